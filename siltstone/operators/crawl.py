"""The crawl as dataflow: schedules, retries, redirects, robots, discovery, extraction, policy."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html
from ..functions.text import origin

PASSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "source_url", "product", "product_category", "skin_tone", "climate", "duration_of_use")])


def schedule(queue: DataFrame, delay_s: float = 5.0, host: str = "host", seq: str = "seq", start: str = "ts") -> DataFrame:
    """Adds ``ready_at``: a host's addresses in order, each a delay after the one before.

    An address isn't ready before it was put in (``start``).  ready(i) is the
    larger of its start and ready(i - 1) + delay, so ready(i) - i * delay is a
    running maximum: a window, no loop.
    """
    order = Window.partitionBy(host).orderBy(seq)
    nth = F.row_number().over(order) - 1
    micros = (F.unix_micros(F.col(start).cast("timestamp")) - nth * F.lit(int(delay_s * 1_000_000))).alias("m")
    shifted = queue.withColumn("__n", nth).withColumn("__m", micros)
    high = F.max("__m").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return shifted.withColumn("ready_at", F.timestamp_micros(high + F.col("__n") * F.lit(int(delay_s * 1_000_000)))).drop("__n", "__m")


def backoff(attempt: Column, base_ms: int = 500, most_ms: int = 30_000) -> Column:
    """Wait before the retry: doubled each time, up to a limit."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40))).cast("long"), F.lit(most_ms)).cast("long")


def retried(status: Column) -> Column:
    """Whether a response is tried again: too many requests, server errors, or none at all."""
    return status.isNull() | (status == 429) | status.between(500, 599)


def redirect_targets(redirects: DataFrame, starts: DataFrame, most: int = 10) -> DataFrame:
    """``url, final, hops``: where addresses end, within ``most`` hops; loops don't end and are left out."""
    spark = redirects.sparkSession
    return spark.sql(
        f"""
        WITH RECURSIVE hop(url, final, hops) AS (
          SELECT url, url, 0 FROM {{starts}}
          UNION ALL SELECT h.url, r.dst, h.hops + 1 FROM hop h JOIN {{redirects}} r ON r.src = h.final WHERE h.hops < {int(most)}
        )
        SELECT url, final, hops FROM hop h WHERE NOT EXISTS (SELECT 1 FROM {{redirects}} r WHERE r.src = h.final)""",
        starts=starts.select("url"),
        redirects=redirects.select("src", "dst"),
    )


def fetch_states(log: DataFrame, url: str = "url", seq: str = "seq", robots: str = "robots_status", allowed: str = "allowed", status: str = "status") -> DataFrame:
    """The log of attempts with ``state``, as the fetcher goes on: an address that
    came before is ``seen``, whatever became of it then; the first is
    ``disallowed`` by its host's robots file, ``failed`` or ``fetched``."""
    nth = F.row_number().over(Window.partitionBy(url).orderBy(seq))
    may = robots_decision(F.col(robots), F.col(allowed))
    state = F.when(F.col("__nth") > 1, "seen").when(~may, "disallowed").when(F.col(status).between(200, 299), "fetched").otherwise("failed")
    return log.withColumn("__nth", nth).withColumn("state", state).drop("__nth")


def archived(fetched: DataFrame, body: str = "html", seq: str = "page_id") -> DataFrame:
    """The archive of contents: a row for each different body, by hash, with the first that brought it."""
    return fetched.where(F.col(body).isNotNull()).groupBy(F.sha2(body, 256).alias("sha")).agg(F.min(seq).alias(seq), F.count("*").alias("times"), F.first(F.octet_length(body)).cast("long").alias("bytes"))


def split_listings(pages: DataFrame, listing: str, known: DataFrame, content: tuple[str, ...] | None = None, most: int = 40, url: str = "url", seq: str = "page_id") -> DataFrame:
    """Pages with ``kind``: a ``listing`` (its path matches) is read for links only;
    what isn't one is ``content``, ``known`` from a run before, ``skipped`` where no
    extractor knows its host, or ``over`` the ``most`` new ones of a run."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    seen = known.select(F.col(url)).distinct().withColumn("__known", F.lit(True))
    held = pages.join(seen, url, "left").withColumn("__skip", F.lit(False) if content is None else ~F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(*content), F.lit(False)))
    kind = F.when(path.rlike(listing), "listing").when(F.col("__known"), "known").when(F.col("__skip"), "skipped").otherwise("content")
    held = held.withColumn("kind", kind).drop("__known", "__skip")
    # the first so many new pages: one row a run marks where they end
    last = held.where("kind = 'content'").select(seq).orderBy(seq).limit(most).agg(F.max(seq).alias("__last"))
    return held.crossJoin(F.broadcast(last)).withColumn("kind", F.when((F.col("kind") == "content") & (F.col(seq) > F.col("__last")), "over").otherwise(F.col("kind"))).drop("__last")

def robots_decision(status: Column, allowed: Column) -> Column:
    """No robots file allows all; any other failure denies; else the rules decide."""
    return F.when(status == 404, F.lit(True)).when(status == 200, allowed).otherwise(F.lit(False))


def robots_allows(body: str | None, agent: str, path: str) -> bool:
    """The rules for an agent: the longest matching one decides, allow before disallow."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    fresh = True
    for line in (body or "").splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if fresh and groups and not groups[-1][1]:
                groups[-1][0].append(value.lower())
            else:
                groups.append(([value.lower()], []))
            fresh = True
        elif key in ("allow", "disallow") and groups:
            fresh = False
            if value:
                groups[-1][1].append((key == "allow", value))
    name = agent.lower().partition("/")[0]
    own = [r for names, rules in groups if name in names for r in rules]
    named = any(name in names for names, _ in groups)
    rules = own if named else [r for names, rules in groups if "*" in names for r in rules]
    best = (-1, True)
    for allow, rule in rules:
        pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + ("$" if rule.endswith("$") else "")
        if re.match(pattern, path):
            best = max(best, (len(rule), allow))
    return best[1]


def robots_rules(agent: str):
    """Pandas UDF over (body, path)."""

    @F.pandas_udf(T.BooleanType())
    def allows(body: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([robots_allows(b, agent, p or "/") for b, p in zip(body, path)])

    return allows


def discovered(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """``page_id, seq, link``: same-host links of the pages, in order."""

    def run(batches):
        for pdf in batches:
            rows = [(p, i, x) for p, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"]) if u is not None for i, x in enumerate(html.links(h, u, pattern))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "link"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, seq int, link string")


def extracted(pages: DataFrame, extractors: html.Extractors) -> DataFrame:
    """``page_id, seq`` and the passages of the pages; hosts that aren't known give none."""

    def run(batches):
        for pdf in batches:
            rows = [{"page_id": p, "seq": i, **x} for p, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"]) for i, x in enumerate(extractors.passages(h, u))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", *PASSAGE.names])

    return pages.select("page_id", "url", "html").mapInPandas(run, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("seq", T.IntegerType()), *PASSAGE.fields]))


def latest(registrations: DataFrame, key: str = "host", seq: str = "seq") -> DataFrame:
    """The last registration of each host."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return registrations.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", seq)


def attributed(rows: DataFrame, policies: DataFrame, url: str = "url") -> DataFrame:
    """Rows with their host's policy; running it fails on a host without one."""
    held = rows.withColumn("host", origin(F.col(url)))
    joined = held.join(latest(policies), "host", "left")
    known = F.assert_true(F.col("source_type").isNotNull(), F.concat(F.lit("no policy for "), F.coalesce("host", F.lit("?"))))
    return joined.withColumn("__ok", known).where("__ok is null").drop("__ok")
