"""Snippets: the densest window of a text, and its rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import runs, tokenized

SIZE = 12
LEAD, TRAIL = "… ", " …"


def windows(docs: DataFrame, query: str, size: int = SIZE) -> DataFrame:
    """``doc_id, start_pos, score``: the window with most query terms, the first of equals."""
    wanted = sorted({t for t, _, _ in runs(query)})
    held = tokenized(docs.select("doc_id", "text")).where(F.size("tokens") > 0)
    hit = F.col("term").isin(wanted) if wanted else F.lit(False)
    at = held.select("doc_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "term")).select("doc_id", "n", "pos", hit.cast("long").alias("hit"))
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, size - 1)
    full = at.withColumn("score", F.sum("hit").over(frame)).where(F.col("pos") <= F.col("n") - F.least("n", F.lit(size)))
    return full.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("best")).select("doc_id", (-F.col("best.back")).cast("int").alias("start_pos"), F.col("best.score").alias("score"))


def snippet(text: str, wanted: set[str], size: int = SIZE) -> tuple[str, list[tuple[int, int]]]:
    """Excerpt and the byte spans in it that match."""
    found = runs(text)
    if not found:
        return text, []
    n = min(size, len(found))
    hits = [t in wanted for t, _, _ in found]
    score = best = sum(hits[:n])
    at = 0
    for i in range(n, len(found)):
        score += hits[i] - hits[i - n]
        if score > best:
            best, at = score, i - n + 1
    data = text.encode()
    begin, end = found[at][1], found[at + n - 1][2]
    lead = LEAD.encode() if at else b""
    body = lead + data[begin:end] + (TRAIL.encode() if at + n < len(found) else b"")
    spans = [(s - begin + len(lead), e - begin + len(lead)) for (_, s, e), h in zip(found[at : at + n], hits[at : at + n]) if h]
    return body.decode(), spans


_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"})


def marked(text: str, spans: list[tuple[int, int]]) -> str:
    """HTML of an excerpt: escaped, the spans within marks."""
    data, out, at = text.encode(), [], 0
    for s, e in spans:
        out += [data[at:s].decode().translate(_ESCAPES), "<mark>", data[s:e].decode().translate(_ESCAPES), "</mark>"]
        at = e
    return "".join([*out, data[at:].decode().translate(_ESCAPES)])


def snippets(text: Column, query: str, size: int = SIZE) -> Column:
    """Struct of the excerpt and its spans."""
    wanted = {t for t, _, _ in runs(query)}

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("matches", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]))
    def cut(col: pd.Series) -> pd.DataFrame:
        got = [snippet(t or "", wanted, size) for t in col]
        return pd.DataFrame({"text": [g[0] for g in got], "matches": [[{"start": s, "end": e} for s, e in g[1]] for g in got]})

    return cut(text)


def snippet_html(text: Column, query: str, size: int = SIZE) -> Column:
    wanted = {t for t, _, _ in runs(query)}

    @F.pandas_udf(T.StringType())
    def render(col: pd.Series) -> pd.Series:
        return col.map(lambda t: marked(*snippet(t or "", wanted, size)))

    return render(text)
