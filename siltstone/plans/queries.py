"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions.hashing import bloom_size, fnv1a_64
from ..functions.language import LEAST, detected
from ..functions.text import content_hash, duration, origin, paragraphs, passage_id, tokenized, tokens_with_offsets
from ..functions.urls import canonical_url
from ..operators import crawl, dedup, evaluate, hybrid, index, rank, snippet, vector
from ..session import lasting_dir, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}

PHRASE = "of the"
TERMS = "the nation of erin that"
TOK = r"list_transform(regexp_extract_all(text, '\p{L}+|\p{Nd}+'), lambda x: lower(x))"
HELD = f"held AS (SELECT doc_id, {TOK} AS toks FROM documents)"
OCC = f"{HELD}, occ AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM held)"
TF = f"{OCC}, tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL)"
LEN = "lens AS (SELECT doc_id, len(toks) AS dl FROM held), stats AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM lens)"
DEAD = "SELECT doc_id FROM labels WHERE toxic = 1"
FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(octet_length(encode(term))), lambda i: ('0x' || substr(hex(encode(term)), (2 * i + 1)::int, 2))::uhugeint)), lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def docs_of(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def pages_of(spark, d) -> DataFrame:
    return spread(table(spark, d, "pages"))


def deleted_of(spark, d) -> DataFrame:
    return table(spark, d, "labels").where("toxic = 1").select("doc_id")


# ---- text ------------------------------------------------------------------


@register("tokenize_stats", f"WITH {OCC} SELECT count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM occ")
def tokenize_stats(spark, d):
    return index.occurrences(docs_of(spark, d)).agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


@register("token_lists", f"WITH {HELD} SELECT doc_id, array_to_string(toks, ' ') AS terms FROM held")
def token_lists(spark, d):
    return tokenized(docs_of(spark, d)).select("doc_id", F.array_join("tokens", " ").alias("terms"))


@register("token_offsets", f"WITH {OCC}, o AS (SELECT term, count(*) AS n FROM occ GROUP BY ALL) SELECT term, n, (n * octet_length(encode(term)))::BIGINT AS bytes FROM o")
def token_offsets(spark, d):
    """Bytes that each term's spans cover in the texts."""
    spans = docs_of(spark, d).select(F.explode(tokens_with_offsets("text")).alias("t"))
    return spans.groupBy(F.col("t.text").alias("term")).agg(F.count("*").alias("n"), F.sum(F.col("t.end") - F.col("t.start")).alias("bytes"))


@register(
    "token_spans",
    r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '\p{L}+|\p{Nd}+') AS toks, regexp_split_to_array(text, '\p{L}+|\p{Nd}+') AS gaps FROM documents),
    u AS (SELECT doc_id, unnest(toks) AS tok, unnest(gaps[1:len(toks)]) AS gap, generate_subscripts(toks, 1) AS i FROM r),
    p AS (SELECT doc_id, i, tok, sum(octet_length(encode(gap)) + octet_length(encode(tok))) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM u)
    SELECT doc_id, (i - 1)::INT AS pos, lower(tok) AS term, (stop - octet_length(encode(tok)))::INT AS start, stop::INT AS stop FROM p""",
)
def token_spans(spark, d):
    """Every term with its place in the text's bytes."""
    held = docs_of(spark, d).select("doc_id", F.posexplode(tokens_with_offsets("text")).alias("pos", "t"))
    return held.select("doc_id", "pos", F.col("t.text").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("stop"))


@register(
    "paragraph_split",
    r"WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[\t\n\f\r ]*\n'), lambda x: regexp_replace(x, '^[\s]+|[\s]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents) SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS nth, unnest(ps) AS paragraph FROM p",
)
def paragraph_split(spark, d):
    return docs_of(spark, d).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("nth", "paragraph"))


@register(
    "duration_extract",
    r"SELECT doc_id, nullif(regexp_extract(text, '(?i)\b[0-9]+[\t\n\f\r ]+(day|days|week|weeks|month|months|year|years)\b', 0), '') AS duration FROM documents",
)
def duration_extract(spark, d):
    return docs_of(spark, d).select("doc_id", duration(F.col("text")).alias("duration"))


@register("passage_ids", "SELECT doc_id, sha256(source || chr(0) || text) AS passage_id FROM documents")
def passage_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", passage_id(F.col("source"), F.col("text")).alias("passage_id"))


@register("content_hashes", "SELECT page_id, sha256(html) AS sha FROM pages")
def content_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", content_hash(F.col("html")).alias("sha"))


@register("language_gate", f"SELECT doc_id, length(text) >= {LEAST} AS long_enough FROM documents")
def language_gate(spark, d):
    return docs_of(spark, d).select("doc_id", (F.length("text") >= LEAST).alias("long_enough"))


@register("language_detect")
def language_detect(spark, d):
    return docs_of(spark, d).select("doc_id", detected("text").alias("language"))


@register("fnv_terms", f"WITH {OCC}, t AS (SELECT DISTINCT term FROM occ), h AS (SELECT term, {FNV} AS h FROM t) SELECT term, (CASE WHEN h >= 9223372036854775808::uhugeint THEN h::hugeint - 18446744073709551616::hugeint ELSE h::hugeint END)::BIGINT AS h FROM h")
def fnv_terms(spark, d):
    return index.occurrences(docs_of(spark, d)).select("term").distinct().withColumn("h", fnv1a_64("term"))


@register("host_of", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host FROM pages")
def host_of(spark, d):
    return table(spark, d, "pages").select("page_id", origin(F.col("url")).alias("host"))


@register(
    "url_canonical",
    """WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)
    SELECT page_id, regexp_extract(u, '^[^?]*', 0) || CASE WHEN contains(u, '?') THEN '?' || array_to_string(list_sort(string_split(regexp_extract(u, '[?](.*)$', 1), '&')), '&') ELSE '' END AS canonical FROM u""",
)
def url_canonical(spark, d):
    return pages_of(spark, d).select("page_id", canonical_url("url").alias("canonical"))


@register("url_canonical_cases", """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
    SELECT page_id, scheme || '://' || host || CASE WHEN page_id % 4 = 3 THEN ':8080' ELSE '' END || CASE page_id % 5 WHEN 0 THEN '/x/~z%2F/' WHEN 1 THEN '/b' WHEN 2 THEN '/' WHEN 3 THEN '/a/b' ELSE '' END || '?a=A+b&b=2&b=1' AS canonical FROM p""")
def url_canonical_cases(spark, d):
    """Addresses with capitals, ports, escapes, dot segments and fragments, made of the pages' own."""
    scheme, host = F.parse_url("url", F.lit("PROTOCOL")), F.parse_url("url", F.lit("HOST"))
    nth = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod("page_id", F.lit(n)) + 1).cast("int"))
    port = F.when(F.pmod("page_id", F.lit(4)) == 3, ":8080").when(F.pmod("page_id", F.lit(4)) == 2, F.when(scheme == "https", ":443").otherwise(":80")).otherwise("")
    made = F.concat(F.upper(scheme), F.lit("://"), F.upper(host), port, nth(5, "/x/./y/../%7Ez%2f/", "/a/../b", "/", "//a//b", ""), F.lit("?b=2&a=%41%20b&b=1#top"))
    return pages_of(spark, d).select("page_id", canonical_url(made).alias("canonical"))


WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@register("token_folding", f"WITH {HELD} SELECT doc_id, array_to_string(toks, ' ') AS terms FROM held")
def token_folding(spark, d):
    """Terms of the texts in full-width letters, which compatibility folding makes narrow again."""
    wide = docs_of(spark, d).select("doc_id", F.translate("text", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", WIDE).alias("text"))
    return tokenized(wide).select("doc_id", F.array_join("tokens", " ").alias("terms"))


# ---- index -----------------------------------------------------------------


@register("term_frequency", f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def term_frequency(spark, d):
    return index.term_frequency(docs_of(spark, d))


@register("positional_postings", f"WITH {OCC} SELECT term, doc_id, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM occ GROUP BY term, doc_id")
def positional_postings(spark, d):
    return index.postings(docs_of(spark, d)).withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@register("doc_lengths", f"WITH {HELD} SELECT doc_id, len(toks) AS dl FROM held")
def doc_lengths(spark, d):
    return index.doc_lengths(docs_of(spark, d))


@register("corpus_stats", f"WITH {HELD}, {LEN} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, d):
    return index.corpus_stats(index.doc_lengths(docs_of(spark, d))).withColumn("avgdl", F.round("avgdl", 6))


@register("document_frequency", f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def document_frequency(spark, d):
    return index.document_frequency(index.term_frequency(docs_of(spark, d)))


@register("dictionary_terms", f"WITH {OCC} SELECT DISTINCT term FROM occ")
def dictionary_terms(spark, d):
    return index.dictionary(index.occurrences(docs_of(spark, d)))


@register("posting_delta_gaps", f"WITH {OCC} SELECT doc_id, term, pos::INT AS pos, (pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id, term ORDER BY pos))::INT AS gap FROM occ")
def posting_delta_gaps(spark, d):
    return index.posting_gaps(index.postings(docs_of(spark, d)))


@register("varint_size", f"WITH {OCC}, g AS (SELECT term, pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id, term ORDER BY pos) AS gap FROM occ) SELECT term, sum(greatest(1, ceil(length(ltrim(bin(gap), '0')) / 7.0)))::BIGINT AS bytes FROM g GROUP BY term")
def varint_size(spark, d):
    return index.posting_gaps(index.postings(docs_of(spark, d))).groupBy("term").agg(F.sum(index.varint_bytes(F.col("gap").cast("long"))).alias("bytes"))


@register("contiguity_check", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, min(doc_id) AS low, max(doc_id) AS high FROM documents")
def contiguity_check(spark, d):
    return index.contiguous(docs_of(spark, d))


@register("row_checksums")
def row_checksums(spark, d):
    return index.checksums(docs_of(spark, d), ["doc_id", "text"]).select("doc_id", "crc")


@register("multi_segment_ids", "WITH s AS (SELECT doc_id, doc_id % 3 AS segment_id, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS local_id FROM documents), b AS (SELECT segment_id, coalesce(sum(count(*)) OVER (ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM s GROUP BY segment_id) SELECT doc_id, segment_id, local_id, base + local_id AS global_id FROM s JOIN b USING (segment_id)")
def multi_segment_ids(spark, d):
    return index.global_ids(index.segment_docs(docs_of(spark, d), F.pmod("doc_id", F.lit(3)))).select("doc_id", "segment_id", "local_id", "global_id")


@register("segment_locate", "SELECT doc_id, row_number() OVER (ORDER BY doc_id % 3, doc_id) - 1 AS global_id, doc_id % 3 AS segment_id, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS local_id FROM documents")
def segment_locate(spark, d):
    held = index.global_ids(index.segment_docs(docs_of(spark, d), F.pmod("doc_id", F.lit(3))))
    return index.located(held.select("doc_id", "global_id"), index.bases(held)).select("doc_id", "global_id", "segment_id", "local_id")


@register("segment_avgdl", f"WITH {HELD}, {LEN} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def segment_avgdl(spark, d):
    return index.joint_avgdl(index.doc_lengths(docs_of(spark, d)).withColumn("segment_id", F.pmod("doc_id", F.lit(3)))).withColumn("avgdl", F.round("avgdl", 6))


@register("segment_merge_gc", f"WITH s AS (SELECT doc_id, doc_id % 3 AS segment_id FROM documents WHERE doc_id NOT IN ({DEAD})) SELECT doc_id, row_number() OVER (ORDER BY segment_id, doc_id) - 1 AS new_id FROM s")
def segment_merge_gc(spark, d):
    held = index.segment_docs(docs_of(spark, d).select("doc_id"), F.pmod("doc_id", F.lit(3)))
    return index.merged(held, deleted_of(spark, d)).select("doc_id", "new_id")


@register("merged_terms", f"WITH {TF} SELECT term, count(*) AS df FROM tf WHERE doc_id NOT IN ({DEAD}) GROUP BY term")
def merged_terms(spark, d):
    return index.document_frequency(index.term_frequency(rank.without(docs_of(spark, d), deleted_of(spark, d))))


# ---- ranking ---------------------------------------------------------------


def bm25_sql(terms: str, tail: str) -> str:
    """SQL of BM25 for a CTE ``q(query_id, term, qtf)``; the tail selects from ``ranked``."""
    return f"""WITH {TF}, {LEN}, {terms}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      scored AS (SELECT q.query_id, tf.doc_id, sum(q.qtf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * (tf.tf * 2.5e0) / (tf.tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term) JOIN lens ON lens.doc_id = tf.doc_id CROSS JOIN stats GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
      {tail}"""


def fixed(text: str) -> str:
    from ..functions.text import runs

    counts: dict[str, int] = {}
    for t, _, _ in runs(text):
        counts[t] = counts.get(t, 0) + 1
    return "q AS (SELECT * FROM (VALUES " + ", ".join(f"(0, '{t}', {n})" for t, n in counts.items()) + ") v(query_id, term, qtf))"


BENCH = r"q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '\p{L}+|\p{Nd}+'), lambda x: lower(x))) AS term FROM benchmark) GROUP BY ALL)"


def bench_terms(spark, d) -> DataFrame:
    held = tokenized(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return held.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def one(spark, d, text: str) -> DataFrame:
    return rank.ranked(rank.bm25(docs_of(spark, d), rank.query_terms(spark, {0: text})))


@register("bm25_search", bm25_sql(fixed(TERMS), "SELECT doc_id, round(score, 6) AS score, rank FROM ranked"))
def bm25_search(spark, d):
    return one(spark, d, TERMS).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("bm25_top10", bm25_sql(fixed(TERMS), "SELECT doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"))
def bm25_top10(spark, d):
    return bm25_search(spark, d).where("rank <= 10")


@register("bm25_repeated_terms", bm25_sql(fixed("erin erin erin that"), "SELECT doc_id, round(score, 6) AS score, rank FROM ranked"))
def bm25_repeated_terms(spark, d):
    return one(spark, d, "erin erin erin that").select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("bm25_multi_query", bm25_sql(BENCH, "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"))
def bm25_multi_query(spark, d):
    out = rank.best(docs_of(spark, d), bench_terms(spark, d), 10)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("bm25_tombstoned", bm25_sql(fixed(TERMS), f"SELECT doc_id, round(score, 6) AS score FROM ranked WHERE doc_id NOT IN ({DEAD})"))
def bm25_tombstoned(spark, d):
    return rank.without(one(spark, d, TERMS), deleted_of(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


@register("idf_terms", f"WITH {TF}, {LEN} SELECT term, round(ln((n - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1e0), 6) AS idf FROM tf CROSS JOIN stats GROUP BY term, n")
def idf_terms(spark, d):
    df = index.document_frequency(index.term_frequency(docs_of(spark, d)))
    n = F.broadcast(docs_of(spark, d).agg(F.count("*").alias("n")))
    return df.crossJoin(n).select("term", F.round(rank.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@register("term_lookup", f"WITH {TF} SELECT doc_id, tf FROM tf WHERE term = 'erin'")
def term_lookup(spark, d):
    held = rank.matches(docs_of(spark, d), rank.query_terms(spark, {0: "erin"}))
    return held.where(F.size("found") > 0).select("doc_id", F.size("found").cast("long").alias("tf"))


@register("phrase_search", f"WITH {OCC} SELECT DISTINCT doc_id FROM (SELECT doc_id, pos - i AS s FROM occ JOIN (VALUES (0, 'of'), (1, 'the')) q(i, t) ON term = t GROUP BY ALL HAVING count(DISTINCT i) = 2)")
def phrase_search(spark, d):
    return rank.with_phrase(docs_of(spark, d), PHRASE)


@register("boolean_and_terms", f"WITH {HELD} SELECT doc_id FROM held WHERE list_has_all(toks, ['erin', 'that', 'of'])")
def boolean_and_terms(spark, d):
    return rank.with_all_terms(docs_of(spark, d), "erin that of")


@register("reverse_id_map", "SELECT sha256('x' || chr(0) || text) AS passage_id, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def reverse_id_map(spark, d):
    return docs_of(spark, d).groupBy(passage_id(F.lit("x"), F.col("text")).alias("passage_id")).agg(F.max_by("doc_id", "doc_id").alias("doc_id"))


# ---- stored index ----------------------------------------------------------

_stored: dict[tuple[str, str], str] = {}


def stored_of(spark, d) -> index.Index:
    """The documents' index in three segments: written once an application, read by every search."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        path = lasting_dir(spark)
        index.write_index(docs_of(spark, d), path, F.pmod("doc_id", F.lit(3)))
        _stored[key] = path
    return index.Index(spark, _stored[key])


@register("bm25_stored", bm25_sql(fixed(TERMS), "SELECT doc_id, round(score, 6) AS score, rank FROM ranked"))
def bm25_stored(spark, d):
    out = rank.ranked(rank.bm25_index(stored_of(spark, d), rank.query_terms(spark, {0: TERMS})))
    return out.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("phrase_stored", f"WITH {OCC} SELECT DISTINCT doc_id FROM (SELECT doc_id, pos - i AS s FROM occ JOIN (VALUES (0, 'of'), (1, 'the')) q(i, t) ON term = t GROUP BY ALL HAVING count(DISTINCT i) = 2)")
def phrase_stored(spark, d):
    return rank.with_phrase_index(stored_of(spark, d), PHRASE)


@register("dictionary_stored", f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def dictionary_stored(spark, d):
    return stored_of(spark, d).dictionary.groupBy("term").agg(F.sum("df").alias("df"))


@register("merged_stored", f"WITH {TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM tf WHERE doc_id NOT IN ({DEAD}) GROUP BY term")
def merged_stored(spark, d):
    """The stored segments merged into one of a new index, without the deleted documents."""
    stored_of(spark, d)
    path = lasting_dir(spark)
    index.merge_index(spark, _stored[spark.sparkContext.applicationId, d], deleted_of(spark, d), path)
    held = index.Index(spark, path)
    return held.dictionary.select("term", "df").join(held.postings.groupBy("term").agg(F.sum("tf").alias("n")), "term")


@register("gap_round_trip", f"WITH {OCC} SELECT doc_id, term, pos::INT AS pos FROM occ")
def gap_round_trip(spark, d):
    """Positions as gaps, as varint bytes, and back; gaps that don't rise would fail."""
    held = index.decoded(index.coded(docs_of(spark, d)))
    return held.select("doc_id", "term", F.explode("positions").alias("pos"))


# ---- vectors and fusion ----------------------------------------------------

SIM = "sim AS (SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def vectors_of(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def vector_zero(spark, d) -> list[float]:
    return vectors_of(spark, d).where("vec_id = 0").head()["embedding"]


@register("knn_top10", f"WITH {SIM} SELECT vec_id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM sim QUALIFY rank <= 10")
def knn_top10(spark, d):
    out = vector.with_rank(vector.nearest(vectors_of(spark, d), vector_zero(spark, d), 10))
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@register("knn_stored", f"WITH {SIM} SELECT vec_id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM sim QUALIFY rank <= 10")
def knn_stored(spark, d):
    """The same over a stored index by cells, of which it visits all, so that it is exact."""
    path = lasting_dir(spark)
    vector.write_vectors(vectors_of(spark, d), path, 16)
    out = vector.with_rank(vector.StoredVectors(spark, path).nearest(vector_zero(spark, d), 10))
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


GONE = "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0"


@register("knn_overfetch_live", f"WITH {SIM}, t AS (SELECT * FROM sim ORDER BY similarity DESC, vec_id LIMIT 30) SELECT vec_id, round(similarity, 6) AS similarity FROM t WHERE vec_id NOT IN ({GONE}) ORDER BY t.similarity DESC, vec_id LIMIT 10")
def knn_overfetch_live(spark, d):
    gone = table(spark, d, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("vec_id"))
    return vector.nearest_live_overfetch(vectors_of(spark, d), vector_zero(spark, d), 10, gone).select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("knn_live", f"WITH {SIM} SELECT vec_id, round(similarity, 6) AS similarity FROM sim WHERE vec_id NOT IN ({GONE}) ORDER BY sim.similarity DESC, vec_id LIMIT 10")
def knn_live(spark, d):
    gone = table(spark, d, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("vec_id"))
    return vector.nearest_live(vectors_of(spark, d), vector_zero(spark, d), 10, gone).select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("vector_upsert_last_wins", "WITH b AS (SELECT label AS vec_id, embedding, vec_id AS seq FROM embeddings), l AS (SELECT vec_id, arg_max(embedding[1], seq) AS first FROM b GROUP BY vec_id) SELECT vec_id::BIGINT AS vec_id, round(first::DOUBLE, 6) AS first FROM l UNION ALL SELECT vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM l)")
def vector_upsert_last_wins(spark, d):
    held = table(spark, d, "embeddings")
    batch = held.select(F.col("label").cast("long").alias("vec_id"), "embedding", F.col("vec_id").alias("seq"))
    return vector.upserted(held.select("vec_id", "embedding"), batch).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


LEX = bm25_sql(fixed(TERMS), "")
RRF = f"""{LEX}, {SIM}, sem AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM sim QUALIFY rank <= 10),
  f AS (SELECT doc_id, sum(1e0 / (60 + rank)) AS rrf FROM (SELECT doc_id, rank FROM ranked UNION ALL SELECT doc_id, rank FROM sem) GROUP BY doc_id)
  SELECT doc_id, round(rrf, 9) AS rrf, row_number() OVER (ORDER BY round(rrf, 12) DESC, doc_id) AS rank FROM f"""


@register("hybrid_search", RRF)
def hybrid_search(spark, d):
    """Flagship: BM25 fused with the ten nearest vectors."""
    q = vector_zero(spark, d)
    out = hybrid.hybrid(docs_of(spark, d), vectors_of(spark, d), TERMS, lambda _: q)
    return out.select("doc_id", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@register("hybrid_stored", RRF)
def hybrid_stored(spark, d):
    q = vector_zero(spark, d)
    out = hybrid.hybrid_index(stored_of(spark, d), vectors_of(spark, d), TERMS, lambda _: q)
    return out.select("doc_id", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@register("hybrid_fallback", f"{LEX} SELECT doc_id, rank FROM ranked")
def hybrid_fallback(spark, d):
    """The embedder fails: the BM25 order stands."""

    def broken(_):
        raise RuntimeError("embedding service is down")

    return hybrid.hybrid(docs_of(spark, d), vectors_of(spark, d), TERMS, broken).select("doc_id", F.col("rank").cast("long").alias("rank"))


@register("rrf_fusion", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC, quality) AS rank FROM labels), f AS (SELECT doc_id, sum(1e0 / (60 + rank)) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id) SELECT doc_id, round(rrf, 9) AS rrf FROM f")
def rrf_fusion(spark, d):
    a = rank.numbered(table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id")
    b = rank.numbered(table(spark, d, "labels").select("doc_id", "quality"), F.col("doc_id"), "quality")
    return hybrid.fused([a, b]).select("doc_id", F.round("rrf", 9).alias("rrf"))


# ---- snippets --------------------------------------------------------------


@register("snippet_window", f"""WITH {OCC}, h AS (SELECT doc_id, pos, (term IN ('the', 'nation', 'of', 'erin', 'that'))::INT AS hit, count(*) OVER (PARTITION BY doc_id) AS n FROM occ),
  w AS (SELECT doc_id, pos, n, sum(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS score FROM h)
  SELECT doc_id, pos::INT AS start_pos, score::BIGINT AS score FROM w WHERE pos <= n - least(n, 12) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w.score DESC, pos) = 1""")
def snippet_window(spark, d):
    return snippet.windows(docs_of(spark, d), TERMS)


ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&#34;'), chr(39), '&#39;')"


@register("snippet_html", rf"""WITH r AS (SELECT doc_id, text, regexp_extract_all(text, '\p{{L}}+|\p{{Nd}}+') AS toks, regexp_split_to_array(text, '\p{{L}}+|\p{{Nd}}+') AS gaps FROM documents),
  u AS (SELECT doc_id, unnest(toks) AS tok, unnest(gaps[1:len(toks)]) AS gap, generate_subscripts(toks, 1) - 1 AS pos, len(toks) AS n FROM r),
  h AS (SELECT *, (lower(tok) IN ('the', 'nation', 'of', 'erin', 'that'))::INT AS hit FROM u),
  w AS (SELECT doc_id, pos AS s, n, sum(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS score FROM h),
  b AS (SELECT doc_id, s FROM w WHERE s <= n - least(n, 12) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s) = 1),
  e AS (SELECT doc_id, any_value(s) AS s, any_value(n) AS n, string_agg(CASE WHEN pos > s THEN {ESC.format('gap')} ELSE '' END || CASE WHEN hit = 1 THEN '<mark>' || {ESC.format('tok')} || '</mark>' ELSE {ESC.format('tok')} END, '' ORDER BY pos) AS body FROM h JOIN b USING (doc_id) WHERE pos BETWEEN s AND s + 11 GROUP BY doc_id)
  SELECT r.doc_id, CASE WHEN len(toks) = 0 THEN {ESC.format('text')} ELSE CASE WHEN s > 0 THEN '… ' ELSE '' END || body || CASE WHEN s + 12 < n THEN ' …' ELSE '' END END AS snippet_html FROM r LEFT JOIN e USING (doc_id)""")
def snippet_html(spark, d):
    return docs_of(spark, d).select("doc_id", snippet.snippet_html(F.col("text"), TERMS).alias("snippet_html"))


# ---- duplicates ------------------------------------------------------------


@register("exact_dedup", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def exact_dedup(spark, d):
    return dedup.first_seen(table(spark, d, "pages").select("url", "page_id"))


@register("url_keys", "SELECT page_id, substr(sha256(url), 1, 32) AS url_key FROM pages")
def url_keys(spark, d):
    return table(spark, d, "pages").select("page_id", dedup.url_key(F.col("url")).alias("url_key"))


KNOWN = "SELECT url FROM pages WHERE starts_with(url, 'https')"


@register("known_page_anti", f"SELECT page_id, url FROM pages WHERE url NOT IN ({KNOWN})")
def known_page_anti(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return dedup.unseen(pages, pages.where("url LIKE 'https%'")).select("page_id", "url")


@register("enqueue_capped", f"SELECT min(page_id) AS seq, url FROM pages WHERE url NOT IN ({KNOWN}) GROUP BY url ORDER BY 1, 2 LIMIT 40")
def enqueue_capped(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url")
    return dedup.admitted(pages, pages.where("url LIKE 'https%'")).select("seq", "url")


@register("bloom_sizing", "SELECT n, ceil(-n * ln(0.01e0) / (ln(2e0) * ln(2e0)))::BIGINT AS m, greatest(1, round(ceil(-n * ln(0.01e0) / (ln(2e0) * ln(2e0))) / n * ln(2e0)))::BIGINT AS k FROM (SELECT count(*) AS n FROM pages)")
def bloom_sizing(spark, d):
    n = table(spark, d, "pages").count()
    return spark.createDataFrame([(n, *bloom_size(n, 0.01))], "n long, m long, k long")


FP = f"""{TF}, t AS (SELECT DISTINCT term FROM tf), h AS (SELECT term, ({FNV})::UBIGINT AS h FROM t),
  v AS (SELECT doc_id, b, sum(CASE WHEN (h.h >> b::UBIGINT) & 1 = 1 THEN tf ELSE -tf END) AS v FROM tf JOIN h USING (term), range(64) r(b) GROUP BY ALL),
  s AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << b::INT) ELSE 0 END) AS s FROM v GROUP BY doc_id),
  fp AS (SELECT d.doc_id, coalesce(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END, 0)::BIGINT AS fp FROM documents d LEFT JOIN s USING (doc_id))"""


@register("simhash_fingerprint", f"WITH {FP} SELECT doc_id, fp FROM fp")
def simhash_fingerprint(spark, d):
    return dedup.fingerprints(docs_of(spark, d))


@register("near_dup_pairs", f"WITH {FP}, c AS (SELECT fp, min(doc_id) AS id FROM fp WHERE fp <> 0 GROUP BY fp) SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= 3")
def near_dup_pairs(spark, d):
    """Pairs of different fingerprints, each by the least id that has it."""
    return dedup.near_pairs(dedup.fingerprints(docs_of(spark, d)))


@register("near_dup_members", f"WITH {FP} SELECT doc_id, CASE WHEN fp = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY fp) END AS class_id, CASE WHEN fp = 0 THEN 1 ELSE count(*) OVER (PARTITION BY fp) END AS copies FROM fp")
def near_dup_members(spark, d):
    """The documents that each fingerprint stands for."""
    return dedup.members(dedup.fingerprints(docs_of(spark, d)))


# ---- crawl -----------------------------------------------------------------


@register("frontier_schedule", "WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, user_id, make_timestamp(max(t - n * 5000000) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + n * 5000000) AS ready_at FROM q")
def frontier_schedule(spark, d):
    queue = table(spark, d, "events").select("event_id", "user_id", "ts")
    return crawl.schedule(queue, 5.0, "user_id", "event_id").select("event_id", "user_id", F.col("ready_at").cast("timestamp_ntz").alias("ready_at"))


@register("backoff_schedule", "SELECT attempt, least(500 * (1::BIGINT << attempt::INT), 30000)::BIGINT AS wait_ms FROM range(10) r(attempt)")
def backoff_schedule(spark, d):
    return spark.range(10).select(F.col("id").alias("attempt"), crawl.backoff(F.col("id")).alias("wait_ms"))


@register("retry_policy", "SELECT status, status = 429 OR status BETWEEN 500 AND 599 AS retried FROM range(100, 600) r(status)")
def retry_policy(spark, d):
    return spark.range(100, 600).select(F.col("id").alias("status"), crawl.retried(F.col("id")).alias("retried"))


@register("redirect_chains", "WITH RECURSIVE r AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey // 2) AS dst FROM nation WHERE n_nationkey > 2), h(url, final, hops) AS (SELECT 'n' || n_nationkey, 'n' || n_nationkey, 0 FROM nation UNION ALL SELECT h.url, r.dst, h.hops + 1 FROM h JOIN r ON r.src = h.final WHERE h.hops < 10) SELECT url, final, hops FROM h WHERE final NOT IN (SELECT src FROM r)")
def redirect_chains(spark, d):
    nation = table(spark, d, "nation")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    links = nation.where("n_nationkey > 2").select(name(F.col("n_nationkey")).alias("src"), name(F.floor(F.col("n_nationkey") / 2)).alias("dst"))
    return crawl.redirect_targets(links, nation.select(name(F.col("n_nationkey")).alias("url")))


@register("robots_policy", """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, [200, 404, 503][(page_id % 3 + 1)::INT] AS status FROM pages)
    SELECT page_id, status, CASE status WHEN 404 THEN true WHEN 200 THEN CASE WHEN regexp_matches(path, '^/.*[.]html$') THEN false WHEN starts_with(path, '/de/1') THEN true ELSE NOT starts_with(path, '/de/') END ELSE false END AS allowed FROM p""")
def robots_policy(spark, d):
    """Page paths against a robots file, by the status with which it came."""
    body = "User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*.html$\n"
    pages = table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("PATH")).alias("path"), F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503)), (F.pmod("page_id", F.lit(3)) + 1).cast("int")).alias("status"))
    return pages.select("page_id", "status", crawl.robots_decision(F.col("status"), crawl.robots_rules("siltstone")(F.lit(body), F.col("path"))).alias("allowed"))


@register("link_discovery", """WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host, list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS found, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM pages),
    l AS (SELECT page_id, host, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i FROM h),
    t AS (SELECT page_id, i, CASE WHEN starts_with(href, '/') THEN host || url_decode(regexp_extract(href, '^[^?#]*')) WHEN starts_with(href, host || '/') THEN url_decode(regexp_extract(href, '^[^?#]*')) END AS link FROM l),
    d AS (SELECT page_id, link, min(i) AS i FROM t WHERE link IS NOT NULL GROUP BY ALL)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS seq, link FROM d""")
def link_discovery(spark, d):
    return crawl.discovered(pages_of(spark, d))


@register("fetch_states", """WITH l AS (SELECT page_id AS seq, url, [200, 404, 503][(page_id % 3 + 1)::INT] AS robots_status, page_id % 5 <> 0 AS allowed, CASE WHEN page_id % 7 = 0 THEN 500 ELSE 200 END AS status FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 100000, url FROM pages WHERE page_id % 4 = 0)),
    n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS nth FROM l)
    SELECT seq, url, CASE WHEN nth > 1 THEN 'seen' WHEN robots_status = 503 OR (robots_status = 200 AND NOT allowed) THEN 'disallowed' WHEN status = 200 THEN 'fetched' ELSE 'failed' END AS state FROM n""")
def fetch_states(spark, d):
    """A log in which some addresses come again."""
    pages = table(spark, d, "pages").select("page_id", "url")
    every = pages.unionByName(pages.where("page_id % 4 = 0").withColumn("page_id", F.col("page_id") + 100_000))
    log = every.select(F.col("page_id").alias("seq"), "url", F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503)), (F.pmod("page_id", F.lit(3)) + 1).cast("int")).alias("robots_status"), (F.pmod("page_id", F.lit(5)) != 0).alias("allowed"), F.when(F.pmod("page_id", F.lit(7)) == 0, 500).otherwise(200).alias("status"))
    return crawl.fetch_states(log).select("seq", "url", "state")


@register("content_archive", "SELECT sha256(html) AS sha, min(page_id) AS page_id, count(*) AS times, any_value(octet_length(encode(html)))::BIGINT AS bytes FROM pages GROUP BY 1")
def content_archive(spark, d):
    return crawl.archived(table(spark, d, "pages"))


@register("listing_split", f"""WITH p AS (SELECT page_id, url, CASE WHEN contains(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/en/') THEN 'listing' WHEN url IN ({KNOWN}) THEN 'known' ELSE 'content' END AS kind FROM pages),
    c AS (SELECT page_id FROM p WHERE kind = 'content' ORDER BY page_id LIMIT 40)
    SELECT page_id, url, CASE WHEN kind = 'content' AND page_id > (SELECT max(page_id) FROM c) THEN 'over' ELSE kind END AS kind FROM p""")
def listing_split(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return crawl.split_listings(pages, "/en/", pages.where("url LIKE 'https%'"))


@register("passage_extract")
def passage_extract(spark, d):
    return crawl.extracted(pages_of(spark, d), html.Extractors(default=_article))


def _article(page: str, url: str) -> list[dict]:
    return html.article_passages(page, url, "article")


@register("attribution_join", "WITH h AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host FROM pages), p AS (SELECT host, arg_max(CASE WHEN contains(url, '/en/') THEN 'blog' ELSE 'forum' END, page_id) AS source_type FROM h GROUP BY host) SELECT page_id, host, source_type FROM h JOIN p USING (host)")
def attribution_join(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    policies = pages.select(origin(F.col("url")).alias("host"), F.col("page_id").alias("seq"), F.when(F.col("url").contains("/en/"), "blog").otherwise("forum").alias("source_type"))
    return crawl.attributed(pages, policies).select("page_id", "host", "source_type")


@register("wal_replay_prefix", """WITH l AS (SELECT event_id, '{"id":' || event_id || CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN '' ELSE '}' END AS line FROM events), stop AS (SELECT min(event_id) AS s FROM l WHERE NOT json_valid(line)) SELECT event_id AS line_no, event_id AS id FROM l, stop WHERE event_id < s""")
def wal_replay_prefix(spark, d):
    """A log whose last line is torn."""
    from ..sources.files import replayed

    events = table(spark, d, "events").select("event_id")
    last = F.broadcast(events.agg(F.max("event_id").alias("last")))
    log = events.crossJoin(last).select(F.col("event_id").alias("line_no"), F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.when(F.col("event_id") == F.col("last"), "").otherwise("}")).alias("line"))
    return replayed(log, "id long")


# ---- evaluation ------------------------------------------------------------

EVAL = bm25_sql(BENCH, "").rstrip() + """, top AS (SELECT * FROM ranked WHERE rank <= 10), r AS (SELECT item_id AS query_id, count(quality) FILTER (quality >= 1) AS hits, min(rank) FILTER (quality >= 1) AS first FROM benchmark LEFT JOIN top ON top.query_id = item_id LEFT JOIN labels USING (doc_id) GROUP BY item_id), e AS (SELECT query_id, hits / 10e0 AS p_at_k, coalesce(1e0 / first, 0) AS rr FROM r)"""


def evaluated(spark, d) -> DataFrame:
    ranking = rank.best(docs_of(spark, d), bench_terms(spark, d), 10)
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    qrels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("relevance"))
    return evaluate.by_query(queries, ranking, qrels, 10)


@register("precision_at_10", f"{EVAL} SELECT query_id, round(p_at_k, 6) AS p_at_k, round(rr, 6) AS rr FROM e")
def precision_at_10(spark, d):
    return evaluated(spark, d).select("query_id", F.round("p_at_k", 6).alias("p_at_k"), F.round("rr", 6).alias("rr"))


@register("mrr", f"{EVAL} SELECT round(avg(p_at_k), 6) AS mean_p_at_k, round(avg(rr), 6) AS mrr FROM e")
def mrr(spark, d):
    return evaluate.means(evaluated(spark, d)).select(F.round("mean_p_at_k", 6).alias("mean_p_at_k"), F.round("mrr", 6).alias("mrr"))
