"""Text, hashes, addresses, languages: known cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import hashing, html, language, text, urls


@pytest.mark.parametrize(
    "given_text, terms",
    [
        ("SPF50", ["spf", "50"]),
        ("SPF 50", ["spf", "50"]),
        ("50ml", ["50", "ml"]),
        ("non-comedogenic", ["non", "comedogenic"]),
        ("10% niacinamide", ["10", "niacinamide"]),
        ("doesn't", ["doesn", "t"]),
        ("", []),
        ("   ", []),
        ("!?.,", []),
        ("x² ½", ["x"]),
        ("ét", ["e", "t"]),
    ],
)
def test_terms(spark, given_text, terms):
    assert [t for t, _, _ in text.runs(given_text)] == terms
    row = text.tokenized(spark.createDataFrame([(given_text,)], "text string")).head()
    assert row["tokens"] == terms


def test_spans_are_bytes():
    assert text.runs("café latte")[1] == ("latte", 6, 11)


def test_compatibility_letters_fold_but_keep_their_span(spark):
    styled = "\U0001d413\U0001d42b\U0001d42e Extract"
    (a, s, e), _ = text.runs(styled)
    assert a == "tru" and styled.encode()[s:e].decode() == styled.split()[0]
    assert text.tokenized(spark.createDataFrame([(styled,)], "text string")).head()["tokens"] == ["tru", "extract"]


def test_null_text_has_no_terms(spark):
    assert text.tokenized(spark.createDataFrame([(None,)], "text string")).head()["tokens"] == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_spans_slice_the_text(value):
    data = value.encode("utf-8", "surrogatepass")
    if "�" in value or any(0xD800 <= ord(c) < 0xE000 for c in value):
        return
    for term, s, e in text.runs(value):
        assert text.fold(data[s:e].decode()) == term


def test_paragraphs(spark):
    df = spark.createDataFrame([("a\n\n b \n \t\nc\n\n\n",), ("one",), ("\n\n",)], "t string")
    assert [r[0] for r in df.select(text.paragraphs(F.col("t"))).collect()] == [["a", "b", "c"], ["one"], []]


def test_duration(spark):
    cases = {"used for 3 weeks": "3 weeks", "1 month": "1 month", "2 years on": "2 years", "5 DAYS": "5 DAYS", "three weeks": None, "a while": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(text.duration(F.col("t"))).collect()] == list(cases.values())


def test_passage_id_keeps_the_boundary(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", "c")], "u string, t string")
    a, b, c = [r[0] for r in df.select(text.passage_id(F.col("u"), F.col("t"))).collect()]
    assert a == c != b and len(a) == 64


def test_fnv_vectors(spark):
    expected = {"a": 12638187200555641996, "foobar": 9625390261332436968, "é": 775207407765167617}
    assert hashing.fnv1a_many(list(expected)).tolist() == list(expected.values())
    assert [hashing.fnv1a(k.encode()) for k in expected] == list(expected.values())
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r[0] for r in df.select(hashing.fnv1a_64("t")).collect()] == [expected["a"] - 2**64, None]


def test_hamming(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0b1111, 0), (0b1010, 0b0101)], "a long, b long")
    assert [r[0] for r in df.select(hashing.hamming(F.col("a"), F.col("b"))).collect()] == [0, 1, 4, 4]


def test_bloom():
    m, k = hashing.bloom_size(1_000_000, 0.01)
    assert 9_500_000 < m < 9_700_000 and k == 7
    bloom = hashing.Bloom(2000, 0.01)
    held, others = [f"in{i}" for i in range(2000)], [f"out{i}" for i in range(2000)]
    bloom.add(held)
    assert bloom.contains(held).all()
    assert bloom.contains(others).mean() < 0.03


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://Example.COM/Foo", "http://example.com/Foo"),
        ("http://e.com:80/", "http://e.com/"),
        ("https://e.com:443/a", "https://e.com/a"),
        ("http://e.com:8080/", "http://e.com:8080/"),
        ("http://e.com/a#b", "http://e.com/a"),
        ("http://e.com/foo/../bar/", "http://e.com/bar/"),
        ("http://e.com/?b=2&a=1", "http://e.com/?a=1&b=2"),
        ("http://www.e.com/", "http://www.e.com/"),
        ("http://e.com/%7Euser", "http://e.com/~user"),
        ("http://e.com/a%2fb", "http://e.com/a%2Fb"),
        ("http://e.com/a%2Fb/c/../d", "http://e.com/a%2Fb/d"),
        ("http://e.com/foo/%2E%2E/bar", "http://e.com/bar"),
        ("http://[::1]:8080/x", "http://[::1]:8080/x"),
        ("http://e.com/%zz", None),
        (None, None),
    ],
)
def test_canonical(url, expected):
    assert urls.canonical(url) == expected
    if expected:
        assert urls.canonical(expected) == expected


def test_redirect_target(spark):
    df = spark.createDataFrame([("http://e.com/a/b", "../c"), ("http://e.com/", None)], "u string, l string")
    assert [r[0] for r in df.select(urls.resolved("u", "l")).collect()] == ["http://e.com/c", None]


def test_language():
    assert language.detect("short") is None
    assert language.detect("this is the text that you would read in the evening with all of them") == "en"
    assert language.detect("das ist nicht der Text, den sie auf der Straße gelesen haben") == "de"
    assert language.detect("1234567890 1234567890 1234567890") is None
    assert language.detect(None) is None


PAGE = """<div class="review" data-product="Serum" data-category="serum"><div class="review-text"><p>Used for 2 weeks.</p><p>Second.</p></div></div>
<div class="review" data-product="Cream"><div class="review-text"><p>  </p></div></div>"""


def test_reviews():
    got = html.review_passages(PAGE, "http://e.com/r")
    assert [(p["text"], p["product"], p["product_category"], p["duration_of_use"]) for p in got] == [("Used for 2 weeks.", "Serum", "serum", "2 weeks"), ("Second.", "Serum", "serum", "")]


def test_articles_drop_paragraphs_without_terms():
    got = html.article_passages('<div class="entry-content"><p>One</p><p>***</p></div><div class="entry-content"><p>No</p></div>', "http://e.com")
    assert [p["text"] for p in got] == ["One"]


def test_links():
    page = '<a href="/post/1?x=1#y">a</a><a href="http://other.com/post/2">b</a><a href="/about">c</a><a>d</a><a href="/post/1">e</a>'
    assert html.links(page, "http://e.com/blog", r"^/post/") == ["http://e.com/post/1"]
    assert html.links(None, "http://e.com") == []


def test_unknown_hosts_have_no_passages():
    known = html.Extractors({"e.com": html.review_passages})
    assert len(known.passages(PAGE, "http://e.com/r")) == 2
    assert known.passages(PAGE, "http://x.com/r") == []
    known.register("x.com", html.article_passages)
    assert known.passages(PAGE, "http://x.com/r") == [] and known.passages(None, None) == []


def test_display_cuts_at_bytes_between_characters(spark):
    texts = ["short", "a" * 12, "aé" * 6, "日本語日本語", "x\U0001f600y\U0001f600", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for size in (1, 2, 3, 4, 7, 10):
        want = [None if t is None else t if len(t.encode()) <= size else t.encode()[:size].decode(errors="ignore") + "..." for t in texts]
        assert [r[0] for r in rows.select(text.shortened(F.col("t"), size)).collect()] == want, size


def test_python_gets_texts_in_bounded_batches(spark):
    """Whatever the number of rows: 40 texts of 1 MB never stand in one batch."""
    import pandas as pd

    from siltstone.session import BATCH_BYTES, spread

    @F.pandas_udf("long")
    def together(t: pd.Series) -> pd.Series:
        return pd.Series([int(t.str.len().sum())] * len(t))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        held = spark.range(40).coalesce(1).selectExpr("repeat('abcdefghi ', 100000) t")
        for bounded in (spread, text.tokenized):
            spark.conf.unset(key)
            bounded(spark.createDataFrame([("a",)], "text string"))
            assert max(r[0] for r in held.select(together("t")).collect()) <= BATCH_BYTES + 1_000_000
    finally:
        spark.conf.set(key, before)


def test_offsets_in_pieces(spark, monkeypatch):
    """Terms of several texts and pieces, with folded letters, nulls and empty texts."""
    texts = ["café latte", None, "", "\U0001d413\U0001d42b\U0001d42e 12a x\u00b2", "!?", "a b c d e"] * 3
    import pyarrow as pa

    for piece in (1, 2, 100_000):
        monkeypatch.setattr(text, "_PIECE", piece)
        got = text.tokens_with_offsets.func(pa.array(texts)).to_pylist()
        assert got == [[{"text": t, "start": a, "end": b} for t, a, b in text.runs(x or "")] for x in texts]
