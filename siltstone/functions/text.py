"""Text functions as column expressions, with Arrow UDFs where Spark has none."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import tuned

#: Runs of letters or of decimal digits; a change of class ends a run.
RUN = r"\p{L}+|\p{Nd}+"
WHITE = r"[\t\n\x0B\f\r \u0085   -     　]"
DURATION = r"(?i)(?<![0-9A-Za-z_])[0-9]+[\t\n\f\r ]+(?:days?|weeks?|months?|years?)(?![0-9A-Za-z_])"
OFFSETS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def tokens(text: Column) -> Column:
    """Lower-cased runs, JVM-side; no compatibility folding."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(0)), F.lower)


@cache
def _kinds() -> tuple[re.Pattern, str]:
    """Python's pattern of runs, and the letters and digits that are folded in
    Python: those that compatibility normalisation changes or composes, and the
    two whose lower case Java takes from their context."""
    letters, digits, changed = [], [], []
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L" or kind == "Nd":
            (letters if kind[0] == "L" else digits).append(cp)
            jamo = 0x1100 <= cp <= 0x11FF
            if cp > 127 and (jamo or chr(cp) in "\u0130\u03a3" or unicodedata.normalize("NFKC", chr(cp)) != chr(cp)):
                changed.append(cp)

    def ranges(points: list[int], form: str) -> str:
        out, start = [], points[0]
        for a, b in zip(points, [*points[1:], -1]):
            if b != a + 1:
                out.append(form.format(start) if start == a else f"{form.format(start)}-{form.format(a)}")
                start = b
        return "".join(out)

    run = re.compile(f"[{ranges(letters, chr(92) + 'U{:08x}')}]+|[{ranges(digits, chr(92) + 'U{:08x}')}]+")
    return run, "".join(map(chr, changed))


def fold(run: str) -> str:
    """A run's term: compatibility form, then lower case, letter by letter."""
    return run.lower() if run.isascii() else "".join(c.lower()[0] for c in unicodedata.normalize("NFKC", run))


def runs(text: str) -> list[tuple[str, int, int]]:
    """Terms with their byte spans in the text as given."""
    found = _kinds()[0].finditer(text)
    if text.isascii():
        return [(m.group().lower(), *m.span()) for m in found]
    at = _byte_places(text)
    return [(fold(m.group()), at[m.start()], at[m.end()]) for m in found]


def _byte_places(text: str) -> list[int]:
    """Where each character begins in the text's UTF-8 bytes, and where they end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return [0, *np.cumsum(width).tolist()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_tokens(text: pd.Series) -> pd.Series:
    """Terms with compatibility folding; null for null."""
    out = pd.Series([None] * len(text), dtype=object)
    for i in text.notna().to_numpy().nonzero()[0]:
        out.iat[i] = [r[0] for r in runs(text.iat[i])]
    return out


#: Terms of one text or more are made into Arrow arrays so many at a time.
_PIECE = 100_000


@F.arrow_udf(OFFSETS)
def tokens_with_offsets(text: pa.Array) -> pa.Array:
    """Terms with byte spans; a null text has none."""
    names, starts, ends, sizes = [], [], [], []
    held: list[tuple[str, int, int]] = []

    def keep() -> None:
        term, start, end = zip(*held) if held else ((), (), ())
        names.append(pa.array(term, pa.string()))
        starts.append(np.array(start, dtype=np.int32))
        ends.append(np.array(end, dtype=np.int32))
        held.clear()

    for t in text:
        found = runs(t.as_py()) if t.is_valid else []
        sizes.append(len(found))
        held += found
        if len(held) >= _PIECE:
            keep()
    keep()
    spans = pa.StructArray.from_arrays([pa.concat_arrays(names), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], names=["text", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), spans)


#: Letters up to U+0131 but for three aren't folded: most texts need no further test.
_BEYOND = "[\u00aa\u00ba\u0130\u0132-\U0010ffff]"


def folds(text: Column) -> Column:
    """Whether a text has letters or digits that are folded in Python.

    A small class first; texts with anything beyond it are then translated by a
    table, a look-up a character, whatever their script.
    """
    return text.rlike(_BEYOND) & (F.translate(text, _kinds()[1], "") != text)


def tokenized(docs: DataFrame, text: str = "text", into: str = "tokens") -> DataFrame:
    """Adds the terms of each row, in one scan; null texts have none.

    Texts without letters that are folded in Python, nearly all, are tokenized
    in the JVM: Python gets a null in their place.
    """
    tuned(docs.sparkSession)
    body = F.col(text)
    return docs.withColumn(into, folded_tokens(F.when(folds(body), body))).withColumn(into, F.coalesce(into, tokens(body), F.array().cast("array<string>")))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n[\t\n\f\r ]*\n"), trimmed), lambda p: p != "")


def duration(text: Column) -> Column:
    """The first stated length of use, as written; null without one."""
    found = F.regexp_extract(text, DURATION, 0)
    return F.when(found != "", found)


def passage_id(url: Column, text: Column) -> Column:
    """Content address of a passage: hex SHA-256 over url, a zero byte and text."""
    return F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def origin(url: Column) -> Column:
    """Scheme and authority of an address; null where there is none."""
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))


def shortened(text: Column, size: int) -> Column:
    """For display: at most ``size`` bytes, with dots where cut; no character is cut in two."""
    bytes_ = F.encode(text, "utf-8")
    # a byte that goes on with a character is 10xxxxxx: at most three of them before its first
    byte = lambda at: F.conv(F.hex(F.substring(bytes_, at, 1)), 16, 10).cast("int")
    end = F.lit(0)
    for back in range(3, -1, -1):
        begins = F.coalesce((byte(size + 1 - back) < 128) | (byte(size + 1 - back) >= 192), F.lit(False)) if size >= back else F.lit(False)
        end = F.when(begins, size - back).otherwise(end)
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(F.decode(F.substring(bytes_, F.lit(1), end), "utf-8"), F.lit("...")))
