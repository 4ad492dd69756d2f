"""Exact and near duplicates by address and by SimHash."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import flat_bytes, fnv1a_flat, hamming
from ..functions.text import tokenized


def first_seen(urls: DataFrame, url: str = "url", order: str = "page_id") -> DataFrame:
    """One row for each address: the first by ``order``."""
    w = Window.partitionBy(url).orderBy(order)
    return urls.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unseen(urls: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address isn't known."""
    return urls.join(known.select(url).distinct(), url, "left_anti")


def url_key(url):
    """The first 16 bytes of the address's SHA-256, in hex."""
    return F.substring(F.sha2(url, 256), 1, 32)


def admitted(found: DataFrame, known: DataFrame, most: int = 40, url: str = "url", order: str = "seq") -> DataFrame:
    """New addresses of a run, the first of each, at most ``most`` in order."""
    return unseen(first_seen(found, url, order), known, url).orderBy(order, url).limit(most)


#: SimHash takes some so many terms at once; the terms are never Python strings.
_PIECE = 100_000


@F.arrow_udf(T.LongType())
def simhash(tokens: pa.Array) -> pa.Array:
    """64-bit SimHash of a list of terms, each as often as it occurs; 0 without terms."""
    out = np.zeros(len(tokens), np.int64)
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, flat = np.cumsum(sizes), tokens.flatten()
    a = 0
    while a < len(tokens):
        first = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, first + _PIECE, side="right")))
        held = flat.slice(first, ends[b - 1] - first).dictionary_encode()
        if len(held):
            signs = np.unpackbits(fnv1a_flat(*flat_bytes(held.dictionary)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
            some = np.flatnonzero(sizes[a:b])
            votes = np.add.reduceat(signs[held.indices.to_numpy()], (ends[a:b] - sizes[a:b])[some] - first, axis=0, dtype=np.int32)
            out[a + some] = np.packbits((votes > 0).astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()
        a = b
    return pa.array(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: SimHash over terms as often as they occur, without a shuffle."""
    return tokenized(docs.select("doc_id", "text")).select("doc_id", simhash("tokens").alias("fp"))


def members(fp: DataFrame) -> DataFrame:
    """``doc_id, class_id, copies``: the least id with the same fingerprint, and how many have it.

    Fingerprint 0 (no terms, or all votes tied) makes no class: each such row is its own.
    """
    classes = fp.where("fp != 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return fp.join(classes, "fp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def near_pairs(fp: DataFrame, distance: int = 3, spare: int = 2) -> DataFrame:
    """``id_a, id_b, distance`` of the fingerprints that differ in at most so many bits.

    A fingerprint stands for all documents that have it, by its least id (see
    ``members``): pairs are of different fingerprints.  Of distance + 1 + spare
    bands of bits at least 1 + spare are equal; every choice of so many bands is
    a key, so a key has about half of the 64 bits and few fingerprints share
    one by chance.  Fingerprint 0 has no pairs.
    """
    bands = distance + 1 + spare
    cut = [64 * i // bands for i in range(bands + 1)]
    keys = fp.where("fp != 0").groupBy("fp").agg(F.min("doc_id").alias("id"))

    def masked(chosen: tuple[int, ...]) -> int:
        mask = sum(((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in chosen)
        return mask - (1 << 64) if mask >> 63 else mask

    choices = [F.col("fp").bitwiseAND(F.lit(masked(c)).cast("long")) for c in itertools.combinations(range(bands), 1 + spare)]
    banded = keys.select("id", "fp", F.posexplode(F.array(*choices)).alias("band", "value"))
    a, b = banded.select("band", "value", F.col("id").alias("ia"), F.col("fp").alias("fa")), banded.select("band", "value", F.col("id").alias("ib"), F.col("fp").alias("fb"))
    near = hamming(F.col("fa"), F.col("fb"))
    return a.join(b, ["band", "value"]).where("ia < ib").where(near <= distance).select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), near.cast("int").alias("distance")).distinct()
