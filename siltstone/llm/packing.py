"""Conflict-constrained best-fit packing of documents into sequences.

A sequence (bin) holds ``capacity`` tokens.  Documents of at least that length
are cut into full sequences; their rests and all shorter documents are packed,
longest first, each into the tightest bin that fits and has no conflict: no
other document of the same source and none of the same duplicate cluster.
Bins are ordered by residual and carry bitmaps of their sources and clusters.
The successor search starts at the smallest residual that fits and goes on to
larger ones until a compatible bin is found; per residual and source it is
known whether a bin without that source exists, so the search skips residuals
without one.  If none is found a bin is opened.

Scale: rows are hashed into groups of about ``group_rows`` rows, packed apart;
only ids, lengths and keys are shuffled, never texts.  A group costs one
partly filled tail.  In the pipeline the groups are stretches of the files that
the stage before wrote (of the mix: its shards), and the bins of a group are
numbered by the first place there of what they hold, so that sequences read in
order keep the mix.  ``sequences``
joins the texts to their bins.

Defined results
---------------
* A token is a maximal run of characters that aren't white space.
* A null or empty text has no tokens and isn't packed.
* Order: length (longest first), then id (nulls first), then cluster, source
  and part.  Repeated rows are packed each on their own.
* A null source conflicts with other null sources; clusters are equal texts,
  unless a column names them (a null cluster never conflicts).
* Among bins of the tightest compatible residual the oldest is taken.
* Result columns: ``doc_id, part, start_token, n_tokens, pack_group, bin,
  position``.  Other columns don't pass.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .frames import by_place, column, saved, scratch, tuned
from .textarrays import SPACE, buffers, slices

RESULT = "doc_id long, part int, start_token long, n_tokens int, pack_group int, bin int, position int"


def best_fit(lengths, sources, clusters, capacity: int) -> list[int]:
    """The bin of each item, taken in the given order.

    ``sources`` and ``clusters`` are small integers; -1 never conflicts.
    """
    n_sources = max([s for s in sources], default=-1) + 1
    free = np.zeros((n_sources + 1, capacity + 1), dtype=np.int32)  # bins without that source, by residual
    every = n_sources  # bins of any sources
    held: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # residual -> source bitmap -> bins
    mask_of: list[int] = []
    clusters_of: list[int] = []
    absent: dict[int, np.ndarray] = {}
    out = []

    def rows_without(mask: int) -> np.ndarray:
        if mask not in absent:
            if len(absent) > 4096:
                absent.clear()
            absent[mask] = np.array([s for s in range(n_sources) if not mask >> s & 1] + [every])
        return absent[mask]

    for length, source, cluster in zip(lengths, sources, clusters):
        bit = 1 << source if source >= 0 else 0
        kin = 1 << cluster if cluster >= 0 else 0
        row = free[source if source >= 0 else every]
        found, at = -1, length
        while found < 0 and at <= capacity:
            step = int((row[at:] > 0).argmax())
            at += step
            if row[at] <= 0:
                break
            best = None
            for mask, bins in held[at].items():
                if not mask & bit and bins and (best is None or bins[0] < best[0]):
                    if not clusters_of[bins[0]] & kin:
                        best = (bins[0], mask)
                    elif kin:
                        ok = min((b for b in bins if not clusters_of[b] & kin), default=None)
                        if ok is not None and (best is None or ok < best[0]):
                            best = (ok, mask)
            if best is None:
                at += 1
                continue
            found, mask = best
            bins = held[at][mask]
            if bins[0] == found:
                heapq.heappop(bins)
            else:
                bins.remove(found)
                heapq.heapify(bins)
            if not bins:
                del held[at][mask]
            free[rows_without(mask), at] -= 1
        if found < 0:
            found, at = len(mask_of), capacity
            mask_of.append(0)
            clusters_of.append(0)
        mask_of[found] |= bit
        clusters_of[found] |= kin
        left = at - length
        if left > 0:
            heapq.heappush(held[left].setdefault(mask_of[found], []), found)
            free[rows_without(mask_of[found]), left] += 1
        out.append(found)
    return out


def _shared(codes: np.ndarray) -> list[int]:
    """Codes that occur more than once, numbered from 0; -1 for all others."""
    often = np.bincount(codes[codes >= 0], minlength=1) > 1
    return np.where(codes >= 0, np.where(often, np.cumsum(often) - 1, -1)[codes], -1).tolist()


def pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one group: columns ``doc_id, source, cluster, n`` to the result's.

    With a column ``at``, the place in the mix, bins are numbered by their least.
    """
    pdf = pdf.sort_values(["n", "doc_id", "cluster", "source"], ascending=[False, True, True, True], na_position="first", kind="stable").reset_index(drop=True)
    n = pdf["n"].to_numpy(dtype=np.int64)
    whole = n // capacity
    rest = n % capacity
    full = np.repeat(np.arange(len(pdf)), whole)
    part = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    tails = np.flatnonzero(rest)
    tails = tails[np.argsort(-rest[tails], kind="stable")]
    source = _shared(pd.factorize(pdf["source"], use_na_sentinel=False)[0][tails])
    cluster = _shared(pd.factorize(pdf["cluster"])[0][tails])
    bins = np.array(best_fit(rest[tails].tolist(), source, cluster, capacity), dtype=np.int64)
    opened = int(bins.max(initial=-1)) + 1
    row = np.concatenate([full, tails])
    out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "part": np.concatenate([part, whole[tails]]), "start_token": np.concatenate([part, whole[tails]]) * capacity, "n_tokens": np.concatenate([np.full(len(full), capacity), rest[tails]]), "bin": np.concatenate([opened + np.arange(len(full)), bins])})
    for name in ("tid", "at"):
        if name in pdf:
            out[name] = pdf[name].to_numpy()[row]
    if "at" in out and len(out):
        first = out.groupby("bin")["at"].transform("min")
        out["bin"] = pd.MultiIndex.from_arrays([first, out["bin"]]).factorize(sort=True)[0]
    out["position"] = out.groupby("bin").cumcount()
    return out


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", cluster: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, cluster, tid, n`` of every row: texts' hashes and token counts, no texts."""
    body = column(docs, text).cast("string")
    kin = column(docs, cluster).cast("string") if cluster else F.xxhash64(body).cast("string")
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, source).cast("string").alias("source"), kin.alias("cluster"), F.xxhash64(body).alias("tid"), *[F.col(c) for c in more], body.alias("text"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[:-1])

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            n = np.zeros(len(batch), np.int64)
            for i, j in slices(offsets):
                part = ~SPACE[data[offsets[i] : offsets[j]]]
                at = offsets[i:j] - offsets[i]
                begins = part.copy()
                begins[1:] &= ~part[:-1]
                some = at < len(part)
                begins[at[some]] = part[at[some]]
                sums = np.concatenate([[0], np.cumsum(begins)])
                n[i:j] = np.diff(sums[offsets[i : j + 1] - offsets[i]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*batch.schema.names[:-1], "n"])

    return rows.mapInArrow(run, f"{kinds}, n long")


def _pack(rows: DataFrame, capacity: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Packs counted rows by their column ``pack_group``."""
    names = [x.split()[0] for x in RESULT.split(", ")] + list(keep)

    def run(key, pdf):
        out = pack_group(pdf, capacity)
        out["pack_group"] = key[0]
        return out[names]

    return rows.where("n > 0").groupBy("pack_group").applyInPandas(run, RESULT + "".join(f", {c} long" for c in keep))


def _grouped(rows: DataFrame, n: int, group_rows: int) -> DataFrame:
    groups = max(1, math.ceil(n / group_rows))
    return rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)).cast("int"))


def pack(docs: DataFrame, capacity: int = 2048, group_rows: int = 20_000, cluster: str | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """The place of every document, or part of one, in packed sequences."""
    tuned(docs.sparkSession)
    return _pack(_grouped(counted(docs, text, source=source, cluster=cluster), docs.count(), group_rows), capacity)


def sequences(docs: DataFrame, capacity: int = 2048, group_rows: int = 20_000, cluster: str | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """``pack_group, bin, position, doc_id, part, piece``: the packed texts themselves.

    Texts are found by id and hash, so repeated ids get their own; rows that
    are equal in both stand for each other.
    """
    tuned(docs.sparkSession)
    placed = _pack(_grouped(counted(docs, text, source=source, cluster=cluster), docs.count(), group_rows), capacity, ("tid",))
    body = column(docs, text).cast("string")
    texts = docs.select(column(docs, "doc_id").cast("long").alias("__id"), F.xxhash64(body).alias("__tid"), body.alias("text")).dropDuplicates(["__id", "__tid"])
    met = placed.join(texts, placed["doc_id"].eqNullSafe(texts["__id"]) & (placed["tid"] == texts["__tid"]))

    runs = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    piece = F.array_join(F.slice(runs, F.col("start_token").cast("int") + 1, F.col("n_tokens")), " ")
    return met.select("pack_group", "bin", "position", "doc_id", "part", piece.alias("piece"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(spread(tuned(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")))


def _stored(docs: DataFrame) -> DataFrame:
    """The rows with two more columns: their file and their place in it.

    Rows that weren't read from files have their partition instead.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        meta = docs.metadataColumn("_metadata")
        return docs.select("*", meta["file_path"].alias("mix_file"), meta["row_index"].alias("mix_row"))
    return docs.select("*", F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("mix_file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("mix_row"))


def stage(spark, docs: DataFrame, sf_dir: str, capacity: int = 2048, group_rows: int = 16_384) -> DataFrame:
    """Pipeline stage: the packed sequences, in the order in which the rows were stored.

    Nothing of the mix is made again: its shards are the files, its order is theirs.
    """
    tuned(spark)
    named, (text, doc_id, source) = by_place(_stored(docs), "text", "doc_id", "source")
    n = len(docs.columns)
    keys = named.select("*", F.col(f"c{n}").alias("mix_file"), F.col(f"c{n + 1}").alias("mix_row"))
    with scratch(spark):
        rows = saved(counted(keys, text, doc_id, source, more=("mix_file", "mix_row")))
        # one row a file: their groups are numbered on
        files = rows.groupBy("mix_file").agg(F.max("mix_row").alias("last")).orderBy("mix_file").collect()
        firsts = np.cumsum([0, *(r["last"] // group_rows + 1 for r in files)]).tolist()
        table = spark.createDataFrame([(r["mix_file"], k) for r, k in zip(files, firsts)], "mix_file string, first int")
        at = rows.join(F.broadcast(table), "mix_file").withColumn("at", F.col("mix_row")).withColumn("pack_group", (F.col("first") + F.floor(F.col("mix_row") / group_rows)).cast("int"))
        return saved(_pack(at, capacity), keep=True)
