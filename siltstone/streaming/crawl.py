"""Crawl state as streams: seen addresses, host politeness, deletions, new segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import tokenized
from ..operators.index import segment_docs


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON log as a stream."""
    return spark.readStream.schema(schema).json(path)


def first_seen(stream: DataFrame, key: str = "url") -> DataFrame:
    """Each address once.  The state is exact and never expires; after a restart
    the checkpoint brings it back."""
    return stream.dropDuplicates([key])


def deletions(stream: DataFrame, key: str = "passage_id") -> DataFrame:
    """Deleted ids, each once; there is no way back."""
    return stream.select(key).dropDuplicates([key])


class Politeness(StatefulProcessor):
    """Gives each host's addresses their times: ``delay`` apart, whatever the batch."""

    def __init__(self, delay_s: float = 5.0):
        self.delay = pd.Timedelta(seconds=delay_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        free = self.next.get()[0] if self.next.exists() else None
        out = []
        for seq, ts in zip(pdf["seq"], pdf["ts"]):
            ready = ts if free is None or ts > pd.Timestamp(free) else pd.Timestamp(free)
            out.append((key[0], seq, ready))
            free = ready + self.delay
        self.next.update((pd.Timestamp(free).to_pydatetime(),))
        yield pd.DataFrame(out, columns=["host", "seq", "ready_at"])

    def close(self) -> None:
        pass


def scheduled(stream: DataFrame, delay_s: float = 5.0) -> DataFrame:
    """``host, seq, ready_at`` of a stream of (host, seq, ts); needs the RocksDB state store."""
    return stream.groupBy("host").transformWithStateInPandas(Politeness(delay_s), "host string, seq long, ready_at timestamp", "Append", "None")


def append_segments(passages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch becomes a segment, overwritten if the batch is run again.

    The tables are those of ``index.write_index``, so ``index.Index`` opens them.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = tokenized(segment_docs(batch, F.lit(number)))
        post = held.select("doc_id", F.posexplode("tokens").alias("pos", "term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        post.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/segment_id={number}")
        held.select("local_id", "doc_id", F.size("tokens").cast("long").alias("dl")).write.mode("overwrite").parquet(f"{path}/documents/segment_id={number}")
        stored = batch.sparkSession.read.parquet(f"{path}/postings/segment_id={number}")
        stored.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/dictionary/segment_id={number}")

    return passages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(entries: DataFrame, path: str) -> None:
    """Adds entries to a log of JSON files; a batch is there as a whole or not at all."""
    entries.write.mode("append").json(path)
