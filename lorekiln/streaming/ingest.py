"""Incremental runs with Structured Streaming: every file once, changed and vanished files, counters with a lifetime."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekiln.operators import merge
from lorekiln.sources import readers, snapshots


def ingest_once(spark: SparkSession, source: str, schema, write, checkpoint: str) -> None:
    """Hands each new file's rows to ``write(batch, batch_id)`` and stops when none is left; a second run starts where the first
    ended. ``write`` must be idempotent by batch_id: a batch may come again after a failure."""
    rows = spark.readStream.schema(schema).parquet(source)
    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@contextmanager
def one_run(spark: SparkSession, state: str):
    """Holds a mark below ``state`` while a run lasts, so that no second one begins; the file system creates it once. A mark left by a run that
    was killed must be removed by hand (``{state}/_running``)."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{state}/_running")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.create(mark, False).close()
    except Exception as e:  # noqa: BLE001 - py4j wraps what the file system throws
        raise RuntimeError(f"a run is going on: {state}/_running") from e
    try:
        yield
    finally:
        fs.delete(mark, False)


class Progress(StreamingQueryListener):
    """Rows and batches of the streams of a session, for those who ask how far they are; ``spark.streams.addListener(Progress())``."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = self.batches[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        k = str(event.progress.id)
        self.rows[k] = self.rows.get(k, 0) + event.progress.numInputRows
        self.batches[k] = self.batches.get(k, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def sync(files: DataFrame, registry: DataFrame, chunks: DataFrame, split, now, partial: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, chunks, changes) after a scan: rows of vanished and changed files go, those of new and changed ones come from
    ``split(files)`` -> file_path, chunk_index, text; unchanged files are neither read again nor written anew.

    ``files``: file_path, sha256, file_size, text. ``registry``: file_path, sha256, file_size, chunk_count, last_indexed, status. A file whose
    status is error counts as changed. ``partial``: only some files were scanned, so that the others aren't gone.
    """
    old = registry.select("file_path", F.when(F.col("status") != "error", F.col("sha256")).alias("sha256"))
    changes = merge.difference(old, files.select("file_path", "sha256"), "file_path", "sha256")
    if partial:
        changes = changes.where("change <> 'deleted'")
    fresh = files.join(changes.where("change in ('new', 'changed')"), "file_path", "left_semi")
    gone = changes.where("change in ('deleted', 'changed')").select("file_path")
    new_chunks = split(fresh).select("file_path", "chunk_index", "text")
    counts = new_chunks.groupBy("file_path").agg(F.count("*").cast("int").alias("chunk_count"))
    rows = fresh.join(counts, "file_path", "left").select("file_path", "sha256", "file_size", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), now.cast("timestamp").alias("last_indexed"), F.lit("indexed").alias("status"))
    kept = registry.join(changes.where("change <> 'unchanged'").select("file_path"), "file_path", "left_anti").select(*rows.columns)
    return kept.unionByName(rows), chunks.join(gone, "file_path", "left_anti").select("file_path", "chunk_index", "text").unionByName(new_chunks), changes


def sync_folder(spark: SparkSession, corpus: str, state: str, split, now, paths: list[str] | None = None) -> dict[str, int]:
    """Brings the snapshots below ``state`` (registry, chunks) up to the files below ``corpus``, or up to ``paths`` of it only; returns how many files
    were new, changed, deleted and unchanged. Chunks are named current before the registry, so that a run that dies is done
    again, never skipped."""
    files = readers.scan(spark, corpus).withColumn("file_path", F.regexp_replace("path", f"^.*?{corpus.rstrip('/')}/", ""))
    if paths is not None:
        files = files.where(F.col("file_path").isin(paths))
    have = snapshots.versions(spark, f"{state}/registry")
    registry = snapshots.read(spark, f"{state}/registry") if have else spark.createDataFrame([], "file_path string, sha256 string, file_size long, chunk_count int, last_indexed timestamp, status string")
    chunks = snapshots.read(spark, f"{state}/chunks") if have else spark.createDataFrame([], "file_path string, chunk_index int, text string")
    new_registry, new_chunks, changes = sync(files, registry, chunks, split, now, paths is not None)
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if set(counts) - {"unchanged"}:
        snapshots.write(new_chunks, f"{state}/chunks")
        snapshots.write(new_registry, f"{state}/registry")
    return counts


def stale_entities(mentions: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity_id): entities whose profiles are stale, as a file that mentions them changed or went."""
    return mentions.join(changes.where("change in ('changed', 'deleted')").select("file_path"), "file_path", "left_semi").select("entity_id").distinct()


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by window and type of a stream or a table; a stream drops events later than ``late``."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


COUNTED = "name string, frequency long, first_seen timestamp, last_seen timestamp"


def counted_candidates(sightings: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """(name, frequency, first_seen, last_seen) of a stream (name, ts): running counts whose state ends when a name wasn't seen for ``days``
    days of event time. Each batch gives the names that it saw."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, lo, hi = state.get if state.exists else (0, None, None)
        for pdf in batches:
            n += len(pdf)
            first, last = pdf.ts.min().to_pydatetime(), pdf.ts.max().to_pydatetime()
            lo, hi = first if lo is None else min(lo, first), last if hi is None else max(hi, last)
        state.update((n, lo, hi))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(hi).timestamp() * 1000) + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"name": [key[0]], "frequency": [n], "first_seen": [lo], "last_seen": [hi]})

    w = sightings.where("name is not null and ts is not null").withWatermark("ts", late)
    return w.groupBy("name").applyInPandasWithState(count, COUNTED, "frequency long, first_seen timestamp, last_seen timestamp", "update", GroupStateTimeout.EventTimeTimeout)
