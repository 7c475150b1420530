"""Streams: request counters, ordered ingest of fragments, and sync-aligned cuts with keyed state.

A stream is read to its end (availableNow) and resumed from its checkpoint when more files come.
State is one row a track.  There is no watermark: a fragment that starts before the last one ended
is an error row, and a gap is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

TRACK = ["asset_id", "track_id"]


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set one of the warehouse, but only for a master that runs in this one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not at and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return at or f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"


def drain(stream: DataFrame, folder: str) -> None:
    """Appends what the stream has now to folder/out, from where folder/state left off."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def in_parts(parts: list[DataFrame], through: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that come out of a stream which gets the parts one after the other, and stops and resumes between them."""
    spark = parts[0].sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        out = through(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        drain(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def counted(stream: DataFrame, keys: list[str], folder: str) -> None:
    """Counts a key, as of the last batch, in folder/out."""

    def put(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    totals = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def ordered_fragments(stream: DataFrame) -> DataFrame:
    """(track, fragment, start, end, late) of fragments (track, fragment, start or null, duration).

    Without a start a fragment follows the one before.  A late one changes no state.
    """

    def ingest(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("fragment")
        due = state.get[0] if state.exists else 0
        out = []
        for f, start, duration in zip(rows["fragment"], rows["start"], rows["duration"], strict=True):
            begin = due if pd.isna(start) else int(start)
            late = begin < due
            out.append((*key, int(f), begin, begin + int(duration), late))
            due = due if late else begin + int(duration)
        state.update((due,))
        yield pd.DataFrame(out, columns=[*TRACK, "fragment", "start", "end", "late"])

    return stream.groupBy(*TRACK).applyInPandasWithState(ingest, "asset_id long, track_id long, fragment long, start long, end long, late boolean", "due long", "append", GroupStateTimeout.NoTimeout)


def stream_cuts(stream: DataFrame, target_ms: int) -> DataFrame:
    """(track, segment_index, first_sample, decode_time): each cut is the first sync sample at or after the last one plus the target.

    The state is the time from which on the next sync sample cuts, and the number of cuts.
    """

    def cut(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("sample_index")
        due, n = state.get if state.exists else (None, 0)
        out = []
        for i, t, sync, scale in zip(rows["sample_index"], rows["decode_time"], rows["is_sync"], rows["timescale"], strict=True):
            if due is None or (sync and t >= due):
                out.append((*key, n, int(i), int(t)))
                due, n = int(t) + target_ms * int(scale) // 1000, n + 1
        if n:
            state.update((due, n))
        yield pd.DataFrame(out, columns=[*TRACK, "segment_index", "first_sample", "decode_time"])

    return stream.groupBy(*TRACK).applyInPandasWithState(cut, "asset_id long, track_id long, segment_index long, first_sample long, decode_time long", "due long, n long", "append", GroupStateTimeout.NoTimeout)
