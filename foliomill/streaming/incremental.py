"""Structured Streaming forms of a run: new files only, committed per batch, with running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.structure import heading_style, layout_notes, page_marker_style
from ..functions.text import is_blank, lines, scripts, strip
from ..plans.run import restore


def restore_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id bigint, text string") -> StreamingQuery:
    """Restore the Parquet files of a folder that are not in the checkpoint, then stop.

    The file source and the sink both commit by batch, so a restarted run goes on where it ended.
    """
    docs = spark.readStream.schema(schema).parquet(source)
    return (
        restore(docs)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


STATE = "observed_pages bigint, heading_style string, page_marker_style string, notes string, scripts string"
OUT = "run string, observed_pages bigint, heading_style string, page_marker_style string, notes array<string>, scripts array<string>"


def running_state(chunks: DataFrame) -> DataFrame:
    """The consistency state of each run (run, seq, text) as its chunks arrive."""
    found = lines(F.col("text"))
    live = ~is_blank(F.col("text")) & (strip(F.col("text")) != "")
    marked = chunks.where(live).select(
        "run", "seq", heading_style(found).alias("heading"), page_marker_style(found).alias("marker"),
        layout_notes(found).alias("notes"), scripts(F.col("text")).alias("scripts"),
    )

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, heading, marker, notes, names = state.get if state.exists else (0, "", "", "", "")
        known, written = [x for x in notes.split("\n") if x], [x for x in names.split("\n") if x]
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for h, m, ns, ss in zip(rows["heading"], rows["marker"], rows["notes"], rows["scripts"]):
            seen, heading, marker = seen + 1, heading or h, marker or m
            known += [x for x in ns if x not in known]
            written += [x for x in ss if x not in written]
        known, written = known[:6], written[:8]
        state.update((seen, heading, marker, "\n".join(known), "\n".join(written)))
        yield pd.DataFrame([(key[0], seen, heading, marker, known, written)], columns=[c.split()[0] for c in OUT.split(", ")])

    return marked.groupBy("run").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Units by outcome and time window; late ones are dropped behind the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("units"), F.sum("value").alias("tokens"))
