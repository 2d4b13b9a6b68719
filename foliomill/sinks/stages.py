"""Staged outputs of a run: pieces by stage and source, state by key, and the best text of a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Stages, the better ones first.
STAGES = ("final", "translated", "restored")


def write_pieces(pieces: DataFrame, folder: str) -> None:
    """Pieces (stage, source_index, piece_index, text, ...) under their stage and source.

    Only the partitions that the rows touch are replaced, so finished sources stay as they are.
    """
    (
        pieces.repartition("stage", "source_index")
        .sortWithinPartitions("stage", "source_index", "piece_index")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stage", "source_index")
        .parquet(folder)
    )


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def unfinished(expected: DataFrame, folder: str, stage: str = "restored") -> DataFrame:
    """Expected (source_index, piece_index) rows that a stage does not hold yet."""
    done = read_pieces(expected.sparkSession, folder).where(F.col("stage") == stage).select("source_index", "piece_index")
    return expected.join(done.distinct(), ["source_index", "piece_index"], "left_anti")


def best_stage(pieces: DataFrame) -> DataFrame:
    """The pieces of each source's best stage that has any text."""
    rank = reduce(lambda c, x: c.when(F.col("stage") == x[1], x[0]), list(enumerate(STAGES))[1:], F.when(F.col("stage") == STAGES[0], 0))
    said = pieces.withColumn("_rank", rank.otherwise(len(STAGES))).where(F.col("text").rlike(r"\S"))
    best = said.groupBy("source_index").agg(F.min("_rank").alias("_best"))
    return said.join(best, "source_index").where(F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def first_text(*texts: Column) -> Column:
    """The first text that is not blank, else empty."""
    return F.coalesce(*[F.when(t.rlike(r"\S"), t) for t in texts], F.lit(""))


def overlay_state(updates: DataFrame, run: str = "run", key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """The state of each run: for every key, its last value."""
    return updates.groupBy(run, key).agg(F.max_by(value, order).alias(value))


def manifest_lines(records: DataFrame, run: str = "run") -> DataFrame:
    """(run, line, json): the manifest of each run as JSON lines, without texts.

    Line 0 holds the run's counts, the others its records by `source_index`; the lines are numbered by
    a scan, so that a run of any size is never in one place.
    """
    from ..operators.ordered import numbered

    own = ["source_index", "label", "status", "failure_reason"]
    lines = numbered(written(records.select(run, *own), "records"), [run], ["source_index", "label"], "_before").select(
        run, (F.col("_before") + 1).alias("line"), F.to_json(F.struct(*own)).alias("json")
    )
    failed = F.count_if(F.col("status") == "failed")
    counts = records.groupBy(run).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("sources"), failed.alias("failed"))).alias("json"))
    return counts.select(run, F.lit(0).cast("long").alias("line"), "json").unionByName(lines)


def manifest(records: DataFrame, run: str = "run") -> DataFrame:
    """(run, manifest): the counts of each run, the head of its manifest."""
    return manifest_lines(records, run).where(F.col("line") == 0).select(run, F.col("json").alias("manifest"))
