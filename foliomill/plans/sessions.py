"""Chat sessions: one JSON file each, with its last turns and notes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed values.
TURNS, NOTES, VERSION = 24, 24, 2
SCHEMA = "version int, turns array<struct<question:string,answer:string>>, notes array<string>, metadata map<string,string>"


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def save(spark: SparkSession, path: str, turns: list[tuple[str, str]], notes: list[str] | None = None, metadata: dict[str, str] | None = None) -> None:
    """Write a session's last turns and first notes, in place of what the file held."""
    held: dict = {"version": VERSION, "turns": [{"question": q, "answer": a} for q, a in turns[-TURNS:]]}
    if notes is not None:
        held["notes"] = [n.strip() for n in notes if n.strip()][:NOTES]
    if metadata is not None:
        held["metadata"] = metadata
    system, place = _file(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray((json.dumps(held, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was a session file to delete."""
    system, place = _file(spark, path)
    return bool(system.exists(place) and system.getFileStatus(place).isFile() and system.delete(place, False))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, turns, notes, metadata) of a folder's sessions; unreadable files have none of the last three.

    Turns need a question and an answer; at most the last of them and the first notes are kept.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    read = files.select("path", F.col("modificationTime").alias("modified"), F.from_json(F.col("content").cast("string"), SCHEMA).alias("s"))
    turns = F.filter("s.turns", lambda t: (strip(t["question"]) != "") & (strip(t["answer"]) != ""))
    trimmed = F.transform(turns, lambda t: F.struct(strip(t["question"]).alias("question"), strip(t["answer"]).alias("answer")))
    notes = F.filter(F.transform("s.notes", strip), lambda n: n != "")
    kept = F.slice(trimmed, F.greatest(F.size(trimmed) - TURNS + 1, F.lit(1)), F.lit(TURNS))
    return read.select("path", "modified", kept.alias("turns"), F.slice(notes, 1, NOTES).alias("notes"), F.col("s.metadata").alias("metadata"))


def latest_first(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions, the one changed last first; ties by path."""
    return sessions(spark, folder).orderBy(F.desc("modified"), "path")


def load(spark: SparkSession, path: str) -> tuple[list[tuple[str, str]], list[str], dict[str, str]]:
    """(turns, notes, metadata) of one session; all empty if it is missing or unreadable."""
    system, place = _file(spark, path)
    if not system.exists(place):
        return [], [], {}
    row = sessions(spark, path).first()
    if row is None:
        return [], [], {}
    return [(t["question"], t["answer"]) for t in row["turns"] or []], list(row["notes"] or []), dict(row["metadata"] or {})
