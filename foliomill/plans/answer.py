"""Answers over sources: choose, build the prompt, ask, keep the turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval
from . import providers

SOURCE_CHARS = 1200
TURNS, NOTES = 4, 8


def prompt(sources: DataFrame, question: str, turns: list[tuple[str, str]] = (), notes: list[str] = ()) -> DataFrame:
    """One row with the prompt: chosen sources cut to size, the last turns, the last notes, the question."""
    part = F.concat(F.lit("["), F.col("source_id"), F.lit("] "), F.col("label"), F.lit("\n"), F.substring("text", 1, SOURCE_CHARS))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "source_id", part.alias("part")))), lambda x: x["part"])
    history = "\n".join(f"Question: {q}\nAnswer: {a}" for q, a in list(turns)[-TURNS:])
    remarks = "\n".join(f"Note: {n}" for n in list(notes)[-NOTES:])
    head = "Answer from the sources below and cite them by their ids. Say so if they do not hold the answer.\n"
    return sources.agg(
        F.concat(F.lit(head), F.array_join(listed, "\n\n"), F.lit(f"\n{history}\n{remarks}\nQuestion: "), F.lit(question)).alias("prompt")
    )


def ask(sources: DataFrame, question: str, provider: str = "offline", pinned: list[str] = (), turns: list[tuple[str, str]] = (), notes: list[str] = ()) -> DataFrame:
    """One row: prompt, reply, error, usage."""
    if pinned:
        chosen = retrieval.pinned(sources, list(pinned)).withColumn("score", F.lit(0))
    else:
        chosen = retrieval.select_relevant(sources, question)
    return providers.ask(prompt(chosen, question, turns, notes), provider)


def sources_of(docs: DataFrame) -> DataFrame:
    """Documents as sources S<doc_id>, one page each."""
    return docs.select(
        F.col("doc_id").alias("source_no"),
        F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("source_id"),
        F.concat_ws("/", "source", "lang").alias("label"),
        "text",
        F.lit("page-record").alias("kind"),
        F.lit(0.5).alias("confidence"),
        F.col("doc_id").cast("int").alias("page_number"),
    )
