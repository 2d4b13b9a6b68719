"""A run: restore sources, cut and observe them, roll up their structure.

Every step is a projection or an aggregate that combines before its shuffle; a run over any number
of documents is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure as X
from ..functions.responses import failure_reason, looks_damaged, parse_replies, status_of
from ..functions.text import is_blank, strip
from ..operators import assemble, rollup
from ..operators.chunking import chunk_rows
from . import providers


def restore(
    docs: DataFrame, key: str = "doc_id", provider: str = "offline", instruction: str = "", retries: int = 1, carry: tuple[str, ...] = ()
) -> DataFrame:
    """A row for each chunk with its restored text, status, reason and usage, and carried columns."""
    chunks = chunk_rows(docs, key, carry=carry).withColumn("prompt", F.concat(F.lit("SOURCE CHUNK\n"), F.col("chunk")))
    asked = providers.ask(chunks, provider, instruction=instruction, retries=retries)
    failed = F.col("error").isNotNull()
    reason = failure_reason(F.coalesce("reply", F.lit("")), F.col("error"), F.coalesce("usage.truncated", F.lit(False)), F.lit(False))
    parsed = parse_replies(asked.withColumn("reply", F.coalesce("reply", F.lit(""))), "reply", "chunk")
    return (
        parsed.withColumn("failure_reason", F.when(failed, reason).otherwise(F.col("failure_reason")))
        .withColumn("status", F.when(failed, status_of(reason)).otherwise(F.col("status")))
        .drop("prompt", "reply", "error")
    )


def observe_chunks(chunks: DataFrame, kind: Column) -> DataFrame:
    pages = chunks.withColumn("document_type", kind)
    return X.observe(pages, "restored_text", "document_type", "chunk_index")


def documents(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The restored documents: chunks joined in order by page breaks."""
    return assemble.concat_pages(chunks, [key], "chunk_index", "restored_text")


def structure(docs: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    """Document structure and layout profile of each key over its restored chunks."""
    observed = observe_chunks(restore(docs, carry=tuple(k for k in keys if k != "doc_id")), kind)
    profiled = rollup.with_profile(observed)
    return rollup.document_structure(profiled, keys, "chunk_index").join(rollup.layout_profile(profiled, keys), keys)


def resume(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without a finished record."""
    return docs.join(done.where(F.col("status").isin("restored", "blank")).select(key).distinct(), key, "left_anti")


def suspicious(chunks: DataFrame, run_key: str, mode: str = "balanced") -> DataFrame:
    """Chunks with `reviewed`: damaged ones in order until the run's budget is spent."""
    from ..functions.normalize import budget

    marked = chunks.withColumn("damaged", looks_damaged(F.col("restored_text"), F.lit(mode)))
    return assemble.review_budget(marked, run_key, "chunk_index", "damaged", budget(F.lit(mode), "reviews"))


def failed_inputs(records: DataFrame) -> DataFrame:
    """Records that failed, or that have a reason and were not restored."""
    reason = F.coalesce(F.col("failure_reason"), F.lit("")) != ""
    return records.where((F.col("status") == "failed") | (reason & (F.col("status") != "restored")))


def blank_share(chunks: DataFrame, keys: list[str]) -> DataFrame:
    blank = is_blank(F.col("restored_text")) | (strip(F.col("restored_text")) == "")
    return chunks.groupBy(*keys).agg(F.count_if(blank).alias("blank"), F.count(F.lit(1)).alias("chunks"))
