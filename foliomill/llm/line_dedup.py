"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded and normalised once; their digests, with the row and place they come from, are
written. Distinct documents are counted for each digest, and lines of frequent digests dropped
everywhere but in the largest doc_id that holds them. What is left is put together again by line
position.

Only digests and positions are shuffled by line; a very common line meets a partial aggregate
before the shuffle. The frequent lines are written, so that the planner knows their size: it sends
them to all executors only below its broadcast limit, and else joins by a shuffle that adaptive
execution can split. The places that rows lose are written as well and go to every executor while
they take at most 16 MB; else the texts are shuffled to meet them.

Rows are known by a digest of doc_id and text, so that rows that share a doc_id, or have none, are
each cut by their own lines.

Defined cases: a null or empty text is one empty line; rows that share a doc_id count as one
document, and so do all rows without one, which is never the largest unless alone; each row is cut
on its own; repeated rows are cut alike; an empty table gives an empty result; `dedup_lines`
carries other columns along, whatever their names, but for `n_lines` and `n_dropped`, which it
replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACES, ascii_lower, digest, forget, fresh, let, named, row_key, sent, whole, written

MIN_CHARS = 20
MIN_DOCS = 3


def _lines() -> F.Column:
    return F.split(whole(), "\n")


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, doc, pos, key): the lines of at least so many characters; positions count from 0."""
    # Stripped before they are exploded, so that each line is stripped once; lowering keeps its length.
    stripped = F.transform(_lines(), lambda x: F.btrim(x, F.lit(SPACES)))
    return (
        docs.select(
            row_key("text", "doc_id").alias("row"),
            F.col("doc_id").alias("doc"),
            F.posexplode(stripped).alias("pos", "line"),
        )
        .where(F.length("line") >= min_chars)
        .select("row", "doc", "pos", digest(ascii_lower(F.col("line"))).alias("key"))
    )


def lost_positions(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(row, positions): where each row holds lines that it loses, as a written table."""
    keyed = written(keyed_lines(docs, min_chars), "lines")
    frequent = written(
        keyed.select("key", "doc")
        .distinct()
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("holders"), F.max("doc").alias("keeper"))
        .where(F.col("holders") >= min_docs)
        .select("key", "keeper"),
        "frequent",
    )
    lost = written(
        keyed.join(frequent, "key")
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("row")
        .agg(F.collect_set("pos").alias("positions")),
        "lost",
    )
    forget(keyed, frequent)
    return lost


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """The documents with `text` cut, and `n_lines` (before) and `n_dropped` added."""
    made = ("n_lines", "n_dropped")
    rest = [c for c in docs.columns if c.lower() not in made]
    docs = docs.select(*map(named, rest))
    row, lost_row, gone = fresh(docs, "row", "lost_row", "gone")
    lost = sent(lost_positions(docs, min_chars, min_docs), "positions").toDF(lost_row, gone)
    joined = docs.withColumn(row, row_key("text", "doc_id")).join(lost, F.col(row) == F.col(lost_row), "left")
    kept = let(
        _lines(),
        lambda x: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)),
                lambda i: F.get(x, i),
            ),
            "\n",
        ),
    )
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c.lower() == "text" else named(c) for c in rest],
        F.size(_lines()).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts and the digest of what each document keeps."""
    return dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(whole(), 256).alias("kept_sha256"),
    )
