"""Text chunks: greedy packing of blocks, and of lines in blocks that are too long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip

CHUNK_CHARS = 5000


def _pack(parts: Column, limit: int, separator: str) -> Column:
    """Parts joined in order while the joined text stays within the limit.

    The fold finds the chunk number of each part; texts are joined once, at the end. A part over
    the limit is a chunk of its own and closes the one before it.
    """
    gap = len(separator)
    sizes = F.transform(parts, lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))

    def step(a: Column, n: Column) -> Column:
        grown = a["size"] + gap + n
        fits = (a["at"] > 0) & (grown <= limit) & (n <= limit) & (a["size"] <= limit)
        return F.struct(
            F.when(fits, a["chunk"]).otherwise(a["chunk"] + 1).alias("chunk"),
            F.when(fits, grown).otherwise(n).alias("size"),
            F.when(fits, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["at"]))).alias("starts"),
            (a["at"] + 1).alias("at"),
        )

    starts = F.aggregate(sizes, start, step, lambda a: a["starts"])
    return let(
        parts,
        lambda p: let(
            starts,
            lambda s: F.transform(
                s,
                lambda a, i: F.array_join(F.slice(p, a + 1, F.coalesce(F.get(s, i + 1), F.size(p)) - a), separator),
            ),
        ),
    )


def split_long(block: Column, limit: int = CHUNK_CHARS) -> Column:
    """A block's non-blank lines packed; a line over the limit stays whole."""
    from ..functions.text import lines

    return let(
        lines(block),
        lambda found: F.when(F.size(found) == 0, F.array(strip(block))).otherwise(_pack(found, limit, "\n")),
    )


def split_chunks(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """The chunks of a text: all of it if short, else packed blocks between blank lines."""
    clean = strip(text)

    def blocks(t: Column) -> Column:
        found = F.filter(F.transform(F.split(t, r"\n{2,}", -1), strip), lambda x: x != "")
        # Runs of short blocks are packed; a long block is split by lines on its own.
        packed = _pack(found, limit, "\n\n")
        return F.flatten(
            F.transform(packed, lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(split_long(x, limit)))
        )

    return let(
        clean,
        lambda t: F.when(t == "", F.array().cast("array<string>"))
        .when(F.length(t) <= limit, F.array(t))
        .otherwise(blocks(t)),
    )


def chunk_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = CHUNK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, chunk_index from 1, chunk)."""
    chunks = docs.select(key, *carry, F.posexplode(split_chunks(F.col(text), limit)).alias("chunk_index", "chunk"))
    return chunks.withColumn("chunk_index", F.col("chunk_index") + 1)
