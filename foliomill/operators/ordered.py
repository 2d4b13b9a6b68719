"""What follows an order through a whole run: running state, numbering and assembly, without one task for a run.

Rows are dealt by ranges of (run, order), sorted, and written with their place. A range holds a stretch
of one run, or several short runs whole; a run of any size covers as many ranges as it needs. What a
range does to a state is an associative summary, one row for each run and range; an exclusive scan over
these few rows gives the state before each range, and a pass inside the range the rest. Ranges are
written before they are counted, so that no lost executor changes them between the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sinks.shared import forget, sent, written

#: Bytes of assembled text in a part, but for the text that fills it.
PART_BYTES = 1 << 20

PLACE, RANGE = "_at", "_range"


def ranged(rows: DataFrame, keys: list[str], name: str = "ranged") -> DataFrame:
    """The rows with `_at`, ascending with the keys, and `_range`; written.

    Finding the ranges reads the rows once more, so what they cost should be written before.
    """
    dealt = rows.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    placed = written(dealt.withColumn(PLACE, F.monotonically_increasing_id()), name)
    out = placed.withColumn(RANGE, F.shiftright(PLACE, 33))
    out.written_to = placed.written_to
    return out


def scanned(placed: DataFrame, run: list[str], sums: dict[str, Column], firsts: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """The rows with the state before or through their range, one column for each name.

    A sum has the total of the ranges before. A last is the greatest struct of the ranges before, a
    first the least one of the ranges up to the row's own, so that a row sees it if its place comes
    later. The values of firsts and lasts are structs whose first field is the place.
    """
    states = placed.groupBy(*run, RANGE).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.min(c).alias(n) for n, c in firsts.items()],
        *[F.max(c).alias(n) for n, c in lasts.items()],
    )
    # One row for each run and range: few, whatever the rows.
    states = written(states, "states")
    through = W.partitionBy(*run).orderBy(RANGE)
    before = through.rowsBetween(W.unboundedPreceding, -1)
    scan = written(
        states.select(
            *[F.col(k).alias(f"_state_{k}") for k in [*run, RANGE]],
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
            *[F.min(n).over(through.rowsBetween(W.unboundedPreceding, 0)).alias(n) for n in firsts],
            *[F.max(n).over(before).alias(n) for n in lasts],
        ),
        "scan",
    )
    forget(states)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_state_{k}")) for k in [*run, RANGE]])
    return placed.join(sent(scan), same).drop(*[f"_state_{k}" for k in [*run, RANGE]])


def inside(run: list[str]) -> W:
    """The rows of a run before a row, in its own range."""
    return W.partitionBy(*run, RANGE).orderBy(PLACE).rowsBetween(W.unboundedPreceding, -1)


def numbered(rows: DataFrame, run: list[str], order: list[str], number: str = "number", weight: Column | None = None) -> DataFrame:
    """The rows with the sum of the weights (rows, if none) before them in their run, from 0."""
    placed = ranged(rows, [*run, *order])
    own = F.lit(1).cast("long") if weight is None else weight.cast("long")
    counted = scanned(placed, run, {"_of_ranges": own}, {}, {})
    here = F.coalesce(F.sum(own).over(inside(run)), F.lit(0))
    return counted.withColumn(number, (F.col("_of_ranges") + here).cast("long")).drop("_of_ranges", PLACE, RANGE)


def parts(rows: DataFrame, keys: list[str], order: list[str], text: str, gap: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(keys, part, offset, length, rows, text): the texts of each key with `gap` between them, in parts.

    `offset` and `length` are in bytes of the joined text. The parts of a key, one after another, are
    that text; each begins with a row's text, or the gap before it, and holds the rows that begin in
    the same stretch of `part_bytes`. A key's text is never in one place: its sizes are scanned, and
    each text goes straight to its part.
    """
    told = written(
        rows.select(*keys, *order, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_id", F.monotonically_increasing_id()),
        "texts",
    )
    size = F.octet_length("_text") + len(gap.encode("utf-8"))
    sizes = told.select(*keys, *order, "_id", size.cast("long").alias("_size"))
    # Offsets count a gap before every text; the first one of a key has none.
    spots = numbered(sizes, keys, [*order, "_id"], "_offset", F.col("_size")).select(
        F.col("_id").alias("_spot"), F.col("_offset"), F.floor(F.col("_offset") / part_bytes).cast("long").alias("part")
    )
    placed = told.join(written(spots, "spots"), F.col("_id") == F.col("_spot"))
    first = F.col("_offset") == 0
    piece = F.when(first, F.col("_text")).otherwise(F.concat(F.lit(gap), F.col("_text")))
    grouped = placed.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("_offset").alias("offset"),
        F.array_sort(F.collect_list(F.struct("_offset", piece.alias("t")))).alias("_pieces"),
    )
    joined = F.array_join(F.transform("_pieces", lambda p: p["t"]), "")
    skipped = F.when(F.col("offset") == 0, F.lit(0)).otherwise(F.lit(len(gap.encode("utf-8"))))
    return grouped.select(
        *keys, "part", (F.col("offset") - skipped).alias("offset"), F.octet_length(joined).cast("long").alias("length"), "rows", joined.alias("text")
    )


def digests(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, chars, digest): size and MD5 of each key's whole text, read part by part in order.

    A digest is serial by nature, so a key's parts pass through one task, one part at a time.
    """
    schema = StructType(
        [StructField(k, pieces.schema[k].dataType) for k in keys]
        + [StructField("rows", LongType()), StructField("chars", LongType()), StructField("digest", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chars, md5 = None, 0, 0, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, held, chars, md5.hexdigest())))], schema=kinds)

        for batch in batches:
            own = batch.schema
            kinds = pa.schema([*[own.field(k) for k in keys], ("rows", pa.int64()), ("chars", pa.int64()), ("digest", pa.string())])
            for row in range(len(batch)):
                now = tuple(batch.column(k)[row].as_py() for k in keys)
                if md5 is None or now != key:
                    if md5 is not None:
                        yield told()
                    key, held, chars, md5 = now, 0, 0, hashlib.md5()
                text = batch.column("text")[row].as_py()
                held += batch.column("rows")[row].as_py()
                chars += len(text)
                md5.update(text.encode("utf-8"))
        if md5 is not None:
            yield told()

    ordered = pieces.select(*keys, "part", "rows", "text").repartition(*keys).sortWithinPartitions(*keys, "part")
    return ordered.mapInArrow(run, schema)
