"""Regular-expression matches with their places, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Prefix sums run in blocks of so many elements: short lists take one block.
BLOCK = 256


def running_total(values: Column) -> Column:
    """The sums of all earlier elements, for each element of an array of ints.

    Blocks keep the work near n times the block length, so that a text with very many matches does
    not cost the square of their number.
    """

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def inside(v: Column, base: Column) -> Column:
        return F.transform(
            v,
            lambda _, i: F.get(base, F.floor(i / BLOCK).cast("int"))
            + total(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
        )

    def sums(v: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")),
            lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))),
        )
        return let(
            let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))),
            lambda base: inside(v, base),
        )

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, sums))


def find(text: Column, pattern: str, before: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value, before).

    Places are code points from 0, the end exclusive; `before` is what the given function makes of
    the whole text between the previous match and this one. The pattern must not match the empty
    text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        ahead = let(
            gaps,
            lambda g: F.zip_with(
                m,
                F.slice(g, F.lit(1), F.size(m)),
                lambda v, b: F.struct(
                    v.alias("value"),
                    F.length(v).alias("n"),
                    F.length(b).alias("gap"),
                    (before(b) if before else F.lit(None).cast("string")).alias("before"),
                ),
            ),
        )
        return let(
            ahead,
            lambda p: F.zip_with(
                p,
                running_total(F.transform(p, lambda x: x["n"] + x["gap"])),
                lambda x, at: F.struct(
                    (at + x["gap"]).alias("start"),
                    (at + x["gap"] + x["n"]).alias("end"),
                    x["value"].alias("value"),
                    x["before"].alias("before"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def apart(found: Column, others: Column) -> Column:
    """The spans of one ascending list that overlap none of another; both are without overlaps.

    Merged by start, the place of the k-th span in the merged order tells how many of the others
    start before it, so only the last of those and the first after it need a look.
    """

    def keyed(x: Column, rank: int) -> Column:
        return F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank")))

    def of(o: Column) -> Column:
        order = F.sort_array(F.concat(keyed(o, 0), keyed(found, 1)))
        places = F.filter(F.transform(order, lambda x, i: F.when(x["rank"] == 1, i)), lambda i: i.isNotNull())
        # A span of equal start stands before: it is the last one that starts at or before this one.
        free = F.zip_with(
            found,
            F.transform(places, lambda i, k: i - k),
            lambda s, n: F.struct(
                s.alias("span"),
                (
                    F.coalesce(F.get(o, n - 1)["end"] <= s["start"], F.lit(True))
                    & F.coalesce(F.get(o, n)["start"] >= s["end"], F.lit(True))
                ).alias("free"),
            ),
        )
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["span"])

    return F.when((F.size(others) == 0) | (F.size(found) == 0), found).otherwise(let(others, of))


def tagged(found: Column, kind: str, rank: int, by_kind: bool) -> Column:
    """Spans of one kind, in structs whose natural order is the order of the report."""

    def one(x: Column) -> Column:
        keys = [x["start"].alias("start"), F.lit(rank).alias("rank")]
        return F.struct(*(keys[::-1] if by_kind else keys), x["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.transform(found, one)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in natural order."""
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )
