"""Benchmark decontamination: which document words lie inside item-sized windows of a benchmark.

A window is ten consecutive words of an item, or all words of a shorter item. The join is a
prefix-filtered set join for full containment. A window's tokens are its shingles of `SHINGLE`
words (a window of fewer words is one shingle), each known by a 64-bit hash and ordered by rarity,
that is by how often the shingle occurs over all documents. As every token of a window is required,
a prefix of one token is complete: a document that holds the window holds its rarest shingle, at
the same distance from the window's start. Document shingles that are some window's prefix are
candidates; a candidate must leave room for the window before and after it (positional and length
bounds) and is then compared word for word over the whole window.

Candidates are found and verified in one pass over the exploded shingles, with nothing shuffled but
verified hits, which are written once and read by both aggregates. That needs the windows on every
executor, so it is done only while they are within `BROADCAST_BYTES`; larger benchmarks go through
shuffled joins on the prefix and on the row.

Rows are known by a digest of doc_id and text, so that rows that share a doc_id, or have none, each
have their own hits.

Defined cases: a null text or item has no words; an item without words has no window; repeated
item_ids count once; a null item_id hits words but is not listed; repeated rows have equal results;
empty tables give no hits or an empty result; other columns of either table are not read by
`report`, and carried along, whatever their names, by `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower, fresh, let, row_key, whole, words, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
#: Windows of at most so many bytes in all are sent to every executor.
BROADCAST_BYTES = 16 << 20


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), SEPARATORS)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win): the distinct windows of each item."""
    found = benchmark.select("item_id", item_words(whole()).alias("found")).where(F.size("found") > 0)
    return (
        found.select(
            "item_id",
            "found",
            F.explode(
                F.sequence(F.lit(1), F.greatest(F.size("found") - window + 1, F.lit(1)))
            ).alias("at"),
        )
        .select("item_id", F.slice("found", F.col("at"), F.lit(window)).alias("win"))
        .distinct()
    )


def shingles(found: Column, width: int) -> Column:
    """The hash of the `width` words from each place; at the end, of the words that are left.

    The last ones hash as shorter shingles do, so they can only add candidates, which are verified.
    """
    return F.transform(found, lambda w, i: F.xxhash64(w, *[F.get(found, i + k) for k in range(1, width)]))


def placed_shingles(said: DataFrame, widths: list[int]) -> DataFrame:
    """The rows (..., found) with `pos` and `token` for every shingle of these widths."""
    each = F.concat(*[shingles(F.col("found"), w) for w in widths])
    placed = said.select("*", F.posexplode(each).alias("pos", "token"))
    return placed.withColumn("pos", F.col("pos") % F.size("found")) if len(widths) > 1 else placed


def window_tokens(windows: DataFrame) -> DataFrame:
    """(win, before, token): the shingles of each distinct window and their places in it."""
    sized = windows.select("win", F.least(F.size("win"), F.lit(SHINGLE)).alias("width"))
    every = F.array(
        *[F.slice(shingles(F.col("win"), w), F.lit(1), F.greatest(F.size("win") - w + 1, F.lit(0))) for w in range(1, SHINGLE + 1)]
    )
    return sized.select("win", F.posexplode(F.element_at(every, F.col("width"))).alias("before", "token"))


def shingle_rarity(docs: DataFrame, tokens: DataFrame, widths: list[int], small: bool) -> DataFrame:
    """(token, seen): how often each window shingle occurs over all documents."""
    wanted = tokens.select("token").distinct()
    said = placed_shingles(docs.select(item_words(whole()).alias("found")), widths).select("token")
    seen = said.join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").agg(
        F.count(F.lit(1)).alias("seen")
    )
    return wanted.join(seen, "token", "left").select("token", F.coalesce("seen", F.lit(0)).alias("seen"))


def rarest_first(tokens: DataFrame, rarity: DataFrame) -> DataFrame:
    """(win, prefix, before, size): each distinct window with its rarest shingle and its place."""
    ranked = (
        tokens.join(rarity, "token")
        .groupBy("win")
        .agg(F.min(F.struct("seen", "token", "before")).alias("first"))
    )
    return ranked.select(
        "win",
        F.col("first.token").alias("prefix"),
        F.col("first.before").alias("before"),
        F.size("win").alias("size"),
    )


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Hits (row, start, size, wid) with starts from 1, written, and (wid, item_id)."""
    windows = written(item_windows(benchmark, window), "windows")
    held, least = windows.agg(
        F.sum(F.length(F.array_join("win", " ")) * 4 + 64), F.min(F.size("win"))
    ).first()
    small = (held or 0) <= BROADCAST_BYTES
    widths = list(range(min(least or SHINGLE, SHINGLE), SHINGLE + 1))
    wid = F.md5(F.array_join("win", " "))
    tokens = window_tokens(windows.select("win").distinct())
    rarity = shingle_rarity(docs, tokens, widths, small)
    keyed = written(
        rarest_first(tokens, F.broadcast(rarity) if small else rarity).withColumn("wid", wid), "prefixes"
    )
    said = docs.select(row_key("text", "doc_id").alias("row"), item_words(whole()).alias("found"))
    start = F.col("pos") - F.col("before") + 1
    if small:
        placed = placed_shingles(said, widths)
        hits = placed.join(
            F.broadcast(keyed),
            (F.col("token") == F.col("prefix"))
            & (start >= 1)
            & (start + F.col("size") - 1 <= F.size("found"))
            & (F.slice("found", F.greatest(start, F.lit(1)), F.col("size")) == F.col("win")),
        ).select("row", start.alias("start"), "size", "wid")
    else:
        placed = placed_shingles(said, widths).select("row", F.size("found").alias("n"), "pos", "token")
        maybe = (
            placed.join(keyed, F.col("token") == F.col("prefix"))
            .where((start >= 1) & (start + F.col("size") - 1 <= F.col("n")))
            .groupBy(F.col("row").alias("maybe_row"))
            .agg(F.collect_set(F.struct(start.alias("start"), "size", "wid")).alias("maybe"))
        )
        checked = let(
            F.col("found"),
            lambda x: F.filter(
                F.col("maybe"),
                lambda m: F.md5(F.array_join(F.slice(x, m["start"], m["size"]), " ")) == m["wid"],
            ),
        )
        hits = (
            said.join(maybe, F.col("row") == F.col("maybe_row"))
            .select("row", F.explode(checked).alias("hit"))
            .select("row", "hit.start", "hit.size", "hit.wid")
        )
    return written(hits.distinct(), "hits"), windows.select(wid.alias("wid"), "item_id").distinct()


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, hit words and items for each document."""
    hits, items = window_hits(docs, benchmark, window)
    ends = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    covered = hits.groupBy("row").agg(ends.alias("ends")).select("row", union_size("ends").alias("n_hit"))
    named = (
        hits.select("row", "wid").distinct()
        .join(items, "wid")
        .select("row", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    found = written(covered.join(named, "row", "left"), "found").withColumnRenamed("row", "hit_row")
    counts = docs.select(
        "doc_id", row_key("text", "doc_id").alias("row"), F.size(item_words(whole())).cast("long").alias("n_words")
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return counts.join(found, F.col("row") == F.col("hit_row"), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def union_size(ends: str) -> Column:
    """Places that ascending (start, end) spans cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        F.col(ends),
        zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0))).alias("n"),
            F.greatest(a["to"], x["end"]).alias("to"),
        ),
        lambda a: a["n"],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows in which no window occurs, with their own columns."""
    row, hit_row = fresh(docs, "row", "hit_row")
    hits, _ = window_hits(docs, benchmark, window)
    hit = written(hits.select(F.col("row").alias(hit_row)).distinct(), "hitrows")
    kept = docs.withColumn(row, row_key("text", "doc_id")).join(hit, F.col(row) == F.col(hit_row), "left_anti")
    return kept.drop(row)
