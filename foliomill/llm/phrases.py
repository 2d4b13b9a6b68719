"""Collocations: phrases of two and three words that occur together more than their parts suggest.

The corpus is indexed vertically. A task cuts its documents, by language, into blocks of a bounded
number of bytes; in a block every word has a list of the places where it occurs, and a place is left
free between pieces, so that no phrase runs across one. The length of a list is the word's exact count
in the block, and the sums over blocks are its count in the corpus. Only lists of frequent words go on.

Phrases grow by merge joins inside a block: the places behind a phrase's occurrences are looked up in
the sorted places of the lists that may follow, words for phrases of one word, frequent pairs that
overlap by a word for phrases of two. What matches is the list of the longer phrase, and its length
again the exact count. A word's, pair's or triple's block counts are one row for each block, so that
the most frequent phrase has a row for every `BLOCK_BYTES` of text, not one for every occurrence.

Pairs are counted by one exchange, with each row's block kept, so that frequent pairs return to their
blocks without a second join. All counts are whole numbers, products are decimals of 38 digits, and
quotients are rounded down exactly.

Defined cases: a null text is empty, a null lang is `und`, together with documents that say so; texts
without words add nothing; a text longer than a block is cut between pieces; repeated rows and rows that
share a doc_id all count; a language without candidates is not in the result; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import forget, whole, written

MIN_COUNT = 10
#: A phrase goes if a longer one has at least so many of 100 of its occurrences.
CONTAINED = 50
TOP = 2000
#: Bytes of text in a block of one language.
BLOCK_BYTES = 4 << 20
#: Bytes in the open blocks of all languages together, as a multiple of one.
OPEN_BLOCKS = 2
#: Rows whose texts are taken out of a batch at a time.
ROWS = 256

#: Separators of pieces become the one that stands for all, tabs spaces, A-Z a-z.
_CUTS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_CUTS + b"\t", b"." * len(_CUTS) + b" ")
POSTINGS = "block long, lang string, word string, n long, gaps array<int>"


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text in lower case with ` . ` between its pieces, cut there if it is longer than a block."""
    text = text.lower().translate(_TABLE).replace(b".", b" . ") + b" . "
    while len(text) > BLOCK_BYTES:
        at = text.find(b" . ", BLOCK_BYTES)
        if at < 0:
            break
        yield text[: at + 3]
        text = text[at + 3 :]
    yield text


def invert(block: int, lang: str, chunks: list[bytes]) -> pa.RecordBatch:
    """The lists of a block's words: each one's places, as the first and then the steps between."""
    said = b"".join(chunks).split()
    known = dict.fromkeys(said)
    known.pop(b".", None)
    known = dict(zip(known, range(len(known))))
    ids = np.fromiter((known.get(w, -1) for w in said), np.int64, len(said))
    keys = (ids << 32) | np.arange(len(ids))
    keys = np.sort(keys[ids >= 0])
    places = (keys & 0xFFFFFFFF).astype(np.int32)
    counts = np.bincount(keys >> 32, minlength=len(known))
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    gaps = np.diff(places, prepend=np.int32(0)).astype(np.int32)
    gaps[offsets[:-1]] = places[offsets[:-1]]
    n = len(known)
    return pa.RecordBatch.from_pydict(
        {
            "block": np.full(n, block, np.int64),
            "lang": pa.array([lang] * n, pa.string()),
            "word": pa.array(list(known), pa.binary()).cast(pa.string(), safe=False),
            "n": counts.astype(np.int64),
            "gaps": pa.ListArray.from_arrays(pa.array(offsets), pa.array(gaps)),
        }
    )


def postings(docs: DataFrame) -> DataFrame:
    """(block, lang, word, n, gaps): the vertical lists of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        open_, sizes = {}, {}
        for rows in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            texts = rows.column(1).cast(pa.binary()).to_pylist()
            for lang, text in zip(rows.column(0).to_pylist(), texts):
                for chunk in _chunks(text):
                    open_.setdefault(lang, []).append(chunk)
                    sizes[lang] = sizes.get(lang, 0) + len(chunk)
                    full = [lang] if sizes[lang] >= BLOCK_BYTES else []
                    if sum(sizes.values()) >= OPEN_BLOCKS * BLOCK_BYTES:
                        full = list(sizes)
                    for x in full:
                        sizes.pop(x)
                        yield invert(block, x, open_.pop(x))
                        pa.default_memory_pool().release_unused()
                        block += 1
        for lang in list(open_):
            yield invert(block, lang, open_.pop(lang))
            block += 1

    told = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole().alias("text"))
    return told.mapInArrow(run, POSTINGS)


class Lists:
    """The lists of a block, merged by place: `places` ascends, `of` says whose list each is from."""

    def __init__(self, group: pa.Table):
        group = group.combine_chunks()
        self.wids = group.column("wid").to_numpy()
        gaps = group.column("gaps").combine_chunks()
        sizes = gaps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        steps = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(steps)
        first = np.cumsum(sizes) - sizes
        places = total - np.repeat(total[first] - steps[first], sizes)
        merged = np.sort((places << 32) | np.repeat(np.arange(len(sizes)), sizes))
        self.places, self.of = merged >> 32, merged & 0xFFFFFFFF


def follow(behind: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two ascending lists: which places behind phrases are in the other list, and where."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(places, behind), len(places) - 1)
    hit = np.flatnonzero(places[at] == behind)
    return hit, at[hit]


def pair_lists(lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of listed words, and each one's key."""
    left, right = follow(lists.places + 1, lists.places)
    return lists.places[left], lists.of[left] * len(lists.wids) + lists.of[right]


def block_pairs(group: pa.Table) -> pa.Table:
    """(block, w1, w2, n): the lengths of the lists of pairs."""
    lists = Lists(group)
    _, keys = pair_lists(lists)
    known, n = np.unique(keys, return_counts=True)
    size = len(lists.wids)
    return pa.table(
        {
            "block": np.full(len(known), group.column("block")[0].as_py(), np.int64),
            "w1": lists.wids[known // size],
            "w2": lists.wids[known % size],
            "n": n.astype(np.int64),
        }
    )


def block_triples(group: pa.Table, frequent: pa.Table) -> pa.Table:
    """(w1, w2, w3, n): the lists of frequent pairs, joined with those of pairs that overlap by a word."""
    found = {c: np.zeros(0, np.int64) for c in ("w1", "w2", "w3", "n")}
    if len(group) and len(frequent):
        lists = Lists(group)
        size = len(lists.wids)
        order = np.argsort(lists.wids)
        local = [order[np.searchsorted(lists.wids, frequent.column(c).to_numpy(), sorter=order)] for c in ("w1", "w2")]
        wanted = np.sort(local[0] * size + local[1])
        places, keys = pair_lists(lists)
        at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        kept = wanted[at] == keys
        places, at = places[kept], at[kept]
        left, right = follow(places + 1, places)
        known, n = np.unique(at[left] * size + wanted[at[right]] % size, return_counts=True)
        pair = wanted[known // size]
        found = {
            "w1": lists.wids[pair // size],
            "w2": lists.wids[pair % size],
            "w3": lists.wids[known % size],
            "n": n.astype(np.int64),
        }
    return pa.table(found)


def score(a: Column, left: Column, right: Column) -> Column:
    """A million times a squared by left times right, rounded down; exact for counts up to 10^16."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def mine(docs: DataFrame, min_count: int = MIN_COUNT, contained: int = CONTAINED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): every candidate that no longer one contains too often."""
    lists = written(postings(docs), "postings")
    counted = lists.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    # The numbers have gaps, but as the table is written they stay what they are.
    words = written(counted.where(F.col("f") >= min_count).withColumn("wid", F.monotonically_increasing_id()), "words")
    totals = written(lists.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    kept = written(lists.join(words.select("lang", "word", "wid"), ["lang", "word"]).select("block", "wid", "gaps"), "lists")
    forget(lists)

    found = kept.groupBy("block").applyInArrow(block_pairs, "block long, w1 long, w2 long, n long")
    of_pair = Window.partitionBy("w1", "w2")
    placed = written(
        found.withColumn("a", F.sum("n").over(of_pair)).where(F.col("a") >= min_count).select("block", "w1", "w2", "a"),
        "pairs",
    )
    pairs = written(placed.groupBy("w1", "w2").agg(F.max("a").alias("a")), "pair-counts")
    grown = kept.groupBy("block").cogroup(placed.select("block", "w1", "w2").groupBy("block"))
    triples = written(
        grown.applyInArrow(block_triples, "w1 long, w2 long, w3 long, n long")
        .groupBy("w1", "w2", "w3")
        .agg(F.sum("n").alias("a"))
        .where(F.col("a") >= min_count),
        "triples",
    )
    forget(kept, placed)

    def named(k: int, *more: str) -> DataFrame:
        own = {"wid": f"w{k}", "word": f"word{k}", "f": f"f{k}"}
        return words.select(*own, *more).withColumnsRenamed(own)

    longer = (
        triples.select("w1", "w2", "a")
        .unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("w1", "w2")
        .agg(F.max("a").alias("inside"))
    )
    two = (
        pairs.join(longer, ["w1", "w2"], "left")
        .where(F.col("inside").isNull() | (100 * F.col("inside") < contained * F.col("a")))
        .join(named(1, "lang"), "w1")
        .join(named(2), "w2")
        .select(
            "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
            score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"),
        )
    )
    behind = pairs.withColumnsRenamed({"w1": "v2", "w2": "v3", "a": "a23"})
    early, late = score(F.col("a"), F.col("f1"), F.col("a23")), score(F.col("a"), F.col("a12"), F.col("f3"))
    three = (
        triples.join(pairs.withColumnRenamed("a", "a12"), ["w1", "w2"])
        .join(behind, (F.col("w2") == F.col("v2")) & (F.col("w3") == F.col("v3")))
        .join(named(1, "lang"), "w1")
        .join(named(2), "w2")
        .join(named(3), "w3")
        .withColumns({"early": early, "late": late})
        .select(
            "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
            F.when(F.col("early") <= F.col("late"), F.col("f1")).otherwise(F.col("a12")).alias("l"),
            F.when(F.col("early") <= F.col("late"), F.col("a23")).otherwise(F.col("f3")).alias("r"),
            F.least("early", "late").alias("score"),
        )
    )
    return two.unionByName(three).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(mined: DataFrame, top: int = TOP) -> DataFrame:
    """The first phrases of each language, by score, count and phrase.

    They are ranked among a part of their language first, of which there are as many as shuffle
    partitions, so that the last ranking of a language sees `top` phrases of each part at most.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = max(int(mined.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = mined.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    among = Window.partitionBy("lang", "part").orderBy(*order)
    few = dealt.withColumn("place", F.row_number().over(among)).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame, min_count: int = MIN_COUNT, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """The best phrases of each language with their counts."""
    return best(mine(docs, min_count, contained), top)
