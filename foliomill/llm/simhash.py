"""SimHash near-dedup: 64-bit fingerprints, links by tiled exact comparison, components.

Fingerprints: A-Z lower-cased, words split at ASCII white space, shingles of `SHINGLE` words (the
whole sequence where there are fewer words), each hashed by XXH64 with seed 42; a bit is set if it
is set in over half of the hashes, repeats included. No words: zero.

Links: all pairs of distinct fingerprints at `radius` or fewer differing bits, exactly. The 64
bits are cut in `BLOCKS` blocks; two fingerprints within the radius agree on at least
`BLOCKS - radius` of them, so every choice of that many blocks is a bucket table and linked
fingerprints meet in some bucket. A first cut like this is needed, as the tile pairs of a whole
corpus grow with its square.

Inside a bucket, of whatever size, fingerprints are ordered by population count and cut in tiles of
one count and at most `TILE` rows. Tile pairs whose population counts differ beyond the radius are
skipped; all others are compared by numpy exclusive-or and bit counts. A bucket over `TILE_ROWS`
rows is dealt by population count as well, so that pairs of counts that would be skipped never
meet in a task; counts over `TILE_ROWS` rows are split into parts, and each pair of parts is a task
of its own.

A task gives each fingerprint's tie to the smallest one it is joined with there, not all pairs,
so a group of n copies never gives more than n rows; exact copies share one fingerprint and enter
once. The ties are closed by distributed connected components.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal
fingerprints always link; a null doc_id has no id to link by, so it takes the component of an equal
fingerprint, or null where there is none; rows that share a doc_id each have their own fingerprint;
an empty table gives an empty result; `keep_first` carries other columns along, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import forget, fresh, row_key, sent, written

SEED = 42
SHINGLE = 3
RADIUS = 2
BLOCKS = 5
#: Rows of a bucket, or of one population count in it, that one task compares; larger ones are split.
TILE_ROWS = 8192
#: Rows of a tile inside a task.
TILE = 512
#: Pairs of rows that are compared at a time.
CHUNK = 1 << 18


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of a text, repeats included; none for a text without words."""
    said = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    joined = b" ".join(said)
    digest = xxhash.xxh64_intdigest
    if len(said) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The unsigned number whose bits are set in over half of the hashes; zero without any."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a bounded part of a very long text at a time
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, fp): each row's key, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(fps)], ["row", "doc_id", "fp"])

    kept = docs.select(row_key("text", "doc_id").alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, f"row binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _blocks() -> list[int]:
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


class Tiles:
    """Rows ordered by bucket and population count, cut in tiles of one bucket and count."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray, radius: int, tile: int = TILE):
        counts = np.bitwise_count(fps).astype(np.int64)
        self.order = np.lexsort((counts, keys))
        self.fps, self.radius = fps[self.order], radius
        keys, counts = keys[self.order], counts[self.order]
        runs = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (counts[1:] != counts[:-1]))))
        sizes = np.diff(np.append(runs, len(keys)))
        pieces = -(-sizes // tile)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.starts = np.repeat(runs, pieces) + within * tile
        self.ends = np.minimum(self.starts + tile, np.repeat(runs + sizes, pieces))
        self.keys, self.counts = keys[self.starts], counts[self.starts]
        self.compared = self.skipped = 0

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tile pairs to compare, by their distance in the order; the others are counted as skipped."""
        n = len(self.starts)
        # The tiles of a bucket stand together, in ascending counts: beyond these ends all are skipped.
        last = np.searchsorted(self.keys, self.keys, side="right")
        group = np.cumsum(np.concatenate(([0], (self.keys[1:] != self.keys[:-1]).astype(np.int64))))
        reach = np.searchsorted(group * 256 + self.counts, group * 256 + self.counts + self.radius, side="right")
        self.skipped += int((last - np.minimum(reach, last)).sum())
        for lag in range(int((reach - np.arange(n)).max(initial=0))):
            left = np.flatnonzero(np.arange(n) + lag < reach)
            self.compared += len(left)
            yield left, left + lag

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places, in the order, of rows that lie within the radius of each other."""
        sizes = self.ends - self.starts
        for left, right in self.pairs():
            cells = sizes[left] * sizes[right]
            large = cells > CHUNK >> 6
            for i, j in zip(left[large], right[large]):
                met = np.bitwise_count(
                    self.fps[self.starts[i] : self.ends[i], None] ^ self.fps[None, self.starts[j] : self.ends[j]]
                )
                a, b = np.nonzero(met <= self.radius)
                yield a + self.starts[i], b + self.starts[j]
            left, right, cells = left[~large], right[~large], cells[~large]
            cuts = np.searchsorted(np.cumsum(cells), np.arange(0, cells.sum() + CHUNK, CHUNK)) if len(cells) else []
            for p, q in zip(cuts, [*cuts[1:], len(cells)]):
                if p == q:
                    continue
                tile = np.repeat(np.arange(p, q), cells[p:q])
                at = np.arange(len(tile)) - np.repeat(np.cumsum(cells[p:q]) - cells[p:q], cells[p:q])
                width = sizes[right[tile]]
                a, b = self.starts[left[tile]] + at // width, self.starts[right[tile]] + at % width
                ok = np.bitwise_count(self.fps[a] ^ self.fps[b]) <= self.radius
                yield a[ok], b[ok]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give joined places the smallest label among them."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        x, y = x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def ties(
    keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS, tile: int = TILE
) -> tuple[np.ndarray, np.ndarray, Tiles]:
    """Each linked id with the smallest id of its component in its bucket, and the tiles' counts."""
    tiles = Tiles(keys, fps, radius, tile)
    label = np.arange(len(fps))
    for a, b in tiles.near():
        _unite(label, a, b)
    ids = ids[tiles.order]
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    tied = least[label] != ids
    return ids[tied], least[label][tied], tiles


def block_buckets(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, id, bucket): a row for every choice of blocks that fingerprints within the radius share."""
    masks = _blocks()
    keep = [sum(masks[i] for i in c) for c in combinations(range(BLOCKS), BLOCKS - radius)]
    signed = [k - (1 << 64) if k >> 63 else k for k in keep]
    tables = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
            for n, m in enumerate(signed)
        ]
    )
    return distinct.select("fp", "id", F.explode(tables).alias("at")).select("fp", "id", F.xxhash64("at.n", "at.bits").alias("bucket"))


def _dealt(buckets: DataFrame, radius: int, tile_rows: int, *more: str) -> DataFrame:
    """(key, fp, id, more): rows for each bucket, and for pairs of parts of large ones."""
    buckets = buckets.withColumn("ones", F.bit_count("fp").cast("int"))
    # Sizes are written and their key dealt anew, so that the rows of a hot bucket are split in the join.
    sizes = written(
        buckets.groupBy("bucket", "ones").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
        .agg(F.sum("n").alias("rows"), F.max("n").alias("most")).where(F.col("rows") > 1),
        "buckets",
    )
    sized = buckets.join(
        sizes.select(F.bitwise_not(F.bitwise_not("bucket")).alias("sized"), "rows", "most"), F.col("bucket") == F.col("sized")
    )
    whole = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("a"), F.lit(0).alias("high"), F.lit(0).alias("b")))
    # In a large bucket a row's own part meets the parts of all counts within the radius.
    parts = F.ceil(F.col("most") / tile_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")

    def pair(step: Column, other: Column) -> Column:
        mine = F.struct(F.col("ones").alias("ones"), own.alias("part"))
        theirs = F.struct((F.col("ones") + step).alias("ones"), other.alias("part"))
        low, high = F.least(mine, theirs), F.greatest(mine, theirs)
        return F.struct(low["ones"].alias("low"), low["part"].alias("a"), high["ones"].alias("high"), high["part"].alias("b"))

    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(-radius), F.lit(radius)),
            lambda step: F.transform(F.sequence(F.lit(0), parts - 1), lambda other: pair(step, other)),
        )
    )
    meet = F.explode(F.when(F.col("rows") <= tile_rows, whole).otherwise(cells)).alias("cell")
    return sized.select("fp", "id", "bucket", *more, meet).select(
        "fp", "id", *more, F.xxhash64("bucket", "cell.low", "cell.a", "cell.high", "cell.b").alias("key")
    )


def _compared(buckets: DataFrame, radius: int, tile_rows: int, found) -> DataFrame:
    """(a, b): what `found` gives for the keys, fingerprints and ids of whole buckets, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            keys, fps, ids = (np.concatenate(x) for x in zip(*held))
            whole = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
            held[:] = [(keys[whole:], fps[whole:], ids[whole:])]
            if whole:
                a, b = found(keys[:whole], fps[:whole].view(np.uint64), ids[:whole], radius)[:2]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if len(batch):
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "id")))
                if sum(len(x[0]) for x in held) >= 1 << 16:
                    yield from flush(False)
        if held:
            yield from flush(True)

    dealt = _dealt(buckets, radius, tile_rows).select("key", "fp", F.col("id").cast("long").alias("id"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): ties between the ids of distinct (fp, id) that join what lies within the radius."""
    return _compared(block_buckets(distinct, radius), radius, tile_rows, ties)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    roots = components(links(first.where(F.col("id").isNotNull()), radius))
    named = written(
        first.join(roots, F.col("id") == F.col("node"), "left").select(
            F.col("fp").alias("named_fp"), F.coalesce("root", "id").alias("component_id")
        ),
        "components",
    )
    forget(first)
    return marked.join(named, F.col("fp") == F.col("named_fp")).drop("named_fp")


def report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    return near_duplicates(docs, radius).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns.

    Each row is judged by its own text: where rows share the doc_id of a kept document, those of
    its component stay, as versions of it, and those that are copies of another document go. Rows
    without doc_id stay if no other document has their fingerprint.
    """
    row, first_row = fresh(docs, "row", "first_row")
    marked = near_duplicates(docs, radius, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = written(marked.select(F.col("row").alias(first_row)).distinct(), "first")
    kept = docs.withColumn(row, row_key("text", "doc_id")).join(first, F.col(row) == F.col(first_row), "left_semi")
    return kept.drop(row)


#: Near copies by similarity: shingles of so many words, alike in so large a part of all of either.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Least hashes of a text, in bands; two texts of similarity 0.8 agree in some band with 0.99.
BANDS, BAND = 16, 6
#: Differing bits of fingerprints within which two texts of a band are candidates: those of similarity
#: 0.8 differ in about ten of 64 bits, three more or less, those of 0.9 in under seven.
WIDE = 20
#: Parts that the hashes of a set are dealt to, for each hash of the middle size of two size bands.
PART_LOAD = 0.55
_MIX = np.random.default_rng(11).integers(1, 1 << 32, (2, BANDS * BAND), dtype=np.uint32) | np.uint32(1)


def bands(found: np.ndarray) -> np.ndarray:
    """A hash for each band of least hashes of a set, all zero for the empty set."""
    if not len(found):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint32).max, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * _MIX[0] + _MIX[1]).min(axis=0), out=least)
    out = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _held(n: int, similarity: float) -> int:
    """How many hashes a set of n shares at least with a set of this similarity, and how many that one has at least."""
    return math.ceil(similarity * n - 1e-9)


def _size_bands(similarity: float) -> np.ndarray:
    """Least sizes of bands: sets of this similarity are of one band or of two that are next to each other."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(math.floor(edges[-1] / similarity + 1e-9) + 1)
    return np.array(edges, np.int64)


def part_keys(found: np.ndarray, similarity: float, edges: np.ndarray) -> np.ndarray:
    """Keys of a sorted set of hashes, of which two sets of this similarity have one in common for certain.

    The hashes are dealt to k parts by value, k given by a pair of size bands that both sets belong to. Such sets
    differ in d hashes at most, so that k - d parts are equal. Of m parts with two hashes or more, m - d are equal at
    least, told by their sums, of which the d + 1 least do: the least one in common is among them in both sets. One
    hash alone is found in many texts. Only where m is no more than d, which small sets may have, parts of one hash
    are keys as well, and where these do not tell, the least hashes themselves.
    """
    n = len(found)
    if not n:
        return np.zeros(0, np.int64)
    differ = math.floor((1 - similarity) / (1 + similarity) * (n + math.floor(n / similarity + 1e-9)) + 1e-9)
    own = int(np.searchsorted(edges, n, "right")) - 1
    mix, out = np.uint64(0x9E3779B97F4A7C15), []
    for band in range(max(own - 1, 0), own + 1):
        k = max(round(PART_LOAD * int(edges[band + 1])), 1)
        part = ((found >> np.uint64(16)) % np.uint64(k)).astype(np.uint16 if k < 1 << 16 else np.uint64)
        order = np.argsort(part, kind="stable")
        dealt = part[order]
        at = np.concatenate(([0], np.flatnonzero(dealt[1:] != dealt[:-1]) + 1))
        sums = np.add.reduceat(found[order], at) + dealt[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        several = sums[np.diff(at, append=n) > 1]
        out.append(np.sort((several + np.uint64(3 * band + 1)) * mix)[: differ + 1])
        if len(several) <= differ:
            out.append(np.sort((sums + np.uint64(3 * band + 2)) * mix)[: differ + 1])
            if len(sums) <= differ:
                out.append((found[: n - _held(n, similarity) + 1] ^ np.uint64(0xD6E8FEB86659FD93)) * mix)
    return np.concatenate(out).view(np.int64)


def signatures(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, fp, cid, bands, parts): fingerprint, a digest of the shingle set, its bands and the keys of its parts."""
    edges = _size_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, cids, keys, parts = [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), shingle)
                found = np.unique(hashes)
                fps.append(majority(hashes))
                cids.append(xxhash.xxh3_64_intdigest(found.tobytes()) >> 1)
                keys.append(bands(found))
                parts.append(part_keys(found, similarity, edges))
            columns = [
                batch.column("row"), batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.array(np.array(cids, np.int64)),
                pa.ListArray.from_arrays(np.arange(0, len(keys) * BANDS + 1, BANDS, dtype=np.int32), pa.array(np.concatenate(keys or [np.zeros(0, np.int64)]))),
                pa.array(parts, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "fp", "cid", "bands", "parts"])

    kept = docs.select(row_key("text", "doc_id").alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"row binary, doc_id {kind}, fp bigint, cid bigint, bands array<bigint>, parts array<bigint>")


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    return (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) + (low >> np.uint64(29)))


def forest(
    keys: np.ndarray,
    fps: np.ndarray,
    ids: np.ndarray,
    radius: int,
    groups: np.ndarray | None = None,
    failed: np.ndarray | None = None,
    layers: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids within the radius that join all such pairs of a bucket, the nearest ones first.

    Rows of a bucket that are of one group are joined already, and pairs whose hash is among the failed
    ones are left out. A pair that joins nothing new is tried in the next layer, which joins the bucket
    once more by other pairs. A layer has one pair fewer than rows at most, so that a group of n copies
    gives no more than n in each.
    """
    tiles = Tiles(keys, fps, radius)
    own = ids[tiles.order]
    label = np.arange(len(fps))
    if groups is not None:
        _, first, of = np.unique(np.stack((keys, groups))[:, tiles.order], axis=1, return_index=True, return_inverse=True)
        label = first[of.ravel()]
    labels = [label.copy() for _ in range(layers)]
    met, chosen = [[np.zeros(0, np.int64)] * 3], []

    def join() -> None:
        a, b, apart = (np.concatenate(x) for x in zip(*met))
        del met[:]
        for distance in range(radius + 1):
            at = np.flatnonzero(apart == distance)
            x, y = a[at], b[at]
            for label in labels:
                spare = [(x[:0], y[:0])]
                while len(x):
                    low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
                    differ = low != high
                    spare.append((x[~differ], y[~differ]))
                    x, y, low, high = x[differ], y[differ], low[differ], high[differ]
                    # Every label is hooked on to a smaller one by one pair.
                    hooked, first = np.unique(high, return_index=True)
                    label[hooked] = low[first]
                    chosen.append((x[first], y[first]))
                    rest = np.ones(len(x), bool)
                    rest[first] = False
                    x, y = x[rest], y[rest]
                    while not np.array_equal(up := label[label], label):
                        label[:] = up
                # What joined nothing here may join something in the next layer.
                x, y = (np.concatenate(s) for s in zip(*spare))

    for a, b in tiles.near():
        if groups is not None:
            other = label[a] != label[b]
            a, b = a[other], b[other]
        if failed is not None and len(failed):
            new = ~np.isin(_pair_hash(own[a], own[b]), failed)
            a, b = a[new], b[new]
        met.append([a, b, np.bitwise_count(tiles.fps[a] ^ tiles.fps[b]).astype(np.int64)])
        if sum(len(x[0]) for x in met) > CHUNK:
            join()
            met.append([np.zeros(0, np.int64)] * 3)
    join()
    a, b = (np.concatenate(x) for x in zip([np.zeros(0, np.int64)] * 2, *chosen))
    return np.maximum(own[a], own[b]), np.minimum(own[a], own[b])


def shingle_sets(docs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(cid, found): the sorted shingle hashes of the texts of rows (row, cid)."""
    texts = docs.select(row_key("text", "doc_id").alias("own"), F.col("text").cast("string").alias("text"))
    one = texts.join(sent(rows), F.col("own") == F.col("row")).dropDuplicates(["cid"]).select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(found, pa.binary())], ["cid", "found"])

    return one.mapInArrow(run, "cid bigint, found binary")


def judged_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, alike): whether the sets of a pair have at least this share of all their hashes in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for mine, theirs in zip(batch.column("mine"), batch.column("theirs")):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (mine, theirs))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= least * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "alike"])

    mine, theirs = sets.toDF("own", "mine"), sets.toDF("other", "theirs")
    joined = pairs.join(mine, F.col("a") == F.col("own")).join(theirs, F.col("b") == F.col("other"))
    return joined.select("a", "b", "mine", "theirs").mapInArrow(run, "a bigint, b bigint, alike boolean")


def _grown(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (node, root) after more links: only the groups that these join are looked at; the old ones are forgotten."""

    def root_of(side: str) -> DataFrame:
        return groups.select(F.col("node").alias(f"node_{side}"), F.col("root").alias(f"root_{side}"))

    joined = links.join(root_of("a"), F.col("a") == F.col("node_a"), "left").join(root_of("b"), F.col("b") == F.col("node_b"), "left")
    met = written(components(joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))), "joined")
    over = met.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = groups.join(over, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    out = written(moved.unionByName(met.join(groups.select("node"), "node", "left_anti").select("node", "root")), "groups")
    forget(groups, met)
    return out


def _listed(sets: DataFrame) -> DataFrame:
    """(cid, n, hashes): the hashes of sets (cid, found) and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("found")]
            columns = [batch.column("cid"), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "n", "hashes"])

    return sets.mapInArrow(run, "cid bigint, n int, hashes array<bigint>")


def _across(hashes: DataFrame) -> DataFrame:
    """(shared, sets): the hashes (cid, group, hash) that sets of different groups hold, and how many sets do."""
    counted = hashes.groupBy("hash").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("sets"))
    return counted.where(F.col("low") < F.col("high")).select(F.col("hash").alias("shared"), "sets")


def _completed(groups: DataFrame, marked: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Groups (node, root) after every pair of this similarity whose classes (cid, row) are still apart; written.

    Nothing is left to chance here. Two sets of this similarity have the key of a part in common, so that a
    class of which no other group holds a key is out. Of the others, which are few, whole sets are taken. In any one order of all hashes, the first hash that two such sets share lies
    early in both; with those first that other groups lack, then the rarest, few sets meet by it. What meets
    is told by sizes and places whether it may be similar, and then checked on the sets.
    """
    held = F.ceil(similarity * F.col("n") - 1e-9).cast("int")
    named = groups.select(F.col("node").alias("named"), "root")

    def grouped(frame: DataFrame) -> DataFrame:
        return frame.join(named, F.col("cid") == F.col("named"), "left").withColumn("group", F.coalesce("root", "cid"))

    one = written(grouped(marked.dropDuplicates(["cid"])).select("cid", "group", F.explode("parts").alias("hash")), "parts")
    few = written(_across(one), "across")
    met = one.join(few, F.col("hash") == F.col("shared")).select(F.col("cid").alias("own")).distinct()
    members = written(rows.join(met, F.col("cid") == F.col("own")).select("row", "cid"), "members")
    sets = written(shingle_sets(docs, members, shingle), "sets")
    whole = written(grouped(_listed(sets)).select("cid", "n", "group", F.explode("hashes").alias("hash")), "hashes")
    shared = written(_across(whole), "shared")
    # The hashes of a class that other groups hold, the rarest first, as far as the first shared one may lie.
    rare = (
        whole.join(shared, F.col("hash") == F.col("shared")).groupBy("cid", "n", "group")
        .agg(F.array_sort(F.collect_list(F.struct("sets", "hash"))).alias("rare")).where(F.size("rare") >= held)
    )
    early = rare.select("cid", "n", "group", (F.col("n") - F.size("rare")).alias("before"), F.posexplode(F.slice("rare", F.lit(1), F.size("rare") - held + 1)).alias("pos", "at"))
    early = written(early.select("cid", "n", "group", F.col("at.hash").alias("hash"), (F.col("n") - F.col("before") - F.col("pos")).alias("rest")), "early")
    x, y = (early.select("hash", *[F.col(c).alias(f"{c}_{side}") for c in ("cid", "n", "group", "rest")]) for side in "ab")
    # So many hashes two sets share at least, of which none comes before this one.
    both = F.ceil(similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    apart = (F.col("cid_a") > F.col("cid_b")) & (F.col("group_a") != F.col("group_b"))
    near = x.join(y, "hash").where(apart & (F.least("rest_a", "rest_b") >= both))
    pairs = written(near.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct(), "pairs")
    judged = written(judged_pairs(pairs, sets, similarity), "judged")
    out = _grown(groups, judged.where("alike").select("a", "b"))
    forget(one, few, members, sets, whole, shared, early, pairs, judged)
    return out


def similar_groups(classes: DataFrame, marked: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root): classes (cid, row, fp, bands) joined by all pairs of this similarity; written.

    The pairs that join the buckets of the bands are checked on the shingle sets and joined. What no bucket has
    told, and what stood behind a pair that failed, is found after it, from the signatures (marked).
    """
    hashed = classes.select("cid", "row", "fp", F.transform("bands", lambda x, n: F.xxhash64(n, x)).alias("buckets"))
    cells = hashed.select("fp", F.col("cid").alias("id"), F.explode("buckets").alias("bucket"))
    maybe = written(_compared(cells, WIDE, TILE_ROWS, forest), "maybe")
    met = maybe.select(F.explode(F.array("a", "b")).alias("met")).distinct()
    members = written(hashed.join(met, F.col("cid") == F.col("met")).select("row", "cid"), "members")
    sets = written(shingle_sets(docs, members, shingle), "sets")
    judged = written(judged_pairs(maybe, sets, similarity), "judged")
    groups = written(components(judged.where("alike").select("a", "b")), "groups")
    forget(maybe, members, sets, judged)
    return _completed(groups, marked, classes.select("cid", "row"), docs, shingle, similarity)


def keep_dissimilar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near copies of others: one stays of each group, the one with the smallest doc_id.

    A group is joined by pairs that have at least this share of all their shingles in common. Texts
    with equal shingle sets are one class from the start. Classes that share a band of least hashes
    are a bucket; inside it, fingerprints are compared in tiles, and of the pairs within `WIDE` bits
    those that join them, nearest first, are checked on the shingle sets themselves. What is similar and
    still apart then meets by equal parts of its sets and its rarest shared hashes, so that no pair is lost.

    The rows of the smallest doc_id of a group stay, as versions of one document, but for those of
    other classes of the group; rows without a doc_id stay if no row of the group has one.
    """
    row, gone_row = fresh(docs, "row", "gone_row")
    marked = written(signatures(docs, shingle, similarity), "signatures")
    # Rows without a doc_id come after all others.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(
        marked.groupBy("cid").agg(F.min(F.struct(order.alias("first"), "fp", "bands")).alias("x")).select("cid", "x.first", "x.fp", "x.bands"),
        "classes",
    )
    groups = similar_groups(classes.select("cid", F.col("first.row").alias("row"), "fp", "bands"), marked, docs, shingle, similarity)
    grouped = classes.join(groups, F.col("cid") == F.col("node"), "left").select("cid", "first", F.coalesce("root", "cid").alias("group"))
    # The class of the smallest doc_id stands for its group; the root is dealt anew, as groups may be large.
    best = written(grouped.groupBy("group").agg(F.min(F.struct("first", "cid")).alias("x")).select(F.col("x.cid").alias("own"), F.col("x.first.doc_id").alias("least")), "best")
    # A row goes if its class is not the best of its group, or another document has the class.
    judged = marked.join(best, F.col("cid") == F.col("own"), "left")
    stays = F.col("own").isNotNull() & F.col("doc_id").eqNullSafe(F.col("least"))
    gone = written(judged.where(~stays).select(F.col("row").alias(gone_row)).distinct(), "gone")
    out = docs.withColumn(row, row_key("text", "doc_id")).join(sent(gone), F.col(row) == F.col(gone_row), "left_anti")
    return out.drop(row)
