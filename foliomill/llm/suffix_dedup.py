"""Suffix-array dedup: bytes covered by long strings that occur elsewhere too are removed.

Every string of `length` bytes that starts at two places, in one document or two, is found, and all
bytes that such strings cover are removed; what counts is the input, not what is left.

1. Anchors. From all `GRAM`-byte windows inside a string of `length` bytes, the one with the least
   hash, the first of equals, is its anchor; that depends on the string alone, so equal strings have
   equal anchors at equal places. Strings that start next to each other mostly share their anchor, so
   every start lies in one interval of starts with one anchor, of about 70 bytes. An anchor's context
   is all that the strings from its interval cover. Only anchors whose hash occurs twice go on.
2. Equal contexts. Contexts are digested; a context that occurs twice is covered whole, and one of
   each goes on. So exact copies cost one context each, whatever their number.
3. Suffix arrays. The distinct contexts of an anchor with several of them go to one shard, whose
   suffixes are sorted by external induced sorting (see `induced`), with common prefixes: its text,
   names and queues lie in files beyond `memory` bytes, whatever the shard's size. Suffixes that share
   `length` bytes with a neighbour are starts of repeated strings, if they come from two places. A
   shard takes whole anchors, and no further one after `shard_bytes`.
4. Hot anchors, with more than `HOT_CONTEXTS` distinct contexts, are not gathered in a task: each
   string around them is digested, and digests are counted with partial sums. This is exact too.
5. Covered spans return to their documents, are merged there and cut out.

Rows are known by digests of doc_id and text, so that rows sharing a doc_id do not mix.

Defined cases: a null text is empty; texts under `length` bytes lose nothing; repeated rows are
documents of their own, so long ones are copies of each other; a null doc_id is kept as it is; an
empty table gives an empty result; other columns are not read; cuts fall on bytes, so what is left of
a text is binary.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .induced import MEMORY, Disk, induced_order
from .text import forget, whole, written

LENGTH = 200
GRAM = 64
#: A shard of this size has more names than fit in `MEMORY` bytes, so that they are sorted by recursion.
SHARD_BYTES = 4 << 20
HOT_CONTEXTS = 8_000
#: Keys of documents with contexts to fetch are sent to all executors up to so many bytes, 16 a key.
BROADCAST_BYTES = 16 << 20
#: Places that one piece of a long text has: they share 64 bits with what is kept of a hash.
PIECE = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_MASK = 0xFFFFFFFFFFFFFFFF
_TABLE, _SECOND = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def string_hashes(octets: np.ndarray, length: int, table: np.ndarray = _TABLE) -> np.ndarray:
    """A polynomial hash of the `length` bytes from each position."""
    h, factor, done, shift = table[octets], _FACTOR, None, 0
    while True:
        if length & 1:
            if done is None:
                done, shift = h, factor
            else:
                # h covers the bytes before those already covered.
                width = len(octets) - len(h) + 1
                n = len(done) - width
                done = h[:n] * np.uint64(shift) + done[width : width + n]
                shift = shift * factor & _MASK
        length >>= 1
        if not length:
            return done
        width = len(octets) - len(h) + 1
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor & _MASK


def gram_hashes(octets: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of the `gram` bytes from each position, whose order is as good as random."""
    h = string_hashes(octets, gram)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _slide(values: np.ndarray, window: int, best) -> np.ndarray:
    """best over each run of `window` values."""
    width = 1
    while 2 * width <= window:
        values = best(values[:-width], values[width:])
        width *= 2
    rest = window - width
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(octets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first, last, at, hash): intervals of starts, each with its anchor, a bounded piece at a time.

    An interval may be cut in two where a piece of the text ends, and by places of equal hashes.
    """
    window, n = length - gram + 1, len(octets)
    low = np.uint64(PIECE - 1)
    step = PIECE - length
    out: list[tuple[np.ndarray, ...]] = []
    for start in range(0, max(n - length + 1, 0), step):
        h = gram_hashes(octets[start : start + PIECE], gram)
        # The place stands below the hash, so that the least of a window is the first of equals.
        least = _slide((h & ~low) | np.arange(len(h), dtype=np.uint64), window, np.minimum)[:step]
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        out.append((first + start, last + start, at[first] + start, h[at[first]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _row_key(doc_id: Column) -> list[Column]:
    shown = F.coalesce(doc_id.cast("string"), F.lit(""))
    return [F.xxhash64(shown, doc_id.isNull()).alias("k1"), F.xxhash64(whole()).alias("k2")]


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2 and the text of each row."""
    return docs.select(*_row_key(F.col("doc_id")), whole().alias("text"))


def all_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, pos, size, anchor, context): every anchor's context, by its place and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            held, size = [], 0
            for i, text in enumerate(batch.column("text")):
                octets = text.as_buffer()
                if octets is None or octets.size < length:
                    continue
                raw = octets.to_pybytes()
                first, last, at, hashes = anchors(np.frombuffer(raw, np.uint8), length)
                ends = last + length
                contexts = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), ends.tolist())], np.uint64)
                # Contexts of one content may have their anchors at different places.
                contexts ^= (at - first).astype(np.uint64) << np.uint64(32)
                held.append((np.full(len(at), k1[i]), np.full(len(at), k2[i]), first, (ends - first).astype(np.int32),
                             hashes.view(np.int64), contexts.view(np.int64)))
                size += len(at)
                if size > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)

    names = ["k1", "k2", "pos", "size", "anchor", "context"]
    schema = "k1 bigint, k2 bigint, pos bigint, size int, anchor bigint, context bigint"
    return keyed(docs).mapInArrow(run, schema)


def fetch_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted (k1, k2, pos, size, anchor, context, hot) contexts."""
    fields = ["pos", "size", "anchor", "context", "hot"]
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields)).alias("spots"))
    # Repeated rows have the same key; one of them is enough.
    texts = only(keyed(docs), wanted.select("k1", "k2").distinct()).dropDuplicates(["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("k1").to_numpy() ^ batch.column("k2").to_numpy()
            for i, (text, spots) in enumerate(zip(batch.column("text"), batch.column("spots"))):
                raw, spots = text.as_buffer().to_pybytes(), spots.values
                pos, size, anchor, context, hot = (spots.field(f) for f in fields)
                octets = [raw[a : a + n] for a, n in zip(pos.to_pylist(), size.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [anchor, context, pa.array(np.full(len(pos), key[i])), pos, pa.array(octets, pa.binary()), hot], names
                )

    names = ["anchor", "context", "doc", "pos", "octets", "hot"]
    schema = "anchor bigint, context bigint, doc bigint, pos bigint, octets binary, hot boolean"
    return texts.join(lists, ["k1", "k2"]).mapInArrow(run, schema)


def only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the given distinct keys, without a shuffle while these take few bytes."""
    keys = written(keys, "keys")
    few = keys.count() * 16 <= BROADCAST_BYTES
    return docs.join(F.broadcast(keys) if few else keys, ["k1", "k2"], "left_semi")


class Shard:
    """Contexts of whole anchors: their bytes in a file beyond a share of memory, and who they are."""

    def __init__(self, memory: int):
        self.disk, self.size = Disk(memory), 0
        self.octets = tempfile.SpooledTemporaryFile(memory // 4)
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, anchor: np.ndarray, context: np.ndarray, origin: np.ndarray, octets: pa.BinaryArray) -> None:
        ends = np.frombuffer(octets.buffers()[1], np.int32)[octets.offset : octets.offset + len(octets) + 1]
        self.octets.write(memoryview(octets.buffers()[2])[ends[0] : ends[-1]])
        self.rows.append((anchor, context, origin, np.diff(ends).astype(np.int64)))
        self.size += int(ends[-1] - ends[0])

    def text(self, sizes: np.ndarray) -> np.ndarray:
        """The contexts as symbols, each closed by 1, and the whole by 0."""
        ends, n = np.cumsum(sizes), int(sizes.sum())
        out = self.disk.array(n + len(sizes), np.uint16)
        self.octets.seek(0)
        for a, b in self.disk.cuts(n):
            raw = np.frombuffer(self.octets.read(b - a), np.uint8)
            out[np.arange(a, b) + np.searchsorted(ends, np.arange(a, b), side="right")] = raw.astype(np.uint16) + 2
        out[ends + np.arange(len(ends))] = 1
        out[-1] = 0
        return out

    def spans(self, length: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor, context, a, b) of what repeated strings cover, as distances from the context's start."""
        anchor, context, origin, sizes = (np.concatenate(x) for x in zip(*self.rows))
        text = self.text(sizes)
        begins = np.cumsum(sizes + 1) - sizes - 1
        hit = self.disk.array(len(text), bool)
        for a, b in self.disk.cuts(len(text)):
            hit[a:b] = False
        mark_repeated(induced_order(text, disk=self.disk), hit, begins, sizes, origin, length)
        for part, a, b in _runs(hit, begins, length, self.disk):
            yield anchor[part], context[part], a.astype(np.int32), b.astype(np.int32)


def mark_repeated(
    stream: Iterator[np.ndarray], hit: np.ndarray, begins: np.ndarray, sizes: np.ndarray, origin: np.ndarray, length: int
) -> None:
    """Set the places where a string of `length` bytes starts that starts at another origin too.

    Suffixes that share so many bytes follow each other in the stream. Of the group that may go on
    in the next piece, its places are kept while they come from one origin only, and so are few.
    """
    low = high = None
    waiting = np.zeros(0, np.int64)
    for part in stream:
        group = np.cumsum(part["lcp"] < length)
        at = part["at"].astype(np.int64)
        of = np.searchsorted(begins, at, side="right") - 1
        inside = at - begins[of]
        ok = inside + length <= sizes[of]
        at, group, place = at[ok], group[ok], (origin[of] + inside)[ok]
        if low is not None and len(waiting):
            at, group, place = np.append(waiting, at), np.append(np.zeros(len(waiting), np.int64), group), np.append(np.full(len(waiting), low), place)
        if low is not None and low != high:
            # The group is known to repeat: one more place stands for it.
            group, place, at = np.append([0, 0], group), np.append([low, high], place), np.append([-1, -1], at)
        if not len(at):
            if part["lcp"].min() < length:
                low, waiting = None, waiting[:0]
            continue
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least, most = np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts)
        twice = np.repeat(least != most, np.diff(np.append(starts, len(at))))
        found = at[twice]
        hit[found[found >= 0]] = True
        ends = int(np.count_nonzero(part["lcp"] < length))
        if group[-1] == ends:
            low, high = int(least[-1]), int(most[-1])
            waiting = at[starts[-1] :] if low == high else waiting[:0]
        else:
            low, waiting = None, waiting[:0]


def _runs(hit: np.ndarray, begins: np.ndarray, length: int, disk: Disk) -> Iterator[tuple[np.ndarray, ...]]:
    """(part, a, b): the spans that strings at marked starts cover, merged, a piece at a time."""
    open_at = last = -1
    for x, y in [*disk.cuts(len(hit)), (len(hit), len(hit))]:
        at = np.flatnonzero(hit[x:y]) + x
        if open_at >= 0:
            at = np.append([open_at, last], at)
        if not len(at):
            continue
        of = np.searchsorted(begins, at, side="right") - 1
        cut = (np.diff(at) > length) | (of[1:] != of[:-1])
        if open_at >= 0:
            cut[0] = False
        first = np.flatnonzero(np.concatenate(([True], cut)))
        final = np.append(first[1:], len(at)) - 1
        # The last run may go on in the next piece.
        done = len(first) if x == len(hit) else len(first) - 1
        open_at, last = (-1, -1) if x == len(hit) else (int(at[first[-1]]), int(at[-1]))
        part = of[first[:done]]
        yield part, at[first[:done]] - begins[part], at[final[:done]] - begins[part] + length


def origins(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The place of each context's first byte: a digest of its document, and the distance there."""
    mixed = doc.astype(np.uint64) * np.uint64(_FACTOR)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(2)).astype(np.int64) + pos


def shard_spans(contexts: DataFrame, length: int, shard_bytes: int, memory: int) -> DataFrame:
    """(anchor, context, a, b): covered spans, as distances from the context's start, by suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = Shard(memory), None
        for batch in batches:
            if not len(batch):
                continue
            anchor, context, doc, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "context", "doc", "pos"))
            octets, place = batch.column("octets").cast(pa.binary()), origins(doc, pos)
            cuts = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if shard.size >= shard_bytes and anchor[a] != now:
                    for found in shard.spans(length):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)
                    shard = Shard(memory)
                now = anchor[a]
                shard.add(anchor[a:b], context[a:b], place[a:b], octets.slice(a, b - a))
        if shard.size:
            for found in shard.spans(length):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

    names = ["anchor", "context", "a", "b"]
    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor", "context")
    return dealt.mapInArrow(run, "anchor bigint, context bigint, a int, b int")


def hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same spans, for hot anchors, by counting the digest of every string around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = batch.slice(at, 1024)
                listed = rows.column("octets").to_pylist()
                sizes = np.array([len(x) for x in listed], np.int64)
                octets = np.frombuffer(b"".join(listed), np.uint8)
                counts = np.maximum(sizes - length + 1, 0)
                row = np.repeat(np.arange(len(rows)), counts)
                start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                if not len(row):
                    continue
                spot = (np.cumsum(sizes) - sizes)[row] + start
                anchor, context, doc, pos = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "context", "doc", "pos"))
                columns = [
                    anchor[row], context[row], start.astype(np.int32), origins(doc, pos)[row] + start,
                    string_hashes(octets, length)[spot].view(np.int64),
                    string_hashes(octets, length, _SECOND)[spot].view(np.int64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    names = ["anchor", "context", "a", "place", "h1", "h2"]
    schema = "anchor bigint, context bigint, a int, place bigint, h1 bigint, h2 bigint"
    strings = contexts.mapInArrow(run, schema)
    twice = written(
        strings.groupBy("h1", "h2").agg(F.min("place").alias("low"), F.max("place").alias("high"))
        .where(F.col("low") != F.col("high")).select("h1", "h2"),
        "strings",
    )
    return strings.join(twice, ["h1", "h2"]).select("anchor", "context", "a", (F.col("a") + length).alias("b"))


def covered_spans(
    docs: DataFrame,
    length: int = LENGTH,
    shard_bytes: int = SHARD_BYTES,
    hot_contexts: int = HOT_CONTEXTS,
    memory: int = MEMORY,
) -> DataFrame:
    """(k1, k2, spans): for each row key, covered (start, end) byte spans, which may overlap; written."""

    def anew(column: str) -> Column:
        # Another way to write a key, so that a join deals it anew and can split it.
        return F.bitwise_not(F.bitwise_not(column)).alias(column)

    every = written(all_anchors(docs, length), "anchors")
    repeated = every.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")
    ).where(F.col("n") > 1).select(anew("anchor"), (F.col("low") != F.col("high")).alias("several"))
    seen = written(every.join(repeated, "anchor"), "repeated")
    forget(every)
    spot = F.struct("k1", "k2", "pos", "size")
    distinct = written(
        seen.groupBy("anchor", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min(spot).alias("spot"), F.max("several").alias("several")
        ),
        "contexts",
    )
    whole_spans = distinct.where(F.col("n") > 1).select(
        "anchor", "context", F.lit(0).alias("a"), F.col("spot.size").alias("b")
    )
    compared = distinct.where("several")
    # Where every context occurs twice, all are covered already.
    open_anchors = (
        compared.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
        .where((F.col("rows") > 1) & (F.col("least") == 1))
        .select(anew("anchor"), (F.col("rows") > hot_contexts).alias("hot"))
    )
    wanted = compared.join(open_anchors, "anchor").select("anchor", "context", "spot.*", "hot")
    contexts = written(fetch_contexts(docs, wanted), "octets")
    spans = whole_spans.unionByName(
        shard_spans(contexts.where(~F.col("hot")), length, shard_bytes, memory)
    ).unionByName(hot_spans(contexts.where("hot"), length))
    spans = written(
        spans.groupBy("anchor", "context").agg(F.collect_set(F.struct("a", "b")).alias("reach")), "spans"
    )
    forget(distinct, contexts)
    found = written(
        seen.select("k1", "k2", "pos", "anchor", "context")
        .join(spans, ["anchor", "context"])
        .select("k1", "k2", F.inline(F.transform("reach", lambda x: F.struct((F.col("pos") + x["a"]).alias("a"), (F.col("pos") + x["b"]).alias("b")))))
        .groupBy("k1", "k2")
        # Equal rows share a key and have the same spans: a set, merged before the shuffle, holds each once.
        .agg(F.collect_set(F.struct("a", "b")).alias("spans")),
        "covered",
    )
    forget(seen, spans)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """doc_id with `kept` (the remaining bytes), `n_bytes`, `n_removed` and `n_spans`."""
    found = covered_spans(docs, length, **sizes)
    rows = docs.select("doc_id", *_row_key(F.col("doc_id")), whole().alias("text")).join(found, ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.slice(at, 256), []
                for text, spans in zip(part.column("text"), part.column("spans")):
                    raw = text.as_buffer().to_pybytes()
                    n, runs = len(raw), 0
                    if spans.is_valid and len(spans.values):
                        a, b = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("a", "b"))
                        order = np.argsort(a, kind="stable")
                        a, b = a[order], np.maximum.accumulate(b[order])
                        first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                        ends = b[np.append(first[1:], len(a)) - 1]
                        runs = len(first)
                        raw = b"".join(raw[x:y] for x, y in zip([0, *ends.tolist()], [*a[first].tolist(), n]))
                    out.append((raw, n, n - len(raw), runs))
                kept, *counts = zip(*out)
                columns = [part.column("doc_id"), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in counts]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
    )


def report(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    return remove_repeats(docs, length, **sizes).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
