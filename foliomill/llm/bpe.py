"""BPE encoding and decoding with word-end vocabularies, in batched numpy merge rounds.

A text is cut at white space, each distinct piece of a batch normalised (NFC, lower case) and cut
into letter runs, single digits and symbol runs. The words of all new pieces lie in one flat array
of symbols; a round finds each word's lowest-ranked pair by binary search over the sorted pair
keys and merges it wherever the word has it, until no word has a known pair. Words over
`LONG_WORD` symbols, for which rounds would take too many passes, go through a heap with the same
result. Encoded pieces are kept per worker, up to `CACHE_PIECES`.

The vocabulary file's path is a parameter; every executor reads it there.

Defined cases: null and empty texts have no tokens; the vocabulary's own special strings in a text
are single tokens; a text of any length is encoded whole, a bounded part at a time, and nothing
depends on where the parts are cut, as no token crosses white space; other columns are carried
along by `encode`, whatever their names (a column named `ids`, in any case, is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import named, numbered_names

#: White space of the Unicode property, which is not quite what str.split() takes.
SPACE = "\t-\r \x85\xa0  -     　"
LONG_WORD = 256
CACHE_PIECES = 200_000
#: Characters handled at a time.
PART_CHARS = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = {b: chr(b) for b in plain}
    return [shown.get(b) or chr(next(spare)) for b in range(256)]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of runs of these lengths, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordBpe:
    """One vocabulary, with a cache of encoded pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.names = np.array([names.get(i, "") for i in range(self.size)], dtype=object)
        letters, end = byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # A pair given twice keeps its later rank.
        order = np.lexsort((np.arange(len(keys)), keys))
        final = np.append(keys[order][1:] != keys[order][:-1], True)
        self.keys, self.ranks = keys[order][final], order[final].astype(np.int64)
        self.made = made
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
        )
        self.spaces = re.compile(f"[{SPACE}]+")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def pieces(self, text: str) -> list[str]:
        """White-space pieces of a text; special strings are pieces of their own."""
        if "<" in text and self.marks.search(text):
            found, at = [], 0
            for m in self.marks.finditer(text):
                found += [*self._split(text[at : m.start()]), m[0]]
                at = m.end()
            return found + self._split(text[at:])
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in self.spaces.split(text) if x]
        return text.split()

    def _piece_words(self, piece: str) -> list[str]:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
        # Each character is lowered alone, so a sigma is never taken as final.
        low = piece.lower() if "Σ" not in piece else "".join(c.lower() for c in piece)
        return [low] if low.isalpha() else self.words.findall(low)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that the cache lacks."""
        words: dict[str, int] = {}
        spans: list[int] = []
        counts: list[int] = []
        special: list[int] = []
        for piece in pieces:
            if piece in self.special:
                # Special strings come after all words; their places are set below.
                special.append(self.special[piece])
                spans.append(-len(special))
                counts.append(1)
            else:
                found = self._piece_words(piece)
                spans += [words.setdefault(w, len(words)) for w in found]
                counts.append(len(found))
        flat, ends = self.merge_all(list(words))
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        begins = np.concatenate((begins, len(flat) + np.arange(len(special))))
        sizes = np.concatenate((ends, len(flat) + np.arange(len(special)) + 1)) - begins
        flat = np.concatenate((flat, np.array(special, np.int64)))
        span = np.array(spans, np.int64)
        span = np.where(span < 0, len(words) - 1 - span, span)
        ids = flat[_runs(begins[span], sizes[span])]
        owner = np.repeat(np.arange(len(pieces)), counts)
        held = np.bincount(owner, weights=sizes[span], minlength=len(pieces)).astype(np.int64)
        base = len(self.at)
        self.at.update(zip(pieces, range(base, base + len(pieces))))
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(held) - held))
        self.lengths = np.concatenate((self.lengths, held))
        self.pool = np.concatenate((self.pool, ids.astype(np.int32)))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by binary search; the number of merges where unknown."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word ends."""
        raw = [w.encode("utf-8", "replace") for w in words]
        room = np.fromiter(map(len, raw), np.int64, len(raw))
        octets = np.frombuffer(b"".join(raw), np.uint8)
        place = np.cumsum(room) - room
        out, final = np.empty(len(octets), np.int64), room.copy()
        for i in np.flatnonzero(room > LONG_WORD):
            ids = self._merge_long(raw[i])
            out[place[i] : place[i] + len(ids)], final[i] = ids, len(ids)
        short = room <= LONG_WORD
        live, sizes = np.flatnonzero(short), room[short]
        sym = self.inner[octets]
        sym[place + room - 1] = self.last[octets[place + room - 1]]
        sym = sym[np.repeat(short, room)]
        none = len(self.made)
        while len(live):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rank = np.full(len(sym), none)
            rank[:-1] = self.rank_of(sym[:-1], sym[1:])
            rank[ends - 1] = none
            best = np.minimum.reduceat(rank, starts)
            go = best < none
            stay = np.repeat(go, sizes)
            if not go.all():
                out[_runs(place[live[~go]], sizes[~go])] = sym[~stay]
                final[live[~go]] = sizes[~go]
            hit = (rank == np.repeat(best, sizes)) & stay
            # In a run of overlapping hits, every other one counts, from the left.
            run = np.arange(len(hit))
            since = np.maximum.accumulate(np.where(hit, -1, run))
            hit &= (run - since) % 2 == 1
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            stay[at + 1] = False
            lost = np.add.reduceat(hit.astype(np.int64), starts)
            sym, live, sizes = sym[stay], live[go], (sizes - lost)[go]
        return out[_runs(place, final)], np.cumsum(final)

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, by a heap of (rank, place)."""
        octets = np.frombuffer(word, np.uint8)
        ids = self.inner[octets]
        ids[-1] = self.last[octets[-1]]
        n, none = len(ids), len(self.made)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank_of(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first < none)]
        heapq.heapify(heap)
        sym, now = ids.tolist(), [*first.tolist(), none]

        def look(i: int) -> None:
            j = after[i]
            now[i] = none if j >= n else int(self.rank_of(np.int64(sym[i]), np.int64(sym[j])))
            if now[i] < none:
                heapq.heappush(heap, (now[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank:
                continue
            j = after[i]
            sym[i], after[i], now[j] = int(self.made[rank]), after[j], -1
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        kept, i = [], 0
        while i < n:
            kept.append(sym[i])
            i = after[i]
        return np.array(kept, np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; the new pieces of texts that are cut in one part are learned together."""
        if sum(map(len, texts)) > 2 * PART_CHARS:
            return [np.concatenate([self._encode(self.pieces(p)) for p in self._parts(t)]) for t in texts]
        cut = [self.pieces(t) for t in texts]
        flat = self._encode([x for c in cut for x in c])
        # Where each text ends, from the lengths of its pieces.
        ends = np.cumsum(self.lengths[self._index], dtype=np.int64)
        last = np.cumsum([len(c) for c in cut])
        stops = np.where(last > 0, ends[np.maximum(last - 1, 0)] if len(ends) else 0, 0)
        return np.split(flat, stops[:-1])

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * PART_CHARS:
            m = self.spaces.search(text, at + PART_CHARS)
            if not m:
                break
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]

    def _encode(self, pieces: list[str]) -> np.ndarray:
        fresh = [x for x in dict.fromkeys(pieces) if x not in self.at]
        if fresh:
            if len(self.at) + len(fresh) > CACHE_PIECES:
                self.clear()
                fresh = list(dict.fromkeys(pieces))
            self.learn(fresh)
        self._index = index = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        lengths, starts = self.lengths[index], self.starts[index]
        return self.pool[_runs(starts, lengths)]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by a space, as for vocabularies without a decoder."""
        return " ".join(self.names[ids].tolist())


@lru_cache(2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def _slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Rows cut so that a slice holds one text or at most so many bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > chars:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """The rows with `ids`, an array of token ids, added."""
    path = path or default_path()
    kept = [c for c in docs.columns if c.lower() != "ids"]
    at, rows = kept.index(column), numbered_names(docs.select(*map(named, kept)))
    schema = rows.withColumn("ids", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for a, b in _slices(batch.column(at), PART_CHARS):
                part = batch.slice(a, b - a)
                ids = bpe.encode_batch([x or "" for x in part.column(at).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                made = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, "ids")


def decode(rows: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """The rows with `decoded`, the text of their ids, added; null ids decode to the empty text."""
    path = path or default_path()
    kept = [c for c in rows.columns if c.lower() != "decoded"]
    at, rows = kept.index(column), numbered_names(rows.select(*map(named, kept)))
    schema = rows.withColumn("decoded", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                ids = part.column(at)
                if pa.types.is_large_list(ids.type):
                    ids = ids.cast(pa.list_(pa.int32()))
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                texts = [bpe.decode(flat[s:e]) for s, e in zip([0, *ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, "decoded")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): both ways in one Python process for each task, a slice of rows at a time."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for a, b in _slices(batch.column("text"), PART_CHARS):
                rows = batch.slice(a, b - a)
                ids = bpe.encode_batch([x or "" for x in rows.column("text").to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                made = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                texts = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), made, texts], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
