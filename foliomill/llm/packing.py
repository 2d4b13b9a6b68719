"""Packing of documents into training sequences, in their order, by dynamic programming.

The documents of a partition follow one another as one stream of token ids, each document with `END`
after its last id. Sequences are consecutive windows of at most `LENGTH` ids of this stream. A window
may end at a document's end, behind a sentence, or, where a sentence is too long, inside it; its cost is
its padding, a small charge for every sequence, and a penalty for a cut that is no document's end. A
window whose length is a power of two needs no padding, every other one is padded to `LENGTH`.

Costs of windows that end at j are `cost(i) - place(i)` plus a term of j alone, so that the best start
is a minimum over the places of the last `LENGTH` ids: a monotone queue gives it in constant time.
Windows of a power of two are looked up by their start besides. The stream of a partition goes through
this in stretches of `STRETCH` ids; a stretch ends at its cheapest cut within a window of its end, and
what follows is carried to the next. At the end of a partition every place of the last window may be a
cut, so that the rest is padded or split in powers of two, whichever costs less.

Nothing is shuffled: a partition of the input is a stretch of the corpus already, and only one sequence
of each is not followed by others. Ids are those of the tokenizers library, asked once for every
distinct word that a worker meets: no token of these vocabularies crosses white space. Texts for which
that shortcut might differ (special strings, capital sigma, separators that count as white space only
in Python) are given to the library whole.

The vocabulary's path is a parameter; every executor reads it there.

Defined cases: a null or empty text is a document of one id; a null doc_id and repeated rows are
documents like any other, each with pieces of its own; a document of any length is cut in as many pieces
as its windows; an empty table or partition gives nothing; other columns, whatever their names, are not
read. Sequence ids are the partition's number times 2^33 and the sequence's place in it; they are whole
numbers without gaps only inside a partition.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe import _runs, byte_letters, default_path

LENGTH = 2048
#: The id that ends every document.
END = 1
#: Costs, in ids of padding: a sequence, a cut behind a sentence, a cut inside a sentence.
SEQUENCE, SENTENCE, INSIDE = 4, 8, 64
#: Ids that are cut together.
STRETCH = 1 << 20
#: Parts of a sequence's length: of the sentences that end within such a part the last one's end may be
#: a cut; a long sentence may be cut after each such part; a sequence in the middle of the stream is not
#: cut to a power of two below such a part.
APART, STRIDE, LEAST_POWER = 128, 8, 16
TEXT_BYTES = 4 << 20
CACHE_PIECES = 600_000

_SENTENCE = re.compile(r"[.!?]+[\"')\]]*</w>")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_MARKS = frozenset(".,;:!?")


def _slow(text: str) -> bool:
    """Whether only the library as a whole is sure to cut the text right."""
    return "<|" in text or "Σ" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")


class Encoder:
    """The library's ids of texts, by a cache of white-space pieces and of the words in them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # The same model for words that are cut, lowered and spelled in the vocabulary's letters already.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        names = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_sentence = self.ends_word.copy()
        for name, i in names.items():
            self.ends_word[i] = name.endswith("</w>")
            self.ends_sentence[i] = bool(_SENTENCE.fullmatch(name))
        self.known = _Known()

    def ask(self, texts: list[str]) -> list[np.ndarray]:
        """Ids from the library itself."""
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, np.uint32) for c in coded]

    def learn_words(self, words: list[str]) -> None:
        """Words by the library's model, many in a call; each ends in a token that ends a word."""
        spelled = [w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(self.letters) for w in words]
        lines = [" ".join(spelled[i : i + 4096]) for i in range(0, len(spelled), 4096)]
        coded = self.model.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in coded])
        self.known.add(words, ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0))

    def learn(self, pieces: list[str]) -> None:
        """Distinct pieces that the cache lacks: words by the model, others from the words in them."""
        words = [x for x in pieces if x.isalpha()]
        mixed = [x for x in pieces if not x.isalpha()]
        # Most are a word and a mark behind it; a single word of other characters is its own only part.
        held = [(x[:-1], x[-1]) if x[-1] in _MARKS and x[:-1].isalpha() else _WORDS.findall(x) for x in mixed]
        flat = list(chain.from_iterable(held))
        new = dict.fromkeys(words)
        new.update(dict.fromkeys(w for w in flat if w not in self.known.at))
        if new:
            self.learn_words(list(new))
        several = [len(h) > 1 for h in held]
        mixed = [x for x, s in zip(mixed, several) if s]
        held = [h for h, s in zip(held, several) if s]
        flat = list(chain.from_iterable(held))
        ids, lengths = self.known.take(self.known.find(flat))
        counts = np.fromiter(map(len, held), np.int64, len(held))
        total = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)]
        self.known.add(mixed, ids, np.diff(total, prepend=0))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with END behind it, and where each text ends."""
        cut, whole = [], []
        for i, text in enumerate(texts):
            if _slow(text):
                whole.append(i)
                cut.append([])
            else:
                cut.append((text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split())
        flat = list(chain.from_iterable(cut))
        index = self.known.find(flat)
        missed = np.flatnonzero(index < 0)
        if len(missed):
            if len(self.known.at) > CACHE_PIECES:
                self.known = _Known()
                missed = np.arange(len(flat))
            names = [flat[i] for i in missed.tolist()]
            self.learn(list(dict.fromkeys(names)))
            index[missed] = self.known.find(names)
        ids, lengths = self.known.take(index)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([len(c) for c in cut])]
        if whole:
            parts = np.split(ids, ends[:-1])
            for i, found in zip(whole, self.ask([texts[i] for i in whole])):
                parts[i] = found
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return np.insert(ids, ends, np.uint32(END)), ends + np.arange(1, len(texts) + 1)


class _Known:
    """Strings with their ids, which lie one after another in one array."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(names) != len(lengths):
            raise ValueError("the library cut words in another way")
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names))))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids))

    def find(self, names: list[str]) -> np.ndarray:
        """Where each name stands, or -1."""
        return np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places, one after another, and how many each has."""
        lengths = self.lengths[index]
        return self.ids[_runs(self.starts[index], lengths)], lengths


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def places(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, ascending from 0, and the penalty of each cut."""
    total = len(ids)
    cost = np.full(total + 1, -1, np.int64)
    inner = np.flatnonzero(sentence[ids]) + 1
    part = inner // max(length // APART, 1)
    inner = inner[np.append(part[1:] != part[:-1], np.ones(len(inner[:1]), bool))]
    cost[inner] = SENTENCE
    cost[0] = 0
    cost[ends] = 0
    known = np.flatnonzero(cost >= 0)
    # Long stretches without a sentence's end are cut at regular places.
    step = max(length // STRIDE, 1)
    wide = np.flatnonzero(np.diff(np.append(known, total)) > step)
    for k in wide:
        stop = known[k + 1] if k + 1 < len(known) else total
        cost[known[k] + step : stop : step] = INSIDE
    if last:
        tail = cost[max(total - length, 0) :]
        tail[tail < 0] = INSIDE
        cost[total] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(at: np.ndarray, cost: np.ndarray, length: int, last: bool) -> np.ndarray:
    """The ends of the cheapest windows over the places; the last one is the stream's end if `last`, else within a window of it."""
    n = len(at)
    place, own = at.tolist(), (cost + SEQUENCE).tolist()
    # Starts of windows of a power of two: for each place, those among the places.
    pairs = []
    power = 1
    while power < length // LEAST_POWER and not last:
        power *= 2
    while power < length:
        i = np.searchsorted(at, at - power)
        j = np.flatnonzero(at[np.minimum(i, n - 1)] == at - power)
        pairs.append(np.stack((j, i[j])))
        power *= 2
    ends, starts = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    order = np.argsort(ends, kind="stable")
    starts = starts[order].tolist()
    bounds = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    best, back = [0] * n, [0] * n
    # A queue of places whose cost - place ascends; its head is the best start within reach.
    queue, keys, head = [0], [0], 0
    for j in range(1, n):
        here = place[j]
        while place[queue[head]] < here - length:
            head += 1
        # The padded window from the head: its padding is length - (here - place).
        value, source = keys[head] + length - here, queue[head]
        for i in starts[bounds[j] : bounds[j + 1]]:
            if best[i] < value:
                value, source = best[i], i
        value += own[j]
        best[j], back[j] = value, source
        key = value + here
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    j = n - 1
    if not last:
        first = int(np.searchsorted(at, at[-1] - length))
        first = max(first, 1)
        j = min(range(first, n), key=best.__getitem__) if first < n else n - 1
    found = []
    while j:
        found.append(place[j])
        j = back[j]
    return np.array(found[::-1], np.int64)


class _Stream:
    """The stream of a partition: what waits to be cut, and the documents it comes from."""

    def __init__(self, sentence: np.ndarray, length: int, base: int):
        self.sentence, self.length, self.next = sentence, length, base
        self.kind: pa.DataType | None = None
        self.ids = np.zeros(0, np.uint32)
        #: Where waiting documents end, and the row, whole size and ids gone before of each.
        self.ends = np.zeros(0, np.int64)
        self.rows: list = []
        self.sizes = np.zeros(0, np.int64)
        self.gone = np.zeros(0, np.int64)

    def add(self, rows: list, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ends = np.concatenate((self.ends, ends + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))
        self.rows += rows
        self.sizes = np.concatenate((self.sizes, np.diff(ends, prepend=0)))
        self.gone = np.concatenate((self.gone, np.zeros(len(rows), np.int64)))

    def cut(self, last: bool) -> list[pa.RecordBatch]:
        """The pieces of all sequences that are settled; the rest waits."""
        if not len(self.ids):
            return []
        at, cost = places(self.ids, self.ends, self.sentence, self.length, last)
        found = cuts(at, cost, self.length, last)
        if not len(found):
            return []
        stop = found[-1]
        closed = np.unique(np.concatenate((found, self.ends[self.ends <= stop])))
        begins = np.concatenate(([0], closed[:-1]))
        doc = np.searchsorted(self.ends, begins, side="right")
        window = np.searchsorted(found, begins, side="right")
        doc_begins = np.concatenate(([0], self.ends[:-1]))
        data = self.ids[:stop].astype("<u4").tobytes()
        made = pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([self.rows[i] for i in doc], self.kind),
                "start": begins - doc_begins[doc] + self.gone[doc],
                "length": closed - begins,
                "doc_tokens": self.sizes[doc],
                "sequence_id": self.next + window,
                "offset": begins - np.concatenate(([0], found[:-1]))[window],
                "ids": pa.array([data[4 * a : 4 * b] for a, b in zip(begins, closed)], pa.binary()),
            }
        )
        self.next += len(found)
        # Documents that are not ended wait with what is left of them.
        first = int(np.searchsorted(self.ends, stop, side="right"))
        if first < len(self.ends):
            self.gone[first] += stop - doc_begins[first]
        self.rows, self.sizes, self.gone = self.rows[first:], self.sizes[first:], self.gone[first:]
        self.ends, self.ids = self.ends[first:] - stop, self.ids[stop:]
        return [made]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Rows and texts of a batch, a bounded number of bytes at a time."""
    rows, texts, held = [], [], 0
    for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        rows.append(row)
        texts.append(text or "")
        held += len(texts[-1])
        if held >= TEXT_BYTES:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all sequences.

    `ids` holds the piece's ids as little-endian unsigned 32-bit numbers.
    """
    if length < 1:
        raise ValueError("length is 1 or more")
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType
    names = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = StructType(
        [StructField("doc_id", kind), *[StructField(n, LongType()) for n in names], StructField("ids", BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        stream = _Stream(known.ends_sentence, length, TaskContext.get().partitionId() << 33)
        for batch in batches:
            stream.kind = batch.column(0).type
            for rows, texts in _texts(batch):
                stream.add(rows, *known.encode(texts))
                if len(stream.ids) >= STRETCH:
                    yield from stream.cut(False)
        yield from stream.cut(True)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def report(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces, with a checksum of their ids."""
    return pack(docs, path, length).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
