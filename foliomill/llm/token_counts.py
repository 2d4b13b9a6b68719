"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole; the byte spans of its tokens are joined with the byte
spans of its sections, and every token is counted in one of them. Sections here are the lines of
the text, each with the line feed that ends it; the first line is the title, the rest the body.

A token that crosses a boundary is allocated by an explicit rule: `start`, to the section of its
first byte; `end`, to that of its last byte; `largest`, to the section with most of its bytes, the
earlier one of equals. All token counts of a document add up to its tokens under every rule.

Both span lists are ascending and without gaps, so the interval join is a binary search of token
ends in section ends: n log n in the tokens, whatever the number of sections.

The vocabulary's path is a parameter; every executor reads it there. Special strings in a text are
ordinary text.

Defined cases: a null or empty text has no tokens and one empty section; a text that ends in a
line feed has a last empty section; null doc_ids and repeated rows are rows like any other; a
column that a result column would clash with is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import named, numbered_names

RULES = ("start", "end", "largest")
ROWS = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """A byte-level vocabulary with the byte length of each token."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a whole text, and where each ends, in bytes."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        return ids, np.cumsum(self.lengths[ids])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def line_ends(text: bytes) -> np.ndarray:
    """Where each line ends, in bytes, its line feed included."""
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(feeds, len(text))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens counted in each section, and how many cross a boundary. Spans begin at zero."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    first, last = (np.minimum(x, len(section_ends) - 1) for x in (first, last))
    chosen = last if rule == "end" else first.copy()
    if rule == "largest":
        begins = np.concatenate(([0], section_ends[:-1]))
        for i in np.flatnonzero(first != last):
            inside = np.arange(first[i], last[i] + 1)
            held = np.minimum(section_ends[inside], token_ends[i]) - np.maximum(begins[inside], starts[i])
            chosen[i] = inside[np.argmax(held)]
    return np.bincount(chosen, minlength=len(section_ends)), int((first != last).sum())


def count_tokens(docs: DataFrame, path: str | None = None, rule: str = "start", column: str = "text") -> DataFrame:
    """The rows with `n_tokens`, `n_crossing` and `section_tokens` (a count for each line) added."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or default_path()
    made = ["n_tokens", "n_crossing", "section_tokens"]
    kept = [c for c in docs.columns if c.lower() not in made]
    at, rows = kept.index(column), numbered_names(docs.select(*map(named, kept)))
    schema = rows.select(
        "*",
        F.lit(None).cast("long").alias(made[0]),
        F.lit(None).cast("long").alias(made[1]),
        F.lit(None).cast("array<int>").alias(made[2]),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                tokens, crossing, sections = [], [], []
                for text in part.column(at).to_pylist():
                    text = text or ""
                    _, ends = words.spans(text)
                    counts, crossed = attribute(ends, line_ends(text.encode("utf-8")), rule)
                    tokens.append(len(ends))
                    crossing.append(crossed)
                    sections.append(counts.astype(np.int32))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sections]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sections), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64()), lists],
                    schema.names,
                )

    return rows.mapInArrow(run, schema).toDF(*kept, *made)


def report(docs: DataFrame, path: str | None = None, rule: str = "start") -> DataFrame:
    """Tokens of each document, of its title and body, and of every line."""
    counted = count_tokens(docs.select("doc_id", "text"), path, rule)
    return counted.select(
        "doc_id",
        "n_tokens",
        F.size("section_tokens").cast("long").alias("n_sections"),
        F.get("section_tokens", F.lit(0)).cast("long").alias("title_tokens"),
        (F.col("n_tokens") - F.get("section_tokens", F.lit(0))).cast("long").alias("body_tokens"),
        "n_crossing",
        "section_tokens",
    )
