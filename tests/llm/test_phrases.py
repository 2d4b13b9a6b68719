"""Collocations against plain Python over all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from foliomill.llm import phrases
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, word string, block string, `a.b` string, n string"


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x or "")


def expected(rows, min_count=10, contained=50, top=2000):
    counts = {}
    for _, text, lang, *_ in rows:
        found = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            said = [w for w in re.split("[ \t]+", piece) if w]
            for k in (1, 2, 3):
                found.update(tuple(said[i : i + k]) for i in range(len(said) - k + 1))
    out = []
    for lang, found in counts.items():
        n = sum(c for p, c in found.items() if len(p) == 1)
        kept = []
        for p, a in found.items():
            if len(p) == 1 or a < min_count:
                continue
            if any(100 * c >= contained * a for q, c in found.items() if len(q) == 3 and len(p) == 2 and c >= min_count and p in (q[:2], q[1:])):
                continue
            cuts = [(1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            best, k = min(cuts)
            kept.append((-best, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    words = ["the", "of", "Über", "new", "york", "city", "naïve", "x-y", "a", "a", "zq", "日本"]
    rows = [(i, None if i % 50 == 7 else "", "en", "c", "c", "c", "c") for i in range(4)]
    for i in range(n):
        said = []
        for _ in range(rng.randint(0, 40)):
            said.append(rng.choice(words) + rng.choice(["", "", "", "s", str(rng.randint(0, 30))]))
            if rng.random() < 0.1:
                said[-1:] = ["New", "York", "City"]
            if rng.random() < 0.05:
                said[-1] = rng.choice(["left hand", "hand over\tfist", "a a a a"])
        text = rng.choice([" ", "  ", "\t"]).join(said)
        text = re.sub("s ", lambda m: rng.choice(["s ", "s. ", "s\n", "s,", "s\r\n", "s\u00a0", "s\x1c"]), text)
        rows.append((None if i % 60 == 0 else i % 300, text, ["en", "en", "en", None, "und", "fr", ""][i % 7], "c", "c", "c", "c"))
    rows += [rows[10], rows[10], (5, "New York City " * 3000, "en", "c", "c", "c", "c"), (6, "rare words only here", "tiny", "c", "c", "c", "c")]
    return rows


@pytest.mark.parametrize(("bytes_", "top"), [(4 << 20, 2000), (500, 25)])
def test_phrases(spark, monkeypatch, bytes_, top):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", bytes_)
    rows = corpus()
    out = phrases.report(spark.createDataFrame(rows, SCHEMA).repartition(3), top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(kind == "bigint" for name, kind in out.dtypes if name not in ("lang", "phrase"))
    got, want = sorted(tuple(r) for r in out.collect()), expected(rows, top=top)
    assert got == want and {r[0] for r in got} >= {"en", "und", "fr", ""} and any(len(r[2].split(" ")) == 3 for r in got)


def test_lists_hold_every_place():
    chunks = [c for t in (b"B a\tb. a,a b", b"", b"c a") for c in phrases._chunks(t)]
    rows = phrases.invert(3, "en", chunks).to_pylist()
    places = {r["word"]: np.cumsum(r["gaps"]).tolist() for r in rows}
    assert places == {"b": [0, 2, 7], "a": [1, 4, 6, 11], "c": [10]} and all(r["n"] == len(r["gaps"]) for r in rows)
    hit, at = phrases.follow(np.array([1, 3, 7]), np.array([0, 3, 4, 7]))
    assert hit.tolist() == [1, 2] and at.tolist() == [1, 3]


def test_scores_are_exact(spark):
    cases = [(10**15, 10**15, 10**15), (10**15 - 1, 10**15, 10**15), (3037000500, 3037000501, 9 * 10**15), (10, 11, 13), (7, 7, 10**15)]
    frame = spark.createDataFrame(cases, "a bigint, l bigint, r bigint")
    got = frame.select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [1_000_000 * r.a * r.a // (r.l * r.r) for r in got]


def test_phrases_of_nothing(spark):
    assert phrases.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.report(spark.createDataFrame([(1, None, None, "", "", "", "")], SCHEMA)).collect() == []
