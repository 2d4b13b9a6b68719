"""Induced sorting and suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from foliomill.llm import induced, suffix_dedup

SCHEMA = "doc_id bigint, text string, context string"


def brute_order(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(t[a:], t[b:])) if x != y), min(len(t) - a, len(t) - b))

    return order, [0] + [shared(a, b) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("memory", [1, 1 << 20])
def test_induced_order_matches_sorting(memory):
    rng = random.Random(memory)
    for _ in range(150):
        t = [rng.randint(1, rng.choice([1, 2, 3, 90])) for _ in range(rng.randint(0, 50))]
        t = t * rng.choice([1, 1, 3]) + [0]
        disk = induced.Disk(memory)
        disk.piece = rng.choice([3, 7, 1000])
        parts = list(induced.induced_order(np.array(t, np.int32), disk=disk))
        order, lcp = brute_order(t)
        # From the largest down, each with the common prefix with the one before in the stream.
        assert np.concatenate([p["at"] for p in parts]).tolist() == order[::-1]
        assert np.concatenate([p["lcp"] for p in parts]).tolist() == [0, *lcp[:0:-1]]


def test_a_shard_far_larger_than_memory(monkeypatch):
    """Text, names and queues go to files, and names are sorted by further inductions."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 107, rng.integers(2, 9)).astype(np.uint8)) for _ in range(60)]
    passage = b" ".join(words[i] for i in rng.integers(0, 60, 400))
    raw = b" ".join([*(words[i] for i in rng.integers(0, 60, 60_000)), passage, *(words[i] for i in rng.integers(0, 60, 9_000)), passage])
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, 0)
    levels = []
    plain = induced._by_induction
    monkeypatch.setattr(induced, "_by_induction", lambda *x: (levels.append(len(x[0])), plain(*x))[1])
    memory = 1 << 18
    disk = induced.Disk(memory)
    assert 8 * len(text) > 10 * memory
    parts = list(induced.induced_order(text, disk=disk))
    assert len(levels) >= 2 and levels[1] < levels[0] == len(text)
    assert disk.mapped > 10 * memory and disk.spilled > 10 * memory
    assert max(len(p) for p in parts) <= disk.piece
    whole = induced.Disk(1 << 30)
    same = list(induced.induced_order(text, disk=whole))
    assert whole.mapped == whole.spilled == 0 and len(levels) == 2 + len(levels[2:])
    for f in ("at", "lcp"):
        assert np.array_equal(np.concatenate([p[f] for p in parts]), np.concatenate([p[f] for p in same]))
    at = np.concatenate([p["at"] for p in parts])[::-1]
    sample = rng.integers(0, len(at) - 1, 2000)
    assert all(raw[at[i] :] < raw[at[i + 1] :] for i in sample)


def brute(texts, length=200):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((d, i))
    cover = [np.zeros(len(r) + 1, bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + length] = True
    out = []
    for raw, c in zip(raws, cover):
        kept = bytes(np.frombuffer(raw, np.uint8)[~c[:-1]])
        out.append((len(raw), int(c.sum()), int((np.diff(c.astype(int)) == 1).sum() + c[0]), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    said = ["the", "of", "naïve", "table", "zq", "über", "number", "a", "in"]

    def prose(n):
        return " ".join(rng.choice(said) + rng.choice(["", "x", "yz"]) for _ in range(n))

    passage, base = prose(60), prose(200)
    texts = [None, "", "short", "a" * 1000, "ab" * 400, passage, passage[3:] + "q"]
    texts += [prose(rng.randint(5, 120)) + passage[: rng.randint(100, 400)] + prose(20) for _ in range(25)]
    for _ in range(15):
        at = rng.randint(0, len(base))
        texts.append(base[:at] + rng.choice(["", "!", prose(3)]) + base[at + rng.randint(0, 9) :])
    return texts + [base, base, base[:300] + base[:300], passage * 3, texts[30]]


@pytest.mark.parametrize("hot, memory", [(20_000, 32 << 20), (20_000, 1 << 12), (2, 32 << 20)])
def test_removal_matches_brute_force(spark, hot, memory):
    texts = corpus(hot)
    ids = [None if i == 5 else (9 if i == 10 else i) for i in range(len(texts))]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in zip(ids, texts)], SCHEMA)
    out = suffix_dedup.report(docs, shard_bytes=20_000, hot_contexts=hot, memory=memory).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    want = sorted((d if d is not None else -1, *x) for d, x in zip(ids, brute(texts)))
    assert got == want


def test_empty_table(spark):
    assert suffix_dedup.report(spark.createDataFrame([], SCHEMA)).count() == 0
