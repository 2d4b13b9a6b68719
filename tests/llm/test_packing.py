"""Packing: ids as the library gives them, pieces without gaps, and the cheapest cuts by brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from foliomill.llm import packing
from foliomill.llm.bpe import default_path

SCHEMA = "doc_id bigint, text string, length string, ids string, `a.b` string"
ODD = [
    None, "", " \n\t", "Word", "it's we'll 'tis o'clock's don't", "x.y, (z). \"Quoted!\" 3.14 a... b?!", "ÜBER naïve Ångström e\u0301 ﬁ",
    "ΟΔΥΣΣΕΥΣ ΣΑΣ", "a\x1cb c\x1fd", "<|startoftext|> hi <|endoftext|>", "<|STARTOFTEXT|>", "日本語 テキスト ½ ² Ⅷ ７", "\u200bzero\u00a0nbsp\u3000wide",
    "İstanbul ǅ", "a" * 5000, "no end " * 3000, "🙂🙂 👍🏽!", "_under_score_, _x.", "tab\tsep\x0bvt\x0cff\rcr",
]


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(default_path())
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(known, text):
    return [*known.encode(text or "", add_special_tokens=False).ids, 1]


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, t, "x", "x", "x") for i, t in enumerate(ODD)]
    for i in range(60):
        said = " ".join(rng.choice(["the", "of", "Naïve", "table", "zq", "x.y", "end.", "stop!", "w1,"]) for _ in range(rng.randint(0, 900)))
        rows.append((100 + i, said, "x", "x", "x"))
    return rows + [rows[-1], rows[-1], (None, "no id at all.", "x", "x", "x")]


def test_encoder_equals_the_library():
    texts = [t or "" for t in ODD] + [r[1] or "" for r in corpus()]
    known, ours = library(), packing.Encoder(default_path())
    for _ in range(2):
        ids, ends = ours.encode(texts)
        assert [p.tolist() for p in np.split(ids, ends[:-1])] == [ids_of(known, t) for t in texts]


@pytest.mark.parametrize(("length", "stretch", "parts"), [(2048, 1 << 20, 3), (64, 1000, 1)])
def test_packing(spark, length, stretch, parts, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    known, rows = library(), corpus()
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).repartition(parts) if parts > 1 else spark.createDataFrame(rows, SCHEMA).coalesce(1)
    out = packing.report(docs, length=length)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    got = out.collect()
    want = {}
    for d, t, *_ in rows:
        want.setdefault(d, []).append(np.array(ids_of(known, t), "<u4"))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == want.keys()
    for d, held in pieces.items():
        ids = want[d][0]
        for r in held:
            assert r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        # Copies of a row have one set of pieces each, of which none overlap.
        assert sum(r.length for r in held) == len(ids) * len(want[d])
        if len(want[d]) == 1:
            at = 0
            for r in sorted(held, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    padding = total = 0
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding < 0.05 * total


def test_order_is_kept(spark):
    rows = [(i, "one two three. " * (i % 50), "", "", "") for i in range(200)]
    got = packing.report(spark.createDataFrame(rows, SCHEMA).coalesce(1)).orderBy("sequence_id", "offset").collect()
    assert [(r.doc_id, r.start) for r in got] == sorted((r.doc_id, r.start) for r in got)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_POWER", 16)
    rng = random.Random(seed)
    length, at, cost = 16, [0], [0]
    for _ in range(rng.randint(1, 40)):
        at.append(at[-1] + rng.randint(1, 9))
        cost.append(rng.choice([0, 0, packing.SENTENCE, packing.INSIDE]))
    best = {0: 0}
    for j in range(1, len(at)):
        each = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= length:
                each.append(best[i] + (0 if n & (n - 1) == 0 else length - n))
        best[j] = min(each) + cost[j] + packing.SEQUENCE
    for last in (True, False):
        found = packing.cuts(np.array(at), np.array(cost), length, last).tolist()
        paid, before = 0, 0
        for x in found:
            n = x - before
            assert 0 < n <= length
            paid += (0 if n & (n - 1) == 0 else length - n) + cost[at.index(x)] + packing.SEQUENCE
            before = x
        if last:
            assert found[-1] == at[-1] and paid == best[len(at) - 1]
        else:
            near = [j for j in range(1, len(at)) if at[j] >= at[-1] - length]
            assert paid == min(best[j] for j in near)


def test_packing_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.report(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, length=0)
