"""The Merkle manifest against plain Python, level by level."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from foliomill.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, `a.b` string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, more=0):
    doc, text, lang, source, chars = row[:5]
    chars = None if chars is None else chars + more
    said = [None if v is None else str(v) for v in (doc, source, lang, chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in said))


def tree(nodes, fanout):
    """The root, and for each node its siblings before and after at every level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            at[k] = i // fanout
        now = [sha("".join(r)) for r in runs]
    return now[0], paths


def expected(rows, fanout):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    roots, inner = [], {}
    for lang in order:
        held = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in held], fanout)
        roots.append(root)
        inner[lang] = list(zip(held, paths))
    root, outer = tree(roots, fanout)
    want = []
    for lang, subroot, above in zip(order, roots, outer):
        for row, below in inner[lang]:
            path = below + above
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, int(chosen))
            for a, b in path:
                node = sha(a + node + b)
            want.append((row[0], leaf(row), subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(want, key=repr)


def corpus(n=300):
    rows = [
        (i, f"Text ü {i}" * (i % 5), ["en", "en", "en", "de", None, ""][i % 6], None if i % 4 else "s", None if i % 9 == 0 else i)
        for i in range(n)
    ]
    rows += [rows[3], rows[3], (None, "x", "en", "s", 1), (None, None, "en", None, None), (7, "", "only", "", 0), (7, "y", "en", "", 0)]
    rows.append((8, "long " * 100_000, "é", "s", 9223372036854775807))
    return [r + ("clash", "clash", "clash") for r in rows]


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 9), (5, 2)])
def test_merkle(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", block)
    rows = corpus()
    out = merkle.report(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got == expected(rows, fanout)
    changed = {r[0] for r in got if not r[-1]}
    assert changed and all(zlib.crc32(str(d).encode()) % 7 == 0 for d in changed)


def test_merkle_of_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "t", "en", "s", 1, "", "", "")], SCHEMA)
    (row,) = merkle.report(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    assert merkle.report(one.where("false")).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(one, 1)
