"""Scans, numbering and assembly over ranges: one run over many ranges gives what one range gives."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zipfile

import pytest
from foliomill.operators import assemble, ordered, publish, retrieval, rollup
from foliomill.sinks import stages
from foliomill.sources import scan
from pyspark.sql import functions as F


@pytest.fixture(params=["one", "many"])
def ranges(spark, request):
    """Whether small ranges are joined to one or kept apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == "one").lower())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def pages(n=300, seed=3):
    rng = random.Random(seed)
    kinds = ["CHAPTER ONE\n\ntext", "", "[unclear]", "- item\n12", "नमस्ते", "a   b   c\nd   e   f\ng   h   i", "see [1] and (2)", None, "plain words here"]
    rows = [("long", i, rng.choice(kinds) if i > 40 else kinds[-1]) for i in range(n)]
    return rows + [("short", 1, "x"), ("short", 2, "y"), (None, 5, "CHAPTER"), (None, 7, "z")]


def test_consistency_scan_over_ranges(spark, ranges):
    out = assemble.consistency_scan(spark.createDataFrame(pages(), "run string, seq int, text string").repartition(5), "run", "seq")
    rows = sorted(out.collect(), key=lambda r: (r.run or "", r.seq))
    lone = [r for r in rows if r.run == "long"]
    # A run cut by hand: the state of a page is what a scan of the pages before it alone ends with.
    for at in (0, 1, 60, 150, 299):
        before = [p for p in pages() if p[0] == "long" and p[1] < at] + [("long", at, "")]
        alone = assemble.consistency_scan(spark.createDataFrame(before, "run string, seq int, text string").coalesce(1), "run", "seq")
        assert alone.where(F.col("seq") == at).first() == lone[at]
    assert [r.observed_pages for r in rows if r.run is None] == [0, 1] and lone[-1].observed_pages > 100
    used = {r for r in ordered.ranged(spark.createDataFrame(pages(), "run string, seq int, text string"), ["run", "seq"]).select("_range").distinct().collect()}
    assert (len(used) > 3) == (ranges == "many")


def test_no_window_over_a_run(spark):
    rows = spark.createDataFrame([("a", i, i % 2 == 0, "t") for i in range(50)], "run string, seq int, damaged boolean, text string")
    for out in (assemble.consistency_scan(rows, "run", "seq"), assemble.review_budget(rows, "run", "seq", "damaged", F.lit(3))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        # No window over the rows of a run alone: the scan over ranges is read as a written table.
        windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
        assert windows and all("_range" in w for w in windows)


def test_review_budget_over_ranges(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.random() < 0.3) for i in range(400)] + [("c", 1, None)]
    out = assemble.review_budget(spark.createDataFrame(rows, "run string, seq int, damaged boolean"), "run", "seq", "damaged", F.lit(20)).collect()
    spent, want = {}, []
    for run, seq, damaged in rows:
        spent[run] = spent.get(run, 0) + bool(damaged)
        want.append((run, seq, damaged, None if damaged is None else damaged and spent[run] <= 20))
    assert sorted(map(tuple, out), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_numbers_over_ranges(spark, ranges):
    rows = [(f"k{i % 3}" if i % 5 else None, i // 2, i % 4) for i in range(500)]
    out = ordered.numbered(spark.createDataFrame(rows, "k string, o int, w int"), ["k"], ["o"], "n", F.col("w")).collect()
    held = {}
    for r in out:
        held.setdefault(r.k, []).append(r)
    for own in held.values():
        at = 0
        for r in sorted(own, key=lambda r: (r.n, r.n + r.w, r.o)):
            assert r.n == at
            at += r.w
        assert [r.o for r in sorted(own, key=lambda r: (r.n, r.o))] == sorted(r.o for r in own)
    sources = retrieval.number_sources([spark.createDataFrame([(i,) for i in range(90)], "o int"), spark.createDataFrame([(i,) for i in range(10)], "o int")], ["o"])
    assert [(r.source_no, r.o, r.source_id) for r in sources.orderBy("source_no").collect()] == [(n + 1, n if n < 90 else n - 90, f"S{n + 1}") for n in range(100)]


@pytest.mark.parametrize("part_bytes", [64, 1 << 20])
def test_parts_make_the_whole_text(spark, ranges, part_bytes):
    rng = random.Random(2)
    rows = [(rng.choice(["big", "big", "big", "small"]), i, rng.choice(["", "é" * rng.randint(1, 40), "word " * 30, "x"])) for i in range(300)]
    rows += [(None, 1, "null key"), ("empty", 1, None)]
    pieces = ordered.parts(spark.createDataFrame(rows, "k string, o int, t string"), ["k"], ["o"], "t", "\n--\n", part_bytes)
    want = {}
    for k, _, t in rows:
        want.setdefault(k, []).append(t or "")
    found = {}
    for r in sorted(pieces.collect(), key=lambda r: r.part):
        raw = found.setdefault(r.k, bytearray())
        assert r.offset == len(raw) and r.length == len(r.text.encode())
        raw += r.text.encode()
    assert {k: bytes(v).decode() for k, v in found.items()} == {k: "\n--\n".join(v) for k, v in want.items()}
    assert (pieces.where("k = 'big'").count() > 10) == (part_bytes == 64)
    for r in ordered.digests(pieces, ["k"]).collect():
        text = "\n--\n".join(want[r.k])
        assert (r.rows, r.chars, r.digest) == (len(want[r.k]), len(text), hashlib.md5(text.encode()).hexdigest())


def test_folder_texts_are_what_folders_combine(spark):
    rows = spark.createDataFrame([(f"a/{'b/' * (i % 3)}{i:03}", f"text {i}") for i in range(40)], "path string, text string")
    whole = {r.folder: (r.parts, hashlib.md5(r.combined.encode()).hexdigest()) for r in rollup.folder_combine(rows).collect()}
    assert {r.folder: (r.rows, r.digest) for r in ordered.digests(rollup.folder_texts(rows), ["folder"]).collect()} == whole


def test_run_parts_are_what_records_hold(spark):
    chunks = [("r1", 1, "one", 4, 0.5), ("r1", 2, " ", 5, 0.9), ("r1", 3, "three", 6, None), ("r2", 1, None, 1, 0.1)]
    frame = spark.createDataFrame(chunks, "label string, seq int, text string, page_number int, confidence double")
    sources, texts = scan.run_parts(frame, ["label"], "seq")
    got = {(r.label, r.kind, r.part): (r.page_number, r.text) for r in sources.collect()}
    assert got == {("r1", "page-record", 0): (4, None), ("r1", "chunk", 1): (4, "one"), ("r1", "chunk", 3): (6, "three")}
    assert [(r.label, r.text) for r in texts.collect()] == [("r1", "one\n\nthree")]
    fields = F.struct(F.lit(None).cast("string").alias("translated_text"), F.col("text").alias("restored_text"), F.lit("").alias("text"), "page_number", "confidence")
    records = frame.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", fields.alias("c")))), lambda x: x["c"]).alias("chunks")).withColumn("source_index", F.lit(1))
    held = {(r.label, r.kind, r.part): (r.page_number, r.text) for r in scan.run_sources(records).collect()}
    assert held == got | {("r1", "page-record", 0): (4, "one\n\nthree")}


def test_manifest_lines(spark):
    records = spark.createDataFrame([("a", i, f"s{i}", "failed" if i == 2 else "ok", "") for i in range(5)], "run string, source_index int, label string, status string, failure_reason string")
    lines = {r.line: r.json for r in stages.manifest_lines(records).collect()}
    assert lines[0] == '{"sources":5,"failed":1}' and sorted(lines) == list(range(6)) and '"label":"s3"' in lines[4]
    assert stages.manifest(records).first().manifest == lines[0]


def test_unit_summary_is_bounded_and_ordered(spark):
    rows = [(1, i, f"role{i}", [f"h{i}-{k}" for k in range(i % 4)], [], [("e", "1")] if i == 3 else [], []) for i in range(400)] + [(2, 0, "only", [], [], [], [])]
    schema = "doc int, page_index int, role string, section_headings array<string>, title_candidates array<string>, contents_entries array<struct<t:string,p:string>>, footnotes array<string>"
    out = {r.doc: r for r in publish.unit_summary(spark.createDataFrame(rows, schema).repartition(4), ["doc"]).collect()}
    assert out[1].role == "role0" and out[1].section_headings == [h for r in rows[:400] for h in r[3]][:120]
    assert len(out[1].contents_entries) == 1 and out[2].role == "only" and out[2].section_headings == []


def test_members_that_need_a_renderer_fail_with_a_reason(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b.pdf", b"%PDF")
        z.writestr("a.txt", "hello")
        z.writestr("c.txt", "")
    members = scan.archive_members(spark.createDataFrame([("z.zip", bytearray(out.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary"))
    failed = {(r.path, r.member, r.status, r.failure_reason[:10]) for r in scan.archive_failures(members).collect()}
    assert failed == {("z.zip", "b.pdf", "failed", "page rende"), ("bad.zip", None, "failed", "unreadable")}
    assert [(r.member, r.chunk_index, r.text) for r in scan.archive_pieces(members).orderBy("chunk_index").collect()] == [("a.txt", 1, "hello"), ("c.txt", 2, None)]
