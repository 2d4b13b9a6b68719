"""Relational operators, sources, sinks, plans and streaming on small tables."""

from __future__ import annotations

import io
import time
import zipfile

import numpy as np
import pytest
from foliomill.operators import assemble, chunking, layout, publish, retrieval, rollup
from foliomill.plans import answer, providers, run
from foliomill.sinks import formats
from foliomill.sources import discover, scan
from foliomill.streaming import incremental
from pyspark.sql import functions as F


def greedy(parts, limit, gap):
    out, now = [], []
    for p in parts:
        if now and len(gap.join([*now, p])) > limit:
            out.append(gap.join(now))
            now = []
        now.append(p)
    return out + ([gap.join(now)] if now else [])


@pytest.mark.parametrize("limit", [10, 25, 60])
def test_chunks(spark, limit):
    rng = np.random.default_rng(limit)
    blocks = ["\n".join("w" * int(n) for n in rng.integers(1, 30, rng.integers(1, 6))) for _ in range(30)]
    text = "\n\n".join(blocks)
    want, run_ = [], []
    for b in blocks:
        if len(b) > limit:
            want += greedy(run_, limit, "\n\n") + greedy(b.split("\n"), limit, "\n")
            run_ = []
        else:
            run_.append(b)
    want += greedy(run_, limit, "\n\n")
    got = spark.createDataFrame([(text,)], "t string").select(chunking.split_chunks(F.col("t"), limit).alias("c")).first()["c"]
    assert got == want
    empty = spark.createDataFrame([(None,), (" \n ",), ("short",)], "t string").select(chunking.split_chunks(F.col("t")).alias("c"))
    assert [r["c"] for r in empty.collect()] == [[], [], ["short"]]


def test_overlap_suppression():
    boxes = np.array([[10, 10, 20, 20], [0, 0, 100, 100], [200, 200, 220, 220]])
    assert layout.suppress_overlaps(boxes).tolist() == [1, 2]


def test_grid_finds_two_bars(spark):
    gray = np.full((720, 560), 255, np.uint8)
    gray[100:300:2, 60:200] = 0
    gray[400:600:2, 300:500] = 0
    pages = spark.createDataFrame([(1, 560, 720, bytearray(gray.tobytes()))], "page bigint, width int, height int, gray binary")
    found = layout.native_blocks(pages).orderBy("top").collect()
    assert len(found) == 2 and found[0]["left"] <= 60 and found[1]["right"] >= 500


def blocks_frame(spark, rows):
    return spark.createDataFrame(rows, "page bigint, block int, left int, top int, right int, bottom int, page_width int, page_height int, dark_ratio double, mid_ratio double")


def test_columns_and_reading_order(spark):
    rows = [(1, n, 50 + 500 * (n % 2), 600 + 100 * n, 450 + 500 * (n % 2), 660 + 100 * n, 1000, 1500, 0.01, 0.0) for n in range(8)]
    blocks = layout.classify(blocks_frame(spark, rows))
    counts = layout.page_flow(layout.column_counts(blocks))
    assert counts.select("columns", "flow").first() == (2, "multi-column")
    order = layout.reading_order(blocks, counts).orderBy("reading_order").collect()
    assert [r["block"] for r in order] == [0, 2, 4, 6, 1, 3, 5, 7]


def test_merges_contract_components(spark):
    rows = [(1, n, n * 10, 0, n * 10 + 5, 10, 100, 100, 0.2, 0.0) for n in range(1, 6)]
    blocks = layout.classify(blocks_frame(spark, rows))
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 4)], "page bigint, a int, b int")
    out = layout.merge_blocks(blocks, pairs).orderBy("block").collect()
    assert [(r["block"], r["left"], r["right"]) for r in out] == [(1, 10, 45), (2, 30, 35), (3, 50, 55)]


def test_text_allocation(spark):
    blocks = spark.createDataFrame([(1, 1, "title-region"), (1, 2, "table-region"), (1, 3, "figure-region"), (1, 4, "text-region"), (1, 5, "table-region")], "page bigint, reading_order int, role string")
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "```csv\n1,2\n```"), (1, 2, "b"), (1, 3, "c")], "page bigint, pos int, segment string")
    out = {r["reading_order"]: r["extracted_text"] for r in assemble.allocate_texts(blocks, parts).collect()}
    assert out == {1: "a", 2: "```csv\n1,2\n```", 3: None, 4: "b\n\nc", 5: None}


def test_folder_rollup(spark):
    rows = spark.createDataFrame([("a/b/x", "1"), ("a/c", "2"), ("top", "3"), ("a/b/y", " ")], "path string, text string")
    out = {r["folder"]: (r["parts"], r["combined"]) for r in rollup.folder_combine(rows).collect()}
    assert out == {"a": (2, "1\n\n\f\n\n2"), "a/b": (1, "1")}


def test_priority_union_and_retries(spark):
    one, two = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a")], [(1, "b"), (2, "c")]))
    assert sorted(r["v"] for r in assemble.priority_union([one, two], ["k"]).collect()) == ["a", "c"]
    assert [r["v"] for r in assemble.priority_union([one.limit(0), two]).orderBy("v").collect()] == ["b", "c"]
    base = spark.createDataFrame([(1, "x", "bad"), (2, "y", "bad")], "k int, t string, failure_reason string")
    again = spark.createDataFrame([(1, "X", ""), (2, "Y", "still")], "k int, t string, failure_reason string")
    out = assemble.retry_merge(base, again, ["k"], ["t", "failure_reason"]).orderBy("k").collect()
    assert [(r["t"], r["failure_reason"], r["retried"]) for r in out] == [("X", "", True), ("y", "bad", False)]


def test_consistency_state_sees_only_earlier_chunks(spark):
    rows = [(1, 1, "CHAPTER ONE\n\ntext"), (1, 2, "[unclear]"), (1, 3, "- item\n12"), (1, 4, "नमस्ते"), (2, 1, "x")]
    out = assemble.consistency_scan(spark.createDataFrame(rows, "run int, seq int, text string"), "run", "seq").orderBy("run", "seq").collect()
    assert [r["observed_pages"] for r in out] == [0, 1, 1, 2, 0]
    assert out[1]["heading_style"] == "short uppercase headings preserved" and out[0]["heading_style"] == ""
    assert out[3]["layout_notes"] == ["preserve list item breaks"] and out[3]["recent_text_excerpt"] == "- item 12"
    assert out[3]["encountered_scripts"] == ["Latin"]


def test_review_budget(spark):
    rows = spark.createDataFrame([(1, n, n % 2 == 0) for n in range(6)], "run int, seq int, damaged boolean")
    out = assemble.review_budget(rows, "run", "seq", "damaged", F.lit(2)).orderBy("seq").collect()
    assert [r["seq"] for r in out if r["reviewed"]] == [0, 2]


@pytest.fixture()
def sources(spark):
    rows = [(n, f"S{n}", f"page {n}", f"text of {'harbour ' * (n % 3)}", "page-record", 0.5, n) for n in range(1, 13)]
    return spark.createDataFrame(rows, "source_no bigint, source_id string, label string, text string, kind string, confidence double, page_number int")


def test_retrieval(sources):
    assert [r["source_id"] for r in retrieval.search(sources, "the harbour").collect()] == ["S11", "S2", "S5", "S8", "S1", "S10", "S4", "S7"]
    assert [r["source_id"] for r in retrieval.select_relevant(sources, "what is on page 6?").collect()] == ["S6", "S5", "S7"]
    assert retrieval.select_relevant(sources, "zzz").count() == 10
    assert [r["source_id"] for r in retrieval.pinned(sources, ["s3", " S1"]).collect()] == ["S1", "S3"]
    with pytest.raises(ValueError):
        retrieval.pinned(sources, ["S99"])
    numbered = retrieval.number_sources([sources.select("label"), sources.select("label")], ["label"])
    assert sorted(r["source_no"] for r in numbered.collect()) == list(range(1, 25))


def test_answers(sources):
    row = answer.ask(sources, "page 6?", pinned=["S4"], turns=[("q", "a")], notes=["n"]).first()
    assert "[S4] page 4" in row["prompt"] and row["usage"]["total_tokens"] == 30


def test_providers_keep_errors_in_rows(spark):
    calls = {"flaky": 0}

    def provider(text, instruction):
        if "bad" in text:
            raise RuntimeError("HTTP 400 bad request")
        return '{"restored_text": "' + text.split("\n")[-1].upper() + '"}', {"total_tokens": 3}

    providers.register("shout", provider)
    docs = spark.createDataFrame([(1, "fine"), (2, "bad one")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in run.restore(docs, provider="shout").collect()}
    assert out[1]["restored_text"] == "FINE" and out[1]["status"] == "restored"
    assert out[2]["status"] == "partial" and out[2]["failure_reason"] == "model returned malformed output"
    assert "shout" in providers.available() and calls == {"flaky": 0}


def test_discovery_and_manifests(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.md", "c.bin"):
        (tmp_path / "in" / name).write_text("x")
    found, missing = discover.discover(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "a.txt"), str(tmp_path / "none")])
    rows = {r["label"]: (r["status"], r["kind"]) for r in found.collect()}
    assert rows == {"in/a.txt": ("ok", "Text/OCR"), "in/sub/b.md": ("ok", "Text/OCR"), "in/c.bin": ("unsupported", None)}
    assert missing == [str(tmp_path / "none")]
    (tmp_path / "m.csv").write_text("path,file\nin\\a.txt,\n,/abs/b\n")
    (tmp_path / "m.manifest.json").write_text('{"inputs": ["in/a.txt", {"path": "s3://x/y"}]}')
    assert [r["path"] for r in discover.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [f"{tmp_path}/in/a.txt", "/abs/b"]
    assert [r["path"] for r in discover.read_manifest(spark, str(tmp_path / "m.manifest.json")).collect()] == [f"{tmp_path}/in/a.txt", "s3://x/y"]
    assert {r["text"] for r in scan.text_files(spark, str(tmp_path / "in")).collect()} == {"x"}


def test_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b/t.txt", "hello")
        z.writestr("a/../../p.png", b"\x89PNG")
        z.writestr("c.exe", b"x")
    rows = spark.createDataFrame([("z.zip", bytearray(out.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    members = scan.archive_members(rows)
    assert sorted((r["path"], r["member"], r["kind"]) for r in members.where("kind <> 'error'").collect()) == [("z.zip", "a/p.png", "image"), ("z.zip", "b/t.txt", "text"), ("z.zip", "c.exe", "other")]
    assert members.where("kind = 'error'").count() == 1
    assert [(r["chunk_index"], r["text"]) for r in scan.archive_pieces(members).orderBy("chunk_index").collect()] == [(1, None), (2, "hello")]


def test_exports(spark):
    docs = spark.createDataFrame([(1, "One\n\nTwo\fa | b\n1 | 2", "T", "Book", {"k": "v", "_x": "y"})], "doc_id bigint, text string, title string, document_type string, metadata map<string,string>")
    out = {r["format"]: r for r in formats.export(docs, list(formats.FORMATS)).collect()}
    assert set(out) == set(formats.FORMATS) - set(formats.SIDECARS)
    assert bytes(out["jsonl"]["content"]).decode().count("\n") == 2
    assert "_x" not in bytes(out["json"]["content"]).decode() and "<table" in bytes(out["html"]["content"]).decode()
    assert not out["searchable-pdf"]["available"] and out["searchable-pdf"]["content"] is None
    book = zipfile.ZipFile(io.BytesIO(bytes(out["epub"]["content"])))
    assert book.namelist()[0] == "mimetype" and book.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
    assert b"One" in zipfile.ZipFile(io.BytesIO(bytes(out["docx"]["content"]))).read("word/document.xml")
    assert [r["format"] for r in formats.export(docs, ["nonsense"]).collect()] == ["txt"]


def test_sidecars(spark):
    rows = spark.createDataFrame([(1, 1, "title-region", 0, 0, 10, 10, 100, 150, "A & B"), (1, 2, "table-region", 0, 20, 10, 30, 100, 150, "x")], "page bigint, reading_order int, role string, left int, top int, right int, bottom int, page_width int, page_height int, extracted_text string")
    made = {f: formats.sidecars(rows, f).first()["content"] for f in formats.SIDECARS}
    assert 'type="heading"' in made["pagexml"] and "A &amp; B" in made["pagexml"] and "TableRegion" in made["pagexml"] and ">x<" not in made["pagexml"]
    assert 'HEIGHT="20"' in made["alto"] and 'bbox 0 20 10 30' in made["hocr"]


def test_resume_and_failed_inputs(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    done = spark.createDataFrame([(1, "restored", ""), (2, "partial", "x"), (3, "restored", "x")], "doc_id bigint, status string, failure_reason string")
    assert [r["doc_id"] for r in run.resume(docs, done).collect()] == [2]
    assert [r["doc_id"] for r in run.failed_inputs(done).collect()] == [2]


def test_stream_commits_each_file_once(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for batch, text in enumerate(("first  text", "second")):
        spark.createDataFrame([(batch, text)], "doc_id bigint, text string").write.mode("append").parquet(source)
        incremental.restore_stream(spark, source, target, marks).awaitTermination()
        time.sleep(0.1)
    assert sorted(r["restored_text"] for r in spark.read.parquet(target).collect()) == ["first text", "second"]


def test_running_state_over_batches(spark, tmp_path):
    source = str(tmp_path / "chunks")
    schema = "run string, seq bigint, text string"
    stream = incremental.running_state(spark.readStream.schema(schema).parquet(source) if (spark.createDataFrame([("a", 1, "CHAPTER\ntext")], schema).write.parquet(source) or True) else None)
    spark.createDataFrame([("a", 2, "- item"), ("a", 3, "[unclear]")], schema).write.mode("append").parquet(source)
    query = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("states").orderBy(F.desc("observed_pages")).first()
    assert last["observed_pages"] == 2 and last["heading_style"] == "short uppercase headings preserved" and last["scripts"] == ["Latin"]


def test_settings_limits_presets(tmp_path):
    from foliomill.plans import settings as S

    plain = S.Settings()
    assert (plain.context(), plain.answer(), plain.timeout()) == (16384, 16384, None)
    small = S.Settings(context_window=10, generation_limit="5", request_timeout="x", mode="quality")
    assert (small.context(), small.answer(), small.timeout()) == (2048, 1024, 480.0)
    assert S.Settings(request_timeout=0).timeout() is None and S.Settings(context_window="?").context() == 16384
    assert S.Settings().bounded().context() == 8192 and S.Settings(context_window=4000, generation_limit=9000).bounded() == S.Settings(context_window=4000, generation_limit=4096)
    (tmp_path / "c.toml").write_text('model = "m"\nmode = "fast"\nother = 1\n')
    assert S.load_settings(str(tmp_path / "c.toml"), {"FOLIOMILL_MODE": "quality"}) == S.Settings(model="m", mode="quality")
    assert S.load_settings(None, {}) == plain
    folder = str(tmp_path / "own")
    path = S.install_instruction(folder)
    assert S.load_instruction(folder=folder) == S.load_instruction()
    open(path, "w").write("mine")
    assert S.load_instruction(folder=folder) == "mine" and S.install_instruction(folder) == path and S.load_instruction(folder=folder) == "mine"
    with pytest.raises(KeyError):
        S.load_instruction("unknown")


def test_chat_sessions(spark, tmp_path):
    from foliomill.plans import sessions

    path = str(tmp_path / "s1.json")
    sessions.save(spark, path, [(f"q{i}", f"a{i}") for i in range(30)], [" n ", ""], {"k": "v"})
    turns, notes, metadata = sessions.load(spark, path)
    assert turns == [(f"q{i}", f"a{i}") for i in range(6, 30)] and notes == ["n"] and metadata == {"k": "v"}
    time.sleep(1.1)
    sessions.save(spark, str(tmp_path / "s0.json"), [("q", " "), ("q", "a")])
    (tmp_path / "bad.json").write_text("{no")
    listed = [r["path"].rsplit("/", 1)[1] for r in sessions.latest_first(spark, str(tmp_path)).collect()]
    assert set(listed) == {"s0.json", "s1.json", "bad.json"} and listed.index("s0.json") < listed.index("s1.json")
    assert sessions.load(spark, str(tmp_path / "s0.json"))[0] == [("q", "a")] and sessions.load(spark, str(tmp_path / "bad.json")) == ([], [], {})
    assert sessions.delete(spark, path) and not sessions.delete(spark, path) and sessions.load(spark, path) == ([], [], {})


def test_progress_of_streams(spark, tmp_path):
    from foliomill.plans import settings

    told = []
    listener = settings.watch(spark, lambda *x: told.append(x))
    try:
        spark.createDataFrame([(1, "first")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
        incremental.restore_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
        for _ in range(50):
            if any(x[0] == "done" for x in told):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [x[0] for x in told][0] == "started" and ("done" in {x[0] for x in told}) and sum(x[2] for x in told) == 1


def test_manifests_are_followed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "in" / "d.txt").write_text("x")
    (tmp_path / "in" / "plain.json").write_text('{"text": "no manifest"}')
    (tmp_path / "in" / "list.csv").write_text("path\n../a.txt\n../more.manifest.json\n")
    (tmp_path / "more.manifest.json").write_text('{"files": ["b.txt", "in/list.csv", "none.txt"]}')
    found, missing = discover.discover(spark, [str(tmp_path / "in"), str(tmp_path / "c.txt")])
    names = sorted(r["path"].rsplit("/", 1)[1] for r in found.collect())
    assert names == ["a.txt", "b.txt", "c.txt", "d.txt", "plain.json"]
    assert [m.rsplit("/", 1)[1] for m in missing] == ["none.txt"]


def test_header_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00" * 8 + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xc0\x00\x11\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\x03" * 9
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate((png, jpeg, b"\xff\xd8", b"GIF"))], "i int, content binary")
    got = [r["s"] for r in rows.select("i", scan.header_size(F.col("content")).alias("s")).orderBy("i").collect()]
    assert [tuple(x) if x else None for x in got] == [(640, 480), (200, 300), None, None]


def test_published_bodies(spark):
    blocks = spark.createDataFrame(
        [
            (1, 1, "title-region", 0, 0, 9, 9, " A & B "), (1, 2, "figure-region", 0, 10, 9, 20, "cap"), (1, 3, "table-region", 0, 0, 1, 1, "a | b\n1 | 2"),
            (1, 4, "list-region", 0, 0, 1, 1, "- x\n• y"), (1, 5, "running-header-or-footer", 0, 0, 1, 1, "7"), (1, 6, "text-region", 0, 0, 1, 1, "p's\nq\n\nr"),
            (1, 7, "text-region", 0, 0, 1, 1, "  "), (2, 1, "figure-region", 5, 5, 6, 6, "only text"), (2, 2, "equation-region", 0, 0, 1, 1, "e=1"),
        ],
        "page bigint, reading_order int, role string, left int, top int, right int, bottom int, extracted_text string",
    )
    assets = spark.createDataFrame([(1, 1, "x.png", [1, 1, 1, 1], 9), (1, 2, "y.png", [0, 10, 9, 20], 8), (1, 3, "z.png", None, 2)], "page bigint, pos int, path string, bbox array<int>, figure_index int")
    both = publish.with_assets(blocks, assets)
    md = {r["page"]: r["body"] for r in publish.layout_bodies(both, "markdown").collect()}
    assert md[1] == "## A & B\n\n![](y.png)\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n- x\n- y\n\n<!-- 7 -->\n\np's\nq\n\nr"
    assert md[2] == "> [Image: only text]\n\ne=1"
    html = {r["page"]: r["body"] for r in publish.layout_bodies(both, "html").collect()}
    assert html[1].split("\n")[0] == "<h2>A &amp; B</h2>" and "<li>x</li><li>y</li>" in html[1] and "<p>p&#x27;s<br />\nq</p>\n<p>r</p>" in html[1]
    assert html[2] == '<figure class="figure-marker"><figcaption>only text</figcaption></figure>\n<p class="equation">e=1</p>'


def test_units_and_page_bodies(spark):
    schema = "doc int, page_index int, role string, layout string, section_headings array<string>, title_candidates array<string>, contents_entries array<struct<title:string,page:string>>, footnotes array<struct<marker:string,text:string>>, text string"
    rows = [
        (1, 1, "chapter", "single-flow", [" ", "Chapter I"], ["T"], [], [("1", "a note")], "Chapter I\n\nbody"), (1, 2, "preface", "single-flow", [], ["My Preface"], [], [], "words"),
        (2, 1, "contents", "list-like", [], [], [("One ", "1"), ("Two", "")], [], "plain"), (2, 5, "title", "x", ["Late"], [], [], [], "x"),
    ]
    units = spark.createDataFrame(rows, schema)
    pages = units.select("doc", "page_index", "text").where("page_index < 5")
    joined = publish.with_units(pages, units, "doc")
    heading = publish.unit_heading(F.col("unit.section_headings"), F.col("unit.title_candidates"))
    unit = publish.markdown_unit(F.col("unit.role"), heading, F.col("unit.contents_entries"), F.col("unit.footnotes"))
    body = publish.page_body(F.col("text"), F.col("unit.role"), heading, unit, "\n\n")
    got = {(r["doc"], r["page_index"]): r["b"] for r in joined.select("doc", "page_index", body.alias("b")).collect()}
    assert got == {(1, 1): "Chapter I\n\nbody", (1, 2): "## My Preface\n\nwords", (2, 1): "## Contents\n\n- One 1\n- Two\n\nplain"}
    lone = publish.with_units(pages.where("doc = 1 and page_index = 1").withColumn("page_index", F.lit(9)), units, "doc").first()["unit"]
    assert lone["role"] == "chapter" and lone["section_headings"] == [" ", "Chapter I"] and len(lone["footnotes"]) == 1


def test_markers_go_beside_related_text(spark):
    said = "This paragraph is certainly longer than forty characters, is it not?"
    texts = spark.createDataFrame([(1, f"first\n\n{said}\n\n[image: old | a/o.png]"), (2, ""), (3, "one")], "doc int, text string")
    assets = spark.createDataFrame(
        [(1, 1, "a\\o.png", "old", "", "", None, None, ""), (1, 2, "a/p.png", "map (2)", said.upper(), "bottom", None, None, ""), (2, 1, "q.png", "", "", "", None, None, ""), (3, 1, " ", "x", "", "", None, None, ""), (3, 2, "w.png", "w", "", "", None, None, "wide")],
        "doc int, pos int, path string, label string, related string, zone string, top double, bottom double, width_hint string",
    )
    got = {r["doc"]: r["text"] for r in publish.insert_markers(texts, assets, "doc").collect()}
    assert got[1] == f"first\n\n{said}\n\n[image: map | a/p.png]\n\n[image: old | a/o.png]"
    assert got[2] == "[image: figure | q.png]" and got[3] == "[image: w | w.png]\n\none"
