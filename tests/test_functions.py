"""Expressions on small values."""

from __future__ import annotations

import pytest
from foliomill.functions import normalize as N
from foliomill.functions import render as R
from foliomill.functions import responses as M
from foliomill.functions import structure as X
from foliomill.functions import text as T
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def value(spark):
    def of(make, *values):
        names = [f"c{i}" for i in range(len(values))]
        row = spark.createDataFrame([values], ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int'}" for n, v in zip(names, values)))
        return row.select(make(*map(F.col, names)).alias("x")).first()["x"]

    return of


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a  b\tc", "a b c\n"),
        ("hy-\nphen  x\r\n\r\n\r\n\r\ny\r", "hyphen x\n\ny\n"),
        ("keep -\n9", "keep -\n9\n"),
        ("SOURCE CHUNK\nonly this", "only this\n"),
        ("rule SOURCE TEXT\nthat", "that\n"),
        ("", "\n"),
        (None, "\n"),
    ],
)
def test_restoration(value, text, want):
    assert value(T.restore_offline, text) == want


def test_lines_and_slugs(value):
    assert value(T.lines, "a\r\n b \n\n\x0bc d") == ["a", "b", "c", "d"]
    assert value(T.slug, " Été / Two__x ") == "été-two-x"
    assert value(T.ascii_slug, "Été!") == "t"
    assert value(T.slug, "!!") == "item"
    assert value(T.label_parts, "..\\a/ ./b ") == ["a", "b"]
    assert value(lambda x: T.numbered_folder(F.lit(7), x), "Root/Sub dir/Page 1.txt") == "root/sub-dir/0007-page-1-txt"
    assert value(T.folder_label, "a") == "root"


@pytest.mark.parametrize(
    ("text", "blank"),
    [("[unclear] [unclear: hand]", True), (" Blank  page. ", True), ("no text", True), ("text", False), ("[unclear] x", False)],
)
def test_blank_phrases(value, text, blank):
    assert value(T.is_blank, text) is blank


@pytest.mark.parametrize(
    ("line", "want"), [("xii", True), ("Page 12", True), ("civil", True), ("page", False), ("12a", False)]
)
def test_page_markers(value, line, want):
    assert value(T.is_page_marker, line) is want


def test_questions(value):
    assert value(T.question_pages, "see page 3, pp. 7-9 and pages 12/14") == [3, 7, 9, 12, 14]
    assert value(T.question_terms, "What does the X-ray show, x?") == ["x-ray", "show"]
    assert value(T.title_of_question, "one two three four five six") == "One Two Three Four Five..."
    assert value(T.wants_picture, "describe it") is True
    assert value(T.excerpt, "a " * 100).endswith("…")


def test_contents_entries(value):
    lines = ["Contents", "The Beginning ..... 3", "12 The Middle", "Notes | xiv", "xii", "It was the day that he went from the city into the long valley 9"]
    got = [(e["title"], e["page"]) for e in value(X.contents_entries, lines)]
    assert got == [("The Beginning", "3"), ("The Middle", "12"), ("Notes", "xiv")]


def test_table_rows_keep_the_most_frequent_width(value):
    lines = ["item  1", "pear  2", "plum  3  x", "plain line", "a | b | c"]
    rows = value(X.table_rows, lines)
    assert [r["cells"] for r in rows] == [["plum", "3", "x"], ["a", "b", "c"]]
    assert value(X.table_rows, ["one  1"]) == []


def test_footnotes_and_credits(value):
    notes = value(X.footnotes, ["* ) short", "1) a note of some length", "b. another longer note", "ab. no note at all"])
    assert [n["marker"] for n in notes] == ["1", "b"]
    assert value(X.contributors, ["Written BY someone", "written by someone", "none"]) == ["Written BY someone"]
    assert value(X.publishers, ["Small Press, 1900"]) == ["Small Press, 1900"]


@pytest.mark.parametrize(
    ("lines", "kind", "role"),
    [
        (["Table of Contents", "x"], "Book", "contents"),
        (["Bar chart", "a 1", "b 2", "c 3", "d 4"], "General", "chart"),
        (["a  1", "b  2"], "General", "table"),
        (["Works cited"], "Journal article", "references"),
        (["Works cited"], "Book", "bibliography"),
        (["GREAT FIRE IN TOWN", "text"], "Newspaper", "headline"),
        (["12r", "line"], "Manuscript", "folio"),
        (["Dear Sir"], "Letter", "salutation"),
        (["Whereas it is"], "Legal document", "recitals"),
        (["THE TITLE", "by A. Writer"], "Book", "title"),
        (["[image: a | b.png]"], "General", "illustrated"),
        (["plain words here"], "General", "body"),
        ([], "Letter", "body"),
    ],
)
def test_roles(spark, lines, kind, role):
    page = spark.createDataFrame([("\n".join(lines), kind, 1)], "text string, document_type string, page_index int")
    assert X.observe(page).first()["role"] == role


@pytest.mark.parametrize(
    ("reply", "text", "status"),
    [
        ('{"restored_text": " a ", "notes": "n"}', "a", "restored"),
        ('<think>{"x": 1}</think>{"text": "b"}', "b", "restored"),
        ('```json\n{"output": "c"}\n```', "c", "restored"),
        ('{"restored_text": "[unclear]"}', "", "blank"),
        ('{"restored_text": "d \\"q\\" \\n e", "notes": }', 'd "q" \n e', "restored"),
        ("Task: do it", "source", "fallback"),
        ("plain", "plain", "restored"),
    ],
)
def test_replies(spark, reply, text, status):
    rows = spark.createDataFrame([(reply, "source")], "reply string, source_text string")
    got = M.parse_replies(rows).first()
    assert (got["restored_text"], got["status"]) == (text, status)
    assert (got["failure_reason"] == T.BLANK_REASON) is (status == "blank")


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"text": "a\\tb', "a\tb"), ('{"text": "', None), ('{"text": ""', ""), ("{}", None), ('{"text" :\n "x\\\\", "y": "z"}', "x\\"),
        ('{"text": "say \\"hi\\" \\/ \\q\\\\n"}', 'say "hi" / q\\n'), ('{"text": " open \\', "open"), ('{"text": "a" "text": "b"', "a"),
        ('{"text": "' + "x\\n" * 20_000 + '", "e": }', "x\n" * 20_000),
    ],
)
def test_lenient_values(spark, reply, want):
    rows = spark.createDataFrame([(reply,)], "reply string")
    assert rows.select(M.lenient_value(F.col("reply"), "text")).first()[0] == want


def test_decisions(value):
    assert value(M.needs_retry, '{"restored_text": oops') is True
    assert value(M.needs_retry, "[BLOCK 1] role: x") is False
    assert value(M.is_retryable, "HTTP 503") is True and value(M.is_retryable, "Invalid API key: timeout") is False
    assert value(lambda t: M.looks_damaged(t, F.lit("balanced")), "aaaaaaa") is True
    assert value(lambda t: M.looks_damaged(t, F.lit("balanced")), "fine text") is False
    assert value(M.is_fragment, "w " * 30, "w w") is True
    assert value(M.block_texts, "[BLOCK 1] a\n[block #2] b [BLOCK 1]c") == {1: "c", 2: "b"}
    assert value(M.picture_text, "Here is the text:\n```text\nabc\n```") == "abc"


@pytest.mark.parametrize(("given", "want"), [("ON", "translate"), ("same_language", "same-language-cleanup"), ("x", "auto"), (None, "auto")])
def test_translation_modes(value, given, want):
    assert value(N.translation_mode, given) == want


def test_budgets(value):
    assert [value(lambda m: N.budget(m, "verifications"), m) for m in ("fast", "balanced", "quality", "?")] == [0, 1, 4, 1]
    assert value(N.retry_delay, 6) == 8.0
    assert value(N.region_role, " Photo ") == "figure-region" and value(N.region_role, "noise") == "delete"


def test_renderings(value):
    assert value(R.markdown_table, "a | b\n1 | 2") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert value(R.html_table, "x,y\n\"1,5\",2").startswith("<p>") is True
    assert value(R.html_table, "x,y\n1,<2>") == '<table class="data-table"><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>&lt;2&gt;</td></tr></table>'
    assert value(R.text_table, "```csv\na,\"b,c\"\n1,2\n```") == [["a", "b,c"], ["1", "2"]]
    assert [(p["label"], p["value"]) for p in value(R.chart_points, "a: 1\nb\t2,5\nnone")] == [("a", 1.0), ("b", 2.5)]
    kinds = [b["kind"] for b in value(R.structured_blocks, "[image: a | b.png]\n\nxiv\n\na | 1\nb | 2\n\nTHE HEAD\n\nplain text")]
    assert kinds == ["figure-marker", "page-marker", "table", "heading", "paragraph"]
    assert value(R.markdown, "a\f \fb").count("[blank page]") == 1


def test_word_wrap_takes_whole_texts(spark, tmp_path):
    import hashlib
    import random

    from foliomill import catalogue

    def brute(text, width):
        done = []
        for w in text.split():
            if done and len(done[-1]) + 1 + len(w) <= width:
                done[-1] += " " + w
            else:
                done.append(w)
        return done

    rng = random.Random(1)
    parts = ["a", "of", "word", "é😀", "x" * 75, "y" * 76, "z" * 77, "w" * 200, "$|.", "longer-word"]
    texts = ["", " \n ", "one\ntwo", *("".join(rng.choice(parts) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randint(1, 90))) for _ in range(40))]
    texts.append("\n".join("word " * rng.randint(1, 30) for _ in range(20_000)))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["digest"] for r in catalogue.queries()["word_wrap"](spark, str(tmp_path)).collect()}
    assert out == {i: hashlib.md5("\n".join(brute(t, 76)).encode()).hexdigest() for i, t in enumerate(texts)}
    short = spark.createDataFrame([(t,) for t in texts[:43]], "text string")
    for width in (1, 2, 3, 10):
        assert [r["x"] for r in short.select("text", T.wrap(F.col("text"), width).alias("x")).collect()] == [brute(t, width) for t in texts[:43]]
