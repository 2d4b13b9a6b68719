"""Odd column names in every operator, and many equal rows."""

from __future__ import annotations

import pytest
from pyspark.sql.types import StringType, StructField

from foliomill.llm import (
    bpe, decontaminate, line_dedup, merkle, packing, phrases, pii, quality, secrets, simhash, suffix_dedup, token_counts,
    toxicity,
)

ODD = ["a.b", "IDS", "N_TOKENS", "Decoded", "N_Lines", "`q`", "Row", "Key", "KEPT", "Score", "spans", "pos", "block", "tree"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"Some words of text {i}, and a line that is shared by all.\nAnother line {i}" * 3, "en", "s", 1) for i in range(5)]
    rows += [(None, None, None, None, None), (3, "", "en", "s", 0)]
    schema = spark.createDataFrame([], SCHEMA).schema
    for name in ODD:
        schema = schema.add(StructField(name, StringType()))
    return spark.createDataFrame([r + ("clash",) * len(ODD) for r in rows], schema).cache()


def reports(spark, docs):
    bench = spark.createDataFrame([(1, "some words of text 1 and a line that is shared", "x")], "item_id bigint, text string, `a.b` string")
    labels = spark.createDataFrame([(1, 0, 1, "x")], "doc_id bigint, quality int, toxic int, `a.b` string")
    yield lambda: toxicity.report(docs, labels)
    yield lambda: simhash.report(docs)
    yield lambda: suffix_dedup.report(docs)
    yield lambda: secrets.report(docs)
    yield lambda: token_counts.report(docs)
    yield lambda: bpe.report(docs)
    yield lambda: pii.report(docs)
    yield lambda: quality.judge(docs)
    yield lambda: decontaminate.report(docs, bench)
    yield lambda: line_dedup.report(docs)
    yield lambda: merkle.report(docs)


@pytest.mark.parametrize("number", range(11))
def test_reports_take_any_names(spark, docs, number):
    assert list(reports(spark, docs))[number]().count() == 7


def test_other_reports_take_any_names(docs):
    assert packing.report(docs).count() >= 7
    assert phrases.report(docs, min_count=2).where("lang = 'en'").count() > 0


def test_operators_carry_any_names(docs):
    def others(out, *made):
        return [c for c in out.columns if c.lower() not in made], [c for c in docs.columns if c.lower() not in made]

    coded = bpe.encode(docs)
    assert coded.columns == [c for c in docs.columns if c != "IDS"] + ["ids"]
    assert {r["a.b"] for r in coded.collect()} == {"clash"}
    back = bpe.decode(coded)
    assert back.columns == [c for c in coded.columns if c != "Decoded"] + ["decoded"] and back.count() == 7
    counted = token_counts.count_tokens(docs)
    assert counted.columns[-3:] == ["n_tokens", "n_crossing", "section_tokens"] and {r["a.b"] for r in counted.collect()} == {"clash"}
    for out, made in ((line_dedup.dedup_lines(docs), ("n_lines", "n_dropped")), (quality.keep_good(docs), ())):
        got, want = others(out, *made)
        assert got == want and all(r["a.b"] == "clash" for r in out.collect())


def test_many_equal_rows_have_short_span_lists(spark):
    text = " ".join(f"word{i * i}" for i in range(60))
    rows = [(None, text)] * 5000 + [(1, "before " + text + " after")]
    found = suffix_dedup.covered_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found.selectExpr("max(size(spans))").first()[0] <= 10
    out = suffix_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id is null").distinct().collect()
    assert len(out) == 1 and out[0].n_removed == out[0].n_bytes == len(text)
