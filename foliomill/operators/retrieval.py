"""Retrieval over text sources: search, relevance, pinned citations, page bands, chat history."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import question_pages, question_terms, text_of
from ..sinks.shared import sent, written
from .ordered import PLACE, RANGE, ranged

SOURCES_KEPT = 10
KIND_BONUS = {"page-record": 22, "raw-visual": 14, "chunk": 6}




def _parsed(sources: DataFrame, question: str) -> tuple[list[str], list[int]]:
    spark = sources.sparkSession
    row = spark.range(1).select(question_terms(F.lit(question)).alias("t"), question_pages(F.lit(question)).alias("p")).first()
    return row["t"], row["p"]


def haystack() -> Column:
    return F.lower(F.concat(text_of(F.col("label")), F.lit("\n"), text_of(F.col("text"))))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def search(sources: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The sources with most term occurrences; ties by source_id as a string."""
    terms, _ = _parsed(sources, query)
    if not terms:
        return sources.withColumn("score", F.lit(0)).limit(0)
    text = haystack()
    score = reduce(lambda a, t: a + occurrences(text, t), terms, F.lit(0))
    scored = sources.withColumn("score", score).where(F.col("score") > 0)
    return scored.orderBy(F.desc("score"), "source_id").limit(limit)


def score(terms: list[str], pages: list[int]) -> Column:
    """Terms present, confidence, kind of source, and how near its page is to a named one."""
    text = haystack()
    points = reduce(lambda a, t: a + F.contains(text, F.lit(t)).cast("int"), terms, F.lit(0))
    points = points + F.floor(F.coalesce(F.col("confidence"), F.lit(0.0)) * 10).cast("int")
    bonus = reduce(lambda c, x: c.when(F.col("kind") == x[0], x[1]), KIND_BONUS.items(), F.when(F.lit(False), 0))
    points = points + bonus.otherwise(0)
    if pages:
        near = reduce(lambda a, p: a | (F.abs(F.col("page_number") - p) <= 1), pages, F.lit(False))
        points = points + F.when(F.col("page_number").isin(pages), 40).when(near, 16).otherwise(0)
    return points


def near_pages(pages: list[int]) -> Column:
    near = reduce(lambda a, p: a | (F.abs(F.col("page_number") - p) <= 1), pages, F.lit(False))
    return F.coalesce(near, F.lit(False))


def select_relevant(sources: DataFrame, question: str, limit: int = SOURCES_KEPT) -> DataFrame:
    """The best sources for a question.

    If it names pages and any source lies on or next to one, only such sources count. If nothing
    scores, the first sources by their order stand in.
    """
    terms, pages = _parsed(sources, question)
    ranked = sources.withColumn("score", score(terms, pages))
    best = ranked.orderBy(F.desc("score"), "source_id")
    if pages and ranked.where(near_pages(pages)).take(1):
        return best.where(near_pages(pages)).limit(limit)
    if ranked.where("score > 0").take(1):
        return best.where("score > 0").limit(limit)
    return ranked.orderBy("source_no").limit(limit)


def pinned(sources: DataFrame, ids: list[str], limit: int = SOURCES_KEPT) -> DataFrame:
    """The sources with these ids, case aside, in their order; an error if there is none."""
    wanted = [i.strip().upper() for i in ids if i.strip()]
    found = sources.where(F.upper("source_id").isin(wanted)).orderBy("source_no").limit(limit)
    if not found.take(1):
        raise ValueError("none of the pinned sources is available")
    return found


def focus(sources: DataFrame, terms: list[str]) -> DataFrame:
    """Sources whose label or path holds a term, or whose id is one."""
    hit = reduce(
        lambda a, t: a | F.contains(F.lower(text_of(F.col("label"))), F.lit(t.lower())) | (F.lower("source_id") == t.lower()),
        terms,
        F.lit(False),
    )
    return sources.where(hit)


def where(sources: DataFrame, term: str, limit: int = 6) -> DataFrame:
    """Sources that a term leads to: those whose ids it names, else the best of a search, else a filter's."""
    ids = sorted({x.upper() for x in re.findall(r"(?i)\bS\d+\b", term)})
    if ids:
        return sources.where(F.upper("source_id").isin(ids)).orderBy("source_no").limit(limit)
    ranked = search(sources, term, limit).drop("score")
    return ranked if ranked.take(1) else focus(sources, [term]).orderBy("source_no").limit(limit)


def path_score(path: Column, terms: list[str]) -> Column:
    """Three points for each term in the words of a path."""
    words = F.translate(F.lower(text_of(path)), "_-", "  ")
    return reduce(lambda a, t: a + F.contains(words, F.lit(t)).cast("int") * 3, terms, F.lit(0))


FOCUSED_FILES, FOLDER_FILES, FOLDER_RUNS, FOLDER_SOURCES = 12, 48, 12, 240


def focus_files(files: DataFrame, question: str, path: str = "path", limit: int = FOCUSED_FILES) -> DataFrame:
    """The files whose paths match a question best; none for a question without terms."""
    terms, _ = _parsed(files, question)
    if not terms:
        return files.limit(0).withColumn("score", F.lit(0))
    scored = files.withColumn("score", path_score(F.col(path), terms)).where(F.col("score") > 0)
    return scored.orderBy(F.desc("score"), path).limit(limit)


# Which files of a folder are read first, and extensions that are read at all.
FOLDER_EXTENSIONS = ("txt", "md", "html", "json", "jsonl", "yaml", "yml")
INTERNAL_FILES = ("run_manifest.json", "stage_manifest.json")


def folder_priority(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(name.rlike("^(?:final|translated|restored)__"), 0)
        .when(name.endswith(".detailed.json") | name.isin(*INTERNAL_FILES), 2)
        .otherwise(3)
    )


def folder_sources(files: DataFrame, root: str, question: str = "") -> DataFrame:
    """Sources from the text files (path, text) of a folder: outputs first, then by path, blank ones left out.

    A question with terms keeps the files whose paths match any, if some do. Ids count from 1.
    """
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*FOLDER_EXTENSIONS))
    terms, _ = _parsed(files, question)
    score = path_score(F.col("path"), terms)
    ranked = kept.withColumn("match_score", score).withColumn("_priority", folder_priority(F.col("path")))
    limit = FOLDER_SOURCES
    if terms and ranked.where("match_score > 0").take(1):
        ranked, limit = ranked.where("match_score > 0"), FOLDER_FILES
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    usable = ranked.where(~name.isin(*INTERNAL_FILES) & text_of(F.col("text")).rlike(r"\S"))
    # Bounded by the limit, so one window over it is no more than a page of rows.
    first = usable.orderBy("_priority", "path").limit(limit)
    numbered = first.withColumn("source_no", F.row_number().over(W.orderBy("_priority", "path")))
    below = F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30))
    return numbered.select(
        "source_no", F.concat(F.lit("S"), F.col("source_no").cast("string")).alias("source_id"), F.coalesce(below, F.col("path")).alias("label"),
        F.trim("text").alias("text"), F.lit("folder-output").alias("kind"), "path", "match_score",
    )


def number_sources(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Sources of several inputs together, in order, as S1, S2 and so on.

    Numbers are row counts before each range plus the place inside it, so no task holds all rows.
    """
    both = reduce(DataFrame.unionByName, [p.withColumn("_input", F.lit(n)) for n, p in enumerate(parts)])
    placed = ranged(written(both, "sources"), ["_input", *order])
    sizes = placed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"), F.min(PLACE).alias("first"))
    # One row for each range: bounded by their number.
    before = F.coalesce(F.sum("n").over(W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select(F.col(RANGE).alias("_of"), (before - F.col("first")).alias("_shift")), "starts")
    number = (F.col(PLACE) + F.col("_shift") + 1).cast("long")
    joined = placed.join(sent(starts), F.col(RANGE) == F.col("_of")).withColumn("source_no", number)
    return joined.withColumn("source_id", F.concat(F.lit("S"), F.col("source_no").cast("string"))).drop("_input", "_of", "_shift", PLACE, RANGE)


def history_tail(turns: DataFrame, session: str, turn: str, n: int = 24) -> DataFrame:
    """The last turns of each session."""
    order = W.partitionBy(session).orderBy(F.desc(turn))
    return turns.withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= n).drop("_back")


def hit_excerpt(text: Column, term: str, chars: int = 160) -> Column:
    """Text around the first hit, from at most 50 characters before it."""
    at = F.locate(term.lower(), F.lower(text_of(text)))
    start = F.greatest(at - 50, F.lit(1))
    return F.regexp_replace(F.substring(text_of(text), F.when(at > 0, start).otherwise(1), F.lit(chars)), r"\s+", " ")
