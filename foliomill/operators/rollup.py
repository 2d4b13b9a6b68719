"""Roll-ups over observed pages: counts, modes, frequent values, structure, usage, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.structure import page_profile
from ..functions.text import PAGE_BREAK, strip
from .ordered import parts


def counts_map(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """For each key, a map from value to its number of rows, by two partial aggregates."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value), "n")))
    return counted.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def mode_of(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key; of equals, the greatest."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias(name))


def frequent(rows: DataFrame, keys: list[str], value: str, order: str, limit: int = 12) -> DataFrame:
    """Values that occur more than once, case aside, within the `limit` most frequent of each key."""
    named = rows.select(*keys, strip(F.col(value)).alias("shown"), F.col(order).alias("at")).where(F.col("shown") != "")
    counted = named.groupBy(*keys, F.lower("shown").alias("low")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("shown", "at").alias("shown")
    )
    # The planner keeps the best of each key in every task before the shuffle of this window.
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "low"))
    best = counted.where(F.col("n") > 1).withColumn("place", place).where(F.col("place") <= limit)
    return best.select(*keys, "place", F.col("shown").alias(value), "n")


def with_profile(observed: DataFrame) -> DataFrame:
    native = F.lit(""), F.lit(0)
    if "native_flow" in observed.columns:
        native = F.coalesce("native_flow", F.lit("")), F.coalesce("native_columns", F.lit(0))
    flow, columns = page_profile(*native)
    return observed.withColumn("dominant_flow", flow).withColumn("column_count", columns)


# The notes' wording is a fixed value.
def layout_notes(columns: Column, flow: Column, counts: Column) -> Column:
    def has(name: str) -> Column:
        return F.coalesce(F.try_element_at(counts, F.lit(name)), F.lit(0)) > 0

    return F.filter(
        F.array(
            F.when(columns > 1, F.format_string("Likely %d-column page structure on some pages.", columns)),
            F.when(has("front-matter"), "Front matter detected on at least one page."),
            F.when(has("structured-list"), "List-like pages such as contents or references detected."),
            F.when(has("tabular"), "Tabular pages detected and should keep row/cell order."),
            F.when(has("chart-led"), "Chart-like pages detected and should keep labels and numeric signals."),
            F.when(flow == "dense-prose", "Pages are text-dense and should stay paragraph-oriented."),
        ),
        lambda x: x.isNotNull(),
    )


def layout_profile(pages: DataFrame, keys: list[str]) -> DataFrame:
    """For each document: flow counts, the dominant flow, most columns, and notes; one pass over the pages."""
    flows = pages.groupBy(*keys, "dominant_flow").agg(F.count(F.lit(1)).alias("n"), F.max("column_count").alias("most"))
    entries = F.array_sort(F.collect_list(F.struct("dominant_flow", "n")))
    profile = flows.groupBy(*keys).agg(
        F.map_from_entries(entries).alias("page_flow_counts"),
        F.max_by("dominant_flow", F.struct("n", "dominant_flow")).alias("dominant_flow"),
        F.greatest(F.lit(1), F.max("most")).alias("column_count_estimate"),
    )
    return profile.withColumn(
        "notes", layout_notes(F.col("column_count_estimate"), F.col("dominant_flow"), F.col("page_flow_counts"))
    )


#: Lists of a document and how many entries they have at most; distinct ones take a value once, case aside.
DISTINCT_LISTS = {"title_candidates": 8, "section_headings": 24, "page_markers": 24, "contributors": 12, "publishers": 8}
PLAIN_LISTS = {"contents_entries": 120, "footnotes": 120}


def document_structure(observed: DataFrame, keys: list[str], order: str = "page_index") -> DataFrame:
    """One row for each document, with the lists and counts of its pages, lists capped as documented.

    The entries of all lists go through one aggregate, by document, list and value, and the first of
    each list through one limited window, so that no row ever holds more than the capped lists, and
    the pages are observed once. Pages are counted in the same aggregate, as a list without entries.
    """
    o = F.col(order)
    at, none = o.cast("long"), F.lit("")

    def row(kind: str, pos: Column, key: Column, a: Column, b: Column = none, c: Column = none) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), key.alias("key"), F.struct(at.alias("at"), pos.alias("pos"), a.alias("a"), b.alias("b"), c.alias("c")).alias("entry"),
        )

    def distinct(kind: str) -> Column:
        values = F.array("page_marker") if kind == "page_markers" else F.col(kind)
        shown = F.filter(F.transform(values, strip), lambda x: x != "")
        return F.transform(shown, lambda x, i: row(kind, i, F.lower(x), x))

    def plain(kind: str, *fields: str) -> Column:
        capped = F.slice(F.col(kind), 1, PLAIN_LISTS[kind])
        return F.transform(capped, lambda x, i: row(kind, i, F.concat_ws(":", at.cast("string"), i.cast("string")), *[x[f] for f in fields]))

    rows = F.concat(
        F.array(row("", F.lit(0), none, none)), *[distinct(k) for k in DISTINCT_LISTS],
        plain("contents_entries", "title", "page", "raw"), plain("footnotes", "marker", "text"),
    )
    entries = (
        observed.select(*keys, (F.size("table_rows") > 0).alias("t"), (F.size("chart_signals") > 0).alias("c"), F.explode(rows).alias("r"))
        .groupBy(*keys, "r.kind", "r.key")
        .agg(F.min("r.entry").alias("entry"), F.count(F.lit(1)).alias("pages"), F.count_if("t").alias("tables"), F.count_if("c").alias("charts"))
    )
    limit = F.lit(1)
    for kind, most in {**DISTINCT_LISTS, **PLAIN_LISTS}.items():
        limit = F.when(F.col("kind") == kind, most).otherwise(limit)
    place = F.row_number().over(W.partitionBy(*keys, "kind").orderBy("entry"))
    first = entries.withColumn("place", place).where(F.col("place") <= max(PLAIN_LISTS.values())).where(F.col("place") <= limit)
    grouped = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("kind", "place", "entry"))).alias("all"),
        *[F.max(F.when(F.col("kind") == "", F.col(n))).alias(n) for n in ("pages", "tables", "charts")],
    )

    def listed(kind: str, shape) -> Column:
        return F.transform(F.filter("all", lambda x: x["kind"] == kind), lambda x: shape(x["entry"])).alias(kind)

    entry = listed("contents_entries", lambda e: F.struct(e["a"].alias("title"), e["b"].alias("page"), e["c"].alias("raw")))
    note = listed("footnotes", lambda e: F.struct(e["a"].alias("marker"), e["b"].alias("text")))
    return grouped.select(
        *keys, F.col("pages").alias("page_count_observed"), *[listed(k, lambda e: e["a"]) for k in DISTINCT_LISTS], entry, note,
        F.col("tables").alias("table_block_count"), F.col("charts").alias("chart_block_count"),
    )


def usage_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Token sums, and whether any reply was cut."""
    return rows.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.bool_or("truncated").alias("truncated"),
    )


def first_failure(rows: DataFrame, keys: list[str], order: str, reason: str = "failure_reason") -> DataFrame:
    """The first reason in order and the status that follows: restored without one, else partial."""
    named = F.when(F.coalesce(F.col(reason), F.lit("")) != "", F.col(order))
    return rows.groupBy(*keys).agg(F.min_by(reason, named).alias("first")).select(
        *keys,
        F.coalesce("first", F.lit("")).alias("failure_reason"),
        F.when(F.col("first").isNull(), "restored").otherwise("partial").alias("status"),
    )


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest last; none for a path without folders."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def folder_parts(rows: DataFrame, path: str = "path", text: str = "text", nested: bool = True) -> DataFrame:
    """(folder, path, text): every text that counts for a folder, for sinks that write folders in parts.

    With nested=False a text counts for the folder that holds it only, else for all folders above it.
    """
    clean = strip(F.col(text))
    folders = ancestors(F.col(path)) if nested else F.array(F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    return rows.where((clean != "") & F.contains(F.col(path), F.lit("/"))).select(
        F.explode(folders).alias("folder"), F.col(path).alias("path"), clean.alias("text")
    )


def folder_combine(rows: DataFrame, path: str = "path", text: str = "text", nested: bool = True) -> DataFrame:
    """(folder, parts, combined): texts joined by page breaks for every folder above them, by path.

    A folder's text is one value, which Spark bounds at 2 GB: larger folders go through `folder_texts`.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"])
    return folder_parts(rows, path, text, nested).groupBy("folder").agg(
        F.count(F.lit(1)).alias("parts"), F.array_join(ordered, PAGE_BREAK).alias("combined")
    )


def folder_texts(rows: DataFrame, path: str = "path", text: str = "text", nested: bool = True) -> DataFrame:
    """(folder, part, offset, length, rows, text): what `folder_combine` joins, in parts of bounded size."""
    return parts(folder_parts(rows, path, text, nested), ["folder"], ["path"], "text", PAGE_BREAK)
