"""Ordered and staged assembly: priority union, retries, running state, budgets, block texts, assets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import structure as X
from ..functions.text import PAGE_BREAK, SCRIPTS, is_blank, lines, recent_words, scripts, strip, text_of
from ..sinks.shared import forget, written
from .ordered import PLACE, inside, numbered, parts, ranged, scanned


def priority_union(parts: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """All rows of the first relation that has any; with keys, decided for each key apart."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("priority", F.lit(n)) for n, p in enumerate(parts, 1)])
    if keys is None:
        first = tagged.agg(F.min("priority").alias("first"))
        return tagged.join(F.broadcast(first), F.col("priority") == F.col("first"), "left_semi")
    first = tagged.groupBy(*keys).agg(F.min("priority").alias("first"))
    return tagged.join(first, keys).where(F.col("priority") == F.col("first")).drop("first")


def concat_pages(rows: DataFrame, keys: list[str], order: str, text: str = "text", blanks: bool = False) -> DataFrame:
    """The texts of each key joined by page breaks in order, blank ones dropped unless asked for.

    Blank texts are left out of the lists, not filtered as rows: a filter would be pushed below the
    projection that made the text, which would then be computed twice.
    """
    clean = strip(F.col(text))
    page = F.struct(F.col(order).alias("o"), clean.alias("t"))
    listed = F.array_sort(F.collect_list(page if blanks else F.when(clean != "", page)))
    joined = rows.groupBy(*keys).agg(listed.alias("_pages")).where(F.size("_pages") > 0)
    return joined.select(*keys, F.array_join(F.transform("_pages", lambda x: x["t"]), PAGE_BREAK).alias("text"))


def retry_merge(base: DataFrame, retried: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Base rows with the fields of their retry where it succeeded; usage is added up by the caller."""
    good = retried.where(F.coalesce(F.col("failure_reason"), F.lit("")) == "")
    picked = good.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    merged = base.join(picked, keys, "left")
    for f in fields:
        merged = merged.withColumn(f, F.when(F.col("_hit"), F.col(f"_new_{f}")).otherwise(F.col(f)))
    return merged.withColumn("retried", F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_new_{f}" for f in fields])


#: What the lists of the state may hold, and how many of them at most.
STATE_LISTS = {"notes": (X.LAYOUT_NOTES, 6), "scripts": (tuple(n for n, _ in SCRIPTS), 8), "structures": (X.STRUCTURES, 8)}


def consistency_scan(chunks: DataFrame, run: str, order: str, text: str = "text") -> DataFrame:
    """The state that each chunk sees: what the chunks of its run before it have shown.

    The columns are those of the chunks but for the text, and the state. What a chunk shows is looked at
    once and written, without the text. A range of a run sums up as its count of live pages, the first
    place of each style and of each known value of the lists, and its latest words; the scan over ranges
    gives each chunk the firsts of its run, of which it sees those that come before it. The lists are
    filled value by value, in the order of their first places.
    """
    found = F.col("_lines")
    live = ~is_blank(F.col(text)) & (strip(F.col(text)) != "")
    kept = [c for c in chunks.columns if c != text]

    def seen(value: Column) -> Column:
        return F.when(live, value)

    marked = written(
        chunks.withColumn("_lines", lines(F.col(text))).select(
            *kept,
            live.cast("int").alias("_live"),
            seen(X.paragraph_style(strip(F.col(text)))).alias("_paragraph"),
            seen(F.nullif(X.heading_style(found), F.lit(""))).alias("_heading"),
            seen(F.nullif(X.page_marker_style(found), F.lit(""))).alias("_marker"),
            seen(X.layout_notes(found)).alias("_notes"),
            seen(scripts(F.col(text))).alias("_scripts"),
            seen(X.structures(found)).alias("_structures"),
            seen(recent_words(F.col(text), 100)).alias("_recent"),
        ),
        "marks",
    )
    placed = ranged(marked, [run, order])
    forget(marked)

    def spot(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.col(PLACE).alias("at"), value.alias("v")))

    def listed(name: str, value: str) -> Column:
        at = F.array_position(f"_{name}", value).cast("int")
        return F.when(at > 0, F.struct(F.col(PLACE).alias("at"), at.alias("pos")))

    styles = {f"_first{c}": spot(F.col(c)) for c in ("_paragraph", "_heading", "_marker")}
    values = {(name, n): v for name, (known, _) in STATE_LISTS.items() for n, v in enumerate(known)}
    state = scanned(
        placed,
        [run],
        {"_before": F.col("_live")},
        styles | {f"_{name}{n}": listed(name, v) for (name, n), v in values.items()},
        {"_last": spot(F.col("_recent"))},
    )

    def first(column: str) -> Column:
        own = F.col(f"_first{column}")
        return F.when(own["at"] < F.col(PLACE), own["v"]).otherwise("")

    def shown(name: str) -> Column:
        firsts = F.array(*[F.struct(F.col(f"_{k}{n}").alias("first"), F.lit(v).alias("value")) for (k, n), v in values.items() if k == name])
        earlier = F.filter(firsts, lambda x: x["first"]["at"] < F.col(PLACE))
        return F.slice(F.transform(F.array_sort(earlier), lambda x: x["value"]), 1, STATE_LISTS[name][1])

    here = inside([run])
    return state.select(
        *kept,
        (F.col("_before") + F.coalesce(F.sum("_live").over(here), F.lit(0))).alias("observed_pages"),
        first("_paragraph").alias("paragraph_style"),
        first("_heading").alias("heading_style"),
        first("_marker").alias("page_marker_style"),
        shown("notes").alias("layout_notes"),
        shown("scripts").alias("encountered_scripts"),
        shown("structures").alias("encountered_structures"),
        F.coalesce(F.last("_recent", ignorenulls=True).over(here), F.col("_last")["v"], F.lit("")).alias("recent_text_excerpt"),
    )


def review_budget(rows: DataFrame, run: str, order: str, damaged: str, limit: Column) -> DataFrame:
    """`reviewed`: damaged rows of a run, in order, until the budget is spent.

    The rows are written before they are ranged, as what tells damage may cost much.
    """
    known = written(rows, "damage")
    spent = numbered(known, [run], [order], "_spent", F.coalesce(F.col(damaged).cast("int"), F.lit(0)))
    return spent.withColumn("reviewed", F.col(damaged) & (F.col("_spent") + 1 <= limit)).drop("_spent")


def concat_parts(rows: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """(keys, part, offset, length, rows, text): the texts of each key joined by page breaks, in parts.

    Blank texts are dropped. For keys with more text than a value should hold; see `ordered.parts`.
    """
    clean = rows.withColumn(text, strip(F.col(text))).where(F.col(text) != "")
    return parts(clean, keys, order, text, PAGE_BREAK)


def allocate_texts(blocks: DataFrame, segments: DataFrame, page: str = "page") -> DataFrame:
    """Blocks with `extracted_text`: the n-th segment of a page goes to its n-th block of that sort.

    CSV segments go to table blocks, others to blocks that are neither tables, figures nor
    separators; what is left over of the others is appended to the last such block. Blocks and
    segments are numbered apart and meet as rows by these numbers, so that a page may have any number of either.
    """
    role, csv = F.col("role"), F.col("segment").startswith("```csv")
    marked = blocks.withColumn("_sort", F.when(role == "table-region", "csv").when(~role.isin("separator-region", "figure-region"), "prose"))
    down = W.partitionBy(page).orderBy("reading_order").rowsBetween(W.unboundedPreceding, 0)
    at = F.when(F.col("_sort") == "csv", F.count_if(F.col("_sort") == "csv").over(down)).otherwise(F.count_if(F.col("_sort") == "prose").over(down))
    ranked = marked.withColumn("_at", at)
    slots = marked.groupBy(F.col(page).alias("_page")).agg(F.count_if(F.col("_sort") == "prose").alias("_slots"))
    along = W.partitionBy("_page").orderBy("pos", "segment").rowsBetween(W.unboundedPreceding, 0)
    sorted_ = segments.select(F.col(page).alias("_page"), "pos", "segment", F.when(csv, "csv").otherwise("prose").alias("_kind"))
    nth = F.when(F.col("_kind") == "csv", F.count_if(F.col("_kind") == "csv").over(along)).otherwise(F.count_if(F.col("_kind") == "prose").over(along))
    dealt = sorted_.withColumn("_nth", nth).join(slots, "_page")
    to = F.when(F.col("_kind") == "prose", F.least("_nth", "_slots")).otherwise(F.col("_nth"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment"))), lambda x: x["segment"])
    texts = dealt.groupBy("_page", "_kind", to.alias("_to")).agg(F.array_join(listed, "\n\n").alias("_said"))
    met = (F.col(page) == F.col("_page")) & (F.col("_sort") == F.col("_kind")) & (F.col("_at") == F.col("_to"))
    said = F.when(F.col("_sort") == "prose", F.coalesce("_said", F.lit(""))).otherwise(F.col("_said"))
    return ranked.join(texts, met, "left").select(*blocks.columns, said.alias("extracted_text"))


def texts_by_marker(blocks: DataFrame, replies: DataFrame, page: str = "page") -> DataFrame:
    """Blocks with `extracted_text`: what their page's reply says behind the marker of their order, else empty.

    A reply's markers are rows of their own before the join; the last marker of a number counts. Pages whose
    reply has no marker keep their blocks without texts, for `allocate_texts`.
    """
    from ..functions.responses import block_texts

    said = replies.select(F.col(page).alias("_page"), F.explode(block_texts(F.col("reply"))).alias("_order", "_said"))
    joined = blocks.join(said, (F.col(page) == F.col("_page")) & (F.col("reading_order") == F.col("_order")), "left")
    return joined.withColumn("extracted_text", strip(F.coalesce("_said", F.lit("")))).drop("_page", "_order", "_said")


def asset_label(label: Column) -> Column:
    """The label before any bar, without a parenthesis at its end."""
    named = F.when(text_of(label) == "", F.lit("figure")).otherwise(text_of(label))
    first = strip(F.get(F.split(strip(named), r" \| "), F.lit(0)))
    made = strip(F.regexp_replace(first, r"\s*\([^)]*\)\s*$", ""))
    return F.when(made == "", "figure").otherwise(made)


def asset_marker(label: Column, path: Column) -> Column:
    return F.concat(F.lit("[image: "), asset_label(label), F.lit(" | "), path, F.lit("]"))


def marker_paths(text: Column) -> Column:
    """Paths of the image markers in a text, with forward slashes."""
    found = F.regexp_extract_all(text_of(text), F.lit(r"(?i)\[image:\s*[^\]|]*\|\s*([^\]]+)\]"), F.lit(1))
    return F.transform(found, lambda p: F.translate(strip(p), "\\", "/"))


def missing_assets(assets: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Assets whose path no marker of their document's text shows."""
    shown = texts.select(key, F.explode(marker_paths(F.col("text"))).alias("_path")).distinct()
    path = F.translate(F.col("path"), "\\", "/")
    return assets.where(F.col("path") != "").withColumn("_path", path).join(shown, [key, "_path"], "left_anti").drop("_path")
