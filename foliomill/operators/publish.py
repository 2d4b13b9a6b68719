"""Pages as they are published: bodies from layout, unit blocks, credits, and assets in their places.

Blocks and assets of a page are few, so they meet as arrays in one join on the page; texts and
assets of a document meet in one join on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import render as R
from ..functions.labels import HEADED_ROLES, role_label
from ..functions.text import escape_xml, let, lines, match_text, ordered_distinct, paragraphs, slug, strip, text_of
from .assemble import asset_marker
from .layout import insertion_index

ASSETS = "array<struct<pos:int,path:string,bbox:array<int>,figure_index:int>>"


def escaped(text: Column) -> Column:
    return F.replace(escape_xml(text), F.lit("'"), F.lit("&#x27;"))


def slashed(path: Column) -> Column:
    return F.translate(text_of(path), "\\", "/")


def _items(text: Column) -> Column:
    """Lines of a list without their bullets."""
    return F.transform(lines(text), lambda x: F.regexp_replace(x, "^[-*• ]+|[-*• ]+$", ""))


def markdown_block(role: Column, text: Column, path: Column) -> Column:
    """One block; null for one without text or picture."""
    t = strip(text)
    said = (
        F.when(role == "table-region", R.markdown_table(t))
        .when(role == "title-region", F.concat(F.lit("## "), t))
        .when(role == "list-region", F.array_join(F.transform(_items(t), lambda x: F.concat(F.lit("- "), x)), "\n"))
        .when(role == "running-header-or-footer", F.concat(F.lit("<!-- "), t, F.lit(" -->")))
        .otherwise(t)
    )
    figure = F.when(path.isNotNull(), F.concat(F.lit("![]("), path, F.lit(")"))).when(t != "", F.concat(F.lit("> [Image: "), t, F.lit("]")))
    return F.when(role == "figure-region", figure).when(t != "", said)


def html_block(role: Column, text: Column, path: Column) -> Column:
    def tag(name: str, inner: Column, attributes: str = "") -> Column:
        return F.concat(F.lit(f"<{name}{attributes}>"), inner, F.lit(f"</{name}>"))

    def broken(t: Column) -> Column:
        return F.replace(escaped(t), F.lit("\n"), F.lit("<br />\n"))

    t = strip(text)
    rows = let(R.text_table(t), lambda r: F.when(F.size(r) == 0, tag("p", broken(t))).otherwise(R.html_rows(r)))
    prose = F.array_join(F.transform(paragraphs(t), lambda p: tag("p", broken(p))), "\n")
    said = (
        F.when(role == "table-region", rows)
        .when(role == "title-region", tag("h2", escaped(t)))
        .when(role == "list-region", tag("ul", F.array_join(F.transform(_items(t), lambda x: tag("li", escaped(x))), "")))
        .when(role == "equation-region", tag("p", escaped(t), ' class="equation"'))
        .when(role.isin("running-header-or-footer", "page-number-region"), tag("p", escaped(t), ' class="page-marker"'))
        .otherwise(prose)
    )
    picture = F.concat(F.lit('<figure class="figure-marker"><img src="'), escaped(path), F.lit('" alt="" /></figure>'))
    caption = F.concat(F.lit('<figure class="figure-marker"><figcaption>'), escaped(t), F.lit("</figcaption></figure>"))
    figure = F.when(path.isNotNull(), picture).when(t != "", caption)
    return F.when(role == "figure-region", figure).when(t != "", said)


FORMS = {"markdown": (markdown_block, "\n\n"), "html": (html_block, "\n")}


def with_assets(blocks: DataFrame, assets: DataFrame, page: str = "page") -> DataFrame:
    """Blocks with `asset_path`: for a figure, its page's first asset of the same box or of its number.

    Assets are rows of (page, pos, path, bbox, figure_index).
    """
    first = F.min(F.struct("pos", "path", "bbox", "figure_index"))
    boxed = assets.where(F.col("bbox").isNotNull()).groupBy(F.col(page).alias("_in"), F.col("bbox").alias("_box")).agg(first.alias("_boxed"))
    told = assets.where(F.col("figure_index").isNotNull()).groupBy(F.col(page).alias("_of"), F.col("figure_index").alias("_number")).agg(first.alias("_told"))
    figure, box = F.col("role") == "figure-region", F.array("left", "top", "right", "bottom")
    met = blocks.join(boxed, figure & (F.col(page) == F.col("_in")) & (box == F.col("_box")), "left")
    met = met.join(told, figure & (F.col(page) == F.col("_of")) & (F.col("reading_order") == F.col("_number")), "left")
    return met.select(*blocks.columns, F.least("_boxed", "_told")["path"].alias("asset_path"))


def layout_bodies(blocks: DataFrame, form: str = "markdown", page: str = "page") -> DataFrame:
    """(page, body): a page's blocks in reading order; blocks without text or picture are left out."""
    block, gap = FORMS[form]
    part = block(F.col("role"), F.col("extracted_text"), F.col("asset_path"))
    listed = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("reading_order", part.alias("part")))))
    return blocks.groupBy(page).agg(F.array_join(F.transform(listed, lambda x: x["part"]), gap).alias("body"))


def unit_heading(headings: Column, candidates: Column) -> Column:
    """The first heading that is not blank, else the first such title candidate, else empty."""
    every = F.filter(F.transform(F.concat(headings, candidates), strip), lambda x: x != "")
    return F.coalesce(F.get(every, F.lit(0)), F.lit(""))


def _shown(values: Column) -> Column:
    return F.filter(values, lambda x: x != "")


def markdown_unit(role: Column, heading: Column, entries: Column, notes: Column) -> Column:
    """Contents, heading and notes of a page as Markdown; empty if it has none."""
    rows = F.transform(entries, lambda e: F.regexp_replace(F.concat(F.lit("- "), strip(e["title"]), F.lit(" "), strip(e["page"])), r"\s+$", ""))
    remarks = F.transform(notes, lambda n: F.concat(F.lit("- "), strip(n["marker"]), F.lit(": "), strip(n["text"])))
    headed = (heading != "") & role.isin("title", "title-page", *HEADED_ROLES)
    return F.array_join(
        _shown(
            F.array(
                F.when((role == "contents") & (F.size(entries) > 0), F.concat(F.lit("## Contents\n\n"), F.array_join(rows, "\n"))).otherwise(""),
                F.when(headed, F.concat(F.lit("## "), heading)).otherwise(""),
                F.when(F.size(notes) > 0, F.concat(F.lit("## Notes\n\n"), F.array_join(remarks, "\n"))).otherwise(""),
            )
        ),
        "\n\n",
    )


def html_unit(role: Column, heading: Column, entries: Column, notes: Column) -> Column:
    def section(classes: Column, inner: Column) -> Column:
        return F.concat(F.lit('<section class="'), classes, F.lit('">'), inner, F.lit("</section>"))

    def title(classes: Column) -> Column:
        return section(classes, F.concat(F.lit("<h2>"), escaped(heading), F.lit("</h2>")))

    rows = F.transform(entries, lambda e: F.concat(F.lit("<tr><td>"), escaped(e["title"]), F.lit("</td><td>"), escaped(e["page"]), F.lit("</td></tr>")))
    contents = section(
        F.lit("contents semantic semantic-contents"), F.concat(F.lit("<h2>Contents</h2><table>"), F.array_join(rows, ""), F.lit("</table>"))
    )
    items = F.transform(notes, lambda n: F.concat(F.lit("<li><span>"), escaped(n["marker"]), F.lit("</span> "), escaped(n["text"]), F.lit("</li>")))
    remarks = section(
        F.lit("notes semantic semantic-footnotes"), F.concat(F.lit("<h2>Notes</h2><ol>"), F.array_join(items, ""), F.lit("</ol>"))
    )
    named = F.concat(F.lit("semantic semantic-"), slug(role))
    return F.array_join(
        _shown(
            F.array(
                F.when((role == "contents") & (F.size(entries) > 0), contents).otherwise(""),
                F.when((heading != "") & role.isin("title", "title-page"), title(F.concat(F.lit("title-page "), named)))
                .when((heading != "") & role.isin(*HEADED_ROLES), title(named)).otherwise(""),
                F.when(F.size(notes) > 0, remarks).otherwise(""),
            )
        ),
        "\n",
    )


def repeats_unit(role: Column, heading: Column, plain: Column) -> Column:
    """Whether a page's own text already shows what its unit block would."""
    low = F.lower(plain)
    return ((role == "contents") & low.rlike("table|contents")) | (
        role.isin("title", "chapter", "section") & (heading != "") & F.contains(low, F.lower(heading))
    )


def page_body(plain: Column, role: Column, heading: Column, unit: Column, gap: str) -> Column:
    """A page's unit block, unless its text repeats it, and its plain body."""
    return F.array_join(_shown(F.array(F.when(repeats_unit(role, heading, plain), "").otherwise(unit), strip(plain))), gap)


def with_units(pages: DataFrame, units: DataFrame, key: str, index: str = "page_index") -> DataFrame:
    """Pages with the unit of their number; a document of one page takes the summary of all its units.

    Units are rows with `role`, `section_headings`, `title_candidates`, `contents_entries` and
    `footnotes`. Missing units give a null `unit`.
    """
    fields = ["role", "section_headings", "title_candidates", "contents_entries", "footnotes"]
    own = units.select(F.col(key).alias("_key"), F.col(index).alias("_index"), F.struct(*fields).alias("_own"))
    whole = unit_summary(units, [key], index).select(F.col(key).alias("_doc"), F.struct(*fields).alias("_whole"))
    counted = pages.groupBy(F.col(key).alias("_counted")).agg(F.count(F.lit(1)).alias("_pages"))
    joined = pages.join(own, (F.col(key) == F.col("_key")) & (F.col(index) == F.col("_index")), "left")
    joined = joined.join(counted, F.col(key) == F.col("_counted"), "left").join(whole, F.col(key) == F.col("_doc"), "left")
    unit = F.coalesce("_own", F.when(F.col("_pages") == 1, F.col("_whole")))
    return joined.select(*pages.columns, unit.alias("unit"))


#: Entries that the summary of a document's units keeps of each list.
SUMMARY_ENTRIES = 120


def unit_summary(units: DataFrame, keys: list[str], index: str = "page_index") -> DataFrame:
    """One unit for each document: role and layout of its first page, and the first entries of all lists.

    A page is one row for each of its lists that has entries, and one for itself. A limited window keeps
    the first `SUMMARY_ENTRIES` pages of each list, and the first page, before any are gathered.
    """
    lists = ["section_headings", "title_candidates", "contents_entries", "footnotes"]
    shown = [c for c in ("role", "layout") if c in units.columns]

    def row(kind: str) -> Column:
        held = [(F.slice(c, 1, SUMMARY_ENTRIES) if c == kind else F.lit(None).cast(units.schema[c].dataType)).alias(c) for c in lists]
        own = [(F.col(c) if kind == "" else F.lit(None).cast(units.schema[c].dataType)).alias(c) for c in shown]
        made = F.struct(F.lit(kind).alias("kind"), F.col(index).alias("at"), *held, *own)
        return made if kind == "" else F.when(F.size(kind) > 0, made)

    rows = units.select(*keys, F.explode(F.array_compact(F.array(*[row(k) for k in ["", *lists]]))).alias("_row"))
    place = F.row_number().over(W.partitionBy(*keys, "_row.kind").orderBy("_row.at"))
    most = F.when(F.col("_row.kind") == "", 1).otherwise(SUMMARY_ENTRIES)
    first = rows.withColumn("_place", place).where(F.col("_place") <= SUMMARY_ENTRIES).where(F.col("_place") <= most)
    grouped = first.groupBy(*keys).agg(F.collect_list(F.struct("_row.kind", "_place", "_row")).alias("_rows"))

    def listed(name: str) -> Column:
        own = F.array_sort(F.transform(F.filter("_rows", lambda x: x["kind"] == name), lambda x: F.struct(x["_place"], x["_row"][name].alias("v"))))
        return F.slice(F.flatten(F.transform(own, lambda x: x["v"])), 1, SUMMARY_ENTRIES).alias(name)

    page = F.filter("_rows", lambda x: x["kind"] == "")[0]["_row"]
    return grouped.select(*keys, *[page[c].alias(c) for c in shown], *[listed(c) for c in lists])


def semantic_tags(observed: DataFrame, kind: str = "document_type", index: str = "page_index", assets: str | None = None) -> DataFrame:
    """The observed pages with `role_label`, `has_figures` and `asset_count`: a unit for each page."""
    count = F.coalesce(F.col(assets), F.lit(0)) if assets else F.lit(0)
    return observed.withColumns({"role_label": role_label(F.col("role"), F.col(kind)), "asset_count": count, "has_figures": count > 0})


def credits(contributors: Column, publishers: Column) -> Column:
    return ordered_distinct(F.concat(contributors, publishers), 6)


def page_assets(tree: DataFrame, chunks: DataFrame, page: str = "page") -> DataFrame:
    """(page, pos, path, label): the assets of a page from its layout tree, then from its chunks, each once.

    Both are rows of (page, pos, path, label); an asset is known by its path, or else by its label.
    """
    both = tree.select(page, F.lit(0).alias("part"), "pos", "path", "label").unionByName(chunks.select(page, F.lit(1).alias("part"), "pos", "path", "label"))
    known = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.nullif(F.col("label"), F.lit("")))
    first = both.where(known.isNotNull()).groupBy(page, known.alias("_known")).agg(F.min(F.struct("part", "pos", "path", "label")).alias("a"))
    return first.select(page, F.struct("a.part", "a.pos").alias("pos"), F.col("a.path").alias("path"), F.col("a.label").alias("label"))


def asset_texts(assets: DataFrame, chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Assets with `related`: the text of their document's first chunk that lists their path.

    Chunks are rows of (key, order, text, asset_paths); paths are compared with forward slashes.
    """
    listed = chunks.select(key, order, "text", F.explode("asset_paths").alias("_listed")).withColumn("_listed", slashed(F.col("_listed")))
    first = listed.groupBy(key, "_listed").agg(F.min_by("text", order).alias("related"))
    named = assets.withColumn("_path", slashed(F.col("path")))
    joined = named.join(first.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col("_path") == F.col("_listed")), "left")
    return joined.drop("_path", "_key", "_listed")


def _starts(related: Column) -> Column:
    """What a paragraph must hold to belong to a related text: the starts of its long paragraphs."""
    every = F.concat(F.transform(paragraphs(related), match_text), F.array(match_text(related)))
    return F.transform(F.filter(every, lambda x: F.length(x) >= 40), lambda x: F.substring(x, 1, 120))


def rendered_paths(text: Column) -> Column:
    """Paths of the paragraphs that are image markers, with forward slashes."""
    markers = F.filter(paragraphs(text), lambda p: p.rlike(R.IMAGE_MARKER))
    return F.transform(markers, lambda p: slashed(strip(F.regexp_extract(p, R.IMAGE_MARKER, 2))))


def insert_markers(texts: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """The texts with a marker for each asset that they do not show yet.

    A marker goes behind the first paragraph that belongs to the asset's related text, else to the
    place that its layout gives, else to the end. Assets are rows of (key, pos, path, label,
    related, zone, top, bottom, width_hint), taken in order.
    """
    fields = ["pos", "path", "label", "related", "zone", "top", "bottom", "width_hint"]
    listed = assets.where(strip(F.col("path")) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_assets"))

    def step(text: Column, a: Column) -> Column:
        marker = asset_marker(a["label"], a["path"])

        def at(ps: Column) -> Column:
            hits = let(
                _starts(a["related"]),
                lambda s: F.transform(ps, lambda p: let(match_text(p), lambda m: F.exists(s, lambda x: F.contains(m, x)))),
            )
            near = F.nullif(F.array_position(hits, True).cast("int"), F.lit(0))
            return F.coalesce(near, insertion_index(F.size(ps), a["zone"], a["top"], a["bottom"], a["width_hint"]))

        def put(ps: Column) -> Column:
            return let(
                at(ps),
                lambda i: F.when(i.isNull(), strip(F.concat(text, F.lit("\n\n"), marker))).otherwise(
                    F.array_join(F.concat(F.slice(ps, F.lit(1), i), F.array(marker), F.slice(ps, i + 1, F.size(ps))), "\n\n")
                ),
            )

        return let(paragraphs(text), put)

    joined = texts.join(listed, key, "left").withColumn("_shown", rendered_paths(F.col("text")))
    missing = F.filter("_assets", lambda a: ~F.array_contains("_shown", slashed(a["path"])))
    made = strip(F.aggregate(missing, F.regexp_replace(text_of(F.col("text")), r"(?U)\s+$", ""), step))
    text = F.when(F.coalesce(F.size(missing), F.lit(0)) == 0, F.col("text")).otherwise(F.coalesce(F.nullif(made, F.lit("")), F.col("text")))
    return joined.withColumn("text", text).drop("_assets", "_shown")


def asset_counts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Assets listed by all chunks of each document."""
    return chunks.groupBy(*keys).agg(F.sum(F.greatest(F.size("asset_paths"), F.lit(0))).alias("asset_count"))


def structure_counts(observed: DataFrame, keys: list[str]) -> DataFrame:
    """For each document, maps from roles, layouts and features to their numbers of pages; one pass."""

    def pair(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    rows = F.concat(
        F.array(pair("content_kinds", F.col("role")), pair("layouts", F.col("layout"))),
        F.transform("content_features", lambda x: pair("content_features", x)),
    )
    counted = observed.select(*keys, F.explode(rows).alias("r")).groupBy(*keys, "r.kind", "r.value").agg(F.count(F.lit(1)).alias("n"))

    def held(kind: str) -> Column:
        entries = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n"))))
        return F.map_from_entries(entries).alias(kind)

    return counted.groupBy(*keys).agg(held("content_kinds"), held("layouts"), held("content_features"))
