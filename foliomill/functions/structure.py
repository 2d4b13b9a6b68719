"""What a page is and holds, from its lines.

`observe` adds the columns of an observation stage by stage, so that each is computed once: lines,
table rows and chart signals, role, features, layout class and the extracted lists.

Role names, word patterns, limits and style notes are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import (
    collapse, half_even, has_column_spacing, is_blank, is_body_line, is_heading, is_page_marker,
    joined_lower, let, lines, ordered_distinct, strip, text_of,
)

ROW = "struct<cells:array<string>,cell_count:int,raw:string>"
ENTRY = "struct<title:string,page:string,raw:string>"
NOTE = "struct<marker:string,text:string>"


def first_of(*cases: tuple[Column, str | Column], otherwise: str | Column = "") -> Column:
    """The value of the first case that holds."""
    chain = reduce(lambda c, x: c.when(x[0], x[1]), cases[1:], F.when(*cases[0]))
    return chain.otherwise(otherwise)


def table_rows(found: Column) -> Column:
    """Rows of the most frequent number of cells, at most 24; the larger number wins a tie."""

    def cells(raw: Column) -> Column:
        parts = F.when(F.contains(raw, F.lit("|")), F.split(raw, r"\|", -1)).when(
            raw.rlike(r"\s{2,}"), F.split(raw, r"\s{2,}", -1)
        )
        return F.coalesce(
            F.filter(F.transform(parts, strip), lambda x: x != ""), F.array().cast("array<string>")
        )

    def usable(x: Column) -> Column:
        low, n = F.lower(x["one"]), F.size(x["cells"])
        digits = F.exists(x["cells"], lambda c: c.rlike(r"\d"))
        return (
            F.length(x["one"]).between(3, 220) & ~low.startswith("contents") & ~low.startswith("table of contents")
            & (n >= 2) & (digits | (n >= 3)) & ~is_body_line(x["one"])
        )

    def rows(c: Column) -> Column:
        sizes = F.transform(F.sequence(F.lit(2), F.lit(8)), lambda k: F.struct(
            F.size(F.filter(c, lambda r: r["cell_count"] == k)).alias("n"), k.alias("k")))
        return let(F.array_max(sizes)["k"], lambda k: F.slice(F.filter(c, lambda r: r["cell_count"] == k), 1, 24))

    candidates = F.transform(
        F.filter(
            F.transform(
                F.slice(found, 1, 120),
                lambda raw: F.struct(raw.alias("raw"), collapse(raw).alias("one"), cells(raw).alias("cells")),
            ),
            usable,
        ),
        lambda x: F.struct(
            F.slice(x["cells"], 1, 8).alias("cells"),
            F.least(F.size(x["cells"]), F.lit(8)).alias("cell_count"),
            x["raw"].alias("raw"),
        ),
    )
    none = F.array().cast(f"array<{ROW}>")
    return F.when(F.size(found) < 2, none).otherwise(
        let(candidates, lambda c: F.when(F.size(c) == 0, none).otherwise(rows(c)))
    )


def chart_signals(found: Column) -> Column:
    head = F.slice(found, 1, 120)
    low = joined_lower(found, 120)
    terms = low.rlike(r"\b(chart|graph|plot|diagram|figure|axis|legend|trend|bar|line chart|pie chart)\b")
    axis = F.exists(head, lambda x: x.rlike(r"(?i)\b(?:x|y)\s*[- ]?axis\b"))
    numbers = F.size(F.filter(head, lambda x: x.rlike(r"\b\d+(?:\.\d+)?%?\b"))) >= 4
    notes = low.rlike(r"\b(legend|key|scale|rate|percentage|axis|graph|chart|plot)\b")
    return F.filter(
        F.array(
            F.when(terms, "chart_terms"), F.when(axis, "axis"), F.when(numbers, "numeric_labels"),
            F.when(notes, "chart_annotations"),
        ),
        lambda x: x.isNotNull(),
    )


def contents_entries(found: Column) -> Column:
    """Titles with their pages, in either order, at most 80."""
    page = r"([ivxlcdm\d]+)"
    leading = rf"(?i)^(.+?)\s*(?:\.{{2,}}|\s{{2,}}|[|:]\s*|-\s+)\s*{page}$"
    trailing = rf"(?i)^{page}\s+(.+?)$"

    def entry(raw: Column) -> Column:
        def of(x: Column) -> Column:
            led = x.rlike(leading)
            title = F.when(led, F.regexp_extract(x, leading, 1)).otherwise(F.regexp_extract(x, trailing, 2))
            number = F.when(led, F.regexp_extract(x, leading, 2)).otherwise(F.regexp_extract(x, trailing, 1))
            made = F.struct(
                F.regexp_replace(title, r"^[ .\-]+|[ .\-]+$", "").alias("title"),
                number.alias("page"),
                raw.alias("raw"),
            )
            low = F.lower(x)
            skip = (
                ~F.length(x).between(3, 180) | is_page_marker(x) | low.startswith("contents")
                | low.startswith("table of contents") | is_body_line(x)
            )
            return F.when(~skip, made)

        return let(collapse(raw), of)

    kept = F.filter(
        F.transform(F.slice(found, 1, 120), entry),
        lambda e: e.isNotNull() & F.length(e["title"]).between(2, 140) & (e["page"] != "") & ~is_page_marker(e["title"]),
    )
    return F.slice(kept, 1, 80)


def footnotes(found: Column) -> Column:
    pattern = r"(?i)^\s*(\*+|\d+|[a-z])[).:\]]\s+(.+)$"
    notes = F.transform(
        F.filter(found, lambda x: x.rlike(pattern)),
        lambda x: F.struct(
            F.regexp_extract(x, pattern, 1).alias("marker"), strip(F.regexp_extract(x, pattern, 2)).alias("text")
        ),
    )
    return F.slice(F.filter(notes, lambda n: F.length(n["text"]) > 8), 1, 40)


def _credit(found: Column, head: int, length: int, words: str, limit: int) -> Column:
    picked = F.filter(
        F.transform(F.slice(found, 1, head), collapse),
        lambda x: (F.length(x) <= length) & x.rlike(rf"(?i)\b({words})\b"),
    )
    return ordered_distinct(picked, limit)


def contributors(found: Column) -> Column:
    return _credit(found, 30, 140, "by|author|edited by|editor|translated by|translator|compiled by", 8)


def publishers(found: Column) -> Column:
    words = "published by|publisher|press|publication|publications|printing|printer"
    return _credit(found, 50, 160, words, 6)


def _ends(found: Column, head: int, tail: int) -> Column:
    n = F.size(found)
    last = F.slice(found, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail))
    return F.concat(F.slice(found, 1, head), last)


def running_header(found: Column) -> Column:
    usable = F.filter(
        F.transform(_ends(found, 3, 3), collapse),
        lambda x: F.length(x).between(4, 90) & ~is_page_marker(x),
    )
    return F.coalesce(F.get(usable, F.lit(0)), F.lit(""))


def page_marker(found: Column) -> Column:
    return F.coalesce(F.get(F.filter(_ends(found, 12, 6), is_page_marker), F.lit(0)), F.lit(""))


def section_headings(found: Column) -> Column:
    return F.slice(F.filter(F.slice(found, 1, 12), is_heading), 1, 6)


def _has(text: Column, words: str) -> Column:
    return text.rlike(rf"\b({words})\b")


@dataclass(frozen=True)
class Page:
    """What many rules look at, computed once: column names of a staged frame, or expressions."""

    found: Column
    low: Column
    low6: Column
    low8: Column
    first: Column
    n: Column
    spaced: Column
    pictured: Column

    @staticmethod
    def of(found: Column) -> Page:
        return Page(
            found, joined_lower(found, 40), joined_lower(found, 6), joined_lower(found, 8),
            F.coalesce(F.get(found, F.lit(0)), F.lit("")), F.size(found), has_column_spacing(found),
            F.exists(found, lambda x: F.contains(F.lower(x), F.lit("[image:"))),
        )

    def staged(self, frame: DataFrame) -> tuple[DataFrame, Page]:
        """The frame with these as columns, and the page that names them."""
        made = {f.name: f"_page_{f.name}" for f in fields(self) if f.name != "found"}
        frame = frame.withColumns({column: getattr(self, name) for name, column in made.items()})
        return frame, Page(self.found, **{name: F.col(column) for name, column in made.items()})


def _magazine(page: Page) -> Column:
    low, first, n, found = page.low, page.first, page.n, page.found
    return first_of(
        (_has(low, r"masthead|editor|publisher|volume|vol\.|issue|no\."), "masthead"),
        (_has(low, "editorial|from the editor"), "editorial"),
        (_has(low, "feature|special report|cover story"), "feature"),
        (_has(low, "advertisement|advertiser|classified"), "advertisement"),
        (_has(low, "sidebar|box item"), "sidebar"),
        (_has(low, "caption|photo|illustration|plate"), "caption"),
        (page.spaced, "multi-column"),
        ((F.length(first) <= 80) & (first == F.upper(first)) & (n <= 25), "article"),
    )


def _newspaper(page: Page) -> Column:
    low, first, n, found = page.low, page.first, page.n, page.found
    return first_of(
        (_has(low, "classifieds?|wanted|for sale|tenders?"), "classifieds"),
        (_has(low, "advertisement|advertiser"), "advertisement"),
        (_has(low, "continued from|continued on"), "continuation"),
        (first.rlike(r"^[A-Z][A-Z .,'-]{6,}$"), "headline"),
        (_has(page.low8, "by|from our correspondent|staff reporter"), "byline"),
        (F.array_join(F.slice(found, 1, 8), "\n").rlike(r"\b[A-Z][a-z]+,\s+[A-Z][a-z]+\.?\s+\d{1,2}\b"), "dateline"),
        (page.spaced, "multi-column"),
    )


def _manuscript(page: Page) -> Column:
    low, first, n, found = page.low, page.first, page.n, page.found
    unclear = F.size(F.split(low, r"\[unclear\]", -1)) - 1
    return first_of(
        (_has(low, r"folio|fol\.|recto|verso") | first.rlike(r"(?i)^(?:f\.?\s*)?\d+[rv]$"), "folio"),
        (_has(low, "marginalia|margin note|in margin"), "marginalia"),
        (_has(low, "correction|inserted|deleted|interlineation"), "correction"),
        (_has(low, "colophon|scribe|copied by|completed by"), "colophon"),
        ((unclear >= 3) | F.contains(low, F.lit("[missing text]")), "damaged"),
        ((n >= 8) & F.forall(F.slice(found, 1, 12), lambda x: F.length(x) <= 90), "lineated-text"),
    )


def _letter(page: Page) -> Column:
    low, first, n, found = page.low, page.first, page.n, page.found
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    return first_of(
        (_has(page.low6, "dear|respected|sir|madam|my dear"), "salutation"),
        (_has(low, "yours faithfully|yours sincerely|sincerely|obediently|signed"), "signature"),
        (_has(low, r"p\.?s\.?|postscript"), "postscript"),
        (low.rlike(r"\b(to|from)\b[^\n]+\b(street|road|district|post|address)\b"), "address"),
        (first.rlike(rf"(?i)\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b(?:{months})\b"), "date-place"),
    )


def _archive(page: Page) -> Column:
    low, first, n, found = page.low, page.first, page.n, page.found
    return first_of(
        (low.rlike(r"\b(file|folder|bundle|box)\s*(no\.?|number|id)?\b"), "folder-label"),
        (_has(low, r"id|identifier|reference|ref\.|case no\.|serial no\."), "identifier"),
        (_has(low, "form|application|register|ledger"), "form"),
        (_has(low, "date|dated"), "date"),
        (low.rlike(r"\b(item|document|record)\s+\d+\b"), "item-boundary"),
        (n <= 35, "record"),
    )


def role_of_kind(page: Page, kind: Column) -> Column:
    """The role by the rules of the document's own type; empty without one."""
    kind = F.lower(text_of(kind))
    rules = {
        "magazine": _magazine, "newspaper": _newspaper, "manuscript": _manuscript, "letter": _letter, "archive bundle": _archive,
    }
    return first_of(*[((kind == name) & (page.n > 0), rule(page)) for name, rule in rules.items()])


def content_role(page: Page, kind: Column, rows: Column, signals: Column, own: Column) -> Column:
    """The first rule that holds, over the first 40 lines and the document's type; `own` is role_of_kind."""
    found, low, n, first_low = page.found, page.low, page.n, F.lower(page.first)
    kind = F.lower(text_of(kind))
    tabular, charted = F.size(rows) > 0, F.size(signals) > 0

    def typed(name: str, words: str) -> Column:
        return (kind == name) & _has(low, words)

    legal, finance = "legal document", "finance document"
    health, insurance = "healthcare document", "insurance document"
    return first_of(
        (F.contains(low, F.lit("contents")), "contents"),
        (charted & (n <= 60) & _has(low, "chart|graph|plot|diagram|axis|legend"), "chart"),
        (tabular & (n <= 80), "table"),
        (low.rlike("preface|foreword"), "preface"),
        (F.contains(first_low, F.lit("abstract")) | (first_low == "summary"), "abstract"),
        (_has(low, "references|bibliography|works cited"),
         F.when(kind == "journal article", "references").otherwise("bibliography")),
        ((kind == "book") & F.contains(low, F.lit("index")), "index"),
        (_has(low, "appendix"), "appendix"),
        (typed("book", "chapter"), "chapter"),
        (kind.isin("book", "journal article", "general") & _has(low, "section|part"), "section"),
        (own != "", own),
        (typed(legal, "parties?|agreement|contract|deed|memorandum|terms and conditions"),
         F.when(n <= 10, "title").otherwise("clauses")),
        (typed(legal, "recitals?|whereas"), "recitals"),
        (typed(legal, "definitions?|defined terms"), "definitions"),
        (typed(legal, "schedule|annex|annexure|exhibit|appendix"), "schedule"),
        (typed(legal, "signatures?|signed by|executed by"), "signature"),
        (typed(finance, "statement|balance sheet|profit and loss|income statement|ledger"), "statement"),
        (typed(finance, "account|invoice|receipt|debit|credit|transaction"), "account"),
        (typed(finance, "total|summary|subtotal|grand total"), "summary"),
        (typed(health, "patient|hospital|clinic|report|diagnosis|prescription"),
         F.when(n <= 10, "title").otherwise("findings")),
        (typed(health, "medication|dose|dosage|treatment|instructions"), "medications"),
        (typed(insurance, "policy|coverage|claim|premium|exclusion|benefit"),
         F.when(n <= 10, "policy").otherwise("coverage")),
        (kind.isin("magazine", "newspaper") & page.spaced, "multi-column"),
        (tabular, "table"),
        (charted, "chart"),
        (page.pictured, "illustrated"),
        otherwise="body",
    )


def is_title_page(found: Column, index: Column, rows: Column, signals: Column) -> Column:
    text_lines = F.filter(found, lambda x: ~is_page_marker(x))
    shaped = F.exists(text_lines, lambda x: F.length(x).between(4, 120) & (x == F.upper(x)))
    credit = F.exists(text_lines, lambda x: x.rlike(r"(?i)\b(by|author|editor|translated by)\b"))
    return (
        (index <= 2) & (F.size(found) > 0) & (F.size(found) <= 18) & (F.size(rows) == 0)
        & (F.size(signals) == 0) & shaped & ((F.size(text_lines) <= 10) | credit)
    )


def content_features(page: Page, role: Column, kind: Column, rows: Column, signals: Column, entries: Column, notes: Column, staged: bool = False) -> Column:
    found = page.found
    low = F.col("_low100") if staged else joined_lower(found, 100)
    wide = F.array_join(F.slice(found, 1, 80), "\n").rlike(r"\S\s{6,}\S")
    aged = role.isin("marginalia", "annotation", "correction", "folio") | (F.lower(text_of(kind)) == "manuscript")
    flags = (
        (page.spaced, "multi_column"),
        (page.pictured, "figure_marker"),
        (F.size(entries) > 0, "contents_entries"),
        (F.size(notes) > 0, "footnotes"),
        (_has(low, "by|from our correspondent|staff reporter"), "byline"),
        (_has(low, "advertisement|classifieds?|wanted|for sale"), "advertising"),
        (_has(low, "caption|photo|illustration|figure|plate|map"), "visual_reference"),
        (wide, "table_or_columns"),
        (F.size(rows) > 0, "table_rows"),
        (F.size(signals) > 0, "chart_candidate"),
        (aged, "manuscript_layout"),
    )
    return F.filter(F.array(*[F.when(c, name) for c, name in flags]), lambda x: x.isNotNull())


def layout_class(role: Column, features: Column) -> Column:
    def has(name: str) -> Column:
        return F.array_contains(features, name)

    return first_of(
        (has("table_rows") | (role == "table"), "tabular"),
        (has("chart_candidate") | (role == "chart"), "chart-led"),
        (has("multi_column"), "multi-column"),
        (role.isin("contents", "references", "bibliography", "index", "classifieds"), "list-like"),
        (role.isin("folio", "marginalia", "lineated-text"), "lineated"),
        (has("table_or_columns"), "tabular-or-columnar"),
        otherwise="single-flow",
    )


def assembly_hint(role: Column, kind: Column) -> Column:
    return first_of(
        (role.isin("title", "cover", "masthead", "cover-sheet", "folder-label"), "front_matter"),
        (role == "contents", "toc"),
        (role.isin("preface", "abstract", "editorial"), "introductory"),
        (role.isin("chapter", "section", "article", "feature", "record", "letter", "body", "lineated-text"), "main_flow"),
        (role.isin("table", "chart", "figure-table"), "tabular"),
        (role.isin("index", "references", "bibliography", "footnotes"), "back_matter"),
        (role.isin("advertisement", "classifieds", "sidebar", "caption", "illustrated"), "supplementary"),
        (F.lower(text_of(kind)) == "archive bundle", "archive_item"),
        otherwise="main_flow",
    )


def layout_confidence(text: Column, role: Column, marker: Column, has_assets: Column) -> Column:
    low = F.lower(text_of(text))
    score = (
        F.lit(0.48)
        + F.when(role.isin("title", "contents", "chapter", "section", "preface", "abstract"), 0.18).otherwise(0.0)
        - F.when(role.isin("marginalia", "damaged"), 0.08).otherwise(0.0)
        + F.least(F.length(text_of(text)) / 1800.0, F.lit(0.2))
        - F.when(is_blank(text), 0.22).otherwise(0.0)
        - F.when(low.rlike(r"\[unclear\]|\[missing text\]"), 0.12).otherwise(0.0)
        + F.when(has_assets, 0.06).otherwise(0.0)
        + F.when(text_of(marker) != "", 0.03).otherwise(0.0)
    )
    return half_even(F.greatest(F.lit(0.05), F.least(score, F.lit(0.99))), 2)


def page_profile(native_flow: Column, native_columns: Column) -> tuple[Column, Column]:
    """(dominant_flow, column_count) from the columns of an observation."""
    features, role = F.col("content_features"), F.col("role")

    def has(name: str) -> Column:
        return F.array_contains(features, name)

    multi = has("multi_column") | (F.col("layout") == "multi-column")
    table = role.isin("table", "chart") | has("table_rows")
    flow = first_of(
        (multi, "multi-column"),
        (table, F.when(role == "chart", "chart-led").otherwise("tabular")),
        (has("table_or_columns"), "tabular"),
        (role.isin("contents", "references", "bibliography", "index"), "structured-list"),
        otherwise="single-flow",
    )
    count = (
        F.when(multi, 2)
        .when(table, F.when(role == "chart", 1).otherwise(2))
        .when(has("table_or_columns"), F.when(F.col("avg_line_length") < 70, 2).otherwise(3))
        .otherwise(1)
    )
    dense = (F.col("line_count") >= 65) & (F.col("avg_line_length") < 62) & (flow == "single-flow")
    flow = first_of((role.isin("title", "cover", "cover-sheet"), "front-matter"), (dense, "dense-prose"), otherwise=flow)
    native = native_flow.isin("multi-column", "figure-led", "dense-prose") & flow.isin("single-flow", "dense-prose")
    return F.when(native, native_flow).otherwise(flow), F.greatest(count, F.coalesce(native_columns, F.lit(0)))


def observe(pages: DataFrame, text: str = "text", kind: str = "document_type", index: str = "page_index") -> DataFrame:
    """The pages with everything that their lines tell; `lines` stays for further use."""
    t, k, i = F.col(text), F.col(kind), F.col(index)
    found = F.col("lines")
    staged, page = Page.of(found).staged(pages.withColumn("lines", lines(t)))
    staged = (
        staged.withColumns({"table_rows": table_rows(found), "chart_signals": chart_signals(found), "_low100": joined_lower(found, 100), "_own": role_of_kind(page, k)})
        .withColumn("_role", content_role(page, k, F.col("table_rows"), F.col("chart_signals"), F.col("_own")))
        .withColumn(
            "role",
            first_of(
                ((F.col("_role") == "body") & (F.size("table_rows") > 0), "table"),
                ((F.col("_role") == "body") & (F.size("chart_signals") > 0) & (F.size("lines") <= 48), "chart"),
                ((F.col("_role") == "body") & is_title_page(found, i, F.col("table_rows"), F.col("chart_signals")), "title"),
                otherwise=F.col("_role"),
            ),
        )
        .drop("_role")
        .withColumns({"_entries": contents_entries(found), "footnotes": footnotes(found)})
    )
    lengths = F.transform(F.slice(found, 1, 80), lambda x: F.length(x))
    mean = let(lengths, lambda v: half_even(F.aggregate(v, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(v), F.lit(1)), 1))
    return (
        staged.withColumn(
            "content_features",
            content_features(page, F.col("role"), k, F.col("table_rows"), F.col("chart_signals"), F.col("_entries"), F.col("footnotes"), True),
        )
        .withColumns(
            {
                "layout": layout_class(F.col("role"), F.col("content_features")),
                "assembly_hint": assembly_hint(F.col("role"), k),
                "contents_entries": F.when(F.col("role") == "contents", F.col("_entries")).otherwise(F.array().cast(f"array<{ENTRY}>")),
                "page_marker": page_marker(found),
                "title_candidates": F.when(i <= 2, F.slice(found, 1, 2)).otherwise(F.array().cast("array<string>")),
                "section_headings": section_headings(found),
                "contributors": contributors(found),
                "publishers": publishers(found),
                "running_header": running_header(found),
                "line_count": F.size(found),
                "avg_line_length": mean,
                "has_figure_marker": page.pictured,
            }
        )
        .drop("_entries", "_low100", "_own", *[f"_page_{f.name}" for f in fields(Page) if f.name != "found"])
    )


def detected_title(candidates: Column, own_words: str = "default") -> Column:
    """The first candidate that reads like a title rather than a marker or a word of the tool."""
    usable = F.filter(
        candidates,
        lambda x: F.length(strip(x)).between(3, 120) & ~is_page_marker(strip(x)) & ~F.lower(x).rlike(own_words)
        & ~((F.length(strip(x)) < 40) & F.lower(x).rlike(r"\b(run|output|restoration|export|workflow)\b")),
    )
    return F.coalesce(strip(F.get(usable, F.lit(0))), F.lit(""))


def paragraph_style(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n\n")), "blank line between paragraphs").otherwise(
        "single line breaks preserved"
    )


def heading_style(found: Column) -> Column:
    def style(x: Column) -> Column:
        n = F.size(F.split(collapse(x), " "))
        return F.when(
            n.between(1, 10) & (x == F.upper(x)) & x.rlike(r"\p{L}"), "short uppercase headings preserved"
        ).when(
            x.rlike(r"(?i)^(chapter|section|part|book|canto|mandala)\b"), "explicit chapter/section headings preserved"
        )

    styles = F.filter(F.transform(F.slice(found, 1, 8), style), lambda s: s.isNotNull())
    return F.coalesce(F.get(styles, F.lit(0)), F.lit(""))


def page_marker_style(found: Column) -> Column:
    def style(x: Column) -> Column:
        return F.when(is_page_marker(x), "standalone page markers preserved").when(
            x.rlike(r"(?i)\bpage\s+\d+\b"), "page labels preserved"
        )

    styles = F.filter(F.transform(_ends(found, 4, 4), style), lambda s: s.isNotNull())
    return F.coalesce(F.get(styles, F.lit(0)), F.lit(""))


# What layout_notes and structures can say, in their order.
LAYOUT_NOTES = (
    "preserve visible table or column spacing when clear", "preserve list item breaks",
    "preserve numbered references and footnote markers",
)
STRUCTURES = ("table-like", "chart-like", "multi-column", "contents-like")


def _those(names: tuple[str, ...], *tests: Column) -> Column:
    return F.filter(F.array(*[F.when(t, n) for n, t in zip(names, tests)]), lambda x: x.isNotNull())


def layout_notes(found: Column) -> Column:
    head = F.slice(found, 1, 80)
    text = F.array_join(head, "\n")
    listed = F.exists(head, lambda x: x.startswith("*") | x.startswith("-"))
    return _those(LAYOUT_NOTES, text.rlike(r"\s{3,}"), listed, text.rlike(r"\[\d+\]|\(\d+\)|\b\d+\."))


def structures(found: Column) -> Column:
    return _those(
        STRUCTURES, F.size(table_rows(found)) > 0, F.size(chart_signals(found)) > 0, has_column_spacing(found),
        F.size(contents_entries(found)) > 0,
    )


# The order in which sections of a document stand.
SECTION_ORDER = (
    "title", "cover", "cover-sheet", "masthead", "contents", "preface", "foreword", "introduction", "chapter", "section",
    "article", "body", "appendix", "index", "references", "bibliography", "footnotes",
)


def section_rank(role: Column) -> Column:
    """Place of a role in the order of sections; roles without one stand with the body."""
    at = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), role)
    return F.when(at == 0, SECTION_ORDER.index("body") + 1).otherwise(at)


def fallback_title(file_name: Column, profile: Column) -> Column:
    """A file's stem in title case, else the profile's name, else a word for none."""

    def shown(x: Column) -> Column:
        return F.initcap(F.trim(F.translate(text_of(x), "_-", "  ")))

    stem = F.regexp_replace(F.element_at(F.split(text_of(file_name), "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(shown(stem), F.lit("")), F.nullif(shown(profile), F.lit("")), F.lit("Untitled"))


def layout_node(order: Column, source: Column) -> Column:
    """A node of the layout tree from the columns of an observation."""
    from .text import excerpt

    return F.struct(
        order.alias("reading_order"), source.alias("source"), F.col("page_marker").alias("page_number"), F.col("role"), F.col("layout"),
        F.col("assembly_hint"), excerpt(F.array_join("lines", " ")).alias("excerpt"),
    )
