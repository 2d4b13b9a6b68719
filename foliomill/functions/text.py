"""Text expressions: white space, lines, cleanup, slugs, predicates and question parsing.

All take and return columns and stay inside the JVM. Null is treated as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as text tools know them: also vertical tab, form feed, separators and NEL.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
PAGE_BREAK = "\n\n\f\n\n"

# Fixed values.
PAGE_MARKER = r"(?i)^(?:page\s*)?[ivxlcdm\d]+$"
BLANK_REASON = "blank page or no readable text"
BLANK_PHRASES = (
    "[missing text]", "[unclear]", "[blank page]", "missing text", "unclear", "blank page",
    "no text", "no readable text", "no visible text",
)
META_MARKERS = ("thinking...", "role:", "task:", "output requirements:", "self-correction", "wait,")
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "what", "which", "from", "into", "about", "have",
    "does", "where", "when", "how", "why", "was", "are", "you", "can", "will", "please",
)
VISUAL_WORDS = (
    "see", "look", "visual", "image", "figure", "diagram", "photo", "poster", "signboard", "chart",
    "what does it show", "what is shown", "describe",
)
SCRIPTS = (
    ("Latin", r"A-Za-z"),
    ("Devanagari", r"ऀ-ॿ"),
    ("Bengali", r"ঀ-৿"),
    ("Gurmukhi", r"਀-੿"),
    ("Gujarati", r"઀-૿"),
    ("Oriya", r"଀-୿"),
    ("Tamil", r"஀-௿"),
    ("Telugu", r"ఀ-౿"),
    ("Kannada", r"ಀ-೿"),
    ("Malayalam", r"ഀ-ൿ"),
    ("Sinhala", r"඀-෿"),
    ("Arabic", r"؀-ۿ"),
)


def let(value: Column, body) -> Column:
    """Bind a value once for use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def half_even(value: Column, places: int) -> Column:
    """Rounded to so many places as doubles, ties to the even digit; as SQL's `round_even` has it.

    `bround` looks at a double's decimal form instead, where other values are ties.
    """
    return F.rint(value * float(10**places)) / float(10**places)


def strip(value: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text_of(value), r"(?U)^\s+|\s+$", "")


def collapse(value: Column) -> Column:
    return F.regexp_replace(strip(value), r"(?U)\s+", " ")


def lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text_of(text), LINE_END, -1), strip), lambda x: x != "")


def joined_lower(found: Column, n: int) -> Column:
    return F.lower(F.array_join(F.slice(found, 1, n), "\n"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(text), "\n\n", -1), strip), lambda x: x != "")


def restore_offline(text: Column) -> Column:
    """The deterministic restoration: line ends, hyphens at line ends, spaces and blank lines."""
    text = text_of(text)
    # Only what follows the first source marker is text to restore.
    chunk, source = F.instr(text, F.lit("SOURCE CHUNK\n")), F.instr(text, F.lit("SOURCE TEXT\n"))
    body = (
        F.when(chunk > 0, F.substring(text, chunk + len("SOURCE CHUNK\n"), F.length(text)))
        .when(source > 0, F.substring(text, source + len("SOURCE TEXT\n"), F.length(text)))
        .otherwise(text)
    )
    body = F.regexp_replace(body, r"\r\n?", "\n")
    body = F.regexp_replace(body, r"-\n([A-Za-z])", "$1")
    body = F.regexp_replace(body, r"[ \t]+", " ")
    body = F.regexp_replace(body, r"\n{3,}", "\n\n")
    return F.concat(strip(body), F.lit("\n"))


def excerpt(text: Column, limit: int = 120) -> Column:
    one = collapse(text)
    cut = F.regexp_replace(F.substring(one, 1, limit - 1), r"(?U)\s+$", "")
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(cut, F.lit("…")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text_of(text), r"(?U)\s+", -1), lambda x: x != "")


def recent_words(text: Column, n: int) -> Column:
    return let(
        tokens(text),
        lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), " "),
    )


def join_notes(*notes: Column) -> Column:
    return F.array_join(F.filter(F.array(*[strip(n) for n in notes]), lambda x: x != ""), "; ")


def slug(value: Column, default: str = "item") -> Column:
    """Lower case; anything but letters and digits of any script becomes one dash."""
    made = F.regexp_replace(F.lower(strip(value)), r"[^\p{L}\p{N}]+", "-")
    made = F.regexp_replace(made, "^-+|-+$", "")
    return F.when(made == "", F.lit(default)).otherwise(made)


def ascii_slug(value: Column, default: str = "item") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(strip(value)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", F.lit(default)).otherwise(made)


def profile_name(value: Column, default: str = "default") -> Column:
    made = F.regexp_replace(F.regexp_replace(strip(value), r"[^A-Za-z0-9_.-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(made == "", F.lit(default)).otherwise(made)


def label_parts(label: Column) -> Column:
    parts = F.filter(
        F.transform(F.split(F.translate(text_of(label), "\\", "/"), "/", -1), strip),
        lambda x: (x != "") & ~x.isin(".", ".."),
    )
    return F.when(F.size(parts) == 0, F.array(F.lit("root"))).otherwise(parts)


def numbered_folder(index: Column, label: Column) -> Column:
    """Slugs of the label's parts, the last one with the source's number before it."""

    def path(p: Column) -> Column:
        folders = F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: slug(x))
        last = F.concat_ws("-", F.format_string("%04d", index), slug(F.element_at(p, -1)))
        return F.array_join(F.concat(folders, F.array(last)), "/")

    return let(label_parts(label), path)


def folder_label(label: Column) -> Column:
    return let(
        label_parts(label),
        lambda p: F.when(F.size(p) <= 1, F.lit("root")).otherwise(
            F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "/")
        ),
    )


def visible(text: Column) -> Column:
    """Without zero-width, soft-hyphen, variation and control characters; tabs become spaces."""
    kept = F.regexp_replace(text_of(text), r"[​-‏⁠﻿­︀-️]", "")
    return F.regexp_replace(F.translate(kept, "\t", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def match_text(text: Column) -> Column:
    return F.lower(collapse(text))


def scripts(text: Column) -> Column:
    """Scripts with at least one letter in the text, in a fixed order."""
    text = text_of(text)
    return F.filter(
        F.array(*[F.when(text.rlike(rf"(?=\p{{L}})[{r}]"), F.lit(name)) for name, r in SCRIPTS]),
        lambda x: x.isNotNull(),
    )


def elapsed(seconds: Column) -> Column:
    whole = F.greatest(seconds.cast("long"), F.lit(0))
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def title_of_question(question: Column) -> Column:
    """The first five words in title case, with dots if there are more."""
    return let(
        tokens(question),
        lambda w: F.concat(
            F.initcap(F.array_join(F.slice(w, 1, 5), " ")), F.when(F.size(w) > 5, "...").otherwise("")
        ),
    )


def question_terms(question: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text_of(question)), F.lit(r"[a-z0-9][a-z0-9-]+"), F.lit(0))
    return F.slice(F.filter(found, lambda t: ~t.isin(*STOP_WORDS)), 1, 20)


def question_pages(question: Column) -> Column:
    """Page numbers that a question names, end points of ranges included, ascending."""
    q = text_of(question)

    def every(pattern: str, group: int) -> Column:
        return F.transform(
            F.filter(F.regexp_extract_all(q, F.lit(pattern), F.lit(group)), lambda x: x != ""),
            lambda x: x.cast("int"),
        )

    one = r"(?i)\bpage\s*(\d{1,4})\b"
    short = r"(?i)\bpp?\.?\s*(\d{1,4})(?:\s*[-–]\s*(\d{1,4}))?"
    many = r"(?i)\bpages?\s*(\d{1,4})(?:\s*[-–/]\s*(\d{1,4}))?"
    return F.array_sort(
        F.array_distinct(F.concat(every(one, 1), every(short, 1), every(short, 2), every(many, 1), every(many, 2)))
    )


def wants_picture(question: Column) -> Column:
    low = F.lower(text_of(question))
    return F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in VISUAL_WORDS]), True)


def escape_xml(text: Column) -> Column:
    out = text_of(text)
    for raw, made in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(made))
    return out


def is_blank(text: Column) -> Column:
    """Blank, or nothing but marks for text that could not be read."""
    low = F.regexp_replace(F.lower(collapse(text)), r"^[. ]+|[. ]+$", "")
    return low.rlike(r"^(?:\[unclear(?::[^\]]*)?\]\s*)+$") | low.isin(*BLANK_PHRASES)


def is_meta(text: Column) -> Column:
    """Commentary of a model rather than text."""
    return F.lower(text_of(text)).rlike("|".join(m.replace(".", r"\.") for m in META_MARKERS))


def is_page_marker(line: Column) -> Column:
    return line.rlike(PAGE_MARKER)


def is_export_marker(text: Column) -> Column:
    """All digits, or all Roman numerals, after an optional word for page."""
    low = F.replace(F.lower(strip(text)), F.lit("page "), F.lit(""))
    return low.rlike(r"^(?:\d+|[ivxlcdm]+)$")


def is_printed_marker(text: Column) -> Column:
    """A page marker as print shows it: digits and Roman letters, mixed or not, after an optional word for page."""
    return strip(text).rlike(r"(?i)^(?:page\s*)?[ivxlcdm\d]+$")


# Words that a printed heading begins with.
PRINTED_HEADS = (
    "chapter", "section", "part", "book", "preface", "foreword", "introduction", "appendix", "index", "abstract", "references",
    "bibliography", "editorial", "feature", "article", "letter", "record", "schedule", "clauses", "definitions", "policy", "coverage",
    "claim", "findings", "diagnosis", "medications", "instructions",
)


def is_printed_heading(line: Column) -> Column:
    """At most 90 characters: four or more in capitals, or a heading's word at the start."""
    capitals = (line == F.upper(line)) & (F.length(line) >= 4)
    return (line != "") & (F.length(line) <= 90) & (capitals | F.lower(line).rlike(rf"^({'|'.join(PRINTED_HEADS)})\b"))


def is_heading(line: Column) -> Column:
    upper = line == F.upper(line)
    keyword = line.rlike(r"(?i)^(chapter|section|part|book|preface|contents|index|appendix)\b")
    return F.length(line).between(2, 90) & (upper | keyword)


def is_heading_line(text: Column) -> Column:
    """One line of at most twelve words whose letters are mostly capitals."""
    one = collapse(text)
    letters = F.length(F.regexp_replace(one, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(one, r"[^\p{Lu}]", ""))
    return (
        (one != "") & ~F.contains(text_of(text), F.lit("\n")) & (F.size(F.split(one, " ")) <= 12)
        & (letters > 0) & (capitals >= 0.72 * letters)
    )


def is_body_line(line: Column) -> Column:
    """Prose rather than an entry of a list: long, with a sentence break, or with function words."""
    n = F.size(F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0)))
    return (n >= 4) & (
        ((F.length(line) > 95) & ~line.rlike(r"\.{2,}|\s{2,}|[|:]-?\s*"))
        | line.rlike(r"[.!?]\s+[A-Z]")
        | ((n >= 8) & line.rlike(r"(?i)\b(and|or|but|the|this|that|with|from|into|upon|which)\b"))
    )


def has_column_spacing(found: Column) -> Column:
    return F.size(F.filter(F.slice(found, 1, 80), lambda x: x.rlike(r"\S\s{4,}\S"))) >= 2


def ordered_distinct(values: Column, limit: int) -> Column:
    """The first occurrences, case aside, of non-blank values, at most `limit`."""

    def kept(v: Column) -> Column:
        return let(
            F.transform(v, F.lower),
            lambda low: F.slice(F.filter(v, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1), 1, limit),
        )

    return let(F.filter(F.transform(values, strip), lambda x: x != ""), kept)


def wrap(text: Column, width: int = 76) -> Column:
    """Lines of whole words within a width; a longer word is a line of its own."""
    # The longest run within the width that ends where a word does, or else a whole word: one pass.
    line = rf"[^ ](?:.{{0,{max(width - 2, 0)}}}[^ ])?(?= |\z)|[^ ]+"
    return F.regexp_extract_all(F.array_join(tokens(text), " "), F.lit(f"(?s){line}"), F.lit(0))


def usage_sentence(item: Column, total: Column) -> Column:
    """Tokens of one unit and of the run; both are structs of counts and a truncated flag."""

    def counts(u: Column) -> tuple[Column, Column, Column]:
        i, o = F.coalesce(u["prompt_tokens"], F.lit(0)), F.coalesce(u["completion_tokens"], F.lit(0))
        return F.coalesce(F.nullif(u["total_tokens"], F.lit(0)), i + o), i, o

    cut = F.coalesce(item["truncated"], F.lit(False)) | F.coalesce(total["truncated"], F.lit(False))
    return F.concat(
        F.format_string("tokens this page: %d (input %d, output %d); ", *counts(item)),
        F.format_string("run total: %d (input %d, output %d)", *counts(total)),
        F.when(cut, " truncated").otherwise(""),
    )
