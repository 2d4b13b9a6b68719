"""Normalizers over enumerations, and budgets by execution mode."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of

# Fixed values.
TRANSLATION_MODES = (
    "auto", "off", "same-language-cleanup", "translate", "bilingual", "transliterate", "metadata-only",
)
TRANSLATION_ALIASES = {
    "on": "translate",
    "yes": "translate",
    "true": "translate",
    "cleanup": "same-language-cleanup",
    "same-language": "same-language-cleanup",
    "translit": "transliterate",
    "transliteration": "transliterate",
    "metadata": "metadata-only",
}
STRICT_POLICIES = ("strict", "source-only", "strict-source", "input-only")
FAILURE_REASONS = (
    "blank page or no readable text",
    "source unreadable or too blurry",
    "page rendering or OCR dependency missing",
    "model context or output limit reached",
    "provider timeout",
    "model does not support the selected script or language",
    "model returned malformed output",
    "network or API error",
)
DOCUMENT_TYPES = (
    "Book", "Manuscript", "Newspaper", "Magazine", "Journal article", "Letter", "Archive bundle",
    "Legal document", "Finance document", "Healthcare document", "Insurance document", "General",
)
BACKEND_ALIASES = {"default": "native", "heuristic": "native", "none": "off", "disabled": "off", "disable": "off"}
REGION_ROLES = {
    "text-region": ("text-region", "text", "paragraph", "body", "prose", "content"),
    "title-region": ("title-region", "title", "heading", "subtitle"),
    "table-region": ("table-region", "table", "grid", "ledger", "register"),
    "figure-region": (
        "figure-region", "figure", "image", "illustration", "photo", "photograph", "plate", "map", "drawing",
        "decoration",
    ),
    "chart-region": ("chart-region", "chart", "diagram", "graph"),
    "running-header-or-footer": (
        "running-header-or-footer", "footer", "marginalia", "folio", "header", "running-header",
    ),
    "caption-region": ("caption-region", "caption"),
    "list-region": ("list-region", "list", "numbered-list", "bullet-list", "bullet", "numbered"),
    "equation-region": ("equation-region", "equation", "formula", "math"),
    "page-number-region": ("page-number", "page-no", "small-mark-or-page-number", "page_number"),
    "separator-region": ("separator-region", "separator", "line", "rule", "divider", "horizontal-rule"),
}
DELETED_ROLES = ("none", "ignore", "background", "noise", "margin")
VISION_HINTS = (
    "vision", "vl", "llava", "moondream", "minicpm-v", "gemma3", "pixtral", "gpt-4o", "gpt-4.1", "gpt-5",
    "claude", "gemini", "ocr",
)


def _lookup(value: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, value)


def _clean(value: Column, default: str) -> Column:
    text = F.when(text_of(value) == "", F.lit(default)).otherwise(text_of(value))
    return F.replace(F.lower(F.trim(text)), F.lit("_"), F.lit("-"))


def translation_mode(value: Column) -> Column:
    mode = _clean(value, "auto")
    mode = F.coalesce(_lookup(mode, TRANSLATION_ALIASES), mode)
    return F.when(mode.isin(*TRANSLATION_MODES), mode).otherwise("auto")


def language(value: Column) -> Column:
    name = _clean(value, "")
    return F.when(name == "", "auto").otherwise(name)


def translation_required(source: Column, target: Column, mode: Column) -> Column:
    mode, source, target = translation_mode(mode), language(source), language(target)
    return (
        F.when(mode.isin("off", "same-language-cleanup", "metadata-only"), False)
        .when(mode.isin("translate", "bilingual", "transliterate"), True)
        .when(target.isin("same", "auto"), False)
        .when(source.isin("auto", "unknown"), True)
        .otherwise(source != target)
    )


def effective_mode(source: Column, target: Column, mode: Column) -> Column:
    named = translation_mode(mode)
    required = translation_required(source, target, F.lit("auto"))
    return F.when(named != "auto", named).otherwise(F.when(required, "translate").otherwise("off"))


def profile_mode(source: Column, target: Column, mode: Column) -> Column:
    """`off` gives way to `auto` where the languages differ."""
    named = translation_mode(mode)
    required = translation_required(source, target, F.lit("auto"))
    return F.when((named == "off") & required, "auto").otherwise(named)


def language_policy(value: Column) -> Column:
    strict = _clean(value, "preserve-detected").isin(*STRICT_POLICIES)
    return F.when(strict, "strict-source").otherwise("preserve-detected")


def layout_backend(value: Column) -> Column:
    name = _clean(value, "native")
    name = F.coalesce(_lookup(name, BACKEND_ALIASES), name)
    return F.when(name.rlike(r"^[\p{L}\p{N}-]+$"), name).otherwise("native")


def execution_mode(value: Column) -> Column:
    return F.when(text_of(value).isin("fast", "balanced", "quality"), value).otherwise("balanced")


def is_vision_model(name: Column) -> Column:
    return F.lower(text_of(name)).rlike("|".join(x.replace(".", r"\.") for x in VISION_HINTS))


def region_role(value: Column) -> Column:
    """One of eleven region roles, `delete` for noise, null for unknown names."""
    named = {x: role for role, names in REGION_ROLES.items() for x in names} | dict.fromkeys(DELETED_ROLES, "delete")
    return _lookup(F.lower(F.trim(text_of(value))), named)


def budget(mode: Column, what: str) -> Column:
    """Retries, reviews or figure verifications that an execution mode allows."""
    allowed = {"retries": (0, 1, 3), "reviews": (0, 1, 3), "verifications": (0, 1, 4)}[what]
    low = F.lower(F.trim(text_of(mode)))
    return F.when(low == "fast", allowed[0]).when(low == "quality", allowed[2]).otherwise(allowed[1])


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next attempt, doubling from a half up to eight."""
    return F.least(F.lit(0.5) * F.pow(F.lit(2.0), attempt), F.lit(8.0))
