"""Quality rules: per-text counts, and lines that a host repeats over many documents.

The base rule reads one text: too few words, or too many words in repeated three-word windows.
The method then looks across documents: lines are normalised and digested, distinct documents
counted per host and line, lines above the host's limit removed (the smallest doc_id of the host
that holds a line keeps it, so that a text never vanishes with all its copies), and documents
that keep too small a part of their words rejected. `judge` counts what the limits take away and
`keep_good` also removes it from the texts.

Rows are known by a digest of doc_id, source and text: rows that share a doc_id, or have none, are
each judged and cut by their own lines.

Defined cases: a null text has no words, so the base rule fails it; a null source is a host of
its own; rows that share a doc_id count as one document of their host, and so do all rows of a
host without one; repeated rows are judged alike; an empty table gives an empty result; `keep_good`
carries other columns along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE_RUN, SPACES, ascii_lower, digest, forget, let, named, row_key, sent, whole, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is over the limit in more documents of a host than both of these allow.
LINE_MIN_DOCS = 50
LINE_MAX_SHARE = 0.01
#: A document with a smaller part of its words left is depleted.
MIN_LEFT_SHARE = 0.3


def window_hashes(found: Column) -> Column:
    """One 64-bit hash for each three-word window."""
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(
            F.zip_with(
                F.zip_with(
                    F.slice(h, 1, F.size(h) - 2),
                    F.slice(h, 2, F.size(h) - 2),
                    lambda a, b: F.xxhash64(a, b),
                ),
                F.slice(h, 3, F.size(h) - 2),
                lambda a, b: F.xxhash64(a, b),
            )
        ),
    )


def _covered(starts: Column) -> Column:
    """Words under three-word windows at these ascending starts."""
    return let(
        starts,
        lambda p: F.coalesce(
            F.aggregate(
                F.zip_with(
                    p,
                    F.slice(p, 2, F.greatest(F.size(p), F.lit(1))),
                    lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))),
                ),
                F.lit(0).cast("bigint"),
                lambda n, x: n + x,
            ),
            F.lit(0).cast("bigint"),
        ),
    )


def repeated_words(windows: str) -> Column:
    """Words in windows found twice or more, from a column of window hashes.

    Repeats are found by sorting (hash, place) pairs, in n log n steps for a text of n words. All 64
    bits of a hash are compared, in texts of every length; texts without equal hashes skip the sort.
    """
    t = F.col(windows)
    pairs = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i"))))
    twins = let(
        pairs,
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda p, i: ((i > 0) & (F.get(s, i - 1)["x"] == p["x"]))
                    | ((i < F.size(s) - 1) & (F.get(s, i + 1)["x"] == p["x"])),
                ),
                lambda p: p["i"],
            )
        ),
    )
    none = F.lit(0).cast("bigint")
    return F.when(F.size(F.array_distinct(t)) == F.size(t), none).otherwise(_covered(twins))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(docs: DataFrame, *kept: Column) -> DataFrame:
    """The kept columns with the base rule's counts."""
    lines = F.filter(F.split(whole(), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    said = docs.select(
        F.struct(*kept).alias("kept"),
        words(whole()).alias("words"),
        (F.length(whole()) - F.length(F.regexp_replace(whole(), r"[#*$%&|<>]", ""))).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    )
    return (
        said.select(
            "kept",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.col("n_symbols").cast("long"),
            F.col("n_dup_lines").cast("long"),
            window_hashes(F.col("words")).alias("windows"),
        )
        .withColumn("n_repeat_words", repeated_words("windows"))
        .drop("windows")
    )


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _row() -> Column:
    return row_key("text", "doc_id", "source")


def host_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: its row, document, host, place, digest, and words."""
    stripped = F.transform(F.split(whole(), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    return (
        docs.select(
            _row().alias("row"),
            F.col("doc_id").alias("doc"),
            _host().alias("host"),
            F.posexplode(stripped).alias("pos", "line"),
        )
        .where(F.col("line") != "")
        .select(
            "row", "doc", "host", "pos",
            digest(ascii_lower(F.col("line"))).alias("key"),
            F.size(words(F.col("line"), SPACE_RUN)).alias("n"),
        )
    )


def lost_lines(
    docs: DataFrame, min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE
) -> DataFrame:
    """(row, gone): the (place, words) of the lines that each row loses to its host's limits.

    The lines are exploded and digested once and written; the result is a written table.
    """
    lines = written(host_lines(docs), "hostlines")
    # Rows that share a doc_id are one document here as they are among a line's holders.
    known = docs.select(_host().alias("host"), F.col("doc_id")).distinct()
    hosts = known.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    over = written(
        lines.select("host", "key", "doc")
        .distinct()
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("doc").alias("keeper"))
        .where(F.col("holders") > min_docs)
        .join(hosts, "host")
        .where(F.col("holders") > max_share * F.col("host_docs"))
        .select("host", "key", "keeper"),
        "over",
    )
    lost = written(
        lines.join(over, ["host", "key"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("row")
        .agg(F.collect_set(F.struct("pos", "n")).alias("gone")),
        "lost",
    )
    forget(lines, over)
    return lost


def _verdict(min_left: float) -> tuple[Column, Column]:
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return failed, ~failed & (F.col("n_words") - F.col("lost_words") >= min_left * F.col("n_words"))


def _judged(docs: DataFrame, min_docs: int, max_share: float, *kept: Column) -> DataFrame:
    """The kept columns as a struct, the counts, `gone` and `lost_words`; one pass, one join."""
    lost = sent(lost_lines(docs, min_docs, max_share), "gone").withColumnRenamed("row", "lost_row")
    counts = text_counts(docs, _row().alias("row"), *kept)
    return counts.join(lost, F.col("kept.row") == F.col("lost_row"), "left").withColumn(
        "lost_words",
        F.coalesce(F.aggregate("gone", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long"),
    )


def judge(
    docs: DataFrame,
    min_docs: int = LINE_MIN_DOCS,
    max_share: float = LINE_MAX_SHARE,
    min_left: float = MIN_LEFT_SHARE,
) -> DataFrame:
    """Counts and verdict for each document; `lost_words` is what the line limits take away."""
    failed, kept = _verdict(min_left)
    return _judged(docs, min_docs, max_share, F.col("doc_id")).select(
        "kept.doc_id", *COUNTS, "lost_words", failed.alias("base_failed"), kept.alias("kept")
    )


def keep_good(
    docs: DataFrame,
    min_docs: int = LINE_MIN_DOCS,
    max_share: float = LINE_MAX_SHARE,
    min_left: float = MIN_LEFT_SHARE,
) -> DataFrame:
    """The documents that pass, with their own columns, without the lines over their host's limit.

    `n_chars`, if there, follows the text where it is cut.
    """
    every = F.struct(*[named(c) for c in docs.columns]).alias("every")
    good = _judged(docs, min_docs, max_share, every).where(_verdict(min_left)[1])
    text = F.col("kept.every.text")
    rest = let(
        F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"),
        lambda x: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.transform("gone", lambda g: g["pos"])),
                lambda i: F.get(x, i),
            ),
            "\n",
        ),
    )
    good = good.select("kept.every", F.col("gone").isNull().alias("as_was"), F.when(F.col("gone").isNull(), text).otherwise(rest).alias("cut"))
    out = []
    for c in docs.columns:
        value = F.col("every")[c]
        if c.lower() == "text":
            value = F.col("cut")
        elif c.lower() == "n_chars":
            value = F.when(F.col("as_was"), value).otherwise(F.length("cut").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return good.select(*out)
