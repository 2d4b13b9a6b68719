"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

The base patterns find email addresses, IPv4 addresses, card numbers and phone numbers. They are
the seeds of the method: the words before an instance are its lexical pattern, every token with a
digit or an at sign is a possible instance, and the two sides form a graph with an edge for each
pair that occurs. Scores go back and forth over the edges: a pattern's score is the smoothed mean
of its instances' confidence, an instance's confidence the best score of its patterns, while seeds
keep confidence 1. All edges take part in every round, so that a pattern without seeds can be
brought in by instances that other patterns made confident. After `ROUNDS` rounds, tokens behind
patterns of a high score, with enough distinct confident instances, and whose words are seldom
followed by anything else, are reported as `ident` spans.

Everything is column expressions and aggregates that combine before the shuffle. The support that a
pattern needs does not depend on the size of the corpus. Possible instances are found in one pass and
written with their rows and places, so that neither the graph nor the spans need a second one.

Rows are known by a digest of doc_id and text, so that rows that share a doc_id, or have none, are
each scanned by themselves.

Defined cases: a null text is empty and has no spans; a null doc_id is a row like any other;
repeated rows are scanned each, and their repeated instances count once; an empty table gives an
empty result; other columns, whatever their names, are carried along by `scan`, but for those it
makes, which it replaces. Matching takes time linear in the text: no pattern backtracks over a run
twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import find, joined, tagged
from .text import ascii_lower, fresh, let, named, row_key, whole, words, written

#: The kinds in their order, with their patterns. The runs are possessive, and a match
#: starts where a run starts or where the last match ended, so that each run is read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
BASE_PARTS = (EMAIL, IP, r"[0-9](?:-?[0-9]){15}")
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

#: Possible identifiers: tokens of these characters, at least six, with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[A-Za-z#._%+/-]*[0-9@])[A-Za-z0-9@#._%+/-]{6,}+(?![^\x20\x09-\x0D,;:!?)])"
#: Characters before an instance that hold its two words as a rule; where they do not, all are read.
NEAR = 48
#: The first screen of patterns counts their words in one of so many texts.
SCREEN = 16
ROUNDS = 3
#: Distinct seeds, or other instances of at least `MIN_SCORE`, and score that a pattern needs, and
#: the weight of doubt in its score.
MIN_SEEDS = 10
MIN_SCORE = 0.8
#: Of all places where a pattern's words occur, the share that an instance follows.
MIN_SHARE = 0.2
DOUBT = 2.0


def base_spans(text: Column, before: Callable[[Column], Column] | None = None) -> dict[str, Column]:
    def digits(x: Column) -> Column:
        return F.regexp_replace(x["value"], "[^0-9]", "")

    return {
        "email": find(text, EMAIL, before),
        "ip": F.filter(find(text, IP, before), lambda x: x["value"].rlike(IP_PARTS)),
        "card": F.filter(
            find(text, CARD, before),
            lambda x: F.length(digits(x)).between(16, 19) & luhn(digits(x)),
        ),
        "phone": F.filter(find(text, PHONE, before), lambda x: F.length(digits(x)).between(8, 15)),
    }


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def pattern_of(before: Column) -> Column:
    """The last two words before an instance, lower-cased, digits alike; null with fewer words."""
    two = r"((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){2})$"
    all_of = F.regexp_extract(before, r"(?:^|[\x20\x09-\x0D])" + two, 1)
    near = F.regexp_extract(F.substring(before, -NEAR, NEAR), r"[\x20\x09-\x0D]" + two, 1)
    said = F.when(F.length(before) <= NEAR, all_of).otherwise(F.coalesce(F.nullif(near, F.lit("")), all_of))
    return let(
        said,
        lambda x: F.when(
            x != "", F.regexp_replace(F.regexp_replace(ascii_lower(x), r"[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")
        ),
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(row, pattern, instance, seed, loose, start, end): all seeds and possible instances.

    `loose` tells possible instances of which no part is a base match.
    """
    kinds = base_spans(whole(), pattern_of)
    seen = docs.select(
        row_key("text", "doc_id").alias("row"),
        *[c.alias(k) for k, c in kinds.items()],
        find(whole(), TOKEN, pattern_of).alias("tokens"),
    ).where(F.size("tokens") + sum((F.size(k) for k in KINDS), F.lit(0)) > 0)

    def listed(found: str, seed: int) -> Column:
        return F.transform(found, lambda x: F.struct(x.alias("x"), F.lit(seed).alias("seed")))

    every = F.concat(*[listed(k, 1) for k in KINDS], listed("tokens", 0))
    return (
        seen.select("row", F.explode(every).alias("at"))
        .where(F.col("at.x.before").isNotNull())
        .select(
            "row",
            F.col("at.x.before").alias("pattern"),
            F.xxhash64("at.x.value").alias("instance"),
            "at.seed",
            ((F.col("at.seed") == 0) & ~F.col("at.x.value").rlike("|".join(BASE_PARTS))).alias("loose"),
            "at.x.start",
            "at.x.end",
        )
    )


def graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, seed, times): the distinct edges between patterns and instances."""
    return found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times"))


def patterns(
    docs: DataFrame,
    found: DataFrame,
    rounds: int = ROUNDS,
    min_seeds: int = MIN_SEEDS,
    min_score: float = MIN_SCORE,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(pattern, score): the lexical patterns of these mentions that may discover identifiers."""
    if rounds < 1:
        raise ValueError("at least one round is needed")
    edges = written(graph(found), "graph")
    trusted = edges.withColumn("confidence", F.col("seed").cast("double"))
    for i in range(rounds):
        if i:
            best = written(
                edges.join(scored.select("pattern", "score"), "pattern").groupBy("instance").agg(F.max("score").alias("best")),
                "best",
            )
            trusted = edges.join(best, "instance").withColumn(
                "confidence", F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.col("best"))
            )
        scored = written(
            trusted.groupBy("pattern").agg(
                (F.round(F.sum("confidence"), 9) / (F.count(F.lit(1)) + DOUBT)).alias("score"),
                F.count_if(F.col("confidence") >= min_score).alias("sure"),
            ),
            "scores",
        )
    sure = scored.where((F.col("score") >= min_score) & (F.col("sure") >= min_seeds)).select("pattern", "score")
    shown = edges.groupBy("pattern").agg(F.sum("times").alias("shown"))
    likely = written(sure.join(shown, "pattern"), "likely")

    def often(listed: DataFrame, among: DataFrame, name: str) -> DataFrame:
        counted = occurrences(among, listed).withColumnRenamed("pattern", "counted")
        joined = listed.join(counted, F.col("pattern") == F.col("counted"), "left")
        share = F.col("shown") >= min_share * F.coalesce("occurs", F.lit(0))
        return written(joined.where(share).select("pattern", "score", "shown"), name)

    if not likely.take(1):
        return likely
    # What occurs too often in a part of the texts does so in all of them: such patterns are out for
    # certain, and the words of all texts are counted for the others.
    part = docs.where(F.pmod(F.xxhash64(whole()), F.lit(SCREEN)) == 0)
    return often(often(likely, part, "screened"), docs, "strong")


def occurrences(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(pattern, occurs): how often the words of listed patterns occur, whatever follows them."""
    found = words(F.regexp_replace(ascii_lower(whole()), r"[0-9]+", "0"))
    pairs = let(
        found,
        lambda w: F.zip_with(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
            F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b, F.lit(" ")),
        ),
    )
    return (
        docs.select(F.explode(pairs).alias("pattern"))
        .join(listed.select("pattern"), "pattern", "left_semi")
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("occurs"))
    )


def scan(docs: DataFrame, found_by: DataFrame | None = None) -> DataFrame:
    """The documents with `email`, `ip`, `card`, `phone` and `ident`: arrays of their spans."""
    made = (*KINDS, "ident")
    kept = docs.select(*[named(c) for c in docs.columns if c.lower() not in made])
    found = written(mentions(docs), "mentions")
    strong = patterns(docs, found) if found_by is None else found_by
    row, own = fresh(kept, "row", "own")
    span = F.struct("start", "end")
    loose = written(
        found.where("loose")
        .join(strong.select("pattern"), "pattern", "left_semi")
        .groupBy(F.col("row").alias(own))
        .agg(F.collect_set(span).alias("ident")),
        "ident",
    )
    base = [F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k, c in base_spans(whole()).items()]
    keyed = kept.select("*", row_key("text", "doc_id").alias(row), *base)
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = keyed.join(loose, F.col(row) == F.col(own), "left")
    return out.withColumn("ident", F.coalesce("ident", none)).drop(row, own)


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    base = F.concat(*[tagged(F.col(k), k, i, True) for i, k in enumerate(KINDS)])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, tagged(F.col("ident"), "ident", 4, True))).alias("spans"),
        F.size("ident").cast("long").alias("n_ident"),
    )
