"""Secret scans: fixed patterns, and random strings told from ordinary identifiers.

The base patterns find assigned values, access keys and hexadecimal runs. The method adds `random`
spans: two character Markov models of first order, one of random strings, one of ordinary
identifiers, are counted from labelled samples, and a long token that no base span touches is
reported if the log-likelihood ratio favours randomness clearly, in all and for each transition.

The samples are labelled by rules: values of base matches are the random strings; tokens that touch
no base span and in which no digit stands before a letter are the ordinary ones. They come from all
documents. The driver gets the transition counts: at most 2 * 67 * 67 numbers, whatever the corpus.
Few samples, or none, fall back smoothly on the prior: all characters alike for random strings, and
for ordinary ones as well, so that without ordinary samples no token stands out.

All of it is column expressions; nothing is shuffled but the transition counts, combined before.

Defined cases: a null text is empty and has no spans; a null doc_id is a row like any other;
repeated rows are scanned each; an empty table gives an empty result; other columns, whatever their
names, are carried along by `scan`, but for those it makes, which it replaces; matches are found in
the whole text, in time n log n in its matches and linear in its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import apart, find, joined, tagged
from .text import fresh, let, named, whole, written

#: The kinds in their order, with their patterns.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET)
#: Transitions that the characters' own frequencies count for in each row, and characters that
#: equal frequencies count for in those.
PRIOR = 10.0
EVEN = 200.0
#: Log-likelihood ratios, in nats: of the whole token, and for each transition.
MIN_RATIO = 12.0
MIN_MEAN_RATIO = 0.6


def base_spans(text: Column) -> dict[str, Column]:
    """Found spans by kind; runs shorter than their kind's minimum cannot match."""
    assigned = find(text, ASSIGN)
    return {
        "assign": F.filter(
            assigned, lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= MIN_VALUE
        ),
        "access": find(text, ACCESS),
        "hex": find(text, HEX),
    }


def _loose(tokens: Column, kinds: dict[str, Column]) -> Column:
    """Tokens that no base span touches; hexadecimal runs and access keys lie inside one token."""
    return apart(F.filter(tokens, lambda t: ~t["value"].rlike(f"{HEX}|{ACCESS}")), kinds["assign"])


def _moves(value: Column) -> Column:
    """The transitions of a string as (a, b), in time linear in it; -1 stands for other characters."""
    places = F.transform(F.split(value, ""), lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("int"))

    def pairs(p: Column) -> Column:
        rest = F.greatest(F.size(p) - 1, F.lit(0))
        return F.zip_with(F.slice(p, F.lit(1), rest), F.slice(p, F.lit(2), rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(places, pairs)


BASE = ("assign", "access", "hex")


def read_spans(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The rows with `assign`, `access` and `hex`, arrays of their base spans, and the loose tokens of their texts."""
    found = docs.select("*", *[c.alias(k) for k, c in base_spans(whole()).items()], find(whole(), TOKEN).alias(tokens))
    return found.withColumn(tokens, _loose(F.col(tokens), {k: F.col(k) for k in BASE}))


def span_transitions(spans: DataFrame) -> DataFrame:
    """(random, a, b, n): transitions in the labelled strings of read spans; -1 stands for other characters."""
    values = F.concat(
        F.transform("assign", lambda x: F.regexp_extract(x["value"], ASSIGN, 2)),
        F.transform("access", lambda x: x["value"]),
        F.transform("hex", lambda x: x["value"]),
    )
    plain = F.filter(F.transform("tokens", lambda x: x["value"]), lambda v: ~v.rlike("[0-9][A-Za-z]"))

    def labelled(found: Column, random: bool) -> Column:
        return F.transform(found, lambda v: F.struct(v.alias("value"), F.lit(random).alias("random")))

    strings = spans.select(
        F.inline(F.concat(labelled(F.filter(values, lambda v: F.length(v) >= 16), True), labelled(plain, False)))
    )
    cells = strings.select("random", F.explode(_moves(F.col("value"))).alias("cell"))
    return cells.groupBy("random", "cell.a", "cell.b").agg(F.count(F.lit(1)).alias("n"))


def transition_counts(docs: DataFrame) -> DataFrame:
    """The transitions in the labelled strings of documents."""
    return span_transitions(read_spans(docs.select(whole().alias("text"))))


def fit_spans(spans: DataFrame) -> list[float]:
    """The log ratio of each transition, row by row, from read spans."""
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in span_transitions(spans).collect()}
    logs = [_log_model(counts, kind) for kind in (True, False)]
    return [x - y for x, y in zip(*logs)]


def fit(docs: DataFrame) -> list[float]:
    """The log ratio of each transition, row by row."""
    return fit_spans(read_spans(docs.select(whole().alias("text"))))


def _log_model(counts: dict, random: bool) -> list[float]:
    """Log transition probabilities; rare rows lean on how often their next character occurs."""
    rows = [[counts.get((random, a, b), 0) for b in range(STATES)] for a in range(STATES)]
    nexts = [sum(r[b] for r in rows) + EVEN / STATES for b in range(STATES)]
    shares = [x / sum(nexts) for x in nexts]
    return [
        math.log((n + PRIOR * share) / (sum(row) + PRIOR)) for row in rows for n, share in zip(row, shares)
    ]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token, its transitions looked up in the table of ratios."""
    held = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    return F.aggregate(_moves(token), F.lit(0.0), lambda acc, m: acc + F.get(held, m["a"] * STATES + m["b"]))


def _likely(tokens: str, ratios: list[float]) -> Column:
    """The loose tokens that look random."""
    return F.filter(
        F.col(tokens),
        lambda t: log_ratio(t["value"], ratios)
        >= F.greatest(F.lit(MIN_RATIO), MIN_MEAN_RATIO * (F.length(t["value"]) - 1)),
    )


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """The documents with `assign`, `access`, `hex` and `random`: arrays of their spans."""
    kept = docs.select(*[named(c) for c in docs.columns if c.lower() not in (*BASE, "random")])
    (tokens,) = fresh(kept, "tokens")
    return read_spans(kept, tokens).withColumn("random", _likely(tokens, ratios)).drop(tokens)


def report(docs: DataFrame) -> DataFrame:
    """Counts and places of each document's spans; texts are read once, their spans and loose tokens written."""
    spans = written(read_spans(docs.select("doc_id", "text")).drop("text"), "spans")
    found = spans.withColumn("random", _likely("tokens", fit_spans(spans)))
    base = F.concat(*[tagged(F.col(k), k, i, False) for i, k in enumerate(BASE)])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, tagged(F.col("random"), "random", 3, False))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
