"""Model providers as row functions, with bounded retries and the outcome in columns.

A provider turns prompts into replies. The offline one is a column expression; others are Python
callables that run in Arrow batches. A reply or its error is a row's data, never an exception of
the job, and a plan writes replies before it reads them twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.responses import NOT_RETRYABLE, RETRYABLE
from ..functions.text import restore_offline

Provider = Callable[[str, str], tuple[str, dict]]
_registry: dict[str, Provider] = {}
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,truncated:boolean>"
# What the offline provider reports for a call.
OFFLINE_USAGE = (10, 20, 30)


def register(name: str, provider: Provider) -> None:
    _registry[name.strip().lower()] = provider


def available() -> list[str]:
    return ["offline", *sorted(_registry)]


def worth_retrying(message: str) -> bool:
    low = message.lower()
    return not any(x in low for x in NOT_RETRYABLE) and (not low or any(x in low for x in RETRYABLE))


def ask(rows: DataFrame, name: str = "offline", prompt: str = "prompt", instruction: str = "", retries: int = 1, delay: float = 0.5) -> DataFrame:
    """The rows with `reply`, `error` and `usage`; unknown names fall back to the offline provider."""
    provider = _registry.get(name.strip().lower())
    if provider is None:
        p, c, t = OFFLINE_USAGE
        usage = F.struct(F.lit(p).cast("long").alias("prompt_tokens"), F.lit(c).cast("long").alias("completion_tokens"),
                         F.lit(t).cast("long").alias("total_tokens"), F.lit(False).alias("truncated"))
        return rows.withColumns({"reply": restore_offline(F.col(prompt)), "error": F.lit(None).cast("string"), "usage": usage})

    def one(text: str) -> tuple[str | None, str | None, dict | None]:
        for attempt in range(retries + 1):
            try:
                reply, usage = provider(text or "", instruction)
                return reply, None, {k: usage.get(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens", "truncated")}
            except Exception as problem:  # whatever a provider raises is this row's error
                message = str(problem)
                if attempt == retries or not worth_retrying(message):
                    return None, message or type(problem).__name__, None
                time.sleep(min(delay * 2**attempt, 8))
        raise AssertionError

    kept = [c for c in rows.columns if c not in ("reply", "error", "usage")]
    schema = rows.select(*kept).withColumns(
        {"reply": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "usage": F.lit(None).cast(USAGE)}
    ).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.copy()
            answers = [one(x) for x in batch[prompt]]
            for i, column in enumerate(("reply", "error", "usage")):
                out[column] = [a[i] for a in answers]
            yield out

    return rows.select(*kept).mapInPandas(run, schema)
