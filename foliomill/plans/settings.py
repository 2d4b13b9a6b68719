"""Settings of a run: limits of model calls, configuration from TOML and environment, presets, progress.

These are small driver-side values; nothing here touches rows.
"""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

# The context window without a setting and the least one, the least answer, seconds by mode.
CONTEXT, LEAST_CONTEXT, LEAST_ANSWER = 16384, 2048, 1024
TIMEOUTS = {"fast": 120, "balanced": 240, "quality": 480}
#: Bounds of a review call.
REVIEW_CONTEXT, REVIEW_ANSWER = 8192, 4096
PREFIX = "FOLIOMILL_"
DEFAULT_PRESET = "restoration"
PRESETS = {
    "restoration": "Restore the text: correct recognition errors, keep its order and its language, add nothing.",
    "translation": "Translate the text whole; keep names, numbers and the order of its parts.",
}


@dataclass(frozen=True)
class Settings:
    """What a model call may take; missing or unreadable values fall back on the defaults."""

    model: str = "offline"
    mode: str = "balanced"
    context_window: object = None
    generation_limit: object = None
    request_timeout: object = None

    def context(self) -> int:
        value = _number(self.context_window)
        return CONTEXT if value is None else max(LEAST_CONTEXT, value)

    def answer(self) -> int:
        value = _number(self.generation_limit)
        return max(LEAST_ANSWER, self.context() if value is None else value)

    def timeout(self) -> float | None:
        """Seconds; none without a setting or for one that is not positive; by mode for an unreadable one."""
        if self.request_timeout is None:
            return None
        value = _number(self.request_timeout)
        if value is None:
            return float(TIMEOUTS.get(self.mode, TIMEOUTS["balanced"]))
        return float(value) if value > 0 else None

    def bounded(self, context: int = REVIEW_CONTEXT, answer: int = REVIEW_ANSWER) -> Settings:
        """The same with limits of at most these."""
        window = min(_number(self.context_window) or context, context)
        return replace(self, context_window=window, generation_limit=min(_number(self.generation_limit) or answer, answer))


def _number(value: object) -> int | None:
    try:
        return None if value is None else int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return None


def load_settings(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings from a TOML file, over which variables such as FOLIOMILL_MODEL go; unknown names are ignored."""
    known = Settings.__dataclass_fields__
    values: dict[str, object] = {}
    if path and Path(path).is_file():
        values = {k: v for k, v in tomllib.loads(Path(path).read_text("utf-8")).items() if k in known}
    given = os.environ if environment is None else environment
    values |= {k: given[PREFIX + k.upper()] for k in known if given.get(PREFIX + k.upper(), "").strip()}
    return Settings(**values)  # type: ignore[arg-type]


def load_instruction(name: str = DEFAULT_PRESET, folder: str | None = None) -> str:
    """A preset's text: the user's own file of that name if the folder has one, else the one that comes along."""
    own = Path(folder) / f"{name}.txt" if folder else None
    if own and own.is_file():
        return own.read_text("utf-8")
    if name not in PRESETS:
        raise KeyError(f"no preset {name!r}; there are {sorted(PRESETS)}")
    return PRESETS[name]


def install_instruction(folder: str, name: str = DEFAULT_PRESET) -> str:
    """Write a preset to the user's folder for editing, unless it is there; returns its path."""
    target = Path(folder) / f"{name}.txt"
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(load_instruction(name), "utf-8")
    return str(target)


class Progress(StreamingQueryListener):
    """Hands events of streaming runs on as (event, message, advance): a row count is an advance."""

    def __init__(self, tell: Callable[[str, str, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell("started", event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        self.tell("progress", f"batch {progress.batchId}", int(progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.tell("waiting", str(event.id), 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("failed" if event.exception else "done", event.exception or str(event.id), 0)


def watch(spark: SparkSession, tell: Callable[[str, str, int], None]) -> Progress:
    """Report the progress of all streaming runs of the session; remove it with spark.streams.removeListener."""
    listener = Progress(tell)
    spark.streams.addListener(listener)
    return listener
