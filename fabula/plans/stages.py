"""A chain of named stages, each a function from DataFrame to DataFrame, that can be edited and checked before it runs.

Running a pipeline only builds a plan: Spark optimises all of its stages together."""

from __future__ import annotations

import importlib
import pkgutil
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.operators import segments as S

#: What a table of chapters provides before any stage.
SEED = ("chapter_id", "text")


class OrderError(ValueError):
    """Stages in an order that cannot work."""


@dataclass(frozen=True)
class Stage:
    """``requires`` and ``assigns`` name columns; a ``model`` stage calls one, a ``plain`` stage does not."""

    name: str
    requires: tuple[str, ...]
    assigns: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]
    kind: str = "plain"


REGISTRY: dict[str, Stage] = {}


def register(stage: Stage) -> Stage:
    if not stage.name:
        raise ValueError("a stage needs a name")
    if stage.name in REGISTRY:
        raise ValueError(f"there is a stage named {stage.name!r}")
    REGISTRY[stage.name] = stage
    return stage


def discover(package: ModuleType) -> list[str]:
    """Import the modules of ``package``, so that their stages register; names with a leading underscore and ``base`` are skipped."""
    found = [m.name for m in pkgutil.iter_modules(package.__path__) if not m.name.startswith("_") and m.name != "base"]
    for name in found:
        importlib.import_module(f"{package.__name__}.{name}")
    return found


def registered(name: str) -> Stage:
    if name not in REGISTRY:
        raise KeyError(f"no stage named {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


@dataclass(frozen=True)
class Pipeline:
    """Immutable: every edit gives another pipeline."""

    stages: tuple[Stage, ...] = ()

    @classmethod
    def from_names(cls, names: Iterable[str]) -> Pipeline:
        return cls(tuple(registered(n) for n in names))

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.stages]

    def index_of(self, name: str) -> int:
        if name not in self.names:
            raise KeyError(f"no stage named {name!r} among {self.names}")
        return self.names.index(name)

    def _edited(self, at: int, cut: int, *new: Stage) -> Pipeline:
        return Pipeline((*self.stages[:at], *new, *self.stages[at + cut :]))

    def append(self, stage: Stage) -> Pipeline:
        return self._edited(len(self.stages), 0, stage)

    def insert_before(self, name: str, stage: Stage) -> Pipeline:
        return self._edited(self.index_of(name), 0, stage)

    def insert_after(self, name: str, stage: Stage) -> Pipeline:
        return self._edited(self.index_of(name) + 1, 0, stage)

    def replace(self, name: str, stage: Stage) -> Pipeline:
        return self._edited(self.index_of(name), 1, stage)

    def remove(self, name: str) -> Pipeline:
        return self._edited(self.index_of(name), 1)

    def problems(self, seed: Iterable[str] = SEED) -> list[str]:
        """One sentence for each stage that needs what no stage before it provides."""
        have, found = set(seed), []
        for s in self.stages:
            if lacking := [r for r in s.requires if r not in have]:
                found.append(f"{s.name} needs {', '.join(lacking)}, which nothing before it provides")
            have.update(s.assigns)
        return found

    def validate(self, seed: Iterable[str] = SEED) -> None:
        if found := self.problems(seed):
            raise OrderError("; ".join(found))

    def run(self, df: DataFrame) -> DataFrame:
        self.validate(df.columns)
        for s in self.stages:
            df = df.transform(s.run)
            if lacking := [c for c in s.assigns if c not in df.columns]:
                raise OrderError(f"{s.name} did not provide {', '.join(lacking)}")
        return df

    def timed(self, df: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, list[tuple[str, str, int]]]:
        """Run with ``write`` (a table of the given name, read back) after each stage; (name, kind, milliseconds) of each."""
        self.validate(df.columns)
        took = []
        for s in self.stages:
            began = time.monotonic()
            df = write(df.transform(s.run), s.name)
            took.append((s.name, s.kind, round(1000 * (time.monotonic() - began))))
        return df, took


def time_by_kind(metrics: DataFrame) -> DataFrame:
    """Total, plain and model milliseconds of metrics (name, kind, ms)."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("ms"))), F.lit(0)).cast("long")
    return metrics.agg(F.coalesce(F.sum("ms"), F.lit(0)).cast("long").alias("total_ms"), of("plain").alias("plain_ms"), of("model").alias("model_ms"))


def narration_defaults(segments: DataFrame) -> DataFrame:
    """Narration is neutral, whatever a model said; segments without emotion are neutral too."""
    told = F.col("kind") != "dialogue"
    have = lambda c, d: F.coalesce(F.col(c), d) if c in segments.columns else d
    emotion, intensity = have("emotion", F.lit("neutral")), have("intensity", F.lit(0.5))
    return segments.withColumn("emotion", F.when(told, "neutral").otherwise(emotion)).withColumn("intensity", F.when(told, 0.5).otherwise(intensity))


_SPLIT = ("id", "kind", "original_text", "speaker", "attribution_source", "paragraph_index", "char_offset_start", "char_offset_end")

for _stage in (
    Stage("segment_splitter", ("text",), _SPLIT, S.split_segments),
    Stage("explicit_attribution", ("kind", "speaker"), ("speaker", "attribution_source"), S.attribute_explicit),
    Stage("turn_taking", ("speaker", "attribution_source"), ("speaker", "attribution_source"), S.take_turns),
    Stage("pause_timing", ("kind", "paragraph_index"), ("pause_before_ms",), S.assign_pauses),
    Stage("narration_defaults", ("kind",), ("emotion", "intensity"), narration_defaults),
    Stage("normalisation", ("original_text", "pause_before_ms"), ("spoken_text",), S.normalise_segments),
):
    register(_stage)

#: The stages that need no model, in the order in which they work.
DEFAULT = tuple(REGISTRY)
