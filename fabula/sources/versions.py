"""A table in versions: loads are folders, a version is a list of loads, and a load counts once it is listed.

A load writes a folder of its own and then, in one step, the list that adds it.  If it fails before, nothing points to its
folder; if it runs again under the same name, it finds itself listed and does nothing.  In a version, the scope keys
(chapters, say) that a later load holds replace all that earlier ones hold of them, so loads in several passes, or again,
end where one pass ends.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.sources.tables import Folder, is_plain_name


class LoadConflict(RuntimeError):
    """Another load has made the same version first; load again."""


class Refused(ValueError):
    """A deletion that the guard does not let through."""


@dataclass(frozen=True)
class VersionedTable:
    """A table of ``schema`` (DDL) under ``path``, replaced by ``scope``."""

    spark: SparkSession
    path: str
    schema: str
    scope: tuple[str, ...]

    def _folder(self, part: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{part}")

    def version(self) -> int:
        """The newest version, 0 before the first load."""
        return max((int(n.removeprefix("v")) for n in self._folder("versions").names() if n.startswith("v")), default=0)

    def loads(self, version: int | None = None) -> list[str]:
        """The loads of a version, oldest first."""
        number = self.version() if version is None else version
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/versions/v{number}").collect())) if number else []

    def load(self, rows: DataFrame, name: str) -> int:
        """Add ``rows`` as the load ``name`` and return the version that has it; a name that is listed already changes nothing."""
        if not is_plain_name(name):
            raise Refused(f"{name} is no name for a load")
        now = self.version()
        listed = self.loads(now)
        if name in listed:
            return now
        kinds = self.spark.createDataFrame([], self.schema).schema
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds])
        rows.write.mode("overwrite").parquet(f"{self.path}/loads/{name}")  # what a failed attempt has left goes
        if not self._folder("versions").put(f"v{now + 1}", json.dumps([*listed, name])):
            raise LoadConflict(f"version {now + 1} is taken")
        return now + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest where none is named."""
        loads = self.loads(version)
        if not loads:
            return self.spark.createDataFrame([], self.schema)
        each = [self.spark.read.schema(self.schema).parquet(f"{self.path}/loads/{n}").withColumn("_load", F.lit(k)) for k, n in enumerate(loads)]
        rows = reduce(DataFrame.unionByName, each)
        if len(loads) == 1:
            return rows.drop("_load")
        same = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"_k{k}") for k, c in enumerate(self.scope)]
        null = [F.col(f"`{c}`").isNull().alias(f"_n{k}") for k, c in enumerate(self.scope)]
        keys = [f"_{x}{k}" for k in range(len(self.scope)) for x in "kn"]
        rows = rows.select("*", *same, *null)
        last = rows.groupBy(*keys).agg(F.max("_load").alias("_load"))
        return rows.join(last, [*keys, "_load"], "left_semi").drop(*keys, "_load")

    def compacted(self, name: str) -> int:
        """A version whose only load, ``name``, holds what the newest has.  Earlier versions stay readable until their loads are deleted."""
        if name in self._folder("loads").names():
            raise Refused(f"{name} is a load already")
        now = self.version()
        self.read(now).write.parquet(f"{self.path}/loads/{name}")
        if not self._folder("versions").put(f"v{now + 1}", json.dumps([name])):
            raise LoadConflict(f"version {now + 1} is taken")
        return now + 1

    def delete(self, names: list[str] | None = None, confirm: str | None = None) -> list[str]:
        """Delete loads by name, or all but those of the newest version; the names deleted.

        Only folders directly within ``loads`` go: names that lead elsewhere or are not there are refused before anything
        is deleted, as are loads that the newest version lists.  Deletion without names needs ``confirm="all"``."""
        have, used = self._folder("loads").names(), set(self.loads())
        if names is None:
            if confirm != "all":
                raise Refused('deletion of all loads needs confirm="all"')
            names = [n for n in have if n not in used]
        for name in names:
            if not is_plain_name(name) or name not in have:
                raise Refused(f"{name} is no load")
            if name in used:
                raise Refused(f"{name} is part of the newest version")
        return [n for n in sorted(names) if self._folder("loads").drop(n)]


def delete_runs(spark: SparkSession, root: str, names: list[str] | None = None, confirm: str | None = None) -> list[str]:
    """Delete runs, which are folders directly within ``root``; the names of those that were there.

    Names that lead elsewhere are refused before anything is deleted; without names, all runs go, but only with
    ``confirm="all"``.  Clips lie outside, as several runs share them."""
    folder = Folder(spark, root)
    have = folder.names(folders=True)
    if names is None and confirm != "all":
        raise Refused('deletion of all runs needs confirm="all"')
    for name in names or ():
        if not is_plain_name(name):
            raise Refused(f"{name} is no run")
    return [n for n in have if (names is None or n in names) and folder.drop(n)]
