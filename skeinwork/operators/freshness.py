"""Freshness: a cache with a time to live and its last good graph, fingerprints, dirty marks, locks and registries."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.predicates import is_relevant_source
from skeinwork.model import PropertyGraph
from skeinwork.storage import stored

DEFAULT_TTL = 30.0
STALE_AFTER = 30.0


def parse_ttl(given: str | None) -> float:
    """Seconds; the default for blank or bad values. At 0 or less nothing is kept."""
    try:
        return float((given or "").strip())
    except ValueError:
        return DEFAULT_TTL


def materialised(graph: PropertyGraph) -> PropertyGraph:
    """The graph as tables of its own, which neither its sources' changes nor their loss touch."""
    return PropertyGraph(stored(graph.nodes, "graph-nodes"), stored(graph.edges, "graph-edges"))


class GraphCache:
    """Keeps a built graph for ttl seconds. A build that fails gives the last good graph and a warning, or the error.

    The build must do its work (see materialised): a plan alone would read its sources again at every use.
    """

    def __init__(self, build: Callable[[], Any], ttl: float = DEFAULT_TTL, clock: Callable[[], float] = time.time):
        self.build, self.ttl, self.clock = build, ttl, clock
        self.value, self.built_at = None, None

    def get(self) -> tuple[Any, list[str]]:
        age = None if self.built_at is None else self.clock() - self.built_at
        if age is not None and self.ttl > 0 and age < self.ttl:
            return self.value, []
        try:
            self.value, self.built_at = self.build(), self.clock()
            return self.value, []
        except Exception as error:
            if self.built_at is None:
                raise
            return self.value, [f"the graph could not be rebuilt and is {age:.0f} s old: {error}"]


def fingerprint(head: bytes, status: bytes) -> str:
    """Of a working tree: its head commit and the listing of what changed."""
    return hashlib.sha256(head + b"\0" + status).hexdigest()


def state_changed(previous: str | None, current: str | None) -> bool:
    """The first observation is no change, nor is a missing one."""
    return previous is not None and current is not None and previous != current


def should_refresh(dirty: bool, report_exists: bool, if_dirty: bool = False) -> bool:
    return dirty if if_dirty and not dirty else dirty or not report_exists


def changed_fingerprints(states: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """states with the fingerprint of `values` and whether it differs from the one before (by `order`, per key)."""
    print_of = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values)), 256)
    seen = F.lag("fingerprint").over(W.partitionBy(key).orderBy(order))
    return states.withColumn("fingerprint", print_of).withColumn("changed", F.coalesce(seen != F.col("fingerprint"), F.lit(False)))


class DirtyMark:
    """A file that says that a graph is out of date. It is set for changes of relevant sources and cleared by a refresh."""

    def __init__(self, path: str, generated: tuple[str, ...] = ()):
        self.path, self.generated = Path(path), generated

    def set_for(self, changed: DataFrame) -> bool:
        """Sets the mark if one of the changed paths (path) is a relevant source; whether it did."""
        if changed.filter(is_relevant_source(F.col("path"), self.generated)).isEmpty():
            return False
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.touch()
        return True

    def is_set(self) -> bool:
        return self.path.exists()

    def clear(self) -> None:
        self.path.unlink(missing_ok=True)


class RefreshLock:
    """An exclusive file. A fresh one of another run means there is nothing to do; a stale one is removed."""

    def __init__(self, path: str, timeout: float, clock: Callable[[], float] = time.time):
        self.path, self.stale, self.clock = Path(path), timeout + STALE_AFTER, clock

    def acquire(self) -> bool:
        try:
            os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            if self.clock() - self.path.stat().st_mtime <= self.stale:
                return False
            self.path.unlink(missing_ok=True)
            return True

    def release(self) -> None:
        self.path.unlink(missing_ok=True)


def repo_root(start: str) -> str:
    """The nearest folder upward that holds .git, else the start."""
    here = Path(start).resolve()
    return str(next((p for p in (here, *here.parents) if (p / ".git").exists()), here))


def registered(roots: DataFrame) -> DataFrame:
    """(slug, root): a root's folder name, or parent-name where several roots share the name. Independent of order."""
    parts = F.split(F.rtrim(F.col("root"), F.lit("/")), "/")
    named = roots.select("root").distinct().select("root", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent"))
    shared = F.count(F.lit(1)).over(W.partitionBy("name")) > 1
    return named.select(F.when(shared, F.concat_ws("-", "parent", "name")).otherwise(F.col("name")).alias("slug"), "root")
