"""Built graphs that processes share: versions in the shared storage and a pointer to the last good one.

A version is a folder of its own, written whole before the pointer names it; the pointer is a small file that a rename
replaces at once. So readers never see half a graph, its age is the pointer's, whichever process built it, and one that is
still being read outlives the next by a grace period.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from skeinwork.model import PropertyGraph
from skeinwork.operators.freshness import DEFAULT_TTL
from skeinwork.storage import claim, discard, folders, put_in_place, read_small, stored_bytes, write_small

#: Seconds after which a builder that has not finished counts as dead, and for which replaced versions stay.
BUILD_LIMIT, GRACE = 600.0, 600.0


class SharedGraph:
    """A graph at a path of the shared storage, built by whoever finds it older than ttl seconds.

    A build that fails serves the last good version with a warning, or raises if there is none. While another process
    builds, the last good version serves too, without waiting; where there is none yet, it is waited for.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[], PropertyGraph], ttl: float = DEFAULT_TTL, grace: float = GRACE, limit: float = BUILD_LIMIT, clock: Callable[[], float] = time.time, pause: float = 0.5):
        self.spark, self.path, self.build, self.ttl, self.grace, self.limit, self.clock, self.pause = spark, path.rstrip("/"), build, ttl, grace, limit, clock, pause

    def current(self) -> dict | None:
        """The pointer: version, built_at (seconds) and replaced (version -> seconds) of older ones; None before the first build."""
        text = read_small(self.spark, f"{self.path}/current.json")
        return json.loads(text) if text else None

    def facts(self) -> dict | None:
        """path, size in bytes and built_at (seconds) of the version that serves now, nothing being built; None before the first build."""
        pointer = self.current()
        if pointer is None:
            return None
        path = f"{self.path}/{pointer['version']}"
        return {"path": path, "size": stored_bytes(self.spark, path), "built_at": pointer["built_at"]}

    def _read(self, version: str) -> PropertyGraph:
        read = self.spark.read.parquet
        return PropertyGraph(read(f"{self.path}/{version}/nodes"), read(f"{self.path}/{version}/edges"))

    def _publish(self, graph: PropertyGraph) -> str:
        version = f"v-{uuid.uuid4().hex}"
        graph.nodes.write.parquet(f"{self.path}/{version}/nodes")
        graph.edges.write.parquet(f"{self.path}/{version}/edges")
        now, before = self.clock(), self.current()
        replaced = dict(before["replaced"], **{before["version"]: now}) if before else {}
        expired = [v for v, since in replaced.items() if now - since > self.grace]
        pointer = {"version": version, "built_at": now, "replaced": {v: s for v, s in replaced.items() if v not in expired}}
        fresh = f"{self.path}/{version}/pointer.json"
        write_small(self.spark, fresh, json.dumps(pointer))
        put_in_place(self.spark, fresh, f"{self.path}/current.json")
        # what the pointer no longer names goes, and so does what a dead builder left
        known = {version, *pointer["replaced"]}
        for name, changed in folders(self.spark, f"{self.path}/v-*"):
            if name not in known and (name in expired or now - changed > max(self.grace, self.limit)):
                discard(self.spark, f"{self.path}/{name}")
        return version

    def get(self) -> tuple[PropertyGraph, list[str]]:
        """The graph and warnings."""
        while True:
            pointer = self.current()
            age = None if pointer is None else self.clock() - pointer["built_at"]
            if age is not None and self.ttl > 0 and age < self.ttl:
                return self._read(pointer["version"]), []
            release = claim(self.spark, f"{self.path}/building", self.limit, self.clock)
            if release is None:
                if pointer is not None:
                    return self._read(pointer["version"]), [f"the graph is being rebuilt and is {age:.0f} s old"]
                time.sleep(self.pause)
                continue
            try:
                latest = self.current()
                if latest != pointer:  # built while the claim was made
                    continue
                return self._read(self._publish(self.build())), []
            except Exception as error:
                if pointer is None:
                    raise
                return self._read(pointer["version"]), [f"the graph could not be rebuilt and is {age:.0f} s old: {error}"]
            finally:
                release()
