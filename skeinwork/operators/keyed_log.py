"""An append-only log by key that compacts: buckets of folded rows, and a tail of small files that is folded in when it grows.

Appends only add files. Once there are many, whoever appends folds them: of the buckets that their keys fall into, each is
merged with its part of the tail into a new folder, and a pointer, replaced at once, then names the new folders and the
files that they hold already. Folding is exact whatever is appended meanwhile, since a file counts either as folded or
as tail. Replaced folders and folded files go after a grace period, at the next folding, so their number stays bounded.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.storage import claim, discard, folders, put_in_place, read_small, write_small

BUCKETS, MOST_FILES = 64, 64
#: Seconds for which readers may go on with what has been replaced, and after which a folding counts as dead.
GRACE, FOLD_LIMIT = 600.0, 600.0


class KeyedLog:
    """Rows of a schema at a path, in a folder `tail`, and rows that `merge` makes of many, in buckets by key.

    lift turns appended rows into rows that merge takes; merge must not depend on order or grouping.
    """

    def __init__(self, spark: SparkSession, path: str, tail: str, schema: T.StructType, key: str, lift: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, most_files: int = MOST_FILES, grace: float = GRACE, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.tail, self.schema, self.key = spark, path, tail, schema, key
        self.lift, self.merge, self.buckets, self.most_files, self.grace, self.clock = lift, merge, buckets, most_files, grace, clock
        self.lifted: T.StructType | None = None

    def pointer(self) -> dict:
        """buckets (number -> folder), folded (file -> when) and replaced (folder -> when)."""
        return json.loads(read_small(self.spark, f"{self.path}/current.json") or '{"buckets": {}, "folded": {}, "replaced": {}}')

    def waiting(self, pointer: dict) -> list[str]:
        """The tail's files that are not folded."""
        return sorted(name for name, _ in folders(self.spark, f"{self.tail}/*.parquet") if name not in pointer["folded"])

    def append(self, rows: DataFrame) -> None:
        """Adds rows as one file, and folds the tail if it has grown long."""
        rows.coalesce(1).write.mode("append").parquet(self.tail)
        if len(self.waiting(self.pointer())) > self.most_files:
            self.fold()

    def _bucket(self, key) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _folded_schema(self) -> T.StructType:
        if self.lifted is None:
            self.lifted = self.merge(self.lift(self.spark.createDataFrame([], self.schema))).schema
        return self.lifted

    def _parts(self, pointer: dict, key: str | None) -> DataFrame:
        """The folded rows and the lifted tail, of one key's bucket if a key is given."""
        if key is None:
            known = list(pointer["buckets"].values())
        else:
            number = self.spark.range(1).select(self._bucket(F.lit(key))).first()[0]
            known = [pointer["buckets"][str(number)]] if str(number) in pointer["buckets"] else []
        files = self.waiting(pointer)
        tail = self.spark.read.schema(self.schema).parquet(*(f"{self.tail}/{f}" for f in files)) if files else self.spark.createDataFrame([], self.schema)
        rows = self.lift(tail if key is None else tail.filter(F.col(self.key) == key))
        if not known:
            return rows
        folded = self.spark.read.schema(self._folded_schema()).parquet(*(f"{self.path}/{f}" for f in known))
        return rows.unionByName(folded if key is None else folded.filter(F.col(self.key) == key))

    def read(self, key: str | None = None) -> DataFrame:
        """The merged rows of all keys, or of one, for which only its bucket and the tail are read."""
        return self.merge(self._parts(self.pointer(), key))

    def fold(self) -> bool:
        """Folds the tail as it is now; whether it did (another process may be at it)."""
        release = claim(self.spark, f"{self.path}/folding", FOLD_LIMIT, self.clock)
        if release is None:
            return False
        try:
            pointer, now = self.pointer(), self.clock()
            files = self.waiting(pointer)
            if not files:
                return False
            tail = self.lift(self.spark.read.schema(self.schema).parquet(*(f"{self.tail}/{f}" for f in files)))
            touched = sorted(r[0] for r in tail.select(self._bucket(self.key)).distinct().collect())  # BUCKETS of them at most
            known = [pointer["buckets"][str(b)] for b in touched if str(b) in pointer["buckets"]]
            rows = tail.unionByName(self.spark.read.schema(self._folded_schema()).parquet(*(f"{self.path}/{f}" for f in known))) if known else tail
            version = f"v-{uuid.uuid4().hex}"
            merged = self.merge(rows).withColumn("bucket", self._bucket(self.key)).repartition("bucket").sortWithinPartitions("bucket", self.key)
            merged.write.partitionBy("bucket").parquet(f"{self.path}/{version}")
            gone = lambda since: now - since > self.grace
            old = {f: s for f, s in pointer["folded"].items() if gone(s)}
            replaced = pointer["replaced"] | {f: now for f in known}
            expired = {f for f, s in replaced.items() if gone(s)}
            fresh = {
                "buckets": pointer["buckets"] | {str(b): f"{version}/bucket={b}" for b in touched},
                "folded": {f: s for f, s in pointer["folded"].items() if f not in old} | {f: now for f in files},
                "replaced": {f: s for f, s in replaced.items() if f not in expired},
            }
            # files go before the pointer forgets them: one that it names no more must not be there
            for f in old:
                discard(self.spark, f"{self.tail}/{f}")
            write_small(self.spark, f"{self.path}/{version}/pointer.json", json.dumps(fresh))
            put_in_place(self.spark, f"{self.path}/{version}/pointer.json", f"{self.path}/current.json")
            for f in expired:
                discard(self.spark, f"{self.path}/{f}")
            return True
        finally:
            release()
