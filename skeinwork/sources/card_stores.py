"""The card stores of all registered projects, each read by a task of its own: (slug, root) -> cards and errors.

A registry names many SQLite files in folders that the executors see. A store that is missing is empty; one that cannot be
read, in whole or in part, gives one row with an error and no cards, and the others come as they are.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skeinwork.model import CARDS
from skeinwork.operators import board

#: Where a project's store lies in its root.
STORE_FILE = "cards.sqlite"
#: Partitions that stores are dealt to, where there are more stores.
MOST_PARTITIONS = 1000
UNREADABLE = "Could not read cards database"
_FIELDS = CARDS.fieldNames()


class StorePartition(InputPartition):
    def __init__(self, value: list[tuple[str, str]]):
        super().__init__(value)


class CardStores(DataSource):
    """Rows of (slug, the columns of CARDS, error). Options: stores, a JSON list of [slug, path of the file]."""

    @classmethod
    def name(cls) -> str:
        return "skeinwork_card_stores"

    def schema(self) -> str:
        return "slug string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CARDS) + ", error string"

    def reader(self, schema) -> DataSourceReader:
        return CardStoresReader([tuple(x) for x in json.loads(self.options["stores"])])


class CardStoresReader(DataSourceReader):
    def __init__(self, stores: list[tuple[str, str]]):
        self.stores = stores

    def partitions(self) -> list[InputPartition]:
        deal = min(MOST_PARTITIONS, max(1, len(self.stores)))
        return [StorePartition(self.stores[i::deal]) for i in range(deal)]

    def read(self, partition: StorePartition) -> Iterator[tuple]:
        for slug, path in partition.value:
            yield from read_cards(slug, path)


def read_cards(slug: str, path: str) -> Iterator[tuple]:
    """The cards of one store, or one row that has only an error."""
    if not os.path.exists(path):
        return
    try:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            # a store is read whole before any of it counts, as a broken page may come late
            rows = db.execute(f"SELECT {', '.join(_FIELDS)} FROM cards").fetchall()
        finally:
            db.close()
    except sqlite3.Error:
        yield (slug, *(None for _ in _FIELDS), UNREADABLE)
        return
    for row in rows:
        yield (slug, *(None if v is None else str(v) for v in row), None)


def read_stores(spark: SparkSession, registry: DataFrame, store_file: str = STORE_FILE) -> DataFrame:
    """(slug, cards' columns, error) of every project of a registry (slug, root). The registry, one row for each project, goes
    through the driver; the stores do not."""
    stores = [(r["slug"], os.path.join(r["root"], store_file)) for r in registry.select("slug", "root").orderBy("slug").collect()]
    spark.dataSource.register(CardStores)
    return spark.read.format(CardStores.name()).option("stores", json.dumps(stores)).load()


def board_of_all(spark: SparkSession, registry: DataFrame, store_file: str = STORE_FILE) -> tuple[DataFrame, DataFrame]:
    """(place, project, counts, total, collapsed, last_activity, error) of every project, and the newest cards of each column.

    Projects come latest activity first, those without any last, then by name; a project whose store is missing or can't be
    read has zeros, the latter with its error.
    """
    rows = read_stores(spark, registry, store_file).withColumnRenamed("slug", "project")
    cards, errors = rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("project", "error")
    projects = registry.select(F.col("slug").alias("project"))
    counts = board.column_counts(cards, projects).join(errors, "project", "left")
    places = board.project_order(cards, projects).select("project", "place")
    return counts.join(places, "project").orderBy("place"), board.newest(cards)
