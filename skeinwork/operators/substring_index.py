"""An index of substrings: posting lists of trigrams, which narrow a search to few rows before it compares texts.

Rows get places, numbers that ascend in each file; every trigram (of characters, in lower case) of their texts posts the
place. A task that reads a run of rows makes the postings of the run whole, so only posting lists are shuffled, to be
sorted by trigram, and a search reads the row groups that hold its own. It takes the needle's rarest trigrams, counts how
many of them each place has, and fetches the rows that have all. These are a superset of the answer: a caller applies its
own predicate to them, as it would to all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.storage import files_digest, finished, shared_dir

#: Rows, and characters of longer ones, of a run whose postings a task makes at once.
BLOCK, BLOCK_CHARS = 1 << 16, 1 << 21
#: A search intersects so many of its trigrams, the rarest ones.
RAREST = 4
#: Rows found up to this number are broadcast to the rows' table, and up to the smaller one pushed into its scan.
BROADCAST_ROWS, PUSHED_ROWS = 50_000, 1000
#: A character takes so many bits of a trigram's number.
CHAR_BITS = 21


def numbered(gram: str) -> int:
    a, b, c = map(ord, gram)
    return (a << 2 * CHAR_BITS) | (b << CHAR_BITS) | c


def grams_of(needle: str) -> list[int]:
    """The numbers of a needle's trigrams in lower case; none for less than three characters."""
    text = needle.lower()
    return sorted({numbered(text[i : i + 3]) for i in range(len(text) - 2)})


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the trigrams of texts, none of them null, and for each the index of its text."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    counts = np.maximum(lengths - 2, 0)
    of = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(of)) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(counts) + counts, counts)
    return (chars[at] << 2 * CHAR_BITS) | (chars[at + 1] << CHAR_BITS) | chars[at + 2], of


def _posted(run: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(gram, base, offsets, count) of a run of (place, texts...): for each trigram the places, as distances from the first."""
    table = pa.Table.from_batches(run)
    places = table.column(0).to_numpy()
    found = [_grams(column.combine_chunks()) for column in table.columns[1:]]
    coded = pa.array(np.concatenate([g for g, _ in found])).dictionary_encode()
    offsets = (places - places[0])[np.concatenate([of for _, of in found])]
    posts = np.sort((coded.indices.to_numpy().astype(np.int64) << 32) | offsets)
    posts = posts[np.diff(posts, prepend=-1) > 0]  # a text may hold a trigram more than once
    starts = np.flatnonzero(np.diff(posts >> 32, prepend=-1))
    codes, bounds = posts[starts] >> 32, np.append(starts, len(posts))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(posts & 0xFFFFFFFF, pa.int32()))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes)), pa.array(np.full(len(codes), places[0])), lists, pa.array(np.diff(bounds), pa.int64())], names=["gram", "base", "offsets", "count"])


def _postings(block: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that makes the postings of each run: rows whose places differ by less than block, of up to most characters or one row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, base = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                places = batch.column(0).to_numpy()
                base = base if run else places[0]
                held_by = held + np.cumsum(sum(pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]))
                beyond = (places < base) | (places >= base + block) | (held_by > most)  # places fall where the next file begins
                taken = max(int(beyond.argmax()) if beyond.any() else batch.num_rows, 0 if run else 1)
                if taken:
                    run, held = [*run, batch.slice(0, taken)], int(held_by[taken - 1])
                batch = batch.slice(taken)
                if batch.num_rows:
                    yield _posted(run)
                    run, held = [], 0
        if run:
            yield _posted(run)

    return task


class SubstringIndex:
    """The index of some columns of rows, at a path of the shared storage; made when it is first asked, unless it is there."""

    def __init__(self, rows: DataFrame, columns: tuple[str, ...] = ("id", "label"), files: list[str] | None = None, label: str = ""):
        self.spark, self.rows, self.columns = rows.sparkSession, rows, columns
        self.files, self.label, self._open = files, label, None

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        if self._open is None:
            # of files, later runs find it again as long as the files stay as they are
            name = files_digest(self.spark, self.files, f"runs {self.label} {self.columns}") if self.files else uuid.uuid4().hex
            path = f"{shared_dir(self.spark)}/skeinwork-substrings-{name}"
            ready = finished(self.spark, f"{path}/*/postings")  # written last
            folder = ready[0].rsplit("/", 1)[0] if ready else self._prepare(f"{path}/{uuid.uuid4().hex}")
            self._open = tuple(self.spark.read.parquet(f"{folder}/{table}") for table in ("rows", "postings"))
        return self._open

    def _prepare(self, folder: str) -> str:
        # places are those of one write, and read back from it
        placed = self.rows.select("*", F.monotonically_increasing_id().alias("place of row"))
        placed.write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/rows")
        texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"text {i}") for i, c in enumerate(self.columns)]
        runs = self.spark.read.parquet(f"{folder}/rows").select("place of row", *texts)
        posted = runs.mapInArrow(_postings(BLOCK, BLOCK_CHARS), "gram long, base long, offsets array<int>, count long")
        posted.repartitionByRange("gram", "base").sortWithinPartitions("gram", "base").write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/postings")
        return folder

    def found(self, needle: str) -> DataFrame | None:
        """(place) of the rows that hold the needle's rarest trigrams; None for a needle too short to have one."""
        grams = grams_of(needle)
        if not grams:
            return None
        postings = self._tables()[1]
        own = postings.filter(F.col("gram").isin(grams))
        counts = {r["gram"]: r["n"] for r in own.groupBy("gram").agg(F.sum("count").alias("n")).collect()}  # one row for each trigram of the needle
        if len(counts) < len(grams):  # one that no row has
            return self.spark.createDataFrame([], "place long")
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        some = postings.filter(F.col("gram").isin(rarest)).select("base", F.explode("offsets").alias("offset")).select((F.col("base") + F.col("offset")).alias("place"))
        return some.groupBy("place").count().filter(F.col("count") == len(rarest)).select("place")

    def candidates(self, needle: str) -> DataFrame:
        """The rows among which all that hold the needle are; all rows for a needle of less than three characters, or where
        very many are found, as to scan all is less than to shuffle them to meet those found."""
        places = self.found(needle)
        rows, columns = self._tables()[0], self.rows.columns
        if places is None:
            return rows.select(*columns)
        few = [r[0] for r in places.limit(PUSHED_ROWS + 1).collect()]
        if len(few) <= PUSHED_ROWS:
            return rows.filter(F.col("place of row").isin(few)).select(*columns)
        if places.count() > BROADCAST_ROWS:
            return rows.select(*columns)
        return rows.join(F.broadcast(places.withColumnRenamed("place", "place of row")), "place of row", "left_semi").select(*columns)
