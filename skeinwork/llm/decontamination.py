"""Operator 13: benchmark decontamination by winnowing, in DataFrame functions alone.

Of every WINDOW consecutive words the least hash of their GRAM-word grams is a fingerprint, so two texts that share so many
words in a row share a fingerprint. Fingerprints of documents are joined with those of the items; in texts that share one,
the windows around the hits are compared with the items' windows word by word. Equal texts are judged once.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import stored

#: Words of a window and of a gram: a window holds WINDOW - GRAM + 1 grams, of which the least is kept.
WINDOW, GRAM = 10, 5
#: Fingerprints of items, windows of items and judged texts are broadcast up to so many rows, and else joined with salts.
BROADCAST_ROWS, SALTS = 200_000, 16
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY, _SALT = "key of text", "salt of text"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` names it."""
    return F.transform(F.array(value), then).getItem(0)


def words_of(text: Column) -> Column:
    """The words, only A-Z in lower case; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # of ASCII alone, where lower() is exact
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), F.lit(_WORD), F.lit(0))


def _slides(values: Column, size: int, of: Callable[[list[Column]], Column]) -> Column:
    """What `of` makes of each run of `size` neighbouring values."""
    last = F.size(values) - size
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: of([F.get(values, i + j) for j in range(size)]))
    return F.when(last >= 0, each).otherwise(F.slice(each, 1, 0))


def fingerprints(hashes: Column, length: int, window: int = WINDOW, gram: int = GRAM) -> Column:
    """The fingerprint of each window of `length` words, by position, from the words' hashes.

    Windows of full size have the least hash of their grams; shorter ones (of items with fewer words) that of all their words.
    """
    if length < window:
        return _slides(hashes, length, lambda w: F.xxhash64(*w))
    return let(_slides(hashes, gram, lambda w: F.xxhash64(*w)), lambda grams: _slides(grams, window - gram + 1, lambda g: F.least(*g) if len(g) > 1 else g[0]))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _spans(hashes: Column, lengths: list[int]) -> Column:
    """(start, length, h) of every window."""

    def of(n: int) -> Column:
        return F.transform(fingerprints(hashes, n), lambda h, i: F.struct(i.alias("start"), F.lit(n).alias("length"), h.alias("h")))

    return F.concat(*map(of, lengths))


def _phrase(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, length, h, items): the windows of items, each once, with the sorted ids of the items that hold it.

    An item of fewer words than a window is one window; one without words has none. Rows of one id are one item; a null id
    is an empty one.
    """
    item = F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item")
    worded = items.select(item, F.inline(F.array(F.struct(words_of(F.col(text_col)).alias("words"))))).filter(F.size("words") > 0)

    def windows(words: Column) -> Column:
        start = lambda n: F.transform(fingerprints(_hashes(words), n), lambda h, i: F.struct(_phrase(words, i, F.lit(n)).alias("phrase"), F.lit(n).alias("length"), h.alias("h")))
        told = F.when(F.size(words) >= WINDOW, start(WINDOW))
        for n in range(1, WINDOW):
            told = told.when(F.size(words) == n, start(n))
        return told

    return worded.select("item", F.inline(windows(F.col("words")))).groupBy("phrase", "length", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _joined(left: DataFrame, right: DataFrame, rows: int, on: list[str], how: str) -> DataFrame:
    """left joined with right, which is broadcast where its rows are few; else a key that many rows of left share is salted."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_row = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    return left.withColumn(_SALT, by_row).join(salted, [*on, _SALT], how).drop(_SALT)


def judged_texts(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n_hit, items) of each different text that holds a window of an item; key is the text's SHA-256."""
    windows = stored(items, "item-windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # WINDOW of them at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], "key string, n_hit long, items array<string>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.sha2(text.cast("binary"), 256).alias("key"), text.alias("text"))

    # which texts share fingerprints with items, and which
    own = F.array_distinct(let(_hashes(words_of(F.col("text"))), lambda w: F.concat(*[fingerprints(w, n) for n in lengths])))
    wanted = windows.select("h").distinct()
    hits = stored(_joined(keyed.select("key", F.explode(own).alias("h")), wanted, wanted.count(), ["h"], "left_semi").distinct(), "winnow-hits")

    # the windows around the hits, of one text of each key
    keys = hits.select("key").distinct()
    texts = stored(_joined(keyed, keys, keys.count(), ["key"], "left_semi").dropDuplicates(["key"]), "winnow-texts")
    around = texts.select("key", F.inline(let(_hashes(words_of(F.col("text"))), lambda w: _spans(w, lengths))))
    spots = around.join(hits, ["key", "h"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("start", "length")).alias("spots"))
    worded = texts.join(spots, "key").select("key", "spots", F.inline(F.array(F.struct(words_of(F.col("text")).alias("words")))))
    spelt = worded.select("key", F.inline(F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), _phrase(F.col("words"), s["start"], s["length"]).alias("phrase")))))
    found = _joined(spelt, windows.select("phrase", "length", "items"), windows.count(), ["phrase", "length"], "inner")

    # words under any window, and the items of all windows
    ends = F.struct(F.col("start").cast("long").alias("s"), (F.col("start") + F.col("length")).cast("long").alias("e"))
    by_text = found.groupBy("key").agg(F.sort_array(F.collect_set(ends)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda so, x: F.struct((so["n"] + F.greatest(x["e"] - F.greatest(x["s"], so["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(so["end"], x["e"]).alias("end")),
        lambda so: so["n"],
    )
    return by_text.select("key", covered.alias("n_hit"), "items")


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items and contaminated (input columns so named are replaced).

    n_hit counts the words within any window of ten words, or all words of an item of fewer, that stands in an item; items
    are the sorted ids (as text) of the items whose windows occur. Every row comes out, rows of one or no doc_id each by
    itself. A null or empty text has no words; nor has a null item. Empty tables give no rows, or no hits.
    """
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    judged = stored(judged_texts(docs, item_windows(benchmark, item_col, item_text_col), text_col), "judged").withColumnRenamed("key", _KEY)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"n_words": F.size(words_of(F.col(text_col))).cast("long"), _KEY: F.sha2(text.cast("binary"), 256)})
    told = _joined(keyed, judged, judged.count(), [_KEY], "left")
    none = F.array().cast("array<string>")
    return told.select(*docs.columns, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("documents", "benchmark"))
    marked = mark_contaminated(docs.select("doc_id", "text"), benchmark)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = rf"""
WITH lowered AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM item_words WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT row, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM lowered, lengths WHERE len(w) >= n)
), hits AS (
  SELECT row, s, d.n, item FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.phrase = i.phrase
), words_hit AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT row, s, n FROM hits)) GROUP BY row
), items_hit AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM lowered LEFT JOIN words_hit USING (row) LEFT JOIN items_hit USING (row)
"""
