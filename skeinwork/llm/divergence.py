"""Operator 11: source divergence audit by inclusion-exclusion over supports.

Groups are the (lang, source) of documents, terms the words that a language keeps. The divergence of one group from another
is a sum over all kept terms, most of which neither or only one of the two holds. So it is put together from three parts:
a constant for each pair, as if neither held any term; for each group's histogram of counts, what its terms add where the
other one's count is zero; and, from a sparse join of postings by term, what has to be corrected where both hold a term.
Work grows with postings, histograms and pairs, never with terms times groups.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import released, stored

MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Groups up to this number are broadcast (some 100 bytes each); more are joined.
BROADCAST_GROUPS = 50_000
#: Terms of a group that are ranked by one task; more are ranked in shares first.
RANKED_TERMS = 4096
#: Distinct terms a task counts before it hands them on, and the bytes of a text that are split into words at a time.
TASK_TERMS, PIECE = 300_000, 1 << 20

#: Letters stay, A-Z in lower case, and so do all bytes of characters beyond ASCII; the rest separates.
_LETTERS = bytes(ord(chr(b).lower()) if b < 0x80 and chr(b).isalpha() else b if b >= 0x80 else 0x20 for b in range(256))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about PIECE bytes."""
    spaced, at = raw.translate(_LETTERS), 0
    while at < len(spaced):
        end = len(spaced) if at + PIECE >= len(spaced) else spaced.find(b" ", at + PIECE)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def count_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within a task as far as its memory goes."""
    kind = "lang string, source string, term string, n long, docs long"
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurring, documents) in held.items():
            terms = list(occurring)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                columns = [[lang] * len(part), [source] * len(part), [t.decode() for t in part], [occurring[t] for t in part], [documents[t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                occurring, documents = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in _pieces(raw):
                    occurring.update(terms)
                    seen.update(terms)
                documents.update(seen)
            if sum(len(o) for o, _ in held.values()) > TASK_TERMS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    named = docs.select(_named("lang"), _named("source"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return named.mapInArrow(released(task), kind)


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def share(count: str, total: str, terms: str) -> Column:
    """The smoothed share of a count, in parts of UNIT; exact, as its product is a decimal."""
    return F.expr(f"1L + {UNIT}BD * cast({count} + 1 as decimal(20, 0)) div cast({total} + {terms} as decimal(20, 0))")


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def postings_of(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, lang_n, first): the counts of kept terms where they occur, the language's beside them.

    One shuffle, by language and term; first marks one posting of each term of a language.
    """
    dealt = count_terms(docs, text_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    told = dealt.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("in_docs"), (F.col("source") == F.min("source").over(term)).alias("first"))
    return told.filter(F.col("in_docs") >= min_docs).drop("in_docs")


def groups_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, zero): every occurring group, terms being the language's kept ones."""
    every = docs.select(_named("lang"), _named("source")).distinct()
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = postings.filter("first").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    told = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total"))
    # a language without kept terms has no shares
    return told.withColumn("zero", F.when(F.col("terms") > 0, share("0", "total", "terms")))


def pair_values(groups: DataFrame, shares: DataFrame, count: int) -> DataFrame:
    """(lang, source, item, value): the divergence of each group from each other one of its language."""
    a = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "terms")
    b = _sized(groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb")), count)
    parts = []
    neither = a.join(b, "lang").filter("a <> b")
    parts.append(neither.selectExpr("lang", "a as source", "b as item", f"coalesce(terms * {gap('za', 'zb')}, 0L) as value"))

    # one side: what the terms of a group add where the other one has none
    histogram = shares.groupBy("lang", F.col("source").alias("a"), "p", F.col("zero").alias("za")).agg(F.count(F.lit(1)).alias("terms"))
    one = histogram.join(b, "lang").filter("a <> b").groupBy("lang", "a", "b")
    one = one.agg(F.expr(f"sum(terms * ({gap('p', 'zb')} - {gap('za', 'zb')}))").alias("there"), F.expr(f"sum(terms * ({gap('zb', 'p')} - {gap('zb', 'za')}))").alias("back"))

    # both sides: what the two one-sided sums have wrong
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    corrected = lambda pa, za, pb, zb: F.expr(f"sum({gap(pa, pb)} - {gap(pa, zb)} - {gap(za, pb)} + {gap(za, zb)})")
    both = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(corrected("pa", "za", "pb", "zb").alias("there"), corrected("pb", "zb", "pa", "za").alias("back"))

    for sums in (one, both):
        parts.append(sums.selectExpr("lang", "inline(array(struct(a as source, b as item, there as value), struct(b as source, a as item, back as value)))"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(shares: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group holds more of than its language, farthest first.

    Groups of many terms are ranked in shares by the term's hash first, so no task ranks all terms of a group.
    """
    over = shares.filter("p > q").selectExpr("lang", "source", "term as item", f"{gap('p', 'q')} as value", f"pmod(xxhash64(term), cast(ceil(terms / {RANKED_TERMS}) as int)) as share")
    order = [F.col("value").desc(), F.col("item")]
    first = over.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "share").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top).drop("share")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group's use of terms lies from that of the other groups of
    its language (part pair), and the terms it overuses most against the language (part term).

    A null text, lang or source is empty. Every row of docs is a document, whatever its doc_id. A group without kept terms
    has shares like any other; a language that keeps none has pairs of value 0 and no terms; one group alone has no pairs.
    An empty table gives no rows. Only the columns lang, source and the text are read.
    """
    postings = stored(postings_of(docs, min_docs, text_col), "postings")
    groups = stored(groups_of(docs, postings), "groups")
    count = groups.count()
    shares = postings.join(_sized(groups, count), ["lang", "source"]).select("lang", "source", "term", "zero", "terms", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    pairs = pair_values(groups, shares, count).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(top_terms(shares, top), "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}
), langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), gs AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT lang, source, term, coalesce(c.n, 0)::HUGEINT AS n, lang_n
  FROM (SELECT gs.lang, source, term, n AS lang_n FROM gs JOIN kept ON kept.lang = gs.lang) LEFT JOIN counts c USING (lang, source, term)
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM dense GROUP BY ALL
), shares AS (
  SELECT lang, source, term, n, 1 + ({UNIT} * (n + 1)) // (totals.total + v) AS p, 1 + ({UNIT} * (lang_n::HUGEINT + 1)) // (langs.total + v) AS q
  FROM dense JOIN totals USING (lang, source) JOIN langs USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
