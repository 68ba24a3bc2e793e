"""Operator 10: chat formatting of reply trees.

Messages point at the message they answer. Self-joins double the known jump (1, 2, 4, ... messages up) and use the jumps
to enumerate every path from a leaf to its root; paths are ranked by the score of their branch, and each chosen path is
formatted as one conversation by a template that can be read back.
"""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import checkpointed, map_rows, stored

#: Marks of the template. Every mark begins with "<" and "|"; in texts each such pair gets one more backslash between.
TURN, SAYS, OVER = "<|turn|>", "<|says|>", "<|over|>"
_BARE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|over\|>", re.DOTALL)
LEARNED = "assistant"


def escape(text: str) -> str:
    return _BARE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text, whether it is learned), and the learned spans in its characters."""
    parts, spans, at = [], [], 0
    for role, text, learned in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, OVER]
        at += len(head) + len(body) + len(OVER)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


def chain(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each answering the one before by turn, role and text.

    Null roles and texts are empty. Rows that repeat a turn, or all of a row, follow one another and stay.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.row_number().over(W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    return rows.select("tree", number.alias("message"), F.when(number > 1, number - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _keyed(messages: DataFrame) -> DataFrame:
    """messages with their tree as a key that joins hold equal for null trees as well."""
    return messages.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0)).alias("id")))


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, message, up): every message on the path from each leaf up to its root, `up` steps above the leaf.

    The jumps double each round, so a path of n messages takes about log2(n) self-joins, and the rows made are the
    messages of the paths, no more. A parent that is missing ends the path. No tree may be null (see _keyed).
    """
    here = messages.select("tree", "message", "parent")
    known = here.select("tree", F.col("message").alias("parent"))
    jumps = [checkpointed(here.filter("parent IS NOT NULL").join(known, ["tree", "parent"], "left_semi").select("tree", "message", F.col("parent").alias("above")))]
    while jumps[-1].limit(1).count():
        step = jumps[-1]
        further = step.select("tree", F.col("message").alias("above"), F.col("above").alias("next"))
        jumps.append(checkpointed(step.join(further, ["tree", "above"]).select("tree", "message", F.col("next").alias("above"))))
    answered = jumps[0].select("tree", F.col("above").alias("message")).distinct()
    paths = here.join(answered, ["tree", "message"], "left_anti").select("tree", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("up"))
    for power in reversed(range(len(jumps))):
        higher = paths.join(jumps[power], ["tree", "message"]).select("tree", "leaf", F.col("above").alias("message"), (F.col("up") + (1 << power)).alias("up"))
        paths = checkpointed(paths.unionByName(higher))  # read twice by the next round
    return paths


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Per chosen path: conv_id, leaf, rank, branch_score, n_turns, formatted, loss_spans (array of start and end).

    messages holds (tree, message, parent, role, text, score). A branch's score is the sum over its path; the `best`
    paths of a tree are kept (None: all), ties going to the least leaf. A learned message that several chosen paths share
    is in the loss of the best of them only, so it is learned once. Messages of a null tree are one tree. Empty input
    gives no rows. Other columns may have any name. One formatted conversation must fit in memory; trees of any size are
    spread by (tree, leaf).
    """
    messages = _keyed(messages.select("tree", "message", "parent", "role", "text", "score"))
    paths = leaf_paths(messages).join(messages.drop("parent"), ["tree", "message"])
    ranked = paths.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf")))
    chosen = paths.drop("score").join(ranked if best is None else ranked.filter(F.col("rank") <= best), ["tree", "leaf"])
    if best != 1:
        first = chosen.groupBy("tree", "message").agg(F.min("rank").alias("first"))
        chosen = chosen.join(first, ["tree", "message"]).withColumn("learned", (F.col("role") == LEARNED) & (F.col("rank") == F.col("first"))).drop("first")
    else:
        chosen = chosen.withColumn("learned", F.col("role") == LEARNED)
    turns = chosen.groupBy("tree", "leaf", "rank", "branch_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text", "learned"))).alias("turns"))
    turns = turns.withColumn("tree", F.when(~F.col("tree.none"), F.col("tree.id")))

    def start():
        def one(values):
            tree, leaf, rank, score, turns = values
            text, spans = format_turns([(t["role"], t["text"], t["learned"]) for t in turns])
            yield tree, leaf, rank, score, len(turns), text, [x for span in spans for x in span]

        return one

    long = ("long", pa.int64())
    return map_rows(turns, start, {"conv_id": long, "leaf": long, "rank": ("int", pa.int32()), "branch_score": ("double", pa.float64()), "n_turns": long, "formatted": ("string", pa.string()), "loss_spans": ("array<long>", pa.list_(pa.int64()))}, flush_rows=512)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def start():
        def one(values):
            conv, text, spans = values
            turns = read_turns(text)
            learned = [unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True)]
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            loss = "".join(learned)
            yield conv, len(turns), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)

        return one

    long, text = ("long", pa.int64()), ("string", pa.string())
    return map_rows(formatted.select("conv_id", "formatted", "loss_spans"), start, {"conv_id": long, "n_turns": long, "turns_sha256": text, "loss_chars": long, "loss_sha256": text, "formatted_chars": long})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")).select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    messages = stored(chain(rows.unionByName(added)), "messages")
    return read_back(format_trees(messages))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24)::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
"""
