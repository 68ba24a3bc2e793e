"""Work items as an append-only table of events, with the current state as a view of it.

An event is a patch: a card_id, a sequence number, a time, and the fields it sets; null keeps what was there. Comments
are a table of their own and never change a card.
"""

from __future__ import annotations

import secrets
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.predicates import equal_if_given
from skeinwork.model import COMMENTS, EVENTS, STATUSES
from skeinwork.operators.keyed_log import BUCKETS, GRACE, MOST_FILES, KeyedLog

FIELDS = ("title", "description", "status", "priority")


def current_state(events: DataFrame) -> DataFrame:
    """One row per card: each field's last value that is not null, created_at and updated_at (null without a later event)."""
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in FIELDS]
    first = F.min_by("at", "seq").alias("created_at")
    return events.groupBy("card_id").agg(*latest, first, F.when(F.count(F.lit(1)) > 1, F.max_by("at", "seq")).alias("updated_at"))


def list_cards(cards: DataFrame, status: str | None = None, priority: str | None = None) -> DataFrame:
    """Cards of a status and priority (None and empty: any), newest first, then by card_id."""
    return cards.filter(equal_if_given("status", status) & equal_if_given("priority", priority)).orderBy(F.desc("created_at"), "card_id")


def card_with_comments(cards: DataFrame, comments: DataFrame, card_id) -> DataFrame:
    """A card and its comments, oldest first, a row for each (one row without comments); no row for an unknown card."""
    card = cards.filter(F.col("card_id") == card_id)
    own = comments.filter(F.col("card_id") == card_id).select("card_id", "comment_id", "author", "comment", F.col("created_at").alias("commented_at"))
    return card.join(own, "card_id", "left").orderBy("commented_at", "comment_id")


def last_comment(comments: DataFrame, card_id) -> DataFrame:
    return comments.filter(F.col("card_id") == card_id).agg(F.max("comment_id").alias("comment_id"))


def lifted_events(events: DataFrame) -> DataFrame:
    """Events as rows that folded_events merges: each field with its number, the first and the last time, and a count."""
    at = F.struct("seq", "at")
    fields = [F.when(F.col(f).isNotNull(), F.struct("seq", F.col(f).alias("value"))).alias(f) for f in FIELDS]
    return events.select("card_id", *fields, at.alias("first"), at.alias("last"), F.lit(1).cast("long").alias("n"))


def folded_events(rows: DataFrame) -> DataFrame:
    """One row for each card, of however many, in any order."""
    return rows.groupBy("card_id").agg(*(F.max(f).alias(f) for f in FIELDS), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def folded_state(folded: DataFrame) -> DataFrame:
    """The rows of current_state from folded events."""
    return folded.select("card_id", *(F.col(f"{f}.value").alias(f) for f in FIELDS), F.col("first.at").alias("created_at"), F.when(F.col("n") > 1, F.col("last.at")).alias("updated_at"))


class CardStore:
    """Events and comments as logs by card, which fold their tails of small files when they grow.

    Nothing is read to number them: a number is the microsecond and twelve random bits, greater than the writer's last one,
    so that several writers neither wait for nor overwrite each other and all readers see one order.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most_files: int = MOST_FILES, grace: float = GRACE):
        self.spark, self.events_path, self.comments_path = spark, f"{path}/events", f"{path}/comments"
        log = lambda name, tail, schema, lift, merge: KeyedLog(spark, f"{path}/{name}", tail, schema, "card_id", lift, merge, buckets, most_files, grace)
        self.event_log = log("states", self.events_path, EVENTS, lifted_events, folded_events)
        self.comment_log = log("said", self.comments_path, COMMENTS, lambda rows: rows, lambda rows: rows)
        self.last = 0

    def _number(self) -> int:
        self.last = max(self.last + 1, (time.time_ns() // 1000) << 12 | secrets.randbits(12))
        return self.last

    def cards(self) -> DataFrame:
        return folded_state(self.event_log.read())

    def comments(self) -> DataFrame:
        return self.comment_log.read()

    def _append(self, card_id: str, **patch: str | None) -> None:
        self.append_events([(card_id, patch)])

    def append_events(self, patches: list[tuple[str, dict[str, str | None]]]) -> None:
        """Several patches, of any cards, as one file; later ones count as later."""
        now = datetime.now(UTC).isoformat()
        rows = [(card_id, *(patch.get(f) for f in FIELDS), now, self._number()) for card_id, patch in patches]
        self.event_log.append(self.spark.createDataFrame(rows, EVENTS))

    def _exists(self, card_id: str) -> bool:
        return not self.event_log.read(card_id).isEmpty()

    def create_card(self, title: str, description: str | None = None, priority: str = "medium") -> str:
        card_id = str(uuid.uuid4())[:8]
        self._append(card_id, title=title, description=description, status=STATUSES[0], priority=priority)
        return card_id

    def update_card(self, card_id: str, title: str | None = None, description: str | None = None, priority: str | None = None, status: str | None = None) -> None:
        """Sets the fields given; any status of the lifecycle may follow any other."""
        if status is not None and status not in STATUSES:
            raise ValueError(f"status must be one of {STATUSES}, not {status!r}")
        patch = {k: v for k, v in {"title": title, "description": description, "priority": priority, "status": status}.items() if v is not None}
        if not patch:
            raise ValueError("no fields to update")
        if not self._exists(card_id):
            raise KeyError(f"card {card_id} not found")
        self._append(card_id, **patch)

    def add_comment(self, card_id: str, author: str, comment: str) -> int:
        """Appends a comment and returns its id; the card's updated_at stays."""
        if not self._exists(card_id):
            raise KeyError(f"card {card_id} not found")
        comment_id = self._number()
        self.comment_log.append(self.spark.createDataFrame([(comment_id, card_id, author, comment, datetime.now(UTC).isoformat())], COMMENTS))
        return comment_id

    def complete_card(self, card_id: str, summary: str) -> None:
        self.add_comment(card_id, "system", f"Completion: {summary}")
        self.update_card(card_id, status=STATUSES[2])
