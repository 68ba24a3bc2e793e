"""Board analytics over the cards of many projects: (project, card_id, status, created_at, updated_at, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.model import STATUSES

OTHER = "Other"


def bucketed(cards: DataFrame) -> DataFrame:
    """cards with `bucket`: the status, or Other for one outside the lifecycle."""
    return cards.withColumn("bucket", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(OTHER))


def column_counts(cards: DataFrame, projects: DataFrame | None = None, top: int = 3) -> DataFrame:
    """Per project: cards created, in progress, complete and other, the total of the lifecycle, whether any column has more
    than `top` cards, and the last activity (null and empty times ignored). Projects without cards come with zeros."""
    names = {"Created": "created", "In Progress": "in_progress", "Complete": "complete", OTHER: "other"}
    rows = bucketed(cards)
    per = rows.groupBy("project").agg(
        *(F.count(F.when(F.col("bucket") == s, 1)).alias(n) for s, n in names.items()),
        F.max(F.when(F.col("updated_at").cast("string") != "", F.col("updated_at"))).alias("last_activity"),
    )
    if projects is not None:
        per = projects.select("project").distinct().join(per, "project", "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in names.values()]
    full = per.select("project", *zero, "last_activity")
    return full.withColumn("total", F.col("created") + F.col("in_progress") + F.col("complete")).withColumn("collapsed", F.greatest(*names.values()) > top)


def newest(cards: DataFrame, top: int | None = 3) -> DataFrame:
    """The `top` newest cards of each project and bucket (None: all), with their place; equal times go by card_id."""
    place = F.row_number().over(W.partitionBy("project", "bucket").orderBy(F.desc("created_at"), "card_id"))
    ranked = bucketed(cards).withColumn("place", place)
    return ranked if top is None else ranked.filter(F.col("place") <= top)


def project_order(cards: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(place, project, last_activity): latest activity first, inactive projects last, then by name; a row per project.

    Places need one order of all projects, so one task ranks them; they are the rows of an aggregate, one each.
    """
    per = column_counts(cards, projects).select("project", "last_activity")
    return per.select(F.row_number().over(W.orderBy(F.desc_nulls_last("last_activity"), "project")).alias("place"), "project", "last_activity")


def card_page(cards: DataFrame) -> DataFrame:
    """Cards as a list page shows them: the first 8, 16 and 19 characters of id, update and creation time."""
    cut = lambda name, n: F.substring(F.col(name).cast("string"), 1, n).alias(name)
    return cards.withColumns({"card_id": cut("card_id", 8), "updated_at": cut("updated_at", 16), "created_at": cut("created_at", 19)})
