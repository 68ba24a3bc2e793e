"""SQLite card stores and git states, read on the driver: both are small files beside a checkout."""

from __future__ import annotations

import sqlite3
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skeinwork.model import CARDS, COMMENTS


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str | None]:
    """Cards, comments and an error. A missing store is empty without one; an unreadable one is empty with one."""
    rows: dict[str, list] = {"cards": [], "card_comments": []}
    error = None
    if Path(path).exists():
        try:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                rows["cards"] = db.execute("SELECT card_id, title, description, status, priority, created_at, updated_at FROM cards ORDER BY created_at DESC, card_id").fetchall()
                rows["card_comments"] = db.execute("SELECT comment_id, card_id, author, comment, created_at FROM card_comments").fetchall()
        except sqlite3.Error as caught:
            error, rows = str(caught), {"cards": [], "card_comments": []}
    return spark.createDataFrame(rows["cards"], CARDS), spark.createDataFrame(rows["card_comments"], COMMENTS), error


def git_state(root: str, timeout: float = 10) -> tuple[bytes, bytes] | None:
    """The head commit and the changed paths of a working tree; None where git can't say."""
    ask = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True, timeout=timeout).stdout
    try:
        return ask("rev-parse", "HEAD"), ask("status", "--porcelain", "-z")
    except (OSError, subprocess.SubprocessError):
        return None
