"""Predicates of searches and filters. A missing string counts as empty, so no predicate is ever null (deviation D1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders whose files never matter, and the suffixes of files that do.
IGNORED_PARTS = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".next", "coverage")
SOURCE_SUFFIXES = (
    ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".kt", ".kts", ".go", ".rs", ".c", ".h", ".cpp", ".hpp", ".cs", ".rb", ".php", ".swift", ".scala",
    ".sh", ".bash", ".zsh", ".sql", ".md", ".mdx", ".rst", ".html", ".css", ".scss", ".vue", ".svelte", ".toml", ".yaml", ".yml", ".json",
)


def text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def exact(query: str, *names: str) -> Column:
    """Equality with any of the columns."""
    return _any(text(n) == query for n in names)


def holds(query: str, *names: str) -> Column:
    """Substring of any of the columns without regard to case; % and _ mean themselves."""
    return _any(F.lower(text(n)).contains(query.lower()) for n in names)


def symbol_in_id(symbol: str) -> Column:
    return text("id").contains(symbol)


def symbol_matches(symbol: str) -> Column:
    """Substring of the id or the whole label."""
    return symbol_in_id(symbol) | (text("label") == symbol)


def type_holds(kind: str) -> Column:
    return text("type").contains(kind)


def equal_if_given(name: str, value: str | None) -> Column:
    """Equality, or nothing asked where the value is None or empty."""
    return F.lit(True) if not value else text(name) == value


def without_prefix(name: str) -> Column:
    """An id without what stands before its first colon."""
    return F.regexp_replace(text(name), "^[^:]*:", "")


def is_generated(path: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a path is one of the folders that tools write, or lies in one; a null path is none."""
    path = F.coalesce(path, F.lit(""))
    return _any((path == p.rstrip("/")) | path.startswith(p) for p in prefixes)


def is_relevant_source(path: Column, generated: tuple[str, ...] = ()) -> Column:
    """Not generated, in no ignored folder (nor in one named like the first part of a generated one), and of a known suffix
    (in lower case). A null path is none."""
    path = F.coalesce(path, F.lit(""))
    ignored = [*IGNORED_PARTS, *sorted({p.split("/")[0] for p in generated})]
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))
    return ~is_generated(path, generated) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored))) & suffix.isin(*SOURCE_SUFFIXES)


def type_display() -> Column:
    """The display form of a SQL type from data_type, max_length, precision and scale."""
    kind, length = F.col("data_type"), F.col("max_length")
    sized = kind.isin("varchar", "nvarchar", "char", "nchar", "binary", "varbinary")
    return (
        F.when(sized & (length == -1), F.concat(kind, F.lit("(max)")))
        .when(sized & length.isNotNull(), F.concat(kind, F.lit("("), length.cast("string"), F.lit(")")))
        .when(kind.isin("decimal", "numeric"), F.concat(kind, F.lit("("), F.coalesce(F.col("precision").cast("string"), F.lit("None")), F.lit(","), F.coalesce(F.col("scale").cast("string"), F.lit("None")), F.lit(")")))
        .when(kind.isin("datetime2", "datetimeoffset", "time") & F.col("scale").isNotNull(), F.concat(kind, F.lit("("), F.col("scale").cast("string"), F.lit(")")))
        .otherwise(kind)
    )


def _any(conditions) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found
