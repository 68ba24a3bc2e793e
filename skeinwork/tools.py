"""The query tools by name, each giving a QueryResult: rows as dictionaries, warnings instead of exceptions.

A thin adapter for callers who want small answers; plans that go on use the operators' DataFrames.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import predicates as P
from skeinwork.model import Catalog, PropertyGraph, QueryResult
from skeinwork.operators import catalog_build, code, schema
from skeinwork.operators import graph as graphs
from skeinwork.operators.cards import CardStore, card_with_comments, list_cards
from skeinwork.operators.freshness import DEFAULT_TTL, GraphCache, materialised
from skeinwork.operators.snapshots import SharedGraph
from skeinwork.sources.card_stores import board_of_all


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _buckets(rows: list[dict], key: str, names: tuple[str, ...]) -> dict[str, list[dict]]:
    return {n: [{k: v for k, v in r.items() if k != key} for r in rows if r[key] == n] for n in names}


def _answer(kind: str):
    """Turns a method's (results, warnings, truncated) into an envelope; what it raises becomes a warning."""

    def wrap(method: Callable) -> Callable:
        @functools.wraps(method)
        def call(self, *args, **kwargs) -> QueryResult:
            asked = {"tool": method.__name__, "args": list(args), **kwargs}
            name = kind if kind != "any" else kwargs.get("graph", "code")
            try:
                results, *rest = method(self, *args, **kwargs)
            except Exception as error:
                return QueryResult(name, asked, {}, [str(error)])
            warnings = list(rest[0]) if rest else []
            return QueryResult(name, asked, results, warnings, bool(rest[1]) if len(rest) > 1 else False)

        return call

    return wrap


class Tools:
    """Tools over a code graph, a catalog and a card store.

    load_code and load_catalog are called when a tool needs them; the whole database graph is kept for `ttl` seconds and
    served stale, with a warning, while it can't be rebuilt. shared is a path at which several processes share it. load_registry
    gives the registered projects (slug, root), whose stores make the board of all.
    """

    def __init__(self, load_code: Callable[[], PropertyGraph], load_catalog: Callable[[], Catalog], cards: CardStore, ttl: float = DEFAULT_TTL, code_path: str | None = None, shared: str | None = None, load_registry: Callable[[], DataFrame] | None = None):
        self.load_code, self.load_catalog, self.store, self.code_path, self.load_registry = load_code, load_catalog, cards, code_path, load_registry
        build = lambda: catalog_build.build_graph(load_catalog())
        self.database = SharedGraph(cards.spark, shared, build, ttl) if shared else GraphCache(lambda: materialised(build()), ttl)

    def _graph(self, name: str) -> tuple[PropertyGraph, list[str]]:
        if name == "code":
            return self.load_code(), []
        if name != "database":
            raise ValueError(f"graph must be code or database, not {name!r}")
        built, warnings = self.database.get()
        return catalog_build.generic(built), warnings

    @_answer("any")
    def graph_search_nodes(self, query: str, graph: str = "code", node_type: str | None = None, fuzzy: bool = False, limit: int = 50):
        found, warnings = self._graph(graph)
        rows = _rows(graphs.search_nodes(found, query, node_type, fuzzy, limit).select("id", "label", "type", "attrs"))
        return rows, warnings, limit > 0 and len(rows) >= limit

    @_answer("any")
    def graph_get_node(self, node_id: str, graph: str = "code"):
        found, warnings = self._graph(graph)
        rows = _rows(graphs.get_node(found, node_id).select("id", "label", "type", "attrs"))
        return (rows[0], warnings) if rows else ({}, [*warnings, f"Node {node_id} not found"])

    @_answer("any")
    def graph_get_neighbors(self, node_id: str, graph: str = "code", direction: str = "both", relationship: str | None = None):
        found, warnings = self._graph(graph)
        rows = _rows(graphs.neighbors(found, node_id, direction, relationship))
        return _buckets(rows, "direction", ("incoming", "outgoing")), warnings

    @_answer("any")
    def graph_find_path(self, source: str, target: str, graph: str = "code", max_depth: int = 5, directed: bool = True):
        found, warnings = self._graph(graph)
        return {"paths": _rows(graphs.find_paths(found, source, target, max_depth, directed).orderBy("rank"))}, warnings

    @_answer("any")
    def graph_get_subgraph(self, seed_nodes: list[str], graph: str = "code", depth: int = 1):
        found, warnings = self._graph(graph)
        part = graphs.subgraph(found, seed_nodes, depth)
        return {"nodes": _rows(part.nodes.select("id", "label", "type", "attrs")), "edges": _rows(part.edges.select("src", "dst", "rel"))}, warnings

    @_answer("any")
    def graph_status(self, graph: str = "code"):
        """Counts, and the path, size and time of what holds the graph: the code graph's file, or the version of the database
        graph that processes share. A graph kept by this process alone has none."""
        found, warnings = self._graph(graph)
        path = size = changed = None
        if graph == "code" and self.code_path and os.path.exists(self.code_path):
            stat = os.stat(self.code_path)
            path, size, changed = self.code_path, stat.st_size, stat.st_mtime
        elif graph == "code":
            path = self.code_path
        elif isinstance(self.database, SharedGraph) and (stored := self.database.facts()):
            path, size, changed = stored["path"], stored["size"], stored["built_at"]
        modified = None if changed is None else datetime.fromtimestamp(changed, UTC).isoformat()
        facts = {"path": path, "exists": graph == "database" or size is not None, "size": size, "modified": modified}
        return facts | {"node_count": found.nodes.count(), "edge_count": found.edges.count()}, warnings

    @_answer("any")
    def graph_refresh(self, graph: str = "code"):
        """The database graph is rebuilt unless it is fresh; a code graph is read anew by every call anyway."""
        _, warnings = self._graph(graph)
        return {"refreshed": not warnings}, warnings

    @_answer("code")
    def code_get_symbol(self, symbol: str):
        found = self.load_code()
        node = _rows(found.nodes.filter(P.symbol_matches(symbol)).orderBy("pos").limit(1).select("id", "label", "type", "attrs"))
        if not node:
            return {}, [f"Symbol {symbol} not found"]
        return {"symbol": node[0], **_buckets(_rows(code.symbol_edges(found, symbol)), "bucket", ("callers", "callees", "imports"))}, []

    @_answer("code")
    def code_search_symbols(self, query: str, symbol_type: str | None = None):
        return _rows(code.search_symbols(self.load_code(), query, symbol_type).orderBy("pos").select("id", "label", "type", "attrs")), []

    def _resolved(self, symbol: str) -> tuple[PropertyGraph, list[str]]:
        found = self.load_code()
        return found, [f"Symbol {symbol} not found"] if code.resolve(found, P.symbol_in_id(symbol)).isEmpty() else []

    @_answer("code")
    def code_get_dependencies(self, symbol: str, depth: int = 2):
        found, missing = self._resolved(symbol)
        return ({}, missing) if missing else (_buckets(_rows(code.dependencies(found, symbol, depth).orderBy("depth", "order_key").drop("order_key")), "bucket", ("incoming", "outgoing")), [])

    @_answer("code")
    def code_find_callers(self, symbol: str, transitive: bool = False, max_depth: int = 5):
        found, missing = self._resolved(symbol)
        return ({}, missing) if missing else ({"callers": _rows(code.find_callers(found, symbol, transitive, max_depth).orderBy("depth"))}, [])

    @_answer("code")
    def code_impact_analysis(self, symbol: str):
        found, missing = self._resolved(symbol)
        return ({}, missing) if missing else (_buckets(_rows(code.impact(found, symbol)), "bucket", ("direct_callers", "modules_affected", "tests", "interfaces", "entry_points")), [])

    @_answer("database")
    def db_get_table(self, table: str):
        node, edges = schema.table_lookup(self.load_catalog(), table)
        rows = _rows(node)
        return ({"table": rows[0], **_buckets(_rows(edges), "direction", ("incoming", "outgoing"))}, []) if rows else ({}, [f"Table {table} not found"])

    @_answer("database")
    def db_get_column(self, table: str, column: str):
        rows = _rows(schema.column_lookup(self.load_catalog(), table, column))
        return (rows[0], []) if rows else ({}, [f"Column {table}.{column} not found"])

    @_answer("database")
    def db_search_schema(self, query: str, object_type: str | None = None):
        built, warnings = self.database.get()
        return _rows(schema.schema_search(built, query, object_type).orderBy("id")), warnings

    @_answer("database")
    def db_get_table_relationships(self, table: str):
        return _buckets(_rows(schema.table_relationships(self.load_catalog(), table)), "direction", ("incoming", "outgoing")), []

    @_answer("database")
    def db_find_relationship_path(self, table1: str, table2: str):
        built, warnings = self.database.get()
        return {"paths": _rows(schema.relationship_paths(built, table1, table2).orderBy("rank"))}, warnings

    @_answer("database")
    def db_get_routine_dependencies(self, routine: str):
        return {"dependencies": _buckets(_rows(schema.routine_dependencies(self.load_catalog(), routine)), "bucket", ("tables", "columns"))}, []

    @_answer("cards")
    def create_card(self, title: str, description: str | None = None, priority: str = "medium"):
        return self._card(self.store.create_card(title, description, priority)), []

    @_answer("cards")
    def list_cards(self, status: str | None = None, priority: str | None = None):
        rows = _rows(list_cards(self.store.cards(), status, priority))
        return {"cards": rows, "total": len(rows)}, []  # of the rows that were asked for, all of which are here

    @_answer("cards")
    def get_card(self, card_id: str):
        return self._card(card_id) | {"comments": _rows(self.store.comments().filter(F.col("card_id") == card_id).orderBy("created_at", "comment_id"))}, []

    @_answer("cards")
    def update_card(self, card_id: str, **fields: str | None):
        self.store.update_card(card_id, **fields)
        return self._card(card_id), []

    @_answer("cards")
    def add_comment(self, card_id: str, author: str, comment: str):
        return {"comment_id": self.store.add_comment(card_id, author, comment)}, []

    @_answer("cards")
    def complete_card(self, card_id: str, summary: str):
        self.store.complete_card(card_id, summary)
        return self._card(card_id), []

    @_answer("cards")
    def board_of_projects(self):
        """Every registered project with its counts, or its store's error, and the newest cards of its columns."""
        if self.load_registry is None:
            return {"projects": []}, ["no registry of projects"]
        counts, newest = board_of_all(self.store.spark, self.load_registry())
        shown = newest.orderBy("project", "bucket", "place").select("project", "bucket", "card_id", "title", "priority")
        columns: dict[str, dict[str, list]] = {}
        for r in _rows(shown):
            columns.setdefault(r["project"], {}).setdefault(r["bucket"], []).append({k: r[k] for k in ("card_id", "title", "priority")})
        projects = [r | {"columns": columns.get(r["project"], {})} for r in _rows(counts.orderBy("place"))]
        return {"projects": projects}, [f"{r['project']}: {r['error']}" for r in projects if r["error"]]

    def _card(self, card_id: str) -> dict:
        rows = _rows(card_with_comments(self.store.cards(), self.store.comments().limit(0), card_id).limit(1))
        if not rows:
            raise KeyError(f"card {card_id} not found")
        return {k: v for k, v in rows[0].items() if k not in ("comment_id", "author", "comment", "commented_at")}
