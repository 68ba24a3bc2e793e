"""Traversals as frontier loops over a prepared adjacency, with the order of a first-in-first-out queue.

A node's key is the least array of edge ordinals over its shortest paths from the start. An ordinal numbers the edges of
one node by position; ordering by (level, key) is the order in which a queue takes nodes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.model import PropertyGraph
from skeinwork.operators.adjacency import BROADCAST_ROWS, PUSHED_ROWS, AdjacencyStore
from skeinwork.storage import checkpointed

#: Walks up to this number are finished in one plan; of more, the first ones by key are taken a step further at a time.
FEW_WALKS = 10_000
#: Edges up to this number are followed at hand, from frontiers whose ids a scan takes.
FEW_EDGES = 5000
#: Where the edges between source and target are no more than this, they are walked at hand instead of by joins.
NEAR_EDGES = 10_000
#: Prefixes of which one step looks for its batch.
BATCH_ROWS = 1000


def store_of(graph: PropertyGraph) -> AdjacencyStore:
    """The graph's prepared adjacency, or one prepared for the call."""
    return graph.adjacency or AdjacencyStore(graph.edges)


@dataclass(frozen=True)
class Around:
    """The edges of a store in one direction, as far as they are wanted; ordinals count all edges, so their order is the same."""

    store: AdjacencyStore
    direction: str
    wanted: Column | None = None

    def touched(self, frontier: DataFrame, rows: int) -> DataFrame:
        found = self.store.touched(frontier, rows, self.direction)
        return found if self.wanted is None else found.filter(self.wanted)

    def neighbours(self, frontier: DataFrame, rows: int) -> DataFrame:
        """As touched, without ordinals."""
        return self.store.neighbours(frontier, rows, self.direction, self.wanted)

    @property
    def back(self) -> Around:
        """The same edges from their other ends."""
        return Around(self.store, {"out": "in", "in": "out"}.get(self.direction, self.direction), self.wanted)

    def few(self, ids: list[str]) -> list[Row] | None:
        """(node, other, ord) of the edges of a few nodes, or None where there are more than FEW_EDGES."""
        found = self.store.of_ids(ids, self.direction)
        rows = (found if self.wanted is None else found.filter(self.wanted)).select("node", "other", "ord").limit(FEW_EDGES + 1).collect()
        return rows if len(rows) <= FEW_EDGES else None

    def few_ends(self, ids: list[str]) -> set[str] | None:
        """The other ends of the edges of a few nodes, or None where there are more than FEW_EDGES edges."""
        start = self.store.spark.createDataFrame([(i,) for i in ids], "node string")
        rows = self.neighbours(start, len(ids)).select("other").limit(FEW_EDGES + 1).collect()
        return {r["other"] for r in rows} - {None} if len(rows) <= FEW_EDGES else None


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast where its rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _settled(df: DataFrame) -> tuple[DataFrame, int]:
    """df as a table, computed once, and its number of rows."""
    table = checkpointed(df)
    return table, table.count()


def levels(around: Around, start: DataFrame, depth: int) -> DataFrame:
    """(node, level, key) of the nodes within `depth` steps of start (node); start nodes have level 0 and need not exist."""
    spark, schema = around.store.spark, "node string, level int, key array<int>"
    few = [r["node"] for r in start.select("node").distinct().limit(PUSHED_ROWS + 1).collect()]
    at_hand = {node: (0, []) for node in few} if len(few) <= PUSHED_ROWS else None
    frontier = few
    level = 1
    while at_hand is not None and level <= depth and frontier:
        edges = around.few(frontier) if len(frontier) <= PUSHED_ROWS else None
        if edges is None:
            break
        reached: dict[str, list[int]] = {}
        for r in edges:
            key = [*at_hand[r["node"]][1], r["ord"]]
            if r["other"] is not None and r["other"] not in at_hand and (r["other"] not in reached or key < reached[r["other"]]):
                reached[r["other"]] = key
        at_hand |= {node: (level, key) for node, key in reached.items()}
        frontier, level = sorted(reached), level + 1
    if at_hand is not None:
        visited, total = spark.createDataFrame([(n, *facts) for n, facts in at_hand.items()], schema), len(at_hand)
        if level > depth or not frontier:
            return visited
        frame, rows = visited.filter(F.col("level") == level - 1), len(frontier)
    else:
        frame, rows = _settled(start.select("node").distinct().select("node", F.lit(0).alias("level"), F.array().cast("array<int>").alias("key")))
        visited, total = frame, rows
    for step in range(level, depth + 1):
        touched = around.touched(frame.select("node", "key"), rows)
        reached = touched.filter("other IS NOT NULL").groupBy("other").agg(F.min(F.concat("key", F.array("ord"))).alias("key"))
        new = reached.select(F.col("other").alias("node"), F.lit(step).alias("level"), "key").join(sized(visited.select("node"), total), "node", "left_anti")
        frame, rows = _settled(new)
        if not rows:
            break
        visited, total = visited.unionByName(frame), total + rows
    return visited


class Search:
    """A breadth-first search without order, extended a level at a time.

    While its nodes are few they are at hand (node -> level) and a step is one scan for them; then they are tables.
    """

    def __init__(self, around: Around, start: DataFrame):
        self.around, self.level, self.spark = around, 0, around.store.spark
        few = [r["node"] for r in start.select("node").distinct().limit(PUSHED_ROWS + 1).collect()]
        self.at_hand: dict[str, int] | None = dict.fromkeys(few, 0)
        self.last = few
        if len(few) > PUSHED_ROWS:
            self._to_tables(start.select("node").distinct().withColumn("level", F.lit(0)))

    def _to_tables(self, frontier: DataFrame | None = None) -> None:
        if frontier is None:
            self.tables, self.total = self._as_frame(), len(self.at_hand)
            self.frontier, self.rows = self.tables.filter(F.col("level") == self.level), len(self.last)
        else:
            self.frontier, self.rows = _settled(frontier)
            self.tables, self.total = self.frontier, self.rows
        self.at_hand = None

    def _as_frame(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.at_hand.items()), "node string, level int")

    @property
    def visited(self) -> DataFrame:
        """(node, level)"""
        return self.tables if self.at_hand is None else self._as_frame()

    @property
    def count(self) -> int:
        """How many nodes are visited."""
        return self.total if self.at_hand is None else len(self.at_hand)

    def step(self, other: Search | None = None, within: int = 0) -> None:
        """Adds the next level; only nodes that another search has reached within so many steps, if one is given."""
        if self.at_hand is not None:
            if not self.last:
                self.level += 1
                return
            ends = self.around.few_ends(self.last) if len(self.last) <= PUSHED_ROWS else None
            if ends is not None:
                new = ends - self.at_hand.keys()
                if other is not None and other.at_hand is not None:
                    new = {n for n in new if other.at_hand.get(n, within + 1) <= within}
                elif other is not None and new:
                    own = self.spark.createDataFrame([(n,) for n in new], "node string")
                    new = {r["node"] for r in other.visited.filter(F.col("level") <= within).join(F.broadcast(own), "node", "left_semi").collect()}
                self.level += 1
                self.at_hand |= dict.fromkeys(new, self.level)
                self.last = sorted(new)
                return
            self._to_tables()
        self.level += 1
        if not self.rows:
            return
        if other is not None and other.at_hand is not None:
            # the other search's nodes are fewer than the frontier's edges: their own edges that end in the frontier
            theirs = [(n,) for n, level in other.at_hand.items() if level <= within]
            ends = self.around.back.neighbours(self.spark.createDataFrame(theirs, "node string"), len(theirs))
            frontier = self.frontier.select(F.col("node").alias("other"))
            reached = ends.join(sized(frontier, self.rows), "other", "left_semi").select("node").distinct()
        else:
            reached = self.around.neighbours(self.frontier.select("node"), self.rows).filter("other IS NOT NULL").select(F.col("other").alias("node")).distinct()
        if other is not None and other.at_hand is None:
            reached = reached.join(other.visited.filter(F.col("level") <= within).select("node"), "node", "left_semi")
        self.frontier, self.rows = _settled(reached.join(sized(self.tables.select("node"), self.total), "node", "left_anti").withColumn("level", F.lit(self.level)))
        if self.rows:
            self.tables, self.total = self.tables.unionByName(self.frontier), self.total + self.rows


def distances(around: Around, start: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """(node, level) as levels has them, without keys, and how many there are."""
    search = Search(around, start)
    for _ in range(depth):
        search.step()
    return search.visited, search.count


def _between(store: AdjacencyStore, source: str, target: str, most: int, directed: bool, wanted: Column | None = None) -> tuple[DataFrame, int]:
    """(node, ahead, left), and how many, of the nodes whose distances from the source and to the target add up to at most `most`.

    Both searches go half the way freely, and then only over nodes that the other one has reached in time.
    """
    one = lambda node: store.spark.createDataFrame([(node,)], "node string")
    ahead, behind = Search(Around(store, "out" if directed else "both", wanted), one(source)), Search(Around(store, "in" if directed else "both", wanted), one(target))
    half = (most + 1) // 2
    for _ in range(half):
        ahead.step()
    for level in range(1, most + 1):
        behind.step(*((ahead, most - level) if level > most - half else ()))
    for level in range(half + 1, most + 1):
        ahead.step(behind, most - level)
    if ahead.at_hand is not None and behind.at_hand is not None:
        near = [(n, a, behind.at_hand[n]) for n, a in ahead.at_hand.items() if a + behind.at_hand.get(n, most + 1) <= most]
        return store.spark.createDataFrame(near, "node string, ahead int, left int"), len(near)
    near = ahead.visited.select("node", F.col("level").alias("ahead")).join(behind.visited.select("node", F.col("level").alias("left")), "node")
    return _settled(near.filter(F.col("ahead") + F.col("left") <= most))


class PathFinder:
    """The simple paths of one length after another, each length's by key, until there are enough.

    A backward pass over the nodes between source and target counts the walks that lead from each to the target in so many
    steps. Of the prefixes of a length the first ones by key are taken further, as many as their walks promise the paths
    still wanted (more in every turn, as walks need not be simple), and the others wait. So what is expanded grows with the
    paths wanted and the degrees on the way, not with all walks.
    """

    def __init__(self, store: AdjacencyStore, source: str, target: str, most: int, cap: int, directed: bool, wanted: Column | None = None):
        self.spark, self.source, self.target, self.cap = store.spark, source, target, cap
        near, rows = _between(store, source, target, most, directed, wanted)
        ends = near.select(F.col("node").alias("other"), "left")
        edges = Around(store, "out" if directed else "both", wanted).touched(near.filter(F.col("node") != target).select("node", "ahead"), rows) if rows else None
        self.edges, self.edge_rows, self.ways, self.expanded = None, 0, [], 0
        if edges is None:
            return
        edges = edges.filter(F.col("other") != source).join(sized(ends, rows), "other").filter(F.col("ahead") + 1 + F.col("left") <= most)
        self.edges = checkpointed(edges.select("node", "other", "rel", "ord"))
        self.edge_rows = self.edges.count()
        if self.edge_rows <= NEAR_EDGES:
            return
        ways = self.spark.createDataFrame([(target, 1)], "node string, n int")
        for _ in range(most):
            self.ways.append(ways)
            led = self.edges.join(ways.select(F.col("node").alias("other"), "n"), "other").groupBy("node").agg(F.least(F.sum("n"), F.lit(FEW_WALKS + 1)).cast("int").alias("n"))
            ways = checkpointed(led)
        self.ways.append(ways)

    def _step(self, walks: DataFrame, left: int, rows: int) -> DataFrame:
        """walks, one edge further, with the number of ways to go on from there in `left` - 1 steps."""
        onward = sized(walks.withColumnRenamed("last", "node").drop("n"), rows).join(sized(self.edges, self.edge_rows), "node").filter(~F.array_contains("nodes", F.col("other")))
        onward = onward.join(self.ways[left - 1].select(F.col("node").alias("other"), "n"), "other")
        return onward.select(F.col("other").alias("last"), F.array_append("nodes", F.col("other")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("key", F.col("ord")).alias("key"), "n")

    def of_length(self, length: int, wanted: int) -> list[DataFrame]:
        """Tables of (nodes, rels, key), by key, that hold the first `wanted` simple paths of a length, or all."""
        begin = [r["n"] for r in self.ways[length].filter(F.col("node") == self.source).collect()]
        if not begin:
            return []
        walks = self.spark.createDataFrame([(self.source, [self.source], [], [], begin[0])], "last string, nodes array<string>, rels array<string>, key array<int>, n int")
        waiting, found, turns = [(length, walks, 1)], [], 0
        while waiting and wanted > 0:
            left, walks, rows = waiting.pop()
            first = walks.select("key", "n").orderBy("key").limit(BATCH_ROWS).collect()
            taken, promised = 0, 0
            while taken < len(first) and promised < wanted << turns:
                promised += first[taken]["n"]
                taken += 1
            turns += 1
            if taken < rows:
                cut = F.array(*(F.lit(x) for x in first[taken - 1]["key"])).cast("array<int>")
                waiting.append((left, walks.filter(F.col("key") > cut), rows - taken))
                walks = walks.filter(F.col("key") <= cut)
            for ahead in range(left, 0, -1) if promised <= FEW_WALKS else [left]:
                walks, left = self._step(walks, ahead, promised if promised <= FEW_WALKS else taken), ahead - 1
            walks = checkpointed(walks)
            rows = walks.count()
            self.expanded += rows
            if rows and not left:
                found.append(walks.orderBy("key").limit(wanted))
                wanted -= rows
            elif rows:
                waiting.append((left, walks, rows))
        return found

    def _near(self, most: int) -> list[tuple]:
        """(nodes, rels, key) of the first paths, from edges that are few."""
        around: dict[str, list[tuple]] = {}
        for r in self.edges.orderBy("node", "ord").collect():
            around.setdefault(r["node"], []).append((r["other"], r["rel"], r["ord"]))
        ways = [{self.target: 1}]
        for _ in range(most):
            ways.append({n: total for n, out in around.items() if (total := sum(ways[-1].get(other, 0) for other, *_ in out))})

        def walk(nodes: list[str], rels: list[str], key: list[int], left: int) -> Iterator[tuple]:
            if not left:
                yield nodes, rels, key
            for other, rel, at in around.get(nodes[-1], ()) if left else ():
                if other not in nodes and other in ways[left - 1]:
                    yield from walk([*nodes, other], [*rels, rel], [*key, at], left - 1)

        every = (path for length in range(1, most + 1) if self.source in ways[length] for path in walk([self.source], [], [], length))
        return list(islice(every, self.cap))

    def first(self, most: int) -> DataFrame | None:
        """(nodes, rels, key) of the first `cap` simple paths of at most `most` edges, and perhaps a few more; None if there is none."""
        if self.edges is not None and self.edge_rows <= NEAR_EDGES:
            near = self._near(most)
            return self.spark.createDataFrame(near, "nodes array<string>, rels array<string>, key array<int>") if near else None
        found, have = [], 0
        for length in range(1, most + 1) if self.edges is not None else []:
            for table in self.of_length(length, self.cap - have):
                found.append(table)
                have += table.count()
            if have >= self.cap:
                break
        every = found[0] if found else None
        for table in found[1:]:
            every = every.unionByName(table)
        return every


def simple_paths(store: AdjacencyStore, source: str, target: str, max_depth: int, cap: int, directed: bool = True, wanted: Column | None = None) -> DataFrame:
    """(rank, nodes, rels): the first `cap` simple paths of at most max_depth edges, as a queue finds them.

    Parallel edges give paths of their own. A source that is the target is one path without edges, known or not. A cap of 0
    or less, and a negative depth, give no rows. wanted is a condition on `rel` that edges must meet.
    """
    none = store.spark.createDataFrame([], "rank int, nodes array<string>, rels array<string>")
    if cap <= 0 or max_depth < 0:
        return none
    if source == target:
        return store.spark.createDataFrame([(1, [source], [])], none.schema)
    hits = PathFinder(store, source, target, max_depth, cap, directed, wanted).first(max_depth)
    if hits is None:
        return none
    order = (F.size("key"), F.col("key"))
    first = hits.orderBy(*order).limit(cap)  # at most max_depth times cap rows are left to rank
    return first.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "nodes", "rels")


def dependency_rows(store: AdjacencyStore, start: DataFrame, depth: int) -> DataFrame:
    """(other, rel, depth, order_key): each edge within reach once, from the end that a queue takes out first."""
    around = Around(store, "both")
    found = levels(around, start, depth)
    inner = found.filter(F.col("level") < depth)
    touched = around.touched(inner, inner.count())
    theirs = found.select(F.col("node").alias("other"), F.col("level").alias("their_level"), F.col("key").alias("their_key"))
    later = F.col("their_level").isNull() | (F.struct(F.col("their_level").alias("l"), F.col("their_key").alias("k")) > F.struct(F.col("level").alias("l"), F.col("key").alias("k")))
    rows = touched.join(theirs, "other", "left").filter(later & ~F.col("node").eqNullSafe(F.col("other")))
    return rows.select("other", "rel", (F.col("level") + 1).alias("depth"), F.concat("key", F.array("ord")).alias("order_key"))


def caller_rows(around: Around, start: DataFrame, transitive: bool, max_depth: int, cap: int | None) -> DataFrame:
    """(caller, rel, depth): inbound call edges of the start, and of its callers in turn.

    Direct rows always come whole. A node at level l of at most max_depth - 1 adds its inbound edges at depth l + 1; with
    a cap, nodes are taken in queue order while the rows before them number fewer than the cap.
    """
    direct = around.neighbours(start.select("node"), 1).select(F.col("other").alias("caller"), "rel", F.lit(1).alias("depth"))
    if not transitive:
        return direct
    if cap is None:
        found, rows = distances(around, start, max(0, max_depth - 1))
        kept = found.filter("level >= 1").select("node", "level")
    else:
        have, found = direct.count(), None
        for depth in range(1, max_depth):
            found = checkpointed(levels(around, start, depth).filter("level >= 1"))
            rows = found.count()
            counts = checkpointed(around.neighbours(found.select("node"), rows).groupBy("node").count())
            total = counts.agg(F.sum("count")).first()[0] or 0
            if have + total >= cap or found.filter(F.col("level") == depth).isEmpty():  # no node further away is taken
                break
        if found is None:
            return direct
        first = found.join(counts, "node").orderBy("level", "key").limit(cap)  # each adds a row at least, so no later one counts
        before = F.sum("count").over(W.orderBy("level", "key").rowsBetween(W.unboundedPreceding, -1))
        chosen = first.withColumn("before", F.coalesce(before, F.lit(0)) + have).filter(F.col("before") < cap)
        kept = checkpointed(chosen.select("node", "level"))
        rows = kept.count()
    inbound = around.neighbours(kept, rows)
    return direct.unionByName(inbound.select(F.col("other").alias("caller"), "rel", (F.col("level") + 1).alias("depth")))
