"""DuckDB SQL for the queries, over the same tables as views."""

from __future__ import annotations

import re

from skeinwork.functions.predicates import IGNORED_PARTS, SOURCE_SUFFIXES
from skeinwork.plans.workload import EXTRACT_IDS, TABLE_ID

ENT = """
e AS (
  SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'calls' AS rel FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'calls' FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'calls' FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports' FROM supplier
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'depends-on' FROM lineitem
), n AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'entity/region' AS type FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'entity/nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'entity/customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'entity/supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'entity/part' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, o_orderpriority, 'entity/order' FROM orders
)"""

BOTH = """
both_ends AS (SELECT src AS node, dst AS other, rel, src, dst, 0 AS side FROM e UNION ALL SELECT dst, src, rel, src, dst, 1 FROM e),
adj AS (SELECT node, other, rel, row_number() OVER (PARTITION BY node ORDER BY src, dst, rel, side) AS ord FROM both_ends)"""


def ent(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{ENT}{body}"


_SYSTEM = """
schemas AS (SELECT n_nationkey AS schema_id, n_name AS name FROM nation),
tables AS (SELECT c_custkey AS object_id, c_name AS name, n_name AS schema_name, c_mktsegment AS temporal_type_desc FROM customer JOIN nation ON n_nationkey = c_nationkey),
own AS (SELECT * FROM tables WHERE object_id % 10 <> 0),
columns AS (SELECT o_custkey AS object_id, o_orderkey AS column_id, 'c' || o_orderkey AS name, CAST(substr(o_orderpriority, 1, 1) AS INT) AS type_id, o_orderkey % 40 - 1 AS size, o_orderkey % 2 AS nulls, o_orderstatus AS status FROM orders),
codes AS (SELECT p_partkey, p_name || ' ' || p_partkey AS p_name, p_type, p_brand, n_name AS schema_name, ['P ', 'PC', 'FN', 'IF', 'TF', 'FS', 'FT', 'V ', 'U '][p_size % 9 + 1] AS code FROM part JOIN nation ON n_nationkey = p_partkey % 25),
routines AS (SELECT * FROM codes WHERE p_partkey % 7 <> 0 AND code NOT IN ('V ', 'U '))
"""
_DEPENDENCIES = """
SELECT DISTINCT p_partkey + 1000000 AS referencing_object_id, r.schema_name AS referencing_schema, p_name AS referencing_name, code AS referencing_type_code, t.object_id AS referenced_id,
       CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE 0 END AS referenced_minor_id, CASE WHEN l_linenumber = 2 THEN 'named' ELSE t.schema_name END AS referenced_schema,
       CASE WHEN l_linenumber = 2 THEN 'entity ' || o_custkey ELSE t.name END AS referenced_table, c.name AS referenced_column
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN routines r ON p_partkey = l_partkey JOIN tables t ON t.object_id = o_custkey
LEFT JOIN columns c ON c.object_id = t.object_id AND c.column_id = CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE 0 END
WHERE l_linenumber <> 3"""

CAT = f"""{_SYSTEM},
c AS (
  SELECT t.schema_name || '.' || t.name AS owner, t.object_id, c.column_id, c.name AS column_name, t.name AS table_name, ['int', 'nvarchar', 'nchar', 'decimal', 'varchar'][type_id] AS data_type,
         CASE WHEN type_id IN (2, 3) AND size > 0 THEN size // 2 ELSE size END AS max_length, nulls, t.object_id % 3 > 0 AND c.column_id % 3 = 0 AS is_pk
  FROM own t JOIN columns c USING (object_id)
), typed AS (
  SELECT *, CASE WHEN data_type = 'decimal' THEN 'decimal(10,0)' WHEN data_type = 'int' THEN 'int' WHEN max_length = -1 THEN data_type || '(max)' ELSE data_type || '(' || max_length || ')' END AS type_display FROM c
), fk AS (
  SELECT 'fk ' || a.column_id AS name, p.object_id AS po, p.schema_name || '.' || p.name AS pt, a.name AS pc, r.object_id AS ro, r.schema_name || '.' || r.name AS rt, b.name AS rc
  FROM columns a JOIN columns b ON b.column_id = a.column_id - 1 JOIN own p ON p.object_id = a.object_id JOIN own r ON r.object_id = b.object_id
), r AS (
  SELECT schema_name || '.' || p_name AS full_name, p_name AS name, p_partkey + 1000000 AS object_id, CASE WHEN code IN ('P ', 'PC') THEN 'Procedure' ELSE 'Function' END AS kind, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS definition FROM routines
), d AS ({_DEPENDENCIES}),
nodes AS (
  SELECT 'table:' || schema_name || '.' || name AS id, 'Table' AS node_type, name, schema_name || '.' || name AS qualified_name, object_id, NULL::BIGINT AS column_id, NULL::VARCHAR AS type_display, NULL::VARCHAR AS data_type,
         false AS is_primary_key, false AS is_foreign_key, false AS is_referenced_key, NULL::VARCHAR AS definition_sha256 FROM own
  UNION ALL SELECT 'column:' || owner || '.' || column_name, 'Column', column_name, owner || '.' || column_name, object_id, column_id, type_display, data_type, is_pk,
         (owner, column_name) IN (SELECT (pt, pc) FROM fk), (owner, column_name) IN (SELECT (rt, rc) FROM fk), NULL FROM typed
  UNION ALL SELECT lower(kind) || ':' || full_name, kind, name, full_name, object_id, NULL, NULL, NULL, false, false, false, CASE WHEN definition <> '' THEN sha256(definition) END FROM r
),
raw_edges AS (
  SELECT 'table:' || owner AS source, 'column:' || owner || '.' || column_name AS target, 'Stores' AS relationship, column_id AS ordinal, NULL::VARCHAR AS foreign_key_name, NULL::VARCHAR AS target_kind, 0 AS kind, '' AS pname, column_id AS number FROM c
  UNION ALL SELECT 'column:' || pt || '.' || pc, 'column:' || rt || '.' || rc, 'Links', NULL, name, NULL, 1, name, 1 FROM fk
  UNION ALL SELECT lower(r.kind) || ':' || r.full_name, CASE WHEN referenced_column IS NULL THEN 'table:' ELSE 'column:' END || concat_ws('.', referenced_schema, referenced_table, referenced_column), 'Creates', NULL, NULL,
         CASE WHEN referenced_column IS NULL THEN 'Table' ELSE 'Column' END, 2, concat_ws('.', referenced_schema, referenced_table, referenced_column), referenced_minor_id FROM d JOIN r ON r.object_id = d.referencing_object_id
),
edges AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY kind, pname, number) - 1 AS key FROM raw_edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
spot AS (SELECT schema_name || '.' || name AS t FROM own WHERE object_id = {TABLE_ID}),
proc AS (SELECT full_name AS p, object_id FROM r WHERE kind = 'Procedure' ORDER BY object_id LIMIT 1)"""

NEAR = """,
links AS (SELECT po AS x, ro AS y FROM fk UNION ALL SELECT referencing_object_id, referenced_id FROM d),
sides AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk AS (SELECT {seed} AS x, 0 AS level UNION SELECT sides.y, level + 1 FROM walk JOIN sides ON sides.x = walk.x WHERE level < {depth}),
near AS (SELECT DISTINCT x FROM walk),
near_nodes AS (SELECT id FROM nodes WHERE object_id IN (SELECT x FROM near))
SELECT 'node' AS kind, id AS name FROM near_nodes
UNION ALL SELECT 'edge', source || ' ' || relationship || ' ' || target FROM edges WHERE source IN (SELECT id FROM near_nodes) AND target IN (SELECT id FROM near_nodes)"""


def cat(body: str) -> str:
    return f"WITH RECURSIVE {CAT}{body}"


CARDS = """
k AS (
  SELECT o_orderkey AS card_id, c_mktsegment AS project, c_name AS title,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'Blocked' WHEN o_orderstatus = 'O' THEN 'Created' WHEN o_orderstatus = 'P' THEN 'In Progress' ELSE 'Complete' END AS status,
         o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(shipped, '%Y-%m-%dT%H:%M:%S') AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
), b AS (SELECT *, CASE WHEN status IN ('Created', 'In Progress', 'Complete') THEN status ELSE 'Other' END AS bucket FROM k)"""

CALLS = """,
calls AS (SELECT dst AS node, src AS other, rel, row_number() OVER (PARTITION BY dst ORDER BY src, dst, rel) AS ord FROM e WHERE contains(rel, 'call')),
walk AS (
  SELECT 'region:0' AS node, 0 AS level, []::BIGINT[] AS key
  UNION ALL SELECT other, level + 1, list_append(key, ord) FROM walk JOIN calls ON calls.node = walk.node WHERE level < {most}
),
best AS (SELECT node, min(struct_pack(level := level, key := key)) AS spot FROM walk GROUP BY node)"""

_GRAPH_FACTS = """
SELECT 'node' AS kind, id AS name, node_type AS type, qualified_name, -1::BIGINT AS key FROM nodes
UNION ALL SELECT 'edge', source || ' ' || target, relationship, NULL, key::BIGINT FROM edges"""

_TABLE_EDGES = """
SELECT CASE WHEN regexp_replace(source, '^[^:]*:', '') = t THEN 'outgoing' ELSE 'incoming' END AS direction,
       CASE WHEN regexp_replace(source, '^[^:]*:', '') = t THEN regexp_replace(target, '^[^:]*:', '') ELSE regexp_replace(source, '^[^:]*:', '') END AS node, relationship
FROM edges, spot WHERE regexp_replace(source, '^[^:]*:', '') = t OR regexp_replace(target, '^[^:]*:', '') = t"""

_EXTRACTED = {
    "tables": """SELECT schema_name, name AS table_name, object_id, temporal_type_desc FROM own WHERE {ids:object_id}""",
    "columns": """
SELECT t.schema_name, t.name AS table_name, c.object_id AS table_object_id, c.column_id, c.name AS column_name, ['int', 'nvarchar', 'nchar', 'decimal', 'varchar'][type_id] AS data_type,
       CAST(CASE WHEN type_id IN (2, 3) AND size > 0 THEN size // 2 ELSE size END AS BIGINT) AS max_length, CAST(nulls AS BIGINT) AS is_nullable,
       CASE WHEN status = 'F' THEN 'default ' || column_id END AS default_definition, CASE WHEN status = 'P' THEN 'computed ' || column_id END AS computed_definition
FROM own t JOIN columns c USING (object_id) WHERE {ids:c.object_id}""",
    "primary_keys": """
SELECT t.schema_name, t.name AS table_name, c.name AS column_name, 'key ' || t.object_id AS constraint_name, CAST(c.column_id % 4 AS BIGINT) AS key_ordinal
FROM own t JOIN columns c USING (object_id) WHERE t.object_id % 3 > 0 AND c.column_id % 3 = 0 AND {ids:t.object_id}""",
    "foreign_keys": """
SELECT 'fk ' || a.column_id AS foreign_key_name, p.schema_name AS parent_schema, p.name AS parent_table, a.name AS parent_column, r.schema_name AS referenced_schema, r.name AS referenced_table, b.name AS referenced_column,
       p.object_id AS parent_object_id, r.object_id AS referenced_object_id, 'CASCADE' AS update_referential_action_desc
FROM columns a JOIN columns b ON b.column_id = a.column_id - 1 JOIN own p ON p.object_id = a.object_id JOIN own r ON r.object_id = b.object_id WHERE {ids:p.object_id} OR {ids:r.object_id}""",
    "routines": """
SELECT schema_name, p_name AS object_name, p_partkey + 1000000 AS object_id, code AS object_type_code, p_type AS type_desc, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS definition
FROM routines WHERE {ids:p_partkey + 1000000}""",
    "dependencies": _DEPENDENCIES + " AND ({ids:p_partkey + 1000000} OR {ids:t.object_id})",
}


def _extracted() -> dict[str, str]:
    """SQL of the catalog row sets, whole and for the listed objects."""
    chosen = ", ".join(map(str, EXTRACT_IDS))
    fill = lambda sql, listed: "WITH " + _SYSTEM + re.sub(r"\{ids:([^}]*)\}", rf"(\1) IN ({chosen})" if listed else "TRUE", sql)
    whole = {f"catalog_extract_{name}": fill(sql, False) for name, sql in _EXTRACTED.items()}
    return whole | {f"catalog_extract_{name}_of_ids": fill(sql, True) for name, sql in _EXTRACTED.items()}


def oracle_sql() -> dict[str, str]:
    ignored = ", ".join(f"'{x}'" for x in IGNORED_PARTS)
    suffixes = ", ".join(f"'{x}'" for x in SOURCE_SUFFIXES)
    return _extracted() | {
        "search_nodes_exact": ent(" SELECT * FROM n WHERE id = 'nation:7' OR label = 'nation:7' ORDER BY id LIMIT 50"),
        "search_nodes_fuzzy": ent(" SELECT * FROM n WHERE contains(lower(id), 'supplier:1') OR contains(lower(label), 'supplier:1')"),
        "search_nodes_typed_limit": ent(" SELECT * FROM n WHERE (contains(lower(id), '1') OR contains(lower(label), '1')) AND contains(type, 'customer') ORDER BY id LIMIT 50"),
        "search_nodes_indexed": ent(" SELECT * FROM n WHERE contains(lower(id), 'supplier:1') OR contains(lower(label), 'supplier:1')"),
        "search_symbols_indexed": ent(" SELECT * FROM n WHERE (contains(lower(id), '00077') OR contains(lower(label), '00077')) AND type = 'entity/customer'"),
        "get_node": ent(" SELECT * FROM n WHERE id = 'part:3' ORDER BY id LIMIT 1"),
        "neighbors_both": ent(
            " SELECT 'outgoing' AS direction, dst AS node, rel, CASE WHEN rel = 'calls' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM e WHERE src = 'nation:7'"
            " UNION ALL SELECT 'incoming', src, rel, CASE WHEN rel = 'calls' THEN 'EXTRACTED' ELSE 'INFERRED' END FROM e WHERE dst = 'nation:7'"
        ),
        "neighbors_out_rel": ent(" SELECT 'outgoing' AS direction, dst AS node, rel, 'INFERRED' AS confidence FROM e WHERE src = 'order:5' AND rel = 'uses'"),
        "find_paths_directed": ent(
            """, adj AS (SELECT src AS node, dst AS other, rel, row_number() OVER (PARTITION BY src ORDER BY src, dst, rel) AS ord FROM e),
            w AS (SELECT 'order:5' AS last, ['order:5'] AS nodes, []::VARCHAR[] AS rels, []::BIGINT[] AS key
                  UNION ALL SELECT other, list_append(nodes, other), list_append(rels, rel), list_append(key, ord) FROM w JOIN adj ON node = last WHERE last <> 'region:0' AND len(key) < 5 AND NOT list_contains(nodes, other)),
            h AS (SELECT *, row_number() OVER (ORDER BY len(key), key) AS rank FROM w WHERE last = 'region:0')
            SELECT rank, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels FROM h WHERE rank <= 10""",
            True,
        ),
        "find_paths_undirected": ent(
            f""", {BOTH},
            w AS (SELECT 'order:5' AS last, ['order:5'] AS nodes, []::VARCHAR[] AS rels, []::BIGINT[] AS key
                  UNION ALL SELECT other, list_append(nodes, other), list_append(rels, rel), list_append(key, ord) FROM w JOIN adj ON node = last WHERE last <> 'region:0' AND len(key) < 4 AND NOT list_contains(nodes, other)),
            h AS (SELECT *, row_number() OVER (ORDER BY len(key), key) AS rank FROM w WHERE last = 'region:0')
            SELECT rank, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels FROM h WHERE rank <= 10""",
            True,
        ),
        "subgraph_nodes": ent(f", {BOTH}, w AS (SELECT unnest(['order:5', 'unknown:1']) AS id, 0 AS level UNION SELECT other, level + 1 FROM w JOIN adj ON node = id WHERE level < 2) SELECT * FROM n WHERE id IN (SELECT id FROM w)", True),
        "subgraph_edges": ent(f", {BOTH}, w AS (SELECT unnest(['order:5', 'unknown:1']) AS id, 0 AS level UNION SELECT other, level + 1 FROM w JOIN adj ON node = id WHERE level < 2) SELECT * FROM e WHERE src IN (SELECT id FROM w) AND dst IN (SELECT id FROM w)", True),
        "graph_counts": ent(" SELECT 'node' AS kind, type AS name, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY rel"),
        "get_symbol_edges": ent(
            """, s AS (SELECT id FROM n WHERE contains(id, 'nation:7') OR label = 'nation:7' ORDER BY id LIMIT 1),
            x AS (SELECT e.*, id, CASE WHEN dst = id AND contains(rel, 'calls') THEN 'callers' WHEN src = id AND contains(rel, 'calls') THEN 'callees' WHEN rel = 'imports' THEN 'imports' END AS bucket FROM e, s WHERE src = id OR dst = id)
            SELECT bucket, CASE WHEN bucket = 'callers' THEN src WHEN bucket = 'callees' THEN dst WHEN src = id THEN dst ELSE src END AS node, rel FROM x WHERE bucket IS NOT NULL"""
        ),
        "search_symbols": ent(" SELECT * FROM n WHERE (contains(lower(id), 'nation') OR contains(lower(label), 'nation')) AND type = 'entity/nation'"),
        "dependencies": ent(
            f""", {BOTH}, s AS (SELECT id FROM n WHERE contains(id, 'order:5') ORDER BY id LIMIT 1),
            w AS (SELECT id AS node, 0 AS level, []::BIGINT[] AS key FROM s UNION ALL SELECT other, level + 1, list_append(key, ord) FROM w JOIN adj ON adj.node = w.node WHERE level < 2),
            l AS (SELECT node, min(struct_pack(level := level, key := key)) AS at FROM w GROUP BY node)
            SELECT CASE WHEN rel IN ('depends-on', 'imports', 'uses') THEN 'incoming' ELSE 'outgoing' END AS bucket, adj.other AS node, rel, (l.at.level + 1)::BIGINT AS depth, array_to_string(list_append(l.at.key, ord), ',') AS order_key
            FROM adj JOIN l ON l.node = adj.node LEFT JOIN l o ON o.node = adj.other
            WHERE l.at.level < 2 AND adj.node <> adj.other AND (o.node IS NULL OR o.at > l.at)""",
            True,
        ),
        "callers_direct": ent(" SELECT src AS caller, rel, 1::BIGINT AS depth FROM e WHERE dst = 'region:0' AND contains(rel, 'call')"),
        "callers_transitive": ent(
            CALLS.format(most=2) + " SELECT other AS caller, rel, 1::BIGINT AS depth FROM calls WHERE node = 'region:0' UNION ALL SELECT other, rel, (spot.level + 1)::BIGINT FROM best JOIN calls USING (node) WHERE spot.level BETWEEN 1 AND 2",
            True,
        ),
        "callers_capped": ent(
            CALLS.format(most=4)
            + """, direct AS (SELECT other, rel FROM calls WHERE node = 'region:0'),
            x AS (SELECT node, spot, count(*) AS rows FROM best JOIN calls USING (node) WHERE spot.level BETWEEN 1 AND 4 GROUP BY node, spot),
            y AS (SELECT node, spot, (SELECT count(*) FROM direct) + coalesce(sum(rows) OVER (ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
            SELECT other AS caller, rel, 1::BIGINT AS depth FROM direct UNION ALL SELECT other, rel, (spot.level + 1)::BIGINT FROM y JOIN calls USING (node) WHERE before < 100""",
            True,
        ),
        "impact_analysis": ent(
            """, s AS (SELECT id FROM n WHERE contains(id, 'customer:7') ORDER BY id LIMIT 1)
            SELECT CASE WHEN dst = id AND contains(rel, 'call') THEN 'direct_callers' WHEN contains(lower(dst), 'test') THEN 'tests' WHEN contains(rel, 'interface') OR contains(lower(dst), 'interface') THEN 'interfaces'
                        WHEN contains(rel, 'entry') OR contains(lower(dst), 'entry') THEN 'entry_points' ELSE 'modules_affected' END AS bucket, CASE WHEN dst = id AND contains(rel, 'call') THEN src ELSE dst END AS node
            FROM e, s WHERE (dst = id AND contains(rel, 'call')) OR src = id"""
        ),
        "catalog_nodes": cat(" SELECT * EXCLUDE (data_type) REPLACE (coalesce(column_id, 0) AS column_id) FROM nodes"),
        "catalog_edges": cat(" SELECT source, target, relationship, key::BIGINT AS key, coalesce(ordinal, 0) AS ordinal, foreign_key_name, target_kind FROM edges"),
        "catalog_summary": cat(" SELECT 'node' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY node_type UNION ALL SELECT 'edge', relationship, count(*) FROM edges GROUP BY relationship"),
        "table_lookup": cat(_TABLE_EDGES),
        "column_lookup": cat(f" SELECT id, data_type, is_primary_key, is_foreign_key, is_referenced_key FROM nodes WHERE node_type = 'Column' AND object_id = {TABLE_ID} ORDER BY column_id LIMIT 1"),
        "schema_search": cat(" SELECT id, qualified_name AS label, node_type AS type FROM nodes WHERE (contains(lower(id), 'c77') OR contains(lower(qualified_name), 'c77')) AND node_type = 'Column'"),
        "table_relationships": cat(_TABLE_EDGES),
        "table_fk_pairs": cat(f" SELECT 'outgoing' AS direction, name AS foreign_key_name, pc AS column, rt AS other_table, rc AS other_column FROM fk WHERE po = {TABLE_ID} UNION ALL SELECT 'incoming', name, rc, pt, pc FROM fk WHERE ro = {TABLE_ID}"),
        "relationship_paths": cat(
            f""", goal AS (SELECT 'table:' || rt AS g FROM fk WHERE po = {TABLE_ID} AND ro <> {TABLE_ID} ORDER BY name LIMIT 1),
            kept AS (SELECT * FROM edges WHERE relationship IN ('Stores', 'Links')),
            both_ends AS (SELECT source AS node, target AS other, relationship AS rel, source, kind, pname, number, target, 0 AS side FROM kept UNION ALL SELECT target, source, relationship, source, kind, pname, number, target, 1 FROM kept),
            adj AS (SELECT node, other, rel, row_number() OVER (PARTITION BY node ORDER BY source, kind, pname, number, target, side) AS ord FROM both_ends),
            w AS (SELECT 'table:' || t AS last, ['table:' || t] AS nodes, []::VARCHAR[] AS rels, []::BIGINT[] AS key FROM spot
                  UNION ALL SELECT other, list_append(nodes, other), list_append(rels, rel), list_append(key, ord) FROM w JOIN adj ON node = last, goal WHERE last <> g AND len(key) < 9 AND NOT list_contains(nodes, other)),
            h AS (SELECT w.*, row_number() OVER (ORDER BY len(key), key) AS rank FROM w, goal WHERE last = g)
            SELECT rank, array_to_string([regexp_replace(x, '^[^:]*:', '') for x in nodes], '>') AS nodes, array_to_string(rels, '>') AS rels FROM h WHERE rank <= 5"""
        ),
        "routine_dependencies": cat(" SELECT CASE WHEN starts_with(target, 'column:') THEN 'columns' ELSE 'tables' END AS bucket, regexp_replace(target, '^[^:]*:', '') AS node FROM edges, proc WHERE source = 'procedure:' || p AND relationship = 'Creates'"),
        "targeted_depth0": cat(NEAR.format(seed=TABLE_ID, depth=0)),
        "targeted_depth1": cat(NEAR.format(seed=TABLE_ID, depth=1)),
        "targeted_depth2": cat(NEAR.format(seed="(SELECT object_id FROM proc)", depth=2)),
        "type_display": cat(" SELECT table_name, column_name, type_display FROM typed"),
        "graph_json_lines": cat(_GRAPH_FACTS),
        "graph_graphml_lines": cat(_GRAPH_FACTS),
        "edge_ordinals": cat(" SELECT 'edge-' || (row_number() OVER (ORDER BY source, kind, pname, number, target, key) - 1) AS edge_uid, source, target, relationship, key::BIGINT AS key FROM edges"),
        "graph_styles": cat(
            """ SELECT id, CASE node_type WHEN 'Table' THEN '#2f6db5' WHEN 'Column' THEN '#8fb7a6' WHEN 'Procedure' THEN '#c2703d' ELSE '#8c5fb0' END AS color, CASE node_type WHEN 'Table' THEN 28 WHEN 'Column' THEN 12 ELSE 20 END::BIGINT AS size,
            CASE node_type WHEN 'Table' THEN 'box' WHEN 'Column' THEN 'dot' WHEN 'Procedure' THEN 'diamond' ELSE 'triangle' END AS shape, concat_ws(chr(10), node_type, qualified_name, type_display) AS tooltip FROM nodes"""
        ),
        "graph_markdown_tables": cat(
            """, cells AS (SELECT object_id, column_id, '| `' || name || '` | `' || type_display || '` | ' || CASE WHEN column_id % 2 = 1 THEN 'Yes' ELSE 'No' END || ' | ' || concat_ws(', ', CASE WHEN is_primary_key THEN 'PK' END,
                CASE WHEN is_foreign_key THEN 'FK' END, CASE WHEN is_referenced_key THEN 'Referenced key' END) || ' |' AS line FROM nodes WHERE node_type = 'Column'),
            listed AS (SELECT object_id, string_agg(line, chr(10) ORDER BY column_id) AS lines FROM cells GROUP BY object_id)
            SELECT qualified_name, concat_ws(chr(10), '| Column | Type | Nullable | Key information |', '|---|---|---:|---|', lines) AS body FROM nodes LEFT JOIN listed USING (object_id) WHERE node_type = 'Table'"""
        ),
        "graph_markdown_links": cat(" SELECT '- `' || pt || '` via `' || pc || '` → `' || rt || '` via `' || rc || '` (`' || name || '`)' AS line FROM fk"),
        "card_page": f"WITH {CARDS} SELECT left(card_id::VARCHAR, 8) AS card_id, project, title, status, priority, left(created_at, 19) AS created_at, left(updated_at, 16) AS updated_at FROM k WHERE status = 'In Progress'",
        "node_attributes": "SELECT 'customer:' || c_custkey AS id, length(c_name)::BIGINT AS size FROM customer WHERE contains('customer:' || c_custkey, '1') OR contains(c_name, '1')",
        "cards_list": f"WITH {CARDS} SELECT * FROM k",
        "cards_list_filtered": f"WITH {CARDS} SELECT * FROM k WHERE status = 'In Progress' AND priority = '1-URGENT'",
        "card_with_comments": f"WITH {CARDS} SELECT card_id, status, turn AS comment_id, role AS author, text AS comment FROM k LEFT JOIN conversations ON conv_id = card_id WHERE card_id = 0",
        "card_current_state": """
            WITH x AS (SELECT user_id::VARCHAR AS card_id, event_type AS status, CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END AS priority, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, ts, event_id FROM events)
            SELECT card_id, arg_max(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status, arg_max(priority, (ts, event_id)) FILTER (priority IS NOT NULL) AS priority,
                   arg_min(stamp, (ts, event_id)) AS created_at, CASE WHEN count(*) > 1 THEN arg_max(stamp, (ts, event_id)) END AS updated_at FROM x GROUP BY card_id""",
        "board_counts": f"""WITH {CARDS}, g AS (
            SELECT project, count(*) FILTER (bucket = 'Created') AS created, count(*) FILTER (bucket = 'In Progress') AS in_progress, count(*) FILTER (bucket = 'Complete') AS complete, count(*) FILTER (bucket = 'Other') AS other, max(nullif(updated_at, '')) AS last_activity FROM b GROUP BY project)
            SELECT *, created + in_progress + complete AS total, greatest(created, in_progress, complete, other) > 3 AS collapsed FROM g""",
        "board_top3": f"WITH {CARDS} SELECT * FROM (SELECT project, bucket, row_number() OVER (PARTITION BY project, bucket ORDER BY created_at DESC, card_id) AS place, card_id, created_at FROM b) WHERE place <= 3",
        "board_project_order": f"""WITH {CARDS}, p AS (SELECT DISTINCT c_mktsegment AS project FROM customer UNION SELECT 'ARCHIVE'),
            g AS (SELECT p.project, max(nullif(updated_at, '')) AS last_activity FROM p LEFT JOIN k USING (project) GROUP BY p.project)
            SELECT row_number() OVER (ORDER BY last_activity DESC NULLS LAST, project) AS place, project, last_activity FROM g""",
        "changed_fingerprint": """
            WITH x AS (SELECT event_id, user_id, sha256(coalesce(event_type, '') || '|' || coalesce(props, '')) AS fingerprint FROM events)
            SELECT event_id, user_id, fingerprint, coalesce(lag(fingerprint) OVER (PARTITION BY user_id ORDER BY event_id) <> fingerprint, false) AS changed FROM x""",
        "relevant_sources": f"""
            WITH x AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
            SELECT page_id, path FROM x WHERE NOT list_has_any(string_split(path, '/'), [{ignored}, 'graph-out', '.graphs']) AND lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1)) IN ({suffixes})
            AND NOT (starts_with(path, 'graph-out/') OR path = 'graph-out' OR starts_with(path, '.graphs/db/') OR path = '.graphs/db')""",
    }
