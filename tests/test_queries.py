"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from skeinwork.plans import oracles
from skeinwork.plans import queries as plans

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("search_nodes_typed_limit", "neighbors_both", "graph_counts", "get_symbol_edges", "impact_analysis", "callers_direct", "catalog_nodes", "catalog_edges", "table_fk_pairs", "type_display", "cards_list_filtered", "card_current_state", "board_counts", "board_top3", "board_project_order", "changed_fingerprint", "relevant_sources", "graph_json_lines", "graph_graphml_lines", "graph_styles", "graph_markdown_tables", "graph_markdown_links", "card_page", "node_attributes")
NAMES += tuple(f"catalog_extract_{name}{ids}" for name in plans.EXTRACTED for ids in ("", "_of_ids"))


def plain(df):
    return sorted(str(tuple(None if pd.isna(x) else x for x in row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF_DIR):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF_DIR}/{file}'")
    assert plain(plans.queries()[name](spark, SF_DIR).toPandas()) == plain(db.execute(oracles.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(oracles.oracle_sql()) <= set(plans.queries())
