"""Graph, catalog, card and freshness operators."""
