"""Readers: node-link JSON graphs, SQL Server catalogs, Spark schemas, cards and registries."""
