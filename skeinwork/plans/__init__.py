"""The queries over the star tables: graphs, catalogs and cards derived from them, and the SQL that checks each."""
