"""The analyses as registered plans (catalog), their fixed values, the dashboard (W34),
the star-schema load, the DuckDB oracles and the side-by-side checker."""
