"""All queries of the core library by name, and DuckDB SQL for the same results."""

from __future__ import annotations

from lexigrid.plans import io_queries, table_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **table_queries.QUERIES, **io_queries.QUERIES}
SQL: dict = {**text_queries.SQL, **table_queries.SQL, **io_queries.SQL}
