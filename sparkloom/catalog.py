"""All queries of the library by name, and SQL for those that SQL can express."""

from .plans import graph_queries, memory_queries, search_queries, store_queries, text_queries

QUERIES = memory_queries.QUERIES | graph_queries.QUERIES | text_queries.QUERIES | store_queries.QUERIES | search_queries.QUERIES
SQL = memory_queries.SQL | graph_queries.SQL | text_queries.SQL | store_queries.SQL | search_queries.SQL
