"""All queries of the library and the SQL of those that have one."""

from . import corpus, entries, flows, landed, more, rows, series

QUERIES = series.QUERIES | rows.QUERIES | more.QUERIES | entries.QUERIES | corpus.QUERIES | flows.QUERIES | landed.QUERIES
SQL = series.SQL | rows.SQL | more.SQL | entries.SQL | corpus.SQL | flows.SQL | landed.SQL
