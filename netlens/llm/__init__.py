"""Training-data operators.

Nothing outside this folder imports it. Each module holds one operator with its own
general interface; ``entry_queries`` has the thin ``opN_<name>`` queries over the test
tables and ``entry_sql`` their DuckDB twins.
"""
