"""All registered queries by name."""

from millrace.queries import graphs, learning_queries, lookups, more_kernels, numerics, sequences, statistics, testing, texts

_REGISTRIES = (sequences.R, statistics.R, testing.R, texts.R, lookups.R, graphs.R, numerics.R, learning_queries.R, more_kernels.R)
QUERIES, SQL = {}, {}
for _r in _REGISTRIES:
    if twice := QUERIES.keys() & _r.queries.keys():
        raise ValueError(f"registered twice: {sorted(twice)}")
    QUERIES.update(_r.queries)
    SQL.update(_r.sql)
