"""DataFrame -> DataFrame operators: joins, windows, aggregates, ML."""
