"""DataFrame -> DataFrame operators: joins, aggregates, search, graph, history."""
