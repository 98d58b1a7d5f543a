"""DataFrame-in / DataFrame-out operators (joins, aggregations, windows, state)."""
