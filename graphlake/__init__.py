"""Analytics over source-code knowledge graphs, as Spark plans."""
