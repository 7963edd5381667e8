"""Document analytics on Spark: nodes, chunks, search, answers, ledgers, metrics and keyed streams."""
