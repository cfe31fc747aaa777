"""DataFrame operators: filters, exact ranks, splits, tokens, scorer, purify, vectors, metrics."""
