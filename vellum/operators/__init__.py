"""DataFrame operators: index build, search, batch search, merge, evaluation."""
