"""DataFrame operators: graph, root cause, features, evaluation, models."""
