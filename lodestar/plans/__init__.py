"""Whole plans: configuration, stages, building and searching an index, evaluation runs, the tool surface."""
