"""Whole pipelines as chains of operators."""
