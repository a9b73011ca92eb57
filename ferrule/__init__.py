"""Spark jobs for ranking, evaluating and preparing text collections at scale."""
