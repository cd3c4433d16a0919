"""Hybrid text retrieval, ranking evaluation and answer packaging as Spark DataFrame operators."""
