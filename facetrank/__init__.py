"""facetrank: a Spark-first engine for semantic-predicate search and training-data preparation."""

__version__ = "0.1.0"
