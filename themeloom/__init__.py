"""Spark-first engine for discovering, describing and tracking themes in text collections."""

__version__ = "0.1.0"
