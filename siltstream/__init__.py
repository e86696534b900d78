"""Spark-first engine for web-corpus tables: URL algebra, state store, reports, policies and page processing."""

__version__ = "0.1.0"
