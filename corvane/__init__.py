"""Corvane: code-intelligence and retrieval analytics as Spark DataFrames.

Sub-packages
------------
``functions``  column expressions (text, paths, refs, ids) that stay in the JVM
``operators``  DataFrame -> DataFrame operators (aggregates, retrieval, graph, ...)
``sources``    scans and sinks
``streaming``  Structured Streaming variants of the incremental operators
``plans``      the named queries and the SQL they are checked against
``llm``        operators for training-data pipelines (optional, removable)
"""

__version__ = "0.1.0"
