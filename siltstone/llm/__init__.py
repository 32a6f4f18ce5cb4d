"""Operators a training-data pipeline needs, on top of plain Spark.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; :mod:`siltstone.llm.queries` applies each one to its
whole table.
"""
