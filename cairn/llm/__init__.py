"""Operators of a training-data pipeline, written as Spark jobs.

Nothing else in the library imports this subpackage.
"""
