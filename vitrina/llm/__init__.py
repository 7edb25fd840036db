"""Operators of a training-data pipeline: one module each, all on Spark DataFrames.

Nothing else in the package imports this subpackage.  ``queries.py`` has the registered
``opN_<name>`` queries, ``common.py`` what the operators share.
"""
