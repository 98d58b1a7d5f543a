"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries when it can be imported.
"""
