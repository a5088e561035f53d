"""Operators for large training-corpus pipelines.

Nothing outside this subpackage imports it: it can be removed and the rest of
the engine still works.  Every operator takes and returns DataFrames.
"""
