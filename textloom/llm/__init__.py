"""Operators for building language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names, returns a lazily composed DataFrame (a few run small jobs of
their own first, which their docstrings say) and defines what nulls, empty
texts, repeated rows and empty tables give.
"""
