"""Operators for preparing text and vector corpora at scale.

Self-contained: nothing outside this folder imports it.  Every operator takes
a DataFrame plus the names of its columns, reads only those columns, and
returns the key with columns of its own, so further input columns (even ones
whose names clash with outputs) never matter.
"""
