"""Training-data operators for large text corpora.

Nothing outside this subpackage imports it.  Every operator is a function of
DataFrames; the thin contract queries live in :mod:`cadenza.llm.queries`.
"""
