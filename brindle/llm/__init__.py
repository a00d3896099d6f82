"""Training-data operators: scoring, deduplication, search, tokenising, packing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns a DataFrame; the ``opN_<name>`` queries are listed in
:mod:`brindle.llm.registry`.
"""
