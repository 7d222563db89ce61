"""Training-data operators: tokenising, quality, archives, packing, near duplicates, URL filtering.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names and returns DataFrames; ``queries.py`` binds them to the test tables.
"""
