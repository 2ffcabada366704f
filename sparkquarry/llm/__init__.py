"""Training-data operators for very large text corpora.

Nothing outside this subpackage imports it.  Every operator has its own module
with a general interface; ``queries`` holds the thin registered queries.
"""
