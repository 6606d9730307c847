"""Operators of a large-scale training-data pipeline.

Ten operators, each in its own module; ``queries`` registers one query per
operator and ``oracles`` holds the SQL that DuckDB can run beside them.
Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
