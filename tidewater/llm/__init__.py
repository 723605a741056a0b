"""Operators of a training-data pipeline (sharding, near-dedup, tokenising, filters ...).

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; :mod:`.queries` registers one query per
operator, :mod:`.oracles` the DuckDB SQL where SQL can express it.
"""
