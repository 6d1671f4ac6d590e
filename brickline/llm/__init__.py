"""Operators of a training-data pipeline over documents, pages and embeddings; each module is one operator.

Nothing else in the library imports this subpackage. ``queries.QUERIES`` and ``queries.ORACLES`` are what
``__spark_entry__.py`` adds when the subpackage is there.
"""
