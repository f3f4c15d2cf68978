"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``strandlog.llm.registry`` lists
the queries that the repository's entry point adds when the subpackage is
there.
"""
