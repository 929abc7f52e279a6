"""Composed jobs: the retrieval-and-evaluation job and the registered queries."""
