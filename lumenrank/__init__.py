"""lumenrank: offline passage retrieval and its evaluation on Spark DataFrames.

Every operator takes and returns DataFrames. Ranked lists use the run schema
``(qid long, rank int, doc_id long, score double)``.
"""

from __future__ import annotations

import sys

try:  # ship the package by value to Python workers that cannot import it
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["config"]
