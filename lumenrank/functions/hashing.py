"""Hashing encoder: a deterministic stand-in for a learned text encoder.

Per token: bucket = first 8 hex digits of md5(token) mod dim; sign = +1 when
the 9th hex digit is even, else -1. A text's vector is the signed bucket
count, L2-normalised. The md5 work stays in the JVM; only the final
scatter-add into a dense vector runs in numpy, one Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrank import config as C

STEP_ROWS, STEP_TOKENS = 1024, 1 << 18  # rows and tokens that become vectors at once


def signed_codes(toks: Column, dim: int = C.HASH_DIM) -> Column:
    """array<int> of ``bucket * 2 + odd`` per token, computed in the JVM.

    ``x`` = the first 9 hex digits of md5 as a number: ``x >> 4`` is the first 8
    digits (the bucket before ``mod dim``), ``x & 1`` is the 9th digit's parity.
    """
    # in two steps: an expression that uses the digest twice would compute it twice
    digits = F.transform(toks, lambda t: F.conv(F.substring(F.md5(t), 1, 9), 16, 10).cast("bigint"))
    return F.transform(digits, lambda x: (F.pmod(F.shiftright(x, 4), F.lit(dim)) * 2 + F.pmod(x, F.lit(2))).cast("int"))


def codes_matrix(values: np.ndarray, lengths: np.ndarray, dim: int) -> np.ndarray:
    """Dense (rows x dim) signed counts, L2-normalised per row (zero rows stay zero)."""
    n = len(lengths)
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    flat = rows * dim + (values >> 1)
    mat = np.bincount(flat, weights=1.0 - 2.0 * (values & 1), minlength=n * dim).astype(np.float64).reshape(n, dim)
    norms = np.sqrt(np.einsum("ij,ij->i", mat, mat))
    nz = norms > 0
    mat[nz] /= norms[nz, None]
    return mat


def arrow_encoder(dim: int, codes_col: str, out_col: str):
    """``mapInArrow`` function: replace the codes list column by the unit vector column.

    Works on the Arrow buffers directly (no per-row Python objects), and on a few rows of a
    batch at a time: what it holds beside the batch is bounded by ``STEP_ROWS`` vectors and
    ``STEP_TOKENS`` tokens (or one text's), however many rows a batch has.
    """

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(codes_col)
            lengths = b.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in steps(lengths):
                some = b.slice(lo, hi - lo)
                values = some.column(at).flatten().to_numpy(zero_copy_only=False)
                mat = codes_matrix(values, lengths[lo:hi], dim)
                offsets = pa.array(np.arange(0, (hi - lo + 1) * dim, dim, dtype=np.int32))
                vec = pa.ListArray.from_arrays(offsets, pa.array(mat.ravel(), type=pa.float64()))
                keep = [i for i, f in enumerate(some.schema) if f.name != codes_col]
                cols = [some.column(i) for i in keep] + [vec]
                names = [some.schema.field(i).name for i in keep] + [out_col]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def steps(lengths: np.ndarray):
    """Row ranges of at most ``STEP_ROWS`` rows and ``STEP_TOKENS`` tokens, one row at least."""
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        before = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(ends, before + STEP_TOKENS, side="right"))
        hi = max(lo + 1, min(hi, lo + STEP_ROWS))
        yield lo, hi
        lo = hi
