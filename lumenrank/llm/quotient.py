"""Counting quotient filters over packed n-grams of word ids: compact, lossless, mergeable.

An n-gram is a number of three ids of ``bits`` bits each (0 for no word). A Feistel
permutation scatters these numbers over 2 * half bits and can be undone. The leading bits
of a permuted number say the shard it belongs to, the next ones are its quotient, all
others its remainder, which is kept in full: so a filter has no false positives, and its
n-grams can be read back.

A filter is a sorted run of distinct numbers with counts. Encoded, a quotient costs one
occupied bit per slot and one end-of-run bit per number, a remainder its bytes, and a
count one byte up to 254; larger counts follow in a list of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
ROUNDS = 4
_HEADER = np.dtype([("half", "u1"), ("shift", "u1"), ("q", "u1"), ("bytes", "u1"), ("n", "<u8"), ("shard", "<u8"),
                    ("large", "<u8"), ("packed", "<u8"), ("occupied", "<u8")])


def half_bits(bits: int) -> int:
    """Bits of each half of a packed n-gram."""
    if bits > 42:
        raise ValueError(f"word ids of {bits} bits; 42 is the most")
    return max(1, -(-3 * bits // 2))


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Three ids as the two halves of one number."""
    half = half_bits(bits)
    low = ((b << U(bits)) | c) & _mask(half)
    return (a << U(2 * bits - half)) | (b >> U(half - bits)), low


def unpack(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    half = half_bits(bits)
    b = ((low >> U(bits)) | (high << U(half - bits))) & _mask(bits)
    return high >> U(2 * bits - half), b, low & _mask(bits)


def _scatter(x: np.ndarray, turn: int, half: int) -> np.ndarray:
    x = (x + U(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return (x ^ (x >> U(31))) & _mask(half)


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for turn in range(ROUNDS):
        high, low = low, high ^ _scatter(low, turn, half)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for turn in reversed(range(ROUNDS)):
        high, low = low ^ _scatter(high, turn, half), high
    return high, low


class Filter:
    """Distinct permuted numbers, ascending, with counts."""

    def __init__(self, half: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.half, self.high, self.low, self.counts = half, high, low, counts

    @classmethod
    def of(cls, half: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> Filter:
        """Numbers in any order, with repeats; sorted runs are merged."""
        if 2 * half <= 64:
            order = np.argsort((high << U(half)) | low, kind="stable")
        else:
            order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.ones(len(high), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(first)
        if counts is None:
            counts = np.diff(np.append(at, len(high)))
        else:
            counts = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
        return cls(half, high[at], low[at], counts.astype(np.int64))

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        if len(filters) == 1:
            return filters[0]
        high, low, counts = (np.concatenate([getattr(f, c) for f in filters]) for c in ("high", "low", "counts"))
        return cls.of(filters[0].half, high, low, counts)

    def shards(self, bits: int):
        """(shard, filter) by the ``bits`` leading bits, where there are any."""
        shard = self.high >> U(self.half - bits)
        bounds = np.append(np.flatnonzero(np.diff(shard, prepend=shard[:1] + U(1))), len(shard))
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
            yield int(shard[lo]), Filter(self.half, self.high[lo:hi], self.low[lo:hi], self.counts[lo:hi])

    def encode(self, shard_bits: int) -> bytes:
        """The bytes of a filter whose numbers share their ``shard_bits`` leading bits."""
        n = len(self.high)
        q = min(max(0, n.bit_length() - 1), self.half - shard_bits)
        shift = self.half - shard_bits - q
        quotient = ((self.high >> U(shift)) & _mask(q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.append(quotient[1:] != quotient[:-1], [True][:n])
        rest = self.high & _mask(shift)
        width = -(-shift // 8), -(-self.half // 8)
        if shift + self.half <= 64:  # one number, else each half by itself
            rest, width = (rest << U(self.half)) | self.low, (-(-(shift + self.half) // 8), 0)
        planes = [x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :w] for x, w in zip((rest, self.low), width) if w]
        remainders = np.concatenate(planes, axis=1) if planes else np.zeros((n, 0), np.uint8)
        large = self.counts[self.counts > 254].astype("<i8")
        small = np.minimum(self.counts, 255).astype(np.uint8)
        bits = np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + small.tobytes() + large.tobytes()
        packed = pa.compress(bits, codec="zstd", asbytes=True)
        head = np.array([(self.half, shift, q, remainders.shape[1], n, self.high[0] >> U(self.half - shard_bits) if n and shard_bits else 0,
                          len(large), len(packed), len(bits))], _HEADER)
        return head.tobytes() + packed + remainders.tobytes()

    @classmethod
    def decode(cls, blob: bytes) -> Filter:
        head = np.frombuffer(blob, _HEADER, 1)[0]
        half, shift, q, n = (int(head[c]) for c in ("half", "shift", "q", "n"))
        at = _HEADER.itemsize
        bits = np.frombuffer(pa.decompress(blob[at:at + int(head["packed"])], decompressed_size=int(head["occupied"]),
                                           codec="zstd", asbytes=True), np.uint8)
        sizes = np.cumsum([-(-(1 << q) // 8), -(-n // 8), n])
        occupied, ends, small, large = np.split(bits, sizes)
        slots = np.flatnonzero(np.unpackbits(occupied, count=1 << q))
        end = np.unpackbits(ends, count=n).astype(np.int64)
        quotient = slots[np.cumsum(end) - end] if n else np.zeros(0, np.int64)
        counts = small.astype(np.int64)
        counts[counts == 255] = np.frombuffer(large.tobytes(), "<i8")
        wide = np.zeros((n, 16), np.uint8)
        remainders = np.frombuffer(blob, np.uint8, offset=at + int(head["packed"])).reshape(n, int(head["bytes"]))
        if shift + half <= 64:
            wide[:, :remainders.shape[1]] = remainders
            both = wide[:, :8].copy().view("<u8").ravel()
            rest, low = (both >> U(half)) if half < 64 else both * U(0), both & _mask(half)
        else:
            w = -(-shift // 8)
            wide[:, :w], wide[:, 8:8 + remainders.shape[1] - w] = remainders[:, :w], remainders[:, w:]
            rest, low = wide[:, :8].copy().view("<u8").ravel(), wide[:, 8:].copy().view("<u8").ravel()
        lead = (U(int(head["shard"])) << U(q)) | quotient.astype(U)
        return cls(half, (lead << U(shift)) | rest, low, counts)
