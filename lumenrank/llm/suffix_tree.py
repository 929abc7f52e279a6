"""LM scoring with a probabilistic suffix tree over words (operator 1).

Symbols are tokens: words ([^\\x20\\x09-\\x0D]+ after lower-casing A-Z) and one end per
text. The root state is the smoothed token distribution of the training part,
(c + 0.5) / (N + 0.5 (V + 1)). A state is a context of up to ``DEPTH`` preceding tokens.

1. Chunks. One pass dictionary-encodes the texts: per chunk of documents a word list, and
   per document the positions in it. The chunk table is written once.
2. Token counts. Chunks send their distinct words with counts, dealt by a hash of the
   word; owners add them up, number the words, and answer each chunk with the totals and
   numbers of its words.
3. Contexts, one depth after the other up to ``DEPTH``. A chunk asks for its distinct
   (context, next) pairs with their training counts and the next token's probability so
   far, dealt by a hash of the context; owners add up, test, and answer each chunk. The
   tree is never in one place: an owner holds its contexts, a chunk the answers it needs.
   Questions are sorted by context and packed as gaps, answers as counts, probabilities with
   repeated ones once; an owner has a range of the hashes. A chunk's text and state stay where
   they are, in tables bucketed by chunk. What a depth no longer needs is deleted once the
   next table is written.
4. Smoothing. A context's distribution discounts each pair's count by one and leaves the
   freed mass to its suffix's distribution. A pair seen once keeps nothing, so only pairs
   seen ``least`` = 2 times are told apart; the others of a context are one sum. That
   changes no probability and no test, at any size of the corpus.
5. Divergence test. A context becomes a state when that distribution diverges from its
   suffix's: the log-likelihood it gains on the context's own training tokens exceeds
   ``MIN_GAIN`` nats per token. The discount makes pairs seen once count against it.
6. Scoring. Per token the longest suffix state of its history gives the probability. A
   token whose context was seen once is done and is not asked for at greater depths.

Contexts are named by 64-bit hashes, sums of their words' mixed numbers. A hot word, pair or
document group is one row per chunk; a hot context's distinct pairs per chunk meet at one
owner. Nothing but the sums of a few counts reaches the driver.

Edge cases: a null text counts as empty, its only token is the end; a null id has the
checksum of the empty string; repeated rows count and are scored each; a text of any length
is one document of one chunk; without training rows there are no states and c = N = V = 0;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, forget, kept_by, written

#: Documents with crc32(id as text) mod FOLDS = HELD_OUT are not learned from.
FOLDS, HELD_OUT = 5, 1
#: Tokens of the longest contexts of the query; occurrences from which a pair is told apart.
DEPTH, LEAST = 5, 2
MIN_GAIN = 0.01
#: Text bytes per chunk; distinct words, and tokens, per owner of an exchange.
CHUNK_BYTES = 6 * 1024 * 1024
WORDS_PER_OWNER, TOKENS_PER_OWNER = 300_000, 1_000_000
#: Owners are asked in so many passes, so that only a part of the questions is shuffled at a time.
PASSES = 4

#: Names of a text's end, and of a context's pairs that are not told apart; words from 2 on.
_END, _REST, _FIRST = np.uint64(1), np.uint64(0), np.uint64(2)
#: A context's hash is the sum of its mixed names, the j-th before the token times this to the power of j.
_TURN = 0x9E3779B185EBCA87
#: Bytes of the longest word that is hashed together with others.
_LONG = 64


# ------------------------------------------------------------------ chunks
def _chunks(batches):
    part, no = TaskContext.get().partitionId(), 0
    for b in batches:
        text = pc.fill_null(b.column(2), "")
        size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            held = b.column(1).slice(lo, hi - lo)
            split = pc.ascii_split_whitespace(pc.ascii_lower(text.slice(lo, hi - lo)))
            flat, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
            keep = pc.not_equal(flat, "")  # white space at either end leaves an empty piece
            doc = np.repeat(np.arange(hi - lo), lengths)[keep.to_numpy(zero_copy_only=False)]
            coded = (flat if len(doc) == len(flat) else flat.filter(keep)).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            train = ~held.to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(codes, weights=train[doc], minlength=len(coded.dictionary)).astype(np.int64)
            lengths = np.bincount(doc, minlength=hi - lo)
            codes = np.insert(codes, np.cumsum(lengths), np.int32(len(counts)))  # an end's number follows the words'
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(["text", "vocab"], pa.string()), "chunk": pa.array([(part << 32) | no] * 2, pa.int64()),
                "ids": pa.concat_arrays([_one(b.column(0).slice(lo, hi - lo)), pa.nulls(1, pa.list_(b.column(0).type))]),
                "held": pa.concat_arrays([_one(held), pa.nulls(1, pa.list_(held.type))]),
                "lengths": pa.concat_arrays([pa.array([_pack(lengths.astype(np.int64))], pa.binary()), none]),
                "codes": pa.concat_arrays([pa.array([_pack(codes)], pa.binary()), none]),
                "vocab": pa.array([None, _pack_words(coded.dictionary)], pa.binary()),
                "counts": pa.array([None, _pack(counts)], pa.binary()), "words": pa.array([len(counts), None], pa.int64()),
                "tokens": pa.array([int(lengths[train].sum() + train.sum()), None], pa.int64()),
                "texts": pa.array([int(train.sum()), None], pa.int64())})
            no += 1


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Like ``_pack`` with the numbers' first bytes together, then their second ones and so on,
    as many as the largest has."""
    x = np.ascontiguousarray(x)
    width = (int(x.view(f"u{x.itemsize}").max()).bit_length() + 7) // 8 if len(x) else 0
    turned = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(turned, codec="zstd", asbytes=True)


def _unplanes(blob: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    out = np.zeros(n, kind)
    if width:
        turned = np.frombuffer(pa.decompress(blob[9:], decompressed_size=n * width, codec="zstd"), np.uint8)
        out.view(np.uint8).reshape(n, out.itemsize)[:, :width] = turned.reshape(width, n).T
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct values, and per value its distinct one."""
    coded = pa.array(x).dictionary_encode()
    of, size = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
    first = np.empty(size, np.int32)
    first[of[::-1]] = np.arange(len(x) - 1, -1, -1, dtype=np.int32)
    return first, of


def _order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in order (of equal ones the earlier first), and the hashes in order. A
    place takes the low bits of its hash, as numbers sort many times faster than an index of
    them; the few hashes that differ in their low bits alone are put in order afterwards."""
    low = np.uint64((1 << len(x).bit_length()) - 1)
    packed = x & ~low
    packed |= np.arange(len(x), dtype=np.uint64)
    packed.sort()
    packed &= low
    order = packed.view(np.int64)
    x = x.take(order)
    wrong = np.flatnonzero(x[1:] < x[:-1])
    if len(wrong):
        group = np.zeros(len(x), np.int32)
        group[1:] = np.cumsum((x[1:] ^ x[:-1]) > low)
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[wrong]] = True
        at = np.flatnonzero(mixed[group])
        again = np.argsort(x[at], kind="stable")
        order[at], x[at] = order[at][again], x[at][again]
    return order, x


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of hashes in order, for each of these the number of its distinct hash, and the
    distinct ones' first places."""
    order, x = _order(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return order, np.cumsum(new) - 1, order.compress(new)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_distinct`` for many different hashes; the distinct ones are in order."""
    order, number, first = _groups(x)
    of = np.empty(len(x), np.int64)
    of[order] = number
    return first, of


def _take(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``x[at]``, which takes twice as long with places of 32 bits."""
    return x.take(at.astype(np.int64))


def _unpack(blob: bytes, kind) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=n, codec="zstd"), kind) if n else np.zeros(0, kind)


def _pack_words(words: pa.Array) -> bytes:
    """Words have no white space, so one text holds them."""
    if not len(words):
        return b""
    text = pc.binary_join(_one(words.cast(pa.string())), " ")[0].as_buffer()
    return text.size.to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _unpack_words(blob: bytes) -> pa.Array:
    if not blob:
        return pa.array([], pa.large_string())
    text = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd")
    one = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, text.size], np.int64)), text)
    return pc.split_pattern(one, " ").flatten()


def _told(x: np.ndarray) -> bytes:
    """Like ``_planes``, with repeated values once: a bit for each number that is new, the new ones, places of the others."""
    first, of = _distinct(np.ascontiguousarray(x).view(f"u{x.itemsize}"))
    new = np.zeros(len(x), bool)
    new[first] = True
    parts = [_pack(np.packbits(new)), _planes(x[first]), _planes(of[~new])]
    return b"".join([len(x).to_bytes(8, "little"), *(len(p).to_bytes(8, "little") for p in parts), *parts])


def _untold(blob: bytes, kind) -> np.ndarray:
    n, *sizes = np.frombuffer(blob, "<i8", 4).tolist()
    ends = np.cumsum([32, *sizes]).tolist()
    bits, values, others = (blob[lo:hi] for lo, hi in zip(ends, ends[1:]))
    new, values, out = np.unpackbits(_unpack(bits, np.uint8), count=n).astype(bool), _unplanes(values, kind), np.empty(n, kind)
    out[new] = values
    out[~new] = values[_unplanes(others, np.int32)]
    return out


def _word_hashes(vocab: pa.Array) -> np.ndarray:
    """Eight bytes of all words at a time; words longer than ``_LONG`` bytes one by one."""
    vocab = vocab.cast(pa.large_binary())
    offsets = np.frombuffer(vocab.buffers()[1], np.int64, len(vocab) + 1, vocab.offset * 8)
    size, out = np.diff(offsets), np.zeros(len(vocab), np.uint64)
    short = np.flatnonzero(size <= _LONG)
    text = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    text[:-8] = np.frombuffer(vocab.buffers()[2], np.uint8, len(text) - 8, offsets[0])
    eights = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    begin, left = offsets[short] - offsets[0], size[short]
    out[short] = left
    while len(short):
        shift = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        out[short] = _mix(out[short], (eights[begin] << shift) >> shift)
        more = left > 8
        short, begin, left = short[more], begin[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(vocab[i].as_py())
    return out


# ------------------------------------------------------- token counts: ask and answer
def _ask_words(owners: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                vocab = _unpack_words(b.column(1)[i].as_py())
                if not len(vocab):
                    continue
                owner = (_word_hashes(vocab) % np.uint64(owners)).astype(np.int64)
                order = np.argsort(owner, kind="stable").astype(np.int32)
                bounds = np.searchsorted(owner[order], np.arange(owners + 1))
                counts = _unpack(b.column(2)[i].as_py(), np.int64)[order]
                sent = np.flatnonzero(np.diff(bounds))
                vocab = vocab.take(pa.array(order))
                parts = [slice(bounds[o], bounds[o + 1]) for o in sent]
                yield pa.RecordBatch.from_pydict({
                    "owner": pa.array(sent, pa.int32()), "chunk": pa.array([b.column(0)[i].as_py()] * len(sent), pa.int64()),
                    "words": pa.array([_pack_words(vocab[p]) for p in parts], pa.binary()),
                    "counts": pa.array([_pack(counts[p]) for p in parts], pa.binary()),
                    "places": pa.array([_pack(order[p]) for p in parts], pa.binary())})

    return run


def _answer_words(owners: int):
    def run(asked: pa.Table) -> pa.Table:
        lists = [_unpack_words(x) for x in asked["words"].to_pylist()]
        ends = np.cumsum([len(x) for x in lists])
        coded = pa.concat_arrays(lists).dictionary_encode()
        del lists
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.concatenate([_unpack(x, np.int64) for x in asked["counts"].to_pylist()])
        totals = np.bincount(codes, weights=counts, minlength=len(coded.dictionary)).astype(np.int64)
        names = np.arange(len(totals), dtype=np.uint64) * np.uint64(owners) + np.uint64(asked["owner"][0].as_py()) + _FIRST
        parts = [codes[e - n:e] for e, n in zip(ends, np.diff(ends, prepend=0))]
        rows = asked.num_rows
        return pa.table({
            "chunk": pa.array([*asked["chunk"].to_pylist(), None], pa.int64()),
            "places": pa.array([*asked["places"].to_pylist(), None], pa.binary()),
            "totals": pa.array([*(_planes(totals[p]) for p in parts), None], pa.binary()),
            "names": pa.array([*(_planes(names[p]) for p in parts), None], pa.binary()),
            "distinct": pa.array([None] * rows + [int((totals > 0).sum())], pa.int64())})

    return run


# ------------------------------------------------------- contexts: ask and answer
def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B185EBCA87)
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


class _Asked:
    """The distinct (context, next) pairs of depth ``d`` in a chunk, by context. An owner has a
    range of contexts, so they are by owner too.

    ``often``: per token whether its pair of the depth above is told apart. A context is
    looked at where it is such a pair itself, its last token being the one before."""

    def __init__(self, token: np.ndarray, mixed: np.ndarray, starts: np.ndarray, often: np.ndarray, d: int):
        at = np.flatnonzero(_next(often, starts))
        context = np.zeros(len(at), np.uint64)
        for j in range(1, d + 1):
            context += _take(mixed, token.take(at - j)) * np.uint64(pow(_TURN, j, 1 << 64))
        # No name's mixture is _REST, as the mixture can be undone.
        pair = np.where(often.take(at), _take(mixed, token.take(at)), _REST)
        self.at = at.astype(np.int32)
        del at
        pair += context
        order, number, first = _groups(pair)
        del pair
        by, self.context = _order(context.take(first))
        del context
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.slot, self.first = np.empty(len(order), np.int32), first.take(by)
        self.slot[order] = place.take(number)

    def owner(self, owners: int) -> np.ndarray:
        return (((self.context >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int32)


def _next(often: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tokens after one that is ``often``, in the same text."""
    out = np.concatenate([[False], often[:-1]])[:len(often)]
    out[starts] = False
    return out


def _runs(context: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    first = np.ones(len(context), bool)
    first[1:] = context[1:] != context[:-1]
    return np.flatnonzero(first)


def _answer_pairs(least: int):
    """An owner's sums: per pair its occurrences where it is told apart, else 0; per context
    its occurrences where it is a state, else 0, and the mass that the discount frees."""

    def run(asked: pa.Table) -> pa.Table:
        gaps = [_unplanes(x, np.uint64) for x in asked["contexts"].to_pylist()]
        runs = [_unplanes(x, np.uint32).astype(np.int64) for x in asked["runs"].to_pylist()]
        context = np.concatenate([np.repeat(np.cumsum(g, dtype=np.uint64), r) for g, r in zip(gaps, runs)])
        key = np.concatenate([_unplanes(x, np.uint64) for x in asked["key"].to_pylist()])
        count = np.concatenate([_unplanes(x, np.int32) for x in asked["counts"].to_pylist()])
        first, pair = _numbered(_mix(context, key))
        seen = np.bincount(pair, weights=count, minlength=len(first))
        below = np.concatenate([_untold(x, np.float32) for x in asked["below"].to_pylist()])[first].astype(np.float64)
        kept = (seen >= least) & (key[first] != _REST)
        where, of = _numbered(context.take(first))
        size = len(where)
        n = np.bincount(of, weights=seen, minlength=size)
        freed = n - np.bincount(of, weights=np.where(kept, seen - 1, 0), minlength=size)
        rest = n - np.bincount(of, weights=np.where(kept, seen, 0), minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = freed / n
            own = (seen - 1) / n[of]
            gain = np.bincount(of, weights=np.where(kept, seen * np.log((own + factor[of] * below) / below), 0.0), minlength=size)
            gain = gain + np.where(rest > 0, rest * np.log(factor), 0.0)
        state = (np.bincount(of, weights=kept, minlength=size) > 0) & (gain > MIN_GAIN * n)
        told, total, free = (np.where(x, y, 0).astype(np.int64) for x, y in ((kept, seen), (state, n), (state, freed)))
        seen_at = told[pair]
        ends = np.cumsum([0, *(int(r.sum()) for r in runs)])
        # A run's pairs share their context, so its first pair says which one it is.
        heads = [of[pair[lo + np.cumsum(r) - r]] for lo, r in zip(ends, runs)]
        return pa.table({
            "chunk": asked["chunk"], "owner": asked["owner"],
            "seen": pa.array([_planes(seen_at[lo:hi]) for lo, hi in zip(ends, ends[1:])], pa.binary()),
            "n": pa.array([_planes(total[h]) for h in heads], pa.binary()),
            "freed": pa.array([_planes(free[h]) for h in heads], pa.binary())})

    return run


#: A chunk's tables: its words' numbers and totals once, its state and its questions anew at each depth.
_WORDS = ("names", "totals")
_STATE = {"p": (_untold, _told, np.float64), "reached": (_unpack, _pack, np.uint8), "score": (_unpack, _pack, np.float64),
          "base": (_unpack, _pack, np.float64), "known": (_unpack, _pack, np.int64)}
_ASK = ("contexts", "runs", "key", "counts", "below")


_ROUND = "kind string, owner int, chunk long, " + ", ".join(f"{c} binary" for c in (*_WORDS, *_STATE, *_ASK))


def _step(d: int, depth: int, least: int, n: int, v: int, texts: int, owners: int):
    """Take in a chunk's answers of depth ``d`` (0: its words' totals). Before the last depth:
    the chunk's state and its questions of the next depth (after 0, also its words); then: scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [one(left.slice(i, 1), right) for i in range(left.num_rows)]
        return pa.concat_tables(out)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths = _unpack(left["lengths"][0].as_py(), np.int64)
        held = left["held"][0].values
        m = len(lengths)
        starts = np.cumsum(lengths + 1) - 1 - lengths
        size = int(lengths.sum() + m)
        vocab = left["words"][0].as_py()
        name_of, count_of = np.full(vocab + 1, _END, np.uint64), np.full(vocab + 1, texts, np.int64)  # the end comes last
        if d == 0:
            for places, totals, given in zip(*(right[c].to_pylist() for c in ("places", "totals", "names"))):
                at = _unpack(places, np.int32)
                count_of[at], name_of[at] = _unplanes(totals, np.int64), _unplanes(given, np.uint64)
        else:
            name_of[:-1] = _unplanes(left["names"][0].as_py(), np.uint64)
            if d == 1:  # of the first depth, the words' totals say it all
                count_of[:-1] = _unplanes(left["totals"][0].as_py(), np.int64)
        mixed, p_of = _mix(np.zeros(vocab + 1, np.uint64), name_of), (count_of + 0.5) / (n + 0.5 * (v + 1))
        token = _unpack(left["codes"][0].as_py(), np.int32)
        doc = np.repeat(np.arange(m, dtype=np.int32), lengths + 1)

        if d == 0:
            known = np.bincount(doc, weights=_take(count_of > 0, token), minlength=m).astype(np.int64)
            base = np.bincount(doc, weights=_take(np.log10(p_of), token), minlength=m)
            score, often, at = np.zeros(m), _take(count_of >= least, token), np.arange(size, dtype=np.int32)
            p = _take(p_of, token)
        else:
            p, bits, score, base, known = (take(left[c][0].as_py(), kind) for c, (take, _, kind) in _STATE.items())
            asked = _Asked(token, mixed, starts, np.unpackbits(bits, count=size).astype(bool), d)
            answers = right.sort_by("owner")
            at, often = asked.at, np.zeros(size, bool)
            if d == 1:
                p = _take(p_of, _take(token, at))
            if len(at):
                seen, total, freed = (np.concatenate([_unplanes(x, np.int64) for x in answers[c].to_pylist()])
                                      for c in ("seen", "n", "freed"))
                heads = _runs(asked.context)  # owners differ in their contexts, so no run goes over two
                long = np.diff(np.append(heads, len(asked.context)))
                state, kept = total > 0, seen > 0
                total = np.maximum(total, 1)
                factor = np.repeat(np.where(state, freed / total, 1.0), long)
                own = np.where(np.repeat(state, long) & kept, (seen - 1) / np.repeat(total, long), 0.0)
                del seen, total, freed, state, heads, long
                slot = asked.slot.astype(np.int64)
                p = factor.take(slot) * p
                p += own.take(slot)
                often[at] = kept.take(slot)
                del factor, own, kept, slot
            del asked  # its arrays go before the next depth's are made

        more = _next(often, starts)[at] if d < depth else np.zeros(len(at), bool)
        score = score + np.bincount(doc[at.compress(~more)], weights=np.log10(p.compress(~more)), minlength=m)
        if d == depth:
            return pa.table({
                "id": left["ids"][0].values, "held_out": held, "n_tokens": pa.array(lengths + 1, pa.int64()),
                "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n] * m, pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})
        p = p.compress(more)
        del at, more
        asked = _Asked(token, mixed, starts, often, d + 1)
        train = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), lengths + 1)[asked.at]
        counts = np.bincount(asked.slot, weights=train, minlength=len(asked.first)).astype(np.int32)
        at = _take(asked.at, asked.first)
        key = np.where(often[at], _take(name_of, token[at]), _REST)
        below = np.where(key != _REST, p.take(asked.first), 0.0).astype(np.float32)
        owner = asked.owner(owners)
        bounds = np.searchsorted(owner, np.arange(owners + 1))
        rows: list[dict] = []
        for o in np.flatnonzero(np.diff(bounds)).tolist():
            q = slice(bounds[o], bounds[o + 1])
            context, heads = asked.context[q], _runs(asked.context[q])
            rows.append({
                "kind": f"ask-{o % PASSES}", "owner": o, "contexts": _planes(np.diff(context[heads], prepend=np.uint64(0))),
                "runs": _planes(np.diff(np.append(heads, len(context))).astype(np.uint32)), "key": _planes(key[q]),
                "counts": _planes(counts[q]), "below": _told(below[q])})
        left_over = p if d else p[:0]
        rows.append({"kind": "state"} | {c: put(x) for (c, (_, put, _)), x in zip(_STATE.items(), (left_over, np.packbits(often), score, base, known))})
        if d == 0:
            rows.append({"kind": "words", "names": _planes(name_of[:-1]), "totals": _planes(count_of[:-1])})
        return pa.table({
            "kind": pa.array([r["kind"] for r in rows], pa.string()), "owner": pa.array([r.get("owner") for r in rows], pa.int32()),
            "chunk": pa.array([left["chunk"][0].as_py()] * len(rows), pa.int64()),
            **{c: pa.array([r.get(c) for r in rows], pa.binary()) for c in (*_WORDS, *_STATE, *_ASK)}})

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
          held_out: int = HELD_OUT, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """Per row: ``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)``;
    scores are log10 probabilities. ``least``: occurrences from which a pair is told apart."""
    id_type = df.schema[id_col].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    chunks = kept_by(df.select(F.col(id_col).alias("id"), (fold == held_out).alias("held"), F.col(text_col).alias("text"))
                     .mapInArrow(_chunks, f"kind string, chunk long, ids array<{id_type}>, held array<boolean>, lengths binary, "
                                 "codes binary, vocab binary, counts binary, words long, tokens long, texts long"),
                     "chunk", "chunks", "kind")
    text, vocab = chunks.filter("kind = 'text'"), chunks.filter("kind = 'vocab'")
    size = text.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    n, texts = size["tokens"] or 0, size["texts"] or 0

    word_owners = (size["words"] or 0) // WORDS_PER_OWNER + 1
    asked = vocab.select("chunk", "vocab", "counts").mapInArrow(
        _ask_words(word_owners), "owner int, chunk long, words binary, counts binary, places binary")
    totals = written(asked.groupBy("owner").applyInArrow(
        _answer_words(word_owners), "chunk long, places binary, totals binary, names binary, distinct long"), "totals", free=True)
    forget(chunks, folder="kind=vocab")
    v = (totals.agg(F.sum("distinct")).first()[0] or 0) + (texts > 0)
    owners = n // TOKENS_PER_OWNER + 1

    text = text.select("chunk", "ids", "held", "lengths", "codes", "words")
    left, old = text, [totals]
    right = totals.filter("chunk IS NOT NULL").select("chunk", "places", "totals", "names")
    for d in range(depth):
        step = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(
            _step(d, depth, least, n, v, texts, owners), _ROUND)
        step = kept_by(step, "chunk", f"contexts-{d + 1}", "kind")
        forget(*old)
        told = []
        for part in range(min(PASSES, owners)):
            sent = step.filter(f"kind = 'ask-{part}'").select("owner", "chunk", *_ASK)
            told.append(written(sent.groupBy("owner").applyInArrow(
                _answer_pairs(least), "chunk long, owner int, seen binary, n binary, freed binary"), f"answers-{d + 1}", free=True))
            forget(step, folder=f"kind=ask-{part}")
        right = reduce(DataFrame.unionByName, told)
        if d == 0:  # the words stay with the first table
            text = text.join(step.filter("kind = 'words'").select("chunk", *_WORDS), "chunk")
        left = text.join(step.filter("kind = 'state'").select("chunk", *_STATE), "chunk")
        old = [*told, (step, "kind=state") if d == 0 else step]
    out = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(
        _step(depth, depth, least, n, v, texts, owners), f"id {id_type}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op1(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents``."""
    return score(documents(spark, sf_dir))
