"""Operator 12, periodic runs of words by block convolution with an exact integer number-theoretic transform.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of length
at least ``max(least, 3 q)``.  Words become small integers, equal ones the same.

* *Blocks.*  At each dyadic scale s the document is cut at multiples of s into blocks.  A run whose period lies
  in [s, 2 s) holds a whole block in its first 2 s - 1 words and that block again q words later (for s < 8, where a
  run has ``least`` words, blocks of 8 do).  Blocks longer than ``BLOCK`` are represented by their first ``BLOCK`` words.
* *Convolution.*  sum (x[k] - y[d + k]) ** 2 over a block x and the window y behind it, for all distances d of the scale at
  once, is a sum of squares less twice a correlation, taken by a transform modulo a prime; further primes follow for blocks with a zero
  until their product exceeds every possible value, so that a zero under all of them is an occurrence without mismatch.
  Blocks that can't occur again are not transformed: a word that comes next only beyond the scale's distances
  rules its block out, and within a known run a block occurs again at multiples of the period only.
* *Seeds.*  Each such distance is extended word by word to both sides.  Smaller distances come first, so that a
  stretch already known under a smaller period is not taken again; the rest are the runs.

All runs are found, in texts of any length: work is O(n log n) a scale and memory one block batch.

Defined results: a null or empty text or one without words has no runs and collapses to the empty text; rows with null or
repeated keys are judged each for itself; words are compared by 64-bit hashes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import texts
from .words import Words, slices

U64 = np.uint64
#: Words of a block that are transformed at most.
BLOCK = 4096
#: Primes c * 2**k + 1 below 2**31 with a generator; k bounds the transform's length.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Numbers in one batch of blocks.
BATCH = 1 << 19
_ROOTS: dict[tuple[int, int, bool], np.ndarray] = {}


def _roots(prime: int, generator: int, half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``, kept for later calls."""
    known = _ROOTS.get((prime, half, inverse))
    if known is None:
        root = pow(generator, (prime - 1) // (2 * half), prime)
        root = pow(root, -1, prime) if inverse else root
        known, have = np.ones(half, U64), 1
        while have < half:  # doubles what is there
            more = min(have, half - have)
            known[have:have + more] = known[:more] * U64(pow(root, have, prime)) % U64(prime)
            have += more
        _ROOTS[prime, half, inverse] = known
    return known


def transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The transform of each row (a power of two long) modulo ``prime``, in bit-reversed order."""
    x, (m, n), p = rows.copy(), rows.shape, U64(prime)
    half = n // 2
    while half:
        pair = x.reshape(m, -1, 2, half)
        u, v = pair[:, :, 0].copy(), pair[:, :, 1]
        pair[:, :, 0], pair[:, :, 1] = (u + v) % p, (u + (p - v)) * _roots(prime, generator, half, False) % p
        half //= 2
    return x


def restore(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The rows whose ``transform`` is given."""
    x, (m, n), p = rows.copy(), rows.shape, U64(prime)
    half = 1
    while half < n:
        pair = x.reshape(m, -1, 2, half)
        u, v = pair[:, :, 0].copy(), pair[:, :, 1] * _roots(prime, generator, half, True) % p
        pair[:, :, 0], pair[:, :, 1] = (u + v) % p, (u + (p - v)) % p
        half *= 2
    return x * U64(pow(n, -1, prime)) % p


def mismatches(block: np.ndarray, window: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """For each row and distance d < len(window) - len(block) + 1: sum over k of (block[k] - window[d + k]) ** 2, modulo ``prime``."""
    p, b, w = U64(prime), block.shape[1], window.shape[1]
    n = 1 << (w - 1).bit_length()
    x, y = np.zeros((len(block), n), U64), np.zeros((len(block), n), U64)
    block, window = block % p, window % p
    x[:, 0], x[:, n - b + 1:] = block[:, 0], block[:, :0:-1]  # reversed, so that the product correlates
    y[:, :w] = window
    both = restore(transform(x, prime, generator) * transform(y, prime, generator) % p, prime, generator)[:, :w - b + 1]
    squares = np.zeros((len(block), w + 1), U64)
    np.cumsum(window * window % p, axis=1, out=squares[:, 1:])
    own = (block * block % p).sum(axis=1)[:, None]
    return (own + (squares[:, b:] - squares[:, :-b]) + U64(2) * (p - both)) % p


def _extended(word: np.ndarray, a: int, b: int, d: int, low: int, high: int) -> tuple[int, int]:
    """The widest [l, r) in [low, high) that holds [a, b) and [a + d, b + d) and keeps the distance d."""
    step, l = 64, a
    while l > low:
        n = min(step, l - low)
        same = word[l - n:l] == word[l - n + d:l + d]
        if not same.all():
            l += int(np.flatnonzero(~same)[-1]) + 1 - n
            break
        l, step = l - n, step * 2
    step, r = 64, b
    while r + d < high:
        n = min(step, high - d - r)
        same = word[r:r + n] == word[r + d:r + n + d]
        if not same.all():
            r += int(np.flatnonzero(~same)[0])
            break
        r, step = r + n, step * 2
    return l, r + d


def find_runs(word: np.ndarray, first: np.ndarray, least: int = 24) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each row; ``first`` cuts ``word`` (any integers) into rows."""
    n, rows = len(word), len(first) - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    length = np.diff(first)
    if not n or length.max() < least:
        return runs
    owner = np.repeat(np.arange(rows), length)
    order = np.lexsort((word, owner))
    new = np.ones(n, bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    number = np.cumsum(new)
    number -= np.repeat(number[np.minimum(first[:-1], n - 1)], length) - 1  # sorted, rows keep their places: small numbers in each
    value, gap = np.empty(n, U64), np.full(n, n, np.int64)
    value[order] = number.astype(U64)
    again = ~new[1:]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    largest = int(value.max())
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run that reaches farthest over each word: its end and period
    taken: set[tuple[int, int]] = set()
    low = 1
    while 3 * low <= length.max():
        size, high, every = max(8, min(low, BLOCK)), max(8, 2 * low), max(8, low)
        a = _blocks(first, length, size, low, every)
        far = np.concatenate(([0], np.cumsum(gap >= high)))
        a = a[far[a + size] == far[a]]
        a = a[reach[a] < a + size + high - 1]  # within a run it occurs again at multiples of the period
        stop = first[owner[a] + 1]
        for at, d in sorted(_seeds(value, a, stop, size, low, high, largest), key=lambda seed: seed[1]):
            if at + size + d <= reach[at] and d % period[at] == 0:
                continue
            row = owner[at]
            l, r = _extended(value, at, at + size, d, first[row], first[row + 1])
            if r - l < max(least, 3 * d) or (l, r) in taken:
                continue
            taken.add((l, r))
            nearer = l + np.flatnonzero(reach[l:r] < r)
            reach[nearer], period[nearer] = r, d
            runs[row].append((int(l - first[row]), int(r - l), int(d)))
        low = high
    for own in runs:
        own.sort(key=lambda run: (run[0], run[2]))
    return runs


def _blocks(first: np.ndarray, length: np.ndarray, size: int, low: int, every: int) -> np.ndarray:
    """Starts of the blocks of all rows that can occur again at a distance ``low`` or more."""
    count = np.maximum(0, (length - size - low) // every + 1)
    count[length < max(size + low, 3 * low)] = 0
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first[:-1], count) + every * within


def _seeds(value: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int, low: int, high: int, largest: int) -> Iterator[tuple[int, int]]:
    """(block start, distance in [low, high)) of each occurrence of a block; ``stop`` is the end of its row."""
    bound = largest * largest * size
    for near in range(low, high, size):
        lags = min(size, high - near)
        for at in range(0, len(start), max(1, BATCH // (2 * size))):
            a, end = start[at:at + max(1, BATCH // (2 * size))], stop[at:at + max(1, BATCH // (2 * size))]
            hit = (a[:, None] + near + np.arange(lags) + size) <= end[:, None]
            product = 1
            for prime, generator in PRIMES:
                some = np.flatnonzero(hit.any(axis=1))
                if product > bound or not len(some):
                    break
                place = a[some, None] + near + np.arange(size + lags - 1)
                window = np.where(place < end[some, None], value[np.minimum(place, len(value) - 1)], U64(0))
                hit[some] &= mismatches(value[a[some, None] + np.arange(size)], window, prime, generator) == 0
                product *= prime
            if product <= bound and hit.any():
                raise ValueError("a text has too many different words for the primes given")
            row, lag = np.nonzero(hit)
            yield from zip(a[row].tolist(), (lag + near).tolist(), strict=True)


def _scan(least: int):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            words = Words(piece.column("text"))
            found = find_runs(words.hash, words.first, least)
            data, collapsed = words.data.tobytes(), []
            for r, runs in enumerate(found):
                if not runs:
                    kept = data[words.offsets[r]:words.offsets[r + 1]].split()
                else:
                    n = int(words.count[r])
                    edge = np.zeros(n + 1, np.int64)
                    for start, length, period in runs:
                        edge[start + period] += 1
                        edge[start + length] -= 1
                    which = np.flatnonzero(np.cumsum(edge[:n]) == 0) + words.first[r]
                    kept = [data[s:e] for s, e in zip(words.start[which].tolist(), words.end[which].tolist(), strict=True)]
                collapsed.append(b" ".join(kept).decode())
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(words.count.astype(np.int64)),
                                              pa.array(runs, pa.list_(run_type)), pa.array(collapsed, pa.string())], schema=schema)

    return run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the words outside repetitions) of every row."""
    if least < 24:
        raise ValueError("blocks of 8 words find runs of at least 24 words")
    run, kind = _scan(least)
    return texts(docs, key, text).mapInArrow(run, kind)
