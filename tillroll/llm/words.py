"""Vectorised word splitting and hashing over Arrow text columns (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []
_BLOCK = 1 << 16  # bytes hashed at a time; small enough for the processor's cache


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits (wrapping arithmetic)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64; kept for the usual size only."""
    if n <= _BLOCK + 1 and _POWERS:
        return _POWERS
    out = []
    for step in (int(_MULT), pow(int(_MULT), -1, 1 << 64)):
        steps = np.full(max(n, _BLOCK + 1), step, dtype=U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if n <= _BLOCK + 1:
        _POWERS[:] = out
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int = 1 << 21,
           max_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds at most ``max_bytes`` of ``column`` (or one row)."""
    for batch in batches:
        offsets, _ = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows, start + max_rows)
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each row, all bytes); a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


class Words:
    """Words of a text column: byte spans, 64-bit hashes, and the first word index of each row."""

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True):
        self.offsets, data = text_bytes(column)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = ~_SPACE[data]
        begins = inside.copy()
        ends = inside.copy()
        if n:
            edges = np.zeros(n + 1, dtype=bool)
            edges[self.offsets] = True
            begins[1:] &= ~inside[:-1] | edges[1:n]
            ends[:-1] &= ~inside[1:] | edges[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.hash = self._hashes() if hashes else None

    def row(self) -> np.ndarray:
        """Row index of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=U64)
        w = 0
        with np.errstate(over="ignore"):
            while w < len(out):
                a = self.start[w]
                stop = max(w + 1, int(np.searchsorted(self.end, a + _BLOCK, side="right")))
                b = self.end[stop - 1]
                power, inverse = _powers(int(b - a) + 1)
                total = np.zeros(b - a + 1, dtype=U64)
                np.cumsum((self.data[a:b].astype(U64) + U64(1)) * power[:b - a], out=total[1:])
                s, e = self.start[w:stop] - a, self.end[w:stop] - a
                out[w:stop] = (total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * _MULT
                w = stop
        return mix(out)


def grams(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (runs may cross rows; callers mask those)."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, seed, dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * _MULT + hashes[j:j + n]
    return mix(out)


def pack(array: np.ndarray) -> bytes:
    """Bytes of an array, most similar bytes side by side, so that shuffle compression finds them."""
    array = np.ascontiguousarray(array)
    return array.view(np.uint8).reshape(-1, array.dtype.itemsize).T.tobytes()


def unpack(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def zipped(column: pa.Array) -> pa.Array:
    """Each text as one zstd frame behind its length; a null one is an empty one."""
    offsets, data = text_bytes(column)
    raw, codec = data.tobytes(), pa.Codec("zstd", compression_level=6)
    return pa.array([int(b - a).to_bytes(8, "little") + codec.compress(raw[a:b], asbytes=True)
                     for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())


def unzipped(column: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([None if b is None else codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)
                     for b in column.to_pylist()], pa.binary())


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with compressed texts, for shuffles that several steps reuse."""
    for piece in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), zipped(piece.column("text"))], names=["doc_id", "text"])


def unpacked(batches: Iterator[pa.RecordBatch], max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The reverse, in pieces of at most ``max_bytes`` packed bytes; all other columns stay."""
    for piece in slices(batches, "text", max_bytes):
        yield piece.set_column(piece.schema.get_field_index("text"), "text", unzipped(piece.column("text")))
