"""Array kernels over Arrow string columns: words, word hashes and shingles without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a worker; a single longer text is still taken whole.
SLICE_BYTES = 1 << 20

_U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept, as every slice needs them."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        have = np.full(size, base & ((1 << 64) - 1), np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= SLICE_BYTES + 1:
            _powers[base] = have
    return have[: n + 1]


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and len + 1 offsets into them. Nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts together stay under ``limit`` bytes (one row at least), with flat() of them."""
    buf, off = flat(batch.column(batch.schema.get_field_index(text)))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def edges(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of True; a run never crosses a row."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cut = off[1:-1]
    first[cut[(cut > 0) & (cut < n)]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cut[cut > 0] - 1] = True
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span; with fold, A-Z count as a-z."""
    table = _TABLE[LOWER] if fold else _TABLE
    acc = np.empty(len(buf) + 1, np.uint64)
    acc[0] = 0
    np.cumsum(table[buf] * powers(len(buf))[:-1], out=acc[1:])
    h = (acc[end] - acc[start]) * powers(len(buf), _BASE_INV)[start]
    return mix(h ^ ((end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def words(buf: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row numbers and hashes of the words ``[^\\x20\\x09-\\x0D]+``."""
    start, end, row = edges(~WHITE[buf], off)
    return start, end, row, span_hash(buf, start, end, fold)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's ``width``-word shingles; a shorter row's whole sequence is its only one."""
    at = np.searchsorted(row, np.arange(n_rows + 1))
    joined = None
    if len(hashes) >= width:
        joined = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            joined = mix(joined * _U(0x2545F4914F6CDD1D) + hashes[k : len(hashes) - width + 1 + k])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(joined[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = hashes[a : a + 1]
            for k in range(a + 1, b):
                h = mix(h * _U(0x2545F4914F6CDD1D) + hashes[k : k + 1])
            out.append(mix(h + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal (non-null integer) keys as one table each, from a stream sorted by them.
    Only one such run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """As runs(), but as many whole runs at once as a batch ends, with the number of each row's run."""
    held: list[pa.RecordBatch] = []

    def numbered() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return table, np.cumsum(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        last = np.ones(batch.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        start = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        before = held[-1].slice(held[-1].num_rows - 1) if held else None
        if start or (before and any(before.column(before.schema.get_field_index(k))[0].as_py() != c[0] for k, c in zip(keys, cols, strict=True))):
            if start:
                held.append(batch.slice(0, start))
            yield numbered()
            held = []
        held.append(batch.slice(start))
    if held:
        yield numbered()


def byte_planes(values: np.ndarray, width: int) -> bytes:
    """Numbers as ``width`` byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def from_byte_planes(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def packed_sets(sets: list[np.ndarray]) -> pa.Array:
    """A binary column of sorted 64-bit hashes, 48 bits of each, as differences."""
    return pa.array([byte_planes(np.diff(s >> _U(16), prepend=_U(0)), 6) for s in sets], pa.binary())


def unpacked_sets(col) -> list[np.ndarray]:
    """The 48-bit hashes of packed_sets()."""
    return [np.cumsum(from_byte_planes(x, 6), dtype=np.uint64) for x in col.to_pylist()]
