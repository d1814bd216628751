"""Uncompressed TIFF pictures as tables of pixels, by the public file format: strips, one or more samples a pixel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags of the format, sizes of its field types, sample kinds.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, KIND = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8)}
_KINDS = {1: "u", 2: "i", 3: "f"}


def decode(data: bytes) -> np.ndarray:
    """The (band, row, column) array of a picture as single-precision floats."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF picture")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    tags: dict[int, tuple] = {}
    for k in range(n):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind in _SIZES:
            code, size = _SIZES[kind]
            where = 8 if size * count <= 4 else None
            raw = entry[8 : 8 + size * count] if where else data[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size * count]
            tags[tag] = struct.unpack(order + code[:1] * (count * len(code)), raw) if code != "s" else (raw,)
    if tags.get(COMPRESSION, (1,))[0] != 1:
        raise ValueError("the picture is compressed")
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    kind = np.dtype(f"{order}{_KINDS[tags.get(KIND, (1,))[0]]}{tags[BITS][0] // 8}")
    raw = b"".join(data[a : a + c] for a, c in zip(tags[OFFSETS], tags[COUNTS], strict=True))
    cells = np.frombuffer(raw, kind, width * height * samples)
    shape = (samples, height, width) if tags.get(PLANAR, (1,))[0] == 2 else (height, width, samples)
    cells = cells.reshape(shape)
    return (cells if shape[0] == samples and tags.get(PLANAR, (1,))[0] == 2 else np.moveaxis(cells, 2, 0)).astype(np.float32)


def encode(bands: np.ndarray) -> bytes:
    """A (band, row, column) array of single-precision floats as one picture, samples side by side."""
    bands = np.asarray(bands, "<f4")
    samples, height, width = bands.shape
    raw = np.moveaxis(bands, 0, 2).tobytes()
    fields = [(WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (32,) * samples), (COMPRESSION, 3, (1,)), (PHOTOMETRIC, 3, (1,)), (OFFSETS, 4, (0,)), (SAMPLES, 3, (samples,)), (ROWS, 4, (height,)), (COUNTS, 4, (len(raw),)), (PLANAR, 3, (1,)), (KIND, 3, (3,) * samples)]
    start = 8 + 2 + 12 * len(fields) + 4
    extra, entries = b"", b""
    for tag, kind, values in fields:
        code, size = _SIZES[kind]
        packed = struct.pack("<" + code * len(values), *values)
        if len(packed) > 4:
            packed, extra = struct.pack("<I", start + len(extra)), extra + packed
        entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    at = struct.pack("<HHI", OFFSETS, 4, 1) + struct.pack("<I", 0)
    entries = entries.replace(at, struct.pack("<HHI", OFFSETS, 4, 1) + struct.pack("<I", start + len(extra)))
    return b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra + raw


def pixels(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, band, row, col, value) of binaryFile rows, one picture in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = decode(data)
                band, row, col = np.indices(cells.shape, np.int32)
                cols = [pa.array([name] * cells.size, pa.string()), *(pa.array(x.ravel()) for x in (band, row, col)), pa.array(cells.ravel())]
                yield pa.RecordBatch.from_arrays(cols, ["path", "band", "row", "col", "value"])

    return files.select(path, content).mapInArrow(run, "path string, band int, row int, col int, value float")
