"""Token ids in wavelet-matrix files.

A file holds the ids of a run of documents as one bit-plane for each bit of the largest id, highest first; after each
plane the ids are split stably into zeros and ones. With the count of ones before each 512th bit, which the file holds
too, ``access``, ``rank`` and ``select`` take one step a plane, and read just the chunk of the plane in which the step
is: a token, a count or the nth occurrence comes from the file (``WaveletFile``) without decoding it.

Layout (little-endian): b"WVM2", u32 length of the JSON head, the head (n, docs, zeros per plane, byte length of each
section), then sections compressed with zstd: document ids (i64), document lengths (u32), each plane's counts (u32),
each plane's packed bits in chunks of 8 KiB.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._cluster import cut, parts_for, shared_dir
from ._text import slices
from ._tokens import SLICE_BYTES, encoder

MAGIC, BLOCK, CHUNK = b"WVM2", 512, 1 << 13
#: Tokens after which a task starts another file.
SHARD_TOKENS = 2 << 20
#: Chunks of planes that an open file keeps at hand.
KEPT_CHUNKS = 128


def _ones_before(plane: np.ndarray) -> np.ndarray:
    """Ones before each BLOCKth bit of a plane, and in all."""
    if not len(plane):
        return np.zeros(1, np.uint32)
    count = np.bitwise_count(plane).astype(np.uint32)
    return np.concatenate(([0], np.cumsum(np.add.reduceat(count, np.arange(0, len(plane), BLOCK // 8))))).astype(np.uint32)


class _Steps:
    """Access, rank and select over bit-planes, given n, zeros, _bytes(level, first, end) and _ranks(level)."""

    n: int
    zeros: list[int]

    def _bit(self, level: int, i: int) -> int:
        return int(self._bytes(level, i >> 3, (i >> 3) + 1)[0]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        rest = np.unpackbits(self._bytes(level, block * (BLOCK // 8), (i + 7) >> 3), bitorder="little")[: i - block * BLOCK]
        return int(self._ranks(level)[block]) + int(rest.sum())

    def _select(self, level: int, k: int, one: bool) -> int:
        """The place of the kth (from 0) one or zero in a plane."""
        ones = self._ranks(level).astype(np.int64)
        seen = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(seen, k, side="right")) - 1
        part = np.unpackbits(self._bytes(level, block * (BLOCK // 8), (block + 1) * (BLOCK // 8)), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == one)[k - int(seen[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(f"{i} of {self.n} ids")
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _walk(self, value: int, i: int) -> tuple[int, int]:
        low, bits = 0, len(self.zeros)
        if value >> bits:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, low), self._rank1(level, i)
            low, i = (zeros + a, zeros + b) if value >> (bits - 1 - level) & 1 else (low - a, i - b)
        return low, i

    def rank(self, value: int, i: int) -> int:
        """How often the id occurs before place i."""
        low, high = self._walk(value, i)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the kth occurrence (from 0) of the id."""
        low, high = self._walk(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(f"{value} occurs {high - low} times")
        i = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = bool(value >> (len(self.zeros) - 1 - level) & 1)
            i = self._select(level, i - self.zeros[level] if one else i, one)
        return i


class WaveletMatrix(_Steps):
    """A wavelet matrix over ids of documents, in memory."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], doc_ids: np.ndarray, lengths: np.ndarray):
        self.n, self.zeros, self.planes, self.doc_ids, self.lengths = n, zeros, planes, doc_ids, lengths
        self._counts: dict[int, np.ndarray] = {}

    def _bytes(self, level: int, first: int, end: int) -> np.ndarray:
        return self.planes[level][first:end]

    def _ranks(self, level: int) -> np.ndarray:
        if level not in self._counts:
            self._counts[level] = _ones_before(self.planes[level])
        return self._counts[level]

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids=(), lengths=()) -> WaveletMatrix:
        ids = np.asarray(ids, np.uint32)
        bits = max(1, int(ids.max(initial=0)).bit_length())
        now, planes, zeros = ids.astype(np.uint16) if bits <= 16 else ids, [], []
        for shift in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << shift)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low = len(now) - int(np.count_nonzero(one))
            zeros.append(low)
            split = np.empty_like(now)
            np.compress(~one, now, out=split[:low])
            np.compress(one, now, out=split[low:])
            now = split
        return cls(len(ids), zeros, planes, np.asarray(doc_ids, np.int64), np.asarray(lengths, np.uint32))

    def ids(self) -> np.ndarray:
        """All ids, by undoing the splits from the last plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level, (zeros, plane) in enumerate(zip(self.zeros[::-1], self.planes[::-1], strict=True)):
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~one)] = now[:zeros]
            up[np.flatnonzero(one)] = now[zeros:] | now.dtype.type(1 << level)
            now = up
        return now.astype(np.uint32)

    def to_bytes(self) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(self.doc_ids.astype("<i8").tobytes()), pack(self.lengths.astype("<u4").tobytes())]
        parts += [pack(self._ranks(level).astype("<u4").tobytes()) for level in range(len(self.planes))]
        parts += [pack(p[a : a + CHUNK].tobytes()) for p in self.planes for a in range(0, len(p), CHUNK)]
        head = json.dumps({"n": self.n, "docs": len(self.doc_ids), "zeros": self.zeros, "sections": [len(p) for p in parts]}).encode()
        return b"".join((MAGIC, len(head).to_bytes(4, "little"), head, *parts))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """All of a file at once."""
        import io

        file = WaveletFile(io.BytesIO(data))
        size = (file.n + 7) // 8
        return cls(file.n, file.zeros, [file.plane(level, size) for level in range(len(file.zeros))], file.doc_ids(), file.lengths())


class WaveletFile(_Steps):
    """A wavelet matrix in an open file (with seek and read), of which only what is asked for is read."""

    def __init__(self, file):
        self._file = file
        start = self._read(0, 8)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        size = int.from_bytes(start[4:], "little")
        head = json.loads(self._read(8, size))
        self.n, self.docs, self.zeros, self._sizes = head["n"], head["docs"], head["zeros"], head["sections"]
        self._at = np.concatenate(([8 + size], 8 + size + np.cumsum(self._sizes, dtype=np.int64))).tolist()
        self._chunks = -(-((self.n + 7) // 8) // CHUNK)
        self._counts: dict[int, np.ndarray] = {}
        self._held: dict[int, np.ndarray] = {}

    def _read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _section(self, k: int, most: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._read(self._at[k], self._sizes[k]), max_output_size=most + 64)

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._section(0, 8 * self.docs), "<i8")

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._section(1, 4 * self.docs), "<u4")

    def plane(self, level: int, size: int) -> np.ndarray:
        first = 2 + len(self.zeros) + level * self._chunks
        return np.frombuffer(b"".join(self._section(k, CHUNK) for k in range(first, first + self._chunks)), np.uint8)[:size]

    def _ranks(self, level: int) -> np.ndarray:
        if level not in self._counts:
            self._counts[level] = np.frombuffer(self._section(2 + level, 4 * (self.n // BLOCK + 2)), "<u4")
        return self._counts[level]

    def _bytes(self, level: int, first: int, end: int) -> np.ndarray:
        # a block of bits lies within one chunk
        k = 2 + len(self.zeros) + level * self._chunks + min(first // CHUNK, self._chunks - 1)
        if first // CHUNK >= self._chunks:
            return np.zeros(0, np.uint8)
        if k not in self._held:
            if len(self._held) >= KEPT_CHUNKS:
                self._held.pop(next(iter(self._held)))
            self._held[k] = np.frombuffer(self._section(k, CHUNK), np.uint8)
        low = first // CHUNK * CHUNK
        return self._held[k][first - low : end - low]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Writes every text's ids and the end id to files under ``folder`` in ascending doc_id order and returns one row
    for each: (file, base, n_tokens, n_docs), base being the number of ids in the files before it.

    Rows are dealt by ranges of doc_id; a task writes its range as one file or more of about ``shard_tokens`` ids, each
    under a name of its own that then takes its place at once, so a task that runs again leaves the same files. Rows
    with a null id are not written. Null and empty texts are the end id alone. Rows that repeat an id stand side by
    side, ordered by text. An empty table writes nothing."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    n = parts_for(kept, F.octet_length("text"), 24 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ids, doc ids and lengths
        tokens = 0

        def flush() -> None:
            nonlocal tokens
            if held:
                ids, doc_ids, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
                name = f"part-{part:06d}-{len(rows):05d}.wvm"
                part_name = f"{root}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part_name) as out:
                    out.write(WaveletMatrix.build(ids, doc_ids, lengths).to_bytes())
                store.move(part_name, f"{root}/{name}")
                rows.append((f"{root}/{name}", part, len(rows), len(ids), len(doc_ids)))
                held.clear()
                tokens = 0

        for batch in batches:
            for piece, buf, off in slices(batch, "text", SLICE_BYTES):
                ids, at = words.encode(buf, off, int(end_id))
                doc_ids, a = piece.column(0).to_numpy(zero_copy_only=False), 0
                while a < len(doc_ids):  # up to the document that fills the file
                    b = min(int(np.searchsorted(at, at[a] + shard_tokens - tokens)), len(doc_ids))
                    held.append((ids[at[a] : at[b]], doc_ids[a:b], np.diff(at[a : b + 1])))
                    tokens += int(at[b] - at[a])
                    a = b
                    if tokens >= shard_tokens:
                        flush()
        flush()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "part", "seq", "n_tokens", "n_docs"])

    files = cut(
        kept.repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "file string, part long, seq long, n_tokens long, n_docs long")
    )
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    return files.select("file", F.coalesce(before, F.lit(0)).alias("base"), "n_tokens", "n_docs")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from write_files()'s files, one file in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(file) as f:
                    matrix = WaveletMatrix.from_bytes(f.read())
                at = np.concatenate(([0], np.cumsum(matrix.lengths, dtype=np.int64)))
                ids = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(matrix.ids().astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(matrix.doc_ids), pa.array(at[:-1] + base), pa.array(matrix.lengths.astype(np.int64)), ids],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    spread = files.select("file", "base").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents as word-BPE ids and id 2, written to files in the shared folder and read back."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    files = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_files(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
