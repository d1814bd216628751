"""Packing token pieces into windows with non-negative least squares.

Documents are cut into windows of 2048 ids and a rest. Lengths are counted in steps of 8 ids (256 classes), a histogram
of fixed size. Every combination of one, two or three classes that fills a window is a column; NNLS finds how often
each should repeat so that the columns add up to the histogram. Repeats are rounded within what is left of each class,
and the residual is packed greedily, again by class and count, so planning costs the same for any number of pieces.
Pieces then find their place by their rank in their class, which is counted in hashed buckets, as many as the class needs
for each to stay small. A sequence is padded to the window, or left as it is where its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._cluster import cut
from ._text import slices
from ._tokens import SLICE_BYTES, encoder

WINDOW, STEP = 2048, 8
#: Pieces of a class that one bucket ranks, on average.
BUCKET_ROWS = 4000


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each text's ids and the end id, cut every ``window`` ids.
    ids are little-endian unsigned 32-bit. A null or empty text is the end id alone; null ids and repeated rows are
    kept as they are; other columns are ignored. No shuffle."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            for part, buf, off in slices(batch, "text", SLICE_BYTES):
                ids, at = words.encode(buf, off, int(end_id))
                size = np.diff(at)
                pieces = -(-size // window)
                doc = np.repeat(np.arange(len(size)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(size[doc] - start, window)
                cuts = np.append(at[doc] + start, len(ids))
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                cols = [part.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, size[doc]))]
                if with_ids:
                    cols.append(pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(ids)]))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets, on the normal equations. Columns enter at most three times each, on
    average; should that not do, the last x, which is feasible, is returned."""
    gram_of, target = a.T, a.T @ b
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, np.abs(target).max(initial=0))
    for _ in range(3 * a.shape[1]):
        grad = target - gram_of @ (a @ x)
        grad[passive] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= tol:
            break
        passive[j] = True
        while True:
            cols = np.flatnonzero(passive)
            sub = a[:, cols]
            z = np.linalg.solve(sub.T @ sub + 1e-9 * np.eye(len(cols)), target[cols])
            if z.min() > 0:
                x[:] = 0
                x[cols] = z
                break
            old = x[cols]
            low = z <= 0
            alpha = (old[low] / np.maximum(old[low] - z[low], 1e-300)).min()
            x[cols] = old + alpha * (z - old)
            out = cols[(x[cols] <= 1e-12) & low]
            x[out] = 0
            passive[out] = False
            if not passive.any():
                break
    return x


def plan(counts: dict[int, int], full: int = WINDOW // STEP) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of classes that together fit ``full`` steps, with how often each repeats; every piece is in one."""
    left = np.zeros(full + 1, np.int64)
    for c, n in counts.items():
        left[c] = n
    out = [((full,), int(left[full]))] if left[full] else []
    left[full] = 0
    some = np.flatnonzero(left)
    if len(some) > 1 or (len(some) and 2 * some[0] == full):
        have = set(some.tolist())
        columns = [(a, full - a) for a in some.tolist() if a <= full - a and full - a in have]
        columns += [(a, b, full - a - b) for a in some.tolist() for b in some.tolist() if a <= b <= full - a - b and full - a - b in have]
        if columns:
            matrix = np.zeros((full + 1, len(columns)))
            for k, parts in enumerate(columns):
                for c in parts:
                    matrix[c, k] += 1
            times = nnls(matrix[some], left[some].astype(float))
            for k in np.argsort(-times, kind="stable"):
                need = np.bincount(columns[k], minlength=full + 1)
                used = np.flatnonzero(need)
                n = int(min(round(times[k]), (left[used] // need[used]).min()))
                if n > 0:
                    left -= n * need
                    out.append((columns[k], n))
    while left.any():  # each turn uses up a class at least
        room, parts, rest = full, [], left.copy()
        while True:
            fits = np.flatnonzero(rest[: room + 1])
            if not len(fits) or room <= 0:
                break
            c = int(fits[-1])
            parts.append(c)
            rest[c] -= 1
            room -= c
        need = np.bincount(parts, minlength=full + 1)
        used = np.flatnonzero(need)
        n = int((left[used] // need[used]).min())
        left -= n * need
        out.append((tuple(parts), n))
    return out


def _intervals(spark: SparkSession, patterns: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """(cls, lo, hi, seq, slot): ranks lo..hi-1 of a class go to sequences seq, seq + 1, ... A table of bounded size."""
    taken: dict[int, int] = {}
    rows, seq = [], 0
    for parts, n in patterns:
        for slot, c in enumerate(parts):
            lo = taken.get(c, 0)
            rows.append((c, lo, lo + n, seq, slot))
            taken[c] = lo + n
        seq += n
    return spark.createDataFrame(rows, "cls long, lo long, hi long, seq long, slot long")


def pack(pieces: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """``pieces`` (1 <= length <= window) with sequence_id, offset and padded_to: each piece in one sequence, sequences of
    at most ``window`` tokens, offsets gapless from 0. padded_to is the sequence's length with its padding: its own where
    that is a power of two, else ``window``. Other columns are carried, whatever their names; columns of these three names
    are replaced. Repeated rows are placed one by one. No rows give no rows. The input is read three times; pass a cut table."""
    made = ("sequence_id", "offset", "padded_to")
    spread = [F.col(f"_p.{c}") for c in ("doc_id", "start", "ids_crc32", "length") if c in pieces.columns]
    cls = F.ceil(F.col("length") / F.lit(step)).cast("long")
    histogram = {r["c"]: r["n"] for r in pieces.groupBy(cls.alias("c")).agg(F.count("*").alias("n")).collect()}  # window / step rows at most
    buckets = F.array(*[F.lit(histogram.get(c, 0) // BUCKET_ROWS + 1) for c in range(window // step + 1)])
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns if c not in made]).alias("_p"), cls.alias("_cls"))
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.get(buckets, F.col("_cls").cast("int"))))
    counts = placed.groupBy("_cls", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_cls").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("_cls", "_bucket", F.coalesce(before, F.lit(0)).alias("_first"))
    where = _intervals(pieces.sparkSession, plan(histogram, window // step))
    rank = F.row_number().over(Window.partitionBy("_cls", "_bucket").orderBy(*spread)) - 1
    ranked = placed.withColumn("_r", rank).join(first, ["_cls", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_r"))
    # a row for each class of each pattern: bounded by the classes, whatever the number of pieces
    seated = ranked.join(F.broadcast(where), (F.col("_cls") == F.col("cls")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    seated = seated.withColumn("_seq", F.col("seq") + F.col("_rank") - F.col("lo")).withColumn("_size", F.col("_p.length"))
    in_order = Window.partitionBy("_seq").orderBy("slot")
    offset = F.coalesce(F.sum("_size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    padded = F.when(F.bit_count(total) == 1, total).otherwise(F.lit(window).cast("long"))
    return seated.select("_p", "_seq", offset.alias("_offset"), padded.alias("_padded")).select(
        "_p.*", F.col("_seq").alias("sequence_id"), F.col("_offset").alias("offset"), F.col("_padded").alias("padded_to")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens, doc_ids, lengths) of pack()'s rows with ids: the training rows themselves."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
        "n_tokens",
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.length").alias("lengths"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Places of all pieces of all documents; ids stay behind as their CRC."""
    return pack(cut(token_pieces(docs, tokenizer, end_id, with_ids=False)))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents as byte-level BPE ids and id 1, packed into windows of 2048."""
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 1)
