"""MinHash near-duplicates by a multi-index Hamming join.

Each text becomes the set of its word shingles and a signature of 32 b-bit MinHash values. Two sets of Jaccard
likeness j differ in each value with probability about 1 - j. A signature is split into 8 chunks of 4 values. By
pigeonhole, two signatures at a distance of at most 8 * (1 + 1) - 1 = 15 agree, in some chunk, in all values but one
at most; so each chunk is filed under its 4 keys of 3 values (one error allowed at each place), and no pair within
that distance is missed. At j = 0.8 a pair shares none of the 32 keys with probability 1.1e-6.

Texts with one shingle set are one class. The classes of one key are compared by sketches: how many hashes of a set fall
into each of so many equal ranges. Two sketches differ by no more than the sets do, so a pair whose sketches differ by
more than alike sets may is ruled out for certain, and chance keys, which grow with the square of the input, tie no
unlike texts together. Connected components of what is left are clusters; they hold every pair that shares a key and is
alike. Within a cluster (large ones are cut into square tiles, all of which are compared) pairs that share none of their
rarest shingles, of which two sets alike enough must share one, are left aside, and the full sets decide on the rest: no
pair of a cluster is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ._cluster import components, cut, release
from ._text import flat, mix, packed_sets, runs, shingles, slices, unpacked_sets, whole_runs, words

VALUES, CHUNK, BITS = 32, 4, 16
#: Classes of a cluster, and shingles in them, that one tile compares with as many others.
TILE, TILE_SHINGLES = 2048, 4 << 20
#: Classes of a key that one tile compares with as many others; up to so many of one key are compared pair by pair.
KEY_TILE, FEW = 4096, 8
_U = np.uint64
_FACTORS = np.random.default_rng(71).integers(1, 1 << 63, VALUES, dtype=np.uint64) * _U(2) + _U(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32 b-bit MinHash values for each set; zeros for an empty one."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
        for k, f in enumerate(_FACTORS):
            out[full, k] = (mix(np.minimum.reduceat(joined * f, at)) & _U((1 << BITS) - 1)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature, a key for each chunk and each place in it that may be wrong."""
    wide, keys = sig.astype(np.uint64), []
    for c in range(0, VALUES, CHUNK):
        for skip in range(CHUNK):
            k = np.full(len(sig), c * CHUNK + skip + 1, np.uint64)
            for place in range(CHUNK):
                if place != skip:
                    k = mix(k * _U(0x2545F4914F6CDD1D) + wide[:, c + place])
            keys.append(k)
    return np.stack(keys, 1) if len(sig) else np.zeros((0, VALUES), np.uint64)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """For each set, how many of its hashes (up to 255) fall into each of 2**k equal ranges, one range for 2 to 4 hashes."""
    out = []
    for s in sets:
        k = max(4, (-(-len(s) // 4) - 1).bit_length())
        count = np.bincount((s >> _U(64 - k)).astype(np.int64), minlength=1 << k)
        out.append(np.minimum(count, 255).astype(np.uint8).tobytes())
    return out


class Sketched:
    """Sets known by size and sketch, to be told apart."""

    def __init__(self, sketch, sizes: np.ndarray, num: int, den: int):
        buf, off = flat(sketch)
        self.sizes, self.num, self.den = sizes, num, den
        self.bins, self.at, self.rows = np.diff(off), np.zeros(len(sizes), np.int64), {}
        for b in np.unique(self.bins).tolist():
            mine = np.flatnonzero(self.bins == b)
            self.at[mine] = np.arange(len(mine))
            self.rows[b] = buf[off[mine][:, None] + np.arange(b)]

    def _folded(self, i: np.ndarray, bins: int, to: int) -> np.ndarray:
        rows = self.rows[bins][self.at[i]]
        return rows if bins == to else np.minimum(rows.reshape(len(i), to, -1).sum(2), 255).astype(np.uint8)

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets i[k] and j[k] may have den * |i & j| >= num * |i | j|; never false if they have. With d elements
        in just one of the sets that is d * (den + num) <= (den - num) * (|i| + |j|), and sketches differ by d at most."""
        out = np.zeros(len(i), bool)
        left = np.flatnonzero(
            self.den * np.minimum(self.sizes[i], self.sizes[j]) >= self.num * np.maximum(self.sizes[i], self.sizes[j])
        )
        code = self.bins[i[left]] << 32 | self.bins[j[left]]
        for c in np.unique(code).tolist():
            p, q = c >> 32, c & 0xFFFFFFFF
            mine, step = left[code == c], max(1, (8 << 20) // max(p, q))
            for low in range(0, len(mine), step):
                k = mine[low : low + step]
                a, b = self._folded(i[k], p, min(p, q)), self._folded(j[k], q, min(p, q))
                apart = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64)
                out[k] = apart * (self.den + self.num) <= (self.den - self.num) * (self.sizes[i[k]] + self.sizes[j[k]])
        return out

    def joined(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that join all close pairs of ``rows``, as (row, first row of its component)."""
        left, found = rows[np.argsort(self.sizes[rows], kind="stable")], []
        while len(left) > 1:
            root, left = left[0], left[1:]
            front = np.array([root])
            while len(front) and len(left):
                hit = np.zeros(len(left), bool)
                if len(front) <= len(left):
                    for f in front:
                        a = np.searchsorted(self.sizes[left] * self.den, self.num * self.sizes[f])
                        b = np.searchsorted(self.sizes[left] * self.num, self.den * self.sizes[f], side="right")
                        new = np.flatnonzero(~hit[a:b]) + a
                        hit[new] = self.close(np.full(len(new), f), left[new])
                else:
                    for k, x in enumerate(left):
                        hit[k] = self.close(np.full(len(front), x), front).any()
                front, left = left[hit], left[~hit]
                found += [(front, np.full(len(front), root))]
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *x]) for x in zip(*found, strict=True)) if found else (empty, empty)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, fp, keys, sketch): the set's size, its 128-bit digest, its chunk keys and its sketch. One pass,
    no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                _, _, row, h = words(buf, off)
                sets = shingles(h, row, part.num_rows, width)
                keys = chunk_keys(signatures(sets)).view(np.int64)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                        pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                        pa.array([s if f else None for s, f in zip(sketches(sets), full, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp", "keys", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, fp binary, keys array<long>, sketch binary"
    )


def candidates(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join all classes (rep, n, keys, sketch) that share a key and that their sketches don't tell apart."""
    filed = classes.select("rep", F.explode("keys").alias("key"))
    tiles = F.ceil(F.count("*") / F.lit(KEY_TILE)).cast("int")
    shared = filed.groupBy("key").agg(F.count("*").alias("n"), tiles.alias("tiles")).where("n > 1").select("key", "tiles")
    rows = filed.join(shared, "key").join(classes.select("rep", "n", "sketch"), "rep")
    rows = in_tiles(rows, "rep").select("key", "ti", "tj", "rep", "n", "sketch")

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_runs(batches, ["key", "ti", "tj"]):
            ids, size = table.column("rep").to_numpy(), np.bincount(group)
            sets = Sketched(table.column("sketch"), table.column("n").to_numpy(), num, den)
            found = []
            for d in range(1, min(FEW, int(size.max()))):
                i = np.flatnonzero((group[:-d] == group[d:]) & (size[group[d:]] <= FEW))
                near = i[sets.close(i, i + d)]
                found.append((near, near + d))
            first = np.cumsum(size) - size
            found += [sets.joined(np.arange(first[g], first[g] + size[g])) for g in np.flatnonzero(size > FEW)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])

    return rows.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInArrow(links_of, "a long, b long")


def in_tiles(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows``, whose groups are cut into ``tiles`` parts, once for each pair of parts (ti, tj) in which they are compared."""
    mine = F.pmod(F.xxhash64(id_col), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = rows.withColumn("mine", mine).withColumn("other", other).where("tiles = 1 or other <> mine")
    return pairs.withColumn("ti", F.least("mine", "other")).withColumn("tj", F.greatest("mine", "other")).drop("mine", "other")


def _linked(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join all sets i, j with den * |i & j| >= num * |i | j|, as (set, smallest of its component)."""
    label = np.arange(len(sets))
    group = _settled(_may_link(sets, num, den))
    for g in np.unique(group):
        members = np.flatnonzero(group == g)
        if len(members) < 2:
            continue
        flat = np.concatenate([sets[i] for i in members])
        sizes = np.array([len(sets[i]) for i in members])
        owner = np.repeat(np.arange(len(members)), sizes)
        seen, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        column = np.full(len(seen), -1)
        column[shared] = np.arange(len(shared))
        c = column[inverse]
        owner, c = owner[c >= 0], c[c >= 0]
        order = np.argsort(c, kind="stable")
        owner, c = owner[order], c[order]
        both = np.zeros((len(members), len(members)), np.float32)
        step = max(256, 16_000_000 // len(members))
        for low in range(0, len(shared), step):
            a, b = np.searchsorted(c, [low, low + step])
            present = np.zeros((len(members), min(step, len(shared) - low)), np.float32)
            present[owner[a:b], c[a:b] - low] = 1
            both += present @ present.T
        both = both.astype(np.int64)
        link = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
        label[members] = members[_settled(link)]
    return [(i, int(k)) for i, k in enumerate(label) if i != k]


def _may_link(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Pairs that aren't ruled out, as a symmetric matrix with a true diagonal. With shingles in order of how many of these
    sets have them, two sets that share num / den of their union share one of their first n - ceil(n * num / den) + 1."""
    sizes = np.array([len(s) for s in sets])
    seen, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.lexsort((inverse, count[inverse], owner))
    place = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = place < np.repeat(sizes - -(-sizes * num // den) + 1, sizes)
    rare, mine = inverse[by][first], owner[first]
    keep = count[rare] > 1
    rare, mine = np.unique(rare[keep], return_inverse=True)[1], mine[keep]
    near = np.eye(len(sets), dtype=bool)
    order = np.argsort(rare, kind="stable")
    rare, mine = rare[order], mine[order]
    step = max(256, 16_000_000 // max(1, len(sets)))
    for low in range(0, int(rare[-1]) + 1 if len(rare) else 0, step):
        a, b = np.searchsorted(rare, [low, low + step])
        has = np.zeros((len(sets), min(step, int(rare[-1]) + 1 - low)), np.float32)
        has[mine[a:b], rare[a:b] - low] = 1
        near |= has @ has.T > 0
    return near & (den * np.minimum(sizes[:, None], sizes[None, :]) >= num * np.maximum(sizes[:, None], sizes[None, :]))


def _settled(link: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component in a symmetric matrix of links (with a true diagonal)."""
    n = len(link)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            seen, front = np.zeros(n, bool), np.array([i])
            seen[i] = True
            while len(front):
                reach = link[front].any(0) & ~seen
                seen |= reach
                front = np.flatnonzero(reach)
            label[seen] = i
    return label


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, num: int = 80, den: int = 100
) -> DataFrame:
    """One row for each input row: (doc_id, n_shingles, component_id).

    Texts are linked if den * |a & b| >= num * |a | b| for their sets of ``width``-word shingles (words are
    ``[^\\x20\\x09-\\x0D]+``, A-Z taken as a-z); component_id is the smallest id that links reach. A text with fewer
    words is one shingle; a null, empty or blank text has none and is its own component. Repeated rows and ties
    come back as often as they were given, with the same component; a null id is compared with nothing and has a
    null component. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    info = cut(described(docs, id_col, text_col, width))
    some = info.where("fp is not null and doc_id is not null")
    classes = some.groupBy("fp").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("keys", "sketch")], F.first("n_shingles").alias("n")
    )
    clusters = cut(components(candidates(classes, num, den)).withColumnRenamed("component", "cluster"))
    release(docs.sparkSession)  # the keys' shuffles are done with
    sized = clusters.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    tiles = F.greatest(F.ceil(F.count("*") / F.lit(TILE)), F.ceil(F.sum("n") / F.lit(TILE_SHINGLES))).cast("int")
    sizes = sized.groupBy("cluster").agg(tiles.alias("tiles"))
    members = clusters.join(sizes, "cluster").select(F.col("node").alias("doc_id"), "cluster", "tiles")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    joined = texts.join(members, "doc_id")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                _, _, row, h = words(buf, off)
                sets = shingles(h, row, part.num_rows, width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), packed_sets(sets)], ["doc_id", "cluster", "tiles", "shingles"]
                )

    sets = joined.select("doc_id", "text", "cluster", "tiles").mapInArrow(
        sets_of, "doc_id long, cluster long, tiles int, shingles binary"
    )
    tiled = in_tiles(sets, "doc_id").select("cluster", "ti", "tj", "doc_id", "shingles")

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in runs(batches, ["cluster", "ti", "tj"]):
            ids = table.column("doc_id").to_numpy()
            order = np.unique(ids, return_index=True)[1]  # repeated rows of one id count once, and ids ascend
            bags = unpacked_sets(table.column("shingles"))
            for i, k in _linked([bags[j] for j in order], num, den):
                a.append(ids[order[i]])
                b.append(ids[order[k]])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = (
        tiled.repartition("cluster", "ti", "tj").sortWithinPartitions("cluster", "ti", "tj").mapInArrow(links_of, "a long, b long")
    )
    joined_up = components(found)
    rooted = classes.select("fp", "rep").join(joined_up.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = rooted.select("fp", F.coalesce("component", "rep").alias("component"))
    named = info.select("doc_id", "n_shingles", "fp").join(rooted, "fp", "left")
    alone = F.when(F.col("doc_id").isNotNull() & F.col("fp").isNull(), F.col("doc_id"))
    return named.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(F.col("component"), alone)).alias("component_id"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` with their columns, one of each group of near-duplicates: the smallest id. Rows with a
    null id or no words stay; rows that repeat one id stay together."""
    found = near_duplicates(docs, id_col, text_col, width, num, den)
    gone = found.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    """Query: near-duplicate components of all documents, 2-word shingles at 0.8."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
