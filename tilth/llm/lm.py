"""Scoring texts with a weighted backoff automaton learned from the corpus.

Smoothed n-grams (to order 3, Dirichlet-smoothed counts) are arcs of an automaton. A state is a context seen in
training; an arc (context, word) carries the log-probability of the word there; where a state has no arc for the next
word, its failure arc leads to the shorter context at the cost of the context's backoff weight. A text is read once
from left to right, carrying the state and adding up log-probabilities.

No machine holds the whole automaton. Documents are dealt into blocks of bounded text size. Each block counts its own
n-grams and sends each, once, as a hash, towards one of many shards, which add the counts up and answer with the training
counts of just the n-grams asked for, which are all the arcs and states the block's texts can meet. Requests are routed
as in a radix sort: a block writes at most FAN messages, by the first digit of the hash; nodes merge the messages of at
most FAN blocks (adding up what they share) and write at most FAN messages by the next digit, until the messages of all
blocks for one range of hashes meet in a shard. Answers go the same way back. So a block costs the same number of messages
a hop whatever the number of blocks, and there are log_FAN(blocks) hops: one up to FAN blocks. A frequent n-gram is one
entry a message, so no shard is hot.

N-grams are identified by 64-bit hashes, of which 40 bits beside the first digit travel over one hop, 48 over two and all
beyond. In a shard they tell a bounded number of n-grams apart, so the chance of a clash for any one stays below 1e-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import parts_for
from ._text import byte_planes, flat, from_byte_planes, mix, runs, words

BLOCK_BYTES = 8 << 20
#: Messages that a block or node writes, and that a node merges, at most.
FAN = 256
#: Weight, in observations, of the shorter context's distribution at orders 2 and 3.
WEIGHTS = (8.0, 4.0)
_U = np.uint64
_START, _END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_FACTOR = _U(0x2545F4914F6CDD1D)


class Routes:
    """How the messages of ``blocks`` blocks are routed: over ``hops`` hops with ``fan`` digits each."""

    def __init__(self, blocks: int, most: int):
        self.hops = 1
        while most**self.hops < blocks:
            self.hops += 1
        self.fan = max(1, math.ceil(blocks ** (1 / self.hops) - 1e-9))
        while self.fan**self.hops < blocks:
            self.fan += 1
        self.width = min(8, 4 + self.hops) if self.hops < 3 else 8
        self.mask = _U((1 << 8 * self.width) - 1)

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The first digit of whole hashes."""
        return (keys >> _U(40)) % _U(self.fan)

    def digit(self, local: np.ndarray, hop: int) -> np.ndarray:
        """The digit that leads to ``hop`` (from 2), of what travels of the hashes."""
        return (mix(local) >> _U(8)) // _U(self.fan ** (hop - 2)) % _U(self.fan)

    def messages(self, local: np.ndarray, counts: np.ndarray, digit: np.ndarray, order: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(digit, keys, counts) of n-grams in order of digit and key: hashes as differences. Every digit has a message at
        order 0, as every one tells its part of the totals."""
        cuts = np.searchsorted(digit, np.arange(self.fan + 1))
        for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a or order == 0:
                yield d, byte_planes(np.diff(local[a:b], prepend=_U(0)), self.width), byte_planes(counts[a:b], 5)


class _Merged:
    """What a node's messages of one order ask: the distinct keys, their counts added up, and each message's places."""

    def __init__(self, table: pa.Table, routes: Routes):
        parts = [np.cumsum(from_byte_planes(k, routes.width), dtype=_U) for k in table.column("keys").to_pylist()]
        self.cuts = np.cumsum([0, *map(len, parts)]).tolist()
        keys = np.concatenate(parts)
        counts = np.concatenate([from_byte_planes(c, 5) for c in table.column("counts").to_pylist()]).astype(np.int64)
        by = np.argsort(keys, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = keys[by][1:] != keys[by][:-1]
        self.keys = keys[by][new]
        self.sums = np.add.reduceat(counts[by], np.flatnonzero(new)) if len(by) else counts
        self.at = np.empty(len(by), np.int64)
        self.at[by] = np.cumsum(new) - 1

    def answers(self, table: pa.Table, totals: np.ndarray, stats: tuple[int, int, int]) -> pa.RecordBatch:
        """``totals`` of the distinct keys, for each message in its own order."""
        each = totals[self.at] if len(self.at) else self.at
        back = [byte_planes(each[a:b], 5) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        cols = [table.column(c).combine_chunks() for c in ("node", "child", "order")]
        cols += [pa.array(back, pa.binary()), *(pa.array([x] * table.num_rows, pa.int64()) for x in stats)]
        return pa.RecordBatch.from_arrays(cols, ["node", "child", "order", "totals", "tokens", "types", "once"])


class _Block:
    """The n-grams of a block of texts, each order's distinct ones in one order that depends on nothing else."""

    def __init__(self, table: pa.Table, routes: Routes):
        buf, off = flat(table.column("text"))
        _, _, row, h = words(buf, off)
        n = table.num_rows
        self.lengths = np.bincount(row, minlength=n) + 1  # words and the end
        self.first = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1] + 1  # of each text's tokens; before it stands a start
        stream = np.empty(int(self.lengths.sum()) + n, _U)
        token = np.ones(len(stream), bool)
        token[self.first - 1] = False
        last = np.zeros(len(stream), bool)
        last[self.first + self.lengths - 1] = True
        stream[~token] = _START
        stream[last] = _END
        stream[token & ~last] = h
        learn = np.repeat(table.column("learn").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), self.lengths + 1)

        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.at: list[np.ndarray] = []  # each place's n-gram, or -1
        ids, context, have = None, None, token
        for order in range(3):
            places = np.flatnonzero(have)
            if order == 0:
                distinct, back = np.unique(stream, return_inverse=True)
                ids, keys = back, mix(distinct ^ _FACTOR)
                self.words, self.start = keys, int(np.searchsorted(distinct, _START)) if n else -1
                at, size = back, len(distinct)
            else:
                code = context[places - 1] * len(self.words) + ids[places]
                distinct, back = np.unique(code, return_inverse=True)
                left, right = np.divmod(distinct, max(1, len(self.words)))
                keys = mix(mix(self.keys[-1][left] * _FACTOR + _U(order)) + self.words[right])
                at = np.full(len(stream), -1)
                at[places] = back
                size = len(distinct)
            self.keys.append(keys)
            self.at.append(at)
            self.counts.append(np.bincount(at[places][learn[places]], minlength=size))
            context = at
            have = have & np.concatenate(([False], have[:-1])) if order else token
        self.routes = routes
        self.order = [np.lexsort((k & routes.mask, routes.first(k))) for k in self.keys]

    def requests(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(order, first digit, keys, counts)."""
        for order, (keys, counts, by) in enumerate(zip(self.keys, self.counts, self.order, strict=True)):
            for d, k, c in self.routes.messages(keys[by] & self.routes.mask, counts[by], self.routes.first(keys[by]), order):
                yield order, d, k, c

    def answered(self, order: int, totals: np.ndarray) -> np.ndarray:
        by = self.order[order]
        if len(totals) != len(by):
            raise RuntimeError("a block's n-grams changed between counting and scoring")
        out = np.empty(len(by), np.int64)
        out[by] = totals
        return out


_ASKED, _ANSWERED = "node long, child long, order long, keys binary, counts binary", "node long, child long, order long, totals binary, tokens long, types long, once long"


def _asked(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    while part := list(islice(rows, 256)):
        cols = [pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, ["node", "child", "order", "keys", "counts"])


def _totals(asked: DataFrame, n: int, routes: Routes, hop: int = 1) -> DataFrame:
    """Answers (node, child, order, totals, tokens, types, once) to messages (node, child, order, keys, counts): the
    counts of their keys over all messages of a node, and the node's share in the corpus totals."""
    fan = routes.fan

    if hop == routes.hops:

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, ["node", "order"]):
                merged = _Merged(table, routes)
                words = table.column("order")[0].as_py() == 0
                stats = (int(merged.sums.sum()), int((merged.sums > 0).sum()), int((merged.sums == 1).sum())) if words else (0, 0, 0)
                yield merged.answers(table, merged.sums, stats)

        return asked.repartition(n, "node").sortWithinPartitions("node", "order").mapInArrow(settle, _ANSWERED)

    grouped = asked.withColumn("above", F.floor(F.col("child") / F.lit(fan)).cast("long")).repartition(n, "node", "above")

    def passed_on(merged: _Merged) -> tuple[np.ndarray, np.ndarray]:
        digit = routes.digit(merged.keys, hop + 1)
        by = np.lexsort((merged.keys, digit))
        return by, digit[by]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for table in runs(batches, ["node", "above", "order"]):
                node, above, order = (table.column(c)[0].as_py() for c in ("node", "above", "order"))
                merged = _Merged(table, routes)
                by, digit = passed_on(merged)
                for d, k, c in routes.messages(merged.keys[by], merged.sums[by], digit, order):
                    yield node * fan + d, above, order, k, c

        yield from _asked(rows())

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        """What came back to a node, dealt to those who asked it."""
        out, asked_order, back_order = [], left.column("order").to_numpy(), right.column("order").to_numpy()
        for order in np.unique(asked_order).tolist():
            table = left.take(np.flatnonzero(asked_order == order))
            merged = _Merged(table, routes)
            answers = right.take(np.flatnonzero(back_order == order)).sort_by("node")
            by, _ = passed_on(merged)
            totals = np.empty(len(by), np.int64)
            totals[by] = np.concatenate([from_byte_planes(t, 5) for t in answers.column("totals").to_pylist()]) if len(by) else 0
            out.append(merged.answers(table, totals, tuple(int(answers.column(c).to_numpy().sum()) for c in ("tokens", "types", "once"))))
        return pa.Table.from_batches(out)

    above = _totals(grouped.sortWithinPartitions("node", "above", "order").mapInArrow(merge, _ASKED), n, routes, hop + 1)
    back = above.withColumn("below", F.floor(F.col("node") / F.lit(fan)).cast("long")).repartition(n, "below", "child")
    return grouped.groupBy("node", "above").cogroup(back.groupBy("below", "child")).applyInArrow(deal, _ANSWERED)


def traverse(block: _Block, counts: list[np.ndarray], tokens: int, once: int, n_texts: int, weights=WEIGHTS) -> np.ndarray:
    """log10 probability of each of the block's texts: all texts step through the automaton side by side."""
    rare = once + 1  # observations set aside for the one class of unknown words
    p1 = np.where(counts[0] > 0, counts[0], rare) / (tokens + rare)
    word, seen1 = block.at[0], counts[0] > 0
    before = np.maximum(0, np.arange(len(word)) - 1)
    context1 = counts[0].copy()
    if block.start >= 0:
        context1[block.start] = n_texts

    def arcs(order: int, low: np.ndarray, total: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of an order's arcs: whether each exists and its probability; and the backoff weight of each context."""
        place = np.full(len(block.keys[order]), 0)
        here = np.flatnonzero(block.at[order] >= 0)
        place[block.at[order][here]] = here  # any place of the n-gram: all have the same context and word
        head = total[block.at[order - 1][before[place]]]
        return counts[order] > 0, (counts[order] + weight * low[place]) / (head + weight), weight / (total + weight)

    has2, p2, back1 = arcs(1, p1[word], context1, weights[0])
    two = np.where(block.at[1] >= 0, p2[np.maximum(block.at[1], 0)] if len(p2) else 0.0, 1.0)
    has3, p3, back2 = arcs(2, two, counts[1], weights[1])
    l1, l2, l3, b1, b2 = (np.log10(x) for x in (p1, p2, p3, back1, back2))

    by = np.argsort(-block.lengths, kind="stable")
    first, lengths = block.first[by], block.lengths[by]
    score = np.zeros(len(by))
    level = np.ones(len(by), np.int8)  # order of the state's context: all begin in the start's state
    if n_texts == 0:
        level[:] = 0
    alive = len(by)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        while lengths[alive - 1] <= step:
            alive -= 1
        at = first[:alive] + step
        state, gained = level[:alive], score[:alive]
        w, two_, three = word[at], block.at[1][at], block.at[2][at]
        deep = state == 2
        if deep.any():
            hit = deep & has3[three]
            gained[hit] += l3[three[hit]]
            fail = deep & ~hit
            gained[fail] += b2[block.at[1][at[fail] - 1]]
        else:
            hit = deep
        middle = (state >= 1) & ~hit
        got = middle & has2[two_]
        gained[got] += l2[two_[got]]
        fail = middle & ~got
        gained[fail] += b1[word[at[fail] - 1]]
        root = ~(hit | got)
        gained[root] += l1[w[root]]
        level[:alive] = np.where(has2[two_], 2, np.where(seen1[w], 1, 0))
    out = np.empty(len(by))
    out[by] = score
    return out


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) for each input row.

    ``learn`` is a column expression: whether to learn from the row (null: not). Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z taken as a-z, then one end. base_score is the add-one unigram log10 probability,
    score the automaton's. A null or empty text is one end. Null ids and repeated rows come back as they are, repeated
    rows are learned as often as they stand; other columns are ignored; an empty table gives no rows.
    """
    n = parts_for(docs, F.octet_length(F.col(text_col)), block_bytes)
    routes = Routes(n, fan)
    dealt = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).alias("block"),
    ).repartition(n, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["block"]):
            block = table.column("block")[0].as_py()
            yield from _asked((d, block, order, k, c) for order, d, k, c in _Block(table, routes).requests())

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, routes)
        right = right.sort_by([("order", "ascending"), ("node", "ascending")])
        order = right.column("order").to_numpy()
        cuts = np.searchsorted(order, np.arange(4)).tolist()
        counts = []
        for o in range(3):
            parts = [from_byte_planes(t, 5) for t in right.column("totals").slice(cuts[o], cuts[o + 1] - cuts[o]).to_pylist()]
            counts.append(block.answered(o, np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)))
        tokens, types, once = (int(right.column(c).to_numpy().sum()) for c in ("tokens", "types", "once"))
        if block.start >= 0:  # the start is no token; as a context it counts the texts learned from, which is told by the ends
            counts[0][block.start] = 0
        ends = counts[0][block.at[0][block.first + block.lengths - 1]]
        n_texts = int(ends[0]) if len(ends) else 0
        token = np.ones(len(block.at[0]), bool)
        token[block.first - 1] = False
        c = np.where(token, counts[0][block.at[0]], 0)
        base = np.where(token, np.log10((c + 1.0) / (tokens + types + 1.0)), 0.0)
        sums = lambda x: np.add.reduceat(x, block.first - 1)
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "learned": left.column("learn"),
                "n_tokens": pa.array(block.lengths.astype(np.int64)),
                "n_known": pa.array(sums((c > 0).astype(np.int64))),
                "train_tokens": pa.array([tokens] * left.num_rows, pa.int64()),
                "base_score": pa.array(sums(base)),
                "score": pa.array(traverse(block, counts, tokens, once, n_texts)),
            }
        )

    asked = dealt.sortWithinPartitions("block").mapInArrow(ask, _ASKED)
    answers = _totals(asked, n, routes).withColumnRenamed("child", "block").repartition(n, "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        answer,
        "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: scores of all documents, learned from those whose crc32(doc_id) mod 7 is not 2."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    rows = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold != 2)
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("held_out")
    return rows.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
