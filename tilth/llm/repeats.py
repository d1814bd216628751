"""Repeated passages by common-prefix intervals of an enhanced suffix array.

A passage is a byte string of a given length; it goes wherever it stands twice or more in the corpus. Each window (a
little shorter than a passage) has one anchor: the 64-byte gram in it of least hash, the leftmost if several. Equal
windows have equal anchors at equal places, so repeats are only sought among suffixes that begin at equal anchors, each
with as much text to the left and right as a passage round the anchor can reach.

Suffixes with one context (anchor and all of that text) are one class, and a class of two or more is a repeat as it
stands. What differs is sorted into a suffix array per anchor. A stack scan of its common prefixes yields the intervals
of the prefix tree; within each, the same scan over the texts to the left, in their own sorted order, yields the groups
whose left extensions differ just there, and of these the groups that spread over more than one branch to the right are
the maximal repeats, each with all its occurrences, not just sorted neighbours. Spans are the union of the occurrences.
An anchor with more distinct contexts than one task should hold gets the same spans from the hashes of its windows, which
need no group in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._cluster import parts_for
from ._text import _BASE_INV, _TABLE, WHITE, flat, mix, powers, runs, slices

GRAM, LENGTH = 64, 400
#: A passage shared between documents: more than so many words, in so many bytes at least.
WORDS, SHARED = 50, 300
BLOCK_BYTES = 8 << 20
#: Distinct contexts of an anchor up to which one task sorts them.
MOST_CONTEXTS = 20_000
_U = np.uint64


class _Hashes:
    """Hashes of any spans of a buffer."""

    def __init__(self, buf: np.ndarray):
        self.acc = np.zeros(len(buf) + 1, _U)
        np.cumsum(_TABLE[buf] * powers(len(buf))[:-1], out=self.acc[1:])
        self.inverse = powers(len(buf), _BASE_INV)

    def grams(self, size: int) -> np.ndarray:
        """For every ``size`` bytes, 32 bits of a hash above their place."""
        key = self.acc[size:] - self.acc[:-size]
        key *= self.inverse[: len(key)]
        key *= _U(0xD1342543DE82EF95)
        key &= _U(0xFFFFFFFF00000000)
        key |= np.arange(len(key), dtype=_U)
        return key

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.acc[end] - self.acc[start]) * self.inverse[start] ^ ((end - start).astype(_U) * _U(0xD6E8FEB86659FD93)))


def anchors(buf: np.ndarray, off: np.ndarray, hashes: _Hashes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows of ``length`` bytes within rows, and their rows."""
    n, reach = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none
    grams = hashes.grams(gram)
    key = np.full(-(-n // reach) * reach + reach, np.iinfo(np.uint64).max, _U)
    key[: len(grams)] = grams
    table = key.reshape(-1, reach)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    sizes = np.diff(off)
    inside = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[:n])
    least = np.minimum(behind[start], ahead[start + reach - 1]) & _U(0xFFFFFFFF)
    at = least.astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return at, np.searchsorted(off, at, side="right") - 1


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of a suffix array whose neighbours share lcp[i] (of i and i+1)."""
    out, stack = [], []
    for i, x in enumerate([*lcp.tolist(), -1]):
        low = i
        while stack and stack[-1][0] > x:
            size, low = stack.pop()
            out.append((size, low, i))
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, low))
    return out


def _shared(rows: list[bytes], order: list[int], width: int) -> np.ndarray:
    """Bytes that neighbours in ``order`` share from the beginning."""
    size = np.array([len(rows[i]) for i in order])
    grid = np.zeros((len(order), width), np.uint8)
    for k, i in enumerate(order):
        grid[k, : size[k]] = np.frombuffer(rows[i], np.uint8)
    differ = grid[1:] != grid[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    return np.minimum(first, np.minimum(size[1:], size[:-1]))


class _Least:
    """Minima of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (step := 1 << len(self.rows)) <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(values) - step + 1], last[step // 2 : len(values) - step // 2 + 1]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(values[a:b]), b > a."""
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.rows[k][a[here]], self.rows[k][b[here] - (1 << int(k))])
        return out


class Suffixes:
    """The enhanced suffix array of suffixes that begin alike, with the order of what stands before them.

    ``left`` holds the text before each suffix, reversed."""

    def __init__(self, left: list[bytes], right: list[bytes], length: int):
        n = len(right)
        by_right = sorted(range(n), key=right.__getitem__)
        by_left = sorted(range(n), key=left.__getitem__)
        lcp = _shared(right, by_right, max(map(len, right)))
        self.length, self.intervals = length, intervals(lcp)
        self.least_left, self.least_right = _Least(_shared(left, by_left, max(1, max(map(len, left))))), _Least(lcp)
        self.place, self.rank = np.empty(n, np.int64), np.empty(n, np.int64)
        self.place[by_left], self.rank[by_right] = np.arange(n), np.arange(n)
        self.by_right, self.by_left = np.array(by_right), np.array(by_left)

    def groups(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shared right, members, where each group begins, shared left of neighbours within groups or -1) for each
        interval of the prefix tree: its groups are the members that share ``length`` bytes in all, each with some other
        one, in order of their left texts. A group whose members all stand in one branch of the interval reaches further
        right and is left to that branch."""
        for size, a, b in self.intervals:
            order = np.sort(self.place[self.by_right[a : b + 1]])
            near = self.least_left(order[:-1], order[1:])
            ok = near >= max(0, self.length - size)
            if not ok.any():
                continue
            members, near = self.by_left[order], np.where(ok, near, -1)
            first = np.flatnonzero(np.concatenate(([True], ~ok)))
            ranks = self.rank[members]
            low, high = np.minimum.reduceat(ranks, first), np.maximum.reduceat(ranks, first)
            many = np.flatnonzero(high > low)
            diverse = many[self.least_right(low[many], high[many]) == size]
            if not len(diverse):
                continue
            if len(diverse) < len(first):
                sizes = np.diff(np.append(first, len(order)))
                keep = np.repeat(np.isin(np.arange(len(first)), diverse), sizes)
                members, near = members[keep], np.append(near, -1)[keep][:-1]
                first = np.concatenate(([0], np.cumsum(sizes[diverse])[:-1]))
            yield size, members, first, near

    def maximal(self) -> Iterator[tuple[np.ndarray, int, int]]:
        """(members, shared left, shared right) of every maximal repeat: groups within groups by what they share to the
        left, whose extensions differ on both sides."""
        for size, members, first, near in self.groups():
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(members)], strict=True):
                for shared, p, q in intervals(near[i : j - 1]):
                    at = self.rank[members[i + p : i + q + 1]]
                    if self.least_right(at.min(keepdims=True), at.max(keepdims=True))[0] == size:
                        yield members[i + p : i + q + 1], shared, size


def repeat_groups(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, shared left, shared right) of the maximal repeats of ``length`` bytes or more."""
    return Suffixes(left, right, length).maximal()


def reaches(left: list[bytes], right: list[bytes], owner: np.ndarray, length: int, passage: int) -> tuple[np.ndarray, ...]:
    """For each suffix: how far left and right repeats of ``length`` bytes cover it (0, 0: not), and the same of the
    longest repeat of ``passage`` (at most ``length``) bytes or more with a suffix of another owner."""
    n = len(right)
    out = tuple(np.zeros(n, np.int64) for _ in range(4))
    l, r, pl, pr = out  # noqa: E741
    if n == 2:  # the one pair is the one group
        x, y = _common(*left), _common(*right)
        if x + y >= length:
            l[:], r[:] = x, y
        if x + y >= passage and owner[0] != owner[1]:
            pl[:], pr[:] = x, y
        return out
    array = Suffixes(left, right, passage)
    for size, members, first, near in array.groups():
        close = np.maximum(np.concatenate(([-1], near)), np.concatenate((near, [-1])))
        far = members[close >= length - size]
        l[far], r[far] = np.maximum(l[far], close[close >= length - size]), np.maximum(r[far], size)
        who, at, k = owner[members], array.place[members], np.arange(len(members))
        begins = np.isin(k, first)
        other = begins | np.concatenate(([True], who[1:] != who[:-1]))
        block = np.flatnonzero(other)  # members of one owner and group that stand together: their neighbours are others'
        of = np.cumsum(other) - 1
        before, after = block[of] - 1, np.append(block[1:], len(members))[of]
        best = np.full(len(members), -1)
        for near_one, ok in ((before, ~begins[block[of]]), (after, ~np.append(begins, True)[after])):
            if ok.any():
                low, high = np.minimum(at[k[ok]], at[near_one[ok]]), np.maximum(at[k[ok]], at[near_one[ok]])
                best[ok] = np.maximum(best[ok], array.least_left(low, high))
        more = (best >= 0) & (best + size > pl[members] + pr[members])
        pl[members[more]], pr[members[more]] = best[more], size
    return out


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings share from the beginning."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n) if n else np.zeros(0, bool)
    return int(differ.argmax()) if differ.any() else n


def _whole_words(text: bytes, a: int, b: int) -> int:
    """Words of text[a:b] that it doesn't cut."""
    n = len(text[a:b].split())
    white = b" \t\n\x0b\x0c\r"
    n -= a > 0 and text[a] not in white and text[a - 1] not in white
    n -= b < len(text) and text[b] not in white and text[b - 1] not in white
    return max(0, n)


def _described(docs: DataFrame, length: int, window: int) -> DataFrame:
    """(h, c, rid, pos, before, after, words): every anchor, its context's hash, extent and whole words."""
    gram = min(GRAM, window)
    names = ["h", "c", "rid", "pos", "before", "after", "words"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                hashes = _Hashes(buf)
                at, row = anchors(buf, off, hashes, window, gram)
                low, high = np.maximum(at - (length - gram), off[row]), np.minimum(at + length, off[row + 1])
                h = hashes(at, at + gram)
                c = mix(hashes(low, high) ^ ((at - low).astype(_U) << _U(32)))
                white = WHITE[buf]
                begins = ~white
                begins[1:] &= white[:-1]
                edge = off[1:-1][off[1:-1] < len(buf)]
                begins[edge] = ~white[edge]
                words = np.concatenate(([0], np.cumsum(begins)))
                cut = (high < off[row + 1]) & ~white[np.minimum(high, len(buf) - 1)] & ~white[high - 1] if len(at) else np.zeros(0, bool)
                rid = part.column(0).to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
                cols = [h.view(np.int64), c.view(np.int64), rid, at - off[row], at - low, high - at, np.maximum(words[high] - words[low] - cut, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k, safe=False) for x, k in zip(cols, kinds, strict=True)], names)

    return docs.select("rid", "text").mapInArrow(run, "h long, c long, rid long, pos long, before int, after int, words int")


class _Search:
    """The repeats of a table: its rows dealt into blocks, classes of equal contexts, and what differs."""

    def __init__(self, docs: DataFrame, length: int, shared: int, id_col: str, text_col: str, most_contexts: int, whole: bool = False):
        self.length, self.shared, self.most = length, min(shared, length), most_contexts
        self.gram = min(GRAM, self.shared)
        self.n = parts_for(docs, F.octet_length(F.col(f"`{text_col}`")), BLOCK_BYTES)
        name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
        keyed = docs.select(name.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(name, text).alias("rid"))
        self.block = F.pmod(F.col("rid"), F.lit(self.n)).alias("block")
        self.dealt = keyed.select("doc_id", "text", "rid", self.block).repartition(self.n, "block")
        # the conditions on both always hold; stated here, the joins add none of their own, and uses share one exchange
        self.found = _described(keyed, length, self.shared).where("h is not null and c is not null")
        # the class's first member, and whether another document has it too
        one = F.min(F.struct("rid", "pos", "before", "after", "words"))
        classes = self.found.groupBy("h", "c").agg(F.count("*").alias("n"), one.alias("one"), F.max("rid").alias("last"))
        classes = classes.where("n > 0 and one is not null and last is not null")  # as above
        self.classes = classes.select("h", "c", "n", "one.*", (F.col("last") != F.col("one.rid")).alias("across"))
        several = self.classes.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
        # classes that others differ from; with whole, also those that only repeat themselves
        joined = self.classes.join(several, "h", "left").withColumn("contexts", F.coalesce("contexts", F.lit(1))).where("contexts > 1 or n > 1") if whole else self.classes.join(several, "h")
        self.need = joined.select("h", "c", "n", "contexts", "rid", "pos", "before", "after", self.block).repartition(self.n, "block")

    def contexts(self, need: DataFrame) -> DataFrame:
        """``need`` with each context's text, and with the hashes of its windows where there are too many."""
        most, length, shared, gram = self.most, self.length, self.shared, self.gram

        def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
            buf, off = flat(left.column("text"))
            rows = dict(zip(left.column("rid").to_pylist(), range(left.num_rows), strict=True))
            zero = np.array([off[rows[r]] for r in right.column("rid").to_pylist()], np.int64)
            at = zero + right.column("pos").to_numpy()
            low, high = at - right.column("before").to_numpy(), at + right.column("after").to_numpy()
            wide = right.column("contexts").to_numpy() > most
            data = buf.tobytes()
            text = [None if w else data[x:y] for x, y, w in zip(low.tolist(), high.tolist(), wide.tolist(), strict=True)]
            table = right.select(["h", "c", "n", "rid", "pos", "before"]).append_column("text", pa.array(text, pa.binary()))
            windows: list = [None] * len(at)
            if wide.any():
                hashes = _Hashes(buf)
                for k in np.flatnonzero(wide):
                    s = np.arange(low[k], high[k] - length + 1)
                    start, end = _word_windows(buf[low[k] : high[k]], int(at[k] - low[k]), gram, shared)
                    hs = [hashes(s, s + length).view(np.int64), mix(hashes(low[k] + start, low[k] + end)).view(np.int64)]
                    first, size = np.concatenate((s, low[k] + start)) - zero[k], np.concatenate((np.full(len(s), length), np.zeros(len(start), np.int64)))
                    windows[k] = [{"w": w, "a": a, "size": z} for w, a, z in zip(np.concatenate(hs).tolist(), first.tolist(), size.tolist(), strict=True)]
            kind = pa.list_(pa.struct([("w", pa.int64()), ("a", pa.int64()), ("size", pa.int64())]))
            return table.append_column("windows", pa.array(windows, kind))

        schema = "h long, c long, n long, rid long, pos long, before int, text binary, windows array<struct<w:long,a:long,size:long>>"
        return self.dealt.groupBy("block").cogroup(need.groupBy("block")).applyInArrow(cut_out, schema)

    def suffixes(self) -> DataFrame:
        return self.contexts(self.need.where(F.col("contexts") <= self.most)).select("h", "c", "n", "rid", "pos", "before", "text").repartition(self.n, "h").sortWithinPartitions("h")


def _word_windows(buf: np.ndarray, at: int, gram: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of WORDS + 1 whole words that hold the gram at ``at``, of ``shared`` bytes or more."""
    inside = np.concatenate(([0], (~WHITE[buf]).astype(np.int8), [0]))
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    start, end = start[: max(0, len(start) - WORDS)], end[WORDS:]
    ok = (start <= at) & (end >= at + gram) & (end - start >= shared)
    return start[ok], end[ok]


def _split(table: pa.Table) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Contexts, and of each the reversed text before the anchor and the text from it on."""
    text, before = table.column("text").to_pylist(), table.column("before").to_pylist()
    return text, [t[:x][::-1] for t, x in zip(text, before, strict=True)], [t[x:] for t, x in zip(text, before, strict=True)]


def maximal_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS
) -> DataFrame:
    """(group_id, doc_id, start, length): all occurrences, in bytes, of each maximal repeat of ``length`` bytes or more.

    Maximal is meant within what an anchor reaches, ``length`` bytes and no more to either side; a longer passage comes
    as several overlapping groups. A group's passage has its anchor in itself, so every place in the table that says it
    is listed, once; a row given twice says it twice. Texts without repeats, null and empty ones have no rows. Of an anchor
    with more than ``most_contexts`` contexts the groups are single windows. Null ids come back as they are; other columns
    are ignored; an empty table gives no rows."""
    search = _Search(docs, length, length, id_col, text_col, most_contexts, whole=True)
    gram = search.gram

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["h"]):
            text, left, right = _split(table)
            before, cs = table.column("before").to_pylist(), table.column("c").to_pylist()
            rows = [(text[k], cs[k], before[k], len(text[k]) - before[k]) for k in np.flatnonzero(table.column("n").to_numpy() > 1) if len(text[k]) >= length]
            for members, x, y in repeat_groups(left, right, length) if len(text) > 1 else ():
                m = members[0]
                passage = np.frombuffer(text[m], np.uint8)[before[m] - x : before[m] + y]
                # else the passage is found by an anchor of its own, and reaches further than this one
                if x in anchors(passage, np.array([0, len(passage)]), _Hashes(passage), length, gram)[0]:
                    rows += [(passage.tobytes(), cs[k], x, y) for k in members.tolist()]
            cols = list(zip(*[(xxh3_64_intdigest(p) - (1 << 63), *r) for p, *r in rows], strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["group_id", "c", "x", "y"])

    groups = search.suffixes().mapInArrow(compare, "group_id long, c long, x long, y long")
    places = search.found.select("c", "rid", "pos").join(groups, "c").select("group_id", "rid", (F.col("pos") - F.col("x")).alias("start"), (F.col("x") + F.col("y")).alias("length"))
    wide = search.need.where(F.col("contexts") > most_contexts)
    windows = search.contexts(wide).select("c", "pos", F.explode("windows").alias("w")).where(F.col("w.size") > 0).select(F.col("w.w").alias("group_id"), "c", (F.col("pos") - F.col("w.a")).alias("x"))
    single = search.found.select("c", "rid", "pos").join(windows, "c").select("group_id", "rid", (F.col("pos") - F.col("x")).alias("start"))
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(name.cast("long").alias("doc_id"), F.xxhash64(name, text).alias("rid"))
    single = single.distinct().join(rows, "rid")
    twice = single.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    windows = single.join(twice, "group_id").select("group_id", "doc_id", "start", F.lit(length).cast("long").alias("length"))
    return places.distinct().join(rows, "rid").select("group_id", "doc_id", "start", "length").unionByName(windows)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS, shared: int = SHARED
) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, shared_words, kept binary) for each input row: the maximal runs
    of UTF-8 bytes covered by a ``length``-byte string that also starts anywhere else in the table, and what is left
    without them. shared_words is the words of the longest passage of ``shared`` bytes or more in a repeat group
    with another document (as far as one anchor reaches), 0 if those are not over WORDS.

    Matches never cross rows and are judged on the input. A null or empty text has 0 bytes and no spans. A row given
    twice repeats itself, but shares nothing with another document. Null ids come back as they are; other columns are
    ignored; an empty table gives no rows.
    """
    search = _Search(docs, length, shared, id_col, text_col, most_contexts)
    least, block, n, dealt = search.shared, search.block, search.n, search.dealt

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for table in runs(batches, ["h"]):
            text, left, right = _split(table)
            before, rid = table.column("before").to_numpy(), table.column("rid").to_numpy()
            l, r, x, y = reaches(left, right, rid, length, least)
            words = np.zeros(len(text), np.int64)
            for k in np.flatnonzero(x + y):
                words[k] = _whole_words(text[k], before[k] - x[k], before[k] + y[k])
            words[words <= WORDS] = 0
            hit = np.flatnonzero((r > 0) | (words > 0))
            if len(hit):
                pos = table.column("pos").to_numpy()[hit]
                out.append((rid[hit], pos - l[hit], pos + r[hit], words[hit]))
            if len(out) > 2000:
                yield _spans(out)
                out = []
        yield _spans(out)

    def _spans(out: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rid", "a", "b", "words"])

    covers = F.col("before") + F.col("after") >= length
    tells = F.when(F.col("across") & (F.col("words") > WORDS) & (F.col("before") + F.col("after") >= least), F.col("words")).otherwise(0)
    whole = search.classes.where("n > 1").withColumn("tells", tells).where(covers | (F.col("tells") > 0)).select("h", "c", "tells")
    cover = search.found.select("h", "c", "rid", "pos", "before", "after").join(whole, ["h", "c"]).select(
        "rid", F.when(covers, F.col("pos") - F.col("before")).otherwise(F.col("pos")).alias("a"), F.when(covers, F.col("pos") + F.col("after")).otherwise(F.col("pos")).alias("b"), F.col("tells").cast("long").alias("words")
    )
    cover = cover.unionByName(search.suffixes().mapInArrow(compare, "rid long, a long, b long, words long"))

    wide = search.need.where(F.col("contexts") > most_contexts)
    windows = search.contexts(wide).select("rid", F.explode("windows").alias("x")).select(F.col("x.w").alias("w"), F.col("x.size").alias("size"), "rid", F.col("x.a").alias("a")).distinct()
    twice = windows.groupBy("w", "size").agg(F.count("*").alias("n"), (F.min("rid") != F.max("rid")).alias("across"))
    twice = twice.where("(size > 0 and n > 1) or (size = 0 and across)").select("w", "size")
    cover = cover.unionByName(windows.join(twice, ["w", "size"]).select("rid", "a", (F.col("a") + F.col("size")).alias("b"), F.when(F.col("size") == 0, WORDS + 1).otherwise(0).cast("long").alias("words")))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        buf, off = flat(left.column("text"))
        by = np.lexsort((right.column("a").to_numpy(), right.column("rid").to_numpy()))
        rid, a, b, w = (right.column(c).to_numpy()[by] for c in ("rid", "a", "b", "words"))
        cuts = {int(rid[i]): (i, j) for i, j in _groups(rid)}
        spans, kept, words = [], [], []
        for lo, hi, key in zip(off[:-1].tolist(), off[1:].tolist(), left.column("rid").to_pylist(), strict=True):
            mine: list[dict] = []
            i, j = cuts.get(key, (0, 0))
            words.append(int(w[i:j].max()) if j > i else 0)
            some = np.flatnonzero(b[i:j] > a[i:j]) + i
            if len(some):
                first, high = a[some], np.maximum.accumulate(b[some])
                new = np.flatnonzero(np.concatenate(([True], first[1:] > high[:-1])))
                ends = high[np.concatenate((new[1:] - 1, [len(some) - 1]))]
                mine = [{"start": x, "end": y} for x, y in zip(first[new].tolist(), ends.tolist(), strict=True)]
            at, parts = lo, []
            for s in mine:
                parts.append(buf[at : lo + s["start"]].tobytes())
                at = lo + s["end"]
            parts.append(buf[at:hi].tobytes())
            spans.append(mine)
            kept.append(b"".join(parts))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_bytes": pa.array(np.diff(off), pa.int64()),
                "spans": pa.array(spans, kind),
                "shared_words": pa.array(words, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    covered = cover.select("rid", "a", "b", "words", block).repartition(n, "block")
    return dealt.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(
        apply, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, shared_words long, kept binary"
    )


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values, as (first, end)."""
    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents without the bytes that 400-byte repeats cover."""
    rows = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shared_words"
    )
