"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The two models are compared by log-likelihood ratio, character by character, on every run of token characters. In a run,
the stretches whose ratios add up highest are found, so that a secret shows in a long path or beside a word as it does
alone; a stretch counts if its whole ratio, less a toll for each character, reaches a threshold, and it then reaches out
to the next separator. The models are trained on labelled samples: strings that the patterns find, and seeded random
strings of the usual alphabets, are positive; runs in the same texts that are made as words and identifiers are made
are negative, as are those words joined by the usual separators. Texts for training are a bounded sample (the
``SAMPLE_DOCS`` ids of smallest hash); only their character-pair counts leave the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import edges, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SAMPLE_DOCS = 4000
#: Characters that a stretch, and so a run, must have at least: shorter strings say too little.
LEAST_RUN = 16
#: What has fewer distinct characters is a rule or a filler, no secret.
LEAST_DISTINCT = 6
#: Toll on each character of a stretch, and the ratio beyond it from which a stretch is taken as random, in nats.
TOLL, THRESHOLD = 0.5, 10.0


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_AZ, _az, _09 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_HEX, _ACCESS, _RUN = _set("abcdef" + _09), _set(_AZ + _09), _set(_AZ + _az + _09 + "+/_=-")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _base(buf: np.ndarray, off: np.ndarray, texts) -> list[tuple[int, int, int, int, int]]:
    """(row, start, end, kind, value start) of the fixed patterns' matches, in bytes of the slice. ``texts(row)`` is a row's text."""
    found = []
    raw = _LOWER[buf].tobytes()
    rows: set[int] = set()
    for word in _WORDS:
        at = raw.find(word)
        while at >= 0:
            row = int(np.searchsorted(off, at, side="right")) - 1
            rows.add(row)
            at = raw.find(word, int(off[row + 1]))
    for row in sorted(rows):
        text, at, seen = texts(row), int(off[row]), 0
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                at += len(text[seen : m.start()].encode())
                size = len(text[m.start() : m.end()].encode())
                found.append((row, at, at + size, 0, at + size - (m.end(2) - m.start(2))))
                seen, at = m.end(), at + size
    start, end, row = edges(_ACCESS[buf], off)
    for a, b, r in zip(*(x[end - start >= 18].tolist() for x in (start, end, row)), strict=True):
        k = buf[a:b].tobytes().find(b"AKIA")
        if k >= 0 and b - a - k >= 18:
            found.append((r, a + k, b, 1, a + k))
    start, end, row = edges(_HEX[buf], off)
    found += [(r, a, b, 2, a) for a, b, r in zip(*(x[end - start >= 16].tolist() for x in (start, end, row)), strict=True)]
    return found


def _runs(buf: np.ndarray, off: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the runs of token characters of at least ``least`` bytes."""
    start, end, row = edges(_RUN[buf], off)
    long = end - start >= least
    yield from zip(row[long].tolist(), start[long].tolist(), end[long].tolist(), strict=True)


def _free_runs(buf: np.ndarray, off: np.ndarray, taken: list[tuple], least: int) -> Iterator[tuple[int, int, int]]:
    """Those runs that touch no taken span."""
    spans = sorted((a, b) for _, a, b, _, _ in taken)
    highs = np.maximum.accumulate([b for _, b in spans]) if spans else np.zeros(0, np.int64)
    lows = np.array([a for a, _ in spans], np.int64)
    for r, a, b in _runs(buf, off, least):
        k = int(np.searchsorted(lows, b))  # spans that start before b; the furthest end among them tells of a touch
        if k == 0 or highs[k - 1] <= a:
            yield r, a, b


_PIECE = rb"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
_ORDINARY = re.compile(_PIECE + rb"(?:[A-Z][a-z]{2,}|[_/=+-]+" + _PIECE + rb")*[_/=+-]*")


def ordinary(s: bytes) -> bool:
    """Whether a run is made as words and identifiers are: pieces of small letters, capitals or digits alone, each at most
    with one capital before it, joined by separators or by capitals with two small letters or more after them."""
    return _ORDINARY.fullmatch(s) is not None


def _pairs(strings: list[bytes]) -> np.ndarray:
    """Counts of character pairs, 0 standing for the start and for the end."""
    out = np.zeros((128, 128))
    if strings:
        codes = np.frombuffer(b"\0".join(strings), np.uint8)
        np.add.at(out, (np.concatenate(([0], codes)), np.concatenate((codes, [0]))), 1)
    return out


def _joined(words: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Counts of the pairs at the joints of ``words``' pieces, were they joined as identifiers and paths are."""
    ends, begins = words[:, 0].copy(), words[0].copy()
    ends[0] = begins[0] = 0
    total = begins.sum()
    out = np.zeros_like(words)
    if total:
        for sep in b"_-/=+":
            out[:, sep] += share * ends
            out[sep] += share * begins
        capital = np.zeros(128)
        for c in range(97, 123):
            capital[c - 32] = begins[c] + begins[c - 32]
        out += share * np.outer(ends, capital) / total
        digits = np.zeros(128)
        digits[48:58] = total / 10
        out += share * np.outer(ends, digits) / total + share * np.outer(digits, digits) / total
    return out


def _made_up(n: int = 400) -> list[bytes]:
    """Seeded random strings of common secret alphabets: labelled positive."""
    rng = np.random.default_rng(20)
    kinds = [_09 + "abcdef", _09 + "ABCDEF", _AZ + _az + _09, _AZ + _az + _09 + "+/", _AZ + _az + _09 + "-_", _AZ + _09]
    return ["".join(rng.choice(list(k), 32)).encode() for _ in range(n // len(kinds) + 1) for k in kinds]


class Model:
    """log P(random) - log P(identifier) for each pair of characters."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, alpha: float = 0.5, backoff: float = 5.0):
        def smoothed(m: np.ndarray) -> np.ndarray:
            """Pairs interpolated with single characters, so that a character never met tells by its rarity."""
            single = (m.sum(0) + alpha) / (m.sum() + alpha * len(m))
            return (m + backoff * single) / (m.sum(1, keepdims=True) + backoff)

        self.ratio = np.log(smoothed(random)) - np.log(smoothed(ordinary))

    def gains(self, s: bytes) -> np.ndarray:
        """Each character's log-likelihood ratio, given the one before."""
        codes = np.frombuffer(s, np.uint8)
        return self.ratio[np.concatenate(([0], codes[:-1])), codes] if len(codes) else np.zeros(0)

    def stretches(self, s: bytes, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
        """(start, end) of the stretches of a run that are taken as random, from left to right."""
        sums = np.concatenate(([0.0], np.cumsum(self.gains(s) - TOLL)))
        out: list[tuple[int, int]] = []
        open_ = [(0, len(s))]
        while open_:
            low, high = open_.pop()
            if high - low < LEAST_RUN:
                continue
            here = sums[low : high + 1]
            rise = here - np.minimum.accumulate(here)
            end = int(rise.argmax())
            if rise[end] < threshold:
                continue
            start = int(here[: end + 1].argmin())
            a, b = low + start, low + end
            while a > low and chr(s[a - 1]).isalnum():
                a -= 1
            while b < high and chr(s[b]).isalnum():
                b += 1
            if b - a >= LEAST_RUN and len(set(s[a:b])) >= LEAST_DISTINCT:
                out.append((a, b))
            open_ += [(low, a), (b, high)]
        return sorted(out)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits both models on the texts of the ``sample_docs`` ids of smallest hash."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 128, 128))
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                base = _base(buf, off, lambda row, c=part.column(1): c[row].as_py() or "")
                total[1] += _pairs([v for _, _, b, _, a in base if max(v := buf[a:b].tobytes(), default=0) < 128])
                total[0] += _pairs([v for _, a, b in _free_runs(buf, off, base, 3) if ordinary(v := buf[a:b].tobytes())])
        label, a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[label, a, b])], ["label", "a", "b", "n"]
        )

    total = np.zeros((2, 128, 128))
    for r in texts.mapInArrow(run, "label int, a int, b int, n double").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        total[r["label"], r["a"], r["b"]] = r["n"]  # 2 x 128 x 128 rows at most
    return Model(total[1] + _pairs(_made_up()), total[0] + _joined(total[0]))


def _found(part: pa.RecordBatch, buf: np.ndarray, off: np.ndarray, text_at: int, model: Model, threshold: float) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) of all spans in bytes of the slice, by row, start and kind."""
    base = _base(buf, off, lambda row: part.column(text_at)[row].as_py() or "")
    spans = [(r, a, b, k) for r, a, b, k, _ in base]
    taken: dict[int, list[tuple[int, int]]] = {}
    for r, a, b, _ in spans:
        taken.setdefault(r, []).append((a, b))
    for r, a, b in _runs(buf, off, LEAST_RUN):
        for x, y in model.stretches(buf[a:b].tobytes(), threshold):
            if not any(u <= a + x and a + y <= v for u, v in taken.get(r, ())):  # else a pattern has it whole
                spans.append((r, a + x, a + y, 3))
    return sorted(spans, key=lambda s: (s[0], s[1], s[3]))


def scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: (doc_id, spans array<struct<kind, start, end>>), in code points, end exclusive,
    by start and then in the order of KINDS. Null and empty texts have no spans; null ids and repeated rows come back
    as they are; other columns are ignored. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                spans = _found(part, buf, off, 1, model, threshold)
                out: list[list] = [[] for _ in range(part.num_rows)]
                if spans:
                    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                    for r, a, b, k in spans:
                        zero = points[off[r]]
                        out[r].append({"kind": KINDS[k], "start": int(points[a] - zero), "end": int(points[b] - zero)})
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def redact(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span (overlaps as one) replaced by ``mark``, all columns and rows kept. A null text
    stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        note = mark.encode()
        for batch in batches:
            for part, buf, off in slices(batch, text_col):
                by_row: dict[int, list] = {}
                for r, a, b, _ in _found(part, buf, off, at, model, threshold):
                    held = by_row.setdefault(r, [])
                    if held and a < held[-1][1]:
                        held[-1][1] = max(held[-1][1], b)
                    else:
                        held.append([a, b])
                if by_row:
                    texts = part.column(at).to_pylist()
                    for r, spans in by_row.items():
                        keep, last = [], int(off[r])
                        for a, b in spans:
                            keep += [buf[last:a].tobytes(), note]
                            last = b
                        texts[r] = b"".join([*keep, buf[last : off[r + 1]].tobytes()]).decode()
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part

    return docs.mapInArrow(run, docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: spans of secrets in all documents, with counts and a digest of the fixed patterns' spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS if k != "random"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count("random"),
    )
