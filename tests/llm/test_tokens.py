"""Token ids, packing and wavelet files against the plain tokenizer and plain arrays."""

import collections
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilth.llm import _tokens, packing, wavelet
from tilth.llm._text import flat

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

PATHS = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
PLAIN = {}
for name, path in PATHS.items():
    PLAIN[name] = tokenizers.Tokenizer.from_file(path)
    PLAIN[name].encode_special_tokens = True
ODD = ["the", "The", "house", "É", "straße", "İstanbul", "don't", "x1", "42", "a.b", "word***", "…", "é", "ŉ", "日本", "ǅ", "<|endoftext|>", "(see", "''", "ﬁ", "q,!!", "|"]
SPACE = [" ", " ", " ", " ", "\n", "  ", "\n\n", " \n", "\t", "\r\n", "\xa0", " ", "\x0b", "\x1c", "　", "\x85", ""]
texts = st.lists(st.tuples(st.one_of(st.sampled_from(ODD), st.text(max_size=6)), st.sampled_from(SPACE)), max_size=12).map(lambda p: "".join(a + b for a, b in p))


def ids_of(name, rows, end=None):
    ids, at = _tokens.encoder(PATHS[name]).encode(*flat(pa.array(rows, pa.string())), end)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("name", PATHS)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), texts.filter(lambda t: t.isprintable() or "\ud800" not in t)), max_size=6))
def test_ids_are_the_tokenizers(name, rows):
    rows = [None if t is None else t.encode("utf-8", "ignore").decode() for t in rows]
    want = [PLAIN[name].encode(t or "", add_special_tokens=False).ids for t in rows]
    assert ids_of(name, rows) == want
    assert ids_of(name, rows, 7) == [w + [7] for w in want]


@pytest.mark.parametrize("name", PATHS)
def test_ids_stay_when_tables_are_emptied(name, monkeypatch):
    monkeypatch.setattr(_tokens, "KEPT_WORDS", 50)
    rng = np.random.default_rng(3)
    rows = [" ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 4))) + rng.choice(["", ".", ",!!"]) for _ in range(60)) for _ in range(12)]
    assert ids_of(name, rows) + ids_of(name, rows[::-1]) == [PLAIN[name].encode(t, add_special_tokens=False).ids for t in rows + rows[::-1]]


def test_pieces_are_their_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(list("abcde"), 5)) for _ in range(n))) for i, n in enumerate([0, 1, 30, 700, 4000, 4000, 9000])] + [(7, None), (None, "x y"), (4, "again")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, seq int, `_p` int, length int").repartition(2)
    name, want = "byte_bpe_50k.json", collections.defaultdict(list)
    for i, t in rows:
        want[i].append(PLAIN[name].encode(t or "", add_special_tokens=False).ids + [1])
    rows = packing.token_pieces(docs, PATHS[name], 1).collect()
    covered = collections.Counter()
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert any(w[r["start"] : r["start"] + r["length"]] == ids and len(w) == r["doc_tokens"] for w in want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and 1 <= r["length"] <= 2048
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: sum(map(len, w)) for i, w in want.items()}


def test_packing_carries_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, int(n), *range(11)) for i, n in enumerate([*rng.integers(1, 2049, 900), *[2048] * 300, *[512] * 50])]
    names = "cls lo hi seq slot sequence_id offset padded_to _cls _bucket _rank".split()
    out = packing.pack(spark.createDataFrame(rows + rows[:20], "doc_id int, length int, " + ", ".join(f"{n} int" for n in names)))
    assert out.columns == ["doc_id", "length", *names[:5], *names[8:], "sequence_id", "offset", "padded_to"]
    got = out.collect()
    assert collections.Counter((r["doc_id"], r["length"], r["seq"], r["_rank"]) for r in got) == collections.Counter((r[0], r[1], 3, 10) for r in rows + rows[:20])
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    tokens = 0
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and {r["padded_to"] for r in parts} == {at if at & (at - 1) == 0 else 2048}
        tokens += parts[0]["padded_to"]
    assert sum(r["length"] for r in got) / tokens > 0.95
    assert packing.pack(out.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000, 600_000])
def test_wavelet_files_answer_without_decoding(n):
    ids = np.random.default_rng(n).integers(0, 70_000 if n == 513 else 3000, n).astype(np.uint32)
    data = wavelet.WaveletMatrix.build(ids, [5], [n]).to_bytes()
    read = []

    class File(io.BytesIO):
        def read(self, size=-1):
            read.append(size)
            return super().read(size)

    f = wavelet.WaveletFile(File(data))
    for i in {0, 1, 511, 512, n // 2, n - 1} & set(range(n)):
        assert f.access(i) == ids[i]
        assert n < 100_000 or len(read) > 60 or sum(read) < len(data) / 2
    for v in {int(x) for x in ids[:3]} | {2999, 1 << 20}:
        at = np.flatnonzero(ids == v)
        assert f.count(v) == len(at) and f.rank(v, n // 2) == (at < n // 2).sum()
        for k in {0, 1, len(at) // 2, len(at) - 1} & set(range(len(at))):
            assert f.select(v, k) == at[k]
    with pytest.raises(IndexError):
        f.access(n)
    assert (wavelet.WaveletMatrix.from_bytes(data).ids() == ids).all()
