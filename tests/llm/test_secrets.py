"""Fixed patterns against plain regular expressions; the Markov models against planted strings."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from tilth.llm import secrets

DATA = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
AZ, az, D = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = [AZ + az + D, AZ + az + D + "+/", AZ + az + D + "-_", az + D, AZ + D]


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def odd_texts():
    rng = np.random.default_rng(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", "  ", "'", '"', "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "é", "ſecret", "K", "x" * 12, "Ab9+/_.=-", "\n", "abcdefghijklmnop", "Z9" * 8]
    return ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(600)] + ["", "é" * 5000 + " token=" + "k3" * 9 + " " + "word " * 40_000]


def test_patterns_equal_plain_expressions(spark):
    rows = list(enumerate(odd_texts())) + [(9001, None), (None, "token: abcdefghijkl")]
    rows += duckdb.sql(f"SELECT doc_id + 10000, text FROM '{DATA}/documents.parquet'").fetchall()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = secrets.train(docs)
    got = {r["doc_id"]: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "random") for r in secrets.scan(docs, model).collect()}
    assert got == {i: base(t or "") for i, t in rows}


def test_query_columns(spark):
    rows = secrets.op2_secrets(spark, DATA)
    assert rows.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    for r in rows.collect():
        want = base(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k + ":") for x in want.split(",")) for k in ("assign", "access", "hex"))
        assert not [x for x in want.split(",") if x and x not in r["spans"].split(",")]


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark.read.parquet(f"{DATA}/documents.parquet"))


def random_strings(rng, n, size):
    for k in range(n):
        yield "".join(rng.choice(list(ALPHABETS[k % len(ALPHABETS)]), size))


def test_recall_on_planted_strings(model):
    rng = np.random.default_rng(4)
    for size, least in ((16, 0.85), (20, 0.95), (32, 0.99), (64, 0.99)):
        strings = list(random_strings(rng, 500, size))
        assert sum(bool(model.stretches(s.encode())) for s in strings) / len(strings) >= least, size
    for s in random_strings(rng, 100, 32):  # found at their place in a long path and beside words
        for before, after in (("/home/someone/projects/reports/" * 7, "/index"), ("the_default_value_of_", ""), ("", "-generated-for-the-reader")):
            found = model.stretches((before + s + after).encode())
            kept = sum(min(b, len(before) + 32) - max(a, len(before)) for a, b in found if a < len(before) + 32 and b > len(before))
            assert kept >= 24 and all(b - a <= 60 for a, b in found)


def test_precision_on_ordinary_strings(model):
    names = duckdb.sql(f"SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}')) FROM '{DATA}/documents.parquet'").fetchall()
    words = [w for (w,) in names]
    rng = np.random.default_rng(5)
    joined = []
    for _ in range(2000):
        few = list(rng.choice(words, rng.integers(2, 5)))
        sep = str(rng.choice(["_", "-", "/", "", "="]))
        joined.append(sep.join(few) if sep else few[0].lower() + "".join(w.capitalize() for w in few[1:]))
    flagged = [w for w in joined + words if model.stretches(w.encode())]
    assert len(flagged) <= 0.005 * len(joined + words), flagged[:10]
    for filler in ("-" * 60, "=" * 40, "_" * 30, "abababababababababab", "2024-01-31-12-00-00-000", "0" * 40):
        assert not model.stretches(filler.encode()), filler


def test_a_secret_in_the_texts_does_not_hide_itself(spark, model):
    rng = np.random.default_rng(6)
    planted = list(random_strings(rng, 200, 24))
    rows = [(i, f"see the {s} for more of it") for i, s in enumerate(planted)] + [(500 + i, "the house of the garden is here and there") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.scan(docs, secrets.train(docs)).collect() if r["spans"]}
    assert len(found & set(range(200))) >= 180 and not found & set(range(500, 700))
