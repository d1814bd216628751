"""The backoff automaton against a direct sum over counted n-grams."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.llm import lm


def tokens(text):
    return ["<s>"] + [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


class Direct:
    """P(w | u, v) by Dirichlet smoothing down to one class of unknown words, from plain counters."""

    def __init__(self, texts):
        self.c = [collections.Counter() for _ in range(3)]
        for t in map(tokens, texts):
            self.c[0].update((w,) for w in t[1:])
            self.c[1].update(zip(t, t[1:]))
            self.c[2].update(zip(t, t[1:], t[2:]))
        self.n = sum(self.c[0].values())
        self.rare = 1 + sum(v == 1 for v in self.c[0].values())
        self.heads = [collections.Counter(), collections.Counter()]
        for g, k in self.c[1].items():
            self.heads[0][g[0]] += k
        self.pairs = self.c[1]

    def p(self, u, v, w):
        low = (self.c[0][w,] or self.rare) / (self.n + self.rare)
        if v is not None and self.heads[0][v]:
            low = (self.c[1][v, w] + lm.WEIGHTS[0] * low) / (self.heads[0][v] + lm.WEIGHTS[0])
            if u is not None and self.c[1][u, v]:
                low = (self.c[2][u, v, w] + lm.WEIGHTS[1] * low) / (self.c[1][u, v] + lm.WEIGHTS[1])
        return low

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(t[i - 2] if i > 1 else None, t[i - 1], t[i])) for i in range(1, len(t)))


def corpus():
    rng = np.random.default_rng(7)
    vocab = ["The", "the", "cat", "Cat", "sat", "on", "a", "mat", "and", "Ünde", "x9", "ran"] + [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, len(vocab) + 1)
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60), p=p / p.sum()))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, " \n "), (203, rows[5][1]), (203, rows[5][1]), (None, "the cat"), (204, "never seen words at all"), (205, " ".join(rng.choice(vocab, 3000)))]


@pytest.mark.parametrize(("block_bytes", "fan"), [(1 << 20, 256), (600, 256), (600, 4), (600, 3)])
def test_scores_equal_a_direct_sum(spark, block_bytes, fan):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    learn = (F.col("doc_id") % 5 != 2) | F.col("doc_id").isNull()
    got = collections.defaultdict(list)
    for r in lm.score_texts(docs, learn, block_bytes=block_bytes, fan=fan).collect():
        got[r["doc_id"]].append(r)
    model = Direct([t for i, t in rows if i is None or i % 5 != 2])
    types = len(model.c[0])
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        r, w = got[i].pop(), tokens(t)[1:]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(model.c[0][x,] > 0 for x in w), model.n)
        assert math.isclose(r["base_score"], sum(math.log10((model.c[0][x,] + 1) / (model.n + types + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], model.score(t), rel_tol=1e-9), (i, r["score"], model.score(t))


def test_probabilities_sum_to_one():
    model = Direct([t for _, t in corpus()])
    words = [w for (w,) in model.c[0]]
    for u, v in [("the", "cat"), (None, "<s>"), ("cat", "the"), ("no", "the"), ("no", "way"), ("<s>", "the")]:
        assert math.isclose(sum(model.p(u, v, w) for w in words) + model.p(u, v, "unknown"), 1, rel_tol=1e-9)


@pytest.mark.parametrize("blocks", [1, 5, 256, 257, 65_536, 65_537, 20_000_000])
def test_messages_stay_few(blocks):
    r = lm.Routes(blocks, 256)
    assert r.fan <= 256 and r.fan**r.hops >= blocks and (r.hops == 1 or 256 ** (r.hops - 1) < blocks)
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    digits = [r.first(keys)] + [r.digit(keys & r.mask, h) for h in range(2, r.hops + 1)]
    assert all(d.max() < r.fan for d in digits)
    assert len({tuple(x) for x in zip(*(d.tolist() for d in digits))}) > 0.9 * min(len(keys), r.fan**r.hops) * (1 - math.exp(-1))


def test_no_rows(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0
