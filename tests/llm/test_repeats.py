"""Repeated passages against brute force: groups, spans, words shared with other documents."""

import collections
import itertools

import numpy as np
import pytest

from tilth.llm import repeats

LETTERS = np.array(list("abc"))


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(12))
def test_maximal_repeats_of_suffixes(seed):
    rng = np.random.default_rng(seed)
    n, least = int(rng.integers(2, 14)), int(rng.integers(2, 7))
    cut = lambda: "".join(rng.choice(LETTERS[: 2 + seed % 2], int(rng.integers(0, 7)))).encode()
    rows = list({(cut(), b"!" + cut()) for _ in range(n)})
    if len(rows) < 2:
        return
    left, right = [r[0] for r in rows], [r[1] for r in rows]
    want = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = shared(left[i], left[j]), shared(right[i], right[j])
        if x + y >= least:
            want.add((frozenset(k for k in range(len(rows)) if shared(left[k], left[i]) >= x and shared(right[k], right[i]) >= y), x, y))
    got = [(frozenset(m.tolist()), x, y) for m, x, y in repeats.Suffixes(left, right, least).maximal()]
    assert len(got) == len(set(got)) and set(got) == want

    owner = rng.integers(0, 3, len(rows))
    passage = max(1, least - 1)
    l, r, x, y = repeats.reaches(left, right, owner, least, passage)
    for i in range(len(rows)):
        pairs = [(shared(left[i], left[j]), shared(right[i], right[j]), owner[i] != owner[j]) for j in range(len(rows)) if j != i]
        long = [p for p in pairs if p[0] + p[1] >= least]
        assert (l[i], r[i]) == (max((p[0] for p in long), default=0), max((p[1] for p in long), default=0))
        assert x[i] + y[i] == max((p[0] + p[1] for p in pairs if p[2] and p[0] + p[1] >= passage), default=0)
        assert not (x[i] + y[i]) or any(p[0] >= x[i] and p[1] >= y[i] for p in pairs)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(n))


def corpus():
    passage, other = prose(1, 60), prose(2, 300)
    line = prose(3, 10)
    rows = [
        (1, prose(10, 40) + " " + passage + " " + prose(11, 40)),
        (2, prose(12, 90) + "\n" + passage + "\n" + prose(13, 5)),
        (3, prose(14, 120)),
        (4, other),
        (5, other),
        (6, other[:1000] + " é " + other[1000:]),
        (7, None),
        (8, ""),
        (9, line + " " + prose(15, 60)),
        (10, line + " " + prose(16, 60)),
        (11, passage + " " + prose(17, 80) + " " + passage),
        (12, prose(18, 70) + " " + prose(18, 70)),
        (13, "x" * 900),
        (14, prose(19, 100)),
        (14, prose(19, 100)),
        (None, passage),
    ]
    return rows + [(100 + i, prose(200 + i, 30) + " " + other[:700] + " " + prose(300 + i, 30)) for i in range(40)]


@pytest.mark.parametrize("most", [20_000, 5, 1])
def test_spans_and_shared_words(spark, most):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, spans long").repartition(3)
    got = repeats.repeated_spans(docs, most_contexts=most).collect()
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    spans = {}
    for i, b in data:
        hit = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                hit[k : k + 400] = True
        edge = np.diff(np.concatenate(([0], hit.astype(int))))
        spans[i] = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
    assert len(got) == len(rows)
    assert all([(s["start"], s["end"]) for s in r["spans"]] == spans[r["doc_id"]] for r in got)
    who = collections.defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 50):
            who[tuple(w[k : k + 51])].add((i, t))
    shares = {i for owners in who.values() if len(owners) > 1 for i, _ in owners}
    assert {r["doc_id"] for r in got if r["shared_words"]} == shares == {1, 2, 4, 5, 6, 11, None, *range(100, 140)}
    assert all(r["shared_words"] > repeats.WORDS for r in got if r["shared_words"])


def test_groups_hold_all_occurrences(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = collections.defaultdict(list)
    for r in repeats.maximal_repeats(docs).collect():
        groups[r["group_id"]].append((r["doc_id"], r["start"], r["length"]))
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append((t or "").encode())
    cover = collections.defaultdict(set)
    for members in groups.values():
        said = {texts[i][0][a : a + n] for i, a, n in members}
        assert len(said) == 1 and len(members) > 1
        passage = said.pop()
        assert len(passage) >= 400
        everywhere = sum(t.startswith(passage, k) for ts in texts.values() for t in ts for k in range(len(t) - len(passage) + 1))
        assert everywhere == len(members)
        for i, a, n in members:
            cover[i].update(range(a, a + n))
    spans = {r["doc_id"]: {k for s in r["spans"] for k in range(s["start"], s["end"])} for r in repeats.repeated_spans(docs).collect()}
    assert {i: c for i, c in spans.items() if c} == dict(cover)
    assert repeats.maximal_repeats(docs.limit(0)).count() == 0
