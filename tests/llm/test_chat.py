"""Quotation links and reply order against a plain search, on made-up conversations with nested quotes."""

import collections

import numpy as np
import pytest

from tilth.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, links string, _b int"


def conversations(seed):
    """Messages that quote others' passages or lines, some edited, some from elsewhere, at several levels."""
    rng = np.random.default_rng(seed)
    phrases = [" ".join(rng.choice(["pump", "valve", "row", "water", "meter", "Leaf", "soil", "night"], rng.integers(1, 7))) for _ in range(25)] + ["ok", "so be it then", "The very common closing line."]
    out, said = [], []
    for c in range(30):
        for t in range(int(rng.integers(1, 9))):
            lines = []
            for _ in range(int(rng.integers(0, 4))):
                if said and rng.random() < 0.7:
                    quote = str(rng.choice(said)).split("\n")
                    k = int(rng.integers(0, len(quote)))
                    quote = quote[k:] if rng.random() < 0.3 else quote
                    if rng.random() < 0.2:
                        quote[0] += " (edited)"
                    mark = str(rng.choice(["> ", ">", "  >  ", ">> ", "> > ", ">>>"]))
                    lines += [mark + q.upper() if rng.random() < 0.1 else mark + q for q in quote]
                if rng.random() < 0.8:
                    own = [str(rng.choice(phrases)) for _ in range(int(rng.integers(1, 3)))]
                    said.append("\n".join(own))
                    lines += own + [""] * int(rng.integers(0, 2))
            if rng.random() < 0.5:
                lines.append("The very common closing line.")
            out.append((c, t, "user", "\n".join(lines) if rng.random() < 0.97 else None))
    return out + out[:3]


def plain(messages):
    """(conv, turn) -> (links, parent), by searching every message for every passage."""
    said = collections.defaultdict(set)
    for c, t, _, x in messages:
        own = [line for level, line in chat.levels(x or "") if not level]
        text = "\n".join(own).strip()
        says = {chat.normal(line) for line in text.split("\n") if len(chat.normal(line)) >= chat.LEAST_LINE}
        says |= {chat.normal(p) for p in text.split("\n\n")} | {chat.normal(text)}
        for s in says - {""}:
            said[s].add((c, t))
    want = {}
    for c, t, _, x in messages:
        passages, level, lines = [], 0, []
        for lv, line in [*chat.levels(x or ""), (0, "")]:
            if lv != level:
                if level and chat.normal(" ".join(lines)):
                    passages.append((level, lines))
                level, lines = lv, []
            lines.append(line)
        links = []
        for n, (lv, part) in enumerate(passages):
            whole = chat.normal(" ".join(part))
            tries = [whole] + [s for s in map(chat.normal, part) if len(s) >= chat.LEAST_LINE and s != whole]
            near = [max((u for d, u in said[s] if d == c and u < t), default=None) for s in tries]
            far = [min(((d, u) for d, u in said[s] if d != c), default=None) for s in tries]
            hits = [(0, k, (c, u)) for k, u in enumerate(near) if u is not None] + [(1, k, p) for k, p in enumerate(far) if p is not None]
            links.append((n, lv, *(min(hits)[2] if hits else (None, None))))
        matched = sorted((lv, n, p, q) for n, lv, p, q in links if q is not None)
        want[c, t] = (links, matched[0][2:] if matched else (None, None))
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_a_plain_search(spark, seed):
    rows = conversations(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = chat.linked(docs).collect()
    want = plain(rows)
    assert len(got) == len(rows) and sum(bool(w[0]) for w in want.values()) > 40
    for r in got:
        links, parent = want[r["conv_id"], r["turn"]]
        assert [tuple(x) for x in r["links"]] == links, (r["conv_id"], r["turn"])
        assert (r["parent_conv"], r["parent_turn"]) == parent and r["n_quotes"] == len(links)
    by = collections.defaultdict(list)
    for r in got:
        by[r["conv_id"]].append(([tuple(x) for x in r["reply_path"]], r["turn"], r["parent_turn"] if r["parent_conv"] == r["conv_id"] else None))
    for messages in by.values():
        order = {t: i for i, (_, t, _) in enumerate(sorted(messages))}
        assert all(order[p] < order[t] for _, t, p in messages if p is not None and p < t)


def test_long_texts_and_repeated_rows(spark):
    long = "\n".join(f"line number {i} of the long report" for i in range(20_000))
    m = [(1, 0, "u", long), (1, 1, "a", "> line number 777 of the long report\nNoted."), (1, 1, "a", "> line number 777 of the long report\nNoted."), (2, 0, "u", ">" * 50 + " deep\n" + "> " * 3)]
    rows = chat.linked(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["turn"], r["parent_turn"]) for r in rows) == [(1, 0, None), (1, 1, 0), (1, 1, 0), (2, 0, None)] or len(rows) == 4
    assert {r["parent_turn"] for r in rows if r["turn"] == 1} == {0}
