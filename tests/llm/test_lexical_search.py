"""Lexical search against SQL and a plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from orderlab.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(ls.UPPER, ls.LOWER)


def plain(docs, items, top):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = set()
    terms = {}
    for item, text in items:
        if item is not None:
            terms.setdefault(item, set()).update(TERM.findall((text or "").translate(LOW)))
    for item, ts in terms.items():
        got = []
        for i, c in bags:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in ts if c[t])
            if s > 0:
                got.append((-s, i is None, i or 0, i))
        for r, (s, _, _, i) in enumerate(sorted(got)[:top], 1):
            out.add((item, r, i, -s))
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ls, "LEAF", 4)
    monkeypatch.setattr(ls, "TREE_DOCS", 150)


def tables():
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdéß5") for _ in range(rnd.randint(1, 4))) for _ in range(80)]
    pick = lambda: vocab[min(int(rnd.expovariate(0.06)), 79)]
    docs = [(i, " ".join(pick() for _ in range(rnd.randint(1, 60)))) for i in range(400)]
    docs += [(400 + i, docs[i % 7][1].upper()) for i in range(40)]                        # equal scores
    docs += [(3, docs[9][1]), (None, docs[2][1]), (None, "a b"), (900, None), (901, ""), (902, " .;:"), (903, "zz " * 4000)]
    items = [(i, " ".join(pick() for _ in range(rnd.randint(1, 25)))) for i in range(30)]
    items += [(2, "dd ab"), (None, "ab"), (50, None), (51, ""), (52, "nowhereatall"), (53, "zz ZZ zz"), (54, vocab[0])]
    return docs, items


def test_places_equal_a_plain_scoring(spark, small):
    rows, wanted = tables()
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, score string, rank int").repartition(3)
    items = spark.createDataFrame([(*r, 7) for r in wanted], "item_id long, text string, doc_id int")
    for top in (5, 50):
        out = ls.search(docs, items, top=top)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert {tuple(r) for r in out.collect()} == plain(rows, wanted, top)
    parts = ls.search(docs, items, top=5, part_terms=40)
    assert {tuple(r) for r in parts.collect()} == plain(rows, wanted, 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("false"), items.where("false"))):
        out = ls.search(d, b)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r) for r in ls.search(docs, items).collect()] == [
        (1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 20 * 100)))]


def test_sql_equals_a_plain_scoring():
    rows, wanted = tables()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", wanted)
    assert set(con.execute(ls.SQL).fetchall()) == plain(rows, wanted, 50)


def test_subtrees_bound_their_documents(small):
    rng = np.random.default_rng(4)
    lens = rng.integers(1, 12, 140)
    term = np.concatenate([np.sort(rng.choice(30, k, replace=False)) for k in lens])
    tf, m = rng.integers(1, 9, len(term)), rng.integers(60, 300, 140)
    t = ls.Tree(np.arange(140), m, lens, term, tf)
    assert sorted(t.doc.tolist()) == list(range(140))
    starts = np.cumsum(lens) - lens
    leaves = sorted((a, b) for a, b, c in zip(t.low, t.high, t.children, strict=True) if not c)
    assert [a for a, _ in leaves] == [0] + [b for _, b in leaves[:-1]] and leaves[-1][1] == 140
    for node in range(len(t.low)):
        below = t.doc[t.low[node]:t.high[node]]
        assert t.least[node] == m[below].min()
        for k, name in enumerate(t.terms):
            counts = [tf[j] for d in below for j in range(starts[d], starts[d] + lens[d]) if term[j] == name]
            assert t.most[node, k] == max(counts, default=0)
