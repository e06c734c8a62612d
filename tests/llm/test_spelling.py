"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from orderlab.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans(sp.UPPER, sp.LOWER)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def plain(docs):
    c = Counter()
    for i, text in docs:
        for run in RUN.findall((text or "").translate(LOW)):
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                c[run] += 1
    c = {w: n for w, n in c.items() if n >= 2}
    form, count = {}, {}
    for w, n in c.items():
        about = sorted((-c[x], x) for x in c if near(w, x))
        count[w] = len(about)
        form[w] = about[0][1] if about and -about[0][0] >= 10 * n else None
    out = set()
    for w, n in c.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, count[w], c[form[w]] if form[w] else None))
    return out


def corpus():
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 10))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    def slip(w):
        k, c = rnd.randrange(len(w)), rnd.choice("abcéÿÀ")
        return rnd.choice([w[:k] + w[k + 1:], w[:k] + c + w[k + 1:], w[:k] + c + w[k:]])
    variants = [slip(w) for w in base for _ in range(12)] + [slip(slip(w)) for w in base for _ in range(3)]
    docs = []
    for i in range(300):
        ws = [rnd.choice(base) if rnd.random() < 0.8 else rnd.choice(variants) for _ in range(60)]
        docs.append((i, rnd.choice([" ", "\n", "1", ", "]).join(w.upper() if rnd.random() < 0.1 else w for w in ws)))
    docs += [(800 + i, "chainword " * 50 + "chaiword " * (4 if i < 9 else 0) + ("chaiwor" if i < 3 else "")) for i in range(20)]
    docs += [(5, "x" * 5000 + " " + "x" * 5000), (6, "x" * 4999 + " " + "x" * 4999), (None, docs[0][1]), (7, None), (8, ""), (9, "12 ab")]
    return docs + docs[:4]


@pytest.mark.parametrize("shard", [40_000, 150])
def test_words_forms_and_roots_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(sp, "SHARD", shard)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "y", 2) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    out = sp.group(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert {tuple(r) for r in out.collect()} == want
    assert any(r[1] and r[2] != r[1] for r in want)         # a chain of forms


def test_hot_halves_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(sp, "SHARD", 30)
    rnd = random.Random(2)
    vocab = sorted({"abcd" + "".join(rnd.choice("xyz") for _ in range(rnd.randint(3, 5))) for _ in range(250)}
                   | {"".join(rnd.choice("xyz") for _ in range(rnd.randint(3, 5))) + "dcba" for _ in range(150)})
    n = {w: rnd.randint(1, 50) for w in vocab}
    out = sp.neighbours(spark.createDataFrame(list(n.items()), "word string, n long"))
    for r in out.collect():
        about = sorted((-n[x], x) for x in vocab if near(r.word, x))
        assert (r.n, r.n_near, r.best) == (n[r.word], len(about), about[0][1] if about else None)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert sp.group(docs.limit(0)).collect() == [] and sp.group(docs).collect() == []


def test_search_finds_each_word_once():
    rnd = random.Random(3)
    vocab = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(4, 9))) for _ in range(300)})
    points, lens = sp.code_points(vocab)
    flat = points - 96
    index = sp.Index(flat, lens)
    a, b = sp.search(index, flat, lens, lens // 2)
    got = sorted(zip(a.tolist(), b.tolist(), strict=True))
    assert got == sorted((i, j) for i, w in enumerate(vocab) for j, x in enumerate(vocab)
                         if near(w, x) and x.startswith(w[:len(w) // 2]))
    assert isinstance(index.keys, np.ndarray)
