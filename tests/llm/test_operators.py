"""The training-data operators against brute force on small fixtures, and their edge
cases: nulls, empty and long texts, ties and repeated rows, empty tables, extra columns
with clashing names."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import math
import random
import re
import time
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orderlab.llm import (
    decontaminate, hmm_lm, lang_id, mixing, near_dup, page_diff, quality, secret_scan, tool_calls, url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    return (text or "").encode().lower().split() if lower else (text or "").encode().split()


def make_docs(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    out = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    out += [out[5], out[5].upper(), out[7] + " extra words", out[9].replace(" ", "\n", 4)]
    out += [None, "", " \t\n", "one", "one two", " ".join(["lorem"] * 3000), out[3] * 30, "\x85x y z \x0b q"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make_docs(spark, texts)


def test_hmm_scores(spark, docs, texts):
    got = {r.doc_id: r for r in hmm_lm.score(docs, states=3, classes=64, iterations=2).collect()}
    assert len(got) == len(texts)
    toks = {i: [*words(t), b""] for i, t in enumerate(texts)}
    train = [i for i in toks if crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert r.held_out == (i not in train) and (r.n_tokens, r.train_tokens) == (len(ws), n)
        assert r.n_known == sum(c[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    ctab = hmm_lm.word_counts(hmm_lm.materialize(hmm_lm.blocks(docs, 64), "t"), 64)[1]
    assert (ctab.tokens, ctab.words) == (n, v)


def test_hmm_recursions_against_all_paths():
    rng = np.random.default_rng(0)
    k, classes = 3, 5
    model = hmm_lm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(classes), k).T)
    seen = rng.integers(0, classes, 23)
    starts, sizes = np.array([0, 1, 7]), np.array([1, 6, 7])

    def brute(s):
        total = 0.0
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        return math.log10(total)

    want = [brute(seen[a:a + n]) for a, n in zip(starts, sizes)]
    for piece in (1, 2, 3, 100):  # chained segments give the same likelihood
        assert np.allclose(hmm_lm.log10_forward(model, seen, starts, sizes, piece), want)
    start, move, emit, ll = hmm_lm.expected_counts(model, seen, starts, sizes)
    assert np.isclose(ll / math.log(10), sum(want)) and np.isclose(emit.sum(), 14) and np.isclose(start.sum(), 3)
    assert np.isclose(move.sum(), 11)
    assert (hmm_lm.unpack(hmm_lm.pack(np.array([0, 1, 70000, 2 ** 31]))) == [0, 1, 70000, 2 ** 31]).all()


def test_hmm_training_runs_over_whole_texts():
    rng = np.random.default_rng(1)
    k, classes = 3, 40
    model = hmm_lm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(classes), k).T)
    sizes = np.array([2100, 1, 600, 30, 512, 513, 700])
    starts, seen = np.cumsum(sizes) - sizes, rng.integers(0, classes, sizes.sum())

    def brute(s):  # scaled recursions token by token, with the posteriors by hand
        a, b, n = [model.start * model.emit[s[0]]], [np.ones(k)], len(s)
        logs = np.log(a[0].sum())
        a[0] = a[0] / a[0].sum()
        for t in range(1, n):
            x = (a[-1] @ model.move) * model.emit[s[t]]
            logs += np.log(x.sum())
            a.append(x / x.sum())
        for t in range(n - 1, 0, -1):
            x = model.move @ (model.emit[s[t]] * b[-1])
            b.append(x / x.sum())
        b = b[::-1]
        g = np.array(a) * np.array(b)
        g /= g.sum(axis=1, keepdims=True)
        move = np.zeros((k, k))
        for t in range(1, n):
            x = a[t - 1][:, None] * model.move * (model.emit[s[t]] * b[t])
            move += x / x.sum()
        emit = np.zeros((classes, k))
        np.add.at(emit, s, g)
        return g[0], move, emit, logs

    want = [sum(x) for x in zip(*(brute(seen[a:a + n]) for a, n in zip(starts, sizes)))]
    for got in (hmm_lm.expected_counts(model, seen, starts, sizes),
                hmm_lm.expected_counts(model, seen, starts, sizes, 7), hmm_lm.expected_counts(model, seen, starts, sizes, 10 ** 6)):
        assert all(np.allclose(x, y) for x, y in zip(got, want))
    single = hmm_lm.expected_counts(model.single(), seen, starts, sizes)
    assert all(np.allclose(x, y, rtol=1e-2, atol=0.05) for x, y in zip(single, want))
    assert np.isclose(want[0].sum(), len(sizes)) and np.isclose(want[1].sum(), (sizes - 1).sum())


def hmm_first_pass(table, counts, sizes, states, classes):
    """(log-likelihood of the training texts, expected emissions by key) of the first model."""
    first = hmm_lm.first_emissions(sizes, counts, states)
    keys = {r.k: r.e for r in first.table.collect()}
    move = np.full((states, states), 0.1 / (states - 1))
    np.fill_diagonal(move, 0.9)
    loglik, found = 0.0, Counter()
    for row in table.withColumn("keys", F.transform("vocab", lambda v: hmm_lm._kind(v["w"], classes))).collect():
        tokens, at, n = hmm_lm._codes(row.asDict())
        model = hmm_lm.Hmm(np.full(states, 1 / states), move, np.array([keys.get(k, first.unseen) for k in row["keys"]]))
        use = ~np.array(row.held, bool)
        loglik += hmm_lm.log10_forward(model, tokens, at[use], n[use]).sum() * math.log(10)
        for k, e in zip(row["keys"], hmm_lm.expected_counts(model, tokens, at[use], n[use])[2]):
            found[k] = found[k] + e
    return loglik, found


@pytest.mark.parametrize("classes", [None, 64])
def test_hmm_trains_on_uncut_texts(spark, classes):
    rnd = random.Random(2)
    docs = make_docs(spark, [" ".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (3000, 5, 700)]).repartition(2)
    table = hmm_lm.materialize(hmm_lm.blocks(docs), "t")
    _, counts, sizes = hmm_lm.word_counts(table, classes)
    *_, emissions, history = hmm_lm.train(table, counts, sizes, 2, classes, 1)
    loglik, found = hmm_first_pass(table, counts, sizes, 2, classes)
    assert np.isclose(history[0], loglik, rtol=1e-5)
    size = {r.k: r["size"] for r in sizes.collect()}
    if not classes:  # one count more for each word, and one for all unseen ones
        rest = sum(found.values()) / counts.tokens
        found = {k: x * size[k] / (size[k] - 1) if k in size else x for k, x in found.items()} | {None: rest}
        assert np.allclose(emissions.unseen, (rest + hmm_lm.PRIOR / counts.total) / (sum(found.values()) + hmm_lm.PRIOR), rtol=1e-3)
    total = sum(found.values())
    for r in emissions.table.collect():
        want = (found[r.k] + hmm_lm.PRIOR * size[r.k] / counts.total) / (total + hmm_lm.PRIOR)
        assert np.allclose(r.e, want, rtol=1e-3)


def test_hmm_learns_every_word(spark):
    rnd = random.Random(4)  # two topics whose words number more than any fixed set of classes
    topics = [[f"{t}{i}" for i in range(20_000)] for t in "ab"]
    texts_ = [" ".join(rnd.choices(topics[i % 2], k=2000)) for i in range(40)]
    table = hmm_lm.materialize(hmm_lm.blocks(make_docs(spark, texts_)), "t")
    counted, counts, sizes = hmm_lm.word_counts(table)
    assert sizes.count() == counts.words > 1 << 14
    start, move, emissions, _ = hmm_lm.train(table, counts, sizes, 2, None, 2)
    total = np.array([r.e for r in emissions.table.collect()]).sum(axis=0) + emissions.unseen
    assert emissions.table.count() == counts.words and np.allclose(total, 1, rtol=1e-4)
    got = {r.doc_id: r for r in hmm_lm.scores(table, counted, start, move, emissions, counts.total).collect()}
    assert len(got) == 40 and all(r.score < 0 for r in got.values())


def test_hmm_scores_against_one_table(spark):
    """The whole operator against Baum-Welch over one list of words: words of one block, of
    several, and words that a block only holds in texts that are not trained on."""
    rnd = random.Random(6)
    texts_ = [" ".join([*rnd.choices("abcdef", k=rnd.randrange(40)), *rnd.choices([f"w{i}é" for i in range(60)], k=8), f"own{i}"])
              for i in range(40)] + [None, "", "nowhere else"]
    got = {r.doc_id: r.score for r in hmm_lm.score(make_docs(spark, texts_).repartition(5), states=3, iterations=2).collect()}
    toks = [[*(x.decode() for x in words(t)), ""] for t in texts_]
    train = [i for i in range(len(toks)) if crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in toks[i])
    vocab = {w: j for j, w in enumerate(count)}
    c, n, v = np.array(list(count.values()), float)[:, None], sum(count.values()), len(count)
    total = n + v + 1
    hashes = [xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(w.encode(), 42).to_bytes(8, "little"), 42) for w in vocab]
    emit = (c + 1) / total * (1 + 0.6 * (np.array([[(2 * (h >> 5 * j & 31) + 1) / 32 for j in range(3)] for h in hashes]) - 1))
    norm = emit.sum(axis=0) + 1 / total
    emit, unseen = emit / norm, 1 / total / norm
    start, move = np.full(3, 1 / 3), np.full((3, 3), 0.05) + np.eye(3) * 0.85
    sizes = np.array([len(t) for t in toks])
    starts, seen = np.cumsum(sizes) - sizes, np.array([vocab.get(w, v) for t in toks for w in t])
    for _ in range(2):
        model = hmm_lm.Hmm(start, move, np.vstack([emit, unseen]))
        first, moves, found, _ = hmm_lm.expected_counts(model, seen, starts[train], sizes[train])
        found, rest = found[:v] * (c + 1) / c, found[:v].sum(axis=0) / n
        weight = found.sum(axis=0) + rest + hmm_lm.PRIOR
        emit, unseen = (found + hmm_lm.PRIOR * (c + 1) / total) / weight, (rest + hmm_lm.PRIOR / total) / weight
        start, move = (first + 1) / (first + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True)
    want = hmm_lm.log10_forward(hmm_lm.Hmm(start, move, np.vstack([emit, unseen])), seen, starts, sizes)
    assert np.allclose([got[i] for i in range(len(toks))], want, rtol=1e-4)


def test_language_id(spark):
    rnd = random.Random(1)
    base = {"en": "the and of that with from this which water house".split(),
            "de": "der und von dass mit aus dieser welche wasser haus".split()}
    langs = [rnd.choice(["en", "de"]) for _ in range(120)]
    texts = [" ".join(rnd.choice(base[x]) for _ in range(15)) for x in langs] + [None, "", "123 !!", "der " * 400]
    docs = make_docs(spark, texts, [*langs, "en", "en", "de", None])
    got = {r.doc_id: r for r in lang_id.identify(docs, rounds=2).collect()}
    assert all(got[i].lang_pred == x and 0.5 < got[i].score <= 1 for i, x in enumerate(langs))
    assert [got[i].lang_pred for i in range(120, 123)] == ["und"] * 3 and got[123].lang_pred == "de"
    none = lang_id.identify(docs.where("doc_id < 0"), rounds=1)
    assert none.count() == 0


def test_segmentations_are_summed():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a"]
    prob = np.random.default_rng(2).random((7, 2))
    index = {p: i for i, p in enumerate(pieces)}

    def brute(w, k):
        if not w:
            return 1.0
        total = 0.0
        for n in range(1, len(w) + 1):
            p = index.get(w[:n], 6 if n == 1 else None)
            total += 0 if p is None else prob[p, k] * brute(w[n:], k)
        return total

    ws = ["▁ab", "▁abab", "b", "▁aßba"]
    got = lang_id.word_scores(lang_id.Lattice(pieces), prob, ws)
    assert np.allclose(got, [[math.log(brute(w, k)) for k in range(2)] for w in ws])
    one = lang_id.expected_pieces(lang_id.Lattice(pieces), prob[:, 0], ["▁ab"], np.array([2.0]))
    assert np.isclose(sum(len((pieces + ["?"])[i]) * n for i, n in enumerate(one)), 6)  # every letter is covered


def test_tool_call_levels(spark):
    rnd = random.Random(9)
    deps = {("chain", i): {i - 1} if i else set() for i in range(150)}
    for g in range(6):  # random graphs, half of them with back edges
        for i in range(14):
            deps[f"g{g}", i] = {rnd.randrange(i) for _ in range(rnd.randint(0, 3))} if i else set()
        if g % 2:
            deps[f"g{g}", rnd.randrange(4)].add(rnd.randrange(4, 14))
    deps |= {("ring", i): {(i + 1) % 3} for i in range(3)} | {("ring", 3): {0, 4}, ("ring", 4): set()}

    def level(key, seen=()):
        if key in seen:
            return None
        below = [level((key[0], d), (*seen, key)) for d in deps[key] if d != key[1]]
        return None if None in below else 1 + max(below, default=-1)

    calls = spark.createDataFrame([(c, str(i)) for c, i in deps], "conv_id string, call_id string")
    edges = spark.createDataFrame([(c, str(i), str(d)) for (c, i), ds in deps.items() for d in ds]
                                  + [("chain", "3", "unknown")], "conv_id string, call_id string, dep_id string")
    got = {(r.conv_id, int(r.call_id)): r.level for r in tool_calls.levels(calls, edges).collect()}
    assert got == {k: v for k in deps if (v := level(k)) is not None}


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "f", '{"y": 2, "x": "s"}'), (1, "b", 1, "f", '{"x": 1}'), (1, "c", 2, "f", "no json"),
        (1, "d", 3, "g", '{"z": []}'), (2, "a", 0, "f", '{"x": "t", "q": {"b": 1, "a": 2}}'), (2, "p", 1, "f", None),
        (2, "s", 2, "f", '{"x": "u"}'), (2, "r", 3, "f", '{"x": "u"}'), (2, "r", 3, "f", '{"x": "u"}'), (None, "n", 0, "f", "{}")],
        "conv_id long, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([(1, "a", 5, "one"), (1, "a", 4, "first"), (1, "zz", 6, "lost"), (2, "a", 1, None)],
                                    "conv_id long, call_id string, turn long, content string")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "d", "unknown"), (2, "s", "r"),
                                   (2, "r", "s"), (2, "a", "a")], "conv_id long, call_id string, dep_id string")
    schemas = {"f": {"x": ("string", True), "y": ("integer", False)}}
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, edges, schemas).collect()}
    assert len(got) == 10
    assert [got[1, k].level for k in "abcd"] == [0, 1, 2, 0]
    assert got[1, "a"].record == ('{"arguments":{"x":"s","y":2},"call_id":"a","conv_id":1,"errors":[],"level":0,"name":"f",'
                                  '"result":"first","status":"linked"}')
    assert got[1, "a"].n_results == 2 and got[2, "r"].n_calls == 2
    assert got[1, "b"].errors == "type:x" and got[1, "c"].errors == "not_json" and got[1, "d"].errors == "unknown_tool"
    assert got[2, "a"].errors == "unknown:q" and '"q":{"a":2,"b":1}' in got[2, "a"].record
    assert got[2, "s"].status == got[2, "r"].status == "cycle" and got[1, "zz"].status == "orphan_result"
    assert got[None, "n"].status == "unlinked" and got[1, "b"].status == "unanswered"
    assert json.loads(got[2, "p"].record)["errors"] == ["not_json"]
    empty = tool_calls.link(calls.limit(0), results.limit(0), edges.limit(0), schemas)
    assert empty.count() == 0


def brute_quality(t):
    ws = BLANK.findall(t or "")
    lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
    c = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    hit = {j for i in range(len(ws) - 7) if c[tuple(ws[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_quality_counters(spark, texts):
    more = [*texts, "a b\na b\n\n a b\n#x $", "l1 one\nl1 one\nl1 one", "a b c d e f g h " * 5]
    docs = make_docs(spark, more)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (9999, 1, 0), (69, 0, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, buckets=256)
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    for i, t in enumerate(more):
        want = brute_quality(t)
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i].base_failed == failed and got[i].kept == (not failed and got[i].llr >= model.threshold)
    none = quality.fit(docs, labels.limit(0), buckets=256)
    assert none.threshold == -np.inf
    assert quality.keep_good(docs.limit(0), none).count() == 0


def test_mixing(spark, texts):
    langs = ["en" if i % 4 else "de" for i in range(len(texts))]
    docs = make_docs(spark, texts, langs)
    got = mixing.sample(docs, sweeps=30).toPandas()
    assert len(got) == len(texts) and abs(got.weight.sum() - 1) < 1e-9
    sums = got.groupby("lang").agg(w=("weight", "sum"), t=("tokens", "sum"))
    want = sums.t ** 0.5 / (sums.t ** 0.5).sum()
    assert abs(sums.w - want).max() < 1e-3
    assert (got[got.tokens == 0].copies == 0).all()
    out = mixing.mix(docs.withColumnRenamed("n_chars", "mix_rate"))
    assert out.columns == ["doc_id", "text", "lang", "source", "mix_topic", "mix_rate", "mix_copies"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_secret_spans(spark, texts):
    body = "x" * 30
    good = f"ghp_{body}{secret_scan.crc_digits(body)}"
    bad = f"ghp_{body}000000"
    more = [*texts, "é TOKEN = \"abcdefgh\" token:short secret=token=abcdefgh", f"k {good} {bad}", "AKIA" + "Z" * 12 + " AKIAX",
            "f" * 31 + " " + "0a" * 20 + "g", "passwordpassword:'longenough1'", "ſecret=abcdefghi eyJhbGciOiJub25lIn0.e30.x"]
    docs = make_docs(spark, more)
    got = {r.doc_id: r for r in secret_scan.find_secrets(docs).collect()}
    plain = [("assign", secret_scan.PATTERNS["assign"], lambda m: len(m[2]) >= 8),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
             ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    for i, t in enumerate(more):
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(plain) for m in p.finditer(t or "") if ok(m))
        want = ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
    n = len(texts)
    assert got[n + 1].spans == f"github:2:{2 + len(good)}" and "jwt" in got[n + 5].spans
    masked = {r.doc_id: r for r in secret_scan.mask_secrets(docs).collect()}
    assert masked[n + 1].text == f"k [SECRET] {bad}" and masked[n + 1].n_chars == len(masked[n + 1].text)
    assert masked[0].text == texts[0] and masked[n - 8].text is None


def test_secret_scans_of_hostile_texts():
    deep = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 100_000).decode().rstrip("=")
    assert [k for k, *_ in secret_scan.find(f"{deep}.e30.x") if k == "jwt"] == []
    start = time.perf_counter()
    run = "eyJ" * 400_000
    assert secret_scan.find(run) == [] and time.perf_counter() - start < 20
    good = "eyJhbGciOiJub25lIn0.e30.x"
    assert secret_scan.find(f"{run} {good}") == [("jwt", len(run) + 1, len(run) + 1 + len(good))]


def page_text(html, *neighbours):
    """(text, lines, deleted lines) of a page held against the html of its neighbours."""
    found = page_diff.lines(html)
    gone = page_diff.template_lines(page_diff.line_hashes(found), page_diff.declared(found) is not None,
                                    *[page_diff.line_hashes(page_diff.lines(x)) for x in neighbours])
    return *page_diff.main_text(html, gone), len(gone)


def test_page_lines():
    assert page_diff.lines(None) == [] and page_text("")[0] == ""
    html = ('<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1>'
            '<p>one<br>two&nbsp; <b>x</b>y<p>&lt;p&gt; &am<script>var t="</p>";</script><aside>side</aside>'
            '<div class="comments"><p>reader</p></div></article><footer>F</footer>')
    assert page_text(html)[0] == "A & B\none two xy\n<p> &am"
    assert page_text("<p>&am<b>p;</b> a&lt;b</p>")[0] == "&amp; a<b"     # references end at a tag
    assert page_text("<p>1 < 2 <3 <!-->x<!-- y --><svg class='i'/>z</p")[0] == "1 < 2 <3 xz</p"
    assert page_text('<p title="a>b">in</p><p title="open>out</p><p>last</p>')[0] == "in\nout\nlast"
    menu = "<div>Start</div><div>News</div><p>{}</p><div>Imprint</div>"
    first, second = menu.format("alpha " * 20), menu.format("beta " * 20)
    assert page_text(first, second) == (("alpha " * 20).strip(), 4, 3)
    assert page_text(first, first)[0].count("\n") == 3  # a copy


@pytest.mark.parametrize("unit", ["<a ", "<a '>", "<a \"'>", "<p", "<!-", "<script>", "</script ", "<svg/", "&am", "<a b='\">'"])
def test_page_markup_in_linear_time(unit):
    start = time.perf_counter()
    page_diff.lines(unit * 200_000)
    assert time.perf_counter() - start < 10


def test_page_template_by_evidence():
    article = "<article><h1>{0}</h1><p>Read more</p><p>body of {0}</p></article>"
    a, b, c = (article.format(x) for x in ("one", "two", "three"))
    assert page_text(a, b, c) == ("one\nbody of one", 3, 1)  # template in declared content
    assert page_text(a, a, c) == ("one\nbody of one", 3, 1)  # a mirrored copy is no evidence
    assert page_text(a, a, a) == ("one\nRead more\nbody of one", 3, 0)
    near = a.replace("Read", "Learn")
    assert page_text(a, near, c)[0].endswith("body of one") and page_text(a, near, near)[2] == 0  # versions of one article
    moved = "<article><p>Read more</p><h1>{0}</h1><p>body of {0}</p><p>end of {0}</p></article>".format("four")
    assert page_text(a, b, moved)[2] == 0                     # a sentence at varying places
    last = "<article><h1>{0}</h1><p>x {0}</p><p>y {0}</p><p>Read more</p><p>body of {0}</p></article>".format("five")
    assert page_text(a, last)[0] == "one\nbody of one"        # the same place from the end
    menu = "<div>" + "</div><div>".join(f"menu entry number {i}" for i in range(18)) + "</div>"
    short = [menu + f"<p>{'text ' * 40}{i}</p>" for i in range(3)]
    assert page_text(*short) == ("text " * 40 + "0", 19, 18)


def test_page_alignment_against_brute_force():
    rng = random.Random(5)
    for n in range(300):
        a, b = ([rng.randrange(rng.choice((2, 6, 30))) for _ in range(rng.randrange(25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        for bits in (1, 40, page_diff.TABLE_BITS):
            got = page_diff.common_lines(a, b, bits)
            pairs = [(i, j) for i, j in enumerate(got.tolist()) if j >= 0]
            assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(x[1] < y[1] for x, y in itertools.pairwise(pairs))
    a = list(range(20_000))
    b = a.copy()
    rng.shuffle(b)
    tracemalloc.start()
    page_diff.common_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_page_pairs(spark):
    menu = "<div>Start</div><div>News {0}</div><p>{1}</p>"
    rows = [(i, f"https://h{i % 2}.example.org/p/{i}?x=1", menu.format(i % 2, f"text {i} " * 9), "clash") for i in range(40)]
    rows += [(41, None, None, "x"), (42, "https://solo.example.org/", "<p>alone</p>", "x"), (0, rows[0][1], rows[0][2], "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = page_diff.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == (f"text {i} " * 9).strip() and by[i].n_template == 2 for i in range(40))
    assert by[41].text == "" and by[41].n_chars == 0 and by[42].text == "alone"
    assert page_diff.extract(pages.limit(0)).count() == 0


def test_page_sentences_of_other_hosts(spark):
    article = "<article><h1>{0}</h1><p>A common sentence.</p><p>one {0}</p><p>two {0}</p><p>Posted on {1}.</p></article>"
    rows = [(i, f"https://h{i % 2}.example.org/{i:03}", article.format(i, f"h{i % 2}")) for i in range(20)]
    rows += [(100, rows[0][1], article.format("other", "h0")), (None, None, "<p>no id</p>")]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = sorted(r.text for r in got)
    want = [f"{i}\nA common sentence.\none {i}\ntwo {i}" for i in [*range(20), "other"]]  # the line of one host goes
    assert texts == sorted([*want, "no id"])


def brute_groups(texts, width, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, width, percent):
    rnd = random.Random(width)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(60)]
    more = list(texts)
    for _ in range(60):  # variants of one text with zero to six changed words
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(60)] = f"z{rnd.randint(0, 9)}"
        more.append(" ".join(w))
    got = near_dup.groups(make_docs(spark, more), width, percent).collect()
    want = brute_groups(more, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_short_near_duplicates_are_linked(spark, width, percent):
    rnd = random.Random(width)
    more = []
    for n in range(5, 41):  # a text, and copies that differ by one or two words
        w = [f"v{rnd.randint(0, 10 ** 6)}" for _ in range(n)]
        more += [" ".join(x) for x in (w, [*w, "x"], ["y", *w, "z"], ["q", *w[1:]], [*w[:-2], "r", "s"])]
    got = near_dup.groups(make_docs(spark, more), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(more, width, percent)


@pytest.mark.parametrize("shared,alone", [(6, 1), (90, 14), (400, 65), (2000, 300)])
def test_links_pass_the_estimate(shared, alone):
    rng = np.random.default_rng(shared)
    for _ in range(200):
        keys = np.sort(rng.integers(0, 1 << 63, shared + alone).astype(np.uint64))
        few = np.sort(rng.choice(keys, shared, replace=False))
        reg = near_dup.sketch(np.array([0, len(keys), len(keys) + shared]), np.concatenate([keys, few]))
        n = np.array([len(keys)]), np.array([shared])
        assert near_dup.near(*n, reg[:1], reg[1:], 85)[0]
        assert near_dup.estimate(*n, reg[:1], reg[1:])[0] > shared / len(keys) - near_dup.SLACK


@pytest.mark.parametrize("shared,alone,percent", [(6, 1, 85), (12, 2, 85), (4, 1, 80), (23, 4, 85), (60, 15, 80)])
def test_linked_small_sets_share_a_key(shared, alone, percent):
    rng = np.random.default_rng(shared)
    for _ in range(400):
        keys = np.sort(rng.integers(0, 1 << 63, shared + alone).astype(np.uint64))
        few = np.sort(rng.choice(keys, shared, replace=False))
        bounds, both = np.array([0, len(keys), len(keys) + shared]), np.concatenate([keys, few])
        row, key = near_dup.band_keys(np.diff(bounds), near_dup.sketch(bounds, both),
                                      near_dup.smallest(bounds, both, percent), percent)
        assert np.isin(key[row == 0], key[row == 1]).any()


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_variants_near_the_bound_keep_their_components(spark, width, percent):
    """Groups around one text whose members are partly linked, only to each other, or to nothing."""
    rnd = random.Random(7 * width)
    more = []
    for size in (60, 200):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(size)]
        for _ in range(110):
            w = list(base)
            for _ in range(rnd.randint(0, size // 9)):
                w[rnd.randrange(size)] = f"z{rnd.randint(0, 30)}"
            more.append(" ".join(w))
        for _ in range(6):      # small families away from the base
            far = list(base)
            for _ in range(size // 7):
                far[rnd.randrange(size)] = f"f{rnd.randint(0, 10 ** 6)}"
            more += [" ".join(far), " ".join([*far[:-1], "end"])]
    got = near_dup.groups(make_docs(spark, more), width, percent).collect()
    want = brute_groups(more, width, percent)
    assert len({c for _, c in want.values()}) > 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_rows_that_repeat_an_id_go_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, c), (6, b + " more"), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in near_dup.keep_representatives(docs).collect()))
    assert kept == sorted([(0, b), (1, a), (5, b), (6, c)])
    got = near_dup.groups(docs).collect()
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.groups(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4)]
    assert near_dup.keep_representatives(docs).count() == 6
    assert near_dup.groups(docs.limit(0)).count() == 0


def test_url_lists(spark):
    ts = "2024-{}-{} 00:00:00".format
    entries = spark.createDataFrame([
        ("l", "bad.org", "add", ts("01", "10")), ("l", "bad.org", "remove", ts("03", "01")), ("l", "bad.org", "add", ts("03", "01")),
        ("m", "x.bad.org", "add", ts("02", "01")), ("m", "ok.org/de", "add", ts("02", "01")), ("m", None, "add", ts("02", "01")),
        ("m", "x.bad.org", "add", ts("02", "01")), ("c", "Case.org", "add", ts("01", "10")), ("c", "case.ORG", "remove", ts("02", "10")),
        ("c", "OK.org/DE", "add", ts("01", "10"))], "list string, pattern string, action string, d string").selectExpr(
        "list", "pattern", "action", "to_timestamp(d) dated_at", "'clash' as host")
    captures = spark.createDataFrame([
        (1, "http://X.bad.org/a", ts("01", "09")), (2, "http://x.bad.org:80/a", ts("01", "10")), (3, "https://bad.org", ts("02", "28")),
        (4, "https://u@x.bad.org/", ts("03", "01")), (5, "http://ok.org/de/1", ts("04", "01")), (6, "http://ok.org/en", ts("04", "01")),
        (10, "http://case.org/x", ts("02", "01")), (11, "http://CASE.org/x", ts("03", "01")), (12, "http://ok.org/DE/x", ts("02", "02")),
        (7, None, ts("04", "01")), (8, "http://bad.org/", None), (9, "junk", ts("04", "01")), (3, "https://bad.org", ts("02", "28"))],
        "page_id long, url string, d string").selectExpr("page_id", "url", "to_timestamp(d) fetched_at")
    got = sorted((r.page_id, r.matches) for r in url_filter.blocked(captures, entries).collect())
    assert got == [(1, ""), (2, "l:bad.org"), (3, "l:bad.org"), (3, "l:bad.org"), (4, "m:x.bad.org"), (5, "m:ok.org/de"),
                   (6, ""), (7, ""), (8, ""), (9, ""), (10, "c:case.org"), (11, ""), (12, "c:ok.org/DE")]
    assert url_filter.keep_allowed(captures, entries.limit(0)).count() == 13
    assert url_filter.blocked(captures.limit(0), entries).count() == 0


def brute_hits(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for i, t in enumerate(texts):
        w, hit, ids = split(t), set(), set()
        for name, text in items:
            x = split(text)
            k = min(13, len(x))
            for j in range(len(x) - k + 1 if k else 0):
                for s in range(len(w) - k + 1):
                    if w[s:s + k] == x[j:j + k]:
                        hit.update(range(s, s + k))
                        ids.add(str(name))
        out[i] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("part_words", [4_000_000, 20])
def test_contamination(spark, texts, part_words):
    items = [(1, " ".join((texts[3] + " pad pad pad").split()[2:20])), (10, "one two"), (2, "ONE, Two!"), (3, None), (4, "--"),
             (5, "lorem lorem lorem")]
    more = [*texts, "so one two go one two", texts[8] + " " + items[0][1].upper() + " . " + texts[9]]
    docs = make_docs(spark, more)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.with_hits(docs, bench, 13, part_words).collect()
    want = brute_hits(more, items)
    hits = {r.doc_id: r[decontaminate.HIT_COLUMN] for r in got}
    assert {i: (h.n_words, h.n_hit, list(h.item_ids)) for i, h in hits.items()} == want
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, (n, k, _) in want.items() if not (k and 20 * k >= n)}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[len(texts)] == "so  go " and cut[0] == texts[0]
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_pipeline_stages(spark, texts, tmp_path):
    rnd = random.Random(9)
    long = [" ".join(f"w{rnd.randint(0, 200)}" for _ in range(80)) for _ in range(12)]
    secret = long[0] + " token = \"abcdefgh12345678\""
    bench = " ".join(long[3].split()[10:30])
    more = [*long, long[1], long[2] + " tail", secret.replace("w1", "v"), None, "short text"]
    make_docs(spark, more).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(15)] + [(16, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
        seen.append({r.doc_id: r.text for r in out.collect()})
    assert not {15, 16} & set(seen[0]) and len(seen[0]) >= 14
    assert not {12, 13} & set(seen[1]) and {0, 1, 2, 3} <= set(seen[1])
    assert 3 not in seen[2] and {0, 1, 2} <= set(seen[2])
    assert "[SECRET]" in seen[3][14] and "abcdefgh12345678" not in seen[3][14] and seen[3][0] == seen[2][0]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= set(seen[3]) and all(r.mix_copies >= 1 for r in final)
