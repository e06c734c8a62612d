"""op1: an iteration moves one packed row for each block and bucket, not one row a word."""
import math
import random

from orderlab.llm import hmm_lm


def test_rows_of_an_iteration_do_not_grow_with_the_words(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    texts = [(i, " ".join(rnd.choices(words, k=1500))) for i in range(30)] + [(30, "only here"), (31, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    sent, got = [], []

    def recorded(df, name, written=hmm_lm.written):
        out = written(df, name)
        if name in ("expected-parts", "dealt"):
            sent.append(out[0].count())
        return out

    monkeypatch.setattr(hmm_lm, "written", recorded)
    for buckets in (1, 12):
        monkeypatch.setattr(hmm_lm, "BUCKETS", buckets)
        got.append({r.doc_id: r.score for r in hmm_lm.score(docs, states=2, iterations=2).collect()})
    assert len(sent) == 10 and max(sent) <= 3 * (12 + 1) + 12  # words of three blocks: about 15,000
    assert len(got[0]) == 32 and all(math.isclose(x, got[1][i], rel_tol=1e-6) for i, x in got[0].items())


def test_no_training_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert hmm_lm.score(docs, states=2, iterations=1).count() == 0


def blocks_of_words(spark, words, texts):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices([f"w{j}" for j in range(words)], k=400))) for i in range(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_counting_writes_packed_rows(spark, monkeypatch):
    wrote = {}

    def recorded(df, name, materialize=hmm_lm.materialize):
        out = materialize(df, name)
        wrote[name] = out.count()
        return out

    monkeypatch.setattr(hmm_lm, "materialize", recorded)
    assert hmm_lm.score(blocks_of_words(spark, 3000, 30), states=2, iterations=1).count() == 30
    # three blocks and two rows of its own in each bucket; a row a word would be about 3,000
    assert wrote and max(wrote.values()) <= (3 + 2) * hmm_lm.BUCKETS


def test_counts_are_those_of_the_words(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Zwei zwei été \x85x", "zwei einmal", None, " ", "nur"] * 3)],
                                 "doc_id long, text string").repartition(4)
    counted, counts, sizes = hmm_lm.word_counts(hmm_lm.materialize(hmm_lm.blocks(docs), "t"))
    want = {}
    for r in docs.collect():
        if not hmm_lm._held(r.doc_id):
            for w in [*(x.decode() for x in (r.text or "").encode().lower().split()), ""]:
                want[w] = want.get(w, 0) + 1
    assert {r.w: r.c for r in counted.collect()} == want
    assert (counts.tokens, counts.words) == (sum(want.values()), len(want))
    assert sorted(r["size"] for r in sizes.collect()) == sorted(c + 1.0 for c in want.values())


def test_an_iteration_does_not_shuffle_the_texts(spark):
    table = hmm_lm._by_block(hmm_lm.materialize(hmm_lm.blocks(blocks_of_words(spark, 50, 9)), "t").drop("vocab"))
    dealt = hmm_lm.materialize(table.selectExpr("1L AS bucket", "block", "counts AS code", "noise AS m", "noise AS size"), "t")
    plan = hmm_lm._with_dealt(table, dealt, lambda text, got: text.select(["block"]), "block bigint")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1 and "Bucketed: true" in text
    assert sorted(r.block for r in plan.collect()) == sorted(r.block for r in table.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]
