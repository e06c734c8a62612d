"""every label counts, in the multinomial of the trusted documents and in the threshold."""
import numpy as np
import pytest

from orderlab.llm import quality
from orderlab.llm.common import WORDS, Words

import pyarrow as pa


def plain_threshold(good, bad, keep):
    good, bad = np.sort(good), np.sort(bad)
    top = good[int((1 - keep) * len(good))]
    cuts = np.unique(np.concatenate([bad[bad <= top], good[good <= top]]))
    gain = np.searchsorted(bad, cuts, "left") / len(bad) - np.searchsorted(good, cuts, "left") / len(good)
    cut = float(cuts[int(np.argmax(gain))])
    below = bad[bad < cut]
    return (float(below[-1]) + cut) / 2 if len(below) else cut


def test_labels_beyond_any_sample_size_count(spark):
    # 20,500 trusted texts, more than the old sample of 20,000
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('only', id) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    some = quality.fit(docs, labels, buckets=64)
    assert some.ratio == pytest.approx(np.zeros(64), abs=1e-12)  # trusted and raw corpus are the same


@pytest.mark.parametrize("keep", [0.995, 0.7, 0.2])
def test_threshold_is_that_of_all_scores(spark, keep):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60)])
    texts = [" ".join(rng.choice(words[:40] if i % 3 else words[20:], rng.integers(1, 30))) for i in range(400)] + [None, ""]
    docs = spark.createDataFrame([*enumerate(texts), (None, "w1 w2"), (5, "w1 w30")], "doc_id long, text string")
    rows = [(i, int(i % 3 > 0)) for i in range(0, 402, 2)] + [(4, 0), (4, 1), (None, 1), (7, None), (9, 5), (99_999, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality.fit(docs, labels, buckets=512, keep_trusted=keep)
    known = {}
    for i, q in rows:
        if i is not None and q in (0, 1):
            known[i] = min(q, known.get(i, 1))
    all_docs = [*enumerate(texts), (None, "w1 w2"), (5, "w1 w30")]

    def counts(ts):
        return np.bincount(quality.gram_buckets(Words(pa.array(ts, pa.string()), WORDS), 512)[1], minlength=512)

    raw = counts([t for _, t in all_docs])
    target = counts([t for i, t in all_docs if known.get(i) == 1])
    ratio = (np.log(target + 1) - np.log(target.sum() + 512)) - (np.log(raw + 1) - np.log(raw.sum() + 512))
    assert np.array_equal(model.ratio, ratio)
    llr = {q: [] for q in (0, 1)}
    for i, t in all_docs:
        if i in known:
            row, bucket = quality.gram_buckets(Words(pa.array([t], pa.string()), WORDS), 512)
            llr[known[i]].append(np.bincount(row, ratio[bucket], minlength=1)[0] / max(len(row), 1))
    assert model.threshold == plain_threshold(llr[1], llr[0], keep)


def test_one_class_alone_sets_no_threshold(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), 64).threshold == -np.inf
    assert quality.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, quality int"), 64).threshold == -np.inf
