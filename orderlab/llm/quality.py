"""Quality rules: hashed n-gram log-likelihood ratio between a trusted-target and
the raw-corpus multinomial.

``fit`` counts hashed word unigrams and bigrams (``buckets`` classes) of every
document for the raw multinomial, and of the trusted labelled documents (quality
1) for the target multinomial.  A document's score is the mean over its n-grams of
log p_target - log p_raw, so it does not depend on length.  The threshold is
fixed from the scores of all labelled documents: the point that best separates the
two label classes among those that keep at least ``keep_trusted`` of the trusted
documents.  Labels meet the documents in a join, and the threshold comes from scores
sorted by range with running counts, so neither labels nor scores pass through the
driver.  Every document is then judged by the same numbers: kept unless the base
rules fail or its score is below the threshold.

Edge cases: null and empty texts have no words, so they fail the base rules; a text
with fewer than 8 words has no windows; a document with no n-gram scores 0; with no
labels the target equals the raw corpus and the threshold is -inf; labels of
unknown documents, null or repeated label rows are ignored; extra columns are left
alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from zlib import crc32

from orderlab.llm.common import WORDS, Words, covered, cut, discard, rows, steps, written

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

STATS = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                   ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_grams", pa.int64()),
                   ("llr", pa.float64())])
STATS_DDL = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
             "n_grams bigint, llr double")
STATS_COLUMN = "__quality"


@dataclass(frozen=True)
class QualityModel:
    ratio: np.ndarray      # log p_target - log p_raw of each bucket
    threshold: float


def gram_buckets(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of neighbouring words of a row."""
    if not len(w.code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.array([crc32(v) for v in w.vocab.to_pylist()], np.uint64)[w.code]
    pair = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    with np.errstate(over="ignore"):
        two = (h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    one = (h * np.uint64(0xD6E8FEB86659FD93))
    keys = np.concatenate([one, two]) >> np.uint64(40)
    return np.concatenate([w.doc, w.doc[pair]]), (keys % np.uint64(buckets)).astype(np.int64)


def repeated_words(w: Words) -> np.ndarray:
    """Per row: words inside 8-word windows that occur twice or more in the row."""
    n = len(w.code) - WINDOW + 1
    out = np.zeros(len(w.counts), np.int64)
    if n <= 0:
        return out
    at = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1:])
    with np.errstate(over="ignore"):
        key = w.doc[at].astype(np.uint64)
        for j in range(WINDOW):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w.code[at + j].astype(np.uint64)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twin = np.zeros(len(at), bool)
    twin[1:] |= same
    twin[:-1] |= same
    at = np.sort(at[order[twin]])
    if not len(at):
        return out
    # the hash only proposes; equal windows are confirmed on the words themselves
    table = np.column_stack([w.doc[at], *(w.code[at + j] for j in range(WINDOW))]).astype(np.int64)
    order = np.lexsort(table.T[::-1])
    same = (table[order][1:] == table[order][:-1]).all(axis=1)
    twin = np.zeros(len(at), bool)
    twin[1:] |= same
    twin[:-1] |= same
    at = at[order[twin]]
    mask = covered(len(w.code), at, WINDOW)
    return np.bincount(w.doc[mask], minlength=len(out))


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _stats(batch: pa.RecordBatch, ratio: np.ndarray) -> pa.StructArray:
    w = Words(batch.column("text"), WORDS)
    n = batch.num_rows
    row, bucket = gram_buckets(w, len(ratio))
    grams = np.bincount(row, minlength=n)
    llr = np.bincount(row, ratio[bucket], minlength=n) / np.maximum(grams, 1)
    values = (w.counts, w.per_row(w.inside & ((w.raw & 0xC0) != 0x80)), w.per_row(SYMBOLS[w.raw]),
              [repeated_lines(t) for t in batch.column("text").to_pylist()], repeated_words(w), grams, llr)
    return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, STATS, strict=True)],
                                      fields=list(STATS))


def with_stats(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` plus STATS_COLUMN (base counters and score), in one narrow pass."""
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)
    schema = T.StructType([*docs.schema.fields, T.StructField(STATS_COLUMN, T.StructType.fromDDL(STATS_DDL))])

    def run(batches):
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, _stats(batch, ratio.value)],
                                             names=[*batch.schema.names, STATS_COLUMN])

    return docs.mapInArrow(run, schema)


def base_failed():
    q = STATS_COLUMN
    return (F.col(f"{q}.n_words") < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * F.col(f"{q}.n_words"))


def verdict(model: QualityModel):
    return ~base_failed() & (F.col(f"{STATS_COLUMN}.llr") >= F.lit(float(model.threshold)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, text) of every document with a label; of repeated label rows the lowest counts.
    Labels grow with the documents, so both sides are shuffled at any size."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(one.hint("merge"), "doc_id").select("quality", "text")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, keep_trusted: float = 0.995) -> QualityModel:
    """Count both multinomials over the documents and set the threshold."""
    spark = docs.sparkSession
    known, path = written(labelled(docs, labels), "labelled")
    try:
        target = _bucket_counts(known.where("quality = 1"), buckets)
        if not target.sum():
            return QualityModel(np.zeros(buckets), -np.inf)
        raw = _bucket_counts(docs, buckets)
        ratio = (np.log(target + 1) - np.log(target.sum() + buckets)) - (np.log(raw + 1) - np.log(raw.sum() + buckets))
        return QualityModel(ratio, _threshold(known, ratio, keep_trusted))
    finally:
        discard(spark, path)


def _bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """N-grams of ``texts`` in each bucket."""
    out = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for batch in steps(batches):
            n += np.bincount(gram_buckets(Words(batch.column("text"), WORDS), buckets)[1], minlength=buckets)
        some = np.flatnonzero(n)
        yield rows(out, some, n[some])

    total = np.zeros(buckets)
    sums = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n"))
    for b, n in sums.collect():  # at most ``buckets`` rows
        total[b] = n
    return total


def _threshold(known: DataFrame, ratio: np.ndarray, keep_trusted: float) -> float:
    """Best separating score among those that keep ``keep_trusted`` of the trusted
    documents; -inf without a low-quality label."""
    log_ratio = known.sparkSession.sparkContext.broadcast(ratio)
    out = pa.schema([("quality", pa.int32()), ("llr", pa.float64())])

    def scores(batches):
        for step in steps(batches):
            yield rows(out, step.column("quality"), _stats(step, log_ratio.value).field("llr"))

    is_good, is_bad = ((F.col("quality") == q).cast("long") for q in (1, 0))
    each = (known.mapInArrow(scores, "quality int, llr double").groupBy("llr")
            .agg(F.sum(is_good).alias("good"), F.sum(is_bad).alias("bad")))
    # distinct scores in order: each partition holds one range of them
    ranges = cut(each.repartitionByRange("llr").withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()
    n_good, n_bad = (sum(r[c] for r in sums) for c in ("good", "bad"))  # one row per partition
    if not n_good or not n_bad:
        return -np.inf
    before, lower = [], (0, 0)
    for r in sums:
        before.append((r["part"], *lower))
        lower = (lower[0] + r["good"], lower[1] + r["bad"])
    before = known.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long")
    up_to = Window.partitionBy("part").orderBy("llr").rowsBetween(Window.unboundedPreceding, -1)
    below = [(F.coalesce(F.sum(c).over(up_to), F.lit(0)) + F.col(f"{c}_before")).alias(f"{c}_below") for c in ("good", "bad")]
    ordered = ranges.join(F.broadcast(before), "part").select("llr", "good", "bad", *below)
    # the trusted score with this many trusted ones below it, and no cut above it
    rank = int((1 - keep_trusted) * n_good)
    gain = F.col("bad_below") / n_bad - F.col("good_below") / n_good
    best = ordered.where(F.col("good_below") <= rank).agg(F.max(F.struct(gain.alias("gain"), (-F.col("llr")).alias("llr"))))
    at = -best.first()[0]["llr"]  # of equal gains the lowest score
    last_bad = ranges.where((F.col("bad") > 0) & (F.col("llr") < at)).agg(F.max("llr")).first()[0]
    return at if last_bad is None else (last_bad + at) / 2  # halfway into the gap: clean texts get the benefit


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the base counters, the score and the verdict of every document."""
    return with_stats(docs.select("doc_id", "text"), model).select(
        "doc_id", f"{STATS_COLUMN}.*", base_failed().alias("base_failed"), verdict(model).alias("kept"))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The kept documents, unchanged."""
    return with_stats(docs, model).where(verdict(model)).select(*docs.columns)
