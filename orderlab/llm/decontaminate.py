"""Benchmark decontamination by n-gram hash sets.

Test items become windows of ``ngram`` normalised words (a shorter item is one
window).  Their word list and window hashes are a broadcast set; each task scans
the token windows of its documents against it, verifies every hash hit word by
word, and marks the words inside verified windows.

The broadcast is bounded: items are taken in parts of at most ``part_words``
words, one scan of the documents per part, so a benchmark of any size is handled
(a normal benchmark is one part).  With several parts the hit positions are kept
as ranges and united per document.

Edge cases: a null or empty text has no words, no hits and is not contaminated; an
item without words is ignored; an item repeated under several ids reports all of
its ids; an empty benchmark hits nothing; extra columns are ignored; rows with
a repeated or null ``doc_id`` are each judged on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlab.llm.common import ALNUM_LOWER, Words, covered, materialize, steps

MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))

# What a scan adds to each document: word positions of hit ranges (end exclusive), item ids as strings.
HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_from", pa.list_(pa.int64())),
                  ("hit_to", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.string()))])
HITS_DDL = "struct<n_words:bigint,n_hit:bigint,hit_from:array<bigint>,hit_to:array<bigint>,item_ids:array<string>>"
HIT_COLUMN = "__benchmark_hits"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.ones(n + 1, np.uint64)
    down = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        up[1:] = np.cumprod(np.full(n, MULT, np.uint64))
        down[1:] = np.cumprod(np.full(n, INVERSE, np.uint64))
    return up, down


def window_keys(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit key of each window of ``width`` ids, from one running sum."""
    with np.errstate(over="ignore"):
        up, down = _powers(len(ids))
        sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return (sums[width:] - sums[:-width]) * down[:len(ids) - width + 1]


class GramIndex:
    """Windows of some benchmark items: word list, and per window width the sorted
    window keys, one place of each in ``ids`` and the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], ngram: int):
        w = Words(pa.array([t for _, t in items], pa.string()), ALNUM_LOWER)
        self.names = [i for i, _ in items]
        self.vocab = w.vocab
        self.ids = w.code.astype(np.int64)
        found: dict[int, tuple[list, list, list]] = {}
        for k in range(len(items)):
            lo, hi = w.bounds[k], w.bounds[k + 1]
            width = min(ngram, hi - lo)
            if not width:
                continue
            keys = window_keys(self.ids[lo:hi], width)
            part = found.setdefault(int(width), ([], [], []))
            part[0].append(keys)
            part[1].append(np.arange(lo, lo + len(keys)))
            part[2].append(np.full(len(keys), k))
        self.widths = {}
        for width, (keys, places, owners) in found.items():
            keys, places, owners = map(np.concatenate, (keys, places, owners))
            order = np.argsort(keys, kind="stable")
            self.widths[width] = (keys[order], places[order], owners[order])

    def hits(self, ids: np.ndarray, doc: np.ndarray):
        """Yield (position, width, item) arrays of verified window matches in the
        id stream ``ids`` (-1: not a benchmark word); windows stay inside a row."""
        for width, (keys, places, owners) in self.widths.items():
            if len(ids) < width:
                continue
            bad = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(ids < 0, out=bad[1:])
            n = len(ids) - width + 1
            at = np.flatnonzero((bad[width:] == bad[:-width]) & (doc[:n] == doc[width - 1:]))
            if not len(at):
                continue
            key = window_keys(ids, width)[at]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # one row per (window, entry with that key); only windows of real benchmark text get here
            entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(at, count)
            same = np.ones(len(at), bool)
            for j in range(width):
                same &= ids[at + j] == self.ids[places[entry] + j]
            yield at[same], width, owners[entry[same]]


def _words_in(gram: GramIndex, column: pa.Array) -> tuple[Words, np.ndarray]:
    w = Words(column, ALNUM_LOWER)
    known = pc.fill_null(pc.index_in(w.vocab, value_set=gram.vocab), -1).to_numpy(zero_copy_only=False)
    return w, known.astype(np.int64)[w.code] if len(w.code) else np.zeros(0, np.int64)


def _scan(docs: DataFrame, items: list[tuple[str, str]], ngram: int) -> DataFrame:
    """``docs`` with the hits against ``items`` in HIT_COLUMN, in one narrow pass."""
    index = docs.sparkSession.sparkContext.broadcast(GramIndex(items, ngram))
    schema = T.StructType([*docs.schema.fields, T.StructField(HIT_COLUMN, T.StructType.fromDDL(f"h {HITS_DDL}")[0].dataType)])

    def run(batches):
        gram = index.value
        for batch in steps(batches):
            w, ids = _words_in(gram, batch.column("text"))
            n = batch.num_rows
            starts: list = [[] for _ in range(n)]
            ends: list = [[] for _ in range(n)]
            found: list = [set() for _ in range(n)]
            n_hit = np.zeros(n, np.int64)
            parts = [(at, np.full(len(at), width), item) for at, width, item in gram.hits(ids, w.doc)]
            if parts:
                at, width, item = map(np.concatenate, zip(*parts, strict=True))
                for d, i in zip(w.doc[at].tolist(), item.tolist(), strict=True):
                    found[d].add(gram.names[i])
                mask = covered(len(ids), at, width)
                n_hit = np.bincount(w.doc[mask], minlength=n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                for lo, hi in edge.reshape(-1, 2).tolist():
                    while lo < hi:  # a run may go on into the next row's first words
                        d = w.doc[lo]
                        to = min(hi, w.bounds[d + 1])
                        starts[d].append(lo - w.bounds[d])
                        ends[d].append(to - w.bounds[d])
                        lo = to
            hits = pa.StructArray.from_arrays(
                [pa.array(v, t.type) for v, t in zip((w.counts, n_hit, starts, ends, map(sorted, found)), HITS,
                                                     strict=True)], fields=list(HITS))
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, HIT_COLUMN])

    return docs.mapInArrow(run, schema)


def item_parts(benchmark: DataFrame, part_words: int):
    """Benchmark items in lists of at most ``part_words`` words (one item at least),
    read one partition at a time."""
    part, size = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").where(
            "text is not null and item_id is not null").toLocalIterator():
        words = len(text.encode().translate(ALNUM_LOWER).split())
        if part and size + words > part_words:
            yield part
            part, size = [], 0
        part.append((name, text))
        size += words
    yield part


# Unites the hit ranges that several scans found in one document.
_UNITE = """aggregate(array_sort(span), cast(array() as array<struct<hit_from:bigint,hit_to:bigint>>), (acc, s) ->
    if(size(acc) > 0 and element_at(acc, -1).hit_to >= s.hit_from,
       concat(slice(acc, 1, size(acc) - 1), array(named_struct('hit_from', element_at(acc, -1).hit_from,
              'hit_to', greatest(element_at(acc, -1).hit_to, s.hit_to)))), concat(acc, array(s))))"""


def with_hits(docs: DataFrame, benchmark: DataFrame, ngram: int = 13, part_words: int = 4_000_000) -> DataFrame:
    """``docs`` plus HIT_COLUMN.  One part: one narrow scan.  More: one scan per part
    over a keyed copy of the documents, whose hits are united per document."""
    parts = item_parts(benchmark, part_words)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _scan(docs, first, ngram)
    keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
    found = None
    for items in item_parts(benchmark, part_words):
        one = _scan(keyed.select("__row", "text"), items, ngram).select("__row", f"{HIT_COLUMN}.*")
        found = one if found is None else found.unionByName(one)
    merged = (found.withColumn("span", F.arrays_zip("hit_from", "hit_to")).groupBy("__row")
              .agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("span")).alias("span"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
              .withColumn("span", F.expr(_UNITE)))
    hits = merged.select("__row", F.struct(
        "n_words", F.expr("aggregate(span, 0L, (n, s) -> n + s.hit_to - s.hit_from)").alias("n_hit"),
        F.col("span.hit_from").alias("hit_from"), F.col("span.hit_to").alias("hit_to"), "item_ids").alias(HIT_COLUMN))
    return keyed.join(hits, "__row").drop("__row")


def _contaminated(share: int):
    n_hit = F.col(f"{HIT_COLUMN}.n_hit")
    return (n_hit > 0) & (F.lit(share) * n_hit >= F.col(f"{HIT_COLUMN}.n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, hit_from, hit_to, item_ids and the verdict: contaminated
    if a word is hit and the hit words are at least one in ``share``."""
    return with_hits(docs.select("doc_id", "text"), benchmark, ngram).select(
        "doc_id", f"{HIT_COLUMN}.*", _contaminated(share).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    return with_hits(docs, benchmark, ngram).where(~_contaminated(share)).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, ngram: int = 13) -> DataFrame:
    """Every document, without the text of its hit ranges (first to last byte of the
    words of each)."""
    hit = with_hits(docs, benchmark, ngram)

    def cut(batches):
        for batch in steps(batches):
            texts, hits = batch.column("text").to_pylist(), batch.column(HIT_COLUMN).to_pylist()
            w = Words(batch.column("text"), ALNUM_LOWER)
            for d, h in enumerate(hits):
                if not h["n_hit"]:
                    continue
                data, keep, pos = texts[d].encode(), [], 0
                for lo, hi in zip(h["hit_from"], h["hit_to"], strict=True):
                    keep.append(data[pos:w.starts[w.bounds[d] + lo] - w.offsets[d]])
                    pos = w.ends[w.bounds[d] + hi - 1] - w.offsets[d]
                texts[d] = (b"".join(keep) + data[pos:]).decode()
            at = batch.schema.get_field_index("text")
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield out.select([n for n in out.schema.names if n != HIT_COLUMN])

    return hit.mapInArrow(cut, docs.schema)


def items_digest(item_ids):
    """SHA-256 (lowercase hex) of the comma-joined ids, as a column."""
    return F.sha2(F.concat_ws(",", item_ids), 256)
