"""Ranked lexical search: the best documents of every query item, exactly.

A term's weight falls with its document frequency, its gain in a document grows with
its count ``tf`` and falls with the document's length measure ``m``; a document's score
is the sum of weight times gain over the item's terms (``gain`` and ``weights`` below).

1. *Restricted vectors.*  One pass over the whole texts counts, per document, its terms
   and the counts of those terms that any item asks for.  The vectors are a table; the
   number of documents, their length and the document frequencies come from it.
2. *Document FP-tree.*  A task turns its vectors into trees.  A vector lists its terms by
   falling document frequency, so that documents share the paths of their frequent terms;
   in the order of the paths, every subtree is a run of documents.  A subtree keeps, for
   each term, the largest ``tf``, and the smallest ``m``.
3. *Branch and bound.*  An item walks the tree depth first, best child first.  The sum of
   weight times gain at the subtree's largest counts and smallest ``m`` is a bound for its
   documents (the gain rises with tf and falls with m); subtrees whose bound is below the
   item's last place so far are left out.  The documents of a leaf are scored exactly.
   The places of an item are carried over from tree to tree of a task.
4. *Merging.*  Tasks return at most ``top`` rows an item; they are ranked within parts of
   each item first, so that no task gets all of an item's rows.

The items' terms are sent to the tasks in parts of at most ``part_terms`` entries (one
scan of the vectors each), so what is sent does not grow with the documents.

Edge cases: null and empty texts have no term and are never found; rows that repeat a
``doc_id`` are documents of their own, and a null ``doc_id`` comes last among equal
scores; rows that repeat an ``item_id`` are one item with the terms of all; items with a
null id or without a term give no row; extra columns are left alone; empty tables give
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlab.llm.common import ALNUM_LOWER, Words, materialize, steps

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TREE_DOCS = 1 << 14        # documents of a tree
TREE_ENTRIES = 1 << 21     # vector entries of a tree
LEAF = 256                 # most documents of a leaf
MERGE_PARTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Saturating count of a term, in millionths."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Thousandths of the logarithm of a term's rarity, rounded down."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item."""
    found = F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return (benchmark.where("item_id is not null").select("item_id", F.explode(found).alias("term")).distinct()
            .groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")))


def item_parts(benchmark: DataFrame, part_terms: int) -> Iterator[list]:
    """Items in lists of at most ``part_terms`` terms (one item at least), read one
    partition at a time."""
    part, size = [], 0
    for item, terms in items_of(benchmark).toLocalIterator():
        if part and size + len(terms) > part_terms:
            yield part
            part, size = [], 0
        part.append((item, terms))
        size += len(terms)
    if part:
        yield part


# ---------------------------------------------------------------- restricted vectors

VECTOR_DDL = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                    ("tfs", pa.list_(pa.int32()))])


def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its number of terms with
    repeats, and the places in ``vocabulary`` and counts of the terms in it."""
    known = docs.sparkSession.sparkContext.broadcast([t.encode() for t in vocabulary])
    size = max(len(vocabulary), 1)

    def run(batches):
        values = pa.array(known.value, pa.large_binary())
        for batch in steps(batches):
            w = Words(batch.column("text"), ALNUM_LOWER)
            place = pc.fill_null(pc.index_in(w.vocab, value_set=values), -1).to_numpy().astype(np.int64)
            term = place[w.code] if len(w.code) else np.zeros(0, np.int64)
            hit = term >= 0
            key, tf = np.unique(w.doc[hit] * size + term[hit], return_counts=True)
            cut = np.searchsorted(key // size, np.arange(batch.num_rows + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(w.counts, pa.int64()),
                pa.ListArray.from_arrays(cut, pa.array(key % size, pa.int32())),
                pa.ListArray.from_arrays(cut, pa.array(tf, pa.int32()))], schema=VECTOR)
            yield out.filter(pa.array(w.counts > 0))

    return docs.select("doc_id", "text").mapInArrow(run, VECTOR_DDL)


# ---------------------------------------------------------------- the tree

def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class Tree:
    """FP-tree of vectors (``lens`` entries each of ``term``, ascending, and ``tf``).

    Documents stand in the order of their paths.  ``low, high`` are the documents of each
    walk node, ``children`` its nodes (none: a leaf), ``most`` and ``least`` the largest
    tf per term and the smallest m below it.
    """

    def __init__(self, doc: np.ndarray, m: np.ndarray, lens: np.ndarray, term: np.ndarray, tf: np.ndarray):
        starts = np.cumsum(lens) - lens
        big = term.astype(">u4").tobytes()
        paths = [big[4 * a:4 * (a + k)] for a, k in zip(starts.tolist(), lens.tolist(), strict=True)]
        order = np.array(sorted(range(len(lens)), key=paths.__getitem__), np.int64)
        at = _ranges(starts[order], lens[order])
        self.doc, self.m, lens = doc[order], m[order], lens[order]
        term, self.tf = term[at], tf[at]
        starts = np.cumsum(lens) - lens
        row = np.repeat(np.arange(len(lens)), lens)
        self.terms, self.term = np.unique(term, return_inverse=True)  # terms of this tree
        self.low, self.high, self.children = [0], [len(lens)], [[]]
        self._walk_nodes(*self._nodes(starts, lens, term, row))
        leaves = [i for i, c in enumerate(self.children) if not c]
        leaves.sort(key=self.low.__getitem__)
        self.leaf = {node: k for k, node in enumerate(leaves)}
        self._bounds(np.array([self.low[i] for i in leaves], np.int64), row)

    def _nodes(self, starts, lens, term, row):
        """First document and number of documents of every trie node, in preorder."""
        depth = np.arange(len(term)) - np.repeat(starts, lens)
        shared = np.zeros(len(term), bool)                    # the path so far is the one of the document before
        both = np.minimum(lens[1:], lens[:-1])
        here, there = _ranges(starts[1:], both), _ranges(starts[:-1], both)
        shared[here] = term[here] == term[there]
        broken = np.zeros(len(term) + 1, np.int64)
        np.cumsum(~shared, out=broken[1:])
        shared = broken[1:] == broken[np.repeat(starts, lens)]
        level = np.lexsort((row, depth))                      # a node's entries stand together
        first = np.flatnonzero(~shared[level])
        size = np.diff(first, append=len(level))
        begin, deep = row[level[first]], depth[level[first]]
        pre = np.lexsort((deep, begin))
        return begin[pre], size[pre]

    def _walk_nodes(self, begin, size):
        """Inner nodes: subtrees of over LEAF documents that hold at most three quarters of
        the inner node above.  What they leave is cut into leaves of at most LEAF."""
        open_ = [0]
        for a, n in zip(begin[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            while a >= self.high[open_[-1]]:
                open_.pop()
            up = open_[-1]
            if 4 * n <= 3 * (self.high[up] - self.low[up]):
                open_.append(self._add(up, a, a + n))
        for node in range(len(self.low)):
            at, inner = self.low[node], self.children[node]
            if not inner and self.high[node] - at <= LEAF:
                continue
            self.children[node] = []
            for child in [*inner, None]:
                end = self.high[node] if child is None else self.low[child]
                for a in range(at, end, LEAF):
                    self._add(node, a, min(a + LEAF, end))
                if child is not None:
                    self.children[node].append(child)
                    at = self.high[child]

    def _add(self, up: int, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        self.children[up].append(len(self.low) - 1)
        return len(self.low) - 1

    def _bounds(self, leaf_low, row):
        width = len(self.terms)
        leaf = np.searchsorted(leaf_low, row, side="right") - 1
        top = np.zeros(len(leaf_low) * width, np.int64)
        np.maximum.at(top, leaf * width + self.term, self.tf)
        top = top.reshape(len(leaf_low), width)
        low_m = np.minimum.reduceat(self.m, leaf_low)
        edge = np.append(leaf_low, len(self.m))
        a = np.searchsorted(edge, self.low)
        b = np.searchsorted(edge, self.high)
        self.most = np.array([top[i:j].max(axis=0) for i, j in zip(a, b, strict=True)], np.int32)
        self.least = np.array([low_m[i:j].min() for i, j in zip(a, b, strict=True)], np.int64)
        # entries by term, then document; ``cut`` limits those of each leaf and term
        by_term = np.lexsort((row, self.term))
        self.row, self.tf, term = row[by_term], self.tf[by_term].astype(np.int64), self.term[by_term]
        n = len(self.m)
        key = term * (n + 1) + self.row
        self.cut = np.searchsorted(key, (np.arange(width) * (n + 1))[None, :] + edge[:, None])

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offers ``best`` every document that can be among its places."""
        at = np.searchsorted(self.terms, terms)
        at = np.minimum(at, len(self.terms) - 1)
        here = self.terms[at] == terms
        cols, w = at[here], weight[here]
        if not len(cols):
            return

        def bounds(nodes):
            tf = self.most[np.ix_(nodes, cols)].astype(np.int64)
            return (w * gain(tf, self.least[nodes][:, None])).sum(axis=1)

        stack = [(0, int(bounds([0])[0]))]
        while stack:
            node, bound = stack.pop()
            if bound < best.least:
                continue
            inner = self.children[node]
            if inner:
                b = bounds(inner)
                stack += [(inner[i], int(b[i])) for i in np.argsort(b, kind="stable") if b[i] >= best.least]
                continue
            k = self.leaf[node]
            first, last = self.cut[k, cols], self.cut[k + 1, cols]
            entry = _ranges(first, last - first)
            row, low = self.row[entry], self.low[node]
            score = np.zeros(self.high[node] - low, np.int64)
            np.add.at(score, row - low, np.repeat(w, last - first) * gain(self.tf[entry], self.m[row]))
            good = np.flatnonzero(score >= best.least)
            if len(good):
                best.offer(score[good], self.doc[good + low])


class Best:
    """The ``top`` highest scores above 0 so far, equal ones by document."""

    def __init__(self, top: int):
        self.top, self.least = top, 1       # smallest score that can still enter
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        self.score, self.doc = np.append(self.score, score), np.append(self.doc, doc)
        if len(self.score) >= self.top:
            order = np.lexsort((self.doc, -self.score))[:self.top]
            self.score, self.doc = self.score[order], self.doc[order]
            self.least = max(1, int(self.score[-1]))


LAST = np.iinfo(np.int64).max       # stands for a null doc_id: last among equal scores


def _search(found: DataFrame, items: list, terms_of: list, weight: np.ndarray, rank: np.ndarray,
            n_docs: int, length: int, top: int) -> DataFrame:
    """Rows (item, doc_id, score): the best documents of every item in every task."""
    sent = found.sparkSession.sparkContext.broadcast((terms_of, weight, rank))
    out = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        terms_of, weight, rank = sent.value
        by_rank = np.empty_like(weight)
        by_rank[rank] = weight
        queries = [np.sort(rank[t]) for t in terms_of]
        best = [Best(top) for _ in queries]
        for doc, n, lens, term, tf in _blocks(batches):
            term = rank[term].astype(np.int64)
            order = np.lexsort((term, np.repeat(np.arange(len(lens)), lens)))
            m = 50 + 50 * n * n_docs // length
            tree = Tree(doc, m, lens, term[order], tf[order])
            for terms, b in zip(queries, best, strict=True):
                tree.search(terms, by_rank[terms], b)
        for i, b in enumerate(best):
            if len(b.doc):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(b.doc), i), pa.int32()), pa.array(b.doc, pa.int64(), mask=b.doc == LAST),
                    pa.array(b.score)], schema=out)

    return found.mapInArrow(run, "item int, doc_id bigint, score bigint")


def _blocks(batches):
    """Vectors with an entry, in blocks of at most TREE_DOCS documents and about TREE_ENTRIES entries."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(1024, TREE_DOCS - docs))
            held.append(part)
            at += part.num_rows
            docs += part.num_rows
            entries += len(part.column("terms").flatten())
            if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield from _block(held)
                held, docs, entries = [], 0, 0
    yield from _block(held)


def _block(held):
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    lens = pc.list_value_length(t["terms"]).to_numpy().astype(np.int64)
    t, lens = t.filter(pa.array(lens > 0)), lens[lens > 0]
    if not len(lens):
        return
    yield (pc.fill_null(t["doc_id"], LAST).to_numpy(), t["n"].to_numpy(), lens,
           pc.list_flatten(t["terms"]).to_numpy(), pc.list_flatten(t["tfs"]).to_numpy())


def search(docs: DataFrame, benchmark: DataFrame, top: int = 50, part_terms: int = 1_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``top`` documents with the
    highest scores above 0."""
    spark = docs.sparkSession
    out = None
    for items in item_parts(benchmark, part_terms):
        vocabulary = sorted({t for _, terms in items for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        found = materialize(vectors(docs, vocabulary), "vectors")
        n_docs, length = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)  # bounded by the items' terms
        for term, count in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[term] = count
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        terms_of = [np.array([place[t] for t in terms], np.int64) for _, terms in items]
        hits = _search(found, items, terms_of, weights(df, n_docs), rank, n_docs, length, top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)],
                                      f"item int, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        one = hits.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return benchmark.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                                               F.lit(0).cast("long").alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
    some = out.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order)))
    last = some.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return last.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ws FROM documents),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT count(*) AS nd, CAST(sum(len(ws)) AS BIGINT) AS total FROM d WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT r, doc_id, 50 + (50 * len(ws) * nd) // total AS m FROM d, s WHERE len(ws) > 0),
score AS (
  SELECT b.item_id, tf.r, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
  FROM b JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY b.item_id, tf.r),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM score JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
