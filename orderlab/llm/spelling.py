"""Spelling variants: words at edit distance one, grouped under their frequent form.

1. *Words.*  Letter runs of the whole texts are counted (JVM side, partial aggregation).
2. *Search scheme.*  With one error (an inserted, deleted or replaced code point), one
   half of a word is free of it.  Scheme L matches the left half exactly and extends to
   the right, scheme R matches the right half and extends to the left; each allows one
   error behind its half.  Words meet in *shards* by the half itself: a word is in the
   index of a shard under the halves that words one shorter, as long or one longer would
   look for.  A half shared by more than ``SHARD`` words is cut into blocks of index
   words, and its queries go to every block.
3. *FM-index.*  A shard's task builds the Burrows-Wheeler transform of its delimited
   vocabulary.  An interval of suffix ranks stands for all words with a prefix; it is
   extended by a code point with two binary searches in the sorted (symbol, rank) keys.
   A search that starts at an end of the word extends in one direction only, so of a
   bidirectional pair scheme L needs the index of the reversed words and scheme R that of
   the words, and no second interval has to be kept in step.  Words with the same prefix
   share its interval, so the symbols that can follow are listed once per prefix, not
   once per query.
4. *Grouping.*  A shard returns one row per query: the number of near words and the most
   frequent one.  Scheme R leaves out what scheme L finds, and each word is reached by one
   placement of the error only, so every near word is counted once.  Forms are followed
   to the last by pointer doubling.

Edge cases: null and empty texts have no runs; a null ``doc_id`` is hashed as an empty
one; rows that repeat a ``doc_id`` count each; ties between forms go to the smallest word
in code-point order; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlab.llm.common import materialize
from orderlab.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD = 40_000      # index words of a shard
CHUNK = 8_000       # queries searched at a time
MORE = 10           # a form occurs at least so many times as often


def words(docs: DataFrame, shortest: int = 7, least: int = 2, noise: int = 31) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, of at least ``shortest``
    code points and ``least`` occurrences.  A run whose CRC-32 with its document's id is
    divisible by ``noise`` first loses one code point (planted misspellings)."""
    run, h = F.col("run"), F.col("h")
    # every word comes from a run at least as long, so shorter ones need not be listed
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length("run")))
    return (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
            .withColumn("h", F.crc32(F.concat("id", F.lit(":"), run).cast("binary")))
            .select(F.when(h % noise == 0, cut).otherwise(run).alias("word"))
            .where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))


# ---------------------------------------------------------------- the index of one shard

def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def code_points(column: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat code points, lengths) of the strings."""
    return (np.frombuffer("".join(column).encode("utf-32-le"), np.uint32).astype(np.int64),
            np.array([len(w) for w in column], np.int64))


class Index:
    """FM-index of words given by their codes (1 or more, ``flat`` and ``lens``), read
    from the first to the last.

    The text holds every word backwards behind no, and before one, delimiter (0); to
    prepend a symbol in the text is then to append it to a prefix.  Suffixes are ranked
    up to their delimiter, equal ones by the place of their word.
    """

    def __init__(self, flat: np.ndarray, lens: np.ndarray):
        self.count = len(lens)
        size = lens + 1
        ends = np.cumsum(size)
        n = self.n = int(ends[-1]) if len(ends) else 0
        text = np.zeros(n, np.int64)
        left = np.repeat(ends - 1, size) - np.arange(n)               # symbols up to the delimiter
        back = np.repeat(np.cumsum(lens) - lens, size) + left - 1       # the word backwards
        text[left > 0] = flat[back[left > 0]]
        rank = self._ranks(text, left)
        order = np.argsort(rank, kind="stable")
        word = np.repeat(np.arange(self.count), size)
        first = np.concatenate([[0], ends[:-1]])[word] == np.arange(n)
        self.bwt = np.where(first, 0, np.concatenate([[0], text[:-1]]))[order]
        by_symbol = np.argsort(self.bwt, kind="stable")
        self.keys = self.bwt[by_symbol] * (n + 1) + by_symbol
        self.word_at = word[order][by_symbol[:self.count]]             # words by the rank of their first suffix

    @staticmethod
    def _ranks(text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Rank of every suffix up to its delimiter: packed first symbols, then doubling."""
        n = len(text)
        if not n:
            return text
        bits = max(int(text.max()).bit_length(), 1)
        span = 62 // bits
        padded = np.concatenate([text, np.zeros(span, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(span):
            key = key << bits | np.where(left >= j, padded[j:j + n], 0)
        longest = int(left.max()) + 1
        while True:
            rank = np.unique(key, return_inverse=True)[1]
            if span >= longest:
                return rank
            later = np.minimum(np.arange(n) + span, n - 1)
            key = rank * (n + 1) + np.where(left >= span, rank[later] + 1, 0)
            span *= 2

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the prefixes one symbol longer."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def followers(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cut, symbol, low, high): the symbols that follow each interval's prefix are
        symbol[cut[i]:cut[i + 1]], with the intervals they lead to."""
        width = high - low
        owner = np.repeat(np.arange(len(low)), width)
        symbol = self.bwt[_ranges(low, width)]
        top = int(self.bwt.max()) + 1 if self.n else 1
        pair = np.unique(owner * top + symbol)
        pair = pair[pair % top > 0]
        owner, symbol = pair // top, pair % top
        lo, hi = self.step(symbol, low[owner], high[owner])
        return np.searchsorted(owner, np.arange(len(low) + 1)), symbol, lo, hi


def search(index: Index, flat: np.ndarray, lens: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): the indexed words with one error behind the first ``half`` symbols of
    each query (codes ``flat``, symbols unknown to the index included), each once."""
    starts = np.cumsum(lens + 1) - lens - 1
    code = np.zeros(int((lens + 1).sum()), np.int64)              # with a final delimiter
    code[_ranges(starts, lens)] = flat
    # exact prefixes of the queries, from their half to the whole word
    low, high = np.zeros(len(lens), np.int64), np.full(len(lens), index.count, np.int64)
    got = []
    live = np.arange(len(lens))
    for p in range(int(lens.max()) + 1 if len(lens) else 0):
        at = live[half[live] <= p]
        got.append((at, np.full(len(at), p), low[at], high[at]))
        live = live[lens[live] > p]
        low[live], high[live] = index.step(code[starts[live] + p], low[live], high[live])
        live = live[low[live] < high[live]]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, p, low, high = (np.concatenate(x) for x in zip(*got, strict=True))
    place = starts[q] + p
    # each prefix's followers once; intervals of different prefixes do not meet
    _, first, prefix = np.unique(low, return_index=True, return_inverse=True)
    cut, symbol, lo, hi = index.followers(low[first], high[first])
    width = np.diff(cut)[prefix]
    state = np.repeat(np.arange(len(q)), width)
    kid = _ranges(cut[prefix], width)
    other = symbol[kid] != code[place[state]]
    state, kid = state[other], kid[other]
    inside = p < lens[q]
    # a deletion counts at the last of equal symbols, an insertion behind them
    drop = np.flatnonzero(inside)
    drop = drop[code[place[drop]] != code[place[drop] + 1]]
    swap = inside[state]
    query = np.concatenate([q[state[swap]], q[state], q[drop]])
    at = np.concatenate([place[state[swap]] + 1, place[state], place[drop] + 1])
    low = np.concatenate([lo[kid[swap]], lo[kid], low[drop]])
    high = np.concatenate([hi[kid[swap]], hi[kid], high[drop]])
    end = (starts + lens)[query]
    found_q, found_w = [], []
    while len(query):
        done = at == end
        if done.any():                                      # the prefix has to be a whole word
            a, b = index.step(np.zeros(int(done.sum()), np.int64), low[done], high[done])
            whole = a < b
            found_q.append(query[done][whole])
            found_w.append(index.word_at[a[whole]])
        query, at, low, high, end = (x[~done] for x in (query, at, low, high, end))
        low, high = index.step(code[at], low, high)
        at = at + 1
        alive = low < high
        query, at, low, high, end = (x[alive] for x in (query, at, low, high, end))
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_w)


def _same_tail(flat: np.ndarray, ends: np.ndarray, lens: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words a and b agree in their last ``size`` symbols (of word a)."""
    same = lens[b] >= size
    for j in range(1, int(size.max()) + 1 if len(size) else 0):
        on = np.flatnonzero(same & (size >= j))
        same[on] = flat[ends[a[on]] - j] == flat[ends[b[on]] - j]
    return same


OUT = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
OUT_DDL = "word string, n bigint, n_near bigint, best_n bigint, best string"


def search_shard(table: pa.Table) -> pa.Table:
    """Rows (left, half, word, n, index, query) of one shard, of one scheme: one row per query
    with the number of its near words in the shard and the first of them by n and name."""
    left = table["left"][0].as_py()
    enc = table["word"].combine_chunks().dictionary_encode()
    names = enc.dictionary
    order = pc.sort_indices(names).to_numpy()
    name = np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    names = names.take(pa.array(order))                     # in code-point order
    word = name[enc.indices.to_numpy()]
    n = np.zeros(len(names), np.int64)
    n[word] = table["n"].to_numpy()
    half, as_index, as_query = (table[c].to_numpy() for c in ("half", "index", "query"))
    points, lens = code_points(names.to_pylist())
    if not left:                                            # scheme R reads from the right
        points = points[np.repeat(np.cumsum(lens), lens) - 1 - _ranges(np.zeros(len(lens), np.int64), lens)]
    flat = np.unique(points, return_inverse=True)[1] + 1
    ends = np.cumsum(lens)
    indexed = np.unique(word[as_index])
    index = Index(flat[_ranges((ends - lens)[indexed], lens[indexed])], lens[indexed])
    # an index word counts for the half by which it is here
    by_half = np.unique(word[as_index] << 32 | half[as_index])
    own = np.unique(word[as_query] << 32 | half[as_query])  # two blocks of a half may be in one shard
    rows_q, rows_h = own >> 32, own & 0xFFFFFFFF
    out_q, out_w = [], []
    for lo in range(0, len(rows_q), CHUNK):
        q, h = rows_q[lo:lo + CHUNK], rows_h[lo:lo + CHUNK]
        a, b = search(index, flat[_ranges((ends - lens)[q], lens[q])], lens[q], h)
        b = indexed[b]
        good = np.isin(b << 32 | h[a], by_half)
        a, b = a[good], b[good]
        if not left:
            good = ~_same_tail(flat, ends, lens, q[a], b, lens[q[a]] // 2)
            a, b = a[good], b[good]
        out_q.append(a + lo)
        out_w.append(b)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_w))
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    best = np.full(len(rows_q), -1)
    best[a[first]] = b[first]
    none = best < 0
    return pa.Table.from_arrays([
        names.take(pa.array(rows_q)), pa.array(n[rows_q]), pa.array(np.bincount(a, minlength=len(rows_q))),
        pa.array(n[best], mask=none), names.take(pa.array(best, mask=none))], schema=OUT)


# ---------------------------------------------------------------- all shards

def _halves(vocabulary: DataFrame) -> DataFrame:
    """Rows (left, half, key, word, n, query): each word under the halves by which its near
    words look for it; ``query`` marks its own half."""
    size = F.length("word")

    def row(left, half, own):
        key = F.substring("word", F.lit(1), half) if left else F.expr("word").substr(size - half + 1, half)
        return F.struct(F.lit(left).alias("left"), half.alias("half"), key.alias("key"), (half == own).alias("query"))

    def whole(x):
        return F.floor(x).cast("int")

    each = F.array(*[row(True, whole(h / 2), whole(size / 2)) for h in (size - 1, size + 1)],
                   *[row(False, whole(h / 2), whole((size + 1) / 2)) for h in (size, size + 2)])
    return vocabulary.select("word", "n", F.explode(each).alias("r")).select("r.*", "word", "n")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best): per word of ``vocabulary`` (word, n; at least two code
    points each, no word twice) the number of words one error away and the first of them by
    falling n, then by name."""
    rows = _halves(vocabulary)
    shards = max(1, -(-4 * vocabulary.count() // SHARD))
    # at most one row per SHARD index words: small enough to send at any size of the vocabulary
    hot = rows.groupBy("left", "key").count().where(F.col("count") > SHARD).select(
        "left", "key", F.ceil(F.col("count") / SHARD).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(hot), ["left", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), "blocks").cast("int")
    # the word goes to the index of its own block; as a query it goes to all blocks
    every = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    rows = (rows.withColumn("own", own).withColumn("block", F.explode(every)).withColumn("index", F.col("block") == F.col("own"))
            .withColumn("shard", F.pmod(F.xxhash64("left", "key", "block"), F.lit(shards)).cast("int")))
    found = (rows.select("shard", "left", "half", "word", "n", "index", "query").groupBy("left", "shard")
             .applyInArrow(search_shard, OUT_DDL))
    return (found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"),
                                      F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best"))).alias("b"))
            .select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each row (word, form), by pointer doubling; a chain of
    k forms takes about log2(k) rounds."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not at.where("moved").isEmpty():
        hop = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut_lineage(at.join(hop, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return at.select("word", "root")


def group(docs: DataFrame, more: int = MORE, shortest: int = 7, least: int = 2, noise: int = 31) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts: the form is the most
    frequent near word if it occurs at least ``more`` times as often, the root the last form."""
    vocabulary = materialize(words(docs, shortest, least, noise), "words")
    often = F.col("best_n") >= more * F.col("n")
    near = materialize(neighbours(vocabulary).select(
        "word", "n", "n_near", F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n")), "near-words")
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
