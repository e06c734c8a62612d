"""LM scoring with a hidden Markov language model.

Tokens are the lower-cased words of a text, then one end token.  The model is a
first-order HMM with ``states`` latent states over the whole training vocabulary.
Every state learns the probability of every training word, so what Baum-Welch learns
grows with the corpus; one more symbol stands for all unseen words.  With c the word's
training count, N training tokens and V distinct words, its corpus share is
(c + 1) / (N + V + 1), that of the unseen symbol 1 / (N + V + 1).  With ``classes`` set,
words of equal CRC-32 modulo ``classes`` share a state profile instead,

    P(word | state) = P(class(word) | state) * (c + 1) / (C + V' + 1),

C and V' being the class's training tokens and distinct words.

1. *Blocks.*  One pass tokenises the documents into a table of blocks (local
   vocabulary with training counts, token codes, document limits), written to the
   shared folder, so later passes read numbers and survive lost executors.
2. *Counts.*  The words are dealt to buckets by their keys, packed as a row for each block
   and bucket (so a very frequent word is there once a block), and a bucket counts its words.
3. *Baum-Welch.*  Every block runs the scaled forward and backward recursions over its
   training texts.  A word that only one block holds keeps its expected counts there.  Of the
   others a bucket knows which stand in which block, in a fixed order, so an iteration only
   moves packed arrays of numbers.  A block sends a bucket the expected counts of their common words; the bucket
   sums them by word and sends back the numerators of the emissions.  Only a row per block
   and per bucket reaches the driver, and an iteration's tables are deleted when the next
   one's exist.
   Long texts are cut into pieces of ``PIECE`` tokens that run side by side; the forward
   and backward vectors at the cuts come from the pieces' transfer matrices, so the
   counts are those of the whole text.
4. *Scores.*  The scaled forward recursion over each whole text; in the last deal a block
   also gets the counts of its words, and the emissions of those that only other blocks were trained on.  Long texts are cut
   into segments whose transfer matrices are chained, which gives the same exact
   likelihood.

Edge cases: null, empty and blank texts are one end token; a null ``doc_id`` counts
as training; repeated rows are scored and counted each; without training tokens
N = V = 0 and every token's base probability is 1; extra columns are left alone.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlab.llm.common import WORDS_LOWER, Words, discard, materialize, rows, shuffles_deleted, steps
from orderlab.llm.common import written as _written
from orderlab.session import checkpoint_dir

STATES, ITERATIONS = 6, 6
BLOCK_BYTES = 13 << 20   # of text a block has at least, but for a task's last one
BATCH_BYTES = 2 << 20
PIECE = 1024       # tokens of a long text's segments, in training and scoring
GROUP = 3 << 18    # tokens whose recursions run side by side
BUCKETS = 12       # of word keys at least; more blocks have one more for each BUCKET_BLOCKS
BUCKET_BLOCKS = 3
PRIOR = 20.0       # weight of the corpus distribution in a state's emissions
END = ""

_BLOCK_DDL = ("block bigint, vocab array<struct<w:string,c:bigint>>, counts binary, noise binary, tokens binary, "
              "doc_ids array<bigint>, held array<boolean>, n_tokens array<int>")
_BLOCK = pa.schema([("block", pa.int64()), ("vocab", pa.list_(pa.struct([("w", pa.string()), ("c", pa.int64())]))),
                    ("counts", pa.binary()), ("noise", pa.binary()), ("tokens", pa.binary()),
                    ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int32()))])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("log_counts", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, score double"


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray      # states
    move: np.ndarray       # states x states
    emit: np.ndarray       # symbols x states, best by columns (order F)

    def single(self) -> Hmm:
        """In single precision, for the scaled recursions of the training."""
        return Hmm(*(x.astype(np.float32, copy=False) for x in (self.start, self.move, self.emit)))


@dataclass(frozen=True)
class Counts:
    tokens: int            # N
    words: int             # V
    total: float           # N + V + 1, or N + V + classes
    buckets: DataFrame     # see ``_bucket_rows``


@dataclass(frozen=True)
class Emissions:
    table: DataFrame | None  # k, size (numerator of the share), e (probability per state); None if the blocks have no words
    unseen: np.ndarray     # the same of any key that is not in the table
    weights: np.ndarray    # per state: divisor of the first emissions, then expected tokens
    dealt: DataFrame | None = None      # see ``_deal``: what each block holds of the table


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As in ``common``; single-precision numbers hardly get smaller by more work."""
    return _written(df, name, "snappy")


@contextmanager
def _small_batches(spark: SparkSession):
    """Rows go to Python in batches of a few MB of text, however many rows that is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _kind(word: Column, classes: int | None) -> Column:
    """Key of the word, or its class."""
    return F.crc32(word.cast("binary")) % classes if classes else F.xxhash64(word)


def _noise(words: list) -> np.ndarray:
    """Low half of the hash of each word's key, as Spark's xxhash64 gives it."""
    return _key_noise([xxhash.xxh64_intdigest(w or b"", 42) for w in words])


def _key_noise(keys: list) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest((k & (1 << 64) - 1).to_bytes(8, "little"), 42) & 0xFFFFFFFF for k in keys], np.uint32)


def _shift(state: int) -> int:
    """Where the five bits of a state's noise begin."""
    return 5 * state % 28


def _held(doc_id) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 7 == 2


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers as byte planes, whose high planes compress to almost nothing; before them their size."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return planes.size.to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data) -> np.ndarray:
    data = memoryview(data)
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def blocks(docs: DataFrame, classes: int | None = None) -> DataFrame:
    """The tokenised documents, see above; token code len(vocab) - 1 is the end.
    ``counts`` holds the block's training count per code, ``noise`` see ``_noise``."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                           F.spark_partition_id().cast("long").alias("part"))

    def block(number, coded, lengths, ids):
        coded, lengths = pa.chunked_array(coded).unify_dictionaries(), np.concatenate(lengths)
        words, code = coded.chunk(0).dictionary, np.concatenate([x.indices.to_numpy() for x in coded.chunks])
        held = np.array([_held(i) for i in ids], bool)
        end = len(words)
        counts = np.bincount(code[~np.repeat(held, lengths)], minlength=end + 1)
        counts[end] = int((~held).sum())
        tokens = np.insert(code, np.cumsum(lengths), end)
        vocab = pa.concat_arrays([words.cast(pa.string()), pa.array([END], pa.string())])
        item = pa.StructArray.from_arrays([vocab, pa.array(counts, pa.int64())], names=["w", "c"])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, end + 1], item),
             pa.array([pack(counts)], pa.binary()), pa.array([_noise([*words.to_pylist(), b""]).tobytes()], pa.binary()),
             pa.array([pack(tokens)], pa.binary()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([(lengths + 1).tolist()], pa.list_(pa.int32()))],
            schema=_BLOCK)

    def run(batches):
        number, size, coded, lengths, ids = None, 0, [], [], []
        for batch in steps(batches):
            number = batch.column("part")[0].as_py() << 32 if number is None else number
            w = Words(batch.column("text"), WORDS_LOWER)
            coded.append(pa.DictionaryArray.from_arrays(pa.array(w.code, pa.int32()), w.vocab))
            lengths.append(w.counts)
            ids += batch.column("doc_id").to_pylist()
            size += len(w.raw)
            del w
            if size >= BLOCK_BYTES:
                yield block(number, coded, lengths, ids)
                number, size, coded, lengths, ids = number + 1, 0, [], [], []
        if ids:
            yield block(number, coded, lengths, ids)

    return numbered.mapInArrow(run, _BLOCK_DDL)


def word_counts(table: DataFrame, classes: int | None = None) -> tuple[DataFrame, Counts, DataFrame]:
    """(w, c) of the training vocabulary, its totals, and (k, size) of each key."""
    buckets = _bucket_rows(table, classes)
    whole = buckets.where("words IS NOT NULL")
    tokens, words = whole.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = pa.schema([("w", pa.string()), ("c", pa.int64())])

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pc.utf8_rtrim(_spaced([one["words"]]).cast(pa.string()), " "),
                                                  pa.array(np.frombuffer(one["c"], np.int64))], schema=schema)

    counted = whole.select("words", "c").mapInArrow(run, "w string, c bigint")
    sizes = counted.groupBy(_kind(F.col("w"), classes).alias("k")).agg(
        (F.sum("c") + F.count("*") + (1 if classes else 0)).cast("double").alias("size"))
    return counted, Counts(tokens, words, float(tokens + words + (classes or 1)), buckets), sizes


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by falling length, and the number of pieces longer than t for each t."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    return order, alive


def _pieces(starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut token ranges into pieces of at most ``most``: (start, size, range)."""
    parts = -(-sizes // most)
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = starts[owner] + number * most
    return at, np.minimum(most, starts[owner] + sizes[owner] - at), owner


def _run(model: Hmm, seen: np.ndarray, at: np.ndarray, sizes: np.ndarray, init: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion of each range from its row of ``init``, the distribution
    of its first state: (last vector, natural log of its scale)."""
    order, alive = _by_length(sizes)
    at, cur = at[order], np.ascontiguousarray(init[order].T, dtype=model.emit.dtype)  # (states, ranges)
    share, forth = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    logs = np.zeros(len(order))
    for t, m in enumerate(alive):
        a = share.take(seen[at[:m] + t], axis=1)
        a *= cur[:, :m] if t == 0 else forth @ cur[:, :m]
        s = a.sum(axis=0)
        np.divide(a, s, out=cur[:, :m])
        logs[:m] += np.log(s)
    vec, log = np.empty((len(order), len(forth))), np.empty_like(logs)
    vec[order], log[order] = cur.T, logs
    return vec, log


def _transfer(model: Hmm, seen: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Transfer matrix of each range, up to a factor: from the state before it to that of its last token."""
    order, alive = _by_length(sizes)
    at, k = at[order], len(model.start)
    share, forth = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    cur = np.repeat(forth.T[:, :, None], len(order), axis=2)  # (from, to, ranges)
    for t, m in enumerate(alive):
        a = cur[:, :, :m] if t == 0 else forth @ cur[:, :, :m]
        a *= share.take(seen[at[:m] + t], axis=1)
        np.divide(a, a.reshape(k * k, m).sum(axis=0) if t else a.sum(axis=(0, 1)), out=cur[:, :, :m])
    out = np.empty((len(order), k, k))
    out[order] = cur.transpose(2, 0, 1)
    return out


def _at_cuts(model: Hmm, seen: np.ndarray, at: np.ndarray, sizes: np.ndarray, owner: np.ndarray):
    """For each piece the forward vector of the token before it (a distribution, unused
    for first pieces) and the backward vector of its last token (up to a factor)."""
    k, n = len(model.start), len(at)
    first = np.diff(owner, prepend=-1) != 0
    number = np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]
    before, after = np.zeros((n, k)), np.ones((n, k))
    further = np.flatnonzero(~first)
    if not len(further):
        return first, before, after
    heads = further[number[further] == 1] - 1
    before[heads + 1] = _run(model, seen, at[heads], sizes[heads], np.repeat(model.start[None], len(heads), axis=0))[0]
    through = np.zeros((n, k, k))  # from the state before the piece to the one at its end
    through[further] = _transfer(model, seen, at[further], sizes[further])
    by_number = further[np.argsort(number[further], kind="stable")]
    limits = np.searchsorted(number[by_number], np.arange(1, number.max() + 2))
    levels = [by_number[lo:hi] for lo, hi in zip(limits[:-1], limits[1:], strict=True)]
    for p in levels[:-1]:
        p = p[owner[np.minimum(p + 1, n - 1)] == owner[p]]  # pieces with a next one
        p = p[p + 1 < n]
        a = np.einsum("pi,pij->pj", before[p], through[p])
        before[p + 1] = a / a.sum(axis=1, keepdims=True)
    for p in levels[::-1]:
        b = np.einsum("pij,pj->pi", through[p], after[p])
        after[p - 1] = b / b.sum(axis=1, keepdims=True)
    return first, before, after


def expected_counts(model: Hmm, seen: np.ndarray, starts: np.ndarray, sizes: np.ndarray, piece: int = PIECE):
    """Forward-backward over the texts: expected (start, move, emit) counts and the
    natural-log likelihood.  ``seen`` holds the class of each token.  Texts longer than
    ``piece`` run as pieces joined at the cuts.  Recursions run in the model's float
    type, sums over pieces in double."""
    k, kind = len(model.start), model.emit.dtype
    starts, sizes, owner = _pieces(starts, sizes, piece)
    order, alive = _by_length(sizes)
    at = starts[order]
    start, move, loglik = np.zeros(k), np.zeros((k, k)), 0.0
    if not len(alive):
        return start, move, np.zeros(model.emit.shape), loglik
    first, prior, after = _at_cuts(model, seen, starts, sizes, owner)
    first, prior, after = first[order], prior[order].T.astype(kind), after[order].T.astype(kind)
    # arrays are (states, tokens), all first tokens of the pieces, then all second ones, ...
    ends = np.cumsum(alive)
    spans = list(zip(alive.tolist(), (ends - alive).tolist(), ends.tolist(), strict=True))
    cells = np.empty(int(ends[-1]), np.int64)
    for t, (n, lo, hi) in enumerate(spans):
        cells[lo:hi] = seen[at[:n] + t]
    emit = np.ascontiguousarray(model.emit.T).take(cells, axis=1)
    alpha, scale = np.empty_like(emit), np.empty(len(cells), kind)
    forth = np.ascontiguousarray(model.move.T)
    before = np.where(first, model.start[:, None], forth @ prior)
    for n, lo, hi in spans:
        a, s = alpha[:, lo:hi], scale[lo:hi]
        np.multiply(emit[:, lo:hi], forth @ before[:, :n] if lo else before, out=a)
        np.add.reduce(a, axis=0, out=s)
        np.divide(a, s, out=a)
        before = a
    loglik = float(np.log(scale).sum(dtype=float))
    emit /= scale
    beta, m = np.ones((k, 0), kind), 0
    for n, lo, hi in reversed(spans):
        a, b = alpha[:, lo:hi], np.empty((k, n), kind)
        if m:
            ahead = emit[:, hi:hi + m]
            ahead *= beta
            move += a[:, :m] @ ahead.T
            np.matmul(model.move, ahead, out=b[:, :m])
        if m < n:  # pieces that end here
            np.divide(after[:, m:n], (a[:, m:] * after[:, m:n]).sum(axis=0), out=b[:, m:])
        a *= b  # now the posterior of the states
        beta, m = b, n
    start += alpha[:, :m][:, first].sum(axis=1)
    move += prior[:, ~first] @ (emit[:, :m] * beta)[:, ~first].T  # moves over the cuts
    out = np.empty(model.emit.shape, order="F")
    for j, g in enumerate(alpha):
        out[:, j] = np.bincount(cells, g, minlength=len(model.emit))
    return start, move * model.move, out, loglik


def first_emissions(sizes: DataFrame, counts: Counts, states: int) -> Emissions:
    """The corpus distribution, varied at random by word and state (five bits of the key's hash)."""
    noise = [F.shiftrightunsigned(F.xxhash64("k"), _shift(j)).bitwiseAND(31) for j in range(states)]
    total = counts.total
    raw = [F.col("size") / total * _varied(u) for u in noise]

    def run(batches):
        sums = np.zeros(states + 1)
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1).to_pylist()[0]
                size = np.frombuffer(one["size"])
                sums[0] += size.sum()
                sums[1:] += _first(size, np.frombuffer(one["noise"], np.uint32), states, total).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    whole = counts.buckets.where("words IS NOT NULL").select("size", "noise").mapInArrow(run, "sums binary")
    known, *sums = sum((np.frombuffer(r.sums) for r in whole.collect()), np.zeros(states + 1))  # one a task
    norm = np.array(sums) + 1 - known / total
    return Emissions(sizes.select("k", "size", F.array(*[e / float(x) for e, x in zip(raw, norm, strict=True)]).alias("e")),
                     1 / total / norm, norm)


def _varied(noise):
    return 1 + 0.6 * ((2 * noise + 1) / 32 - 1)


def _first(size: np.ndarray, noise: np.ndarray, states: int, total: float) -> np.ndarray:
    """Numerators of ``first_emissions`` of words with these sizes."""
    bits = noise[:, None] >> np.array([_shift(j) for j in range(states)], np.uint32) & np.uint32(31)
    return size[:, None] / total * _varied(bits.astype(float))


def _own_next(c: np.ndarray, found: np.ndarray, weights: np.ndarray, total: float) -> np.ndarray:
    """Emissions of a block's own words with the training counts ``c``, smoothed as in ``_deal``."""
    size = c[:, None] + 1.0
    return (found * (size / c[:, None]) + PRIOR * size / total) / (weights + PRIOR)


def _spaced(data: list[bytes]) -> pa.Array:
    """The words of packed lists, in which a space ends each word; it stays."""
    data = b"".join(data)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20) + 1
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data)])


def _classes(words: list, classes: int) -> np.ndarray:
    return np.array([crc32(w) % classes for w in words], np.int64)


def _bucket_rows(table: DataFrame, classes: int | None) -> DataFrame:
    """Words by bucket of their keys.  A row with ``words`` holds the bucket's ``n`` training words, their
    counts ``c`` and sum (``tokens``), and noise and size of their keys; the other one without a block
    noise and size of the keys that more than one block holds (with classes, of all).  A row with a block
    says which of the latter stand in the block (``at``) under which ``code``: first the ``n`` words that
    it trains on, then the others."""
    buckets = max(BUCKETS, table.count() // BUCKET_BLOCKS)
    packed = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("code", pa.binary()),
                        ("c", pa.binary()), ("noise", pa.binary())])

    def deal(batches):
        blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        for batch in batches:
            for i in range(batch.num_rows):
                w, c = batch.column("vocab")[i].values.flatten()
                noise, c = np.frombuffer(batch.column("noise")[i].as_py(), np.uint32), c.to_numpy()
                key = _classes(w.cast(pa.binary()).to_pylist(), classes) if classes else noise
                bucket = (key % buckets).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                spaced = pc.binary_join_element_wise(w.cast(pa.large_string()).take(pa.array(order)), *blank).cast(pa.large_binary())
                limits = np.searchsorted(bucket[order], np.arange(buckets + 1))
                data, ends = memoryview(spaced.buffers()[2]), np.frombuffer(spaced.buffers()[1], np.int64)
                for b in np.flatnonzero(np.diff(limits)).tolist():
                    lo, hi = limits[b], limits[b + 1]
                    yield rows(packed, [b], [batch.column("block")[i].as_py()], [bytes(data[ends[lo]:ends[hi]])],
                               [pack(order[lo:hi])], [pack(c[order[lo:hi]])], [noise[order[lo:hi]].tobytes()])

    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("code", pa.binary()),
                        ("noise", pa.binary()), ("size", pa.binary()), ("words", pa.binary()), ("c", pa.binary()), ("tokens", pa.int64())])

    def run(group):
        lines = group.to_pylist()  # the words of one bucket; the more blocks, the more buckets
        found = _spaced([x["words"] for x in lines]).dictionary_encode()
        word, words = found.indices.to_numpy(), found.dictionary
        code, c, noise = (np.concatenate(x) for x in zip(
            *[(unpack(x["code"]), unpack(x["c"]), np.frombuffer(x["noise"], np.uint32)) for x in lines], strict=True))
        block = np.repeat([x["block"] for x in lines], [len(x["noise"]) // 4 for x in lines])
        total = np.bincount(word, c, minlength=len(words)).astype(np.int64)  # exact below 2 ** 53
        seen, size = total > 0, total + 1.0
        if classes:
            keys, of = np.unique(_classes([w[:-1] for w in words.to_pylist()], classes), return_inverse=True)
            size, own = np.bincount(of, total + seen) + 1.0, _key_noise(keys.tolist())
            known = keep = np.bincount(of, seen) > 0
            word = of[word]
        else:
            own = np.zeros(len(words), np.uint32)
            own[word] = noise
            known, keep = seen, seen & (np.bincount(word, minlength=len(words)) > 1)
        use = keep[word]
        block, code, c, word = block[use], code[use], c[use], (np.cumsum(keep) - 1)[word[use]]
        order = np.lexsort((code, c == 0, block))
        block, code, c, word = block[order], code[order], c[order], word[order]
        limits = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        bucket, none = lines[0]["bucket"], (None,) * 5
        out = [(bucket, int(block[lo]), int((c[lo:hi] > 0).sum()), pack(word[lo:hi]), pack(code[lo:hi]), *none)
               for lo, hi in zip(limits[:-1], limits[1:], strict=True)]
        out.append((bucket, None, None, None, None, own[keep].tobytes(), size[keep].tobytes(), None, None, None))
        text = b"".join(words.filter(pa.array(seen)).to_pylist())
        out.append((bucket, None, int(seen.sum()), None, None, own[known].tobytes(), size[known].tobytes(), text,
                    total[seen].tobytes(), int(total.sum())))
        return pa.Table.from_batches([rows(schema, *map(list, zip(*out, strict=True)))])

    dealt = table.select("block", "vocab", "noise").mapInArrow(
        deal, "bucket bigint, block bigint, words binary, code binary, c binary, noise binary")
    return materialize(dealt.groupBy("bucket").applyInArrow(
        run, "bucket long, block long, n long, at binary, code binary, noise binary, size binary, words binary, c binary, tokens long"),
        "buckets")


def _deal(buckets: DataFrame, parts: DataFrame | None, counts: Counts, states: int, classes: int | None, last: bool) -> DataFrame:
    """The numerators of the emissions: first ones without ``parts``, else expected counts of the
    parts (bucket, block, v) summed by word and smoothed.  Without classes a word's counts are raised from
    c to c + 1.  A row with a block holds the numerators ``m`` of the words that the block trains on (in
    the last deal, of all its words, with the sizes of their keys); the other row of a bucket holds the sums of its expected counts, as
    found and raised.  Own words of a block (bucket -1) pass through."""
    columns = ["bucket", "block", "n", "at", "code", "noise", "size", "v"]
    both = buckets.where("words IS NULL").withColumn("v", F.lit(None).cast("binary"))
    if parts is not None:
        both = both.unionByName(parts.where("bucket >= 0"), allowMissingColumns=True)
    out = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("code", pa.binary()), ("m", pa.binary()), ("size", pa.binary())])
    total, summed = counts.total, parts is not None

    def run(group):
        lines = group.to_pylist()  # at most the words of one bucket
        bucket, cells = lines[0]["bucket"], [x for x in lines if x["at"] is not None]
        (words,) = (x for x in lines if x["noise"] is not None)
        size, places = np.frombuffer(words["size"]), [unpack(x["at"]) for x in cells]
        sums = raised = np.zeros((len(size), states))
        if summed:
            found = {x["block"]: x["v"] for x in lines if x["v"] is not None}
            at = np.concatenate([p[:x["n"]] for p, x in zip(places, cells, strict=True)] or [np.zeros(0, np.int64)])
            v = np.frombuffer(b"".join(found.get(x["block"], b"") for x in cells), np.float32).reshape(-1, states)
            sums = np.stack([np.bincount(at, v[:, j], minlength=len(size)) for j in range(states)], axis=1)
            raised = sums if classes else sums * (size / (size - 1))[:, None]
            value = raised + PRIOR * (size / total)[:, None]
        else:
            value = _first(size, np.frombuffer(words["noise"], np.uint32), states, total)
        value, res = value.astype(np.float32), []
        for p, x in zip(places, cells, strict=True):
            n = len(p) if last else x["n"]
            res.append((bucket, x["block"], pack(unpack(x["code"])[:n]), value[p[:n]].tobytes(),
                        size[p[:n]].tobytes() if last else None))
        res.append((bucket, None, None, np.stack([sums.sum(axis=0), raised.sum(axis=0)]).tobytes(), None))
        return pa.Table.from_batches([rows(out, *map(list, zip(*res, strict=True)))])

    dealt = both.select(columns).groupBy("bucket").applyInArrow(run, "bucket long, block long, code binary, m binary, size binary")
    if parts is None:
        return dealt
    own = parts.where("bucket = -1").select("bucket", "block", F.col("v").alias("m"))
    few = max(1, int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return dealt.unionByName(own.coalesce(few), allowMissingColumns=True)


def _with_dealt(table: DataFrame, dealt: DataFrame, run, ddl: str) -> DataFrame:
    """``run`` on each block's row of ``table`` and its rows of ``_deal``, at most a block's own vocabulary."""
    return table.groupBy("block").cogroup(dealt.where("block IS NOT NULL").groupBy("block")).applyInArrow(run, ddl)


def _local(dealt: pa.Table, c: np.ndarray, divisor: np.ndarray, unseen: np.ndarray, kind=float):
    """Of a block's rows of ``_deal``: the parts (bucket, codes) in the order of the buckets, emissions and
    sizes of all codes, the own codes, and the expected counts of these."""
    parts, own, k = [], b"", len(unseen)
    emit, size, mine = np.empty((len(c), k), kind, order="F"), c + 1.0, c > 0
    emit[:] = unseen
    buckets = dealt.column("bucket").to_numpy()
    for n in np.argsort(buckets).tolist():
        code, m, sizes = (dealt.column(x)[n].as_buffer() for x in ("code", "m", "size"))
        if buckets[n] < 0:
            own = m
            continue
        code = unpack(code)
        emit[code] = np.frombuffer(m, np.float32).reshape(-1, k) / divisor
        if sizes is not None:
            size[code] = np.frombuffer(sizes)
        mine[code] = False
        parts.append((int(buckets[n]), code))
    return parts, emit, size, np.flatnonzero(mine), np.frombuffer(own, np.float32).reshape(-1, k)


def _by_block(table: DataFrame) -> DataFrame:
    """The blocks as a bucketed table, which joins by block read without a shuffle."""
    spark, name = table.sparkSession, f"blocks_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_deleted(spark):
        table.repartition(count, "block").write.bucketBy(count, "block").option("compression", "zstd").option(
            "path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return out


def _codes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token codes, first token and number of tokens per document)."""
    sizes = np.array(row["n_tokens"], np.int64)
    return unpack(row["tokens"]), np.cumsum(sizes) - sizes, sizes


def _groups(sizes: np.ndarray):
    """Slices of pieces with about GROUP tokens each."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GROUP, side="right")))
        yield slice(lo, hi)
        lo = hi


def train(table: DataFrame, counts: Counts, sizes: DataFrame, states: int = STATES, classes: int | None = None,
          iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, Emissions, list[float]]:
    """Baum-Welch over the training documents of the block table, one iteration at least:
    (start, move, emissions), and the natural-log likelihood (of keys) before each update."""
    if iterations < 1:
        raise ValueError("at least one iteration")
    spark, total = table.sparkSession, counts.total
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    start, history = np.full(states, 1 / states), []
    move = np.full((states, states), 0.1 / max(1, states - 1))  # sticky states
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    first = first_emissions(sizes, counts, states)
    unseen, weights = first.unseen, first.weights
    buckets = counts.buckets
    dealt, dealt_path = written(_deal(buckets, None, counts, states, classes, False), "dealt")
    out = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("v", pa.binary())])
    texts = table.select("block", "counts", "tokens", "held", "n_tokens", "noise")
    # bucket -1: a block's own words; -2: moves by state, starts, likelihood, own tokens, own tokens raised by one count a word

    def estep(start, move, unseen, weights, begun):
        def run(text, got):
            one, tail = text.to_pylist()[0], np.zeros((states + 4, states))
            tokens, first, sizes = _codes(one)
            c = unpack(one["counts"])
            parts, emit, _, mine, v = _local(got, c, weights + PRIOR if begun else weights, unseen, np.float32)
            if begun:
                emit[mine] = _own_next(c[mine], v, weights, total)
            else:
                emit[mine] = _first(c[mine] + 1.0, np.frombuffer(one["noise"], np.uint32)[mine], states, total) / weights
            hmm, found = Hmm(start, move, emit).single(), np.zeros(emit.shape, order="F")
            use = ~np.array(one["held"], bool)
            at, sizes = first[use], sizes[use]
            for part in _groups(sizes):
                s, m, e, ll = expected_counts(hmm, tokens, at[part], sizes[part])
                found += e
                tail[:states] += m
                tail[states] += s
                tail[states + 1, 0] += ll
            tail[states + 2] = found[mine].sum(axis=0)
            tail[states + 3] = (found[mine] * (1 + 1 / c[mine][:, None])).sum(axis=0)
            found = found.astype(np.float32, order="C")
            parts.append((-1, mine))
            return pa.Table.from_batches([rows(out, [*(b for b, _ in parts), -2], [one["block"]] * (len(parts) + 1),
                                               [*(found[code].tobytes() for _, code in parts), tail.tobytes()])])
        return run

    for i in range(iterations):
        found = _with_dealt(texts, dealt, estep(start, move, unseen, weights, i > 0), "bucket long, block long, v binary")
        parts, parts_path = written(found.coalesce(max(1, count // 2)), "expected-parts")  # fewer, larger files
        discard(spark, dealt_path)
        tail = sum((np.frombuffer(r.v).reshape(-1, states) for r in parts.where("bucket = -2").select("v").collect()),  # one a block
                   np.zeros((states + 4, states)))
        history.append(tail[states + 1, 0])
        move, start = tail[:states] + 1.0, tail[states] + 1.0
        start, move = start / start.sum(), move / move.sum(axis=1, keepdims=True)
        dealt, dealt_path = written(_deal(buckets, parts, counts, states, classes, i == iterations - 1), "dealt")
        discard(spark, parts_path)
        sums = sum((np.frombuffer(r.m).reshape(2, states) for r in dealt.where("block IS NULL").select("m").collect()),  # one a bucket
                   np.zeros((2, states))) + tail[states + 2:]
        # the unseen symbol gets one count, dealt to the states by their tokens, as in the corpus shares
        rest = np.zeros(states) if classes else sums[0] / max(1, counts.tokens)
        weights = sums[0] if classes else sums[1] + rest
        unseen = (rest + PRIOR / total) / (weights + PRIOR)
    learned = _learned(table, dealt, sizes, unseen, weights, total, classes) if "vocab" in table.columns else None
    return start, move, Emissions(learned, unseen, weights, dealt), history


def _learned(table: DataFrame, dealt: DataFrame, sizes: DataFrame, unseen: np.ndarray, weights: np.ndarray, total: float,
             classes: int | None) -> DataFrame:
    """(k, size, e) of the whole training vocabulary."""
    schema = pa.schema([("k", pa.int64()), ("e", pa.list_(pa.float64()))])
    keys = table.select("block", "counts", F.transform("vocab", lambda v: _kind(v["w"], classes)).alias("keys"))

    def run(text, got):
        one = text.to_pylist()[0]
        c = unpack(one["counts"])
        _, emit, _, mine, v = _local(got, c, weights + PRIOR, unseen)
        emit[mine] = _own_next(c[mine], v, weights, total)
        use = np.flatnonzero(c > 0)
        return pa.Table.from_batches([rows(schema, np.array(one["keys"], np.int64)[use], list(emit[use]))])

    found = _with_dealt(keys, dealt, run, "k long, e array<double>")
    return found.groupBy("k").agg(F.first("e").alias("e")).join(sizes, "k").select("k", "size", "e")


def log10_forward(model: Hmm, seen: np.ndarray, starts: np.ndarray, sizes: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Exact log10 likelihood of each class sequence by the scaled forward recursion.
    A sequence longer than ``piece`` is a chain of segments: the first runs from the
    start distribution, each further one from every state at once (its transfer
    matrix)."""
    k = len(model.start)
    at, n, owner = _pieces(starts, sizes, piece)
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    copies = np.where(first, 1, k)
    base = np.cumsum(copies) - copies
    at, n = np.repeat(at, copies), np.repeat(n, copies)
    state = np.arange(len(at)) - np.repeat(base, copies)
    init = np.where(np.repeat(first, copies)[:, None], model.start, model.move[state])
    vec, log = _run(model, seen, at, n, init)
    out = np.zeros(len(starts))
    out[owner[first]] = log[base[first]]
    last = {}
    for p in np.flatnonzero(~first):  # further segments, in order
        d = owner[p]
        a = last[d] if d in last else vec[base[p - 1]]
        own = log[base[p]:base[p] + k]
        top = own.max()
        a = (a * np.exp(own - top)) @ vec[base[p]:base[p] + k]
        s = a.sum()
        out[d] += top + np.log(s)
        last[d] = a / s
    return out / np.log(10)


def scores(table: DataFrame, counted: DataFrame, start: np.ndarray, move: np.ndarray, emissions: Emissions,
           total: float, classes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, log_counts (sum of log10(c + 1)), score."""
    texts = table.select("block", "counts", "tokens", "doc_ids", "held", "n_tokens")
    if classes:  # else the buckets send the counts; a word whose training tokens all lie in the block needs none
        word = table.select("block", F.posexplode("vocab").alias("code", "v")).select("block", "code", "v.w", "v.c")
        more = word.join(counted.withColumnRenamed("c", "total"), "w").where("total > c")
        texts = texts.join(materialize(more.groupBy("block").agg(  # at most a block's own vocabulary
            F.collect_list("code").alias("at"), F.collect_list("total").alias("total")), "elsewhere"), "block", "left")
    unseen, weights = emissions.unseen, emissions.weights

    def run(text, got):
        one = text.to_pylist()[0]
        tokens, first, sizes = _codes(one)
        c = unpack(one["counts"])
        _, emit, size, mine, v = _local(got, c, weights + PRIOR, unseen)
        emit[mine] = _own_next(c[mine], v, weights, total)
        if not classes:
            c = size.astype(np.int64) - 1
        elif one["at"]:
            c[one["at"]] = one["total"]
        hmm, logs = Hmm(start, move, emit), np.log10(c + 1)
        sums = np.add.reduceat(logs[tokens], first)
        # words within their class; without classes only the unseen symbol's one
        rest = np.add.reduceat((logs - np.log10(size))[tokens], first)
        known_ = np.add.reduceat((c > 0).astype(np.int64)[tokens], first)
        own = np.zeros(len(first))
        for part in _groups(sizes):
            own[part] = log10_forward(hmm, tokens, first[part], sizes[part])
        return pa.Table.from_batches([rows(SCORES, one["doc_ids"], one["held"], sizes, known_, sums, rest + own)])

    return _with_dealt(texts, emissions.dealt, run, SCORES_DDL)


def score(docs: DataFrame, states: int = STATES, classes: int | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every
    document; learns from the documents that are not held out."""
    with _small_batches(docs.sparkSession):
        table, path = _written(blocks(docs), "blocks")
    counted, counts, sizes = word_counts(table, classes)
    if not classes:
        table = _by_block(table.drop("vocab"))
        discard(docs.sparkSession, path)
    start, move, emissions, _ = train(table, counts, sizes, states, classes, iterations)
    base = float(np.log10(counts.tokens + counts.words + 1))
    return scores(table, counted, start, move, emissions, counts.total, classes).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score")
