"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces of the
product of their probabilities, computed by a forward recursion; a text's score is
the sum over its words.  Piece probabilities are learned by expectation
maximisation (forward-backward expected piece counts) on labelled documents.

Words are runs of letters, lower-cased, with the vocabulary's word-start mark, taken
in chunks of at most ``RUN`` letters.  Letters outside the vocabulary are unknown
pieces of one letter.  The prediction is the language of highest likelihood; ``score``
is its posterior under equal priors.

Learning uses about ``max_docs`` documents per language (chosen by a hash of the id,
among documents whose CRC-32 remainder is not the held-out one, with a language);
every document is scored, whole.  Vocabulary x languages numbers are broadcast: the
vocabulary is fixed and the number of languages is checked against ``MAX_LANGS``.

Edge cases: a null text or one without letters is ``und`` with score 0, as is every
text when nothing can be learned; ties go to the first language in order; a null
``doc_id`` is not held out and not learned from; repeated rows are scored each; extra
columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlab.llm.common import Words, byte_table, rows, steps
from orderlab.session import cut_lineage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
RUN = 32
MAX_PIECE = 16
MAX_LANGS = 512
ROUNDS = 4
FLOOR = 0.05       # pseudo-count of each piece in each language
CACHE = 1 << 17    # words whose scores a task keeps
LETTERS = re.compile(r"[^\W\d_]+")
# ASCII bytes other than letters separate words; A-Z are lowered
TABLE = byte_table(True, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Distinct pieces of letters (with or without the word-start mark), lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    body = {p for p in pieces if p == p.lower() and len(p) <= MAX_PIECE and LETTERS.fullmatch(p.removeprefix(MARK) or "a")}
    return sorted(body)


def runs(word: str) -> list[str]:
    """Marked letter runs of a word, in chunks of at most RUN letters."""
    out = []
    for run in LETTERS.findall(word.lower()):
        out.append(MARK + run[:RUN])
        out += [run[i:i + RUN] for i in range(RUN, len(run), RUN)]
    return out


class Lattice:
    """All pieces inside words: which word, from where to where, which piece."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.tables = {}
        for size in sorted({len(p) for p in pieces}):
            own = [i for i, p in enumerate(pieces) if len(p) == size]
            keys = self._keys("".join(pieces[i] for i in own), size)[::size]
            order = np.argsort(keys)
            self.tables[size] = (keys[order], np.array(own)[order])

    @staticmethod
    def _keys(text: str, size: int) -> np.ndarray:
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return Lattice._window(*Lattice._sums(chars), size)

    @staticmethod
    def _sums(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(chars), MULT)]))
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(chars), INVERSE)]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum((chars + np.uint64(1)) * up[:-1])])
        return sums, down

    @staticmethod
    def _window(sums: np.ndarray, down: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        with np.errstate(over="ignore"):
            return (sums[size:] - sums[:-size]) * down[:n] if n > 0 else np.zeros(0, np.uint64)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, from, to, piece) sorted by (to, word), and the word lengths."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) for w in words], np.int64)
        base = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(chars)) - base[word]
        room = sizes[word] - place
        sums, down = self._sums(chars)
        found = []
        single = np.zeros(len(chars), bool)
        for size, (keys, ids) in self.tables.items():
            key = self._window(sums, down, size)
            at = np.flatnonzero(room[:len(key)] >= size)
            slot = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            hit = keys[slot] == key[at]
            at, slot = at[hit], slot[hit]
            if size == 1:
                single[at] = True
            found.append((word[at], place[at], place[at] + size, ids[slot]))
        at = np.flatnonzero(~single)
        found.append((word[at], place[at], place[at] + 1, np.full(len(at), self.unknown)))
        w, lo, hi, piece = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((w, hi))
        return w[order], lo[order], hi[order], piece[order], sizes


def forward(edges, prob: np.ndarray) -> np.ndarray:
    """f[word, place, language]: summed probability of all segmentations up to place."""
    w, lo, hi, piece, sizes = edges
    most = int(sizes.max())
    f = np.zeros((len(sizes), most + 1, prob.shape[1]))
    f[:, 0] = 1
    limit = np.searchsorted(hi, np.arange(1, most + 2))
    for end in range(1, most + 1):
        s = slice(limit[end - 1], limit[end])
        if s.start == s.stop:
            continue
        first = np.flatnonzero(np.diff(w[s], prepend=-1))
        f[w[s][first], end] = np.add.reduceat(f[w[s], lo[s]] * prob[piece[s]], first, axis=0)
    return f


def word_scores(lattice: Lattice, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural-log probability of each word in each language."""
    out = np.empty((len(words), prob.shape[1]))
    order = np.argsort([len(w) for w in words], kind="stable")
    step = max(64, 4_000_000 // (RUN * max(1, prob.shape[1])))
    for lo in range(0, len(words), step):
        part = order[lo:lo + step]
        edges = lattice.edges([words[i] for i in part])
        f = forward(edges, prob)
        out[part] = np.log(np.maximum(f[np.arange(len(part)), edges[4]], 1e-300))
    return out


def expected_pieces(lattice: Lattice, prob: np.ndarray, words: list[str], count: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words under one language's probabilities."""
    out = np.zeros(len(prob))
    for lo_ in range(0, len(words), 20_000):
        part, weight = words[lo_:lo_ + 20_000], count[lo_:lo_ + 20_000]
        edges = lattice.edges(part)
        w, lo, hi, piece, sizes = edges
        f = forward(edges, prob[:, None])[:, :, 0]
        b = np.zeros_like(f)
        b[np.arange(len(part)), sizes] = 1
        order = np.lexsort((w, -lo))
        start = -lo[order]
        limit = np.searchsorted(start, np.arange(-int(sizes.max()), 2))
        for k in range(len(limit) - 1):  # from the last place back
            s = order[limit[k]:limit[k + 1]]
            if len(s):
                first = np.flatnonzero(np.diff(w[s], prepend=-1))
                b[w[s][first], lo[s][first]] += np.add.reduceat(prob[piece[s]] * b[w[s], hi[s]], first)
        total = np.maximum(f[np.arange(len(part)), sizes], 1e-300)
        out += np.bincount(piece, f[w, lo] * prob[piece] * b[w, hi] * (weight / total)[w], minlength=len(prob))
    return out


def sample(docs: DataFrame, max_docs: int) -> DataFrame:
    """(lang, text) of about ``max_docs`` learnable documents per language; only the
    ids and languages are counted, the text is read once."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    own = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (rest != 2))
    share = own.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(max_docs)) / F.count("*")).alias("share"))
    share = cut_lineage(share)
    if share.limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: raise MAX_LANGS and the tasks' memory")
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return own.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").where(u < F.col("share")).select(
        "lang", "text")  # at most MAX_LANGS rows are broadcast


def sample_words(docs: DataFrame, max_docs: int) -> DataFrame:
    """(lang, word, n) of the learning sample."""
    out = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in steps(batches):
            langs = batch.column("lang").to_pylist()
            w = Words(batch.column("text"), TABLE)
            texts = [runs(v.decode()) for v in w.vocab.to_pylist()]
            names = sorted(set(langs))
            lang = np.array([names.index(x) for x in langs])[w.doc]
            key, n = np.unique(lang * max(1, len(texts)) + w.code, return_counts=True)
            got = [(names[k // len(texts)], r, c) for k, c in zip(key.tolist(), n.tolist(), strict=True)
                   for r in texts[k % len(texts)]]
            if got:
                yield rows(out, *zip(*got, strict=True))

    counted = sample(docs, max_docs).mapInArrow(run, "lang string, word string, n bigint")
    return cut_lineage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))


def train(words: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities[piece, language]); the last piece is the unknown one.
    Each round sums expected counts per task and then across partitions."""
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())  # at most MAX_LANGS
    lattice = Lattice(pieces)
    size = len(pieces) + 1
    length = np.array([len(p) for p in pieces] + [1], float)
    prob = np.repeat((np.exp(-length) / np.exp(-length).sum())[:, None], max(1, len(langs)), axis=1)
    sc = words.sparkSession.sparkContext
    out = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])
    for _ in range(rounds if langs else 0):
        shared = sc.broadcast((lattice, prob, {x: i for i, x in enumerate(langs)}))

        def estep(batches, shared=shared):
            lat, p, index = shared.value
            for batch in batches:
                lang = np.array([index[x] for x in batch.column("lang").to_pylist()])
                text = np.array(batch.column("word").to_pylist(), object)
                n = batch.column("n").to_numpy()
                for k in np.unique(lang):
                    own = lang == k
                    got = expected_pieces(lat, p[:, k], text[own].tolist(), n[own].astype(float))
                    some = np.flatnonzero(got)
                    yield rows(out, np.full(len(some), k), some, got[some])

        counts = np.full((size, len(langs)), FLOOR)
        for k, piece, n in (words.mapInArrow(estep, "lang int, piece int, n double").groupBy("lang", "piece")
                            .agg(F.sum("n")).collect()):  # at most pieces x languages rows
            counts[piece, k] += n
        prob = counts / counts.sum(axis=0)
        shared.unpersist()
    return langs, prob


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, pieces: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((Lattice(pieces), prob, langs))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]):
        lattice, p, names = shared.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(names)))
        for batch in steps(batches):
            n = batch.num_rows
            ids = batch.column("doc_id").to_pylist()
            held = [i is not None and crc32(str(i).encode()) % 4 == 2 for i in ids]
            w = Words(batch.column("text"), TABLE)
            parts = [runs(v.decode()) for v in w.vocab.to_pylist()]
            has = np.array([bool(x) for x in parts] + [False])
            letters = np.bincount(w.doc, has[w.code], minlength=n) > 0 if len(w.code) else np.zeros(n, bool)
            if not names or not letters.any():
                yield rows(out, ids, held, ["und"] * n, np.zeros(n))
                continue
            if len(known) > CACHE:
                known, table = {}, table[:0]
            new = list(dict.fromkeys(r for x in parts for r in x if r not in known))
            if new:
                known.update((r, len(table) + i) for i, r in enumerate(new))
                table = np.concatenate([table, word_scores(lattice, p, new)])
            flat = np.array([known[r] for x in parts for r in x], np.int64)
            owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            total = np.empty((n, len(names)))
            for k in range(len(names)):
                own = np.bincount(owner, table[flat, k], minlength=len(parts))
                total[:, k] = np.bincount(w.doc, own[w.code], minlength=n)
            best = total.argmax(axis=1)
            post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            yield rows(out, ids, held, [names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)],
                       np.where(letters, post, 0.0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, max_docs: int = 2000, rounds: int = ROUNDS) -> DataFrame:
    """Learn on the sample, then predict every document."""
    pieces = read_pieces(vocabulary)
    langs, prob = train(sample_words(docs, max_docs), pieces, rounds)
    return predict(docs, langs, prob, pieces)
