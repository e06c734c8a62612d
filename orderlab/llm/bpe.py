"""Byte-level BPE encoding and decoding with a public tokenizer file.

The merges of many words run together in numpy.  A step of texts is cut into words by
the file's pre-tokenisation pattern, the distinct words' bytes become symbols in one
flat array, and every round merges, in each word, the pair of the lowest rank wherever
it stands.  A pair's rank is found by binary search over the sorted pair keys
``left << 32 | right``.  Words that have no pair left leave the array.  A word of more
than ``LONG`` bytes would need many rounds over all its symbols; such words are merged
rank by rank over a linked list of positions, with the same search, so that the work
grows with the number of merges.

``encode`` adds the ids as packed little-endian unsigned 32-bit integers (the usual
format of token shards), ``decode`` turns them back into text; ids whose bytes are not
valid UTF-8 decode with replacement characters.

The result is that of the tokenizers library for the same file without added special
tokens: the file's own added tokens (here ``<|endoftext|>``) are recognised in texts.
Letters and numbers are those of the library's Unicode version.

Edge cases: null and empty texts have no ids and decode to the empty text; very long
texts are handled one at a time, long words by the second way; rows are independent, so
null or repeated ids, ties and clashing extra columns change nothing (``ids``,
``n_tokens`` and ``decoded`` replace columns of these names); an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlab.llm.common import steps

LONG = 2048          # bytes of a word
FILE = "byte_bpe_50k.json"
# Fixed value: the pre-tokenisation pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)


@dataclass
class Table:
    """A tokenizer file as arrays.

    byte_id   id of each single byte
    keys      sorted pair keys; ``rank`` and ``merged`` are aligned with them
    pair      keys by rank
    starts, data   bytes of token i are data[starts[i]:starts[i + 1]]
    added     contents and ids of the added tokens
    late      code points that are no letters or numbers to the library's Unicode version
    """

    byte_id: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    pair: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    added: dict
    late: str

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE if they never merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level file: itself
    where it is printable Latin-1, else the next code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


def _late(path: str) -> str:
    """Code points that ``regex`` counts as letters or numbers, but the library's older
    Unicode tables do not; only those that are new to Python's tables can differ."""
    from tokenizers import Tokenizer
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    new = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"]
    new = regex.findall(r"[\p{L}\p{N}]", "".join(new))
    # a letter joins the a before it, a number the 1, anything else joins neither
    return "".join(c for c in new if len(cut(f"a{c}")) == 2 and len(cut(f"1{c}")) == 2)


@lru_cache(maxsize=4)
def load(path: str) -> Table:
    """The byte-level BPE file at ``path``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if (spec["pre_tokenizer"].get("type"), spec.get("normalizer"), model.get("ignore_merges")) != ("ByteLevel", None, False):
        raise ValueError(f"{path} is no plain byte-level BPE file")
    vocab = model["vocab"]
    letters = byte_letters()
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    pair = left << 32 | right
    order = np.argsort(pair, kind="stable")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *added.values()]) + 1
    value = {c: b for b, c in enumerate(letters)}
    token = [b""] * size
    for text, i in [*vocab.items(), *added.items()]:
        token[i] = bytes(map(value.__getitem__, text)) if all(c in value for c in text) else text.encode()
    starts = np.zeros(size + 1, np.int64)
    np.cumsum([len(t) for t in token], out=starts[1:])
    return Table(np.array([vocab[c] for c in letters], np.int64), pair[order], order.astype(np.int64), merged[order],
                 pair, starts, np.frombuffer(b"".join(token), np.uint8), added, _late(path))


class Splitter:
    """Cuts texts into words and added tokens."""

    def __init__(self, table: Table):
        self.words = regex.compile(PATTERN)
        self.late = frozenset(table.late)
        self.plain = dict.fromkeys(map(ord, table.late), "§")  # a sign that is no letter, number or space
        self.added = regex.compile("|".join(map(regex.escape, sorted(table.added, key=len, reverse=True)))) if table.added else None
        self.names = list(table.added)

    def part(self, text: str) -> list[str]:
        if text.isascii() or self.late.isdisjoint(text):
            return self.words.findall(text)
        return [text[m.start():m.end()] for m in self.words.finditer(text.translate(self.plain))]

    def __call__(self, text: str) -> list[str]:
        if self.added is None or not any(a in text for a in self.names):
            return self.part(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += self.part(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.part(text[at:])


def _alternate(same: np.ndarray) -> np.ndarray:
    """Of runs of overlapping pairs, every other one from the left; ``same[i]`` tells that
    pair i overlaps pair i - 1."""
    at = np.arange(len(same))
    start = np.maximum.accumulate(np.where(same, 0, at))
    return (at - start) % 2 == 0


def merge_words(sym: np.ndarray, lens: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Merges all words in rounds; word i has ``lens[i]`` (at least one) symbols of the
    flat array ``sym``.  Returns the flat array and lengths after the last round."""
    word = np.repeat(np.arange(len(lens)), lens)
    done_word, done_sym = [], []
    rank = np.full(len(sym), NONE)
    inner = np.flatnonzero(word[:-1] == word[1:])
    rank[inner] = table.ranks(sym[inner], sym[inner + 1])
    while len(sym):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sizes = np.diff(starts, append=len(word))
        low = np.minimum.reduceat(rank, starts)
        open_ = np.repeat(low < NONE, sizes)
        if not open_.all():
            done_word.append(word[~open_])
            done_sym.append(sym[~open_])
            sym, word, rank, low = sym[open_], word[open_], rank[open_], np.repeat(low, sizes)[open_]
            if not len(sym):
                break
        else:
            low = np.repeat(low, sizes)
        at = np.flatnonzero(rank == low)
        overlap = np.zeros(len(at), bool)
        overlap[1:] = (at[1:] == at[:-1] + 1) & (word[at[1:]] == word[at[:-1]])
        at = at[_alternate(overlap)]
        sym[at] = table.merged[np.searchsorted(table.keys, sym[at] << 32 | sym[at + 1])]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1           # places of the merged symbols
        sym, word, rank = sym[keep], word[keep], rank[keep]
        touched = np.unique(np.concatenate([new, new[new > 0] - 1]))
        rank[touched] = NONE
        touched = touched[touched + 1 < len(sym)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched] = table.ranks(sym[touched], sym[touched + 1])
    word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(lens))


def merge_long(sym: np.ndarray, table: Table) -> np.ndarray:
    """Merges one long word rank by rank."""
    n = len(sym)
    sym = sym.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.ones(n, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(at: np.ndarray) -> None:
        at = at[after[at] < n]
        rank = table.ranks(sym[at], sym[after[at]])
        at, rank = at[rank < NONE], rank[rank < NONE]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        for part, r in zip(np.split(at, np.flatnonzero(np.diff(rank)) + 1), rank[np.flatnonzero(np.diff(rank, prepend=-1))],
                           strict=True) if len(at) else ():
            if int(r) not in waiting:
                waiting[int(r)] = []
                heapq.heappush(heap, int(r))
            waiting[int(r)].append(part)

    put(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(r)))
        left, right = table.pair[r] >> 32, table.pair[r] & 0xFFFFFFFF
        at = at[alive[at] & (after[at] < n)]
        at = at[(sym[at] == left) & (sym[after[at]] == right)]
        if left == right and len(at):
            at = at[_alternate(np.concatenate([[False], after[at[:-1]] == at[1:]]))]
        if not len(at):
            continue
        gone = after[at]
        sym[at] = table.merged[np.searchsorted(table.keys, table.pair[r])]
        alive[gone] = False
        after[at] = after[gone]
        inside = after[at] < n
        before[after[at][inside]] = at[inside]
        put(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
    return sym[alive]


def encode_words(words: list[bytes], table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lens) of the words, one after the other."""
    lens = np.array([len(w) for w in words], np.int64)
    long = np.flatnonzero(lens > LONG)
    short = [w for w in words if len(w) <= LONG] if len(long) else words
    flat = table.byte_id[np.frombuffer(b"".join(short), np.uint8)]
    ids, sizes = merge_words(flat, lens[lens <= LONG], table)
    if not len(long):
        return ids, sizes
    parts = np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []
    left = iter(parts)
    out = [merge_long(table.byte_id[np.frombuffer(w, np.uint8)], table) if len(w) > LONG else next(left) for w in words]
    return np.concatenate(out), np.array([len(x) for x in out])


def encode_texts(texts: list[str | None], table: Table, split: Splitter) -> list[np.ndarray]:
    """The ids of each text."""
    words: list[str] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            words += split(text)
        ends[i + 1] = len(words)
    if not words:
        return [np.zeros(0, "<u4") for _ in texts]
    enc = pa.array(words, pa.large_string()).dictionary_encode()
    code, vocab = enc.indices.to_numpy(), enc.dictionary.to_pylist()
    plain = [i for i, w in enumerate(vocab) if w not in table.added]
    ids, lens = encode_words([vocab[i].encode() for i in plain], table)
    own = np.ones(len(vocab), np.int64)
    own[plain] = lens
    first = np.zeros(len(vocab) + 1, np.int64)
    np.cumsum(own, out=first[1:])
    flat = np.zeros(first[-1], np.int64)
    taken = np.ones(len(vocab), bool)
    for i in np.setdiff1d(np.arange(len(vocab)), plain):
        flat[first[i]] = table.added[vocab[i]]
        taken[i] = False
    flat[np.repeat(taken, own)] = ids
    all_ids = flat[_ranges(first[:-1][code], own[code])].astype("<u4")
    cut = np.zeros(len(words) + 1, np.int64)
    np.cumsum(own[code], out=cut[1:])
    return [all_ids[cut[a]:cut[b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lens[0] of them), then the same of each next range."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def decode_ids(ids: list[bytes | None], table: Table) -> list[str]:
    """The text of each packed id list; unknown ids raise."""
    flat = np.frombuffer(b"".join(x or b"" for x in ids), "<u4").astype(np.int64)
    lens = np.diff(table.starts)[flat]
    data = table.data[_ranges(table.starts[flat], lens)].tobytes()
    ends = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(lens, out=ends[1:])
    at = ends[np.cumsum([0, *(len(x or b"") // 4 for x in ids)])]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def default_file() -> str:
    import public_tokenizers
    return public_tokenizers.path(FILE)


def encode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) instead of the text
    ``column``, and ``n_tokens``.  ``path`` is read on the driver; the tables (about
    2 MB, bounded by the vocabulary) are sent to the tasks."""
    table = docs.sparkSession.sparkContext.broadcast(load(path or default_file()))
    rest = [c for c in docs.columns if c not in (column, "ids", "n_tokens")]
    src = docs.select(*rest, F.col(column).alias("__text"))
    out = src.drop("__text").select("*", F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches):
        split = Splitter(table.value)
        for batch in steps(batches, "__text"):
            ids = encode_texts(batch.column("__text").to_pylist(), table.value, split)
            kept = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())],
                [*rest, "ids", "n_tokens"])

    return src.mapInArrow(run, out)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` with the text ``decoded`` of the column ``ids``, special tokens included."""
    table = tokens.sparkSession.sparkContext.broadcast(load(path or default_file()))
    src = tokens.drop("decoded")

    def run(batches):
        for batch in steps(batches, "ids"):
            text = decode_ids(batch.column("ids").to_pylist(), table.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    return src.mapInArrow(run, src.select("*", F.lit("").alias("decoded")).schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the packed ids and of the decoded text."""
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
