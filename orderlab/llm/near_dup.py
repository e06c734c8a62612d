"""MinHash near-duplicate groups with HyperMinHash sketches.

A document's set is its distinct ``width``-word shingles (lower-cased A-Z; with
fewer words, the whole sequence).  Documents with Jaccard similarity >= ``percent``
/ 100 are linked; a group is a connected component.

1. *Sketch.*  One narrow pass hashes each shingle to 64 bits.  The hash picks one of
   ``REGISTERS`` buckets; a bucket keeps the leading-zero count of its smallest
   remaining hash plus ``MANTISSA`` bits after the leading one.  The set's own
   128-bit fingerprint makes exact copies one class, represented by its smallest id.
2. *Bands.*  Registers are grouped into bands; equal bands propose candidates.  With
   more bands than differing shingles one band of a linked pair must agree, and with
   ``PREFIX`` shingles the chance that it is empty is below ``MISS``; larger sets use as
   many bands as make the chance of a miss below ``MISS``.  Sets under ``PREFIX``
   shingles have no bands: their keys are their smallest shingle hashes, one more than
   a linked pair can differ in, of which a linked pair must share one.  The key also
   holds a size class (each document is in two neighbouring ones), since linked sets
   have similar sizes.
3. *Candidates.*  In each band bucket every member is paired with one hub, the member
   that has the most company over all its buckets, never with all others.  After the
   linked pairs are merged into components, two linked members of a bucket that are still
   apart differ from its hub h alike: with D(x) the shingles in which x and h differ,
   |D(a) & D(b)| = (|D(a)| + |D(b)| - |a ^ b|) / 2, which the bound on |a ^ b| makes at
   least one unless both are linked to h.  So the members of split buckets are keyed by
   the differences from their hub, by a prefix filter: the rarest ones first, as many as
   the smallest overlap that a partner needs leaves (``_apart``).  A pair comes up only
   where its sizes and the differences that are not its own alone can reach the overlap.
   Before that, members of which too many shingles occur nowhere else in such buckets are
   left out.  No link between components is lost, nothing is capped, and a group of
   variants costs no comparison of all its pairs; copies cost one each.
4. *Estimate.*  Pairs whose collision-corrected Jaccard estimate is more than
   ``SLACK`` below the bound are dropped (about 5 standard errors).  Pairs with a set
   of at most ``SMALL`` shingles are all verified.
5. *Verification.*  The rest is confirmed on the full shingle sets.
6. *Components.*  Alternating minimum-label star steps on the links, as DataFrames.

Edge cases: null, empty and blank texts have an empty set and are linked with
nothing; a row with a null ``doc_id`` is linked with nothing and has a null component;
rows that repeat a ``doc_id`` are each grouped, kept or dropped by their own text; extra
columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlab.llm.common import WORDS_LOWER, Words, cut, materialize, rows, shuffles_deleted, steps

REGISTERS = 192
MANTISSA = 4       # of 8 bits; the leading-zero count has the other 4
EMPTY = np.uint8(0xFF)
MISS = 1e-6
SLACK = 0.14
PREFIX = 128       # shingles
SMALL = 64         # shingles; a sketch says no more about such a set than the set itself

SKETCH = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("registers", pa.binary()),
                    ("small", pa.binary())])
SKETCH_DDL = "doc_id bigint, hash bigint, n bigint, fp binary, registers binary, small binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the sorted distinct shingle hashes of row i are
    hashes[bounds[i]:bounds[i+1]]."""
    w = Words(column, WORDS_LOWER)
    n = len(w.counts)
    h = np.array([xxhash.xxh3_64_intdigest(v) for v in w.vocab.to_pylist()], np.uint64)
    h = h[w.code] if len(w.code) else np.zeros(0, np.uint64)
    doc, keys = [], []
    with np.errstate(over="ignore"):
        size = len(h) - width + 1
        if size > 0:
            at = np.flatnonzero(w.doc[:size] == w.doc[width - 1:])
            key = np.full(len(at), width, np.uint64)
            for j in range(width):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + h[at + j])
            doc.append(w.doc[at])
            keys.append(key)
        for d in np.flatnonzero((w.counts > 0) & (w.counts < width)):  # the whole sequence as one
            key = np.full(1, w.counts[d], np.uint64)
            for j in range(w.bounds[d], w.bounds[d + 1]):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + h[j])
            doc.append(np.array([d]))
            keys.append(key)
    if not doc:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    doc, keys = np.concatenate(doc), np.concatenate(keys)
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    doc, keys = doc[new], keys[new]
    return np.searchsorted(doc, np.arange(n + 1)), keys


def sketch(bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each row's set: leading zeros, then mantissa."""
    n = len(bounds) - 1
    out = np.full((n, REGISTERS), EMPTY, np.uint8)
    if not len(keys):
        return out
    with np.errstate(over="ignore"):
        h = _mix(keys + np.uint64(0x2545F4914F6CDD1D))
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    with np.errstate(over="ignore"):
        rest = _mix(h + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)  # 53 bits: exact as a float
    cell = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds)) * REGISTERS + bucket.astype(np.int64)
    order = np.lexsort((rest, cell))
    cell, rest = cell[order], rest[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    cell, low = cell[first], np.maximum(rest[first], np.uint64(1))
    frac, exp = np.frexp(low.astype(np.float64))          # low = frac * 2^exp, 0.5 <= frac < 1
    zeros = np.minimum(53 - exp, 14).astype(np.int64)
    mantissa = ((frac * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out.reshape(-1)[cell] = (zeros << MANTISSA | mantissa).astype(np.uint8)
    return out


def band_count(percent: int) -> int:
    """Most registers per band that keep the chance of a miss at the bound below MISS."""
    t = percent / 100
    best = REGISTERS
    for r in range(2, 13):
        if (1 - t ** r) ** (REGISTERS // r) <= MISS:
            best = REGISTERS // r
    return best


def _band_block(c: np.ndarray, registers: np.ndarray, bands: int) -> tuple[list, list]:
    edge = np.arange(bands + 1) * REGISTERS // bands
    row, key = [], []
    for b in range(bands):
        part = registers[edge[b]:edge[b + 1]]
        full = np.flatnonzero((part != EMPTY).any(axis=0))
        with np.errstate(over="ignore"):
            k = _mix((c.astype(np.uint64) << np.uint64(16)) + np.uint64(b + 1))
            for r in part:
                k = (k ^ r) * np.uint64(0x9E3779B97F4A7C15)
                k ^= k >> np.uint64(32)
            k = _mix(k)
        row.append(full)
        key.append(k[full])
    return row, key


def _differing(c: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles in which two linked sets that meet in size class c differ: both have
    under t^-(c+1) shingles, and they differ in at most (1-t)/t of the smaller one."""
    t = percent / 100
    return np.floor((1 - t) / t * t ** -(c + 1.0) + 1e-9).astype(np.int64)


def _size_class(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(percent / 100) + 1e-9).astype(np.int64)


def _by_prefix(c: np.ndarray, percent: int) -> np.ndarray:
    """Size classes whose sets all have under PREFIX shingles."""
    return (percent / 100) ** -(c + 1.0) < PREFIX


def smallest(bounds: np.ndarray, keys: np.ndarray, percent: int) -> list:
    """The (mixed) shingle hashes that a set needs as keys in its two size classes, in rising
    order; None for sets that are in no class of small sets."""
    n = np.diff(bounds)
    c = _size_class(n, percent)
    most = np.where(_by_prefix(c + 1, percent), _differing(c + 1, percent),
                    np.where(_by_prefix(c, percent), _differing(c, percent), -1)) + 1
    with np.errstate(over="ignore"):
        return [np.sort(_mix(keys[lo:hi]))[:k].tobytes() if k and hi > lo else None
                for lo, hi, k in zip(bounds[:-1], bounds[1:], most, strict=True)]


def band_keys(n: np.ndarray, registers: np.ndarray, small: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every non-empty band, or of every smallest hash of small sets, for the
    two size classes of each row."""
    most, size_class = band_count(percent), _size_class(n, percent)
    by_register = np.ascontiguousarray(registers.T).astype(np.uint64)
    row, key = [], []
    for shift in (0, 1):
        c = size_class + shift
        prefix = _by_prefix(c, percent)
        for i in np.flatnonzero(prefix & (n > 0)):
            h = np.frombuffer(small[i], np.uint64)[:_differing(c[i:i + 1], percent)[0] + 1]
            with np.errstate(over="ignore"):
                key.append(_mix(h + c[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            row.append(np.full(len(h), i))
        bands = np.minimum(most, _differing(c, percent) + 1)
        for k in np.unique(bands[(n > 0) & ~prefix]):
            own = np.flatnonzero((bands == k) & (n > 0) & ~prefix)
            r, h = _band_block(c[own], by_register[:, own], int(k))
            row += [own[x] for x in r]
            key += h
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(row), np.concatenate(key).view(np.int64)


def estimate(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows: share of equal registers among those in use,
    less the share of unequal ones that is expected to agree by chance.  The published
    HyperMinHash approximation of that chance holds when both sets fill their registers;
    for smaller sets nothing is taken off, so the estimate can only be too high."""
    used = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=1), 1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1) / used
    big, small = np.maximum(na, nb), np.minimum(na, nb)
    ratio = big / np.maximum(small, 1)
    chance = 0.169919487159739093975315012348 / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    chance = np.where(small >= 4 * REGISTERS, chance, 0.0)
    return np.maximum(equal - chance, 0) / (1 - chance)


def near(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Mask of the pairs whose estimate is not clearly below the bound."""
    return (np.minimum(na, nb) <= SMALL) | (estimate(na, nb, a, b) >= percent / 100 - SLACK)


def _registers(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, REGISTERS), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in steps(batches):
            bounds, keys = shingle_sets(batch.column("text"), width)
            reg = sketch(bounds, keys)
            fp = [xxhash.xxh3_128_digest(keys[lo:hi].tobytes()) if hi > lo else None
                  for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield rows(SKETCH, batch.column("doc_id"), batch.column("hash"), np.diff(bounds), fp, [r.tobytes() for r in reg],
                       smallest(bounds, keys, percent))

    return docs.select("doc_id", "hash", "text").mapInArrow(run, SKETCH_DDL)


def _bands(reps: DataFrame, percent: int) -> DataFrame:
    """(key, id, n) of every band of every class representative."""
    out = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                n = part.column("n").to_numpy()
                row, key = band_keys(n, _registers(part.column("registers")),
                                     part.column("small").to_pylist(), percent)
                yield rows(out, key, part.column("id").to_numpy()[row], n[row])

    return reps.select("id", "n", "registers", "small").mapInArrow(run, "key bigint, id bigint, n bigint")


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate is not clearly below the bound."""
    r = reps.select("id", "n", "registers")
    both = (pairs.join(r.toDF("a", "na", "ra"), "a").join(r.toDF("b", "nb", "rb"), "b"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = near(batch.column("na").to_numpy(), batch.column("nb").to_numpy(),
                        _registers(batch.column("ra")), _registers(batch.column("rb")), percent)
            got = batch.filter(pa.array(keep))
            yield rows(out, got.column("a"), got.column("b"))

    return both.mapInArrow(run, "a bigint, b bigint")


def _set_rows(width: int):
    """Task function: (id, text) to (id, packed shingle hashes)."""
    set_schema = pa.schema([("id", pa.int64()), ("keys", pa.binary())])

    def sets(batches):
        for batch in steps(batches):
            bounds, keys = shingle_sets(batch.column("text"), width)
            yield rows(set_schema, batch.column("id"),
                       [keys[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)])

    return sets


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs confirmed on the full shingle sets of their two documents."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    one = texts.join(ids, "id").select("id", "text").mapInArrow(_set_rows(width), "id bigint, keys binary")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ka"), batch.column("kb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            got = batch.filter(pa.array(keep, pa.bool_()))
            yield rows(out, got.column("a"), got.column("b"))

    return (pairs.join(one.toDF("a", "ka"), "a").join(one.toDF("b", "kb"), "b")
            .select("a", "b", "ka", "kb").mapInArrow(confirm, "a bigint, b bigint").distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over the links (a, b), by alternating
    large-star and small-star steps; only ids with a link are listed."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    while True:
        # large star: each larger neighbour is linked to the smallest id around its node
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours and the node itself are linked to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # done when every node has one target and no target has one itself
        ends = edges.select("u").union(edges.select("v").distinct())
        if ends.groupBy("u").count().where("count > 1").isEmpty():
            break
    return cut(edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
                       .union(edges.select("v", "v").distinct()))


def _confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    near = materialize(_near(pairs, reps, percent), "near")
    return materialize(_verified(near, texts, width, percent), "links")


def _alone(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, alone): how many of the id's shingles occur in none of the other ``ids``;
    the rest bounds its overlap with any of them."""
    key_schema = pa.schema([("id", pa.int64()), ("key", pa.int64())])

    def keys(batches):
        for batch in steps(batches):
            bounds, found = shingle_sets(batch.column("text"), width)
            yield rows(key_schema, np.repeat(batch.column("id").to_numpy(), np.diff(bounds)), found.view(np.int64))

    each = texts.join(ids, "id").select("id", "text").mapInArrow(keys, "id bigint, key bigint")
    return (each.groupBy("key").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1")
             .groupBy("id").agg(F.count("*").alias("alone")))


def _apart(todo: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, links) of the members of split buckets; ``todo``: hub, id, n, c (component),
    inner (whether that is the largest component around the hub).

    With |a ^ b| <= (1-t)/(1+t) (|a|+|b|) for linked sets, D(a) and D(b) share at least half
    of |D(a)| + |D(b)| less that; and since |D(b)| is no smaller than what they share and
    |b| <= |a| / t, at least |D(a)| - (1-t)/t |a|: the prefix of D(a) is what that leaves."""
    met = todo.select("id").union(todo.select("hub")).distinct()
    one = materialize(texts.join(met, "id").select("id", "text").mapInArrow(_set_rows(width), "id bigint, keys binary"), "sets")
    out = pa.schema([("hub", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("inner", pa.bool_()),
                     ("nd", pa.int64()), ("linked", pa.bool_()), ("diff", pa.list_(pa.int64()))])

    def differ(batches):
        for batch in batches:
            for part in (batch.slice(lo, 512) for lo in range(0, batch.num_rows, 512)):
                diff, linked = [], []
                for own, hub in zip(part.column("own"), part.column("other"), strict=True):
                    x, h = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(hub.as_buffer(), np.uint64)
                    d = np.setxor1d(x, h, assume_unique=True)
                    diff.append(d.view(np.int64))
                    linked.append((100 + percent) * len(d) <= (100 - percent) * (len(x) + len(h)))
                yield rows(out, *[part.column(k) for k in ("hub", "id", "n", "c", "inner")], [len(d) for d in diff], linked, diff)

    d = materialize(todo.join(one.toDF("id", "own"), "id").join(one.toDF("hub", "other"), "hub")
                    .select("hub", "id", "n", "c", "inner", "own", "other").mapInArrow(
                        differ, "hub bigint, id bigint, n bigint, c bigint, inner boolean, nd bigint, linked boolean, diff array<bigint>"),
                    "differences")
    links = d.where("linked").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    least = F.greatest(F.col("nd") - F.floor(F.lit(100 - percent) * F.col("n") / percent), F.lit(1))
    shared = Window.partitionBy("hub", "key")    # texts with one difference: counted, never collected
    mine = Window.partitionBy("hub", "id")       # the differences of one text
    common = d.select("hub", "id", "n", "c", "inner", "nd", F.explode("diff").alias("key")).withColumn(
        "df", F.count("*").over(shared)).where("df > 1")
    common = (common.withColumn("reach", F.count("*").over(mine)).where(F.col("reach") >= least)
              .withColumn("at", F.row_number().over(mine.orderBy("df", "key")) + F.col("nd") - F.col("reach"))
              .where(F.col("at") <= F.col("nd") - least + 1))
    keyed = materialize(common.select("hub", "key", "id", "n", "c", "nd", "reach", "inner"), "keys")
    other = keyed.toDF("hub", "key", "ido", "no", "co", "ndo", "reacho", "innero")
    pairs = (keyed.where("not inner").join(other, ["hub", "key"])
             .where("c <> co and (innero or id < ido)")
             .where(f"100 * least(n, no) >= {percent} * greatest(n, no)")
             .where(f"{2 * (100 + percent)} * least(reach, reacho) >= {100 + percent} * (nd + ndo) - {100 - percent} * (n + no)")
             .select(F.least("id", "ido").alias("a"), F.greatest("id", "ido").alias("b")).distinct())
    return pairs, links


def _text_hash():
    """Tells the texts of rows with one id apart."""
    return F.xxhash64("text")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, class_id, component_id, kept."""
    with shuffles_deleted(docs.sparkSession):
        return _group_rows(docs, width, percent)


def _group_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("hash"), "text")
    sk = materialize(sketches(docs, width, percent), "sketches")
    # classes of equal sets with numbers of their own; ``first`` is the row that stands for one
    classes = sk.where("fp is not null and doc_id is not null").groupBy("fp").agg(
        F.min(F.struct("doc_id", "hash")).alias("first"))
    classes = materialize(classes.select("fp", "first.*").withColumn("id", F.monotonically_increasing_id()), "classes")
    all_reps = materialize(sk.join(classes, ["fp", "doc_id", "hash"]).dropDuplicates(["fp", "doc_id", "hash"])
                           .select("id", "n", "registers", "small"), "representatives")
    bands = _bands(all_reps, percent)
    several = bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("top")).where("low <> top")
    shared = materialize(bands.join(several, "key").select("key", "id", "n"), "bands")
    members = shared.select("id").distinct()
    firsts = classes.join(members, "id").select("id", "doc_id", "hash")
    texts = materialize(docs.join(firsts, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("id", "text"), "texts")
    reps = materialize(all_reps.drop("small").join(members, "id"), "members")
    # hub of a bucket: the member with the most company over all its buckets, so that a group
    # of copies meets around the same few central texts
    company = shared.join(shared.groupBy("key").agg(F.count("*").alias("mates")), "key").groupBy("id").agg(
        F.sum("mates").alias("company"))
    hubs = shared.join(company, "id").groupBy("key").agg(
        F.max(F.struct("company", F.negative("id").alias("minus"), "n")).alias("h"))
    hubs = cut(hubs.select("key", F.negative("h.minus").alias("hub"), F.col("h.n").alias("nh"), "h.company"))
    sizes = f"100 * least(n, nh) >= {percent} * greatest(n, nh)"
    pairs = shared.join(hubs, "key").where("id <> hub").where(sizes).select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = _confirm(pairs, reps, texts, width, percent)
    comp = components(links)
    # buckets whose members are still in several components
    at = shared.join(comp, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    todo = _split(at)
    ids = todo.select("id", "n").distinct()
    reach = ids.join(_alone(ids.select("id"), texts, width), "id", "left").where(
        f"100 * (n - coalesce(alone, 0)) >= {percent} * n").select("id")  # others can have no link
    todo = materialize(_around(_split(todo.join(reach, "id")), hubs), "split")
    if not todo.isEmpty():
        pairs, more = _apart(todo, texts, width, percent)
        comp = components(links.union(_confirm(pairs, reps, texts, width, percent)).union(more))
    low = comp.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = comp.join(low, "component").select("id", "component_id")
    return (sk.join(classes.select("fp", "id", F.col("doc_id").alias("class_id")), "fp", "left").join(named, "id", "left")
            .select("doc_id", "hash", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "class_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _around(todo: DataFrame, hubs: DataFrame) -> DataFrame:
    """(hub, id, n, c, inner): the texts that the members of each split bucket are held against.  Any
    text will do, so a bucket takes, of the hubs its members meet in all their buckets, the one
    with the most company: a group of variants has few of them and each member differs from few."""
    top = lambda hub: F.max(F.struct("company", F.negative(hub).alias("minus"))).alias("h")
    own = todo.join(hubs.select("key", "hub", "company"), "key").groupBy("id").agg(top("hub"))
    best = todo.select("key", "id").join(own, "id").groupBy("key").agg(F.max("h").alias("h"))
    best = best.select("key", F.negative("h.minus").alias("hub"))
    around = cut(todo.join(best, "key").where("id <> hub").select("hub", "id", "n", "c").distinct())
    main = around.groupBy("hub", "c").agg(F.count("*").alias("size")).groupBy("hub").agg(
        F.max_by("c", F.struct("size", "c")).alias("main"))
    return around.join(main, "hub").select("hub", "id", "n", "c", (F.col("c") == F.col("main")).alias("inner"))


def _split(at: DataFrame) -> DataFrame:
    """The rows (key, id, n, c) of the buckets with more than one component."""
    split = at.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("top")).where("low <> top").select("key")
    return cut(at.join(split, "key").select("key", "id", "n", "c"))


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id,
    kept, one row per document."""
    return _grouped(docs, width, percent).drop("hash")


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group (the smallest id), unchanged; rows that
    repeat its id and text, and rows without an id, are kept."""
    gone = _grouped(docs, width, percent).where("doc_id is not null and not kept").select(
        F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    same = (F.col("doc_id") == F.col("__id")) & (_text_hash() == F.col("__hash"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
