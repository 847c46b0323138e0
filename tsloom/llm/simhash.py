"""SimHash near-duplicates by pivot distance tables.

Fingerprints.  Texts are lower-cased (A-Z), cut into words at white space and
hashed as overlapping shingles (3 words, XXH64 with seed 42), all in numpy over
batches of whole texts.  A bit is set where over half of the hashes set it.

Links.  Two fingerprints link at a Hamming distance of RADIUS or less.  Equal
ones are collapsed first, in two steps, so copies cost nothing further.

Blocks deal out the work: the free bits of a fingerprint, all 64 at first, are
cut into six runs; two fingerprints at distance 3 or less agree in at least
three of the six, so they meet under one of 20 keys of about half the bits.  A
key that more than HOT fingerprints share isn't taken by one task: its rows come
back with the key's bits as fixed ones and are dealt anew by the rest, at most
LEVELS times; by then so few bits are free that distinct fingerprints run out.

Pivot tables find the links inside a key: the distances of each fingerprint to
the PIVOTS reference fingerprints are computed once a batch, rows are sorted by
the first of them and only neighbours within RADIUS there are paired, a shift at
a time; pairs whose largest coordinate difference exceeds RADIUS are discarded,
the survivors verified exactly.  Spanning stars of what is connected leave a
task, never all pairs.  (Pivots alone can't deal out rows: a random pair agrees
within 3 in a coordinate in 47 of 100 cases, so a key of coordinates would need
dozens of them, each with its neighbouring values as copies.)

Components follow by alternating large- and small-star rounds over tables in
the shared folder.

near_duplicates(.., shingle=5, similarity=(4, 5)) links by the exact similarity
of shingle sets instead (simhash_sets): there, too, pivot tables over
fingerprints discard the pairs, with a bound that holds for certain.

Defined results: null and empty texts have fingerprint zero and link like any
other; null ids are kept, a component's id is its smallest non-null id, or null;
repeated rows are repeated in the result; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.textbytes import LOWER, SOLID, runs, words, xxh64
from tsloom.session import drop, staged

SHINGLE, RADIUS, SEED = 3, 3, 42
PIVOTS = np.random.default_rng(20).integers(0, 1 << 63, size=32, dtype=np.uint64) * np.uint64(2) ^ np.random.default_rng(21).integers(0, 1 << 63, size=32, dtype=np.uint64)
#: Pairs held at once inside a key.
HELD = 1 << 18
#: Fingerprints of a key that one task pairs up; keys of more are dealt anew.
HOT, LEVELS = 4096, 3
#: Partial results of a fingerprint that its first step of collapsing spreads over.
SALTS = 16

#: Byte j of SPREAD[b] is bit j of b.
SPREAD = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words, row by row, and how many each row has; fewer words are one shingle."""
    low = LOWER[data]
    starts, ends, rows = words(low, offsets, SOLID)
    keep = SOLID[low]
    after = ends[ends < len(low)]
    after = after[~SOLID[low[after]]]
    keep[after] = True
    low[after] = 32
    moved = np.cumsum(keep) - keep
    text, starts, ends = low[keep], moved[starts], moved[ends - 1] + 1
    n = np.diff(rows)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) + np.repeat(rows[:-1] - first, counts)
    last = at + np.repeat(np.minimum(n, size) - 1, counts)
    return xxh64(text, starts[at], ends[last], SEED), counts


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One fingerprint for each row."""
    h, counts = shingles_of(data, offsets, size)
    first = np.cumsum(counts) - counts
    # Counts of set bits, a byte each, over runs of at most 255 shingles.
    pieces = -(-counts // 255)
    begin = np.repeat(first, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begins = (np.cumsum(pieces) - pieces)[full]
    for k in range(8):
        packed = np.add.reduceat(SPREAD[(h >> np.uint64(8 * k)) & np.uint64(255)], begin)
        bits = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), begins, axis=0)
        set_ = (2 * bits > counts[full, None]).astype(np.uint64)
        out[full] |= (set_ << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint(size: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in runs(batch):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(fingerprints_of(data, offsets, size).view(np.int64))], names=["doc_id", "carried", "fp"])

    return prints


@cache
def narrower(mask: int) -> tuple[int, ...]:
    """The masks that fix half of the free bits, too: three of six runs of them each."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // 6 for k in range(7)]
    blocks = [sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
    return tuple(dict.fromkeys(mask | a | b | c for a, b, c in combinations(blocks, 3)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, fp) under each narrower mask, with a hash of the bits it fixes as key."""
    for batch in batches:
        masks, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        for mask in np.unique(masks).tolist():
            own = fps[masks == mask]
            for new in narrower(mask):
                # A clash of keys adds candidates only, each is verified.
                salt = np.uint64(new * 0x9E3779B97F4A7C15 >> 7 & (1 << 64) - 1)
                with np.errstate(over="ignore"):
                    key = ((own & np.uint64(new)) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                yield pa.record_batch([pa.array((key ^ (key >> np.uint64(29))).view(np.int64)), pa.array(np.full(len(own), new, np.uint64).view(np.int64)), pa.array(own.view(np.int64))], names=["key", "mask", "fp"])


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that it is connected to by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links among distinct fingerprints that share a key; rows come sorted by key."""
    fresh = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff([*fresh, len(key)])
    rows = np.repeat(sizes, sizes) > 1
    key, fp = key[rows], fp[rows].view(np.uint64)
    if not len(key):
        return fp, fp
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :1]).astype(np.int16)
    order = np.lexsort((table[:, 0], group))  # by the first pivot's distance
    group, fp = group[order], fp[order]
    table = np.stack([np.bitwise_count(fp ^ p) for p in PIVOTS]).astype(np.int16)
    live, shift = np.arange(len(fp)), 1
    left, right, held = [], [], 0
    while len(live):
        live = live[live + shift < len(fp)]
        other = live + shift
        near = (group[live] == group[other]) & (table[0, other] - table[0, live] <= RADIUS)
        live = live[near]  # sorted: a row whose neighbour is too far has none beyond it
        x, y = live, live + shift
        for coordinate in table[1:]:
            ok = np.abs(coordinate[x] - coordinate[y]) <= RADIUS
            x, y = x[ok], y[ok]
        ok = np.bitwise_count(fp[x] ^ fp[y]) <= RADIUS
        left.append(x[ok])
        right.append(y[ok])
        held += int(ok.sum())
        if held > HELD:
            root = stars(np.concatenate(left), np.concatenate(right), len(fp))
            inner = np.flatnonzero(root != np.arange(len(fp)))
            left, right, held = [root[inner]], [inner], 0
        shift += 1
    a, b = np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])
    root = stars(a, b, len(fp))
    inner = np.flatnonzero(root != np.arange(len(fp)))
    return fp[inner], fp[root[inner]]


def _links(last: bool):
    """Rows (key, mask, fp) sorted by key to star links (u, v), and rows (mask, fp) of keys with too many rows for a task, unless it is the last level."""

    def pack(**columns: np.ndarray) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.record_batch([pa.array(columns[c].view(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in ("u", "v", "mask", "fp")], names=["u", "v", "mask", "fp"])

    def done(key: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not last:
            begins = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            sizes = np.diff([*begins, len(key)])
            hot = np.repeat(sizes > HOT, sizes)
            if hot.any():
                yield pack(mask=mask[hot], fp=fp[hot])
                key, fp = key[~hot], fp[~hot]
        for a in _chunks(key):
            u, v = linked(key[a], fp[a])
            yield pack(u=u, v=v)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed = [np.zeros(0, np.int64)] * 3, None  # rows of the last key, or the key whose rows are passed on
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if passed is not None:
                n = int(np.searchsorted(held[0], passed, "right"))
                yield pack(mask=held[1][:n], fp=held[2][:n])
                held = [h[n:] for h in held]
            if not len(held[0]):
                continue
            passed, cut = None, int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from done(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
            if len(held[0]) > HOT and not last:
                passed = held[0][0]
                yield pack(mask=held[1], fp=held[2])
                held = [h[:0] for h in held]
        if len(held[0]):
            yield from done(*held)

    return links


def _chunks(key: np.ndarray, size: int = 1 << 17) -> Iterator[slice]:
    at = 0
    while at < len(key):
        to = len(key) if at + size >= len(key) else int(np.searchsorted(key, key[at + size], "left"))
        to = to if to > at else int(np.searchsorted(key, key[at], "right"))
        yield slice(at, to)
        at = to


def links(distinct: DataFrame) -> DataFrame:
    """Star links (u, v) among distinct fingerprints (column fp)."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo, found = distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    for level in range(1, LEVELS + 1):
        keyed = todo.mapInArrow(_keyed, "key long, mask long, fp long").repartition(n, "key").sortWithinPartitions("key")
        rows = staged(keyed.mapInArrow(_links(level == LEVELS), "u long, v long, mask long, fp long"), "pairs")
        found.append(rows.filter("u IS NOT NULL").select("u", "v"))
        todo = rows.filter("u IS NULL").select("mask", "fp")
        if level == LEVELS or todo.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def collapsed(rows: DataFrame, key: str, *values) -> DataFrame:
    """One row for each key with aggregates `values` (name, function): the parts of a hot key are gathered by several tasks first."""
    parts = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy(key, "salt").agg(*[f(n).alias(n) for n, f in values])
    return parts.groupBy(key).agg(*[f(n).alias(n) for n, f in values])


def components(edges: DataFrame) -> DataFrame:
    """Rows (fp, root) of the fingerprints that have links; root is the smallest in signed order."""
    oriented = lambda d: d.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = staged(oriented(edges), "links")
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = oriented(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        before, now = now, staged(oriented(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))), "links")
        drop(before)
        new = now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if new == sign:
            return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        sign = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] | None = None, carried: Column | None = None) -> DataFrame:
    """Rows (doc_id, carried, fp, root, component_id), one for each document; carried is a long of the caller's, or null.

    With a similarity, a fraction (n, m), texts link where their sets of
    shingles share n / m of their union or more, and fp is a hash of the set.
    """
    carried = F.lit(None) if carried is None else carried
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), carried.cast("long").alias("carried"), F.col(text_col).cast("string").alias("text"))
    if similarity is not None:
        from tsloom.llm import simhash_sets

        return simhash_sets.near_duplicates(texts, shingle, similarity)
    prints = staged(texts.mapInArrow(_fingerprint(shingle), "doc_id long, carried long, fp long"), "fingerprints")
    distinct = staged(collapsed(prints, "fp", ("doc_id", F.min)), "distinct")
    return grouped(prints, distinct, components(links(distinct.select("fp"))))


def grouped(prints: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (doc_id, carried, fp, root, component_id) for the rows (doc_id, carried, fp), each fingerprint's smallest id and the components of fingerprints."""
    distinct = distinct.withColumnRenamed("doc_id", "low")
    members = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    # Tables of their own on the small side: Spark can then split a hot root or fingerprint on the large one.
    ids = staged(members.join(distinct, "fp").groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    known = distinct.join(members.join(ids, "root"), "fp", "left")
    classes = staged(known.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id")), "classes")
    return prints.join(classes, "fp").select("doc_id", "carried", "fp", "root", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
