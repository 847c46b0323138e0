"""The similarity mode of the SimHash operator: texts linked by their sets of shingles.

No radius of majority fingerprints gives this: at a similarity of 0.8 two of 64
bits differ in 9.7 of them on average, in 16 and more now and then, and so do
many pairs at 0.6.  So the fingerprints are parity sketches here: every shingle
flips one of WORDS * 64 bits, and two sketches differ in at most as many bits as
the sets differ in shingles, for certain.

Sets.  A text is the set of its shingles (words and hashes as in simhash).  Two
texts link where the shared part of their sets' union is at least the asked
similarity n / m: that is, where the sets differ in at most (a + b)(m - n) /
(m + n) shingles.  Equal sets are collapsed first.

Candidates.  In one fixed order of all shingles, two sets of a and b shingles
that link share one among the first a - ceil(a n / m) + 1 of the one and the like
of the other, so each such shingle is a key and no pair is lost.  Any order
gives the same links.  The one used puts shingles that are frequent in a sample
of texts last: it only keeps common passages from being keys.

Pivot tables.  The texts of a key are compared with a few of them at a time,
first with one, then with ever more; texts that are in one component by then are
not compared again.  Sizes and places in the order, then the largest difference
of the distances to the PIVOTS reference sketches, then the sketches' own
distance discard pairs, all by bounds that lose none; the survivors are verified
on the whole sets.  A key of many texts is compared by several tasks, each with
some of the texts and all that these are compared with.

Defined results: null texts and such without words have the empty set and link
to each other; texts of fewer words than a shingle are one shingle; null ids are
kept, a component's id is its smallest non-null id, or null; repeated rows are
repeated in the result; an empty table gives no rows.  Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsloom.llm.simhash import collapsed, components, grouped, shingles_of
from tsloom.llm.textbytes import ragged, release, runs
from tsloom.session import drop, staged

#: Texts and shingles that the order is made of.
SAMPLE, COMMON = 20_000, 200_000
#: Each round compares with so many times the texts of the one before.
GROWTH = 64
#: Words of a sketch, so many that sets which differ a little too much rarely look nearer; reference sketches.
WORDS = 64
PIVOTS = np.random.default_rng(31).integers(0, 1 << 64, (6, WORDS), np.uint64, endpoint=False)
#: Cells of the filter that tells which sets are wanted, a bit each.
CELLS = 1 << 24
#: Texts of a key that a task compares with the others.
PART = 1 << 9


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' sets end to end, each in ascending order, their sizes and one hash of each set."""
    h, counts = shingles_of(data, offsets, shingle)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    sizes = np.bincount(row, minlength=len(counts))
    out = np.zeros(len(counts), np.uint64)
    with np.errstate(over="ignore"):
        m = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        m = (m ^ (m >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(m ^ (m >> np.uint64(29)), (np.cumsum(sizes) - sizes)[full])
    return h, sizes, out.view(np.int64)


def sketches_of(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity sketches (row, WORDS) of the sets that h holds end to end."""
    out = np.zeros((len(sizes), WORDS), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bit = np.uint64(1) << (h >> np.uint64(13) & np.uint64(63))
        word = (h >> np.uint64(29)) % np.uint64(WORDS)
        for w in range(WORDS):
            out[full, w] = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), (np.cumsum(sizes) - sizes)[full])
    return out


def _prints(shingle: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in runs(batch):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(sets_of(data, offsets, shingle)[2])], names=["doc_id", "carried", "fp"])

    return prints


def _shingles(shingle: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in runs(batch):
                h, n = np.unique(sets_of(data, offsets, shingle)[0], return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return counts


def _order(texts: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, ascending, and their levels; all others have level 0."""
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0)
    counted = some.mapInArrow(_shingles(shingle), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 4")
    top = counted.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, level = top.column("h").to_numpy().view(np.uint64), np.log2(top.column("n").to_numpy()).astype(np.int64)
    order = np.argsort(h)
    return h[order], level[order]


def _keys(common, shingle: int, similar: tuple[int, int]):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, levels = common.value
        for batch in batches:
            for _, data, offsets in runs(batch):
                h, sizes, fp = sets_of(data, offsets, shingle)
                level = np.zeros(len(h), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    level = np.where(hashes[at] == h, levels[at], 0)
                row = np.repeat(np.arange(len(sizes)), sizes)
                h = h[np.lexsort((h, level, row))]
                need = -(-sizes * similar[0] // similar[1])
                many = np.where(sizes > 0, sizes - need + 1, 0)
                first = np.cumsum(sizes) - sizes
                at, row = ragged(first, many), np.repeat(np.arange(len(sizes)), many)
                columns = [h[at].view(np.int64), fp[row], sizes[row].astype(np.int32), (at - first[row]).astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["key", "fp", "size", "place"])

    return keys


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, fp) without repeats, of keys that two or more sets have, numbered within their key."""
    key = fp = None  # of the last row
    last, nth, lone = None, 0, None
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
        fresh[0] = key is None or keys[0] != key or fps[0] != fp
        key, fp = keys[-1], fps[-1]
        rows = pa.Table.from_batches([batch]).filter(pa.array(fresh))
        if not len(rows):
            continue
        keys = rows.column("key").to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        number = np.arange(len(keys)) - np.repeat(begins, np.diff([*begins, len(keys)]))
        if keys[0] == last:
            number[: (begins[1] if len(begins) > 1 else len(keys))] += nth
        if lone is not None and keys[0] == last:
            rows, number, keys = pa.concat_tables([lone, rows]), np.concatenate([[0], number]), np.concatenate([[last], keys])
        more = number > 0
        more[:-1] |= number[1:] > 0
        last, nth = keys[-1], int(number[-1]) + 1
        # The last row may yet find others of its key.
        lone = rows.slice(len(rows) - 1) if number[-1] == 0 else None
        rows = rows.append_column("nth", pa.array(number.astype(np.int64))).filter(pa.array(more))
        yield from rows.combine_chunks().to_batches()


def _table(sketch: np.ndarray) -> np.ndarray:
    """Distances of the sketches to the reference sketches, a column each."""
    return np.stack([np.bitwise_count(sketch ^ p).sum(axis=1, dtype=np.int64) for p in PIVOTS], axis=1).astype(np.int16)


def _near_ones(x: np.ndarray, y: np.ndarray, table_x: np.ndarray, table_y: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the pairs x[i], y[j] whose sketches differ in at most so many bits: by the largest coordinate difference first, then bit by bit."""
    live = np.flatnonzero(np.abs(table_x[i] - table_y[j]).max(axis=1, initial=0) <= bound)
    apart = np.bitwise_count(x[i[live]] ^ y[j[live]]).sum(axis=1, dtype=np.int64)
    ok = apart <= bound[live]
    return live[ok], apart[ok]


def _sketches(column: pa.Array) -> np.ndarray:
    flat = pa.concat_arrays([column]).cast(pa.binary(8 * WORDS))
    return np.frombuffer(flat.buffers()[1], np.uint64)[flat.offset * WORDS :][: len(flat) * WORDS].reshape(-1, WORDS)


def _bound(a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Shingles in which two linked sets of these sizes differ at most."""
    less, more = similar
    return (a.astype(np.int64) + b) * (more - less) // (more + less)


def _near(similar: tuple[int, int]):
    """Rows (u, v, a, b, x, y) of pairs with their sizes and sketches to the pairs that may link, with their distance."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_sketches(batch.column(c)) for c in ("x", "y"))
            each = np.arange(len(x))
            ok, apart = _near_ones(x, y, _table(x), _table(y), each, each, _bound(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")), similar))
            yield pa.record_batch([batch.column("u").take(pa.array(ok)), batch.column("v").take(pa.array(ok)), pa.array(apart)], names=["u", "v", "apart"])

    return near


def _pairs(low: int, high: int, similar: tuple[int, int]):
    """Pairs of the texts numbered low <= nth < high of a part of a key with its texts after them, as far as they may link and are in two components."""
    less, more = similar

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = None  # the first rows of the last part, which may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, nth, fp, size, place, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "nth", "fp", "size", "place", "root"))
            sketched = "sketch" in batch.schema.names
            rows, old = (key, part, nth, fp, size.astype(np.int64), place.astype(np.int64), root, *([_sketches(batch.column("sketch"))] if sketched else [])), 0
            if begun is not None and (begun[0][0], begun[1][0]) == (key[0], part[0]):
                old = len(begun[0])
                rows = tuple(np.concatenate(x) for x in zip(begun, rows, strict=True))
            key, part, nth, fp, size, place, root = rows[:7]
            table = _table(rows[7]) if sketched else None
            fresh = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            begins = np.flatnonzero(fresh)
            begin = np.repeat(begins, np.diff([*begins, len(key)]))
            here = np.arange(old, len(key))
            for k in range(high - low):
                here = here[begin[here] + k < here]
                here = here[(nth[begin[here] + k] < high) & (nth[begin[here] + k] >= low)]
                if not len(here):
                    break
                c, at = begin[here] + k, here
                p, q, a, b = place[c], place[at], size[c], size[at]
                ok = (root[c] != root[at]) & ((np.minimum(p, q) + np.minimum(a - p, b - q)) * (less + more) >= (a + b) * less)
                c, at = c[ok], at[ok]
                if sketched:
                    ok, _ = _near_ones(rows[7], rows[7], table, table, c, at, _bound(size[c], size[at], similar))
                    c, at = c[ok], at[ok]
                yield pa.record_batch([pa.array(fp[c]), pa.array(fp[at])], names=["u", "v"])
            begun = tuple(x[begins[-1] :][: high - low] for x in rows)

    return pairs


def _sets(wanted, shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = np.zeros(0, np.int64), wanted.value
        for batch in batches:
            for _, data, offsets in runs(batch):
                h, sizes, fp = sets_of(data, offsets, shingle)
                want = np.zeros(len(fp), bool)
                want[np.unique(fp, return_index=True)[1]] = True
                want &= _held(bits, fp) & ~np.isin(fp, seen)
                at = np.flatnonzero(want)
                seen = np.union1d(seen, fp[at])
                flat, many = h[ragged((np.cumsum(sizes) - sizes)[at], sizes[at])], sizes[at]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(flat.view(np.int64)))
                coded = pa.Array.from_buffers(pa.binary(8 * WORDS), len(at), [None, pa.py_buffer(sketches_of(flat, many).tobytes())]).cast(pa.binary())
                yield pa.record_batch([pa.array(fp[at]), pa.array(many.astype(np.int32)), lists, coded], names=["fp", "size", "shingles", "sketch"])

    return sets


def _held(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether the fingerprints fall into cells that are set."""
    cell = fp.view(np.uint64) >> np.uint64(40)
    return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def _words(rows: DataFrame) -> DataFrame:
    """CELLS bits, set where a fingerprint of the rows falls, as at most CELLS / 64 rows (word, bits), whatever the corpus."""
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(fp, 40) & 63 AS INT))")
    return rows.groupBy(F.shiftrightunsigned("fp", 46).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _chosen(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets whose cells the rows' fingerprints set: a few more than theirs.  The words are few enough to broadcast."""
    words = F.broadcast(_words(rows))
    held = F.expr("(shiftrightunsigned(bits, CAST(shiftrightunsigned(fp, 40) & 63 AS INT)) & 1) = 1")
    return sets.join(words, F.shiftrightunsigned(sets["fp"], 46) == words["word"]).filter(held).select(*sets.columns)


def _wanted(rows: DataFrame) -> np.ndarray:
    """The same bits in an array."""
    found, out = _words(rows).toArrow(), np.zeros(CELLS // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def links(texts: DataFrame, n: int, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """Rows (fp, root) of the sets that have links; n is the number of texts."""
    spark = texts.sparkSession
    context = spark.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts.mapInArrow(_keys(context.broadcast(_order(texts, n, shingle)), shingle, similar), "key long, fp long, size int, place int")
    buckets = staged(keyed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_buckets, "key long, fp long, size int, place int, nth long"), "buckets")
    sets = texts.mapInArrow(_sets(context.broadcast(_wanted(buckets)), shingle), "fp long, size int, shingles array<long>, sketch binary")
    release()
    sets = staged(sets.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("size", "shingles", "sketch")]), "sets")
    sketches = lambda fp, size, sketch: sets.select(F.col("fp").alias(fp), F.col("size").alias(size), F.col("sketch").alias(sketch))
    none = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "fp long, root long")
    found, rows, low, high = none, buckets, 0, 1
    while True:
        # A key whose texts are in one component stays so: only what was open is looked at again.
        now = rows.join(found[1], "fp", "left").select("key", "fp", "size", "place", "nth", F.coalesce("root", "fp").alias("root"))
        tops = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("nth").alias("top")).filter(f"a <> b AND top > {low}").select("key", "top")
        now = staged(now.join(tops, "key"), "open")
        drop(rows)
        if now.isEmpty():
            drop(now)
            drop(sets)
            return found[1]
        rows = now.drop("root", "top")
        rows.staged_at = now.staged_at
        # The texts compared with go to every part of their key, the others to one each.
        own = F.array(F.floor(F.col("nth") / PART))
        every = F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / PART))
        dealt = now.filter(f"nth >= {low}").withColumn("part", F.explode(F.when(F.col("nth") < high, every).otherwise(own)))
        columns = ["key", "part", "nth", "fp", "size", "place", "root"]
        if low:  # one pair a row at first needs no sketches yet
            dealt, columns = dealt.join(sets.select("fp", "sketch"), "fp"), [*columns, "sketch"]
        pairs = dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "nth").select(*columns).mapInArrow(_pairs(low, high, similar), "u long, v long").distinct()
        both = pairs.join(sketches("u", "a", "x"), "u").join(sketches("v", "b", "y"), "v").select("u", "v", "a", "b", "x", "y")
        survivors = staged(both.mapInArrow(_near(similar), "u long, v long, apart long"), "survivors")
        # Each text with its nearest first: most of the other pairs are in one component then.
        best = survivors.groupBy(F.col("v").alias("w")).agg(F.min_by("u", F.struct("apart", "u")).alias("nearest"))
        found = _verified(found, sets, survivors.join(best, (F.col("v") == F.col("w")) & (F.col("u") == F.col("nearest"))).select("u", "v"), similar)
        root = lambda fp, name: found[1].select(F.col("fp").alias(fp), F.col("root").alias(name))
        rest = survivors.join(root("u", "r"), "u", "left").join(root("v", "s"), "v", "left").filter("coalesce(r, u) <> coalesce(s, v)").select("u", "v")
        found = _verified(found, sets, rest, similar)
        drop(survivors)
        low, high = high, high + (high - low) * GROWTH


def _verified(found: tuple[DataFrame, DataFrame], sets: DataFrame, pairs: DataFrame, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(links, roots) with those of the pairs that are alike on their whole sets."""
    pairs = staged(pairs, "asked")
    if pairs.isEmpty():
        drop(pairs)
        return found
    # Only the sets of the pairs are shuffled.
    chosen = _chosen(sets.select("fp", "shingles"), pairs.select(F.explode(F.array("u", "v")).alias("fp")))
    both = pairs.join(chosen.select(F.col("fp").alias("u"), F.col("shingles").alias("x")), "u").join(chosen.select(F.col("fp").alias("v"), F.col("shingles").alias("y")), "v")
    alike = F.size(F.array_intersect("x", "y")) * sum(similar) >= (F.size("x") + F.size("y")) * similar[0]
    edges = staged(found[0].unionByName(both.filter(alike).select("u", "v")), "verified")
    drop(pairs)
    if hasattr(found[0], "staged_at"):
        drop(found[0])
    roots = components(edges)
    return edges, roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())


def near_duplicates(texts: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """Rows (doc_id, carried, fp, root, component_id) of the rows (doc_id, carried, text); fp is a hash of the text's set."""
    prints = staged(texts.mapInArrow(_prints(shingle), "doc_id long, carried long, fp long"), "prints")
    distinct = staged(collapsed(prints, "fp", ("doc_id", F.min)), "distinct")
    roots = links(texts.select("text"), prints.count(), shingle, similar)
    return grouped(prints, distinct, roots.filter("fp <> root"))
