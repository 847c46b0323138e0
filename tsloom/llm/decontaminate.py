"""Benchmark decontamination with a distributed positional inverted index.

Index.  Documents are tokenised in numpy over whole texts.  Each run of
documents (some megabytes) becomes one segment: its distinct terms, sorted by
their XXH64, each with the ascending list of its positions in the segment.
Segments are rows of a table in the shared folder, so the index grows with the
corpus and is spread over it; no term's postings ever meet in one task, however
frequent the term.

Search.  Benchmark items are cut into windows of WINDOW consecutive words (a
shorter item is one window).  A segment looks up the items' terms once, keeps
the windows all of whose terms it has, and answers each by the positions of its
locally rarest term, shifted back by the term's offset and intersected with the
shifted lists of the other terms from rarest to most frequent: exact phrase
matches.  A proximity match is a start from which every term of the window lies
within `slop` words of its place; the rarest term's positions give all starts
that can be one.  Documents lie GAP words apart in a segment, further than any
match reaches, and a match belongs to the document of its rarest term.

The items' terms are sent to the segments in blocks of BLOCK_WORDS (8 bytes a
word: a proven bound on what is broadcast at a time), long items cut with
overlap; a larger benchmark is searched block by block over the stored index,
each block's matches are stored, and merged by document.

Defined results: null and empty texts have no words and are not contaminated;
items without words match nothing; repeated documents are repeated in the
result; repeated items each count; items without an id count as hits and, all
together, as one null among a document's items; an empty benchmark or corpus gives clean
rows or none; further columns are not read.  Very long texts are segments of
their own.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.textbytes import ALNUM, LOWER, ragged, runs, words, xxh64
from tsloom.session import staged

WINDOW, SHARE, SLOP = 13, 20, 2
#: A search may ask for so much slop; the gap between documents allows for it.
MOST_SLOP = 8
GAP = WINDOW + 2 * MOST_SLOP
BLOCK_WORDS = 1 << 21
#: Bytes of text in a segment; a longer text is a segment of its own.
SEGMENT_BYTES = 2 << 20
#: Windows looked at together, and candidate places of theirs.
SOME_WINDOWS, SOME_PLACES = 1 << 16, 1 << 20
SEGMENT = "segment string, ids binary, counts binary, terms binary, starts binary, positions binary"
FOUND = pa.schema([("segment", pa.string()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("near", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
FOUND_SQL = "segment string, row int, doc_id long, n_words long, hits array<struct<start:long,stop:long>>, near array<long>, items array<long>"
NO_ID = np.iinfo(np.int64).min


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, rows = words(low, offsets, ALNUM)
    return xxh64(low, starts, ends), rows


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part, data, offsets in runs(batch, limit=SEGMENT_BYTES):
            terms, rows = _tokens(data, offsets)
            counts = np.diff(rows)
            place = (np.arange(len(terms)) + np.repeat(np.arange(len(counts)) * GAP, counts)).astype(np.int32)
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            first = np.flatnonzero(np.diff(terms, prepend=terms[:1] ^ np.uint64(1)))
            ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            cells = [ids, counts.astype(np.int64), terms[first], np.append(first, len(terms)).astype(np.int32), place[order]]
            yield pa.record_batch([pa.array([f"{task}-{made}"]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["segment", "ids", "counts", "terms", "starts", "positions"])
            made += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row for each segment."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(df.mapInArrow(_index, SEGMENT), "postings")


class Block:
    """Terms of some items (or overlapping parts of long ones) end to end, and the windows that begin among them."""

    def __init__(self, pieces: list[tuple[int, np.ndarray]]):
        sizes = np.array([len(t) for _, t in pieces], np.int64)
        self.items, self.sizes = np.array([i for i, _ in pieces], np.int64), sizes
        self.terms = np.concatenate([t for _, t in pieces]) if pieces else np.zeros(0, np.uint64)

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of a window: their first terms' places and their items."""
        first, length = np.cumsum(self.sizes) - self.sizes, np.minimum(self.sizes, WINDOW)
        for n in np.unique(length).tolist():
            own = length == n
            many = self.sizes[own] - n + 1
            yield n, ragged(first[own], many), np.repeat(self.items[own], many)


def blocks_of(items: Iterator[tuple[int, str]]) -> Iterator[Block]:
    """The items' words, at most BLOCK_WORDS at a time."""
    held, size = [], 0
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        terms, _ = _tokens(raw, np.array([0, len(raw)]))
        at = 0
        while at < len(terms):
            part = terms[at : at + max(WINDOW, BLOCK_WORDS)]
            if size and size + len(part) > BLOCK_WORDS:
                yield Block(held)
                held, size = [], 0
            held.append((item, part))
            size += len(part)
            # The next part repeats what its first windows need of this one.
            at = len(terms) if at + len(part) == len(terms) else at + len(part) - WINDOW + 1
    if held:
        yield Block(held)


def _within(lists: np.ndarray, begin: np.ndarray, stop: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    """Whether each list lists[begin:stop] holds a value within slop of want: binary searches in step."""
    low, high = begin.copy(), stop.copy()
    target = want - slop
    while True:
        open_ = low < high
        if not open_.any():
            break
        mid = (low + high) >> 1
        right = open_ & (lists[np.minimum(mid, len(lists) - 1)] < target)
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return (low < stop) & (lists[np.minimum(low, len(lists) - 1)] <= want + slop)


def _matches(segment: tuple, slots: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, place of the rarest term) of the matches of windows whose terms are at these slots (window, term) of the segment."""
    starts, positions = segment
    sizes = starts[slots + 1] - starts[slots]
    rarest = np.argsort(sizes, axis=1, kind="stable")
    pick = np.arange(len(slots))
    least = sizes[pick, rarest[:, 0]].astype(np.int64)
    ends = np.cumsum(least)
    lo = 0
    while lo < len(slots):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SOME_PLACES // (2 * slop + 1), "right")))
        rows = pick[lo:hi]
        seed = rarest[rows, 0]
        w = np.repeat(rows, least[rows])
        place = positions[ragged(starts[slots[rows, seed]].astype(np.int64), least[rows])].astype(np.int64)
        begin = place - np.repeat(seed, least[rows])
        if slop:
            shifts = np.arange(-slop, slop + 1)
            w, place, begin = np.repeat(w, len(shifts)), np.repeat(place, len(shifts)), (begin[:, None] + shifts).ravel()
        for k in range(1, slots.shape[1]):
            if not len(w):
                break
            term = rarest[w, k]
            slot = slots[w, term]
            ok = _within(positions, starts[slot].astype(np.int64), starts[slot + 1].astype(np.int64), begin + term, slop)
            w, begin, place = w[ok], begin[ok], place[ok]
        if len(w):
            yield w, begin, place
        lo = hi


def _search(sent, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        windows = list(block.windows())
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64)
                terms, segment = np.frombuffer(row["terms"], np.uint64), (np.frombuffer(row["starts"], np.int32), np.frombuffer(row["positions"], np.int32))
                base = np.cumsum(counts) - counts + np.arange(len(counts)) * GAP
                hits: dict[int, list] = {}
                near: dict[int, set] = {}
                items: dict[int, set] = {}
                slot = np.searchsorted(terms, block.terms)
                slot[slot == len(terms)] = 0
                there = np.concatenate([[0], np.cumsum(terms[slot] == block.terms)]) if len(terms) else np.zeros(len(slot) + 1, np.int64)
                for n, first, item in windows:
                    whole = np.flatnonzero(there[first + n] - there[first] == n)
                    for at in range(0, len(whole), SOME_WINDOWS):
                        some = whole[at : at + SOME_WINDOWS]
                        slots = slot[first[some][:, None] + np.arange(n)]
                        for w, begin, _ in _matches(segment, slots, 0):
                            doc = np.searchsorted(base, begin, "right") - 1
                            _note(items, doc, item[some][w])
                            spans = np.unique(np.stack([doc, begin - base[doc]]), axis=1)
                            for d in np.unique(spans[0]).tolist():
                                hits.setdefault(d, []).append((n, spans[1][spans[0] == d]))
                        for w, _, place in _matches(segment, slots, slop) if slop else ():
                            _note(near, np.searchsorted(base, place, "right") - 1, item[some][w])
                merged = [_union(hits[d]) if d in hits else [] for d in range(len(ids))]
                yield pa.record_batch(
                    [
                        pa.array([row["segment"]] * len(ids)), pa.array(range(len(ids)), pa.int32()), pa.array(ids, mask=ids == NO_ID), pa.array(counts),
                        pa.array(merged, FOUND.field("hits").type), pa.array([_listed(near.get(d, ())) for d in range(len(ids))], pa.list_(pa.int64())), pa.array([_listed(items.get(d, ())) for d in range(len(ids))], pa.list_(pa.int64())),
                    ],
                    schema=FOUND,
                )

    return search


def _note(found: dict[int, set], doc: np.ndarray, item: np.ndarray) -> None:
    for d, i in np.unique(np.stack([doc, item]), axis=1).T.tolist():
        found.setdefault(d, set()).add(i)


def _listed(items) -> list[int | None]:
    """Ids in ascending order; all items without an id are one null at the end."""
    return sorted(i for i in items if i != NO_ID) + [None] * (NO_ID in items)


def _union(spans: list[tuple[int, np.ndarray]]) -> list[dict]:
    """Disjoint hit ranges of a document from (length, starts)."""
    a = np.concatenate([s for _, s in spans])
    b = np.concatenate([s + n for n, s in spans])
    order = np.lexsort((b, a))
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return [{"start": x, "stop": y} for x, y in zip(a[new].tolist(), b[np.append(new[1:], len(b)) - 1].tolist(), strict=True)]


def search_index(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", slop: int = 0) -> DataFrame:
    """Rows (segment, row, doc_id, n_words, hits, near, items): merged hit ranges in words, items matched exactly and, with slop, nearby."""
    if not 0 <= slop <= MOST_SLOP:
        raise ValueError(f"slop goes from 0 to {MOST_SLOP}")
    context = index.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(int(NO_ID))), F.coalesce(F.col(text_col), F.lit("")))
    blocks = blocks_of(items.toLocalIterator())  # the test set only, a block at a time
    block, more = next(blocks, Block([])), next(blocks, None)
    if more is None:
        return index.mapInArrow(_search(context.broadcast(block), slop), FOUND_SQL)
    every = None
    while block is not None:
        sent = context.broadcast(block)
        found = staged(index.mapInArrow(_search(sent, slop), FOUND_SQL), "matches")
        sent.destroy()
        every = found if every is None else every.unionByName(found)
        block, more = more, next(blocks, None)
    lists = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("near", "items")}
    return every.groupBy("segment", "row", "doc_id", "n_words").agg(_merge_spans(F.sort_array(F.flatten(F.collect_list("hits")))).alias("hits"), lists["near"], lists["items"])


def _merge_spans(spans):
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] <= last["stop"], joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, empty, step)


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0) -> DataFrame:
    """The search's rows with n_hit and contaminated, one for each document."""
    found = search_index(build_index(docs), benchmark, slop=slop)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


ORACLE = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, w, len(w) AS n, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, n - k + 1)) AS s FROM v)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
c AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, k, s, item_id FROM c JOIN wins USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY doc_id),
wt AS (SELECT DISTINCT win, k, unnest(string_split(win, ' ')) AS word, generate_subscripts(string_split(win, ' '), 1) AS j FROM wins),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
held AS (SELECT doc_id, win FROM (SELECT DISTINCT doc_id, word FROM dw) JOIN (SELECT DISTINCT win, word FROM wt) USING (word) JOIN (SELECT win, count(DISTINCT word) AS need FROM wt GROUP BY win) USING (win) GROUP BY doc_id, win, need HAVING count(*) = need),
shifted AS (SELECT DISTINCT doc_id, win, k, j, p - j + x AS b FROM held JOIN wt USING (win) JOIN dw USING (doc_id, word) CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS x)),
nigh AS (SELECT DISTINCT doc_id, win FROM shifted GROUP BY doc_id, win, k, b HAVING count(*) = k),
nears AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM nigh JOIN wins USING (win)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: items with a window whose words all lie within SLOP words of their places."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), SLOP)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))
