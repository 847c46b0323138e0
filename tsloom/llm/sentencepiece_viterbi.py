"""SentencePiece encoding and decoding by batched Viterbi, or merges, in numpy.

The model file is read directly.  Texts are escaped as the model asks (a leading
mark, blanks as marks) and cut where no piece can cross: before a run of marks
and around characters that no piece holds.  Equal units are segmented once a
batch.  Units of equal length advance together: substring hashes come from
prefix hashes, probe the sorted piece keys (behind a bitmap), and at each
position vectorised maxima store the best score and a back-pointer.  Units over
LONG bytes are probed at all positions at once and solved one by one.

For unigram models the result is the segmentation with the greatest sum of piece
scores.  In a model of merge kind (BPE) the scores are merge ranks, and the best
sum of these is not its encoding: there, units of equal length are merged
together instead, one pair a step in each, the best score first and the leftmost
of equals; longer units use a heap.  encode alone is Viterbi for any model,
encode_as_trained goes by the model's kind.  Equal sums prefer the longer last
piece.  Characters that no piece covers become byte pieces, or the unknown id
where the model has none.

Decoding joins the pieces, bytes included, and drops the leading mark.
decode(encode(text)) is the text with U+2581 read as a blank.

Defined results: null texts encode to null and decode to null; empty texts to no
ids; texts are never cut; repeated rows are repeated; an empty table gives no
rows; ids out of range and control ids decode to nothing; a clashing column of
the result's name is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.textbytes import _SALT, hashes, ragged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG, UNKNOWN_PENALTY = 96, 10.0
RUN_BYTES = 1 << 20
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({5: 4, 1: 8}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Model:
    """Pieces, scores and look-up tables; of fixed size, so it may be broadcast."""

    def __init__(self, raw: bytes):
        pieces, scores, kinds = [], [], []
        prefix, collapse, escape, charsmap, kind = True, True, True, b"", 1
        for number, value in fields(raw):
            if number == 1:
                f = dict(fields(value))
                pieces.append(f.get(1, b"").decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, _NORMAL))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
            elif number == 3:
                f = dict(fields(value))
                charsmap, prefix, collapse, escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if charsmap or collapse or not escape or _USER in kinds:
            raise ValueError("only models with identity normalisation and without user-defined pieces are supported")
        if kind not in (1, 2) or kind == 2 and _UNUSED in kinds:
            raise ValueError("only unigram models and merge models without unused pieces are supported")
        self.prefix, self.merges, kinds = prefix, kind == 2, np.array(kinds)
        self.unknown = int(np.flatnonzero(kinds == _UNKNOWN)[0])
        usable = [i for i in np.flatnonzero(kinds == _NORMAL).tolist() if pieces[i]]
        self.byte_id = np.full(256, -1, np.int64)
        for i in np.flatnonzero(kinds == _BYTE).tolist():
            self.byte_id[int(pieces[i][3:5], 16)] = i
        self.has_bytes = bool((self.byte_id >= 0).all())
        coded = [pieces[i].encode() for i in usable]
        sizes = np.array([len(c) for c in coded])
        flat = np.frombuffer(b"".join(coded), np.uint8)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(flat)) - np.repeat(first, sizes)
        self.longest = int(sizes.max())
        self.power, self.inverse = _powers(_BASE, self.longest + 1), _powers(_INVERSE, LONG + self.longest + 1)
        key = np.add.reduceat(_SALT[flat] * self.power[place], first)
        order = np.argsort(key)
        self.keys, self.ids, self.sizes = key[order], np.array(usable)[order], sizes[order]
        self.score = np.array(scores)[self.ids]
        self.row_of = {coded[i]: row for row, i in enumerate(order.tolist())} if self.merges else {}
        self.unknown_score = float(self.score.min()) - UNKNOWN_PENALTY
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.keys >> np.uint64(44)] = True
        self.lengths = np.unique(sizes)[::-1].tolist()
        texts = [pieces[i] for i in usable]
        self.cut_marks = not any(MARK in t.lstrip(MARK) for t in texts)
        held = np.zeros(256, bool)
        held[np.unique(flat)] = True
        self.apart = ~held & (np.arange(256) < 128)
        out = [b""] * len(pieces)
        for i, c in zip(usable, coded, strict=True):
            out[i] = c.replace(MARK.encode(), b" ")
        for b, i in enumerate(self.byte_id.tolist()):
            if i >= 0:
                out[i] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        self.out_sizes = np.array([len(o) for o in out], np.int64)
        self.out_first = np.cumsum(self.out_sizes) - self.out_sizes
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)

    def probe(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are keys of pieces of `size` bytes, and these pieces' rows."""
        may = np.flatnonzero(self.bitmap[h >> np.uint64(44)])
        row = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        ok = (self.keys[row] == h[may]) & (self.sizes[row] == size)
        return may[ok], row[ok]

    def rows(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of the pieces of these hashes and sizes, or -1."""
        out = np.full(len(h), -1)
        may = np.flatnonzero(self.bitmap[h >> np.uint64(44)])
        row = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        ok = (self.keys[row] == h[may]) & (self.sizes[row] == size[may])
        out[may[ok]] = row[ok]
        return out


def load(path: str = MODEL) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def _char_sizes(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character that a byte begins; 0 inside one."""
    return np.where(lead < 0x80, 1, np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))))


def _together(model: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best segments of n units of one length, text (n, length): (unit, start, size, piece row or -1)."""
    n, length = text.shape
    prefix = np.zeros((length + 1, n), np.uint64)
    np.cumsum(_SALT[text.T] * _powers(_BASE, length)[:, None], axis=0, out=prefix[1:])
    chars = _char_sizes(text.T)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
    for end in range(1, length + 1):
        for size in range(min(end, max(4, model.longest)), 0, -1):
            start = end - size
            hit = np.zeros(0, np.int64)
            if size <= model.longest:
                hit, row = model.probe((prefix[end] - prefix[start]) * model.inverse[start], size)
                value = best[start, hit] + model.score[row]
                up = value > best[end, hit]
                won = hit[up]
                best[end, won], back[end, won], piece[end, won] = value[up], start, row[up]
            if size <= 4:
                lone = chars[start] == size
                lone[hit] = False
                lone = np.flatnonzero(lone)
                value = best[start, lone] + model.unknown_score
                up = value > best[end, lone]
                won = lone[up]
                best[end, won], back[end, won], piece[end, won] = value[up], start, -1
    unit, at, found = np.arange(n), np.full(n, length), []
    while len(unit):
        start = back[at, unit]
        found.append((unit, start, at - start, piece[at, unit]))
        go = start > 0
        unit, at = unit[go], start[go]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _alone(model: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best segments of one long unit: (start, size, piece row or -1)."""
    length = len(text)
    prefix = np.zeros(length + 1, np.uint64)
    np.cumsum(_SALT[text] * _powers(_BASE, length), out=prefix[1:])
    inverse = _powers(_INVERSE, length + 1)
    chars = _char_sizes(text)
    lone = chars > 0
    starts, sizes, rows = [], [], []
    for size in model.lengths:
        if size <= length:
            hit, row = model.probe((prefix[size:] - prefix[:-size]) * inverse[: length + 1 - size], size)
            lone[hit[chars[hit] == size]] = False
            starts.append(hit)
            sizes.append(np.full(len(hit), size))
            rows.append(row)
    lone = np.flatnonzero(lone)
    starts, sizes, rows = (np.concatenate(x) for x in ([*starts, lone], [*sizes, chars[lone]], [*rows, np.full(len(lone), -1)]))
    value = np.where(rows < 0, model.unknown_score, model.score[rows])
    order = np.lexsort((starts, starts + sizes))
    best, back = [-np.inf] * (length + 1), [-1] * (length + 1)
    best[0] = 0.0
    for k, s, e, v in zip(order.tolist(), starts[order].tolist(), (starts + sizes)[order].tolist(), value[order].tolist(), strict=True):
        if best[s] + v > best[e]:
            best[e], back[e] = best[s] + v, k
    found, at = [], length
    while at:
        found.append(back[at])
        at = int(starts[back[at]])
    found = np.array(found[::-1], np.int64)
    return starts[found], sizes[found], rows[found]


def _merged_together(model: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments by merge order of n units of one length, text (n, length): (unit, start, size, piece row or -1)."""
    n, length = text.shape
    prefix = np.zeros((n, length + 1), np.uint64)
    np.cumsum(_SALT[text] * _powers(_BASE, length), axis=1, out=prefix[:, 1:])
    inverse = model.inverse
    sizes = _char_sizes(text)
    # At the start of each symbol its end, at the end of each its start.
    end, begin = np.arange(length) + sizes, np.zeros((n, length + 1), np.int64)
    end[sizes == 0] = 0
    unit, at = np.nonzero(sizes)
    begin[unit, end[unit, at]] = at

    def rows(u, a, b):
        return model.rows((prefix[u, b] - prefix[u, a]) * inverse[a], b - a)

    score = np.full((n, length), -np.inf)  # of the pair whose left symbol starts here

    def look(u, a, b):
        row = rows(u, a, b)
        score[u, a] = np.where(row < 0, -np.inf, model.score[row])

    more = end[unit, at] < length
    unit, at = unit[more], at[more]
    look(unit, at, end[unit, end[unit, at]])
    live = np.arange(n)
    while len(live):
        a = score[live].argmax(axis=1)  # the leftmost of equals
        ok = score[live, a] > -np.inf
        live, a = live[ok], a[ok]
        m = end[live, a]
        b = end[live, m]
        end[live, a], end[live, m], begin[live, b], score[live, m], score[live, a] = b, 0, a, -np.inf, -np.inf
        right, left = b < length, a > 0
        look(live[right], a[right], end[live[right], b[right]])
        look(live[left], begin[live[left], a[left]], b[left])
    unit, at = np.nonzero(end)
    b = end[unit, at]
    return unit, at, b - at, rows(unit, at, b)


def _merged_alone(model: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments by merge order of one long unit: (start, size, piece row or -1)."""
    raw, row_of, score = text.tobytes(), model.row_of, model.score
    starts = np.flatnonzero(_char_sizes(text)).tolist()
    ends = [*starts[1:], len(raw)]
    end, begin = dict(zip(starts, ends, strict=True)), dict(zip(ends, starts, strict=True))
    heap = []

    def pair(a: int, m: int, b: int) -> tuple | None:
        row = row_of.get(raw[a:b])
        return None if row is None else (-float(score[row]), a, m, b)

    heap = [x for a, m, b in zip(starts, starts[1:], ends[1:]) if (x := pair(a, m, b))]  # noqa: B905
    heapify(heap)
    while heap:
        _, a, m, b = heappop(heap)
        if end.get(a) != m or end.get(m) != b:
            continue
        end[a], begin[b] = b, a
        del end[m], begin[m]
        if b < len(raw) and (x := pair(a, b, end[b])):
            heappush(heap, x)
        if a > 0 and (x := pair(begin[a], a, b)):
            heappush(heap, x)
    found = np.array(sorted(end.items()), np.int64)
    return found[:, 0], found[:, 1] - found[:, 0], np.array([row_of.get(raw[a:b], -1) for a, b in found.tolist()], np.int64)


def _segment(model: Model, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, merges: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units, end to end, and how many each has."""
    parts = []
    together, alone = (_merged_together, _merged_alone) if merges else (_together, _alone)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        size = int(sizes[order[a]])
        step = max(1, (1 << 20) // size) if size <= LONG else 1
        for lo in range(a, b, step):
            which = order[lo : min(b, lo + step)]
            if size <= LONG:
                unit, start, width, row = together(model, data[starts[which][:, None] + np.arange(size)])
                parts.append((which[unit], start, width, row))
            else:
                start, width, row = alone(model, data[starts[which[0]] : starts[which[0]] + size])
                parts.append((np.full(len(start), which[0]), start, width, row))
    unit, start, width, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, unit))
    unit, start, width, row = unit[order], start[order], width[order].astype(np.int64), row[order]
    lone = row < 0
    many = np.where(lone & model.has_bytes, width, 1)
    ids = np.repeat(np.where(lone, model.unknown, model.ids[row]), many)
    if model.has_bytes and lone.any():
        at = ragged(starts[unit[lone]] + start[lone], width[lone])
        ids[np.repeat(lone, many)] = model.byte_id[data[at]]
    return ids, np.bincount(unit, weights=many, minlength=len(starts)).astype(np.int64)


def _encode_run(model: Model, texts: pa.Array, merges: bool) -> pa.Array:
    texts = pc.replace_substring(texts, " ", MARK)
    if model.prefix:
        texts = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.LargeListArray.from_arrays(np.zeros(len(texts) + 1, np.int64), pa.array([], pa.int32()))
    begin = np.zeros(len(data) + 1, bool)
    if model.cut_marks:
        mark = np.zeros(len(data) + 3, bool)
        mark[3 : len(data) + 1] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begin[:-1] = mark[3:] & ~mark[:-3]
    apart = model.apart[data]
    begin[:-1] |= apart
    begin[1:] |= apart
    begin[offsets] = True
    starts = np.flatnonzero(begin[:-1])
    sizes = np.diff(np.append(starts, len(data)))
    _, first, same = np.unique(hashes(data, starts, starts + sizes), return_index=True, return_inverse=True)
    here, there = ragged(starts, sizes), ragged(starts[first[same]], np.minimum(sizes, sizes[first[same]]))
    if (sizes != sizes[first[same]]).any() or (data[here] != data[there]).any():  # equal hashes of unlike units
        first = same = np.arange(len(starts))
    ids, many = _segment(model, data, starts[first], sizes[first], merges)
    at = np.cumsum(many) - many
    flat = ids[ragged(at[same], many[same])]
    total = np.concatenate([[0], np.cumsum(many[same])])
    return pa.LargeListArray.from_arrays(total[np.searchsorted(starts, offsets)], pa.array(flat.astype(np.int32)))


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def encode(model: Model, texts: pa.Array, merges: bool = False) -> pa.Array:
    """Lists of int32 ids, by the greatest sum of scores or else by merge order."""
    nulls, texts = pc.is_null(texts), texts.cast(pa.large_string()).fill_null("")
    parts = [_encode_run(model, texts.slice(a, b - a), merges) for a, b in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), RUN_BYTES)]
    ids = pa.concat_arrays(parts) if parts else pa.array([], pa.large_list(pa.int32()))
    return pc.if_else(nulls, pa.scalar(None, ids.type), ids).cast(pa.list_(pa.int32()))


def encode_as_trained(model: Model, texts: pa.Array) -> pa.Array:
    """Lists of int32 ids as the model's own kind gives them."""
    return encode(model, texts, model.merges)


def _decode_run(model: Model, lists: pa.Array) -> list[str]:
    flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), many)
    ok = (flat >= 0) & (flat < len(model.out_sizes))
    flat, owner = flat[ok], owner[ok]
    sizes = model.out_sizes[flat]
    raw = model.out_bytes[ragged(model.out_first[flat], sizes)].tobytes()
    ends = np.cumsum(np.bincount(owner, weights=sizes, minlength=len(lists)).astype(np.int64)).tolist()
    out = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [(o[1:] if model.prefix and o[:1] == b" " else o).decode("utf-8", "replace") for o in out]


def decode(model: Model, lists: pa.Array) -> pa.Array:
    nulls, lists = pc.is_null(lists), lists.fill_null([])
    many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out: list[str] = []
    for a, b in _slices(many, RUN_BYTES // 4):
        out += _decode_run(model, lists.slice(a, b - a))
    return pc.if_else(nulls, pa.scalar(None, pa.string()), pa.array(out, pa.string()))


def encode_texts(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of ids."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield encode_as_trained(sent.value, texts)
            pa.default_memory_pool().release_unused()

    return docs.withColumn(ids_col, ids(F.col(text_col).cast("string")))


def decode_ids(encoded: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with a column of decoded texts."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield decode(sent.value, lists)

    return encoded.withColumn(text_col, text(F.col(ids_col).cast("array<int>")))


def encode_checked(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ids and exact: whether decoding the ids gives the text back.  The decoded text stays in the worker."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("ids array<int>, exact boolean")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for a, b in _slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 8 * RUN_BYTES):
                some = texts.slice(a, b - a)
                ids = encode_as_trained(sent.value, some)
                same = pc.equal(decode(sent.value, ids), pc.replace_substring(some, MARK, " "))
                parts.append(pa.StructArray.from_arrays([ids, pc.fill_null(same, True)], names=["ids", "exact"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("exact", pa.bool_())]))
            del parts, texts
            pa.default_memory_pool().release_unused()

    return docs.drop("ids", "exact").withColumn("coded", both(F.col(text_col).cast("string"))).withColumns({"ids": F.col("coded.ids"), "exact": F.col("coded.exact")}).drop("coded")


def query(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, exact): exact tells that decoding gives the text back."""
    model = load(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_checked(docs, model).select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "exact")
