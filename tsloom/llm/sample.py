"""A bounded sample of labelled documents, and fitting on it in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsloom.llm.textbytes import release
from tsloom.session import ship

#: Bytes of text that a sample holds at most: rows are taken whole, in their order, until the next would not fit.
SAMPLE_BYTES = 1 << 24


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0).cast("long"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bounds: tuple[int, int]) -> tuple[list, tuple[int, int]]:
    """_chosen as a list of tuples, and the counts."""
    rows, counts = _chosen(docs, labels, label, folds, held_out, bounds)
    return [tuple(r) for r in rows.collect()], counts


def learned(fit: Callable, docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bounds: tuple[int, int]):
    """What fit(rows, counts) makes of the sample of labelled().  One task learns, the driver gets the model alone: neither texts nor what training needs meet there."""
    rows, counts = _chosen(docs, labels, label, folds, held_out, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        model = pickle.dumps(fit(sample, counts))
        sample.clear()
        release()
        yield pa.record_batch([pa.array([model], pa.binary())], names=["model"])

    ship(docs.sparkSession)
    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    # An empty sample may have no task at all.
    return pickle.loads(found[0]["model"]) if found else fit([], counts)


def _chosen(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bounds: tuple[int, int]) -> tuple[DataFrame, tuple[int, int]]:
    """Rows (text, lang, y) in a fixed order, at most bounds[y] of each class and SAMPLE_BYTES in all, and the class counts over all learnable labels.

    Rows go by the hash of their id, then id, text and label, so equal ones tie
    without effect.
    Labels of held-out ids, null labels and null ids are never read into it; of
    repeated ids each row may come, the bound still holds.
    """
    learn = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), folds) != held_out))
    counts = {r["y"]: r["count"] for r in learn.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = [learn.filter(F.col("y") == y).orderBy(*order).limit(bounds[y]) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most sum(bounds) ids
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    some = texts.join(chosen, "doc_id").orderBy(*order, "text", "y").limit(sum(bounds))
    # One window over the bounded sample.
    so_far = F.sum(F.octet_length("text").cast("long")).over(W.orderBy(*order, "text", "y").rowsBetween(W.unboundedPreceding, 0))
    rows = some.withColumn("bytes so far", so_far).filter(F.col("bytes so far") <= SAMPLE_BYTES).orderBy("bytes so far", *order, "text", "y").select("text", "lang", "y")
    return rows, (counts.get(0, 0), counts.get(1, 0))
