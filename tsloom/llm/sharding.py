"""Sharding by a hypergeometric communication matrix (law "rows").

A uniform shuffle of all rows into shards whose sizes differ by one at most.
Rows are staged once with the partition and place they have there, so what
follows can be computed again after any loss.  Shards are cut into cells of at
most CELL_ROWS rows with exact sizes.

1. Matrix: how many rows each partition sends to each cell is drawn exactly as
   in a uniform permutation, a multivariate hypergeometric law.  Partitions form
   a binary tree: each node splits its cells' places between its halves with a
   generator seeded by the node, so every task draws its own row of the matrix
   in O(cells x log partitions) and nobody holds the whole.
2. Local permutation: a partition's rows are permuted and dealt to the cells by
   its row of the matrix.
3. Exchange by cell.
4. Second permutation inside each cell, which is of bounded size; a row's slot
   is its cell's first slot plus its place.

What the driver sees is a count for each partition.

Defined results: null texts count as empty, very long ones as any other (only
digests travel in the query); ties and repeated rows are placed one by one, each
at random; null ids are kept; an empty table gives no rows; fewer rows than
shards leaves shards empty; further columns travel with their row inside a
struct, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsloom.session import staged


SHARDS, OVERHEAD, SEED = 40, 16, 11
CELL_ROWS = 1 << 16
#: numpy's samplers take populations below this.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` from good + bad are good, for populations of any size (ratio of uniforms)."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    if not good or not draws:
        return 0
    total, few, many = good + bad, min(good, bad), max(good, bad)
    m = min(draws, total - draws)
    g = math.lgamma
    log_weight = lambda z: -(g(z + 1) + g(few - z + 1) + g(m - z + 1) + g(many - m + z + 1))
    share = few / total
    centre = m * share + 0.5
    spread = math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
    mode = (m + 1) * (few + 1) // (total + 2)
    top, width = log_weight(mode), 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        x = 1 - rng.random()
        z = math.floor(centre + width * (rng.random() - 0.5) / x)
        if max(0, m - many) <= z <= min(m, few) and 2 * math.log(x) <= log_weight(z) - top:
            break
    z = z if good <= bad else m - z
    return z if m == draws else good - z


def split(rng: np.random.Generator, places: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw from the places."""
    total = int(places.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(places, draws, method="marginals")
    out = np.zeros_like(places)
    for i, n in enumerate(places.tolist()):
        out[i] = hypergeometric(rng, n, total - n, draws)
        total, draws = total - n, draws - int(out[i])
    return out


def cells_of(rows: int, shards: int, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of each cell."""
    sizes = rows // shards + (np.arange(shards) < rows % shards)
    parts = np.maximum(1, -(-sizes // cell_rows))
    shard = np.repeat(np.arange(shards), parts)
    k = np.arange(len(shard)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = sizes[shard] // parts[shard] + (k < sizes[shard] % parts[shard])
    first = np.cumsum(size) - size
    return shard, first - np.repeat(first[np.cumsum(parts) - parts], parts), size


def matrix_row(part: int, bounds: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Rows that partition `part` sends to each cell; bounds: rows before each partition, then all."""
    lo, hi = 0, len(bounds) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng([seed, lo, hi]), places, int(bounds[mid] - bounds[lo]))
        lo, hi, places = (lo, mid, left) if part < mid else (mid, hi, places - left)
    return places


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows (row, shard, slot): each input row as a struct, its shard and its place there."""
    spark = df.sparkSession
    tagged = df.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"))
    rows = staged(tagged, "rows")
    counts = rows.groupBy("part").count().orderBy("part").collect()  # a number for each task
    parts = np.array([r["part"] for r in counts], np.int64)
    bounds = np.concatenate([[0], np.cumsum([r["count"] for r in counts])]).astype(np.int64)
    shard, first, size = cells_of(int(bounds[-1]), shards, cell_rows)
    sent = spark.sparkContext.broadcast((parts, bounds))
    total = int(bounds[-1])

    @F.pandas_udf("int")
    def cell(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ids, limits = sent.value
        places = cells_of(total, shards, cell_rows)[2]

        @lru_cache(maxsize=8)
        def dealt(part: int) -> np.ndarray:
            k = int(np.searchsorted(ids, part))
            out = np.empty(int(limits[k + 1] - limits[k]), np.int32)
            out[np.random.default_rng([seed, part, 1, 1]).permutation(len(out))] = np.repeat(np.arange(len(places)), matrix_row(k, limits, places, seed))
            return out

        for part, seq in columns:
            out = np.empty(len(part), np.int32)
            for p in part.unique():
                here = (part == p).to_numpy()
                out[here] = dealt(int(p))[seq[here].to_numpy()]
            yield pd.Series(out)

    order = W.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed), "part", "seq"), "part", "seq")
    placed = rows.withColumn("cell", cell("part", "seq")).withColumn("place", F.row_number().over(order) - 1)
    cells = pd.DataFrame({"cell": np.arange(len(shard), dtype=np.int32), "shard": shard.astype(np.int32), "first": first.astype(np.int64)})
    # One row for each CELL_ROWS rows: it is left to Spark whether that is small enough to broadcast.
    return placed.join(spark.createDataFrame(cells, "cell int, shard int, first long"), "cell").select("row", "shard", (F.col("first") + F.col("place")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(digest).select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
