"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn first, exactly as a
uniform shuffle would distribute them (hypergeometric counts with the shard sizes as margins). Then
each block permutes its rows and deals them out by these counts, rows are exchanged, and each shard
permutes what it got. All orderings are equally likely, and shard sizes differ by one at most.

Blocks are drawn from row positions, not from contents, so equal rows, hot keys and groups of
copies spread evenly. Nulls and empty texts are rows like others; an empty table gives an empty
result. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowrill.llm.frames import packed, stored, unpacked
from flowrill.session import delete_path


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good; any population size.

    Inverts the distribution outwards from its mode, so it takes about one standard deviation of
    steps.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(
        log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws)
    )
    left = rng.random() - peak
    down = up = mode
    p_down = p_up = peak
    while left >= 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left < 0:
                return down
        if max(p_up, p_down) < 1e-300:
            break
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Counts from each block to each shard with these exact row and column sums."""
    rng = random.Random(seed)
    room = list(shard_rows)
    total = sum(room)
    matrix = []
    for rows in block_rows:
        line, rest, outside = [], rows, total
        for capacity in room:
            outside -= capacity
            line.append(hypergeometric(rng, capacity, outside, rest))
            rest -= line[-1]
        room = [a - b for a, b in zip(room, line)]
        total -= rows
        matrix.append(line)
    return matrix


def _small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of known few rows, from a literal."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(parsed))


def shuffle_into_shards(
    docs: DataFrame, n_shards: int = 16, seed: int = 20, n_blocks: int = 1024, n_cells: int = 64
) -> DataFrame:
    """The rows with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    ``n_blocks`` and ``n_cells`` (parts of a shard that are permuted apart, in random proportions)
    bound what one task sorts; raise them with the table. The matrix has ``n_blocks x n_shards``
    numbers, the only data that passes the driver. Rows are stored once with their random keys, so
    a lost task finds the same blocks again; they are deleted once dealt out.
    """
    spark = docs.sparkSession
    position = F.monotonically_increasing_id()
    drawn = packed(docs).select(
        "row",
        F.pmod(F.xxhash64(F.lit(seed), position), F.lit(n_blocks)).cast("int").alias("block"),
        F.xxhash64(F.lit(seed + 1), position).alias("key"),
    )
    rows, blocks_path = stored(drawn, "blocks", "zstd")

    counts = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    blocks = sorted(counts)
    total = sum(counts.values())
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counts[b] for b in blocks], sizes, seed)
    ends = [
        {"block": b, "ends": [sum(line[: s + 1]) for s in range(n_shards)]}
        for b, line in zip(blocks, matrix)
    ]
    plan = _small_table(spark, ends, "block:int,ends:array<bigint>")

    rank = F.row_number().over(Window.partitionBy("block").orderBy("key")) - 1
    dealt = (
        rows.withColumn("rank", rank).join(F.broadcast(plan), "block")
        .withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("rank"))))
        .select(
            "row", "shard",
            F.pmod(F.xxhash64(F.lit(seed + 2), "key"), F.lit(n_cells)).cast("int").alias("cell"),
            F.xxhash64(F.lit(seed + 3), "key").alias("key"),
        )
    )
    dealt, _ = stored(dealt, "dealt", "zstd")
    delete_path(spark, blocks_path)  # whole rows, now stored as dealt

    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key")) - 1
    placed = (
        dealt.withColumn("within", within)
        .join(F.broadcast(offsets), ["shard", "cell"])  # at most n_shards x n_cells rows
        .withColumn("slot", (F.col("offset") + F.col("within")).cast("long"))
    )
    return unpacked(placed, "shard", "slot")
