"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted ``rate(s) = weight(s) * total / documents(s)`` times on average.
How often it is taken inverts the Poisson distribution of that mean at a number in [0, 1) hashed
from the seed and ``doc_id``; documents are repeated accordingly and shuffled globally by a hash of
document and copy.

A null source is a source of its own. Rows with equal ``doc_id`` draw equal counts; a null
``doc_id`` hashes as an empty string. Texts are not looked at. Empty tables give empty results.
Sources without a given weight get none. Result columns win over input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowrill.llm.frames import packed, unpacked
from flowrill.session import shared_dir

Weights = dict[str | None, float]


def hashed(digits: int, *parts: Column) -> Column:
    """The first hex digits of an md5 as a number."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_rates(
    docs: DataFrame, weights: Weights | None = None, exponent: float = 0.5, total: float | None = None
) -> DataFrame:
    """``source, rate``: mean number of copies of each document of the source.

    Without ``weights`` a source weighs its number of documents to the power ``exponent`` (1 keeps
    the proportions, 0 makes all sources equal). ``total`` is the wanted mean number of rows, by
    default as many as there are.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            given = F.col("source").eqNullSafe(F.lit(source).cast("string"))
            weight = F.when(given, F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("weight").alias("all_weights"), F.sum("n").alias("all_rows"))
    wanted = F.col("all_rows").cast("double") if total is None else F.lit(float(total))
    share = F.when(F.col("all_weights") > 0, F.col("weight") / F.col("all_weights")).otherwise(0.0)
    return counts.crossJoin(F.broadcast(sums)).select(  # one row
        "source", (share * wanted / F.col("n")).alias("rate")
    )


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``source, steps``: the distribution function at 0, 1, 2, ... until doubles do not tell it
    from 1. Terms are computed by logarithms, so large rates do not underflow."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    upto = Window.partitionBy("source").orderBy("k")
    log_term = F.col("k") * F.log("rate") - F.col("rate") - F.sum(F.log(F.greatest("k", F.lit(1)))).over(upto)
    return (
        rates.where("rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("term", F.exp(log_term))
        .withColumn("step", F.sum("term").over(upto))
        .groupBy("source").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    )


def replicate(
    docs: DataFrame, weights: Weights | None = None, exponent: float = 0.5,
    total: float | None = None, seed: int = 10, copy: str = "copy", order_key: str = "order_key",
) -> DataFrame:
    """The documents' rows repeated and shuffled, with ``copy`` (from 1) and ``order_key``.

    Both may be given other names, for documents that have columns of these names to keep.

    Rows come in order of ``order_key``, partition after partition. The table of sources is stored
    first: where its measured size is below the broadcast threshold, documents are not exchanged
    before they are repeated; else the join is on the source, and adaptive execution splits a
    source that holds most of the rows.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "rates")
    poisson_steps(source_rates(docs.select("source"), weights, exponent, total)).write.parquet(path)
    steps = spark.read.schema("source string, steps array<double>").parquet(path)

    rows = packed(docs)
    source, doc_id = F.col("row").getField("source"), F.col("row").getField("doc_id")
    drawn = hashed(13, F.lit(seed), doc_id) / F.lit(float(16**13))
    times = F.size(F.filter("steps", lambda step: step <= F.col("drawn")))
    copies = (
        rows.withColumn("drawn", drawn)
        .join(steps, source.eqNullSafe(F.col("source")))
        .withColumn("times", times).where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
        .withColumn("order_key", hashed(15, F.lit(seed), F.col("row").getField("doc_id"), F.col("copy")))
    )
    shuffled = copies.repartitionByRange("order_key").sortWithinPartitions("order_key")
    return unpacked(shuffled.withColumnsRenamed({"copy": copy, "order_key": order_key}), copy, order_key)
