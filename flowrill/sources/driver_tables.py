"""Flow table derived from the order tables, so that every operator can run over them.

Each line item is one flow, from a customer's host to a supplier's host. Only the order's customer
is needed from ``orders``, so the join reads two of its columns. Spark chooses the join by size: a
broadcast while ``orders`` is small, a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowrill.functions.numbers import INF


def _address(prefix: str, number: str):
    return F.concat(
        F.lit(prefix),
        F.expr(f"cast({number} div 256 as string)"),
        F.lit("."),
        F.expr(f"cast({number} % 256 as string)"),
    )


def flows_from_tables(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Typed flow table over ``lineitem`` and ``orders`` in ``sf_dir``.

    ``lines`` replaces the line items, for example by a stream of them.
    """
    if lines is None:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)

    number, returned = F.col("l_linenumber"), F.col("l_returnflag") == "R"
    tax_points = F.round(F.col("l_tax") * 100).cast("bigint")
    discount_points = F.round(F.col("l_discount") * 100).cast("bigint")
    return joined.select(
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        ).alias("flow_id"),
        _address("10.0.", "o_custkey").alias("src_ip"),
        (F.lit(1024) + F.col("l_partkey") % 50000).alias("src_port"),
        _address("10.1.", "l_suppkey").alias("dst_ip"),
        F.when(number == 1, 80).when(number == 2, 443).when(number == 3, 53).otherwise(22)
        .alias("dst_port"),
        F.when(number == 1, 0).when(number == 2, 1).when(number.isin(3, 4), 17)
        .when(number == 7, 2).otherwise(6).alias("protocol"),
        F.date_format("l_shipdate", "dd/MM/yyyy hh:mm:ss a").alias("timestamp_raw"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_shipdate").cast("date").alias("flow_date"),
        (F.col("l_quantity") * 1000).alias("flow_duration"),
        F.col("l_quantity").cast("bigint").alias("total_fwd_packet"),
        number.cast("bigint").alias("total_bwd_packets"),
        F.col("l_extendedprice").alias("total_length_fwd"),
        (F.col("l_tax") * 100).alias("total_length_bwd"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("fwd_packet_length_mean"),
        F.when(F.col("l_quantity") == 1, F.lit(INF)).otherwise(F.col("l_extendedprice"))
        .alias("flow_bytes_s"),
        (F.col("l_quantity") * F.when(F.col("o_custkey") % 7 == 0, 100).otherwise(1))
        .alias("flow_packets_s"),
        (F.col("l_tax") * 1000).alias("flow_iat_mean"),
        F.when(discount_points >= 8, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("fin"),
        number.cast("bigint").alias("syn"),
        F.when(returned, number.cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("rst"),
        discount_points.alias("psh"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit(0).cast("bigint")).otherwise(tax_points)
        .alias("ack"),
        (discount_points % 2).alias("urg"),
        (discount_points % 3).alias("cwr"),
        (discount_points % 5).alias("ece"),
        F.col("l_quantity").alias("active_mean"),
        F.col("l_tax").alias("idle_mean"),
        F.when((number == 7) & (F.col("l_returnflag") == "N"), F.lit(None).cast("string"))
        .when(returned & (F.col("l_quantity") > 25), "DoS").otherwise("BENIGN").alias("label"),
    )


def flow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows as a stream of line items joined with the static orders.

    The table may be a file or a folder of files; a pattern as path accepts both.
    """
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = (
        spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parque[t]")
    )
    return flows_from_tables(spark, sf_dir, lines)


# The same table for a SQL engine with ``//`` as integer division, as a CTE named ``flows``.
FLOWS_SQL = """
flows as (
  select concat(cast(l_orderkey as varchar), '-', cast(l_partkey as varchar), '-',
                cast(l_suppkey as varchar), '-', cast(l_linenumber as varchar)) as flow_id,
    concat('10.0.', cast(o_custkey // 256 as varchar), '.', cast(o_custkey % 256 as varchar)) as src_ip,
    1024 + l_partkey % 50000 as src_port,
    concat('10.1.', cast(l_suppkey // 256 as varchar), '.', cast(l_suppkey % 256 as varchar)) as dst_ip,
    case l_linenumber when 1 then 80 when 2 then 443 when 3 then 53 else 22 end as dst_port,
    case l_linenumber when 1 then 0 when 2 then 1 when 3 then 17 when 4 then 17 when 7 then 2
         else 6 end as protocol,
    strftime(l_shipdate, '%d/%m/%Y %I:%M:%S %p') as timestamp_raw,
    l_shipdate as ts, cast(l_shipdate as date) as flow_date,
    l_quantity * 1000 as flow_duration,
    cast(l_quantity as bigint) as total_fwd_packet, cast(l_linenumber as bigint) as total_bwd_packets,
    l_extendedprice as total_length_fwd, l_tax * 100 as total_length_bwd,
    l_extendedprice / l_quantity as fwd_packet_length_mean,
    case when l_quantity = 1 then cast('Infinity' as double) else l_extendedprice end as flow_bytes_s,
    l_quantity * (case when o_custkey % 7 = 0 then 100 else 1 end) as flow_packets_s,
    l_tax * 1000 as flow_iat_mean,
    cast(case when round(l_discount * 100) >= 8 then 1 else 0 end as bigint) as fin,
    cast(l_linenumber as bigint) as syn,
    case when l_returnflag = 'R' then cast(l_linenumber as bigint) else cast(0 as bigint) end as rst,
    cast(round(l_discount * 100) as bigint) as psh,
    case when o_custkey % 5 = 0 then cast(0 as bigint) else cast(round(l_tax * 100) as bigint) end as ack,
    cast(round(l_discount * 100) as bigint) % 2 as urg,
    cast(round(l_discount * 100) as bigint) % 3 as cwr,
    cast(round(l_discount * 100) as bigint) % 5 as ece,
    l_quantity as active_mean, l_tax as idle_mean,
    case when l_linenumber = 7 and l_returnflag = 'N' then null
         when l_returnflag = 'R' and l_quantity > 25 then 'DoS' else 'BENIGN' end as label
  from lineitem join orders on l_orderkey = o_orderkey
)
"""
