"""The raster-like views over the given tables that the registered queries run on, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Corners of a supplier's polygon, from its place (x, y) and width w, in the words of both engines.
RECTANGLE = [("x", "y"), ("x + w", "y"), ("x + w", "y + 1"), ("x", "y + 1")]
TRIANGLE = [("x + cast(0.2 as double)", "y + cast(0.1 as double)"), ("x + w + cast(0.7 as double)", "y + cast(0.4 as double)"), ("x + cast(0.5 as double)", "y + cast(1.9 as double)")]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def px(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id div 100 as row", "event_id % 100 as col", "value as b1", "cast(get_json_object(props, '$.k') as double) as b2", "event_type as cls", "ts")


def spec(spark: SparkSession, d: str) -> DataFrame:
    bands = [f"(cast(embedding[{k - 1}] as double) + 1) / 20 as b{k}" for k in range(1, 11)]
    return table(spark, d, "embeddings").selectExpr("vec_id div 25 as row", "vec_id % 25 as col", *bands, "label as cls")


def segpx(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_partkey as segment_id", "l_suppkey as tile_id", "l_quantity / 50 as b1", "l_extendedprice / 100000 as b2", "nullif(l_discount, 0D) as b3", "nullif(l_tax, 0D) as b4", "l_returnflag as cls"
    )


def pts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "c_custkey as point_id", "(c_custkey * 7) % 100 + 0.5D as x", "(c_custkey * 13) % 10 + 0.5D as y", "abs(c_acctbal) / 1000 as depth", "c_mktsegment as hab_class", "c_nationkey as segment_id"
    )


def pred(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey % 10 as fold", "l_returnflag as truth", "case when l_linenumber <= 5 then l_returnflag when l_linestatus = 'O' then 'N' else 'A' end as pred")


def proba_stack(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_linenumber as run_id", "l_partkey div 20 as row", "l_partkey % 20 as col", "l_returnflag as class", "l_discount * 10 as proba")


def cover_obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_partkey as obs_id", "l_linenumber as type_id", "l_quantity").groupBy("obs_id", "type_id").agg(F.sum("l_quantity").alias("cover"))


def cover_wide(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.sum(F.when(F.col("type_id") == k, F.col("cover")).otherwise(0.0)).alias(f"c{k}") for k in range(1, 8)]
    return cover_obs(spark, d).groupBy("obs_id").agg(*sums)


def change_epochs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.windows import majority

    base = table(spark, d, "lineitem").selectExpr("l_partkey as cell", "case when year(l_shipdate) < 1998 then 1 else 2 end as epoch", "l_returnflag as cls")
    return majority(base, ["cell", "epoch"], "cls").drop("n")


def dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey as obs_id", "o_orderdate as date", "o_orderstatus as cls")


def polys(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle or a triangle for each supplier, in px coordinates; the label is the nation's."""
    point = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    rings = [f"array({', '.join(point(a, b) for a, b in ring)})" for ring in (RECTANGLE, TRIANGLE)]
    some = table(spark, d, "supplier").selectExpr("s_suppkey", "s_nationkey", "double(s_suppkey * 3 % 90) as x", "double(s_suppkey * 7 % 8) as y", "double(1 + s_nationkey % 5) as w")
    return some.selectExpr("s_suppkey as poly_id", "concat('n', s_nationkey) as label", "int(s_nationkey + 1) as int_class", f"if(s_suppkey % 2 = 0, {rings[0]}, {rings[1]}) as ring")


_BANDS = ", ".join(f"(cast(embedding[{k}] as double) + 1) / 20 as b{k}" for k in range(1, 11))
DUCK = {
    "px": "select event_id // 100 as row, event_id % 100 as col, value as b1, cast(json_extract_string(props, '$.k') as double) as b2, event_type as cls, ts from events",
    "spec": f"select vec_id // 25 as row, vec_id % 25 as col, {_BANDS}, label as cls from embeddings",
    "segpx": "select l_partkey as segment_id, l_suppkey as tile_id, l_quantity / 50 as b1, l_extendedprice / 100000 as b2, nullif(l_discount, 0) as b3, nullif(l_tax, 0) as b4, l_returnflag as cls from lineitem",
    "pts": "select c_custkey as point_id, (c_custkey * 7) % 100 + 0.5::double as x, (c_custkey * 13) % 10 + 0.5::double as y, abs(c_acctbal) / 1000 as depth, c_mktsegment as hab_class, c_nationkey as segment_id from customer",
    "pred": "select l_suppkey % 10 as fold, l_returnflag as truth, case when l_linenumber <= 5 then l_returnflag when l_linestatus = 'O' then 'N' else 'A' end as pred from lineitem",
    "proba_stack": "select l_linenumber as run_id, l_partkey // 20 as row, l_partkey % 20 as col, l_returnflag as class, l_discount * 10 as proba from lineitem",
    "cover_obs": "select l_partkey as obs_id, l_linenumber as type_id, sum(l_quantity) as cover from lineitem group by all",
    "cover_wide": "select obs_id, " + ", ".join(f"sum(case when type_id = {k} then cover else 0 end) as c{k}" for k in range(1, 8)) + " from (select l_partkey as obs_id, l_linenumber as type_id, sum(l_quantity) as cover from lineitem group by all) group by obs_id",
    "change_epochs": "select cell, epoch, cls from (select cell, epoch, cls, row_number() over (partition by cell, epoch order by count(*) desc, cls) as rn from (select l_partkey as cell, case when year(l_shipdate) < 1998 then 1 else 2 end as epoch, l_returnflag as cls from lineitem) group by cell, epoch, cls) where rn = 1",
    "dates": "select o_orderkey as obs_id, o_orderdate as date, o_orderstatus as cls from orders",
    "polys": "select s_suppkey as poly_id, concat('n', cast(s_nationkey as varchar)) as label, cast(s_nationkey + 1 as int) as int_class, case when s_suppkey % 2 = 0 then "
    + " else ".join("[" + ", ".join(f"{{'x': {a}, 'y': {b}}}" for a, b in ring) + "]" for ring in (RECTANGLE, TRIANGLE))
    + " end as ring from (select *, (s_suppkey * 3 % 90)::double as x, (s_suppkey * 7 % 8)::double as y, (1 + s_nationkey % 5)::double as w from supplier)",
}


def sql(body: str, *views: str, extra: str = "") -> str:
    """A DuckDB query over the named views, with further common table expressions if need be."""
    ctes = [f"{v} as ({DUCK[v]})" for v in views] + ([extra] if extra else [])
    return ("with recursive " + ", ".join(ctes) + " " if ctes else "") + body


def r(x: str, digits: int = 6) -> str:
    """Rounded as the Spark side rounds, without a negative zero."""
    return f"(round({x}, {digits}) + 0.0)"
