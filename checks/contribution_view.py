"""Contribution log derived from the order tables, for tests and benchmarks.

Every line item becomes one contribution.  The three profiles differ only in who the
contributor is, which gives many small, some medium or few very active users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editpulse.functions.rules import WORLD_BOUNDS

PROFILES = {"sparse": "l_orderkey", "medium": "o_custkey", "dense": "l_suppkey"}
RANGE_START = "1995-01-01 00:00:00"
RANGE_END = "2002-01-01 00:00:00"
VALIDITY_SNAPSHOT = "2001-12-31 23:59:59"
COHORT_SNAPSHOT = "2001-12-31"

TAG_SETS = (
    {"building": "yes"},
    {"building": "no", "name": "a"},
    {"building": "school"},
    {"highway": "residential", "surface": "asphalt"},
    {"amenity": "school"},
    {"amenity": "bank"},
    {"amenity": "hospital"},
    {"amenity": "shelter"},
    {"amenity": "toilets"},
    {"water": "pond", "natural": "water"},
    {"water": "other"},
    {"shop": "bakery", "name": "b"},
    {"healthcare": "clinic"},
    {"landuse": "forest"},
    {"waterway": "riverbank"},
    {"waterway": "river"},
    {"place": "village"},
    {"office": "ngo", "craft": "tailor"},
    {"social_facility": "outreach", "man_made": "water_well"},
    {"note": "x"},
)
EDITORS = {"1": "JOSM/1.5", "2": "iD 2.20", "3": "StreetComplete 50", "4": "Vespucci 18"}
EDIT_KINDS = {"AF": "CREATION", "AO": "DELETION", "NF": "TAG", "NO": "GEOMETRY", "RF": "TAG_GEOMETRY", "RO": ""}


SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_name string",
    "nation": "n_nationkey int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that is stored as fewer pieces than there are cores.

    The small test files hold a single row group, which one task would read alone.  A
    table with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _nation_code(key: str) -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(key).cast("string"), 2, "0"))


def _tag_set(index: str) -> Column:
    sets = ", ".join(
        "map(" + ", ".join(f"'{key}', '{value}'" for key, value in tags.items()) + ")" for tags in TAG_SETS
    )
    return F.expr(f"element_at(array({sets}), cast({index} + 1 AS int))")


def _lookup(value: Column, choices: dict[str, str]) -> Column:
    chosen = None
    for key, text in choices.items():
        chosen = F.when(value == key, text) if chosen is None else chosen.when(value == key, text)
    return chosen


def contributions(spark: SparkSession, sf_dir: str, profile: str = "sparse") -> DataFrame:
    lines = spread(table(spark, sf_dir, "lineitem"))
    suppliers = table(spark, sf_dir, "supplier")
    customers = table(spark, sf_dir, "customer")
    parts = table(spark, sf_dir, "part")
    # orders meet their customers first, so line items are shuffled once less
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    number, part = F.col("l_linenumber"), F.col("l_partkey")
    amount = F.floor("l_quantity").cast("int")
    kind = F.concat("l_returnflag", "l_linestatus")
    supplier_nation, customer_nation = _nation_code("s_nationkey"), _nation_code("c_nationkey")
    countries = (
        F.when(number == 7, F.array().cast("array<string>"))
        .when(part % 50 == 0, F.array(supplier_nation, F.lit("CP"), F.lit("XA")))
        .when(number % 3 == 0, F.array(supplier_nation, customer_nation))
        .otherwise(F.array(supplier_nation))
    )
    valid_from = F.col("l_shipdate") + F.make_dt_interval(hours=number)
    before = F.when(
        kind == "AF", F.when(number % 2 == 1, F.create_map().cast("map<string,string>"))
    ).otherwise(_tag_set("(l_partkey + cast(floor(l_quantity) AS int)) % 20"))
    west = F.lit(-120) + F.lit(10) * F.col("s_nationkey") + F.col("l_quantity") / 10
    return rows.select(
        countries.alias("countries"),
        (part * 10 + number).alias("osm_id"),
        F.element_at(F.array(F.lit("relation"), F.lit("node"), F.lit("way")), number % 3 + 1).alias("osm_type"),
        F.struct(F.col(PROFILES[profile]).alias("id")).alias("user"),
        valid_from.alias("valid_from"),
        F.when(F.col("l_returnflag") != "N", valid_from + F.make_dt_interval(days=amount)).alias("valid_to"),
        _tag_set("l_partkey % 20").alias("tags"),
        before.alias("tags_before"),
        _lookup(kind, EDIT_KINDS).alias("contrib_type"),
        F.struct(
            (F.col("l_orderkey") * 8 + number).alias("id"),
            _lookup(F.substring("o_orderpriority", 1, 1), EDITORS).alias("editor"),
            F.when(F.col("l_tax") == 0, F.create_map().cast("map<string,string>"))
            .otherwise(F.create_map(F.lit("comment"), F.col("p_name")))
            .alias("tags"),
            F.col("o_orderdate").alias("created_at"),
            (F.col("o_orderdate") + F.make_dt_interval(mins=amount)).alias("closed_at"),
        ).alias("changeset"),
        F.struct(
            west.alias("xmin"),
            (F.col("l_tax") * -100).alias("ymin"),
            (west + F.col("l_discount") * 50).alias("xmax"),
            (F.col("l_tax") * 100).alias("ymax"),
        ).alias("bbox"),
    )


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per nation; every fifth nation spans the world."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    world = key % 5 == 0
    xmin, ymin, xmax, ymax = WORLD_BOUNDS

    def side(whole: float, own: Column) -> Column:
        return F.when(world, F.lit(whole)).otherwise(own.cast("double"))

    return nation.select(
        _nation_code("n_nationkey").alias("iso"),
        side(xmin, key * 10 - 120).alias("xmin"),
        side(ymin, F.lit(-60)).alias("ymin"),
        side(xmax, key * 10 - 111).alias("xmax"),
        side(ymax, F.lit(60)).alias("ymax"),
    )
