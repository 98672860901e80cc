"""The driver's star-schema tables as a property graph: a view, without copies."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import PropertyGraph


def _id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


@lru_cache(maxsize=8)
def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions to events as nodes, foreign keys as relationships.

    Order lines have no key of their own, so a line's relationship is numbered within its order
    along all its columns; the numbering is left out of plans that don't ask for it.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, customer, supplier, part = map(read, ("region", "nation", "customer", "supplier", "part"))
    orders, lines, events, documents, labels = map(read, ("orders", "lineitem", "events", "documents", "labels"))

    def named(frame: DataFrame, kind: str, key: str, **props: str) -> DataFrame:
        return frame.select(_id(kind, key).alias("id"), *[F.col(c).alias(p) for p, c in props.items()])

    def rel(frame: DataFrame, id: Column, src: Column, dst: Column, **props: str) -> DataFrame:
        return frame.select(id.alias("rel_id"), src.alias("src"), dst.alias("dst"), *[F.col(c).alias(p) for p, c in props.items()])

    g = PropertyGraph(spark)
    g = g.with_nodes("region", named(region, "region", "r_regionkey", name="r_name"), ["Region"])
    g = g.with_nodes("nation", named(nation, "nation", "n_nationkey", name="n_name"), ["Nation"])
    g = g.with_nodes("customer", named(customer, "customer", "c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"), ["Customer", "Party"])
    g = g.with_nodes("supplier", named(supplier, "supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"), ["Supplier", "Party"])
    g = g.with_nodes("part", named(part, "part", "p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", retailprice="p_retailprice"), ["Part"])
    g = g.with_nodes("order", named(orders, "order", "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"), ["Order"])
    g = g.with_nodes("event", named(events.withColumn("props", F.try_parse_json("props")), "event", "event_id", ts="ts", event_type="event_type", value="value", props="props"), ["Event"])
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = documents.select("doc_id", "lang", "source", "n_chars").join(marks, "doc_id", "left")
    g = g.with_nodes("document", named(docs, "doc", "doc_id", lang="lang", source="source", n_chars="n_chars", quality="quality", toxic="toxic"), ["Document"])

    g = g.with_rels("IN_REGION", rel(nation, _id("inreg", "n_nationkey"), _id("nation", "n_nationkey"), _id("region", "n_regionkey")), ["Nation"], ["Region"], True)
    cloc = rel(customer, _id("cloc", "c_custkey"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"))
    sloc = rel(supplier, _id("sloc", "s_suppkey"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"))
    g = g.with_rels("LOCATED_IN", cloc.unionAll(sloc), ["Party"], ["Nation"], True)
    placed = rel(orders, _id("placed", "o_orderkey"), _id("customer", "o_custkey"), _id("order", "o_orderkey"), orderdate="o_orderdate")
    g = g.with_rels("PLACED", placed, ["Customer"], ["Order"], True)
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[c for c in lines.columns if c != "l_orderkey"]))
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), nth.cast("string"))
    contains = rel(
        lines, _id("line", line), _id("order", "l_orderkey"), _id("part", "l_partkey"), quantity="l_quantity", extendedprice="l_extendedprice",
        discount="l_discount", tax="l_tax", returnflag="l_returnflag", shipdate="l_shipdate",
    )
    g = g.with_rels("CONTAINS", contains, ["Order"], ["Part"], True)
    pairs = lines.select("l_partkey", "l_suppkey").distinct()
    pair = F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"))
    g = g.with_rels("SUPPLIED_BY", rel(pairs, _id("sup", pair), _id("part", "l_partkey"), _id("supplier", "l_suppkey")), ["Part"], ["Supplier"], True)
    did = rel(events, _id("did", "event_id"), _id("customer", "user_id"), _id("event", "event_id"))
    g = g.with_rels("DID", did, ["Customer"], ["Event"], True)
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    for type, far in (("NEXT", 1), ("SKIP", 3)):
        later = events.select("event_id", "ts", F.lead("event_id", far).over(along).alias("next_id"), F.lead("ts", far).over(along).alias("next_ts"))
        gap = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
        later = later.where("next_id IS NOT NULL").withColumn("gap", (gap if far == 1 else F.floor(gap / 2)).cast("double"))
        steps = rel(later, _id(type.lower(), "event_id"), _id("event", "event_id"), _id("event", "next_id"), gap="gap")
        g = g.with_rels(type, steps, ["Event"], ["Event"], True)
    return g
