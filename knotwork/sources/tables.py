"""Adapters: the given tables as graphs and fact tables, so that the graph operators run on data of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.graph import confidence_rank
from knotwork.session import table

#: The kind of node that each table's rows become.
KIND = {"region": "interface", "nation": "trait", "customer": "class", "supplier": "enum", "part": "method", "order": "function"}


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the trade graph, before merging: an order calls parts and references its customer, a part receives its
    supplier, and these reference nations, which reference regions."""
    flag = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "A", "INFERRED").otherwise("AMBIGUOUS")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", flag.alias("confidence"))
    rank = F.when(F.col("confidence") == "EXTRACTED", 1).when(F.col("confidence") == "INFERRED", 2).otherwise(3)
    lines = lines.withColumn("seq", F.col("l_linenumber").cast("long") * 10 + rank)

    def fact(df: DataFrame, source: Column, relation: str, target: Column, confidence: Column | None = None, line: Column | None = None, seq: Column | None = None) -> DataFrame:
        return df.select(
            source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"), (confidence if confidence is not None else F.lit("EXTRACTED")).alias("confidence"),
            (line if line is not None else F.lit(None)).cast("int").alias("line"), F.lit(None).cast("string").alias("via"), (seq if seq is not None else F.lit(0)).cast("long").alias("seq"),
        )

    marks = (F.col("confidence"), F.col("l_linenumber"), F.col("seq"))
    parts = [
        fact(lines, node_id("order", "l_orderkey"), "calls", node_id("part", "l_partkey"), *marks),
        fact(lines, node_id("part", "l_partkey"), "receives", node_id("supplier", "l_suppkey"), *marks),
        fact(table(spark, sf_dir, "orders"), node_id("order", "o_orderkey"), "references", node_id("customer", "o_custkey")),
        place_edges(spark, sf_dir),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the trade graph that is a tree: customers and suppliers, nations, regions."""
    rows = None
    for name, source, key, target, up in (("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "nation", "n_nationkey", "region", "n_regionkey")):
        part = table(spark, sf_dir, name).select(
            node_id(source, key).alias("source"), F.lit("references").alias("relation"), node_id(target, up).alias("target"), F.lit("EXTRACTED").alias("confidence"),
            F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("via"), F.lit(0).cast("long").alias("seq"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name, kind, key, label in (
        ("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"),
        ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("orders", "order", "o_orderkey", "o_orderpriority"),
    ):
        part = table(spark, sf_dir, name).select(
            node_id(kind, key).alias("id"), F.col(label).alias("label"), F.lit(KIND[kind]).alias("kind"), F.lit(None).cast("string").alias("file"),
            F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("service"), F.col(key).cast("long").alias("seq"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, confidence): customers depend on the suppliers of what they order, as namespaced classes.

    region\\nation\\layer\\name; the layer's segment follows the key, so that every kind of segment occurs.
    """
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", F.concat_ws("\\", "r_name", "n_name").alias("place"))

    def classes(name: str, key: str, nation: str, short: str, segments: tuple[str, ...]) -> DataFrame:
        segment = F.element_at(F.array(*(F.lit(s) for s in segments)), (F.col(key) % len(segments) + 1).cast("int"))
        df = table(spark, sf_dir, name).join(F.broadcast(places), F.col(nation) == F.col("n_nationkey"))  # places: the nations, a fixed few
        return df.select(key, F.concat_ws("\\", "place", segment, F.concat(F.lit(short), F.col(key).cast("string"))).alias("class"))

    customers = classes("customer", "c_custkey", "c_nationkey", "Customer", CUSTOMER_SEGMENTS)
    suppliers = classes("supplier", "s_suppkey", "s_nationkey", "Supplier", SUPPLIER_SEGMENTS)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "A", "INFERRED").otherwise("AMBIGUOUS").alias("confidence"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.select(F.col("class").alias("source"), "l_suppkey", "confidence").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("source", F.col("class").alias("target"), "confidence")


CUSTOMER_SEGMENTS = ("Domain", "UseCases", "Model", "Billing")
SUPPLIER_SEGMENTS = ("Infra", "Http", "Domain", "Port", "Shipping")


def event_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sends and handlers: a user sends the type of an event of even id, and handles that of an odd one. A message is type and
    day, so that some are only sent or only handled; the service is the user's number modulo 5."""
    events = table(spark, sf_dir, "events")
    message = F.concat_ws("@", "event_type", F.date_format("ts", "yyyy-MM-dd HH"))
    rows = events.select(message.alias("message"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("service"), (F.col("user_id") % 5).cast("string")).alias("service"), (F.col("event_id") % 2).alias("odd"))
    sends = rows.where("odd = 0").select("message", F.col("user").alias("sender"), "service")
    return sends, rows.where("odd = 1").select("message", F.col("user").alias("handler"), "service")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href, nth): links in the pages' text."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("nth", "href"))
    return pages.select("page_id", "href", "nth")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): the urls' paths."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"))


def code_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as of a code base: customers are classes and orders their methods, parts methods of twenty interfaces, pages
    routes, users messages. The lines of an order are its facts, by their number: 1 calls another order, 2 a part's method; 3
    overrides one; 4 reads the state that another order writes; 5 instantiates a customer. Events of even id send their user."""
    o, line = F.col("o_orderkey"), F.col("l_linenumber")
    classed = table(spark, sf_dir, "orders").select(o, F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("class"))
    methods = classed.select(o, "class", F.concat("class", F.when(o % 19 == 0, "::__construct").otherwise(F.concat(F.lit("::m"), o.cast("string")))).alias("method"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("I"), (F.col("p_partkey") % 20).cast("string")).alias("class"), "p_partkey")
    parts = parts.select("class", F.concat("class", F.lit("::p"), F.col("p_partkey").cast("string")).alias("method"))
    customers, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")

    def nodes(df: DataFrame, ident: Column | str, kind: str, file: Column = none) -> DataFrame:
        return df.select(F.col(ident).alias("id") if isinstance(ident, str) else ident.alias("id"), F.lit(kind).alias("kind"), file.alias("file")).distinct()

    def name(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    place = F.concat(F.when(k % 10 == 9, "tests/C").otherwise("src/C"), k.cast("string"), F.lit(".php"))
    every = nodes(customers, name("C", k), "class", place)
    for df in (nodes(methods, "method", "method"), nodes(parts, "class", "interface"), nodes(parts, "method", "method"), nodes(pages, name("route:", F.col("page_id")), "route"), nodes(events, name("message:", F.col("user_id")), "class")):
        every = every.unionByName(df)

    sure = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "A", "INFERRED").otherwise("AMBIGUOUS")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", line, sure.alias("confidence"), F.when(F.col("l_quantity") > 40, F.array(line, line + 1)).otherwise(F.array(line)).alias("lines"))
    lines = lines.join(methods.select(o.alias("l_orderkey"), F.col("method").alias("source")), "l_orderkey")

    def facts(df: DataFrame, source: Column, relation: str, target: Column) -> DataFrame:
        confidence = F.col("confidence") if "confidence" in df.columns else F.lit("EXTRACTED")
        where = F.col("lines") if "lines" in df.columns else F.array().cast("array<int>")
        return df.select(source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"), confidence.alias("confidence"), where.alias("lines"), none.alias("via"))

    def to_method(df: DataFrame, number: Column) -> DataFrame:
        return df.withColumn("_number", number).join(methods.select(o.alias("_number"), F.col("method").alias("target")), "_number")

    source, target, part = F.col("source"), F.col("target"), F.col("l_partkey")
    of_part = F.concat(name("I", part % 20), name("::p", part))
    user, event, page = F.col("user_id"), F.col("event_id"), F.col("page_id")
    found = [
        facts(methods, F.col("class"), "has_method", F.col("method")),
        facts(parts, F.col("class"), "has_method", F.col("method")),
        facts(customers.where((k % 4 == 1) & (k > 1)), name("C", k), "extends", name("C", F.expr("c_custkey div 3"))),
        facts(customers.where(k % 3 == 0), name("C", k), "implements", name("I", k % 20)),
        facts(to_method(lines.where(line == 1), part * 7 + F.col("l_suppkey")), source, "calls", target),
        facts(lines.where((line == 2) & (part % 3 == 0)), source, "calls", of_part),
        facts(lines.where((line == 3) & (F.col("l_orderkey") % 7 == 3)), source, "overrides", of_part),
        facts(to_method(lines.where((line == 4) & (F.col("l_orderkey") % 5 == 0)), part * 3), source, "reads_state_of", target),
        facts(lines.where((line == 5) & (F.col("l_orderkey") % 3 == 0)), source, "instantiates", name("C", F.col("l_suppkey"))),
        facts(to_method(pages, page * 3), name("route:", page), "handled_by", target),
        facts(pages, name("route:", page), "references", name("C", page % 97)),
        facts(to_method(events.where(event % 2 == 0), event).withColumnRenamed("target", "source"), source, "dispatches", name("message:", user)),
        facts(to_method(events.select("user_id").distinct(), user * 2), name("message:", user), "handled_by", target),
    ]
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    first = F.min(F.struct(confidence_rank(F.col("confidence")).alias("rank"), "lines", "confidence")).alias("first")
    edges = edges.where("source <> target").groupBy("source", "relation", "target").agg(first)
    return every, edges.select("source", "relation", "target", "first.confidence", "first.lines", none.alias("via"))
