"""Registered queries of the linking operators, with their SQL oracles; facts come from the given tables by simple rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import linking
from knotwork.plans.catalogue import query
from knotwork.session import table
from knotwork.sources.tables import node_id


def _numbered(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


@query("""with m as (select 'nation:' || n_nationkey as class, 'm' || n_nationkey % 4 as name from nation union all select 'region:' || r_regionkey, 'z' || r_regionkey from region), d as (select *, class || '::' || name as method from m),
c as (select o_orderkey as seq, 'order:' || o_orderkey as source, case when o_orderkey % 11 = 0 then 'z' || o_orderkey % 7 else 'm' || o_orderkey % 5 end as name, case when o_orderkey % 4 = 0 then []::varchar[] else ['nation:' || o_orderkey % 25, 'nation:' || (o_orderkey * 7 + 3) % 25] end as receivers, o_orderkey % 3 <> 0 as complete from orders),
f as (select distinct seq, source, c.name, method, complete from (select *, unnest(receivers) as class from c) c join d on d.class = c.class and d.name = c.name), lone as (select name, min(method) as only_one from d group by name having count(*) = 1)
select seq, source, name, method as target, case when complete then 'INFERRED' else 'AMBIGUOUS' end as confidence, case when complete then 'inferred' else 'ambiguous' end as outcome from f
union all select seq, source, c.name, case when not (complete and len(receivers) > 0) then only_one end, case when not (complete and len(receivers) > 0) and only_one is not null then 'AMBIGUOUS' end, case when complete and len(receivers) > 0 then 'outside' when only_one is not null then 'ambiguous' else 'unknown' end
from c left join lone on lone.name = c.name where seq not in (select seq from f)""")
def union_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of orders on either of two nations."""
    k = F.col("o_orderkey")
    methods = table(spark, sf_dir, "nation").select(node_id("nation", "n_nationkey").alias("class"), _numbered("m", F.col("n_nationkey") % 4).alias("name"))
    methods = methods.union(table(spark, sf_dir, "region").select(node_id("region", "r_regionkey"), _numbered("z", F.col("r_regionkey")))).withColumn("method", F.concat_ws("::", "class", "name"))
    receivers = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(_numbered("nation:", k % 25), _numbered("nation:", (k * 7 + 3) % 25)))
    name = F.when(k % 11 == 0, _numbered("z", k % 7)).otherwise(_numbered("m", k % 5))
    calls = table(spark, sf_dir, "orders").select(k.alias("seq"), node_id("order", "o_orderkey").alias("source"), name.alias("name"), receivers.alias("receivers"), (k % 3 != 0).alias("complete"))
    return linking.union_calls(calls, methods, methods)


@query("""with c as (select o_orderkey as seq, 'order:' || o_orderkey as source, 'm' || o_custkey % 20 as target, case when o_orderkey % 3 = 0 then o_orderkey // 2 end as outer_call, 'p' || o_orderkey % 4 as parameter from orders), i as (select distinct 'm' || n_nationkey % 20 as method, 'p' || n_nationkey % 3 as parameter from nation)
select distinct o.target as source, c.target, 'INFERRED' as confidence, 'closure of ' || c.source as via from c join c o on o.seq = c.outer_call join i on i.method = o.target and i.parameter = c.parameter""")
def closure_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order as a call in a closure that is passed to the call of half its key."""
    k = F.col("o_orderkey")
    calls = table(spark, sf_dir, "orders").select(k.alias("seq"), node_id("order", "o_orderkey").alias("source"), _numbered("m", F.col("o_custkey") % 20).alias("target"), F.lit("INFERRED").alias("confidence"), F.when(k % 3 == 0, F.expr("o_orderkey div 2")).alias("outer"), _numbered("p", k % 4).alias("parameter"))
    invoked = table(spark, sf_dir, "nation").select(_numbered("m", F.col("n_nationkey") % 20).alias("method"), _numbered("p", F.col("n_nationkey") % 3).alias("parameter"))
    return linking.closure_calls(calls, invoked)


@query(r"""with c as (select c_custkey as k, 'x@Acme\N' || c_nationkey || '\S' || c_custkey % 50 || 'Interface' as interface, 'C' || c_custkey || case when c_custkey % 4 = 0 then 'Client' else '' end as class from customer),
r as (select 'rpc:' || s_suppkey as operation, 'M' || s_suppkey % 3 as rpc, case when s_suppkey % 10 = 9 then 'x@Other\S' else 'x@Acme\N' || s_nationkey || '\S' || s_suppkey % 50 || 'Interface' end as interface from supplier)
select operation, class || '::m' || k % 2 as target, 'implemented_by' as relation from r join c using (interface) where k % 4 <> 0 and rpc = 'M' || k % 2
union all select distinct operation, interface || '::m0', 'references' from r join c using (interface) where rpc = 'M0'""")
def rpc_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as remote calls, customers as classes that implement the interfaces generated for them."""
    customer, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    interface = F.concat(F.lit("x@Acme\\N"), F.col("c_nationkey").cast("string"), _numbered("\\S", k % 50), F.lit("Interface"))
    made = customer.select(F.concat(_numbered("C", k), F.when(k % 4 == 0, "Client").otherwise("")).alias("source"), interface.alias("target"), (k % 2).alias("m"))
    interfaces = made.select(F.col("target").alias("id")).distinct()
    methods = made.select(F.col("source").alias("class"), _numbered("m", F.col("m")).alias("name")).union(interfaces.select("id", F.lit("m0"))).withColumn("method", F.concat_ws("::", "class", "name"))
    s = F.col("s_suppkey")
    rpcs = table(spark, sf_dir, "supplier").select(_numbered("rpc:", s).alias("operation"), _numbered("acme..n", F.col("s_nationkey")).alias("package"), F.when(s % 10 == 9, "Other").alias("namespace"), _numbered("S", s % 50).alias("service"), _numbered("M", s % 3).alias("rpc"))
    return linking.link_rpcs(rpcs, interfaces, made, methods)


@query("""with s as (select 'nation:' || s_nationkey as id, 'supplier:' || s_suppkey as decorator, s_suppkey % 3 as p, -s_suppkey as late from supplier where s_suppkey % 4 = 0), c as (select 'supplier:' || c_custkey % 100 as id, 'customer:' || c_custkey as decorator, c_custkey % 2 as p, -c_custkey as late from customer where c_custkey % 4 = 0),
w as (select id, decorator, p, late, 9 as p2, 0 as late2 from s union all select id, decorator, p, late, 9, 0 from c union all select s.id, c.decorator, s.p, s.late, c.p, c.late from s join c on c.id = s.decorator)
select id, decorator, row_number() over (partition by id order by p, late, p2, late2) as position from w""")
def decorator_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers around nations, and customers around suppliers."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(node_id("nation", "s_nationkey").alias("id"), node_id("supplier", "s_suppkey").alias("decorator"), (s % 3).cast("int").alias("priority"), s.alias("seq"))
    rows = rows.union(table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(_numbered("supplier:", c % 100), node_id("customer", "c_custkey"), (c % 2).cast("int"), c))
    return linking.decorator_order(rows)


@query("select distinct 'user:' || user_id as source, 'type:' || event_type as target from events where event_type < 'p' and value > 0")
def enum_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as methods that read a property of their events, whose type is an enum for some types of event."""
    events = table(spark, sf_dir, "events")
    reads = events.where("value > 0").select(_numbered("user:", F.col("user_id")).alias("reader"), F.concat(F.lit("p:"), "event_type").alias("property"))
    kinds = events.select("event_type").distinct()
    types = kinds.select(F.concat(F.lit("p:"), "event_type").alias("property"), F.concat(F.lit("type:"), "event_type").alias("type"))
    return linking.enum_references(reads, types, kinds.select(F.concat(F.lit("type:"), "event_type").alias("id"), F.when(F.col("event_type") < "p", "enum").otherwise("class").alias("kind")))


@query("""with v as (select n_nationkey as k, lower(n_name) as value from nation where n_nationkey % 2 = 0)
select 'part:' || p_partkey as route, '/' || coalesce(a.value, '{C' || p_partkey % 25 || '}') || '/{id}/x' || coalesce(b.value, '{C' || p_partkey * 3 % 30 || '}') as path from part left join v a on a.k = p_partkey % 25 left join v b on b.k = p_partkey * 3 % 30""")
def route_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as routes with constants named after nations, of which every second has a value."""
    k = F.col("p_partkey")
    path = F.concat(_numbered("/{const:C", k % 25), F.lit("}/{id}/x"), _numbered("{const:C", k * 3 % 30), F.lit("}"))
    constants = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(_numbered("C", F.col("n_nationkey")).alias("name"), F.lower("n_name").alias("value"))
    return linking.with_constants(table(spark, sf_dir, "part").select(node_id("part", "p_partkey").alias("route"), path.alias("path")), constants)


@query("""select 'region:' || n_regionkey as id, 'src/' || c_mktsegment as directory, count(*) as classes from customer join nation on c_nationkey = n_nationkey where c_custkey % 7 <> 0 and c_custkey % 11 <> 0 group by all""")
def implementation_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as classes that implement nations, which extend regions."""
    customer, nation, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), F.col("c_custkey")
    file = F.concat(F.when(k % 7 == 0, "tests/").otherwise("src/"), "c_mktsegment", _numbered("/C", k), F.lit(".php"))
    nodes = customer.select(node_id("customer", "c_custkey").alias("id"), F.lit("class").alias("kind"), F.when(k % 11 != 0, file).alias("file"))
    nodes = nodes.union(nation.select(node_id("nation", "n_nationkey"), F.lit("interface"), F.lit("src/N.php")))
    edges = customer.select(node_id("customer", "c_custkey").alias("source"), F.lit("implements").alias("relation"), node_id("nation", "c_nationkey").alias("target"))
    edges = edges.union(nation.select(node_id("nation", "n_nationkey"), F.lit("extends"), node_id("region", "n_regionkey")))
    return linking.implementations_by_directory(nodes, edges, table(spark, sf_dir, "region").select(node_id("region", "r_regionkey").alias("id")))


@query("""select distinct 'customer:' || c_custkey as handler, 'order:' || o_orderkey as message, a.n_name as context, b.n_name as other from customer join orders on o_custkey = c_custkey join nation a on a.n_nationkey = c_nationkey join nation b on b.n_nationkey = o_orderkey % 25
where c_custkey % 3 <> 0 and a.n_nationkey <> b.n_nationkey and b.n_nationkey not in (1, 6)""")
def foreign_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as handlers in their nations that dispatch orders, each a message of some nation; two nations are shared."""
    customer, orders, nation = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    shared = tuple(r.n_name for r in nation.where("n_nationkey in (1, 6)").select("n_name").collect())  # two names
    of = customer.select(node_id("customer", "c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey")).union(orders.select(node_id("order", "o_orderkey"), F.col("o_orderkey") % 25))
    contexts = of.join(F.broadcast(nation.select("n_nationkey", "n_name")), "n_nationkey").select("id", F.col("n_name").alias("context"))  # nations: a fixed few
    sent = orders.select(node_id("customer", "o_custkey").alias("class"), node_id("order", "o_orderkey").alias("message"))
    return linking.foreign_dispatches(sent, customer.where("c_custkey % 3 <> 0").select(node_id("customer", "c_custkey").alias("class")), contexts, shared)


@query("""with recursive a as (select 's' || s as service, 'part:' || p_partkey as id, 'part:' || p_partkey // 3 as target, p_partkey from part, (values (0), (1)) t(s) where p_partkey >= 3 and (s = 0 or p_partkey % 5 <> 0)),
h as (select service, target as start, id, 1 as depth from a where target in ('part:1', 'part:2', 'part:5') union all select a.service, h.start, a.id, depth + 1 from h join a on a.target = h.id and a.service = h.service where depth < 4)
select service, start as id, id as holder, depth from h""")
def transitive_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts given the part of a third of their number, in two services."""
    part = table(spark, sf_dir, "part").where("p_partkey >= 3")
    given = part.select(F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("service"), node_id("part", "p_partkey").alias("id"), F.concat(F.lit("part:"), F.expr("cast(p_partkey div 3 as string)")).alias("target"), "p_partkey")
    given = given.where("service = 's0' or p_partkey % 5 <> 0").drop("p_partkey")
    starts = given.select("service", F.col("target").alias("id")).where("id in ('part:1', 'part:2', 'part:5')").distinct()
    return linking.transitive_holders(given, starts, depth=4)


@query("""with recursive i as (select p_partkey as file, p_partkey // 4 as parent, 'p' || p_partkey % 10 as prefix from part where p_partkey >= 4 union select p_partkey, p_partkey // 2, 'q' from part where p_partkey % 50 = 0 and p_partkey >= 4),
w as (select p_partkey as file, p_partkey as here, '' as prefix from part union select w.file, i.parent, '/' || i.prefix || w.prefix from w join i on i.file = w.here)
select distinct 'f' || file as file, prefix from w where here not in (select file from i)""")
def import_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as route files, imported by the file of a quarter of their number, some by that of half of it too."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    late = part.where("p_partkey >= 4")
    imports = late.select(_numbered("f", k).alias("file"), _numbered("f", F.expr("p_partkey div 4")).alias("parent"), F.concat(_numbered("/p", k % 10), F.lit("/")).alias("prefix"))
    imports = imports.union(late.where("p_partkey % 50 = 0").select(_numbered("f", k), _numbered("f", F.expr("p_partkey div 2")), F.lit("q")))
    return linking.import_prefixes(part.select(_numbered("f", k).alias("file")), imports, depth=20)
