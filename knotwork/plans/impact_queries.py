"""Registered queries of impact, over the tables as a code graph, with their SQL oracles: steps by joins, levels spelled out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.words import is_test_path, path_segments
from knotwork.operators import cones, generics, growth, impact, patterns, traverse
from knotwork.plans.catalogue import query, relevance_scores
from knotwork.session import materialize, table
from knotwork.sources.tables import code_graph, place_edges, trade_nodes

DEPTH, DAYS, ROUNDS = 3, 30, 4

_GRAPH = """m as (select o_orderkey as k, 'C' || o_custkey as class, 'C' || o_custkey || case when o_orderkey % 19 = 0 then '::__construct' else '::m' || o_orderkey end as method, o_orderdate from orders),
p as (select 'I' || p_partkey % 20 as class, 'I' || p_partkey % 20 || '::p' || p_partkey as method from part),
n0 as (select 'C' || c_custkey as id, 'class' as kind, c_custkey % 10 = 9 as test from customer union select method, 'method', false from m union select class, 'interface', false from p union select method, 'method', false from p
  union select 'route:' || page_id, 'route', false from pages union select 'message:' || user_id, 'class', false from events),
n as (select n0.id, n0.kind, n0.test or coalesce(c.test, false) as test from n0 left join n0 c on c.id = split_part(n0.id, '::', 1)),
li as (select lineitem.*, method as source, case l_returnflag when 'N' then 1 when 'A' then 2 else 3 end as rank, l_quantity > 40 as twice from lineitem join m on m.k = l_orderkey),
e0 as (select class as source, 'has_method' as relation, method as target, 1 as rank, false as twice from m union all select class, 'has_method', method, 1, false from p
  union all select 'C' || c_custkey, 'extends', 'C' || c_custkey // 3, 1, false from customer where c_custkey % 4 = 1 and c_custkey > 1
  union all select 'C' || c_custkey, 'implements', 'I' || c_custkey % 20, 1, false from customer where c_custkey % 3 = 0
  union all select source, 'calls', m.method, rank, twice from li join m on m.k = l_partkey * 7 + l_suppkey where l_linenumber = 1
  union all select source, 'calls', 'I' || l_partkey % 20 || '::p' || l_partkey, rank, twice from li where l_linenumber = 2 and l_partkey % 3 = 0
  union all select source, 'overrides', 'I' || l_partkey % 20 || '::p' || l_partkey, rank, twice from li where l_linenumber = 3 and l_orderkey % 7 = 3
  union all select source, 'reads_state_of', m.method, rank, twice from li join m on m.k = l_partkey * 3 where l_linenumber = 4 and l_orderkey % 5 = 0
  union all select source, 'instantiates', 'C' || l_suppkey, rank, twice from li where l_linenumber = 5 and l_orderkey % 3 = 0
  union all select 'route:' || page_id, 'handled_by', m.method, 1, false from pages join m on m.k = page_id * 3 union all select 'route:' || page_id, 'references', 'C' || page_id % 97, 1, false from pages
  union all select m.method, 'dispatches', 'message:' || user_id, 1, false from events join m on m.k = event_id where event_id % 2 = 0
  union all select 'message:' || user_id, 'handled_by', m.method, 1, false from (select distinct user_id from events) join m on m.k = user_id * 2),
e as (select source, relation, target, rank, twice from e0 where source <> target qualify row_number() over (partition by source, relation, target order by rank, twice) = 1),
up(start, id) as (select source, target from e where relation in ('extends', 'implements') union select up.start, e.target from up join e on e.source = up.id where relation in ('extends', 'implements')),
built(class, id) as (select distinct source, source from e where relation = 'has_method' and target like '%::__construct' union select built.class, e.source from built join e on e.target = built.id and e.relation = 'extends' where e.source not in (select source from e where relation = 'has_method' and target like '%::__construct')),
over(id, parent) as (select source, target from e where relation = 'overrides' union select over.id, e.target from over join e on e.source = over.parent where relation = 'overrides'),
s0 as (select target as id, source as dependent, relation, rank, relation <> 'receives' as followed, null::varchar as through, twice from e where relation in ('calls', 'references', 'instantiates', 'extends', 'implements', 'overrides', 'dispatches', 'reads_state_of')
  union select source, target, relation, rank, true, null, twice from e where relation = 'handled_by' and source not like 'route:%' union select target, source, relation, rank, false, null, twice from e where relation = 'handled_by' and source like 'route:%'
  union select h.target, s.source, 'dispatches', greatest(h.rank, s.rank), true, null, s.twice from e h join e s on s.target = h.source and s.relation = 'dispatches' where h.relation = 'handled_by' and h.source not like 'route:%'
  union select n.id, e.source, relation, rank, false, null, twice from e join n on split_part(n.id, '::', 1) = e.target and n.id like '%::%' where relation = 'references' and source like 'route:%'
  union select class || '::__construct', e.source, relation, rank, true, null, twice from e join built on built.id = e.target where relation = 'instantiates'
  union select over.id, e.source, 'calls', 2, true, over.parent, e.twice from over join e on e.target = over.parent and e.relation = 'calls' join n on n.id = over.id where not n.test and over.id not like '%::__construct'),
s1 as (select s0.*, split_part(s0.id, '::', 1) as cls, split_part(dependent, '::', 1) as other, split_part(coalesce(through, ''), '::', 1) as face, n.kind = 'route' as route, n.test from s0 join n on n.id = s0.dependent),
steps as (select s1.*, f.id is not null as rival, a.id is not null as above from s1 left join up f on f.start = s1.other and f.id = s1.face left join up a on a.start = s1.cls and a.id = s1.other)"""


def _changed(spark: SparkSession, sf_dir: str, days: int = DAYS) -> DataFrame:
    """What changed: the methods of the orders of the last days."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = orders.agg(F.date_sub(F.max("day"), days).alias("since"))
    k = F.col("o_orderkey")
    method = F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.when(k % 19 == 0, "::__construct").otherwise(F.concat(F.lit("::m"), k.cast("string"))))
    return orders.join(F.broadcast(last), F.col("day") > F.col("since")).select(method.alias("start")).distinct()  # last: one row


def _steps(spark: SparkSession, sf_dir: str) -> impact.Steps:
    nodes, edges = code_graph(spark, sf_dir)
    return impact.dependents(nodes, materialize(edges, "code-edges"))


def _levels_sql() -> str:
    """The walk level by level, as the operator defines it."""
    out = [
        f"k0 as (select distinct method as start, method as id, split_part(method, '::', 1) as root, 0 as depth, 1 as rank, false as state, 0 as hops, true as followed, n.test, false as route from m join n on n.id = method where o_orderdate::date > (select max(o_orderdate)::date - {DAYS} from orders))",
        "l0 as (select * from k0)",
    ]
    for d in range(1, DEPTH + 1):
        out += [
            f"c{d} as (select l.start, l.root, s.dependent as id, l.state or relation = 'reads_state_of' as state, case when l.state and relation = 'calls' and twice then 2 else greatest(l.rank, s.rank) end as rank, l.hops + (l.state and other <> root)::int as hops, "
            f"other <> root and other <> cls and (above or u.id is not null) as inherited, s.followed, relation, l.id as parent, through, s.route, s.test from l{d - 1} l join steps s on s.id = l.id left join up u on u.start = root and u.id = other left join up b on b.start = other and b.id = root where not rival or other = root or b.id is not null)",
            f"f{d} as (select c.* replace (coalesce(k.rank, c.rank) as rank, c.followed and not inherited and not c.route as followed) from c{d} c left join k{d - 1} k using (start, id) where k.id is null or k.state and not c.state and c.followed and not inherited and not c.route)",
            f"r{d} as (select start, id, root, {d} as depth, rank, state, hops, followed, test, route from f{d} qualify row_number() over (partition by start, id order by state, rank, hops, followed desc, relation, parent, through is null, inherited) = 1)",
            f"g{d} as (select * from r{d} where followed and (not state or split_part(id, '::', 1) = root or hops < 2 and rank = 2))",
            f"w{d} as (select g.start, e.target as id, g.root, g.depth, g.rank, g.state, g.hops, g.followed, g.test, g.route from g{d} g join e on e.source = case when g.id like '%::__construct' then split_part(g.id, '::', 1) else g.id end and relation = 'has_method' join n0 on n0.id = e.source and kind in ('class', 'interface') "
            f"where e.target <> g.id and (g.start, e.target) not in (select (start, id) from k{d - 1}) and (g.start, e.target) not in (select (start, id) from r{d}) qualify row_number() over (partition by g.start, e.target order by g.state, g.rank, g.hops, g.id) = 1)",
            f"k{d} as (select * from k{d - 1} where (start, id) not in (select (start, id) from r{d}) union all select * from r{d} union all select * from w{d})",
            f"l{d} as (select * from (select * from r{d} union all select * from w{d}) where followed and (not state or split_part(id, '::', 1) = root or hops < 2 and rank = 2))",
        ]
    return ",\n".join(out)


@query(f"with recursive {_GRAPH} select id, dependent, relation, rank, followed, through, twice, rival, above, route, test from steps")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the code graph from a node to one that depends on it."""
    return _steps(spark, sf_dir).steps.select("id", "dependent", "relation", "rank", "followed", "through", "twice", "rival", "above", "route", "test")


@query(f"""with recursive {_GRAPH}, {_levels_sql()}
select start, class, depth, case rank when 1 then 'EXTRACTED' when 2 then 'INFERRED' else 'AMBIGUOUS' end as confidence, state as through_state, followed, test as is_test, id as node
from (select *, split_part(id, '::', 1) as class from k{DEPTH}) where not route and class <> root qualify row_number() over (partition by start, class order by state, depth, rank, id) = 1""")
def impact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that the changes of the last days reach within three steps."""
    return impact.impact_classes(impact.impact_walk(_steps(spark, sf_dir), _changed(spark, sf_dir), DEPTH))


@query(None)
def entry_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes that the changes of the last ten days reach within three steps and four rounds more."""
    graph = _steps(spark, sf_dir)
    return impact.entry_routes(graph, impact.entry_walk(graph, impact.impact_walk(graph, _changed(spark, sf_dir, 10), DEPTH), ROUNDS))


@query(None)
def impact_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each route the ways from its handler to the change: of the simple paths of at most 30 nodes the 40 shortest."""
    graph, serving = impact.toward_routes(_steps(spark, sf_dir))
    starts = _changed(spark, sf_dir, 10).join(serving.withColumnRenamed("id", "start"), "start", "left_semi")
    walk = impact.entry_walk(graph, impact.impact_walk(graph, starts, DEPTH), ROUNDS)
    routes = impact.entry_routes(graph, walk)
    found = impact.chains(walk, routes.select("start", "handler"), longest=30, most=40)
    return routes.join(found, ["start", "handler"]).select("start", "route", "handler", "confidence", "chain")


_NAMES = r"list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"


def _common_sql(a: str, b: str) -> str:
    return f"coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]), false) - 1, least(len({a}), len({b})))"


@query(f"""with p as (select distinct regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) as "group", array_to_string({_NAMES}, '.') as name from pages), r as (select *, string_split(name, '.') as parts from p),
e as (select "group", count(*) as n, min(parts) as a, max(parts) as b, min(list_reverse(parts)) as c, max(list_reverse(parts)) as d, min(len(parts)) as least from r group by 1),
f as (select "group", n, a, {_common_sql("a", "b")} as first, least({_common_sql("c", "d")}, least - {_common_sql("a", "b")}) as last from e),
m as (select "group", middle, min(name) as name from (select r."group", array_to_string(parts[first + 1:len(parts) - last], '.') as middle, name from r join f using ("group")) group by 1, 2)
select f."group" as host, case when n = 1 then array_to_string(a, '.') else array_to_string(list_concat(list_concat(a[1:first], ['{{' || (select string_agg(middle, ',' order by name) from m where m."group" = f."group") || '}}']), a[len(a) - last + 1:]), '.') end as pattern from f""")
def path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the paths of each host's pages have in common, written with dots."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1).alias("group"), F.array_join(path_segments(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)), ".").alias("name"))
    return patterns.common_patterns(pages).withColumnRenamed("group", "host")


@query(None)
def grouped_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as methods, `name(type)`: those of one type as one signature."""
    name = F.regexp_replace(F.initcap("p_name"), "[^A-Za-z]", "")
    return patterns.grouped_signatures(table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.concat(name, F.lit("("), "p_type", F.lit(")")).alias("signature"))).withColumnRenamed("group", "brand")


def _about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as classes about a market segment: (id, score, topic, half, words)."""
    customers = table(spark, sf_dir, "customer")
    on = F.col("c_mktsegment") == "BUILDING"
    return customers.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.when(on, 1.0).otherwise(0.0).alias("score"), on.alias("topic"), on.alias("half"), F.lit(1).alias("words"))


@query(None)
def module_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that work with the three richest customers of a segment, in rounds of admission."""
    nodes, edges = code_graph(spark, sf_dir)
    known = materialize(nodes.where(F.col("kind").isin("class", "interface") & ~F.coalesce(is_test_path(F.col("file")), F.lit(False)) & ~F.col("id").startswith("message:")).select("id", "kind"), "classes")
    rich = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_custkey % 10 <> 9").orderBy(F.desc("c_acctbal"), "c_custkey").limit(3)
    seeds = rich.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    return growth.grow_module(known, materialize(edges, "code-edges"), materialize(seeds, "seeds"), _about(spark, sf_dir))


@query(None)
def topic_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies around the parts that three words mean, within a budget of 60 nodes, and how far."""
    nodes, edges = code_graph(spark, sf_dir)
    known = materialize(nodes.select("id", "kind", F.coalesce(is_test_path(F.col("file")), F.lit(False)).alias("test")), "nodes")
    scores = relevance_scores(spark, sf_dir)
    method = F.concat(F.lit("I"), (F.col("id") % 20).cast("string"), F.lit("::p"), F.col("id").cast("string"))
    scores = materialize(scores.select(method.alias("id"), "score", F.col("score").alias("own")), "scores")
    seeds = materialize(scores.orderBy(F.desc("score"), "id").limit(6).select("id"), "seeds")
    return growth.expand_topic(known, materialize(edges, "code-edges"), seeds, scores, depth=3, budget=60, shown=seeds.select(F.substring_index("id", "::", 1).alias("id")))


@query("""with recursive c as (select c_custkey as k from customer),
b(class, k, depth, t, u) as (select k, k, 0, 'T', 'U' from c union all select class, k // 3, depth + 1, 'list<' || t || '>', case when k // 3 % 2 = 0 then u else 'U' end from b where k % 4 = 1 and k > 1),
i as (select class, 'I' || k % 20 as ancestor, depth + 1 as depth, t from b where k % 3 = 0 qualify row_number() over (partition by class, k % 20 order by depth) = 1)
select 'C' || class as class, 'C' || k as ancestor, depth, 'T' as template, t as argument from b where depth > 0 union all select 'C' || class, 'C' || k, depth, 'U', u from b where depth > 0 and k % 2 = 0 union all select 'C' || class, ancestor, depth, 'E', t from i""")
def template_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as generic classes: each extends one of a third of its number with a list of its own, and some implement an interface."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("C"), k.cast("string")).alias("class"))
    heirs = customers.where((k % 4 == 1) & (k > 1)).select("class", F.concat(F.lit("C"), F.expr("c_custkey div 3").cast("string")).alias("parent"))
    faces = customers.where(k % 3 == 0).select("class", F.concat(F.lit("I"), (k % 20).cast("string")).alias("parent"))

    def given(df: DataFrame, position: int, what: str) -> DataFrame:
        return df.select("class", *(["parent"] if "parent" in df.columns else []), F.lit(position).alias("position"), F.lit(what).alias("argument"))

    templates = given(customers, 0, "T").union(given(customers.where(k % 2 == 0), 1, "U")).union(given(faces.select(F.col("parent").alias("class")).distinct(), 0, "E")).withColumnRenamed("argument", "template")
    parents = heirs.select(F.col("class").alias("source"), F.lit("extends").alias("relation"), F.col("parent").alias("target")).union(faces.select("class", F.lit("implements"), "parent"))
    return generics.template_bindings(templates, parents, given(heirs, 0, "list<T>").union(given(heirs, 1, "U")).union(given(faces, 0, "T")))


CONE = 8


@query(f"""with recursive {_GRAPH}, app as (select id from n0 where id like 'C%' and kind = 'class' and not test),
r0 as (select source as x, target as y, rank = 3 as guess from e where relation = 'calls' union all select e.source, e.target || '::__construct', false from e where relation = 'instantiates' and e.target || '::__construct' in (select id from n0)
  union all select target, source, false from e where relation = 'overrides' and target in (select target from e where relation = 'overrides' group by 1 having count(*) <= 4)),
r as (select x, y, bool_and(guess) as guess from r0 where x <> y and y in (select id from n0) and split_part(y, '::', 1) in (select id from app) group by 1, 2),
b as (select id, count(distinct caller) as callers from (select target as id, split_part(source, '::', 1) as caller from e where relation = 'calls' union all select target || '::__construct', split_part(source, '::', 1) from e where relation = 'instantiates') where caller in (select id from app) group by 1),
w(id, depth) as (select * from (select source, 0 from e where relation = 'calls' group by source order by count(*) desc, source limit 1) union select r.y, depth + 1 from w join r on r.x = w.id where depth < {CONE} and (depth = 0 or w.id not in (select id from b where callers >= 20))),
cone as (select id, min(depth) as depth from w group by id),
s(id) as (select id from cone where depth = 0 union select r.y from s join r on r.x = s.id where not guess and r.y in (select id from cone) and s.id not in (select id from b where callers >= 20)),
f as (select cone.id, depth, coalesce(callers, 0) as callers from cone left join b using (id))
select id, depth, case when callers >= 20 and depth > 0 then 'hub' when id in (select id from s) then 'sure' else 'guessed' end as state, callers from f""")
def run_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the method with the most calls runs within eight steps, without bounds on methods or classes."""
    nodes, edges = code_graph(spark, sf_dir)
    edges = materialize(edges, "code-edges")
    busiest = edges.where("relation = 'calls'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    start = busiest.agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("start")).first().start  # one name
    every = 1 << 30
    return cones.run_cone(materialize(nodes, "nodes"), edges, start, CONE, methods=every, classes=every)


@query("""with recursive places as (select 'customer:' || c_custkey as source, 'nation:' || c_nationkey as target from customer union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation),
ends as (select 'customer:1' as a, 'supplier:' || min(s_suppkey) as z from supplier join nation s on s_nationkey = s.n_nationkey join customer on c_custkey = 1 join nation c on c_nationkey = c.n_nationkey where s.n_regionkey = c.n_regionkey and s_nationkey <> c_nationkey),
two_ways as (select source, target, true as forward from places union all select target, source, false from places),
w(id, path, hops) as (select a, [a], []::struct(source varchar, target varchar, forward boolean)[] from ends union all select target, list_append(path, target), list_append(hops, {'source': source, 'target': target, 'forward': forward}) from w join two_ways on source = w.id where not list_contains(path, target) and len(path) < 5)
select position::int as position, h.source, h.target, 'references' as relation, h.forward, 'undirected' as mode, false as reversed from (select unnest(hops) as h, unnest(range(1, len(hops) + 1)) as position from w, ends where id = z)""")
def path_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from a customer to the first supplier of another nation of its region: no dependency either way, so by both directions."""
    nations = table(spark, sf_dir, "nation")
    home = table(spark, sf_dir, "customer").where("c_custkey = 1").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", F.col("n_regionkey").alias("_region"))
    near = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(home), (F.col("n_regionkey") == F.col("_region")) & (F.col("s_nationkey") != F.col("c_nationkey")))  # home: one row
    end = near.agg(F.min("s_suppkey").alias("key")).first().key
    return traverse.path_ladder(trade_nodes(spark, sf_dir), place_edges(spark, sf_dir), "customer:1", f"supplier:{end}")
