"""Registered queries of the wiring operators, with their SQL oracles; facts come from the given tables by simple rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import resolve, rollup, traverse, wiring
from knotwork.plans.catalogue import _CLASSES, _PLACES, _customer_classes, query
from knotwork.session import table
from knotwork.sources import tables

_PATHS = "paths as (select page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as path from pages)"


def _numbered(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _normal(path: str) -> str:
    return f"'/' || trim(regexp_replace({path}, '/+', '/', 'g'), '/')"


@query(f"""with {_PATHS}, r as (select 'p' || page_id as request, path, 'host' as host, page_id % 3 <> 0 as literal, page_id % 5 = 0 as absolute,
  case page_id % 4 when 1 then 'https://Api.Example.com:8080/v' || (page_id % 2) || case when page_id % 8 = 1 then '/*' else '' end when 2 then '*config' when 3 then '//base/' end as base from paths)
select request, case when absolute or base is null or base = '*config' then path when base like 'https%' then {_normal("regexp_extract(base, '^https://[^/]*(.*)$', 1) || '/' || path")} else {_normal("base || '/' || path")} end as path,
  case when absolute or base is null then host when base like 'https%' then 'api.example.com' end as host,
  case when absolute or base is null then literal when base = '*config' then false when base like 'https%' then literal and not contains(base, '*') else literal end as literal from r""")
def request_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the calls on pages go, given their base urls."""
    n = F.col("page_id")
    base = F.when(n % 4 == 1, F.concat(_numbered("https://Api.Example.com:8080/v", n % 2), F.when(n % 8 == 1, "/*").otherwise(""))).when(n % 4 == 2, "*config").when(n % 4 == 3, "//base/")
    rows = tables.page_paths(spark, sf_dir).select(_numbered("p", n).alias("request"), "path", F.lit("host").alias("host"), (n % 3 != 0).alias("literal"), (n % 5 == 0).alias("absolute"), base.alias("base"))
    return wiring.request_targets(rows)


@query(f"""with {_PATHS}, r as (select 'p' || page_id as route, 'service' || page_id % 3 as service, case when page_id % 5 > 0 then 'l' || page_id % 5 end as loader, path from paths),
x as (select distinct case when n_regionkey < 4 then 'service' || n_regionkey % 2 end as service, 'l' || n_nationkey % 4 as loader, '/' || lower(n_name) as prefix from nation),
o as (select r.*, x.prefix from r left join x on x.service = r.service and x.loader = r.loader),
b as (select o.route, o.path, coalesce(o.prefix, y.prefix) as prefix from o left join x y on o.prefix is null and y.service is null and y.loader = o.loader)
select route, case when prefix is null then path else {_normal("prefix || '/' || path")} end as path from b""")
def prefixed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes under the prefixes of their loaders."""
    n, k = F.col("page_id"), F.col("n_nationkey")
    routes = tables.page_paths(spark, sf_dir).select(_numbered("p", n).alias("route"), _numbered("service", n % 3).alias("service"), F.when(n % 5 > 0, _numbered("l", n % 5)).alias("loader"), "path")
    prefixes = table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") < 4, _numbered("service", F.col("n_regionkey") % 2)).alias("service"), _numbered("l", k % 4).alias("loader"), F.concat(F.lit("/"), F.lower("n_name")).alias("prefix"))
    return wiring.with_loader_prefixes(routes, prefixes)


@query("""with r as (select 'o' || o_orderkey as route, 'customer' || o_custkey as service, o_totalprice > 200000 as described from orders)
select service, count(distinct route) as routes from r where service in (select service from r where described) and not described group by service""")
def undocumented_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routes of their customers, which a schema describes where they are dear."""
    rows = table(spark, sf_dir, "orders").select(_numbered("o", F.col("o_orderkey")).alias("route"), _numbered("customer", F.col("o_custkey")).alias("service"), F.col("o_totalprice"))
    return wiring.undocumented(rows.select("route", "service"), rows.where("o_totalprice > 200000").select("route"))


@query(rf"""with {_PATHS}, s as (select page_id, list_filter(string_split(path, '/'), lambda x: x <> '') as ps from paths),
o as (select distinct case when page_id % 3 = 0 then 'get' else 'post' end as m, case when page_id % 2 = 0 and len(ps) > 1 then list_concat(ps[:-2], ['{{id}}']) else ps end as ps from s where page_id % 4 = 0),
n as (select m || ' ' || array_to_string(ps, '/') as operation, m, ps from o),
q as (select 'p' || page_id as request, case when page_id % 5 > 0 then 'get' end as m, page_id % 7 > 0 as literal, ps from s where page_id % 3 > 0),
f as (select distinct request, literal, operation from q join n on len(q.ps) = len(n.ps) and (q.m is null or q.m = n.m) and len(list_filter(list_zip(q.ps, n.ps), lambda x: x[1] <> x[2] and not regexp_matches(x[2], '^\{{.*\}}$'))) = 0),
k as (select *, row_number() over (partition by request order by operation) as nth, count(*) over (partition by request) as fits from f)
select request, operation, case when literal and fits = 1 then 'INFERRED' else 'AMBIGUOUS' end as confidence from k where nth <= 5""")
def described_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as operations of schemas, some with a placeholder, and as calls, of which some reach a route already."""
    rows = tables.page_paths(spark, sf_dir).withColumn("ps", F.filter(F.split("path", "/"), lambda s: s != ""))
    n, size = F.col("page_id"), F.size("ps")
    own = F.when((n % 2 == 0) & (size > 1), F.concat(F.slice("ps", F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(F.lit("{id}")))).otherwise(F.col("ps"))
    operations = rows.where(n % 4 == 0).select(F.when(n % 3 == 0, "get").otherwise("post").alias("method"), F.array_join(own, "/").alias("path")).distinct()
    operations = operations.select(F.concat_ws(" ", "method", "path").alias("operation"), "method", "path")
    requests = rows.select(_numbered("p", n).alias("request"), F.when(n % 5 > 0, "get").alias("method"), "path", (n % 7 > 0).alias("literal"), n)
    return wiring.match_described(operations, requests.drop("page_id"), requests.where(n % 3 == 0).select("request"))


_EVENTS = """f as (select event_type || '@' || strftime(ts, '%Y-%m-%d %H') as message, 'user:' || user_id as who, 'service' || user_id % 5 as service, event_id % 2 as odd, event_id from events)"""


@query(f"""with {_EVENTS}, b as (select message from f where odd = 0 intersect select message from f where odd = 1)
select distinct who as source, message as target, 'dispatches' as relation from f join b using (message) where odd = 0 union select message, who, 'handled_by' from f join b using (message) where odd = 1""")
def channel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as nodes between those that send and handle them."""
    return wiring.channel_edges(*tables.event_facts(spark, sf_dir))


@query(f"""with {_EVENTS}, s as (select case when who not like '%7' then message end as message, service from f where odd = 0), h as (select message, service from f where odd = 1),
a as (select message, list(distinct service) as sv from s where message is not null group by 1), b as (select message, list(distinct service) as hv from h group by 1)
select (select count(*) from b) as handled, (select count(*) from a) as sent, (select count(*) from a where message not in (select message from b)) as unhandled, (select count(*) from b where message not in (select message from a)) as never_sent,
  (select count(*) from a join b using (message) where len(list_distinct(list_concat(sv, hv))) > 1) as contracts, (select count(*) from s where message is null) as untyped""")
def bus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over sends and handlers; sends of some users have no type."""
    sends, handlers = tables.event_facts(spark, sf_dir)
    return wiring.bus_statistics(sends.withColumn("message", F.when(~F.col("sender").endswith("7"), F.col("message"))), handlers)


@query(f"""with {_EVENTS}, c as (select 'user:' || (user_id + 1) as source, 'user:' || user_id as target, case when event_id % 3 > 0 then event_type end as message from events where event_id % 2 = 1)
select message, who as sender from f where odd = 0 union select message, source from c where message is not null and target in (select who from f where odd = 0 and who like '%3')""")
def forwarded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose number ends with 3 pass on what the next user gives them."""
    sends, _ = tables.event_facts(spark, sf_dir)
    n = F.col("user_id")
    calls = table(spark, sf_dir, "events").where("event_id % 2 = 1").select(_numbered("user:", n + 1).alias("source"), _numbered("user:", n).alias("target"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("message"))
    return wiring.forwarded(sends, sends.where(F.col("sender").endswith("3")).select(F.col("sender").alias("method")).distinct(), calls)


@query(f"""with recursive {_PLACES.strip()}, up(id, top) as (select source, target from places union select up.id, places.target from up join places on places.source = up.top)
select top as head, count(distinct id) as members from up group by top having count(distinct id) >= 2 order by members desc, head limit 8""")
def largest_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places with most places and people below them."""
    return wiring.largest_families(tables.place_edges(spark, sf_dir), ("references",))


@query(f"""with recursive {_PLACES.strip()}, up(id, depth) as (select 'customer:7', 0 union select places.target, depth + 1 from up join places on places.source = up.id),
calls as (select 'order:' || o_orderkey as caller, 'customer:' || o_custkey as method from orders union select source, target from places where source like 'supplier%' or source like 'nation%')
select distinct caller, method, depth from calls join up on method = id""")
def callers_through_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls customer 7 or the places above: orders, and for places suppliers and nations."""
    places = tables.place_edges(spark, sf_dir).select("source", "relation", "target")
    up = places.withColumn("relation", F.lit("overrides"))
    calls = table(spark, sf_dir, "orders").select(tables.node_id("order", "o_orderkey").alias("source"), F.lit("calls").alias("relation"), tables.node_id("customer", "o_custkey").alias("target"))
    calls = calls.union(places.where("source like 'supplier%' or source like 'nation%'").withColumn("relation", F.lit("calls")).select("source", "relation", "target"))
    return wiring.callers_through_parents(up.union(calls), "customer:7")


@query("""with recursive e as (select 'part:' || p_partkey as source, 'part:' || p_partkey // 2 as target from part where p_partkey > 1), d as (select 'part:' || p_partkey as class from part where p_size > 40),
down(class) as (select 'part:1' union select e.source from down join e on e.target = down.class where e.source not in (select class from d))
select distinct 'order:' || l_orderkey as source, class from down join lineitem on class = 'part:' || l_partkey""")
def inherited_instantiations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts extend the part of half their number; those of a size over 40 have a constructor of their own; orders make parts."""
    part = table(spark, sf_dir, "part")
    extends = part.where("p_partkey > 1").select(tables.node_id("part", "p_partkey").alias("source"), F.lit("extends").alias("relation"), _numbered("part:", F.expr("p_partkey div 2")).alias("target"))
    made = table(spark, sf_dir, "lineitem").select(tables.node_id("order", "l_orderkey").alias("source"), F.lit("instantiates").alias("relation"), tables.node_id("part", "l_partkey").alias("target"))
    return wiring.instantiations(extends.union(made), part.where("p_size > 40").select(tables.node_id("part", "p_partkey").alias("class")), "part:1")


@query("""with recursive e as (select p_partkey as s, p_partkey // 2 as t, case when p_partkey % 3 = 0 then 1 else 0 end as way from part where p_partkey > 1),
m as (select p_partkey as id, p_type as name, p_brand as type from part where p_size > 10), up(start, id, depth) as (select p_partkey, p_partkey, 0 from part union all select start, e.t, depth + 1 from up join e on e.s = up.id),
r as (select start, name, type, depth, row_number() over (partition by start, name order by depth, m.id) as nth from up join m on m.id = up.id)
select 'part:' || start as class, name, type, depth from r where nth = 1""")
def inherited_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts have a property named after their type, and inherit those of the part of half their number, extended or used as a trait."""
    part = table(spark, sf_dir, "part")
    relation = F.when(F.col("p_partkey") % 3 == 0, "uses_trait").otherwise("extends")
    edges = part.where("p_partkey > 1").select(tables.node_id("part", "p_partkey").alias("source"), relation.alias("relation"), _numbered("part:", F.expr("p_partkey div 2")).alias("target"))
    members = part.where("p_size > 10").select(tables.node_id("part", "p_partkey").alias("class"), F.col("p_type").alias("name"), F.col("p_brand").alias("type"))
    return wiring.found_members(members, edges)


@query("""with t as (select distinct unnest(string_split(lower(p_name), ' ')) as term from part), n as (select lower(p_name) as label from part)
select term, count(*) as classes from t join n on ends_with(label, term) where term <> '' group by term having count(*) >= 20""")
def common_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that many names of parts end with."""
    part = table(spark, sf_dir, "part")
    terms = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).where("term <> ''")
    return wiring.common_endings(part.select(F.col("p_name").alias("label")), terms)


@query(r"""with n as (select distinct n_name || '\' || c_mktsegment || '\' || case when c_custkey % 2 = 0 then 'Model\' else '' end || 'Customer' || c_custkey % 40 as id from customer join nation on c_nationkey = n_nationkey),
p as (select id, string_split(id, '\') as ps from n), x as (select id, k as n, array_to_string(ps[len(ps) - k + 1:], '\') as shown from p, unnest(range(2, len(ps) + 1)) u(k)),
s as (select shown, count(*) as c, min(id) as id, min(n) as n from x group by shown), b as (select id, arg_min(shown, n) as shown from s where c = 1 group by id)
select id, coalesce(shown, id) as shown from n left join b using (id)""")
def distinct_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as classes, of which many share a short name."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: a fixed few
    short = _numbered("Customer", F.col("c_custkey") % 40)
    return wiring.distinct_suffixes(rows.select(F.concat_ws("\\", "n_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "Model"), short).alias("id")))


@query(r"""with w as (select distinct unnest(string_split(p_name, ' ')) as word from part union select 'user-' || lower(n_name) || 'es' from nation union select lower(r_name) || 'ies' from region), b as (select word, replace(word, '-', '_') as x from w)
select word, case when ends_with(x, 'ies') then left(x, -3) || 'y' when regexp_matches(x, '(ss|x|ch|sh)es$') then left(x, -2) when ends_with(x, 's') and not ends_with(x, 'ss') then left(x, -1) else x end as one from b""")
def singular_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names in the singular."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    names = names.union(table(spark, sf_dir, "nation").select(F.concat(F.lit("user-"), F.lower("n_name"), F.lit("es")))).union(table(spark, sf_dir, "region").select(F.concat(F.lower("r_name"), F.lit("ies")))).distinct()
    return names.select("word", wiring.singular(F.col("word")).alias("one"))


@query("""with f as (select case p_partkey % 5 when 0 then 'tests/Unit/' || p_brand || '/T' when 1 then 'Tests/' || p_brand || '/T' when 2 then 'src/' || p_brand || '/spec/x/T' when 3 then 'lib/' || p_brand || '/T' else 'T' end || p_partkey || '.php' as path,
  case p_partkey % 5 when 0 then 'tests/Unit/' || p_brand when 1 then 'Tests/' || p_brand when 2 then 'src/' || p_brand when 3 then 'lib/' || p_brand else '.' end as module from part)
select module, count(distinct path) as files from f group by module""")
def tests_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as test files of their brands."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    lead = F.when(k % 5 == 0, F.concat(F.lit("tests/Unit/"), brand, F.lit("/T"))).when(k % 5 == 1, F.concat(F.lit("Tests/"), brand, F.lit("/T"))).when(k % 5 == 2, F.concat(F.lit("src/"), brand, F.lit("/spec/x/T")))
    lead = lead.when(k % 5 == 3, F.concat(F.lit("lib/"), brand, F.lit("/T"))).otherwise("T")
    return wiring.tests_by_module(table(spark, sf_dir, "part").select(F.concat(lead, k.cast("string"), F.lit(".php")).alias("path")))


_ROLES = r"""c as (select distinct source as id, from_role as role, from_explicit as explicit, from_segment as segment, from_place as place from deps union select target, to_role, to_explicit, to_segment, to_place from deps)"""


@query(f"with {_CLASSES.strip()}, {_ROLES} select id, role from c")
def rule_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer that rules see of each class."""
    edges = tables.class_edges(spark, sf_dir)
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return ids.select("id", rollup.rule_role(F.col("id")).alias("role"))


@query(f"with {_CLASSES.strip()}, {_ROLES} select count(distinct place) as before, 0::bigint as after, false as layer_first from c where explicit and role = 'domain'")
def layer_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the classes put the layer before the context."""
    edges = tables.class_edges(spark, sf_dir)
    return wiring.is_layer_first(edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct())


_LOOKUP = """segments as (select distinct c_mktsegment as segment, len(c_mktsegment) as size, len(c_mktsegment) % 5 as r from customer),
lookups as (select 'customer:' || c_custkey as class, 'nation:' || c_nationkey as nation, 'region:' || n_regionkey as region, 'segment:' || c_mktsegment as segment, 'region:' || s.r as other, c_nationkey % 5 = 0 as mixed from customer join nation on c_nationkey = n_nationkey join segments s on s.segment = c_mktsegment),
declared as (select 'nation:' || n_nationkey as class, 'm' || n_nationkey % 4 as name, true as project from nation union all select 'region:' || r_regionkey, 'm' || (r_regionkey % 3 + 2), r_regionkey % 2 = 0 from region
  union all select 'segment:' || segment, 'm' || (size % 3 + 3), true from segments union all select 'helper', unnest(['m5', 'm9']), true)"""


def _lookup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """methods, edges and mixins: customers extend nations, which extend regions, and implement segments, which extend regions."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    size = F.length("c_mktsegment")
    segments = customer.select(F.concat(F.lit("segment:"), "c_mktsegment").alias("class"), size.alias("size")).distinct()
    methods = nation.select(tables.node_id("nation", "n_nationkey").alias("class"), _numbered("m", F.col("n_nationkey") % 4).alias("name"), F.lit(True).alias("project"))
    methods = methods.union(region.select(tables.node_id("region", "r_regionkey"), _numbered("m", F.col("r_regionkey") % 3 + 2), F.col("r_regionkey") % 2 == 0))
    methods = methods.union(segments.select("class", _numbered("m", F.col("size") % 3 + 3), F.lit(True)))
    methods = methods.union(region.where("r_regionkey = 0").select(F.lit("helper"), F.explode(F.array(F.lit("m5"), F.lit("m9"))), F.lit(True)))
    extends, implements = F.lit("extends").alias("relation"), F.lit("implements").alias("relation")
    edges = customer.select(tables.node_id("customer", "c_custkey").alias("source"), extends, tables.node_id("nation", "c_nationkey").alias("target"))
    edges = edges.union(nation.select(tables.node_id("nation", "n_nationkey"), extends, tables.node_id("region", "n_regionkey")))
    edges = edges.union(customer.select(tables.node_id("customer", "c_custkey"), implements, F.concat(F.lit("segment:"), "c_mktsegment")))
    edges = edges.union(segments.select("class", extends, _numbered("region:", F.col("size") % 5)))
    mixins = nation.where("n_nationkey % 5 = 0").select(tables.node_id("nation", "n_nationkey").alias("class"), F.lit("helper").alias("mixin"))
    return methods.withColumn("method", F.concat_ws("::", "class", "name")), edges, mixins


@query(f"""with {_LOOKUP}, ways as (select class, nation as up, 1 as turn, mixed from lookups union all select class, region, 2, mixed from lookups union all select class, segment, 3, mixed from lookups union all select class, other, 4, mixed from lookups union all select class, 'helper', 9, mixed from lookups where mixed)
select w.class, d.name, arg_min(d.class || '::' || d.name, case when turn = 9 then 100 when project then turn else 10 + turn end) as method from ways w join declared d on d.class = w.up group by all""")
def method_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declaration of each method that customers have: depth first, what the project declares first, mixins last."""
    methods, edges, mixins = _lookup(spark, sf_dir)
    return resolve.find_methods(methods, edges, mixins).where("class like 'customer:%'").select("class", "name", "method")


@query(f"""with {_LOOKUP}, ways as (select class, nation as up, '1' || nation as way from lookups union all select class, region, '1' || nation || ' 1' || region from lookups union all select class, segment, '2' || segment from lookups union all select class, other, '2' || segment || ' 1' || other from lookups)
select class, up as ancestor, min(way) as way from ways group by all""")
def ranked_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors of customers, with the way by which a depth-first search first meets each."""
    _, edges, _ = _lookup(spark, sf_dir)
    found = traverse.ranked_lineage(edges, ("extends", "implements", "uses_trait")).where("start like 'customer:%' and size(path) > 0")
    way = F.array_join(F.transform("path", lambda s: F.concat(s["rank"].cast("string"), s["to"])), " ")
    return found.select(F.col("start").alias("class"), F.col("id").alias("ancestor"), way.alias("way"))


@query(r"""with c as (select c_custkey as k, c_mktsegment as m, r_name || '\' || n_name || '\' || ['Domain', 'UseCases', 'Model', 'Billing'][c_custkey % 4 + 1] || '\Customer' || c_custkey as id, ['Domain', 'UseCases', 'Model', 'Billing'][c_custkey % 4 + 1] as s from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select 'contract' as rule, id, 'does not implement Contracts\Payable' as reason from c where s = 'Billing' and k % 3 = 0
union all select distinct 'contract', id, 'has the public method m' || o_orderkey % 4 || '()' from c join orders on o_custkey = k where s = 'Billing' and o_orderkey % 2 = 0 and o_orderkey % 4 <> 0
union all select 'clock', id, 'does not use Shared\Clock' from c where s = 'Model' and k % 5 <> 0 and k % 10 <> 2
union all select 'clock', id, 'is final' from c where s = 'Model' and m = 'BUILDING' and k % 10 <> 2
union all select 'base', id, 'does not extend Contracts\Payable' from c where s = 'UseCases' and m = 'MACHINERY' and k % 3 = 0""")
def structure_rule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on interfaces, parents, traits and public methods over customers as classes."""
    classes = _customer_classes(spark, sf_dir)
    k = F.col("c_custkey")
    classes = classes.withColumns({"modifiers": F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("final"))).otherwise(F.array().cast("array<string>")), "kind": F.col("c_mktsegment")})
    edges = classes.where(k % 3 != 0).select(F.col("id").alias("source"), F.lit("implements").alias("relation"), F.lit("Contracts\\Invoice").alias("target"))
    edges = edges.union(classes.where(k % 5 == 0).select("id", F.lit("uses_trait"), F.lit("Shared\\Clock")))
    edges = edges.union(edges.where("relation = 'implements'").select("target", F.lit("extends"), F.lit("contracts\\payable")).distinct())
    lineage = traverse.closure(edges, ("extends", "implements", "uses_trait")).where("depth > 0").select(F.col("start").alias("id"), F.col("id").alias("ancestor"))
    owned = table(spark, sf_dir, "orders").join(classes.select("id", "c_custkey"), F.col("o_custkey") == k)
    modifiers = F.when(F.col("o_orderkey") % 2 == 1, F.array(F.lit("private"))).otherwise(F.array().cast("array<string>"))
    methods = owned.select("id", _numbered("m", F.col("o_orderkey") % 4).alias("method"), modifiers.alias("modifiers"))
    rules = [
        rollup.StructureRule("contract", "**\\Billing\\*", implements=("\\Contracts\\Payable",), public=("M0",)),
        rollup.StructureRule("clock", "**\\Model\\*", uses=("Shared\\Clock",), without="final", beside="**2"),
        rollup.StructureRule("base", "**\\UseCases\\*", extends=("Contracts\\Payable",), kind="MACHINERY"),
    ]
    return rollup.structure_breaches(classes, rules, lineage, methods)
