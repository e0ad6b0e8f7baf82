"""The registered queries of the graph engine and their SQL oracles.

Each query runs an operator of the library over whole tables, through the adapters of knotwork.sources.tables. The SQL
says the same by plain joins, aggregates and recursive expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.words import is_test_path, path_segments, stems
from knotwork.operators import graph, relevance, resolve, rollup, traverse
from knotwork.session import table
from knotwork.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_RANK = "case confidence when 'EXTRACTED' then 1 when 'INFERRED' then 2 else 3 end"
_FLAG = "case l_returnflag when 'N' then 'EXTRACTED' when 'A' then 'INFERRED' else 'AMBIGUOUS' end"
_PLACES = """
places as (
  select 'customer:' || c_custkey as source, 'references' as relation, 'nation:' || c_nationkey as target, 'EXTRACTED' as confidence from customer
  union all select 'supplier:' || s_suppkey, 'references', 'nation:' || s_nationkey, 'EXTRACTED' from supplier
  union all select 'nation:' || n_nationkey, 'references', 'region:' || n_regionkey, 'EXTRACTED' from nation)"""
_TRADE = f"""
lines as (select *, {_FLAG} as confidence, l_linenumber * 10 + case l_returnflag when 'N' then 1 when 'A' then 2 else 3 end as seq from lineitem),
facts as (
  select 'order:' || l_orderkey as source, 'calls' as relation, 'part:' || l_partkey as target, confidence, l_linenumber as line, seq from lines
  union all select 'part:' || l_partkey, 'receives', 'supplier:' || l_suppkey, confidence, l_linenumber, seq from lines
  union all select 'order:' || o_orderkey, 'references', 'customer:' || o_custkey, 'EXTRACTED', null, 0 from orders
  union all select source, relation, target, confidence, null, 0 from places),
edges as (
  select source, relation, target, arg_min(confidence, seq) as confidence, coalesce(array_to_string(list_sort(list(distinct line) filter (line <> 0)), ','), '') as lines
  from facts where source <> target group by all)"""
_NODES = """
nodes as (
  select 'region:' || r_regionkey as id, r_name as label, 'interface' as kind from region
  union all select 'nation:' || n_nationkey, n_name, 'trait' from nation
  union all select 'customer:' || c_custkey, c_name, 'class' from customer
  union all select 'supplier:' || s_suppkey, s_name, 'enum' from supplier
  union all select 'part:' || p_partkey, p_name, 'method' from part
  union all select 'order:' || o_orderkey, o_orderpriority, 'function' from orders)"""
_DEGREES = """
degrees as (select id, count(*) as degree from (select source as id from edges union all select target from edges) group by id)"""
_CLASSES = r"""
spots as (select n_nationkey, r_name || '\' || n_name as place from nation join region on n_regionkey = r_regionkey),
customers as (select c_custkey, place, ['Domain', 'UseCases', 'Model', 'Billing'][c_custkey % 4 + 1] as segment, ['domain', 'application', 'domain', null][c_custkey % 4 + 1] as role, c_custkey % 4 < 2 as explicit from customer join spots on c_nationkey = n_nationkey),
suppliers as (select s_suppkey, place, ['Infra', 'Http', 'Domain', 'Port', 'Shipping'][s_suppkey % 5 + 1] as segment, ['infrastructure', 'interface', 'domain', 'port', null][s_suppkey % 5 + 1] as role, s_suppkey % 5 in (0, 2, 3) as explicit from supplier join spots on s_nationkey = n_nationkey),
deps as (
  select c.place || '\' || c.segment || '\Customer' || c_custkey as source, s.place || '\' || s.segment || '\Supplier' || s_suppkey as target,
    c.place as from_place, s.place as to_place, c.segment as from_segment, s.segment as to_segment, c.role as from_role, s.role as to_role, c.explicit as from_explicit, s.explicit as to_explicit, """ + _FLAG + r""" as confidence
  from lineitem join orders on l_orderkey = o_orderkey join customers c on o_custkey = c_custkey join suppliers s on l_suppkey = s_suppkey)"""


def _query(sql: str | None) -> Callable:
    def keep(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


#: For other modules that register queries.
query = _query


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_edges(tables.trade_edges(spark, sf_dir))


@_query(f"with {_PLACES.strip()}, {_TRADE} select source, relation, target, confidence, lines from edges")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph's edges, merged."""
    return _trade(spark, sf_dir).select("source", "relation", "target", "confidence", F.array_join("lines", ",").alias("lines"))


@_query(f"with {_NODES} select kind, count(*) as nodes from nodes group by kind")
def node_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trade_nodes(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


@_query(f"with {_PLACES.strip()}, {_TRADE}, {_DEGREES} select id, degree from degrees")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_trade(spark, sf_dir))


@_query(f"with {_PLACES.strip()}, {_TRADE}, {_DEGREES}, {_NODES} select id, label, kind, degree from nodes join degrees using (id) where kind not in ('interface', 'trait') order by degree desc, id limit 15")
def degree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs, without the places that everything refers to."""
    return graph.hubs(tables.trade_nodes(spark, sf_dir), _trade(spark, sf_dir), 15, without=("interface", "trait")).select("id", "label", "kind", "degree")


@_query(f"""with {_PLACES.strip()}, {_TRADE}, {_DEGREES}, {_NODES}
select id, label, kind, tier, coalesce(degree, 0) as degree from (
  select *, case when id = 'nation:1' then 0 when lower(label) = 'nation:1' then 1 when lower(id) = 'nation:1' then 2 when contains(lower(label), 'nation:1') then 3 when contains(lower(id), 'nation:1') then 4 end as tier from nodes) left join degrees using (id)
where tier is not null order by tier, degree desc, id limit 8""")
def candidates_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the name `nation:1` may mean."""
    return graph.candidates(tables.trade_nodes(spark, sf_dir), _trade(spark, sf_dir), "nation:1", 8)


@_query(f"""with {_PLACES.strip()}, {_TRADE}
select true as forward, relation, target as other, confidence from edges where source = 'nation:3' union all select false, relation, source, confidence from edges where target = 'nation:3'""")
def neighbours_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connections(_trade(spark, sf_dir), "nation:3")


@_query(f"""with recursive {_PLACES.strip()}, {_TRADE}, steps as (select source, target, min({_RANK}) as r from edges group by all),
l1 as (select source as id, min(r) as r from steps where target = 'supplier:1' group by 1),
l2 as (select s.source as id, min(greatest(l1.r, s.r)) as r from l1 join steps s on s.target = l1.id where s.source not in (select id from l1) and s.source <> 'supplier:1' group by 1)
select 'supplier:1' as id, 0 as depth, 1 as rank union all select id, 1, r from l1 union all select id, 2, r from l2""")
def impact_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a change of one supplier reaches, with depth and confidence."""
    starts = spark.createDataFrame([("supplier:1",)], "start string")
    return traverse.reach(_trade(spark, sf_dir), starts).select("id", "depth", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse reachability over the trade graph."""
    return impact_confidence(spark, sf_dir)


@_query(f"""with {_PLACES.strip()}, up as (
  select source as start, target as id, 1 as depth from places union all
  select a.source, b.target, 2 from places a join places b on a.target = b.source)
select id, count(*) as descendants, max(depth) as depth from up group by id""")
def closure_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places, customers and suppliers lie below each place."""
    above = traverse.closure(tables.place_edges(spark, sf_dir), ("references",)).where("depth > 0")
    return above.groupBy("id").agg(F.count(F.lit(1)).alias("descendants"), F.max("depth").alias("depth"))


@_query("""with below as (select s_nationkey as n, count(*) as c from supplier group by 1), wide as (select n_regionkey as r, sum(c) as c from below join nation on n = n_nationkey group by 1)
select 'supplier:' || s_suppkey as id, case when b.c >= 5 then 'nation:' || s_nationkey else 'region:' || n_regionkey end as head, case when b.c >= 5 then 1 else 2 end as depth
from supplier join below b on s_nationkey = b.n join nation on s_nationkey = n_nationkey join wide w on w.r = n_regionkey where b.c >= 5 or w.c >= 5""")
def family_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place of five suppliers or more, of each supplier."""
    members = table(spark, sf_dir, "supplier").select(tables.node_id("supplier", "s_suppkey").alias("id"))
    return traverse.family_heads(tables.place_edges(spark, sf_dir), ("references",), members, 5)


def _tree_paths(mode: str) -> str:
    back = "" if mode == "dependency" else "union all select target, source from places"
    return f"""with recursive {_PLACES.strip()}, steps as (select source as a, target as b from places {back}),
walk(id, hops) as (select 'customer:1', 0 union all select b, hops + 1 from walk join steps on a = id where hops < 4)
select id, min(hops)::int as hops from walk group by id"""


@_query(_tree_paths("dependency"))
def shortest_path_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.shortest_paths(tables.place_edges(spark, sf_dir), "customer:1").select("id", "hops")


@_query(_tree_paths("undirected") + " having min(hops) <= 4")
def shortest_path_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.shortest_paths(tables.place_edges(spark, sf_dir), "customer:1", mode="undirected", max_depth=4).select("id", "hops")


@_query(f"""with {_PLACES.strip()}, up1 as (select source as id from places where target = 'nation:3'), down as (select distinct target as id from places where source = 'nation:3')
select 'nation:3' as id, 0 as hops union all select id, 1 from up1 union all select id, 1 from down""")
def up_then_down_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs together with a nation by going up and then down, never down and up."""
    return traverse.up_then_down(tables.place_edges(spark, sf_dir), "nation:3")


@_query(f"""with {_PLACES.strip()}, {_TRADE}, kept as (select distinct source, target from edges where relation in ('calls', 'receives')),
hubs as (select target as id from kept group by 1 having count(*) >= 40),
l1 as (select target as id from kept where source = 'order:7'),
l2 as (select distinct target as id from kept where source in (select id from l1) and source not in (select id from hubs)),
cone as (select 'order:7' as id, 0 as depth union all select id, 1 from l1 union all select id, 2 from l2 where id not in (select id from l1))
select id, depth, id in (select id from hubs) as is_hub from cone""")
def cone_with_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts and suppliers behind an order; parts of 40 orders or more are not followed."""
    return traverse.method_cone(_trade(spark, sf_dir), "order:7", hub=40)


@_query(f"with {_PLACES.strip()}, {_TRADE} select target as id, count(distinct source) as callers from edges where relation in ('calls', 'instantiates') group by 1")
def caller_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.caller_counts(_trade(spark, sf_dir))


@_query("select distinct 'part:' || l_partkey as id, 'external' as kind from lineitem where l_partkey not in (select p_partkey from part where p_size <= 25)")
def dangling_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that orders call and that a catalogue of small parts lacks."""
    declared = table(spark, sf_dir, "part").where("p_size <= 25").select(tables.node_id("part", "p_partkey").alias("id"))
    return graph.with_externals(declared, tables.trade_edges(spark, sf_dir).where("relation = 'calls'"))


@_query("select sha256(text) as id, min(doc_id) as first_doc, count(*) as declarations from documents group by text having count(*) > 1")
def duplicates_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts declared more than once, and the first declaration of each."""
    nodes = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("id"), F.col("doc_id").alias("doc"), F.col("doc_id").alias("seq"))
    return graph.merge_nodes(nodes).join(graph.duplicate_declarations(nodes), "id").select("id", F.col("doc").alias("first_doc"), "declarations")


@_query(f"""with {_PLACES.strip()}, a as (select distinct source, target from places where hash(source) is not null and cast(split_part(source, ':', 2) as int) % 3 <> 0), b as (select distinct source, target from places where cast(split_part(source, ':', 2) as int) % 2 = 0)
select coalesce(a.source, b.source) as source, coalesce(a.target, b.target) as target, case when b.source is null then 'first' when a.source is null then 'second' else 'both' end as side from a full join b on a.source = b.source and a.target = b.target""")
def graph_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs that differ, pair by pair."""
    edges = tables.place_edges(spark, sf_dir).withColumn("n", F.split_part("source", F.lit(":"), F.lit(2)).cast("int"))
    return graph.compare_edges(edges.where("n % 3 <> 0"), edges.where("n % 2 = 0"))


@_query(r"""with spots as (select n_nationkey, r_name, n_name from nation join region on n_regionkey = r_regionkey), rows as (select r_name, n_name, ['Domain', 'UseCases', 'Model', 'Billing'][c_custkey % 4 + 1] as segment from customer join spots on c_nationkey = n_nationkey)
select r_name as namespace, 1 as depth, count(*) as classes from rows group by 1 union all select r_name || '\' || n_name, 2, count(*) from rows group by 1 union all select r_name || '\' || n_name || '\' || segment, 3, count(*) from rows group by 1""")
def namespace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes below each namespace, three levels deep."""
    return rollup.namespace_tree(_customer_classes(spark, sf_dir))


def _customer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    segment = F.element_at(F.array(*(F.lit(s) for s in tables.CUSTOMER_SEGMENTS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    named = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.concat_ws("\\", "r_name", "n_name", segment, F.concat(F.lit("Customer"), F.col("c_custkey").cast("string"))).alias("id"), "c_mktsegment", "c_custkey")


@_query(f"""with {_CLASSES} select from_place as "from", to_place as "to", count(*) as n from deps where from_place <> to_place group by all""")
def boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies between nations."""
    return rollup.boundaries(tables.class_edges(spark, sf_dir), 2)


@_query(f"""with {_CLASSES} select source, target, from_role, to_role, count(*) as n, arg_min(confidence, {_RANK}) as confidence from deps
where confidence <> 'AMBIGUOUS' and (from_role, to_role) in (('domain', 'application'), ('domain', 'infrastructure'), ('domain', 'interface'), ('application', 'infrastructure'), ('application', 'interface'), ('port', 'infrastructure'), ('port', 'interface')) group by all""")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.layer_violations(tables.class_edges(spark, sf_dir))


@_query(f"with {_CLASSES} select from_place as from_context, to_place as to_context, count(*) as n from deps where from_explicit and to_explicit and from_place <> to_place group by all")
def context_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.context_pairs(tables.class_edges(spark, sf_dir))


@_query(f"""with {_CLASSES} select from_role as role, from_segment as segment, count(distinct source) as classes from deps where from_role is not null group by all""")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each role and segment."""
    from knotwork.functions.words import namespace_of

    segments = namespace_of(F.col("source"))
    found = rollup.layer(segments)
    rows = tables.class_edges(spark, sf_dir).select("source").distinct().select(found["role"].alias("role"), F.get(segments, found["position"]).alias("segment"))
    return rows.where("role is not null").groupBy("role", "segment").agg(F.count(F.lit(1)).alias("classes"))


@_query(f"""with {_CLASSES} select 'no ports from use cases' as rule, source, target, count(*) as n from deps where from_segment = 'UseCases' and to_segment = 'Port' group by all
union all select 'billing ships only', source, target, count(*) from deps where from_segment = 'Billing' and to_segment <> 'Shipping' group by all""")
def dependency_rule_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rollup.DependencyRule("no ports from use cases", "**\\UseCases\\*", deny=("**\\Port\\**",)), rollup.DependencyRule("billing ships only", "**\\Billing\\*", allow=("**\\Shipping\\",))]
    return rollup.dependency_breaches(tables.class_edges(spark, sf_dir), rules)


_STRUCTURE = r"""with spots as (select n_nationkey, r_name || '\' || n_name as place from nation join region on n_regionkey = r_regionkey),
classes as (select c_custkey, c_mktsegment, place || '\' || ['Domain', 'UseCases', 'Model', 'Billing'][c_custkey % 4 + 1] || '\Customer' || c_custkey as id, ['Domain', 'UseCases', 'Model', 'Billing'][c_custkey % 4 + 1] as segment from customer join spots on c_nationkey = n_nationkey),
breaches as (
  select 'final domain' as rule, id, 'not final' as reason from classes where segment = 'Domain' and c_mktsegment not in ('BUILDING', 'MACHINERY')
  union all select 'round names', id, 'not named **0' from classes where segment = 'Billing' and c_custkey % 10 <> 0)"""


def _breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = _customer_classes(spark, sf_dir).withColumn("modifiers", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array(F.lit("final"))).otherwise(F.array(F.lit("abstract"))))
    rules = [rollup.StructureRule("final domain", "**\\Domain\\*", modifier="final"), rollup.StructureRule("round names", "**\\Billing\\*", named="**0")]
    return rollup.structure_breaches(classes, rules)


@_query(_STRUCTURE + " select rule, id, reason from breaches")
def structure_rule_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaches(spark, sf_dir)


@_query(_STRUCTURE + " select rule, id, reason from breaches where id not in (select id from classes where segment = 'Domain' and c_custkey % 3 = 0)")
def baseline_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches that the baseline (domain classes of every third key) does not hold."""
    baseline = _customer_classes(spark, sf_dir).where("c_custkey % 3 = 0 and c_custkey % 4 = 0").select(F.lit("final domain").alias("rule"), "id")
    return rollup.new_violations(_breaches(spark, sf_dir), baseline, ["rule", "id"])


_STEM1 = """case when w like '%ies' and len(w) >= 6 then left(w, -3) || 'y' when w like '%sses' and len(w) >= 7 then left(w, -2) when w like '%ss' then w when w like '%s' and len(w) >= 4 then left(w, -1)
 when w like '%ed' and len(w) >= 5 then left(w, -2) when w like '%ing' and len(w) >= 6 then left(w, -3) when w like '%er' and len(w) >= 5 then left(w, -2) else w end"""
_STEM2 = """case when w like '%ization' and len(w) >= 10 then left(w, -5) || 'e' when w like '%ation' and len(w) >= 8 then left(w, -5) || 'ate' when w like '%ator' and len(w) >= 7 then left(w, -4) || 'ate'
 when w like '%ments' and len(w) >= 8 then left(w, -5) when w like '%ment' and len(w) >= 7 then left(w, -4) when w like '%ity' and len(w) >= 6 then left(w, -3) else w end"""


def _stems_sql(rows: str) -> str:
    """rows: select id, name, weight."""
    return rf"""named as ({rows}),
split as (select id, weight, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+')) as w from named),
kept as (select id, weight, w from split where len(w) >= 3 and not regexp_full_match(w, '[0-9]+')),
once as (select id, weight, {_STEM1} as w from kept), twice as (select id, weight, {_STEM2} as w from once),
weights as (select id, case when len(w) > 4 and w like '%e' then left(w, -1) else w end as stem, max(weight) as weight from twice group by all)"""


_PART_NAMES = "select p_partkey as id, p_name as name, 3.0::double as weight from part union all select p_partkey, p_type, 2.0::double from part union all select p_partkey, p_brand, 1.0::double from part"


def _part_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.word_weights(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("owner"), F.col("p_brand").alias("namespace")))


@_query(f"with {_stems_sql(_PART_NAMES)} select id, stem, weight from weights")
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of parts, weighted by where they stand."""
    return _part_weights(spark, sf_dir)


@_query(f"with {_stems_sql('select doc_id as id, text as name, 3.0::double as weight from documents')} select stem, count(*) as df from weights group by stem")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each stem occurs."""
    return relevance.frequencies(_text_weights(table(spark, sf_dir, "documents")))


def _text_weights(docs: DataFrame) -> DataFrame:
    """(id, stem, weight) of texts as names; a text has each stem once."""
    return docs.select(F.col("doc_id").alias("id"), F.explode(stems(F.col("text"))).alias("stem"), F.lit(relevance.NAME).alias("weight"))


@_query(f"with {_stems_sql('select doc_id as id, text as name, 3.0::double as weight from documents')}, n as (select count(*) as n from documents) select stem, count(*) as nodes from weights, n group by stem, n.n having 10 * count(*) > n.n")
def common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems that more than a tenth of all documents have."""
    docs = table(spark, sf_dir, "documents")
    return relevance.common_stems(_text_weights(docs), docs.count(), part=10)


_SCORES = f"""with {_stems_sql(_PART_NAMES)}, df as (select stem, count(*) filter (weight >= 2) as df from weights group by stem), total as (select count(*)::double as n from part),
scores as (select id, round(sum(weight * ln(1 + n / (1 + df))) * pow(count(*) / 3.0, 2), 6) as score, count(*) as matched from weights join df using (stem), total where stem in ('widget', 'econom', 'red') group by id)"""
_TERMS = ["widget", "econom", "red"]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _part_weights(spark, sf_dir)
    return relevance.relevance(weights, relevance.frequencies(weights), table(spark, sf_dir, "part").count(), _TERMS)


@_query(_SCORES + " select id, score, matched from scores")
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their relevance to three words."""
    return _scores(spark, sf_dir)


@_query(_SCORES + """, owned as (select id, p_brand as owner, score from scores join part on p_partkey = id), best as (select max(score) as best from scores)
select id, owner, score from (select *, row_number() over (partition by owner order by score desc, id) as r from owned, best where score >= 0.4 * best) where r = 1 order by score desc, id limit 6""")
def topic_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parts for three words, one of a brand."""
    owned = _scores(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner")), "id")
    return relevance.seeds(owned)


@_query("""select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1))))::int as nth from pages""")
def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_links(spark, sf_dir)


_PATH = r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"


@_query(f"select page_id, array_to_string(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''), '|') as segments, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))::int as n from pages")
def page_path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_paths(spark, sf_dir).select("page_id", F.array_join(path_segments(F.col("path")), "|").alias("segments"), F.size(path_segments(F.col("path"))).alias("n"))


@_query(f"""with q as (select page_id as request, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') as p from pages),
r as (select '/' || r1 || '/' || r2 as route, r1, r2, (r1 = '{{lang}}')::int + (r2 = '{{id}}')::int as holes from (values ('{{lang}}'), ('en'), ('fr')) a(r1), (values ('{{id}}'), ('825'), ('25')) b(r2))
select request, route, holes, rank from (select request, route, holes, row_number() over (partition by request order by holes, route)::int as rank from q join r on len(p) = 2 and (r1 = '{{lang}}' or r1 = p[1]) and (r2 = '{{id}}' or r2 = p[2])) where rank <= 5""")
def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes that each page's path fits, most specific first."""
    routes = spark.createDataFrame([(f"/{a}/{b}", None, f"/{a}/{b}") for a in ("{lang}", "en", "fr") for b in ("{id}", "825", "25")], "route string, method string, path string")
    requests = tables.page_paths(spark, sf_dir).select(F.col("page_id").alias("request"), F.lit(None).cast("string").alias("method"), "path")
    return resolve.match_routes(requests, routes)


_EVENTS = "rows as (select event_type || '@' || strftime(ts, '%Y-%m-%d %H') as message, 'user:' || user_id as user, 'service' || user_id % 5 as service, event_id % 2 as odd from events), sends as (select message, user as sender, service from rows where odd = 0), handlers as (select message, user as handler, service from rows where odd = 1)"


@_query(f"with {_EVENTS} select distinct message, sender, handler from sends join handlers using (message)")
def channel_senders_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.link_messages(*tables.event_facts(spark, sf_dir))


@_query(f"with {_EVENTS} select distinct message, 'unhandled' as state from sends where message not in (select message from handlers) union all select distinct message, 'never sent' from handlers where message not in (select message from sends)")
def message_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.message_balance(*tables.event_facts(spark, sf_dir))


@_query(f"with {_EVENTS} select distinct message, s.service as source, h.service as target from sends s join handlers h using (message) where s.service <> h.service")
def service_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.contracts(*tables.event_facts(spark, sf_dir))


_CALLS = """methods as (select 'nation:' || n_nationkey as class, 'm' || n_nationkey % 4 as name from nation union all select 'region:' || r_regionkey, 'm' || r_regionkey % 3 + 2 from region union all select 'supplier:' || s_suppkey, 's' || s_suppkey from supplier where s_suppkey % 2 = 0),
declared as (select class, name, class || '::' || name as method from methods),
calls as (select 'order:' || o_orderkey as source, case when o_orderkey % 3 = 0 then null else 'customer:' || o_custkey end as receiver, case when o_orderkey % 3 = 0 then 's' || o_orderkey % 7 else 'm' || o_orderkey % 6 end as name, o_orderkey as seq from orders),
lineage as (select 'customer:' || c_custkey as class, 'nation:' || c_nationkey as up, 1 as depth from customer union all select 'customer:' || c_custkey, 'region:' || n_regionkey, 2 from customer join nation on c_nationkey = n_nationkey),
found as (select l.class, d.name, arg_min(d.method, l.depth) as method from lineage l join declared d on d.class = l.up group by all),
lone as (select name, min(method) as lone_method from declared group by name having count(*) = 1),
resolved as (select c.source, c.receiver, c.name, c.seq, f.method, case when f.method is not null then 'inferred' when c.receiver is not null then 'outside' when l.lone_method is not null then 'ambiguous' else 'unknown' end as outcome, l.lone_method from calls c left join found f on f.class = c.receiver and f.name = c.name left join lone l on l.name = c.name)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    methods = nation.select(tables.node_id("nation", "n_nationkey").alias("class"), F.concat(F.lit("m"), (F.col("n_nationkey") % 4).cast("string")).alias("name"))
    methods = methods.union(region.select(tables.node_id("region", "r_regionkey"), F.concat(F.lit("m"), (F.col("r_regionkey") % 3 + 2).cast("string"))))
    methods = methods.union(supplier.where("s_suppkey % 2 = 0").select(tables.node_id("supplier", "s_suppkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    methods = methods.withColumn("method", F.concat_ws("::", "class", "name"))
    lines = tables.place_edges(spark, sf_dir).where("source not like 'supplier:%'").withColumn("relation", F.lit("extends"))
    free = F.col("o_orderkey") % 3 == 0
    name = F.when(free, F.concat(F.lit("s"), (F.col("o_orderkey") % 7).cast("string"))).otherwise(F.concat(F.lit("m"), (F.col("o_orderkey") % 6).cast("string")))
    calls = table(spark, sf_dir, "orders").select(tables.node_id("order", "o_orderkey").alias("source"), F.when(~free, tables.node_id("customer", "o_custkey")).alias("receiver"), name.alias("name"), F.col("o_orderkey").alias("seq"))
    return resolve.resolve_calls(calls, resolve.find_methods(methods, lines), methods)


@_query(f"with {_CALLS} select source, name, outcome, case outcome when 'inferred' then method when 'ambiguous' then lone_method end as target, case outcome when 'inferred' then 'INFERRED' when 'ambiguous' then 'AMBIGUOUS' end as confidence from resolved")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of orders on customers, whose methods come from their nations and regions."""
    return _resolved(spark, sf_dir).select("source", "name", "outcome", "target", "confidence")


@_query(f"with {_CALLS} select outcome, count(*) as calls from resolved group by outcome")
def call_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.call_outcomes(_resolved(spark, sf_dir))


@_query(f"with {_CALLS} select name, count(*) as calls from resolved where outcome = 'unknown' group by name order by calls desc, name limit 15")
def unresolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unresolved_names(_resolved(spark, sf_dir))


@_query(f"with {_CALLS}, pairs as (select n.method as source, r.method as target from declared n join nation on n.class = 'nation:' || n_nationkey join declared r on r.class = 'region:' || n_regionkey and r.name = n.name) select source, target from pairs")
def method_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' methods that a region declares too."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    methods = nation.select(tables.node_id("nation", "n_nationkey").alias("class"), F.concat(F.lit("m"), (F.col("n_nationkey") % 4).cast("string")).alias("name"))
    methods = methods.union(region.select(tables.node_id("region", "r_regionkey"), F.concat(F.lit("m"), (F.col("r_regionkey") % 3 + 2).cast("string")))).withColumn("method", F.concat_ws("::", "class", "name"))
    return resolve.overrides(methods, tables.place_edges(spark, sf_dir).withColumn("relation", F.lit("extends")))


@_query("""with a as (select distinct 'user:' || user_id || '::' || event_type as method, event_type as class, 'p' || user_id % 20 as property, case when event_id % 2 = 0 then 'write' else 'read' end as kind, case when user_id % 3 = 0 then []::varchar[] else ['c' || user_id % 5] end as constants from events)
select distinct w.method as writer, r.method as reader, w.property as property, case when len(w.constants) = 0 or len(r.constants) = 0 then 'AMBIGUOUS' else 'INFERRED' end as confidence from a w join a r on w.kind = 'write' and r.kind = 'read' and w.class = r.class and w.property = r.property and w.method <> r.method where len(w.constants) = 0 or len(r.constants) = 0 or list_has_any(w.constants, r.constants)""")
def state_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that read what others write, by type of event."""
    user = F.col("user_id")
    access = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), user.cast("string"), F.lit("::"), "event_type").alias("method"), F.col("event_type").alias("class"), F.concat(F.lit("p"), (user % 20).cast("string")).alias("property"),
        F.when(F.col("event_id") % 2 == 0, "write").otherwise("read").alias("kind"), F.when(user % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), (user % 5).cast("string")))).alias("constants"),
    ).distinct()
    return resolve.state_readers(access)


@_query("""with paths as (select page_id, 'src' || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as path from pages), s(service) as (values ('src/en'), ('src/fr'), ('src/en/25'))
select page_id, (select arg_max(service, len(service)) from s where path = service or starts_with(path, service || '/')) as service from paths""")
def service_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest service directory above each page's path."""
    paths = tables.page_paths(spark, sf_dir).select("page_id", F.concat(F.lit("src"), "path").alias("path"))
    services = spark.createDataFrame([("src/en",), ("src/fr",), ("src/en/25",)], "service string")
    return paths.join(resolve.service_of(paths.select("path").distinct(), services), "path", "left").select("page_id", "service")


@_query("""with recursive r as (select p_partkey as k, p_partkey // 16 as c from part where p_partkey >= 16 union all select k, c // 16 from r where c >= 16)
select 'part:' || k as id, 'part:' || c as class from r where c < 16""")
def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as aliases, each of the one of a sixteenth of its number; chains end at the parts below 16."""
    parts = table(spark, sf_dir, "part").where("p_partkey >= 16").withColumn("up", F.expr("p_partkey div 16"))
    return resolve.follow_aliases(parts.select(tables.node_id("part", "p_partkey").alias("id"), tables.node_id("part", "up").alias("target")))


@_query(f"""with {_PLACES.strip()}, {_TRADE} select 'part:' || p_partkey as id, coalesce(bool_or(t), false) as tested, coalesce(bool_or(not t), false) as used from part left join (select target, cast(split_part(source, ':', 2) as bigint) % 10 = 0 as t from edges where relation = 'calls') on target = 'part:' || p_partkey group by p_partkey""")
def untested_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that tests (orders of a round key) touch, and parts that other orders use."""
    nodes = table(spark, sf_dir, "part").select(tables.node_id("part", "p_partkey").alias("id"))
    is_test = F.split_part("source", F.lit(":"), F.lit(2)).cast("long") % 10 == 0
    return resolve.untested(nodes, _trade(spark, sf_dir).where("relation = 'calls'"), is_test)


@_query(f"with p as (select page_id, 'app/' || case when page_id % 4 = 0 then 'Tests' when page_id % 4 = 1 then 'src' when page_id % 4 = 2 then 'spec' else 'lib' end || {_PATH} || case when page_id % 5 = 0 then 'Test.php' else '.php' end as path from pages) select page_id, page_id % 4 in (0, 2) or page_id % 5 = 0 as is_test from p")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are tests', by directory or by file."""
    folder = F.element_at(F.array(*(F.lit(x) for x in ("Tests", "src", "spec", "lib"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("app/"), folder, "path", F.when(F.col("page_id") % 5 == 0, "Test.php").otherwise(".php"))
    return tables.page_paths(spark, sf_dir).select("page_id", is_test_path(path).alias("is_test"))


@_query("""with rows as (select 'user:' || user_id as source, 'dispatches' as relation, 'event:' || event_type as target, case event_id % 3 when 0 then 'EXTRACTED' when 1 then 'INFERRED' else 'AMBIGUOUS' end as confidence, (event_id % 50)::int as line, event_id as seq from events)
select source, relation, target, arg_min(confidence, seq) as confidence, coalesce(array_to_string(list_sort(list(distinct line) filter (line <> 0)), ','), '') as lines from rows group by all""")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts, folded in by a stream in batches: the edges of a full build."""
    from knotwork.session import fresh_path
    from knotwork.streaming.incremental import current_edges, fold_in

    confidence = F.element_at(F.array(*(F.lit(c) for c in graph.CONFIDENCES)), (F.col("event_id") % 3 + 1).cast("int"))
    facts = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source"), F.lit("dispatches").alias("relation"), F.concat(F.lit("event:"), "event_type").alias("target"), confidence.alias("confidence"),
        (F.col("event_id") % 50).cast("int").alias("line"), F.lit(None).cast("string").alias("via"), F.col("event_id").alias("seq"),
    )
    incoming, state, marks = (fresh_path(spark, x) for x in ("facts", "state", "stream"))
    facts.repartition(3, "seq").write.parquet(incoming)
    fold_in(spark, incoming, state, marks)
    return current_edges(spark, state).select("source", "relation", "target", "confidence", F.array_join("lines", ",").alias("lines"))


_SUFFIXES = ("widget", "gear", "ring", "et", "r", "e")


@_query("select suffix, count(*) as classes from (select case " + " ".join(f"when ends_with(p_name, '{s}') and p_name <> '{s}' then '{s}'" for s in _SUFFIXES) + " end as suffix from part) where suffix is not null group by suffix")
def suffix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.suffix_counts(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), _SUFFIXES)


@_query(r"""with spots as (select n_nationkey, r_name || '\' || n_name as place from nation join region on n_regionkey = r_regionkey)
select c_mktsegment || c_nationkey as grouped, case when count(distinct c_custkey % 4) = 1 then any_value(place) || '\' || any_value(['Domain', 'UseCases', 'Model', 'Billing'][c_custkey % 4 + 1]) else any_value(place) end as root from customer join spots on c_nationkey = n_nationkey group by all""")
def common_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The namespace that the customers of a segment and nation share."""
    places = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("grouped"))
    return rollup.common_roots(_customer_classes(spark, sf_dir).join(places, "c_custkey"), "grouped")


@_query(f"""with p as (select list_filter(string_split({_PATH}, '/'), lambda x: x <> '') as s from pages), c as (select coalesce(s[1], '') as one, array_to_string(s[1:2], '/') as two from p), n as (select one, count(*) as n from c group by 1)
select case when n > 40 then two else one end as prefix, count(*) as routes from c join n using (one) group by 1""")
def route_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.route_groups(tables.page_paths(spark, sf_dir), 40)


@_query("select lang, source, sum(('0x' || substr(md5(text), 1, 8))::bigint)::bigint as fingerprint, count(*) as rows from documents group by all")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each language and source that changes with any text and not with their order."""
    return rollup.fingerprints(table(spark, sf_dir, "documents"), "lang", "source", value="text")


@_query(r"""with spots as (select n_nationkey, n_regionkey, r_name || '\' || n_name as place from nation join region on n_regionkey = r_regionkey),
classes as (select c_custkey, n_nationkey, n_regionkey, place || '\' || ['Domain', 'UseCases', 'Model', 'Billing'][c_custkey % 4 + 1] || '\Customer' || c_custkey as id, place from customer join spots on c_nationkey = n_nationkey)
select 'one' as tag, id as class from classes where c_custkey = 1 union all select 'place', id from classes where starts_with(id, 'AFRICA\') union all select 'kind', id from classes where n_regionkey = 1""")
def tagged_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by their id, their namespace and what they descend from."""
    classes = _customer_classes(spark, sf_dir)
    one = classes.where("c_custkey = 1").select(F.lit("one").alias("tag"), F.lit("id").alias("kind"), F.col("id").alias("value"))
    fixed = spark.createDataFrame([("place", "prefix", "AFRICA\\"), ("kind", "instanceof", "region:1")], "tag string, kind string, value string")
    up = tables.place_edges(spark, sf_dir).where("source not like 'supplier:%'").withColumn("relation", F.lit("extends"))
    named = classes.select(tables.node_id("customer", "c_custkey").alias("source"), "id")
    lineage = up.join(named, "source", "left").withColumn("source", F.coalesce("id", "source")).drop("id")
    return resolve.tagged_classes(one.union(fixed), classes, lineage)


@_query(f"""with p as (select page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') as s from pages), r as (select distinct s[1] as lang from p where len(s) = 2)
select 'op' || page_id as operation, '/' || s[1] || '/{{id}}' as route from p where len(s) = 2 and page_id % 3 <> 0""")
def operation_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations (a page's path, its number a placeholder) and the routes of their shape: one for each first segment, for GET."""
    parts = path_segments(F.col("path"))
    two = tables.page_paths(spark, sf_dir).where(F.size(parts) == 2)
    method = F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET")
    none = F.lit(None).cast("string")
    operations = two.select(F.concat(F.lit("op"), F.col("page_id").cast("string")).alias("operation"), method.alias("method"), none.alias("service"), F.concat(F.lit("/"), parts[0], F.lit("/{page}")).alias("path"))
    route = F.concat(F.lit("/"), parts[0], F.lit("/{id}"))
    routes = two.select(route.alias("route")).distinct().select("route", F.lit("GET").alias("method"), none.alias("service"), F.col("route").alias("path"))
    return resolve.match_operations(operations, routes)
