"""The registered queries of the operators, with the parameters of their contracts, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import bpe_codec, conversation_repair, exact_search, jaccard_join, lexical_scan, lm_scoring, packing, quality_rules, repeat_removal, secret_scans, sorted_tables, url_filters, weighted_sampling
from knotwork.session import fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids, byte-level tokenizer, end id 1."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@_query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@_query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every text by the 50k ranks."""
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op8_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to sorted-string-table shards and read back."""
    encoder = sorted_tables.tokenizer_encoder(public_tokenizers.path("word_bpe_49k.json"), spaced=True)
    shards = sorted_tables.write_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "sst"), encoder)
    return sorted_tables.read_shards(spark, shards, with_ids=False)


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    found = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    return secret_scans.scan(table(spark, sf_dir, "documents"))


@_query
def op6_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every hundredth."""
    return exact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@_query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that share 85 % of their 4-word shingles, by links."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@_query
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes that lie in a repeated string of 200."""
    return repeat_removal.removal_digests(table(spark, sf_dir, "documents"))


@_query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every text."""
    return lm_scoring.score(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired by the cheapest edits."""
    return conversation_repair.repair_digests(table(spark, sf_dir, "conversations"))


@_query
def op13_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return weighted_sampling.next_edits(table(spark, sf_dir, "documents"))


@_query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of all documents for every benchmark item."""
    return lexical_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op2_jaccard_join"] = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end)) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
ways as (select a, b from links union all select b, a from links),
reached(id, r) as (select doc_id, doc_id from documents union select reached.id, ways.b from reached join ways on reached.r = ways.a),
least as (select id, min(r) as component_id from reached group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id from documents d left join n using (doc_id) join least on id = d.doc_id"""

ORACLE_SQL["op6_exact_search"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores) where rank <= 10"""


def _url_sql() -> str:
    """The rules and the vocabulary as SQL."""
    rules, words = sorted(url_filters.CONTRACT_RULES, key=lambda r: -len(r.name)), url_filters.DEFAULT_VOCABULARY
    fits = [f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in rules]

    def has(terms: str) -> str:
        return f"regexp_matches(lower(url), '(^|[^a-z0-9])({terms})($|[^a-z0-9])')"

    hits = " + ".join(f"{has(t)}::int" for t, _ in words.soft)
    weight = " + ".join(f"{w} * {has(t)}::int" for t, w in words.soft)
    return f"""
with r as (select page_id, url, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
m as (select *, case {" ".join(f"when {f} then '{r.name}'" for f, r in zip(fits, rules, strict=True))} end as rule, case {" ".join(f"when {f} then '{r.verdict}'" for f, r in zip(fits, rules, strict=True))} end as ruled from p)
select page_id, host, path, rule, coalesce(ruled, case when {has("|".join(words.strict))} or ({hits} >= {words.soft_hits} and {weight} >= {words.soft_weight}) then 'block' else 'allow' end) as verdict from m"""


ORACLE_SQL["op5_url_filters"] = _url_sql()

_TERMS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL["op12_lexical_search"] = f"""
with d as (select doc_id, {_TERMS} as ts from documents),
c as (select count(*)::bigint as n_docs, sum(len(ts))::bigint as n_terms from d where len(ts) > 0),
tf as (select doc_id, len(ts)::bigint as n, t, count(*)::bigint as tf from (select doc_id, ts, unnest(ts) as t from d) group by doc_id, ts, t),
df as (select t, count(*)::bigint as df from tf group by t),
q as (select item_id, t, count(*)::bigint as times from (select item_id, unnest({_TERMS}) as t from benchmark) group by 1, 2),
w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from df, c),
scores as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from q join tf using (t) join w using (t), c group by 1, 2)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0) where rank <= 20"""
