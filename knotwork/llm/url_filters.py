"""URL filters: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule (host, path prefix) decides a url outright; the longest fitting rule wins. Any other url is judged by its
words: one strict term rejects it, and so do several distinct soft terms whose weights reach a threshold. A term
counts only between boundaries, that is where no ASCII letter or digit touches it.

Defined results: a url that is null, empty or without `://` has an empty host and path and no rule; null is allowed,
the others are still judged by their words. Repeated rows are judged alike and all returned. Columns other than the url
are passed through, and a column of the input that has the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import ascii_lower


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlVocabulary:
    """strict: terms that reject alone. soft: terms with weights. soft_hits distinct ones of soft_weight in sum reject."""

    strict: tuple[str, ...]
    soft: tuple[tuple[str, float], ...]
    soft_hits: int = 2
    soft_weight: float = 2.0


#: The terms of the default vocabulary, with the weights of the soft ones. Words that clean urls have too weigh
#: less than half of the limit, so that two of them alone reject nothing; their weights are exact in binary.
DEFAULT_VOCABULARY = UrlVocabulary(
    strict=("camgirls", "escorts", "hardcore", "keygen", "malware", "phishing", "porn", "pornhub", "sexcams", "warez", "xxx"),
    soft=(
        ("adult", 0.75), ("bet", 0.75), ("bonus", 0.75), ("casino", 1.5), ("cheap", 0.75), ("crack", 1.25), ("dating", 1.25), ("jackpot", 1.5), ("loan", 0.75),
        ("lottery", 1.25), ("nude", 1.5), ("payday", 1.25), ("pills", 0.75), ("poker", 1.25), ("replica", 0.75), ("sex", 1.5), ("slots", 0.75), ("torrent", 1.25), ("viagra", 1.5),
    ),
)

#: The rules of the query's contract.
CONTRACT_RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null. The list of rules is part of the plan: keep it short."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


@lru_cache(maxsize=4)
def _automaton(vocabulary: UrlVocabulary) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term, weight in vocabulary.soft:
        machine.add_word(term, (term, weight))
    for term in vocabulary.strict:
        machine.add_word(term, (term, None))
    machine.make_automaton()
    return machine


def judge_words(url: str | None, vocabulary: UrlVocabulary) -> tuple[int, int, float]:
    """Counts over one url: occurrences of strict terms, distinct soft terms, and their weight."""
    if not url:
        return 0, 0, 0.0
    text = url.lower()
    strict, soft = 0, {}
    for end, (term, weight) in _automaton(vocabulary).iter(text):
        begin = end - len(term) + 1
        if _is_word(text[begin - 1 : begin]) or _is_word(text[end + 1 : end + 2]):
            continue
        if weight is None:
            strict += 1
        else:
            soft[term] = weight
    return strict, len(soft), sum(soft.values())


def _is_word(char: str) -> bool:
    return char.isascii() and char.isalnum()


def filter_urls(df: DataFrame, rules: tuple[UrlRule, ...] = CONTRACT_RULES, vocabulary: UrlVocabulary = DEFAULT_VOCABULARY, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, n_strict, n_soft and soft_weight to every row. A map over rows: no shuffle."""

    @F.pandas_udf("n_strict long, n_soft long, soft_weight double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([judge_words(u, vocabulary) for u in urls], columns=["n_strict", "n_soft", "soft_weight"])

    added = ("host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight")
    kept = [c for c in df.columns if c.lower() not in added or c == url]
    # the caller's columns travel as one struct, so that their names meet none of ours
    own = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row")
    out = df.select(own, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), count(F.col(f"`{url}`")).alias("_words"))
    out = out.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    rejects = (F.col("_words.n_strict") > 0) | ((F.col("_words.n_soft") >= vocabulary.soft_hits) & (F.col("_words.soft_weight") >= vocabulary.soft_weight))
    by_words = F.when(rejects, "block").otherwise("allow")
    return out.select(*(F.col(f"_row.`{c}`") for c in kept), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_words).alias("verdict"), "_words.n_strict", "_words.n_soft", "_words.soft_weight")
