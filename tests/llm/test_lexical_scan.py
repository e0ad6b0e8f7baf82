"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import pytest
from knotwork.llm import lexical_scan

DOCS = [
    (0, "The cat, the CAT and the dog"), (1, "cat"), (1, "cat"), (2, None), (3, ""), (4, " .,!\t"), (5, "catalogue dog-cat Éclair"), (6, "É éclair dog dog dog"), (None, "cat"), (7, "dog"), (8, "the " * 40_000 + "zebra"),
    (9, "a\x00cat\x7fdog"), (10, "İ zebra　zebra"), (11, "under_score cat9 9cat"),
]
ITEMS = [(1, "cat dog the"), (2, "Éclair"), (3, None), (4, "..."), (5, "zebra zebra cat"), (5, "dog"), (6, "missing"), (None, "under score"), (7, "cat9 the the")]


def plain(docs, items, k):
    pattern = re.compile(lexical_scan.TERM)

    def terms(text):
        return pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, total = len(held), sum(h[2] for h in held)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc, tf, n in held:
            score = 0
            for t, times in asked.items():
                df = sum(t in h[1] for h in held)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += times * w * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * (75 + 25 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bounds", [None, (2, 100), (100, 3)])
@pytest.mark.parametrize("k", [2, 20])
def test_search_is_the_plain_one(spark, monkeypatch, bounds, k):
    if bounds:
        monkeypatch.setattr(lexical_scan, "ITEMS", bounds[0])
        monkeypatch.setattr(lexical_scan, "TERMS", bounds[1])
    docs = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical_scan.search(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(DOCS, ITEMS, k)


def test_many_equal_scores_are_ordered_by_id(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("2999 - id as doc_id", "if(id % 3 = 0, 'x y', 'x') as text").repartition(4)
    best = lexical_scan._Best

    class Small(best):
        def __init__(self, items, k):
            super().__init__(items, k)
            self.room = 50

    monkeypatch.setattr(lexical_scan, "_Best", Small)
    items = spark.createDataFrame([("a", "x"), ("b", "y")], "item_id string, text string")
    got = [(r.item_id, r.rank, r.doc_id) for r in lexical_scan.search(docs, items, 5).orderBy("item_id", "rank").collect()]
    # x is in all documents, so its weight is 0 and nothing is found
    assert got == [("b", n + 1, 2 + 3 * n) for n in range(5)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_scan.search(docs.limit(0), items).count() == 0
    assert lexical_scan.search(docs, items.limit(0)).count() == 0
