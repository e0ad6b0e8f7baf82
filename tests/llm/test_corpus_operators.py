"""Operators over whole corpora, against brute force on a small corpus with copies, near copies and shared passages."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from knotwork.llm import attention_model, exact_search, jaccard_join, lm_scoring, quality_rules, repeat_removal
from knotwork.llm.attention_model import Shape, gradient, windows
from knotwork.llm.suffix_array import common_prefixes, suffix_array
from knotwork.llm.word_cache import cached_tokenizer
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [None, "", " \n ", "one two", "one two", "One  TWO", "short one"]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 160))]
        texts.append(" ".join(words) if i % 7 else " ".join(words[:20]) + "\n" + passage + "\n" + " ".join(words[20:40]))
        for _ in range(i % 4):
            near = list(words)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    texts += [texts[-1]] * 3 + [passage] * 2 + ["rep eat " * 60, "x " * 400, "line a b c\nline a b c\n\nother"]
    return texts


@pytest.fixture(scope="module")
def documents(spark, corpus):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", "clash") for i, t in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string").repartition(5)


def _classes(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").encode().lower().decode())
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_classes(documents, corpus, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(documents, width, percent).collect()}
    want = _classes([t and t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in corpus], width, percent)
    assert [got[i] for i in range(len(corpus))] == want
    kept = {r.doc_id for r in jaccard_join.one_of_each(documents, width, percent).collect()}
    assert kept == {i for i, (_, c) in enumerate(want) if c == i}


def test_jaccard_with_null_ids(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(7, text), (None, text + " more"), (None, "quite another text of seven words"), (9, "none of these"), (9, "none of these")]
    got = sorted((r.n_shingles, r.component_id) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.component_id)
    assert got == [(1, 9), (1, 9), (23, 7), (24, 7)]


def test_jaccard_keeps_rows_not_ids(spark):
    far = ["one two three four five six seven", "red green blue black white grey pink", "north south east west up down left", "iron tin zinc gold lead silver copper"]
    rows = [(1, far[0], "x"), (1, far[1], "x"), (2, far[1], "x"), (2, far[2], "x"), (3, far[2], "x"), (None, far[0], "x"), (None, far[3], "x"), (None, far[3], "y"), (5, None, "x"), (5, "", "x")]
    rows += [(1, far[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, far[0]), (1, far[1]), (2, far[2]), (None, far[3]), (5, None), (5, "")], key=str)


@pytest.mark.parametrize(("apart", "copies", "width", "percent", "turns"), [(8, 150, 5, 80, 1), (14, 150, 5, 80, 1), (30, 220, 2, 85, 0), (24, 200, 2, 85, 0), (10, 200, 4, 85, 0)])
def test_jaccard_of_many_near_copies(spark, apart, copies, width, percent, turns):
    """A group of copies with so many changes that some are linked only with some others. Without turns the last comparison does all."""
    rng = random.Random(apart)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
    texts = []
    for _ in range(copies):
        near = list(base)
        for _ in range(rng.randint(0, apart)):
            near[rng.randrange(len(near))] = "".join(rng.choice("klmnop") for _ in range(6))
        texts.append(" ".join(near))
    want = _classes(texts, width, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(df, width, percent, turns=turns).collect()}
    assert [got[i] for i in range(len(texts))] == want and len({c for _, c in want}) > 1


def test_jaccard_pair_in_a_bucket_that_neither_probes():
    """Equal sketches in buckets 1, which a far third set alone probes, and 2, which the first probes: flagged in 2."""
    words = np.zeros((3, jaccard_join.SKETCH_BITS // 64), np.int64)
    words[2] = -1

    def tile(sig, probe, members):
        rows = {"sig": [sig] * len(members), "set": members, "label": members, "n": [50] * len(members), "probe": probe, "tile": [0] * len(members), "i": [0] * len(members), "j": [0] * len(members)}
        lists = {"sketch": [words[m] for m in members], "sigs": [[[1, 2], [1, 2], [1]][m] for m in members], "asks": [[[2], [], [1]][m] for m in members]}
        return {c: np.array(x) for c, x in rows.items()} | {c: pa.array(x, pa.list_(pa.int64())) for c, x in lists.items()}

    solve = jaccard_join._with_partners(85)
    assert solve(tile(1, [False, False, True], [0, 1, 2]))["set"].tolist() == []
    assert solve(tile(2, [True, False], [0, 1]))["set"].tolist() == [0, 1]


def test_jaccard_tells_long_texts_apart(spark):
    """Long texts that have nothing in common are told apart by their sketches alone; linked ones whose sketches differ in length are not."""
    rng = random.Random(5)
    long, other, edge = ([f"{name}{rng.randrange(10**9)}" for _ in range(n)] for name, n in (("a", 6000), ("b", 6000), ("c", 1900)))
    texts = [" ".join(x) for x in (long, other, edge, edge[:1800], long[:4500])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, _ = jaccard_join._met(df, 5, 80, "doc_id", "text", F.lit(0), 0)
    name = {r.id: r.set for r in sets.select("id", "set").collect()}
    assert len({len(r.sketch) for r in sets.where("id in (2, 3)").select("sketch").collect()}) == 2
    pairs = spark.createDataFrame([(name[x], name[y]) for x in name for y in name if x < y], "a long, b long")
    near = {(r.a, r.b) for r in jaccard_join._not_apart(pairs, sets.select("set", "n", "sketch"), 80).collect()}
    assert near == {(name[2], name[3])}
    rows = sets.orderBy("id").toPandas()
    tile = {"label": rows["set"].to_numpy(), "n": rows["n"].to_numpy(), "probe": np.ones(5, bool), "tile": np.zeros(5, int), "i": np.zeros(5, int), "j": np.zeros(5, int), "sketch": pa.array(rows["sketch"], pa.list_(pa.int64()))}
    assert [(x, y) for xs, ys, _ in jaccard_join._candidates(tile, 80) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)] in ([(2, 3)], [(3, 2)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(df, 5, 80).collect()}
    assert [got[i] for i in range(len(texts))] == _classes(texts, 5, 80)


def test_jaccard_of_nothing(documents):
    assert jaccard_join.classes(documents.limit(0)).count() == 0


def test_quality_measures(documents, corpus):
    rows = {r.doc_id: r for r in quality_rules.verdicts(documents).collect()}
    for i, text in enumerate(corpus):
        text = text or ""
        words = WORD.findall(text)
        count = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        marked = {p for k in range(len(words) - 7) if count[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(marked), failed)
        assert not (failed and r.kept)
    assert quality_rules.apply_rules(documents).count() == len(corpus)
    assert quality_rules.verdicts(documents.limit(0)).count() == 0


def test_quality_of_little(spark):
    schema = "doc_id long, text string, lang string, source string, n_words string, kept string, base_failed string, _text string"
    bad = spark.createDataFrame([(1, "one short text", "en", "s", "own", "k", "b", "t"), (2, None, None, None, "own", "k", "b", "t"), (3, "", "en", "s", "own", "k", "b", "t")], schema)
    for df in (bad, bad.where("doc_id > 5"), bad.limit(0)):
        assert quality_rules.keep_good(df).count() == 0
        assert [r.kept for r in quality_rules.verdicts(df).collect()] == [False] * df.count()
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100_000))
    good = spark.createDataFrame([(i, long if i == 7 else long[200 * i : 200 * i + 400], "en", "s", "own", "k", "b", "t") for i in range(30)] * 2, schema)
    kept = quality_rules.keep_good(good)
    assert kept.columns == good.columns and kept.count() == 60
    assert {tuple(r)[4:] for r in kept.collect()} == {("own", "k", "b", "t")}
    assert quality_rules.apply_rules(good).where("doc_id = 7").first().n_words == 100_000


def _exact_bounds(rows, limits):
    """Thresholds by exact quantiles of (group, metrics) rows, for groups that are large enough."""
    out = {}
    for group in {g for g, _ in rows}:
        own = [m for g, m in rows if g == group]
        for name, fence in limits.fences:
            values = sorted(m[name] for m in own)
            rank = lambda q: values[max(0, math.ceil(q * len(values)) - 1)]  # noqa: B023, E731
            middle = rank(0.5)
            out[group, name] = (middle - max(fence.guard, fence.times * (middle - rank(1 - fence.quantile))) if fence.low else -math.inf, middle + max(fence.guard, fence.times * (rank(fence.quantile) - middle)))
    return out


def test_quality_verdicts_by_exact_quantiles(spark):
    """Groups below the sketch's size keep every value, so verdicts are those of exact quantiles."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        size, noise = (4, 7)[i % 2], rng.random()
        lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(max(1, size + rng.randint(-2, 2 + 6 * (noise > 0.97))))) for _ in range(6)) for _ in range(8)]
        lines += [lines[0]] * (rng.randint(0, 5) if noise < 0.08 else 0)
        lines += ["# * $ | " * rng.randint(1, 4)] if 0.1 < noise < 0.15 else []
        rows.append((i, "\n".join(lines), "en", f"s{i % 2}"))
    limits = quality_rules.QualityLimits()
    got = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), limits).collect()
    values = {r.doc_id: {"symbols": r.n_symbols / r.word_chars, "dup_lines": r.n_dup_lines / r.n_lines, "repeats": r.n_repeat_words / r.n_words, "word_length": r.word_chars / r.n_words} for r in got}
    assert all(r.n_symbols == sum(c in "#*$%&|<>" for c in rows[r.doc_id][1]) for r in got)
    bounds = _exact_bounds([(r.doc_id % 2, values[r.doc_id]) for r in got if not r.base_failed], limits)
    want = {r.doc_id: not r.base_failed and all(bounds[r.doc_id % 2, m][0] <= v <= bounds[r.doc_id % 2, m][1] for m, v in values[r.doc_id].items()) for r in got}
    assert {r.doc_id: r.kept for r in got} == want and len(set(want.values())) == 2


def test_quality_follows_the_data(spark):
    rng = random.Random(4)
    clean = [(i, " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(50)), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice(["#*#*", "|&|", "word"]) for _ in range(50)), "en", "s") for i in range(20)]
    rows = {r.doc_id: r.kept for r in quality_rules.verdicts(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(rows[i] for i, *_ in clean) and not any(rows[i] for i, *_ in junk)


def test_quality_differs_by_source(spark):
    rng = random.Random(5)

    def text(size, same=0, lines=20):
        every = [" ".join("".join(rng.choice("abcdefgh") for _ in range(size + rng.randint(-1, 1))) for _ in range(9)) for _ in range(lines)]
        return "\n".join(every[: lines - same] + [every[0]] * same)

    plain = {"short": 4, "long": 8, "lined": 4}
    rows = [(1000 * k + i, text(size, 5 if source == "lined" and i % 10 == 0 else 0), source) for k, (source, size) in enumerate(plain.items()) for i in range(300)]
    odd = {9000: text(4), 9100: text(8), 9200: text(4, same=5)}
    rows += [(i + k, t, source) for i, t in odd.items() for k, source in enumerate(plain)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    rows = {r.doc_id: r for r in quality_rules.verdicts(df).collect()}
    assert not any(rows[i].base_failed for i in (9000, 9001, 9002, 9100, 9101, 9102))
    assert [rows[9000 + k].kept for k in range(3)] == [True, False, True]
    assert [rows[9100 + k].kept for k in range(3)] == [False, True, False]
    assert [rows[9200 + k].kept for k in range(3)] == [False, False, True]
    assert all(rows[1000 * k + i].kept for k in range(3) for i in range(300))


@pytest.mark.parametrize("most", [1 << 14, 1])
def test_repeats(documents, corpus, most):
    least = 60
    runs = {r.rid: r.runs for r in repeat_removal.repeated_runs(documents, least, gram=16, most_contexts=most).collect()}
    keyed = {r.doc_id: r._rid for r in repeat_removal._keyed(documents, "doc_id", "text").select("doc_id", "_rid").collect()}
    data = [(t or "").encode() for t in corpus]
    count = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    for i, d in enumerate(data):
        keep = np.ones(len(d), bool)
        for k in range(len(d) - least + 1):
            if count[d[k : k + least]] > 1:
                keep[k : k + least] = False
        parts, _ = repeat_removal.kept_parts(d, runs.get(keyed[i]), least)
        assert b"".join(d[a:b] for a, b in parts) == bytes(np.frombuffer(d, np.uint8)[keep])
    assert repeat_removal.removal_digests(documents).count() == len(corpus)
    assert repeat_removal.removal_digests(documents.limit(0)).count() == 0


def test_removal_keeps_columns_of_any_name(spark):
    same = "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(1, same + " one", "a", "b", "c", "d"), (2, "two " + same, "a", "b", "c", "d"), (3, None, "a", "b", "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, _rid string, row string, key string")
    got = repeat_removal.remove_repeats(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, " one", *"abcd"), (2, "two ", *"abcd"), (3, None, *"abcd")]
    assert repeat_removal.remove_repeats(df.limit(0)).count() == 0


def test_removed_text_stays_text(documents, corpus):
    rows = {r.doc_id: r.text for r in repeat_removal.remove_repeats(documents).collect()}
    assert rows[0] is None and rows[1] == "" and len(rows) == len(corpus)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        text = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 80))).astype(np.uint8)
        raw, sa = text.tobytes(), suffix_array(text).astype(np.int64)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        _, plcp = common_prefixes(text, sa)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while b + n < len(raw) and a + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert plcp[b] == n


@pytest.mark.parametrize("dim", [2, 16])
def test_exact_search(spark, dim):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(700, dim)).round(2)
    points[100:140] = points[0]
    rows = [(i, [float(x) for x in p], "clash") for i, p in enumerate(points)]
    rows += [(900, None, ""), (901, [float("nan")] * dim, ""), (902, [None] * dim, ""), (903, [float("inf")] * dim, ""), (None, [0.5] * dim, ""), (950, [1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in exact_search.top_k(df, F.col("id") % 50 == 0, k=5, shard_rows=100, block_rows=6).collect())
    valid = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in valid:
        if q is not None and q % 50 == 0:
            best = sorted((-int(v @ w), i is None, i or 0, i) for i, w in valid if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, _, _, i) in enumerate(best)]
    assert got == sorted(want)
    assert exact_search.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_lm_base_scores_and_learning(documents, corpus):
    rows = {r.doc_id: r for r in lm_scoring.score(documents, public_tokenizers.path("word_bpe_49k.json"), lm_scoring.LmOptions(head=50, every=2)).collect()}
    tokens = [[*WORD.findall((t or "").encode().lower().decode()), ""] for t in corpus]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(corpus))]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in (x.translate(str.maketrans("", "")) for x in t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_lm_trains_on_every_document(spark):
    file, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    texts = [" ".join(rng.choice(["the", "model", "reads", "words"]) for _ in range(n)) for n in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = lm_scoring.word_counts(df, "text").cache()
    every = sum(len(t.split()) + 1 for t in texts)  # each of these words is one id
    assert lm_scoring.fit(df, counts, file, lm_scoring.LmOptions()).seen == every
    some = lm_scoring.fit(df, counts, file, lm_scoring.LmOptions(every=10**6)).seen
    assert len(texts) <= some < every


def test_lm_bounds_change_no_score(documents):
    file = public_tokenizers.path("word_bpe_49k.json")
    twice = documents.unionByName(documents.where("doc_id % 3 = 0"))  # equal rows too
    whole, bounded = (sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in lm_scoring.score(twice, file, o).collect()) for o in (lm_scoring.LmOptions(), lm_scoring.LmOptions(head=5, pairs=20)))
    assert len(whole) == twice.count()
    for a, b in zip(whole, bounded, strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-5)


def test_lm_held_out_scores_against_base(spark):
    """Texts of a few phrases and of words that training lacks: no score is far below the base, all together are above it."""
    rng = random.Random(11)
    phrases = ["the model reads the words", "of a long text", "and counts what it finds"]
    texts = [" ".join(rng.choice([*phrases, "".join(rng.choice("bcdfgaeiou") for _ in range(9))]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = [r for r in lm_scoring.score(df, public_tokenizers.path("word_bpe_49k.json")).collect() if r.held_out]
    assert len(rows) > 20 and sum(r.n_known < r.n_tokens for r in rows) > 20
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert all(r.score >= r.base_score + r.n_tokens * math.log10(lm_scoring.LmOptions().count_weight) - 1e-6 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_small_tables_have_few_files(spark, monkeypatch):
    """However many partitions links come from, they are written in no more files than there are cores."""
    rng, files, shuffles = random.Random(13), {}, spark.conf.get("spark.sql.shuffle.partitions")
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200 + i, t + " end") for i, t in enumerate(texts)]
    plain = jaccard_join.materialize

    def counted(df, label, **more):
        out = plain(df, label, **more)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r.doc_id: r.component_id for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {i: i % 200 for i, _ in rows}
    assert all(files[label] <= spark.sparkContext.defaultParallelism for label in ("stars", "pairs", "links", "least", "owned"))


def test_lm_works_out_each_place_and_rare_word_once(spark, monkeypatch):
    """Overlapping windows share places, and rare words recur: classes are worked out once a place, units once a word."""
    file, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(12)
    texts = [" ".join(rng.choice(["the", "model", "Zürich,", "qxzv"]) for _ in range(n)) for n in (0, 1, 19, 20, 21, 60, 200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    scorer = lm_scoring.Scorer(lm_scoring.fit(df, lm_scoring.word_counts(df, "text").cache(), file, lm_scoring.LmOptions(head=1)), file)
    worked_out, asked, plain, unit = [], [], attention_model._exponentials, scorer.words.unit
    monkeypatch.setattr(attention_model, "_exponentials", lambda w, h: worked_out.append(h.size // h.shape[-1]) or plain(w, h))
    scorer.words.unit = lambda word: asked.append(word) or unit(word)
    together = scorer.score(texts)
    assert sum(worked_out) == together["n_tokens"].sum()
    assert len(asked) == len(set(asked)) > 1
    monkeypatch.setattr(lm_scoring, "KEPT", 1)
    scorer.words.kept.clear()
    apart = [scorer.score([t])["head_score"][0] for t in texts]
    assert np.allclose(together["head_score"], apart, rtol=1e-5)


def test_last_ids_are_the_librarys():
    known = cached_tokenizer(public_tokenizers.path("word_bpe_49k.json"), True)
    for word in ["x", "house", "house,", "don't", "(q)", "...", "é,", "naïve!", "日本", "12,5", "a\x00b", "\x1c", "\u3000"]:
        ids = known.tokenizer.encode(word, add_special_tokens=False).ids
        assert known.last(word) == (ids[-1] if ids else None)


def test_lm_pairs_of_one_slot(spark):
    every = np.arange(1, 3_000_000)
    slots = lm_scoring._slot(every)
    crowded = int(np.flatnonzero(np.bincount(slots) > 1)[0])
    pairs = every[(slots >= crowded) & (slots <= crowded + 1)].tolist()
    rows = spark.createDataFrame([(p, 5, float(i + 1)) for i, p in enumerate(pairs)], "pair long, c long, share double")
    keys, share, beyond = lm_scoring._pair_table(rows, 100)
    assert not beyond and share[lm_scoring._find_pairs(keys, np.array(pairs))].tolist() == [i + 1 for i in range(len(pairs))]


def test_gradient_and_windows():
    shape, rng = Shape(30, 7, 8, 6), np.random.default_rng(0)
    flat = rng.normal(0, 0.5, shape.size())
    a, y, ok = rng.integers(0, 30, (4, 6)), rng.integers(0, 7, (4, 6)), rng.random((4, 6)) < 0.8
    g, _ = gradient(shape, flat, a, y, ok)
    for i in rng.integers(0, len(flat), 20):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs((gradient(shape, up, a, y, ok)[1] - gradient(shape, down, a, y, ok)[1]) / 2e-4 - g[i]) < 1e-5
    for length in (1, 5, 20, 21, 37, 100):
        covered = np.zeros(length, int)
        for s, skip in zip(*windows(length, 20, 17), strict=True):
            covered[s + skip : s + 20] += 1
        assert (covered == 1).all()
