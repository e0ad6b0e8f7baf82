"""Fingerprints: against plain sampling for one text, exact similarities, and the edited texts of a plain loop."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from knotwork.llm import weighted_sampling as ws
from knotwork.session import table

ODD = [(5, "a b c d"), (1, None), (2, ""), (2, ""), (3, " \t\n"), (None, "null id"), (4, "Éa é " * 3), (9, "word"), (9, "word"), (9, "Word"), (7, "x" * 200_000), (8, "long text of words " * 20_000), (6, "ab")]


def weights(text):
    counted = Counter(text.encode().lower().split())
    return {w: n * len(w.decode()) for w, n in counted.items()}


def similarity(a, b):
    a, b = weights(a), weights(b)
    return sum(min(a[w], b[w]) for w in a.keys() & b.keys()) / sum(max(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys())


def plain_fingerprint(text):
    """The definition, a draw and a word after the other."""
    own, best = weights(text), [(np.inf, 0)] * ws.SAMPLES
    for w, weight in own.items():
        h = np.array([xxhash.xxh3_64_intdigest(w)], np.uint64)
        r, c, b = (x[0] for x in ws.draws(h))
        for k in range(ws.SAMPLES):
            t = np.floor(np.float32(np.log(weight)) / r[k] + b[k])
            value = c[k] - r[k] * (t - b[k] + np.float32(1))
            if value < best[k][0]:
                best[k] = value, int(ws._mixed(h + np.array([int(t)], np.int64).astype(np.uint64) * ws._MIX[0])[0]) >> 48
    return "".join(f"{label:04x}" for _, label in best) if own else ""


def test_fingerprint_is_the_definition(monkeypatch):
    monkeypatch.setattr(ws, "_KEPT", 40)
    monkeypatch.setattr(ws, "_ROWS", 16)
    rng, sampler = random.Random(2), ws.Sampler()
    for _ in range(12):
        text = " ".join(rng.choice(["a", "Be", "été", "of", *map(str, range(90))]) for _ in range(rng.randint(0, 120)))
        assert sampler.fingerprint(text).tobytes().hex() == plain_fingerprint(text)


def test_draws_have_the_gamma_moments():
    r, c, b = ws.draws(np.array([xxhash.xxh3_64_intdigest(str(i)) for i in range(20_000)], np.uint64), 4)
    for x in (r, np.exp(c)):
        assert abs(x.mean() - 2) < 0.03 and abs(x.var() - 2) < 0.08
    assert abs(b.mean() - 0.5) < 0.01 and abs(b.var() - 1 / 12) < 0.002
    together = np.corrcoef(np.concatenate([r, np.exp(c), b], axis=1).T)
    assert np.abs(together - np.eye(12)).max() < 0.03


def test_collisions_are_the_similarity():
    rng, sampler, errors = random.Random(1), ws.Sampler(256), []
    for _ in range(60):
        words = [str(i) * rng.randint(1, 3) for i in range(300)]
        a = [rng.choice(words) for _ in range(400)]
        b = a[: rng.randint(0, 400)] + [rng.choice(words) for _ in range(200)]
        errors.append(ws.likeness(sampler.fingerprint(" ".join(a)), sampler.fingerprint(" ".join(b))) - similarity(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.015 and max(map(abs, errors)) < 0.15


def plain(rows):
    """Rows of next_edits, for rows in order."""
    out, sampler = [], ws.Sampler()
    for (ident, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        part = len(text) // 4
        changed = text[: len(text) - part] + following[:part]
        own, edited, other = (sampler.fingerprint(t) for t in (text, changed, following))
        out.append((ident, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), edited.tobytes().hex(), ws.likeness(own, edited), ws.likeness(own, other)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_next_edits(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, t, "clash", 1) for i, t in ODD], "doc_id long, text string, fingerprint string, kind int").repartition(3)
        hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) as h").collect()}
        ordered = [(i, t or "") for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))]
        got = ws.next_edits(df)
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain(ordered)
        assert ws.next_edits(df.limit(0)).count() == 0
        single = ws.next_edits(df.where("doc_id = 5")).collect()
        assert [(r.near_next, r.near_edited) for r in single] == [(1.0, ws.likeness(*map(ws.Sampler().fingerprint, ("a b c d", "a b c a")))) ]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_given_documents(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text or "") for r in df.orderBy("doc_id").collect()]
    assert sorted(map(tuple, ws.next_edits(df).collect()), key=repr) == plain(rows)


def test_fingerprint_column(spark):
    df = spark.createDataFrame([("a b", "old"), ("A  b", None), (None, "x")], "text string, fingerprint string")
    got = [r.fingerprint for r in ws.fingerprints(df).collect()]
    assert got == [plain_fingerprint("a b")] * 2 + [""]
