"""Repair of conversations against a search over all states by increasing cost and string."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from knotwork.llm import conversation_repair as cr
from knotwork.session import table

FULL = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        dice = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        if dice:
            out += [(conv, turn, "user" if dice == 4 else role, text)] * (2 if dice == 3 else 1)
    return out


def plain(rows):
    """Of the rows of one conversation in order: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text."""
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, kinds = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, "E", ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in "EA":
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        for i in "ua":
            if (state, i) in cr._NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", at, cr._NEXT[state, i], (*out, f"{FULL[i]}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if kinds[at] not in ("blank", "duplicate"):
                stay = cost + (kinds[at] == "truncated")
                if (state, role[:1]) in cr._NEXT:
                    heapq.heappush(heap, (stay, audit + "K", at + 1, cr._NEXT[state, role[:1]], (*out, f"{role}:{text}")))
                for i in "ua":
                    if (state, i) in cr._NEXT:
                        heapq.heappush(heap, (stay + 2, audit + "R", at + 1, cr._NEXT[state, i], (*out, f"{FULL[i]}:{text}")))
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_all(rows):
    conversations = {r[0]: [] for r in rows}
    for conv, turn, role, text in plain_damage(rows):
        conversations[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {conv: plain(sorted(own, key=order)) for conv, own in conversations.items()}


def checked(got, want):
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want)
    for row in found:
        assert row[1:] == want[row[0]], row


def odd_rows(seed):
    rng = random.Random(seed)
    roles = ["user"] * 8 + ["assistant"] * 8 + ["system", None, "", "unknown", "sage", "tool"]
    texts = ["Yes.", "No!", "a b", " \t", "", None, "So? ", "x" * 50 + ".", "é。", "."] + [f"t{i}." for i in range(30)]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for t in range(rng.randint(1, 12))]
    rows += [(c, rng.choice([None, 3, 3, 90]), rng.choice(roles), rng.choice(texts)) for c in range(20) for _ in range(3)]
    rows += [(777, t // 2, rng.choice(roles[:17]), rng.choice(texts)) for t in range(500)]
    rows += [(778, 1, "user", "same.")] * 40 + [(779, 1, "system", "Only.")] * 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [3, cr.BLOCK])
def test_repair_is_the_plain_one(spark, block):
    rows = odd_rows(block)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    checked(cr.repair_digests(df, block=block), plain_all(rows))


def test_given_conversations(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    checked(cr.repair_digests(df), plain_all([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


def test_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "user", "long " * 300_000 + "?"), (1, 1, "assistant", "x" * 1_000_000), (2, 7, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    checked(cr.repair_digests(df), plain_all(rows))
    assert cr.repair_digests(df.limit(0)).count() == 0


def test_auction_prices_tell_the_cheapest_way():
    """A chain of rows from every state to every state: costs against relaxation, and the prices are feasible."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [cr.Row(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 9))]
        for last in (True, False):
            lattice = cr.Lattice(rows, last)
            for end in [lattice.end] if last else map(lattice.node, cr.STATES):
                least = {end: 0}
                for _ in range(4 * len(rows) + 6):
                    for at, out in enumerate(lattice.arcs):
                        for _, cost, to in out:
                            if to in least:
                                least[at] = min(least.get(at, 1 << 30), cost + least[to])
                found = lattice.cheapest(cr.STATES, end)
                assert {s: c for s, (c, _) in found.items()} == {s: least[i] for i, s in enumerate(cr.STATES) if i in least}
