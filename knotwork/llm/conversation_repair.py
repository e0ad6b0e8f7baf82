"""Repair of conversations: the cheapest edits that make their roles alternate, by an auction for shortest paths.

The rows of a conversation and four states (nothing yet E, after a system row S, after a user row U, after an assistant
row A) make a lattice of nodes (rows done, state). Its arcs are edits: keep a row or give it another role and go on as the
roles allow, delete it, or insert an empty row before the next one. Costs are small integers. The auction algorithm finds
the way: every node has a price, never more than an arc's cost and the price at its end. A path grows from the origin. At its end
node, if the price is below the least of cost and price over the outgoing arcs, it rises to that and the path contracts by a node;
else the path extends along that arc, until it reaches the destination. Then the prices of origin and destination differ
by the least cost, and every arc of every cheapest way is tight: its cost is the difference of its prices. Tight arcs that
lead to the destination are followed by sets of nodes, always along the least label, which gives the least of all cheapest
edit strings. Prices begin with what later rows must cost by themselves; origins of one destination share them.

Long conversations are cut into blocks of BLOCK rows. A block is solved from each state in which it may begin to each in
which it may end, so blocks are independent, wherever their rows lie; a pass over a conversation's blocks, in which a block
is a few short strings, then chooses the way through them. No two of the strings of equally many rows and equal cost begin
one another, because inserted rows belong to the row after them; so the least whole is made of least parts.

Rows are dealt out by ranges of (conversation, turn, role, text's hash), so that one conversation may fill many tasks. Texts
seen before are found by a hash of 128 bits, first ones by partial aggregation. Only the hash of a whole repaired
conversation is made by one task, a block after the other, as its definition asks.

Defined results: null roles and texts are one space. Rows of one turn are ordered by role and then by the hash of the text,
so that results depend on no order; null turns come first. A role that is empty has no initial and can't be kept. A null conversation id
is a conversation like others. Repeated rows are rows of their own, and duplicates. An empty table gives no rows. Texts of
any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from knotwork.llm.common import SPACES
from knotwork.session import materialize

BLOCK = 64
#: Costs of edits, and of rows that stay although they break off.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: The states before anything, after a system, user and assistant row, and where each initial leads.
STATES = "ESUA"
_NEXT = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
_FULL = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}
_INFINITE = 1 << 40


@dataclass(frozen=True)
class Row:
    """What the lattice needs of a row: its role's initial, whether it must go, and what it costs to stay."""

    initial: str
    must_go: bool
    stay: int


class Lattice:
    """Edits of consecutive rows. last: they end the conversation, so rows may be inserted after them too."""

    def __init__(self, rows: list[Row], last: bool) -> None:
        n = len(rows)
        self.rows = rows
        self.arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(4 * n + 5)]
        self.end = 4 * n + 4
        for k in range(n + 1):
            for x, state in enumerate(STATES):
                out = self.arcs[4 * k + x]
                if k < n or last:
                    out += [("I", INSERT, 4 * k + STATES.index(_NEXT[state, i])) for i in "ua" if (state, i) in _NEXT]
                if k == n:
                    continue
                row = rows[k]
                out.append(("D", DELETE, 4 * k + 4 + x))
                if row.must_go:
                    continue
                if (state, row.initial) in _NEXT:
                    out.append(("K", row.stay, 4 * k + 4 + STATES.index(_NEXT[state, row.initial])))
                out += [("R", REROLE + row.stay, 4 * k + 4 + STATES.index(_NEXT[state, i])) for i in "ua" if (state, i) in _NEXT]
        if last:
            self.arcs[4 * n].append(("", 0, self.end))
            self.arcs[4 * n + 3].append(("", 0, self.end))
        ahead = [0]
        for row in reversed(rows):
            ahead.append(ahead[-1] + (DELETE if row.must_go else min(DELETE, row.stay)))
        #: What rows cost by themselves is no more than any way from a node, so prices may begin there.
        self.first_prices = [ahead[n - k] for k in range(n + 1) for _ in STATES] + [0]

    def node(self, state: str) -> int:
        """The node of a state after all rows."""
        return 4 * len(self.rows) + STATES.index(state)

    def _reaches(self, state: str, end: int) -> bool:
        """Whether a way leads from a state before all rows to a node after them."""
        if end == self.end:
            return True
        goal = STATES[end % 4]
        if goal == "E":
            return state == "E"
        if goal == "S":
            return state == "S" or state == "E" and any(r.initial == "s" and not r.must_go for r in self.rows)
        return True

    def cheapest(self, origins: str, end: int) -> dict[str, tuple[int, str]]:
        """For each of the origin states that a way leads from: the least cost to end, and the least of the cheapest strings."""
        prices, found = list(self.first_prices), {}
        for state in origins:
            if self._reaches(state, end):
                self._auction(prices, STATES.index(state), end)
                found[state] = prices[STATES.index(state)] - prices[end], self._trace(prices, STATES.index(state), end)
        return found

    def _auction(self, prices: list[int], origin: int, end: int) -> None:
        path, arcs = [origin], self.arcs
        while path[-1] != end:
            at = path[-1]
            best, to = _INFINITE, -1
            for _, cost, node in arcs[at]:
                if cost + prices[node] < best:
                    best, to = cost + prices[node], node
            if prices[at] < best:
                prices[at] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def _trace(self, prices: list[int], origin: int, end: int) -> str:
        """Of all ways of tight arcs from origin to end the one whose labels are least."""
        tight: dict[int, list[tuple[str, int]]] = {}
        back: dict[int, list[int]] = {}
        waiting = [origin]
        while waiting:
            at = waiting.pop()
            if at in tight:
                continue
            tight[at] = [(label, to) for label, cost, to in self.arcs[at] if prices[at] == cost + prices[to]]
            for _, to in tight[at]:
                back.setdefault(to, []).append(at)
                waiting.append(to)
        alive, waiting = set(), [end]
        while waiting:
            at = waiting.pop()
            if at not in alive:
                alive.add(at)
                waiting += back.get(at, ())
        labels, nodes = [], {origin}
        while end not in nodes:
            ways = [(label, to) for at in nodes for label, to in tight[at] if to in alive]
            least = min(label for label, _ in ways)
            labels.append(least)
            nodes = {to for label, to in ways if label == least}
        return "".join(labels)


def edited(rows: list[tuple[str, str]], edits: str, state: str) -> tuple[list[tuple[str, str]], str]:
    """The rows (role, text) after edits, begun in a state, and the state after them. A new role is the one that may follow."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        role, text = rows[at] if edit in "KR" else ("", "")
        at += edit in "KR"
        if edit != "K":
            role = _FULL["a" if state == "U" else "u"]
        out.append((role, text))
        state = _NEXT[state, role[:1]]
    return out, state


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in, as (conv, turn, role, text): by crc32("key:turn") % 20 a row is dropped (0), emptied (1),
    loses its .!? (2), comes twice (3) or is given role user (4). Nulls are one space, but a null turn stays null."""
    conv, number = F.col(f"`{key}`"), F.col(f"`{turn}`")
    dice = F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(number.cast("string"), F.lit(" ")))) % 20
    said = F.when(F.col("_dice") == 1, "").when(F.col("_dice") == 2, F.translate(F.col("_text"), ".!?", "")).otherwise(F.col("_text"))
    rows = df.select(conv.alias("conv"), number.cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("_role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("_text"), dice.alias("_dice")).where("_dice <> 0")
    rows = rows.select("conv", "turn", F.when(F.col("_dice") == 4, "user").otherwise(F.col("_role")).alias("role"), said.alias("text"), F.when(F.col("_dice") == 3, 2).otherwise(1).alias("_times"))
    return rows.select("conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "_times")).alias("_time")).drop("_time")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
#: A block: where it lies, its rows, for each pair of a first and a last state the cost and edits, and what joins it to its neighbours.
_BLOCK = (
    "conv {kind}, part int, block int, roles array<string>, texts array<string>, ways array<struct<begin:string,stop:string,cost:int,edits:string>>, "
    "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
)
_CHOSEN = "conv {kind}, part int, block int, begin string, edits string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (conv, turn, role, text) as solved blocks, named by part and block, which rise within a conversation."""
    kind = rows.schema["conv"].dataType.simpleString()
    named = materialize(rows.select("*", F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("rid")), "turns")
    place: Column = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "rid")
    first = named.groupBy("conv", "role", "digest").agg(F.min_by("rid", place).alias("rid")).select("rid", F.lit(True).alias("fresh"))
    order = ["conv", "turn", "role", "digest", "rid"]  # nulls come first
    dealt = named.join(first, "rid", "left").repartitionByRange(*order).sortWithinPartitions(*order)
    told = rows.sparkSession.createDataFrame([], _BLOCK.format(kind=kind)).schema
    arrow = to_arrow_schema(told)
    ends = set(".!?")

    def solve(conv: object, part: int, number: int, held: list[tuple], opened: bool, closed: bool | None) -> tuple:
        """closed: whether the conversation ends here; None where this task can't tell."""
        lattice_rows, faults, turns = [], [0, 0, 0], {t for t, *_ in held if t is not None}
        for _, role, text, fresh in held:
            seen = text.strip(SPACES)
            fault = 0 if not seen else 1 if not fresh else 2 if seen[-1] not in ends else 3
            if fault < 3:
                faults[fault] += 1
            lattice_rows.append(Row(role[:1], fault < 2, TRUNCATED if fault == 2 else 0))
        origins, ways = "E" if opened else STATES, []
        for last in (True, False):
            if last and closed is not False or not last and closed is not True:
                lattice = Lattice(lattice_rows, last)
                for end in ("",) if last else STATES:
                    node = lattice.end if last else lattice.node(end)
                    ways += [{"begin": b, "stop": end, "cost": c, "edits": e} for b, (c, e) in lattice.cheapest(origins, node).items()]
        initials = [r.initial for r in lattice_rows]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        return (conv, part, number, [r for _, r, *_ in held], [t for *_, t, _ in held], ways, min(turns, default=None), max(turns, default=None), len(turns), *faults, illegal, initials[0], initials[-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, conv = TaskContext.get().partitionId(), 0, [], None
        # what this task holds of its first and its last conversation may be a part of it
        opened, waiting = False, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fresh"))
            for ident, *row in zip(*columns, strict=True):
                if held and (ident != conv or len(held) >= block):
                    waiting.append(solve(conv, part, number, held, opened, ident != conv))
                    opened, held, number = ident != conv, [], number + 1
                conv = ident
                held.append(row)
            if waiting:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in waiting], f.type) for i, f in enumerate(arrow)], schema=arrow)
                waiting = []
        if held:
            row = solve(conv, part, number, held, opened, None)
            yield pa.RecordBatch.from_arrays([pa.array([row[i]], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return materialize(dealt.select("conv", "turn", "role", "text", "fresh").mapInArrow(read, told), "blocks")


def _way_through(blocks: list[dict]) -> list[tuple[str, int, str]]:
    """For each block of a conversation, in order: the state it begins in, its cost and its edits."""
    ahead: dict[str, int] = {"": 0}
    kept = []
    for at, own in reversed(list(enumerate(blocks))):
        ways = [w for w in own["ways"] if (w["stop"] == "") == (at == len(blocks) - 1) and w["stop"] in ahead]
        kept.append((ways, ahead))
        costs: dict[str, int] = {}
        for w in ways:
            costs[w["begin"]] = min(costs.get(w["begin"], _INFINITE), w["cost"] + ahead[w["stop"]])
        ahead = costs
    states, total, out = {"E"}, ahead["E"], []
    for ways, ahead in reversed(kept):
        cheap = [w for w in ways if w["begin"] in states and w["cost"] + ahead[w["stop"]] == total]
        least = min(w["edits"] for w in cheap)
        taken = [w for w in cheap if w["edits"] == least]
        out.append((min(w["begin"] for w in taken), taken[0]["cost"], least))
        states, total = {w["stop"] for w in taken}, total - taken[0]["cost"]
    return out


def _chosen(blocks: DataFrame) -> DataFrame:
    """For each block the state it begins in, its edits and its share of the conversation's counts."""
    kind = blocks.schema["conv"].dataType.simpleString()
    told = blocks.sparkSession.createDataFrame([], _CHOSEN.format(kind=kind)).schema
    arrow = to_arrow_schema(told)

    def choose(own: list[dict]) -> list[tuple]:
        out, high, before = [], None, ""
        for b, (begin, cost, edits) in zip(own, _way_through(own), strict=True):
            illegal = b["illegal"] + (before + b["first"] not in _LEGAL if out else 0)
            gaps = 0
            if b["high"] is not None:
                # the share of this block: how far it moves the highest turn on, less the turns that are new
                new = b["turns"] - (b["low"] == high)
                gaps = b["high"] - (b["low"] - 1 if high is None else high) - new
                high = b["high"]
            before = b["last"]
            out.append((b["conv"], b["part"], b["block"], begin, edits, cost, gaps, b["blank"], b["duplicate"], b["truncated"], illegal))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def told_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                if held and held[0]["conv"] != b["conv"]:
                    rows += choose(held)
                    held = []
                held.append(b)
            if rows:
                yield told_of(rows)
        if held:
            yield told_of(choose(held))

    few = blocks.drop("roles", "texts")
    return few.repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(read, told)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv, turn, role, text) repaired, in blocks: conv, part, block (rising within a conversation), audit, roles and
    texts of the repaired rows, and the block's share of cost, gaps, blank, duplicate, truncated and illegal."""
    blocks = _blocks(rows, block)
    kind = blocks.schema["conv"].dataType.simpleString()
    joined = blocks.select("part", "block", F.col("roles").alias("_roles"), F.col("texts").alias("_texts")).join(_chosen(blocks), ["part", "block"])
    schema = f"conv {kind}, part int, block int, audit string, roles array<string>, texts array<string>, cost long, {', '.join(f'{c} long' for c in _COUNTS)}"
    told = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(told)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("_roles", "_texts", "edits", "begin")}
            kept = [edited(list(zip(r, t, strict=True)), e, b)[0] for r, t, e, b in zip(*columns.values(), strict=True)]
            made = {"audit": batch.column("edits"), "roles": pa.array([[r for r, _ in k] for k in kept], pa.list_(pa.string())), "texts": pa.array([[t for _, t in k] for k in kept], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else batch.column(f.name) for f in arrow], schema=arrow)

    return joined.mapInArrow(read, told)


def repair_digests(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Damages and repairs; a row for each conversation of df: key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    every = df.select(F.col(f"`{key}`").alias("conv")).distinct()
    found = repair(damaged(df, key, turn, role, text), block)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("audit", "roles", "texts") else F.lit(-1 if f.name == "part" else 0).cast(f.dataType).alias(f.name) for f in found.schema.fields[1:]]
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string, repaired_sha256 string"
    told = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(told)
    sums = (*_COUNTS, "cost")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, counts, audit, digest, begun = None, None, [], None, False

        def told_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("conv", *sums, "audit")]
            for ident, *more, edits, roles, texts in zip(*columns, batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                if counts is None or ident != conv:
                    if counts is not None:
                        rows.append((conv, *counts, "".join(audit), digest.hexdigest()))
                    conv, counts, audit, digest, begun = ident, [0] * len(sums), [], hashlib.sha256(), False
                counts = [a + b for a, b in zip(counts, more, strict=True)]
                audit.append(edits or "")
                for r, t in zip(roles or (), texts or (), strict=True):
                    digest.update(f"{chr(10) if begun else ''}{r}:{t}".encode())
                    begun = True
            if rows:
                yield told_of(rows)
        if counts is not None:
            yield told_of([(conv, *counts, "".join(audit), digest.hexdigest())])

    whole = found.unionByName(every.select("conv", *missing))
    return whole.repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(read, told)
