"""Secret scans by one deterministic automaton for all rules.

The rules' regular expressions are compiled together, reversed: into a nondeterministic automaton that may start anywhere,
by subset construction into a deterministic one over classes of bytes, and that is minimised into an array of
transitions. One pass over a text's bytes, from the last to the first, tells every place where a match of a rule begins.
A rule's spans are then taken from left to right: from the first such place that no earlier span of the rule covers, to
the longest match there, by the rule's own automaton over the bytes of the match. So spans are leftmost and longest, and
don't overlap within a rule. A rule may have two parts, a lead and the secret itself; a span whose secret is shorter than
the rule asks for is dropped, but covers what it covers.

The pattern language: literals, escapes (\\xHH, \\.), classes, groups, |, ?, *, + and {n}; ASCII only.

Defined results: null counts as an empty text, without spans. Spans are in code points. Rows are independent, so repeated
rows and empty tables need no care; other columns are ignored by scan() and passed through by redact(). Texts of any
length are read once as a whole, byte by byte, and once more where they match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import map_batches, slices, texts_of


@dataclass(frozen=True)
class SecretRule:
    """A match is lead and then secret, each as long as it can be. least: characters that the secret must have. base: counted
    in the digest of base spans."""

    kind: str
    secret: str
    least: int = 0
    lead: str = ""
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: The three rules of the query's contract. A run of hexadecimal digits that is too short has no longer one in
#: it, so that its pattern asks for the length itself and places in words are no starts.
BASE_RULES = (
    SecretRule("assign", "[A-Za-z0-9+/_.=-]+", 12, rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?", base=True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 18, base=True),
    SecretRule("hex", r"[0-9a-f]{16}[0-9a-f]*", 16, base=True),
)
#: A key that has no end (a text that was cut) spans the runs of its letters that follow the banner.
_BANNER, _KEY_LINES = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"([\x20\n\r\t]*[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=]*)*"
#: Well-known public forms of keys.
MORE_RULES = (
    SecretRule("private_key", _BANNER + rf"((-?-?-?-?[^-])*-----END [A-Z ]*PRIVATE KEY-----|{_KEY_LINES})"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    SecretRule("google", r"AIza[A-Za-z0-9_-]+", 39),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
DEFAULT_RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """States with edges on sets of bytes and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        """Start and end of a pattern's part of the automaton."""
        if not pattern:
            only = self.state()
            return only, only
        self.pattern, self.at = pattern, 0
        made = self._either()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} of {pattern!r}")
        return made

    def reversed(self) -> _Nfa:
        """The same states with every edge turned round."""
        turned = _Nfa()
        for _ in self.edges:
            turned.state()
        for s, (edges, empty) in enumerate(zip(self.edges, self.empty, strict=True)):
            for found, t in edges:
                turned.edges[t].append((found, s))
            for t in empty:
                turned.empty[t].append(s)
        return turned

    def _peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def _either(self) -> tuple[int, int]:
        start, end = self._row()
        while self._peek() == "|":
            self._take()
            first, last = self._row()
            fork, join = self.state(), self.state()
            self.empty[fork] += [start, first]
            self.empty[end].append(join)
            self.empty[last].append(join)
            start, end = fork, join
        return start, end

    def _row(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            first, last = self._repeated()
            self.empty[end].append(first)
            end = last
        return start, end

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        start, end = self._atom()
        sign = self._peek()
        if sign == "{":
            close = self.pattern.index("}", self.at)
            times, stop, after = int(self.pattern[self.at + 1 : close]), self.at, close + 1
            for _ in range(times - 1):
                self.at = begin
                first, last = self._atom()
                assert self.at == stop
                self.empty[end].append(first)
                end = last
            self.at = after
        elif sign and sign in "?*+":
            self._take()
            fork, join = self.state(), self.state()
            self.empty[fork].append(start)
            self.empty[end].append(join)
            if sign in "?*":
                self.empty[fork].append(join)
            if sign in "*+":
                self.empty[end].append(start)
            start, end = fork, join
        return start, end

    def _atom(self) -> tuple[int, int]:
        sign = self._take()
        if sign == "(":
            if self._peek() == "?":
                self.at += 2  # (?:
            made = self._either()
            self._take()
            return made
        found = self._class() if sign == "[" else frozenset([self._escape() if sign == "\\" else ord(sign)])
        start, end = self.state(), self.state()
        self.edges[start].append((found, end))
        return start, end

    def _escape(self) -> int:
        sign = self._take()
        if sign == "x":
            self.at += 2
            return int(self.pattern[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(sign, ord(sign))

    def _class(self) -> frozenset[int]:
        inverse = self._peek() == "^" and bool(self._take())
        found: set[int] = set()
        while (sign := self._take()) != "]":
            low = self._escape() if sign == "\\" else ord(sign)
            if self._peek() == "-" and self.pattern[self.at + 1] != "]":
                self._take()
                sign = self._take()
                found |= {*range(low, (self._escape() if sign == "\\" else ord(sign)) + 1)}
            else:
                found.add(low)
        return frozenset(range(256)) - found if inverse else frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """next_state[state + class of byte], states premultiplied by width; states from first_hit on have hits, as bits of rules.
    dead: the state that nothing leaves, if there is one."""

    classes: bytes
    width: int
    next_state: list[int]
    first_hit: int
    hits: dict[int, int]
    dead: int

    def places(self, data: bytes) -> list[tuple[int, int]]:
        """(index, hits) of the bytes after which the automaton has hits, in order."""
        state, table, first = 0, self.next_state, self.first_hit
        found = []
        for i, c in enumerate(data.translate(self.classes)):
            state = table[state + c]
            if state >= first:
                found.append((i, self.hits[state]))
        return found

    def longest(self, data: bytes, start: int) -> int:
        """The end of the longest match from start, or -1."""
        state, table, first, dead, classes = 0, self.next_state, self.first_hit, self.dead, self.classes
        end = start if first == 0 else -1
        for i in range(start, len(data)):
            state = table[state + classes[data[i]]]
            if state >= first:
                end = i + 1
            elif state == dead:
                break
        return end


def automaton(nfa: _Nfa, starts: set[int], ends: dict[int, int], anywhere: bool, most: int = 200_000) -> Automaton:
    """The minimal deterministic automaton. ends: the hit of each end. anywhere: whether a match may begin at any byte."""
    ordered = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in ordered), len(kinds)) for b in range(256))
    width = len(kinds)
    example = [classes.index(c) for c in range(width)]

    def closure(state: int) -> int:
        """The states that empty edges lead to, as bits; those that nothing leaves and that end nothing are left out."""
        stack, seen = [state], {state}
        while stack:
            for s in nfa.empty[stack.pop()]:
                if s not in seen:
                    seen.add(s)
                    stack.append(s)
        return sum(1 << s for s in seen if nfa.edges[s] or s in ends)

    def joined(every: Iterable[int]) -> int:
        return reduce(or_, every, 0)

    reach = [closure(s) for s in range(len(nfa.edges))]
    # where each state goes, by class of byte
    moves = [[joined(reach[t] for found, t in edges if byte in found) for byte in example] for edges in nfa.edges]
    start = joined(reach[s] for s in starts)
    again = start if anywhere else 0
    names, rows, queue, masks = {start: 0}, [], [start], []
    for subset in queue:
        members = [s for s in range(subset.bit_length()) if subset >> s & 1]
        masks.append(sum(ends.get(s, 0) for s in members))
        row = []
        for to in zip(*(moves[s] for s in members), strict=True) if members else [()] * width:
            target = joined(to) | again
            if target not in names:
                names[target] = len(names)
                queue.append(target)
                if len(names) > most:
                    raise ValueError(f"the rules need over {most} states")
            row.append(names[target])
        rows.append(row)
    masks = np.array(masks)
    table, masks = _minimised(np.array(rows), masks)
    # quiet states first, the start before all others unless it has hits itself
    order = np.argsort(masks > 0, kind="stable")
    if masks[0]:
        raise ValueError("a rule must not match nothing")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    table, masks = place[table[order]], masks[order]
    dead = np.flatnonzero((masks == 0) & (table == np.arange(len(table))[:, None]).all(axis=1))
    quiet = int((masks == 0).sum())
    return Automaton(classes, width, (table * width).ravel().tolist(), quiet * width, {i * width: int(m) for i, m in enumerate(masks) if m}, int(dead[0]) * width if len(dead) and not anywhere else -1)


def _minimised(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges states that no text tells apart; state 0 stays the start."""
    _, label = np.unique(masks, return_inverse=True)
    while True:
        rows = np.ascontiguousarray(np.column_stack([label, label[table]]).astype(np.int32))
        _, first, finer = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
        if len(first) == label.max() + 1:
            break
        label = finer
    swap = np.arange(len(first))
    swap[finer[0]], swap[0] = 0, finer[0]
    label = swap[finer]
    chosen = np.empty(len(first), int)
    chosen[swap] = first
    return label[table[chosen]], masks[chosen]


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...]) -> None:
        self.rules = rules
        nfa = _Nfa()
        whole = [nfa.add(f"({r.lead})({r.secret})" if r.lead else r.secret) for r in rules]
        back = nfa.reversed()
        self.begins = automaton(back, {end for _, end in whole}, {start: 1 << i for i, (start, _) in enumerate(whole)}, anywhere=True)
        self.leads = [_own(r.lead) if r.lead else None for r in rules]
        self.secrets = [_own(r.secret) for r in rules]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, index of rule, end) of every span, in that order."""
        data = text.encode()
        places = self.begins.places(data[::-1])
        if not places:
            return []
        found, covered, last = [], [0] * len(self.rules), len(data) - 1
        for i, hits in reversed(places):
            at = last - i
            for k, rule in enumerate(self.rules):
                if hits >> k & 1 and at >= covered[k]:
                    begin = at if self.leads[k] is None else self.leads[k].longest(data, at)
                    end = self.secrets[k].longest(data, begin) if begin >= 0 else -1
                    if end >= 0:
                        covered[k] = end
                        if end - begin >= rule.least:
                            found.append((at, k, end))
        if not text.isascii():
            # of a span of ASCII letters, bytes and code points are as many; else both ends are counted
            found = [(len(data[:s].decode()), k, len(data[:e].decode())) for s, k, e in found]
        return sorted(found)

    def shown(self, spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{self.rules[i].kind}:{start}:{end}" for start, i, end in spans)


def _own(pattern: str) -> Automaton:
    nfa = _Nfa()
    start, end = nfa.add(pattern)
    return automaton(nfa, {start}, {end: 1}, anywhere=False)


@lru_cache(maxsize=4)
def scanner(rules: tuple[SecretRule, ...]) -> Scanner:
    return Scanner(rules)


def scan(df: DataFrame, rules: tuple[SecretRule, ...] = DEFAULT_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_<kind> of each base rule, base_sha256 and spans, of every row. A map over rows: no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    base = [i for i, r in enumerate(rules) if r.base]
    machine = scanner(rules)  # compiled once, by the driver; its arrays are small
    counts = ", ".join(f"n_{rules[i].kind} long" for i in base)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
            for part in slices(batch):
                every = [machine.spans(t) for t in texts_of(part)]
                out = {key: part.column("key").to_pylist(), "spans": [machine.shown(s) for s in every]}
                out |= {f"n_{rules[b].kind}": [sum(i == b for _, i, _ in s) for s in every] for b in base}
                out["base_sha256"] = [hashlib.sha256(machine.shown([x for x in s if rules[x[1]].base]).encode()).hexdigest() for s in every]
                yield out

        return work

    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return map_batches(source, make, f"`{key}` {kind}, {counts}, base_sha256 string, spans string")


def redact(df: DataFrame, rules: tuple[SecretRule, ...] = DEFAULT_RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every span of a secret replaced by mark; overlapping spans by one. Null stays null."""

    machine = scanner(rules)

    def masked(value: str | None) -> str | None:
        if not value:
            return value
        out, at = [], 0
        for start, _, end in machine.spans(value):
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join([*out, value[at:]])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(masked)

    return df.withColumn(text, run(F.col(f"`{text}`")))
