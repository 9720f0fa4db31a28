"""Secret scans by one combined deterministic automaton.

The rules' regular expressions are compiled together: Thompson automata over bytes, subset construction (searching from
every position at once), minimisation by partition refinement, and a transition array over classes of bytes that all
rules treat alike. A text is read once, for all rules. To read in numpy, the bytes of a batch are cut into lanes that
step together from the start state; a lane whose true entry state turns out to be another is stepped again until both
runs meet, so the states are those of one sequential pass. A byte that never occurs in UTF-8 parts the texts and
resets the automaton.

The pass tells where matches of each rule can end. Starts come from the rule's reversed automaton and the greedy end from
its anchored one, both run near such places only; matches are leftmost and non-overlapping per rule, as a regex engine
finds them, and those whose value is too short are dropped after they have taken their place.

Null and empty texts have no spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scriptorium.llm.batches import pieces

#: Parts two texts in a buffer: no byte of UTF-8.
PART = 0xFF
LANES, SHORTEST = 4096, 64
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the part that is the value, and the least code points of that value.

    value: None for the whole match, else the pattern of what precedes the value.
    """

    kind: str
    pattern: str
    least: int = 1
    fold: bool = False
    before_value: str | None = None

    @property
    def one_class(self) -> bool:
        """Whether the pattern is one class, once or more, so that its matches are the runs of that class."""
        return not self.before_value and re.fullmatch(r"\[[^\]^]+\]\+", self.pattern) is not None


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", 8, True, _ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Further kinds that the method brings: public token formats and key headers. Open-ended kinds multiply the states of
#: the combined automaton (tokens of three dotted parts and credentials in URLs made 29,196 of them); these leave 1,051.
MORE = (
    Rule("git", r"gh[pousr]_[A-Za-z0-9]+", 30),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 35),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class _Nfa:
    """A Thompson automaton of one pattern: literals, classes, groups, alternatives, ?, * and +."""

    def __init__(self, pattern: str, fold: bool):
        self.pattern, self.fold, self.at = pattern, fold, 0
        self.empty: dict[int, list[int]] = defaultdict(list)
        self.edges: list[tuple[int, frozenset[int], int]] = []
        self.n = 0
        self.start, self.stop = self._alternatives()
        if self.at != len(pattern):
            raise ValueError(f"can't read {pattern!r} from {self.at}")

    def _state(self) -> int:
        self.n += 1
        return self.n - 1

    def _alternatives(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self.pattern[self.at : self.at + 1] == "|":
            self.at += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self._state(), self._state()
        for start, stop in parts:
            self.empty[a].append(start)
            self.empty[stop].append(b)
        return a, b

    def _sequence(self) -> tuple[int, int]:
        start = stop = self._state()
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            a, b = self._atom()
            mark = self.pattern[self.at : self.at + 1]
            if mark and mark in "?*+":
                self.at += 1
                into, out = self._state(), self._state()
                self.empty[into].append(a)
                self.empty[b].append(out)
                if mark in "?*":
                    self.empty[into].append(out)
                if mark in "*+":
                    self.empty[b].append(a)
                a, b = into, out
            self.empty[stop].append(a)
            stop = b
        return start, stop

    def _atom(self) -> tuple[int, int]:
        if self.pattern[self.at] == "(":
            self.at += 1
            part = self._alternatives()
            self.at += 1
            return part
        a, b = self._state(), self._state()
        self.edges.append((a, self._bytes(), b))
        return a, b

    def _char(self) -> int:
        c = self.pattern[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.pattern[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.pattern[self.at - 2 : self.at], 16)
        return ord(c)

    def _bytes(self) -> frozenset[int]:
        if self.pattern[self.at] != "[":
            found = {self._char()}
        else:
            self.at += 1
            found = set()
            while self.pattern[self.at] != "]":
                low = high = self._char()
                if self.pattern[self.at] == "-" and self.pattern[self.at + 1] != "]":
                    self.at += 1
                    high = self._char()
                found |= set(range(low, high + 1))
            self.at += 1
        if self.fold:
            found |= {b ^ 32 for b in found if 65 <= b <= 90 or 97 <= b <= 122}
        return frozenset(found)


class Dfa:
    """Transition array of patterns read together; accepts[state] has a bit for each pattern that can end there.

    search: begin a match at every position. backwards: read the patterns from their ends. State 0 is the start; a
    state without a way on is dead (anchored automata only).
    """

    def __init__(self, patterns: list[tuple[str, bool]], search: bool, backwards: bool = False):
        nfas = [_Nfa(p, f) for p, f in patterns]
        empty: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        edges: dict[tuple[int, int], list[tuple[frozenset[int], tuple[int, int]]]] = defaultdict(list)
        starts, stops = set(), {}
        for i, nfa in enumerate(nfas):
            for a, into in nfa.empty.items():
                for b in into:
                    empty[(i, b) if backwards else (i, a)].append((i, a) if backwards else (i, b))
            for a, found, b in nfa.edges:
                edges[(i, b) if backwards else (i, a)].append((found, (i, a) if backwards else (i, b)))
            starts.add((i, nfa.stop if backwards else nfa.start))
            stops[i, nfa.start if backwards else nfa.stop] = i
        alike: dict[tuple[bool, ...], int] = {}
        sets = sorted({found for nfa in nfas for _, found, _ in nfa.edges}, key=sorted)
        self.classes = np.zeros(256, np.uint8)
        for b in range(256):
            self.classes[b] = alike.setdefault(tuple(b in s for s in sets), len(alike))
        sample = {int(c): b for b, c in enumerate(self.classes)}
        n_classes = len(alike)

        def closed(states):
            todo, found = list(states), set(states)
            while todo:
                for b in empty[todo.pop()]:
                    if b not in found:
                        found.add(b)
                        todo.append(b)
            return frozenset(found)

        first = closed(starts)
        numbers, table, todo = {first: 0}, [], [first]
        while todo:
            state = todo.pop(0)
            row = []
            for c in range(n_classes):
                into = {b for a in state for found, b in edges[a] if sample[c] in found}
                to = closed(into | starts if search else into)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row.append(numbers[to])
            table.append(row)
        accepts = np.array([sum(1 << stops[a] for a in state if a in stops) for state in numbers], np.int64)
        self._minimise(np.array(table), accepts)
        self.dead = {s for s in range(len(self.table)) if not self.accepts[s] and (self.table[s] == s).all()}
        self.rows = [[int(self.table[s, c]) for c in self.classes] for s in range(len(self.table))]

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """States are alike if they accept alike and lead to alike states: refined until nothing splits."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            if finer.max() == block.max():
                break
            block = finer
        order = {b: i for i, b in enumerate(dict.fromkeys(block.tolist()))}
        number = np.array([order[b] for b in block.tolist()])
        one = np.array([int(np.flatnonzero(number == i)[0]) for i in range(len(order))])
        self.table, self.accepts = number[table[one]], accepts[one]


class Scanner:
    """The combined automaton of some rules, and what finds spans around the ends it reports."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Dfa([(r.pattern, r.fold) for r in rules], search=True)
        self.ahead = [Dfa([(r.pattern, r.fold)], search=False) for r in rules]
        self.back = [Dfa([(r.pattern, r.fold)], search=False, backwards=True) for r in rules]
        self.lead = [Dfa([(r.before_value, r.fold)], search=False) if r.before_value else None for r in rules]
        n = int(self.all.classes.max()) + 2
        classes = self.all.classes.astype(np.int32)
        classes[PART] = n - 1
        self.classes = classes
        wide = np.zeros((len(self.all.table), n), np.int32)
        wide[:, : n - 1] = self.all.table * n
        self.step, self.width = wide.ravel(), n
        self.accepts = np.repeat(self.all.accepts, n)

    def states(self, data: np.ndarray) -> np.ndarray:
        """The state (times the number of classes) after each byte, as one sequential pass gives them."""
        lanes = max(1, min(LANES, len(data) // SHORTEST))
        length = -(-len(data) // lanes)
        kinds = np.full(lanes * length, self.width - 1, np.int32)
        kinds[: len(data)] = self.classes[data]
        kinds = np.ascontiguousarray(kinds.reshape(lanes, length).T)
        out = np.empty((length, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for i in range(length):
            state = self.step[state + kinds[i]]
            out[i] = state
        entered = np.zeros(lanes, np.int32)
        while True:
            true = np.concatenate([[0], out[-1, :-1]]).astype(np.int32)
            again = np.flatnonzero(true != entered)
            if not len(again):
                break
            entered[again] = true[again]
            state = true[again]
            for i in range(length):
                state = self.step[state + kinds[i][again]]
                apart = state != out[i, again]
                if not apart.any():
                    break
                again, state = again[apart], state[apart]
                out[i, again] = state
        return out.T.ravel()[: len(data)]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text, (rule, start, end) in bytes: all matches of each rule, short ones dropped."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = bytes([PART]).join(texts) + bytes([PART])
        data = np.frombuffer(joined, np.uint8)
        flags = self.accepts[self.states(data)]
        hits = np.flatnonzero(flags)
        if not len(hits):
            return found
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        for r, rule in enumerate(self.rules):
            ends = hits[(flags[hits] >> r) & 1 == 1]
            if not len(ends):
                continue
            fresh = np.ones(len(ends), bool)
            fresh[1:] = ends[1:] != ends[:-1] + 1
            run = np.flatnonzero(fresh)
            stop = ends[np.append(run[1:], len(ends)) - 1]
            if rule.one_class:  # every run of the class is a match: long ones are told by their ends
                keep = stop - ends[run] + 1 >= rule.least
                run, stop = run[keep], stop[keep]
            owner = np.searchsorted(begins, ends[run], side="right") - 1
            taken: dict[int, int] = {}
            for doc, first, last in zip(owner.tolist(), ends[run].tolist(), stop.tolist(), strict=True):
                base, floor = int(begins[doc]), taken.get(doc, 0)
                text = texts[doc]
                at = first - base
                while at <= last - base:
                    start = self._leftmost(r, text, at, floor)
                    if start is None:
                        at += 1
                        continue
                    end = self._longest(self.ahead[r], text, start)
                    floor = taken[doc] = end
                    if self._value(r, text, start, end) >= rule.least:
                        found[doc].append((r, start, end))
                    at = max(at + 1, end)
        return found

    def _leftmost(self, r: int, text: bytes, last: int, floor: int) -> int | None:
        """The leftmost start, at `floor` or later, of a match that ends with byte `last`."""
        dfa, state, best = self.back[r], 0, None
        rows, accepts, dead = dfa.rows, dfa.accepts, dfa.dead
        for at in range(last, floor - 1, -1):
            state = rows[state][text[at]]
            if state in dead:
                break
            if accepts[state]:
                best = at
        return best

    @staticmethod
    def _longest(dfa: Dfa, text: bytes, start: int) -> int:
        state, end = 0, start
        rows, accepts, dead = dfa.rows, dfa.accepts, dfa.dead
        for at in range(start, len(text)):
            state = rows[state][text[at]]
            if state in dead:
                break
            if accepts[state]:
                end = at + 1
        return end

    def _value(self, r: int, text: bytes, start: int, end: int) -> int:
        if self.lead[r] is not None:
            start = self._longest(self.lead[r], text, start)
        return len(text[start:end].decode("utf-8", "replace"))


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One automaton per worker."""
    return Scanner(rules)


def find_spans(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text, (rule, start, end) in code points, by start, then rule."""
    scan, out = scanner(rules), []
    for part in _parts([(t or "").encode() for t in texts]):
        for text, spans in zip(part, scan.spans(part), strict=True):
            if spans and not text.isascii():
                marks = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                spans = [(r, int(marks[a]), int(marks[b])) for r, a, b in spans]
            out.append(sorted(spans, key=lambda s: (s[1], s[0], s[2])))
    return out


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, total = [], 0
    for t in texts:
        if held and total + len(t) > BATCH_BYTES:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t) + 1
    if held:
        yield held


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_frame(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans array<struct<kind, start, end>>): the secrets of each text, found where it is read; no shuffle."""
    schema = T.StructType([df.schema[key], T.StructField("spans", _SPAN)])
    kinds = [r.kind for r in rules]

    def run(batches):
        for batch in pieces(batches, text):
            spans = find_spans(batch.column(text).to_pylist(), rules)
            out = [[{"kind": kinds[r], "start": a, "end": b} for r, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=[key, "spans"])

    return df.select(key, text).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with every span, and what overlaps it, replaced by the kind of the first."""
    out, at = [], 0
    for r, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{rules[r].kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_frame(df: DataFrame, text: str = "text", n_chars: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with secrets replaced in `text` and its length, if there is such a column, brought up to date; nulls stay."""

    def run(batches):
        for batch in pieces(batches, text):
            texts = batch.column(text).to_pylist()
            clean = [t and redact(t, s, rules) if s else t for t, s in zip(texts, find_spans(texts, rules), strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[text] = pa.array(clean, pa.string())
            if n_chars in columns:
                sizes = [n if c is t else len(c) for n, c, t in zip(columns[n_chars].to_pylist(), clean, texts, strict=True)]
                columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.mapInArrow(run, df.schema)


def digest_frame(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans): counts and digest of the base kinds, and all spans."""
    kinds = [r.kind for r in RULES]
    schema = T.StructType([df.schema[key], *[T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for batch in pieces(batches, text):
            found = find_spans(batch.column(text).to_pylist())
            base = [[s for s in spans if s[0] < len(BASE)] for spans in found]
            said = lambda spans: ",".join(f"{kinds[r]}:{a}:{b}" for r, a, b in spans)
            columns = [
                batch.column(key),
                *[pa.array([sum(s[0] == r for s in spans) for spans in base], pa.int64()) for r in range(len(BASE))],
                pa.array([hashlib.sha256(said(spans).encode()).hexdigest() for spans in base], pa.string()),
                pa.array([said(spans) for spans in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
