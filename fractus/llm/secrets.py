"""Secret scan with one deterministic automaton for all rules (operator 3).

Rule patterns are parsed, joined into one nondeterministic automaton over bytes,
determinised by subset construction and minimised. Its transition array is
driven over a batch of texts in one pass, many stretches of text in lockstep:
stretches are cut only at bytes after which every state is the initial one. The
pass yields, by rule, the places where a match may end; the reversed rule's
automaton, run back from there, gives the leftmost start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded, slices

#: Bytes of text scanned in lockstep at once; a longer text is scanned alone.
BATCH = 4 << 20
VALUE = "[A-Za-z0-9+/_.=-]+"
KEY = "(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"


@dataclass(frozen=True)
class Rule:
    """``head``: what stands before the value; a match whose value has fewer than ``least`` characters is dropped."""

    kind: str
    pattern: str
    fold: bool = False
    head: str = ""
    least: int = 0


# The three base kinds, in the order in which ties are listed.
BASE = (
    Rule("assign", KEY + VALUE, fold=True, head=KEY, least=8),
    Rule("access", "AKIA[A-Z0-9]+", head="AKIA", least=12),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Kinds that the scan adds: key files and two public token formats.
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", head="gh[pousr]_", least=36),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", head="xox[abprs]-", least=10),
)


# --- from patterns to automata ------------------------------------------------


class Parser:
    """Patterns of literals, classes, groups, ``|``, ``? * +`` and ``{n,}`` as nested tuples."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold
        self.tree = self.union()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def union(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("seq", parts)

    def repeat(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.text.index(",}", self.at)
                n = int(self.text[self.at : end])
                self.at = end + 2
                node = ("seq", [node] * n + [("star", node)])
            elif c == "?":
                node = ("or", [node, ("seq", [])])
            else:
                node = ("star", node) if c == "*" else ("seq", [node, ("star", node)])
        return node

    def atom(self):
        c = self.peek()
        self.at += 1
        if c == "(":
            node = self.union()
            self.at += 1
            return node
        if c == "[":
            end = self.text.index("]", self.at)
            body, self.at = self.text[self.at : end], end + 1
            out, i = set(), 0
            while i < len(body):
                if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
                    out |= {chr(x) for x in range(ord(body[i]), ord(body[i + 2]) + 1)}
                    i += 3
                else:
                    out.add(body[i])
                    i += 1
            return self.chars(out)
        return self.chars({c})

    def chars(self, out: set[str]):
        if self.fold:
            out = {y for x in out for y in (x.lower(), x.upper())}
        return ("set", frozenset(ord(x) for x in out))


def reverse(node):
    kind, body = node
    if kind == "set":
        return node
    if kind == "star":
        return (kind, reverse(body))
    parts = [reverse(x) for x in body]
    return (kind, parts[::-1] if kind == "seq" else parts)


class Automaton:
    """Minimal deterministic automaton: ``table[state * classes + klass[byte]]``, start 0, ``accept`` a bit mask by state.

    ``search`` lets a match begin at every byte. ``dead`` is the state from which
    nothing is accepted (none if there is none).
    """

    def __init__(self, trees: list, search: bool):
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []
        starts, ends = [], {}
        for i, tree in enumerate(trees):
            a, b = self._build(tree)
            starts.append(a)
            ends[b] = 1 << i
        sets = {s for edges in self.steps for s, _ in edges}
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
        self.klass = np.array([kinds[s] for s in signature], np.uint8)
        members = [int(np.flatnonzero(self.klass == k)[0]) for k in range(len(kinds))]
        # What each state reaches by each class, with empty steps after it.
        reach = [[frozenset().union(*[self._closure([t]) for s, t in edges if byte in s]) for byte in members] for edges in self.steps]
        first = self._closure(starts)
        again = first if search else frozenset()
        states, todo, rows = {first: 0}, [first], []
        for current in todo:  # subset construction; ``todo`` grows on the way
            row = []
            moving = [reach[q] for q in current if self.steps[q]]
            for k in range(len(members)):
                goal = again.union(*[m[k] for m in moving])
                if goal not in states:
                    states[goal] = len(states)
                    todo.append(goal)
                row.append(states[goal])
            rows.append(row)
        table = np.array(rows, np.int64)
        accept = np.array([sum({ends[q] for q in state if q in ends}) for state in states], np.int64)
        group = accept.copy()
        while True:  # minimisation: refine classes of states by their successors' classes
            _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if len(np.unique(finer)) == len(np.unique(group)):
                break
            group = finer
        order = {g: i for i, g in enumerate(dict.fromkeys(finer.tolist()))}
        number = np.array([order[g] for g in finer.tolist()])
        keep = np.unique(number, return_index=True)[1]
        self.classes = len(members)
        self.table = number[table[keep]].astype(np.int32).reshape(-1)
        self.accept = accept[keep]
        square = self.table.reshape(-1, self.classes)
        stuck = np.flatnonzero((square == np.arange(len(square))[:, None]).all(1) & (self.accept == 0))
        self.dead = int(stuck[0]) if len(stuck) else -1
        self.resets = (square == 0).all(0)[self.klass]
        self.steps_of = [[row[k] for k in self.klass.tolist()] for row in square.tolist()]  # by byte, for single texts
        del self.empty, self.steps

    def _state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.steps) - 1

    def _build(self, node) -> tuple[int, int]:
        kind, body = node
        a, b = self._state(), self._state()
        if kind == "set":
            self.steps[a].append((body, b))
        elif kind == "star":
            x, y = self._build(body)
            self.empty[a] += [x, b]
            self.empty[y] += [x, b]
        elif kind == "or":
            for part in body:
                x, y = self._build(part)
                self.empty[a].append(x)
                self.empty[y].append(b)
        else:
            at = a
            for part in body:
                x, y = self._build(part)
                self.empty[at].append(x)
                at = y
            self.empty[at].append(b)
        return a, b

    def _closure(self, states: list[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for q in self.empty[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return frozenset(seen)

    def longest(self, data: bytes) -> int:
        """Length of the longest accepted prefix, -1 if there is none."""
        state, best = 0, 0 if self.accept[0] else -1
        for i, byte in enumerate(data):
            state = self.steps_of[state][byte]
            if state == self.dead:
                break
            if self.accept[state]:
                best = i + 1
        return best


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        if len(rules) > 63:  # the bits of a state's mask
            raise ValueError("at most 63 rules")
        trees = [Parser(r.pattern, r.fold).tree for r in rules]
        self.rules = rules
        self.forward = Automaton(trees, search=True)
        self.backward = [Automaton([reverse(t)], search=False) for t in trees]
        self.heads = [Automaton([Parser(r.head, r.fold).tree], search=False) if r.head else None for r in rules]

    def _stretches(self, data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts, the longer ones cut behind reset bytes into stretches of about ``size``."""
        starts, ends = bounds[:-1], bounds[1:]
        long = np.flatnonzero(ends - starts > 2 * size)
        if not len(long):
            return starts, ends
        resets = np.flatnonzero(self.forward.resets[data]) + 1
        more = []
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            at = np.searchsorted(resets, np.arange(a + size, b - size, size))
            cuts = np.unique(resets[at[at < len(resets)]])
            more.append(cuts[(cuts > a) & (cuts < b)])
        all_starts = np.sort(np.concatenate([starts, *more]))
        return all_starts, np.r_[all_starts[1:], bounds[-1]]

    def ends(self, data: np.ndarray, bounds: np.ndarray, size: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Offsets just behind accepted bytes, ascending, and the rules' bits there."""
        auto = self.forward
        klass = auto.klass[data]
        starts, stops = self._stretches(data, bounds, size)
        lengths = stops - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        state = np.zeros(len(starts), np.int32)
        found, bits = [], []
        for i, m in enumerate(active.tolist()):
            now = auto.table[state[:m] * auto.classes + klass[starts[:m] + i]]
            state[:m] = now
            hit = auto.accept[now]
            if hit.any():
                at = np.flatnonzero(hit)
                found.append(starts[at] + i + 1)
                bits.append(hit[at])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, bits = np.concatenate(found), np.concatenate(bits)
        order = np.argsort(found, kind="stable")
        return found[order], bits[order]

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule, end) in code points, sorted; null counts as empty."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        bounds = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        joined = b"".join(raw)
        found, bits = self.ends(np.frombuffer(joined, np.uint8), bounds)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule in enumerate(self.rules):
            ends = found[(bits >> k) & 1 == 1]
            if not len(ends):
                continue
            doc = np.searchsorted(bounds, ends - 1, "right") - 1
            last = np.r_[(np.diff(ends) != 1) | (np.diff(doc) != 0), True]
            before, of = 0, -1
            for end, d in zip(ends[last].tolist(), doc[last].tolist()):
                base = int(bounds[d])
                if d != of:
                    before, of = base, d
                n = self._back(k, joined, before, end)
                if n < 0:
                    continue
                start, before = end - n, end
                if rule.head and n - self.heads[k].longest(joined[start:end]) < rule.least:
                    continue
                text = raw[d]
                out[d].append((len(text[: start - base].decode("utf-8", "surrogatepass")), k, len(text[: end - base].decode("utf-8", "surrogatepass"))))
        for spans in out:
            spans.sort()
        return out

    def _back(self, k: int, data: bytes, low: int, end: int) -> int:
        """Longest match of rule ``k`` that ends at ``end`` and starts at ``low`` or later, read backwards in blocks."""
        auto, state, best, at = self.backward[k], 0, -1, end
        while at > low:
            block = data[max(low, at - 4096) : at][::-1]
            for i, byte in enumerate(block):
                state = auto.steps_of[state][byte]
                if state == auto.dead:
                    return best
                if auto.accept[state]:
                    best = end - at + i + 1
            at -= len(block)
        return best


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One scanner for each worker process."""
    return Scanner(rules)


def secret_scan(docs: DataFrame, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans) for ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then by
    the order of the rules, comma-joined; ``added`` are rules besides the base
    ones (63 in all at most, more raise ValueError). Null and empty texts have none. Each
    row is scanned alone: repeated rows and ids give repeated results, a null id
    stays null, other columns are ignored, an empty table gives no row.
    """
    rules = BASE + added

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(rules)
        for some in slices(batches, 1, BATCH):
            rows = []
            for spans in machine.scan(some.column(1).to_pylist()):
                said = [(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in spans]
                base = [s for k, s in said if k < len(BASE)]
                counts = [sum(k == i for k, _ in said) for i in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(s for _, s in said)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return bounded(source).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def oracle_sql() -> str:
    """The scan by plain regular expressions: offsets add up from what stands between the matches."""
    keys = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
    head = r"(" + keys + r")[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
    patterns = {
        "assign": (head + f"({VALUE})", f"length(regexp_extract(m[i], '{head}({VALUE})', 2)) >= 8"),
        "access": ("AKIA[A-Z0-9]+", "length(m[i]) >= 16"),
        "hex": ("[0-9a-f]+", "length(m[i]) >= 32"),
        "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
        "github": ("gh[pousr]_[A-Za-z0-9]+", "length(m[i]) >= 40"),
        "slack": ("xox[abprs]-[A-Za-z0-9-]+", "length(m[i]) >= 15"),
    }
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    parts = [
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, CAST({size.format('p[1 : i]')} + {size.format('m[1 : i - 1]')} AS BIGINT) AS s, length(m[i]) AS n FROM ("
        f"SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m FROM d) AS q, unnest(range(1, len(m) + 1)) AS u(i) WHERE {test}"
        for k, (kind, (pattern, test)) in enumerate(patterns.items())
    ]
    said = "kind || ':' || s || ':' || (s + n)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}), g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg({said}, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({said}, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
