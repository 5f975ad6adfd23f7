"""Secret scans: one minimised automaton for all rules, run over the bytes of many texts in step."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, texts_of

UPPER, LOWER, DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"


# A rule's expression is a sequence of (bytes allowed, least, most) steps, most None for "any number", and of
# alternatives: a list of such sequences. That covers the rules here; see `compile_rules` for what it builds.
def lit(s: bytes, fold: bool = False) -> list:
    return [(bytes({*bytes([c]).lower(), *bytes([c]).upper()}) if fold else bytes([c]), 1, 1) for c in s]


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Its last step is a run, which a match takes whole. A match of fewer than `least` bytes is dropped
    after it was matched; where `lead` says what stands before the run, only the run's bytes count."""

    kind: str
    steps: tuple
    least: int = 0
    lead: bytes = b""


VALUE = UPPER + LOWER + DIGIT + b"+/_.=-"
TOKEN = UPPER + LOWER + DIGIT

_KEYWORDS = [lit(w, fold=True) for w in (b"password", b"passwd", b"secret", b"token")] + [[*lit(b"api", fold=True), (b"_", 0, 1), *lit(b"key", fold=True)]]

#: The base rules, then those this method adds.
BASE = (
    Rule(
        "assign", (_KEYWORDS, (b"\"'", 0, 1), (b" ", 0, None), (b":=", 1, 1), (b" ", 0, None), (b"\"'", 0, 1), (VALUE, 1, None)), 6,
        rb"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?"
    ),
    Rule("access", (*lit(b"AKIA"), (UPPER + DIGIT, 1, None)), 20),
    Rule("hex", ((DIGIT + b"abcdef", 24, None),), 24),
)
ADDED = (
    Rule("github", (*lit(b"gh"), (b"pousr", 1, 1), *lit(b"_"), (TOKEN, 1, None)), 40),
    Rule("slack", (*lit(b"xox"), (b"abprs", 1, 1), *lit(b"-"), (TOKEN + b"-", 1, None)), 15),
    Rule("google", (*lit(b"AIza"), (TOKEN + b"_-", 1, None)), 39),
    Rule("jwt", (*lit(b"eyJ"), (TOKEN + b"_-.", 1, None)), 40),
    Rule("stripe", (*lit(b"sk_live_"), (TOKEN, 1, None)), 20),
    Rule("private_key", (*lit(b"-----BEGIN "), (UPPER + b" ", 0, None), *lit(b"PRIVATE KEY"), (b"-", 1, None)), 30),
)
BASE_KINDS = tuple(r.kind for r in BASE)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[bytes, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, at: int, step) -> int:
        if isinstance(step, list):
            end = self.state()
            for alternative in step:
                s = self.state()
                self.empty[at].append(s)
                for part in alternative:
                    s = self.add(s, part)
                self.empty[s].append(end)
            return end
        allowed, least, most = step
        for _ in range(least):
            s = self.state()
            self.moves[at].append((allowed, s))
            at = s
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.moves[loop].append((allowed, loop))
            return loop
        if most > least:
            end = self.state()
            self.empty[at].append(end)
            for _ in range(most - least):
                s = self.state()
                self.moves[at].append((allowed, s))
                self.empty[s].append(end)
                at = s
            return end
        return at


@dataclass
class Automaton:
    """next[state, class of byte]; accepts[state] has bit k if a match of rule k may end before the next byte; dead: from there none can, or -1."""

    classes: np.ndarray
    next: np.ndarray
    accepts: np.ndarray
    dead: int = -1


def _determinise(nfa: _Nfa, start: int, final: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction over byte classes, then partition refinement. anywhere: a match may begin at any byte. State 0 is the start."""
    tests = sorted({a for moves in nfa.moves for a, _ in moves})
    shape = np.array([[b in t for t in tests] for b in range(256)], dtype=bool)
    _, sample, classes = np.unique(shape, axis=0, return_index=True, return_inverse=True)

    reach = []  # by empty moves, of each state
    for s in range(len(nfa.empty)):
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach.append(frozenset(seen))

    def closed(states) -> frozenset:
        return frozenset().union(*(reach[s] for s in states))

    by_class = [[[t for a, t in moves if int(b) in a] for moves in nfa.moves] for b in sample]
    first = closed(frozenset([start]))
    number, rows, todo = {first: 0}, [], deque([first])
    while todo:
        states, row = todo.popleft(), []
        for targets in by_class:
            reached = {t for s in states for t in targets[s]}
            if anywhere:
                reached.add(start)
            to = closed(frozenset(reached))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows, dtype=np.int32)
    accepts = np.array([sum(1 << k for k in {final[s] for s in states if s in final}) for states in number], dtype=np.int32)
    group = np.unique(accepts, return_inverse=True)[1].astype(np.int64)
    count = group.max() + 1
    while True:  # states stay together while their successors do
        group = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].astype(np.int64)
        if group.max() + 1 == count:
            break
        count = group.max() + 1
    order = np.unique(group, return_index=True)[1]
    rename = np.empty(count, dtype=np.int64)
    rename[group[order[np.argsort(order)]]] = np.arange(count)
    group = rename[group]
    keep = np.unique(group, return_index=True)[1]
    small, accepts = group[table[keep]].astype(np.int32), accepts[keep]
    stuck = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(classes.ravel().astype(np.uint8), small, accepts, int(stuck[0]) if len(stuck) else -1)


def compile_rules(rules: tuple) -> tuple[Automaton, list[Automaton]]:
    """The automaton of all rules, which may begin anywhere, and each rule's own automaton over a text read backwards."""
    nfa, final = _Nfa(), {}
    start = nfa.state()
    for k, rule in enumerate(rules):
        s = nfa.state()
        nfa.empty[start].append(s)
        for step in rule.steps:
            s = nfa.add(s, step)
        final[s] = k

    def turned(steps):
        return [[turned(a) for a in s] if isinstance(s, list) else s for s in reversed(list(steps))]

    backwards = []
    for rule in rules:
        own = _Nfa()
        s = begin = own.state()
        for step in turned(rule.steps):
            s = own.add(s, step)
        backwards.append(_determinise(own, begin, {s: 0}, anywhere=False))
    return _determinise(nfa, start, final, anywhere=True), backwards


def _ends(texts: list[bytes], machine: Automaton, lanes: int = 2048) -> list[tuple[int, int, int]]:
    """(text, end, accepting bits) of every place where some rule's match ends and can't go on, in no order of texts.

    Texts of like length are run in step: one transition of all of them at a time. Every byte is read once."""
    found = []
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    flat, accepts, width = machine.next.ravel(), machine.accepts, machine.next.shape[1]
    for k in range(0, len(order), lanes):
        part = order[k : k + lanes]
        lengths = np.array([len(texts[i]) for i in part])
        data = machine.classes[np.frombuffer(b"".join(texts[i] for i in part) + b"\0", dtype=np.uint8)]
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.zeros(len(part), dtype=np.int64)
        bits = np.zeros(len(part), dtype=np.int32)
        live = len(part)
        falling = -lengths
        for step in range(int(lengths[0]) if len(lengths) else 0):
            now = int(np.searchsorted(falling, -step, side="left"))
            if now < live:  # these texts have ended
                for j in np.flatnonzero(bits[now:]).tolist():
                    found.append((part[now + j], step, int(bits[now + j])))
                live, state, bits, at = now, state[:now], bits[:now], at[:now]
            state = flat[state * width + data[at]]
            at = at + 1
            new = accepts[state]
            gone = bits & ~new
            if gone.any():
                for j in np.flatnonzero(gone).tolist():
                    found.append((part[j], step, int(gone[j])))
            bits = new
        for j in np.flatnonzero(bits[:live]).tolist():
            found.append((part[j], int(lengths[j]), int(bits[j])))
    return found


def scan(texts: list[bytes], rules: tuple, machines: tuple) -> list[list[tuple[int, int, int]]]:
    """For each text, (start, end, rule) in bytes: per rule the leftmost matches that don't overlap, without dropped ones, by start and rule.

    The last step of each rule is a run, so a match that begins at s ends at one place e(s), and e rises with s. The ends
    come from the pass over all texts; an end's match begins at the first place that reaches it, but not before the
    end of the match before it, which the rule's backward automaton finds."""
    machine, backwards = machines
    per: dict[tuple[int, int], list[int]] = {}
    for i, end, bits in _ends(texts, machine):
        for k in range(len(rules)):
            if bits >> k & 1:
                per.setdefault((i, k), []).append(end)
    out: list[list] = [[] for _ in texts]
    for (i, k), ends in per.items():
        text, rule, back = texts[i], rules[k], backwards[k]
        lead, last = re.compile(rule.lead), 0
        for end in sorted(ends):
            state, start, at = 0, -1, end
            while at > last and state != back.dead:
                at -= 1
                state = back.next[state, back.classes[text[at]]]
                if back.accepts[state]:
                    start = at
            if start < 0:
                continue
            last = end
            if end - (lead.match(text, start, end).end() if rule.lead else start) >= rule.least:
                out[i].append((start, end, k))
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


SPANS = "array<struct<kind: string, start: long, end: long>>"


def _redacted(text: bytes, found: list[tuple[int, int, int]], kinds: list[str]) -> bytes:
    parts, done = [], 0
    for s, e, k in found:
        if s >= done:
            parts += [text[done:s], b"[" + kinds[k].encode() + b"]"]
        done = max(done, e)
    return b"".join([*parts, text[done:]])


def _scanner(rules: tuple, machines: tuple, redact: bool):
    kinds = [r.kind for r in rules]
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in blocks(batches):
            texts = byte_texts(batch)
            spans, clean = [], []
            for text, found in zip(texts, scan(texts, rules, machines), strict=True):
                if not found:
                    spans.append([])
                    clean.append(text)
                    continue
                at = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80).tolist()  # code points up to and with each byte
                at = [0, *at]
                spans.append([{"kind": kinds[k], "start": at[s], "end": at[e]} for s, e, k in found])
                clean.append(_redacted(text, found, kinds))
            cols = [batch.column(0), pa.array(spans, item)] + ([pa.array(clean, pa.binary()).cast(pa.string())] if redact else [])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "spans", "redacted"][: len(cols)])

    return run


def find_secrets(docs: DataFrame, rules: tuple = BASE + ADDED, redact: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points, end exclusive; by start, then rule), and with redact the text
    with each secret replaced by its [kind].

    The rules are compiled once, on the driver, to one minimised automaton; a map over the splits runs it, without a shuffle. A text is
    scanned whole. Null or empty text: no spans. Null or repeated ids: rows of their own. Empty table: no rows. Overlapping secrets are
    replaced by the first one's kind. Other columns are not read."""
    schema = f"doc_id long, spans {SPANS}" + ", redacted string" * redact
    return texts_of(docs, doc_id, text).mapInArrow(_scanner(rules, compile_rules(rules), redact), schema)


def redact_secrets(docs: DataFrame, rules: tuple = BASE + ADDED) -> DataFrame:
    """docs with each secret in text replaced by its [kind], and n_chars, where there is one, as the new text's length. All rows and columns
    stay; a null text stays null."""
    machines, kinds = compile_rules(rules), [r.kind for r in rules]

    def run(batches):
        for batch in blocks(batches):
            names = batch.schema.names
            texts = byte_texts(batch)
            found = scan([t or b"" for t in texts], rules, machines)
            clean = pa.array([t if t is None or not f else _redacted(t, f, kinds) for t, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            columns = [clean.cast(batch.schema.field(n).type) if n == "text" else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
