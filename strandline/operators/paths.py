"""Best monotone paths over pairs of texts of which only few are compared.

A pair's similarity has a cheap upper bound, from the characters that its texts have in common. The best path by these bounds can't be worse
than the best path; once all its pairs have been compared, it is that path. So the pairs of the path are compared, and the bounds of what it
leaves out stand for the rest: each round compares the path's new pairs and the best-bounded pairs of every text, twice as many as the round
before.

Searches are generators that yield the pairs they want compared, so that those of many jobs are compared together."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator, Sequence

import numpy as np

from strandline.functions.similar import bags, bound, ratios

STEPS = 255  # of a bound, rounded up
ROWS = 256  # of a table of bounds that are made together
CELLS = 1 << 22  # of tables of bounds that jobs which are searched together have, about
JOB = 1 << 13  # cells that a job counts for beyond its own: what its search holds besides

#: A search: yields (first texts, second texts), is sent their similarities, and returns its result.
Search = Generator[tuple[list[str], list[str]], np.ndarray, tuple[np.ndarray, int, int]]


def together(searches: Sequence[Search]) -> list[tuple[np.ndarray, int, int]]:
    """The results of searches whose pairs are compared together, round by round."""
    results: list = [None] * len(searches)
    answers: dict[int, np.ndarray | None] = dict.fromkeys(range(len(searches)))
    while answers:
        asked = {}
        for k, answer in answers.items():
            try:
                asked[k] = searches[k].send(answer)
            except StopIteration as end:
                results[k] = end.value
        found = ratios([x for a, _ in asked.values() for x in a], [y for _, b in asked.values() for y in b])
        ends = np.cumsum([len(a) for a, _ in asked.values()])
        answers = {k: part for k, part in zip(asked, np.split(found, ends[:-1]) if len(ends) else [], strict=True)}
    return results


def in_turn(jobs: Iterable[tuple[int, Callable[[], Search]]]) -> Iterator[tuple[np.ndarray, int, int]]:
    """The results of jobs (cells of its tables, its search), of about CELLS cells together, but one job at least."""
    held, size = [], 0
    for cells, search in jobs:
        if held and size + cells + JOB > CELLS:
            yield from together([s() for s in held])
            held, size = [], 0
        held.append(search)
        size += cells + JOB
    if held:
        yield from together([s() for s in held])


def runs(texts: Sequence[str], n: int) -> list[str]:
    """Every n neighbouring texts, joined."""
    return ["".join(texts[k : k + n]) for k in range(len(texts) - n + 1)]


class Pairs:
    """Similarities of all texts on the left with all on the right: a byte's bound each, and what has been compared."""

    def __init__(self, left: list[str], right: list[str]):
        self.left, self.right = left, right
        both = bags([*left, *right])
        a, b = both[: len(left)], both[len(left) :]
        self.bounds = np.empty((len(left), len(right)), dtype=np.uint8)
        for k in range(0, len(left), ROWS):
            self.bounds[k : k + ROWS] = np.ceil(bound(a[k : k + ROWS], b) * STEPS - 1e-9)
        self.known = self.bounds == 0  # nothing in common: 0
        self.values: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(left)

    def row(self, k: int) -> np.ndarray:
        """Similarities of one text on the left, bounds where they aren't known."""
        out = self.bounds[k] / STEPS
        at, values = self.values[k]
        out[at] = values
        return out

    def get(self, k: int, j: int) -> float:
        at, values = self.values[k]
        found = np.flatnonzero(at == j)
        return float(values[found[0]]) if len(found) else 0.0

    def best_open(self, most: int, rows: np.ndarray | None = None) -> np.ndarray:
        """(row, column) of the `most` best-bounded pairs of each row, or of those marked in rows, that aren't known."""
        out = []
        for k in range(len(self.left)) if rows is None else np.flatnonzero(rows).tolist():
            open_ = np.flatnonzero(~self.known[k])
            if len(open_) > most:
                open_ = open_[np.argpartition(self.bounds[k, open_], -most)[-most:]]
            out.append(np.stack([np.full(len(open_), k), open_], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)

    def put(self, at: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(at[:, 0], kind="stable")
        at, values = at[order], values[order]
        for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at[:, 0])) + 1):
            if len(rows):
                k = int(at[rows[0], 0])
                old = self.values[k]
                self.values[k] = np.concatenate([old[0], at[rows, 1]]), np.concatenate([old[1], values[rows]])
        self.known[at[:, 0], at[:, 1]] = True


def compare(kinds: list[Pairs], wanted: list[np.ndarray]) -> Generator[tuple[list[str], list[str]], np.ndarray, None]:
    """Has the wanted (row, column) of each kind of pairs compared that aren't known."""
    todo = []
    for p, at in zip(kinds, wanted, strict=True):
        at = at[~p.known[at[:, 0], at[:, 1]]] if len(at) else np.zeros((0, 2), dtype=np.int64)
        todo.append(np.unique(at, axis=0))
    first = [p.left[k] for p, at in zip(kinds, todo, strict=True) for k in at[:, 0].tolist()]
    second = [p.right[j] for p, at in zip(kinds, todo, strict=True) for j in at[:, 1].tolist()]
    found = yield first, second
    begin = 0
    for p, at in zip(kinds, todo, strict=True):
        p.put(at, found[begin : begin + len(at)])
        begin += len(at)


Step = tuple[int, int, int]


def settled(kinds: list[Pairs], solve: Callable[[], list[Step]]) -> Generator[tuple[list[str], list[str]], np.ndarray, list[Step]]:
    """The steps (kind, row, column) of the best path, all of whose pairs are known. solve gives the best path by what is known so far."""
    most = 0
    while True:
        path = solve()
        on = [np.array([(r, c) for k, r, c in path if k == kind], dtype=np.int64).reshape(-1, 2) for kind in range(len(kinds))]
        if all(p.known[at[:, 0], at[:, 1]].all() for p, at in zip(kinds, on, strict=True)):
            return path
        yield from compare(kinds, [np.concatenate([at, p.best_open(most)]) if most else at for p, at in zip(kinds, on, strict=True)])
        most = 2 * most or 1


def shares(kinds: list[Pairs]) -> tuple[int, int]:
    """(pairs that were compared, all pairs)."""
    return sum(len(v) for p in kinds for v, _ in p.values), sum(p.known.size for p in kinds)


#: (blocks, stamped lines) of a group, in the order in which equal ways into a cell are preferred.
GROUPS = ((3, 1), (2, 1), (1, 3), (1, 2), (1, 1))
SKIP, MERGE = 0.12, 0.04  # for a stamped line that is left out; for each text beyond two in a group


def cover(n: int, m: int, row: Callable[[int, int], np.ndarray]) -> list[tuple[int, int, int]]:
    """The groups (which of GROUPS, first block, first line) that cover n blocks, in order, with the most gain; of m lines some may be left
    out at SKIP each. None if no groups do.

    row(g, b): the gains of group g from block b on with every line."""
    sums = np.full((n + 1, m + 1), -np.inf)
    took = np.full((n + 1, m + 1), len(GROUPS), dtype=np.int8)
    sums[0, 0] = 0.0
    for b in range(n + 1):
        if b:
            ways = np.full((len(GROUPS), m + 1), -np.inf)
            for g, (high, wide) in enumerate(GROUPS):
                if high <= b and wide <= m:
                    ways[g, wide:] = sums[b - high, : m + 1 - wide] + row(g, b - high)
            took[b], sums[b] = ways.argmax(axis=0), ways.max(axis=0)
        line, left_out = sums[b].tolist(), []
        for at in range(m):  # where a line is left out depends on whether the one before is
            if line[at] - SKIP > line[at + 1]:
                line[at + 1] = line[at] - SKIP
                left_out.append(at + 1)
        sums[b], took[b, left_out] = line, len(GROUPS)
    if sums[n, m] == -np.inf:
        return []
    groups, b, at = [], n, m
    while b or at:
        if took[b, at] == len(GROUPS):
            at -= 1
            continue
        g = int(took[b, at])
        b, at = b - GROUPS[g][0], at - GROUPS[g][1]
        groups.append((g, b, at))
    return groups[::-1]


def best_groups(blocks: Sequence[str], lines: Sequence[str]) -> Search:
    """(rows (b, bc, i, ic, score) of the groups of keys that cover all blocks with the most gain, pairs compared, all pairs)."""
    kinds = [Pairs(runs(blocks, high), runs(lines, wide)) for high, wide in GROUPS]
    less = [MERGE * (high + wide - 2) for high, wide in GROUPS]
    path = yield from settled(kinds, lambda: cover(len(blocks), len(lines), lambda g, b: kinds[g].row(b) - less[g]))
    return np.array([(b, GROUPS[g][0], i, GROUPS[g][1], kinds[g].get(b, i)) for g, b, i in path]).reshape(-1, 5), *shares(kinds)


UNMATCHED, LEFT = 0.18, 0.03  # for a block that matches nothing; for each segment that is left at the end
WIDEST = 6  # segments that a block may match


def follow(n: int, m: int, most: int, row: Callable[[int, int], np.ndarray]) -> list[tuple[int, int]]:
    """(j, k) of each of n blocks on the path with the most gain over m segments; j == k where a block matches nothing, at UNMATCHED.
    Segments left at the end cost LEFT each.

    row(d, b): the gains of block b with every d neighbouring segments, up to `most`. Among equal ways into a cell the one from the earliest
    segment wins."""
    sums, took = np.full(m + 1, -np.inf), np.zeros((n, m + 1), dtype=np.int8)
    sums[0] = 0.0
    for b in range(n):
        ways = np.full((most + 1, m + 1), -np.inf)  # of the longest step first
        for d in range(most + 1):
            ways[most - d, d:] = sums[: m + 1 - d] + (row(d, b) if d else -UNMATCHED)
        first = ways.argmax(axis=0)
        took[b], sums = most - first, ways[first, np.arange(m + 1)]
    at, path = int(np.argmax(sums - LEFT * (m - np.arange(m + 1)))), []
    for b in range(n - 1, -1, -1):
        d = int(took[b, at])
        path.append((at - d, at))
        at -= d
    return path[::-1]


def best_path(blocks: Sequence[str], segments: Sequence[str], starts: np.ndarray, ends: np.ndarray) -> Search:
    """(rows (j, k, score) of each block's key on the path with the most gain over the segments' keys, pairs compared, all pairs). A match
    loses as its length is far from 3.2 s."""
    most = min(WIDEST, len(segments))
    kinds = [Pairs(list(blocks), runs(segments, d)) for d in range(1, most + 1)]
    lengths = [np.maximum(0.1, ends[d - 1 :] - starts[: len(starts) - d + 1]) for d in range(1, most + 1)]
    less = [np.minimum(0.18, np.abs(x - 3.2) * 0.015) for x in lengths]
    steps: list[tuple[int, int]] = []

    def solve() -> list[tuple[int, int, int]]:
        steps[:] = follow(len(blocks), len(segments), most, lambda d, b: kinds[d - 1].row(b) - less[d - 1])
        return [(k - j - 1, b, j) for b, (j, k) in enumerate(steps) if k > j]

    yield from settled(kinds, solve)
    return np.array([(j, k, kinds[k - j - 1].get(b, j) if k > j else 0.0) for b, (j, k) in enumerate(steps)]).reshape(-1, 3), *shares(kinds)


BETTER = 0.03  # by more than that a later line of a block must resemble a run of segments better


def best_scores(lines: Sequence[str], segments: Sequence[str], most: int = 3, pos: Sequence[int] | None = None) -> Search:
    """(the greatest similarity of each key with any run of one to `most` neighbouring segments' keys, pairs compared, all pairs).

    With pos, the places of the lines in their blocks from 0 on, only what can be chosen is searched: of lines that aren't better than their block's first
    by more than BETTER some lesser similarity or 0 is given."""
    kinds = [Pairs(list(lines), runs(segments, d)) for d in range(1, min(most, len(segments)) + 1)]
    known = np.zeros(len(lines))
    first = np.ones(len(lines), dtype=bool) if pos is None else np.asarray(pos) == 0
    block = np.maximum.accumulate(np.where(first, np.arange(len(lines)), 0))
    for own in (first, ~first):
        least = np.where(own, 0.0 if own is first else known[block] + BETTER, np.inf)
        many = 1
        while own.any():
            todo = []
            for p in kinds:
                at = p.best_open(many, own)
                todo.append(at[p.bounds[at[:, 0], at[:, 1]] / STEPS > np.maximum(known, least)[at[:, 0]]])
            if not any(map(len, todo)):
                break
            yield from compare(kinds, todo)
            for p in kinds:
                known = np.maximum(known, [v.max(initial=0.0) for _, v in p.values])
            many *= 2
    return known, *shares(kinds)
