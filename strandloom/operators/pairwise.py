"""Pairwise global alignment: exact seed matches hold, dynamic programming fills what lies between.

``align_pairs`` takes rows with two sequences. Seeds are maximal exact matches of at least ``seed`` characters,
found by the words that each sequence has once; the longest counts first, and others only as far as
they lie before or after all that hold already, cut where they overlap. The rests between seeds are aligned with
unit costs (a mismatch, a character against a gap) by diagonals, each one numpy step, several pairs' rests of a
batch side by side. Of equally cheap alignments the one counts that, read from the end, prefers a column of two
characters to a gap in the second sequence, and that to a gap in the first.

Without a seed (``seed`` None) the alignment is the cheapest of all. With seeds it is the cheapest of those that keep
them; two long sequences that are much alike then cost about as much as the places where they differ. The rests of a
pair together may have ``most_cells`` cells (a byte each, held while a pair is aligned): beyond, the pair's strings and
counts are null and ``aligned`` is false; smaller seeds leave smaller rests.

Edge cases. A null sequence has a null alignment. An empty one is all gaps; two empty ones are 0 columns of identity
null. Repeated rows are aligned each; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 1 << 28
#: Cells that are filled side by side; a pair that has more goes alone.
SIDE_BY_SIDE = 1 << 24
DIAGONAL, LEFT_ONLY, RIGHT_ONLY = 0, 1, 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _once(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that occur once, sorted, and their places."""
    if len(codes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.zeros(len(codes) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - k + 1 + i].astype(np.uint64) + np.uint64(1)
    found, first, n = np.unique(hashed, return_index=True, return_counts=True)
    return found[n == 1], first[n == 1]


def seed_matches(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the seeds that hold, in order."""
    words_a, at_a = _once(a, k)
    words_b, at_b = _once(b, k)
    _, i, j = np.intersect1d(words_a, words_b, assume_unique=True, return_indices=True)
    x, y = at_a[i], at_b[j]
    same = np.array([np.array_equal(a[p : p + k], b[q : q + k]) for p, q in zip(x, y, strict=True)], bool)
    x, y = x[same], y[same]
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    # Words that follow one another on a diagonal make one match, stretched as far as it goes.
    matches: list[tuple[int, int, int]] = []
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        if matches and matches[-1][0] - matches[-1][1] == p - q and p + k <= matches[-1][0] + matches[-1][2]:
            continue
        n = k
        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
            n += 1
        while p and q and a[p - 1] == b[q - 1]:
            p, q, n = p - 1, q - 1, n + 1
        matches.append((p, q, n))
    held: list[tuple[int, int, int]] = []
    for p, q, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
        before = max((h for h in held if h[0] < p and h[1] < q), default=None)
        after = min((h for h in held if h[0] >= p or h[1] >= q), default=None)
        if before is not None:
            cut = max(before[0] + before[2] - p, before[1] + before[2] - q, 0)
            p, q, n = p + cut, q + cut, n - cut
        if after is not None:
            n = min(n, after[0] - p, after[1] - q)
        if n >= k:
            held.append((p, q, n))
            held.sort()
    return held


def _fill(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The steps of the cheapest alignment of each pair, first column first. All are filled side by side,
    diagonal by diagonal; of a cell only the direction that it came from is kept."""
    rows, columns = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    n = len(pairs)
    left, right = np.zeros((n, rows + 1), np.uint32), np.full((n, columns + 1), 0xFFFFFFFF, np.uint32)
    for i, (a, b) in enumerate(pairs):
        left[i, 1 : len(a) + 1], right[i, 1 : len(b) + 1] = a, b
    steps = np.zeros((rows + columns + 1, n, min(rows, columns) + 1), np.uint8)
    far = np.int32(rows + columns + 9)
    # before[.., i]: the cell in row i of the diagonal before; rows beyond a diagonal's ends are far.
    older, before = np.full((n, rows + 1), far, np.int32), np.full((n, rows + 1), far, np.int32)
    before[:, 0] = 0
    for d in range(1, rows + columns + 1):
        low, high = max(0, d - columns), min(rows, d)
        at = np.arange(low, high + 1)
        now = np.full((n, rows + 1), far, np.int32)
        both = np.full((n, len(at)), far, np.int32)
        inner = (at > 0) & (at < d)
        i = at[inner]
        both[:, inner] = older[:, i - 1] + (left[:, i] != right[:, d - i])
        down = np.where(at > 0, before[:, np.maximum(at - 1, 0)], far) + 1  # a character of the left one
        along = np.where(at < d, before[:, at], far) + 1
        best = np.minimum(both, np.minimum(down, along))
        now[:, low : high + 1] = best
        steps[d, :, : len(at)] = np.where(both == best, DIAGONAL, np.where(down == best, LEFT_ONLY, RIGHT_ONLY))
        older, before = before, now
    out = []
    for k, (a, b) in enumerate(pairs):
        i, j, path = len(a), len(b), []
        while i or j:
            d = i + j
            step = int(steps[d, k, i - max(0, d - columns)])
            path.append(step)
            i, j = i - (step != RIGHT_ONLY), j - (step != LEFT_ONLY)
        out.append(np.array(path[::-1], np.uint8))
    return out


def _groups(rests: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[int]]:
    """Numbers of rests of like sizes that are filled together."""
    group: list[int] = []
    rows = columns = 0
    for i in sorted(range(len(rests)), key=lambda i: (len(rests[i][0]), len(rests[i][1]))):
        r, c = max(rows, len(rests[i][0])), max(columns, len(rests[i][1]))
        if group and (len(group) + 1) * (r + c + 1) * (min(r, c) + 1) > SIDE_BY_SIDE:
            yield group
            group, r, c = [], len(rests[i][0]), len(rests[i][1])
        group.append(i)
        rows, columns = r, c
    if group:
        yield group


def paths(pairs: list[tuple[np.ndarray, np.ndarray]], seed: int | None = None, most_cells: int = MOST_CELLS) -> list[np.ndarray | None]:
    """The steps of each pair's alignment, a column each."""
    plans: list[list | None] = []  # of each pair its parts: a number of a rest, or a seed's steps
    rests: list[tuple[np.ndarray, np.ndarray]] = []
    for x, y in pairs:
        held = seed_matches(x, y, seed) if seed else []
        i = j = 0
        plan, its = [], []
        for p, q, n in [*held, (len(x), len(y), 0)]:
            its.append((x[i:p], y[j:q]))
            plan += [len(rests) + len(its) - 1, np.zeros(n, np.uint8)]
            i, j = p + n, q + n
        cells = sum((len(u) + len(v) + 1) * (min(len(u), len(v)) + 1) for u, v in its)
        if cells > most_cells:
            plans.append(None)
            continue
        rests += its
        plans.append(plan)
    steps: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(rests)
    full = [i for i, (u, v) in enumerate(rests) if len(u) and len(v)]
    for i, (u, v) in enumerate(rests):
        if not len(u) or not len(v):
            steps[i] = np.concatenate([np.full(len(u), LEFT_ONLY, np.uint8), np.full(len(v), RIGHT_ONLY, np.uint8)])
    for group in _groups([rests[i] for i in full]):
        for i, path in zip(group, _fill([rests[full[i]] for i in group]), strict=True):
            steps[full[i]] = path
    return [plan and np.concatenate([steps[part] if isinstance(part, int) else part for part in plan]) for plan in plans]


def _spread(codes: np.ndarray, there: np.ndarray) -> str:
    line = np.full(len(there), ord("-"), np.uint32)
    line[there] = codes
    return line.tobytes().decode("utf-32-le")


def _with_paths(pairs: DataFrame, a: str, b: str, seed: int | None, most_cells: int, each, new: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``pairs`` with columns made by ``each(codes of a, codes of b, steps)``; null where a sequence is null."""
    names = [f"__sl_{n}" for n in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = list(zip(part.column(a).to_pylist(), part.column(b).to_pylist(), strict=True))
                there = [i for i, (u, v) in enumerate(texts) if u is not None and v is not None]
                codes = [(_codes(texts[i][0]), _codes(texts[i][1])) for i in there]
                found: list[tuple] = [(None,) * len(new)] * len(texts)
                for i, (u, v), steps in zip(there, codes, paths(codes, seed, most_cells), strict=True):
                    found[i] = each(u, v, steps)
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*found, strict=True), new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), *(f"{n} {kind}" for n, (kind, _) in zip(names, new.values(), strict=True))])
    done = pairs.mapInArrow(run, schema)
    return done.select(*pairs.columns, *(F.col(f"__sl_{n}").alias(n) for n in new))


def align_pairs(pairs: DataFrame, a: str, b: str, seed: int | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """``pairs`` with aligned (a boolean), a_gapped, b_gapped, matches (columns of two equal characters), paired
    (columns without a gap), columns, and identity (matches in percent of the paired ones; null without any)."""

    def each(x: np.ndarray, y: np.ndarray, steps: np.ndarray | None) -> tuple:
        if steps is None:
            return (False, *(None,) * 5)
        in_x, in_y = steps != RIGHT_ONLY, steps != LEFT_ONLY
        both = in_x & in_y
        same = x[(np.cumsum(in_x) - 1)[both]] == y[(np.cumsum(in_y) - 1)[both]]
        return True, _spread(x, in_x), _spread(y, in_y), int(same.sum()), int(both.sum()), len(steps)

    new = {"aligned": ("boolean", pa.bool_()), "a_gapped": ("string", pa.string()), "b_gapped": ("string", pa.string())} | {n: ("long", pa.int64()) for n in ("matches", "paired", "columns")}
    return _with_paths(pairs, a, b, seed, most_cells, each, new).withColumn("identity", F.when(F.col("paired") > 0, 100 * F.col("matches") / F.col("paired")))


def region_of(pairs: DataFrame, reference: str, read: str, begin: int, end: int, seed: int | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """``pairs`` with ``region``: the characters of ``read`` from the one aligned to ``begin`` to that aligned to
    ``end`` (places of ``reference`` from 1; without one there, what lies between counts); empty where there is none,
    null where the pair isn't aligned or the reference ends before."""

    def each(x: np.ndarray, y: np.ndarray, steps: np.ndarray | None) -> tuple:
        if steps is None or len(x) < end:
            return (None,)
        in_x, in_y = steps != RIGHT_ONLY, steps != LEFT_ONLY
        upto = np.cumsum(in_x)  # characters of the reference up to each column
        first, last = np.searchsorted(upto, begin), np.searchsorted(upto, end)
        held = np.cumsum(in_y)
        return (y[held[first] - in_y[first] : held[last]].tobytes().decode("utf-32-le"),)

    return _with_paths(pairs, reference, read, seed, most_cells, each, {"region": ("string", pa.string())})
