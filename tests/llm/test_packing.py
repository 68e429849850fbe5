"""Bin completion: fillings by brute force, optima of perfect packings, and slots."""

import itertools
import random
import tracemalloc
from collections import Counter

import pytest

from strandloom.llm import packing


def all_fillings(counts, room):
    sizes = sorted(counts)
    for times in itertools.product(*(range(counts[s] + 1) for s in sizes)):
        if sum(s * n for s, n in zip(sizes, times, strict=True)) <= room:
            yield tuple(s for s, n in zip(sizes, times, strict=True) for _ in range(n))


def dominated(counts, part, room):
    """By trying every subset of the filling against every piece left over."""
    left = [s for s, n in counts.items() if n > part.count(s)]
    free = room - sum(part)
    for k in range(len(part) + 1):
        for some in itertools.combinations(part, k):
            total = sum(some)
            for x in left:
                if (x > total if k < 2 else x >= total) and x - total <= free:
                    return True
    return False


def test_fillings_by_brute_force():
    dice = random.Random(2)
    for _ in range(150):
        counts = {s: dice.randint(1, 3) for s in dice.sample(range(1, 14), dice.randint(1, 6))}
        room = dice.randint(1, 22)
        waste = dice.randint(0, room)
        want = {p for p in all_fillings(counts, room) if sum(p) >= room - waste and not dominated(counts, p, room)}
        got = [tuple(sorted(p)) for p in packing.fillings(counts, sorted(counts), room, waste, [10**6])]
        if room in counts:  # it dominates all others
            assert got == [(room,)]
        else:
            assert set(got) == want and len(got) == len(want), (counts, room, waste)
            assert [sum(p) for p in got] == sorted((sum(p) for p in got), reverse=True)


@pytest.mark.parametrize("capacity,sequences", [(60, 5), (60, 40), (200, 12), (2048, 4), (2048, 12), (2048, 60)])
def test_perfect_packings_of_five_to_seven_pieces(capacity, sequences):
    dice = random.Random(capacity + sequences)
    for _ in range(10):
        counts = Counter()
        for _ in range(sequences):
            cuts = sorted(dice.sample(range(1, capacity), dice.randint(4, 6)))
            counts.update(b - a for a, b in zip([0, *cuts], [*cuts, capacity], strict=True))
        got = packing.bin_completion(dict(counts), capacity)
        assert sum(n for _, n in got) == sequences
        assert Counter({s: sum(p.count(s) * n for p, n in got) for s in counts}) == counts


def test_short_documents_share_sequences():
    """All of 300 to 420: five or six to a sequence, better than best fit alone."""
    dice = random.Random(1)
    counts = {s: dice.randint(1, 10**5) for s in range(300, 421)}
    got = packing.bin_completion(counts)
    assert max(len(p) for p, _ in got) >= 5 and all(sum(p) <= packing.LENGTH for p, _ in got)
    assert {s: sum(p.count(s) * n for p, n in got) for s in counts} == counts
    assert sum(n for _, n in got) < 0.99 * sum(n for _, n in packing.best_fit_decreasing(counts, packing.LENGTH))


def test_slots_give_every_piece_a_place_of_its_own():
    patterns = [((5, 5, 3), 2), ((5, 3, 3), 1), ((3,), 4)]
    places = []
    for size, low, high, first, offset, each in packing.slots_of(patterns):
        for number in range(low, high):
            at = number - low
            places.append((first + at // each, offset + at % each * size, size))
    assert len(places) == len({x[:2] for x in places}) == 2 * 3 + 3 + 4
    for sequence, rows in itertools.groupby(sorted(places), key=lambda x: x[0]):
        rows = list(rows)
        assert [x[1] for x in rows] == [0, *itertools.accumulate(x[2] for x in rows[:-1])], sequence


def test_a_deep_search_holds_one_histogram():
    """Thousands of nodes of two thousand sizes: the driver holds what is left of the last one only."""
    dice = random.Random(41)
    counts = Counter(min(2047, 1 + int(dice.lognormvariate(6.2, 0.8))) for _ in range(50_000))
    tracemalloc.start()
    got = packing.bin_completion(dict(counts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    used = Counter()
    for pattern, times in got:
        assert sum(pattern) <= packing.LENGTH
        for size in pattern:
            used[size] += times
    assert used == counts and sum(times for _, times in got) <= sum(times for _, times in packing.best_fit_decreasing(counts, packing.LENGTH))
    assert peak < 40e6
