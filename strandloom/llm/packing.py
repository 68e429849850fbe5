"""Best-fit packing of tokenised documents by bin completion.

Documents become token ids plus an end id; only those over the sequence length are cut, into full
pieces and one shorter first piece. What is left to decide is how the pieces under the length share
sequences. Pieces of one length are interchangeable, so the problem is a histogram of at most
``length`` sizes, whatever the number of documents, and a solution is a list of patterns (which
sizes share a sequence) with multiplicities. That bounded problem is solved in one place:

* best-fit decreasing gives the first incumbent;
* bin completion takes the largest size left and enumerates the undominated fillings of the room beside
  it, of any number of pieces, the fullest first. A filling is dominated if some of its pieces could
  give way to one left-over piece that takes up no less (Martello and Toth). Each branches into its
  use as often as the counts allow and its use once;
* the waste so far is checked against what a better packing than the incumbent may waste, and only
  fillings within it are made; a state that was met with as few sequences is left;
* nodes are completed by best fit, and a better completion is the new incumbent: every node with fewer
  than 32 sizes left, and of wider ones one in so many nodes as 32 goes into its sizes.

The search ends when the incumbent meets the lower bound or everything is tried, or else after
``work`` steps (about a size or a partial filling looked at each), where the incumbent stands.

Documents then find their places without any being gathered: pieces are numbered within (length,
bucket), buckets get offsets from a table of counts, and a number within a length falls in the range
of one slot of a pattern, looked for among those of its bucket's range.

Edge cases. A null or empty text is the end id alone. Repeated rows and ids are pieces of their own.
Extra columns are dropped; an empty table gives an empty result. The name of a special token in a text
is that token, as the tokenizer has it.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_lists

LENGTH = 2048
END_ID = 0
#: Steps of the search, a few seconds' worth.
WORK = 400_000
#: The special token that is not in the rank file.
SPECIAL = {"<|endoftext|>": 50_256}

Patterns = list[tuple[tuple[int, ...], int]]


# -- Tokens ------------------------------------------------------------------------------------


def tokenizer(path: str) -> Callable[[str], list[int]]:
    """Ids of a text, no special token added, by a ``.json`` or ``.tiktoken`` vocabulary file."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        held = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        named = lambda text: held.encode(text, allowed_special="all")
        return lambda text: named(text) if any(x in text for x in SPECIAL) else held.encode_ordinary(text)
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(path)
    return lambda text: held.encode(text, add_special_tokens=False).ids


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: a shorter first one, then full ones."""
    first = n % length or min(n, length)
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces(documents: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids_crc32 of every piece of every row."""

    def make():
        ids_of = tokenizer(vocabulary)

        def each(texts):
            rows = []
            for i, x in enumerate(texts):
                ids = np.array([*(ids_of(x) if x else ()), end_id], "<u4")
                rows += [(i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())) for k, (start, n) in enumerate(cut(len(ids), length))]
            return [list(x) for x in zip(*rows, strict=True)] or [[]] * 5

        return each

    return map_lists(documents.select(key, text), make, {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}, keep=key)


# -- Bin completion on a histogram -------------------------------------------------------------


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Patterns:
    """Largest first, each into the fullest sequence that has room; equal sequences go together."""
    bins: dict[int, Counter] = {}  # room left -> patterns with it
    rooms: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size  # new sequences, filled with this size alone
                whole, rest = divmod(left, each)
                for pattern, times in (((size,) * each, whole), ((size,) * rest, 1 if rest else 0)):
                    if times:
                        _put(bins, rooms, capacity - sum(pattern), pattern, times)
                break
            room = rooms[at]
            pattern, times = next(iter(bins[room].items()))
            each = room // size
            use = min(times, left // each)
            if not use:
                each, use = left, 1
            bins[room][pattern] -= use
            if not bins[room][pattern]:
                del bins[room][pattern]
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            _put(bins, rooms, room - each * size, pattern + (size,) * each, use)
            left -= use * each
    return [(pattern, times) for _, found in sorted(bins.items()) for pattern, times in sorted(found.items(), reverse=True)]


def _put(bins: dict[int, Counter], rooms: list[int], room: int, pattern: tuple[int, ...], times: int) -> None:
    if room not in bins:
        bins[room] = Counter()
        bisect.insort(rooms, room)
    bins[room][pattern] += times


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and of the bound that pairs large sizes with what fits."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for threshold in [0, *(s for s in sizes if s <= capacity // 2)]:
        large = sum(n for s, n in counts.items() if s > capacity - threshold)
        middle = {s: n for s, n in counts.items() if capacity // 2 < s <= capacity - threshold}
        small = sum(s * n for s, n in counts.items() if threshold <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in middle.items())
        best = max(best, large + sum(middle.values()) + max(0, -(-(small - room) // capacity)))
    return best


def sums(counts: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """For each k the sums up to ``room`` of some of the first k sizes, within their counts, as bits."""
    now, out = 1, [1]
    whole = (1 << room + 1) - 1
    for size in sizes:
        left, step = min(counts[size], room // size), 1
        while left > 0:
            step = min(step, left)
            now |= now << size * step
            left -= step
            step *= 2
        now &= whole
        out.append(now)
    return out


def fillings(counts: dict[int, int], sizes: list[int], room: int, waste: int, work: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room`` but for at most ``waste``, the fullest first and of equally full
    ones those of larger pieces, but for a first pair. ``sizes``: those with a count, ascending.
    ``work``: the steps left; there are no more fillings after them."""
    sizes = sizes[: bisect.bisect_right(sizes, room)]
    if sizes and sizes[-1] == room:  # a piece that fills the room dominates everything
        yield (room,)
        return
    first = next(((a, room - a) for a in reversed(sizes) if 2 * a >= room and counts.get(room - a, 0) > (2 * a == room)), None)
    if first:
        yield first
    bits = sums(counts, sizes, room)
    work[0] -= len(sizes)
    there = 0
    for size in sizes:
        there |= 1 << size
    for total in range(room, max(room - waste, 0) - 1, -1):
        if bits[-1] >> total & 1:
            for part in _adding_up(counts, sizes, bits, total, work):
                if part != first and not _dominated(counts, there, part, room - total):
                    yield part


def _adding_up(counts: dict[int, int], sizes: list[int], bits: list[int], total: int, work: list[int]) -> Iterator[tuple[int, ...]]:
    """The ways to add up to ``total``. None is begun that can't be ended."""
    stack = [(len(sizes), total, ())]
    while stack and work[0] > 0:
        work[0] -= 1
        k, total, part = stack.pop()
        if not total:
            yield part
            continue
        k = bisect.bisect_right(sizes, total, 0, k)
        if not k or not bits[k] >> total & 1:
            continue
        size = sizes[k - 1]
        # Of several the last is taken up first: more of the larger.
        for n in range(min(counts[size], total // size) + 1):
            if bits[k - 1] >> total - n * size & 1:
                stack.append((k - 1, total - n * size, part + (size,) * n))


def _dominated(counts: dict[int, int], there: int, part: tuple[int, ...], room: int) -> bool:
    """Is there a left-over piece that none, one or more of the filling's pieces could give way to,
    without overflow, and that takes up no less (more than a single one)?"""
    used = Counter(part)
    for size, n in used.items():
        if n == counts[size]:
            there ^= 1 << size
    single = several = 0
    for size in part:
        several |= several << size | single << size
        single |= 1 << size
    return bool(there & (_smeared(1 << 1, room - 1) | _smeared(single << 1, room - 1) | _smeared(several, room)))


def _smeared(bits: int, width: int) -> int:
    """Every bit and the ``width`` bits above it; nothing for a negative width."""
    if width < 0:
        return 0
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def bin_completion(counts: dict[int, int], capacity: int = LENGTH, work: int = WORK) -> Patterns:
    """Patterns that pack the histogram into few sequences; the best of the search."""
    counts = {s: n for s, n in sorted(counts.items()) if n}
    if not counts:
        return []
    bound = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    best_n = sum(n for _, n in best)
    total = sum(s * n for s, n in counts.items())
    seen: dict[bytes, int] = {}
    steps, since = [work], 0
    # A node: the sequences used, their waste, how it came about, and its branches. What is left is held
    # of the last node only: a search of thousands of nodes goes deep.
    stack: list[tuple] = []
    now = [counts]

    def enter(counts: dict[int, int], used: int, waste: int, chosen: tuple | None) -> None:
        nonlocal best, best_n, since
        steps[0] -= 1 + len(counts) // 8
        since += 1
        state = hashlib.blake2b(np.array([*counts, *counts.values()], np.int64), digest_size=16).digest()
        if seen.get(state, used + 1) <= used:
            return
        seen[state] = used
        if 32 * since >= len(counts):
            since = 0
            steps[0] -= 4 * len(counts)
            rest = best_fit_decreasing(counts, capacity)
            n = used + sum(times for _, times in rest)
            if n < best_n:
                best, best_n = _listed(chosen) + rest, n
        if counts and best_n > bound:
            sizes = sorted(counts)
            largest = sizes[-1]
            if counts[largest] == 1:
                sizes.pop()
            now[0] = counts
            ways = fillings(_Others(now, largest), sizes, capacity - largest, (best_n - 1) * capacity - total - waste, steps)
            stack.append((used, waste, chosen, _branches(now, largest, ways)))

    enter(counts, 0, 0, None)
    while stack and best_n > bound and steps[0] > 0:
        used, waste, chosen, branches = stack[-1]
        pattern, times = next(branches, (None, 0))
        if not times:
            stack.pop()
            if chosen is not None:
                now[0] = _put_back(now[0], *chosen[1:])
            continue
        lost = waste + times * (capacity - sum(pattern))
        if lost > (best_n - 1) * capacity - total:
            steps[0] -= 1
            continue
        left = dict(now[0])
        for size, n in Counter(pattern).items():
            left[size] -= times * n
            if not left[size]:
                del left[size]
        enter(left, used + times, lost, (chosen, pattern, times))
    return best


class _Others:
    """What is left (a list of its histogram) without one of the largest pieces."""

    def __init__(self, now: list[dict[int, int]], largest: int):
        self.now, self.largest = now, largest

    def __getitem__(self, size: int) -> int:
        return self.now[0][size] - (size == self.largest)

    def get(self, size: int, default: int = 0) -> int:
        return self[size] if size in self.now[0] else default


def _put_back(counts: dict[int, int], pattern: tuple[int, ...], times: int) -> dict[int, int]:
    """The histogram before the pattern was taken from it, the sizes ascending as always."""
    out = Counter(counts)
    for size in pattern:
        out[size] += times
    return dict(sorted(out.items()))


def _branches(now: list[dict[int, int]], largest: int, ways: Iterator[tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], int]]:
    for way in ways:
        pattern = (largest, *way)
        times = min(now[0][s] // n for s, n in Counter(pattern).items())
        yield pattern, times
        if times > 1:
            yield pattern, 1


def _listed(chosen: tuple | None) -> Patterns:
    out = []
    while chosen is not None:
        chosen, pattern, times = chosen
        out.append((pattern, times))
    return out[::-1]


# -- Places ------------------------------------------------------------------------------------


def slots_of(patterns: Patterns) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a length go: those numbered [low, high) of it lie ``each`` to a sequence, from
    sequence ``first`` and place ``offset`` on. A row per pattern and size of it."""
    slots, taken, first = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for size, each in Counter(pattern).items():
            slots.append((size, taken[size], taken[size] + times * each, first, offset, each))
            taken[size] += times * each
            offset += size * each
        first += times
    return slots


def pack(cuts: DataFrame, length: int = LENGTH, work: int = WORK) -> DataFrame:
    """``cuts`` (a row per piece, with ``length``) with sequence_id and offset."""
    spark = cuts.sparkSession
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32)
    sized = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    sized = durable(sized)
    per_bucket = durable(sized.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    # At most ``length`` rows.
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(length, 0)
    patterns = bin_completion(counts, length, work) + ([((length,), full)] if full else [])
    # As many slots as the patterns have sizes, which lengths and steps of the search bound.
    table = spark.createDataFrame(slots_of(patterns), "length long, low long, high long, first long, offset long, each long")
    by_size = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "offset", "each"))).alias("slots"))
    # Where a bucket's pieces begin among those of its length, and the slots that they fall in.
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(by_size, "length")
    meets = F.filter("slots", lambda s: (s["low"] < F.col("before") + F.col("n")) & (F.col("before") < s["high"]))
    ranges = begun.select("length", "bucket", "before", meets.alias("slots"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sized.withColumn("rank", F.row_number().over(within) - 1)
    placed = ranked.join(ranges, ["length", "bucket"]).withColumn("number", F.col("rank") + F.col("before"))
    found = placed.withColumn("slot", F.filter("slots", lambda s: (s["low"] <= F.col("number")) & (F.col("number") < s["high"]))[0])
    at = F.col("number") - F.col("slot.low")
    sequence = F.col("slot.first") + F.floor(at / F.col("slot.each"))
    return found.select(*cuts.columns, sequence.alias("sequence_id"), (F.col("slot.offset") + at % F.col("slot.each") * F.col("length")).alias("offset"))


def pack_documents(documents: DataFrame, vocabulary: str, length: int = LENGTH, work: int = WORK) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack(pieces(documents, vocabulary, length), length, work)
