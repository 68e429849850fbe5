"""Many primers, or other short patterns, found in reads at once, with mismatches and on both strands.

A primer that matches with at most ``mismatches`` other characters has one of its ``mismatches + 1`` pieces unchanged.
The pieces of all primers make one sorted index; each word of a read is looked up in it once, whatever the number of
primers, and what it leads to is compared in full. All of it is numpy over the reads of a batch laid end to end.

Primers are shipped in blocks of at most ``BLOCK`` (some MB); each block is one pass over the reads, so their number is
bounded by time only. Reads are never shuffled to be searched; the best match per read and strand is chosen in the
task, and among blocks by one aggregate.

Bases of primers may be ambiguity codes (``ambiguous``): a piece is then indexed by all that it stands for, up to
``SPELLED`` ways; a primer with more in all its pieces is an error.

Edge cases. A null read has no match; characters that no primer has simply don't match; the case of a to z doesn't count. Primers
without name or sequence are left out, as are those shorter than their number of pieces; equal ones are each
their own. Repeated reads are searched each; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .patterns import CODES, UPPER
from .records import match_barcodes

BLOCK = 20_000
SPELLED = 256
_TIMES = np.uint64(0x9E3779B97F4A7C15)
#: A, C, G and T or U as bits, so that a code and a base match if they share one.
_BIT = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = max(len(codes) - q + 1, 0)
    found = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q if n else 0):
            found = found * _TIMES + codes[i : i + n] + np.uint64(1)
    return found


def _bits(codes: np.ndarray) -> np.ndarray:
    table = np.zeros(128, np.uint8)
    for c, own in CODES.items():
        table[ord(c)] = sum({_BIT[x] for x in own if x in _BIT})
    return np.where(codes < 128, table[np.minimum(codes, np.uint64(127)).astype(np.int64)], 0)


class Index:
    """The pieces of a block of primers."""

    def __init__(self, primers: list[tuple[str, str]], mismatches: int, ambiguous: bool):
        self.names = [name for name, _ in primers]
        self.mismatches, self.ambiguous = mismatches, ambiguous
        texts = [text.translate(UPPER) for _, text in primers]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.codes = np.zeros((len(texts), int(self.length.max(initial=0))), np.uint64)
        for i, t in enumerate(texts):
            self.codes[i, : len(t)] = _codes(t)
        #: Pieces of one length each: (length, sorted hashes, primer and place of the piece in it).
        self.pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for i, t in enumerate(texts):
            cuts = [len(t) * k // (mismatches + 1) for k in range(mismatches + 2)]
            ways = [self._ways(t[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            if any(w > SPELLED for w in ways):
                raise ValueError(f"a piece of primer {self.names[i]} stands for more than {SPELLED} words")
            for a, b in zip(cuts, cuts[1:], strict=False):
                spelled = product(*(sorted(CODES[c] - {"U"} if ambiguous and c in CODES and c in "RYSWKMBDHVN" else {c}) for c in t[a:b]))
                plain = {"".join(x) for x in spelled}
                if ambiguous:
                    plain = {p.translate(_TO_T) for p in plain}
                by_length.setdefault(b - a, []).extend((int(_hashes(_codes(p), b - a)[0]), i, a) for p in plain)
        for q, held in sorted(by_length.items()):
            h, i, a = zip(*sorted(held), strict=True)
            self.pieces.append((q, np.array(h, np.uint64), np.array(i), np.array(a)))

    def _ways(self, piece: str) -> int:
        n = 1
        for c in piece:
            n *= len(CODES[c] & set("ACGT")) if self.ambiguous and c in "RYSWKMBDHVN" else 1
        return n

    def find(self, texts: list[str], most_begin: int | None) -> tuple[np.ndarray, ...]:
        """read, primer, begin and mismatches of every match, each once."""
        codes = [_codes(t.translate(UPPER).translate(_TO_T) if self.ambiguous else t.translate(UPPER)) for t in texts]
        starts = np.cumsum([0, *(len(c) + 1 for c in codes)])
        line = np.full(int(starts[-1]), np.uint64(1 << 40))  # no character between the reads
        for s, c in zip(starts, codes, strict=False):
            line[s : s + len(c)] = c
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for q, hashes, primer, place in self.pieces:
            words = _hashes(line, q)
            low, high = np.searchsorted(hashes, words), np.searchsorted(hashes, words, side="right")
            at = np.flatnonzero(high > low)
            n = (high - low)[at]
            which = np.repeat(low[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append((primer[which], np.repeat(at, n) - place[which]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        primer, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        once = np.unique(np.stack([primer, begin]), axis=1)
        primer, begin = once[:, once[1] >= 0]
        read = np.searchsorted(starts, begin, side="right") - 1
        own = np.array([len(c) for c in codes], np.int64)
        fits = (begin - starts[read] + self.length[primer] <= own[read]) & ((most_begin is None) | (begin - starts[read] <= (most_begin or 0)))
        primer, begin, read = primer[fits], begin[fits], read[fits]
        apart = np.zeros(len(primer), np.int64)
        bits = _bits(line) if self.ambiguous else None
        for k in range(self.codes.shape[1]):
            there = np.flatnonzero(k < self.length[primer])
            mine, theirs = self.codes[primer[there], k], begin[there] + k
            same = mine == line[theirs]
            if bits is not None:
                same |= (_bits(mine) & bits[theirs]) != 0
            apart[there] += ~same
        good = apart <= self.mismatches
        return read[good], primer[good], (begin - starts[read])[good], apart[good]


_TO_T = str.maketrans("U", "T")


def _index_blocks(primers: DataFrame, mismatches: int, ambiguous: bool) -> Iterator[Index]:
    held: list[tuple[str, str]] = []
    rows = primers.where(F.col("name").isNotNull() & (F.length("seq") > mismatches)).select(F.col("name").cast("string"), F.col("seq")).orderBy("name", "seq")
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == BLOCK:
            yield Index(held, mismatches, ambiguous)
            held = []
    yield Index(held, mismatches, ambiguous)


HIT = "struct<mismatches:int,begin:int,name:string,length:int>"


def find_primers(reads: DataFrame, seq: str, primers: DataFrame, mismatches: int = 2, most_begin: int | None = None, ambiguous: bool = True, into: str = "primer") -> DataFrame:
    """``reads`` with ``into``, a struct (mismatches, begin from 0, name, length) of the best match of any primer (name,
    seq): the fewest mismatches, then the first place, then the smallest name; null without a match."""
    found = reads
    for n, index in enumerate(_index_blocks(primers, mismatches, ambiguous)):
        found = _search(found, seq, index, most_begin, f"__sl_hit{n}")
    hits = [c for c in found.columns if c.startswith("__sl_hit")]
    best = F.col(hits[0]) if len(hits) == 1 else F.least(*hits)  # nulls are passed over
    return found.withColumn(into, best).drop(*hits)


def _search(reads: DataFrame, seq: str, index: Index, most_begin: int | None, into: str) -> DataFrame:
    shared = reads.sparkSession.sparkContext.broadcast(index)
    kind = pa.struct([("mismatches", pa.int32()), ("begin", pa.int32()), ("name", pa.string()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(seq).to_pylist()
                there = [i for i, t in enumerate(texts) if t is not None]
                best: list[dict | None] = [None] * len(texts)
                if there and len(index.names):
                    read, primer, begin, apart = index.find([texts[i] for i in there], most_begin)
                    names = np.array(index.names)[primer] if len(primer) else np.zeros(0, str)
                    order = np.lexsort((names, begin, apart, read))
                    first = order[np.unique(read[order], return_index=True)[1]]
                    for k in first:
                        best[there[read[k]]] = {"mismatches": int(apart[k]), "begin": int(begin[k]), "name": str(names[k]), "length": int(index.length[primer[k]])}
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, kind)], names=[*part.schema.names, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema), f"{into} {HIT}"])
    return reads.mapInArrow(run, schema)


def primer_pairs(reads: DataFrame, seq: str, forward: DataFrame, reverse: DataFrame, mismatches: int = 2, most_begin: int | None = None, ambiguous: bool = True) -> DataFrame:
    """``reads`` with f_primer and r_primer (as ``find_primers``): the best forward primer on the read as it is, the best
    reverse primer on its reverse complement, whose begin counts from that one's start; and pair, the name that both
    share, if they do."""
    turned = find_primers(reads, seq, forward, mismatches, most_begin, ambiguous, "f_primer").withColumn("__sl_turned", reverse_complement(F.col(seq)))
    both = find_primers(turned, "__sl_turned", reverse, mismatches, most_begin, ambiguous, "r_primer").drop("__sl_turned")
    return both.withColumn("pair", F.when(F.col("f_primer.name") == F.col("r_primer.name"), F.col("f_primer.name")))


def cross_matches(pairs: DataFrame) -> DataFrame:
    """forward, reverse and reads: how often each two primers meet on a read of ``primer_pairs``."""
    both = pairs.where("f_primer IS NOT NULL AND r_primer IS NOT NULL")
    return both.groupBy(F.col("f_primer.name").alias("forward"), F.col("r_primer.name").alias("reverse")).agg(F.count("*").alias("reads"))


def demultiplex_reads(reads: DataFrame, seq: str, primers: DataFrame, barcodes: DataFrame, mismatches: int = 2, most_gap: int = 0, values: str | None = None, least: float = 0.0, ambiguous: bool = True) -> DataFrame:
    """``reads`` turned so that their primer lies forward, with primer, strand, sample and outcome: the primer is looked
    for on both strands (the better match counts, on a tie the read as it is), the barcode before it by
    ``records.match_barcodes``, its quality by the values of its own bases, which are turned along. Reads without a
    primer stay as they are, with a null strand, sample and outcome."""
    turned = find_primers(reads, seq, primers, mismatches, None, ambiguous, "__sl_plus").withColumn("__sl_turned", reverse_complement(F.col(seq)))
    both = find_primers(turned, "__sl_turned", primers, mismatches, None, ambiguous, "__sl_minus")
    back = F.col("__sl_minus").isNotNull() & (F.col("__sl_plus").isNull() | (F.col("__sl_minus.mismatches") < F.col("__sl_plus.mismatches")))
    hit: Column = F.when(back, F.col("__sl_minus")).otherwise(F.col("__sl_plus"))
    oriented = both.withColumn("__sl_back", back).withColumn("primer", hit).withColumn("strand", F.when(F.col("primer").isNotNull(), F.when(F.col("__sl_back"), "-").otherwise("+")))
    oriented = oriented.withColumn(seq, F.when(F.col("__sl_back"), F.col("__sl_turned")).otherwise(F.col(seq))).withColumn("__sl_at", F.col("primer.begin"))
    if values is not None:
        oriented = oriented.withColumn(values, F.when(F.col("__sl_back"), F.reverse(values)).otherwise(F.col(values)))
    found = match_barcodes(oriented, seq, "__sl_at", barcodes, most_gap, values, least)
    return found.drop("__sl_plus", "__sl_minus", "__sl_turned", "__sl_back", "__sl_at")
