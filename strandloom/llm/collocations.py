"""Collocations by Suffix-sigma.

Texts fall into pieces at punctuation and line ends, and into words at spaces. Every place of a piece starts a
suffix of at most ``max_words`` words. Suffixes are dealt out by first word, language and further words, and sorted
in reverse lexicographic order; there a suffix comes before its own prefixes, so one stack per partition, a
count for each word of the current suffix, gives the frequencies of all prefixes, that is of all phrases. The stack
takes a batch of suffixes in one step: where neighbours part, counts are closed, and what the last one has open stays.

* **Words first.** Words are counted before (one row per word and task is shuffled). Words under the least
  frequency are in no candidate and no part of one, so suffixes end before them. The frequent words
  go to the tasks as one bitmap of ``FILTER_BITS`` hashed bits, of fixed size whatever the vocabulary; a word that
  passes by chance costs a row, no more: its phrases fall out by their frequency. Suffixes of one word aren't
  needed any more.
* **Hot words.** The deal is by ranges over language and all words of the suffix, so a first word (or pair) of a third
  of all rows gets as many partitions as it has rows for; equal suffixes are added up in the tasks before
  the shuffle. Only the prefixes of a partition's first and last suffix can go on in another; these leave it at any
  count, all others from the least frequency on, and a last sum over these few rows joins them.
* **Parts.** The frequency table is written; candidates find the frequencies of their parts in it by equality joins, and
  what longer candidates cover by another. Quotients and products are decimals, exact beyond 64 bits.

Edge cases. A null text is empty; a null language is ``und`` and one with rows that say so. Words are compared as
they are, but for A-Z. Control characters that are no separators belong to words. Repeated rows count each. Extra
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, slices

LEAST = 30
MAX_WORDS = 4
FIRST = 2000
COVERED = 80  # per cent
#: Bits of the filter of frequent words: 8 MB.
FILTER_BITS = 1 << 26
#: Bytes of text that a task works on at a time, and words whose passing it remembers.
PART, HELD = 8 << 20, 200_000
#: Joins the words of a suffix. It is less than every character of a word, so a phrase and what goes on
#: from it lie together in the order; the few characters below it are spelled with ESCAPE.
JOINT, ESCAPE = "\t", "\x0e"
_LOW = re.compile(b"[\x00-\x08\x0e]")
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def words_of(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts in their order, and a number for each that words of one piece share."""
    joined = b"\n".join(t.encode() for t in texts).translate(_FOLD)
    if _LOW.search(joined):
        joined = _LOW.sub(lambda m: ESCAPE.encode() + bytes([m[0][0] + 64]), joined)
    held = np.frombuffer(joined, np.uint8)
    inside = (held != 32) & (held != 10)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(held[inside].tobytes()))
    return words, np.searchsorted(np.flatnonzero(held == 10), starts)


def _escaped(lang: str) -> str:
    return re.sub("[\x00-\x09\x0e]", lambda m: ESCAPE + chr(ord(m[0]) + 64), lang)


def _spelled(phrase: Column) -> Column:
    """A phrase (or a language) as it stands in the table, with spaces between its words."""
    spaced = F.translate(phrase, JOINT, " ")
    for low in (*range(10), 14):
        spaced = F.replace(spaced, F.lit(ESCAPE + chr(low + 64)), F.lit(ESCAPE if low == 14 else chr(low)))
    return F.when(F.instr(phrase, ESCAPE) > 0, spaced).otherwise(F.translate(phrase, JOINT, " "))


def _counted(documents: DataFrame, count, names: list[str]) -> DataFrame:
    """Columns ``names`` and n of what ``count(lang, texts)`` finds in the texts of a language that lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_rows, PART):
                texts: dict[str, list[str]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(text)
                for lang, its in texts.items():
                    *keys, n = count(_escaped(lang), its)
                    for at in range(0, len(n), 50_000):
                        yield pa.RecordBatch.from_arrays([k[at : at + 50_000] for k in (*keys, pa.array(n, pa.int64()))], names=[*names, "n"])

    texts = documents.where(F.length("text") > 0).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, ", ".join([*(f"{name} string" for name in names), "n long"]))


def _count_words(lang: str, texts: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    coded = words_of(texts)[0].dictionary_encode()
    return pa.repeat(lang, len(coded.dictionary)), coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))


def word_counts(documents: DataFrame) -> DataFrame:
    """lang, word and n of all words of ``documents`` (lang, text)."""
    return _counted(documents, _count_words, ["lang", "word"]).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _filter(words: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the hashes of (lang, word): at most ``bits`` / 8 bytes, whatever the number of words."""
    place = F.pmod(F.xxhash64(F.concat_ws(JOINT, "lang", "word")), F.lit(bits)) + 1  # the functions count from one
    made = words.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("held"))
    found = np.zeros(bits // 8, np.uint8)
    for row in made.collect():
        part = np.frombuffer(bytes(row["held"]), np.uint8)
        at = (row["b"] - 1) * len(part)
        found[at : at + len(part)] = part[: len(found) - at]
    return found


class Passing:
    """Whether words of a language pass the filter; what was asked is remembered up to a bound."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.lang, self.bits, self.known = lang, bits, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > HELD:
            known.clear()
        for w in words:
            if w not in known:
                h = xxhash.xxh64_intdigest(f"{self.lang}{JOINT}{w}".encode(), 42)
                h %= 8 * len(self.bits)  # a power of two divides the signed and the unsigned hash alike
                known[w] = bool(self.bits[h >> 3] >> (h & 7) & 1)
        return np.fromiter(map(known.__getitem__, words), bool, len(words))


def suffix_counts(lang: str, words: pa.StringArray, piece: np.ndarray, passing, max_words: int) -> tuple[pa.Array, np.ndarray]:
    """The different suffixes of 2 to ``max_words`` words, ended before words that don't pass, and how often each
    stands in ``words``. The first word has the language behind it, after a line end."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    there = passing(coded.dictionary.to_pylist())[codes] if len(codes) else np.zeros(0, bool)
    goes_on = np.zeros(len(codes) + max_words, bool)
    goes_on[: len(codes)][:-1] = there[:-1] & there[1:] & (piece[:-1] == piece[1:])
    places = np.flatnonzero(goes_on)
    padded = np.concatenate([codes, np.zeros(max_words, np.int64)])
    base = len(coded.dictionary) + 1
    columns, key, alive = [codes[places]], codes[places], np.ones(len(places), bool)
    limit = base  # keys are less than this
    for ahead in range(1, max_words):
        alive = alive & goes_on[places + ahead - 1]
        column = np.where(alive, padded[places + ahead] + 1, 0)  # nought: ended
        if limit * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            limit = len(key)
        key, limit = key * base + column, limit * base
        columns.append(column)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    led = pc.binary_join_element_wise(coded.dictionary, pa.scalar(lang), "\n")
    spelled = [led.take(pa.array(columns[0][first]))]
    spelled += [coded.dictionary.take(pa.array(c[first] - 1, mask=c[first] == 0)) for c in columns[1:]]
    return pc.binary_join_element_wise(*spelled, JOINT, null_handling="skip"), n


class Stack:
    """Counts of the prefixes of suffixes that come in descending order, batch by batch. Given out are prefixes of
    ``least`` or more, and those of the first and the last suffix at any count, as they may go on elsewhere."""

    def __init__(self, least: int, max_words: int):
        self.least, self.max_words = least, max_words
        self.words: list[str] = []  # of the last suffix
        self.counts: list[int] = []  # of its prefixes so far
        self.edge: int | None = None  # so many of its words have been there since the first suffix

    def batch(self, suffixes: pa.StringArray, n: np.ndarray) -> Iterator[tuple[str, int]]:
        rows = len(suffixes)
        if not rows:
            return
        parts = pc.split_pattern(suffixes, JOINT)
        offsets = parts.offsets.to_numpy()
        lengths = np.diff(offsets)
        coded = parts.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary
        table = np.full((rows, self.max_words), -1, np.int64)
        for m in range(self.max_words):
            has = np.flatnonzero(lengths > m)
            table[has, m] = codes[offsets[has] - offsets[0] + m]
        spell = lambda row, m: [names[int(c)].as_py() for c in table[row, :m]]
        same = np.zeros(rows, np.int64)  # words that a suffix shares with the one before it
        alive = np.ones(rows - 1, bool)
        for m in range(self.max_words):
            alive &= (table[1:, m] == table[:-1, m]) & (table[1:, m] >= 0)
            same[1:] += alive
        last = spell(rows - 1, lengths[-1])
        for a, b in zip(self.words, spell(0, lengths[0]), strict=False):
            if a != b:
                break
            same[0] += 1
        begun, edge = self.edge is not None, self.edge or 0
        counts = [0] * len(last)
        for m in range(1, self.max_words + 1):
            sums = np.concatenate([[0], np.cumsum(np.where(lengths >= m, n, 0))])
            starts = np.flatnonzero(same < m)
            if len(self.words) >= m:
                held = self.counts[m - 1] + int(sums[starts[0] if len(starts) else rows])
                if not len(starts):
                    counts[m - 1] = held
                elif held >= self.least or m <= edge:
                    yield JOINT.join(self.words[:m]), held
            if not len(starts):
                continue
            totals = sums[np.append(starts[1:], rows)] - sums[starts]
            its = lengths[starts] >= m
            out = its & (totals >= self.least)
            out[0] |= its[0] and not begun
            if its[-1]:  # goes on
                counts[m - 1], out[-1] = int(totals[-1]), False
            for k in np.flatnonzero(out):
                yield JOINT.join(spell(starts[k], m)), int(totals[k])
        stays = int(same[1:].min(initial=lengths[0]))
        self.edge = min(edge, int(same[0]), stays) if begun else stays
        self.words, self.counts = last, counts

    def end(self) -> Iterator[tuple[str, int]]:
        for m, held in enumerate(self.counts, 1):
            yield JOINT.join(self.words[:m]), held


def _suffix_counter(shared, max_words: int):
    passing: dict[str, Passing] = {}

    def count(lang: str, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        if lang not in passing:
            if len(passing) > 64:
                passing.clear()
            passing[lang] = Passing(lang, shared.value)
        return suffix_counts(lang, *words_of(texts), passing[lang], max_words)

    return count


def phrase_counts(documents: DataFrame, frequent: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, phrase (words joined by ``JOINT``) and f of all phrases of at most ``max_words`` words that occur
    ``least`` times or more; ``frequent`` has lang, word and n of all words that do."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(_filter(frequent))
    suffixes = _counted(documents, _suffix_counter(shared, max_words), ["suffix"])
    dealt = suffixes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.desc("suffix")).sortWithinPartitions(F.desc("suffix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(least, max_words)
        for batch in batches:
            yield _batch(list(stack.batch(batch.column(0), batch.column(1).to_numpy())))
        yield _batch(list(stack.end()))

    parts = dealt.mapInArrow(run, "lang string, phrase string, n long")
    # Prefixes of one word are left to ``frequent``: suffixes of one word weren't made.
    several = parts.where(F.instr("phrase", JOINT) > 0).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return several.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))


def _batch(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    """lang, phrase and n of prefixes, the language behind whose first word is put apart."""
    apart = []
    for prefix, n in rows:
        first, *others = prefix.split(JOINT)
        word, lang = first.split("\n", 1)
        apart.append((lang, JOINT.join([word, *others]), n))
    lang, phrase, n = zip(*apart, strict=True) if apart else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _big(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(documents: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, covered: int = COVERED, first: int = FIRST, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``first`` phrases of each language."""
    documents = documents.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # Written once: the words of a language in all, and the frequent ones.
    words = word_counts(documents)
    often = F.col("n") >= least
    words = durable(words.groupBy("lang", F.when(often, F.col("word")).alias("word")).agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    f = durable(phrase_counts(documents, words.where(F.col("word").isNotNull()), least, max_words))

    split = f.withColumn("words", F.split("phrase", JOINT)).where(F.size("words") > 1)
    joined = lambda words: F.array_join(words, JOINT)
    upto = F.sequence(F.lit(1), F.size("words") - 1)
    cuts = split.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(upto).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice("words", F.lit(1), F.col("k"))).alias("left"), joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"))
    side = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(2000000 * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    cuts = cuts.withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # (start, length) of the shorter phrases of two words or more within a longer one
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda at: joined(F.slice("words", at, m)))))
    longer = split.where(F.size("words") > 2).select("lang", F.col("f").alias("longer"), F.explode(inside).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _big("longer") < covered * _big("a")))

    kept = kept.select("lang", _spelled(F.col("phrase")).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place).where(F.col("rank") <= first)  # the limit goes before the shuffle too
    return ranked.join(totals, "lang").select(_spelled(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), w AS (SELECT id, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS place FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)
), totals AS (SELECT lang, count(*) AS n FROM w GROUP BY lang
), s AS MATERIALIZED (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id ORDER BY place)
), sizes(m) AS (VALUES (1), (2), (3), (4)
), f AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS ws FROM (
    SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM s WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  )
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM f c JOIN (VALUES (1), (2), (3)) ks(k) ON k < c.m
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1 : c.m], ' ')
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT f.lang, f.f AS longer, array_to_string(f.ws[i : i + s.m - 1], ' ') AS phrase FROM f JOIN sizes s ON s.m > 1 AND s.m < f.m JOIN (VALUES (1), (2), (3)) ats(i) ON i + s.m - 1 <= f.m
), covered AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL
), kept AS (
  SELECT lowest.lang, lowest.phrase, a, l, r, score FROM lowest LEFT JOIN covered ON covered.lang = lowest.lang AND covered.phrase = lowest.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
