"""Whole queries against plain versions that share no more than the random draws and hashes."""

import hashlib
import io
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import langid, media, mixing, quality
from strandloom.llm.queries import language_model, queries

SF = "/root/testdata/sf0.001"


# -- 1 -----------------------------------------------------------------------------------------------


def plain_area(image, rows, columns):
    """Means over rectangles by adding up every pixel's share, in fractions."""
    height, width = len(image), len(image[0])
    out = []
    for y in range(rows):
        top, bottom = Fraction(height * y, rows), Fraction(height * (y + 1), rows)
        line = []
        for x in range(columns):
            left, right = Fraction(width * x, columns), Fraction(width * (x + 1), columns)
            total = Fraction(0)
            for i in range(math.floor(top), math.ceil(bottom)):
                high = min(bottom, i + 1) - max(top, i)
                for j in range(math.floor(left), math.ceil(right)):
                    total += high * (min(right, j + 1) - max(left, j)) * image[i][j]
            line.append(total / ((bottom - top) * (right - left)))
        out.append(line)
    return out


def test_media_features_by_brute_force(spark):
    texts = ["", "a", "word " * 40, "ÄÖ" * 77, "x" * 64 * 33, "".join(chr(32 + i * 7 % 90) for i in range(3000))]
    got = {r.doc_id: r for r in media.text_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        raw = text.encode()
        raw += b"\0" * (-len(raw) % 64 if raw else 64)
        image = [list(raw[i : i + 64]) for i in range(0, len(raw), 64)]
        small = plain_area(image, 8, 9)
        bits = "".join(str(int(line[j + 1] - line[j] > Fraction(1, 10**9))) for line in small for j in range(8))
        digest, parts = hashlib.sha256(), 0
        for y in range(0, len(image), 32):
            for x in range(0, 64, 32):
                tile = np.array([line[x : x + 32] for line in image[y : y + 32]], np.uint8)
                out = io.BytesIO()
                np.save(out, tile)
                digest.update(out.getvalue())
                parts += 1
        feature = f"dhash:{int(bits, 2):016x};mean:{sum(raw) / len(raw):.6f};shape:{len(image)}x64"
        assert (got[k].feature, got[k].n_tiles, got[k].tiles_sha256) == (feature, parts, digest.hexdigest())


# -- 3 -----------------------------------------------------------------------------------------------


def test_languages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    drawn = langid.Profiles()
    kept: dict = {}

    def gram(three):
        if three not in kept:
            vector = np.ones(drawn.dimension, int)
            for place, c in enumerate(reversed(three)):
                vector = vector * np.roll(drawn.letter(ord(c) if c != " " else 0).astype(int), place)
            kept[three] = vector
        return kept[three]

    def unit(text):
        letters = " " + re.sub(r"[^\w]|[\d_]", " ", (text or "").lower()) + " "
        letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in letters))
        counts = Counter(letters[i : i + 3] for i in range(len(letters) - 2)) if letters.strip() else {}
        total = sum((n * gram(g) for g, n in counts.items()), np.zeros(drawn.dimension, int))
        return total / max(np.linalg.norm(total), 1e-9), sum(counts.values())

    rows = docs.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).collect()
    sums: dict = {}
    for r in rows:
        if r.fold and r.lang is not None and r.text is not None:
            sums[r.lang] = sums.get(r.lang, 0) + unit(r.text)[0]
    names = sorted(sums)
    prototypes = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    centred = prototypes - prototypes.mean(axis=0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    got = {r.doc_id: r for r in queries()["op3_langid"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        vector, n = unit(r.text)
        best = int(np.argmax(centred @ vector))
        want = (names[best], min(1.0, max(0.0, float(prototypes[best] @ vector)))) if n else ("und", 0.0)
        assert got[r.doc_id].lang_pred == want[0] and abs(got[r.doc_id].score - want[1]) < 1e-4 and got[r.doc_id].held_out == (r.fold == 0)
    kept_ids = {r.doc_id for r in langid.keep_identified(docs, language_model(docs)).collect()}
    for r in rows:
        vector, n = unit(r.text)
        score = float(prototypes[int(np.argmax(centred @ vector))] @ vector)
        least = max(0.0, 0.5 * math.sqrt(n * 0.002 / (1 + n * 0.002)) - 3 / 32)
        if abs(score - least) > 1e-3:
            assert (r.doc_id in kept_ids) == (n > 0 and score >= least)


# -- 5 -----------------------------------------------------------------------------------------------


def plain_slots(text):
    """Slots of a text's 1 to 3 characters and 1 to 2 word shapes, one by one in whole numbers."""
    wrap = (1 << 64) - 1
    slot = lambda code: ((code * 0x9E3779B97F4A7C15) & wrap) >> 46
    points = [ord(c) + 1 for c in text]
    codes = list(points) + [(a << 21 | b) & wrap for a, b in zip(points, points[1:], strict=False)]
    codes += [((a << 21 | b) << 21 | c) & wrap for a, b, c in zip(points, points[1:], points[2:], strict=False)]

    def shape(word):
        marks = "".join("A" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "a" if c in "abcdefghijklmnopqrstuvwxyz" else "0" if c in "0123456789" else c for c in word)
        marks = "".join(("A" if c.isupper() else "a") if re.match(r"[^\W\d_a]", c) else c for c in marks)
        short = "".join(c for i, c in enumerate(marks) if not i or marks[i - 1] != c)[:12]
        code = 0
        for c in short:
            code = (code * 1_000_003 + ord(c) + 1) & 0xFFFFFFFF
        return code

    words = re.findall(r"\S+", text)
    shapes = [shape(w) for w in words]
    codes += [s | 1 << 63 for s in shapes]
    codes += [(((a * 31 + b) * 2 + (v == w)) & wrap) | 3 << 62 for a, b, v, w in zip(shapes, shapes[1:], words, words[1:], strict=False)]
    return {slot(c) for c in codes}


def test_quality_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = docs.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).collect()
    slots = {r.doc_id: plain_slots(r.text or "") for r in rows}
    learned = [r for r in rows if r.fold != 2 and labels.get(r.doc_id) is not None]
    # The same descent over features and counts made here.
    ordered = sorted(((np.array(sorted(slots[r.doc_id]), "<i4").tobytes(), labels[r.doc_id]) for r in learned))
    order = np.random.default_rng(quality.SEED).permutation(len(ordered))
    found = [np.frombuffer(ordered[i][0], "<i4").astype(np.int64) for i in order]
    model = quality.fit(found, np.array([ordered[i][1] for i in order]))
    p, q = Counter(), Counter()
    for i, s in zip(order, found, strict=True):
        (p if ordered[i][1] else q).update(s.tolist())
    ratio = {s: math.log(((p[s] + 1) / (sum(p.values()) + quality.SLOTS)) / ((q[s] + 1) / (sum(q.values()) + quality.SLOTS))) for s in set(p) | set(q)}
    assert all(abs(model.weights[1][s] - r * r) < 1e-3 * max(1, r * r) for s, r in list(ratio.items())[:2000])
    got = {r.doc_id: r for r in queries()["op5_quality"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = sorted(slots[r.doc_id])
        total, square = sum(float(model.weights[0][s]) for s in own), sum(float(model.weights[1][s]) for s in own)
        margin = total / max(math.sqrt(square), 1e-9) + model.bias
        want = 1 / (1 + math.exp(-max(-40, min(40, model.slope * margin + model.offset))))
        assert abs(got[r.doc_id].score - want) < 1e-5 and got[r.doc_id].held_out == (r.fold == 2)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)


# -- 7 -----------------------------------------------------------------------------------------------


def highest_quotients(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))):
        i = max((i for i in range(len(votes)) if out[i] < most[i] and votes[i] > 0), key=lambda i: (Fraction(votes[i]) / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_mixing_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60 OR doc_id > 180")
    seed, block, per = mixing.SEED, mixing.BLOCK, 12
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\x0b\f\r]+"), lambda x: x != "")).cast("long")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), size.alias("size"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "size", "mark", F.lit(seed))).withColumn("order", F.xxhash64("doc_id", "mark", F.lit(seed), F.lit("order"))).collect()
    names = sorted({r.source for r in rows}, key=lambda x: (x is None, x or ""))
    words = [sum(r["size"] for r in rows if r.source == n) for n in names]
    goal = mixing.targets(words, [(5, 2, 1)[i % 3] for i in range(len(names))])
    blocks = highest_quotients(goal, round(sum(goal) / block), [2 * -(-w // block) for w in words])
    want = {}
    begins = {}
    for name, seats in zip(names, blocks, strict=True):
        own = [r for r in rows if r.source == name]
        shards = -(-len(own) // per)
        groups = max(1, math.isqrt(shards))
        held = {}
        for r in own:
            held.setdefault(r.hash % shards, []).append(r)
        totals = {k: sum(r["size"] for r in v) for k, v in held.items()}
        most = {k: 2 * -(-n // block) for k, n in totals.items()}
        of = sorted({k % groups for k in totals})
        quota = {}
        for g, n in zip(of, highest_quotients([sum(t for k, t in totals.items() if k % groups == g) for g in of], seats, [sum(m for k, m in most.items() if k % groups == g) for g in of]), strict=True):
            inside = sorted(k for k in totals if k % groups == g)
            quota |= dict(zip(inside, highest_quotients([totals[k] for k in inside], n, [most[k] for k in inside]), strict=True))
        for k, members in held.items():
            laid = [r.doc_id for r in sorted(members, key=lambda r: (r.order, r.doc_id, r["size"], r.mark)) for _ in range(r["size"])]
            n = max(1, -(-totals[k] // block))
            if (name, k) not in begins:
                begins[name, k] = spark.range(1).select(F.pmod(F.xxhash64(F.lit(name).cast("string"), F.lit(k).cast("int"), F.lit(seed)), F.lit(n)).alias("b")).first().b
            taken = Counter()
            for i in range(quota[k]):
                at = (begins[name, k] + i) % n
                taken.update(laid[at * block : (at + 1) * block])
            want |= {r.doc_id: taken[r.doc_id] for r in members}
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(docs, shard_rows=per).collect()}
    assert got == {r.doc_id: (r["size"], want[r.doc_id]) for r in rows}
