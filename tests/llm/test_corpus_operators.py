"""Corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import htmltext, langid, media, mixing, packing, quality, simhash, topk, urlfilter, warc
from strandloom.llm.queries import VOCABULARY, queries

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size int, length string, fp long, score double"


def documents(spark, texts, start=0):
    rows = [(None if t == "no id" else i + start, t, "en" if i % 3 else None, ["a", None, "b"][i % 3], None, 1, "x", 2, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


ODD = ["", None, " \t\n", "a", "Ä", "no id", "word " * 5000, "same text of five words here", "same text of five words here", "x" * 30_000, "日本語のテキスト", "!!! ???", "one two", "one  two", "ONE two", "\u00a0"]


# -- 1 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 16), (5, 4, 3), (2, 3, 3)])
def test_netpbm_and_bmp_round_trip(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    for encode in (media.encode_pgm, media.encode_bmp):
        assert np.array_equal(media.decode(encode(image)), image)


def test_netpbm_kinds():
    assert media.decode(b"P1 # note\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n# top\n255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    wide = np.array([[1, 500]], np.uint16)
    assert np.array_equal(media.decode(media.encode_pgm(wide)), wide)
    for broken in (None, b"", b"P5", b"P5 4 4 255\n123", b"BM", b"P9 1 1 1\n1", b"P5 0 3 255\n"):
        assert media.decode(broken) is None


def test_area_resize_by_brute_force():
    image = np.random.default_rng(2).random((7, 13))
    fine = np.repeat(np.repeat(image, 5, axis=0), 4, axis=1)  # 35 x 52 cells divide evenly
    want = fine.reshape(5, 7, 4, 13).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 5, 4), want)


def test_tiles_round_trip():
    image = np.arange(70 * 33, dtype=np.uint16).reshape(70, 33)
    assert np.array_equal(media.untile(media.tiles(image)), image)


def test_media_columns(spark):
    image = np.random.default_rng(3).integers(0, 256, (40, 50, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(1, media.encode_bmp(image)), (2, None), (3, b"junk")], "id long, data binary")
    got = {r.id: r for r in media.media_features(rows, "id", "data").collect()}
    assert (got[1].height, got[1].width, got[1].channels) == (40, 50, 3) and got[2].dhash is None and got[3].height is None
    parts = [(r.tile_row, r.tile_column, r.npy) for r in media.media_tiles(rows, "id", "data").collect()]
    assert np.array_equal(media.untile(parts), image)
    assert media.media_tiles(rows, "id", "data", shape=(8, 8)).count() == 1


def test_text_payloads(spark):
    got = media.text_features(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    want = {}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want[None if t == "no id" else i] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want
    assert len({(r.feature, r.media_sha256) for r in got if r.doc_id in (7, 8)}) == 1
    stored = {r.doc_id: r.media for r in media.text_media(documents(spark, ODD)).collect()}
    assert all(len(stored[r.doc_id]) == r.media_bytes and hashlib.sha256(stored[r.doc_id]).hexdigest() == r.media_sha256 for r in got)


# -- 2 -------------------------------------------------------------------------------------------


def optimum(sizes, capacity):
    """Fewest sequences, by trying all."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(room)
            place(i + 1, rooms[:k] + [room - sizes[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


def test_bin_completion_against_optimum():
    dice = random.Random(5)
    for _ in range(150):
        capacity = dice.choice([20, 37, 60])
        sizes = [dice.randint(1, capacity - 1) for _ in range(dice.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        got = packing.bin_completion(counts, capacity)
        assert all(sum(p) <= capacity for p, _ in got)
        used = {s: sum(p.count(s) * n for p, n in got) for s in counts}
        assert used == counts
        assert packing.lower_bound(counts, capacity) <= optimum(sizes, capacity)
        assert sum(n for _, n in got) == optimum(sizes, capacity)


def test_bin_completion_on_many():
    dice = random.Random(6)
    counts = {s: dice.randint(0, 60) for s in range(1, 2048, 3)}
    got = packing.bin_completion(counts, 2048)
    assert sum(n for _, n in got) <= 1.01 * packing.lower_bound({s: n for s, n in counts.items() if n}, 2048)


def test_packing_of_documents(spark):
    texts = [*ODD, "an <|endoftext|> in a text<|endoftext|>", *(" ".join(f"tok{i}" for i in range(k * 37)) for k in range(1, 40))]
    got = packing.pack_documents(documents(spark, texts), VOCABULARY).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    official = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = [*official.encode(t or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id.isna() if t == "no id" else got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.piece.tolist() == [*range(len(mine))]
        assert len(mine) == -(-len(ids) // 2048) and (len(mine) == 1 or mine.length.max() <= 2048)
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


# -- 3 and 5 -------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    got = queries()["op3_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert held.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    model = langid.learn(documents(spark, [f"the cat and the dog {i}" for i in range(30)]))
    assert model.languages == ["en"]
    got = {r.doc_id: r for r in langid.predict(documents(spark, ODD), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 11, 15)] == ["und"] * 5 and got[3].lang_pred == "en" and len(got) == len(ODD)
    assert got[7].score == got[8].score
    nothing = langid.learn(documents(spark, []))
    assert {r.lang_pred for r in langid.predict(documents(spark, ODD), nothing).collect()} == {"und"}
    kept = langid.keep_identified(documents(spark, ODD), model, 0.0)
    assert kept.columns == documents(spark, []).columns and kept.count() == len(ODD) - 5


def test_ngram_vectors_are_nearly_orthogonal():
    p = langid.Profiles()
    a, b, c = (p.ngram(p.codes(x)[1]).astype(int) for x in ("abc", "acb", "bca"))
    assert a @ a == p.dimension and max(abs(int(x @ y)) for x, y in ((a, b), (b, c), (a, c))) < 5 * p.dimension**0.5
    v, _ = p.bundle(["abab"])
    want = sum(p.ngram(x).astype(float) for x in p.codes("abab").tolist())
    assert np.array_equal(v[0], want)


def test_quality_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries()["op5_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.98
    assert ((held.score >= 0.7) == (held.predicted == 1)).all()


def test_quality_of_odd_texts(spark):
    none = quality.learn(documents(spark, []).withColumn("quality", F.lit(1)))
    assert {r.score for r in quality.predict(documents(spark, ODD), none).collect()} == {0.5}
    good = documents(spark, [f"a fair line of text {i}" for i in range(20)]).withColumn("quality", F.lit(1))
    bad = documents(spark, [f"### $$$ {i} ###" for i in range(20)], 50).withColumn("quality", F.lit(0))
    model = quality.learn(good.union(bad).union(bad.withColumn("quality", F.lit(None).cast("int"))))
    got = {r.doc_id: r for r in quality.predict(documents(spark, ["a fair text", "$$$ ###", *ODD]), model).collect()}
    assert got[0].predicted == 1 and got[1].predicted == 0 and got[2].score == got[3].score
    assert quality.keep_good(documents(spark, ["a fair line of text", "$$$ ###"]), model).count() == 1


def test_dual_coordinate_descent_reaches_the_optimum():
    dice = np.random.default_rng(1)
    slots = [np.unique(dice.integers(0, 40, 8)) for _ in range(60)]
    labels = np.where(np.array([5 in s or 7 in s for s in slots]), 1, -1)
    w, b = quality.dual_coordinate_descent(slots, np.ones(quality.SLOTS), labels, passes=400, tolerance=1e-7)
    most = np.where(labels > 0, max(1, (labels < 0).sum() / (labels > 0).sum()), max(1, (labels > 0).sum() / (labels < 0).sum()))
    x = np.zeros((60, 40))
    for i, s in enumerate(slots):
        x[i, s] = 1 / np.sqrt(len(s))
    value = lambda w, b: 0.5 * (w @ w + b * b) + (most * np.maximum(0, 1 - labels * (x @ w + b))).sum()
    here = value(w[:40], b)
    for _ in range(300):
        assert here <= value(w[:40] + dice.normal(0, 0.02, 40), b + dice.normal(0, 0.02)) + 1e-6


# -- 4 -------------------------------------------------------------------------------------------


def brute_top(rows, k):
    v = [(i, np.floor(1024 * np.array(x, float)).astype(int)) for i, x in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x)]
    out = []
    for i, q in v:
        if i % 100 == 0:
            found = sorted((-int(q @ p), j) for j, p in v if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_by_brute_force(spark, spread):
    dice = np.random.default_rng(7)
    rows = [(int(i), (dice.normal(size=16) * np.exp(spread * dice.normal())).tolist()) for i in range(1200)]
    rows += [(1200 + i, rows[7][1]) for i in range(300)]  # ties
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16), (None, rows[0][1]), (2100, [0.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = topk.top_k(table, F.col("vec_id") % 100 == 0, bucket=64, block=5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 10)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(table.where("vec_id in (100, 3)"), F.col("vec_id") % 100 == 0).count() == 1


def test_pruning_prunes():
    dice = np.random.default_rng(8)
    v = (dice.normal(size=(4000, 16)) * np.exp(1.5 * dice.normal(size=4000))[:, None] * 1000).astype(np.int64)
    order = np.argsort(-(v.astype(float) ** 2).sum(axis=1))
    search = topk.Retrieval(np.arange(10), v[:10], np.full(10, -np.inf), 5)
    for at in range(0, 4000, 250):
        search.bucket(order[at : at + 250], v[order[at : at + 250]])
    assert search.verified < 0.5 * 10 * 4000


# -- 6 -------------------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    rest = rest[:cut]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fit = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_url_rules_by_brute_force(spark):
    hosts = ["example.com", "EXAMPLE.com", "a.b.example.com", "com", "xcom", "example.net", "notexample.net", "w.example.net", "org", "a.org", "a.org.", "", "a..com", "ÄB.com"]
    paths = ["", "/", "/en/", "/en/7", "/en/70?x=/de/", "/en", "/de/8", "/de/9#top", "/es/1", "?/en/7", "#", "/EN/7"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)] + [None, "", "no scheme/en/7", "x://", "a://b://c/en/", "://com/en/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("keys", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(rows).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(urls)}
    assert urlfilter.filter_urls(rows.limit(0)).count() == 0


def test_cascade_is_exact_with_tiny_filters(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = keys.where("key like '%7'")
    levels = urlfilter.build_cascade(listed, keys, bits_per_key=4, hashes=2)
    assert len(levels) > 2
    test = urlfilter.member(spark, levels)
    got = keys.withColumn("x", test(F.array(F.xxhash64("key")), F.array(F.xxhash64("key", F.lit("second"))))[0])
    assert got.where("x <> (key like '%7')").count() == 0


# -- 7 -------------------------------------------------------------------------------------------


def test_apportionment_by_brute_force():
    dice = random.Random(3)
    for _ in range(200):
        votes = [dice.choice([0.0, dice.random() * 100]) for _ in range(dice.randint(1, 6))]
        most = [dice.randint(0, 30) for _ in votes]
        seats = dice.randint(0, 50)
        out = [0] * len(votes)
        for _ in range(seats):
            quotients = [(v / (2 * k + 1), -i) for i, (v, k, m) in enumerate(zip(votes, out, most, strict=True)) if k < m and v > 0]
            if quotients:
                out[-max(quotients)[1]] += 1
        assert mixing.sainte_lague(votes, seats, most) == out


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200.0, 450 - 200 - 250 / 3, 250 / 3])
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_mixing(spark):
    dice = random.Random(9)
    texts = [" ".join(["w"] * dice.randint(0, 400)) for _ in range(600)]
    got = mixing.mix(documents(spark, [*ODD, *texts]), shard_rows=50).toPandas()
    assert len(got) == len(ODD) + 600 and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    import re

    want = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate([*ODD, *texts]) if t != "no id"}
    assert {int(i): n for i, n in zip(got.doc_id, got["size"], strict=True) if i == i} == want
    by = got.groupby(got.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), given=("source_size", "first"))
    assert (by["size"] == by.given).all() and (abs(by.taken / by.target - 1) < 0.01).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6
    again = mixing.mix(documents(spark, [*ODD, *texts]).repartition(7), shard_rows=50).toPandas()
    assert dict(zip(got.doc_id.fillna(-1), got.taken, strict=True)) == dict(zip(again.doc_id.fillna(-1), again.taken, strict=True))
    assert mixing.mix(documents(spark, ["", None])).where("taken <> 0").count() == 0 and mixing.mix(documents(spark, [])).count() == 0


def test_mixed_documents(spark):
    table = documents(spark, [f"some words of text {i}" for i in range(400)])
    rows = mixing.mixed_documents(table)
    assert rows.columns == table.columns
    assert abs(rows.count() - 600) <= 12 and rows.groupBy("doc_id").count().where("count > 2").count() == 0


# -- 8 -------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x &amp; y<script>z</script></p>"), (2, None, None), (3, "u", "é\r\n\r\n")], "page_id long, url string, html string")
    records = warc.derive(warc.response_records(pages))
    warc.write_warc(records, str(tmp_path / "w"))
    back = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    made = records.collect()
    assert len(made) == 6 == len(back)
    for r in made:
        assert bytes(back[r.record_id].block).decode() == r.block and back[r.record_id].refers_to == r.refers_to
        assert back[r.record_id].block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and back[r.record_id].target_uri == r.target_uri
    texts = {r.page_id: r for r in made if r.warc_type == "conversion"}
    assert texts[1].block == "x & y" and texts[2].block == "" and texts[3].block == "é"
    facts = {r.page_id: r for r in made if r.warc_type == "metadata"}
    assert all(texts[i].concurrent_to == facts[i].record_id and texts[i].refers_to == facts[i].refers_to for i in (1, 2, 3))
    assert "http-status: 200" in facts[1].block and f"source-payload-digest: {facts[1].source_payload_digest}" in facts[1].block


def test_warc_references_scripts_and_headers(spark):
    html = "<p>caf&eacute; it&#8217;s &#x27;x&#x27; &mdash; &amp;lt; a&nbsp;b &nosuch; &lt;</p><script>var hidden = 1;<p>gone"
    responses = warc.response_records(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    more = "HTTP/1.1 200 OK\r\nDate: Mon, 01 Jan 2024 00:00:00 GMT\r\nContent-Type: text/html; charset=latin-1\r\nLocation: /a\r\n  b\r\nContent-Length: 9\r\n\r\nabc"
    other = responses.withColumn("page_id", F.lit(2).cast("long")).withColumn("block", F.lit(more))
    made = {(r.page_id, r.warc_type): r.block for r in warc.derive(responses.unionByName(other)).collect()}
    assert made[1, "conversion"] == "café it’s 'x' — &lt; a b &nosuch; <"
    assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in made[1, "metadata"]
    want = ["Date: Mon, 01 Jan 2024 00:00:00 GMT", "Content-Type: text/html; charset=latin-1", "Location: /a b", "Content-Length: 9"]
    assert [x.removeprefix("source-header: ") for x in made[2, "metadata"].split("\r\n") if x.startswith("source-header: ")] == want


# -- 9 -------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, prints, budget=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= budget:
            root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(prints))]


def test_near_duplicates_by_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [*ODD, *(base + f" end{i}" for i in range(60)), *(base.replace(f"w{i} ", "") for i in range(20))]
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    ids = [None if t == "no id" else i for i, t in enumerate(texts)]
    prints = [brute_fingerprint(t) for t in texts]
    want = sorted(zip(map(str, ids), (f"{p:016x}" for p in prints), map(str, brute_components(ids, prints)), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.keep_one(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    assert kept.where("doc_id is not null").count() == len({c for c in brute_components(ids, prints) if c is not None})


def test_near_copies_by_brute_force(spark):
    base = [f"w{i}" for i in range(200)]
    other = [f"v{i * 7 % 150}" for i in range(300)]
    texts = [*ODD, *(" ".join([*base[: 20 * i], f"new{i}", *base[20 * i + 1 :]]) for i in range(10)), " ".join(base), " ".join(base), " ".join(base[:150]), " ".join(other), " ".join(other[:-20])]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").encode().lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] != "no id" and texts[j] != "no id" and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root = [root[i] if x == root[j] else x for x in root]
    kept = simhash.keep_one_near(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    found = [r.doc_id for r in kept.select("doc_id").collect()]
    named = [i for i, t in enumerate(texts) if t != "no id"]
    assert sorted(x for x in found if x is not None) == sorted({min(j for j in named if root[j] == root[i]) for i in named})
    assert found.count(None) == len(texts) - len(named)
    assert simhash.keep_one_near(documents(spark, [])).count() == 0


def near_by_brute_force(texts):
    """Smallest position of each group of texts of five-word Jaccard similarity 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    return sorted(set(root))


def kept_near(spark, texts):
    return sorted(r.doc_id for r in simhash.keep_one_near(documents(spark, texts)).select("doc_id").collect())


def test_near_copies_at_the_least_similarity(spark):
    dice = random.Random(21)
    texts = []
    for f in range(40):
        base = [f"w{f}x{dice.randrange(500)}" for _ in range(100)]
        texts.append(" ".join(base))
        for edits in (1, 2, 2, 2, 3):  # similarities around 0.8; two edits of the same text are often under it
            other = list(base)
            for at in dice.sample(range(100), edits):
                other[at] = f"new{dice.random()}"
            texts.append(" ".join(other))
    assert kept_near(spark, texts) == near_by_brute_force(texts)


def test_near_copies_behind_a_repeated_line(spark):
    dice = random.Random(22)
    line = "the same line comes again and again "
    tails = [" ".join(f"t{dice.random()}" for _ in range(60)) for _ in range(12)]
    texts = [line * 400 + tail + end for tail in tails for end in ("", " one", " one two")]
    want = near_by_brute_force(texts)
    assert len(want) == 12 and kept_near(spark, texts) == want


def test_thousands_of_variants_of_one_text(spark, monkeypatch):
    dice = random.Random(23)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(3000):
        other = list(base)
        for at in dice.sample(range(100), 2):
            other[at] = f"new{i}x{at}"
        texts.append(" ".join(other))
    texts += [" ".join(base), *(" ".join(f"z{i}y{k}" for k in range(50)) for i in range(20))]
    compared = []
    checked = simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda df: compared.append(checked(df)) or compared[-1])
    assert kept_near(spark, texts) == [0, *range(3001, 3021)]
    # Links and pairs stay far under the 4.5 million of all pairs.
    assert max(x.count() for x in compared) < 200_000


def test_near_copies_of_a_repeated_key(spark):
    dice = random.Random(24)
    a, b, c = (" ".join(f"{n}{dice.random()}" for _ in range(80)) for n in "abc")
    rows = [(1, a, "en"), (2, a + " end", "en"), (2, b, "en"), (2, c, "en"), (3, c + " end", "en"), (2, b, "fr")]
    kept = simhash.keep_one_near(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (2, c)])


def test_trie_links_by_brute_force():
    dice = np.random.default_rng(11)
    for free in (5, 12, 32):
        groups = [np.unique(dice.integers(0, 1 << free, n).astype(np.uint64)) for n in (1, 2, 30, 31)]
        values = np.concatenate(groups)
        ends = np.cumsum([len(g) for g in groups])
        begins = ends - [len(g) for g in groups]
        for budget in (0, 1, 2, 4):
            i, j = simhash.trie_links(values, begins, ends, free, budget)
            want = {(a, b) for s, e in zip(begins, ends, strict=True) for a, b in itertools.combinations(range(s, e), 2) if int(values[a] ^ values[b]).bit_count() <= budget}
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_large_subtrees_are_cut(spark):
    dice = random.Random(12)
    center = dice.getrandbits(64)
    prints = {center ^ sum(1 << b for b in dice.sample(range(30), dice.randint(0, 4))) for _ in range(300)} | {dice.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=8))
    of = {r.node: r.component for r in found.collect()}
    brute = brute_components(range(len(prints)), prints)
    mine = [of.get(x, x) for x in signed]
    assert len(set(zip(mine, brute, strict=True))) == len(set(mine)) == len(set(brute))


def test_components_of_a_long_chain(spark):
    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1000, 1005).selectExpr("id AS a", "1010L AS b"))
    assert {r.component for r in simhash.components(edges).collect()} == {0, 1000}


# -- 10 ------------------------------------------------------------------------------------------


def test_maximum_flow_against_all_cuts():
    dice = random.Random(13)
    for _ in range(200):
        n = dice.randint(1, 7)
        source, sink = [dice.randint(0, 9) * 1.0 for _ in range(n)], [dice.randint(0, 9) * 1.0 for _ in range(n)]
        edges = [(a, b, dice.randint(1, 5) * 1.0) for a, b in itertools.combinations(range(n), 2) if dice.random() < 0.5]
        cost = lambda s: sum(sink[i] if s[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if s[a] != s[b])
        assert cost(htmltext.maximum_flow(n, source, sink, edges)) == min(cost(s) for s in itertools.product([False, True], repeat=n))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies to make this better. Accept them all.</p></div>
<article><h1>Head &amp; <i>line</i></h1><p>First  para&shy;graph, with <b>bold</b> words.<p>Second one,<br>broken &lt;b&gt;.<!-- <p>no</p> --><script>var t="</p>";</script>
<div class="ad">Buy this now. It is cheap and good.</div><ul><li>An item of the list.</li></ul><form><label>Mail</label><input></form></article>
<section class="comments"><p>Great post! I liked it. Thank you.</p></section><aside>Related stories here.</aside><footer>&copy; me</footer></body></html>"""


def test_html_extraction():
    assert htmltext.main_text(PAGE) == "Head & line\n\nFirst para\u00adgraph, with bold words.\n\nSecond one, broken <b>.\n\nAn item of the list."
    for cut in range(0, len(PAGE), 7):
        htmltext.main_text(PAGE[:cut])
    assert htmltext.main_text("<p>" + "Plain text stands alone. It has sentences. " * 9 + "</p>").startswith("Plain text")
    assert htmltext.main_text("<article><p>abc def. Ghi.<br") == "abc def. Ghi."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav><a href=x>x</a></nav>") == ""


def test_html_keeps_what_follows_odd_tags():
    page = "<article><p>Before it. It is a sentence here.</p>{}<p>The rest stays. It is kept whole.</p></article>"
    plain = htmltext.main_text(page.format(""))
    assert plain.endswith("The rest stays. It is kept whole.")
    for odd in ("<svg width=1 />", "<math/>", "<video src=x>", "<audio>", "<object data=a>", "<canvas>", "<svg><svg></svg>no</svg>", "<svg><text>no</text></svg>", "<video>no</video>", "<img alt='a > b'>"):
        assert htmltext.main_text(page.format(odd)) == plain, odd
    for odd in ("<p title=don't>Kept too.</p>", '<p title="5" screen">Kept too.</p>', '<p class="a>Kept too.</p>', "<p a = 'x>y'>Kept too.</p>", "<video src=x><p>Kept too.</p><video>no</video>"):
        assert htmltext.main_text(page.format(odd)) == plain.replace("\n\n", "\n\nKept too.\n\n"), odd


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "", 7), (1, "u", PAGE, 5)], "page_id long, url string, html string, n_chars int")
    got = htmltext.extract(rows).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 2
    assert htmltext.extract(rows.limit(0)).count() == 0


# -- All ------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert media.text_features(empty).count() == packing.pack_documents(empty, VOCABULARY).count() == simhash.keep_one(empty).count() == mixing.mixed_documents(empty).count() == 0
    assert warc.derive(warc.response_records(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 2048
