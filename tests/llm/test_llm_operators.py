"""The operators against brute force, exact round trips and held-out accuracy, with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphloom.llm import _shared, chat_format, decontamination, forest, line_dedup, mixing, quality_rules, secret_scan, simhash, token_counts, toxicity, url_filter
from glyphloom.llm._ragged import Powers, chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, text_key long, _id long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"w{i}" for i in range(400)]


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, ("a", "b", None)[k % 3], len(t or ""), "clash", 7, 9) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [None, "", " \n\t ", "one", "One two THREE", passage, passage, prose(rng, 3000)]
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 20)}" for _ in range(12)]
    texts += ["é ü NUL\x00here ñ " * 5, "x" * 5000, passage.replace("w1", "W1"), "### " * 80]
    return texts


# 1


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7?x=/y", "http://example.com/en/8", "https://x.com#f", "http://b.net/de/8", "http://example.net/de/81", "ftp://u/p://q", "http://notcom/en/", "http://h.org/es/\n1"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string")
    listed = spark.createDataFrame([("u/p://q",), ("x.com",), (None,), ("absent",)], "key string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if host + path in ("u/p://q", "x.com") else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict) == tuple(got[i + len(urls)])[1:]


def test_rules_are_those_of_the_contract(spark):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"), "http://example.com/en/6": ("com/en/", "block"), "http://b.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/81": ("example.net/de/8", "block"), "http://c.org/es/": ("org/es/", "block"), "http://c.org/en/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    listed = spark.createDataFrame([("b.net/de/1",), ("www.example.com/en/71",)], "key string")
    got = url_filter.judge(pages, listed).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == list(want.values())


def test_urls_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    assert url_filter.judge(pages, url_filter.stand_in_list(pages)).count() == 0


def test_cascade_is_exact_both_ways(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.pmod(F.xxhash64("key"), F.lit(7)) == 0)
    cascades, shards = url_filter.build(listed, keys, shard_keys=3000)
    truth = {r.key for r in listed.collect()}
    for most in (1 << 20, 1):
        got = url_filter.with_membership(keys.withColumn("h1", F.lit(1)), cascades, shards, most)
        assert {r.key for r in got.where("listed").collect()} == truth and got.count() == 20_000
    none, n = url_filter.build(listed.limit(0), keys.limit(0))
    assert url_filter.with_membership(keys.limit(3), none, n).where("listed").count() == 0


# 2


def test_mix(spark, mixed):
    docs = documents(spark, mixed)
    found = mixing.planned(docs).collect()
    total = sum(r["size"] for r in found)
    sizes = Counter()
    for r in found:
        sizes[r.row.source] += r["size"]
        assert r["size"] == len(SPACED.findall(r.row.text or ""))
        assert 0 <= r.copies <= 2 and r.target <= 2 * r.source_size
    target = {r.row.source: r.target for r in found}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    assert {r.row.source: r.source_size for r in found} == sizes
    level = max((target[s] / w for s, w in zip(("a", "b", None), (5, 2, 1), strict=True) if target[s] < 2 * sizes[s]))
    for s, w in zip(("a", "b", None), (5, 2, 1), strict=True):
        assert target[s] == pytest.approx(min(2 * sizes[s], level * w))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect(), key=str) == sorted((r.row for r in found for _ in range(r.copies)), key=str)
    assert mixing.planned(docs.limit(0)).count() == 0
    assert {r.target for r in mixing.planned(documents(spark, [None, ""])).collect()} == {0.0}


@pytest.mark.parametrize("seed", range(3))
def test_targets_of_many_sources(spark, seed):
    rng = random.Random(seed)
    sizes = [(f"s{i:03}" if i else None, rng.choice((0, 1, 5, 100, rng.randint(1, 10_000)))) for i in range(150)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rng.sample(sizes, 150), "source string, source_size long").repartition(7)).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
    size, total, open_, level = dict(sizes), 1.5 * sum(n for _, n in sizes), set(weight), 0.0
    while open_:
        level = (total - sum(2 * size[s] for s in weight if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        open_ -= over
    assert got == {s: pytest.approx(weight[s] * level if s in open_ else 2 * size[s]) for s in weight}


def test_mix_joins_alike_without_broadcast(spark, mixed, monkeypatch):
    key = lambda df: sorted(map(str, df.select("row.doc_id", "target", "copies").collect()))
    want = key(mixing.planned(documents(spark, mixed)))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key(mixing.planned(documents(spark, mixed))) == want


# 3


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["idiot", "abschaum", "canaille"]
    rows = []
    for i in range(900):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(1, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), toxic))
    texts = [r[1] for r in rows] + [None, "", "x " * 30_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(got) == len(texts) and 100 < len(held) < 260
    assert np.mean([got[i].predicted == t for i, _, t in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[900].score == got[901].score
    none = toxicity.judged(docs.limit(5), labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.0}


def test_scores_are_those_of_a_plain_loop():
    rng = np.random.default_rng(3)
    filters = [rng.normal(size=(k, toxicity.DIMENSIONS, toxicity.FILTERS)) for k in toxicity.WIDTHS]
    n = toxicity.FILTERS * len(filters)
    m = toxicity.Model(rng.normal(size=(60, toxicity.DIMENSIONS)), filters, rng.normal(size=n), rng.normal(size=n), 0.3)
    m.embedding[0] = 0
    texts = [rng.integers(1, 60, (k, 3)) for k in (0, 1, 2, 0, 3, 9, 40, 0)]
    want = []
    for t in texts:
        vectors = [m.embedding[r].sum(axis=0) for r in t] + [np.zeros(toxicity.DIMENSIONS)] * 3
        pool = [max(sum(vectors[i + j] @ w[j][:, f] for j in range(len(w))) for i in range(max(len(t), 1))) for w in filters for f in range(toxicity.FILTERS)]
        want.append(1 / (1 + np.exp(-(np.maximum(np.array(pool) + m.bias, 0) @ m.weights + m.offset))))
    sizes = np.array([len(t) for t in texts])
    assert m.score(np.concatenate(texts), sizes) == pytest.approx(want)
    assert [m.score(t, np.array([len(t)]))[0] for t in texts] == pytest.approx(want)


def test_best_threshold():
    rng = np.random.default_rng(4)
    for _ in range(30):
        y = (rng.random(60) < 0.4).astype(float)
        score = np.round(np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1), 2)
        f1 = lambda t: 2 * ((score >= t) & (y > 0)).sum() / ((score >= t).sum() + y.sum())  # noqa: B023, E731
        assert f1(toxicity.best_threshold(score, y)) == pytest.approx(max(map(f1, score)))
    assert toxicity.best_threshold(np.array([0.1, 0.9]), np.array([0.0, 1.0])) == 0.5


def test_toxicity_reruns_agree_where_ids_repeat(spark):
    rng = random.Random(12)
    texts = [prose(rng, 20) + (" idiot" if i % 4 == 0 else "") for i in range(240)]
    ids = [i // 3 for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(3 * i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts, ids)
    runs = [toxicity.judged(d, labels).orderBy("doc_id", "score").collect() for d in (docs.repartition(2), docs.repartition(5).orderBy(F.rand(3)))]
    assert runs[0] == runs[1] and len(runs[0]) == 240
    assert toxicity.judged(docs.limit(0), labels).count() == 0


def labelled_texts(n, bad):
    rng = random.Random(21)
    rows = [(i, [rng.choice(VOCABULARY) for _ in range(rng.randint(1, 40))], int(rng.random() < 0.2)) for i in range(n)]
    return [(i, " ".join([*words, rng.choice(bad)] if toxic else words), toxic) for i, words, toxic in rows]


def test_toxicity_learns_from_all_labelled_rows(spark):
    rows = labelled_texts(900, [f"b{chr(97 + i % 26)}{i * 7919}" for i in range(40)])
    docs = documents(spark, [r[1] for r in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    runs = [{r.doc_id: r for r in toxicity.judged(d, labels, 150).collect()} for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]
    trained = [runs[0][i] for i, _, t in rows if t and not runs[0][i].held_out]
    assert np.mean([r.predicted for r in trained]) > 0.8 < np.mean([r.flagged for r in trained])
    assert np.mean([runs[0][i].predicted for i, _, t in rows if not t]) < 0.05


def test_toxicity_counts_all_labelled_rows(spark):
    rows = labelled_texts(300, ["idiot"])
    docs = documents(spark, [r[1] for r in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    examples, sizes = toxicity.labelled(docs.union(docs.limit(20)), labels, 50)
    used = [(text, t) for i, text, t in rows if zlib.crc32(str(i).encode()) % 5]
    assert sum(r[1] for r in sizes) == examples.count() == len(used) and examples.rdd.getNumPartitions() == -(-len(used) // 50)
    want, powers = np.zeros((2, toxicity.BUCKETS), int), Powers()
    for text, t in used:
        (chunk,) = chunks(pa.array([text]))
        found = np.unique(toxicity.word_ids(chunk, powers)[0]) - 1
        want[0, found] += 1
        want[1, found] += t
    assert (toxicity._counts(examples).sum(axis=0) == want).all()


def test_few_texts_without_labels_are_dealt_for_the_join(spark, monkeypatch):
    ids = spark.range(0, 400_000, 3, numPartitions=4).withColumnRenamed("id", "doc_id")
    rows = spark.range(-60_000, 60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).union(spark.createDataFrame([(None, "none")], "doc_id long, text string"))
    got = [r.doc_id for r in _shared.likely_among(rows, ids, "doc_id").collect()]
    assert set(range(0, 60_000, 3)) <= set(got) and len(got) == len(set(got)) < 20_000 + 0.15 * 100_000
    texts = labelled_texts(300, ["idiot"])
    docs = documents(spark, [r[1] for r in texts])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in texts[:200]], "doc_id long, quality int, toxic int")
    want, sizes = toxicity.labelled(docs.union(docs.limit(20)), labels, 50)
    monkeypatch.setattr(toxicity, "small", lambda rows: False)
    found, others = toxicity.labelled(docs.union(docs.limit(20)), labels, 50)
    assert found.collect() == want.collect() and sorted(sizes) == sorted(others)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    m = toxicity.started(rng.normal(size=toxicity.BUCKETS + 1), 0.3)
    texts = [rng.integers(1, 200, (k, 3)) for k in (0, 1, 2, 5, 40, 7, 0)]
    whole = toxicity.strongest(m, texts)
    for most in (1, 2, 3, 8):
        for a, b in zip(whole, toxicity.strongest(m, texts, most), strict=True):
            assert a == pytest.approx(b)
    (chunk,) = chunks(pa.array(["one Two, three-fourteen é " * 20 + "z" * 70 + " end"]))
    want = toxicity.word_ids(chunk, Powers())
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    assert all((a == b).all() for a, b in zip(want, toxicity.word_ids(chunk, Powers()), strict=True))


def test_scores_agree_whatever_the_block(monkeypatch):
    rng = np.random.default_rng(9)
    m = toxicity.started(rng.normal(size=toxicity.BUCKETS + 1), 0.3)
    texts = [rng.integers(1, 200, (k, 3)) for k in (0, 4, 1, 0, 2, 33, 7, 0)]
    args = np.concatenate(texts), np.array([len(t) for t in texts])
    want, (top, windows) = m.score(*args), toxicity.strongest(m, texts)
    for places in (1, 2, 3, 8):
        monkeypatch.setattr(toxicity, "PLACES", places)
        assert (m.score(*args) == want).all()
        assert toxicity.strongest(m, texts)[0] == pytest.approx(top) and (toxicity.strongest(m, texts)[1] == windows).all()


def test_scoring_needs_little_room_beside_the_words():
    rng = np.random.default_rng(10)
    m = toxicity.started(rng.normal(size=toxicity.BUCKETS + 1), 0.3)
    rows = rng.integers(1, toxicity.BUCKETS, (200_000, 3)).astype(np.int32)
    tracemalloc.start()
    m.score(rows, np.full(500, 400))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(rows)


def test_bins_of_scores_are_small(spark):
    rng = np.random.default_rng(11)
    scores = np.sort(np.append(np.round(1 / (1 + np.exp(-rng.normal(-8, 1.5, 5000))), 9), [0.0, 1.0]))
    bins = [r[0] for r in spark.createDataFrame([(float(x),) for x in scores], "score double").select(toxicity.score_bin(F.col("score"))).collect()]
    assert bins == sorted(bins) and max(np.unique(bins, return_counts=True)[1]) < 100


def test_thresholds_are_those_of_a_list(spark):
    rng = np.random.default_rng(8)
    rows = [(lang, float(np.round(np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1), digits)), y) for lang, n, digits in (("a", 400, 9), ("b", 300, 2), ("", 50, 4), ("few", 6, 3)) for y in (rng.random(n) < 0.4).astype(int).tolist()]
    got = dict(map(tuple, toxicity.thresholds(spark.createDataFrame(rows, "lang string, score double, hit int")).collect()))
    for lang in {r[0] for r in rows}:
        score, y = (np.array(x, float) for x in zip(*[r[1:] for r in rows if r[0] == lang], strict=True))
        assert got.get(lang, 0.5) == pytest.approx(toxicity.best_threshold(score, y), abs=1e-12)


# 4


def fingerprint(text):
    words = SPACED.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, ids):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for i in range(len(values)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(values))]


def test_simhash(spark, mixed):
    ids = [None if i == 6 else 1 if i == 2 else 100 - i for i in range(len(mixed))]
    got = simhash.clustered(documents(spark, mixed, ids)).collect()
    fps = [fingerprint(t) for t in mixed]
    want = Counter((i, f, r) for i, f, r in zip(ids, fps, roots(fps, ids), strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.keep_one(documents(spark, [*mixed, mixed[5]], [*ids, ids[5]]))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert len(kept.collect()) == len(set(roots(fps, ids)))
    assert simhash.clustered(documents(spark, mixed).limit(0)).count() == 0


def test_the_count_filter_prunes_and_loses_nothing():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    b = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    b = (b & ~np.uint64(0xFFFF)) | (a & np.uint64(0xFFFF))  # pairs of one list: two bytes are shared
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for n in rng.integers(0, 7, 20_000)], np.uint64)
    tally = simhash.shared_bytes(a, b)
    plain = [sum((int(x) ^ int(y)) >> 8 * k & 255 == 0 for k in range(8)) for x, y in zip(a[:500], b[:500], strict=True)]
    assert tally[:500].tolist() == plain and (tally >= simhash.SHARED).mean() < 0.01  # all others are never verified
    near = np.bitwise_count(flips) <= simhash.MOST_BITS
    assert (simhash._close(a, a ^ flips) == near).all() and (simhash.shared_bytes(a, a ^ flips)[near] >= simhash.SHARED).all()


def test_common_keys_are_joined_where_they_stand(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_SHARE", 4)
    left = spark.createDataFrame([(1, i) for i in range(60)] + [(k, k) for k in range(2, 30)], "k long, v long")
    right = spark.createDataFrame([(k, -k) for k in range(40)], "k long, w long")
    hot = _shared.hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert hot == [1]
    key = lambda df: sorted(map(tuple, df.select("k", "v", "w").collect()))
    assert key(_shared.join_dealt(left, right, "k", hot)) == key(left.join(right, "k"))


def test_keep_one_is_the_same_in_any_order(spark, monkeypatch):
    rng = random.Random(13)
    texts = [prose(rng, 60) for _ in range(4)]
    rows = [(i % 3, texts[i % 4], "en", f"s{rng.randint(0, 5)}", 1, None, None, None) for i in range(40)]
    rows += rows[:6]
    want = None
    for most in (500_000, 0):
        monkeypatch.setattr(_shared.small, "__defaults__", (most,))
        for parts in (1, 5):
            got = sorted(map(str, simhash.keep_one(spark.createDataFrame(rng.sample(rows, len(rows)), DOCS).repartition(parts)).collect()))
            want = want or got
            assert got == want and len(got) == 4


@pytest.mark.parametrize(("width", "block"), [(2, 16), (3, 4096), (4, 4096)])
def test_links_are_all_found(spark, width, block):
    rng = np.random.default_rng(width)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centre for k in (1, 2, 3, 4, 5, 6) for _ in range(4)]
    dense = [int(centre[0]) ^ v for v in range(256)]
    values = sorted({int(c) for c in centre} | set(near) | set(dense))
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(nodes, width, block)).collect()}
    classes = roots(values, list(range(len(values))))
    joined = {}
    for v, c in zip(values, classes, strict=True):
        joined.setdefault(c, set()).add(found.get(v, v))
    assert all(len(x) == 1 for x in joined.values()) and len({next(iter(x)) for x in joined.values()}) == len(joined)


# 5


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", ""]), st.text(alphabet="ab\\_n<|>/s[]INST im_startend\n") | st.sampled_from([*chat_format.CONTROL, "<</s>", "\\<\\_s>"]))))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(messages):
    text, spans = chat_format.render(messages)
    assert chat_format.read(text) == messages
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]
    assert text.count(chat_format.BEGIN) == text.count(chat_format.END) == len(messages)
    assert not any(c in chat_format.escape(t) for _, t in messages for c in chat_format.CONTROL)


def test_events_fold(spark):
    log = [
        (1, 3, "delta", "m2", None, "wor"), (1, 1, "start", "m1", "user", "hi"), (1, 2, "start", "m2", "assistant", None), (1, 4, "delta", "m2", None, "ld"), (1, 5, "edit", "m1", None, "hello"),
        (1, 6, "regenerate", "m2", None, None), (1, 7, "delta", "m2", None, "new "), (1, 8, "delta", "m2", None, "reply"), (2, 1, "delta", "x", None, "lone"), (2, 2, "start", None, "user", None), (2, 3, "start", "gone", "user", "z"), (2, 4, "delete", "gone", None, None),
        (None, None, "start", None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message string, role string, text string").repartition(3)
    got = {r.conv_id: chat_format.read(r.formatted) for r in chat_format.formatted(events).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "new reply")], 2: [("assistant", "lone"), ("user", "")], None: [("", "")]}
    assert chat_format.formatted(events.limit(0)).count() == 0


def test_events_of_one_number_fold_alike_in_any_order(spark):
    log = [(1, 1, "start", "m", "assistant", "x"), (1, 2, "edit", "m", None, "y"), (1, 2, "regenerate", "m", None, "y"), (1, 2, "delta", "m", None, "y"), (1, 3, "delta", "m", None, "z")]
    kind = "conv_id long, seq long, kind string, message string, role string, text string"
    got = {chat_format.formatted(spark.createDataFrame(random.Random(k).sample(log, 5), kind).repartition(3)).first().formatted for k in range(3)}
    assert [chat_format.read(t) for t in got] == [[("assistant", "z")]]


def test_turns_of_one_conversation_are_rendered_in_many_tasks(spark):
    rng = random.Random(6)
    log = [(1, i, "start", f"m{i}" if i % 3 == 0 else None, rng.choice(("user", "assistant", None)), rng.choice((None, "a\\b", "</s>", prose(rng, 5)))) for i in range(300)]
    log += [(1, 300 + i, "delta", f"m{3 * i}", None, f" more {i}") for i in range(100)] + [(1, 500, "delete", "m9", None, None), (1, 501, "start", "m9", "user", "again"), (2, 1, "regenerate", None, None, "x")]
    log += [(2, 0, "start", None, "user", t) for t in ("b", "a", None)]
    events = spark.createDataFrame(rng.sample(log, len(log)), "conv_id long, seq long, kind string, message string, role string, text string").repartition(4)
    want = {}
    for conv, _, kind, name, role, text in sorted(log, key=lambda e: (e[0], e[1], *((x is not None, x or "") for x in e[3:]))):
        messages = want.setdefault(conv, {})
        if kind == "delete":
            messages.pop(name)
        elif kind == "delta":
            messages[name][1] += text
        else:
            messages[name or object()] = [role or ("" if kind == "start" else "assistant"), "" if kind == "regenerate" else text or ""]
    parts = chat_format.rendered(events)
    assert parts.where("conv_id = 1").select(F.spark_partition_id()).distinct().count() > 1
    assert max(p.part.count(chat_format.BEGIN) for p in parts.collect()) == 1
    got = {r.conv_id: r for r in chat_format.digests(parts).collect()}
    whole = {r.conv_id: r for r in chat_format.formatted(events).collect()}
    assert set(got) == set(want)
    for conv, messages in want.items():
        text, spans = chat_format.render([tuple(m) for m in messages.values()])
        under = "".join(t for r, t in messages.values() if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in messages.values()), under)]
        assert tuple(got[conv]) == (conv, len(messages), sha[0], len(under), sha[1], len(text))
        assert (whole[conv].formatted, [tuple(s) for s in whole[conv].loss]) == (text, spans)


# 6


def repeated_runs(texts, words):
    """Lines (text, line) in runs of so many words, at least, that an earlier place has."""
    found, seen = set(), set()
    for d, text in enumerate(texts):
        doc = [(i, x.strip(" "), len(SPACED.findall(x))) for i, x in enumerate((text or "").split("\n")) if SPACED.search(x)]
        for p in range(len(doc)):
            n = 0
            for q in range(p, len(doc)):
                n += doc[q][2]
                key = tuple(x[1] for x in doc[p : q + 1])
                if n >= words and key in seen:
                    found.update((d, x[0]) for x in doc[p : q + 1])
                if n >= words:
                    seen.add(key)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice((1, 4, 9, 14, 30, 70))) for _ in range(30)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(4, 12))] for _ in range(4)]
    texts = []
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(runs) if rng.random() < 0.5 else [prose(rng, rng.choice((3, 20, 60))), "", rng.choice(pool)]
        texts.append("\n".join(parts))
    texts += [None, "", "\n\n", texts[0]]
    docs = documents(spark, texts)
    got = line_dedup.deduplicate(docs)
    rows = {r.row.doc_id: r for r in got.collect()}
    may = repeated_runs(texts, 25)
    assert repeated_runs(texts, 50) and not repeated_runs([rows[i].text for i in range(len(texts))], 50)
    for i, t in enumerate(texts):
        kept, lines = [] if rows[i].text is None else rows[i].text.split("\n"), [] if t is None else t.split("\n")
        assert len(kept) == len(lines) - rows[i].n_removed or kept == [""]
        gone = Counter(lines) - Counter(kept)
        assert not gone - Counter(lines[k] for d, k in may if d == i)
    assert set(got.select("row.*").columns) == set(docs.columns)
    firsts = {x.strip(" ") for t in texts for x in (t or "").split("\n")}
    assert firsts == {x.strip(" ") for r in rows.values() for x in (r.text or "").split("\n")} | {""}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_where_the_first_place_ends_sooner(spark, seed):
    rng = random.Random(seed)
    texts = [[], [], []]
    for _ in range(40):
        a, b, c, x = (prose(rng, 24) for _ in range(4))
        texts[0].append(([a, b], [b, c])[rng.random() < 0.3])
        texts[1].append([x, a, b, c])
        texts[2].append([a, b, c])
    texts = ["\n".join(line for part in parts for line in [*part, prose(rng, 24)]) for parts in texts]
    got = line_dedup.repeated_lines(documents(spark, texts)).collect()
    gone = {(r.doc_id, k) for r in got for k in r.drop}
    assert repeated_runs(texts, 50) <= gone <= repeated_runs(texts, 25)


def test_line_dedup_of_nulls_and_copies(spark):
    rng = random.Random(9)
    passage = prose(rng, 55)
    docs = documents(spark, [f"a\n{passage}", f"b\n{passage}", passage, passage], [None, 5, 7, 7])
    got = sorted((str(r.row.doc_id), r.text, r.n_removed) for r in line_dedup.deduplicate(docs).collect())
    assert got == [("5", f"b\n{passage}", 0), ("7", "", 1), ("7", "", 1), ("None", "a", 1)]
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


# 7


def test_forest_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert np.mean((forest.train(x[:1000], y[:1000]).predict(x[1000:]) > 0.5) == y[1000:]) > 0.9


@pytest.fixture(scope="module")
def secrets(spark):
    """A model from generated documents, and labelled findings that it has not seen, planted in other documents."""
    rng = random.Random(8)
    docs = documents(spark, [prose_of_letters(rng, 80) for _ in range(300)])
    words = secret_scan.dictionary(docs)
    assert len(words) == len(LETTERS) and set(words) == {w.lower() for w in LETTERS}
    between = secret_scan.places(docs)
    assert len(between) == 300 and all(len(x) <= secret_scan.CONTEXT for pair in between for x in pair)
    model = secret_scan.train(secret_scan.labelled_findings(between[:200], words), words)
    return model, secret_scan.labelled_findings(between[200:], words, 1000, seed=99)


LETTERS = [a + b + c for a in ("ther", "ung", "mos", "cion") for b in ("al", "ing", "er", "out", "ment") for c in ("", "de", "son", "ly")]


def prose_of_letters(rng, n):
    return " ".join(rng.choice(LETTERS) for _ in range(n))


def test_secrets_held_out(secrets):
    model, held = secrets
    said = model.score([(f.value, f.before, f.after, f.path) for f in held]) >= secret_scan.THRESHOLD
    real = np.array([f.real for f in held])
    assert (said & real).sum() / said.sum() > 0.97 and (said & real).sum() / real.sum() > 0.95


def test_secrets(spark, secrets):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [None, "", f'x token = "{key}" y', f"commit: {key} done", 'password = "your-token-here"', "q" * 20_000, f'token = "{key}"', "plain words only"]
    found = secret_scan.scan(documents(spark, texts), secrets[0], path="source").collect()
    assert {(r.doc_id, r.value) for r in found if r.secret} == {(2, key), (6, key)}
    assert {r.doc_id for r in found} == {2, 3, 4, 5, 6} and all(texts[r.doc_id][r.start : r.end] == r.value for r in found)


def test_secrets_without_a_digit(spark, secrets):
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["AKIA" + "".join(rng.choices(letters, k=16)) for _ in range(5)] + ["ghp_" + "".join(rng.choices(letters + letters.lower(), k=36)) for _ in range(5)]
    others = ["thereringthermentson", "MOSAL_THERER_UNGING_CIONOUT", "-" * 60, "cionoutde/theringson/ungerly"]
    texts = [f"we use {v} for it" for v in [*keys, *others]]
    found = secret_scan.scan(documents(spark, texts), secrets[0]).collect()
    assert {r.value for r in found} == {*keys, *others}
    assert {r.value for r in found if r.secret} == set(keys)


def plain_candidates(text):
    """The definition, place by place: assigned values from left to right, and maximal runs that meet none of them."""
    mark, allowed = re.compile(r"[\w.\-]{0,40}[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?([^\s\"'<>,;]{8,})"), re.compile(r"[A-Za-z0-9+/_\-]")
    values, at = [], 0
    while at < len(text):
        hits = [m for n in secret_scan.NAMES if text[at:].lower().startswith(n) and (m := mark.match(text, at + len(n)))]
        if hits:
            values.append(hits[0].span(1))
            at = hits[0].end()
        else:
            at += 1
    runs, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and allowed.match(text[end]):
            end += 1
        if end - at >= 20:
            end += min(2, len(text[end:]) - len(text[end:].lstrip("=")))
            runs.append((at, end))
        at = max(end, at + 1)
    return sorted(values + [r for r in runs if not any(v[0] < r[1] and r[0] < v[1] for v in values)])


def test_candidates_are_those_of_the_definition():
    rng = random.Random(3)
    parts = ["token", "API_KEY", "pwd", "auth", " = ", "=", ": ", ':"', '"', " ", "\n", "a1B2c3D4", "x" * 9, "abc-def/ghi_", "ü", ",", "=="]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secret_scan.candidates(text) == plain_candidates(text), text


def test_a_run_of_two_million_letters_takes_linear_time(secrets):
    for text in ("q" * 2_000_000, "token " * 330_000, "qwertz_-" * 250_000):
        began = time.perf_counter()
        found = secret_scan.candidates(text)
        assert len(found) == (text[0] == "q") and time.perf_counter() - began < 2
        secrets[0].score([(text[a:b], "", "", "") for a, b in found])
        assert time.perf_counter() - began < 6


def test_secrets_of_an_empty_table(spark):
    docs = documents(spark, ["x"]).limit(0)
    assert secret_scan.dictionary(docs) == [] and secret_scan.places(docs) == []
    assert secret_scan.scan(docs, secret_scan.fit(docs, 200)).count() == 0


# 8


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return path, Tokenizer.from_file(path)


def test_tokens(spark, mixed, bpe):
    path, library = bpe
    texts = [*mixed, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "aaaa" * 300, "ab" * 3000, "日本語 🙂🙂 ½", "'s't'RE"]
    got = {r.doc_id: r for r in token_counts.token_counts(documents(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)


def test_tokens_of_random_texts(bpe):
    path, library = bpe
    counter, rng = token_counts.Counter(token_counts.vocabulary(path)), random.Random(4)
    texts = ["".join(rng.choice("aab  \n\tcéß日🙂'1,.$<|>THthe ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tokens_of_long_pieces(bpe, monkeypatch):
    path, library = bpe
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(letters, k=30_000)), "a" * 5001, "abab" * 3000, "日本" * 900, "".join(rng.choices("ab\u00e9ß日", k=9000)), " " * 3000 + "x", "-=" * 4000, "the <|endoftext|> " * 300]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    v = token_counts.vocabulary(path)
    assert token_counts.Counter(v).count(texts) == want
    pieces = [p.encode() for p in texts if " " not in p]
    assert token_counts.long_sizes(pieces, v).tolist() == token_counts.merged_sizes(pieces, v).tolist()
    monkeypatch.setattr(token_counts, "BATCH_CHARS", 5000)
    monkeypatch.setattr(token_counts, "BATCH_PIECES", 7)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "LONG", 4)
    assert token_counts.Counter(v).count(texts) == want


def test_a_million_letters_take_seconds(bpe):
    path, library = bpe
    text, counter = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), token_counts.Counter(token_counts.vocabulary(path))
    began = time.perf_counter()
    n = counter.count([text])
    assert time.perf_counter() - began < 15 and n == [len(library.encode(text, add_special_tokens=False).ids)]


def test_quality_and_benchmark_of_empty_tables(spark):
    docs, labels = documents(spark, ["x"]).limit(0), spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs, labels).count() == 0 and quality_rules.filter_documents(docs, labels).count() == 0
    assert decontamination.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_tokens_of_an_empty_table(spark, bpe):
    assert token_counts.token_counts(documents(spark, ["x"]).limit(0), bpe[0]).count() == 0


# 9


def counts(text):
    words = SPACED.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, mixed):
    rng = random.Random(1)
    texts = [*mixed, "a b c\na b c\n x\n x\nx", "a b a b a b a"]
    good = [prose(rng, rng.randint(60, 120)) for _ in range(200)]
    junk = [" ".join(w + rng.choice(("***", "$$$")) for w in prose(rng, 80).split()) for _ in range(60)]
    docs = documents(spark, [*texts, *good, *junk])
    n = len(texts)
    labels = spark.createDataFrame([(n + i, int(i < 200), 0) for i in range(260)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        want = counts(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert all(got[n + i].kept == (i < 200) for i in range(260))
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0


# 10


def brute_hits(text, items, window=10):
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = cut.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        w = cut.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        mine = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in mine:
                hit |= set(range(k, k + n))
                found.add("" if i is None else str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1 << 20, 60])
def test_decontamination(spark, block_words):
    rng = random.Random(3)
    small = VOCABULARY[:12]
    items = [(i, " ".join(rng.choice(small) for _ in range(rng.choice((3, 10, 12, 30))))) for i in range(20)] + [(None, prose(rng, 15)), (21, None), (22, " - "), (3, prose(rng, 11)), (40, "Ärger! NAÏVE")]
    texts = [None, "", *(" ".join(rng.choice(small) for _ in range(rng.randint(0, 60))) for _ in range(20))]
    for _ in range(30):
        pick = rng.choice(items)[1] or ""
        texts.append(f"{prose(rng, rng.randint(0, 30))}, {pick.upper()}... {prose(rng, 9)}\n{pick} {prose(rng, 5)}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [*texts, texts[25]])
    found = decontamination.contamination(docs, bench, clean=True, block_words=block_words).withColumn("n_hit", decontamination.n_hit()).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        n, hit, names = brute_hits(r.row.text, items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, names)
        assert brute_hits(r.text, items)[0] == n - hit and (hit or r.text == r.row.text)
    assert decontamination.contamination(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_suffixes_and_ranks():
    rng = np.random.default_rng(1)
    text = np.concatenate(([0], rng.integers(1, 5, 500), [0], rng.integers(1, 5, 60)))
    order = decontamination.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = decontamination.FmIndex(text)
    windows = np.array([[1, 2, 3], [4, 4, 4], [2, 1, 2], [9, 1, 1]])
    lo, hi = index.search(windows)
    for w, a, b in zip(windows, lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == w.tolist()]


def test_digest_of_no_item(spark):
    found = decontamination.contamination(documents(spark, ["a b"]), spark.createDataFrame([(1, "c")], "item_id long, text string"))
    assert found.select(F.sha2(F.array_join("items", ","), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_decontamination_of_long_texts_and_items(monkeypatch):
    """Parts of a text share the words of a window, pieces of an item too; nothing is found twice or lost at their ends."""
    rng = random.Random(5)
    item = prose(rng, 300)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontamination, "SEARCHED", 7)
    monkeypatch.setattr(decontamination.parts, "__defaults__", (120,))
    text = f"{prose(rng, 90)} {item} {'x' * 700} {prose(rng, 40)} {' '.join(item.split()[20:33])} {' - ' * 200} b"
    words = item.split()
    cut = [words[k : k + 25] for k in range(0, 300 - 9, 16)]
    hashes = np.concatenate([np.array([hash_of(w) for w in c], np.uint64) for c in cut])
    p = decontamination.patterns(["a"] * len(cut), hashes, np.array([len(c) for c in cut]))
    for t in (text, f"{item} {item}", "x" * 1000, " " * 1000, prose(rng, 8) + " " * 900):
        n, spans, pairs = decontamination.search(pa.array([None, "short", t]), p)
        total, hit, names = brute_hits(t, [("a", item)])
        found = decontamination.merged([(lo, hi) for i, lo, hi in spans.tolist() if i == 2])
        assert n.tolist() == [0, 1, total] and sum(hi - lo for lo, hi in found) == hit and bool(len(pairs)) == bool(names)
        if found:
            left = decontamination.without(t, found)
            covered = {k for lo, hi in found for k in range(lo, hi)}
            split = lambda v: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", v.lower())
            assert split(left) == [w for k, w in enumerate(split(t)) if k not in covered]


def hash_of(word):
    powers, c = decontamination.Powers(), decontamination.Chunk(slice(0, 1), [word])
    mapped, starts, ends, _ = c.words(decontamination.ALNUM_LOWER)
    return powers.spans(mapped, starts, ends)[0]


def test_benchmark_blocks(spark):
    """Blocks hold about as many words as asked for, whatever an item's size and however often it comes; no window is lost."""
    rng = random.Random(8)
    long = prose(rng, 2000)
    bench = spark.createDataFrame([*[(1, long)] * 50, *((i, prose(rng, 30)) for i in range(2, 40)), (99, None)], "item_id long, text string")
    built, blocks = decontamination.blocks_of(bench, block_words=200)
    sizes = [len(decontamination.pickle.loads(r["data"]).words) for r in built.collect()]
    assert blocks >= 10 and max(sizes) < 1200 and 2000 + 38 * 30 <= sum(sizes) < 4500
    docs = documents(spark, [long, *[long] * 30, f"{prose(rng, 5)} {' '.join(long.split()[190:215])}", prose(rng, 50)])
    found = decontamination.contamination(docs, bench, block_words=200).withColumn("n_hit", decontamination.n_hit()).collect()
    assert sorted(r.n_hit for r in found) == [0, 25] + [2000] * 31


def test_memory_of_a_long_text():
    """A text of 64 MB with few known words is searched and cleaned in memory that its parts need, some times its own size."""
    import tracemalloc

    item = "one two three four five six seven eight nine ten"
    text = "".join(["plain words here " * 1_900_000, item.upper(), " and more words " * 1_900_000])
    hashes = np.array([hash_of(w) for w in item.split()], np.uint64)
    p = decontamination.patterns(["a"], hashes, np.array([10]))
    texts = pa.array([text])
    tracemalloc.start()
    n, spans, _ = decontamination.search(texts, p)
    left = decontamination.without(text, [tuple(s[1:]) for s in spans.tolist()])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n[0] == 3 * 1_900_000 * 2 + 10 and len(spans) == 1 and len(left) == len(text) - len(item)
    assert peak < 8 * len(text)
