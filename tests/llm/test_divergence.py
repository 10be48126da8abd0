"""op11: shard counts, kept terms, pair sums and rankings against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from glyphloom.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n string, term string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    """rows of (text, lang, source); the definition word by word."""
    found, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        found[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (of, t), n in docs.items() if of == lang and n >= least]
        total = {t: sum(found[lang, s][t] for s in sources) for t in kept}

        def rates(count):
            size = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // size for t in kept}

        q = rates(total)
        p = {s: rates(found[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                some.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(some, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(60)] + ["Éa", "éA", "ñ", "日本", "THE", "the"]
    rows = [(" ".join(rng.choice(words[: rng.randint(3, 66)]) + rng.choice(("", ",", "'s", "\n", "\x00")) for _ in range(rng.randint(0, 40))), rng.choice(("en", "de", None, "")), f"s{min(int(rng.expovariate(0.7)), 6)}") for _ in range(n)]
    rows += rows[:10]  # repeated rows
    rows += [(None, "en", None), ("", "en", "quiet"), ("once upon", "xx", "a"), ("never again", "xx", "b"), ("the " * 5000, "en", "s0")]
    return rows


def given(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", None) for i, r in enumerate(rows)], DOCS)


@pytest.mark.parametrize("seed", range(2))
def test_audit(spark, seed):
    rows = rows_of(seed)
    got = divergence.audit(given(spark, rows).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_audit_of_few_groups_at_a_time_and_a_short_ranking(spark, monkeypatch):
    rows = rows_of(7)
    monkeypatch.setattr(divergence, "GROUPS", 2)
    assert sorted(map(tuple, divergence.audit(given(spark, rows), top=3).collect())) == plain(rows, top=3)


def test_audit_of_an_empty_table(spark):
    got = divergence.audit(given(spark, []))
    assert got.collect() == [] and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_tasks_work_piece_by_piece(monkeypatch):
    """Texts longer than a chunk, and keys that reach over several runs of rows."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows_of(3)]
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 100)
    monkeypatch.setattr(divergence, "CHUNK_ROWS", 7)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 20]], pa.string()) for k in (1, 2, 0)], names=["lang", "source", "text"]) for i in range(0, len(rows), 20)]
    counted = pa.Table.from_batches(list(divergence._count_texts(iter(batches)))).sort_by([("lang", "ascending"), ("term", "ascending")])
    shards = counted.to_batches(5)
    kept = pa.Table.from_batches(list(divergence._keep_terms(3)(iter(shards))))
    want = defaultdict(Counter)
    docs = Counter()
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        docs.update((lang, t) for t in set(terms))
        for t in terms:
            want[lang, t][source] += 1
    got = {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"], strict=True)) for r in kept.to_pylist()}
    assert got == {k: dict(c) for k, c in want.items() if docs[k] >= 3}
    told = []
    for lang in {k[0] for k in got}:
        v = sum(k[0] == lang for k in got)
        sums = Counter()
        for (of, _), c in got.items():
            if of == lang:
                sums.update(c)
        told += [(lang, s, v, sums[s], sum(sums.values())) for s in {r[2] for r in rows if r[1] == lang}]
    judged = pa.Table.from_batches(list(divergence._judge_shards(told, 200)(iter(kept.to_batches(9))))).to_pylist()
    pairs = Counter()
    for r in judged:
        if r["part"] == "pair":
            pairs[r["lang"], r["source"], r["item"]] += r["value"]
    assert pairs == {(r[0], r[1], r[3]): r[4] for r in plain(rows) if r[2] == "pair" and r[0] in {k[0] for k in got}}
    terms = {(r["lang"], r["source"], r["item"], r["value"]) for r in judged if r["part"] == "term"}
    assert terms == {(r[0], r[1], r[3], r[4]) for r in plain(rows, top=10**9) if r[2] == "term"}
