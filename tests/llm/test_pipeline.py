"""The corpus pipeline, each stage held against brute force on its own input."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_operators import SPACED, brute_hits, counts, fingerprint, prose, repeated_runs, roots

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("tables")
    passage, leak = prose(rng, 60), " ".join(f"b{rng.randint(10, 60)}" for _ in range(40))
    clean = [f"{prose(rng, rng.randint(40, 90))}\n{prose(rng, rng.randint(20, 70))}" for _ in range(30)]
    texts = [*clean, *(f"{prose(rng, 30)}\n{passage}\n{prose(rng, 25)}" for _ in range(6)), *clean[:4], clean[4].replace(" w", "  W", 3)]
    texts += [f"{prose(rng, 40)} {leak} {prose(rng, 20)}", "too short", None, "", " ".join(w + "$$$" for w in prose(rng, 90).split())]
    junk = [" ".join(w[:-1] + "#" for w in prose(rng, rng.randint(60, 160)).split()) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*texts, *junk])]
    rows += [(None, prose(rng, 70), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < len(texts) - 4), 0) for i in range(len(rows) - 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), leak


def test_stages(spark, folder):
    sf_dir, leak = folder
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    columns, before = docs.columns, docs.collect()
    for name, stage in stages.items():
        docs = stage(spark, docs, sf_dir).persist()
        after = docs.collect()
        assert docs.columns == columns
        old, new = {r.doc_id: r.text for r in before}, {r.doc_id: r.text for r in after}
        if name == "quality_rules":
            base = {i for i, t in old.items() if counts(t)[0] >= 50 and 100 * counts(t)[4] <= 50 * counts(t)[0]}
            assert set(new) == {i for i in base if "#" not in old[i] and "$$$" not in old[i]} and all(old[i] == t for i, t in new.items())
        elif name == "line_dedup":
            order = sorted(new, key=lambda i: (i is None, i))
            assert not repeated_runs([new[i] for i in order], 50) and 30 < len(new) < len(old)
            assert all(new[i] == old[i] for i in range(30))
        elif name == "simhash_near_dedup":
            ids = sorted(old, key=lambda i: (i is None, i))
            classes = roots([fingerprint(old[i]) for i in ids], ids)
            assert len(after) == len(set(classes)) and {i for i in new if i is not None} == {c for c in classes if c is not None}
        elif name == "benchmark_decontamination":
            assert set(new) == set(old) and not any(brute_hits(t, [(1, leak)])[1] for t in new.values())
            assert sum(new[i] != old[i] for i in new) == 1
        else:
            assert set(new) <= set(old) and all(new[i] == old[i] for i in new) and max(Counter(r.doc_id for r in after).values()) <= 2
            words = sum(len(SPACED.findall(r.text)) for r in after) / sum(len(SPACED.findall(t)) for t in old.values())
            assert 1.2 < words < 1.8
        before = after


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder[0])
    again = corpus_pipeline.run(spark, folder[0])
    assert found.where(F.col("n_chars") != F.length("text")).count() == 0
    key = lambda df: sorted(map(str, df.collect()))
    assert key(found) == key(again)


def test_run_of_empty_and_clashing_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 50 or doc_id is null")
    more = docs.withColumns({"row": F.lit("r"), "text_key": F.lit(1), "counts": F.lit(2), "found": F.lit("f"), "n_words": F.lit(None).cast("int"), "place": F.lit(3), "own_id": F.lit(4), "_id": F.lit(5)})
    for name, rows in (("empty", docs.limit(0)), ("more", more.unionByName(more.limit(5)))):
        path = f"{tmp_path}/{name}"
        rows.write.parquet(f"{path}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{folder[0]}/{other}.parquet").write.parquet(f"{path}/{other}.parquet")
        found = corpus_pipeline.run(spark, path)
        assert found.columns == rows.columns and (found.count() > 10) == (name == "more")
        assert found.where("n_chars != length(text)").count() == 0
