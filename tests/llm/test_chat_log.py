"""op5: the log that the query folds."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from glyphloom.llm import chat_format

TURNS = "conv_id long, turn long, role string, text string, kind string, message string"


def given(spark, rows):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], TURNS).repartition(4)


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(("user", "assistant", "system", None, "")), rng.choice((None, "", "a", "é ü", "long text " * rng.randint(1, 30), "</s>[INST] \\ x"))) for c in range(12) for t in range(rng.randint(1, 20))]
    rows += [(3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "assistant", "other"), (3, 1, "assistant", None), (None, None, None, None), (4, None, "user", "first"), (5, -3, "user", "before")]
    return rows + [(99, t, "user", f"hot {t}") for t in range(400)]


def test_a_log_folds_to_its_turns(spark):
    rows = rows_of(1)
    log = chat_format.streamed(given(spark, rows))
    assert log.columns == ["conv_id", "seq", "kind", "message", "role", "text"]
    kinds = Counter(r.kind for r in log.collect())
    assert set(kinds) == {"start", "delta", "edit", "regenerate", "delete"} and min(kinds.values()) > 20
    names = log.groupBy("message").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("seqs"), F.max("seq").alias("last"), F.min("seq").alias("first")).collect()
    assert len([r for r in names if not r.message.endswith("-draft")]) == len(rows) and all(r.message is not None and r.n == r.seqs >= 2 and r["last"] - r["first"] < chat_format.STEPS for r in names)
    back = chat_format.turns(log).select("conv_id", "role", "text").collect()
    assert Counter(map(tuple, back)) == Counter((c, r or "", t or "") for c, _, r, t in rows)


def test_digests_of_a_log(spark):
    rows = rows_of(2)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.rendered(chat_format.streamed(given(spark, rows)))).collect()}
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, messages in by.items():
        under = "".join(t for r, t in messages if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in messages), under)]
        assert tuple(got[c]) == (c, len(messages), sha[0], len(under), sha[1], len(chat_format.render(messages)[0]))
    assert chat_format.digests(chat_format.rendered(chat_format.streamed(given(spark, []).limit(0)))).count() == 0


def test_every_turn_of_the_query_comes_out_of_the_fold(spark):
    folder = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    log = chat_format.streamed(turns.select("conv_id", "turn", "role", "text"))
    assert log.where("message is null").count() == 0
    events = log.groupBy("kind").count().collect()
    assert sum(r["count"] for r in events) > 3 * turns.count() and {r.kind for r in events} == {"start", "delta", "edit", "regenerate", "delete"}
    got = chat_format.op5_chat_format(spark, folder)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert got.agg(F.sum("n_turns")).first()[0] == turns.count() + 2
