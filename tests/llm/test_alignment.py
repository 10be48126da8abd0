"""op12: segments, links and corpus counts against the two libraries on whole texts and plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphloom.llm import alignment
from glyphloom.llm.token_counts import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, chunk long, b int, kind string"


@pytest.fixture(scope="module")
def aligner():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        found = alignment.Aligner(f.read(), g.read())
    assert found.cuts
    return found


def tokens(aligner, text):
    """(id, bytes) of both, of the whole text at once."""
    byte_of = {c: i for i, c in enumerate(byte_characters())}
    a = aligner.a.encode(" " + text, add_special_tokens=False)
    pieces = [(i, aligner.b.id_to_piece(i)) for i in aligner.b.encode(text)]
    return [(i, bytes(byte_of[c] for c in aligner.a.id_to_token(i))) for i in a.ids], [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in pieces]


def plain(aligner, texts):
    count, each = Counter(), []
    for t in texts:
        a, b = tokens(aligner, t) if t else ([], [])
        if not t or not (b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode()):
            each.append(((0, 0, 0), [], ""))
            continue
        spans = []
        for some in (a, b):
            at, own = 0, []
            for i, x in some:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        joint = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, k, links = [], 0, []
        for stop in sorted(joint):
            groups.append("|".join(",".join(str(i) for s, e, i in own if k < e <= stop) for own in spans))
            k = stop
        j = 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            m = j
            while m < len(spans[1]) and spans[1][m][0] < e:
                links.append((i, spans[1][m][2]))
                m += 1
        count.update(links)
        each.append(((len(a), len(b), len(joint)), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*sizes, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest) for sizes, links, digest in each]


ODD = [None, "", " ", "  a", "a ", "\n", "a\n\nb  c\t d\r\n e;\r\nf", "<|endoftext|> x <s></s>", "lower▁space", "<0x41> z", "x" * 3000, "é ñ 日本語 　 \xa0b", "a\x00b", "\t\ttabs\n", "👍🏽 ok", "don't stop \x85 x\x1cy", "﻿ bom", "ﬁ ½ é"]


def rows(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, "clash", 5, 6, "doc") for i, t in enumerate(texts)], DOCS)


def key(r):
    return str(r[0]), r[1:]


def test_alignments(spark, aligner):
    rng = random.Random(4)
    words = [rng.choice(("the", "ofananinor", "einbekeit,", "naïve", "x1y2", "co-op.")) + rng.choice(("", "s", "ly", "\n", "  ")) for _ in range(50)]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    texts += texts[-3:]
    want = [(None if i == 3 else i, *r) for i, r in enumerate(plain(aligner, texts))]
    got = alignment.alignments(rows(spark, texts).repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(not r[1] for r in want) >= 3 and sum(r[5] > 0 for r in want) > 45


def test_alignments_of_hot_side_ids(spark, aligner, monkeypatch):
    monkeypatch.setattr(alignment, "SALT_POSTINGS", 2)
    texts = ["the same words here", None] * 30 + ["the other, the same"]
    got = alignment.alignments(rows(spark, texts).repartition(7), A, B).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((None if i == 3 else i, *r) for i, r in enumerate(plain(aligner, texts))), key=key)
    assert alignment.alignments(rows(spark, []), A, B).collect() == []
    assert [tuple(r)[1:] for r in alignment.alignments(rows(spark, [None, ""]), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_long_texts_and_forgotten_segments(aligner, monkeypatch):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randint(0, 300)}{rng.choice(('', '.', chr(10)))}" for _ in range(3000))
    whole = aligner.chunk([text])
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 500)
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    cut = aligner.chunk([text])
    assert whole[1] == cut[1] and all((x == y).all() for x, y in zip((whole[0], *whole[2:]), (cut[0], *cut[2:]), strict=True))
    bad = aligner.chunk([text + " ▁"])
    assert not bad[0].any() and bad[1] == [""] and not len(bad[2])
    aligner.forget()


def test_without_cuts_the_results_are_the_same(aligner, monkeypatch):
    aligner.forget()
    cut = aligner.chunk([t or "" for t in ODD])
    aligner.forget()
    monkeypatch.setattr(aligner, "cuts", False)
    whole = aligner.chunk([t or "" for t in ODD])
    assert cut[1] == whole[1] and all((x == y).all() for x, y in zip((whole[0], *whole[2:]), (cut[0], *cut[2:]), strict=True))
    aligner.forget()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab; .\r\n\t\x0b\x0c\x1c\x85\xa0 é日'1́▁<>"), max_size=30))
def test_segments_encode_like_the_whole(aligner, text):
    a, b = tokens(aligner, text)
    counts, digests, _, _ = aligner.chunk([text])
    (want,) = plain(aligner, [text])
    assert (*counts[:, 0].tolist(), digests[0]) == (*want[:4], want[6])
    assert counts[0, 0] in (0, len(a)) and counts[1, 0] in (0, len(b))


def test_every_text_of_the_smallest_table(aligner):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for text in texts:
        counts, digests, _, _ = aligner.chunk([text or ""])
        (want,) = plain(aligner, [text])
        assert (*counts[:, 0].tolist(), digests[0]) == (*want[:4], want[6])


def test_a_text_that_the_first_vocabulary_does_not_give_back(aligner, monkeypatch):
    """Of a vocabulary whose entry stands for other bytes: the segment is not good, the others are."""
    aligner.forget()
    (odd,) = aligner.a.encode(" odd", add_special_tokens=False).ids
    monkeypatch.setattr(aligner, "a_bytes", [b"?" * len(x) if i == odd else x for i, x in enumerate(aligner.a_bytes)])
    counts, digests, keys, _ = aligner.chunk(["fine text", "an odd text", "text"])
    assert counts[:, 1].tolist() == [0, 0, 0, 0] and digests[1] == "" and set((keys & 0xFFFF).tolist()) == {0, 2}
    aligner.forget()
    monkeypatch.undo()
    again = aligner.chunk(["fine text", "x", "text"])
    assert (again[0][:, [0, 2]] == counts[:, [0, 2]]).all() and again[1][0] == digests[0]
    aligner.forget()
