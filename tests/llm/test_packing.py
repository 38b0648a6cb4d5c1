import zlib

import numpy as np
import pytest

from palimpsest.llm import packing as P

TEXTS = ["", "plain words, and more.", "İstanbul Σας ΣΑΣ áb é", "x\xa0y z \x1cq\u0085r", "it's I'LL don't ''s a1b22c 's'tdef", "<|endoftext|> hi <|startoftext|>there",
         "ÀÉ×÷ ǅ ǆ Ⱥ ɐ", "a­b ªº½² ẞ", "日本語 テスト 123", "\x00\x01 ok﻿", "**$$ ...! a_b __", "\t\n\r\x0b\x0c", "é ́x ǫ́", "🙂🙂a 1२३"]


@pytest.fixture(scope="module")
def encoder():
    return P.encoder(P.default_tokenizer())


def test_ids_are_the_tokenizers_own(encoder):
    assert encoder.by_word
    for text in [*TEXTS, " ".join(TEXTS)]:
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_texts_encoded_together_and_alone_are_the_same(encoder):
    texts = [t.encode() for t in TEXTS * 2]
    assert encoder.many(texts) == [encoder.whole(t) for t in texts]
    assert encoder.many([]) == []


def test_every_plain_letter_has_its_own_ids(encoder):
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x240)]]
    texts = [f"x{c}y {c}1{c}{c} '{c} a" for c in letters]
    assert encoder.many([t.encode() for t in texts]) == [encoder.whole(t.encode()) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_random_runs_have_the_tokenizers_ids(encoder, seed):
    random = np.random.default_rng(seed)
    signs = np.array(list("etaoinshrdlucmfwyp" * 3 + "'.,!#*-_0189éßñçÀŁ×÷İ" * (1 + seed) + "'vlx" + "   \n\t"))
    texts = ["".join(random.choice(signs, 3000)) for _ in range(20)]
    assert encoder.many([t.encode() for t in texts]) == [encoder.whole(t.encode()) for t in texts]


def test_neighbours_follow_plain_bm25():
    random = np.random.default_rng(1)
    docs = [np.append(random.integers(3, 60, random.integers(1, 30)), 2).astype("<u4") for _ in range(80)]
    index, used = P.Index(docs), np.zeros(80, bool)
    used[::7] = True
    held = {t: sum(t in d[:-1] for d in docs) for t in range(3, 60)}
    average = np.mean([len(d) for d in docs])
    for seed in range(80):
        terms = sorted((t for t in set(docs[seed][:-1].tolist()) if held[t] > 1), key=lambda t: (held[t], t))[:P.QUERY_TERMS]
        scores = {}
        for n, d in enumerate(docs):
            count = [int((d[:-1] == t).sum()) for t in terms]
            if any(count) and not used[n]:
                scores[n] = sum(np.log(1 + (80 - held[t] + .5) / (held[t] + .5)) * c * (P.K1 + 1) / (c + P.K1 * (1 - P.B + P.B * len(d) / average)) for t, c in zip(terms, count))
        got = list(index.neighbours(seed, used))
        assert sorted(got) == sorted(scores)
        assert all(scores[a] >= scores[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_every_id_once_and_no_padding(spark, encoder):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id"), (77, None), (78, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as id", "3 as `order`")
    got = P.retrieval_packs(df, window=64, shard_bytes=20000).collect()
    lengths, pieces = {}, {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths.get(r["sequence_id"], 0)
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
        pieces.setdefault(r["id"], []).append(r)
    assert all(n <= 64 and n & (n - 1) == 0 for n in lengths.values())
    for id_, text in rows:
        ids = np.append(np.frombuffer(encoder.ids((text or "").encode()), "<u4"), 2).astype("<u4")
        own = [r for r in pieces[id_] if r["doc_tokens"] == len(ids)]
        assert {zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in own} >= {r["ids_crc32"] for r in own} or id_ == 3
        covered = sorted((r["start"], r["start"] + r["length"]) for r in own)
        times = sum(1 for i, t in rows if i == id_ and len(encoder.ids((t or "").encode())) == len(encoder.ids((text or "").encode())))
        assert sum(b - a for a, b in covered) == times * len(ids)


def test_empty_table(spark):
    assert P.retrieval_packs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_terms_of_a_long_seed_count():
    rare, shared = np.arange(1000, 1040), np.arange(100, 400)
    docs = [np.concatenate([rare, shared, [2]])] + [np.array([t, 3000 + t, 2]) for t in rare] + [np.append(shared, 2)] * 2
    docs = [d.astype("<u4") for d in docs]
    used = np.arange(len(docs)) == 0
    assert list(P.Index(docs).neighbours(0, used))[:2] == [41, 42]
    held = {t: sum(t in d[:-1] for d in docs) for t in docs[0][:-1].tolist()}
    average, plain = np.mean([len(d) for d in docs]), []
    for d in docs[1:]:
        terms = set(d[:-1].tolist()) & held.keys()
        plain.append(sum(np.log(1 + (len(docs) - held[t] + .5) / (held[t] + .5)) * (P.K1 + 1) / (1 + P.K1 * (1 - P.B + P.B * len(d) / average)) for t in terms))
    assert list(P.Index(docs).neighbours(0, used)) == (1 + np.argsort(-np.array(plain).round(6), kind="stable")).tolist()


def test_all_neighbours_in_order_beyond_the_first():
    random = np.random.default_rng(5)
    docs = [np.append(random.integers(3, 40, random.integers(1, 12)), 2).astype("<u4") for _ in range(400)]
    index, used = P.Index(docs), random.random(400) < 0.2
    for seed in range(0, 400, 7):
        total = index.scores(seed, 400)
        found = [] if total is None else np.flatnonzero((total > 0) & ~used)
        assert list(index.neighbours(seed, used)) == sorted((int(n) for n in found), key=lambda n: (-total[n], n))


def test_copies_are_in_different_sequences_while_others_are_left():
    random = np.random.default_rng(3)
    docs = [np.append(random.integers(3, 300, random.integers(10, 40)), 2).astype("<u4") for _ in range(60)] * 3
    docs += [np.array([2], "<u4")] * 5
    held = {}
    for number, start, length, sequence, _ in P.pack(docs, 128):
        if start == 0:
            held.setdefault(sequence, []).append(docs[number].tobytes())
    last = max(held)
    assert sum(len(v) for v in held.values()) == len(docs)
    for sequence, starts in held.items():
        if sequence < last - 8:
            assert len(starts) == len(set(starts))


@pytest.mark.parametrize("seed", range(4))
def test_runs_apart_are_those_of_the_pattern(seed):
    random = np.random.default_rng(seed)
    signs = np.array(list("strevmld" * 2 + "'" * 4 + "..#_09é" + "  \t\0"))
    for _ in range(200):
        text = "".join(random.choice(signs, random.integers(1, 60)))
        assert P.runs_apart(text.encode()).split() == P._RUNS.findall(text)
