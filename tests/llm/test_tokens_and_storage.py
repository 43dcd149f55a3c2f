"""Exact ids, shard files, word tables and packing, against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import common, repair_store, sos_packing, tokens, word_table_bpe
from tidemark.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


def library(name):
    return tokenizers.Tokenizer.from_file(vocabulary(name))


@pytest.mark.parametrize("kind, name", [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_cached_encoder_is_exact(kind, name, limit, monkeypatch):
    monkeypatch.setattr(tokens, "LIMIT", limit)
    rnd, alphabet = random.Random(1), "aAbzé ß́̌'.,$\n\t \xa0 \x1c12İΣ<|>"
    texts = ["", " a\n\n b\t", "it's I'LL 'S", "a<|endoftext|>b <|ENDOFTEXT|>", "a\r\nb\x85d", " " * 40] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(500)]
    own = {"word": tokens.WordEncoder, "byte": tokens.ByteEncoder}[kind](vocabulary(name))
    got = [x for at in range(0, len(texts), 60) for x in own.encode([t.encode() for t in texts[at : at + 60]])]
    assert [g.tolist() for g in got] == [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]


def test_repair_round_trip_and_random_access():
    rnd = np.random.default_rng(0)
    docs = [np.append(rnd.integers(0, 50, n), 1).astype(np.uint32) for n in (0, 1, 5, 1000, 3000)] + [np.full(500, 7, np.uint32)]
    data = repair_store.pack(0, 0, 0, [1, 2, None, 4, 5, 6], docs, 49408)
    shard = repair_store.Shard(data)
    assert shard.doc_ids == [1, 2, None, 4, 5, 6] and shard.head["rules"] > 0
    for k in (5, 0, 3, 1, 4, 2):
        assert shard.document(k).tolist() == docs[k].tolist()
        for a, b in ((0, 3), (2, 2), (17, 900), (0, len(docs[k])), (len(docs[k]) - 1, len(docs[k]))):
            assert shard.span(k, a, b).tolist() == docs[k][a:b].tolist()
    assert (shard.lengths == np.diff(repair_store.expansions(shard.rules, 49408, shard.lengths)[1])[49408:]).all()


@pytest.mark.parametrize("base", [300, 65_530, 70_000, 200_000])
def test_repair_keeps_ids_of_any_vocabulary(base):
    rnd = np.random.default_rng(base)
    docs = [np.append(rnd.zipf(1.3, n).clip(0, base - 1), 1).astype(np.uint32) for n in rnd.integers(0, 3000, 60)] + [np.full(40, base - 1, np.uint32)]
    shard = repair_store.Shard(repair_store.pack(0, 0, 0, list(range(len(docs))), docs, base))
    assert shard.head["rules"] > 100 and shard.head["width"] == max(16, (base + shard.head["rules"] - 1).bit_length())
    for k, want in enumerate(docs):
        assert shard.document(k).tolist() == want.tolist() and shard.span(k, 1, 9).tolist() == want[1:9].tolist()


def test_repair_ends_when_no_pair_is_frequent():
    passage = np.random.default_rng(1).integers(0, 40_000, 3000).astype(np.uint32)
    docs = [np.append(passage, 1).astype(np.uint32) for _ in range(8)]
    ids, last = np.concatenate(docs), np.zeros(8 * 3001, bool)
    last[3000::3001] = True
    symbols, ends, rules = repair_store.compress(ids, last, 49408)
    pairs = (symbols[:-1].astype(np.int64) << 16 | symbols[1:])[~ends[:-1]]
    counts = np.unique(pairs, return_counts=True)[1]
    assert not len(counts) or counts.max() < repair_store.LEAST
    # Eight copies of a passage: each becomes very few symbols.
    assert len(symbols) <= 16 and ends.sum() == 8
    shard = repair_store.Shard(repair_store.pack(0, 0, 0, list(range(8)), docs, 49408))
    assert all(shard.document(k).tolist() == docs[k].tolist() for k in range(8))


def test_store_of_odd_rows(spark, docs_of, odd_rows):
    tok = library("word_bpe_49k.json")
    folder = common.scratch(spark, "test-ids")
    repair_store.write(docs_of(odd_rows), folder, vocabulary("word_bpe_49k.json"), shard=500)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair_store.read(spark, folder).collect()), key=lambda r: r[2])
    assert [g[:2] for g in got] == sorted(g[:2] for g in got) and len(got) == len(odd_rows)
    start = 0
    for g in got:
        assert g[2] == start
        start += g[3]
    want = sorted(zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in odd_rows)
    assert sorted(g[4] for g in got) == want


def test_store_of_an_empty_table(spark, docs_of):
    folder = common.scratch(spark, "test-ids")
    repair_store.write(docs_of([(1, "a")]).where("false"), folder, vocabulary("word_bpe_49k.json"))
    assert repair_store.read(spark, folder).count() == 0


@pytest.mark.parametrize("words", [150_000, 3])
def test_word_table_on_odd_rows(spark, docs_of, odd_rows, words, monkeypatch):
    monkeypatch.setattr(word_table_bpe, "BLOCK_WORDS", words)
    tok = library("word_bpe_49k.json")
    rows = word_table_bpe.encode_decode(docs_of(odd_rows), vocabulary("word_bpe_49k.json")).collect()
    key = lambda r: tuple(map(str, r))
    want = []
    for i, t in odd_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert word_table_bpe.encode_decode(docs_of(odd_rows).where("false"), vocabulary("word_bpe_49k.json")).count() == 0


def test_word_table_gives_ids_and_text(spark, docs_of):
    tok = library("word_bpe_49k.json")
    row = word_table_bpe.encode_decode(docs_of([(1, "Hello there, world")]), vocabulary("word_bpe_49k.json"), word_table_bpe.IDS).first()
    ids = tok.encode("Hello there, world", add_special_tokens=False).ids
    assert row["ids"] == ids and row["decoded"] == tok.decode(ids, skip_special_tokens=False)


def test_placement_follows_the_sum_of_squares():
    rnd = random.Random(3)
    lengths = [rnd.randrange(1, 30) for _ in range(300)]
    got, gaps = sos_packing.place(lengths, 30), {}
    for s, b in zip(lengths, got):
        count = {g: list(gaps.values()).count(g) for g in range(31)}

        def total(old, new):
            n = dict(count)
            if old is not None:
                n[old] -= 1
            if new:
                n[new] += 1
            return sum(n[g] ** 2 for g in range(1, 31))

        options = {g - s: total(g, g - s) for g in set(gaps.values()) if g >= s}
        options[30 - s] = min(total(None, 30 - s), options.get(30 - s, 1 << 60))
        old = gaps.get(b)
        assert total(old, (30 if old is None else old) - s) == min(options.values())
        gaps[b] = (30 if old is None else old) - s
        if not gaps[b]:
            gaps[b] = 0
    assert all(g >= 0 for g in gaps.values())


def test_packing_of_odd_rows(spark, docs_of, odd_rows):
    tok = library("byte_bpe_50k.json")
    rows = sos_packing.pack(docs_of(odd_rows), vocabulary("byte_bpe_50k.json"), end=2).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    assert sum(r["length"] for r in rows) == total
    assert len(by) <= -(-total // 1024) + 1
    assert sos_packing.pack(docs_of(odd_rows).where("false"), vocabulary("byte_bpe_50k.json")).count() == 0
