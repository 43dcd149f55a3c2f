"""Spelling variants, periodic runs and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import common, periodic_runs, queries, spelling, winnowing


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def plain_forms(rows, every, least_length, least_count, ratio):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if len(word) < least_length:
                continue
            h = 1 if i is None else zlib.crc32(f"{i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if k >= least_count and len(w) >= least_length}
    out = {}
    for w in n:
        near = sorted((v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)), key=lambda v: (-n[v], v))
        out[w] = [near[0] if near and n[near[0]] >= ratio * n[w] else None, w, n[w], len(near), None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
        row[4] = n[row[0]] if row[0] else None
    return {w: tuple(row) for w, row in out.items()}


@pytest.fixture
def variant_rows(odd_rows):
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abÀé"), int(rng.integers(6, 10)))) for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = list(stems[int(rng.integers(12) * rng.random())])
            if rng.random() < 0.4:
                at = int(rng.integers(len(w)))
                w[at : at + int(rng.integers(2))] = [str(rng.choice(list("abé")))] * int(rng.integers(3))
            words.append("".join(w))
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else "-".join(words)))
    return [(None if i is None else i + 1000, t) for i, t in odd_rows] + rows + rows[:3] + [(None, rows[0][1])]


@pytest.mark.parametrize("shard, visitors", [(50_000, 200_000), (25, 4)])
def test_forms_against_all_pairs(spark, docs_of, variant_rows, monkeypatch, shard, visitors):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "VISITORS", visitors)
    got = spelling.forms(spelling.counts(docs_of(variant_rows), every=7, least_count=2), ratio=3).collect()
    want = plain_forms(variant_rows, 7, 6, 2, 3)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert sum(r.root not in (r.word, r.form) for r in got) and max(r.n_near for r in got) > 5


def test_scan_of_long_words_and_shared_prefixes_beyond_the_kept_ones():
    rng = np.random.default_rng(2)
    stem = "".join(rng.choice(list("ab"), 90))
    words = sorted({stem[:k] + c + stem[k + j :] for k in range(60, 90) for c in ("", "a", "c") for j in (0, 1)} | {stem})
    found = set()
    for side in (False, True):
        keys = sorted(w[::-1] for w in words) if side else words
        shard = spelling.Shard(keys, [1] * len(keys), side, 6)
        for w, n in zip(*(shard.best(keys).column(c).to_pylist() for c in (0, 1))):
            found.add((w, side, n))
    total = Counter()
    for w, _, n in found:
        total[w] += n
    assert total == {w: n for w in words if (n := sum(one_edit(w, v) for v in words))}


def test_a_long_word_does_not_heighten_the_matrices_of_others(monkeypatch):
    made = []
    full = np.full
    monkeypatch.setattr(spelling, "CELLS", 30_000)
    monkeypatch.setattr(np, "full", lambda shape, *a, **k: (made.append(int(np.prod(shape))), full(shape, *a, **k))[1])
    words = sorted({f"abcdef{'abcde'[k % 5]}{'abcdefghij'[k // 5 % 10]}{k}" for k in range(400)} | {"abcdef" * 500, "abcdef" * 500 + "g"})
    found = spelling.Shard(words, [1] * len(words), False, 6).best(words).column(0).to_pylist()
    assert {w for w in found if len(w) > 99} == {w for w in words if len(w) > 99} and max(made) <= 30_000


def test_no_words_no_forms(spark, docs_of):
    for rows in ([], [(1, None), (2, ""), (3, "short words only")]):
        assert spelling.forms(spelling.counts(docs_of(rows))).collect() == []


# -- periodic runs ----------------------------------------------------------------------------------------------


def plain_runs(words, shortest, times):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(shortest, times * q):
                out.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((s, k, q) for (s, k), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(i, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = plain_runs(words, 24, 3)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def random_documents(rng, how_many):
    for _ in range(how_many):
        n, kinds = int(rng.integers(0, 300)), int(rng.choice([1, 2, 3, 60]))
        words = rng.integers(0, kinds, n)
        for _ in range(int(rng.integers(0, 4))):
            a, p = sorted(rng.integers(0, max(n, 1), 2)) if n else (0, 0)
            p = max((p - a) // int(rng.integers(2, 9)), 1)
            b = int(rng.integers(a, n + 1))
            words[a:b] = words[a + np.arange(b - a) % p] if b > a else words[a:b]
        yield words


def test_runs_against_all_periods():
    rng = np.random.default_rng(11)
    for shortest, times in ((24, 3), (6, 3), (12, 5)):
        documents = list(random_documents(rng, 150))
        got = periodic_runs.runs(documents, shortest, times)
        assert [list(map(tuple, g.tolist())) for g in got] == [plain_runs(d.tolist(), shortest, times) for d in documents]


def test_extensions_against_a_loop():
    rng = np.random.default_rng(4)
    for _ in range(60):
        text = np.concatenate([[-1], rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(2, 150))), [-2]])
        rounds, n = periodic_runs.recompress(text), len(text)
        a, b = rng.integers(1, n - 1, (2, 40))
        a, b = a[a != b], b[a != b]
        right = [next(k for k in range(n) if text[i + k] != text[j + k]) for i, j in zip(a, b)]
        left = [next(k for k in range(n) if text[i - 1 - k] != text[j - 1 - k]) for i, j in zip(a, b)]
        assert periodic_runs.extension(rounds, a, b).tolist() == right
        assert periodic_runs.extension([r.mirrored() for r in rounds], n - a, n - b).tolist() == left


def test_run_query_against_brute_force(spark, docs_of, odd_rows):
    rng = np.random.default_rng(8)
    rows = [(i if i is None else i - 5, t) for i, t in odd_rows if len(t or "") < 9999] + [(10 + k, " \n ".join(f"w{x}" for x in d)) for k, d in enumerate(random_documents(rng, 120))]
    got = periodic_runs.digests(periodic_runs.scan(docs_of(rows), periodic_runs.planted)).drop("n_words").collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(*r) for r in rows), key=key)
    assert periodic_runs.scan(docs_of([])).collect() == []


def test_spans_of_a_long_text(spark, docs_of):
    (row,) = periodic_runs.scan(docs_of([(6, "long words " * 60_000 + "end")])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 2)] and row.collapsed == "long words end" and row.n_words == 120_001


# -- fingerprints -----------------------------------------------------------------------------------------------


def plain_fingerprint(text, k, w):
    points = [ord(c) for c in text]
    hashes = []
    for i in range(max(len(points) - k + 1, 1) if points else 0):
        h = 0
        for c in (points[i : i + k] + [-1] * k)[:k]:
            h = (h * winnowing._base + c + 2) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor % 2**64
        hashes.append(h ^ h >> 31)
    chosen = {max(range(s, min(s + w, len(hashes))), key=lambda j: (-hashes[j], j)) for s in range(max(len(hashes) - w, 0) + 1) if hashes}
    return [(hashes[p], p) for p in sorted(chosen)]


@pytest.mark.parametrize("k, w", [(8, 16), (5, 4), (7, 1), (1, 3), (12, 17)])
def test_winnowing_against_a_loop(k, w):
    rng = np.random.default_rng(k)
    texts = ["".join(rng.choice(list("abcé\U0001f600"[: int(rng.integers(1, 6))]), int(rng.integers(0, 150)))) for _ in range(50)]
    got = winnowing.winnow([winnowing.code_points(t) for t in texts], k, w)
    assert [list(zip(h.tolist(), p.tolist())) for h, p in got] == [plain_fingerprint(t, k, w) for t in texts]


def test_match_guarantee(spark, docs_of):
    shared = "a passage of 23 points."
    rows = docs_of([(1, "before it " + shared + " and behind"), (2, "quite another text, then " + shared)])
    one, two = (dict(zip(r.hashes, r.positions)) for r in winnowing.fingerprints(rows).orderBy("doc_id").collect())
    assert any(one[h] - two[h] == 10 - 25 for h in one.keys() & two.keys())


@pytest.mark.parametrize("many", [False, True])
def test_edits_against_a_loop(spark, docs_of, odd_rows, many):
    rng = np.random.default_rng(3)
    rows = odd_rows + [(100 + i, "".join(rng.choice(list("abc é"), int(rng.integers(0, 300))))) for i in range(80)] * (1 + many) if many else odd_rows
    got = winnowing.compare_edits(docs_of(rows).repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        mine, theirs, following = (plain_fingerprint(x, winnowing.K, winnowing.W) if len(x) < 9999 else None for x in (t, edited, after))
        alike = lambda a, b: None if a is None or b is None else 1.0 if not a + b else 2 * len({h for h, _ in a} & {h for h, _ in b}) / (len({h for h, _ in a}) + len({h for h, _ in b}))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(mine, theirs), alike(mine, following)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for g, x in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_chars, r.edited_sha256))), sorted(want, key=key), strict=True):
        assert (g.doc_id, g.n_chars, g.edited_sha256) == x[:3]
        assert all(b is None or a == b for a, b in ((g.near_edited, x[3]), (g.near_next, x[4])))
    prints = {(r.n_chars, r.fingerprint) for r in got}
    assert len(prints) == len({t or "" for _, t in rows})


def test_few_rows_follow_themselves(spark, docs_of):
    (row,) = winnowing.compare_edits(docs_of([(3, "abcdef")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1
    assert [r.near_next for r in winnowing.compare_edits(docs_of([(None, None), (None, "")])).collect()] == [1, 1]
    assert winnowing.compare_edits(docs_of([])).collect() == []


def test_half_replaced_texts_stay_alike_and_others_are_not(spark, sf_dir):
    rows = winnowing.compare_edits(common.table(spark, sf_dir, "documents").where("n_chars >= 100")).toPandas()
    assert rows.near_edited.quantile(0.05) > 0.3 and rows.near_next.median() < 0.05


def test_forms_of_the_smallest_tables(spark, sf_dir):
    from compare import difference

    assert difference(spark, queries.op11_spelling_forms, queries.ORACLES["op11_spelling_forms"], sf_dir) == ""
