"""The grouped prefix join, components, M-tree search and WARC archives, against brute force and round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, components, group_join, mtree, warc_store

WORDS = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORDS.findall(lower(t or ""))
        sets.append(set() if not w else {tuple(w)} if len(w) < n else set(zip(*(w[k:] for k in range(n)))))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(j)] = find(i)
    least: dict[int, int] = {}
    for j, (i, _) in enumerate(rows):
        if i is not None:
            least[find(j)] = min(least.get(find(j), i), i)
    return [(i, len(sets[j]), least.get(find(j)), links[j]) for j, (i, _) in enumerate(rows)]


def near_copies(seed: int, groups: int, copies: int) -> list[tuple[int, str]]:
    rnd, rows, i = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(20, 90))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randrange(0, 4)):
                text[rnd.randrange(len(text))] = f"v{rnd.randrange(5000)}"
            rows.append((i, " ".join(text)))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent, n, block", [(90, 3, 1000), (80, 5, 1000), (80, 3, 4)])
def test_join_is_exact(spark, docs_of, odd_rows, percent, n, block, monkeypatch):
    monkeypatch.setattr(group_join, "BLOCK_CLASSES", block)
    rows = near_copies(percent + block, 6, 12) + [(1000 + i if i else None, t) for i, t in odd_rows]
    got = group_join.join(docs_of(rows), n, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, n, percent), key=key)


def test_repeated_ids_with_different_texts_stay_apart(spark, docs_of):
    a, c = ([f"{x}{k}" for k in range(60)] for x in "ac")
    near = lambda words: " ".join([*words[:-1], "z"])
    rows = [(5, " ".join(c)), (5, " ".join(a)), (3, near(c)), (9, near(a)), (4, "q r s t"), (4, "u v w")]
    got = group_join.join(docs_of(rows), 3, 90).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 3, 90)) == sorted([(5, 58, 3, 1), (5, 58, 5, 1), (3, 58, 3, 1), (9, 58, 5, 1), (4, 2, 4, 0), (4, 1, 4, 0)])
    kept = group_join.one_of_each(docs_of(rows), 3, 90)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([rows[2], rows[1], rows[4], rows[5]])


@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_large_clusters_are_found_by_their_list(spark, docs_of, hot, monkeypatch):
    monkeypatch.setattr(group_join, "HOT", hot)
    monkeypatch.setattr(group_join, "BLOCK_CLASSES", 4)
    rows = near_copies(8, 5, 9)
    got = group_join.join(docs_of(rows), 3, 80).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 3, 80))


def test_verify_by_bits_and_by_lists_agree():
    rnd = np.random.default_rng(0)
    base = np.unique(rnd.integers(0, 1 << 60, 80).astype(np.uint64))
    alike = [np.unique(np.concatenate([rnd.choice(base, 70, False), rnd.integers(0, 1 << 60, 5).astype(np.uint64)])) for _ in range(40)]
    apart = [np.unique(rnd.integers(0, 1 << 60, 75).astype(np.uint64)) for _ in range(40)]
    for members in (alike, apart + alike[:4]):
        members = sorted(members, key=len)
        sizes = np.array([len(x) for x in members])
        root, links = group_join.verify(sizes, members, None, np.ones(len(members), np.int64), 70)
        want = [sum(1 for j, y in enumerate(members) if j != i and 170 * len(np.intersect1d(x, y)) >= 70 * (len(x) + len(y))) for i, x in enumerate(members)]
        assert links.tolist() == want and (root <= np.arange(len(members))).all()


def test_join_of_an_empty_table(spark, docs_of):
    assert group_join.join(docs_of([(1, "a b c")]).where("false")).count() == 0


def test_one_document_of_each_group_stays(spark, docs_of, odd_rows):
    rows = near_copies(5, 4, 6) + [(1000 + i if i else None, t) for i, t in odd_rows]
    df = docs_of(rows)
    kept = group_join.one_of_each(df, 3, 80)
    assert kept.columns == df.columns
    expect = brute(rows, 3, 80)
    groups = {c for _, size, c, _ in expect if size}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i, (_, size, _, _) in zip((r[0] for r in rows), expect) if not size) == sorted(i for i in ids if i in (1001, 1002, 1003))
    assert sorted(i for i in ids if i not in (1001, 1002, 1003)) == sorted(groups)


def test_repeated_rows_without_words_all_stay(spark, docs_of):
    blank = [(1, ""), (1, ""), (2, None), (2, None), (None, " \n\x0b\t "), (None, " \n\x0b\t "), (None, None), (None, None)]
    words = [(7, "one two three"), (7, "one two three"), (8, "\xa0"), (8, "\xa0")]
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in group_join.one_of_each(docs_of(blank + words), 3, 90).collect())
    assert kept == sorted((str(i), str(t)) for i, t in blank + words[::2])


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("shard", [30, 100_000])
def test_search_is_exact(spark, shard):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 8)).astype(np.float32)
    x[150:170] = x[3]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[50].tolist()), (900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (904, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, mtree.top(df, lambda c: c % 50 == 0, 5, shard).collect()))
    ints = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for a, (i, q) in enumerate(ints):
        if i % 50 == 0:
            best = sorted(((-int(q @ y), j) for b, (j, y) in enumerate(ints) if b != a))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_the_tree_saves_distances_on_groups():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 16)) * 10
    x = np.floor(256 * (centres[rnd.integers(0, 20, 4000)] + rnd.normal(size=(4000, 16)) * 0.1)).astype(np.int64)
    tree = mtree.Tree(np.arange(4000), x)
    *_, computed = tree.search(x[:1], np.array([mtree.NONE]), 5)
    assert computed < 2500
    for start, end in zip(tree.start, tree.end):
        assert end - start <= mtree.PAGE


def test_limits_from_another_tree_hold():
    rnd = np.random.default_rng(3)
    x, q = rnd.integers(-300, 300, (3000, 12)), rnd.integers(-300, 300, (40, 12))
    tree, ip = mtree.Tree(np.arange(3000), x), q @ x.T
    floor = np.sort(ip, 1)[:, -3].copy()
    filled, scores, ids, _ = tree.search(q, floor, 6)
    for r in range(40):
        want = sorted(((-int(s), i) for i, s in enumerate(ip[r]) if s >= floor[r]))[:6]
        assert list(zip((-scores[r, : filled[r]]).tolist(), ids[r, : filled[r]].tolist())) == want


def test_vectors_too_long_for_floats_are_exact():
    x = np.array([[1 << 30, 3], [1 << 30, 2], [5, 1 << 30], [0, 0]], np.int64)
    filled, scores, ids, _ = mtree.Tree(np.arange(4), x).search(x[:1], np.array([mtree.NONE]), 3)
    assert ids[0].tolist() == [0, 1, 2] and scores[0].tolist() == [(1 << 60) + 9, (1 << 60) + 6, (5 << 30) + (3 << 30)]


def test_search_in_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.top(df, lambda c: c % 50 == 0).count() == 0


def sha(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("roll", [1, 700, 1 << 24])
def test_archives_round_trip(spark, roll):
    rows = [(5, "http://a/5", "<p>same</p>"), (3, "http://a/3\n", "<p>same</p>"), (9, None, None), (8, "", ""), (None, "n", "<p>same</p>"), (7, "u", "é" * 5000), (3, "http://a/3\n", "<p>same</p>"), (11, "v", "only")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    folder = common.scratch(spark, "test-warc")
    listed = warc_store.write(pages, folder, roll=roll)
    assert listed.agg({"records": "sum"}).first()[0] == len(rows)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_store.read(spark, folder).collect()), key=str)
    want = []
    seen = set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "") == (h or "") and j is not None)
        revisit = first != i or (i, data) in seen
        seen.add((i, data))
        want.append((i, len(data), sha(data), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_archives_are_equal_bytes_and_standard_gzip(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k}", "text " * k) for k in range(20)], "page_id long, url string, html string")
    names = []
    for _ in range(2):
        folder = common.scratch(spark, "test-warc")
        names.append(sorted((r["name"], r["sha256"]) for r in warc_store.write(pages, folder).collect()))
        for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).collect():
            assert gzip.decompress(r["content"]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert names[0] == names[1]


def test_archives_do_not_depend_on_the_session(spark, tmp_path):
    n, kept = 50_000, spark.conf.get("spark.sql.shuffle.partitions")
    pages = spark.range(n).select((F.col("id") * 7919 % n).alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.concat(F.lit("text "), (F.col("id") % 900).cast("string"), F.repeat(F.lit("x"), 40)).alias("html"))
    found = []
    try:
        for partitions, spread in ((4, 3), (4, 3), (7, 11)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            listed = warc_store.write(pages.repartition(spread), common.scratch(spark, "test-warc"), roll=200_000, size=1 << 20)
            found.append(sorted((r["name"], r["records"], r["sha256"]) for r in listed.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] == found[2] and len({x[0][:11] for x in found[0]}) > 4 and sum(x[1] for x in found[0]) == n


@pytest.mark.parametrize("hot", [1, 2, 3, 100])
def test_references_of_hot_payloads(spark, hot, monkeypatch):
    monkeypatch.setattr(warc_store, "HOT", hot)
    slim = spark.createDataFrame([(5, b"a"), (3, b"a"), (None, b"a"), (1, b"b"), (2, b"c"), (9, b"c"), (9, b"c")], "page_id long, digest binary")
    got = sorted(((r["page_id"] or 0, bytes(r["digest"]), r["first"]) for r in warc_store.references(slim).collect()))
    assert got == [(0, b"a", 3), (2, b"c", 2), (3, b"a", 3), (5, b"a", 3), (9, b"c", 2)]


def test_archives_of_an_empty_table(spark):
    folder = common.scratch(spark, "test-warc")
    warc_store.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc_store.read(spark, folder).count() == 0


@pytest.mark.parametrize("bound", [20_000, 42_123, 65_006, 69_999])
@pytest.mark.parametrize("short", [0, 1, 10])
def test_many_equal_short_vectors(bound, short):
    # The square of the longest norm is ``bound``: four squares.
    far = next([a, b, c, d] for a in range(int(bound**0.5), 0, -1) for b in range(int((bound - a * a) ** 0.5), -1, -1) for c in [int((bound - a * a - b * b) ** 0.5)] for d in [round((bound - a * a - b * b - c * c) ** 0.5)] if a * a + b * b + c * c + d * d == bound)
    x = np.array([[short, 0, 0, 0]] * 700 + [far], np.int64)
    tree = mtree.Tree(np.arange(701), x)
    assert tree.bound == bound and all(e - s <= mtree.PAGE for s, e in zip(tree.start, tree.end))
    assert sorted(tree.obj[tree.child < 0].tolist()) == list(range(701))
    q = np.array([[3, 1, 0, 2]], np.int64)
    want = sorted(((-int(s), i) for i, s in enumerate(x @ q[0])))[:5]
    filled, scores, ids, _ = tree.search(q, np.array([mtree.NONE]), 5)
    assert list(zip((-scores[0]).tolist(), ids[0].tolist())) == want


def test_most_cells_of_grouped_vectors_are_never_met(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    centre = rnd.normal(size=(12, 24)) * 4
    x = (centre[np.arange(2400) % 12] + 0.05 * rnd.normal(size=(2400, 24))).astype(float)
    x *= 4 / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs = {}
    plain = mtree.reached

    def counted(blocks, own, radius):
        out = plain(blocks, own, radius)
        pairs["all"] = sum(len(r["keys"]) for r in blocks.collect()) * len(radius)
        pairs["kept"] = sum(len(r["keys"]) for r in out.collect())
        return out

    monkeypatch.setattr(mtree, "reached", counted)
    got = sorted(map(tuple, mtree.top(df, lambda c: c % 50 == 0, 5, 200).collect()))
    whole = np.floor(256 * x).astype(np.int64)
    want = []
    for q in range(0, 2400, 50):
        score = whole @ whole[q]
        best = sorted((i for i in range(2400) if i != q), key=lambda i: (-score[i], i))[:5]
        want += [(q, k + 1, i, int(score[i])) for k, i in enumerate(best)]
    assert got == sorted(want)
    assert pairs["kept"] < pairs["all"] / 3, pairs
