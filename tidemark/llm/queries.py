"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, common, group_join, language_id, mtree, ordinal_toxicity, periodic_runs, quality_gbt, repair_store, sos_packing, spelling, warc_store, winnowing, word_table_bpe

#: Where the vocabulary files are; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """The file's place on this machine; the package that describes the vocabularies knows it where it is installed."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_mod(F.col("doc_id"), 7) == 2
    return brown_lm.score(*brown_lm.train(docs, ~held_out))


def op2_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "token-ids")
    repair_store.write(common.table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end=1)
    return repair_store.read(spark, folder)


def op3_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table_bpe.encode_decode(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return ordinal_toxicity.score(docs, ordinal_toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top(common.table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op6_sos_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sos_packing.pack(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2)


def op7_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    warc_store.write(common.table(spark, sf_dir, "pages"), folder)
    return warc_store.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality_gbt.judge(docs, quality_gbt.learn(docs, common.table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_mod(F.col("doc_id"), 5) == 0
    return language_id.predict(docs, language_id.learn(docs, ~held_out), held_out)


def op10_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.join(common.table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.forms(spelling.counts(common.table(spark, sf_dir, "documents"), every=199))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.scan(common.table(spark, sf_dir, "documents"), periodic_runs.planted))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edits(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_lm": op1_brown_lm,
    "op2_repair_ids": op2_repair_ids,
    "op3_word_table_bpe": op3_word_table_bpe,
    "op4_ordinal_toxicity": op4_ordinal_toxicity,
    "op5_mtree": op5_mtree,
    "op6_sos_packing": op6_sos_packing,
    "op7_warc_store": op7_warc_store,
    "op8_quality_gbt": op8_quality_gbt,
    "op9_language_id": op9_language_id,
    "op10_group_join": op10_group_join,
    "op11_spelling_forms": op11_spelling_forms,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_winnowing": op13_winnowing,
}
#: Whole results of four operators in SQL: all pairs of vectors, digests of pages, the closure of linked documents, and words that
#: agree when one code point is taken out of one or both (crc32 bit by bit).
ORACLES: dict[str, str] = {
    "op5_mtree": """WITH v AS (SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.nth, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score FROM v q JOIN v ON q.nth <> v.nth AND len(q.v) = len(v.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_warc_store": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substring(hex, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - k % 4 * 5)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op10_group_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT doc_id, hash(unnest(s)) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM t WHERE t.a = doc_id), doc_id)) AS component_id, (SELECT count(*) FROM e WHERE e.a = doc_id) AS n_links FROM n""",
    "op11_spelling_forms": r"""WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS k, hex(encode(doc_id || ':' || w)) AS x FROM r WHERE length(w) >= 6 GROUP BY doc_id, w),
b AS (SELECT w, k, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substring(x, 2 * i + 1, 2) AS BIGINT)) AS y FROM c),
h AS (SELECT w, k, xor(4294967295, list_reduce(list_transform(range(0, 8 * len(y)), lambda i: (y[i // 8 + 1] >> CAST(i % 8 AS INTEGER)) & 1), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1)), 4294967295)) AS h FROM b),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
u AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM v, unnest(range(0, length(word))) AS t(i)),
p AS (SELECT a.word, b.word AS other FROM u a JOIN u b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT u.word, v.word FROM u JOIN v ON u.rest = v.word UNION SELECT v.word, u.word FROM u JOIN v ON u.rest = v.word),
q AS (SELECT p.word, other, v.n AS m, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, other) AS k, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN v ON other = v.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN q ON v.word = q.word AND k = 1),
t AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM f JOIN t ON f.form = t.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON f.word = t.word""",
}
