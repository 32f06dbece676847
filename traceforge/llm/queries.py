"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fim, html, langid, minhash, packing, ppm, quality, sharding, simhash, tokencount, whitening
from ._common import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int):
    """crc32(doc_id as text) mod ``divisor``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(remainder(4) != 2))
    return langid.identify(docs, model, keep=["doc_id"]).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = saved(simhash.with_edited(table(spark, sf_dir, "documents")), "fingerprints")
    return simhash.count_within(made, F.col("doc_id") % 100 == 0).drop("fa", "fb")


def op3_additive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False, keep=["doc_id"])


def op5_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs.filter(remainder(5) != 0), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings"))


def op12_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fim.transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    back = fim.restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_additive_neighbours, op4_byte_bpe, op5_wrapper_text, op6_token_counts, op7_attention_quality, op8_best_fit_packing, op9_minhash, op10_ppm_score, op11_tiled_whitening, op12_interleaved_shards, op13_fill_in_middle)}

_OP9 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(t[i : i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, least(len(t), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
c AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT c.root, e.b FROM c JOIN e ON e.a = c.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

#: CRC-32 of whole texts in pieces of 1024 bytes (the first has what is over): ``far`` moves a checksum over 1024 bytes.
_OP12 = r"""WITH k AS (SELECT n, list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)),
tab AS (SELECT list(v ORDER BY n) AS tab FROM k),
far AS (SELECT list(v ORDER BY i) AS far FROM (SELECT i, list_reduce([1::BIGINT << i] || range(1024), lambda c, b: xor(c >> 8, tab[(c & 255) + 1])) AS v FROM range(32) r(i), tab)),
b AS (SELECT doc_id, source, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents),
p AS (SELECT doc_id, source, bytes, hex(x) AS x, unnest(range(0, bytes // 1024 + 1)) AS i FROM b),
q AS (SELECT doc_id, source, bytes, i, CASE WHEN i = 0 THEN x[1:2 * (bytes % 1024)] ELSE x[2 * (bytes % 1024 + 1024 * (i - 1)) + 1:2 * (bytes % 1024 + 1024 * i)] END AS x FROM p),
c AS (SELECT doc_id, source, bytes, i, list_reduce([CASE WHEN i = 0 THEN 4294967295 ELSE 0 END] || list_transform(range(1, length(x), 2), lambda j: CAST('0x' || x[j:j + 1] AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])) AS v FROM q, tab),
l AS (SELECT doc_id, source, bytes, list(v ORDER BY i) AS v FROM c GROUP BY ALL),
z AS (SELECT doc_id, source, bytes + 8 AS size, xor(list_reduce(v, lambda c, d: xor(d, list_reduce([0::BIGINT] || range(32), lambda s, j: CASE WHEN (c >> j) & 1 = 1 THEN xor(s, far[j + 1]) ELSE s END))), 4294967295) AS text_crc32, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM l, far),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source)) AS f FROM z),
g AS (SELECT *, row_number() OVER (ORDER BY f, key) - 1 AS g, count(*) OVER () AS n FROM r), s AS (SELECT *, g * 24 // n AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(g - (shard * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_OP13 = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
r AS (SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
c AS (SELECT *, array_to_string(t[1:i], '') AS p, array_to_string(t[i + 1:j], '') AS m, array_to_string(t[j + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""

#: Queries that SQL can express.
ORACLES: dict[str, str] = {"op9_minhash": _OP9, "op12_interleaved_shards": _OP12, "op13_fill_in_middle": _OP13}
