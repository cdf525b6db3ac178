"""The registered query of each operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, langid, licenses, minhash, packing, pii, quality, quality_gam, spelling, toxicity, urlfilter, whitening
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held))
    out = langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model)
    p = F.col("language")
    return out.select("doc_id", "held_out", p["lang"].alias("lang_pred"), p["score"].alias("score"), p["ambiguous"].alias("ambiguous"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.FEATURES, "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS (SELECT *, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM w),
s AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
k AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM k) GROUP BY doc_id),
f AS (SELECT b.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN r USING (doc_id)),
g AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_dup_lines > 3 * len(l)
    OR 2 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > word_chars
    OR 2 * (length(t) - length(regexp_replace(t, '\p{L}', '', 'g'))) < word_chars
    OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '\.\.\. *$'))) > 3 * len(l)
    OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) > 9 * len(l)) AS kept
FROM g
"""

def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(_tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    return packing.pack(_table(spark, sf_dir, "documents"), spec)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, _tokenizer_path(), digests=True).drop("text")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)
    return out.withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node AND r.root < u.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("licences")
    out = licenses.scan(docs, licenses.train(docs))
    return out.select("doc_id", F.size(found).cast("long").alias("n_licences"), F.concat_ws(",", found["family"]).alias("licences"), F.coalesce(F.array_max(found["probability"]), F.lit(0.0)).alias("score"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    p = F.col("pii")
    out = pii.find(docs, pii.train(docs))
    return out.select("doc_id", p["n_email"].alias("n_email"), p["n_ip"].alias("n_ip"), p["n_card"].alias("n_card"), p["n_phone"].alias("n_phone"), F.sha2(p["base"].cast("binary"), 256).alias("base_sha256"), p["spans"].alias("spans"))


def op3_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.similar_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP3_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
u AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node AND r.root < u.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.root AS component_id, vec_id = c.root AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", *[F.col("judged")[n].alias(n) for n in ("host", "path", "rule", "verdict")])


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, h || q AS rule, verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) = 1)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN m USING (page_id)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    out = toxicity.score(docs.select("doc_id", "text", held.alias("held_out")), toxicity.train(docs, labels))
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op11_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    out = quality_gam.score(docs.select("doc_id", "text", held.alias("held_out")), quality_gam.train(docs, labels))
    return out.select("doc_id", "held_out", F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # a run of under 7 code points stays under 7
    runs = docs.select("doc_id", F.explode(spelling.runs("text", least=7)).alias("w"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("w")).cast("binary"))
    runs = runs.select("w", h.alias("h"))
    cut = F.expr("concat(substring(w, 1, int(h % length(w))), substring(w, int(h % length(w)) + 2))")
    words = runs.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("w")).alias("word"))
    return spelling.variants(spelling.lexicon(words), ratio=10)


OP12_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i)),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS w FROM documents),
hex AS (SELECT w, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM run),
h AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i+1])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM hex, crc),
word AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word FROM h),
lex AS MATERIALIZED (SELECT word, count(*) AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM lex)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.c = b.c AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN lex b ON a.c = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN lex b ON a.c = b.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -n, 'w': other}) AS top FROM near GROUP BY word),
f AS MATERIALIZED (SELECT lex.word, lex.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -top.m >= 10 * lex.n THEN top.w END AS form, CASE WHEN -top.m >= 10 * lex.n THEN -top.m END AS form_n FROM lex LEFT JOIN best USING (word)),
up(word, far) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.far WHERE f.form IS NOT NULL),
root AS (SELECT up.word, up.far AS root FROM up JOIN f ON f.word = up.far WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, root.root FROM f JOIN root USING (word)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    n, shares, error = (model.n, model.explained.tolist(), model.identity_error) if model is not None else (0, [], None)
    out = whitening.whiten(vectors, model).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1) if shares else F.lit(None)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_pii": op2_pii,
    "op3_cover_tree_links": op3_cover_tree_links,
    "op4_url_filter": op4_url_filter,
    "op8_toxicity": op8_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing, "op7_bpe": op7_bpe, "op9_minhash_near_dedup": op9_minhash_near_dedup, "op6_language_id": op6_language_id, "op10_quality_rules": op10_quality_rules,
    "op11_quality_gam": op11_quality_gam,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
}
SQL = {"op12_spelling_variants": OP12_SQL, "op3_cover_tree_links": OP3_SQL, "op4_url_filter": OP4_SQL, "op9_minhash_near_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL}
