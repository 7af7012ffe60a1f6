"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenfold.llm import mixing, negatives, packing, pages, pivots, prefix_trie, quality, repeats, sharding, simhash, topk, toxicity, url_rules
from tokenfold.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RULES = [
    url_rules.Rule("net", "/", "block"), url_rules.Rule("example.net", "/en/", "allow"),
    url_rules.Rule("example.com", "/de/", "block"), url_rules.Rule("org", "/fr/", "allow"),
]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE["op1_segment_topk"] = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c AS (SELECT vec_id, unnest(v) x, generate_subscripts(v, 1) i FROM ok),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) score FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), RULES)


# n_candidates: each rule stands under one token, so a url has a rule's candidate if it holds that token
ORACLE["op2_url_rules"] = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM u),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
tok AS (SELECT h, p, verdict, unnest(list_concat(list_transform(string_split(h, '.'), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(p, '/'), lambda x: x <> ''), lambda x: 'p:' || x))) t FROM rules),
utok AS (SELECT page_id, host, path, list_distinct(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x),
  list_transform(string_split(path, '/'), lambda x: 'p:' || x))) ts FROM s),
cnt AS (SELECT w.t, count(u.t) n FROM (SELECT DISTINCT t FROM tok) w LEFT JOIN (SELECT unnest(ts) t FROM utok) u ON u.t = w.t GROUP BY w.t),
rare AS (SELECT h, p, arg_min(t, (n, -length(t), t)) t FROM tok JOIN cnt USING (t) GROUP BY h, p),
fit AS (SELECT host, path, arg_max(h || p, length(h || p)) rule, arg_max(verdict, length(h || p)) verdict
  FROM (SELECT DISTINCT host, path FROM s) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') verdict,
  CAST((SELECT count(*) FROM rare WHERE list_contains(ts, rare.t)) AS INTEGER) n_candidates
FROM utok LEFT JOIN fit USING (host, path)"""


@query
def op3_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = quality.train(docs, labels, ~quality.held_out(F.col("doc_id"), 4, 2))
    return _judged(quality.scored(docs.select("doc_id", "text"), network), 4, 2)


def _judged(scored: DataFrame, parts: int, part: int) -> DataFrame:
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query
def op5_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels, ~quality.held_out(F.col("doc_id"), 3, 1))
    return _judged(toxicity.scored(docs.select("doc_id", "text"), lexicon), 3, 1)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_fixed_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op9_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_shard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shard_words(table(spark, sf_dir, "documents"))


@query
def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


ORACLE["op11_threshold_negatives"] = """
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
  AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c AS (SELECT vec_id, label, unnest(v) x, generate_subscripts(v, 1) i FROM ok),
s AS (SELECT a.vec_id anchor_id, c.vec_id, any_value(a.label = c.label) same, CAST(sum(a.x * c.x) AS BIGINT) score FROM c a JOIN c ON a.i = c.i AND a.vec_id <> c.vec_id
  WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id negative_id, positive_score, score negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""


@query
def op12_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("row.*", "text", "n_chars")


# the tables' pages hold their text in one article element, in headings and paragraphs
ORACLE["op12_block_rules"] = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') ts FROM pages),
plain AS (SELECT page_id, url, list_transform(ts, lambda t: regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) ts FROM a),
read AS (SELECT page_id, url, list_transform(ts, lambda t: trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace(
  t, '&#x27;', ''''), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) ts FROM plain),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(ts, lambda t: t <> ''), chr(10)), '') AS text FROM read)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) n_chars FROM t"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))[1]


ORACLE["op13_prefix_trie"] = r"""
WITH r AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) i,
  {'role': coalesce(role, ''), 'text': coalesce(text, '')} t FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda s, x: list_reduce(list_concat([xor(s, x)], list_transform(range(8), lambda j: 0::BIGINT)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 4 h
  FROM r GROUP BY c),
o AS (SELECT k.c, r.i, r.t FROM k JOIN r ON r.c = k.c - k.c % 20 AND r.i <= k.h
  UNION ALL SELECT k.c, r.i + 3, r.t FROM k JOIN r ON r.c = k.c AND r.i > k.h),
s AS (SELECT k.c, coalesce(any_value(q.s), []) s FROM k LEFT JOIN (SELECT c, list(t ORDER BY i) s FROM o GROUP BY c) q USING (c) GROUP BY k.c),
p AS (SELECT c, s, unnest(range(len(s) + 1)) d FROM s),
n AS (SELECT s[:d] pre, d, min(c) conv_id, count(*) n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(s) = d) ids FROM p GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(pre[d].text, '[^\x20\x09-\x0D]+')) END v FROM n),
f AS (SELECT w.*, (SELECT count(*) FROM n b WHERE b.d = w.d + 1 AND b.pre[:w.d] = w.pre) kids FROM w),
a AS (SELECT pre[:x] pre, x d, count(*) FILTER (WHERE kids = 0) n_leaves, sum(v) saved FROM (SELECT *, unnest(range(d + 1)) x FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d depth, u.conv_id parent_conv_id, f.n_convs, f.kids n_children, CAST(a.n_leaves AS BIGINT) n_leaves, CAST(a.saved AS BIGINT) saved_tokens,
  sha256(coalesce(f.ids, '')) ends_sha256
FROM f JOIN a ON a.d = f.d AND a.pre = f.pre LEFT JOIN n u ON u.d = f.d - 1 AND u.pre = f.pre[:f.d - 1]"""
