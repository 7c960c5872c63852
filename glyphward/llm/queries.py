"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward.llm.ann_mih import nearest_neighbours
from glyphward.llm.chat_collapse import collapse_and_render
from glyphward.llm.conversation_trie import conversation_trie
from glyphward.llm.html_paths import extract_main_text
from glyphward.llm.importance_resampling import importance_ranks
from glyphward.llm.mixing_ipf import DIMENSIONS, FLATTEN, ROUNDS, calibrated
from glyphward.llm.packing import pack_digests
from glyphward.llm.prefix_tree_join import jaccard_groups
from glyphward.llm.quality_cnn import fit_quality, score_quality
from glyphward.llm.sharding import shard_by_bytes
from glyphward.llm.simhash_ball import near_duplicates
from glyphward.llm.tables import fold_of, table
from glyphward.llm.toxicity_crf import fit_toxicity, score_toxicity
from glyphward.llm.topk_bitslice import exact_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizers keep a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of at most 4096 tokens."""
    return pack_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def _held_out(folds: int, fold: int):
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(False)).alias("held_out")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the number of offending spans."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity.score")
    return scored.select("doc_id", _held_out(4, 2), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.size("toxicity.spans").alias("n_spans"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(3, 1), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest integer inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


ORACLES["op6_exact_top_k"] = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by cosine of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return collapse_and_render(table(spark, sf_dir, "conversations"))


ORACLES["op2_chat_formatting"] = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns, list(role ORDER BY place) AS roles, list(text ORDER BY place) AS texts,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS text
  FROM placed GROUP BY conv_id
), one AS (
  SELECT min(conv_id) AS conv_id, n_turns, roles, texts, count(*) AS copies FROM whole GROUP BY n_turns, roles, texts
), prefixes AS (
  SELECT DISTINCT n.n AS n_turns, roles[1:n.n] AS roles, texts[1:n.n] AS texts
  FROM whole, LATERAL (SELECT unnest(range(1, n_turns)) AS n) n
)
SELECT o.conv_id, o.n_turns, o.copies, w.text
FROM one o JOIN whole w USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.n_turns = o.n_turns AND p.roles = o.roles AND p.texts = o.texts)
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, raked weight, probability and draw of every document."""
    mixed = calibrated(table(spark, sf_dir, "documents")).select("doc_id", "mix.*")
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def _mixing_sql() -> str:
    steps = ["""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
), marked AS (
  SELECT doc_id, source, lang,
    CASE WHEN contains(text, ' | ') OR contains(text, '{') THEN 'structured' WHEN contains(text, '@') OR contains(text, '://') THEN 'contact'
      WHEN contains(text, '?') THEN 'question' WHEN length(text) < 800 THEN 'short prose' WHEN length(text) < 4000 THEN 'prose' ELSE 'long prose' END AS topic,
    CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens,
    CAST('0x' || substring(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), md5(text))), 1, 12) AS BIGINT) / 281474976710656.0 AS draw
  FROM docs
), sums AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM marked GROUP BY ALL
)"""]
    for d in DIMENSIONS:
        steps.append(f"""s_{d} AS (SELECT {d}, sum(tokens) AS held, power(sum(tokens), {FLATTEN}) AS share FROM sums GROUP BY {d}
), c_{d} AS (
  SELECT *, row_number() OVER o AS place, (0.5 * sum(held) OVER () - coalesce(sum(held) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM s_{d} WINDOW o AS (ORDER BY share / held DESC, {d})
), t_{d} AS (SELECT {d}, least(held, share * (SELECT arg_min(c, place) FROM c_{d} WHERE c * share <= held)) AS target_{d} FROM c_{d})""")
    steps.append("r0 AS MATERIALIZED (SELECT sums.*, target_source, target_lang, target_topic, CAST(0.5 AS DOUBLE) AS rate FROM sums JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT * REPLACE (rate * target_{d} / sum(tokens * least(1.0, rate)) OVER (PARTITION BY {d}) AS rate) FROM r{n})")
            n += 1
    steps.append(f"""cells AS MATERIALIZED (SELECT source, lang, topic, least(1.0, rate) AS probability, tokens * least(1.0, rate) / sum(tokens * least(1.0, rate)) OVER () AS weight FROM r{n})""")
    return ",\n".join(steps) + """
SELECT doc_id, m.source, m.lang, m.topic, m.tokens, round(c.weight, 6) AS weight, round(c.probability, 6) AS probability, m.draw < c.probability AS drawn
FROM marked m JOIN cells c USING (source, lang, topic)"""


ORACLES["op8_mixing"] = _mixing_sql()


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by bytes, over forty shards."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


ORACLES["op9_sharding"] = """
WITH table_of AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i))
), texts AS (
  SELECT digest, h, list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS b
  FROM (SELECT md5(coalesce(text, '')) AS digest, any_value(hex(encode(coalesce(text, '')))) AS h FROM documents GROUP BY 1)
), sums AS (
  SELECT digest, CAST(length(h) // 2 + 16 AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS BIGINT) AS text_crc32 FROM texts, table_of
), records AS (
  SELECT row_number() OVER (ORDER BY digest, doc_id NULLS FIRST) AS nth, CAST(doc_id AS BIGINT) AS doc_id, digest, size, text_crc32
  FROM (SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents) JOIN sums USING (digest)
), placed AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY nth) AS ends, sum(size) OVER (PARTITION BY digest) AS group_bytes FROM records
), dealt AS (
  SELECT *, CAST(least(39, floor(CASE WHEN group_bytes <= total / 64 / 40 THEN max(ends) OVER (PARTITION BY digest) - group_bytes / 2 ELSE ends - size / 2 END * 40 / total)) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
"""


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's texts."""
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op11_importance_resampling"] = rf"""
WITH table_of AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i))
), texts AS (
  SELECT 0 AS side, row_number() OVER () AS row_id, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), worded AS MATERIALIZED (
  SELECT side, row_id, doc_id, list_filter(string_split_regex({_SMALL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts
), grams AS (
  SELECT side, row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM worded
), counted AS MATERIALIZED (
  SELECT side, row_id, f, count(*) AS n FROM grams GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM hexed, table_of
), held AS MATERIALIZED (
  SELECT side, row_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM held GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM sums
), weights AS (
  SELECT row_id, sum(n) AS n_features, sum(n * g) AS weight FROM held JOIN gain USING (bucket) WHERE side = 0 GROUP BY row_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM worded LEFT JOIN weights USING (row_id) WHERE side = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


@query
def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of its shingle set and group of every document."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


ORACLES["op13_ngram_jaccard_join"] = rf"""
WITH worded AS (
  SELECT row_number() OVER () AS row_id, doc_id, list_filter(string_split_regex({_SMALL}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT row_id, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM worded
), distinct_sets AS MATERIALIZED (
  SELECT row_number() OVER () AS set_id, s, len(s) AS n FROM (SELECT DISTINCT list_sort(s) AS s FROM sets WHERE len(s) > 0)
), shingles AS MATERIALIZED (
  SELECT set_id, n, unnest(s) AS x FROM distinct_sets
), pairs AS (
  SELECT a.set_id AS a, b.set_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.set_id < b.set_id AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n
  GROUP BY a.set_id, b.set_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), links AS MATERIALIZED (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), members AS MATERIALIZED (
  SELECT row_id, doc_id, len(sets.s) AS n, set_id FROM sets LEFT JOIN distinct_sets d ON d.s = list_sort(sets.s)
), reach AS (
  WITH RECURSIVE r AS (SELECT set_id AS a, set_id AS b FROM distinct_sets UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a) SELECT * FROM r
), least AS (
  SELECT a AS set_id, min(doc_id) AS component_id FROM reach JOIN members ON set_id = b GROUP BY a
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM members LEFT JOIN least USING (set_id)
"""


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_conversation_trie"] = r"""
WITH table_of AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i))
), original AS MATERIALIZED (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, o.t AS own, CAST(xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, x: xor(c >> 8, table_of.t[(xor(c, x) & 255) + 1]))) % 6 AS BIGINT) AS h FROM original o, table_of
), rebuilt AS MATERIALIZED (
  SELECT heads.conv_id, list_concat(coalesce(f.t, [])[1:h], own[h + 1:]) AS t FROM heads LEFT JOIN original f ON f.conv_id = heads.conv_id - heads.conv_id % 100
), steps AS (
  SELECT conv_id, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth, t FROM rebuilt
), nodes AS MATERIALIZED (
  SELECT row_number() OVER () AS node, * FROM (
    SELECT depth, t[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM steps GROUP BY ALL)
), own AS MATERIALIZED (
  SELECT node, depth, prefix, conv_id, n_convs, ends_sha256, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth]['text']) END AS saved FROM nodes
), parents AS MATERIALIZED (
  SELECT c.node, p.node AS parent, p.conv_id AS parent_conv_id FROM own c JOIN own p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]
), children AS MATERIALIZED (
  SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent
), below AS (
  WITH RECURSIVE r AS (SELECT node AS top, node AS low FROM own UNION ALL SELECT parents.parent, r.low FROM r JOIN parents ON parents.node = r.top) SELECT * FROM r
), sums AS (
  SELECT top AS node, sum(o.saved) AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves FROM below JOIN own o ON o.node = low LEFT JOIN children c ON c.node = low GROUP BY top
)
SELECT o.conv_id, o.depth, p.parent_conv_id, o.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums s USING (node) LEFT JOIN parents p USING (node) LEFT JOIN children c USING (node)
"""
