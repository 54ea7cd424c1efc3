"""The registered queries of this package and their SQL counterparts, where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitscreen.llm import conversation_trie, decontaminate, hard_negatives, html_extract, jaccard_join, mixing, nearest, packing, quality_classifier, quality_rules, secret_scan, token_counts, toxicity
from pitscreen.llm.common import stored, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity of at least 0.9, over all documents."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, numerator=90, denominator=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(mixing.sizes(table(spark, sf_dir, "documents")))
    return plan.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][((turn - 1) % 3) + 1] AS weight, CAST([0.6, 0.0, -0.6][((turn - 1) % 3) + 1] AS DOUBLE) AS slope, 3 * source_size AS cap FROM per
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - (sum(cap) OVER need - cap) AS DOUBLE) / CAST(sum(weight) OVER () - (sum(weight) OVER need - weight) AS DOUBLE) AS level
  FROM ranked WINDOW need AS (ORDER BY CAST(cap AS DOUBLE) / weight, turn ROWS UNBOUNDED PRECEDING)
), targets AS (
  SELECT source, source_size, slope, least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * max(level) OVER ()) AS target FROM levels
), placed AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM sized
), joined AS (
  SELECT p.doc_id, p.size, p.start, t.source_size, t.target, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS most
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, (CASE WHEN start < most AND 2 * start + size <= 2 * most THEN 1 ELSE 0 END + CASE WHEN start + source_size < most AND 2 * (start + source_size) + size <= 2 * most THEN 1 ELSE 0 END
    + CASE WHEN start + 2 * source_size < most AND 2 * (start + 2 * source_size) + size <= 2 * most THEN 1 ELSE 0 END) AS copies,
    least(CAST(1.0 AS DOUBLE), (CAST(start AS DOUBLE) + CAST(size AS DOUBLE) / 2.0) / greatest(target, 1.0)) AS share
  FROM joined
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies = 0 THEN NULL WHEN slope = 0.0 THEN share
       ELSE (sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * share) - (1.0 - slope)) / (2.0 * slope) END AS position
FROM copied
"""


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH lower_of AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), sized AS (
  SELECT item_id, words, least(10, len(words)) AS size FROM lower_of WHERE len(words) > 0
), spots AS (
  SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS begin_at FROM sized
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(words, begin_at, begin_at + size - 1), ' ') AS w FROM spots
), docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), placed AS (
  SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS begin_at FROM docs, (SELECT DISTINCT size FROM windows)
), met AS (
  SELECT p.row, p.begin_at, p.size, w.item_id
  FROM (SELECT row, begin_at, size, array_to_string(list_slice(words, begin_at, begin_at + size - 1), ' ') AS w FROM placed) p JOIN windows w ON p.w = w.w AND p.size = w.size
), hit AS (
  SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(begin_at, begin_at + size)) AS spot FROM (SELECT DISTINCT row, begin_at, size FROM met)) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  coalesce(n.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON d.row = h.row LEFT JOIN named n ON d.row = n.row
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = stored(conversation_trie.turns(table(spark, sf_dir, "conversations")), "turns")
    return conversation_trie.trie(conversation_trie.rebuilt(ordered))


OP12_SQL = """
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(md5(coalesce(role, '')), 16), left(md5(coalesce(text, '')), 16)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list(struct_pack(key := md5(md5(role) || md5(text)), chars := length(text)) ORDER BY pos) AS own FROM ordered GROUP BY conv_id
), heads AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS base,
    CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) + 1000 AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: CASE WHEN x >= 1000 THEN xor(a, x - 1000) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS BIGINT) AS h
  FROM lists
), rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE b.own[1:c.h] END, c.own[c.h + 1:]) AS turns FROM heads c LEFT JOIN lists b ON c.base = b.conv_id
), paths AS (
  SELECT conv_id, len(turns) AS n, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), steps AS (
  SELECT conv_id, n, depth, md5(array_to_string(list_transform(turns[1:depth], lambda t: t.key), ',')) AS key,
    CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(turns[1:depth - 1], lambda t: t.key), ',')) END AS parent,
    CASE WHEN depth > 0 THEN turns[depth].chars ELSE 0 END AS chars
  FROM paths
), nodes AS (
  SELECT depth, key, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256
  FROM steps GROUP BY depth, key
), grown AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN (SELECT depth - 1 AS depth, parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL) c ON n.key = c.parent AND n.depth = c.depth
), below AS (
  SELECT s.depth, s.key, sum(CASE WHEN g.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((g.n_convs - 1) * g.chars) AS saved_tokens
  FROM grown g JOIN steps s ON s.conv_id = g.conv_id AND s.depth <= g.depth GROUP BY s.depth, s.key
)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(g.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM grown g JOIN below b ON g.key = b.key AND g.depth = b.depth LEFT JOIN nodes p ON g.parent = p.key AND p.depth = g.depth - 1
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.quantized(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_toxicity, op3_nearest_neighbours, op4_quality_rules, op5_quality_classifier, op6_secret_scans, op7_token_counts,
    op8_packing, op9_mixing, op10_html_extraction, op11_decontamination, op12_conversation_trie, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op9_mixing": OP9_SQL, "op11_decontamination": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
