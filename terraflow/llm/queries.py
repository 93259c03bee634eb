"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraflow.llm import (
    bitplane, conversations, decontaminate, jaccard, line_templates, packing, periodic, pii, quality, sharding, url_rules, weak_labels, word_lm,
)
from terraflow.llm.common import read_table

SHARDS = 24
SEQUENCE = 2048

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn

    return wrap


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_rendezvous_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"), SHARDS)


@query("op2_perplexity_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents")).drop("text_hash")


OP3 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*(.*)$', 1, 's') AS tail FROM parts
), site AS (
  SELECT r.name, r.verdict, split_part(r.name, '/', 1) AS host, substr(r.name, position('/' IN r.name)) AS path
  FROM (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')) r(name, verdict)
), fits AS (
  SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict
  FROM split s JOIN site r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY page_id
), other AS (
  SELECT page_id, list_filter(list_zip(
    ['^utm_source=', '/ads/', '||ads.', '^sessionid=', '/login^', '.exe|'],
    ['(?s)[^A-Za-z0-9_.%-]utm_source=', '/ads/', '(?s)^(?:[^/?#]*\.)?ads\.', '(?s)[^A-Za-z0-9_.%-]sessionid=', '(?s)/login(?:[^A-Za-z0-9_.%-]|$)', '(?s)\.exe$']
  ), lambda x: regexp_matches(host || tail, x[2])) AS held FROM split
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN len(o.held) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f USING (page_id) JOIN other o USING (page_id)
"""


@query("op3_rarest_token_url_rules", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages"), url_rules.RULES).drop("pattern")


OP4 = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, text, unnest(range(len(l))) AS line_no, unnest(l) AS raw FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
), masked AS (
  SELECT doc_id, line_no, list_transform(string_split(trim(translate(raw, chr(9) || chr(13), '  '), ' '), ' '),
    lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM lines
), leaved AS (
  SELECT doc_id, line_no, w, len(w) AS n, w[1:3] AS lead FROM masked WHERE len(w) >= 5 AND array_to_string(w, '') <> ''
), leaves AS (
  SELECT n, lead, count(DISTINCT w) > 1 AS mixed FROM leaved GROUP BY ALL HAVING count(DISTINCT doc_id) > 1
), different AS (
  SELECT *, row_number() OVER (ORDER BY n, lead, w) AS id, least(n - CAST(ceil(0.8::DOUBLE * n) AS BIGINT) + 1, n - 3) AS parts
  FROM (SELECT n, lead, w, min(doc_id) AS low, max(doc_id) AS high FROM leaved JOIN leaves USING (n, lead) WHERE mixed GROUP BY n, lead, w)
), stretches AS (
  SELECT id, n, lead, w, low, high, s, w[3 + (s * (n - 3) + parts - 1) // parts + 1 : 3 + ((s + 1) * (n - 3) + parts - 1) // parts] AS stretch
  FROM (SELECT *, unnest(range(parts)) AS s FROM different)
), branches AS (
  SELECT row_number() OVER (ORDER BY n, lead, s, stretch) AS branch, n, lead, s, stretch, c
  FROM (SELECT n, lead, s, stretch, count(*) AS c FROM stretches GROUP BY n, lead, s, stretch HAVING count(*) > 1 AND min(low) < max(high))
), fullest AS (
  SELECT x.*, branch, row_number() OVER (PARTITION BY id ORDER BY c DESC, s) AS r FROM stretches x JOIN branches USING (n, lead, s, stretch)
), tokens AS MATERIALIZED (
  SELECT branch, id, n, unnest(range(n)) AS i, unnest(w) AS token FROM fullest WHERE r <= 2
), held AS (
  SELECT branch, i, token, count(*) AS c FROM tokens GROUP BY branch, i, token
), template AS (
  SELECT branch, i, token FROM (SELECT *, row_number() OVER (PARTITION BY branch, i ORDER BY c DESC, token DESC) AS r FROM held) WHERE r = 1
), members AS MATERIALIZED (
  SELECT branch, id FROM tokens JOIN template USING (branch, i, token) GROUP BY branch, id, n HAVING count(*) >= ceil(0.8::DOUBLE * n)
), edges AS MATERIALIZED (
  SELECT DISTINCT id AS a, min(id) OVER (PARTITION BY branch) AS b FROM members
), reach AS (
  SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON e.a = r.b
), label AS (
  SELECT a AS id, min(b) AS label FROM reach GROUP BY a
), named AS (
  SELECT l.doc_id, l.line_no, l.n, l.lead, CASE WHEN g.label IS NOT NULL THEN ['general', CAST(g.label AS VARCHAR)] ELSE ['exact'] || l.w END AS template
  FROM leaved l JOIN leaves USING (n, lead) LEFT JOIN different d ON d.n = l.n AND d.lead = l.lead AND d.w = l.w LEFT JOIN label g ON g.id = d.id
), stats AS (
  SELECT n, lead, template, min((doc_id, line_no)) AS first FROM named GROUP BY ALL HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT doc_id, line_no FROM named JOIN stats USING (n, lead, template) WHERE (doc_id, line_no) <> first
), kept AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM lines ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, CAST(coalesce(g.n, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""


@query("op4_template_line_dedup", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("__dropped").alias("n_dropped"))


OP5 = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows))
), held AS (
  SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, t)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM held) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM held) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op5_prefix_filter_decontamination", OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.drop("__k1", "__k2")


OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


@query("op6_weak_label_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), insults=())


@query("op7_kneser_ney_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lm.score_documents(read_table(spark, sf_dir, "documents"))


@query("op8_count_vector_jaccard", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op9_exact_complement_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary(), SEQUENCE)


@query("op10_bitplane_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.corpus_digest(read_table(spark, sf_dir, "documents"), vocabulary())


@query("op11_anchored_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


@query("op12_conversation_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(read_table(spark, sf_dir, "conversations"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(read_table(spark, sf_dir, "documents"))
