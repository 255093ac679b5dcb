"""One query per operator over its whole table, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_cnn, decontaminate, html_text, lexical, lm_scoring, near_dups, packing, quality_rules, repeats, token_counts, toxicity, url_rules
from .common import corpus

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE, PIECE_MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")

SITES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(corpus(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = corpus(spark, sf_dir, "documents"), corpus(spark, sf_dir, "labels")
    models = lm_scoring.fit(docs, labels, BYTE_TOKENIZER, public_tokenizers.PATTERN)
    return lm_scoring.score(docs, models, BYTE_TOKENIZER, public_tokenizers.PATTERN)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(corpus(spark, sf_dir, "pages"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(corpus(spark, sf_dir, "pages"), [url_rules.site_rule(*s) for s in SITES])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(corpus(spark, sf_dir, "documents"), BYTE_TOKENIZER, public_tokenizers.PATTERN)


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(corpus(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, corpus(spark, sf_dir, "labels")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(corpus(spark, sf_dir, "documents"), percent=85)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, "documents")
    return quality_rules.judge_quality(docs, quality_rules.fit(docs, corpus(spark, sf_dir, "labels")))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(corpus(spark, sf_dir, "documents"), corpus(spark, sf_dir, "benchmark"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, "documents")
    return byte_cnn.score_quality(docs, byte_cnn.fit(docs, corpus(spark, sf_dir, "labels")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(corpus(spark, sf_dir, "documents"), BYTE_FILE, PIECE_MODEL)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(corpus(spark, sf_dir, "documents"), corpus(spark, sf_dir, "benchmark"))


_OWN = "|".join(r.pattern for r in url_rules.OWN_RULES)
_SITE_ROWS = ", ".join(f"('{s}', '{v}')" for s, v in SITES)

OP4_SQL = rf"""
WITH cut AS (
    SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS mark FROM pages
), rest AS (
    SELECT page_id, CASE WHEN mark > 0 THEN substr(u, mark + 3) ELSE '' END AS r FROM cut
), parts AS (
    SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM rest
), sites(spec, verdict) AS (VALUES {_SITE_ROWS}), rules AS (
    SELECT spec, verdict, split_part(spec, '/', 1) AS h, substr(spec, strpos(spec, '/')) AS p FROM sites
), best AS (
    SELECT page_id, arg_max(spec, length(spec)) AS rule, arg_max(verdict, length(spec)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id
)
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN regexp_matches(lower(host || path), '{_OWN}') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""

OP6_SQL = r"""
WITH raw AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), windows AS (
    SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS w FROM raw, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS t(i)
), twice AS (
    SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (
    SELECT doc_id, i FROM windows SEMI JOIN twice USING (w)
), runs AS (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits
), grouped AS (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM runs
), spans AS (
    SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM grouped GROUP BY ALL
), edges AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), kept AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
    FROM edges JOIN raw USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE front || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
    FROM words, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 WHEN len(w) < 5 THEN 2 ELSE len(w) - 3 END)) AS t(i)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
    FROM documents
), held AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
    SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
    SELECT count(*) AS texts, sum(n)::BIGINT AS total FROM lengths
), weights AS (
    SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY term, texts
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * texts) // total))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pack, op2_lm_scores, op3_main_text, op4_url_rules, op5_token_counts, op6_repeated_bytes, op7_toxicity, op8_near_duplicates,
        op9_quality_rules, op10_benchmark_leaks, op11_quality_classifier, op12_token_alignment,
        op13_lexical_search,
    )
}
SQL: dict[str, str] = {"op4_url_rules": OP4_SQL, "op6_repeated_bytes": OP6_SQL, "op8_near_duplicates": OP8_SQL, "op13_lexical_search": OP13_SQL}
