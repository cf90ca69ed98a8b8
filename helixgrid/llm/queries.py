"""The opN_ queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, fingerprints, language, licenses, mixing, near_dup, packing, quality, rules, substring_dedup
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_warc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archives.pages_to_records(table(spark, sf_dir, "pages"), version=2)
    path = new_path(spark, "warc")
    archives.write_warcs(records, path)
    return archives.read_warcs(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(table(spark, sf_dir, "documents"), licenses.ALL)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return out.select("doc_id", "n_words", names.alias("licenses"), F.size("matches").cast("long").alias("n_matches"), F.array_max(F.transform("matches", lambda m: m["containment"])).alias("best"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text is what is left, as text: a character of which only some bytes are left stands as U+FFFD there; kept_sha256 is of the bytes."""
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), width=400)
    left = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return out.select("doc_id", "n_bytes", F.col("n_removed").cast("long"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), left)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, language.fit(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def near_dup_five_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's operator as the pipeline uses it, on shingles of five words."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 takes fingerprints of."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 fits: sizes, and each source's target to three places."""
    return op5_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10's base verdict rests on."""
    return op10_quality_rules(spark, sf_dir).drop("kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_fingerprints, op3_warc_converter, op4_best_fit_packing, op5_source_mix, op6_near_dup,
        op7_license_scan, op8_suffix_dedup, op9_language_id, op10_quality_rules, near_dup_five_words, edited_texts, mix_targets, text_statistics,
    )
}

#: Words in SQL; A to Z in lower case.
_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _near_dup_sql(size: int) -> str:
    """Every pair that shares a shingle, confirmed on whole sets, and the smallest id reachable."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i : i + {size - 1}], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.doc_id = s.doc_id"""


#: Where SQL can express a query or the columns of it that no method decides. Learned verdicts, signatures, token ids
#: and matches of every 400-byte string of a corpus are held against brute force in tests/llm instead.
ORACLE_SQL: dict[str, str] = {
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS f, length(t) // 2 AS half FROM d)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - half) || substr(f, 1, half)) AS edited_sha256 FROM n""",
    "op3_warc_converter": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top, list_transform(range(0, 8), lambda i: ('0x' || substr(x, i * 5 + 1, 5))::BIGINT) AS v FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g""",
    "mix_targets": rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
o AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w, 2.0 * source_size AS most FROM s),
k AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total, coalesce(sum(most) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before, sum(w) OVER (ORDER BY most / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o WHERE source_size > 0),
f AS (SELECT min_by((total - before) / open, most / w) FILTER ((total - before) / open <= most / w) AS level FROM k)
SELECT doc_id, size, source_size, round(coalesce(CASE WHEN source_size = 0 THEN 0 WHEN most <= w * level THEN most ELSE w * level END, most)::DOUBLE, 3) AS target FROM d JOIN o ON o.source IS NOT DISTINCT FROM d.source, f""",
    "op6_near_dup": _near_dup_sql(2),
    "near_dup_five_words": _near_dup_sql(5),
    "text_statistics": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, {_WORDS}) AS ws FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE regexp_matches(line, {_WORDS}) GROUP BY 1),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
m AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM m) GROUP BY 1),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a""",
}
