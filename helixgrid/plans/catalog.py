"""Queries over the driver's tables, by name, with the SQL that checks them.

The tables hold prose; letters and the space stand for bases (see
functions.sequence.text_to_bases), everything else breaks a sequence. Every
query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as seqf
from ..operators import merging, patterns, recipes, windows
from ..operators.table import KmerTable, merge
from ..sources import sequences as sources
from ..sources.shared import new_path
from ..streaming.counter import counted_stream, run_to_path

K = 11
PLAIN_K = 9

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _tasks(rows: DataFrame) -> int:
    """How many tasks a scan has that read rows: row groups are never split, so files count, not the pieces planned of them."""
    return min(len(rows.inputFiles()), rows.rdd.getNumPartitions())


def sequences(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """record_id, seq. A table stored as one file is one task of the scan; it is dealt to all cores before words are cut."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("record_id"), F.col(text).alias("_text"))
    cores = spark.sparkContext.defaultParallelism
    dealt = rows.repartition(2 * cores) if _tasks(rows) < cores else rows
    # Letters become bases after the rows are dealt.
    return dealt.select("record_id", seqf.text_to_bases(F.col("_text")).alias("seq"))


def documents(spark: SparkSession, sf_dir: str, k: int = K, canonical: bool = True) -> KmerTable:
    return KmerTable.count(sequences(spark, sf_dir), k, canonical)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir, "benchmark", "item_id")


def _bases(text: str = "text") -> str:
    return f"translate({text}, '{seqf.TEXT_FROM}', '{seqf.TEXT_TO}')"


def _windows(name: str, table: str, key: str, k: int, text: str = "text") -> str:
    """A CTE (record_id, w) of the windows of a table."""
    return f"""{name}_r AS (SELECT {key} AS record_id, unnest(regexp_split_to_array({_bases(text)}, '[^ACGT]+')) AS run FROM {table}),
{name} AS (SELECT record_id, substr(run, i, {k}) AS w FROM (SELECT record_id, run, unnest(range(1, length(run) - {k} + 2)) AS i FROM {name}_r WHERE length(run) >= {k}))"""


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _rc(x: str) -> str:
    return _RC.format(x)


def _counted(name: str, source: str, canonical: bool) -> str:
    word = f"least(w, {_rc('w')})" if canonical else "w"
    return f'{name} AS (SELECT {word} AS kmer, count(*) AS "count" FROM {source} GROUP BY 1)'


def _table(canonical: bool = True, k: int = K) -> str:
    """WITH ... t(kmer, count) of the documents."""
    return f"WITH {_windows('d', 'documents', 'doc_id', k)}, {_counted('t', 'd', canonical)}"


T = _table()
B = f"{T}, {_windows('b', 'benchmark', 'item_id', K)}"


@query(f"{_table(False, PLAIN_K)} SELECT * FROM t")
def count_kmers(spark, sf_dir):
    return documents(spark, sf_dir, PLAIN_K, False).rows


@query(f"{T} SELECT * FROM t")
def count_canonical(spark, sf_dir):
    return documents(spark, sf_dir).rows


@query(f'{T} SELECT * FROM t WHERE "count" BETWEEN 5 AND 500')
def count_filtered(spark, sf_dir):
    return documents(spark, sf_dir).filter(5, 500).rows


@query(f"""{T} SELECT sum("count")::BIGINT AS total_before, count(*) AS unique_before, count(*) FILTER ("count" >= 3) AS kept_after,
count(*) FILTER ("count" < 3) AS filtered_out, 100.0::DOUBLE * count(*) FILTER ("count" >= 3) / count(*) AS kept_percentage FROM t""")
def filter_stats(spark, sf_dir):
    return documents(spark, sf_dir).filter_report(3)


@query(f"{T} SELECT sum(\"count\")::BIGINT AS total_kmers, count(*) AS unique_kmers, count(*) * 36 AS memory_bytes, {K} AS k, true AS canonical FROM t")
def counter_stats(spark, sf_dir):
    return documents(spark, sf_dir).report()


@query(f'{T} SELECT * FROM t ORDER BY "count" DESC, kmer LIMIT 20')
def top_n(spark, sf_dir):
    return documents(spark, sf_dir).top(20)


@query(f"""WITH s AS (SELECT doc_id AS record_id, {_bases()} AS seq FROM documents),
e AS (SELECT record_id, length(seq) AS n, list_sum(list_transform(regexp_split_to_array(seq, '[^ACGT]+'), lambda r: greatest(length(r) - {K - 1}, 0)))::BIGINT AS emitted FROM s)
SELECT record_id, emitted, greatest(n - {K - 1}, 0) - emitted AS skipped FROM e""")
def window_summary(spark, sf_dir):
    return windows.window_summary(sequences(spark, sf_dir), K)


@query(f"""WITH s AS (SELECT {_bases('p_name')} AS seq FROM part),
w AS (SELECT substr(seq, i, 5) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM s WHERE length(seq) >= 5 AND regexp_full_match(seq, '[ACGT]*')))
SELECT kmer, count(*) AS "count" FROM w GROUP BY 1""")
def strict_extract(spark, sf_dir):
    rows = sequences(spark, sf_dir, "part", "p_partkey", "p_name")
    return windows.strict_windows(rows, 5).groupBy("kmer").agg(F.count("*").alias("count"))


@query(f"""WITH s AS (SELECT doc_id AS record_id, {_bases()} AS seq FROM documents),
q AS (SELECT record_id, length(seq) AS length, length(regexp_replace(seq, '[^ACGTacgt]', '', 'g')) AS valid, length(regexp_replace(seq, '[^Nn]', '', 'g')) AS n_count FROM s)
SELECT record_id, length, valid, length - valid AS invalid, n_count, CASE WHEN length > 0 THEN 100.0::DOUBLE * valid / length ELSE 0 END AS percent_valid FROM q""")
def sequence_quality(spark, sf_dir):
    rows = sequences(spark, sf_dir)
    out = rows.select("record_id", seqf.sequence_quality(F.col("seq")).alias("q"))
    return out.select("record_id", *[F.col(f"q.{c}").cast("long").alias(c) for c in ("length", "valid", "invalid", "n_count")], "q.percent_valid")


@query("SELECT count(*) AS records, sum(length(text))::BIGINT AS total_length FROM documents")
def record_totals(spark, sf_dir):
    return sources.totals(sequences(spark, sf_dir))


@query(f"""WITH {_windows('b', 'benchmark', 'item_id', K)}
SELECT DISTINCT w AS kmer, {_rc('w')} AS reverse_complement, least(w, {_rc('w')}) AS canonical, w <= {_rc('w')} AS is_canonical FROM b""")
def reverse_complement(spark, sf_dir):
    words = windows.explode_windows(benchmark(spark, sf_dir), K).distinct()
    w = F.col("kmer")
    return words.select(w, seqf.reverse_complement(w).alias("reverse_complement"), seqf.canonical(w).alias("canonical"), seqf.is_canonical(w).alias("is_canonical"))


@query(f"""WITH {_windows('b', 'benchmark', 'item_id', K)}, p AS (SELECT DISTINCT w AS kmer,
list_sum(list_transform(range(1, {K + 1}), lambda i: (strpos('ACGT', substr(w, i, 1)) - 1) * (4 ** ({K} - i))::BIGINT))::BIGINT AS code FROM b)
SELECT kmer, code, lower(to_hex(code)) AS hex, kmer AS decoded, code::VARCHAR AS lo FROM p""")
def encode_packed(spark, sf_dir):
    w = F.col("kmer")
    rows = windows.explode_windows(benchmark(spark, sf_dir), K).distinct().withColumn("code", seqf.packed(w))
    return rows.select(w, "code", seqf.hexadecimal(w).alias("hex"), seqf.unpacked(F.col("code"), K).alias("decoded"), seqf.packed_wide(w)["lo"].alias("lo"))


@query(f"""WITH {_windows('b', 'benchmark', 'item_id', K)} SELECT DISTINCT w AS kmer, hamming(w, 'ACGTACGTACG')::BIGINT AS distance, hamming(w, 'ACGTACGTACG') <= 6 AS near FROM b""")
def hamming_distance(spark, sf_dir):
    w, to = F.col("kmer"), F.lit("ACGTACGTACG")
    return windows.explode_windows(benchmark(spark, sf_dir), K).distinct().select(w, seqf.hamming(w, to).cast("long").alias("distance"), seqf.within(w, to, 6).alias("near"))


@query(f"""WITH s AS (SELECT doc_id AS record_id, regexp_replace({_bases()}, '[^ACGT]', 'N', 'g') AS seq FROM documents)
SELECT record_id, len(regexp_extract_all(seq, 'AA+|CC+|GG+|TT+')) AS polymers, len(regexp_extract_all(seq, 'N+')) AS gaps, strpos(seq, 'N') - 1 AS first_gap, length(regexp_replace(seq, 'N{{2,}}', 'NN', 'g')) AS shortened FROM s""")
def polymers_and_gaps(spark, sf_dir):
    s = F.col("seq")
    rows = sequences(spark, sf_dir).select("record_id", F.regexp_replace(s, "[^ACGT]", "N").alias("seq")).withColumn("g", seqf.gaps(s))
    return rows.select("record_id", seqf.polymers(s).cast("long").alias("polymers"), F.size("g").cast("long").alias("gaps"), F.coalesce(F.get("g", F.lit(0))["first"], F.lit(-1)).cast("long").alias("first_gap"), F.length(seqf.shorten_gaps(s, 2)).cast("long").alias("shortened"))


_WORDS = ["AAAAAAAAAAA", "ACACACACACA", "TTGCATTGCAT", "GGGGGGGGGGG"]


@query(f"""{T}, q AS (SELECT unnest({_WORDS!r}) AS kmer) SELECT q.kmer, coalesce(t."count", 0) AS "count", t."count" IS NOT NULL AS found FROM q LEFT JOIN t ON t.kmer = least(q.kmer, {_rc('q.kmer')})""")
def lookup_exact(spark, sf_dir):
    return documents(spark, sf_dir).lookup(spark.createDataFrame([(w,) for w in _WORDS], "kmer string"))


@query(f"""{B}, q AS (SELECT DISTINCT w AS kmer FROM b) SELECT q.kmer, coalesce(t."count", 0) AS "count", t."count" IS NOT NULL AS found FROM q LEFT JOIN t ON t.kmer = least(q.kmer, {_rc('q.kmer')})""")
def lookup_batch(spark, sf_dir):
    return documents(spark, sf_dir).lookup(windows.explode_windows(benchmark(spark, sf_dir), K).distinct())


@query(f"""{T}, s AS (SELECT item_id AS record_id, {_bases()} AS seq FROM benchmark),
p AS (SELECT record_id, i - 1 AS pos, substr(seq, i, {K}) AS kmer FROM (SELECT record_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM s WHERE length(seq) >= {K}))
SELECT record_id, pos, p.kmer, CASE WHEN regexp_full_match(p.kmer, '[ACGT]+') THEN coalesce(t."count", 0) ELSE 0 END AS "count"
FROM p LEFT JOIN t ON t.kmer = least(p.kmer, {_rc('p.kmer')})""")
def lookup_sequence(spark, sf_dir):
    return documents(spark, sf_dir).lookup_sequences(benchmark(spark, sf_dir))


@query(f"""{B}, f AS (SELECT kmer FROM t WHERE "count" >= 20), m AS (SELECT DISTINCT record_id, least(w, {_rc('w')}) AS kmer FROM b)
SELECT x.item_id AS record_id, count(m.kmer) AS zero_windows FROM benchmark x LEFT JOIN (SELECT * FROM m WHERE kmer NOT IN (SELECT kmer FROM f)) m ON m.record_id = x.item_id GROUP BY 1""")
def zero_windows(spark, sf_dir):
    return documents(spark, sf_dir).filter(20).zero_windows(benchmark(spark, sf_dir))


@query(f"{T} SELECT * FROM t WHERE starts_with(kmer, 'ACGC')")
def prefix(spark, sf_dir):
    return documents(spark, sf_dir).prefix("acgc")


_PREFIXES = ["AAC", "ACGT", "CCCCC", "GATTACA"]


@query(f"{T}, p AS (SELECT unnest({_PREFIXES!r}) AS prefix) SELECT prefix, kmer, \"count\" FROM t JOIN p ON starts_with(kmer, prefix)")
def multi_prefix(spark, sf_dir):
    return documents(spark, sf_dir).prefixes(_PREFIXES)


@query(f"{T} SELECT * FROM t WHERE starts_with(kmer, 'AC') AND \"count\" BETWEEN 4 AND 40")
def prefix_count_filter(spark, sf_dir):
    return documents(spark, sf_dir).prefix("AC", 4, 40)


@query(f"{T} SELECT count(*) FILTER (kmer < 'ACGAAAAAAAA') AS start, count(*) FILTER (kmer <= 'ACGTTTTTTTT') AS \"end\" FROM t")
def prefix_block(spark, sf_dir):
    return documents(spark, sf_dir).prefix_block("ACG")


@query(f"{T} SELECT * FROM t WHERE ends_with(kmer, 'GGTA')")
def suffix(spark, sf_dir):
    return documents(spark, sf_dir).suffix("GGTA")


@query(f"{T} SELECT * FROM t WHERE kmer LIKE 'AC_______TA'")
def hybrid(spark, sf_dir):
    return documents(spark, sf_dir).gapped("AC{N7}TA")


@query(f"{T} SELECT * FROM t WHERE kmer LIKE 'A_C__A_T__A'")
def wildcard_scattered(spark, sf_dir):
    return documents(spark, sf_dir).wildcard("ANCNNANTNNA")


@query("SELECT 'ACNNNNNNNNN' AS pattern, 'prefix' AS strategy, 9 AS wildcards, 262144.0::DOUBLE AS words")
def explain_pattern(spark, sf_dir):
    return patterns.explain_pattern(spark, "ACNNNNNNNNN")


@query(f"""{T} SELECT sum("count")::BIGINT AS total_kmers, count(*) AS unique_kmers, min("count") AS min_count, max("count") AS max_count,
sum("count")::DOUBLE / count(*) AS mean_count, quantile_cont("count", 0.5)::DOUBLE AS median_count FROM t""")
def stats_basic(spark, sf_dir):
    return documents(spark, sf_dir).stats()


@query(f"""{T}, h AS (SELECT "count", count(*) AS frequency FROM t GROUP BY 1), e AS (SELECT min("count") AS lo, max("count") AS hi FROM h),
bins AS (SELECT unnest(range(lo, hi + 1)) AS "count" FROM e) SELECT bins."count", coalesce(frequency, 0) AS frequency FROM bins LEFT JOIN h ON h."count" = bins."count\"""")
def stats_histogram(spark, sf_dir):
    return documents(spark, sf_dir).histogram()


@query(f"""{T}, s AS (SELECT list_sort(list("count")) AS l, count(*) AS n FROM t)
SELECT l[n * 25 // 100 + 1] AS p25, (l[(n - 1) // 2 + 1] + l[n // 2 + 1]) // 2 AS median, l[n * 75 // 100 + 1] AS p75, l[n * 90 // 100 + 1] AS p90, l[n * 95 // 100 + 1] AS p95, l[n * 99 // 100 + 1] AS p99 FROM s""")
def stats_percentiles(spark, sf_dir):
    return documents(spark, sf_dir).percentiles()


_TWO = f"WITH {_windows('d', 'documents', 'doc_id', PLAIN_K)}, {_counted('t', 'd', False)}, {_windows('b', 'benchmark', 'item_id', PLAIN_K)}, {_counted('u', 'b', False)}, {_counted('c', 'b', True)}"


def _two(spark, sf_dir, canonical: bool = False) -> tuple[KmerTable, KmerTable]:
    return documents(spark, sf_dir, PLAIN_K, False), KmerTable.count(benchmark(spark, sf_dir), PLAIN_K, canonical)


@query(f'{_TWO} SELECT kmer, sum("count")::BIGINT AS "count" FROM (SELECT * FROM t UNION ALL SELECT * FROM u) GROUP BY 1')
def merge_two(spark, sf_dir):
    return merge(list(_two(spark, sf_dir))).rows


@query(f'{_TWO} SELECT kmer, sum("count")::BIGINT AS "count" FROM (SELECT least(kmer, {_rc("kmer")}) AS kmer, "count" FROM t UNION ALL SELECT * FROM c) GROUP BY 1')
def merge_mixed_canonical(spark, sf_dir):
    return merge(list(_two(spark, sf_dir, True)), mixed=True).rows


@query(f'{_TWO} SELECT t.kmer, least(t."count", u."count") AS "count" FROM t JOIN u ON t.kmer = u.kmer')
def intersect_tables(spark, sf_dir):
    one, two = _two(spark, sf_dir)
    return merging.intersect_tables(one.rows, two.rows)


@query(f"{_TWO} SELECT * FROM t WHERE kmer NOT IN (SELECT kmer FROM u)")
def subtract_tables(spark, sf_dir):
    one, two = _two(spark, sf_dir)
    return merging.subtract_tables(one.rows, two.rows)


def _fuzzy_sql(where: str, pattern: str, kind: str, distance: str) -> str:
    """Every word of both orientations that the table holds, by a test on the word; forward hits win over reverse ones."""
    return f"""{T}, o AS (SELECT kmer AS sequence, "count" FROM t UNION SELECT {_rc('kmer')}, "count" FROM t)
SELECT 0 AS query_id, '{pattern}' AS query, sequence, "count", '{kind}' AS match_type, {distance} AS distance FROM o WHERE {where}"""


@query(_fuzzy_sql("sequence LIKE 'ACA_A_ACA_A'", "ACANANACANA", "wildcard", "0"))
def fuzzy_wildcard(spark, sf_dir):
    return documents(spark, sf_dir).fuzzy("ACANANACANA")


@query(_fuzzy_sql("hamming(sequence, 'ACACAACACAA') <= 2", "ACACAACACAA", "mutation", "hamming(sequence, 'ACACAACACAA')::INTEGER"))
def fuzzy_hamming(spark, sf_dir):
    return documents(spark, sf_dir).fuzzy("ACACAACACAA", 2)


@query(_fuzzy_sql(
    "substr(sequence, 1, 2) = 'AC' AND substr(sequence, 10, 2) = 'AA' AND hamming(substr(sequence, 3, 3), 'ACA') <= 2 AND hamming(substr(sequence, 6, 4), 'ACAC') <= 1",
    "ACACAACACAA", "positions", "hamming(sequence, 'ACACAACACAA')::INTEGER"))
def fuzzy_positions(spark, sf_dir):
    return documents(spark, sf_dir).fuzzy("ACACAACACAA", positions="2,3,4:2;5-8:1")


@query(_fuzzy_sql("sequence LIKE 'ACAACAACA__' OR sequence LIKE '_ACAACAACA_' OR sequence LIKE '__ACAACAACA'", "ACAACAACA", "normalised", "0"))
def fuzzy_normalized(spark, sf_dir):
    return documents(spark, sf_dir).fuzzy("ACAACAACA")


_BATCH = ["ACACAACACAA", "ATATATNTATA", "NNNNNNNNNNN"]


@query(f"""{T}, o AS (SELECT kmer AS sequence, "count" FROM t UNION SELECT {_rc('kmer')}, "count" FROM t),
q AS (SELECT * FROM (VALUES (0, 'ACACAACACAA', 34, 'ok'), (1, 'ATATATNTATA', 124, 'ok'), (2, 'NNNNNNNNNNN', 0, 'too many variants')) AS v(query_id, query_string, variants_generated, status)),
m AS (SELECT 0 AS query_id, "count" FROM o WHERE hamming(sequence, 'ACACAACACAA') <= 1
UNION ALL SELECT 1, "count" FROM o WHERE hamming(substr(sequence, 1, 6) || 'A' || substr(sequence, 8), 'ATATATATATA') <= 1),
s AS (SELECT query_id, sum("count")::BIGINT AS total_matches, count(*) AS matched_kmers FROM m GROUP BY 1)
SELECT q.query_id, query_string, variants_generated, 1 AS mutations, coalesce(total_matches, 0) AS total_matches, coalesce(matched_kmers, 0) AS matched_kmers, status FROM q LEFT JOIN s ON s.query_id = q.query_id""")
def fuzzy_batch(spark, sf_dir):
    return documents(spark, sf_dir).fuzzy_batch(_BATCH, 1)


@query(f"""{T}, f AS (SELECT kmer FROM t WHERE "count" >= 20), s AS (SELECT item_id AS record_id, {_bases()} AS seq FROM benchmark),
p AS (SELECT record_id, i, substr(seq, i, {K}) AS w FROM (SELECT record_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM s WHERE length(seq) >= {K})),
h AS (SELECT DISTINCT record_id, i + unnest(range(0, {K})) AS place FROM p WHERE regexp_full_match(w, '[ACGT]+') AND least(w, {_rc('w')}) IN (SELECT kmer FROM f)),
c AS (SELECT record_id, place, substr(seq, place, 1) AS base FROM (SELECT record_id, seq, unnest(range(1, length(seq) + 1)) AS place FROM s)),
m AS (SELECT c.record_id, count(*) AS length, count(h.place) AS supported, string_agg(CASE WHEN h.place IS NULL THEN 'N' ELSE base END, '' ORDER BY c.place) AS marked FROM c LEFT JOIN h ON h.record_id = c.record_id AND h.place = c.place GROUP BY 1)
SELECT record_id, length, supported, marked, regexp_replace(regexp_replace(marked, '^N+', ''), 'N+$', '') AS trimmed, 100.0::DOUBLE * supported / length AS percent FROM m""")
def mark_unsupported(spark, sf_dir):
    out = documents(spark, sf_dir).filter(20).mark_unsupported(benchmark(spark, sf_dir))
    return out.withColumn("length", F.col("length").cast("long"))


_FILL = f"{B}, g AS (SELECT DISTINCT substr(w, 1, 4) AS prefix, substr(w, 8, 4) AS suffix FROM b), k AS (SELECT prefix || '-' || suffix AS region, kmer, \"count\", len(regexp_extract_all(kmer, 'AA+|CC+|GG+|TT+'))::INTEGER AS polymers FROM t JOIN g ON substr(kmer, 1, 4) = prefix AND substr(kmer, 8, 4) = suffix)"


def _regions(spark, sf_dir) -> DataFrame:
    words = windows.explode_windows(benchmark(spark, sf_dir), K)
    own = words.select(F.substring("kmer", 1, 4).alias("prefix"), F.substring("kmer", K - 3, 4).alias("suffix")).distinct()
    return own.select(F.concat_ws("-", "prefix", "suffix").alias("region"), "prefix", "suffix")


@query(f'{_FILL} SELECT region, kmer, "count", polymers FROM k QUALIFY row_number() OVER (PARTITION BY region ORDER BY "count" DESC, polymers, kmer) = 1')
def gap_fill_by_count(spark, sf_dir):
    return recipes.choose_fill(recipes.gap_candidates(documents(spark, sf_dir).rows, _regions(spark, sf_dir)))


@query(f'{_FILL} SELECT region, kmer, "count", polymers FROM k QUALIFY row_number() OVER (PARTITION BY region ORDER BY polymers, "count" DESC, kmer) = 1')
def gap_fill_by_polymers(spark, sf_dir):
    return recipes.choose_fill(recipes.gap_candidates(documents(spark, sf_dir).rows, _regions(spark, sf_dir)), by_polymers=True)


@query(f"{T} SELECT * FROM t ORDER BY kmer LIMIT 100 OFFSET 50")
def export_page(spark, sf_dir):
    return documents(spark, sf_dir).page(100, 50)


@query(f"{T} SELECT kmer || chr(9) || \"count\"::VARCHAR AS value FROM t")
def export_text(spark, sf_dir):
    return documents(spark, sf_dir).rows.select(F.concat_ws("\t", "kmer", F.col("count").cast("string")).alias("value"))


@query(f"{_table(True, 7)} SELECT * FROM t")
def stream_count(spark, sf_dir):
    """The count as a stream over the documents' files, run until it has caught up."""
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders or patterns; this pattern stands for the one name.
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[t]").select(seqf.text_to_bases(F.col("text")).alias("seq"))
    base = new_path(spark, "stream-count")
    run_to_path(counted_stream(stream, 7, True), f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rows")
