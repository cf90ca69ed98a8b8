"""Queries over stored tables, files, larger words and streams, with their SQL.

Each writes what it reads to the shared folder first, so that the round trip
through the files is part of the answer.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as seqf
from ..operators import counting, fuzzy, patterns, recipes, windows
from ..operators.merging import packed_report
from ..operators.table import KmerTable, compatibility, merge, read_metadata
from ..sources import binary_table, exports
from ..sources import sequences as sources
from ..sources.shared import new_path
from ..streaming.counter import run_to_path, windowed_stream
from .catalog import B, K, PLAIN_K, T, _bases, _counted, _rc, _table, _two, _TWO, _windows, benchmark, documents, query, sequences

# -- words of every width ------------------------------------------------------------------------------


@query(f"{_table(False, 21)} SELECT * FROM t")
def count_k21(spark, sf_dir):
    return documents(spark, sf_dir, 21, False).rows


@query(f"{_table(True, 31)} SELECT * FROM t")
def count_k31_canonical(spark, sf_dir):
    return documents(spark, sf_dir, 31, True).rows


@query(f"{_table(True, 33)} SELECT * FROM t")
def count_k33_canonical(spark, sf_dir):
    return documents(spark, sf_dir, 33, True).rows


@query(f"{_table(False, 64)} SELECT * FROM t")
def count_k64(spark, sf_dir):
    return documents(spark, sf_dir, 64, False).rows


def _code(first: int, last: int) -> str:
    digits = f"list_transform(range({first}, {last + 1}), lambda i: (strpos('ACGT', substr(w, i, 1)) - 1)::HUGEINT)"
    return f"list_reduce({digits}, lambda a, b: a * 4 + b)"


@query(f"""WITH {_windows('b', 'benchmark', 'item_id', 40)} SELECT DISTINCT w AS kmer, ({_code(1, 8)})::VARCHAR AS hi, ({_code(9, 40)})::VARCHAR AS lo, w AS decoded,
lower(to_hex({_code(1, 40)})) AS hex FROM b""")
def encode_wide(spark, sf_dir):
    rows = windows.explode_windows(benchmark(spark, sf_dir), 40).distinct().withColumn("c", seqf.packed_wide(F.col("kmer")))
    return rows.select("kmer", "c.hi", "c.lo", seqf.unpacked_wide(F.col("c"), 40).alias("decoded"), F.regexp_replace(seqf.hexadecimal(F.col("kmer")), "^0+(?=.)", "").alias("hex"))


@query(f"""WITH w AS (SELECT DISTINCT k, substr(w, 1, k) AS w FROM (SELECT w, unnest([1, 31, 32, 33, 40]) AS k FROM (WITH {_windows('b', 'benchmark', 'item_id', 40)} SELECT w FROM b)))
SELECT k, w AS kmer, CASE WHEN k <= 32 THEN 64 ELSE 128 END AS bits, (list_reduce(list_transform(range(1, k + 1), lambda i: (strpos('ACGT', substr(w, i::BIGINT, 1)) - 1)::HUGEINT), lambda a, b: a * 4 + b) // 18446744073709551616)::BIGINT AS hi FROM w""")
def encode_auto(spark, sf_dir):
    """Prefixes of words in the narrower code that holds them."""
    words = windows.explode_windows(benchmark(spark, sf_dir), 40)
    rows = words.select("kmer", F.explode(F.array(*[F.lit(k) for k in (1, 31, 32, 33, 40)])).alias("k")).select("k", F.substring(F.col("kmer"), F.lit(1), F.col("k")).alias("kmer")).distinct()
    return rows.withColumn("c", seqf.packed_auto(F.col("kmer"))).select("k", "kmer", "c.bits", F.col("c.hi").cast("decimal(20,0)").cast("long").alias("hi"))


@query(f"""WITH s AS (SELECT doc_id AS record_id, {_bases()} AS seq FROM documents)
SELECT record_id, regexp_full_match(seq, '[ACGTacgt]*') AS valid, NOT regexp_full_match(seq, '[ACGTacgt]*') AS ambiguous,
reverse(translate(regexp_replace(upper(seq), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS reverse_complement FROM s""")
def sequence_checks(spark, sf_dir):
    s = F.col("seq")
    return sequences(spark, sf_dir).select("record_id", seqf.is_valid(s).alias("valid"), seqf.has_ambiguous(s).alias("ambiguous"), seqf.reverse_complement_any(s).alias("reverse_complement"))


@query(f"""WITH s AS (SELECT source AS file, {_bases()} AS seq FROM documents),
e AS (SELECT file, length(seq) AS n, list_sum(list_transform(regexp_split_to_array(seq, '[^ACGT]+'), lambda r: greatest(length(r) - {K - 1}, 0)))::BIGINT AS emitted FROM s)
SELECT file, count(*) AS records, sum(emitted)::BIGINT AS emitted, sum(greatest(n - {K - 1}, 0) - emitted)::BIGINT AS skipped FROM e GROUP BY 1""")
def file_report(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("file"), seqf.text_to_bases(F.col("text")).alias("seq"))
    return counting.file_report(rows, K)


@query(f"""{_TWO} SELECT kmer, sum("count")::BIGINT AS "count" FROM (SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT 'ACGTACGTA', 3) GROUP BY 1""")
def count_added(spark, sf_dir):
    """A counter that grows: records of one table, then of another, then one word."""
    t = KmerTable.empty(spark, PLAIN_K).add_sequences(sequences(spark, sf_dir)).add_sequences(benchmark(spark, sf_dir))
    return t.add_word("ACGTACGTA", 3).rows


# -- stored tables -------------------------------------------------------------------------------------


def stored(spark, sf_dir, k: int = K, canonical: bool = True, of=sequences) -> KmerTable:
    """A count that has been saved and loaded again, its checksum compared."""
    path = new_path(spark, "table")
    KmerTable.count(of(spark, sf_dir), k, canonical).save(path)
    return KmerTable.load(spark, path, check=True)


@query(f"{_table(True, 21)} SELECT * FROM t")
def stored_count(spark, sf_dir):
    return stored(spark, sf_dir, 21).rows


@query(f"{T} SELECT * FROM t WHERE starts_with(kmer, 'ACGC')")
def stored_prefix(spark, sf_dir):
    return stored(spark, sf_dir).prefix("ACGC")


@query(f"{T} SELECT * FROM t WHERE kmer LIKE 'AC_______TA'")
def stored_hybrid(spark, sf_dir):
    return stored(spark, sf_dir).gapped("AC{N7}TA")


@query(f"""{B}, q AS (SELECT DISTINCT w AS kmer FROM b) SELECT q.kmer, coalesce(t."count", 0) AS "count", t."count" IS NOT NULL AS found FROM q LEFT JOIN t ON t.kmer = least(q.kmer, {_rc('q.kmer')})""")
def stored_lookup(spark, sf_dir):
    return stored(spark, sf_dir).lookup(windows.explode_windows(benchmark(spark, sf_dir), K).distinct())


_TWO_21 = f"WITH {_windows('d', 'documents', 'doc_id', 21)}, {_counted('t', 'd', True)}, {_windows('b', 'benchmark', 'item_id', 21)}, {_counted('u', 'b', True)}"


@query(f'{_TWO_21} SELECT kmer, sum("count")::BIGINT AS "count" FROM (SELECT * FROM t UNION ALL SELECT * FROM u) GROUP BY 1')
def stored_merge(spark, sf_dir):
    """Two saved tables, summed, saved and loaded again."""
    path = new_path(spark, "merged")
    merge([stored(spark, sf_dir, 21), stored(spark, sf_dir, 21, of=benchmark)]).save(path)
    return KmerTable.load(spark, path, check=True).rows


@query(f"""{_TWO_21} SELECT 21 AS k, true AS canonical, true AS sorted, count(*) AS distinct_kmers, sum("count")::BIGINT AS total_kmers FROM t""")
def stored_metadata(spark, sf_dir):
    path = new_path(spark, "table")
    KmerTable.count(sequences(spark, sf_dir), 21, True).save(path)
    meta = read_metadata(spark, path)
    return spark.createDataFrame([tuple(meta[c] for c in ("k", "canonical", "sorted", "distinct_kmers", "total_kmers"))], "k int, canonical boolean, sorted boolean, distinct_kmers long, total_kmers long")


@query("SELECT true AS saved, false AS dealt")
def stored_order(spark, sf_dir):
    """Whether a saved table is in order, and the same rows dealt by hash and saved as they are."""
    t = stored(spark, sf_dir)
    path = new_path(spark, "dealt")
    t.rows.repartition(4, F.xxhash64("kmer")).write.parquet(path)
    return spark.createDataFrame([(t.is_sorted(), KmerTable(spark.read.parquet(path), K, True).is_sorted())], "saved boolean, dealt boolean")


@query("SELECT * FROM (VALUES ('table 2 has k=9, the first has k=11'), ('table 2 is plain, the first is not alike'), ('table 3 is plain, the first is not alike')) AS v(reason)")
def merge_compatibility(spark, sf_dir):
    tables = [documents(spark, sf_dir), documents(spark, sf_dir, PLAIN_K, False), documents(spark, sf_dir, K, False)]
    return spark.createDataFrame([(r,) for r in compatibility(tables)], "reason string")


@query(f"""{_TWO_21}, m AS (SELECT sum("count")::BIGINT AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM u) GROUP BY kmer)
SELECT 2 AS inputs, (SELECT count(*) FROM t) + (SELECT count(*) FROM u) AS rows_in, count(*) AS rows_out, ((SELECT count(*) FROM t) + (SELECT count(*) FROM u) - count(*)) AS shared, sum(n)::BIGINT AS total_kmers FROM m""")
def merge_report(spark, sf_dir):
    return packed_report([KmerTable.count(of(spark, sf_dir), 21, True).unsummed() for of in (sequences, benchmark)], 21)


@query(f"{_table(True, PLAIN_K)} SELECT * FROM t")
def binary_round_trip(spark, sf_dir):
    """Through the fixed-width binary format, which is for local or mounted paths."""
    path = new_path(spark, "table") + ".bin"
    binary_table.write_binary(documents(spark, sf_dir, PLAIN_K), path)
    return binary_table.read_binary(spark, path).rows


@query(f"""{_table(True, PLAIN_K)} SELECT {PLAIN_K} AS k, count(*) AS "rows", true AS sorted, true AS canonical FROM t""")
def binary_header(spark, sf_dir):
    path = new_path(spark, "table") + ".bin"
    binary_table.write_binary(documents(spark, sf_dir, PLAIN_K), path)
    h = binary_table.read_header(path)
    return spark.createDataFrame([(h.k, h.rows, h.sorted, h.canonical)], "k int, rows long, sorted boolean, canonical boolean")


# -- sequence files ------------------------------------------------------------------------------------

_CLEAN = f"regexp_replace({_bases()}, '[^ACGT]', 'N', 'g')"
#: Qualities by base; one of them is the character that also begins a record.
_QUALITY = ("ACGTN", "I@5!#")


def _records(spark, sf_dir, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = sequences(spark, sf_dir, table, key, text)
    return rows.select(F.col("record_id").cast("string").alias("record_id"), F.lit("of the corpus").alias("description"), F.regexp_replace("seq", "[^ACGT]", "N").alias("seq")).withColumn("qual", F.translate("seq", *_QUALITY))


def _fastq(spark, sf_dir, *table: str) -> DataFrame:
    path = new_path(spark, "reads")
    exports.write_fastq(_records(spark, sf_dir, *table), path)
    return sources.read_fastq(spark, path, names="part-*")


@query(f"SELECT doc_id::VARCHAR AS record_id, 'of the corpus' AS description, {_CLEAN} AS seq FROM documents")
def fasta_scan(spark, sf_dir):
    """Written with wrapped lines, read again."""
    path = new_path(spark, "genome")
    exports.write_fasta(_records(spark, sf_dir), path)
    return sources.read_fasta(spark, path, strict=True, names="part-*").select("record_id", "description", "seq")


@query(f"SELECT doc_id::VARCHAR AS record_id, 'of the corpus' AS description, {_CLEAN} AS seq, translate({_CLEAN}, '{_QUALITY[0]}', '{_QUALITY[1]}') AS qual FROM documents")
def fastq_scan(spark, sf_dir):
    return _fastq(spark, sf_dir).select("record_id", "description", "seq", "qual")


@query(f"SELECT p_partkey::VARCHAR AS record_id FROM part WHERE NOT contains(translate({_bases('p_name')}, '{_QUALITY[0]}', '{_QUALITY[1]}'), '!')")
def fastq_quality_filter(spark, sf_dir):
    return sources.filter_quality(_fastq(spark, sf_dir, "part", "p_partkey", "p_name"), 34).select("record_id")


@query(f"""WITH q AS (SELECT {_CLEAN} AS s FROM documents), n AS (SELECT sum(length(s)) AS every, {', '.join(f"sum(length(s) - length(replace(s, '{b}', ''))) AS n{b}" for b in 'ACGTN')} FROM q)
SELECT ({' + '.join(f"{ord(c)} * n{b}" for b, c in zip(*_QUALITY))})::DOUBLE / every AS average FROM n""")
def fastq_average_quality(spark, sf_dir):
    reads = _fastq(spark, sf_dir)
    return reads.agg(sources.average_quality(reads).alias("average"))


@query("SELECT * FROM (VALUES ('fasta', 3::BIGINT, 9::BIGINT, 2::BIGINT), ('fastq', 2, 6, 1)) AS v(kind, files, bytes, compressed)")
def discovery_summary(spark, sf_dir):
    """Sequence files of both kinds among others, in folders, found and summed up."""
    path = new_path(spark, "found")
    names = ("a.fa", "deep/b.fasta.gz", "deep/er/c.FNA.bz2", "d.fq", "deep/e.fastq.xz", "notes.txt", ".hidden.fa")
    fs, _ = sources.hadoop_path(spark, path)
    for name in names:
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(bytearray(b">x\n"))
        out.close()
    return sources.summary_of(sources.discovered(spark, path)).select("kind", "files", "bytes", "compressed")


# -- sinks ---------------------------------------------------------------------------------------------


@query(f"{T} SELECT * FROM t")
def export_csv(spark, sf_dir):
    path = new_path(spark, "csv")
    exports.write_csv(documents(spark, sf_dir).rows, path)
    return spark.read.option("header", True).schema("kmer string, count long").csv(path)


@query(f"{T} SELECT * FROM t")
def export_json(spark, sf_dir):
    path = new_path(spark, "json")
    exports.write_json(documents(spark, sf_dir).rows, path)
    return spark.read.schema("kmer string, count long").json(path)


@query(f"""{T} SELECT kmer || chr(9) || "count"::VARCHAR AS value FROM t UNION ALL SELECT unnest(['# kmer text format v1', '# kmer_length: {K}', '# total_kmers: ' || (SELECT count(*) FROM t)::VARCHAR, '# format: kmer_sequence<TAB>count'])""")
def export_text_v1(spark, sf_dir):
    path = new_path(spark, "text")
    exports.write_text_v1(documents(spark, sf_dir), path)
    return spark.read.text(path)


@query(f"{T}, h AS (SELECT *, list_reduce(list_transform(range(1, {K + 1}), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1)::BIGINT), lambda a, b: a * 4 + b) AS code FROM t) SELECT lower(to_hex(code)) AS kmer, \"count\" FROM h ORDER BY code LIMIT 200")
def export_hex(spark, sf_dir):
    return documents(spark, sf_dir).page(200, as_hex=True)


# -- approximate lookup and recipes --------------------------------------------------------------------

_BOTH = f"""{T}, o AS (SELECT kmer AS sequence, "count" FROM t UNION SELECT {_rc('kmer')}, "count" FROM t)"""


@query(f"{_BOTH} SELECT 0 AS query_id, 'NNNNNNNNCAN' AS query, sequence, \"count\", 'combined' AS match_type, least(1, hamming(substr(sequence, 9, 2), 'CA'))::INTEGER AS distance FROM o WHERE hamming(substr(sequence, 9, 2), 'CA') <= 1")
def fuzzy_scan(spark, sf_dir):
    """A query for more words than can be listed, answered by a pass over the table."""
    return documents(spark, sf_dir).fuzzy("NNNNNNNNCAN", 1, beyond="scan")


@query(f"{_BOTH} SELECT sequence, \"count\", 1 AS distance FROM o WHERE hamming(sequence, 'ACACAACACAA') = 1")
def fuzzy_by_distance(spark, sf_dir):
    return fuzzy.matches_by_distance(documents(spark, sf_dir).fuzzy("ACACAACACAA", 2), 1).select("sequence", "count", "distance")


@query(f"{_BOTH} SELECT sequence, \"count\" FROM o WHERE hamming(sequence, 'ACACAACACAA') <= 2 ORDER BY \"count\" DESC, sequence LIMIT 15")
def fuzzy_top(spark, sf_dir):
    return fuzzy.top_matches(documents(spark, sf_dir).fuzzy("ACACAACACAA", 2), 15).select("sequence", "count")


@query(f"""{_BOTH}, m AS (SELECT sum("count")::BIGINT AS n, count(*) AS d FROM o WHERE hamming(sequence, 'ACACAACACAA') <= 1)
SELECT 0 AS query_id, 34 AS variants_generated, n AS total_matches, d AS matched_kmers, 'ok' AS status FROM m UNION ALL SELECT 1, 0, 0, 0, 'error' UNION ALL SELECT 2, 0, 0, 0, 'too many variants'""")
def fuzzy_batch_errors(spark, sf_dir):
    """A malformed query and one over the limit have their own status; the others are answered."""
    out = documents(spark, sf_dir).fuzzy_batch(["ACACAACACAA", "ACXCAACACAA", "NNNNNNNNNNN"], 1)
    return out.select("query_id", "variants_generated", "total_matches", "matched_kmers", F.split_part("status", F.lit(":"), F.lit(1)).alias("status"))


@query(f"{T} SELECT kmer, \"count\", hamming(kmer, 'ACACAACACAA')::INTEGER AS distance FROM t WHERE hamming(kmer, 'ACACAACACAA') <= 3")
def near_words(spark, sf_dir):
    return fuzzy.near_words(documents(spark, sf_dir).rows, "ACACAACACAA", 3)


_GAPS = f"""WITH s AS (SELECT item_id AS record_id, regexp_replace({_bases()}, '[^ACGT]', 'N', 'g') AS seq FROM benchmark),
p AS (SELECT record_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s),
f AS (SELECT record_id, seq, i - 1 AS first, i + length(regexp_extract(substr(seq, i), '^N+')) - 2 AS last FROM p WHERE substr(seq, i, 1) = 'N' AND (i = 1 OR substr(seq, i - 1, 1) <> 'N')),
l AS (SELECT *, ({K} - (last - first + 1)) AS rest FROM f),
x AS (SELECT record_id, first, last, substr(seq, greatest(first - rest // 2, 0) + 1, least(rest // 2, first)) AS prefix, substr(seq, last + 2, rest - rest // 2) AS suffix, rest FROM l WHERE rest >= 2),
g AS (SELECT record_id, first, last, prefix, (last - first + 1) AS gap, suffix FROM x WHERE length(prefix) = rest // 2 AND length(suffix) = rest - rest // 2 AND NOT contains(prefix || suffix, 'N'))"""


def _gaps(spark, sf_dir) -> DataFrame:
    rows = benchmark(spark, sf_dir).select("record_id", F.regexp_replace("seq", "[^ACGT]", "N").alias("seq"))
    return recipes.flanks(rows, K).select("record_id", "first", "last", "prefix", "gap", "suffix")


@query(f"{_GAPS} SELECT record_id, first, last, prefix, gap, suffix FROM g")
def gap_flanks(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(f"""{_GAPS}, {_windows('d', 'documents', 'doc_id', K)}, {_counted('t', 'd', True)}, f2 AS (SELECT kmer FROM t WHERE "count" >= 20),
c AS (SELECT DISTINCT prefix || '-' || suffix AS region, prefix, suffix FROM g),
k AS (SELECT region, prefix, suffix, kmer, "count" FROM t JOIN c ON starts_with(kmer, prefix) AND ends_with(kmer, suffix)),
w AS (SELECT region, kmer, "count", substr(b, i, {K}) AS w FROM (SELECT region, kmer, "count", 'ACGTACGT' || kmer || 'TTGCATGC' AS b, unnest(range(1, {K + 16 - K + 2})) AS i FROM k)),
m AS (SELECT region, kmer, "count", count(DISTINCT least(w, {_rc('w')})) FILTER (least(w, {_rc('w')}) NOT IN (SELECT kmer FROM f2)) AS zero_windows FROM w GROUP BY 1, 2, 3)
SELECT region, kmer, "count", zero_windows FROM m QUALIFY row_number() OVER (PARTITION BY region ORDER BY zero_windows, "count" DESC, kmer) = 1""")
def gap_polish(spark, sf_dir):
    """Every word that fits a gap is tried in its place; the one that leaves the fewest windows unsupported wins."""
    t = documents(spark, sf_dir)
    own = _gaps(spark, sf_dir).select(F.concat_ws("-", "prefix", "suffix").alias("region"), "prefix", "suffix").distinct()
    around = own.select("region", F.lit("ACGTACGT").alias("left"), F.lit("TTGCATGC").alias("right"))
    return recipes.polish(t.filter(20).rows, recipes.gap_candidates(t.rows, own), around, K, True)


# -- streams -------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT date_trunc('hour', ts) AS start, {_bases('event_type')} AS seq FROM events),
w AS (SELECT start, substr(seq, i, 4) AS kmer FROM (SELECT start, seq, unnest(range(1, length(seq) - 2)) AS i FROM s))
SELECT start, start + INTERVAL 1 HOUR AS "end", kmer, count(*) AS "count" FROM w GROUP BY 1, 2, 3""")
def stream_windows(spark, sf_dir):
    """Words of the events' types by hour, counted as a stream under a watermark."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[t]").select(F.col("ts").cast("timestamp").alias("ts"), seqf.text_to_bases(F.col("event_type")).alias("seq"))
    base = new_path(spark, "stream-windows")
    run_to_path(windowed_stream(stream, 4, "ts", "1 hour", "1 hour"), f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rows").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"""{T}, p AS (SELECT * FROM (VALUES ('ACNNNNNNNNN'), ('NNNNNNNNNGT'), ('ACGTNNNNNGT'), ('ACGTACGTACG'), ('ACGTACGTANN')) AS v(pattern))
SELECT pattern, count(t.kmer) AS words FROM p LEFT JOIN t ON t.kmer LIKE replace(pattern, 'N', '_') GROUP BY 1""")
def wildcard_strategies(spark, sf_dir):
    """Words under a pattern of each strategy: prefix, suffix, gapped, exact and listed."""
    t = documents(spark, sf_dir)
    names = ("ACNNNNNNNNN", "NNNNNNNNNGT", "ACGTNNNNNGT", "ACGTACGTACG", "ACGTACGTANN")
    assert len({patterns.strategy(p) for p in names}) == 5
    # One pass: each word names the patterns it fits.
    fits = F.array(*[F.when(patterns.wildcard(p, K), F.lit(p)) for p in names])
    found = t.rows.select(F.explode(F.array_compact(fits)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(p,) for p in names], "pattern string")
    return every.join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("words"))


@query(f"""{T} SELECT '{K}' AS k, 'true' AS canonical, count(*)::VARCHAR AS unique_kmers, sum("count")::VARCHAR AS total_kmers FROM t""")
def table_json(spark, sf_dir):
    j = json.loads(exports.table_json(documents(spark, sf_dir), limit=1))
    return spark.createDataFrame([(str(j["kmer_length"]), str(j["canonical_mode"]).lower(), str(j["unique_kmers"]), str(j["total_kmers"]))], "k string, canonical string, unique_kmers string, total_kmers string")
