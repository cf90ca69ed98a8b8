import bz2
import gzip
import json
import lzma
import random
import struct

import pytest

from helixgrid import cli
from helixgrid.operators.table import KmerTable, TableError
from helixgrid.sources import binary_table, exports, sequences
from helixgrid.streaming.counter import run_to_path, windowed_stream

FASTA = ">one first record\nACGT\nACGT\n\n>two\nNNACGTT\n>three x\nacgt"
FASTQ = "@r1 a\nACGT\n+\nIIII\n@r2\nACNT\n+r2\nI#II\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "deep").mkdir()
    with gzip.open(tmp_path / "deep" / "b.fastq.gz", "wt") as f:
        f.write(FASTQ)
    with gzip.open(tmp_path / "deep" / "b.fastq.gz", "at") as f:
        f.write("@r3\nGGGG\n+\nIIII\n")
    (tmp_path / "c.fq.bz2").write_bytes(bz2.compress(FASTQ.encode()))
    (tmp_path / "d.fasta.xz").write_bytes(lzma.compress(FASTA.encode()))
    (tmp_path / ".hidden.fa").write_text(FASTA)
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_readers(spark, files):
    sequences.register(spark)
    rows = spark.read.format("fasta").load(str(files / "a.fa")).collect()
    assert [(r["record_id"], r["description"], r["seq"]) for r in rows] == [("one", "first record", "ACGTACGT"), ("two", "", "NNACGTT"), ("three", "x", "acgt")]
    reads = spark.read.format("fastq").load(str(files))
    assert sorted(r["record_id"] for r in reads.collect()) == ["r1", "r1", "r2", "r2", "r3"]
    assert {r["record_id"] for r in sequences.filter_quality(reads, 60).collect()} == {"r1", "r3"}
    codes = [ord(c) for r in reads.collect() for c in r["qual"]]
    assert abs(reads.agg(sequences.average_quality(reads).alias("a")).first()["a"] - sum(codes) / len(codes)) < 1e-9
    assert tuple(sequences.totals(reads).first()) == (5, 20)
    assert sequences.read_sequences(spark, [str(files)]).count() == 3 + 3 + 5
    rows, seen = sequences.watched(sequences.read_fastq(spark, str(files)))
    assert len(rows.collect()) == 5 and seen.get == {"records": 5, "bases": 20}


def test_spark_readers(spark, files, tmp_path):
    """The readers on Spark's file systems against the line parsers, with files cut into many pieces."""
    assert sorted((r["record_id"], r["description"], r["seq"]) for r in sequences.read_fasta(spark, str(files), strict=True).collect()) == sorted(sequences.fasta_records(FASTA.splitlines()))
    assert sorted(r["record_id"] for r in sequences.read_fastq(spark, str(files)).collect()) == ["r1", "r1", "r2", "r2", "r3"]
    assert {r["seq"] for r in sequences.read_fasta(spark, "file://" + str(files / "a.fa")).collect()} == {"ACGTACGT", "NNACGTT", "acgt"}
    rng = random.Random(6)
    reads = []
    for i in range(300):
        n = rng.choice([0, 1, 2, 5, 40])
        qual = "".join(rng.choice("@@@+>I#") for _ in range(n))
        reads.append((f"q{i}", rng.choice(["", "about it"]), "".join(rng.choice("ACGTN") for _ in range(n)), qual))
    (tmp_path / "in").mkdir()
    for name, end in (("unix.fq", "\n"), ("dos.fastq", "\r\n"), ("bare.FQ", "\n")):
        text = "".join(f"@{a}{' ' + b if b else ''}{end}{s}{end}+{end}{q}{end}" for a, b, s, q in reads)
        (tmp_path / "in" / name).write_bytes((text.rstrip("\n") if name == "bare.FQ" and reads[-1][3] else text).encode())
    genes = [(f"g{i}", "", "".join(rng.choice("ACGTN") for _ in range(rng.randrange(300)))) for i in range(60)]
    wrapped = [f">{a}\n" + "".join(s[j : j + 60] + "\n" for j in range(0, len(s), 60)) for a, _, s in genes]
    (tmp_path / "in" / "g.fasta").write_text("\n".join(wrapped))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (held, "97", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sequences.read_fastq(spark, str(tmp_path / "in")).collect()
            assert sorted((r["record_id"], r["description"], r["seq"], r["qual"]) for r in got) == sorted(reads * 3)
            assert sorted((r["record_id"], r["description"], r["seq"]) for r in sequences.read_fasta(spark, str(tmp_path / "in")).collect()) == sorted(genes)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    for i, bad in enumerate(("@a\nAC\n+\nI\n", "@a\nAC\n", "a\nAC\n+\n@I\nAC\n", "@a\nAC\nxx\nII\n", "@a\nAC\n+\n@r\nAC\n+\nII\n")):
        (tmp_path / f"bad{i}.fq").write_text(bad)
        with pytest.raises(Exception, match="no record of four lines"):
            sequences.read_fastq(spark, str(tmp_path / f"bad{i}.fq")).collect()
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(sequences.SequenceError):
        sequences.read_fasta(spark, str(tmp_path / "bad.fa"), strict=True)
    with pytest.raises(FileNotFoundError):
        sequences.read_fasta(spark, str(tmp_path / "nowhere"))


def test_discovery_through_spark(spark, files):
    found = sequences.discovered(spark, str(files))
    want = {(f.path.rsplit("/", 1)[1], f.kind, f.bytes, f.compressed) for f in sequences.discover(str(files))}
    assert {(r["path"].rsplit("/", 1)[1], r["kind"], r["bytes"], r["compressed"]) for r in found.collect()} == want
    assert sequences.discovered(spark, str(files), depth=0).count() == 3 and sequences.discovered(spark, str(files), "fastq").count() == 2
    assert sequences.discovered(spark, str(files), least=10**6).count() == 0 == sequences.discovered(spark, str(files), most=1).count()
    assert {r["kind"]: (r["files"], r["compressed"]) for r in sequences.summary_of(found).collect()} == {"fasta": (2, 1), "fastq": (2, 2)}


def test_discovery(spark, files):
    found = sequences.discover(str(files))
    assert [f.path.rsplit("/", 1)[1] for f in found] == ["a.fa", "c.fq.bz2", "d.fasta.xz", "b.fastq.gz"]
    assert len(sequences.discover(str(files), depth=0)) == 3 and len(sequences.discover(str(files), "fastq")) == 2 and not sequences.discover(str(files), least=10**6)
    rows = {r["kind"]: (r["files"], r["compressed"]) for r in sequences.discovery_summary(spark, found).collect()}
    assert rows == {"fasta": (2, 1), "fastq": (2, 2)}
    assert sequences.guessed_kind("x.fastq.old") == "fastq" and sequences.guessed_kind("x.dat") == "fasta" and sequences.kind_of("x.fna.gz") == "fasta"
    with pytest.raises(FileNotFoundError):
        sequences.discover(str(files / "none"))


def test_bad_files(spark, tmp_path):
    (tmp_path / "e.fa").write_text("")
    with pytest.raises(sequences.SequenceError):
        sequences.validate(str(tmp_path / "e.fa"))
    (tmp_path / "w.fa").write_text(">\n\n>x\nAC\n")
    assert len(sequences.validate(str(tmp_path / "w.fa"))) == 2
    for bad in ("ACGT\n>x\n", ):
        with pytest.raises(sequences.SequenceError):
            list(sequences.fasta_records(bad.splitlines()))
    for bad in ("@a\nAC\n+\nI\n", "@a\nAC\n", "a\nAC\n+\nII\n"):
        with pytest.raises(sequences.SequenceError):
            list(sequences.fastq_records(bad.splitlines()))


@pytest.mark.parametrize("k", [5, 31, 33, 64])
def test_binary_round_trip(spark, tmp_path, k, monkeypatch):
    monkeypatch.setattr(binary_table, "ROWS_PER_PARTITION", 7)
    df = spark.createDataFrame([(1, "ACGTTGCAAC" * 12 + "GATTACA" * 9)], "record_id long, seq string")
    t = KmerTable.count(df, k, True)
    path = str(tmp_path / "t.bin")
    h = binary_table.write_binary(t, path)
    assert h == binary_table.read_header(path) and h.rows == t.size and h.sorted and h.canonical
    back = binary_table.read_binary(spark, path)
    assert [tuple(r) for r in back.rows.collect()] == sorted(tuple(r) for r in t.rows.collect())
    data = open(path, "rb").read()
    assert data[:4] == b"RKDB" and len(data) == 42 + 20 * h.rows and struct.unpack_from("<H", data, 4)[0] == 2
    for cut in (data[:20], b"XXXX" + data[4:], data[:-1], data[:4] + b"\x09\x00" + data[6:]):
        (tmp_path / "bad").write_bytes(cut)
        with pytest.raises(TableError):
            binary_table.read_header(str(tmp_path / "bad"))


def test_exports(spark, tmp_path):
    t = KmerTable.from_pairs(spark, [("ACG", 2), ("AAA", 5)], 3)
    assert exports.text_lines(t)[4:] == ["AAA\t5", "ACG\t2"] and len(exports.dump_lines(t)) == 9
    j = json.loads(exports.table_json(t, 1))
    assert j["kmers"] == [{"kmer": "AAA", "count": 5}] and j["total_kmers"] == 7 and j["unique_kmers"] == 2
    assert "Average count: 3.50" in exports.summary_text(t) and "0.00" in exports.summary_text(KmerTable.empty(spark, 3))
    df = t.page()
    assert exports.formatted(df, "csv") == "kmer,count\nAAA,5\nACG,2\n" and exports.formatted(df, "tsv").startswith("kmer\tcount")
    assert json.loads(exports.formatted(df, "json"))[1] == {"kmer": "ACG", "count": 2} and exports.formatted(df).splitlines()[0] == "kmer  count"
    with pytest.raises(ValueError):
        exports.formatted(df, "xml")
    exports.write_text(df, str(tmp_path / "x"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "x")).collect()) == ["AAA\t5", "ACG\t2"]
    exports.write_csv(df, str(tmp_path / "y"))
    exports.write_json(df, str(tmp_path / "z"))
    assert spark.read.option("header", True).csv(str(tmp_path / "y")).count() == spark.read.json(str(tmp_path / "z")).count() == 2
    assert exports.checksum(df) == exports.checksum(t.rows.repartition(3)) != exports.checksum(df.limit(1))
    assert exports.format_count("ACG", 2) == "ACG\t2" and exports.format_kmer("acg", True) == "ACG"


def test_command_line(spark, files, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["count", str(files), "-k", "4", "--canonical", "-o", out]) == 0
    assert cli.main(["count", str(files / "a.fa"), "-k", "4", "--canonical", "-o", out + ".bin", "--format", "binary"]) == 0
    assert cli.main(["query", out, "ACGT", "GGGG", "TTTT", "AC"]) == 0
    assert "CCCC" not in capsys.readouterr().out
    assert cli.main(["query", out + ".bin", "ACGT", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"kmer": "ACGT", "count": 4}]
    (tmp_path / "list").write_text("# c\nACGT\n\nacgt\nTTTT\n")
    assert cli.main(["query", out, "--file", str(tmp_path / "list")]) == 0
    assert capsys.readouterr().out.splitlines()[1:] in (["ACGT\t10", "TTTT\t0"], ["TTTT\t0", "ACGT\t10"])
    assert cli.main(["query", out, "--sequences", str(files / "a.fa")]) == 0
    assert cli.main(["dump", out, "--limit", "2"]) == 0
    assert cli.main(["stats", out]) == 0 and cli.main(["stats", out, "--histogram", "--format", "csv"]) == 0
    assert cli.main(["prefix-query", out, "AC"]) == 0 and cli.main(["prefix-query", out, "A{N2}T", "--min", "2"]) == 0
    assert cli.main(["fuzzy-query", out, "ACNT", "--distance", "1"]) == 0
    (tmp_path / "patterns").write_text("ACGT|x\n# y\nANNT\n")
    capsys.readouterr()
    assert cli.main(["fuzzy-query-batch", out, str(tmp_path / "patterns"), "--format", "csv"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert cli.main(["merge", out, out + ".bin", "--check-compatibility"]) == 0
    assert cli.main(["merge", out, out + ".bin", "-o", out + "2"]) == 0
    assert KmerTable.load(spark, out + "2", check=True).get("ACGT") == 14
    assert cli.main(["count", str(files), "-k", "99", "-o", out + "3"]) == 1 and cli.main(["prefix-query", out, "XX"]) == 1


def test_windowed_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "ACGTA"), ("2024-01-01 00:05:10", "ACGTT")], "ts string, seq string").selectExpr("timestamp(ts) ts", "seq")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run_to_path(windowed_stream(stream, 4, "ts", "1 minute", "1 minute"), str(tmp_path / "win"), str(tmp_path / "cp"), "append").awaitTermination()
    got = {(str(r["start"]), r["kmer"], r["count"]) for r in spark.read.parquet(str(tmp_path / "win")).collect()}
    assert got >= {("2024-01-01 00:00:00", "ACGT", 1), ("2024-01-01 00:00:00", "CGTA", 1)}
