import random

import pytest
from pyspark.sql import functions as F

from helixgrid.functions import sequence as seqf
from helixgrid.functions.sizes import format_bytes, parse_bytes
from helixgrid.operators import windows


def rc(w):
    return w[::-1].translate(str.maketrans("ACGT", "TGCA"))


def code(w):
    n = 0
    for c in w:
        n = n * 4 + "ACGT".index(c)
    return n


def words(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "w string")


def test_codes_and_orientation(spark):
    rng = random.Random(1)
    rows = ["ATGC", "ATAT", "A"] + ["".join(rng.choice("ACGT") for _ in range(k)) for k in range(1, 65)]
    w = F.col("w")
    for r in words(spark, rows).select(w, seqf.packed(w).alias("p"), seqf.packed_wide(w).alias("x"), seqf.hexadecimal(w).alias("h"), seqf.reverse_complement(w).alias("r"), seqf.canonical(w).alias("c"), seqf.is_canonical(w).alias("i"), seqf.orientations(w).alias("o")).collect():
        assert r["p"] == (code(r["w"]) if len(r["w"]) <= 31 else None)
        assert int(r["x"]["hi"]) << 64 | int(r["x"]["lo"]) == code(r["w"])
        assert int(r["h"], 16) == code(r["w"])
        assert r["r"] == rc(r["w"]) and r["c"] == min(r["w"], rc(r["w"])) and r["i"] == (r["w"] <= rc(r["w"]))
        assert (r["o"]["forward"], r["o"]["reverse"]) == (r["w"], rc(r["w"]))
    assert code("ATGC") == 57
    for k in (5, 31):
        own = [x for x in rows if len(x) == k]
        assert [r[0] for r in words(spark, own).select(seqf.unpacked(seqf.packed(w), k)).collect()] == own
    for k in (32, 33, 64):
        own = [x for x in rows if len(x) == k]
        assert [r[0] for r in words(spark, own).select(seqf.unpacked_wide(seqf.packed_wide(w), k)).collect()] == own
    assert words(spark, ["ACN", ""]).select(seqf.packed(w)).collect() == [(None,), (None,)]


def test_any_text(spark):
    w = F.col("w")
    rows = words(spark, ["acgtNx", "", "ACGT", "NNANN", "AAACCG"])
    got = [tuple(r) for r in rows.select(seqf.reverse_complement_any(w), seqf.is_valid(w), seqf.usable(w, 4), seqf.polymers(w), seqf.extractable(w, 2)).collect()]
    assert got == [("NNACGT", False, False, 0, 3), ("", True, False, 0, 0), ("ACGT", True, True, 0, 3), ("NNTNN", False, False, 0, 0), ("CGGTTT", True, True, 2, 5)]
    q = rows.select(seqf.sequence_quality(w).alias("q")).select("q.*").collect()
    assert tuple(q[0])[:4] == (6, 4, 2, 1) and q[1]["percent_valid"] == 0.0 and q[2]["percent_valid"] == 100.0
    g = [[tuple(x) for x in r[0]] for r in rows.select(seqf.gaps(w)).collect()]
    assert g[3] == [(0, 1), (3, 4)] and g[1] == [] and g[0] == [(4, 4)]
    assert words(spark, ["A" + "N" * 20 + "C"]).select(seqf.shorten_gaps(w)).first()[0] == "A" + "N" * 11 + "C"


def test_hamming(spark):
    rows = spark.createDataFrame([("ACGT", "ACCA"), ("A", "AC"), ("", ""), ("AAAA", "AAAA")], "a string, b string")
    got = rows.select(seqf.hamming(F.col("a"), F.col("b")).alias("d"), seqf.within(F.col("a"), F.col("b"), 1).alias("n")).collect()
    assert [tuple(r) for r in got] == [(2, False), (None, False), (0, True), (0, True)]


def naive(seq, k, canonical):
    out = []
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k].upper()
        if set(w) <= set("ACGT"):
            out.append(min(w, rc(w)) if canonical else w)
    return out


@pytest.mark.parametrize("k", [1, 3, 21, 33, 64])
def test_windows_match_naive(spark, k, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 7)
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTacgtN") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 5, 64, 65, 200, 500)] + ["A" * 40 + "N" + "A" * 39, "ACGTNACG"]
    df = spark.createDataFrame(list(enumerate(seqs)), "record_id long, seq string")
    for canonical in (False, True):
        got = {}
        for r in windows.explode_windows(df, k, canonical, keep=("record_id",)).collect():
            got.setdefault(r["record_id"], []).append(r["kmer"])
        for i, s in enumerate(seqs):
            assert sorted(got.get(i, [])) == sorted(naive(s, k, canonical))
    for r in windows.window_summary(df, k).collect():
        s = seqs[r["record_id"]]
        assert r["emitted"] == len(naive(s, k, False)) and r["emitted"] + r["skipped"] == max(len(s) - k + 1, 0)
    placed = {(r["record_id"], r["pos"]): r["kmer"] for r in windows.placed_windows(df, k).collect()}
    assert placed == {(i, p): s[p : p + k] for i, s in enumerate(seqs) for p in range(len(s) - k + 1)}
    strict = [r["kmer"] for r in windows.strict_windows(df, k).collect()]
    assert sorted(strict) == sorted(w for s in seqs if set(s.upper()) <= set("ACGT") for w in naive(s, k, False))


def test_known_windows(spark):
    df = spark.createDataFrame([(1, "ACGTNACG"), (2, "A" * 40 + "N" + "A" * 39)], "record_id long, seq string")
    assert {tuple(r) for r in windows.window_summary(df, 3).collect()} >= {(1, 3, 3)}
    assert {tuple(r) for r in windows.window_summary(df, 33).collect()} >= {(2, 15, 33)}


@pytest.mark.parametrize("k", [0, 65, -1])
def test_bad_k(spark, k):
    with pytest.raises(ValueError):
        seqf.check_k(k)


def test_sizes():
    assert parse_bytes("2GB") == 2 << 30 and parse_bytes("512") == 512 and parse_bytes("1.5 kb") == 1536 and parse_bytes("3M") == 3 << 20
    for bad in ("", "0", "5XB", "-1", "GB"):
        with pytest.raises(ValueError):
            parse_bytes(bad)
    assert format_bytes(512) == "512 B" and format_bytes(1536) == "1.50 KB" and format_bytes(3 << 30) == "3.00 GB" and format_bytes(5 << 40) == "5.00 TB"
