import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from helixgrid.operators import counting, fuzzy, patterns, recipes, stats
from helixgrid.operators.table import KmerTable, TableError, compatibility, merge, read_metadata
from helixgrid.plans import catalog

from test_sequence import naive, rc

SEQS = ["ACGTACGTTTGACCAGTNNACGATTACA", "TTTTTTTTTTTTAAAACCCCGGGG", "acgtacgtTTGACCAGT", "NNN", "", "GATTACAGATTACAGATTACA"]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(list(enumerate(SEQS)), "record_id long, seq string")


def counts(k, canonical):
    return Counter(w for s in SEQS for w in naive(s, k, canonical))


def pairs(df):
    return {r["kmer"]: r["count"] for r in df.collect()}


@pytest.mark.parametrize("k,canonical", [(3, False), (3, True), (7, True), (21, False)])
def test_count(spark, seqs, k, canonical):
    assert pairs(KmerTable.count(seqs, k, canonical).rows) == counts(k, canonical)


def test_file_report(spark, seqs):
    rows = counting.file_report(seqs.withColumn("file", F.when(F.col("record_id") < 2, "a").otherwise("b")), 5).collect()
    want = {f: (len(own), sum(len(naive(s, 5, False)) for s in own), sum(max(0, len(s) - 4) for s in own)) for f, own in (("a", SEQS[:2]), ("b", SEQS[2:]))}
    assert {r["file"]: (r["records"], r["emitted"], r["emitted"] + r["skipped"]) for r in rows} == want


def test_filters_and_reports(spark, seqs):
    t, want = KmerTable.count(seqs, 3), counts(3, False)
    kept = {w: n for w, n in want.items() if 2 <= n <= 5}
    assert pairs(t.filter(2, 5).rows) == kept
    r = t.filter_report(2, 5).first()
    assert (r["total_before"], r["unique_before"], r["kept_after"], r["filtered_out"]) == (sum(want.values()), len(want), len(kept), len(want) - len(kept))
    assert KmerTable.empty(spark, 3).filter_report(2).first()["kept_percentage"] == 100.0
    for bad in ((3, 2), (None, 0), (-1, None)):
        with pytest.raises(ValueError):
            counting.check_bounds(*bad)
    counting.check_bounds(0, 1)
    assert [(x["kmer"], x["count"]) for x in t.top(4).collect()] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert t.report().first()["memory_bytes"] == 36 * len(want)


def test_lookup(spark, seqs):
    for canonical in (False, True):
        t, want = KmerTable.count(seqs, 5, canonical), counts(5, canonical)
        key = (lambda w: min(w.upper(), rc(w.upper()))) if canonical else str.upper
        asked = ["ACGTA", "acgta", "GATTA", "TAATC", "AAAAC", "CCCCC", "ACGTA"]
        assert t.get_many(asked) == {w: want[key(w)] for w in asked}
        assert t.get("gatta") == want[key("GATTA")] and t.exists("GATTA") and not t.exists("CGCGC")
        rows = t.lookup_sequences(seqs).orderBy("record_id", "pos").collect()
        assert [(r["record_id"], r["pos"], r["kmer"], r["count"]) for r in rows] == [(i, p, s[p : p + 5], want[key(s[p : p + 5])] if set(s[p : p + 5].upper()) <= set("ACGT") else 0) for i, s in enumerate(SEQS) for p in range(len(s) - 4)]
        few = t.filter(2)
        have = {w for w, n in want.items() if n >= 2}
        zero = {r["record_id"]: r["zero_windows"] for r in few.zero_windows(seqs).collect()}
        assert zero == {i: len(set(naive(s, 5, canonical)) - have) for i, s in enumerate(SEQS)}
    with pytest.raises(TableError):
        t.get("ACG")
    with pytest.raises(patterns.PatternError):
        t.get("ACGNA")


def test_patterns(spark, seqs):
    t, want = KmerTable.count(seqs, 7), counts(7, False)
    like = lambda f: {w: n for w, n in want.items() if f(w)}
    assert pairs(t.prefix("ac")) == like(lambda w: w.startswith("AC"))
    assert pairs(t.prefix("ACGTACG", loose=True)) == like(lambda w: w == "ACGTACG") and not pairs(t.prefix("", loose=True)) and not pairs(t.prefix("ACGTACGT", loose=True))
    assert pairs(t.suffix("TT")) == like(lambda w: w.endswith("TT"))
    assert pairs(t.gapped("A{N3}ACA")) == like(lambda w: w[0] == "A" and w.endswith("ACA"))
    assert pairs(t.gapped("AC")) == pairs(t.prefix("AC"))
    assert pairs(t.gapped("ACG{N0}TACG")) == like(lambda w: w == "ACGTACG")
    assert pairs(t.wildcard("ANNTACA")) == like(lambda w: w[0] == "A" and w[3:] == "TACA")
    assert pairs(t.wildcard("NNNTNNA")) == like(lambda w: w[3] == "T" and w[6] == "A")
    assert {(r["prefix"], r["kmer"]) for r in t.prefixes(["AC", "GATT", "ACGT", "X" * 9]).collect()} == {(p, w) for p in ("AC", "GATT", "ACGT") for w in want if w.startswith(p)}
    b = t.prefix_block("AC").first()
    order = sorted(want)
    assert order[b["start"] : b["end"]] == [w for w in order if w.startswith("AC")]
    for bad in ("", "ACGTACG", "ANC"):
        with pytest.raises(patterns.PatternError):
            t.prefix(bad)
    for bad in ("A{N3}AC", "A{X}C", "A{N", "NAC", "AC{N0}GG"):
        with pytest.raises(patterns.PatternError):
            t.gapped(bad)
    assert patterns.parse_gap("AC{N}GT") == patterns.GapPattern("AC", 1, "GT")
    assert [patterns.strategy(p) for p in ("ACGT", "ACNN", "ACNNN", "NNNAC", "ANNNC", "ANCNGNT")] == ["exact", "listed", "prefix", "suffix", "gapped", "scan"]


def test_prefix_is_pushed_down(spark, seqs, tmp_path):
    t = KmerTable.count(seqs, 7, True).save(str(tmp_path / "t"))
    plan = t.wildcard("ACNNNNN")._jdf.queryExecution().toString()
    assert "StringStartsWith(kmer,AC)" in plan


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13, 15, 16, 21, 31])
def test_codes_equal_windows(spark, seqs, k, monkeypatch):
    """Counting by codes against a row for each window, also over seams of pieces and blocks."""
    from helixgrid.operators import codes

    rng = random.Random(k)
    rows = [(i, "".join(rng.choice("ACGTacgtN\n") if rng.random() < 0.2 else rng.choice("ACGT") for _ in range(rng.randrange(400)))) for i in range(60)] + [(60, None), (61, ""), (62, "ÄACGT" * 40)]
    df = spark.createDataFrame(rows, "record_id long, seq string").union(seqs.select("record_id", "seq"))
    for piece, block in ((1 << 20, 1 << 16), (50, 37)):
        monkeypatch.setattr(codes, "PIECE", piece)
        monkeypatch.setattr(codes, "BLOCK", block)
        for canonical in (False, True):
            assert pairs(counting.count_words(df, k, canonical)) == pairs(counting.exploded_counts(df, k, canonical))


def test_stats(spark, seqs):
    t, want = KmerTable.count(seqs, 3), sorted(counts(3, False).values())
    r = t.stats().first()
    n = len(want)
    assert (r["total_kmers"], r["unique_kmers"], r["min_count"], r["max_count"]) == (sum(want), n, want[0], want[-1])
    assert abs(r["mean_count"] - sum(want) / n) < 1e-12 and r["median_count"] == (want[(n - 1) // 2] + want[n // 2]) / 2
    assert want[0] <= t.stats(approximate=True).first()["median_count"] <= want[-1]
    h = {x["count"]: x["frequency"] for x in t.histogram().collect()}
    assert h == {c: want.count(c) for c in range(want[0], want[-1] + 1)}
    p = t.percentiles().first()
    assert all(p[f"p{q}"] == want[n * q // 100] for q in (25, 75, 90, 95, 99)) and p["median"] == (want[(n - 1) // 2] + want[n // 2]) // 2
    big = KmerTable.from_pairs(spark, [("AAA", 1), ("AAC", 5000)], 3)
    bins = {x["count"]: x["frequency"] for x in big.histogram().collect()}
    assert len(bins) == 5000 and sum(bins.values()) == 2
    for most in (1, 10, 1000, 5000, 9000):
        bins = {x["count"]: x["frequency"] for x in big.histogram(most_bins=most).collect()}
        assert sum(bins.values()) == 2 and len(bins) == min(most, 5000) == max(bins)
    empty = KmerTable.empty(spark, 3)
    with pytest.raises(stats.EmptyTable):
        empty.stats(strict=True)
    assert empty.stats().first()["unique_kmers"] == 0 and empty.histogram().count() == 0


def test_percentiles_of_wide_counts(spark):
    rng = random.Random(9)
    words = ["".join(w) for w in product("ACGT", repeat=5)]
    for n in (1, 2, 3, 100, 1024):
        got = [rng.randrange(1, 1 << rng.randrange(2, 60)) for _ in range(n)]
        p = KmerTable.from_pairs(spark, list(zip(words, got, strict=False)), 5).percentiles().first()
        want = sorted(got)
        assert all(p[f"p{q}"] == want[n * q // 100] for q in (25, 75, 90, 95, 99))


def test_merge_keeps_large_sums(spark):
    one = KmerTable.from_pairs(spark, [("AAA", 4_294_967_290)], 3)
    assert merge([one, KmerTable.from_pairs(spark, [("AAA", 100)], 3)]).get("AAA") == 4_294_967_390
    assert merge([one, KmerTable.from_pairs(spark, [("AAA", 100)], 3)], "saturate").get("AAA") == counting.CEILING


def test_whole_histogram(spark):
    """Counts over 1000 and over a block of bins stay, through the registered query too."""
    rare = KmerTable.from_pairs(spark, [("AAA", 1), ("AAC", 5000), ("AAG", 5000), ("AAT", stats.FILL + 7)], 3)
    bins = {x["count"]: x["frequency"] for x in rare.histogram().collect()}
    assert sorted(bins) == list(range(1, stats.FILL + 8)) and {c: n for c, n in bins.items() if n} == {1: 1, 5000: 2, stats.FILL + 7: 1}
    sf = "/root/testdata/sf0.01"
    rows, got = catalog.documents(spark, sf).rows, catalog.QUERIES["stats_histogram"](spark, sf)
    want = rows.agg(F.count("*"), F.sum("count"), F.max("count")).first()
    assert got.agg(F.sum("frequency"), F.sum(F.col("count") * F.col("frequency")), F.max("count")).first() == want and want[2] > 1000


def test_merge(spark):
    a = KmerTable.from_pairs(spark, [("AAA", 3), ("ACG", 2)], 3)
    b = KmerTable.from_pairs(spark, [("AAA", counting.CEILING), ("TTT", 1)], 3)
    assert pairs(merge([a, b], "saturate").rows) == {"AAA": counting.CEILING, "ACG": 2, "TTT": 1}
    assert pairs(merge([a, b]).rows)["AAA"] == counting.CEILING + 3
    with pytest.raises(Exception, match="passed"):
        merge([a, b], "error").rows.collect()
    c = KmerTable.from_pairs(spark, [("TTT", 4)], 3, True)
    assert pairs(c.rows) == {"AAA": 4}
    with pytest.raises(TableError):
        merge([a, c])
    assert pairs(merge([a, c], mixed=True).rows) == {"AAA": 7, "ACG": 2}
    assert compatibility([a, KmerTable.empty(spark, 4)]) and not compatibility([a, b]) and compatibility([])


def test_merge_equals_counting_together(spark, seqs):
    parts = [seqs.where(F.col("record_id") % 2 == i) for i in (0, 1)]
    for canonical in (False, True):
        t = merge([KmerTable.count(p, 5, canonical) for p in parts])
        assert pairs(t.rows) == counts(5, canonical)
    assert pairs(KmerTable.count(parts[0], 5).add_sequences(parts[1]).rows) == counts(5, False)
    assert pairs(KmerTable.empty(spark, 3).add_word("acg").rows) == {"ACG": 1}


def test_save_and_load(spark, seqs, tmp_path):
    t = KmerTable.count(seqs, 5, True)
    path = str(tmp_path / "t")
    saved = t.save(path, files=3)
    assert pairs(saved.rows) == counts(5, True) and saved.sorted and saved.is_sorted()
    back = KmerTable.load(spark, path, check=True)
    assert back.k == 5 and back.canonical and back.size == len(counts(5, True))
    spark.createDataFrame([("AAAAA", 7)], "kmer string, count long").write.mode("append").parquet(str(tmp_path / "t" / "data"))
    with pytest.raises(TableError):
        KmerTable.load(spark, path, check=True)
    back = saved = KmerTable.count(seqs, 5, True).save(str(tmp_path / "u"))
    order = sorted(counts(5, True).items())
    assert [(r["kmer"], r["count"]) for r in back.page(4, 2).collect()] == order[2:6] and back.entry(0) == order[0] and back.entry(10**6) is None
    assert int(back.page(1, as_hex=True).first()["kmer"], 16) == 0 or order[0][0] != "AAAAA"
    with pytest.raises(TableError):
        KmerTable.empty(spark, 5).save(str(tmp_path / "e"), allow_empty=False)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "metadata.json").write_text('{"format": "9"}')
    with pytest.raises(TableError):
        read_metadata(spark, str(tmp_path / "m"))


# --- fuzzy


def brute(table, pattern, k, distance=0, groups=()):
    """Words of length k near the pattern that the table holds under either orientation."""
    found = {}
    for p in fuzzy.normalise_length(pattern, k):
        for w in map("".join, product("ACGT", repeat=k)):
            diff = [i for i in range(k) if p[i] not in ("N", w[i])]
            if groups:
                wild = [i for i in range(k) if p[i] == "N"]
                spots = {q for g in groups for q in g.positions}
                ok = set(diff) <= spots and all(len(set(diff) & set(g.positions)) <= g.limit for g in groups) and (not wild or True)
            else:
                ok = len(diff) <= distance
            if ok and (n := table.get(w) or table.get(rc(w))):
                found[w] = n
    return found


def test_fuzzy(spark, seqs):
    for canonical in (False, True):
        t, want = KmerTable.count(seqs, 5, canonical), dict(counts(5, canonical))
        for pattern, distance in (("ACGTA", 0), ("ANGTN", 0), ("GATTA", 2), ("ANGTA", 1), ("ACG", 0), ("ACGTACG", 1), ("GATT", 1)):
            rows = t.fuzzy(pattern, distance).collect()
            assert {r["sequence"]: r["count"] for r in rows} == brute(want, pattern, 5, distance), (pattern, distance)
            assert all(r["distance"] <= distance for r in rows) and len(rows) == len({r["sequence"] for r in rows})
        rows = t.fuzzy("GATTA", positions="0,1:1;3-4:2").collect()
        assert {r["sequence"]: r["count"] for r in rows} == brute(want, "GATTA", 5, 0, fuzzy.parse_positions("0,1:1;3-4:2"))


def test_fuzzy_batch(spark, seqs):
    t, want = KmerTable.count(seqs, 5, True), dict(counts(5, True))
    rows = t.fuzzy_batch(["GATTA", "NNNNN", "CGCGC"], 1, limit=200).orderBy("query_id").collect()
    assert [r["status"] for r in rows] == ["ok", "too many variants", "ok"]
    assert rows[0]["variants_generated"] == 16 and rows[0]["total_matches"] == sum(brute(want, "GATTA", 5, 1).values())
    found = t.fuzzy("GATTA", 2)
    assert {r["distance"] for r in fuzzy.matches_by_distance(found, 1).collect()} <= {1}
    near = {r["kmer"]: r["distance"] for r in fuzzy.near_words(t.rows, "GATTA", 2).collect()}
    assert near == {w: sum(a != b for a, b in zip(w, "GATTA", strict=True)) for w in want if sum(a != b for a, b in zip(w, "GATTA", strict=True)) <= 2}
    top = fuzzy.top_matches(found, 2).collect()
    assert [r["count"] for r in top] == sorted((r["count"] for r in found.collect()), reverse=True)[:2]


def test_fuzzy_beyond_the_limit(spark, seqs, monkeypatch):
    """Over the limit: an error, or the same words by a scan; a batch tells each query's error."""
    t = KmerTable.count(seqs, 5)
    with pytest.raises(fuzzy.TooManyVariants):
        t.fuzzy("NNNNN", limit=100)
    order = ["sequence", "count", "match_type", "distance"]
    for pattern, distance, positions in (("NNNNN", 0, ""), ("GATTA", 2, ""), ("GANTA", 1, ""), ("GATT", 1, ""), ("GATTACA", 1, ""), ("GATTA", 0, "0,1:1;3-4:2"), ("ANNTA", 0, "0,1:1")):
        listed = sorted(tuple(r) for r in t.fuzzy(pattern, distance, positions).select(*order).collect())
        assert listed and listed == sorted(tuple(r) for r in t.fuzzy(pattern, distance, positions, limit=1, beyond="scan").select(*order).collect())
    with pytest.raises(fuzzy.FuzzyError):
        t.fuzzy_batch(["GATTA", "GAX"], 1, fail_fast=True)
    batch = [tuple(r) for r in t.fuzzy_batch(["GATTA", "GAX", "NNNNN", "CGCGC"], 1, limit=200).orderBy("query_id").collect()]
    assert [r[-1].split(":")[0] for r in batch] == ["ok", "error", "too many variants", "ok"]
    monkeypatch.setattr(fuzzy, "TOGETHER", 0)
    assert batch == [tuple(r) for r in t.fuzzy_batch(["GATTA", "GAX", "NNNNN", "CGCGC"], 1, limit=200).orderBy("query_id").collect()]
    wide = fuzzy.FuzzyQuery("NNNN" + "ACGTTGCAACGTACGTA", 21, 2, limit=10_000)
    with pytest.raises(fuzzy.TooManyVariants):
        wide.expand()


def test_fuzzy_rules():
    assert fuzzy.parse_positions("3,4,5:2;6-8:1") == (fuzzy.PositionGroup((3, 4, 5), 2), fuzzy.PositionGroup((6, 7, 8), 1))
    assert fuzzy.parse_positions(" ") == ()
    for bad in ("1,2", "1,:1", "a:1", "3-1:1", "1:x", ":1"):
        with pytest.raises(fuzzy.FuzzyError):
            fuzzy.parse_positions(bad)
    for groups in ("9:1", "1:1;1:1", "1:2"):
        with pytest.raises(fuzzy.FuzzyError):
            fuzzy.check_positions(fuzzy.parse_positions(groups), 5)
    for q in (fuzzy.FuzzyQuery("ACX", 3), fuzzy.FuzzyQuery("", 3), fuzzy.FuzzyQuery("ACGTA", 5, 3), fuzzy.FuzzyQuery("A" * 9, 5), fuzzy.FuzzyQuery("A", 5), fuzzy.FuzzyQuery("acg", 3)):
        with pytest.raises(fuzzy.FuzzyError):
            q.expand()
    with pytest.raises(fuzzy.TooManyVariants):
        fuzzy.expand_wildcards("N" * 7)
    with pytest.raises(fuzzy.TooManyVariants):
        fuzzy.grouped_mutations("A" * 20, fuzzy.parse_positions("0-19:8"))
    assert len(fuzzy.mutations("ACGTAC", 2)) == fuzzy.exact_mutations(6, 2) == fuzzy.estimate_mutations(6, 2) == 1 + 18 + 135
    assert fuzzy.estimate_mutations(10, 3) == 1 + 30 + 45 * 9 + 1000 // 27 * 27
    assert fuzzy.normalise_length("ACG", 5) == ["ACGNN", "NACGN", "NNACG"] and fuzzy.normalise_length("ACGTA", 4) == ["ACGT", "CGTA"]
    assert fuzzy.normalise_likely("ACG", 5) == ["NACGN", "ACGNN", "NNACG"] and fuzzy.normalisation_report("ACG", 5)["type"] == "padded"
    assert fuzzy.FuzzyQuery("ACGTN", 5).estimate() == 4


# --- recipes


def test_mark_unsupported(spark, seqs):
    t = KmerTable.count(seqs, 5, True).filter(2)
    have = pairs(t.rows)
    for r in t.mark_unsupported(seqs).collect():
        s = SEQS[r["record_id"]]
        good = set()
        for p in range(len(s) - 4):
            w = s[p : p + 5].upper()
            if set(w) <= set("ACGT") and min(w, rc(w)) in have:
                good |= set(range(p, p + 5))
        assert r["marked"] == "".join(c if i in good else "N" for i, c in enumerate(s))
        assert r["supported"] == len(good) and r["length"] == len(s) and r["trimmed"] == r["marked"].strip("N")


def test_gap_filling(spark):
    t = KmerTable.from_pairs(spark, [("ACGTACG", 5), ("ACAAACG", 9), ("ACTTTCG", 9), ("GGGGGGG", 1)], 7)
    regions = spark.createDataFrame([("r", "AC", "CG"), ("none", "TT", "CG")], "region string, prefix string, suffix string")
    found = recipes.gap_candidates(t.rows, regions)
    assert {(r["kmer"], r["polymers"]) for r in found.collect()} == {("ACGTACG", 0), ("ACAAACG", 1), ("ACTTTCG", 1)}
    assert recipes.choose_fill(found).first()["kmer"] == "ACAAACG" and recipes.choose_fill(found, True).first()["kmer"] == "ACGTACG"
    context = spark.createDataFrame([("r", "", "T")], "region string, left string, right string")
    best = recipes.polish(t.rows.union(spark.createDataFrame([("CTTTCGT", 1)], "kmer string, count long")), found, context, 7, False).first()
    assert (best["kmer"], best["zero_windows"]) == ("ACTTTCG", 0)
    assert recipes.flank_pattern("ACGTNNACGT", 4, 5, 8) == ("CGT", 2, "ACG") and recipes.flank_pattern("NNACGT", 0, 1, 6) is None
    assert recipes.gap_candidates(t.rows, regions.limit(0)).count() == 0


def test_random_tables(spark):
    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(seqs)), "record_id long, seq string")
    want = Counter(w for s in seqs for w in naive(s, 4, True))
    t = KmerTable.count(df, 4, True)
    assert pairs(t.rows) == want
    assert t.stats().first()["total_kmers"] == sum(len(naive(s, 4, True)) for s in seqs)
