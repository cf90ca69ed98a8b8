"""Long words: packed counts and sums against plain ones, and how much they shuffle."""

import random
from collections import Counter

import numpy as np
import pytest

from helixgrid.operators import codes, counting, packed
from helixgrid.operators.table import KmerTable, merge
from helixgrid.plans import catalog, files  # noqa: F401

from test_sequence import naive

RNG = random.Random(7)
#: Runs of one base, copies, breaks, and sequences shorter than a word.
SEQS = ["".join(RNG.choice("ACGTacgtN") if RNG.random() < 0.1 else RNG.choice("ACGT") for _ in range(RNG.randrange(900))) for _ in range(40)]
SEQS += [SEQS[3], "A" * 2000, "", "ACGT" * 5, "N" * 80]


def moved(spark, query) -> int:
    """Bytes that a query shuffles, spills and writes."""

    def now():
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in map(stages.apply, range(stages.size())))

    before = now()
    query().write.format("noop").mode("overwrite").save()
    return now() - before


@pytest.fixture(scope="module")
def windows(spark):
    return catalog.sequences(spark, "/root/testdata/sf0.01").selectExpr("sum(length(seq))").first()[0]


@pytest.mark.parametrize("k", [13, 16, 21, 31, 33, 64])
def test_counts_equal_windows(spark, k):
    df = spark.createDataFrame([(s,) for s in SEQS], "seq string")
    for canonical in (False, True):
        want = {r["kmer"]: r["count"] for r in counting.exploded_counts(df, k, canonical).collect()}
        rows = counting.count_words(df, k, canonical).collect()
        assert {r["kmer"]: r["count"] for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("name", ["count_k21", "count_k31_canonical", "count_k33_canonical", "count_k64"])
def test_counts_shuffle_little(spark, windows, name):
    """Two bytes a base, with the texts that are dealt from their one file; a row for each word took more."""
    assert moved(spark, lambda: catalog.QUERIES[name](spark, "/root/testdata/sf0.01")) < 2 * windows


@pytest.mark.parametrize("name,most", [("stored_merge", 11), ("stored_count", 5), ("stored_metadata", 5), ("merge_report", 5)])
def test_tables_shuffle_little(spark, windows, name, most):
    """Bytes a base, with the texts that are dealt; words as rows took 8 to 11 for one table."""
    assert moved(spark, lambda: catalog.QUERIES[name](spark, "/root/testdata/sf0.01")) < most * windows


@pytest.mark.parametrize("k", [13, 32, 33, 64])
def test_saved_merge(spark, k, tmp_path):
    """Sums of tables of both kinds, saved in order, in as many files as asked for; words that are none are an error."""
    rows = spark.createDataFrame([(s,) for s in SEQS], "seq string")
    one, plain = KmerTable.count(rows, k, True), KmerTable.count(rows, k)
    loaded = one.save(str(tmp_path / "one"), files=3)
    assert loaded.is_sorted() and len(loaded.rows.inputFiles()) == 3
    want = {w: 2 * n for w, n in Counter(w for s in SEQS for w in naive(s, k, True)).items()}
    for i, tables in enumerate(([one, loaded], [loaded, plain])):
        both = merge(tables, mixed=True)
        saved = both.save(str(tmp_path / f"both{i}"))
        for t in (both, KmerTable.load(spark, str(tmp_path / f"both{i}"), check=True)):
            found = t.rows.collect()
            assert {r["kmer"]: r["count"] for r in found} == want and len(found) == len(want)
        assert saved.is_sorted()
    few = one.filter(2)
    assert few.save(str(tmp_path / "few")).size == few.size < len(want)
    assert KmerTable.empty(spark, k).save(str(tmp_path / "none")).size == 0
    with pytest.raises(Exception, match="words"):
        KmerTable(spark.createDataFrame([("ACGN" * 20, 1)], "kmer string, count long"), k).save(str(tmp_path / "bad"))


@pytest.mark.parametrize("held", [1 << 22, 500])
def test_sums_in_passes(held, monkeypatch):
    monkeypatch.setattr(packed, "HELD", held)
    rng = np.random.default_rng(3)
    parts = [packed._in_order((rng.integers(0, 9000, 5000).astype(np.uint64), None), rng.integers(1, 5, 5000)) for _ in range(3)]
    got = Counter()
    for (hi, _), n in packed._passes([packed._row(*p) for p in parts]):
        assert not got or hi[0] > max(got)
        got.update(dict(zip(hi.tolist(), n.tolist(), strict=True)))
    want = Counter()
    for (hi, _), n in parts:
        want.update(dict(zip(hi.tolist(), n.tolist(), strict=True)))
    assert got == want
    with pytest.raises(OverflowError):
        packed._in_order((np.zeros(4, np.uint64), None), np.full(4, 1 << 62))


@pytest.mark.parametrize("k,canonical", [(13, True), (21, False), (32, True), (33, True), (64, False), (64, True)])
@pytest.mark.parametrize("held", [1 << 22, 500])
def test_passes(k, canonical, held, monkeypatch):
    """The same words in one pass as in many, each once, whatever repeats."""
    monkeypatch.setattr(packed, "HELD", held)
    data = np.frombuffer("\n".join(SEQS).encode(), np.uint8)
    dealt = packed._dealt([packed._stretches(data, k, 10, canonical, 5)] * 3, k)
    got = Counter()
    for words, counts in packed._counted(list(zip(dealt.column(1).to_pylist(), dealt.column(2).to_pylist(), strict=True)), k, canonical):
        for batch in packed._batches(words, counts, k):
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                assert w not in got
                got[w] = n
    assert got == {w: 3 * n for w, n in Counter(w for s in SEQS for w in naive(s, k, canonical)).items()}


def test_batches_are_small(spark):
    """What Python gets at once does not grow with the length of the sequences."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('ACGTTGCATT', 3000) AS seq")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    n = [r["n"] for r in codes.pieces_of(rows, 11).mapInArrow(sizes, "n long").collect()]
    assert sum(n) > 90_000_000 and max(n) < 32_000_000
