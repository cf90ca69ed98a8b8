"""Rules, near-duplicates, suffix dedup, mixing and packing against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixgrid.llm import mixing, near_dup, packing, rules, substring_dedup
from helixgrid.llm.lyndon import repeated_windows, suffix_array
from helixgrid.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


# --- rules


def brute_stats(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def check_rules(got, pairs):
    want = sorted((str(i), *brute_stats(t)) for i, t in pairs)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_query(spark, sf):
    got = QUERIES["op10_quality_rules"](spark, sf).collect()
    check_rules(got, docs_of(spark, sf))


def test_rules_verdicts_by_the_list(spark, sf):
    """kept of every document against the learned list, walked rule by rule."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = rules.text_stats(docs)
    verdict = rules.fit(stats, labels)
    shown = {r["doc_id"]: r for r in stats.select("doc_id", *[F.expr(q).cast("double").alias(n) for n, q in rules.FEATURES.items()]).collect()}
    for r in QUERIES["op10_quality_rules"](spark, sf).collect():
        x = shown[r["doc_id"]]
        hit = any(all((x[c.feature] >= c.threshold) == c.above for c in rule) for rule in verdict.rules)
        assert r["kept"] == (not r["base_failed"] and not hit)


def test_rules_are_learned():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    verdict = rules.learn(x, bad, precision=0.9)
    assert ((~verdict.keeps(x)) == bad).mean() > 0.97
    assert not rules.learn(x, np.zeros(3000, bool)).rules


def test_rules_expression_matches_list(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = rules.text_stats(docs)
    verdict = rules.fit(stats, labels)
    rows = stats.select(verdict.expression().alias("k"), *[F.expr(s).alias(n) for n, s in rules.FEATURES.items()]).toPandas()
    assert (rows["k"].to_numpy() == verdict.keeps({n: rows[n].to_numpy(float) for n in rules.FEATURES})).all()


def test_repeat_words_wide_vocabulary():
    rng = random.Random(3)
    words = [str(rng.randrange(20_000)).encode() for _ in range(30_000)]
    words[20_000:20_040] = words[100:140]
    assert rules.repeat_words(words)[0] == brute_stats(b" ".join(words).decode())[4] >= 80


def test_rules_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int")
    check_rules(rules.quality_rules(odd, labels).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert rules.quality_rules(none, labels).count() == 0


# --- near-duplicates


def brute_components(pairs, size, percent=80):
    sets = defaultdict(set)
    for i, t in pairs:
        w = [x.lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
        sets[i] |= {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dup_query(spark, sf):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op6_near_dup"](spark, sf).collect()}
    assert got == brute_components(docs_of(spark, sf), 2)
    assert any(i != c for i, (_, c) in got.items())


def test_near_dup_odd_and_empty(spark, odd, none):
    rows = near_dup.near_duplicates(odd, shingle=2).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in odd.collect()], 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert len(rows) == odd.count() and all(r["kept"] for r in rows if r["doc_id"] is None)
    assert near_dup.near_duplicates(none).count() == 0


def test_near_dup_chains(spark):
    """A chain whose ends are unlike, a bucket whose smallest member is unlike the others, and many near copies."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    rows, words = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
    other = [f"u{i}" for i in range(150)]
    for i in range(60, 200):
        copy = list(other)
        for j in rng.sample(range(150), 6):
            copy[j] = f"m{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 2)


def test_near_dup_shared_ids(spark):
    """Texts under one id, under -1 or under none are compared and judged row by row."""
    import corpus_pipeline

    rng = random.Random(3)

    def words(n):
        return [f"z{rng.randrange(10**6)}" for _ in range(n)]

    def near(text):
        return " ".join("changed" if i == 40 else w for i, w in enumerate(text.split()))

    a, b, c, d, e = (" ".join(words(n)) for n in (120, 100, 90, 110, 130))
    rows = [(1, a), (5, near(a)), (5, b), (9, near(b)), (None, c), (None, near(c)), (None, d), (-1, e), (20, near(e)), (5, near(a)), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["row_key"]): (r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, keyed=True).collect()}
    keys = {(r["doc_id"], r["text"]): (r["doc_id"], r["k"]) for r in docs.select("*", near_dup.row_key("doc_id").alias("k")).collect()}
    first = min((keys[None, c], keys[None, near(c)]), key=lambda x: x[1])
    want = {(1, a): (1, True), (5, near(a)): (1, False), (5, b): (5, True), (9, near(b)): (5, False), (None, d): (None, True), (-1, e): (-1, True), (20, near(e)): (-1, False), (7, None): (7, True), (7, ""): (7, True)}
    want |= {(None, t): (None, keys[None, t] == first) for t in (c, near(c))}
    assert got == {keys[k]: v for k, v in want.items()}
    whole = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    stay = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, whole.union(whole), "").collect()), key=str)
    assert stay == sorted((k for k, (_, kept) in want.items() if kept), key=str)


def test_texts_in_slices(spark):
    """Python objects are made of few rows at a time, not of a whole batch; nulls and every row pass."""
    from helixgrid.llm.common import mapped_slices

    def sizes(batches):
        for pdf in batches:
            yield pdf.assign(n=len(pdf))

    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "CASE WHEN id % 7 > 0 THEN repeat('ab ', 9) END AS text")
    got = mapped_slices(rows, sizes, "id long, text string, n long").collect()
    assert {(r["id"], r["text"]) for r in got} == {(r["id"], r["text"]) for r in rows.collect()} and len(got) == 5000 and max(r["n"] for r in got) <= 250
    plans = near_dup.signatures(rows, "id", "text", 2)._jdf.queryExecution().toString()
    assert "MapInArrow" in plans and "MapInPandas" not in plans


def test_near_dup_moves_only_asked_texts(spark):
    """Texts without a candidate stay out of every shuffle, also when the ids asked for are too many to broadcast."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(1500))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 300, 100)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written = lambda: sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    try:
        start = written()
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
        moved = written() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert moved < sum(len(t) for _, t in rows) / 2


def test_near_dup_sieve_keeps_what_is_asked(spark, monkeypatch):
    """Whatever the size of its table: all asked rows stay, and with few asked for nearly all others go."""
    texts = spark.range(5000).select(F.xxhash64("id").alias("id"), F.concat(F.lit("t"), "id").alias("text"))
    asked = spark.range(0, 5000, 50).select(F.xxhash64("id").alias("id"))
    ids = {r["id"] for r in asked.collect()}
    for bits, most in ((6, 5000), (12, 400), (26, 110)):
        monkeypatch.setattr(near_dup, "SIEVE", bits)
        rows = near_dup._sieved(texts, asked).collect()
        left = {r["id"] for r in rows}
        assert ids <= left and len(left) == len(rows) <= most
    assert near_dup._sieved(texts, asked.limit(0)).count() == 0


def test_keys_meet_within_the_bound():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 256, near_dup.SLOTS, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(near_dup.SLOTS, near_dup.BOUND, replace=False)
        b[at] += 1
        assert (near_dup._keys(a[None]) == near_dup._keys(b[None])).any()


# --- suffix dedup


def brute_cut(pairs, width):
    data = [(t or "").encode() for _, t in pairs]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for (i, _), d in zip(pairs, data, strict=True):
        gone = bytearray(len(d))
        for j in range(len(d) - width + 1):
            if seen[d[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        runs = sum(1 for j in range(len(d)) if gone[j] and (not j or not gone[j - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((str(i), len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digests(rows):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)


def test_suffix_query(spark, sf):
    got = QUERIES["op8_suffix_dedup"](spark, sf).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_cut(docs_of(spark, sf), 400)
    for r in got:
        if "\ufffd" not in r["text"]:
            assert len(r["text"].encode()) == r["n_bytes"] - r["n_removed"] and hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("broadcast,hot", [(0, 10**6), (10**6, 10**6), (10**6, 0), (0, 0)])
def test_suffix_odd(spark, odd, none, broadcast, hot):
    rows = substring_dedup.substring_dedup(odd, 100, broadcast=broadcast, hot=hot).collect()
    assert digests(rows) == brute_cut([(r["doc_id"], r["text"]) for r in odd.collect()], 100)
    assert substring_dedup.substring_dedup(none, 100, broadcast=broadcast).count() == 0


def test_suffix_overlaps(spark):
    rng = random.Random(11)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40, 300))) for _ in range(40)]
    rows = [(i, "".join(rng.choice(parts)[rng.randrange(30) :] for _ in range(rng.randrange(1, 8)))) for i in range(120)]
    for hot in (substring_dedup.HOT, 3, 0):
        got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 120, hot=hot).collect()
        assert digests(got) == brute_cut(rows, 120)


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(40))]
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    strings = [bytes(rng.choice(b"ab\0") for _ in range(30)) for _ in range(6)]
    seen = Counter(s[i : i + 5] for s in strings for i in range(26))
    assert repeated_windows(strings, 5) == [[i for i in range(26) if seen[s[i : i + 5]] > 1] for s in strings]


def test_suffix_decoded(spark):
    rows = [(1, "é" * 40 + "x" * 60 + "ü"), (2, "è" * 40 + "x" * 60 + "û"), (3, "plain é")]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 61, decoded=True).collect()}
    # The second byte of the last character before the run is shared where its first is not, and cut with it.
    assert got[3]["kept"] == "plain é" and got[1]["n_removed"] == got[2]["n_removed"] > 0
    assert all(ord(c) < 0xFFFD for r in got.values() for c in r["kept"])


# --- mixing


def test_mix_query(spark, sf):
    rows = QUERIES["op5_source_mix"](spark, sf).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t in docs_of(spark, sf)}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(r[0]["target"] for r in by.values()) <= 1.5 * sum(sizes.values()) + 1e-6
    for own in by.values():
        total = sum(r["size"] for r in own)
        assert all(r["source_size"] == total and r["target"] <= 2 * total + 1e-6 for r in own)
        # The sum is the nearest that whole documents can reach.
        whole = int(own[0]["target"] // total) if total else 0
        reach = 1
        for r in own:
            reach |= reach << r["size"]
        best = min((abs(whole * total + i - own[0]["target"]) for i in range(total + 1) if reach >> i & 1), default=0)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= best + 1
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in QUERIES["op5_source_mix"](spark, sf).collect()}


def test_targets_share_the_excess():
    t = mixing.fit_targets([10, 1000, 1000, 0], [3, 1, 2, 3])
    assert t[0] == 20 and t[3] == 0 and abs(sum(t) - 1.5 * 2010) < 1e-9 and abs(t[2] - 2995 * 2 / 3) < 1e-9


def test_subset_counts(monkeypatch):
    rng = np.random.default_rng(8)
    for _ in range(200):
        sizes = np.unique(rng.integers(1, 400, rng.integers(1, 12)))
        counts = rng.integers(1, 6, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(rng.integers(0, total + 1))
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        take = mixing.subset_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((sizes * take).sum()) - budget) == min(abs(r - budget) for r in reach)
    monkeypatch.setattr(mixing, "EXACT", 512)
    for _ in range(100):
        sizes = np.unique(rng.integers(1, 60, 20))
        counts = rng.integers(1, 60, len(sizes))
        budget = int(rng.integers(0, int((sizes * counts).sum()) + 1))
        take = mixing.subset_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((sizes * take).sum()) - budget) <= 2
    monkeypatch.undo()
    big = mixing.subset_counts(np.arange(1, 5000), np.full(4999, 10**6), 3 * 10**12)
    assert abs(int((np.arange(1, 5000) * big).sum()) - 3 * 10**12) <= 1


def test_mix_ranks_inside_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rows = spark.range(3000).selectExpr("id doc_id", "'a b c' text", "case when id < 2000 then 'x' else 'y' end source")
    out = mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("times").alias("m"), F.count("*").alias("n")).collect()
    assert all(abs(r["t"] - r["g"]) <= 3 and r["m"] <= 2 for r in out) and sum(r["n"] for r in out) == 3000


def test_mix_odd_and_empty(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0


# --- packing


def check_packing(rows, pairs, length=1024):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % length if len(ids) > length else len(ids)
        cuts = ([(0, head)] if head else []) + [(j, j + length) for j in range(head, len(ids), length)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(cuts)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= length
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // length)


def test_packing_query(spark, sf):
    used, least = check_packing(QUERIES["op4_best_fit_packing"](spark, sf).collect(), docs_of(spark, sf))
    assert used <= 1.02 * least + 1


def test_packing_odd_and_empty(spark, odd, none):
    check_packing(packing.pack(odd, vocabulary(), 64).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 64)
    assert packing.pack(none, vocabulary()).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # Greedy gives 6 + 2 (gap 2); replacing 2 by 3 + 1 leaves none... only if two pieces fit better.
    plan = packing.best_two_fit({60: 1, 25: 1, 20: 2}, 100)
    assert sorted(plan[0][0]) == [20, 20, 60]
    rng = random.Random(9)
    for _ in range(100):
        counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(20)}
        plan = packing.best_two_fit(counts, 100)
        back = Counter()
        for lengths, n in plan:
            assert sum(lengths) <= 100 and n > 0
            for k in lengths:
                back[k] += n
        assert back == counts


def test_encoder_matches_tokenizers():
    from tokenizers import Tokenizer

    import public_tokenizers
    from helixgrid.llm.tokens import Encoder

    tok, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder(vocabulary())
    rng = random.Random(6)
    for _ in range(3000):
        s = "".join(rng.choice(" \n\t  ab1'.,é s!中🙂\r") for _ in range(rng.randrange(25)))
        assert own.ids(s).tolist() == tok.encode(s, add_special_tokens=False).ids
    assert own.ids("a <|endoftext|> b").tolist() == tok.encode("a <|endoftext|> b", add_special_tokens=False).ids


# --- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2]
    used, least = check_packing(corpus_pipeline.run(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= 1.02 * least + 1


def test_pipeline_odd_and_empty(spark, odd, none, tmp_path):
    """Rows without an id, repeated rows and nulls pass every stage, and no row is multiplied before the mix."""
    import corpus_pipeline

    spark.createDataFrame([(1, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        docs = spark.createDataFrame(docs.select(*corpus_pipeline.COLUMNS).collect(), ", ".join(f"{n} {t}" for n, t in docs.select(*corpus_pipeline.COLUMNS).dtypes))
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            before = docs.count()
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
            assert docs.count() <= (2 if n == 3 else 1) * before
            if n == 1:
                assert docs.count() == docs.select("doc_id", "text").distinct().count()
        check_packing(corpus_pipeline.packed(spark, docs, str(tmp_path)).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_pipeline_rejects_rows(spark, tmp_path):
    """A rejected row goes although a row of the same id, or another without an id, is kept."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    rows = [(1, good[0]), (1, "too short"), (None, good[1]), (None, "short too"), (None, None), (2, "short"), (3, good[2]), (3, good[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, good[0]), (None, good[1]), (3, good[2]), (3, good[2])], key=str)
