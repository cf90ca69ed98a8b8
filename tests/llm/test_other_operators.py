"""Classifier, fingerprints, archives, license scan and language identification."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixgrid.llm import archives, fingerprints, language, licenses, quality, rules
from helixgrid.llm.queries import QUERIES


def docs_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


# --- quality classifier


def test_quality_query(spark, sf):
    rows = QUERIES["op1_quality_classifier"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_quality_classifier"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.92
    assert np.mean([r["predicted"] for r in rows if labels[r["doc_id"]] == 1]) > 0.97


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(4)
    m = quality.Machine(0.3, rng.normal(size=40).astype(np.float32), rng.normal(size=(40, 5)).astype(np.float32), np.zeros((quality.STATS, 1)))
    ids, x = np.array([3, 7, 11, 30, 3 + 1]), rng.random(5).astype(np.float32)
    want = m.bias + (m.linear[ids] * x).sum() + sum((m.factors[ids[a]] @ m.factors[ids[b]]) * x[a] * x[b] for a in range(5) for b in range(a + 1, 5))
    assert abs(m.margins(ids, x, np.array([0]))[0] - want) < 1e-4


def test_quality_scores_by_the_formula(spark, sf):
    """Every score of the table against the machine's definition: all pairs of coordinates, one by one."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, m).collect()}
    known = quality.WordHashes()
    for r in docs.collect():
        ids, x = quality._words(r["text"], known)
        stats = np.array([quality._ratios(r["text"], r["n_chars"])], float)
        ids, x = np.r_[m.stat_ids(stats)[0], ids], np.r_[np.ones(quality.STATS), x].astype(float)
        v = m.factors[ids].astype(float)
        gram = v @ v.T * np.outer(x, x)
        want = m.bias + float((m.linear[ids].astype(float) * x).sum()) + float(np.triu(gram, 1).sum())
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(want, -35, 35)))) < 1e-4


def _crowd(spark, n=4000):
    """One id and no id on thousands of rows each, equal rows among them, beside some others."""
    rows = [(1, f"the same id {i} " + "words of a text that goes on " * 3) for i in range(n)] + [(None, f"no id {i} " + "der hund und die katze " * 3) for i in range(n)]
    rows += [(2, "an equal row of many words that is there again and again")] * n + [(i, f"document {i} le chien et le chat " * 4) for i in range(10, 60)]
    return spark.createDataFrame([(i, t, ("en", "de", "fr")[j * 3 // len(rows)], len(t)) for j, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n_chars long")


def test_learning_is_bounded_by_ids(spark, monkeypatch):
    docs = _crowd(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, *range(10, 60))], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(quality, "train", lambda stats, words, good: seen.update(n=len(good)) or _train(stats, words, good))
    rows = quality.quality_scores(docs.drop("n_chars"), quality.fit(docs.drop("n_chars"), labels)).collect()
    assert seen["n"] <= 52 and len(rows) == docs.count()
    learned = []
    monkeypatch.setattr(rules, "learn", lambda x, bad: learned.append(len(bad)) or rules.DecisionList(()))
    assert rules.quality_rules(docs, labels).count() == docs.count() and learned[0] <= 52
    drawn = []
    monkeypatch.setattr(language, "ladder", lambda x, names: drawn.append(len(names)) or _ladder(x, names))
    model = language.fit(docs, sample=300)
    # Two rows for each text drawn; the draw is about the sample's size.
    assert 100 < drawn[0] < 2 * 300 * 1.5 and len(language.languages(docs, model).collect()) == docs.count()


_train, _ladder = quality.train, language.ladder


def test_language_scores_by_the_formula(spark, sf):
    """Every prediction of the table against the machines applied one pair at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(docs, model).collect()}

    def decide(ladder, x):
        if len(ladder.classes) == 1:
            return ladder.classes[0], 1.0
        wins, total, least = defaultdict(int), defaultdict(float), defaultdict(lambda: np.inf)
        for (i, j), w, b in zip(ladder.pairs, ladder.weights, ladder.biases, strict=True):
            margin = float(w @ x) + float(b)
            for c, m in ((i, margin), (j, -margin)):
                wins[c] += m > 0
                total[c] += np.tanh(m)
                least[c] = min(least[c], m)
        best = max(range(len(ladder.classes)), key=lambda c: (wins[c] + total[c] / (4 * len(ladder.classes)), -c))
        return ladder.classes[best], 1 / (1 + np.exp(-4 * np.clip(least[best], -8, 8)))

    for r in docs.collect():
        data = language.letters(r["text"])
        if not data:
            assert got[r["doc_id"]] == ("und", 1.0)
            continue
        x = language.features(data).astype(float)
        family, sure = decide(model.families, x)
        lang, also = decide(model.inside[family], x)
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - sure * also) < 1e-4


def test_quality_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(odd, quality.fit(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    only = quality.fit(odd, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.quality_scores(odd, only).collect()} == {0.5}
    assert quality.quality_scores(none, only).count() == 0


# --- fingerprints


def slow_fingerprint(text):
    """The definition, byte by byte."""
    data = (text or "").encode()
    n, block = len(data), 3
    if not n:
        return "3::"
    while block * 64 < n:
        block *= 2
    hashes = []
    for i in range(n):
        win = [data[j] if j >= 0 else 0 for j in range(i - 6, i + 1)]
        shifted = 0
        for j, b in enumerate(win):
            shifted ^= b << 5 * (6 - j)
        hashes.append((sum(win) + sum((j + 1) * b for j, b in enumerate(win)) + (shifted & 0xFFFFFFFF)) & 0xFFFFFFFF)

    def ends(size):
        return [i for i, h in enumerate(hashes) if h % size == size - 1]

    while block > 3 and len(ends(block)) < 32:
        block //= 2

    def mix(x):
        x = x & (2**64 - 1)
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & (2**64 - 1)
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & (2**64 - 1)
        return x ^ x >> 31

    def sign(size):
        cuts = [e + 1 for e in ends(size)[:63]]
        cuts += [n] if not cuts or cuts[-1] < n else []
        out, at = "", 0
        for c in cuts:
            value = sum((b + 1) * pow(0x100000001B3, j, 2**64) for j, b in enumerate(data[at:c]))
            out += fingerprints.ALPHABET[mix(value + 1) >> 58]
            at = c
        return out

    return f"{block}:{sign(block)}:{sign(2 * block)}"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_fingerprint_matches_definition(spark, sf):
    rng = random.Random(2)
    texts = [t for _, t in docs_of(spark, sf)[:25] if len(t) < 3000] + ["", "a", "é", "x" * 1000, "abc " * 200] + ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(400))) for _ in range(20)]
    assert [fingerprints.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_common_and_likeness():
    rng = random.Random(3)
    pairs = [("".join(rng.choice("ABCDa") for _ in range(rng.randrange(1, 65))), "".join(rng.choice("ABCDa") for _ in range(rng.randrange(1, 65)))) for _ in range(300)]
    assert fingerprints._common([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [lcs(a, b) for a, b in pairs]
    f = fingerprints.likeness(["3:ABCDEF:AB", "3:ABCDEF:AB", "6:ABCDE:X", "3:ABCD:EFGH", "3::"], ["3:ABCDEF:AB", "6:ABCDEF:AB", "3:zzzz:ABCDE", "12:ABCD:EFGH", "3::"])
    assert f[0] == 1 and f[1] == 0.99 * 0 + min(0.99, 2 * 2 / 8) and f[2] == 0.99 and f[3] == 0 and f[4] == 1


def check_fingerprints(rows, pairs):
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0))
    follow = {p[0]: order[(i + 1) % len(order)][1] or "" for i, p in enumerate(order)}
    text = {i: t or "" for i, t in pairs}
    assert len(rows) == len(pairs)
    for r in rows:
        t, nxt = text[r["doc_id"]], follow[r["doc_id"]]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t) and r["edited_fingerprint"] == fingerprints.fingerprint(e)
        assert r["near_edited"] == fingerprints.likeness([r["fingerprint"]], [r["edited_fingerprint"]])[0]
        assert r["near_next"] == fingerprints.likeness([r["fingerprint"]], [fingerprints.fingerprint(nxt)])[0]


def test_fingerprints_query(spark, sf):
    rows = QUERIES["op2_fingerprints"](spark, sf).collect()
    check_fingerprints(rows, docs_of(spark, sf))
    assert np.mean([r["near_edited"] for r in rows if r["n_chars"] > 200]) > 0.45
    assert np.mean([r["near_next"] for r in rows]) < 0.1


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_odd_and_empty(spark, odd, none, parts):
    single = odd.dropDuplicates(["doc_id"])
    check_fingerprints(fingerprints.fingerprints(single, parts=parts).collect(), [(r["doc_id"], r["text"]) for r in single.collect()])
    assert fingerprints.fingerprints(odd, parts=parts).count() == odd.count()
    assert fingerprints.fingerprints(none, parts=parts).count() == 0
    one = fingerprints.fingerprints(odd.where("doc_id = 12"), parts=parts).first()
    assert one["near_next"] == 1


def test_fingerprints_of_one_id(spark):
    """Large ids beside none, and equal rows that fill several ranges."""
    rows = [(2**62 + 1, "a text of its own"), (2**62 + 3, "another text")] + [(None, "no id")] * 40 + [(5, "equal " * 30)] * 200
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), parts=8).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    last = next(r for r in got if r["doc_id"] == 2**62 + 3)
    assert last["edited_sha256"] == hashlib.sha256(b"anotheno id").hexdigest()
    assert sum(r["near_next"] == 1 for r in got if r["doc_id"] == 5) == 199


# --- archives


def base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def check_warc(rows, pages):
    groups = defaultdict(list)
    for i, h in pages:
        groups[(h or "").encode()].append(i)
    want = []
    for data, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, len(data), base32(data), "response" if i == top else "revisit", None if i == top else top) for i in ids]
    key = lambda r: (r[0] is not None, r)
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows], key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))


def test_warc_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    check_warc(QUERIES["op3_warc_converter"](spark, sf).collect(), [(r["page_id"], r["html"]) for r in pages.collect()])


@pytest.mark.parametrize("version", [1, 2])
def test_warc_odd_and_empty(spark, tmp_path, version):
    rows = [(1, "http://a b/ü", "<p>x</p>"), (2, None, None), (3, "", ""), (4, "http://x\ny", "<p>x</p>"), (5, "u", "A\r\n\r\nWARC/1.1\r\n\r\n\n"), (None, "u", "only"), (None, "v", "<p>x</p>"), (-9, "u", "é" * 1000), (2**62, "u", "🙂")]
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, id int, digest string")
    path = str(tmp_path / "w")
    archives.write_warcs(archives.arcs_to_records(archives.pages_to_arcs(pages, version)), path)
    back = archives.read_warcs(spark, path)
    check_warc(back.withColumnRenamed("id", "page_id").collect(), [(r[0], r[2]) for r in rows])
    assert {r["url"] for r in back.collect()} >= {"http://a b/ü", "-", "http://x%0Ay"}
    archives.write_warcs(archives.arcs_to_records(archives.pages_to_arcs(pages.limit(0), version)), path + "e")
    assert archives.read_warcs(spark, path + "e").count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parsing(spark, tmp_path, version):
    records = [archives.Record("http://x/a b", "1.2.3.4", "19970102030405", "text/html", "200", b"HTTP/1.0 200 OK\nX-Archive-Id: 7\n\nbody\n"), archives.Record("dns:x", "0.0.0.0", "199701020304", "text/dns", "-", b"\xff\x00 data"), archives.Record("e", "-", "1", "-", "-", b"")]
    data = archives.arc_bytes(records, version)
    got = list(archives.arc_records(data))
    assert [(r.url, r.ip, r.date, r.mime, r.block) for r in got] == [(r.url, r.ip, r.date, r.mime, r.block) for r in records]
    head, block = next(archives.warc_records(archives.warc_bytes(got[0], 7)))
    assert head["warc-type"] == "response" and head["warc-date"] == "1997-01-02T03:04:05Z" and block == records[0].block and head["warc-payload-digest"] == "sha1:" + base32(b"body\n")
    head, block = next(archives.warc_records(archives.warc_bytes(got[1], None)))
    assert head["warc-type"] == "resource" and head["content-type"] == "text/dns" and block == records[1].block and archives.uuid_key(head["warc-record-id"]) is None
    head, block = next(archives.warc_records(archives.warc_bytes(got[0], 7, 9)))
    assert head["warc-type"] == "revisit" and block == b"HTTP/1.0 200 OK\nX-Archive-Id: 7\n\n" and archives.uuid_key(head["warc-refers-to"]) == 9
    (tmp_path / "x.arc.gz").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]))
    (tmp_path / "y.arc").write_bytes(data)
    rows = archives.arcs_to_records(archives.read_arcs(spark, str(tmp_path))).collect()
    assert len(rows) == 6 and {r["id"] for r in rows} == {7, None}
    for bad in (data.replace(b" 7\n", b" 99999\n", 1), b"http://x 1 2 3 4\n", data[: data.index(b"\n")]):
        with pytest.raises((archives.ArchiveError, IndexError)):
            list(archives.arc_records(bad))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_in_the_wild(version):
    """URLs in Latin-1 and with spaces, types with parameters, and streams that arrive byte by byte."""
    about = f"{version} 0 export\n{archives.ARC_FIELDS[version]}\n".encode()
    tail = b"" if version == 1 else b"200 - - 0 old.arc "
    lines = [b"http://x/caf\xe9 1.2.3.4 19970102030405 text/html; charset=iso-8859-1 ", b"http://y/a 5.6.7.8 20000101000000 b 1.2.3.4 19970102030405 text/plain; format=flowed; x=1 ", "http://z/é 2001:db8::1 19970102030405 text/html ".encode()]
    bodies = [b"HTTP/1.0 200 OK\r\n\r\nbody " + bytes(range(256)), b"x" * 70_000, b""]
    data = b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain " + tail + str(len(about)).encode() + b"\n" + about + b"\n"
    for line, body in zip(lines, bodies, strict=True):
        data += line + tail + str(len(body)).encode() + b"\n" + body + b"\n"
    want = [("http://x/café", "1.2.3.4", "19970102030405", "text/html; charset=iso-8859-1"), ("http://y/a 5.6.7.8 20000101000000 b", "1.2.3.4", "19970102030405", "text/plain; format=flowed; x=1"), ("http://z/é", "2001:db8::1", "19970102030405", "text/html")]
    packed = gzip.compress(data[:99]) + gzip.compress(data[99:40_000]) + gzip.compress(data[40_000:])
    for source in (data, archives.Stream(bytes([b]) for b in data), archives.Stream(archives._chunks(packed, 1000)), archives.Stream(archives._chunks(data, 7))):
        got = list(archives.arc_records(source))
        assert [(r.url, r.ip, r.date, r.mime) for r in got] == want and [r.block for r in got] == bodies
    warc = b"".join(archives.warc_bytes(r, i) for i, r in enumerate(got))
    assert [b for _, b in archives.warc_records(archives.Stream(archives._chunks(gzip.compress(warc), 333)))] == bodies
    with pytest.raises(archives.ArchiveError):
        list(archives._chunks(packed[:-9]))


def test_warc_long_and_repeated(spark, tmp_path):
    """Very long html, rows of one id with equal and other payloads, and many rows without an id."""
    pages = [(1, "u", "long " * 600_000), (2, "u", "same"), (2, "u", "same"), (2, "u", "other"), (3, "u", "same"), (3, "u", None), *[(None, "u", "same")] * 50, (2**62 + 1, "u", "x"), (2**62 + 3, "u", "x")]
    records = archives.pages_to_records(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3))
    archives.write_warcs(records, str(tmp_path / "w"))
    got = archives.read_warcs(spark, str(tmp_path / "w")).collect()
    assert sorted((str(r["id"]), r["payload_bytes"]) for r in got) == sorted((str(i), len((h or "").encode())) for i, _, h in pages)
    by = defaultdict(set)
    for r in got:
        by[r["id"], r["payload_bytes"]].add((r["record_type"], r["refers_to"]))
    assert by[1, 3_000_000] == {("response", None)} and by[2, 4] == {("revisit", 3)} and by[None, 4] == {("revisit", 3)} and by[2, 5] == {("response", None)}
    assert by[3, 4] == {("response", None)} == by[3, 0] and by[2**62 + 1, 1] == {("revisit", 2**62 + 3)}


def test_record_names():
    for k in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        assert archives.uuid_key(archives.record_uuid(k)) == k
    assert len({archives.record_uuid(k) for k in range(1000)}) == 1000


# --- license scan


def brute_licenses(text, templates=licenses.TEMPLATES):
    """Templates of which a text holds 0.8 of the shingles; one of fewer than five words must stand in the text as it is."""
    words = licenses.normalised(text)

    def grams(w):
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    found, own = set(), grams(words)
    for name, texts in templates.items():
        for i, t in enumerate(texts):
            short = licenses.normalised(t)
            want = grams(short)
            if len(short) < 5:
                if any(words[j : j + len(short)] == short for j in range(len(words))):
                    found.add((name, i))
            elif 100 * len(want & own) >= 80 * len(want):
                found.add((name, i))
    return found


def test_license_query(spark, sf):
    rows = {r["doc_id"]: r["licenses"] for r in QUERIES["op7_license_scan"](spark, sf).collect()}
    assert rows == {i: ",".join(sorted({n for n, _ in brute_licenses(t, licenses.ALL)})) for i, t in docs_of(spark, sf)}
    assert any(rows.values())


def test_license_retrieval(spark):
    rng = random.Random(8)
    rows = []
    for n, texts in enumerate(licenses.TEMPLATES.values()):
        for m, t in enumerate(texts):
            for r in range(6):
                words = t.split()
                if r > 3 and len(words) > 35:
                    words[len(words) // 3] = "changed"
                pad = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 400))]
                at = rng.randrange(len(pad) + 1)
                rows.append((n * 100 + m * 10 + r, " ".join([*pad[:at], *words, *pad[at:]])))
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, (i, t) in zip(sorted(got, key=lambda x: x["doc_id"]), sorted(rows), strict=True):
        assert r["doc_id"] == i and {(m["license"], m["template"]) for m in r["matches"]} == brute_licenses(t)
        for m in r["matches"]:
            assert 0 <= m["first"] < m["end"] <= r["n_words"] and m["containment"] >= 0.8


def test_license_phrases(spark):
    """A template under five words is found inside a long text, in a text of its own and in none that lacks a word of it."""
    pad = " ".join(f"w{i}" for i in range(300))
    texts = [f"{pad} (c) 2020 All rights reserved. {pad}", "All rights reserved.", f"all rights reserved {pad} ALL RIGHTS RESERVED", f"{pad} all other rights reserved {pad}", "all rights"]
    got = {r["doc_id"]: [(m["license"], m["first"], m["end"]) for m in r["matches"]] for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.ALL).collect()}
    found = {i: [("Proprietary", a, a + 3) for a in at] for i, at in enumerate([[302], [0], [0, 303], [], []])}
    assert got == found
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"] for r in QUERIES["op7_license_scan"](spark, sf).collect() if "Proprietary" in r["licenses"]}
    assert rows == {i for i, t in docs_of(spark, sf) if b" all rights reserved " in b" %b " % b" ".join(licenses.normalised(t))} and rows


def test_license_insertions():
    """Words inserted into a template: it is found at every place of the text, also next to an exact one."""
    index, known = licenses.Index(licenses.TEMPLATES), licenses.WordHashes()
    t = index.names.index(("LGPL-3.0", 0))
    words = licenses.normalised(licenses.TEMPLATES["LGPL-3.0"][0])
    cut = [*words[:15], *(b"in%d" % i for i in range(30)), *words[15:]]
    for before in range(130):
        pad = [b"w%d" % i for i in range(before)]
        assert [m[:3] for m in index.scan([*pad, *cut, *pad], known) if m[0] == t] == [(t, before, before + len(cut))]
        both = [m[1:] for m in index.scan([*pad, *words, *cut], known) if m[0] == t]
        assert both == [(before, before + len(words), 1.0), (before + len(words), before + len(words) + len(cut), 21 / 25)]


def test_license_windows_have_their_minima():
    """What the bands retrieve, against windows hashed one by one; parts of the text meet without a gap."""
    index = licenses.Index(licenses.TEMPLATES)
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 3 * licenses.PART + 77).astype(np.uint64)
    for t, own in enumerate(index.sets):
        at = int(rng.integers(0, len(h) - len(own)))
        h[at : at + len(own)] = own
    want = set()
    for t, level in index.level_of.items():
        bands = licenses.FEW if level == 1 else licenses.BANDS
        mine = licenses.minima(index.sets[t]).min(axis=0)[:bands]
        for start in range(0, len(h), 1 << (level - 1)):
            if (licenses.minima(h[start : start + (1 << level)]).min(axis=0)[:bands] == mine).any():
                want.add((start, start + (1 << level), t))
    assert set(index.retrieved(h)) == want and {t for _, _, t in want} == set(index.level_of)


def test_license_repeated_rows(spark):
    """Rows that match and are repeated have equal answers, in a batch of many."""
    text = " ".join(["x y z"] * 50 + [licenses.TEMPLATES["MIT"][0]] + ["u v w"] * 50)
    rows = [(1, text)] * 300 + [(2, "nothing here " * 20)] * 300 + [(None, text)] * 5
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 605 and all([(m["license"], m["first"]) for m in r["matches"]] == ([] if r["doc_id"] == 2 else [("MIT", 150)]) for r in got)


def test_license_odd_and_empty(spark, odd, none):
    assert {r["doc_id"] for r in licenses.license_scan(odd).collect() if not r["matches"]} == {r["doc_id"] for r in odd.collect()}
    assert licenses.license_scan(none).count() == 0


# --- language


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        d = docs[r["doc_id"]]
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and d["lang"]:
            right.append(r["lang_pred"] == d["lang"])
    assert np.mean(right) > 0.97


def test_language_odd_and_empty(spark, odd, none):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("el perro y el gato", "es")] * 30)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    rows = {r["doc_id"]: r["lang_pred"] for r in language.languages(odd, model).collect()}
    assert len(rows) == odd.select("doc_id").distinct().count()
    assert rows[1] == rows[2] == rows[3] == rows[20] == "und" and rows[4] in {"de", "en", "fr", "es"}
    seen = {r["doc_id"]: r["lang_pred"] for r in language.languages(docs, model).collect()}
    assert [seen[i] for i in range(4)] == ["de", "en", "fr", "es"]
    assert language.languages(none, model).count() == 0
    empty = language.fit(none)
    assert {r["lang_pred"] for r in language.languages(odd, empty).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language.languages(odd.where(F.col("doc_id") > 3).where("doc_id <> 20"), one).collect()} == {"de"}
