"""Merkle manifest, quality rules and resampling against brute force; odd rows for each; 64-bit ids beside nulls."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import jaccard, licenses, line_dedup, merkle, mixing, oracles, quality, queries, resample, tiff, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BIG = [2**53 + 1, 2**53 + 3, 2**62, 2**62 + 1, -(2**62) - 1, None]
LONG = " ".join(f"w{i % 700}" for i in range(3000))
ODD = [
    (1, None, "en", "s", 0), (2, "", None, "s", None), (3, " \n\n", "en", None, 3), (4, "One TWO three", "en", "s", 1), (5, LONG, "de", "t", 9), (5, LONG, "de", "t", 9), (6, LONG, "de", "", 9),
    (None, "Alpha beta\nGamma", "en", "s", 7), (None, "Other", "en", None, 7), (9, "ß Ünï çode\x00   A B a b A B a b\nx # y\nx # y", "fr", "ü", 4), *[(i, f"Text {i}", "en", "many", 2) for i in range(100, 140)], (2**53 + 1, "Big", "en", "s", 1), (2**53 + 2, "Big", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit("clash") for c in ("g", "key", "pos", "n", "item", "digest", "__w", "__t", "row")}).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < -9")


def compared(duck, sql, rows):
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    want = collections.Counter(got.fetchall())
    assert collections.Counter(tuple(r[c] for c in names) for r in rows) == want and sorted(names) == sorted(rows[0].__fields__)


# ---- 11


def hashed(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def enc(row):
    return hashed(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS])


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [hashed(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def brute_manifest(docs):
    groups = collections.defaultdict(list)
    for x in docs:
        groups[x["source"]].append((x["doc_id"] is not None, x["doc_id"] or 0, enc(x), x))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        groups[k].sort(key=lambda r: r[:3])
    trees = {k: levels_of([r[2] for r in groups[k]]) for k in names}
    top = levels_of([trees[k][-1][0] for k in names])
    for at, k in enumerate(names):
        for i, (known, doc_id, digest, x) in enumerate(groups[k]):
            path = path_of(trees[k], i) + path_of(top, at)
            later = dict(x)
            if known and zlib.crc32(str(doc_id).encode()) % 5 == 0 and x["text"]:
                later["text"] = re.sub("[A-Z]+", lambda m: m[0].lower(), x["text"])
            h = enc(later)
            for a, b in path:
                h = hashed(a, h, b)
            yield x["doc_id"], digest, trees[k][-1][0], top[-1][0], hashed(*[a + b for a, b in path]), h, h == top[-1][0]


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest_equals_brute_force(spark, data, odd, monkeypatch, levels):
    """With blocks of one level, trees of both the sources and their rows take several rounds; then nothing is broadcast either."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    if levels == 1:
        monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(merkle, "SIZE", 16**levels)
    frame = odd if levels == 3 else odd.union(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", *["text"] * 9).limit(150).withColumn("source", F.lit("many")))
    got = collections.Counter(tuple(r[c] for c in NAMES) for r in merkle.verified(frame).collect())
    assert got == collections.Counter(brute_manifest([r.asDict() for r in frame.select(*merkle.FIELDS).collect()]))


def test_manifest_interface(spark, odd, none):
    made = merkle.Manifest(odd)
    rows = made.proofs().select("subroot", "x.*").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        h = r.leaf
        for left, right in r.path:
            h = hashed(left, h, right)
        assert h == made.root
    one = merkle.verified(odd.where("doc_id = 4")).collect()
    assert [(r.leaf, r.proof_sha256) for r in one] == [(one[0].root, hashed(""))] and one[0].subroot == one[0].root
    assert merkle.verified(none).count() == 0 and tuple(merkle.verified(none).columns) == NAMES


def test_manifest_query_equals_sql(spark, data, duck):
    compared(duck, oracles.SQL["op11_merkle"], queries.op11_merkle(spark, data).collect())


# ---- 12


def spaced(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def brute_measures(text):
    w, seen, covered, twice = spaced(text), set(), set(), 0
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if spaced(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), twice, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_measures_equal_brute_force(spark, data, odd, none):
    repeats = [(i, t, "en", "s", 1) for i, t in enumerate(["a b c a b c", "a a a", "a a a a", "a b a b a", "a b c d a b x b c d", "one\n\none\n \n\none ", "x " * 300, "  a b c"])]
    for frame in (spark.read.parquet(f"{data}/documents.parquet"), odd, spark.createDataFrame(repeats, DOC)):
        want = collections.Counter((r.doc_id, *brute_measures(r.text)[:5]) for r in frame.collect())
        got = quality.judge(frame).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality.judge(none).count() == 0


def test_quality_query_equals_sql(spark, data, duck):
    rows = queries.op12_quality_rules(spark, data).collect()
    compared(duck, oracles.SQL["op12_quality_rules"], rows)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(r.base_failed == brute_measures(text[r.doc_id])[5] and not (r.base_failed and r.kept) for r in rows)


def test_quality_finds_low_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = {r.doc_id: (r.kept, r.base_failed) for r in queries.op12_quality_rules(spark, d).collect()}
    low = [kept[i][0] for i, q in labels.items() if q == 0]
    fine = [kept[i][0] for i, q in labels.items() if q == 1 and not kept[i][1]]
    assert not any(low) and np.mean(fine) > 0.98


def test_rules_are_a_table(spark, odd):
    rules = spark.createDataFrame([("b", "n_words", 3.0, None), ("a", "symbol_ratio", None, 0.2)], "name string, measure string, least double, most double")
    rows = {r.doc_id: r for r in quality.judge(odd, rules).collect()}
    assert rows[4].kept and rows[4].failed == [] and rows[1].failed == ["a", "b"] and not rows[1].kept


# ---- 13


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w]


def brute_resample(docs, target, percent=10, least=20, grams=1, buckets=10_000, seed=2024):
    of = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [words(t)] for k in range(1, grams + 1) for i in range(len(w) - k + 1)]
    s, t = collections.Counter(b for d in docs for b in of(d.text)), collections.Counter(b for x in target for b in of(x))
    total = [float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)]
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * total[0] / ((s[b] + 1.0) * total[1]))) for b in range(buckets)}
    out = []
    for d in docs:
        f = of(d.text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d.doc_id is None else d.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([d.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(d.text))])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("grams", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 77, 60, 3)])
def test_resample_equals_brute_force(spark, data, odd, none, grams, buckets, percent, least):
    target = spark.read.parquet(f"{data}/benchmark.parquet")
    for frame in (spark.read.parquet(f"{data}/documents.parquet"), odd):
        got = resample.resample(frame, target, percent, least, grams, buckets).collect()
        assert collections.Counter(tuple(r) for r in got) == brute_resample(frame.collect(), [r.text for r in target.collect()], percent, least, grams, buckets)
    assert resample.resample(none, target).count() == 0 and resample.resample(odd, target.where("item_id < 0")).count() == len(ODD)


def test_bit_slices_are_exact():
    r = np.random.default_rng(0)
    counts, gain = r.integers(0, 5000, (9, 130)) * (r.random((9, 130)) < 0.4), r.integers(-9000, 9000, 130)
    got = resample._sums(resample.planes(counts), resample.planes(np.maximum(gain, 0)), resample.planes(np.maximum(-gain, 0)), 9)
    assert (got == counts @ gain).all() and resample.planes(np.zeros((2, 5), int)) == []


def test_resample_query_equals_sql(spark, data, duck):
    compared(duck, oracles.SQL["op13_resample"], queries.op13_resample(spark, data).collect())


# ---- ids


def test_ids_above_2_to_53_beside_nulls(spark):
    docs = spark.createDataFrame([(i, f"Some words here {k}", "en", "s", 1) for k, i in enumerate(BIG)], DOC).coalesce(1)
    got = tiff.digest_pages(tiff.tiff_pages(tiff.to_tiff(docs))).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(BIG)
    pages = spark.createDataFrame([(i, f"http://a/{k}", "<p>same</p>" * 20) for k, i in enumerate(BIG)] + [(7, "http://b", "short")], "page_id long, url string, html string").coalesce(1)
    rows = {r.page_id: r for r in warc.read_records(warc.write_bundles(pages)).collect()}
    first = min(i for i in BIG if i is not None)
    assert set(rows) == {*BIG, 7} and rows[first].refers_to is None and all(rows[i].refers_to == first for i in BIG if i != first)
    assert {r.doc_id for r in resample.resample(docs, docs).collect()} == {r.doc_id for r in merkle.verified(docs).collect()} == {r.doc_id for r in quality.judge(docs).collect()} == set(BIG)


def test_bundles_end_by_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 3)
    index = list(warc._bundles(iter([__import__("pandas").DataFrame({"page_id": [str(i) for i in range(8)], "url": None, "html": "x", "payload_digest": "d", "refers_to": None})])))
    assert [len(x.records[0]) for x in index] == [3, 3, 2]


@pytest.mark.parametrize("ids_only", [True, False])
def test_mixing_keeps_sources_apart(spark, ids_only):
    """Equal ids and texts, and null ids with empty texts, in two sources: one source's extra draws aren't the other's."""
    big = [(i, "a b c d e f g h i j" if i < 10 else "k l m n o p q r s t", "en", "big", 1) for i in range(100)]
    small = [(i, "a b c d e f g h i j", "en", "small", 1) for i in range(10)]
    rows = big + small + [(None, "", "en", s, 0) for s in ("big", "small", None)]
    got = mixing.mix(spark.createDataFrame(rows, DOC), repeats=1.5, ids_only=ids_only).collect()
    of = collections.Counter(r.source for r in got if r.doc_id is not None)
    assert of == {"big": 100, "small": 15}
    assert all(n == 1 for n in collections.Counter(r.doc_id for r in got if r.source == "big" and r.doc_id is not None).values())


def test_hot_lines_are_split(spark, data, monkeypatch):
    """With windows told by broadcast from the second place on, the same lines go."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.union(docs.limit(60)).withColumn("doc_id", F.monotonically_increasing_id())
    rows = lambda: collections.Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    want = rows()
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 1)
    assert rows() == want and any(r[3] for r in want)


def test_hot_cells_give_the_same_classes(spark, data, monkeypatch):
    """With cells that are hot from the second item on, classes stay as they are."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.unionByName(docs.limit(70).select((F.col("doc_id") + 10_000).alias("doc_id"), "source", "lang", "n_chars", F.concat("text", F.lit(" more")).alias("text")))
    rows = lambda: collections.Counter(tuple(r) for r in jaccard.Join(4, 85).classes(docs).collect())
    want = rows()
    monkeypatch.setattr(jaccard, "HOT_ROWS", 1)
    assert rows() == want and len({r[2] for r in want}) < docs.count()


def test_whole_licence_texts_and_names(spark):
    texts = ["GNU Lesser General Public License version 3", "BSD 3-Clause License", "Licensed under CC BY-SA 4.0", "This is free and unencumbered software\nreleased into the public domain.", dict(licenses.TEMPLATES)["mit-text"].upper()]
    rows = spark.createDataFrame([(i, f"Some words. {t} and more", "en", "s", 1) for i, t in enumerate(texts)] + [(9, "merge " * 3000 + "publish", "en", "s", 1)], DOC)
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(rows).collect()}
    assert got[0] == {"lgpl"} and got[1] == {"bsd-3-clause"} and {"cc-by", "cc-by-sa"} <= got[2] and got[3] == {"unlicense"} and {"mit-grant", "mit-text"} <= got[4] and got[9] == {""}


def test_long_templates_as_a_table(spark):
    """Templates of hundreds of words with repeats, texts with words lost, added and moved apart; against brute force."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {f"t{j}": " ".join(rng.choice(vocabulary, n)) for j, n in enumerate((3, 12, 60, 300, 600))}
    rows = []
    for text in texts.values():
        for lost in (0.0, 0.1, 0.25, 0.4):
            w = [x for x in text.split() if rng.random() >= lost]
            for _ in range(int(rng.integers(0, 1 + len(w) // 6))):
                w.insert(int(rng.integers(0, len(w) + 1)), str(rng.choice(vocabulary)))
            rows.append((len(rows), " ".join(["before"] * int(rng.integers(0, 900)) + w + ["after"] * int(rng.integers(0, 900)))))
    rows += [(len(rows), " ".join(rng.choice(vocabulary, 3000))), (None, texts["t2"]), (None, texts["t2"]), (None, texts["t1"]), (90, ""), (91, None)]
    table = spark.createDataFrame([(k, f"{t.upper()}\n") for k, t in texts.items()] + [("void", " - "), ("void", None)], "label string, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def brute(text):
        w, best, labels = (text or "").lower().split(), 0.0, set()
        for label, t in texts.items():
            n, own = math.ceil(len(t.split()) / 0.8 - 1e-9), set(t.split())
            most = max(len(own & set(w[i : i + n])) for i in range(max(len(w) - n + 1, 1)))
            if most >= (math.ceil(0.8 * len(own) - 1e-9) if len(own) >= 10 else len(own)):
                labels, best = labels | {label}, max(best, most / len(own))
        return ",".join(sorted(labels)), round(best, 6)

    got = sorted(((r.doc_id, r.labels, r.score) for r in licenses.scan(docs, table).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert sum(bool(x) for _, x, _ in got) > 8 and any(0 < s < 1 for _, _, s in got)
    assert all(not r.labels for r in licenses.scan(docs, []).collect())
