"""Training-data operators against brute force, round trips and held-out labels; odd rows for each of them."""

import collections
import hashlib
import math
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import common, decontaminate, jaccard, licenses, line_dedup, mixing, oracles, queries, sharding, tiff, toxicity, urls, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(5000))
ODD = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\n", "en", None, 3), (4, "one two three", "en", "s", 1), (5, LONG, "de", "t", 9), (5, LONG, "de", "t", 9), (6, LONG, "de", "t", 9),
    (None, "Alpha beta\nGamma delta\nEpsilon zeta eta\ntheta", "en", "u", 7), (8, "Alpha beta\nGamma delta\nEpsilon zeta eta\nother end", "en", "u", 7), (9, "ß Ünï çode\x00 \u2028 gnu GENERAL-public License, mit\nLICENSE", "fr", "v", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("row", F.lit("clash")).withColumn("shard", F.lit(7)).withColumn("h", F.lit(1)).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]


def docs_of(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# ---- 1


def brute_leaks(docs, items):
    s = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    its = [(i, min(5, len(words(t))), s(words(t), min(5, len(words(t))))) for i, t in items if words(t)]
    return {(d, i, len(x & y), len(y)) for d, t in docs for w in [words(t)] for i, k, y in its for x in [s(w, k)] if len(x & y) >= 0.8 * len(y) - 1e-9}


def test_leaks_equal_brute_force(spark, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    docs = docs_of(spark, data)
    parts = docs.limit(30).select((F.col("doc_id") + 10_000).alias("item_id"), F.expr("array_join(slice(split(text, ' '), 5, 20), ' ')").alias("text"))
    # near items: the first words changed, so that about 0.8 of the shingles stay
    near = parts.withColumn("text", F.concat(F.lit("changed words here "), "text"))
    short = docs.limit(12).select((F.col("doc_id") + 20_000).alias("item_id"), F.expr("array_join(slice(split(text, ' '), 7, cast(doc_id % 4 + 1 as int)), ' ')").alias("text"))
    both = items.unionByName(near).unionByName(short).cache()
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in both.collect()])
    got = {(r.doc_id, r.item_id, r.shared, r.n_item) for r in decontaminate.leaks(docs, both).collect()}
    assert got == want and len(want) > 20 and {len(words(r.text)) for r in both.collect() if r.item_id in {w[1] for w in want}} >= {1, 2, 3, 4}
    clean = decontaminate.clean(docs, both)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {w[0] for w in want} and clean.columns == docs.columns


def test_leaks_by_salted_shuffle(spark, data, odd, monkeypatch):
    """With nothing small enough to broadcast, the same leaks; a passage stands in most documents, under null ids too."""
    passage = "one two three four five six seven eight nine"
    docs = docs_of(spark, data).select("doc_id", "text").unionByName(spark.createDataFrame([(None if i % 3 == 0 else 70_000 + i, f"start {i} {passage} end") for i in range(300)], "doc_id long, text string")).unionByName(odd.select("doc_id", "text"))
    items = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(-1, passage), (-2, "two three")], "item_id long, text string"))
    rows = lambda: sorted((tuple(r) for r in decontaminate.leaks(docs, items).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert rows() == want and len(want) > 400


def test_leaks_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, "a b c"), (4, "Two"), (7, "three four"), (8, " \u2028 "), (9, "one two three"), (3, " ".join(f"w{i}" for i in range(100, 130))), (3, "w9 w9 w9 w9 w9 w9"), (None, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()} == {(5, 3), (6, 3), (5, None), (6, None), (4, 4), (4, 9), (9, 8)}
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(odd, items.where("item_id < 0")).count() == 0
    assert decontaminate.clean(odd, items).count() == len(ODD) - 5
    item = spark.createDataFrame([(1, "here stands a benchmark item of words")], "item_id long, text string")
    shared = spark.createDataFrame([(None, "clean"), (None, "x here stands a benchmark item of words"), (7, "here stands a benchmark item of words y"), (7, "clean too"), (7, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in decontaminate.clean(shared, item).collect()} == {(None, "clean"), (7, "clean too"), (7, None)}


# ---- 2


def brute_scan(text):
    w, places = words(text), []
    for p, label in licenses.PHRASES.items():
        p = p.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    labels, best = {x for _, x in places}, 0.0
    for name, t in licenses.TEMPLATES:
        n, t = math.ceil(len(t.split()) / 0.8 - 1e-9), set(t.split())
        most = max(len(t & set(w[i : i + n])) for i in range(max(len(w) - n + 1, 1)))
        if most >= (math.ceil(0.8 * len(t) - 1e-9) if len(t) >= 10 else len(t)):
            labels.add(name)
            best = max(best, most / len(t))
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if at else round(best, 6)


def test_licenses_equal_brute_force(spark, data, odd, none):
    extra = spark.createDataFrame([(90_000 + i, t.upper() + " and more", "en", "x", 1) for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(90_100 + i, " ".join(t.split()[2:]), "en", "x", 1) for i, (_, t) in enumerate(licenses.TEMPLATES)], DOC)
    for frame in (docs_of(spark, data).unionByName(extra), odd):
        want = collections.Counter((r.doc_id, *brute_scan(r.text)) for r in frame.collect())
        got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(frame).collect())
        assert got == want
    assert licenses.scan(none).count() == 0


def test_licenses_wrapped_over_lines(spark, data):
    rng, texts = np.random.default_rng(1), []
    for _, t in licenses.TEMPLATES:
        texts += ["\n".join(f"{mark}{x}" for x in textwrap.wrap(f"Some words. {t} and more words.", 40)) for mark in ("", "# ", " * ")]
        for _ in range(6):
            w = [x for x in t.split() if rng.random() > 0.15]
            for _ in range(int(rng.integers(0, 14))):
                w.insert(int(rng.integers(0, len(w) + 1)), "filler")
            texts.append("\n".join(textwrap.wrap("filler " * int(rng.integers(0, 90)) + " ".join(w) + " filler" * int(rng.integers(0, 90)), 30)))
    docs = docs_of(spark, data).unionByName(spark.createDataFrame([(50_000 + i, t, "en", "x", 1) for i, t in enumerate(texts)], DOC))
    want = {r.doc_id: brute_scan(r.text)[5:] for r in docs.collect()}
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got == want
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert all(name in got[50_000 + 9 * i + j][0].split(",") for j in range(3))


def test_prose_has_no_label(spark):
    prose = "yesterday the committee released a long report under which the new license fee for the use of this file is not to be paid by any person except in compliance with the terms of the law"
    rows = [(1, prose), (2, f"{prose} " * 50), (3, "released under the new license"), (4, "licensed under cc by"), (5, f"{prose} released under the mit license")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("", 0.0), 2: ("", 0.0), 3: ("", 0.0), 4: ("cc-by", 1.0), 5: ("mit,mit-short", 1.0)}


# ---- 3


def brute_lines(docs):
    seen, out = {}, {}
    order = sorted(docs, key=lambda r: (-(2**63) if r[0] is None else r[0]))
    for d, t in order:
        ls = (t or "").split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if "".join(w).strip(" ") == "":
                continue
            if seen.setdefault(w, (d, i)) != (d, i):
                gone |= {i, i + 1, i + 2}
        out[d] = (None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark, data, odd, none):
    docs = docs_of(spark, data)
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == len(ODD) and {(r.doc_id, r.text) for r in rows if r.n_removed} == {(8, "other end")}
    assert line_dedup.dedup_lines(none).count() == 0


# ---- 4


def test_mixing_meets_targets(spark, data, odd, none):
    docs = docs_of(spark, data).withColumn("source", F.expr("case when doc_id % 3 = 0 then 'big' when doc_id % 20 = 1 then 'small' else 'mid' end"))
    totals = docs.groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("tokens")).cache()
    c = {r.source: r.tokens for r in totals.collect()}
    plan = {r.source: r for r in mixing.plan(totals, entropy=0.95).collect()}
    w = np.array([plan[s].weight for s in plan])
    assert w.sum() == pytest.approx(1) and -(w * np.log(w)).sum() >= 0.95 * math.log(3) - 1e-6
    a = plan["big"].exponent
    more = np.array([x ** (a + 1e-3) for x in c.values()])
    more /= more.sum()
    assert -(more * np.log(more)).sum() < 0.95 * math.log(3)
    capped = {r.source: r for r in mixing.plan(totals, entropy=1.0, repeats=2).collect()}
    assert max(r.epochs for r in capped.values()) == pytest.approx(2, rel=1e-6) and min(r.epochs for r in capped.values()) == pytest.approx(1)
    rows = mixing.mix(docs, entropy=1.0, repeats=2, ids_only=True).collect()
    uses = collections.Counter(r.doc_id for r in rows)
    assert set(uses.values()) <= {1, 2} and len(uses) == docs.count()
    spent = collections.Counter()
    longest = max(r.n_tokens for r in rows)
    for r in rows:
        spent[r.source] += r.n_tokens
    for s, r in capped.items():
        assert 0 <= spent[s] - r.epochs * c[s] + 1e-3 <= longest + 1
    half = mixing.mix(docs, budget=sum(c.values()) / 2, ids_only=True).collect()
    # a permutation's prefix: within a source, the kept documents are the first in the order of the hash
    assert len({r.doc_id for r in half}) == len(half) and sum(r.n_tokens for r in half) == pytest.approx(sum(c.values()) / 2, abs=3 * longest)
    out = mixing.mix(odd, repeats=2)
    assert out.columns == [*odd.columns, "__epoch", "__order"] and {r.doc_id for r in out.collect()} == {r[0] for r in ODD}
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("most", [5_000, 20])
def test_mixing_equals_recomputation(spark, data, most, monkeypatch):
    """The registered query's parameters: exponent, epochs, order and the last permutation's prefix, one by one."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", most)
    docs = docs_of(spark, data).withColumn("source", F.expr("case when doc_id % 3 = 0 then 'big' when doc_id % 60 = 1 then 'small' when doc_id % 7 < 4 then 'mid' end"))
    rows = {r.doc_id: (r.source, len([x for x in re.split("[ \\t\\n\\x0B\\f\\r]+", r.text or "") if x])) for r in docs.collect()}
    c = collections.Counter()
    for s, n in rows.values():
        c[s] += n

    def entropy(a):
        w = np.array([x**a for x in c.values()])
        w = w / w.sum()
        return -(w * np.log(w)).sum()

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.97 * math.log(len(c)) else (low, mid)
    a = max(low, 1 - math.log(4) / math.log(max(c.values()) / min(c.values())))
    epochs = {s: round(c[s] ** (a - 1) * max(x ** (1 - a) for x in c.values()), 6) for s in c}
    assert len(c) == 4 and max(epochs.values()) > 1.5
    hashed = {}
    for k in range(6):
        for r in docs.select("doc_id", F.xxhash64(F.lit(0), F.lit(k), F.xxhash64("doc_id", "text")).alias("h")).collect():
            hashed[r.doc_id, k] = r.h
    want = set()
    for s, e in epochs.items():
        own = [d for d in rows if rows[d][0] == s]
        want |= {(d, k) for d in own for k in range(int(e))}
        left, ran = (e - int(e)) * c[s], 0
        for d in sorted(own, key=lambda d: hashed[d, int(e)] % 2**64):  # ranges go by the unsigned hash
            if ran < left - 1e-3:
                want.add((d, int(e)))
            ran += rows[d][1]
    got = mixing.mix(docs, entropy=0.97, repeats=4, ids_only=True).collect()
    assert {(r.doc_id, r.epoch) for r in got} == want and len(got) == len(want)
    assert all(r.order == hashed[r.doc_id, r.epoch] and (r.source, r.n_tokens) == rows[r.doc_id] for r in got)


def test_mixing_by_repeats_alone(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d", "en", "big" if i < 800 else "mid" if i < 950 else "tiny", 4) for i in range(1000)], DOC)
    before = collections.Counter(r.source for r in docs.collect())
    rows = corpus_pipeline.mix_sources(spark, docs, None).collect()
    after, uses = collections.Counter(r.source for r in rows), collections.Counter(r.doc_id for r in rows)
    assert len(uses) == 1000 and max(uses.values()) == 2
    assert after["big"] == before["big"] and after["tiny"] == pytest.approx(2 * before["tiny"], abs=1) and before["mid"] < after["mid"] < 2 * before["mid"]
    share = lambda c, s: c[s] / sum(c.values())
    assert share(after, "big") < share(before, "big") - 0.03 and share(after, "tiny") > 1.5 * share(before, "tiny")
    # a limit that equal weights meet: all sources come out equal
    even = {r.source: r.epochs for r in mixing.plan(spark.createDataFrame([("a", 100), ("b", 60)], "source string, tokens long"), repeats=2).collect()}
    assert even["a"] == pytest.approx(1) and even["b"] == pytest.approx(100 / 60)


# ---- 5


def brute_capacity(sizes, k):
    def ok(c):
        n, at = 1, 0
        for x in sizes:
            if x > c:
                return False
            n, at = (n + 1, x) if at + x > c else (n, at + x)
        return n <= k

    lo, hi = 0, sum(sizes)
    while hi - lo > 1:
        m = (lo + hi) // 2
        lo, hi = (lo, m) if ok(m) else (m, hi)
    return hi


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding_is_minimax(spark, data, shards):
    docs = docs_of(spark, data)
    got = sharding.assign(docs, shards).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    groups = {}
    for d in sorted(text):
        groups[text[d]] = groups.get(text[d], 0) + len(text[d].encode()) + 16
    held, of, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        of[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16
    assert max(held.values()) == brute_capacity(list(groups.values()), shards)
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(held) <= set(range(shards))


def test_sharding_random_groups(spark):
    rng = np.random.default_rng(0)
    for n, k in ((400, 9), (30, 12), (3, 5)):
        sizes = [int(x) for x in rng.pareto(1.2, n) * 50 + 1]
        ends = spark.createDataFrame([(int(e), s) for e, s in zip(np.cumsum(sizes), sizes, strict=True)], "end long, bytes long")
        capacity, cuts = sharding.minimax_cuts(ends, k)
        assert capacity == brute_capacity(sizes, k) and max(np.diff(cuts)) <= capacity and cuts[-1] == sum(sizes) and set(cuts) <= {0, *np.cumsum(sizes).tolist()}


def test_sharding_of_texts_with_many_rows(spark, odd, monkeypatch):
    """Texts over the limit are joined by broadcast: the shards are the same."""
    docs = odd.union(odd).union(odd)
    shards = lambda: collections.Counter((r.doc_id, r.text, r.shard) for r in sharding.shard_documents(docs, 3).collect())
    want = shards()
    monkeypatch.setattr(sharding, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    assert shards() == want and sum(want.values()) == 3 * len(ODD)


def test_sharding_odd_rows(odd, none):
    rows = sharding.assign(odd, 4).collect()
    assert len(rows) == len(ODD) and {r.size for r in rows if r.doc_id in (1, 2)} == {16}
    out = sharding.shard_documents(odd, 4)
    assert out.count() == len(ODD) and out.columns.count("shard") == 1 and len({r.shard for r in out.where("doc_id in (5, 6)").collect()}) == 1
    assert sharding.assign(none, 4).count() == 0 and sharding.shard_documents(none, 4).count() == 0


# ---- 6


def brute_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def brute_llr(train, n=urls.ORDER):
    counts = {v: [collections.defaultdict(collections.Counter) for _ in range(n + 1)] for v in ("allow", "block")}
    for url, v in train:
        s = urls.START * n + lower(url) + urls.END
        for i in range(n, len(s)):
            for k in range(n + 1):
                counts[v][k][s[i - k : i]][s[i]] += 1

    def p(v, s, i):
        out = 1 / urls.SYMBOLS
        for k in range(n + 1):
            c = counts[v][k].get(s[i - k : i], {})
            total, t = sum(c.values()), len(c)
            if total:
                out = (c.get(s[i], 0) + t * out) / (total + t)
        return out

    def score(url):
        s = urls.START * n + lower(url or "") + urls.END
        return float(np.mean([math.log(p("allow", s, i)) - math.log(p("block", s, i)) for i in range(n, len(s))]))

    return score


def test_urls_equal_brute_force(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    extra = [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "HTTP://WWW.Example.COM/en/x?y"), (-5, "http://net"), (-6, "x://a.net/es/://q"), (-4, "HTTP://WWW.Example.COM/en/x?y"), (-7, "http://ü.org/\U0001f600"), (None, "http://a.org/b")]
    pages = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string")).cache()
    held = {r.url for r in pages.where(urls._held_out()).collect()}
    rows = [(r.page_id, r.url, *brute_rule(r.url)) for r in pages.collect()]
    score = brute_llr([(u, v) for _, u, _, _, _, v in rows if v and u not in held])
    got = urls.judge(pages).collect()
    at = got[0].threshold
    want = collections.Counter((i, h, p, r, v or ("allow" if score(u) >= at else "block")) for i, u, h, p, r, v in rows)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert sorted(r.score for r in got) == pytest.approx(sorted(score(u) for _, u, *_ in rows), abs=2e-6)


def test_urls_held_out(spark):
    s = urls.scored(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).cache()
    at = urls.threshold(s)
    held = [(r.score >= at, r.ruled == "allow") for r in s.where(urls._held_out()).collect() if r.ruled]
    print(np.mean([a == b for a, b in held]))
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.85


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/b"), (2, None)], "page_id long, url string").withColumn("gram", F.lit("x"))
    assert {(r.page_id, r.rule, r.threshold) for r in urls.judge(pages).collect()} == {(1, None, 0.0), (2, None, 0.0)}
    assert urls.judge(pages.where("page_id > 5")).count() == 0


# ---- 7


@pytest.mark.parametrize("n", [0, 1, 10, 700, 4800, 48_000])
def test_codecs_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (bytes(n), rng.integers(0, 256, n, np.uint8).tobytes(), rng.integers(97, 100, n, np.uint8).tobytes(), (b"abcabcabd" * n)[: 40 * n]):
        for kind in tiff.ENCODE:
            for width in {1, 96, 200} if len(data) % 9600 == 0 else {1}:
                part = np.frombuffer(data, np.uint8).reshape(-1, width)
                assert tiff.DECODE[kind](tiff.ENCODE[kind](part)) == data


def test_known_codes():
    # examples of the format's specification
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))
    assert tiff.lzw_decode(codes) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    bits = "".join(f"{b:08b}" for b in codes)
    assert [int(bits[i : i + 9], 2) for i in range(0, 81, 9)] == [256, 7, 258, 8, 8, 258, 6, 6, 257]


def test_big_endian_and_colour_tiles():
    import struct

    px = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    data = px.tobytes()
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 8), (259, 3, 1), (262, 3, 2), (273, 4, 8), (277, 3, 3), (278, 3, 2), (279, 4, len(data))]
    body = b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + struct.pack(">H", len(tags))
    for tag, kind, v in tags:
        body += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", v, 0) if kind == 3 else struct.pack(">I", v))
    page = next(tiff.read_pages(body + b"\0\0\0\0"))
    assert page["pixels"] == data and page["samples"] == 3


def test_tiff_query_reads_back(spark, data, odd, none):
    for frame in (docs_of(spark, data), odd):
        got = tiff.digest_pages(tiff.tiff_pages(tiff.to_tiff(frame))).collect()
        want = collections.Counter()
        for r in frame.collect():
            b = (r.text or "").encode()
            p = b.ljust(max(576, -(-len(b) // 576) * 576), b"\xff")
            want[r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
        assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        by = collections.defaultdict(set)
        for r in got:
            by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
        assert all(len(x) == 1 for x in by.values())
    assert tiff.to_tiff(none).count() == 0
    broken = spark.createDataFrame([(1, 0, b"II*\0junk"), (2, 0, None), (3, 0, b"II*\0\0\0\0\0")], "doc_id long, n_bytes long, media binary")
    assert {(r.doc_id, r.page) for r in tiff.tiff_pages(broken).collect()} == {(1, -1), (2, -1), (3, -1)}
    assert tiff.digest_pages(tiff.tiff_pages(broken)).count() == 3


def test_every_codec_meets_texts_of_every_length():
    rng, met = np.random.default_rng(5), collections.defaultdict(set)
    for blocks in (1, 2, 3, 40, 200):
        for _ in range(80):
            payload = rng.integers(97, 110, 576 * blocks, np.uint8).tobytes()
            pages = list(tiff.read_pages(tiff.write_tiff(payload)))
            assert b"".join(p["pixels"] for p in pages) == payload and len(pages) == -(-576 * blocks // (96 * 192))
            met[blocks].add((pages[0]["compression"], pages[0]["predictor"], pages[0]["tiled"]))
    full = {(c, p, t) for c in (5, 8, 32773) for p in (1, 2) for t in (False, True) if c != 32773 or p == 1}
    assert all(kinds == full for kinds in met.values())


# ---- 8


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = queries.labels_of(spark, "/root/testdata/sf0.1")
    train, test = labels.where("doc_id % 3 > 0"), {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, train, queries.CATEGORIES).collect()}
    assert len(got) == docs.count()
    right = [got[d].toxic == t for d, t in test.items() if d in got]
    found = [got[d].toxic for d, t in test.items() if d in got and t]
    assert np.mean(right) > 0.98 and np.mean(found) > 0.9


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    y = np.stack([rng.integers(0, 2, 400)] * 2, 1)
    rows = [np.array(sorted({10 + int(a), *rng.integers(100, 200, 5).tolist()}), np.int32) for a in y[:, 0]]
    chain = toxicity.Chain(rows, y, np.arange(400) % toxicity.FOLDS)
    assert chain.links[1].w.shape == (toxicity.KEPT + 1,) or len(chain.links[1].w) == len(chain.links[1].at) + 1
    assert chain.links[1].w[-1] > 0 and chain.out_of_fold.shape == (400, 2)
    assert np.mean([(chain(r)[1] >= chain.cuts[1]) == bool(t) for r, t in zip(rows, y[:, 1], strict=True)]) > 0.99


def test_chain_equals_its_definition(spark, data):
    """Out-of-fold inputs, the links fitted on them and the scores of the query, each recomputed link by link."""
    docs, labels = docs_of(spark, data), queries.labels_of(spark, data)
    chain = toxicity.fit(docs, labels, queries.CATEGORIES)
    text = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: (r.low_quality, r.toxic) for r in labels.collect() if r.doc_id in text}
    ids = sorted(y)
    rows, folds = [toxicity.features(text[i]) for i in ids], np.array([zlib.crc32(str(i).encode()) % toxicity.FOLDS for i in ids])
    earlier = np.zeros((len(ids), 0))
    for c in range(2):
        out, target = np.zeros(len(ids)), np.array([y[i][c] for i in ids])
        for f in range(toxicity.FOLDS):
            train = [i for i in range(len(ids)) if folds[i] != f]
            link = toxicity.Link([rows[i] for i in train], earlier[train], target[train])
            out[folds == f] = [link(rows[i], earlier[i]) for i in np.flatnonzero(folds == f)]
        assert chain.out_of_fold[:, c] == pytest.approx(out, abs=1e-5)
        whole = toxicity.Link(rows, earlier, target)
        assert chain.links[c].at.tolist() == whole.at.tolist() and chain.links[c].w == pytest.approx(whole.w, abs=1e-4)
        earlier = np.hstack([earlier, chain.out_of_fold[:, c : c + 1]])

    def by_hand(t):
        found, p = set(toxicity.features(t).tolist()), []
        for link in chain.links:
            k = len(link.at)
            if not len(link.w):
                p.append(link.rate)
                continue
            z = link.b + sum(w for a, w in zip(link.at, link.w, strict=False) if a in found) + sum(w * q for w, q in zip(link.w[k:], p, strict=True))
            p.append(1 / (1 + math.exp(-z)))
        return p

    for r in toxicity.score(docs, labels, queries.CATEGORIES).collect():
        p = by_hand(text[r.doc_id])
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(p, abs=1e-4) and r.toxic == (p[1] >= chain.cuts[1])


def test_toxicity_sample(spark):
    """Labels of absent documents take no place in the sample; of rows that share an id one is fixed by its text's hash."""
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} text {i}") for i in range(40)] + [(3, "another text of this id")] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(1000 + i, 0, 1) for i in range(500)], "doc_id long, low_quality int, toxic int")
    chains = [toxicity.fit(d, labels, queries.CATEGORIES, max_rows=30) for d in (docs, docs.orderBy(F.desc("doc_id"), "text"))]
    assert len(chains[0].out_of_fold) == 30 and chains[0].links[1].w.tolist() == chains[1].links[1].w.tolist()


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 1), (5, 0, 0), (77, 1, 1), (8, None, 1), (None, 1, 1)], "doc_id long, low_quality int, toxic int")
    assert toxicity.score(odd, labels, queries.CATEGORIES).count() == len(ODD) and toxicity.score(none, labels, queries.CATEGORIES).count() == 0
    blind = toxicity.score(odd, labels.where("doc_id < 0"), queries.CATEGORIES).collect()
    assert {r.toxic for r in blind} == {0} and len(blind) == len(ODD)
    kept = toxicity.reject(odd, labels.where("doc_id < 0"), queries.CATEGORIES)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


# ---- 9


def brute_components(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    inverted, parent = collections.defaultdict(list), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = collections.Counter(o for x in s for o in inverted[x])
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(seed, members, length, edits):
    rng = np.random.default_rng(seed)
    base = [f"b{seed}x{i}" for i in range(length)]
    out = []
    for m in range(members):
        w = list(base)
        for i in rng.choice(length, int(rng.integers(0, edits + 1)), replace=False):
            w[i] = f"e{m}x{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent", "leaf", "hot"), [(4, 85, 256, 5_000), (5, 80, 12, 20)])
def test_jaccard_equals_brute_force(spark, data, k, percent, leaf, hot, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    texts = [t for s, (m, n, e) in enumerate([(60, 120, 9), (40, 300, 25), (30, 30, 4), (25, 9, 2), (20, 6, 1), (50, 60, 6)]) for t in family(s, m, n, e)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{j}x{i}" for i in range(10 + j)) for j in range(30)]
    extra = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(texts + texts[::7])], "doc_id long, text string")
    docs = docs_of(spark, data).select("doc_id", "text").unionByName(extra)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.Join(k, percent).classes(docs).collect()}
    assert got == want and sum(d != c for d, (_, c) in want.items()) > 50


@pytest.mark.parametrize("percent", [85, 80, 51])
def test_jaccard_cells_lose_no_link(percent):
    """Sets at the threshold share a cell, whatever differs; small sets and such with few filled runs too."""
    join, rng, met = jaccard.Join(4, percent), np.random.default_rng(0), 0
    draw = lambda n, narrow: np.unique(rng.integers(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2) >> np.uint64(20 * narrow))
    for n in (1, 2, 3, 7, 12, 40, 127, 128, 333):
        for trial in range(60):
            a = draw(n, trial % 3 == 0)
            out = int(rng.integers(0, n // 3 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[out:], draw(int(rng.integers(0, n // 3 + 1)), trial % 3 == 0)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            cells, number = join.cells([a, b])
            met += 1
            assert np.intersect1d(cells[: number[0]], cells[number[0] :]).size
    assert met > 100


def test_shingle_sets_of_arrow_columns():
    """Words and sets as a plain split makes them, in pieces, slices, with nulls and with words beyond the table."""
    import pyarrow as pa

    texts = [None, "", " \t\x0b", "a", "A b\nc", "x" * 300 + " y Z", "x" * 299 + "z y z", "é Ü\u00a0ß end of line", "one two three four five one two three four five", "o" * 40 + " p q r"] * 3
    column = pa.array(["skip me please now", *texts], pa.string()).slice(1)
    for chunk in (1 << 20, 7):
        jaccard.CHUNK, held = chunk, jaccard.CHUNK
        try:
            raw, at = jaccard._texts(column)
            got = jaccard.shingle_sets(raw[at[0] : at[-1]], at[1:] - at[0], 4)
        finally:
            jaccard.CHUNK = held
        split = [lower(t).encode().split() for t in texts]
        want = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set() for w in split]
        assert [len(s) for s in got] == [len(s) for s in want]
        names = {}
        for s, w in zip(got, want, strict=True):
            assert names.setdefault(s.tobytes(), w) == w
        assert len(names) == len({frozenset(w) for w in want})


@pytest.mark.parametrize("members", [10, 90])
def test_tree_pairs_lose_no_link(members):
    """What bounds of nodes and points leave open holds every link between labels; far points are dropped."""
    join, rng = jaccard.Join(4, 85), np.random.default_rng(members)
    bases = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.permutation(bases[i % 6])[: int(rng.integers(150, 200))], rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)])) for i in range(members)]
    point = np.stack([np.frombuffer(jaccard.pack_point(s), np.uint8).astype(np.int32) for s in sets])
    leaf = {"id": np.arange(members), "label": np.arange(members) % 7, "n": np.array([len(s) for s in sets]), "point": point}
    other = {c: v[: members // 2] for c, v in leaf.items()}
    links = {(i, j) for i in range(members) for j in range(i) if i % 7 != j % 7 and join.enough(n := len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j]))}
    for y in (leaf, other):
        got = {(max(i, j), min(i, j)) for i, j in zip(*(v.tolist() for v in join.open_pairs(leaf, y)), strict=True)}
        assert got >= {p for p in links if p[1] < len(y["id"])} and len(got) < members * members / 8
    assert members < 20 or len(links) > 20
    assert sorted(np.concatenate(jaccard.pack_nodes(leaf["n"], point)).tolist()) == list(range(members))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.id: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_jaccard_odd_rows(odd, none):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.Join(4, 85).classes(odd).collect())
    assert got[5, 4997, 5] == 2 and got[6, 4997, 5] == 1 and got[1, 0, 1] == got[2, 0, 2] == got[3, 0, 3] == 1 and got[4, 1, 4] == 1 and sum(got.values()) == len(ODD)
    assert jaccard.Join().classes(none).count() == 0
    kept = jaccard.Join().one_of_each(odd)
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id in (5, 6))) == [5] and kept.columns == odd.columns


def test_one_of_each_with_shared_and_null_ids(spark):
    near = " ".join(f"n{i}" for i in range(100))
    rows = [
        (None, "some first text of its own"), (None, "a second one that is not like it"), (None, "third words stand here all alone"), (7, "clean words under a shared id"), (7, "unrelated words with the same id too"),
        (7, near + " tail"), (3, near), (8, near + " other"), (8, "eighth text linked with nothing else here"), (None, near + " more"), (9, "Twice  the same"), (9, "twice the same"), (10, "again and again"), (10, "again and again"),
        (None, "null id near a null id " + near[:60]), (None, "null id near a NULL id " + near[:60]), (10, ""), (10, ""), (None, None), (7, " "),
    ]
    kept = [(r.doc_id, lower(r.text).split()) for r in jaccard.Join(5, 80).one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    gone = {5, 7, 9, 11, 13, 15}
    want = [(d, lower(t).split()) for i, (d, t) in enumerate(rows) if i not in gone]
    assert sorted(kept, key=str) == sorted(want, key=str)


# ---- 10


def test_warc_round_trip(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    extra = [(9001, "u\nv", "x" * 100), (9000, None, "x" * 100), (9002, "w", "x" * 99), (9003, "w", "x" * 99), (9004, "w", None), (9005, "w", ""), (9006, "é", "ü" * 60), (9007, "é", "ü" * 60), (9007, "é", "ü" * 60), (None, "n", "ü" * 60)]
    pages = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string, html string")).cache()
    first = {}
    for r in pages.collect():
        b = (r.html or "").encode()
        if r.page_id is not None and len(b) >= 100:
            first[b] = min(first.get(b, r.page_id), r.page_id)
    want = collections.Counter()
    for r in pages.collect():
        b = (r.html or "").encode()
        to = first.get(b)
        to = None if to == r.page_id else to
        want[r.page_id, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to] += 1
    bundles = warc.write_bundles(pages)
    assert collections.Counter(map(tuple, warc.read_records(bundles).collect())) == want
    index = warc.record_index(bundles).collect()
    content = {r.bundle: r.content for r in bundles.collect()}
    import zstandard

    for r in index[::7]:  # one record through the footer alone
        start, c, d = warc.frame_starts(content[r.bundle])[r.frame]
        plain = zstandard.ZstdDecompressor().decompress(content[r.bundle][start : start + c], max_output_size=d)
        headers, _ = warc.parse(plain, r.offset)
        assert headers["WARC-Record-ID"] == f"<urn:page:{'' if r.page_id is None else r.page_id}>"
    whole = zstandard.ZstdDecompressor().stream_reader(next(iter(content.values())), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n")
    assert warc.read_records(warc.write_bundles(pages.where("page_id < -5"))).count() == 0


# ---- SQL and pipeline


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(name, same):
    same(queries.queries()[name], oracles.SQL[name])


def test_pipeline_stages(spark, data):
    docs = docs_of(spark, data)
    names = docs.columns
    step = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = step
        step = corpus_pipeline.cut(stage(spark, step, data))
        seen[name] = (before, step)
        assert name == "sharding" or step.columns == names
    before, after = seen["near_duplicates"]
    want = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    before, after = seen["decontamination"]
    bad = {x[0] for x in brute_leaks([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()])}
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in bad)
    before, after = seen["mixing"]
    uses = collections.Counter(r.doc_id for r in after.collect())
    assert set(uses) == {r.doc_id for r in before.collect()} and max(uses.values()) == 2
    share = lambda d: max((x := collections.Counter(r.source for r in d.collect())).values()) / sum(x.values())
    assert share(after) < share(before)
    final = seen["sharding"][1].collect()
    assert len(final) == sum(uses.values()) and all(0 <= r.shard < 40 for r in final)
    of = collections.defaultdict(set)
    for r in final:
        of[r.text].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_pipeline_odd_rows(spark, odd, none, data):
    """Null ids, repeated rows and columns that clash with inner names pass all stages with their values."""
    frame = odd.drop("row").withColumns({c: F.concat(F.lit("own "), F.col("lang")) for c in ("row", "key", "__row", "__doc", "__p", "__bad", "__as", "__fate", "__key", "__hot", "__d", "__r", "__s")})
    for docs in (frame, frame.where("doc_id < 0")):
        step, ids = docs, []
        for name, stage in corpus_pipeline.STAGES:
            step = corpus_pipeline.cut(stage(spark, step, data))
            assert set(step.columns) == set(frame.columns) and (name == "sharding" or step.columns == frame.columns)
            ids.append(collections.Counter(r.doc_id for r in step.collect()))
            assert step.where("__doc <> concat('own ', lang) or __row <> concat('own ', lang) or h <> 1").count() == 0
        if not docs.count():
            assert not any(ids)
            continue
        assert ids[0] == collections.Counter(r[0] for r in ODD)
        assert ids[1] == collections.Counter([1, 2, 3, 4, 5, None, 8, 9]) == ids[2]
        assert set(ids[3]) == set(ids[2]) and ids[4] == ids[3]
