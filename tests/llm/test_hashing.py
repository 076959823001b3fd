"""Operators 2, 8, 9 and 10 against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import common, exactdedup, linkgraph, mixing, simhash

DOCS = "doc_id long, text string, source string, lang string, size long, key string"


def make_docs(spark, rows):
    return spark.createDataFrame([(d, t, s, "en", -1, "clash") for d, t, s in rows], DOCS)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "IN", " "]
    rows = [(None, None, None), (None, "", "a"), (1000, "", None), (1001, "ABC É", "b"), (1002, "abc É", "b"), (1003, "abc é", "b"), (1003, "abc é", "b"), (1004, "one two", "c")]
    base = [rng.choice(words) for _ in range(2000)]
    for i in range(n):
        text = base[:]
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        cut = rng.choice([20, 60, 2000])
        rows.append((i, " ".join(text[:cut]), rng.choice(["a", "a", "a", "b", "c", "é", None])))
    rows.append((2000, "x" * 300_000 + " y" * 50_000, "long"))
    return rows


def test_exact_groups_match_brute_force(spark):
    rows = corpus()
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(norm(t), []).append(d)
    want = []
    for d, t, _ in rows:
        ids = groups[norm(t)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exactdedup.exact_groups(make_docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_groups_come_from_the_index(spark, monkeypatch):
    copies = make_docs(spark, [(i, "same text", "a") for i in range(60)] + [(100, "Same text", "b"), (101, "other", "b")])
    (got,) = {(r.keep_id, r.group_size) for r in exactdedup.exact_groups(copies).where("doc_id < 100").collect()}
    assert got == (100, 61)
    # entries hold some of a text's rows each: without the owners' chains no group is whole
    real = exactdedup.build_index
    seen = []

    def spy(entries, folder, capacity):
        seen.append(max(r["group_size"] for r in entries.collect()))
        return real(entries, folder, capacity)

    monkeypatch.setattr(exactdedup, "build_index", spy)
    exactdedup.exact_groups(copies).collect()
    assert seen and max(seen) < 61
    monkeypatch.setattr(exactdedup, "build_index", lambda entries, folder, capacity: entries)
    with pytest.raises(Exception):
        exactdedup.exact_groups(copies).collect()


def test_index_splits_overfull_buckets(spark, tmp_path):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"), F.col("id").alias("keep_id"), F.lit(1).alias("group_size"), F.lit(None).cast("string").alias("part"))
    collided = keys.limit(3).withColumn("key", F.lit(7).cast("long")).withColumn("text_sha256", F.concat(F.lit("z"), "text_sha256"))
    index = exactdedup.build_index(keys.unionByName(collided), f"file://{tmp_path}/index", capacity=300)
    assert index.count() == 5003
    sizes = index.groupBy("bucket", "depth").count().collect()
    assert max(r["count"] for r in sizes) <= 300 and len(sizes) >= 16
    assert sorted(r["chain"] for r in index.where("key = 7").collect()) == [1, 2, 3]
    for r in sizes:  # a bucket starts where its prefix does
        assert r["bucket"] % (1 << (64 - r["depth"])) == 0


def test_directory_doubles_as_far_as_keys_differ(spark, tmp_path):
    # the first 40 bits are equal, so only deeper levels can part them
    keys = spark.range(600).select((F.lit(5 << 40) + F.col("id") * 1000).alias("key"), F.col("id").cast("string").alias("text_sha256"), F.col("id").alias("keep_id"), F.lit(1).alias("group_size"), F.lit(None).cast("string").alias("part"))
    index = exactdedup.build_index(keys, f"file://{tmp_path}/deep", capacity=20)
    sizes = index.groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in sizes) == 600 and max(r["count"] for r in sizes) <= 20 and min(r["depth"] for r in sizes) > 40


def test_bytes_decide_where_keys_and_digests_collide(spark):
    rows = corpus(300)
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_groups(make_docs(spark, rows)).collect()}
    one_key = exactdedup.exact_groups(make_docs(spark, rows), key=lambda t: F.lit(7).cast("long"), capacity=10)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in one_key.collect()} == want
    one_digest = exactdedup.exact_groups(make_docs(spark, rows), key=lambda t: F.length(t).cast("long"), digest=lambda t: F.lit("same"))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in one_digest.collect()]
    assert set(got) == want and len(got) == len(rows)


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    rows = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    found = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = common.lookup(rows, found, ["k"], "n")
    assert sorted((r.id, r.k, r.n) for r in got.collect()) == sorted((r.id, r.k, r.n) for r in rows.join(found, "k").collect())


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rows = corpus(2, 200)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(fps)
    least = {}
    for (d, _, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted(((d, f"{f:016x}", least.get(r)) for (d, _, _), f, r in zip(rows, fps, roots)), key=str)
    found = simhash.near_duplicates(make_docs(spark, rows))
    got = sorted(((r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in found.collect()), key=str)
    assert got == want
    assert len({w[2] for w in want}) < len(rows) - 5


def test_golay_search_finds_every_pair_also_under_hot_keys(spark, monkeypatch):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        center = rng.getrandbits(64)
        fps |= {center} | {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(30)}
    fps = sorted(fps)
    want = {(min(s(a), s(b)), max(s(a), s(b))) for s in [lambda x: x - 2**64 if x >= 2**63 else x] for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2}
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    for hot in (256, 2):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = [(r["a"], r["b"]) for r in simhash.links(table).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 130)}


def test_empty_tables(spark):
    empty = make_docs(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert exactdedup.exact_groups(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert linkgraph.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return share | fixed
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_reaches_targets(spark):
    rows = corpus(4)
    got = mixing.mix(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size_of = {}
    for d, t, s in rows:
        size_of[s] = size_of.get(s, 0) + len((t or "").encode().split())
    want = brute_targets(size_of)
    by_id = {d: s for d, _, s in rows if d is not None}
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            s = by_id[r["doc_id"]]
            taken[s] = taken.get(s, 0) + r["taken"]
            assert r["source_size"] == size_of[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(4, 0.01 * want[s])
    again = mixing.mix(make_docs(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_taken_words_equal_blocks_selected_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1 << 40)  # a source is one shard
    rng = random.Random(11)
    rows = [(i, " ".join("w" * rng.randrange(0, 90)), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(160)] + [(500, None, "e"), (501, "x", "f")]
    df = make_docs(spark, rows)
    block = mixing.BLOCK_WORDS
    place = {r.doc_id: r for r in df.select("doc_id", mixing._order(mixing.SEED).alias("o"), F.xxhash64(F.lit(mixing.SEED), mixing._key(), F.lit(0).cast("long")).alias("h")).collect()}
    size = {d: len((t or "").split()) for d, t, _ in rows}
    sizes = {}
    for d, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[d]
    goals, quota = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for _ in range(sum(sizes.values()) // block):
        top = max(goals, key=lambda s: goals[s] / (2 * quota[s] + 1))
        quota[top] += 1
    want = {}
    for s in sizes:
        own = sorted((d for d, _, x in rows if x == s), key=lambda d: (place[d].o, d))
        line = [d for d in own for _ in range(size[d])]
        if not line:
            want |= dict.fromkeys(own, 0)
            continue
        words = min(quota[s] * block, 3 * len(line))
        blocks = [line[i : i + block] for i in range(0, len(line), block)]
        n, r = len(blocks), min(len(blocks), int(words % len(line) / block + 0.5))
        start = place[own[0]].h % n
        taken = {d: words // len(line) * size[d] for d in own}
        for b, held in enumerate(blocks):
            if ((b + 1) * r + start) // n > (b * r + start) // n:
                for d in held:
                    taken[d] += 1
        want |= taken
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == want


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(5)
    rows = [(g, f"u{i:03d}", float(rng.choice([0, 1, 3, 3, 7, 50, 1000 * rng.random()])), seats) for g, (n, seats) in enumerate([(1, 5), (7, 100), (40, 13), (60, 1000), (5, 0)]) for i in range(n)]
    got = {(r["g"], r["u"]): r["quota"] for r in mixing.apportion(spark.createDataFrame(rows, "g int, u string, share double, seats long"), ["g"], ["u"], "share", "seats").collect()}
    for g in range(5):
        units = [(u, w) for h, u, w, _ in rows if h == g]
        seats = next(r[3] for r in rows if r[0] == g)
        quotients = sorted((w / (2 * k - 1) for _, w in units for k in range(1, seats + 1) if w > 0), reverse=True)
        assert sum(got[g, u] for u, _ in units) == seats
        if seats:
            edge = quotients[seats - 1]
            for u, w in units:
                sure = sum(w / (2 * k - 1) > edge for k in range(1, seats + 1))
                most = sum(w / (2 * k - 1) >= edge for k in range(1, seats + 1)) if w else 0
                assert sure <= got[g, u] <= most


def test_rules_and_link_graph(spark):
    link = '<a href="http://{}/x">'
    rows = [
        (1, "HTTP://A.Example.COM/en/7?q=1", link.format("b.org")),
        (2, "http://a.example.com/en/8#f", None),
        (3, "https://net/de/1", link.format("c.org") * 3),
        (4, "http://example.net/de/81", ""),
        (5, "nothing", "x"),
        (6, None, None),
        (7, "http://b.org/fr/", link.format("bad.org")),
        (8, "http://bad.org/es/1?x", ""),
        (9, "http://c.org", ""),
        (9, "http://c.org", ""),
        (10, "http://notexample.com/en/7", ""),
    ]
    got = sorted(map(tuple, linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == [
        (1, "a.example.com", "/en/7", "example.com/en/7", "allow"),
        (2, "a.example.com", "/en/8", "com/en/", "block"),
        (3, "net", "/de/1", "net/de/", "allow"),
        (4, "example.net", "/de/81", "example.net/de/8", "block"),
        (5, "", "", None, "allow"),
        (6, "", "", None, "allow"),
        (7, "b.org", "/fr/", None, "block"),
        (8, "bad.org", "/es/1", "org/es/", "block"),
        (9, "c.org", "", None, "allow"),
        (9, "c.org", "", None, "allow"),
        (10, "notexample.com", "/en/7", "com/en/", "block"),
    ]
