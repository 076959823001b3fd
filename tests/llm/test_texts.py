"""Operators 1, 3, 4, 5, 6 and 7: brute force, round trips and held-out accuracy on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, language, pii, quality, tokenfile, warc

DOCS = "doc_id long, text string, lang string, source string, score double, c0 string, t string"


def make_docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 0.5, "x", "y") for d, t, lang in rows], DOCS)


def edge_rows():
    return [(None, None, None), (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "same", "en"), (4, "same", "en"), (5, "x" * 200_000 + " word" * 200_000, "en"), (6, "12 34 !!", "de"), (7, "É漢字 ok", "fr")]


# 1: WARC


def pages(spark, n=250):
    rows = [(i, f"http://h{i % 7}.org/{i}", "<p>" + "word " * (i % 60) + "</p>") for i in range(n)] + [(None, None, None), (None, "u", None), (3, "http://twice.org", "x"), (3, "http://twice.org", "x"), (n, "http://long.org", "y" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("file", F.lit("clash"))


def test_audit_finds_all_damage_and_nothing_else(spark):
    good = warc.layout(pages(spark), 40).cache()
    assert warc.audit(good, good.select("file", "offset", "length", "digest", "record_id")).count() == 0
    bad = good.where("NOT page_id <=> 17").withColumn("digest", F.when(F.expr("page_id IN (5, 200)"), "spoiled").otherwise(F.col("digest")))
    extra = spark.createDataFrame([(0, 999_999, 5, "new", None)], "file long, offset long, length long, digest string, record_id string")
    found = warc.audit(good, bad.select(*extra.columns).unionByName(extra)).select("file", "offset", "status").join(good, ["file", "offset"], "left").select("page_id", "status")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(17, "missing"), (5, "changed"), (200, "changed"), (None, "extra")], key=str)
    assert warc.audit(good, good.limit(0)).where("status = 'missing'").count() == good.count()


def test_empty_replicas_agree(spark):
    empty = warc.layout(pages(spark).limit(0))
    assert warc.audit(empty, empty).count() == 0


def test_files_hold_the_layout(spark, tmp_path):
    source = pages(spark)
    files = warc.write_warc(source, f"file://{tmp_path}/warc", 40)
    got = warc.read_warc(files).select("file", "offset", "length", "digest")
    want = warc.layout(source, 40).select("file", "offset", "length", "digest")
    assert sorted(got.collect()) == sorted(want.collect())
    path = next(r.path for r in files.collect() if r.file == 0).removeprefix("file://")
    data = open(path, "rb").read()
    # one gzip member for each record, each of which can be fetched alone
    packed = warc.write_warc(source, f"file://{tmp_path}/packed", 40, compress=True)
    again = warc.read_warc(packed)
    assert sorted(again.select(*got.columns).collect()) == sorted(want.collect())
    with open(packed.where("file = 0").first().path.removeprefix("file://"), "rb") as file:
        for r in again.where("file = 0").collect():
            assert warc.fetch(file, r.member) == data[r.offset : r.offset + r.length]
    broken = data.replace(b"word", b"w0rd", 1)
    differ = [a[:2] for a, b in zip(warc.parse_warc(io.BytesIO(data)), warc.parse_warc(io.BytesIO(broken))) if a != b]
    assert len(differ) == 1


def test_damaged_bytes_are_found_where_they_are(spark, tmp_path):
    source = pages(spark).where("page_id < 80 AND page_id <> 3")
    replicas = [warc.write_warc(source, f"file://{tmp_path}/{name}", 40, compress=zipped) for name, zipped in (("plain", False), ("bad", False), ("packed", True), ("badly", True))]
    plain, bad, packed, badly = ({r.file: r.path.removeprefix("file://") for r in x.collect()} for x in replicas)
    records = {int(r[3][10:-1]): r for r in warc.parse_warc(open(plain[0], "rb"))}
    cut = lambda raw, r, a, b, new=b"": raw[: r[0] + a] + new + raw[r[0] + b :]
    raw = open(bad[0], "rb").read()
    raw = cut(raw, records[30], 0, 4, b"XXXX")  # header
    raw = cut(raw, records[25], 180, 190)  # bytes of a body lost
    raw = cut(raw, records[20], 0, records[20][1])  # a record lost
    raw = raw.replace(b"Content-Length: " + str(5 * 10 + 7).encode(), b"Content-Length: 999999", 1)  # page 10
    open(bad[0], "wb").write(raw)
    found = {(r.record_id, r.status) for r in warc.audit(warc.read_warc(replicas[0]), warc.read_warc(replicas[1])).collect()}
    page = lambda k: f"<urn:page:{k}>"
    want = {(page(10), "changed"), (page(20), "missing"), (page(25), "changed"), (page(30), "missing"), (None, "extra")} | {(page(k), "moved") for k in range(11, 40) if k not in (20, 25, 30)}
    assert found == want
    raw = bytearray(open(badly[1], "rb").read())
    members = {int(r[3][10:-1]): r for r in warc.parse_members(open(packed[1], "rb"))}
    for k in range(12):
        raw[members[50][5] + 10 + k] ^= 0xFF
    open(badly[1], "wb").write(raw)
    found = warc.audit(warc.read_warc(replicas[2]), warc.read_warc(replicas[3])).collect()
    assert {r.record_id for r in found if r.status in ("missing", "changed")} == {page(50)} and {r.record_id for r in found if r.status == "moved"} == {page(k) for k in range(51, 80)}
    # records and stretches longer than what is read at once
    long = warc.record(1, "u", "z" * (3 * warc.PIECE))
    assert [r[1] for r in warc.parse_warc(io.BytesIO(long + long))] == [len(long)] * 2
    assert [r[1] for r in warc.parse_warc(io.BytesIO(b"junk" * warc.PIECE + long))] == [4 * warc.PIECE, len(long)]


# 3: token files


def test_tokens_equal_the_library_and_files_read_back(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert model.encode("x<|endoftext|>y", add_special_tokens=False).ids == [87, 50256, 88]
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "É", "\x1c", "'s", "12", "!", "<|endoftext|>", "漢", " ", "word"]
    rows = edge_rows() + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(30))), "en") for i in range(300)]
    docs = make_docs(spark, rows)
    manifest = tokenfile.write_tokens(docs, f"file://{tmp_path}/ids", shards=3).cache()
    got = tokenfile.read_digests(manifest).orderBy("start").collect()
    want = {}
    for d, t, _ in rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        want.setdefault(d, []).append((len(ids) // 4, zlib.crc32(ids)))
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id] and r.start == at
        at += r.n_tokens
    # one document alone needs its own frame only, and any zstd tool reads the file
    import zstandard

    shard = manifest.orderBy("shard").first()
    with tokenfile.open_shard(shard.path) as file:
        reader = tokenfile.ShardReader(file)
        ids = [reader.ids(k) for k in range(len(reader.docs))]
        file.seek(0)
        assert zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True).read() == b"".join(ids)
    data = bytearray(open(shard.path.removeprefix("file://"), "rb").read())
    data[reader.frames[0][0] + reader.frames[0][1] // 2] ^= 1
    with pytest.raises(Exception):
        tokenfile.ShardReader(io.BytesIO(bytes(data))).ids(0)
    assert tokenfile.token_digests(docs.limit(0)).count() == 0


# 4 and 5: learned operators


def labelled(spark, n=900):
    rng = random.Random(2)
    vocab = {"en": "the of and with this that water house".split(), "de": "der die und nicht wasser haus über".split(), "fr": "le la et avec eau maison été".split(), "es": "el los y con agua casa niño".split()}
    rows, marks = [], []
    for i in range(n):
        lang = ("en", "de", "fr", "es")[i % 4]
        words = [rng.choice(vocab[lang]) for _ in range(rng.randrange(5, 80))]
        good = i % 5 != 0
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper() + "!!", lang))
        marks.append((i, int(good)))
    return make_docs(spark, rows + edge_rows()), spark.createDataFrame(marks + [(0, 0), (None, 1), (10**9, None)], "doc_id long, quality int")


def test_language_by_held_out_rows(spark):
    docs, _ = labelled(spark)
    model = language.fit(docs)
    got = language.identify(docs, model, carry=("doc_id", "lang", "text")).collect()
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id >= 10]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.99
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    again = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs.repartition(5), model).collect()}
    assert {(a, b, round(c, 6)) for a, b, c in again} == {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in got}
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR text = ''").count() == 0
    nothing = language.fit(docs.where("lang = 'xx'"))
    assert nothing is None and {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_quality_by_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect() if r.doc_id is not None}
    held = [i for i in range(1, 900) if zlib.crc32(str(i).encode()) % 3 == 1 and i >= 10]
    assert np.mean([(got[i] >= 0.5) == (i % 5 != 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(7), model).collect() if r.doc_id is not None}
    assert all(abs(again[i] - got[i]) < 1e-6 for i in got if i >= 10)
    assert quality.fit(docs, labels.where("quality = 1")) == 1.0 and quality.fit(docs.limit(0), labels.limit(0)) == 0.5


def test_learned_operators_take_clashing_columns_and_empty_tables(spark):
    docs, marks = labelled(spark, 120)
    more = docs.withColumns({c: F.lit("clash") for c in ("quality", "label_id", "x", "place", "lang_pred", "spans", "found")})
    plain, clashing = (sorted(map(tuple, quality.score(d, quality.fit(d, marks)).collect()), key=str) for d in (docs, more))
    assert plain == clashing and len(plain) == docs.count()
    assert language.identify(more, language.fit(more)).count() == docs.count() and pii.find(more, pii.fit(more)).count() == docs.count()
    none = more.limit(0)
    assert quality.score(none, quality.fit(none, marks)).count() == 0 and quality.fit(more, marks.limit(0)) == 0.5
    assert language.fit(none) is None and language.identify(none, None).count() == 0 and pii.fit(none) is None
    assert decontaminate.overlaps(none, spark.createDataFrame([("1", "a b")], "item_id string, text string")).count() == 0


def test_votes_equal_a_plain_loop(spark):
    docs, marks = labelled(spark, 200)
    model = quality.fit(docs, marks)
    texts = [r.text for r in docs.limit(40).collect() if r.text]
    x = quality.terms(texts)
    latent, got = model._latent(x).astype(np.float64), model.scores(texts)
    for i in range(len(texts)):
        near = [int(np.rint(float(latent[i].astype(np.float32) @ model.vectors[:, j]) * 1e4)) for j in range(model.vectors.shape[1])]
        top = sorted(range(len(near)), key=lambda j: (-near[j], j))[: quality.NEIGHBOURS]
        weight = [(max(near[j], 0) / 1e4) ** quality.SHARPNESS * model.votes[j] for j in top]
        want = sum(w * model.labels[j] for w, j in zip(weight, top)) / sum(weight) if sum(weight) > 0 else got[i]
        assert abs(got[i] - want) < 0.02


def test_features_do_not_depend_on_neighbours():
    from quarryline.llm.features import gram_counts

    texts = ["abc abc", None, "", "Été été", "x" * 5000, "a b b b"]
    for fold in (True, False):
        both = gram_counts(texts, 256, fold=fold, repeats=True)
        alone = np.vstack([gram_counts([t], 256, fold=fold, repeats=True) for t in texts])
        assert (both == alone).all()
    assert tuple(gram_counts(["a b b b"], 256, repeats=True)[0, 256:]) == (4, 2)


# 6: contamination


def brute_overlap(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(13, len(w))
        for win in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == win:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "B", "c1", "é", "ÉÈ", "x-y", "the", "No"]
    sentence = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [("7", sentence(30)), ("10", sentence(14)), ("9", sentence(13)), ("8", "rare short"), ("11", ""), ("12", None), ("13", "漢字"), ("14", sentence(14))]
    rows = [(i, sentence(rng.randrange(0, 60)) + " " + rng.choice([t or "" for _, t in items]).upper().replace("É", "É") + "! " + sentence(rng.randrange(0, 400)), "en") for i in range(60)] + edge_rows()
    docs = make_docs(spark, rows)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id string, text string, doc_id string")
    want = sorted(((d, *brute_overlap(t, items)) for d, t, _ in rows), key=str)
    got = decontaminate.overlaps(docs, bench)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == want
    assert sorted(map(tuple, decontaminate.overlaps(docs, bench, spans=False).collect()), key=str) == want
    with pytest.raises(ValueError, match="words"):
        decontaminate.overlaps(docs, bench, most_words=50)
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {w[0] for w in want if not w[5]} and len(kept) > 3
    assert decontaminate.overlaps(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_spans_point_into_the_original():
    items = [("1", "One, two")]
    text = "É x—one; TWO! y"
    _, joined, _ = decontaminate.Windows(items).scan(text)
    assert joined == []  # the dash is a word character, so the word is 'x—one'
    text = "É x one; TWO! y"
    _, joined, _ = decontaminate.Windows(items).scan(text)
    assert [text[a:b] for a, b in decontaminate.original(text, joined)] == ["one; TWO"]


# 7: personal data


def brute_base(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(pii.digits(m[0])) <= 15]


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    parts = ["a", ".", "@", "@@", "b-c", "4111 1111 1111 1111", "1", "22", "333", "-", " ", "+", "+1 (499) 555-6503", "10.0.0.1", "256.1.1.1", "é", "\n", "x.y@z.com", "%", "..", "0001.2.3.4"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.base_spans(t) == brute_base(t)


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for unit in ("a", "1", "1.", "+1 ", "a@", "1 ", "(at) ", "@a."):
        pii.base_spans(unit * 200_000)
        pii.candidates(unit * 200_000)
    assert time.time() - began < 60


def test_model_adds_disguised_spans_and_keeps_base_ones(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        kind = i % 4
        value = (f"joe.{i}@mail{i % 9}.example.com", f"{rng.randrange(1, 255)}.{rng.randrange(255)}.1.{i % 250}", "4111111111111111", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}")[kind]
        rows.append((i, f"some words here {value} and more words {rng.randrange(10**9, 10**10)}", "en"))
    docs = make_docs(spark, rows + edge_rows())
    model = pii.fit(docs)
    got = pii.find(docs, model, carry=("doc_id", "text")).collect()
    assert len(got) == len(rows) + len(edge_rows())
    for r in got:
        base = brute_base(r.text)
        assert r.base_sha256 == hashlib.sha256(pii.line(base).encode()).hexdigest()
        assert set(filter(None, pii.line(base).split(","))) <= set(r.spans.split(","))
    sure = "write to joe (at) foo (dot) com please"
    assert model.more(sure, []) and pii.redact(sure, pii.line(model.more(sure, []))) == "write to [email] please"
    assert model.more("on 2024-01-05 we met", []) == []
    assert pii.fit(docs.where("text = 'same'")) is None
    assert pii.find(docs.where("text IS NULL"), None).select("spans").first()[0] == ""
