import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasight.llm import ann, bpe, chat, exact_dedup, html, langid, licenses, mixing, pii, simhash
from seasight.llm.components import components

LONG = "word " * 40_000 + "x" * 30_000
DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", " \t\n", "Same text here, twice.", "Same text here, twice.", "same text here, twice.", "a", LONG, "é日本 ünï ٣²", "All  Rights\nReserved. all rights reserved", "mail a.b@c.de or +49 (30) 123-4567 89"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, row_no long, recipe string, fp string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators name their own."""
    rows = [(i, t, "en" if i % 2 else None, [None, "s1", "s2"][i % 3], None, 1, "r", "f", "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", "en", "s1", None, 1, "r", "f", "s")], DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_fingerprint(text, k=4):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(keys, linked):
    up = {k: k for k in keys}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {k: top(k) for k in keys}


# 1


def test_simhash_edge_cases(docs, empty):
    got = [(r["doc_id"], r["fingerprint"]) for r in simhash.near_groups(docs).collect()]
    want = [(i, f"{brute_fingerprint(t):016x}") for i, t in [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id")]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize(("n", "paired"), [(150, 64), (150, 2)])
def test_simhash_links_all_pairs(spark, monkeypatch, n, paired):
    """With and without blocks: what they give is what all pairs give."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(8)]
    while len(fps) < n:
        x = r.choice(fps)
        for b in r.sample(range(64), r.randrange(1, 7)):
            x ^= 1 << b
        fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "node long, fp long")
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(simhash.block_keys())]))
    keyed = nodes.select("node", "fp", keys.alias("x")).select("x.c", "x.k", "node", "fp")
    got = {r["node"]: r["component"] for r in components(simhash.link(nodes, keyed, 4)).collect()}
    want = brute_components(range(n), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    assert {i: got.get(i, i) for i in range(n)} == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {(r[0], r[1]) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 90), (90, 90)}


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(2)
    rand = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    base = rand(300)
    near = [base[:i] + ["changed"] + base[i + 1 :] for i in (40, 200)]
    half = base[:150] + rand(150)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([base, *near, half, rand(300), [], []])], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.drop_near_copies(d).collect()) == [0, 3, 4, 5, 6]


@pytest.mark.parametrize("paired", [64, 1])
def test_near_copies_with_repeats_and_short_ones_go(spark, monkeypatch, paired):
    """Of pairs that differ in repeats of a passage, or have 8 and 9 words, the first stays."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    r = random.Random(9)
    texts = []
    for i in range(60):
        w = [f"w{r.randrange(10**6)}" for _ in range(9 if i % 2 else 150)]
        texts += [w[:8], w] if i % 2 else [w, w[:60] + w[40:60] * 40 + w[60:]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.drop_near_copies(d).collect()) == list(range(0, 120, 2))


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_copies_are_those_of_all_pairs(spark):
    """Of the documents of a test table: every pair at 0.8 is linked, and no other."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 if sets[a] and sets[b] else False
    want = brute_components(sorted(sets), alike)
    d = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    got = {r["node"]: r["component"] for r in simhash.near_copies(d).collect()}
    assert {i: got.get(i, i) for i in sets} == want


@pytest.mark.parametrize("paired", [64, 3])
def test_a_large_family_of_near_copies(spark, monkeypatch, paired):
    """Copies of copies, most of them below 0.8 to each other, by pairs or by stars and blocks."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 20_000)
    r = random.Random(21)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    texts = [base]
    for i in range(60):
        w = list(r.choice(texts[-5:]))
        for _ in range(r.choice([1, 1, 2, 4])):
            w[r.randrange(len(w))] = f"n{i}"
        texts.append(w)
    sets = [shingles(" ".join(w)) for w in texts]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x["node"]: x["component"] for x in simhash.near_copies(d).collect()}
    want = brute_components(range(len(sets)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert {i: got.get(i, i) for i in range(len(sets))} == want and len(set(want.values())) > 1


def test_near_copies_edge_cases(docs, empty):
    kept = [x["doc_id"] for x in simhash.drop_near_copies(docs).collect()]
    assert sorted(kept, key=str) == sorted([0, 1, 2, 3, 3, 6, 7, 8, 9, 10, None], key=str)  # 4 and 5 repeat 3, in other cases too
    assert simhash.drop_near_copies(docs).columns == docs.columns and simhash.drop_near_copies(empty).count() == 0


# 2


def brute_scan(text):
    """Base places, and templates whose mandatory phrases all stand where one start puts them."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    at = lambda p, i: w[max(i, 0) : i + len(p)] == p if i >= 0 else False
    base = sorted((i, label) for p, label in licenses.BASE for i in range(len(w)) if at(p.split(), i))
    labels = {x for _, x in base}
    for label, t, ps in licenses.TEMPLATES:
        offsets = [(p.split(), licenses._offset(t, p)) for p in ps]
        if any(all(at(p, s + o) for p, o in offsets) for s in range(-len(t.split()), len(w))):
            labels.add(label)
    return len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_license_scan_is_brute_force(spark):
    """Over the documents of a test table, and over texts with parts of notices, repeated ones and ones that tie."""
    r = random.Random(22)
    parts = [x for _, t, ps in licenses.TEMPLATES for x in (t, *ps)]
    mixed = []
    for _ in range(80):
        w = " ".join(r.choice(parts) for _ in range(r.randrange(1, 4))).split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(["the", "license", "version", "x"])
        mixed.append(" ".join(w))
    texts = [x["text"] for x in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + mixed
    got = {x["doc_id"]: tuple(x)[1:7] for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_scan(x) for i, x in enumerate(texts)} and len(licenses.TEMPLATES) > licenses.RAREST


def test_license_scan(docs, empty):
    rows = licenses.scan(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(TEXTS) + 2
    r = got[9]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (6, 2, 0, 3, "reserved", "reserved", 1.0)
    assert got[0][1:8] == (0, 0, None, None, "", "", 0.0) and got[7]["n_words"] == 40_001
    assert licenses.scan(empty).count() == 0


def test_license_templates(spark):
    d = spark.createDataFrame([(1, "x y. Licensed under the Apache License, Version 2.0."), (2, "apache version license 2 0 the"), (3, "Licensed under CC BY-NC 4.0")], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in licenses.scan(d).collect()}
    assert got == {1: ("", "apache-2.0"), 2: ("", ""), 3: ("cc-by", "cc-by,cc-by-nc-4.0")}


def test_license_templates_of_many_in_one_text(spark):
    """A text with every notice in it loses none, however many rarer licence words it has."""
    text = ". ".join(t for _, t, _ in licenses.TEMPLATES)
    d = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(d).collect()}
    assert set(got[1].split(",")) == {label for label, _, _ in licenses.TEMPLATES} | {"gpl", "cc-by"} and got[2] == ""


# 3


def test_language_models_learn_and_hold_out(spark):
    r = random.Random(3)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(40))
    kinds = {"aa": ["tho", "er", "ing"], "bb": ["sch", "und", "ä"], "cc": ["ción", "el", "os"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(sorted(kinds) * 60)]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", "bb"), (902, make(kinds["aa"]), None), (903, "zzzzqqqq" * 40, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and not any(got[i]["rejected"] for i, _, _ in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["rejected"] and got[903]["rejected"]
    assert got[902]["lang_pred"] == "aa" and all(0 <= x["score"] <= 1 for x in got.values())
    kept = {x["doc_id"] for x in langid.drop_rejected(d).collect()}
    assert kept == {i for i, _, _ in rows} | {902}


def brute_models(rows):
    """Interpolated Kneser-Ney by the book, with dictionaries: p(lang, context, character)."""
    out = {}
    for lang in {x for _, x in rows}:
        counts = {}
        for text, x in rows:
            s = f"   {langid.plain(text)} " if x == lang and langid.plain(text) else ""
            for i in range(len(s) - 3):
                counts[s[i : i + 4]] = counts.get(s[i : i + 4], 0) + 1
        levels = [counts]
        for _ in range(3):
            shorter = {}
            for g in levels[-1]:
                shorter[g[1:]] = shorter.get(g[1:], 0) + 1
            levels.append(shorter)
        out[lang] = levels[::-1]
    d = langid._DISCOUNT

    def prob(lang, context, char):
        levels = out[lang]
        p = d * len(levels[0]) / sum(levels[0].values()) * langid._OTHER
        for n, level in enumerate(levels):
            ctx = context[3 - n :]
            after = [c for g, c in level.items() if g[:n] == ctx]
            if after:
                p = (max(level.get(ctx + char, 0) - d, 0) + (d * len(after) * p if n else 0)) / sum(after) + (0 if n else p)
        return p

    return prob


@pytest.mark.parametrize("part_grams", [10**6, 60])
def test_kneser_ney_scores_by_the_book(spark, part_grams):
    """Whole models and models in parts give what dictionaries give, and probabilities sum to one."""
    r = random.Random(13)
    rows = [("".join(r.choice(letters) for _ in range(60)), lang) for lang, letters in (("aa", "abc d"), ("bb", "bcde éß")) for _ in range(6)]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)] + [(90, "xyz", None), (91, "cab bed", None), (92, "", "aa"), (93, None, "aa")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.score(d.select("doc_id", "text"), d, part_grams).collect()}
    prob = brute_models(rows)
    for i, text in [*((i, x) for i, (x, _) in enumerate(rows)), (90, "xyz"), (91, "cab bed")]:
        s = f"   {langid.plain(text)} "
        nats = {lang: -sum(np.log(prob(lang, s[k - 3 : k], s[k])) for k in range(3, len(s))) / (len(s) - 3) for lang in ("aa", "bb")}
        best = min(nats, key=lambda x: (nats[x], x))
        assert got[i]["lang_pred"] == best and got[i]["nats"] == pytest.approx(nats[best])
    assert got[92]["lang_pred"] == got[93]["lang_pred"] == "und"
    letters = {c for x, lang in rows if lang == "bb" for c in x} | {" "}
    assert sum(prob("bb", "cde", c) for c in letters) + prob("bb", "cde", "\u2603") * (1 / langid._OTHER) == pytest.approx(1.0)


def test_language_edge_cases(docs, empty):
    assert langid.identify(docs).count() == len(TEXTS) + 2
    assert langid.identify(empty).count() == 0


# 4


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((300, 16)).astype(np.float32)
    v[50:80] = v[50]  # copies, and so ties
    rows = [(i, v[i].tolist()) for i in range(300)]
    bad = [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None, *[1.0] * 15])]
    got: dict = {}
    for x in ann.nearest(spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, rounds=3).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, own in got.items():
        s = v.astype(float) @ v[q].astype(float)
        want = sorted((-s[i], i) for i in range(300) if i != q)[:20]
        own.sort()
        assert [x[0] for x in own] == list(range(1, 21)) and all(abs(x[2] - s[x[1]]) < 1e-9 for x in own)
        hits += len({x[1] for x in own} & {i for _, i in want})
    assert hits / 300 >= 0.95


def recall(spark, v, **how):
    """Of the queries' 20 nearest by brute force those found; every score is exact."""
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got: dict = {}
    for x in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, **how).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    hits, n = 0, 0
    for q, own in got.items():
        s = v.astype(float) @ v[q].astype(float)
        want = sorted((-s[i], i) for i in range(len(v)) if i != q)[:20]
        assert all(abs(x[2] - s[x[1]]) <= 1e-9 * max(1, abs(x[2])) for x in own)
        hits, n = hits + len({x[1] for x in own} & {i for _, i in want}), n + len(want)
    return hits / n


def test_nearest_beside_very_long_vectors(spark):
    """A few vectors 100 times longer than the rest don't make the rest look alike."""
    v = np.random.default_rng(14).standard_normal((400, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[[3, 77, 200, 381]] *= 100
    v[[5, 120]] *= 5000
    assert recall(spark, v) >= 0.95


def test_nearest_edge_cases(spark):
    """Shorter vectors are filled up with zeros, of a repeated id the largest counts, null ids take no part."""
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (1, [0.5], 1), (2, [0.0, 1.0, 5.0], 1), (None, [9.0, 9.0], 1), (3, [], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").withColumn("code", F.lit("x"))
    got = [tuple(x) for x in ann.nearest(d, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0)]


def test_nearest_of_few(spark):
    d = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(d([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert ann.nearest(d([]), F.col("vec_id") == 0).count() == 0


# 5


def test_chat_round_trip(spark):
    hostile = "a<|end|>\n~1~0<|user|>\n</s>[INST]|>"
    rows = [(1, 0, "system", "rules"), *[(1, i, "assistant" if i % 2 == 0 else "user", f"{i} {hostile} " + "x" * 900) for i in range(1, 9)], (2, 0, "user", None), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, None, None, None)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    w = chat.windows(t)
    got = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    for conv in (1, 2, None):
        own = sorted((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    parts = [r for r in w.filter("conv_id = 1").orderBy("window").collect()]
    assert len(parts) > 1 and all(r["formatted"].startswith("<|system|>\nrules<|end|>\n") for r in parts)
    assert chat.read_back(chat.windows(t.limit(0))).count() == 0


# 6


def test_exact_groups(docs, empty):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert {(0, 1, 2, False), (1, 1, 2, True), (4, 4, 3, True), (3, 4, 3, False), (5, 5, 1, True), (None, None, 1, True)} <= got
    assert exact_dedup.exact_groups(empty).count() == 0
    assert sorted(x["doc_id"] or -1 for x in exact_dedup.drop_copies(docs).collect()) == [-1, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_chunks_join_to_the_whole_and_survive_an_edit():
    data = random.Random(5).randbytes(200_000)

    def parts(d):
        ends = exact_dedup.chunk_ends(d)
        return [d[a:b] for a, b in zip([0, *ends], ends)]

    assert b"".join(parts(data)) == data
    edited = data[:100_000] + b"!" + data[100_000:]
    assert len(set(parts(data)) & set(parts(edited))) > 0.9 * len(parts(data))
    assert max(np.diff([0, *exact_dedup.chunk_ends(bytes(100_000))])) <= exact_dedup.MAX_BYTES


# 7


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and (sum(digits[::-2]) + sum(sum(divmod(2 * x, 10)) for x in digits[-2::-2])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(list(PATTERNS)[k], s, e) for s, k, e in sorted(out)]


def test_base_spans_are_the_patterns(spark):
    """Of all four kinds, over the documents of a test table and over random strings of what patterns are made of."""
    r = random.Random(23)
    texts = [x["text"] or "" for x in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += ["".join(r.choice("0123456789" * 2 + "..@@-- +()aZ%_é") for _ in range(60)) for _ in range(20_000)]
    texts += ["x@y @a.b_c@d.ee 1.2.3.4.5 256.1.1.1 4111 1111-1111 1111 4111111111111112 +1 (2) 345-67890. +12"]
    for x in texts:
        assert pii.base_spans(x) == brute_spans(x)


def test_long_runs_take_linear_time_and_no_limit():
    import time

    assert pii.base_spans("0" * 5000 + ".1.1.1 " + "0" * 5000 + "1.1.1.1") == [("ip", 0, 5006), ("ip", 5007, 10014)]
    assert pii.entity("ip", "0" * 5000 + "1.1.1.1") == pii.entity("ip", "1.1.1.1")
    began = time.process_time()
    for x in (" @a.b" * 100_000, "a@" * 200_000, "1" * 500_000, "+1" + "(" * 500_000, "token" * 100_000, "-_" * 200_000 + "= x"):
        pii.all_spans(x)
    pii.near_words("a@b.cc word " * 20_000, pii.all_spans("a@b.cc word " * 20_000))
    assert time.process_time() - began < 20


def test_secrets():
    t = 'token = "fc22f42429fef2ebde85e081b172bc127a2eef28" and API_KEY: AbCd1234EfGh5678 but key = value, password: internationalisation, 00000000000000000000000000000000'
    assert [t[s:e] for k, s, e in pii.all_spans(t) if k == "secret"] == ["fc22f42429fef2ebde85e081b172bc127a2eef28", "AbCd1234EfGh5678"]
    assert pii.all_spans("me@x.org")[0][0] == "email" and pii.bits("aaaa") == 0


def brute_judge(texts):
    """word, entity: pairs that tell, by counting places one by one."""
    from math import log

    every, near, size, rows = {}, {}, {}, {}
    for text in texts:
        spans = pii.all_spans(text)
        free = [m for m in pii._WORD.finditer(text) if not any(s < m.end() and e > m.start() for _, s, e in spans)]
        for m in pii._WORD.finditer(text):
            every[m[0].lower()] = every.get(m[0].lower(), 0) + 1
        places = set()
        for kind, s, e in spans:
            before = [m for m in free if m.start() < s][-pii.NEAR :]
            for m in before + [m for m in free if m.start() >= s][: pii.NEAR]:
                places |= {(m.start(), m[0].lower(), pii.KINDS.index(kind)), (m.start(), m[0].lower(), pii.entity(kind, text[s:e]))}
        for _, w, x in places:
            near[w, x] = near.get((w, x), 0) + 1
            size[x] = size.get(x, 0) + 1
        for pair in {(w, x) for _, w, x in places}:
            rows[pair] = rows.get(pair, 0) + 1
    n, z, out = sum(every.values()), pii.DEVIATIONS, set()
    for (w, x), k in near.items():
        m, p = every[w], k / every[w]
        low = (p + z * z / 2 / m - z * (p * (1 - p) / m + z * z / 4 / m / m) ** 0.5) / (1 + z * z / m)
        if log(low * n / size[x]) >= pii.ALPHA * log(n / size[x]) and low >= 0.5 and rows[w, x] >= 2:
            out.add((pii._id(w), x))
    return out


def test_disclosure_is_brute_force(spark):
    r = random.Random(24)
    names, fill = ["ludmilla", "bartholomew", "quentin"], ["alpha", "beta", "gamma", "delta", "mail", "phone"]
    texts = []
    for i in range(300):
        w = [r.choice(fill) for _ in range(r.randrange(30))]
        if i % 4 == 0:
            k = r.randrange(3)
            w += [names[k], f"p{k}@q.org" if k == 0 or r.random() < 0.8 else "10.0.0.7"]
        texts.append(" ".join([*w, *(r.choice(fill + names[1:2]) for _ in range(r.randrange(20)))]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["word"], x["entity"]) for x in pii.judge(pii.counted(d)).filter("tells").collect()}
    assert got == brute_judge(texts) and got


def test_a_single_place_tells_in_no_corpus(spark):
    """However many other words there are, nor do many places in one row, or a word that is beside a value now and then."""
    texts = ["ludmilla jo@q.org"] * 5 + ["quentin al@q.org"] + ["bartholomew bartholomew bartholomew bartholomew ed@q.org"] + ["wanda ty@q.org"] * 5 + ["wanda"] * 10
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.counted(d)
    for times in (10, 10_000, 10**9):
        more = got.union(spark.createDataFrame([(1, pii.ALL, 40 * times, 0)], got.schema))
        telling = {x["word"] for x in pii.judge(more).filter("tells and entity < 0").collect()}
        assert telling == {pii._id("ludmilla")}


def test_a_filter_has_room_for_its_words(spark):
    """Of the words that aren't in it few pass, however many are."""
    for n in (0, 1, 30_000):
        bits = pii._filter(spark.range(n).select(F.xxhash64("id").alias("word")))
        own = np.array([x["h"] for x in spark.range(n + 1000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
        held = pii._held(bits, own)
        assert held[:n].all() and held[n:].mean() < 0.08


def test_sanitise_edge_cases(spark, docs, empty):
    d = docs.withColumns({"_spans": F.lit(1), "spans": F.lit(2), "row": F.lit(3)})
    out = pii.sanitise(d)
    assert out.columns == d.columns and out.count() == len(TEXTS) + 2
    got = {(x["doc_id"], x["text"]) for x in out.collect()}
    assert (10, "mail [email] or [phone]") in got and (0, None) in got and (3, TEXTS[3]) in got
    assert pii.sanitise(empty).count() == 0
    sha = {x["doc_id"]: x["clean_sha256"] for x in pii.report(docs).collect()}
    assert sha[10] == hashlib.sha256(b"mail [email] or [phone]").hexdigest() and sha[0] == hashlib.sha256(b"").hexdigest()


def test_disclosing_words(spark, docs, empty):
    r = random.Random(6)
    filler = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    d = spark.createDataFrame([(i, f"{filler()} mailbox p{i}@q.org {filler()}" if i % 3 == 0 else filler()) for i in range(120)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in pii.report(d).collect()}
    assert all(got[i]["n_terms"] == (1 if i % 3 == 0 else 0) for i in range(120))
    assert "mailbox" not in "".join(x["text"] for x in pii.sanitise(d).collect()) and "[email]" in pii.sanitise(d).filter("doc_id = 0").first()["text"]
    rows = pii.report(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and {x["doc_id"]: (x["n_email"], x["n_phone"]) for x in rows}[10] == (1, 1)
    assert pii.report(empty).count() == 0


def _prose(seed, n, texts):
    """n texts of common words, with ``texts`` put into the first ones."""
    r = random.Random(seed)
    fill = lambda k: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(k))
    return [(i, f"{fill(20)} {texts[i]} {fill(20)}" if i < len(texts) else fill(40)) for i in range(n)]


def test_a_rare_word_gives_one_value_away(spark):
    """Five places beside one address, in different spellings; at the kind's level, of which the corpus is full, they would not do."""
    texts = [f"ludmilla {v}" for v in ["jo@q.org", "JO@q.org", "Jo@Q.org", "jo@Q.ORG", "jO@q.org"]] + [f"p{i}@q.org" for i in range(395)]
    d = spark.createDataFrame(_prose(7, 400, texts=texts), "doc_id long, text string")
    got = {x["doc_id"]: x["n_terms"] for x in pii.report(d).collect()}
    assert [got[i] for i in range(400)] == [1] * 5 + [0] * 395
    assert pii.entity("ip", "01.2.3.4") == pii.entity("ip", "1.2.3.4") != pii.entity("phone", "+1.2.3.4")


def test_all_places_of_a_disclosing_word_go(spark):
    """Also those without the value beside them, and those with a long run in between."""
    gap = "0" * 400
    texts = [f"ludmilla {gap if i % 2 else ''} jo@q.org" for i in range(12)] + ["ludmilla"] * 2
    d = spark.createDataFrame(_prose(8, 400, texts=texts), "doc_id long, text string")
    got = {x["doc_id"]: x["n_terms"] for x in pii.report(d).collect()}
    assert [got[i] for i in range(400)] == [1] * 14 + [0] * 386
    assert not [x for x in pii.sanitise(d).collect() if "ludmilla" in x["text"]]


# 8


def test_bpe_equals_the_library(spark, docs, empty):
    lib, own = Tokenizer.from_file(bpe.TOKENIZER), bpe.Bpe(bpe.TOKENIZER)
    r = random.Random(8)
    texts = [t or "" for t in TEXTS] + ["<|endoftext|> a<|endoftext|>b", "aaaaaaaaaaaaaaaaaaa", " " * 50 + "x\n\n"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(0x1F300, 0x1F700)])) for _ in range(40)) for _ in range(300)]
    got = own.encode_batch(texts)
    for t, ids in zip(texts, got):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    e = bpe.encode(docs)
    assert {(x["doc_id"], x["text"]) for x in bpe.decode(e).collect()} == {(i, t or "") for i, t in enumerate(TEXTS)} | {(None, "no id")}
    assert bpe.encode(empty, digests=True).count() == 0


def test_bpe_of_a_very_long_word(spark):
    """Linear in its length, and what the library gives."""
    import time

    own, lib = bpe.Bpe(bpe.TOKENIZER), Tokenizer.from_file(bpe.TOKENIZER)
    for x in ("ab" * 10_000, "x" * 20_000, "é" * 5_000, " " * 10_000):
        assert np.frombuffer(own.encode_batch([x])[0], "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids
    began = time.process_time()
    own.encode_batch(["abcdefghij" * 40_000])
    assert time.process_time() - began < 10


# 9


def brute_template(pages, least=5, share=0.8):
    """Tokens of the valid, nested classes of one host's pages, with dictionaries."""
    tables = {}
    for page in pages:
        found, elements = html.parse(page)
        depth = [0]
        for x in elements[1:]:
            depth.append(depth[x[1]] + 1)
        own = {x[0]: [x[3], x[4], elements[x[1]][0], depth[i]] for i, x in enumerate(elements) if i}
        for e, text, _, _ in found:  # texts nest in whatever is around them
            own.setdefault(f"{elements[e][0]}\n{text}", [0, elements[e][4], None, depth[e] + 1])[0] += 1
        tables[page] = own
    if len(tables) < least:
        return set()
    classes = {}
    for token in {t for x in tables.values() for t in x}:
        vector = tuple(x[token][0] if token in x else 0 for x in tables.values())
        seen = [n for n in vector if n]
        if len(seen) >= share * len(tables) and len(set(seen)) == 1:
            classes.setdefault(vector, []).append(token)
    good = {}
    for vector, tokens in classes.items():
        orders = {tuple(sorted(tokens, key=lambda t: (x[t][1], html._hash(t)))) for n, x in zip(vector, tables.values()) if n}
        if len(orders) == 1:
            good |= {t: next(x[t] for x in tables.values() if t in x) for t in tokens}
    out = set()
    for token in sorted(good, key=lambda t: (good[t][3], html._hash(t))):
        if good[token][3] == 1 or good[token][2] is None or good[token][2] in out:
            out.add(token)
    return {html._hash(t) for t in out}


def test_html_templates_are_brute_force(spark):
    r = random.Random(25)
    names, word = ["a", "b", "x1", "y"], lambda: f"t{r.randrange(9)}"

    def block(deep):
        if deep == 0 or r.random() < 0.3:
            return f"<p>{word()}</p>"
        return f"<div class={r.choice(names)}>" + "".join(block(deep - 1) for _ in range(r.randrange(3))) + "</div>"

    for _ in range(4):
        fixed = [block(2) for _ in range(3)]
        pages = [f"<html><body>{fixed[0]}<div class=k>{block(2)}{word()}{i}</div>{fixed[1]}{fixed[2] if r.random() < 0.9 else ''}</body></html>" for i in range(8)]
        d = spark.createDataFrame([(i, "http://h/", x) for i, x in enumerate([*pages, pages[0]])], "page_id long, url string, html string")
        read = d.select("page_id", "url", F.lit("h").alias("host"), "html").mapInArrow(html._read, f"page_id long, url string, {html._READ}")
        assert set(html.host_templates(read).first()["template"]) == brute_template(pages)


def test_html_by_the_host_where_markup_misleads(spark):
    """No article, odd names, a notice repeated in the text's own element, and reader comments under a name that no list has."""
    r = random.Random(26)
    words = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        paragraphs = [words(30 + i) for _ in range(2 + i % 3)]
        voices = "".join(f"<p>{words(6)}</p>" for _ in range(i % 4))
        page = f"<body><div class=q9><p>Site</p></div><div class=zz><h2>Title {i}</h2><div class=k7><p>Read our terms before use</p>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</div></div><div class=user-voices>{voices}</div><div class=w3>{words(3)} {i}</div>"
        rows.append((i, "http://odd.example/", page))
        want[i] = "\n\n".join([f"Title {i}", *paragraphs])
    got = {x["page_id"]: x for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: x["text"] for i, x in got.items()} == want and all(x["n_template"] > 1 for x in got.values())


def test_html_notice_inside_the_article_goes(spark):
    page = lambda i: f"<body><main><article><p>Read our terms before use</p><p>own text {i}</p><section class=reader-thoughts><p>thought {i}</p></section></article></main>"
    d = spark.createDataFrame([(i, "http://h.example/x", page(i)) for i in range(10)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(d).collect()}
    assert got[3].startswith("own text 3") and "terms" not in got[3]


def test_html_of_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>{i} " + "w " * 200 for i in range(3000))
    d = spark.createDataFrame([(1, "http://h/", page), (1, "http://h/", page), (None, None, "<p>x")], "page_id long, url string, html string").withColumns({"host": F.lit(1), "template": F.lit(2), "main_slot": F.lit(3)})
    got = html.extract(d).collect()
    assert sorted((x["page_id"] or 0, x["text"].count("\n\n")) for x in got) == [(0, 0), (1, 2999), (1, 2999)]


def test_html_blocks():
    page = (
        "<html><head><title>t</title></head><body class='has-sidebar'><div id=cookie-notice>c</div><nav>n<ul><li>m</ul></nav><header>h</header>"
        "<article><header><h1>A &amp;amp; B</h1></header><p>one<br>two <b>th</b>ree&nbsp;x<p>four<script>var a='</p>'</script><ul><li>i<li>j</ul>"
        "<div class='ad-slot'>ad<p>ad</div><form>f</form><section class=comments><p>said</p></section><p>end<!-- no --></article><aside>s</aside><footer>f</footer>"
    )
    assert [t for _, t, main in html.blocks(page) if main] == ["A &amp; B", "one two three x", "four", "i", "j", "end"]
    assert html.blocks(None) == html.blocks("") == [] and html.blocks("<a href='x") == []


def test_html_attributes_go_by_name():
    kept = ["style='overflow:hidden'", 'aria-hidden="false"', 'title="Hidden gems"', 'data-role="share"', "data-id=menu", "title='class=\"ad\"'", "title=\"it's hidden\" class=x"]
    gone = ["hidden", "class=x hidden=''", 'aria-hidden="true"', "role=search", "ID = 'menu'", "class='x ad'", "data-x='a' class=\"ad\""]
    page = "<article>" + "".join(f"<div {a}>{i}</div>" for i, a in enumerate(kept + gone))
    assert [t for _, t, _ in html.blocks(page)] == [str(i) for i in range(len(kept))]


def test_html_template(spark):
    page = lambda i: f"<body><div><p>Site of things</p></div><div><p>own {i}</p><p>more {i}</p></div><div><p>Terms apply</p></div>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(8)] + [(90, "http://other.example/", page(90)), (91, None, None), (92, "http://h.example/", "<article><p>Site of things</p></article>")]
    d = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html.extract(d).collect()}
    assert got[3] == "own 3\n\nmore 3" and got[90].startswith("Site of things") and got[91] == "" and got[92] == "Site of things"
    assert html.extract(d.limit(0)).count() == 0


def test_html_slots_come_from_the_host(spark):
    """What most pages of a host share decides: the main slot, and constant text outside it."""
    page = lambda i: f"<body><div class='a/b c'><nav><a>{i}</a></nav><div class=top><p>Welcome</p></div><main><p>own {i}</p>" + "<p>more</p>" * (i % 3) + "</main><div class=end>bye</div>"
    odd = "<body><div class='a/b c'><div class=top><p>Welcome</p></div><div class=other><p>no main here</p></div><div class=end>bye</div>"
    d = spark.createDataFrame([*((i, "http://h.example/x", page(i)) for i in range(9)), (50, "http://h.example/y", odd)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract(d).collect()}
    assert got[2]["text"] == "own 2\n\nmore\n\nmore" and got[3]["text"] == "own 3" and got[2]["n_slots"] == 1
    assert got[50]["text"] == "no main here" and got[50]["n_template"] == 2
    read = d.select("page_id", "url", html.host_of(F.col("url")).alias("host"), "html").mapInArrow(html._read, f"page_id long, url string, {html._READ}")
    tokens = set(html.host_templates(read).first()["template"])
    held = lambda path: html._hash(path) in tokens
    assert held("/body/div.a/b.c/main") and not held("/body/div.a/b.c/main/p") and held("/body/div.a/b.c/div.end\nbye")


def test_html_keeps_an_optional_second_article(spark):
    page = lambda i: f"<body><div class=top>Welcome</div><article class=lead><p>lead {i}</p></article>" + f"<div class=more><article class=update><p>update {i}</p></article></div>" * (i % 2) + "<div class=end>bye</div>"
    d = spark.createDataFrame([(i, "http://h.example/x", page(i)) for i in range(10)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(d).collect()}
    assert got == {i: f"lead {i}" + f"\n\nupdate {i}" * (i % 2) for i in range(10)}


RECIPE = "<body><nav>menu</nav><article><p class=note>Free for members</p><h1>{t}</h1><h2>Ingredients</h2><ul><li>flour</li><li>{a}</li></ul><h2>Method</h2><p>{b}</p><p>Serves four</p><p class=legal>Terms apply</p></article><footer>f</footer>"
ANSWERS = "<body><div class=top>Shop</div><main><h1>{t}</h1><dl><dt>How long is delivery?</dt><dd>{a}</dd><dt>Can I return it?</dt><dd>{b}</dd><dt>Is it new?</dt><dd>Yes.</dd></dl></main><div class=end>bye</div>"
PRODUCT = "<body><div class=w8>Shop</div><div class=x1><h1>{t}</h1><table><tr><th>Weight</th><td>{a}</td></tr><tr><th>Colour</th><td>{b}</td></tr></table></div><div class=w9>Terms apply</div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (RECIPE, ["{t}", "Ingredients", "flour", "{a}", "Method", "{b}", "Serves four"]),
        (ANSWERS, ["{t}", "How long is delivery?", "{a}", "Can I return it?", "{b}", "Is it new?", "Yes."]),
        (PRODUCT, ["{t}", "Weight", "{a}", "Colour", "{b}"]),
    ],
)
def test_html_repeated_text_inside_the_article_stays(spark, page, want):
    """Headings, questions and lines that all pages of a host have, between or after the page's own; notices before and legal lines after go."""
    r = random.Random(27)
    words = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(n))
    own = [{"t": f"Title {i}", "a": f"{words(5)} {i}", "b": f"{words(20)} {i}"} for i in range(9)]
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame([(i, "http://h.example/", page.format(**o)) for i, o in enumerate(own)], "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(want).format(**o) for i, o in enumerate(own)}


# 10


def test_mix_meets_its_targets(spark, docs, empty):
    r = random.Random(10)
    d = spark.createDataFrame([(i, "w " * r.randrange(0, 60), r.choice(["a"] * 8 + ["b", None])) for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(d).collect()
    by: dict = {}
    for x in rows:
        by.setdefault(x["source"], []).append(x)
        assert 0 <= x["taken"] <= 3 * x["size"]
    total = sum(x["size"] for x in rows)
    for own in by.values():
        assert sum(x["taken"] for x in own) == int(own[0]["target"]) and own[0]["target"] <= 3 * own[0]["source_size"]
    assert abs(sum(own[0]["target"] for own in by.values()) - total) < 1e-6
    assert mixing.mix(docs).count() == len(TEXTS) + 2 and mixing.mix(empty).count() == 0
    assert {tuple(x) for x in mixing.mix(d).drop("row_no").collect()} == {tuple(x)[1:] for x in rows}


def test_mix_says_its_slots(spark):
    """Slots cover what is taken, and every stretch of the schedule has its sources near their shares."""
    r = random.Random(27)
    d = spark.createDataFrame([(i, "w " * r.randrange(1, 60), r.choice("aabc")) for i in range(500)], "doc_id long, text string, source string")
    rows = mixing.mix(d, slots=1000).collect()
    assert all((x["n_slots"] > 0) == (x["taken"] > 0) == (x["first_slot"] >= 0) for x in rows)
    sizes = mixing.cut(d.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "source", F.regexp_count("text", F.lit(r"\w+")).cast("long").alias("size")))
    targets = mixing.cut(mixing.source_targets(sizes))
    slots = mixing.schedule(targets, 1000).collect()
    goal = {x["source"]: x["target"] for x in targets.collect()}
    total = sum(goal.values())
    for upto in range(50, 1000, 50):
        for s, target in goal.items():
            assert abs(sum(x["source"] == s and x["slot"] < upto for x in slots) - upto * target / total) <= 4


def test_mixed_rows_keep_repeats_and_names(spark, empty):
    r = random.Random(28)
    rows = [(i % 50, "w " * r.randrange(0, 40), r.choice(["a", "a", "b", None]), 1, 2) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, times int, row int").withColumn("m_id", F.lit("x"))
    out = mixing.mixed_rows(d)
    assert out.columns == d.columns and mixing.mixed_rows(empty).count() == 0
    size = lambda x: len(words(x["text"]))
    taken = {}
    for x in out.collect():
        taken[x["source"]] = taken.get(x["source"], 0) + size(x)
    for x in mixing.mix(d).select("source", "target").distinct().collect():
        assert abs(taken.get(x["source"], 0) - x["target"]) <= 41
    once = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s")], "doc_id long, text string, source string")
    assert mixing.mixed_rows(once).count() == 2


STAGE_NAMES = ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]


@pytest.mark.parametrize("name", STAGE_NAMES)
def test_pipeline_stages_take_any_table(docs, empty, spark, name):
    """Nulls in any column, repeated rows and no rows; all but the last return the columns of documents."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (7, "words and more words here", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, empty, nulls):
        out = stage(spark, d, "")
        n = out.count()
        assert n == d.count() if name == "bpe" else n <= 3 * d.count()
        assert name == "bpe" or out.columns == d.columns
    assert list(dict(corpus_pipeline.STAGES)) == STAGE_NAMES


def test_pipeline_is_its_stages_by_brute_force(spark):
    """Over a test table: what each stage keeps is what plain Python keeps."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    kept = {x["doc_id"] for x in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {i for i, x in texts.items() if langid.plain(x)}  # none of these is rejected for its language
    one = docs.filter(F.col("doc_id").isin(sorted(kept)))
    last = {}
    for i in sorted(kept):
        last[texts[i]] = i
    assert {x["doc_id"] for x in corpus_pipeline.exact(spark, one, "").collect()} == set(last.values())
    two = docs.filter(F.col("doc_id").isin(sorted(last.values())))
    sets = {i: shingles(texts[i]) for i in last.values()}
    comp = brute_components(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert {x["doc_id"] for x in corpus_pipeline.near(spark, two, "").collect()} == {i for i in sets if comp[i] == i}
    lib = Tokenizer.from_file(bpe.TOKENIZER)
    for x in corpus_pipeline.tokens(spark, two.limit(20), "").collect():
        ids = lib.encode(texts[x["doc_id"]], add_special_tokens=False).ids
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_keeps_columns(docs, spark):
    import corpus_pipeline

    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, out, "").count() > 0
