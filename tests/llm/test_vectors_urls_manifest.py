import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seasight.llm import centroids, merkle, urls
from seasight.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(pdf):
    return sorted(map(str, pdf[sorted(pdf.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op11_centroids", "op12_url_filters", "op13_merkle"])
def test_query_says_what_its_sql_says(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


# 11


def brute_clusters(vectors, k, rounds):
    kept = [(i, [int(np.floor(64 * float(y))) for y in v]) for i, v in vectors if v is not None and len(v) == 64 and all(y is not None and np.isfinite(y) for y in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    for n in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, m)) for m in c] for _, v in kept]
        at = [x.index(min(x)) for x in d]
        if n < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), a in zip(kept, at) if a == j]
                c[j] = [sum(col) // len(mine) for col in zip(*mine)] if mine else c[j]
    least = [min(x) for x in d]
    per = [sum(x for x, a in zip(least, at) if a == j) for j in range(len(c))]
    return sorted(((i, a, x, per[a], sum(least), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, least)), key=str)


def test_clusters_equal_brute_force(spark):
    """Unstructured and repeated vectors, ids that repeat or are missing, and vectors that are left out."""
    r = np.random.default_rng(3)
    v = [(i, r.normal(0, 2, 64).astype(np.float32).tolist()) for i in range(300)]
    v += [(7, v[8][1]), (None, v[9][1]), (None, v[0][1]), *[(400 + i, v[5][1]) for i in range(40)]]
    v += [(500, None), (501, [1.0] * 63), (502, [1.0] * 63 + [None]), (503, [1.0] * 63 + [float("nan")]), (504, [1.0] * 63 + [float("inf")]), (505, [])]
    df = spark.createDataFrame([(i, x, "c") for i, x in v], "vec_id long, embedding array<float>, cluster string").repartition(5)
    got = sorted(map(tuple, centroids.cluster_vectors(df, k=6).collect()), key=str)
    assert got == brute_clusters(v, 6, 3)


def test_clusters_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert centroids.cluster_vectors(spark.createDataFrame([], kind)).count() == 0
    two = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert sorted(map(tuple, centroids.cluster_vectors(spark.createDataFrame(two, kind)).collect()), key=str) == brute_clusters(two, 16, 3)
    nameless = centroids.cluster_vectors(spark.createDataFrame([(None, [0.5] * 64)], kind)).collect()
    assert [r["cluster"] for r in nameless] == [None]
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], kind)).collect()


def test_dot_products_are_those_of_the_centroids(spark):
    """What rounds add up is what a product from scratch gives."""
    r = np.random.default_rng(4)
    x = r.integers(-50, 50, (200, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, x array<int>")
    old, new = x[:5].copy(), x[:5].copy()
    new[1, 3] += 7
    new[4] = x[9]
    start = df.mapInArrow(centroids._start(old), f"vec_id long, {centroids._MATRIX}")
    got = {v["vec_id"]: v["dots"] for v in start.mapInArrow(centroids._update(old, new), f"vec_id long, {centroids._MATRIX}").collect()}
    assert got == {i: (x[i] @ new.T).tolist() for i in range(200)}


# 12


def test_a_cascade_is_exact_over_its_keys(spark, monkeypatch):
    """Also with filters that let much through, so that it has several levels."""
    monkeypatch.setattr(urls, "FIRST", (2, 1))
    monkeypatch.setattr(urls, "LATER", (2, 1))
    listed = spark.range(2000).select(F.concat(F.lit("in"), "id").alias("key"))
    universe = spark.range(20_000).select(F.concat(F.lit("out"), "id").alias("key")).union(listed)
    cascade = urls.Cascade.of(listed, 2000, universe)
    assert len(cascade.filters) > 4
    assert universe.filter(cascade.has(F.col("key")) != F.startswith("key", F.lit("in"))).count() == 0


def brute_judge(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = lambda h, p: host != "" and (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max((((len(h) + len(p), len(h), v == "block"), h + p, v) for h, p, v in rules if fits(h, p)), default=None)
    own = max((h + p for h, p in listed if fits(h, p)), key=len, default=None)
    return (host, path, best and best[1], best[2] if best else "block" if own else "allow", own)


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_judged_by_brute_force(spark, monkeypatch, most):
    """By cascades, and by joins as where the lists are too long for them."""
    monkeypatch.setattr(urls, "MOST_BITS", most)
    r = random.Random(2)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "a.net", "B.net", "c.net", "com", "casino.org", "m.casino.org", "localhost", "a..b", "xa.com", "a.com."]
    seen = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/x', '/e', '/EN/', '/de/y'])}{r.choice(['', '?q=/en/', '#f'])}" for _ in range(200)]
    seen += [None, "", "a.com/en/", "://", "x://A.com/en/1", "http://" + "y." * 3000 + "a.com/en/" + "z" * 50_000, "http://a.com\n/en/", seen[0]]
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("b.a.com", "", "allow"), ("net", "/e", "block"), ("a.net", "/e", "allow"), ("a.net", "/e", "block"), ("org", "/none", "allow")]
    listed = [("casino.org", ""), ("c.net", "/de/"), ("c.net", "")]
    pages = spark.createDataFrame([(i, u, "h", "k", "o") for i, u in enumerate(seen)], "page_id long, url string, host string, keys string, own string").repartition(3)
    got = urls.judge(pages, spark.createDataFrame([*rules, ("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string"), spark.createDataFrame(listed, "host string, path string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(((i, *brute_judge(u, rules, listed)) for i, u in enumerate(seen)), key=str)


def test_judge_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x"), (None, None)], "page_id long, url string")
    assert {tuple(x) for x in urls.judge(pages, none, none).collect()} == {(1, "a.com", "/x", None, "allow", None), (None, "", "", None, "allow", None)}
    assert urls.judge(pages.limit(0), urls.base_rules(spark), none).count() == 0
    hosts = [r["host"] for r in urls.listed_hosts(spark.createDataFrame([("http://m.best-casino.example.com/",), ("http://casinos.example.com/",), (None,), ("http://casino/",)], "url string")).collect()]
    assert hosts == ["best-casino.example.com"]


# 13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """The root, and of each leaf its siblings with their sides."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i in range(0, len(nodes), 2):
            for j in (i, i + 1):
                for leaf in own[j] if j < len(nodes) else ():
                    k = j ^ 1
                    paths[leaf].append((("L" if k < j else "R") + nodes[k]) if k < len(nodes) else "")
        own = [sum(own[i : i + 2], []) for i in range(0, len(nodes), 2)]
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(docs):
    f = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, more=0: H(*map(f, (d[0], d[3], d[2], None if d[4] is None else d[4] + more, d[1])))
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for lang in langs:
        mine = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees.append((mine, *brute_tree([leaf(d) for d in mine])))
    root, tops = brute_tree([t[1] for t in trees])
    for (mine, subroot, paths), top in zip(trees, tops):
        for d, p in zip(mine, paths):
            h = leaf(d, 1) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 else leaf(d)
            for s in (path := p + top):
                h = H(s[1:], h) if s[:1] == "L" else H(h, s[1:])
            out.append((d[0], leaf(d), subroot, root, H(*[s[1:] for s in path]), h, h == root))
    return sorted(out, key=str)


DOC = "doc_id long, text string, lang string, source string, n_chars long, g string, rank long"


@pytest.mark.parametrize(("levels", "span"), [(8, 12), (2, 3)])
def test_manifest_is_brute_force(spark, monkeypatch, levels, span):
    """Ids near and far, negative, repeated and missing; in blocks of four and directories of eight too."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", span)
    r = random.Random(5)
    ids = [*range(100, 400), *r.sample(range(10**6), 60), *(r.randrange(-(2**63), 2**63) for _ in range(20)), -1, 0, 2**63 - 1, -(2**63), None, None, None, *[5000] * 9]
    langs = [None, "", "en", "de", "é", "日本", "zz"]
    docs = [(i, r.choice([None, "", "a text", "ünï\n", "x" * 3000]), r.choice(langs[:4]), r.choice([None, "s"]), r.choice([None, 0, 17])) for i in ids]
    docs += [docs[3]] * 5 + [(1, "one", "é", None, 1), (1, "one", "日本", None, 1), (None, None, "zz", None, None)]
    df = spark.createDataFrame([(*d, "g", 1) for d in docs], DOC).repartition(4)
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(docs)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 256, 257])
def test_manifest_of_so_many(spark, n):
    docs = [(i, "t", "en", None, i) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame([(*d, "g", 1) for d in docs], DOC)).collect()
    want = brute_manifest([(*d[:4], d[4]) for d in docs]) if docs else []
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == sorted(w[1:5] for w in want)
    assert all(r["verified"] for r in got)
