"""URL filters by cascades of Bloom filters.

The first filter of a cascade holds the listed keys, the second those keys of
the corpus that the first lets through by mistake, the third the listed ones
that the second lets through, and so on until none are left. Over the keys of
that corpus the answer is exact, and no URL is joined with a list. Everything
is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasight.llm.common import ascii_lower, cut, free_name, table

#: The rules (host, path, verdict) that every run has.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: A host is listed from the label on that has one of these words (words end at hyphens and underscores).
TERMS = "adult ads bet bets betting casino escort gambling loans pharma pills poker porn sex spam track tracker viagra xxx".split()
LISTED = rf"(?:^|\.)((?:[^.]*[-_])?(?:{'|'.join(TERMS)})(?:[-_][^.]*)?\..+)$"
#: Bits a key and hashes of the first filter, which all keys of the corpus meet, and of the others, which halve what is left.
FIRST, LATER = (14, 8), (3, 2)
#: Bits that one filter may have: they go to every task. Longer lists are joined.
MOST_BITS = 1 << 26


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


@dataclass
class Filter:
    """A Bloom filter of a cascade's level; ``words`` are its bits as comma-joined longs, which travel with the plan."""

    level: int
    bits: int
    hashes: int
    words: str = ""

    @classmethod
    def of(cls, keys: DataFrame, n: int, level: int) -> Filter:
        """Of the ``n`` rows of ``keys`` (key). Every task merges its keys into words, and words are merged by OR."""
        per, hashes = LATER if level else FIRST
        out = cls(level, max(64, ceil(n * per / 64) * 64), hashes)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
        places = keys.select(F.explode(out.places(F.col("key"))).alias("p"))
        merged = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
        dense = [0] * (out.bits // 64)
        for r in merged.toLocalIterator():  # MOST_BITS bound it
            dense[r["w"]] = r["bits"]
        out.words = ",".join(map(str, dense))
        return out

    def places(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.lit(self.level * 64 + i), key), F.lit(self.bits).cast("long")) for i in range(self.hashes)])

    def may_have(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded once, when the plan is made
        return F.forall(self.places(key), lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)


@dataclass
class Cascade:
    filters: list[Filter]

    @classmethod
    def of(cls, listed: DataFrame, n: int, universe: DataFrame) -> Cascade:
        """Of the ``n`` distinct keys ``listed`` (key), exact for them and all keys of ``universe`` (key)."""
        filters: list[Filter] = []
        now, other = listed, universe.join(listed, "key", "left_anti")
        while n:
            f = Filter.of(now, n, len(filters))
            filters.append(f)
            now, other = cut(other.filter(f.may_have(F.col("key"))).distinct()), now
            n = now.count()
        return cls(filters)

    def has(self, key: Column) -> Column:
        """A filter that doesn't have the key decides: those at even places hold listed keys, the others unlisted ones. Of a key that all may have, the last one says."""
        out = F.lit(len(self.filters) % 2 == 1)
        for i, f in reversed(list(enumerate(self.filters))):
            out = F.when(~f.may_have(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def candidates(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys under which a URL can be listed, longest first: its host's last 1 to ``labels`` labels, and the whole host's suffixes so, with prefixes of its path of those lengths.

    An array of n (length of the key), h (length of its host) and key.
    """
    own = F.size(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, labels)), own)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, 1, n))
    each = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((F.length(s) + F.length(p)).alias("n"), F.length(s).alias("h"), F.concat(s, p).alias("key")))))
    return F.when(host == "", F.array().cast("array<struct<n:int,h:int,key:string>>")).otherwise(F.sort_array(each, asc=False))


def _listed(cascade: Cascade):
    return lambda k: cascade.has(k["key"])


def longest(urls: DataFrame, lists: dict[str, DataFrame], keys_col: str) -> DataFrame:
    """``urls`` with a column per list (of keys): the longest of the row's candidates that is listed, or null.

    Lists that fit into MOST_BITS are cascades over all candidates of ``urls``;
    longer ones are joined with the candidates.
    """
    universe = None
    for name, listed in lists.items():
        listed = cut(listed.select("key").distinct())
        n = listed.count()
        if not n:
            urls = urls.withColumn(name, F.lit(None).cast("struct<n:int,h:int,key:string>"))
        elif n * FIRST[0] <= MOST_BITS:
            if universe is None:
                universe = cut(urls.select(F.explode(F.col(keys_col).getField("key")).alias("key")).distinct())
            cascade = Cascade.of(listed, n, universe)
            urls = urls.withColumn(name, F.get(F.filter(keys_col, _listed(cascade)), F.lit(0)))
        else:
            row = free_name("row", urls)
            urls = cut(urls.withColumn(row, F.monotonically_increasing_id()))
            met = urls.select(row, F.explode(keys_col).alias(name)).withColumn("key", F.col(name)["key"]).join(listed, "key", "left_semi")
            urls = urls.join(met.groupBy(row).agg(F.max(name).alias(name)), row, "left").drop(row)
    return urls


def listed_hosts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """host, path (empty): of all hosts of ``urls`` what LISTED names, from the label with the word on."""
    hosts = urls.select(host_of(F.col(url_col).cast("string")).alias("host")).distinct()
    return hosts.select(F.regexp_extract("host", LISTED, 1).alias("host"), F.lit("").alias("path")).filter("host <> ''").distinct()


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    ``rules`` (host, path, verdict) and ``listed`` (host, path; blocked where no
    rule fits) fit a host and its subdomains, and paths that start with
    theirs; the longest rule wins, of equally long ones that of the longer
    host, of the same one with both verdicts the block. Rules with a null or
    an empty host are none. Null URLs and those without ``://`` have an empty
    host and path and fit nothing; repeated rows each count; an empty table
    gives no rows, and other columns are not looked at.
    """
    key = F.concat(ascii_lower(F.col("host")), F.col("path"))
    named = [x.filter("host <> '' AND path IS NOT NULL") for x in (rules, listed)]
    shape = named[0].select("host", "path").union(named[1].select("host", "path"))
    size = shape.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), size["labels"] or 1, size["lengths"]))
    lists = {v: named[0].filter(F.col("verdict") == v).select(key.alias("key")) for v in ("allow", "block")} | {"own": named[1].select(key.alias("key"))}
    urls = longest(urls, lists, "keys")
    said = [F.when(F.col(v).isNotNull(), F.struct(F.col(f"{v}.n"), F.col(f"{v}.h"), F.lit(v).alias("verdict"), F.col(f"{v}.key").alias("rule"))) for v in ("allow", "block")]
    urls = urls.withColumn("said", F.greatest(*said))
    own = F.when(F.col("own").isNull(), "allow").otherwise("block")
    return urls.select("page_id", "host", "path", F.col("said.rule").alias("rule"), F.coalesce("said.verdict", own).alias("verdict"), F.col("own.key").alias("listed"))


def base_rules(spark: SparkSession) -> DataFrame:
    each = [F.struct(*[F.lit(x).alias(c) for c, x in zip(("host", "path", "verdict"), r)]) for r in RULES]
    return spark.range(1).select(F.inline(F.array(*each)))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, base_rules(spark), cut(listed_hosts(pages)))


OP12_SQL = rf"""
WITH r AS (SELECT * FROM (VALUES {", ".join(map(str, RULES))}) t(rh, rp, rv)),
u AS (SELECT row_number() OVER () AS row_no, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_no, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT row_no, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row_no)
SELECT page_id, host, path, rule, CASE WHEN rv IS NOT NULL THEN rv WHEN regexp_matches(host, '{LISTED}') THEN 'block' ELSE 'allow' END AS verdict,
       nullif(regexp_extract(host, '{LISTED}', 1), '') AS listed
FROM p LEFT JOIN f USING (row_no)
"""
