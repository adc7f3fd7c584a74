"""Personal data, and information-theoretic sanitisation of what gives it away.

Emails, IP addresses, card and phone numbers are found by pattern, and so are
secrets: long values without a word's regularity, alone or after a name that
says what they are. Words near
them are then held against the whole corpus: a word gives an entity (one value,
or its whole kind) away as far as seeing it makes that entity less surprising,
their pointwise mutual information. If that is ``alpha`` of the entity's own
information content or above, even at the lower bound that the number of the
word's places supports, and if at that bound half of its places or more are
beside the entity, in two rows or more, the word is disclosing, and all its
places become spans. The second condition keeps a word with a place or two from
telling in a large corpus, where any value is surprising.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from seasight.llm.common import cut, free_name, pieces, table

#: Kinds of personal data; the first BASE have a fixed pattern each.
KINDS, BASE = ("email", "ip", "card", "phone", "secret"), 4
TERM = "term"
#: Words before and after personal data that are held to be near it.
NEAR = 5
#: Share of an entity's information content that a word may give away, and the deviations of the lower bound (Wilson's, one-sided 95 %) on it.
ALPHA, DEVIATIONS = 0.9, 1.645
#: Share of a word's places, at that lower bound, and rows that a telling word has beside the entity, whatever the corpus's size.
LEAST_SHARE, LEAST_ROWS = 0.5, 2
#: What a word's places are counted under: below ALL is a kind, ALL every place, and a value is below zero.
ALL = len(KINDS)
#: Bits of Spark's bitmap buckets, bits a word, and most bits (128 MB), of the filters that the second pass looks words up in; a join then decides.
_BUCKET, _PER_WORD, _MOST_BITS = 1 << 15, 32, 1 << 30
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Values after a name that promises a secret, hexadecimal runs, and keys that name themselves.
_NAMED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{0,40}(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|(?:access|private|auth)[_-]?key|credential)[A-Za-z0-9_-]{0,40}[\"']?\s{0,8}(?::=|=>|=|:)\s{0,8}[\"']?([A-Za-z0-9+/_.~-]{12,}={0,2})", re.I)
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])")
#: A secret has letters and digits, and this many bits of information by its own letters' frequencies.
LEAST_BITS = 32.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed: leftmost, non-overlapping per kind, failing matches dropped."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):  # the local part is what stands before, in one run, and not in the match before
        at = m.start()
        while at > last and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            out.append((at, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def bits(value: str) -> float:
    """Information of a string by the frequencies of its own characters."""
    n = len(value)
    return -sum(c * log2(c / n) for c in Counter(value).values())


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """``base_spans``, and secrets that don't overlap any of them or each other."""
    out = [(s, KINDS.index(k), e) for k, s, e in base_spans(text)]
    found = [m.span(1) for m in _NAMED.finditer(text)] if "=" in text or ":" in text else []
    found += [m.span() for p in (_HEX, _KEY) for m in p.finditer(text)]
    taken, upto, i, own = sorted((s, e) for s, _, e in out), 0, 0, []
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][0] < e:
            upto = max(upto, taken[i][1])
            i += 1
        value = text[s:e]
        if s >= upto and re.search("[A-Za-z]", value) and re.search("[0-9]", value) and bits(value) >= LEAST_BITS:
            own.append((s, KINDS.index("secret"), e))
            upto = e
    return [(KINDS[k], s, e) for s, k, e in sorted(out + own)]


def free_words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The text's words that no span touches; spans come by start."""
    i, upto = 0, 0
    for m in _WORD.finditer(text):
        while i < len(spans) and spans[i][1] < m.end():
            upto = max(upto, spans[i][2])
            i += 1
        if m.start() >= upto:
            yield m


def near_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str, int]]:
    """(start, end, word, kind, entity) of up to NEAR words on either side of each span, however far; words inside any span don't count."""
    out, free = set(), [(m.start(), m.end(), m[0].lower()) for m in free_words(text, spans)]
    for kind, s, e in spans:
        at, own = bisect_left(free, (s,)), entity(kind, text[s:e])
        out.update((*x, kind, own) for x in free[max(0, at - NEAR) : at + NEAR])
    return sorted(out)


def _id(word: str) -> int:
    x = xxh64_intdigest(word.encode("utf-8", "replace"))
    return x - (1 << 64) if x >= 1 << 63 else x


def entity(kind: str, value: str) -> int:
    """Hash, below zero, of the normalised value: of an email in lower case, of an IP address its numbers, of a secret itself, of the others their digits."""
    value = value.lower() if kind == "email" else ".".join(x.lstrip("0") or "0" for x in value.split(".")) if kind == "ip" else value if kind == "secret" else "".join(_DIGITS.findall(value))
    return -1 - (_id(f"{kind}:{value}") & (1 << 63) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, entity, n, n_rows: a word's places in the batch, all of them (ALL, without rows), and those near each kind and each value."""
    for b in batches:
        raw, counts, rows = Counter(), Counter(), Counter()
        for value in b.column("text"):
            text = value.as_py() or ""
            raw.update(_WORD.findall(text))
            own = all_spans(text)
            if own:
                near = near_words(text, own)
                places = {(s, w, x) for s, _, w, k, v in near for x in (KINDS.index(k), v)}
                counts.update((w, x) for _, w, x in places)
                rows.update({(w, x) for _, w, x in places})
        for w, n in raw.items():
            counts[w.lower(), ALL] += n
        ids = {w: _id(w) for w in {w for w, _ in counts}}
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[w] for w, _ in counts], pa.int64()), pa.array([x for _, x in counts], pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.array([rows[k] for k in counts], pa.int64())],
            names=["word", "entity", "n", "n_rows"],
        )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_WORDS = pa.list_(pa.struct([("word", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))


def _filter(words: DataFrame) -> np.ndarray:
    """Bits of the column word, as bytes: a power of two, _PER_WORD a word or more, up to _MOST_BITS (beyond, more words pass on to the join)."""
    size = min(_MOST_BITS, max(_BUCKET, 1 << (_PER_WORD * words.count()).bit_length()))
    v = F.pmod("word", F.lit(size)) + 1
    out = np.zeros(size // 8, np.uint8)
    for r in words.groupBy(F.bitmap_bucket_number(v).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits")).collect():
        at = (r["at"] - 1) * _BUCKET // 8
        out[at : at + _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _held(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.mod(ids, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7)) & 1 > 0


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans (start, kind, end) generalised: personal data to its kind, disclosing words to dots."""
    out, last = [], 0
    for s, k, e in sorted(spans):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k]}]" if k < len(KINDS) else "[...]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _read(near_bits, all_bits):
    """Of a text: its spans, the places of words that may be disclosing (those near a span, and those with places elsewhere), and the digest of the sanitised text, or the text where such words are left to judge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [x.as_py() or "" for x in b.column("text")]
            owns = [all_spans(t) for t in texts]
            known = list({w for t in texts for w in _WORD.findall(t)})
            ids = np.array([_id(w.lower()) for w in known], np.int64)
            beside, anywhere = ({known[i]: int(ids[i]) for i in np.flatnonzero(_held(x.value, ids))} for x in (near_bits, all_bits))
            words = []
            for text, own in zip(texts, owns):
                places: dict[int, list] = {}
                if beside and own:
                    for s, e in {(s, e) for s, e, *_ in near_words(text, own)}:
                        if text[s:e] in beside:
                            places.setdefault(beside[text[s:e]], []).append((s, e))
                if anywhere and not anywhere.keys().isdisjoint(_WORD.findall(text)):
                    for m in free_words(text, own):
                        if m[0] in anywhere:
                            places.setdefault(anywhere[m[0]], []).append(m.span())
                words.append([{"word": w, "places": [{"start": s, "end": e} for s, e in sorted(set(x))]} for w, x in places.items()])
            found = [[(s, KINDS.index(k), e) for k, s, e in own] for own in owns]
            clean = [None if w else _sha(sanitised(t, f)) for t, f, w in zip(texts, found, words)]
            left = [t if w else None for t, w in zip(texts, words)]
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_no"), b.column("doc_id"), pa.array(spans, _SPANS), pa.array(words, _WORDS), pa.array(clean, pa.string()), pa.array(left, pa.string())], names=["row_no", "doc_id", "spans", "words", "clean", "left"]
            )

    return run


def counted(texts: DataFrame) -> DataFrame:
    """word, entity, n, n_rows: places (and rows) in parts, of every word (entity ALL) and of those near a kind or a value."""
    return cut(texts.select("text").mapInArrow(_count, "word long, entity long, n long, n_rows long"))


def judge(got: DataFrame, alpha: float = ALPHA, deviations: float = DEVIATIONS, least_share: float = LEAST_SHARE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """word, entity, n_pair, n_rows, n_word, n_entity, elsewhere, tells, of ``counted``: pairs that have ``alpha`` of the entity's content, and whether the evidence does."""
    words = got.filter(F.col("entity") == ALL).groupBy("word").agg(F.sum("n").alias("n_word"))
    pairs = cut(got.filter(F.col("entity") != ALL).groupBy("word", "entity").agg(F.sum("n").alias("n_pair"), F.sum("n_rows").alias("n_rows")))
    total = got.filter(F.col("entity") == ALL).agg(F.sum("n")).first()[0]
    n = F.lit(float(total or 1))
    # an entity has one place at least: words with too small a share near any go before their pairs are joined
    most = pairs.groupBy("word").agg(F.max("n_pair").alias("most"))
    known = cut(words.join(most, "word").filter(F.log(F.col("most") / F.col("n_word")) >= (alpha - 1) * F.log(n)))
    judged = cut(pairs.join(known, "word"))
    facts = pairs.groupBy("entity").agg(F.sum("n_pair").alias("n_entity"))
    # a few kinds, held by many words, and many values, held by few words each
    judged = judged.filter("entity >= 0").join(F.broadcast(facts.filter("entity >= 0")), "entity").union(judged.filter("entity < 0").join(facts.filter("entity < 0"), "entity"))
    m, p, z = F.col("n_word"), F.col("n_pair") / F.col("n_word"), deviations
    low = (p + z * z / 2 / m - z * F.sqrt(p * (1 - p) / m + z * z / 4 / m / m)) / (1 + z * z / m)
    enough = lambda share: F.log(share * n / F.col("n_entity")) >= alpha * F.log(n / F.col("n_entity"))
    tells = enough(low) & (low >= least_share) & (F.col("n_rows") >= least_rows)
    return judged.filter(enough(p)).select("word", "entity", "n_pair", "n_rows", "n_word", "n_entity", (F.col("n_word") > F.col("most")).alias("elsewhere"), tells.alias("tells"))


def find(docs: DataFrame, alpha: float = ALPHA, deviations: float = DEVIATIONS, least_share: float = LEAST_SHARE, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row_no, doc_id, found and terms, both arrays of (start, kind, end), and clean, the SHA-256 of the sanitised text.

    kind is numbered as in KINDS, terms come after them. A word's counts are
    those of its places in the whole corpus; a place is near an entity, one
    value or all of its kind, if fewer than NEAR words stand between. PMI of
    word and entity is log(n(word, entity) * n / (n(word) * n(entity))), the
    entity's information content log(n / n(entity)), with n(entity) the places
    near it. In place of n(word, entity) / n(word) stands its lower bound at
    ``deviations``, so that few places count as little evidence but as some; it
    must also be ``least_share`` or more, over ``least_rows`` rows (copies are
    rows), however large the corpus. All places of a disclosing word outside
    personal data are terms, near it or not. Null and empty texts have no spans; repeated rows each count; ids may
    be null; an empty table gives an empty result. row_no is ``row_col``, or a
    number of its own.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    d = docs.select(row.alias("row_no"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    telling = cut(judge(counted(d), alpha, deviations, least_share, least_rows).filter("tells").groupBy("word").agg(F.bool_or("elsewhere").alias("elsewhere")))
    near_bits, all_bits = (d.sparkSession.sparkContext.broadcast(_filter(x)) for x in (telling, telling.filter("elsewhere")))
    rows = cut(d.mapInArrow(_read(near_bits, all_bits), f"row_no long, doc_id {kind}, spans array<struct<start:int,kind:int,end:int>>, words array<struct<word:long,places:array<struct<start:int,end:int>>>>, clean string, left string"))
    places = rows.select("row_no", F.explode("words").alias("x")).select("row_no", "x.word", "x.places").join(telling.select("word"), "word").select("row_no", F.explode("places").alias("p"))
    span = F.struct("p.start", F.lit(len(KINDS)).alias("kind"), "p.end")
    terms = places.groupBy("row_no").agg(F.array_sort(F.collect_list(span)).alias("terms"))
    out = rows.join(terms, "row_no", "left").withColumn("terms", F.coalesce("terms", F.slice("spans", 1, 0)))

    @F.pandas_udf("string")
    def digest(clean: pd.Series, texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([c if t is None else _sha(sanitised(t, [(x["start"], x["kind"], x["end"]) for x in own])) for c, t, own in zip(clean, texts, spans)], dtype="object")

    return out.select("row_no", "doc_id", F.col("spans").alias("found"), "terms", digest("clean", "left", F.concat("spans", "terms")).alias("clean"))


def _listed(spans):
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_private, n_terms, clean_sha256: ``find``, counted and written out; n_private counts all but terms."""
    found = find(docs, **how)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *map(count, range(BASE)),
        F.sha2(_listed(F.filter("found", lambda x: x["kind"] < BASE)), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("found", "terms"))).alias("spans"),
        *map(count, range(BASE, len(KINDS))),
        F.size("found").cast("long").alias("n_private"),
        F.size("terms").cast("long").alias("n_terms"),
        F.col("clean").alias("clean_sha256"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the text's personal data generalised to its kind in brackets and disclosing words to dots.

    Null texts stay null, rows may repeat, ids may be null, columns may have any
    names, and an empty table stays empty.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or own is None else sanitised(t, [(x["start"], x["kind"], x["end"]) for x in own]) for t, own in zip(texts, spans)], dtype="object")

    row, spans = free_name("row", docs), free_name("spans", docs)
    # a table of its own: the numbers of its rows stay what they are
    d = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = find(d, id_col=id_col, text_col=text_col, row_col=row, **how).select(F.col("row_no").alias(row), F.concat("found", "terms").alias(spans)).filter(F.size(spans) > 0)
    return d.join(found, row, "left").withColumn(text_col, clean(F.col(text_col).cast("string"), spans)).select(docs.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
