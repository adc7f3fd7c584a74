"""Language identification by interpolated Kneser-Ney character models.

Character 4-grams are counted per language over all training rows, and Spark
takes from all of them what Kneser-Ney needs: totals and numbers of distinct
successors of every context, and below the 4-grams the numbers of distinct
characters that precede. A language's model is a set of sorted hash arrays, and
the language with the lowest cross-entropy per character wins. How high that may
be before a text is rejected is calibrated, per language, on the scores of all
training rows.

Nothing is cut from a model. One that is too large to send is sent in parts: all
that a place of a text asks for has the same character before its last, so a
part has the grams of some of these characters, each part scores its own places,
and the sums are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasight.llm.common import cut, pieces, table

ORDER = 4
#: Grams of a part of the models, all languages together; a part is 24 bytes a gram, on the driver and on each executor.
PART_GRAMS = 2_000_000
#: Rejected: cross-entropies so many deviations above the training rows' mean.
REJECT_SD = 8.0
#: The least deviation to reckon with: texts of one line or of two languages are rough, and stay.
LEAST_SD = 0.2
UNKNOWN = "und"
_DISCOUNT = 0.75
_OTHER = 1.0 / 100_000  # of a character that training never showed
_PAD = " " * (ORDER - 1)
#: Characters that are scored or counted at a time, and distinct grams that a task holds.
_STEP, _HELD = 250_000, 300_000
_NO_LETTER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)


def plain(text: str | None) -> str:
    """Lower-cased letters, everything between them one space; empty without a letter."""
    s = _NO_LETTER.sub(" ", (text or "").lower()).strip()
    return s if any(map(str.isalpha, s)) else ""


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _quads(c: np.ndarray, stacked: bool) -> tuple[np.ndarray, ...]:
    """The four characters that end at each place, the first one first; of a text, or of grams given as four rows."""
    return tuple(c) if stacked else (c[:-3], c[1:-2], c[2:-1], c[3:])


def _grams(c: np.ndarray, stacked: bool = False) -> list[np.ndarray]:
    """Keys of the n-grams that end at each character from the fourth on: n = 1 to 4. To three characters they are exact."""
    four, three, two, one = _quads(c, stacked)
    h2 = two << _BITS | one
    h3 = three << (_BITS * np.uint64(2)) | h2
    return [one, h2, h3, h3 + four * _MIX]


def _contexts(c: np.ndarray, stacked: bool = False) -> list[np.ndarray | None]:
    """Keys of what stands before the last character of those n-grams: n = 1 has none."""
    four, three, two, _ = _quads(c, stacked)
    h = three << _BITS | two
    return [None, two, h, four << (_BITS * np.uint64(2)) | h]


class _Sorted:
    """Values by key, in sorted arrays."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        o = np.argsort(keys)
        self.keys, self.values = keys[o], [v[o] for v in values]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), [np.zeros(len(keys)) for _ in self.values]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, [v[at] for v in self.values]


class KneserNey:
    """One language, or a part of it: own probabilities of grams of every order, and what each context leaves to the next lower order."""

    def __init__(self, level: np.ndarray, before: np.ndarray, last: np.ndarray, own: np.ndarray, share: np.ndarray):
        """Rows of ``model_grams``."""
        self.levels: list[tuple[_Sorted, _Sorted | None]] = []
        for n in range(1, ORDER + 1):
            of = level == n
            d, c, b, a = last[of] & _MASK, last[of] >> _BITS, before[of] & _MASK, before[of] >> _BITS
            padded = np.stack([a, b, c, d], axis=1).astype(np.uint64)
            keys = _grams(padded.T, True)[n - 1]
            if n == 1:
                self.levels.append((_Sorted(keys, own[of]), None))
                self.rest = float(share[of][0]) * _OTHER if of.any() else 0.0
            else:
                ctx, first = np.unique(_contexts(padded.T, True)[n - 1], return_index=True)
                self.levels.append((_Sorted(keys, own[of]), _Sorted(ctx, share[of][first])))

    def prob(self, grams: list[np.ndarray], contexts: list[np.ndarray | None]) -> np.ndarray:
        p = np.full(len(grams[0]), self.rest)
        for (own, before), g, ctx in zip(self.levels, grams, contexts):
            seen, (v,) = own.get(g)
            if before is not None:
                known, (share,) = before.get(ctx)
                p = np.where(known, share * p, p)
            p = p + np.where(seen, v, 0)
        return p


class Model:
    """The models of all languages, or the part of them with the characters whose code is ``part`` of ``parts``."""

    def __init__(self, names: list[str], models: list[KneserNey], part: int = 0, parts: int = 1):
        self.names, self.models, self.part, self.parts = names, models, part, parts
        # 4-grams scored so far in this worker, with -log p by language; HELD at most
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(names)))

    def _scored(self, keys: np.ndarray, grams: list[np.ndarray], contexts: list[np.ndarray | None], first: np.ndarray) -> np.ndarray:
        """-log p of distinct 4-grams (sorted keys, which stand at ``first`` in grams and contexts): a row each, a column per language."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        out = np.empty((len(keys), len(self.names)))
        out[~new] = self.scores[at[~new]]
        if new.any():
            f = first[new]
            g, x = [a[f] for a in grams], [None if a is None else a[f] for a in contexts]
            for i, m in enumerate(self.models):
                out[new, i] = -np.log(m.prob(g, x))
            if len(self.keys) + int(new.sum()) > _HELD:
                self.keys, self.scores = keys, out
            else:
                every = np.concatenate([self.keys, keys[new]])
                order = np.argsort(every)
                self.keys, self.scores = every[order], np.concatenate([self.scores, out[new]])[order]
        return out

    def nats(self, texts: list[str]) -> np.ndarray:
        """Sums of -log p over the part's places: a row per text, a column per language. No text may be empty."""
        padded = [f"{_PAD}{t} " for t in texts]
        sizes = np.array([len(t) - len(_PAD) for t in padded])
        c = _codes("".join(padded))
        grams, contexts = _grams(c), _contexts(c)
        starts = np.concatenate([[0], np.cumsum(sizes + len(_PAD))[:-1]])
        # a position counts for the text that it ends in; between two texts only padding ends
        inside = np.ones(len(grams[0]), bool)
        for k in range(len(_PAD)):
            inside[starts[1:] - len(_PAD) + k] = False
        if self.parts > 1:
            mine = c[2:-1] % np.uint64(self.parts) == self.part
        keys, first, back = np.unique(grams[-1], return_index=True, return_inverse=True)
        scored, back = self._scored(keys, grams, contexts, first), back[inside]
        bounds = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = []
        for i in range(len(self.models)):
            v = scored[back, i]
            if self.parts > 1:
                v = np.where(mine[inside], v, 0)
            out.append(np.add.reduceat(v, bounds))
        return np.stack(out, axis=1)


def _steps(texts: list[str]) -> Iterator[list[int]]:
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t)
        if size >= _STEP:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Counts:
    """4-grams of a language so far, as keys, both halves and numbers."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, s: str) -> None:
        c = _codes(s)
        keys, first, n = np.unique(_grams(c)[-1], return_index=True, return_counts=True)
        d, x, b, a = c[first + 3], c[first + 2], c[first + 1], c[first]
        real = (x != 32) | (d != 32)  # what ends in two spaces is padding
        self.parts.append(tuple(v[real] for v in (keys, a << _BITS | b, x << _BITS | d, n.astype(np.int64))))
        self.size += int(real.sum())
        if len(self.parts) > 16:
            self.merge()

    def merge(self) -> None:
        keys, hi, lo, n = (np.concatenate(v) for v in zip(*self.parts))
        keys, first, where = np.unique(keys, return_index=True, return_inverse=True)
        self.parts = [(keys, hi[first], lo[first], np.bincount(where, weights=n).astype(np.int64))]
        self.size = len(keys)

    def batch(self, lang: str) -> pa.RecordBatch:
        self.merge()
        keys, hi, lo, n = self.parts[0]
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(n)], names=["lang", "before", "last", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Counts] = {}
    for b in pieces(batches):
        langs, texts = b.column("lang").to_pylist(), [plain(t) for t in b.column("text").to_pylist()]
        for part in _steps(texts):
            rows: dict[str, list[str]] = {}
            for i in part:
                if texts[i]:
                    rows.setdefault(langs[i], []).append(f"{_PAD}{texts[i]} ")
            for lang, own in rows.items():
                held.setdefault(lang, _Counts()).add("".join(own))
            if sum(x.size for x in held.values()) > _HELD:
                for x in held.values():
                    x.merge()
            while sum(x.size for x in held.values()) > _HELD:  # the largest goes on its way
                most = max(held, key=lambda x: held[x].size)
                yield held.pop(most).batch(most)
    for lang, counts in held.items():
        yield counts.batch(lang)


def model_grams(rows: DataFrame) -> DataFrame:
    """lang, level, before, last, own, share: every gram of one to four characters that the columns text and lang of ``rows`` show.

    before and last hold two characters each, 21 bits a character; what a
    shorter gram lacks is zero. own is the discounted probability after the
    gram's context, share what that context leaves to the next lower order.
    Null langs and texts without letters teach nothing.
    """
    grams = rows.filter("lang is not null").select("lang", "text").mapInArrow(_count, "lang string, before long, last long, n long").groupBy("lang", "before", "last").agg(F.sum("n").alias("n"))
    char = (1 << 21) - 1
    out = None
    for level in range(ORDER, 0, -1):
        grams = cut(grams)
        # successors of a context are at most as many as there are characters
        after = Window.partitionBy("lang", "before", F.shiftright("last", 21))
        total = F.sum("n").over(after)
        this = grams.select("lang", F.lit(level).alias("level"), "before", "last", ((F.col("n") - _DISCOUNT) / total).alias("own"), (_DISCOUNT * F.count("*").over(after) / total).alias("share"))
        out = this if out is None else out.union(this)
        # without its first character
        shorter = {4: [F.col("before").bitwiseAND(F.lit(char)), F.col("last")], 3: [F.lit(0).cast("long"), F.col("last")], 2: [F.lit(0).cast("long"), F.col("last").bitwiseAND(F.lit(char))]}.get(level)
        if shorter:
            grams = grams.groupBy("lang", shorter[0].alias("before"), shorter[1].alias("last")).agg(F.count("*").alias("n"))
    return out


def models(rows: DataFrame, part_grams: int = PART_GRAMS) -> Iterator[Model]:
    """The parts of the models of ``rows``, one after the other; of all characters if there is but one."""
    grams = cut(model_grams(rows))
    size = grams.count()
    names = [r["lang"] for r in grams.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    parts = max(1, -(-size // part_grams))
    for part in range(parts):
        # single characters go into every part, and so do the spaces before a text
        own = grams if parts == 1 else grams.filter((F.col("level") == 1) | (F.pmod(F.shiftright("last", 21), F.lit(parts)) == part))
        t = own.toArrow()
        at = {n: i for i, n in enumerate(names)}
        lang = np.array([at[x] for x in t.column("lang").to_pylist()], int)
        columns = [t.column(c).to_numpy() for c in ("level", "before", "last", "own", "share")]
        of = [[v[lang == i] for v in columns] for i in range(len(names))]
        yield Model(names, [KneserNey(x[0], x[1].astype(np.uint64), x[2].astype(np.uint64), x[3], x[4]) for x in of], part, parts)


def _verdict(sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cross-entropies per character: the best language, how sure it is, its own."""
    nats = sums / sizes[:, None]
    best = nats.argmin(axis=1)
    low = nats[np.arange(len(nats)), best]
    sure = 1 / np.exp((low[:, None] - nats) * np.minimum(sizes[:, None], 50)).sum(axis=1)
    return best, np.minimum(sure, 1.0), low


def score(docs: DataFrame, training: DataFrame, part_grams: int = PART_GRAMS) -> DataFrame:
    """The columns of ``docs`` but text, and lang_pred, score, nats (cross-entropy per character, null for ``und``), by the models of ``training``."""
    keep = [c for c in docs.columns if c != "text"]
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    verdict = "lang_pred string, score double, nats double"

    def sums_of(m: Model, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Sums and sizes (0: no letter) of a batch's texts."""
        texts = [plain(t) for t in b.column("text").to_pylist()]
        sums, sizes = np.zeros((len(texts), len(m.names))), np.array([len(t) + 1 if t else 0 for t in texts], float)
        for part in _steps(texts) if m.names else ():
            own = [i for i in part if texts[i]]
            if own:
                sums[own] = m.nats([texts[i] for i in own])
        return sums, sizes

    def batch(columns: list, names: list[str], sums: np.ndarray, sizes: np.ndarray, langs: list[str]) -> pa.RecordBatch:
        pred, conf, nats = [UNKNOWN] * len(sizes), [0.0] * len(sizes), [None] * len(sizes)
        own = np.flatnonzero(sizes) if langs else []
        if len(own):
            for i, k, s, x in zip(own.tolist(), *(v.tolist() for v in _verdict(sums[own], sizes[own]))):
                pred[i], conf[i], nats[i] = langs[k], s, x
        return pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(conf, pa.float64()), pa.array(nats, pa.float64())], names=[*names, "lang_pred", "score", "nats"])

    sc, made, whole = docs.sparkSession.sparkContext, [], None
    for model in models(training, part_grams):
        shared = sc.broadcast(model)
        if model.parts == 1:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                m = shared.value
                for b in pieces(batches):
                    yield batch([b.column(c) for c in keep], keep, *sums_of(m, b), m.names)

            return docs.select(*keep, "text").mapInArrow(run, f"{head}, {verdict}" if head else verdict)

        def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in pieces(batches):
                sums, sizes = sums_of(m, b)
                yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(sizes), pa.array(list(sums), pa.list_(pa.float64()))], names=["_row", "_size", "_sums"])

        if whole is None:
            whole = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
        made.append(cut(whole.select("_row", "text").mapInArrow(part, "_row long, _size double, _sums array<double>")))
        shared.unpersist()
    langs = model.names
    # the parts' sums of a text, added up
    add = [F.sum(F.get("_sums", i)).alias(f"_{i}") for i in range(len(langs))]
    rows = reduce(DataFrame.union, made).groupBy("_row").agg(F.first("_size").alias("_size"), *add).select("_row", "_size", F.array(*[f"_{i}" for i in range(len(langs))]).alias("_sums"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.array(b.column("_sums").to_pylist(), float).reshape(len(b), len(langs))
            yield batch([b.column(c) for c in keep], keep, sums, b.column("_size").to_numpy(), langs)

    return whole.drop("text").join(rows, "_row").mapInArrow(judge, f"{head}, {verdict}" if head else verdict)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", part_grams: int = PART_GRAMS, reject_sd: float = REJECT_SD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, nats, rejected.

    Learns from the rows whose crc32(doc_id as text) mod 3 is not 1 and whose
    lang is not null; the others are held out. lang_pred is ``und`` where the
    text is null or has no letter, or nothing could be learned. Rejected are
    those and texts whose cross-entropy is over ``reject_sd`` deviations above
    the mean of the training rows of that language. A null doc_id isn't held
    out; repeated rows each count; ties go to the first language by name; an
    empty table gives an empty result. The models' parts, of ``part_grams``,
    change nothing but how they are sent.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    scored = cut(score(d, d.filter("not held_out"), part_grams))
    limits = scored.filter("not held_out and lang = lang_pred").groupBy("lang_pred").agg((F.avg("nats") + reject_sd * F.greatest(F.coalesce(F.stddev("nats"), F.lit(0.0)), F.lit(LEAST_SD))).alias("most"))
    far = (F.col("lang_pred") == UNKNOWN) | F.coalesce(F.col("nats") > F.col("most"), F.lit(False))
    # one row per language of the model, whose names the driver holds
    return scored.join(F.broadcast(limits), "lang_pred", "left").select("doc_id", "held_out", "lang_pred", "score", "nats", far.alias("rejected"))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that language ID rejects.

    doc_id names a document: rows that repeat one go if any of them is
    rejected, and rows without one stay. A null or letterless text is rejected;
    an empty table stays empty; other columns aren't looked at.
    """
    gone = identify(docs, id_col, **how).filter("rejected").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "nats", "rejected")
