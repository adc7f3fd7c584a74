"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

In byte-pair encoding the last token of a prefix's encoding fixes the rest:
what stands before that token is encoded as that shorter prefix is. The last
token is the one suffix that is a token and whose border with the last token
before it is never merged away. So distinct words are put in order, which is
the depth-first order of their trie, the last-token state of every node is
kept along the path, and a shared prefix is encoded once.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasight.llm.common import pieces, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The published pattern of byte-level BPE: how a text is cut into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 40
#: Characters that are cut into words at a time, and words and token borders kept from one time to the next.
_STEP, _KEPT, _BORDERS = 200_000, 100_000, 400_000


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {as_bytes(t): i for t, i in vocab.items() if t not in self.special}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        # by the last three bytes the lengths of tokens that end so, longest first
        lengths: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) > 2:
                lengths.setdefault(b[-3:], {1, 2}).add(len(b))
        self.lengths = {b: tuple(sorted(n, reverse=True)) for b, n in lengths.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # of two tokens: rank, token
        halves: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair, whole = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.merged[pair] = rank, whole
            halves.setdefault(whole, (rank, *pair))
        # a token's outer pieces on one side, from the single byte up, each with the rank at which it is merged away
        self.right, self.left = ({t: self._outer(t, halves, side) for t in self.ids.values()} for side in (2, 1))
        self.borders: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(WORDS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

    @staticmethod
    def _outer(token: int, halves: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, int]]:
        out, gone = [(token, _NEVER)], token
        while gone in halves:
            rank, gone = halves[gone][0], halves[gone][side]
            out.append((gone, rank))
        return out[::-1]

    def border(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of two tokens gives the two: no pieces that meet at the border are merged before they are merged away from it."""
        key = a << 20 | b
        known = self.borders.get(key)
        if known is not None:
            return known
        rights, lefts, i, j, keeps = self.right[a], self.left[b], 0, 0, True
        while True:
            (x, x_gone), (y, y_gone) = rights[i], lefts[j]
            rank = self.merged.get((x, y), (_NEVER,))[0]
            if rank < x_gone and rank <= y_gone:  # of equal ranks the leftmost goes first
                keeps = False
                break
            if x_gone == y_gone == _NEVER:
                break
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1
        if len(self.borders) > _BORDERS:
            self.borders.clear()
        self.borders[key] = keeps
        return keeps

    def learn(self, words: set[str]) -> None:
        """Encode distinct words: their sorted bytes are the trie, depth first."""
        ids, lengths, border, put = self.ids, self.lengths.get, self.border, self.words
        last, size = [-1], [0]  # at each depth of the path: the last token and its length
        before, short = b"", (2, 1)
        for data, word in sorted((w.encode(), w) for w in words):
            n, shared = len(data), 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for long in lengths(data[end - 3 : end], short) if end > 2 else short:
                    start = end - long
                    if start < 0:
                        continue
                    token = ids.get(data[start:end])
                    if token is not None and (start == 0 or border(last[start], token)):
                        last.append(token)
                        size.append(long)
                        break
                else:
                    raise ValueError(f"no token ends at byte {end} of {word!r}")
            out, at = [], n
            while at:
                out.append(last[at])
                at -= size[at]
            put[word] = array("I", out[::-1]).tobytes()
            before = data

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        parts = [[(p, p in self.special) for p in self.cut(t) if p] for t in texts]
        cuts = [[[p] if special else self.split(p) for p, special in x] for x in parts]
        if len(self.words) > _KEPT:
            self.words.clear()
        for t, i in self.special.items():
            self.words[t] = array("I", [i]).tobytes()
        self.learn({w for x in cuts for words in x for w in words}.difference(self.words))
        get = self.words.__getitem__
        return [b"".join([get(w) for words in x for w in words]) for x in cuts]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> Bpe:
    """One per Python worker."""
    return Bpe(path)


def _steps(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= _STEP:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids with the decoded text or, with ``digests``, their SHA-256.

    The whole text is encoded; a null text counts as empty and has no ids.
    Every row of ``docs`` gives a row, repeated ones too; other columns aren't
    looked at. ``path`` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tail = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in pieces(batches):
            n, first, second = [], [], []
            for texts in _steps([t or "" for t in b.column("text").to_pylist()]):
                for ids in bpe.encode_batch(texts):
                    n.append(len(ids) // 4)
                    text = bpe.decode(ids)
                    first.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<u4").astype("i4"))
                    second.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, k) for x, (_, k) in zip((first, second), tail))], names=["doc_id", "n_tokens", *(x for x, _ in tail)])

    out = ", ".join(f"{x} {'string' if k == pa.string() else 'array<int>'}" for x, k in tail)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, {out}")


def decode(encoded: DataFrame, path: str = TOKENIZER, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with text: the ids decoded (null ids: null), special tokens included."""

    @F.pandas_udf("string")
    def run(ids):
        bpe = tokenizer(path)
        return ids.map(lambda x: None if x is None else bpe.decode(np.asarray(x, "<u4").tobytes()))

    return encoded.withColumn("text", run(ids_col))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
