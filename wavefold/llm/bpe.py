"""BPE encoding and decoding with a public vocabulary file.

A word's parts and the ranks of adjacent parts stand in two short arrays; the least rank is searched again and again,
its boundary is deleted and the two neighbouring ranks are refreshed. Words of more than ``LONG`` symbols, for which
that would be quadratic, take the same merges from a heap. Words repeat, so each task keeps the codes of those it met.

Edge cases: null and empty texts have no tokens and decode to the empty string; the vocabulary's special strings in a
text become their ids; texts of any length are encoded whole; characters newer than unicodedata's tables keep their
case and composition; each row gives one row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches

LONG = 100
#: Words whose codes a task keeps.
KEPT = 1 << 18
_NONE = 1 << 60
#: Letters of Unicode 16.0, which the tokenizers library knows and unicodedata here does not.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_LETTER = regex.compile(r"\p{L}").match


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: its own where that is visible, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Codec(dict):
    """Word -> packed little-endian ids, filled as words come."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")
        self.find_latin = regex.compile(pattern).findall
        # Characters that regex knows from a later Unicode than the tokenizers library; there they are no letters.
        known = {i for a, b in LETTERS_16 for i in range(a, b + 1)}
        late = "".join(chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) == "Cn" and i not in known and _LETTER(chr(i)))
        self.find_any = regex.compile("(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{late}]]")).findall if late else self.find_latin
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        code = np.array(self.merge(word.encode()), "<u4").tobytes()
        self[word] = code
        return code

    def merge(self, word: bytes) -> list[int]:
        part = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(part) > LONG:
            return self.merge_long(part)
        get = self.rank.get
        ranks = [get(p, _NONE) for p in zip(part, part[1:])]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            part[i] = self.merged[least]
            del part[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((part[i], part[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get((part[i - 1], part[i]), _NONE)
        return part

    def merge_long(self, part: list[int]) -> list[int]:
        n, get = len(part), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((part[i], part[i + 1]), _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or get((part[i], part[j])) != r:
                continue
            part[i], part[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s := get((part[a], part[b]), _NONE)) < _NONE:
                    heapq.heappush(heap, (s, a))
        return [p for p in part if p >= 0]

    def encode(self, text: str) -> bytes:
        out = []
        for piece in self.cut(text) if "<" in text else [text]:
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                # one character at a time, so a last sigma is as any other
                lower = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                out += map(self.__getitem__, self.find(lower))
        return b"".join(out)

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text as an array<int> column, in place of any column of that name."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != ids_col]
    schema = docs.select(*keep).schema.add(ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            codes = [enc.encode(t or "") for t in batch.column(at).to_pylist()]
            offsets = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*keep, ids_col])

    return docs.select(*keep).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text that its ids stand for; null ids give the empty string."""
    small_batches(tokens.sparkSession)
    keep = [c for c in tokens.columns if c != text_col]
    schema = tokens.select(*keep).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            texts = [enc.decode(np.array(x or [], "<u4").tobytes()) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, text_col])

    return tokens.select(*keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the digests of its ids and of what they decode to: encode and decode in one pass over the texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path)
        for batch in batches:
            n, ids, out = [], [], []
            for t in batch.column(1).to_pylist():
                code = enc.encode(t or "")
                n.append(len(code) // 4)
                ids.append(hashlib.sha256(code).hexdigest())
                out.append(hashlib.sha256(enc.decode(code).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
