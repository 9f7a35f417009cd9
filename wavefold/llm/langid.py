"""Language identification by interpolated Kneser-Ney character models.

Counts of character 4-grams are summed by Spark over a bounded sample of labelled texts (``max_bytes`` for each
language, and ``most_bytes`` for all, chosen by a hash of the id; the first text by that hash is always in it and never
in the calibration part, so that each labelled language is learnt). The driver turns them into interpolated probabilities; each order is one sorted
array of 64-bit n-gram hashes with a column for each language. Every text goes to the language of lowest cross-entropy
per character. The calibration part of the sample (a tenth, not counted) has, for each language, the usual entropy of
its own texts and that of the others; a language without calibration texts takes the loosest of the others'. A text is
rejected if its entropy is above the middle of the two and also beyond what its language and length lead to expect.

Edge cases: null texts and texts without letters are ``und`` with score 0 and rejected, and not learnt from; with
nothing to learn from all texts are; ties go to the first language by name; rows with a null id are judged but not learnt from; each row gives
one row, and long texts are read whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import grams, materialise, mix, small_batches

ORDER = 4
#: Bytes of text for each language from which n-grams are counted.
MAX_BYTES = 4_000_000
#: And for all languages together: where there are many, each has an equal share.
MOST_BYTES = 200_000_000
#: A text is rejected beyond so many standard deviations from its language's usual entropy.
DEVIATIONS = 8.0


def _kinds() -> np.ndarray:
    """For each code point: 2 a letter, 1 a mark, 0 all else."""
    names = (unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1))
    return np.fromiter((2 if c == "L" else c == "M" for c in names), np.uint8, sys.maxunicode + 1)


KINDS: np.ndarray | None = None


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each behind ORDER - 1 spaces, with one space for each run of other characters;
    where each text begins, and the end; and whether it has a letter."""
    global KINDS
    if KINDS is None:
        KINDS = _kinds()
    pad = " " * (ORDER - 1)
    lower = [pad + (t or "").lower() + " " for t in texts]
    x = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.cumsum([0, *map(len, lower)])
    kind = KINDS[x]
    space = kind == 0
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    for j in range(ORDER - 1):
        keep[first[:-1] + j] = True
    has = np.maximum.reduceat(kind, first[:-1]) == 2 if len(texts) else np.zeros(0, bool)
    place = np.concatenate([[0], np.cumsum(keep)])[first]
    return np.where(space, 32, x)[keep], place, has


@dataclass
class Table:
    """A sorted array of hashes with an index over their top bits, and a row of values for each."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        top = max(1, len(self.keys).bit_length())  # about one key for each entry of the index
        self.shift = np.uint64(64 - top)
        self.start = np.searchsorted(self.keys, np.arange(1 << top, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in ``keys``, or -1."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        at = self.start[(h >> self.shift).astype(np.int64)]
        todo = None
        while True:
            here = np.minimum(at, len(self.keys) - 1)
            found = self.keys[here]
            same, less = found == h, (found < h) & (at < len(self.keys) - 1)
            if todo is None:
                out[same] = here[same]
                todo = np.flatnonzero(less)
            else:
                out[todo[same]] = here[same]
                todo = todo[less]
            if not len(todo):
                return out
            at, h = at[less] + 1, h[less]


@dataclass
class Model:
    langs: list[str]
    probs: list[Table]
    backs: list[Table]
    floor: np.ndarray
    usual: np.ndarray | None = None

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities (natural) of each character from place ORDER - 1 on, a column for each language."""
        return self._order(mix(x.astype(np.uint64)), np.arange(ORDER - 1, len(x)), ORDER)

    def _order(self, c: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.langs)))
        whole = len(at) == len(c) - ORDER + 1
        h = grams(c, n)[ORDER - n :] if whole else _some(c, at, n)
        place = self.probs[n - 1].find(h)
        out = self.probs[n - 1].values[place]
        if len(miss := np.flatnonzero(place < 0)):
            back = self.backs[n - 1].find(_some(c, at[miss] - 1, n - 1)) if n > 1 else np.zeros(len(miss), np.int32)
            out[miss] = np.where((back >= 0)[:, None], self.backs[n - 1].values[back], np.float32(0)) + self._order(c, at[miss], n - 1)
        return out

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entropies per character by language, the squares' means, numbers of characters, and which texts have letters."""
        total = np.zeros((len(texts), len(self.langs)))
        square, lens, has = np.zeros_like(total), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for owner, pieces in _pieces(texts):
            x, first, letters = characters(pieces)
            logs = np.concatenate([self.logs(x), np.zeros((ORDER - 1, len(self.langs)), np.float32)])
            for j in range(1, ORDER):  # positions over a bound, in the padding of the next text
                logs[first[1:-1] - j] = 0
            np.add.at(total, owner, -np.add.reduceat(logs, first[:-1], axis=0, dtype=np.float64))
            np.add.at(square, owner, np.add.reduceat(np.square(logs), first[:-1], axis=0, dtype=np.float64))
            np.add.at(lens, owner, np.diff(first) - (ORDER - 1))
            np.logical_or.at(has, owner, letters)
        n = np.maximum(lens, 1)[:, None]
        return total / n, square / n, lens, has


#: Texts are read in pieces of at most so many characters, and about so many together.
PIECE = 1 << 19


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """All texts in small batches: which text each piece is of, and the pieces."""
    owner, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t or ""), 1), PIECE):
            piece = (t or "")[at : at + PIECE]
            if size and size + len(piece) > PIECE:
                yield np.array(owner), pieces
                owner, pieces, size = [], [], 0
            owner.append(i)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield np.array(owner), pieces


def _some(c: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at the places ``at``; as grams() has them."""
    out = c[at - n + 1].copy()
    for j in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + c[at - n + 1 + j]
    return mix(out)


def fit(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (language, 4-gram, count). Each order below the highest counts the distinct characters before."""
    langs = sorted({r[0] for r in counts})
    tops: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER + 1)]
    for lang, gram, n in counts:
        tops[ORDER].setdefault(gram, np.zeros(len(langs)))[langs.index(lang)] += n
    for n in range(ORDER - 1, 0, -1):
        for gram, c in tops[n + 1].items():
            tops[n].setdefault(gram[1:], np.zeros(len(langs)))
            tops[n][gram[1:]] += c > 0
    letters = len(tops[1]) + 1
    floor = np.full(len(langs), -np.log(letters), np.float32)
    probs, backs = [], []
    lower = {"": np.full(len(langs), 1 / letters)}
    for n in range(1, ORDER + 1):
        once, twice = (sum((c == k).astype(float) for c in tops[n].values()) for k in (1, 2))
        discount = np.clip((once + 1) / (once + 2 * twice + 2), 0.1, 0.9)
        sums: dict[str, np.ndarray] = {}
        kinds: dict[str, np.ndarray] = {}
        for gram, c in tops[n].items():
            sums[gram[:-1]] = sums.get(gram[:-1], 0) + c
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + (c > 0)
        gamma = {g: np.where(s > 0, discount * kinds[g] / np.maximum(s, 1), 1.0) for g, s in sums.items()}
        now = {}
        for gram, c in tops[n].items():
            s = sums[gram[:-1]]
            now[gram] = np.where(s > 0, np.maximum(c - discount, 0) / np.maximum(s, 1), 0) + gamma[gram[:-1]] * lower[gram[1:]]
        probs.append(_table(now, n))
        backs.append(_table(gamma, n - 1))
        lower = now
    return Model(langs, probs, backs, floor)


def _table(rows: dict[str, np.ndarray], n: int) -> Table:
    if n == 0:
        return Table(np.zeros(1, np.uint64), np.log(np.maximum([rows[""]], 1e-12)).astype(np.float32))
    x = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, n)
    keys = _some(mix(x.ravel()), np.arange(n - 1, x.size, n), n)
    order = np.argsort(keys)
    return Table(keys[order], np.log(np.maximum(np.array(list(rows.values()))[order], 1e-12)).astype(np.float32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang, pieces in ((lang, p) for lang in sorted(set(langs)) for _, p in _pieces([t for t, own in zip(texts, langs, strict=True) if own == lang])):
            x, first, _ = characters(pieces)
            cells = np.lib.stride_tricks.sliding_window_view(x, ORDER)
            keep = np.ones(len(cells), bool)
            for j in range(1, ORDER):
                keep[first[1:-1] - j] = False
            grams_, n = np.unique(np.ascontiguousarray(cells[keep]).view(f"<U{ORDER}").ravel(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([str(g).ljust(ORDER) for g in grams_], pa.string()), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, learnable: Column, *, max_bytes: int = MAX_BYTES, most_bytes: int = MOST_BYTES, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """A model from the rows of ``docs`` for which ``learnable`` holds; None if there are none."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    part = lambda seed: F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1) / float(1 << 63)
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("place", part(1))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("place").alias("least"))  # a row for each language
    sizes = materialise(sizes, "languages")
    each = min(float(max_bytes), most_bytes / max(1, sizes.count()))
    share = sizes.select("lang", "least", F.least(F.lit(1.0), F.lit(each) / F.col("bytes")).alias("share"))
    first = F.col("place") == F.col("least")
    some = known.join(F.broadcast(share), "lang").filter((F.col("place") < F.col("share")) | first)
    counted = some.filter((part(2) >= 0.1) | first).select("lang", "text").mapInArrow(_count, "lang string, gram string, n long")
    counts = [tuple(r) for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").collect()]
    if not counts:
        return None
    model = fit(counts)
    sent = spark.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            mean, square, n, has = sent.value.judge(batch.column(1).to_pylist())
            known_ = {x: i for i, x in enumerate(sent.value.langs)}
            rows = [(y, y == x, mean[i, k], square[i, k] - mean[i, k] ** 2) for i, x in enumerate(langs) if has[i] and x in known_ and n[i] >= 50 for y, k in known_.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "own", "mean", "spread"])

    usual = some.filter((part(2) < 0.1) & ~first).select("lang", "text").mapInArrow(entropies, "lang string, own boolean, mean double, spread double")
    found = {(r["lang"], r["own"]): r for r in usual.groupBy("lang", "own").agg(F.avg("mean").alias("m"), F.coalesce(F.stddev("mean"), F.lit(0.0)).alias("s"), F.avg("spread").alias("v")).collect()}
    sent.destroy()  # nothing is read through it any more
    far = {x: found[x, False]["m"] if (x, False) in found else -float(f) for x, f in zip(model.langs, model.floor, strict=True)}
    own = {x: (r["m"], r["s"], r["v"], (r["m"] + far[x]) / 2) for x in model.langs if (r := found.get((x, True)))}
    loosest = np.max(list(own.values()), axis=0) if own else np.array([np.inf, 0, 0, np.inf])
    model.usual = np.array([own.get(x, loosest) for x in model.langs])
    return model


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), entropy (nats a character) and rejected; columns of those names are replaced."""
    new = ["lang_pred", "score", "entropy", "rejected"]
    keep = [c for c in docs.columns if c not in new]
    schema = docs.select(*keep).schema
    for name, kind in zip(new, ["string", "double", "double", "boolean"], strict=True):
        schema = schema.add(name, kind)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            lang, score, entropy, rejected = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            if m and n:
                mean, _, size, has = m.judge(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
                best = mean.argmin(1)
                low = mean[np.arange(n), best]
                odds = np.exp(-(mean - low[:, None]) * np.minimum(size, 200)[:, None]).sum(1)
                limit = m.usual[best, 0] + DEVIATIONS * np.sqrt(m.usual[best, 1] ** 2 + m.usual[best, 2] / np.maximum(size, 1))
                lang[has] = np.array(m.langs, object)[best[has]]
                score[has], entropy[has] = 1 / odds[has], low[has]
                rejected = ~has | (low > np.maximum(limit, m.usual[best, 3]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)], names=[*keep, *new])

    return docs.select(*keep).mapInArrow(run, schema)
