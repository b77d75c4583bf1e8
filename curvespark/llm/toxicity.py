"""Toxicity scores of texts that are first restored from leetspeak, spacing and repetition.

A noisy channel: a written token is a lattice of the letters that its characters may stand for. Viterbi decoding under
a character trigram model, counted over all documents, finds the likeliest word. A logistic regression on the restored words,
learned from labelled documents, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespark.plans.lineage import stored

#: The classifier is fitted on so many labelled documents at most, those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: So many features are kept at most, those of the largest likelihood ratio, if it is over MIN_RATIO.
MAX_FEATURES = 4_000
MIN_RATIO = 24.0
THRESHOLD = 0.3
_PREFIXES = (3, 4, 5, 6)
#: A task remembers the features of so many tokens, of so many characters at most.
_CACHE, _CACHED_CHARS = 65_536, 32
_SLICE = 1 << 22

#: What a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
_SEPARATORS = set(".-_~'’·*/\\,:;^`")
_SUBSTITUTED, _DROPPED, _DROPPED_AT_END, _SPACE = -1.0, -8.0, -0.3, -1.5

_DOUBLED = re.compile(r"([^\w\s])\1+")
_LONG_RUN = re.compile(r"(.)\1\1")
_EDGES = ".,;:?\"'()[]{}<>#%&*~-_/\\^`’“”«»|="
_LETTER = r"[a-z0-9@$!]"
_SPACED = re.compile(rf"(?<!\S)(?:{_LETTER}[ .\-_]){{2,}}{_LETTER}(?!\S)")

_CLASS = np.zeros(0x250, np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
for _c in range(0x80, 0x250):
    _CLASS[_c] = 27 if chr(_c).isalpha() else 0


def _class(c: str) -> int:
    code = ord(c)
    return int(_CLASS[code]) if code < len(_CLASS) else 27


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 15, np.int64)
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            for k in range(0, len(text), _SLICE):
                codes = np.frombuffer(f" {text[k : k + _SLICE].lower()} ".encode("utf-32-le"), np.uint32)
                kinds = np.where(codes < len(_CLASS), _CLASS[np.minimum(codes, len(_CLASS) - 1)], 27)
                total += np.bincount((kinds[:-2] << 10) | (kinds[1:-1] << 5) | kinds[2:], minlength=1 << 15)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["trigram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [c, a, b] of a character class after two others, counted over all texts: 32**3 numbers, whatever the corpus."""
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_trigrams, "trigram long, n long")
    counts = np.zeros(1 << 15)
    for row in counted.groupBy("trigram").agg(F.sum("n").alias("n")).collect():  # 2**15 rows at most
        counts[row.trigram] = row.n
    three = counts.reshape(32, 32, 32)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + 32)
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    return np.log((three + 8 * p2) / (three.sum(2, keepdims=True) + 8))


def decode(token: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest word (words, where letters were ``spaced``) behind a lower-case token: Viterbi over its lattice, with the last two letters as states."""
    slots: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(token):
        c, end = token[k], k + 1
        while end < len(token) and token[end] == c:
            end += 1
        n, edge = end - k, k == 0 or end == len(token)
        if c in LEET:
            drop = _DROPPED_AT_END if edge and not c.isalnum() else 0.0 if c in _SEPARATORS else _DROPPED
            slots.append([(x, _SUBSTITUTED) for x in LEET[c]] + [("", drop)] + ([(c, _DROPPED)] if c.isalnum() else []))
            end = k + 1 if n < 3 else end
        elif c in _SEPARATORS or c.isspace():
            slots.append([("", 0.0)])
        elif n == 1 or spaced:
            slots.extend([[(c, 0.0)]] * n)
        elif n == 2:
            slots.append([(c + c, 0.0), (c, -5.0)])
        else:
            slots.append([(c, -0.2), (c + c, -0.4)])
        if spaced and slots[-1][0][0]:
            slots.append([("", 0.0), (" ", _SPACE)])
        k = end
    # the letters so far are chained from the last one back, so that a long token takes linear time
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for slot in slots:
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, out) in states.items():
            for letters, cost in slot:
                x, y, s = a, b, score + cost
                for c in letters:
                    z = _class(c)
                    s += model[x, y, z]
                    x, y = y, z
                if (x, y) not in following or s > following[x, y][0]:
                    following[x, y] = (s, (out, letters) if letters else out)
        states = following
    chain = max(states.items(), key=lambda x: x[1][0] + model[x[0][0], x[0][1], 0])[1][1]
    found: list[str] = []
    while chain is not None:
        chain, letters = chain
        found.append(letters)
    return "".join(reversed(found))


def words_of(token: str, model: np.ndarray) -> list[str]:
    """The words that a lower-case token without white space stands for."""
    core = _DOUBLED.sub(" ", token).strip(_EDGES + " ")
    if core.isalpha() and not _LONG_RUN.search(core):
        return [core]
    words: list[str] = []
    for part in core.split():
        bits = [b for b in re.split(r"[^\w@$!|+(€£*]+", part) if b]
        if len(bits) > 1 and any(len(b) < 2 for b in bits):
            bits = [part]
        for bit in bits:
            if not any(c.isalpha() for c in bit):
                continue
            if bit.isalpha() and not _LONG_RUN.search(bit):
                words.append(bit)
            else:
                words += decode(bit, model).split()
    return words


def _spread(text: str, model: np.ndarray) -> str:
    """``text`` with words whose letters stand apart put together."""
    return _SPACED.sub(lambda m: decode(m[0], model, spaced=True), text)


def restore(text: str | None, model: np.ndarray) -> str:
    """The whole text in lower case, its words restored and one space between them."""
    return " ".join(w for t in _tokens(text, model) for w in words_of(t, model))


def _tokens(text: str | None, model: np.ndarray) -> list[str]:
    tokens = (text or "").lower().split()
    if sum(len(t) == 1 for t in tokens) > 2 or any(len(t) > 4 and (t[1::2].count(t[1]) * 2 >= len(t) - 1) and not t[1].isalnum() for t in tokens):
        return _spread(" ".join(tokens), model).split()
    return tokens


def _features(token: str, model: np.ndarray) -> list[str]:
    return [f for w in words_of(token, model) for f in (f"={w}", *(w[:k] for k in _PREFIXES if len(w) > k))]


def _feature_counter(model: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, every = Counter(), Counter()
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = {f for t in set(_tokens(text.as_py(), model)) for f in _features(t, model)}
                every.update(own)
                if label:
                    toxic.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([toxic[f] for f in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["feature", "toxic", "every"])

    return count


@dataclass
class ToxicityModel:
    """The character model and a logistic regression on which features occur."""

    characters: np.ndarray
    features: dict[str, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -math.inf
    _seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def _of(self, token: str) -> tuple[int, ...]:
        if (found := self._seen.get(token)) is None:
            found = tuple(self.features[f] for f in _features(token, self.characters) if f in self.features)
            if len(token) <= _CACHED_CHARS:
                if len(self._seen) >= _CACHE:
                    self._seen.clear()
                self._seen[token] = found
        return found

    def present(self, text: str | None) -> tuple[list[int], float]:
        """The features that occur in the whole text, and its length on a scale of logarithms."""
        out: set[int] = set()
        tokens = set(_tokens(text, self.characters))
        for token in tokens:
            out.update(self._of(token))
        return sorted(out), math.log1p(len(tokens)) / 2 - 2.5

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        found, length = self.present(text)
        z = self.bias + float(self.weights[found].sum()) + length * float(self.weights[-1])
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def _fit(rows: list[list[int]], lengths: np.ndarray, labels: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by accelerated gradient steps; the last weight is the length's."""
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    col = np.array([f for r in rows for f in (*r, n)], np.int64)
    value = np.ones(len(col))
    value[col == n] = lengths
    n += 1
    step = 4.0 / (3 + max((len(r) for r in rows), default=0))
    w = v = np.zeros(n + 1)
    t = 1.0
    for _ in range(600):
        z = v[n] + np.bincount(row, v[col] * value, len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels
        slope = np.append(np.bincount(col, error[row] * value, n)[:n], error.sum()) / len(rows)
        slope[:n] += v[:n] * 0.5 / len(rows)
        new, after = v - step * slope, (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from ``docs`` (all texts, for the character model) and from ``labels`` (id and 0/1; null labels are left out, of repeated ids the largest holds, and the last text in order).

    Without labelled documents, every score is zero.
    """
    characters = character_model(docs, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.max("text").alias("text"))  # MAX_LABELLED rows at most
    known = stored(known, "labelled")
    total = known.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not total.n:
        return ToxicityModel(characters, {})
    n, toxic = float(total.n), float(total.toxic)
    counted = known.mapInArrow(_feature_counter(characters), "feature string, toxic long, every long")
    counted = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every"))

    def share(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    t, e = F.col("toxic"), F.col("every")
    ratio = share(t, e * (toxic / n)) + share(e - t, e * (1 - toxic / n)) + share(toxic - t, (n - e) * (toxic / n)) + share(n - toxic - e + t, (n - e) * (1 - toxic / n))
    best = counted.where((t >= 3) & (t / e > toxic / n)).select("feature", ratio.alias("ratio")).where(F.col("ratio") > MIN_RATIO)
    features = {r.feature: k for k, r in enumerate(best.orderBy(F.desc("ratio"), "feature").limit(MAX_FEATURES).collect())}
    model = ToxicityModel(characters, features)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lengths = zip(*(model.present(x.as_py()) for x in batch.column(1)), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(lengths, pa.float64())], names=["label", "found", "length"])

    rows = known.select("label", "text").mapInArrow(present, "label int, found array<int>, length double").collect()  # MAX_LABELLED short lists at most
    model.weights, model.bias = _fit([r.found for r in rows], np.array([r.length for r in rows]), np.array([r.label for r in rows], float), len(features))
    return model


def with_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs``' columns and the score of each whole text, 0 to 1 (null and empty texts: that of a text without words).

    A column of ``docs`` that has the score's name is replaced.
    """
    kept = [c for c in docs.columns if c != score_col]
    out = docs.select(*kept, F.col(text_col).cast("string").alias(score_col))
    schema = out.withColumn(score_col, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=batch.schema.names)

    return out.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learned from: those whose CRC-32 of the id as text leaves 2 when divided by 4 (a null id is the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
