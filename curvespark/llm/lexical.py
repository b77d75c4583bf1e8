"""Ranked lexical search: the best documents for each query by an exact scan in buckets of impact vectors, longest first.

A document is a vector of integer impacts over the terms that the queries have; a score is its product with a query's weights. Tasks sort their
documents by the length of these vectors and cut them into buckets. By Cauchy and Schwarz no document of a bucket scores above the query's length times the bucket's
largest length, so a query leaves a task's remaining buckets once its k-th best score is higher. Inside a bucket the query's heaviest coordinates
are summed exactly and the rest is bounded by the lengths that are left; what may still reach the k-th score is added up exactly in integers. Each task returns its
k best for each query, of which the k best of all are the answer: nothing is approximate and no document is dropped.

Queries are taken in blocks of bounded size, which is all that tasks are sent; documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvespark.plans.lineage import discard, stored

#: A block of queries has about so many terms in all (a single longer query is a block of its own).
BLOCK_TERMS = 200_000
BUCKET = 1024
#: So many of a query's heaviest coordinates are summed before the rest is bounded.
FOCUS = 8
#: Bounds are computed in doubles; this share is added to them, so no document is lost to rounding.
SLACK = 1e-9
_CHARS = 1 << 20
#: Digits, letters (A to Z lower-cased) and every byte of other characters belong to terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8; null has none."""
    return (text or "").encode().translate(_TABLE).split()


def weight(rows: int, found: int) -> int:
    """What a term counts that ``found`` of ``rows`` documents hold."""
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * found + 1)))


@dataclass
class Queries:
    """A block of queries over its own vocabulary: query ``q`` has ``ids[starts[q] : starts[q + 1]]`` with ``counts``."""

    vocabulary: dict[bytes, int]
    starts: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Queries:
        words = sorted({t for r in rows for t in r.terms})
        vocabulary = {t.encode(): k for k, t in enumerate(words)}
        places = {t: k for k, t in enumerate(words)}
        starts = np.cumsum([0, *(len(r.terms) for r in rows)])
        ids = np.array([places[t] for r in rows for t in r.terms], np.int64)
        return cls(vocabulary, starts, ids, np.array([c for r in rows for c in r.counts], np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1


def _lists(values: list, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values, kind))


def _counted(rows: Iterator[tuple[object, str | None]], kind: pa.DataType, vocabulary: dict[bytes, int] | None) -> Iterator[pa.RecordBatch]:
    """Batches of (id, n, terms, counts) of the rows that have terms; with a vocabulary, only its terms, as their numbers."""
    word = pa.string() if vocabulary is None else pa.int32()
    keys: list = []
    lengths: list[int] = []
    total: list[int] = []
    found: list = []
    counts: list[int] = []
    held = 0

    def batch() -> pa.RecordBatch:
        every = pa.array(found, pa.binary()).cast(pa.string()) if vocabulary is None else found
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(total, pa.int64()), _lists(every, lengths, word), _lists(counts, lengths, pa.int32())], names=["id", "n", "terms", "counts"])

    for key, text in rows:
        every = terms(text)
        if every:
            if vocabulary is None:
                mine = Counter(every)
                found += mine.keys()
            else:
                mine = Counter(map(vocabulary.get, every))
                mine.pop(None, None)
                found += mine.keys()
            counts += mine.values()
            keys.append(key)
            total.append(len(every))
            lengths.append(len(mine))
            held += len(text or "")
            if held > _CHARS:
                yield batch()
                keys, lengths, total, found, counts, held = [], [], [], [], [], 0
    if keys:
        yield batch()


def count_terms(table: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int] | None = None) -> DataFrame:
    """``(id, n, terms, counts)`` of the rows of ``table`` that have terms: how many with repeats, the different ones and how often each occurs.

    With a vocabulary, ``terms`` are its numbers, and terms outside it count only in ``n``.
    """
    wanted = table.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _counted(zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True), b.schema.field(0).type, vocabulary)

    return wanted.mapInArrow(run, f"id {wanted.schema['id'].dataType.simpleString()}, n long, terms array<{'string' if vocabulary is None else 'int'}>, counts array<int>")


def _runs(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive runs, which may be empty."""
    out, full = np.zeros(len(lengths)), lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return out


def _with_lengths(weights: np.ndarray, rows: int, all_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Impacts in place of counts, and the lengths of the impact vectors, each coordinate times its weight's square root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            lengths = b.column(2).value_lengths().to_numpy()
            ids, counts = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.int64)
            m = 25 + np.array([75 * int(x) * rows // all_terms for x in n], np.int64)
            impacts = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, lengths))
            norms = np.sqrt(_runs(lengths, weights[ids] * impacts.astype(float) ** 2))
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(impacts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), kept, pa.array(norms, pa.float64())], names=["id", "terms", "impacts", "norm"])

    return run


class Best:
    """The k best documents of a query so far: highest scores first, then smallest ids, null ids last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """A score below this can't be among them."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, n = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.none, none])
        order = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.ids, self.none = s[order], i[order], n[order]


@dataclass
class Search:
    """One task's search: buckets come in, longest vectors first. ``compared`` and ``skipped`` count query-bucket pairs, ``rescored`` documents."""

    queries: Queries
    weights: np.ndarray
    k: int
    compared: int = 0
    skipped: int = 0
    rescored: int = 0

    def __post_init__(self) -> None:
        q = self.queries
        self.best = [Best(self.k) for _ in range(len(q))]
        factor = self.weights[q.ids] * q.counts
        self.norms = np.sqrt(_runs(np.diff(q.starts), factor.astype(float) * q.counts))
        self.parts = []
        for a, b in zip(q.starts[:-1], q.starts[1:], strict=True):
            order = np.argsort(-(factor[a:b] * q.counts[a:b]), kind="stable")  # of the coordinates' squares
            ids, by, squares = q.ids[a:b][order], factor[a:b][order], (factor[a:b] * q.counts[a:b])[order].astype(float)
            self.parts.append((ids.tolist(), by.tolist(), math.sqrt(squares[FOCUS:].sum())))

    def bucket(self, ids: np.ndarray, none: np.ndarray, lengths: np.ndarray, term: np.ndarray, impacts: np.ndarray, norms: np.ndarray) -> None:
        """Documents whose lengths are at most those of the buckets before."""
        thresholds = np.array([b.threshold for b in self.best])
        active = np.flatnonzero(self.norms * norms.max(initial=0) * (1 + SLACK) >= thresholds)
        self.skipped += len(self.best) - len(active)
        self.compared += len(active)
        if not len(active):
            return
        order = np.argsort(term, kind="stable")
        rows, values = np.repeat(np.arange(len(ids)), lengths)[order], impacts[order].astype(np.int64)
        present, first = np.unique(term[order], return_index=True)
        bounds = [*first.tolist(), len(order)]
        lists = {int(t): (rows[bounds[k] : bounds[k + 1]], values[bounds[k] : bounds[k + 1]]) for k, t in enumerate(present)}
        for q in active:
            mine, by, rest = self.parts[q]
            score, left = np.zeros(len(ids), np.int64), norms**2
            for t, f in zip(mine[:FOCUS], by[:FOCUS], strict=True):
                if (found := lists.get(t)) is not None:
                    score[found[0]] += f * found[1]
                    left[found[0]] -= float(self.weights[t]) * found[1].astype(float) ** 2
            least = self.best[q].threshold
            reach = score + rest * np.sqrt(np.maximum(left, 0) + SLACK * norms**2)
            alive = reach * (1 + SLACK) >= least
            self.rescored += int(alive.sum())
            if not alive.any():
                continue
            for t, f in zip(mine[FOCUS:], by[FOCUS:], strict=True):
                if (found := lists.get(t)) is not None:
                    score[found[0]] += f * found[1]
            good = np.flatnonzero(alive & (score >= least))
            if len(good) > 8 * self.k:  # only those that reach the k-th of them
                good = good[score[good] >= np.partition(score[good], -self.k)[-self.k]]
            if len(good):
                self.best[q].add(score[good], ids[good], none[good])


def _searcher(queries: Queries, weights: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries, weights, k)
        for whole in batches:
            for at in range(0, whole.num_rows, BUCKET):
                b = whole.slice(at, BUCKET)
                ids = b.column(0)
                search.bucket(
                    ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(),
                    b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(), b.column(3).to_numpy(),
                )
        numbers = np.repeat(np.arange(len(queries), dtype=np.int32), [len(b.scores) for b in search.best])
        join = lambda name: np.concatenate([getattr(b, name) for b in search.best]) if len(numbers) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(join("ids"), pa.int64(), mask=join("none").astype(bool)), pa.array(join("scores"), pa.int64())], names=["query", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, rows: list, k: int, id_col: str, text_col: str) -> DataFrame:
    queries = Queries.of(rows)
    vectors = stored(count_terms(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", queries.vocabulary), "vectors")
    rows_, all_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's vocabulary
    weights = np.array([weight(rows_, found.get(t, 0)) for t in range(len(queries.vocabulary))], np.int64)
    long = vectors.where(F.size("terms") > 0).mapInArrow(_with_lengths(weights, rows_, max(all_terms, 1)), "id long, terms array<int>, impacts array<int>, norm double")
    best = long.sortWithinPartitions(F.desc("norm")).mapInArrow(_searcher(queries, weights, k), "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = stored(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    discard(vectors)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each row of ``items`` the ``k`` rows of ``docs`` with the highest scores above 0, ranks from 1.

    A term weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))`` where N documents have terms and df hold it; a document that has it ``tf`` times, and n of all L terms,
    adds the weight times ``10^9 tf div (1000 tf + 8 (25 + 75 n N div L))`` for each time that the query has it. Equal scores are ordered by ``doc_id``, null last.
    Ids are integers. Null texts, texts without terms and empty tables find nothing and are not found; repeated rows, of either table, each stand for themselves; other columns aren't read.
    """
    counted = stored(count_terms(items, item_col, item_text_col), "items")
    total = counted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    order = Window.partitionBy("block").orderBy("id", "terms", "counts")
    numbered = counted.withColumn("block", F.pmod(F.xxhash64("id", "terms"), F.lit(blocks))).withColumn("query", F.row_number().over(order) - 1)
    numbered = stored(numbered.select("block", "query", "id", "terms", "counts"), "queries")
    out = None
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).orderBy("query").collect()  # about BLOCK_TERMS terms
        if rows:
            found = _search_block(docs, rows, k, id_col, text_col).withColumn("block", F.lit(block).cast("long"))
            out = found if out is None else out.unionByName(found)
    discard(counted)
    if out is None:
        return numbered.select(F.col("id").alias("item_id"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    named = numbered.select("block", "query", F.col("id").alias("item_id"))
    return out.join(named, ["block", "query"]).select("item_id", "rank", "doc_id", "score")
