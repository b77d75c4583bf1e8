"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is cut into windows of 13 words (an item with fewer words is one window). A document contains a window
only if it contains each of the window's shingles, so one of them, the rarest in the corpus, is the
window's necessary prefix. Documents are searched for prefixes alone; a document's place that may hold one is kept with the words around
it, equality-joined with the windows of that prefix, cut down by position and length, and compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespark.plans.lineage import numbered, stored

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
#: Bits of the filter that goes to every task, whatever the benchmark's size: 2 MB.
FILTER_BITS = 1 << 24
#: The windows are broadcast if their words take no more bytes than this; else both sides are shuffled.
BROADCAST_BYTES = 32 << 20
_CHUNK_WORDS = 1 << 16

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_U = np.uint64
_BYTE = (np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=_U) << _U(29))
_PLACE = np.cumprod(np.full(1024, 0xD6E8FEB86659FD93, _U))


def _words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's bytes with A-Z lower-cased, and where its words start and end."""
    data = (text or "").encode().lower()
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


def _word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, _U)
    low = starts[0]
    at = starts - low
    values = _BYTE[np.frombuffer(data, np.uint8, ends[-1] - low, low)]
    inside = np.zeros(len(values) + 1, np.int8)
    inside[at] += 1
    inside[ends - low] -= 1
    place = np.arange(len(values)) - np.repeat(at, np.diff(np.append(at, len(values))))
    values = np.where(np.cumsum(inside[:-1]) > 0, values * _PLACE[place & 1023], _U(0))
    return np.add.reduceat(values, at)


def _shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, size, _U)
    for k in range(size):
        out = (out ^ words[k : k + n]) * _U(0xFF51AFD7ED558CCD)
        out ^= out >> _U(33)
    return out


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each item's windows: its words, its shingle length and the hashes of its shingles in order."""
    for batch in batches:
        items, words, sizes, hashes = [], [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, starts, ends = _words(text)
            if not len(starts):
                continue
            width = min(WINDOW_WORDS, len(starts))
            size = min(SHINGLE_WORDS, width)
            own = [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            runs = _shingle_hashes(_word_hashes(data, starts, ends), size).view(np.int64).tolist()
            for k in range(len(own) - width + 1):
                items.append(item)
                words.append(own[k : k + width])
                sizes.append(size)
                hashes.append(runs[k : k + width - size + 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
            names=["item_id", "words", "size", "shingles"],
        )


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits of the column ``shingle``."""
    place = F.col("shingle").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    placed = hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # FILTER_BITS bits at most
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _found(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles that may be in the filter."""
    places, hashes = [], []
    for size in sizes:
        runs = _shingle_hashes(words, size)
        low = runs & _U(FILTER_BITS - 1)
        at = np.flatnonzero((bits[low >> _U(3)] >> (low & _U(7)).astype(np.uint8)) & 1)
        places.append(at)
        hashes.append(runs[at])
    return np.concatenate(places) if places else np.zeros(0, np.int64), np.concatenate(hashes) if hashes else np.zeros(0, _U)


def _search(text: str | None, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk, so that a long text takes bounded memory."""
    data, starts, ends = _words(text)
    over = max(sizes, default=1) - 1
    for k in range(0, max(1, len(starts)), _CHUNK_WORDS):
        stop = k + _CHUNK_WORDS
        places, hashes = _found(_word_hashes(data, starts[k : stop + over], ends[k : stop + over]), sizes, bits)
        own = places < _CHUNK_WORDS
        yield data, starts, ends, places[own] + k, hashes[own]


def _counter(sizes: list[int], bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [h for text in batch.column(0) for *_, h in _search(text.as_py(), sizes, bits)]
            seen, counts = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, _U), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

    return count


def _candidates(sizes: list[int], bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    around = WINDOW_WORDS - 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n = 0
                for data, starts, ends, places, hashes in _search(text.as_py(), sizes, bits):
                    n = len(starts)
                    for at, shingle in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        low, high = max(0, at - around), min(n, at + around + 1)
                        context = [data[a:b].decode() for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                        for column, value in zip(rows, (row, doc, n, shingle, at, low, context), strict=True):
                            column.append(value)
                for column, value in zip(rows, (row, doc, n, None, None, None, None), strict=True):
                    column.append(value)  # a row for the document itself
                if len(rows[0]) >= 20_000:
                    yield _rows(rows)
                    rows = [[], [], [], [], [], [], []]
            yield _rows(rows)

    return search


def _rows(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["row", "doc_id", "n_words", "shingle", "at", "low", "context"])


def _prefixes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, list[int], np.ndarray]:
    """Windows by prefix; the shingle lengths in use; the filter of prefixes."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    windows = items.mapInArrow(_window_batches, "item_id string, words array<string>, size int, shingles array<long>")
    windows = stored(windows.groupBy("words", "size", "shingles").agg(F.collect_set("item_id").alias("items")), "windows")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # one to three
    each = windows.select("words", "items", F.posexplode("shingles").alias("offset", "shingle"))
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_counter(sizes, _filter(each)), "shingle long, n long")
    counts = counted.groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    chosen = each.join(counts, "shingle", "left").groupBy("words", "items").agg(rarest)
    window = F.struct(F.col("rarest.offset").alias("offset"), "words", "items")
    chosen = chosen.select(F.col("rarest.shingle").alias("shingle"), window.alias("window"))
    prefixes = stored(chosen.groupBy("shingle").agg(F.collect_list("window").alias("windows")), "prefixes")
    return prefixes, sizes, _filter(prefixes)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``row`` (``row_col``, a number of its own for each row; its place, if none is given), ``doc_id`` (as text), ``n_words``, ``n_hit``, ``items`` and ``hits`` (start and length in words, items).

    Null and empty texts have no words and no hits. Repeated rows and ids are each returned. Items without words have no window; items
    that share an id count as one; a null item id is the empty string. Other columns are not read, so their names can't clash.
    """
    prefixes, sizes, bits = _prefixes(docs, benchmark, text_col, item_col, item_text_col)
    wanted = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    places = wanted.mapInArrow(_candidates(sizes, bits), "row long, doc_id string, n_words long, shingle long, at long, low long, context array<string>")
    weight = prefixes.agg(F.sum(F.length(F.to_json("windows")))).first()[0] or 0
    if weight <= BROADCAST_BYTES:
        prefixes = F.broadcast(prefixes)
    # the documents' own rows have no shingle; by a hash of their own they spread over a shuffle, and without context they match nothing
    keyed = places.withColumn("shingle", F.coalesce("shingle", F.xxhash64("row")))
    joined = keyed.join(prefixes, "shingle", "left")
    start = lambda w: F.col("at") - w["offset"]
    fits = lambda w: (start(w) >= F.col("low")) & (start(w) + F.size(w["words"]) <= F.col("n_words"))
    same = lambda w: F.slice("context", (start(w) - F.col("low") + 1).cast("int"), F.size(w["words"])) == w["words"]
    found = F.transform(F.filter("windows", lambda w: fits(w) & same(w)), lambda w: F.struct(start(w).alias("start"), F.size(w["words"]).alias("words"), w["items"].alias("items")))
    by_row = joined.select("row", "doc_id", "n_words", found.alias("found")).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("found")).alias("hits")
    )
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["words"] - 1))))
    return by_row.select("row", "doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("hits.items"))).alias("items"), "hits")


def is_contaminated() -> Column:
    """Hit words make a twentieth of the document's words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated. Rows are numbered once and stored."""
    placed = numbered(docs, "__row", "documents")
    bad = find_contamination(placed, benchmark, id_col, text_col, row_col="__row", **columns).where(is_contaminated()).select(F.col("row").alias("__row"))
    return placed.join(bad, "__row", "left_anti").select(*docs.columns)
