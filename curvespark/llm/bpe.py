"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Tasks cut texts into words by the tokenizer's pattern and gather them in blocks: a block's distinct words, each once, and its texts as places among
them. A word is an array of bytes, one character each in a string, so that Spark's string functions merge it; a fold over the word's possible
mergers, in the order of their ranks, replaces pairs by what a literal rank map says. Texts are then the ids of their words. A block holds all that it needs, so
nothing is shuffled, no table of words has to fit anywhere, and every text is treated alike whatever the corpus.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A block ends with the text that brings it to so many characters: larger blocks fold fewer words, smaller ones take less memory.
BLOCK_CHARS = 1 << 22
#: Ids from here on stand for characters above the surrogates, which no string may hold.
_SURROGATES, _SKIPPED = 0xD800, 0x800


def _code(rank: int) -> int:
    """The character that stands for an id."""
    return rank if rank < _SURROGATES else rank + _SKIPPED


def _literal(value: list, kind: str) -> Column:
    """A constant: Spark folds the parsing away when it plans the query."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bind_all(tables: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of tables that each stand in the plan once."""

    def rest(names: list[str], bound: dict[str, Column]) -> Column:
        if not names:
            return body(bound)
        return _bind(tables[names[0]], lambda x: rest(names[1:], bound | {names[0]: x}))

    return rest(list(tables), {})


@dataclass
class Tokenizer:
    """Ranks by bytes, and the pattern that cuts texts."""

    ranks: dict[bytes, int]
    pattern: str
    _splits: dict[bytes, tuple[int, int]] = field(default_factory=dict, repr=False)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Tokenizer:
        """From a file with a token in base64 and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def splits(self) -> dict[bytes, tuple[int, int]]:
        """The pair of ids that merges into each token.

        While ranks are merged in their order, the parts of a token meet as this pair only: what is merged between a token's ends doesn't depend on
        what stands around them. A token's parts have lower ranks than itself, so no merger makes a pair of a lower rank. ValueError if a
        vocabulary isn't like this (none made by training is).
        """
        if not self._splits:
            for token, rank in self.ranks.items():
                parts = [token[k : k + 1] for k in range(len(token))]
                while len(parts) > 1:
                    pairs = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
                    if (least := min(pairs)) >= rank:
                        break
                    k = pairs.index(least)
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if len(parts) == 2:
                    self._splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
                elif len(parts) > 2:
                    raise ValueError(f"ranks aren't in an order of mergers at {token!r}")
            if missing := 256 - sum(len(t) == 1 for t in self.ranks):
                raise ValueError(f"{missing} bytes have no id")
        return self._splits

    def mergers(self) -> dict[str, Column]:
        """The literal rank map: at a rank, the two characters of its pair, and the character of their merger."""
        pairs = [""] * (max(self.ranks.values()) + 1)
        for token, (a, b) in self.splits().items():
            pairs[self.ranks[token]] = chr(_code(a)) + chr(_code(b))
        return {"pairs": _literal(pairs, "array<string>"), "merged": _literal([chr(_code(k)) for k in range(len(pairs))], "array<string>")}

    def pieces(self) -> Column:
        """The bytes of each id, as strings that need not be valid by themselves."""
        out = [""] * (max(self.ranks.values(), default=0) + 1)
        for token, rank in self.ranks.items():
            out[rank] = base64.b64encode(token).decode()
        return _literal(out, "array<binary>").cast("array<string>")

    def little(self) -> Column:
        """Each id as four bytes, as strings that need not be valid."""
        return _literal([base64.b64encode(k.to_bytes(4, "little")).decode() for k in range(max(self.ranks.values(), default=0) + 1)], "array<binary>").cast("array<string>")


def fold_words(words: Column, tokenizer: Tokenizer) -> Column:
    """Ids, a character each, of an array of words: structs of ``bytes`` (their ids, a character each) and ``ranks`` (ascending, of all tokens that occur in the word)."""

    def fold(word: Column, lit: dict[str, Column]) -> Column:
        return F.aggregate(word["ranks"], word["bytes"], lambda s, rank: F.replace(s, F.get(lit["pairs"], rank), F.get(lit["merged"], rank)))

    return _bind_all(tokenizer.mergers(), lambda lit: F.transform(words, lambda w: fold(w, lit)))


class _Numbered(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


def _strings(codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of so many characters each, from code points one after the other (below the surrogates)."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    widths = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800)
    ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])[np.concatenate([[0], np.cumsum(lengths)])]
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _cutter(tokenizer: Tokenizer, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each block: its distinct words and its texts. The last column holds the texts, the others go with them."""
    ranks, pattern = tokenizer.ranks, tokenizer.pattern

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import regex

        words_of = regex.compile(pattern).findall
        tokens = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                tokens.add_word(token.decode("latin-1"), rank)
        if len(tokens):
            tokens.make_automaton()
        single = np.array([ranks[bytes([k])] for k in range(256)], np.int64)

        def put(held: list[pa.RecordBatch], words: _Numbered, places: list[np.ndarray]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data = [w.encode() for w in words]
            found = [sorted({r for _, r in tokens.iter(d.decode("latin-1"))}) if len(d) > 1 else [] for d in data] if len(tokens) else [[]] * len(data)
            lengths = np.fromiter(map(len, data), np.int64, len(data))
            chars = _strings(single[np.frombuffer(b"".join(data), np.uint8)], lengths)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            all_ranks = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter((r for f in found for r in f), np.int32, int(ends[-1]))))
            offsets = pa.array(np.cumsum([0, *map(len, places)], dtype=np.int32))
            texts = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places)))
            docs = pa.StructArray.from_arrays([*rows.columns, texts], names=[*rows.schema.names, "places"])
            own = pa.StructArray.from_arrays([chars, all_ranks], names=["bytes", "ranks"])
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([whole(own), whole(docs)], names=["words", "docs"])

        held, words, places, size = [], _Numbered(), [], 0
        for batch in batches:
            start = 0
            texts = batch.column(batch.num_columns - 1)
            rows = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                places.append(np.fromiter(map(words.__getitem__, words_of(text)), np.int32))
                size += len(text)
                if size >= block:
                    yield put([*held, rows.slice(start, k + 1 - start)], words, places)
                    held, words, places, size, start = [], _Numbered(), [], 0, k + 1
            if start < batch.num_rows:
                held.append(rows.slice(start))
        if held:
            yield put(held, words, places)

    return cut


def _encoded(docs: DataFrame, tokenizer: Tokenizer, columns: list[str], text_col: str, then: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``columns`` of ``docs`` and what ``then`` makes of the ids of the whole text, a character each."""
    kept = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)), F.col(text_col).cast("string").alias("text"))
    # a row that has no columns still counts
    kept = kept.select(F.lit(0).cast("byte").alias("row"), "*")
    docs_type = T.StructType([*kept.schema.fields[:-1], T.StructField("places", T.ArrayType(T.IntegerType()))])
    words_type = T.StructType([T.StructField("bytes", T.StringType()), T.StructField("ranks", T.ArrayType(T.IntegerType()))])
    blocks = kept.mapInArrow(_cutter(tokenizer, BLOCK_CHARS), T.StructType([T.StructField("words", T.ArrayType(words_type)), T.StructField("docs", T.ArrayType(docs_type))]))
    folded = blocks.select("docs", fold_words(F.col("words"), tokenizer).alias("words"))
    put = lambda d: F.struct(*(d[f"c{k}"].alias(f"c{k}") for k in range(len(columns))), F.array_join(F.transform(d["places"], lambda p: F.get("words", p)), "").alias("ids"))
    each = folded.select(F.inline(F.transform("docs", put)))
    return each.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)), *(x.alias(c) for c, x in then(F.col("ids")).items()))


def _id_array(chars: Column, tokenizer: Tokenizer) -> Column:
    """Ids of a string with a character for each."""

    def rank(char: Column) -> Column:
        code = F.ascii(char)
        return code if max(tokenizer.ranks.values()) < _SURROGATES else F.when(code < _SURROGATES, code).otherwise(code - _SKIPPED)

    return F.when(chars == "", F.slice(F.array(F.lit(0)), 1, 0)).otherwise(F.transform(F.split(chars, ""), rank))


def encode(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs``' columns and ``ids_col``, the ids of the whole text without special tokens, each match of the pattern by itself.

    Null and empty texts have no ids (an empty array). A column of ``docs`` named ``ids_col`` is replaced. Rows are encoded by themselves, so
    repeated rows and ids don't matter. The time of a word grows with its length times the number of distinct tokens in it.
    """
    columns = [c for c in docs.columns if c != ids_col]
    return _encoded(docs, tokenizer, columns, text_col, lambda chars: {ids_col: _id_array(chars, tokenizer)})


def _joined(ids: Column, table: Column) -> Column:
    return _bind(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")).cast("binary")


def decode(ids: Column, tokenizer: Tokenizer) -> Column:
    """The bytes that the ids stand for: their pieces, concatenated (null ids: null)."""
    return _joined(ids, tokenizer.pieces())


def id_bytes(ids: Column, tokenizer: Tokenizer) -> Column:
    """The ids as little-endian unsigned 32-bit integers, one after the other (null ids: null)."""
    return _joined(ids, tokenizer.little())


def digests(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row: the text encoded, its ids digested, and decoded again by concatenating their pieces."""
    encoded = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text"), tokenizer)
    ids = F.col("ids")
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(id_bytes(ids, tokenizer), 256).alias("ids_sha256"), F.sha2(decode(ids, tokenizer), 256).alias("decoded_sha256"))
