"""Packing documents into windows: best-fit decreasing over a segment tree of remaining capacities.

A task encodes the texts of its partition and packs them block by block, so no row is shuffled, memory is a block's, and what an executor loses is one
task's work. Documents of more tokens than a window are cut into full windows first; what is left of each, the longest first, goes to the open window with the least
room that still takes it. A segment tree whose leaves are the possible rooms finds it in as many steps as the window's length has bits.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
#: A block ends with the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 22
#: Windows that would get more padding than this are laid end to end and cut anew at the end of a block.
LOOSE = WINDOW // 64
#: A text is encoded in parts of so many characters, cut at white space.
PART_CHARS = 1 << 19
#: A task remembers the ids of so many short strings between spaces, and then begins anew.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 48
_ID_BYTES = 4
#: White space as the tokenizer's normaliser sees it, among the characters below ``_PLAIN_END``.
_SPACE = "\\t-\\r \\x85\\xa0"
_PLAIN_END = 0x180
#: The steps of the tokenizer whose texts are encoded word by word; other tokenizers take the library's own path.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_END = "</w>"


class WordTokenizer:
    """Ids of texts by a file of the ``tokenizers`` library, without special tokens around them.

    The library itself takes a microsecond a character. Where its file is a byte-pair model with word ends, and a text has only characters below
    U+0180, the text is cut by the same pattern in parts between spaces, which recur, and each part is merged once by the merge table. All other texts go
    through the library. Special tokens that stand in a text have their ids, as the library has it.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def __reduce__(self) -> tuple:
        return WordTokenizer, (self.path,)

    @cached_property
    def library(self):  # noqa: ANN201
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def _file(self) -> dict:
        with open(self.path, encoding="utf-8") as file:
            return json.load(file)

    @cached_property
    def _special(self) -> tuple[re.Pattern, dict[str, int]] | None:
        ids = {x["content"]: x["id"] for x in self._file["added_tokens"]}
        return (re.compile("(" + "|".join(map(re.escape, ids)) + ")"), ids) if ids else None

    def _is_known(self) -> bool:
        file, model = self._file, self._file["model"]
        first = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in file["added_tokens"])
        return plain and (file["normalizer"] or {}).get("normalizers") == _NORMALIZERS and first.get("pattern") == {"Regex": _CUT} and model["type"] == "BPE" and model["end_of_word_suffix"] == _WORD_END and not (model["dropout"] or model["ignore_merges"])

    @cached_property
    def _merge(self) -> Callable[[bytes], list[int]] | None:
        """Ids of a word's bytes, its end marked by a byte that no text has; None if ids don't rise as pairs are merged."""
        if not self._is_known():
            return None
        import tiktoken

        places = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in places} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(places)))}
        ranks = {}
        for token, rank in self._file["model"]["vocab"].items():
            ends = token.endswith(_WORD_END)
            ranks[bytes(letters[c] for c in token.removesuffix(_WORD_END)) + b"\xff" * ends] = rank
        merges = self._file["model"]["merges"]
        made = [self._file["model"]["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in merges]
        if made != sorted(made) or made and made[0] < 512:
            return None
        return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @cached_property
    def _words(self) -> re.Pattern:
        group = lambda kind: "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == kind)
        letters, numbers = group("L"), group("N")
        return re.compile(_CUT.replace("[^\\s\\p{L}\\p{N}]", f"[^{_SPACE}{letters}{numbers}]").replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]"))

    @cached_property
    def _known(self) -> dict[bytes, bytes]:
        merge, words = self._merge, self._words

        class Known(dict):
            def __missing__(self, part: bytes) -> bytes:
                ids = array("I")
                for word in words.findall(part.decode()):
                    ids.extend(merge(word.encode() + b"\xff"))
                found = ids.tobytes()
                if len(part) <= REMEMBERED_BYTES:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[part] = found
                return found

        return Known()

    _odd = re.compile(f"[^\\x00-{chr(_PLAIN_END - 1)}]")
    _gap = re.compile("[ \t-\r]")

    def _plain(self, text: str) -> Iterator[bytes]:
        """Of a text without special tokens; parts are cut before white space, where words end."""
        at = 0
        while at < len(text):
            end = self._gap.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
            part = text[at : end.start()] if end else text[at:]
            at += len(part)
            if self._merge and not self._odd.search(part):
                yield b"".join(map(self._known.__getitem__, part.lower().encode().split()))
            else:
                yield array("I", self.library.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null has none."""
        if not text:
            return b""
        if not self._special or not self._special[0].search(text):
            return b"".join(self._plain(text))
        parts = self._special[0].split(text)
        ids = self._special[1]
        return b"".join(ids[x].to_bytes(_ID_BYTES, "little") if k % 2 else b"".join(self._plain(x)) for k, x in enumerate(parts))


class RoomTree:
    """Open windows by their room: a segment tree over the rooms tells where any are left."""

    def __init__(self, most: int) -> None:
        self.base = 1 << most.bit_length()
        self.filled = bytearray(2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, window: int, room: int) -> None:
        self.open[room].append(window)
        node = room + self.base
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the least room of ``least`` or more, and its room; it is open no longer."""
        node, filled = least + self.base, self.filled
        if not filled[node]:
            while node & 1 or not filled[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.base:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        room = node - self.base
        window = self.open[room].pop()
        if not self.open[room]:
            filled[node] = 0
            while (node := node >> 1) and not (filled[2 * node] or filled[2 * node + 1]):
                filled[node] = 0
        return window, room


def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Windows as lists of places in ``sizes`` (each 1 to ``window``): the largest first, each into the fullest window that takes it; equal sizes in their order."""
    tree, windows = RoomTree(window), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        if found:
            w, room = found
            windows[w].append(k)
        else:
            w, room = len(windows), window
            windows.append([k])
        if room > sizes[k]:
            tree.add(w, room - sizes[k])
    return windows


Piece = tuple[int, int, int]  # the document's place, its start there, its length


def pack(sizes: list[int], window: int = WINDOW, loose: int = LOOSE) -> list[tuple[int, list[Piece]]]:
    """Sequences for documents of these lengths: what each is padded to, and its pieces.

    Windows with more padding than ``loose`` are laid end to end: full windows, then one sequence for each power of two in the rest, which needs no padding.
    """
    out = [(window, [(k, at, window)]) for k, n in enumerate(sizes) for at in range(0, n - window + 1, window)]
    rest = [(k, n - n % window, n % window) for k, n in enumerate(sizes) if n % window]
    again: list[Piece] = []
    for places in best_fit([n for _, _, n in rest], window):
        pieces = [rest[k] for k in places]
        filled = sum(n for _, _, n in pieces)
        if window - filled > loose and filled & (filled - 1):
            again += pieces
        else:
            out.append((filled if filled & (filled - 1) == 0 else window, pieces))
    left = sum(n for _, _, n in again)
    lengths = [window] * (left // window) + [1 << b for b in reversed(range(window.bit_length())) if left % window >> b & 1]
    again.reverse()
    for length in lengths:
        pieces, room = [], length
        while room:
            k, at, n = again.pop()
            pieces.append((k, at, min(n, room)))
            if n > room:
                again.append((k, at + room, n - room))
            room -= pieces[-1][2]
        out.append((length, pieces))
    return out


def _packer(tokenizer: WordTokenizer, end_id: int, window: int, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(_ID_BYTES, "little")
        number = TaskContext.get().partitionId() << 33
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[tuple] = []
            for padded, pieces in pack([len(x) // _ID_BYTES for x in texts], window):
                offset = 0
                for k, start, length in pieces:
                    rows.append((ids[k], start, length, texts[k][start * _ID_BYTES : (start + length) * _ID_BYTES], len(texts[k]) // _ID_BYTES, number, offset, padded))
                    offset += length
                number += 1
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_to")
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc)
                texts.append(tokenizer.encode(text.as_py()) + end)
                held += len(texts[-1]) // _ID_BYTES
                if held >= block_tokens:
                    yield from flush()
                    ids, texts, held = [], [], 0
        if texts:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: WordTokenizer, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset, padded_to)`` for each piece; ``ids`` are little-endian unsigned 32-bit integers.

    A document's ids are those of its text and ``end_id``; null and empty texts have that one alone. Repeated rows are packed each; null ids stay null;
    other columns aren't read; an empty table has no pieces. Sequence numbers begin with the number of the input's partition, so they differ between tasks and are the same when a task runs again.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(_packer(tokenizer, end_id, window, block_tokens), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long")


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids, lengths, padded_to)``: each sequence's ids, without padding, and the lengths of its pieces in order, for masks that keep documents apart."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"), F.max("padded_to").alias("padded_to"))  # a window's pieces at most
    ids = F.aggregate("p", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.col("p.length").alias("lengths"), "padded_to")
