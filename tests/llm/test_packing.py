"""Packing against the tokenizer library and against a plain search for the tightest window."""

import random
import unicodedata
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from curvespark.llm import packing
from curvespark.llm.queries import QUERIES, word_tokenizer
from tests.test_entry import DATA


def numbers(ids):
    return [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)]


@pytest.fixture(scope="module")
def tokenizer():
    return word_tokenizer()


def library(tokenizer, text):
    return tokenizer.library.encode(text, add_special_tokens=False).ids


def test_every_low_character_is_cut_as_the_library_does(tokenizer):
    assert tokenizer._merge
    chars = [chr(c) for c in range(packing._PLAIN_END)]
    text = " ".join(f"a{c}b {c}{c} 1{c}'s" for c in chars) + "\n".join(f"x{c}" for c in chars) + "'S'T'RE'Ve'M'lL'd ''s s's"
    assert numbers(tokenizer.encode(text)) == library(tokenizer, text)
    for c in chars:
        assert numbers(tokenizer.encode(f"q{c}{c}'t9{c}")) == library(tokenizer, f"q{c}{c}'t9{c}")


def test_other_texts_equal_the_library(tokenizer):
    rng = random.Random(5)
    alphabet = "aeiou stn.,'\n\t\x1c\x85\xa0ßéİıǅ0²½_-" + "日本語ñ́ééΣςα🙂​ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "<|endoftext", "a" * 5000, "", " ", "\n\n", "x\x00y", "Ａ ﬁ Å"]
    texts += ["".join(chr(c) for c in range(0x180, 0x3000) if unicodedata.category(chr(c)) != "Cn")]
    for t in texts:
        assert numbers(tokenizer.encode(t)) == library(tokenizer, t), t


def test_long_texts_are_encoded_in_parts(tokenizer, monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdé.,'s") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    assert numbers(tokenizer.encode(text)) == library(tokenizer, text)
    assert numbers(tokenizer.encode(text + " 語 " + text)) == library(tokenizer, text + " 語 " + text)


def test_windows_are_the_tightest(tokenizer):
    rng = random.Random(7)
    for window in (1, 2, 16, 64):
        sizes = [rng.randrange(1, window + 1) for _ in range(300)]
        rooms: list[int] = []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms[rooms.index(min(fits))] -= size
            else:
                rooms.append(window - size)
        got = packing.best_fit(sizes, window)
        assert sorted(window - sum(sizes[k] for k in w) for w in got) == sorted(rooms)
        assert sorted(k for w in got for k in w) == list(range(len(sizes)))


@pytest.mark.parametrize("sizes", [[], [1], [16], [3] * 7, [100, 1, 1, 5, 33], list(range(1, 60))])
def test_every_token_has_one_place_and_nothing_is_padded_much(sizes):
    placed, padding = defaultdict(list), 0
    for padded, pieces in packing.pack(sizes, 16, 1):
        filled = sum(n for _, _, n in pieces)
        assert 0 < filled <= padded <= 16 and padded & (padded - 1) == 0 and (padded == 16 or filled == padded)
        padding += padded - filled
        for k, at, n in pieces:
            placed[k] += range(at, at + n)
    assert [sorted(placed[k]) for k in range(len(sizes))] == [list(range(n)) for n in sizes]
    assert padding <= max(1, sum(sizes) // 8)


def check(pieces, want, window):
    """``want``: ids by document, each named once."""
    docs, rows = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        rows[p.sequence_id].append(p)
    assert set(docs) == set(want)
    for doc, ps in docs.items():
        at, ids = 0, want[doc]
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[p.start : at]))
        assert at == len(ids)
    padding = total = 0
    for ps in rows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        total += at
    assert padding <= 0.005 * total


def test_query_packs_all_documents(spark, tokenizer):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: [*library(tokenizer, r.text or ""), 2] for r in texts}
    check(QUERIES["op11_packing"](spark, DATA).collect(), want, packing.WINDOW)


def test_nulls_repeats_long_texts_and_other_columns(spark, tokenizer):
    long = " ".join(f"w{k}" for k in range(9000))
    rows = [("a", None, 1), ("b", "", 2), ("c", "one two", 3), (None, "one two", 4), ("d", long, 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, length int").withColumns({c: F.lit(0) for c in ("ids", "start", "sequence_id")})
    pieces = packing.pack_documents(docs.union(docs.where("doc_id = 'c'")), tokenizer, 2, block_tokens=10_000)
    got = pieces.withColumn("ids_crc32", F.crc32("ids")).collect()
    assert sorted((p.length, p.doc_tokens) for p in got if p.doc_id in ("a", "b")) == [(1, 1), (1, 1)]
    assert sum(p.length for p in got if p.doc_id is None) == len(library(tokenizer, "one two")) + 1
    assert sum(p.length for p in got if p.doc_id == "c") == 2 * (len(library(tokenizer, "one two")) + 1)
    whole = sorted((p for p in got if p.doc_id == "d"), key=lambda p: p.start)
    assert numbers(b"".join(bytes(p.ids) for p in whole)) == [*library(tokenizer, long), 2]
    made = packing.sequences(pieces).collect()
    assert sum(len(r.ids) // 4 for r in made) == sum(p.length for p in got) and all(len(r.ids) == 4 * sum(r.lengths) <= 4 * r.padded_to for r in made)
    assert packing.pack_documents(docs.limit(0), tokenizer, 2).count() == 0
