import random
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter

import public_tokenizers
import pytest
from quirefold.llm import packing
from quirefold.llm.tokens import ChunkIds, byte_letters, tokenizer, word_model

from .data import SF, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(counts, capacity=2048):
    """How many sequences it takes to put each piece, the longest first, where it leaves the least room."""
    many, rooms, bins = Counter(), [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect_left(rooms, length)
            room = rooms[i] if i < len(rooms) else capacity
            if i == len(rooms):
                bins += 1
            else:
                many[room] -= 1
                if not many[room]:
                    rooms.pop(i)
            if not many[room - length]:
                insort(rooms, room - length)
            many[room - length] += 1
    return bins


def check(rows, texts, capacity):
    """Pieces are the documents' ids in order, every sequence is filled from 0 without gaps, and there are few sequences."""
    ids = {i: e.ids + [0] for i, e in zip(texts, tokenizer(PATH).encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids[i]) // capacity)))
        for r in own:
            part = ids[i][r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(part) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert sum(r["length"] for r in own) == len(ids[i])
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(spans) <= best_fit_decreasing(Counter(r["length"] for r in rows), capacity) + 1


def test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.pack_documents(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)


def test_awkward_rows(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    check(packing.pack_documents(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
    assert packing.pack_documents(documents(spark), PATH).where("piece = 0").count() == documents(spark).count()
    assert packing.pack_documents(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    counts = Counter(min(2048, max(1, int(r.lognormvariate(r.choice([3, 6, 7]), 1)))) for _ in range(r.choice([1, 7, 400, 9000])))
    seen, spans = set(), {}
    for length, first, many, sequence, per, offset in packing.plan(counts):
        for i in range(many):
            assert (length, first + i) not in seen
            seen.add((length, first + i))
            spans.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
    assert seen == {(k, i) for k, n in counts.items() for i in range(n)}
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(spans) <= best_fit_decreasing(counts) + 1


HARD = [
    {683: 3000, 682: 3000, 1024: 2000, 1025: 500, 1023: 500},
    dict.fromkeys(range(1, 2048), 40),
    dict.fromkeys((1100, 700, 300, 248), 1000),
    dict.fromkeys(range(300, 1500), 7),
]


@pytest.mark.parametrize("counts", HARD)
def test_no_more_sequences_than_best_fit_decreasing(counts):
    assert max(first + -(-many // per) for _, _, many, first, per, _ in packing.plan(counts)) <= best_fit_decreasing(counts)


def test_the_tables_need_no_more_than_best_fit_decreasing(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/documents.parquet")
    pieces = packing.token_pieces(docs, PATH)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    assert max(first + -(-many // per) for _, _, many, first, per, _ in packing.plan(counts)) <= best_fit_decreasing(counts)


def test_words_whose_ends_cannot_be_told_are_encoded_one_by_one():
    chunks = ChunkIds(PATH)
    chunks.ends = set()
    texts = ["some words, and other words", "x y", "words"]
    want = [struct.pack(f"<{len(e)}I", *e.ids) for e in tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]
    assert list(chunks(texts)) == want


def test_chunks_give_the_tokenizers_ids():
    texts = ["a­b İΣ x's don't 'S foo-bar's '' <|endoftext|> <|ENDOFTEXT|>x ÀÉ½ ª º µm ǅ 12a.b\x85c 　 \x1c a\tb\n\n  c", "É'S it'S,", "éa ́b x ͅ", "", " ", "l'été... (ok)!", "ÿ Ÿ ß ẞ", "x" * 3000]
    want = [struct.pack(f"<{len(e)}I", *e.ids) for e in tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]
    assert list(ChunkIds(PATH)(texts)) == want
    assert list(ChunkIds(PATH, most=0)(texts * 50)) == want * 50


def test_small_latin_words_by_the_model_alone():
    letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
    r = random.Random(7)
    words = letters + [a + b for a in letters for b in letters] + ["".join(r.choices(letters, k=r.randint(3, 14))) for _ in range(5000)]
    model = word_model(tokenizer(PATH))
    got = model.encode_batch([byte_letters(w) for w in words], add_special_tokens=False)
    want = tokenizer(PATH).encode_batch(words, add_special_tokens=False)
    assert [e.ids for e in got] == [e.ids for e in want]


def test_other_tokenizers_are_not_reduced_to_their_model():
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_str(tokenizer(PATH).to_str())
    assert word_model(other)
    other.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    assert word_model(other) is None


def test_chunks_in_use_are_not_learned_again():
    chunks, learned = ChunkIds(PATH, most=400), Counter()
    learn = chunks.learn
    chunks.learn = lambda new: (learned.update(new), learn(new))[1]
    common = " ".join(f"often{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    texts = [f"{common} " + " ".join(f"rare{a}{b}{c}" for b in "abcdefghij" for c in "klmno") for a in "abcdefghijklmnopqrst" for _ in range(200)]
    want = [struct.pack(f"<{len(e)}I", *e.ids) for e in tokenizer(PATH).encode_batch(texts[::200], add_special_tokens=False)]
    assert list(chunks(texts))[::200] == want
    assert max(learned[c] for c in common.split()) == 1
    assert len(chunks.known) + len(chunks.before) <= 600
