import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
from quirefold.llm import media, tokens
from quirefold.llm.tokens import split_safely, tokenizer

from .data import SF, documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_are_the_librarys(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), documents(spark)):
        texts = [r["text"] or "" for r in docs.collect()]
        want = sorted((len(t.encode()), len(e.ids), len(e.ids) > 1024) for t, e in zip(texts, tokenizer(PATH).encode_batch(texts, add_special_tokens=False)))
        assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs, PATH).collect()) == want
    assert tokens.count_tokens(empty(spark), PATH).count() == 0


def test_long_texts_are_cut_where_counts_add_up():
    text = ("don't  stop\n\n it's 1234 naïve <|endoftext|> 😀 " * 40).strip()
    for most in (5, 50, 300):
        pieces = split_safely(text, most)
        assert "".join(pieces) == text and len(pieces) > 1
        assert sum(len(tokenizer(PATH).encode(p, add_special_tokens=False).ids) for p in pieces) == len(tokenizer(PATH).encode(text, add_special_tokens=False).ids)
    assert split_safely("x" * 1000, 10) == ["x" * 1000]


def test_texts_without_spaces_are_cut_at_marks_and_batches_go_by_bytes():
    text = "你好，世界。这是「测试」！don’t l’été… 東京、京都。１２３４、五六。a—b “quoted” ‘s ’s" * 40
    for most in (1, 7, 100):
        pieces = split_safely(text, most)
        assert "".join(pieces) == text and len(pieces) > 20
        assert sum(len(tokenizer(PATH).encode(p, add_special_tokens=False).ids) for p in pieces) == len(tokenizer(PATH).encode(text, add_special_tokens=False).ids)
    assert [len(p) for p, _ in tokens.by_bytes(["你" * 10] * 9, most=60)] == [2, 2, 2, 2, 1]


def peaks(samples):
    """The fingerprint of samples, frame by frame."""
    x = [b - 128 for b in samples]
    n = max(1, -(-(len(x) - 256) // 128) + 1) if x else 1
    x += [0] * ((n - 1) * 128 + 256 - len(x))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 255) for i in range(256)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    power = [np.abs(turn @ np.array([a * w for a, w in zip(x[t * 128 : t * 128 + 256], window)])) for t in range(n)]
    found = []
    for low, high in ((1, 8), (8, 24), (24, 56), (56, 129)):
        best = [low + int(p[low:high].argmax()) for p in power]
        loud = [p[low:high].max() > 1e-3 for p in power]
        for gap in (1, 2):
            found += [t * 2**20 + gap * 2**16 + best[t] * 2**8 + best[t + gap] for t in range(n - gap) if loud[t] or loud[t + gap]]
    return sorted(found)


def test_fingerprints_match_brute_force():
    r = np.random.default_rng(5)
    for n in (0, 64, 256, 257, 384, 640, 6400):
        samples = r.integers(32, 127, n, dtype=np.uint8).tobytes()
        assert media.fingerprint(samples).tolist() == peaks(samples)


def test_media_round_trip(spark):
    docs = documents(spark)
    stored = media.text_to_media(docs)
    wavs = sorted(bytes(r["media"]) for r in stored.collect())
    assert wavs == sorted(media.to_wav(media.payload_of(r["text"])[1]) for r in docs.collect())
    rows = media.media_features(stored, ["doc_id", "n_bytes"]).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest() and r["media_bytes"] == len(payload) + 44
        assert seen.setdefault(raw, r["feature"]) == r["feature"]
    assert media.media_features(media.text_to_media(empty(spark)), ["doc_id"]).count() == 0


def test_fingerprints_find_a_shared_stretch():
    r = np.random.default_rng(0)
    shared = r.integers(32, 127, 128 * 60, dtype=np.uint8).tobytes()
    a = media.fingerprint(shared + r.integers(32, 127, 1280, dtype=np.uint8).tobytes())
    b = media.fingerprint(r.integers(32, 127, 128 * 7, dtype=np.uint8).tobytes() + shared)
    codes = {int(x) & 0xFFFFF: int(x) >> 20 for x in a}
    shifts = [(int(x) >> 20) - codes[int(x) & 0xFFFFF] for x in b if int(x) & 0xFFFFF in codes]
    assert shifts.count(7) > 0.5 * len(shifts)
