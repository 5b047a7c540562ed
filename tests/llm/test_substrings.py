import hashlib
import random

import pytest

from quirefold.llm import substrings

from .data import SF, documents, empty


def brute(rows):
    """(n_words, n_removed, sha) for each (doc_id, text); rows with id, sorted by it."""
    first, out = {}, {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][s : s + 20]), (i, s))
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (i, s):
                gone.update(range(s, s + 20))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_tables_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = result(substrings.deduplicated_words(docs))
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


def test_awkward_rows(spark):
    docs = documents(spark)
    out = substrings.deduplicated_words(docs)
    assert out.count() == docs.count()
    got = result(out.where("doc_id is not null"))
    assert got == brute({(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()})
    assert got[6][1] == 0 and got[7][1] == 300 and got[12][1] == 75
    assert substrings.deduplicated_words(empty(spark)).count() == 0


def test_texts_without_repeats(spark):
    docs = documents(spark)
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[6] == before[6] and texts[7] == "" and texts[0] is None and texts[11] == "tail"
    for i, (_, _, sha) in brute({(i, t) for i, t in before.items() if i is not None}).items():
        assert hashlib.sha256(b" ".join((texts[i] or "").encode().split())).hexdigest() == sha


class Blind:
    def iter(self, text):
        return ()


def test_removal_follows_from_the_automata():
    """Every removed run comes from Shard.locate(), which finds nothing without its automaton."""
    words = [b"w%d" % j for j in range(30)]
    shard = substrings.Shard([(0, 0, 0, b" ".join(words))])
    assert shard.locate(5, 5, 7, words) != ([], [])
    assert shard.locate(0, 0, 0, words) == ([], [])  # the owner's own place
    shard.automaton = Blind()
    assert shard.locate(5, 5, 7, words) == ([], [])


def test_a_shard_finds_every_word_in_a_window_of_its_passages():
    r = random.Random(2)
    for shared in (0, 1, 8):
        texts = [[r.choice("abc") for _ in range(r.randint(20, 90))] for _ in range(30)]
        seen, passages = set(), []
        for i, words in enumerate(texts):  # passages with windows that no other has, as the operator makes them
            for s in range(len(words) - 19):
                if (w := tuple(words[s : s + 20])) not in seen:
                    seen.add(w)
                    passages.append((i, i, s, " ".join(w).encode()))
        old, substrings.SHARED = substrings.SHARED, shared
        try:
            shard = substrings.Shard(passages)
        finally:
            substrings.SHARED = old
        stream = [r.choice("abc") for _ in range(200)] + texts[3][:25] + ["d"] + texts[7] + texts[9][5:40]
        want = {p for s in range(len(stream) - 19) if tuple(stream[s : s + 20]) in seen for p in range(s, s + 20)}
        starts, stops = shard.locate(10**6, 0, 100, [w.encode() for w in stream])
        assert {p - 100 for a, b in zip(starts, stops) for p in range(a, b)} == want and len(want) < len(stream)


def test_hot_passages_over_many_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WINDOWS", 5)
    monkeypatch.setattr(substrings, "STREAM_CHARS", 500)
    monkeypatch.setattr(substrings, "STRETCH", 7)
    line = [f"x{j}" for j in range(30)]
    rows = [(i, " ".join([f"a{i}", *line[i % 5 :], f"b{i % 7}", *line[: 20 + i % 3]] * (1 + i % 2))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substrings.deduplicated_words(docs)) == brute(rows)


def test_ids_that_are_no_integers_are_refused_in_words(spark):
    with pytest.raises(TypeError, match="integer"):
        substrings.deduplicated_words(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
