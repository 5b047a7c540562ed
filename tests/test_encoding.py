"""Windows of tokens against the tokenizer library's own pairs, truncation and padding; decoding over windows by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quirefold.operators import encoding, readers

SPECIALS = encoding.Specials(49406, 49407, 0)


def library(path, size, overlap):
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    ids = [("<|startoftext|>", SPECIALS.first), ("<|endoftext|>", SPECIALS.separator)]
    t.post_processor = processors.TemplateProcessing(single="<|startoftext|> $A <|endoftext|>", pair="<|startoftext|> $A <|endoftext|> <|endoftext|> $B:1 <|endoftext|>:1", special_tokens=ids)
    t.enable_truncation(size, stride=overlap, strategy="only_second")
    t.enable_padding(length=size, pad_id=SPECIALS.padding, pad_token="!")
    return t


def pages():
    r = random.Random(8)
    letters = "abcdefgh,.'-é日ß😀"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 12))).strip() or "x"
    asked = lambda: [word()[:2].strip() or "x" for _ in range(r.randint(1, 4))]  # noqa: E731  short: the library refuses a question that leaves no step
    rows = [(i, asked(), [word() for _ in range(n)]) for i, n in enumerate((0, 1, 5, 17, 18, 40, 133, 400))]
    return rows + [(8, ["what", "is"], ["Total", "TOTAL", "...", "don't", "x" * 90, "1,200.00", "<|endoftext|>", "!"] * 9)]


@pytest.mark.parametrize("size,overlap", [(64, 16), (512, 128), (48, 0)])
def test_windows_are_those_of_the_library(spark, size, overlap):
    path, rows = encoding.vocabulary("word_bpe_49k.json"), pages()
    boxes = lambda w: [[i, i + 1, i + 2, i + 3] for i in range(len(w))]
    df = spark.createDataFrame([(k, q, w, boxes(w), "clash") for k, q, w in rows], "page_id long, question array<string>, words array<string>, boxes array<array<int>>, window string").repartition(3)
    got = sorted((tuple(r) for r in encoding.encode_windows(df, "page_id", path, SPECIALS, size, overlap).collect()), key=lambda r: r[:2])
    tokenizer, want = library(path, size, overlap), []
    for key, question, words in rows:
        first = tokenizer.encode(question, words, is_pretokenized=True)
        for n, e in enumerate([first, *first.overflowing]):
            box = [boxes(words)[w] if s == 1 else [1000] * 4 if i == SPECIALS.separator else [0] * 4 for i, s, w in zip(e.ids, e.sequence_ids, e.word_ids)]
            want.append((key, n, sum(e.attention_mask), e.ids, e.sequence_ids, e.word_ids, box))
    assert [(*r[:2], *r[3:]) for r in got] == want
    assert len(want) > len(rows) or size == 512


def test_spans_and_odd_words(spark):
    path = encoding.vocabulary("word_bpe_49k.json")
    df = spark.createDataFrame([(1, ["unbelievably", None, "", "ok", "1,200.00"]), (2, None), (3, [])], "k long, words array<string>")
    e = {r.k: r.e for r in df.select("k", encoding.encode_words(F.col("words"), path).alias("e")).collect()}
    assert e[2].ids == [] and e[3].word_of == [] and sorted(set(e[1].word_of)) == [0, 3, 4]
    n = df.where("k = 1").select(*[encoding.span_tokens(encoding.encode_words(F.col("words"), path)["word_of"], F.lit(a), F.lit(b)) for a, b in ((1, 2), (3, 3), (3, 4))]).first()
    assert tuple(n) == (0, 1, 1 + e[1].word_of.count(4))
    one = spark.range(1).select(encoding.window_span(F.expr("array(null, 0, null, 1, 1, 1, null)"), F.expr("array(null, 2, null, 1, 2, 2, null)"), F.lit(2), F.lit(3)).alias("s")).select("s.*").first()
    assert tuple(one) == (4, 5)


def decoded(windows, longest):
    """As a reader does: masked softmax, upper triangle, the first greatest; a later window has to be better."""
    best = (None, None, 0.0)
    for start, end, allowed, words in windows:
        ok = np.array(allowed)
        if not ok.any():
            continue
        p, q = (np.where(ok, np.exp(np.where(ok, x, 0) - max(v for v, k in zip(x, allowed) if k)), 0) for x in (np.array(start), np.array(end)))
        scores = np.outer(p / p.sum(), q / q.sum())
        scores = np.triu(scores) - np.triu(scores, longest)
        i, j = divmod(int(scores.argmax()), len(start))
        if scores[i, j] > best[2] and words[i] is not None and words[j] is not None:
            best = (words[i], words[j], float(scores[i, j]))
    return best if best[0] is not None else (None, None, None)


def test_decoding_over_windows(spark):
    r, rows, want = random.Random(5), [], {}
    for key in range(40):
        windows = []
        for w in range(r.randint(1, 4)):
            n = r.randint(1, 20)
            value = lambda: float(r.randint(-3, 3)) if key % 2 else r.gauss(0, 3)  # noqa: B023, E731  ties for odd keys
            windows.append(([value() for _ in range(n)], [value() for _ in range(n)], [r.random() < (0.0, 0.7, 1.0)[key % 3] for _ in range(n)], [r.choice([None, *range(5)]) if key % 5 == 0 else i // 2 for i in range(n)]))
        if key == 7:  # the same window twice: the first counts
            windows = [windows[0], windows[0]]
        want[key] = decoded(windows, 4)
        rows += [(key, i, *w) for i, w in enumerate(windows)]
    df = spark.createDataFrame(rows, "k long, window int, start_logits array<double>, end_logits array<double>, allowed array<boolean>, word_ids array<int>").repartition(4)
    got = {x.k: x for x in readers.decode_windows(df, "k", 4).collect()}
    assert len(got) == 40 and sum(x[0] is None for x in want.values()) >= 13
    for key, (start, end, score) in want.items():
        assert (got[key].start, got[key].end) == (start, end), key
        assert got[key].score is None if score is None else math.isclose(got[key].score, score, rel_tol=1e-9)
        assert got[key].n_windows == sum(k == key for k, *_ in rows)
