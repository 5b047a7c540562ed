"""Words as tokens of a public tokenizer, and windows of them as a neural reader takes them (ML-01, ML-07, ALN-02)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .readers import OVERLAP, SPECIAL, WINDOW, windows

#: What the box of a separator holds four times; all other special tokens have zeros.
GRID = 1000
_loaded: dict[str, object] = {}


class Specials(NamedTuple):
    """Ids of the special tokens: before the question, between and behind the parts, after the end."""

    first: int
    separator: int
    padding: int


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def encode_batch(words: pa.Array, path: str) -> pa.Array:
    """Arrays of words -> structs of ids and word_of (which word each token is of). Each different word of a batch is encoded once."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.fill_null(words.flatten(), "").dictionary_encode()
    found = _tokenizer(path).encode_batch(coded.dictionary.to_pylist(), add_special_tokens=False)
    sizes = np.array([len(e.ids) for e in found], np.int64)
    known = np.array([i for e in found for i in e.ids], np.int32)
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = sizes[at]
    total = int(counts.sum())
    firsts = np.cumsum(counts) - counts  # of each word among the tokens
    within = np.arange(total) - np.repeat(firsts, counts)
    ids = known[np.repeat((np.cumsum(sizes) - sizes)[at], counts) + within] if total else np.zeros(0, np.int32)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(starts, lengths)  # of each word in its row
    ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (ids, np.repeat(place, counts))]
    return pa.StructArray.from_arrays(lists, names=["ids", "word_of"])


def encode_words(words: Column, path: str) -> Column:
    """struct(ids, word_of) of an array of words: the tokens of each word by itself, and which word each token is of.

    A null array has no tokens, a null word neither. Works in Arrow batches; each worker loads the tokenizer once.
    """

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield encode_batch(batch, path)

    encoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encoded, "struct<ids:array<int>,word_of:array<int>>")(words)


#: Words whose number of tokens a worker remembers.
KNOWN = 1 << 18
_counts: dict[str, dict[str, int]] = {}


def count_batch(words: pa.Array, path: str) -> pa.Array:
    """Arrays of words -> arrays of how many tokens each word has. A word that comes again is not encoded again."""
    coded = pc.fill_null(words.flatten(), "").dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    known = _counts.setdefault(path, {})
    if len(known) > KNOWN:
        known.clear()
    new = [w for w in distinct if w not in known]
    known.update(zip(new, map(len, _tokenizer(path).encode_batch_fast(new, add_special_tokens=False))))
    sizes = np.fromiter(map(known.__getitem__, distinct), np.int32, len(distinct))
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(sizes[coded.indices.to_numpy(zero_copy_only=False)], pa.int32()))


def count_tokens(words: Column, path: str) -> Column:
    """How many tokens each word of an array has by itself, which is all that limits need of encode_words(); empty for a null array."""

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield count_batch(batch, path)

    counted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counted, "array<int>")(words)


def encode_windows(rows: DataFrame, key: str, path: str, specials: Specials, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """ML-01: rows (key, question, words, boxes) -> key, window, start, n_tokens, input_ids, sequence, word_ids, boxes.

    question and words are arrays of words, boxes one of four whole numbers for each word. A window is first, question,
    two separators, tokens of the page, separator, and padding up to ``size``; the next one starts ``overlap`` page
    tokens before the end of the last. start: page tokens before the window; n_tokens: without padding; sequence: 0 for
    the question, 1 for the page, null for special tokens; word_ids: the word within question or page. A page token has
    the box of its word, a separator GRID four times, all else zeros. A page without tokens has one window. A question
    that leaves no room for a window to go on gets the windows that cover its page, or none.
    """
    coded = rows.select(key, "boxes", encode_words(F.col("question"), path).alias("q"), encode_words(F.col("words"), path).alias("d"))
    cut = windows(coded, key, F.size("q.ids"), F.size("d.ids"), size, overlap, keep=["q", "d", "boxes"])
    room = F.greatest((F.col("stop") - F.col("start")).cast("int"), F.lit(0))
    part = lambda c: F.slice(F.col(f"d.{c}"), F.col("start").cast("int") + 1, room)
    ints = lambda *x: F.array(*[F.lit(v).cast("int") for v in x])
    pad = F.array_repeat(F.lit(None).cast("int"), F.lit(size) - SPECIAL - F.size("q.ids") - room)
    fill = lambda v: F.transform(pad, lambda _: F.lit(v).cast("int"))
    same = lambda x, v: F.transform(x, lambda _: F.lit(v).cast("int"))
    ids = F.concat(ints(specials.first), F.col("q.ids"), ints(specials.separator, specials.separator), part("ids"), ints(specials.separator), fill(specials.padding))
    sequence = F.concat(ints(None), same(F.col("q.ids"), 0), ints(None, None), same(part("ids"), 1), ints(None), pad)
    word_ids = F.concat(ints(None), F.col("q.word_of"), ints(None, None), part("word_of"), ints(None), pad)
    out = cut.select(key, "window", "start", (F.size("q.ids") + SPECIAL + room).alias("n_tokens"), ids.alias("input_ids"), sequence.alias("sequence"), word_ids.alias("word_ids"), F.col("boxes").alias("word_boxes"))

    def box(token: Column) -> Column:
        own = F.get("word_boxes", token["word_ids"])
        return F.when(token["sequence"] == 1, own).when(token["input_ids"] == specials.separator, ints(*[GRID] * 4)).otherwise(ints(0, 0, 0, 0))

    return out.withColumn("boxes", F.transform(F.arrays_zip("input_ids", "sequence", "word_ids"), box)).drop("word_boxes")


def window_span(sequence: Column, word_ids: Column, start: Column, end: Column) -> Column:
    """ML-07: struct(first_token, last_token) of the page's words start to end in a window; nulls if none of their tokens is there."""
    page = F.zip_with(sequence, word_ids, lambda s, w: F.when(s == 1, w))
    places = F.filter(F.transform(page, lambda w, i: F.when((w >= start) & (w <= end), i)), lambda i: i.isNotNull())
    return let(places, lambda p: F.struct(F.array_min(p).alias("first_token"), F.array_max(p).alias("last_token")))


def span_tokens(word_of: Column, start: Column, end: Column) -> Column:
    """ALN-02: how many tokens the words start to end have."""
    return F.size(F.filter(word_of, lambda w: (w >= start) & (w <= end)))
