"""Token counts and token ids by public tokenizers, in Arrow batches."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import extended, in_arrow, named

#: Bytes of text given to the tokenizer at once, and the length from which a text is split.
BATCH_BYTES, LONG_CHARS = 1 << 18, 1 << 16
#: Where a byte-level BPE text may be cut, as no token spans it: before a single space between two visible characters, and
#: between a mark outside ASCII (as in Chinese or Japanese) and a letter.
SAFE = re.compile(r"(?<=\S) (?=\S)|(?<=[^\s\w\x00-\x7F])(?=[^\W\d_])")
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file; one per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def split_safely(text: str, most: int = LONG_CHARS) -> list[str]:
    """Pieces of at least ``most`` characters, cut only where pre-tokens end, so that token counts add up exactly."""
    pieces, start = [], 0
    while len(text) - start > most and (m := SAFE.search(text, start + most)):
        pieces.append(text[start : m.start()])
        start = m.start()
    return [*pieces, text[start:]]


def by_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of pieces of about ``most`` bytes, with the index of the text that each piece is from."""
    pieces, owner, held = [], [], 0
    for i, text in enumerate(texts):
        for piece in split_safely(text):
            pieces.append(piece)
            owner.append(i)
            held += len(piece.encode())
            if held >= most:
                yield pieces, owner
                pieces, owner, held = [], [], 0
    if pieces:
        yield pieces, owner


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). Only lengths leave the Python workers.

    Null text counts as empty: 0 bytes, 0 tokens. Rows are kept one by one, repeated ones too. Long texts are split
    where no token can span the cut, so any length is counted whole. Strings of special tokens inside a text count as
    the tokenizer does by default, as one token.
    """
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch_fast
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            for pieces, owner in by_bytes(texts):
                for i, e in zip(owner, encode(pieces, add_special_tokens=False)):
                    counts[i] += len(e)
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return in_arrow(docs.select(named(key), named(text)), lengths, extended(docs, [key], "n_bytes long, n_tokens long, over_limit boolean"))


#: The steps before the model that leave a word of small Latin-1 letters as it is, one pre-token of byte letters.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_model(full):
    """The model of a tokenizer alone, for byte_letters() of words of small Latin-1 letters between spaces; None if its other steps may change such words."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps = [json.loads(x.__getstate__()) if x else {} for x in (full.normalizer, full.pre_tokenizer)]
    normal, splits = steps[0].get("normalizers", []), steps[1].get("pretokenizers", [])
    if [x["type"] for x in normal] != _NORMAL or normal[1]["pattern"] != {"Regex": "\\s+"} or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
        return None
    split, letters = splits
    if split["pattern"] != {"Regex": _SPLIT} or (split["behavior"], split["invert"]) != ("Removed", True) or letters["add_prefix_space"] or letters["use_regex"] or full.post_processor:
        return None
    model = Tokenizer(full.model)
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return model


def byte_letters(words: str) -> str:
    """Small Latin-1 letters and spaces with each UTF-8 byte as the letter that byte-level models have for it."""
    return words.encode().decode("latin-1").replace("\x9f", "Ł").replace("\xa0", "ł").replace("\xad", "Ń")


class ChunkIds:
    """Token ids of texts by way of the chunks between spaces and line feeds, which no token of a word-end BPE spans.

    The ids of a chunk are kept, up to ``most`` chunks: when half as many are new or were met again since the last time,
    all others are forgotten. Unknown chunks go through the tokenizer itself: Latin-1 words joined and told apart by the
    ids that end a word (by its model alone where no other step changes them), a word with marks behind it as two parts,
    others one by one. Latin-1 texts are lower-cased before, as the tokenizer does later, which leaves fewer chunks.
    """

    WORD, MARKS = re.compile(r"[a-zß-öø-ÿ]+"), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, most: int = 300_000):
        self.encode = tokenizer(path).encode_batch_fast
        vocab = tokenizer(path).get_vocab()
        self.ends = {i for w, i in vocab.items() if w.endswith("</w>")}
        self.model = word_model(tokenizer(path))
        self.most, self.known, self.before = most, {}, {}

    def word_ids(self, words: list[str]) -> list[int]:
        """The ids of small Latin-1 words, one after another."""
        joined = " ".join(words)
        if self.model:
            return self.model.encode_batch_fast([byte_letters(joined)], add_special_tokens=False)[0].ids
        return self.encode([joined], add_special_tokens=False)[0].ids

    def learn(self, chunks: set[str]) -> None:
        known, match, marks, own, parts, other = self.known, self.WORD.fullmatch, self.MARKS, set(), [], []
        for c in chunks:
            word = c.rstrip(marks)
            if match(word):
                own.add(word)
                if len(word) < len(c):
                    parts.append((c, word, c[len(word) :]))
            else:
                other.append(c)
        other += {tail for _, _, tail in parts}.difference(known, other)
        for w, e in zip(other, self.encode(other, add_special_tokens=False)):
            known[w] = struct.pack(f"<{len(e)}I", *e.ids)
        words = list(own.difference(known))
        for at in range(0, len(words), 500):
            group = words[at : at + 500]
            ids = self.word_ids(group)
            raw = struct.pack(f"<{len(ids)}I", *ids)
            stops = [4 * i + 4 for i, x in enumerate(ids) if x in self.ends]
            if len(stops) != len(group):  # a word without an end, or with several: one by one
                for w, e in zip(group, self.encode(group, add_special_tokens=False)):
                    known[w] = struct.pack(f"<{len(e)}I", *e.ids)
                continue
            start = 0
            for w, stop in zip(group, stops):
                known[w] = raw[start:stop]
                start = stop
        for c, word, tail in parts:
            known[c] = known[word] + known[tail]

    @staticmethod
    def spaced(text: str) -> str:
        """The text with its chunks between single spaces."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            if "<|" not in text:
                text = text.lower()
        return text.replace("\n", " ")

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), 200):
            parts = pc.split_pattern(pa.array(map(self.spaced, texts[at : at + 200]), pa.large_string()), " ")
            coded = pc.list_flatten(parts).dictionary_encode()
            chunks, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
            if len(self.known) > self.most // 2:
                self.known, self.before = {}, self.known
            known, before = self.known, self.before
            if new := set(chunks).difference(known):
                again = [c for c in new if c in before]
                known.update(zip(again, map(before.__getitem__, again)))
                if new := new.difference(again):
                    self.learn(new)
            own = [known[c] for c in chunks]
            ids = np.frombuffer(b"".join(own), np.uint32)
            lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
            n = lengths[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            raw = ids[np.arange(ends[-1]) + np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], n)].tobytes()
            stops = (ends[parts.offsets.to_numpy()] * 4).tolist()
            for start, stop in zip(stops, stops[1:]):
                yield raw[start:stop]
