"""Language identification by the nearest of several centroids per language.

Texts become hashed, TF-IDF weighted and normalised counts of one to three letters. Each language has a few centroids,
found by clustering a bounded sample; the nearest by cosine gives the language, and a text that is too far from it is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, in_arrow, named

#: Expected rows of each language that the centroids are learned from; n-gram buckets; centroids a language.
SAMPLE, BUCKETS, CENTROIDS = 400, 1 << 13, 4
#: The most languages that are learned (131 kB each) and rows that are learned from.
LABELS, ROWS = 512, 20_000
#: A text is rejected below this part of the similarity that all but this share of a language's learned texts have to their
#: centroid. Longer texts are nearer to a centroid, so texts of fewer than SHORT different n-grams get by with less, in proportion.
SLACK, SHARE, SHORT = 0.5, 0.02, 200
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Buckets of all runs of one to three characters, where every stretch of non-letters counts as one space. Empty without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    c = np.concatenate(([32], np.where(is_letter, c, 32), [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    two = c[:-1] * np.uint32(0x01000193) + c[1:]
    three = two[:-1] * np.uint32(0x01000193) + c[2:]
    h = np.concatenate((c * np.uint32(7), two * np.uint32(11), three * np.uint32(13)))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as unit vectors of (1 + log tf) * idf; rows without counts stay zero."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of x by spherical k-means from spread-out first rows, and each row's similarity to its own."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack((centres, x[(x @ centres.T).max(1).argmin()][None]))
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (x @ centres.T).max(1)


class Model:
    """labels, idf, centroids (one unit row each), owner (label index of each row), floor (least similarity of each row)."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]], k: int = CENTROIDS):
        """rows: language, buckets and their counts of each text. One language at a time is made dense."""
        self.labels = sorted({lang for lang, _, _ in rows})
        seen = np.zeros(BUCKETS, np.int64)
        for _, at, _ in rows:
            seen[at] += 1
        self.idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
        centres, owner, floor = [], [], []
        for j, lang in enumerate(self.labels):
            texts = [r for r in rows if r[0] == lang]
            counts = np.zeros((len(texts), BUCKETS), np.float32)
            for i, (_, at, n) in enumerate(texts):
                counts[i, at] = n
            own, near = cluster(weigh(counts, self.idf), k)
            centres.append(own)
            owner += [j] * len(own)
            floor += [SLACK * float(np.quantile(near, SHARE))] * len(own)  # the same for all centroids of the language
        self.centres = np.vstack(centres).astype(np.float32) if centres else np.zeros((0, BUCKETS), np.float32)
        self.owner, self.floor = np.array(owner, int), np.array(floor)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(label or und, cosine 0 to 1, rejected) of each text; und, 0 and rejected without letters or labels."""
        out = []
        for at in range(0, len(texts), 32):
            part = [grams(t) for t in texts[at : at + 32]]
            flat = np.concatenate([g + i * BUCKETS for i, g in enumerate(part)])
            counts = np.bincount(flat, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS).astype(np.float32)
            near = weigh(counts, self.idf) @ self.centres.T
            for g, row, seen in zip(part, near, np.count_nonzero(counts, axis=1).tolist()):
                if len(g) and len(row):
                    j = int(row.argmax())
                    score = float(min(1, max(0, row[j])))
                    least = self.floor[j] * min(1.0, seen / SHORT)
                    out.append((self.labels[self.owner[j]], score, bool(row[j] < least)))
                else:
                    out.append(("und", 0.0, True))
        return out


def fold(key: Column, folds: int = 3) -> Column:
    """The fold of a row: crc32 of the key as text, modulo folds."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % folds


def fit(labelled: DataFrame, per_language: int = SAMPLE, k: int = CENTROIDS, most_labels: int = LABELS, most_rows: int = ROWS) -> Model:
    """Learn from columns text, lang and a sampling key. Null langs and texts without letters teach nothing.

    About ``per_language`` rows of each language are used, chosen by a hash of the key; what comes to the driver is their
    n-gram counts, at most BUCKETS numbers a row. Where lang holds something else than languages, the model stays
    bounded: of more than ``most_labels`` values those with the most rows are learned, the first of equals in order, and
    with many of them fewer rows each, so that about ``most_rows`` come together.
    """
    labelled = labelled.where("lang is not null and text is not null")
    parts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).collect()
    if not parts:
        return Model([], k)
    each = min(per_language, max(1, most_rows // len(parts)))
    rates = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in parts], "lang string, rate double")
    labelled = labelled.join(F.broadcast(rates), "lang")  # most_labels rows at most
    chosen = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(t), return_counts=True) for t in batch.column(1).to_pylist()]
            cols = [pa.array([f[i].astype(np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["lang", "at", "n"])

    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in in_arrow(chosen, count, "lang string, at binary, n binary").collect())
    return Model([(lang, np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)) for lang, at, n in rows if at], k)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Add lang_pred (und without letters or for null text), score and rejected to the kept columns.

    text: the column to judge, or "row.text" for a field of a kept struct, which is then not sent twice.
    """
    inner = text.startswith(f"{keep[0]}.")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: labels x CENTROIDS x BUCKETS

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict((batch.column(0).field(text.partition(".")[2]) if inner else batch.column(len(keep))).to_pylist())
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *cols], names=[*keep, "lang_pred", "score", "rejected"])

    sent = docs.select(*map(named, keep)) if inner else docs.select(*map(named, keep), F.col(text).alias("_text"))
    return in_arrow(sent, predict, extended(docs, keep, "lang_pred string, score double, rejected boolean"))


def identify_documents(documents: DataFrame, keep: list[str], per_language: int = SAMPLE) -> DataFrame:
    """Fit on the rows whose fold is not 1, then predict all rows: keep, held_out, lang_pred, score, rejected.

    A null doc_id falls into the fold of the empty string. Repeated rows get equal results. Without labelled rows all
    texts are und.
    """
    train = documents.where(fold(F.col("doc_id")) != 1).select("text", "lang", F.col("doc_id").alias("key"))
    model = fit(train, per_language)
    rows = documents.withColumn("held_out", fold(F.col("doc_id")) == 1)
    return identify(rows, model, [*keep, "held_out"])


def accepted(documents: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """The documents, in their own columns, that are not rejected: they have letters and are near enough to a learned language.

    Without any labelled document nothing can be near or far, so all texts with letters stay.
    """
    model = fit(documents.select("text", "lang", F.col("doc_id").alias("key")), per_language)
    rows = documents.select(F.struct(*map(named, documents.columns)).alias("row"))
    if not model.labels:
        return rows.where(F.col("row.text").rlike(r"\p{L}")).select("row.*")
    return identify(rows, model, ["row"], "row.text").where("not rejected").select("row.*")
