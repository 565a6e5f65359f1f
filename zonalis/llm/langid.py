"""Language identification with hyperdimensional profiles.

Each letter, and each mark that stands with letters, has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, the first permuted (rotated) twice and the second once. A text's profile bundles (adds) the
vectors of its trigrams, words being padded by a boundary symbol; a language's prototype bundles the
texts of that language. A text gets the language of greatest cosine, after the prototypes' common
part is taken off both sides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

DIMENSIONS = 512
SEED = 7
#: Labelled texts that a language's prototype bundles, about; chosen by a hash of doc_id and text.
TRAIN_PER_LANG = 2000
#: Trigram vectors that a task keeps.
KEPT = 1 << 15
#: Values of lang that are learned at most, those of the most texts; 2 kB of vectors each are broadcast.
MAX_LANGS = 10_000
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a mark that stands with letters, 0 for all else."""
    return np.fromiter((2 if (c := chr(i)).isalpha() else int(unicodedata.category(c)[0] == "M") for i in range(0x110000)), np.uint8, 0x110000)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The random vector of each code point: bits of a mixed hash of the code point and the word's place."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)[None, :] + points.astype(np.uint64)[:, None] * np.uint64(1 << 32) + np.uint64(SEED << 56)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        words = (words ^ (words >> np.uint64(shift))) * np.uint64(odd)
    words ^= words >> np.uint64(29)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


class Encoder:
    """Texts to profiles; keeps the vectors of trigrams that it has met."""

    def __init__(self):
        self.kinds = _letter_table()
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.vectors = np.zeros((KEPT, DIMENSIONS), np.float32)

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        a, b, c = (letter_vectors(grams >> np.uint64(s) & np.uint64(0x1FFFFF)) for s in (42, 21, 0))
        return (np.roll(a, 2, 1) * np.roll(b, 1, 1) * c).astype(np.float32)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Different trigrams (three code points of 21 bits, 0 at a boundary) and their counts. Runs of other
        characters are one boundary; marks belong to the word; a text without a letter has none."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[points]
        if not (kinds == 2).any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        s = np.concatenate([[0], np.where(kinds > 0, points, 0), [0]]).astype(np.uint64)
        s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
        grams = s[:-2] << np.uint64(42) | s[1:-1] << np.uint64(21) | s[2:]
        return np.unique(grams[s[1:-1] > 0], return_counts=True)

    def profile(self, text: str | None) -> np.ndarray | None:
        """The sum of the text's trigram vectors; None for a text without letters."""
        grams, counts = self.trigrams(text or "")
        if not len(grams):
            return None
        if len(grams) > KEPT:
            return sum(counts[i : i + KEPT].astype(np.float32) @ self._vectors(grams[i : i + KEPT]) for i in range(0, len(grams), KEPT))
        get = self.index.get
        at = np.fromiter((get(g, -1) for g in grams.tolist()), np.int64, len(grams))
        new = at < 0
        if n := int(new.sum()):
            if len(self.index) + n > KEPT:
                self._clear()
                new, n = np.ones(len(grams), bool), len(grams)
            places = np.arange(len(self.index), len(self.index) + n)
            self.vectors[places] = self._vectors(grams[new])
            self.index.update(zip(grams[new].tolist(), places.tolist(), strict=True))
            at[new] = places
        return counts.astype(np.float32) @ self.vectors[at]


@lru_cache(1)
def _encoder() -> Encoder:
    """The worker's encoder: the vectors that one task has met serve the next."""
    return Encoder()


class Prototypes:
    def __init__(self, sums: dict[str, np.ndarray]):
        self.names = sorted(k for k, v in sums.items() if np.any(v))
        units = np.array([sums[k] / np.linalg.norm(sums[k]) for k in self.names]).reshape(len(self.names), DIMENSIONS)
        self.common = units.mean(0) if len(self.names) > 1 else np.zeros(DIMENSIONS)
        own = units - self.common
        self.own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)

    def nearest(self, profile: np.ndarray | None) -> tuple[str, float]:
        if profile is None or not self.names or not (size := np.linalg.norm(profile)):
            return UNKNOWN, 0.0
        own = profile / size - self.common
        cosines = self.own @ own / max(np.linalg.norm(own), 1e-12)
        best = int(np.argmax(cosines))
        return self.names[best], float(min(1.0, max(0.0, cosines[best])))


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, sums = _encoder(), {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (p := encoder.profile(text)) is not None:
                sums[lang] = sums.get(lang, 0) + np.rint(p).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Prototypes:
    """Prototypes of the non-null lang values, from about per_lang texts of each (a documented sample:
    rows are counted per lang over all the data, then taken by hash at the rate that gives so many).
    What reaches the driver is one vector a language, of ``MAX_LANGS`` languages at most."""
    own = docs.where("lang is not null and text is not null")
    counts = checkpoint(own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS))
    rate = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"))
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = own.join(F.broadcast(counts), "lang").where(hashed < rate).select("lang", "text")
    sums = sample.mapInArrow(_bundle, "lang string, bundle array<bigint>").select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    whole = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v"))
    return Prototypes({r.lang: np.array(r.v, np.float64) for r in whole.toLocalIterator()})


def identify(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """doc_id, lang_pred, score for each row.

    lang_pred is a learned value, or ``und`` with score 0 where the text is null, has no letter or
    nothing was learned. score is the cosine, between 0 and 1; ties go to the first name. Repeated rows
    get the same; a null doc_id stays null; an empty table gives an empty table; other columns are not
    read. Whole texts are bundled.
    """
    held = docs.sparkSession.sparkContext.broadcast(prototypes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder()
        for b in batches:
            out = [held.value.nearest(encoder.profile(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")
