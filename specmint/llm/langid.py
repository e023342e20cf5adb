"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmint.llm.common import held_out, slices, sum_vectors, table

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
_SEED = 0x5EED


def letter_vector(code: int) -> np.ndarray:
    """The random +-1 vector of a code point; the same in every process."""
    return np.random.default_rng([_SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class Bundler:
    """Text vectors: sums over n-grams of the bound, permuted vectors of their letters.

    An n-gram abc is bound as rho(rho(A)) * rho(B) * C, rho a rotation by one place. The
    vectors of `limit` n-grams are kept; more only cost time.
    """

    def __init__(self, limit: int = 20_000) -> None:
        self.limit = limit
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.grams = np.zeros((1024, DIMENSIONS), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 50_000:
                self.letters.clear()
            self.letters[code] = letter_vector(code)
        return self.letters[code]

    def _gram(self, key: int) -> np.ndarray:
        out = np.ones(DIMENSIONS, np.int8)
        for shift in range(GRAM):
            out = out * np.roll(self._letter(key >> 21 * shift & 0x1FFFFF), shift)
        return out.astype(np.float32)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(n-gram keys, counts) of the lower-cased letters, other runs being one blank; None without a letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = letters_among(codes)
        if not letter.any():
            return None
        codes = np.concatenate([[32], np.where(letter, codes, 32), [32]])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if codes[-1] != 32:
            codes = np.concatenate([codes, [32]])
        keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        return np.unique(keys, return_counts=True)

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(rows x DIMENSIONS vectors, which rows have a letter)."""
        found = [self.counts(t) for t in texts]
        some = np.array([f is not None for f in found], bool)
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        if not some.any():
            return out, some
        keys = np.concatenate([f[0] for f in found if f is not None])
        n = np.concatenate([f[1] for f in found if f is not None])
        row = np.repeat(np.nonzero(some)[0], [len(f[0]) for f in found if f is not None])
        distinct, at = np.unique(keys, return_inverse=True)
        for first in range(0, len(distinct), 4096):
            here = np.nonzero((at >= first) & (at < first + 4096))[0]
            dense = np.zeros((len(texts), min(4096, len(distinct) - first)), np.float32)
            dense[row[here], at[here] - first] = n[here]
            out += dense @ self._vectors(distinct[first : first + 4096])
        return out, some

    def _vectors(self, keys: np.ndarray) -> np.ndarray:
        new = [k for k in keys.tolist() if k not in self.place]
        if len(self.place) + len(new) > max(self.limit, 4096):
            self.place.clear()
            new = keys.tolist()
        if len(self.place) + len(new) > len(self.grams):
            grown = np.zeros((max(2 * len(self.grams), len(self.place) + len(new)), DIMENSIONS), np.float32)
            grown[: len(self.grams)] = self.grams
            self.grams = grown
        for k in new:
            self.grams[len(self.place)] = self._gram(k)
            self.place[k] = len(self.place)
        return self.grams[[self.place[k] for k in keys.tolist()]]


_LETTER = np.zeros(0, bool)


def letters_among(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters (str.isalpha)."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _LETTER[codes]


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The learned languages and their unit vectors, from all rows that labels may be learned from.

    Each task adds its rows up by language (every text with unit length, so long ones don't
    outweigh the rest); its few vectors meet in a tree of sums. A language that holds most
    rows is one vector per task like any other.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        maker, sums = Bundler(), {}
        for batch in batches:
            for some in slices(batch):
                vectors, has = maker.bundle(some.column(1).to_pylist())
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                langs = np.array(some.column(0).to_pylist(), object)
                for lang in set(langs[has]):
                    sums[lang] = sums.get(lang, 0) + vectors[has & (langs == lang)].sum(axis=0, dtype=np.float64)
        if sums:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"key": list(sums), "part": pa.array([part] * len(sums), pa.int32()), "vec": [v.tobytes() for v in sums.values()]})

    parts = rows.mapInArrow(run, "key string, part int, vec binary")
    found = sorted((r["key"], np.frombuffer(r["vec"])) for r in sum_vectors(parts, rows.rdd.getNumPartitions()).collect())
    langs = [k for k, _ in found]
    vectors = np.array([v / max(np.linalg.norm(v), 1e-9) for _, v in found], np.float32).reshape(len(langs), DIMENSIONS)
    return langs, vectors


def identify(docs: DataFrame, langs: list[str], vectors: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per input row.

    The text's vector is compared with each prototype by cosine, centred on the mean of the
    prototypes, which all texts share; the best language wins, ties by name. `score` is the
    winner's plain cosine cut to 0..1. A text that is null or has no letter is `und` with
    score 0, and so is every row when nothing was learned. Whole texts count; repeated
    rows agree; a null doc_id counts as held out. Empty input, empty result; lang, source and
    any further column play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    names = list(langs)
    centre = vectors.mean(axis=0) if len(vectors) > 1 else np.zeros(DIMENSIONS, np.float32)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, known = Bundler(), shared.value
        central = known - centre
        for batch in batches:
            for some in slices(batch):
                found, has = maker.bundle(some.column(1).to_pylist())
                preds, scores = [UNKNOWN] * some.num_rows, np.zeros(some.num_rows)
                if names:
                    cos = found @ known.T / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
                    best = (found @ (central / np.maximum(np.linalg.norm(central, axis=1, keepdims=True), 1e-9)).T).argmax(axis=1)
                    scores = np.where(has, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0).astype(np.float64)
                    preds = [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, *prototypes(docs))
