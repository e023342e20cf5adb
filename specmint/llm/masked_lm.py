"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmint.llm.common import slices, sum_vectors, table
from specmint.storage import materialize

#: Hashed vocabulary: the leaves of a tree with ARITY children a node and LEVELS levels.
BITS, LEVELS = 4, 3
ARITY = 1 << BITS
VOCAB = ARITY**LEVELS
#: Index of "beyond the text", which is context only.
EDGE = VOCAB
WIDTH = 32
#: Words on either side that predict a word.
REACH = 3
OFFSETS = tuple(o for o in range(-REACH, REACH + 1) if o)
#: The rounds share the texts out: together they train on every word of every text once.
ROUNDS = 2
#: Words of a share, which one copy of the network is trained on, and the most shares; beyond them shares grow.
SHARE_WORDS, MOST_SHARES = 1 << 22, 1 << 14
#: Positions of a gradient step: a share makes about STEPS, none on more positions than MOST_BATCH.
STEPS, LEAST_BATCH, MOST_BATCH = 512, 256, 4096
RATE = 0.2
_CHUNK = 1 << 16


class Words:
    """Word buckets by CRC-32 of the lower-cased word; beyond `limit` words the cache takes no more."""

    def __init__(self, limit: int = 500_000) -> None:
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            for i, b in enumerate(got):
                if b is None:
                    b = got[i] = zlib.crc32(words[i]) % VOCAB
                    if len(known) < self.limit:
                        known[words[i]] = b
        return np.array(got, np.uint16)


def stream(texts: list[np.ndarray]) -> np.ndarray:
    """Texts one after the other with REACH edges around each, so that no window sees a neighbour text."""
    edge = np.full(REACH, EDGE, np.uint16)
    return np.concatenate([edge, *(x for t in texts for x in (t, edge))])


class Network:
    """p(word | both sides) is a product over the levels of a tree, softmaxes of h = tanh(b + sum of g_o * e[neighbour o]).

    Every word has one vector, and every offset a gate for it, so left and right context differ.
    """

    SHAPES = (
        {"e": (VOCAB + 1, WIDTH), "g": (len(OFFSETS), WIDTH), "b": (WIDTH,)}
        | {f"w{k}": (ARITY**k, WIDTH, ARITY) for k in range(LEVELS)}
        | {f"c{k}": (ARITY**k, ARITY) for k in range(LEVELS)}
    )

    def __init__(self, params: dict[str, np.ndarray], seen: dict[str, np.ndarray] | None = None) -> None:
        self.p = params
        #: Sums of squared gradients; they go with the parameters from round to round.
        self.seen = seen or {k: np.full(v.shape, 1e-3, np.float32) for k, v in params.items()}

    @classmethod
    def initial(cls, counts: np.ndarray) -> Network:
        """Random small weights; output biases are the corpus's log frequencies."""
        rng = np.random.default_rng(11)
        p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in cls.SHAPES.items()}
        p["g"] += 1
        p["b"][:] = 0
        freq = counts + 0.5
        for k in range(LEVELS):
            nodes = freq.reshape(ARITY**k, ARITY, -1).sum(axis=2)
            p[f"c{k}"] = np.log(nodes / nodes.sum(axis=1, keepdims=True)).astype(np.float32)
            p[f"w{k}"] *= 0.5
        return cls(p)

    def _hidden(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of the window's words, hidden units of all but its first and last REACH)."""
        vectors = self.p["e"][window]
        n = len(window) - 2 * REACH
        h = np.empty((n, WIDTH), np.float32)
        h[:] = self.p["b"]
        for gate, o in zip(self.p["g"], OFFSETS, strict=True):
            h += gate * vectors[REACH + o : REACH + o + n]
        return vectors, np.tanh(h, out=h)

    @staticmethod
    def _targets(window: np.ndarray) -> np.ndarray:
        """Places of the words to predict, edges left out, in order of the word: then a node's words are one run."""
        t = window[REACH : len(window) - REACH]
        places = np.nonzero(t < VOCAB)[0]
        return places[np.argsort(t[places], kind="stable")]

    def _level(self, k: int, h: np.ndarray, t: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """(runs of equal nodes, logits less their largest, child taken) at level k for words in order."""
        node, child = t >> BITS * (LEVELS - k), t >> BITS * (LEVELS - k - 1) & ARITY - 1
        cuts = np.searchsorted(node, np.arange(ARITY**k + 1)).tolist()
        runs = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        w, z = self.p[f"w{k}"], np.empty((len(t), ARITY), np.float32)
        for i, a, b in runs:
            np.matmul(h[a:b], w[i], out=z[a:b])
        z += self.p[f"c{k}"][node]
        z -= z.max(axis=1, keepdims=True)
        return runs, z, child

    def log_prob(self, texts: np.ndarray, block: int = 1 << 13) -> np.ndarray:
        """Natural log-probability of every word of a stream given its neighbours; 0 at the edges."""
        out = np.zeros(len(texts))
        for at in range(REACH, len(texts) - REACH, block):
            window = texts[at - REACH : min(at + block, len(texts) - REACH) + REACH]
            places = self._targets(window)
            t, h = window[REACH + places].astype(np.int64), self._hidden(window)[1][places]
            logs, rows = np.zeros(len(t), np.float32), np.arange(len(t))
            for k in range(LEVELS):
                _, z, child = self._level(k, h, t)
                logs += z[rows, child] - np.log(np.exp(z).sum(axis=1))
            out[at + places] = logs
        return out

    def _step(self, key: str, at, grad: np.ndarray) -> None:
        sums = self.seen[key][at] + grad * grad
        self.seen[key][at] = sums
        self.p[key][at] -= RATE * grad / np.sqrt(sums)

    def train(self, window: np.ndarray) -> None:
        """One adaptive gradient step on all words of a stream but its first and last REACH, which are context."""
        places = self._targets(window)
        m, n = len(places), len(window) - 2 * REACH
        if not m:
            return
        vectors, hidden = self._hidden(window)
        t, h = window[REACH + places].astype(np.int64), hidden[places]
        dh, part, rows = np.zeros_like(h), np.empty_like(h), np.arange(m)
        for k in range(LEVELS):
            runs, z, child = self._level(k, h, t)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            z[rows, child] -= 1
            z /= m
            w, dw = self.p[f"w{k}"], np.empty((len(runs), WIDTH, ARITY), np.float32)
            for j, (i, a, b) in enumerate(runs):
                np.matmul(z[a:b], w[i].T, out=part[a:b])
                np.matmul(h[a:b].T, z[a:b], out=dw[j])
            dh += part
            nodes = np.array([i for i, _, _ in runs])
            self._step(f"w{k}", nodes, dw)
            self._step(f"c{k}", nodes, np.add.reduceat(z, [a for _, a, _ in runs], axis=0))
        dz = np.zeros((n, WIDTH), np.float32)
        dz[places] = dh * (1 - h * h)
        de, dg = np.zeros_like(vectors), np.empty((len(OFFSETS), WIDTH), np.float32)
        for j, o in enumerate(OFFSETS):
            there = slice(REACH + o, REACH + o + n)
            de[there] += self.p["g"][j] * dz
            dg[j] = np.einsum("ij,ij->j", vectors[there], dz)
        self._step("b", slice(None), dz.sum(axis=0))
        self._step("g", slice(None), dg)
        order = np.argsort(window, kind="stable")
        words = window[order]
        first = np.concatenate([[0], np.nonzero(np.diff(words))[0] + 1])
        self._step("e", words[first], np.add.reduceat(de[order], first, axis=0))

    def flat(self) -> np.ndarray:
        return np.concatenate([part[k].ravel() for part in (self.p, self.seen) for k in self.SHAPES])

    @classmethod
    def unflat(cls, v: np.ndarray) -> Network:
        parts, at = [], 0
        for _ in range(2):
            parts.append({})
            for k, s in cls.SHAPES.items():
                size = int(np.prod(s))
                parts[-1][k] = v[at : at + size].reshape(s).astype(np.float32)
                at += size
        return cls(*parts)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, key, ids): 16-bit word buckets of every whole text, written once so that texts are read once.

    `key` is a hash of doc_id and text, which deals the rows out alike however they are partitioned; rows
    without a doc_id have any.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(own, F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for some in slices(batch, 2):
                ids = [words.ids(t.as_py()).tobytes() for t in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"])

    return materialize(rows.mapInArrow(run, "doc_id long, key long, ids binary"), "lm-tokens")


def _ids(cells: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in cells]


def word_counts(rows: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the whole corpus (rows of `tokens`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(VOCAB)
        for batch in batches:
            for some in slices(batch, 0):
                counts += np.bincount(np.concatenate(_ids(some.column(0))), minlength=VOCAB)
        yield pa.RecordBatch.from_pydict({"key": ["n"], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "vec": [counts.tobytes()]})

    found = sum_vectors(rows.select("ids").mapInArrow(run, "key string, part int, vec binary"), rows.rdd.getNumPartitions()).collect()
    return np.frombuffer(found[0]["vec"]).copy() if found else np.zeros(VOCAB)


def share_count(words: int) -> int:
    """Shares of a corpus: its size decides, not its partitions."""
    return max(1, min(MOST_SHARES, round(words / SHARE_WORDS)))


def batch_size(words: float) -> int:
    """Positions of a gradient step on a share of so many words."""
    return int(min(MOST_BATCH, max(LEAST_BATCH, words // STEPS)))


class Trainer:
    """Trains a copy of a network on texts that come one after the other, in batches over their stream."""

    def __init__(self, network: Network, batch: int) -> None:
        self.network, self.batch, self.trained = network, batch, 0
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, text: np.ndarray) -> None:
        if len(text):
            self.waiting.append(text)
            self.held += len(text) + REACH
            if self.held >= 32 * self.batch:
                self.learn()

    def learn(self) -> None:
        """Train on the texts that wait; batches are of nearly equal size, so that none is a scrap."""
        if not self.waiting:
            return
        texts, self.waiting, self.held = stream(self.waiting), [], 0
        n = len(texts) - 2 * REACH
        cuts = np.linspace(0, n, max(1, round(n / self.batch)) + 1).astype(int)
        for a, b in zip(cuts, cuts[1:], strict=False):
            self.network.train(texts[a : b + 2 * REACH])
        self.trained += int(np.count_nonzero(texts < VOCAB))


def mean_vectors(parts: DataFrame, n_parts: int, fan_in: int = 16) -> DataFrame:
    """Means of float32 vectors (key string, part int, n double, vec binary) weighed by n, by a tree.

    Groups are added in order of their parts, so the result doesn't depend on which task comes first.
    """

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = np.zeros(len(pdf["vec"].iloc[0]) // 4)
        for n, v in zip(pdf["n"], pdf["vec"], strict=True):
            total += n * np.frombuffer(v, "<f4")
        n = float(pdf["n"].sum())
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // fan_in], "n": [n], "vec": [(total / n).astype("<f4").tobytes()]})

    left = n_parts
    while left > fan_in:
        parts = parts.groupBy("key", F.floor(F.col("part") / fan_in).alias("g")).applyInPandas(mean, "key string, part int, n double, vec binary")
        left = -(-left // fan_in)
    return parts.groupBy("key").applyInPandas(mean, "key string, part int, n double, vec binary")


def train_round(rows: DataFrame, network: Network, turn: int, words: float, rounds: int = ROUNDS) -> Network:
    """A copy of the network is trained on each share of this round's texts; the copies' mean, weighed by words, is the result.

    A share is chosen by a text's key and taken in order of the keys, so neither the shares nor the order
    in them depend on partitions. Copies leave the tasks in chunks and meet in a tree of means: what is
    gathered grows with the input, what any task or the driver holds doesn't.
    """
    shares = share_count(words)
    batch = batch_size(words / shares / rounds)
    shared = rows.sparkSession.sparkContext.broadcast(network.flat())
    own = rows.where((F.octet_length("ids") > 0) & (F.pmod(F.shiftright("key", 32), F.lit(rounds)) == turn))
    dealt = own.select(F.pmod("key", F.lit(shares)).cast("int").alias("share"), "key", "ids").repartitionById(shares, F.col("share")).sortWithinPartitions("share", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, trainer = -1, None

        def finished() -> Iterator[pa.RecordBatch]:
            if trainer is not None:
                trainer.learn()
                v = trainer.network.flat()
                pieces = [v[i : i + _CHUNK].astype("<f4").tobytes() for i in range(0, len(v), _CHUNK)]
                k = len(pieces)
                yield pa.RecordBatch.from_pydict({"key": [f"{i:04d}" for i in range(k)], "part": pa.array([share] * k, pa.int32()), "n": [float(trainer.trained)] * k, "vec": pieces})

        for some in batches:
            for s, ids in zip(some.column(0).to_pylist(), _ids(some.column(2)), strict=True):
                if s != share:
                    yield from finished()
                    share, trainer = s, Trainer(Network.unflat(shared.value), batch)
                trainer.add(ids)
        yield from finished()

    copies = dealt.mapInArrow(run, "key string, part int, n double, vec binary")
    found = sorted((r["key"], r["vec"]) for r in mean_vectors(copies, shares).collect())
    return Network.unflat(np.concatenate([np.frombuffer(v, "<f4") for _, v in found])) if found else network


def train(rows: DataFrame, rounds: int = ROUNDS) -> Network:
    """Corpus counts of all words, then rounds of data-parallel training over every word of all rows of `tokens`.

    The result depends on the rows alone: partitions, retries and the number of executors don't matter.
    """
    counts = word_counts(rows)
    network = Network.initial(counts)
    for turn in range(rounds):
        network = train_round(rows, network, turn, float(counts.sum()), rounds)
    return network


def score(rows: DataFrame, network: Network) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) per row of `tokens`, hence per input row.

    Every word of a whole text is masked in turn and predicted from both sides; the
    sum is the pseudo-log-likelihood. A null, empty or blank text has n_words 0, log_prob 0
    and a null mean. A text of one word has nothing but edges around it. Repeated rows score
    alike up to float32 rounding; a null doc_id stays null. Empty input, empty result; other columns play no part.
    """
    shared = rows.sparkSession.sparkContext.broadcast(network.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unflat(shared.value)
        for batch in batches:
            for some in slices(batch, 1, most=1 << 18):
                ids = _ids(some.column(1))
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = np.cumsum(sizes + REACH)
                sums = np.concatenate([[0.0], np.cumsum(net.log_prob(stream(ids)))])
                total = sums[ends] - sums[ends - sizes]
                mean = pa.array(total / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), pa.array(total), mean], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_words long, log_prob double, mean_log_prob double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(table(spark, sf_dir, "documents"))
    return score(rows, train(rows))
