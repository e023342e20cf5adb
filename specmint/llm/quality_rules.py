"""Quality rules and an n-gram likelihood ratio between trusted text and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmint.llm.common import bound_batches, map_batches, sum_vectors, table

#: Hash buckets of the multinomials, and bytes in an n-gram.
BITS = 16
GRAM = 4
#: Buckets of the recency n-grams: four words' codes of three bits, each bit a word equal to its 1st, 2nd or 3rd predecessor.
RECENCY = 1 << 12
#: A document is kept when its mean log-likelihood ratio per n-gram is at least this.
MIN_RATIO = -0.6
#: All pseudo-counts together, as a share of a multinomial's real counts.
SMOOTH = 0.005
REPEAT_WINDOW = 8
#: Bits that tell which ids may be trusted (4 MB): more ids in a bit cost moved texts, never a count. `bitmap_construct_agg` makes 2^_SLOT of them.
TRUST_BITS, _SLOT = 25, 15
_SYMBOLS = b"#*$%&|<>"


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words inside `width`-word windows that occur twice or more in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = (h ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = np.nonzero(h[order[1:]] == h[order[:-1]])[0]
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    equal = np.ones(len(a), bool)
    for j in range(width):
        equal &= ids[a + j] == ids[b + j]
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.concatenate([a[equal], b[equal]]))
    edges[starts] += 1
    edges[starts + width] -= 1
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def rule_counts(text: str, data: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    blanks = sum(data.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - blanks, sum(data.count(bytes([s])) for s in _SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids)


def byte_grams(data: bytes) -> np.ndarray:
    """Hash bucket of every n-gram of the text's bytes."""
    x = np.frombuffer(data, np.uint8)
    n = len(x) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    h = x[:n].astype(np.uint32)
    for j in range(1, GRAM):
        h = h * np.uint32(257) + x[j : j + n]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def recency_grams(ids: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of recency codes, which show words that keep coming back whatever they are."""
    code = np.zeros(len(ids), np.uint32)
    for j in range(1, 4):
        code[j:] |= (ids[j:] == ids[:-j]).astype(np.uint32) << (j - 1)
    n = len(ids) - 3
    if n < 1:
        return np.zeros(0, np.uint32)
    return code[:n] << 9 | code[1 : n + 1] << 6 | code[2 : n + 2] << 3 | code[3 : n + 3]


def parse(text: str | None) -> tuple[str, bytes, list[bytes], np.ndarray]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    return text, data, words, word_ids(words)


def trust_bits(good: DataFrame) -> DataFrame:
    """(slot, bits): a set of 2^TRUST_BITS bits with that of each doc_id's hash; of a fixed size, whatever the number of ids."""
    places = good.select(F.shiftright(_trust_place(F.col("doc_id")), _SLOT).alias("slot"), _trust_place(F.col("doc_id")).bitwiseAND((1 << _SLOT) - 1).alias("at"))
    return places.groupBy("slot").agg(F.bitmap_construct_agg("at").alias("bits"))


def _trust_place(doc_id: Column) -> Column:
    return F.xxhash64(doc_id).bitwiseAND((1 << TRUST_BITS) - 1)


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(trusted, text) per row; trusted are all rows whose doc_id is labelled of good quality.

    Only texts whose id's bit is set in `trust_bits` can be trusted: these alone meet the labels in a shuffle, which
    says of each whether it is. All other texts stay where they are. The join is never a broadcast of ids, which
    grow with the corpus, and does not sort texts.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = _trust_place(F.col("doc_id"))
    byte = F.substring("bits", F.shiftright(place.bitwiseAND((1 << _SLOT) - 1), 3).cast("int") + 1, 1)
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), place.bitwiseAND(7).cast("int"))
    slot = F.when(F.col("doc_id").isNotNull(), F.shiftright(place, _SLOT)).alias("slot")
    rows = rows.select("doc_id", "text", slot).join(F.broadcast(trust_bits(good)), "slot", "left").select("doc_id", "text", F.coalesce(bit == 1, F.lit(False)).alias("maybe"))
    judged = rows.where("maybe").drop("maybe").join(good.hint("shuffle_hash"), "doc_id", "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    return rows.where(~F.col("maybe")).select(F.lit(False).alias("trusted"), "text").unionByName(judged)


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """log(trusted / raw) of every bucket; None when no trusted row has an n-gram.

    The raw multinomial counts every row, the trusted one every row labelled good. Counts leave a task as one vector and
    meet in a tree of sums, so what the driver gets has a fixed size.
    """
    rows = with_trust(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        raw, good = np.zeros((1 << BITS) + RECENCY), np.zeros((1 << BITS) + RECENCY)
        for batch in batches:
            trusted = batch.column(0).to_numpy(zero_copy_only=False)
            waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
            size = 0
            for k, text in enumerate(batch.column(1)):
                _, data, _, words = parse(text.as_py())
                grams = [byte_grams(data), recency_grams(words) + np.uint32(1 << BITS)]
                waiting[bool(trusted[k])] += grams
                size += len(grams[0])
                if size > 1 << 20 or k == batch.num_rows - 1:
                    for flag, parts in waiting.items():
                        counts = np.bincount(np.concatenate(parts), minlength=len(raw)) if parts else 0
                        raw += counts
                        if flag:
                            good += counts
                    waiting, size = {True: [], False: []}, 0
        part = TaskContext.get().partitionId()
        found = {k: v.tobytes() for k, v in (("raw", raw), ("good", good)) if v.any()}
        yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.string()), "part": pa.array([part] * len(found), pa.int32()), "vec": pa.array(found.values(), pa.binary())})

    parts = rows.mapInArrow(run, "key string, part int, vec binary")
    most = docs.rdd.getNumPartitions() + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = {r["key"]: np.frombuffer(r["vec"]) for r in sum_vectors(parts, most).collect()}
    if "good" not in sums:
        return None
    out = []
    for own in (slice(0, 1 << BITS), slice(1 << BITS, None)):
        raw, good = (sums[k][own] for k in ("raw", "good"))
        if not good.sum():
            out.append(np.zeros(len(raw)))
            continue
        out.append(np.log(good / good.sum() + SMOOTH / len(good)) - np.log(raw / raw.sum() + SMOOTH / len(raw)))
    return np.concatenate(out).astype(np.float32)


def verdict(text: str | None, ratios: np.ndarray, min_ratio: float) -> tuple:
    """(the five rule counts, base_failed, ratio, kept) of a whole text."""
    text, data, words, ids = parse(text)
    counts = rule_counts(text, data, words, ids)
    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
    grams, recent = byte_grams(data), recency_grams(ids)
    ratio = float(ratios[grams].mean(dtype=np.float64)) if len(grams) else 0.0
    ratio += float(ratios[recent + np.uint32(1 << BITS)].mean(dtype=np.float64)) if len(recent) else 0.0
    return (*counts, failed, ratio, not failed and ratio >= min_ratio)


def shared_ratios(docs: DataFrame, labels: DataFrame) -> Broadcast:
    """The log ratios as a broadcast variable of fixed size; zeros where nothing is trusted."""
    ratios = log_ratios(docs, labels)
    return docs.sparkSession.sparkContext.broadcast(np.zeros((1 << BITS) + RECENCY, np.float32) if ratios is None else ratios)


def judge_quality(docs: DataFrame, labels: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, text_hash, the rules' counts, base_failed, ratio, kept) per input row.

    `ratio` is the mean over a text's n-grams of log(p_trusted / p_raw), both multinomials
    over hashed byte n-grams, plus the same mean over n-grams of word recency. A row is kept
    when the base rules pass and the ratio reaches `min_ratio`, a fixed number: the same text
    always gets the same verdict from the same corpus. Null, empty and blank texts have zero
    counts and fail the base rules; without trusted rows every ratio is 0 and the base rules
    alone decide. Repeated rows are judged alike; a null doc_id is judged like any other. An
    empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    shared = shared_ratios(docs, labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        rows = [verdict(text.as_py(), shared.value, min_ratio) for text in batch.column(2)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
        cols = [pa.array(list(c), pa.bool_() if n in ("base_failed", "kept") else pa.float64() if n == "ratio" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text_hash", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"
    return map_batches(source, run, schema)


def keep_quality(docs: DataFrame, labels: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows that `judge_quality` keeps, with all their columns, without moving any text."""
    shared = shared_ratios(docs, labels)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([verdict(text.as_py(), shared.value, min_ratio)[-1] for text in batch.column(at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the rules reject go."""
    bound_batches(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))
