"""Benchmark decontamination by template windows with typed placeholders."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmint.llm.common import bound_batches, slices, table
from specmint.storage import materialize

WINDOW = 5
LITERALS = 3
COVERAGE = 0.8
#: Diagonals this near belong to one place of an item: so many words may be put in or left out.
SLACK = 3
#: Bits of the filter that keeps other windows from being shuffled: so many a benchmark window, within these bounds.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 256, 1 << 22, 1 << 27

#: Letters of scripts without blanks between words (Thai to Khmer, kana, Han): each is a word of its own.
_ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
TOKEN = re.compile(rf"[^\W\d_{_ALONE}]+|\d+(?:[.,]\d+)*|[.!?:\n|$€£%。！？]|[{_ALONE}]")
ENDERS = frozenset(".!?:\n|。！？")
#: Words that are units after a number.
UNITS = frozenset(
    "mm cm m km inch inches ft feet yd yards mile miles mg g kg t lb lbs oz ml l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz "
    "w kw mw v kv a ma j kj cal kcal k c f degrees percent dollar dollars euro euros pound pounds cent cents $ € £ %".split()
)
LITERAL, NUMBER, NAME, UNIT, END = range(5)
_PLACE = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Canon:
    """Token classes and hashes of surface forms; the cache is emptied at `limit` forms."""

    def __init__(self, limit: int = 500_000) -> None:
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.kinds = np.zeros(1 << 12, np.uint8)

    def _add(self, surface: str) -> int:
        k = len(self.ids)
        if k == len(self.hashes):
            self.hashes, self.kinds = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.kinds))
        low = surface.lower()
        if surface in ENDERS:
            kind = END
        elif surface[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif surface[0].isupper() and surface[1:].islower():
            kind = NAME
        else:
            kind = LITERAL
        self.kinds[k], self.hashes[k] = kind, xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
        self.ids[surface] = k
        return k

    def templates(self, texts: list[str | None]) -> Templates:
        """The words of whole texts, one text after the other.

        Numbers are <num>; a unit word right after a number is <unit>; a title-cased word is
        <name> unless it begins a sentence, a line or the text. Other words are lower-cased.
        """
        if len(self.ids) > self.limit:
            self._reset()
        ids, found, sizes = self.ids, [], []
        for text in texts:
            tokens = TOKEN.findall(text) if text else []
            got = list(map(ids.get, tokens))
            if None in got:
                got = [self._add(t) if k is None and t not in ids else ids[t] for t, k in zip(tokens, got, strict=True)]
            found += got
            sizes.append(len(got))
        at = np.array(found, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        kinds, values = self.kinds[at], self.hashes[at]
        before = np.concatenate([[END], kinds[:-1]])[: len(kinds)]
        before[np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]] = END
        kinds = np.where((kinds == NAME) & (before == END), LITERAL, kinds)
        kinds = np.where((kinds == UNIT) & (before != NUMBER), LITERAL, kinds)
        words = kinds != END
        return Templates(kinds[words], values[words], owner[words], len(texts))


class Templates:
    """Kinds and value hashes of the words of some texts; `start` has each text's first word."""

    def __init__(self, kinds: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> None:
        self.kinds, self.values, self.owner = kinds, values, owner
        self.start = np.searchsorted(owner, np.arange(n + 1))
        self.canon = canonical(kinds, values)

    def _within(self, length: int) -> np.ndarray:
        """Words at which a window of `length` words of one text begins."""
        n = max(0, len(self.owner) - length + 1)
        return np.nonzero(self.owner[:n] == self.owner[length - 1 : length - 1 + n])[0]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows with at least LITERALS words that are no placeholders."""
        at = self._within(WINDOW)
        literal = np.concatenate([[0], np.cumsum(self.kinds == LITERAL)])
        at = at[literal[at + WINDOW] - literal[at] >= LITERALS]
        return at, window_hashes(self.canon, at, WINDOW, 0)

    def value_windows(self, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all windows of `length` words as they stand, placeholders or not."""
        at = self._within(length)
        return at, window_hashes(self.values, at, length, length)


def canonical(kinds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of words as the template has them: a placeholder by kind, else the word."""
    return np.where(kinds == LITERAL, values, _PLACE[kinds % 4])


def window_hashes(words: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    n = max(0, len(words) - length + 1)
    h = np.full(n, seed, np.uint64)
    for j in range(length):
        h = (h ^ words[j : j + n]) * _STEP
        h ^= h >> np.uint64(29)
    return h[at]


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, size, kinds, values) of every distinct text with a word, and (item, hash, pos) of all their windows.

    `item` names a text by its MD5. Windows are counted as templates and as they stand; an item
    under WINDOW words is one window as it stands.
    """
    texts = benchmark.where("text is not null").select(F.col("text").cast("string").alias("text")).distinct().select(F.md5("text").alias("item"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for some in (x for batch in batches for x in slices(batch)):
            t = canon.templates(some.column(1).to_pylist())
            sizes = np.diff(t.start)
            spans = [slice(a, b) for a, b in zip(t.start, t.start[1:], strict=False)]
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in spans]
            for length in range(1, WINDOW + 1):
                for at, h in ([t.windows()] if length == WINDOW else []) + [t.value_windows(length)]:
                    own = t.owner[at]
                    fit = (sizes[own] >= WINDOW) if length == WINDOW else (sizes[own] == length)
                    cuts = np.searchsorted(own[fit], np.arange(len(spans) + 1))
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if a < b:
                            found[k].append((at[fit][a:b] - t.start[k], h[fit][a:b].view(np.int64)))
            pos = [np.concatenate([p for p, _ in f]) if f else np.zeros(0, np.int64) for f in found]
            hashes = [np.concatenate([h for _, h in f]) if f else np.zeros(0, np.int64) for f in found]
            lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int32()), pa.array([t.kinds[s].tobytes() for s in spans]), pa.array([t.values[s].tobytes() for s in spans]), lists(pos), lists(hashes)], ["item", "size", "kinds", "values", "pos", "hash"])

    items = materialize(texts.mapInArrow(run, "item string, size int, kinds binary, values binary, pos array<long>, hash array<long>").where("size > 0"), "bench-items")
    windows = items.select("item", F.inline(F.arrays_zip("hash", "pos")))
    return items.drop("pos", "hash"), windows


def _filter(windows: DataFrame) -> np.ndarray:
    """A bit map with two bits for every benchmark window; its size is bounded, whatever the benchmark's."""
    n = windows.count()
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_SHARE * n).bit_length()))
    places = F.array(F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1, F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1)) + 1)
    marked = windows.select(F.explode(places).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in marked.collect():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["map"], np.uint8)[: len(out) - at]
    return out


def _passes(marked: np.ndarray, h: np.ndarray) -> np.ndarray:
    last = np.uint64(8 * len(marked) - 1)
    is_set = lambda i: marked[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8) & 1
    near = np.nonzero(is_set(h & last))[0]
    return near[is_set(h[near] >> np.uint64(32) & last) == 1]


def text_key(text: str | Column) -> list[Column]:
    """Two hashes that name a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit("text"), text)]


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(k1, k2, hash, pos, kinds, v0..): the windows of every distinct text that may be in the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(windows))
    k1, k2 = text_key("text")
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text")).where("text is not null")
    values = [f"v{j}" for j in range(WINDOW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, marked = Canon(), shared.value
        for some in (x for batch in batches for x in slices(batch, 2)):
            t = canon.templates(some.column(2).to_pylist())
            sought = [t.windows(), *(t.value_windows(length) for length in lengths)]
            at, h = (np.concatenate(x) for x in zip(*sought, strict=True))
            near = _passes(marked, h)
            if not len(near):
                continue
            at, h = at[near], h[near]
            own = t.owner[at]
            kinds, words = (np.concatenate([x, np.zeros(WINDOW, x.dtype)]) for x in (t.kinds, t.values))
            packed = sum(kinds[at + j].astype(np.int32) << 3 * j for j in range(WINDOW))
            cols = [some.column(0).take(pa.array(own)), some.column(1).take(pa.array(own)), pa.array(h.view(np.int64)), pa.array((at - t.start[own]).astype(np.int64)), pa.array(packed, pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(words[at + j].view(np.int64)) for j in range(WINDOW))], ["k1", "k2", "hash", "pos", "kinds", *values])

    found = rows.mapInArrow(run, "k1 long, k2 long, hash long, pos long, kinds int, " + ", ".join(f"{v} long" for v in values))
    # Copies of a text, and windows that match both ways, are one row from here on.
    return found.groupBy("k1", "k2", "hash", "pos").agg(F.first("kinds").alias("kinds"), *(F.first(v).alias(v) for v in values))


def judge(own_kinds: np.ndarray, own_values: np.ndarray, votes: list[tuple[int, int, np.ndarray, np.ndarray]]) -> tuple[float, int]:
    """(share of the item's words covered, slots that differ) at the best place in a text.

    `votes` are (diagonal, position in the item, kinds, values of the text's window). Votes on
    neighbouring diagonals are one place.
    """
    best: tuple[float, int] = (0.0, 0)
    group: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for vote in sorted(votes, key=lambda v: v[:2]):
        if group and vote[0] - group[-1][0] > SLACK:
            best = max(best, _judge(own_kinds, own_values, group), key=lambda x: x[0])
            group = []
        group.append(vote)
    return max(best, _judge(own_kinds, own_values, group), key=lambda x: x[0]) if group else best


def _judge(own_kinds: np.ndarray, own_values: np.ndarray, group: list[tuple[int, int, np.ndarray, np.ndarray]]) -> tuple[float, int]:
    """Coverage of an item by the windows of neighbouring diagonals whose slots agree.

    Slots agree when each value of the item stands for one value of the text and the
    other way round. The diagonal with most votes sets the pairs: each position in its windows is a
    vote, and a pair holds that has more votes than any other pair of either of its values. Windows
    with another pair are refused, here and on the neighbours, which may add pairs that don't clash.
    A window that stands in the text word for word is covered whatever its slots.
    """
    own_canon = canonical(own_kinds, own_values)
    covered = np.zeros(len(own_kinds), bool)
    diagonals = Counter(v[0] for v in group)
    main = min(diagonals, key=lambda v: (-diagonals[v], v))
    placed: list[tuple[int, slice, bool, list[tuple[int, int, int]]]] = []
    slots: dict[int, tuple[int, int, int]] = {}
    for diagonal, p, kinds, values in sorted(group, key=lambda v: (v[0] != main, *v[:2])):
        span = slice(p, min(p + WINDOW, len(own_kinds)))
        kinds, values = kinds[: span.stop - p], values[: span.stop - p]
        same = np.array_equal(own_values[span], values)
        if not same and not np.array_equal(own_canon[span], canonical(kinds, values)):
            continue
        at = {i: (int(own_kinds[i]), int(own_values[i]), int(values[i - p])) for i in range(span.start, span.stop) if own_kinds[i] != LITERAL}
        placed.append((diagonal, span, same, list(at.values())))
        if diagonal == main:
            slots |= at
    forth: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    counts = Counter(slots.values())
    best: dict[tuple[bool, int, int], list[int]] = defaultdict(list)
    for (kind, a, b), n in counts.items():
        best[True, kind, a].append(n)
        best[False, kind, b].append(n)
    for (kind, a, b), n in counts.items():
        if all(max(x) == n and x.count(n) == 1 for x in (best[True, kind, a], best[False, kind, b])):
            forth[kind, a], back[kind, b] = b, a
    differ = set()
    for diagonal, span, same, pairs in placed:
        if diagonal == main:
            agree = all(forth.get((kind, a)) == b for kind, a, b in pairs)
        else:
            agree = all(forth.get((kind, a), b) == b and back.get((kind, b), a) == a for kind, a, b in pairs)
        if not agree and not same:
            continue
        covered[span] = True
        if not agree:
            continue
        for kind, a, b in pairs:
            forth[kind, a], back[kind, b] = b, a
            if a != b:
                differ.add((kind, a))
    return float(covered.mean()), len(differ)


def leaking_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k1, k2, item, coverage, n_slots_changed): every benchmark text that a text of the corpus holds.

    Windows of both sides meet in a hash-join. An item can only be covered if its matched windows could
    cover COVERAGE of its words with no overlap; the pairs of texts and items for which this holds are
    gathered, a row each, and judged (see `judge`). What is counted and gathered is per pair, so
    neither a task nor the driver holds the benchmark; the driver gets a bit map of bounded size.
    """
    items, windows = _items(benchmark)
    lengths = sorted(r[0] for r in items.select(F.least("size", F.lit(WINDOW))).distinct().collect())
    hits = _hits(docs, windows, lengths)
    met = hits.join(windows.withColumnRenamed("pos", "at"), "hash").join(items.select("item", "size"), "item")
    vote = F.struct((F.col("pos") - F.col("at")).alias("diagonal"), "at", "kinds", *(f"v{j}" for j in range(WINDOW)))
    pairs = met.groupBy("k1", "k2", "item", "size").agg(F.collect_list(vote).alias("votes"))
    enough = F.lit(WINDOW) * F.size(F.array_distinct(F.transform("votes", lambda v: v["at"]))) >= COVERAGE * F.col("size")
    pairs = pairs.where(enough).drop("size").join(items.select("item", F.col("kinds").alias("own_kinds"), F.col("values").alias("own_values")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, slots = [], []
            for r in batch.select(["votes", "own_kinds", "own_values"]).to_pylist():
                votes = [(v["diagonal"], v["at"], np.array([v["kinds"] >> 3 * j & 7 for j in range(WINDOW)], np.uint8), np.array([v[f"v{j}"] for j in range(WINDOW)], np.int64).view(np.uint64)) for v in r["votes"]]
                share, differ = judge(np.frombuffer(r["own_kinds"], np.uint8), np.frombuffer(r["own_values"], np.uint64), votes)
                shares.append(share)
                slots.append(differ)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "item")), pa.array(shares, pa.float64()), pa.array(slots, pa.int64())], ["k1", "k2", "item", "coverage", "n_slots_changed"])

    judged = pairs.select("k1", "k2", "item", "votes", "own_kinds", "own_values").mapInArrow(run, "k1 long, k2 long, item string, coverage double, n_slots_changed long")
    return materialize(judged.where(F.col("coverage") >= COVERAGE), "leaks")


def _named(leaks: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks under every item_id of the item's text."""
    ids = benchmark.where("item_id is not null and text is not null").select(F.md5(F.col("text").cast("string")).alias("item"), F.col("item_id").cast("long").alias("item_id")).distinct()
    return leaks.join(ids, "item")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, n_slots_changed): every item that a text holds, for every row with that text.

    An item counts as found when windows on neighbouring diagonals, with consistent slots, cover
    COVERAGE of its words. Windows match as templates if they have LITERALS literal words, and as
    they stand in any case; an item under WINDOW words is one window that matches only as it stands.
    In scripts without blanks every letter is a word. Items without words, with null text or null id
    match nothing; items of equal text are all found. Rows with null text hold nothing.
    """
    leaks = _named(leaking_texts(docs, benchmark), benchmark)
    k1, k2 = text_key("text")
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    return own.join(leaks, ["k1", "k2"]).select("doc_id", "item_id", "coverage", "n_slots_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, coverage) per input row; see `find_leaks`.

    Rows without a leak have an empty item list and coverage 0. Repeated rows get equal
    results; a null doc_id stays null. An empty benchmark finds nothing; empty input,
    empty result; other columns are ignored.
    """
    leaks = _named(leaking_texts(docs, benchmark), benchmark)
    leaks = leaks.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
    k1, k2 = text_key("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    out = own.join(leaks, ["k1", "k2"], "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that hold a benchmark item go, all others stay."""
    bound_batches(spark)
    leaks = leaking_texts(docs, table(spark, sf_dir, "benchmark")).select("k1", "k2").distinct()
    k1, k2 = text_key(docs["text"])
    return docs.join(leaks, (k1 == leaks["k1"]) & (k2 == leaks["k2"]), "left_anti")
