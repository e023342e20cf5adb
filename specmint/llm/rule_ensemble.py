"""Quality classifier: a sparse ensemble of tree rules, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmint.llm.common import held_out, table

#: Most labelled rows that rules are fitted on (those whose ids have the smallest hashes).
TRAIN_ROWS = 6_000
TREES, DEPTH, CUTS = 40, 3, 24
#: Lasso penalty on rule weights, per row.
PENALTY = 0.002
THRESHOLD = 0.7


STATISTICS = ("log_words", "word_length", "symbols", "capitals", "digits", "exclaims", "stops", "distinct_words", "repeats", "short_words", "line_words", "same_lines")


def statistics(docs: DataFrame, keep: Sequence[str] = (), text: str = "text") -> DataFrame:
    """`keep` and the STATISTICS of whole texts as JVM expressions; null is the empty text, ratios of nothing are 0.

    Words and lines are columns of their own: an array that a lambda names would be made anew
    for each of its elements, which is quadratic on long texts.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keep, t.alias("_t"), F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), "").alias("_words"), F.filter(F.split(t, "\n", -1), lambda x: F.trim(x) != "").alias("_lines"))
    rows = rows.select(*keep, "_t", "_words", "_lines", F.size("_words").alias("_n"), F.char_length("_t").alias("_chars"))
    words, lines, n_words, n_chars = F.col("_words"), F.col("_lines"), F.col("_n"), F.col("_chars")
    fewer = F.greatest(n_words - 1, F.lit(0))
    equal = F.zip_with(F.slice(words, F.lit(1), fewer), F.slice(words, F.lit(2), fewer), lambda a, b: a == b)

    def over(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")

    def share(pattern: str) -> Column:
        return over(F.regexp_count("_t", F.lit(pattern)), n_chars)

    values = {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": over(F.char_length(F.array_join(words, "")), n_words),
        "symbols": share(r"[#*$%&|<>]"),
        "capitals": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "exclaims": share(r"[!?]"),
        "stops": share(r"[.,;:]"),
        "distinct_words": over(F.size(F.array_distinct(words)), n_words),
        "repeats": over(F.size(F.filter(equal, lambda e: e)), n_words),
        "short_words": over(F.size(F.filter(words, lambda w: F.char_length(w) <= 3)), n_words),
        "line_words": over(n_words, F.size(lines)),
        "same_lines": over(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return rows.select(*keep, *(values[name].alias(name) for name in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at most?, cut) conditions."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, low, cut in self.terms:
            v = x[:, names.index(name)]
            out &= v <= cut if low else v > cut
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, cut in self.terms:
            out = out & (F.col(name) <= cut if low else F.col(name) > cut)
        return out


@dataclass
class RuleModel:
    names: list[str]
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as an expression over statistics columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * rule.holds(x, self.names)
        return 1 / (1 + np.exp(-total))


def _grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: tuple, names: Sequence[str], depth: int, leaves: list, rules: list) -> None:
    """Least-squares splits down to `depth`; every inner and leaf path is a rule."""
    if path:
        rules.append(Rule(path))
    best = None
    if depth and len(rows) >= 20:
        r = residual[rows]
        for j in range(x.shape[1]):
            low = x[rows, j][:, None] <= cuts[j][None, :]
            n_low = low.sum(axis=0)
            s_low = r @ low
            n_high, s_high = len(rows) - n_low, r.sum() - s_low
            good = (n_low >= 10) & (n_high >= 10)
            if good.any():
                gain = np.where(good, s_low**2 / np.maximum(n_low, 1) + s_high**2 / np.maximum(n_high, 1), -1.0)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0] + 1e-12:
                    best = gain[k], j, float(cuts[j][k])
    if best is None or best[0] <= residual[rows].sum() ** 2 / max(len(rows), 1) + 1e-9:
        leaves.append((rows, residual[rows].mean() if len(rows) else 0.0))
        return
    _, j, cut = best
    low = x[rows, j] <= cut
    for side, at_most in ((rows[low], True), (rows[~low], False)):
        _grow(x, residual, cuts, side, (*path, (names[j], at_most, cut)), names, depth - 1, leaves, rules)


def fit(x: np.ndarray, y: np.ndarray, names: Sequence[str], seed: int = 7) -> RuleModel:
    """Boost small trees on random halves, take their paths as rules, weigh the rules by lasso logistic regression."""
    names = list(names)
    if not len(y):
        return RuleModel(names)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if y.min() == y.max():
        return RuleModel(names, base)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, CUTS))) for j in range(x.shape[1])]
    f, rules = np.full(len(y), base), []
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(40, len(y) // 2) if len(y) > 40 else len(y), replace=False))
        leaves: list = []
        tree: list[Rule] = []
        _grow(x, residual, cuts, rows, (), names, DEPTH, leaves, tree)
        if not tree:
            break
        rules += tree
        for rule in tree:
            if len(rule.terms) == DEPTH or not any(other.terms[: len(rule.terms)] == rule.terms for other in tree if len(other.terms) > len(rule.terms)):
                on = rule.holds(x, names)
                if on.any():
                    f[on] += 0.5 * residual[on].mean() / max(0.05, float((y[on].mean() * (1 - y[on].mean()))))
        f = np.clip(f, -6, 6)
    rules = list(dict.fromkeys(rules))
    z = np.array([r.holds(x, names) for r in rules], float).T
    keep = (z.mean(axis=0) > 0.002) & (z.mean(axis=0) < 0.998)
    _, first = np.unique(z[:, keep], axis=1, return_index=True) if keep.any() else (None, np.zeros(0, int))
    chosen = np.nonzero(keep)[0][np.sort(first)]
    z, rules = z[:, chosen], [rules[i] for i in chosen]
    intercept, weights = _lasso(z, y, base)
    return RuleModel(names, intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def _lasso(z: np.ndarray, y: np.ndarray, base: float, steps: int = 3000) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean logistic loss + PENALTY * |weights|."""
    n, m = z.shape
    if not m:
        return base, np.zeros(0)
    # Rows that fire the same rules count as one row with a weight: there are few such patterns.
    _, first, which = np.unique(np.packbits(z.astype(bool), axis=1), axis=0, return_index=True, return_inverse=True)
    count, ones = np.bincount(which.ravel()), np.bincount(which.ravel(), weights=y)
    a = np.hstack([np.ones((len(first), 1)), z[first]])
    step = 4 * n / np.linalg.norm(a * np.sqrt(count)[:, None], 2) ** 2
    w = np.zeros(m + 1)
    w[0] = base
    v, t = w.copy(), 1.0
    for _ in range(steps):
        grad = a.T @ (count / (1 + np.exp(-(a @ v))) - ones) / n
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / nt * (new - w)
        done = np.abs(new - w).max() < 1e-7
        w, t = new, nt
        if done:
            break
    return float(w[0]), w[1:]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> RuleModel:
    """A model from at most `rows` labelled rows that labels may be learned from.

    The sample is a fixed one: the ids with the smallest hashes. Only its statistics
    reach the driver. An id with differing labels counts as its smaller label; ids without a
    document add nothing. Without any label every score is 0.5; with one class, its base rate.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(target).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("l_id")))
    sample = usable.groupBy("l_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    names = list(STATISTICS)
    texts = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.col("text").cast("string").alias("text"))
    got = statistics(texts.join(F.broadcast(sample), "l_id"), ("l_id", "y")).toPandas()
    got = got.sort_values(["l_id", *names]).reset_index(drop=True)
    return fit(got[names].to_numpy(float), got["y"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) per input row, in one JVM pass.

    Null and empty texts are scored by their zero statistics; a null doc_id counts as held
    out; repeated rows agree; very long texts are read whole. Empty input, empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    stats = statistics(source, ("doc_id", "held_out"))
    out = stats.select("doc_id", "held_out", model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
