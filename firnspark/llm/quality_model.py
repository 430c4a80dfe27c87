"""Quality classifier: a sparse rule ensemble that runs as Spark column expressions.

Shallow boosted trees over text statistics give conjunctive rules (the path to each node), a lasso
logistic regression picks and weighs the rules, and the rest is compiled to columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r"

#: Statistics the rules are over, all of the text alone.
FEATURES = ("log_words", "mean_word", "distinct", "upper", "pipes", "bangs", "marks", "digits", "stops", "commas", "words_per_line", "dup_lines")


def _without(text: Column, chars: str, by: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the struct column `features`, FEATURES of the whole text; null texts are empty ones."""
    # The caller's columns travel in one struct, so that no name of theirs can meet one of the steps'.
    docs = docs.select(F.struct("*").alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    out = docs.withColumn("_w", F.array_remove(F.split(_without(text, BLANKS, " "), " "), ""))
    out = out.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    count = lambda chars: F.length(text) - F.length(_without(text, chars))
    out = out.withColumns({
        "_n": F.size("_w"), "_d": F.size(F.array_distinct("_w")), "_c": F.length(_without(text, BLANKS + " ")),
        "_ln": F.size("_l"), "_ld": F.size(F.array_distinct("_l")),
        "_upper": F.regexp_count(text, F.lit("[A-Z]")), "_digits": F.regexp_count(text, F.lit("[0-9]")),
        "_pipes": count("|"), "_bangs": count("!"), "_marks": count("#*$%&<>{}"), "_stops": count("."), "_commas": count(","),
    }).drop("_w", "_l")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    values = {
        "log_words": F.log1p(F.col("_n").cast("double")), "mean_word": share("_c", "_n"), "distinct": share("_d", "_n"), "upper": share("_upper", "_c"),
        "pipes": share("_pipes", "_n"), "bangs": share("_bangs", "_n"), "marks": share("_marks", "_n"), "digits": share("_digits", "_c"),
        "stops": share("_stops", "_n"), "commas": share("_commas", "_n"), "words_per_line": share("_n", "_ln"), "dup_lines": F.when(F.col("_ln") > 0, 1.0 - share("_ld", "_ln")).otherwise(0.0),
    }
    found = F.struct(*[values[k].alias(k) for k in FEATURES]).alias("features")
    return out.select("own.*", found)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds, each (feature, low, high): low < value <= high."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, low, high in self.bounds:
            v = x[:, FEATURES.index(name)]
            out &= (v > low) & (v <= high)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            v = F.col(f"features.{name}")
            if low > -math.inf:
                out = out & (v > F.lit(low))
            if high < math.inf:
                out = out & (v <= F.lit(high))
        return out


@dataclass
class Ensemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score: logistic of the bias and the weights of the rules that hold."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, bounds: dict, found: list, least: int) -> None:
    """Split rows by the largest gain; every node below the root is a rule with its leaf value."""
    if bounds:
        found.append((dict(bounds), rows, -grad[rows].sum() / (hess[rows].sum() + 1.0)))
    if depth == 0 or len(rows) < 2 * least:
        return
    g_all, h_all, best = grad[rows].sum(), hess[rows].sum(), (1e-9, -1, -1)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        b = bins[rows, f]
        n, g, h = (np.cumsum(np.bincount(b, weights=w, minlength=len(cut) + 1))[:-1] for w in (None, grad[rows], hess[rows]))
        gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
        gain[(n < least) | (len(rows) - n < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    _, f, k = best
    if f < 0:
        return
    low = bins[rows, f] <= k
    name, at = FEATURES[f], float(cuts[f][k])
    a, b = bounds.get(name, (-math.inf, math.inf))
    _grow(bins, cuts, grad, hess, rows[low], depth - 1, bounds | {name: (a, min(b, at))}, found, least)
    _grow(bins, cuts, grad, hess, rows[~low], depth - 1, bounds | {name: (max(a, at), b)}, found, least)


def mined_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 7) -> list[Rule]:
    """Paths of boosted trees, each grown on half of the rows and with a depth of 2 up to `depth`."""
    rng, least = np.random.default_rng(seed), max(5, len(x) // 500)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 41)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, out = np.zeros(len(x)), {}
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        nodes: list = []
        rows = np.sort(rng.permutation(len(x))[: max(2, len(x) // 2)])
        _grow(bins, cuts, p - y, np.maximum(p * (1 - p), 1e-6), rows, 2 + k % max(1, depth - 1), {}, nodes, least)
        for bounds, _, value in nodes:
            rule = Rule(tuple((n, *bounds[n]) for n in sorted(bounds)))
            out[rule] = None
            if not any(set(bounds) <= set(b) and b != bounds and all(b[n][0] >= bounds[n][0] and b[n][1] <= bounds[n][1] for n in bounds) for b, _, _ in nodes):
                margin += 0.3 * value * rule.holds(x)  # a leaf
    return list(out)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; columns are scaled, the bias is not penalised."""
    mean, std = z.mean(0), np.maximum(z.std(0), 1e-9)
    s = (z - mean) / std
    # The step is one over a bound of the curvature: a quarter of the largest eigenvalue of s's/n.
    gram = s.T @ s / len(s)
    v = np.ones(s.shape[1])
    for _ in range(30):
        v = gram @ v
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * max(1.0, float(v @ gram @ v)) * 1.05)
    rate_of = min(max(y.mean(), 1e-3), 1 - 1e-3)
    b = b_old = math.log(rate_of / (1 - rate_of))
    w = w_old = np.zeros(s.shape[1])
    t = 1.0
    for _ in range(steps):
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, c = w + (t - 1) / t_next * (w - w_old), b + (t - 1) / t_next * (b - b_old)
        err = 1 / (1 + np.exp(-(s @ u + c))) - y
        w_old, b_old, t = w, b, t_next
        u = u - rate * (s.T @ err / len(s))
        w, b = np.sign(u) * np.maximum(np.abs(u) - rate * penalty, 0), c - rate * float(err.mean())
    own = w / std
    return float(b - own @ mean), own


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3) -> Ensemble:
    """The ensemble for features x and labels y; without both labels, a constant score."""
    if not len(y):
        return Ensemble()
    if y.min() == y.max():
        return Ensemble(bias=4.0 if y[0] else -4.0)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order].astype(float)
    rules, seen, kept = mined_rules(x, y), set(), []
    for rule in rules:
        column = rule.holds(x)
        if 0 < column.sum() < len(x) and (key := column.tobytes()) not in seen:
            seen.add(key)
            kept.append((rule, column))
    if not kept:
        return Ensemble(bias=float(np.log(y.mean() / (1 - y.mean()))))
    bias, weights = lasso_logistic(np.stack([c for _, c in kept], axis=1).astype(float), y, penalty)
    return Ensemble(bias, [(r, float(w)) for (r, _), w in zip(kept, weights, strict=True) if abs(w) > 1e-6])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> Ensemble:
    """Fit on at most `most_rows` labelled documents that aren't held out, those of the least id hashes.

    Labels that contradict each other for a document count as 1 if any is 1; null labels and ids
    are left out. Of rows with the same id the one with the least text counts, so the sample is the same in every
    run. The chosen labels (16 bytes each) are the side that is broadcast.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("_label").alias("_label"), F.min("text").alias("text"))
    got = with_features(rows).select("_label", *[f"features.{k}" for k in FEATURES]).toPandas()
    return fit(got[list(FEATURES)].to_numpy(float).reshape(len(got), len(FEATURES)), (got["_label"].to_numpy() >= 1).astype(int))


def scored(docs: DataFrame, model: Ensemble, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    The score reads the text alone. Null and empty texts get the score of an empty text. Repeated
    rows and other columns stay; own columns are named features, score and predicted, and input
    columns of these names are replaced.
    """
    out = with_features(docs.drop("features", "score", "predicted")).withColumn("score", model.column())
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("features")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model trained on the labels."""
    model = train(docs, labels, most_rows)
    return scored(docs.select("doc_id", "text"), model, threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
