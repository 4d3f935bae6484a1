"""Quality classifier: a sparse ensemble of rules over text statistics.

Two targets are learned from labelled documents: low quality and toxicity. For
each, boosted trees are grown over statistics of the texts, every path from a
root becomes a conjunctive rule, and lasso logistic regression weighs the rules;
most weights are zero. The rules left compile to Spark columns, so scoring is
one projection without Python.

Training sees at most ``sample_rows`` labelled documents (the least hashes of
doc_id); scoring sees all. The words counted as abuse are learned too: word
beginnings that many toxic documents of the sample hold and next to no other.

Semantics
  * keep is true if the scores of low quality and of toxicity are both below
    ``threshold``. A null or blank text has null scores and keep false.
  * Labels: of repeated rows the worse label counts; null labels are left out.
    Without labels, or with one class only, a target's score is the smoothed
    share of that class, so that nothing but blank texts is rejected.
  * One row per row of the input, repeated ones included; a null doc_id is kept
    as it is. Extra columns don't matter; where the input has a column of a
    result's name, the result is named with a leading underscore (more if taken).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, let
from .tokens import WORD, release

SAMPLE_ROWS, TREES, DEPTH, BINS, THRESHOLD = 10_000, 40, 3, 48, 0.5
MARKS = r"[#%$&*|!^~<>{}=@_\[\]]"


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def statistics(text: Column, words: Column, abuse: list[list[str]]) -> dict[str, Column]:
    """The statistics that rules speak of, by name."""
    n = F.size(words).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    lower = F.lower(text)
    sure, likely = (F.regexp_count(lower, F.lit(abuse_pattern(w))).cast("double") if w else F.lit(0.0) for w in abuse)
    return {
        "words": n,
        "word_length": chars / n,
        "distinct": F.size(F.array_distinct(words)) / n,
        "distinct_scaled": F.size(F.array_distinct(words)) / F.pow(n, F.lit(0.8)),
        "upper": count(r"\p{Lu}") / chars,
        "marks": count(MARKS) / n,
        "bars": count(r"\|") / n,
        "digits": count(r"\p{Nd}") / chars,
        "repeats": count(r"(?<!\S)(\S+) \1(?!\S)") / n,
        "stops": count(r"[.?]") / n,
        "links": count(r"https?:|www\.|@") / n,
        "lines": count("\n") / n,
        "abuse": sure,
        "likely_abuse": likely,
        "abuse_share": (sure + likely) / n,
    }


def abuse_pattern(words: list[str]) -> str:
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[0], []).append(w[1:])
    # word beginnings are of letters and digits only, so nothing needs escaping
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by.items()) + ")"


def abuse_words(texts: list[str], toxic: np.ndarray, least: int = 6, lift: float = 4.0, most: int = 80) -> list[list[str]]:
    """Word beginnings of 3 to 8 characters that tell toxic documents: the sure ones, then those that others hold now and then.

    The next one is always that with the largest likelihood ratio among the
    documents that no earlier one has explained.
    """
    def units(text: str) -> set[str]:
        return {w[:k] for w in set(WORD.findall(text.lower())) for k in range(3, 9) if len(w) >= k}

    bad, good = Counter(), Counter()
    for text, t in zip(texts, toxic):
        if t:
            bad.update(units(text))
    bad = Counter({w: n for w, n in bad.items() if n >= least})
    for text, t in zip(texts, toxic):
        if not t:
            good.update(units(text) & bad.keys())
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    names = sorted(w for w, n in bad.items() if n / n1 >= lift * good[w] / n0)
    at = {w: k for k, w in enumerate(names)}
    held = np.zeros((len(names), len(texts)), bool)
    for d, text in enumerate(texts):
        held[[at[w] for w in units(text) & at.keys()], d] = True
    t, left, tiers = toxic.astype(bool), np.ones(len(texts), bool), [[], []]

    def entropy(p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return -(p * np.log(p) + (1 - p) * np.log(1 - p))

    for _ in range(most):
        if not names or not (left & t).any():
            break
        pos, neg = (held & (left & t)).sum(1), (held & (left & ~t)).sum(1)
        p1, p0 = (left & t).sum(), max(1, (left & ~t).sum())
        n, total = pos + neg, p1 + p0
        gain = 2 * (total * entropy(p1 / total) - n * entropy(pos / np.maximum(n, 1)) - (total - n) * entropy((p1 - pos) / np.maximum(total - n, 1)))
        gain[(pos < least) | (pos / p1 < lift * neg / p0)] = 0
        best = np.flatnonzero(gain >= gain.max() - 1e-6)
        k = int(max(best, key=lambda i: (len(names[i]), names[i])))
        if gain[k] < 30:
            break
        tiers[int(pos[k] < 0.95 * n[k])].append(names[k])
        left &= ~(held[k] & t) if pos[k] < 0.95 * n[k] else ~held[k]
    # further sure ones, though other words explain their documents: a text may hold any one of them
    for w in sorted(names, key=lambda w: (len(w), w)):
        if bad[w] >= least + 2 and good[w] <= 0.02 * bad[w] and not any(w[:k] in tiers[0] for k in range(3, len(w) + 1)):
            # as long as a longer beginning is held by as many, it is more specific and catches the same
            longer = [x for x in names if x.startswith(w) and bad[x] == bad[w]]
            if not any(x in tiers[0] for x in longer):
                tiers[0].append(max(longer, key=len))
    return tiers


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.terms:
            out &= (x[name] > at) if above else (x[name] <= at)
        return out

    def column(self, x: Column) -> Column:
        """The rule on a struct of statistics."""
        out = None
        for name, above, at in self.terms:
            c = (x[name] > F.lit(at)) if above else (x[name] <= F.lit(at))
            out = c if out is None else out & c
        return out


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[float, Rule]]

    def probability(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = self.intercept + sum((w * r.holds(x) for w, r in self.rules), np.zeros(len(next(iter(x.values())))))
        return 1 / (1 + np.exp(-z))

    def column(self, x: Column) -> Column:
        z = F.lit(self.intercept)
        for w, r in self.rules:
            z = z + F.when(r.column(x), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(binned, cuts, names, grad, hess, depth, rows, path, rules):
    """One regression tree on gradients; adds its paths to ``rules`` and returns leaf values by row."""
    best = (1e-3, None)
    if depth and len(rows) >= 20:
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        base = total_g**2 / (total_h + 1)
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gs, hs, ns = np.bincount(b, g, BINS).cumsum()[:-1], np.bincount(b, h, BINS).cumsum()[:-1], np.bincount(b, minlength=BINS).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - base
            gain[(ns < 8) | (len(rows) - ns < 8)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0] and k < len(cuts[f]):
                best = (gain[k], (f, k))
    if best[1] is None:
        return [(rows, -grad[rows].sum() / (hess[rows].sum() + 1))]
    f, k = best[1]
    out = []
    for above in (False, True):
        part = rows[(binned[rows, f] > k) == above]
        step = (*path, (names[f], above, float(cuts[f][k])))
        rules.append(step)
        out += _grow(binned, cuts, names, grad, hess, depth - 1, part, step, rules)
    return out


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> list[Rule]:
    """The paths of boosted trees, shortened to one bound a side and without repetitions."""
    names = list(x)
    cuts = [np.unique(np.quantile(x[n], np.linspace(0, 1, BINS)[1:-1])) for n in names]
    binned = np.stack([np.searchsorted(c, x[n], "left") for c, n in zip(cuts, names)], 1)
    z, paths, rng = np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), [], np.random.default_rng(seed)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        found: list = []
        for part, value in _grow(binned, cuts, names, p - y, p * (1 - p), depth, rows, (), found):
            pass
        for step in found:
            paths.append(step)
        # the update applies to all rows, by the leaf that they fall into
        leaves = [s for s in found if not any(t[: len(s)] == s and len(t) > len(s) for t in found)]
        for leaf in leaves:
            held = Rule(leaf).holds(x)
            if held.any():
                z[held] -= 0.3 * (p - y)[held].sum() / ((p * (1 - p))[held].sum() + 1)
    out: dict[tuple, Rule] = {}
    for path in paths:
        bounds: dict[tuple[str, bool], float] = {}
        for n, above, at in path:
            bounds[n, above] = (max if above else min)(at, bounds.get((n, above), at))
        terms = tuple(sorted((n, a, t) for (n, a), t in bounds.items()))
        out.setdefault(terms, Rule(terms))
    return list(out.values())


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, w=None, b=0.0, steps: int = 200):
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, m = r.shape
    w = np.zeros(m) if w is None else w.copy()
    rate = 4 * n / max(1.0, float((r.sum(1) + 1).sum()) * 1.0)
    rate = min(rate, 4 / max(1.0, float((r.sum(1) + 1).max())) * 4)
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(r @ v + vb))) - y
        nw = v - rate * (r.T @ g) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * g.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_ensemble(x: dict[str, np.ndarray], y: np.ndarray, penalties=(0.01, 0.004, 0.002)) -> Ensemble:
    """Rules with weights; the penalty is the one with the least loss on every fourth row."""
    share = (y.sum() + 0.5) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        share = min(share, 0.4)
        return Ensemble(float(math.log(share / (1 - share))), [])
    held = np.arange(len(y)) % 4 == 3
    rules = tree_rules({k: v[~held] for k, v in x.items()}, y[~held])
    if not rules:  # too few rows for a tree
        return Ensemble(float(math.log(share / (1 - share))), [])
    r = np.stack([q.holds(x) for q in rules], 1).astype(np.float64)
    best, w, b = (math.inf, 0.0, None), None, 0.0
    for penalty in penalties:
        w, b = lasso(r[~held], y[~held], penalty, w, b)
        z = r[held] @ w + b
        loss = float(np.mean(np.logaddexp(0, z) - y[held] * z))
        if loss < best[0]:
            best = (loss, penalty, (w, b))
    w, b = lasso(r, y, best[1], *best[2])
    kept = [(float(a), q) for a, q in zip(w, rules) if abs(a) > 0.02]
    return Ensemble(float(b), kept)


@dataclass
class Classifier:
    abuse: list[list[str]]
    low: Ensemble
    toxic: Ensemble

    def verdict(self, text: Column, threshold: float = THRESHOLD) -> Column:
        """A struct of low_quality, toxicity and keep: one expression, in which each statistic is computed once."""

        def judged(words: Column) -> Column:
            stats = F.struct(*[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in statistics(text, words, self.abuse).items()])
            real = F.array_join(words, "") != ""
            scores = let(stats, lambda x: F.struct(*[F.when(real, F.round(e.column(x), 6)).alias(n) for n, e in (("low_quality", self.low), ("toxicity", self.toxic))]))
            keep = lambda x: F.coalesce((x["low_quality"] < threshold) & (x["toxicity"] < threshold), F.lit(False))
            return let(scores, lambda x: F.struct(x["low_quality"].alias("low_quality"), x["toxicity"].alias("toxicity"), keep(x).alias("keep")))

        return let(words_of(text), judged)

    def scored(self, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """The input's columns and low_quality, toxicity, keep."""
        held = free("verdict", docs.columns)
        out = docs.withColumn(held, self.verdict(F.col("text"), threshold))
        return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(held)[n].alias(free(n, docs.columns)) for n in ("low_quality", "toxicity", "keep")])


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> list:
    """At most ``sample_rows`` rows of (text, quality, toxic)."""
    chosen = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .withColumnRenamed("doc_id", "_id")
    )
    # at most sample_rows rows of three numbers: small enough to send to all executors
    texts = docs.select("doc_id", "text").filter("text is not null")
    rows = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"])
    return rows.select("doc_id", "text", "_q", "_t")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Learns the abuse words, then both ensembles, from a bounded sample."""
    rows = labelled(docs, labels, sample_rows).toPandas().sort_values(["doc_id", "text"])
    toxic, low = rows["_t"].to_numpy(float), 1 - rows["_q"].to_numpy(float)
    texts = rows["text"].tolist()
    abuse = abuse_words(texts, toxic) if len(rows) else [[], []]
    spark = docs.sparkSession
    if not len(rows):
        none = fit_ensemble({"words": np.zeros(0)}, np.zeros(0))
        return Classifier([[], []], none, none)
    frame = spark.createDataFrame(rows[["text"]].reset_index(names="at")[["at", "text"]].assign(at=range(len(rows))))
    stats = frame.select("at", *[c.alias(k) for k, c in statistics(F.col("text"), words_of(F.col("text")), abuse).items()]).toPandas().sort_values("at")
    x = {k: stats[k].fillna(0).to_numpy(float) for k in stats.columns if k != "at"}
    # the texts aren't needed any more; memory that is free goes before the ensembles take theirs, and after
    del rows, texts, frame, stats
    release()
    found = Classifier(abuse, fit_ensemble(x, low), fit_ensemble(x, toxic))
    release()
    return found


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.scored(docs).select("doc_id", "low_quality", "toxicity", "keep")
