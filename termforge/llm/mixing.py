"""Mixing documents to target domain weights with soft membership.

A softmax classifier over native text features, fitted on a labelled table, gives each document a
posterior over domains. Document rates r >= 0 are then fitted by projected-gradient least squares
so that the expected tokens of each domain, sum of r * tokens * posterior, match the targets. A
gradient is one aggregate over all documents (a vector of one number a domain); the rate after t
accelerated steps is a fold over the t gradients, computed in the row, so no rates are stored or collected.

The classifier is fitted on at most about `most_rows` labelled rows by a hash of doc_id
(documented bound). Null and empty texts have no tokens and keep rate 1. Labelled rows of other
documents or without label aren't used; domains without labelled rows get no posterior and can't be
reached. Rates have no upper bound unless `most` names one; a small pull towards 1 (`ridge`, a hundredth
of the targets' weight) picks the rates that change least and keeps them from running away where
targets can't be met. The fit ends when it is proven to be within a thousandth of the least. Repeated rows count as often as they
stand there, each with its own rate; rows without doc_id share one draw. Very long texts are one row
of nine numbers. Extra columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm._store import keep

FEATURES = ("log_tokens", "mean_length", "symbols", "capitals", "shouting", "digits", "distinct", "accents", "lines")
SPACE = r"[\x20\x09-\x0D]+"


def features(docs: DataFrame, *carry: str) -> DataFrame:
    """carry columns, tokens (long) and the array x of FEATURES, all native expressions."""
    base = docs.select(*carry, F.coalesce("text", F.lit("")).alias("body")).withColumn("words", F.array_remove(F.split("body", SPACE), ""))
    n = F.size("words").cast("double")
    per = lambda e: e / F.greatest(n, F.lit(1.0))
    count = lambda p: F.regexp_count("body", F.lit(p)).cast("double")
    held = lambda c: (F.length("body") - F.length(F.replace("body", F.lit(c), F.lit("")))).cast("double")
    chars = F.length("body").cast("double")
    x = F.array(
        F.log1p(n),
        per(chars),
        per(count(r"[#*$%&|<>]+")),
        per(count(r"\p{Lu}")),
        per(held("!")),
        per(count("[0-9]")),
        per(F.size(F.array_distinct("words")).cast("double")),
        per(count(r"[^\x00-\x7F]")),
        per(held("\n")),
    )
    return base.select(*carry, F.size("words").cast("long").alias("tokens"), x.alias("x"))


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a ridge softmax by gradient descent; weights: classes by features + 1."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, target = np.zeros((classes, z.shape[1])), np.eye(classes)[y]
    for _ in range(steps):
        s = z @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.5 * ((p - target).T @ z / len(z) + 1e-4 * w)
    return mean, scale, w


def posterior(x: Column, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """Array of class posteriors as a native expression."""
    mean, scale, w = model
    weights = w[:, :-1] / scale
    bias = w[:, -1] - weights @ mean
    total = lambda k: sum((F.lit(float(weights[k, j])) * F.get(x, F.lit(j)) for j in range(weights.shape[1])), F.lit(float(bias[k])))
    scores = F.array(*[total(k) for k in range(len(w))])
    shifted = F.transform(F.array(scores), lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s))))
    return F.get(F.transform(shifted, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))), F.lit(0))


def _fold(moves: list[list[float]], p: Column, most: float | None, ridge: float) -> Column:
    """(rate, point) after those accelerated projected steps: point is where the next gradient is taken."""
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("point"))
    if not moves:
        return start
    steps = F.array(*[F.array(*[F.lit(v) for v in m]) for m in moves])
    slope = lambda m: F.aggregate(F.zip_with(m, p, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    above = (lambda r: r) if most is None else (lambda r: F.least(F.lit(float(most)), r))
    momentum = (1 - ridge**0.5) / (1 + ridge**0.5)

    def step(held: Column, move: Column) -> Column:
        rate = above(F.greatest(F.lit(0.0), (held["point"] - slope(move) + ridge) / (1 + ridge)))
        return F.get(F.transform(F.array(rate), lambda r: F.struct(r.alias("rate"), (r + momentum * (r - held["rate"])).alias("point"))), F.lit(0))

    return F.aggregate(steps, start, step)


def whitening(gram: np.ndarray) -> np.ndarray:
    """The inverse of a Gram matrix, damped by a hundredth of its largest eigenvalue: mixtures of domains that
    the posteriors hardly tell apart aren't chased."""
    return np.linalg.inv(gram + 0.01 * np.linalg.eigvalsh(gram)[-1] * np.eye(len(gram)))


def fit_rates(known: DataFrame, targets: list[float], steps: int = 1000, tolerance: float = 1e-3, most: float | None = None, ridge: float = 0.01) -> Column:
    """The rate of a row as an expression over p; known holds tokens and p of all documents.

    Accelerated projected gradient from rate 1 on the squared gap between sum(rate * tokens * p) and
    targets * sum(tokens), whitened, plus ridge * sum(tokens * (rate - 1)^2), rates kept at 0 or
    more. With rates measured in tokens the curvature lies between ridge and 1 + ridge (see
    whitening), so full steps can't diverge and the momentum of that ratio brings the error down by a
    tenth a step. Each step's aggregate also takes the dual objective at the gap of the step before,
    which no rates can fall below: the fit ends once the best objective is proven to be within
    `tolerance` (a share) of the least, so `steps` only guards against targets that aren't numbers.
    """
    k = len(targets)
    e = [F.get("p", F.lit(i)) for i in range(k)]
    n = F.col("tokens").cast("double")
    gram = known.agg(F.sum(n).alias("n"), *[F.sum(n * e[i] * e[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    total = gram["n"] or 0.0
    if not total:
        return F.lit(1.0)
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    whiten = whitening(g)
    goal = np.array(targets) / sum(targets) * total
    moves: list[list[float]] = []
    price = np.zeros(k)
    best, chosen, floor = np.inf, 0, 0.0
    for _ in range(steps):
        at = known.select("p", n.alias("n"), _fold(moves, F.col("p"), most, ridge).alias("at")).select("p", "n", "at.rate", "at.point")
        cost = sum((F.lit(float(price[i])) * e[i] for i in range(k)), F.lit(0.0))
        cheapest = F.greatest(F.lit(0.0), 1 - cost / ridge)  # the rate that is best at these prices
        cheapest = cheapest if most is None else F.least(F.lit(float(most)), cheapest)
        sums = {"moved": F.col("n") * (F.col("rate") - 1) * (F.col("rate") - 1), "dual": F.col("n") * (ridge * (cheapest - 1) * (cheapest - 1) + 2 * cheapest * cost)}
        for i in range(k):
            sums |= {f"d{i}": F.col("n") * F.col("rate") * e[i], f"e{i}": F.col("n") * F.col("point") * e[i]}
        got = at.agg(*[F.sum(v).alias(c) for c, v in sums.items()]).first()
        gap, ahead = (np.array([got[f"{c}{i}"] for i in range(k)]) - goal for c in "de")
        loss = float(gap @ whiten @ gap) + ridge * got["moved"]
        floor = max(floor, got["dual"] - float(price @ np.linalg.solve(whiten, price)) - 2 * float(price @ goal))
        if loss < best:
            best, chosen = loss, len(moves)
        if not best - floor > tolerance * best:
            break
        price = whiten @ gap
        moves.append([float(v) for v in whiten @ ahead])
    return _fold(moves[:chosen], F.col("p"), most, ridge)["rate"]


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain 0..3: quality + 2 * toxic."""
    return labels.select("doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("domain")).dropna().distinct()


def rates(docs: DataFrame, labelled: DataFrame, targets: list[float], *carry: str, most_rows: int = 20_000, most: float | None = None) -> DataFrame:
    """carry columns, tokens, p (posteriors) and rate; labelled: doc_id, domain in range(len(targets))."""
    n = labelled.count()
    share = min(1.0, most_rows / max(1, n))
    own = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = features(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id"), "domain").select("domain", "x").collect()
    if sample:
        x = np.array(sorted([float(r["domain"]), *r["x"]] for r in sample))
        model = softmax_fit(x[:, 1:], x[:, 0].astype(int), len(targets))
    else:
        model = (np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros((len(targets), len(FEATURES) + 1)))
    known = keep(features(docs, *carry).select(*carry, "tokens", posterior(F.col("x"), model).alias("p")))
    rate = fit_rates(known, targets, most=most)
    return known.select(*carry, "tokens", "p", F.when(F.col("tokens") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


#: Target token shares of the domains low, good, low and toxic, good and toxic: a policy, not a
#: description of a corpus.
TARGETS = [0.02, 0.86, 0.01, 0.11]


def times(rate: Column, doc_id: Column) -> Column:
    """Whole copies for a rate: its floor, and one more by a hash of doc_id with its fraction's chance."""
    u = F.pmod(F.xxhash64(F.lit("mix"), doc_id), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: list[float] = TARGETS, most: float | None = None) -> DataFrame:
    """docs repeated or left out by their fitted rates; all columns stay."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text")
    found = rates(rows, labelled, targets, "row", "doc_id", most=most)
    copies = found.select("row", F.explode(F.array_repeat(F.lit(1), times(F.col("rate"), F.col("doc_id")))).alias("copy"))
    return copies.select("row.*")
