"""Ranking and selection of terms. Orders are total, so ranks are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termforge.operators import ranges
from termforge.operators.tables import written

SCORE_ORDER = ["abs_score DESC", "selected_score DESC", "label1_doc_count DESC", "label0_doc_count DESC", "term"]


def ordering(keys: list[str]) -> list[Column]:
    return [F.col(k.split()[0]).desc() if k.endswith("DESC") else F.col(k.split()[0]).asc() for k in keys]


def top(rows: DataFrame, keys: list[str], k: int, rank: str = "selection_rank", by: list[str] = ()) -> DataFrame:
    """The first k rows by keys with their ranks. Without groups a distributed top-k comes before the ranking, which then numbers k rows at most."""
    first = rows if by else rows.orderBy(*ordering(keys)).limit(k)
    numbered = first.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*ordering(keys))))
    return numbered.filter(F.col(rank) <= k)


def top_excluding(rows: DataFrame, excluded: DataFrame, keys: list[str], k: int) -> DataFrame:
    """As top(), without excluded terms; fewer than k left is an error at run time."""
    left = top(rows.join(excluded.select("term"), "term", "left_anti"), keys, k)
    short = left.agg(F.count(F.lit(1)).alias("have"))
    guard = F.when(F.col("have") < k, F.raise_error(F.lit(f"fewer than {k} terms are left"))).otherwise(F.lit(True))
    return left.crossJoin(F.broadcast(short)).filter(guard.cast("boolean")).drop("have")


def by_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.filter(F.col("abs_score") >= threshold)


def ranked(rows: DataFrame, keys: list[str], rank: str = "selection_rank") -> DataFrame:
    """All rows with their ranks by keys, numbered by ranges."""
    return ranges.numbered(rows, ordering(keys), rank)


def threshold_join(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """score_threshold, dominant_label, terms: a range join of thresholds (few, broadcast) with the counts of
    each distinct score, so the join sees distinct scores, not terms. Thresholds without terms have no row."""
    counts = scores.groupBy("abs_score", "dominant_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(thresholds), F.col("abs_score") >= F.col("score_threshold")).groupBy("score_threshold", "dominant_label").agg(F.sum("n").alias("terms"))


def threshold_summary(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold the terms at or above it; thresholds without terms stay. One pass of conditional aggregates, no range join."""
    aggs = []
    at = lambda t: F.col("abs_score") >= t
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(at(t)).alias(f"n{i}")] + [F.count_if(at(t) & (F.col("dominant_label") == d)).alias(f"{d}{i}") for d in ("label1", "label0", "neutral")]
        aggs.append(F.min(F.when(at(t), F.col("abs_score"))).alias(f"m{i}"))
    one = scores.agg(F.max("abs_score").alias("max_abs_score"), *aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("score_threshold"), F.col(f"n{i}").alias("selected_term_count"), F.col(f"label1{i}").alias("label1_selected_term_count"),
                 F.col(f"label0{i}").alias("label0_selected_term_count"), F.col(f"neutral{i}").alias("neutral_selected_term_count"),
                 F.col("max_abs_score").alias("max_abs_score"), F.col(f"m{i}").alias("min_selected_abs_score"))
        for i, t in enumerate(thresholds)]))
    return one.select(rows.alias("r")).select("r.*")


def score_curve(scores: DataFrame) -> DataFrame:
    """Terms at each distinct score and at or above it, by dominant label."""
    at = scores.groupBy(F.round("abs_score", 12).alias("abs_score")).agg(
        *[F.count_if(F.col("dominant_label") == d).alias(f"{d}_term_count_at_score") for d in ("label1", "label0", "neutral")], F.count(F.lit(1)).alias("term_count_at_score"))
    sums = {"selected_term_count_at_or_above_score": "term_count_at_score"} | {f"{d}_selected_term_count_at_or_above_score": f"{d}_term_count_at_score" for d in ("label1", "label0", "neutral")}
    return ranges.running(at, [F.col("abs_score").desc()], sums)


def balanced_top(scores: DataFrame, n: int) -> DataFrame:
    """n/2 best terms of each label, joined in order without repeats. n must be even."""
    if n % 2:
        raise ValueError("n must be even")
    half = lambda d: top(scores.filter(F.col("dominant_label") == d), ["abs_score DESC", "label1_doc_count DESC", "label0_doc_count DESC", "term"], n // 2).withColumn("side", F.lit(0 if d == "label1" else 1))
    both = half("label1").unionByName(half("label0"))
    first = both.withColumn("nth", F.row_number().over(W.partitionBy("term").orderBy("side", "selection_rank"))).filter("nth = 1")
    return first.drop("nth")


def overlap(metrics: DataFrame, specs: dict[str, str], k: int) -> DataFrame:
    """Terms over the top-k lists of several columns: how often, best and mean rank, which lists."""
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("ranking_name"), F.col(column).cast("double").alias("v")) for name, column in specs.items()]))
    lists = top(metrics.select("term", names.alias("l")).select("term", "l.*"), ["v DESC", "term"], k, "rank", ["ranking_name"])
    return lists.groupBy("term").agg(
        F.count(F.lit(1)).alias("appearance_count"), F.array_join(F.sort_array(F.collect_list("ranking_name")), ", ").alias("ranking_names"),
        F.min("rank").alias("best_rank"), F.round(F.avg("rank"), 9).alias("average_rank"))


def combined_unique(first: DataFrame, second: DataFrame, k: int, equal_rank_to: str = "second") -> DataFrame:
    """k/2 terms of each ranked list (term, rank); a shared term goes to its better rank, the other list refills.

    Scan depths grow until stable: a list holds its terms that the other one, within its depth,
    doesn't win; its depth is the rank of its (k/2)-th held term. Few rounds, each two small top-k jobs over a written
    table of terms and their two ranks.
    """
    if k % 2:
        raise ValueError("k must be even")
    half = k // 2
    both = written(first.select("term", F.col("rank").alias("ra")).join(second.select("term", F.col("rank").alias("rb")), "term", "full_outer"))
    second_wins = (F.col("rb") <= F.col("ra")) if equal_rank_to == "second" else (F.col("rb") < F.col("ra"))
    loses = {"ra": F.coalesce(second_wins, F.lit(False)), "rb": F.coalesce(~second_wins, F.lit(False))}

    def held(mine: str, other: str, depth: int) -> DataFrame:
        lost = loses[mine] & F.coalesce(F.col(other) <= depth, F.lit(False))
        return both.filter(F.col(mine).isNotNull() & ~lost).orderBy(mine).limit(half)

    depth_a = depth_b = half
    while True:
        a = held("ra", "rb", depth_b).agg(F.max("ra").alias("depth"), F.count("ra").alias("n")).first()
        b = held("rb", "ra", a["depth"] or 0).agg(F.max("rb").alias("depth"), F.count("rb").alias("n")).first()
        if min(a["n"], b["n"]) < half:
            raise ValueError(f"fewer than {half} terms are left in a list")
        if (a["depth"], b["depth"]) == (depth_a, depth_b):
            break
        depth_a, depth_b = a["depth"], b["depth"]
    out = lambda mine, other, depth, name: held(mine, other, depth).select(F.lit(name).alias("selection_source"), "term", F.col(mine).alias("source_rank"))
    return out("ra", "rb", depth_b, "first").unionByName(out("rb", "ra", depth_a, "second"))


#: Of each mode its sources, in order, and whether a shared term counts once.
MODES = {
    "term_frequency": (["term_frequency"], False),
    "document_frequency": (["document_frequency"], False),
    "tfidf": (["tfidf"], False),
    "combined_unique": (["term_frequency", "document_frequency"], True),
    "combined_duplicate": (["term_frequency", "document_frequency"], False),
    "document_tfidf_unique": (["document_frequency", "tfidf"], True),
    "document_tfidf_duplicate": (["document_frequency", "tfidf"], False),
}


def by_mode(tables: dict[str, DataFrame], mode: str, k: int) -> DataFrame:
    """selection_mode, selection_rank, term, selection_source, source_rank: k terms of difference tables
    (term, absolute_difference) by source name. Two sources give k/2 each (k must be even); a term of
    both counts for its better rank, on equal ranks for document_frequency. Fewer terms than asked are an error."""
    if mode not in MODES:
        raise ValueError(f"unknown selection mode: {mode}")
    if k <= 0:
        raise ValueError("k must be positive")
    sources, unique = MODES[mode]
    if len(sources) > 1 and k % 2:
        raise ValueError(f"{mode} needs an even k")
    keys = ["absolute_difference DESC", "term"]
    if unique:
        lists = [ranked(tables[n].select("term", "absolute_difference"), keys, "rank") for n in sources]
        found = combined_unique(*lists, k, "second" if sources[1] == "document_frequency" else "first")
        own = found.withColumn("place", F.when(F.col("selection_source") == "first", 0).otherwise(1))
        named = own.withColumn("selection_source", F.when(F.col("place") == 0, sources[0]).otherwise(sources[1]))
    else:
        named, share = None, k // len(sources)
        for i, n in enumerate(sources):
            part = top_excluding(tables[n].select("term", "absolute_difference"), tables[n].select("term").limit(0), keys, share)
            part = part.select("term", F.col("selection_rank").cast("long").alias("source_rank"), F.lit(n).alias("selection_source"), F.lit(i).alias("place"))
            named = part if named is None else named.unionByName(part)
    rank = F.row_number().over(W.orderBy("place", "source_rank"))  # k rows
    return named.select(F.lit(mode).alias("selection_mode"), rank.alias("selection_rank"), "term", "selection_source", "source_rank")


def best_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """Highest mean_accuracy a condition, then the smaller feature_count; rows that don't parse are skipped."""
    parsed = rows.withColumns({"_acc": F.expr("try_cast(mean_accuracy AS DOUBLE)"), "_k": F.expr("try_cast(feature_count AS BIGINT)")}).filter("_acc IS NOT NULL AND _k IS NOT NULL")
    return parsed.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(F.col("_acc").desc(), "_k"))).filter("_nth = 1").drop("_nth", "_acc", "_k")
