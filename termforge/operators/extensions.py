"""What users can put in place of the library's own: tokenizers, models, a cache of contexts; and JSON leaves as a table function.

    with using(tokenizer="white_space", cache="hdfs://.../contexts"):
        QUERIES["o81_score_table"](spark, folder)

A tokenizer maps a text column to an array of strings; a model maps training rows, labels and test rows to decisions. The
setting holds for queries begun inside the block, in this driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from termforge.functions import text as T

TOKENIZERS: dict[str, Callable[[Column, int], Column]] = {
    "alphabetic": T.tokenize,
    "white_space": lambda text, min_len=1: F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) >= F.greatest(F.lit(min_len), F.lit(1))),
}
_CURRENT: dict[str, str | None] = {"tokenizer": "alphabetic", "cache": None}


def register_tokenizer(name: str, function: Callable[[Column, int], Column]) -> None:
    """function(text column, least length): an array of tokens; native expressions stay native, a UDF is possible."""
    if name in TOKENIZERS and TOKENIZERS[name] is not function:
        raise ValueError(f"a tokenizer of that name is known: {name}")
    TOKENIZERS[name] = function


def current(what: str) -> str | None:
    return _CURRENT[what]


@contextmanager
def using(tokenizer: str | None = None, cache: str | None = None) -> Iterator[None]:
    """Settings for the queries begun inside: a known tokenizer, a folder that keeps split contexts."""
    if tokenizer is not None and tokenizer not in TOKENIZERS:
        raise ValueError(f"no tokenizer of that name: {tokenizer}")
    before = dict(_CURRENT)
    _CURRENT.update({k: v for k, v in (("tokenizer", tokenizer), ("cache", cache)) if v is not None})
    try:
        yield
    finally:
        _CURRENT.update(before)


def model(fit_predict: Callable[[np.ndarray, np.ndarray, np.ndarray, dict], tuple[np.ndarray, np.ndarray]]) -> Callable[[DataFrame, DataFrame, float | None], DataFrame]:
    """For models.candidate_records(run=...): fit_predict(training rows, labels, test rows, candidate) gives the decisions of
    both; above 0 is label 1. A context is one group, its candidates (any columns beside candidate_index and
    param_label) are fitted one after another, the gate is that of models.evaluate."""
    out = "outer_fold int, inner_fold int, candidate_index int, param_label string, doc_id long, label int, status string, decision double, predicted int"

    def run(rows: DataFrame, candidates: DataFrame, margin: float | None) -> DataFrame:
        known = [r.asDict() for r in candidates.orderBy("candidate_index").collect()]  # a grid, of fixed size

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("doc_id")
            train, test = part[part.role == "train"], part[part.role == "test"]
            y, found = train.label.to_numpy(), []
            for g in known:
                status, decision = "one_class", np.zeros(len(test))
                if len(np.unique(y)) == 2:
                    x, xt = (np.array(p.features.tolist(), float).reshape(len(p), -1) if len(p) else np.zeros((0, len(train.features.iloc[0]))) for p in (train, test))
                    own, decision = fit_predict(x, y, xt, g)
                    status = "ok" if margin is None or (np.where(y == 1, 1, -1) * own >= margin).all() else "invalid_margin"
                found.append(pd.DataFrame({"outer_fold": test.outer_fold, "inner_fold": test.inner_fold, "candidate_index": g["candidate_index"], "param_label": g["param_label"], "doc_id": test.doc_id, "label": test.label, "status": status, "decision": decision, "predicted": (decision > 0).astype("int32")}))
            return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in out.split(", ")])

        return rows.groupBy("outer_fold", "inner_fold").applyInPandas(fit, out)

    return run


@udtf(returnType="path string, nth int, leaf string")
class JsonLeaves:
    """A row for each non-blank leaf string of a JSON value, with its path and place; none for null or what isn't JSON.

    Values nested deeper than the parser goes have no rows. In SQL after spark.udtf.register("json_leaves", JsonLeaves):
    SELECT ... FROM t, LATERAL json_leaves(t.props).
    """

    def eval(self, text: str):
        try:
            left = [("$", json.loads(text))] if text is not None else []
        except (ValueError, RecursionError):
            return
        nth = 0
        while left:
            path, value = left.pop()
            if isinstance(value, dict):
                left += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                left += [(f"{path}[{k}]", v) for k, v in reversed(list(enumerate(value)))]
            elif isinstance(value, str) and value.strip():
                yield path, nth, value
                nth += 1


def json_leaf_rows(rows: DataFrame, column: str) -> DataFrame:
    """rows, each once for every leaf of `column`, with path, nth and leaf in its place."""
    return rows.lateralJoin(JsonLeaves(F.col(column).outer())).drop(column)
