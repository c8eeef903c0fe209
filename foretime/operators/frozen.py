"""Models frozen by content: what was fitted, on which data, by which code, and nothing else scores.

A frozen model is one JSON row: weights and scaling, parameters, seasons, row count, a digest of
the training rows, of the code that makes the features, and of all this together. Scoring
recomputes the digests and refuses a model, or feature code, that is not the recorded one. A
challenger is derived: its base model's name and digest, and a calibrator on top.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Sequence
from types import ModuleType

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.operators.audit import fingerprint
from foretime.operators.linear import Scaling, fit_logistic

#: Probabilities are kept this far from 0 and 1 before their logit is calibrated.
EDGE = 1e-6


def code_digest(modules: Sequence[ModuleType]) -> str:
    """Of the source text of the modules that make the features."""
    return hashlib.sha256("\n".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def data_digest(rows: DataFrame) -> str:
    """Of a table's content, whatever the order of its rows."""
    return hashlib.sha256(json.dumps(fingerprint(rows).first().asDict(), default=str, sort_keys=True).encode()).hexdigest()


def _sealed(content: dict) -> dict:
    return {**content, "digest": hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()}


def champion(train: DataFrame, features: Sequence[str], label: str, C: float, code: str, season: str = "season", id: str = "game_id") -> dict:
    """A logistic model with all that it was made from."""
    known = train.where(F.col(label).isNotNull())
    scaling = Scaling.of(known, features)
    beta = fit_logistic(known.select(scaling.array().alias("z"), F.array(F.col(label).cast("double")).alias("y")), len(features), 1, C)[0]
    span = known.agg(F.min(season).alias("first"), F.max(season).alias("last"), F.count(F.lit(1)).alias("n")).first()
    return _sealed({
        "kind": "champion", "features": list(features), "fill": scaling.fill, "mean": scaling.mean, "spread": scaling.spread,
        "weights": beta[:-1].tolist(), "intercept": float(beta[-1]), "C": C, "first_season": span["first"], "last_season": span["last"], "n": span["n"],
        "data_digest": data_digest(known.select(id, label, *features)), "code_digest": code})


def challenger(base: dict, out_of_fold: DataFrame, y: str = "y", p: str = "p") -> dict:
    """``base`` with a calibrator fitted to rows that it hadn't seen."""
    line = fit_logistic(out_of_fold.select(F.array(_logit(F.col(p))).alias("z"), F.array(F.col(y).cast("double")).alias("y")), 1, 1, float("inf"))[0]
    return _sealed({"kind": "challenger", "base_digest": base["digest"], "slope": float(line[0]), "shift": float(line[1]), "n": out_of_fold.count(), "code_digest": base["code_digest"]})


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(q / (1 - q))


def save(spark: SparkSession, model: dict, path: str) -> None:
    """Write a model once; a path that exists is refused by the writer."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def load(spark: SparkSession, path: str, code: str, base: dict | None = None) -> dict:
    """A stored model, if it is still what it says, and its feature code what it was; a challenger only on its own base."""
    model = json.loads(spark.read.text(path).first()["value"])
    content = {k: v for k, v in model.items() if k != "digest"}
    if _sealed(content)["digest"] != model["digest"]:
        raise ValueError(f"the model at {path} was changed after it was frozen")
    if model["code_digest"] != code:
        raise ValueError(f"feature code has changed since the model at {path} was frozen")
    if model["kind"] == "challenger" and (base is None or base["digest"] != model["base_digest"]):
        raise ValueError(f"the challenger at {path} belongs to another base model")
    return model


def score(df: DataFrame, model: dict, top: dict | None = None, p: str = "p") -> DataFrame:
    """``df`` with the model's probability, or with that of the challenger ``top`` derived from it."""
    scaling = Scaling(tuple(model["features"]), tuple(model["fill"]), tuple(model["mean"]), tuple(model["spread"]))
    terms = F.zip_with(scaling.array(), F.array(*map(F.lit, model["weights"])), lambda z, w: z * w)
    raw = F.aggregate(terms, F.lit(float(model["intercept"])), lambda a, x: a + x)
    own = 1 / (1 + F.exp(-raw))
    if top is not None:
        own = 1 / (1 + F.exp(-(_logit(own) * top["slope"] + top["shift"])))
    return df.withColumn(p, own)


def raw_scores(x: np.ndarray, model: dict) -> np.ndarray:
    """The same in plain arrays, for tests and small tables."""
    x = np.where(np.isnan(x), np.array(model["fill"]), x)
    return (x - np.array(model["mean"])) / np.array(model["spread"]) @ np.array(model["weights"]) + model["intercept"]
