"""Frozen models: equal scores after a reload, and refusals of whatever is not the recorded thing."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from foretime.operators import features, frozen, linear

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) + [0, 3]
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    x[rng.random((300, 2)) < 0.1] = np.nan
    d = pd.DataFrame(x, columns=NAMES).assign(home_win=y, game_id=range(300), season=[2000 + i // 100 for i in range(300)])
    return d, spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), "a double, b double, home_win int, game_id int, season int")


def test_scores_after_reload_and_refusals(spark, frame, tmp_path):
    pdf, d = frame
    code = frozen.code_digest([features, linear])
    base = frozen.champion(d.where("season < 2002"), NAMES, "home_win", 0.5, code)
    assert (base["first_season"], base["last_season"], base["n"]) == (2000, 2001, 200)
    path, top_path = str(tmp_path / "champion"), str(tmp_path / "challenger")
    frozen.save(spark, base, path)
    got = frozen.load(spark, path, code)
    assert got["digest"] == base["digest"]
    p = {r.game_id: r.p for r in frozen.score(d, got).collect()}
    want = 1 / (1 + np.exp(-frozen.raw_scores(pdf[NAMES].values, base)))
    assert [p[i] for i in range(300)] == pytest.approx(want.tolist())

    oof = frozen.score(d.where("season = 2002"), base).selectExpr("home_win AS y", "p")
    top = frozen.challenger(base, oof)
    frozen.save(spark, top, top_path)
    top = frozen.load(spark, top_path, code, got)
    q = {r.game_id: r.p for r in frozen.score(d, got, top).collect()}
    logit = np.log(want / (1 - want))
    assert [q[i] for i in range(300)] == pytest.approx((1 / (1 + np.exp(-(logit * top["slope"] + top["shift"])))).tolist())

    with pytest.raises(AnalysisException):
        frozen.save(spark, base, path)
    with pytest.raises(ValueError, match="feature code"):
        frozen.load(spark, path, frozen.code_digest([features]))
    other = frozen.champion(d.where("season < 2001"), NAMES, "home_win", 0.5, code)
    assert other["data_digest"] != base["data_digest"]
    with pytest.raises(ValueError, match="another base"):
        frozen.load(spark, top_path, code, other)
    changed = {**base, "intercept": base["intercept"] + 1e-6}
    frozen.save(spark, changed, str(tmp_path / "changed"))
    with pytest.raises(ValueError, match="was changed"):
        frozen.load(spark, str(tmp_path / "changed"), code)


def test_data_digest_is_the_content(frame):
    _, d = frame
    one = frozen.data_digest(d)
    assert one == frozen.data_digest(d.repartition(7)) != frozen.data_digest(d.where("game_id > 0"))
    assert json.loads(json.dumps(one)) == one
