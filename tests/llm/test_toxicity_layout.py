"""The toxicity model is the rows' own: no partitioning of the tables changes it."""

import numpy as np
import pytest

from foretime.llm import toxicity


@pytest.mark.parametrize("fit_rows", [6000, 40])
def test_same_model_for_any_partitioning(spark, fit_rows):
    rng = np.random.default_rng(3)
    words = ["fair", "calm", "kind", "tree", "road", "house"]
    rows = [(i, " ".join([*rng.choice(words, 20), *(["vileword", "foulword"] if i % 4 == 0 else [])])) for i in range(300)]
    # ids that repeat with other texts, and equal rows
    docs = spark.createDataFrame([*rows, *rows[:30], *((i, f"other text {i}") for i in range(40)), (None, "x"), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 4 == 0)) for i in range(250)), (500, 1)], "doc_id long, toxic int")
    models = [toxicity.fit(docs.repartition(n), labels.repartition(n), fit_rows=fit_rows) for n in (1, 3, 7)]
    scored = [sorted((repr(r) for r in toxicity.scored(docs, m).collect())) for m in models]
    assert scored[0] == scored[1] == scored[2]
