"""Feature statistics are summed up in the long form, one group a feature."""

import numpy as np
import pytest

from editpulse.operators import features as P


def test_statistics_come_from_narrow_groups_and_keep_the_order_of_features(spark):
    values = {"z": [1.0, 2.0, 4.0, 90.0], "a": [0.5, None, 1.0, 0.25], "m": [None] * 4, "c": [3.0] * 4}
    rows = spark.createDataFrame([(i, *(v[i] for v in values.values())) for i in range(4)], "user_id long, " + ", ".join(f"{n} double" for n in values))
    profile = P.skew_profile(rows, list(values))
    assert "keys=[feature" in profile._jdf.queryExecution().executedPlan().toString()
    found = {r["feature"]: r for r in profile.collect()}
    assert {n: (found[n]["n"], found[n]["low"], found[n]["high"]) for n in values} == {"z": (4, 1.0, 90.0), "a": (3, 0.25, 1.0), "m": (0, None, None), "c": (4, 3.0, 3.0)}
    scaled = P.scale_features(rows)
    assert scaled.columns == ["user_id", "z_scaled", "a_scaled", "c_scaled"]
    known = np.array([0.5, 1.0, 0.25])
    assert [r["a_scaled"] for r in scaled.orderBy("user_id").collect() if r["a_scaled"] is not None] == pytest.approx(list((known - known.mean()) / known.std()))
    assert P.scale_features(rows.limit(0)).columns == ["user_id"]
