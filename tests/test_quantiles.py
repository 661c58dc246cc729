"""Exact grouped quantiles match pandas' linear quantile, including a hot group."""

import numpy as np
import pandas as pd

from lossframe.operators.quantiles import group_quantiles


def test_matches_pandas(spark):
    rng = np.random.default_rng(7)
    hot = rng.integers(0, 500, 20000).astype(float)          # one group holds most rows
    small = rng.normal(100, 30, 37).round(3)
    tiny = np.array([5.0, 5.0, 5.0])
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["small"] * len(small) + ["tiny"] * 3,
                        "v": np.concatenate([hot, small, tiny])})
    out = group_quantiles(spark.createDataFrame(pdf), ["g"], "v", [0.25, 0.75], num_partitions=16)
    got = {r["g"]: (r["_n"], r["q0"], r["q1"]) for r in out.collect()}
    for g, sub in pdf.groupby("g"):
        n, q0, q1 = got[g]
        assert n == len(sub)
        assert abs(q0 - sub.v.quantile(0.25)) < 1e-9
        assert abs(q1 - sub.v.quantile(0.75)) < 1e-9


def check_columns(spark, pdf, accuracy):
    from pyspark.sql import functions as F

    from lossframe.operators.quantiles import column_quantiles
    df = spark.createDataFrame(pdf)
    out, groups = column_quantiles(df, "g", {"x": F.col("x"), "y": F.when(F.col("y") > -1e300, F.col("y")), "none": F.lit(None)}, [0.25, 0.75],
                                   [F.count("x").alias("n")], accuracy)
    got = {(r["g"], r["m"]): (r["q0"], r["q1"]) for r in out.collect()}
    want = {(g, m): tuple(sub[m].quantile([0.25, 0.75])) for g, sub in pdf.groupby("g") for m in "xy" if sub[m].notna().any()}
    assert set(got) == set(want)
    for k, q in want.items():
        assert np.allclose(got[k], q, rtol=0, atol=1e-9), k
    assert {r["g"]: r["n"] for r in groups.collect()} == pdf.groupby("g").x.count().to_dict()


def frame_of_groups():
    rng = np.random.default_rng(9)
    sizes = {"hot": 30_000, "ties": 4_000, "small": 11, "two": 2, "one": 1, "empty": 3}
    pdf = pd.DataFrame({"g": np.repeat(list(sizes), list(sizes.values()))})
    pdf["x"] = rng.normal(0, 1e6, len(pdf))
    pdf["y"] = np.where(rng.random(len(pdf)) < 0.7, 0.0, rng.integers(-5, 50, len(pdf)) / 4)
    pdf.loc[pdf.g == "ties", "x"] = rng.choice([0.0, 0.0, 1.0], (pdf.g == "ties").sum())
    pdf.loc[pdf.g == "empty", ["x", "y"]] = None
    pdf["y"] = pdf.y.where(rng.random(len(pdf)) > 0.1)
    return pdf.sample(frac=1, random_state=1)


def test_column_quantiles_match_pandas(spark):
    for accuracy in (2000, 10):
        check_columns(spark, frame_of_groups(), accuracy)


def test_brackets_that_miss_are_opened(spark, monkeypatch):
    """Whatever the sketch says, the quantiles are exact."""
    from lossframe.operators import quantiles as Q
    for edges in ([1e9, 2e9, 1e9, 2e9], [-5.0, -4.0, 0.5, 0.25], [0.0, 0.0, 0.0, 0.0]):
        monkeypatch.setattr(Q.F, "percentile_approx", lambda c, p, a, e=edges: Q.F.array(*[Q.F.lit(x) for x in e]))
        pdf = frame_of_groups()
        check_columns(spark, pdf[pdf.g != "empty"], 2000)


def test_no_shuffle_of_all_values(spark, monkeypatch):
    """The rows are aggregated where they are; only what lies inside the brackets is range-partitioned."""
    from pyspark.sql import functions as F

    from lossframe.operators import quantiles as Q
    seen = []
    monkeypatch.setattr(Q, "rank_histogram", lambda df, *a, real=Q.rank_histogram: (seen.append(df.count()), real(df, *a))[1])
    df = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("g"), F.rand(4).alias("x"))
    Q.column_quantiles(df, "g", {"x": F.col("x")}, [0.25, 0.75])[0].collect()
    assert seen[0] < 0.02 * 200_000
