"""Reuse counts videos and channels of a hash without a copy of every row for each count."""
from reeltide.operators import signals as S


def test_reuse_expands_no_rows(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(S, "cut_lineage", kept)
    rows = [(v, c, float(k), h) for v, c in ((1, 1), (2, 2), (3, None)) for k, h in enumerate("abc")] + [(1, 1, 9.0, "x"), (1, 4, 9.0, "y"), (2, 3, 7.0, "b")]
    df = spark.createDataFrame(rows, "video_id long, channel_id long, timestamp double, hash string")
    out = sorted(tuple(r) for r in S.reuse(df, 1.0, 2.0).collect())
    assert out == [(a, b, 0.0, 0.0, 3.0, True) for a, b in ((1, 2), (1, 3), (2, 3))]
    assert plans and not any("Expand" in p for p in plans)
