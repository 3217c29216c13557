"""Sliding windows over raw measures against a plain loop."""
import random

from reeltide.operators import temporal as B


def brute(measures, durations):
    out = {}
    for video, duration in durations:
        k = 0
        while duration is not None and k * 2.5 < duration and min(k * 2.5 + 5, duration) - k * 2.5 >= 2.5:
            own = [v for i, t, v in measures if i == video and t is not None and k * 2.5 <= t < k * 2.5 + 5 and v is not None]
            n = sum(i == video and t is not None and k * 2.5 <= t < k * 2.5 + 5 for i, t, _ in measures)
            out[video, k * 2.5] = (min(k * 2.5 + 5, duration), n, sum(own) / len(own) if own else None)
            k += 1
    return out


def test_windows(spark):
    rng = random.Random(3)
    durations = [("a", 0.4), ("b", 2.4), ("c", 2.6), ("d", 7.0), ("e", 2.5), ("f", 61.3), ("g", None), ("h", 12.0)]
    measures = [(v, rng.random() * (d or 9) * 1.1, rng.choice([None, rng.random()])) for v, d in durations if v != "h" for _ in range(60)]
    measures += [("d", 2.5, 1.0), ("d", 5.0, 2.0), ("d", 0.0, 3.0), ("f", None, 1.0), ("unknown", 1.0, 1.0), ("f", -0.5, 1.0)]
    got = B.sliding_windows(spark.createDataFrame(measures, "video_id string, at double, v double"), spark.createDataFrame(durations, "video_id string, duration_s double"), ["v"])
    got = {(r["video_id"], r["start_time"]): (r["end_time"], r["n"], r["mean_v"]) for r in got.collect()}
    want = brute(measures, durations)
    assert got.keys() == want.keys() and not any(v in "abg" for v, _ in got) and [s for v, s in sorted(got) if v == "d"] == [0.0, 2.5]
    for key, (end, n, mean) in want.items():
        assert got[key][:2] == (end, n) and (mean is None) == (got[key][2] is None) and abs((mean or 0) - (got[key][2] or 0)) < 1e-9
    assert got["h", 0.0] == (5.0, 0, None)
