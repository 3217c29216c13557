"""Column functions at the borders of their rules."""
import time

import pytest
from pyspark.sql import functions as F

from reeltide.functions import scores as S
from reeltide.functions import text as T
from reeltide.functions import urls as U


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("likes,score", [(9, 0.4), (10, 0.2), (99, 0.2), (100, 0.06)])
def test_quick_spam_damping(spark, likes, score):
    assert value(spark, T.quick_spam(F.lit("please subscribe"), F.lit(likes))) == pytest.approx(score)


def test_quick_spam_parts(spark):
    assert value(spark, T.quick_spam(F.lit("http://a http://b"), F.lit(0))) == pytest.approx(0.3)
    assert value(spark, T.quick_spam(F.lit("hey"), F.lit(0))) == pytest.approx(0.2)


@pytest.mark.parametrize("p,band", [(-0.1, "weak"), (0.2499, "weak"), (0.25, "low"), (0.5, "moderate"), (0.75, "strong"), (0.9, "very_strong"), (1.4, "very_strong")])
def test_bands(spark, p, band):
    assert value(spark, S.confidence_band(F.lit(p)))["band"] == band


def test_timestamps_keep_their_order_and_overlaps(spark):
    got = value(spark, T.extract_timestamps(F.lit("see 1:23:45, at 5 minutes and 30 sec")))
    assert got["raw"] == ["1:23:45", "1:23", "at 5 minutes", "30 sec"]
    assert got["seconds"] == [5025.0, 83.0, 5.0, 30.0]


def test_energy_of_missing_loudness_is_speech(spark):
    assert value(spark, S.energy(F.lit(None).cast("double"), F.lit(0.7))) == pytest.approx(0.7)
    assert value(spark, S.energy(F.lit(-30.0), F.lit(0.7))) == pytest.approx(0.5)


@pytest.mark.parametrize("text,bad", [("thank you " * 4, True), ("thank you " * 3, False), ("go go go go go", False), ("go go go go go stop", True), ("a fine sentence here", False), ("", True)])
def test_hallucination(spark, text, bad):
    assert value(spark, T.is_hallucination(F.lit(text), F.lit(0.0), F.lit(5.0))) is bad


def test_hallucination_of_inverted_span(spark):
    assert value(spark, T.is_hallucination(F.lit("fine words"), F.lit(5.0), F.lit(4.0))) is True


@pytest.mark.parametrize("url,out", [
    ("https://youtu.be/x", "https://youtu.be/x?t=3725s"), ("https://youtube.com/watch?v=x", "https://youtube.com/watch?v=x&t=3725s"),
    ("https://twitch.tv/videos/1", "https://twitch.tv/videos/1?t=1h2m5s"), ("https://vimeo.com/1", "https://vimeo.com/1#t=3725s"), ("https://tiktok.com/@a", "https://tiktok.com/@a")])
def test_timecode(spark, url, out):
    assert value(spark, U.timecoded_url(F.lit(url), F.lit(3725.9))) == out


@pytest.mark.parametrize("url,key", [("https://www.youtube.com/@abc/videos", "yt:abc"), ("https://x.com/home", "twitter:home"), ("https://www.instagram.com/me/", "ig:me"), ("https://example.org/a/b/", "other:b")])
def test_channel_key(spark, url, key):
    u = F.lit(url)
    assert value(spark, U.channel_key(u, U.detect_platform(u))) == key


def test_posted(spark):
    assert str(value(spark, T.parse_posted(F.lit("1704067200")))) == "2024-01-01 00:00:00"
    assert str(value(spark, T.parse_posted(F.lit("2024-01-01T00:00:00Z")))) == "2024-01-01 00:00:00"
    assert value(spark, T.parse_posted(F.lit("soon"))) is None


def test_norm_is_worked_out_once(spark):
    """The cost of a scaled vector grows with its length, not with the square of it."""
    from pyspark.sql import functions as F
    from reeltide.functions.scores import l2_normalize
    df = spark.range(300).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: (F.col("id") + i).cast("double")).alias("v"))
    start = time.time()
    got = df.select(F.max(F.abs(F.aggregate(l2_normalize("v"), F.lit(0.0), lambda s, x: s + x * x) - 1))).first()[0]
    assert got < 1e-9 and time.time() - start < 30
    odd = spark.createDataFrame([(None,), ([],), ([0.0, 0.0],), ([3.0, None, 4.0],)], "v array<double>").select(l2_normalize("v")).collect()
    assert [r[0] for r in odd] == [None, [], [0.0, 0.0], [3.0, None, 4.0]]
