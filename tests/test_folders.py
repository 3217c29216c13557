"""Tables that are folders of part files, read as streams."""
import shutil

from reeltide.plans import catalog
from reeltide.sources import readers as R

SF = "/root/testdata/sf0.01"
STREAMS = ["comment_stream", "annotate_stream", "author_state", "graph_event_log", "replay", "interval_join"]


def parted(spark, tmp_path):
    """The tables, conversations as a folder of files, the newest rows in the first."""
    for name in ("events", "conversations"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    (tmp_path / "conversations.parquet").unlink()
    c.selectExpr("*", "-conv_id AS o").repartitionByRange(4, "o").drop("o").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_streams_over_a_folder_give_the_rows_of_the_file(spark, tmp_path):
    folder = parted(spark, tmp_path)
    for name in STREAMS:
        q = catalog.queries()[name]
        got, want = [sorted(map(tuple, q(spark, d).collect()), key=repr) for d in (folder, SF)]
        assert got == want and got, name


def test_no_row_of_the_stored_files_is_late(spark, tmp_path):
    s = spark.range(40).selectExpr("timestamp_seconds(1700000000 + (39 - id) * 86400) AS timestamp_posted", "id", "CAST(id AS STRING) AS platform_comment_id")
    s.repartitionByRange(8, "id").write.parquet(str(tmp_path / "conversations.parquet"))
    from reeltide.streaming import streams as X
    c = X.comment_stream(R.stream_table(spark, str(tmp_path), "conversations", s.schema))
    X.append_to(c, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.schema(s.schema).parquet(str(tmp_path / "o")).count() == 40
