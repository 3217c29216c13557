"""Vectors of single precision are scaled in single precision, as the SQL does."""
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from oracle_check import compare
from reeltide.plans import catalog


def test_vector_hash_at_the_border_of_two_numbers(spark, tmp_path):
    x = np.arange(1, 1000, dtype=np.float32) / np.float32(1000)
    odd = x[np.floor(x * np.float32(1000)) != np.floor(x.astype(np.float64) * 1000)]
    assert len(odd)
    vectors = [[float(v), -float(v)] for v in odd]
    t = pa.table({"vec_id": pa.array(range(len(odd)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(odd), pa.int32())})
    pq.write_table(t, tmp_path / "embeddings.parquet")
    assert compare(spark, str(tmp_path), "vector_hash", catalog.queries()["vector_hash"], catalog.oracle_sql()["vector_hash"])[0] == "ok"
