import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from tallyframe.functions import perceptual
from tallyframe.plans import queries as Q


def test_hashes_of_odd_vectors_are_those_of_the_sql(spark, tmp_path):
    """Frequencies that are equal but for rounding, and components that are no pixel."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=64).astype("f4").tolist()
    odd = [v[:k] + [x] + v[k + 1 :] for k, x in ((3, float("nan")), (4, float("inf")), (5, -float("inf")), (6, None), (7, 1e10), (8, -1e10))]
    even = [v[:32] + v[:32][::-1], v[:8] * 8, [(-1.0) ** (i + i // 8) / 2 for i in range(64)], [float(i // 8 == i % 8) for i in range(64)], [1.0] * 64, [0.0] * 64, *np.sign(rng.normal(size=(60, 64))).tolist()]
    rows = odd + even
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = sorted(con.sql(Q.SQL["perceptual_hashes"]).fetchall())
    assert sorted(map(tuple, Q.QUERIES["perceptual_hashes"](spark, str(tmp_path)).collect())) == want


def test_matrices_are_transformed_a_few_at_a_time(monkeypatch):
    """However many a batch has; the same hashes as one by one."""
    taken, seen, dct = [], [], perceptual._dct
    monkeypatch.setattr(perceptual.F, "pandas_udf", lambda kind: lambda f: taken.append(f) or (lambda column: None))
    monkeypatch.setattr(perceptual, "_dct", lambda rows, table, keep: seen.append(len(rows)) or dct(rows, table, keep))
    perceptual.phash(None)
    rows = pd.Series([list(m) for m in np.random.default_rng(0).integers(0, 256, (1300, 8, 8))])
    got = taken[0](rows)
    assert max(seen) <= 512 and sum(seen) == 2 * 1300
    assert got[::130].tolist() == [taken[0](rows[k : k + 1].reset_index(drop=True))[0] for k in range(0, 1300, 130)]
