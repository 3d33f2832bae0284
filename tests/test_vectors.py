import numpy as np

from groundspark.operators import vectors as V


def test_nearest_in_blocks(spark, monkeypatch):
    """Several blocks of either side, ties, vectors without length, of another size, and null."""
    monkeypatch.setattr(V, "QUERIES", 7)
    monkeypatch.setattr(V, "VECTORS", 20)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)]
    rows += [(100, [0.0] * 4), (101, rows[3][1]), (102, rows[3][1]), (103, [1.0, 2.0]), (104, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in V.similar(df.where("vec_id % 5 = 0 or vec_id in (103, 104)"), df, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.cosine, r.vec_id))

    def cos(x, y):
        size = np.linalg.norm(x) * np.linalg.norm(y) if len(x) == len(y) else 0
        return round(float(np.dot(x, y)) / size, 6) if size else 0.0

    asked = [(i, x) for i, x in rows if x is not None and (i % 5 == 0 or i == 103)]
    assert set(got) == {i for i, _ in asked}
    for i, x in asked:
        want = sorted((-cos(x, y), j) for j, y in rows if y is not None and j != i)[:4]
        assert [(c, j) for _, c, j in sorted(got[i])] == [(-c + 0.0, j) for c, j in want]
