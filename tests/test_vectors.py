import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecrel.functions import quantize as qz
from vecrel.functions import vectors as vf
from vecrel.functions.pca import PCA
from vecrel.operators import hnsw, knn


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_known_values(spark):
    a, b = vf.literal([1, 0, 0]), vf.literal([0, 1, 0])
    assert value(spark, vf.l2(a, b)) == pytest.approx(math.sqrt(2))
    assert value(spark, vf.inner_product(vf.literal([1, 2, 3]), vf.literal([4, 5, 6]))) == 32
    assert value(spark, vf.norm(vf.literal([3, 4]))) == 5
    assert value(spark, vf.normalize(vf.literal([3, 4]))) == pytest.approx([0.6, 0.8])
    assert value(spark, vf.cosine(a, vf.literal([-2, 0, 0]))) == pytest.approx(2.0)
    assert value(spark, vf.cosine(a, b)) == pytest.approx(1.0)


def test_zero_vectors(spark):
    zero, one = vf.literal([0, 0]), vf.literal([1, 0])
    assert value(spark, vf.cosine(zero, one)) == 1.0
    assert value(spark, vf.normalize(zero)) == [0, 0]
    with pytest.raises(Exception, match="zero vector"):
        value(spark, vf.cosine(zero, one, strict=True))


def test_errors(spark):
    with pytest.raises(Exception, match="dimension mismatch"):
        value(spark, vf.l2(vf.literal([1]), vf.literal([1, 2])))
    with pytest.raises(ValueError):
        vf.literal([math.nan])
    with pytest.raises(Exception, match="bad vector literal"):
        value(spark, vf.parse(F.lit("1, 2")))
    with pytest.raises(ValueError):
        knn.top(spark.range(1), F.lit(1.0), -1, "id")


def test_format(spark):
    assert value(spark, vf.format_vector(vf.literal([1, 2.5, 3.75]))) == "[1,2.5,3.75]"


def test_quantizer(spark):
    assert qz.scale_grid(0.5, 1.5, 5) == [0.5, 0.75, 1.0, 1.25, 1.5] and qz.scale_grid(0.5, 1.5, 1) == [1.0]
    assert value(spark, vf.pack_levels(F.array(*[F.lit(i) for i in (0, 1, 2, 3) * 2]), 2)) == bytes([0b11100100] * 2)
    v, p = [0.1, 0.5, 0.9, -0.3], qz.Params.preset(8)
    q = value(spark, qz.quantize(vf.literal(v), p))
    back = value(spark, qz.reconstructed(qz.quantize(vf.literal(v), p), p))
    assert q.levels[3] == 0 and np.allclose(back[:3], v[:3], atol=0.01)


def test_binary_words(spark):
    v = [1.0 if i % 3 == 0 else -1.0 for i in range(70)]
    w = [-x for x in v]
    at = [0.0] * 70
    assert value(spark, qz.hamming(qz.binary_words(vf.literal(v), at), qz.binary_words(vf.literal(w), at))) == 70


def test_line_and_ties(spark):
    line = spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(10)], "vec_id long, embedding array<float>")
    assert {r.vec_id for r in knn.knn(line, [5.0, 0.0, 0.0], 3).collect()} == {4, 5, 6}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in knn.knn(same, [1.0, 2.0], 10).collect()] == list(range(10))


def test_graph_recall():
    rng = np.random.default_rng(5)
    data = rng.uniform(-1, 1, (600, 16)).astype(np.float32)
    graph = hnsw.in_memory(data)
    hit = 0
    for q, found in zip(data[:30], hnsw.neighbours(graph, data[:30], 10), strict=True):
        hit += len({*np.argsort(((data - q) ** 2).sum(1))[:10].tolist()} & set(found))
    assert hit / 300 >= 0.9


def test_index_saves_and_loads(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), float(i % 7)]) for i in range(60)], "vec_id long, embedding array<float>")
    index = hnsw.Index.build(rows, hnsw.Params(shard_rows=30))
    queries = spark.createDataFrame([(0, [10.0, 3.0])], "query_id long, query array<float>")
    before = [tuple(r) for r in index.search(queries, 5).collect()]
    index.save(str(tmp_path / "i"))
    again = hnsw.Index.load(spark, str(tmp_path / "i"), 2)
    assert [tuple(r) for r in again.search(queries, 5).collect()] == before and again.params == index.params
    assert again.search(queries, 1000).count() == 60 and again.search(queries, 0).count() == 0
    with pytest.raises(ValueError, match="dimension mismatch"):
        hnsw.Index.load(spark, str(tmp_path / "i"), 3)


def plain_distance(metric, q, v):
    """Summed one by one in doubles."""
    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    if metric == "l2":
        d = [x - y for x, y in zip(v, q)]
        return math.sqrt(dot(d, d))
    if metric == "ip":
        return -dot(v, q)
    size = math.sqrt(dot(v, v)) * math.sqrt(dot(q, q))
    return 1.0 if size == 0 else 1 - dot(v, q) / size


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_joined_search(spark, metric):
    """Against every pair: ties, repeated and null vectors, zero vectors, far and close ones, queries in blocks, hot copies."""
    rng = np.random.default_rng(5)
    vectors = [*rng.normal(size=(300, 6)), *np.repeat(rng.normal(size=(1, 6)), 200, 0), np.zeros(6), *(1e4 + rng.normal(size=(40, 6)) * 1e-6)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (900, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = df.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = {}
    for i, q in rows[::9]:
        near = sorted((plain_distance(metric, q, v), j) for j, v in rows)[:7]
        want |= {(i, at + 1): (j, d) for at, (d, j) in enumerate(near)}
    for size in (knn.QUERY_BYTES, 6 * 8 * 20):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in knn.knn_join(asked, df, 7, metric, query_bytes=size).collect()}
        assert got == want
    assert knn.knn_join(asked, df, 0, metric).count() == knn.knn_join(asked.where(F.lit(False)), df, 3, metric).count() == knn.knn_join(asked, df.where(F.lit(False)), 3, metric).count() == 0
    assert knn.knn_join(asked, df.limit(3), 7, metric).groupBy("query_id").count().where("count > 3").count() == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        knn.knn_join(asked, spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), 2, metric).collect()


def test_thresholds(spark):
    """Medians against the sorted values: odd and even counts, one hot value, null and infinite components."""
    rng = random.Random(3)
    for n in (1, 2, 501, 700):
        rows = [[rng.gauss(0, 1), 5.0, rng.choice([0.0, 0.0, 1.0, 1e6]), rng.choice([None, 1.0, 2.0]), rng.choice([float("inf"), float("-inf"), 1.5])] for _ in range(n)]
        rows[0][3] = 1.0
        df = spark.createDataFrame([(r,) for r in rows], "embedding array<double>").repartition(4)
        want = df.select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(F.median("v").alias("m")).collect()
        got = {r.pos: r.threshold for r in qz.thresholds(df).collect()}
        assert len(got) == 5 and all(got[r.pos] == pytest.approx(r.m, nan_ok=True) for r in want)
    with pytest.raises(ValueError, match="no vectors"):
        qz.thresholds(df.where(F.lit(False)))
    with pytest.raises(ValueError, match="dimension mismatch"):
        qz.thresholds(df.unionByName(spark.createDataFrame([([1.0],)], "embedding array<double>")))


def test_pca(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] @ rng.normal(size=(6, 6)) + 7).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = PCA.train(df, 3)
    centred = x.astype(np.float64) - x.astype(np.float64).mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(found.variances, (s**2 / 299)[:3], rtol=1e-9)
    assert abs(found.explained - (s**2)[:3].sum() / (s**2).sum()) < 1e-9
    vt *= np.where(np.take_along_axis(vt, np.abs(vt).argmax(1)[:, None], 1) < 0, -1, 1)
    got = {r.vec_id: r.p for r in df.select("vec_id", found.project("embedding").alias("p")).collect()}
    assert got.pop(300) is None
    np.testing.assert_allclose([got[i] for i in range(300)], centred @ vt[:3].T, atol=1e-6)
    for bad, k, words in ((df, 7, "1 to 6"), (df.where("vec_id = 0"), 1, "two vectors"), (df.unionByName(spark.createDataFrame([(9, [1.0])], df.schema)), 1, "dimension mismatch")):
        with pytest.raises(ValueError, match=words):
            PCA.train(bad, k)
