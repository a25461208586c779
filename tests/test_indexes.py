"""The inverted index and the vector collection against scans of everything."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from scholarspark.operators import retrieval, vectors
from scholarspark.operators.inverted import InvertedIndex

from .conftest import DATA

DOC = "doc_id long, text string"


def corpus(rng, n, start=0):
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    return [(start + 3 * i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(n)]


def scanned(spark, rows, query, k):
    got = retrieval.bm25(spark.createDataFrame(rows, DOC), query).select("doc_id", F.round("score", 6).alias("score"))
    return [tuple(r) for r in got.orderBy(F.desc("score"), "doc_id").limit(k).collect()]


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(got, want, strict=True))


def test_index_equals_scan_through_its_life(spark, tmp_path):
    rng = random.Random(11)
    index = InvertedIndex(spark, str(tmp_path / "i"), 4, 16)
    assert index.search("w1").collect() == []
    world = dict(corpus(rng, 300)) | {901: None, 902: "", 904: "!?", -7: "w3 rare W3"}
    index.add(spark.createDataFrame(list(world.items()), DOC))
    more = dict(corpus(rng, 120, 1)) | {0: "w59 w58 changed", 3: "rare rare"}
    asked = ("w0 w0 w17 unknown", "rare w59 w3")

    def check():
        for q in asked:
            same([tuple(r) for r in index.search(q, 7, first=2).collect()], scanned(spark, list(world.items()), q, 7))

    check()
    index.add(spark.createDataFrame([*more.items(), (None, "w0")], DOC))
    world |= more
    check()
    gone = [6, -7, 901, 4, 12_345]
    index.remove(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    index.remove(spark.createDataFrame([(6,)], "doc_id long"))  # dead already
    for i in gone:
        world.pop(i, None)
    check()
    older = index.table.version()
    index.merge()
    assert index.table.read().select("segment").distinct().count() == 1 and index.table.read(older).select("segment").distinct().count() > 1
    check()
    index.add(spark.createDataFrame([(6, "w17 back"), (6, "w17 back")], DOC))  # a repeated id is one document
    world[6] = "w17 back"
    check()
    assert index.search("unknown words only").collect() == [] and index.search(" ?!").collect() == []


def test_blocks_are_skipped(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=30)) + (" needle" * (1 + i % 3) if i % 97 == 0 else "")) for i in range(3000)]
    index = InvertedIndex(spark, str(tmp_path / "i"), 4, 32)
    index.add(spark.createDataFrame(rows, DOC))
    same([tuple(r) for r in index.search("needle a", 5, first=4).collect()], scanned(spark, rows, "needle a", 5))
    assert 0 < index.blocks_read < index.blocks_found / 2
    bounds = index.table.read().where("term = 'needle'").select("n", "max_tf", "min_len")
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "tfs" not in plan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(term), EqualTo(term,needle)]" in plan


def test_index_of_nothing(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), 2)
    index.add(spark.createDataFrame([], DOC))
    index.remove(spark.createDataFrame([(1,)], "doc_id long"))
    index.merge()
    assert index.search("a").collect() == []
    index.add(spark.createDataFrame([(1, "a")], DOC))
    assert [r.id for r in index.search("a").collect()] == [1]


def test_index_of_whole_texts(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    index = InvertedIndex(spark, str(tmp_path / "i"), 8)
    index.add(docs)
    rows = [tuple(r) for r in docs.collect()]
    same([tuple(r) for r in index.search("the tion and", 20).collect()], scanned(spark, rows, "the tion and", 20))


# vectors ----------------------------------------------------------------------------------------------------------


def nearest(rows, q, n):
    q = np.asarray(q, float)
    out = []
    for i, v in rows:
        if i is None or v is None or len(v) != len(q) or not np.isfinite(np.array(v, float)).all() or not np.linalg.norm(v):
            continue
        out.append((i, max(0.0, float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)))))
    return sorted(out, key=lambda r: (-round(r[1], 9), r[0]))[:n]


def test_collection_equals_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in middles[i % 12] * rng.uniform(0.5, 3) + 0.15 * rng.normal(size=8)]) for i in range(900)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [1.0, 2.0]), (1004, [math.inf] * 8), (None, [1.0] * 8), (1005, rows[0][1]), (1006, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("odd", F.col("vec_id") % 2 == 1)
    made = vectors.VectorCollection.write(df, str(tmp_path / "c"))
    for q in ([float(x) for x in middles[4]], rows[0][1], [float(x) for x in -middles[0]]):
        for k in (1, 50):
            got = [tuple(r) for r in made.search(q, k).collect()]
            want = nearest(rows, q, min(max(1, 2 * k), 20))
            assert len(got) == len(want) and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, want, strict=True))
            assert [i for i, s in got if s > 0] == [i for i, s in want if s > 0]
    got = [tuple(r) for r in made.search(rows[0][1], 3, where=F.col("odd")).collect()]
    assert [i for i, _ in got] == [i for i, _ in nearest([r for r in rows if r[0] is not None and r[0] % 2], rows[0][1], 6)]
    # few cells are read, and the plan names the folders of those alone
    made.search(rows[0][1], 3, first=1)
    assert 0 < made.cells_read < len(made.bounds(rows[0][1])) / 2
    plan = made.cell_rows([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    for q in ([], [0.0] * 8, [math.nan] * 8):
        assert made.search(q, 3).count() == 0


def test_collection_of_nothing(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None)], [(1, [0.0, 0.0])])):
        made = vectors.VectorCollection.write(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), str(tmp_path / f"c{k}"))
        assert made.search([1.0, 0.0], 3).count() == 0


def test_bounds_hold(spark):
    """No cell has a vector nearer than its bound says."""
    df = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    made = vectors.VectorCollection.write(df)
    q = df.where("vec_id = 9").first().embedding
    best = {c: b for b, c, _ in made.bounds(q)}
    for r in made.cell_rows(list(best)).select("cell", "embedding").collect():
        v = np.asarray(r.embedding, float)
        assert v @ np.asarray(q) / np.linalg.norm(v) / np.linalg.norm(q) <= best[r.cell] + 1e-9
