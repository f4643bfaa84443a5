import uuid

import numpy as np
import pytest

from tessella import store
from tessella.operators import retrieval as R
from tessella.operators import vector_index as V
from tessella.plans import model
from tessella.plans import retrieval as plans

SF = "/root/testdata/sf0.1"


def table(spark, vectors, first=0):
    rows = [(i + first, None if v is None else [float(x) for x in v], i % 7, "own") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell string")


def folder(spark):
    return f"{store.shared_dir(spark)}/index-{uuid.uuid4().hex}"


def asked(spark, vectors, ids=None):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors)], "query_id long, q array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    centres *= 3 / np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = centres[rng.integers(0, 40, 3_000)] + rng.normal(size=(3_000, 16)) * 0.15
    vectors[:1_000] = vectors[0]  # a third of all rows alike
    rows = table(spark, vectors).cache()
    return vectors, rows, V.build(rows, folder(spark))


def test_recall_on_the_given_table(spark):
    """Vectors without structure: recall holds because the probes follow what was measured."""
    exact = {(r.query_id, r.id): r.score for r in plans.PLANS.queries["vector_topk"](spark, SF).collect()}
    got = {(r.query_id, r.id): r.score for r in plans.PLANS.queries["vector_index_topk"](spark, SF).collect()}
    assert len(got) == len(exact) and len(set(got) & set(exact)) >= 0.9 * len(exact)
    assert all(abs(got[p] - exact[p]) < 2e-6 for p in set(got) & set(exact))
    index = model.vector_index(spark, SF)
    assert index.probes < len(index.centres)
    rows = index.rows(spark)
    assert rows.count() == rows.select("id").distinct().count() == model.read(spark, SF, "embeddings").count()


def test_clusters_are_pruned(spark, clustered):
    vectors, rows, index = clustered
    assert index.probes <= len(index.centres) / 4
    queries = asked(spark, vectors[1_000::50])
    exact = {(r.query_id, r.id) for r in R.dense_topk(rows, queries, 20).collect()}
    found = V.search(spark, index, queries, 20).collect()
    assert len({(r.query_id, r.id) for r in found} & exact) >= 0.9 * len(exact)
    assert {r["rank"] for r in found} == set(range(1, 21)) and len(found) == 40 * 20
    one = V.search(spark, index, asked(spark, vectors[2_000:2_001]), 20)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")
    chosen = index.cells_of(vectors[2_000:2_001])[0].tolist()
    assert index.rows(spark).where(index_cells(chosen)).count() < 0.6 * len(vectors)


def index_cells(cells):
    return f"cell in ({', '.join(map(str, cells))})"


def test_all_cells_give_the_exact_rows(spark, clustered):
    vectors, rows, index = clustered
    queries = asked(spark, vectors[::300])
    want = sorted((r.query_id, r["rank"], r.id) for r in R.dense_topk(rows, queries, 30).collect())
    got = V.search(spark, index, queries, 30, probes=len(index.centres)).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == want


def test_a_condition_comes_before_the_choice(spark, clustered):
    vectors, rows, index = clustered
    queries = asked(spark, vectors[1_000::500])
    got = V.search(spark, index, queries, 10, where=lambda row: row.label.isin(1, 3) & (row["cell"] == "own"), probes=len(index.centres))
    want = R.dense_topk(rows.where("label in (1, 3)"), queries, 10)
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == sorted((r.query_id, r["rank"], r.id) for r in want.collect())


def test_an_index_is_loaded_again(spark, clustered):
    vectors, _, index = clustered
    again = V.load(spark, index.path)
    assert again.probes == index.probes and (again.centres == index.centres).all() and again.schema == index.schema
    queries = asked(spark, vectors[1_500:1_502])
    assert V.search(spark, again, queries, 5).collect() == V.search(spark, index, queries, 5).collect()


def test_odd_rows_and_queries(spark):
    vectors = [[1, 0], None, [], [0, 1], [float("nan"), 1], [float("inf"), 1], [2, 0, 5], [1, 0], [3]]
    index = V.build(table(spark, vectors), folder(spark), cells=2)
    assert index.rows(spark).count() == 9
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0]), (2, None), (3, [0.0, 0.0, 1.0])], "query_id long, q array<double>")
    got = V.search(spark, index, queries, 20, probes=2).collect()
    by = {q: [(r.id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in range(4)}
    assert by[0][:3] == [(8, 3.0), (3, 2.0), (6, 2.0)] and {i for i, _ in by[0]} == {0, 2, 3, 6, 7, 8}
    assert by[1][:2] == [(8, 3.0), (6, 2.0)] and by[2] == [] and by[3][0] == (6, 5.0)


def test_empty_tables(spark):
    nothing = V.build(table(spark, [[1.0]]).where("false"), folder(spark))
    assert len(nothing.centres) == 0 and V.search(spark, nothing, asked(spark, [[1.0]]), 3).count() == 0
    some = V.build(table(spark, [[1.0], [2.0]]), folder(spark))
    assert V.search(spark, some, asked(spark, [[1.0]]).where("false"), 3).count() == 0


def test_copies_are_one_cell_and_ties_go_by_id(spark):
    index = V.build(table(spark, [[1.0, 2.0]] * 500), folder(spark))
    assert len(index.centres) == 1
    assert [r.id for r in V.search(spark, index, asked(spark, [[1.0, 1.0]]), 4).orderBy("rank").collect()] == [0, 1, 2, 3]
