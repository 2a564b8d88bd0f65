import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolk import schema
from kinfolk.functions.ranking import with_position
from kinfolk.operators import components as CC
from kinfolk.operators.persons import best_thumbnails, person_ranks, persons
from kinfolk.operators.similarity import similar_pairs, split_by_dimension
from kinfolk.plans.run import group_faces, number_faces
from tests.conftest import rows


def faces(spark, vectors, **more):
    data = [
        (i, more.get("paths", {}).get(i, f"/p/{i}.jpg"), 0, [0.0] * 4, v, more.get("scores", {}).get(i, 0.5), more.get("thumbs", {}).get(i, ""))
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(data, schema.FACES)


def pair_set(spark, vectors, t, method):
    return {(r.src, r.dst) for r in similar_pairs(faces(spark, vectors), t, method).collect()}


@pytest.mark.parametrize("method", ["blocked", "expr"])
@pytest.mark.parametrize(
    ("vectors", "t", "want"),
    [
        ([[1.0, 0.0], [0.8, 0.6], [0.28, 0.96]], 0.5, {(0, 1), (1, 2)}),  # chain
        ([[1.0, 0.0], [3.0, 4.0]], 0.6 - 1e-12, {(0, 1)}),
        ([[1.0, 0.0], [3.0, 4.0]], 0.6 + 1e-12, set()),
        ([[0.0, 0.0], [1.0, 0.0]], 0.5, set()),  # zero vector
        ([[0.0, 0.0], [1.0, 0.0]], 0.0, {(0, 1)}),
        ([[float("nan"), 0.0], [1.0, 0.0]], 0.5, set()),
        ([[1.0, 0.0], [-1.0, 0.0]], 0.5, set()),
        ([[10.0, 0.0], [0.1, 0.0]], 0.5, {(0, 1)}),
        ([[1.0, 0.0]], 2.0, set()),
        ([], 0.5, set()),
    ],
)
def test_pairs(spark, vectors, t, want, method):
    assert pair_set(spark, vectors, t, method) == want


def test_blocks_equal_expressions_and_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 5))
    f = faces(spark, x.tolist())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= 0.7}
    assert {(r.src, r.dst) for r in similar_pairs(f, 0.7, block=16).collect()} == want
    assert {(r.src, r.dst) for r in similar_pairs(f, 0.7, "expr").collect()} == want


def test_wrong_dimensions_are_errors(spark):
    good, bad = split_by_dimension(faces(spark, [[1.0, 0.0], [1.0], [0.0, 1.0]]))
    assert [r.face_id for r in good.orderBy("face_id").collect()] == [0, 2]
    assert [r.path for r in bad.collect()] == ["/p/1.jpg"]


def brute(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return dict(enumerate(label))


@pytest.mark.parametrize("find", [CC.star_labels, CC.contracted_labels])
@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, find, seed):
    r = random.Random(seed)
    n = 80
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(50)] + [(i, i + 1) for i in range(60, 79)]
    found = {x.id: x.component_id for x in find(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    want = brute(n, edges)
    assert all(found.get(i, i) == want[i] for i in range(n))


def test_components_keep_single_vertices(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "face_id bigint")
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert rows(CC.components(v, none)) == [(1, 1), (2, 2), (3, 3)]
    assert rows(CC.star_labels(none)) == [] and rows(CC.contracted_labels(none)) == []
    assert rows(CC.components(v, spark.createDataFrame([(3, 2), (2, 3), (1, 1)], none.schema))) == [(1, 1), (2, 2), (3, 2)]


def test_ranks_break_ties_by_component(spark):
    c = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4), (6, 4)], "face_id bigint, component_id bigint")
    assert rows(person_ranks(c)) == [(1, 4, 3), (2, 0, 2), (3, 2, 2)]


def test_positions_in_ranges(spark, monkeypatch):
    from kinfolk.functions import ranking

    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 10)
    monkeypatch.setattr(ranking, "RANGE_ROWS", 20)
    df = spark.range(137).withColumn("k", F.col("id") * 7919 % 137)
    assert rows(with_position(df, "n", F.asc("k")).select("n", "k")) == [(k + 1, k) for k in range(137)]


@pytest.mark.parametrize(
    ("scores", "thumbs", "want"),
    [
        ({0: 0.9, 1: 0.8, 2: 0.8}, {0: "", 1: "a", 2: "b"}, "a"),
        ({0: 0.0, 1: 0.0, 2: 0.0}, {0: "a", 1: "b", 2: "c"}, ""),
        ({0: 0.1, 1: 0.7, 2: 0.2}, {0: "a", 1: "b", 2: "c"}, "b"),
    ],
)
def test_best_thumbnail(spark, scores, thumbs, want):
    f = faces(spark, [[1.0]] * 3, scores=scores, thumbs=thumbs).withColumn("component_id", F.lit(0))
    assert [r.thumbnail for r in best_thumbnails(f).collect()] == ([want] if want else [])


def test_photos_are_distinct_by_path(spark):
    f = faces(spark, [[1.0, 0.0]] * 3, paths={0: "/b/x.jpg", 1: "/a/x.jpg", 2: "/b/x.jpg"})
    g = group_faces(f)
    (p,) = g.persons.collect()
    assert (p.photo_count, p.face_count, p.photos) == (2, 3, ["Person_1/x.jpg", "Person_1/x.jpg"])


def test_empty_tables_keep_their_schema(spark):
    g = group_faces(faces(spark, []))
    assert g.persons.columns == ["id", "component_id", "photo_count", "face_count", "thumbnail", "photos"]
    assert g.persons.count() == g.edges.count() == g.components.count() == 0


def test_raising_the_threshold_only_splits(spark):
    rng = np.random.default_rng(3)
    f = faces(spark, rng.normal(size=(60, 3)).tolist())
    low = {r.face_id: r.component_id for r in group_faces(f, 0.7).components.collect()}
    high = {r.face_id: r.component_id for r in group_faces(f, 0.9).components.collect()}
    for i in range(60):
        assert low[i] == low[high[i]]
    p = group_faces(f, 0.9).persons.agg(F.sum("face_count"), F.count("*")).first()
    assert p[0] == 60 and p[1] == len(set(high.values()))
    assert math.isclose(group_faces(f, 1.5).persons.count(), 60)


def test_faces_are_numbered_in_walk_order(spark):
    f = spark.createDataFrame([("/r/a.jpg", 0), ("/r/a/b.jpg", 1), ("/r/a/b.jpg", 0)], "file_path string, face_idx int")
    assert rows(number_faces(f).select("face_id", "file_path", "face_idx")) == [(1, "/r/a/b.jpg", 0), (2, "/r/a/b.jpg", 1), (3, "/r/a.jpg", 0)]


def test_persons_without_components(spark):
    f = faces(spark, [[1.0]])
    assert persons(f, spark.createDataFrame([], schema.COMPONENTS)).count() == 0
