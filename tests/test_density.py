"""Clustering against a brute-force model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyground.operators import density, hotspots
from tallyground.operators.components import connected_components
from tallyground.plans.hotspots import hotspots as hotspot_plan
from tallyground.settings import HotspotSettings

EPS = 0.0001


def distances(lat, lon):
    phi, lam = np.radians(lat), np.radians(lon)
    h = (np.sin((phi[:, None] - phi) / 2) ** 2
         + np.cos(phi[:, None]) * np.cos(phi) * np.sin((lam[:, None] - lam) / 2) ** 2)
    return 2 * np.arcsin(np.minimum(1, np.sqrt(h)))


def brute(lat, lon, eps, min_samples):
    near = distances(np.array(lat), np.array(lon)) <= eps
    core, labels, cluster = near.sum(1) >= min_samples, -np.ones(len(lat), int), 0
    for i in range(len(lat)):
        if core[i] and labels[i] == -1:
            labels[i], todo = cluster, [i]
            while todo:
                p = todo.pop()
                for q in np.where(near[p] & (labels == -1))[0]:
                    labels[q] = cluster
                    if core[q]:
                        todo.append(q)
            cluster += 1
    return labels


def check(spark, lat, lon, eps=EPS, min_samples=20, parts=None):
    rows = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))],
                                 "id bigint, lat double, lon double")
    if parts:
        rows = rows.repartition(parts)
    got = density.dbscan_clusters(rows, "lat", "lon", "id", None, eps, min_samples).collect()
    labels = np.full(len(lat), -9)
    for r in got:
        labels[r.id] = r.cluster
    expected = brute(lat, lon, eps, min_samples)
    assert (labels == expected).all()
    return expected


@pytest.mark.parametrize("centre", [(42.3, -71.1), (0.0, 0.0), (75.0, 179.999), (-89.995, 30.0)])
def test_matches_brute_force(spark, centre):
    rng = np.random.default_rng(3)
    n, spread = 600, 0.02
    lat = np.clip(centre[0] + rng.normal(0, spread, n), -90, 90)
    lon = centre[1] + rng.normal(0, spread, n) / max(np.cos(np.radians(centre[0])), 0.01)
    lon = (lon + 180) % 360 - 180
    expected = check(spark, lat, lon, min_samples=12, parts=5)
    assert expected.max() >= 0


def test_crowded_cell_beside_another(spark):
    # Two dense groups whose nearest points are just within, then just beyond eps of each other.
    rng = np.random.default_rng(5)
    step = np.degrees(EPS)
    # Degrees, so that the gap is measured along the meridian.
    for gap, clusters in ((0.999, 1), (1.001, 2)):
        lat = np.concatenate([42 + rng.uniform(-0.6, 0, 300) * step, 42 + (gap + rng.uniform(0, 0.6, 300)) * step])
        lat[0], lat[300] = 42.0, 42.0 + gap * step
        lon = np.full(600, -71.0)
        assert check(spark, lat, lon).max() + 1 == clusters


def test_nineteen_and_twenty_at_one_place(spark):
    lat = [42.0] * 19 + [43.0] * 20
    assert sorted(set(check(spark, lat, [-71.0] * 39))) == [-1, 0]


def test_border_point_takes_the_smaller_cluster(spark):
    step = np.degrees(EPS)
    lat = [42.0] * 20 + [42 + 1.9 * step] * 20 + [42 + 0.95 * step]
    labels = check(spark, lat, [-71.0] * 41, min_samples=21)
    assert labels[40] == 0


def test_types_are_clustered_apart(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], 42.0, -71.0) for i in range(39)],
                                 "id bigint, kind string, lat double, lon double")
    got = density.dbscan_clusters(rows, "lat", "lon", "id", "kind", EPS, 20).groupBy("kind", "cluster").count().collect()
    assert {(r.kind, r.cluster): r["count"] for r in got} == {("a", 0): 20, ("b", -1): 19}


def test_eps_is_checked(spark):
    with pytest.raises(ValueError):
        density.dbscan_clusters(spark.range(1).selectExpr("id", "0D lat", "0D lon"), "lat", "lon", "id", eps=2.0)


def test_components_of_chain_star_and_pair(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    pair = [(201, 200)]
    got = {r.u: r.root for r in connected_components(
        spark.createDataFrame(chain + star + pair, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_hotspot_plan_and_reasons(spark):
    day = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 40 as int))"
    rows = spark.range(400).selectExpr(
        "id", "CASE WHEN id < 200 THEN 'dense' WHEN id < 380 THEN 'far' WHEN id < 399 THEN 'short' ELSE 'bad' END AS kind",
        "CASE WHEN id < 200 THEN 42.0D WHEN id < 380 THEN CAST(id AS DOUBLE) / 10 WHEN id < 399 THEN 42.0D END AS lat",
        "-71.0D AS lon", f"CASE WHEN id < 380 THEN {day} ELSE timestamp_ntz'2024-01-01' END AS ts")
    result = hotspot_plan(rows, "kind", "ts", "lat", "lon", "id", HotspotSettings(min_samples=10))
    assert {r.kind: r.reason for r in result.status.collect()} == {
        "dense": None, "far": "every row is noise", "short": "the largest cluster has too few days",
        "bad": "no row has a usable position"}
    forecast = result.forecast.collect()
    assert {r.kind for r in forecast} == {"dense"} and len(forecast) == 40 + 30
    assert result.counts.filter("kind = 'dense'").first()["count"] == 200


def test_rank_ties_go_by_id(spark):
    counts = spark.createDataFrame([("a", 1, 5), ("a", 0, 5), ("a", 2, 9)], "kind string, cluster_id bigint, count bigint")
    ranks = {r.cluster_id: r.cluster_rank for r in hotspots.cluster_rank(counts, "kind").collect()}
    assert ranks == {2: 1, 0: 2, 1: 3}
    assert hotspots.largest_cluster(counts, "kind").first().cluster_id == 2
    assert hotspots.top_clusters(counts, "kind", 2).filter(F.col("cluster_id") == 1).isEmpty()


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (240, 2))]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    expected = {n: find(n) for n in range(300) if find(n) != n}
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == expected
