"""Leader passes in rounds against the plain pass in order, whatever the blocks, rounds and partitions."""

import numpy as np
import pytest

from stratalens.operators import collections, geo, vectors


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def alike(a, b):
    return round(float(unit(a) @ unit(b)), 12)


def plain_clusters(rows, threshold, least):
    """rows of (group, id, seq, vector): leaders in order, members, centroids, and the move to the nearest centroid."""
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g and r[3] is not None and all(x is not None and np.isfinite(x) for x in r[3])), key=lambda r: (r[2], r[1]))
        heads = []
        for r in own:
            if all(alike(h, np.array(r[3])) < threshold for h in heads):
                heads.append(np.array(r[3]))

        def nearest(v, centres):
            best = max(range(len(centres)), key=lambda k: (alike(v, centres[k]), -k))
            return best if alike(v, centres[best]) >= threshold else None

        first = [nearest(np.array(r[3]), heads) for r in own]
        used = [k for k in range(len(heads)) if k in first]
        means = [np.mean([unit(np.array(r[3])) for r, k in zip(own, first, strict=True) if k == h], axis=0) for h in used]
        moved = [nearest(np.array(r[3]), means) for r in own]
        sizes = {k: moved.count(k) for k in range(len(means)) if moved.count(k) >= least}
        number = {k: n for n, k in enumerate(sorted(sizes, key=lambda k: (-sizes[k], k)))}
        out |= {r[1]: (g, number[k]) for r, k in zip(own, moved, strict=True) if k in number}
    return out


def vector_rows(n=240, d=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [("abc"[i % 7 % 3] if i % 11 else None, i, float(rng.integers(0, 50)), (centres[rng.integers(12)] + 0.35 * rng.normal(size=d)).tolist()) for i in range(n)]
    return [*rows, ("a", 900, 1.0, None), ("a", 901, 1.0, [None] * d), ("a", 902, 1.0, [0.0] * d), ("a", 903, 2.0, [float("nan")] * d), ("b", 904, 60.0, rows[5][3]), ("b", 905, 60.0, rows[5][3])]


@pytest.mark.parametrize(("block", "candidates", "parts"), [(4096, 512, 2), (10, 3, 5)])
def test_greedy_clusters_equal_the_plain_pass(spark, monkeypatch, block, candidates, parts):
    monkeypatch.setattr(collections, "CANDIDATES", candidates)
    monkeypatch.setattr(collections.leaders, "__defaults__", (block, candidates))
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "label string, id long, seq double, vector array<double>").repartition(parts)
    got = {r.id: (r.group, r.cluster) for r in collections.greedy_clusters(frame, group="label", threshold=0.8, least=2, block=block).collect()}
    want = plain_clusters(rows, 0.8, 2)
    assert got == want and len({*want.values()}) > 8
    assert collections.greedy_clusters(frame.limit(0), group="label").count() == 0


def plain_places(rows, radius):
    """rows of (id, seq, lat, lon, group): founders in order, members, means, and counts within the radius."""
    km, out = lambda a, b: round(float(geo.distance_km(a[0], a[1], b[0], b[1])), 9), []
    for g in {r[4] for r in rows if r[2] is not None and r[3] is not None}:
        points = [(r[2], r[3], r[1]) for r in rows if r[4] == g and r[2] is not None and r[3] is not None]
        spots = {}
        for a, o, s in points:
            spots[a, o] = min(spots.get((a, o), (True, 0.0)), (s is None, s or 0.0))
        heads = []
        for p in sorted(spots, key=lambda p: (spots[p], p)):
            if all(km(p, h) > radius for h in heads):
                heads.append(p)
        member = {}
        for a, o, _ in points:
            member.setdefault(min(range(len(heads)), key=lambda k: (km((a, o), heads[k]), k)), []).append((a, o))
        means = {k: (sum(p[0] for p in m) / len(m), sum(p[1] for p in m) / len(m)) for k, m in member.items()}
        size = {k: sum(km(p[:2], c) <= radius for p in points) for k, c in means.items()}
        for place, k in enumerate(sorted(size, key=lambda k: (-size[k], k))):
            out.append((g, place, round(means[k][0], 6), round(means[k][1], 6), size[k]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("few", "parts"), [(100_000, 2), (0, 5)])
def test_leader_places_equal_the_plain_pass(spark, monkeypatch, few, parts):
    monkeypatch.setattr(geo, "FEW_SPOTS", few)
    rng = np.random.default_rng(4)
    spots = [(float(rng.uniform(40, 43)), float(rng.uniform(5, 9))) for _ in range(90)] + [(float(rng.uniform(-2, 2)), float(x)) for x in rng.choice([179.6, -179.7, 179.9], 30)] + [(89.5 + float(rng.uniform(0, 0.5)), float(rng.uniform(-180, 180))) for _ in range(30)]
    spots += [(45.0, 0.0 + 0.4 * k) for k in range(12)]  # a chain in order
    rows = [(i, None if i % 17 == 0 else float(rng.integers(0, 60)), *spots[int(rng.integers(len(spots)))], ["x", "y", None][i % 3]) for i in range(500)]
    rows += [(600 + k, float(100 + k), 45.0, 20.0 + 0.4 * k, "z") for k in range(12)] + [(700, 1.0, None, 3.0, "x"), (701, 1.0, 3.0, None, "x"), (702, None, None, None, None)]
    frame = spark.createDataFrame(rows, "id long, seq double, gps_lat double, gps_lon double, country string").repartition(parts)
    got = geo.leader_places(frame, 50.0, group="country").collect()
    assert sorted(((r.group, r.place, round(r.lat, 6), round(r.lon, 6), r.members) for r in got), key=str) == plain_places(rows, 50.0)
    assert geo.leader_places(frame.limit(0), 50.0).count() == 0


@pytest.mark.parametrize(("pivots", "block"), [(128, 4096), (7, 5), (1, 50)])
def test_nearest_join_equals_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) + 3 * (i % 5)).tolist()) for i in range(160)]
    rows += [(500 + i, rows[i][1]) for i in range(6)] + [(600, None), (601, [None, 1.0, 1.0, 1.0]), (602, [float("inf")] * 4)]
    asked = [*rows[::7], (900, [100.0] * 4), (600, None)]
    frame = lambda x: spark.createDataFrame(x, "id long, vector array<double>")
    got = {}
    for r in sorted(vectors.nearest_join(frame(asked), frame(rows).repartition(3), 4, pivots).collect(), key=lambda r: (r.query, r.rank)):
        got.setdefault(r.query, []).append((r.distance, r.id))
    sound = [(i, np.array(v)) for i, v in rows if i < 600]
    want = {q: sorted((round(float(np.sqrt(((v - np.array(x)) ** 2).sum())), 9), i) for i, v in sound if i != q)[:4] for q, x in asked if x is not None and np.isfinite(x).all()}
    assert got == want
    assert vectors.nearest_join(frame(asked), frame([]), 4).count() == 0 and vectors.nearest_join(frame([]), frame(rows), 4).count() == 0
    few = vectors.nearest_join(frame(rows[:1]), frame(rows[:3]), 4).collect()
    assert len(few) == 2


def test_example_neighbours_in_blocks_of_targets(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "id long, vector array<double>")
    examples = spark.createDataFrame([(i, f"d{i}", i % 2 == 0, None) for i in range(40)], "id long, doc string, is_raw boolean, pair long")
    targets = v.where("id % 3 = 0").selectExpr("id", "vector", "id % 2 = 0 as is_raw", "cast(null as long) as pair")
    whole = sorted(map(tuple, vectors.example_neighbours(targets, examples, v, 3).collect()))
    monkeypatch.setattr(vectors, "TARGETS", 5)
    assert sorted(map(tuple, vectors.example_neighbours(targets, examples, v, 3).collect())) == whole and len(whole) == 42
