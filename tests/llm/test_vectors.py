import math

import numpy as np
import pytest

from lexweave.llm import density_peaks, nearest, unit_vectors

SCHEMA = "row_id bigint, word string, embedding array<float>, cos double"
RNG = np.random.default_rng(3)


def near(v, cos):
    """A unit vector at this cosine to v."""
    v = v / np.linalg.norm(v)
    r = RNG.standard_normal(128)
    r -= (r @ v) * v
    return cos * v + math.sqrt(1 - cos * cos) * r / np.linalg.norm(r)


def table(spark, rows):
    return spark.createDataFrame([(i, f"w{i}", None if v is None else [None if x is None else float(x) for x in v], 0.0) for i, v in rows], SCHEMA)


def planted(groups, size, cos, loose=300):
    rows = [(i, RNG.standard_normal(128) * 10.0 ** RNG.integers(-3, 4)) for i in range(loose)]
    for g in range(groups):
        c = RNG.standard_normal(128)
        rows += [(10_000 + 100 * g + j, near(c, cos) * (1 + j)) for j in range(size)]
    return rows


BAD = [(90_001, None), (90_002, []), (90_003, [1.0] * 127), (90_004, [1.0] * 129), (90_005, [0.0] * 128), (90_006, [float("nan")] + [1.0] * 127), (90_007, [float("inf")] + [1.0] * 127), (90_008, [None] + [1.0] * 127), (None, [1.0] * 128)]


def brute(rows, k, floor):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    top = {}
    for a in range(len(ids)):
        best = sorted((-round(c, 9), ids[b]) for b, c in enumerate(cos[a]) if b != a and c >= floor)[:k]
        top[ids[a]] = {b for _, b in best}
    return {(int(a), int(b)) for a in top for b in top[a] if a < b and a in top[b]}


@pytest.mark.parametrize("options", [{}, {"cell_rows": 64, "leaf_rows": 8, "sample": 200}])
def test_mutual_neighbours(spark, options):
    rows = planted(40, 8, 0.99)
    want = brute(rows, 5, 0.96)
    df = table(spark, rows + rows[-20:] + BAD).repartition(4)
    got = {(r.row_a, r.row_b) for r in nearest.mutual_neighbours(df, **options).collect()}
    assert len(want) > 300 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def nearest_by_force(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return {int(a): {int(ids[b]) for b in [b for b in np.lexsort((ids, -(x @ x[i]).round(12))) if b != i][:k]} for i, a in enumerate(ids) if a % asked == 0}


@pytest.mark.parametrize(("options", "least"), [({}, 0.99), ({"cell_rows": 128, "leaf_rows": 16, "sample": 300}, 0.9), ({"cell_rows": 128, "leaf_rows": 16, "sample": 300, "miss": 0}, 1.0)])
def test_recall_without_a_floor(spark, options, least):
    rows = planted(30, 8, 0.9, 1200)
    want = nearest_by_force(rows, 20, 5)
    got = {}
    for r in nearest.nearest_rows(table(spark, rows + BAD), **options).collect():
        got.setdefault(r.row_id, set()).add(r.other)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len(got[i] & want[i]) for i in want)
    assert hits >= least * 5 * len(want)


def test_what_rounding_leaves_in_doubt_is_computed_again(spark):
    c = RNG.standard_normal(128)
    rows = [(0, c)] + [(i, near(c, 0.96 + (i - 20) * 1e-6)) for i in range(1, 40)]
    cos = {i: float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)) for i, v in rows[1:]}
    f32 = {i: v.astype(np.float32).astype(np.float64) for i, v in rows}
    cos = {i: float(f32[i] @ f32[0] / np.linalg.norm(f32[i]) / np.linalg.norm(f32[0])) for i in cos}
    got = {r.other for r in nearest.nearest_rows(table(spark, rows), k=50, min_similarity=0.96).collect() if r.row_id == 0}
    assert got == {i for i, x in cos.items() if x >= 0.96} and 15 < len(got) < 25


def test_many_versions_of_a_row_in_a_dense_region(spark):
    c = RNG.standard_normal(128)
    rows = [(i, near(c, 0.95 + i * 1e-4)) for i in range(1, 400)] + [(1000, near(c, 0.9999)) for _ in range(300)] + [(0, c)]
    got = {r.other for r in nearest.nearest_rows(table(spark, rows)).collect() if r.row_id == 0}
    assert got == {1000, 399, 398, 397, 396}


def test_versions_without_a_direction_do_no_harm(spark):
    c = RNG.standard_normal(128)
    rows = [(i, near(c, 0.96)) for i in range(1, 6)] + [(0, c)] + [(i, v) for i in range(6) for v in ([0.0] * 128, [float("nan")] * 128, [None] * 128)]
    assert nearest.mutual_neighbours(table(spark, rows)).count() >= 0
    rows = [(i, near(c, math.sqrt(0.65))) for i in range(1, 6)] + [(0, c)] + [(i, v) for i in range(6) for v in ([0.0] * 128, [float("nan")] * 128)]
    assert density_peaks.clusters(table(spark, rows), smallest=2).filter("row_id = 0").count() == 1


def test_copies_go_by_id(spark):
    v = RNG.standard_normal(128)
    df = table(spark, [(i, v) for i in range(50)] + [(100, near(v, 0.97)), (101, RNG.standard_normal(128))])
    got = {(r.row_a, r.row_b) for r in nearest.mutual_neighbours(df).collect()}
    top = {i: {j for j in range(7) if j != i} and set([j for j in range(50) if j != i][:5]) for i in range(50)}
    assert got == {(a, b) for a in top for b in top[a] if a < b and a in top[b]}


def test_no_vectors(spark):
    assert nearest.mutual_neighbours(table(spark, [])).count() == 0 and nearest.mutual_neighbours(table(spark, BAD)).count() == 0
    assert density_peaks.clusters(table(spark, [])).count() == 0 and density_peaks.clusters(table(spark, BAD)).count() == 0


def test_chi_square():
    assert math.isclose(nearest.chi2_tail(3.841459, 1), 0.05, rel_tol=1e-5) and math.isclose(nearest.quantiles(10, 0.01)[10], 23.209251, rel_tol=1e-5)


def groups(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r.cluster, set()).add(r.row_id)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("options", [{}, {"block_rows": 20, "sample": 100}])
def test_clusters(spark, options):
    rows = planted(30, 9, 0.9)
    rows += [(20_000 + 10 * g + j, near(c, 0.92)) for g in range(5) for c in [RNG.standard_normal(128)] for j in range(4)]  # too small
    df = table(spark, rows + rows[:30] + BAD).repartition(4)
    labels = density_peaks.clusters(df, **options)
    want = {frozenset(10_000 + 100 * g + j for j in range(9)) for g in range(30)}
    got = groups(labels)
    assert len(got & want) >= 29 and not {x for g in got for x in g if x >= 20_000}
    if not options:
        pairs = density_peaks.pairs(labels)
        assert pairs.count() == sum(len(g) * (len(g) - 1) // 2 for g in got) and pairs.filter("row_a >= row_b").count() == 0
        d = {r.cluster: (r.size, r.words) for r in density_peaks.described(labels, df.select("row_id", "word")).collect()}
        assert len(d) == len(got) and all(s == 9 and len(w) == 3 for s, w in d.values())


def test_a_third_of_the_rows_in_one_group(spark):
    c = RNG.standard_normal(128)
    rows = planted(10, 6, 0.93, 300) + [(50_000 + j, near(c, 0.95)) for j in range(200)] + [(60_000 + j, c) for j in range(60)]
    got = groups(density_peaks.clusters(table(spark, rows), block_rows=10, sample=150))
    assert frozenset([*range(50_000, 50_200), *range(60_000, 60_060)]) in got


def test_versions_of_a_row(spark):
    c = [RNG.standard_normal(128) for _ in range(6)]
    rows = [(i, near(c[i % 6], 0.93)) for i in range(60)] + [(i, near(c[(i + 1) % 6], 0.93)) for i in range(0, 60, 3)]
    labels = density_peaks.clusters(table(spark, rows))
    ids = [r.row_id for r in labels.collect()]
    assert len(ids) == len(set(ids)) and 40 <= len(ids) and set(ids) <= set(range(60))
    pairs = {(r.row_a, r.row_b) for r in nearest.mutual_neighbours(table(spark, rows + rows[:20]), min_similarity=0.8).collect()}
    assert pairs and all(a < b for a, b in pairs)


def test_dense_region(spark):
    c = RNG.standard_normal(128)
    rows = [(i, near(c, 0.995)) for i in range(1500)] + [(5000 + i, RNG.standard_normal(128)) for i in range(500)]
    want = brute(rows, 5, 0.96)
    got = {(r.row_a, r.row_b) for r in nearest.mutual_neighbours(table(spark, rows), cell_rows=256, leaf_rows=64).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)


def test_follow(spark):
    links = spark.createDataFrame([(i, max(0, i - 1)) for i in range(40)] + [(100, 100)], "row_id bigint, parent bigint")
    assert {r.row_id: r.root for r in density_peaks.follow(links).collect()} == {**{i: 0 for i in range(40)}, 100: 100}


def test_clusters_stay_whole_in_many_blocks(spark):
    rng = np.random.default_rng(17)
    rows = []
    for g in range(200):
        a, b = np.linalg.qr(rng.standard_normal((128, 2)))[0].T
        rows += [(2 * g, a), (2 * g + 1, 0.67 * a + math.sqrt(1 - 0.67**2) * b)]
    got = groups(density_peaks.clusters(table(spark, rows), smallest=2, block_rows=2))
    assert got == {frozenset({2 * g, 2 * g + 1}) for g in range(200)}


def test_similarity_just_at_the_bound(spark):
    rng = np.random.default_rng(23)
    rows, want = [], set()
    for g in range(120):
        a, b = np.linalg.qr(rng.standard_normal((128, 2)))[0].T
        cos = 0.65 + (g - 60) * 2e-5
        x, y = np.float32(a).astype(np.float64), np.float32(cos * a + math.sqrt(1 - cos * cos) * b).astype(np.float64)
        rows += [(2 * g, x), (2 * g + 1, y)]
        if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.65:
            want.add(frozenset({2 * g, 2 * g + 1}))
    assert 50 < len(want) < 70 and groups(density_peaks.clusters(table(spark, rows), smallest=2)) == want


def test_density_counts_the_neighbours(spark):
    rows = planted(20, 9, 0.9)
    ids, x = np.array([i for i, _ in rows]), np.array([v / np.linalg.norm(v) for _, v in rows])
    want = dict(zip(ids.tolist(), ((x @ x.T) >= 0.65).sum(1) - 1))
    got = {r.row_id: r.density for r in density_peaks.clusters(table(spark, rows), block_rows=60, copies=8).collect()}
    assert len(got) > 150 and sum(got.values()) >= 0.9 * sum(int(want[i]) for i in got) and all(d <= want[i] + 1 for i, d in got.items())


@pytest.mark.parametrize("part_rows", [2000, 20])
def test_complete_densities(spark, part_rows):
    c = [RNG.standard_normal(128) for _ in range(4)]
    rows = [(i, near(c[i % 4], 0.75)) for i in range(240)]
    labels = spark.createDataFrame([(i, 1000 + i % 4) for i, _ in rows], "row_id bigint, cluster bigint")
    x = np.array([v for _, v in rows], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mine = np.arange(240)[:, None] % 4 == np.arange(240)[None, :] % 4
    want = ((x @ x.T >= 0.65) & mine).sum(1) - 1
    got = {r.row_id: (r.density, r.cluster) for r in density_peaks.density_within(labels, table(spark, rows + BAD), part_rows=part_rows).collect()}
    assert {i: d for i, (d, _) in got.items()} == dict(enumerate(want.tolist()))
    assert all(got[i][1] == max((j for j in range(i % 4, 240, 4)), key=lambda j: (want[j], -j)) for i in range(240))
    assert density_peaks.density_within(labels.limit(0), table(spark, rows)).count() == 0


def test_pairs_of_a_large_cluster_in_parts(spark):
    labels = spark.createDataFrame([(i, 7, 1) for i in range(50)] + [(100 + i, 8, 1) for i in range(5)], "row_id bigint, cluster bigint, density int")
    got = {(r.row_a, r.row_b) for r in density_peaks.pairs(labels, 8).collect()}
    assert got == {(a, b) for b in range(50) for a in range(b)} | {(100 + a, 100 + b) for b in range(5) for a in range(b)}


def test_chance_to_meet():
    few, many = (density_peaks.Blocks(rows, 8, 1500, 202) for rows in (40_000, 4_000_000))
    assert 0.8 < few.meeting(0.65) < 0.95 and 0.3 < many.meeting(0.65) < 0.5 and density_peaks.Blocks(10, 8, 1500, 202).meeting(0.65) == 1


def test_more_rows_as_near_as_the_kth_than_candidates(spark):
    """40 rows that half precision can't tell apart; the nearest have the largest ids."""
    rng = np.random.default_rng(31)
    c, r = np.linalg.qr(rng.standard_normal((128, 2)))[0].T
    rows = [(0, c)] + [(i, (c + (61 - i) * 1e-5 * r).astype(np.float32)) for i in range(1, 61)] + [(1000 + i, rng.standard_normal(128)) for i in range(300)]
    for options in ({}, {"miss": 0.005}):
        got = {r.other for r in nearest.nearest_rows(table(spark, rows), **options).collect() if r.row_id == 0}
        assert got == {56, 57, 58, 59, 60}
    f32 = [(i, np.asarray(v, np.float32)) for i, v in rows]
    got = {(r.row_a, r.row_b) for r in nearest.mutual_neighbours(table(spark, rows)).collect()}
    ids, x = np.array([i for i, _ in f32]), np.array([v for _, v in f32], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = {int(a): {int(ids[b]) for b in [b for b in np.lexsort((ids, -(x @ x[n]).round(12))) if b != n and x[b] @ x[n] >= 0.96][:5]} for n, a in enumerate(ids)}
    assert got == {(a, b) for a in top for b in top[a] if a < b and a in top[b]}


@pytest.mark.parametrize("options", [{}, {"miss": 0.005}])
def test_every_copy_asked_for_has_its_neighbours(spark, options):
    v = RNG.standard_normal(128)
    rows = [(i, v) for i in range(100)] + [(1000 + i, RNG.standard_normal(128)) for i in range(100)]
    got = {}
    for r in nearest.nearest_rows(table(spark, rows), **options).collect():
        got.setdefault(r.row_id, set()).add(r.other)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    assert all(got[i] == set([j for j in range(7) if j != i][:5]) for i in range(0, 100, 20))


@pytest.mark.parametrize("options", [{}, {"slice_rows": 60}])
def test_a_link_that_holds_is_found_behind_one_that_does_not(spark, options):
    """The third row of each group is just below the bound with the first and just above it with the second, closer than 8 bits can tell."""
    rng = np.random.default_rng(41)
    rows = []
    for g in range(60):
        p, a, b = np.linalg.qr(rng.standard_normal((128, 3)))[0].T
        rows += [(3 * g + i, (c * p + math.sqrt(1 - c * c) * o).astype(np.float32)) for i, (c, o) in enumerate([(0.64998, a), (0.65002, b)])] + [(3 * g + 2, p.astype(np.float32))]
    got = groups(density_peaks.clusters(table(spark, rows), smallest=2, **options))
    assert got == {frozenset({3 * g + 1, 3 * g + 2}) for g in range(60)}


def linked(rows, similarity, smallest):
    """All pairs that reach ``similarity`` whose first row has enough neighbours; each distinct vector of a row counts."""
    once = {(i, np.asarray(v, np.float32).tobytes()) for i, v in rows}
    ids = np.array([i for i, _ in once])
    x = np.array([np.frombuffer(v, np.float32) for _, v in once]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= similarity) & (ids[:, None] != ids)
    density = {int(i): int(near[ids == i].sum()) for i in ids}
    return sorted((int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(near)) if ids[a] < ids[b] and density[int(ids[a])] >= smallest - 1)


@pytest.mark.parametrize("options", [{}, {"slice_rows": 100}])
def test_all_pairs_that_reach_the_bound(spark, options):
    rng = np.random.default_rng(43)
    rows = planted(6, 7, 0.9, 200) + planted(3, 4, 0.95, 0)  # the second ones share ids: versions
    a, b = np.linalg.qr(rng.standard_normal((128, 2)))[0].T
    rows += [(20_000 + i, math.cos(0.06 * i) * a + math.sin(0.06 * i) * b) for i in range(60)]  # a chain: each reaches 14 on each side
    rows += [(30_000 + i, a) for i in range(20)] + [(31_000 + i, near(a, 0.65 + (i - 10) * 1e-5)) for i in range(20)]
    want = linked(rows, 0.65, 5)
    got = sorted((r.row_a, r.row_b) for r in density_peaks.neighbour_pairs(table(spark, rows + rows[:50] + BAD).repartition(4), **options).collect())
    assert len(want) > 800 and got == want
    assert density_peaks.neighbour_pairs(table(spark, BAD)).count() == 0


def test_clusters_of_a_chain_stay_whole_and_densities_complete(spark):
    rng = np.random.default_rng(47)
    rows = planted(10, 9, 0.85, 200)
    a, b = np.linalg.qr(rng.standard_normal((128, 2)))[0].T
    rows += [(20_000 + i, math.cos(0.06 * i) * a + math.sin(0.06 * i) * b) for i in range(20)] + [(30_000 + i, a) for i in range(8)]
    x = np.array([np.asarray(v, np.float32) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, n = [i for i, _ in rows], (x @ x.T >= 0.65).sum(1) - 1
    got = {r.row_id: r.density for r in density_peaks.clusters(table(spark, rows), slice_rows=80).collect()}
    assert got.items() <= dict(zip(ids, n.tolist())).items() and {i for i in ids if i >= 20_000} <= set(got)


def test_clusters_in_blocks(spark):
    rows = planted(30, 9, 0.9)
    got = groups(density_peaks.clusters(table(spark, rows + BAD), miss=0.001, block_rows=20, sample=100))
    assert len(got & {frozenset(10_000 + 100 * g + j for j in range(9)) for g in range(30)}) >= 29


def mutual(rows, k, floor):
    """The mutual pairs of the distinct vectors of ``rows``, as numbered, by all cosines in double precision."""
    ids, x = np.array([i for i, _ in rows]), np.array([np.asarray(v, np.float32) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = (x @ x.T).round(12)
    top = {int(a): {int(ids[b]) for b in [b for b in np.lexsort((ids, -cos[n])) if b != n and cos[n, b] >= floor][:k]} for n, a in enumerate(ids)}
    return {(a, b) for a in top for b in top[a] if a < b and a in top[b]}


@pytest.mark.parametrize("options", [{}, {"block_rows": 60, "miss": 1e-4}, {"block_rows": 4, "miss": 1e-4}, {"miss": 0}])
def test_mutual_neighbours_in_blocks(spark, monkeypatch, options):
    rng = np.random.default_rng(53)
    monkeypatch.setitem(globals(), "RNG", rng)
    rows = planted(60, 4, 0.985, 600) + [(40_000 + j, np.eye(128)[j] + 1e-3) for j in range(20)] + [(41_000 + j, np.eye(128)[j]) for j in range(20)]
    c = rng.standard_normal(128)
    rows += [(50_000 + j, near(c, 0.999)) for j in range(80)] + [(60_000 + j, c) for j in range(30)]  # crowded
    want = mutual(rows, 5, 0.96)
    got = [(r.row_a, r.row_b) for r in nearest.mutual_neighbours(table(spark, rows + rows[:40] + BAD).repartition(3), **options).collect()]
    assert len(want) > 300 and len(got) == len(set(got)) and set(got) ^ want == set()


def test_what_a_row_sends_hardly_grows(spark):
    """In a table of 10,000,000 rows (6 GB) a row is sent to at most 16 blocks of 144 bytes each, less than four times its own size; the tree sent 264 bytes to about 100 cells."""
    few, many = (nearest.EvenBlocks.for_miss(n, 0.954, 0.002, 6000) for n in (100_000, 10_000_000))
    assert few.copies <= 8 and many.copies <= 16
    rng = np.random.default_rng(59)
    units = unit_vectors.turned_rows(unit_vectors.full_rows(table(spark, [(i, rng.standard_normal(128)) for i in range(500)])))
    known = units.selectExpr("row_id", "vec", "1L AS n", "0L AS density")
    blocks = nearest.EvenBlocks(500, 3, 50, 1)
    assert density_peaks._spread(known, blocks, 500, 50, 500).count() == 3 * 500


def test_first_rows_are_the_first_copies(spark):
    rows = [(i, RNG.standard_normal(128)) for i in range(100)]
    df = table(spark, rows + rows[:10] + [(200 + i, rows[0][1]) for i in range(9)] + [(3, -rows[3][1])] + BAD)
    first = unit_vectors.first_rows(df, 4)
    want = unit_vectors.first_copies(unit_vectors.full_rows(df), 4)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, want.collect())) and first.count() == 100 + 3 + 1
