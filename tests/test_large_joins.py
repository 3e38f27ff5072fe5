"""No table that grows goes through the driver: joins with it shuffle both sides, and its rows are made by more than one task."""

import pytest

from geoframe.plans import storage, views

SMALL = "/root/testdata/sf0.001"
NAMES = """v17_rasterize_mesh v13_straighten x1_apply_submesh_model p15_points_in_mesh m12_sample_surface m13_vertex_normals
m16_local_surface m17_face_centres m1_face_geometry m2_mesh_area m3_mesh_volume m5_cap_loops m6_dihedral_p95 m9_aspect_ratio
n3_smooth_taubin n4_sweep_diverges m7_curvature_rms m8_curvature_variation j18_transfer_labels e10_normal_error
p17_clip_outside_caps k14_thin_points k7_sample_rows k5_place_samples x2_sample_udtf k4_walk_steps""".split()
#: A row a range, and the ten remainders by which points are dealt to meshes in p15.
BOUNDED = ("__range", "r#")


@pytest.mark.parametrize("name", NAMES)
def test_joins_shuffle_both_sides(spark, monkeypatch, name):
    import __spark_entry__

    plans, write = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder: (plans.append(df), write(df, folder))[1])
    plans.append(__spark_entry__.queries()[name](spark, SMALL))
    text = "\n".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    sent = [line for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sent if not line.split("BroadcastHashJoin")[1].lstrip(" [coalesce(").startswith(BOUNDED)]


@pytest.mark.parametrize("name", ["v_vertex", "v_face"])
def test_meshes_are_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(views, "MESHES", 3)
    rows = views.view(spark, SMALL, name)
    assert rows.rdd.getNumPartitions() > 1
    assert rows.select("mesh_id").distinct().count() == spark.read.parquet(f"{SMALL}/supplier.parquet").count()


def test_found_region_is_shuffled(spark, monkeypatch):
    test_joins_shuffle_both_sides(spark, monkeypatch, "n5_region_grow")


@pytest.mark.parametrize("name", ["n5_region_grow", "n3_smooth_laplacian"])
def test_tasks_grow_with_written_tables(spark, monkeypatch, name):
    import __spark_entry__

    plans, write = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder: (plans.append(df), write(df, folder))[1])
    monkeypatch.setattr(storage, "ROWS", 1_000, raising=False)
    __spark_entry__.queries()[name](spark, SMALL)
    text = "\n".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    edges = spark.read.parquet(f"{SMALL}/supplier.parquet").count() * 2 * 705
    assert f", {edges // 1_000 + 1}), REPARTITION_BY_NUM" in text


def test_lines_are_dealt_once(spark, monkeypatch):
    from geoframe.operators import lines

    monkeypatch.setattr(views, "POINTS", 100, raising=False)
    rows = views.view(spark, SMALL, "v_line")
    tasks = spark.read.parquet(f"{SMALL}/events.parquet").count() // 100 + 1
    assert rows.rdd.getNumPartitions() == tasks > 1
    plan = lines.successors(rows, 30.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count(f", {tasks}), REPARTITION_BY_NUM") == 1


def test_samples_meet_their_spots_in_tasks_that_grow(spark, monkeypatch):
    import __spark_entry__
    from geoframe.operators import lines

    monkeypatch.setattr(lines, "SPOTS", 100, raising=False)
    plan = __spark_entry__.queries()["k7_sample_rows"](spark, SMALL)
    spots = __spark_entry__.queries()["k4_walk_steps"](spark, SMALL).count()
    assert f", {spots // 100 + 1}), REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_near_points_are_dealt(spark, monkeypatch):
    from geoframe.operators import spatial

    plans, write = {}, storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder: (plans.setdefault(folder, df), write(df, folder))[1])
    monkeypatch.setattr(spatial, "THINNED", 10, raising=False)
    points = [(0, i, float(i % 7), float(i * 3 % 11), float(i * 5 % 4)) for i in range(60)]
    kept = {r.point_id for r in spatial.thin_points(spark.createDataFrame(points, "case_id long, point_id long, x double, y double, z double"), 2.5).collect()}
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])) >= 2.5**2
    alone = []
    for p in points:
        if all(far(p, q) for q in alone):
            alone.append(p)
    assert kept == {p[1] for p in alone}
    text = plans["conflicts"]._jdf.queryExecution().executedPlan().toString()
    assert text.count(", 7), REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("name", ["m6_dihedral_p95", "m7_curvature_rms"])
def test_edges_of_faces_are_dealt_by_meshes(spark, monkeypatch, name):
    import __spark_entry__
    from geoframe.operators import mesh

    plans, write = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder: (plans.append(df), write(df, folder))[1])
    monkeypatch.setattr(mesh, "FACES", 1_000, raising=False)
    plans.append(__spark_entry__.queries()[name](spark, SMALL))
    tasks = spark.read.parquet(f"{SMALL}/supplier.parquet").count() * 450 // 1_000 + 1
    text = "\n".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert f", {tasks}), REPARTITION_BY_NUM" in text and "SortAggregate" not in text


def test_corners_are_joined_where_meshes_are_dealt(spark, monkeypatch):
    from geoframe.operators import mesh

    monkeypatch.setattr(views, "MESHES", 3)
    plan = mesh.corners(views.view(spark, SMALL, "v_face"), views.view(spark, SMALL, "v_vertex"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") == 4


def test_crossing_faces_are_paired_in_one_cell(spark, monkeypatch):
    import __spark_entry__
    from geoframe.operators import mesh

    monkeypatch.setattr(views, "MESHES", 3)
    monkeypatch.setattr(mesh, "CROSSED", 1_000, raising=False)
    plan = __spark_entry__.queries()["m10_self_intersections"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    # Faces and vertices are dealt once a side; pairs and celled faces are not shuffled.
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") and "o_fid" in plan


@pytest.mark.parametrize("name", ["k8_plane_trajectories", "k9_deproject_trajectories"])
def test_samples_stay_where_their_case_is(spark, monkeypatch, name):
    import __spark_entry__
    from geoframe.plans import queries_geometry

    monkeypatch.setattr(views, "POINTS", 100)
    monkeypatch.setattr(queries_geometry, "SAMPLED", 50, raising=False)
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") and "Window" in plan


def test_cells_of_wide_cases_are_dealt(spark, monkeypatch):
    """Ten cases hold all points, so a task a case would not do."""
    import __spark_entry__
    from geoframe.plans import queries_lines

    monkeypatch.setattr(queries_lines, "PAIRED", 50, raising=False)
    tasks = spark.read.parquet(f"{SMALL}/events.parquet").count() // 50 + 1
    plan = __spark_entry__.queries()["p6_points_in_box"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if f", {tasks}), REPARTITION_BY_NUM" in line]
    assert tasks > 4 and len(dealt) == 2 and all("__cx" in line for line in dealt)
