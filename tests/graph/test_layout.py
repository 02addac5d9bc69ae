import numpy as np

from tessera.operators import layout, reports

SCHEMA = "g string, node int, x double, y double, pinned boolean"


def all_pairs(place):
    gap = place[:, None] - place[None]
    return (gap / np.maximum((gap**2).sum(-1), 1e-6)[..., None]).sum(1)


def frame(spark, groups):
    return spark.createDataFrame([(g, i, float(x), float(y), i % 10 == 0) for g, place in groups.items() for i, (x, y) in enumerate(place)], SCHEMA)


def test_push_is_near_all_pairs_at_every_size(spark):
    r = np.random.default_rng(3)
    clump = np.concatenate([r.normal(0, 1e-3, (300, 2)), r.normal(0, 40, (500, 2))])
    same = np.concatenate([np.full((200, 2), 5.0), r.normal(0, 9, (100, 2))])  # one point never falls apart
    groups = {"one": np.zeros((1, 2)), "few": r.normal(0, 3, (20, 2)), "many": r.normal(0, 30, (1500, 2)), "clump": clump, "same": same}
    got = {(x.g, x.node): (x.px, x.py) for x in layout.repulsion(frame(spark, groups), "g").collect()}
    assert len(got) == sum(map(len, groups.values()))
    for g, place in groups.items():
        have, want = np.array([got[g, i] for i in range(len(place))]), all_pairs(place)
        off, size = np.hypot(*(have - want).T), np.hypot(*want.T)
        assert off.mean() <= 0.05 * size.mean() + 1e-9, g
        if g in ("one", "few"):  # no cell is apart, so these are exact
            assert np.allclose(have, want)


def test_rounds_against_brute_force(spark):
    r = np.random.default_rng(5)
    place = r.normal(0, 20, (400, 2))
    pairs = np.array([(i, (i * 7 + 1) % 400) for i in range(400)])
    df = frame(spark, {"a": place})
    links = spark.createDataFrame([("a", int(i), int(j)) for i, j in pairs] + [("a", 1, 9999), ("b", 1, 2)], "g string, a int, b int")
    rounds, at = 3, place.copy()
    for turn in range(rounds):
        d = at[pairs[:, 1]] - at[pairs[:, 0]]
        step = all_pairs(at)
        np.add.at(step, pairs[:, 0], 0.1 * d)
        np.add.at(step, pairs[:, 1], -0.1 * d)
        size = np.maximum(np.hypot(*step.T), 1e-9)
        at += (np.arange(400) % 10 != 0)[:, None] * step / size[:, None] * np.minimum(size, 1 - turn / rounds)[:, None]
    got = {x.node: (x.x, x.y) for x in layout.relax_large(df, links, "g", rounds).collect()}
    have = np.array([got[i] for i in range(400)])
    off = np.hypot(*(have - at).T)
    assert off.mean() < 0.05 and off.max() < 0.5
    assert np.array_equal(have[::10], place[::10])
    assert layout.relax_large(df.limit(0), links, "g", 1).count() == 0


def test_large_groups_move_beside_small_ones(spark):
    r = np.random.default_rng(8)
    groups = {"small": r.normal(0, 5, (8, 2)), "large": r.normal(0, 5, (60, 2))}
    df = frame(spark, groups)
    links = spark.createDataFrame([("small", 1, 2), ("large", 1, 2)], "g string, a int, b int")
    split = {(x.g, x.node): (x.x, x.y) for x in reports.relax_groups(df, links, "g", 2, most=10).collect()}
    whole = {(x.g, x.node): (x.x, x.y) for x in reports.relax(df, links, "g", 2).collect()}
    assert split.keys() == whole.keys()
    far = {k: np.hypot(*(np.array(split[k]) - np.array(whole[k]))) for k in whole}
    assert max(v for k, v in far.items() if k[0] == "small") == 0
    assert np.mean([v for k, v in far.items() if k[0] == "large"]) < 0.05
    assert any(split["large", i] != tuple(groups["large"][i]) for i in range(60) if i % 10)


def test_added_nodes_of_a_large_group_move(spark):
    placed = spark.createDataFrame([("g", i, float(i % 7), float(i // 7)) for i in range(40)], "g string, node int, x double, y double")
    added = spark.createDataFrame([("g", 100), ("g", 101)], "g string, node int")
    links = spark.createDataFrame([("g", 100, 0)], "g string, a int, b int")
    start = {x.node: (x.x, x.y) for x in reports.append_seeds(placed, added, "g").collect()}
    end = {x.node: (x.x, x.y) for x in reports.append_layout(placed, added, links, "g", rounds=2, most=20).collect()}
    assert end.keys() == {100, 101} and all(end[k] != start[k] for k in end)


def test_nodes_are_not_written_once_a_level(spark, monkeypatch):
    r = np.random.default_rng(4)
    sizes, write = [], layout.materialize

    def counted(df, name, **options):
        sizes.append((out := write(df, name, **options)).count())
        return out

    monkeypatch.setattr(layout, "materialize", counted)
    df = frame(spark, {"even": r.uniform(-100, 100, (3000, 2))})
    assert layout.repulsion(df, "g").count() == 3000
    assert sum(sizes) <= 3000  # cells down to the group's depth, not 21 levels of nearly as many cells as nodes


def test_null_places_are_left_out(spark):
    rows = [("g", i, float(i), 0.0, False) for i in range(3)] + [("g", 3, None, 1.0, False), (None, 4, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = layout.relax_large(df, spark.createDataFrame([("g", 0, 3)], "g string, a int, b int"), "g", 1)
    assert sorted(x.node for x in got.collect()) == [0, 1, 2]
