"""The loader's scenarios; tiles of 1000 bytes. Expected tiles are fixed values of FIXTURES.md."""

import pytest

from gridloom.streaming.loader import EVENTS, Loader, fold, over, place

ROOT, KIDS = "0/0/0", ["1/0/0", "1/1/0", "1/0/1", "1/1/1"]


def land(loader, keys, size=1000, now=0):
    for k in keys:
        assert loader.result(now, k, loader.tiles[k].attempt, size)
    while loader.upload():
        pass


def test_boxes():
    assert over(place("0/0/0"), place("2/3/1")) and over(place("2/3/1"), place("1/1/0")) and not over(place("2/3/1"), place("1/0/0"))


def test_stand_ins():
    s = Loader()
    assert s.frame(0, [ROOT]) == ([], [ROOT], [])
    land(s, [ROOT])
    assert s.frame(1, KIDS)[:2] == ([ROOT], KIDS)  # while children load, the root is drawn
    land(s, [KIDS[2]])
    assert s.frame(2, KIDS)[0] == [ROOT, KIDS[2]]
    land(s, [k for k in KIDS if k != KIDS[2]])
    assert sorted(s.frame(3, KIDS)[0]) == sorted(KIDS)
    t = Loader()
    t.frame(0, KIDS)
    land(t, KIDS)
    assert sorted(t.frame(1, [ROOT])[0]) == sorted(KIDS)  # children until the root lands


def test_suspended_loads_draw_what_is_there():
    s = Loader()
    s.frame(0, [ROOT])
    land(s, [ROOT])
    assert s.frame(1, KIDS, suspended=True)[:2] == ([ROOT], [])


def test_evictions_spare_ancestors():
    s = Loader(byte_cap=1000)
    s.frame(0, ["1/0/0", "1/1/1"])
    land(s, ["1/0/0", "1/1/1"])
    assert s.frame(1, ["1/0/0"])[2] == ["1/1/1"]
    t = Loader(count_cap=4)
    t.frame(0, [ROOT])
    land(t, [ROOT])
    t.frame(1, KIDS)
    land(t, KIDS)
    assert t.frame(2, KIDS)[2] == [] and ROOT in t.tiles


def test_pruning():
    s = Loader(in_flight=3)
    s.frame(0, KIDS)
    gone = s.frame(1, ["1/0/0", "1/0/1"])[2]
    assert len(gone) == 1 and gone[0].startswith("1/1/")
    t = Loader(in_flight=0)
    t.frame(0, KIDS)
    assert t.frame(1, [ROOT])[2] == [] and sum(x.state == "loading" for x in t.tiles.values()) == 5  # what overlaps the view stays


def test_retries_and_late_results():
    s, asked = Loader(retries=2), []
    for now in (0, 500, 1000, 2000, 2999, 3000, 9000, 99000):
        if s.frame(now, [ROOT])[1]:
            asked.append(now)
            assert s.result(now, ROOT, s.tiles[ROOT].attempt, None)
    assert asked == [0, 1000, 3000]
    t = Loader(in_flight=0)
    t.frame(0, ["1/0/0"])
    old = t.tiles["1/0/0"].attempt
    t.frame(1, ["1/1/1"])  # given up
    t.frame(2, ["1/0/0"])  # a second attempt
    assert not t.result(3, "1/0/0", old, 1000) and t.tiles["1/0/0"].state == "loading"
    assert t.result(3, "1/0/0", old + 2, 1000)


def test_upload_budget():
    for cap, want in ((1500, [2, 2, 0]), (0, [1, 1, 1, 1, 0])):
        s = Loader(upload_cap=cap)
        s.frame(0, KIDS)
        for k in KIDS:
            s.result(0, k, s.tiles[k].attempt, 1000)
        got = [s.upload() for _ in want]
        assert [len(x) for x in got] == want and sum(got, []) == KIDS


def test_destroyed():
    s = Loader()
    s.frame(0, KIDS)
    assert s.destroy() == sorted(KIDS) and s.frame(1, KIDS) == ([], [], []) and not s.result(1, KIDS[0], 1, 10)


@pytest.mark.parametrize("parts", [1, 3])
def test_fold(spark, parts):
    rows, at = [], 0
    for session in ("a", "b", "c"):
        for kind, keys, key, attempt, size in (("frame", [ROOT], None, None, None), ("result", None, ROOT, 1, 1000), ("result", None, ROOT, 9, 1000), ("upload", None, None, None, None), ("frame", KIDS, None, None, None), ("destroy", None, None, None, None)):
            rows.append((session, at, kind, at, keys, key, attempt, size))
            at += 1
    got = sorted(map(tuple, fold(spark.createDataFrame(rows, EVENTS).repartition(parts)).collect()), key=lambda r: r[1])
    for i in range(3):
        own = got[6 * i : 6 * i + 6]
        assert own[0][4] == [f"{ROOT}@1"] and own[1][7] == 1 and own[2][5] == [ROOT] and own[3][3] == [ROOT]
        assert own[4][3] == [ROOT] and len(own[4][4]) == 4 and own[4][9] == 1000 and own[5][8] == 0
