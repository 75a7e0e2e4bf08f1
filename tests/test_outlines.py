"""Outlines put together from members."""

from __future__ import annotations

from collections import defaultdict

from geoscore.operators import outlines as O

MEMBERS = "name string, rings array<array<struct<x:double,y:double>>>"


def box(x, y, w=1, h=1, back=False, closed=True):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    ring = ring[::-1] if back else ring
    return ring + ring[:1] if closed else ring


def member(name, *rings):
    return name, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]


def rings_of(spark, members):
    got = defaultdict(dict)
    for r in O.region_outline(spark.createDataFrame(members, MEMBERS), "name").collect():
        got[r["name"], r["ring"]][r["seq"]] = (r["x"], r["y"])
    out = defaultdict(list)
    for (name, ring), corners in sorted(got.items(), key=str):
        assert sorted(corners) == list(range(len(corners)))
        out[name].append([corners[i] for i in range(len(corners))])
    assert sorted(k for _, k in got) == list(range(len(got)))
    return {n: sorted(r) for n, r in out.items()}


def area(ring):
    return sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])) / 2


def test_joined_touching_and_apart(spark):
    got = rings_of(spark, [
        member("row", box(0, 0)), member("row", box(1, 0, back=True)), member("row", box(2, 0, closed=False)),
        member("corner", box(0, 0)), member("corner", box(1, 1)), member("apart", box(0, 0)), member("apart", box(5, 5)),
        member(None, box(-1, -1)), member("none", []), member("thin", [(0, 0), (1, 1)]), ("null", None),
    ])
    assert got["row"] == [[(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (2, 1), (1, 1), (0, 1)]]
    assert got["corner"] == [[(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]]
    assert [area(r) for r in got["apart"]] == [1, 1] and got[None] == [[(-1, -1), (0, -1), (0, 0), (-1, 0)]]
    assert set(got) == {"row", "corner", "apart", None}


def test_holes(spark):
    """A frame of eight boxes around a hole, a hole filled by another member, and a member with a hole of its own."""
    frame = [member("frame", box(x, y)) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    own = [member("own", box(0, 0, 9, 9), box(2, 2, 2, 2)), member("filled", box(0, 0, 9, 9), box(2, 2, 2, 2, back=True)), member("filled", box(2, 2, 2, 2))]
    got = rings_of(spark, frame + own)
    assert sorted(area(r) for r in got["frame"]) == [-1, 9] and sorted(len(r) for r in got["frame"]) == [4, 12]
    assert sorted(area(r) for r in got["own"]) == [-4, 81] and [area(r) for r in got["filled"]] == [81]


def test_long_ring(spark):
    """A comb of 300 boxes: one ring of many corners is put in order."""
    members = [member("comb", box(x, 0)) for x in range(200)] + [member("comb", box(x, 1)) for x in range(0, 200, 2)]
    (ring,) = rings_of(spark, members)["comb"]
    assert area(ring) == 300 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))
    assert len(set(ring)) == len(ring) and ring[0] == min(ring)
