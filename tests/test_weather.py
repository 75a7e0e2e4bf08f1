"""Formulas and day classes, with the cases that are easy to get wrong."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from geoscore.functions import gsod as N, text as H, weather as W
from geoscore.functions.binning import fixed_breaks
from geoscore.functions.geo import haversine_km
from geoscore.operators import aggregate as A, classify as C, columns as P
from geoscore.operators.impute import impute_knn, impute_linear
from geoscore.plans import composites as Q


def test_degree_days_match_integration(spark):
    cases = [(8.0, 30.0), (20.0, 25.0), (1.0, 10.0), (18.0, 18.0), (17.9, 18.1), (18.0, 30.0), (-5.0, 18.0), (7.0, 7.0), (21.0, 21.0)]
    df = spark.createDataFrame(cases, "lo double, hi double")
    for row in P.expand_struct(df, W.excess_degree_days(F.col("lo"), F.col("hi"))).collect():
        n, hot, cold = 20_000, 0.0, 0.0
        for i in range(n):
            a = (row["hi"] - row["lo"]) / 2
            t = row["lo"] + a - a * math.cos(2 * math.pi * (i + 0.5) / n) - 18
            hot, cold = hot + max(t, 0), cold + max(-t, 0)
        assert row["edd_hot"] == pytest.approx(hot / n, abs=0.0051)
        assert row["edd_cold"] == pytest.approx(cold / n, abs=0.0051)
        assert row["edd_total"] == pytest.approx(row["edd_hot"] + row["edd_cold"], abs=0.0101)


def test_degree_hours_are_a_day_of_degree_days(spark):
    df = spark.createDataFrame([(8.0, 30.0), (20.0, 25.0), (1.0, 10.0)], "lo double, hi double")
    both = P.expand_struct(df, W.excess_degree_days(F.col("lo"), F.col("hi"))).withColumn("h", W.excess_degree_hours(F.col("lo"), F.col("hi")))
    assert all(r["h"] == pytest.approx(24 * r["edd_total"], abs=0.13) for r in both.collect())


def test_degree_days_unknown(spark):
    df = spark.createDataFrame([(None, 5.0), (5.0, None)], "lo double, hi double")
    assert all(r["edd_total"] is None for r in P.expand_struct(df, W.excess_degree_days(F.col("lo"), F.col("hi"))).collect())


def test_heat_index_published_values(spark):
    # Table values of the weather service, in Fahrenheit: (temperature, humidity) -> index
    table = {(90, 70): 106, (80, 40): 80, (100, 50): 118, (84, 90): 98, (96, 45): 104}
    rows = [((f - 32) / 1.8, float(h), v) for (f, h), v in table.items()]
    df = spark.createDataFrame(rows, "t double, rh double, v int")
    for r in df.withColumn("hi", W.heat_index(F.col("t"), F.col("rh")) * 1.8 + 32).collect():
        assert r["hi"] == pytest.approx(r["v"], abs=0.7)


def test_feels_like_branches(spark):
    rows = [(5.0, 50.0, 2.0, 5.0), (5.0, 50.0, None, 5.0), (15.0, 50.0, 20.0, 15.0), (30.0, None, 1.0, 30.0), (30.0, 120.0, 1.0, None), (None, 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "t double, rh double, w double, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", W.feels_like(F.col("t"), F.col("rh"), F.col("w"))).collect())
    chilled = df.limit(1).select(W.feels_like(F.lit(0.0), F.lit(50.0), F.lit(10.0)).alias("c")).first()["c"]
    assert chilled == pytest.approx(-4.9, abs=0.5)


def test_classify_day_with_unknowns(spark):
    columns = "temp_min_feel double, temp_max_feel double, prcp double, sndp double, i_rain_drizzle double, i_snow_ice double, want string"
    rows = [
        (10.0, 20.0, None, None, None, None, "pleasant"), (19.0, None, None, None, None, None, "hot"),
        (None, 25.0, 99.0, None, None, None, "pleasant"), (None, 5.0, None, None, None, None, "pleasant"),
        (-1.0, 20.0, 99.0, None, None, None, "cold"), (10.0, 20.0, None, None, 0.5, None, "elements"), (10.0, 20.0, 5.0, 50.0, 0.0, 0.0, "pleasant"),
        (18.0, 28.0, 0.0, 0.0, 0.0, 0.0, "pleasant"), (0.0, 12.0, 6.0, None, None, None, "elements"),
    ]
    for r in C.classify_day(spark.createDataFrame(rows, columns)).collect():
        assert r["class"] == r["want"]
        assert r["hot"] + r["cold"] + r["elements"] + r["pleasant"] == 1


def test_fill_min_max_uses_the_filled_high(spark):
    df = spark.createDataFrame([(None, None, 10.0), (5.0, None, 10.0), (None, 14.0, 10.0)], "temp_min double, temp_max double, temp_mean double")
    assert [tuple(r) for r in C.fill_min_max(df).collect()] == [(None, None, 10.0), (5.0, 15.0, 10.0), (6.0, 14.0, 10.0)]
    assert tuple(C.fill_min_max(df, both_from_mean=True).first()) == (10.0, 10.0, 10.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 122), min_size=3, max_size=3), min_size=1, max_size=6))
def test_composition_always_totals_365(spark, years):
    rows = [(1, 2000 + y, int(c == 0), int(c == 1), int(c == 2)) for y, counts in enumerate(years) for c, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows or [(1, 2000, 0, 0, 0)], "e int, year int, pleasant int, hot int, cold int")
    got = A.normalized_composition(df, "e", "year", ["pleasant", "hot", "cold"]).first()
    assert sum(got[c] for c in ("pleasant", "hot", "cold", "unknown")) == 365


def test_composition_of_a_leap_year(spark):
    rows = [(1, 2000, 1, 0)] * 183 + [(1, 2000, 0, 1)] * 183
    got = A.normalized_composition(spark.createDataFrame(rows, "e int, year int, pleasant int, hot int"), "e", "year", ["pleasant", "hot"]).first()
    # both halves are 182.5 and round to the even 182, one short of 365; the missing day becomes unknown
    assert (got["pleasant"], got["hot"], got["unknown"]) == (182, 182, 1)


def test_codes(spark):
    df = spark.createDataFrame([("0.00I",), ("1.25G",), ("99.99",), ("71.1*",), ("",), (None,)], "t string")
    got = df.select(N.strip_flags(F.col("t")).alias("v"), N.precip_hours(F.col("t"), None).alias("h"), N.sentinel_to_null(N.strip_flags(F.col("t")), 99.99).alias("s")).collect()
    assert [r["v"] for r in got] == [0.0, 1.25, 99.99, 71.1, None, None]
    assert [r["h"] for r in got] == [1, 24, None, None, None, None]
    assert [r["s"] for r in got] == [0.0, 1.25, None, 71.1, None, None]


def test_names(spark):
    df = spark.createDataFrame([("Winston--Salem, NC",), ("Austin, TX",), ("Boston-Cambridge, MA-NH",), ("Nowhere",)], "n string")
    n = F.col("n")
    got = df.select(H.short_name(n), H.city_part(n), H.state_part(n), H.display_name(n)).collect()
    assert [tuple(r) for r in got] == [
        ("Winston", "Winston--Salem", "NC", "Winston – Salem, NC"), ("Austin", "Austin", "TX", "Austin, TX"),
        ("Boston", "Boston-Cambridge", "MA-NH", "Boston – Cambridge, MA-NH"), (None, None, None, None),
    ]


def test_fips_and_breaks(spark):
    df = spark.createDataFrame([("1001", 0.0), ("48453", 365.0), ("7", 50.0), ("1", 366.0)], "f string, v double")
    got = df.select(H.fips5(F.col("f")).alias("f"), fixed_breaks(F.col("v"), [0, 50, 100, 365]).alias("b")).collect()
    assert [(r["f"], r["b"]) for r in got] == [("01001", 1), ("48453", 3), ("007", 2), ("001", None)]


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`RegionID` int, `Region Name` int, `region_name` int, `2010-01` int")
    assert P.clean_names(df).columns == ["region_id", "region_name", "region_name_2", "x2010_01"]


def test_published_scores(spark):
    """Six places of the published table that between them hold every scale's ends, and their totals."""
    rows = [
        ("16980", 112.0, 285946.31327697093, 363.4, 70.09, 9498716.0, 45.0, 57.71886370086734),
        ("35620", 124.0, 578043.1100706148, 498.4, 80.81, 19979477.0, 95.0, 53.474157461163784),
        ("35380", 128.0, 234101.35272608805, 55.8, 53.65, 1270399.0, 5.0, 43.67517043004841),
        ("33460", 100.0, 328934.1169511983, 148.6, 67.65, 3629190.0, 30.0, 42.235675751360205),
        ("41740", 273.0, 711454.5738549664, 68.3, 41.61, 3343364.0, 80.0, 40.85722985680701),
        ("27260", 129.0, 264749.1876009045, 30.5, 29.45, 1534701.0, 25.0, 39.18214095593959),
        ("00001", 300.0, 1500000.0, 600.0, 90.0, 900000.0, 90.0, None),  # too dear
        ("00002", 300.0, 300000.0, 600.0, 90.0, 900000.0, 0.0, None),  # not preferred
        ("00003", 300.0, None, 600.0, 90.0, 900000.0, 50.0, None),  # price unknown
    ]
    df = spark.createDataFrame(rows, "cbsafp string, weather double, zhvi double, dest_index double, walkscore double, population double, preference_points double, want double")
    got = Q.score_and_rank(df, "cbsafp").orderBy("rank").collect()
    assert [r["cbsafp"] for r in got] == [r[0] for r in rows[:6]]
    assert all(r["total_weighted"] == pytest.approx(r["want"], abs=1e-9) for r in got)
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6]


def test_walk_composite_adds_up_repeated_places(spark):
    df = spark.createDataFrame([("a", 50.0, None, 10.0), ("a", 10.0, 10.0, 10.0), ("b", 100.0, 100.0, 100.0)], "k string, w double, t double, b double")
    got = {r["k"]: r["walkscore"] for r in Q.walk_composite(df, "k", {"w": 0.2, "t": 0.5, "b": 0.3}).collect()}
    assert got == {"a": pytest.approx(23.0), "b": pytest.approx(100.0)}


def test_area_quality_missing_year_is_unknown(spark):
    df = spark.createDataFrame([("1001", 1.0, 2.0), ("1003", 3.0, None), ("2001", 5.0, None)], "fips string, y1 double, y2 double")
    xw = spark.createDataFrame([("01001", "A", "a"), ("01003", "A", "a"), ("02001", "B", "b")], "fips string, cbsafp string, name string")
    assert {r["cbsafp"]: r["pm25"] for r in Q.area_quality(df, xw, ["y1", "y2"]).collect()} == {"A": 2.0, "B": None}


def test_clean_names_never_repeat(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`a` int, `A b` int, `a_b` int, `a_b_2` int")
    names = P.clean_names(df).columns
    assert len(set(names)) == 4 and names[:3] == ["a", "a_b", "a_b_2"]


NAN, INF = float("nan"), float("inf")


def test_distance_of_unknown_places(spark):
    rows = [(NAN, 0.0), (INF, 0.0), (None, 0.0), (0.0, NAN)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert all(r[0] is None for r in df.select(haversine_km(F.col("a"), F.lit(0.0), F.lit(0.0), F.col("b"))).collect())


@pytest.mark.parametrize("bad", [NAN, INF, -INF])
def test_unknown_values_are_not_known_days(spark, bad):
    rows = [("p", f"2020-01-{d:02d}", bad if d > 5 else 1.0) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "e string, d string, v double").withColumn("d", F.col("d").cast("date"))
    assert [r["known"] for r in A.yearly_coverage(df, "e", "d", "v").collect()] == [5]


@pytest.mark.parametrize("bad", [NAN, INF])
def test_models_leave_unknown_values_out(spark, bad):
    rows = [("p", x, 2000, 2.0 * x) for x in range(1, 9)] + [("p", 9, 2000, bad), ("p", 10, 2000, None)]
    df = spark.createDataFrame(rows, "e string, yday int, year int, v double")
    linear = {r["yday"]: r["predicted"] for r in impute_linear(df, ["e"], "v").collect()}
    assert linear == {9: pytest.approx(18.0), 10: pytest.approx(20.0)}
    nearest = {r["yday"]: r["predicted"] for r in impute_knn(df, ["e"], "v", k=2).collect()}
    assert nearest == {9: 15.0, 10: 15.0}


@pytest.mark.parametrize("bad", [NAN, INF, None])
def test_classes_of_unknown_values(spark, bad):
    df = spark.createDataFrame([(bad, bad, bad, bad, bad, bad, bad)], "lo double, hi double, mid double, p double, s double, r double, w double")
    day = C.classify_day(df, low="lo", high="hi", prcp="p", sndp="s", rain="r", snow="w").first()
    assert day["class"] == "pleasant"
    bands = C.classify_bands(df, low="lo", high="hi", mean="mid", prcp="p", sndp="s", rain="r", snow="w").first()
    assert (bands["temp_class"], bands["weather_class"], bands["double_class"]) == ("unknown", "unknown", "unknown")
    flags = C.classify_flags(df, low="lo", high="hi", mean="mid", prcp="p", sndp="s", rain="r", snow="w", wind="p").first()
    assert flags["hot"] is None and flags["pleasant"] is None
    strict = C.classify_strict(df, low="lo", high="hi", mean="mid", prcp="p", sndp="s", element="r").first()
    assert strict["hot"] is None and strict["elements"] is None


def test_world_limits(spark):
    df = spark.createDataFrame([(10.0, 29.0, 4.0), (10.0, 31.0, 0.0), (10.0, 20.0, 2.9)], "lo double, hi double, p double")
    df = df.withColumns({c: F.lit(0.0) for c in ("s", "r", "w")})
    names = dict(low="lo", high="hi", prcp="p", sndp="s", rain="r", snow="w")
    assert [r["class"] for r in C.classify_day(df, C.WORLD_LIMITS, **names).collect()] == ["elements", "hot", "pleasant"]
    assert [r["class"] for r in C.classify_day(df, **names).collect()] == ["hot", "hot", "pleasant"]
