"""Readers and writers on small files."""

from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F, types as T

from geoscore.plans.catalog import QUERIES
from geoscore.sources import archives, delimited, fixed_width, polygons, sinks


def test_daily_record(spark, tmp_path):
    path = tmp_path / "a.op"
    line = (
        "030050 99999  20180115  " + "  41.4 24  " + "  36.1 24  " + "9999.9  0  " + "9999.9  0  "
        + "  6.2  6  " + " 17.6 24  " + " 28.0  " + "999.9  " + "  44.1" + "* " + "9999.9" + "  " + " 0.12" + "G" + " 999.9  " + "010010"
    )
    path.write_text("STN--- WBAN   YEARMODA    TEMP\n" + line + "\n")
    row = fixed_width.read_daily_records(spark, str(path)).first().asDict()
    assert (row["stn"], row["wban"], str(row["date"])) == ("030050", "99999", "2018-01-15")
    assert (row["temp"], row["temp_cnt"], row["slp"], row["wdsp"], row["mxspd"]) == (41.4, 24, None, 17.6, 28.0)
    assert (row["gust"], row["max"], row["max_flag"], row["min"]) == (None, 44.1, "*", None)
    assert (row["prcp"], row["prcp_flag"], row["sndp"], row["frshtt"]) == (0.12, "G", None, "010010")


def test_station_history_skips_headers(spark, tmp_path):
    path = tmp_path / "history.txt"
    line = "723860 23169 " + "MC CARRAN INTL AIRPORT".ljust(29) + " " + "US   NV KLAS  +36.072 -115.163 -999.0  19730101 20200101"
    path.write_text("Integrated list\n\nNotes: 20 lines\nUSAF   WBAN  STATION NAME\n" + line + "\n")
    row = fixed_width.read_station_history(spark, str(path)).collect()
    assert len(row) == 1
    got = row[0].asDict()
    assert (got["usaf"], got["wban"], got["station"], got["ctry"], got["st"], got["call"]) == ("723860", "23169", "MC CARRAN INTL AIRPORT", "US", "NV", "KLAS")
    assert (got["lat"], got["lon"], got["elev"], str(got["begin"])) == (36.072, -115.163, None, "1973-01-01")


def test_csv_types_and_null_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('AA,\\N,1.5,2020-01-02\nBB,"x, y",oops,\\N\n')
    schema = T.StructType.fromDDL("a STRING, b STRING, c DOUBLE, d DATE")
    got = delimited.read_table_csv(spark, str(path), schema, ("\\N", ""), header=False).collect()
    assert [(r["a"], r["b"], r["c"], str(r["d"])) for r in got] == [("AA", None, 1.5, "2020-01-02"), ("BB", "x, y", None, "None")]


def test_latin1_and_json_array(spark, tmp_path):
    tsv, js = tmp_path / "t.tsv", tmp_path / "t.json"
    tsv.write_bytes("1\t Málaga \t9\n".encode("latin-1"))
    js.write_text(json.dumps([{"city": "A", "latitude": 1.5}, {"city": "B", "rank": "2"}], indent=1))
    assert tuple(delimited.read_tsv_latin1(spark, str(tsv), T.StructType.fromDDL("i INT, n STRING, x INT"), ["i", "n"]).first()) == (1, "Málaga")
    got = delimited.read_json_records(spark, str(js), T.StructType.fromDDL("city STRING, latitude DOUBLE, rank STRING")).collect()
    assert [tuple(r) for r in got] == [("A", 1.5, None), ("B", None, "2")]


def test_station_years_reads_wanted_files_only(spark, tmp_path):
    for year in (2001, 2002, 2003):
        for station in ("111", "222"):
            (tmp_path / str(year)).mkdir(exist_ok=True)
            (tmp_path / str(year) / f"{station}.csv").write_text(f"v\n{year}.5\n")
    schema = T.StructType.fromDDL("v DOUBLE")
    want = [(2001, "222", 2001.5), (2003, "222", 2003.5)]
    for stations in (["222", "999"], spark.createDataFrame([("222",), ("999",)], "s string")):
        got = archives.read_station_years(spark, str(tmp_path), [2001, 2003], schema, stations)
        assert sorted(map(tuple, got.collect())) == want


def test_archives_from_disk(spark, tmp_path):
    for year in (2001, 2002):
        with tarfile.open(tmp_path / f"{year}.tar.gz", "w:gz") as tar:
            for station in ("a", "b"):
                data = f"{year}{station} one\n{year}{station} two\n".encode()
                info = tarfile.TarInfo(f"./{station}.op")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    got = archives.expand_archives(spark, str(tmp_path / "*.tar.gz"))
    assert sorted(r["line"] for r in got.collect()) == sorted(f"{y}{s} {n}" for y in (2001, 2002) for s in "ab" for n in ("one", "two"))
    assert got.where(F.col("line_no") == 2).count() == 4


def test_feature_collection(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    features = [
        {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [ring, ring]}},
        {"type": "Feature", "properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
    ]
    whole, lines = tmp_path / "w.json", tmp_path / "l.json"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=2))
    lines.write_text("\n".join(json.dumps(f) for f in features))
    attributes = T.StructType.fromDDL("name STRING")
    for path, split in ((whole, False), (lines, True)):
        got = {r["name"]: r["rings"] for r in polygons.read_polygons(spark, str(path), attributes, split).collect()}
        assert len(got["p"]) == 2 and len(got["m"]) == 3 and got["p"][0][1]["x"] == 1.0


def test_chunks_and_union(spark, tmp_path):
    out = str(tmp_path / "chunks")
    sinks.write_chunked(spark.range(95).coalesce(1), out, 20)
    sizes = [sum(1 for _ in open(p)) - 1 for p in (tmp_path / "chunks").glob("part-*.csv")]
    assert sum(sizes) == 95 and max(sizes) <= 20
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("id,y\n3,4\n")
    got = delimited.read_union(spark, {str(tmp_path / "a.csv"): T.StructType.fromDDL("id INT, x INT"), str(tmp_path / "b.csv"): T.StructType.fromDDL("id INT, y INT")})
    assert sorted(map(tuple, got.collect())) == [(1, 2, None), (3, None, 4)]


def test_snapshot_ends_lineage(spark, tmp_path):
    saved = sinks.snapshot(spark.range(10).withColumn("x", F.col("id") * 2), str(tmp_path / "s"))
    assert saved.agg(F.sum("x")).first()[0] == 90
    assert "Range" not in saved._jdf.queryExecution().optimizedPlan().toString()


def test_only_wanted_station_files_are_read(spark, tmp_path):
    """The scan counts the files it reads; a long list falls back to a semi-join with the same rows."""
    from geoscore.sources.archives import read_station_years

    root = str(tmp_path / "years")
    spark.range(90).select((F.col("id") % 3 + 1996).alias("year"), (F.col("id") % 30).alias("station"), "id").repartition("year", "station") \
        .write.partitionBy("year", "station").option("header", True).csv(root)

    def files(df):
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        while not plan.metrics().contains("numFiles"):
            plan = plan.children().apply(0) if plan.children().size() else plan.executedPlan()
        return plan.metrics().apply("numFiles").value()

    how = {"schema": T.StructType.fromDDL("id BIGINT"), "layout": r"/year=(\d+)/station=([^/]+)/", "folder": "{root}/year={year}/*"}
    wanted = spark.createDataFrame([("1",), ("2",), (None,), ("2",), ("missing",)], "id string")
    named = read_station_years(spark, root, [1996, 1997], stations=wanted, **how)
    rows = sorted((r["year"], r["station"], r["id"]) for r in named.collect())
    assert rows == sorted((1996 + i % 3, str(i % 30), i) for i in range(90) if i % 30 in (1, 2) and i % 3 < 2)
    assert files(named) == len({r[:2] for r in rows}) == files(read_station_years(spark, root, [1996, 1997], stations=["1", "2"], **how))
    joined = read_station_years(spark, root, [1996, 1997], stations=wanted, most=1, **how)
    assert sorted((r["year"], r["station"], r["id"]) for r in joined.collect()) == rows


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_json_arrays_are_split(spark, tmp_path, size):
    """One large array in small splits: nested objects, brackets and quotes in strings, several arrays a file."""
    words = ["plain", "}", "{", "]}", '"', '\\', '\\"', '"}', "[{", "a}b{c", "é}ü", "\n}", ""]
    rows = [{"id": i, "s": words[i % len(words)] * (i % 4), "in": {"a": words[(i * 7) % len(words)], "l": [{"k": "}"}] * (i % 3)}} for i in range(150)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(rows[:80], ensure_ascii=False))
    (tmp_path / "in" / "two.json").write_text(json.dumps(rows[80:100], indent=2) + "\n[]\n" + json.dumps(rows[100:]) + "\n")
    (tmp_path / "in" / "none.json").write_text(" [ ] ")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        schema = T.StructType.fromDDL("id BIGINT, s STRING, `in` STRUCT<a: STRING, l: ARRAY<STRUCT<k: STRING>>>")
        got = delimited.read_json_array(spark, str(tmp_path / "in"), schema).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.asDict(True) for r in got), key=lambda r: r["id"]) == rows


def test_archive_members_hold_a_station_s_lines_together(spark, tmp_path, monkeypatch):
    spark.range(30_000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), (F.col("id") % 3_000).alias("l_suppkey"), F.lit(2.0).alias("l_quantity")
    ).repartition(2).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    plain = archives.expand_archive_rows
    monkeypatch.setattr(archives, "expand_archive_rows", lambda packed: seen.append(plain(packed)) or seen[-1])
    got = QUERIES["expand_archives"](spark, str(tmp_path))
    assert got.count() == 30_000 and got.where("member != concat('s', l_orderkey % 3000, '.op')").isEmpty()
    # A new member begins with line 1. Only a station at the end of a range or of an archive is cut.
    assert seen[0].where("line_no = 1").count() < 3_200


def test_lines_of_a_long_member_are_numbered_on(spark):
    body = io.BytesIO()
    with tarfile.open(fileobj=body, mode="w:gz") as tar:
        for name, text in (("a", "x\r\n" * 120_000), ("none", ""), ("b", "\nlast")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    rows = archives.expand_archive_rows(spark.createDataFrame([("p", bytearray(body.getvalue()))], "path string, content binary"))
    a = rows.where("archive = 'p' AND member = 'a' AND line = 'x'").agg(F.countDistinct("line_no"), F.min("line_no"), F.max("line_no")).first()
    assert tuple(a) == (120_000, 1, 120_000) and rows.count() == 120_002
    assert sorted(map(tuple, rows.where("member = 'b'").select("line_no", "line").collect())) == [(1, ""), (2, "last")]
