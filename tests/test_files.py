"""Sources, sinks, resumable output, streams."""

import collections
import datetime
import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork import schema as S
from rillwork.functions import geometry as G
from rillwork.operators import clean as C
from rillwork.sources import layers as Y
from rillwork.sources import sinks as K
from rillwork.sources import tables as R
from rillwork.streaming import results as X


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3\n4,5,6\n7,8\n"x, ""y""",9\n')
    rows = R.read_csv_tolerant(spark, [str(tmp_path / "none.csv"), str(tmp_path / "a.csv")])
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [("1", "2"), ("3", None), ("7", "8"), ('x, "y"', "9")], key=str)
    only = R.read_csv_tolerant(spark, str(tmp_path / "a.csv"), ["b", "absent"])
    assert only.columns == ["b"] and only.count() == 4
    with pytest.raises(FileNotFoundError):
        R.read_csv_tolerant(spark, str(tmp_path / "none.csv"), ["a"])


def test_latest_files(spark, tmp_path):
    header = ",".join(R.LATEST_COLUMNS)
    (tmp_path / "temperature_water_latest.csv").write_text(f"{header}\ns1,7.5,40,-80,01010101,010101010101\ns2,<1,40,-80,1,2\n")
    (tmp_path / "iron_latest.csv").write_text(f"{header}\ns1,2,40,-80,01010101,010101010101\n")
    rows = R.read_latest(spark, str(tmp_path))
    got = sorted((r.SiteID, r[S.ANALYTE], r[S.VALUE], r.HUC12) for r in rows.collect())
    assert got == [("s1", "Iron", 2.0, "010101010101"), ("s1", "Temperature_Water", 7.5, "010101010101")]
    (tmp_path / "ph_latest.csv").write_text(f"{S.VALUE},x,{S.SITE}\n6.5,1,s9\n")
    (tmp_path / "odd_latest.csv").write_text("x,y\n1,2\n")
    with pytest.warns(UserWarning, match="odd"):
        more = R.read_latest(spark, str(tmp_path))
    assert {(r.SiteID, r[S.VALUE], r.HUC12) for r in more.where(f"{S.ANALYTE} = 'Ph'").collect()} == {("s9", 6.5, None)}
    with pytest.raises(FileNotFoundError):
        R.read_latest(spark, str(tmp_path / "none"))


def test_geojson_collection_of_every_type(spark, tmp_path):
    shapes = {
        "Point": [1, 2], "MultiPoint": [[1, 2], [3, 4]], "LineString": [[0, 0], [1, 1]],
        "MultiLineString": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]],
        "Polygon": [[[0, 0], [1, 0], [1, 1], [0, 0]]],
        "MultiPolygon": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]],
    }
    features = [{"type": "Feature", "geometry": {"type": t, "coordinates": c}, "properties": {"id": t, "n": 1}}
                for t, c in shapes.items()]
    features.append({"type": "Feature", "geometry": None, "properties": {"id": "none"}})
    (tmp_path / "mix.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = Y.read_geojson(spark, str(tmp_path / "mix.geojson"), "mix", "id", lines=False)
    got = {r.feature_id: r.parts for r in rows.collect()}
    assert got["Point"] == [[[1, 2]]] and got["MultiPoint"] == [[[1, 2]], [[3, 4]]]
    assert got["LineString"] == [[[0, 0], [1, 1]]] and got["Polygon"] == shapes["Polygon"]
    assert got["MultiPolygon"] == [s[0] for s in shapes["MultiPolygon"]] and got["none"] is None
    # Written out and read again the layer is the same.
    K.write_geojson(rows.drop("layer"), str(tmp_path / "again"))
    again = Y.read_geojson(spark, str(tmp_path / "again"), "mix", "feature_id")
    assert {r.feature_id: r.parts for r in again.collect()} == got
    every = Y.read_layers(spark, str(tmp_path / "*.geojson"), "id", lines=False)
    assert {r.layer for r in every.collect()} == {"mix"}


def _layout(rng, value):
    """JSON of a value with blanks and line breaks at random places."""
    gap = lambda: rng.choice(["", "", " ", "\n", "\r\n  "])
    if isinstance(value, dict):
        return "{" + ",".join(f"{gap()}{json.dumps(k)}{gap()}:{gap()}{_layout(rng, v)}" for k, v in value.items()) + gap() + "}"
    if isinstance(value, list):
        return "[" + ",".join(gap() + _layout(rng, v) for v in value) + gap() + "]"
    return json.dumps(value, ensure_ascii=False)


@pytest.mark.parametrize("size", [150, 5000])
def test_collections_of_any_layout_are_split(spark, tmp_path, size):
    rng = random.Random(size)
    texts = ["}", "{", '"', "\\", "\\\\", '"}', "a } b", '\\"{', "é}", '"features":[{', "plain", "]", ""]
    expected = collections.Counter()
    for number in range(2):
        whole = ""
        for _ in range(rng.randint(1, 3)):
            features = []
            for _ in range(rng.randint(0, 30)):
                properties = {"t": "".join(rng.choices(texts, k=rng.randint(0, 4))), "deep": {"features": [{"type": "Feature"}, {}]}}
                shape = rng.choice([None, {"type": "Point", "coordinates": [rng.randint(0, 9), 1]}])
                features.append({"type": "Feature", "properties": properties, "geometry": shape, "id": str(rng.randint(0, 99))})
                expected[f"f{number}", features[-1]["id"], properties["t"], shape and float(shape["coordinates"][0])] += 1
            other = {"name": rng.choice(texts), "crs": {"type": "Feature", "id": "no"}}
            after = {"list": ["a}b", {"type": "Feature", "id": "no"}], rng.choice(texts) + "x": {"type": "Feature", "id": "no"}, "n": 1}
            whole += rng.choice(["", "\n"]) + _layout(rng, other | {"features": features} | after)
        (tmp_path / f"f{number}.geojson").write_bytes((whole + rng.choice(["", "\n"])).encode())
    (tmp_path / "empty.geojson").write_text("")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = Y.read_layers(spark, str(tmp_path / "*.geojson"), lines=False).collect()
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "f*.geojson")).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    assert collections.Counter((r.layer, r.feature_id, r.properties["t"], r.parts and r.parts[0][0][0]) for r in rows) == expected


def test_torn_collections_are_errors(spark, tmp_path):
    good = '{"type":"FeatureCollection","features":[{"type":"Feature","id":"1","properties":{},"geometry":null}]}'
    bad = {"cut": good[:-30], "string": good[:-2] + ',"x": "}', "surplus": good + "}" + good, "bare": json.dumps(
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}})}
    for name, text in bad.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match="not closed|too many|outside of a collection"):
            Y.read_geojson(spark, str(tmp_path / f"{name}.json"), "x", lines=False).collect()
    (tmp_path / "good.json").write_text("\ufeff" + good)
    assert [r.feature_id for r in Y.read_geojson(spark, str(tmp_path / "good.json"), "x", lines=False).collect()] == ["1"]


def test_collection_with_a_feature_to_a_line_is_split(spark, tmp_path):
    point = '{ "type": "Feature", "id": 7, "properties": { "n": 1 }, "geometry": { "type": "Point", "coordinates": [ 1.0, 2.0 ] } }'
    both = ('{"type":"Feature","properties":{},"geometry":{"type":"GeometryCollection","geometries":['
            '{"type":"Point","coordinates":[3,4]},{"type":"LineString","coordinates":[[0,0],[1,1]]}]},"id":"c"}')
    text = "\n".join([
        "{", '"type": "FeatureCollection",', '"name": "x",',
        '"crs": { "type": "name", "properties": { "name": "urn:ogc:def:crs:OGC:1.3:CRS84" } },', '"features": [', point + ",", both, "]", "}", ""])
    path = tmp_path / "split.geojson"
    path.write_text(text)
    for lines in (True, False):
        got = {r.feature_id: (r.geometry_type, r.parts) for r in Y.read_geojson(spark, str(path), "x", lines=lines).collect()}
        assert got == {"7": ("Point", [[[1, 2]]]), "c#0": ("Point", [[[3, 4]]]), "c#1": ("LineString", [[[0, 0], [1, 1]]])}
    # One line that holds the whole collection is a feature table too; anything else is an error.
    path.write_text('{"type":"FeatureCollection","features":[' + point + "," + both + "]}")
    assert Y.read_geojson(spark, str(path), "x").count() == 3
    for broken in (json.dumps(json.loads(point), indent=1), point[:-2], '{"type":"FeatureCollection","features":[' + point + ","):
        path.write_text(broken)
        with pytest.raises(Exception, match="one feature per line"):
            Y.read_geojson(spark, str(path), "x").collect()


def test_multipolygon_keeps_its_holes(spark, tmp_path):
    def ring(a, b):
        return [[a, a], [b, a], [b, b], [a, b], [a, a]]

    shape = [[ring(0, 4), ring(1, 2)], [ring(10, 12)]]
    (tmp_path / "m.geojson").write_text(json.dumps(
        {"type": "Feature", "id": "m", "geometry": {"type": "MultiPolygon", "coordinates": shape}, "properties": {}}))
    rows = Y.read_geojson(spark, str(tmp_path / "m.geojson"), "x")
    assert rows.first().polygon_of == [0, 0, 1]
    K.write_geojson(rows.drop("layer"), str(tmp_path / "again"))
    text = "".join(p.read_text() for p in (tmp_path / "again").glob("part-*"))
    assert json.loads(text)["geometry"]["coordinates"] == shape
    c = rows.select(G.centroid(F.col("parts"), F.col("polygon_of")).alias("c")).first().c
    # Areas 16 - 1 + 4, whatever way the hole is wound.
    assert c.x == pytest.approx((16 * 2 - 1.5 + 4 * 11) / 19)


def test_missing_layer_is_empty(spark, tmp_path):
    with pytest.warns(UserWarning):
        rows = Y.read_geojson(spark, str(tmp_path / "none.geojson"), "x")
    assert rows.count() == 0 and rows.schema == S.FEATURE
    with pytest.warns(UserWarning):
        assert not K.write_geojson(spark.range(1), str(tmp_path / "out"))


def test_bad_pages_are_skipped(spark, tmp_path):
    page = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"id": "a"}}]})
    (tmp_path / "1.json").write_text(page)
    (tmp_path / "2.json").write_text(page[:-20])
    (tmp_path / "3.json").write_text(page.replace('"a"', '"b"'))
    rows = Y.read_feature_pages(spark, str(tmp_path / "*.json"), "x", "id")
    assert sorted(r.feature_id for r in rows.collect()) == ["a", "b"]


def test_result_columns_go_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"extra,{S.VALUE},{S.SITE}\nq,1.5,s1\n")
    row = R.read_results(spark, str(tmp_path / "a.csv")).first()
    assert (row[S.SITE], row[S.VALUE], row["extra"]) == ("s1", "1.5", "q")


def test_broken_result_lines_are_errors(spark, tmp_path):
    (tmp_path / "break.csv").write_text(f'{S.SITE},{S.VALUE}\n1,"x\ny"\n2,z\n')
    whole = R.read_results(spark, str(tmp_path / "break.csv"), multi_line=True)
    assert sorted(map(tuple, whole.collect())) == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "over.csv").write_text(f"{S.SITE},{S.VALUE}\n3,4,5\n")
    for name in ("break", "over"):
        with pytest.raises(Exception, match="(?i)malformed"):
            R.read_results(spark, str(tmp_path / f"{name}.csv")).collect()
    assert tuple(R.tolerant_counts(spark, str(tmp_path / "over.csv")).first()) == (0, 1)


def test_null_keys_are_done_too(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    path = str(tmp_path / "done")
    for _ in range(2):
        assert K.append_missing(rows, path, ["k"]).count() == 2


def test_unfinished_output_is_built_again(spark, tmp_path):
    (tmp_path / "t" / "_temporary").mkdir(parents=True)
    assert R.cached_table(spark, str(tmp_path / "t"), lambda: spark.range(3)).count() == 3


def test_csv_of_nested_columns(spark, tmp_path):
    rows = spark.range(1).select("id", F.create_map(F.lit("a"), F.lit("b")).alias("properties"))
    K.write_csv(rows, str(tmp_path / "out"))
    assert R.read_csv(spark, str(tmp_path / "out")).first()["properties"] == '{"a":"b"}'


def test_dimension_and_cache(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    with pytest.warns(UserWarning):
        assert R.read_dimension(spark, str(tmp_path / "none.csv"), schema).count() == 0
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    for _ in range(2):
        assert R.cached_table(spark, path, build).count() == 3
    assert len(calls) == 1


def test_canonical_columns(spark):
    rows = spark.createDataFrame([("1", "2", "x")], ["Lat", "LongitudeMeasure", "other"])
    assert R.canonicalise(rows, {"lat": S.LAT_NAMES, "lon": S.LON_NAMES}).columns == ["lat", "lon"]
    with pytest.raises(ValueError):
        R.canonicalise(rows, {"id": S.ID_NAMES}, ["id"])
    columns = ["Flow_dist", "Bituminous_dist_m", "AML_dist_m"]
    assert R.find_column(columns, S.DISTANCE_NAMES, ["dist"]) == "AML_dist_m"
    assert R.find_column(columns[:1], S.DISTANCE_NAMES, ["dist"]) == "Flow_dist"


def test_resume_equals_fresh_run(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "out")
    K.append_missing(rows.where("id < 40"), path, ["id"])
    done = K.append_missing(rows, path, ["id"])
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, rows.collect()))
    assert K.append_missing(rows, path, ["id"]).count() == 100


def _write_arrivals(folder):
    folder.mkdir()
    header = ",".join(S.RESULT_COLUMNS)
    for i in range(3):
        lines = [f"org,s{j % 4},name,Stream,2020-01-0{i + 1},40,-80,{'Iron' if j % 2 else 'Zinc'},{j}.5,mg/l" for j in range(6)]
        (folder / f"{i}.csv").write_text("\n".join([header, *lines, lines[0], "org,s0,name,Stream,2020-01-09,40,-80,Iron,1,mg/l"]) + "\n")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    _write_arrivals(folder)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        source = R.read_results(spark, str(folder), stream=True, files_per_batch=1)
        X.stream_clean(source, out, state).awaitTermination()
    batch = C.clean_results(R.read_results(spark, str(folder)))
    stream = spark.read.parquet(f"{out}/clean")
    assert sorted(map(tuple, stream.select(*[f"`{c}`" for c in batch.columns]).collect())) == sorted(map(tuple, batch.collect()))
    subset = X.settled(spark.read.parquet(f"{out}/subset"))
    assert {r[S.ANALYTE] for r in subset.collect()} == {"Iron"}
    assert len(list((tmp_path / "out" / "clean").glob("batch=*"))) == 3


def test_stream_dedup_counts_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    spec = "k string, at timestamp"
    batches = [[("a", "2020-01-10 00:00:00"), ("a", "2020-01-10 01:00:00"), ("b", "2020-01-10 00:00:00")],
               [("c", "2020-01-20 00:00:00")],
               [("late", "2020-01-01 00:00:00"), ("c", "2020-01-20 00:30:00")]]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    dropped = 0
    for rows in batches:
        df = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(spec).parquet(str(folder))
        query = X.append_stream(X.stream_dedup(source, ["k"], "at", "1 day"), out, state)
        query.awaitTermination()
        dropped += X.dropped_late(query)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    assert dropped == 1


def test_stream_keeps_and_counts_every_row(spark, tmp_path):
    """More micro-batches than progress is kept for, against a plain run over them, with a restart in between."""
    hour = datetime.timedelta(hours=1)
    draw, start = random.Random(2), datetime.datetime(2020, 1, 1)
    batches = []
    for n in range(102):
        rows = [(draw.choice([f"k{draw.randrange(40)}", None]), start + (n - draw.choice([0, 0, 1, 5, 30])) * hour, n) for _ in range(draw.randint(1, 3))]
        batches.append(rows + [("no time", None, n)] * (n % 50 == 7))
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("n", T.IntegerType())])
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    (tmp_path / "in").mkdir()
    for part in (batches[:3], batches[3:]):
        for rows in part:
            table = pa.table({"k": pa.array([r[0] for r in rows], pa.string()), "at": pa.array([r[1] for r in rows], pa.timestamp("us", "UTC")),
                              "n": pa.array([r[2] for r in rows], pa.int32())})
            path = f"{folder}/{rows[0][2]:03}.parquet"
            pq.write_table(table, path)
            os.utime(path, (1.7e9 + rows[0][2],) * 2)  # files arrive in the order of their times
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        X.stream_dedup_kept(source, ["k"], "at", "10 hours", out, state).awaitTermination()
    fates, latest, held = collections.Counter(), None, {}
    for rows in batches:
        bound = latest and latest - 10 * hour
        fresh = {}
        for k, t, n in sorted((r for r in rows if r[1]), key=lambda r: r[1]):
            alive = k in held and (bound is None or any(at + 10 * hour > bound for at in held[k]))
            fate = "late" if bound and t <= bound else "copy" if alive or k in fresh else "kept"
            if fate == "kept":
                fresh[k] = t
            fates[n, fate] += 1
        fates[rows[0][2], "late"] += sum(r[1] is None for r in rows)
        for k, t in fresh.items():
            held.setdefault(k, []).append(t)
        latest = max([r[1] for r in rows if r[1]] + [latest] * bool(latest))
    got = {(r["n"], r["fate"]): r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("n", "fate").count().collect()}
    assert got == +fates and {f for _, f in got} == {"kept", "copy", "late"}
    total = spark.read.parquet(f"{out}/counts").where("batch = 101").first()
    assert total["total_kept"] + total["total_copy"] + total["total_late"] == sum(map(len, batches))


def test_chunks_are_replaced_and_hidden_until_finished(spark, tmp_path):
    path, by = str(tmp_path / "out"), ["layer", "chunk"]
    rows = K.with_chunks(spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), (F.col("id") % 3).cast("string"))).alias("layer")), ["id"], 3)
    rows = rows.fillna("none", ["layer"])
    with pytest.raises(FileNotFoundError):
        K.read_finished(spark, path, by)
    calls = []

    def compute(part):
        calls.append(sorted({(r["layer"], r["chunk"]) for r in part.collect()}))
        if len(calls) == 2:
            part.limit(1).withColumn("v", F.lit(-1)).write.mode("append").partitionBy(*by).parquet(path)
            raise InterruptedError
        return part.where("id <> 9").withColumn("v", F.col("id").cast("int"))

    with pytest.raises(InterruptedError):
        K.finish_chunks(rows, path, compute, by, at_once=4)
    early = K.read_finished(spark, path, by)
    assert {(r["layer"], r["chunk"]) for r in early.collect()} == set(calls[0]) and early.where("v < 0").count() == 0
    done = K.finish_chunks(rows, path, compute, by, at_once=4)
    assert sorted((r["id"], r["v"]) for r in done.collect()) == [(i, i) for i in range(60) if i != 9]
    assert len(calls) == 4 and calls[1] == calls[2]
    K.finish_chunks(rows, path, compute, by, at_once=4)
    assert len(calls) == 4


def test_clean_and_subset_files(spark, tmp_path):
    folder = tmp_path / "in"
    _write_arrivals(folder)
    K.write_clean_and_subset(R.read_results(spark, str(folder)), str(tmp_path / "c"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 19
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "s")).select(S.ANALYTE).collect()} == {"Iron"}
