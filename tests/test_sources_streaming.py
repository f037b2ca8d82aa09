"""Readers on small files, and streams against their batch results."""

from pyspark.sql import functions as F

from tripspark import sources, streaming
from tripspark.operators.sync import upsert
from tripspark.sources.files import build_city_catalog

#: Three ways of relation 70, of which one is relation 71's too; a way without tags of its own; one node that is missing; a
#: reference whose network is a state's own smaller one.
OSM = """<osm>
<node id="11" lat="-19.5" lon="-44.1"/><node id="12" lat="-19.6" lon="-44.2"/><node id="13" lat="-19.7" lon="-44.2"/><node id="14" lat="-19.8" lon="-44.4"/><node id="15" lat="-19.9" lon="-44.5"/>
<way id="500"><nd ref="11"/><nd ref="12"/></way>
<way id="501"><nd ref="12"/><nd ref="404"/><nd ref="13"/><tag k="ref" v="MG-10;LMG 808"/></way>
<way id="502"><nd ref="13"/><nd ref="14"/><tag k="highway" v="primary"/></way>
<way id="503"><nd ref="404"/><nd ref="15"/><tag k="ref" v="MG-10"/></way>
<relation id="70"><member type="way" ref="500" role="forward"/><member type="way" ref="501" role=""/><member type="way" ref="502" role=""/><tag k="type" v="route"/><tag k="route" v="road"/><tag k="ref" v="40"/><tag k="network" v="BR"/></relation>
<relation id="71"><member type="way" ref="502" role=""/><member type="node" ref="15" role="stop"/><tag k="type" v="route"/><tag k="route" v="road"/><tag k="ref" v="135"/><tag k="network" v="BR:MG"/></relation>
</osm>"""


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_osm_to_road_catalog(spark, tmp_path):
    nodes, ways, relations = sources.read_osm(spark, put(tmp_path, "x.osm", OSM))
    keys = sources.relation_member_keys(ways, relations)
    both = [(500, "BR|BR|40"), (501, "BR|BR|40"), (501, "BR|LMG|808"), (501, "BR|MG|10"), (502, "BR|BR|40"), (502, "BR|MG|135"), (503, "BR|MG|10")]
    assert sorted(map(tuple, keys.collect())) == both
    catalog = sources.build_road_catalog(keys, sources.assemble_way_lines(ways, nodes))
    got = {r["key"]: (r["n_lines"], r["n_points"], r["network"]) for r in catalog.collect()}
    assert got == {"BR|BR|40": (3, 6, "BR"), "BR|LMG|808": (1, 2, "LMG"), "BR|MG|10": (1, 2, "MG"), "BR|MG|135": (1, 2, "MG")}
    bad = sources.write_partitioned_catalog(catalog.select("key", "km").union(spark.createDataFrame([("BR|x", 1.0)], "key string, km double")), str(tmp_path / "catalog"))
    assert [r["key"] for r in bad.collect()] == ["BR|x"]
    assert spark.read.json(str(tmp_path / "catalog")).filter("country = 'br' and network = 'mg'").count() == 2


def test_gazetteers(spark, tmp_path):
    row = lambda i, code, pop, cls="P": "\t".join([str(i), f"Name {i}", "", "", "-20.123456", "-47.5", cls, code, "BR", "", "27", "", "", "", str(pop), "", "", "", "2020"])
    g = sources.read_geonames(spark, put(tmp_path, "g.txt", "\n".join([row(1, "PPLA", 0), row(2, "PPL", 500), row(3, "PPL", 5000), row(4, "PPLA", 9, "S"), "short\trow"])))
    assert g.count() == 4
    cities = build_city_catalog(g, sources.read_admin1(spark, put(tmp_path, "a.txt", "BR.27\tSão Paulo\tSao Paulo\t1\nAR.01\tX\tX\t2")))
    assert sorted((r["place_id"], r["lat"], r["region"]) for r in cities.collect()) == [(1, -20.12346, "São Paulo"), (3, -20.12346, "São Paulo")]
    m = sources.read_municipalities(spark, put(tmp_path, "m.csv", "codigo_ibge,nome,latitude,longitude,capital,codigo_uf,siafi_id,ddd,fuso_horario\n3550308,São Paulo,-23.5,-46.6,1,35,1,11,x\n1,,1,1,0,35,1,1,x\n2,X,,1,0,35,1,1,x"))
    assert [(r["name"], r["capital"], r["uf"], r["state"]) for r in m.collect()] == [("São Paulo", True, "SP", "São Paulo")]
    a = sources.read_airports(spark, put(tmp_path, "p.csv", 'type,name,latitude_deg,longitude_deg,iso_country,iso_region,municipality,scheduled_service,gps_code,iata_code\nlarge_airport,"A ""B"", C",-23,-46,BR,BR-SP,Guarulhos,yes,SBGR,GRU\nheliport,X,1,1,BR,BR-SP,Y,yes,Z,ZZZ\nsmall_airport,X,1,1,BR,BR-SP,Y,no,Z,YYY'))
    assert [(r["iata"], r["name"], r["kind_rank"]) for r in a.collect()] == [("GRU", 'A "B", C', 1)]


def test_trips_and_catalogs(spark, tmp_path):
    t = sources.read_trips(spark, put(tmp_path, "t.json", '{"id":"1","mode":"carro","date":"2024-01-01","roadLabels":["br 153","SP-300"],"conquests":{"roads":["SP 300","MG-050"]},"roadSegments":{"br 153":[[[1,2],[3,4]]],"BR-153":[[[5,6],[7,8]]]}}\n{"mode":"aviao"}')).orderBy("mode").collect()
    assert t[1]["roads"] == ["BR-153", "SP-300", "MG-050"] and t[1]["createdAt"] == "2024-01-01" and len(t[1]["roadSegments"]["BR-153"]) == 2
    assert t[0]["id"] and t[0]["stopPlaces"] == [] and t[0]["roads"] == [] and t[0]["visible"]
    backup = sources.read_trips(spark, str(tmp_path / "t.json"))
    sources.export_backup(backup, str(tmp_path / "backup"))
    assert sources.import_backup(spark, str(tmp_path / "backup"), False).count() == 2
    for name, text in (("list.json", '[{"id":"a"},{"id":"b"}]'), ("envelope.json", '{"trips":[{"id":"a"},{"id":"b"}]}')):
        assert sorted(r["id"] for r in sources.import_backup(spark, put(tmp_path, name, text)).collect()) == ["a", "b"]
    (tmp_path / "roads").mkdir()
    put(tmp_path / "roads", "1.json", '{"key":"BR|SP|1","cacheVersion":"v1","partial":false,"totalKm":1.5,"encodedLines":["_p~iF~ps|U_ulLnnqC"]}')
    put(tmp_path / "roads", "2.json", '{"key":"BR|SP|2","cacheVersion":"v1","partial":true,"encodedLines":["_p~iF~ps|U_ulLnnqC"]}')
    put(tmp_path / "roads", "3.json", '{"key":"BR|SP|3","cacheVersion":"v1","encodedLines":["_"]}')
    good, bad = sources.read_road_catalog(spark, str(tmp_path / "roads"), "v1")
    assert [r["key"] for r in good.collect()] == ["BR|SP|1"] and bad.count() == 2


def test_streams_equal_batches(spark, tmp_path):
    schema = "id long, content string, updated_at long"
    rows = [[(1, "a", 5), (2, "b", 5)], [(1, "c", 3), (2, "d", 9), (3, "e", 1), (3, "f", 2)], [(1, "g", 5)]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = streaming.read_changes(spark, str(tmp_path / "in"), schema, 1)
    streaming.stream_upserts(changes, str(tmp_path / "table"), str(tmp_path / "cp"), ["id"]).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: (r["content"], r["updated_at"]) for r in streaming.read_table(spark, str(tmp_path / "table")).collect()}
    want = {r["id"]: (r["content"], r["updated_at"]) for r in upsert(spark.createDataFrame([], schema), spark.createDataFrame([x for r in rows for x in r if x[2:] != (5,) or x[1] != "a"], schema), ["id"]).collect()}
    assert got.keys() == want.keys() and got[2] == ("d", 9) and got[3] == ("f", 2) and got[1][1] == 5
    spark.createDataFrame([(1, "x", 10, 1), (1, "x", 11, 2), (2, "x", 12, 3)], "user_id long, item_key string, trip_id long, trip_date long").write.parquet(str(tmp_path / "won"))
    first = streaming.stream_first_arrivals(spark.readStream.schema("user_id long, item_key string, trip_id long, trip_date long").parquet(str(tmp_path / "won")))
    first.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp2")).option("path", str(tmp_path / "first")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "first")).count() == 2
    table = spark.read.parquet(str(tmp_path / "won"))
    again = streaming.first_by_time(table.limit(0), table.withColumn("trip_date", -F.col("trip_date")), ["user_id", "item_key"])
    assert sorted((r["user_id"], r["trip_id"]) for r in again.collect()) == [(1, 11), (2, 12)]
