"""Readers of GPX tracks and road catalogs: what is valid, and what is worked out where it is absent."""

import json
import math

import pytest

from tripspark import sources


def km(points):
    def one(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))

    return sum(one(a, b) for a, b in zip(points, points[1:]))


def encoded(points, precision=5):
    out, last = "", (0, 0)
    for p in points:
        now = tuple(round(x * 10**precision) for x in p)
        for step in (now[0] - last[0], now[1] - last[1]):
            z = -2 * step - 1 if step < 0 else 2 * step
            while z >= 32:
                out, z = out + chr((z & 31) + 95), z >> 5
            out += chr(z + 63)
        last = now
    return out


BEND = [(-20.0, -44.0), (-20.005, -44.00001), (-20.01, -44.0), (-20.01, -43.98)]


def test_official_tracks(spark, tmp_path):
    short = [(-20.0, -44.0), (-20.004, -44.0)]
    tracks = [("B", [BEND]), ("A", [BEND[::-1][:2], BEND[::-1][2:]]), ("Caminho para carro", [[(x, y + 1) for x, y in BEND]]), ("Trilha", [[(x, y + 2) for x, y in BEND]]), ("Curta", [short]), ("Vazia", []), ("Um", [BEND[:1]]), (None, [[(x, y + 3) for x, y in BEND]])]
    text = "".join("<trk>" + (f"<name>{n}</name>" if n else "") + "".join("<trkseg>" + "".join(f'<trkpt lat="{y}" lon="{x}"/>' for y, x in s) + "</trkseg>" for s in segments) + "</trk>" for n, segments in tracks)
    (tmp_path / "x.gpx").write_text(f'<gpx>{text}</gpx>')
    got = {r["name"]: r for r in sources.read_official_tracks(spark, str(tmp_path / "x.gpx")).collect()}
    kept = [BEND[0], BEND[2], BEND[3]]
    assert {n: (r["encoded"], r["n_points"]) for n, r in got.items()} == {"A": (encoded(kept[::-1]), 3), None: (encoded([(y, x + 3) for y, x in kept]), 3)}
    assert got["A"]["km"] == pytest.approx(km(kept), abs=1e-9)
    assert {r["name"] for r in sources.read_official_tracks(spark, str(tmp_path / "x.gpx"), least_km=0.4).collect()} == {"A", None, "Curta"}


def test_road_catalog_rules(spark, tmp_path):
    valid = {"kind": "road", "schema": "s1", "validationSchema": "v1", "cacheVersion": 7, "partial": False}
    two = [[(-20.0, -44.0), (-20.1, -44.2)], [(-21.0, -44.0), (-21.1, -44.0), (-21.1, -44.1)]]
    files = {
        "whole": valid | {"key": "whole", "totalKm": 9.5, "pointCount": 99, "precision": 5, "compactToleranceM": 15, "bounds": [[-21.1, -44.2], [-20.0, -44.0]], "encodedLines": [encoded(two[0])]},
        "absent": valid | {"key": "absent", "encodedLines": [encoded(x) for x in two] + ["_", None, encoded(two[0][:1]), ""]},
        "zero": valid | {"key": "zero", "totalKm": 0, "pointCount": 4, "precision": 6, "encodedLines": [encoded(x, 6) for x in two]},
        "kind": valid | {"key": "kind", "kind": "other", "encodedLines": [encoded(two[0])]}, "schema": valid | {"key": "schema", "schema": None, "encodedLines": [encoded(two[0])]},
        "old": valid | {"key": "old", "cacheVersion": 6, "encodedLines": [encoded(two[0])]}, "points": valid | {"key": "points", "encodedLines": [encoded(two[0][:1])]}, "none": valid | {"key": "none"},
        "keyless": valid | {"encodedLines": [encoded(two[0])]}, "partial": valid | {"key": "partial", "partial": True, "encodedLines": [encoded(two[0])]},
    }
    for name, row in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(row))
    good, bad = sources.read_road_catalog(spark, str(tmp_path), "7", {"kind": "road", "schema": "s1", "validationSchema": "v1"})
    got = {r["key"]: r for r in good.collect()}
    assert sorted(got) == ["absent", "whole", "zero"] and bad.count() == 7
    assert (got["whole"]["totalKm"], got["whole"]["pointCount"], got["whole"]["compactToleranceM"]) == (9.5, 99, 15.0) and got["whole"]["bounds"][0] == [-21.1, -44.2]
    assert got["absent"]["totalKm"] == pytest.approx(sum(map(km, two)), abs=1e-9) and (got["absent"]["pointCount"], got["absent"]["precision"], got["absent"]["compactToleranceM"], len(got["absent"]["lines"])) == (5, 5, 25.0, 2)
    assert got["zero"]["totalKm"] == pytest.approx(sum(map(km, two)), abs=1e-9) and got["zero"]["pointCount"] == 4
    assert {r["key"] for r in sources.read_road_catalog(spark, str(tmp_path))[0].collect()} == {"absent", "whole", "zero", "kind", "schema", "old"}
