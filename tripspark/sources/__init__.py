"""Readers of trip, gazetteer and road files, and writers of catalogs. Rows that break a rule go to a quarantine of their own."""

from tripspark.sources.files import (
    export_backup, import_backup, read_admin1, read_airports, read_geonames, read_gpx_tracks, read_iconic_catalog, read_municipalities, read_official_tracks, read_osm, read_road_catalog, read_trips, write_partitioned_catalog)
from tripspark.sources.roads import assemble_way_lines, build_road_catalog, relation_member_keys

__all__ = [
    "assemble_way_lines", "build_road_catalog", "export_backup", "import_backup", "read_admin1", "read_airports", "read_geonames", "read_gpx_tracks", "read_iconic_catalog",
    "read_municipalities", "read_official_tracks", "read_osm", "read_road_catalog", "read_trips", "relation_member_keys", "write_partitioned_catalog",
]
