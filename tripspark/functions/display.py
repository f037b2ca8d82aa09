"""Display strings and place records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripspark.functions.text import international_parts, plain, state_of

#: Names of travel modes, and of the kinds of points of interest, by value and else by key.
MODES = {"carro": "Carro", "moto": "Moto", "bicicleta": "Bicicleta", "a-pe": "A pé", "aviao": "Avião", "outro": "Outro"}
VALUES = {
    "camp_site": "Camping", "caravan_site": "Camping", "hotel": "Hotel", "hostel": "Hostel", "guest_house": "Pousada", "chalet": "Hospedagem", "museum": "Museu", "attraction": "Atração", "viewpoint": "Mirante", "waterfall": "Cachoeira", "cave_entrance": "Caverna",
    "nature_reserve": "Reserva natural", "park": "Parque", "beach": "Praia", "restaurant": "Restaurante", "aerodrome": "Aeroporto", "station": "Estação", "cathedral": "Catedral", "church": "Igreja", "library": "Biblioteca",
}
KEYS = {"tourism": "Destino", "natural": "Local natural", "historic": "Local histórico"}
DESTINATION_KEYS = ["tourism", "amenity", "leisure", "natural", "historic", "man_made", "aeroway", "railway", "shop", "office", "craft", "sport", "place"]
ADMINISTRATIVE = ["city", "town", "village", "municipality", "state", "country", "county", "suburb", "neighbourhood", "borough"]


def _named(table: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), c)


def format_date(c: Column) -> Column:
    """dd/mm/yyyy of yyyy-mm-dd; other text as it is; "Sem data" for none."""
    return F.when(F.coalesce(c, F.lit("")) == "", "Sem data").otherwise(F.regexp_replace(c, "^([^-]*)-([^-]*)-([^-]*)$", "$3/$2/$1"))


def format_distance(metres: Column) -> Column:
    """Whole kilometres with dots from 1000 m on, else whole metres; a dash for null."""
    km = F.replace(F.format_number(metres / 1000, 0), F.lit(","), F.lit("."))
    return F.when(metres.isNull(), "—").when(metres >= 1000, F.concat(km, F.lit(" km"))).otherwise(F.concat(F.round(metres).cast("long").cast("string"), F.lit(" m")))


def format_duration(seconds: Column) -> Column:
    """Hours and minutes, either left out if there are none (but 0 min); a dash for null."""
    minutes = F.round(seconds / 60).cast("long")
    h, m = F.floor(minutes / 60), minutes % 60
    return F.when(seconds.isNull(), "—").when(h == 0, F.concat(m.cast("string"), F.lit(" min"))).when(m == 0, F.concat(h.cast("string"), F.lit(" h"))).otherwise(F.concat(h.cast("string"), F.lit(" h "), m.cast("string"), F.lit(" min")))


def mode_label(mode: Column) -> Column:
    return F.coalesce(_named(MODES, mode), F.lit("Outro"))


def destination_category(osm_key: Column, osm_value: Column) -> Column:
    return F.coalesce(_named(VALUES, F.lower(osm_value)), _named(KEYS, F.lower(osm_key)), F.lit("Local"))


def is_destination(name: Column, osm_key: Column, osm_value: Column, lat: Column, lng: Column) -> Column:
    """Named points of interest with coordinates, of a known key; places that are administrative are none."""
    key, value = F.lower(F.coalesce(osm_key, F.lit(""))), F.lower(F.coalesce(osm_value, F.lit("")))
    return (F.coalesce(name, F.lit("")) != "") & lat.isNotNull() & lng.isNotNull() & key.isin(*DESTINATION_KEYS) & ~((key == "place") & value.isin(*ADMINISTRATIVE))


def compact_place_label(city: Column, region: Column, country_code: Column, country: Column, label: Column) -> Column:
    """City and state in Brazil, else city and a region of two or three letters; without a city the label's first two parts."""
    parts = F.filter(F.transform(F.split(F.coalesce(label, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    home = (F.upper(F.coalesce(country_code, F.lit(""))) == "BR") | plain(country).isin("brasil", "brazil")
    short = F.when(F.trim(region).rlike("^[A-Za-z]{2,3}$"), F.upper(F.trim(region)))
    tail = F.when(home, F.coalesce(F.when(F.length(short) == 2, short), state_of(region))).otherwise(short)
    return F.when(F.coalesce(city, F.lit("")) != "", F.concat_ws(", ", F.trim(F.substring_index(city, ",", 1)), tail)).otherwise(F.array_join(F.slice(parts, 1, 2), ", "))


def tags_region(tags: Column) -> Column:
    """region, country, country_code of an element's tags: its own, else by the ISO code of its area; empty if not said."""

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.element_at(tags, n)), F.lit("")) for n in names], F.lit(""))

    iso = F.upper(first("ISO3166-2", "addr:state_code"))
    good = iso.rlike("^[A-Z]{2}-[A-Z0-9]{1,3}$")
    code, region = F.upper(first("ISO3166-1:alpha2", "ISO3166-1", "addr:country", "is_in:country_code")), first("is_in:state_code", "addr:state", "is_in:state")
    return F.struct(
        F.when((region == "") & good, F.substring_index(iso, "-", -1)).otherwise(region).alias("region"), first("is_in:country").alias("country"),
        F.when((code == "") & good, F.substring(iso, 1, 2)).otherwise(code).alias("country_code"))


def element_point(lat: Column, lng: Column, center: Column, bounds: Column) -> Column:
    """lat, lng of an element: its own, its centre's, or the middle of its bounds."""
    middle = F.struct(((bounds["s"] + bounds["n"]) / 2).alias("lat"), ((bounds["w"] + bounds["e"]) / 2).alias("lng"))
    return F.coalesce(F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng"))), F.when(center.isNotNull(), center), F.when(bounds.isNotNull(), middle))


def sanitize_refs(labels: Column, country_code: Column) -> Column:
    """Labels without state references outside Brazil; international and federal ones stay."""
    home = F.upper(F.coalesce(country_code, F.lit("BR"))) == "BR"
    return F.filter(labels, lambda x: home | x.startswith("INT:") | x.startswith("BR-"))


def trip_country_context(codes: Column) -> Column:
    """The one country of a trip's places, or AUTO: and its countries in order; empty without any."""
    known = F.array_sort(F.array_distinct(F.filter(F.transform(codes, F.upper), lambda c: c.isNotNull() & (c != ""))))
    return F.when(F.size(known) == 0, F.lit("")).when(F.size(known) == 1, known[0]).otherwise(F.concat(F.lit("AUTO:"), F.array_join(known, ",")))


#: The national network of each country.
NATIONAL = {"UY": "RU", "AR": "RN", "PY": "PY", "CL": "CH", "BO": "F", "PE": "PE", "CO": "RN", "VE": "T", "EC": "E", "GY": "N", "SR": "N", "GF": "N", "PA": "N", "CR": "N", "NI": "NIC", "HN": "RN", "SV": "RN", "GT": "RN", "BZ": "N"}
#: Names of roads that one country alone uses, and its network; numbers have three digits at most.
OWN_NAME = {"PE": ("PE", "PE"), "PY": ("PY", "PY"), "CH": ("CL", "CH"), "E": ("EC", "E"), "T": ("VE", "T"), "TRONCAL": ("VE", "T"), "F": ("BO", "F"), "NIC": ("NI", "NIC")}
#: Names of a country's national roads, where the country is known; four digits at most.
ROAD_NAMES = ["RN", "RUTA", "RUTA NACIONAL", "ROUTE", "CARRETERA"]
#: Countries where a network "CA" runs (three digits at most), and where a bare number is a national road (four).
CENTRAL = ["GT", "SV", "HN", "NI", "CR", "PA"]
BARE = ["CO", "CR", "PA", "PE", "PY"]


def international_ref(raw: Column, hint: Column) -> Column:
    """INT:country:network:number of a reference; empty if it cannot be told.

    A reference is cut at its first digit into a name (a dash at its end goes) and a number (digits, a letter at will, leading
    zeros go), and the name is looked up: names that one country alone has tell themselves (PE only when set off from its
    number, unless some country is hinted); other names, bare numbers and CA need the hinted country. Brazilian names are in no
    list. A finished label is taken as it is."""
    c = F.trim(F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), "[–—]", "-")), r"\s+", " "))
    own = F.upper(F.coalesce(hint, F.lit("")))
    abroad = (own != "") & (own != "BR")
    before = F.regexp_extract(c, "^[^0-9]*", 0)
    name = F.trim(F.regexp_replace(F.trim(before), "-$", ""))
    number = F.regexp_extract(c, "^[^0-9]*([0-9]+[A-Z]?)$", 1)
    bare = lambda n: F.regexp_replace(n, "^0+(?=[0-9])", "")
    digits = F.length(F.regexp_replace(bare(number), "[A-Z]$", ""))
    label = lambda country, network, n: F.concat_ws(":", F.lit("INT"), country, network, bare(n))
    done, told = international_parts(c, "[0-9A-Z]{1,6}"), _named({k: ":".join(v) for k, v in OWN_NAME.items()}, name)
    told_by_name = told.isNotNull() & (digits <= 3) & ((name != "PE") | abroad | (F.length(before) > 2))
    national = F.coalesce(_named(NATIONAL, own), F.lit("N"))
    hinted = F.when((name == "CA") & own.isin(*CENTRAL) & (digits <= 3), F.lit("CA"))
    hinted = hinted.when((digits <= 4) & (name.isin(*ROAD_NAMES) & abroad | (before == "") & own.isin(*BARE)), national)
    return (
        F.when(done.isNotNull(), label(done["country"], done["network"], done["number"])).when(number == "", F.lit(""))
        .when(told_by_name, F.concat_ws(":", F.lit("INT"), told, bare(number))).when(hinted.isNotNull(), label(own, hinted, number)).otherwise(F.lit(""))
    )


def poi_score(name: Column, query: Column) -> Column:
    """Whether a point of interest's name holds all words of the query: 0 equal, 1 all words, null else."""
    n, q = plain(name), plain(query)
    return F.when(n == q, F.lit(0.0)).when(F.forall(F.split(q, " "), lambda w: F.concat(F.lit(" "), n).contains(F.concat(F.lit(" "), w))) & (q != ""), F.lit(1.0))


#: Countries whose national roads are told apart only by where they run.
NEIGHBOURS = ["AR", "UY"]


def reclassify_label(label: Column, country: Column) -> Column:
    """A national road of one of NEIGHBOURS under the country that its badge stands in, if that is one of them too; other labels
    as they are, trimmed."""
    own = F.trim(F.coalesce(label, F.lit("")))
    p = international_parts(F.upper(own), "[0-9A-Z]+")
    known = p["country"].isin(*NEIGHBOURS) & p["network"].isin(*[NATIONAL[c] for c in NEIGHBOURS])
    moved = F.concat_ws(":", F.lit("INT"), country, _named({c: NATIONAL[c] for c in NEIGHBOURS}, country), p["number"])
    return F.when(known & country.isin(*NEIGHBOURS), moved).otherwise(own)
