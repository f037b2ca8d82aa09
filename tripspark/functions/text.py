"""Names, road references and places as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Federal and state prefixes of road references, and the parent states of secondary networks.
STANDARD_PREFIXES = ["BR", "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO"]
PARENT_STATE = {"LMG": "MG", "AMG": "MG", "MGC": "MG", "CMG": "MG", "ERS": "RS", "RSC": "RS", "VRS": "RS", "SPV": "SP", "SPA": "SP", "SPI": "SP"}
#: State codes and names.
STATES = {
    "AC": "Acre", "AL": "Alagoas", "AP": "Amapá", "AM": "Amazonas", "BA": "Bahia", "CE": "Ceará", "DF": "Distrito Federal", "ES": "Espírito Santo", "GO": "Goiás",
    "MA": "Maranhão", "MT": "Mato Grosso", "MS": "Mato Grosso do Sul", "MG": "Minas Gerais", "PA": "Pará", "PB": "Paraíba", "PR": "Paraná", "PE": "Pernambuco",
    "PI": "Piauí", "RJ": "Rio de Janeiro", "RN": "Rio Grande do Norte", "RS": "Rio Grande do Sul", "RO": "Rondônia", "RR": "Roraima", "SC": "Santa Catarina",
    "SP": "São Paulo", "SE": "Sergipe", "TO": "Tocantins",
}
#: Country codes by three-letter code and by name.
ISO3 = {"BRA": "BR", "ARG": "AR", "URY": "UY", "PRY": "PY", "BOL": "BO", "CHL": "CL", "PER": "PE", "COL": "CO", "ECU": "EC", "VEN": "VE"}
COUNTRIES = {"brasil": "BR", "brazil": "BR", "argentina": "AR", "uruguai": "UY", "uruguay": "UY", "paraguai": "PY", "paraguay": "PY", "bolivia": "BO", "chile": "CL", "peru": "PE", "colombia": "CO", "equador": "EC", "ecuador": "EC", "venezuela": "VE"}

#: A run of two or three letters and a number: what a road code looks like. Whether the letters are a prefix, the lists above say.
_CODE = r"\b[A-Za-z]{2,3}\s*-?\s*[0-9]{1,4}(?:/[0-9]{1,4})?\b"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one ASCII letter and marks, and those ASCII letters."""
    pairs = [(chr(p), unicodedata.normalize("NFD", chr(p))[0]) for p in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain(c: Column) -> Column:
    """Accents off (Latin letters, and marks that stand alone), lower case, everything but a-z and 0-9 to single spaces; null as empty."""
    c = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.lower(F.translate(c, *_accents())), "[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.replace(plain(c), F.lit(" "), F.lit(""))


def key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _dashes(c: Column) -> Column:
    return F.trim(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[–—]", "-")))


def road_codes(c: Column) -> Column:
    """prefix (upper case), number and text of each road code in c, in order.

    code = prefix, white space and one dash at will, number; number = up to four digits, or two of those with a slash between."""
    cut = lambda m: F.struct(F.upper(F.regexp_extract(m, "^[A-Za-z]+", 0)).alias("prefix"), F.regexp_extract(m, "[0-9/]+$", 0).alias("number"), m.alias("text"))
    found = F.transform(F.regexp_extract_all(c, F.lit(_CODE), F.lit(0)), cut)
    return F.filter(found, lambda x: x["prefix"].isin(*STANDARD_PREFIXES, *PARENT_STATE))


def international_parts(c: Column, number: str = "[0-9]{1,4}[A-Z]?") -> Column:
    """country, network, number of a label INT:country:network:number in upper case; null if c is none."""
    parts = F.split(c, ":")
    mark, country, network, own = (F.get(parts, F.lit(i)) for i in range(4))
    ok = (F.size(parts) == 4) & (mark == "INT") & country.rlike("^[A-Z]{2}$") & network.rlike("^[A-Z]{1,3}$") & own.rlike(f"^(?:{number})$")
    return F.when(ok, F.struct(country.alias("country"), network.alias("network"), own.alias("number")))


def parse_road_code(label: Column) -> Column:
    """country, network, number, federal, secondary, parent_state, international; null if the label has no road code."""
    c = _dashes(label)
    first, abroad = F.get(road_codes(c), F.lit(0)), international_parts(c)
    parents = F.create_map(*[F.lit(x) for p in PARENT_STATE.items() for x in p])
    network = first["prefix"]
    parent = F.coalesce(F.element_at(parents, network), F.when(network == "BR", F.lit("")).otherwise(network))
    kind = "struct<country:string,network:string,number:string,federal:boolean,secondary:boolean,parent_state:string,international:boolean>"
    foreign = F.struct(abroad["country"], abroad["network"], abroad["number"], F.lit(False), F.lit(False), F.lit(""), F.lit(True)).cast(kind)
    home = F.struct(F.lit("BR"), network, first["number"], network == "BR", network.isin(*PARENT_STATE), parent, F.lit(False)).cast(kind)
    return F.when(abroad.isNotNull(), foreign).when(first.isNotNull(), home)


def clean_road_ref(raw: Column) -> Column:
    """Single spaces, and every road code in it as PREFIX-number, prefix in upper case."""
    c = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    return F.aggregate(road_codes(c), c, lambda s, x: F.replace(s, x["text"], F.concat(x["prefix"], F.lit("-"), x["number"])))


def is_highway_ref(value: Column) -> Column:
    c = clean_road_ref(value)
    p = parse_road_code(c)
    exact = ~p["international"] & (F.upper(c) == F.concat_ws("-", p["network"], p["number"]))
    return international_parts(F.upper(c)).isNotNull() | F.coalesce(exact, F.lit(False)) | c.rlike(r"(?i)\b(ruta|route|rodovia|estrada)\s*[\w-]*\d+")


def road_refs(raw: Column) -> Column:
    """Distinct clean references of a step's reference text, in order: cut at ; and , and at a slash if a road code begins after
    it (other slashes belong to a number)."""
    starts = lambda x: x.rlike(r"^\s*[A-Za-z]{2,3}\s*-?\s*[0-9]")

    def joined(done: Column, piece: Column) -> Column:
        whole = F.concat(F.element_at(done, -1), F.lit("/"), piece)
        return F.when((F.size(done) == 0) | starts(piece), F.concat(done, F.array(piece))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(whole)))

    lists = F.transform(F.split(F.coalesce(raw, F.lit("")), "[;,]"), lambda part: F.aggregate(F.split(part, "/"), F.array().cast("array<string>"), joined))
    return F.array_distinct(F.transform(F.filter(F.flatten(lists), lambda x: _stripped(x) != ""), lambda x: clean_road_ref(_stripped(x))))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _bare_number(c: Column) -> Column:
    """c without spaces around it if it is a number, or two with a slash between, of up to four digits; else null."""
    t = _stripped(c)
    parts = F.split(t, "/")
    return F.when((F.size(parts) <= 2) & F.forall(parts, lambda x: x.rlike("^[0-9]{1,4}$")), t)


def canonical_keys(refs: list[Column], network: Column) -> Column:
    """Distinct BR|PREFIX|number keys of reference texts; where no text has a road code, bare numbers take the network's prefix:
    its last state's (runs of two or three letters are looked at), else BR."""
    texts = F.array(*[_dashes(r) for r in refs])
    made = lambda prefix, number: F.concat(F.lit("BR|"), prefix, F.lit("|"), number)
    coded = F.flatten(F.transform(texts, lambda t: F.transform(road_codes(t), lambda x: made(x["prefix"], x["number"]))))
    runs = F.regexp_extract_all(F.upper(F.coalesce(network, F.lit(""))), F.lit("[A-Z]{2,3}"), F.lit(0))
    state = F.try_element_at(F.filter(runs, lambda x: x.isin(*PARENT_STATE, *STANDARD_PREFIXES[1:])), F.lit(-1))
    prefix = F.coalesce(state, F.when(F.array_contains(runs, "BR"), F.lit("BR")))
    bare = F.array_compact(F.transform(texts, lambda t: made(prefix, _bare_number(t))))
    return F.array_sort(F.array_distinct(F.when(F.size(coded) > 0, coded).otherwise(bare)))


def road_key(label: Column) -> Column:
    """COUNTRY|NETWORK|NUMBER, or the label's own key."""
    p = parse_road_code(label)
    return F.coalesce(F.concat_ws("|", p["country"], p["network"], p["number"]), key(label))


def display_label(label: Column) -> Column:
    """International labels without their mark, others as they are."""
    p = parse_road_code(label)
    return F.when(p["international"], F.concat_ws(" ", p["network"], p["number"])).otherwise(label)


def state_of(value: Column) -> Column:
    """Two-letter state: BR-XX, the code itself, a state's name, a name inside the text (longest first), a code as a token."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    upper, text = F.upper(raw), F.trim(F.regexp_replace(plain(raw), r"\b(?:estado|state) (?:de|do|da|of) ", ""))
    codes = F.array(*[F.lit(s) for s in STATES])
    iso = F.regexp_extract(upper, r"\bBR[-_ ]([A-Z]{2})\b", 1)
    steps = F.when(F.array_contains(codes, iso), iso).when(F.array_contains(codes, upper), upper)
    names = sorted(((s, "".join(ch for ch in unicodedata.normalize("NFD", n) if ch.isascii()).lower()) for s, n in STATES.items()), key=lambda x: (-len(x[1]), x[1]))
    for s, n in names:
        steps = steps.when(text == n, F.lit(s))
    for s, n in names:
        steps = steps.when(F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {n} "), F.lit(s))
    tokens = F.filter(F.split(upper, "[^A-Z]+"), lambda t: F.array_contains(codes, t))
    return steps.otherwise(F.get(tokens, F.lit(0)))


def country_code(code: Column, country: Column) -> Column:
    """Two letters from a two- or three-letter code or a country's name; empty if none is known."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    three, named = (F.create_map(*[F.lit(x) for p in table.items() for x in p]) for table in (ISO3, COUNTRIES))
    return F.when(c.rlike("^[A-Z]{2}$"), c).otherwise(F.coalesce(F.element_at(three, c), F.element_at(named, plain(country)), F.lit("")))


def fuzzy_score(name: Column, query: Column, cutoff: float = 0.34) -> Column:
    """How near a name is to a query: 0 equal, 2 prefix, 3 last words, 4 words, 5 inside, 7 inside without spaces, 20 and
    more by edit distance of a window of its words; null if it is too far. Edit distances over 4 count as no match."""
    n, q = plain(name), plain(query)
    nc, qc = F.replace(n, F.lit(" "), F.lit("")), F.replace(q, F.lit(" "), F.lit(""))
    words, asked = F.split(n, " "), F.size(F.split(q, " "))
    anchor = F.substring(q, 1, 2)
    anchor = F.substring_index(anchor, " ", 1)
    starts = F.sequence(F.lit(1), F.size(words))
    windows = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(F.array(asked - 1, asked, asked + 1), lambda k: (k >= 1) & (k <= F.size(words) - s + 1)), lambda k: F.array_join(F.slice(words, s, k), ""))))
    windows = F.concat(windows, F.array(nc))
    far = F.transform(windows, lambda w: F.when(F.levenshtein(w, qc, 4) >= 0, F.levenshtein(w, qc, 4) / F.greatest(F.length(w), F.length(qc), F.lit(1))))
    best = F.array_min(F.filter(far, lambda x: x.isNotNull()))
    return (
        F.when((q == "") | (n == ""), F.lit(None).cast("double"))
        .when(n == q, F.lit(0.0)).when(n.startswith(q), F.lit(2.0)).when(n.endswith(F.concat(F.lit(" "), q)), F.lit(3.0))
        .when(F.concat(F.lit(" "), n, F.lit(" ")).contains(F.concat(F.lit(" "), q, F.lit(" "))), F.lit(4.0))
        .when(n.contains(q), F.lit(5.0)).when(nc.contains(qc), F.lit(7.0))
        .when(~F.exists(words, lambda w: w.contains(anchor)), F.lit(None).cast("double"))
        .when(best <= cutoff, 20 + best * 50)
    )


def city_identity(osm_type: Column, osm_id: Column, city: Column, region: Column, code: Column, lat: Column, lng: Column) -> Column:
    """osm:type:id, else name|region|country|coordinates to 4 places."""
    known = (F.coalesce(osm_type, F.lit("")) != "") & (F.coalesce(osm_id.cast("string"), F.lit("")) != "")
    place = F.when(lat.isNotNull() & lng.isNotNull(), F.concat(F.format_string("%.4f", lat), F.lit("|"), F.format_string("%.4f", lng))).otherwise("")
    return F.when(known, F.concat_ws(":", F.lit("osm"), osm_type, osm_id.cast("string"))).otherwise(F.concat_ws("|", plain(city), plain(region), F.upper(F.coalesce(code, F.lit(""))), place))
