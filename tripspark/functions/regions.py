"""Rough outlines of countries, by which a point on a road is given its country."""

from __future__ import annotations

#: Fixed values, in order of precedence: a country's ring of (lat, lng), or its box (south, north, west, east).
OUTLINES: list[tuple[str, list[tuple[float, float]] | tuple[float, float, float, float]]] = [
    ("MX", [(32.72, -117.13), (32.55, -114.72), (31.33, -111.07), (31.78, -108.20), (31.33, -106.50), (31.76, -104.50), (29.78, -102.30), (28.96, -100.30), (26.00, -99.00), (25.84, -97.15), (22.00, -97.80), (18.00, -94.00), (18.20, -90.70), (21.50, -86.70), (18.20, -87.80), (14.50, -92.20), (16.00, -98.00), (17.50, -101.50), (20.00, -105.70), (23.00, -106.60), (23.00, -110.00), (28.00, -114.00), (32.00, -117.00)]),
    ("US", [(49.00, -124.80), (49.00, -95.00), (48.00, -89.50), (46.50, -84.50), (45.00, -82.50), (42.00, -83.20), (41.70, -82.70), (42.00, -79.80), (43.60, -76.80), (44.80, -74.70), (47.50, -69.20), (45.00, -66.90), (40.00, -73.70), (35.00, -75.50), (30.00, -80.00), (25.00, -80.50), (24.40, -82.00), (29.00, -97.50), (25.80, -97.20), (29.80, -101.00), (31.80, -106.50), (32.50, -117.20), (42.00, -124.80)]),
    ("US", (54.5, 71.6, -170.0, -141.0)),
    ("US", (18.8, 22.4, -160.6, -154.5)),
    ("CA", (41.6, 83.2, -141.1, -52.6)),
    ("BZ", (15.7, 18.6, -89.3, -87.4)),
    ("SV", (13.0, 14.6, -90.2, -87.6)),
    ("GT", (13.7, 17.9, -92.3, -88.0)),
    ("HN", (12.8, 16.5, -89.4, -83.1)),
    ("NI", (10.7, 15.1, -87.8, -82.5)),
    ("CR", (8.0, 11.3, -86.2, -82.3)),
    ("PA", (7.0, 9.8, -83.1, -77.0)),
    ("GY", (1.0, 8.7, -61.6, -56.3)),
    ("SR", (1.7, 6.3, -58.2, -53.7)),
    ("GF", (2.0, 5.9, -54.7, -51.5)),
    ("CO", [(12.6, -71.7), (11.4, -74.4), (8.5, -77.5), (1.4, -79.1), (-4.3, -69.9), (-1.5, -67.0), (4.0, -67.5), (7.0, -72.0), (10.8, -72.8)]),
    ("VE", [(12.3, -71.7), (11.4, -66.0), (10.6, -61.7), (8.4, -60.5), (5.5, -61.0), (1.0, -66.8), (4.0, -67.5), (7.0, -72.0), (9.0, -73.3)]),
    ("UY", [(-34.98, -56.16), (-34.86, -57.97), (-33.25, -58.42), (-30.11, -57.63), (-30.08, -56.00), (-30.36, -53.18), (-32.65, -53.10), (-33.75, -53.35), (-34.30, -53.40), (-34.85, -53.80), (-35.00, -54.95)]),
    ("PY", (-27.8, -19.0, -62.8, -54.0)),
    ("BO", (-23.3, -9.3, -69.9, -57.3)),
    ("PE", (-18.6, -0.1, -81.6, -68.4)),
    ("EC", (-5.2, 1.7, -81.3, -75.0)),
    ("CL", (-56.2, -17.0, -76.0, None)),
    ("AR", (-55.5, -21.0, -73.8, -53.4)),
    ("BR", (-34.0, 5.4, -74.1, -34.0)),
]
#: Chile's eastern limit by latitude: north of the first latitude the first longitude holds, and so on southward.
EASTERN_STEPS = [(-23.0, -68.4), (-30.0, -69.0), (-35.0, -70.0), (-45.0, -71.0), (None, -72.0)]


def rings() -> list[tuple[int, str, list[tuple[float, float]]]]:
    """priority, code, ring."""
    return [(p, code, shape) for p, (code, shape) in enumerate(OUTLINES) if isinstance(shape, list)]


def boxes() -> list[tuple[int, str, float, bool, float, float, float]]:
    """priority, code, south, whether the box begins north of it, north, west, east. A box whose eastern limit changes with
    latitude is one box for each step; a latitude on a step counts to the south of it."""
    out = []
    for p, (code, shape) in enumerate(OUTLINES):
        if isinstance(shape, list):
            continue
        s, n, w, e = shape
        if e is not None:
            out.append((p, code, s, False, n, w, e))
            continue
        for low, east in EASTERN_STEPS:
            out.append((p, code, s if low is None else low, low is not None, n, w, east))
            n = low
    return out
