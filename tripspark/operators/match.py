"""Matching names of places to a gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.text import fuzzy_score, plain
from tripspark.operators.sizes import dealt

#: Neighbouring countries, which come before others.
NEARBY = ["AR", "UY", "PY", "BO", "CL", "PE", "CO", "EC", "VE"]


def candidates(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of queries (query_id, query) and places (place_id, name, ...) that can match: some word of the name holds the
    query's first two letters (of its first word), as every scored match needs; or both are equal without spaces there."""
    q = queries.withColumn("gram", F.substring_index(F.substring(plain(F.col("query")), 1, 2), " ", 1)).filter("gram <> ''")
    text = F.replace(plain(F.col("name")), F.lit(" "), F.lit(""))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.array(F.substring(text, i, F.lit(1)), F.substring(text, i, F.lit(2))))))
    return q.join(places.withColumn("gram", F.explode(grams)), "gram").drop("gram")


def match_places(queries: DataFrame, places: DataFrame, local: int = 8, most: int = 12) -> DataFrame:
    """query_id, place_id, score, pos: the best places for each query.

    places: place_id, name, admin, country. The eight best at home come first; if one is equal to the query they are all,
    else come equal ones abroad, those at home, the neighbours' and the rest; equal name, area and country count once."""
    s = candidates(queries, places).withColumn("score", fuzzy_score(F.col("name"), F.col("query"))).filter("score is not null")
    home = F.col("country") == "BR"
    s = s.withColumn("n_", F.row_number().over(Window.partitionBy("query_id", home).orderBy("score", "name", "place_id"))).filter(~home | (F.col("n_") <= local))
    own = Window.partitionBy("query_id")
    s = s.withColumn("exact_", F.max(home & (F.col("score") == 0)).over(own)).filter(home | ~F.col("exact_"))
    rank = F.when(~home & (F.col("score") == 0), 0).when(home, 1).when(F.col("country").isin(*NEARBY), 2).otherwise(3)
    s = s.withColumn("rank_", rank)
    order = ["rank_", "score", "name", "place_id"]
    same = Window.partitionBy("query_id", plain(F.col("name")), plain(F.col("admin")), "country").orderBy(*order)
    s = s.withColumn("d_", F.row_number().over(same)).filter("d_ = 1")
    return s.withColumn("pos", F.row_number().over(own.orderBy(*order))).filter(F.col("pos") <= most).select("query_id", "place_id", "score", "pos")


def merge_results(cities: DataFrame, pois: DataFrame, most: int = 12, rows: int | None = None) -> DataFrame:
    """query_id, kind, item_id, pos: exact cities, then points of interest that match exactly or by category, then other cities
    and other points. cities, pois: query_id, item_id, score; pois also category_hit. rows: about how many there are, where it is known:
    they are then dealt so that no task's share grows with them."""
    c = cities.select("query_id", F.lit("city").alias("kind"), "item_id", "score", F.when(F.col("score") == 0, 0).otherwise(2).alias("rank_"))
    p = pois.select("query_id", F.lit("poi").alias("kind"), "item_id", "score", F.when(F.col("category_hit") | (F.col("score") == 0), 1).otherwise(3).alias("rank_"))
    w = Window.partitionBy("query_id").orderBy("rank_", "score", "kind", "item_id")
    both = c.union(p)
    both = both if rows is None else dealt(both, rows, "query_id")
    return both.distinct().withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most).select("query_id", "kind", "item_id", "pos")


def _pieces(name: str) -> Column:
    """The empty text and all runs of one to three letters of a column."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(at, lambda k: F.array(*[F.substring(F.col(name), k, F.lit(n)) for n in (1, 2, 3)])))))


def kb_match(cities: DataFrame, items: DataFrame, most_km: float = 120.0, keep: int = 5) -> DataFrame:
    """city_id, item_id, score: the knowledge-base item for each city: names equal 14, one inside the other 5, else -8; a town by its
    description 4, noise -14, the same group 7, the same country 3; the best that scores 5 or more and lies near, with a flag."""
    from tripspark.functions.geo import haversine

    c = cities.withColumn("n_", plain(F.col("name"))).alias("c")
    i = items.withColumn("m_", plain(F.col("title"))).alias("i")
    name = F.when(F.col("n_") == F.col("m_"), 14).when(F.col("m_").contains(F.col("n_")) | F.col("n_").contains(F.col("m_")), 5).otherwise(-8)
    score = name + F.when(F.col("i.is_town"), 4).otherwise(0) + F.when(F.col("i.is_noise"), -14).otherwise(0) + F.when(F.col("c.region") == F.col("i.region"), 7).otherwise(0) + F.when(F.col("c.country") == F.col("i.country"), 3).otherwise(0)
    wanted = ["city_id", "item_id", score.alias("score"), haversine(F.col("c.lat"), F.col("c.lng"), F.col("i.lat"), F.col("i.lng")).alias("km"), "has_flag"]
    # a name inside the other: its first letters are some letters of the other in a row
    inside = c.withColumn("key_", F.explode(_pieces("n_"))).alias("c").join(i.withColumn("key_", F.substring("m_", 1, 3)).alias("i"), "key_").select(*wanted)
    around = c.withColumn("key_", F.substring("n_", 1, 3)).alias("c").join(i.withColumn("key_", F.explode(_pieces("m_"))).alias("i"), "key_").select(*wanted)
    # other names need all of town, group and country; all score the same there, so the first items of each group are enough
    towns = i.filter("is_town and not coalesce(is_noise, false)").withColumn("o_", F.row_number().over(Window.partitionBy("region", "country").orderBy("item_id"))).filter(F.col("o_") <= keep).alias("i")
    others = c.join(towns, (F.col("c.region") == F.col("i.region")) & (F.col("c.country") == F.col("i.country"))).select(*wanted)
    j = inside.union(around).union(others).filter("score >= 5").distinct()
    w = Window.partitionBy("city_id").orderBy(F.desc("score"), "item_id")
    j = j.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= keep).filter((F.col("km").isNull() | (F.col("km") <= most_km)) & F.col("has_flag"))
    return j.groupBy("city_id").agg(F.min_by(F.struct("item_id", "score"), "n_").alias("b")).select("city_id", "b.item_id", "b.score")
