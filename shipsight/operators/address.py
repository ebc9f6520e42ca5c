"""Region of a free-text delivery address, from a table of places.

Every rule is data: a row of `places` says which text stands for which place, and under which rule. Distinct addresses are
cut into the pieces of text that have a place's length, an equi-join finds the pieces that are places, and one aggregate per
address keeps the first place under each rule. So the work is linear in the addresses, for a table of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import cases

#: Columns of `places`. `rank` orders the places of a rule, and the groups of rule `place`.
PLACES = "rule string, rank int, place string, region string, sub string, abroad boolean"
#: Rules of places.
JUNK, TERMS, FULL, PROVINCE, CITY, DISTRICT, PLACE = ("junk", "terms", "full", "province", "city", "district", "place")
UNKNOWN, OVERSEAS = "unknown", "overseas"


def cleaned(address: Column, prefixes: list[str]) -> Column:
    """The address without the spaces around it and without each of the prefixes that it begins with, in their order."""
    text = F.trim(F.coalesce(address, F.lit("")))
    for prefix in prefixes:
        text = F.when(F.startswith(text, F.lit(prefix)), F.trim(F.substr(text, F.lit(len(prefix) + 1)))).otherwise(text)
    return text


#: A place table of more rows is joined by sorting.
BROADCAST_PLACES = 100_000


def pieces(addresses: DataFrame, lengths: Column) -> DataFrame:
    """All pieces of the texts that have one of the lengths, with where they begin."""
    text = F.col("text")
    starts = lambda n: F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    piece = lambda at, n: F.struct(at.alias("at"), F.substr(text, at, n).alias("piece"))
    cut = F.flatten(F.transform(lengths, lambda n: F.transform(starts(n), lambda at: piece(at, n))))
    return addresses.select("key", "headed", "text", F.explode(cut).alias("p")).select("key", "headed", "text", "p.*")


def hits(addresses: DataFrame, places: DataFrame, sign: int) -> DataFrame:
    """The pieces that are places, with the few letters on either side.

    Pieces are many times the addresses, which Spark's estimate of their size doesn't know: without a hint it sends them all
    through the driver. So the places travel, or both sides are sorted where the places are many.
    """
    lengths = places.agg(F.collect_set(F.length("place"))).scalar()
    many = places.limit(BROADCAST_PLACES + 1).count() > BROADCAST_PLACES
    cut = pieces(addresses.withColumn("lengths", lengths), F.col("lengths"))
    found = cut.join(places.hint("merge" if many else "broadcast"), F.col("piece") == F.col("place"))
    longest = places.agg(F.max(F.length("place"))).scalar()
    text, at = F.col("text"), F.col("at")
    return found.withColumn("longest", longest).withColumns({
        "before": F.substr(text, F.greatest(at - F.col("longest") - 1, F.lit(1)), F.least(at - 1, F.col("longest") + 1)),
        "next": F.substr(text, at + F.length("place"), F.lit(sign)),
    })


def matched(addresses: DataFrame, places: DataFrame, city_sign: str) -> DataFrame:
    """Addresses with the first place under each rule, as structs of (order, place); cities as an array."""
    found = hits(addresses, places, len(city_sign))
    size, head = F.length("place"), F.col("at") == 1
    signed, region = F.col("next") == city_sign, F.col("region")
    after = F.endswith("before", region) | F.endswith("before", F.concat(region, F.lit("省")))
    place = [F.col(c) for c in ("place", "region", "sub", "abroad")]
    ranked, longest = F.struct("rank", *place), F.struct((-size).alias("size"), "rank", *place)
    is_rule = lambda name: F.col("rule") == name
    city = is_rule(CITY) & (head | signed)
    return found.groupBy("key").agg(
        F.coalesce(F.bool_or(is_rule(JUNK)), F.lit(False)).alias("junk"),
        F.collect_set(F.when(is_rule(TERMS), F.struct("rank", "place", "region", "sub", "abroad"))).alias("terms"),
        F.min(F.when(is_rule(FULL) & head, ranked)).alias("full"),
        F.min(F.when(is_rule(PROVINCE) & head & (F.col("place") == F.col("headed")), ranked)).alias("named"),
        F.min(F.when(is_rule(PROVINCE), ranked)).alias("anywhere"),
        F.collect_set(F.when(is_rule(CITY) & (head | signed | after), longest)).alias("cities"),
        F.min(F.when(city, longest)).alias("city"),
        F.min(F.when(is_rule(DISTRICT) & head, longest)).alias("district"),
        F.min(F.when(is_rule(PLACE), F.struct("rank", F.lit(0).alias("kind"), (-size).alias("size"), *place))).alias("place"),
    )


def resolve(
    df: DataFrame, places: DataFrame, col: str = "address", patterns: list[tuple[int, str, str, str, bool]] = (), prefixes: list[str] = (),
    junk: str = r"^(\d{7,}|-+|无|nan|None)$", foreign: str = r"[A-Za-z]{4,}", city_sign: str = "市",
) -> DataFrame:
    """Each distinct address with region, sub, abroad and the rule that decided.

    `places` has the columns of PLACES and these rules, tried in this order on the text without `prefixes`:

    * `junk` anywhere, or the pattern `junk`: unknown;
    * `terms`: all places of one rank occur: region and sub of that rank, least rank first;
    * a province: one of rule `full` at the head, else `X省` at the head, else one of rule `province` anywhere, least rank
      first. Where it isn't abroad, sub is its longest `city` that stands at the head, before `city_sign`, or after the
      province; a city that is its own province has an empty sub;
    * `district` at the head; then the longest `city` at the head or before `city_sign`;
    * `place` anywhere, by rank, the longest first; `patterns` (rank, expression, region, sub, abroad) come after the places of
      their rank;
    * the pattern `foreign`: overseas, abroad; else unknown.

    Null and empty addresses are unknown. Repeated addresses come once. Without places only patterns decide. Cities of one
    length are taken by rank, then by name. The table is joined by equality and may have any size; its lengths are few.
    """
    addresses = df.select(F.col(col).alias("address")).distinct().withColumn("text", cleaned(F.col("address"), list(prefixes)))
    addresses = addresses.withColumns({"headed": F.regexp_extract("text", r"^(\S{1,5}?)省", 1), "key": F.sha2(F.coalesce("address", F.lit("")), 256)})
    # By a number of its own: few bytes make much work here, so that small partitions must not be put together.
    addresses = addresses.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    m = addresses.join(matched(addresses, places, city_sign), "key", "left")
    needed = places.filter(F.col("rule") == TERMS).groupBy("rank").agg(F.count("*").alias("n"))
    needed = needed.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct("rank", "n"))), F.create_map().cast("map<int,bigint>"))).scalar()
    text, full, named = F.col("text"), F.col("full"), F.col("named")
    all_terms = F.array_min(F.filter("terms", lambda t: F.size(F.filter("terms", lambda o: o["rank"] == t["rank"])) == F.try_element_at("needed", t["rank"])))
    province = F.when(full.isNotNull(), full).when(F.col("headed") != "", named).otherwise(F.col("anywhere"))
    city = F.array_min(F.filter("cities", lambda x: x["region"] == F.col("province.region")))
    struct = "struct<rank:int,kind:int,size:int,place:string,region:string,sub:string,abroad:boolean>"
    found = [F.when(text.rlike(p), F.struct(F.lit(rank).alias("rank"), F.lit(1).alias("kind"), F.lit(0).alias("size"), F.lit(p).alias("place"), F.lit(r).alias("region"), F.lit(s).alias("sub"), F.lit(a).alias("abroad")).cast(struct)) for rank, p, r, s, a in patterns]
    m = m.withColumn("needed", needed).select("address", "text", F.coalesce("junk", F.lit(False)).alias("junk"), all_terms.alias("terms"), province.alias("province"), "cities", "city", "district", F.array_min(F.array_compact(F.array(F.col("place").cast(struct), *found))).alias("place"))
    m = m.withColumn("in_province", city)
    inside = F.when(F.col("in_province.place") == F.col("in_province.region"), "").otherwise(F.coalesce("in_province.sub", F.lit("")))
    alone = F.when(F.col("city.place") == F.col("city.region"), "").otherwise(F.col("city.sub"))
    rules = [
        ((text == "") | F.col("junk") | text.rlike(junk), "junk", UNKNOWN, "", False),
        (F.col("terms").isNotNull(), "terms", F.col("terms.region"), F.col("terms.sub"), F.col("terms.abroad")),
        (F.coalesce(~F.col("province.abroad"), F.lit(False)), "province", F.col("province.region"), inside, False),
        (F.col("district").isNotNull(), "district", F.col("district.region"), F.col("district.sub"), F.col("district.abroad")),
        (F.col("city").isNotNull(), "city", F.col("city.region"), alone, F.col("city.abroad")),
        (F.col("place").isNotNull(), "place", F.col("place.region"), F.col("place.sub"), F.col("place.abroad")),
        (text.rlike(foreign), "foreign", OVERSEAS, "", True),
    ]
    pick = lambda i, default: cases(*[(r[0], r[i]) for r in rules], default=default)
    return m.select(F.col("address").alias(col), pick(2, UNKNOWN).alias("region"), pick(3, "").alias("sub"), pick(4, False).alias("abroad"), pick(1, UNKNOWN).alias("rule"))


def full_name(region: Column, special: dict[str, str], provinces: list[str], cities: list[str]) -> Column:
    """The official name of a region: of `special` by table, of `cities` with 市, of `provinces` with 省, else as it is."""
    table = F.create_map(*[F.lit(x) for pair in special.items() for x in pair]) if special else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, region), F.when(region.isin(*cities), F.concat(region, F.lit("市"))), F.when(region.isin(*provinces), F.concat(region, F.lit("省"))), region)
