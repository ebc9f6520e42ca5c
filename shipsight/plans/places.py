"""Addresses and places: the place table is an argument of the operators; the one here serves the registered queries."""

from pyspark.sql import functions as F

from ..operators import address
from ..operators import datasets as ops
from ..sources.fact import table
from .datasets import P, gr, mg, mo, sums, ytd
from .registry import cte, query
from .sqlbits import LM, d, tot, win

# Public place names, as they occur in addresses.
_PROVINCES = ["内蒙古", "黑龙江", "北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "广西", "海南", "四川", "贵州", "云南", "西藏", "陕西", "甘肃", "青海", "宁夏", "新疆"]
_HARBOUR = ["香港", "澳门", "台湾"]
_FULL = {"北京市": "北京", "天津市": "天津", "上海市": "上海", "重庆市": "重庆", "内蒙古自治区": "内蒙古", "广西壮族自治区": "广西", "西藏自治区": "西藏", "宁夏回族自治区": "宁夏", "新疆维吾尔自治区": "新疆", "香港特别行政区": "香港", "澳门特别行政区": "澳门", "台湾省": "台湾"}
_CITIES = {"北京": "北京", "成都": "四川", "福州": "福建", "广州": "广东", "杭州": "浙江", "呼和浩特": "内蒙古", "惠州": "广东", "南宁": "广西", "青岛": "山东", "上海": "上海", "深圳": "广东", "苏州": "江苏", "武汉": "湖北", "西安": "陕西", "珠海": "广东"}
_GROUPS = [(1, "高雄", "台湾", "高雄市"), (1, "新竹", "台湾", "新竹市"), (2, "九龍", "香港", "九龙"), (2, "新界", "香港", "新界"), (3, "澳門", "澳门", ""), (4, "Incheon", "韩国", "仁川"), (4, "Seoul", "韩国", "首尔"), (5, "Formosa Trading", "台湾", ""), (6, "India", "印度", ""), (6, "Japan", "日本", ""), (6, "Singapore", "新加坡", "")]
ROWS = (
    [("junk", 1, w, "", "", False) for w in ("测试", "请补充")] + [("terms", 1, w, "广东", "深圳市", False) for w in ("FOB", "深圳")]
    + [("full", i, w, r, "", r in _HARBOUR) for i, (w, r) in enumerate(_FULL.items())] + [("province", i, w, w, "", w in _HARBOUR) for i, w in enumerate([*_PROVINCES, *_HARBOUR])]
    + [("city", i, c, r, f"{c}市", False) for i, (c, r) in enumerate(_CITIES.items())] + [("district", i, w, "广东", "深圳市", False) for i, w in enumerate(["宝安区", "福田区", "南山区"])]
    + [("place", rank, w, r, s, True) for rank, w, r, s in _GROUPS]
)
PATTERNS = [(1, r"^\d{3,5}\s*[台新高]", "台湾", "", True), (2, r"Hong\s?Kong", "香港", "", True)]
PREFIXES = ["停用-", "作废-", "OLD-", "中国"]
HOME = "广东"
#: Shapes of addresses: every one has customers, so that every rule decides some. {c} is a city, {k} the customer.
SHAPES = ["广东省{c}市工业路{k}号", "中国广东{c}科技园{k}号", "停用-{c}市第{k}仓", "{c}中山路{k}号", "江苏 {k}号 物流园", "内蒙古自治区呼和浩特市{k}号", "宝安区{k}栋", "FOB深圳机场{k}", "请补充{k}", "幸福大街{k}号院", "台湾省高雄市{k}號", "300 台{k}", "香港新界{k}號", "Unit {k}, Hong Kong", "澳門{k}號", "{k} Guro, Seoul", "Formosa Trading {k}", "{k} Ginza, Tokyo, Japan", "{k} Abbey Road", "武汉市{c}大道{k}号", "上海市浦东新区{k}号", "{c}福建会馆{k}", "18934600000", "OLD-浙江省杭州市{k}号", ""]
_NAMES = list(_CITIES)


def _cut(shape):
    """A shape as its pieces, with the slots as None."""
    out = []
    for i, part in enumerate(shape.replace("{c}", "\0c\0").replace("{k}", "\0k\0").split("\0")):
        out.append((part, i % 2 == 1))
    return [x for x in out if x[0]]


def _addresses(w):
    """An address per customer, made from its key and nation."""
    t = table(w.spark, w.folder, "customer")
    city = F.element_at(F.array(*[F.lit(c) for c in _NAMES]), F.pmod("c_nationkey", F.lit(len(_NAMES))) + 1)
    slot = {"c": city, "k": F.col("c_custkey").cast("string")}
    made = [F.concat(F.lit(""), *[slot[x] if is_slot else F.lit(x) for x, is_slot in _cut(shape)]) for shape in SHAPES]
    which = F.pmod("c_custkey", F.lit(len(SHAPES))).cast("int") + 1
    return t.select(F.col("c_custkey").alias("customer_id"), F.element_at(F.array(*made), which).alias("address"))


def _resolved(w):
    places = w.spark.createDataFrame(ROWS, address.PLACES)
    return address.resolve(_addresses(w), places, patterns=PATTERNS, prefixes=PREFIXES)


def _q(x):
    return "'" + x.replace("'", "''") + "'"


def _made(shape):
    slot = {"c": "c", "k": "CAST(c_custkey AS VARCHAR)"}
    return " || ".join(["''", *[slot[x] if is_slot else _q(x) for x, is_slot in _cut(shape)]])


_TEXT = "trim(address)"
for _p in PREFIXES:
    _TEXT = f"(CASE WHEN starts_with({_TEXT}, {_q(_p)}) THEN trim(substr({_TEXT}, {len(_p) + 1})) ELSE {_TEXT} END)"
cte("ad", f"SELECT c_custkey AS customer_id, CASE c_custkey % {len(SHAPES)} {' '.join(f'WHEN {i} THEN {_made(s)}' for i, s in enumerate(SHAPES))} END AS address FROM (SELECT *, [{', '.join(map(_q, _NAMES))}][c_nationkey % {len(_NAMES)} + 1] AS c FROM customer)")
cte("ad_places", "SELECT * FROM (VALUES " + ", ".join(f"({_q(r)}, {n}, {_q(w)}, {_q(g)}, {_q(s)}, {a})" for r, n, w, g, s, a in ROWS) + ") AS t(rule, rank, place, region, sub, abroad)")
cte("ad_text", f"SELECT address, {_TEXT} AS text, regexp_extract({_TEXT}, '^(\\S{{1,5}}?)省', 1) AS headed FROM (SELECT DISTINCT address FROM ad)")
_S = "{'a': rank, 'region': region, 'sub': sub, 'abroad': abroad, 'place': place}"
_L = "{'a': -len(place), 'b': rank, 'region': region, 'sub': sub, 'abroad': abroad, 'place': place}"
cte("ad_hit", f"""SELECT address, text, headed, coalesce(bool_or(rule = 'junk'), FALSE) AS junk, count(DISTINCT place) FILTER (rule = 'terms') AS terms,
  CASE WHEN count(*) FILTER (rule = 'full' AND starts_with(text, place)) > 0 THEN min({_S}) FILTER (rule = 'full' AND starts_with(text, place)) WHEN headed <> '' THEN min({_S}) FILTER (rule = 'province' AND place = headed) ELSE min({_S}) FILTER (rule = 'province') END AS province,
  min({_L}) FILTER (rule = 'city' AND (starts_with(text, place) OR contains(text, place || '市'))) AS city, min({_L}) FILTER (rule = 'district' AND starts_with(text, place)) AS district,
  min({{'a': rank, 'k': 0, 'b': -len(place), 'region': region, 'sub': sub, 'place': place}}) FILTER (rule = 'place') AS place
  FROM ad_text LEFT JOIN ad_places ON contains(text, place) GROUP BY 1, 2, 3""")
_PATTERN = " ".join(f"WHEN place IS NULL AND regexp_matches(text, {_q(p)}) OR place.a > {n} AND regexp_matches(text, {_q(p)}) THEN [{_q(r)}, {_q(s)}]" for n, p, r, s, _ in PATTERNS)
cte("ad_region", f"""SELECT address, CASE rule WHEN 'terms' THEN '广东' WHEN 'province' THEN province.region WHEN 'district' THEN district.region WHEN 'city' THEN city.region WHEN 'place' THEN abroad_place[1] WHEN 'foreign' THEN 'overseas' ELSE 'unknown' END AS region,
  CASE rule WHEN 'terms' THEN '深圳市' WHEN 'province' THEN CASE WHEN inner_city.place = inner_city.region THEN '' ELSE coalesce(inner_city.sub, '') END WHEN 'district' THEN district.sub WHEN 'city' THEN CASE WHEN city.place = city.region THEN '' ELSE city.sub END WHEN 'place' THEN abroad_place[2] ELSE '' END AS sub,
  rule IN ('place', 'foreign') AS abroad, rule FROM (
  SELECT *, CASE WHEN text = '' OR junk OR regexp_matches(text, '^(\\d{{7,}}|-+|无|nan|None)$') THEN 'junk' WHEN terms = 2 THEN 'terms' WHEN NOT province.abroad THEN 'province' WHEN district IS NOT NULL THEN 'district' WHEN city IS NOT NULL THEN 'city' WHEN abroad_place IS NOT NULL THEN 'place' WHEN regexp_matches(text, '[A-Za-z]{{4,}}') THEN 'foreign' ELSE 'unknown' END AS rule
  FROM (SELECT *, CASE {_PATTERN} WHEN place IS NOT NULL THEN [place.region, place.sub] END AS abroad_place FROM ad_hit)
  LEFT JOIN (SELECT address, min({_L}) AS inner_city FROM (SELECT h.address, p.* FROM ad_hit h JOIN ad_places p ON p.rule = 'city' AND p.region = h.province.region AND contains(text, p.place) WHERE starts_with(text, p.place) OR contains(text, p.place || '市') OR contains(text, p.region || p.place) OR contains(text, p.region || '省' || p.place)) GROUP BY 1) USING (address))""")
query("c27_address_regions", "SELECT address, region, sub, abroad, rule FROM ad_region")(_resolved)
query("c27_rules", "SELECT rule, count(*) AS customers, count(DISTINCT region) AS regions FROM ad JOIN ad_region USING (address) GROUP BY 1")(
    lambda w: _addresses(w).join(_resolved(w), "address").groupBy("rule").agg(F.count("*").alias("customers"), F.count_distinct("region").alias("regions"))
)


def _placed(w, *cols, months=None):
    """Fact rows with the region of their customer's address."""
    return w.fact("customer_id", "month_idx", *cols, months=months).join(_addresses(w).join(_resolved(w).drop("rule"), "address").drop("address"), "customer_id")


cte("ad_fact", "SELECT f.* EXCLUDE (region), r.region, sub, abroad FROM fact f JOIN ad USING (customer_id) JOIN ad_region r USING (address)")
cte("ad_level", f"SELECT *, unnest(CASE WHEN abroad OR region = 'unknown' THEN ['abroad'] WHEN region = '{HOME}' THEN ['province', 'city'] ELSE ['province'] END) AS level FROM ad_fact")
cte("ad_rows", "SELECT * EXCLUDE (sub), CASE level WHEN 'province' THEN '' WHEN 'city' THEN coalesce(nullif(sub, ''), 'unspecified') ELSE sub END AS sub FROM ad_level")
query("b37_places", f"""SELECT level, region, sub, revenue, profit, qty, customers, {mg('profit', 'revenue')} AS margin, revenue/(SELECT {d('sum(revenue)')} FROM fact WHERE {win(12)})*100 AS share, {gr('revenue_m0', 'revenue_m1')} AS mom, {', '.join(f't{i}' for i in range(12))} FROM (
  SELECT level, region, sub, {d('sum(revenue)')} AS revenue, {d('sum(profit)')} AS profit, {d('sum(qty)')} AS qty, count(DISTINCT customer_id) AS customers, {sums(mo(0), 'm0')}, {sums(mo(1), 'm1')}, {', '.join(f"{tot('revenue', f'month_idx = {LM} - {11 - i}')} AS t{i}" for i in range(12))} FROM ad_rows WHERE {win(12)} GROUP BY 1, 2, 3)""", "revenue profit qty margin share mom " + " ".join(f"t{i}" for i in range(12)))(
    lambda w: ops.place_report(_placed(w, *ops.M3, months=12), P(w), HOME).select("level", "region", "sub", *ops.M3, "customers", "margin", "share", "mom", *[F.col("trend")[i].alias(f"t{i}") for i in range(12)])
)


def _leaders(what):
    return f"""SELECT level, region, sub, rank, {what}, revenue_now AS revenue, {mg('profit_now', 'revenue_now')} AS margin, {gr('revenue_now', 'revenue_before')} AS yoy FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY level, region, sub ORDER BY revenue_now DESC, {what}) AS INT) AS rank FROM (SELECT level, region, sub, {what}, {sums(ytd(), 'now', ('revenue', 'profit'))}, {sums(ytd(1), 'before', ('revenue',))} FROM ad_rows GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER ({ytd()}) > 0)) WHERE rank <= 5"""


for _what, _name in (("customer_id", "b37_place_customers"), ("product_id", "b37_place_products")):
    query(_name, _leaders(_what), "revenue margin yoy")(lambda w, what=_what: ops.place_leaders(_placed(w, *({"product_id"} & {what}), "revenue", "profit", months=24), P(w), HOME, what))
query("b37_place_kpis", f"""SELECT *, province_revenue/t*100 AS province_share, abroad_revenue/t*100 AS abroad_share, unknown_revenue/t*100 AS unknown_share FROM (SELECT {tot('revenue', f"region = '{HOME}' AND NOT abroad")} AS province_revenue, {tot('revenue', 'abroad')} AS abroad_revenue, {tot('revenue', "region = 'unknown'")} AS unknown_revenue,
  count(DISTINCT region) FILTER (NOT abroad AND region <> 'unknown') AS provinces, {d('sum(revenue)')} AS t FROM ad_fact WHERE {ytd()})""".replace("SELECT *, province", "SELECT * EXCLUDE (t), province"), "province_revenue abroad_revenue unknown_revenue province_share abroad_share unknown_share")(lambda w: ops.place_kpis(_placed(w, "revenue", months=12), P(w), HOME))
