"""Address rules: one case per rule, and the whole against a plain loop over the table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shipsight.operators import address

PROVINCES = ["内蒙古", "黑龙江", "北京", "上海", "江苏", "浙江", "湖北", "广东", "广西", "重庆", "香港", "澳门", "台湾"]
HARBOUR = {"香港", "澳门", "台湾"}
ROWS = (
    [("junk", 1, w, "", "", False) for w in ("测试", "test")]
    + [("terms", 1, w, "广东", "深圳市", False) for w in ("FOB", "深圳")]
    + [("full", i, w, r, "", r in HARBOUR) for i, (w, r) in enumerate([("北京市", "北京"), ("内蒙古自治区", "内蒙古"), ("广西壮族自治区", "广西"), ("香港特别行政区", "香港"), ("台湾省", "台湾")])]
    + [("province", i, w, w, "", w in HARBOUR) for i, w in enumerate(PROVINCES)]
    + [("city", i, c, r, f"{c}市", False) for i, (c, r) in enumerate([("深圳", "广东"), ("广州", "广东"), ("惠州", "广东"), ("杭州", "浙江"), ("苏州", "江苏"), ("武汉", "湖北"), ("北京", "北京"), ("上海", "上海"), ("呼和浩特", "内蒙古"), ("南宁", "广西")])]
    + [("district", i, w, "广东", "深圳市", False) for i, w in enumerate(["福田区", "宝安区"])]
    + [("place", 1, w, "台湾", s, True) for w, s in (("高雄", "高雄市"), ("新竹", "新竹市"))]
    + [("place", 2, w, "香港", s, True) for w, s in (("九龍", "九龙"), ("新界", "新界"))]
    + [("place", 3, w, "澳门", "", True) for w in ("澳門", "Macau")]
    + [("place", 4, w, "韩国", s, True) for w, s in (("Seoul", "首尔"), ("Incheon", "仁川"))]
    + [("place", 5, w, "台湾", "", True) for w in ("均德實業",)]
    + [("place", 6, w, r, "", True) for w, r in (("Japan", "日本"), ("India", "印度"), ("Indiana", "美国"))]
)
PATTERNS = [(1, r"^\d{3,5}\s*[台新高]", "台湾", "", True), (2, r"(?i)Hong\s?Kong", "香港", "", True)]
PREFIXES = ["停用-", "OLD-", "中国"]
CASES = [
    (None, "unknown", "", False, "junk"), ("", "unknown", "", False, "junk"), ("18934606766", "unknown", "", False, "junk"), ("深圳测试地址", "unknown", "", False, "junk"), ("--", "unknown", "", False, "junk"),
    ("FOB深圳机场", "广东", "深圳市", False, "terms"), ("广东省惠州市惠阳区三和街道", "广东", "惠州市", False, "province"), ("停用-广东省深圳市南山区", "广东", "深圳市", False, "province"), ("中国广东深圳宝安区某工业园", "广东", "深圳市", False, "province"),
    ("内蒙古自治区呼和浩特市赛罕区", "内蒙古", "呼和浩特市", False, "province"), ("上海上海市浦东新区", "上海", "", False, "province"), ("北京市海淀区", "北京", "", False, "province"), ("某园区 江苏 工厂", "江苏", "", False, "province"),
    ("幸福省广东路", "unknown", "", False, "unknown"), ("宝安区西乡街道", "广东", "深圳市", False, "district"), ("深圳宝安区", "广东", "深圳市", False, "city"), ("寄到武汉市", "湖北", "武汉市", False, "city"), ("寄到武汉", "unknown", "", False, "unknown"),
    ("台湾省高雄市前镇区", "台湾", "高雄市", True, "place"), ("300 新竹科學園", "台湾", "新竹市", True, "place"), ("104 台北", "台湾", "", True, "place"), ("香港新界元朗", "香港", "新界", True, "place"), ("Unit 3, HongKong", "香港", "", True, "place"),
    ("澳門氹仔", "澳门", "", True, "place"), ("1 Guro, Seoul", "韩国", "首尔", True, "place"), ("均德實業收", "台湾", "", True, "place"), ("1-1-1 Chiyoda, Tokyo, Japan", "日本", "", True, "place"), ("Gary, Indiana", "美国", "", True, "place"),
    ("12 Abbey Road", "overseas", "", True, "foreign"), ("幸福大街1号院", "unknown", "", False, "unknown"), ("  OLD-广州  ", "广东", "广州市", False, "city"),
]


def resolved(spark, addresses, rows=ROWS):
    places = spark.createDataFrame(rows, address.PLACES)
    df = spark.createDataFrame([(a,) for a in addresses], "address string")
    out = address.resolve(df, places, patterns=PATTERNS, prefixes=PREFIXES).collect()
    assert len(out) == len(set(addresses))
    return {r.address: (r.region, r.sub, r.abroad, r.rule) for r in out}


def test_every_rule(spark):
    got = resolved(spark, [c[0] for c in CASES] * 2)
    assert got == {c[0]: c[1:] for c in CASES}
    assert {r[3] for r in got.values()} == {"junk", "terms", "province", "district", "city", "place", "foreign", "unknown"}


def plain(text):
    """The rules as a loop over the table."""
    t = (text or "").strip()
    for p in PREFIXES:
        if t.startswith(p):
            t = t[len(p) :].strip()
    of = lambda rule: [r for r in ROWS if r[0] == rule]
    if not t or any(r[2] in t for r in of("junk")) or re.match(r"^(\d{7,}|-+|无|nan|None)$", t):
        return "unknown", "", False, "junk"
    if all(r[2] in t for r in of("terms")):
        return "广东", "深圳市", False, "terms"
    full = [r for r in of("full") if t.startswith(r[2])]
    head = re.match(r"^(\S{1,5}?)省", t)
    province = full[0] if full else next((r for r in of("province") if head and r[2] == head[1]), None) if head else next((r for r in of("province") if r[2] in t), None)
    cities = sorted(of("city"), key=lambda r: (-len(r[2]), r[1]))
    if province and not province[5]:
        for c in cities:
            if c[3] == province[3] and (t.startswith(c[2]) or c[2] + "市" in t or re.search(c[3] + "省?" + c[2], t)):
                return province[3], "" if c[2] == c[3] else c[4], False, "province"
        return province[3], "", False, "province"
    for r in of("district"):
        if t.startswith(r[2]):
            return r[3], r[4], False, "district"
    for c in cities:
        if t.startswith(c[2]) or c[2] + "市" in t:
            return c[3], "" if c[2] == c[3] else c[4], False, "city"
    for rank in range(1, 7):
        for r in sorted((r for r in of("place") if r[1] == rank and r[2] in t), key=lambda r: (-len(r[2]), r[2])):
            return r[3], r[4], r[5], "place"
        for n, p, region, sub, abroad in PATTERNS:
            if n == rank and re.search(p, t):
                return region, sub, abroad, "place"
    return ("overseas", "", True, "foreign") if re.search("[A-Za-z]{4,}", t) else ("unknown", "", False, "unknown")


def test_equals_a_loop_over_the_table(spark):
    rng = random.Random(2)
    parts = sorted({r[2] for r in ROWS if r[0] != "junk"}) + ["市", "省", "路", "1号", " ", "Abbey", "Hong Kong", "300"]
    addresses = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(1500)]
    assert resolved(spark, addresses) == {a: plain(a) for a in addresses}


def test_without_places_and_long_texts(spark):
    long = "街" * 30_000 + "武汉市"
    assert resolved(spark, [long])[long] == ("湖北", "武汉市", False, "city")
    assert resolved(spark, ["Abbey Road", "Hong Kong"], rows=[]) == {"Abbey Road": ("overseas", "", True, "foreign"), "Hong Kong": ("香港", "", True, "place")}


@pytest.mark.parametrize("short,full", [("广东", "广东省"), ("北京", "北京市"), ("内蒙古", "内蒙古自治区"), ("某地", "某地")])
def test_full_names(spark, short, full):
    row = spark.range(1).select(address.full_name(F.lit(short), {"内蒙古": "内蒙古自治区"}, ["广东", "内蒙古"], ["北京"]).alias("x"))
    assert row.first().x == full


def test_pieces_do_not_travel_through_the_driver(spark, monkeypatch):
    """The pieces of the addresses are never the broadcast side, and a table of many places gives the same rows by sorting."""
    texts = [c[0] for c in CASES]
    df = spark.createDataFrame([(t,) for t in texts], "address string")
    places = spark.createDataFrame(ROWS, address.PLACES)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    few = address.resolve(df, places, patterns=PATTERNS, prefixes=PREFIXES)
    assert re.search(r"BroadcastHashJoin \[piece#\d+\], \[place#\d+\], Inner, BuildRight", plan(few))
    monkeypatch.setattr(address, "BROADCAST_PLACES", len(ROWS) - 1)
    many = address.resolve(df, places, patterns=PATTERNS, prefixes=PREFIXES)
    assert re.search(r"SortMergeJoin \[piece#\d+\], \[place#\d+\], Inner", plan(many))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
