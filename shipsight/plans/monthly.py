"""Monthly tables, daily KPIs and period comparisons."""

from ..operators import period, silver
from .registry import query

M4 = "qty, revenue, cost, profit"
_D = "CAST({0} AS DOUBLE) AS {0}"
_SUMS = ", ".join(f"CAST({m} AS DECIMAL(38,4)) AS {m}" for m in ("qty", "revenue", "cost", "profit"))


def _wide(df):
    """Same decimal width as the SQL engine's sums."""
    from pyspark.sql import functions as F

    return df.withColumns({m: F.col(m).cast("decimal(38,4)") for m in silver.MONEY if m in df.columns})


@query(
    "a01_customer_month",
    f"SELECT customer_id, month, month_idx, {_SUMS}, orders, CAST(profit AS DOUBLE)/nullif(CAST(revenue AS DOUBLE),0) AS margin FROM cm",
    doubles="margin",
)
def _a01(w):
    return _wide(w.customer_month())


@query(
    "a02_product_month",
    f"""SELECT product_id, month, month_idx, {_SUMS}, is_new,
    CASE WHEN qty > 0 THEN CAST(revenue AS DOUBLE)/CAST(qty AS DOUBLE) END AS avg_price,
    CAST(profit AS DOUBLE)/nullif(CAST(revenue AS DOUBLE),0) AS margin FROM pm""",
    doubles="avg_price margin",
)
def _a02(w):
    return _wide(w.product_month())


@query(
    "a03_customer_product_month",
    f"""SELECT customer_id, product_id, month, month_idx, {_SUMS}, price,
    CAST(profit AS DOUBLE)/nullif(CAST(revenue AS DOUBLE),0) AS margin FROM cpm""",
    doubles="price margin",
)
def _a03(w):
    return _wide(w.customer_product_month())


@query(
    "a04_silver_layer",
    """SELECT f.customer_id, f.product_id, pl.product_line, f.month, f.month_idx,
      CAST(sum(qty) AS DECIMAL(38,4)) AS qty, CAST(sum(revenue) AS DECIMAL(38,4)) AS revenue,
      CAST(sum(cost) AS DECIMAL(38,4)) AS cost, CAST(sum(profit) AS DECIMAL(38,4)) AS profit,
      CAST(sum(profit) AS DOUBLE)/nullif(CAST(sum(revenue) AS DOUBLE),0) AS margin,
      CAST(sum(revenue) AS DOUBLE)/nullif(CAST(sum(qty) AS DOUBLE),0) AS price
    FROM fact f JOIN (SELECT product_id, min(product_line) AS product_line FROM fact GROUP BY 1) pl USING (product_id)
    WHERE month_idx < (SELECT m FROM lm) GROUP BY 1, 2, 3, 4, 5""",
    doubles="margin price",
)
def _a04(w):
    rows = w.fact("ship_date", "month", "month_idx", "order_id", "customer_id", "product_id", "product_line", "is_new", *w.MONEY)
    return _wide(silver.silver_layer(rows, trim_day=25)["customer_product_month"])


@query(
    "a05_daily_kpi",
    """SELECT d.ship_date, d.month_idx, CAST(d.revenue AS DOUBLE) AS revenue, CAST(d.qty AS DOUBLE) AS qty, orders, customers, products,
      CASE WHEN d.month_idx = m THEN CAST(sum(d.revenue) OVER (PARTITION BY d.month_idx ORDER BY d.ship_date) AS DOUBLE) END AS mtd_revenue,
      CASE WHEN d.month_idx = m THEN row_number() OVER (PARTITION BY d.month_idx ORDER BY d.ship_date) END AS mtd_day,
      top_customers, top_products
    FROM (SELECT ship_date, month_idx, sum(revenue) AS revenue, sum(qty) AS qty, count(DISTINCT order_id) AS orders,
            count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products FROM fact GROUP BY 1, 2) d
    CROSS JOIN lm
    JOIN (SELECT ship_date, string_agg(CAST(customer_id AS VARCHAR) || ':' || CAST(CAST(round(r, 0) AS BIGINT) AS VARCHAR), '; ' ORDER BY rn) AS top_customers
          FROM (SELECT ship_date, customer_id, sum(revenue) AS r, row_number() OVER (PARTITION BY ship_date ORDER BY sum(revenue) DESC, customer_id) AS rn
                FROM fact GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1) tc USING (ship_date)
    JOIN (SELECT ship_date, string_agg(CAST(product_id AS VARCHAR) || ':' || CAST(CAST(round(r, 0) AS BIGINT) AS VARCHAR), '; ' ORDER BY rn) AS top_products
          FROM (SELECT ship_date, product_id, sum(revenue) AS r, row_number() OVER (PARTITION BY ship_date ORDER BY sum(revenue) DESC, product_id) AS rn
                FROM fact GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1) tp USING (ship_date)""",
    doubles="revenue qty mtd_revenue",
)
def _a05(w):
    from ..functions.core import dbl

    out = silver.daily_kpi(w.fact("ship_date", "month_idx", "order_id", "customer_id", "product_id", "revenue", "qty"), w.latest)
    return out.withColumns({m: dbl(m) for m in ("revenue", "qty", "mtd_revenue")})


def _change_sql(lag_by: int, idx: str, part: str, label: str, cols) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY {idx} RANGE BETWEEN {lag_by} PRECEDING AND {lag_by} PRECEDING)"
    return ", ".join(f"({c} - max({c}) {w}) / nullif(abs(max({c}) {w}), 0) * 100 AS {c}_{label}" for c in cols)


_PO = ("revenue", "profit", "qty", "asp")


def _period_sql(level: str, idx: str, start: str, back: int) -> str:
    inner = f"""SELECT '{level}' AS level, {idx} AS period_idx, {start} AS period_start, CAST(sum(revenue) AS DOUBLE) AS revenue,
      CAST(sum(profit) AS DOUBLE) AS profit, CAST(sum(qty) AS DOUBLE) AS qty,
      CAST(sum(revenue) AS DOUBLE)/nullif(CAST(sum(qty) AS DOUBLE),0) AS asp,
      CAST(sum(profit) AS DOUBLE)/nullif(CAST(sum(revenue) AS DOUBLE),0)*100 AS margin,
      count(DISTINCT customer_id) AS customers, count(DISTINCT order_id) AS orders FROM fact GROUP BY 2, 3"""
    return f"SELECT *, {_change_sql(1, 'period_idx', 'level', 'prev_pct', _PO)}, {_change_sql(back, 'period_idx', 'level', 'yoy_pct', _PO)} FROM ({inner})"


@query(
    "a09_period_overview",
    _period_sql("month", "month_idx", "month", 12)
    + " UNION ALL "
    + _period_sql("quarter", "CAST(year(ship_date)*4 + quarter(ship_date) AS INT)", "CAST(date_trunc('quarter', ship_date) AS DATE)", 4),
    doubles="revenue profit qty asp margin " + " ".join(f"{c}_{x}" for x in ("prev_pct", "yoy_pct") for c in _PO),
)
def _a09(w):
    return period.period_overview(w.fact("ship_date", "month", "month_idx", "customer_id", "order_id", "revenue", "profit", "qty"))


@query(
    "a10_volume_price_decomposition",
    """SELECT product_line, month_idx, revenue, qty, price, volume_effect, price_effect,
      change - volume_effect - price_effect AS residual, change,
      CASE WHEN change IS NULL THEN NULL WHEN volume_effect >= 0 AND price_effect >= 0 THEN 'both_up' WHEN volume_effect >= 0 THEN 'volume_led'
           WHEN price_effect >= 0 THEN 'price_led' ELSE 'both_down' END AS tag
    FROM (SELECT *, (qty - lag(qty) OVER z) * lag(price) OVER z AS volume_effect, (price - lag(price) OVER z) * qty AS price_effect,
            revenue - lag(revenue) OVER z AS change
          FROM (SELECT product_line, month_idx, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(qty) AS DOUBLE) AS qty,
                  CAST(sum(revenue) AS DOUBLE)/nullif(CAST(sum(qty) AS DOUBLE),0) AS price FROM fact GROUP BY 1, 2)
          WINDOW z AS (PARTITION BY product_line ORDER BY month_idx))""",
    doubles="revenue qty price volume_effect price_effect residual change",
)
def _a10(w):
    return period.volume_price(w.fact("product_line", "month_idx", "revenue", "qty"), ["product_line"])


_RADAR = """SELECT {key}, month_idx, revenue, profit, qty, {extra} {asp},
  {mom}, {yoy} FROM (SELECT {key}, month_idx, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit,
  CAST(sum(qty) AS DOUBLE) AS qty, {aggs} CAST(sum(revenue) AS DOUBLE)/nullif(CAST(sum(qty) AS DOUBLE),0) AS asp FROM {src} GROUP BY 1, 2)"""


@query(
    "a11_key_account_radar",
    _RADAR.format(
        key="customer_id", extra="", aggs="", asp="asp", src="(SELECT * FROM fact WHERE tier IN ('KA','AA'))",
        mom=_change_sql(1, "month_idx", "customer_id", "mom_pct", ("revenue", "profit", "qty")),
        yoy=_change_sql(12, "month_idx", "customer_id", "yoy_pct", ("revenue", "profit", "qty")),
    ),
    doubles="revenue profit qty asp revenue_mom_pct profit_mom_pct qty_mom_pct revenue_yoy_pct profit_yoy_pct qty_yoy_pct",
)
def _a11(w):
    return period.key_account_radar(
        w.fact("customer_id", "month_idx", "revenue", "profit", "qty"), w.customers("tier"), ("KA", "AA")
    )


@query(
    "a12_owner_month",
    _RADAR.format(
        key="owner", extra="customers,", aggs="count(DISTINCT customer_id) AS customers,", asp="asp",
        src="(SELECT cust.owner, f.customer_id, f.month_idx, f.revenue, f.profit, f.qty FROM fact f JOIN cust ON f.customer_id = cust.customer_id)",
        mom=_change_sql(1, "month_idx", "owner", "mom_pct", ("revenue", "profit", "qty")),
        yoy=_change_sql(12, "month_idx", "owner", "yoy_pct", ("revenue", "profit", "qty")),
    ),
    doubles="revenue profit qty asp revenue_mom_pct profit_mom_pct qty_mom_pct revenue_yoy_pct profit_yoy_pct qty_yoy_pct",
)
def _a12(w):
    return period.owner_month(w.fact("customer_id", "month_idx", "revenue", "profit", "qty"), w.customers("owner"))
