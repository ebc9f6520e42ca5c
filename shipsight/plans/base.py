"""Shared sub-selects for the SQL texts: the fact, monthly tables, customer attributes."""

from .registry import cte

cte(
    "fact",
    """SELECT CAST(l_shipdate AS DATE) AS ship_date, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  CAST(year(l_shipdate)*12 + month(l_shipdate) AS INT) AS month_idx,
  l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id, l_partkey AS product_id,
  p_brand AS product_line, p_type AS category, p_size >= 46 AS is_new, s_name AS owner, r_name AS region,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'distributor' ELSE 'direct' END AS channel,
  CASE WHEN c_acctbal >= 9000 THEN 'KA' WHEN c_acctbal >= 7500 THEN 'AA' WHEN c_acctbal >= 4500 THEN 'KM' ELSE 'MM' END AS tier,
  CAST(sgn * l_quantity AS DECIMAL(18,4)) AS qty,
  CAST(sgn * l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS revenue,
  CAST(sgn * l_extendedprice * (0.60 + 5 * l_tax) AS DECIMAL(18,4)) AS cost,
  CAST(sgn * l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) - CAST(sgn * l_extendedprice * (0.60 + 5 * l_tax) AS DECIMAL(18,4)) AS profit
FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN -1 ELSE 1 END AS sgn FROM lineitem) l
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
)
cte("lm", "SELECT max(month_idx) AS m FROM fact")
cte(
    "cm",
    """SELECT customer_id, month, month_idx, sum(qty) AS qty, sum(revenue) AS revenue, sum(cost) AS cost,
  sum(profit) AS profit, count(DISTINCT order_id) AS orders FROM fact GROUP BY 1, 2, 3""",
)
cte(
    "pm",
    """SELECT product_id, min(product_line) AS product_line, month, month_idx, sum(qty) AS qty, sum(revenue) AS revenue,
  sum(cost) AS cost, sum(profit) AS profit, bool_or(is_new) AS is_new FROM fact GROUP BY product_id, month, month_idx""",
)
cte(
    "cpm",
    """SELECT customer_id, product_id, min(product_line) AS product_line, min(category) AS category, month, month_idx,
  sum(qty) AS qty, sum(revenue) AS revenue, sum(cost) AS cost, sum(profit) AS profit,
  CAST(sum(revenue) AS DOUBLE) / nullif(CAST(sum(qty) AS DOUBLE), 0) AS price
  FROM fact GROUP BY customer_id, product_id, month, month_idx""",
)
cte(
    "cust",
    """SELECT customer_id, channel, tier, region, owner FROM (SELECT *, row_number() OVER
  (PARTITION BY customer_id ORDER BY ship_date, order_id, line_no, owner) AS rn FROM fact) WHERE rn = 1""",
)
