"""What an independent SQL engine computes for the queries of ``decision_support``."""

_LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS ship,
  CAST(l_quantity AS DECIMAL(15,2)) AS qty, CAST(l_extendedprice AS DECIMAL(15,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc,
  CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(5,2)) AS DECIMAL(20,4)) AS net FROM lineitem)"""
_ORD = "ord AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DECIMAL(15,2)) AS total, CAST(o_orderdate AS DATE) AS od FROM orders)"
_PS = "ps AS (SELECT l_partkey AS pk, l_suppkey AS sk, CAST(SUM(l_linenumber) AS BIGINT) AS avail, MIN(CAST(l_extendedprice AS DECIMAL(15,2))) AS cost FROM lineitem GROUP BY 1, 2)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


ORACLES = {
    "tpch_q1": _with(_LI) + """SELECT l_returnflag, l_linestatus, CAST(SUM(qty) AS DECIMAL(38,2)) AS sum_qty, CAST(SUM(price) AS DECIMAL(38,2)) AS sum_base_price,
      CAST(SUM(net) AS DECIMAL(38,4)) AS sum_disc_price, CAST(SUM(CAST(net * CAST(1 + tax AS DECIMAL(5,2)) AS DECIMAL(25,6))) AS DECIMAL(38,6)) AS sum_charge,
      ROUND(AVG(CAST(qty AS DOUBLE)), 6) AS avg_qty, ROUND(AVG(CAST(price AS DOUBLE)), 6) AS avg_price, ROUND(AVG(CAST(disc AS DOUBLE)), 6) AS avg_disc, COUNT(*) AS count_order
      FROM li WHERE ship <= DATE '1998-09-02' GROUP BY 1, 2""",
    "tpch_q2": _with(_PS, "offer AS (SELECT * FROM ps JOIN supplier ON sk = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')") + """
      SELECT CAST(s_acctbal AS DECIMAL(15,2)) AS s_acctbal, s_name, n_name, p_partkey FROM offer o JOIN part ON p_partkey = o.pk
      WHERE p_size = 15 AND cost = (SELECT MIN(i.cost) FROM offer i WHERE i.pk = o.pk)""",
    "tpch_q3": _with(_LI, _ORD) + """SELECT l_orderkey, od AS o_orderdate, CAST(SUM(net) AS DECIMAL(38,4)) AS revenue FROM customer, ord, li
      WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_mktsegment = 'BUILDING' AND od < DATE '1998-03-15' AND ship > DATE '1998-03-15' GROUP BY 1, 2""",
    "tpch_q4": _with(_ORD) + """SELECT o_orderpriority, COUNT(*) AS order_count FROM ord WHERE od >= DATE '1997-07-01' AND od < DATE '1997-10-01'
      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""",
    "tpch_q5": _with(_LI, _ORD) + """SELECT n_name, CAST(SUM(net) AS DECIMAL(38,4)) AS revenue FROM customer, ord, li, supplier, nation, region
      WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
      AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND YEAR(od) = 1997 GROUP BY 1""",
    "tpch_q6": _with(_LI) + """SELECT CAST(SUM(CAST(price * disc AS DECIMAL(19,4))) AS DECIMAL(38,4)) AS revenue FROM li
      WHERE YEAR(ship) = 1997 AND disc BETWEEN 0.05 AND 0.07 AND qty < 24""",
    "tpch_q7": _with(_LI) + """SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(YEAR(ship) AS BIGINT) AS l_year, CAST(SUM(net) AS DECIMAL(38,4)) AS revenue
      FROM supplier, li, orders, customer, nation a, nation b WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
      AND s_nationkey = a.n_nationkey AND c_nationkey = b.n_nationkey AND ship BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
      AND ((a.n_name = 'NATION_6' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_6')) GROUP BY 1, 2, 3""",
    "tpch_q8": _with(_LI, _ORD) + """SELECT CAST(YEAR(od) AS BIGINT) AS o_year,
      ROUND(CAST(SUM(CASE WHEN b.n_name = 'NATION_2' THEN net ELSE 0 END) AS DOUBLE) / CAST(SUM(net) AS DOUBLE), 6) AS mkt_share
      FROM part, supplier, li, ord, customer, nation a, nation b, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey
      AND o_custkey = c_custkey AND c_nationkey = a.n_nationkey AND a.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = b.n_nationkey
      AND od BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p_type = 'ECONOMY' GROUP BY 1""",
    "tpch_q9": _with(_LI, _ORD, _PS) + """SELECT n_name AS nation, CAST(YEAR(od) AS BIGINT) AS o_year, CAST(SUM(CAST(net - cost * qty AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS sum_profit
      FROM part, supplier, li, ps, ord, nation WHERE s_suppkey = l_suppkey AND sk = l_suppkey AND pk = l_partkey AND p_partkey = l_partkey
      AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%gear%' GROUP BY 1, 2""",
    "tpch_q10": _with(_LI, _ORD) + """SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, n_name, CAST(SUM(net) AS DECIMAL(38,4)) AS revenue
      FROM customer, ord, li, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND l_returnflag = 'R'
      AND od >= DATE '1997-10-01' AND od < DATE '1998-01-01' GROUP BY 1, 2, 3, 4""",
    "tpch_q11": _with(_PS, "held AS (SELECT pk, cost * avail AS v FROM ps JOIN supplier ON sk = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')") + """
      SELECT pk AS ps_partkey, CAST(SUM(v) AS DECIMAL(38,2)) AS worth FROM held GROUP BY 1
      HAVING CAST(SUM(v) AS DOUBLE) > (SELECT CAST(SUM(v) AS DOUBLE) * 0.001 FROM held)""",
    "tpch_q12": _with(_LI, _ORD) + """SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
      CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
      FROM li JOIN ord ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND YEAR(ship) = 1997 AND ship > od GROUP BY 1""",
    "tpch_q13": """SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders
      ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%URGENT%' AND o_orderstatus = 'O' GROUP BY 1) AS t GROUP BY 1""",
    "tpch_q14": _with(_LI) + """SELECT ROUND(100.0 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN net ELSE 0 END) AS DOUBLE) / CAST(SUM(net) AS DOUBLE), 6) AS promo_revenue
      FROM li JOIN part ON l_partkey = p_partkey WHERE ship >= DATE '1997-09-01' AND ship < DATE '1997-10-01'""",
    "tpch_q15": _with(_LI, "rev AS (SELECT l_suppkey AS sk, CAST(SUM(net) AS DECIMAL(38,4)) AS r FROM li WHERE ship >= DATE '1996-01-01' AND ship < DATE '1996-04-01' GROUP BY 1)") + """
      SELECT s_suppkey, s_name, r AS total_revenue FROM supplier JOIN rev ON s_suppkey = sk WHERE r = (SELECT MAX(r) FROM rev)""",
    "tpch_q16": _with(_PS) + """SELECT p_brand, p_type, p_size, COUNT(DISTINCT sk) AS supplier_cnt FROM ps JOIN part ON p_partkey = pk
      WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MED%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
      AND sk NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3""",
    "tpch_q17": _with(_LI) + """SELECT ROUND(CAST(SUM(price) AS DOUBLE) / 7.0, 4) AS avg_yearly FROM li o JOIN part ON p_partkey = l_partkey
      WHERE p_brand = 'Brand#23' AND CAST(qty AS DOUBLE) < (SELECT 0.5 * AVG(CAST(i.qty AS DOUBLE)) FROM li i WHERE i.l_partkey = p_partkey)""",
    "tpch_q18": _with(_LI, _ORD) + """SELECT c_name, c_custkey, o_orderkey, od AS o_orderdate, total AS o_totalprice, CAST(SUM(qty) AS DECIMAL(38,2)) AS sum_qty
      FROM customer, ord, li WHERE o_orderkey IN (SELECT l_orderkey FROM li GROUP BY 1 HAVING SUM(qty) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
      GROUP BY 1, 2, 3, 4, 5""",
    "tpch_q19": _with(_LI) + """SELECT CAST(SUM(net) AS DECIMAL(38,4)) AS revenue FROM li, part WHERE p_partkey = l_partkey AND l_returnflag IN ('A', 'R') AND (
      (p_brand = 'Brand#12' AND p_type IN ('PROMO', 'SMALL', 'ECONOMY') AND qty BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
      OR (p_brand = 'Brand#23' AND p_type IN ('MEDIUM', 'STANDARD', 'PROMO') AND qty BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 20)
      OR (p_brand = 'Brand#24' AND p_type IN ('LARGE', 'ECONOMY', 'STANDARD') AND qty BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 25))""",
    "tpch_q20": _with(_LI, _PS) + """SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (
      SELECT sk FROM ps WHERE pk IN (SELECT p_partkey FROM part WHERE p_name LIKE 'cold%')
      AND CAST(avail AS DOUBLE) > (SELECT 0.5 * CAST(SUM(qty) AS DOUBLE) FROM li WHERE l_partkey = pk AND l_suppkey = sk AND YEAR(ship) = 1997))""",
    "tpch_q21": """SELECT s_name, COUNT(*) AS numwait FROM supplier, lineitem a, orders WHERE s_suppkey = a.l_suppkey AND o_orderkey = a.l_orderkey AND o_orderstatus = 'F'
      AND a.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
      AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R') GROUP BY 1""",
    "tpch_q22": _with("own AS (SELECT c_custkey, SUBSTRING(c_mktsegment, 1, 2) AS cntrycode, CAST(c_acctbal AS DECIMAL(15,2)) AS bal FROM customer WHERE SUBSTRING(c_mktsegment, 1, 2) IN ('AU', 'BU', 'FU', 'HO', 'MA'))") + """
      SELECT cntrycode, COUNT(*) AS numcust, CAST(SUM(bal) AS DECIMAL(38,2)) AS totacctbal FROM own WHERE CAST(bal AS DOUBLE) > (SELECT AVG(CAST(bal AS DOUBLE)) FROM own WHERE bal > 0)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1""",
}
