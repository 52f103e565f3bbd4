"""More TPC-H shapes, put to the local tables: there is no partsupp, and dates, modes and phones are fewer."""

from __future__ import annotations

from typing import Any

import loomframe as lf
from loomframe import col

from .queries import q, r, ts

PRICE = col("l_extendedprice") * (1 - col("l_discount"))


@q("tpch_q2", """WITH c AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY ALL), e AS (SELECT c.*, s_name, s_acctbal, n_name, p_brand FROM c
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE r_name = 'EUROPE' AND p_size < 15 AND p_type = 'PROMO')
 SELECT s_acctbal, s_name, n_name, l_partkey, p_brand, round(cost, 6) AS cost FROM e QUALIFY cost = min(cost) OVER (PARTITION BY l_partkey)""", "lineitem", "supplier", "nation", "region", "part")
def tpch_q2(li: Any, s: Any, n: Any, rg: Any, p: Any) -> Any:
    near = s.join(n.join(rg.filter(r_name="EUROPE"), left_on="n_regionkey", right_on="r_regionkey"), left_on="s_nationkey", right_on="n_nationkey")
    cost = li.group_by("l_partkey", "l_suppkey").agg((col("l_extendedprice") / col("l_quantity")).min().alias("cost"))
    e = cost.join(near, left_on="l_suppkey", right_on="s_suppkey").join(p.filter(col("p_size") < 15, p_type="PROMO"), left_on="l_partkey", right_on="p_partkey")
    return e.filter(col("cost") == col("cost").min().over("l_partkey")).select("s_acctbal", "s_name", "n_name", "l_partkey", "p_brand", r(col("cost")))


@q("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1", "orders", "lineitem")
def tpch_q4(o: Any, li: Any) -> Any:
    late = o.filter(col("o_orderdate") >= ts(1997, 7, 1), col("o_orderdate") < ts(1997, 10, 1))
    return late.join(li.filter(l_returnflag="R"), left_on="o_orderkey", right_on="l_orderkey", how="semi").group_by("o_orderpriority").agg(lf.len_().alias("order_count"))


@q("tpch_q7", """SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
 JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_regionkey = 2 AND b.n_regionkey = 3 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY ALL""", "supplier", "lineitem", "orders", "customer", "nation")
def tpch_q7(s: Any, li: Any, o: Any, c: Any, n: Any) -> Any:
    a, b = (n.filter(n_regionkey=k).select("n_nationkey", col("n_name").alias(x)) for k, x in ((2, "supp_nation"), (3, "cust_nation")))
    sold = li.filter(col("l_shipdate").is_between(ts(1996, 1, 1), ts(1998, 12, 31))).join(s.join(a, left_on="s_nationkey", right_on="n_nationkey"), left_on="l_suppkey", right_on="s_suppkey")
    j = sold.join(o, left_on="l_orderkey", right_on="o_orderkey").join(c.join(b, left_on="c_nationkey", right_on="n_nationkey"), left_on="o_custkey", right_on="c_custkey")
    return j.with_columns(l_year=col("l_shipdate").dt.year()).group_by("supp_nation", "cust_nation", "l_year").agg(PRICE.sum().round(4).alias("revenue"))


@q("tpch_q8", """SELECT CAST(year(o_orderdate) AS INT) AS o_year, round(sum(CASE WHEN a.n_name = 'NATION_7' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share FROM part JOIN lineitem ON p_partkey = l_partkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation b ON c_nationkey = b.n_nationkey JOIN nation a ON s_nationkey = a.n_nationkey WHERE b.n_regionkey = 1 AND p_type = 'ECONOMY' GROUP BY 1""", "part", "lineitem", "supplier", "orders", "customer", "nation")
def tpch_q8(p: Any, li: Any, s: Any, o: Any, c: Any, n: Any) -> Any:
    j = li.join(p.filter(p_type="ECONOMY"), left_on="l_partkey", right_on="p_partkey").join(s.join(n, left_on="s_nationkey", right_on="n_nationkey").select("s_suppkey", "n_name"), left_on="l_suppkey", right_on="s_suppkey")
    j = j.join(o, left_on="l_orderkey", right_on="o_orderkey").join(c.join(n.filter(n_regionkey=1), left_on="c_nationkey", right_on="n_nationkey", how="semi"), left_on="o_custkey", right_on="c_custkey")
    return j.with_columns(o_year=col("o_orderdate").dt.year(), volume=PRICE).group_by("o_year").agg(r(lf.when(col("n_name") == "NATION_7").then(col("volume")).otherwise(0).sum() / col("volume").sum()).alias("mkt_share"))


@q("tpch_q9", """SELECT n_name, CAST(year(o_orderdate) AS INT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 3) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
 JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%bolt%' GROUP BY ALL""", "part", "lineitem", "supplier", "orders", "nation")
def tpch_q9(p: Any, li: Any, s: Any, o: Any, n: Any) -> Any:
    j = li.join(p.filter(col("p_name").str.contains("bolt", literal=True)), left_on="l_partkey", right_on="p_partkey").join(s.join(n, left_on="s_nationkey", right_on="n_nationkey"), left_on="l_suppkey", right_on="s_suppkey").join(o, left_on="l_orderkey", right_on="o_orderkey")
    return j.with_columns(o_year=col("o_orderdate").dt.year()).group_by("n_name", "o_year").agg((PRICE - col("p_retailprice") * col("l_quantity")).sum().round(3).alias("profit"))


@q("tpch_q11", """WITH v AS (SELECT l_partkey, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 10 GROUP BY 1)
 SELECT l_partkey, round(v, 3) AS value FROM v WHERE v > 2 * (SELECT avg(v) FROM v)""", "lineitem", "supplier")
def tpch_q11(li: Any, s: Any) -> Any:
    v = li.join(s.filter(col("s_nationkey") < 10), left_on="l_suppkey", right_on="s_suppkey", how="semi").group_by("l_partkey").agg(col("l_extendedprice").sum().alias("value"))
    return v.filter(col("value") > 2 * col("value").mean()).with_columns(col("value").round(3))


@q("tpch_q12", """SELECT l_returnflag, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey
 WHERE l_linestatus = 'O' AND l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1""", "orders", "lineitem")
def tpch_q12(o: Any, li: Any) -> Any:
    j = li.filter(col("l_shipdate") >= ts(1998, 1, 1), col("l_shipdate") < ts(1999, 1, 1), l_linestatus="O").join(o, left_on="l_orderkey", right_on="o_orderkey").filter(col("l_shipdate") > col("o_orderdate"))
    high = col("o_orderpriority").is_in(["1-URGENT", "2-HIGH"])
    return j.group_by("l_returnflag").agg(high.sum().alias("high"), (~high).sum().alias("low"))


@q("tpch_q16", """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#5' AND p_type <> 'PROMO' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""", "lineitem", "part", "supplier")
def tpch_q16(li: Any, p: Any, s: Any) -> Any:
    j = li.join(p.filter(col("p_brand") != "Brand#5", col("p_type") != "PROMO", col("p_size").is_in([3, 9, 14, 19, 23, 36, 45, 49])), left_on="l_partkey", right_on="p_partkey")
    return j.join(s.filter(col("s_acctbal") < 0), left_on="l_suppkey", right_on="s_suppkey", how="anti").group_by("p_brand", "p_type", "p_size").agg(col("l_suppkey").n_unique().alias("supplier_cnt"))


@q("tpch_q19", """SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 15)
 OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 40)""", "lineitem", "part")
def tpch_q19(li: Any, p: Any) -> Any:
    qty, size, brand = col("l_quantity"), col("p_size"), col("p_brand")
    some = ((brand == "Brand#12") & qty.is_between(1, 21) & size.is_between(1, 15)) | ((brand == "Brand#23") & qty.is_between(10, 30) & size.is_between(1, 30)) | ((brand == "Brand#4") & qty.is_between(20, 40))
    return li.join(p, left_on="l_partkey", right_on="p_partkey").filter(some).select(PRICE.sum().round(4).alias("revenue"))


@q("tpch_q20", """SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
 GROUP BY l_partkey, l_suppkey HAVING sum(l_quantity) > 60)""", "supplier", "nation", "lineitem", "part")
def tpch_q20(s: Any, n: Any, li: Any, p: Any) -> Any:
    much = li.join(p.filter(col("p_name").str.starts_with("small")), left_on="l_partkey", right_on="p_partkey", how="semi").group_by("l_partkey", "l_suppkey").agg(col("l_quantity").sum()).filter(col("l_quantity") > 60)
    return s.join(n.filter(n_regionkey=2), left_on="s_nationkey", right_on="n_nationkey", how="semi").join(much, left_on="s_suppkey", right_on="l_suppkey", how="semi").select("s_suppkey", "s_name")


@q("tpch_q21", """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l ON s_suppkey = l.l_suppkey JOIN orders ON o_orderkey = l.l_orderkey WHERE o_orderstatus = 'F' AND l.l_returnflag = 'R'
 AND EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey <> l.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey <> l.l_suppkey AND m.l_returnflag = 'R') GROUP BY 1""", "supplier", "lineitem", "orders")
def tpch_q21(s: Any, li: Any, o: Any) -> Any:
    by = li.group_by("l_orderkey").agg(col("l_suppkey").n_unique().alias("all"), col("l_suppkey").filter(col("l_returnflag") == "R").n_unique().alias("late"))
    one = by.filter(col("all") > 1, col("late") == 1).join(o.filter(o_orderstatus="F"), left_on="l_orderkey", right_on="o_orderkey", how="semi")
    j = li.filter(l_returnflag="R").join(one, on="l_orderkey", how="semi").join(s, left_on="l_suppkey", right_on="s_suppkey")
    return j.group_by("s_name").agg(lf.len_().alias("numwait"))


@q("tpch_q22", """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 3) AS totacctbal FROM customer WHERE c_nationkey IN (3, 1, 2, 9, 13, 17, 18) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (3, 1, 2, 9, 13, 17, 18))
 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1""", "customer", "orders")
def tpch_q22(c: Any, o: Any) -> Any:
    some = c.filter(col("c_nationkey").is_in([3, 1, 2, 9, 13, 17, 18]))
    rich = some.filter(col("c_acctbal") > col("c_acctbal").filter(col("c_acctbal") > 0).mean())
    return rich.join(o.filter(o_orderstatus="P"), left_on="c_custkey", right_on="o_custkey", how="anti").group_by("c_nationkey").agg(lf.len_().alias("numcust"), col("c_acctbal").sum().round(3).alias("totacctbal"))
