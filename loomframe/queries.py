"""Queries that show every operator on the driver's tables, with the same result as SQL for DuckDB.

Floating results are rounded to 6 places on both sides, so that the order of summing doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import loomframe as lf
from loomframe import col, lit
from loomframe import dtypes as dt
from loomframe import selectors as cs

QUERIES: dict[str, Callable[[Any, str], Any]] = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None, *tables: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Register a query over tables; the function gets a lazy frame for each."""

    def add(fn: Callable[..., Any]) -> Callable[..., Any]:
        def run(spark: Any, sf_dir: str) -> Any:
            return fn(*[lf.scan_parquet(spark, f"{sf_dir}/{t}.parquet") for t in tables]).to_native()

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def simple(name: str, table: str, exprs: Callable[[], list[Any]], sql: str) -> None:
    q(name, f"SELECT {sql} FROM {table}", table)(lambda f: f.select(*exprs()))


def r(e: Any) -> Any:
    return e.round(6)


# --- whole queries ----------------------------------------------------------------------------------------------
import datetime as _d  # noqa: E402


def ts(*a: int) -> Any:
    return lit(_d.datetime(*a)).cast(dt.Datetime("us"))


@q("tpch_q1", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS sum_charge,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL""", "lineitem")
def tpch_q1(f: Any) -> Any:
    price = col("l_extendedprice") * (1 - col("l_discount"))
    return f.filter(col("l_shipdate") <= ts(2001, 9, 2)).with_columns(disc_price=price, charge=price * (1 + col("l_tax"))).group_by("l_returnflag", "l_linestatus").agg(
        r(col("l_quantity").sum()).alias("sum_qty"), col("l_extendedprice").sum().round(4).alias("sum_base_price"), col("disc_price").sum().round(4).alias("sum_disc_price"),
        col("charge").sum().round(4).alias("sum_charge"), r(col("l_quantity").mean()).alias("avg_qty"), r(col("l_extendedprice").mean()).alias("avg_price"), r(col("l_discount").mean()).alias("avg_disc"), lf.len_().alias("count_order"),
    )


@q("tpch_q3", """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
 JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
 GROUP BY ALL ORDER BY revenue DESC, o_orderkey DESC LIMIT 10""", "customer", "orders", "lineitem")
def tpch_q3(c: Any, o: Any, li: Any) -> Any:
    cut = ts(1998, 3, 15)
    j = c.filter(c_mktsegment="BUILDING").join(o.filter(col("o_orderdate") < cut), left_on="c_custkey", right_on="o_custkey").join(li.filter(col("l_shipdate") > cut), left_on="o_orderkey", right_on="l_orderkey")
    return j.group_by("o_orderkey", "o_orderdate").agg((col("l_extendedprice") * (1 - col("l_discount"))).sum().round(4).alias("revenue")).top_k(10, by=["revenue", "o_orderkey"])


@q("tpch_q5", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'ASIA' GROUP BY n_name""", "customer", "orders", "lineitem", "supplier", "nation", "region")
def tpch_q5(c: Any, o: Any, li: Any, s: Any, n: Any, rg: Any) -> Any:
    small = s.join(n.join(rg.filter(r_name="ASIA"), left_on="n_regionkey", right_on="r_regionkey"), left_on="s_nationkey", right_on="n_nationkey")
    j = c.join(o, left_on="c_custkey", right_on="o_custkey").join(li, left_on="o_orderkey", right_on="l_orderkey").join(small, left_on=["l_suppkey", "c_nationkey"], right_on=["s_suppkey", "s_nationkey"])
    return j.group_by("n_name").agg((col("l_extendedprice") * (1 - col("l_discount"))).sum().round(4).alias("revenue"))


@q("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", "lineitem")
def tpch_q6(f: Any) -> Any:
    return f.filter(col("l_shipdate") >= ts(1996, 1, 1), col("l_shipdate") < ts(1997, 1, 1), col("l_discount").is_between(0.05, 0.07), col("l_quantity") < 24).select((col("l_extendedprice") * col("l_discount")).sum().round(4).alias("revenue"))


@q("tpch_q10", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01' GROUP BY ALL ORDER BY revenue DESC, c_custkey DESC LIMIT 20""", "customer", "orders", "lineitem", "nation")
def tpch_q10(c: Any, o: Any, li: Any, n: Any) -> Any:
    j = c.join(o.filter(col("o_orderdate") >= ts(1997, 1, 1), col("o_orderdate") < ts(1997, 4, 1)), left_on="c_custkey", right_on="o_custkey").join(li.filter(l_returnflag="R"), left_on="o_orderkey", right_on="l_orderkey").join(n, left_on="c_nationkey", right_on="n_nationkey")
    return j.group_by("c_custkey", "c_name", "c_acctbal", "n_name").agg((col("l_extendedprice") * (1 - col("l_discount"))).sum().round(4).alias("revenue")).top_k(20, by=["revenue", "c_custkey"])


@q("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1", "customer", "orders")
def tpch_q13(c: Any, o: Any) -> Any:
    return c.join(o, left_on="c_custkey", right_on="o_custkey", how="left").group_by("c_custkey").agg(col("o_orderkey").count().alias("c_count")).group_by("c_count").agg(lf.len_().alias("custdist"))


@q("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey", "lineitem", "part")
def tpch_q14(li: Any, p: Any) -> Any:
    price = col("l_extendedprice") * (1 - col("l_discount"))
    return li.join(p, left_on="l_partkey", right_on="p_partkey").select(r(100.0 * lf.when(col("p_type") == "PROMO").then(price).otherwise(0).sum() / price.sum()).alias("promo_revenue"))


@q("tpch_q15", "WITH rev AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem GROUP BY 1) SELECT s_suppkey, s_name, total FROM supplier JOIN rev ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM rev)", "lineitem", "supplier")
def tpch_q15(li: Any, s: Any) -> Any:
    rev = li.group_by("l_suppkey").agg((col("l_extendedprice") * (1 - col("l_discount"))).sum().round(4).alias("total"))
    return s.join(rev.filter(col("total") == col("total").max()), left_on="s_suppkey", right_on="l_suppkey").select("s_suppkey", "s_name", "total")


@q("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM (SELECT l_extendedprice, l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey) AS a FROM lineitem) WHERE l_quantity < 0.2 * a", "lineitem")
def tpch_q17(li: Any) -> Any:
    return li.filter(col("l_quantity") < 0.2 * col("l_quantity").mean().over("l_partkey")).select((col("l_extendedprice").sum() / 7.0).round(4).alias("avg_yearly"))


@q("tpch_q18", "SELECT o_orderkey, o_custkey, round(sum(l_quantity), 4) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200) GROUP BY ALL", "orders", "lineitem")
def tpch_q18(o: Any, li: Any) -> Any:
    big = li.group_by("l_orderkey").agg(col("l_quantity").sum().alias("s")).filter(col("s") > 200)
    return o.join(big, left_on="o_orderkey", right_on="l_orderkey", how="semi").join(li, left_on="o_orderkey", right_on="l_orderkey").group_by("o_orderkey", "o_custkey").agg(col("l_quantity").sum().round(4).alias("qty"))


# --- frame operators ------------------------------------------------------------------------------------------------
q("frame_with_columns", "SELECT *, o_totalprice * 2 AS dbl, upper(o_orderstatus) AS st FROM orders", "orders")(lambda o: o.with_columns((col("o_totalprice") * 2).alias("dbl"), st=col("o_orderstatus").str.to_uppercase()))
q("frame_select_broadcast", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS d, 1 AS one FROM orders", "orders")(lambda o: o.select("o_orderkey", (col("o_totalprice") - col("o_totalprice").mean()).round(4).alias("d"), lit(1).alias("one")))
q("frame_filter_constraints", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0", "customer")(lambda c: c.filter(col("c_acctbal") > 0, c_mktsegment="BUILDING"))
q("frame_filter_window", "SELECT o_orderkey FROM orders QUALIFY o_totalprice > avg(o_totalprice) OVER (PARTITION BY o_custkey)", "orders")(lambda o: o.filter(col("o_totalprice") > col("o_totalprice").mean().over("o_custkey")).select("o_orderkey"))
q("frame_rename", "SELECT r_regionkey AS k, r_name FROM region", "region")(lambda f: f.rename({"r_regionkey": "k"}))
q("frame_drop", "SELECT r_name FROM region", "region")(lambda f: f.drop("r_regionkey", "nope", strict=False))
q("frame_head", "SELECT count(*) AS n FROM (SELECT * FROM nation LIMIT 7)", "nation")(lambda f: f.head(7).select(lf.len_().alias("n")))
q("frame_sort", "SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_nationkey", "nation")(lambda f: f.select("n_nationkey", "n_regionkey").sort("n_regionkey", "n_nationkey", descending=[True, False]))
q("frame_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25", "orders")(lambda o: o.top_k(25, by=["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice"))
q("frame_top_k_reverse", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25", "orders")(lambda o: o.top_k(25, by=["o_totalprice", "o_orderkey"], reverse=True).select("o_orderkey", "o_totalprice"))
q("frame_drop_nulls", "SELECT e, v FROM (SELECT nullif(event_type, 'view') AS e, value AS v FROM events) WHERE e IS NOT NULL", "events")(lambda f: f.select(lf.when(col("event_type") != "view").then(col("event_type")).alias("e"), col("value").alias("v")).drop_nulls("e"))
q("frame_unique_any", "SELECT DISTINCT user_id, event_type FROM events", "events")(lambda f: f.select("user_id", "event_type").unique())
q("frame_unique_first", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1", "events")(lambda f: f.unique("user_id", keep="first", order_by=["ts", "event_id"]).select("event_id", "user_id"))
q("frame_unique_last", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", "events")(lambda f: f.unique("user_id", keep="last", order_by=["ts", "event_id"]).select("event_id", "user_id"))
q("frame_unique_none", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1", "lineitem")(lambda f: f.unique("l_orderkey", keep="none").select("l_orderkey"))
q("frame_with_row_index", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index, o_orderkey FROM orders", "orders")(lambda o: o.with_row_index(order_by=["o_totalprice", "o_orderkey"]).select("index", "o_orderkey"))
q("frame_unpivot", "SELECT o_orderkey, variable, value FROM (SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders) UNPIVOT (value FOR variable IN (price, cust))", "orders")(lambda o: o.select("o_orderkey", price="o_totalprice", cust=col("o_custkey").cast(dt.Float64)).unpivot(["price", "cust"], index="o_orderkey"))
q("frame_explode", "SELECT vec_id, unnest(embedding[1:3]) AS e FROM embeddings", "embeddings")(lambda f: f.select("vec_id", lf.list_(*[col("embedding").list.get(i) for i in range(3)]).alias("e")).explode("e"))
q("frame_explode_multi", "SELECT vec_id, unnest(embedding[1:2]) AS a, unnest(embedding[3:4]) AS b FROM embeddings", "embeddings")(lambda f: f.select("vec_id", lf.list_(col("embedding").list.get(0), col("embedding").list.get(1)).alias("a"), lf.list_(col("embedding").list.get(2), col("embedding").list.get(3)).alias("b")).explode("a", "b"))
q("frame_explode_empty", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN w END AS w FROM (SELECT doc_id, unnest(['x', 'y']) AS w FROM documents) WHERE doc_id % 2 = 0 OR w = 'x'", "documents")(lambda f: f.select("doc_id", lf.when(col("doc_id") % 2 == 0).then(lf.list_(lit("x"), lit("y"))).alias("w")).explode("w"))
q("frame_pipe", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'", "orders")(lambda o: o.pipe(lambda f, s: f.filter(o_orderstatus=s), "F").select(lf.len_().alias("n")))
q("concat_vertical", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", "nation", "region")(lambda n, g: lf.concat([n.select(k="n_nationkey"), g.select(k="r_regionkey")]))
q("concat_diagonal", "SELECT n_nationkey AS k, n_name AS n, NULL::VARCHAR AS r FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region", "nation", "region")(lambda n, g: lf.concat([n.select(k="n_nationkey", n="n_name"), g.select(k="r_regionkey", r="r_name")], how="diagonal"))

# --- joins ----------------------------------------------------------------------------------------------------------
_null_key = "CASE WHEN {k} % 5 <> 0 THEN {k} END"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("full", "FULL JOIN")):
    q(f"join_{_how}_null_keys", f"WITH c AS (SELECT {_null_key.format(k='c_custkey')} AS k, c_name FROM customer), o AS (SELECT {_null_key.format(k='o_custkey')} AS k, o_orderkey FROM orders WHERE o_orderkey % 7 = 0) SELECT c.k AS k, c_name, o_orderkey" + (", o.k AS k_right" if _how == "full" else "") + f" FROM c {_sql} o ON c.k = o.k", "customer", "orders")(
        lambda c, o, how=_how: c.select(lf.when(col("c_custkey") % 5 != 0).then(col("c_custkey")).alias("k"), "c_name").join(o.filter(col("o_orderkey") % 7 == 0).select(lf.when(col("o_custkey") % 5 != 0).then(col("o_custkey")).alias("k"), "o_orderkey"), on="k", how=how)
    )
q("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "customer", "orders")(lambda c, o: c.join(o.filter(col("o_totalprice") > 200000), left_on="c_custkey", right_on="o_custkey", how="semi").select("c_custkey"))
q("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "customer", "orders")(lambda c, o: c.join(o.filter(col("o_totalprice") > 200000), left_on="c_custkey", right_on="o_custkey", how="anti").select("c_custkey"))
q("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", "nation", "region")(lambda n, g: n.join(g, how="cross").select("n_name", "r_name"))
q("join_suffix", "SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_other FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey", "nation")(lambda n: n.join(n.select("n_nationkey", "n_name"), left_on="n_regionkey", right_on="n_nationkey", suffix="_other").select("n_nationkey", "n_name", "n_name_other"))
_pair = ("WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) ", lambda e: (e.filter(event_type="purchase").select("event_id", "user_id", "ts"), e.filter(event_type="view").group_by("user_id", "ts").agg(col("value").max())))
q("join_asof_backward", _pair[0] + "SELECT l.event_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts", "events")(lambda e: _pair[1](e)[0].join_asof(_pair[1](e)[1], on="ts", by="user_id").select("event_id", "value"))
q("join_asof_forward", _pair[0] + "SELECT l.event_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts", "events")(lambda e: _pair[1](e)[0].join_asof(_pair[1](e)[1], on="ts", by="user_id", strategy="forward").select("event_id", "value"))
q("join_asof_nearest", _pair[0] + "SELECT event_id, value FROM (SELECT l.event_id, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) AS k FROM l LEFT JOIN r ON l.user_id = r.user_id) WHERE k = 1", "events")(lambda e: _pair[1](e)[0].join_asof(_pair[1](e)[1], on="ts", by="user_id", strategy="nearest").select("event_id", "value"))

# --- groups and aggregates ------------------------------------------------------------------------------------------
q("group_keys_only", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")(lambda o: o.group_by("o_orderstatus", "o_orderpriority").agg())
q("group_expr_key", "SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY 1", "orders")(lambda o: o.group_by((col("o_custkey") % 10).alias("k")).agg(lf.len_().alias("n")))
q("group_drop_null_keys", "SELECT k, count(*) AS n FROM (SELECT nullif(event_type, 'view') AS k FROM events) WHERE k IS NOT NULL GROUP BY 1", "events")(lambda e: e.select(lf.when(col("event_type") != "view").then(col("event_type")).alias("k")).group_by("k", drop_null_keys=True).agg(lf.len_().alias("n")))
q("group_null_keys", "SELECT nullif(event_type, 'view') AS k, count(*) AS n FROM events GROUP BY 1", "events")(lambda e: e.select(lf.when(col("event_type") != "view").then(col("event_type")).alias("k")).group_by("k").agg(lf.len_().alias("n")))
q("group_all_sum", "SELECT l_returnflag, round(sum(l_quantity), 4) AS l_quantity, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY 1", "lineitem")(lambda f: f.select("l_returnflag", "l_quantity", "l_tax").group_by("l_returnflag").agg(lf.all_().sum().round(4)))
q("group_ratio", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS x FROM orders GROUP BY 1", "orders")(lambda o: o.group_by("o_orderstatus").agg((col("o_totalprice").sum() / lf.len_()).round(4).alias("x")))
_g = "SELECT event_type, {} FROM events GROUP BY 1"
_v = "nullif(CAST(user_id % 7 AS BIGINT), 3)"


def _group(name: str, expr: Callable[[Any], Any], sql: str) -> None:
    q(f"agg_{name}", _g.format(f"{sql.replace('$v', _v)} AS x"), "events")(lambda e: e.with_columns(v=lf.when(col("user_id") % 7 != 3).then(col("user_id") % 7)).group_by("event_type").agg(expr(col("v")).alias("x")))


_group("sum", lambda v: v.sum(), "CAST(coalesce(sum($v), 0) AS BIGINT)")
_group("mean", lambda v: r(v.mean()), "round(avg($v), 6)")
_group("median", lambda v: v.median(), "median($v)")
_group("min", lambda v: v.min(), "min($v)")
_group("max", lambda v: v.max(), "max($v)")
_group("count", lambda v: v.count(), "count($v)")
_group("len", lambda v: v.len(), "count(*)")
_group("n_unique", lambda v: v.n_unique(), "count(DISTINCT $v) + max(CASE WHEN $v IS NULL THEN 1 ELSE 0 END)")
_group("null_count", lambda v: v.null_count(), "count(*) - count($v)")
_group("std", lambda v: r(v.std()), "round(stddev_samp($v), 6)")
_group("var_ddof0", lambda v: r(v.var(ddof=0)), "round(var_pop($v), 6)")
_group("var_ddof2", lambda v: r(v.var(ddof=2)), "round(var_pop($v) * count($v) / (count($v) - 2), 6)")
_group("skew", lambda v: r(v.skew()), "round((avg($v ^ 3) - 3 * avg($v) * avg($v ^ 2) + 2 * avg($v) ^ 3) / var_pop($v) ^ 1.5, 6)")
_group("kurtosis", lambda v: r(v.kurtosis()), "round(kurtosis_pop($v), 6)")
_group("quantile_linear", lambda v: r(v.quantile(0.3)), "round(quantile_cont($v, 0.3), 6)")
for _i, _f in (("lower", "floor"), ("higher", "ceil")):
    _group(f"quantile_{_i}", lambda v, i=_i: v.quantile(0.3, i), f"CAST(list_sort(list($v) FILTER ($v IS NOT NULL))[CAST({_f}((count($v) - 1) * 0.3) AS BIGINT) + 1] AS DOUBLE)")
_group("quantile_nearest", lambda v: v.quantile(0.3, "nearest"), "CAST(list_sort(list($v) FILTER ($v IS NOT NULL))[CAST(round_even((count($v) - 1) * 0.3, 0) AS BIGINT) + 1] AS DOUBLE)")
_group("quantile_midpoint", lambda v: v.quantile(0.3, "midpoint"), "(list_sort(list($v) FILTER ($v IS NOT NULL))[CAST(floor((count($v) - 1) * 0.3) AS BIGINT) + 1] + list_sort(list($v) FILTER ($v IS NOT NULL))[CAST(ceil((count($v) - 1) * 0.3) AS BIGINT) + 1]) / 2.0")
_group("any", lambda v: (v > 5).any(), "coalesce(bool_or($v > 5), false)")
_group("all", lambda v: (v >= 0).all(), "coalesce(bool_and($v >= 0), true)")
_group("first", lambda v: v.first(order_by=["ts", "event_id"]), f"min_by(struct_pack(v := {_v}), struct_pack(a := ts, b := event_id)).v")
_group("last", lambda v: v.last(order_by=["ts", "event_id"]), f"max_by(struct_pack(v := {_v}), struct_pack(a := ts, b := event_id)).v")
_group("any_value", lambda v: (v * 0).any_value(ignore_nulls=True), "CAST(0 AS BIGINT)")
_group("mode", lambda v: v.mode(keep="any"), f"(list_sort(map_keys(map_from_entries(list_filter(map_entries(histogram({_v})), lambda e: e.value = list_max(map_values(histogram({_v}))))))))[1]")
_group("filter_sum", lambda v: v.filter(col("value") > 10, v > 1).sum(), "CAST(coalesce(sum($v) FILTER (value > 10 AND $v > 1), 0) AS BIGINT)")
_group("drop_nulls_len", lambda v: v.drop_nulls().len(), "count($v)")
_group("unique_sum", lambda v: v.unique().sum(), "CAST(coalesce(sum(DISTINCT $v), 0) AS BIGINT)")
_group("corr", lambda v: r(lf.corr("value", v)), "round(corr(value, $v), 6)")
_group("cov", lambda v: r(lf.cov("value", v)), "round(covar_samp(value, $v), 6)")
_group("cov_ddof0", lambda v: r(lf.cov("value", v, ddof=0)), "round(covar_pop(value, $v), 6)")
_group("get_categories", lambda v: v.cat.get_categories(), "list_sort(list(DISTINCT $v) FILTER ($v IS NOT NULL))")
q("corr_spearman", """WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS x FROM k""", "lineitem")(lambda f: f.select(r(lf.corr("l_quantity", "l_extendedprice", method="spearman")).alias("x")))
q("agg_top_level", "SELECT round(sum(o_totalprice), 3) AS s, round(avg(o_totalprice), 6) AS m, median(o_totalprice) AS md, min(o_totalprice) AS mn, max(o_totalprice) AS mx, count(*) AS len FROM orders", "orders")(lambda o: o.select(lf.sum("o_totalprice").round(3).alias("s"), r(lf.mean("o_totalprice")).alias("m"), lf.median("o_totalprice").alias("md"), lf.min("o_totalprice").alias("mn"), lf.max("o_totalprice").alias("mx"), lf.len_()))

for _a, _s in {"std": "stddev_samp", "var": "var_samp", "median": "median", "min": "min", "max": "max", "sum": "sum", "mean": "avg"}.items():
    q(f"agg_unique_{_a}", f"SELECT user_id, round(CAST({_s}(DISTINCT event_id % 7) AS DOUBLE), 6) AS x FROM events GROUP BY 1", "events")(lambda e, a=_a: e.group_by("user_id").agg(r(getattr((col("event_id") % 7).unique(), a)().cast(dt.Float64)).alias("x")))
q("agg_unique_skew", "SELECT user_id, round(sum((v - m) ** 3) / count(*) / (sum((v - m) ** 2) / count(*)) ** 1.5, 6) AS x, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, avg(v) OVER (PARTITION BY user_id) AS m FROM (SELECT DISTINCT user_id, event_id % 50 AS v FROM events)) GROUP BY 1", "events")(lambda e: e.group_by("user_id").agg(r((col("event_id") % 50).unique().skew()).alias("x"), (col("event_id") % 50).unique().count().alias("n")))
q("agg_unique_quantile", "SELECT user_id, quantile_cont(v, 0.3) AS x FROM (SELECT DISTINCT user_id, (event_id % 11)::DOUBLE AS v FROM events) GROUP BY 1", "events")(lambda e: e.group_by("user_id").agg((col("event_id") % 11).unique().quantile(0.3).alias("x")))
q("agg_mode_all", """WITH c AS (SELECT user_id, event_id % 5 AS v, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY user_id))
 SELECT user_id, CAST(sum(v) AS BIGINT) AS s, count(*) AS n, max(v) AS hi FROM m GROUP BY 1""", "events")(lambda e: e.group_by("user_id").agg((col("event_id") % 5).mode(keep="all").sum().alias("s"), (col("event_id") % 5).mode(keep="all").len().alias("n"), (col("event_id") % 5).mode(keep="all").max().alias("hi")))
q("agg_mode_all_whole", "WITH c AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM c WHERE n = (SELECT max(n) FROM c)", "orders")(lambda o: o.select(col("o_custkey").mode(keep="all").sum().alias("s"), col("o_custkey").mode(keep="all").len().alias("n")))

# --- windows --------------------------------------------------------------------------------------------------------
_part, _ord = "PARTITION BY user_id", "ORDER BY ts, event_id"
_w = f"OVER ({_part} {_ord} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_x = "nullif(CAST(event_id % 9 AS BIGINT), 4)"


def _window(name: str, expr: Callable[[Any], Any], sql: str, order: bool = True) -> None:
    over = {"order_by": ["ts", "event_id"]} if order else {}
    q(f"win_{name}", f"WITH e AS (SELECT event_id, user_id, ts, {_x} AS x FROM events) SELECT event_id, {sql.replace('$w', _w)} AS y FROM e", "events")(
        lambda e: e.with_columns(x=lf.when(col("event_id") % 9 != 4).then(col("event_id") % 9)).select("event_id", expr(col("x"), lambda z: z.over("user_id", **over)).alias("y"))
    )


_window("over_sum", lambda x, o: o(x.sum()), "CAST(coalesce(sum(x) OVER (PARTITION BY user_id), 0) AS BIGINT)", order=False)
_window("over_pushdown", lambda x, o: o(x.sum() + x.max() * 2), "CAST(coalesce(sum(x) OVER (PARTITION BY user_id), 0) + 2 * max(x) OVER (PARTITION BY user_id) AS BIGINT)", order=False)
_window("n_unique", lambda x, o: o(x.n_unique()), "(SELECT count(DISTINCT b.x) + max(CASE WHEN b.x IS NULL THEN 1 ELSE 0 END) FROM e b WHERE b.user_id = e.user_id)", order=False)
for _m, _s in {"average": "rank() OVER (PARTITION BY user_id ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2.0", "min": "rank() OVER (PARTITION BY user_id ORDER BY x NULLS LAST)", "max": "rank() OVER (PARTITION BY user_id ORDER BY x NULLS LAST) + count(*) OVER (PARTITION BY user_id, x) - 1", "dense": "dense_rank() OVER (PARTITION BY user_id ORDER BY x NULLS LAST)", "ordinal": "row_number() OVER (PARTITION BY user_id ORDER BY x NULLS LAST, ts, event_id)"}.items():
    _window(f"rank_{_m}", lambda x, o, m=_m: o(x.rank(m)), f"CASE WHEN x IS NOT NULL THEN {_s} END")
_window("rank_descending", lambda x, o: o(x.rank("min", descending=True)), "CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY user_id ORDER BY x DESC NULLS LAST) END", order=False)
_window("cum_sum", lambda x, o: o(x.cum_sum()), "CAST(CASE WHEN x IS NOT NULL THEN sum(x) $w END AS BIGINT)")
_window("cum_sum_reverse", lambda x, o: o(x.cum_sum(reverse=True)), f"CAST(CASE WHEN x IS NOT NULL THEN sum(x) OVER ({_part} {_ord} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS BIGINT)")
_window("cum_count", lambda x, o: o(x.cum_count()), "count(x) $w")
_window("cum_min", lambda x, o: o(x.cum_min()), "CASE WHEN x IS NOT NULL THEN min(x) $w END")
_window("cum_max", lambda x, o: o(x.cum_max()), "CASE WHEN x IS NOT NULL THEN max(x) $w END")
_window("cum_prod", lambda x, o: r(o((x % 2 + 1).cum_prod()).log()), "CASE WHEN x IS NOT NULL THEN round(ln(product(x % 2 + 1) $w), 6) END")
_window("shift", lambda x, o: o(x.shift(2)), f"lag(x, 2) OVER ({_part} {_ord})")
_window("shift_lead", lambda x, o: o(x.shift(-1)), f"lead(x) OVER ({_part} {_ord})")
_window("diff", lambda x, o: o(x.diff()), f"x - lag(x) OVER ({_part} {_ord})")
for _m, _s in {"sum": "CAST(sum(x) OVER f AS BIGINT)", "mean": "round(avg(x) OVER f, 6)", "var": "round(var_samp(x) OVER f, 6)", "std": "round(stddev_samp(x) OVER f, 6)"}.items():
    for _c, _f in ((False, "3 PRECEDING AND CURRENT ROW"), (True, "2 PRECEDING AND 1 FOLLOWING")):
        _fr = f"({_part} {_ord} ROWS BETWEEN {_f})"
        _window(f"rolling_{_m}" + "_center" * _c, lambda x, o, m=_m, c=_c: r(o(getattr(x, f"rolling_{m}")(4, min_samples=2, center=c))) if m != "sum" else o(x.rolling_sum(4, min_samples=2, center=c)), f"CASE WHEN count(x) OVER {_fr} >= 2 THEN {_s.replace('OVER f', f'OVER {_fr}')} END")
_window("fill_forward", lambda x, o: o(x.fill_null(strategy="forward")), "last_value(x IGNORE NULLS) $w")
_window("fill_backward_limit", lambda x, o: o(x.fill_null(strategy="backward", limit=1)), f"first_value(x IGNORE NULLS) OVER ({_part} {_ord} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)")
_window("is_unique", lambda x, o: o(x.is_unique()), "count(*) OVER (PARTITION BY user_id, x) = 1", order=False)
_window("is_duplicated", lambda x, o: o(x.is_duplicated()), "count(*) OVER (PARTITION BY user_id, x) > 1", order=False)
_window("is_first_distinct", lambda x, o: o(x.is_first_distinct()), "row_number() OVER (PARTITION BY user_id, x ORDER BY ts, event_id) = 1")
_window("is_last_distinct", lambda x, o: o(x.is_last_distinct()), "row_number() OVER (PARTITION BY user_id, x ORDER BY ts DESC, event_id DESC) = 1")
_window("first", lambda x, o: o(x.first(order_by=["ts", "event_id"])), f"first_value(x) OVER ({_part} {_ord})", order=False)
_window("last", lambda x, o: o(x.last()), f"last_value(x) OVER ({_part} {_ord} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_window("ewm_mean", lambda x, o: r(o(x.ewm_mean(alpha=0.5))), "CASE WHEN x IS NOT NULL THEN (SELECT round(sum(b.x * 0.5 ^ (n - m)) / sum(CASE WHEN b.x IS NOT NULL THEN 0.5 ^ (n - m) END), 6) FROM (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m, event_id FROM e) b, (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e) c WHERE c.event_id = e.event_id AND b.user_id = e.user_id AND m <= n) END")
for _a, _s in {"sum": "CAST((SELECT sum(DISTINCT b.x) FROM e b WHERE b.user_id = e.user_id) AS BIGINT)", "mean": "(SELECT round(avg(DISTINCT b.x), 6) FROM e b WHERE b.user_id = e.user_id)", "count": "(SELECT count(DISTINCT b.x) FROM e b WHERE b.user_id = e.user_id)", "std": "(SELECT round(stddev_samp(DISTINCT b.x), 6) FROM e b WHERE b.user_id = e.user_id)"}.items():
    _window(f"unique_{_a}", lambda x, o, a=_a: (lambda y: r(y) if a in ("mean", "std") else y)(o(getattr(x.unique(), a)())), _s, order=False)
_window("mode_all", lambda x, o: o(x.mode(keep="all").sum()), "CAST((SELECT sum(v) FROM (SELECT b.x AS v, count(*) AS n, max(count(*)) OVER () AS m FROM e b WHERE b.user_id = e.user_id AND b.x IS NOT NULL GROUP BY b.x) WHERE n = m) AS BIGINT)", order=False)
q("win_ewm_mean_long", """WITH RECURSIVE e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS n FROM events),
 w AS (SELECT n, event_id, value AS num, 1.0::DOUBLE AS den FROM e WHERE n = 1 UNION ALL SELECT e.n, e.event_id, w.num * 0.9995 + e.value, w.den * 0.9995 + 1 FROM w JOIN e ON e.n = w.n + 1)
 SELECT event_id, round(num / den, 6) AS y FROM w""", "events")(lambda e: e.with_columns(one=lit(1)).select("event_id", r(col("value").ewm_mean(alpha=0.0005).over("one", order_by="event_id")).alias("y")))
for _m, _s in {"average": "rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0", "min": "rank() OVER (ORDER BY l_quantity)", "max": "rank() OVER (ORDER BY l_quantity) + count(*) OVER (PARTITION BY l_quantity) - 1", "dense": "dense_rank() OVER (ORDER BY l_quantity)"}.items():
    q(f"rank_all_{_m}", f"SELECT l_orderkey, l_linenumber, l_partkey, {_s} AS y FROM lineitem", "lineitem")(lambda f, m=_m: f.collect().select("l_orderkey", "l_linenumber", "l_partkey", col("l_quantity").rank(m).alias("y")).lazy())
q("win_of_window", "SELECT CAST(max(s) AS BIGINT) AS m FROM (SELECT sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM events)", "events")(lambda e: e.select(col("event_id").cum_sum().over("user_id", order_by=["ts", "event_id"]).max().alias("m")))

# --- row-wise expressions -------------------------------------------------------------------------------------------
_nul = lf.when(col("event_id") % 4 != 0).then(col("event_id"))
_nsql = "CASE WHEN event_id % 4 <> 0 THEN event_id END"


def _row(name: str, exprs: Callable[[], list[Any]], sql: str, table: str = "events", key: str = "event_id") -> None:
    q(name, f"SELECT {key}, {sql} FROM {table}", table)(lambda f: f.select(key, *exprs()))


_row("op_arithmetic", lambda: [(col("event_id") + 2).alias("a"), (col("event_id") - col("user_id")).alias("b"), (3 * col("user_id")).alias("c"), (-col("user_id")).alias("d"), (10 - col("user_id")).alias("e")], "event_id + 2 AS a, event_id - user_id AS b, 3 * user_id AS c, -user_id AS d, 10 - user_id AS e")
_row("op_true_division", lambda: [r(col("event_id") / (col("user_id") % 3)).fill_nan(-1.0).clip(-1e300, 1e300).alias("a"), (1 / (col("event_id") + 1)).round(6).alias("b")], "CASE WHEN user_id % 3 <> 0 THEN round(event_id / (user_id % 3)::DOUBLE, 6) WHEN event_id = 0 THEN -1.0 ELSE 1e300 END AS a, round(1.0 / (event_id + 1), 6) AS b")
_row("op_floor_division", lambda: [((col("event_id") - 5000) // 7).alias("a"), (col("event_id") // (col("user_id") % 3)).alias("b"), (col("value") // 2.5).alias("c")], "CAST(floor((event_id - 5000) / 7.0) AS BIGINT) AS a, CASE WHEN user_id % 3 <> 0 THEN CAST(floor(event_id / (user_id % 3)::DOUBLE) AS BIGINT) END AS b, floor(value / 2.5) AS c")
_row("op_modulo", lambda: [((col("event_id") - 5000) % 7).alias("a"), ((5000 - col("event_id")) % -7).alias("b")], "((event_id - 5000) % 7 + 7) % 7 AS a, ((5000 - event_id) % -7 - 7) % -7 AS b")
_row("op_power", lambda: [((col("event_id") % 10) ** 2).alias("a"), r(col("value") ** 0.5).alias("b"), (2 ** (col("event_id") % 10)).alias("c")], "CAST((event_id % 10) ** 2 AS BIGINT) AS a, round(value ** 0.5, 6) AS b, CAST(2 ** (event_id % 10) AS BIGINT) AS c")
_row("op_compare", lambda: [(col("event_id") == col("user_id")).alias("eq"), (col("event_id") != 5).alias("ne"), (col("value") < 50).alias("lt"), (col("value") <= 50).alias("le"), (col("value") > 50).alias("gt"), (col("value") >= 50).alias("ge")], "event_id = user_id AS eq, event_id <> 5 AS ne, value < 50 AS lt, value <= 50 AS le, value > 50 AS gt, value >= 50 AS ge")
_row("op_boolean", lambda: [((_nul > 5) & (col("value") > 50)).alias("a"), ((_nul > 5) | (col("value") > 50)).alias("o"), (~(_nul > 5)).alias("n")], f"({_nsql} > 5) AND value > 50 AS a, ({_nsql} > 5) OR value > 50 AS o, NOT ({_nsql} > 5) AS n")
_row("pred_is_between", lambda: [col("event_id").is_between(10, 20, c).alias(c) for c in ("both", "left", "right", "none")], 'event_id BETWEEN 10 AND 20 AS both, event_id >= 10 AND event_id < 20 AS "left", event_id > 10 AND event_id <= 20 AS "right", event_id > 10 AND event_id < 20 AS none')
_row("pred_is_in", lambda: [col("event_type").is_in(["view", "click"]).alias("a"), col("event_type").is_in([]).alias("b")], "event_type IN ('view', 'click') AS a, false AS b")
_row("pred_nulls", lambda: [_nul.is_null().alias("a"), _nul.fill_null(-1).alias("b"), (_nul / 0).is_nan().alias("c"), (_nul / 0).is_finite().alias("d")], f"{_nsql} IS NULL AS a, coalesce({_nsql}, -1) AS b, CASE WHEN {_nsql} IS NOT NULL THEN event_id = 0 END AS c, CASE WHEN {_nsql} IS NOT NULL THEN false END AS d")
_row("pred_is_close", lambda: [col("value").is_close(col("value") * (1 + 1e-12)).alias("a"), col("value").is_close(50.0, abs_tol=1.0).alias("b")], "true AS a, abs(value - 50) <= 1.0 AS b")
_row("clip", lambda: [_nul.clip(10, 20).alias("a"), _nul.clip(10).alias("b"), _nul.clip(None, 20).alias("c")], f"CASE WHEN {_nsql} IS NOT NULL THEN greatest(least(event_id, 20), 10) END AS a, CASE WHEN {_nsql} IS NOT NULL THEN greatest(event_id, 10) END AS b, CASE WHEN {_nsql} IS NOT NULL THEN least(event_id, 20) END AS c")
_row("cast", lambda: [col("event_id").cast(dt.Float64).alias("a"), col("event_id").cast(dt.String).alias("b"), (col("event_id") % 100).cast(dt.Int8).alias("c"), (col("event_id") % 2).cast(dt.Boolean).alias("d"), col("ts").cast(dt.Date).alias("e")], "CAST(event_id AS DOUBLE) AS a, CAST(event_id AS VARCHAR) AS b, CAST(event_id % 100 AS TINYINT) AS c, event_id % 2 <> 0 AS d, CAST(ts AS DATE) AS e")
_row("replace_strict", lambda: [col("event_type").replace_strict({"view": 1, "click": 2}, default=0).alias("a")], "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS a")
_row("when_chain", lambda: [lf.when(col("value") > 80, col("event_id") % 2 == 0).then(lit("hi")).when(col("value") > 40).then(lit("mid")).otherwise(lit("lo")).alias("a"), lf.when(col("value") > 80).then(col("value")).alias("b")], "CASE WHEN value > 80 AND event_id % 2 = 0 THEN 'hi' WHEN value > 40 THEN 'mid' ELSE 'lo' END AS a, CASE WHEN value > 80 THEN value END AS b")
_row("math", lambda: [r(col("value").exp().clip(None, 1e6)).alias("a"), r((col("value") + 1).log()).alias("b"), r((col("value") + 1).log(2)).alias("c"), r(col("value").sqrt()).alias("d"), r(col("value").sin()).alias("e"), r(col("value").cos()).alias("f"), (col("value") - 50).abs().alias("g"), col("value").floor().alias("h"), col("value").ceil().alias("i"), col("value").round(1).alias("j")], "round(least(exp(value), 1e6), 6) AS a, round(ln(value + 1), 6) AS b, round(ln(value + 1) / ln(2), 6) AS c, round(sqrt(value), 6) AS d, round(sin(value), 6) AS e, round(cos(value), 6) AS f, abs(value - 50) AS g, floor(value) AS h, ceil(value) AS i, round(value, 1) AS j")
_row("math_edges", lambda: [(col("event_id") * 0).log().is_finite().alias("a"), (col("event_id") * 0 - 1).log().is_nan().alias("b"), (col("event_id") * 0 - 1).sqrt().is_nan().alias("c")], "false AS a, true AS b, true AS c")
_row("horizontal", lambda: [lf.sum_horizontal(_nul, "user_id").alias("s"), r(lf.mean_horizontal(_nul, "user_id")).alias("m"), lf.min_horizontal(_nul, "user_id").alias("mn"), lf.max_horizontal(_nul, "user_id").alias("mx")], f"coalesce({_nsql}, 0) + user_id AS s, round((coalesce({_nsql}, 0) + user_id) / (1 + ({_nsql} IS NOT NULL)::INT)::DOUBLE, 6) AS m, least({_nsql}, user_id) AS mn, greatest({_nsql}, user_id) AS mx")
_row("horizontal_bool", lambda: [lf.all_horizontal(_nul > 5, col("value") > 50).alias("a"), lf.any_horizontal(_nul > 5, col("value") > 50).alias("b"), lf.all_horizontal(_nul > 5, col("value") > 50, ignore_nulls=True).alias("c"), lf.any_horizontal(_nul > 5, col("value") > 50, ignore_nulls=True).alias("d")], f"({_nsql} > 5) AND value > 50 AS a, ({_nsql} > 5) OR value > 50 AS b, coalesce({_nsql} > 5, true) AND value > 50 AS c, coalesce({_nsql} > 5, false) OR value > 50 AS d")
_row("concat_str", lambda: [lf.concat_str("event_type", "user_id", separator="-").alias("a"), lf.concat_str(_nul, "event_type").alias("b"), lf.concat_str([_nul, col("event_type")], separator="|", ignore_nulls=True).alias("c"), lf.format("<{}:{}>", "event_type", "user_id").alias("d")], f"event_type || '-' || user_id AS a, CAST({_nsql} AS VARCHAR) || event_type AS b, concat_ws('|', {_nsql}, event_type) AS c, '<' || event_type || ':' || user_id || '>' AS d")
_row("coalesce", lambda: [lf.coalesce(_nul, "user_id").alias("a"), lf.coalesce(_nul, lit(-7)).alias("b")], f"coalesce({_nsql}, user_id) AS a, coalesce({_nsql}, -7) AS b")
_row("struct_field", lambda: [lf.struct("user_id", v=col("value") * 2).struct.field("v").alias("a")], "value * 2 AS a")
_row("list_pack", lambda: [lf.list_("event_id", "user_id").list.get(1).alias("a"), lf.list_("event_id", "user_id").list.len().cast(dt.Int64).alias("b")], "user_id AS a, CAST(2 AS BIGINT) AS b")
_row("literals", lambda: [lit(1).alias("a"), lit("x").alias("b"), lit(2.5).alias("c"), lit([1, 2]).list.sum().alias("d"), lit(None, dt.Int64).alias("e")], "1 AS a, 'x' AS b, 2.5::DOUBLE AS c, CAST(3 AS BIGINT) AS d, CAST(NULL AS BIGINT) AS e")
_row("names", lambda: [col("user_id", "value").name.prefix("p_"), col("value").name.suffix("_s"), col("event_type").alias("zz").name.keep(), col("user_id").name.map(lambda n: n[::-1])], "user_id AS p_user_id, value AS p_value, value AS value_s, event_type, user_id AS di_resu")
q("names_case", 'SELECT event_id AS "EVENT_ID" FROM events', "events")(lambda e: e.select(col("event_id").name.to_uppercase()))
_row("map_batches", lambda: [col("value").map_batches(lambda s: s * 2 + 1, dt.Float64).alias("a")], "value * 2 + 1 AS a")
q("roots", "SELECT r_regionkey, r_name FROM region", "region")(lambda g: g.select(lf.nth(0), lf.exclude("r_regionkey")))
q("selectors", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer", "customer")(lambda c: c.select(cs.numeric()))
q("selectors_algebra", "SELECT c_name, c_mktsegment, c_acctbal FROM customer", "customer")(lambda c: c.select((cs.string() | cs.by_dtype(dt.Float64)) - cs.matches("^x")))
q("selectors_complement", "SELECT event_id, user_id, value FROM events", "events")(lambda e: e.select(~(cs.string() | cs.datetime() | cs.boolean() | cs.categorical() | cs.enum())))

# --- strings --------------------------------------------------------------------------------------------------------
_row("str_basic", lambda: [col("event_type").str.len_chars().alias("a"), col("event_type").str.to_uppercase().alias("b"), col("event_type").str.to_lowercase().alias("c"), col("event_type").str.starts_with("v").alias("d"), col("event_type").str.ends_with("w").alias("e"), col("event_type").str.contains("^[ve]").alias("f"), col("event_type").str.contains("r.", literal=True).alias("g")], "length(event_type) AS a, upper(event_type) AS b, lower(event_type) AS c, starts_with(event_type, 'v') AS d, ends_with(event_type, 'w') AS e, regexp_matches(event_type, '^[ve]') AS f, contains(event_type, 'r.') AS g")
_row("str_slices", lambda: [col("event_type").str.slice(1, 2).alias("a"), col("event_type").str.slice(-3).alias("b"), col("event_type").str.head(3).alias("c"), col("event_type").str.tail(4).alias("d")], "substr(event_type, 2, 2) AS a, right(event_type, 3) AS b, left(event_type, 3) AS c, right(event_type, 4) AS d")
_row("str_replace", lambda: [col("event_type").str.replace("[aeiou]", "$").alias("a"), col("event_type").str.replace_all("[aeiou]", "_").alias("b"), col("event_type").str.replace("r", "R", literal=True, n=2).alias("c"), col("event_type").str.replace_all("r", "..", literal=True).alias("d")], "regexp_replace(event_type, '[aeiou]', '$') AS a, regexp_replace(event_type, '[aeiou]', '_', 'g') AS b, regexp_replace(regexp_replace(event_type, 'r', 'R'), 'r', 'R') AS c, replace(event_type, 'r', '..') AS d")
_row("str_pad", lambda: [col("user_id").cast(dt.String).str.zfill(6).alias("a"), (-col("user_id")).cast(dt.String).str.zfill(6).alias("b"), col("event_type").str.pad_start(7, "*").alias("c"), col("event_type").str.pad_end(7).alias("d")], "lpad(CAST(user_id AS VARCHAR), 6, '0') AS a, CASE WHEN user_id > 0 THEN '-' || lpad(CAST(user_id AS VARCHAR), 5, '0') ELSE '000000' END AS b, lpad(event_type, CAST(greatest(7, length(event_type)) AS INTEGER), '*') AS c, rpad(event_type, CAST(greatest(7, length(event_type)) AS INTEGER), ' ') AS d")
_row("str_strip_split", lambda: [lf.format("  {} ", "event_type").str.strip_chars().alias("a"), col("event_type").str.strip_chars("vw").alias("b"), lf.format("{}.{}", "event_type", "user_id").str.split(".").list.get(1).alias("c")], "event_type AS a, trim(event_type, 'vw') AS b, CAST(user_id AS VARCHAR) AS c")
_row("str_titlecase", lambda: [lf.format("{} {}-x", "event_type", "event_type").str.to_titlecase().alias("a")], "upper(event_type[1]) || event_type[2:] || ' ' || upper(event_type[1]) || event_type[2:] || '-X' AS a")
_row("str_parse", lambda: [col("ts").dt.to_string("%Y-%m-%d %H:%M:%S").str.to_datetime("%Y-%m-%d %H:%M:%S").alias("a"), col("ts").dt.to_string("%d/%m/%Y").str.to_date("%d/%m/%Y").alias("b")], "date_trunc('second', ts) AS a, CAST(ts AS DATE) AS b")

# --- dates ----------------------------------------------------------------------------------------------------------
_row("dt_parts", lambda: [getattr(col("ts").dt, p)().cast(dt.Int64).alias(p) for p in ("year", "month", "day", "hour", "minute", "second", "millisecond", "microsecond", "nanosecond", "ordinal_day", "weekday")] + [col("ts").dt.date().alias("d")], "year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, CAST(floor((epoch_us(ts) % 1000000) / 1000) AS BIGINT) AS millisecond, epoch_us(ts) % 1000000 AS microsecond, epoch_us(ts) % 1000000 * 1000 AS nanosecond, dayofyear(ts) AS ordinal_day, isodow(ts) AS weekday, CAST(ts AS DATE) AS d")
_row("dt_timestamp", lambda: [col("ts").dt.timestamp(u).alias(u) for u in ("ns", "us", "ms")], "epoch_us(ts) * 1000 AS ns, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms")
_row("dt_truncate", lambda: [col("ts").dt.truncate(e).alias(f"t{i}") for i, e in enumerate(("1s", "7m", "1h", "2d", "1mo", "1q", "1y"))], "date_trunc('second', ts) AS t0, make_timestamp(epoch_us(ts) - epoch_us(ts) % 420000000) AS t1, date_trunc('hour', ts) AS t2, make_timestamp(epoch_us(ts) - epoch_us(ts) % 172800000000) AS t3, CAST(date_trunc('month', ts) AS TIMESTAMP) AS t4, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS t5, CAST(date_trunc('year', ts) AS TIMESTAMP) AS t6")
_row("dt_offset_by", lambda: [col("ts").dt.offset_by(e).alias(f"t{i}") for i, e in enumerate(("90s", "-5m", "3h", "2d", "1mo", "-1y"))], "ts + INTERVAL 90 SECOND AS t0, ts - INTERVAL 5 MINUTE AS t1, ts + INTERVAL 3 HOUR AS t2, ts + INTERVAL 2 DAY AS t3, ts + INTERVAL 1 MONTH AS t4, ts - INTERVAL 1 YEAR AS t5")
_row("dt_to_string", lambda: [col("ts").dt.to_string("%Y-%m-%dT%H:%M:%S").alias("a"), col("ts").dt.to_string("%G-W%V-%u").alias("b"), col("ts").dt.to_string("%d.%m.%y").alias("c")], "strftime(ts, '%Y-%m-%dT%H:%M:%S') AS a, strftime(ts, '%G-W%V-%u') AS b, strftime(ts, '%d.%m.%y') AS c")
_row("dt_totals", lambda: [getattr((col("ts") - ts(2024, 1, 10, 12)).dt, f"total_{p}")().alias(p) for p in ("minutes", "seconds", "milliseconds", "microseconds", "nanoseconds")], "CAST(trunc(u / 60000000) AS BIGINT) AS minutes, CAST(trunc(u / 1000000) AS BIGINT) AS seconds, CAST(trunc(u / 1000) AS BIGINT) AS milliseconds, u AS microseconds, u * 1000 AS nanoseconds", "(SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00') AS u FROM events)")
QUERIES["dt_totals"] = lambda spark, d: lf.scan_parquet(spark, f"{d}/events.parquet").select("event_id", *[getattr((col("ts") - ts(2024, 1, 10, 12)).dt, f"total_{p}")().alias(p) for p in ("minutes", "seconds", "milliseconds", "microseconds", "nanoseconds")]).to_native()
_row("dt_zones", lambda: [col("ts").dt.convert_time_zone("Asia/Kathmandu").alias("a"), col("ts").dt.replace_time_zone("UTC").dt.replace_time_zone(None).alias("b")], "ts + INTERVAL '5 hours 45 minutes' AS a, ts AS b")

# --- lists ----------------------------------------------------------------------------------------------------------
_row("list_stats", lambda: [col("embedding").list.len().cast(dt.Int64).alias("n"), r(col("embedding").list.sum()).alias("s"), col("embedding").list.min().alias("mn"), col("embedding").list.max().alias("mx"), r(col("embedding").list.mean()).alias("m"), r(col("embedding").list.median()).alias("md"), col("embedding").list.get(5).alias("g"), col("embedding").list.get(500).alias("z")], "len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS s, list_min(embedding) AS mn, list_max(embedding) AS mx, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS m, round(list_median(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS md, embedding[6] AS g, CAST(NULL AS FLOAT) AS z", "embeddings", "vec_id")
_row("list_sort_unique", lambda: [lf.list_(col("vec_id") % 3, col("vec_id") % 2, lit(None, dt.Int64)).list.sort().list.get(1).alias("a"), lf.list_(col("vec_id") % 3, col("vec_id") % 2).list.sort(descending=True).list.get(0).alias("b"), lf.list_(col("vec_id") % 3, col("vec_id") % 2).list.unique().list.len().cast(dt.Int64).alias("c"), lf.list_(col("vec_id") % 3, lit(None, dt.Int64)).list.contains(2).alias("d")], "least(vec_id % 3, vec_id % 2) AS a, greatest(vec_id % 3, vec_id % 2) AS b, CASE WHEN vec_id % 3 = vec_id % 2 THEN 1 ELSE 2 END::BIGINT AS c, vec_id % 3 = 2 AS d", "embeddings", "vec_id")


# --- ordered (eager) operators --------------------------------------------------------------------------------------
def _eager(name: str, sql: str | None, table: str, fn: Callable[[Any], Any]) -> None:
    q(name, sql, table)(lambda f: fn(lf.DataFrame(f.to_native())))


def _by(f: Any, *keys: str) -> Any:
    """Rows in the order of the keys."""
    return f.sort(*keys)


_eager("eager_tail", "SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 4", "nation", lambda f: _by(f, "n_nationkey").tail(4).select("n_nationkey"))
_eager("eager_gather_every", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k >= 2 AND (k - 2) % 7 = 0", "orders", lambda f: _by(f, "o_orderkey").gather_every(7, 2).select("o_orderkey"))
_eager("eager_getitem", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k BETWEEN 10 AND 19", "orders", lambda f: _by(f, "o_orderkey")[10:20, ["o_orderkey", "o_custkey"]])
_eager("eager_pivot", "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS \"F\", count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS \"O\", count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS \"P\" FROM orders GROUP BY 1", "orders", lambda f: f.pivot("o_orderstatus", index="o_orderpriority", values="o_orderkey", aggregate_function="len", sort_columns=True))
_eager("eager_pivot_max", "SELECT user_id % 5 AS k, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'error' THEN value END) AS error FROM events WHERE event_type IN ('click', 'error') GROUP BY 1", "events", lambda f: f.filter(col("event_type").is_in(["click", "error"])).with_columns(k=col("user_id") % 5).pivot("event_type", index="k", values="value", aggregate_function="max"))
_eager("eager_is_duplicated", "SELECT count(*) FILTER (n > 1) AS d, count(*) FILTER (n = 1) AS u FROM (SELECT count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)", "events", lambda f: lf.concat([f.select("user_id", "event_type").is_duplicated().to_frame().select(col("mask").sum().alias("d")), f.select("user_id", "event_type").is_unique().to_frame().select(col("mask").sum().alias("u"))], how="horizontal"))
_eager("eager_null_count", "SELECT CAST(count(*) FILTER (event_id % 4 = 0) AS BIGINT) AS x FROM events", "events", lambda f: f.select(_nul.alias("x")).null_count())
_eager("eager_shift", "SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p FROM orders", "orders", lambda f: _by(f, "o_orderkey").select("o_orderkey", col("o_orderkey").shift(1).alias("p")))
_eager("eager_sample_n", "SELECT CAST(50 AS BIGINT) AS n", "orders", lambda f: f.sample(50, seed=1).select(lf.len_().alias("n")))
_eager("eager_sample_fraction", "SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS n FROM orders", "orders", lambda f: f.sample(fraction=0.1, seed=1).select(lf.len_().alias("n")))
_eager("eager_sample_replacement", "SELECT CAST(70 AS BIGINT) AS n", "nation", lambda f: f.sample(70, with_replacement=True, seed=1).select(lf.len_().alias("n")))
_eager("series_value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1", "events", lambda f: f["event_type"].value_counts(sort=True))
_eager("series_value_counts_normalize", "SELECT event_type, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS proportion FROM events GROUP BY 1", "events", lambda f: f["event_type"].value_counts(normalize=True).with_columns(r(col("proportion"))))
_eager("series_mode", "SELECT k AS user_id FROM (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))", "events", lambda f: f["user_id"].mode().to_frame())
_eager("series_unique", "SELECT DISTINCT event_type FROM events", "events", lambda f: f["event_type"].unique().to_frame())
_eager("series_to_dummies", "SELECT (r_name = 'AFRICA')::TINYINT AS \"r_name_AFRICA\", (r_name = 'AMERICA')::TINYINT AS \"r_name_AMERICA\", (r_name = 'ASIA')::TINYINT AS \"r_name_ASIA\", (r_name = 'EUROPE')::TINYINT AS \"r_name_EUROPE\", (r_name = 'MIDDLE EAST')::TINYINT AS \"r_name_MIDDLE EAST\" FROM region", "region", lambda f: f["r_name"].to_dummies())
_eager("series_hist", "SELECT b AS breakpoint, (SELECT count(*) FROM events WHERE value <= b AND (value > b - 25 OR (b = 25 AND value = 0))) AS count FROM (SELECT unnest([25.0, 50.0, 75.0, 100.0])::DOUBLE AS b)", "events", lambda f: f["value"].hist([0, 25, 50, 75, 100]))
_eager("series_arg_true", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS x FROM orders QUALIFY o_totalprice > 200000", "orders", lambda f: (_by(f, "o_orderkey")["o_totalprice"] > 200000).alias("x").arg_true().to_frame())
_eager("series_scatter", "SELECT CASE k WHEN 1 THEN 100 WHEN 3 THEN NULL ELSE n_nationkey END AS n_nationkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation)", "nation", lambda f: _by(f, "n_nationkey")["n_nationkey"].scatter([1, 3], [100, None]).to_frame())
_eager("series_zip_with", "SELECT CASE WHEN n_regionkey > 2 THEN n_nationkey ELSE n_regionkey END AS n_nationkey FROM nation", "nation", lambda f: f["n_nationkey"].zip_with(f["n_regionkey"] > 2, f["n_regionkey"]).to_frame())
_eager("series_sort", "SELECT n_regionkey FROM nation ORDER BY 1 DESC", "nation", lambda f: f["n_regionkey"].sort(descending=True).to_frame())


# --- in-memory sources ----------------------------------------------------------------------------------------------
def _source(name: str, make: Callable[[Any], Any], sql: str) -> None:
    QUERIES[f"source_{name}"] = lambda spark, _: make(spark).to_native()
    SQL[f"source_{name}"] = sql


def _numpy(spark: Any) -> Any:
    import numpy as np

    return lf.from_numpy(spark, np.arange(6.0).reshape(3, 2), ["a", "b"])


def _arrow(spark: Any) -> Any:
    import pyarrow as pa

    return lf.from_arrow(spark, pa.table({"a": [1, None], "b": ["x", "y"]}))


_source("from_dict", lambda s: lf.from_dict(s, {"a": [1, 2, None], "b": ["x", None, "z"]}), "SELECT * FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) t(a, b)")
_source("from_dicts", lambda s: lf.from_dicts(s, [{"a": 1, "b": 2.5}, {"a": 3}]), "SELECT * FROM (VALUES (1, 2.5::DOUBLE), (3, NULL)) t(a, b)")
_source("from_numpy", _numpy, "SELECT * FROM (VALUES (0.0::DOUBLE, 1.0::DOUBLE), (2.0, 3.0), (4.0, 5.0)) t(a, b)")
_source("from_arrow", _arrow, "SELECT * FROM (VALUES (1, 'x'), (NULL, 'y')) t(a, b)")
_source("new_series", lambda s: lf.new_series(s, "a", [3, 1, 2], dt.Int32).to_frame(), "SELECT * FROM (VALUES (3), (1), (2)) t(a)")
q("frame_with_row_index_strings", "SELECT row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS index, l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem", "lineitem")(lambda f: f.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").with_row_index(order_by=["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]))
q("eager_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey) - 1 AS index FROM orders", "orders")(lambda o: o.collect().sort("o_orderkey").sort("o_orderstatus", "o_totalprice", descending=[True, False]).with_row_index().select("o_orderkey", "index").lazy())
for _how, _op, _dir in (("backward", "<=", "DESC"), ("forward", ">=", "ASC")):
    q(f"join_asof_plain_{_how}", f"SELECT o_orderkey, (SELECT s_suppkey FROM supplier WHERE s_acctbal {_op} o_totalprice ORDER BY s_acctbal {_dir}, s_suppkey DESC LIMIT 1) AS s_suppkey FROM orders", "orders", "supplier")(lambda o, s, h=_how: o.join_asof(s.select("s_acctbal", "s_suppkey"), left_on="o_totalprice", right_on="s_acctbal", strategy=h).select("o_orderkey", "s_suppkey"))
q("join_asof_plain_nearest", "SELECT o_orderkey, (SELECT round(s_acctbal, 4) FROM supplier ORDER BY abs(s_acctbal - o_totalprice / 50), s_acctbal LIMIT 1) AS s FROM orders", "orders", "supplier")(lambda o, s: o.with_columns(x=col("o_totalprice") / 50).join_asof(s.select("s_acctbal"), left_on="x", right_on="s_acctbal", strategy="nearest").select("o_orderkey", col("s_acctbal").round(4).alias("s")))
q("source_scan_parquet", "SELECT * FROM region", "region")(lambda g: g)
q("frame_lazy_collect", "SELECT * FROM nation", "nation")(lambda n: n.collect().lazy())
q("win_unpartitioned", "SELECT n_nationkey, sum(n_regionkey) OVER (ORDER BY n_nationkey) AS s FROM nation", "nation")(lambda n: n.select("n_nationkey", col("n_regionkey").cum_sum().over(order_by="n_nationkey").alias("s")))

from . import conversions, tpch  # noqa: E402, F401  (they register theirs)
