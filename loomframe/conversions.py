"""Queries of sources, sinks, eager conversions and operators with the expression on the right."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import loomframe as lf
from loomframe import col, lit
from loomframe import dtypes as dt
from loomframe import selectors as cs

from .operators.eager import Series
from .queries import _row, q, r


def _folder(spark: Any) -> str:
    """A new folder that the executors see: under spark.checkpoint.dir, or a local one where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{shared or tempfile.mkdtemp(prefix='loomframe-out-')}/{uuid.uuid4().hex}"


def _spark(frame: Any) -> Any:
    return frame.to_native().sparkSession


def _out_and_in(name: str, write: Callable[[Any, str], Any], read: Callable[[Any, str], Any]) -> None:
    @q(name, "SELECT n_nationkey, n_name, n_regionkey FROM nation", "nation")
    def run(n: Any) -> Any:
        path = _folder(_spark(n))
        write(n, path)
        return read(_spark(n), path)


_out_and_in("sink_parquet", lambda n, p: n.sink_parquet(p), lf.read_parquet)
_out_and_in("write_parquet", lambda n, p: n.collect().write_parquet(p), lf.scan_parquet)
_out_and_in("write_csv", lambda n, p: n.collect().write_csv(p), lf.read_csv)
_out_and_in("scan_csv", lambda n, p: n.to_native().write.option("sep", "|").option("header", True).csv(p), lambda s, p: lf.scan_csv(s, p, separator="|"))


def _made(name: str, sql: str, table: str, fn: Callable[[Any, Any], dict[str, list[Any]]]) -> None:
    """A query whose values go through the driver: small tables, as such conversions are for."""
    q(name, sql, table)(lambda f: lf.from_dict(_spark(f), fn(f, f.collect())))


def _key(e: Any) -> Any:
    return e.sort("r_regionkey")


_REGION = "SELECT r_regionkey, r_name FROM region"
_made("eager_to_dict", _REGION, "region", lambda f, e: e.to_dict(as_series=False))
_made("eager_to_pandas", _REGION, "region", lambda f, e: e.to_pandas().to_dict("list"))
_made("eager_to_arrow", _REGION, "region", lambda f, e: e.to_arrow().to_pydict())
_made("eager_to_numpy", "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region", "region", lambda f, e: {"k": [int(x) for x in e.select("r_regionkey").to_numpy()[:, 0]]})
_made("eager_rows", _REGION, "region", lambda f, e: {"r_regionkey": [x[0] for x in e.rows()], "r_name": [x["r_name"] for x in e.iter_rows(named=True)]})
_made("eager_row_item", "SELECT r_name AS a, r_name AS b, CAST(r_regionkey AS BIGINT) AS c FROM region WHERE r_regionkey = 2", "region", lambda f, e: {"a": [_key(e).row(2)[1]], "b": [_key(e).item(2, "r_name")], "c": [e.filter(r_regionkey=2).select("r_regionkey").item()]})
_made("eager_columns", "SELECT unnest(['r_regionkey', 'r_name']) AS name, unnest([5, 5]) AS n", "region", lambda f, e: {"name": [s.name for s in e.iter_columns()], "n": [len(e.get_column(c)) for c in e.columns]})
_made("eager_shape", "SELECT count(*) AS n, 2 AS width, count(*) = 0 AS empty, true AS sized FROM region", "region", lambda f, e: {"n": [e.shape[0]], "width": [e.shape[1]], "empty": [e.is_empty()], "sized": [e.estimated_size() > 0]})
_made("frame_schema", "SELECT unnest(['r_regionkey', 'r_name']) AS name, unnest(['Int32', 'String']) AS kind, true AS same", "region", lambda f, e: {"name": f.columns, "kind": [str(x) for x in f.schema.values()], "same": [f.schema == f.collect_schema()] * 2})
q("eager_clone", _REGION, "region")(lambda f: f.collect().clone())
_made("series_values", "SELECT r_regionkey AS a, r_regionkey AS b, r_regionkey AS c, r_regionkey AS d FROM region", "region", lambda f, e: (lambda s: {"a": s.to_list(), "b": s.to_numpy().tolist(), "c": s.to_pandas().tolist(), "d": s.to_arrow().to_pylist()})(e.get_column("r_regionkey")))
_made("series_facts", "SELECT 4 AS hi, 0 AS lo, true AS up, false AS down, false AS empty, count(*) AS n, 'Int32' AS kind, 3 AS item FROM region", "region", lambda f, e: (lambda s: {"hi": [s.arg_max()], "lo": [s.arg_min()], "up": [s.is_sorted()], "down": [s.is_sorted(descending=True)], "empty": [s.is_empty()], "n": [s.shape[0]], "kind": [str(s.dtype)], "item": [s.item(3)]})(_key(e).get_column("r_regionkey")))
q("series_from_iterable", "SELECT unnest([3, 1, 2]) AS x", "region")(lambda f: Series.from_iterable(_spark(f), "x", [3, 1, 2]).to_frame())
_made("group_iter", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1", "nation", lambda f, e: (lambda g: {"k": [k[0] for k, _ in g], "n": [len(x.collect()) for _, x in g]})(list(f.group_by("n_regionkey"))))

_row("op_reflected", lambda: [(5 + col("user_id")).alias("a"), (2 * col("user_id")).alias("b"), r(7 / (col("user_id") + 1)).alias("c"), (100 // (col("user_id") + 1)).alias("d"), (100 % (col("user_id") + 1)).alias("e"), (True & (col("value") > 50)).alias("f"), (False | (col("value") > 50)).alias("g"), (2 ** (col("user_id") % 40)).alias("h")], "5 + user_id AS a, 2 * user_id AS b, round(7 / (user_id + 1)::DOUBLE, 6) AS c, 100 // (user_id + 1) AS d, 100 % (user_id + 1) AS e, value > 50 AS f, value > 50 AS g, 1::BIGINT << (user_id % 40) AS h")
_row("op_power_exact", lambda: [((col("event_id") * 0 + 3) ** 39).alias("a"), ((-3) ** (col("user_id") % 4)).alias("b")], "4052555153018976267 AS a, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -3 WHEN 2 THEN 9 ELSE -27 END AS b")
_row("str_to_time", lambda: [lf.concat_str(lit("1"), (col("event_id") % 10).cast(dt.String), lit(":30:05")).str.to_time().cast(dt.String).alias("t")], "'1' || (event_id % 10) || ':30:05' AS t")
q("names_lower", "SELECT o_orderkey AS o_orderkey FROM orders", "orders")(lambda o: o.select(col("o_orderkey").alias("O_ORDERKEY").name.to_lowercase()))
q("selectors_all", "SELECT r_regionkey, r_name FROM region", "region")(lambda f: f.select(cs.all()))
