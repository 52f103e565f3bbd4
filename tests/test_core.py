"""Rules of the expression language on small frames: nulls, NaN, division, order, broadcasting, errors."""

import datetime as D
import math

import pytest

import loomframe as lf
from loomframe import col as c
from loomframe import dtypes as dt
from loomframe import errors
from loomframe import selectors as cs
from loomframe.plans import ranges


@pytest.fixture(scope="module")
def d(spark):
    return lf.from_dict(spark, {"a": [1, 3, 2, None], "b": [4, 4, 6, 6], "z": [7.0, 8.0, 9.0, math.nan], "s": ["x y", "Ab-c", None, "-12"], "g": ["p", "p", "q", "q"]})


def get(frame, *sort):
    frame = frame.lazy().collect() if not isinstance(frame, lf.DataFrame) else frame
    return (frame.sort(*sort) if sort else frame).to_dict(as_series=False)


def test_broadcast(d):
    out = get(d.select("a", m=c("a").mean(), x=c("a") - c("a").mean()))
    assert out == {"a": [1, 3, 2, None], "m": [2.0] * 4, "x": [-1.0, 1.0, 0.0, None]}
    out = get(d.lazy().select(c("a").sum(), c("b").n_unique(), lf.len_(), lf.lit(3).alias("k"), c("a").filter(c("b") == 4).sum().alias("f"), c("a").drop_nulls().len().alias("n"), c("b").unique().sum().alias("u")))
    assert out == {"a": [6], "b": [2], "len": [4], "k": [3], "f": [4], "n": [3], "u": [10]}


def test_division(d):
    out = get(d.select(x=c("a") / 0, y=c("a") // 2, m=-c("a") % 3, r=2 / c("a"), q=c("b") // 0))
    assert out == {"x": [math.inf] * 3 + [None], "y": [0, 1, 1, None], "m": [2, 0, 1, None], "r": [2.0, 2 / 3, 1.0, None], "q": [None] * 4}
    nan = get(d.select(x=(c("a") * 0) / 0))["x"]
    assert all(math.isnan(v) for v in nan[:3]) and nan[3] is None


def test_groups(d):
    out = get(d.lazy().group_by("g").agg(c("a").sum(), r=(c("a").sum() / c("b").sum()).round(2), f=c("a").first(order_by="b"), la=c("z").last("a"), q=c("a").quantile(0.5, "lower")), "g")
    assert out == {"g": ["p", "q"], "a": [4, 2], "r": [0.5, 0.17], "f": out["f"], "la": [8.0, 9.0], "q": [1.0, 2.0]}
    assert get(d.lazy().drop("s", "z").group_by("g").agg(lf.all_().sum()), "g") == {"g": ["p", "q"], "a": [4, 2], "b": [8, 12]}
    assert get(d.lazy().group_by((c("b") % 4).alias("b")).agg(lf.len_()), "b") == {"b": [0, 2], "len": [2, 2]}
    assert sorted(k for k, _ in d.group_by("g")) == [("p",), ("q",)]


def test_windows(d):
    out = get(d.lazy().select("g", "a", s=(c("a").sum() + 1).over("g"), cs=c("a").cum_sum().over("g", order_by="a"), nu=c("b").n_unique().over("g"), rk=c("a").rank("min").over("g")), "g", "a")
    assert out == {"g": ["p", "p", "q", "q"], "a": [1, 3, None, 2], "s": [5, 5, 3, 3], "cs": [1, 4, None, 2], "nu": [1] * 4, "rk": [1, 2, None, 1]}
    out = get(d.select(x=c("a").shift(1), y=c("a").diff(), w=c("a").rolling_mean(2, min_samples=1), f=c("a").fill_null(strategy="forward"), e=c("a").ewm_mean(alpha=0.5)))
    assert out["x"] == [None, 1, 3, 2] and out["y"] == [None, 2, -1, None] and out["w"] == [1.0, 2.0, 2.5, 2.0] and out["f"] == [1, 3, 2, 2]
    assert [None if v is None else round(v, 6) for v in out["e"]] == [1.0, round((3 + 0.5) / 1.5, 6), round((2 + 1.5 + 0.25) / 1.75, 6), None]


def test_strings(d):
    out = get(d.select(t=c("s").str.to_titlecase(), r=c("s").str.replace("[xb]", "Q$"), z=c("s").str.zfill(5), l=c("s").str.slice(-5, 2), p=c("s").str.split("-")))
    assert out == {"t": ["X Y", "Ab-C", None, "-12"], "r": ["Q$ y", "AQ$-c", None, "-12"], "z": ["00x y", "0Ab-c", None, "-0012"], "l": ["", "A", None, ""], "p": [["x y"], ["Ab", "c"], None, ["", "12"]]}


def test_nulls_and_nan(d):
    out = get(d.select(n=c("z").is_nan(), f=c("z").is_finite(), cl=c("a").clip(2), fn=c("z").fill_nan(0.0), b=c("a").is_between(1, 2), i=c("a").is_in([1, 3])))
    assert out == {"n": [False] * 3 + [True], "f": [True] * 3 + [False], "cl": [2, 3, 2, None], "fn": [7.0, 8.0, 9.0, 0.0], "b": [True, False, True, None], "i": [True, True, False, None]}
    assert d.drop_nulls("z").shape[0] == 4 and d.drop_nulls().shape[0] == 2


def test_joins(spark, d):
    a, b = (lf.from_dict(spark, {"k": [1, None], n: [1, 2]}).lazy() for n in ("x", "y"))
    assert get(a.join(b, on="k", how="full"), "x", "y") == {"k": [None, 1, None], "x": [None, 1, 2], "k_right": [None, 1, None], "y": [2, 1, None]}
    assert get(a.join(b, on="k", how="semi"))["k"] == [1] and get(a.join(b, on="k", how="anti"))["k"] == [None]
    e = lf.from_dict(spark, {"t": [1, 5, 9], "k": ["u", "u", "v"]}).lazy()
    f = lf.from_dict(spark, {"t": [2, 4, 8], "k": ["u", "u", "v"], "v": [10, 20, 30]}).lazy()
    for strategy, want in (("backward", [None, 20, 30]), ("forward", [10, None, None]), ("nearest", [10, 20, 30])):
        assert get(e.join_asof(f, on="t", by="k", strategy=strategy), "t")["v"] == want


def test_dates(spark):
    x = lf.from_dict(spark, {"t": [D.datetime(2021, 1, 3, 4, 5, 6, 789123), D.datetime(1969, 12, 31, 23, 59, 59, 1)], "d": [D.date(2020, 2, 29), None]})
    out = get(x.select(w=c("t").dt.weekday(), us=c("t").dt.microsecond(), ts=c("t").dt.timestamp("ms"), st=c("t").dt.to_string("%G-W%V-%u %Y/%m/%dT%H:%M:%S.%f"), dy=c("d").dt.offset_by("1y")))
    assert out == {"w": [7, 3], "us": [789123, 1], "ts": [1609646706789, -1000], "st": ["2020-W53-7 2021/01/03T04:05:06.789123", "1970-W01-3 1969/12/31T23:59:59.000001"], "dy": [D.date(2021, 2, 28), None]}
    out = get(x.select(t=c("t").dt.truncate("7m").cast(dt.String), q=c("t").dt.truncate("1q").cast(dt.String)))
    assert out == {"t": ["2021-01-03 04:04:00", "1969-12-31 23:53:00"], "q": ["2021-01-01 00:00:00", "1969-10-01 00:00:00"]}


def test_lists(spark):
    q = lf.from_dict(spark, {"l": [[3, None, 2, 2], [-1], None, [None], []]})
    out = get(q.select(*[getattr(c("l").list, m)().alias(m) for m in ("len", "min", "sum", "mean", "median", "unique")], x=c("l").list.contains(2), n=c("l").list.contains(None), s=c("l").list.sort(descending=True)))
    assert out == {"len": [4, 1, None, 1, 0], "min": [2, -1, None, None, None], "sum": [7, -1, None, 0, 0], "mean": [7 / 3, -1.0, None, None, None], "median": [2.0, -1.0, None, None, None], "unique": [[3, None, 2], [-1], None, [None], []], "x": [True, False, None, False, False], "n": [True, False, None, True, False], "s": [[None, 3, 2, 2], [-1], None, [None], []]}


def test_frames(spark, d):
    x = lf.from_dict(spark, {"i": [1, 2, 3], "l": [[1, 2], [], None], "m": [[3, 4], [], None]}).lazy()
    assert get(x.explode("l", "m"), "i", "l") == {"i": [1, 1, 2, 3], "l": [1, 2, None, None], "m": [3, 4, None, None]}
    assert d.pivot("g", index="b", values="a", aggregate_function="sum").rows() == [(4, 4, None), (6, None, 2)]
    assert get(lf.concat([d.select("a"), d.select("g")], how="horizontal")) == {"a": [1, 3, 2, None], "g": ["p", "p", "q", "q"]}
    assert d[[0, 2], ["a", "b"]].rows() == [(1, 4), (2, 6)] and d.row(1) == (3, 4, 8.0, "Ab-c", "p") and d.item(0, "a") == 1
    assert d.tail(2).select("a").rows() == [(2,), (None,)] and d.with_row_index().columns[0] == "index"
    assert lf.framed(lambda f: f.select("a"))(d.to_native()).columns == ["a"]


def test_series(d):
    s = d["a"]
    assert s.sum() == 6 and (s + 1).to_list() == [2, 4, 3, None] and s.arg_max() == 1 and s.arg_min() == 0
    assert s.sort(descending=True).to_list() == [None, 3, 2, 1] and not s.is_sorted() and 3 in s and s[1:3].to_list() == [3, 2]
    assert s.scatter([0, 1], [9, None]).to_list() == [9, None, 2, None] and s.cum_sum().to_list() == [1, 4, 6, None]
    assert d["b"].hist(bin_count=2).rows() == [(5.0, 2), (6.0, 2)] and sorted(d["b"].mode().to_list()) == [4, 6]
    assert d["g"].to_dummies().rows() == [(1, 0), (1, 0), (0, 1), (0, 1)] and s.zip_with(d["b"] == 4, d["b"]).to_list() == [1, 3, 6, 6]


def test_selectors_and_names(d):
    assert d.select(cs.numeric() - cs.matches("z")).columns == ["a", "b"]
    assert d.select(~cs.string()).columns == ["a", "b", "z"]
    assert d.select(c("a", "b").sum().name.suffix("_x")).columns == ["a_x", "b_x"]
    assert d.select(lf.nth(0), lf.exclude("a", "b", "z")).columns == ["a", "s", "g"]


def test_dtypes(d):
    assert d.schema["a"] == dt.Int64 and dt.Datetime("us") == dt.Datetime and dt.Datetime("us") != dt.Datetime("ns")
    assert dt.List(dt.Int64) != dt.List(dt.String) and dt.from_spark(dt.to_spark(dt.Struct({"x": dt.Int8}))) == dt.Struct({"x": dt.Int8()})
    with pytest.raises(Exception, match="range"):
        d.select((c("a") - 5).cast(dt.UInt8)).rows()
    with pytest.raises(errors.UnsupportedDTypeError):
        dt.to_spark(dt.Object)


@pytest.mark.parametrize(
    ("bad", "error"),
    [
        (lambda f: f.select(c("a").sum().sum()), errors.InvalidOperationError),
        (lambda f: f.select(c("a").cum_sum()), errors.InvalidOperationError),
        (lambda f: f.select("nope"), errors.ColumnNotFoundError),
        (lambda f: f.select("a", "a"), errors.DuplicateError),
        (lambda f: f.group_by("g").agg(c("a")), errors.InvalidOperationError),
        (lambda f: f.select(c("a").drop_nulls()), errors.InvalidOperationError),
        (lambda f: f.select(c("a").abs().over("g")), errors.InvalidOperationError),
        (lambda f: f.select(c("s").median()), errors.InvalidOperationError),
        (lambda f: f.select(c("a", "b") + c("a", "b", "z")), errors.MultiOutputExpressionError),
        (lambda f: f.unique("a", keep="first"), errors.InvalidOperationError),
        (lambda f: f.with_row_index(), errors.InvalidOperationError),
        (lambda f: f.join(f, on="nope"), errors.ColumnNotFoundError),
        (lambda f: f.drop("nope"), errors.ColumnNotFoundError),
        (lambda f: bool(c("a") == 1), TypeError),
    ],
)
def test_errors(d, bad, error):
    with pytest.raises(error):
        bad(d.lazy())


def test_files_and_stream(spark, d, tmp_path):
    d.write_parquet(f"{tmp_path}/p")
    assert sorted(lf.scan_parquet(spark, f"{tmp_path}/p").collect().select("b").rows()) == [(4,), (4,), (6,), (6,)]
    d.select("b", "g").write_csv(f"{tmp_path}/c")
    assert lf.scan_csv(spark, f"{tmp_path}/c").schema == {"b": dt.Int32(), "g": dt.String()}
    from loomframe.streaming import scan_parquet_stream

    s = scan_parquet_stream(spark, f"{tmp_path}/p", spark.read.parquet(f"{tmp_path}/p").schema).group_by("g").agg(c("b").sum())
    run = s.to_native().writeStream.format("memory").queryName("sums").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM sums").collect()) == [("p", 8), ("q", 12)]


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore_nulls", [True, False])
@pytest.mark.parametrize("alpha", [0.0005, 0.3, 0.97])
def test_ewm_mean_of_long_columns(spark, alpha, adjust, ignore_nulls):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    x = pd.Series(rng.normal(50, 20, 10_000)).where(rng.random(10_000) > 0.2)
    x[3000:5500] = None
    got = lf.from_dict(spark, {"x": [None if math.isnan(v) else v for v in x]}).select(c("x").ewm_mean(alpha=alpha, adjust=adjust, ignore_nulls=ignore_nulls)).to_dict(as_series=False)["x"]
    want = x.ewm(alpha=alpha, adjust=adjust, ignore_na=ignore_nulls).mean().where(x.notna())
    assert [v is None for v in got] == want.isna().tolist()
    assert np.allclose([v for v in got if v is not None], want.dropna(), rtol=1e-9)


def test_values_that_count_once(spark):
    d = lf.from_dict(spark, {"x": [1, 1, 1, 5, None, None], "g": ["a", "a", "a", "a", "b", "b"]})
    u, m = c("x").unique(), c("x").mode(keep="all")
    out = get(d.lazy().select(s=u.std(), md=u.median(), v=u.var(), q=u.quantile(1.0), k=u.null_count(), n=u.len(), c=u.count(), me=u.mean(), ms=m.sum(), ml=m.len()))
    assert {k: round(v[0], 4) for k, v in out.items()} == {"s": 2.8284, "md": 3.0, "v": 8.0, "q": 5.0, "k": 1, "n": 3, "c": 2, "me": 3.0, "ms": 1, "ml": 1}
    out = get(d.lazy().select("g", s=u.sum().over("g"), m=u.mean().over("g"), n=u.count().over("g"), le=u.len().over("g"), mo=m.max().over("g")).unique(), "g")
    assert out == {"g": ["a", "b"], "s": [6, 0], "m": [3.0, None], "n": [2, 0], "le": [2, 1], "mo": [1, None]}
    out = get(d.lazy().filter(c("g") == "a").group_by("g").agg(u.std().round(4).alias("s"), c("x").filter(c("x") > 1).unique().len().alias("n"), m.min().alias("m")))
    assert out == {"g": ["a"], "s": [2.8284], "n": [1], "m": [1]}
    two = lf.from_dict(spark, {"x": [2, 2, 7, 7, 1]})
    assert get(two.lazy().select(c("x").mode(keep="all").sum()))["x"] == [9]
    for bad in (c("x").unique().filter(c("x") > 1).sum(), c("x").unique().mode(keep="all").len(), c("x").mode(keep="all")):
        with pytest.raises(errors.InvalidOperationError):
            two.lazy().select(bad)


@pytest.mark.parametrize("how", ["lower", "higher", "nearest", "midpoint", "linear"])
def test_quantiles(spark, how):
    import numpy as np

    v = [5.0, 1.0, 4.0, 4.0, None, 9.0, 2.5, 7.0]
    d = lf.from_dict(spark, {"x": v, "g": ["a"] * 5 + ["b"] * 3}).lazy()
    whole, parts = [x for x in v if x is not None], {"a": [5.0, 1.0, 4.0, 4.0], "b": [9.0, 2.5, 7.0]}
    for q in (0.0, 0.3, 0.5, 0.77, 1.0):
        one = c("x").quantile(q, how)
        assert get(d.select(one, m=c("x").max()))["x"] == [pytest.approx(np.quantile(whole, q, method=how))]
        want = {k: pytest.approx(np.quantile(p, q, method=how)) for k, p in parts.items()}
        out = get(d.group_by("g").agg(one), "g")
        assert dict(zip(out["g"], out["x"])) == want
        out = get(d.select("g", y=one.over("g")))
        assert dict(zip(out["g"], out["y"])) == want
    assert get(d.filter(c("x") > 100).select(c("x").quantile(0.5, how)))["x"] == [None]


def test_powers_are_exact(spark):
    d = lf.from_dict(spark, {"a": [3, -3, 2, -1, 0, 10, 1, None], "b": [39, 39, 62, 10**6 + 1, 5, 18, 10**9, 2]})
    assert get(d.select(c("a") ** c("b")))["a"] == [3**39, -(3**39), 2**62, -1, 0, 10**18, 1, None]


def plan_of(frame):
    return frame.to_native()._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sampled", [4, 1000])
def test_orders_in_ranges(spark, monkeypatch, sampled):
    """Numbers, sorts, ranks and as-of joins over whole frames, against Python, with ties, nulls and both directions."""
    import random

    monkeypatch.setattr(ranges, "SAMPLED", sampled)
    rng = random.Random(4)
    rows = [(rng.choice([None, "b", "a", "c"]), rng.choice([None, 1.5, -2.0, math.nan, 7.0]), i) for i in range(500)]
    d = lf.from_dict(spark, {"s": [r[0] for r in rows], "x": [r[1] for r in rows], "i": [r[2] for r in rows]})
    num = lambda v: math.inf if v is not None and math.isnan(v) else v
    key = lambda v, desc=False, last=False: ((v is None) == last, 0 if v is None else v)
    want = sorted(rows, key=lambda r: (key(r[0]), key(num(r[1])), r[2]))
    got = d.lazy().with_row_index(order_by=["s", "x", "i"])
    assert [r["i"] for r in sorted(got.to_native().collect(), key=lambda r: r["index"])] == [r[2] for r in want]
    for last in (False, True):
        want = sorted(rows, key=lambda r: r[2])
        want = sorted(want, key=lambda r: -math.inf if r[1] is None else -num(r[1]))
        want = [r for r in want if (r[1] is None) != last] + [r for r in want if (r[1] is None) == last]
        assert get(d.sort("x", descending=True, nulls_last=last))["i"] == [r[2] for r in want]
    both = [r for r in rows if r[1] is not None and not math.isnan(r[1])]
    p = lf.from_dict(spark, {"x": [r[1] for r in both]})
    lo = [sum(q[1] < r[1] for q in both) for r in both]
    n = [sum(q[1] == r[1] for q in both) for r in both]
    assert get(p.select(c("x").rank("min")))["x"] == [a + 1 for a in lo]
    assert get(p.select(c("x").rank("average")))["x"] == [a + (b + 1) / 2 for a, b in zip(lo, n)]
    assert sorted(get(p.select(c("x").rank("ordinal")))["x"]) == list(range(1, len(both) + 1))
    right = lf.from_dict(spark, {"t": [10, 10, 50, 400], "v": [1, 2, 3, 4]})
    back = get(d.select("i").join_asof(right, left_on="i", right_on="t"))["v"]
    assert back == [None if i < 10 else 2 if i < 50 else 3 if i < 400 else 4 for i in range(500)]
    forth = get(d.select("i").join_asof(right, left_on="i", right_on="t", strategy="forward"))["v"]
    assert forth == [2 if i <= 10 else 3 if i <= 50 else 4 if i <= 400 else None for i in range(500)]
    near = get(d.select("i").join_asof(right, left_on="i", right_on="t", strategy="nearest"))["v"]
    assert near == [2 if i <= 30 else 3 if i <= 225 else 4 for i in range(500)]
    for e in (lf.from_dict(spark, {"x": []}, {"x": dt.Int64}), lf.from_dict(spark, {"x": [1]})):
        assert get(e.sort("x").with_row_index())["index"] == list(range(len(e)))


def test_aggregates_beside_rows_are_one_aggregation(spark):
    d = lf.from_dict(spark, {"a": [1, 2, 3], "b": [1.0, 2.0, 4.0]}).lazy()
    out = d.select(x=c("a") - c("a").mean(), y=c("b") // c("b").max(), z=(c("a").sum() + c("b").std()) * c("b"))
    assert plan_of(out).count("Join") == 1 and plan_of(out).count("Aggregate") == 1


def test_too_many_columns_are_refused(spark):
    many = lf.from_dict(spark, {"k": list(range(10_001)), "v": [1] * 10_001, "i": [0] * 10_001})
    for make in (lambda: many.pivot("k", index="i", values="v"), lambda: many.get_column("k").to_dummies()):
        with pytest.raises(errors.InvalidOperationError):
            make()


def test_is_close_at_zero(spark, tmp_path):
    """The query against its SQL where a value is 0; the operator's tolerance there is 0 unless abs_tol is given."""
    import duckdb

    from loomframe import queries as lib

    spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 1e-9, 0.01, 49.0, 51.0, 51.01, 560.21, -3.0])], "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(lib.SQL["pred_is_close"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in lib.QUERIES["pred_is_close"](spark, str(tmp_path)).collect()) == sorted(want)
    z = lf.from_dict(spark, {"x": [0.0, 1.0]})
    assert get(z.select(c("x").is_close(c("x") + 1e-12)))["x"] == [False, True]
    assert get(z.select(c("x").is_close(c("x") + 1e-12, abs_tol=1e-9)))["x"] == [True, True]


def test_ranges_of_many_keys_are_found_by_searches(spark, monkeypatch):
    """Numbers over keys of many types, with nulls, ties, NaN and -0.0, and no function of every bound for each row."""
    import random

    monkeypatch.setattr(ranges, "SAMPLED", 20)
    rng = random.Random(5)
    rows = [(rng.choice([None, 0.0, -0.0, 1.5, math.nan]), rng.choice("ab"), D.datetime(2020, 1, 1) + D.timedelta(hours=rng.randrange(9)), rng.choice([None, D.date(1960, 5, 5), D.date(2000, 1, 1)]), i) for i in range(600)]
    d = spark.createDataFrame(rows, "x double, s string, t timestamp_ntz, d date, i long")
    got = lf.LazyFrame(d).with_row_index(order_by=["x", "s", "t", "d", "i"])
    num = lambda v: math.inf if v is not None and math.isnan(v) else v
    want = sorted(rows, key=lambda r: (r[0] is not None, num(r[0]) or 0, r[1], r[2], r[3] is not None, r[3] or D.date.min, r[4]))
    out = got.to_native().collect()
    assert [r["i"] for r in sorted(out, key=lambda r: r["index"])] == [r[4] for r in want] and sorted(r["index"] for r in out) == list(range(600))
    assert "lambda" not in plan_of(got)


def test_sorts_of_sorts_read_their_input_twice(spark, tmp_path):
    """Once for the counts of the ranges and once for the rows, however many sorts are before."""
    spark.range(3000).selectExpr("id AS i", "id % 7 AS k", "id % 11 AS m").write.parquet(f"{tmp_path}/t")
    e = lf.scan_parquet(spark, f"{tmp_path}/t").collect()
    out = e.sort("i", descending=True).sort("m").sort("k").with_row_index()
    assert plan_of(out.lazy()).count("parquet") <= 2
    want = sorted(sorted(range(3000)[::-1], key=lambda i: i % 11), key=lambda i: i % 7)
    assert [r[1] for r in out.rows()] == want and get(out)["index"] == list(range(3000))


def test_places_after_a_sort_need_no_sample(spark, tmp_path):
    """arg_true of a sorted frame: the input is read twice, and the second numbering isn't sampled."""
    spark.range(3000).selectExpr("id AS i", "id * 37 % 3001 AS k").write.parquet(f"{tmp_path}/t")
    e = lf.scan_parquet(spark, f"{tmp_path}/t").collect().sort("k")
    s = (e["i"] % 5 == 2).alias("x").arg_true()
    assert plan_of(s.to_frame().lazy()).count("parquet") <= 2
    order = sorted(range(3000), key=lambda i: i * 37 % 3001)
    assert s.to_list() == [n for n, i in enumerate(order) if i % 5 == 2]


@pytest.mark.parametrize("rows", [0, 5, 3000])
def test_numbers_after_a_sort_sort_nothing_again(spark, tmp_path, rows):
    """The places are the numbers where all rows are still there; the ranges' rows are counted before any is sorted."""
    spark.range(rows).selectExpr("id AS i", "if(id % 9 = 0, null, id % 13) AS k").write.parquet(f"{tmp_path}/t")
    e = lf.scan_parquet(spark, f"{tmp_path}/t").collect()
    d = e.sort("k", "i").with_columns(z=c("i") * 2)
    order = sorted(range(rows), key=lambda i: (i % 9 != 0, i % 13 if i % 9 else 0, i))
    s = (d["z"] % 5 == 2).alias("x").arg_true()
    assert s.to_list() == [n for n, i in enumerate(order) if 2 * i % 5 == 2]
    assert str(s._df._jdf.queryExecution().optimizedPlan()).count("row_number()") <= 1
    # Not where rows are missing, doubled or have got another order since.
    for got, want in (
        (d.filter(c("i") % 3 == 0), [i for i in order if i % 3 == 0]),
        (d.filter(c("i") % 3 == 0).select("i"), [i for i in order if i % 3 == 0]),
        (lf.DataFrame(d._df.unionAll(d._df)), sorted([*order, *order], key=order.index)),
        (d.sort("i", descending=True), sorted(order, reverse=True)),
        (d.sort("i", descending=True).sort("z"), sorted(order)),
        (d.tail(7), order[-7:]),
    ):
        assert sorted((r[0], r[1]) for r in got.with_row_index().select("index", "i").rows()) == list(enumerate(want)), want[:5]


def whole_frames(spark):
    """Rows with nulls, and an ordered column of them in the three ways that a window over all rows has."""
    import random

    rng = random.Random(6)
    x = [None if rng.random() < 0.3 or 200 < i < 290 else rng.randrange(1, 9) for i in range(600)]
    rows = [(i, v, 1) for i, v in enumerate(x)]
    rng.shuffle(rows)
    d = lf.LazyFrame(spark.createDataFrame(rows, "i long, x long, one int").repartition(7, "i")).with_columns(k=lf.lit(1))
    eager = d.collect().sort("i")
    take = lambda f, e, order: get(f.select("i", y=order(e)), "i")["y"]
    ways = [lambda e: take(eager, e, lambda e: e), lambda e: take(d, e, lambda e: e.over(order_by="i")), lambda e: take(d, e, lambda e: e.over("k", order_by="i"))]
    return x, ways


@pytest.mark.parametrize("way", [0, 1, 2])
def test_windows_over_whole_frames(spark, monkeypatch, way):
    import pandas as pd

    from loomframe.plans import whole

    monkeypatch.setattr(ranges, "SAMPLED", 20)
    monkeypatch.setattr(whole, "BLOCK", 50)
    x, ways = whole_frames(spark)
    s = pd.Series([math.nan if v is None else v for v in x])
    plain = lambda p: [None if v != v else v for v in p.tolist()]
    e, got = c("x"), ways[way]
    back = s[::-1]
    for expr, want in (
        (e.shift(1), s.shift(1)), (e.shift(-2), s.shift(-2)), (e.shift(70), s.shift(70)), (e.diff(), s.diff()),
        (e.cum_sum(), s.cumsum()), (e.cum_sum(reverse=True), back.cumsum()[::-1]), (e.cum_max(), s.cummax()), (e.cum_min(reverse=True), back.cummin()[::-1]),
        (e.cum_count(), s.notna().cumsum()), (e.fill_null(strategy="forward"), s.ffill()), (e.fill_null(strategy="backward"), s.bfill()),
        (e.fill_null(strategy="backward", limit=3), s.bfill(limit=3)), (e.rolling_sum(60, min_samples=2), s.rolling(60, min_periods=2).sum()),
        (e.rolling_sum(5, min_samples=1, center=True), s.rolling(5, min_periods=1, center=True).sum()),
    ):
        assert got(expr) == plain(want)


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore_nulls", [True, False])
@pytest.mark.parametrize("alpha", [0.004, 0.5, 1])
def test_ewm_mean_over_whole_frames(spark, monkeypatch, alpha, adjust, ignore_nulls):
    import pandas as pd

    monkeypatch.setattr(ranges, "SAMPLED", 20)
    x, ways = whole_frames(spark)
    s = pd.Series([math.nan if v is None else v for v in x])
    want = s.ewm(alpha=alpha, adjust=adjust, ignore_na=ignore_nulls, min_periods=4).mean().where(s.notna())
    for got in ways[:1] + ways[2:]:
        y = got(c("x").ewm_mean(alpha=alpha, adjust=adjust, ignore_nulls=ignore_nulls, min_samples=4))
        assert [v is None for v in y] == want.isna().tolist()
        assert [v for v in y if v is not None] == pytest.approx(want.dropna().tolist(), rel=1e-9)


def test_no_single_task_has_the_rows_of_an_ordered_window(spark, monkeypatch):
    """A constant key is none: no window over the rows is without keys, or has that one."""
    monkeypatch.setattr(ranges, "SAMPLED", 20)
    d = lf.LazyFrame(spark.range(600).withColumnRenamed("id", "i")).with_columns(k=lf.lit(1))
    for e in (c("i").shift(1), c("i").ewm_mean(alpha=0.1), c("i").cum_sum()):
        plan = plan_of(d.select("i", y=e.over("k", order_by="i")))
        assert "windowspecdefinition(1" not in plan and "windowspecdefinition(i#" not in plan and "windowspecdefinition(id#" not in plan
