"""Registry of the driver queries: a Spark plan over the given tables and its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Declared rather than inferred: a scan then needs no footer job before planning.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """Lazy readers of the driver tables: ``t.orders`` is a parquet scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    # Joins that several queries share.
    def labelled_documents(self) -> DataFrame:
        return self.documents.select("doc_id", "lang", "source", "n_chars").join(self.labels, "doc_id")

    def order_lines(self, *columns: str) -> DataFrame:
        """lineitem joined to its order; only the requested columns are scanned."""
        lines = [c for c in columns if c.startswith("l_")]
        heads = [c for c in columns if c.startswith("o_")]
        left = self.lineitem.select(*dict.fromkeys(["l_orderkey", *lines]))
        right = self.orders.select(*dict.fromkeys(["o_orderkey", *heads]))
        return left.join(right, left.l_orderkey == right.o_orderkey).select(*columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that two engines' summation orders agree."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ])


# ---- pieces of oracle SQL


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def arank(x: str, part: str = "") -> str:
    """Average-tie rank in SQL."""
    by = f"partition by {part} " if part else ""
    ties = f"partition by {part}, {x}" if part else f"partition by {x}"
    return f"(rank() over ({by}order by {x}) + (count(*) over ({ties}) - 1) / 2.0)"


def scorr(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))"


def drawn(seed: int, *keys: str) -> str:
    """The library's keyed 60-bit integer."""
    text = "concat_ws('|', " + ", ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]]) + ")"
    return f"cast(('0x' || substr(md5({text}), 1, 15)) as bigint)"


def binom_p(k: str, n: str) -> str:
    """Exact two-sided sign-test p in SQL."""
    return (f"least(1.0, 2 * list_sum(list_transform(range(0, cast(least({k}, {n} - {k}) as bigint) + 1), "
            f"lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0)))))")


def t_p(t: str, df: str) -> str:
    """Two-sided Student t tail by Simpson's rule on the substitution t = sqrt(df) tan(u)."""
    # P(|T|>t) = 1 - 2 c Int_0^atan(t/sqrt(df)) cos(u)^(df-1) du
    h = f"(atan(abs({t}) / sqrt({df})) / 400.0)"
    c = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return (f"greatest(0.0, 1 - 2 * {c} * {h} / 3.0 * list_sum(list_transform(range(0, 401), lambda i: "
            f"(case when i = 0 or i = 400 then 1 when i % 2 = 1 then 4 else 2 end) * pow(cos(i * {h}), {df} - 1))))")


def normal_sf(z: str) -> str:
    """P(Z >= z) by the series of the normal distribution function."""
    # Phi(|z|) = 1/2 + phi(z) sum z^(2n+1) / (2n+1)!!
    a = f"least(abs({z}), 8.0)"
    series = (f"list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(greatest({a}, 1e-12)) "
              f"+ n * ln(2.0) + lgamma(n + 1) - lgamma(2 * n + 2))))")
    phi = f"(0.5 + exp(-{a} * {a} / 2) / sqrt(2 * pi()) * {series})"
    return f"(case when {z} >= 0 then 1 - {phi} else {phi} end)"


def t_quantile(p: float, df: str) -> str:
    """Upper quantile of Student t by Newton steps on the exact tail, from the normal point."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    t = f"({z!r} * (1 + ({z * z + 1!r}) / (4.0 * {df})))"
    # Nested lambdas name each step once; the tail is twice the upper one.
    step = (f"lambda t: [t[1] + ({t_p('t[1]', df)} - {2 * (1 - p)!r}) / (2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) "
            f"/ sqrt({df} * pi()) * pow(1 + t[1] * t[1] / {df}, -({df} + 1) / 2.0))]")
    once = f"list_transform([[{t}]], {step})"
    twice = f"list_transform({once}, {step})"
    return f"list_transform({twice}, {step})[1][1]"
