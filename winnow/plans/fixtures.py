"""Views over the driver's tables that give every operator a realistic, seeded input.

Each view exists twice: as a Spark DataFrame and as a CTE for the SQL twin.  Both are built
from the same expression text; only the spelling of the hash-based uniform differs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.primitives import settle
from winnow.plans.registry import cte


def u_spark(tag: str, key: str = "rid") -> str:
    return (f"(cast(conv(substr(md5(concat_ws(':',{key},'{tag}')),1,8),16,10) as bigint)"
            "/4294967296.0D)")


def u_duck(tag: str, key: str = "rid") -> str:
    return f"(('0x'||substr(md5(concat_ws(':',{key},'{tag}')),1,8))::UBIGINT/4294967296.0e0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_MADE: dict[str, dict[str, DataFrame | None]] = {}


@contextmanager
def made_once(sf: str, *but: str) -> Iterator[None]:
    """Inside, the population and the window are made and written once and then read back.

    For plans that come back to them several times; a plan that reads them once is better off
    without, as its filters then reach the table itself.  ``but`` names what is not written.
    """
    outer = _MADE.get(sf)
    _MADE.setdefault(sf, dict.fromkeys(but))
    try:
        yield
    finally:
        if outer is None:
            del _MADE[sf]


def _view(name: str, sf: str, make: Callable[[], DataFrame]) -> DataFrame:
    views = _MADE.get(sf)
    if views is None:
        return make()
    if name not in views:
        views[name] = settle(make())
    return make() if views[name] is None else views[name]


_RID = "concat_ws(':',l_orderkey,l_linenumber,l_partkey,l_suppkey)"

# -- BED: the whole population; one row per object and month --------------------------------
_BED0 = [
    "cast(l_suppkey % 4 as bigint) as batch_id",
    "cast((year(l_shipdate)-1995)*12+month(l_shipdate)-1 as bigint) as step",
    "500e0+10e0*l_quantity as size_um",
    "l_discount", "l_tax",
    f"{_RID} as rid",
]
_BED1 = ["*", "20e0*(step+1)/83e0*(size_um/755e0)*(1e0+2e0*(l_discount-0.05e0)) as h_um"]
_BED2 = ["*", "size_um-2e0*h_um as core_um",
         "cast(case when {k}<0.03e0 then 1 else 0 end as bigint) as true_class"]


def bed(spark: SparkSession, sf: str) -> DataFrame:
    return _view("bed", sf, lambda: _bed(spark, sf))


def _bed(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "lineitem").selectExpr(*_BED0).selectExpr(*_BED1)
            .selectExpr(*[e.format(k=u_spark("k")) for e in _BED2]))


cte("bed0", f"SELECT {', '.join(_BED0)} FROM lineitem")
cte("bed1", f"SELECT {', '.join(_BED1)} FROM bed0")
cte("bed", f"SELECT {', '.join(e.format(k=u_duck('k')) for e in _BED2)} FROM bed1")

# -- WIN: the size-biased sample an instrument sees -----------------------------------------
_WIN1 = ["batch_id", "step", "60e0*(step+1) as t_s", "size_um", "h_um", "core_um", "true_class",
         "true_class as gate_class", "(true_class=0 and {a}>=0.05e0) as accepted", "rid",
         "l_discount", "l_tax"]
_WIN2 = ["*", "case when accepted then greatest(0e0, h_um+25e0*(l_tax-0.04e0)) end"
         " as thickness_um"]
_KEEP = "{w} < power(size_um/1000e0,3e0)"


def win(spark: SparkSession, sf: str) -> DataFrame:
    return _view("win", sf, lambda: _win(spark, sf))


def _win(spark: SparkSession, sf: str) -> DataFrame:
    return (bed(spark, sf).filter(_KEEP.format(w=u_spark("w")))
            .selectExpr(*[e.format(a=u_spark("a")) for e in _WIN1]).selectExpr(*_WIN2))


cte("win1", f"SELECT {', '.join(e.format(a=u_duck('a')) for e in _WIN1)} FROM bed "
            f"WHERE {_KEEP.format(w=u_duck('w'))}")
cte("win", f"SELECT {', '.join(_WIN2)} FROM win1")

# -- EV: an event stream of ten instruments --------------------------------------------------
_EV0 = ["event_id", "cast(user_id % 10 as bigint) as instrument", "{us} as us", "event_type",
        "value",
        "cast(case event_type when 'purchase' then 1 when 'view' then 2 else 0 end as bigint)"
        " as gate_class"]
_EV1 = ["*", "cast(floor((us-1704067200000000)/21600e6) as bigint) as step",
        "(gate_class=0 and event_type<>'error') as accepted"]


def ev(spark: SparkSession, sf: str) -> DataFrame:
    # the tables carry timestamps without zone; they mean UTC
    us = ("cast(datediff(cast(ts as date), date'1970-01-01') as bigint)*86400000000"
          "+(hour(ts)*3600+minute(ts)*60)*1000000L"
          "+cast(extract(second from ts)*1000000 as bigint)")
    return (table(spark, sf, "events").selectExpr(*[e.format(us=us) for e in _EV0])
            .selectExpr(*_EV1))


cte("ev0", f"SELECT {', '.join(e.format(us='epoch_us(ts)') for e in _EV0)} FROM events")
cte("ev", f"SELECT {', '.join(_EV1)} FROM ev0")

# -- FEAT: seven features per scan, each the sum of every seventh element of the whole vector -----
def feat(spark: SparkSession, sf: str) -> DataFrame:
    def part(i: int):
        return F.expr(f"aggregate(filter(embedding, (x, j) -> j % 7 = {i}), 0e0, "
                      f"(a, x) -> a + cast(x as double))")

    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("bigint").alias("label"),
        *[part(i).alias(f"f{i + 1}") for i in range(7)], (F.col("label") < 5).alias("baseline"))


cte("feat", "SELECT vec_id, label::BIGINT AS label, "
    + ", ".join(f"list_sum((embedding::DOUBLE[])[{i + 1}:len(embedding):7]) AS f{i + 1}"
                for i in range(7))
    + ", label < 5 AS baseline FROM embeddings")

# -- PRED: scored objects ---------------------------------------------------------------------
_PRED0 = [f"{_RID} as rid", "l_extendedprice", "l_orderkey",
          "cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as bigint) as truth"]
_PRED1 = ["*", "case when {p}<0.8e0 then truth else (truth+2)%3 end as predicted",
          "1e0-0.6e0*{c}*{c} as confidence", "{f} as fouling", "12e0+24e0*{s} as snr_db",
          "4e0+28e0*{t} as true_um", "1e0-0.18e0*{o}*{o} as solidity",
          "0.25e0*{d}*{d} as defect", "{g} as pigment"]
# own error structure: a skewed spread that grows with the square of fouling
_PRED2 = ["*", "(0.25e0+1.5e0*fouling*fouling)*(3e0*{e}*{e}-1e0) as error_um",
          "case when truth=2 then 'gated' when {u}<0.05e0+0.5e0*fouling*fouling"
          " then 'undecided' else 'measured' end as status"]


def _tags(u) -> dict[str, str]:
    return {t: u(t) for t in "pcfstodgeu"}


def pred(spark: SparkSession, sf: str) -> DataFrame:
    tags = _tags(u_spark)
    return (table(spark, sf, "lineitem").selectExpr(*_PRED0)
            .selectExpr(*[e.format(**tags) for e in _PRED1])
            .selectExpr(*[e.format(**tags) for e in _PRED2]))


cte("pred0", f"SELECT {', '.join(_PRED0)} FROM lineitem")
cte("pred1", f"SELECT {', '.join(e.format(**_tags(u_duck)) for e in _PRED1)} FROM pred0")
cte("pred", f"SELECT {', '.join(e.format(**_tags(u_duck)) for e in _PRED2)} FROM pred1")

# -- ASC: columns of a depth scan, one scan per part -------------------------------------------
_ASC0 = ["l_partkey as scan_id", f"{_RID} as rid", "10e0*(l_quantity-25.5e0) as x_um",
         "350e0+l_partkey%50 as radius_um", "l_tax", "l_discount",
         "1.48e0*(10e0+l_partkey%15) as optical_um", "15e0+5e0*(l_partkey%7) as snr_db",
         "l_discount < 0.1e0 as valid"]
_ASC1 = ["*", "250e0+radius_um-sqrt(radius_um*radius_um-x_um*x_um)+5e0*(l_tax-0.04e0)"
         " as outer_um"]
_ASC2 = ["*", "outer_um+optical_um as inner_um", "outer_um+{q} as found_outer",
         "outer_um+optical_um+{r} as found_inner"]


def asc(spark: SparkSession, sf: str) -> DataFrame:
    tags = {"q": u_spark("q"), "r": u_spark("r")}
    return (table(spark, sf, "lineitem").selectExpr(*_ASC0).selectExpr(*_ASC1)
            .selectExpr(*[e.format(**tags) for e in _ASC2]))


cte("asc0", f"SELECT {', '.join(_ASC0)} FROM lineitem")
cte("asc1", f"SELECT {', '.join(_ASC1)} FROM asc0")
cte("asc2", "SELECT " + ", ".join(e.format(q=u_duck("q"), r=u_duck("r")) for e in _ASC2)
    + " FROM asc1")

# -- LOG: append-only logs ----------------------------------------------------------------------
_LOG = ["conv_id as log_id", "turn+1 as seq", "role", "text"]


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(*_LOG)


cte("logs", f"SELECT {', '.join(_LOG)} FROM conversations")

# -- GRID: result cells ---------------------------------------------------------------------------
_GRID = ["case when o_orderstatus='F' then 0.5e0 else 0e0 end as gamma",
         "cast(o_custkey%5 as double) as m", "0.5e0*(o_orderkey%4) as k", "o_orderkey as seed",
         "o_orderpriority as scenario", "(o_totalprice-250000e0)/100000e0 as bias",
         "o_totalprice/20000e0 as below_pct", "o_totalprice > 300000e0 as stopped"]


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_GRID)


cte("grid", f"SELECT {', '.join(_GRID)} FROM orders")

# -- library of representative scans ---------------------------------------------------------------
_LIB = ["p_partkey as scan_id", "cast(p_size as double) as lib_thickness_um",
        "p_retailprice-300e0 as lib_size_um", "0.4e0*(p_partkey%3) as lib_fouling"]


def library(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*_LIB)


cte("library", f"SELECT {', '.join(_LIB)} FROM part")
