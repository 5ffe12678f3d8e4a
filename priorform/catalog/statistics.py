"""Association, binned response and ranked tables. The SQL twins use the textbook forms."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.catalog.registry import ORACLES, query, rounded
from priorform.operators import association, binned, report
from priorform.sources.datasets import DatasetRegistry, DatasetSpec
from priorform.sources.sinks import stage
from priorform.sources.tables import Tables

CATS = ("l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment")
CONTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal")
SMALL = 1e9  # squared differences over counts are tiny; they are compared in billionths


def _facts(t: Tables) -> DataFrame:
    """Lines with their order and customer and whether the order is filled."""
    lines = t.lineitem.select("l_orderkey", *[c for c in (*CATS, *CONTS) if c.startswith("l_")])
    orders = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("filled"),
    )
    customer = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return lines.join(orders, on="l_orderkey").join(customer, on="o_custkey")


DATASETS = DatasetRegistry(
    (
        DatasetSpec("lines", _facts, (*CATS, *CONTS), "filled"),
        DatasetSpec("customers", lambda t: t.customer, ("c_nationkey", "c_acctbal"), "c_mktsegment"),
    )
)
FACTS_SQL = """facts as (
  select l_returnflag, l_linestatus, o_orderpriority, c_mktsegment, l_quantity, l_extendedprice, l_discount, l_tax,
         o_totalprice, c_acctbal, case when o_orderstatus = 'F' then 1 else 0 end as filled
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
)"""


# --- SQL pieces ----------------------------------------------------------------------------


def nominal_sql(table: str, x: str, y: str, *, bias: bool = True, tschuprow: bool = False) -> str:
    """The statistic of two columns as a scalar, from the dense table of expected counts."""
    diff = "abs(coalesce(o, 0) - r * c / n)"
    if not bias:
        diff = f"(case when rn = 2 and cn = 2 then greatest({diff} - 0.5, 0.0) else {diff} end)"
    if bias:
        phi2 = "greatest(0.0, chi2 / n - (rn - 1) * (cn - 1) / (n - 1))"
        rc, cc = "(rn - (rn - 1) * (rn - 1) / (n - 1))", "(cn - (cn - 1) * (cn - 1) / (n - 1))"
    else:
        phi2, rc, cc = "chi2 / n", "rn", "cn"
    den = f"sqrt(({rc} - 1) * ({cc} - 1))" if tschuprow else f"least({rc} - 1, {cc} - 1)"
    return f"""(select round(sqrt({phi2} / nullif({den}, 0)), 6) + 0.0 from (
  select sum({diff} * {diff} / (r * c / n)) as chi2, max(n) as n, max(rn) as rn, max(cn) as cn from (
    select rs.*, cs.*, o, (select cast(count(*) as double) from {table}) as n,
           (select cast(count(distinct {x}) as double) from {table}) as rn, (select cast(count(distinct {y}) as double) from {table}) as cn
    from (select {x} as a, cast(count(*) as double) as r from {table} group by 1) rs
    cross join (select {y} as b, cast(count(*) as double) as c from {table} group by 1) cs
    left join (select {x} as a, {y} as b, cast(count(*) as double) as o from {table} group by 1, 2) os on os.a = rs.a and os.b = cs.b)))"""


def eta_sql(table: str, cat: str, cont: str) -> str:
    return f"""(select round(sqrt(sum(n * (m - mu) * (m - mu)) / max(total)), 6) + 0.0 from (
  select count(*) as n, avg({cont}) as m, (select avg({cont}) from {table}) as mu,
         (select sum(power({cont} - (select avg({cont}) from {table}), 2)) from {table}) as total
  from {table} group by {cat}))"""


def t_sql(table: str, x: str, y: str) -> str:
    """Slope over its standard error."""
    return (
        f"(select round(s / sqrt((syy - s * sxy) / (n - 2) / sxx), 6) + 0.0 from (select regr_slope({y}, {x}) as s,"
        f" regr_syy({y}, {x}) as syy, regr_sxy({y}, {x}) as sxy, regr_sxx({y}, {x}) as sxx, regr_count({y}, {x}) as n from {table}))"
    )


def edges_sql(table: str, column: str, name: str) -> str:
    """Constants e1..e10 by repeated addition."""
    steps = ",\n".join(
        f"  {name}{i} as (select e{i - 1} + step as e{i}, * from {name}{i - 1})" for i in range(2, 11)
    )
    return (
        f"{name}1 as (select min({column}) as e1, (max({column}) - min({column})) / 10 as step from {table}),\n{steps}"
    )


def bin_sql(column: str, alias: str) -> str:
    return "(1" + "".join(f" + case when {column} >= {alias}.e{i} then 1 else 0 end" for i in range(2, 11)) + ")"


def cells_sql(table: str, x: str, y: str, kinds: tuple[str, str], response: str) -> tuple[str, str]:
    """(CTEs, body) of the cells (a, b, n, m) of two predictors."""
    ctes, exprs, sources = [], [], [table]
    for c, kind, name in ((x, kinds[0], "ex"), (y, kinds[1], "ey")):
        if kind == "cont":
            ctes.append(edges_sql(table, c, name))
            sources.append(f"{name}10")
            exprs.append(bin_sql(c, f"{name}10"))
        else:
            exprs.append(c)
    body = (
        f"select {exprs[0]} as a, {exprs[1]} as b, count(*) as n, avg({response}) as m,"
        f" (select avg({response}) from {table}) as mu, (select count(*) from {table}) as total"
        f" from {' cross join '.join(sources)} group by 1, 2"
    )
    return ",\n".join(ctes), body


def dmr_2d_sql(table: str, x: str, y: str, kinds: tuple[str, str], response: str) -> str:
    ctes, body = cells_sql(table, x, y, kinds, response)
    head = f"with {ctes}\n" if ctes else ""
    d = "(m - mu) * (m - mu) / n"
    return (
        f"(select {{'dmr': round(avg({d}) * {SMALL:.0f}, 6), 'wdmr': round(avg({d} * n / total) * {SMALL:.0f}, 6)}}"
        f" from ({head}{body}))"
    )


def _union(parts: list[str], head: str = "") -> str:
    return head + "\nunion all ".join(parts)


# --- association -----------------------------------------------------------------------------

_BANDS_SQL = """bands as (select *, case when l_tax > 0.03 and l_returnflag = 'R' then 'high' else 'low' end as band,
  case when l_discount > 0.04 or l_linestatus = 'O' then 1 else 0 end as cut from lineitem)"""
_NOMINAL = (("l_returnflag", "band"), ("l_tax", "band"), ("l_linestatus", "cut"), ("l_returnflag", "l_linestatus"))


def _bands(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_returnflag", "l_tax", "l_linestatus",
        F.when((F.col("l_tax") > 0.03) & (F.col("l_returnflag") == "R"), "high").otherwise("low").alias("band"),
        F.when((F.col("l_discount") > 0.04) | (F.col("l_linestatus") == "O"), 1).otherwise(0).alias("cut"),
    )


def _nominal(t: Tables, **options) -> DataFrame:
    rows, out = _bands(t), None
    for x, y in _NOMINAL:
        one = association.cramers_v(rows, x, y, **options)
        out = one if out is None else out.unionByName(one)
    return rounded(out, "corr")


def _nominal_query(**options) -> str:
    return _union(
        [f"select '{x}' as x, '{y}' as y, {nominal_sql('bands', x, y, **options)} as corr" for x, y in _NOMINAL],
        f"with {_BANDS_SQL}\n",
    )


@query("cramers_v", _nominal_query())
def cramers_v(t: Tables) -> DataFrame:
    """Bias-corrected Cramer's V of pairs of categories."""
    return _nominal(t)


@query("tschuprow_t", _nominal_query(tschuprow=True))
def tschuprow_t(t: Tables) -> DataFrame:
    """Bias-corrected Tschuprow's T."""
    return _nominal(t, tschuprow=True)


@query("cramers_v_uncorrected", _nominal_query(bias=False))
def cramers_v_uncorrected(t: Tables) -> DataFrame:
    """Cramer's V without correction; two by two tables with the Yates correction."""
    return _nominal(t, bias_correction=False)


@query(
    "correlation_ratio",
    _union(
        [
            f"select '{c}' as cat, '{v}' as cont, {eta_sql('lineitem', c, v)} as corr"
            for c in ("l_returnflag", "l_linenumber")
            for v in ("l_quantity", "l_extendedprice")
        ]
    ),
)
def correlation_ratio(t: Tables) -> DataFrame:
    """Correlation ratio of categories with numbers."""
    out = association.correlation_ratios(t.lineitem, ["l_returnflag", "l_linenumber"], ["l_quantity", "l_extendedprice"])
    return rounded(out, "corr")


_OLS = (("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"))


@query(
    "pearson_ols",
    _union(
        [
            f"select '{x}' as x, '{y}' as y, count(*) as n, round(corr({x}, {y}), 6) as corr, round(regr_slope({y}, {x}), 6) as slope,"
            f" {t_sql('lineitem', x, y)} as t from lineitem"
            for x, y in _OLS
        ]
    ),
)
def pearson_ols(t: Tables) -> DataFrame:
    """Pearson's r and the slope test of simple regressions."""
    out = association.pearson_pairs(t.lineitem, _OLS)
    return rounded(out, "corr", "slope", "t")


# two-sided p of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(dof)
_P_PARTS = 20_000
_P_SQL = f"""select x, y, n, corr, slope, t,
       round(2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * wide / (3 * {_P_PARTS})
             * sum(case when i in (0, {_P_PARTS}) then 1 when i % 2 = 1 then 4 else 2 end * exp((dof - 1) * ln(cos(low + wide * i / {_P_PARTS})))), 9) + 0.0 as p
from (select *, least(pi() / 2 - 1e-12 - low, 40 / sqrt(dof)) as wide
      from (select *, n - 2.0::double as dof, atan(abs(t) / sqrt(n - 2.0::double)) as low from slopes)), range(0, {_P_PARTS} + 1) as parts(i)
group by x, y, n, corr, slope, t, dof, low, wide"""


@query("ols_pvalue", f"with slopes as ({ORACLES['pearson_ols']})\n{_P_SQL}")
def ols_pvalue(t: Tables) -> DataFrame:
    """The same with p-values."""
    return rounded(association.with_p_values(association.pearson_pairs(t.lineitem, _OLS)), "corr", "slope", "t").withColumn("p", F.round("p", 9))


@query("logit_z")
def logit_z(t: Tables) -> DataFrame:
    """Logistic slope of a 0/1 flag on a number, no intercept."""
    rows = t.lineitem.select(F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("open"), "l_discount")
    return association.logit_slope(rows, "open", "l_discount")


NEWTON_STEPS = 12  # of the SQL twins; slopes settle after about six


def newton_sql(rows: str) -> str:
    """Slopes, errors and z of ``rows`` (name, x, y) by Newton steps for all names together, as (name, n, b, se)."""
    share = "(1 / (1 + exp(-b * x)))"
    ctes = ["n0 as materialized (select distinct name, 0.0::double as b from pairs)"]
    for i in range(NEWTON_STEPS):
        ctes.append(f"n{i + 1} as materialized (select name, any_value(b) + sum(x * (y - {share})) / sum(x * x * {share} * (1 - {share})) as b from pairs join n{i} using (name) group by name)")
    return (
        f"pairs as materialized ({rows}),\n" + ",\n".join(ctes)
        + f",\nslopes as (select name, count(*) as n, any_value(b) as b, 1 / sqrt(sum(x * x * {share} * (1 - {share}))) as se from pairs join n{NEWTON_STEPS} using (name) group by name)"
    )


def slopes_table(df: DataFrame) -> DataFrame:
    """What two engines agree on: slopes in standard errors, and errors in thousandths of a slope's unit."""
    return rounded(rounded(df, "z"), "b", "se", scale=1e3).select("name", "n", "b", "se", "z")


SLOPES_SQL = "select name, n, round(b * 1e3, 6) + 0.0 as b, round(se * 1e3, 6) + 0.0 as se, round(b / se, 6) + 0.0 as z from slopes"


@query(
    "logit_z_all",
    "with " + newton_sql(" union all ".join(
        f"select '{c}' as name, cast({c} as double) as x, case when l_linestatus = 'O' then 1.0::double else 0.0::double end as y from lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    )) + SLOPES_SQL.join(["\n", ""]),
)
def logit_z_all(t: Tables) -> DataFrame:
    """Logistic slopes of a flag on every number of a line, by Newton steps for all of them together."""
    rows = t.lineitem.withColumn("open", F.when(F.col("l_linestatus") == "O", 1).otherwise(0))
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    return slopes_table(association.logit_slopes(rows, [(c, "open", c) for c in names]))


_MATRIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "corr_matrix",
    _union(
        [
            f"select '{a}' as p1, '{b}' as p2, round(abs(corr({a}, {b})), 6) as value from lineitem"
            for a in _MATRIX for b in _MATRIX
        ]
    ),
)
def corr_matrix(t: Tables) -> DataFrame:
    """Absolute correlations of all numbers."""
    return rounded(association.correlation_matrix(t.lineitem, _MATRIX), "value")


# --- binned response, one dimension ------------------------------------------------------------

def _y():
    return F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)


_Y_SQL = "case when l_linestatus = 'O' then 1.0::double else 0.0::double end"
_ONE_D = ("l_quantity", "l_extendedprice", "l_discount")


def _bins_1d_sql(c: str) -> str:
    d = "(m - mu) * (m - mu) / n"
    return f"""select '{c}' as predictor, cast(g.b - 1 as int) as bin, coalesce(lo, edge) as lower, coalesce(hi, edge + stp) as upper,
  (edge + stp) / 2 + edge as center, coalesce(n, 0) as n, round(m, 6) as mean, round(mu, 6) as pop_mean,
  round({d} * {SMALL:.0f}, 6) as msd, round(coalesce(n, 0) / cast(total as double), 6) as share,
  round({d} * n / total * {SMALL:.0f}, 6) as msd_weighted
from (with {edges_sql('lineitem', c, 'ed')} select unnest([{', '.join(str(i) for i in range(1, 11))}]) as b,
        unnest([{', '.join(f'e{i}' for i in range(1, 11))}]) as edge,
        unnest([{', '.join(['step'] * 9 + ["'inf'::double"])}]) as stp from ed10) g
left join (with {edges_sql('lineitem', c, 'ed')} select {bin_sql(c, 'ed10')} as b, min({c}) as lo, max({c}) as hi, count(*) as n,
        avg({_Y_SQL}) as m from lineitem cross join ed10 group by 1) cells on cells.b = g.b
cross join (select avg({_Y_SQL}) as mu, count(*) as total from lineitem) pop"""


def _dmr_1d(t: Tables) -> tuple[DataFrame, DataFrame]:
    return binned.dmr_1d(t.lineitem, [], _ONE_D, _y())


@query("dmr_1d_cont_bins", _union([_bins_1d_sql(c) for c in _ONE_D]))
def dmr_1d_cont_bins(t: Tables) -> DataFrame:
    """Ten equal-width bins of numbers with their mean response."""
    bins = _dmr_1d(t)[0].drop("level")
    return rounded(rounded(bins, "mean", "pop_mean", "share"), "msd", "msd_weighted", scale=SMALL)


def _summary_1d_sql(c: str, key: str, head: str, source: str) -> str:
    return f"""select '{c}' as predictor, round(avg((m - mu) * (m - mu) / n) * {SMALL:.0f}, 6) as dmr,
  round(avg((m - mu) * (m - mu) / n * n / total) * {SMALL:.0f}, 6) as wdmr
from ({head} select {key} as b, count(*) as n, avg({_Y_SQL}) as m from {source} group by 1)
cross join (select avg({_Y_SQL}) as mu, count(*) as total from lineitem)"""


@query(
    "dmr_1d_cont",
    _union(
        [
            _summary_1d_sql(c, bin_sql(c, "ed10"), f"with {edges_sql('lineitem', c, 'ed')}", "lineitem cross join ed10")
            for c in _ONE_D
        ]
    ),
)
def dmr_1d_cont(t: Tables) -> DataFrame:
    """Averages over the ten bins of each number."""
    return rounded(_dmr_1d(t)[1], "dmr", "wdmr", scale=SMALL)


@query("dmr_1d_cat", _union([_summary_1d_sql(c, c, "", "lineitem") for c in ("l_returnflag", "l_linenumber")]))
def dmr_1d_cat(t: Tables) -> DataFrame:
    """Averages over the levels of each category."""
    rows = t.lineitem.withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    return rounded(binned.dmr_1d(rows, ["l_returnflag", "l_linenumber"], [], _y())[1], "dmr", "wdmr", scale=SMALL)


def _adaptive_sql(c: str) -> str:
    """Ten chained bins, each starting at the largest value of the one before."""
    ctes = [f"s0 as (select min({c}) as lo, (max({c}) - min({c})) / 10 as step from lineitem)"]
    for i in range(1, 10):
        ctes.append(
            f"s{i} as (select coalesce((select max({c}) from lineitem where {c} >= p.lo and {c} < p.lo + p.step), p.lo + p.step) as lo,"
            f" p.step from s{i - 1} p)"
        )
    bins = "\n  union all ".join(
        f"select {i} as bin, count(*) as n, avg({_Y_SQL}) as m, min({c}) as bmin, max({c}) as bmax"
        f" from lineitem cross join s{i} p where {c} >= p.lo" + (f" and {c} < p.lo + p.step" if i < 9 else "")
        for i in range(10)
    )
    return f"""select '{c}' as predictor, bin, n, bmin as lower, bmax as upper, (bmax - bmin) / 2 + bmin as center,
  round((m - mu) * (m - mu) / n * {SMALL:.0f}, 6) as msd,
  round((m - mu) * (m - mu) / n / (n / cast(total as double)) * {SMALL:.0f}, 6) as msd_weighted
from (with {', '.join(ctes)} {bins}) cross join (select avg({_Y_SQL}) as mu, count(*) as total from lineitem)"""


@query("dmr_1d_adaptive", _union([_adaptive_sql(c) for c in ("l_extendedprice", "l_quantity")]))
def dmr_1d_adaptive(t: Tables) -> DataFrame:
    """Bins that start at the last value of the bin before, shared boundary rows counted twice."""
    bins, _ = binned.dmr_1d_adaptive(t.lineitem, ["l_extendedprice", "l_quantity"], _y())
    out = bins.select("predictor", "bin", "n", "lower", "upper", "center", "msd", "msd_weighted")
    return rounded(out, "msd", "msd_weighted", scale=SMALL)


# --- binned response, two dimensions -------------------------------------------------------------


def _dmr_2d_query(pairs, kinds) -> str:
    return _union(
        [
            f"select '{x}' as x, '{y}' as y, d.dmr as dmr, d.wdmr as wdmr from (select {dmr_2d_sql('facts', x, y, (kinds[x], kinds[y]), 'filled')} as d)"
            for x, y in pairs
        ],
        f"with {FACTS_SQL}\n",
    )


KINDS = {**{c: "cat" for c in CATS}, **{c: "cont" for c in CONTS}}
_CAT_PAIRS = list(combinations(CATS, 2))
_MIXED = list(product(CATS, CONTS))
_CONT_PAIRS = list(combinations(CONTS, 2))


def _dmr_2d(t: Tables, pairs) -> DataFrame:
    kinds = {c: KINDS[c] for p in pairs for c in p}
    return rounded(binned.dmr_2d(stage(_facts(t)), pairs, kinds, "filled"), "dmr", "wdmr", scale=SMALL)


@query("dmr_2d_cat_cat", _dmr_2d_query(_CAT_PAIRS, KINDS))
def dmr_2d_cat_cat(t: Tables) -> DataFrame:
    """Two categories against the response."""
    return _dmr_2d(t, _CAT_PAIRS)


@query("dmr_2d_cat_cont", _dmr_2d_query(_MIXED, KINDS))
def dmr_2d_cat_cont(t: Tables) -> DataFrame:
    """A category and a binned number."""
    return _dmr_2d(t, _MIXED)


@query("dmr_2d_cont_cont", _dmr_2d_query(_CONT_PAIRS, KINDS))
def dmr_2d_cont_cont(t: Tables) -> DataFrame:
    """Two binned numbers."""
    return _dmr_2d(t, _CONT_PAIRS)


def _dense_sql(x: str, y: str) -> str:
    ctes, body = cells_sql("lineitem", x, y, ("cat", "cont"), _Y_SQL)
    return f"""select g.a, cast(g.b as varchar) as b, coalesce(c.n, 0) as n, round(c.m, 6) as mean, round(coalesce(c.n / cast(c.total as double), 0.0), 6) as share
from (select a, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) as b from (select distinct {x} as a from lineitem)) g
left join (with {ctes} {body}) c on c.a = g.a and c.b = g.b"""


@query("dmr_2d_cells", _dense_sql("l_returnflag", "l_discount"))
def dmr_2d_cells(t: Tables) -> DataFrame:
    """Mean response and share of every cell, also the empty ones."""
    kinds = {"l_returnflag": "cat", "l_discount": "cont"}
    return rounded(binned.dense_cells(t.lineitem, "l_returnflag", "l_discount", kinds, _y()), "mean", "share")


# --- ranked tables ---------------------------------------------------------------------------------


def _analysis(t: Tables) -> report.Analysis:
    data = DATASETS.choose("lines")
    rows = stage(data.load(t.spark, t.folder))
    return report.Analysis(rows, data.predictors, data.response, list(CATS), list(CONTS), True)


def _pair_table_sql(pairs, types, corr, extra: str = "") -> str:
    parts = [
        f"select '{x}' as predictor_1, '{y}' as predictor_2, '{types[0]}' as type_1, '{types[1]}' as type_2, corr, abs(corr) as abs_corr,"
        f" {extra.format(t=t_sql('facts', x, y)) if extra else ''} d.dmr as dmr, d.wdmr as wdmr"
        f" from (select {corr(x, y)} as corr, {dmr_2d_sql('facts', x, y, (KINDS[x], KINDS[y]), 'filled')} as d)"
        for x, y in pairs
    ]
    return _union(parts, f"with {FACTS_SQL}\n")


def _table(df: DataFrame, *more: str) -> DataFrame:
    return rounded(rounded(df, "corr", "abs_corr", *more), "dmr", "wdmr", scale=SMALL)


@query(
    "pair_table_cat_cat",
    _pair_table_sql(_CAT_PAIRS, (report.CAT, report.CAT), lambda x, y: nominal_sql("facts", x, y)),
)
def pair_table_cat_cat(t: Tables) -> DataFrame:
    """All pairs of categories: Cramer's V and DMR."""
    return _table(report.cat_cat_table(_analysis(t)))


@query(
    "pair_table_cat_cont",
    _pair_table_sql(_MIXED, (report.CAT, report.CONT), lambda x, y: eta_sql("facts", x, y)),
)
def pair_table_cat_cont(t: Tables) -> DataFrame:
    """All categories with all numbers: correlation ratio and DMR."""
    return _table(report.cat_cont_table(_analysis(t)))


@query(
    "pair_table_cont_cont",
    _pair_table_sql(
        _CONT_PAIRS, (report.CONT, report.CONT),
        lambda x, y: f"(select round(corr({x}, {y}), 6) + 0.0 from facts)", "{t} as t,",
    ),
)
def pair_table_cont_cont(t: Tables) -> DataFrame:
    """All pairs of numbers: Pearson, slope test and DMR."""
    return _table(report.cont_cont_table(_analysis(t), p_values=False), "t")


def _rank_sql() -> str:
    parts = []
    pop = "(select avg(filled) as mu, count(*) as total from facts)"
    d = "(m - mu) * (m - mu) / n"
    figures = f"round(avg({d}) * {SMALL:.0f}, 6) as dmr, round(avg({d} * n / total) * {SMALL:.0f}, 6) as wdmr"
    for c in CONTS:
        parts.append(f"""select 'filled' as response, '{c}' as predictor, 'continuous' as predictor_type, 'categorical' as response_type,
  (select min({c}) from facts) as min, (select round(median({c}), 6) from facts) as median, (select max({c}) from facts) as max,
  {eta_sql('facts', 'filled', c)} as corr, 'Correlation Ratio' as corr_type, {figures}
from (with {edges_sql('facts', c, 'ed')} select {bin_sql(c, 'ed10')} as b, count(*) as n, avg(filled) as m from facts cross join ed10 group by 1) cross join {pop}""")
    for c in CATS:
        parts.append(f"""select 'filled' as response, '{c}' as predictor, 'categorical' as predictor_type, 'categorical' as response_type,
  null::double as min, null::double as median, null::double as max, {nominal_sql('facts', c, 'filled')} as corr, 'Cramer''s V' as corr_type, {figures}
from (select {c} as b, count(*) as n, avg(filled) as m from facts group by 1) cross join {pop}""")
    return _union(parts, f"with {FACTS_SQL}\n")


@query("rank_predictors", _rank_sql())
def rank_predictors(t: Tables) -> DataFrame:
    """Every predictor against the response, ranked by weighted DMR."""
    out = report.response_table(_analysis(t), importance=False)
    return rounded(rounded(out, "median", "corr"), "dmr", "wdmr", scale=SMALL)


@query("screen_predictors")
def screen_predictors(t: Tables) -> DataFrame:
    """First-look table with slope tests, adaptive DMR and forest importance."""
    rows = _facts(t).select("l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "filled")
    return report.screen_predictors(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"], "filled")
