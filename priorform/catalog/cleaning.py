"""Typing, encoding, splits, checks, scalar functions, sorts, SQL text."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.catalog.registry import bigints, doubles, query, rounded
from priorform.functions.dates import day_number, first_words, season, season_text
from priorform.operators import cleaning, encoding
from priorform.operators.ordering import row_index, top_n
from priorform.sources.checks import apply_corrections, duplicate_keys
from priorform.sources.tables import Tables


@query(
    "clean_types",
    """
select event_id, cast(user_id as double) as user_id, cast(value as double) as value,
       try_cast(regexp_extract(props, '[0-9]+') as double) as k from events""",
)
def clean_types(t: Tables) -> DataFrame:
    """Columns cast to double, one of them from text."""
    rows = t.events.select("event_id", "user_id", "value", F.regexp_extract("props", "[0-9]+", 0).alias("k"))
    return cleaning.to_numeric(rows, ["user_id", "value", "k"])


@query(
    "blank_to_null",
    """
select o_orderkey, case when p in ('', 'None') then null else p end as priority
from (select o_orderkey, replace(replace(o_orderpriority, '4-NOT SPECIFIED', 'None'), '5-LOW', '') as p from orders)""",
)
def blank_to_null(t: Tables) -> DataFrame:
    """Unspecified and low priorities, written as None and blank, become NULL."""
    text = F.replace(F.replace(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"), F.lit("None")), F.lit("5-LOW"), F.lit(""))
    return cleaning.blank_to_null(t.orders.select("o_orderkey", text.alias("priority")), ["priority"])


@query(
    "season_column",
    """
select o_orderkey, cast(year(o_orderdate) as bigint) as season,
       split_part(cast(cast(o_orderdate as date) as varchar), '-', 1) as season_text from orders""",
)
def season_column(t: Tables) -> DataFrame:
    """Year of the order as number and as text."""
    out = t.orders.select(
        "o_orderkey", season("o_orderdate").alias("season"), season_text("o_orderdate").alias("season_text")
    )
    return bigints(out, "season")


@query(
    "drop_nulls",
    """
select doc_id, lang, quality, toxic from (
  select d.doc_id, lang, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id)
where quality is not null and toxic is not null""",
)
def drop_nulls(t: Tables) -> DataFrame:
    """Documents whose labels are known."""
    rows = t.documents.select("doc_id", "lang").join(t.labels, on="doc_id", how="left")
    return cleaning.drop_missing(rows, ["quality", "toxic"])


@query(
    "one_hot",
    """
select l_orderkey, l_partkey, l_linenumber, l_extendedprice, case when l_returnflag = 'N' then 1 else 0 end as flag_N,
       case when l_returnflag = 'R' then 1 else 0 end as flag_R, case when l_linestatus = 'O' then 1 else 0 end as status_O
from lineitem""",
)
def one_hot(t: Tables) -> DataFrame:
    """Flags as 0/1 columns without the first level."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    return encoding.one_hot(encoding.one_hot(rows, "l_returnflag", prefix="flag"), "l_linestatus", prefix="status")


@query(
    "label_encode",
    """
with first as (select p_brand, min(p_partkey) as f from part group by p_brand),
     code as (select p_brand, row_number() over (order by f, p_brand) - 1 as code from first),
     kind as (select p_type, dense_rank() over (order by p_type) - 1 as code from (select distinct p_type from part))
select p_partkey, part.p_brand, code.code as brand_code, kind.code as type_code
from part join code on code.p_brand = part.p_brand join kind on kind.p_type = part.p_type""",
)
def label_encode(t: Tables) -> DataFrame:
    """Brands coded by first appearance, types alphabetically."""
    rows = t.part.select("p_partkey", "p_brand", "p_type")
    by_first = encoding.label_encode(rows, "p_brand", order_by="p_partkey", name="brand_code")
    return encoding.label_encode(by_first, "p_type", name="type_code").drop("p_type")


_TYPE_COLUMNS = {
    "l_quantity": "lineitem", "l_linestatus": "lineitem", "l_returnflag": "lineitem", "l_linenumber": "lineitem",
}


@query(
    "classify_two_value",
    "\nunion all ".join(
        f"select '{c}' as \"column\", count(distinct {c}) <> 2 as continuous from {t}" for c, t in _TYPE_COLUMNS.items()
    ),
)
def classify_two_value(t: Tables) -> DataFrame:
    """Continuous unless a column has exactly two values."""
    found = cleaning.two_value_types(t.lineitem, list(_TYPE_COLUMNS))
    return t.spark.createDataFrame(list(found.items()), "column string, continuous boolean")


_CLASSIFY = ("c_acctbal", "c_nationkey", "c_mktsegment", "quality", "toxic", "number_text")
_CLASSIFY_ROWS = """(select c_acctbal, c_nationkey, c_mktsegment, quality, toxic, cast(c_nationkey as varchar) as number_text,
  c_mktsegment = 'BUILDING' as response from customer left join labels on doc_id = c_custkey)"""


@query(
    "classify_columns",
    "\nunion all ".join(
        f"""select '{c}' as "column", 'predictor' as role,
       case when count(*) filter (where {c} is not null and try_cast(cast({c} as varchar) as double) is null) > 0
              or count(distinct {c}) + max(case when {c} is null then 1 else 0 end) <= 2
            then 'categorical' else 'continuous' end as type from {_CLASSIFY_ROWS}"""
        for c in _CLASSIFY
    )
    + f"\nunion all select 'response', 'response', case when count(distinct response) = 2 then 'categorical' else 'continuous' end from {_CLASSIFY_ROWS}",
)
def classify_columns(t: Tables) -> DataFrame:
    """Types of predictors and response by their values, missing values counted as one."""
    rows = t.customer.join(t.labels, on=F.col("doc_id") == F.col("c_custkey"), how="left").select(
        "c_acctbal", "c_nationkey", "c_mktsegment", "quality", "toxic",
        F.col("c_nationkey").cast("string").alias("number_text"), (F.col("c_mktsegment") == "BUILDING").alias("response"),
    )
    return cleaning.column_type_table(rows, list(_CLASSIFY), "response")


@query(
    "truthy_response",
    """
select o_orderkey, cast(case when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 0 end as double) as response,
       case when o_orderstatus = 'F' then 1 else 0 end as number from orders""",
)
def truthy_response(t: Tables) -> DataFrame:
    """Yes/no words as 1/0, with a missing word left missing."""
    word = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "off")
    rows = t.orders.select("o_orderkey", word.alias("word"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("number"))
    return rows.select("o_orderkey", cleaning.numeric_response(rows, "word").alias("response"), "number")


@query(
    "derive_category",
    """
select c_custkey, cast(c_nationkey as varchar) as nation, case when c_acctbal > 0 then '1' else '0' end as positive from customer""",
)
def derive_category(t: Tables) -> DataFrame:
    """A number as class name, and a sign class."""
    return t.customer.select(
        "c_custkey", cleaning.as_category("c_nationkey").alias("nation"), cleaning.sign_category("c_acctbal").alias("positive")
    )


def _choice_sql(seed: int, options: int) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || o_orderkey), 1, 8) as bigint) % {options}"


@query(
    "random_columns",
    f"select o_orderkey, {_choice_sql(1, 2)} = 0 as test1, cast({_choice_sql(2, 2)} as int) as test2,"
    f" cast({_choice_sql(3, 100)} as int) as test3 from orders",
)
def random_columns(t: Tables) -> DataFrame:
    """Noise predictors that depend on the key and a seed only."""
    return t.orders.select(
        "o_orderkey",
        encoding.hashed_choice(["o_orderkey"], [True, False], seed=1).alias("test1"),
        encoding.hashed_choice(["o_orderkey"], [0, 1], seed=2).alias("test2"),
        encoding.hashed_choice(["o_orderkey"], list(range(100)), seed=3).alias("test3"),
    )


HOLDOUT = 2000


@query(
    "time_split",
    f"""
select o_orderkey, case when year(o_orderdate) = {HOLDOUT} then 'test' when year(o_orderdate) < {HOLDOUT} then 'train' end as split,
       case when year(o_orderdate) = {HOLDOUT} then 'test' else 'train' end as split_all from orders""",
)
def time_split(t: Tables) -> DataFrame:
    """Held-out season against the seasons before, or against all others."""
    return t.orders.select(
        "o_orderkey",
        encoding.split_label("o_orderdate", HOLDOUT).alias("split"),
        encoding.split_label("o_orderdate", HOLDOUT, "not_equal").alias("split_all"),
    )


@query(
    "nth_row_split",
    "select vec_id, label, case when (row_number() over (order by vec_id) - 1) % 10 = 0 then 1 else 0 end as is_test from embeddings",
)
def nth_row_split(t: Tables) -> DataFrame:
    """Every tenth row of an order marked as test row."""
    return encoding.nth_row_flag(t.embeddings.select("vec_id", "label"), ["vec_id"])


@query(
    "apply_corrections",
    """
select c_custkey, coalesce(o.total, c_acctbal) as c_acctbal, coalesce(o.segment, c_mktsegment) as c_mktsegment
from customer left join (select o_custkey, max(o_totalprice) as total,
       case when count(*) > 12 then 'FREQUENT' end as segment from orders where o_orderstatus = 'P' group by o_custkey) o
on o.o_custkey = c_custkey""",
)
def corrections(t: Tables) -> DataFrame:
    """Customer columns overwritten where a correction exists for the key."""
    pending = t.orders.where(F.col("o_orderstatus") == "P")
    fixes = pending.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal"),
        F.when(F.count(F.lit(1)) > 12, F.lit("FREQUENT")).alias("c_mktsegment"),
    )
    rows = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    return apply_corrections(rows, fixes, ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query(
    "duplicate_keys",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
)
def duplicates(t: Tables) -> DataFrame:
    """Line keys that occur more than once."""
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "scalar_text",
    """
select doc_id, array_to_string(string_split(text, ' ')[1:2], ' ') as two_words, length(text) as n_text,
       case when lower(lang) in ('en', 'de') then 1 else 0 end as germanic from documents""",
)
def scalar_text(t: Tables) -> DataFrame:
    """Text functions over whole documents."""
    out = t.documents.select(
        "doc_id",
        first_words("text", 2).alias("two_words"),
        F.length("text").alias("n_text"),
        F.when(F.lower("lang").isin("en", "de"), 1).otherwise(0).alias("germanic"),
    )
    return bigints(out, "n_text")


@query(
    "scalar_date",
    """
select o_orderkey, cast(o_orderdate as date) as day, cast(year(o_orderdate) as bigint) as year,
       cast(datediff('day', date '1995-01-01', o_orderdate) as bigint) as days_since,
       cast(cast(o_orderdate as date) - interval 100 day as date) as hundred_before,
       cast(datediff('day', date '1970-01-01', o_orderdate) as bigint) as day_number from orders""",
)
def scalar_date(t: Tables) -> DataFrame:
    """Date functions."""
    out = t.orders.select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("day"),
        F.year("o_orderdate").alias("year"),
        F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("days_since"),
        F.date_add(F.to_date("o_orderdate"), -100).alias("hundred_before"),
        day_number("o_orderdate").alias("day_number"),
    )
    return bigints(out, "year", "days_since", "day_number")


@query(
    "scalar_math",
    """
select event_id, round(abs(value - 50), 6) + 0.0 as off, round(sqrt(abs(value)), 6) as root, round(value * value, 6) as square,
       round(value / nullif(value, 0), 6) as one, -value as negated from events""",
)
def scalar_math(t: Tables) -> DataFrame:
    """Arithmetic, with a NULL for a division by zero."""
    v = F.col("value")
    out = t.events.select(
        "event_id", F.abs(v - 50).alias("off"), F.sqrt(F.abs(v)).alias("root"), (v * v).alias("square"),
        (v / F.nullif(v, F.lit(0.0))).alias("one"), (-v).alias("negated"),
    )
    return rounded(out, "off", "root", "square", "one")


@query(
    "sort_multi",
    """
select o_custkey, o_orderkey, o_orderdate, row_number() over (order by o_custkey, o_orderdate desc, o_orderkey) as position from orders""",
)
def sort_multi(t: Tables) -> DataFrame:
    """Customer ascending, date descending; the position proves the order."""
    days = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", (-day_number("o_orderdate")).alias("back"))
    out = row_index(days, ["o_custkey", "back", "o_orderkey"], "position").drop("back")
    return out.orderBy(F.asc("o_custkey"), F.desc("o_orderdate"), F.asc("o_orderkey"))


@query(
    "top_n",
    "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
)
def top(t: Tables) -> DataFrame:
    """The twenty dearest orders."""
    return top_n(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")])


_VIEW_SQL = """
select c_mktsegment as segment, year(o_orderdate) as year, count(*) as n,
       cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
from {rows} group by c_mktsegment, year(o_orderdate)"""


@query(
    "sql_transform",
    """
select c_mktsegment as segment, cast(year(o_orderdate) as bigint) as year, count(*) as n,
       cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
from orders join customer on c_custkey = o_custkey group by c_mktsegment, year(o_orderdate)""",
)
def sql_transform(t: Tables) -> DataFrame:
    """SQL text over named frames, then an SQL statement as a pipeline stage."""
    joined = t.spark.sql(
        "select * from {orders} join {customer} on c_custkey = o_custkey", orders=t.orders, customer=t.customer
    )
    stage = SQLTransformer(statement=_VIEW_SQL.replace("{rows}", "__THIS__"))
    return doubles(bigints(stage.transform(joined), "year"), "total")
