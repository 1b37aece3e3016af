"""

``entry(spark)`` runs the flagship query (numeric summary of ``lineitem``) on
sf0.001. ``queries()`` maps every implemented operator to a callable
``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` holds the DuckDB SQL for
each one that SQL can express. Floating-point outputs are rounded to 6 dp on
both sides so that last-bit differences between engines do not matter.

Derived inputs (missing values, duplicates, rule predictions) are written
once as SQL expressions and used verbatim by Spark (``selectExpr``) and by
the oracle, so both sides compute over exactly the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import insights as IN
from tabforge.functions import metrics as ME
from tabforge.operators import balance as BA
from tabforge.operators import clean as CL
from tabforge.operators import encode as EN
from tabforge.operators import neighbours as NB
from tabforge.operators import profile as P
from tabforge.operators import scale as SC
from tabforge.operators import smote as SM
from tabforge.operators import split as SP
from tabforge.plans import training as TR
from tabforge.plans import workflow as WF
from tabforge.session import ensure_checkpoint_dir
from tabforge.sources import csv as CSV
from tabforge.sources import store as ST
from tabforge.sources.tables import TABLES, load_table

SF_SMOKE = "/root/testdata/sf0.001"
ND = 6  # decimals kept for floating-point comparison

# ------------------------------------------------------------------ derived inputs

LINEITEM_DIRTY = [
    "l_orderkey", "l_partkey", "l_linenumber",
    "case when l_orderkey % 7 = 0 then null else l_quantity end as qty",
    "l_extendedprice",
    "case when l_linenumber = 1 then null else l_discount end as discount",
    "l_tax",
    "case when l_orderkey % 5 < 3 then null else l_returnflag end as returnflag",
    "l_linestatus", "l_shipdate",
]
ORDERS_DIRTY = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
    "case when o_orderkey % 5 = 0 then null else o_orderpriority end as prio",
    "o_orderdate",
]
LINEITEM_SCALE = [
    "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "case when l_discount > 0.05 then 1 else 0 end as flag",
    "cast(5.0 as double) as k",
]
FLAG_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]
# deterministic rule predictions, so metric operators are checked without a model
LINEITEM_RULE = [
    "l_orderkey", "l_linenumber",
    "case when l_returnflag = 'R' then 1 else 0 end as label",
    "case when l_discount > 0.05 then 1 else 0 end as prediction",
    "l_discount as score",
    "l_orderkey % 5 as fold",
    "l_returnflag",
    "case when l_discount > 0.06 then 'R' when l_tax > 0.04 then 'A' else 'N' end as mc_prediction",
    "l_tax as score_a", "1.0 - l_discount as score_n", "l_discount as score_r",
    "l_extendedprice", "l_quantity * 1500.0 as price_pred",
]

DERIVED = {
    "lineitem_dirty": ("lineitem", LINEITEM_DIRTY),
    "orders_dirty": ("orders", ORDERS_DIRTY),
    "lineitem_scale": ("lineitem", LINEITEM_SCALE),
    "lineitem_flags": ("lineitem", FLAG_COLS),
    "lineitem_rule": ("lineitem", LINEITEM_RULE),
}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in DERIVED:
        base, exprs = DERIVED[name]
        return load_table(spark, sf, base).selectExpr(*exprs)
    return load_table(spark, sf, name)


def _sql_from(name: str) -> str:
    """FROM-clause text for a table or derived input in DuckDB."""
    if name in DERIVED:
        base, exprs = DERIVED[name]
        return f"(select {', '.join(exprs)} from {base}) as {name}"
    return name


def _round(df: DataFrame, nd: int = ND) -> DataFrame:
    """Round double columns; ``+ 0.0`` folds a negative zero into zero (the
    oracle SQL does the same, see ``_fold_negative_zero``)."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), nd) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def _fold_negative_zero(sql: str) -> str:
    """Rewrite every ``round(...)`` call as ``(round(...) + 0.0)``: DuckDB
    rounds a tiny negative double to -0.0 where Spark gives 0.0; both are
    zero. Text inside quotes is left alone."""
    out, i, n, quote = [], 0, len(sql), None
    while i < n:
        ch = sql[i]
        if quote:
            out.append(ch)
            quote = None if ch == quote else quote
            i += 1
            continue
        if ch in "'\"":
            quote = ch
            out.append(ch)
            i += 1
            continue
        if sql.startswith("round(", i) and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_")):
            depth, k, q2 = 0, i + 5, None
            while k < n:
                c2 = sql[k]
                if q2:
                    q2 = None if c2 == q2 else q2
                elif c2 in "'\"":
                    q2 = c2
                elif c2 == "(":
                    depth += 1
                elif c2 == ")":
                    depth -= 1
                    if depth == 0:
                        break
                k += 1
            out.append("(round(" + _fold_negative_zero(sql[i + 6:k]) + ") + 0.0)")
            i = k + 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def _qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


# column lists of the fixture tables (as read from the parquet schemas)
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]
LINEITEM_NUM = LINEITEM_COLS[:8]
DIRTY_COLS = ["l_orderkey", "l_partkey", "l_linenumber", "qty", "l_extendedprice", "discount",
              "l_tax", "returnflag", "l_linestatus", "l_shipdate"]
DIRTY_NUM = DIRTY_COLS[:7]
DIRTY_INTEGRAL = {"l_orderkey", "l_partkey", "l_linenumber"}
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "prio", "o_orderdate"]
SCALE_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "flag", "k"]

_DUCK_TO_SPARK = ("case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' "
                  "when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' "
                  "when 'TIMESTAMP' then 'timestamp_ntz' when 'TIMESTAMP WITH TIME ZONE' then 'timestamp' when 'FLOAT' then 'float' "
                  "when 'SMALLINT' then 'smallint' when 'TINYINT' then 'tinyint' "
                  "when 'BOOLEAN' then 'boolean' when 'DATE' then 'date' else lower(data_type) end")
_DUCK_KIND = ("case when data_type in ('BIGINT','INTEGER','DOUBLE','FLOAT','SMALLINT','TINYINT') "
              "then 'numeric' when data_type = 'VARCHAR' then 'categorical' "
              "when data_type = 'BOOLEAN' then 'boolean' "
              "when data_type in ('TIMESTAMP','DATE','TIMESTAMP WITH TIME ZONE') then 'datetime' else 'other' end")

# ------------------------------------------------------------------ registry

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ profile

def _numeric_summary_sql(src: str, cols: list[str]) -> str:
    parts = []
    for x in cols:
        d = f"cast({x} as double)"
        parts.append(
            f"select {_lit(x)} as \"column\", count({x}) as \"count\", round(avg({d}), {ND}) as mean, "
            f"round(stddev_samp({d}), {ND}) as std, round(min({d}), {ND}) as min, "
            f"round(quantile_cont({d}, 0.25), {ND}) as p25, round(quantile_cont({d}, 0.5), {ND}) as p50, "
            f"round(quantile_cont({d}, 0.75), {ND}) as p75, round(max({d}), {ND}) as max "
            f"from {_sql_from(src)}")
    return _union(parts)


@_register("numeric_summary", _numeric_summary_sql("lineitem_dirty", DIRTY_NUM))
def q_numeric_summary(spark, sf):
    return _round(P.numeric_summary(_t(spark, sf, "lineitem_dirty")))


@_register("shape", _union([
    f"select {_lit(t)} as table_name, (select count(*) from {t}) as n_rows, "
    f"(select count(*) from information_schema.columns where table_name = {_lit(t)}) as n_cols"
    for t in TABLES]))
def q_shape(spark, sf):
    parts = [P.shape(load_table(spark, sf, t)).select(F.lit(t).alias("table_name"), "n_rows", "n_cols")
             for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_register("column_types",
           f"select cast(ordinal_position - 1 as bigint) as position, column_name as \"column\", "
           f"{_DUCK_TO_SPARK} as dtype, {_DUCK_KIND} as kind, "
           f"case {_DUCK_KIND} when 'numeric' then 'Numeric' when 'categorical' then 'Categorical' "
           f"else 'Other' end as label "
           f"from information_schema.columns where table_name = 'lineitem'")
def q_column_types(spark, sf):
    return P.column_types(_t(spark, sf, "lineitem"))


@_register("dtypes_by_group",
           f"select {_DUCK_TO_SPARK} as dtype, count(*) as n_columns, "
           f"string_agg(column_name, ', ' order by column_name) as columns "
           f"from information_schema.columns where table_name = 'lineitem' group by 1")
def q_dtypes_by_group(spark, sf):
    return P.dtype_groups(_t(spark, sf, "lineitem"))


@_register("missing_counts", _union([
    f"select {_lit(x)} as \"column\", count(*) - count({x}) as missing from {_sql_from('lineitem_dirty')}"
    for x in DIRTY_COLS]))
def q_missing_counts(spark, sf):
    return P.missing_counts(_t(spark, sf, "lineitem_dirty"))


@_register("missing_ranking",
           "with m as (" + _union([
               f"select {_lit(x)} as \"column\", count(*) - count({x}) as missing, count(*) as n "
               f"from {_sql_from('lineitem_dirty')}" for x in DIRTY_COLS]) + ") "
           "select \"column\", missing, round(missing * 100.0 / n, 2) as percent, "
           "case when round(missing * 100.0 / n, 2) > 50 then 'danger' "
           "when round(missing * 100.0 / n, 2) > 20 then 'warning' else 'info' end as severity, "
           "row_number() over (order by missing desc, \"column\") as rank "
           "from m where missing > 0")
def q_missing_ranking(spark, sf):
    return P.missing_ranking(_t(spark, sf, "lineitem_dirty"))


@_register("unique_counts", _union([
    f"select {_lit(x)} as \"column\", count(distinct {x}) as \"unique\" from lineitem"
    for x in LINEITEM_COLS]))
def q_unique_counts(spark, sf):
    return P.unique_counts(_t(spark, sf, "lineitem"))


def _value_counts_sql(src: str, cols: list[str], strings: set[str]) -> str:
    parts = []
    for x in cols:
        keep = "true" if x in strings else f"(select count(distinct {x}) from {_sql_from(src)}) <= 20"
        parts.append(
            f"select * from (select {_lit(x)} as \"column\", cast(v as varchar) as value, cnt as \"count\", "
            f"row_number() over (order by cnt desc, v) as rank from "
            f"(select {x} as v, count(*) as cnt from {_sql_from(src)} where {x} is not null group by {x}) "
            f"where {keep}) where rank <= 10")
    return _union(parts)


@_register("value_counts_top10",
           _value_counts_sql("lineitem_dirty", DIRTY_COLS, {"returnflag", "l_linestatus"}))
def q_value_counts_top10(spark, sf):
    return P.value_counts_top(_t(spark, sf, "lineitem_dirty"))


@_register("column_ranges", _union([
    f"select {_lit(x)} as \"column\", round(min(cast({x} as double)), {ND}) as min, "
    f"round(max(cast({x} as double)), {ND}) as max from {_sql_from('lineitem_dirty')}"
    for x in DIRTY_NUM]))
def q_column_ranges(spark, sf):
    return _round(P.column_ranges(_t(spark, sf, "lineitem_dirty")))


@_register("categorical_summary", _union([
    f"select {_lit(x)} as \"column\", cast(sum(cnt) as bigint) as \"count\", count(*) as \"unique\", "
    f"first(v order by cnt desc, v) as top, max(cnt) as freq from "
    f"(select {x} as v, count(*) as cnt from {_sql_from('orders_dirty')} where {x} is not null group by {x})"
    for x in ["o_orderstatus", "prio"]]))
def q_categorical_summary(spark, sf):
    return P.categorical_summary(_t(spark, sf, "orders_dirty"))


@_register("duplicate_count", _union([
    f"select 'lineitem_flags' as table_name, count(*) as n_rows, "
    f"(select count(*) from (select distinct {', '.join(FLAG_COLS)} from lineitem)) as n_distinct, "
    f"count(*) - (select count(*) from (select distinct {', '.join(FLAG_COLS)} from lineitem)) as duplicates "
    f"from lineitem",
    "select 'lineitem' as table_name, count(*) as n_rows, "
    "(select count(*) from (select distinct * from lineitem)) as n_distinct, "
    "count(*) - (select count(*) from (select distinct * from lineitem)) as duplicates from lineitem"]))
def q_duplicate_count(spark, sf):
    a = P.duplicate_count(_t(spark, sf, "lineitem_flags")).select(F.lit("lineitem_flags").alias("table_name"), "*")
    b = P.duplicate_count(_t(spark, sf, "lineitem")).select(F.lit("lineitem").alias("table_name"), "*")
    return a.unionByName(b)


def _scalable_sql(src: str, cols: list[str]) -> str:
    parts = []
    for x in cols:
        low = x.lower()
        id_like = any(m in low for m in ("id", "number", "index", "key", "code"))
        parts.append(
            f"select {_lit(x)} as \"column\", {str(id_like).lower()} as id_like, count(distinct {x}) as u, "
            f"count(*) as n, min(cast({x} as double)) as lo, max(cast({x} as double)) as hi "
            f"from {_sql_from(src)}")
    reason = ("case when id_like then 'id-like name' when u = n then 'unique per row' "
              "when u = 2 and lo in (0, 1) and hi in (0, 1) then 'binary 0/1' "
              "when u <= 2 then 'two or fewer values' when u / n > 0.95 then 'near-unique' else 'ok' end")
    return (f"select \"column\", {reason} = 'ok' as scalable, {reason} as reason from ("
            + _union(parts) + ")")


@_register("scalable_columns", _scalable_sql("lineitem_scale", SCALE_COLS))
def q_scalable_columns(spark, sf):
    return P.scalable_columns(_t(spark, sf, "lineitem_scale"))


def _readiness_sql(src: str, cols: list[str]) -> str:
    miss = " + ".join(f"(count(*) - count({x}))" for x in cols)
    return (f"select {_lit(src)} as table_name, m.missing_total, d.duplicates, "
            f"case when m.missing_total = 0 and d.duplicates = 0 then 'Ready' else 'Required' end as status, "
            f"case when m.missing_total = 0 and d.duplicates = 0 then 'Clean' else 'Needs Work' end as label "
            f"from (select cast({miss} as bigint) as missing_total from {_sql_from(src)}) m, "
            f"(select count(*) - (select count(*) from (select distinct * from {_sql_from(src)})) as duplicates "
            f"from {_sql_from(src)}) d")


@_register("readiness", _union([_readiness_sql("lineitem_dirty", DIRTY_COLS),
                                _readiness_sql("lineitem", LINEITEM_COLS)]))
def q_readiness(spark, sf):
    a = P.readiness(_t(spark, sf, "lineitem_dirty")).select(F.lit("lineitem_dirty").alias("table_name"), "*")
    b = P.readiness(_t(spark, sf, "lineitem")).select(F.lit("lineitem").alias("table_name"), "*")
    return a.unionByName(b)


def _column_notes_sql() -> str:
    src = _sql_from("orders_dirty")
    types = {"o_orderkey": ("bigint", "numeric"), "o_custkey": ("bigint", "numeric"),
             "o_orderstatus": ("string", "categorical"), "o_totalprice": ("double", "numeric"),
             "prio": ("string", "categorical"), "o_orderdate": ("timestamp_ntz", "datetime")}
    parts = []
    for x in ORDERS_COLS:
        dtype, kind = types[x]
        num = kind == "numeric"
        mn = f"round(min(cast({x} as double)), {ND})" if num else "cast(null as double)"
        mx = f"round(max(cast({x} as double)), {ND})" if num else "cast(null as double)"
        # for timestamps compare the text form Spark produces
        key = f"strftime({x}, '%Y-%m-%d %H:%M:%S')" if kind == "datetime" else f"cast({x} as varchar)"
        parts.append(
            f"select {_lit(x)} as \"column\", {_lit(dtype)} as dtype, {_lit(kind)} as kind, "
            f"count(distinct {x}) as \"unique\", count(*) - count({x}) as missing, {mn} as min, {mx} as max, "
            f"(select {key} from {src} where {x} is not null group by {x} order by count(*) desc, {x} limit 1) "
            f"as top_value, "
            f"(select count(*) from {src} where {x} is not null group by {x} order by count(*) desc limit 1) "
            f"as top_count from {src}")
    return _union(parts)


@_register("column_notes", _column_notes_sql())
def q_column_notes(spark, sf):
    return _round(P.column_notes(_t(spark, sf, "orders_dirty")))


EVENTS_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@_register("events_unique_counts", _union([
    f"select {_lit(x)} as \"column\", count(distinct {x}) as \"unique\" from events" for x in EVENTS_COLS]))
def q_events_unique_counts(spark, sf):
    return P.unique_counts(_t(spark, sf, "events"))


def _events_notes_sql() -> str:
    types = {"event_id": ("bigint", "numeric"), "ts": ("timestamp_ntz", "datetime"),
             "user_id": ("bigint", "numeric"), "event_type": ("string", "categorical"),
             "value": ("double", "numeric"), "props": ("string", "categorical")}
    parts = []
    for x in EVENTS_COLS:
        dtype, kind = types[x]
        num = kind == "numeric"
        mn = f"round(min(cast({x} as double)), {ND})" if num else "cast(null as double)"
        mx = f"round(max(cast({x} as double)), {ND})" if num else "cast(null as double)"
        parts.append(
            f"select {_lit(x)} as \"column\", {_lit(dtype)} as dtype, {_lit(kind)} as kind, "
            f"count(distinct {x}) as \"unique\", count(*) - count({x}) as missing, {mn} as min, {mx} as max, "
            f"(select cast({x} as varchar) from events where {x} is not null group by {x} "
            f"order by count(*) desc, {x} limit 1) as top_value, "
            f"(select count(*) from events where {x} is not null group by {x} order by count(*) desc limit 1) "
            f"as top_count from events")
    return _union(parts)


@_register("events_column_notes", _events_notes_sql())
def q_events_column_notes(spark, sf):
    return _round(P.column_notes(_t(spark, sf, "events")))


@_register("events_numeric_summary", _numeric_summary_sql("events", ["event_id", "user_id", "value"]))
def q_events_numeric_summary(spark, sf):
    return _round(P.numeric_summary(_t(spark, sf, "events")))


# ------------------------------------------------------------------ clean

def _cols_sql(cols: list[str]) -> str:
    return ", ".join(cols)


@_register("drop_columns",
           f"select {_cols_sql([c for c in LINEITEM_COLS if c not in ('l_partkey', 'l_suppkey')])} from lineitem")
def q_drop_columns(spark, sf):
    return CL.remove_columns(_t(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "no_such_column"])


@_register("dropna_any",
           f"select * from {_sql_from('lineitem_dirty')} where "
           + " and ".join(f"{x} is not null" for x in DIRTY_COLS))
def q_dropna_any(spark, sf):
    return CL.drop_missing_rows(_t(spark, sf, "lineitem_dirty"))


@_register("dropna_subset",
           f"select * from {_sql_from('lineitem_dirty')} where qty is not null and discount is not null")
def q_dropna_subset(spark, sf):
    return CL.drop_missing_rows(_t(spark, sf, "lineitem_dirty"), ["qty", "discount", "no_such_column"])


@_register("drop_missing_columns",
           f"select {_cols_sql([c for c in DIRTY_COLS if c not in ('qty', 'discount', 'returnflag')])} "
           f"from {_sql_from('lineitem_dirty')}")
def q_drop_missing_columns(spark, sf):
    return CL.drop_missing_columns(_t(spark, sf, "lineitem_dirty"))


@_register("drop_duplicates", f"select distinct {_cols_sql(FLAG_COLS)} from lineitem")
def q_drop_duplicates(spark, sf):
    return CL.drop_duplicates(_t(spark, sf, "lineitem_flags"))


def _impute_sql(fill: dict[str, str]) -> str:
    src = _sql_from("lineitem_dirty")
    sel = []
    for x in DIRTY_COLS:
        if x in fill:
            sel.append(f"round(coalesce({x}, (select {fill[x].format(x=x)} from {src})), {ND}) as {x}")
        elif x == "l_extendedprice" or x == "l_tax":
            sel.append(f"round({x}, {ND}) as {x}")
        else:
            sel.append(x)
    return f"select {', '.join(sel)} from {src}"


@_register("impute_mean", _impute_sql({"qty": "avg({x})", "discount": "avg({x})"}))
def q_impute_mean(spark, sf):
    return _round(CL.impute(_t(spark, sf, "lineitem_dirty"), "mean", ["qty", "discount"]))


@_register("impute_median", _impute_sql({"qty": "quantile_cont({x}, 0.5)", "discount": "quantile_cont({x}, 0.5)"}))
def q_impute_median(spark, sf):
    return _round(CL.impute(_t(spark, sf, "lineitem_dirty"), "median", ["qty", "discount"]))


@_register("impute_mode",
           f"select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, {ND}) as o_totalprice, "
           f"coalesce(prio, (select prio from {_sql_from('orders_dirty')} where prio is not null "
           f"group by prio order by count(*) desc, prio limit 1)) as prio, o_orderdate "
           f"from {_sql_from('orders_dirty')}")
def q_impute_mode(spark, sf):
    return _round(CL.impute(_t(spark, sf, "orders_dirty"), "mode", ["prio"]))


def _impute_map_sql() -> str:
    src = _sql_from("lineitem_dirty")
    return (f"select l_orderkey, l_partkey, l_linenumber, "
            f"round(coalesce(qty, (select quantile_cont(qty, 0.5) from {src})), {ND}) as qty, "
            f"round(l_extendedprice, {ND}) as l_extendedprice, "
            f"round(coalesce(discount, (select avg(discount) from {src})), {ND}) as discount, "
            f"round(l_tax, {ND}) as l_tax, "
            f"coalesce(returnflag, (select returnflag from {src} where returnflag is not null "
            f"group by returnflag order by count(*) desc, returnflag limit 1)) as returnflag, "
            f"l_linestatus, l_shipdate from {src}")


@_register("impute_strategy_map", _impute_map_sql())
def q_impute_strategy_map(spark, sf):
    plan = {"qty": "median", "discount": "mean", "returnflag": "mode", "no_such_column": "mean",
            "l_linestatus": "mean"}  # mean on a string column is skipped, as in the reference
    return _round(CL.impute(_t(spark, sf, "lineitem_dirty"), plan))


@_register("impute_drop", f"select * from {_sql_from('lineitem_dirty')} where returnflag is not null")
def q_impute_drop(spark, sf):
    return CL.impute(_t(spark, sf, "lineitem_dirty"), {"returnflag": "drop"})


@_register("columns_with_missing", "select * from (" + _union([
    f"select {_lit(x)} as \"column\", count(*) - count({x}) as missing from {_sql_from('lineitem_dirty')}"
    for x in DIRTY_COLS]) + ") where missing > 0")
def q_columns_with_missing(spark, sf):
    return P.columns_with_missing(_t(spark, sf, "lineitem_dirty"))


def _impute_report_sql() -> str:
    src = _sql_from("lineitem_dirty")
    filled = (f"(select * replace (coalesce(qty, (select avg(qty) from {src})) as qty) "
              f"from {src}) as t")
    return _union([f"select {_lit(x)} as \"column\", count(*) - count({x}) as missing from {filled}"
                   for x in DIRTY_COLS])


@_register("impute_report", _impute_report_sql())
def q_impute_report(spark, sf):
    # M5: the missing counts after a mean imputation of qty
    return P.missing_counts(CL.impute(_t(spark, sf, "lineitem_dirty"), "mean", ["qty"]))


# ------------------------------------------------------------------ encode

def _label_sql() -> str:
    src = _sql_from("orders_dirty")
    def codes(x):
        return (f"(select v, dense_rank() over (order by v) - 1 as code from "
                f"(select distinct coalesce(cast({x} as varchar), 'nan') as v from {src}))")
    return (f"select d.o_orderkey, d.o_custkey, a.code as o_orderstatus, round(d.o_totalprice, {ND}) as o_totalprice, "
            f"b.code as prio, d.o_orderdate from {src.replace(' as orders_dirty', ' as d')} "
            f"join {codes('o_orderstatus')} a on coalesce(cast(d.o_orderstatus as varchar), 'nan') = a.v "
            f"join {codes('prio')} b on coalesce(cast(d.prio as varchar), 'nan') = b.v")


@_register("label_encode", _label_sql())
def q_label_encode(spark, sf):
    return _round(EN.label_encode(_t(spark, sf, "orders_dirty"), ["o_orderstatus", "prio"]))


# category lists of part.p_type and part.p_brand (fixed by the data generator)
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
P_BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))


def _onehot_sql() -> str:
    dummies = [f"case when p_type = {_lit(v)} then 1 else 0 end as {_qi('p_type_' + v)}" for v in P_TYPES[1:]]
    dummies += [f"case when p_brand = {_lit(v)} then 1 else 0 end as {_qi('p_brand_' + v)}" for v in P_BRANDS[1:]]
    return (f"select p_partkey, p_name, p_size, round(p_retailprice, {ND}) as p_retailprice, "
            f"{', '.join(dummies)} from part")


@_register("onehot_encode", _onehot_sql())
def q_onehot_encode(spark, sf):
    return _round(EN.onehot_encode(_t(spark, sf, "part"), ["p_type", "p_brand"]))


@_register("onehot_guard", _union([
    f"select {_lit(x)} as \"column\", count(distinct {x}) as \"unique\", count(distinct {x}) <= 50 as allowed "
    f"from customer" for x in ["c_name", "c_mktsegment", "c_nationkey"]]))
def q_onehot_guard(spark, sf):
    return EN.cardinality(_t(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_nationkey"])


def _onehot_lists_sql() -> str:
    dummies = [f"p_type_{v}" for v in P_TYPES[1:]] + [f"p_brand_{v}" for v in P_BRANDS[1:]]
    cols = ["p_partkey", "p_name", "p_size", "p_retailprice"] + dummies
    numeric = ["p_partkey", "p_size", "p_retailprice"] + dummies
    return _union([
        f"select 'columns' as list, {_lit(', '.join(cols))} as columns",
        f"select 'numeric' as list, {_lit(', '.join(numeric))} as columns",
        "select 'categorical' as list, 'p_name' as columns",
        # scalable: numeric, not id-like, not unique per row, > 2 distinct, ratio <= 0.95
        "select 'scalable' as list, coalesce(string_agg(c, ', ' order by pos), '') as columns from ("
        "select 'p_size' as c, 1 as pos, count(distinct p_size) as u, count(*) as n from part union all "
        "select 'p_retailprice', 2, count(distinct p_retailprice), count(*) from part) "
        "where u <> n and u > 2 and u / n <= 0.95"])


@_register("onehot_column_lists", _onehot_lists_sql())
def q_onehot_column_lists(spark, sf):
    # E5: column lists after one-hot encoding (0/1 dummies are never scalable)
    return P.column_lists(EN.onehot_encode(_t(spark, sf, "part"), ["p_type", "p_brand"]))


# ------------------------------------------------------------------ scale

SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flag", "k"]


def _scale_sql(center: str, spread: str) -> str:
    src = _sql_from("lineitem_scale")
    stats = ", ".join(f"{center.format(x=x)} as c_{x}, coalesce(nullif({spread.format(x=x)}, 0), 1) as s_{x}"
                      for x in SCALED)
    sel = ", ".join(f"round((cast({x} as double) - st.c_{x}) / st.s_{x}, {ND}) as {x}" for x in SCALED)
    return (f"select t.l_orderkey, t.l_linenumber, {sel} from {src.replace(' as lineitem_scale', ' as t')}, "
            f"(select {stats} from {src}) st")


@_register("scale_standard", _scale_sql("avg({x})", "stddev_pop({x})"))
def q_scale_standard(spark, sf):
    return _round(SC.scale(_t(spark, sf, "lineitem_scale"), "StandardScaler", SCALED))


@_register("scale_minmax", _scale_sql("min({x})", "max({x}) - min({x})"))
def q_scale_minmax(spark, sf):
    return _round(SC.scale(_t(spark, sf, "lineitem_scale"), "MinMaxScaler", SCALED))


@_register("scale_robust", _scale_sql("quantile_cont({x}, 0.5)",
                                      "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"))
def q_scale_robust(spark, sf):
    return _round(SC.scale(_t(spark, sf, "lineitem_scale"), "RobustScaler", SCALED))


@_register("scale_params", _union([
    f"select {_lit(x)} as \"column\", round(avg({x}), {ND}) as center, "
    f"round(coalesce(nullif(stddev_pop({x}), 0), 1), {ND}) as scale from {_sql_from('lineitem_scale')}"
    for x in SCALED]))
def q_scale_params(spark, sf):
    return _round(SC.fit_scaler(_t(spark, sf, "lineitem_scale"), "standard", SCALED).params_df(spark))


# ------------------------------------------------------------------ task, split

TASK_TARGETS = ["l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice", "l_orderkey"]


def _task_sql() -> str:
    types = {"l_returnflag": "string", "l_linenumber": "int", "l_quantity": "double",
             "l_extendedprice": "double", "l_orderkey": "bigint"}
    parts = []
    for x in TASK_TARGETS:
        t = types[x]
        if t == "string":
            rule = "'classification'"
        else:
            small = "true" if t in ("int", "bigint") else "false"
            rule = (f"case when {small} and count(distinct {x}) <= 20 then 'classification' "
                    f"when count(distinct {x}) / count(*) < 0.05 then 'classification' else 'regression' end")
        parts.append(f"select {_lit(x)} as target, {_lit(t)} as dtype, count(distinct {x}) as n_unique, "
                     f"count(*) as n_rows, {rule} as task_type from lineitem")
    return _union(parts)


@_register("task_type", _task_sql())
def q_task_type(spark, sf):
    df = _t(spark, sf, "lineitem")
    out = None
    for x in TASK_TARGETS:
        one = SP.task_stats(df, x)
        out = one if out is None else out.unionByName(one)
    return out


@_register("train_test_split")
def q_train_test_split(spark, sf):
    return SP.mark_split(_t(spark, sf, "lineitem"), 0.2, 42)


@_register("kfold")
def q_kfold(spark, sf):
    return SP.assign_folds(_t(spark, sf, "lineitem"), 5, 42)


@_register("kfold_stratified")
def q_kfold_stratified(spark, sf):
    return SP.assign_folds(_t(spark, sf, "lineitem"), 5, 42, stratify="l_returnflag")


# ------------------------------------------------------------------ metrics

RULE = _sql_from("lineitem_rule")


@_register("confusion_matrix",
           f"select l_returnflag as label, mc_prediction as prediction, count(*) as \"count\" "
           f"from {RULE} group by 1, 2")
def q_confusion_matrix(spark, sf):
    return ME.confusion(_t(spark, sf, "lineitem_rule"), "l_returnflag", "mc_prediction")


@_register("confusion_matrix_wide",
           f"select l_returnflag as label, "
           + ", ".join(f"count(*) filter (where mc_prediction = '{v}') as \"{v}\"" for v in ("A", "N", "R"))
           + f" from {RULE} group by 1")
def q_confusion_matrix_wide(spark, sf):
    return ME.confusion_wide(_t(spark, sf, "lineitem_rule"), "l_returnflag", "mc_prediction")


def _clf_sql(label: str, pred: str) -> str:
    return (f"with cm as (select cast({label} as varchar) as y, cast({pred} as varchar) as p, count(*) as cnt "
            f"from {RULE} group by 1, 2), "
            f"cls as (select y as cls from cm union select p from cm), "
            f"pc as (select cls, "
            f"coalesce((select sum(cnt) from cm where y = cls and p = cls), 0) as tp, "
            f"coalesce((select sum(cnt) from cm where y = cls), 0) as support, "
            f"coalesce((select sum(cnt) from cm where p = cls), 0) as predicted from cls), "
            f"m as (select *, case when predicted = 0 then 0 else tp / predicted end as pr, "
            f"case when support = 0 then 0 else tp / support end as rc from pc), "
            f"f as (select *, case when pr + rc = 0 then 0 else 2 * pr * rc / (pr + rc) end as f1 from m) "
            f"select cast(sum(support) as bigint) as n, round(sum(tp) / sum(support), {ND}) as accuracy, "
            f"round(sum(f1 * support) / sum(support), {ND}) as weighted_f1, round(avg(f1), {ND}) as macro_f1 from f")


@_register("accuracy", _clf_sql("label", "prediction"))
def q_accuracy(spark, sf):
    return _round(ME.classification_metrics(_t(spark, sf, "lineitem_rule"), "label", "prediction"))


@_register("weighted_f1", _clf_sql("l_returnflag", "mc_prediction"))
def q_weighted_f1(spark, sf):
    return _round(ME.classification_metrics(_t(spark, sf, "lineitem_rule"), "l_returnflag", "mc_prediction"))


@_register("regression_metrics",
           f"select count(*) as n, round(avg((l_extendedprice - price_pred) ^ 2), 2) as mse, "
           f"round(sqrt(avg((l_extendedprice - price_pred) ^ 2)), 4) as rmse, "
           f"round(1 - sum((l_extendedprice - price_pred) ^ 2) / (var_pop(l_extendedprice) * count(*)), {ND}) as r2 "
           f"from {RULE}")
def q_regression_metrics(spark, sf):
    m = ME.regression_metrics(_t(spark, sf, "lineitem_rule"), "l_extendedprice", "price_pred")
    return m.select("n", F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"),
                    F.round("r2", ND).alias("r2"))


def _auc_sql(pos: str, score: str, src: str = RULE, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    part = f"partition by {group} " if group else ""
    return (f"with s as (select {g}{score} as score, sum(case when {pos} then 1 else 0 end) as pos, "
            f"sum(case when {pos} then 0 else 1 end) as neg from {src} where {score} is not null "
            f"group by {g}{score}), "
            f"c as (select *, coalesce(sum(neg) over ({part}order by score rows between unbounded preceding "
            f"and 1 preceding), 0) as below from s) "
            f"select {g}round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), {ND}) as auc, "
            f"cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from c"
            + (f" group by {group}" if group else ""))


@_register("roc_auc_binary", _auc_sql("label = 1", "score"))
def q_roc_auc_binary(spark, sf):
    return _round(ME.roc_auc_binary(_t(spark, sf, "lineitem_rule"), "label", "score", 1))


def _ovr_sql() -> str:
    long = (f"(select l_returnflag as y, 'A' as cls, score_a as score from {RULE} union all "
            f"select l_returnflag, 'N', score_n from {RULE} union all "
            f"select l_returnflag, 'R', score_r from {RULE}) as lf")
    per = _auc_sql("y = cls", "score", long, "cls")
    return (f"with per as ({per}) select cls, auc from per union all "
            f"select 'macro' as cls, round(avg(auc), {ND}) as auc from per")


@_register("roc_auc_ovr", _ovr_sql())
def q_roc_auc_ovr(spark, sf):
    out = ME.roc_auc_ovr(_t(spark, sf, "lineitem_rule"), "l_returnflag",
                         {"A": "score_a", "N": "score_n", "R": "score_r"})
    # the macro row averages the unrounded class AUCs; round per class first, like the oracle
    per = _round(out.where(F.col("cls") != "macro"))
    return per.unionByName(per.agg(F.round(F.avg("auc"), ND).alias("auc")).select(F.lit("macro").alias("cls"), "auc"))


@_register("roc_curve",
           f"with s as (select score, sum(label) as pos, sum(1 - label) as neg from {RULE} group by score), "
           f"c as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, "
           f"sum(pos) over () as tot_p, sum(neg) over () as tot_n from s) "
           f"select score as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, "
           f"round(tp / tot_p, {ND}) as tpr, round(fp / tot_n, {ND}) as fpr from c")
def q_roc_curve(spark, sf):
    return _round(ME.roc_curve(_t(spark, sf, "lineitem_rule"), "label", "score", 1))


FOLD_SCORES_SQL = (f"select fold, avg(case when label = prediction then 1.0 else 0.0 end) as score "
                   f"from {RULE} group by fold")


@_register("fold_scores", f"select fold, round(score, {ND}) as score from ({FOLD_SCORES_SQL})")
def q_fold_scores(spark, sf):
    return _round(ME.fold_scores(_t(spark, sf, "lineitem_rule"), "fold", "label", "prediction", "accuracy"))


@_register("cv_summary",
           f"select count(score) as n_folds, round(avg(score), 4) as cv_mean, round(stddev_pop(score), {ND}) as cv_std, "
           f"round(min(score), {ND}) as cv_min, round(max(score), {ND}) as cv_max from ({FOLD_SCORES_SQL})")
def q_cv_summary(spark, sf):
    s = ME.fold_scores(_t(spark, sf, "lineitem_rule"), "fold", "label", "prediction", "accuracy")
    return _round(ME.cv_summary(s))


@_register("fold_deviation",
           f"select fold, round(score, {ND}) as score, round(score - avg(score) over (), {ND}) as deviation "
           f"from ({FOLD_SCORES_SQL})")
def q_fold_deviation(spark, sf):
    s = ME.fold_scores(_t(spark, sf, "lineitem_rule"), "fold", "label", "prediction", "accuracy")
    return _round(ME.fold_deviation(s))


THRESHOLDS = [0.0, 0.02, 0.04, 0.06, 0.08, 0.1]


def _insights_sql() -> str:
    runs = ", ".join(f"(cast({t} as double))" for t in THRESHOLDS)
    per = (f"select r.t as run, fold, sum(case when label = (case when score > r.t then 1 else 0 end) "
           f"then 1.0 else 0.0 end) as hits, count(*) as n from {RULE} join (values {runs}) as r(t) on true "
           f"group by 1, 2")
    agg = (f"select run, sum(case when fold <> 0 then hits end) / sum(case when fold <> 0 then n end) as train_score, "
           f"sum(case when fold = 0 then hits end) / sum(case when fold = 0 then n end) as test_score, "
           f"avg(case when fold <> 0 then hits / n end) as cv_mean, "
           f"stddev_pop(case when fold <> 0 then hits / n end) as cv_std from ({per}) group by run")
    t, r, s = "test_score", "train_score", "cv_std"
    return (f"select round(run, {ND}) as run, round({r}, {ND}) as train_score, round({t}, {ND}) as test_score, "
            f"round(cv_mean, {ND}) as cv_mean, round({s}, {ND}) as cv_std, "
            f"case when {t} >= 0.9 then 'Excellent Performance' when {t} >= 0.8 then 'Good Performance' "
            f"when {t} >= 0.7 then 'Fair Performance' else 'Needs Improvement' end as performance, "
            f"case when {r} - {t} > 0.1 then 'Possible Overfitting' when {r} - {t} < 0.05 then 'Well-Balanced Model' "
            f"end as fit, "
            f"case when {s} < 0.05 then 'Consistent Cross-Validation' when {s} > 0.1 then 'Variable Performance' "
            f"end as cv_stability, "
            f"case when {t} >= 0.9 then 'Excellent' when {t} >= 0.8 then 'Good' when {t} >= 0.7 then 'Fair' "
            f"when {t} >= 0.6 then 'Warning' else 'Poor' end as grade from ({agg})")


@_register("insights", _insights_sql())
def q_insights(spark, sf):
    df = _t(spark, sf, "lineitem_rule")
    runs = df.select("label", "fold", "score", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("run"))
    runs = runs.withColumn("pred", (F.col("score") > F.col("run")).cast("int"))
    scores = ME.run_scores(runs, "run", "fold", "label", "pred", test_fold=0)
    return _round(IN.insights(scores))


@_register("export_results_roundtrip", _SQL["insights"])
def q_export_results_roundtrip(spark, sf):
    # The insight table written as JSON lines and read back with its schema
    res = q_insights(spark, sf)
    path = _scratch(spark, "results") + "/insights.json"
    ST.export_results(res, path)
    return spark.read.schema(res.schema).json(path)


# ------------------------------------------------------------------ balance

@_register("class_weights",
           f"select l_returnflag, count(*) as \"count\", "
           f"round(sum(count(*)) over () / (count(*) over () * count(*)), {ND}) as weight "
           f"from lineitem group by l_returnflag")
def q_class_weights(spark, sf):
    return _round(BA.class_weights(_t(spark, sf, "lineitem"), "l_returnflag"))


@_register("undersample")
def q_undersample(spark, sf):
    return BA.undersample(_t(spark, sf, "lineitem"), "l_returnflag", seed=42)


@_register("oversample")
def q_oversample(spark, sf):
    return BA.oversample(_t(spark, sf, "lineitem"), "l_returnflag", seed=42)


SMOTE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@_register("smote")
def q_smote(spark, sf):
    # scaled first, so that no feature decides alone who is near
    table = SC.scale(_t(spark, sf, "lineitem").select("l_returnflag", *SMOTE_FEATURES), "minmax", SMOTE_FEATURES)
    return SM.smote(table, "l_returnflag", SMOTE_FEATURES)


# classes of one size; all old rows are there; new rows lie within the class's ranges
@_register("smote_counts",
           "with c as (select l_returnflag as label, count(*) as n from lineitem group by 1) "
           "select label, n as n_old, (select max(n) from c) - n as n_new, true as old_kept, true as within from c")
def q_smote_counts(spark, sf):
    table = _t(spark, sf, "lineitem").select("l_returnflag", *SMOTE_FEATURES)
    out = SM.smote(table, "l_returnflag", SMOTE_FEATURES, mark="new")

    def ranges(df, p):
        return [f(x).alias(f"{p}{n}{x}") for x in SMOTE_FEATURES for n, f in (("lo", F.min), ("hi", F.max), ("sum", F.sum))]
    old = table.groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"), *ranges(table, "a"))
    kept = out.where("not new").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n_old"), *ranges(out, "b"))
    made = out.where("new").groupBy(F.col("l_returnflag").alias("m")).agg(F.count("*").alias("n_new"), *ranges(out, "c"))
    same, within = F.col("n") == F.col("n_old"), F.lit(True)
    for x in SMOTE_FEATURES:
        same = same & (F.abs(F.col(f"asum{x}") - F.col(f"bsum{x}")) < 1e-3)
        within = within & (F.col(f"clo{x}") >= F.col(f"alo{x}")) & (F.col(f"chi{x}") <= F.col(f"ahi{x}"))
    return old.join(kept, F.col("label") == F.col("k")).join(made, F.col("label") == F.col("m"), "left").select(
        "label", "n_old", F.coalesce("n_new", F.lit(0)).alias("n_new"), same.alias("old_kept"), F.coalesce(within, F.lit(True)).alias("within"))


@_register("nearest_neighbours",
           f"with p as (select distinct c_mktsegment as g, c_acctbal as a, c_nationkey * cast(100.0 as double) as b from customer), "
           f"d as (select p.g, p.a, p.b, q.a as near_a, q.b as near_b, (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) as d2 "
           f"from p join p q on p.g = q.g and (p.a <> q.a or p.b <> q.b)), "
           f"r as (select *, row_number() over (partition by g, a, b order by d2, near_a, near_b) as rank from d) "
           f"select g, a, b, cast(rank as int) as rank, near_a, near_b, round(d2, {ND}) as d2 from r where rank <= 5")
def q_nearest_neighbours(spark, sf):
    rows = _t(spark, sf, "customer").selectExpr("c_mktsegment", "c_acctbal as a", "c_nationkey * 100.0D as b").distinct()
    coded = EN.label_encode(rows.withColumn("g", F.col("c_mktsegment")), ["g"])
    names = coded.select("g", "c_mktsegment").distinct()
    near = NB.nearest(NB.points_of(coded, ["a", "b"], "g"), 5, 64)
    each = near.select("g", "x", F.posexplode(F.slice("near", 1, 5)).alias("rank", "e"))
    out = each.join(names, "g").select(F.col("c_mktsegment").alias("g"), F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), (F.col("rank") + 1).alias("rank"),
                                       F.col("e.x")[0].alias("near_a"), F.col("e.x")[1].alias("near_b"), "e.d2")
    return _round(out)


# ------------------------------------------------------------------ models
# Not expressible in SQL: rows-only checks. Small forests / few boosting
# rounds keep the driver's run short; the full reference grids are the
# defaults of tabforge.plans.models.HYPERPARAMETER_GRIDS.

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_linestatus"]


def _clf_table(spark, sf, target_expr: str = "l_returnflag") -> DataFrame:
    df = _t(spark, sf, "lineitem").selectExpr(*FEATURES, f"{target_expr} as target")
    return EN.label_encode(df, ["l_linestatus"], plain=True)  # training scans it often


def _reg_table(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").selectExpr("l_quantity", "l_discount", "l_tax", "l_linenumber",
                                                "l_extendedprice as target")


@_register("train_rf_classifier")
def q_train_rf_classifier(spark, sf):
    r = TR.train(_clf_table(spark, sf), "target", "Random Forest",
                 params={"n_estimators": 20, "max_depth": 5})
    return r.record(spark)


@_register("train_rf_regressor")
def q_train_rf_regressor(spark, sf):
    r = TR.train(_reg_table(spark, sf), "target", "Random Forest",
                 params={"n_estimators": 20, "max_depth": 5})
    return r.record(spark)


@_register("train_gbt_classifier")
def q_train_gbt_classifier(spark, sf):
    df = _clf_table(spark, sf, "case when l_returnflag = 'R' then 1 else 0 end")
    r = TR.train(df, "target", "XGBoost", params={"n_estimators": 20, "max_depth": 3}, use_cv=False)
    return r.record(spark)


@_register("train_gbt_multiclass")
def q_train_gbt_multiclass(spark, sf):
    r = TR.train(_clf_table(spark, sf), "target", "LightGBM",
                 params={"n_estimators": 10, "max_depth": 3}, use_cv=False)
    return r.record(spark)


@_register("train_gbt_regressor")
def q_train_gbt_regressor(spark, sf):
    r = TR.train(_reg_table(spark, sf), "target", "XGBoost",
                 params={"n_estimators": 20, "max_depth": 3, "learning_rate": 0.1}, use_cv=False)
    return r.record(spark)


@_register("grid_search")
def q_grid_search(spark, sf):
    r = TR.train(_clf_table(spark, sf), "target", "Random Forest", tuning="Grid Search",
                 grid={"n_estimators": [10, 20], "max_depth": [3, 5], "min_samples_split": [2]},
                 use_cv=False)
    return r.search_table(spark)


@_register("random_search")
def q_random_search(spark, sf):
    r = TR.train(_reg_table(spark, sf), "target", "XGBoost", tuning="Random Search", n_iter=3,
                 grid={"n_estimators": [5, 10], "max_depth": [2, 3], "learning_rate": [0.1, 0.2]},
                 use_cv=False)
    return r.search_table(spark)


@_register("model_export_roundtrip")
def q_model_export_roundtrip(spark, sf):
    # Save the fitted pipeline (indexer + assembler + forest), load it, score the table
    df = _clf_table(spark, sf)
    r = TR.train(df, "target", "Random Forest", params={"n_estimators": 5, "max_depth": 3}, use_cv=False)
    path = _scratch(spark, "model")
    ST.export_model(r.model, path)
    return ST.load_model(path).transform(df).select("target", "prediction")


# every row has the prediction of the model before it was saved
@_register("model_export_same", "select count(*) as \"rows\", count(*) as same from lineitem")
def q_model_export_same(spark, sf):
    df = _clf_table(spark, sf)
    r = TR.train(df, "target", "Random Forest", params={"n_estimators": 5, "max_depth": 3}, use_cv=False)
    path = _scratch(spark, "model")
    ST.export_model(r.model, path)
    before = r.model.transform(df).select(*df.columns, F.col("prediction").alias("before"))
    after = ST.load_model(path).transform(before)
    return after.agg(F.count("*").alias("rows"), F.count(F.when(F.col("before") == F.col("prediction"), 1)).alias("same"))


@_register("feature_importance")
def q_feature_importance(spark, sf):
    r = TR.train(_clf_table(spark, sf), "target", "Random Forest",
                 params={"n_estimators": 20, "max_depth": 5}, use_cv=False)
    return r.importance(spark)


# V5, V9: what a result says of itself: names, labels, folds, and importances that are shares ranked from the top
@_register("training_record",
           f"select 'Random Forest' as model_name, 'classification' as task_type, '{','.join(FEATURES)}' as features, "
           f"string_agg(distinct l_returnflag, ',' order by l_returnflag) as labels, cast(5 as int) as folds, true as mean_of_folds, "
           f"'accuracy,f1_score,roc_auc' as metrics, cast({len(FEATURES)} as bigint) as ranked, true as falling, "
           f"cast(1.0 as double) as total from lineitem")
def q_training_record(spark, sf):
    r = TR.train(_clf_table(spark, sf), "target", "Random Forest", params={"n_estimators": 5, "max_depth": 3})
    ranked = r.importance(spark).agg(
        F.count("*").alias("ranked"), F.round(F.sum("importance"), ND).alias("total"),
        F.array_sort(F.collect_list(F.struct("rank", "importance"))).alias("rows")).first()
    shares = [x["importance"] for x in ranked["rows"]]
    mean = F.aggregate("cv_scores", F.lit(0.0), lambda x, y: x + y) / F.size("cv_scores")
    return r.record(spark).select(
        "model_name", "task_type", F.array_join("feature_names", ",").alias("features"), F.lit(",".join(r.labels)).alias("labels"),
        F.size("cv_scores").alias("folds"), (F.abs(mean - F.col("cv_mean")) < 2e-4).alias("mean_of_folds"),
        F.array_join(F.array_sort(F.map_keys("metrics")), ",").alias("metrics"),
        F.lit(ranked["ranked"]).cast("long").alias("ranked"), F.lit(shares == sorted(shares, reverse=True)).alias("falling"),
        F.lit(ranked["total"]).alias("total"))


# ------------------------------------------------------------------ sources (S1-S10), workflow

def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared storage
    on a cluster; tests and local runs get a scratch folder)."""
    import uuid
    base = ensure_checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir is not set")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


CSV_COLS = [c for c in DIRTY_COLS if c != "l_shipdate"]


@_register("csv_roundtrip",
           f"select l_orderkey, l_partkey, cast(l_linenumber as bigint) as l_linenumber, qty, l_extendedprice, "
           f"discount, l_tax, returnflag, l_linestatus from {_sql_from('lineitem_dirty')}")
def q_csv_roundtrip(spark, sf):
    path = _scratch(spark, "csv") + "/lineitem.csv"
    ST.export_data(_t(spark, sf, "lineitem_dirty").select(*CSV_COLS), path, "csv")
    return CSV.read_csv(spark, path)


@_register("save_load_version", f"select * from {_sql_from('lineitem_dirty')}")
def q_save_load_version(spark, sf):
    base = _scratch(spark, "versions")
    ST.save_version(_t(spark, sf, "lineitem_dirty"), base, "v1")
    return ST.load_version(spark, base, "v1")


@_register("head_sample",
           f"select l_orderkey, l_partkey, l_linenumber, qty, l_extendedprice, discount, l_tax, returnflag, "
           f"l_linestatus, l_shipdate from {_sql_from('lineitem_dirty')} "
           f"order by {', '.join(c + ' nulls first' for c in DIRTY_COLS)} limit 5")
def q_head_sample(spark, sf):
    # a total order (every column) makes the five rows reproducible
    return ST.head(_t(spark, sf, "lineitem_dirty"), 5, order_by=DIRTY_COLS)


@_register("dataset_descriptor",
           f"select 'v1' as id, count(*) as n_rows, 10 as n_cols, '{','.join(DIRTY_COLS)}' as columns, "
           f"'bigint,bigint,int,double,double,double,double,string,string,timestamp_ntz' as dtypes "
           f"from {_sql_from('lineitem_dirty')}")
def q_dataset_descriptor(spark, sf):
    return ST.describe_version(_t(spark, sf, "lineitem_dirty"), "v1").withColumns(
        {x: F.array_join(x, ",") for x in ("columns", "dtypes")})


def _workflow_sql() -> str:
    src = _sql_from("lineitem_dirty")
    t = (f"select l_orderkey, l_linenumber, coalesce(qty, (select quantile_cont(qty, 0.5) from {src})) as qty, "
         f"l_extendedprice, discount, l_tax, returnflag, l_linestatus, l_shipdate from {src}")
    return (f"with t as ({t}), s as (select min(qty) as a1, max(qty) as b1, min(l_extendedprice) as a2, "
            f"max(l_extendedprice) as b2 from t) "
            f"select l_orderkey, l_linenumber, round((qty - a1) / coalesce(nullif(b1 - a1, 0), 1), {ND}) as qty, "
            f"round((l_extendedprice - a2) / coalesce(nullif(b2 - a2, 0), 1), {ND}) as l_extendedprice, "
            f"round(discount, {ND}) as discount, round(l_tax, {ND}) as l_tax, returnflag, l_linestatus, l_shipdate "
            f"from t, s")


def _workflow(spark, sf) -> WF.Workflow:
    w = WF.Workflow(_t(spark, sf, "lineitem_dirty"))
    w.remove_columns(["l_partkey"])
    w.handle_missing("median", ["qty"])
    w.scale("MinMaxScaler", ["qty", "l_extendedprice"])
    return w


@_register("workflow_result", _workflow_sql())
def q_workflow_result(spark, sf):
    return _round(_workflow(spark, sf).df)


@_register("workflow_log",
           f"select cast(1 as int) as step_no, 'Remove Columns' as step, 'Removed 1 columns: l_partkey' as details union all "
           f"select cast(2 as int), 'Missing Values', 'Applied median to ' || case when count(*) > count(qty) then '1' else '0' end || ' columns' "
           f"from {_sql_from('lineitem_dirty')} union all "
           f"select cast(3 as int), 'Feature Scaling', 'Scaled 2 columns using MinMaxScaler'")
def q_workflow_log(spark, sf):
    return _workflow(spark, sf).log_df(spark)


# ------------------------------------------------------------------ hard cases of earlier operators

# text that a CSV file must quote; the same expression builds it in both engines
CSV_EDGE = ("select l_orderkey, l_linenumber, case l_linenumber % 5 "
            "when 0 then concat('say \"', l_returnflag, '\", ok') when 1 then concat(' pad ', l_linestatus, ' ') "
            "when 2 then concat('C:', chr(92), l_returnflag, chr(92)) when 3 then concat('two', chr(10), l_linestatus) "
            "else concat('a,b;', l_returnflag) end as note from lineitem")


def _sql(spark, sf, text: str, *tables: str) -> DataFrame:
    """The text over tables read as they are (no missing-value normalisation)."""
    for t in tables:
        text = text.replace(f"from {t}", f"from parquet.`{sf}/{t}.parquet`")
    return spark.sql(text)


@_register("csv_edge_cases", CSV_EDGE.replace("l_linenumber, case", "cast(l_linenumber as bigint) as l_linenumber, case"))
def q_csv_edge_cases(spark, sf):
    path = _scratch(spark, "csv") + "/notes.csv"
    ST.export_data(_sql(spark, sf, CSV_EDGE, "lineitem"), path, "csv")
    return CSV.read_csv(spark, path)


@_register("split_summary", " union all ".join(
    f"select '{t}' as source, '{p}' as split, {n} as n from {_sql_from(t)}" for t in ("lineitem", "lineitem_flags")
    for p, n in (("test", "(count(*) * 2000 + 9999) // 10000"), ("train", "count(*) - (count(*) * 2000 + 9999) // 10000"))))
def q_split_summary(spark, sf):
    out = [SP.exact_split(_t(spark, sf, t), 0.2).groupBy("split").agg(F.count("*").alias("n")).select(
        F.lit(t).alias("source"), "split", "n") for t in ("lineitem", "lineitem_flags")]
    return out[0].union(out[1])


@_register("fold_summary", " union all ".join(
    f"select '{t}' as source, l_returnflag as label, count(*) as n, cast(5 as bigint) as folds, true as even "
    f"from {_sql_from(t)} group by 2" for t in ("lineitem", "lineitem_flags")))
def q_fold_summary(spark, sf):
    out = []
    for t in ("lineitem", "lineitem_flags"):
        per = SP.exact_folds(_t(spark, sf, t), 5, stratify="l_returnflag").groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"))
        out.append(per.groupBy(F.col("l_returnflag").alias("label")).agg(
            F.sum("n").alias("n"), F.count("*").alias("folds"), (F.max("n") - F.min("n") <= 1).alias("even")).select(
            F.lit(t).alias("source"), "label", "n", "folds", "even"))
    return out[0].union(out[1])


# one class per class size: the counts after balancing, and that every row comes from the table
def _balanced_sql(size: str) -> str:
    return (f"with c as (select l_returnflag as label, count(*) as n from lineitem group by 1) "
            f"select label, (select {size}(n) from c) as n, (select {size}(n) from c) as from_table from c")


def _balanced(spark, sf, f) -> DataFrame:
    table = _t(spark, sf, "lineitem")
    own = table.dropDuplicates()
    out = f(table, "l_returnflag", seed=42)
    inside = out.join(own, [out[x].eqNullSafe(own[x]) for x in table.columns], "left_semi")
    return out.groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n")).join(
        inside.groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("from_table")), "label")


@_register("undersample_counts", _balanced_sql("min"))
def q_undersample_counts(spark, sf):
    return _balanced(spark, sf, BA.undersample)


@_register("oversample_counts", _balanced_sql("max"))
def q_oversample_counts(spark, sf):
    return _balanced(spark, sf, BA.oversample)


DOUBLES = ("select l_orderkey, l_linenumber, l_quantity, case l_linenumber when 1 then cast(0.0001 as double) when 2 then cast(0.5 as double) "
           "when 3 then cast(10000000.0 as double) when 4 then cast(0.00001 as double) else l_tax end as x from lineitem")


@_register("label_encode_double",
           f"select l_orderkey, l_linenumber, l_quantity, dense_rank() over (order by cast(x as varchar)) - 1 as x from ({DOUBLES})")
def q_label_encode_double(spark, sf):
    return _round(EN.label_encode(_sql(spark, sf, DOUBLES, "lineitem"), ["x"]))


NANS = ("select l_orderkey, l_linenumber, case when l_linenumber = 2 then cast('NaN' as double) else l_quantity end as x from lineitem")
INFS = ("select case when l_linenumber = 7 then cast('Infinity' as double) else l_quantity end as x, "
        "cast(l_quantity as decimal(30,2)) as y from lineitem")


@_register("impute_nan_mean", f"select l_orderkey, l_linenumber, round(case when isnan(x) then "
                              f"(select avg(x) from ({NANS}) where not isnan(x)) else x end, {ND}) as x from ({NANS})")
def q_impute_nan_mean(spark, sf):
    return _round(CL.impute(_sql(spark, sf, NANS, "lineitem"), "mean", ["x"]))


@_register("numeric_summary_inf", f"select 'x' as \"column\", count(*) as \"count\", null::double as mean, null::double as std, min(x) as min, "
                                  f"quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.75) as p75, "
                                  f"null::double as max from ({INFS}) union all "
                                  f"select 'y', count(*), round(avg(y::double), {ND}), round(stddev_samp(y::double), {ND}), min(y::double), "
                                  f"quantile_cont(y::double, 0.25), quantile_cont(y::double, 0.5), quantile_cont(y::double, 0.75), max(y::double) from ({INFS})")
def q_numeric_summary_inf(spark, sf):
    return _round(P.numeric_summary(_sql(spark, sf, INFS, "lineitem")))


# ------------------------------------------------------------------ contract

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: exact numeric summary (count, mean, std, quartiles, min,
    max) of every numeric column of ``lineitem`` at sf0.001."""
    return _round(P.numeric_summary(load_table(spark, SF_SMOKE, "lineitem")))


def _corpus() -> tuple[dict, dict]:
    """Queries and SQL of the training-data subpackage; none where its folder is absent."""
    found: tuple[dict, dict] = ({}, {})
    for module in ("tabforge.llm.registry", "corpus_pipeline"):
        try:
            m = import_module(module)
        except ModuleNotFoundError as e:
            if e.name not in ("tabforge.llm", module):
                raise
            continue
        found[0].update(m.QUERIES)
        found[1].update(m.SQL)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _Q | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    return {k: _fold_negative_zero(v) for k, v in _SQL.items()} | _corpus()[1]
