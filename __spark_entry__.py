"""

Each query reads the whole driver tables (or a view Spark derives from
them, defined identically on both sides) and returns a DataFrame; the
oracle is the same question in DuckDB SQL. Computed columns carry the same
names on both sides.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions.classes import shape_frame
from framescope.operators import ask, charts, findings, preview, quality, stats
from framescope.operators.gram import Pivoted
from framescope.plans.chart_data import ChartSpec, chart_data
from framescope.plans.chart_plan import chart_plan
from framescope.plans.profile import profile
from framescope.session import ensure_checkpoint_dir
from framescope.sources.files import load_dataset
from framescope.sources.sinks import answer_kind, write_result

try:  # the corpus operators are an optional part with libraries of their own
    from framescope.llm import registry as corpus
except ImportError:
    corpus = None

SMOKE_DIR = "/root/testdata/sf0.001"


# --------------------------------------------------------------------------
# Tables and derived views (same definitions as the CTEs in the oracle)
# --------------------------------------------------------------------------

def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUM = LINEITEM[:8]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CONVERSATIONS = ["conv_id", "turn", "role", "text"]

MESSY = LINEITEM + ["empty_num", "near_empty"]
MESSY_NUM = LINEITEM_NUM + ["empty_num"]
CORRELATED = LINEITEM + ["y", "constant"]
CORRELATED_NUM = LINEITEM_NUM + ["y", "constant"]


def messy_lineitem(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return li.select(
        *LINEITEM[:6],
        F.when(F.col("l_discount") == F.lit(0.05), None).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_tax") == F.lit(0.0), None).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus", "l_shipdate",
        F.lit(None).cast("double").alias("empty_num"),
        F.when(F.col("l_quantity") == 1, F.col("l_returnflag")).alias("near_empty"),
    )


def messy_events(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events")
    return ev.select("*", F.concat(F.lit("$"), F.col("user_id").cast("string"), F.lit("%")).alias("money_text"))


def correlated(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return li.select(
        "*", (2 * F.col("l_quantity") + F.col("l_discount")).alias("y"), F.lit(5.0).cast("double").alias("constant")
    )


MESSY_SQL = """messy_lineitem AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         CASE WHEN l_discount = CAST(0.05 AS DOUBLE) THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_tax = CAST(0.0 AS DOUBLE) THEN NULL ELSE l_tax END AS l_tax,
         l_returnflag, l_linestatus, l_shipdate,
         CAST(NULL AS DOUBLE) AS empty_num,
         CASE WHEN l_quantity = 1 THEN l_returnflag END AS near_empty
  FROM lineitem)"""
MESSY_EVENTS_SQL = """messy_events AS (
  SELECT *, concat('$', CAST(user_id AS VARCHAR), '%') AS money_text FROM events)"""
CORRELATED_SQL = """correlated AS (
  SELECT *, 2 * l_quantity + l_discount AS y, CAST(5.0 AS DOUBLE) AS "constant" FROM lineitem)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _nz(expr: str) -> str:
    """Adding +0.0 turns a rounded -0.0 into 0.0 (Spark's round never
    returns a negative zero)."""
    return f"({expr} + CAST(0.0 AS DOUBLE))"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --------------------------------------------------------------------------
# SQL builders for the oracle (the same questions, written in DuckDB SQL)
# --------------------------------------------------------------------------

def _sql_missing(view: str, cols: list[str]) -> str:
    return _union([
        f"SELECT {i} AS position, '{c}' AS {_q('column')}, count(*) - count({_q(c)}) AS missing, "
        f"count(*) AS total FROM {view}"
        for i, c in enumerate(cols)
    ])


def _sql_describe(view: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CAST({_q(c)} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS {_q('column')}, count({v}) AS n, round(avg({v}), 4) AS mean, "
            f"round(quantile_cont({v}, 0.5), 4) AS median, "
            f"round(CASE WHEN count({v}) > 1 THEN stddev_samp({v}) ELSE CAST(0.0 AS DOUBLE) END, 4) AS std, "
            f"round(min({v}), 4) AS min, round(max({v}), 4) AS max FROM {view} HAVING count({v}) > 0"
        )
    return _union(parts)


def _sql_corr_value(a: str, b: str) -> str:
    x, y = f"CAST({_q(a)} AS DOUBLE)", f"CAST({_q(b)} AS DOUBLE)"
    r = f"corr({x}, {y})"
    return f"CASE WHEN count({x} + {y}) > 1 AND NOT isnan({r}) THEN {r} END"


def _sql_corr_matrix(view: str, cols: list[str], decimals: int) -> str:
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                r = f"CASE WHEN stddev_pop(CAST({_q(a)} AS DOUBLE)) > 0 THEN CAST(1.0 AS DOUBLE) END"
            else:
                r = _sql_corr_value(a, b)
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {_nz(f'round({r}, {decimals})')} AS r "
                         f"FROM {view}")
    return _union(parts)


def _sql_strong(view: str, cols: list[str]) -> str:
    pairs = [(i, j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    body = _union([
        f"SELECT {i} AS pa, {j} AS pb, '{a}' AS column_a, '{b}' AS column_b, "
        f"{_nz(f'round({_sql_corr_value(a, b)}, 3)')} AS r FROM {view}"
        for i, j, a, b in pairs
    ])
    return f"""WITH pr AS ({body})
    SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, pa, pb) AS INTEGER) AS rank, column_a, column_b, r,
           CASE WHEN r > 0 THEN 'positively' ELSE 'negatively' END AS direction,
           column_a || ' is ' || CASE WHEN r > 0 THEN 'positively' ELSE 'negatively' END
             || ' correlated with ' || column_b || ' (' || printf('%.2f', r) || ')' AS description
    FROM pr WHERE abs(r) >= 0.6"""


def _supplier_days(spark: SparkSession, sf_dir: str) -> Pivoted:
    """A wide table with gaps: a row for each shipping day, a column for each
    supplier with the quantity shipped that day."""
    cells = _t(spark, sf_dir, "lineitem").groupBy("l_shipdate", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    return Pivoted(cells, "l_shipdate", "l_suppkey", "quantity", "s{}")


SUPPLIER_PAIRS_SQL = """
    WITH d AS (SELECT l_shipdate AS day, 's' || l_suppkey AS c, CAST(sum(l_quantity) AS DOUBLE) AS v
               FROM lineitem GROUP BY ALL),
    names AS (SELECT c, CASE WHEN min(v) < max(v) THEN CAST(1.0 AS DOUBLE) END AS own FROM d GROUP BY c),
    p AS (SELECT a.c AS ca, b.c AS cb,
                 CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v)
                      THEN round(corr(a.v, b.v), 3) + 0.0 END AS r
          FROM d a JOIN d b ON a.day = b.day AND a.c <> b.c GROUP BY 1, 2)"""


def _sql_quartiles(view: str, cols: list[str]) -> str:
    return _union([
        f"SELECT '{c}' AS {_q('column')}, round(quantile_cont(CAST({_q(c)} AS DOUBLE), 0.25), 4) AS q1, "
        f"round(quantile_cont(CAST({_q(c)} AS DOUBLE), 0.5), 4) AS median, "
        f"round(quantile_cont(CAST({_q(c)} AS DOUBLE), 0.75), 4) AS q3 FROM {view}"
        for c in cols
    ])


def _sql_outliers(view: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CAST({_q(c)} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS {_q('column')}, CAST(count_if({v} < lo OR {v} > hi) AS BIGINT) AS count,
            round(count_if({v} < lo OR {v} > hi) / count({v}) * 100, 2) AS percentage,
            round(any_value(lo), 4) AS lower, round(any_value(hi), 4) AS upper
          FROM {view}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr
                        FROM (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {view}))
          HAVING count({v}) >= 4 AND any_value(iqr) <> 0 AND count_if({v} < lo OR {v} > hi) > 0""")
    return _union(parts)


def _sql_top(view: str, col: str, k: int, name: str = "value") -> str:
    return f"""SELECT {_q(col)} AS {_q(name)}, count(*) AS count,
          CAST(row_number() OVER (ORDER BY count(*) DESC, {_q(col)}) AS INTEGER) AS rank
        FROM {view} WHERE {_q(col)} IS NOT NULL GROUP BY {_q(col)}
        ORDER BY count DESC, {_q(name)} LIMIT {k}"""


def _sql_box(view: str, col: str, by: str | None) -> str:
    v = f"CAST({_q(col)} AS DOUBLE)"
    g = f"{_q(by)}, " if by else ""
    gb = f"GROUP BY {_q(by)}" if by else ""
    jn = f"USING ({_q(by)})" if by else "ON TRUE"
    wh = f"WHERE {v} IS NOT NULL" + (f" AND {_q(by)} IS NOT NULL" if by else "")
    return f"""WITH q AS (SELECT {g}quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS med,
                         quantile_cont({v}, 0.75) AS q3 FROM {view} {wh} {gb}),
      s AS (SELECT {g}count({v}) AS n, any_value(q1) AS q1, any_value(med) AS med, any_value(q3) AS q3,
                   max(CASE WHEN {v} <= q3 + 1.5 * (q3 - q1) THEN {v} END) AS hi_in,
                   min(CASE WHEN {v} >= q1 - 1.5 * (q3 - q1) THEN {v} END) AS lo_in,
                   CAST(count_if({v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS fliers
            FROM (SELECT * FROM {view} {wh}) AS base JOIN q {jn} {gb})
    SELECT {g}n, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
           round(CASE WHEN lo_in IS NULL OR lo_in > q1 THEN q1 ELSE lo_in END, 4) AS whisker_lo,
           round(CASE WHEN hi_in IS NULL OR hi_in < q3 THEN q3 ELSE hi_in END, 4) AS whisker_hi, fliers
    FROM s"""


def _sql_histogram(view: str, col: str) -> str:
    v = f"CAST({_q(col)} AS DOUBLE)"
    return f"""WITH vals AS (SELECT {v} AS v FROM {view} WHERE {v} IS NOT NULL),
      st AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                    CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi,
                    CAST(least(30, greatest(5, count(DISTINCT v))) AS INTEGER) AS nb, count(v) AS n FROM vals),
      est AS (SELECT v, least(CAST(trunc((v - lo) * (nb / (hi - lo))) AS INTEGER), nb - 1) AS i, lo, hi, nb
              FROM vals, st),
      bins AS (SELECT CASE
                 WHEN v < (CASE WHEN i = nb THEN hi ELSE i * ((hi - lo) / nb) + lo END) THEN i - 1
                 WHEN i <> nb - 1 AND v >= (CASE WHEN i + 1 = nb THEN hi ELSE (i + 1) * ((hi - lo) / nb) + lo END)
                   THEN i + 1
                 ELSE i END AS bin FROM est),
      counts AS (SELECT bin, count(*) AS count FROM bins GROUP BY bin),
      frame AS (SELECT CAST(b.range AS INTEGER) AS bin, lo, hi, nb FROM st, range(0, 30) AS b WHERE b.range < nb AND n > 0)
    SELECT frame.bin, frame.bin * ((hi - lo) / nb) + lo AS lo,
           CASE WHEN frame.bin + 1 = nb THEN hi ELSE (frame.bin + 1) * ((hi - lo) / nb) + lo END AS hi,
           coalesce(counts.count, 0) AS count
    FROM frame LEFT JOIN counts ON frame.bin = counts.bin"""


def _sql_numeric_as_text(view: str, cols: list[tuple[int, str]]) -> str:
    parts = []
    for pos, c in cols:
        s = f"CAST({_q(c)} AS VARCHAR)"
        like = f"regexp_matches(regexp_replace({s}, '[,$%\\s]', '', 'g'), '^-?\\d+\\.?\\d*$')"
        parts.append(f"""SELECT {pos} AS position, '{c}' AS {_q('column')}, count({s}) AS checked,
            CAST(count_if({like}) AS BIGINT) AS numeric_like, round(count_if({like}) / count({s}), 4) AS share,
            count_if({like}) / count({s}) > 0.8 AS flagged FROM {view} HAVING count({s}) > 0""")
    return _union(parts)


def _list_of(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "]::VARCHAR[], lambda x: x IS NOT NULL)"


def _sql_quality_report(view: str, cols: list[str], text_cols: list[str], n_num: int, n_cat: int, n_dt: int) -> str:
    cnt = ", ".join(f"count({_q(c)}) AS c{i}" for i, c in enumerate(cols))
    txt = ", ".join(
        f"count({_q(c)}) AS tn{i}, count_if(regexp_matches(regexp_replace(CAST({_q(c)} AS VARCHAR), "
        f"'[,$%\\s]', '', 'g'), '^-?\\d+\\.?\\d*$')) AS tk{i}"
        for i, c in enumerate(text_cols)
    )
    allc = ", ".join(_q(c) for c in cols)
    miss = " + ".join(f"(total - c{i})" for i in range(len(cols)))
    colsw = " + ".join(f"CAST(total - c{i} > 0 AS INTEGER)" for i in range(len(cols)))
    view_cte = f"{MESSY_SQL},\n" if view == "messy_lineitem" else ""
    return f"""WITH {view_cte}
      m AS (SELECT count(*) AS total, {cnt} FROM {view}),
      t AS (SELECT {txt} FROM {view}),
      d AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
            FROM (SELECT count(*) AS n FROM {view} GROUP BY {allc}))
    SELECT total AS total_rows, {len(cols)} AS total_columns, CAST({miss} AS BIGINT) AS missing_values,
      CAST({colsw} AS BIGINT) AS columns_with_missing,
      {_list_of([f"CASE WHEN total - c{i} > 0 THEN '{c}' END" for i, c in enumerate(cols)])} AS missing_columns,
      duplicates, {n_num} AS numeric_columns, {n_cat} AS categorical_columns, {n_dt} AS datetime_columns,
      {_list_of([f"CASE WHEN c{i} = 0 THEN '{c}' END" for i, c in enumerate(cols)])} AS empty_columns,
      {_list_of([f"CASE WHEN total > 0 AND (total - c{i}) / total >= 0.9 AND c{i} > 0 THEN '{c}' END"
                 for i, c in enumerate(cols)])} AS near_empty_columns,
      {_list_of([f"CASE WHEN tn{i} > 0 AND tk{i} / tn{i} > 0.8 THEN '{c}' END"
                 for i, c in enumerate(text_cols)])} AS suspected_numeric_as_text
    FROM m, t, d"""


def _sql_chart_plan(view: str, numeric: list[str], categorical: list[str], datetime: list[str]) -> str:
    """The automatic chart plan, derived from the table's counts."""
    facts = []
    for i, c in enumerate(numeric):
        pair = f"count({_q(datetime[0])} + INTERVAL 0 DAY) FILTER (WHERE {_q(c)} IS NOT NULL)" if datetime else "0"
        facts.append(f"SELECT 'numeric' AS kind, {i} AS pos, '{c}' AS name, count({_q(c)}) AS nn, "
                     f"CAST(NULL AS BIGINT) AS nd, {pair} AS pairs FROM {view}")
    for i, c in enumerate(categorical):
        facts.append(f"SELECT 'categorical', {i}, '{c}', count({_q(c)}), count(DISTINCT {_q(c)}), 0 FROM {view}")
    for i, c in enumerate(datetime):
        facts.append(f"SELECT 'datetime', {i}, '{c}', count({_q(c)}), NULL, 0 FROM {view}")
    return f"""SELECT * FROM (WITH facts AS ({_union(facts)}),
      num AS (SELECT name, pairs, row_number() OVER (ORDER BY pos) AS k FROM facts WHERE kind = 'numeric' AND nn > 0),
      cat AS (SELECT name, nd, row_number() OVER (ORDER BY pos) AS k FROM facts WHERE kind = 'categorical' AND nn > 0),
      dt AS (SELECT name FROM facts WHERE kind = 'datetime' ORDER BY pos LIMIT 1),
      pie AS (SELECT name FROM cat WHERE nd BETWEEN 2 AND 8 ORDER BY k LIMIT 1),
      rows_ AS (
        SELECT 1 AS grp, k AS sub, 'Histogram' AS chart_type, name AS x_axis, 'Frequency' AS y_axis, name AS c
          FROM num WHERE k <= 4
        UNION ALL SELECT 2, k, 'Bar Chart', 'Count', name, name FROM cat WHERE k <= 3
        UNION ALL SELECT 3, 1, 'Pie Chart', NULL, NULL, name FROM pie
        UNION ALL SELECT 4, 1, 'Trend Line', dt.name, num.name, NULL FROM dt, num WHERE num.k = 1 AND num.pairs > 0
        UNION ALL SELECT 5, 1, 'Correlation Heatmap', NULL, NULL, NULL FROM (SELECT count(*) AS m FROM num) WHERE m >= 2)
    SELECT CAST(row_number() OVER (ORDER BY grp, sub) AS INTEGER) AS chart_id, chart_type, x_axis, y_axis,
           c AS {_q('column')} FROM rows_)"""


def _values(names: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + ")"


def _sql_findings_base(view: str, columns: list[str], numeric: list[str], categorical: list[str],
                       datetime: list[str]) -> str:
    """CTEs shared by the findings oracles: plan, strong, outliers, chart
    columns."""
    real = ", ".join(f"'{c}'" for c in columns)
    return f""", plan AS ({_sql_chart_plan(view, numeric, categorical, datetime)}),
      st AS (SELECT * FROM ({_sql_strong(view, numeric)})),
      ol AS (SELECT * FROM ({_sql_outliers(view, numeric)})),
      cand AS (SELECT chart_id, 1 AS o, {_q('column')} AS name FROM plan
               UNION ALL SELECT chart_id, 2, x_axis FROM plan UNION ALL SELECT chart_id, 3, y_axis FROM plan),
      kept AS (SELECT chart_id, name, min(o) AS o FROM cand
               WHERE name IS NOT NULL AND (name NOT IN ('Frequency', 'Count') OR name IN ({real}))
               GROUP BY chart_id, name),
      cc AS (SELECT chart_id, CAST(row_number() OVER (PARTITION BY chart_id ORDER BY o) - 1 AS INTEGER) AS position,
                    name AS {_q('column')} FROM kept)
    """


def _sql_follow_ups(view: str, columns: list[str], numeric: list[str], categorical: list[str],
                    datetime: list[str]) -> str:
    d = datetime[0] if datetime else None
    v = numeric[0] if numeric else None
    parts = ["""SELECT 1 AS rule, rank AS sub, 'scatter' AS chart_type, column_a AS x_column, column_b AS y_column,
              CAST(NULL AS VARCHAR) AS c, column_a || ' vs ' || column_b AS title,
              'scatter plot between ' || column_a || ' and ' || column_b AS chart_request FROM st WHERE rank <= 2"""]
    if d and numeric:
        parts.append(f"""SELECT * FROM (SELECT 2, 1, 'line', '{d}', name, CAST(NULL AS VARCHAR),
              name || ' Trend Over Time', 'line chart between {d} and ' || name
            FROM {_values(numeric)} AS numl(pos, name) WHERE name NOT IN (SELECT name FROM charted)
            ORDER BY pos LIMIT 1)""")
    if categorical and numeric:
        parts.append(f"""SELECT * FROM (SELECT 3, 1, 'bar', name, '{v}', CAST(NULL AS VARCHAR),
              '{v} by ' || name, 'bar chart comparing ' || name || ' and {v}'
            FROM {_values(categorical)} AS catl(pos, name) WHERE name NOT IN (SELECT name FROM charted)
            ORDER BY pos LIMIT 1)""")
    if numeric:
        parts.append(f"""SELECT * FROM (SELECT 4, 1, 'box', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
              ol.{_q('column')}, ol.{_q('column')} || ' Outlier Review', 'boxplot for ' || ol.{_q('column')}
            FROM ol JOIN {_values(numeric)} AS numl(pos, name) ON ol.{_q('column')} = numl.name
            WHERE percentage >= 5 ORDER BY pos LIMIT 1)""")
    if len(numeric) >= 3:
        parts.append("""SELECT 5, 1, 'heatmap', NULL, NULL, NULL, 'Full Correlation Overview',
              'correlation heatmap for all numeric columns'""")
    return f"""{_sql_findings_base(view, columns, numeric, categorical, datetime)},
      charted AS (SELECT DISTINCT name FROM cand WHERE name IS NOT NULL),
      allr AS ({_union(parts)})
    SELECT CAST(row_number() OVER (ORDER BY rule, sub) AS INTEGER) AS rank, rule, chart_type, x_column, y_column,
           c AS {_q('column')}, title, chart_request FROM allr ORDER BY rule, sub LIMIT 5"""


def _sql_observations(view: str, columns: list[str], numeric: list[str], categorical: list[str],
                      datetime: list[str]) -> str:
    return f"""{_sql_findings_base(view, columns, numeric, categorical, datetime)},
      co AS (SELECT DISTINCT p.chart_id, s.rank AS ord,
                    upper(substr(s.description, 1, 1)) || lower(substr(s.description, 2)) || '.' AS text
             FROM (SELECT DISTINCT chart_id FROM cc) AS p JOIN st AS s ON s.rank <= 2
             WHERE EXISTS (SELECT 1 FROM cc WHERE cc.chart_id = p.chart_id
                           AND (cc.{_q('column')} = s.column_a OR cc.{_q('column')} = s.column_b))),
      oo AS (SELECT cc.chart_id, 100 + cc.position AS ord,
                    cc.{_q('column')} || ' has ' || CAST(ol.count AS VARCHAR) || ' outlier value(s) ('
                      || CAST(ol.percentage AS VARCHAR) || '% of records).' AS text
             FROM cc JOIN ol ON cc.{_q('column')} = ol.{_q('column')}),
      found AS (SELECT * FROM co UNION ALL SELECT * FROM oo),
      allo AS (SELECT * FROM found
               UNION ALL SELECT chart_id, 0, '{findings.NO_OBSERVATION}' FROM plan
               WHERE chart_id NOT IN (SELECT chart_id FROM found))
    SELECT chart_id, CAST(row_number() OVER (PARTITION BY chart_id ORDER BY ord) AS INTEGER) AS rank, text
    FROM allo"""


# --------------------------------------------------------------------------
# Queries
# --------------------------------------------------------------------------

def _csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"csv-{uuid.uuid4().hex}.csv")
    write_result(_t(spark, d, "part"), path, fmt="csv")
    return load_dataset(spark, path)


def _csv_line_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with line breaks and quotes, written as CSV and read back
    in records, one row a document."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}.csv")
    write_result(_t(spark, d, "documents").select("doc_id", "text"), path, fmt="csv")
    back = load_dataset(spark, path)
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"),
                                      F.max(F.md5("text")).alias("digest"))


def _csv_odd(spark: SparkSession, d: str) -> DataFrame:
    """Null tokens, codes that look like numbers, and quoted line breaks,
    written as CSV and read back."""
    even = F.col("p_size") % 2 == 0
    table = _t(spark, d, "part").select(
        "p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("D")).alias("code"),
        F.when(even, "N/A").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.concat(F.col("p_name"), F.lit('\n"'), F.col("p_brand"), F.lit('", new')).alias("note"),
        F.when(even, "null").otherwise(F.col("p_type")).alias("type"))
    path = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}.csv")
    table.write.option("header", True).option("escape", '"').csv(path)
    return load_dataset(spark, path)


def _csv_latin1(spark: SparkSession, d: str) -> DataFrame:
    """All documents, written as ISO-8859-1 and read without naming it."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}.csv")
    _t(spark, d, "documents").write.option("header", True).option("escape", '"').option(
        "encoding", "ISO-8859-1").csv(path)
    return load_dataset(spark, path, infer_dates=False)


def _clashing(spark: SparkSession, d: str) -> DataFrame:
    """lineitem under the names that operators use themselves."""
    return _t(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("n"), F.col("l_linestatus").alias("count"), F.col("l_suppkey").alias("value"),
        F.col("l_linenumber").alias("p"), F.col("l_quantity").alias("_h"), F.col("l_tax").alias("v"))


def _tails(spark: SparkSession, d: str) -> DataFrame:
    """A heavy tail with infinities at one end."""
    price = F.col("l_extendedprice")
    return _t(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 100 == 7, F.lit(float("inf"))).otherwise(
        price * price * price * price).alias("tail"), "l_quantity")


def _unbounded(spark: SparkSession, d: str) -> DataFrame:
    return correlated(spark, d).withColumn(
        "k", F.when(F.col("l_orderkey") == 1, F.lit(float("inf"))).otherwise(F.col("l_quantity")))


def _profile_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile of lineitem, charts included, in long form: its
    report, coefficients, strong pairs, top values and histogram bins."""
    prof = profile(_t(spark, d, "lineitem"))
    long = lambda df, section, column, metric, value: df.select(
        F.lit(section).alias("section"), F.col(column).alias("column"), metric.cast("string").alias("metric"),
        F.col(value).cast("double").alias("value"))
    out = prof.report()
    out = out.unionByName(long(prof.correlations, "correlation", "column_a", F.col("column_b"), "r"))
    out = out.unionByName(long(prof.strong, "strong", "column_a", F.col("column_b"), "r"))
    out = out.unionByName(long(prof.top_values, "top", "column", F.col("value"), "count"))
    for chart in prof.chart_plan.where("chart_type = 'Histogram'").collect():  # at most four
        bins = prof.charts[chart["chart_id"]].withColumn("name", F.lit(chart["column"]))
        out = out.unionByName(long(bins, "bin", "name", F.col("bin"), "count"))
    return out


def _describe_single_value(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    top = li.agg(F.max("l_extendedprice")).scalar()
    return stats.describe(li.select(
        "l_quantity", F.when(F.col("l_extendedprice") == top, F.col("l_extendedprice")).alias("top_price")))


def _observations(df: DataFrame) -> DataFrame:
    plan, strong, outliers = findings.shared_inputs(df)
    return findings.chart_observations(plan, df.columns, strong, outliers)


def _q_messy(fn):
    return lambda spark, d: fn(messy_lineitem(spark, d))


def _table_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _t
    return {
        # shape and classes
        "dataset_shape": lambda s, d: shape_frame(t(s, d, "orders")),
        # quality
        "missing_by_column": _q_messy(quality.missing_by_column),
        "missing_total": _q_messy(quality.missing_total),
        "empty_columns": _q_messy(quality.empty_columns),
        "near_empty_columns": _q_messy(quality.near_empty_columns),
        "drop_empty_columns": _q_messy(quality.drop_empty_columns),
        "duplicate_rows": lambda s, d: quality.duplicate_rows(t(s, d, "documents").select("text", "lang", "source")),
        "duplicate_rows_lineitem": lambda s, d: quality.duplicate_rows(
            t(s, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag")),
        "dedup_rows": lambda s, d: quality.dedup_rows(
            messy_lineitem(s, d).select("l_quantity", "l_discount", "l_returnflag", "empty_num")),
        "numeric_as_text": lambda s, d: quality.numeric_as_text(messy_events(s, d)),
        "numeric_as_text_first": lambda s, d: quality.numeric_as_text(messy_events(s, d), sample_rows=50, order_by=["event_id"]),
        "quality_report": _q_messy(quality.quality_report),
        "quality_issues": _q_messy(quality.quality_issues),
        # statistics
        "describe_lineitem": lambda s, d: stats.describe(t(s, d, "lineitem")),
        "describe_with_nulls": _q_messy(stats.describe),
        "describe_single_value": _describe_single_value,
        "correlation_matrix": lambda s, d: stats.correlation_matrix(t(s, d, "lineitem")),
        "correlation_with_nulls": _q_messy(stats.correlation_matrix),
        "correlation_constant": lambda s, d: stats.correlation_matrix(correlated(s, d)),
        "strong_correlations": lambda s, d: stats.strong_correlations(correlated(s, d)),
        "quartiles": lambda s, d: stats.quartiles(t(s, d, "events")).select(
            "column", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")]),
        "iqr_outliers": lambda s, d: stats.iqr_outliers(t(s, d, "events")),
        "iqr_outliers_orders": lambda s, d: stats.iqr_outliers(t(s, d, "orders")),
        "distinct_counts": lambda s, d: stats.distinct_counts(t(s, d, "orders")),
        "column_roles": lambda s, d: stats.column_roles(t(s, d, "orders")),
        "top_values_all": lambda s, d: stats.top_values(t(s, d, "orders")),
        "top_n_values": lambda s, d: ask.top_n_values(t(s, d, "part"), "p_brand", 5),
        # chart data
        "histogram_value": lambda s, d: charts.histogram(t(s, d, "events"), "value"),
        "histogram_constant": lambda s, d: charts.histogram(correlated(s, d), "constant"),
        "bar_counts": lambda s, d: charts.bar_counts(t(s, d, "part"), "p_brand"),
        "bar_mean_by_category": lambda s, d: charts.bar_mean_by_category(
            t(s, d, "lineitem"), "l_returnflag", "l_extendedprice"),
        "bar_mean_with_missing": lambda s, d: charts.bar_mean_by_category(
            messy_lineitem(s, d), "l_linenumber", "empty_num"),
        "pie_auto": lambda s, d: charts.pie_shares(
            t(s, d, "orders"), charts.auto_pie_column(t(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])),
        "pie_top_shares": lambda s, d: charts.pie_shares(t(s, d, "part"), "p_brand"),
        "trend": lambda s, d: charts.trend_series(t(s, d, "orders"), "o_orderdate", "o_orderkey"),
        "line_series": lambda s, d: charts.line_series(t(s, d, "events"), "ts", "value"),
        "area_series": lambda s, d: charts.area_series(t(s, d, "orders"), "o_orderdate", "o_totalprice"),
        "scatter_pairs": lambda s, d: charts.scatter_pairs(t(s, d, "events"), "user_id", "value"),
        "scatter_sample_rows": lambda s, d: charts.scatter_pairs(
            t(s, d, "events"), "user_id", "value", sample_rows=1000, key=["event_id"]),
        "scatter_sample_fraction": lambda s, d: charts.scatter_pairs(
            t(s, d, "lineitem"), "l_quantity", "l_tax", sample_fraction=0.1, key=["l_orderkey", "l_linenumber"]),
        "box_summary": lambda s, d: charts.box_summary(t(s, d, "lineitem"), "l_extendedprice"),
        "box_by_group": lambda s, d: charts.box_summary(t(s, d, "lineitem"), "l_extendedprice", by="l_returnflag"),
        "heatmap": lambda s, d: charts.heatmap(t(s, d, "lineitem"), decimals=6),
        "chart_plan": lambda s, d: chart_plan(t(s, d, "orders")),
        "chart_request_box": lambda s, d: chart_data(
            t(s, d, "lineitem"), ChartSpec("box", x_column="l_returnflag", column="l_tax"))[1],
        "chart_request_bar": lambda s, d: chart_data(
            t(s, d, "orders"), ChartSpec("bar", x_column="o_orderpriority", y_column="o_totalprice"))[1],
        "chart_request_histogram": lambda s, d: chart_data(
            t(s, d, "lineitem"), ChartSpec("histogram", column="l_quantity"))[1],
        # questions
        "sum_by_group": lambda s, d: ask.shape_result(
            ask.sum_by_group(t(s, d, "lineitem"), "l_returnflag", "l_extendedprice")),
        "count_by_group": lambda s, d: ask.count_by_group(t(s, d, "orders"), "o_orderpriority"),
        "sum_by_two_keys": lambda s, d: ask.shape_result(
            ask.group_agg(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "sum")),
        "median_by_group": lambda s, d: ask.shape_result(
            ask.group_agg(t(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "median")),
        "mean_by_group": lambda s, d: ask.shape_result(
            ask.group_agg(t(s, d, "orders"), ["o_orderpriority"], "o_totalprice", "mean")),
        "max_by_two_keys": lambda s, d: ask.group_agg(
            t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "max"),
        "count_by_two_keys": lambda s, d: ask.group_agg(
            t(s, d, "lineitem"), ["l_returnflag", "l_shipdate"], "l_orderkey", "count"),
        "top_n_numeric": lambda s, d: ask.top_n_values(t(s, d, "lineitem"), "l_quantity", 7),
        "nunique_by_group": lambda s, d: ask.group_agg(t(s, d, "orders"), ["o_orderstatus"], "o_custkey", "nunique"),
        "argmax_group": lambda s, d: ask.shape_result(
            ask.argmax_group(t(s, d, "lineitem"), "l_returnflag", "l_extendedprice")),
        "best_month": lambda s, d: ask.shape_result(ask.best_month(t(s, d, "orders"), "o_orderdate", "o_totalprice")),
        "avg_col": lambda s, d: ask.shape_result(ask.avg_col(t(s, d, "orders"), "o_totalprice")),
        "max_col": lambda s, d: ask.max_col(t(s, d, "orders"), "o_totalprice"),
        "min_col": lambda s, d: ask.min_col(t(s, d, "orders"), "o_totalprice"),
        "row_count": lambda s, d: ask.row_count(t(s, d, "orders")),
        "count_above": lambda s, d: ask.count_above(t(s, d, "orders"), "o_totalprice", 250000),
        "rows_above": lambda s, d: ask.rows_above(t(s, d, "orders"), "o_totalprice", 450000),
        "capped_result": lambda s, d: ask.capped(t(s, d, "orders"), ["o_orderkey"]),
        "shaped_result": lambda s, d: ask.shape_result(t(s, d, "orders")),
        # previews
        "sample_values": lambda s, d: preview.sample_values(t(s, d, "part"), ["p_partkey"]),
        "preview": lambda s, d: preview.preview(t(s, d, "part"), ["p_partkey"]),
        # findings
        "key_findings": lambda s, d: findings.key_findings(correlated(s, d)),
        "follow_ups": lambda s, d: findings.follow_ups(correlated(s, d)),
        "follow_ups_orders": lambda s, d: findings.follow_ups(t(s, d, "orders")),
        "chart_observations": lambda s, d: _observations(correlated(s, d)),
        "chart_observations_events": lambda s, d: _observations(t(s, d, "events")),
        "chart_columns": lambda s, d: findings.chart_columns(chart_plan(correlated(s, d)), CORRELATED),
        "chart_plan_messy": lambda s, d: chart_plan(messy_lineitem(s, d)),
        "headline": lambda s, d: findings.headline(correlated(s, d)),
        "profile_report": lambda s, d: profile(t(s, d, "events"), with_charts=False).report(),
        # other tables: whole document texts, customers, conversations
        "quality_report_documents": lambda s, d: quality.quality_report(t(s, d, "documents")),
        "top_values_documents": lambda s, d: stats.top_values(t(s, d, "documents")),
        "numeric_as_text_conversations": lambda s, d: quality.numeric_as_text(t(s, d, "conversations")),
        "describe_customer": lambda s, d: stats.describe(t(s, d, "customer")),
        "box_by_segment": lambda s, d: charts.box_summary(t(s, d, "customer"), "c_acctbal", by="c_mktsegment"),
        "correlation_customer": lambda s, d: stats.correlation_matrix(t(s, d, "customer")),
        "correlation_wide": lambda s, d: stats.correlation_matrix(_supplier_days(s, d)),
        "strong_correlations_wide": lambda s, d: stats.strong_correlations(_supplier_days(s, d), 0.25).select(
            "column_a", "column_b", "r", "direction", "description"),
        "sum_by_role": lambda s, d: ask.group_agg(t(s, d, "conversations"), ["role"], "turn", "sum"),
        # sources
        "top_texts": lambda s, d: stats.value_counts(t(s, d, "documents"), "text", 10),
        "top_keys": lambda s, d: ask.top_n_values(t(s, d, "lineitem").select(
            F.col("l_partkey").cast("string").alias("part")), "part", 10),
        "dedup_documents": lambda s, d: quality.dedup_rows(t(s, d, "documents").select("text", "lang", "source")),
        "distinct_lineitem": lambda s, d: stats.distinct_counts(t(s, d, "lineitem")),
        "median_by_flag_status": lambda s, d: ask.shape_result(
            ask.group_agg(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "median")),
        "csv_line_breaks": _csv_line_breaks,
        "csv_roundtrip": _csv_roundtrip,
        "csv_odd_values": _csv_odd,
        "csv_latin1": _csv_latin1,
        "clash_duplicates": lambda s, d: quality.duplicate_rows(_clashing(s, d)),
        "clash_count": lambda s, d: ask.count_by_group(_clashing(s, d), "n"),
        "clash_median": lambda s, d: ask.shape_result(ask.group_agg(_clashing(s, d), ["value"], "v", "median")),
        "clash_box": lambda s, d: charts.box_summary(_clashing(s, d), "_h", by="p"),
        "median_by_partkey": lambda s, d: ask.shape_result(
            ask.group_agg(t(s, d, "lineitem"), ["l_partkey"], "l_extendedprice", "median")),
        "box_by_suppkey": lambda s, d: charts.box_summary(t(s, d, "lineitem"), "l_extendedprice", by="l_suppkey"),
        "quartiles_heavy_tail": lambda s, d: stats.quartiles(_tails(s, d)),
        "strong_correlations_infinity": lambda s, d: stats.strong_correlations(_unbounded(s, d)),
        "sum_by_group_large": lambda s, d: ask.sum_by_group(t(s, d, "lineitem").select(
            "l_returnflag", (F.col("l_orderkey") + F.lit(1 << 62)).alias("big")), "l_returnflag", "big"),
        "quality_columns": _q_messy(quality.quality_columns),
        "answer_kind": lambda s, d: answer_kind(ask.count_by_group(t(s, d, "orders"), "o_orderstatus"), 1).unionAll(
            answer_kind(ask.row_count(t(s, d, "orders")))),
        "profile_rows": _profile_rows,
    }


def _sql_profile_rows() -> str:
    """The long form of lineitem's profile from the single oracles."""
    cells = [("describe", m, _sql_describe("lineitem", LINEITEM_NUM), _q("column"), f"'{m}'", m)
             for m in ("n", "mean", "median", "std", "min", "max")]
    cells += [("missing", "", _sql_missing("lineitem", LINEITEM), _q("column"), "'missing'", "missing")]
    cells += [("outliers", m, _sql_outliers("lineitem", LINEITEM_NUM), _q("column"), f"'{m}'", m)
              for m in ("count", "percentage")]
    cells += [("correlation", "", _sql_corr_matrix("lineitem", LINEITEM_NUM, 3), "column_a", "column_b", "r"),
              ("strong", "", _sql_strong("lineitem", LINEITEM_NUM), "column_a", "column_b", "r")]
    cells += [("top", "", _sql_top("lineitem", c, 5), f"'{c}'", "value", "count") for c in ("l_returnflag", "l_linestatus")]
    cells += [("bin", "", _sql_histogram("lineitem", c), f"'{c}'", "bin", "count") for c in LINEITEM_NUM[:4]]
    return _union([f"SELECT '{section}' AS section, {column} AS {_q('column')}, CAST({metric} AS VARCHAR) AS metric, "
                   f"CASE WHEN {value} = 0 THEN 0.0 ELSE CAST({value} AS DOUBLE) END AS value FROM ({sql})" for section, _, sql, column, metric, value in cells])


def _table_oracle_sql() -> dict[str, str]:
    m = _with(MESSY_SQL)
    corr = _with(CORRELATED_SQL)
    return {
        "dataset_shape": 'SELECT count(*) AS "rows", 6 AS "columns", 3 AS numeric_columns, '
                         '2 AS categorical_columns, 1 AS datetime_columns FROM orders',
        "missing_by_column": m + _sql_missing("messy_lineitem", MESSY),
        "missing_total": m + f""", mc AS ({_sql_missing('messy_lineitem', MESSY)})
            SELECT CAST(coalesce(sum(missing), 0) AS BIGINT) AS missing_values,
                   CAST(count_if(missing > 0) AS BIGINT) AS columns_with_missing FROM mc""",
        "empty_columns": m + f""", mc AS ({_sql_missing('messy_lineitem', MESSY)})
            SELECT position, {_q('column')} FROM mc WHERE missing = total""",
        "near_empty_columns": m + f""", mc AS ({_sql_missing('messy_lineitem', MESSY)})
            SELECT position, {_q('column')}, round(missing / total, 4) AS missing_share FROM mc
            WHERE total > 0 AND missing / total >= 0.9 AND missing / total < 1.0""",
        "drop_empty_columns": m + "SELECT " + ", ".join(c for c in MESSY if c != "empty_num") + " FROM messy_lineitem",
        "duplicate_rows": """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
            FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)""",
        "duplicate_rows_lineitem": """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
            FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_returnflag)""",
        "dedup_rows": m + "SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM messy_lineitem",
        "numeric_as_text": _with(MESSY_EVENTS_SQL) + _sql_numeric_as_text(
            "messy_events", [(3, "event_type"), (5, "props"), (6, "money_text")]),
        "numeric_as_text_first": _with(MESSY_EVENTS_SQL)
        + ", first_events AS (SELECT * FROM messy_events ORDER BY event_id LIMIT 50) " + _sql_numeric_as_text(
            "first_events", [(3, "event_type"), (5, "props"), (6, "money_text")]),
        "quality_report": _sql_quality_report(
            "messy_lineitem", MESSY, ["l_returnflag", "l_linestatus", "near_empty"], 9, 3, 1),
        "quality_issues": f"""WITH r AS ({_sql_quality_report(
            'messy_lineitem', MESSY, ['l_returnflag', 'l_linestatus', 'near_empty'], 9, 3, 1)}),
          issues AS (
            SELECT 1 AS rank, 'missing_values' AS issue, missing_columns AS columns, missing_values AS n,
                   printf('Fill or drop %d missing values across %d column(s).', missing_values,
                          columns_with_missing) AS message FROM r WHERE missing_values > 0
            UNION ALL
            SELECT 2, 'duplicates', []::VARCHAR[], duplicates, printf('Remove %d duplicate row(s).', duplicates)
              FROM r WHERE duplicates > 0
            UNION ALL
            SELECT 3, 'empty_columns', empty_columns, CAST(len(empty_columns) AS BIGINT),
                   'Drop fully empty column(s): ' || array_to_string(empty_columns, ', ') || '.'
              FROM r WHERE len(empty_columns) > 0
            UNION ALL
            SELECT 4, 'near_empty_columns', near_empty_columns, CAST(len(near_empty_columns) AS BIGINT),
                   'Review near-empty column(s) (>90% missing): ' || array_to_string(near_empty_columns, ', ') || '.'
              FROM r WHERE len(near_empty_columns) > 0
            UNION ALL
            SELECT 5, 'numeric_as_text', suspected_numeric_as_text, CAST(len(suspected_numeric_as_text) AS BIGINT),
                   'Convert text-formatted numeric column(s) to numeric type: '
                     || array_to_string(suspected_numeric_as_text, ', ') || '.'
              FROM r WHERE len(suspected_numeric_as_text) > 0)
          SELECT * FROM issues
          UNION ALL
          SELECT 0, 'no_issues', []::VARCHAR[], CAST(0 AS BIGINT), 'No major data quality issues detected.'
          WHERE NOT EXISTS (SELECT 1 FROM issues)""",
        "describe_lineitem": _sql_describe("lineitem", LINEITEM_NUM),
        "describe_with_nulls": m + _sql_describe("messy_lineitem", MESSY_NUM),
        "describe_single_value": """WITH v AS (SELECT l_quantity, CASE WHEN l_extendedprice =
              (SELECT max(l_extendedprice) FROM lineitem) THEN l_extendedprice END AS top_price FROM lineitem)
            """ + _sql_describe("v", ["l_quantity", "top_price"]),
        "correlation_matrix": _sql_corr_matrix("lineitem", LINEITEM_NUM, 3),
        "correlation_with_nulls": m + _sql_corr_matrix("messy_lineitem", LINEITEM_NUM, 3),
        "correlation_constant": corr + _sql_corr_matrix("correlated", CORRELATED_NUM, 3),
        "strong_correlations": corr + "SELECT * FROM (" + _sql_strong("correlated", CORRELATED_NUM) + ")",
        "quartiles": _sql_quartiles("events", ["event_id", "user_id", "value"]),
        "iqr_outliers": _sql_outliers("events", ["event_id", "user_id", "value"]),
        "iqr_outliers_orders": _sql_outliers("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
        "distinct_counts": _union([
            f"SELECT '{c}' AS {_q('column')}, count(DISTINCT {c}) AS {_q('distinct')} FROM orders" for c in ORDERS
        ]),
        "column_roles": _union([
            f"""SELECT '{c}' AS {_q('column')}, 'numeric' AS class, CAST(min({c}) AS DOUBLE) AS min,
                CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS BIGINT) AS {_q('distinct')},
                'A numeric measure ranging from ' || printf('%.2f', CAST(min({c}) AS DOUBLE)) || ' to '
                  || printf('%.2f', CAST(max({c}) AS DOUBLE)) || '.' AS description FROM orders"""
            for c in ("o_orderkey", "o_custkey", "o_totalprice")
        ] + [
            f"""SELECT '{c}', 'categorical', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), count(DISTINCT {c}),
                'A categorical field with ' || count(DISTINCT {c}) || ' distinct value(s).' FROM orders"""
            for c in ("o_orderstatus", "o_orderpriority")
        ] + [
            """SELECT 'o_orderdate', 'datetime', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT),
                'A date/time field used to track values over time.' FROM (SELECT count(*) FROM orders)"""
        ]),
        "top_values_all": f"""SELECT * FROM (
            SELECT c AS {_q('column')}, v AS value, count(*) AS count,
                   CAST(row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS INTEGER) AS rank
            FROM (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders
                  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
            WHERE v IS NOT NULL GROUP BY c, v) WHERE rank <= 5""",
        "top_n_values": """SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL
            GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 5""",
        "histogram_value": _sql_histogram("events", "value"),
        "histogram_constant": corr + "SELECT * FROM (" + _sql_histogram("correlated", "constant") + ")",
        "bar_counts": _sql_top("part", "p_brand", 10),
        "bar_mean_by_category": """SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean_y,
              CAST(row_number() OVER (ORDER BY avg(l_extendedprice) DESC NULLS LAST, l_returnflag) AS INTEGER)
                AS rank
            FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
            ORDER BY avg(l_extendedprice) DESC NULLS LAST, l_returnflag LIMIT 15""",
        "bar_mean_with_missing": m + """SELECT l_linenumber, round(avg(empty_num), 4) AS mean_y,
              CAST(row_number() OVER (ORDER BY avg(empty_num) DESC NULLS LAST, l_linenumber) AS INTEGER) AS rank
            FROM messy_lineitem WHERE l_linenumber IS NOT NULL GROUP BY l_linenumber
            ORDER BY avg(empty_num) DESC NULLS LAST, l_linenumber LIMIT 15""",
        "pie_auto": f"""WITH vc AS ({_sql_top('orders', 'o_orderstatus', 8)})
            SELECT value, count, round(count * 100.0 / (SELECT sum(count) FROM vc), 1) AS share, rank FROM vc""",
        "pie_top_shares": f"""WITH vc AS ({_sql_top('part', 'p_brand', 8)})
            SELECT value, count, round(count * 100.0 / (SELECT sum(count) FROM vc), 1) AS share, rank FROM vc""",
        "trend": """SELECT o_orderdate, o_orderkey FROM orders
            WHERE o_orderdate IS NOT NULL AND o_orderkey IS NOT NULL ORDER BY o_orderdate""",
        "line_series": "SELECT ts, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL ORDER BY ts",
        "area_series": """SELECT o_orderdate, o_totalprice FROM orders
            WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY o_orderdate""",
        "scatter_pairs": "SELECT user_id, value FROM events",
        "scatter_sample_rows": "SELECT user_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 1000",
        "scatter_sample_fraction": """SELECT l_quantity, l_tax FROM lineitem
              WHERE substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)), 1, 8) < '19999999'""",
        "box_summary": _sql_box("lineitem", "l_extendedprice", None),
        "box_by_group": _sql_box("lineitem", "l_extendedprice", "l_returnflag"),
        "heatmap": _sql_corr_matrix("lineitem", LINEITEM_NUM, 6),
        "chart_plan": _sql_chart_plan("orders", ["o_orderkey", "o_custkey", "o_totalprice"],
                                      ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]),
        "chart_request_box": _sql_box("lineitem", "l_tax", "l_returnflag"),
        "chart_request_bar": """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_y,
              CAST(row_number() OVER (ORDER BY avg(o_totalprice) DESC NULLS LAST, o_orderpriority) AS INTEGER)
                AS rank
            FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
            ORDER BY avg(o_totalprice) DESC NULLS LAST, o_orderpriority LIMIT 15""",
        "chart_request_histogram": _sql_histogram("lineitem", "l_quantity"),
        "sum_by_group": """SELECT l_returnflag, round(coalesce(sum(l_extendedprice), 0), 4) AS l_extendedprice
            FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 20""",
        "count_by_group": """SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL
            GROUP BY o_orderpriority ORDER BY count DESC, o_orderpriority LIMIT 20""",
        "sum_by_two_keys": """SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_quantity), 0), 4) AS l_quantity
            FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
            GROUP BY l_returnflag, l_linestatus""",
        "median_by_group": """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice
            FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""",
        "mean_by_group": """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice FROM orders
            WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""",
        "max_by_two_keys": """SELECT l_returnflag, l_linestatus, max(l_extendedprice) AS l_extendedprice FROM lineitem
            WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY l_returnflag, l_linestatus""",
        "count_by_two_keys": """SELECT l_returnflag, l_shipdate, count(l_orderkey) AS l_orderkey FROM lineitem
            WHERE l_returnflag IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY l_returnflag, l_shipdate""",
        "top_n_numeric": """SELECT l_quantity, count(*) AS count FROM lineitem WHERE l_quantity IS NOT NULL
            GROUP BY l_quantity ORDER BY count DESC, l_quantity LIMIT 7""",
        "nunique_by_group": """SELECT o_orderstatus, count(DISTINCT o_custkey) AS o_custkey FROM orders
            WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""",
        "argmax_group": """SELECT l_returnflag, round(coalesce(sum(l_extendedprice), 0), 4) AS total FROM lineitem
            WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
            ORDER BY coalesce(sum(l_extendedprice), 0) DESC, l_returnflag LIMIT 1""",
        "best_month": """SELECT strftime(o_orderdate, '%Y-%m') AS month, round(coalesce(sum(o_totalprice), 0), 4) AS total
            FROM orders WHERE o_orderdate IS NOT NULL GROUP BY month
            ORDER BY coalesce(sum(o_totalprice), 0) DESC, month LIMIT 1""",
        "avg_col": "SELECT round(avg(o_totalprice), 4) AS value FROM orders",
        "max_col": "SELECT max(o_totalprice) AS value FROM orders",
        "min_col": "SELECT min(o_totalprice) AS value FROM orders",
        "row_count": 'SELECT count(*) AS "rows" FROM orders',
        "count_above": "SELECT CAST(count_if(o_totalprice > 250000) AS BIGINT) AS count FROM orders",
        "rows_above": "SELECT * FROM orders WHERE o_totalprice > 450000",
        "capped_result": """SELECT *, (SELECT count(*) > 200 FROM (SELECT 1 FROM orders LIMIT 201)) AS truncated
            FROM orders ORDER BY o_orderkey LIMIT 200""",
        "shaped_result": """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice,
            strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
        "sample_values": f"""WITH long AS (
              {_union([f"SELECT {i} AS position, '{c}' AS {_q('column')}, '{tp}' AS dtype, p_partkey AS k, "
                       f"CAST({c} AS VARCHAR) AS value FROM part WHERE {c} IS NOT NULL"
                       for i, (c, tp) in enumerate(zip(PART, ['bigint', 'string', 'string', 'string', 'int',
                                                              'double']))])}),
            firsts AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY k) AS rn FROM long)
            SELECT position, {_q('column')}, dtype, list(value ORDER BY rn) AS samples
            FROM firsts WHERE rn <= 3 GROUP BY position, {_q('column')}, dtype""",
        "preview": "SELECT * FROM part ORDER BY p_partkey LIMIT 50",
        "follow_ups": corr + "SELECT * FROM (WITH x AS (SELECT 1)" + _sql_follow_ups(
            "correlated", CORRELATED, CORRELATED_NUM, ["l_returnflag", "l_linestatus"], ["l_shipdate"]) + ")",
        "follow_ups_orders": "WITH x AS (SELECT 1)" + _sql_follow_ups(
            "orders", ORDERS, ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"],
            ["o_orderdate"]),
        "chart_observations": corr + "SELECT * FROM (WITH x AS (SELECT 1)" + _sql_observations(
            "correlated", CORRELATED, CORRELATED_NUM, ["l_returnflag", "l_linestatus"], ["l_shipdate"]) + ")",
        "chart_observations_events": "WITH x AS (SELECT 1)" + _sql_observations(
            "events", EVENTS, ["event_id", "user_id", "value"], ["event_type", "props"], ["ts"]),
        "chart_columns": corr + "SELECT * FROM (WITH x AS (SELECT 1)" + _sql_findings_base(
            "correlated", CORRELATED, CORRELATED_NUM, ["l_returnflag", "l_linestatus"], ["l_shipdate"])
            + f"SELECT chart_id, position, {_q('column')} FROM cc)",
        "chart_plan_messy": m + _sql_chart_plan(
            "messy_lineitem", MESSY_NUM, ["l_returnflag", "l_linestatus", "near_empty"], ["l_shipdate"]),
        "quality_report_documents": _sql_quality_report(
            "documents", DOCUMENTS, ["text", "lang", "source"], 2, 3, 0),
        "top_values_documents": f"""SELECT * FROM (
            SELECT c AS {_q('column')}, v AS value, count(*) AS count,
                   CAST(row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS INTEGER) AS rank
            FROM (SELECT 'text' AS c, text AS v FROM documents
                  UNION ALL SELECT 'lang', lang FROM documents
                  UNION ALL SELECT 'source', source FROM documents)
            WHERE v IS NOT NULL GROUP BY c, v) WHERE rank <= 5""",
        "numeric_as_text_conversations": _sql_numeric_as_text("conversations", [(2, "role"), (3, "text")]),
        "describe_customer": _sql_describe("customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
        "box_by_segment": _sql_box("customer", "c_acctbal", "c_mktsegment"),
        "correlation_wide": SUPPLIER_PAIRS_SQL + """
            SELECT x.c AS column_a, y.c AS column_b, CASE WHEN x.c = y.c THEN x.own ELSE r END AS r
            FROM names x CROSS JOIN names y LEFT JOIN p ON p.ca = x.c AND p.cb = y.c""",
        "strong_correlations_wide": SUPPLIER_PAIRS_SQL + """
            SELECT ca AS column_a, cb AS column_b, r,
                   CASE WHEN r > 0 THEN 'positively' ELSE 'negatively' END AS direction,
                   ca || ' is ' || CASE WHEN r > 0 THEN 'positively' ELSE 'negatively' END
                     || ' correlated with ' || cb || ' (' || printf('%.2f', r) || ')' AS description
            FROM p WHERE abs(r) >= 0.25 AND CAST(substr(ca, 2) AS BIGINT) < CAST(substr(cb, 2) AS BIGINT)""",
        "correlation_customer": _sql_corr_matrix("customer", ["c_custkey", "c_nationkey", "c_acctbal"], 3),
        "sum_by_role": """SELECT role, CAST(coalesce(sum(turn), 0) AS DECIMAL(38, 0)) AS turn FROM conversations
            WHERE role IS NOT NULL GROUP BY role""",
        "top_texts": """SELECT text AS value, count(*) AS count,
              CAST(row_number() OVER (ORDER BY count(*) DESC, text) AS INTEGER) AS rank
              FROM documents WHERE text IS NOT NULL GROUP BY text QUALIFY rank <= 10""",
        "top_keys": """SELECT CAST(l_partkey AS VARCHAR) AS part, count(*) AS count FROM lineitem GROUP BY 1
              ORDER BY count DESC, part LIMIT 10""",
        "dedup_documents": "SELECT DISTINCT text, lang, source FROM documents",
        "distinct_lineitem": _union([
            f"SELECT '{c}' AS {_q('column')}, count(DISTINCT {c}) AS {_q('distinct')} FROM lineitem" for c in LINEITEM]),
        "median_by_flag_status": """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice
              FROM lineitem GROUP BY ALL""",
        "csv_line_breaks": """SELECT doc_id, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS characters,
              max(md5(text)) AS digest FROM documents GROUP BY doc_id""",
        "csv_roundtrip": "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
        "csv_odd_values": """SELECT p_partkey, CAST(p_size AS VARCHAR) || 'D' AS code,
              CASE WHEN p_size % 2 <> 0 THEN CAST(p_size AS BIGINT) END AS size,
              p_name || chr(10) || '"' || p_brand || '", new' AS note,
              CASE WHEN p_size % 2 <> 0 THEN p_type END AS type FROM part""",
        "csv_latin1": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "clash_duplicates": """SELECT CAST(sum(k - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS k FROM lineitem
              GROUP BY l_returnflag, l_linestatus, l_suppkey, l_linenumber, l_quantity, l_tax)""",
        "clash_count": "SELECT l_returnflag AS n, count(*) AS count FROM lineitem GROUP BY l_returnflag",
        "clash_median": """SELECT l_suppkey AS value, round(quantile_cont(l_tax, 0.5), 4) AS v FROM lineitem
              GROUP BY l_suppkey""",
        "clash_box": f"SELECT l_linenumber AS p, * EXCLUDE (l_linenumber) FROM ({_sql_box('lineitem', 'l_quantity', 'l_linenumber')})",
        "median_by_partkey": """SELECT l_partkey, round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice
              FROM lineitem GROUP BY l_partkey""",
        "box_by_suppkey": _sql_box("lineitem", "l_extendedprice", "l_suppkey"),
        "quartiles_heavy_tail": """WITH x AS (SELECT CASE WHEN l_orderkey % 100 = 7 THEN CAST('Infinity' AS DOUBLE) ELSE
                l_extendedprice * l_extendedprice * l_extendedprice * l_extendedprice END AS tail, l_quantity FROM lineitem)
              SELECT 'tail' AS "column", quantile_cont(tail, 0.25) AS q1, quantile_cont(tail, 0.5) AS median,
                     quantile_cont(tail, 0.75) AS q3 FROM x
              UNION ALL SELECT 'l_quantity', quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5),
                     quantile_cont(l_quantity, 0.75) FROM x""",
        "strong_correlations_infinity": corr + f" SELECT * FROM ({_sql_strong('correlated', CORRELATED_NUM)})",
        "sum_by_group_large": """SELECT l_returnflag, CAST(sum(CAST(l_orderkey AS HUGEINT) + 4611686018427387904)
              AS DECIMAL(38, 0)) AS big FROM lineitem GROUP BY l_returnflag""",
        "quality_columns": m + f"""SELECT c.position, c.{_q('column')}, class, missing, missing = total AS empty,
              missing < total AND missing / total >= 0.9 AS near_empty
              FROM ({_sql_missing('messy_lineitem', MESSY)}) c JOIN (VALUES {', '.join(
                  f"({i}, '{c}', '{'numeric' if c in MESSY_NUM else 'datetime' if c == 'l_shipdate' else 'categorical'}')"
                  for i, c in enumerate(MESSY))}) k(place, name, class) ON k.name = c.{_q('column')}""",
        "answer_kind": "SELECT CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'table' ELSE 'scalar' END AS kind, 2 AS columns "
                       "FROM orders UNION ALL SELECT 'scalar', 1 FROM (SELECT count(*) FROM orders)",
        "profile_rows": _sql_profile_rows(),
        "key_findings": corr + f""", st AS (SELECT * FROM ({_sql_strong('correlated', CORRELATED_NUM)})),
            cf AS (SELECT rank, 'correlation' AS kind, column_a || ', ' || column_b AS subject,
                          upper(substr(description, 1, 1)) || lower(substr(description, 2)) || '.' AS text
                   FROM st WHERE rank <= 3),
            tv AS (SELECT c, cp, v, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS r FROM (
                     SELECT 'l_returnflag' AS c, 0 AS cp, l_returnflag AS v, count(*) AS n FROM correlated
                       WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
                     UNION ALL
                     SELECT 'l_linestatus', 1, l_linestatus, count(*) FROM correlated
                       WHERE l_linestatus IS NOT NULL GROUP BY l_linestatus)),
            tf AS (SELECT 3 + row_number() OVER (ORDER BY cp) AS rank, 'top_value' AS kind, c AS subject,
                          printf('''%s'' is the most frequent value in ''%s'' (%d occurrences).', v, c, n) AS text
                   FROM tv WHERE r = 1 QUALIFY row_number() OVER (ORDER BY cp) <= 2),
            allf AS (SELECT * FROM cf UNION ALL SELECT * FROM tf)
            SELECT CAST(dense_rank() OVER (ORDER BY rank) AS INTEGER) AS rank, kind, subject, text FROM (
              SELECT * FROM allf
              UNION ALL
              SELECT 0, 'none', NULL, '{findings.NO_PATTERN}' WHERE NOT EXISTS (SELECT 1 FROM allf))""",
        "headline": corr + f""", st AS (SELECT * FROM ({_sql_strong('correlated', CORRELATED_NUM)}))
            SELECT count(*) AS total_rows, 13 AS total_columns, (SELECT count(*) FROM st) AS strong_correlations,
              printf('The dataset contains %d records across %d columns. %d notable relationship(s) were found '
                     || 'between numeric fields, summarized below.', count(*), 13, (SELECT count(*) FROM st))
                AS summary
            FROM correlated""",
        "profile_report": f"""WITH d AS ({_sql_describe('events', ['event_id', 'user_id', 'value'])}),
              mc AS ({_sql_missing('events', EVENTS)}),
              o AS ({_sql_outliers('events', ['event_id', 'user_id', 'value'])})
            SELECT 'describe' AS section, {_q('column')}, metric, value FROM (
              SELECT {_q('column')}, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM d
              UNION ALL SELECT {_q('column')}, 'mean', mean FROM d
              UNION ALL SELECT {_q('column')}, 'median', median FROM d
              UNION ALL SELECT {_q('column')}, 'std', std FROM d
              UNION ALL SELECT {_q('column')}, 'min', min FROM d
              UNION ALL SELECT {_q('column')}, 'max', max FROM d)
            UNION ALL
            SELECT 'missing', {_q('column')}, 'missing', CAST(missing AS DOUBLE) FROM mc
            UNION ALL
            SELECT 'outliers', {_q('column')}, 'count', CAST(count AS DOUBLE) FROM o
            UNION ALL
            SELECT 'outliers', {_q('column')}, 'percentage', percentage FROM o""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _table_queries() | (corpus.queries() if corpus else {})


def oracle_sql() -> dict[str, str]:
    return _table_oracle_sql() | (corpus.oracle_sql() if corpus else {})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the end-to-end profile of lineitem at sf0.001, as its long
    report ``section, column, metric, value`` (descriptive statistics,
    missing counts, outliers)."""
    return profile(_t(spark, SMOKE_DIR, "lineitem"), with_charts=False).report()
