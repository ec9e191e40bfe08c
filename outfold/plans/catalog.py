"""The checked queries, one per operator of the inventory, on the driver's tables.

Stand-ins (no table carries a target of its own):
- orders is the fact with row folds: y = o_totalprice, id = o_orderkey,
  category o_orderpriority; customer is its dimension.
- lineitem is the fact with group folds (by l_partkey); part its dimension.

Every Spark query has a DuckDB twin written in the slow direct form (for
out-of-fold models, a correlated average over the other folds), so the
subtract-and-join form of the library is tested independently. Computed
doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from outfold.functions.folds import fold_sql
from outfold.functions.safe import round_dec, round_dec_sql
from outfold.operators import blending as bl
from outfold.operators import boosting as bo
from outfold.operators import bootstrap as bs
from outfold.operators import checks as ch
from outfold.operators import drift as dr
from outfold.operators import features as fe
from outfold.operators import folds as fo
from outfold.operators import holdout as ho
from outfold.operators import lad
from outfold.operators import metrics as me
from outfold.operators import models as mo
from outfold.operators import oof
from outfold.operators import profile as pr
from outfold.operators import profile_state as ps
from outfold.operators import slices as sl
from outfold.operators.quantiles import exact_quantiles
from outfold.operators.stored import StoredSums
from outfold.plans.registry import register, table
from outfold.session import scratch_path
from outfold.sources import sinks, tables
from outfold.streaming import scoring as st

K = 5


def orders_fact(spark, sf_dir, src=None):
    """(id, g, status, cust, y, fold) for the row-fold stand-in; ``src`` may
    be a streaming read of the same table."""
    o = src if src is not None else table(spark, sf_dir, "orders")
    return fo.assign_fold(
        o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("g"),
                 F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"),
                 F.col("o_totalprice").alias("y")), "id", K)


def orders_oof(spark, sf_dir):
    return oof.oof_predict(orders_fact(spark, sf_dir), fold="fold", y="y", by="g", k=K)


ORDERS_FACT_SQL = f"""
  SELECT o_orderkey AS id, o_orderpriority AS g, o_orderstatus AS status,
         o_custkey AS cust, o_totalprice AS y, {fold_sql('o_orderkey', K)} AS fold
  FROM orders"""

def fold_sums_sql(name: str, src: str, keys=(), fold: str = "fold", y: str = "y") -> str:
    """CTE with the sum and count of ``y`` per (keys, fold): one plain GROUP BY."""
    cols = "".join(f"{k}, " for k in keys)
    return (f"{name} AS (SELECT {cols}{fold} AS fold, sum({y}) AS s, count({y}) AS n "
            f"FROM {src} GROUP BY {cols}{fold})")


def other_folds_sql(cte: str, keys=(), fold: str = "fold", what: str = "mean") -> str:
    """Correlated aggregate over the *other* folds' rows of the same keys (the
    direct form: no total-minus-own subtraction). Summing per-fold partial
    sums keeps DuckDB's float results the same on every run."""
    cond = " AND ".join([f"x.{k} = b.{k}" for k in keys] + [f"x.fold <> b.{fold}"])
    expr = {"mean": "sum(x.s) / nullif(sum(x.n), 0)", "s": "sum(x.s)", "n": "sum(x.n)"}[what]
    return f"(SELECT {expr} FROM {cte} x WHERE {cond})"


# Out-of-fold group mean per row, direct form: the mean over the other folds'
# rows of the group, falling back to the mean over all other folds' rows.
ORDERS_OOF_SQL = f"""
  f AS ({ORDERS_FACT_SQL}),
  {fold_sums_sql('fg', 'f', ['g'])},
  {fold_sums_sql('fa', 'f')},
  p AS (
    SELECT b.*,
           coalesce({other_folds_sql('fg', ['g'])}, {other_folds_sql('fa')}) AS pred
    FROM f b)"""

MAE_SQL = """round(avg(abs(y - pred)), 6) AS mae,
       count(abs(y - pred)) AS n_scored,
       count(*) - count(abs(y - pred)) AS n_missing"""


# The order-independent form (metrics.mae(exact=True)): errors summed as decimals.
MAE_EXACT_SQL = """round(CAST(sum(CAST(abs(y - pred) AS DECIMAL(38,9))) AS DOUBLE)
             / count(abs(y - pred)), 6) AS mae,
       count(abs(y - pred)) AS n_scored,
       count(*) - count(abs(y - pred)) AS n_missing"""


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


# --- R4 + R3 + R2: the flagship ------------------------------------------------

@register("oof_mae", oracle=f"""
WITH {ORDERS_OOF_SQL}
SELECT {MAE_SQL} FROM p""")
def q_oof_mae(spark, sf_dir):
    return me.mae(orders_oof(spark, sf_dir)).select(
        F.round("mae", 6).alias("mae"), "n_scored", "n_missing")


@register("oof_group_mean", oracle=f"""
WITH {ORDERS_OOF_SQL}
SELECT id, fold, round(pred, 6) AS pred FROM p""")
def q_oof_group_mean(spark, sf_dir):
    return orders_oof(spark, sf_dir).select("id", "fold", F.round("pred", 6).alias("pred"))


# --- R1: typed CSV scan ----------------------------------------------------------

@register("csv_scan", oracle="SELECT * FROM part")
def q_csv_scan(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = scratch_path(spark, "csv_scan")
    tables.write_csv(part, path)
    return tables.read_table(spark, path, part.schema)


# --- R2, D19, D20: folds -------------------------------------------------------

@register("fold_assign", oracle=f"""
SELECT o_orderkey, {fold_sql('o_orderkey', K)} AS fold FROM orders""")
def q_fold_assign(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return fo.assign_fold(o, "o_orderkey", K)


@register("group_fold", oracle=f"""
WITH f AS (SELECT l_partkey, {fold_sql('l_partkey', K)} AS fold FROM lineitem)
SELECT fold, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_groups,
       (SELECT max(nf) FROM (SELECT count(DISTINCT fold) AS nf FROM f GROUP BY l_partkey)) = 1
         AS one_fold_per_group
FROM f GROUP BY fold""")
def q_group_fold(spark, sf_dir):
    li = fo.assign_group_fold(table(spark, sf_dir, "lineitem").select("l_partkey"),
                              "l_partkey", K)
    folds_per_group = li.groupBy("l_partkey").agg(F.count_distinct("fold").alias("nf"))
    one = folds_per_group.agg(F.max("nf") == 1).scalar()
    return fo.fold_sizes(li, "fold", "l_partkey").withColumn("one_fold_per_group", one)


@register("strat_fold", oracle="""
SELECT c_custkey, c_mktsegment,
       (row_number() OVER (PARTITION BY c_mktsegment
                           ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS fold
FROM customer""")
def q_strat_fold(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return fo.assign_strat_fold(c, "c_mktsegment", "c_custkey", K)


# --- R5, D21-D25: scores -------------------------------------------------------

HOLD_SQL = f"""
  h AS (SELECT *, {fold_sql('id', 10, 'hold')} = 0 AS hold FROM ({ORDERS_FACT_SQL})),
  tr AS (SELECT * FROM h WHERE NOT hold),
  te AS (SELECT * FROM h WHERE hold),
  m AS (SELECT g, avg(y) AS gm FROM tr GROUP BY g),
  hp AS (SELECT te.id, te.cust, te.y, coalesce(m.gm, (SELECT avg(y) FROM tr)) AS pred
         FROM te LEFT JOIN m ON te.g = m.g)"""


def orders_holdout(spark, sf_dir):
    return ho.holdout_predict(orders_fact(spark, sf_dir), "id", "y", "g", parts=10)


@register("holdout_mae", oracle=f"""
WITH {HOLD_SQL}
SELECT {MAE_SQL} FROM hp""")
def q_holdout_mae(spark, sf_dir):
    return me.mae(orders_holdout(spark, sf_dir)).select(
        F.round("mae", 6).alias("mae"), "n_scored", "n_missing")


@register("mae_by_fold", oracle=f"""
WITH {ORDERS_OOF_SQL},
per AS (SELECT fold, avg(abs(y - pred)) AS mae, count(abs(y - pred)) AS n_scored,
               count(*) - count(abs(y - pred)) AS n_missing
        FROM p GROUP BY fold)
SELECT fold, round(mae, 6) AS mae, n_scored, n_missing,
       round((SELECT avg(mae) FROM per), 6) AS mean_fold_mae,
       round((SELECT stddev_samp(mae) FROM per), 6) AS sd_fold_mae
FROM per""")
def q_mae_by_fold(spark, sf_dir):
    r = me.mae_by_fold(orders_oof(spark, sf_dir))
    return r.select("fold", *_r6("mae"), "n_scored", "n_missing",
                    *_r6("mean_fold_mae", "sd_fold_mae"))


@register("mae_by_segment", oracle=f"""
WITH {ORDERS_OOF_SQL},
pe AS (SELECT status, abs(y - pred) AS e FROM p)
SELECT status, round(avg(e), 6) AS mae, count(e) AS n_scored, count(*) - count(e) AS n_missing,
       round(sum(e), 2) AS sum_abs_err,
       round(sum(e) / (SELECT sum(e) FROM pe), 6) AS err_share
FROM pe GROUP BY status""")
def q_mae_by_segment(spark, sf_dir):
    r = me.mae_by(orders_oof(spark, sf_dir), "status")
    return r.select("status", *_r6("mae"), "n_scored", "n_missing",
                    F.round("sum_abs_err", 2).alias("sum_abs_err"), *_r6("err_share"))


@register("score_gap", oracle=f"""
WITH {HOLD_SQL},
{fold_sums_sql('tg', 'tr', ['g'])},
{fold_sums_sql('ta', 'tr')},
tp AS (SELECT b.y, coalesce({other_folds_sql('tg', ['g'])}, {other_folds_sql('ta')}) AS pred
       FROM tr b),
s AS (SELECT (SELECT avg(abs(y - pred)) FROM tp) AS mae_oof,
             (SELECT avg(abs(y - pred)) FROM hp) AS mae_holdout,
             (SELECT count(abs(y - pred)) FROM tp) AS n_oof,
             (SELECT count(abs(y - pred)) FROM hp) AS n_holdout)
SELECT round(mae_oof, 6) AS mae_oof, round(mae_holdout, 6) AS mae_holdout, n_oof, n_holdout,
       round(mae_holdout - mae_oof, 6) AS gap,
       round(100 * (mae_holdout - mae_oof) / mae_oof, 6) AS gap_pct
FROM s""")
def q_score_gap(spark, sf_dir):
    fact = ho.split_holdout(orders_fact(spark, sf_dir), "id", 10, col="hold")
    # Held-out rows have no fold: they train nothing and, as rows of no fold, are
    # predicted from all training rows by the same sums.
    r = me.gap_of(oof.oof_with_holdout(fact, "hold", by="g", k=K), F.col("hold"))
    return r.select(*_r6("mae_oof", "mae_holdout"), "n_oof", "n_holdout", *_r6("gap", "gap_pct"))


@register("stream_holdout_mae", oracle=f"""
WITH {HOLD_SQL}
SELECT {MAE_SQL} FROM hp""")
def q_stream_holdout_mae(spark, sf_dir):
    """Held-out rows arrive as a file stream and are scored against the model
    fitted on the training rows; the running MAE ends equal to R5's."""
    fact = ho.split_holdout(orders_fact(spark, sf_dir), "id", 10, col="hold")
    model, glob = ho.fit_group_mean(fact.where(~F.col("hold")), "y", "g")
    schema = table(spark, sf_dir, "orders").schema
    src = st.file_stream(spark, f"{sf_dir.rstrip('/')}/orders.parquet", schema)
    arriving = ho.split_holdout(orders_fact(spark, sf_dir, src), "id", 10, col="hold")
    scored = st.score_stream(arriving.where(F.col("hold")), model, glob, "g")
    out = scratch_path(spark, "stream-mae")
    st.run_running_mae(spark, scored, out).awaitTermination()
    return st.latest(spark, out).select(F.round("mae", 6).alias("mae"), "n_scored", "n_missing")


def orders_two_models(spark, sf_dir):
    """Orders with two out-of-fold predictions: by priority (p1) and by the
    customer's market segment (p2)."""
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("seg"))
    f = orders_fact(spark, sf_dir).join(cust, "cust", "left")
    f = oof.oof_encode_many(f, ["g", "seg"], y="y", fold="fold", k=K, m=None)
    return f.withColumnsRenamed({"g_te": "p1", "seg_te": "p2"})


TWO_MODELS_SQL = f"""
  f AS (SELECT o.*, c.c_mktsegment AS seg
        FROM ({ORDERS_FACT_SQL}) o LEFT JOIN customer c ON o.cust = c.c_custkey),
  {fold_sums_sql('fg', 'f', ['g'])},
  {fold_sums_sql('fs', 'f', ['seg'])},
  {fold_sums_sql('fa', 'f')},
  p AS (
    SELECT b.*,
           coalesce({other_folds_sql('fg', ['g'])}, {other_folds_sql('fa')}) AS p1,
           coalesce({other_folds_sql('fs', ['seg'])}, {other_folds_sql('fa')}) AS p2
    FROM f b)"""


@register("blend_weights", oracle=f"""
WITH {TWO_MODELS_SQL},
ws AS (SELECT i / 10 AS w FROM range(0, 11) t(i)),
r AS (SELECT ws.w, round(avg(abs(p.y - (ws.w * p.p1 + (1 - ws.w) * p.p2))), 6) AS mae
      FROM ws, p GROUP BY ws.w)
SELECT w, mae, w = (SELECT w FROM r ORDER BY mae, w LIMIT 1) AS best FROM r""")
def q_blend_weights(spark, sf_dir):
    r = me.blend(orders_two_models(spark, sf_dir), "p1", "p2", y="y", steps=10)
    return r.select("w", *_r6("mae"), "best")


@register("prediction_sink", oracle=f"""
WITH {ORDERS_OOF_SQL}
SELECT id, fold, round(pred, 6) AS pred FROM p""")
def q_prediction_sink(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(orders_oof(spark, sf_dir), path, "id", cols=("fold", "pred"))
    back = spark.read.parquet(path)
    return back.select("id", "fold", F.round("pred", 6).alias("pred"))


# --- D1-D4, D10: checks --------------------------------------------------------

@register("cast_exact", oracle="""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity = floor(l_quantity) THEN CAST(floor(l_quantity) AS INTEGER) END AS l_quantity,
       CASE WHEN l_extendedprice = floor(l_extendedprice)
            THEN CAST(floor(l_extendedprice) AS INTEGER) END AS l_extendedprice
FROM lineitem""")
def q_cast_exact(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return ch.cast_exact(li, ["l_quantity", "l_extendedprice"])


@register("inexact_counts", oracle="""
SELECT 'l_quantity' AS "column", count(*) AS n_rows,
       count(*) FILTER (WHERE l_quantity IS NULL) AS n_null,
       count(*) FILTER (WHERE l_quantity = floor(l_quantity)) AS n_whole,
       count(*) FILTER (WHERE l_quantity <> floor(l_quantity)) AS n_bad,
       CAST(sum(CASE WHEN l_quantity = floor(l_quantity) THEN CAST(floor(l_quantity) AS BIGINT) END)
            AS BIGINT) AS sum_int
FROM lineitem
UNION ALL
SELECT 'l_extendedprice', count(*),
       count(*) FILTER (WHERE l_extendedprice IS NULL),
       count(*) FILTER (WHERE l_extendedprice = floor(l_extendedprice)),
       count(*) FILTER (WHERE l_extendedprice <> floor(l_extendedprice)),
       CAST(sum(CASE WHEN l_extendedprice = floor(l_extendedprice)
                     THEN CAST(floor(l_extendedprice) AS BIGINT) END) AS BIGINT)
FROM lineitem""")
def q_inexact_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return ch.inexact_counts(li, ["l_quantity", "l_extendedprice"])


@register("dup_keys", oracle="""
SELECT l_orderkey, l_linenumber, count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_dup_keys(spark, sf_dir):
    return ch.check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


LINEITEM_RULES = [
    ch.not_null("l_orderkey"),
    ch.positive("l_quantity"),
    ch.between("l_quantity", 1, 49),
    ch.ratio("l_discount"),
    ch.between("l_tax", 0.0, 0.05),
    ch.allowed("l_returnflag", ["A", "R"]),
    ch.allowed("l_linestatus", ["O", "F"]),
]


def _rules_sql(rules, tbl):
    parts = [f"SELECT '{name}' AS rule, count(*) AS n_rows, "
             f"count(*) FILTER (WHERE NOT ({cond})) AS n_bad FROM {tbl}" for name, cond in rules]
    return "\nUNION ALL\n".join(parts)


@register("domain_rules", oracle=_rules_sql(LINEITEM_RULES, "lineitem"))
def q_domain_rules(spark, sf_dir):
    return ch.check_rules(table(spark, sf_dir, "lineitem"), LINEITEM_RULES)


# Bounds per part type for p_size (a parameter of the check, with hits).
P_SIZE_BOUNDS = {"ECONOMY": (1, 40), "LARGE": (10, 50), "MEDIUM": (5, 45),
                 "PROMO": (1, 50), "SMALL": (1, 25)}


def _bounds_sql(bounds):
    return " UNION ALL ".join(f"SELECT '{k}' AS p_type, {lo} AS lo, {hi} AS hi"
                              for k, (lo, hi) in bounds.items())


@register("range_by_category", oracle=f"""
WITH b AS ({_bounds_sql(P_SIZE_BOUNDS)})
SELECT p.p_type, count(*) AS n_rows,
       count(*) FILTER (WHERE p.p_size < b.lo OR p.p_size > b.hi) AS n_bad,
       count(*) FILTER (WHERE b.lo IS NULL) AS n_unbounded,
       min(p.p_size) AS min, max(p.p_size) AS max
FROM part p LEFT JOIN b ON p.p_type = b.p_type GROUP BY p.p_type""")
def q_range_by_category(spark, sf_dir):
    return ch.check_ranges_by(table(spark, sf_dir, "part"), "p_type", "p_size", P_SIZE_BOUNDS)


@register("orphans", oracle="""
SELECT d.doc_id, d.lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_orphans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ch.orphans(docs, table(spark, sf_dir, "labels"), "doc_id")


# --- D5-D8: profile ------------------------------------------------------------

def _profile_sql(cols, tbl):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, "
            f"count(DISTINCT {c}) AS n_distinct, round(min({x}), 6) AS min, round(max({x}), 6) AS max, "
            f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd, "
            f"round(quantile_cont({x}, 0.25), 6) AS q1, round(quantile_cont({x}, 0.5), 6) AS median, "
            f"round(quantile_cont({x}, 0.75), 6) AS q3 FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


def _round_stats(df):
    return df.select("column", "n_rows", "n_null", "n_distinct",
                     *_r6("min", "max", "mean", "sd", "q1", "median", "q3"))


@register("profile", oracle=_profile_sql(["o_orderkey", "o_custkey", "o_totalprice"], "orders"))
def q_profile(spark, sf_dir):
    return _round_stats(pr.profile(table(spark, sf_dir, "orders"), exact=True))


@register("profile_customer", oracle=_profile_sql(["c_custkey", "c_nationkey", "c_acctbal"], "customer"))
def q_profile_customer(spark, sf_dir):
    return _round_stats(pr.profile(table(spark, sf_dir, "customer"), exact=True))


@register("quantiles_by_flag", oracle="""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.9), 6) AS p90
FROM lineitem GROUP BY l_returnflag""")
def q_quantiles_by_flag(spark, sf_dir):
    """Exact quantiles of large groups, with intervals of a few hundred rows
    at the end, so that the passes over brackets run at any table size."""
    q = exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.9],
                        by="l_returnflag", work=200)
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 6).alias(c)
                                      for i, c in enumerate(("p10", "p50", "p90"))])


@register("category_freq", oracle="""
SELECT c_mktsegment AS value, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM customer), 6) AS share
FROM customer GROUP BY c_mktsegment""")
def q_category_freq(spark, sf_dir):
    r = pr.freq(table(spark, sf_dir, "customer"), "c_mktsegment")
    return r.select("value", "n", *_r6("share"))


@register("summary_by_category", oracle="""
SELECT o_orderpriority, count(*) AS n_rows, count(o_totalprice) AS o_totalprice_n,
       round(avg(o_totalprice), 6) AS o_totalprice_mean,
       round(stddev_samp(o_totalprice), 6) AS o_totalprice_sd,
       min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max
FROM orders GROUP BY o_orderpriority""")
def q_summary_by_category(spark, sf_dir):
    r = pr.summary_by(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"])
    return r.select("o_orderpriority", "n_rows", "o_totalprice_n",
                    *_r6("o_totalprice_mean", "o_totalprice_sd"),
                    "o_totalprice_min", "o_totalprice_max")


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(cols, tbl):
    from itertools import combinations
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM {tbl}"
        for a, b in combinations(cols, 2))


@register("corr_pairs", oracle=_corr_sql(CORR_COLS, "lineitem"))
def q_corr_pairs(spark, sf_dir):
    r = pr.corr_pairs(table(spark, sf_dir, "lineitem"), CORR_COLS)
    return r.select("a", "b", F.round("r", 9).alias("r"))


# --- D9, D11-D14: features -------------------------------------------------------

@register("enrich", oracle="""
SELECT o.o_orderkey, o.o_totalprice, c.c_mktsegment, c.c_acctbal
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_enrich(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("custkey"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_mktsegment", "c_acctbal")
    return fe.enrich(o, c, "custkey").drop("custkey")


# Fixture: c_acctbal is masked to null on every 7th customer key (no row is
# dropped), since the tables carry no nulls of their own.
CUSTOMER_NULLS_SQL = """
  SELECT c_custkey, c_mktsegment,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal
  FROM customer"""


def customer_with_nulls(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_mktsegment",
                    F.when(F.col("c_custkey") % 7 == 0, F.lit(None))
                    .otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@register("impute_median", oracle=f"""
WITH c AS ({CUSTOMER_NULLS_SQL}),
m AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS med FROM c GROUP BY c_mktsegment)
SELECT c.c_custkey,
       round(coalesce(c.c_acctbal, m.med, (SELECT quantile_cont(c_acctbal, 0.5) FROM c)), 6)
         AS c_acctbal,
       c.c_acctbal IS NULL AS c_acctbal_was_null
FROM c LEFT JOIN m ON c.c_mktsegment = m.c_mktsegment""")
def q_impute_median(spark, sf_dir):
    r = fe.impute(customer_with_nulls(spark, sf_dir), ["c_acctbal"], by="c_mktsegment")
    return r.select("c_custkey", *_r6("c_acctbal"), "c_acctbal_was_null")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot", oracle="SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS INTEGER) AS c_mktsegment_{v}" for v in SEGMENTS)
    + " FROM customer")
def q_one_hot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return fe.one_hot(c, "c_mktsegment").drop("c_mktsegment")


@register("label_index", oracle="""
WITH f AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment),
i AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY n DESC, c_mktsegment) - 1 AS INTEGER)
             AS c_mktsegment_idx FROM f)
SELECT c.c_custkey, c.c_mktsegment, i.c_mktsegment_idx
FROM customer c LEFT JOIN i ON c.c_mktsegment = i.c_mktsegment""")
def q_label_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return fe.label_index(c, "c_mktsegment").select("c_custkey", "c_mktsegment", "c_mktsegment_idx")


@register("ratios", oracle=f"""
SELECT l_orderkey, l_linenumber,
       {round_dec_sql('l_extendedprice / nullif(l_quantity, 0)')} AS price_per_qty,
       {round_dec_sql('l_tax / nullif(l_discount, 0)')} AS tax_per_discount
FROM lineitem""")
def q_ratios(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    li = fe.ratio(li, "l_extendedprice", "l_quantity", "price_per_qty")
    li = fe.ratio(li, "l_tax", "l_discount", "tax_per_discount")
    return li.select("l_orderkey", "l_linenumber",
                     *[round_dec(c).alias(c) for c in ("price_per_qty", "tax_per_discount")])


@register("zscore", oracle="""
SELECT o_orderkey,
       round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
             / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS o_totalprice_z
FROM orders""")
def q_zscore(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return fe.zscore(o, ["o_totalprice"]).select("o_orderkey", *_r6("o_totalprice_z"))


@register("quantile_bins", oracle="""
WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS c FROM orders)
SELECT o_orderkey,
       CAST(o_totalprice > c[1] AS INTEGER) + CAST(o_totalprice > c[2] AS INTEGER)
         + CAST(o_totalprice > c[3] AS INTEGER) AS o_totalprice_bin
FROM orders, q""")
def q_quantile_bins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return fe.qbin(o, "o_totalprice", 4).select("o_orderkey", "o_totalprice_bin")


# --- D15-D18: models -------------------------------------------------------------

def orders_with_customer(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("seg"),
        F.col("c_acctbal").alias("x"))
    return orders_fact(spark, sf_dir).join(cust, "cust", "left")


ORDERS_CUST_SQL = f"""
  f AS (SELECT o.*, c.c_mktsegment AS seg, c.c_acctbal AS x
        FROM ({ORDERS_FACT_SQL}) o LEFT JOIN customer c ON o.cust = c.c_custkey)"""


@register("oof_encode", oracle=f"""
WITH {ORDERS_CUST_SQL},
{fold_sums_sql('fs', 'f', ['seg'])},
{fold_sums_sql('fa', 'f')},
p AS (
  SELECT b.id, b.fold,
         {other_folds_sql('fs', ['seg'], what='s')} AS s,
         {other_folds_sql('fs', ['seg'], what='n')} AS n,
         {other_folds_sql('fa')} AS g
  FROM f b)
SELECT id, fold, round((coalesce(s, 0) + 20 * g) / (coalesce(n, 0) + 20), 6) AS seg_te FROM p""")
def q_oof_encode(spark, sf_dir):
    r = oof.oof_encode(orders_with_customer(spark, sf_dir), col="seg", y="y", fold="fold",
                       k=K, m=20.0)
    return r.select("id", "fold", *_r6("seg_te"))


@register("oof_group_median", oracle=f"""
WITH f AS ({ORDERS_FACT_SQL}),
p AS (
  SELECT b.y,
         coalesce((SELECT quantile_cont(x.y, 0.5) FROM f x WHERE x.g = b.g AND x.fold <> b.fold),
                  (SELECT quantile_cont(x.y, 0.5) FROM f x WHERE x.fold <> b.fold)) AS pred
  FROM f b)
SELECT {MAE_EXACT_SQL} FROM p""")
def q_oof_group_median(spark, sf_dir):
    r = oof.oof_median(orders_fact(spark, sf_dir), fold="fold", y="y", by="g", k=K,
                       method="exact")
    return me.mae(r, exact=True).select(F.round("mae", 6).alias("mae"), "n_scored", "n_missing")


@register("oof_group_median_sketch", oracle=f"""
WITH f AS ({ORDERS_FACT_SQL})
SELECT fold, count(y) AS n_scored, count(*) - count(y) AS n_missing, true AS in_bounds
FROM f GROUP BY fold""")
def q_oof_group_median_sketch(spark, sf_dir):
    """Per fold: are all sketched medians within 1 % of the middle rank of the
    rows they stand for? (The oracle says yes.)"""
    f = orders_fact(spark, sf_dir)
    r = oof.oof_median(f, fold="fold", y="y", by="g", k=K, method="sketch")
    scored = r.groupBy("fold").agg(
        F.count(me.abs_err("y", "pred")).alias("n_scored"),
        (F.count(F.lit(1)) - F.count(me.abs_err("y", "pred"))).alias("n_missing"))
    meds = r.groupBy("g", "fold").agg(F.first("pred").alias("m")).withColumnRenamed("fold", "t")
    ranks = (f.join(meds, "g").where("fold <> t").groupBy("g", "t").agg(
        (F.count(F.when(F.col("y") < F.col("m"), 1)) / F.count("y")).alias("below"),
        (F.count(F.when(F.col("y") <= F.col("m"), 1)) / F.count("y")).alias("upto")))
    ok = ranks.groupBy(F.col("t").alias("fold")).agg(
        F.every((F.col("below") <= 0.51) & (F.col("upto") >= 0.49)).alias("in_bounds"))
    return scored.join(ok, "fold").select("fold", "n_scored", "n_missing", "in_bounds")


@register("oof_linear", oracle=f"""
WITH {ORDERS_CUST_SQL},
ff AS (SELECT DISTINCT fold FROM f),
c AS (SELECT ff.fold, regr_slope(x.y, x.x) AS b1, regr_intercept(x.y, x.x) AS b0
      FROM ff JOIN f x ON x.fold <> ff.fold GROUP BY ff.fold),
e AS (SELECT f.fold, abs(f.y - (c.b0 + c.b1 * f.x)) AS err FROM f JOIN c ON f.fold = c.fold)
SELECT fold, round(avg(err), 6) AS mae, count(err) AS n_scored FROM e GROUP BY fold""")
def q_oof_linear(spark, sf_dir):
    r = mo.oof_ols(orders_with_customer(spark, sf_dir), fold="fold", y="y", xs=["x"], k=K)
    return (r.groupBy("fold").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"),
                                  F.count(F.abs(F.col("y") - F.col("pred"))).alias("n_scored"))
            .select("fold", *_r6("mae"), "n_scored"))


@register("oof_gbt", oracle=f"""
WITH f AS ({ORDERS_FACT_SQL})
SELECT fold, count(y) AS n_scored, count(*) - count(y) AS n_missing, true AS near_median
FROM f GROUP BY fold""")
def q_oof_gbt(spark, sf_dir):
    """Per fold: is the trees' MAE at most 1.05 times that of the out-of-fold
    median? (The oracle says yes.)"""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").alias("y"), F.dayofyear("o_orderdate").cast("double").alias("doy"))
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("x"))
    f = fo.assign_fold(o, "id", K).join(cust, "cust", "left").withColumn("one", F.lit(1))
    r = mo.oof_gbt(f, fold="fold", y="y", xs=["x", "doy"], k=K)
    r = oof.oof_median(r, fold="fold", y="y", by="one", k=K, out="med", method="sketch")
    err, base = me.abs_err("y", "pred"), me.abs_err("y", "med")
    return r.groupBy("fold").agg(
        F.count(err).alias("n_scored"), (F.count(F.lit(1)) - F.count(err)).alias("n_missing"),
        (F.avg(err) <= 1.05 * F.avg(base)).alias("near_median"))


@register("holdout_encode", oracle=f"""
WITH {HOLD_SQL},
s AS (SELECT g, sum(y) AS s, count(y) AS n FROM tr GROUP BY g)
SELECT te.id, round((coalesce(s.s, 0) + 20 * (SELECT avg(y) FROM tr)) / (coalesce(s.n, 0) + 20), 6) AS pred
FROM te LEFT JOIN s ON te.g = s.g""")
def q_holdout_encode(spark, sf_dir):
    """The held-out form of the smoothed target encoding."""
    r = ho.holdout_encode(orders_fact(spark, sf_dir), "id", "y", "g", m=20.0)
    return r.select("id", *_r6("pred"))


@register("holdout_linear", oracle=f"""
WITH {ORDERS_CUST_SQL},
h AS (SELECT *, {fold_sql('id', 10, 'hold')} = 0 AS hold FROM f),
c AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM h WHERE NOT hold)
SELECT round(avg(abs(y - (b0 + b1 * x))), 6) AS mae, count(abs(y - (b0 + b1 * x))) AS n_scored,
       count(*) - count(abs(y - (b0 + b1 * x))) AS n_missing
FROM h, c WHERE hold""")
def q_holdout_linear(spark, sf_dir):
    """The held-out form of least squares."""
    r = ho.holdout_linear(orders_with_customer(spark, sf_dir), "id", "y", ["x"])
    return me.mae(r).select(*_r6("mae"), "n_scored", "n_missing")


@register("oof_linear_encoded", oracle=f"""
WITH {ORDERS_CUST_SQL},
s AS (SELECT seg, fold, sum(y) AS s, count(y) AS n FROM f GROUP BY seg, fold),
a AS (SELECT fold, sum(y) AS s, count(y) AS n FROM f GROUP BY fold),
t AS (SELECT DISTINCT fold FROM f),
enc AS (
  SELECT b.seg, b.fold, t.fold AS target,
         (coalesce((SELECT sum(x.s) FROM s x WHERE x.seg = b.seg AND x.fold <> b.fold AND x.fold <> t.fold), 0)
          + 20 * (SELECT sum(x.s) / sum(x.n) FROM a x WHERE x.fold <> b.fold AND x.fold <> t.fold))
         / (coalesce((SELECT sum(x.n) FROM s x WHERE x.seg = b.seg AND x.fold <> b.fold AND x.fold <> t.fold), 0)
            + 20) AS x
  FROM s b, t),
c AS (SELECT e.target, regr_slope(f.y, e.x) AS b1, regr_intercept(f.y, e.x) AS b0
      FROM f JOIN enc e ON e.seg = f.seg AND e.fold = f.fold WHERE f.fold <> e.target GROUP BY e.target),
p AS (SELECT f.fold, f.y, c.b0 + c.b1 * e.x AS pred
      FROM f JOIN enc e ON e.seg = f.seg AND e.fold = f.fold AND e.target = f.fold
      JOIN c ON c.target = f.fold)
SELECT fold, round(avg(abs(y - pred)), 4) AS mae, count(abs(y - pred)) AS n_scored FROM p GROUP BY fold""")
def q_oof_linear_encoded(spark, sf_dir):
    """Least squares on a target encoding that never holds a scored row's target."""
    r = oof.nested_encoded_ols(orders_with_customer(spark, sf_dir), "seg", y="y", k=K, m=20.0)
    err = me.abs_err("y", "pred")
    return r.groupBy("fold").agg(F.round(F.avg(err), 4).alias("mae"), F.count(err).alias("n_scored"))


@register("oof_encode_many", oracle=f"""
WITH {ORDERS_CUST_SQL},
{fold_sums_sql('fs', 'f', ['seg'])},
{fold_sums_sql('fg', 'f', ['g'])},
{fold_sums_sql('fa', 'f')},
p AS (
  SELECT b.id, b.fold,
         {other_folds_sql('fs', ['seg'], what='s')} AS s1,
         {other_folds_sql('fs', ['seg'], what='n')} AS n1,
         {other_folds_sql('fg', ['g'], what='s')} AS s2,
         {other_folds_sql('fg', ['g'], what='n')} AS n2,
         {other_folds_sql('fa')} AS gm
  FROM f b)
SELECT id, fold,
       round((coalesce(s1, 0) + 20 * gm) / (coalesce(n1, 0) + 20), 6) AS seg_te,
       round((coalesce(s2, 0) + 20 * gm) / (coalesce(n2, 0) + 20), 6) AS g_te
FROM p""")
def q_oof_encode_many(spark, sf_dir):
    r = oof.oof_encode_many(orders_with_customer(spark, sf_dir), ["seg", "g"], y="y",
                            fold="fold", k=K, m=20.0)
    return r.select("id", "fold", *_r6("seg_te", "g_te"))


# --- D19 in use: row-wise against group-wise folds --------------------------------

LINEITEM_FOLDS_SQL = f"""
  f AS (SELECT l_partkey AS p, l_extendedprice AS y,
               {fold_sql('l_orderkey', K)} AS fold_order,
               {fold_sql('l_partkey', K)} AS fold_part
        FROM lineitem)"""


@register("fold_kind_mae", oracle=f"""
WITH {LINEITEM_FOLDS_SQL},
{fold_sums_sql('go', 'f', ['p'], fold='fold_order')},
{fold_sums_sql('ao', 'f', fold='fold_order')},
{fold_sums_sql('gp', 'f', ['p'], fold='fold_part')},
{fold_sums_sql('ap', 'f', fold='fold_part')},
po AS (SELECT b.y, coalesce({other_folds_sql('go', ['p'], fold='fold_order')},
                            {other_folds_sql('ao', fold='fold_order')}) AS pred
       FROM f b),
pp AS (SELECT b.y, coalesce({other_folds_sql('gp', ['p'], fold='fold_part')},
                            {other_folds_sql('ap', fold='fold_part')}) AS pred
       FROM f b)
SELECT 'order' AS fold_kind, {MAE_SQL} FROM po
UNION ALL
SELECT 'part', {MAE_SQL} FROM pp""")
def q_fold_kind_mae(spark, sf_dir):
    """Mean extended price per part, scored out of fold with folds by order
    (a part's other orders train its own prediction) and by part (a part is
    never seen in training, as new entities on a leaderboard)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"),
        F.col("l_extendedprice").alias("y"))
    f = fo.assign_group_fold(fo.assign_fold(li, "o", K, out="fold_order"), "p", K, out="fold_part")
    r = oof.oof_predict_kinds(f, {"order": "fold_order", "part": "fold_part"}, by="p", k=K)
    errs = {kind: me.abs_err("y", f"pred_{kind}") for kind in ("order", "part")}
    wide = r.agg(F.count(F.lit(1)).alias("n"), *[a for kind, e in errs.items() for a in (
        F.avg(e).alias(f"m_{kind}"), F.count(e).alias(f"n_{kind}"))])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(kind).alias("fold_kind"), F.round(f"m_{kind}", 6).alias("mae"),
        F.col(f"n_{kind}").alias("n_scored"), (F.col("n") - F.col(f"n_{kind}")).alias("n_missing"))
        for kind in errs])))


@register("impute_median_oof", oracle=f"""
WITH c AS (SELECT *, {fold_sql('c_custkey', K)} AS fold FROM ({CUSTOMER_NULLS_SQL}))
SELECT b.c_custkey, b.fold,
       round(coalesce(b.c_acctbal,
         (SELECT quantile_cont(x.c_acctbal, 0.5) FROM c x
          WHERE x.c_mktsegment = b.c_mktsegment AND x.fold <> b.fold),
         (SELECT quantile_cont(x.c_acctbal, 0.5) FROM c x WHERE x.fold <> b.fold)), 6) AS c_acctbal,
       b.c_acctbal IS NULL AS c_acctbal_was_null
FROM c b""")
def q_impute_median_oof(spark, sf_dir):
    """D11 without leaks for cross-validation: a row of fold t is filled from
    the other folds' rows of its segment."""
    c = fo.assign_fold(customer_with_nulls(spark, sf_dir), "c_custkey", K)
    r = fe.impute(c, ["c_acctbal"], by="c_mktsegment", fold="fold", k=K)
    return r.select("c_custkey", "fold", *_r6("c_acctbal"), "c_acctbal_was_null")


@register("zscore_oof", oracle=f"""
WITH o AS (SELECT o_orderkey, o_totalprice, {fold_sql('o_orderkey', K)} AS fold FROM orders),
t AS (SELECT DISTINCT fold FROM o),
s AS (SELECT t.fold, avg(x.o_totalprice) AS m, stddev_samp(x.o_totalprice) AS sd
      FROM t JOIN o x ON x.fold <> t.fold GROUP BY t.fold)
SELECT o.o_orderkey, o.fold, round((o.o_totalprice - s.m) / s.sd, 6) AS o_totalprice_z
FROM o JOIN s ON o.fold = s.fold""")
def q_zscore_oof(spark, sf_dir):
    """D14 without leaks for cross-validation: scaled by the other folds."""
    o = fo.assign_fold(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"),
                       "o_orderkey", K)
    r = fe.zscore(o, ["o_totalprice"], fold="fold", k=K)
    return r.select("o_orderkey", "fold", *_r6("o_totalprice_z"))


@register("mae_report", oracle=f"""
WITH {ORDERS_OOF_SQL}
SELECT 'pooled' AS level, CAST(NULL AS VARCHAR) AS key, {MAE_SQL} FROM p
UNION ALL
SELECT 'fold', CAST(fold AS VARCHAR), {MAE_SQL} FROM p GROUP BY fold
UNION ALL
SELECT 'status', status, {MAE_SQL} FROM p GROUP BY status""")
def q_mae_report(spark, sf_dir):
    """R4, D21 and D22 from one aggregate over the scored rows."""
    r = me.mae_report(orders_oof(spark, sf_dir), fold="fold", by="status")
    return r.select("level", "key", *_r6("mae"), "n_scored", "n_missing")


# --- D18: folds grown together ---------------------------------------------------

NET_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x, l_discount AS d, l_tax AS t, l_quantity AS q,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y, {fold_sql('l_orderkey', K)} AS fold FROM lineitem"""


def net_price(spark, sf_dir):
    """lineitem with its net price as a target that its columns explain."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("q"))
    return fo.assign_fold(li, "l_orderkey", K).withColumn(
        "y", F.col("x") * (1 - F.col("d")) * (1 + F.col("t")))


@register("oof_boost", oracle=f"""
WITH f AS ({NET_SQL}),
m AS (SELECT a.fold, quantile_cont(b.y, 0.5) AS med FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON b.fold <> a.fold
      GROUP BY a.fold)
SELECT fold, count(*) AS n_scored, 0 AS n_missing, round(avg(abs(y - med)), 6) AS median_mae, true AS below_a_tenth
FROM f JOIN m USING (fold) GROUP BY fold""")
def q_oof_boost(spark, sf_dir):
    """Per fold: the out-of-fold median's MAE, and is that of trees grown together
    below a tenth of it? (The oracle says yes; the median itself would fail.)"""
    f = net_price(spark, sf_dir).withColumn("one", F.lit(1))
    r = bo.oof_boost(f, xs=["x", "d", "t"], k=K, rounds=12, depth=4, rate=0.6)
    r = oof.oof_median(r, y="y", by="one", k=K, out="med", method="exact")
    err, base = me.abs_err("y", "pred"), me.abs_err("y", "med")
    return r.groupBy("fold").agg(
        F.count(err).alias("n_scored"), (F.count(F.lit(1)) - F.count(err)).alias("n_missing"),
        F.round(F.avg(base), 6).alias("median_mae"), (F.avg(err) < 0.1 * F.avg(base)).alias("below_a_tenth"))


STUMP_EDGES = [10000.0 * i for i in range(1, 11)]


@register("oof_boost_stump", oracle=f"""
WITH f AS ({NET_SQL}),
b AS (SELECT a.fold, quantile_cont(o.y, 0.5) AS base FROM (SELECT DISTINCT fold FROM f) a JOIN f o ON o.fold <> a.fold
      GROUP BY a.fold),
tr AS (SELECT b.fold, b.base, f.x, f.y - b.base AS r, sign(f.y - b.base) AS g FROM b JOIN f ON f.fold <> b.fold),
c AS (SELECT fold, e, sum(g) FILTER (WHERE x <= e) AS gl, count(*) FILTER (WHERE x <= e) AS nl,
             sum(g) FILTER (WHERE x > e) AS gr, count(*) FILTER (WHERE x > e) AS nr
      FROM tr, (SELECT unnest({STUMP_EDGES})::DOUBLE AS e) GROUP BY fold, e),
s AS (SELECT fold, e AS cut FROM c WHERE nl >= 20 AND nr >= 20
      QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gl * gl / nl + gr * gr / nr DESC, e) = 1),
v AS (SELECT tr.fold, any_value(base) AS base, cut, quantile_cont(r, 0.5) FILTER (WHERE x <= cut) AS lo,
             quantile_cont(r, 0.5) FILTER (WHERE x > cut) AS hi
      FROM tr JOIN s ON tr.fold = s.fold GROUP BY tr.fold, cut)
SELECT f.fold, cut, {round_dec_sql("base")} AS base, {round_dec_sql("lo")} AS "left", {round_dec_sql("hi")} AS "right",
       round(avg(abs(y - (base + CASE WHEN x <= cut THEN lo ELSE hi END))), 6) AS mae, count(*) AS n_scored
FROM f JOIN v ON f.fold = v.fold GROUP BY f.fold, cut, base, lo, hi""")
def q_oof_boost_stump(spark, sf_dir):
    """One split a fold with exact leaves: the split, both leaves and the score."""
    f = net_price(spark, sf_dir)
    m = bo.fit(f, "fold", "y", ["x"], K, rounds=1, depth=1, rate=1.0, edges=[STUMP_EDGES], leaf="exact")
    feature, cut, value = m.trees[0]
    parts = spark.createDataFrame(
        [(t, STUMP_EDGES[cut[t, 0] - 1], float(m.base[t]), float(value[t, 0]), float(value[t, 1])) for t in range(K)],
        "fold long, cut double, base double, left double, right double")
    score = bo.predict(f, m, F.col("fold")).groupBy("fold").agg(
        F.round(F.avg(me.abs_err("y", "pred")), 6).alias("mae"), F.count("pred").alias("n_scored"))
    return score.join(F.broadcast(parts), "fold").select(
        "fold", "cut", *[round_dec(c).alias(c) for c in ("base", "left", "right")], "mae", "n_scored")


# --- D23: is the gap chance? -----------------------------------------------------

REPLICATES = 100


def _interval_sql(level: str, unit: str) -> str:
    w = bs.poisson_weight_sql("h", "b")
    return f"""
  u_{level} AS (SELECT CAST('0x' || substr(md5(CAST({unit} AS VARCHAR)), 1, 8) AS BIGINT) AS h, s, sum(e) AS e, count(*) AS n
        FROM sc GROUP BY ALL),
  d_{level} AS (SELECT b, s, {w} AS w, e, n FROM u_{level}, (SELECT unnest(range(1, {REPLICATES + 1})) AS b)),
  r_{level} AS (SELECT b, sum(w * e) FILTER (WHERE NOT s) / nullif(sum(w * n) FILTER (WHERE NOT s), 0) AS mae_a,
               sum(w * e) FILTER (WHERE s) / nullif(sum(w * n) FILTER (WHERE s), 0) AS mae_b
        FROM d_{level} GROUP BY b),
  l_{level} AS (SELECT '{level}' AS unit, unnest(['mae_a', 'mae_b', 'gap', 'gap_pct']) AS measure,
               unnest([mae_a, mae_b, mae_b - mae_a, 100 * (mae_b - mae_a) / mae_a]) AS v FROM r_{level})"""


@register("gap_interval", oracle=f"""
WITH {HOLD_SQL},
{fold_sums_sql('tg', 'tr', ['g'])},
{fold_sums_sql('ta', 'tr')},
sc AS (SELECT id, cust, false AS s, abs(y - coalesce({other_folds_sql('tg', ['g'])}, {other_folds_sql('ta')})) AS e
       FROM tr b UNION ALL SELECT id, cust, true AS s, abs(y - pred) AS e FROM hp),
{_interval_sql('row', 'id')},
{_interval_sql('customer', 'cust')},
p AS (SELECT avg(e) FILTER (WHERE NOT s) AS a, avg(e) FILTER (WHERE s) AS b FROM sc),
est AS (SELECT unnest(['mae_a', 'mae_b', 'gap', 'gap_pct']) AS measure, unnest([a, b, b - a, 100 * (b - a) / a]) AS estimate
        FROM p)
SELECT unit, measure, round(estimate, 4) AS estimate, round(quantile_cont(v, 0.025), 4) AS low,
       round(quantile_cont(v, 0.975), 4) AS high, round(stddev(v), 4) AS se, count(v) AS n_replicates
FROM (SELECT * FROM l_row UNION ALL SELECT * FROM l_customer) JOIN est USING (measure)
GROUP BY unit, measure, estimate""")
def q_gap_interval(spark, sf_dir):
    """Intervals of the out-of-fold score, the held-out score and their gap; drawn
    by row, and by customer."""
    fact = ho.split_holdout(orders_fact(spark, sf_dir), "id", 10, col="hold")
    scored = oof.oof_with_holdout(fact, "hold", by="g", k=K)
    parts = [bs.gap_interval(scored, unit, F.col("hold"), b=REPLICATES, clustered=unit == "cust").select(
        F.lit(name).alias("unit"), "measure", *[F.round(c, 4).alias(c) for c in ("estimate", "low", "high", "se")],
        "n_replicates") for name, unit in (("row", "id"), ("customer", "cust"))]
    return parts[0].unionByName(parts[1])


# --- D24: the exact weight ---------------------------------------------------------

@register("blend_exact", oracle=f"""
WITH {TWO_MODELS_SQL},
q AS (SELECT (y - p2) / (p1 - p2) AS r, abs(p1 - p2) AS d FROM p WHERE p1 <> p2),
c AS (SELECT r, sum(d) OVER (ORDER BY r) AS upto, sum(d) OVER () / 2 AS half FROM q),
w AS (SELECT least(1, greatest(0, min(r))) AS w FROM c WHERE upto >= half)
SELECT round(w, 6) AS w, round(avg(abs(y - (w * p1 + (1 - w) * p2))), 6) AS mae, count(y) AS n_scored
FROM p, w GROUP BY w""")
def q_blend_exact(spark, sf_dir):
    r = bl.blend_exact(orders_two_models(spark, sf_dir), "p1", "p2")
    return r.select(*_r6("w", "mae"), "n_scored")


# --- D17: least absolute deviations --------------------------------------------------

@register("oof_lad", oracle=f"""
WITH RECURSIVE {ORDERS_CUST_SQL},
ff AS (SELECT DISTINCT fold FROM f),
tr AS (SELECT ff.fold AS t, f.y, f.x FROM ff JOIN f ON f.fold <> ff.fold WHERE f.x IS NOT NULL),
it AS (
  SELECT fold AS t, -1000.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS i FROM ff
  UNION ALL
  SELECT t, CASE WHEN g > 0 THEN mid ELSE lo END, CASE WHEN g > 0 THEN hi ELSE mid END, i + 1
  FROM (SELECT m.t, m.lo, m.hi, m.mid, m.i, sum(tr.x * sign(tr.y - m.mid * tr.x - m.med)) AS g
        FROM (SELECT it.t, it.lo, it.hi, (it.lo + it.hi) / 2 AS mid, it.i,
                     median(tr.y - (it.lo + it.hi) / 2 * tr.x) AS med
              FROM it JOIN tr ON tr.t = it.t WHERE it.i < 60 GROUP BY it.t, it.lo, it.hi, it.i) m
        JOIN tr ON tr.t = m.t GROUP BY m.t, m.lo, m.hi, m.mid, m.i)),
b AS (SELECT it.t, (it.lo + it.hi) / 2 AS b1, median(tr.y - (it.lo + it.hi) / 2 * tr.x) AS b0
      FROM it JOIN tr ON tr.t = it.t WHERE it.i = 60 GROUP BY it.t, it.lo, it.hi),
l AS (SELECT b.t, avg(abs(tr.y - b.b0 - b.b1 * tr.x)) AS mae FROM b JOIN tr ON tr.t = b.t GROUP BY b.t),
e AS (SELECT f.fold, abs(f.y - b.b0 - b.b1 * f.x) AS err FROM f JOIN b ON f.fold = b.t)
SELECT e.fold, round(any_value(l.mae), 4) AS train_mae, round(avg(e.err), 4) AS mae,
       count(e.err) AS n_scored, true AS proven
FROM e JOIN l ON l.t = e.fold GROUP BY e.fold""")
def q_oof_lad(spark, sf_dir):
    """The oracle halves the interval of the slope by the sign of the derivative,
    with the median as intercept; the fit must have the same least training MAE."""
    f = orders_with_customer(spark, sf_dir)
    fits = lad.fit(f, "fold", "y", ["x"], range(K), K, near=2000)
    best = spark.createDataFrame(
        [(t, m.mae, m.gap <= 1e-9) for t, m in fits.items()], "fold long, train_mae double, proven boolean")
    err = me.abs_err("y", "pred")
    return (lad.predict(f, fits, "fold", ["x"], K).groupBy("fold").agg(
        F.avg(err).alias("mae"), F.count(err).alias("n_scored")).join(F.broadcast(best), "fold")
        .select("fold", F.round("train_mae", 4).alias("train_mae"), F.round("mae", 4).alias("mae"),
                "n_scored", "proven"))


# --- D19: folds of near equal size ---------------------------------------------------

BALANCED_SLOTS = 64

@register("balanced_group_fold", oracle=f"""
WITH RECURSIVE l AS (
  SELECT l_returnflag || CASE WHEN l_partkey % 2 = 0 THEN '' ELSE '-' || l_partkey END AS g FROM lineitem),
n AS (SELECT g, {fold_sql('g', BALANCED_SLOTS)} AS s, count(*) AS c FROM l WHERE g IS NOT NULL GROUP BY g),
big AS (SELECT * FROM n WHERE c * {BALANCED_SLOTS} > (SELECT sum(c) FROM n)
        AND s IN (SELECT s FROM n GROUP BY s HAVING sum(c) * {BALANCED_SLOTS} > 2 * (SELECT sum(c) FROM n))),
item AS (SELECT c, s, 0 AS kind, g FROM big UNION ALL
         SELECT sum(c), s, 1, '' FROM n WHERE g NOT IN (SELECT g FROM big) GROUP BY s),
o AS (SELECT *, row_number() OVER (ORDER BY c DESC, s, kind, g) AS i FROM item),
pack AS (
  SELECT 0::BIGINT AS i, [0::BIGINT, 0, 0, 0, 0] AS load, -1::BIGINT AS f
  UNION ALL
  SELECT i, load[:place - 1] || [load[place] + c] || load[place + 1:], place - 1
  FROM (SELECT o.i, p.load, o.c::BIGINT AS c, list_position(p.load, list_min(p.load)) AS place
        FROM pack p JOIN o ON o.i = p.i + 1)),
a AS (SELECT o.*, pack.f FROM o JOIN pack USING (i))
SELECT n.g, n.c::BIGINT AS n_rows, coalesce(b.f, r.f) AS fold
FROM n LEFT JOIN a b ON b.kind = 0 AND b.g = n.g LEFT JOIN a r ON r.kind = 1 AND r.s = n.s""")
def q_balanced_group_fold(spark, sf_dir):
    """Groups of very unequal size: half of the rows are in those of the return
    flags alone, the others in one for each flag and odd part."""
    f = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.when(
        F.col("l_partkey") % 2 == 0, "").otherwise(F.concat(F.lit("-"), F.col("l_partkey")))).alias("g"))
    f = fo.assign_balanced_group_fold(f, "g", K, slots=BALANCED_SLOTS)
    return f.groupBy("g", "fold").agg(F.count(F.lit(1)).alias("n_rows")).select("g", "n_rows", "fold")


# --- R5, D23: do the held-out rows look like the others? -------------------------------

@register("holdout_drift", oracle=f"""
WITH {ORDERS_CUST_SQL},
u AS (SELECT {fold_sql('id', 10, 'hold')} = 0 AS h, 'y' AS col, CAST(y AS DOUBLE) AS v FROM f
      UNION ALL SELECT {fold_sql('id', 10, 'hold')} = 0, 'x', x FROM f),
t AS (SELECT col, count(*) FILTER (h) AS n_in, count(*) FILTER (NOT h) AS n_out
      FROM u WHERE v IS NOT NULL GROUP BY col),
c AS (SELECT col, v, count(*) FILTER (h) AS a, count(*) FILTER (NOT h) AS b
      FROM u WHERE v IS NOT NULL GROUP BY col, v),
s AS (SELECT col, v, sum(a) OVER w AS ca, sum(b) OVER w AS cb, lead(v) OVER w - v AS width
      FROM c WINDOW w AS (PARTITION BY col ORDER BY v)),
g AS (SELECT s.col, v, n_in, n_out, abs(ca / n_in - cb / n_out) AS gap, width FROM s JOIN t ON s.col = t.col)
SELECT col AS "column", n_in, n_out, round(max(gap), 9) AS ks, arg_min(v, (-gap, v)) AS ks_at,
       round(sqrt(ln(40) / 2 * (n_in + n_out) / (n_in::DOUBLE * n_out)), 9) AS ks_critical,
       round(sum(gap * width), 6) AS wasserstein
FROM g GROUP BY col, n_in, n_out""")
def q_holdout_drift(spark, sf_dir):
    f = ho.split_holdout(orders_with_customer(spark, sf_dir), "id")
    return dr.drift(f, "is_holdout", ["y", "x"]).select(
        "column", "n_in", "n_out", F.round("ks", 9).alias("ks"), "ks_at",
        F.round("ks_critical", 9).alias("ks_critical"), *_r6("wasserstein"))


# --- D22: which segments hold the error --------------------------------------------------

SLICE_ATTRS = ("flag", "status", "price", "discount", "tax")


def _slices_sql() -> str:
    """Every slice of one or two conditions, by one GROUP BY for each set of attributes."""
    sets = [(a,) for a in SLICE_ATTRS] + list(combinations(SLICE_ATTRS, 2))
    parts = [f"SELECT {len(s)} AS level, " + " || ' & ' || ".join(f"'{a}=' || {a}" for a in s)
             + ", count(*), CAST(sum(CAST(err AS DECIMAL(38,9))) AS DOUBLE) FROM s GROUP BY " + ", ".join(s)
             for s in sets]
    return " UNION ALL ".join(parts)


@register("worst_slices", oracle=f"""
WITH f AS (SELECT l_returnflag AS flag, l_linestatus AS status, floor(l_extendedprice / 10000)::INT::VARCHAR AS price,
                  round(l_discount * 100)::INT::VARCHAR AS discount, round(l_tax * 100)::INT::VARCHAR AS tax,
                  l_extendedprice * (1 - l_discount) AS y, {fold_sql('l_orderkey', K)} AS fold FROM lineitem),
{fold_sums_sql('fg', 'f', ['flag'])},
p AS (SELECT b.*, {other_folds_sql('fg', ['flag'])} AS pred FROM f b),
s AS (SELECT *, abs(y - pred) AS err FROM p),
a AS (SELECT count(*) AS n, CAST(sum(CAST(err AS DECIMAL(38,9))) AS DOUBLE) / count(*) AS mae FROM s),
u(level, slice, n, e) AS ({_slices_sql()}),
r AS (SELECT u.*, 0.99::DOUBLE * (u.e / u.n / a.mae - 1) - (1 - 0.99::DOUBLE) * (a.n::DOUBLE / u.n - 1) AS score
      FROM u, a WHERE u.n >= ceil(0.01::DOUBLE * a.n))
SELECT row_number() OVER (ORDER BY score DESC, level, slice)::INT AS rank, level::INT AS level, slice,
       n::BIGINT AS n_rows, round(e / n, 4) AS mae, round(score, 6) AS score
FROM r WHERE score > 0 ORDER BY score DESC, level, slice LIMIT 20""")
def q_worst_slices(spark, sf_dir):
    """The lattice, pruned, against all slices counted one set of attributes at a
    time: where does the mean net price of a return flag miss most?"""
    def whole(c):
        return F.round(c).cast("int").cast("string")

    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.floor(F.col("l_extendedprice") / 10000).cast("int").cast("string").alias("price"),
        whole(F.col("l_discount") * 100).alias("discount"), whole(F.col("l_tax") * 100).alias("tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), "l_orderkey")
    p = oof.oof_predict(fo.assign_fold(f, "l_orderkey", K), by="flag", k=K)
    name = F.concat_ws(" & ", F.transform("slice", lambda c: F.concat(c["attribute"], F.lit("="), c["value"])))
    return sl.worst_slices(p, SLICE_ATTRS, alpha=0.99).select(
        "rank", "level", name.alias("slice"), "n_rows", F.round("mae", 4).alias("mae"),
        F.round("score", 6).alias("score"))


# --- D8, D17: hundreds of columns ------------------------------------------------------------

WIDE = 200


def _wide(i: int) -> tuple[str, str]:
    return f"w{i}", f"(o_orderkey * {2 * i + 1} + o_custkey * {i * i + 3}) % {499 + i}"


@register("corr_wide", oracle="""
WITH o AS (SELECT """ + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in map(_wide, range(WIDE))) + """, o_orderkey FROM orders),
m AS (SELECT """ + ", ".join(f"avg({n}) AS {n}" for n, _ in map(_wide, range(WIDE))) + """ FROM o),
l AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS i, '{n}' AS name, list(o.{n} - m.{n} ORDER BY o_orderkey) AS v FROM o, m"
    for i, (n, _) in enumerate(map(_wide, range(WIDE)))) + """)
SELECT x.name AS a, y.name AS b, round(list_dot_product(x.v, y.v)
       / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)), 6) AS r
FROM l x JOIN l y ON x.i < y.i""")
def q_corr_wide(spark, sf_dir):
    """All 19,900 pairs of 200 derived columns, complete rows."""
    o = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in map(_wide, range(WIDE))])
    return pr.corr_pairs(o, method="blocks").select("a", "b", F.round("r", 6).alias("r"))


# --- R3, D5: states that grow batch by batch ---------------------------------------------------

@register("oof_group_mean_stored", oracle=f"""
WITH {ORDERS_OOF_SQL}
SELECT id, fold, round(pred, 6) AS pred FROM p""")
def q_oof_group_mean_stored(spark, sf_dir):
    """Three batches, one put in twice, merged halfway: as if all facts came at once."""
    f = orders_fact(spark, sf_dir)
    store = StoredSums(spark, scratch_path(spark, "sums"), f.schema, "g")
    for batch in (0, 1, 1, 2):
        store.add(f.where(F.pmod("id", F.lit(3)) == batch), batch)
        if batch == 0:
            store.compact()
    return store.predict(f, K).select("id", "fold", *_r6("pred"))


STORED_COLS = ("l_quantity", "l_extendedprice", "l_partkey")


@register("profile_stored", oracle=" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, min({c})::DOUBLE AS min,
       max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd,
       true AS distinct_ok, true AS quartiles_ok FROM lineitem""" for c in STORED_COLS))
def q_profile_stored(spark, sf_dir):
    """Four batches stored one after the other and merged; counts, extremes and
    moments are exact, the sketches are held to 3 % of the distinct values and 1 %
    of the ranks."""
    li = table(spark, sf_dir, "lineitem").select(*STORED_COLS, "l_orderkey")
    store = ps.StoredProfile(spark, scratch_path(spark, "profile"), STORED_COLS)
    for batch in range(4):
        store.add(li.where(F.pmod("l_orderkey", F.lit(4)) == batch), batch)
        if batch == 1:
            store.compact()
    got = {r["column"]: r for r in store.report().collect()}  # one row a column
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    exact = li.agg(*[F.struct(F.count_distinct(c).alias("d"), *[
        F.struct((F.count(F.when(F.col(c) < got[c][q], 1)) / F.count(c)).alias("lo"),
                 (F.count(F.when(F.col(c) <= got[c][q], 1)) / F.count(c)).alias("hi")).alias(q)
        for q in probs]).alias(c) for c in STORED_COLS]).first()
    rows = []
    for c, r in got.items():
        e = exact[c]
        rows.append((c, r["n_rows"], r["n_null"], r["min"], r["max"], r["mean"], r["sd"],
                     abs(r["n_distinct"] - e["d"]) <= 0.03 * e["d"],
                     all(e[q]["lo"] - 0.01 <= p <= e[q]["hi"] + 0.01 for q, p in probs.items())))
    return spark.createDataFrame(rows, "column string, n_rows long, n_null long, min double, max double, "
                                 "mean double, sd double, distinct_ok boolean, quartiles_ok boolean").select(
        "column", "n_rows", "n_null", "min", "max", F.round("mean", 4).alias("mean"),
        F.round("sd", 4).alias("sd"), "distinct_ok", "quartiles_ok")
