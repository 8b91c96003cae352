"""Model, file and consistency queries.

Driver queries fit all 200 rounds; one fitted model is reused per (session,
data folder). MLlib runs one job a tree level, so the training rows are dealt
into partitions of about ``FIT_ROWS_A_TASK`` rows, but no more than
``FIT_TASKS_A_CORE`` for each core: beyond that a level waits for the launch of its
tasks. A partition has at most ``FIT_MOST_ROWS`` rows, whatever the cores.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import priority_formula
from ..operators import boosting, checks, enrich, model as M
from ..session import ensure_checkpoint_dir, fresh_dir
from ..sources import files
from ..sources.tickets import stored_tickets as T
from .catalog import r6, register
from .pipeline import run_pipeline
from .sql import PROPENSITY_SQL, d, hours_since, round_even, with_tickets

FIT_ROWS_A_TASK = 50_000
FIT_TASKS_A_CORE = 2
FIT_MOST_ROWS = 2_000_000
_P = "pred_sla_breach_prob"
_MODELS: dict[tuple[str, str], object] = {}


def _split(spark, sf):
    return M.stratified_split(T(spark, sf))


def _checkpointed(spark, sf, name, build):
    """Build once per (session, data folder) and cut the lineage with a
    reliable checkpoint in the session's checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MODELS:
        ensure_checkpoint_dir(spark)
        _MODELS[key] = build().checkpoint(eager=True)
    return _MODELS[key]


def fit_tasks(rows: int, cores: int) -> int:
    return max(1, min(-(-rows // FIT_ROWS_A_TASK), FIT_TASKS_A_CORE * cores), -(-rows // FIT_MOST_ROWS))


def _fitted(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        train = M.features(_split_stored(spark, sf).where(~F.col("is_test")))
        rows = train.count()
        tasks = fit_tasks(rows, spark.sparkContext.defaultParallelism)
        _MODELS[key] = M.train_gbt(train.repartition(tasks, "ticket_id"), rows)
    return _MODELS[key]


def _test(spark, sf):
    return M.features(_split_stored(spark, sf).where(F.col("is_test")))


def _split_stored(spark, sf):
    """The split, computed once and checkpointed: train and test read it."""
    return _checkpointed(spark, sf, "split", lambda: _split(spark, sf))


# SQL for the exact split: per label, ceil(0.2 n) rows by md5 order are test.
_SPLIT_CTE = ("_split AS (SELECT *, rn <= CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS is_test FROM (SELECT *, "
              "row_number() OVER (PARTITION BY sla_breach ORDER BY md5(ticket_id || '42'), ticket_id) AS rn, "
              "count(*) OVER (PARTITION BY sla_breach) AS n FROM tickets))")


@register("m01_features", with_tickets(f"SELECT ticket_id, sla_breach, {', '.join(M.FEATURES)} FROM tickets"))
def m01_features(spark, sf):
    return M.features(T(spark, sf))


@register("m03_standardize", with_tickets(
    "SELECT ticket_id, " + ", ".join(
        f"round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0::DOUBLE ELSE ({c} - avg({c}) OVER ()) / "
        f"stddev_pop({c}) OVER () END, 6) AS {c}_z" for c in M.NUM_COLS) + " FROM tickets"))
def m03_standardize(spark, sf):
    z = M.standardize(T(spark, sf))
    return z.select("ticket_id", *[r6(f"{c}_z").alias(f"{c}_z") for c in M.NUM_COLS])


@register("m04_stratified_split", with_tickets("SELECT ticket_id, sla_breach, is_test FROM _split", _SPLIT_CTE))
def m04_stratified_split(spark, sf):
    return _split(spark, sf).select("ticket_id", "sla_breach", "is_test")


@register("m07_auc_risk_score", with_tickets(
    "SELECT round(sum(pos * (below + 0.5::DOUBLE * neg)) / (sum(pos) * sum(neg)), 9) AS auc FROM ("
    "SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS below FROM (SELECT round(pred_sla_breach_prob, 9) AS p, sum(sla_breach) AS pos, sum(1 - sla_breach) "
    "AS neg FROM _split WHERE is_test GROUP BY 1))", _SPLIT_CTE))
def m07_auc_risk_score(spark, sf):
    # The score is rounded to 9 digits so one-ulp differences of ``exp``
    # between engines cannot split ties differently.
    test = _split(spark, sf).where(F.col("is_test")).withColumn(_P, F.round(_P, 9))
    return M.auc(test, _P).select(F.round("auc", 9).alias("auc"))


@register("m08_brier", with_tickets(
    "SELECT round(avg((pred_sla_breach_prob - sla_breach) * (pred_sla_breach_prob - sla_breach)), 6) AS brier "
    "FROM _split WHERE is_test", _SPLIT_CTE))
def m08_brier(spark, sf):
    return M.brier(_split(spark, sf).where(F.col("is_test")), _P).select(r6("brier").alias("brier"))


@register("m09_split_rates", with_tickets(
    "SELECT is_test, count(*) AS rows, round(avg(sla_breach), 6) AS breach_rate FROM _split GROUP BY is_test",
    _SPLIT_CTE))
def m09_split_rates(spark, sf):
    return M.split_rates(_split(spark, sf)).withColumn("breach_rate", r6("breach_rate"))


@register("m10_risk_calibration", with_tickets(
    "SELECT round(coalesce(avg(CASE WHEN pred_sla_breach_prob > 0.7 THEN sla_breach END), 0.0::DOUBLE), 6) AS "
    "high_risk_breach_rate, round(coalesce(avg(CASE WHEN pred_sla_breach_prob < 0.3 THEN sla_breach END), "
    "0.0::DOUBLE), 6) AS low_risk_breach_rate FROM _split WHERE is_test", _SPLIT_CTE))
def m10_risk_calibration(spark, sf):
    c = M.risk_calibration(_split(spark, sf).where(F.col("is_test")), _P)
    return c.select(r6("high_risk_breach_rate").alias("high_risk_breach_rate"),
                    r6("low_risk_breach_rate").alias("low_risk_breach_rate"))


_W = dims.DEFAULT_PRIORITY_WEIGHTS
_W5 = (_W["risk"], _W["severity"], _W["vuln"], _W["sent"], _W["fest"])


@register("m14_baseline_priority", with_tickets(
    "SELECT ticket_id, " + round_even(
        f"{d(100)} * least(greatest({d(_W5[0])} * {_P} + {d(_W5[1])} * (severity / {d(3)}) + {d(_W5[2])} * "
        f"CAST(vulnerable_population AS DOUBLE) + {d(_W5[3])} * ((-citizen_sentiment + {d(1)}) / {d(2)}) + "
        f"{d(_W5[4])} * CAST(festival_season AS DOUBLE), {d(0)}), {d(1)})", 1) + " AS priority FROM tickets"))
def m14_baseline_priority(spark, sf):
    t = T(spark, sf)
    return t.select("ticket_id", priority_formula(_P, "severity", "vulnerable_population", "citizen_sentiment",
                                                  "festival_season", _W5).alias("priority"))


# ------------------------------------------------------------- rows-only (ML)

_LEVELS_SQL = " + ".join(f"(SELECT count(DISTINCT {c}) FROM _split WHERE NOT is_test) + 1" for c in M.CAT_COLS)


@register("m02_one_hot", with_tickets(
    f"SELECT ticket_id, CAST({_LEVELS_SQL} + {len(M.NUM_COLS)} AS INTEGER) AS width, CAST(place AS INTEGER) AS dept_index, "
    "array_to_string(list_transform(range((SELECT count(*) + 1 FROM _dept)), lambda i: CASE WHEN i = place THEN '1' ELSE '0' END), '') "
    "AS dept_one_hot FROM tickets JOIN _dept USING (dept)", _SPLIT_CTE,
    "_dept AS (SELECT dept, row_number() OVER (ORDER BY count(*) DESC, dept) - 1 AS place FROM _split WHERE NOT is_test GROUP BY dept)"))
def m02_one_hot(spark, sf):
    """Encoders fitted on the training rows, applied to all tickets."""
    train = M.features(_split_stored(spark, sf).where(~F.col("is_test")))
    out = Pipeline(stages=M.encoding_stages()).fit(train).transform(M.features(T(spark, sf)))
    digits = F.transform(vector_to_array("dept_ohe"), lambda x: x.cast("int").cast("string"))
    return out.select("ticket_id", F.size(vector_to_array("features")).alias("width"), F.col("dept_idx").cast("int").alias("dept_index"),
                      F.array_join(digits, "").alias("dept_one_hot"))


# Importance of the features for the breach propensity (E07). The scores are rounded to 9
# digits, so that one-ulp differences of ``exp`` between engines cannot split ties.
REPEATS = 3


def _variant_sql(f: str) -> str:
    cols = ", ".join(f"r.{c} AS {c}" if c == f else f"l.{c} AS {c}" for c in M.FEATURES)
    return f"SELECT '{f}' AS feature, r.repeat, l.sla_breach, {cols} FROM _left l JOIN _right r ON l.place = r.place"


def _auc_sql(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return (f"SELECT {keys}sum(pos * (below + 0.5::DOUBLE * neg)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT {keys}pos, neg, "
            f"coalesce(sum(neg) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM "
            f"(SELECT {keys}round({PROPENSITY_SQL}, 9) AS p, sum(sla_breach) AS pos, sum(1 - sla_breach) AS neg FROM {source} "
            f"GROUP BY {keys}p)) {'GROUP BY ' + by if by else ''}")


_IMPORTANCE_CTES = (
    _SPLIT_CTE,
    "_left AS (SELECT *, row_number() OVER (ORDER BY md5(ticket_id || 'left42'), ticket_id) AS place FROM _split WHERE is_test)",
    f"_right AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY md5(ticket_id || 'right42-' || repeat), ticket_id) AS place "
    f"FROM _split, (SELECT unnest(range({REPEATS})) AS repeat) WHERE is_test)",
    "_variants AS (" + " UNION ALL ".join(_variant_sql(f) for f in M.FEATURES) + ")",
    f"_base AS ({_auc_sql('(SELECT * FROM _split WHERE is_test)')})",
    f"_aucs AS ({_auc_sql('_variants', 'feature, repeat')})",
    "_importance AS (SELECT feature, round(avg((SELECT auc FROM _base) - auc), 9) + 0.0::DOUBLE AS importance_mean, "
    "round(stddev_pop((SELECT auc FROM _base) - auc), 9) + 0.0::DOUBLE AS importance_std FROM _aucs GROUP BY feature)",
)


def _propensity(df):
    return enrich.breach_propensity(df, out=_P).withColumn(_P, F.round(_P, 9))


def _score_importance(spark, sf):
    def build():
        got = M.permutation_importance(_propensity, _test(spark, sf), repeats=REPEATS)
        return got.select("feature", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("importance_mean", "importance_std")])
    return _checkpointed(spark, sf, "score-importance", build)


@register("m12_score_importance", with_tickets("SELECT * FROM _importance", *_IMPORTANCE_CTES))
def m12_score_importance(spark, sf):
    return _score_importance(spark, sf)


@register("m13_score_top_features", with_tickets(
    "SELECT * FROM _importance ORDER BY importance_mean DESC, feature LIMIT 10", *_IMPORTANCE_CTES))
def m13_score_top_features(spark, sf):
    return M.top_features(_score_importance(spark, sf), 10)


_COEF_SQL = ", ".join(f"('{f}', {d(c)})" for f, c in dims.LOGIT_COEFFICIENTS.items())


@register("v05_score_consistency", with_tickets(
    "SELECT *, CASE WHEN issues = 0 THEN 'PASS' ELSE 'WARNING' END AS overall FROM (SELECT *, CAST(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS issues FROM ("
    "SELECT feature, importance_mean, rank, coefficient, CASE WHEN rank <= 7 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT *, "
    "CAST(row_number() OVER (ORDER BY importance_mean DESC, feature) AS INTEGER) AS rank FROM _importance) JOIN "
    f"(VALUES {_COEF_SQL}) AS c(feature, coefficient) USING (feature) WHERE coefficient >= {d(0.5)}))", *_IMPORTANCE_CTES))
def v05_score_consistency(spark, sf):
    return checks.coef_consistency(_score_importance(spark, sf))


@register("s05_score_importance", with_tickets("SELECT * FROM _importance", *_IMPORTANCE_CTES))
def s05_score_importance(spark, sf):
    path = fresh_dir(spark, "importance")
    files.write_importance(_score_importance(spark, sf), path)
    return files.read_importance(spark, path)


# The first tree of the boosting over histograms, over fixed cuts of the numbers.
TREE_DEPTH = 4
_TREE_CUTS = {"severity": [1, 2], "citizen_sentiment": [k / 8 for k in range(-7, 8)], "vulnerable_population": [0],
              "historical_backlog": list(range(5, 120, 5)), "resource_availability": [k / 16 for k in range(1, 16)],
              "weather_rain_mm": list(range(1, 31)), "traffic_index": list(range(4, 100, 4)), "festival_season": [0],
              "created_hour": list(range(23)), "is_business_hours": [0], "is_weekend": [0]}
_CODES_SQL = ", ".join([f"dense_rank() OVER (ORDER BY {c}) - 1" for c in M.CAT_COLS] + [
    " + ".join(f"CAST({c} > {d(x)} AS INTEGER)" for x in _TREE_CUTS[c]) for c in M.NUM_COLS])
_FEATURES_SQL = "[" + ", ".join(f"'{f}'" for f in M.FEATURES) + "]"


def _level_sql(k: int) -> list[str]:
    """Sums, totals, best splits of depth ``k``, and the rows below them."""
    n_cats = len(M.CAT_COLS)
    running = ", ".join(f"CASE WHEN f >= {n_cats} THEN sum({x}) OVER w ELSE {x} END AS l{x}" for x in "nrh")
    return [
        f"_hist{k} AS (SELECT node, f, codes[f + 1] AS code, count(*) AS n, sum(r) AS r, sum(h) AS h FROM _rows{k}, "
        f"(SELECT unnest(range({len(M.FEATURES)})) AS f) GROUP BY 1, 2, 3)",
        f"_total{k} AS (SELECT node, sum(n) AS n, sum(r) AS r, sum(h) AS h FROM _hist{k} WHERE f = 0 GROUP BY 1)",
        f"_best{k} AS (SELECT * FROM (SELECT _l.node, f, code, round(ln * (n - ln) / n * pow(lr / ln - (r - lr) / (n - ln), 2), 9) AS gain "
        f"FROM (SELECT node, f, code, {running} FROM _hist{k} WINDOW w AS (PARTITION BY node, f ORDER BY code)) _l JOIN _total{k} "
        f"ON _l.node = _total{k}.node WHERE n >= 20 AND ln >= 10 AND n - ln >= 10) WHERE gain > 0 "
        "QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, code) = 1)",
        f"_rows{k + 1} AS (SELECT 2 * _r.node + CASE WHEN codes[f + 1] = code OR (f >= {n_cats} AND codes[f + 1] < code) THEN 1 ELSE 2 END "
        f"AS node, codes, r, h FROM _rows{k} _r JOIN _best{k} ON _r.node = _best{k}.node)"]


@register("m05_first_tree", with_tickets(
    " UNION ALL ".join(
        f"SELECT CAST(t.node AS INTEGER) AS node, {_FEATURES_SQL}[s.f + 1] AS feature, CAST(coalesce(s.code, -1) AS INTEGER) AS code, "
        f"CAST(n AS BIGINT) AS rows, round(r / h, 6) AS value FROM _total{k} t LEFT JOIN _best{k} s ON t.node = s.node" for k in range(TREE_DEPTH))
    + f" UNION ALL SELECT CAST(node AS INTEGER), NULL, -1, count(*), round(sum(r) / sum(h), 6) FROM _rows{TREE_DEPTH} GROUP BY node",
    _SPLIT_CTE,
    f"_coded AS (SELECT ticket_id, sla_breach, [{_CODES_SQL}] AS codes, avg(sla_breach) OVER () AS p FROM _split WHERE NOT is_test)",
    "_rows0 AS (SELECT 0 AS node, codes, sla_breach - p AS r, p * (1 - p) AS h FROM _coded WHERE "
    f"substr(md5(ticket_id || '42-0'), 1, 8) < '{round(0.8 * 16**8):08x}')",
    *[x for k in range(TREE_DEPTH) for x in _level_sql(k)]))
def m05_first_tree(spark, sf):
    train = M.features(_split_stored(spark, sf).where(~F.col("is_test")))
    model = boosting.fit(train, rounds=1, depth=TREE_DEPTH, cuts=_TREE_CUTS)
    return boosting.nodes(model, 0, train).withColumn("value", r6("value"))


@register("m05_train_gbt")
def m05_train_gbt(spark, sf):
    model = _fitted(spark, sf)
    scored = M.score(model, _test(spark, sf))
    a = M.auc(scored, _P)
    b = M.brier(scored, _P)
    trees = len(model.stages[-1].trees)
    return a.select(F.lit(trees).alias("trees"), "auc", b.select("brier").scalar().alias("brier"))


@register("m06_score_test")
def m06_score_test(spark, sf):
    return M.score(_fitted(spark, sf), _test(spark, sf)).select("ticket_id", "sla_breach", _P)


@register("m11_score_all")
def m11_score_all(spark, sf):
    scored = M.score(_fitted(spark, sf), T(spark, sf).drop("priority_score"))
    return scored.select("ticket_id", _P, priority_formula(_P, "severity", "vulnerable_population",
                                                           "citizen_sentiment", "festival_season", _W5)
                         .alias("priority_score"))


def _importance(spark, sf):
    return _checkpointed(spark, sf, "importance",
                         lambda: M.permutation_importance(_fitted(spark, sf), _test(spark, sf), repeats=5))


@register("m12_permutation_importance")
def m12_permutation_importance(spark, sf):
    return _importance(spark, sf)


@register("m13_top_features")
def m13_top_features(spark, sf):
    return M.top_features(_importance(spark, sf), 10)


@register("v05_coef_consistency")
def v05_coef_consistency(spark, sf):
    return checks.coef_consistency(_importance(spark, sf))


# ------------------------------------------------------------- files

@register("s01_load_predictions", with_tickets(
    "SELECT ticket_id, created_at, dept, round(pred_sla_breach_prob, 6) AS pred_sla_breach_prob, priority_score, "
    "round(resolution_hours, 6) AS resolution_hours FROM tickets"))
def s01_load_predictions(spark, sf):
    path = fresh_dir(spark, "predictions")
    files.write_predictions(T(spark, sf), path)
    back = files.load_predictions(spark, path)
    return back.select("ticket_id", "created_at", "dept", r6(_P).alias(_P), "priority_score",
                       r6("resolution_hours").alias("resolution_hours"))


@register("s02_read_back", with_tickets(
    "SELECT count(*) AS rows, count(DISTINCT ticket_id) AS ids, round(sum(priority_score), 3) AS priority_sum "
    "FROM tickets"))
def s02_read_back(spark, sf):
    path = fresh_dir(spark, "predictions")
    files.write_predictions(T(spark, sf), path)
    back = files.read_back(spark, path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ticket_id").alias("ids"),
                    F.round(F.sum("priority_score"), 3).alias("priority_sum"))


@register("s03_write_tickets", with_tickets(
    "SELECT CAST(created_at AS DATE) AS created_date, count(*) AS tickets, CAST(sum(sla_breach) AS BIGINT) AS breaches "
    "FROM tickets GROUP BY 1"))
def s03_write_tickets(spark, sf):
    path = fresh_dir(spark, "tickets")
    files.write_tickets(T(spark, sf), path)
    back = files.read_tickets(spark, path)
    return back.groupBy("created_date").agg(F.count(F.lit(1)).alias("tickets"),
                                            F.sum("sla_breach").cast("long").alias("breaches"))


@register("s05_write_importance")
def s05_write_importance(spark, sf):
    path = fresh_dir(spark, "importance")
    files.write_importance(_importance(spark, sf), path)
    return files.read_importance(spark, path)


@register("s06_save_model")
def s06_save_model(spark, sf):
    path = fresh_dir(spark, "model")
    files.save_model(_fitted(spark, sf), path)
    loaded = files.load_model(path)
    return M.score(loaded, _test(spark, sf)).select("ticket_id", _P)


@register("s08_run_summary")
def s08_run_summary(spark, sf):
    model = _fitted(spark, sf)
    scored = M.score(model, _test(spark, sf))
    metrics = M.auc(scored, _P).select("auc", M.brier(scored, _P).select("brier").scalar().alias("brier"))
    ready = checks.readiness(M.score(model, T(spark, sf)))
    return files.run_summary(metrics, ready, {"data": sf})


@register("s08_run_pipeline", with_tickets(
    "SELECT count(*) AS tickets, CAST(sum(sla_breach) AS BIGINT) AS breaches, round(avg(sla_breach), 6) AS breach_rate, 'PASS' AS verdict, "
    "count(*) AS predicted, count(DISTINCT ticket_id) AS predictions, CAST(16 AS BIGINT) AS features, TRUE AS model_fits, "
    f"round(count_if({hours_since('created_at')} > 72) * 100.0::DOUBLE / count(*), 6) AS already_breached_pct FROM tickets"))
def s08_run_pipeline(spark, sf):
    """The one-call run; what its JSON file says beside the files that it wrote."""
    out = fresh_dir(spark, "run")
    run_pipeline(T(spark, sf), out, fit=lambda train: _fitted(spark, sf))
    told = spark.read.text(f"{out}/summary").select(F.from_json(
        "value", "tickets long, breaches long, breach_rate double, data string, verdict string, predicted long, auc double, brier double, "
                 "predictions string, feature_importance string, model string, dashboard_readiness struct<already_breached_pct:double>").alias("j"))
    paths = told.select("j.*").first()
    wrote = files.read_back(spark, paths.predictions).agg(F.count_distinct("ticket_id"))
    features = files.read_importance(spark, paths.feature_importance).agg(F.count("importance_mean"))
    files.load_model(paths.model)
    return told.select("j.tickets", "j.breaches", r6(F.col("j.breach_rate")).alias("breach_rate"), "j.verdict", "j.predicted",
                       wrote.scalar().alias("predictions"), features.scalar().alias("features"),
                       ((F.col("j.auc") > 0.8) & (F.col("j.brier") < 0.2)).alias("model_fits"),
                       r6(F.col("j.dashboard_readiness.already_breached_pct")).alias("already_breached_pct"))
