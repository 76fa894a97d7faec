"""Named queries over a directory of tables: ``fn(spark, directory) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.categories import rank_of
from ..functions.geometry import AOI_RADIUS, item_x, item_y
from ..functions.sql import add, aggregates, quoted
from ..functions.student_t import t_quantile
from ..operators import attach as at
from ..operators import classify as cl
from ..operators import drift, errors, exclude, lagged, phases, positions, reshape, summarize, trial_log
from ..operators.markers import PATTERNS
from ..operators.parted import together
from ..sources import event_tables as tables
from ..sources.schemas import DRIFT_EXP1, TRIAL_LOG
from ..sources.scratch import new_folder
from ..sources.stored_events import store_events
from ..sources.summaries import read_rows, write_summary
from ..sources.trial_logs import EVENT_KEY, duplicate_events, read_trial_logs, schema_diff_files
from . import behaviour, gaze, saccades

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round double columns once, at the edge of a report."""
    # adding 0 turns a negative zero into zero
    cols = [
        f"round({f.name}, {DIGITS}) + 0D AS {f.name}" if isinstance(f.dataType, T.DoubleType) else f.name
        for f in df.schema
    ]
    return df.selectExpr(*cols)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, directory: rounded(fn(spark, directory))
    return fn


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return behaviour.prepared_trials(tables.load_trial_log(spark, d))


def _repeat_trials(spark: SparkSession, d: str) -> DataFrame:
    return behaviour.trials_with_repeats(tables.load_trial_log(spark, d))


# ---- sources and shape ----


@query
def load_trials(spark, d):
    """Declared schema, plain column names, one response column."""
    return tables.load_trial_log(spark, d)


@query
def load_fixations(spark, d):
    return tables.load_fixations(spark, d, relabel=False)


@query
def load_saccades(spark, d):
    return tables.load_saccades(spark, d)


@query
def duplicate_keys(spark, d):
    """Lines that share (order, line number): the key check run on a table that has duplicates."""
    lines = tables.read_table(spark, d, "lineitem")
    return duplicate_events(lines, ["l_orderkey", "l_linenumber"])


@query
def schema_fill(spark, d):
    """Stack three shapes of the event table; two columns may be absent."""
    e = tables.read_table(spark, d, "events")
    shapes = [
        e.where("event_type IN ('view', 'click')").select("event_id", "event_type", "value", "user_id"),
        e.where("event_type IN ('purchase', 'error')").select("event_type", "event_id", "value", "props"),
        e.where("event_type = 'signup'").select("event_id", "event_type", "user_id", "props", "value"),
    ]
    return drift.union_filled(shapes, ["user_id", "props"])


@query
def schema_diff(spark, d):
    """Field names (event type and value band) that some user never produced."""
    e = tables.read_table(spark, d, "events")
    pairs = e.selectExpr("user_id", "concat_ws('_', event_type, CAST(floor(value / 100) AS STRING)) AS field")
    return drift.not_shared(pairs, "user_id", "field")


@query
def pivot_roundtrip(spark, d):
    """Ten orientation columns to (loc, ori) rows and back."""
    log = trial_log.experiment_trials(tables.load_trial_log(spark, d))
    cols = positions.ORIENTATION_COLUMNS
    long = reshape.to_long(log, ["participant", "tno"], cols, "loc", "ori")
    return reshape.to_wide(long, ["participant", "tno"], "loc", cols, "ori")


#: columns that the written logs have beside the declared ones, by the third of the participants they belong to
_EXTRA = {0: {}, 1: {"int14_2.started": "concat('s', participant)"}, 2: {"int14_2.started": "'0'", "per15_2.started": "CAST(response_corr + 1 AS STRING)"}}


def _written_logs(spark: SparkSession, d: str) -> list[str]:
    """The trial log as CSV files with three different headers: other columns in another order."""
    log = tables.trial_log(tables.read_table(spark, d, "events"))
    folder = new_folder(spark, "logs")
    paths = []
    for third, extra in _EXTRA.items():
        rows = add(log.where(f"CAST(participant AS INT) % 3 = {third}").withColumnRenamed("response.corr", "response_corr"), extra)
        rows = rows.withColumnRenamed("response_corr", "response.corr")
        names = rows.columns[::-1] if third == 1 else rows.columns[third:] + rows.columns[:third]
        rows.select(*map(quoted, names)).write.csv(f"{folder}/{third}", header=True, nullValue="NA")
        paths.append(f"{folder}/{third}")
    return paths


@query
def csv_trial_log(spark, d):
    """Trial logs written as CSV with differing headers and read back by column name in one scan."""
    log = read_trial_logs(spark, _written_logs(spark, d), DRIFT_EXP1)
    return log.select(*TRIAL_LOG.fieldNames(), "int14_2_started", "per15_2_started", "response_pract_rt")


@query
def csv_schema_diff(spark, d):
    """Columns that not all of the written logs have, from the headers alone."""
    return schema_diff_files(spark, _written_logs(spark, d)).select("field")


@query
def summary_roundtrip(spark, d):
    """Response times without repeats, written as a numbered CSV summary, replaced, and read back."""
    summary = behaviour.norep_rt(_repeat_trials(spark, d))
    path = new_folder(spark, "summary")
    write_summary(summary.limit(0), path)
    write_summary(summary, path, mode="overwrite")
    return read_rows(spark, path)


# ---- trial log ----


@query
def trial_blocks(spark, d):
    log = trial_log.trial_blocks(tables.load_trial_log(spark, d))
    return log.select("participant", "blocktype", "tno", "response_corr")


@query
def recode_levels(spark, d):
    """Response label with unknown levels as NULL, and its rank."""
    log = trial_log.label_response(trial_log.experiment_trials(tables.load_trial_log(spark, d)))
    counts = log.groupBy("response").agg(*aggregates({"n": "count(1)"}))
    return add(counts, {"response_rank": rank_of("response", trial_log.RESPONSES)})


@query
def item_positions(spark, d):
    log = positions.item_positions(trial_log.experiment_trials(tables.load_trial_log(spark, d)))
    return log.select("participant", "tno", "tar1_pos", "tar2_pos", "dist_pos")


@query
def distractor_region(spark, d):
    return _trials(spark, d).select("participant", "tno", "dist_pos", "dist_region", "distractor")


@query
def target_regions(spark, d):
    """Regions of both targets, the pair label, and the region visited first."""
    trials = positions.target_regions(_trials(spark, d))
    markers = gaze.markers_of(tables.load_fixations(spark, d)).select(*at.TRIAL, "first_target_id")
    joined = positions.first_target_region(trials.join(markers, list(at.TRIAL), "left"))
    return joined.select(*at.TRIAL, "tar1_region", "tar2_region", "tar_regions", "first_region_fixed")


@query
def dist_repeat(spark, d):
    return _repeat_trials(spark, d).select("participant", "tno", "dist_pos", "dist_rep")


@query
def rt_by_region(spark, d):
    return behaviour.rt_by_region(_trials(spark, d))


@query
def accuracy_by_region(spark, d):
    return behaviour.accuracy_by_region(_trials(spark, d))


@query
def within_rt(spark, d):
    return behaviour.within_rt(_trials(spark, d))


@query
def within_acc(spark, d):
    return behaviour.within_accuracy(_trials(spark, d), pool_responses=True)


@query
def within_acc_go(spark, d):
    return behaviour.within_accuracy(_trials(spark, d), pool_responses=False)


@query
def norep_rt(spark, d):
    return behaviour.norep_rt(_repeat_trials(spark, d))


@query
def norep_rt_both(spark, d):
    """Two experiments side by side in one pass: users with even and with odd group number."""
    events = tables.read_table(spark, d, "events")
    # the tag follows from the trial number, so it can be added to the finished log
    log = add(tables.declare(tables.trial_log(events)), {"experiment": f"CASE WHEN coalesce(trials_thisN, practice_trials_thisRepN) div {tables.BLOCKS} % 2 = 1 THEN 'exp2' ELSE 'exp1' END"})
    log = log.selectExpr("* EXCEPT (participant)", "concat(experiment, ':', participant) AS participant")
    return behaviour.norep_rt(behaviour.trials_with_repeats(log), ["experiment"])


# ---- fixations ----


@query
def gaze_distance(spark, d):
    fx = cl.gaze_distances(tables.load_fixations(spark, d))
    return fx.select("participant", "tno", "fix_count", "tar1_dist", "tar2_dist", "dist_dist", "fix_dist")


@query
def fix_class(spark, d):
    fx = cl.classify(tables.load_fixations(spark, d))
    return fx.select("participant", "tno", "fix_count", "fix_type", "tar_fixed")


@query
def aoi_outline(spark, d):
    """Outline points of the areas of interest of every trial's targets and distractor."""
    trials = _trials(spark, d)
    long = reshape.to_long(trials, ["participant", "tno"], ["tar1_pos", "tar2_pos", "dist_pos"], "item", "pos")
    layout = long.where("pos > 0").selectExpr(
        "participant", "tno", "item", f"{item_x('pos')} AS x", f"{item_y('pos')} AS y", f"{AOI_RADIUS}D AS radius"
    )
    points = cl.circle_outline(layout, "x", "y", "radius")
    return points.select("participant", "tno", "item", "point", "outline_x", "outline_y")


@query
def fix_pattern(spark, d):
    markers = gaze.markers_of(tables.load_fixations(spark, d))
    rank = rank_of("fix_pattern", PATTERNS)
    return markers.selectExpr("participant", "tno", "fix_pattern", f"{rank} AS pattern_rank")


@query
def fix_pattern_share(spark, d):
    return gaze.pattern_share(tables.load_fixations(spark, d))


@query
def display_visits(spark, d):
    """Visits of two or three items a trial."""
    visits = gaze.display_visits(tables.load_fixations(spark, d))
    return visits.select(
        "participant", "tno", "n_items", "n_seen", "visit_pattern", "seen_order",
        "first_item", "first_item_at", "first_item_time", "all_seen_at", "all_seen_time",
    )


@query
def display_visit_share(spark, d):
    return gaze.display_visit_share(tables.load_fixations(spark, d))


@query
def display_scan_time(spark, d):
    return gaze.display_scan_time(tables.load_fixations(spark, d))


@query
def enrich_full(spark, d):
    """Fixations with the repeat label of their trial; practice events have no trial."""
    fx = tables.load_fixations(spark, d).select("participant", "tno", "fix_count", "cat", "duration")
    repeats = _repeat_trials(spark, d).select("participant", "tno", "dist_rep")
    return at.enrich_full(fx, repeats)


@query
def trial_markers(spark, d):
    markers = gaze.markers_of(tables.load_fixations(spark, d))
    return markers.select(
        "participant", "tno", "n_events", "n_search", "first_search",
        "first_target", "first_target_id", "first_target_time",
        "both_targets", "both_targets_time", "first_distractor", "first_distractor_time",
    )


@query
def checked_markers(spark, d):
    """Markers that also check in the same aggregation that no event key repeats."""
    markers = gaze.trial_markers(cl.classify(tables.load_fixations(spark, d)), unique_keys=True)
    return markers.select("participant", "tno", "n_events", "first_target", "both_targets", "first_distractor_time", "fix_pattern")


@query
def dist_phase(spark, d):
    events = cl.classify(tables.load_fixations(spark, d))
    return phases.label_phases(events, gaze.trial_markers(events)).select("participant", "tno", "fix_count", "dfix_type")


@query
def first_fix_share(spark, d):
    return gaze.first_object_share(tables.load_fixations(spark, d))


@query
def target_region_rt(spark, d):
    return gaze.target_region_rt(tables.load_fixations(spark, d))


@query
def between_se(spark, d):
    cells = gaze.target_region_cells(tables.load_fixations(spark, d))
    return errors.between_error(cells, ["tar_regions", "response"], "rt", "rt")


@query
def phase_prop(spark, d):
    return gaze.phase_prop(tables.load_fixations(spark, d))


@query
def phase_prop_long(spark, d):
    return gaze.phase_prop_long(gaze.phase_prop(tables.load_fixations(spark, d)))


@query
def phase_prop_norep(spark, d):
    return gaze.phase_prop_norep(tables.load_fixations(spark, d), _repeat_trials(spark, d), need_both=True)


@query
def phase_prop_norep_any(spark, d):
    return gaze.phase_prop_norep(tables.load_fixations(spark, d), _repeat_trials(spark, d), need_both=False)


@query
def dist_dur_cells(spark, d):
    return gaze.distractor_duration_cells(tables.load_fixations(spark, d))


@query
def dist_dur_first(spark, d):
    return gaze.distractor_duration(tables.load_fixations(spark, d))


@query
def target_dur(spark, d):
    return gaze.target_duration(tables.load_fixations(spark, d))


@query
def refix_cells(spark, d):
    return gaze.refixation_cells(tables.load_fixations(spark, d))


@query
def refix_after(spark, d):
    return gaze.refixation_after(tables.load_fixations(spark, d))


@query
def refix_after_complete(spark, d):
    return gaze.refixation_after(tables.load_fixations(spark, d), all_cells=8)


# ---- saccades ----


def _eye(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tables.load_saccades(spark, d), gaze.markers_of(tables.load_fixations(spark, d))


@query
def asof_target(spark, d):
    rows = saccades.leading_saccades(*_eye(spark, d), ["Target"])
    return rows.select("participant", "tno", "start_time", "marker", "marker_time", "latency")


@query
def asof_distractor(spark, d):
    rows = saccades.leading_saccades(*_eye(spark, d), ["Distractor"])
    return rows.select("participant", "tno", "start_time", "marker", "marker_time", "latency")


@query
def sacc_first_search(spark, d):
    """Natural full join of leading saccades with the first search event of every trial, for both kinds of event."""
    rows = saccades.with_first_search(*_eye(spark, d))
    return rows.select("participant", "tno", "kind", "marker", "first_search", "latency")


@query
def enrich_saccades(spark, d):
    """Saccades with the repeat label of their trial, and trials without saccades."""
    sc = tables.load_saccades(spark, d).select("participant", "tno", "cat", "start_time")
    return at.enrich_full(sc, _repeat_trials(spark, d).select("participant", "tno", "dist_rep"))


@query
def sacc_latency_all(spark, d):
    return saccades.latency_all(*_eye(spark, d))


@query
def sacc_latency_first(spark, d):
    return saccades.first_latency_summary(*_eye(spark, d))


# ---- the same analyses on stored tables ----


def _stored(spark: SparkSession, d: str):
    """Both event tables, bucketed by trial in the scratch folder, with checked keys."""
    events = {"fixations": tables.load_fixations(spark, d), "saccades": tables.load_saccades(spark, d)}
    return store_events(events, new_folder(spark, "events"), buckets=8, keys={"fixations": EVENT_KEY})


@query
def stored_markers(spark, d):
    markers = gaze.markers_of(_stored(spark, d)["fixations"])
    return together(markers).select("participant", "tno", "n_events", "first_target", "both_targets", "first_distractor_time", "fix_pattern")


@query
def stored_phase_prop(spark, d):
    return gaze.phase_prop(_stored(spark, d)["fixations"])


@query
def stored_latency(spark, d):
    """Leading saccades of both kinds: the as-of lookup between two stored tables."""
    store = _stored(spark, d)
    rows = together(saccades.leading_saccades(store["saccades"], gaze.markers_of(store["fixations"])))
    return rows.select("participant", "tno", "type", "start_time", "marker", "marker_time", "latency")


@query
def stored_enriched(spark, d):
    """Stored fixations with the repeat label of their trial, and trials without fixations."""
    fx = _stored(spark, d)["fixations"].select("participant", "tno", "fix_count", "cat", "duration")
    return at.enrich_full(fx, _repeat_trials(spark, d).select("participant", "tno", "dist_rep"))


# ---- the general operators on other tables ----


def _subjects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and the order statuses each of them has had."""
    customers = tables.read_table(spark, d, "customer").selectExpr("c_custkey AS subject", "c_mktsegment", "c_acctbal")
    orders = tables.read_table(spark, d, "orders").selectExpr("o_custkey AS subject", "o_orderstatus", "o_totalprice")
    return customers, orders


@query
def complete_subjects(spark, d):
    """Customers with orders in every status (intersection of three sets, semi-join)."""
    customers, orders = _subjects(spark, d)
    listed = exclude.participants_with(orders, [f"o_orderstatus = '{s}'" for s in "FOP"], "subject")
    return exclude.keep_participants(customers, listed, "subject")


@query
def gapless_subjects(spark, d):
    """Customers without a missing mean: drops those lacking open or finished orders (anti-join)."""
    customers, orders = _subjects(spark, d)
    means = summarize.cell_mean(orders, ["subject", "o_orderstatus"], "o_totalprice", "price")
    wide = reshape.to_wide(means, ["subject"], "o_orderstatus", ["F", "O"], "price")
    return exclude.drop_participants(customers, exclude.participants_missing(wide, ["F", "O"], "subject"), "subject")


@query
def within_orders(spark, d):
    """Order value by priority with the customer as subject."""
    orders = tables.read_table(spark, d, "orders")
    return errors.within_error(orders, ["o_orderpriority"], {"price": "o_totalprice"}, subject="o_custkey")


@query
def within_lineitem(spark, d):
    """Two measures by return flag with the supplier as subject."""
    lines = tables.read_table(spark, d, "lineitem")
    measures = {"price": "l_extendedprice", "quantity": "l_quantity"}
    return errors.within_error(lines, ["l_returnflag"], measures, subject="l_suppkey")


@query
def two_level_lineitem(spark, d):
    """Mean price per order, then mean of the orders, by return flag."""
    lines = tables.read_table(spark, d, "lineitem")
    return summarize.two_level_mean(lines, ["l_returnflag"], "l_extendedprice", "price", unit=["l_orderkey"])


@query
def share_lineitem(spark, d):
    lines = tables.read_table(spark, d, "lineitem")
    return summarize.share_within(lines, ["l_returnflag"], "l_linestatus")


@query
def previous_event(spark, d):
    """Value of each user's event before, in the order of time stamps."""
    events = tables.read_table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return lagged.previous_in_order(events, ["user_id"], ["ts", "event_id"], "value", "previous").select("event_id", "user_id", "previous")


@query
def first_line_sum(spark, d):
    """Price of the first line of each order; lines that share the least number are added up."""
    lines = tables.read_table(spark, d, "lineitem")
    return summarize.sum_at_first(lines, ["l_orderkey"], "l_linenumber", "l_extendedprice", "price")


@query
def within_merged(spark, d):
    """Order value by priority from the stored cells of three periods, merged."""
    orders, by, measures = tables.read_table(spark, d, "orders"), ["o_orderpriority"], {"price": "o_totalprice"}
    period = "pmod(datediff(o_orderdate, DATE '1992-01-01'), 3)"
    states = []
    for i in range(3):
        path = new_folder(spark, "cells")
        errors.error_cells(orders.where(f"{period} = {i}"), by, measures, "o_custkey").write.parquet(path)
        states.append(spark.read.parquet(path))
    return errors.error_of_cells(errors.merge_cells(states, by, "o_custkey"), by, list(measures), "o_custkey")


@query
def welch_quantiles(spark, d):
    """Degrees of freedom for comparing two price means by supplier (not whole numbers), and t at two levels."""
    lines = tables.read_table(spark, d, "lineitem")
    parts = {}
    for flag in "RN":
        price = f"CASE WHEN l_returnflag = '{flag}' THEN l_extendedprice END"
        parts |= {f"n{flag}": f"count({price})", f"q{flag}": f"var_samp({price}) / count({price})"}
    cells = lines.groupBy("l_suppkey").agg(*aggregates(parts)).where("nR > 1 AND nN > 1")
    cells = add(cells, {"df": "try_divide(power(qR + qN, 2), qR * qR / (nR - 1) + qN * qN / (nN - 1))"})
    return cells.selectExpr("l_suppkey", "df", f"{t_quantile(0.95, 'df')} AS t_90", f"{t_quantile(0.9995, 'df')} AS t_999")
