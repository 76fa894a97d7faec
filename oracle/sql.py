"""One DuckDB statement per query.

The statements follow the definition step by step - aggregates joined back to the
events, ranking windows, full outer joins, intersections of participant sets - where
the Spark side uses conditional aggregates and cells, so that agreement means
something.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

# Angles of the ten display positions.
DEGREES = "30 60 90 120 150 210 240 270 300 330".split()
# Up to this many degrees of freedom t quantiles are listed; above, a polynomial in 1 / df passes through exact values.
LISTED = 40


NODES = np.polynomial.legendre.leggauss(80)


def between(t: float, df: float) -> float:
    """P(0 < T < t) by Gauss-Legendre quadrature of the density."""
    x, w = NODES
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return scale * t / 2 * float(w @ (1 + (t / 2 * (x + 1)) ** 2 / df) ** (-(df + 1) / 2))


def t_quantile(df: float) -> float:
    low, high = 1.9, 13.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if between(middle, df) < 0.475 else (low, middle)
    return (low + high) / 2


@cache
def t_tables() -> tuple[list[float], list[float]]:
    nodes = [2 * LISTED / (1 + math.cos((k + 0.5) * math.pi / 9)) for k in range(9)]  # Chebyshev points of 1 / df
    fit = np.polynomial.Polynomial.fit([1 / n for n in nodes], [t_quantile(n) for n in nodes], len(nodes) - 1).convert().coef
    return [t_quantile(i) for i in range(1, LISTED + 1)], fit.tolist()


# ---- building blocks: name -> (names it needs, body) ----

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, *needs: str):
    def keep(body: str) -> None:
        BLOCKS[name] = (needs, body)

    return keep


block("ev")(
    """
    SELECT *, us // 432000000000 AS blk, CAST(user_id % 15 AS INT) AS pid,
           CAST((user_id // 15) * 6 + us // 432000000000 AS INT) AS tno
    FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us,
                 CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
    """
)
block("disp", "ev")(
    """
    SELECT pid, tno, least(a, b) AS tar1_pos, greatest(a, b) AS tar2_pos,
           CAST(CASE WHEN d IN (a, b) THEN d % 10 + 1 ELSE d END AS INT) AS dist_pos,
           CASE WHEN pid % 2 = 0 THEN 'freq_bottom' ELSE 'freq_top' END AS dist_freq,
           CASE WHEN (pid + tno * 3) % 5 < 3 THEN 'resp' ELSE 'inhibit' END AS raw_response,
           CASE WHEN (pid * 3 + tno * 7) % 11 = 0 THEN 0 ELSE 1 END AS response_corr
    FROM (SELECT DISTINCT pid, tno, (pid + tno) % 10 + 1 AS a, (pid + tno + 3 + tno % 4) % 10 + 1 AS b,
                 CASE WHEN (pid * 7 + tno * 3) % 4 = 0 THEN 0
                      ELSE (pid * 3 + (tno // 2) * 7) % 10 + 1 END AS d FROM ev)
    """
)
block("reg", "disp")(
    """
    SELECT *, CASE WHEN dist_pos = 0 THEN 'Absent'
                   WHEN (dist_freq = 'freq_bottom') = (dist_pos > 5) THEN 'Freq.' ELSE 'Rare' END AS dist_region,
           CASE raw_response WHEN 'resp' THEN 'Go' ELSE 'No-go' END AS response
    FROM disp
    """
)
block("fx", "ev", "reg")(
    """
    SELECT CAST(e.pid AS VARCHAR) AS participant, e.tno, e.event_id AS fix_count,
           CASE WHEN e.event_type = 'signup' THEN 'Post' ELSE 'Search' END AS cat,
           (e.us % 432000000000) / 143999999999 + 0.05::DOUBLE AS start_time,
           e.value / 1000 AS duration,
           CASE WHEN e.k < 99 THEN (2.503::DOUBLE + e.value - 6 * floor(e.value / 6)) * cos(e.k * pi() / 50) END AS gx,
           CASE WHEN e.k < 99 THEN (2.503::DOUBLE + e.value - 6 * floor(e.value / 6)) * sin(e.k * pi() / 50) END AS gy,
           r.tar1_pos, r.tar2_pos, r.dist_pos, r.dist_freq, r.dist_region, r.response, r.raw_response, r.response_corr,
           0.15::DOUBLE + e.k / 100::DOUBLE AS response_rt
    FROM ev e JOIN reg r ON e.pid = r.pid AND e.tno = r.tno
    """
)
block("sc", "fx")(
    """
    SELECT participant, tno, cat, start_time - 0.02::DOUBLE AS start_time, 0::DOUBLE AS search_start_time,
           dist_region, raw_response AS response, response_corr
    FROM fx
    """
)
block("items")(
    "SELECT pos, 6 * cos(radians(deg)) AS x, 6 * sin(radians(deg)) AS y FROM (VALUES "
    + ", ".join(f"({i}, {d})" for i, d in enumerate(DEGREES, 1))
    + ") v(pos, deg)"
)
block("gd", "fx", "items")(
    """
    SELECT f.*, sqrt((a.x - gx) ** 2 + (a.y - gy) ** 2) AS tar1_dist, sqrt((b.x - gx) ** 2 + (b.y - gy) ** 2) AS tar2_dist,
           sqrt((c.x - gx) ** 2 + (c.y - gy) ** 2) AS dist_dist, sqrt(gx ** 2 + gy ** 2) AS fix_dist
    FROM fx f LEFT JOIN items a ON f.tar1_pos = a.pos LEFT JOIN items b ON f.tar2_pos = b.pos
              LEFT JOIN items c ON f.dist_pos = c.pos
    """
)
block("cl", "gd")(
    """
    SELECT *, CASE WHEN fix_type = 'Target' THEN CASE WHEN tar1_dist < tar2_dist THEN 1 ELSE 2 END END AS tar_fixed
    FROM (SELECT *, CASE WHEN gx IS NULL THEN NULL
               WHEN tar1_dist < 3 AND tar1_dist <= coalesce(dist_dist, 1e9) THEN 'Target'
               WHEN tar2_dist < 3 AND tar2_dist <= coalesce(dist_dist, 1e9) THEN 'Target'
               WHEN fix_dist < 3 THEN 'Fixation' WHEN dist_dist < 3 THEN 'Distractor' ELSE 'Other' END AS fix_type
          FROM gd)
    """
)
# per-trial markers, each by its own aggregate joined back to the events
block("m1", "cl")(
    """
    SELECT participant, tno, min(fix_count) AS first_target FROM cl
    WHERE cat = 'Search' AND fix_type = 'Target' GROUP BY ALL
    """
)
block("m2", "cl", "m1")(
    """
    SELECT participant, tno, first_target, tar_fixed AS first_target_id, start_time AS first_target_time
    FROM cl JOIN m1 USING (participant, tno) WHERE fix_count = first_target
    """
)
block("m3", "cl", "m2")(
    """
    SELECT participant, tno, min(fix_count) AS both_targets FROM cl JOIN m2 USING (participant, tno)
    WHERE cat = 'Search' AND fix_type = 'Target' AND fix_count > first_target AND tar_fixed <> first_target_id
    GROUP BY ALL
    """
)
block("m4", "cl", "m3")(
    """
    SELECT participant, tno, both_targets, start_time AS both_targets_time
    FROM cl JOIN m3 USING (participant, tno) WHERE fix_count = both_targets
    """
)
block("m5", "cl")(
    """
    SELECT participant, tno, min(fix_count) AS first_distractor, min(start_time) AS first_distractor_time FROM cl
    WHERE cat = 'Search' AND fix_type = 'Distractor' GROUP BY ALL
    """
)
block("m6", "cl")(
    "SELECT participant, tno, min(fix_count) AS first_search FROM cl WHERE cat = 'Search' GROUP BY ALL"
)
block("mk", "cl", "m2", "m4", "m5")(
    """
    SELECT cl.*, first_target, first_target_id, first_target_time, both_targets, both_targets_time, first_distractor,
           first_distractor_time,
           CASE WHEN cat = 'Search' AND fix_type = 'Distractor' THEN
             CASE WHEN first_target IS NULL OR fix_count < first_target THEN 'Before'
                  WHEN both_targets IS NULL OR fix_count < both_targets THEN 'Between' ELSE 'After' END END AS dfix_type
    FROM cl LEFT JOIN m2 USING (participant, tno) LEFT JOIN m4 USING (participant, tno)
            LEFT JOIN m5 USING (participant, tno)
    """
)
# visit pattern from the ordered list of visited targets
block("pat", "cl")(
    """
    SELECT participant, tno, response,
           CASE WHEN seq IS NULL THEN 'No fix.'
                WHEN len(list_distinct(seq)) = 1 THEN 'Single tar. fix.'
                WHEN list_contains(seq[list_position(seq, 3 - seq[1]):], seq[1]) THEN 'Refixation'
                ELSE 'Both fix.' END AS fix_pattern
    FROM (SELECT participant, tno, response,
                 list(tar_fixed ORDER BY fix_count) FILTER (cat = 'Search' AND tar_fixed IS NOT NULL) AS seq
          FROM cl GROUP BY ALL)
    """
)
# the nearest of all items of the display, each event against each item
block("seen", "fx", "items")(
    """
    SELECT * FROM (
      SELECT participant, tno, fix_count, start_time, item, sqrt((x - gx) ** 2 + (y - gy) ** 2) AS d,
             row_number() OVER (PARTITION BY participant, tno, fix_count
                                ORDER BY sqrt((x - gx) ** 2 + (y - gy) ** 2), item DESC) AS nearest
      FROM (SELECT participant, tno, fix_count, start_time, gx, gy, unnest([1, 2, 3]) AS item,
                   unnest([tar1_pos, tar2_pos, dist_pos]) AS pos
            FROM fx WHERE cat = 'Search' AND gx IS NOT NULL) JOIN items USING (pos))
    WHERE nearest = 1 AND d < 3
    """
)
block("begun", "seen")("SELECT participant, tno, item, min(fix_count) AS begin FROM seen GROUP BY ALL")
# seen again: a visit after another item was first seen, which itself was first seen later
block("again", "seen", "begun")(
    """
    SELECT DISTINCT s.participant, s.tno FROM seen s
      JOIN begun a ON (a.participant, a.tno, a.item) = (s.participant, s.tno, s.item)
      JOIN begun b ON (b.participant, b.tno) = (s.participant, s.tno) AND b.item <> s.item
    WHERE b.begin > a.begin AND s.fix_count > b.begin
    """
)
block("vis", "fx", "begun", "again")(
    """
    SELECT t.*, CAST(coalesce(n, 0) AS INT) AS n_seen, coalesce(seen_order, '') AS seen_order, first_item_at,
           CASE WHEN n = n_items THEN last_at END AS all_seen_at,
           CASE WHEN n IS NULL THEN 'No fix.' WHEN n = 1 THEN 'Single fix.' WHEN a.tno IS NOT NULL THEN 'Refixation'
                WHEN n = n_items THEN 'All fix.' ELSE 'Some fix.' END AS visit_pattern
    FROM (SELECT DISTINCT participant, tno, dist_region, response, response_corr,
                 CASE WHEN dist_pos = 0 THEN 2 ELSE 3 END AS n_items FROM fx) t
    LEFT JOIN (SELECT participant, tno, count(*) AS n, min(begin) AS first_item_at, max(begin) AS last_at,
                      string_agg(['target 1', 'target 2', 'distractor'][item], ' > ' ORDER BY begin) AS seen_order
               FROM begun GROUP BY ALL) b USING (participant, tno)
    LEFT JOIN again a USING (participant, tno)
    """
)
block("vist", "vis", "fx")(
    """
    SELECT v.*, f.start_time AS first_item_time, l.start_time AS all_seen_time FROM vis v
    LEFT JOIN fx f ON (f.participant, f.tno, f.fix_count) = (v.participant, v.tno, v.first_item_at)
    LEFT JOIN fx l ON (l.participant, l.tno, l.fix_count) = (v.participant, v.tno, v.all_seen_at)
    """
)
# ---- trial log ----
block("firstk", "ev")("SELECT pid, tno, arg_min(k, event_id) AS k0 FROM ev GROUP BY ALL")
block("log", "reg", "firstk")(
    """
    SELECT CAST(pid AS VARCHAR) AS participant, tno, CASE WHEN tno = 0 THEN 'Practice' ELSE 'Experiment' END AS blocktype,
           tar1_pos, tar2_pos, dist_pos, dist_freq, dist_region,
           CASE WHEN dist_pos > 0 THEN 'Present' ELSE 'Absent' END AS distractor, response_corr,
           CASE WHEN (pid + tno * 5) % 97 = 0 THEN 'none' ELSE raw_response END AS logged,
           CASE WHEN raw_response = 'resp' THEN 0.15::DOUBLE + k0 / 100::DOUBLE END AS response_rt
    FROM reg JOIN firstk USING (pid, tno)
    """
)
block("tr", "log")(
    """
    SELECT *, CASE logged WHEN 'resp' THEN 'Go' WHEN 'inhibit' THEN 'No-go' END AS response
    FROM log WHERE blocktype = 'Experiment'
    """
)
REPEAT = """
    SELECT *, CASE WHEN dist_pos = 0 THEN 'Absent' WHEN prev IS NULL THEN NULL
                   WHEN dist_pos = prev THEN 'Repeat' ELSE 'Change' END AS dist_rep
    FROM (SELECT *, lag(dist_pos) OVER (PARTITION BY {by} ORDER BY tno) AS prev FROM tr)
"""
block("rep", "tr")(REPEAT.format(by="participant"))
VALID = "response_corr = 1 AND response = 'Go' AND response_rt > 0.2"


# ---- statement assembly ----


def statement(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in BLOCKS[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({BLOCKS[n][1].strip()})" for n in order)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()


def rnd(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0 AS {name}"


def t_sql(df: str) -> str:
    listed, fit = t_tables()
    table = ", ".join(f"{t!r}::DOUBLE" for t in listed)
    tail = " + ".join(f"{c!r}::DOUBLE / ({df})::DOUBLE ** {k}" for k, c in enumerate(fit))
    return f"CASE WHEN {df} > {LISTED} THEN {tail} WHEN {df} >= 1 THEN ([{table}])[{df}] END"


def within(cells: str, by: str, measures: dict[str, str], subject: str = "participant") -> str:
    """Definition of the within-subject error on raw rows."""
    centred = ", ".join(f"{v} - avg({v}) OVER (PARTITION BY {subject}) AS d_{k}" for k, v in measures.items())
    out = []
    for k, v in measures.items():
        se = f"CASE WHEN count(*) > 1 THEN stddev_samp(d_{k}) / sqrt(count(*) - 1) END"
        out += [
            rnd(f"avg({v})", f"m_{k}"),
            rnd(se, f"se_{k}"),
            rnd(f"({se}) * ({t_sql('(count(*) - 1)')})", f"ci_{k}"),
        ]
    return (
        f"SELECT {by}, count(*) AS n, {', '.join(out)} FROM (SELECT *, {centred} FROM ({cells})) GROUP BY {by}"
    )


Q: dict[str, str] = {}

ORI = ("ori10", "ori11", "ori12", "ori13", "ori14", "ori16", "ori17", "ori18", "ori19", "ori20")
ORIENTATIONS = ", ".join(
    f"CASE {i} WHEN tar1_pos THEN 12 WHEN tar2_pos THEN -168"
    f" WHEN dist_pos THEN CASE WHEN tno % 2 = 0 THEN 90 ELSE 270 END ELSE 0 END::DOUBLE AS {c}"
    for i, c in enumerate(ORI, 1)
)

# ---- sources and shape ----
Q["load_trials"] = statement(
    f"""SELECT participant, CASE WHEN tno <> 0 THEN tno END AS trials_thisN,
        CASE WHEN tno = 0 THEN tno END AS practice_trials_thisRepN, {ORIENTATIONS}, dist_freq, logged AS response,
        response_corr, {rnd('response_rt', 'response_rt')} FROM log""",
    "log",
)
Q["load_fixations"] = statement(
    f"""SELECT participant, tno, fix_count, cat, {rnd('start_time', 'start_time')}, {rnd('duration', 'duration')},
        {rnd('gx', 'average_gaze_x')}, {rnd('gy', 'average_gaze_y')}, CAST(tar1_pos AS INT) AS tar1_pos,
        CAST(tar2_pos AS INT) AS tar2_pos, dist_pos, dist_freq, dist_region, raw_response AS response, response_corr,
        {rnd('response_rt', 'response_rt')} FROM fx""",
    "fx",
)
Q["load_saccades"] = statement(
    f"""SELECT participant, tno, cat, {rnd('start_time', 'start_time')}, search_start_time, dist_region, response,
        response_corr FROM sc""",
    "sc",
)
Q["duplicate_keys"] = """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
"""
Q["schema_fill"] = f"""
    SELECT event_id, event_type, {rnd('value', 'value')},
           CASE WHEN event_type IN ('view', 'click', 'signup') THEN user_id END AS user_id,
           CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN props END AS props FROM events
"""
Q["schema_diff"] = """
    WITH p AS (SELECT DISTINCT user_id, event_type || '_' || CAST(floor(value / 100) AS INT) AS field FROM events),
         everyone AS (SELECT DISTINCT user_id FROM p), fields AS (SELECT DISTINCT field FROM p),
         lacking AS (SELECT field, user_id FROM fields CROSS JOIN everyone EXCEPT SELECT field, user_id FROM p)
    SELECT field, count(*) AS n_sources FROM p WHERE field IN (SELECT field FROM lacking) GROUP BY field
"""
Q["pivot_roundtrip"] = statement(
    f"SELECT participant, tno, {ORIENTATIONS} FROM tr",
    "tr",
)

# ---- trial log ----
Q["trial_blocks"] = statement("SELECT participant, blocktype, tno, response_corr FROM log", "log")
Q["recode_levels"] = statement(
    """SELECT response, CASE response WHEN 'Go' THEN 1 WHEN 'No-go' THEN 2 END AS response_rank, count(*) AS n
       FROM tr GROUP BY ALL""",
    "tr",
)
Q["item_positions"] = statement("SELECT participant, tno, tar1_pos, tar2_pos, dist_pos FROM tr", "tr")
Q["distractor_region"] = statement("SELECT participant, tno, dist_pos, dist_region, distractor FROM tr", "tr")
TARGET_REGION = (
    "CASE WHEN (dist_freq = 'freq_bottom') = ({0} > 5) THEN 'Frequent' ELSE 'Rare' END"
)
PAIR = (
    "CASE WHEN r1 <> r2 THEN 'Freq./Rare dist.' WHEN r1 = 'Frequent' THEN 'Freq. dist.' ELSE 'Rare dist.' END"
)
Q["target_regions"] = statement(
    f"""SELECT participant, tno, r1 AS tar1_region, r2 AS tar2_region, {PAIR} AS tar_regions,
        CASE first_target_id WHEN 1 THEN r1 WHEN 2 THEN r2 END AS first_region_fixed
        FROM (SELECT *, {TARGET_REGION.format('tar1_pos')} AS r1, {TARGET_REGION.format('tar2_pos')} AS r2 FROM tr)
        LEFT JOIN m2 USING (participant, tno)""",
    "tr",
    "m2",
)
Q["dist_repeat"] = statement("SELECT participant, tno, dist_pos, dist_rep FROM rep", "rep")
RT_CELLS = f"""SELECT dist_region, distractor, participant, avg(response_rt) * 1000 AS rt FROM tr WHERE {VALID} GROUP BY ALL"""
ACC_CELLS = """SELECT dist_region, distractor, response, participant, avg(response_corr) AS acc FROM tr GROUP BY ALL"""
Q["rt_by_region"] = statement(f"SELECT dist_region, distractor, participant, {rnd('rt', 'rt')} FROM ({RT_CELLS})", "tr")
Q["accuracy_by_region"] = statement(
    f"""SELECT dist_region, distractor, response, participant, {rnd('acc', 'acc')}, {rnd('1 - acc', 'err')}
        FROM ({ACC_CELLS})""",
    "tr",
)
Q["within_rt"] = statement(within(RT_CELLS, "dist_region, distractor", {"rt": "rt"}), "tr")
Q["within_acc"] = statement(within(ACC_CELLS, "dist_region, distractor", {"acc": "acc"}), "tr")
Q["within_acc_go"] = statement(
    f"""SELECT * FROM ({within(ACC_CELLS, 'dist_region, distractor, response', {'pc': 'acc'})})
        WHERE response = 'Go'""",
    "tr",
)
NOREP = f"""SELECT dist_region, CASE WHEN dist_region = 'Absent' THEN 'Absent' ELSE 'Present' END AS dist_present,
    participant, avg(response_rt) * 1000 AS rt FROM {{rep}}
    WHERE dist_rep IN ('Absent', 'Change') AND {VALID} GROUP BY ALL"""
Q["norep_rt"] = statement(within(NOREP.format(rep="rep"), "dist_region, dist_present", {"rt": "rt"}), "rep")


def _both() -> str:
    """Two copies of the trial-log pipeline, one per half of the users."""
    parts = []
    ctes = []
    for tag, odd in (("exp1", 0), ("exp2", 1)):
        names = {n: f"{n}_{tag}" for n in ("ev", "disp", "reg", "firstk", "log", "tr")}
        for n in names:
            body = BLOCKS[n][1].strip()
            for old, new in names.items():
                for kw in ("FROM", "JOIN"):
                    for end in (" ", ")", "\n"):
                        body = body.replace(f"{kw} {old}{end}", f"{kw} {new}{end}")
                if body.endswith(f"FROM {old}"):
                    body = body[: -len(old)] + new
            if n == "ev":
                body = body.replace("FROM events)", f"FROM events WHERE (user_id // 15) % 2 = {odd})")
            ctes.append(f"{names[n]} AS ({body})")
        ctes.append(f"rep_{tag} AS ({REPEAT.format(by='participant').strip().replace('FROM tr)', f'FROM tr_{tag})')})")
        one = within(NOREP.format(rep=f"rep_{tag}"), "dist_region, dist_present", {"rt": "rt"})
        parts.append(f"SELECT *, '{tag}' AS experiment FROM ({one})")
    return f"WITH {', '.join(ctes)}\n{' UNION ALL '.join(parts)}"


Q["norep_rt_both"] = _both()

# ---- fixations ----
Q["gaze_distance"] = statement(
    "SELECT participant, tno, fix_count, "
    + ", ".join(rnd(c, c) for c in ("tar1_dist", "tar2_dist", "dist_dist", "fix_dist"))
    + " FROM gd",
    "gd",
)
Q["fix_class"] = statement("SELECT participant, tno, fix_count, fix_type, tar_fixed FROM cl", "cl")
Q["aoi_outline"] = statement(
    f"""SELECT participant, tno, item, CAST(i AS INT) AS point,
        {rnd('x + 3 * cos(i * 2 * pi() / 99)', 'outline_x')}, {rnd('y + 3 * sin(i * 2 * pi() / 99)', 'outline_y')}
        FROM (SELECT participant, tno, 'tar1_pos' AS item, tar1_pos AS pos FROM tr
              UNION ALL SELECT participant, tno, 'tar2_pos', tar2_pos FROM tr
              UNION ALL SELECT participant, tno, 'dist_pos', dist_pos FROM tr) a
        JOIN items USING (pos), range(100) r(i)""",
    "tr",
    "items",
)
Q["fix_pattern"] = statement(
    """SELECT participant, tno, fix_pattern, CASE fix_pattern WHEN 'No fix.' THEN 1 WHEN 'Single tar. fix.' THEN 2
       WHEN 'Both fix.' THEN 3 ELSE 4 END AS pattern_rank FROM pat""",
    "pat",
)
SHARE = "count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY {panel}), 6) AS share"
Q["fix_pattern_share"] = statement(
    f"""SELECT response, fix_pattern, {SHARE.format(panel='response')} FROM pat
        WHERE response IS NOT NULL GROUP BY response, fix_pattern""",
    "pat",
)
Q["display_visits"] = statement(
    f"""SELECT participant, tno, n_items, n_seen, visit_pattern, seen_order,
        nullif(split_part(seen_order, ' > ', 1), '') AS first_item, first_item_at,
        {rnd('first_item_time', 'first_item_time')}, all_seen_at, {rnd('all_seen_time', 'all_seen_time')} FROM vist""",
    "vist",
)
Q["display_visit_share"] = statement(
    f"""SELECT dist_region, response, visit_pattern, {SHARE.format(panel='dist_region, response')} FROM vis
        WHERE response_corr = 1 AND response IS NOT NULL GROUP BY dist_region, response, visit_pattern""",
    "vis",
)
Q["display_scan_time"] = statement(
    within(
        """SELECT dist_region, response, participant, avg((all_seen_time - first_item_time) * 1000) AS scan FROM vist
           WHERE response_corr = 1 AND n_seen > 1 AND all_seen_at IS NOT NULL GROUP BY dist_region, response, participant""",
        "dist_region, response",
        {"scan": "scan"},
    ),
    "vist",
)
Q["enrich_full"] = statement(
    f"""SELECT participant, tno, fix_count, cat, {rnd('duration', 'duration')}, dist_rep
        FROM fx FULL JOIN (SELECT participant, tno, dist_rep FROM rep) r USING (participant, tno)""",
    "fx",
    "rep",
)
Q["trial_markers"] = statement(
    f"""SELECT participant, tno, n_events, n_search, first_search, first_target, first_target_id,
        {rnd('first_target_time', 'first_target_time')}, both_targets, {rnd('both_targets_time', 'both_targets_time')},
        first_distractor, {rnd('first_distractor_time', 'first_distractor_time')}
        FROM (SELECT participant, tno, count(*) AS n_events, count(*) FILTER (cat = 'Search') AS n_search
              FROM cl GROUP BY ALL)
        LEFT JOIN m6 USING (participant, tno) LEFT JOIN m2 USING (participant, tno)
        LEFT JOIN m4 USING (participant, tno) LEFT JOIN m5 USING (participant, tno)""",
    "cl", "m2", "m4", "m5", "m6",
)
Q["dist_phase"] = statement(
    "SELECT participant, tno, fix_count, dfix_type FROM mk", "mk"
)
Q["first_fix_share"] = statement(
    f"""SELECT dist_region, response, fix_type, {SHARE.format(panel='dist_region, response')}
        FROM (SELECT DISTINCT dist_region, response, participant, tno, fix_type
              FROM (SELECT * FROM cl WHERE cat = 'Search' AND fix_type <> 'Fixation' AND response_corr = 1
                    QUALIFY fix_count = min(fix_count) OVER (PARTITION BY participant, tno)))
        WHERE dist_region <> 'Absent' GROUP BY dist_region, response, fix_type""",
    "cl",
)
REGION_CELLS = f"""
    SELECT tar_regions, response, participant, avg(rt) AS rt FROM (
      SELECT tar_regions, response, participant, tno, avg(response_rt) * 1000 AS rt
      FROM (SELECT *, {PAIR} AS tar_regions FROM (
              SELECT *, {TARGET_REGION.format('tar1_pos')} AS r1, {TARGET_REGION.format('tar2_pos')} AS r2 FROM fx))
      WHERE response_corr = 1 AND response = 'Go' AND dist_region = 'Absent' GROUP BY ALL) GROUP BY ALL
"""
Q["target_region_rt"] = statement(within(REGION_CELLS, "tar_regions, response", {"rt": "rt"}), "fx")
Q["between_se"] = statement(
    f"""SELECT tar_regions, response, count(*) AS n, {rnd('avg(rt)', 'm_rt')},
        {rnd('CASE WHEN count(*) > 1 THEN stddev_samp(rt) / sqrt(count(*) - 1) END', 'se_rt')}
        FROM ({REGION_CELLS}) GROUP BY tar_regions, response""",
    "fx",
)


def phase_flags(source: str, where: str) -> str:
    flags = ", ".join(
        f"coalesce(sum(CASE WHEN dfix_type = '{p}' THEN 1 ELSE 0 END), 0) > 0 AS {p.lower()}"
        for p in ("Before", "Between", "After")
    )
    return f"""SELECT dist_region, response, participant, tno, {flags} FROM {source}
        WHERE cat = 'Search' AND response_corr = 1 AND {where} GROUP BY dist_region, response, participant, tno"""


def phase_cells(source: str, where: str) -> str:
    means = ", ".join(f"avg(CAST({p} AS INT)) AS {p}" for p in ("before", "between", "after"))
    return f"""SELECT dist_region, response, participant, {means.replace('AS between', 'AS "between"').replace('CAST(between', 'CAST("between"')}
        FROM ({phase_flags(source, where).replace('AS between', 'AS "between"')}) GROUP BY ALL"""


PHASES = {"before": "before", "between": '"between"', "after": "after"}
BOTH = "both_targets IS NOT NULL"
PROP = within(phase_cells("mk", f"{BOTH} AND dist_region <> 'Absent'"), "dist_region, response", PHASES)
Q["phase_prop"] = statement(PROP, "mk")
Q["phase_prop_long"] = statement(
    " UNION ALL ".join(
        f"SELECT dist_region, response, '{p}' AS fix_type, m_{p} AS m, ci_{p} AS ci FROM ({PROP})" for p in PHASES
    ),
    "mk",
)
CHANGED = "(SELECT mk.*, dist_rep FROM mk LEFT JOIN (SELECT participant, tno, dist_rep FROM rep) r USING (participant, tno))"
for key, both in (("phase_prop_norep", f"{BOTH} AND "), ("phase_prop_norep_any", "")):
    cells = phase_cells(CHANGED, f"{both}dist_rep = 'Change'")
    Q[key] = statement(within(cells, "dist_region, response", PHASES), "mk", "rep")

DUR_LONG = f"""
    SELECT dist_region, dfix_type, response, participant, avg(dur) AS dur FROM (
      SELECT dist_region, dfix_type, response, participant, tno, sum(duration) * 1000 AS dur
      FROM (SELECT * FROM mk WHERE cat = 'Search' AND fix_type = 'Distractor' AND response_corr = 1 AND {BOTH}
            QUALIFY fix_count = min(fix_count) OVER (PARTITION BY participant, tno, dfix_type))
      GROUP BY ALL) WHERE dfix_type <> 'Between' GROUP BY ALL
"""
DUR_WIDE = f"""
    SELECT dist_region, response, participant, max(dur) FILTER (dfix_type = 'Before') AS "Before",
           max(dur) FILTER (dfix_type = 'After') AS "After" FROM ({DUR_LONG}) GROUP BY ALL
"""
Q["dist_dur_cells"] = statement(
    f"""SELECT dist_region, response, participant, {rnd('"Before"', '"Before"')}, {rnd('"After"', '"After"')}
        FROM ({DUR_WIDE})""",
    "mk",
)
Q["dist_dur_first"] = statement(
    within(
        f"""SELECT dist_region, response, participant, dfix_type AS type, dur FROM ({DUR_LONG})
            WHERE participant NOT IN (
              SELECT participant FROM ({DUR_WIDE}) WHERE "After" IS NULL
              UNION SELECT participant FROM ({DUR_WIDE}) WHERE "Before" IS NULL)""",
        "dist_region, response, type",
        {"dur": "dur"},
    ),
    "mk",
)
Q["target_dur"] = statement(
    within(
        " UNION ALL ".join(
            f"""SELECT response, dist_region, participant, '{tag}' AS tar_fixed, avg(duration) * 1000 AS dur FROM mk
                WHERE fix_type = 'Target' AND fix_count = {marker} AND response_corr = 1
                GROUP BY response, dist_region, participant"""
            for tag, marker in (("First", "first_target"), ("Second", "both_targets"))
        ),
        "response, dist_region, tar_fixed",
        {"dur": "dur"},
    ),
    "mk",
)
REFIX = f"""
    SELECT CASE WHEN before THEN 'Fix.' ELSE 'No fix.' END AS before_fix, dist_region, response, participant,
           avg(CAST(after AS INT)) AS after
    FROM ({phase_flags('mk', f"{BOTH} AND dist_region <> 'Absent'").replace('AS between', 'AS "between"')})
    WHERE NOT "between" GROUP BY before, dist_region, response, participant
"""
Q["refix_cells"] = statement(
    f"SELECT before_fix, dist_region, response, participant, {rnd('after', 'after')} FROM ({REFIX})", "mk"
)
RARE = f"SELECT participant FROM ({REFIX}) WHERE before_fix = 'Fix.' AND dist_region = 'Rare' AND response = "
Q["refix_after"] = statement(
    within(
        f"SELECT * FROM ({REFIX}) WHERE participant IN ({RARE}'No-go' INTERSECT {RARE}'Go')",
        "before_fix, dist_region, response",
        {"after": "after"},
    ),
    "mk",
)
Q["refix_after_complete"] = statement(
    within(
        f"""SELECT * FROM ({REFIX}) WHERE participant IN (
            SELECT participant FROM ({REFIX}) GROUP BY participant HAVING count(*) = 8)""",
        "before_fix, dist_region, response",
        {"after": "after"},
    ),
    "mk",
)

# ---- saccades ----
LEADING = """
    SELECT s.*, marker, marker_time, (start_time - search_start_time) * 1000 AS latency
    FROM (SELECT sc.*, {index} AS marker, {time} AS marker_time
          FROM sc JOIN {markers} USING (participant, tno) WHERE start_time < {time}
          QUALIFY rank() OVER (PARTITION BY participant, tno ORDER BY start_time DESC) = 1) s
    WHERE cat = 'Search'
"""
LEAD = {
    "Target": LEADING.format(index="first_target", time="first_target_time", markers="m2"),
    "Distractor": LEADING.format(index="first_distractor", time="first_distractor_time", markers="m5"),
}
for kind, lead in LEAD.items():
    Q[f"asof_{kind.lower()}"] = statement(
        f"""SELECT participant, tno, {rnd('start_time', 'start_time')}, marker, {rnd('marker_time', 'marker_time')},
            {rnd('latency', 'latency')} FROM ({lead})""",
        "sc", "m2", "m5",
    )
Q["sacc_first_search"] = statement(
    " UNION ALL ".join(
        f"""SELECT participant, tno, '{kind}' AS kind, marker, first_search, {rnd('latency', 'latency')}
            FROM ({lead}) x NATURAL FULL JOIN m6"""
        for kind, lead in LEAD.items()
    ),
    "sc", "m2", "m5", "m6",
)
Q["enrich_saccades"] = statement(
    f"""SELECT participant, tno, cat, {rnd('start_time', 'start_time')}, dist_rep
        FROM sc FULL JOIN (SELECT participant, tno, dist_rep FROM rep) r USING (participant, tno)""",
    "sc",
    "rep",
)
Q["sacc_latency_all"] = statement(
    " UNION ALL ".join(
        f"""SELECT dist_region, response, participant, {rnd('avg(latency)', 'latency')}, '{kind}' AS type
            FROM (SELECT dist_region, response, participant, tno, avg(latency) AS latency FROM ({lead})
                  WHERE response_corr = 1 GROUP BY ALL) GROUP BY dist_region, response, participant"""
        for kind, lead in LEAD.items()
    ),
    "sc", "m2", "m5",
)
FIRST = {
    kind: f"""SELECT dist_region, participant, avg(latency) AS latency, '{kind}' AS type FROM (
        SELECT dist_region, participant, tno, avg(latency) AS latency
        FROM ({lead}) x FULL JOIN m6 USING (participant, tno)
        WHERE response_corr = 1 AND latency > 50 AND latency < 500 AND marker = first_search
        GROUP BY dist_region, participant, tno) GROUP BY dist_region, participant"""
    for kind, lead in LEAD.items()
}
GOOD = " INTERSECT ".join(
    f"SELECT participant FROM ({FIRST['Target']}) WHERE dist_region = '{r}'" for r in ("Absent", "Freq.", "Rare")
)
Q["sacc_latency_first"] = statement(
    within(
        f"""SELECT * FROM (({FIRST['Target']}) UNION ALL ({FIRST['Distractor']})) WHERE participant IN ({GOOD})""",
        "dist_region, type",
        {"lat": "latency"},
    ),
    "sc", "m2", "m5", "m6",
)

# ---- the general operators on other tables ----
HAS = "SELECT o_custkey FROM orders WHERE o_orderstatus = "
CUSTOMER = f"SELECT c_custkey AS subject, c_mktsegment, {rnd('c_acctbal', 'c_acctbal')} FROM customer WHERE c_custkey"
Q["complete_subjects"] = f"{CUSTOMER} IN ({HAS}'F' INTERSECT {HAS}'O' INTERSECT {HAS}'P')"
Q["gapless_subjects"] = f"""{CUSTOMER} NOT IN (
    SELECT o_custkey FROM orders WHERE o_custkey NOT IN ({HAS}'F')
    UNION SELECT o_custkey FROM orders WHERE o_custkey NOT IN ({HAS}'O'))"""
Q["within_orders"] = within("SELECT * FROM orders", "o_orderpriority", {"price": "o_totalprice"}, "o_custkey")
Q["within_lineitem"] = within(
    "SELECT * FROM lineitem", "l_returnflag", {"price": "l_extendedprice", "quantity": "l_quantity"}, "l_suppkey"
)
Q["two_level_lineitem"] = f"""
    SELECT l_returnflag, {rnd('avg(p)', 'price')} FROM (
      SELECT l_returnflag, l_orderkey, avg(l_extendedprice) AS p FROM lineitem GROUP BY ALL) GROUP BY l_returnflag
"""
Q["share_lineitem"] = f"""
    SELECT l_returnflag, l_linestatus, {SHARE.format(panel='l_returnflag')} FROM lineitem
    GROUP BY l_returnflag, l_linestatus
"""

# ---- files ----
Q["csv_trial_log"] = f"""
    SELECT *, CASE CAST(participant AS INT) % 3 WHEN 1 THEN 's' || participant WHEN 2 THEN '0' END AS int14_2_started,
        CASE CAST(participant AS INT) % 3 WHEN 2 THEN CAST(response_corr + 1 AS VARCHAR) END AS per15_2_started,
        CAST(NULL AS VARCHAR) AS response_pract_rt
    FROM ({Q['load_trials']})"""
Q["csv_schema_diff"] = """
    SELECT field FROM (SELECT DISTINCT CAST(user_id % 15 % 3 AS INT) AS third FROM events) t
    JOIN (VALUES ('int14_2.started', 1), ('int14_2.started', 2), ('per15_2.started', 2)) v(field, third) USING (third)
    GROUP BY field HAVING count(*) < (SELECT count(DISTINCT user_id % 15 % 3) FROM events)"""
Q["summary_roundtrip"] = Q["norep_rt"]

# ---- the same results on stored tables ----
Q["stored_phase_prop"], Q["stored_enriched"] = Q["phase_prop"], Q["enrich_full"]
Q["stored_markers"] = f"""
    SELECT participant, tno, n_events, first_target, both_targets, first_distractor_time, fix_pattern
    FROM ({Q['trial_markers']}) JOIN ({Q['fix_pattern']}) USING (participant, tno)"""
Q["checked_markers"] = Q["stored_markers"]
Q["stored_latency"] = f"""
    SELECT participant, tno, 'Target' AS type, start_time, marker, marker_time, latency FROM ({Q['asof_target']})
    UNION ALL SELECT participant, tno, 'Distractor', start_time, marker, marker_time, latency FROM ({Q['asof_distractor']})"""

# ---- further operators on other tables ----
Q["previous_event"] = f"""
    SELECT event_id, user_id, {rnd('lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)', 'previous')} FROM events"""
Q["first_line_sum"] = f"""
    SELECT l_orderkey, {rnd('sum(l_extendedprice)', 'price')}
    FROM (SELECT * FROM lineitem QUALIFY l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey)) GROUP BY l_orderkey"""
Q["within_merged"] = Q["within_orders"]
_GAUSS = ", ".join(f"{{'x': {x!r}::DOUBLE, 'w': {w!r}::DOUBLE}}" for x, w in zip(NODES[0].tolist(), NODES[1].tolist()))
# bisection of the angle whose cosine power integral is the level
Q["welch_quantiles"] = f"""
    WITH RECURSIVE c AS (
      SELECT l_suppkey, df FROM (
        SELECT l_suppkey, (qr + qn) ** 2 / nullif(qr * qr / (nr - 1) + qn * qn / (nn - 1), 0) AS df FROM (
          SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS nr, count(*) FILTER (l_returnflag = 'N') AS nn,
            var_samp(l_extendedprice) FILTER (l_returnflag = 'R') / nr AS qr, var_samp(l_extendedprice) FILTER (l_returnflag = 'N') / nn AS qn
          FROM lineitem GROUP BY l_suppkey) WHERE nr > 1 AND nn > 1)),
    s AS (
      SELECT l_suppkey, df, level, 0::DOUBLE AS low, pi() / 2 AS high, 0 AS i,
        exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) AS scale FROM c, (VALUES (0.9::DOUBLE), (0.999::DOUBLE)) v(level)
      UNION ALL
      SELECT l_suppkey, df, level, if(area < level, mid, low), if(area < level, high, mid), i + 1, scale FROM (
        SELECT *, (low + high) / 2 AS mid,
          scale * mid * list_sum(list_transform([{_GAUSS}], lambda g: g.w * cos(mid / 2 * (g.x + 1)) ** (df - 1))) AS area
        FROM s WHERE i < 56)),
    t AS (SELECT l_suppkey, level, sqrt(df) * tan((low + high) / 2) AS t FROM s WHERE i = 56)
    SELECT l_suppkey, {rnd('df', 'df')}, {rnd('a.t', 't_90')}, {rnd('b.t', 't_999')} FROM c
    LEFT JOIN (SELECT * FROM t WHERE level < 0.95) a USING (l_suppkey) LEFT JOIN (SELECT * FROM t WHERE level > 0.95) b USING (l_suppkey)"""

ORACLE_SQL = Q
