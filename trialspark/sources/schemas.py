"""Declared schemas. Ids are strings: they look numeric in some studies only."""

from __future__ import annotations

from pyspark.sql import types as T

from ..operators.positions import ORIENTATION_COLUMNS

TRIAL_LOG = T.StructType(
    [
        T.StructField("participant", T.StringType()),
        T.StructField("trials_thisN", T.IntegerType()),
        T.StructField("practice_trials_thisRepN", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ORIENTATION_COLUMNS],
        T.StructField("dist_freq", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("response_corr", T.IntegerType()),
        T.StructField("response_rt", T.DoubleType()),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("dist_region", T.StringType()),
        T.StructField("dist_present", T.StringType()),
        T.StructField("m_rt", T.DoubleType()),
        T.StructField("se_rt", T.DoubleType()),
        T.StructField("ci_rt", T.DoubleType()),
    ]
)

# Log columns that only some files have, per experiment, and the
# two names under which the response is logged.
DRIFT_EXP1 = (
    "int14_2.started", "int14_2.stopped", "per15_2.started", "per15_2.stopped",
    "response_pract.keys", "response_pract.corr", "response_pract.rt",
)
DRIFT_EXP2 = (
    "fix_check_3.started", "fix_check_3.stopped", "text_feedback.started",
    "text_feedback.stopped", "text_feedback_2.stopped",
)
RESPONSE_NAMES = ("respon", "responses")
