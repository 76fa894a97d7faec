import csv
import gzip
import random

import pytest

from trialspark.operators import drift
from trialspark.operators.positions import ORIENTATION_COLUMNS
from trialspark.sources import schemas, summaries, trial_logs

BASE = ["participant", "trials.thisN", "practice_trials.thisRepN", *ORIENTATION_COLUMNS, "dist_freq", "respon", "response.corr", "response.rt"]


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


def log_row(participant, tno, header, **extra):
    values = {"participant": participant, "trials.thisN": tno, "practice_trials.thisRepN": "", "dist_freq": "freq_top", "respon": "resp", "response.corr": 1, "response.rt": 0.5}
    values |= {c: 0 for c in ORIENTATION_COLUMNS} | extra
    return [values.get(h, "x") for h in header]


def test_logs_are_bound_by_name_and_filled(spark, tmp_path, rows):
    with_extra = [*BASE, "int14_2.started", "int14_2.stopped"]
    mixed = [with_extra[-1], *reversed(BASE), with_extra[-2]]
    paths = [
        write(tmp_path / "001.csv", BASE, [log_row("001", 1, BASE), log_row("001", "NA", BASE, **{"practice_trials.thisRepN": 0})]),
        write(tmp_path / "2.csv", with_extra, [log_row("AI", 2, with_extra)]),
        write(tmp_path / "3.csv", mixed, [log_row("3", 3, mixed, **{"response.rt": "NA"})]),
    ]
    log = trial_logs.read_trial_logs(spark, paths, schemas.DRIFT_EXP1)
    assert log.select(*schemas.TRIAL_LOG.fieldNames()).schema == schemas.TRIAL_LOG
    got = rows(log, "participant", "trials_thisN", "practice_trials_thisRepN", "response", "response_rt", "int14_2_started", "per15_2_started")
    assert got == [
        ("001", 1, None, "resp", 0.5, None, None),
        ("001", None, 0, "resp", 0.5, None, None),
        ("3", 3, None, "resp", None, "x", None),
        ("AI", 2, None, "resp", 0.5, "x", None),
    ]


def test_second_response_name(spark, tmp_path):
    header = ["responses" if c == "respon" else c for c in BASE]
    path = write(tmp_path / "a.csv", header, [log_row("a", 1, header, responses="inhibit")])
    assert trial_logs.read_trial_logs(spark, [path], schemas.DRIFT_EXP2).first()["response"] == "inhibit"


def test_other_drift_raises(spark, tmp_path):
    more = [*BASE, "surprise"]
    paths = [write(tmp_path / "a.csv", BASE, [log_row("a", 1, BASE)]), write(tmp_path / "b.csv", more, [log_row("b", 1, more)])]
    with pytest.raises(drift.SchemaDriftError, match="surprise"):
        trial_logs.read_trial_logs(spark, paths, schemas.DRIFT_EXP1)
    lacking = [c for c in BASE if c != "dist_freq"]
    path = write(tmp_path / "c.csv", lacking, [log_row("c", 1, lacking)])
    with pytest.raises(ValueError, match="dist_freq"):
        trial_logs.read_trial_logs(spark, [path], schemas.DRIFT_EXP1)


def test_every_listed_file_has_a_header(spark, tmp_path):
    renamed = ["subject" if c == "participant" else c for c in BASE]
    good = write(tmp_path / "a.csv", BASE, [log_row("a", 1, BASE), log_row("a", 2, BASE)])
    bad = write(tmp_path / "b.csv", renamed, [log_row("b", 1, renamed)])
    with pytest.raises(ValueError, match="participant|subject"):
        trial_logs.read_trial_logs(spark, [good, bad], schemas.DRIFT_EXP1)
    headless = write(tmp_path / "c.csv", log_row("c", 1, BASE), [log_row("c", 2, BASE)])
    with pytest.raises(Exception):  # noqa: B017  its cells are not the columns of the other files
        trial_logs.read_trial_logs(spark, [good, headless], schemas.DRIFT_EXP1)
    (tmp_path / "d.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        trial_logs.read_trial_logs(spark, [good, str(tmp_path / "d.csv")], schemas.DRIFT_EXP1)


def test_cells_like_headers_and_byte_order_marks(spark, tmp_path):
    path = tmp_path / "a.csv"
    write(path, BASE, [log_row("participant", 1, BASE), log_row("b", 2, BASE)])
    path.write_bytes(b"\xef\xbb\xbf" + path.read_bytes())
    other = write(tmp_path / "b.csv", BASE, [log_row("participant", 3, BASE)])
    got = trial_logs.read_trial_logs(spark, [str(path), other], schemas.DRIFT_EXP1).collect()
    assert sorted((r["participant"], r["trials_thisN"]) for r in got) == [("b", 2), ("participant", 1), ("participant", 3)]


def test_a_header_in_the_middle_raises(spark, tmp_path):
    path = write(tmp_path / "a.csv", BASE, [log_row("a", 1, BASE), BASE])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        trial_logs.read_trial_logs(spark, [path], schemas.DRIFT_EXP1).collect()


def test_schema_diff_of_files(spark, tmp_path, rows):
    paths = [write(tmp_path / f"{i}.csv", list(h), [list(h)]) for i, h in enumerate(("ab", "ac", "abc"))]
    assert rows(trial_logs.schema_diff_files(spark, paths), "field", "n_sources") == [("b", 2), ("c", 2)]
    assert trial_logs.schema_diff_files(spark, []).count() == 0


def test_event_keys_are_checked_on_read(spark, tmp_path):
    path = str(tmp_path / "fx")
    df = spark.createDataFrame([("p", 1, 1), ("p", 1, 2)], "participant string, tno int, fix_count int")
    df.write.parquet(path)
    assert trial_logs.read_events(spark, path, trial_logs.EVENT_KEY).count() == 2
    with pytest.raises(ValueError, match="repeated"):
        trial_logs.validated(df.union(df.limit(1)))
    with pytest.raises(ValueError, match="missing"):
        trial_logs.validated(df.union(spark.createDataFrame([("p", None, 3)], df.schema)))


def test_union_filled(spark, rows):
    ab = spark.createDataFrame([(1, 2)], "a int, b int")
    ac = spark.createDataFrame([(3, 4)], "a int, c int")
    abc = spark.createDataFrame([(7, 6, 5)], "c int, b int, a int")
    assert rows(drift.union_filled([ab, ac, abc], ["b", "c"]), "a", "b", "c") == [(1, 2, None), (3, None, 4), (5, 6, 7)]
    with pytest.raises(drift.SchemaDriftError):
        drift.union_filled([ab, ac, spark.createDataFrame([(1, 1)], "a int, d int")], ["b", "c"])
    assert "e" in drift.union_filled([ab], ["e"]).columns


def test_not_shared(spark, rows):
    pairs = [(f, c) for f, cols in {"1": "ab", "2": "ac", "3": "abc"}.items() for c in cols]
    df = spark.createDataFrame(pairs * 2, "source string, name string")
    assert rows(drift.not_shared(df, "source", "name")) == [("b", 2), ("c", 2)]
    assert drift.not_shared(df.where("source > '9'"), "source", "name").count() == 0


def test_summary_csv(spark, tmp_path, rows):
    path = tmp_path / "s.csv"
    path.write_text('"","dist_region","dist_present","m_rt","se_rt","ci_rt"\n"1","Absent","Absent",1076.4929091544,12.49,26.8\n')
    got = summaries.read_summary(spark, str(path), "exp1")
    assert rows(got) == [("Absent", "Absent", 1076.4929091544, 12.49, 26.8, "exp1")]
    out = str(tmp_path / "out")
    summaries.write_summary(got.drop("experiment"), out)
    (lines,) = [p.read_text() for p in (tmp_path / "out").rglob("part-*.txt")]
    assert lines == path.read_text()
    with pytest.raises(FileExistsError):
        summaries.write_summary(got.drop("experiment"), out)
    summaries.write_summary(got.limit(0).drop("experiment"), out, mode="ignore")
    assert rows(summaries.read_summary(spark, out, "exp1")) == rows(got)
    summaries.write_summary(got.drop("experiment"), out, mode="overwrite", files=None)
    assert rows(summaries.read_summary(spark, out, "exp1")) == rows(got)
    with pytest.raises(ValueError, match="append"):
        summaries.write_summary(got, out, mode="append")


def test_a_failed_overwrite_keeps_the_old_summary(spark, tmp_path, rows):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "c string, n int, m double")
    summaries.write_summary(first, out)
    with pytest.raises(Exception, match="too far"):
        summaries.write_summary(first.selectExpr("c", "n", "CASE WHEN n > 1 THEN raise_error('too far') ELSE m END AS m"), out, mode="overwrite")
    assert rows(summaries.read_rows(spark, out)) == rows(first)
    second = first.selectExpr("c", "n + 1 AS n", "m", "true AS extra")
    summaries.write_summary(second, out, mode="overwrite")
    assert rows(summaries.read_rows(spark, out)) == rows(second)
    with pytest.raises(FileNotFoundError):
        summaries.read_rows(spark, str(tmp_path / "none"))


def test_lines_keep_every_value(spark, tmp_path):
    values = ["plain", "with, comma", 'a "quoted" word', "back\\slash", "'", "", " edge ", "NA ", "é 日", "1", None]
    doubles = [0.1, -0.0, 1e300, 5e-324, 1 / 3, float("nan"), float("inf"), -1e-7, 123456789.125, 2.0, None]
    df = spark.createDataFrame([(v, d, i, i % 2 == 0) for i, (v, d) in enumerate(zip(values, doubles))], "label string, x double, `a,b` long, flag boolean")
    for numbered in (True, False):
        back = summaries.from_lines(summaries.to_lines(df, numbered), df.schema, numbered)
        assert back.schema == df.schema
        assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, map(tuple, df.collect())))
    with pytest.raises(Exception, match="line break"):
        summaries.to_lines(spark.createDataFrame([("a\nb",)], "label string")).collect()
    with pytest.raises(Exception):  # noqa: B017
        summaries.from_lines(spark.createDataFrame([('"1","x"',)], "value string"), spark.createDataFrame([], "n int").schema).collect()


def test_duplicate_events(spark, rows):
    df = spark.createDataFrame([("p", 1, 1), ("p", 1, 2), ("p", 1, 2)], "participant string, tno int, fix_count int")
    assert rows(trial_logs.duplicate_events(df)) == [("p", 1, 2, 2)]


def test_read_events_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "fx")
    spark.createDataFrame([("p", 1, 1, 0.5)], "participant string, tno int, fix_count int, duration double").write.parquet(path)
    plan = trial_logs.read_events(spark, path).where("tno = 1").select("participant")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<participant:string,tno:int>" in plan and "EqualTo(tno,1)" in plan


def file_scans(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def test_a_thousand_headers_take_one_scan(spark, tmp_path, rows):
    rnd = random.Random(2)
    paths, want = [], []
    for i in range(1000):
        header = [*BASE, *rnd.sample(schemas.DRIFT_EXP1, rnd.randint(0, 7))]
        rnd.shuffle(header)
        values = {c: f"{c}{i}" for c in schemas.DRIFT_EXP1} | {"response.rt": i / 8}
        paths.append(write(tmp_path / f"{i}.csv", header, [log_row(f"p{i}", t, header, **values) for t in range(2)]))
        want += [(f"p{i}", t, i / 8, *(f"{c}{i}" if c in header else None for c in schemas.DRIFT_EXP1)) for t in range(2)]
    log = trial_logs.read_trial_logs(spark, paths, schemas.DRIFT_EXP1)
    assert log.select(*schemas.TRIAL_LOG.fieldNames()).schema == schemas.TRIAL_LOG
    got = log.select("participant", "trials_thisN", "response_rt", *map(trial_logs.plain, schemas.DRIFT_EXP1))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert file_scans(log) == 1


def test_paths_with_odd_characters_and_folders(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    for i, name in enumerate(("x y.csv", "50%25.csv", "a+b.csv", "ü.csv", "p=1,q.csv")):
        write(folder / name, [*reversed(BASE)] if i % 2 else BASE, [log_row(f"s{i}", i, [*reversed(BASE)] if i % 2 else BASE)])
    log = trial_logs.read_trial_logs(spark, [str(folder)], schemas.DRIFT_EXP1)
    assert sorted((r["participant"], r["trials_thisN"]) for r in log.collect()) == [(f"s{i}", i) for i in range(5)]


def test_only_the_beginning_of_files_is_read_for_headers(spark, tmp_path):
    path = tmp_path / "large.csv"
    row = ",".join(map(str, log_row("a", 1, BASE))) + "\n"
    path.write_text(",".join(BASE) + "\n" + row * 200_000)
    packed = tmp_path / "packed.csv.gz"
    packed.write_bytes(gzip.compress((",".join([*BASE, "extra"]) + "\n" + row * 1000).encode()))
    def bytes_read():
        return sum(x.getBytesRead() for x in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = bytes_read()
    headers = trial_logs.file_headers(spark, [str(path), str(packed)])
    read = bytes_read() - before
    assert sorted(map(len, headers.values())) == [len(BASE), len(BASE) + 1]
    assert path.stat().st_size > 8_000_000 and 0 < read < 200_000


def test_duplicate_and_short_rows(spark, tmp_path, rows):
    header = [*BASE, "per15_2.started"]
    path = write(tmp_path / "a.csv", header, [log_row("a", 1, header), log_row("a", 2, header)[: len(BASE)]])
    log = trial_logs.read_trial_logs(spark, [path], schemas.DRIFT_EXP1)
    assert rows(log, "trials_thisN", "per15_2_started") == [(1, "x"), (2, None)]
