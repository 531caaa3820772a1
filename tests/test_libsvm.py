"""LIBSVM and labelled-point loaders: edge rows, files, format switch."""

import os

import pytest

from concord.sources import libsvm as io


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def parsed(spark, rows, relabel=True):
    return io.parse_records(io.clean_lines(lines(spark, rows)), relabel=relabel)


def test_blank_and_comment_lines_dropped(spark):
    assert io.clean_lines(lines(spark, ["", "   ", "# note", "1 1:2"])).count() == 1


def test_relabel_and_raw(spark):
    r = parsed(spark, ["-1 1:0.5 3:2"]).first()
    assert (r["label"], r["indices"], r["values"], r["bad"]) == (0.0, [0, 2], [0.5, 2.0], False)
    assert parsed(spark, ["-1 1:0.5 3:2"], relabel=False).first()["label"] == -1.0


def test_plus_sign_and_double_spaces(spark):
    r = parsed(spark, ["+1  2:1"]).first()
    assert (r["label"], r["indices"], r["values"]) == (1.0, [1], [1.0])


def test_no_features_counts_as_index_zero(spark):
    p = parsed(spark, ["1"])
    r = p.first()
    assert r["indices"] == [] and r["values"] == [] and not r["bad"]
    assert io.infer_num_features(p) == 1


@pytest.mark.parametrize("line", ["1 2:1 2:3", "1 3:1 2:1", "1 0:1", "1 1:x", "abc 1:1"])
def test_bad_rows_flagged(spark, line):
    assert parsed(spark, [line]).first()["bad"]


@pytest.mark.parametrize("line", ["1 2:1 2:3", "1 3:1 2:1", "1 0:1", "1 1:x", "abc 1:1", "1 5", "1 1:2:3", "1 :1"])
@pytest.mark.parametrize("column", ["label", "indices", "values"])
def test_strict_loader_raises_whatever_is_read(spark, line, column):
    rows, _ = io.load_libsvm_lines(lines(spark, ["1 1:1", line]), num_features=9)
    with pytest.raises(Exception, match="not a valid record"):
        rows.select(column).collect()


@pytest.mark.parametrize("column", ["label", "indices", "values"])
def test_known_width_rejects_wider_rows(spark, column):
    rows, d = io.load_libsvm_lines(lines(spark, ["1 1:1 5:2"]), num_features=3)
    assert d == 3
    with pytest.raises(Exception, match="beyond the model width"):
        rows.select(column).collect()


def test_tolerant_loader_sets_bad_rows_apart(spark):
    rows = ["1 1:1", "\t# note", "\t", "1 5", "x 1:1", "-1 2:1 4:2", "1 9:1"]
    good, bad, d = io.load_libsvm_tolerant(lines(spark, rows), num_features=4)
    assert d == 4 and sorted(r["label"] for r in good.collect()) == [0.0, 1.0]
    assert sorted(r["line"] for r in bad.collect()) == ["1 5", "1 9:1", "x 1:1"]


def test_missing_paths_can_be_skipped(spark, scratch):
    a = os.path.join(scratch, "here")
    lines(spark, ["1 1:1"]).write.text(a)
    rows, _ = io.load_libsvm(spark, [a, os.path.join(scratch, "gone")], ignore_missing=True)
    assert rows.count() == 1
    with pytest.raises(Exception):
        io.load_libsvm(spark, [a, os.path.join(scratch, "gone")])[0].count()


def test_malformed_point_fails_with_its_text(spark):
    with pytest.raises(Exception, match="not a labelled point"):
        io.parse_labeled_points(lines(spark, ["(1.0,[1.0,oops])"])).select("features").collect()


def test_small_test_fractions_are_not_rounded_away(spark):
    df = spark.range(100_000).withColumnRenamed("id", "k")
    assert 300 < io.hash_split(df, "k", 0.004)[1].count() < 500


def test_dense_test_rows_wider_than_the_model_are_refused(spark, scratch):
    tr, te = os.path.join(scratch, "dtr"), os.path.join(scratch, "dte")
    lines(spark, ["(1.0,[1.0,2.0])", "(0.0,[2.0,1.0])"]).write.text(tr)
    lines(spark, ["(1.0,[1.0,2.0,3.0])"]).write.text(te)
    _, test, d = io.load_datasets(spark, tr, "dense", test_path=te)
    assert d == 2
    with pytest.raises(Exception, match="wider than the model"):
        test.select("features").collect()


def test_classifier_rejects_non_binary_label(spark):
    from concord.plans.train import check_binary_labels

    rows, _ = io.load_libsvm_lines(lines(spark, ["2 1:1", "1 1:2"]), binary=True)
    with pytest.raises(ValueError):
        check_binary_labels(rows)


def test_files_multi_path_and_builtin(spark, scratch):
    a, b = os.path.join(scratch, "a"), os.path.join(scratch, "b")
    lines(spark, ["# header", "-1 1:1 3:2", "1 2:4"]).coalesce(1).write.text(a)
    lines(spark, ["1 1:0.5", ""]).coalesce(1).write.text(b)
    rows, d = io.load_libsvm(spark, [a, b])
    assert rows.count() == 3 and d == 3
    assert sorted(r["label"] for r in rows.collect()) == [0.0, 1.0, 1.0]
    builtin = io.vectors_to_arrays(io.load_libsvm_builtin(spark, a, num_features=3))
    got = sorted((r["label"], tuple(r["features"])) for r in builtin.collect())
    assert got == [(-1.0, (1.0, 0.0, 2.0)), (1.0, (0.0, 4.0, 0.0))]


def test_format_switch(spark, scratch):
    path = os.path.join(scratch, "pts")
    lines(spark, ["(1.0,[1.0,0.0,3.0])", "0.0,2.0 1.0 0.0", "(1.0,(3,[0,2],[5.0,6.0]))"]).coalesce(1).write.text(path)
    got = sorted((r["label"], tuple(r["features"])) for r in io.load_data(spark, path, "dense").collect())
    assert got == [(0.0, (2.0, 1.0, 0.0)), (1.0, (1.0, 0.0, 3.0)), (1.0, (5.0, 0.0, 6.0))]
    with pytest.raises(ValueError):
        io.load_data(spark, path, "csv")


def test_hash_split_is_repeatable_and_whole(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    train, test = io.hash_split(df, "k", 0.25)
    n_train, n_test = train.count(), test.count()
    assert n_train + n_test == 2000 and 350 < n_test < 650
    assert sorted(r["k"] for r in io.hash_split(df, "k", 0.25)[1].collect()) == sorted(r["k"] for r in test.collect())


def test_load_datasets_split_and_test_file(spark, scratch):
    tr, te = os.path.join(scratch, "tr"), os.path.join(scratch, "te")
    lines(spark, [f"{i % 2} 1:{i} 2:1" for i in range(1, 101)]).write.text(tr)
    lines(spark, ["1 1:1 3:1"]).write.text(te)
    train, test, d = io.load_datasets(spark, tr, "libsvm", frac_test=0.3)
    assert d == 2 and train.count() + test.count() == 100
    _, test2, _ = io.load_datasets(spark, tr, "libsvm", test_path=te)
    with pytest.raises(Exception):  # the test file is wider than the training width
        test2.collect()


def test_filters_leave_the_parse_whole(spark):
    """A filter on parsed columns repeats none of the parse and stays above the spread of the lines."""
    lines = spark.range(10).selectExpr("concat('+1 1:', id) AS value").repartition(3)
    plan = io.bad_rows(io.parse_records(io.clean_lines(lines)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    assert "Filter" not in plan[plan.index("Repartition"):]
