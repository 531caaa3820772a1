"""LIBSVM and labelled-point text loaders, as DataFrame plans (no per-row Python).

A LIBSVM record is ``label i:v i:v ...`` with 1-based ascending indices.  The plan:
``spark.read.text`` -> trim all white space -> drop blank and ``#`` lines -> split once on
blanks -> ``i:v`` to (i-1, v) -> order and width checks -> optional relabel (-1 -> 0).  Every
step is a built-in expression; each line is split once and each item once, whatever is filtered on it later.

A strict load carries its checks in ``label``, ``indices`` and ``values`` themselves, so
whichever of them a query reads, the first bad row fails the job.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.losses import label_01

#: characters stripped from both ends of a line
_BLANKS = " \t\r\n\f\x0b"


def read_lines(spark: SparkSession, paths: str | Sequence[str], ignore_missing: bool = False) -> DataFrame:
    """Text lines of one or several files or folders (``value string``).  With
    ``ignore_missing`` paths that match nothing are skipped (all missing: no lines)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if ignore_missing:
        paths = [p for p in paths if _exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], "value string")
    return spark.read.text(paths)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once per row, by a generator of one element.  A projection's columns are copied
    into every filter that the optimizer moves below it, and into each place that reads them there; a generator's are not,
    and a filter on them stays above, also above a ``repartition`` that spreads the work."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def clean_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trim, then drop empty lines and ``#`` comment lines; adds ``line``."""
    return (_once(lines, line=_trimmed(F.col(col)))
            .where(~((F.length("line") == 0) | F.col("line").startswith("#"))))


def parse_records(lines: DataFrame, line_col: str = "line", relabel: bool = True) -> DataFrame:
    """Parse cleaned lines into ``label double, indices array<int>, values array<double>``
    plus a ``bad`` flag: an item that is not ``i:v``, an unparsable number, or an index
    that is not above the one before it (the first must be at least 1).

    The line, its items and the numbers in them are each read once (``_once``)."""
    tokens = F.filter(F.split(F.col(line_col), " "), lambda t: t != "")
    out = _once(lines, __tokens__=tokens)
    out = _once(out, __items__=F.transform(
        F.slice("__tokens__", 2, F.greatest(F.size("__tokens__") - 1, F.lit(0))), lambda t: F.split(t, ":")))
    raw_label = F.get("__tokens__", 0).try_cast("double")
    out = _once(out, label=label_01(raw_label) if relabel else raw_label,
                indices=F.transform("__items__", lambda x: F.get(x, 0).try_cast("int") - 1),
                values=F.transform("__items__", lambda x: F.get(x, 1).try_cast("double")),
                __shape__=F.exists("__items__", lambda x: F.size(x) != 2))
    # one pass over the indices: the running index, or -2 once the order was broken
    order = F.aggregate("indices", F.lit(-1), lambda last, i: F.when((last >= -1) & (i > last), i).otherwise(F.lit(-2)))
    bad = (F.col("label").isNull() | F.col("__shape__") | F.exists("indices", lambda i: i.isNull())
           | F.exists("values", lambda v: v.isNull()) | (order == -2))
    return _once(out, bad=bad).select(*[F.col(f"`{c}`") for c in lines.columns if c not in ("label", "indices", "values", "bad")],
                                      "label", "indices", "values", "bad")


def bad_rows(parsed: DataFrame) -> DataFrame:
    """The rows that the strict loader would reject."""
    return parsed.where("bad")


def _checked(parsed: DataFrame, bad: Column, message: Column) -> DataFrame:
    """``label``, ``indices`` and ``values`` fail the job where ``bad`` holds."""
    for name in ("label", "indices", "values"):
        kind = parsed.schema[name].dataType
        parsed = parsed.withColumn(f"__{name}__", F.when(bad, F.raise_error(message).cast(kind)).otherwise(F.col(name)))
    return parsed.select(*[F.col(f"__{c}__").alias(c) if c in ("label", "indices", "values") else F.col(f"`{c}`")
                           for c in parsed.columns if not c.startswith("__")])


def require_valid(parsed: DataFrame) -> DataFrame:
    """Strict mode: reading label, indices or values of a bad row fails with its text."""
    return _checked(parsed, F.col("bad"), F.concat(F.lit("not a valid record: \""), F.col("line"), F.lit("\"")))


def _last_index(parsed: DataFrame) -> Column:
    return F.coalesce(F.get("indices", F.size("indices") - 1), F.lit(0))


def infer_num_features(parsed: DataFrame) -> int:
    """``max(last index) + 1``; a row without features counts as index 0."""
    return int(parsed.agg(F.max(_last_index(parsed)).alias("m")).first()["m"] or 0) + 1


def num_features_frame(parsed: DataFrame) -> DataFrame:
    return parsed.agg((F.max(_last_index(parsed)) + 1).cast("int").alias("num_features"))


def _with_width(rows: DataFrame, num_features: int) -> tuple[DataFrame, int]:
    """Enforce the width on the three data columns (indices ascend, so the last decides)."""
    d = num_features if num_features > 0 else infer_num_features(rows)
    message = F.concat(F.lit(f"feature index beyond the model width {d}: \""), F.col("line"), F.lit("\""))
    return _checked(rows, _last_index(rows) >= F.lit(d), message).withColumn("size", F.lit(d)).drop("bad"), d


def load_libsvm_lines(lines: DataFrame, num_features: int = -1, binary: bool = True) -> tuple[DataFrame, int]:
    """Lines (``value``) -> rows ``label, size, indices, values`` and the width d.

    ``binary=True`` relabels -1 to 0 (classification); ``False`` keeps labels (regression).
    The first bad row fails the job that reads it; so does an index beyond a known width."""
    return _with_width(require_valid(parse_records(clean_lines(lines), relabel=binary)), num_features)


def load_libsvm_tolerant(lines: DataFrame, num_features: int = -1, binary: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """(good rows, bad rows, width): bad records are set apart instead of failing.  With a
    known width, records beyond it are bad too."""
    parsed = parse_records(clean_lines(lines), relabel=binary)
    if num_features > 0:
        parsed = parsed.withColumn("bad", F.col("bad") | (_last_index(parsed) >= F.lit(num_features)))
    good = parsed.where("not bad")
    rows, d = _with_width(good, num_features)
    return rows, parsed.where("bad").drop("bad"), d


def load_libsvm(spark: SparkSession, paths: str | Sequence[str], num_features: int = -1, binary: bool = True,
                min_partitions: int | None = None, ignore_missing: bool = False) -> tuple[DataFrame, int]:
    """Load LIBSVM files (``binary``: -1 -> 0).  ``min_partitions`` spreads the lines over
    that many tasks at least."""
    lines = read_lines(spark, paths, ignore_missing)
    if min_partitions:
        lines = lines.repartition(min_partitions)
    return load_libsvm_lines(lines, num_features=num_features, binary=binary)


def load_libsvm_builtin(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Spark's own ``libsvm`` source (``label double, features vector``)."""
    reader = spark.read.format("libsvm")
    if num_features:
        reader = reader.option("numFeatures", str(num_features))
    return reader.load(path)


def vectors_to_arrays(df: DataFrame, features: str = "features") -> DataFrame:
    """``pyspark.ml`` vector column -> dense ``array<double>`` (the ML edge only)."""
    from pyspark.ml.functions import vector_to_array

    return df.withColumn(features, vector_to_array(F.col(features)))


# ------------------------------------------------------------------ labelled points


_DENSE = r"^\(\s*([^,]+)\s*,\s*\[(.*)\]\s*\)$"
_SPARSE = r"^\(\s*([^,]+)\s*,\s*\(\s*(\d+)\s*,\s*\[(.*)\]\s*,\s*\[(.*)\]\s*\)\s*\)$"
_LEGACY = r"^([^,(]+),(.*)$"


def _num_list(s: Column, sep: str, cast: str) -> Column:
    parts = F.filter(F.split(F.trim(s), sep), lambda t: F.trim(t) != "")
    return F.transform(parts, lambda t: F.trim(t).try_cast(cast))


def parse_labeled_points(lines: DataFrame, col: str = "value") -> DataFrame:
    """Labelled-point text: ``(label,[v1,v2,...])`` dense, ``(label,(n,[i..],[v..]))``
    sparse, or the legacy ``label,v1 v2 ...``.  Output ``label double,
    features array<double>`` (sparse forms are expanded to dense).  A line with an
    unreadable number fails the job that reads its label or features, with its text."""
    line = _trimmed(F.col(col))
    is_sparse = line.rlike(_SPARSE)
    is_dense = line.rlike(_DENSE)
    label = (F.when(is_sparse, F.regexp_extract(line, _SPARSE, 1))
              .when(is_dense, F.regexp_extract(line, _DENSE, 1))
              .otherwise(F.regexp_extract(line, _LEGACY, 1)))
    dense_vals = _num_list(F.regexp_extract(line, _DENSE, 2), ",", "double")
    legacy_vals = _num_list(F.regexp_extract(line, _LEGACY, 2), " ", "double")
    size = F.regexp_extract(line, _SPARSE, 2).try_cast("int")
    idx = _num_list(F.regexp_extract(line, _SPARSE, 3), ",", "int")
    vals = _num_list(F.regexp_extract(line, _SPARSE, 4), ",", "double")
    lookup = F.map_from_arrays(idx, vals)
    sparse_dense = F.transform(F.array_repeat(F.lit(0.0), F.coalesce(size, F.lit(0))),
                               lambda zero, k: F.coalesce(F.element_at(lookup, k), zero))
    features = F.when(is_sparse, sparse_dense).when(is_dense, dense_vals).otherwise(legacy_vals)
    out = lines.where(F.length(line) > 0).select(
        "*", line.alias("__line__"), F.trim(label).try_cast("double").alias("__label__"), features.alias("__features__"))
    bad = F.col("__label__").isNull() | F.col("__features__").isNull() | F.exists("__features__", lambda v: v.isNull())
    error = F.raise_error(F.concat(F.lit("not a labelled point: \""), F.col("__line__"), F.lit("\"")))
    return out.select(*lines.columns, F.when(bad, error.cast("double")).otherwise(F.col("__label__")).alias("label"),
                      F.when(bad, error.cast("array<double>")).otherwise(F.col("__features__")).alias("features"))


def load_dense_points(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_labeled_points(read_lines(spark, paths))


# ------------------------------------------------------------------ format switch, data sets


def load_data(spark: SparkSession, path: str, fmt: str, num_features: int | None = None) -> DataFrame:
    """``"dense"`` or ``"libsvm"``; anything else is a ValueError.  Always reads ``path``."""
    if fmt == "dense":
        return load_dense_points(spark, path)
    if fmt == "libsvm":
        rows, _ = load_libsvm(spark, path, num_features=num_features or -1, binary=False)
        return rows
    raise ValueError(f"Bad data format: {fmt}")


#: grain of a repeatable split
SPLIT_BUCKETS = 1_000_000


def bucket_of(key: str | Column, buckets: int = SPLIT_BUCKETS) -> Column:
    """0..buckets-1 from the first 8 hex digits of md5(key as string): repeatable in any engine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, key: str | Column, frac_test: float) -> tuple[DataFrame, DataFrame]:
    """Repeatable train/test split by key bucket, to a millionth; a null key trains."""
    test = F.coalesce(bucket_of(key) < int(round(SPLIT_BUCKETS * frac_test)), F.lit(False))
    return df.where(~test), df.where(test)


def load_datasets(spark: SparkSession, path: str, fmt: str, test_path: str = "", frac_test: float = 0.2,
                  seed: int = 12345) -> tuple[DataFrame, DataFrame, int]:
    """Train, test and the width.  With ``test_path`` the test file is read with the
    train width (wider test rows are an error); else ``randomSplit([1-f, f], seed)``."""
    if fmt == "libsvm":
        train, d = load_libsvm(spark, path, binary=False)
        if test_path:
            test, _ = load_libsvm(spark, test_path, num_features=d, binary=False)
        else:
            train, test = train.randomSplit([1.0 - frac_test, frac_test], seed=seed)
        return train, test, d
    train = load_data(spark, path, fmt)
    d = int(train.agg(F.max(F.size("features")).alias("d")).first()["d"])
    if test_path:
        test = load_data(spark, test_path, fmt)
        wide = F.raise_error(F.concat(F.lit(f"a test row is wider than the model width {d}: "), F.col("value")))
        test = test.withColumn("features", F.when(F.size("features") > d, wide.cast("array<double>")).otherwise(F.col("features")))
    else:
        train, test = train.randomSplit([1.0 - frac_test, frac_test], seed=seed)
    return train, test, d
