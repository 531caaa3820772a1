"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once for three base kinds (assignments, access keys, hex runs) and
for loose tokens that mix cases and digits.  Hashes of all candidates are then counted
over the corpus by distinct repositories and distinct owners: a value seen under many owners is a copied
example, a value that only a few share looks like a live credential, in however many of their repositories,
rows and files it is.  Where the owner of a row is unknown, its repository stands for one: nobody says that two of them
belong together.  Base spans always stay; a loose token becomes a span only
when it is owner-specific and not wholly covered by base spans.

Defined results: null or empty text has no spans; rows without owner and repository count as one owner;
repeated rows are scanned row by row; other columns pass through or are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import free_name, materialise, prepare

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same spans as all runs filtered by length
LOOSE = re.compile(r"[A-Za-z0-9+/_-]{24,}")
KINDS = ("assign", "access", "hex", "loose")
#: a value is owner-specific up to this many owners (and repositories without one)
MAX_OWNERS = 2


def scan(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """(base spans, loose spans) as (start, kind number, end, secret value)."""
    base = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base.sort()
    loose = []
    for m in LOOSE.finditer(text):
        v = m[0]
        if (any(c.islower() for c in v) and any(c.isupper() for c in v) and sum(c.isdigit() for c in v) >= 3
                and not _covered(m.start(), m.end(), base)):
            loose.append((m.start(), 3, m.end(), v))
    return base, loose


def _covered(start: int, stop: int, base: list) -> bool:
    """Whether base spans (sorted by start) together hold every character of start..stop."""
    for s, _, e, _ in base:
        if s > start or start >= stop:
            break
        start = max(start, e)
    return start >= stop


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


FINDING = "start long, kind int, stop long, value string, base boolean"
SCANNED = ("row string, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, "
           f"base_sha256 string, found array<struct<{FINDING}>>")


def scan_rows(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None = None) -> DataFrame:
    """One row per document with its candidates (hashes of values, never the values)."""
    repo = F.lit(None) if repo_col is None else F.col(repo_col)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                    F.col(text_col).alias("text"), repo.cast("string").alias("repository"))
    finding = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()),
                         ("value", pa.string()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("row", "n_assign", "n_access", "n_hex", "base_sha256", "found")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                text = text or ""
                base, loose = scan(text)
                cols["row"].append(row_key(doc, text))
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    cols[name].append(sum(x[1] == k for x in base))
                cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols["found"].append([{"start": s, "kind": k, "stop": e, "base": k < 3,
                                       "value": hashlib.sha256(v.encode()).hexdigest()[:32]}
                                      for s, k, e, v in [*base, *loose]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["row"], pa.string()), batch.column(0), batch.column(1), batch.column(3),
                 *[pa.array(cols[c], pa.int64()) for c in ("n_assign", "n_access", "n_hex")],
                 pa.array(cols["base_sha256"], pa.string()), pa.array(cols["found"], pa.list_(finding))],
                names=["row", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return src.mapInArrow(run, SCANNED)


def row_key(doc, text: str) -> str:
    """Identity of a row by content, so that repeated rows share their decisions."""
    return hashlib.md5(f"{doc}\x00{text}".encode("utf-8", "surrogatepass")).hexdigest()


def ownership(scanned: DataFrame) -> DataFrame:
    """(value, owners, repositories, live) per candidate hash.

    ``repositories`` counts distinct pairs of owner and repository, ``owners`` the distinct owners, an unknown owner by its
    repository.  Three aggregations, all combined map-side: to distinct (value, owner, repository), to
    (value, owner), then to the value; no value is gathered in one task."""
    owner = F.coalesce(F.concat(F.lit("o:"), "owner"), F.concat(F.lit("r:"), "repository"), F.lit(""))
    pairs = (scanned.select(owner.alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"), F.explode("found").alias("f"))
             .select(F.col("f.value").alias("value"), "owner", "repository").distinct())
    return (pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
            .groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
            .withColumn("live", F.col("owners") <= MAX_OWNERS))


def credentials(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                repo_col: str | None = None) -> DataFrame:
    """(value, kinds, found, owners, repositories, live) per distinct candidate of the corpus: the report that separates
    widely copied examples from owner-specific credentials.  Values are hashes."""
    prepare(df.sparkSession)
    scanned = materialise(scan_rows(df, id_col, text_col, owner_col, repo_col))
    hits = scanned.select(F.explode("found").alias("f")).select(F.col("f.value").alias("value"), F.col("f.kind").alias("kind"))
    label = F.array(*[F.lit(k) for k in KINDS])
    seen = hits.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_set("kind")), lambda k: F.element_at(label, k + 1)), ",").alias("kinds"),
                                     F.count(F.lit(1)).alias("found"))
    return seen.join(ownership(scanned), "value")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str | None = None) -> DataFrame:
    """One row per document: counts of base kinds, ``base_sha256``, all ``spans``, the spans
    to mask, and how many of its candidates look live or are copied examples."""
    prepare(df.sparkSession)
    scanned = materialise(scan_rows(df, id_col, text_col, owner_col, repo_col))
    hits = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).distinct()
    # written first, so that both sides of the join are plain shuffles that may be split
    # where one value is held by very many rows
    owned = materialise(ownership(scanned))
    judged = (hits.select("row", "f", F.col("f.value").alias("value"))
              .join(owned.select("value", "live"), "value")
              .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
                  F.col("f.start").alias("start"), F.col("f.kind").alias("kind"), F.col("f.stop").alias("stop"),
                  F.col("f.base").alias("base"), "live"))).alias("judged")))
    kept = F.filter(F.coalesce("judged", F.array()), lambda x: x["base"] | x["live"])
    label = F.array(*[F.lit(k) for k in KINDS])
    return (scanned.join(judged, "row", "left")
            .select("row", F.col("doc_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
                    F.concat_ws(",", F.transform(kept, lambda x: F.concat_ws(
                        ":", F.element_at(label, x["kind"] + 1), x["start"], x["stop"]))).alias("spans"),
                    F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("mask"),
                    F.size(F.filter(F.coalesce("judged", F.array()), lambda x: x["live"])).cast("long").alias("n_live"),
                    F.size(F.filter(F.coalesce("judged", F.array()), lambda x: ~x["live"])).cast("long").alias("n_example")))


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 by: str = "[secret]", repo_col: str | None = None) -> DataFrame:
    """``df`` with every span of ``find_secrets`` replaced by ``by``; all rows stay.

    Rows are joined with their spans by content key; only rows with spans are on the
    other side."""
    found = find_secrets(df, id_col, text_col, owner_col, repo_col)
    key, mask = free_name(df, "row_key"), free_name(df, "row_mask")
    spans = (found.where(F.size("mask") > 0).select(F.col("row").alias(key), F.col("mask").alias(mask))
             .dropDuplicates([key]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("None")), F.lit("\x00"), text))
    joined_df = df.withColumn(key, own).join(spans, key, "left")
    # walk the spans in order, keeping (text so far, position reached); overlaps merge
    walked = F.aggregate(
        F.col(mask), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(by)))
            .otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["stop"]).alias("at")))
    masked = F.concat(walked["out"], F.substr(text, (walked["at"] + 1).cast("int"), F.length(text)))
    return joined_df.withColumn(text_col, F.when(F.col(mask).isNotNull(), masked).otherwise(F.col(text_col))).drop(key, mask)
