"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased, runs of non-letters become one space, and every 4-gram of the
labelled texts is counted over the whole corpus (``count_grams``: map-side sums, one small
shuffle).  ``fit`` turns the counts into one Kneser-Ney model per language; log-probabilities
of all orders live in arrays sorted by hash with a bucket index, which are broadcast (they
hold every gram, and so grow with the distinct grams of the corpus).  ``predict`` takes the language of lowest
length-normalised cross-entropy.  Rejection thresholds are calibrated on all labelled rows of every
language that are long enough.

Defined results: null text, or text without a letter, is ``und`` with score 0 and rejected;
a null label never trains; ties go to the first language in sorted order; without any
labelled row everything is ``und``; repeated rows count and are predicted row by row; other
columns are never inputs.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concord.llm.common import discard, materialise, packed_row, prepare, text_slices

ORDER = 4
SLICE_BYTES = 1 << 18
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplying by it permutes 64-bit keys
BUCKET_BITS = 18


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit symbols of all texts, start of each text): lower case, one space for every
    run of non-letters and one before each text; letters beyond 16 bits are folded onto the 2,048 symbols
    that no character has."""
    lowered = [t.lower() for t in texts]
    joined = "".join(" " + t for t in lowered)
    lengths = np.fromiter((1 + len(t) for t in lowered), np.int64, len(texts))
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first non-letter after a letter stays, as a space
    starts = np.cumsum(lengths) - lengths
    keep[starts] = True
    symbols = np.where(is_letter, np.where(cp > 0xFFFF, 0xD800 + cp % 2048, cp), 32).astype(np.uint16)
    at = np.cumsum(keep)
    return symbols[keep], at[starts] - 1


def gram_keys(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 4-gram ending at every position, 16 bits a symbol; text starts see spaces."""
    key = symbols.astype(np.uint64)
    for back in range(1, ORDER):
        prior = np.full(len(symbols), 32, np.uint64)
        prior[back:] = symbols[:-back]
        for k in range(back):  # positions whose prior symbol lies before their text
            at = starts + k
            at = at[at < len(symbols)]
            prior[at] = 32
        key |= prior << np.uint64(16 * back)
    return key


def count_grams(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all labelled rows; each task sums its own grams first."""
    prepare(df.sparkSession)
    src = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def fold(lang):
            keys, n = (np.concatenate(x) for x in zip(*held[lang]))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
            held[lang] = [(keys[first], np.add.reduceat(n, first) if len(n) else n)]

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                rows = batch.take(pa.array(np.flatnonzero(langs == lang)))
                for part in text_slices(rows, "text", SLICE_BYTES):
                    symbols, starts = letter_runs(part.column("text").to_pylist())
                    keys = gram_keys(symbols, starts)
                    real = np.ones(len(keys), bool)
                    real[starts] = False
                    keys, n = np.unique(keys[real], return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    if len(held[lang]) > 30:
                        fold(lang)
        for lang in sorted(held):
            fold(lang)
            keys, n = held[lang][0]
            for lo in range(0, len(keys), 50_000):
                part = keys[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)),
                     pa.array(n[lo:lo + 50_000].astype(np.int64))], names=["lang", "gram", "n"])

    return (src.mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class HashArray:
    """Keys sorted by hash with a bucket index over the leading hash bits."""

    def __init__(self, keys: np.ndarray):
        hashed = keys * MIX
        self.order = np.argsort(hashed)
        self.hashed = np.append(hashed[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        edges = np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
        self.bucket = np.searchsorted(self.hashed[:-1], edges).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of every key in sorted order, or the number of keys when it is absent."""
        n = len(self.hashed) - 1
        hashed = keys * MIX
        at = self.bucket[(hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        got = self.hashed[at]
        behind = np.flatnonzero(got < hashed)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashed[at[behind]] < hashed[behind]]
        at[self.hashed[at] != hashed] = n
        at[at > n] = n
        return at


@dataclass
class Model:
    langs: list[str]
    grams: list[HashArray] = field(default_factory=list)  # order 4 down to 2
    logp: list[np.ndarray] = field(default_factory=list)  # per order: (grams + 1) x languages
    backoff: list[np.ndarray] = field(default_factory=list)  # per order: log weight of a context
    contexts: list[HashArray] = field(default_factory=list)
    unigram: np.ndarray | None = None  # 65,536 x languages
    mean: np.ndarray | None = None  # calibrated cross-entropy, its spread over texts and symbols
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None

    def log_probs(self, keys: np.ndarray, depth: int = 0) -> np.ndarray:
        """Log-probability of the last symbol of each gram under every language."""
        if depth == ORDER - 1:
            return self.unigram[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        order = ORDER - depth
        if depth:
            keys = keys & np.uint64((1 << (16 * order)) - 1)
        at = self.grams[depth].find(keys)
        out = self.logp[depth][at]
        missing = np.flatnonzero(at == len(self.logp[depth]) - 1)
        if len(missing):
            part = keys[missing]
            ctx = self.contexts[depth].find(part >> np.uint64(16))
            out[missing] = self.backoff[depth][ctx] + self.log_probs(part, depth + 1)
        return out


def fit(counts: pa.Table) -> Model:
    """Kneser-Ney models of all languages from a table (lang, gram, n).

    The top order uses counts; each lower order uses the number of distinct symbols seen
    before a gram.  Every order is interpolated with the next lower one by an absolute
    discount; the lowest is interpolated with the uniform distribution."""
    if not counts.num_rows:
        return Model([])
    of = counts.column("lang").combine_chunks().dictionary_encode()
    if isinstance(of, pa.ChunkedArray):
        of = of.combine_chunks()
    names = of.dictionary.to_pylist()
    number, gram, n = of.indices.to_numpy(), counts.column("gram").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    langs = sorted(names)
    model = Model(langs)
    if not langs:
        return model
    raw = {la: (gram[number == names.index(la)], n[number == names.index(la)].astype(np.float64)) for la in langs}
    levels: list[dict] = []  # per order 4..1: lang -> (grams, weights)
    level = raw
    for order in range(ORDER, 0, -1):
        levels.append(level)
        if order > 1:
            mask = np.uint64((1 << (16 * (order - 1))) - 1)
            level = {la: tuple(x.astype(t) for x, t in zip(np.unique(g & mask, return_counts=True), (np.uint64, np.float64)))
                     for la, (g, _) in level.items()}
    n_lang = len(langs)
    model.unigram = np.zeros((1 << 16, n_lang), np.float32)
    for k, lang in enumerate(langs):
        g, c = levels[-1][lang]
        d = _discount(c)
        p = np.full(1 << 16, d * len(c) / c.sum() / (1 << 16))
        p[g.astype(np.int64)] += np.maximum(c - d, 0) / c.sum()
        model.unigram[:, k] = np.log(p)
    built: list[tuple] = []
    for depth in range(ORDER - 2, -1, -1):  # bigrams up to 4-grams, each on the order below
        order = ORDER - depth
        grams = np.unique(np.concatenate([levels[depth][la][0] for la in langs]))
        ctx = np.unique(grams >> np.uint64(16))
        back = np.zeros((len(ctx) + 1, n_lang))
        high = np.zeros((len(grams), n_lang))
        for k, lang in enumerate(langs):
            g, c = levels[depth][lang]
            d = _discount(c)
            at = np.searchsorted(ctx, g >> np.uint64(16))
            total = np.bincount(at, c, len(ctx))
            kinds = np.bincount(at, minlength=len(ctx))
            back[:-1, k] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            high[np.searchsorted(grams, g), k] = np.maximum(c - d, 0) / total[at]
        back[-1] = 1.0
        below = Model(langs, unigram=model.unigram)
        pad = ORDER - order + 1  # lower orders sit at the end of the lists
        below.grams = [None] * pad + [b[0] for b in built]
        below.logp = [None] * pad + [b[1] for b in built]
        below.contexts = [None] * pad + [b[2] for b in built]
        below.backoff = [None] * pad + [b[3] for b in built]
        lower = np.exp(below.log_probs(grams, depth + 1).astype(np.float64))
        p = high + back[np.searchsorted(ctx, grams >> np.uint64(16))] * lower
        table, contexts = HashArray(grams), HashArray(ctx)
        logp = np.vstack([np.log(p)[table.order], np.zeros((1, n_lang))]).astype(np.float32)
        backoff = np.vstack([np.log(back[:-1])[contexts.order], np.zeros((1, n_lang))]).astype(np.float32)
        built.insert(0, (table, logp, contexts, backoff))
    model.grams, model.logp, model.contexts, model.backoff = (list(x) for x in zip(*built))
    return model


def _discount(counts: np.ndarray) -> float:
    one, two = float((counts == 1).sum()), float((counts == 2).sum())
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


def cross_entropies(model: Model, texts: list[str | None]):
    """(nats per symbol under each language, their variance, symbols) per text."""
    n_lang, n = len(model.langs), len(texts)
    symbols, starts = letter_runs(["" if t is None else t for t in texts])
    keys = gram_keys(symbols, starts)
    nats = -model.log_probs(keys)
    real = np.ones(len(keys), np.float32)
    real[starts] = 0  # the space before a text is context only
    nats *= real[:, None]
    size = np.diff(np.append(starts, len(keys))) - 1
    has = np.add.reduceat((symbols != 32).astype(np.int64), starts) if n else np.zeros(0, np.int64)
    total = np.add.reduceat(nats, starts, axis=0, dtype=np.float64) if n else np.zeros((0, n_lang))
    square = np.add.reduceat(nats * nats, starts, axis=0, dtype=np.float64) if n else np.zeros((0, n_lang))
    div = np.maximum(size, 1)[:, None]
    return total / div, np.maximum(square / div - (total / div) ** 2, 0), np.where(has > 0, size, 0)


#: least rows of a language that thresholds are set on
LEAST_ROWS = 10
#: symbols of a text that is long enough to set thresholds on
CALIBRATION_SYMBOLS = 20
#: values are compared to a 2^-20 (nats per symbol), and counted first by runs of 2^12 such steps
STEPS, RUN = 1 << 20, 1 << 12


def measure(df: DataFrame, model: Model, lang_col: str, text_col: str) -> DataFrame:
    """(lang, h, var, size): cross-entropy under the own language's model, its variance and the symbols of every
    usable text, scored where they are and written once (a few numbers per text)."""
    spark = df.sparkSession
    usable = (df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
              .where(F.col("lang").isNotNull() & F.col("text").rlike(r"(?s)(?:\p{L}\P{L}*+){%d}" % CALIBRATION_SYMBOLS)))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = {la: k for k, la in enumerate(m.langs)}
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                h, var, size = cross_entropies(m, part.column("text").to_pylist())
                at, own = np.arange(part.num_rows), np.array([number[la] for la in part.column("lang").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(h[at, own]), pa.array(var[at, own].astype(np.float64)),
                                                  pa.array(size.astype(np.int64))], names=["lang", "h", "var", "size"])

    return materialise(usable.mapInArrow(run, "lang string, h double, var double, size long"))


def medians(rows: DataFrame, values: dict[str, Column]) -> dict[str, dict[str, float]]:
    """{lang: {name: median}} over all rows, to a step of 1/STEPS.

    Two counts, by run of steps and then by step of the runs that hold a middle row: neither holds rows,
    and what reaches the driver depends on the range of the values only."""
    step = {name: F.floor(c * F.lit(STEPS)).cast("long") for name, c in values.items()}
    long = rows.select("lang", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), q.alias("q")) for n, q in step.items()])).alias("e")).select("lang", "e.*")
    coarse: dict[tuple, list] = {}
    for r in long.groupBy("lang", "name", F.floor(F.col("q") / F.lit(RUN)).alias("run")).agg(F.count(F.lit(1)).alias("n")).collect():
        coarse.setdefault((r["lang"], r["name"]), []).append((r["run"], r["n"]))
    wanted = {}  # (lang, name) -> [(run, place within the run)] of the one or two middle rows
    for key, runs in coarse.items():
        runs.sort()
        ends = np.cumsum([n for _, n in runs])
        middle = {(int(ends[-1]) - 1) // 2, int(ends[-1]) // 2}
        at = {k: int(np.searchsorted(ends, k, side="right")) for k in middle}
        wanted[key] = [(runs[i][0], k - (int(ends[i]) - runs[i][1])) for k, i in sorted(at.items())]
    if not wanted:
        return {}
    runs = rows.sparkSession.createDataFrame([(*key, run) for key, w in wanted.items() for run in {r for r, _ in w}], "lang string, name string, run long")
    fine: dict[tuple, list] = {}
    for r in (long.withColumn("run", F.floor(F.col("q") / F.lit(RUN))).join(F.broadcast(runs), ["lang", "name", "run"])
              .groupBy("lang", "name", "run", "q").agg(F.count(F.lit(1)).alias("n")).collect()):
        fine.setdefault((r["lang"], r["name"], r["run"]), []).append((r["q"], r["n"]))
    out: dict[str, dict[str, float]] = {}
    for (lang, name), w in wanted.items():
        found = []
        for run, place in w:
            steps = sorted(fine[lang, name, run])
            found.append(steps[int(np.searchsorted(np.cumsum([n for _, n in steps]), place, side="right"))][0])
        out.setdefault(lang, {})[name] = (float(np.mean(found)) + 0.5) / STEPS
    return out


def calibrate(model: Model, rows: DataFrame) -> None:
    """Median cross-entropy per language with its spread over texts (by the median absolute
    deviation, so foreign texts under a label move it little) and over symbols, over every usable text.

    A language with fewer than LEAST_ROWS usable texts takes the most lenient values of the
    others; if there are none, those of all texts, and without any text those of a uniform code."""
    def values(of: DataFrame) -> dict[str, tuple[float, float, float]]:
        first = medians(of, {"mid": F.col("h"), "var": F.col("var"), "noise": F.col("var") / F.greatest(F.col("size"), F.lit(1))})
        if not first:
            return {}
        mids = of.sparkSession.createDataFrame([(la, v["mid"]) for la, v in first.items()], "lang string, mid double")
        off = medians(of.join(F.broadcast(mids), "lang"), {"off": F.abs(F.col("h") - F.col("mid"))})
        return {la: (v["mid"], max((1.4826 * off[la]["off"]) ** 2 - v["noise"], MIN_SPREAD), v["var"]) for la, v in first.items()}

    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    enough = [la for la, n in counts.items() if n >= LEAST_ROWS]
    known = values(rows.where(F.col("lang").isin(enough))) if enough else {}
    if known:
        pooled = tuple(max(v[k] for v in known.values()) for k in range(3))
    elif counts:
        pooled = values(rows.withColumn("lang", F.lit("")))[""]
    else:
        pooled = (float(np.log(1 << 16)), MIN_SPREAD, 0.0)
    table = np.array([known.get(la, pooled) for la in model.langs], float).reshape(-1, 3)
    model.mean, model.spread, model.noise = table.T.copy()


#: how many spreads above the mean a text may lie before it is rejected
TOLERANCE = 8.0
#: least spread of cross-entropy over texts: mixed-language and repetitive prose is kept
MIN_SPREAD = 0.01


def decide(model: Model, texts: list[str | None]):
    """(language, score, cross-entropy, rejected) per text."""
    n = len(texts)
    if not model.langs or n == 0:
        return [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
    h, _, size = cross_entropies(model, texts)
    best = np.argmin(h, axis=1)
    own = h[np.arange(n), best]
    # the score is the posterior of a text of at most 40 symbols, so long texts do not all score 1
    weight = np.exp(-(h - own[:, None]) * np.minimum(np.maximum(size, 1), 40)[:, None])
    score = 1.0 / weight.sum(axis=1)
    limit = model.mean[best] + TOLERANCE * np.sqrt(model.spread[best] + 2 * model.noise[best] / np.maximum(size, 1))
    none = size == 0
    langs = [UNKNOWN if z else model.langs[b] for z, b in zip(none, best)]
    return langs, np.where(none, 0.0, np.clip(score, 0, 1)), np.where(none, np.nan, own), none | (own > limit)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from all labelled rows of ``df``.

    Counts cover every row and every gram stays, so the broadcast model grows with the
    distinct grams of the corpus.  Thresholds are set per language on every usable text (``measure``)."""
    model = fit(count_grams(df, text_col, lang_col).toArrow())
    if model.langs:
        rows = measure(df, model, lang_col, text_col)
        calibrate(model, rows)
        discard(rows)
    return model


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected`` added
    (columns of those names are replaced)."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "cross_entropy", "rejected")
    # the text travels once: inside the row, unless it is replaced there
    inside = next((c for c in df.columns if c == text_col and c.lower() not in new), None)
    src = df.select(packed_row(df, set(new)).alias("row"), *([] if inside else [F.col(text_col).alias("text")]))
    ddl = "lang_pred string, score double, cross_entropy double, rejected boolean"
    schema = StructType([src.schema.fields[0], *StructType.fromDDL(ddl).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if inside:
                row = batch.column("row")
                batch = pa.RecordBatch.from_arrays([row, row.field(inside)], names=["row", "text"])
            for part in text_slices(batch, "text", SLICE_BYTES):
                langs, score, own, rejected = decide(m, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(own), pa.array(rejected)],
                    names=["row", *new])

    return src.mapInArrow(run, schema).select("row.*", *new)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 modulo 4 (null id: false)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
