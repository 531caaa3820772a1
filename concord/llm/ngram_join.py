"""N-gram Jaccard self-join by parity sketches.

A text's distinct word shingles are XOR-hashed into a bit sketch: every shingle flips one
bit, so the Hamming distance of two sketches is at most the symmetric difference of the
sets.  For sets of one size band a Jaccard of t or more bounds that difference by D; a
sketch of P > D parts then agrees in at least P - D whole parts (pigeonhole), and parts are
joined by value.  Candidates are verified on their sets, links are closed by connected
components.

Part values are ordered by the number of sets that hold them.  A linked pair agrees in s = P - D
values at least, so the rarest of these is not among the last s - 1 of either set: every set is joined on
the others only (a prefix filter).  Empty parts, parts of one shingle and parts filled by a passage of very
many texts are the common ones and fall away; a set with fewer than s shared values has no partner.  No link is lost.
First every set is compared with one central set; then sets that share such values but are not connected yet are
compared tile by tile within such clouds, in tasks that return links and no pairs.

Defined results: null or empty text, and text without words, has no shingles and is its own
component; fewer words than n are one shingle; equal sets are one class whatever their texts;
rows without an id link with nothing and have a null component; rows that share an id and
differ in text take the smallest component of the id's rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.bpe import pack, unpack
from concord.llm.common import connected_components, discard, free_name, give_back, materialise, prepare, shuffle_parts, text_slices
from concord.llm.embedding_dedup import smallest_reachable

SLICE_BYTES = 1 << 19
BAND_RATIO = 1.25
SLACK = 0.3
KEY_BYTES = 6  # of a key are sent to its partition; equal ones by chance are found out on verification
HELD_KEYS = 500_000  # that a task holds before it deals them, and about as many as it sorts at a time
TILE = 256  # sets compared with each other at a time, and shingle columns per product
TILE_COLUMNS = 1 << 14
MAX_BAND = 150  # BAND_RATIO ** 150 shingles are beyond any text
SEED = 7_919

_U = np.uint64


@functools.cache
def _byte_values() -> np.ndarray:
    """Random value per byte after lower-casing A-Z; white space counts nothing."""
    values = np.random.Generator(np.random.Philox(key=SEED)).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    values[[32, 9, 10, 11, 12, 13]] = 0
    return values


_POWERS: list[np.ndarray] = []
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    data = np.frombuffer("\n".join("" if t is None else t for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
    sizes = np.fromiter((0 if t is None else len(t.encode("utf-8", "surrogatepass")) if not t.isascii() else len(t) for t in texts),
                        np.int64, len(texts))
    edge = np.cumsum(sizes + 1)
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * len(texts)
    values = _byte_values()[data]
    word = values != 0
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    if not len(starts):
        return [none] * len(texts)
    power, inverse = _powers(len(data))
    values *= power[:len(data)]
    words = _mix(np.add.reduceat(values, starts) * inverse[starts])
    doc = np.searchsorted(edge, starts, side="right")
    per = np.bincount(doc, minlength=len(texts))
    # a shingle begins at every word that has n - 1 words after it in its text
    sums = np.zeros(len(words), np.uint64)
    count = len(words) - n + 1
    if count > 0:
        for k in range(n):
            sums[:count] = sums[:count] * _U(0xD6E8FEB86659FD93) + words[k:k + count]
        valid = np.zeros(len(words), bool)
        valid[:count] = doc[:count] == doc[n - 1:]
    else:
        valid = np.zeros(len(words), bool)
    hashes, owner = _mix(sums[valid]), doc[valid]
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        whole = []
        for d in short:
            h = int(per[d])
            for w in words[first[d]:first[d] + per[d]].tolist():
                h = (h * 0xC2B2AE3D27D4EB4F + w) & (1 << 64) - 1
            whole.append(h)
        hashes = np.concatenate([hashes, _mix(np.array(whole, np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    hashes = hashes[order]
    cuts = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return [np.unique(hashes[a:b]) if b > a else none for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts)]


def set_id(s: np.ndarray) -> int:
    """64-bit identity of a set (signed)."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_of(size: int) -> int:
    g = int(math.log(size) / math.log(BAND_RATIO))
    while BAND_RATIO ** (g + 1) <= size:
        g += 1
    while BAND_RATIO ** g > size:
        g -= 1
    return g


@functools.cache
def band_shape(g: int, num: int, den: int) -> tuple[int, int]:
    """(P, D): parts of a band's sketches, and the largest symmetric difference of a linked
    pair whose larger set lies in the band.

    P exceeds D by a slack, so that a linked pair agrees in P - D parts at least."""
    most = math.ceil(BAND_RATIO ** (g + 1)) - 1
    d = (den - num) * 2 * most // (den + num)
    return d + 2 + math.ceil(SLACK * d), d


def sketch_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of the set of each key): part values of every set in the bands that a
    larger or equal partner may lie in.  The last eight bits of a key are the band."""
    jobs = []
    for i, s in enumerate(sets):
        if len(s):
            jobs += [(i, g) for g in range(band_of(len(s)), band_of(max(len(s), len(s) * den // num)) + 1)
                     if band_shape(g, num, den)[1]]  # D = 0: only equal sets link
    if not jobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.array([i for i, _ in jobs])
    band = np.array([g for _, g in jobs], np.uint64)
    shape = np.array([band_shape(g, num, den) for _, g in jobs], np.int64)
    parts = shape[:, 0]
    base = np.cumsum(parts) - parts
    length = np.array([len(sets[i]) for i, _ in jobs])
    tokens = np.concatenate([sets[i] for i, _ in jobs])
    spread = _mix(tokens + _U(SEED))
    cell = np.repeat(base, length) + ((spread >> _U(8)) % np.repeat(parts, length).astype(np.uint64)).astype(np.int64)
    total = int(parts.sum())
    sketch = np.zeros(total, np.uint64)
    # a part is a sparse bit sketch as wide as the hashes: every shingle flips the bit of its
    # hash, and what is kept is the XOR of one random word per set bit, which tells parts apart
    np.bitwise_xor.at(sketch, cell, _mix(tokens * _U(0xD6E8FEB86659FD93) + _U(1)))
    number = np.arange(total) - np.repeat(base, parts)
    bands = np.repeat(band, parts)
    value = _mix(_mix(sketch + _U(1)) + number.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + bands)
    return (value << _U(8)) | bands, np.repeat(owner, parts)


FOUND = "doc_id long, text_hash long, n long, sid long, key long, size long, band int"


def _sketch(src: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """One table of two kinds of rows: (doc_id, n, sid) per document, and (key, sid, size,
    band) for every part value that two sets share at least."""
    schema = pa.schema([("part", pa.int32()), ("docs", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int64())), ("sids", pa.binary()), ("keys", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task send their keys once
        held, kept = [], 0
        at = 0

        def flush():
            keys = np.concatenate([k for k, _ in held])
            sids = np.concatenate([s for _, s in held])
            to = (keys >> _U(8 * KEY_BYTES)) % _U(parts)  # bits that are not sent
            order = np.argsort(to, kind="stable")
            keys, sids = keys[order], sids[order]
            ends = np.cumsum(np.bincount(to.astype(np.int64), minlength=parts))
            for p in range(parts):
                lo = ends[p - 1] if p else 0
                if ends[p] > lo:
                    by = np.argsort(sids[lo:ends[p]], kind="stable")  # equal sids together, for compression
                    yield pa.RecordBatch.from_pylist([{"part": p, "sids": pack(sids[lo:ends[p]][by]),
                                                       "keys": _cut_bytes(keys[lo:ends[p]][by], KEY_BYTES)}], schema=schema)

        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                sids = [set_id(s) for s in sets]
                ids = part.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_pylist([{"part": at % parts, "docs": ids, "hashes": part.column("text_hash").to_pylist(), "sizes": [len(s) for s in sets],
                                                   "sids": pack(np.array(sids, np.int64))}], schema=schema)
                at += 1
                fresh = []
                for k, (doc, sid) in enumerate(zip(ids, sids)):
                    if doc is not None and sid not in seen:
                        seen.add(sid)
                        fresh.append(k)
                keys, own = sketch_keys([sets[k] for k in fresh], num, den)
                if len(keys):
                    held.append((keys, np.array([sids[k] for k in fresh], np.int64)[own]))
                    kept += len(keys)
                if kept > HELD_KEYS:
                    yield from flush()
                    held, kept = [], 0
        if held:
            yield from flush()
        held.clear()
        give_back()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        types = [{"int": pa.int32()}.get(f.split()[1], pa.int64()) for f in FOUND.split(", ")]
        keys, sids = [], []

        def rows(length, **cols):
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[c], t) if c in cols else pa.nulls(length, t) for c, t in zip(names, types)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                own = unpack(r["sids"], np.int64)
                if r["keys"] is None:
                    yield rows(len(own), doc_id=r["docs"], text_hash=r["hashes"], n=r["sizes"], sid=own)
                else:
                    keys.append(_from_bytes(r["keys"], KEY_BYTES) | _U(r["part"] << 8 * KEY_BYTES))
                    sids.append(own)
        # some of the keys at a time: a key's rows are all in one run, and sorting takes several times its arrays
        runs = -(-sum(len(k) for k in keys) // HELD_KEYS)
        for run in range(runs):
            mine = [(k >> _U(8)) % _U(runs) == _U(run) for k in keys]
            key, sid = np.concatenate([k[m] for k, m in zip(keys, mine)]), np.concatenate([s[m] for s, m in zip(sids, mine)])
            if not len(key):
                continue
            order = np.lexsort((sid, key))
            key, sid = key[order], sid[order]
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
            key, sid = key[first], sid[first]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(head, len(key)))
            size = np.repeat(size, size)
            key, sid, size = key[size > 1], sid[size > 1], size[size > 1]
            for lo in range(0, len(key), 100_000):
                k = key[lo:lo + 100_000]
                yield rows(len(k), key=k.view(np.int64), sid=sid[lo:lo + 100_000], size=size[lo:lo + 100_000],
                           band=(k & _U(255)).astype(np.int32))
        give_back()

    return (src.mapInArrow(sketch, "part int, docs array<long>, hashes array<long>, sizes array<long>, sids binary, keys binary")
            .repartitionById(parts, F.col("part")).mapInArrow(share, FOUND))


def _joined_keys(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(key, sid, size): the part values on which each set is joined, all of its shared values in a band but the
    P - D - 1 most common ones, as far as another set is joined on them too."""
    slack = F.element_at(F.lit([p - d for p, d in (band_shape(g, num, den) for g in range(MAX_BAND))]), F.col("band") + 1)
    own = Window.partitionBy("sid", "band")  # at most P values
    kept = (shared.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("place", F.row_number().over(own.orderBy("size", "key")))
            .where(F.col("place") <= F.col("n") - slack + 1).select("key", "sid"))
    held = kept.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return kept.join(held, "key").select("key", "sid", "size")


def _texts_of(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, body) of the wanted sets: one text of each, compressed (a third of its set)."""

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())],
                names=["doc_id", "text_hash", "body"])

    moved = src.mapInArrow(squeeze, "doc_id long, text_hash long, body binary")
    return moved.join(wanted, ["doc_id", "text_hash"]).select("sid", "body")


def _verify(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, common, either): sizes of intersection and union of every pair, from the
    shingles of both texts."""
    z = zstandard

    def run(batches):
        open_ = z.ZstdDecompressor()

        def shingles(bodies):
            return shingle_sets([open_.decompress(b).decode("utf-8", "surrogatepass") for b in bodies], n)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                common, either = [], []
                for u, v in zip(shingles(part.column(2).to_pylist()), shingles(part.column(3).to_pylist())):
                    merged = np.concatenate([u, v])
                    merged.sort()
                    same = int((merged[1:] == merged[:-1]).sum())
                    common.append(same)
                    either.append(len(merged) - same)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(common, pa.int64()), pa.array(either, pa.int64())],
                                                 names=["a", "b", "common", "either"])

    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(run, "a long, b long, common long, either long"))


def linked_rows(x: list[np.ndarray], y: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of all pairs of sets with den * |x & y| >= num * |x | y|.

    Intersections of all pairs are counted at once, by products of 0/1 columns of the
    shingles that both sides hold, some columns at a time."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
    flat = [np.concatenate(side) for side in (x, y)]
    owner = [np.repeat(np.arange(len(side)), n) for side, n in zip((x, y), sizes)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(x), len(y)), np.int64)
    column = [np.searchsorted(shared, f) for f in flat]
    held = [c < len(shared) for c in column]
    if len(shared):
        held = [h & (shared[np.minimum(c, len(shared) - 1)] == f) for h, c, f in zip(held, column, flat)]
    order = [np.argsort(c[h], kind="stable") for c, h in zip(column, held)]
    column = [c[h][o] for c, h, o in zip(column, held, order)]
    owner = [w[h][o] for w, h, o in zip(owner, held, order)]
    for lo in range(0, len(shared), TILE_COLUMNS):
        width = min(TILE_COLUMNS, len(shared) - lo)
        sides = []
        for c, w, n in zip(column, owner, (len(x), len(y))):
            a, z = np.searchsorted(c, [lo, lo + width])
            m = np.zeros((n, width), np.float32)
            m[w[a:z], c[a:z] - lo] = 1
            sides.append(m)
        common += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    either = sizes[0][:, None] + sizes[1][None, :] - common
    return np.nonzero((common > 0) & (den * common >= num * either))


def _links_in_clouds(cloud: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): links between sets of one cloud, as stars.

    Clouds are salted into tiles of about TILE sets; every pair of tiles of a cloud is one
    task's work of bounded size, whatever the cloud's."""
    home = ["cloud", "band"]
    # linked sets differ in size by the threshold at most, so only neighbouring bands meet
    cloud = materialise(cloud.withColumn("band", F.floor(F.log("size") / F.lit(math.log(den / num) + 1e-9)).cast("int")
                                         if num < den else F.col("size").cast("int")))
    salts = materialise(cloud.groupBy(*home).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("salts")))
    tile = F.concat_ws(":", *[F.col(c).cast("string") for c in (*home, "salt")]).alias("tile")
    placed = (cloud.join(salts, home).withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"))
              .select("sid", tile).join(texts, "sid"))

    def bundle(table: pa.Table) -> pa.Table:
        return pa.table({"tile": table.column("tile").slice(0, 1),
                         "sids": pa.array([table.column("sid").to_pylist()], pa.list_(pa.int64())),
                         "bodies": pa.array([table.column("body").to_pylist()], pa.list_(pa.binary()))})

    tiles = materialise(placed.select("tile", "sid", "body").groupBy("tile").applyInArrow(bundle, "tile string, sids array<long>, bodies array<binary>"))
    index = salts.select(*home, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(*home, "salt", tile)
    reach = index.select("cloud", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("from"), "salt", "tile")
    pairs = (reach.join(index.toDF(*home, "salt2", "tile2"), home).where((F.col("from") != F.col("band")) | (F.col("salt") <= F.col("salt2")))
             .select(F.concat("tile", F.lit("|"), "tile2").alias("pair"), F.explode(F.array(
                 F.struct(F.lit(0).alias("side"), F.col("tile").alias("tile")),
                 F.struct(F.lit(1).alias("side"), F.col("tile2").alias("tile")))).alias("s")).select("pair", "s.side", "s.tile"))

    def compare(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        rows = sorted(table.to_pylist(), key=lambda r: r["side"])
        sets = {r["tile"]: shingle_sets([open_.decompress(b).decode("utf-8", "surrogatepass") for b in r["bodies"]], n) for r in rows}
        i, j = linked_rows(sets[rows[0]["tile"]], sets[rows[-1]["tile"]], num, den)
        same = rows[0]["tile"] == rows[-1]["tile"]
        names = np.array(rows[0]["sids"] if same else [*rows[0]["sids"], *rows[-1]["sids"]], np.int64)
        root = smallest_reachable(len(names), i, j if same else j + len(rows[0]["sids"]))
        hit = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": pa.array(names[hit]), "b": pa.array(names[root[hit]])})

    return pairs.join(tiles, "tile").groupBy("pair").applyInArrow(compare, "a long, b long")


def _cut_bytes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of every value."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                   num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) per row: components of the links
    ``den * |A & B| >= num * |A | B|``."""
    if not 0 < num <= den:
        raise ValueError("the threshold must lie in (0, 1]")
    spark = df.sparkSession
    prepare(spark)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    found = materialise(_sketch(src, n, num, den, shuffle_parts(spark)))
    docs = materialise(found.where("key is null").select("doc_id", "text_hash", "n", "sid"))
    classes = materialise(docs.where("doc_id is not null and n > 0").groupBy("sid")
                          .agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.max("n").alias("n")))

    members = _joined_keys(found.where("key is not null").select("key", "sid", "size", "band"), num, den)
    central = members.groupBy("sid").agg(F.sum("size").alias("weight"))
    members = materialise(members.select("key", "sid").join(central, "sid"))
    discard(found)
    wanted = members.select("sid").distinct().join(classes, "sid").select(F.col("rep").alias("doc_id"), "text_hash", "sid")
    texts = materialise(_texts_of(src, wanted).dropDuplicates(["sid"]))

    linked = F.col("common") * den >= F.col("either") * num
    # first every set against one pivot: a bucket's pivot is its most central set, a set's is
    # the most central of its buckets' pivots
    rank = F.struct("weight", (-F.col("sid")).alias("tie"))
    pivots = materialise(members.groupBy("key").agg(F.max(rank).alias("rank")))
    pairs = (members.select("key", "sid").join(pivots, "key").groupBy("sid").agg(F.max("rank").alias("rank"))
             .select(F.col("sid").alias("a"), (-F.col("rank.tie")).alias("b")).where("a <> b"))
    got = materialise(_verify(pairs, texts, n))
    comp = materialise(connected_components(got.where(linked)))
    # then all that is still open: sets of different components that share a part value.  Such
    # sets are compared tile by tile in tasks, which return links as stars and never pairs
    state = materialise(members.select("key", "sid").join(comp.withColumnRenamed("node", "sid"), "sid", "left")
                        .select("key", "sid", F.coalesce("component", "sid").alias("comp")))
    open_keys = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("sid").alias("head")).where("lo < hi")
    cloud = materialise(connected_components(
        state.join(open_keys, "key").select(F.col("sid").alias("a"), F.col("head").alias("b")).distinct()))
    sized = cloud.toDF("sid", "cloud").join(classes.select("sid", F.col("n").alias("size")), "sid")
    more = _links_in_clouds(sized, texts, n, num, den)
    comp = materialise(connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    discard(texts, members, pivots, state, got, cloud)  # what is left lazy reads docs, classes and comp
    named = materialise(classes.join(comp, F.col("sid") == F.col("node"), "left")
                        .select("sid", "rep", F.coalesce("component", "sid").alias("comp")))
    # written, so that the join of a large component may be split
    lowest = materialise(named.groupBy("comp").agg(F.min("rep").alias("component_id")))
    per_set = materialise(named.join(lowest, "comp").select("sid", "component_id"))
    out = (docs.join(per_set, "sid", "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(),
                                              F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                         num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` that stand for their group: one row of each component, one with its smallest id.

    Rows, not ids, are compared: a row without an id takes part and goes if a row with an id is in
    its group; of repeated rows one stays; rows that share an id and differ in text stand for themselves.  Rows without
    words all stay."""
    row = free_name(df, "row")
    numbered = materialise(df.withColumn(row, F.monotonically_increasing_id()))
    groups = materialise(jaccard_groups(numbered, row, text_col, n, num, den).select(F.col(row).alias("r"), F.col("component_id").alias("c")))
    known = numbered.select(F.col(row).alias("r"), F.col(f"`{id_col}`").alias("i"))
    first = F.min(F.struct(F.col("i").isNull().alias("none"), "i", "r"))
    stays = materialise(groups.join(known, "r").groupBy("c").agg(first.alias("f")).select("c", F.col("f.r").alias("stays")))
    gone = materialise(groups.join(stays, "c").where("r <> stays").select(F.col("r").alias(row)))
    discard(groups, stays)
    return numbered.join(gone, row, "left_anti").drop(row)
