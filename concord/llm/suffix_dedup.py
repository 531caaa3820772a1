"""Removal of repeated byte strings by a column-wise suffix order of the collection.

A byte goes when it is covered by a string of ``WINDOW`` bytes that also starts earlier (a
smaller document, or earlier in the same one); strings are judged on the input.

1. Every string of WINDOW bytes is assigned to the smallest hash of its k-grams (its
   minimiser); neighbours with the same minimiser form a segment.  Equal strings have equal
   minimisers, so segments are dealt over partitions by it, and no match is lost.  K-grams
   that fill much of the corpus (found on a bounded sample, which steers only where work is
   done) are avoided as minimisers, so a common passage in many contexts is spread by its
   contexts.
2. Equal segments become one, in the task that cuts them and again where they meet: all
   their places but the first are repeats as a whole.
3. A string that two different segments share holds their minimiser at one place, and CONTEXT bytes after it
   or before it; a segment that has neither in common with another one of its minimiser shares nothing and goes
   no further.  The others are sorted as a collection, column by column
   (``collection_bwt``), with common prefixes; a run of suffixes with WINDOW common bytes is
   one repeated string, whose first place stays.  The columns of a batch of segments are
   held in memory (batches are bounded; a batch is never larger than one minimiser's
   segments), so nothing is written to a task's own disk.
4. Repeated ranges and the compressed texts meet by document.

Defined results: null text counts as empty; texts shorter than WINDOW lose nothing; rows
without an id come last; rows that share an id are ordered by a hash of their text; equal rows
(id and text) are one document and all get the same result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.bpe import pack, ragged, unpack
from concord.llm.collection_bwt import collection_order
from concord.llm.common import prepare, shuffle_parts, text_slices

WINDOW = 100
GRAM = 26
REACH = WINDOW - GRAM + 1  # k-grams in a string
CONTEXT = (WINDOW - GRAM) // 2  # bytes beside the minimiser that a shared string has on one side at least
MOST = 128  # strings per segment, so segments stay below 256 bytes
SLICE_BYTES = 2 << 20
HELD_BYTES = 16 << 20  # texts whose segments a task deals out at a time
BATCH_BYTES = 1 << 19
SAMPLE_ROWS = 1000
HOT_SHARE = 0.02
LAST_ID = (1 << 63) - 1

_U = np.uint64
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_TABLES: dict = {}


def _tables(n: int):
    size = max(n + 1, SLICE_BYTES * 2)
    if len(_TABLES.get("power", ())) < size:
        _TABLES["byte"] = np.random.Generator(np.random.Philox(key=97)).integers(1, 1 << 63, 256, dtype=np.uint64)
        for name, b in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            _TABLES[name] = np.cumprod(np.full(size, b, np.uint64))
    return _TABLES["byte"], _TABLES["power"], _TABLES["inverse"]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(31)
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    byte, power, inverse = _tables(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * power[:len(data)], out=out[1:])
    return out, inverse


def gram_hashes(sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of the k-gram at every position, its top bit clear."""
    h = sums[GRAM:] - sums[:-GRAM]
    h *= inverse[:len(h)]
    return _mix(h) >> _U(1)


class Hot:
    """The k-grams avoided as minimisers, with a bitmap that rules most others out."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(self.hashes & _U(0xFFFF)).astype(np.int64)] = True

    def raise_in(self, h: np.ndarray) -> None:
        """Set the top bit of hot hashes, so that any other is smaller."""
        if len(self.hashes):
            at = np.flatnonzero(self.bitmap[(h & _U(0xFFFF)).astype(np.int64)])
            found = np.searchsorted(self.hashes, h[at])
            at = at[self.hashes[np.minimum(found, len(self.hashes) - 1)] == h[at]]
            h[at] |= _U(1 << 63)


def _sliding(least, h: np.ndarray) -> np.ndarray:
    """``least`` (a minimum or maximum) over every REACH neighbours."""
    span = 1
    while span * 2 <= REACH:
        h = least(h[:-span], h[span:])
        span *= 2
    return least(h[:len(h) - (REACH - span)], h[REACH - span:])


def segments(data: np.ndarray, ends: np.ndarray, hot: Hot):
    """(minimiser, content hash, text number, start in data, strings, whether it may repeat
    itself, place of the minimiser in it) of every segment of the texts that end at ``ends`` in ``data``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(bool), none
    sums, inverse = _sums(data)
    grams = gram_hashes(sums, inverse)
    hot.raise_in(grams)
    low = _sliding(np.minimum, grams)
    count = len(low)  # a string of WINDOW bytes begins at each of these positions
    # a segment can repeat itself only if its minimiser lies in it twice: find k-grams that
    # are a minimiser at two places of which one string of a segment can hold both
    edge = np.full(REACH - 1, 0, np.uint64)
    minima = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, low, edge])) == grams)
    chosen = minima[np.lexsort((minima, grams[minima]))]
    close = (grams[chosen][1:] == grams[chosen][:-1]) & (np.diff(chosen) <= REACH)
    double = np.unique(grams[chosen][1:][close])
    sizes = np.diff(ends, prepend=0)
    first = ends - sizes
    valid = np.zeros(count + 1, bool)
    begin, stop = np.minimum(first, count), np.minimum(np.maximum(ends - WINDOW + 1, first), count)
    step = np.zeros(count + 1, np.int8)
    np.add.at(step, begin, 1)
    np.add.at(step, stop, -1)
    valid = np.cumsum(step, dtype=np.int8)[:count] > 0
    cut = np.ones(count, bool)
    cut[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    cut[begin[begin < count]] = True
    start = np.flatnonzero(cut & valid)
    over = np.ones(count, bool)
    over[:-1] = cut[1:] | ~valid[1:]
    strings = np.flatnonzero(over & valid) + 1 - start
    if len(strings) and strings.max() > MOST:
        pieces = -(-strings // MOST)
        nth = ragged(np.zeros(len(pieces), np.int64), pieces)
        whole = np.repeat(strings, pieces)
        start = np.repeat(start, pieces) + nth * MOST
        strings = np.minimum(whole - nth * MOST, MOST)
    content = _mix((sums[start + strings + WINDOW - 1] - sums[start]) * inverse[start])
    found = low[start]
    twice = np.zeros(len(found), bool)
    if len(double):
        twice = double[np.minimum(np.searchsorted(double, found), len(double) - 1)] == found
    # the minimiser lies in every string of its segment, so from the start of the last one on
    at = np.searchsorted(minima, np.minimum(start + strings - 1, minima[-1]))
    open_ = np.flatnonzero(~twice & (grams[minima[at]] != found))
    while len(open_):
        at[open_] += 1
        open_ = open_[grams[minima[at[open_]]] != found[open_]]
    middle = np.where(twice, 0, minima[at] - start)
    return found, content, np.searchsorted(ends, start, side="right"), start, strings, twice, middle


CUT = "part int, ids array<long>, keys array<long>, head binary, gone binary, body binary"
CUT_SCHEMA = pa.schema([("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
                        ("head", pa.binary()), ("gone", pa.binary()), ("body", pa.binary())])
RANGE = "part int, doc_id long, key long, ids array<long>, keys array<long>, head binary, body binary"
RANGE_SCHEMA = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())),
                          ("keys", pa.list_(pa.int64())), ("head", pa.binary()), ("body", pa.binary())])


def _columns(*arrays) -> bytes:
    """Equally long integer columns as one blob."""
    return b"".join(len(b).to_bytes(4, "little") + b for b in (pack(np.ascontiguousarray(a)) for a in arrays))


def _uncolumns(blob: bytes, *dtypes) -> list[np.ndarray]:
    out, at = [], 0
    for dtype in dtypes:
        size = int.from_bytes(blob[at:at + 4], "little")
        out.append(unpack(blob[at + 4:at + 4 + size], dtype))
        at += 4 + size
    return out


def _cut(batches: Iterator[pa.RecordBatch], hot: Hot, parts: int) -> Iterator[pa.RecordBatch]:
    """Segments of the texts, packed per partition for about HELD_BYTES of texts at a time; repeats among these
    travel as places only."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for part in text_slices(batch, "text", SLICE_BYTES):
            rows = {k: (i, t) for i, k, t in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(),
                                                 part.column("text").to_pylist()) if t}
            if not rows:
                continue
            texts = [t.encode("utf-8", "surrogatepass") for _, t in rows.values()]
            raw = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            found = segments(np.frombuffer(raw, np.uint8), ends, hot)
            if not len(found[0]):
                continue
            ids = np.array([LAST_ID if i is None else i for i, _ in rows.values()], np.int64)
            held.append((raw, ends, ids, np.array(list(rows), np.int64), found))
            size += len(raw)
            if size >= HELD_BYTES:
                yield _dealt(held, parts)
                held, size = [], 0
    if held:
        yield _dealt(held, parts)


def _dealt(held: list[tuple], parts: int) -> pa.RecordBatch:
    raw = b"".join(h[0] for h in held)
    shift = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
    docs = np.cumsum([0, *[len(h[1]) for h in held[:-1]]])
    ends = np.concatenate([h[1] + at for h, at in zip(held, shift)])
    ids, keys = (np.concatenate([h[k] for h in held]) for k in (2, 3))
    low, content, strings, twice, middle = (np.concatenate([h[4][k] for h in held]) for k in (0, 1, 4, 5, 6))
    text = np.concatenate([h[4][2] + at for h, at in zip(held, docs)])
    start = np.concatenate([h[4][3] + at for h, at in zip(held, shift)])
    place = start - (ends - np.diff(ends, prepend=0))[text]
    # earliest place first, so the first of equal segments is the one that stays
    order = np.lexsort((place, keys[text], ids[text], content))
    twin = np.zeros(len(order), bool)
    same = content[order][1:] == content[order][:-1]
    head = order[np.concatenate([[True], ~same])]
    leader = np.repeat(head, np.diff(np.append(np.flatnonzero(np.concatenate([[True], ~same])), len(order))))
    for at in np.flatnonzero(leader != order):
        s, b = order[at], leader[at]
        n = int(strings[s]) + WINDOW - 1
        twin[s] = strings[s] == strings[b] and raw[start[s]:start[s] + n] == raw[start[b]:start[b] + n]
    to = (low % _U(parts)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    lows = np.searchsorted(to[by], np.arange(parts + 1))
    out = []
    data = np.frombuffer(raw, np.uint8)
    z = zstandard.ZstdCompressor(level=3)
    for p in np.flatnonzero(np.diff(lows)).tolist():
        own = by[lows[p]:lows[p + 1]]
        used = np.unique(text[own])
        number = np.searchsorted(used, text[own]).astype(np.uint32)
        g, k = twin[own], ~twin[own]
        kept = own[k]
        body = data[ragged(start[kept], strings[kept] + WINDOW - 1)].tobytes()
        out.append({"part": p, "ids": ids[used], "keys": keys[used],
                    "head": _columns(number[k], place[kept].astype(np.uint32), strings[kept].astype(np.uint8), twice[kept].astype(np.uint8),
                                     middle[kept].astype(np.uint8), (low[kept] // _U(parts)).astype(np.uint32)),
                    "gone": _columns(number[g], place[own[g]].astype(np.uint32), strings[own[g]].astype(np.uint8)),
                    "body": z.compress(body)})
    return pa.RecordBatch.from_pylist(out, schema=CUT_SCHEMA)


def _in_common(texts: list[bytes], middle: list[int], group: list[int]) -> np.ndarray:
    """Which distinct segments share the bytes after or before their minimiser with another one."""
    seen: dict[tuple, int] = {}
    fits = np.zeros(len(texts), bool)
    for k, (text, at, g) in enumerate(zip(texts, middle, group)):
        sides = [(g, True, text[at:at + GRAM + CONTEXT])] if len(text) >= at + GRAM + CONTEXT else []
        if at >= CONTEXT:
            sides.append((g, False, text[at - CONTEXT:at + GRAM]))
        for side in sides:
            first = seen.setdefault(side, k)
            if first != k:
                fits[first] = fits[k] = True
    return fits


def _repeats(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Repeated ranges among the segments of one partition, packed per partition of
    documents."""
    ids, keys, bodies, cols, gone, blob_no, docs = [], [], [], [], [], [], 0
    for batch in batches:
        for r in batch.to_pylist():
            number, place, strings, twice, middle, group = _uncolumns(r["head"], np.uint32, np.uint32, np.uint8, np.uint8, np.uint8, np.uint32)
            cols.append((number.astype(np.int64) + docs, place.astype(np.int64), strings.astype(np.int64), group, twice > 0, middle))
            blob_no.append(np.full(len(number), len(bodies)))
            number, place, strings = _uncolumns(r["gone"], np.uint32, np.uint32, np.uint8)
            gone.append((number.astype(np.int64) + docs, place.astype(np.int64), place + strings.astype(np.int64) + WINDOW - 1))
            bodies.append(r["body"])
            ids.append(np.array(r["ids"], np.int64))
            keys.append(np.array(r["keys"], np.int64))
            docs += len(r["ids"])
    if not bodies:
        return
    ids, keys = np.concatenate(ids), np.concatenate(keys)
    doc, place, strings, group, twice, middle = (np.concatenate(x) for x in zip(*cols))
    blob = np.concatenate(blob_no)
    out_doc, out_from, out_to = ([np.concatenate(x)] for x in zip(*gone))
    # documents in order, equal ones sharing a rank
    order = np.lexsort((keys, ids))
    new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])])
    rank = np.empty(docs, np.int64)
    rank[order] = np.cumsum(new)
    value = (rank[doc] << 32) | place
    # segments of a minimiser that occurs once cannot repeat, unless they repeat themselves
    by = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))
    size = np.diff(np.append(edge, len(by)))
    many = np.zeros(len(by), bool)
    many[by] = np.repeat(size > 1, size)
    many |= twice
    # bytes of those segments, one compressed block at a time; equal segments become one
    content: dict[tuple[int, bytes], int] = {}
    texts: list[bytes] = []
    which = np.full(len(many), -1)
    for b, body in enumerate(bodies):
        own = np.flatnonzero((blob == b))
        if not many[own].any():
            continue
        raw = zstandard.ZstdDecompressor().decompress(body)
        length = strings[own] + WINDOW - 1
        at = np.cumsum(length) - length
        pick = many[own]
        for s, o, n, g in zip(own[pick].tolist(), at[pick].tolist(), length[pick].tolist(), group[own[pick]].tolist()):
            text = raw[o:o + n]
            k = content.setdefault((g, text), len(texts))
            if k == len(texts):
                texts.append(text)
            which[s] = k
    seen = np.flatnonzero(which >= 0)
    seen = seen[np.lexsort((value[seen], which[seen]))]
    lead = np.concatenate([[True], which[seen][1:] != which[seen][:-1]]) if len(seen) else np.zeros(0, bool)
    leader = seen[lead]  # first place of every distinct segment, in order of its number
    first = np.repeat(value[leader], np.diff(np.append(np.flatnonzero(lead), len(seen)))) if len(seen) else value[:0]
    late = seen[value[seen] != first]
    out_doc.append(doc[late])
    out_from.append(place[late])
    out_to.append(place[late] + strings[late] + WINDOW - 1)
    # minimisers with several different segments: sort each batch as a collection
    kind = group[leader]
    # a segment that may repeat itself has its minimiser at several places: its whole group is sorted
    fits = _in_common(texts, middle[leader].tolist(), kind.tolist()) | np.isin(kind, kind[twice[leader]])
    order = np.flatnonzero(fits)
    order = order[np.argsort(kind[order], kind="stable")]
    edge = np.append(np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1]])), len(order)) if len(order) else np.zeros(1, np.int64)
    held: list[int] = []
    held_bytes = 0

    def sort_held():
        length = np.array([len(texts[k]) for k in held], np.int64)
        start = np.cumsum(length) - length
        suffix, prefix = collection_order(np.frombuffer(b"".join(texts[k] for k in held), np.uint8), start, length, WINDOW)
        own, left = suffix >> 8, suffix & 255
        run = np.cumsum(prefix < WINDOW)
        full = left >= WINDOW
        own, offset, run = own[full], length[own[full]] - left[full], run[full]
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        seg = leader[np.array(held)[own]]
        v = value[seg] + offset
        earliest = np.repeat(np.minimum.reduceat(v, begin), np.diff(np.append(begin, len(v))))
        again = np.flatnonzero(v != earliest)
        again = again[np.lexsort((offset[again], own[again]))]
        if len(again):
            s, o = seg[again], offset[again]
            brk = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)])
            a, z = np.flatnonzero(brk), np.append(np.flatnonzero(brk)[1:], len(s)) - 1
            out_doc.append(doc[s[a]])
            out_from.append(place[s[a]] + o[a])
            out_to.append(place[s[a]] + o[z] + WINDOW)

    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi - lo < 2 and not twice[leader[order[lo]]]:
            continue
        group_texts = order[lo:hi].tolist()
        n = sum(len(texts[k]) for k in group_texts)
        if held and held_bytes + n > BATCH_BYTES:
            sort_held()
            held, held_bytes = [], 0
        held += group_texts
        held_bytes += n
    if held:
        sort_held()
    d, a, z = (np.concatenate(x) for x in (out_doc, out_from, out_to))
    if not len(d):
        return
    to = np.mod(keys[d], parts)
    by = np.lexsort((a, d, to))
    lows = np.searchsorted(to[by], np.arange(parts + 1))
    rows = []
    for p in range(parts):
        own = by[lows[p]:lows[p + 1]]
        if len(own):
            used, number = np.unique(d[own], return_inverse=True)
            rows.append({"part": p, "ids": ids[used], "keys": keys[used],
                         "head": _columns(number.astype(np.uint32), a[own].astype(np.uint32), (z - a)[own].astype(np.uint32))})
    yield pa.RecordBatch.from_pylist(rows, schema=RANGE_SCHEMA)


def removed_mask(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    return np.cumsum(step)[:n] > 0


def hot_grams(src: DataFrame, rows: int) -> np.ndarray:
    """K-grams held by more than HOT_SHARE of a bounded random sample of ``SAMPLE_ROWS``
    texts.  They steer where work is done and change no result."""
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))

    def run(batches):
        held = [np.zeros(0, np.uint64)]
        texts = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                data = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
                texts += 1
                if len(data) >= GRAM:
                    held.append(np.unique(gram_hashes(*_sums(data))))
        found, n = np.unique(np.concatenate(held), return_counts=True)
        found = found[n >= max(HOT_SHARE * texts, 8)]
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    sample = src.select("text").sample(False, share, seed=11).repartition(1)  # the sampled texts only
    return np.array([r["h"] for r in sample.mapInArrow(run, "h long").collect()], np.int64).view(np.uint64)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", emit: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans, and the remaining bytes as
    ``kept`` (binary: a cut may part a character) or, with ``emit='digest'``, their sha256."""
    spark = df.sparkSession
    prepare(spark)
    parts = shuffle_parts(spark)
    src = (df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
           .withColumn("key", F.xxhash64("doc_id", "text")))
    hot = spark.sparkContext.broadcast(hot_grams(src, src.count()))

    def cut(batches):
        return _cut(batches, Hot(hot.value), parts)

    def meet(batches):
        return _repeats(batches, parts)

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            key = batch.column("key").to_numpy()
            body = [z.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            none = pa.nulls(len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.mod(key, parts).astype(np.int32)), batch.column("doc_id"), batch.column("key"), none.cast(pa.list_(pa.int64())),
                 none.cast(pa.list_(pa.int64())), none.cast(pa.binary()), pa.array(body, pa.binary())], schema=RANGE_SCHEMA)

    digest = emit == "digest"
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                            ("kept", pa.string() if digest else pa.binary())])

    def finish(batches):
        ranges: dict[int, list] = {}
        waiting = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] is not None:
                    waiting.append((r["doc_id"], r["key"], r["body"]))
                    continue
                number, start, size = _uncolumns(r["head"], np.uint32, np.uint32, np.uint32)
                edge = np.searchsorted(number, np.arange(len(r["keys"]) + 1))
                for k, key in enumerate(r["keys"]):
                    s = start[edge[k]:edge[k + 1]].astype(np.int64)
                    ranges.setdefault(key, []).append((s, s + size[edge[k]:edge[k + 1]]))
        z = zstandard.ZstdDecompressor()
        rows = []
        for doc, key, body in waiting:
            raw = z.decompress(body)
            gone = np.zeros(len(raw), bool)
            if key in ranges:
                gone = removed_mask(len(raw), *(np.concatenate(x) for x in zip(*ranges[key])))
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
            rows.append({"doc_id": doc, "n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": spans,
                         "kept": hashlib.sha256(kept).hexdigest() if digest else kept})
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist(rows, schema=out_schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    ranges = src.mapInArrow(cut, CUT).repartitionById(parts, F.col("part")).mapInArrow(meet, RANGE)
    texts = src.mapInArrow(squeeze, RANGE)
    out = (texts.union(ranges).repartitionById(parts, F.col("part"))
           .mapInArrow(finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"))
    return out.withColumnsRenamed({"doc_id": id_col, "kept": "kept_sha256" if digest else "kept"})
