"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j the walk reads the character under its pointer
and a shared random bit of (j, character) says whether the pointer moves on.  Texts at small
edit distance fall into step again after an edit, so edit distance becomes Hamming distance
between the characters read (Chakraborty, Goldenberg and Koucky 2016).  A fingerprint samples
the walk at ``DIGITS`` steps: of all steps below twice the length, those of smallest shared
random rank, so texts of different lengths still share most of their steps.  Bands of sampled digits, cut at
steps that texts of similar lengths share, find candidates (``Windows``: every pair as like as
the threshold meets), and agreement of the digits verifies them.

Walks run over whole texts, many texts abreast in numpy.

Defined results: null or empty text has the fingerprint of no steps; equal texts have equal
fingerprints; likeness of two empty texts is 1, of an empty and another 0; repeated ids take
any of their rows as neighbours in turn (id, then text); a single row is its own next row;
rows without an id come first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import discard, materialise, prepare, shuffle_parts

DIGITS = 128
CLASSES = 256
BLOCK = 1024
SLICE_CHARS = 16 << 20
SEED = 20_161


def walk_block(block: int) -> np.ndarray:
    """Shared random bits of steps block*BLOCK.., one row per step, one column per class."""
    rng = np.random.Generator(np.random.Philox(key=[SEED, block]))
    return np.unpackbits(rng.integers(0, 256, (BLOCK, CLASSES // 8), dtype=np.uint8), axis=1)


class Sampling:
    """Which steps a text of a given length is sampled at.

    Every step has a shared random rank; a text with n steps is sampled at its DIGITS steps
    of smallest rank.  ``steps`` holds all steps below the longest text that are sampled
    for some length, so a walk records only those."""

    def __init__(self) -> None:
        self.known = 0
        self.ranks = np.zeros(0, np.float64)
        self.steps = np.zeros(0, np.int64)
        self.by_length: dict[int, np.ndarray] = {}

    def extend(self, limit: int) -> None:
        if limit <= self.known:
            return
        import heapq

        new = np.concatenate([np.random.Generator(np.random.Philox(key=[SEED + 1, b])).random(BLOCK)
                              for b in range(self.known // BLOCK, -(-limit // BLOCK))])
        start = self.known // BLOCK * BLOCK
        steps, ranks = list(self.steps[self.steps < start]), list(self.ranks[self.steps < start])
        heap = [-r for r in sorted(ranks)[:DIGITS]]
        heapq.heapify(heap)
        cut = -heap[0] if len(heap) == DIGITS else 1.0
        at = 0
        while at < len(new):
            if len(heap) < DIGITS:
                hit = at
            else:
                later = np.flatnonzero(new[at:] < cut)
                if not len(later):
                    break
                hit = at + int(later[0])
            steps.append(start + hit)
            ranks.append(float(new[hit]))
            heapq.heappush(heap, -float(new[hit])) if len(heap) < DIGITS else heapq.heapreplace(heap, -float(new[hit]))
            cut = -heap[0] if len(heap) == DIGITS else 1.0
            at = hit + 1
        self.steps, self.ranks, self.known = np.array(steps, np.int64), np.array(ranks), start + len(new)

    def of(self, length: int) -> np.ndarray:
        """Places in ``steps`` of the sampled steps of a text of ``length`` characters, ascending."""
        if length not in self.by_length:
            n = int(np.searchsorted(self.steps, 2 * length))
            self.by_length[length] = np.sort(np.argsort(self.ranks[:n], kind="stable")[:DIGITS])
        return self.by_length[length]


_SAMPLING = Sampling()


def code_classes(text: str) -> np.ndarray:
    """One of 256 classes per character (a fixed mix of its code point)."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (((cp * np.uint32(2_654_435_761)) >> np.uint32(13)) ^ cp).astype(np.uint8)


def digit_of(classes: np.ndarray) -> np.ndarray:
    """The hexadecimal digit recorded for a class."""
    return ((classes.astype(np.uint16) * 167 + 13) >> 4).astype(np.uint8) & 15


def fingerprints(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Sampled digits of every text (arrays of character classes), in step order.

    All walks of a call go abreast, the longest texts first, and a walk of n characters
    leaves after 2n steps.  A pointer that has passed its text may run on into the next one;
    its digits then count as past the end."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    if n == 0:
        return []
    sampling = _SAMPLING
    sampling.extend(2 * int(lengths.max()) + 1)
    order = np.argsort(-lengths, kind="stable")
    data = np.concatenate([*[texts[i] for i in order], np.zeros(1, np.uint8)])
    starts = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
    ends = starts + lengths[order]
    pointer = starts.copy()
    steps = sampling.steps
    top = int(np.searchsorted(steps, 2 * int(lengths.max())))
    # read[k] holds the digits at sampled step k of the walks that still go then (longest first)
    read: list[np.ndarray] = []
    falling = 2 * lengths[order]  # walk i lasts 2 * length steps
    step, alive = 0, n
    for k in range(top):
        goal = int(steps[k])
        while step < goal:
            stop = min(goal, (step // BLOCK + 1) * BLOCK)
            bits = _block(step // BLOCK)
            alive = int(np.searchsorted(-falling, -step, side="left"))
            p = pointer[:alive]
            c = np.empty(alive, np.uint8)
            move = np.empty(alive, np.uint8)
            for s in range(step % BLOCK, step % BLOCK + stop - step):
                np.take(data, p, out=c, mode="clip")
                np.take(bits[s], c, out=move, mode="clip")
                p += move
            step = stop
        alive = int(np.searchsorted(-falling, -goal, side="left"))
        p = pointer[:alive]
        digits = digit_of(np.take(data, p, mode="clip"))
        digits[p >= ends[:alive]] = 255  # already past its end
        read.append(digits)
    out: list[np.ndarray] = [None] * n
    for rank, i in enumerate(order):
        out[i] = np.array([read[k][rank] for k in sampling.of(int(lengths[i]))], np.uint8)
    return out


_BLOCKS: dict[int, np.ndarray] = {}


def _block(b: int) -> np.ndarray:
    if b not in _BLOCKS:
        if len(_BLOCKS) > 512:
            _BLOCKS.clear()
        _BLOCKS[b] = walk_block(b)
    return _BLOCKS[b]


def as_string(length: int, digits: np.ndarray) -> str:
    """``length:digits``; a step past the end of its text is ``-``."""
    return f"{length:x}:" + "".join("-" if d == 255 else "0123456789abcdef"[d] for d in digits)


#: pairs of fingerprints compared at a time
PAIRS = 1024


def _table(prints: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(digits by sampled step, 0 where a text is not sampled; number of digits) of fingerprints."""
    _SAMPLING.extend(2 * max(int(n, 16) for n, _ in prints) + 1)
    places = [_SAMPLING.of(int(n, 16)) for n, _ in prints]
    columns = np.unique(np.concatenate(places))
    table = np.zeros((len(prints), len(columns)), np.uint8)
    for row, at, (_, digits) in zip(table, places, prints):
        row[np.searchsorted(columns, at)] = np.frombuffer(digits.encode(), np.uint8)
    return table, np.array([len(d) for _, d in prints])


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """Per pair of fingerprints the share of the sampled steps at which both read the same digit.

    Steps of the longer text that lie past the steps of the shorter do not agree."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), PAIRS):
        own = a[lo:lo + PAIRS]
        table, size = _table([x.split(":") for x in [*own, *b[lo:lo + PAIRS]]])
        n = len(own)
        same = ((table[:n] == table[n:]) & (table[:n] != 0)).sum(axis=1)
        larger = np.maximum(size[:n], size[n:])
        out[lo:lo + n] = np.where(larger == 0, 1.0, same / np.maximum(larger, 1))
    return out


def likeness(a: str, b: str) -> float:
    return float(likenesses([a], [b])[0])


class Windows:
    """Bands keyed by sampled steps that texts of different lengths share.

    A window starts at a length g and holds the longer texts whose sample has at most so
    many steps that the sample of g lacks.  The steps of least rank in the sample of g are
    sampled in every text of the window; they are cut into one band more than alike texts can
    differ in.  Two texts as like as the threshold are both in the window at or below the
    shorter one, and by the pigeonhole principle they agree in a whole band of it."""

    SLACK = 8

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.most = self.differ(DIGITS)
        self.starts: list[int] = [1]
        self.cuts: dict[int, list[np.ndarray]] = {}
        self.at: dict[int, list] = {}
        self.ends: dict[int, int] = {}
        self.holders: dict[int, list[int]] = {}

    def differ(self, length: int) -> int:
        """Steps in which a text may differ from a shorter one that is as like as the threshold."""
        n = min(2 * length, DIGITS)
        return n - sum(1 for k in range(n) if k / n < self.threshold)

    def slack(self, start: int) -> int:
        return 1 if 2 * start < DIGITS else self.SLACK

    @staticmethod
    def fresh(start: int, length: int) -> int:
        """Steps sampled for ``length`` and not for ``start``."""
        own = _SAMPLING.of(length)
        return len(own) - len(np.intersect1d(own, _SAMPLING.of(start), assume_unique=True))

    def holds(self, start: int, length: int) -> bool:
        return self.fresh(start, length) < self.differ(length) + self.slack(start)

    def extend(self, length: int) -> None:
        """Starts of all windows up to ``length``: a window starts where the one before
        misses as many steps as its slack."""
        while True:
            start = self.starts[-1]
            if length <= start or self.fresh(start, length) < self.slack(start):
                return
            low, high = start, length  # fresh() never falls as the length grows
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if self.fresh(start, mid) >= self.slack(start) else (mid, high)
            self.starts.append(high)

    def bands_of(self, start: int) -> list[np.ndarray]:
        """Places of the steps of every band of a window."""
        if start not in self.cuts:
            own = _SAMPLING.of(start)
            keep = min(len(own), max(DIGITS - self.most - self.slack(start) + 1, 0))
            least = np.sort(own[np.argsort(_SAMPLING.ranks[own], kind="stable")[:keep]])
            end = start
            while 2 * end < DIGITS and self.holds(start, end + 1):
                end += 1
            self.cuts[start] = np.array_split(least, self.differ(end) + 1)
        return self.cuts[start]

    def last(self, start: int) -> int:
        """The greatest length a window holds (it holds all from its start on: below DIGITS / 2 characters every
        character adds two fresh steps and less than one to ``differ``, which then stays, and fresh() never falls)."""
        if start not in self.ends:
            low, high = start, 2 * start
            _SAMPLING.extend(2 * high + 1)
            while self.holds(start, high):
                low, high = high, 2 * high
                _SAMPLING.extend(2 * high + 1)
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if self.holds(start, mid) else (low, mid)
            self.ends[start] = low
        return self.ends[start]

    def held_by(self, length: int) -> list[int]:
        """Starts of all windows that hold a length, its home first."""
        if length not in self.holders:
            if len(self.holders) > 100_000:
                self.holders.clear()
            _SAMPLING.extend(2 * length + 1)
            self.extend(length)
            below = self.starts[:int(np.searchsorted(self.starts, length, side="right"))]
            self.holders[length] = [below[-1], *[g for g in reversed(below[:-1]) if self.last(g) >= length]]
        return self.holders[length]

    def places(self, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every window that holds a length: places of its bands' digits in the fingerprint, where each band
        begins among them, and a salt per digit and band."""
        if length not in self.at:
            if len(self.at) > 20_000:
                self.at.clear()
            _SAMPLING.extend(2 * length + 1)
            self.extend(length)
            own, out = _SAMPLING.of(length), []
            for start in reversed(self.starts[:int(np.searchsorted(self.starts, length, side="right"))]):
                if self.fresh(start, length) >= self.most + self.SLACK:
                    break
                if self.holds(start, length):
                    bands = self.bands_of(start)
                    size = np.array([len(band) for band in bands])
                    begin = np.cumsum(size) - size
                    within = np.arange(int(size.sum())) - np.repeat(begin, size)
                    salt = _scatter(np.uint64(start) * np.uint64(1 << 20) + np.arange(len(bands), dtype=np.uint64))
                    out.append((np.searchsorted(own, np.concatenate(bands)), begin, size, _scatter(within.astype(np.uint64) + np.uint64(7)), salt))
            self.at[length] = out
        return self.at[length]

    def keys(self, fingerprint: str) -> np.ndarray:
        """64-bit keys of all bands of all windows that hold a fingerprint."""
        length, digits = fingerprint.split(":")
        if not digits:
            return np.zeros(0, np.uint64)
        read = np.frombuffer(digits.encode(), np.uint8).astype(np.uint64)
        out = []
        for at, begin, size, weight, salt in self.places(int(length, 16)):
            if not len(at):
                out.append(salt)  # bands without digits: every text of the window shares them
                continue
            sums = np.add.reduceat(_scatter(read[at] + weight), np.minimum(begin, len(at) - 1))
            out.append(_scatter(np.where(size > 0, sums, 0).astype(np.uint64) + salt))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _scatter(h: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_WINDOWS: dict[float, Windows] = {}


def windows_of(threshold: float) -> Windows:
    if threshold not in _WINDOWS:
        _WINDOWS[threshold] = Windows(threshold)
    return _WINDOWS[threshold]


def band_keys(fingerprint: str, threshold: float) -> np.ndarray:
    return windows_of(threshold).keys(fingerprint)


def in_windows(reps: DataFrame, threshold: float) -> DataFrame:
    """(win, home, node, fp): every class once in each window that holds its length, and whether the window is its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(threshold)
        for batch in batches:
            held = [windows.held_by(n) if (n := int(fp.split(":")[0], 16)) else [] for fp in batch.column("fp").to_pylist()]
            row = np.repeat(np.arange(len(held)), [len(h) for h in held])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for h in held for w in h], pa.int64()), pa.array(np.diff(row, prepend=-1) != 0),
                 batch.column("node").take(at), batch.column("fp").take(at)], names=["win", "home", "node", "fp"])

    return reps.select("node", "fp").mapInArrow(run, "win long, home boolean, node long, fp string")


class Cell:
    """Classes at home in a window (one tile of them) against classes that the window holds (one tile)."""

    def __init__(self, start: int, threshold: float, home: tuple[np.ndarray, list[str]], held: tuple[np.ndarray, list[str]]):
        self.threshold = threshold
        rows: dict[int, list[int]] = {}  # by length
        digits = []
        for k, x in enumerate([*home[1], *held[1]]):
            length, own = x.split(":")
            rows.setdefault(int(length, 16), []).append(k)
            digits.append(own)
        _SAMPLING.extend(2 * max(rows) + 1)
        bands = windows_of(threshold).bands_of(start)
        columns = np.unique(np.concatenate([_SAMPLING.of(length) for length in rows]))
        table, size = np.zeros((len(digits), len(columns)), np.uint8), np.zeros(len(digits), np.int64)
        for length, at in rows.items():
            own = np.searchsorted(columns, _SAMPLING.of(length))
            table[np.ix_(at, own)] = np.frombuffer("".join(digits[k] for k in at).encode(), np.uint8).reshape(len(at), len(own))
            size[at] = len(own)
        n = len(home[1])
        self.kept = np.searchsorted(columns, np.concatenate(bands))
        self.begins = np.cumsum([0, *(len(b) for b in bands)])[:-1]
        self.most = len(bands) - 1  # steps of ``kept`` in which alike texts of the window can differ
        self.empty = any(len(b) == 0 for b in bands)
        self.table, self.size = (table[:n], table[n:]), (size[:n], size[n:])
        self.names, at = np.unique(np.concatenate([home[0], held[0]]), return_inverse=True)
        self.at = (at[:n], at[n:])
        self.label = np.arange(len(self.names))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join what is as like as the threshold among pairs of rows that are not joined yet."""
        from concord.llm.embedding_dedup import smallest_reachable

        for lo in range(0, len(i), 4 * PAIRS):
            u, v = i[lo:lo + 4 * PAIRS], j[lo:lo + 4 * PAIRS]
            apart = self.label[self.at[0][u]] != self.label[self.at[1][v]]
            u, v = u[apart], v[apart]
            if not len(u):
                continue
            own = self.table[0][u]
            same = np.count_nonzero((own == self.table[1][v]) & (own != 0), axis=1)
            hit = same / np.maximum(np.maximum(self.size[0][u], self.size[1][v]), 1) >= self.threshold
            if hit.any():
                root = smallest_reachable(len(self.names), self.label[self.at[0][u[hit]]], self.label[self.at[1][v[hit]]])
                self.label = root[self.label]

    def banded(self) -> bool:
        """Compare rows that agree in a whole band; False, and nothing done, where comparing all is less work."""
        keys = [np.zeros((len(self.begins), len(t)), np.uint64) for t in self.table]
        for b, (lo, hi) in enumerate(zip(self.begins, [*self.begins[1:], len(self.kept)])):
            for k, t in zip(keys, self.table):
                for c in self.kept[lo:hi]:
                    k[b] = _scatter(k[b] + t[:, c].astype(np.uint64))
        found, total = [], 0
        for mine, other in zip(*keys):
            order = np.argsort(other, kind="stable")
            lo = np.searchsorted(other, mine, side="left", sorter=order)
            n = np.searchsorted(other, mine, side="right", sorter=order) - lo
            total += int(n.sum())
            if total * PAIR_COST > len(mine) * len(other):
                return False
            found.append((order, lo, n))
        for order, lo, n in found:
            ends = np.cumsum(n)
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 1, 64 * PAIRS), side="right"))
            for a, z in zip([0, *cuts], [*cuts, len(n)]):  # some rows at a time, so that few pairs are in memory
                i = np.repeat(np.arange(a, z), n[a:z])
                first = np.repeat(ends[a:z] - n[a:z], n[a:z])
                self.link(i, order[np.repeat(lo[a:z], n[a:z]) + np.arange(len(i)) + (ends[a - 1] if a else 0) - first])
        return True

    def all_pairs(self) -> None:
        """Compare every row with every other, first in some of the steps that all texts of the window are sampled at."""
        first = self.kept[:2 * self.most + 2]
        other = np.ascontiguousarray(self.table[1][:, first].T)
        differ, one = np.empty(len(self.table[1]), np.uint8), np.empty(len(self.table[1]), bool)
        for i, row in enumerate(self.table[0][:, first]):
            differ[:] = 0
            for mine, column in zip(row, other):
                np.not_equal(column, mine, out=one)
                np.add(differ, one.view(np.uint8), out=differ)
            j = np.flatnonzero(differ <= self.most)
            j = j[self.label[self.at[1][j]] != self.label[self.at[0][i]]]
            if len(j):
                self.link(np.full(len(j), i), j)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Every class that is joined with another, with the first class of its component here."""
        if self.empty or not self.banded():
            self.all_pairs()
        hit = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.names[hit], self.names[self.label[hit]]


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of ``after``."""
    q = len(text) // 4
    return text[:len(text) - q] + after[:q] if q else text


ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
PART = ROW + ", part int, edge string, text string"


def _rows(ids: list, texts: list[str], last_next: str | None) -> list[dict]:
    """Result rows of texts in turn; the last one needs ``last_next``, else it is left out."""
    following = [*texts[1:], *([] if last_next is None else [last_next])]
    changed = [edited(t, f) for t, f in zip(texts, following)]
    every = [code_classes(t) for t in [*texts, *([] if last_next is None else [last_next]), *changed]]
    prints = [as_string(len(c), d) for c, d in zip(every, fingerprints(every))]
    own, new = prints[:len(prints) - len(changed)], prints[len(prints) - len(changed):]
    near_edited = likenesses(own[:len(new)], new).tolist()
    near_next = likenesses(own[:len(new)], own[1:len(new) + 1]).tolist()
    return [{"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(),
             "fingerprint": own[k], "edited_fingerprint": new[k], "near_edited": near_edited[k], "near_next": near_next[k]}
            for k, (i, t, e) in enumerate(zip(ids, texts, changed))]


def fingerprint_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edit by the next text in id order.

    Rows are range-partitioned by id and sorted, so all neighbours but those across a
    partition edge meet in one task; the last row of each partition is joined with the
    first text of the next non-empty one (two rows per partition travel)."""
    spark = df.sparkSession
    prepare(spark)
    parts = shuffle_parts(spark)
    src = (df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
           .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
           .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                        ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        size, first = 0, True
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first:
                    yield pa.RecordBatch.from_pylist([{"part": part, "edge": "first", "text": t}], schema=schema)
                    first = False
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > SLICE_CHARS and len(ids) > 1:
                    yield pa.RecordBatch.from_pylist(_rows(ids[:-1], texts[:-1], texts[-1]), schema=schema)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if ids:
            if len(ids) > 1:
                yield pa.RecordBatch.from_pylist(_rows(ids[:-1], texts[:-1], texts[-1]), schema=schema)
            yield pa.RecordBatch.from_pylist([{"doc_id": ids[-1], "part": part, "edge": "last", "text": texts[-1]}], schema=schema)

    out = materialise(src.mapInArrow(run, PART))
    # partition numbers only: one small row per partition reaches the driver
    filled = sorted(r["part"] for r in out.where("edge = 'first'").select("part").collect())
    names = [f.split()[0] for f in ROW.split(", ")]
    inner = out.where("edge is null").select(*names)
    if not filled:
        return inner.withColumnRenamed("doc_id", id_col)
    pairs = spark.createDataFrame(list(zip(filled, [*filled[1:], filled[0]])), "part int, next int")
    heads = out.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    tails = out.where("edge = 'last'").select("part", "doc_id", "text").join(pairs, "part").join(heads, "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.schema(list(schema)[:7])
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(_rows([r["doc_id"]], [r["text"]], r["after"]), schema=own)

    edges = tails.select("doc_id", "text", "after").mapInArrow(close, ROW)
    return inner.unionByName(edges).withColumnRenamed("doc_id", id_col)


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) per row, computed where the texts lie."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = [code_classes(t) for t in batch.column(1).to_pylist()]
                prints = [as_string(len(c), d) for c, d in zip(codes, fingerprints(codes))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return src.mapInArrow(run, "doc_id long, fingerprint string").withColumnRenamed("doc_id", id_col)


#: classes on one side of a tile
TILE = 1 << 15
#: a pair of a band takes this many times the work of a pair compared in passing
PAIR_COST = 25


def _cell_links(threshold: float):
    """Links of one cell, as stars."""

    def run(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        sides = []
        for own in (home, ~home):
            side = table.filter(pa.array(own))
            sides.append((side.column("node").to_numpy(), side.column("fp").to_pylist()))
        if not all(len(nodes) for nodes, _ in sides):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = Cell(table.column("win")[0].as_py(), threshold, *sides).links()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def with_classes(df: DataFrame, fingerprint: str = "fingerprint", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``df`` with ``class_id`` of ``fingerprint_classes``, by its fingerprint."""
    return df.join(fingerprint_classes(df, fingerprint, id_col, threshold).withColumnRenamed("fp", fingerprint), fingerprint, "left")


def near_classes(df: DataFrame, fingerprint: str = "fingerprint", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(id, class_id) per row of ``df``."""
    return with_classes(df.select(id_col, fingerprint), fingerprint, id_col, threshold).select(id_col, "class_id")


def fingerprint_classes(df: DataFrame, fingerprint: str = "fingerprint", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(fp, class_id): documents linked by bit-sampled banding and verified likeness.

    Equal fingerprints are one class.  In every window (``Windows``) the classes at home there meet all that it
    holds, in salted tiles of bounded size; in a pair of tiles the classes that share a band are compared, or all where
    the bands tell them apart so little that this is less work.  So every pair of classes as like as
    the threshold is linked.  Links are closed by connected components; ``class_id`` is the
    smallest id of a component (null when none of its rows has an id)."""
    from concord.llm.common import connected_components

    prepare(df.sparkSession)
    # the numbers are written with the table, so they stay
    reps = materialise(df.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("fp"))
                       .agg(F.min(F.col(id_col).cast("long")).alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    placed = materialise(in_windows(reps, threshold))
    tiles = materialise(placed.groupBy("win").agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("homes"),
                                                  F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("helds")))
    # a class takes part in its home on both sides: as one at home there, and as one that the window holds
    salted = placed.join(F.broadcast(tiles.where("homes > 0")), "win").withColumn("salt", F.xxhash64("node"))
    own = {c: F.pmod("salt", F.col(c)).cast("int") for c in ("homes", "helds")}
    every = {c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("homes", "helds")}
    at_home = salted.where("home").select("win", own["homes"].alias("x"), every["helds"].alias("y"), F.lit(True).alias("home"), "node", "fp")
    held = salted.select("win", every["homes"].alias("x"), own["helds"].alias("y"), F.lit(False).alias("home"), "node", "fp")
    # cells are much work for their bytes, so they are not put together by bytes
    links = (at_home.unionByName(held).repartition(shuffle_parts(df.sparkSession), "win", "x", "y").groupBy("win", "x", "y")
             .applyInArrow(_cell_links(threshold), "a long, b long"))
    whole = materialise(connected_components(links))
    discard(placed, tiles)
    named = materialise(reps.join(whole, "node", "left").select("fp", "rep", F.coalesce("component", "node").alias("comp")))
    # written, so that the join of a large class may be split
    least = materialise(named.groupBy("comp").agg(F.min("rep").alias("class_id")))
    out = materialise(named.join(least, "comp").select("fp", "class_id"))
    discard(reps, whole, named, least)
    return out
