"""Packing documents into fixed-length sequences by swap-based local search.

Every document is tokenised (word vocabulary) and closed with an end id; longer documents
are cut into full pieces and a rest.  Pieces are dealt evenly over groups by a hash.  In
each group a best-fit start is improved by moving, swapping one for one and two for one
between underfull bins, each step raising the sum of squared fills, until bins empty.
Bins that stay underfull go on to a next level, dealt anew over groups of the same size: bins
of complementary fills meet, or by hash where that saved nothing.  It ends with a level of one
group, or when neither dealing saves a bin; no group grows with the corpus.

Defined results: a null or empty text is the end id alone; strings of special tokens become
those tokens; a document of exactly the capacity is one piece; repeated rows are packed
each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm import words
from concord.llm.bpe import ragged, vocabulary_text
from concord.llm.common import discard, give_back, materialise, prepare, text_slices

CAPACITY = 4096
END_ID = 1
SLICE_BYTES = 1 << 20
CACHE_WORDS = 150_000
#: pieces per group, on every level
GROUP_PIECES = 20_000


class WordVocabulary:
    """Lower-casing word vocabulary: each word is encoded once per task and remembered."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        spec["truncation"] = spec["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.closing = np.zeros(max([*vocab.values(), *self.special.values()]) + 1, bool)
        self.closing[[i for piece, i in vocab.items() if piece.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = [np.zeros(0, np.uint16 if len(self.closing) < 65536 else np.uint32)]
        self.counts = [np.zeros(0, np.int64)]

    def table(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word, ids of all known words, ids per known word)."""
        if len(self.row) > CACHE_WORDS:
            self.forget()
        known = self.row
        fresh = [w for w in distinct if w not in known]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at:at + 20_000]
            # words part again at the blanks, and every word's last id is a closing one
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(part):
                each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids, ends = np.concatenate([np.asarray(x, np.int64) for x in each]), np.cumsum([len(x) for x in each])
            for w in part:
                known[w] = len(known)
            self.ids.append(ids.astype(self.ids[0].dtype))
            self.counts.append(np.diff(ends, prepend=0))
        self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]
        return np.fromiter((known[w] for w in distinct), np.int64, len(distinct)), self.ids[0], self.counts[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, as the tokenizer gives them without special tokens added."""
        plain, owner, special = texts, None, None
        if self.pattern is not None and any(s in t for s in self.special for t in texts):
            plain, owner, special = [], [], []
            for row, t in enumerate(texts):
                for k, p in enumerate(self.pattern.split(t)):
                    plain.append("" if k % 2 else p)
                    special.append(self.special[p] if k % 2 else -1)
                    owner.append(row)
        plain = [self.normal(t) for t in plain]
        data, starts, ends, per = words.split(plain, "bare")
        offsets = np.empty(2 * len(starts) + 1, np.int32)
        offsets[0:-1:2], offsets[1::2], offsets[-1] = starts, ends, len(data)
        tiles = pa.StringArray.from_buffers(2 * len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = tiles.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
        row, ids, counts = self.table(coded.dictionary.to_pylist())
        word = row[coded.indices.to_numpy(zero_copy_only=False)]
        at = np.concatenate([[0], np.cumsum(counts)])[:-1] if len(counts) else np.zeros(0, np.int64)
        flat = ids[ragged(at[word], counts[word])].astype(np.uint32)
        stops = np.concatenate([[0], np.cumsum(counts[word])])[np.cumsum(per)]
        parts = np.split(flat, stops[:-1]) if len(stops) else []
        if owner is None:
            return parts
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, row_no in enumerate(owner):
            out[row_no].append(np.array([special[k]], np.uint32) if special[k] >= 0 else parts[k])
        return [np.concatenate(x) for x in out]

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return text.lower()


_LOADED: dict[str, WordVocabulary] = {}


def load(spec: str) -> WordVocabulary:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordVocabulary(spec)
    return _LOADED[key]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(df: DataFrame, vocab_path: str, id_col: str, text_col: str, capacity: int,
                     end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; with ``keep_ids`` the ids themselves."""
    spark = df.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(vocabulary_text(spark, vocab_path))
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(spec.value)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                cols: list[list] = [[] for _ in range(6)]
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), vocab.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at:at + capacity]
                        row = (doc, k, at, len(own), zlib.crc32(own.tobytes()), own.tobytes() if keep_ids else None)
                        for c, v in zip(cols, row):
                            c.append(v)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays if keep_ids else arrays[:5], names=names if keep_ids else names[:5])
        give_back()

    return src.mapInArrow(run, PIECE + (", ids binary" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over item numbers: each item joins the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    # next non-empty room at or above a value, kept as a bitmap of rooms
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        above = rooms >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= need
        else:
            b, room = len(bins), capacity - need
            bins.append([i])
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


class _Search:
    """Bins of one group in arrays: fills, items, and the sums a bin may give back."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.capacity, self.size = capacity, lengths.astype(np.int64)
        self.items = [list(b) for b in bins]
        self.fill = np.array([int(self.size[b].sum()) for b in bins], np.int64)
        self.sums = list(zip(*[self._sums(b) for b in range(len(bins))])) or [(), ()]
        self.sums = [list(x) for x in self.sums]  # of one item and of two items, per bin
        self._lay()

    def _lay(self) -> None:
        """The sums of all bins in one array each, with their bins; a bin's old rows go to the
        bin behind the last, which has no room."""
        n = len(self.items)
        self.flat = []
        for sums in self.sums:
            sizes = np.array([len(x) for x in sums], np.int64)
            self.flat.append([np.concatenate([np.zeros(0, np.int64), *sums]), np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes, int(sizes.sum())])

    def _renew(self, b: int, own: tuple[np.ndarray, np.ndarray]) -> None:
        for k, new in enumerate(own):
            given, owner, start, used = self.flat[k]
            owner[start[b]:start[b] + len(self.sums[k][b])] = len(self.items)
            if used + len(new) > len(given):
                more = len(given) // 2 + len(new)
                given = np.concatenate([given, np.zeros(more, np.int64)])
                owner = np.concatenate([owner, np.full(more, len(self.items))])
            given[used:used + len(new)], owner[used:used + len(new)], start[b] = new, b, used
            self.flat[k] = [given, owner, start, used + len(new)]
            self.sums[k][b] = new

    def _sums(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct sums of one and of two items of a bin; at most ``capacity`` of each."""
        one, n = np.unique(self.size[self.items[b]], return_counts=True)
        i, j = np.triu_indices(len(one), 1)
        return one, np.unique(np.concatenate([one[i] + one[j], 2 * one[n > 1]]))

    def find(self, a: int) -> tuple[int, int, int, int, int] | None:
        """(bin, sum out, items out, sum back, items back) of a step that raises the sum of
        squared fills, by a move, a one-for-one, two-for-one or one-for-two exchange with any
        bin at least as full; the one that leaves least room.  None when there is none."""
        open_ = (self.fill >= self.fill[a]) & (self.fill < self.capacity)
        open_[a] = False
        room = np.append(np.where(open_, self.capacity - self.fill, 0), 0)
        below = []  # per number of items out: the largest sum of them up to every value
        for own in (self.sums[0][a], self.sums[1][a]):
            at = np.zeros(2 * self.capacity + 1, np.int64)
            at[own] = own
            below.append(np.maximum.accumulate(at))
        for out, back in ((1, 0), (1, 1), (2, 1), (1, 2)):
            given, owner = self.flat[back - 1][:2] if back else (np.zeros(len(room), np.int64), np.arange(len(room)))
            gain = np.where(room[owner] > 0, below[out - 1][given + room[owner]] - given, 0)
            hits = np.flatnonzero(gain > 0)
            if len(hits):
                k = hits[np.argmin(room[owner[hits]] - gain[hits])]
                return int(owner[k]), int(given[k] + gain[k]), out, int(given[k]), back
        return None

    def apply(self, a: int, step: tuple[int, int, int, int, int]) -> None:
        b, out, n_out, back, n_back = step
        gone, came = self._pick(a, out, n_out), self._pick(b, back, n_back)
        for i in gone:
            self.items[a].remove(i)
        for i in came:
            self.items[b].remove(i)
        self.items[a] += came
        self.items[b] += gone
        self.fill[a] -= out - back
        self.fill[b] += out - back
        for c in (a, b):
            self._renew(c, self._sums(c))
        if self.flat[0][3] > 4 * sum(len(x) for x in self.items) + 1000:  # mostly old rows
            self._lay()

    def _pick(self, b: int, total: int, n: int) -> list[int]:
        """``n`` items of a bin that add up to ``total``."""
        first: dict[int, int] = {}
        for i in self.items[b] if n else []:
            size = int(self.size[i])
            if n == 1 and size == total:
                return [i]
            if n == 2 and total - size in first:
                return [first[total - size], i]
            first.setdefault(size, i)
        return []


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over underfull bins: the emptiest bin gives items away by a move, a
    one-for-one or a two-for-one exchange.  Every step raises the sum of squared fills, so it
    ends: when no step of any bin does so, or when the items fill more than all bins but one
    and no bin can be saved.  A bin without items is dropped."""
    full = [b for b in bins if sum(lengths[b]) == capacity]
    search = _Search([b for b in bins if sum(lengths[b]) < capacity], lengths, capacity)
    total, alive = int(search.fill.sum()), {b for b, items in enumerate(search.items) if items}
    changed = True
    while changed and total <= (len(alive) - 1) * capacity:
        changed = False
        # bins of equal content are alike: what one of them tried in vain since the last step,
        # the others need not try
        vain: set[tuple[int, ...]] = set()
        for a in sorted(alive, key=lambda b: int(search.fill[b])):
            while search.items[a] and search.fill[a] < capacity:
                content = tuple(sorted(search.size[search.items[a]].tolist()))
                step = search.find(a) if content not in vain else None
                if step is None:
                    vain.add(content)
                    break
                search.apply(a, step)
                vain.clear()
                changed = True
            if not search.items[a]:
                alive.discard(a)
                if total > (len(alive) - 1) * capacity:
                    break
    return full + [search.items[b] for b in sorted(alive)]


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


PLACED = PIECE + ", sequence_id long, offset long"


def _pack_group(level: int, group: int, table: pa.Table, capacity: int, last: bool) -> pa.Table:
    """Pack the pieces of one group; ``done`` marks bins that are full (or the last level).

    ``fill`` is the fill of the bin a piece is in."""
    order = np.lexsort([table.column("tie").to_numpy(), table.column("piece").to_numpy(),
                        table.column("doc_id").fill_null(-(1 << 62)).to_numpy(), -table.column("length").to_numpy()])
    table = table.take(pa.array(order))
    lengths = table.column("length").to_numpy()
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    done, fill = np.zeros(len(lengths), bool), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(pack_lengths(lengths, capacity)):
        at = 0
        total = int(sum(lengths[items]))
        for i in items:
            seq[i], off[i] = (level << 48) | (group << 24) | b, at
            done[i] = last or total == capacity
            fill[i] = total
            at += int(lengths[i])
    keep = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "tie"])
    for name, col in (("sequence_id", seq), ("offset", off), ("done", done), ("fill", fill)):
        keep = keep.append_column(name, pa.array(col))
    return keep


def _group_packer(level: int, capacity: int, last: bool):
    return lambda key, table: _pack_group(level, key[0].as_py(), table, capacity, last)


def _dealt(left: DataFrame, held: DataFrame | None, level: int, vain: int, groups: int, capacity: int) -> DataFrame:
    """Pieces dealt over ``groups`` groups of about equal size (column ``grp``).

    At first, and after a level in vain, by a hash of the piece.  Otherwise by bins: a bin of
    fill f and one of fill capacity - f are of one class, classes follow each other over the
    groups, and a class of many bins is spread by hash over as many groups as it needs."""
    piece = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level))
    if held is None or vain:
        return left.withColumn("grp", F.pmod(piece, F.lit(groups)).cast("int"))
    kind = F.abs(2 * F.col("fill") - capacity)
    # one row per class, at most capacity + 1
    sizes = {r["kind"]: r["n"] for r in left.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, before, total = [], 0, sum(sizes.values())
    for k in sorted(sizes, reverse=True):
        rows.append((k, before, sizes[k]))
        before += sizes[k]
    classes = F.broadcast(left.sparkSession.createDataFrame(rows, "kind long, before long, own long"))
    place = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(1 << 20)) / (1 << 20)
    return (left.withColumn("kind", kind).join(classes, "kind")
            .withColumn("grp", F.least(F.floor((F.col("before") + place * F.col("own")) * groups / total), F.lit(groups - 1)).cast("int"))
            .drop("kind", "before", "own"))


def pack(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its offset in it."""
    spark = df.sparkSession
    pieces = materialise(tokenised_pieces(df, vocab_path, id_col, text_col, capacity, end_id, keep_ids=False))
    whole = pieces.where(F.col("length") == capacity)
    # a full piece is a sequence of its own; its number is made of the row's place in the
    # written table, with a bit that packed bins do not use
    placed = [whole.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 61))
              .withColumn("offset", F.lit(0).cast("long"))]
    left = pieces.where(F.col("length") < capacity).withColumn("tie", F.col("ids_crc32"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = PIECE + ", tie long, sequence_id long, offset long, done boolean, fill long"
    count = left.count()
    level, vain, held, held_bins = 0, 0, None, None
    while count:
        groups = -(-count // GROUP_PIECES)
        last = groups == 1
        dealt = _dealt(left, held, level, vain, groups, capacity)
        packed = materialise(dealt.groupBy("grp").applyInArrow(_group_packer(level, capacity, last), schema))
        # a bin is one row with offset 0
        now = packed.where("offset = 0").agg(F.count(F.lit(1)).alias("bins"), F.count_if(~F.col("done")).alias("open")).first()
        saved = held is None or now["bins"] < held_bins
        if saved:
            placed.append(packed.where("done").select(*names, "sequence_id", "offset"))
            held, held_bins, vain = packed.where("not done"), now["open"], 0
        else:
            discard(packed)
            vain += 1
        level += 1
        if last and saved:
            break
        # the dealing by complementary fills and the one by hash have both saved nothing
        if vain == (1 if last else 2):
            placed.append(held.select(*names, "sequence_id", "offset"))
            break
        left = held.select(*names, "tie", "sequence_id", "fill")
        count = left.count() if saved else count
    out = placed[0]
    for p in placed[1:]:
        out = out.select(p.columns).unionByName(p)
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
