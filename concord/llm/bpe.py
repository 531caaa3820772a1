"""Byte-level BPE encoding and decoding through a distinct-word table.

Every task splits its texts into words and asks for each distinct word of a chunk once;
the requests are dealt over partitions by a hash of the word, where each distinct word of
the corpus is encoded once; the answers return to the chunk, and ids are put together by
word position.  Decoding joins ids with the id-to-piece table (the vocabulary, so bounded
and broadcast) and concatenates the pieces.

Words travel as packed blocks (one per chunk and partition), so shuffles move each distinct
word of a chunk once, not each occurrence.  A very frequent word appears once per chunk, so
no partition is hot.

Defined results: a null or empty text has no ids; strings of special tokens inside a text
become those tokens; repeated rows and ids are encoded row by row; a text longer than a
chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from concord.llm import words
from concord.llm.common import packed_row, prepare, shuffle_parts, text_slices

CHUNK_BYTES = 8 << 20
NO_IDS = hashlib.sha256(b"").hexdigest()


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes (equal bytes of neighbours together)."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    out, spare = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + spare)] = b
            spare += 1
    return out


class Vocabulary:
    """A byte-level tokenizer file: encoder of single words, special tokens, pieces."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        spec["truncation"] = spec["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        vocab = {**spec["model"]["vocab"], **self.special}
        size = max(vocab.values()) + 1
        pieces: list[bytes] = [b""] * size
        alphabet = byte_alphabet()
        for piece, i in vocab.items():
            known = all(c in alphabet for c in piece)
            pieces[i] = bytes(alphabet[c] for c in piece) if known else piece.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode_words(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, ids per word)."""
        ids, counts = [], np.zeros(len(items), np.uint32)
        for at in range(0, len(items), 5000):
            part = self.tokenizer.encode_batch_fast(items[at:at + 5000], add_special_tokens=False)
            got = [e.ids for e in part]
            counts[at:at + len(got)] = [len(x) for x in got]
            ids.append(np.concatenate([np.asarray(x, np.uint32) for x in got]) if got else np.zeros(0, np.uint32))
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The pieces of ``ids`` in turn, as the utf-8 bytes of the decoded text."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at:at + (1 << 18)]
            out.append(self.piece_bytes[ragged(self.piece_at[part], self.piece_len[part])].tobytes())
        raw = b"".join(out)
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode("utf-8")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length-1 of every run, in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


_LOADED: dict[str, Vocabulary] = {}


def load(spec: str) -> Vocabulary:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


def vocabulary_text(spark: SparkSession, path: str) -> str:
    """The tokenizer file, read where the driver runs; tasks get it as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _chunk_words(texts: list[str], vocab: Vocabulary):
    """(key of the chunk, distinct words as an Arrow array, word index of every word,
    words per text); special tokens take indices from len(distinct words) on."""
    inserts: list[tuple[int, int]] = []
    parts, owner = [], []
    joined_has = vocab.pattern is not None and any(s in t for s in vocab.special for t in texts)
    order = sorted(vocab.special)
    if joined_has:
        for row, t in enumerate(texts):
            for k, p in enumerate(vocab.pattern.split(t)):
                if k % 2:
                    inserts.append((len(parts), order.index(p)))
                parts.append("" if k % 2 else p)
                owner.append(row)
    else:
        parts = texts
    data, starts, ends, per = words.split(parts, "spaced")
    # words tile the texts, so the boundaries are the offsets of an Arrow string array
    offsets = np.append(starts, len(data)).astype(np.int32)
    column = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    coded = column.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary
    if joined_has:
        before = np.concatenate([[0], np.cumsum(per)])
        index = np.insert(index, [before[p] for p, _ in inserts], [len(distinct) + s for _, s in inserts])
        for p, _ in inserts:
            per[p] += 1
        per = np.bincount(np.asarray(owner), weights=per, minlength=len(texts)).astype(np.int64)
    digest = hashlib.sha256(data)
    digest.update(np.asarray(per, np.int64).tobytes())
    return digest, distinct, index, per


def _by_part(distinct: pa.Array, parts: int):
    """Words in order of the partition that encodes them, and each word's place there."""
    import pandas as pd

    to = (pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False) % parts).astype(np.int64) \
        if len(distinct) else np.zeros(0, np.int64)
    order = np.argsort(to, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct.take(pa.array(order)), np.bincount(to, minlength=parts), place


def _key(digest, ids: pa.Array) -> str:
    digest.update(repr(ids.to_pylist()).encode())
    return digest.hexdigest()[:32]


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
           emit: str = "ids") -> DataFrame:
    """Encode every text.  ``emit='ids'``: (id, ids array<int>); ``emit='digest'``: (id,
    n_tokens, ids_sha256, decoded_sha256), decoding every document again.

    Chunks are recognised by their content; a chunk whose answers are missing fails the job
    instead of losing rows."""
    spark = df.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(vocabulary_text(spark, vocab_path))
    parts = shuffle_parts(spark)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def slices(batches: Iterator[pa.RecordBatch]):
        vocab = load(spec.value)
        for batch in batches:
            for part in text_slices(batch, "text", CHUNK_BYTES):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                digest, distinct, index, per = _chunk_words(texts, vocab)
                yield part.column("id"), _key(digest, part.column("id")), distinct, index, per

    def ask(batches):
        for _, key, distinct, _, _ in slices(batches):
            ordered, counts, _ = _by_part(distinct, parts)
            offsets = np.frombuffer(ordered.buffers()[1], np.int32, len(ordered) + 1) if len(ordered) else np.zeros(1, np.int32)
            data = memoryview(ordered.buffers()[2]) if len(ordered) else b""
            lo = 0
            out = []
            for p, n in enumerate(counts):
                if n:
                    o = offsets[lo:lo + n + 1]
                    out.append((p, key, pack(np.diff(o).astype(np.uint32)),
                                zstandard.ZstdCompressor(level=3).compress(data[o[0]:o[-1]])))
                lo += n
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("part", "chunk", "head", "body"), r)) for r in out], schema=ask_schema)

    ask_schema = pa.schema([("part", pa.int32()), ("chunk", pa.string()), ("head", pa.binary()), ("body", pa.binary())])
    answer_schema = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())),
                               ("head", pa.binary()), ("body", pa.binary())])

    def answer(batches):
        vocab = load(spec.value)
        keys, lens, bodies, sizes, part_no = [], [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                n = unpack(r["head"], np.uint32)
                keys.append(r["chunk"])
                part_no.append(r["part"])
                sizes.append(len(n))
                lens.append(n)
                bodies.append(zstandard.ZstdDecompressor().decompress(r["body"]))
        if not keys:
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lens), dtype=np.int64)])
        asked = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b"".join(bodies)))
        coded = asked.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids, counts = vocab.encode_words(coded.dictionary.to_pylist())
        at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[:-1]
        lo = 0
        for key, p, n in zip(keys, part_no, sizes):
            w = index[lo:lo + n]
            lo += n
            got = ids[ragged(at[w], counts[w].astype(np.int64))]
            yield pa.RecordBatch.from_pylist(
                [{"chunk": key, "part": p, "ids": None, "head": pack(counts[w]), "body": pack(got)}], schema=answer_schema)

    def hold(batches):
        for ids, key, distinct, index, per in slices(batches):
            _, _, place = _by_part(distinct, parts)
            known = index < len(place)
            index[known] = place[index[known]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([-1 - len(place)], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                 pa.array([pack(per.astype(np.uint32))], pa.binary()), pa.array([pack(index.astype(np.uint32))], pa.binary())],
                schema=answer_schema)

    def assemble(table: pa.Table) -> pa.Table:
        vocab = load(spec.value)
        rows = table.to_pylist()
        held = [r for r in rows if r["part"] < 0]
        answers = {r["part"]: r for r in rows if r["part"] >= 0}
        if not held:
            raise RuntimeError("answers without their chunk: the input was split differently when it was read again")
        heads = [unpack(answers[p]["head"], np.uint32) for p in sorted(answers)]
        bodies = [unpack(answers[p]["body"], np.uint32) for p in sorted(answers)]
        counts = np.concatenate([*heads, np.ones(len(vocab.special), np.uint32)]).astype(np.int64)
        ids = np.concatenate([*bodies, np.array([vocab.special[s] for s in sorted(vocab.special)], np.uint32)])
        at = np.concatenate([[0], np.cumsum(counts)])[:-1]
        out = []
        for r in held:
            if sum(map(len, heads)) != -1 - r["part"]:
                raise RuntimeError("a chunk lacks answers: the input was split differently when it was read again")
            per, index = unpack(r["head"], np.uint32), unpack(r["body"], np.uint32)
            got = ids[ragged(at[index], counts[index])]
            word_ends = np.concatenate([[0], np.cumsum(counts[index])])
            ends = word_ends[np.cumsum(per, dtype=np.int64)]
            lo = 0
            for doc, hi in zip(r["ids"], ends):
                own = got[lo:hi]
                lo = hi
                if emit == "ids":
                    out.append({"id": doc, "ids": own.astype(np.int32)})
                else:
                    out.append({"id": doc, "n_tokens": len(own),
                                "ids_sha256": hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(),
                                "decoded_sha256": hashlib.sha256(vocab.decode(own)).hexdigest()})
        return pa.Table.from_pylist(out, schema=out_schema)

    fields = [("ids", pa.list_(pa.int32()))] if emit == "ids" else \
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out_schema = pa.schema([("id", pa.int64()), *fields])
    ddl = "id long, ids array<int>" if emit == "ids" else "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    row = "chunk string, part int, ids array<long>, head binary, body binary"
    asked = src.mapInArrow(ask, "part int, chunk string, head binary, body binary")
    answered = asked.repartitionById(parts, F.col("part")).mapInArrow(answer, row)
    held = src.mapInArrow(hold, row)
    return held.union(answered).groupBy("chunk").applyInArrow(assemble, ddl).withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of an ``array<int>`` column (null array: null text),
    by joining ids with the vocabulary's pieces."""
    spark = df.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(vocabulary_text(spark, vocab_path))
    src = df.select(packed_row(df, {out_col.lower()}).alias("row"), F.col(ids_col).alias("ids"))
    schema = StructType([src.schema.fields[0], StructField("decoded", StringType())])

    def run(batches):
        vocab = load(spec.value)
        for batch in batches:
            texts = [None if x is None else vocab.decode(np.asarray(x, np.int64)).decode("utf-8")
                     for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return src.mapInArrow(run, schema).select("row.*", F.col("decoded").alias(out_col))
