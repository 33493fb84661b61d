"""Packing token sequences along a space-filling curve (operator 6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import bpe
from cellweave.llm.common import column, give_back, per_process, slices
from cellweave.session import cut_lineage

DIMS, BITS = 3, 10
SLICE = 1 << 20  # bytes of text tokenised together
KNOWN = 200_000  # merged pieces a worker remembers


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each integer point (n x dims, ``bits`` bits each) on the Hilbert curve.

    The published transposition: from the highest bit down, undo the exchanges and inversions of each level, Gray-
    decode, and interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def directions(size: int, seed: int = 11) -> np.ndarray:
    """A random sign for every id and dimension."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (size, DIMS))


def curve_keys(ids: np.ndarray, counts: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Hilbert key of each document: its hashed bag of ids, projected to ``DIMS`` directions and scaled to its length."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    sums = np.zeros((len(counts), DIMS))
    some = np.flatnonzero(counts)
    if len(some):
        sums[some] = np.add.reduceat(signs[ids].astype(np.float64), ends[some], axis=0)
    spread = sums / np.sqrt(np.maximum(counts, 1))[:, None] / 4
    cells = np.floor((np.tanh(spread) + 1) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, ids): Hilbert key and all token ids with the end id, little-endian, two bytes each if all ids fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = per_process(f"vocabulary {tokenizer}", lambda: bpe.load(tokenizer))
        known = per_process(f"pieces {tokenizer}", lambda: bpe.Pieces(KNOWN))
        signs = per_process(f"directions {tokenizer}", lambda: directions(int(max(vocab.merged.max(), vocab.byte_ids.max(), *vocab.special.values(), 0)) + 1))
        for batch in slices(batches, text_col, SLICE):  # the merge arrays of a slice are many times its bytes
            ids, counts = bpe.token_ids(vocab, column(batch, text_col), known)
            keys = curve_keys(ids, counts, signs)
            ends = np.cumsum(counts)
            flat = np.insert(ids.astype("<u2" if max(len(signs), end_id) < 1 << 16 else "<u4"), ends, end_id)
            offsets = np.concatenate([[0], flat.itemsize * (ends + np.arange(1, len(ends) + 1))]).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(keys), pa.array(counts + 1), packed], ["id", "key", "n", "ids"])
            del ids, counts, keys, ends, flat, offsets, packed
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, key long, n long, ids binary")


def _sequence_sizes(left: int, length: int) -> list[int]:
    """The rest of a partition in powers of two, largest first: a sequence of such a size needs no padding."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are range-sorted by the Hilbert key of their hashed token vectors, so that neighbours on the curve share
    sequences, and each range partition is cut into sequences of ``length`` ids, one after the other. What is left at
    the end of a partition is cut into powers of two, which are not padded; so no id is padding at all. Null and empty
    texts are their end id alone. Equal keys are ordered by id, so copies spread over partitions. Repeated rows and
    null ids are packed like others; other columns are not read.

    Texts are tokenised once, into a written table; the range sort reads that table twice (limits, then rows).
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    rows = cut_lineage(tokenized(docs, tokenizer, end_id, id_col, text_col))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", F.xxhash64("id"), "id"]
    ordered = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, fill, kind = 0, 0, 0, None
        last: list[tuple] = []  # pieces of the open sequence: (id, start, size, bytes, doc tokens)
        for batch in batches:
            out: list[tuple] = []
            kind = column(batch, "id").type
            part = column(batch, "part")[0].as_py() if batch.num_rows else part
            for ident, n, blob in zip(column(batch, "id").to_pylist(), column(batch, "n").to_pylist(), column(batch, "ids")):
                buffer, start = blob.as_buffer(), 0
                tokens = np.frombuffer(buffer, f"<u{buffer.size // n}")
                while start < n:
                    size = min(n - start, length - fill)
                    last.append((ident, start, size, tokens[start : start + size].astype("<u4").tobytes(), n))
                    start, fill = start + size, fill + size
                    if fill == length:
                        at = 0
                        for i, s, k, ids, doc in last:
                            out.append((i, s, k, zlib.crc32(ids), doc, part << 40 | number, at))
                            at += k
                        last, fill, number = [], 0, number + 1
            if out:
                yield _batch(out, names, kind)
        out = []
        sizes = _sequence_sizes(fill, length)
        room, at = (sizes.pop(0) if sizes else 0), 0
        for ident, start, size, ids, doc in last:
            done = 0
            while done < size:
                k = min(size - done, room - at)
                out.append((ident, start + done, k, zlib.crc32(ids[4 * done : 4 * (done + k)]), doc, part << 40 | number, at))
                done, at = done + k, at + k
                if at == room:
                    room, at, number = (sizes.pop(0) if sizes else 0), 0, number + 1
        if out:
            yield _batch(out, names, kind)

    shown = docs.schema[id_col].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {shown}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType | None) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)
