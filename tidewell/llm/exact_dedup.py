"""Exact dedup by counting quotient filters and a comparison of whole texts.

Each task puts the 64-bit fingerprints of its texts into counting quotient
filters, one for each block (range) of fingerprints. Filters of a block are
merged without loss, as each lists its fingerprints in ascending order. Texts
whose fingerprint counts more than once, and only these, are compared by their
bytes; a fingerprint that two different texts share costs a comparison, never a
document.

A filter holds a fingerprint as quotient (a place) and remainder (what stands in
the slot). Remainders of a quotient form a run, in ascending order, as near to
its place as earlier runs allow. A slot that isn't larger than the remainder
before it in its run is a digit of that remainder's counter.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, shielded, small_batches

#: Rows of fingerprints or digests up to which a table of them is sent to every executor (some 60 MB as Spark holds it); beyond that it is joined by a shuffle.
MOST_BROADCAST = 250_000
#: Fingerprints that a task holds before it turns them into filters.
MOST_HELD = 1 << 20
_HEAD = "<BBQ"
_ONE = np.uint64(1)


def normalised(text) -> F.Column:
    """The text with each run of white space (U+0020, U+0009 to U+000D) as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digits(x: int, n: int) -> list[int]:
    """n in bijective base x + 1, lowest digit first, each digit less by one: none for 0, and every digit is at most x."""
    out = []
    if x == 0:
        return [0] * n
    while n:
        n -= 1
        out.append(n % (x + 1))
        n //= x + 1
    return out


def _number(x: int, digits: list[int]) -> int:
    n = 0
    for d in reversed(digits):
        n = n * (x + 1) + d + 1
    return n


def pack(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter of ascending different fingerprints below 2 ** bits, with their counts."""
    n = len(prints)
    q = min(bits - 1, max(1, int(n * 4 / 3).bit_length()))
    r = bits - q
    prints, counts = prints.astype(np.uint64), counts.astype(np.int64)
    quotient, remainder = (prints >> np.uint64(r)).astype(np.int64), prints & ((_ONE << np.uint64(r)) - _ONE)
    # a counter takes one slot if it is at most one more than the remainder, as nearly all are
    more = counts - 1
    one = (more > 0) & (more.astype(np.uint64) <= remainder + _ONE)
    long = {int(i): _digits(int(remainder[i]), int(more[i])) for i in np.nonzero((more > 0) & ~one)[0]}
    width = 1 + one.astype(np.int64)
    for i, d in long.items():
        width[i] = 1 + len(d)
    at = np.cumsum(width) - width
    flat = np.zeros(int(width.sum()), np.uint64)
    flat[at] = remainder
    flat[at[one] + 1] = (more[one] - 1).astype(np.uint64)
    for i, d in long.items():
        flat[at[i] + 1 : at[i] + 1 + len(d)] = d
    # runs: each begins at its quotient or right after the run before it
    occupied, first = np.unique(quotient, return_index=True)
    length = np.diff(np.append(at[first], len(flat)))
    before = np.cumsum(length) - length
    start = np.maximum.accumulate(occupied - before) + before if n else before
    slots = np.zeros(int(start[-1] + length[-1]) if n else 0, np.uint64)
    slots[np.repeat(start - before, length) + np.arange(len(flat))] = flat
    occupieds, runends = np.zeros(1 << q, bool), np.zeros(len(slots), bool)
    occupieds[occupied] = True
    runends[start + length - 1] = True
    size = -(-r // 8)
    raw = np.ascontiguousarray(slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])
    return struct.pack(_HEAD, bits, q, len(slots)) + np.packbits(occupieds).tobytes() + np.packbits(runends).tobytes() + raw.tobytes()


def unpack(filter_: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints and their counts: exactly what pack() was given."""
    bits, q, n = struct.unpack_from(_HEAD, filter_)
    r, at = bits - q, struct.calcsize(_HEAD)
    size, places, marks = -(-r // 8), -(-(1 << q) // 8), -(-n // 8)
    occupied = np.nonzero(np.unpackbits(np.frombuffer(filter_, np.uint8, places, at), count=1 << q))[0]
    ends = np.nonzero(np.unpackbits(np.frombuffer(filter_, np.uint8, marks, at + places), count=n))[0]
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :size] = np.frombuffer(filter_, np.uint8, n * size, at + places + marks).reshape(n, size)
    slots = raw.reshape(-1).view("<u8").astype(np.uint64)
    start = np.maximum(occupied, np.append(0, ends[:-1] + 1)) if len(ends) else ends
    length = ends - start + 1
    before = np.cumsum(length) - length
    flat = slots[np.repeat(start - before, length) + np.arange(int(length.sum()))]
    # with its quotient in front, a remainder is larger than all slots before it, and a digit is not
    whole = np.repeat(occupied.astype(np.uint64), length) << np.uint64(r) | flat
    item = np.append(True, whole[1:] > np.maximum.accumulate(whole)[:-1]) if len(whole) else np.empty(0, bool)
    at = np.nonzero(item)[0]
    extra = np.diff(np.append(at, len(whole))) - 1
    counts = np.ones(len(at), np.int64)
    one = extra == 1
    counts[one] += flat[at[one] + 1].astype(np.int64) + 1
    for i in np.nonzero(extra > 1)[0]:
        counts[i] += _number(int(flat[at[i]]), [int(x) for x in flat[at[i] + 1 : at[i] + 1 + extra[i]]])
    return whole[at], counts


def counted(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different fingerprints and the sums of their counts. The sort merges ascending stretches."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.nonzero(np.append(True, prints[1:] != prints[:-1]))[0] if len(prints) else np.empty(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def merge(filters: list[bytes]) -> bytes:
    """The filter of all fingerprints of filters of one block, counts added."""
    parts = [unpack(f) for f in filters]
    return pack(*counted(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])), struct.unpack_from(_HEAD, filters[0])[0])


def filters_of(prints: DataFrame, block_bits: int, held: int = MOST_HELD) -> DataFrame:
    """(block, filter): for the fingerprints (column fp, 64 bits) of each partition, one filter a block, or one for each `held` fingerprints."""
    rest = np.uint64(64 - block_bits)

    def run(batches):
        def table(parts):
            fps, n = counted(np.concatenate(parts), np.ones(sum(map(len, parts)), np.int64))
            block = (fps >> rest).astype(np.int64)
            low = fps & ((_ONE << rest) - _ONE)
            ids, first = np.unique(block, return_index=True)
            ends = np.append(first[1:], len(fps))
            packed = [pack(low[i:j], n[i:j], 64 - block_bits) for i, j in zip(first, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["block", "filter"])

        parts, size = [], 0
        for b in batches:
            parts.append(b.column("fp").to_numpy().view(np.uint64))
            size += b.num_rows
            if size >= held:
                yield table(parts)
                parts, size = [], 0
        if size:
            yield table(parts)

    return prints.select("fp").mapInArrow(run, "block long, filter binary")


def merged(filters: DataFrame, block_bits: int) -> DataFrame:
    """(fp, n): the fingerprints that count more than once, from the merged filters of each block. A task holds one block at a time."""
    rest = np.uint64(64 - block_bits)

    def run(batches):
        def repeated(block, held):
            fps, n = unpack(merge(held))
            again = n > 1
            fps = fps[again] | np.uint64(block) << rest
            return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(n[again])], names=["fp", "n"])

        at, held = None, []
        for b in batches:
            for block, f in zip(b.column("block").to_pylist(), b.column("filter").to_pylist(), strict=True):
                if block != at:
                    if held:
                        yield repeated(at, held)
                    at, held = block, []
                held.append(f)
        if held:
            yield repeated(at, held)

    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(run, "fp long, n long")


def block_bits(rows: int, parts: int, a_block: int = 1 << 18) -> int:
    """Bits of a fingerprint that name its block: some blocks for each of `parts` tasks, and about a_block of `rows` at most in each."""
    return min(40, max(8, (4 * parts - 1).bit_length(), (max(1, rows) // a_block).bit_length()))


def _light(rows: DataFrame, most: int) -> DataFrame:
    """rows, to be broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def find_copies(docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Groups of texts of docs (doc_id, text) that are equal after each run of white space is made one space.

    Returns doc_id, keep_id (the smallest doc_id of the equal texts), group_size,
    kept (doc_id = keep_id) and text_sha256 of the text so normalised, a row for
    each row of docs. Null counts as empty, and empty texts equal each other.
    Rows that repeat a kept doc_id with the same text are all kept (drop_copies
    leaves one of them). A null doc_id is larger than any other; a group of
    nulls alone has a null keep_id and is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    slim = materialize(texts.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")), "exact-digests")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")  # fingerprints are small
    try:
        bits = block_bits(slim.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
        again = materialize(merged(materialize(filters_of(slim, bits), "exact-filters"), bits), "exact-repeated")
    finally:
        small_batches(spark)
    suspects = _light(again.select(F.col("fp").alias("_fp")), most_broadcast)
    # copies meet as texts, byte by byte, after each task has folded its own
    same = texts.join(suspects, F.xxhash64("norm") == F.col("_fp"), "left_semi").groupBy("norm").agg(
        F.min("doc_id").alias("keep"), F.count("*").alias("size")
    )
    groups = materialize(same.where("size > 1").select(F.sha2("norm", 256).alias("_sha"), "keep", "size"), "exact-groups")
    found = slim.join(_light(groups, most_broadcast), F.col("text_sha256") == F.col("_sha"), "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of docs, with all their columns, of one document in each group of equal texts; of rows that repeat it one stays."""
    inner, restore = shielded(docs, ["doc_id", "text"])
    found = materialize(find_copies(inner, most_broadcast).where("group_size > 1").select(
        F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_sha"), F.col("kept").alias("_kept")
    ).groupBy("_d", "_sha").agg(F.max("_kept").alias("_kept"), F.count("*").alias("_n")), "exact-rows")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.sha2(normalised(F.col("text")), 256) == F.col("_sha"))
    gone = _light(found.where("not _kept"), most_broadcast)
    left = inner.join(gone, same, "left_anti")
    repeated = found.where("_kept and _n > 1")
    if not repeated.limit(1).count():
        return restore(left)
    repeated = _light(repeated.select("_d", "_sha"), most_broadcast)
    once = left.join(repeated, same, "left_semi").withColumn("_sha", F.sha2(normalised(F.col("text")), 256)).dropDuplicates(["doc_id", "_sha"])
    return restore(left.join(repeated, same, "left_anti")).union(restore(once))
