"""Benchmark decontamination by a prefix-filtered set join on word shingles.

The tokens of a window (the words a document must hold in full and in order)
are its shingles of SHINGLE words. They are ordered by rarity, counted over the
whole corpus. Containment needs all of them, so a window's prefix is one token:
its rarest. The join is on that token: a document's shingles meet the prefix
tokens of a block of the benchmark, a hash table of bounded size that every
worker holds. A match names windows, and where they would have to lie; the
length and position bounds drop those that don't fit into the text, and the rest
are compared word by word.
"""

from __future__ import annotations

import hashlib
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import covered, materialize, plain_words, shielded, small_batches, window_hash

#: Words of a token; windows of fewer words are one token.
SHINGLE = 3
#: Text of the benchmark that is joined at a time. 8 MB make a table of about 50 MB (measured: 1.2 million windows).
BLOCK_BYTES = 8 << 20
#: Bits of a hash that are looked up before the sorted tokens are.
FILTER_BITS = 22

FOUND = "doc_id long, n_words long, hits array<int>, items array<string>, unnamed boolean"


class Tokens(NamedTuple):
    """Sorted hashes of some windows' tokens of `size` words, and a table of their leading bits."""

    size: int
    hashes: np.ndarray
    lead: np.ndarray

    @staticmethod
    def of(size: int, hashes: np.ndarray) -> Tokens:
        lead = np.zeros(1 << FILTER_BITS, bool)
        lead[hashes >> np.uint64(64 - FILTER_BITS)] = True
        return Tokens(size, hashes, np.packbits(lead))

    def find(self, numbers: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, place among the hashes) of the tokens of a text that are here."""
        known = numbers > 0
        all_known = known[: len(known) - self.size + 1].copy()
        for j in range(1, self.size):
            all_known &= known[j : len(known) - self.size + 1 + j]
        at = np.nonzero(all_known)[0]
        if not len(at):
            return at, at
        h = window_hash(numbers, self.size)[at]
        maybe = lead[h >> np.uint64(64 - FILTER_BITS)]
        at, h = at[maybe], h[maybe]
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        right = self.hashes[place] == h
        return at[right], place[right]


class Group(NamedTuple):
    """Windows whose tokens have one size, by prefix token: those of token t are places starts[t] to starts[t + 1]."""

    tokens: Tokens
    starts: np.ndarray
    offset: np.ndarray  # of the token in the window
    first: np.ndarray  # of the window in the words
    length: np.ndarray
    item: np.ndarray


class Block:
    """A block of the benchmark: its words as numbers from 1, and its windows of k words, each once an item."""

    def __init__(self, items: list[tuple[str | None, str | None]], k: int):
        self.names = [n for n, _ in items]
        self.numbers: dict[bytes, int] = {}
        parts = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in plain_words(t)] for _, t in items]
        self.words = np.array([x for p in parts for x in p], np.uint64)
        sizes = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(sizes) - sizes
        n = np.where(sizes > 0, np.maximum(1, sizes - k + 1), 0)
        self.item = np.repeat(np.arange(len(items)), n)
        self.first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[self.item]
        self.length = np.minimum(k, sizes)[self.item]
        self.groups: list[Group] = []

    def sizes(self) -> list[int]:
        """Sizes of the tokens of the block's windows."""
        return sorted({int(min(SHINGLE, x)) for x in np.unique(self.length)})

    def _of(self, size: int) -> np.ndarray:
        return np.nonzero(np.minimum(SHINGLE, self.length) == size)[0]

    def all_tokens(self, size: int) -> np.ndarray:
        """Sorted hashes of all tokens of that size."""
        h = window_hash(self.words, size)
        w = self._of(size)
        inside = [self.first[w][self.length[w] - size >= j] + j for j in range(int(self.length[w].max()) - size + 1)]
        return np.unique(h[np.concatenate(inside)])

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Enter each window under its rarest token; counts has (sorted hashes, how often they occur) by size."""
        for size in self.sizes():
            h, w = window_hash(self.words, size), self._of(size)
            rarest, least, token = np.zeros(len(w), np.int64), np.full(len(w), np.iinfo(np.int64).max), np.zeros(len(w), np.uint64)
            known, often = counts[size]
            for j in range(int(self.length[w].max()) - size + 1):
                at = np.minimum(self.first[w] + j, len(h) - 1)
                n = often[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)]
                better = (self.length[w] - size >= j) & (n < least)
                rarest[better], least[better], token[better] = j, n[better], h[at][better]
            # a window that an item repeats is entered once
            order = np.lexsort((rarest, self.length[w], self.item[w], token))
            w, rarest, token = w[order], rarest[order], token[order]
            fresh = np.ones(len(w), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (self.item[w][1:] != self.item[w][:-1]) | (rarest[1:] != rarest[:-1]) | (
                self.length[w][1:] != self.length[w][:-1]
            )
            for i in np.nonzero(~fresh)[0]:
                a, b, n = self.first[w[i - 1]], self.first[w[i]], self.length[w[i]]
                fresh[i] = not np.array_equal(self.words[a : a + n], self.words[b : b + n])
            w, rarest, token = w[fresh], rarest[fresh], token[fresh]
            hashes, starts = np.unique(token, return_index=True)
            self.groups.append(
                Group(
                    Tokens.of(size, hashes), np.append(starts, len(w)), rarest.astype(np.int16), self.first[w].astype(np.int32),
                    self.length[w].astype(np.int16), self.item[w].astype(np.int32)
                )
            )
        self.item = self.first = self.length = None

    def ready(self) -> Block:
        self.leads = [np.unpackbits(g.tokens.lead).view(bool) for g in self.groups]
        return self

    def number(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, ws, repeat(0)), np.uint64, len(ws))

    def scan(self, ws: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Mask of the words of a text that lie in a window, and the items with such windows."""
        numbers, n = self.number(ws), len(ws)
        hit, items = np.zeros(n, bool), []
        for g, lead in zip(self.groups, self.leads, strict=True):
            at, token = g.tokens.find(numbers, lead) if n >= g.tokens.size else ((), ())
            if not len(at):
                continue
            times = g.starts[token + 1] - g.starts[token]
            cuts = np.searchsorted(np.cumsum(times), np.arange(most, int(times.sum()) + most, most))
            for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):  # so many windows are compared at a time
                m = times[lo:hi]
                entry = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(g.starts[token[lo:hi]], m)
                start, length = np.repeat(at[lo:hi], m) - g.offset[entry], g.length[entry].astype(np.int64)
                fits = (start >= 0) & (start + length <= n)
                entry, start, length = entry[fits], start[fits], length[fits]
                for j in range(int(length.max()) if len(length) else 0):
                    same = (length <= j) | (numbers[np.minimum(start + j, n - 1)] == self.words[np.minimum(g.first[entry] + j, len(self.words) - 1)])
                    entry, start, length = entry[same], start[same], length[same]
                for size in np.unique(length):
                    hit |= covered(np.unique(start[length == size]), int(size), n)
                items.append(g.item[entry])
        return hit, np.unique(np.concatenate(items)) if items else np.empty(0, np.int32)


def corpus_counts(docs: DataFrame, block: Block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each token of the block occurs in all texts, by size. The result is as large as the block."""
    tokens = {s: Tokens.of(s, block.all_tokens(s)) for s in block.sizes()}
    held = docs.sparkSession.sparkContext.broadcast((block, tokens))

    def run(batches):
        block, tokens = held.value
        leads, total = {s: np.unpackbits(t.lead).view(bool) for s, t in tokens.items()}, {s: np.zeros(len(t.hashes), np.int64) for s, t in tokens.items()}
        for b in batches:
            for text in b.column("text"):
                numbers = block.number(plain_words(text.as_py()))
                for s, t in tokens.items():
                    if len(numbers) >= s:
                        np.add.at(total[s], t.find(numbers, leads[s])[1], 1)
        for s, n in total.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), s), pa.int64()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["size", "w", "n"]
            )

    rows = docs.select("text").mapInArrow(run, "size long, w long, n long").groupBy("size", "w").agg(F.sum("n").alias("n")).toArrow()
    size, w, n = (rows.column(c).to_numpy() for c in ("size", "w", "n"))
    out = {}
    for s, t in tokens.items():
        often = np.zeros(len(t.hashes), np.int64)
        often[w[size == s]] = n[size == s]
        out[s] = t.hashes, often
    return out


def _benchmark(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Blocks of (item_id, text) of about half of block_bytes; one if the benchmark is not larger than block_bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= block_bytes:
        return [items]
    n = int(-(-2 * size // block_bytes))
    placed = materialize(items.withColumn("block", F.pmod(F.hash("item_id", "text"), F.lit(n))), "benchmark")
    return [placed.where(F.col("block") == i) for i in range(n)]


def _broadcast_block(docs: DataFrame, items: DataFrame, k: int):
    block = Block([(r.item_id, r.text) for r in items.select("item_id", "text").collect()], k)  # at most about block_bytes
    block.order(corpus_counts(docs, block) if block.sizes() else {})
    return docs.sparkSession.sparkContext.broadcast(block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of docs (doc_id, text) that lie in a k-word window of an item of benchmark (item_id, text).

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and
    beyond these hits (positions of the hit words) and items. Null and empty
    texts have no words and no hits; the same text in several items counts for
    each of them; items without an id hit like others and count as one item,
    which items_sha256 and items leave out; repeated documents are judged one by
    one; other columns are ignored. The benchmark's size is checked: it is
    joined in blocks of at most block_bytes of text, each sent to the executors;
    usually that is one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _benchmark(benchmark, block_bytes)
    found = [_join_block(docs, b, k, len(blocks) > 1) for b in blocks]
    merged = found[0]
    if len(found) > 1:
        for f in found[1:]:
            merged = merged.unionByName(f)
        # repeated rows of a document have become one row a block
        merged = merged.groupBy("doc_id", "text_key", "n_words").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.bool_or("unnamed").alias("unnamed"), F.max("copies").alias("copies")
        )
        merged = merged.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return merged.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "hits", "items",
    )


def _join_block(docs: DataFrame, items: DataFrame, k: int, keyed: bool) -> DataFrame:
    held = _broadcast_block(docs, items, k)

    def run(batches):
        block = held.value.ready()
        for b in batches:
            counts, hits, found, unnamed, keys = [], [], [], [], []
            for t in b.column("text"):
                t = t.as_py()
                ws = plain_words(t)
                hit, at = block.scan(ws)
                names = {block.names[i] for i in at.tolist()}
                counts.append(len(ws))
                hits.append(np.nonzero(hit)[0].astype(np.int32))
                found.append(sorted(names - {None}))
                unnamed.append(None in names)
                if keyed:
                    keys.append(hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest())
            columns = [
                b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                pa.array(found, pa.list_(pa.string())), pa.array(unnamed, pa.bool_())
            ]
            yield pa.RecordBatch.from_arrays(
                [*columns, *([pa.array(keys, pa.string())] if keyed else [])],
                names=["doc_id", "n_words", "hits", "items", "unnamed", *(["text_key"] if keyed else [])]
            )

    rows = docs.mapInArrow(run, FOUND + (", text_key string" if keyed else ""))
    if not keyed:
        return rows
    return rows.groupBy("doc_id", "text_key", "n_words").agg(
        F.first("hits").alias("hits"), F.first("items").alias("items"), F.first("unnamed").alias("unnamed"), F.count("*").alias("copies")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no k-word window of the benchmark. Texts are never shuffled."""
    small_batches(docs.sparkSession)
    left, restore = shielded(docs, ["text"])
    names, kinds = left.columns, dict(left.dtypes)
    for items in _benchmark(benchmark, block_bytes):
        held = _broadcast_block(left, items, k)

        def run(batches, held=held):
            block = held.value.ready()
            for b in batches:
                clean = [not len(block.scan(plain_words(t.as_py()))[1]) for t in b.column("text")]
                yield b.filter(pa.array(clean, pa.bool_()))

        left = left.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    return restore(left)
