"""Substring dedup: suffix automata of reference shards find the passages that stand elsewhere too.

Streaming all documents past all automata would take time in the square of the
corpus, and a set of automata that grows with the corpus can't be sent to every
executor. So the reference is cut into shards by anchor, and a passage meets
only the shard that can hold its equal:

1. Each window of the threshold's length picks an anchor, the least hash among
   its short word sequences. Equal windows pick equal anchors, and consecutive
   windows mostly the same one: a run of them is a span.
2. Spans whose anchor occurs once have no equal. The rest are cut from the
   texts, and equal ones are counted once with their number.
3. A shard holds spans of some anchors. A generalized suffix automaton of the
   shard counts the occurrences of each of its substrings; streaming the spans
   through it gives for each place the longest suffix of at least the
   threshold's length and how often it occurs.
4. Places with two or more occurrences are the removed spans.

An anchor whose different spans do not fit in one shard is dealt over several.
What repeats within a shard is settled there; each different window of such a
shard is then counted once across shards, so no group grows with the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WordHash, covered, materialize, small_batches, window_hash, words

#: Words of an anchor's sequence.
ANCHOR = 6
#: Bytes of different spans after which a new automaton is begun; an anchor with more than that is dealt over several.
SHARD_BYTES = 128 << 10

_LOW = np.uint64((1 << 26) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m, s = x, 1
    while s * 2 <= w:
        m, s = np.minimum(m[:-s], m[s:]), s * 2
    n = len(x) - w + 1
    return np.minimum(m[:n], m[w - s : w - s + n])


def anchors(h: np.ndarray, length: int, block: int = 1 << 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows that pick the same place."""
    k = max(ANCHOR, length - 61)
    parts = [_anchors(h[a : a + block + length - 1], length, k, a) for a in range(0, max(1, len(h) - length + 1), block)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(h: np.ndarray, length: int, k: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(h) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = window_hash(h, k)
    # the place breaks ties towards the left, alike in equal windows
    place = (sliding_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), length - k + 1) & _LOW).astype(np.int64)
    first = np.nonzero(np.diff(place, prepend=-1))[0]
    return g[place[first]], first + start, np.append(first[1:], len(place)) - 1 + start


class SuffixAutomaton:
    """Of several word sequences; counts[s] is how often the substrings of state s occur."""

    def __init__(self):
        self.next, self.link, self.length, self.counts = [{}], [-1], [0], [0]

    def add(self, sequence: list, times: int = 1) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.counts[last] += times

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        self.counts.append(0)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.counts.append(0)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def finish(self) -> None:
        counts, link = self.counts, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if link[s] > 0:
                counts[link[s]] += counts[s]

    def repeats(self, sequence: list, least: int) -> list[int]:
        """Starts of the length-`least` parts of a sequence that occur twice or more in the automaton."""
        nxt, link, length, counts = self.next, self.link, self.length, self.counts
        out, s, n = [], 0, 0
        for i, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            s = nxt[s].get(c, 0)
            n = n + 1 if s else 0
            while n >= least and length[link[s]] >= least:
                s = link[s]
                n = length[s]
            if n >= least and counts[s] > 1:
                out.append(i - least + 1)
        return out


def shard_repeats(spans: list[tuple[bytes, int]], least: int) -> list[int]:
    """For each (span, times): a bit for each of its windows that occurs twice or more in the shard."""
    numbers: dict[bytes, int] = {}
    rows = [[numbers.setdefault(w, len(numbers)) for w in s.split(b" ")] for s, _ in spans]
    automaton = SuffixAutomaton()
    for row, (_, times) in zip(rows, spans, strict=True):
        automaton.add(row, times)
    automaton.finish()
    return [sum(1 << i for i in automaton.repeats(row, least)) for row in rows]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of the text: together they name a text."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return t.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))


def _all_anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        hashes = WordHash()
        for b in batches:
            parts = []
            for i, t in enumerate(b.column("text")):
                a, first, last = anchors(hashes.of(words(t.as_py())), length)
                if len(a):
                    parts.append((np.full(len(a), i), a.view(np.int64), first << 6 | (last - first)))
            if parts:
                at, a, w = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(at)) for c in ("doc_id", "k1", "k2")), pa.array(a), pa.array(w)],
                    names=["doc_id", "k1", "k2", "anchor", "run"]
                )

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, anchor long, run long")


def _cut_spans(listed: DataFrame, length: int) -> DataFrame:
    """One row per run of a document: its anchor and its words."""

    def run(batches):
        for b in batches:
            at, out_anchor, out_first, out_span = [], [], [], []
            for i, (t, runs) in enumerate(zip(b.column("text"), b.column("runs"), strict=True)):
                ws = words(t.as_py())
                for anchor, r in sorted(((r["anchor"], r["run"]) for r in runs.as_py()), key=lambda x: x[1]):
                    first, more = r >> 6, r & 63
                    at.append(i)
                    out_anchor.append(anchor)
                    out_first.append(first)
                    out_span.append(b" ".join(ws[first : first + more + length]))
                if len(at) > 20_000:
                    yield _spans(b, at, out_anchor, out_first, out_span)
                    at, out_anchor, out_first, out_span = [], [], [], []
            yield _spans(b, at, out_anchor, out_first, out_span)

    return listed.mapInArrow(run, "doc_id long, k1 long, k2 long, own boolean, anchor long, first long, span binary")


def _spans(b, at, anchor, first, span):
    return pa.RecordBatch.from_arrays(
        [
            *(b.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "k1", "k2", "own")), pa.array(anchor, pa.int64()),
            pa.array(first, pa.int64()), pa.array(span, pa.binary())
        ],
        names=["doc_id", "k1", "k2", "own", "anchor", "first", "span"]
    )


SHARD_ROWS = "s1 long, s2 long, bits long, w1 long, w2 long, n long"


def _by_automata(grouped: DataFrame, length: int) -> DataFrame:
    """Rows (s1, s2, bits) of the windows of a span that repeat within its shard, and rows (w1, w2, n) of the windows of
    anchors dealt over several shards, with the one span and bit where such a window occurs once in its shard.

    The spans come sorted by anchor and part; whole parts are gathered into shards of about SHARD_BYTES.
    """

    def run(batches):
        import xxhash

        shard, held, at = [], 0, None

        def results():
            rows, seen = [], set()
            for (s1, s2, span, n, dealt), bits in zip(shard, shard_repeats([x[2:4] for x in shard], length), strict=True):
                if bits:
                    rows.append((s1, s2, bits, None, None, None))
                if not dealt:
                    continue
                ws = span.split(b" ")
                for i in range(len(ws) - length + 1):
                    d = xxhash.xxh3_128_digest(b" ".join(ws[i : i + length]))
                    w = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                    if not bits >> i & 1:
                        rows.append((s1, s2, 1 << i, *w, n))
                    elif w not in seen:
                        seen.add(w)
                        rows.append((None, None, None, *w, 2))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)],
                names=["s1", "s2", "bits", "w1", "w2", "n"]
            )

        for b in batches:
            for s1, s2, anchor, part, dealt, span, n in zip(
                *(b.column(c).to_pylist() for c in ("s1", "s2", "anchor", "part", "dealt", "span", "n")), strict=True
            ):
                if held >= SHARD_BYTES and (anchor, part) != at:
                    yield results()
                    shard, held = [], 0
                at = anchor, part
                shard.append((s1, s2, span, n, dealt))
                held += len(span)
        if shard:
            yield results()

    return grouped.mapInArrow(run, SHARD_ROWS)


def repeated_spans(docs: DataFrame, length: int = 35, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(groups, places): how often each text occurs, and (doc_id, k1, k2, starts) of the windows that occur elsewhere too.

    Of equal texts one stands for all in the shards; their own windows are
    repeated anyway. `docs` comes from _keyed.
    """
    slim = docs.select("doc_id", "k1", "k2").where("text is not null") if "text" in docs.columns else docs
    groups = materialize(slim.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("keeper")), "texts")
    found = materialize(_all_anchors(docs, length), "anchors")
    # tables of counts are written before they are joined, so that both sides of a join come from shuffles and a frequent key can be split
    again = materialize(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select(F.col("anchor").alias("a")), "anchor-counts")
    # as a set: a row that is repeated names the same runs each time
    lists = found.join(again, F.col("anchor") == F.col("a")).groupBy("doc_id", "k1", "k2").agg(F.collect_set(F.struct("anchor", "run")).alias("runs"))
    # a text with copies is read once, and only to be compared with others
    lists = lists.join(groups, ["k1", "k2"]).where(
        F.col("copies").eqNullSafe(1) | F.col("doc_id").eqNullSafe(F.col("keeper"))
    ).select("doc_id", "k1", "k2", "runs", (F.col("copies") == 1).alias("own"))
    lists = materialize(lists, "runs")
    d, l = docs.alias("d"), lists.alias("l")
    listed = d.join(
        l, (F.col("d.k1") == F.col("l.k1")) & (F.col("d.k2") == F.col("l.k2")) & F.col("d.doc_id").eqNullSafe(F.col("l.doc_id"))
    ).select("d.doc_id", "d.k1", "d.k2", "d.text", "l.runs", "l.own")
    names = [F.xxhash64("span").alias("s1"), F.xxhash64(F.lit(1), "span").alias("s2")]
    spans = materialize(_cut_spans(listed, length), "spans")
    kinds = materialize(spans.groupBy("anchor", "span").agg(F.count("*").alias("n")).select(*names, "anchor", "span", "n"), "span-kinds")
    sizes = materialize(
        kinds.groupBy("anchor").agg(
            F.sum(F.octet_length("span")).alias("m"), F.sum("n").alias("t")
        ).select(F.col("anchor").alias("a"), "m", "t"),
        "anchor-sizes"
    )
    sized = kinds.join(sizes, F.col("anchor") == F.col("a")).where("t > 1")
    parts = F.ceil(F.col("m") / F.lit(shard_bytes))
    dealt = sized.select(
        "s1", "s2", "anchor", F.pmod(F.xxhash64("s1", "s2"), parts).alias("part"), (parts > 1).alias("dealt"), "span", "n"
    ).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    found = materialize(_by_automata(dealt, length), "repeats")
    windows = found.where("w1 is not null")
    counts = materialize(
        windows.groupBy("w1", "w2").agg(F.sum("n").alias("t")).where("t > 1").select(F.col("w1").alias("v1"), F.col("w2").alias("v2")),
        "window-counts"
    )
    across = windows.where("s1 is not null").join(counts, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).select("s1", "s2", "bits")
    bits = materialize(found.where("w1 is null").select("s1", "s2", "bits").union(across).groupBy("s1", "s2").agg(F.sum("bits").alias("bits")), "bits")
    places = spans.where("own").select("doc_id", "k1", "k2", "first", *names).join(bits, ["s1", "s2"])
    starts = F.expr("transform(filter(sequence(0, 62), i -> (shiftright(bits, i) & 1L) = 1L), i -> first + i)")
    return groups, places.select("doc_id", "k1", "k2", starts.alias("starts")).groupBy("doc_id", "k1", "k2").agg(
        F.flatten(F.collect_list("starts")).alias("starts")
    )


def remove_repeats(docs: DataFrame, length: int = 35, with_text: bool = False) -> DataFrame:
    """Remove from docs (doc_id, text) each word in a `length`-word window that starts anywhere else too.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words
    joined by spaces); with_text adds kept_text. Windows are judged on the
    input, so of equal windows none is kept. Null and empty texts have no
    words; a repeated row is a copy; texts shorter than a window keep all their
    words; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = _keyed(docs)
    groups, places = repeated_spans(docs, length)
    p, g, d = places.alias("p"), groups.where("copies > 1").alias("g"), docs.alias("d")
    known = (
        docs.select("doc_id", "k1", "k2").distinct().alias("d")
        .join(g, ["k1", "k2"], "left")
        .join(p, (F.col("d.k1") == F.col("p.k1")) & (F.col("d.k2") == F.col("p.k2")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), "left")
        .where("copies is not null or starts is not null")
        .select("d.doc_id", "d.k1", "d.k2", F.col("copies").isNotNull().alias("copied"), "starts")
    )
    k, d = materialize(known, "removals").alias("k"), docs.alias("d")
    joined = d.join(
        k, (F.col("d.k1") == F.col("k.k1")) & (F.col("d.k2") == F.col("k.k2")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left"
    ).select("d.doc_id", "d.text", "copied", "starts")

    def run(batches):
        for b in batches:
            counts, removed, digests, texts = [], [], [], []
            for t, copied, starts in zip(b.column("text"), b.column("copied"), b.column("starts"), strict=True):
                ws = words(t.as_py())
                n, kept = len(ws), ws
                if copied.as_py() and n >= length:
                    kept = []
                elif starts.is_valid and not copied.as_py():
                    gone = covered(starts.values.to_numpy(), length, n)
                    kept = [ws[i] for i in np.nonzero(~gone)[0]]
                counts.append(n)
                removed.append(n - len(kept))
                out = b" ".join(kept)
                digests.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    texts.append(None if not t.is_valid else out.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                    *([pa.array(texts, pa.string())] if with_text else [])
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
