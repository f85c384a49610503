"""MinHash near-dedup with an LSH forest.

Each text has a signature of N_HASH minima. Each of TREES orders reads the
signature from another place on, so it begins with values that no other order
begins with. All signatures are sorted in every order; a region is all rows that
begin with the same DEPTH values there, the least depth. A row's candidates are
its neighbours in the order: first those that share its longest prefix, then at
each lesser depth, until one agrees, NEIGHBOURS were looked at, or the region
ends. So depth adapts to how many rows are alike. What these candidates leave
apart in a region is compared as a whole, in one task or, if the region is
crowded, in blocks over many.
Candidates whose signatures agree well enough join a candidate component; within
these, all links are confirmed on the full sets of shingles.
"""

from __future__ import annotations

from collections import deque
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WordHash, materialize, shielded, small_batches, window_hash
from tidewell.llm.components import Forest, connected_components, sorted_intersection

N_HASH, TREES, DEPTH, TAIL = 128, 32, 4, 64
#: Rows of a region from which it is compared in blocks of REGION_BLOCK; smaller ones go row by row.
SMALL_REGION, REGION_BLOCK = 24, 512
#: Rows before it in the order that a row meets at most, and rows of a region that one task compares; what the neighbours
#: leave apart in a larger one meets in pairs of blocks of about CROWDED rows.
NEIGHBOURS, CROWDED = 32, 4096
#: Forest rows for each of the counters by which crowded regions are looked for.
ROWS_A_COUNTER = 1000
#: Agreement of the tail's half-bytes from which a pair is a candidate; a pair at the threshold is 3 deviations above.
AGREE = 0.60
#: Forest rows sorted in one task, at most about.
ROWS_A_PART = 2_000_000
#: Texts compared in one task at a time.
BLOCK = 256
#: Shingles on each side where all blocks of a component meet; a text counts as LEAST_COST at least.
MEET_COST, LEAST_COST = 400_000, 400
#: Rows of ids up to which a table of them is sent to every executor (about 28 MB as Spark holds it); beyond that it is joined by a shuffle.
MOST_BROADCAST = 250_000


def shingles(text: str | None, hashes: WordHash, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of fewer words, the whole sequence is the one shingle."""
    raw = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not raw:
        return np.empty(0, np.uint64)
    return np.unique(window_hash(hashes.of(raw), min(k, len(raw))))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 2**32, N_HASH, np.uint32) | np.uint32(1), r.integers(0, 2**32, N_HASH, np.uint32)


def signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """N_HASH minima, cut to 16 bits."""
    out = np.full(N_HASH, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024, None] * mul + add).min(0), out=out)
    # the high bits of a minimum of many values are mostly zero
    out *= np.uint32(2654435761)
    return (out >> np.uint32(16)).astype(np.uint16)


def with_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): size, 128-bit name and signature of each row's set."""
    small_batches(docs.sparkSession)

    def run(batches):
        import xxhash

        hashes, (mul, add) = WordHash(), _multipliers()
        for b in batches:
            n, k1, k2, sig = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), hashes)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                k1.append(int.from_bytes(d[:8], "little", signed=True))
                k2.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(s, mul, add).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, k1, k2)), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "sig"]
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def forest_rows(sets: DataFrame) -> DataFrame:
    """(place, node): for each order, a key whose bytes sort as the order's signature: tree, DEPTH values, TAIL half-bytes."""

    def run(batches):
        starts = np.arange(TREES) * (N_HASH // TREES)
        head = (starts[:, None] + np.arange(DEPTH)) % N_HASH
        tail = (starts[:, None] + DEPTH + np.arange(TAIL)) % N_HASH
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, N_HASH)
            n = len(sig)
            keys = np.zeros((n, TREES, 1 + 2 * DEPTH + TAIL // 2), np.uint8)
            keys[:, :, 0] = np.arange(TREES)
            keys[:, :, 1 : 1 + 2 * DEPTH] = np.ascontiguousarray(sig[:, head].astype(">u2")).view(np.uint8).reshape(n, TREES, 2 * DEPTH)
            half = (sig[:, tail] & 15).astype(np.uint8)
            keys[:, :, 1 + 2 * DEPTH :] = half[:, :, ::2] << 4 | half[:, :, 1::2]
            flat = keys.reshape(n * TREES, -1)
            node = np.repeat(b.column("node").to_numpy(), TREES)
            buffer, width = flat.tobytes(), flat.shape[1]
            for at in range(0, len(node), 8192):
                part = buffer[at * width : (at + 8192) * width]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[i : i + width] for i in range(0, len(part), width)], pa.binary()),
                        pa.array(node[at : at + 8192], pa.int64())
                    ],
                    names=["place", "node"]
                )

    return sets.mapInArrow(run, "place binary, node long")


_ONES = int("1" * TAIL, 16)


def agreement(a: int, b: int) -> int:
    """How many of the TAIL half-bytes of two tails are equal."""
    x = a ^ b
    x |= x >> 2
    x |= x >> 1
    return TAIL - (x & _ONES).bit_count()


def _by_neighbours(tails: list[bytes], need: int, most: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs (i, j) of each sorted row and the first row before it that agrees in `need` half-bytes, of `most` rows looked at; and labels of what they connect.

    The further back a row lies, the shorter is the prefix that it shares: a step
    back goes to a lesser depth, or stays at one that many rows share.
    """
    label, out = list(range(len(tails))), []
    if len(tails) < SMALL_REGION:
        numbers = [int.from_bytes(t, "big") for t in tails]
        found = ((i, next((j for j in range(i - 1, max(i - 1 - most, -1), -1) if agreement(numbers[j], numbers[i]) >= need), None)) for i in range(1, len(tails)))
        out = [(i, j) for i, j in found if j is not None]
    else:
        x, open_ = _tails(tails), np.arange(1, len(tails))
        for d in range(1, most + 1):
            open_ = open_[open_ >= d]
            if not len(open_):
                break
            differ = np.zeros(len(open_), np.uint8)
            for w in range(x.shape[1]):
                y = x[open_, w] ^ x[open_ - d, w]
                y |= y >> np.uint64(2)
                y |= y >> np.uint64(1)
                differ += np.bitwise_count(y & np.uint64(0x1111111111111111))
            agrees = differ <= TAIL - need
            out += [(int(i), int(i) - d) for i in open_[agrees]]
            open_ = open_[~agrees]
        out.sort()
    for i, j in out:  # each row once, after all before it
        label[i] = label[j]
    return out, label


def _joins_of_few(tails: list[int], need: int, label: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect what pairs that agree in `need` half-bytes connect. Rows of one label are joined already and aren't compared."""
    label, out = list(range(len(tails))) if label is None else list(label), []
    for i, t in enumerate(tails):
        for j in range(i - 1, -1, -1):
            if label[i] != label[j] and agreement(tails[j], t) >= need:
                out.append((i, j))
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return out


def _joins_of_many(tails: np.ndarray, need: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The same for rows of TAIL / 16 unsigned 64-bit numbers, in blocks; blocks of one and the same component aren't compared. Rows of one label are joined already."""
    forest, out, n = Forest(), [], len(tails)
    ones = np.uint64(0x1111111111111111)
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    for start in range(0, n, REGION_BLOCK):
        stop = min(start + REGION_BLOCK, n)
        for first in range(start, -1, -REGION_BLOCK):
            last = min(first + REGION_BLOCK, n)
            here, there = label[start:stop], label[first:last]
            if (there == there[0]).all():
                rows = start + np.nonzero(here != there[0])[0]
            else:
                rows = np.arange(start, stop)
            if not len(rows):
                continue
            differ = np.zeros((len(rows), last - first), np.uint8)
            for w in range(tails.shape[1]):
                x = tails[rows, w][:, None] ^ tails[None, first:last, w]
                x |= x >> np.uint64(2)
                x |= x >> np.uint64(1)
                x &= ones
                differ += np.bitwise_count(x)
            i, j = np.nonzero(differ <= TAIL - need)
            i, j = rows[i], first + j
            apart = label[i] != label[j]
            if not apart.any():
                continue
            i, j = i[apart], j[apart]
            # one pair of each two components that meet here
            _, one = np.unique(np.stack([label[i], label[j]]), axis=1, return_index=True)
            for p, q in zip(i[one].tolist(), j[one].tolist(), strict=True):
                if forest.join(int(label[p]), int(label[q])):
                    out.append((p, q))
            seen, back = np.unique(label, return_inverse=True)
            label = np.fromiter((forest.root(int(x)) for x in seen), np.int64, len(seen))[back]
    return out


def _need(least: float) -> int:
    return int(np.ceil(least * TAIL))


def _tails(tails: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(tails), "<u8").reshape(len(tails), -1)


def neighbour_pairs(rows: DataFrame, least: float = AGREE, crowded: int = CROWDED, most: int | None = None) -> DataFrame:
    """(a, b, rest, place): pairs that connect what all agreeing pairs of each region connect, with rest = false those of neighbours in
    the order and true those that neighbours leave apart; of a region with more than `crowded` rows, its rows instead, as a and
    place. Rows come sorted, a region in one task, which holds `crowded` of them at most."""
    cut, need, most = 1 + 2 * DEPTH, _need(least), NEIGHBOURS if most is None else most

    def joins(tails, nodes):
        near, label = _by_neighbours(tails, need, most)
        rest = []
        if any(x != label[0] for x in label):
            rest = _joins_of_few([int.from_bytes(t, "big") for t in tails], need, label) if len(nodes) < SMALL_REGION else _joins_of_many(_tails(tails), need, np.array(label))
        return [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j]), k, None) for k, found in ((False, near), (True, rest)) for i, j in found if nodes[i] != nodes[j]]

    def run(batches):
        region, tails, nodes, many = None, [], [], False

        def table(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                names=["a", "b", "rest", "place"]
            )

        for batch in batches:
            out = []
            for place, node in zip(batch.column("place").to_pylist(), batch.column("node").to_pylist(), strict=True):
                head = place[:cut]
                if head != region:
                    if len(nodes) > 1:
                        out += joins(tails, nodes)
                    region, tails, nodes, many = head, [], [], False
                if many:
                    out.append((node, None, None, place))
                    continue
                tails.append(place[cut:])
                nodes.append(node)
                if len(nodes) > crowded:
                    out += [(n, None, None, head + t) for n, t in zip(nodes, tails, strict=True)]
                    tails, nodes, many = [], [], True
            yield table(out)
        if len(nodes) > 1:
            yield table(joins(tails, nodes))

    return rows.mapInArrow(run, "a long, b long, rest boolean, place binary")


def crowded_heads(rows: DataFrame, n_rows: int, crowded: int = CROWDED) -> DataFrame:
    """(head): the regions of rows (place, node) with more than `crowded` rows, at most n_rows / crowded of them.

    Rows are first counted by a hash of their head, with about ROWS_A_COUNTER to
    a counter, and then by the head itself where a counter is over the bound.
    """
    head = F.substring("place", 1, 1 + 2 * DEPTH)
    counter = F.pmod(F.xxhash64(head), F.lit(max(1, n_rows // ROWS_A_COUNTER)))
    over = materialize(rows.groupBy(counter.alias("_k")).agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("_k"), "counters")
    if not over.limit(1).count():
        return rows.sparkSession.createDataFrame([], "head binary")
    inside = rows.join(_light(over), counter == F.col("_k"), "left_semi")
    return materialize(inside.groupBy(head.alias("head")).agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("head"), "crowded-heads")


def _nearest(rows: DataFrame, need: int) -> DataFrame:
    """(a, b): each sorted row and the nearest of the rows before it, in its region, with which it agrees."""
    cut = 1 + 2 * DEPTH

    def run(batches):
        region, held = None, deque(maxlen=NEIGHBOURS)
        for batch in batches:
            a, b = [], []
            for place, node in zip(batch.column("place").to_pylist(), batch.column("node").to_pylist(), strict=True):
                if place[:cut] != region:
                    region = place[:cut]
                    held.clear()
                tail = int.from_bytes(place[cut:], "big")
                other = next((n for t, n in reversed(held) if agreement(t, tail) >= need), node)
                if other != node:
                    a.append(max(node, other))
                    b.append(min(node, other))
                held.append((tail, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def crowded_pairs(rows: DataFrame, least: float = AGREE, crowded: int = CROWDED) -> DataFrame:
    """(a, b) that connect what all agreeing pairs of the regions of rows (place, node) connect, with no region in one task."""
    need, cut = _need(least), 1 + 2 * DEPTH
    near = materialize(_nearest(rows.repartitionByRange("place", "node").sortWithinPartitions("place", "node"), need).distinct(), "nearest")
    labels = materialize(connected_components(near), "nearest-components").select(F.col("node").alias("_n"), F.col("component").alias("label"))
    region = F.substring("place", 1, cut).alias("component")
    labelled = materialize(
        rows.join(labels, F.col("node") == F.col("_n"), "left").select(
            "node", region, F.coalesce("label", "node").alias("label"), F.substring("place", cut + 1, TAIL).alias("tail"),
            F.lit(1).alias("cost")
        ),
        "crowded"
    )
    met = _meetings(labelled, crowded)
    if met is None:
        return near
    met = met.repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2")

    def run(batches):
        at, tails, nodes, labels = None, [], [], []

        def result():
            found = _joins_of_many(_tails(tails), need, np.array(labels))
            rows = [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j])) for i, j in found if nodes[i] != nodes[j]]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *key, node, label, tail in zip(*(batch.column(c).to_pylist() for c in ("component", "b1", "b2", "node", "label", "tail")), strict=True):
                if key != at:
                    if nodes:
                        yield result()
                    at, tails, nodes, labels = key, [], [], []
                tails.append(tail)
                nodes.append(node)
                labels.append(label)
        if nodes:
            yield result()

    return near.union(materialize(met.mapInArrow(run, "a long, b long"), "crowded-pairs"))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, with the sizes looked at first."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    i = sorted_intersection(a, b)
    return 100 * i >= percent * (len(a) + len(b) - i)


def block_links(members: list[tuple[int, np.ndarray]], percent: int) -> Forest:
    """Components of the exact links among the members of a block. A member that is already joined to a component isn't compared with the rest of it."""
    forest, groups = Forest(), []
    for node, s in sorted(members, key=lambda m: m[0]):
        forest.root(node)
        joined, apart = [(node, s)], []
        for g in groups:
            if any(n == node or linked(s, other, percent) for n, other in g):
                forest.join(node, g[0][0])
                joined += g
            else:
                apart.append(g)
        groups = sorted([*apart, joined], key=len, reverse=True)
    return forest


def _confirm_blocks(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): node and smallest node of its component within the block, also for nodes alone."""

    def run(batches):
        hashes, at, members = WordHash(), None, []

        def result():
            forest = block_links(members, percent)
            rows = [(x, forest.root(x)) for x in {node for node, _ in members}]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b"])

        for batch in batches:
            for comp, block, node, text in zip(
                batch.column("component").to_pylist(), batch.column("block").to_pylist(), batch.column("node").to_pylist(),
                batch.column("text"), strict=True
            ):
                if (comp, block) != at:
                    if members:
                        yield result()
                    at, members = (comp, block), []
                members.append((node, shingles(text.as_py(), hashes)))
        if members:
            yield result()

    return placed.mapInArrow(run, "a long, b long")


def _light(ids: DataFrame) -> DataFrame:
    """The ids, to be broadcast if they are counted to be few: then the texts that they meet stay where they are."""
    return F.broadcast(ids) if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ids


def _with_text(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    return _light(nodes).join(texts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sorted arrays without repeats, n x n. Slices of the hash range bound the memory."""
    n, total = len(sets), sum(map(len, sets))
    out = np.zeros((n, n), np.int32)
    parts = max(1, -(-total // 500_000))
    edges = [np.uint64(k * (2**64 // parts)) for k in range(1, parts)]
    cuts = [np.concatenate([[0], np.searchsorted(s, np.array(edges, np.uint64)), [len(s)]]).astype(np.int64) for s in sets]
    for k in range(parts):
        pieces = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        value, row = np.concatenate(pieces), np.repeat(np.arange(n), [len(p) for p in pieces])
        order = np.argsort(value, kind="stable")
        value, row = value[order], row[order]
        new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.empty(0, bool)
        column = np.cumsum(new) - 1
        times = np.bincount(column) if len(value) else np.empty(0, np.int64)
        # columns of few rows: their pairs one by one; columns of many rows: products of dense slices
        often = times[column] >= 32 if len(value) else np.empty(0, bool)
        c, r = column[~often], row[~often]
        for d in range(1, 32):
            same = np.nonzero(c[d:] == c[:-d])[0]
            if not len(same):
                break
            pair = r[same] * n + r[same + d]
            if len(pair) * 8 < n * n:
                np.add.at(out.reshape(-1), pair, 1)
            else:
                out += np.bincount(pair, minlength=n * n).reshape(n, n).astype(np.int32)
        c, r = column[often], row[often]
        if len(c):
            c = np.unique(c, return_inverse=True)[1]
            for at in range(0, int(c[-1]) + 1, 2048):
                lo, hi = np.searchsorted(c, [at, at + 2048])
                dense = np.zeros((n, int(c[hi - 1]) - at + 1), np.float32)
                dense[r[lo:hi], c[lo:hi] - at] = 1
                # rows are ascending within a column, so that the pairs above fill the upper half alone
                out += np.triu(dense @ dense.T, 1).astype(np.int32)
    return out + out.T


def cross_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each two labels, one pair of nodes with 100 * intersection >= percent * union, if there is any."""
    both = overlaps(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    ok = 100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both)
    ok &= labels[:, None] > labels[None, :]
    i, j = np.nonzero(ok)
    if not len(i):
        return nodes[:0], nodes[:0]
    _, one = np.unique(np.stack([labels[i], labels[j]]), axis=1, return_index=True)
    return nodes[i[one]], nodes[j[one]]


def _meetings(labelled: DataFrame, most: int) -> DataFrame | None:
    """The rows (node, component, label, cost, ...) with the pairs of blocks b1, b2 in which they meet all rows of other
    labels of their component; None if all have one label. A block costs about `most`."""
    split = labelled.groupBy(F.col("component").alias("_c")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("_c")
    left = materialize(labelled.join(split, F.col("component") == F.col("_c"), "left_semi"), "open")
    if not left.limit(1).count():
        return None
    # a label of many texts has blocks of its own; labels of few share blocks (label null), each label in one
    whole = left.groupBy("component", "label").agg(F.sum("cost").alias("all")).withColumn("own", F.when(F.col("all") * 4 > most, F.col("label")))
    sizes = whole.groupBy("component", "own").agg(F.ceil(F.sum("all") / most).alias("n_blocks"))
    sizes = sizes.select(F.col("component").alias("_c"), F.col("own").alias("_o"), "n_blocks")
    dealer = whole.join(
        sizes, (F.col("component") == F.col("_c")) & F.col("own").eqNullSafe(F.col("_o"))
    ).select(F.col("component").alias("_k"), F.col("label").alias("_l"), "own", "n_blocks")
    salted = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("label")).otherwise(F.col("node"))), F.col("n_blocks"))
    block = F.concat_ws("-", F.coalesce(F.col("own").cast("string"), F.lit("few")), salted.cast("string"))
    placed = left.join(dealer, (F.col("component") == F.col("_k")) & (F.col("label") == F.col("_l"))).select(*left.columns, block.alias("block"))
    placed = materialize(placed, "placed")
    blocks = placed.groupBy("component", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = (
        blocks.select(
            F.col("component").alias(f"c{i}"), F.col("block").alias(f"b{i}"), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")
        ) for i in (1, 2)
    )
    # blocks of one and the same label have nothing to settle
    meets = x.join(y, F.col("c1") == F.col("c2")).where("b1 <= b2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
    meets = meets.select("c1", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("_block"))
    return materialize(placed.join(meets, (F.col("component") == F.col("c1")) & (F.col("block") == F.col("_block"))).select(*left.columns, "b1", "b2"), "meets")


def _meet_all(labelled: DataFrame, sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between nodes of one component whose labels differ; each meets all others, in pairs of blocks. None if all have one label."""
    sizes = sets.select(F.col("doc_id").alias("_s"), "n_shingles")
    cost = labelled.join(sizes, F.col("node") == F.col("_s")).groupBy("node", "component", "label").agg(
        F.greatest(F.max("n_shingles"), F.lit(LEAST_COST)).alias("cost")
    )
    dealt = _meetings(materialize(cost, "costs"), MEET_COST)
    if dealt is None:
        return None
    met = _with_text(dealt.drop("cost"), texts).repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2")

    def run(batches):
        hashes, at, members = WordHash(), None, []

        def result():
            nodes, labels, found = zip(*members, strict=True)
            a, b = cross_links(np.array(nodes), np.array(labels), list(found), percent)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("component", "b1", "b2")), strict=True)
            for key, node, label, text in zip(keys, batch.column("node").to_pylist(), batch.column("label").to_pylist(), batch.column("text"), strict=True):
                if key != at:
                    if members:
                        yield result()
                    at, members = key, []
                members.append((node, label, shingles(text.as_py(), hashes)))
        if members:
            yield result()

    return materialize(met.mapInArrow(run, "a long, b long"), "links")


def _confirm(candidates: DataFrame, sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect what the exact links within candidate components connect.

    Components up to BLOCK texts are compared as a whole. Larger ones are dealt
    over blocks; the blocks' own components then send their smallest node to
    the next, smaller set of blocks, until each component fits in one or
    nothing is linked any more. That joins most of a group of like copies. What
    is still apart after it, in a large component, then meets all of the rest.
    """
    left, links, large = candidates, None, False
    for level in count():
        sizes = left.groupBy("component").agg(F.count("*").alias("size"))
        dealt = left.join(sizes.withColumnRenamed("component", "_c"), F.col("component") == F.col("_c")).where("size > 1")
        dealt = materialize(
            dealt.select(
                "node", "component", "size", F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("size") / BLOCK)).alias("block")
            ),
            "blocks"
        )
        placed = _with_text(dealt.select("node", "component", "block"), texts).repartition("component", "block").sortWithinPartitions("component", "block")
        found = materialize(_confirm_blocks(placed, percent), "links")
        links = found if links is None else links.union(found)
        many = dealt.where(F.col("size") > BLOCK)
        n = many.count()
        if not n:
            break
        large = True
        heads = found.where("a = b").select(F.col("a").alias("_a"))
        rest = materialize(many.join(heads, F.col("node") == F.col("_a")).select("node", "component"), "heads")
        if 2 * rest.count() > n:  # little is linked any more: the rest is settled below
            break
        left = rest
    links = links.where("a <> b")
    if large:
        now = materialize(connected_components(links), "components").select(F.col("node").alias("_n"), F.col("component").alias("label"))
        big = candidates.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select(F.col("component").alias("_c"))
        inside = candidates.join(big, F.col("component") == F.col("_c"), "left_semi")
        labelled = materialize(
            inside.join(now, F.col("node") == F.col("_n"), "left").select("node", "component", F.coalesce("label", "node").alias("label")),
            "labels"
        )
        more = _meet_all(labelled, sets, texts, percent)
        links = links if more is None else links.union(more)
    return links


def candidate_pairs(rows: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b, rest): pairs that connect what all agreeing pairs of each region of rows (place, node) connect; see neighbour_pairs.

    Crowded regions are told by counts, before any task gets a region as a whole.
    """
    n_rows, head = rows.count(), F.substring("place", 1, 1 + 2 * DEPTH)
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // ROWS_A_PART)
    heads = crowded_heads(rows, n_rows, crowded)
    many, few = None, rows
    if heads.limit(1).count():
        heads = _light(heads)
        many, few = rows.join(heads, head == F.col("head"), "left_semi"), rows.join(heads, head == F.col("head"), "left_anti")
    # by the head alone: a region must not be cut
    ordered = few.repartitionByRange(int(width), head).sortWithinPartitions("place", "node")
    pairs = materialize(neighbour_pairs(ordered, crowded=crowded).select("a", "b", "rest").distinct(), "pairs")
    return pairs if many is None else pairs.union(crowded_pairs(materialize(many, "many"), crowded=crowded).select("a", "b", F.lit(True).alias("rest")))


def find_near_duplicates(docs: DataFrame, percent: int = 75, crowded: int = CROWDED) -> DataFrame:
    """Components of the texts of docs (doc_id, text) whose sets of 5-word shingles agree to `percent` per cent or more.

    Returns doc_id, n_shingles, component_id (smallest doc_id that can be
    reached) and kept (doc_id = component_id). Null and empty texts have no
    shingles and are linked with nothing; equal texts and repeated rows are
    linked, whatever their number; rows that share a doc_id are one document; a
    null doc_id has a null component and is kept; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sets = materialize(with_sets(docs), "sets")
    named = sets.where("n_shingles > 0 and doc_id is not null")
    # equal sets have equal signatures; rows that repeat one are not carried further
    groups = materialize(named.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "groups")
    # a doc_id with several different sets is one node
    rows = materialize(forest_rows(groups.select("node", "sig")), "forest")
    pairs = candidate_pairs(rows, crowded).select("a", "b")
    candidates = materialize(connected_components(pairs), "candidates")
    member = _light(candidates.select(F.col("node").alias("_m")))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")
    ).join(member, F.col("node") == F.col("_m"), "left_semi")
    # rows that repeat a document's text are compared once, however many there are
    again = materialize(sets.groupBy(F.col("doc_id").alias("_a")).agg(F.count("*").alias("n")).where("n > 1 and _a is not null").select("_a"), "repeated")
    if again.limit(1).count():
        once = texts.join(again, F.col("node") == F.col("_a"), "left_anti")
        texts = once.union(texts.join(again, F.col("node") == F.col("_a"), "left_semi").dropDuplicates(["node", "text"]))
    links = _confirm(candidates, sets, texts, percent)
    final = connected_components(links).select(F.col("node").alias("_n"), "component")
    known = groups.join(final, F.col("node") == F.col("_n"), "left").where("copies > 1 or component is not null").select(
        F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.coalesce("component", "node").alias("component")
    )
    known = materialize(known, "known")
    slim = sets.select("doc_id", "n_shingles", "k1", "k2")
    joined = slim.join(known, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n_shingles") > 0), "left")
    comp = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, of one document in each component; of rows that repeat it one stays."""
    inner, restore = shielded(docs, ["doc_id", "text"])
    found = find_near_duplicates(inner, percent).where("kept")
    found = materialize(found.groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_times")), "kept")
    out = inner.join(_light(found), F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")))
    again = (F.col("_times") > 1) & F.col("_kept").isNotNull()
    if not found.where(again).limit(1).count():
        return restore(out)
    return restore(out.where(~again)).union(restore(out.where(again).dropDuplicates(["doc_id"])))
