import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common_rows import DOCS, docs, rows
from tidewell.llm import near_dedup, substring_dedup
from tidewell.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_components(table, percent=75):
    sets = {}
    for d, t in table:
        w = WORD.findall(lower(t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = defaultdict(list)
    for d in sorted(sets):
        c = Counter(o for s in sets[d] for o in seen[s])
        for s in sets[d]:
            seen[s].append(d)
        for o, n in c.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = root(d), root(o)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def test_near_dedup_matches_brute_force(spark):
    want = brute_components([(r[0], r[1]) for r in rows()])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.find_near_duplicates(docs(spark)).collect()}
    assert got == want
    assert sum(not k for *_, k in got.values()) >= 10


def test_near_dedup_of_large_groups(spark, monkeypatch):
    """Groups of more than a block: copies of one text with an edit each, a chain of texts, and texts that only share a passage."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"w{i}" for i in range(80)]
    table = [(i, " ".join([*base[:i], "edit", *base[i + 1 :]])) for i in range(0, 78, 2)]
    table += [(100 + i, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 60))) for i in range(30)]
    table += [(200 + i, " ".join([*(f"p{j}" for j in range(30)), *(f"q{i}-{j}" for j in range(30))])) for i in range(12)]
    df = spark.createDataFrame(table, "doc_id BIGINT, text STRING").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.find_near_duplicates(df).collect()}
    assert got == brute_components(table)


def test_near_dedup_star_of_edited_copies(spark):
    """Copies that are linked with their original alone, which has the largest id."""
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(204)]
    table = [(5000, " ".join(base))]
    for i in range(1200):
        ws = list(base)
        for j in r.choice(25, 5, replace=False):
            ws[4 + 8 * j] = f"edit{i}-{j}"
        table.append((i, " ".join(ws)))
    sets = {d: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t in table}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(share(i, 5000) >= 0.75 for i in range(1200))
    assert np.mean([share(int(a), int(b)) < 0.75 for a, b in r.integers(0, 1200, (300, 2)) if a != b]) > 0.95
    df = spark.createDataFrame(table, "doc_id BIGINT, text STRING").repartition(4)
    assert {r.component_id for r in near_dedup.find_near_duplicates(df).collect()} == {0}


@pytest.mark.parametrize("crowded", [1, 7, 40])
def test_crowded_regions_lose_nothing(spark, monkeypatch, crowded):
    """Copies of several templates whose regions are all over the bound: components are those of the exact links."""
    monkeypatch.setattr(near_dedup, "NEIGHBOURS", 2)
    r = np.random.default_rng(5)
    table = []
    for t in range(3):
        base = [f"t{t}w{j}" for j in range(90)]
        for i in range(60):
            at = r.choice(90, 1 + i % 4, replace=False)
            table.append((len(table), " ".join(f"e{i}" if j in at else w for j, w in enumerate(base))))
    table += [(1000 + i, " ".join(f"alone{i}x{j}" for j in range(30))) for i in range(40)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.find_near_duplicates(df, crowded=crowded).collect()}
    assert got == {d: c for d, (_, c, _) in brute_components(table).items()}


def test_crowded_pairs_join_what_a_region_joins(spark):
    r = np.random.default_rng(6)
    sigs = r.integers(0, 65536, (120, near_dedup.N_HASH)).astype(np.uint16)
    for i in range(120):
        sigs[i, 10:24] = sigs[0, 10:24]  # one region of several orders, whatever the rest
        if i > 20:
            sigs[i] = np.where(r.random(near_dedup.N_HASH) < 0.7, sigs[r.integers(0, i)], sigs[i])
            sigs[i, 10:24] = sigs[0, 10:24]
    rows = near_dedup.forest_rows(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sigs)], "node long, sig binary")).cache()
    ordered = rows.repartition(F.substring("place", 1, 9)).sortWithinPartitions("place", "node")

    def components(pairs):
        forest = near_dedup.Forest()
        for p in pairs:
            forest.join(p.a, p.b)
        return [forest.root(i) for i in range(120)]

    whole = near_dedup.neighbour_pairs(ordered)
    assert whole.where("place is not null").count() == 0
    want = components(whole.collect())
    cut = near_dedup.neighbour_pairs(ordered, crowded=10).cache()
    many = cut.where("place is not null").selectExpr("place", "a as node")
    assert many.count() >= 120
    assert components([*cut.where("b is not null").collect(), *near_dedup.crowded_pairs(many, crowded=10).collect()]) == want and len(set(want)) > 5


def test_documents_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(40)) for x in "abc")
    table = [(3, a), (3, b), (5, a + " end"), (6, "start " + b), (7, c)]
    got = {(r.doc_id, r.component_id) for r in near_dedup.find_near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (5, 3), (6, 3), (7, 7)}


def test_a_repeated_row_is_compared_once(spark, monkeypatch):
    seen = []
    confirm = near_dedup._confirm
    monkeypatch.setattr(near_dedup, "_confirm", lambda c, s, texts, p: seen.append(texts.where("node = 3").count()) or confirm(c, s, texts, p))
    a = [f"w{j}" for j in range(60)]
    table = [(3, " ".join(a))] * 400 + [
        (4, " ".join([*a[:58], "x", "y"])), (5, " ".join(a[::-1])), (3, "another text of three"), (None, " ".join(a))
    ] + [(8, "some text " * 9)] * 50
    got = {
        (r.doc_id, r.component_id, r.kept) for r in near_dedup.find_near_duplicates(
            spark.createDataFrame(table, "doc_id long, text string").repartition(5)
        ).collect()
    }
    assert got == {(3, 3, True), (4, 3, False), (5, 5, True), (8, 8, True), (None, None, True)} and seen == [2]


def test_joins_within_a_region(monkeypatch):
    """Every agreeing pair of a region counts, however many rows lie between its two."""
    monkeypatch.setattr(near_dedup, "REGION_BLOCK", 16)
    r = np.random.default_rng(12)
    rows = r.integers(0, 16, (150, near_dedup.TAIL))
    for i in range(0, 150, 3):
        rows[i] = np.where(r.random(near_dedup.TAIL) < 0.8, rows[r.integers(0, 150)], rows[i])
    tails = [bytes((x[::2] << 4 | x[1::2]).astype(np.uint8)) for x in rows]
    need = 39

    def components(pairs):
        forest = near_dedup.Forest()
        for i, j in pairs:
            forest.join(i, j)
        return [forest.root(i) for i in range(150)]

    want = components((i, j) for i in range(150) for j in range(i) if (rows[i] == rows[j]).sum() >= need)
    assert len(set(want)) < 150
    assert components(near_dedup._joins_of_few([int.from_bytes(t, "big") for t in tails], need)) == want
    assert components(near_dedup._joins_of_many(np.frombuffer(b"".join(tails), "<u8").reshape(150, -1), need)) == want


def test_overlaps():
    r = np.random.default_rng(13)
    stock = r.integers(0, 2**64, 3000, np.uint64)
    sets = [np.unique(r.choice(stock, n)) for n in (0, 1, 50, 700, 2500, 9000)] + [
        np.unique(np.concatenate([stock[:40], r.choice(stock, 30)])) for _ in range(60)
    ]
    sets += [np.unique(r.integers(0, 2**64, 300_000, np.uint64)) for _ in range(2)]
    got = near_dedup.overlaps(sets)
    assert all(got[i, j] == (len(np.intersect1d(sets[i], sets[j])) if i != j else 0) for i in range(len(sets)) for j in range(len(sets)))


def test_near_dedup_repeated_rows_nulls_and_empty(spark):
    more = [r for r in rows() if r[0] < 4] + [(None, "no id at all here", None, None, None, *"abcdefg")]
    df = docs(spark, more)
    out = near_dedup.find_near_duplicates(df)
    assert out.count() == df.count()
    n = out.where("doc_id is null").first()
    assert n.component_id is None and n.kept
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r.doc_id for r in out.where("kept").collect()}
    none = spark.createDataFrame([], DOCS)
    assert near_dedup.find_near_duplicates(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_agreement_and_signatures():
    assert near_dedup.agreement(0, 0) == near_dedup.TAIL
    assert near_dedup.agreement(0x8, 0) == near_dedup.TAIL - 1
    assert near_dedup.agreement(int("f" * near_dedup.TAIL, 16), 0) == 0
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
    y = np.unique(np.concatenate([x[:857], r.integers(0, 2**63, 143).astype(np.uint64)]))
    mul, add = near_dedup._multipliers()
    share = np.mean(near_dedup.signature(x, mul, add) == near_dedup.signature(y, mul, add))
    assert abs(share - 0.75) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, 1), (9, 5), (1, 7), (3, 3), (None, 4)]
    df = spark.createDataFrame(edges, "a BIGINT, b BIGINT").repartition(4)
    for most in (1000, 20):
        got = {r.node: r.component for r in connected_components(df, most).collect()}
        assert got == {i: 200 for i in range(200, 261)} | {1: 1, 5: 1, 7: 1, 9: 1}
    assert connected_components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def brute_substrings(table, n=35):
    ws = [WORD.findall(t or "") for _, t in table]
    c = Counter(tuple(w[i : i + n]) for w in ws for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(table, ws, strict=True):
        gone = {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [substring_dedup.SHARD_BYTES, 300])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(substring_dedup.repeated_spans, "__defaults__", (35, shard))
    more = [r for r in rows() if r[0] in (3, 60)] + [(None, "null id " * 30, None, None, None, *"abcdefg"), (3, "w " * 36, None, None, None, *"abcdefg")]
    df = docs(spark, more)
    got = sorted(
        (
            (
                r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text or ""
            ) for r in substring_dedup.remove_repeats(df, with_text=True).collect()
        ),
        key=repr
    )
    assert got == brute_substrings([(r[0], r[1]) for r in [*rows(), *more]])


def test_substring_dedup_other_lengths_and_empty(spark):
    table = [(r[0], r[1]) for r in rows() if r[1] is None or len(r[1]) < 20_000]
    df = spark.createDataFrame(table, "doc_id BIGINT, text STRING")
    for n in (8, 70):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, n).collect()), key=repr)
        assert got == [x[:4] for x in brute_substrings(table, n)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_automaton():
    r = np.random.default_rng(2)
    for _ in range(60):
        rows = [list(r.integers(0, 2, r.integers(1, 14))) for _ in range(r.integers(1, 5))]
        times = r.integers(1, 3, len(rows))
        a = substring_dedup.SuffixAutomaton()
        for x, t in zip(rows, times, strict=True):
            a.add(x, int(t))
        a.finish()
        c = Counter()
        for x, t in zip(rows, times, strict=True):
            for i in range(len(x) - 3):
                c[tuple(x[i : i + 4])] += t
        for x in rows:
            assert a.repeats(x, 4) == [i for i in range(len(x) - 3) if c[tuple(x[i : i + 4])] > 1]


def test_anchors_in_blocks():
    h = np.random.default_rng(3).integers(0, 2**63, 500).astype(np.uint64)
    a, first, last = substring_dedup.anchors(h, 35)
    assert first[0] == 0 and last[-1] == 465 and (first[1:] == last[:-1] + 1).all()
    b, f, z = substring_dedup.anchors(h, 35, block=50)
    per = lambda a, f, z: np.repeat(a, z - f + 1)
    assert (per(a, first, last) == per(b, f, z)).all()


def test_neighbours_of_the_order_carry_the_result(spark, sf_dir):
    """Of what all pairs of all regions connect, neighbours in the sorted orders alone connect nearly everything."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = near_dedup.with_sets(d).where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    pairs = near_dedup.candidate_pairs(near_dedup.forest_rows(sets).cache()).collect()

    def joined(rows):
        forest = near_dedup.Forest()
        return sum(forest.join(p.a, p.b) for p in rows)

    assert joined([p for p in pairs if not p.rest]) >= 0.98 * joined(pairs) > 0


def test_depth_adapts_to_like_rows():
    """Rows of one deep prefix meet each other first; a row that agrees with a farther one goes back to it, as far as it may."""
    r = np.random.default_rng(2)
    base = r.integers(0, 256, 32).astype(np.uint8)
    far = base.copy()
    far[10:] = r.integers(0, 256, 22)
    rows = sorted([bytes(base), bytes(base), *(bytes([*base[:31], x]) for x in (1, 200)), bytes(far), bytes(r.integers(0, 256, 32).astype(np.uint8))])
    for tails in (rows, rows + [bytes([255] * 31 + [i]) for i in range(60)]):
        pairs, label = near_dedup._by_neighbours(tails, 39, 4)
        alike = [i for i, t in enumerate(tails) if t[:30] == bytes(base[:30])]
        assert len({label[i] for i in alike}) == 1 and {p for p in pairs if p[0] in alike} == {(i, i - 1) for i in alike[1:]}
        assert label[tails.index(bytes(far))] not in {label[i] for i in alike}


@pytest.mark.parametrize("n", [10, 23, 24, 150])
def test_neighbours_and_the_rest_join_what_all_pairs_join(n):
    r = np.random.default_rng(n)
    tails = [r.integers(0, 2, 32).astype(np.uint8) * 17]
    for _ in range(n - 1):
        t = tails[r.integers(0, len(tails))].copy()
        at = r.choice(32, 12, replace=False)
        t[at] = r.integers(0, 256, 12)
        tails.append(t)
    tails, need = sorted(bytes(t) for t in tails), 39

    def components(pairs):
        forest = near_dedup.Forest()
        for i, j in pairs:
            forest.join(i, j)
        return [forest.root(i) for i in range(n)]

    numbers = [int.from_bytes(t, "big") for t in tails]
    want = components([(i, j) for i in range(n) for j in range(i) if near_dedup.agreement(numbers[i], numbers[j]) >= need])
    for most in (1, 3, 32):
        near, label = near_dedup._by_neighbours(tails, need, most)
        rest = near_dedup._joins_of_few(numbers, need, label) if n < 24 else near_dedup._joins_of_many(near_dedup._tails(tails), need, np.array(label))
        assert all(near_dedup.agreement(numbers[i], numbers[j]) >= need for i, j in near)
        assert components([*near, *rest]) == want


def test_crowded_regions_are_counted_first(spark, monkeypatch):
    """A region over the bound is told by counts and gets to no task as a whole; regions that share its counter stay."""
    monkeypatch.setattr(near_dedup, "ROWS_A_COUNTER", 40)
    place = lambda head, i: bytearray(bytes([0]) + bytes(8 * [head]) + i.to_bytes(32, "big"))
    rows = [(place(1, i), i) for i in range(30)] + [(place(2 + i % 50, i), 100 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "place binary, node long").repartition(3)
    assert [bytes(x.head)[1] for x in near_dedup.crowded_heads(df, len(rows), 20).collect()] == [1]
    assert near_dedup.crowded_heads(df, len(rows), 30).count() == 0
    met = []
    real = near_dedup.neighbour_pairs
    monkeypatch.setattr(near_dedup, "neighbour_pairs", lambda few, **how: met.append(few.where(F.substring("place", 2, 1) == bytearray([1])).count()) or real(few, **how))
    near_dedup.candidate_pairs(df, 20).count()
    assert met == [0]


def test_pairs_just_over_the_threshold_are_found(spark):
    """300 pairs with a similarity of 0.75 to 0.80, each edited in several places: all are found."""
    r = np.random.default_rng(9)
    table, n = [], 0
    while n < 300:
        words = [f"p{n}w{i}" for i in range(int(r.integers(60, 400)))]
        edited = list(words)
        at = r.choice(len(words), max(1, int(len(words) * r.uniform(0.02, 0.035))), replace=False)
        for i in at:
            edited[i] = f"e{i}"
        a, b = (set(zip(*(x[k:] for k in range(5)), strict=False)) for x in (words, edited))
        if 0.75 <= len(a & b) / len(a | b) <= 0.80:
            table += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(edited))]
            n += 1
    got = {x.doc_id: x.component_id for x in near_dedup.find_near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: d - d % 2 for d, _ in table}
