import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import common, decontaminate, near_dedup, pii, quality, substring_dedup
from tidewell.llm.components import Forest, sorted_intersection

texts = st.text(alphabet="ab@.-+ 0123\n\té_%#", max_size=80)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@given(texts)
@settings(max_examples=400, deadline=None)
def test_proposed_spans_are_those_of_the_plain_expressions(text):
    spans = pii.base_spans(text)
    assert [(a, b) for a, k, b in spans if k == "email"] == [m.span() for m in EMAIL.finditer(text)]
    assert [(a, b) for a, k, b in spans if k == "ip"] == [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_words(text):
    assert [w.decode("utf-8", "surrogatepass") for w in common.words(text)] == re.findall(r"[^\x20\x09-\x0D]+", text)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode("utf-8", "surrogatepass") for w in common.plain_words(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@given(st.lists(st.lists(st.integers(0, 2), max_size=20), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_automaton_counts(rows, n):
    a = substring_dedup.SuffixAutomaton()
    for r in rows:
        a.add(r)
    a.finish()
    every = [tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1)]
    for r in rows:
        assert a.repeats(r, n) == [i for i in range(len(r) - n + 1) if every.count(tuple(r[i : i + n])) > 1]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(8, 40))
@settings(max_examples=200, deadline=None)
def test_equal_windows_pick_equal_anchors(ids, n):
    h = common.mix64(np.array(ids, np.uint64) + np.uint64(7))
    anchor, first, last = substring_dedup.anchors(h, n)
    picked = {}
    for a, lo, hi in zip(anchor, first, last, strict=True):
        for i in range(lo, hi + 1):
            assert picked.setdefault(tuple(ids[i : i + n]), a) == a
    assert sum(last - first + 1) == max(0, len(ids) - n + 1)


@given(st.lists(st.integers(0, 30), max_size=30), st.lists(st.integers(0, 30), max_size=30))
@settings(max_examples=200, deadline=None)
def test_links(a, b):
    x, y = np.unique(np.array(a, np.uint64)), np.unique(np.array(b, np.uint64))
    i = len(set(a) & set(b))
    assert sorted_intersection(x, y) == i
    assert near_dedup.linked(x, y, 75) == (100 * i >= 75 * len(set(a) | set(b)))


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_forest(edges):
    f = Forest()
    for a, b in edges:
        f.join(a, b)
    for x in {v for e in edges for v in e}:
        group = {x}
        while True:
            more = {v for e in edges for v in e if group & set(e)} | group
            if more == group:
                break
            group = more
        assert f.root(x) == min(group)


@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_contamination(doc, items, k):
    rows = [(str(i), " ".join(t)) for i, t in enumerate(items)]
    ws = [w.encode() for w in doc]
    block = decontaminate.Block(rows, k)
    r = np.random.default_rng(len(doc))
    tokens = {s: block.all_tokens(s) for s in block.sizes()}
    block.order({s: (t, r.integers(0, 3, len(t))) for s, t in tokens.items()})
    hit, at = block.ready().scan(ws, most=7)
    names = {block.names[i] for i in at}
    want, found = set(), set()
    for i, t in enumerate(items):
        n = min(k, len(t))
        if not n:
            continue
        for s in {tuple(t[j : j + n]) for j in range(len(t) - n + 1)}:
            for j in range(len(doc) - n + 1):
                if tuple(doc[j : j + n]) == s:
                    want.update(range(j, j + n))
                    found.add(str(i))
    assert set(np.nonzero(hit)[0].tolist()) == want and names == found


@given(st.text(alphabet="ab \n#", max_size=80))
@settings(max_examples=200, deadline=None)
def test_repeats_and_lines(text):
    n, chars, signs, dup, lines, rep = quality.text_counts(text, common.WordHash())
    w = text.split()
    assert (n, chars) == (len(w), sum(map(len, w)))
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    assert rep == len({j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + 5)})
    full = [x for x in text.split("\n") if x.split()]
    assert (dup, lines) == (len(full) - len(set(full)), len(full)) and (not n or signs == text.count("#"))
