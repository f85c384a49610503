import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from contextlib import nullcontext

import numpy as np
import pytest

from tests.llm.common_rows import DOCS, docs, rows
from tidewell.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(table):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {}
    extra = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(256 + extra)] = b
            extra += 1
    links_of, facts, counts = [], [], Counter()
    for d, t in table:
        a = [(i, bytes(byte_of[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = []
        for i in tb.encode(t or ""):
            p = tb.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()))
        raw = b" " + (t or "").encode()
        if not t or any(b"".join(x for _, x in side) != raw for side in (a, b)):
            links_of.append([])
            facts.append((d, 0, 0, 0, ""))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        owner = np.empty((2, len(raw)), np.int64)
        for s in (0, 1):
            for k, (_, lo, hi) in enumerate(spans[s]):
                owner[s, lo:hi] = k
        links = [(spans[0][x][0], spans[1][y][0]) for x, y in sorted(set(zip(*owner.tolist(), strict=True)))]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        members = [([], []) for _ in cuts]
        for s in (0, 1):
            for i, _, e in spans[s]:
                members[bisect_left(cuts, e)][s].append(str(i))
        groups = ["|".join(map(",".join, m)) for m in members]
        links_of.append(links)
        counts.update(links)
        facts.append((d, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(
        ((d, na, nb, ng, len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), sha)
         for (d, na, nb, ng, sha), ls in zip(facts, links_of, strict=True)), key=repr
    )


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41> plain", "▁ already here", "tabs\t\tand\r\nlines \n\n end ", "   three before", "\U0001f600\U0001f468‍\U0001f469 faces",
    "日本語の文", "café naïve ß", "  nbsp", "a", " ", "\n", "x" * 300, "1234567 89 0.5", "don't we'll I'd", "\x00 null byte \x7f",
]


def _more():
    return [(1000 + i, t, None, None, None, *"abcdefg") for i, t in enumerate(ODD)] + [(None, "null id twice", None, None, None, *"abcdefg")] * 2


def test_matches_brute_force(spark):
    table = [(r[0], r[1]) for r in [*rows(), *_more()]]
    got = sorted((tuple(r) for r in alignment.align(docs(spark, _more()), A, B).collect()), key=repr)
    want = brute(table)
    assert got == want
    assert sum(r[1] == 0 for r in want) >= 4 and sum(r[5] < r[4] for r in want) > 20


@pytest.mark.parametrize(("head", "piece"), [(50, 2 << 20), (0, 700), (10**6, 300)])
def test_rare_pairs_by_shuffle_and_long_texts_in_parts(spark, head, piece):
    """Neither the share of pairs that executors hold nor the cutting of texts changes a row."""
    few = [r for r in [*rows(), *_more()] if len(r[1] or "") < 3000]
    long = [(5000, " ".join(w for r in few for w in (r[1] or "").split(" ")) + " ▁", None, None, None, *"abcdefg"), (5001, " ".join(r[1] or "" for r in few if "▁" not in (r[1] or "")), None, None, None, *"abcdefg")]
    table = [*few, *long]
    df = spark.createDataFrame(table, DOCS).repartition(3)
    got = sorted((tuple(r) for r in alignment.align(df, A, B, most_head=max(1, head), piece=piece).collect()), key=repr)
    want = brute([(r[0], r[1]) for r in table])
    assert got == want
    assert next(r for r in want if r[0] == 5000)[1] == 0 and next(r for r in want if r[0] == 5001)[1] > 1000


def test_forgotten_chunks_are_learned_again(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_chunks", lambda both, real=alignment._Chunks: nullcontext(real(both, 30)))
    got = sorted((tuple(r) for r in alignment.align(docs(spark, _more()), A, B, piece=2000).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in [*rows(), *_more()]])


def test_parts_and_chunks_give_the_text():
    both = alignment.Vocabularies(open(A, encoding="utf-8").read(), open(B, "rb").read())
    for text in [*ODD, *(r[1] or "" for r in rows()), "a  b c\u00a0 d \x1c e\u2003f  "]:
        for size in (1, 7, 10**6):
            parts = both.parts(text, size)
            assert " ".join(parts) == text and " ".join(c for p in parts for c in both.chunks(p)) == text


def test_partial_counts_are_handed_on(spark):
    definition, model = open(A, encoding="utf-8").read(), open(B, "rb").read()
    df = docs(spark)
    few, once = (alignment.link_texts(df, definition, model, held=h) for h in (20, 10**6))
    assert few.where("not whole").count() >= once.where("not whole").count() == 3
    key = lambda x: sorted(tuple(r) for r in alignment.pair_counts(x).collect())
    assert key(few) == key(once)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).count() == 0
