"""A table of documents with every odd case."""

import random

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, component STRING, q_text STRING, mix_key STRING, kept STRING, k1 STRING, anchor STRING, _times STRING"


def sentence(r, n, stock=400):
    return " ".join(f"w{r.randrange(stock)}" for _ in range(n))


def rows(seed=1):
    r = random.Random(seed)
    base = [sentence(r, r.randrange(5, 160)) for _ in range(40)]
    passage = sentence(r, 60)
    texts = [*base, *base[:5]]  # exact copies
    for t in base[5:15]:  # near copies
        ws = t.split()
        for _ in range(max(1, len(ws) // 60)):
            ws[r.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
    texts += [sentence(r, 20) + "\n" + passage + "\t" + sentence(r, 20) for _ in range(6)]
    texts += [
        "a " * 200, "a b c " * 50, "x", "one two three", "One Two Three", "ONE\ttwo  three", "", None, " \n\t ", None, "日本 語 é É ß " * 12,
        "line\n" * 30, "#$% " * 20
    ]
    texts += [sentence(r, 30_000, 5000)]  # a very long one
    texts += [("é" * 5000 + " ") * 3]
    out = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], None, "c", "q", "m", "k", "1", "a", "t") for i, t in enumerate(texts)]
    r.shuffle(out)
    return out


def docs(spark, more=(), seed=1):
    return spark.createDataFrame([*rows(seed), *more], DOCS).repartition(3)
