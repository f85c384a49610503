"""Decks in byte ranges give what the parser of whole files gives, errors included."""

import numpy as np
import pytest

from tidewell.sources import decks, split_decks


def _text(r, n, keyword="PORO", before=True, end=True, bad=None):
    lines = ["-- a deck", "NOECHO"]
    if before:
        lines += ["SPECGRID", "3 4 5 /", "OTHER", *(" ".join(str(x) for x in r.integers(0, 99, 9)) for _ in range(40)), "/"]
    lines.append(f"  {keyword.lower()}   -- values")
    values, left = [], n
    while left:
        k = int(min(left, r.choice([1, 1, 1, 2, 50])))
        v = round(float(r.random()), 4)
        values.append(f"{k}*{v}" if k > 1 or r.random() < 0.1 else str(v))
        left -= k
    while values:
        k = int(r.integers(1, 9))
        lines.append(" ".join(values[:k]) + (" -- 7 8 / 9" if r.random() < 0.2 else ""))
        values = values[k:]
        if r.random() < 0.1:
            lines += ["", "ECHO", "  -- nothing"]
    if bad:
        lines.insert(len(lines) - 3, bad)
    lines[-1] += "\n /" if end else ""
    return "\n".join([*lines, "PERMX", "1 2 3 /", keyword, "5 5 5 /", ""])


def _write(folder, texts):
    for i, t in enumerate(texts):
        (folder / f"{i}.grdecl").write_text(t, newline="")
    return str(folder)


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_ranges_give_the_whole_file(spark, tmp_path, split):
    r = np.random.default_rng(split)
    texts = [_text(r, n, before=i % 2 == 0) for i, n in enumerate((1, 30, 700, 5000))]
    texts.append(_text(r, 400).replace("\n", "\r\n"))
    path = _write(tmp_path, texts)
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = split_decks.cubes(spark, path, ["poro", "permx"], split_bytes=split).collect()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == conf
    for i, t in enumerate(texts):
        for keyword in ("PORO", "PERMX"):
            tokens = decks._tokens_after(decks.clean_lines(t), keyword)
            want = decks.expand(tokens)
            mine = sorted((x.flat, x.value) for x in got if x.keyword == keyword and x.path.endswith(f"/{i}.grdecl"))
            assert mine == list(enumerate(want))
    if split == 64:
        found = split_decks.read_runs(spark, path, ["PORO"], split)
        assert found.select("path", "start").distinct().count() > 100


@pytest.mark.parametrize("split", [50, 1 << 20])
@pytest.mark.parametrize(
    ("how", "says"),
    [({"keyword": "SATNUM"}, "PORO is missing"), ({"bad": "1.2.3 x"}, "bad token 1.2.3"), ({"bad": "PERMX"}, "bad token PERMX"), ({}, "PORO has 200 values, not 201"), ({"bad": "x*3"}, r"bad token x\*3")]
)
def test_errors_are_those_of_the_whole_file(spark, tmp_path, split, how, says):
    r = np.random.default_rng(3)
    text = _text(r, 200, **how)
    path = _write(tmp_path, [text])
    with pytest.raises(decks.DeckError, match=says):
        split_decks.cubes(spark, path, ["PORO"], 201, split)
    with pytest.raises(decks.DeckError):
        decks.read_cube(text, "PORO", 201)
    assert split_decks.cubes(spark, path, ["PORO"], 201, split, strict=False).count() == 0


def test_a_block_without_end(spark, tmp_path):
    path = _write(tmp_path, ["PORO\n" + "1 2 3\n" * 40, "PORO\n1 2 /\n"])
    with pytest.raises(decks.DeckError, match="no end"):
        split_decks.cubes(spark, path, ["PORO"], split_bytes=32)
    some = split_decks.cubes(spark, path, ["PORO"], split_bytes=32, strict=False)
    assert sorted((x.flat, x.value) for x in some.collect()) == [(0, 1.0), (1, 2.0)]


def test_long_runs_and_long_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split_decks, "_RUNS", 7)
    monkeypatch.setattr(split_decks, "_VALUES", 1000)
    path = _write(tmp_path, ["PORO\n25000*0.5 " + " ".join(str(i) for i in range(500)) + "\n0*9 2*7\n/"])
    got = [x.value for x in split_decks.cubes(spark, path, ["PORO"], 25_502, 100).orderBy("flat").collect()]
    assert got == [0.5] * 25_000 + [float(i) for i in range(500)] + [7.0, 7.0]


def test_empty_files(spark, tmp_path):
    assert split_decks.cubes(spark, _write(tmp_path, ["", ""]), ["PORO"]).count() == 0
