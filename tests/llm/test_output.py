import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common_rows import DOCS, docs, rows
from tidewell.llm import token_frames, warc
from tidewell.llm.common import shared_dir

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_round_trip(spark, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    more = [
        (None, "null id", None, None, None, *"abcdefg"), (3, "again it's <|endoftext|> now", None, None, None, *"abcdefg"),
        (3, None, None, None, None, *"abcdefg"), (2, dict((r[0], r[1]) for r in rows())[2], None, None, None, *"abcdefg")
    ]
    table = [(r[0], r[1]) for r in [*rows(), *more]]
    got = token_frames.token_output(docs(spark, more), P.path(name), shards=4).orderBy("start").collect()
    assert len(got) == len(table)
    assert [r.doc_id for r in got] == sorted((d for d, _ in table), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted(((d, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, x in table), key=repr)
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=repr) == want
    assert token_frames.token_output(spark.createDataFrame([], DOCS), P.path(name)).count() == 0


def test_one_doc_id_fills_several_shards(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    table = [(7, f"word {i} of many") for i in range(300)] + [(i, "one") for i in range(40)] + [(None, f"n{i}") for i in range(9)]
    table = spark.createDataFrame(table, "doc_id long, text string")
    ids = token_frames.encode(table, token_frames.vocabulary(WORDS), shards=12, fan=4).cache()
    bounds = token_frames.shard_bounds(table, 12, fan=4)
    assert len(bounds) == 11 and list(bounds) == sorted(bounds)
    held = {(r.doc_id, r.shard): r["count"] for r in ids.groupBy("doc_id", "shard").count().collect()}
    assert len([s for d, s in held if d == 7]) >= 8 and max(held.values()) < 100
    got = token_frames.token_output(table, WORDS, shards=12).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 9 + list(range(7)) + [7] * 301 + list(range(8, 40))
    want = sorted(
        zlib.crc32(
            np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes()
        ) for x in [*(f"word {i} of many" for i in range(300)), "one"]
    )
    assert sorted(r.ids_crc32 for r in got if r.doc_id == 7) == want


def test_many_shards_in_few_partitions(spark, monkeypatch):
    """Twelve shards written and read by three tasks: the same files, in the same order."""
    monkeypatch.setattr(token_frames, "MOST_PARTS", 3)
    df = spark.createDataFrame([(i, f"text {i} here") for i in range(200)], "doc_id long, text string")
    ids = token_frames.encode(df, token_frames.vocabulary(WORDS), shards=12, most_parts=3)
    assert ids.rdd.getNumPartitions() == 3
    files = token_frames.write(ids, shared_dir(spark, "tokens-test"))
    assert files.count() == 12
    back = token_frames.read(files)
    assert back.rdd.getNumPartitions() == 3
    assert [r.doc_id for r in back.orderBy("start").collect()] == list(range(200))


def test_frames_are_read_alone_and_checked(tmp_path):
    path = str(tmp_path / "a.zst")
    w = token_frames.ShardWriter(path, "<u2", frame_bytes=64)
    r = np.random.default_rng(1)
    texts = {i: r.integers(0, 60_000, r.integers(0, 80)).astype("<u2") for i in range(50)}
    for i, x in texts.items():
        w.add(i, x.tobytes())
    assert w.close(7)[0] == 7
    reader = token_frames.ShardReader(path)
    assert len(reader.per_frame) > 10
    got = reader.documents({3, 40, 999})
    assert set(got) == {3, 40} and all((got[i] == texts[i]).all() for i in got)
    import zstandard

    raw = b"".join(x.tobytes() for x in texts.values())
    with open(path, "rb") as f:  # any reader of zstandard skips the index and the table
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == raw
    data = bytearray(open(path, "rb").read())
    data[reader.at[1] + 12] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        token_frames.ShardReader(path).frame(1)


def test_chunks_give_the_ids_of_whole_texts():
    import random

    from tokenizers import Tokenizer

    d = token_frames.vocabulary(WORDS)
    t, ids = Tokenizer.from_str(d), token_frames._ChunkIds(d, "<u2", most=50)
    r = random.Random(3)
    texts = ["".join(r.choice("abAB12,.'-<|é— \n\téÉß") for _ in range(60)) for _ in range(400)]
    texts += ["don't it's <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "İ ΑΣ. ﬁ K", "x\u0301 \u0301 e\u0301t", "a\u00a0b\u2003c \x1c\x1d"]
    texts += ["", " ", "Ẹ́É̇ Å Å ×÷ÀÞÿß", "l'été,—là «oui».***¿qué?1234567²", "rock'n'roll'd've'!'s,'ll", "a≮b ≠", "'" * 9 + "s"]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for text, got in zip(part, ids.of([x.encode() for x in part]), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_cut_in_pieces(monkeypatch):
    from tokenizers import Tokenizer

    d = token_frames.vocabulary(WORDS)
    t, ids = Tokenizer.from_str(d), token_frames._ChunkIds(d, "<u2")
    monkeypatch.setattr(token_frames, "PIECE", 37)
    texts = [f"{'word ' * i}{'x' * i * 9}, É{i}." * (1 + i % 3) for i in range(40)]
    for text, got in zip(texts, ids.of([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


PAGES = "page_id BIGINT, url STRING, html STRING, payload STRING, record_type STRING"


def brute_warc(table):
    first, out = {}, []
    for i, _, h in table:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, _, h in table:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and first[b] < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 30_000
    table = [
        (i, f"http://h/{i}", h) for i,
        h in enumerate(
            ["x" * 200, "x" * 200, "small", "small", None, "", "y" * 99, "y" * 99, "é" * 50, "é" * 50, big, big, "\r\n\r\n" * 40]
        )
    ]
    table += [(20, None, "x" * 200), (20, None, "x" * 200), (21, "http://a\r\nb", "z" * 300), (None, "u", "z" * 300), (0, "again", "x" * 200)]
    df = spark.createDataFrame([(*r, "p", "q") for r in table], PAGES).repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df).collect()), key=repr)
    assert got == brute_warc(table)
    assert warc.archive(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [warc.MOST_BROADCAST, 0])
def test_warc_repeated_page_ids(spark, most):
    """Rows of one page_id with different payloads, one or both of them copies of earlier pages; the table of copies sent or joined by marks."""
    a, b, c, d = ("<p>" + x * 200 for x in "abcd")
    table = [
        (1, "http://x/1", a), (2, "http://x/2", b), (5, "http://x/5", a), (5, "http://x/6", c), (7, "http://x/7", a), (7, "http://x/8", b),
        (9, "http://x/9", d)
    ]
    plan = warc.plan_records(spark.createDataFrame(table, "page_id BIGINT, url STRING, html STRING"), most)
    got = sorted((r.record_id, r.url[-1], r.record_type, r.refers_to) for r in plan.collect())
    assert got == [
        (1, "1", "response", None), (2, "2", "response", None), (5, "5", "revisit", 1), (5, "6", "response", None), (7, "7", "revisit", 1),
        (7, "8", "revisit", 2), (9, "9", "response", None)
    ]


def test_marks_grow_with_the_copies():
    assert warc.mark_bits(0) == warc.LEAST_MARK_BITS and warc.mark_bits(10**9) == warc.MOST_MARK_BITS
    assert all(64 << warc.mark_bits(n) >= 8 * n for n in (1, 1000, 10**5, 3 * 10**6, 16 * 10**6))


def test_time_of_a_cut_is_linear_in_the_payload(spark, tmp_path):
    """A payload of 64 MB takes less than three times one of 32 MB; all chunks are there."""
    took = {}
    for mb in (4, 32, 64):  # the first one warms up
        df = spark.range(1).select(F.col("id").alias("record_id"), *(F.lit(None).cast(t).alias(c) for c, t in zip(warc.CHUNKS.names[1:6], ("string", "long", "string", "long", "string"), strict=True)), F.expr(f"repeat('0123456789abcdef', {mb << 16})").alias("payload"))
        df.write.parquet(f"{tmp_path}/{mb}")
        rows = warc._cut(spark.read.parquet(f"{tmp_path}/{mb}"), warc.CHUNK)
        took[mb] = []
        for _ in range(2):
            began = time.monotonic()
            n, size = rows.agg(F.count("*"), F.sum(F.octet_length("data"))).first()
            took[mb].append(time.monotonic() - began)
        assert (n, size) == (mb << 4, mb << 20)
    assert min(took[64]) < 3 * max(min(took[32]), 0.5)


def test_chunked_record_table(spark):
    big = "0123456789" * 30_000
    df = spark.createDataFrame([(1, "u", big, "", ""), (2, "u", big, "", ""), (3, "u", None, "", "")], PAGES)
    chunks = warc.chunked(warc.plan_records(df), 1000)
    files = warc.write(chunks, shared_dir(spark, "warc-test"))
    back = warc.read(files)
    for table in (chunks, back):
        rows = sorted((r for r in table.collect() if r.record_id == 1), key=lambda r: r.chunk_no)
        assert b"".join(bytes(r.data) for r in rows).decode() == big
        so_far = hashlib.sha256()
        for r in rows:
            so_far.update(bytes(r.data))
            assert r.digest_so_far == so_far.hexdigest()
        assert rows[-1].last and rows[-1].digest_so_far == rows[0].payload_digest and len(rows) > 1
    path = files.first().path
    data = bytearray(open(re.sub("^file:", "", path), "rb").read())
    assert data[:2] == b"\x1f\x8b"


def test_damaged_archives_are_refused(tmp_path):
    path = str(tmp_path / "a.warc.gz")
    w = warc.WarcWriter(path)
    body = b"hello" * 100
    head = {
        "record_id": 1, "record_type": "response", "refers_to": None, "url": "u", "payload_bytes": 500,
        "payload_digest": hashlib.sha256(b"other").hexdigest(), "chunk_no": 0, "last": True, "data": body, "digest_so_far": ""
    }
    w.add(head)
    w.close()
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(path))
    data = open(path, "rb").read()
    open(path, "wb").write(data[:60])
    with pytest.raises(ValueError):
        list(warc.records(path))
