"""Alignment of the tokens of two vocabularies by the bytes that they cover.

Texts are cut into chunks at those spaces where tokens of both vocabularies
begin. The tokens of a batch's different chunks are intervals of one axis, on
which the chunks follow each other. DuckDB joins them in the task: the token of
the other side that holds a token's start comes from an ASOF join, a link is two
intervals that overlap, and groups are numbered by a running sum over the places
where tokens of both sides begin. What a text has is the sum over its chunks.
Each task also counts its pairs of ids; Spark adds these partial counts, and
rates every text's links by the sums.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from contextlib import contextmanager
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, small_batches

#: Bytes of text whose chunks DuckDB joins at a time; a longer text is cut where chunks meet.
PIECE = 4 << 20
#: Pairs of ids, at most, that every executor holds with their counts; rarer ones are joined by a shuffle.
MOST_HEAD = 1_000_000
#: Different chunks that a worker remembers; then it forgets those that it met once, and half of them at least.
MOST_CHUNKS = 300_000
#: Different pairs that a task holds before it hands on their counts.
MOST_HELD = 500_000

_LIST = pa.list_(pa.int32())
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("whole", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("groups_sha256", pa.string()), ("a", _LIST), ("b", _LIST), ("n", pa.list_(pa.int64()))
])
_TYPE = "doc_id long, whole boolean, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, n array<long>"


def byte_level_tokens(definition: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary. Printable Latin-1 characters name their own byte; 256 and on name the others in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocab = json.loads(definition)["model"]["vocab"]
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        if all(c in names for c in token):
            out[i] = bytes(names[c] for c in token)
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]


class Vocabularies:
    """Both tokenizers of a worker; ids and bytes of texts."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [pa.array(x, pa.binary()) for x in (byte_level_tokens(definition), piece_tokens(self.b))]
        self.lengths = [np.array([len(x) for x in tokens.to_pylist()], np.int64) for tokens in self.bytes]
        #: Whether no piece has a space after another character: then a space that follows a word begins a new token.
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.bytes[1].to_pylist())

    def parts(self, text: str, size: int) -> list[str]:
        """Parts of about `size` characters that give the text when joined by spaces."""
        if len(text) <= size or not self.cuts:
            return [text]
        out, at = [], 0
        while True:
            found = _SPACE.search(text, at + size) if at + size < len(text) else None
            out.append(text[at : found.start()] if found else text[at:])
            if not found:
                return out
            at = found.end()

    def chunks(self, part: str) -> list[str]:
        """Chunks that give the part when joined by spaces. Each, with a space before it, has the tokens of both kinds that it has in the text."""
        return _SPACE.split(part) if self.cuts else [part]

    def encode(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of the chunks with a space before each, which B adds itself, one after the other, and how many each chunk has."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        return [(np.fromiter(chain.from_iterable(x), np.int32), np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b)]

    def fits(self, side: int, ids: np.ndarray, counts: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        """Of each chunk, whether its tokens' bytes, one after the other, are a space and the chunk."""
        ends = np.cumsum(self.lengths[side][ids])[np.cumsum(counts) - 1]
        data = self.bytes[side].take(pa.array(ids)).buffers()[2]
        data = data.to_pybytes()[: int(ends[-1])] if data is not None else b""
        if data == b" " + b" ".join(chunks):
            return np.ones(len(chunks), bool)
        return np.array([data[i:j] == b" " + c for (i, j), c in zip(pairwise([0, *ends.tolist()]), chunks, strict=True)], bool)


#: A space between two characters that are none: no pre-token of A and no piece of B goes over it.
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _vocabularies(definition: str, model: bytes) -> Vocabularies:
    """The Python worker's tokenizers, kept from task to task."""
    held = sys.modules.setdefault("_tidewell_vocabularies", types.ModuleType("_tidewell_vocabularies")).__dict__
    key = (hash(definition), hash(model))
    if held.get("key") != key:
        held["key"], held["both"] = key, Vocabularies(definition, model)
    return held["both"]


def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    con.execute("SET preserve_insertion_order = false")
    con.execute("CREATE TABLE counts (a INT, b INT, n BIGINT)")
    con.execute("CREATE TABLE chunk_pairs (chunk INT, a INT, b INT, n BIGINT)")
    return con


#: From token intervals of both sides (chunk, s and e, start and end on the axis, id): pairs of ids by chunk, and facts of each chunk.
_LINKS = """
INSERT INTO chunk_pairs SELECT chunk, a, b, count(*) FROM (
  SELECT a.chunk, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s WHERE a.s < b.e
  UNION ALL SELECT b.chunk, a.id, b.id FROM b ASOF JOIN a ON b.s > a.s WHERE b.s < a.e) GROUP BY ALL
"""
_GROUPS = """
WITH tokens AS (
  SELECT a.chunk, 0 AS side, a.s, a.id, b.s IS NOT NULL AS opens FROM a LEFT JOIN b ON a.s = b.s
  UNION ALL SELECT b.chunk, 1, b.s, b.id, a.s IS NOT NULL FROM b LEFT JOIN a ON a.s = b.s),
grouped AS (SELECT *, sum((opens AND side = 0)::INT) OVER (ORDER BY s, side ROWS UNBOUNDED PRECEDING)::INT AS g FROM tokens)
SELECT chunk, opens AND side = 0 AS first, (CASE WHEN NOT opens THEN ',' WHEN side = 1 THEN '|' ELSE ';' END) || id AS token
FROM grouped ORDER BY g, side, s
"""
#: Pairs of ids by part, from the chunks that it uses.
_PAIRS = """
SELECT part, a, b, sum(times * n)::BIGINT AS n FROM (SELECT part, chunk, count(*) AS times FROM uses GROUP BY ALL)
JOIN chunk_pairs USING (chunk) GROUP BY part, a, b ORDER BY part
"""


def _intervals(ids: np.ndarray, chunk: np.ndarray, lengths: np.ndarray) -> pa.Table:
    e = np.cumsum(lengths[ids])
    return pa.table({"chunk": chunk, "s": e - lengths[ids], "e": e, "id": ids})


class _Numbers(dict):
    """Numbers of chunks, in the order in which they are met."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


class _Chunks:
    """The chunks that a worker has met, up to `most` of them: numbers, whether they fit, groups as text, and n_groups, n_a and n_b; their pairs are in DuckDB."""

    def __init__(self, both: Vocabularies, most: int = MOST_CHUNKS):
        self.con, self.both, self.most = _connection(), both, most
        self.numbers, self.groups = _Numbers(), []
        self.fits, self.sizes, self.met = np.empty(0, bool), np.empty((3, 0), np.int64), np.empty(0, np.int64)

    def forget(self) -> None:
        """Keep the half that was met most, of those that were met twice or more; all is forgotten if that is none."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
        keep = keep[self.met[keep] > 1]
        old = list(self.numbers)
        self.numbers = _Numbers(zip((old[i] for i in keep.tolist()), range(len(keep)), strict=True))
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.fits, self.sizes, self.met = self.fits[keep], self.sizes[:, keep], self.met[keep] // 2
        self.con.register("kept", pa.table({"old": keep.astype(np.int32), "new": np.arange(len(keep), dtype=np.int32)}))
        self.con.execute("CREATE OR REPLACE TABLE chunk_pairs AS SELECT new AS chunk, a, b, n FROM chunk_pairs JOIN kept ON old = chunk")
        self.con.unregister("kept")

    def number(self, part: str) -> np.ndarray:
        """The part's chunks by number; those that are new are to be learned."""
        chunks = self.both.chunks(part) if part else []
        return np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks))

    def count(self, uses: list[np.ndarray]) -> None:
        self.met += np.bincount(np.concatenate(uses), minlength=len(self.met))

    def learn(self, at_once: int = 50_000) -> None:
        new = list(islice(self.numbers, len(self.groups), None))
        for at in range(0, len(new), at_once):
            self._learn(new[at : at + at_once])

    def _learn(self, new: list[str]) -> None:
        raw, sides, first = [c.encode() for c in new], self.both.encode(new), len(self.groups)
        fits = self.both.fits(0, *sides[0], raw) & self.both.fits(1, *sides[1], raw)
        sizes, groups = np.zeros((3, len(new)), np.int64), [""] * len(new)
        if fits.any():
            for name, lengths, (ids, counts) in zip("ab", self.both.lengths, sides, strict=True):
                chunk = np.repeat(np.arange(first, first + len(new), dtype=np.int32), counts)
                good = np.repeat(fits, counts)
                self.con.register(name, _intervals(ids[good], chunk[good], lengths))
            self.con.execute(_LINKS)
            tokens = self.con.sql(_GROUPS).to_arrow_table().combine_chunks()
            self.con.unregister("a")
            self.con.unregister("b")
            # tokens of a chunk follow each other, so its groups are a stretch of the column's text
            where = np.nonzero(fits)[0]
            edges = np.searchsorted(tokens.column("chunk").to_numpy(), np.append(where + first, first + len(new)))
            column = pa.array(tokens.column("token").chunk(0), pa.string())
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
            at, text = ends[edges].tolist(), column.buffers()[2].to_pybytes().decode("ascii")
            for i, (j, k) in zip(where.tolist(), pairwise(at), strict=True):
                groups[i] = text[j + 1 : k]
            opened = np.append(0, np.cumsum(tokens.column("first").to_numpy()))
            sizes[:, where] = np.diff(opened[edges]), sides[0][1][fits], sides[1][1][fits]
        self.groups += groups
        self.fits, self.sizes, self.met = np.append(self.fits, fits), np.append(self.sizes, sizes, axis=1), np.append(self.met, np.zeros(len(new), np.int64))


@contextmanager
def _chunks(both: Vocabularies):
    """The Python worker's chunks, kept from task to task; a task that fails leaves none."""
    held = sys.modules["_tidewell_vocabularies"].__dict__
    known = held.pop("chunks", None)
    if known is None or known.both is not both:
        known = _Chunks(both)
    known.con.execute("DELETE FROM counts")
    yield known
    held["chunks"] = known


def _used(con, uses: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Pairs (a, b, n) of each part, from the numbers of its chunks."""
    part = np.repeat(np.arange(len(uses), dtype=np.int32), [len(x) for x in uses])
    con.register("uses", pa.table({"part": part, "chunk": np.concatenate(uses)}))
    out = con.sql(_PAIRS).to_arrow_table()
    con.unregister("uses")
    edges = np.searchsorted(out.column("part").to_numpy(), np.arange(len(uses) + 1)).tolist()
    columns = [out.column(c).to_numpy() for c in ("a", "b", "n")]
    return [[c[i:j] for c in columns] for i, j in pairwise(edges)]


def _count(con, rows: list[tuple]) -> int:
    """Add the pairs of finished texts to the task's counts; return how many rows those have."""
    a, b, n = (np.concatenate(x) for x in list(zip(*rows, strict=True))[6:])
    con.register("done", pa.table({"a": a, "b": b, "n": n}))
    con.execute("INSERT INTO counts SELECT a, b, sum(n) FROM done GROUP BY ALL")
    con.unregister("done")
    return con.sql("SELECT count(*) AS n FROM counts").to_arrow_table().column("n")[0].as_py()


def _partial(con):
    """The task's counts so far as rows that hold no text."""
    t = con.sql("SELECT a, b, sum(n)::BIGINT AS n FROM counts GROUP BY ALL").to_arrow_table()
    con.execute("DELETE FROM counts")
    a, b, n = (t.column(c).to_numpy() for c in ("a", "b", "n"))
    for at in range(0, len(a), 50_000):
        cut = slice(at, at + 50_000)
        lists = [pa.array([x[cut]], t) for x, t in zip((a, b, n), (_LIST, _LIST, SCHEMA.field("n").type), strict=True)]
        empty = [pa.nulls(1, SCHEMA.field(i).type) for i in range(6)]
        empty[1] = pa.array([False])
        yield pa.RecordBatch.from_arrays([*empty, *lists], schema=SCHEMA)


def _pieces(batches, both: Vocabularies, size: int):
    """Lists of (row, ends a text, part, doc_id) of about `size` bytes together."""
    held, total, row = [], 0, 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            parts = both.parts(text.as_py() or "", size)
            for k, part in enumerate(parts):
                held.append((row, k == len(parts) - 1, part, doc_id))
                total += len(part.encode())
                if total >= size:
                    yield held
                    held, total = [], 0
            row += 1
    if held:
        yield held


class _Text:
    """What is gathered of one text over its parts."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.digest, self.fits, self.pairs = hashlib.sha256(), True, []

    def add(self, groups: str, n_groups: int, n_a: int, n_b: int, pairs: list[np.ndarray]) -> None:
        self.digest.update((";" + groups if self.n_groups else groups).encode())
        self.n_groups, self.n_a, self.n_b = self.n_groups + n_groups, self.n_a + n_a, self.n_b + n_b
        self.pairs.append(pairs)

    def row(self, doc_id) -> tuple:
        if not self.fits or not self.n_groups:
            none = np.empty(0, np.int32)
            return doc_id, True, 0, 0, 0, "", none, none, none.astype(np.int64)
        a, b, n = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        if len(self.pairs) > 1:
            keys, back = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
            a, b, n = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), np.bincount(back, n).astype(np.int64)
        return doc_id, True, self.n_a, self.n_b, self.n_groups, self.digest.hexdigest(), a, b, n


def _lists(columns: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, columns)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns) if columns else [], kind.value_type))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    plain = list(zip(*rows, strict=True))
    arrays = [pa.array(c, f.type) for c, f in zip(plain[:6], SCHEMA, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, *(_lists(c, SCHEMA.field(6 + i).type) for i, c in enumerate(plain[6:]))], schema=SCHEMA)


def link_texts(docs: DataFrame, definition: str, model: bytes, piece: int = PIECE, held: int = MOST_HELD) -> DataFrame:
    """The texts' token counts, groups and pairs of ids (whole = true), and each task's partial counts of pairs (whole = false)."""
    spark = docs.sparkSession
    small_batches(spark)
    # the model is sent once to an executor, not with each task
    sent = spark.sparkContext.broadcast((definition, model))

    def run(batches):
        both, open_ = _vocabularies(*sent.value), {}
        with _chunks(both) as known:
            for parts in _pieces(batches, both, piece):
                if len(known.numbers) >= known.most:
                    known.forget()
                uses, texts = [known.number(t) for _, _, t, _ in parts], [open_.setdefault(row, _Text()) for row, *_ in parts]
                known.learn()
                known.count(uses)
                for text, used in zip(texts, uses, strict=True):
                    text.fits = text.fits and bool(known.fits[used].all())
                now = [i for i, text in enumerate(texts) if text.fits and len(uses[i])]
                for i, pairs in zip(now, _used(known.con, [uses[i] for i in now]) if now else [], strict=True):
                    texts[i].add(";".join([known.groups[x] for x in uses[i].tolist()]), *known.sizes[:, uses[i]].sum(1).tolist(), pairs)
                # only now it is known whether all parts of a text fit
                done = [open_.pop(row).row(doc_id) for row, last, _, doc_id in parts if last]
                if done:
                    yield _rows(done)
                    if _count(known.con, done) >= held:
                        yield from _partial(known.con)
            yield from _partial(known.con)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _TYPE)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each pair of ids in all texts, and whether no other pair of b has more."""
    partial = linked.where("not whole").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    counts = partial.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _rated(texts: DataFrame, head, whole: bool) -> DataFrame:
    """Sums over a text's links to pairs of head (sorted keys, counts, best), and the pairs that head doesn't hold."""

    def run(batches):
        keys, counts, best = head.value
        for batch in batches:
            starts = batch.column("a").offsets.to_numpy()
            a, b, n = (batch.column(c).flatten().to_numpy() for c in ("a", "b", "n"))
            key = a.astype(np.int64) << 32 | b
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            sums = []
            for value in (np.ones(len(n), np.int64) * n, np.where(known, best[at], 0) * n if len(keys) else n * 0, np.where(known, counts[at], 0) * n if len(keys) else n * 0):
                total = np.append(0, np.cumsum(value))
                sums.append(pa.array(total[starts[1:] - starts[0]] - total[starts[:-1] - starts[0]], pa.int64()))
            left = np.append(0, np.cumsum(~known))
            offsets = pa.array((left[starts - starts[0]]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known])) for x in (a, b, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")] + sums + rest,
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum", "a", "b", "n"]
            )

    return texts.mapInArrow(
        run,
        "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, a array<int>, b array<int>, n array<long>"
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, byte_path: str, piece_path: str, most_head: int = MOST_HEAD, piece: int = PIECE) -> DataFrame:
    """Tokens of two vocabularies over each text of docs (doc_id, text), linked where their bytes overlap.

    A is a byte-level BPE vocabulary (JSON) over a space and the text, B a
    sentencepiece model over the text, to which it adds the space. Returns
    doc_id, n_a, n_b, n_groups (stretches between bytes where tokens of both
    end), n_links (overlapping occurrences), n_best (links whose pair of ids is
    the most frequent one of its B id, ties included), count_sum (their pairs'
    counts over all texts) and groups_sha256 of the groups' ids. Null and empty
    texts, and those whose tokens' bytes aren't the space and the text, have
    zeros and '' and no links. Rows are counted as often as they are given,
    whatever their doc_id; other columns are ignored.

    Counts of frequent pairs, of which there are most_head at most because each
    holds that share of all links, go to every executor; rarer ones are joined.
    """
    spark = docs.sparkSession
    with open(byte_path, encoding="utf-8") as f:
        definition = f.read()
    with open(piece_path, "rb") as f:
        model = f.read()
    linked = materialize(link_texts(docs, definition, model, piece), "aligned")
    pairs = materialize(pair_counts(linked), "pair-counts")
    n_pairs, total = pairs.agg(F.count("*"), F.sum("n")).first()
    frequent = F.col("n") > (0 if n_pairs <= most_head else total / most_head)
    head = pairs.where(frequent).select((F.col("a").cast("long") * 2**32 + F.col("b")).alias("k"), "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("k")
    sent = spark.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("k", "n", "best")))
    texts = linked.where("whole").withColumn("row", F.monotonically_increasing_id())
    if n_pairs <= most_head:
        return _rated(texts, sent, True).select(*COLUMNS)
    rated = materialize(_rated(texts, sent, False), "rated")
    rest = rated.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", "p.a", "p.b", F.col("p.n").alias("times"))
    rare = pairs.where(~frequent).withColumnRenamed("a", "_a").withColumnRenamed("b", "_b")
    more = rest.join(rare, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    both = rated.join(more, F.col("row") == F.col("_row"), "left")
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0).cast("long"))).alias(c)
    return both.withColumns({"n_best": plus("n_best", "_best"), "count_sum": plus("count_sum", "_sum")}).select(*COLUMNS)
