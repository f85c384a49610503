"""Token-ID output: independent zstandard frames, a document index, and a trailing seek table.

File layout (one file per shard of consecutive doc_ids)::

    data frame 0 .. n-1   zstd frames with content checksum; little-endian token ids of whole documents
    skippable 0x184D2A50  zstd frame of the document index: JSON line, then doc_id i8[], nulls u1[], n_tokens u8[]
    skippable 0x184D2A5E  seek table of the public zstd seekable format, with a checksum for each frame

The seek table covers the data frames; the index says how many documents and
tokens each holds, so a reader fetches the tail, then only the frames it needs.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, open_fs, shared_dir, small_batches

#: Fixed values of the zstd seekable format.
SKIP_INDEX, SKIP_SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

#: Bytes of text, and rows, of one file, about.
SHARD_TEXT, SHARD_ROWS = 32 << 20, 4 << 20
#: Tasks that write or read shards, at most; beyond that a task has several shards, one after the other.
MOST_PARTS = 10_000
#: Bounds of shards that are drawn in one step; more are drawn from within each of these ranges.
FAN = 10_000

IDS = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("turn", pa.int64()), ("ids", pa.binary())])
FILES = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def vocabulary(tokenizer_path: str) -> str:
    """The tokenizer's definition as text, so that executors need no file of the driver's machine."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


class _ChunkIds(dict):
    """Token ids of chunks, as bytes.

    The vocabulary drops white space and never joins text across the places
    where cut() cuts, so the ids of a text are those of its chunks one after the
    other. Words that are new to the memo are encoded many at a time: joined by
    spaces, with one pre-token a word, and cut where the tokens end a word. When
    the memo is full its words move to a second one, from which those met again
    come back.
    """

    def __init__(self, definition: str, dtype: str, most: int = 120_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.dtype, self.most, self.old = Tokenizer.from_str(definition), dtype, most, {}
        plain = json.loads(definition)
        model = plain.get("model", {})
        # lower-case words need neither normalizer nor pre-tokenizer, but bytes must be named as the vocabulary names them
        self.plain = Tokenizer.from_str(json.dumps(plain | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.suffix = model.get("end_of_word_suffix")
        ids = model.get("vocab") or {}
        self.ends = np.zeros(max(ids.values(), default=0) + 1 + len(self.tokenizer.get_vocab()), bool)
        if self.suffix:
            self.ends[[i for t, i in ids.items() if t.endswith(self.suffix)]] = True

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            ids = self.tokenizer.encode(chunk.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
            out = np.array(ids, self.dtype).tobytes()
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def learn(self, chunks: list[bytes]) -> None:
        """Put different chunks that are not in the memo there, as far as they are words."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if self.old:
            found = {c: v for c, v in zip(chunks, map(self.old.get, chunks), strict=True) if v is not None}
            self.update(found)
            chunks = [c for c in chunks if c not in found]
        if self.suffix:
            new = list(filter(_LATIN.fullmatch, chunks))
            for at in range(0, len(new), 4000):
                self._encode(new[at : at + 4000])

    def _encode(self, new: list[bytes]) -> None:
        """Memorize words of one pre-token each; if their number doesn't come out, they are left to __missing__."""
        text = b" ".join(new).decode("latin-1").translate(_BYTE_NAMES)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.nonzero(self.ends[ids])[0] + 1
        if len(cuts) == len(new) and (not len(ids) or cuts[-1] == len(ids)):
            raw, step = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            self.update(zip(new, (raw[i:j] for i, j in pairwise([0, *(cuts * step).tolist()])), strict=True))

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts. Each different chunk of a piece of them is looked up once."""
        out = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if b"<|" not in t]
        for i in set(range(len(texts))).difference(plain):  # special tokens may stand here: only cut at white space
            out[i] = b"".join(map(self.__getitem__, texts[i].split()))
        for owners, parts in _pieces([(i, texts[i]) for i in plain]):
            chunks, ends = cut(parts)
            coded = chunks.dictionary_encode()
            kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            known = list(map(self.get, kinds))
            new = [i for i, ids in enumerate(known) if ids is None]
            self.learn([kinds[i] for i in new])
            for i in new:
                known[i] = self[kinds[i]]
            ids = pa.array(known, pa.binary()).take(coded.indices)
            if not len(ids):
                continue
            at = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)[[0, *ends]].tolist()
            raw = memoryview(ids.buffers()[2]) if ids.buffers()[2] is not None else memoryview(b"")
            for owner, (i, j) in zip(owners, pairwise(at), strict=True):
                out[owner] = out[owner] + raw[i:j] if out[owner] else bytes(raw[i:j])
        return out


#: Lower-case words of a-z and the letters of Latin-1: one pre-token each, with nothing to normalize.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]){1,64}")

#: Names of those bytes that do not stand for themselves in a byte-level vocabulary: 256 and more, in their order.
_BYTE_NAMES = {b: 256 + 33 + i for i, b in enumerate([*range(127, 161)])} | {173: 256 + 33 + 34}

#: Bytes that are cut together, and how much text at a time.
PIECE = 2 << 20


def _pieces(texts: list[tuple[int, bytes]]):
    """(owners, parts) of about PIECE bytes; a longer text is cut at white space, into several parts with one owner."""
    owners, parts, size = [], [], 0
    for owner, text in texts:
        at = 0
        while at < len(text) or not at:
            end = len(text)
            if end - at > PIECE:
                space = _SPACE.search(text, at + PIECE)
                end = space.end() if space else end
            owners.append(owner)
            parts.append(text[at:end])
            size += end - at
            at = max(end, 1)
            if size >= PIECE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")

#: Kinds of bytes: white space, letter, digit, ASCII sign but the apostrophe (which can begin a pre-token of its own), anything else.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
_KIND = np.array(
    [
        SPACE if b in b" \t\n\r\x0b\x0c" else OTHER if b > 126 or b < 33 or b == 39 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN for b in range(256)
    ],
    np.uint8
)
#: Whether a chunk begins at a byte of kind b after one of kind a, at 8 a + b.
_BEGINS = np.array([b < 5 and b != SPACE and (a == SPACE or (a != b and a < OTHER and b < OTHER) or a == b == DIGIT) for a in range(8) for b in range(8)])


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Chunks whose ids, one after the other, are those of the texts, and how many chunks there are to the end of each text.

    Cuts lie at white space, and where letters, digits and signs meet: there
    every pre-token ends. Chunks with any other character are left whole.
    Letters are lower-cased: A to Z and those of Latin-1, which no context changes.
    """
    x = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    kind = _KIND[x]
    at = np.nonzero(x == 0xC3)[0]
    if len(at):
        second = x[at + 1]
        letter = (second != 0x97) & (second != 0xB7)
        at, second = at[letter] + 1, second[letter]
        kind[at] = kind[at - 1] = LETTER
        x = x.copy()
        x[at] += ((second < 0x9F) * 32).astype(np.uint8)
    begins = np.empty(len(x), bool)
    begins[:1] = kind[:1] != SPACE
    np.take(_BEGINS, kind[:-1] << 3 | kind[1:], out=begins[1:])
    full = kind != SPACE
    data = x[full]
    offsets = np.append(np.flatnonzero(begins[full]), len(data)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return chunks, np.searchsorted(np.flatnonzero(begins), np.cumsum([len(t) + 1 for t in texts]))


def memo(definition: str, dtype: str) -> _ChunkIds:
    """The Python worker's memo, kept from task to task."""
    held = sys.modules.setdefault("_tidewell_memo", types.ModuleType("_tidewell_memo")).__dict__
    key = (hash(definition), dtype)
    if held.get("key") != key:
        held["key"], held["ids"] = key, _ChunkIds(definition, dtype)
    return held["ids"]


def _gathered(batches):
    """Batches of about PIECE bytes, so that a word is looked up once for more texts."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= PIECE:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    # workers live on: what this task has used goes back to the system
    pa.default_memory_pool().release_unused()


def splits_at_spaces(definition: str) -> bool:
    """Whether chunks can be encoded one by one: every pre-token is free of white space, and none is kept."""
    pre = json.loads(definition).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "[^\\s" in str(
        (first.get("pattern") or {}).get("Regex")
    )


def shard_bounds(docs: DataFrame, shards: int, fan: int = FAN) -> np.ndarray:
    """Largest doc_id of each shard but the last, ascending. A doc_id that fills several shards is named as often."""
    coarse = min(shards, fan)

    def at(n):
        return F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n))

    bounds = (docs.agg(at(coarse)).first()[0] or []) if coarse > 1 else []
    fine = -(-shards // coarse)
    if fine > 1:
        edges = np.array(bounds, np.int64)

        def run(batches):
            for b in batches:
                b = b.filter(b.column("doc_id").is_valid())
                part = np.searchsorted(edges, b.column("doc_id").to_numpy(), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), b.column("doc_id")], names=["part", "doc_id"])

        within = docs.select("doc_id").mapInArrow(run, "part long, doc_id long").groupBy("part").agg(at(fine).alias("b")).select("b").collect()
        # a range that begins where it ends has no rows of its own, but its share of those of that doc_id
        bounds = [*bounds, *(x for r in within for x in r.b), *np.repeat(edges[1:][edges[1:] == edges[:-1]], fine - 1).tolist()]
    return np.sort(np.array(bounds, np.int64))


def encode(docs: DataFrame, definition: str, end_id: int = 1, shards: int | None = None, fan: int = FAN, most_parts: int = MOST_PARTS) -> DataFrame:
    """(shard, doc_id, turn, ids): the ids of every whole text and the end id; shards are ranges of doc_id.

    A partition holds one shard, or several in their order if there are more
    than most_parts. A null text is an empty one; a null doc_id sorts first. A doc_id that fills
    several shards is dealt over them by a hash of the ids, its rows' turn.
    """
    from tokenizers import Tokenizer

    small_batches(docs.sparkSession)
    dtype = "<u2" if max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1) <= 65536 else "<u4"
    by_chunk = splits_at_spaces(definition)
    end = np.array([end_id], dtype).tobytes()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if shards is None:
        n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        shards = max(8, int((size or 0) // SHARD_TEXT), n // SHARD_ROWS)
    edges = shard_bounds(docs, shards, fan)
    n_shards = len(edges) + 1
    spread = {int(d): int(n) for d, n in zip(*np.unique(edges, return_counts=True), strict=True) if n > 1}
    # sent once to an executor, not with each task
    sent = docs.sparkSession.sparkContext.broadcast((edges, spread))

    def run(batches):
        import xxhash

        ids_of, (edges, spread) = memo(definition, dtype), sent.value
        for b in _gathered(batches):
            docs_, texts = b.column("doc_id"), b.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            out = [ids + end for ids in (ids_of.of(texts) if by_chunk else [ids_of[t] if t else b"" for t in texts])]
            known = docs_.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            shard, turn = np.searchsorted(edges, known, side="left"), np.zeros(len(out), np.int64)
            for i in np.nonzero(np.isin(known, list(spread)))[0] if spread else ():
                turn[i] = xxhash.xxh64_intdigest(out[i]) >> 1
                shard[i] += int(turn[i]) * spread[int(known[i])] >> 63
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), docs_.cast(pa.int64()), pa.array(turn, pa.int64()), pa.array(out, pa.binary())], schema=IDS
            )

    out = docs.mapInArrow(run, "shard long, doc_id long, turn long, ids binary")
    parts = min(n_shards, most_parts)
    return out.repartitionById(parts, F.floor(F.col("shard") * parts / n_shards).cast("int")).sortWithinPartitions("shard", "doc_id", "turn", "ids")


class ShardWriter:
    """Writes one file; a frame ends at the first document that fills it, so documents are never cut."""

    def __init__(self, uri: str, dtype: str, frame_bytes: int = 256 << 10, level: int = 3):
        import zstandard

        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.zstd, self.out, self.uri, self.dtype, self.frame_bytes = zstandard.ZstdCompressor(
            level=level, write_checksum=True, write_content_size=True
        ), fs.open_output_stream(path, compression=None, buffer_size=1 << 20), uri, dtype, frame_bytes
        self.seek, self.docs, self.counts, self.per_frame = [], [], [], []
        self.buffer, self.held, self.in_frame, self.n_tokens = [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.buffer.append(ids)
        self.held += len(ids)
        self.in_frame += 1
        self.docs.append(doc_id)
        self.counts.append(len(ids) // np.dtype(self.dtype).itemsize)
        self.n_tokens += self.counts[-1]
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.in_frame:
            raw = b"".join(self.buffer)
            frame = self.zstd.compress(raw)
            self.out.write(frame)
            self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.per_frame.append(self.in_frame)
            self.buffer, self.held, self.in_frame = [], 0, 0

    def close(self, shard: int) -> tuple:
        self.flush()
        head = json.dumps({"dtype": self.dtype, "docs_per_frame": self.per_frame}).encode() + b"\n"
        known = np.array([d is None for d in self.docs], "u1")
        index = self.zstd.compress(head + np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes() + np.array(self.counts, "<u8").tobytes())
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_END)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)
        self.out.close()
        return shard, self.uri, len(self.docs), self.n_tokens


class ShardReader:
    """Reads the tail of a file, then any frame on its own; checks every frame it decompresses."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = open_fs(uri)
        self.file, self.zstd = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_END or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        table_at = size - 9 - 12 * n
        self.seek = list(struct.iter_unpack("<III", self._at(table_at, 12 * n)))
        self.at = [0, *np.cumsum([x[0] for x in self.seek], dtype=np.int64).tolist()]
        index_at = self.at[-1]
        raw = self.zstd.decompress(self._at(index_at + 8, table_at - 8 - index_at - 8))
        head, _, body = raw.partition(b"\n")
        head = json.loads(head)
        self.dtype, self.per_frame = np.dtype(head["dtype"]), head["docs_per_frame"]
        d = sum(self.per_frame)
        ids, absent = np.frombuffer(body, "<i8", d), np.frombuffer(body, "u1", d, 8 * d)
        self.docs = [None if a else int(i) for i, a in zip(ids, absent, strict=True)]
        self.counts = np.frombuffer(body, "<u8", d, 9 * d).astype(np.int64)
        self.first = [0, *np.cumsum(self.per_frame, dtype=np.int64).tolist()]

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        import xxhash

        size, length, check = self.seek[k]
        raw = self.zstd.decompress(self._at(self.at[k], size), max_output_size=length)
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        lo, hi = self.first[k], self.first[k + 1]
        parts = np.split(np.frombuffer(raw, self.dtype), np.cumsum(self.counts[lo:hi])[:-1])
        return list(zip(self.docs[lo:hi], parts, strict=True))

    def documents(self, wanted: set) -> dict:
        """Ids of the wanted documents; only their frames are read."""
        out = {}
        for k in range(len(self.per_frame)):
            if wanted.intersection(self.docs[self.first[k] : self.first[k + 1]]):
                out |= {d: ids for d, ids in self.frame(k) if d in wanted}
        return out


def write(ids: DataFrame, to: str, dtype: str = "<u2", frame_bytes: int = 256 << 10) -> DataFrame:
    """Write sorted rows of encode() as one file a shard; return the files with their counts.

    A repeated task writes under a new name; only files named in the returned
    table belong to the output.
    """

    def run(batches):
        now, at = None, None
        for b in batches:
            for shard, doc_id, raw in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if now is None or shard != at:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(FILES.names, now.close(at), strict=True))], FILES)
                    now, at = ShardWriter(f"{to}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.zst", dtype, frame_bytes), shard
                now.add(doc_id, raw)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(FILES.names, now.close(at), strict=True))], FILES)

    return materialize(ids.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32. Memory: one frame and one index."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        import zlib

        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                reader = ShardReader(path)
                for k in range(len(reader.per_frame)):
                    docs, starts, counts, crcs = [], [], [], []
                    for doc_id, ids in reader.frame(k):
                        docs.append(doc_id)
                        starts.append(start)
                        counts.append(len(ids))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, counts, crcs)], schema=ROWS)

    placed = files.select("path", before.alias("base"), "shard")
    n = min(MOST_PARTS, max(1, files.count()))
    return placed.repartitionById(n, (F.col("shard") % n).cast("int")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encode, write and read back every document of docs (doc_id, text; other columns are ignored).

    Returns doc_id, start (ids of all documents before it in ascending doc_id
    order), n_tokens (with the end id) and ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). Null or empty texts have the end
    id alone; equal doc_ids follow each other in an order that their ids fix; an
    empty table gives no file and no row.
    """
    definition = vocabulary(tokenizer_path)
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1) <= 65536 else "<u4"
    return read(write(encode(docs, definition, end_id, shards), shared_dir(docs.sparkSession, "tokens"), dtype))
