"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over fixed-length windows of bytes; each filter
keeps its maximum in the window; a softmax layer reads these maxima. As the
input is bytes, a filter is a table of 256 rows for each of its places, and two
neighbouring places are one table of 65,536 rows when predicting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import small_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
UNKNOWN = "und"
#: Languages up to which their shares are sent to every executor.
MOST_BROADCAST = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def encode(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes of the whole text, zero-padded at the end."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class ByteConv:
    def __init__(self, classes: list[str], params: dict | None = None, seed: int = 1):
        self.classes = classes
        if params:
            self.params = params
            return
        r = np.random.default_rng(seed)
        self.params = {f"t{w}": r.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.params |= {
            "b": np.zeros(len(WIDTHS) * FILTERS, np.float32),
            "v": r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32), "c": np.zeros(len(classes), np.float32)
        }

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        best, where = [], []
        for w in WIDTHS:
            t, n = self.params[f"t{w}"], x.shape[1] - w + 1
            out = t[0][x[:, :n]]
            for j in range(1, w):
                out += t[j][x[:, j : j + n]]
            where.append(out.argmax(1))
            best.append(np.take_along_axis(out, where[-1][:, None], 1)[:, 0])
        return np.concatenate(best, 1), where

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.params["b"], 0) @ self.params["v"] + self.params["c"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, size: int = 128, rate: float = 0.01, seed: int = 1) -> None:
        """Adam on cross entropy; only the place of each maximum gets a gradient."""
        r, moments, step = np.random.default_rng(seed), {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in self.params.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), size):
                i = order[at : at + size]
                xb, (pooled, where) = x[i], self._pooled(x[i])
                h = np.maximum(pooled + self.params["b"], 0)
                dz = self._softmax(pooled)
                dz[np.arange(len(i)), y[i]] -= 1
                dz /= len(i)
                dh = (dz @ self.params["v"].T) * (h > 0)
                g = {"v": h.T @ dz, "c": dz.sum(0), "b": dh.sum(0)}
                for n, w in enumerate(WIDTHS):
                    g[f"t{w}"] = np.zeros_like(self.params[f"t{w}"])
                    part = dh[:, n * FILTERS : (n + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[f"t{w}"][j], (np.take_along_axis(xb, where[n] + j, 1), np.arange(FILTERS)[None]), part)
                step += 1
                for k, p in self.params.items():
                    m, v = moments[k]
                    m += 0.1 * (g[k] - m)
                    v += 0.001 * (g[k] ** 2 - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def ready(self) -> None:
        """Tables of two neighbouring places."""
        t = self.params
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.tables = [pair(*t["t2"]), pair(*t["t3"][:2]), t["t3"][2], pair(*t["t4"][:2]), pair(*t["t4"][2:])]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        two = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        a, b, c, d, e = self.tables
        w2 = np.take(a, two, 0).max(1)
        out = np.take(b, two[:, :-1], 0)
        out += np.take(c, x[:, 2:], 0)
        w3 = out.max(1)
        out = np.take(d, two[:, :-2], 0)
        out += np.take(e, two[:, 2:], 0)
        return self._softmax(np.concatenate([w2, w3, out.max(1)], 1))

    def predict(self, texts: list[str], block: int = 128) -> list[tuple[str, float]]:
        """Language and score of whole texts: windows' probabilities weighted by their bytes. Windows of all texts are run in equal blocks."""
        parts = [encode(t) for t in texts]
        sizes = [len(p) for p in parts]
        x = np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.uint8)
        p = np.concatenate([self.windows(x[i : i + block]) for i in range(0, len(x), block)]) if len(x) else np.zeros((0, len(self.classes)))
        weight = np.maximum((x != 0).sum(1), 1)[:, None]
        starts = np.cumsum([0, *sizes[:-1]])
        mean = np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts) if texts else p
        best = mean.argmax(1)
        return [(self.classes[k], float(min(1.0, m[k]))) for k, m in zip(best, mean, strict=True)]


def held_out():
    """Documents kept from training: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame, per_language: int = 400, per_document: int = 4) -> tuple[np.ndarray, list[str]]:
    """Bounded sample of labelled windows: per_language different documents of each language, the first by a hash of
    id and text, with per_document windows spread over each text."""
    docs = docs.select("doc_id", "text", "lang")
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # by id and text: rows that share an id or repeat a text must not fill or empty a language's sample
    key = F.xxhash64("doc_id", "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    table = docs.sparkSession.createDataFrame([(lang, min(1.0, 2 * per_language / max(1, n))) for lang, n in counts.items()], "_l string, _share double")
    u = F.pmod(key, F.lit(1 << 52)) / float(1 << 52)
    spread = F.array(
        *(
            F.expr(
                f"substring(text, 1 + cast(greatest(0, length(text) - {WINDOW}) * {i / max(1, per_document - 1)} as int), {WINDOW})"
            ) for i in range(per_document)
        )
    )
    # the join's rows are few and slim: of ids whose hashes are small, their windows alone
    sample = rows.join(
        F.broadcast(table) if len(counts) <= MOST_BROADCAST else table, F.col("lang") == F.col("_l")
    ).where(u < F.col("_share")).select("lang", u.alias("u"), "doc_id", F.array_distinct(spread).alias("parts"))
    # rows that repeat a document are one; the limit holds before anything is gathered, whatever the ids
    first = Window.partitionBy("lang").orderBy("u", "doc_id", "parts")
    sample = sample.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).collect()
    x, y = [], []
    for r in sorted(sample, key=lambda r: (r.lang, r["_n"])):
        for part in r.parts:
            x.append(encode(part)[0])
            y.append(r.lang)
    return np.stack(x), y


def fit(docs: DataFrame, per_language: int = 400, epochs: int = 8) -> ByteConv | None:
    """A network for the languages of docs (doc_id, text, lang), or None if there is no labelled row."""
    x, y = training_windows(docs, per_language)
    if not len(x):
        return None
    classes = sorted(set(y))
    place = {c: i for i, c in enumerate(classes)}
    model = ByteConv(classes)
    model.train(x, np.array([place[c] for c in y]), epochs)
    return model


def identify_languages(docs: DataFrame, per_language: int = 400, epochs: int = 8) -> DataFrame:
    """Predict the language of every whole text of docs (doc_id, text, lang).

    Returns doc_id, held_out, lang_pred and score. A null text or one without a
    letter is UNKNOWN with score 0, as is every text if no row is labelled.
    Null languages are not learned; a null doc_id is neither learned from nor
    held out; repeated rows are predicted alike; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fitted = fit(docs, per_language, epochs)
    model = spark.sparkContext.broadcast(fitted and (fitted.classes, fitted.params))

    def run(batches):
        net = model.value and ByteConv(*model.value)
        if net:
            net.ready()
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None] if net else []
            out = [(UNKNOWN, 0.0)] * len(texts)
            for at in range(0, len(known), 64):
                i = known[at : at + 64]
                for k, guess in zip(i, net.predict([texts[j] for j in i]), strict=True):
                    out[k] = guess
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.float64())
                ],
                names=["doc_id", "held_out", "lang_pred", "score"]
            )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
