"""Language identification by a byte convolutional network, trained in numpy.

The network embeds bytes, applies filters of several widths, takes each filter's largest response over a window, and maps these
to the languages by softmax. A text is cut into windows of fixed length that cover all of its bytes; its log-probabilities are
the means over its windows, weighted by length.

Training: a bounded sample, SAMPLE_DOCS documents of least id hash with WINDOWS windows each, is brought to the driver; the bound
holds at any size of the corpus. Only the text and its label are seen.

Cases: null text or a text without any letter is `und` with score 0; documents without a label are predicted like any other
and never learnt from; where no labelled document is left to learn from, all are `und`; repeated rows are predicted alike; of equally likely
languages the first in order of names is told; an empty table gives no rows; other columns, whatever their names, are left alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, require, string_bytes, tidy

SAMPLE_DOCS = 4000
WINDOWS = 3
LETTER = regex.compile(r"\p{L}")
UND = "und"


@dataclass
class ByteCNN:
    """widths x filters convolution over byte embeddings, max pooling over the window, softmax over languages."""

    embed: np.ndarray  # 256 x e
    kernel: np.ndarray  # (widest * e) x (widths * filters); narrower filters are zero in the rows they don't see
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]
    window: int

    @property
    def widest(self) -> int:
        return len(self.kernel) // self.embed.shape[1]

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, widest * e): the embedded bytes that the filters see at each position."""
        e = self.embed[x]
        n, length, dim = e.shape
        return np.lib.stride_tricks.as_strided(e, (n, length - self.widest + 1, self.widest * dim), e.strides)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities, pooled responses, and where they come from."""
        p = self.patches(x)
        r = (np.ascontiguousarray(p).reshape(-1, p.shape[2]) @ self.kernel).reshape(*p.shape[:2], -1)
        at = r.argmax(1)
        pooled = np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0] + self.bias, 0)
        return self.classify(pooled), pooled, at

    def classify(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def log_probabilities(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        out = []
        for i in range(0, len(x), batch):
            p = self.patches(x[i : i + batch])
            r = (np.ascontiguousarray(p).reshape(-1, p.shape[2]) @ self.kernel).reshape(*p.shape[:2], -1)
            out.append(self.classify(np.maximum(r.max(1) + self.bias, 0)))
        return np.concatenate(out)


def train(x: np.ndarray, y: list[str], window: int, widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, dim: int = 8, epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteCNN:
    """Adam on the cross-entropy, languages weighted by the square root of their rarity."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(y))
    index = {k: i for i, k in enumerate(languages)}
    t = np.array([index[k] for k in y])
    weight = np.sqrt(len(t) / len(languages) / np.bincount(t, minlength=len(languages)))
    widest, total = max(widths), filters * len(widths)
    mask = np.zeros((widest * dim, total), np.float32)
    for k, w in enumerate(widths):
        mask[: w * dim, k * filters : (k + 1) * filters] = 1
    normal = lambda *s: rng.standard_normal(s).astype(np.float32)
    net = ByteCNN(normal(256, dim) * 0.5, normal(widest * dim, total) * mask * (2 / (widest * dim)) ** 0.5, np.zeros(total, np.float32), normal(total, len(languages)) * 0.2, np.zeros(len(languages), np.float32), languages, window)
    names = ("embed", "kernel", "bias", "out", "out_bias")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for i in range(0, len(order), batch):
            of = order[i : i + batch]
            xb, tb = x[of], t[of]
            logp, pooled, at = net.forward(xb)
            d = np.exp(logp)
            d[np.arange(len(of)), tb] -= 1
            d *= (weight[tb] / len(of))[:, None].astype(np.float32)
            dp = (d @ net.out.T) * (pooled > 0)
            seen = net.patches(xb)[np.arange(len(of))[:, None], at]  # windows x filters x (widest * dim)
            grads = {"out": pooled.T @ d, "out_bias": d.sum(0), "bias": dp.sum(0), "kernel": np.einsum("nfk,nf->kf", seen, dp) * mask, "embed": np.zeros_like(net.embed)}
            back = (dp[:, :, None] * net.kernel.T[None]).reshape(len(of), total, widest, dim)
            np.add.at(grads["embed"], xb[np.arange(len(of))[:, None, None], at[:, :, None] + np.arange(widest)], back)
            step += 1
            for k in names:
                g = grads[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                getattr(net, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def windows(data: np.ndarray, off: np.ndarray, window: int, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, text of each, weight of each) in portions of about `slots` windows; the last window of a text ends where it ends."""
    texts, starts, sizes, n = [], [], [], 0

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, start, size = (np.concatenate(c) for c in (texts, starts, sizes))
        at = start[:, None] + np.arange(window)
        x = data[np.minimum(at, len(data) - 1)]
        x[np.arange(window) >= size[:, None]] = 0
        return x, text, size

    for i in range(len(off) - 1):
        a, b = int(off[i]), int(off[i + 1])
        if a == b:
            continue
        s = np.minimum(np.arange(a, b, window), max(a, b - window))
        for k in range(0, len(s), slots):
            part = s[k : k + slots]
            texts.append(np.full(len(part), i))
            starts.append(part)
            sizes.append(np.full(len(part), min(window, b - a)))
            n += len(part)
            if n >= slots:
                yield cut()
                texts, starts, sizes, n = [], [], [], 0
    if n:
        yield cut()


def fit(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", doc_id: str = "doc_id", window: int = 256, sample_docs: int = SAMPLE_DOCS, per_doc: int = WINDOWS) -> ByteCNN | None:
    """Train on a bounded sample of the labelled rows that `learn` selects."""
    rows = require(docs, doc_id, text, label).toDF("doc_id", "text", "label").where(learn & F.col("label").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))
    last = rows.select(key.alias("k")).orderBy("k").limit(sample_docs).agg(F.max("k")).first()[0]
    if last is None:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (t, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if LETTER.search(t):
                    raw = t.encode("utf-8", "replace")
                    for k in range(per_doc):
                        a = (len(raw) - window) * k // max(1, per_doc - 1) if len(raw) > window else 0
                        piece = raw[a : a + window] if k != 1 or len(raw) <= window else raw[a : a + window // 4]
                        found.append((piece.ljust(window, b"\0"), y))
                        if len(raw) <= window:
                            break
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], ["x", "y"])

    sample = rows.where(key <= F.lit(last)).select("text", F.col("label").cast("string").alias("label")).mapInArrow(tidy(cut), "x binary, y string")
    got = sample.orderBy("y", "x").limit(2 * sample_docs * per_doc).toArrow()  # the limit only bounds ids repeated without end
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint8).reshape(-1, window)
    return train(x, got["y"].to_pylist(), window)


def predict_batch(net: ByteCNN | None, col: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column."""
    n = len(col)
    lang, score = [UND] * n, np.zeros(n)
    if net is None or not n:
        return lang, score
    data, off = string_bytes(col)
    logp, weight = np.zeros((n, len(net.languages))), np.zeros(n)
    for x, of, size in windows(data, off, net.window, 2048):
        np.add.at(logp, of, net.log_probabilities(x) * size[:, None])
        np.add.at(weight, of, size)
    p = logp / np.maximum(weight, 1)[:, None]
    p = np.exp(p - p.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    for i, t in enumerate(col):
        s = t.as_py()
        if s and LETTER.search(s):
            lang[i], score[i] = net.languages[best[i]], p[i, best[i]]
    return lang, score


def predict(docs: DataFrame, net: ByteCNN | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, with lang_pred and score; the network is a few ten thousand numbers and travels with the task."""
    rows = require(docs, *keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict_batch(net, batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, crc_remainder("doc_id", 4) != 2)
    return predict(docs, net).withColumn("held_out", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)))


def keep_known(docs: DataFrame, net: ByteCNN | None, min_score: float = 0.35, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known: not `und`, and predicted with at least the least score.

    Without a network only texts without a letter go."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict_batch(net, batch.column(at))
            known = [LETTER.search(t.as_py() or "") is not None for t in batch.column(at)] if net is None else [a != UND and s >= min_score for a, s in zip(lang, score, strict=True)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
