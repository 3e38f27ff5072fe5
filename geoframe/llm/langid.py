"""Language identification by a convolutional network over bytes.

A text is cut into windows of a fixed number of bytes. Bytes are embedded; filters of several widths slide over the
window; each filter's highest value, after a ReLU, goes to a softmax over the languages. The network is trained in
numpy. A text's prediction is the language with the highest mean log-probability over its windows, each weighted by
its letters; the score is that language's share.

Edge cases: a null text, an empty one or one without letters is `und` with score 0; training rows need a text with a
letter and a non-null language; if there are none, every prediction is `und`; other columns are ignored; repeated rows
are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.llm.text import LOWER, NO_LETTERS, small_batches, sums_between, text_batches

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8


@dataclass
class Network:
    languages: list[str]
    p: dict[str, np.ndarray]


def forward(p: dict, windows: np.ndarray):
    """Log-probabilities of each window's languages; and what backward() needs."""
    x = p["embed"][windows]
    pooled, where, views = [], [], []
    for w in WIDTHS:
        view = sliding_window_view(x.reshape(len(x), -1), w * EMBEDDING, axis=1)[:, ::EMBEDDING]
        flat = view.reshape(-1, w * EMBEDDING)
        out = (flat @ p[f"k{w}"]).reshape(len(x), WINDOW - w + 1, FILTERS)
        views.append(view)
        where.append(out)
        pooled.append(out.max(1) + p[f"b{w}"])
    h = np.maximum(np.concatenate(pooled, 1), 0)
    z = h @ p["out"] + p["bias"]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True)), h, where, views


def backward(p: dict, windows: np.ndarray, y: np.ndarray) -> dict:
    logp, h, outs, views = forward(p, windows)
    d = np.exp(logp)
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    grads = {"out": h.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
    dh = (d @ p["out"].T) * (h > 0)
    rows = np.arange(len(y))[:, None]
    for i, w in enumerate(WIDTHS):
        own, at = dh[:, i * FILTERS : (i + 1) * FILTERS], outs[i].argmax(1)
        grads[f"b{w}"] = own.sum(0)
        seen = views[i][rows, at]  # window, filter, width * embedding
        grads[f"k{w}"] = np.einsum("nfd,nf->df", seen, own)
        back = own[:, :, None] * p[f"k{w}"].T[None]
        for j in range(w):
            np.add.at(grads["embed"], windows[rows, at + j].ravel(), back[:, :, j * EMBEDDING : (j + 1) * EMBEDDING].reshape(-1, EMBEDDING))
    return grads


def train(windows: np.ndarray, y: np.ndarray, n: int, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> dict:
    """Parameters by Adam on the cross-entropy of single windows."""
    rng = np.random.default_rng(seed)
    shapes = {"embed": (256, EMBEDDING), "out": (FILTERS * len(WIDTHS), n), "bias": (n,)} | {f"k{w}": (w * EMBEDDING, FILTERS) for w in WIDTHS} | {f"b{w}": (FILTERS,) for w in WIDTHS}
    p = {k: (rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    mean, square = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            t += 1
            own = order[at : at + batch]
            for k, g in backward(p, windows[own], y[own]).items():
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * square[k] + 0.001 * g * g
                p[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows side by side over each whole text (zeros after its end), their letters, and each text's first window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(firsts[-1] * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(firsts[:-1] * WINDOW - offsets[:-1], sizes)] = data
    out = out.reshape(-1, WINDOW)
    return out, (~NO_LETTERS[out]).sum(1), firsts


def fit(docs: DataFrame, most: int = 6000, max_chars: int = 50_000, per_text: int = 3) -> Network | None:
    """Train on a bounded sample of docs (text, lang): at most `most` texts, about as many of each language (one at least, as
    long as there are no more languages than that), chosen by a hash of the row.

    Of a text longer than max_chars a part of that length is taken, from a place that the hash tells. Each text gives per_text
    windows: its first and others from anywhere.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    begin = 1 + F.floor(place / (1 << 20) * (F.greatest(F.length("text") - max_chars, F.lit(0)) + 1)).cast("int")
    known = docs.where("lang is not null and text is not null").select("lang", F.substring("text", begin, F.lit(max_chars)).alias("text"), place.alias("place"))
    counts = docs.where("lang is not null and text is not null").groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    many = F.count("*").over(Window.partitionBy())
    limits = counts.select("lang", F.greatest(F.least(F.lit(1.0), 1.2 * most / many / F.col("n")) * (1 << 20), F.col("first") + 1).alias("limit"))
    some = known.join(F.broadcast(limits.orderBy(F.desc("limit")).limit(most)), "lang").where(F.col("place") < F.col("limit"))
    # The first of each language before all others, so that none is left out for being rare.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    got = some.withColumn("rank", F.when(rank == 1, 0).otherwise(1)).orderBy("rank", "place", "text").limit(most).select("lang", "text").toArrow()
    learned = sorted(set(got["lang"].to_pylist()))
    rng, windows, y = np.random.default_rng(3), [], []
    for lang, text in zip(got["lang"].to_pylist(), got["text"].to_pylist()):
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        for at in {0, *rng.integers(0, max(1, len(data) - WINDOW), per_text - 1).tolist()}:
            window = np.zeros(WINDOW, np.uint8)
            part = data[at : at + WINDOW]
            window[: len(part)] = part
            if (~NO_LETTERS[part]).any():
                windows.append(window)
                y.append(learned.index(lang))
    return Network(learned, train(np.array(windows), np.array(y), len(learned))) if windows else None


def no_letters(raw: bytes) -> bool:
    return not any(c.isalpha() for c in raw.decode())


def predicted(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    windows, letters, firsts = windows_of(data, offsets)
    logp = np.concatenate([forward(net.p, windows[i : i + 128])[0] for i in range(0, len(windows), 128)] or [np.zeros((0, len(net.languages)), np.float32)])
    total = sums_between(logp * letters[:, None], firsts)
    weight = sums_between(letters.astype(float), firsts)
    mean = total / np.maximum(weight, 1)[:, None]
    share = np.exp(mean - mean.max(1, keepdims=True, initial=-1e9)) if len(mean) else mean
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    names, score = [net.languages[i] for i in best], share[np.arange(len(best)), best]
    has_ascii = sums_between(((data < 128) & ~NO_LETTERS[data]).astype(float), offsets) > 0
    for i in np.flatnonzero(~has_ascii).tolist():
        if no_letters(data[offsets[i] : offsets[i + 1]].tobytes()):
            names[i], score[i] = "und", 0.0
    return names, np.clip(score, 0, 1)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches):
        for batch, data, offsets in text_batches(batches, limit=1 << 20):
            names, score = predicted(sent.value, data, offsets) if sent.value else (["und"] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, net: Network | None, least: float = 0.4) -> DataFrame:
    """The rows of docs, with their own columns, whose language is told with at least that score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches):
        for batch, data, offsets in text_batches(batches, limit=1 << 20):
            if sent.value:
                names, score = predicted(sent.value, data, offsets)
                batch = batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, score)], pa.bool_()))
            else:
                batch = batch.slice(0, 0)
            yield batch

    return small_batches(docs).mapInArrow(rows, docs.schema)
