"""Toxicity by multiple-instance learning.

Only documents have labels; sentences don't. A sentence's logit is a bias and the weights of its words (a word that
repeats the one before it left out; each word's own, and those of its first four and five letters, which catch inflected forms); p = sigmoid(logit). A document's
score is the noisy-or of its sentences, 1 - prod(1 - p), and the weights are those under which the document labels are
likeliest. A sentence without a telling word is no evidence: its p is exactly zero, however many of them a text has. The trained sentence scores then say which sentences offend.

Edge cases: a null or empty text, or one without letters, has no sentence and scores 0; labels that are null or belong
to no document are not used; several labels of one document count as toxic if one does; with no labelled document of
either class every score is 0; other columns are ignored; repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm.text import LOWER, NO_LETTERS, SpanHash, fresh, small_batches, sums_between, text_batches, words_of

BUCKETS = 1 << 18
#: Where the bias of a telling sentence starts from in training.
BIAS = -5.0
#: Bytes that end a sentence.
ENDS = np.zeros(256, bool)
ENDS[list(b".!?\n")] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sentences_of(data: np.ndarray, offsets: np.ndarray):
    """Bucket of each word's features (one row a word), first word of each sentence, first sentence of each text, word spans."""
    starts, ends, firsts = words_of(data, offsets, NO_LETTERS)
    span = SpanHash(data)
    whole = span(starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = whole[1:] == whole[:-1]
    again[firsts[:-1][firsts[:-1] < len(starts)]] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    starts, ends, firsts = starts[~again], ends[~again], kept[firsts]
    buckets = np.stack([(span(starts, np.minimum(ends, starts + n) if n else ends) + np.uint64(n)) & np.uint64(BUCKETS - 1) for n in (0, 4, 5)], 1).astype(np.int32)
    stops = np.concatenate([[0], np.cumsum(ENDS[data])])[starts]
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])
    first_words = np.flatnonzero(new)
    return buckets, np.append(first_words, len(starts)), np.searchsorted(first_words, firsts), starts, ends


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def logits(model: Model, buckets: np.ndarray, first_words: np.ndarray) -> np.ndarray:
    return model.bias + sums_between(model.weights[buckets].sum(1, dtype=np.float64), first_words)


def evidence(model: Model, buckets: np.ndarray, first_words: np.ndarray) -> np.ndarray:
    """logits(), and minus infinity for sentences without a word of any weight."""
    silent = sums_between((model.weights[buckets] != 0).any(1), first_words) == 0
    return np.where(silent, -np.inf, logits(model, buckets, first_words))


def chunks(texts: list[str], size: int = 250):
    """sentences_of() so many texts at a time."""
    for at in range(0, len(texts), size):
        raw = [t.encode() for t in texts[at : at + size]]
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        yield at, sentences_of(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))[:3]


def telling(texts: list[str], toxic: np.ndarray, least: float = 4.5) -> np.ndarray:
    """Buckets found in a larger share of toxic than of clean texts, by so many standard errors: others get no weight."""
    a, b = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for at, (buckets, first_words, first_sentences) in chunks(texts):
        text = np.repeat(np.arange(len(first_sentences) - 1), np.diff(first_words[first_sentences]))
        pairs = np.unique((text[:, None] * BUCKETS + buckets).ravel())
        marked = toxic[at + pairs // BUCKETS]
        a += np.bincount(pairs[marked] % BUCKETS, minlength=BUCKETS)
        b += np.bincount(pairs[~marked] % BUCKETS, minlength=BUCKETS)
    n, m = len(toxic), toxic.sum()
    share = (a + b + 1) / (n + 2)
    z = (a / m - b / (n - m)) / np.sqrt(share * (1 - share) * (1 / m + 1 / (n - m)))
    return (z > least) & (a >= 5)


def train(texts: list[str], labels: np.ndarray, epochs: int = 80, rate: float = 0.25, shrink: float = 5e-3) -> Model:
    """Weights by full-batch Adam on the likelihood of the document labels under noisy-or."""
    toxic = labels.astype(bool)
    used = telling(texts, toxic)
    # Words without a telling bucket add nothing, nor do sentences without such words.
    parts = []
    for at, (buckets, first_words, first_sentences) in chunks(texts):
        some = np.flatnonzero(used[buckets].any(1))
        sentence = np.searchsorted(first_words, some, "right") - 1
        text = np.searchsorted(first_sentences, sentence, "right") - 1
        parts.append((buckets[some], at + text, sentence, np.diff(first_sentences)))
    base = np.concatenate([[0], np.cumsum([p[3].sum() for p in parts])])
    buckets, sentence = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] + n for p, n in zip(parts, base)])
    first_words = np.append(np.flatnonzero(np.diff(sentence, prepend=-1)), len(sentence))
    text = np.concatenate([p[1] for p in parts])[first_words[:-1]]
    # The bias is the last of the parameters.
    p = np.append(np.zeros(BUCKETS), BIAS)
    mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, epochs + 1):
        loss, grad = likelihood(p, buckets, first_words, text, toxic)
        grad += shrink / len(texts) * np.append(p[:-1], 0)
        grad[:-1][~used] = 0
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        p -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model(p[:-1].astype(np.float32), float(p[-1]))


def likelihood(p: np.ndarray, buckets: np.ndarray, first_words: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the labels under noisy-or, and its gradient, at the weights and (last) the bias p."""
    z = logits(Model(p[:-1], p[-1]), buckets, first_words)
    total = np.clip(np.bincount(text, softplus(z), len(toxic)), 1e-6, None)  # -log of the chance that no sentence offends
    loss = np.where(toxic, -np.log(-np.expm1(-total)), total).mean()
    pull = np.where(toxic, -1 / np.expm1(np.clip(total, 0, 60)), 1.0) / len(toxic)
    by_sentence = pull[text] / (1 + np.exp(-np.clip(z, -60, 60)))
    by_word = np.repeat(by_sentence, np.diff(first_words))
    grad = sum(np.bincount(buckets[:, k], by_word, BUCKETS) for k in range(buckets.shape[1]))
    return float(loss), np.append(grad, by_sentence.sum())


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 3000, clean: int = 5000, max_chars: int = 50_000) -> Model | None:
    """Train on a bounded sample: the first so many documents of each class by a hash of doc_id, of at most max_chars each.

    Of rows that share an id the least text is taken, so no more texts than ids go to the driver.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ordered = marked.select("doc_id", "toxic", F.xxhash64("doc_id").alias("place"))
    chosen = ordered.where("toxic = 1").orderBy("place", "doc_id").limit(toxic).unionByName(ordered.where("toxic = 0").orderBy("place", "doc_id").limit(clean))
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, max_chars)).join(F.broadcast(chosen), "doc_id")
    got = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = got["toxic"].to_numpy()
    if not 0 < (y == 1).sum() < len(y):
        return None
    return train(got["text"].to_pylist(), y == 1)


def score(docs: DataFrame, model: Model | None, keep: list[str] = ()) -> DataFrame:
    """doc_id and the columns keep, with score and where the worst sentence is (worst_start, worst_end in code points; null if none)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in ("doc_id", *keep)]

    def rows(batches):
        model = sent.value
        for batch, data, offsets in text_batches(batches):
            n = batch.num_rows
            buckets, first_words, first_sentences, starts, ends = sentences_of(data, offsets)
            result, worst = np.zeros(n), np.full((n, 2), -1)
            if model is not None and len(starts):
                z = evidence(model, buckets, first_words)
                result = -np.expm1(-sums_between(softplus(z), first_sentences))
                some = np.flatnonzero(np.diff(first_sentences))
                top = np.maximum.reduceat(z, first_sentences[:-1][some])
                text = np.repeat(np.arange(n), np.diff(first_sentences))
                best = np.flatnonzero(z == np.repeat(top, np.diff(first_sentences)[some]))
                where, at = np.unique(text[best], return_index=True)
                characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                worst[where, 0] = characters[starts[first_words[best[at]]]] - characters[offsets[where]]
                worst[where, 1] = characters[ends[first_words[best[at] + 1] - 1]] - characters[offsets[where]]
            none = worst[:, 0] < 0
            columns = [c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.clip(result, 0, 1)), pa.array(worst[:, 0], mask=none), pa.array(worst[:, 1], mask=none)], [*(f.name for f in fields), "score", "worst_start", "worst_end"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return small_batches(docs).select("doc_id", *keep, "text").mapInArrow(rows, schema + ", score double, worst_start long, worst_end long")


def without_toxic(docs: DataFrame, model: Model | None, limit: float = 0.3) -> DataFrame:
    """The rows of docs that score under the limit, with their own columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = sent.value
        for batch, data, offsets in text_batches(fresh(batches)):
            if model is not None:
                buckets, first_words, first_sentences, _, _ = sentences_of(data, offsets)
                total = sums_between(softplus(evidence(model, buckets, first_words)), first_sentences)
                batch = batch.filter(pa.array(-np.expm1(-total) < limit))
            yield batch

    return small_batches(docs).mapInArrow(rows, docs.schema)
