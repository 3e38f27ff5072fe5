"""A hidden Markov language model.

Tokens are words (A-Z lowered) and one end per document. The most frequent words and the end are symbols of their own;
all other words share one symbol and split its probability in proportion to their smoothed counts in the whole corpus:
P(word | state) = P(shared | state) * P(word) / P(shared), so every state's distribution over all words, an unseen one
included, sums to one. Baum-Welch counts of every training document are summed across partitions in each round. The
score is the exact log10 likelihood of the whole text, by the forward recursion with scaling at every step.

Counts of all words come from the whole training corpus in one shuffle. Words whose count is at least a threshold, under
which at most COMMON words lie by a histogram of the counts, are looked up in a broadcast table; the others are joined,
so no join key is hot. Words are compared by 64-bit hashes.

In training, documents are cut into sequences of SEQUENCE tokens, all of which count; scoring has no cuts. The states' starting point is fitted on a
bounded sample: of WARM_DOCS documents, chosen by a hash, a stretch of at most WARM_TOKENS tokens each, from a place that
the hash tells; the rounds after it use every token of every training document.

Edge cases: a null or empty text is one end token; a null doc_id is held out and never trained on; without training
documents nothing is known: c = N = V = 0 and the score is the base score; repeated rows count and are scored each;
other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.text import small_batches, SpanHash, sums_between, text_batches, words_of
from geoframe.plans.storage import stored

STATES, SYMBOLS, COMMON, SEQUENCE = 8, 16_384, 400_000, 256
ROUNDS, WARM_ROUNDS, WARM_DOCS, WARM_TOKENS = 3, 15, 2000, 2048
SMOOTHING = 0.1
#: Entries that a task gathers before it hands on its sums, tokens of a Baum-Welch batch.
GATHERED, BATCH_TOKENS = 3_000_000, 400_000


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, as a signed integer; first word of each text."""
    starts, ends, firsts = words_of(data, offsets)
    return SpanHash(data)(starts, ends).view(np.int64), firsts


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word is in docs (text)."""

    def summed(parts):
        h, c = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        names, where = np.unique(h, return_inverse=True)
        return names, np.bincount(where, c, len(names)).astype(np.int64)

    def rows(batches):
        parts = []
        for _, data, offsets in text_batches(batches):
            parts.append(np.unique(word_hashes(data, offsets)[0], return_counts=True))
            if sum(len(p[0]) for p in parts) > GATHERED:
                parts = [summed(parts)]
                if len(parts[0][0]) > GATHERED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts.pop()], ["h", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(parts)], ["h", "c"])

    return small_batches(docs).select("text").mapInArrow(rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """Counts of the common words, ascending by hash; symbol: place among the most frequent, or the shared symbol."""

    h: np.ndarray
    c: np.ndarray
    symbol: np.ndarray
    n_symbols: int
    symbol_counts: np.ndarray
    tokens: int
    distinct: int

    @property
    def shared(self) -> int:
        return self.n_symbols

    @property
    def end(self) -> int:
        return self.n_symbols + 1

    @property
    def divisor(self) -> float:
        return self.tokens + SMOOTHING * (self.distinct + 1)

    def symbol_shares(self) -> np.ndarray:
        """Base probability of each symbol."""
        known = self.symbol_counts + SMOOTHING * (self.symbol_counts > 0)
        out = np.append(known[:-1], [0, known[-1]])
        out[self.shared] = self.divisor - out.sum()
        return out / self.divisor


def common_words(counts: DataFrame, train_docs: int, most: int = COMMON, symbols: int = SYMBOLS) -> Words:
    """At most `most` words, those over a count threshold; by a histogram of the counts."""
    step = F.floor(F.log2("c") * 8)
    steps = {r.step: r for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum("c").alias("total")).collect()}
    upto, least = 0, None
    for s in sorted(steps, reverse=True):
        if upto + steps[s].n > most:
            break
        upto, least = upto + steps[s].n, steps[s].least
    got = counts.where(F.col("c") >= least).select("h", "c").toArrow() if least is not None else None
    h, c = (got[k].to_numpy() if got is not None else np.zeros(0, np.int64) for k in ("h", "c"))
    rank = np.lexsort((h, -c))
    symbol = np.full(len(h), min(symbols, len(h)))
    symbol[rank[:symbols]] = np.arange(min(symbols, len(h)))
    order = np.argsort(h)
    tokens, distinct = sum(r.total for r in steps.values()) + train_docs, sum(r.n for r in steps.values()) + (train_docs > 0)
    n = min(symbols, len(h))
    return Words(h[order], c[order], symbol[order].astype(np.int32), n, np.append(c[rank[:symbols]], train_docs).astype(float), int(tokens), int(distinct))


def encoded(docs: DataFrame, words: Words, held_out: Column) -> DataFrame:
    """Per row of docs: row, doc_id, held_out, n_tokens, symbols, rare (hashes of words that are not common), and over
    the common words: their number, how many of them have no symbol of their own, the sum of log10(c + SMOOTHING), and that sum over those without their own symbol."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batches):
        words = sent.value
        logs = np.log10(words.c + SMOOTHING)
        for batch, data, offsets in text_batches(batches):
            h, firsts = word_hashes(data, offsets)
            keys, which = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(words.h, keys), max(len(words.h) - 1, 0))
            common = words.h[at] == keys if len(words.h) else np.zeros(len(keys), bool)
            symbol = np.where(common, words.symbol[at] if len(words.h) else 0, words.shared)
            log = np.where(common, logs[at] if len(words.h) else 0, 0.0)
            symbol, common, log = symbol[which].astype(np.uint16), common[which], log[which]
            ends = np.insert(symbol, firsts[1:], words.end)
            rare, upto = h[~common], np.concatenate([[0], np.cumsum(~common)])[firsts]
            raw, rare, to = ends.tobytes(), rare.tobytes(), (firsts + np.arange(len(firsts))).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(np.diff(firsts) + 1),
                    pa.array([raw[2 * a : 2 * b] for a, b in zip(to[:-1], to[1:])], pa.binary()),
                    pa.array([rare[8 * a : 8 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.binary()),
                    pa.array(sums_between(common.astype(float), firsts).astype(np.int64)),
                    pa.array(sums_between((common & (symbol == words.shared)).astype(float), firsts).astype(np.int64)),
                    pa.array(sums_between(log, firsts)),
                    pa.array(sums_between(np.where(symbol == words.shared, log, 0), firsts)),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "symbols", "rare", "n_common", "n_common_shared", "log_common", "log_shared"],
            )

    numbered = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out.alias("held_out"), "text")
    return numbered.mapInArrow(rows, "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, rare binary, n_common long, n_common_shared long, log_common double, log_shared double")


@dataclass
class HMM:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state


def sequences(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded matrix (time, sequence), longest sequence first; lengths."""
    parts = sorted(parts, key=len, reverse=True)
    lengths = np.array([len(p) for p in parts])
    out = np.zeros((lengths[0], len(parts)), np.int64)
    for i, p in enumerate(parts):
        out[: len(p), i] = p
    return out, lengths


def alive(seen: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many sequences (longest first) reach each time."""
    return np.searchsorted(-lengths, -np.arange(len(seen)), "left")


def steps(model: HMM, seen: np.ndarray, live: np.ndarray, begin: int, end: int, a: np.ndarray | None, total: np.ndarray, keep: bool = False):
    """The scaled recursion from time begin to end, on from the forward values a; adds to total. Returns the last values, and
    with keep all of them and the scales."""
    alphas, scales = [], []
    for t in range(begin, end):
        n = live[t]
        a = (np.broadcast_to(model.start, (n, len(model.start))) if t == 0 else a[:n] @ model.move) * model.emit[seen[t, :n]]
        scale = a.sum(1)
        a = a / scale[:, None]
        if keep:
            alphas.append(a)
            scales.append(scale)
        else:
            total[:n] += np.log(scale)
    return a, alphas, scales


def forward(model: HMM, seen: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log likelihood of each sequence."""
    total = np.zeros(len(lengths))
    steps(model, seen, alive(seen, lengths), 0, len(seen), None, total)
    return total


def expected(model: HMM, seen: np.ndarray, lengths: np.ndarray, block: int = SEQUENCE):
    """Baum-Welch counts of some sequences: start, move, emit, log likelihood."""
    live, total, a, before = alive(seen, lengths), np.zeros(len(lengths)), None, []
    if len(seen) <= block:
        before = [None]
    for begin in range(0, len(seen) if len(seen) > block else 0, block):
        before.append(a)
        a, _, _ = steps(model, seen, live, begin, min(begin + block, len(seen)), a, total)
    k, n_symbols = len(model.start), len(model.emit)
    move, emit, ahead = np.zeros((k, k)), np.zeros((n_symbols, k)), np.zeros((0, k))
    for begin in range(len(before) - 1, -1, -1):
        end = min((begin + 1) * block, len(seen))
        _, alphas, scales = steps(model, seen, live, begin * block, end, before[begin], total, True)
        if len(before) == 1:
            for scale in scales:
                total[: len(scale)] += np.log(scale)
        gammas = []
        for t in range(end - 1, begin * block - 1, -1):
            now, m = alphas.pop(), len(ahead)
            move += now[:m].T @ ahead
            b = np.concatenate([ahead @ model.move.T, np.ones((len(now) - m, k))])
            gammas.append(now * b)
            ahead = model.emit[seen[t, : len(now)]] * b / scales.pop()[:, None]
        gamma = np.concatenate(gammas)
        symbol = np.concatenate([seen[t, : live[t]] for t in range(end - 1, begin * block - 1, -1)])
        for s in range(k):
            emit[:, s] += np.bincount(symbol, gamma[:, s], n_symbols)
    return gammas[-1].sum(0), model.move * move, emit, total.sum()


def updated(start, move, emit, shares: np.ndarray) -> HMM:
    """Parameters from counts, smoothed by a few pseudo-counts of the base distribution."""
    start = (start + 1) / (start + 1).sum()
    move = (move + 1) / (move + 1).sum(1, keepdims=True)
    emit = emit + 20.0 * shares[:, None]
    return HMM(start, move, emit / emit.sum(0))


def batches_of(symbols: list[bytes]):
    """Whole sequences of about equal lengths, so little of a matrix is padding, about 4 * BATCH_TOKENS at a time: their places, matrix, lengths."""
    whole = [np.frombuffer(s, np.uint16).astype(np.int64) for s in symbols]
    order, at = sorted(range(len(whole)), key=lambda i: -len(whole[i])), 0
    while at < len(order):
        to, longest = at, len(whole[order[at]])
        while to < len(order) and (to - at + 1) * longest <= 4 * BATCH_TOKENS and (2 * len(whole[order[to]]) + 500 >= longest):
            to += 1
        to = max(to, at + 1)
        yield order[at:to], *sequences([whole[i] for i in order[at:to]])
        at = to


def cuts_of(symbols: list[bytes]):
    """All sequences of at most SEQUENCE symbols, BATCH_TOKENS at a time: matrix, lengths."""
    held, n = [], 0
    for raw in symbols:
        whole = np.frombuffer(raw, np.uint16).astype(np.int64)
        for at in range(0, len(whole), SEQUENCE):
            held.append(whole[at : at + SEQUENCE])
            n += len(held[-1])
            if n >= BATCH_TOKENS:
                yield sequences(held)
                held, n = [], 0
    if held:
        yield sequences(held)


def train(rows: DataFrame, words: Words, states: int = STATES, rounds: int = ROUNDS) -> HMM:
    """Baum-Welch over rows (row, symbols): a start from a bounded sample, then rounds over all rows."""
    shares, rng = words.symbol_shares(), np.random.default_rng(11)
    emit = shares[:, None] * np.exp(rng.normal(0, 1, (len(shares), states)))
    model = HMM(np.full(states, 1 / states), np.eye(states) * 0.9 + 0.1 / states, emit / emit.sum(0))
    # Two bytes a token.
    place, tokens = F.xxhash64("row"), F.octet_length("symbols") / 2
    begin = F.floor(F.pmod(place, F.lit(1 << 20)) / (1 << 20) * (F.greatest(tokens - WARM_TOKENS, F.lit(0)) + 1)).cast("int")
    stretch = F.substring("symbols", 2 * begin + 1, F.lit(2 * WARM_TOKENS))
    # Each task sends its own lowest rows to the driver, so rows that can't be among the lowest go first: 4 * WARM_DOCS are left.
    share = min(1.0, 4 * WARM_DOCS / max(1, rows.count()))
    few = rows.where(place <= int((2 * share - 1) * (2**63 - 1024)))
    sample = [r.symbols for r in few.select(stretch.alias("symbols"), place.alias("place")).orderBy("place").limit(WARM_DOCS).collect()]
    warm = list(cuts_of([bytes(s) for s in sample]))
    for _ in range(WARM_ROUNDS if warm else 0):
        sums = [sum(x) for x in zip(*(expected(model, *b) for b in warm))]
        model = updated(*sums[:3], shares)
    fields = ", ".join(f"s{i} double" for i in range(states))
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(model)

        def counts(batches):
            model, total = sent.value, None
            for batch in batches:
                for b in cuts_of(batch.column(0).to_pylist()):
                    one = expected(model, *b)[:3]
                    total = one if total is None else [x + y for x, y in zip(total, one)]
            if total is not None:
                start, move, emit = total
                some = np.flatnonzero(emit.sum(1))
                table = np.concatenate([emit[some], move, start[None]])
                kinds = np.concatenate([some, -1 - np.arange(len(move)), [-1 - len(move)]])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(table[:, i]) for i in range(table.shape[1]))], ["kind", *(f"s{i}" for i in range(table.shape[1]))])

        summed = rows.select("symbols").mapInArrow(counts, "kind long, " + fields).groupBy("kind").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(states)])
        got = {r.kind: [r[f"s{i}"] for i in range(states)] for r in summed.collect()}  # a row for each symbol and state at most
        if not got:
            break
        emit = np.zeros((len(shares), states))
        some = [k for k in got if k >= 0]
        emit[some] = [got[k] for k in some]
        model = updated(np.array(got[-1 - states]), np.array([got[-1 - i] for i in range(states)]), emit, shares)
        sent.unpersist()
    return model


def likelihoods(rows: DataFrame, model: HMM) -> DataFrame:
    """(row, fit): log10 likelihood of each row's whole sequence of symbols."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        model = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for places, seen, lengths in batches_of(batch.column(1).to_pylist()):
                out[places] = forward(model, seen, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out / math.log(10))], ["row", "fit"])

    return rows.select("row", "symbols").mapInArrow(scored, "row long, fit double")


def rare_sums(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, rare_known, log_rare): over each row's rare words, how many are known and the sum of log10(c + SMOOTHING)."""

    def pairs(batches):
        for batch in batches:
            rare = batch.column(1).to_pylist()
            many = [len(r) // 8 for r in rare]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(np.frombuffer(b"".join(rare), np.int64))], ["row", "h"])

    exploded = rows.select("row", "rare").where(F.octet_length("rare") > 0).mapInArrow(pairs, "row long, h long")
    c = F.coalesce("c", F.lit(0))
    return exploded.join(counts, "h", "left").groupBy("row").agg(F.count("c").alias("rare_known"), F.sum(F.log10(c + SMOOTHING)).alias("log_rare"))


def score(docs: DataFrame, held_out: Column, symbols: int = SYMBOLS, states: int = STATES) -> DataFrame:
    """Train on the rows of docs (doc_id, text) that aren't held out; score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The `symbols` (at most 65,534) most frequent words have emissions of their own in each of the states.
    """
    training = docs.where(~held_out)
    counts = stored(word_counts(training), "word-counts")
    words = common_words(counts, training.count(), symbols=symbols)
    rows = stored(encoded(docs, words, held_out), "symbols")
    model = train(rows.where(~F.col("held_out")), words, states)
    end_known = 1 if words.tokens else 0
    log_divisor, log_end = math.log10(words.divisor), math.log10(words.symbol_counts[-1] + SMOOTHING)
    n_rare, rare_log = F.col("n_tokens") - 1 - F.col("n_common"), F.coalesce("log_rare", F.lit(0.0))
    whole = rows.join(rare_sums(rows, counts), "row", "left").join(likelihoods(rows, model), "row")
    log_share = math.log10(words.symbol_shares()[words.shared])
    base = F.col("log_common") + rare_log + log_end - F.col("n_tokens") * log_divisor
    n_shared = n_rare + F.col("n_common_shared")
    score = F.col("fit") + F.col("log_shared") + rare_log - n_shared * (log_divisor + log_share)
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("rare_known", F.lit(0)) + end_known).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (score if words.tokens else base).alias("score"))
