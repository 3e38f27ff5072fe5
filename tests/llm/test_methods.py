"""The methods themselves against plain versions: sketches, convolutions, noisy-or, Baum-Welch in blocks, short items, odd pages."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoframe.llm import decontam, hmm, html_extract, langid, packing, queries, sketch, toxicity

SF = "/root/testdata/sf0.001"


def text_of(n, seed):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(100_000)}" for _ in range(n))


def plain_sketch(text):
    """All shingle hashes as signed 64-bit numbers, by the standard XXH64, each word's seed the hash before it."""
    words = [w for w in re.split(r"[ \t-\r]+", (text or "").lower()) if w]
    hashes = set()
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    return sorted(h for h in hashes if h < sketch.THRESHOLD), min(hashes)


def test_op8_against_a_plain_sketch(spark):
    texts = ["", " ", "One two", "one  TWO", text_of(5, 1), text_of(9, 2), text_of(60, 3), text_of(60, 3) + " more", text_of(700, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sketch.compared_with_next(docs).collect()}

    def as_text(s):
        return "".join(f"{h & (2**64 - 1):016x}" for h in s[0]) if s[0] else f"-{s[1] & (2**64 - 1):016x}"

    def likeness(a, b):
        x, y = set(a[0]), set(b[0])
        return len(x & y) / len(x | y) if x | y else float(a[1] == b[1])

    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, other, after = plain_sketch(t), plain_sketch(edited), plain_sketch(following)
        assert got[i].fingerprint == as_text(own) and got[i].edited_fingerprint == as_text(other)
        assert np.isclose(got[i].near_edited, likeness(own, other)) and np.isclose(got[i].near_next, likeness(own, after))
    assert got[2].fingerprint == got[3].fingerprint and got[3].near_next == 0 and got[2].near_next == 1


def test_op8_what_a_text_holds_it_holds_wholly(spark):
    rows = [(n, text_of(n, n), text_of(300, 900 + n) + " " + text_of(n, n) + " " + text_of(300, 500 + n)) for n in list(range(1, 40)) + [200]]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    for c in "ab":
        df = sketch.with_sketch(df, c, f"s_{c}")
    a, b = F.col("s_a"), F.col("s_b")
    # Words at the seams make shingles of their own; what is merged is just the union.
    r = df.select("n", sketch.containment(a, b).alias("held"), sketch.containment(b, a).alias("back"), sketch.merged(a, b).alias("m"), "s_a", "s_b").where("n >= 5").collect()
    assert all(x.held == 1 for x in r) and all(x.back < 0.9 for x in r)
    assert all(x.m.hashes == sorted(set(x.s_a.hashes) | set(x.s_b.hashes)) and x.m.least == min(x.s_a.least, x.s_b.least) for x in r)


def test_op9_forward_and_gradients():
    rng = np.random.default_rng(2)
    windows, y = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    p = langid.train(windows, y, 3, epochs=1)
    p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in p.items()}
    logp = langid.forward(p, windows)[0]
    for n, window in enumerate(windows):
        features = []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                best = max(sum(p["embed"][window[i + j]] @ p[f"k{w}"][j * langid.EMBEDDING : (j + 1) * langid.EMBEDDING, f] for j in range(w)) for i in range(langid.WINDOW - w + 1))
                features.append(max(0.0, best + p[f"b{w}"][f]))
        z = np.array(features) @ p["out"] + p["bias"]
        assert np.allclose(logp[n], z - np.log(np.exp(z).sum()))
    grads, loss = langid.backward(p, windows, y), lambda: -langid.forward(p, windows)[0][np.arange(5), y].mean()
    for k, v in p.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(4)]:
            old, step = v[at], 1e-6
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert np.isclose((up - down) / (2 * step), grads[k][at], atol=1e-5), k


def test_op9_rare_and_long_languages_are_learned(spark):
    rows = [(i, "abc cab bac " * 8, "common") for i in range(400)] + [(900, "xyz zyx yxz " * 8, "rare"), (901, "mnop ponm " * 9000, "long")]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=60)
    assert net.languages == ["common", "long", "rare"]


def test_op10_likelihood_and_gradient():
    rng = np.random.default_rng(3)
    texts = ["bad word here. fine one.", "fine one. fine two", "bad bad worse! ok", "nothing"]
    ((_, (buckets, first_words, first_sentences)),) = toxicity.chunks(texts)
    text, toxic = np.repeat(np.arange(4), np.diff(first_sentences)), np.array([True, False, True, False])
    p = np.append(np.zeros(toxicity.BUCKETS), -1.0)
    p[np.unique(buckets)] = rng.normal(0, 1, len(np.unique(buckets)))
    loss, grad = toxicity.likelihood(p, buckets, first_words, text, toxic)
    clean = np.ones(4)
    for s in range(len(first_words) - 1):
        z = p[-1] + sum(p[b] for w in buckets[first_words[s] : first_words[s + 1]] for b in w)
        clean[text[s]] *= 1 - 1 / (1 + np.exp(-z))
    assert np.isclose(loss, -np.log(np.where(toxic, 1 - clean, clean)).mean())
    for at in [*np.unique(buckets)[:8], toxicity.BUCKETS]:
        ends = []
        for step in (1e-6, -1e-6):
            q = p.copy()
            q[at] += step
            ends.append(toxicity.likelihood(q, buckets, first_words, text, toxic)[0])
        assert np.isclose((ends[0] - ends[1]) / 2e-6, grad[at], atol=1e-6)


def test_op3_counts_are_the_same_in_blocks():
    rng = np.random.default_rng(6)
    model = hmm.HMM(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(9), 4).T)
    seen, lengths = hmm.sequences([rng.integers(0, 9, n) for n in (1, 7, 8, 9, 40, 41, 3)])
    whole = hmm.expected(model, seen, lengths, 1000)
    for block in (1, 3, 8, 41):
        assert all(np.allclose(x, y) for x, y in zip(whole, hmm.expected(model, seen, lengths, block)))


def test_op3_odd_tables(spark):
    docs = spark.createDataFrame([(10, "a b"), (10, "a b"), (None, None)], "doc_id long, text string")
    all_out = hmm.score(docs, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens) for r in all_out] == [(0, 0)] * 3 and all(r.score == r.base_score for r in all_out)
    assert hmm.score(docs.limit(0), F.lit(False)).count() == 0


def test_op4_short_items_do_no_harm(spark):
    long_item = text_of(12, 999)
    docs = spark.createDataFrame([(i, "yes " * 3000 + (long_item if i % 5 == 0 else text_of(40, i))) for i in range(40)] + [(90, None), (91, "")], "doc_id long, text string")
    items = spark.createDataFrame([(0, long_item), (1, "s"), (2, "yes"), (3, " \n"), (4, ""), (5, None), (6, "zzz")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.start, r.end) for r in decontam.contaminated(docs, items).collect()}
    assert {k for k in got if k[1] == 0} == {(i, 0) for i in range(0, 40, 5)} and {i for _, i in got} == {0, 1, 2}
    assert all(got[i, 1] == (0, 2, 3) and got[i, 2] == (0, 0, 3) for i in range(40))
    assert decontam.contaminated(docs.limit(0), items).count() == 0 and decontam.without_items(docs, items.limit(0)).count() == 42


@pytest.mark.parametrize(
    "html,want",
    [
        ("<html><head><title>t</title><body><p>First text, of some length.<p>Second text.", "First text, of some length.\n\nSecond text."),
        ("<body><div class='content no-sidebar'><p>One, two, three.</p><p>Four.</p></div>", "One, two, three.\n\nFour."),
        ("<body><div class='post share-enabled'><p>One, two, three.</p><p>Four.</p></div>", "One, two, three.\n\nFour."),
        ("<body><article><p>Lead.</p><p class='related-work'>Work of others.</p><div class='warning'><p>Mind the step.</p></div></article>", "Lead.\n\nWork of others.\n\nMind the step."),
        ("<body><article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><p><object data=x>Shown instead.</object></p></article>", "So x=1 holds.\n\nShown instead."),
        ("<body><div class='main-nav'><p>" + "The whole article, wrapped oddly. " * 9 + "</p></div><div class=sidebar><p>Small.</p></div>", ("The whole article, wrapped oddly. " * 9).strip()),
        ("<body><article><p>Text &amp; more.</p><div class='related'><a href=x>Other page</a></div></article><div class=comments><p>" + "I say, this is long. " * 50 + "</p></div>", "Text & more."),
    ],
)
def test_op5_pages(html, want):
    assert html_extract.main_text(html) == want


def test_op5_rows(spark):
    rows = [(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (2, None, None, "x"), (None, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_extract.extracted(pages).collect()), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_op7_examples_without_tokens_stay(spark):
    rows = [(i, 50 if i % 3 == 0 else 0, 0) for i in range(90)] + [(100 + i, -1, None) for i in range(5)]
    out = packing.pack_examples(spark.createDataFrame(rows, "id long, tokens long, loss_tokens long").coalesce(1), 100, 5, 60).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    sizes = {}
    for r in out:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + 1
    assert max(sizes.values()) <= 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_return_their_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    if name.startswith(("op1_", "op5_")):
        assert len(rows) == pages
    elif name.startswith("op4_"):
        assert rows and {r.doc_id for r in rows} <= set(docs) and all(r.distance <= r.budget for r in rows)
    elif name.startswith("op7_"):
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
        assert sorted(d for d, _ in by_doc) == sorted(docs)
        for (_, n), pieces in by_doc.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at == n
        for pieces in by_sequence.values():
            assert sum(p[2] for p in pieces) <= packing.LOSS and sum(p[1] for p in pieces) <= 2048
        # The limit on loss-bearing tokens binds somewhere.
        assert any(sum(x[2] for x in p) == packing.LOSS for p in by_sequence.values())
    elif name.startswith("op13_"):
        assert len({r.word for r in rows}) == len(rows) > 1000
    else:
        assert sorted(r.doc_id for r in rows) == sorted(docs)
