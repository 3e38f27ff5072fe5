"""The ten operators against brute force and on odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from geoframe.llm import dac, decontam, hmm, html_extract, langid, packing, simhash, sketch, toxicity, url_filter
from geoframe.llm.text import held_out
from geoframe.llm.tokens import Ids

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " \n\t ", "a", "Ünï cödé, it's 'fine'.", "x" * 3000, "a  b   c\n\n d", "の日本語 テスト", "same text here again", "same text here again", "\u00a0  nbsp \u3000x", "12 345, 6.7!"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{min(rnd.randrange(vocabulary), rnd.randrange(vocabulary))}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + [words(10 + 13 * (i % 40), i) for i in range(120)]
    rows = [(i, t, None if i % 11 == 0 else ("xx" if i % 2 else "yy"), "s", 0) for i, t in enumerate(texts)]
    rows += [(None, "no id", "xx", "s", 0), (140, texts[30], "xx", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "score": F.lit(2.0), "held_out": F.lit(True), "h": F.lit("x")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_remembered_pieces_give_the_tokenizers_ids(path):
    rnd = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab 'é,.\n\t  12$…́s\u00a0\x85") for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, bounds = Ids.of(path).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    assert [ids[a:b].tolist() + [1] for a, b in zip(bounds[:-1], bounds[1:])] == ids_of(path, texts)


def test_op2_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    dac.write_token_files(docs, path, WORD)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (name, _), ids in zip(rows, ids_of(WORD, [t for _, t in rows])):
        want.append((name, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted((tuple(r) for r in dac.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    flat = [i for ids in ids_of(WORD, [t for _, t in rows]) for i in ids]
    asked = spark.createDataFrame([(p,) for p in (0, 5, 77, len(flat) - 1, len(flat))], "position long")
    assert {r.position: r.token_id for r in dac.token_at(spark, path, asked).collect()} == {p: flat[p] if p < len(flat) else None for p in (0, 5, 77, len(flat) - 1, len(flat))}


@pytest.mark.parametrize("bits", [3, 8, 16])
def test_any_code_is_read_without_its_neighbours(bits):
    rnd = np.random.default_rng(bits)
    ids = np.concatenate([rnd.integers(0, 1 << k, 700) for k in (1, 7, 9, 16, 31)]).astype(np.uint32)
    block = dac.Block(dac.pack(ids, [4, None], np.array([0, 3, len(ids)]), bits))
    assert (block.all() == ids).all()
    assert [block[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_op1_longest_rule_and_shrinkage(spark):
    urls = ["http://a.example.org/es/1", "http://org/x", "ftp://EXAMPLE.org/en/12?q", "https://b.com/de/9", "http://b.com", "no scheme", None, "x://y.net/p#f", "http://notexample.org.net/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://bad.net/{i}") for i in range(40)] + [(200 + i, f"http://good.net/{i}") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, int(i % 10 == 0)) for i in range(40)] + [(200 + i, 1) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.page_id: r for r in url_filter.judged(pages, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [("a.example.org", "/es/1", "example.org/es/"), ("org", "/x", "org/"), ("example.org", "/en/12", "example.org/en/1"), ("b.com", "/de/9", "com/de/"), ("b.com", "", None), ("", "", None), ("", "", None), ("y.net", "/p", None), ("notexample.org.net", "/es/", None)]
    assert [got[i].verdict for i in (0, 1, 2, 3, 100, 139, 200)] == ["block", "allow", "block", "block", "block", "block", "allow"]
    assert url_filter.judged(pages.limit(0), labels).count() == 0
    assert url_filter.judged(pages, labels.limit(0)).count() == pages.count()


def test_op3_base_scores_and_normalisation(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = hmm.score(docs, held_out("doc_id", 10, 0)).collect()
    count, n = Counter(), 0
    for r in rows:
        w = (r.text or "").encode().lower().split() + [None]
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10:
            count.update(w)
            n += len(w)
    divisor = n + 0.1 * (len(count) + 1)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.1) / divisor) for x in w), 6)) for r in rows for w in [(r.text or "").encode().lower().split() + [None]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}


def test_hmm_forward_and_counts_match_brute_force():
    rng = np.random.default_rng(5)
    model = hmm.HMM(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    parts = [rng.integers(0, 5, n) for n in (1, 4, 6)]
    seen, lengths = hmm.sequences(parts)

    def paths(s):
        total = 0.0
        for p in np.ndindex(*[3] * len(s)):
            v = model.start[p[0]] * model.emit[s[0], p[0]]
            for a, b, x in zip(p, p[1:], s[1:]):
                v *= model.move[a, b] * model.emit[x, b]
            total += v
        return math.log(total)

    assert np.allclose(hmm.forward(model, seen, lengths), [paths(s) for s in sorted(parts, key=len, reverse=True)])
    before = hmm.forward(model, seen, lengths).sum()
    start, move, emit, total = hmm.expected(model, seen, lengths)
    assert np.isclose(total, before) and np.isclose(emit.sum(), 11) and np.isclose(move.sum(), 8)
    better = hmm.HMM(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    assert hmm.forward(better, seen, lengths).sum() >= before


def edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        left, row[0] = row[0], 0
        for i in range(1, len(pattern) + 1):
            left, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, left + (pattern[i - 1] != c))
        best = min(best, row[-1])
    return best


def test_op4_finds_what_is_within_budget_and_nothing_else(spark):
    rnd = random.Random(8)
    items = [words(25, 900 + i, 5000) for i in range(6)] + [None, ""]
    texts = []
    for n in range(40):
        passage = list(items[n % 6])
        for _ in range(rnd.randrange(0, 24)):
            at = rnd.randrange(len(passage))
            rnd.choice([lambda: passage.__setitem__(at, "q"), lambda: passage.pop(at), lambda: passage.insert(at, "é")])()
        texts.append(words(30, n) + " " + "".join(passage).upper() + "\n" + words(9, n))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(90, None), (91, ""), (92, words(300, 7))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    plain = lambda t: t.encode().lower().replace(b"\n", b" ")
    want = {}
    for n, t in enumerate(texts):
        for i, item in enumerate(items[:6]):
            d = edits(plain(item), plain(t))
            if d <= int(0.1 * len(plain(item))):
                want[n, i] = d
    assert {k: r.distance for k, r in got.items()} == want and 5 < len(want) < 40
    for (n, i), r in got.items():
        assert edits(plain(items[i]), plain(texts[n][r.start : r.end])) == r.distance
    kept = {r.doc_id for r in decontam.without_items(docs, bench).collect()}
    assert kept == {n for n in [*range(40), 90, 91, 92]} - {n for n, _ in want}
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_op5_keeps_the_article_alone():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a></li></ul></nav><!-- <p>no --><div class="ad">Buy, now, cheap, things.</div>
    <div id="cookie-notice"><p>We use cookies, many, many cookies.</p></div><article><h1>Head &amp; line</h1><p><b>First, the&nbsp;start<br>goes on.
    <p>Second 1 &lt; 2, a paragraph with <a href="#">one link</a> in it.</p><ul><li>One<li>Two</ul></article>
    <aside>Aside, text.</aside><section class="comments"><p>Reader, says, a lot, of things, here, and, more, and more.</p></section><form><p>Form</p></form><footer>&copy; foot</footer>"""
    assert html_extract.main_text(page) == "Head & line\n\nFirst, the start goes on.\n\nSecond 1 < 2, a paragraph with one link in it.\n\nOne\n\nTwo"
    for odd in (None, "", "<", "<p", "</div></p>", "<nav>x</nav>", "<script>x", "<!--"):
        assert html_extract.main_text(odd) in ("", "<", "<p")
    assert html_extract.main_text("plain words") == "plain words"
    assert len(html_extract.main_text("<p>" + "long text, " * 50_000)) == 11 * 50_000 - 1


def test_op6_matches_all_pairs(spark, docs, empty, monkeypatch):
    base = words(150, 1, 3000).split()
    near = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in range(0, 150, 3)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    rows = both.collect()
    prints = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{prints[i]:016x}", least.get(root(i))) for i, r in enumerate(rows))
    assert Counter(map(tuple, simhash.classes(both).collect())) == want
    monkeypatch.setattr(simhash, "NODES", 16)
    monkeypatch.setattr(simhash, "SHARD_MOST", 60)  # shards are split again and again
    assert Counter(map(tuple, simhash.classes(both).collect())) == want
    assert simhash.classes(empty).count() == 0 and simhash.one_of_each(empty).columns == empty.columns


@pytest.mark.parametrize("segments,loss", [(512, 64), (3, 60)])
def test_op7_pieces_cover_all_ids_within_limits(docs, segments, loss):
    rows = docs.select("doc_id", "text").collect()
    pieces = packing.pack_documents(docs, BYTE, length=64, segments=segments, loss=loss, shortest=1).collect()
    whole = Counter((r.doc_id, tuple(ids)) for r, ids in zip(rows, ids_of(BYTE, [r.text for r in rows])))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in whole.items())
    for (name, ids), n in whole.items():
        own = [p for p in by_doc[name, len(ids)] if p.ids_crc32 == crc(ids[p.start : p.start + p.length])]
        assert sum(p.length for p in own) >= len(ids)
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        assert sum(p.length for p in ps) <= 64 and len(ps) <= segments and sum(p.loss_tokens for p in ps) <= loss
    if loss == 64:
        assert sum(sum(p.length for p in ps) < 64 for ps in by_sequence.values()) <= docs.rdd.getNumPartitions()


def test_whole_examples_stay_whole(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(1, 100), rnd.randint(0, 40)) for i in range(300)] + [(300, None, None)]
    out = packing.pack_examples(spark.createDataFrame(rows, "id long, tokens long, loss_tokens long").coalesce(1), 100, 5, 60).collect()
    assert sorted(r.id for r in out) == list(range(301))
    sums = {}
    for r in out:
        t = sums.setdefault(r.sequence_id, [0, 0, 0])
        t[0], t[1], t[2] = t[0] + r.tokens, t[1] + 1, t[2] + r.loss_tokens
    assert all(a <= 100 and b <= 5 and c <= 60 for a, b, c in sums.values())


def test_op8_edits_and_likeness(spark, docs, empty):
    got = sketch.compared_with_next(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(t for t in ODD if t)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in plain.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in sketch.compared_with_next(plain.repartition(3)).collect()}
    for k, (name, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(k + 1) % len(rows)][1][:half]
        assert got[name].n_chars == len(text) and got[name].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    same = [got[n].fingerprint for n, t in rows if t == "same text here again"]
    assert same[0] == same[1]
    assert sketch.compared_with_next(empty).count() == 0
    alone = sketch.compared_with_next(plain.limit(1)).collect()
    assert alone[0].near_next == 1.0


def test_op8_scaled_sketches_merge_and_measure_containment(spark):
    a, b = words(4000, 1, 100_000), words(400, 2, 100_000)
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    for c in ("a", "b", "ab"):
        df = sketch.with_sketch(df, c, f"s_{c}")
    r = df.select(sketch.containment(F.col("s_b"), F.col("s_ab")).alias("whole"), sketch.containment(F.col("s_b"), F.col("s_a")).alias("none"), sketch.likeness(sketch.merged(F.col("s_a"), F.col("s_b")), F.col("s_ab")).alias("merged")).first()
    assert r.whole == 1 and r.none < 0.05 and r.merged > 0.95


def test_op9_learns_bytes_and_rejects_texts_without_letters(spark, empty):
    rnd = random.Random(4)
    make = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(40))
    rows = [(i, make("abcde") if i % 2 else make("vwxyé"), "ab" if i % 2 else "vé") for i in range(300)]
    train = spark.createDataFrame(rows + [(900, None, "ab"), (901, "abc", None)], "doc_id long, text string, lang string")
    net = langid.fit(train)
    new = spark.createDataFrame([(0, make("abcde")), (1, make("vwxyé")), (2, None), (3, ""), (4, "123 !?"), (5, "b" * 5000), (6, "é")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(new, net).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["ab", "vé", "und", "und", "und", "ab"] and got[6].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in langid.with_language(new, net).collect()} >= {0, 1, 5} and langid.with_language(new, net).where("doc_id in (2, 3, 4)").count() == 0
    assert langid.fit(empty) is None and langid.predict(new, None).where("lang_pred = 'und'").count() == 7


def test_op10_learns_from_documents_and_locates_sentences(spark, empty):
    rnd = random.Random(6)
    sentence = lambda: " ".join(f"w{rnd.randrange(200)}x" for _ in range(8)) + "."
    rows, labels = [], []
    for i in range(600):
        parts = [sentence() for _ in range(rnd.randint(1, 12))]
        if i % 4 == 0:
            parts[rnd.randrange(len(parts))] = "You blorfed grunk it is."
        rows.append((i, " ".join(parts)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(700, None), (701, ""), (702, "...")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1), (3, None), (5000, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].score >= 0.3) == (i % 4 == 0) for i in range(600)) and all(got[i].score == 0 for i in (700, 701, 702))
    texts = dict(rows)
    assert all("grunk" in texts[i][got[i].worst_start : got[i].worst_end] for i in range(0, 600, 4))
    assert {r.doc_id for r in toxicity.without_toxic(docs, model).collect()} == {i for i in range(600) if i % 4} | {700, 701, 702}
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.score(empty, model).count() == 0


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(160):
        text = ". ".join(" ".join(f"{'abcd'[i % 4]}w{rnd.randrange(300)}" for _ in range(12)) for _ in range(6))
        if i % 8 == 0:
            text += ". you grunk blorf."
        rows.append([i, text, f"l{i % 4}", "s", len(text)])
        labels.append((i, 1, int(i % 8 == 0)))
    rows[21][1] = rows[9][1]
    item = words(30, 77, 9000)
    rows[35][1] += "\n" + item
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert got == {i for i in range(160) if i % 8} - {21, 35}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_batches_of_any_type(spark):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["A b", None, "c"], pa.large_string())})
    from geoframe.llm.text import text_batches, words_of

    ((_, data, offsets),) = text_batches(iter([batch.slice(1)]))
    starts, ends, firsts = words_of(data, offsets)
    assert data.tobytes() == b"c" and firsts.tolist() == [0, 0, 1] and ends.tolist() == [1]
