"""Mixing, the Merkle manifest and spelling variants against brute force and on odd inputs; HTML against plain sums."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geoframe.llm import decontam, html_extract, merkle, mixing, packing, simhash, toxicity, variants
from geoframe.llm import queries as q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \n\t ", "a", "Ünï cödé ÉCOLE, it's fine", "straße Straße strasse", "x" * 3000, "a  b\x0bc\n\n d", "の日本語", "  nbsp 　x"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("thin", "edé", "ouba") for b in ("king", "r", "lé") for c in ("s", "ed", "Tion")]
    texts = ODD + [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 20, 200]))) + "\n" * (i % 3) for i in range(90)]
    found = [(i, t, "xx" if i % 3 else None, None if i % 13 == 0 else "hot" if i % 2 else f"s{i % 7}", None if i % 5 == 0 else i) for i, t in enumerate(texts)]
    found += [(None, "no id", "xx", "hot", 1), (20, texts[20], "xx", "s6", 20), (20, texts[20], "xx", "s6", 20), (7, "lone", None, "zz", 0), (21, "", "a", "empty", 0)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {"size": F.lit(1), "target": F.lit(2.0), "tree": F.lit("x"), "leaf": F.lit("y"), "word": F.lit("z"), "n": F.lit(3), "place": F.lit(0), "root": F.lit("r")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_mixing", "op12_merkle_manifest", "op13_spelling_variants"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    want = [plain(r) for r in con.sql(q.ORACLE_SQL[name]).select(*columns).fetchall()]
    assert sorted(map(plain, df.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_mix(docs, rows, empty):
    got = mixing.taken(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((r[0], size(r[1])) for r in rows), key=str)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > 3 * sizes[s]}
        if not full:
            target |= {s: share * weights[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in full}
        open_, left = open_ - full, left - sum(3 * sizes[s] for s in full)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= len(names) for s in names) and sum(taken.values()) == sum(sizes.values())
    # In the mix each document is whole before the next of its source, and all that is taken follows each other.
    queue, budget = mixing.queued(docs)
    mix = sorted(mixing.mixed(queue, budget).collect(), key=lambda r: r.first_at)
    assert [r.first_at for r in mix] == [sum(x.words for x in mix[:i]) for i in range(len(mix))]
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs.repartition(7)).collect()))
    assert mixing.taken(empty).count() == 0


def test_mix_stops_at_a_smaller_budget(docs):
    got = mixing.taken(docs, (3, 1), 2, 500).collect()
    assert sum(r.taken for r in got) == 500 and all(r.taken <= 2 * r.size for r in got)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_manifest(docs, rows, empty):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4])), field(text))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), r))

    def fold(nodes):
        """Digest at the top of nodes (digest, members), and the proof (left, right) levels of each member."""
        proofs = {m: [] for _, members in nodes for m in members}
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes), 3):
                run = nodes[i : i + 3]
                for k, (_, members) in enumerate(run):
                    for m in members:
                        proofs[m].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
                up.append((H(*(d for d, _ in run)), [m for _, ms in run for m in ms]))
            nodes = up
        return nodes[0][0], proofs

    tops, want = [], []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(by[source], key=lambda x: x[:2])
        top, proofs = fold([(d, [(source, i)]) for i, (_, d, _) in enumerate(leaves)])
        tops.append((top, leaves, proofs, source))
    root, over = fold([(t[0], [n]) for n, t in enumerate(tops)])
    for n, (top, leaves, proofs, source) in enumerate(tops):
        for i, (_, d, r) in enumerate(leaves):
            path = proofs[source, i] + over[n]
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[1].replace("\n", "") if r[1] is not None and cut else r[1])
            for left, right in path:
                now = H(left, now, right)
            want.append((r[0], d, top, root, H("".join(a + b for a, b in path)), now, now == root))
    got = [tuple(r) for r in merkle.verified(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and 0 < sum(w[-1] for w in want) < len(want)
    assert merkle.verified(empty).count() == 0


def test_one_row_and_one_source(spark, rows):
    one = merkle.verified(spark.createDataFrame(rows[20:21], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H("")
    same = merkle.verified(spark.createDataFrame([(i, "x", None, "s", 1) for i in range(28)], SCHEMA)).collect()
    assert len({r.root for r in same}) == 1 and all(r.subroot == r.root and r.verified for r in same)


def near(a, b):
    """Exactly one edit apart, by trying all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants(spark, docs, rows, empty):
    more = [(1000 + i, " ".join(["banana", "bananas", "bannana", "Banana", "ananas"][: 1 + i % 5] * (1 + i % 3)), None, None, 0) for i in range(60)]
    counts = Counter()
    for i, t, *_ in rows + more:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    want = {}
    for w, n in words.items():
        beside = [v for v in words if near(w, v)]
        best = min(beside, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 2 * n else None
        want[w] = form, n, len(beside), form and words[form]
    got = {r.word: r for r in variants.grouped(docs.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))).collect()}
    assert {w: (r.form, r.n, r.n_near, r.form_n) for w, r in got.items()} == want and any(f for f, *_ in want.values())
    for w, r in got.items():
        while want[w][0]:
            w = want[w][0]
        assert r.root == w
    assert variants.grouped(empty).count() == 0


def test_every_single_edit_is_found(spark):
    rnd = random.Random(9)
    words = set()
    for n in range(5, 13):
        w = "".join(rnd.choice("abé") for _ in range(n))
        words |= {w} | {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + c + w[i:] for i in range(n + 1) for c in "aé"} | {w[:i] + "z" + w[i + 1 :] for i in range(n)}
    words = sorted(w for w in words if len(w) >= 5)
    pairs = variants.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    got = [tuple(sorted((r.a, r.b))) for r in pairs]
    assert sorted(got) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)) and len(set(got)) == len(got)


def plain_main_text(html):
    """What html_extract.main_text() says it does, with sums taken anew for each element."""
    elements, found = html_extract.blocks_of(html or "")
    inside = {e: [b for b in found if e in b[0].lineage()] for e in elements}
    total = sum(len(t) for b, t, _ in found if not any(e.words & html_extract.NEVER for e in b.lineage()))

    def goes(e):
        n, linked = sum(len(b[1]) for b in inside[e]), sum(b[2] for b in inside[e])
        if not e.words:
            return False
        if e.words & html_extract.NEVER or 2 * linked >= n:
            return True
        return 2 * n < total and bool(e.words & html_extract.SELDOM or not (e.parent and e.parent.main))

    found = [b for b in found if not any(goes(e) for e in b[0].lineage())]
    if not found:
        return ""
    inside = {e: [b for b in found if e in b[0].lineage()] for e in elements}
    points = {id(b): (1 + b[1].count(",") + len(b[1]) / 100) * (0.2 if b[0].name in html_extract.HEADINGS else 1) for b in found}
    chars = {e: sum(len(b[1]) for b in inside[e]) for e in elements}
    links = {e: sum(b[2] for b in inside[e]) for e in elements}
    first = {e: found.index(inside[e][0]) if inside[e] else -1 for e in elements}
    holders = [e for e in reversed(elements) if any(e in b[0].around().lineage() for b in found)]
    density = {e: 1 - links[e] / max(chars[e], 1) for e in elements}
    got = {e: sum(points[id(b)] / 2 ** b[0].around().lineage().index(e) for b in found if e in b[0].around().lineage()) for e in elements}
    own = {e: sum(points[id(b)] for b in found if b[0].around() is e) for e in elements}
    score = {e: (got[e] + (5 if e.name in ("article", "main") else 0)) * density[e] for e in elements}
    has_text = lambda e: own[e] * density[e] >= html_extract.LEAST
    best = max(holders, key=lambda e: (round(score[e], 9), -first[e]))
    while best.name in html_extract.PARAGRAPHS and best.parent is not None:
        best = best.parent
    line = best.lineage()
    top = max((n for n, e in enumerate(line) if e.main), default=0)
    for e in holders:
        if has_text(e) and (e.main or not best.main):
            top = max(top, next(n for n, x in enumerate(line) if x in e.lineage()))
    main, out = line[top], []
    for b in found:
        at = next((e for e in b[0].lineage() if e is best or e is main or e.parent is main.parent), None)
        around = b[0].around()
        if at is best:
            wanted = True
        elif at is main:
            wanted = links[around] < 0.5 * chars[around] or bool(around.parent and has_text(around.parent))
        else:
            few = at is not None and links[at] < 0.25 * chars[at]
            wanted = at is not None and ((few and not main.main) or (at in holders and score[at] >= 3) or (at.name == "p" and few and chars[at] > 80) or (at.name in html_extract.HEADINGS and few and first[at] < first[main]))
        if wanted:
            out.append(b[1])
    return "\n\n".join(out)


def test_tree_sums_equal_plain_sums_on_all_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    assert [html_extract.main_text(h) for h in pages] == [plain_main_text(h) for h in pages] and len(pages) > 50


BODY = "<p>" + "A long paragraph, with commas, and more text to be read by people. " * 5 + "</p>"


def test_wrappers_and_slashes_lose_no_article():
    text = " ".join(("A long paragraph, with commas, and more text to be read by people. " * 5).split())
    assert html_extract.main_text(f"<article><svg viewBox='0 0 1 1'/>{BODY}</article>") == text
    assert html_extract.main_text(f"<body><form><div class='nav'><a href=x>Menu</a></div><div id=main>{BODY}</div><button>Go</button></form></body>") == text
    assert html_extract.main_text(f"<body><div class='post ad'>{BODY}</div></body>") == text
    assert html_extract.main_text(f"<body><div>{BODY}</div><div class='ad'>Buy it now, it is cheap.</div><form>Sign up here <input></form><div class='post comment'>{BODY}{BODY}</div></body>") == text


@pytest.mark.parametrize("html", ["<div>" * 100_000 + BODY, "<b>" * 100_000 + BODY * 50, "<div><p>some words<i>" * 30_000, "<ul><li>x<a>" * 30_000, "<blockquote>" * 50_000 + "<li>x" * 30_000])
def test_deep_pages_take_seconds(html):
    began = time.perf_counter()
    html_extract.main_text(html)
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3, 0.4])
def test_items_within_their_budget_are_found_at_any_rate(rate):
    import numpy as np

    rnd = random.Random(int(rate * 10))
    for _ in range(60):
        items = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 14))) for _ in range(5)]
        texts = []
        for _ in range(5):
            base = list(rnd.choice(items))
            for _ in range(rnd.randint(0, 3)):
                base[rnd.randrange(len(base)) : rnd.randrange(len(base)) + 1] = rnd.choice(["", "a", "bc"])
                base = base or ["a"]
            texts.append("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 6))) + "".join(base) + "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 6))))
        pieces = decontam.cut_items(items, list(range(5)), rate)
        raw = [t.encode() for t in texts]
        got = {(t, i): d for t, i, d, *_ in decontam.matches(pieces, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))}
        for t, text in enumerate(texts):
            for i, item in enumerate(items):
                last = [0] * (len(text) + 1)
                for n, c in enumerate(item, 1):
                    row = [n]
                    for m, d in enumerate(text, 1):
                        row.append(min(last[m] + 1, row[-1] + 1, last[m - 1] + (c != d)))
                    last = row
                assert ((t, i) in got) == (bool(item.strip()) and min(last) <= int(rate * len(item)))


def test_short_documents_fill_sequences(spark):
    import public_tokenizers

    rnd = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["one", "two", "three", "four"]) for _ in range(rnd.randint(1, 35))), None, None, 0) for i in range(4000)], SCHEMA).coalesce(1)
    by = Counter()
    for r in packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 2048 and sum(by.values()) >= 0.97 * 2048 * len(by)


def test_any_column_names_pass_near_duplicates(spark):
    names = {n: F.lit(1) for n in ("__id", "__T", "t", "__stays", "__text", "__row_id", "__ROW_TEXT", "count", "fp", "first")}
    rows = [(i, "the same words in a row that make a text long enough to compare " * (1 + i % 2), None, "s", 0) for i in range(4)] + [(9, "other", None, "s", 0)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA).withColumns(names))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9] or sorted(r.doc_id for r in kept.collect()) == [0, 1, 9]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]


def test_rows_that_repeat_an_id_are_one_training_text(spark):
    docs = spark.createDataFrame([(1, f"awful nasty words {i}", None, None, 0) for i in range(50)] + [(2, "all is well here", None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    real, toxicity.train = toxicity.train, lambda texts, y: seen.extend(texts)
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = real
    assert len(seen) == 2


def test_empty_tables_are_encoded_and_packed(spark, empty, tmp_path):
    import public_tokenizers

    from geoframe.llm import dac

    dac.write_token_files(empty, str(tmp_path / "ids"), public_tokenizers.path("word_bpe_49k.json"))
    assert dac.read_documents(spark, str(tmp_path / "ids")).count() == 0
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
