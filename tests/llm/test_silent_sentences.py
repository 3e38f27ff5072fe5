"""Sentences without a telling word add nothing to a document's score."""

import random

from geoframe.llm import toxicity


def test_long_clean_texts_stay(spark):
    rnd = random.Random(6)
    sentence = lambda: " ".join(f"w{rnd.randrange(200)}x" for _ in range(8)) + "."
    rows = [(i, " ".join([sentence() for _ in range(rnd.randint(1, 12))] + ["You blorfed grunk it is."] * (i % 4 == 0))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    lines = [f"w{i % 200}x w{i % 7}x" for i in range(100_000)]
    long = [(1000, "\n".join(lines)), (1001, "\n".join([*lines, "you blorfed grunk it is."]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    both = spark.createDataFrame(rows + long, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(both, model).collect()}
    assert got[1000].score == 0 and got[1001].score >= 0.3
    assert "grunk" in long[1][1][got[1001].worst_start : got[1001].worst_end]
    assert {r.doc_id for r in toxicity.without_toxic(both, model).collect()} == {i for i in range(400) if i % 4} | {1000}
