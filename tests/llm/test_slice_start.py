"""An item at the very start of a slice, without its first bytes."""

import random

import numpy as np

from geoframe.llm import decontam


def test_item_that_lacks_its_first_bytes_is_found_anywhere():
    rnd = random.Random(3)
    item = " ".join(f"w{rnd.randrange(5000)}" for _ in range(25))
    pieces = decontam.cut_items([item], [0], 0.1)
    for before in ([], ["another text"]):
        for lacking in range(1, pieces.budgets[0] + 1):
            raw = [t.encode() for t in [*before, item[lacking:] + " and more"]]
            data = np.frombuffer(b"".join(raw), np.uint8)
            got = decontam.matches(pieces, data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
            assert [(t, i) for t, i, *_ in got] == [(len(before), 0)] and got[0][2] <= lacking
