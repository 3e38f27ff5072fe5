"""Ids of the public tokenizers, with a memory of the pieces seen before.

Both tokenizers treat what stands between runs of white space on its own, and runs of letters apart from
the punctuation beside them. So texts are cut there, each distinct piece goes through the tokenizers
library once per worker (as long as it is remembered), and the ids are those of the whole texts.
"""

from __future__ import annotations

import re

import numpy as np

from geoframe.llm.text import BASES, REMEMBERED, SPACES, SpanHash, words_of

#: Digits, ASCII and Latin-1 letters; ASCII punctuation but for the apostrophe, which may join letters on either side.
LETTERS = "A-Za-z0-9À-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"
CORE_AND_MARKS = re.compile(rf"( ?[{LETTERS}]+)([{MARKS}]+)").fullmatch
CORE = re.compile(rf" ?[{LETTERS}]+").fullmatch
#: Cores (some 200 bytes each) and pieces (some 40 bytes each) remembered per worker.
MOST_CORES, MOST_PIECES = 800_000, 2_000_000

_of_worker: dict[str, Ids] = {}
REMEMBERED.append(_of_worker.clear)


class Ids:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        #: It lowers letters and drops white space, so the texts given to encode() may have A-Z lowered.
        self.lowers = self.tokenizer.normalizer is not None
        self.cores: dict[str, bytes] = {}
        self.forget()

    @classmethod
    def of(cls, path: str) -> Ids:
        """The one of this worker process."""
        if path not in _of_worker:
            _of_worker[path] = cls(path)
        return _of_worker[path]

    def forget(self) -> None:
        self.keys, self.checks, self.codes = (np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64))
        self.at = np.zeros((1 << 12) + 1, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """Pieces: words, with the white space before them where the tokenizer keeps it."""
        if self.lowers:
            return words_of(data, offsets)
        space = SPACES[data]
        cut = np.zeros(len(data) + 1, bool)
        # Never after a character that may be white space beyond ASCII: with what follows, it forms one run.
        wide = np.zeros(len(data), bool)
        wide[2:] = data[:-2] == 0xC2
        wide[3:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3)
        cut[1:-1] = space[1:] & ~space[:-1] & ~wide[1:]
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        return bounds[:-1], bounds[1:], np.searchsorted(bounds[:-1], offsets)

    def encoded(self, pieces: list[str]) -> list[bytes]:
        parts = [m.groups() if (m := CORE_AND_MARKS(p)) else (p,) for p in pieces]
        needed = {c for cs in parts for c in cs}
        new = [c for c in needed if c not in self.cores]
        if len(self.cores) + len(new) > MOST_CORES:
            self.cores.clear()
            new = list(needed)
        # Cores of letters alone go through as one text, which is faster; token offsets tell them apart again.
        plain = [c for c in new if (self.lowers or c[0:1] == " ") and CORE(c)]
        if plain:
            glue = " " if self.lowers else ""
            found = self.tokenizer.encode(glue.join(plain), add_special_tokens=False)
            starts = np.cumsum([0] + [len(c) + len(glue) for c in plain])
            self.keep(plain, found.ids, np.searchsorted(starts, [o[0] for o in found.offsets], "right") - 1)
        rest = [c for c in new if c not in self.cores]
        if rest:
            found = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            self.keep(rest, found.ids, found.word_ids)
        return [self.cores[cs[0]] if len(cs) == 1 else b"".join([self.cores[c] for c in cs]) for cs in parts]

    def keep(self, cores: list[str], ids: list[int], of) -> None:
        """Remember the ids of each core; of: the place in cores that each id belongs to, ascending."""
        raw = np.array(ids, np.uint32).tobytes()
        ends = (4 * np.searchsorted(np.asarray(of, np.int64), np.arange(len(cores) + 1))).tolist()
        self.cores.update((c, raw[a:b]) for c, a, b in zip(cores, ends[:-1], ends[1:]))

    def learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        """Remember pieces under their (ascending) keys."""
        found = self.encoded(pieces)
        n, m = len(self.keys), len(self.keys) + len(keys)
        ends = self.at[n] + np.cumsum([len(x) // 4 for x in found])
        for name, most in (("at", m + 1), ("ids", int(ends[-1]))):
            if len(old := getattr(self, name)) < most:
                setattr(self, name, np.concatenate([old, np.zeros(most, old.dtype)]))
        self.at[n + 1 : m + 1], self.ids[self.at[n] : ends[-1]] = ends, np.frombuffer(b"".join(found), np.uint32)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.checks, self.codes = np.insert(self.keys, place, keys), np.insert(self.checks, place, checks), np.insert(self.codes, place, np.arange(n, m))

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, keys)
        return place, self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in data, and where each text's ids begin (one entry more than texts)."""
        starts, ends, firsts = self.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, first, which = np.unique(SpanHash(data)(starts, ends), return_index=True, return_inverse=True)
        checks = SpanHash(data, BASES[1])(starts, ends)
        if (checks != checks[first][which]).any():  # two pieces with one hash: each text by itself
            return self.plainly(data, offsets)
        checks = checks[first]
        place, have = self.known(keys)
        if len(self.keys) + len(keys) - have.sum() > MOST_PIECES:
            self.forget()
            have[:] = False
        if not have.all():
            at = first[~have]
            raw = data.tobytes()
            self.learn(keys[~have], checks[~have], [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            place, _ = self.known(keys)
        if (self.checks[place] != checks).any():
            self.forget()
            return self.plainly(data, offsets)
        codes = self.codes[place]
        begin = self.at[codes]
        many = (self.at[codes + 1] - begin)[which]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = self.ids[np.repeat(begin[which] - upto[:-1], many) + np.arange(upto[-1])]
        return ids, upto[firsts]

    def plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], add_special_tokens=False)
        return np.concatenate([np.array(x.ids, np.uint32) for x in found]), np.concatenate([[0], np.cumsum([len(x.ids) for x in found])])


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    at = bounds[1:] + np.arange(1, len(bounds)) - 1
    out = np.empty(len(ids) + len(at), np.uint32)
    own = np.ones(len(out), bool)
    own[at] = False
    out[own], out[at] = ids, end_id
    return out, bounds + np.arange(len(bounds))
