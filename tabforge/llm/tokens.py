"""Token ids of a byte-level BPE tokenizer file, with a cache of word pieces.

Byte-level BPE never merges across the pieces its split pattern makes, so the
ids of a text are the ids of its pieces in a row. Pieces are cut and hashed in
numpy for many texts at once; each distinct piece goes through the tokenizer
once per worker. The cache is emptied when it passes ``LIMIT`` pieces, so
memory is bounded and only time depends on it. Other kinds of tokenizer files,
and texts that hold the spelling of a special token, take the plain way.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from tabforge.llm.common import U64, mix, stream

LIMIT = 4 << 20
#: fixed values: code points with the property White_Space
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_READY: dict[str, Encoder] = {}
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    if not _KINDS:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                table[c] = LETTER
            elif k == "N":
                table[c] = NUMBER
        table[WHITE_SPACE] = SPACE
        _KINDS.append(table)
    return _KINDS[0]


def piece_starts(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted starts of the pieces that the byte-level split pattern makes of each text.

    A run of letters, numbers or other signs is a piece, with one blank before it.
    Of white space before such a run all but the last sign is a piece; the last
    is one of its own unless it is that blank. 's 't 're 've 'm 'll 'd are pieces
    where an apostrophe begins one.
    """
    n = len(cps)
    kind = kinds()[cps]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    edge = offs[:-1][offs[:-1] < n]
    first = np.zeros(n + 1, dtype=bool)
    first[edge] = True
    first[n] = True
    new |= first[:n]
    # the last white space before a run of the same text
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
    new[last] = True
    blank = last[cps[last] == 0x20]
    new[blank + 1] = False
    # contractions: a lone apostrophe that begins a piece
    quote = np.flatnonzero(new & (cps == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one = np.isin(cps[quote + 1], [ord(c) for c in "stmd"])
    more = np.flatnonzero(~one & (quote + 2 < n))
    q = quote[more]
    two = np.zeros(len(quote), dtype=bool)
    ab = cps[q + 1].astype(np.int64) << 21 | cps[q + 2]
    two[more] = ~first[q + 2] & np.isin(ab, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])
    for hit, size in ((quote[one], 2), (quote[two], 3)):
        new[hit + 1] = False
        rest = hit + size
        rest = rest[rest < n]
        new[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(new)


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                         and pre.get("use_regex", True) and not spec.get("normalizer"))
        self.places = np.zeros(0, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        got: list[int] = []
        size = np.empty(len(pieces), np.int64)
        for i in range(0, len(pieces), 4096):
            for j, e in enumerate(self.tokenizer.encode_batch_fast(pieces[i:i + 4096], add_special_tokens=False), i):
                ids = e.ids
                size[j] = len(ids)
                got += ids
        begin = len(self.ids) + np.cumsum(size) - size
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.begin, begin), (self.size, size)))
        self.ids = np.concatenate([self.ids, np.asarray(got, np.uint32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        odd = [i for i, t in enumerate(texts) if not self.by_piece or any(s in t for s in self.special)]
        own = {i: self.plain(texts[i]) for i in odd}
        if odd:
            texts = ["" if i in own else t for i, t in enumerate(texts)]
        whole = "".join(texts)
        if not whole:
            return [own.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]
        if len(self.keys) > LIMIT:
            self.forget()
        cps = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = piece_starts(cps, offs)
        size = np.diff(starts, append=len(cps))
        if size.max() > len(self.places):
            self.places = stream(1 << int(size.max()).bit_length(), 14) | U64(1)
        place = np.arange(len(cps), dtype=np.int64) - np.repeat(starts, size)
        h = mix(np.add.reduceat(cps * self.places[place], starts) + size.astype(np.uint64))
        back, keys = pd.factorize(h)
        some = np.empty(len(keys), np.int64)
        some[back[::-1]] = np.arange(len(h))[::-1]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            new = new[np.argsort(keys[new])]
            self.learn(keys[new], [whole[a:b] for a, b in zip(starts[some[new]].tolist(), (starts + size)[some[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        n_ids = self.size[at][back]
        ends = np.cumsum(n_ids)
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[at][back] - ends + n_ids, n_ids)]
        cuts = np.concatenate([[0], ends])[np.searchsorted(starts, offs)]
        return [own[i] if i in own else flat[cuts[i]:cuts[i + 1]] for i in range(len(texts))]


def encoder(path: str) -> Encoder:
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]
