"""Ids of a word-level byte-pair tokenizer, looked up by white-space-separated word.

The tokenizer drops white space and never joins what it separates, so a text's ids are the ids of its words in
order, and each distinct word is encoded once for each worker process. Words are cut and told apart in numpy and Arrow;
only the distinct ones of a batch become Python objects.
"""

from __future__ import annotations

import json
import os
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Words, split

#: Words in each of a worker's two generations of cached ids. When the younger is full it becomes the older, whose
#: words come back as they are met again, so memory has a bound and common words stay.
CACHE_WORDS = 300_000
#: New words that the tokenizer gets as one text, if they are letters throughout.
JOINED = 50
#: ASCII punctuation that the tokenizer cuts off from letters and digits before it, as one piece; and these.
_TAIL = np.array([32 < c < 127 and not chr(c).isalnum() and c != 39 for c in range(256)])
_SOLID = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


@dataclass
class Coded:
    """Ids of texts, one text after the other; `each` counts the ids of each word, `ends` those up to each text's end."""

    words: Words
    ids: np.ndarray
    each: np.ndarray
    ends: np.ndarray

    def texts(self) -> list[np.ndarray]:
        return np.split(self.ids, self.ends[:-1]) if len(self.ends) else []


class WordEncoder:
    """Ids as unsigned 16-bit numbers; the vocabulary has to fit."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has ids of more than 16 bits")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        #: Whether an id ends a run of letters, by which the ids of words that were encoded together are told apart.
        self.last = np.zeros(1 << 16, bool)
        if suffix:
            self.last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Words of letters are encoded together, in half the time; each of them ends with one id
        that ends a run of letters, and where that count is off, they are encoded one by one."""
        out: list[bytes] = [b""] * len(words)
        texts = [w.decode("utf-8", "replace") for w in words]
        solid = [i for i, t in enumerate(texts) if t.isalpha()] if self.last.any() else []
        groups = [solid[a : a + JOINED] for a in range(0, len(solid), JOINED)]
        alone = set(range(len(words))).difference(solid)
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint16)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                alone.update(group)
                continue
            raw, at = ids.tobytes(), 0
            for i, to in zip(group, (2 * ends).tolist(), strict=True):
                out[i] = raw[at:to]
                at = to
        rest = sorted(alone)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("H", e.ids).tobytes()
        return out

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, from the caches or by the tokenizer."""
        found = list(map(self.cache.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            older = self.older.get
            fresh = []
            for i in missing:
                found[i] = older(words[i])
                if found[i] is None:
                    fresh.append(i)
            for at in range(0, len(fresh), 20_000):
                part = fresh[at : at + 20_000]
                for i, x in zip(part, self._encode([words[i] for i in part]), strict=True):
                    found[i] = x
            self.cache.update(zip([words[i] for i in missing], [found[i] for i in missing], strict=True))
            if len(self.cache) > CACHE_WORDS:
                self.older, self.cache = self.cache, {}
        return found

    def code(self, text: pa.Array) -> Coded:
        """Of an array of strings. The tokenizer lower-cases; doing it for A-Z here lets words share an entry. Special
        tokens are found before that, so texts that may hold one are left as they are."""
        special = pc.fill_null(pc.match_substring(text, "<|"), False).to_numpy(zero_copy_only=False)
        words = split(text, lower=True, keep=special)
        first, start, end = words.first, words.start, words.end
        if not len(start):
            return Coded(words, np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(len(text), np.int64))
        # ASCII punctuation behind a letter or digit is a piece of its own, so words share their stems.
        stem = end.copy()
        more = np.flatnonzero(_TAIL[words.data[stem - 1]])
        while len(more):
            stem[more] -= 1
            more = more[(stem[more] > start[more])]
            more = more[_TAIL[words.data[stem[more] - 1]]]
        two = (stem < end) & (stem > start)
        two[two] = _SOLID[words.data[stem[two] - 1]]
        if special.any():
            two &= ~np.repeat(special, np.diff(first))
        pieces = np.cumsum(1 + two)
        begin, last = np.empty(int(pieces[-1]), np.int64), np.empty(int(pieces[-1]), np.int64)
        begin[pieces - 1], last[pieces - 1] = start, end
        begin[pieces[two] - 1] = last[pieces[two] - 2] = stem[two]
        begin[pieces[two] - 2] = start[two]
        # The bytes of the words without what is between them, as an Arrow array, whose dictionary has the distinct pieces.
        edge = np.zeros(len(words.data) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        dense = words.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(last - begin)]).astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(dense)])
        coded = column.dictionary_encode()
        found = self._known(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat = np.frombuffer(b"".join(found), np.uint16)
        at = coded.indices.to_numpy()
        size = length[at]
        total = np.cumsum(size)
        ids = flat[np.repeat((np.cumsum(length) - length)[at] - (total - size), size) + np.arange(int(total[-1]))]
        upto = np.concatenate([[0], total[pieces - 1]])
        return Coded(words, ids, np.diff(upto), upto[first[1:]])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.code(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())).texts()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
