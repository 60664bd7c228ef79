"""Token ids by the tokenizers library, a word at a time.

Every tokenizer read here cuts at white space before it merges, so the ids of a text are those of
its words in order. A batch's words are made distinct first and words already seen come
from a cache of bounded size in the worker; only new words go through the library. A
worker reads the vocabulary file once.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 1
CACHE_WORDS = 400_000
#: Letters and marks whose lower case and composed form are those of any Unicode library: fixed alphabets, nothing that combines.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+|[!-&(-/:-@\[-`{-~]+")
_LOADED: dict[str, Words] = {}


class Words:
    """Ids of distinct words, as bytes of unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for pieces that are lower-cased, composed and cut already
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.clear()

    def clear(self) -> None:
        self.word: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Adds the words not seen yet: their plain pieces, if new, go to the library many at a time, other words whole."""
        known, cut, whole = self.piece, {}, []
        for w in words:
            low = w.lower()
            p = _PLAIN.findall(low)
            if sum(map(len, p)) == len(low) and "<|" not in low:
                cut[w] = p
            else:
                whole.append(w)
        fresh = list({p for ps in cut.values() for p in ps if p not in known})
        for at in range(0, len(fresh), 8192):
            part = fresh[at : at + 8192]
            e = self.bare.encode(part, is_pretokenized=True, add_special_tokens=False)
            edges = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)) * 4
            ids, edges = np.array(e.ids, np.uint32).tobytes(), edges.tolist()
            known.update(zip(part, (ids[a:b] for a, b in zip(edges, edges[1:]))))
        for w, e in zip(whole, self.tokenizer.encode_batch(whole, add_special_tokens=False)):
            self.word[w] = np.array(e.ids, np.uint32).tobytes()
        get = known.__getitem__
        self.word.update((w, get(p[0]) if len(p) == 1 else b"".join(map(get, p))) for w, p in cut.items())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with END after each text, as unsigned 32-bit integers, and the number of ids of each text."""
        if len(self.word) > CACHE_WORDS:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        here, known = flat.dictionary.to_pylist(), self.word
        self.learn([w for w in here if w not in known])
        # the batch's own table: ids of its distinct words, one after the other
        parts = [known[w] for w in here]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        table = np.frombuffer(b"".join(parts), np.uint32)
        word = flat.indices.to_numpy(zero_copy_only=False)
        w_size = size[word]
        ends = np.cumsum(w_size)
        counts = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]) + 1
        # position of every id in the table: steps of one within a word
        at = np.repeat((np.cumsum(size) - size)[word] - (ends - w_size), w_size)
        at += np.arange(len(at))
        out = np.full(int(counts.sum()), END, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts) - 1] = False
        out[keep] = table[at]
        return out, counts


def words(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def slices(texts: pa.Array, limit: int = 6 << 20):
    """Runs (start, length) of a column of texts of about limit bytes each, so that memory is bounded."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield at, to - at
        at = to


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
