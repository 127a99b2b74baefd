"""Ids of a lower-casing word-end BPE vocabulary (tokenizers .json), merged once for each distinct word of a batch.

White space is a hard boundary of this kind of tokenizer, so texts are cut at ASCII white space and each distinct word is
encoded once. Words of ASCII and Latin-1 letters, digits and marks go through the merge agenda, vectorised over all words;
what the library's normaliser does to each such character is asked of the library itself when the vocabulary is loaded. All
other words (apostrophes, special strings, other scripts) are encoded by the library.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from millrace.llm.merges import PairTable, merge_words

_LOADED: dict[str, "WordVocabulary"] = {}
LETTER, DIGIT, MARK, OTHER = 0, 1, 2, 3


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the others count up from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class WordVocabulary:
    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        spec = json.load(open(file, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fast = bool(self.suffix) and model["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and not model.get("dropout")
        if not self.fast:
            return
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PairTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], np.arange(len(pairs)), [vocab[a + b] for a, b in pairs])
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        # what single characters become, asked of the library
        self.lower = np.arange(256, dtype=np.uint8)
        self.kind = np.full(256, OTHER, np.uint8)
        for b in range(33, 127):
            c = chr(b)
            low = self.lib.normalizer.normalize_str(c)
            if len(low) == 1 and low.isascii():
                self.lower[b], self.kind[b] = ord(low), LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK
        self.kind[ord("'")] = self.kind[ord("<")] = OTHER
        self.latin = np.zeros(256, bool)  # second bytes after C3
        self.latin_low = np.arange(256, dtype=np.uint8)
        for b in range(0x80, 0xC0):
            c = bytes([0xC3, b]).decode()
            low = self.lib.normalizer.normalize_str(c).encode()
            if c.isalpha() and len(low) == 2 and low[0] == 0xC3:
                self.latin[b], self.latin_low[b] = True, low[1]

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words (no white space in them) and offsets."""
        n = len(words)
        words = words.cast(pa.large_string())
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        if not self.fast:
            return self._by_library(words.to_pylist())
        kind = self.kind[data]
        c3 = data == 0xC3
        if c3.any():
            at = np.nonzero(c3)[0]
            ok = self.latin[data[np.minimum(at + 1, len(data) - 1)]] & (at + 1 < len(data))
            at = at[ok]
            kind[at] = LETTER
            kind[at + 1] = LETTER
        low = self.lower[data]
        if c3.any():
            low[at + 1] = self.latin_low[data[at + 1]]
        bad = np.add.reduceat((kind == OTHER).astype(np.int32), np.minimum(offs[:-1], max(len(data) - 1, 0))) > 0
        word = np.repeat(np.arange(n), np.diff(offs))
        start = np.ones(len(data), bool)
        start[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        use = ~bad[word]
        low, start, word = low[use], start[use], word[use]
        tok = np.nonzero(start)[0]
        ends = np.append(tok[1:], len(low))
        sym = self.inner[low]
        if len(low):
            sym[ends - 1] = self.last[low[ends - 1]]
        flat, cuts = merge_words(sym, np.append(tok, len(low)).astype(np.int64), self.table)
        per_token = np.diff(cuts)
        counts = np.zeros(n, np.int64)
        np.add.at(counts, word[tok], per_token)
        slow = np.nonzero(bad)[0]
        if not len(slow):
            return flat, np.concatenate([[0], np.cumsum(counts)])
        s_ids, s_offs = self._by_library(words.take(pa.array(slow)).to_pylist())
        counts[slow] = np.diff(s_offs)
        out_offs = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(out_offs[-1], np.int32)
        is_slow = np.repeat(bad, counts)
        out[~is_slow] = flat
        out[is_slow] = s_ids
        return out, out_offs

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.lib.encode(w, add_special_tokens=False).ids for w in words]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.array([i for x in ids for i in x], np.int32), offs


def vocabulary(file: str) -> WordVocabulary:
    if file not in _LOADED:
        _LOADED[file] = WordVocabulary(file)
    return _LOADED[file]
