"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, over Arrow batches.

A text is cut where no piece of the vocabulary can reach across: before a run of spaces that follows something else. That no
piece reaches across is checked on the whole vocabulary when it is loaded. Distinct segments of a batch are merged
once by the score-ordered agenda of `merges`, and every distinct segment's ids are checked against the sentencepiece library;
a segment that differs, or a text with what segments cannot express, takes the library's ids.

Defined results: null text counts as empty; an empty text has the end id only and decodes to ""; repeated rows are encoded
each; an empty table gives an empty table; other columns stay out of the result, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, strings
from millrace.llm.merges import PairTable, merge_words

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_LOADED: dict[str, "PieceVocabulary"] = {}


class PieceVocabulary:
    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces change the merges; this vocabulary is not supported")
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("a vocabulary without byte fallback is not supported")
        normal = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces reach across spaces; this vocabulary is not supported")
        probe = "Aﬁé́ 　x  ​y\t\n z"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("a vocabulary with a normaliser is not supported")
        # symbols: piece ids; single characters that are no pieces get ids from n on
        self.char_of = dict.fromkeys(c for p in normal for c in p)
        self.symbol = np.full(0x110000, -1, np.int32)
        extra, self.extra_chars = n, []
        for c in self.char_of:
            if c in normal:
                self.symbol[ord(c)] = normal[c]
            else:
                self.symbol[ord(c)], extra = extra, extra + 1
                self.extra_chars.append(c)
        own = normal | {c: n + k for k, c in enumerate(self.extra_chars)}
        rows = [(own[p[:k]], own[p[k:]], sp.get_score(i), i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
        left, right, score, merged = map(np.array, zip(*rows, strict=True))
        ranks = np.unique(-score, return_inverse=True)[1]
        self.table = PairTable(left, right, ranks, merged)
        self.first_other = extra
        self.end = sp.eos_id()
        self.text_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])

    def segment_ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment by the agenda."""
        joined = "".join(segments)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
        sym = self.symbol[cps]
        odd = sym < 0
        sym = np.where(odd, self.first_other + cps.astype(np.int64), sym).astype(np.int32)
        out, ends = merge_words(sym, offs, self.table)
        flat, cuts = out.tolist(), ends.tolist()
        n = len(self.pieces)
        if (out >= n).any():
            res = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ids: list[int] = []
                for x in flat[a:b]:
                    if x < n:
                        ids.append(x)
                    else:
                        c = self.extra_chars[x - n] if x < self.first_other else chr(x - self.first_other)
                        ids += [int(self.byte_ids[v]) for v in c.encode()]
                res.append(ids)
            return res
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def checked(self, segments: list[str]) -> tuple[list[list[int]], int]:
        """Ids of segments, each checked against the library; and how many differed. A segment with one leading space mark
        is what the library makes of the bare word; others are checked with their marks as spaces."""
        ids = self.segment_ids(segments)
        lib = self.lib.encode([s[1:] for s in segments], num_threads=1)
        wrong = [k for k, (a, b) in enumerate(zip(ids, lib, strict=True)) if a != b and len(segments[k]) > 1]
        for k in wrong:
            ids[k] = lib[k]
        return ids, len(wrong)

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Bytes of ids without the sentence's own rules: pieces' texts and bytes, one after the other."""
        t = self.text_bytes
        return b"".join([t[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: the first space of the text goes, each byte that is no part of valid UTF-8 becomes U+FFFD."""
        raw = self.decode_bytes(ids)
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.lib.decode(ids)


def vocabulary(model_file: str) -> PieceVocabulary:
    if model_file not in _LOADED:
        _LOADED[model_file] = PieceVocabulary(model_file)
    return _LOADED[model_file]


def encode_texts(v: PieceVocabulary, texts: pa.LargeStringArray) -> tuple[list[list[list[int]]], int]:
    """For each text the ids of its segments, and the number of segments where the library differed."""
    marked = pc.replace_substring(texts, " ", SPACE)
    # with the mark that the library puts before a text, two marks in a row
    hard = pc.or_(pc.match_substring(marked, SPACE + SPACE), pc.starts_with(marked, SPACE)).to_pylist()
    plain = pc.split_pattern(marked, SPACE)
    enc = plain.flatten().dictionary_encode()
    offs = plain.offsets.to_numpy()
    offs = (offs - offs[0]).tolist()
    idx = enc.indices.to_numpy(zero_copy_only=False)
    words = [SPACE + w for w in enc.dictionary.to_pylist()]
    ids, wrong = v.checked(words)
    out = []
    for k, t in enumerate(marked):
        a, b = offs[k], offs[k + 1]
        if not hard[k]:
            # words of a lone mark at the end ("x ") are segments of one mark, which the agenda gives too
            out.append([ids[i] for i in idx[a:b].tolist()] if b > a and not (b == a + 1 and words[idx[a]] == SPACE) else [])
            continue
        segs = _SEGMENT.findall(SPACE + t.as_py())
        got, _ = _hard_segments(v, segs)
        out.append(got)
    return out, wrong


def _hard_segments(v: PieceVocabulary, segs: list[str]) -> tuple[list[list[int]], int]:
    distinct = list(dict.fromkeys(segs))
    ids, wrong = v.checked(distinct)
    by = dict(zip(distinct, ids, strict=True))
    return [by[s] for s in segs], wrong


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encodes with the end id and decodes again: key, n_tokens, ids_sha256, decoded_sha256, n_differing [, ids].

    n_differing counts the distinct segments of the document's batch in which the agenda and the library differed (0 is expected;
    the library's ids are then used). One map over the rows: no shuffle, memory for one slice of a batch.
    """
    types = docs.select(key).schema[0].dataType.simpleString()
    schema = f"{key} {types}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differing long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        v = vocabulary(model_file)
        tail = str(v.end).encode()
        for batch in batches:
            for part in slices(batch, text):
                enc, wrong = encode_texts(v, strings(part.column(text)))
                n_tokens, sha, dec, all_ids = [], [], [], []
                strs: dict[int, tuple[bytes, bytes, int]] = {}
                for segs in enc:
                    bits, raws, n = [], [], 1
                    for s in segs:
                        made = strs.get(id(s))
                        if made is None:
                            made = strs[id(s)] = (b"".join([b"%d " % i for i in s]), v.decode_bytes(s), len(s))
                        bits.append(made[0])
                        raws.append(made[1])
                        n += made[2]
                    raw = b"".join(raws)
                    raw = raw[1:] if raw[:1] == b" " else raw
                    try:
                        raw.decode()
                    except UnicodeDecodeError:
                        raw = v.lib.decode([i for s in segs for i in s]).encode()
                    n_tokens.append(n)
                    sha.append(hashlib.sha256(b"".join(bits) + tail).hexdigest())
                    dec.append(hashlib.sha256(raw).hexdigest())
                    if with_ids:
                        all_ids.append([i for s in segs for i in s] + [v.end])
                cols = [part.column(key), pa.array(n_tokens, pa.int64()), pa.array(sha), pa.array(dec), pa.array([wrong] * len(sha), pa.int64())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "n_differing"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names)

    return docs.select(F.col(key), F.col(text).alias(text)).mapInArrow(run, schema)
