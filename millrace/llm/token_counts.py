"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both encodings must agree.

A splice point is a lone space between two characters that are no white space, well inside the overlap of two chunks. In the
tokenizers served here a piece never reaches from before such a space to behind it (the pre-tokenizers cut there; for
sentencepiece vocabularies it is checked on the vocabulary), so the tokens up to it and after it are those of the whole text.
Two such points are asked for: the tokens between them must be the same in both chunks.

Texts without spaces are spliced where AGREE tokens in a row, with equal ids and places and well inside the overlap, stand in both
chunks. Merges by rank never reach across a boundary between two tokens that are the encoding of what they spell together; in the
spliced sequence each two neighbours are neighbours in one of the two encodings, so none of its boundaries can be merged away, and
it is the encoding of the whole text. Where neither is found the overlap is doubled, up to encoding both chunks as one.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives an empty
table; other columns stay out of the result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, strings, words_of

HUGE_CHARS = 32768
OVERLAP_CHARS = 512
AGREE = 16


class Encoder:
    """ids and character offsets of a text, and counts of many, for a tokenizers .json or a sentencepiece .model file."""

    def __init__(self, file: str):
        self.file = file
        if file.endswith(".model"):
            from millrace.llm.pieces import vocabulary

            self.pieces, self.words = vocabulary(file), None
        else:
            from millrace.llm.wordbpe import vocabulary as word_vocabulary

            self.pieces, self.words = None, word_vocabulary(file)

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        if self.pieces:
            got = self.pieces.lib.encode(text, return_type="proto").pieces
            # the library's offsets are in bytes
            starts = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
            return [p.id for p in got], [(int(starts[p.begin]), int(starts[p.end])) for p in got]
        got = self.words.lib.encode(text, add_special_tokens=False)
        return got.ids, got.offsets

    def counts(self, texts: pa.LargeStringArray) -> np.ndarray:
        """Token counts of whole texts that are not huge."""
        if self.words and self.words.fast:
            idx, offs, words = words_of(texts)
            _, cuts = self.words.word_ids(words)
            return np.diff(np.concatenate([[0], np.cumsum(np.diff(cuts)[idx])])[offs])
        if self.pieces:
            return np.array([len(x) for x in self.pieces.lib.encode(texts.to_pylist(), num_threads=1)], np.int64)
        return np.array([len(self.words.lib.encode(t, add_special_tokens=False).ids) for t in texts.to_pylist()], np.int64)


def lone_spaces(text: str, a: int, b: int) -> list[int]:
    """Places in (a, b) of a space between two characters that are no white space."""
    out, p = [], text.find(" ", a + 1, b - 1)
    while p >= 0:
        if not text[p - 1].isspace() and not text[p + 1].isspace():
            out.append(p)
        p = text.find(" ", p + 1, b - 1)
    return out


def resync_count(encode, text: str, chunk: int = HUGE_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """Tokens of a text encoded in chunks, and how often an overlap had to be widened. encode: text -> (ids, spans)."""
    done, widened, n = 0, 0, len(text)
    start, stop = 0, min(chunk, n)
    ids, spans = encode(text[start:stop])
    first = 0  # tokens of this chunk before it belong to what is done
    while stop < n:
        wide = overlap
        while True:
            begin, end = max(start, stop - wide), min(n, stop - wide + chunk if stop - wide > start else stop + chunk)
            if begin == start:  # nothing aligned: both chunks as one
                ids, spans = encode(text[start:end])
                stop = end
                break
            ids2, spans2 = encode(text[begin:end])
            cut = _splice(text, start, begin, stop, ids, spans, ids2, spans2)
            if cut is not None:
                left, right = cut
                done += left - first
                ids, spans, first = ids2, spans2, right
                start, stop = begin, end
                break
            widened += 1
            wide *= 2
    return done + len(ids) - first, widened


def _splice(text, start, begin, stop, ids, spans, ids2, spans2) -> tuple[int, int] | None:
    """Numbers of tokens of the left and right chunk before a common stable boundary, or None."""
    margin = max(8, (stop - begin) // 8)
    places = lone_spaces(text, begin + margin, stop - margin)
    if len(places) < 2:
        return _agreed(start, begin, begin + margin, stop - margin, ids, spans, ids2, spans2)
    lo, hi = places[0], places[-1]
    ends, ends2 = [e for _, e in spans], [e for _, e in spans2]
    cuts = [(bisect.bisect_right(ends, p - start), bisect.bisect_right(ends2, p - begin)) for p in (lo, hi)]
    (a, a2), (b, b2) = cuts
    same = ids[a:b] == ids2[a2:b2] and all(s[1] + start == t[1] + begin for s, t in zip(spans[a:b], spans2[a2:b2], strict=True))
    return (b, b2) if same and b > a else None


def _agreed(start, begin, lo, hi, ids, spans, ids2, spans2) -> tuple[int, int] | None:
    """Numbers of tokens of the left and right chunk before the middle of AGREE common tokens between the places lo and hi, or None."""
    a, b = bisect.bisect_left(spans, lo - start, key=lambda s: s[0]), bisect.bisect_right(spans, hi - start, key=lambda s: s[1])
    other = {(x[0] + begin, x[1] + begin, t): k for k, (x, t) in enumerate(zip(spans2, ids2, strict=True))}
    run, last = 0, None
    for k in range(a, b):
        at = other.get((spans[k][0] + start, spans[k][1] + start, ids[k]))
        run = run + 1 if at is not None and run and at == last + 1 else int(at is not None)
        last = at
        if run == AGREE:
            half = AGREE // 2
            while half and spans[k - half][1] > spans[k - half + 1][0]:  # not within a character
                half -= 1
            return (k - half + 1, last - half + 1) if half else None
    return None


def token_counts(docs: DataFrame, file: str, limit: int, text: str = "text", key: str = "doc_id", huge: int = HUGE_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit), n_widened. One map over the rows, no shuffle."""
    types = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        enc = Encoder(file)
        for batch in batches:
            for part in slices(batch, text):
                texts = strings(part.column(text))
                big = pc.greater(pc.utf8_length(texts), huge).to_numpy(zero_copy_only=False)
                n_tokens, widened = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                n_tokens[~big] = enc.counts(texts.filter(pa.array(~big)))
                for i in np.nonzero(big)[0]:
                    n_tokens[i], widened[i] = resync_count(enc.spans, texts[int(i)].as_py(), huge, overlap)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pc.binary_length(texts).cast(pa.int64()), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(widened)], [key, "n_bytes", "n_tokens", "over_limit", "n_widened"]
                )

    return docs.select(F.col(key), F.col(text).alias(text)).mapInArrow(run, f"{key} {types}, n_bytes long, n_tokens long, over_limit boolean, n_widened long")
