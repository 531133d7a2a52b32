"""Tokenizers inside tasks: loaded once a worker, with a bounded memory of segments already encoded.

A segment is white space followed by other characters, up to the next white space (or white space alone
at the end); a run of Latin letters and digits at its start is a segment of its own where ASCII
punctuation follows. For every tokenizer here a pre-token never holds a non-space followed by a space, nor
a letter or digit followed by punctuation, so a segment's ids do not depend on its neighbours, and a
text's ids are those of its segments in order. The ids themselves always come from the tokenizer's library.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, as \s means in the tokenizers' patterns.
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters that stay one letter when lower-cased (a capital I with a dot does not).
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SEGMENT = re.compile(rf"[{SPACE}]*[0-9{LATIN}]++(?=[!-/:-@\[-`{{-~])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Of a byte-level tokenizer, one pre-token for certain.
WORD = re.compile(rf" ?[{LATIN}]+")
#: Segments that a worker remembers before it starts afresh.
REMEMBERED = 1_200_000
#: Longer segments are encoded each time: remembering them would cost more than it saves.
LONGEST_REMEMBERED = 64


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_alphabet(path: str) -> dict[int, str] | None:
    """How a byte-level tokenizer writes bytes, as a table for str.translate; None for tokenizers that do more
    to a word than its model does."""
    with open(path, "rb") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE"
    if not plain or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or any(WORD.fullmatch(x["content"]) for x in spec.get("added_tokens", ())):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Segments(dict):
    """What encoding gives for segments, encoded where they are first met.

    Plain words of a byte-level tokenizer go to the library's model directly, past its splitting.
    """

    def __init__(self, path: str, value):
        super().__init__()
        self.tokenizer = library_tokenizer(path)
        self.alphabet = byte_alphabet(path)
        self.model = self.tokenizer.model
        self.value = value

    def __missing__(self, segment: str):
        if self.alphabet is not None and WORD.fullmatch(segment):
            out = self.value([t.id for t in self.model.tokenize(segment.encode().decode("latin-1").translate(self.alphabet))])
        else:
            out = self.value(self.tokenizer.encode_batch_fast([segment], add_special_tokens=False)[0].ids)
        if len(segment) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = out
        return out

    def per_text(self, texts: list[str], join) -> list:
        """join(values of a text's segments), for each text."""
        value_of, cut = self.__getitem__, SEGMENT.findall
        return [join(map(value_of, cut(x))) for x in texts]

    def per_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; their numbers per text), of Segments whose values are ids.

        The segments are told apart and numbered by numpy and Arrow, so that each different one is looked up once."""
        begins, segments = column_segments(texts)
        numbered = segments.dictionary_encode()
        values = [self[x] for x in numbered.dictionary.to_numpy(zero_copy_only=False)]
        known = np.frombuffer(b"".join([*values, self.value([end_id])]), np.uint32)
        size_of = np.array([*map(len, values), 4], np.int64) // 4
        # the end's number after every text's segments
        order = np.insert(numbered.indices.to_numpy(), begins[1:], len(values))
        size = size_of[order]
        stops = np.cumsum(size)
        ids = known[np.repeat((np.cumsum(size_of) - size_of)[order] - (stops - size), size) + np.arange(int(size.sum()))]
        ends = stops[begins[1:] + np.arange(len(texts))]
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def segment_ids(path: str) -> Segments:
    """Values: ids as unsigned 32-bit integers in the order of bytes that numpy reads."""
    return Segments(path, lambda ids: array("I", ids).tobytes())


@lru_cache(maxsize=2)
def segment_counts(path: str) -> Segments:
    """Values: numbers of tokens."""
    return Segments(path, len)


_IS_PUNCTUATION = np.zeros(256, bool)
_IS_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def column_segments(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of the first segment of each text, and of all; the segments) of texts without nulls.

    Cut before ASCII white space that follows a character that is none, and where ASCII punctuation follows a
    segment's first letters and digits. These are some of the places where the text may be cut: behind characters
    that may be white space beyond ASCII, and behind letters beyond U+01FF, it is not.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    b = np.frombuffer(data, np.uint8, high) if high else np.zeros(0, np.uint8)
    b, starts = b[low:high], offsets[:-1] - low
    if not len(b):
        return np.zeros(len(texts) + 1, np.int64), pa.array([], pa.large_string())
    space = (b == 32) | (b - np.uint8(9) < 5)
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    # NEL and NBSP begin with C2, the other white space of Unicode with E1, E2 or E3
    wide = (b[np.maximum(at - 2, 0)] == 0xC2) | (b[np.maximum(at - 3, 0)] - np.uint8(0xE1) < 3)
    is_cut = np.zeros(len(b) + 1, bool)
    is_cut[at[~wide]] = True
    is_cut[starts] = True
    # letters of two bytes from U+00C0 on, but for the multiplication and division signs and a capital I with a dot
    letter = ((b | np.uint8(32)) - np.uint8(97) < 26) | (b - np.uint8(48) < 10)
    lead = np.flatnonzero(b[:-1] - np.uint8(0xC3) < 5)
    pair = b[lead].astype(np.int32) << 8 | b[lead + 1]
    lead = lead[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]
    letter[lead] = letter[lead + 1] = True
    other = ~(letter | space)
    # of a segment, the first that is neither letter nor digit nor white space, if right behind one of these
    marked = np.flatnonzero(is_cut[:-1] | other)
    begins = is_cut[marked]
    at = marked[1:][other[marked[1:]] & ~begins[1:] & begins[:-1]]
    at = at[letter[at - 1]]
    is_cut[at[_IS_PUNCTUATION[b[at]]]] = True
    cuts = np.append(np.flatnonzero(is_cut[:-1]), len(b))
    first = np.searchsorted(cuts, np.append(starts, len(b)))
    return first, pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(b)])


def slices(texts: pa.Array, limit: int = 1 << 23):
    """An Arrow column of texts as runs of whole texts of about limit bytes, nulls as empty texts."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = min(len(texts), int(np.searchsorted(ends, before + limit)) + 1)
        yield texts.slice(begin, end - begin)
        begin = end


def groups(texts, limit: int = 1 << 18):
    """Texts of an Arrow column as lists of about limit characters."""
    out: list[str] = []
    held = 0
    for x in texts:
        x = x.as_py() or ""
        out.append(x)
        held += len(x)
        if held >= limit:
            yield out
            out, held = [], 0
    if out:
        yield out
