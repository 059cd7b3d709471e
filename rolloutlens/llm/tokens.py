"""Token ids of whole texts by a public tokenizer, with a bounded cache of the parts that repeat.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so that the ids of the parts, joined, are the ids of
the text. Texts with unusual white space are encoded whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Parts in a worker's cache (about 200 bytes each); it is emptied when full.
CACHE_PARTS = 1_000_000
_LONGEST_KEPT = 64
#: Between a letter and a stop or comma is always a cut.
_STOP = re.compile(rb"(?<=[a-z])(?=[.,!])")
#: Byte strings of white space other than one space or line feed between two other characters; and the mark used below.
_ODD = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\x03", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


class Encoder:
    """``ids(texts)`` gives a list of uint32 arrays.

    kind "words": the pre-tokenizer drops white space, so words are independent (``word_bpe_49k.json``).
    kind "spaced": a single space starts a part and a single line feed is a token (``byte_bpe_50k.json``).
    The strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = kind == "spaced"
        self.cache: dict[bytes, bytes] = {}
        self.gap, self.mark = (b"\n", b"\n") if self.spaced else (b" \x01 ", b"\x01")
        (self.gap_id,) = self._flat(self.mark.decode()).tolist()

    def _parts(self, raw: bytes) -> list[bytes] | None:
        """In "spaced", a part without a mark has a space before it, \\n is itself a mark and \\x03 stands for nothing."""
        if not self.spaced:
            return _STOP.sub(b" ", raw.lower()).split()
        if raw[:1] in (b" ", b"\n") or raw[-1:] in (b" ", b"\n") or any(x in raw for x in _ODD):
            return None
        return _STOP.sub(b" \x03", b"\x03" + raw).replace(b"\n", b" \n").split(b" ") if raw else []

    def _new(self, parts: list[bytes]) -> list[bytes]:
        if not self.spaced:
            return self._encoded(parts)
        got = self._encoded([p[1:] if p[0] in b"\n\x03" else b" " + p for p in parts])
        feed = self.gap_id.to_bytes(4, "little")
        return [feed + x if p[0] == 10 else x for p, x in zip(parts, got, strict=True)]

    def _encoded(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part. Parts are encoded many at a time, with a part between them that has one id of its own."""
        gap, mark = self.gap, self.mark
        out: list[bytes] = []
        for start in range(0, len(parts), 2_000):
            some = parts[start : start + 2_000]
            if any(mark in p for p in some):
                out += [self._flat(p.decode()).tobytes() for p in some]
                continue
            flat = self._flat(gap.join(some).decode())
            ends = np.append(np.flatnonzero(flat == self.gap_id), len(flat)) * 4
            data, at = flat.tobytes(), 0
            for end in ends.tolist():
                out.append(data[at:end])
                at = end + 4
        return out

    def _flat(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cache = self.cache
        if len(cache) > CACHE_PARTS:
            cache.clear()
        cut = [self._parts(t.encode()) for t in texts]
        found = [parts and list(map(cache.get, parts)) for parts in cut]
        fresh = list({p for parts, got in zip(cut, found, strict=True) if got and None in got for p, x in zip(parts, got, strict=True) if x is None})
        new = dict(zip(fresh, self._new(fresh), strict=True))
        out = []
        for text, parts, got in zip(texts, cut, found, strict=True):
            if parts is None:
                out.append(self._flat(text))
                continue
            if got and None in got:
                got = [new[p] if x is None else x for p, x in zip(parts, got, strict=True)]
            out.append(np.frombuffer(b"".join(got), "<u4"))
        cache.update((p, x) for p, x in new.items() if len(p) <= _LONGEST_KEPT)
        return out


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path, kind)
