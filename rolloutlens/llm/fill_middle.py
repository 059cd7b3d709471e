"""Fill-in-middle examples: a text is cut at two unit boundaries into prefix, middle and suffix, and these are put in another order behind sentinels.

Where the boundaries are is answered by a wavelet matrix over the classes of the characters: a unit ends behind each character of an ending class, and behind the last character.
A text's boundary count is a sum of ranks, one for each ending class; the place of its k-th boundary is select for one ending class, and a bisection on those sums for several.
One matrix is built for a run of texts of some megabytes, and the cuts of all of them are found together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlens.llm.common import NULL_ID, as_bytes, id_and_text, real_id, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Character classes by their ASCII bytes; all other characters have class 0.
CLASSES = {"newline": b"\n", "return": b"\r", "space": b" \t\x0b\x0c", "stop": b".!?", "pause": b",;:", "digit": b"0123456789", "bracket": b"()[]{}<>"}
#: The classes that end a unit.
UNITS = {"line": ("newline",), "sentence": ("newline", "stop"), "word": ("newline", "return", "space")}

_CLASS_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(CLASSES.values(), 1):
    _CLASS_OF[list(_chars)] = _k


class WaveletMatrix:
    """Rank and select over small whole numbers: a bit vector for each bit, highest first, zeros before ones on the next level; 64 bits a word, and the ones before each word."""

    def __init__(self, values: np.ndarray, bits: int = 3):
        self.n, self.levels = len(values), []
        for k in reversed(range(bits)):
            ones = (values >> k & 1).astype(bool)
            packed = np.packbits(np.append(ones, np.zeros(-len(ones) % 64 + 64, bool)), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = self.n - int(before[-1])
            self.levels.append((k, packed, before, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ones in front of each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often the value occurs in front of each place."""
        low, high = np.zeros(len(at), np.int64), at
        for k, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            low, high = (zeros + a, zeros + b) if value >> k & 1 else (low - a, high - b)
        return high - low

    def select(self, value: int, count: np.ndarray) -> np.ndarray:
        """The place of the count-th occurrence (from 1) of the value, which must occur so often: down to its run, then up level by level."""
        low = np.zeros(1, np.int64)
        for k, packed, before, zeros in self.levels:
            a = self._ones(packed, before, low)
            low = zeros + a if value >> k & 1 else low - a
        at = low + count - 1
        for k, packed, before, zeros in reversed(self.levels):
            at = self._find(packed, before, (at - zeros if value >> k & 1 else at) + 1, bool(value >> k & 1))
        return at

    def _find(self, packed: np.ndarray, before: np.ndarray, count: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the count-th one, or zero, of a bit vector: its word by binary search, its bit by halving the word."""
        held = before if ones else np.arange(len(before), dtype=np.int64) * 64 - before
        word = np.searchsorted(held, count, side="left") - 1
        left, bits, at = count - held[word], packed[word] if ones else ~packed[word], word * 64
        for width in (32, 16, 8, 4, 2, 1):
            first = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left > first
            left, at, bits = left - beyond * first, at + beyond * width, np.where(beyond, bits >> np.uint64(width), bits)
        return at

    def count(self, values: Sequence[int], at: np.ndarray) -> np.ndarray:
        """How often any of the values occurs in front of each place."""
        return sum(self.rank(v, at) for v in values)

    def reach(self, values: Sequence[int], wanted: np.ndarray) -> np.ndarray:
        """The place of the wanted-th occurrence (from 1) of any of the values."""
        if len(values) == 1:
            return self.select(values[0], wanted)
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), self.n, np.int64)
        while np.any(open_ := low < high):
            mid = (low + high) >> 1
            enough = self.count(values, mid) >= wanted
            high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid + 1, low)
        return low - 1


def cuts(texts: list[bytes], draw: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts and two drawn numbers each: units, the first and second cut in code points, and the same cuts in bytes (two columns each).

    With n units the cuts are behind the smaller and the larger of draw mod n + 1 units.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
    classes = _CLASS_OF[data[begins]]
    ends = np.searchsorted(begins, np.cumsum(lengths))  # in code points
    starts = np.concatenate([[0], ends[:-1]])
    matrix, ending = WaveletMatrix(classes), [list(CLASSES).index(c) + 1 for c in UNITS[unit]]
    at_start, at_end = matrix.count(ending, starts), matrix.count(ending, ends)
    last = np.isin(classes[np.maximum(ends - 1, 0)], ending) if len(classes) else np.ones(len(texts), bool)
    units = at_end - at_start + ((ends > starts) & ~last)
    chosen = np.sort(draw % (units + 1)[:, None], axis=1)
    points = np.where(chosen == 0, starts[:, None], ends[:, None])
    inner = (chosen > 0) & (chosen <= (at_end - at_start)[:, None])
    if inner.any():
        points[inner] = matrix.reach(ending, (at_start[:, None] + chosen)[inner]) + 1
    places = np.append(begins, len(data))[points] - (np.cumsum(lengths) - lengths)[:, None]
    return units, points[:, 0] - starts, points[:, 1] - points[:, 0], places


def fill_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``docs``.

    n counts the units. Four numbers come from the sha256 of ``seed:doc_id`` (a null id as the empty string), so equal ids are cut by the same numbers and nothing depends on where a row runs.
    Of 100 texts ``rate`` are transformed, and ``spm`` of 100 of those put the suffix first. A text that is empty (a null one too) or holds a sentinel stays plain, with null counts.
    Null and repeated ids keep their rows; other columns are left aside. Nothing is shuffled.
    """
    if unit not in UNITS or not 0 <= rate <= 100 or not 0 <= spm <= 100:
        raise ValueError(f"unit must be one of {sorted(UNITS)}, rate and spm from 0 to 100")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.nullif(F.col("did"), F.lit(NULL_ID)).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    schema = "did long, n long, form string, prefix_chars long, middle_chars long, output binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            h = np.stack([batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)], axis=1)
            units, prefix, middle, places = cuts(texts, h[:, :2], unit)
            forms, outputs = [], []
            for k, text in enumerate(texts):
                if not text or any(m in text for m in marks) or h[k, 2] % 100 >= rate:
                    forms.append("plain")
                    outputs.append(text)
                    continue
                a, b = places[k].tolist()
                forms.append("spm" if h[k, 3] % 100 < spm else "psm")
                parts = (marks[1], text[b:], marks[0], text[:a]) if forms[-1] == "spm" else (marks[0], text[:a], marks[1], text[b:])
                outputs.append(b"".join((*parts, marks[2], text[a:b])))
            plain = np.array([f == "plain" for f in forms], bool)
            columns = [batch.column("did"), pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(outputs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["did", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = id_and_text(docs).select("did", "text", *numbers).mapInArrow(cut, schema)
    return made.select(real_id().alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from an output and its form: what stands between the sentinels, in the old order. The text holds no sentinel, and none can arise where a text and a sentinel meet."""
    parts = [F.substring_index(F.substring_index(F.col(output), MIDDLE, 1), mark, -1) for mark in (PREFIX, SUFFIX)]
    middle = F.substring_index(F.col(output), MIDDLE, -1)
    # behind its own sentinel a part reaches to the other one, if that comes later
    prefix, suffix = F.substring_index(parts[0], SUFFIX, 1), F.substring_index(parts[1], PREFIX, 1)
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat(prefix, middle, suffix))
