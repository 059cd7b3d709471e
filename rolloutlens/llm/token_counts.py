"""Token counts under a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates every vocabulary piece in a word; dynamic programming carries the best score and
the number of pieces on that path. Ties go to the piece that starts earliest, as in the tokenizers library's unigram model.
Words are cut at spaces and 0x09-0x0D and get a leading word mark; each distinct word is worked out once while it stays in the cache.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolloutlens.llm.common import id_and_text, real_id, slices

#: The word mark, and what an unknown character costs below the worst piece: fixed values of the unigram model.
MARK, UNKNOWN_PENALTY = "▁", 10.0
CACHE_WORDS = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log probability) from a public piece vocabulary, unknown first: by Zipf's law on the pieces' given order. Nothing is trained."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return [("<unk>", 0.0), *((p, -math.log(k + 10.0)) for k, p in enumerate(pieces))]


class Counter:
    """``count(word)``: pieces of the best segmentation, a run of unknown characters being one piece, and how many are unknown."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> tuple[int, int]:
        n = len(word)
        best, pieces, unknowns = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        open_end = [False] * (n + 1)  # the path ends in an unknown piece
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):
            ending[last + 1].append(match)
        for end in range(1, n + 1):
            top, at, unknown = -math.inf, 0, False
            for length, score in sorted(ending[end], reverse=True):  # the longest starts earliest
                if (got := best[end - length] + score) > top:
                    top, at = got, end - length
            if word[end - 1] not in self.single and (got := best[end - 1] + self.unknown) > top:
                top, at, unknown = got, end - 1, True
            best[end], open_end[end] = top, unknown
            new = not (unknown and open_end[at])
            pieces[end], unknowns[end] = pieces[at] + new, unknowns[at] + (unknown and new)
        return pieces[n], unknowns[n]

    def totals(self, text: str) -> tuple[int, int]:
        cache, words = self.cache, _WORD.findall(text)
        got = list(map(cache.get, words))
        if None in got:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for k, x in enumerate(got):
                if x is None:
                    word = words[k]
                    if word not in cache:
                        n, unknown = self.count(word if word.startswith(MARK) else MARK + word)
                        got[k] = n + (unknown << 32)
                        if len(word) <= 64:
                            cache[word] = got[k]
                    else:
                        got[k] = cache[word]
        total = sum(got)
        return total & 0xFFFFFFFF, total >> 32


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(zipf_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, n_unknown) for each row. Null and empty texts have no tokens; null ids stay; repeated rows come out each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path)
        for batch in slices(batches):
            got = np.array([counter.totals(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(got[:, 0]), pa.array(got[:, 1])], ["did", "n_tokens", "n_unknown"])

    return id_and_text(docs).mapInArrow(count, "did long, n_tokens long, n_unknown long").select(real_id().alias("doc_id"), "n_tokens", "n_unknown")
