"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced at proven boundaries.

A boundary between two neighbouring characters is *closed* if no piece of the vocabulary holds these two characters next to
each other: then no merge can ever join across it, whatever stands around, and the tokens on its left and right do not
depend on each other. Two overlapping chunks are spliced at a closed boundary inside the overlap at which both have a token
boundary. If there is none the overlap is widened, in the end to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, OVERLAP = 20_000, 200


class ResyncCounter:
    """Counts tokens as a SentencePiece BPE model gives them for the whole text, without added begin or end tokens."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_byte(i) and not self.model.is_control(i))
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.widened = 0

    def counts(self, texts: list[str]) -> list[int]:
        """Short texts in one call, huge ones by chunks."""
        short = [t for t in texts if len(t) <= self.chunk]
        counted = iter(self.model.encode(short, num_threads=1, return_type="numpy") if short else [])
        return [len(next(counted)) if len(t) <= self.chunk else self.spliced(t) for t in texts]

    def _boundaries(self, text: str, start: int, stop: int) -> list[int]:
        """Where tokens of the chunk begin, as positions in the whole text; one entry per token."""
        return [start + begin for begin, _ in self.model.encode(text[start:stop], return_type="offset_mapping")["offsets"]]

    def closed(self, text: str, at: int) -> bool:
        pair = text[at - 1 : at + 1].replace(" ", "▁")
        return pair not in self.joined

    def spliced(self, text: str) -> int:
        if self.model.normalize(text[: self.chunk]).lstrip("▁") != text[: self.chunk].replace(" ", "▁").lstrip("▁"):
            return len(self.model.encode(text))  # a model that rewrites texts has no common positions
        total, done, start, overlap = 0, 0, 0, self.overlap
        stop = min(len(text), self.chunk)
        left = self._boundaries(text, start, stop)
        while stop < len(text):
            next_start = max(done, stop - overlap)
            next_stop = min(len(text), next_start + self.chunk + overlap)
            right = self._boundaries(text, next_start, next_stop)
            common = set(left).intersection(right)
            # the last tokens of the left chunk and the first of the right one lack their surroundings; a closed boundary needs none
            cut = next((p for p in sorted(common, reverse=True) if next_start < p < stop and p > done and self.closed(text, p)), None)
            if cut is None:
                self.widened += 1
                overlap *= 2
                if overlap >= stop - done:  # nothing is left to widen to the left: lengthen the left chunk
                    stop = min(len(text), stop + overlap)
                    left = self._boundaries(text, start, stop)
                continue
            total += sum(done <= p < cut for p in left)
            start, done, stop, left, overlap = next_start, cut, next_stop, right, self.overlap
        return total + sum(p >= done for p in left)


@lru_cache(maxsize=2)
def counter(path: str) -> ResyncCounter:
    """The counter of this worker process."""
    return ResyncCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each whole text; null counts as the empty text, which has none."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[int] = []
            for at in range(0, len(texts), 256):
                out += counter(path).counts(["" if t is None else t for t in texts.iloc[at : at + 256]])
            yield pd.Series(out, dtype="int64")

    return count(text)
