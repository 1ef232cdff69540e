"""Whole-text encoding by public tokenizers, each distinct piece encoded once per worker.

The pieces are cut where the library's own first split always cuts, so the joined ids are those of the whole text.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A piece longer than this is encoded but not kept.
LONG_PIECE = 200
#: A character that stands alone as a word between pieces; its id cannot come from pieces without it.
MARK = "\x00"
_STEM = re.compile(r"([^\W_]+)([!-/:-@\[-`{-~].*)\Z", re.DOTALL)
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def spaced_pieces(text: str) -> tuple[str, list[str]]:
    """Cut before single spaces between two visible characters; a byte-level tokenizer joins such a space to what follows."""
    head, *tail = _BETWEEN_WORDS.split(text)
    return head, tail


def word_pieces(text: str) -> tuple[str, list[str]]:
    """Cut at spaces and line breaks, for a tokenizer that drops white space."""
    return "", text.replace("\n", " ").split(" ")


def _ascii_lower(stem: str) -> str:
    """Lower case where it is sure to be what a lower-casing tokenizer makes of the stem."""
    return stem.lower() if stem.isascii() else stem


class CachedEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A piece made of letters or digits and a tail that begins with ASCII punctuation is cut once more between the two, where
    both libraries' first split always cuts. ``pieces`` and ``stems`` bound what stays in memory between calls: a memory
    that would grow beyond its bound is emptied first.
    """

    def __init__(self, path: str, spaced: bool, pieces: int = 300_000, stems: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.lead = (spaced_pieces, " ") if spaced else (word_pieces, "")
        self.fold = str if spaced else _ascii_lower
        self.bounds = {"pieces": pieces, "stems": stems}
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(f"a {MARK}", add_special_tokens=False).ids[1:]

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces without the mark, encoded as one text with the mark, a word of its own, behind each."""
        text = lead + f" {MARK}{lead or ' '}".join(pieces) + f" {MARK}"
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.mark[-1]) + 1
        starts = np.concatenate(([0], ends[:-1])) * 4
        raw, stops = ids.tobytes(), (ends - len(self.mark)) * 4
        return [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]

    def _learn_stems(self, new: list[str]) -> None:
        if len(self.stems) + len(new) > self.bounds["stems"]:
            self.stems.clear()
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            self.stems.update(zip(part, self._joined(part, self.lead), strict=True))

    def _learn(self, pieces: set[str]) -> list[str]:
        """Make sure that all pieces are known; return those to be forgotten after this call."""
        known, stems = self.known, self.stems
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > self.bounds["pieces"]:
            known.clear()
            new = list(pieces)
        bare, cut, other, fold = [], [], [], self.fold
        for piece in new:
            if piece.isalnum():
                bare.append((piece, fold(piece)))
            elif "<|" not in piece and MARK not in piece and (found := _STEM.match(piece)):
                cut.append((piece, fold(found[1]), found[2]))
            else:
                other.append(piece)
        wanted = {c[1] for c in bare}.union(c[1] for c in cut)
        self._learn_stems([w for w in wanted if w not in stems])
        if lost := [w for w in wanted if w not in stems]:  # emptied meanwhile
            self._learn_stems(lost)
        tails = list({c[2] for c in cut})
        tail_ids = dict(zip(tails, self._alone(tails), strict=True))
        known.update((piece, stems[stem]) for piece, stem in bare)
        known.update((piece, stems[stem] + tail_ids[tail]) for piece, stem, tail in cut)
        known.update(zip(other, self._alone([self.lead + p for p in other]), strict=True))
        for stem in wanted:
            if len(stem) > LONG_PIECE:
                del stems[stem]
        return [p for p in new if len(p) > LONG_PIECE]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # only strings and bytes are made here, but in numbers that would set the collector off again and again
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        heads = self._alone([head for head, _ in cut])
        long = self._learn(set().union(*(tail for _, tail in cut)))
        of = self.known.__getitem__
        ids = [head + b"".join(map(of, tail)) for head, (_, tail) in zip(heads, cut, strict=True)]
        for piece in long:
            del self.known[piece]
        return ids


#: First split of byte-level tokenizers, a fixed value of their format.
BYTE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run that the rank encoder would need quadratic time or deep recursion for.
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def _byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if visible, else the next above 255."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankEncoder:
    """Ids of texts by a byte-level vocabulary whose ids are its merge ranks, as little-endian unsigned 32-bit integers.

    Such a file means the same to ``tiktoken``, which needs a quarter of the time and no memory of pieces. Texts with very long
    runs without a split go to the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        symbols, vocabulary = _byte_symbols(), stated["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in stated["model"]["merges"]]
        merged = [vocabulary["".join(m)] for m in pairs]
        if merged != sorted(set(merged)) or len(merged) + 256 != len(vocabulary.keys() - special.keys()):
            raise ValueError(f"the ids of {path} are no merge ranks")
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.encoding = tiktoken.Encoding("ranks", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.path = path

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        whole = self.encoding.encode
        return [
            encoder(self.path, True).encode([t])[0] if _LONG_RUN.search(t) else array("I", whole(t, allowed_special="all")).tobytes()
            for t in texts
        ]


@lru_cache(maxsize=4)
def rank_encoder(path: str) -> RankEncoder:
    """The rank encoder of this worker process."""
    return RankEncoder(path)


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> CachedEncoder:
    """The encoder of this worker process."""
    return CachedEncoder(path, spaced)
