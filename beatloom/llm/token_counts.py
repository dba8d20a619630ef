"""Token counts of a SentencePiece BPE model without encoding whole texts.

Whole-token shortcut: a vocabulary string that the library encodes alone as one
token needs no merging wherever it stands as a pre-token. Pre-tokens end before
each run of spaces; no vocabulary string holds a space mark behind another
character (checked when the model is read), so no merge crosses such an end and
the count of a text is the sum over its pre-tokens.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from beatloom.llm.text import keyed, map_batches, schema_of, texts

MARK = "▁"  # the model's sign for a space
PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KEPT = 400_000  # remembered merges per worker; forgetting costs time only
BLOCK = 4_000_000  # characters whose unknown pre-tokens are merged in one call


class PreTokenCounts:
    """Token counts of pre-tokens, given without their first space mark."""

    def __init__(self, model: str):
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.encoder.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("pre-tokens of this model are not independent")
        # the proof: the library itself encodes the string as this one token
        starts = {p[1:]: i for i, p in enumerate(pieces) if p.startswith(MARK) and not p.startswith(MARK * 2)}
        starts.pop("", None)
        encoded = self.encoder.encode(list(starts), num_threads=1)
        self.whole = {s: 1 for (s, i), ids in zip(starts.items(), encoded) if ids == [i]}
        # a space at the end of a text stands alone
        if self.encoder.encode("a ")[-1] == self.encoder.piece_to_id(MARK):
            self.whole[""] = 1
        self.known = dict(self.whole)

    @staticmethod
    def split(text: str) -> list[str]:
        """Pre-tokens without their first space mark, which the encoder adds."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            marked = PRE_TOKEN.findall(MARK + text.replace(" ", MARK))
            return [p[1:].replace(MARK, " ") for p in marked]
        return text.split(" ")

    def learn(self, parts: set[str]) -> None:
        """Merge, once each, the pre-tokens that are not known yet."""
        rest = list(parts - self.known.keys())
        if len(self.known) + len(rest) > KEPT:
            self.known = dict(self.whole)
            rest = list(parts - self.known.keys())
        self.known.update(zip(rest, map(len, self.encoder.encode(rest, num_threads=1))))

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of some texts; the merges of a block of texts are done together."""
        out: list[int] = []
        block: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            block.append(self.split(text))
            size += len(text)
            if size >= BLOCK or i == len(texts) - 1:
                self.learn(set(chain.from_iterable(block)))
                out += [sum(map(self.known.__getitem__, parts)) for parts in block]
                block, size = [], 0
        return out


@lru_cache(maxsize=2)
def counts_of(model: str) -> PreTokenCounts:
    return PreTokenCounts(model)


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    ``model`` is a SentencePiece file that every executor can read. Counts are the
    library's, without begin and end tokens. Null and empty texts have 0; rows
    with equal keys are counted each.
    """
    d = keyed(docs, key, text)
    schema = schema_of(d, key, "n_bytes long, n_tokens long, over_limit boolean")

    def run(batches):
        for batch in batches:
            n = counts_of(model).counts(texts(batch))
            yield {
                key: batch.column(key),
                "n_bytes": pc.binary_length(batch.column("_text")),
                "n_tokens": n,
                "over_limit": [x > limit for x in n],
            }

    return map_batches(d, run, schema)
