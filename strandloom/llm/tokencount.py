"""Token counts by the whole-token shortcut.

A vocabulary of merged pieces (byte-pair style, by sentencepiece) never merges two characters that stand
side by side in none of its pieces. Two facts about the vocabulary file follow from its pieces alone and are
worked out once per task, before any text is read:

* **Where a text may be cut.** Characters that occur together in a piece belong to one class (components
  of the graph of neighbours). Nothing merges across two classes, nor before a space unless another space
  comes first. So the text falls into pre-tokens, spaces followed by a run of one class, that are encoded
  each on its own.
* **Which strings are one token.** A piece of the vocabulary whose own encoding is that piece alone counts
  as one wherever it is a whole pre-token. Not all do: merges may lead past a piece.

Pre-tokens are looked up in the table of proven pieces; only those not found go through the library's
merges, the different ones of a batch once, and their counts are kept for later batches (up to ``MEMO`` strings
of at most ``SHORT`` characters, so memory is bounded; longer ones are merged each time).

Vocabularies that rewrite texts first (a normaliser's table, removed spaces) or hold user-defined pieces
have no such cuts: there every text goes through the library whole, which ``Counter.exact`` tells.

Edge cases. A null or empty text has no token. Characters that the vocabulary lacks count as the library
spells them, a token per UTF-8 byte with byte fallback. Names of control pieces in a text are ordinary text.
Repeated rows and ids are counted each. Texts are read whole, however long. Extra columns are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists

LIMIT = 4096
MEMO = 400_000
SHORT = 64
SPACE = "▁"


class Counter:
    """Numbers of tokens of texts, by one sentencepiece model."""

    def __init__(self, path: str, memo: int = MEMO):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.memo = memo
        self.looked_up = self.merged = 0
        kinds = self.library
        pieces = [kinds.id_to_piece(i) for i in range(len(kinds)) if not (kinds.is_byte(i) or kinds.is_control(i) or kinds.is_unknown(i) or kinds.is_unused(i))]
        self.lone = self._lone(pieces)
        self.exact = self.lone is not None and self._plain(pieces)
        if self.exact:
            self.pattern = re.compile(self._cuts(pieces))
            self.proven = self._prove(pieces)
            self.known = dict.fromkeys(self.proven, 1)

    def _encoded(self, pre_tokens: list[str]) -> list[int]:
        """Tokens of pre-tokens as they come out inside a text. The library puts a space before a text: that is
        the pre-token's own if it has one, or else stands apart behind a character that never merges."""
        asked = [p[1:] if p[0] == SPACE else self.lone + p for p in pre_tokens]
        less = [0 if p[0] == SPACE else self.alone for p in pre_tokens]
        # A lone space would be an empty text, which has no token at all.
        return [1 if p == SPACE else len(ids) - b for p, ids, b in zip(pre_tokens, self.library.encode(asked, num_threads=1), less, strict=True)]

    def _lone(self, pieces: list[str]) -> str | None:
        """A character that is in no piece of two or more."""
        used = {c for p in pieces if len(p) > 1 for c in p}
        found = next((c for c in map(chr, range(10, 128)) if c not in used), None)
        if found is not None:
            self.alone = len(self.library.encode(found))
        return found

    def _plain(self, pieces: list[str]) -> bool:
        """Whether texts are encoded as they are, a space before them, and spaces lead the pieces they are in."""
        spaced = " a  b "
        if "".join(self.library.encode(spaced, out_type=str)) != SPACE + spaced.replace(" ", SPACE):
            return False
        if any(self.library.decode(self.library.encode(text)) != text for text in ("Åﬁ①Ａ", "a" + self.lone + "b")):
            return False
        return not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def _cuts(self, pieces: list[str]) -> str:
        """The pattern of pre-tokens: spaces, then a run of characters of one class."""
        parent: dict[str, str] = {}

        def top(c: str) -> str:
            while parent.setdefault(c, c) != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for p in pieces:
            run = p.lstrip(SPACE)
            for a, b in zip(run, run[1:], strict=False):
                parent[top(a)] = top(b)
        classes: dict[str, list[str]] = {}
        for c in parent:
            classes.setdefault(top(c), []).append(c)
        runs = ["[" + "".join(map(re.escape, sorted(cs))) + "]+" for cs in sorted(classes.values(), key=len, reverse=True)]
        return f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+"

    def _prove(self, pieces: list[str]) -> set[str]:
        """The pieces that are pre-tokens and encode as themselves alone."""
        whole = [p for p in pieces if self.pattern.fullmatch(p)]
        return {p for p, n in zip(whole, self._encoded(whole), strict=True) if n == 1}

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.exact:
            return [len(ids) for ids in self.library.encode([t or "" for t in texts], num_threads=1)]
        split, known = self.pattern.findall, self.known
        found = [split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        rest = {p for p in chain.from_iterable(found) if p not in known}
        if len(known) + len(rest) > len(self.proven) + self.memo:  # begin anew, with what these texts ask for
            known = self.known = dict.fromkeys(self.proven, 1)
            rest = {p for p in chain.from_iterable(found) if p not in known}
        self.merged += len(rest)
        if rest:
            known = self._learn(list(rest))
        self.looked_up += sum(map(len, found))
        return [sum(map(known.__getitem__, f)) for f in found]

    def _learn(self, rest: list[str]) -> dict[str, int]:
        """What is known with ``rest``; short ones stay known for later batches, unless they are too many."""
        numbers = dict(zip(rest, self._encoded(rest), strict=True))
        if len(rest) > self.memo:
            return self.known | numbers
        long = {p: n for p, n in numbers.items() if len(p) > SHORT}
        self.known.update((p, n) for p, n in numbers.items() if len(p) <= SHORT)
        return self.known | long if long else self.known


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row."""

    def make():
        counter = Counter(vocabulary)

        def each(texts, sizes):
            tokens = np.array(counter.counts(texts), np.int64)
            return [range(len(texts)), sizes, tokens, tokens > limit]

        return each

    rows = documents.select(F.col(key), F.col(text), F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return map_lists(rows, make, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, keep=key)
