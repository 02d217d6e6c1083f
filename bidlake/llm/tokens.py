"""Token ids of texts by a public tokenizer file, with a bounded memory of text pieces."""

from __future__ import annotations

import os
import re

import numpy as np

#: A space between, or after, other white space may belong to a longer token; the first pattern is a quick look.
_RUN, _UNSAFE = re.compile(r" (?:\s|\Z)"), re.compile(r"\s (?:\s|\Z)")
_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}
#: What an encoder's memory is bounded by unless said otherwise; see :class:`Encoder`.
MEMORY = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE ids of whole texts, equal to ``Tokenizer.encode``.

    A space always starts a new pre-token unless it stands between white space, so a text is cut
    before its spaces and pieces are remembered. Pieces not met before reach the library joined again, many at
    once, and the ids are dealt out by the bytes that each stands for. ``memory`` bounds what is remembered: seven tenths
    of it, half in ``known`` (pieces met lately) and half in ``tokens`` (those that filled ``known`` before). When
    ``known`` is full it takes the place of ``tokens``, and pieces that are met again return, so frequent ones stay. Texts
    that cannot be cut safely are encoded whole, as are those that hold the string of a special token. Such a string gives
    the token's id, as in a plain ``encode``; with ``special`` off it is ordinary text.
    """

    def __init__(self, path: str, special: bool = True, memory: int = MEMORY, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.tokenizer.model._resize_cache(0)  # pieces are remembered here; the library's own memory of 10,000 words costs a third of its time on new ones
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes that an id stands for: a byte is a letter of the vocabulary
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self.memory, self.longest, self.known, self.tokens = memory, longest, {}, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces after a space; none is empty or has white space at an end, so all can be cut apart again."""
        out = []
        for lo in range(0, len(pieces), 1000):
            own = pieces[lo : lo + 1000]
            data = self._encode([" " + " ".join(own)])[0]
            through = np.cumsum(self.sizes[np.frombuffer(data, "<u4")])
            ends = 4 * np.searchsorted(through, np.cumsum([len(p.encode()) + 1 for p in own]), side="right")
            out += [data[at:end] for at, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text; null is empty."""
        texts = [t or "" for t in texts]
        out: list[bytes] = [b""] * len(texts)
        cut, whole = [], []
        for i, text in enumerate(texts):
            if text:
                (whole if self.added(text) or _RUN.search(text) and _UNSAFE.search(text) else cut).append(i)
        # A piece without its space is a text's beginning; the others get their space back below.
        pieces = [texts[i].split(" ") for i in cut]
        begin = [p.pop(0) for p in pieces]
        wanted = set().union(*pieces)
        fresh = wanted.difference(self.known)
        if len(self.known) + len(fresh) > 0.35 * self.memory:
            self.tokens, self.known, fresh = self.known, {}, wanted
        again = self.tokens.keys() & fresh
        self.known.update((p, self.tokens[p]) for p in again)
        fresh -= again
        inner = [p for p in fresh if p and p == p.strip()]
        edge = list(fresh.difference(inner))
        data = self._encode([" " + p for p in edge] + begin + [texts[i] for i in whole])
        self.known.update(zip(inner, self._joined(inner), strict=True))
        self.known.update(zip(edge, data, strict=False))
        ids = self.known.__getitem__
        for i, first, rest in zip(cut, data[len(edge) :], pieces, strict=False):
            out[i] = first + b"".join(map(ids, rest))
        for p in fresh:
            if len(p) > self.longest:
                del self.known[p]
        for i, own in zip(whole, data[len(edge) + len(begin) :], strict=True):
            out[i] = own
        return [np.frombuffer(x, "<u4") for x in out]


def encoder(path: str, special: bool = True, memory: int = MEMORY) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if (path, special, memory) not in _ENCODERS:
        _ENCODERS[path, special, memory] = Encoder(path, special, memory)
    return _ENCODERS[path, special, memory]


def forget() -> None:
    """Gives back the memory that encoders of this worker took for an earlier stage; they fill it again when used."""
    for held in _ENCODERS.values():
        held.known.clear()
        held.tokens.clear()
