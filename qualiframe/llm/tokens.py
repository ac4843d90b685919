"""Token ids of public vocabularies, fast enough for whole corpora."""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import regex

_SPLIT_DIFFERS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Letters and signs whose normal form and lower case are the same everywhere.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
#: Fixed value: how the vocabulary cuts text between white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Chunks that are encoded at once; the library's own results are large.
LEARNED = 8000
_END = b"\xff"  # no byte of UTF-8, so it can stand for the end of a word


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(merges: list[tuple[str, str]], suffix: str) -> dict[bytes, int] | None:
    """Ranks by token bytes for an encoder that looks only at what two neighbours make together.

    That encoder agrees with one that knows the merging pairs if every token, encoded alone, is made by
    its own pair: lower merges within a token then come out alike in any word that does not merge
    across its ends.  None if a token fails this.
    """
    letters = _byte_letters()

    def raw(token: str) -> bytes:
        end = token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + (_END if end else b"")

    pairs = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
    for a, b in pairs:
        whole = a + b
        parts = [whole[i : i + 1] for i in range(len(whole))]
        if whole.endswith(_END):
            parts[-2:] = [whole[-2:]]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: pairs.get((parts[i], parts[i + 1]), len(pairs)))
            if (parts[at], parts[at + 1]) not in pairs:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _END: 256 + b for b in range(255)}
    return ranks | {a + b: 512 + i for (a, b), i in pairs.items()}


class WordTokens:
    """Ids of a ``tokenizers`` file whose pieces never cross white space, by chunk and from memory.

    A chunk between white space has the same ids wherever it stands, so each is encoded once while it is
    remembered.  What is remembered is bounded: two sets of about ``remember`` chunks, of which the older
    is forgotten when the newer is full, but for what was used since.
    Chunks of plain letters are cut and merged by ranks (see ``merge_ranks``).  All others, and those
    that may hold a special token, go through the library whole, as do texts with the four separators
    on which the two notions of white space differ.
    """

    def __init__(self, path: str, remember: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model, self.known, self.older, self.remember = Tokenizer.from_file(path), {}, {}, remember
        self.cut, self.merge = regex.compile(PIECES).findall, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["merges"]]
        ranks = merge_ranks(merges, told["end_of_word_suffix"])
        if ranks:
            letter = {b: c for c, b in _byte_letters().items()}
            name = {t: "".join(letter[b] for b in t.removesuffix(_END)) + (told["end_of_word_suffix"] if t.endswith(_END) else "") for t in ranks if t != _END}
            self.ids = np.zeros(max(ranks.values()) + 1, "<u4")
            for t, n in name.items():
                self.ids[ranks[t]] = told["vocab"][n]
            self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        plain, other = [], []
        for c in chunks:
            (plain if self.merge and _PLAIN.fullmatch(c) and "<|" not in c else other).append(c)
        merge, cut = self.merge, self.cut
        ids, ends = [], []
        for c in plain:
            for piece in cut(c.lower()):
                ids += merge(piece.encode() + _END)
            ends.append(4 * len(ids))
        raw, at = self.ids[np.array(ids, np.int64)].tobytes() if ids else b"", 0
        for c, end in zip(plain, ends):
            self.known[c] = raw[at:end]
            at = end
        self.known.update(zip(other, self._whole(other)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        chunks = [x.split() for x in texts]
        used = set().union(*chunks)
        if len(self.known) > self.remember:
            self.older, self.known = self.known, {}
        new = used.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((c, self.older[c]) for c in again)
        new = list(new - again)
        for at in range(0, len(new), LEARNED):
            self._learn(new[at : at + LEARNED])
        known, out = self.known, []
        for text, row in zip(texts, chunks):
            if any(c in text for c in _SPLIT_DIFFERS):
                out.append(self._whole([text])[0])
            else:
                out.append(b"".join([known[c] for c in row]))
        return out


_WORDS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The encoder of a file, one for each worker process, so tasks share what it remembers."""
    if path not in _WORDS:
        _WORDS[path] = WordTokens(path)
    return _WORDS[path]


class ByteTokens:
    """Ids of a byte-level vocabulary given as ranks; special strings are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model, self.size = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_ordinary(text), "<u4")
