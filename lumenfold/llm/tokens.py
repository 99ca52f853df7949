"""Exact encoding of whole texts by pieces: a text is cut where its tokenizer always cuts, and a piece is encoded once.

Both tokenizers used here work on pieces that never span certain white space, so the ids of a text are those of its
pieces in turn. Each worker keeps the ids of the pieces it has met in a bounded table; only new pieces reach the library.
"""

from __future__ import annotations

import functools
import os
import string

import numpy as np
import public_tokenizers
import regex

#: A space that doesn't open a new piece: followed by white space, or the last character.
_LOOSE_SPACE = regex.compile(r" (?:\s|\Z)")
_PIECE = regex.compile(public_tokenizers.PATTERN)
#: White space to str.split() but not to the tokenizers' patterns.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\s+")


def byte_level_parts(text: str) -> tuple[list[str], list[str]]:
    """(parts that stand as they are, then parts that follow one space each).

    In public_tokenizers.PATTERN a space followed by another character than white space always begins a match, so the
    text may be cut before each. Texts with other spaces are cut into the pattern's matches.
    """
    if not text:
        return [], []
    if _LOOSE_SPACE.search(text):
        return _PIECE.findall(text), []
    first, *rest = text.split(" ")
    return ([first] if first else []), rest


def word_parts(text: str) -> tuple[list[str], list[str]]:
    """Words between white space; the tokenizer drops the white space itself."""
    if _SEPARATORS.search(text):
        return [w for w in _SPACES.split(text) if w], []
    return text.split(), []


def at_line_break(part: str) -> tuple[str, str] | None:
    """What stands before and after a part's lone line break, all three of which are encoded alike alone; or None."""
    a, _, b = part.partition("\n")
    return (a, b) if a and b and not a[-1].isspace() and not b[0].isspace() else None


#: Parts of texts whose ids a worker keeps.
MOST = 800_000


class PieceEncoder:
    """Texts to the bytes of their ids (little-endian, 4 bytes each).

    A new part is put together from parts known already where that gives the same ids: a word and the marks after it,
    what stands around a line break, and (for tokenizers that take ASCII capitals for small letters) the small word.
    """

    def __init__(self, cut, encode, small: bool, breaks: bool, most: int = MOST, slice_chars: int = 500_000):
        """cut: text to (parts, parts after a space); encode: (parts, whether a space precedes) to a list of bytes;
        small, breaks: whether capitals count as small letters, and line breaks have ids; most: parts kept."""
        self.cut, self.encode, self.small, self.breaks, self.most, self.slice_chars = cut, encode, small, breaks, most, slice_chars
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _learn(self, spaced: bool, new: list[str]) -> None:
        """Puts parts without line breaks to themselves in the table."""
        table, marks, small = (self.spaced if spaced else self.bare), self.marks, self.small
        single: dict[str, None] = {}
        made: list[tuple[str, str, str]] = []
        tails: dict[str, None] = {}
        for part in new:
            word = part.rstrip(string.punctuation)
            tail = part[len(word) :]
            if tail and not (word and word[-1].isalnum()):
                word, tail = part, ""
            if small and word.isascii():
                word = word.lower()
            if word not in table:
                single[word] = None
            if tail and tail not in marks:
                tails[tail] = None
            made.append((part, word, tail))
        if tails:
            marks.update(zip(tails, self.encode(list(tails), False), strict=True))
        if single:
            table.update(zip(single, self.encode(list(single), spaced), strict=True))
        for part, word, tail in made:
            if tail:
                table[part] = table[word] + marks[tail]
            elif part is not word:
                table[part] = table[word]

    def _know(self, spaced: bool, lists: list[list[str]]) -> None:
        table = self.spaced if spaced else self.bare
        found: dict[str, None] = {}
        for own in lists:
            found.update(dict.fromkeys([x for x in own if x not in table]))
        if not found:
            return
        new = list(found)
        broken = [(x, ab) for x in new if "\n" in x and (ab := at_line_break(x))] if self.breaks else []
        if broken:
            gone = {x for x, _ in broken}
            heads = dict.fromkeys(a for _, (a, _) in broken if a not in table)
            new = list(dict.fromkeys([x for x in new if x not in gone]) | heads)
            self._learn(False, [x for x in dict.fromkeys(["\n", *(b for _, (_, b) in broken)]) if x not in self.bare])
        self._learn(spaced, new)
        for x, (a, b) in broken:
            table[x] = table[a] + self.bare["\n"] + self.bare[b]

    def _slice(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        bare, spaced = self.bare, self.spaced
        if len(bare) + len(spaced) + len(self.marks) > self.most:
            for table in (bare, spaced, self.marks):
                table.clear()
        self._know(False, [a for a, _ in cut])
        self._know(True, [b for _, b in cut])
        return [b"".join([bare[x] for x in a] + [spaced[x] for x in b]) for a, b in cut]

    def many(self, texts) -> list[bytes]:
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= self.slice_chars:
                out += self._slice(part)
                part, size = [], 0
        return out + self._slice(part) if part else out


@functools.lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # in a text their strings are ordinary text
    return tokenizer


#: Parts to a string that goes to the library; short strings are cheaper for it.
_TOGETHER = 200


@functools.lru_cache(maxsize=4)
def library_encoder(path: str, kind: str, most: int = MOST) -> PieceEncoder:
    """kind: "byte_level" or "word", as the file's pre-tokenizer is; one encoder a worker; most: parts it keeps.

    New parts go to the library many to a string, in which they are encoded as they would be alone. Where a part's ids
    begin is plain from the ids: in a byte-level file only the first token of a part begins with the space before it; in
    a word file a zero character, which no part then holds, stands between the parts.
    """
    tokenizer = library(path)

    def alone(parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def cut(strings: list[str], opens: np.ndarray, drop: int) -> list[bytes]:
        """Ids of the strings, cut at ids that open a part; drop: whether those ids themselves go (1) or stay (0)."""
        out: list[bytes] = []
        for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            raw, edges = ids.tobytes(), np.flatnonzero(opens[ids])
            starts = (4 * (edges + drop)).tolist()
            out += [raw[i:j] for i, j in zip(starts, [*(4 * edges[1:]).tolist(), len(raw)], strict=True)]
        return out

    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    if kind == "byte_level":
        opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how a space is written in the file

        def encode(parts: list[str], spaced: bool) -> list[bytes]:
            if not spaced:
                return alone(parts)
            return cut([" " + " ".join(parts[i : i + _TOGETHER]) for i in range(0, len(parts), _TOGETHER)], opens, 0)

        return PieceEncoder(byte_level_parts, encode, small=False, breaks=True, most=most)

    zero = tokenizer.encode("\0", add_special_tokens=False).ids
    opens[zero] = True

    def encode_words(parts: list[str], spaced: bool) -> list[bytes]:
        odd = [p for p in parts if "\0" in p]
        if odd or len(zero) != 1:
            known = dict(zip(odd, alone(odd), strict=True))
            plain = [p for p in parts if p not in known]
            known.update(zip(plain, encode_words(plain, spaced) if plain and len(zero) == 1 else alone(plain), strict=True))
            return [known[p] for p in parts]
        return cut(["\0 " + " \0 ".join(parts[i : i + _TOGETHER]) for i in range(0, len(parts), _TOGETHER)], opens, 1)

    return PieceEncoder(word_parts, encode_words, small=True, breaks=False, most=most)


def vocabulary_size(path: str) -> int:
    return library(path).get_vocab_size(with_added_tokens=True)
