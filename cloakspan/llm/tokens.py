"""Token ids of whole texts, by a `tokenizers` file, with what a word gives remembered from text to text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: So many words, and parts of words, a worker remembers twice: those met lately, and those met before them.
REMEMBERED = 200_000
#: Longer words are remembered only for the texts at hand.
LONGEST = 64
#: Characters of text whose words are looked up at once, unless one text alone has more.
AT_ONCE = 2 << 20
#: Words of these characters alone are unchanged by NFC and are lower-cased letter by letter, so they can be split here.
_PLAIN_TEXT = re.compile("[\t-\r -~¡-¬®-ÿ]*")
_SPECIAL = "<|"


class PairMerges:
    """Byte-pair merges of many short words at once.

    In each round every word merges its pair of least rank, the leftmost of equal ones, until none has a pair left.
    """

    def __init__(self, vocab: dict[str, int], merges: list, letters: list[str], end: str) -> None:
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (b >= 0), self.ranks[at], len(self.keys)).astype(np.int32)

    def ids(self, words: bytes, size: int) -> list[bytes]:
        """For words of `size` bytes, one after the other, the ids of each as unsigned 32-bit numbers."""
        raw = np.frombuffer(words, np.uint8).reshape(-1, size)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        rows = np.arange(len(raw))
        # own: the words that may still have a pair, with a column of -1 behind; ranks: of each of their pairs.
        own, left = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), rows
        ranks = np.pad(self._rank(ids[:, :-1], ids[:, 1:]), ((0, 0), (0, 2)), constant_values=len(self.keys))
        for width in range(size, 1, -1):
            k = ranks[:, :width].argmin(1)
            rank = ranks[rows[: len(left)], k]
            some = np.flatnonzero(rank < len(self.keys))
            left, k, rank, own, ranks = left[some], k[some], rank[some], own[some], ranks[some]
            if not len(left):
                break
            # What is behind the pair moves up by one.
            r, behind = rows[: len(left)], np.arange(width)[None, :] > k[:, None]
            own[:, :width] = np.where(behind, own[:, 1 : width + 1], own[:, :width])
            ranks[:, :width] = np.where(behind, ranks[:, 1 : width + 1], ranks[:, :width])
            made = self.made[rank]
            own[r, k] = made
            ranks[r, k] = self._rank(made, own[r, k + 1])
            ranks[r, k - 1] = np.where(k > 0, self._rank(own[r, k - 1], made), ranks[r, k - 1])
            ids[left] = own[:, :size]
        sizes = np.concatenate([[0], np.cumsum((ids >= 0).sum(1))]) * 4
        flat = ids[ids >= 0].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]


class _Memory:
    """Results by word: those met lately, and those met before, which go when the late ones take their place."""

    def __init__(self) -> None:
        self.late: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def unknown(self, words: Iterable[str]) -> set[str]:
        """Those of the words that aren't remembered; the others are among the late ones afterwards."""
        out = set(words).difference(self.late)
        new = out.difference(self.before)
        back = out.difference(new)
        self.late.update(zip(back, map(self.before.__getitem__, back), strict=True))
        return new

    def forget(self) -> None:
        if len(self.late) >= REMEMBERED:
            for w in [w for w in self.late if len(w) > LONGEST]:
                del self.late[w]
            self.late, self.before = {}, self.late


class WordEncoder:
    """all_ids(texts) equals Tokenizer.encode(text, add_special_tokens=False).ids of each, as little-endian unsigned 32-bit bytes.

    For tokenizers that lower-case, drop white space and never join what ASCII white space parts. Words of plain
    characters are merged here or by the file's BPE model, others go through the whole tokenizer, word by word.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed":
            raise ValueError(f"{path}: not a tokenizer that lower-cases and drops white space")
        # Of plain words, letters and numbers can be spelled out.
        pattern = split["pattern"]["Regex"]
        for kind in "LN":
            pattern = pattern.replace(rf"\p{{{kind}}}", "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind))
        self.cut = re.compile(pattern).findall
        # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for 256 and up, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = [chr(b) if b in shown else chr(next(rest)) for b in range(256)]
        model = spec["model"]
        self.merges = PairMerges(model["vocab"], model["merges"], self.letters, model["end_of_word_suffix"] or "")
        self.words, self.parts = _Memory(), _Memory()

    def _learn_parts(self, parts: Iterable[str]) -> None:
        late, by_size = self.parts.late, {}
        for part in parts:
            size = len(part) if part.isascii() else len(part.encode())
            if size in by_size:
                by_size[size].append(part)
            else:
                by_size[size] = [part]
        for size, same in by_size.items():
            if size <= 32:
                late.update(zip(same, self.merges.ids("".join(same).encode(), size), strict=True))
                continue
            for part in same:
                late[part] = np.array([x.id for x in self.tokenizer.model.tokenize("".join([self.letters[b] for b in part.encode()]))], "<u4").tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        """Words of other than plain characters, or with marks of special tokens."""
        for word in words:
            self.words.late[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _parted(self, text: str) -> list[str | tuple[str]]:
        """The parts of the text, and, each in a tuple, words that can't be cut here."""
        if _PLAIN_TEXT.fullmatch(text) and _SPECIAL not in text:
            return self.cut(text.lower())
        out: list = []
        for word in ascii_split(text):
            if _PLAIN_TEXT.fullmatch(word) and _SPECIAL not in word:
                out += self.cut(word.lower())
            else:
                out.append((word,))
        return out

    def all_ids(self, texts: list[str | None]) -> Iterator[bytes]:
        begin = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size < AT_ONCE and end < len(texts):
                continue
            cut = [self._parted(x or "") for x in texts[begin:end]]
            seen = set().union(*cut)
            if odd := [x for x in seen if type(x) is tuple]:
                self._learn(self.words.unknown([x[0] for x in odd]))
                seen.difference_update(odd)
            self._learn_parts(self.parts.unknown(seen))
            # The tuples, few, are looked up beside the parts and taken out again.
            known = self.parts.late
            known.update((x, self.words.late[x[0]]) for x in odd)
            for parts in cut:
                yield b"".join(map(known.__getitem__, parts))
            for x in odd:
                del known[x]
            self.words.forget()
            self.parts.forget()
            begin, size = end, 0

    def ids(self, text: str | None) -> bytes:
        return next(self.all_ids([text]))


#: White space beyond ASCII's six, as str.split() knows it.
_MORE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def ascii_split(text: str) -> list[str]:
    """The runs between ASCII white space (space and \\t to \\r)."""
    if _MORE_SPACE.search(text):
        return re.split("[ \t-\r]+", text.strip(" \t\n\x0b\x0c\r")) if text.strip(" \t\n\x0b\x0c\r") else []
    return text.split()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker and file."""
    return WordEncoder(path)
