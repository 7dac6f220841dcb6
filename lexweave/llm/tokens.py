"""Encoding whole texts with a public tokenizer, remembering the ids of words already seen.

A text is cut where the tokenizer's own pre-tokenizer always cuts (before a white-space character, or at one for
tokenizers that drop it), so that joining the ids of the pieces gives the ids of the whole text. A piece of plain letters
and closing symbols is two words to the pre-tokenizer; each distinct one goes to the library's model directly. Other
pieces, and texts in which cuts are not certain or that spell a special token, go through the whole tokenizer.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Unicode White_Space, which the tokenizers' regular expressions call \s. Fixed value.
WHITE = "\t-\r \x85\xa0  -     　"
#: Texts in which a cut before a single space or newline might not be a cut of a byte-level pre-tokenizer: white space
#: beside white space or at an end, and white space other than the two.
_ODD = f"[{WHITE.replace(' ', '', 1).replace('\t-\r', '\t\x0b-\r')}]|[ \n][ \n]|\\A[ \n]|[ \n]\\z"
_MARK = "\x01"
#: A newline or none, letters that stay single characters in every normal form, then ASCII symbols but no apostrophe
#: (which begins contractions). Pre-tokenizers take the letters as one word and the symbols as another.
_LETTERS, _SYMBOLS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = rf"\A(?P<head>\n?)(?P<stem>[{_LETTERS}]+)(?P<tail>[{_SYMBOLS}]*)\z"
#: Words that must come out alike through the model alone and through the whole tokenizer.
_PROBES = ("word", "Straße!", "NAÏVE,", "çà...", "a", "x)")


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_NAMES = _byte_names()


class PieceEncoder:
    """Encode texts as uint32 ids.

    ``keeps_space``: the tokenizer gives ids to white space (byte-level), else it drops it and lower-cases.
    ``remember``: how many words are kept from call to call; beyond it those go that were met in one call only since the
    last time, or all, if the others are more than half of it.
    """

    def __init__(self, path: str, keeps_space: bool, remember: int = 250_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.keeps_space, self.remember = keeps_space, remember
        self._forget()
        self.sep = f" {_MARK}" if keeps_space else f" {_MARK} "
        self.sep_ids = self.whole(self.sep).tolist()
        self.special = "(?i)" + "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.model, self.newline = self.tok.model, self.whole("\n")
        probes = [x for p in _PROBES for x in ((p, f"\n{p}") if keeps_space else (p,))]
        self.direct = True
        ids, at = self._pieces(pa.array(probes))
        self.direct = all(np.array_equal(ids[at[i] : at[i + 1]], self.whole(self._text(x))) for i, x in enumerate(probes))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a word's number
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # word k has ids[ends[k] : ends[k + 1]]
        self.met = np.zeros(1 << 14, bool)  # again, in a later call than the one that brought the word

    def _forget_rare(self) -> None:
        """Forget the words that were not met again."""
        kept = np.flatnonzero(self.met[: len(self.known)])
        words, ids, ends = list(self.known), self.ids, self.ends
        self._forget()
        if len(kept) <= self.remember // 2:
            flat, at = _gathered(ids, ends[kept], ends[kept + 1] - ends[kept])
            self._add([words[i] for i in kept.tolist()], flat, at[1:])

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Number further words; ends: where each one's ids end."""
        n, begin = len(self.known), int(self.ends[len(self.known)])
        while len(self.ids) < begin + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.ends) <= n + len(words):
            self.ends, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.ends, self.met))
        self.ids[begin : begin + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = begin + ends
        self.known.update(zip(words, range(n, n + len(words))))

    def _new_words(self, words: list[str]) -> None:
        """Learn words of the pre-tokenizer, by the model alone."""
        ids, ends, tokenize, space = [], [], self.model.tokenize, _NAMES[32]
        for word in words:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_NAMES)
            elif word[:1] == " ":
                word = space + word[1:]
            ids += [t.id for t in tokenize(word)]
            ends.append(len(ids))
        self._add(words, np.array(ids, np.uint32), np.array(ends, np.int64))

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word; new ones are learnt."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(numbers < 0)
        self.met[numbers[numbers >= 0]] = True
        numbers[new] = len(self.known) + np.arange(len(new))
        self._new_words([distinct[i] for i in new.tolist()])
        return numbers[coded.indices.to_numpy()]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the places where each begins."""
        n = len(pieces)
        found = pc.extract_regex(pieces, _PLAIN)
        plain = np.asarray(found.is_valid()) if self.direct else np.zeros(n, bool)
        own = found.filter(pa.array(plain))
        head, stem, tail = (pc.struct_field(own, k) for k in ("head", "stem", "tail"))
        if self.keeps_space:
            after_space = pc.equal(head, "")
            stem = pc.binary_join_element_wise(pc.if_else(after_space, " ", ""), stem, "")
        else:
            stem = pc.utf8_lower(stem)
        words = np.stack((self._numbers(stem), self._numbers(tail)), axis=1) if len(own) else np.zeros((0, 2), np.int64)
        rest = np.flatnonzero(~plain)
        others = self._learn(pieces.take(pa.array(rest)).to_pylist())
        # three parts a piece: a newline or an odd piece's ids, letters, symbols
        extra = np.concatenate((self.newline, *others)).astype(np.uint32)
        base, begin, size = int(self.ends[len(self.known)]), np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64)
        begin[plain, 1:], size[plain, 1:] = self.ends[words], self.ends[words + 1] - self.ends[words]
        begin[:, 0] = base
        if self.keeps_space:
            size[np.flatnonzero(plain)[~np.asarray(after_space)], 0] = len(self.newline)
        size[rest, 0] = [len(x) for x in others]
        begin[rest, 0] += len(self.newline) + np.cumsum(size[rest, 0]) - size[rest, 0]
        return _gathered(np.concatenate((self.ids[:base], extra)), begin.ravel(), size.ravel(), 3)

    def _learn(self, missing: list[str]) -> list[np.ndarray]:
        """Ids of other pieces, many of them in one call with a marker between."""
        into, mark, k = {"": np.zeros(0, np.uint32)}, self.sep_ids[-1], len(self.sep_ids) - 1
        into |= {key: self.whole(self._text(key)) for key in missing if _MARK in key}
        joined = [key for key in missing if key not in into]
        for at in range(0, len(joined), 256):
            part = joined[at : at + 256]
            ids = self.whole("".join(self._text(key) + self.sep for key in part))
            ends = np.flatnonzero(ids == mark)
            if len(ends) != len(part):  # the marker met something unforeseen: one by one
                into.update((key, self.whole(self._text(key))) for key in part)
                continue
            begin = 0
            for key, end in zip(part, ends.tolist()):
                into[key] = ids[begin : end - k]
                begin = end + 1
        return [into[key] for key in missing]

    def _text(self, key: str) -> str:
        return f" {key}" if self.keeps_space and key[0] != "\n" else key

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 places where each text begins. Null is empty."""
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, f"{self.special}|{_ODD}" if self.keeps_space else self.special).to_numpy(zero_copy_only=False), bool)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n" if self.keeps_space else " "), " ")
        at = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode() if at[-1] > at[0] else None
        at -= at[0]
        if coded is None:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if len(self.known) > self.remember:
            self._forget_rare()
        which, pieces = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        flat, places = self._pieces(pieces)
        whole = []  # texts and pieces that are encoded by themselves stand behind the pieces
        if self.keeps_space:  # the first piece of a text has no space before it
            heads = which[at[:-1]]
            first = {i: len(pieces) + k for k, i in enumerate(np.unique(heads).tolist())}
            whole += [self.whole(pieces[i].as_py()) for i in first]
            which[at[:-1]] = [first[i] for i in heads.tolist()]
        for i in np.flatnonzero(odd).tolist():
            which[at[i]] = len(pieces) + len(whole)
            whole.append(self.whole(texts[i].as_py()))
        sizes = np.concatenate((np.diff(places), np.array([len(x) for x in whole], np.int64)))
        ids, ends = _gathered(np.concatenate((flat, *whole)), (np.cumsum(sizes) - sizes)[which], sizes[which])
        return ids, ends[at]

    def encode_with_end(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with END_ID after each text."""
        ids, at = self.encode(texts)
        out = np.empty(len(ids) + len(texts), np.uint32)
        ends = at[1:] + np.arange(len(texts))
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep], out[ends] = ids, END_ID
        return out, at + np.arange(len(texts) + 1)


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, each: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """flat's stretches one after another, and where every `each`-th begins, with the end."""
    ends = np.concatenate(([0], np.cumsum(size)))
    shift = np.repeat(begin - ends[:-1], size)
    shift += np.arange(ends[-1])
    return flat[shift].astype(np.uint32, copy=False), ends[::each]


_ENCODERS: dict = {}


def encoder(path: str, keeps_space: bool, remember: int = 250_000) -> PieceEncoder:
    """One encoder for each worker process, kept from task to task."""
    key = (path, keeps_space, remember)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, keeps_space, remember)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
