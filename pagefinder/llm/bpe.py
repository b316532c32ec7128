"""Tokenizer use on executors: ids of whole texts, remembered word by word."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

from .common import caches

#: A worker forgets its words, and their pieces, beyond this many each; each table stays near 130 MB.
MOST_WORDS = 600_000
#: Words of these characters are cut here; NFC leaves them alone and lower() treats each by itself.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]*")
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The vocabulary's pre-tokenizer within those characters, for lower case; words are a line each.
ASCII_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|\n|[^a-z0-9\n]+")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|\n|[^{_LETTERS}{_NUMBERS}\n]+")
#: Stands between words' ids; it is found nowhere else, as each id has two zero bytes.
BETWEEN = b"\xff" * 4


class WordEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    The vocabulary's pre-tokenizer drops white space, never joins across it, and cuts words into
    pieces that are merged apart, so a text's ids are those of its words between blanks and
    newlines, and a word's ids those of its pieces, one after another.  Each distinct word is cut
    once and each distinct piece encoded once.  Words with other characters than Latin ones are encoded whole.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        self.most_words = most_words
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same merges (one copy in memory) for pieces already normalised and cut: only blanks separate.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"\n": BETWEEN}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, fresh: Iterable[str]) -> None:
        """Adds words to ``known``: all are cut at once, joined by newlines, which no word holds."""
        if len(self.pieces) > self.most_words:
            self.pieces = {"\n": BETWEEN}
        ascii_words, latin_words = [], []
        for w in fresh:
            if "<|" in w:
                self.known[w] = self.ids(w).tobytes()
            elif w.isascii() and w.isprintable():
                ascii_words.append(w)
            elif PLAIN.fullmatch(w):
                latin_words.append(w)
            else:
                self.known[w] = self.ids(w).tobytes()
        for some, pattern in ((ascii_words, ASCII_PIECE), (latin_words, PIECE)):
            if some:
                cut = pattern.findall("\n".join(some).lower())
                self._learn_pieces(list(set(cut).difference(self.pieces)))
                raw = b"".join(map(self.pieces.__getitem__, cut))
                self.known.update(zip(some, raw.split(BETWEEN), strict=True))

    def _learn_pieces(self, fresh: list[str]) -> None:
        """Encodes pieces many at a time, with blanks between; each ends with its one word-final token."""
        for at in range(0, len(fresh), 500):
            some = fresh[at : at + 500]
            ids = np.array(self.merger.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(some) or ends[-1] != 4 * len(ids):
                self.pieces.update((x, self.ids(x).tobytes()) for x in some)
                continue
            raw, begin = ids.tobytes(), 0
            for x, end in zip(some, ends.tolist(), strict=True):
                self.pieces[x], begin = raw[begin:end], end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        cut = [_folded(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.most_words:
            self.known = {"": b""}
        fresh = set().union(*cut).difference(self.known)
        if fresh:
            self.learn(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]


def _folded(text: str) -> str:
    """Lower case for Latin-1 texts, which saves words; the vocabulary ignores case, but not in its special tokens."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_encoders: dict[str, WordEncoder] = {}


def _forget() -> bool:
    some = any(len(e.known) > 1 for e in _encoders.values())
    for e in _encoders.values():
        e.known, e.pieces = {"": b""}, {"\n": BETWEEN}
    return some


caches["pieces"] = _forget


def encoder(path: str | None = None, most_words: int = MOST_WORDS) -> WordEncoder:
    """This worker's encoder for the vocabulary file (default: the public ``word_bpe_49k.json``).

    ``most_words`` trades time for memory; ids don't depend on it.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].most_words = most_words
    return _encoders[path]
