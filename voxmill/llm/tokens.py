"""Token ids of texts, with a bounded cache of words.

Both public vocabularies cut a text before each space that stands between two other characters, so the ids of a text
are those of its pieces in a row. The library (its model, for plain words) encodes a piece once, as long as it stays in the cache.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by one Python worker are twice as many at most (about 50 MB): a full half becomes the older one.
CACHE_WORDS = 120_000

#: White space that a byte-level vocabulary does not cut as it does one space between two words.
_ODD = "^ | $|  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: One word of Latin letters, then ASCII marks other than the apostrophe: two units for both vocabularies.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_LETTERS = "".join(c for c in map(chr, range(256)) if _PLAIN.fullmatch(c))
_MARKS = "".join(c for c in map(chr, range(128)) if _PLAIN.fullmatch("a" + c) and c not in _LETTERS)


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies (printable bytes for themselves)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _gathered(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes[i]`` entries of ``pool`` from ``begin[i]`` on, for each i, in a row."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])]


class Encoder:
    """Texts to ids. ``spaces``: the vocabulary encodes spaces (byte level).

    Arrow cuts texts and finds each slice's unique pieces; their ids stand one after the other in a pool, and ids of texts
    are gathered from it. Special tokens in a text get their ids, as the library gives them, or are plain text if not
    ``special``.
    """

    def __init__(self, path: str, spaces: bool, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.spaces, self.lead = spaces, " " if spaces else ""
        self.model = self.tokenizer.model
        self.shown = _byte_characters()
        self.line_end = self._unit("\n") if spaces else b""
        if spaces:
            vocab = self.tokenizer.get_vocab()
            self.spaced = np.zeros(max(vocab.values()) + 1, bool)
            self.spaced[[i for token, i in vocab.items() if self.shown[32] in token]] = True
        #: Ids of words and odd pieces as they stand after a space, of words at the starts of lines, and of marks; each as
        #: a newer and an older half.
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.bare: list[dict[str, bytes]] = [{}, {}] if spaces else self.words
        self.marks: list[dict[str, bytes]] = [{}, {}]

    def _unit(self, text: str) -> bytes:
        """Ids of one unit, which the vocabulary does not cut before its merges."""
        if not self.spaces:
            text = text.lower()
        if not (text.isascii() and text.isalpha()):
            text = text.encode().decode("latin-1").translate(self.shown)
        return array("I", [x.id for x in self.model.tokenize(text)]).tobytes()

    def _keep(self, word: str, ids: bytes) -> list[dict[str, bytes]]:
        if len(self.words[0]) >= CACHE_WORDS:
            self.words[:] = [{}, self.words[0]]
        self.words[0][word] = ids
        return self.words

    def _word(self, known: list[dict[str, bytes]], word: str, lead: str) -> bytes:
        new, old = known
        if (ids := new.get(word)) is None:
            if (ids := old.get(word)) is None:
                ids = self._unit(lead + word)
            if len(new) >= CACHE_WORDS:
                known[:] = [{}, new]
            known[0][word] = ids
        return ids

    def _plain(self, piece: str, known: list[dict[str, bytes]], lead: str) -> bytes | None:
        """Ids of a word with marks after it, or None for any other piece."""
        if not (m := _PLAIN.fullmatch(piece)):
            return None
        word, mark = m.groups()
        ids = self._word(known, word, lead)
        return ids + self._word(self.marks, mark, "") if mark else ids

    def _lines(self, piece: str) -> bytes | None:
        """Ids of plain words with line ends between them, or None for any other piece."""
        first, *rest = piece.split("\n")
        ids = [self._plain(first, self.words, self.lead), *(self._plain(x, self.bare, "") for x in rest)]
        return None if None in ids else self.line_end.join(ids)

    def _units(self, words: list[str]) -> list[bytes]:
        """Ids of each plain word. A byte-level vocabulary cuts before each space, so the library takes all of them as one text, in
        which only the first id of a word stands for a space."""
        if not self.spaces or not words:
            return [self._unit(x) for x in words]
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(words):
            return [self._unit(" " + x) for x in words]
        flat, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return [flat[a:b] for a, b in itertools.pairwise(at)]

    def _apart(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each). Arrow parts plain words from the marks after them, so that Python
        meets each word once, in lower case for a vocabulary without spaces, which has that alone."""
        words = pc.utf8_rtrim(pieces, _MARKS)
        plain = pc.match_substring_regex(words, f"^[{_LETTERS}]+$")
        marks = pc.if_else(plain, pc.utf8_ltrim(pieces, _LETTERS), "").dictionary_encode()
        words = pc.if_else(plain, words if self.spaces else pc.utf8_lower(words), pieces).dictionary_encode()
        found, fresh, other, (new, old) = [], [], [], self.words
        for word in (each := words.dictionary.to_pylist()):
            ids = new.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None and "\n" in word:
                    ids = self._lines(word)
                    new, old = self.words
                    if ids is None:
                        other.append(len(found))
                elif ids is None:
                    (fresh if _PLAIN.fullmatch(word) else other).append(len(found))
                else:
                    new, old = self._keep(word, ids)
            found.append(ids)
        for i, ids in zip(fresh, self._units([each[i] for i in fresh]), strict=True):
            found[i] = ids
            self._keep(each[i], ids)
        for i, ids in zip(other, self._whole([self.lead + each[i] for i in other]), strict=True):
            found[i] = ids
            if len(self.words[0]) < CACHE_WORDS and len(each[i]) < 50:
                self.words[0][each[i]] = ids
        place = np.stack([words.indices.to_numpy(), len(found) + marks.indices.to_numpy()], axis=1).ravel()
        found += [self._word(self.marks, x, "") if x else b"" for x in marks.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        return _gathered(np.frombuffer(b"".join(found), "<u4"), begin, sizes), sizes.reshape(-1, 2).sum(axis=1)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def flat(self, texts: pa.Array, led: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text). Null counts as the empty text. ``led``: each text is
        taken with a space before it (byte level only)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        if self.spaces:
            odd = pc.match_substring_regex(texts, "^\n|" + _ODD if led else _ODD)
            odd_texts = [_SAFE_CUT.split(" " + x if led else x) for x in texts.filter(odd).to_pylist()]
            texts, odd = pc.if_else(odd, "", texts), odd.to_numpy(zero_copy_only=False)
        else:  # a line end is white space like any other
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        first = np.cumsum(counts) - counts
        pieces = lists.flatten().dictionary_encode()
        place = pieces.indices.to_numpy()
        pool, sizes = self._apart(pieces.dictionary)
        begin, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        if self.spaces:  # the first piece of a text has no space before it; odd texts are encoded whole
            heads = pieces.take(pa.array(first)).to_pylist()
            first = first[odd] if led else first
            own = iter([] if led else self._whole([text for k, text in enumerate(heads) if not odd[k]]))
            rare = iter(b"".join(self._whole(x)) for x in odd_texts)
            whole = [next(rare) if k else next(own) for k in odd if k or not led]
            sizes[first] = np.fromiter(map(len, whole), np.int64, len(whole)) // 4
            begin[first] = len(pool) + np.cumsum(sizes[first]) - sizes[first]
            pool = np.concatenate([pool, np.frombuffer(b"".join(whole), "<u4")])
        return _gathered(pool, begin, sizes), np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, sizes = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - sizes, ends, strict=True)]


def with_ends(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text's ids."""
    out = np.full(len(ids) + len(sizes), end_id, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1


class PieceEncoder:
    """Texts to ids of a piece vocabulary that adds a space before each text.

    No piece has a space behind another character and none a line end, so the ids of a text are those of its words and lines in a
    row, and the library encodes a word once, as long as it stays in the cache.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.shown = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("\u2581" in p.lstrip("\u2581") or "\n" in p for p in self.shown):
            raise ValueError(f"{path}: its pieces run over words or lines")
        self.line_end = self._ids("\n")[4:]  # without the space
        self.words: list[dict[str, bytes]] = [{}, {}]

    def _ids(self, text: str) -> bytes:
        return array("I", self.model.encode(text)).tobytes()

    def _word(self, piece: str) -> bytes:
        new, old = self.words
        if (ids := new.get(piece)) is None:
            if (ids := old.get(piece)) is None:
                if "\n" in piece:  # what follows a line end has no space before it
                    first, *rest = piece.split("\n")
                    return self._word(first) + b"".join(self.line_end + self._line(x) for x in rest)
                ids = self._ids(piece) if piece else self._ids("\n")[:4]
            if len(piece) < 50:
                if len(new) >= CACHE_WORDS:
                    self.words[:] = [{}, new]
                self.words[0][piece] = ids
        return ids

    def _line(self, text: str) -> bytes:
        """Ids of a line's first word: they follow those of a line end."""
        if not text:
            return b""
        key = "\n" + text
        if (ids := self.words[0].get(key) or self.words[1].get(key)) is None:
            ids = self._ids(key)[4 + len(self.line_end) :]
            if len(text) < 50:
                if len(self.words[0]) >= CACHE_WORDS:
                    self.words[:] = [{}, self.words[0]]
                self.words[0][key] = ids
        return ids

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text). Null counts as the empty text."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, "^ | $|  | \n|\n |\u2581")
        cut = lambda text: [text] if "\u2581" in text else _SAFE_CUT.split(text)  # noqa: E731  that sign counts as a space
        odd_texts = [[self._ids(x[1:] if i else x) for i, x in enumerate(cut(text))] for text in texts.filter(odd).to_pylist()]
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        pieces = lists.flatten().dictionary_encode()
        known, place = [self._word(x) for x in pieces.dictionary.to_pylist()], pieces.indices.to_numpy()
        whole = [b"".join(x) for x in odd_texts]
        pool = np.frombuffer(b"".join(known + whole), "<u4")
        sizes = np.fromiter(map(len, known + whole), np.int64, len(known) + len(whole)) // 4
        first = np.cumsum(counts) - counts
        place = place.astype(np.int64)
        place[first[odd.to_numpy(zero_copy_only=False)]] = len(known) + np.arange(len(whole))
        begin, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        ends = np.cumsum(sizes)
        return pool[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])], np.add.reduceat(sizes, first)


_ENCODERS: dict[tuple, Encoder | PieceEncoder] = {}


def encoder(path: str, spaces: bool, special: bool = True) -> Encoder:
    """The worker's own encoder, kept for its next tasks."""
    if (path, spaces, special) not in _ENCODERS:
        _ENCODERS[path, spaces, special] = Encoder(path, spaces, special)
    return _ENCODERS[path, spaces, special]


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's own encoder of a piece vocabulary, kept for its next tasks."""
    if (path,) not in _ENCODERS:
        _ENCODERS[path,] = PieceEncoder(path)
    return _ENCODERS[path,]


def byte_table(encoder: Encoder) -> pa.Array:
    """The bytes that each id of a byte-level vocabulary stands for."""
    back = {c: b for b, c in encoder.shown.items()}
    vocab = encoder.tokenizer.get_vocab()
    found = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        found[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return pa.array(found, pa.large_binary())


def piece_table(encoder: PieceEncoder) -> pa.Array:
    """The bytes that each id of a piece vocabulary stands for: U+2581 is a space, <0xHH> a byte."""
    plain = (bytes([int(p[3:5], 16)]) if encoder.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(encoder.shown))
    return pa.array(list(plain), pa.large_binary())


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the files stay outside this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)
