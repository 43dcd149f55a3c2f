"""Ids of whole texts by a public tokenizer, with a bounded cache of words in each Python worker.

The tokenizer splits at white space before it merges, so the ids of a text are the ids of its words in order. A batch of
texts is split and its words numbered by Arrow and numpy; only its distinct words meet Python. A worker keeps the ids of
the words it has seen, up to ``LIMIT``, and asks the tokenizer only for new ones. Words of letters are asked for many at
a time: the marks of word ends or starts in the vocabulary tell where each one's ids end.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries from which a worker's cache is emptied; bytes of texts that are split together.
LIMIT, TOGETHER = 700_000, 8 << 20
PUNCTUATION = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum())
#: Unicode's White_Space property, as the tokenizers' patterns understand white space.
SPACE = "\t-\r \x85\xa0  -     　"
SEGMENTS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: How white space beyond ASCII begins in UTF-8; other characters begin so as well.
WIDE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80")
#: Byte-level vocabularies write each byte as one character: printable ones as themselves, others from U+0100 on.
_printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: b if b in _printable else 0x100 + sum(x not in _printable for x in range(b)) for b in range(256)}
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


class Cache(dict):
    """A dict that empties itself when it is full."""

    def add(self, key, value):
        if len(self) >= LIMIT:
            self.clear()
        self[key] = value
        return value


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` with these starts and sizes one after another, and where each ends."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def spans(data: bytes, starts: np.ndarray) -> pa.Array:
    """The pieces of ``data`` that begin at ``starts``, each up to the next, without a copy."""
    ends = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


class _Encoder:
    """The ids of words are those of their core, the letters, and of the marks behind it, which no pattern takes together."""

    separator = prefix = ""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bounds = np.array([self.bound(str(self.tok.id_to_token(i) or "")) for i in range(self.size)])
        self.tokenize = self.tok.model.tokenize
        # Words of letters may go straight to the vocabulary's merges, if this gives what the whole tokenizer does.
        self.straight = all(self.spelled(x) == self.ask(x).tolist() for x in (self.separator.strip() + self.prefix + w for w in ("a", "thing", "zyxwvutsr", "é", "großmütig")))
        self.forget()

    def forget(self) -> None:
        """Empty the cache: ids of entry k are ids[start[k] : start[k] + size[k]]; size -1: no letters, see ``odd``."""
        self.known: dict[bytes, int] = {}
        self.odd: dict[bytes, int] = {}
        self.ids, self.held = np.zeros(1 << 20, self.kind), 0
        self.start, self.size_of, self.entries = np.zeros(1 << 19, np.int64), np.zeros(1 << 19, np.int64), 0

    def store(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Add entries with these ids; the number of the first."""
        n, m = self.held + len(ids), self.entries + len(sizes)
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(n, self.kind)])
        if m > len(self.start):
            self.start, self.size_of = (np.concatenate([x, np.zeros(m, np.int64)]) for x in (self.start, self.size_of))
        self.ids[self.held : n] = ids
        first, self.entries = self.entries, m
        self.size_of[first:m] = sizes
        self.start[first:m] = self.held + np.cumsum(sizes) - sizes
        self.held = n
        return first

    def ask(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def spelled(self, core: str) -> list[int]:
        """The ids of a word of letters by the merges alone."""
        text = core if core.isascii() and self.prefix == "" else core.encode().decode("latin-1").translate(BYTES)
        return [t.id for t in self.tokenize(text)]

    @staticmethod
    def plainest(core: str) -> bool:
        """The tokenizer changes nothing in this word of letters before it merges."""
        return True

    def learn(self, cores: list[bytes]) -> None:
        """Put new cores into the cache."""
        text = [c.decode() for c in cores]
        plain = list(map(self.letters, text))
        for c in (c for c, ok in zip(cores, plain, strict=True) if not ok and c):
            self.known[c] = self.store(np.zeros(0, self.kind), np.zeros(1, np.int64))
            self.size_of[self.known[c]] = -1
        names, text = ([x for x, ok in zip(some, plain, strict=True) if ok] for some in (cores, text))
        straight = [self.straight and self.plainest(t) for t in text]
        spelled = [self.spelled(t) for t, ok in zip(text, straight, strict=True) if ok]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        first = self.store(np.fromiter(itertools.chain.from_iterable(spelled), self.kind, int(sizes.sum())), sizes)
        self.known.update(zip((c for c, ok in zip(names, straight, strict=True) if ok), range(first, first + len(spelled)), strict=True))
        names, text = ([x for x, ok in zip(some, straight, strict=True) if not ok] for some in (names, text))
        for at in range(0, len(names), 2000):
            part = text[at : at + 2000]
            ids = self.ask(self.separator.join(part))
            cuts = self.cuts(ids)
            if len(cuts) != len(part) + 1:  # a word that is several to the tokenizer
                each = [self.ask(x) for x in part]
                ids, cuts = np.concatenate(each), np.cumsum([0, *map(len, each)])
            first = self.store(ids, np.diff(cuts))
            self.known.update(zip(names[at : at + 2000], range(first, first + len(part)), strict=True))

    def whole(self, word: bytes) -> int:
        """The entry of a text that is asked for as it is."""
        if (at := self.odd.get(word)) is None:
            ids = self.ask(word.decode())
            at = self.odd[word] = self.store(ids, np.array([len(ids)]))
        return at

    def entries_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each of distinct words (a binary array) the entry of its core and that of the marks behind it."""
        if len(self.known) + len(self.odd) >= LIMIT:
            self.forget()
        core = pc.utf8_rtrim(words.cast(pa.string()), characters=PUNCTUATION).cast(pa.binary())
        coded = core.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        empty = self.whole(b"")
        self.known.setdefault(b"", empty)
        found = list(map(self.known.get, distinct))
        if None in found:
            self.learn([c for c, k in zip(distinct, found, strict=True) if k is None])
            found = [self.known[c] for c in distinct]
        first = np.array(found, np.int64)[coded.indices.to_numpy()]
        second = np.full(len(words), empty)
        ends, data = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64), np.frombuffer(words.buffers()[2] or b"", np.uint8)
        size = np.diff(ends) - pc.binary_length(core).to_numpy().astype(np.int64)
        marked = np.flatnonzero(size)
        if len(marked):
            marks, cuts = gather(data, ends[1:][marked] - size[marked], size[marked])
            rests = spans(marks.tobytes(), np.concatenate([[0], cuts[:-1]])).dictionary_encode()
            second[marked] = np.array([self.whole(x) for x in rests.dictionary.to_pylist()], np.int64)[rests.indices.to_numpy()]
        other = np.flatnonzero(self.size_of[first] < 0)
        if len(other):
            first[other] = [self.whole(x) for x in words.take(pa.array(other)).to_pylist()]
            second[other] = empty
        return first, second

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (a binary array), each its own text, one after another, and where each one's ids end."""
        if not len(words):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        coded = words.dictionary_encode()
        both = np.stack(self.entries_of(coded.dictionary), 1)[coded.indices.to_numpy()].ravel()
        flat, ends = gather(self.ids, self.start[both], self.size_of[both])
        return flat, ends[1::2]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out, start, total = [], 0, 0
        for k, text in enumerate(texts):
            total += len(text)
            if total > TOGETHER or k == len(texts) - 1:
                out += self.joined(texts[start : k + 1])
                start, total = k + 1, 0
        return out

    def of(self, words: pa.Array, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of texts, given all their words and where each text's words end."""
        flat, stops = self.spell(words)
        cuts = np.concatenate([[0], stops])[ends].tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class WordEncoder(_Encoder):
    """For a vocabulary with word ends, lower case and white space dropped. Words are split at x20 and x09-x0D."""

    separator = " "

    @staticmethod
    def bound(piece: str) -> bool:
        return piece.endswith("</w>")

    def cuts(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(self.bounds[ids]) + 1])

    @staticmethod
    def letters(core: str) -> bool:
        """Letters only, also after the tokenizer's normal form and lower case."""
        return core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha())

    @staticmethod
    def plainest(core: str) -> bool:
        """In lower case, and composed: Latin letters only."""
        return core.isascii() and core.islower() or core <= "ɏ" and max(core) <= "ɏ" and core == core.lower()

    @staticmethod
    def lower(text: bytes) -> bytes:
        """ASCII letters in lower case where this cannot meet a combining mark or an added token."""
        return text.lower() if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text else text

    @classmethod
    def split(cls, text: bytes) -> list[bytes]:
        return cls.lower(text).split()

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of single words, each its own text."""
        flat, ends = self.spell(pa.array(words, pa.binary()))
        return np.split(flat, ends[:-1]) if words else []

    def joined(self, docs: list[bytes]) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pa.array([self.lower(d) for d in docs], pa.binary()).cast(pa.string()))
        # White space at either end leaves an empty word, which has no ids.
        return self.of(lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()[1:].astype(np.int64))


class ByteEncoder(_Encoder):
    """For a byte-level vocabulary that keeps white space: a text is split into runs of it and words with one space before."""

    prefix = " "

    def __init__(self, path: str):
        super().__init__(path)
        self.added = [str(x.content).encode() for x in self.tok.get_added_tokens_decoder().values()]

    @staticmethod
    def bound(piece: str) -> bool:
        return piece.startswith("Ġ")

    def cuts(self, ids: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(self.bounds[ids]), len(ids))

    @staticmethod
    def letters(core: str) -> bool:
        return core[:1] == " " and core[1:].isalpha()

    @staticmethod
    def segments(docs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The segments of texts whose white space is ASCII, and where each text's segments end.

        Of a run of white space before a word the last character stands apart: a space begins the word's segment, any
        other is a segment. A run at the end of a text stays whole.
        """
        data = b"".join(docs)
        c = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(d) for d in docs])
        if not len(c):
            return spans(data, np.zeros(0, np.int64)), ends
        space = _space[c]
        first, last = np.zeros(len(c) + 1, bool), np.zeros(len(c) + 1, bool)
        first[ends - [len(d) for d in docs]] = True
        last[ends - 1] = True  # of no text, if the first is empty: place -1, which is cut off
        first, last = first[:-1], last[:-1]
        before, after = np.concatenate([[False], space[:-1]]), np.concatenate([space[1:], [True]])
        blank = np.concatenate([[False], c[:-1] == 0x20])
        begin = first | (space & ~before) | (space & ~after & ~last) | (~space & before & ~blank)
        starts = np.flatnonzero(begin)
        return spans(data, starts), np.searchsorted(starts, ends)

    def joined(self, docs: list[bytes]) -> list[np.ndarray]:
        whole = [any(x in d for x in self.added) for d in docs]
        wide = [not w and WIDE.search(d) is not None for d, w in zip(docs, whole, strict=True)]
        plain = [k for k in range(len(docs)) if not whole[k] and not wide[k]]
        out: list = [None] * len(docs)
        for k, ids in zip(plain, self.of(*self.segments([docs[k] for k in plain])) if plain else [], strict=True):
            out[k] = ids
        for k, d in enumerate(docs):
            if whole[k]:
                out[k] = self.ask(d.decode())
            elif wide[k]:
                out[k] = self.spell(pa.array([x.encode() for x in SEGMENTS.findall(d.decode())], pa.binary()))[0]
        return out


_encoders: dict[tuple[str, str], object] = {}


def encoder(kind: str, path: str):
    """One for each Python worker and vocabulary file."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = {"word": WordEncoder, "byte": ByteEncoder}[kind](path)
    return _encoders[kind, path]
