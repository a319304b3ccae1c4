"""Token ids of whole texts from public tokenizers, for operators 12 and 13.

A text is cut before each space that follows another character than a space and is followed by anything but white space. Neither a byte-level
tokenizer with the usual splitting pattern nor a piece tokenizer whose pieces hold the space mark only in front joins bytes across
such a cut, so the ids of a text are those of its stretches in a row. A worker has the library encode a stretch (mostly a word) once, and
a batch of texts is put together from the ids of its stretches with array operations. What this relies on is read from the vocabulary
files when they are opened; where it does not hold, and in texts with strings of special tokens that count as such, whole texts are encoded.

Memory: a worker keeps at most MAX_STRETCHES stretches and MAX_CHARS characters beside those of the batch in hand, then starts anew.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The mark that stands for a space in pieces; the splitting pattern of byte-level tokenizers, as their documentation gives it.
MARK = "▁"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_STRETCHES, MAX_CHARS = 300_000, 15_000_000
#: Rows that are not simply cut at each space: a space at either end or before white space.
_ODD = r"^ | $| [\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Letters that every version of Unicode classes alike; stretches with others are split by the tokenizer's own pattern.
_BEYOND = re.compile("[^\x00-ɏ]")
_POINTS = frozenset(",.;:!?")


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; a path of one's own is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def stretches(text: str) -> list[str]:
    """The parts of text between cuts, without the space before each but the first."""
    parts = text.split(" ")
    out, last = [parts[0]], parts[0]
    for part in parts[1:]:
        if part and last and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
        last = part
    return out


def byte_alphabet() -> dict[int, str]:
    """Byte to character of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


class ByteBpe:
    """A byte-level tokenizer file of the tokenizers library. plain_specials: strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain_specials: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        with open(public_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(public_path(path))
        self.library.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.cuts = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.alphabet, self.split = byte_alphabet(), regex.compile(PATTERN).findall
        back = {c: b for b, c in self.alphabet.items()}
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_of = [added.get(i) or bytes(back[c] for c in self.library.id_to_token(i)) for i in range(self.library.get_vocab_size())]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[Sequence[int]]:
        """Ids of each text. The merges of words are the library's; words are known from text to text."""
        if not self.cuts or any(s in t for s in self.specials for t in texts):
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > MAX_STRETCHES:
            self.known = {}
        known, merges, alphabet, out = self.known, self.library.model.tokenize, self.alphabet, []
        for t in texts:
            if _BEYOND.search(t):
                out.append(self.library.encode(t, add_special_tokens=False).ids)
                continue
            # most stretches are a space and letters, maybe with a mark behind: one word, or a word and the mark
            spaced = t[:1] == " "
            words = (t,) if spaced and t[1:].isalpha() else (t[:-1], t[-1]) if spaced and t[-1] in _POINTS and t[1:-1].isalpha() else self.split(t)
            ids: tuple[int, ...] = ()
            for word in words:
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple([x.id for x in merges(word.encode().decode("latin-1").translate(alphabet))])
                ids += own
            out.append(ids)
        return out


class PieceBpe:
    """A model file of the sentencepiece library; it puts a space before each text by itself, so texts are given without theirs."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=public_path(path))
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.specials: list[str] = []
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


class _Rows:
    """Rows of numbers end to end in one growing array."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes, self.used, self.n = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0, 0

    def add(self, rows: list[Sequence[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(rows) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + total] = np.fromiter((i for r in rows for i in r), np.int32, total)
        self.sizes[self.n : self.n + len(rows)] = sizes
        self.starts[self.n : self.n + len(rows)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + total, self.n + len(rows)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The given rows end to end, and the size of each."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], sizes


class _Index(dict):
    """Number of each stretch, in order of first sight. A stretch with a space before it is a string, one without a tuple."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Stretches:
    """Ids of texts in several tokenizers at once.

    lead: a space is put before each text. check: a stretch is valid only if each tokenizer's bytes are those of the stretch.
    """

    def __init__(self, tokenizers: list[ByteBpe | PieceBpe], lead: bool = False, check: bool = False) -> None:
        self.tokenizers, self.lead, self.check = tokenizers, lead, check
        self.cuts = all(t.cuts for t in tokenizers)
        self.specials = [s for t in tokenizers for s in t.specials]
        self._restart()

    def _restart(self) -> None:
        self.index, self.rows, self.valid, self.chars = _Index(), [_Rows() for _ in self.tokenizers], _Rows(), 0

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The stretches of each text."""
        if not self.cuts:
            return pa.array([[t] for t in texts.to_pylist()], pa.list_(pa.string()))
        odd = pc.match_substring_regex(texts, "|".join([_ODD, *map(re.escape, self.specials)]))
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        if len(plain) == len(texts):
            return plain
        other = [[t] if any(s in t for s in self.specials) else stretches(t) for t in texts.filter(odd).to_pylist()]
        odd = np.asarray(odd)
        place = np.empty(len(texts), np.int64)
        place[~odd], place[odd] = np.arange(len(plain)), len(plain) + np.arange(len(other))
        return pa.concat_arrays([plain, pa.array(other, plain.type)]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each tokenizer the ids of all texts (without nulls) end to end and their number a text; and whether each text is valid."""
        if len(self.index) > MAX_STRETCHES or self.chars > MAX_CHARS:
            self._restart()
        gc.disable()  # the many small objects made here hold no cycles, and looking for some costs more than the encoding
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        lists = self._cut(texts)
        bounds = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        own = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        rows = own[np.asarray(words.indices)] if len(words) else np.empty(0, np.int64)
        if not self.lead:
            firsts = words.take(pa.array(bounds[:-1])).to_pylist()
            rows[bounds[:-1]] = np.fromiter((self.index[(w,)] for w in firsts), np.int64, len(firsts))
        if self.index.new:
            new = [" " + k if isinstance(k, str) else k[0] for k in self.index.new]
            self.index.new = []
            self.chars += sum(map(len, new))
            good = [True] * len(new)
            for tokenizer, store in zip(self.tokenizers, self.rows):
                ids = tokenizer.encode(new)
                store.add(ids)
                if self.check:
                    names = tokenizer.bytes_of
                    good = [g and b"".join([names[i] for i in row]) == p.encode() for g, row, p in zip(good, ids, new)]
            self.valid.add([[int(g)] for g in good])
        per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        taken = [store.take(rows) for store in self.rows]
        return [(ids, per_text(n)) for ids, n in taken], per_text(1 - self.valid.flat[self.valid.starts[rows]]) == 0


_HELD: dict[tuple, Stretches] = {}


def for_worker(key: tuple, make: Callable[[], Stretches]) -> Stretches:
    """The encoder of that key, kept by a Python worker from task to task."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def text_parts(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in parts of at most `limit` bytes of text, or one longer row."""
    start, seen = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column("text")).fill_null(0).to_pylist()):
        if k > start and seen + n > limit:
            yield batch.slice(start, k - start)
            start, seen = k, 0
        seen += n
    if start < batch.num_rows:
        yield batch.slice(start)
