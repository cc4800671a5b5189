"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A pair merge at the end of what has been read can still change when more text arrives, but only
so far back: each step of such a change moves one token to the left and needs a merge of a later
rank than the step before. The longest such chain in the merge list is the *sufficient lookahead*.
A token that ends at least that many bytes before the end of the buffer is final, so the encoder
emits it, forgets it, and starts again at its right edge. Memory is one buffer, whatever the input.

Texts are normalised and cut into words by the tokenizer file's own normalizer and pre-tokenizer;
for the lower-casing word family and texts of plain Latin letters the same is done with string methods.
Words are encoded once and remembered in a memo of bounded size.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

# Plain words kept with their ids, other chunks and pieces kept with theirs, and the longest one kept.
MEMO_WORDS = 300_000
MEMO_PIECES = 50_000
MEMO_LENGTH = 64

# Ids that the decoder turns into text at a time.
DECODE_BLOCK = 1 << 16

# Characters for which composing and lower-casing are one to one and white space is plain.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ňŊ-ž]")

# Where a long text may be cut: added tokens hold no such blank.
_BLANK = re.compile("[ \n](?=[0-9A-Za-z])")

_NONE = 1 << 62

# Multiplier that spreads pair keys over the slots of a lookup table.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

# Characters of plain text encoded together; longer texts are cut at blanks.
BLOCK_CHARS = 1 << 19

# Classes of characters.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    letters |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Merges:
    """A merge list over ids: pair lookup, token lengths and the sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.table: dict[int, int] = {}
        pairs = []
        for rank, (a, b) in enumerate(merges):
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            self.table.setdefault(left << 20 | right, rank << 20 | new)
            pairs.append((left, right, new))
        self.length = {i: max(1, len(t.removesuffix(suffix) if suffix else t)) for t, i in vocab.items()}
        self.lookahead = self._sufficient_lookahead(pairs)
        self._slot_keys = None

    def _sufficient_lookahead(self, pairs: list[tuple[int, int, int]]) -> int:
        """Longest chain of merges of rising rank, each taking the token left of the one before.

        reach[t]: how far a change can still travel once token t may or may not be taken by a merge
        on its left that comes later than the ranks seen so far (ranks are walked downwards). The token
        may have grown to the right meanwhile, so a merge counts for every token that its right
        operand begins with.
        """
        begins: dict[int, int] = {}
        for left, _, new in pairs:
            begins.setdefault(new, left)
        reach: dict[int, int] = {}
        longest = 1
        for left, right, _ in reversed(pairs):
            far = self.length[left] + reach.get(left, 0)
            longest = max(longest, far)
            token: int | None = right
            while token is not None:
                if reach.get(token, 0) < far:
                    reach[token] = far
                token = begins.get(token)
        return longest

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the lowest-ranked pair, leftmost first, until none is left."""
        get = self.table.get
        pairs = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(pairs):
                pairs[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """Rank and new token of each pair key, _NONE for pairs that never merge."""
        slots = (keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self._slot_bits)
        slots = slots.astype(np.int64)
        there = self._slot_keys[slots]
        found = np.where(there == keys, self._slot_values[slots], _NONE)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & (len(self._slot_keys) - 1)
            there = self._slot_keys[slots[rest]]
            hit = there == keys[rest]
            found[rest[hit]] = self._slot_values[slots[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return found

    def _fill_slots(self) -> None:
        self._slot_bits = 19
        self._slot_keys = np.full(1 << self._slot_bits, -1, np.int64)
        self._slot_values = np.zeros(1 << self._slot_bits, np.int64)
        for key, value in self.table.items():
            slot = (key * int(_SPREAD) & 0xFFFFFFFFFFFFFFFF) >> (64 - self._slot_bits)
            while self._slot_keys[slot] >= 0:
                slot = (slot + 1) & (len(self._slot_keys) - 1)
            self._slot_keys[slot], self._slot_values[slot] = key, value

    def merge_all(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many words at once: ids of all words end to end, and symbols in each (at least one).

        Returns the tokens end to end and the number in each word.
        """
        if self._slot_keys is None:
            self._fill_slots()
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_word, done_ids = [], []
        while len(ids):
            rank = np.full(len(ids), _NONE, np.int64)
            rank[:-1] = self._look_up(ids[:-1] << 20 | ids[1:])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank[starts[1:] - 1] = _NONE
            best = np.minimum.reduceat(rank, starts)
            spread = np.repeat(best, np.diff(np.r_[starts, len(ids)]))
            live = spread != _NONE
            at = np.flatnonzero((rank == spread) & live)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]] if len(at) else at
            ids[at] = rank[at] & 0xFFFFF
            keep = live.copy()
            keep[at + 1] = False
            done_word.append(word[~live])
            done_ids.append(ids[~live])
            word, ids = word[keep], ids[keep]
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(sizes))

    def stream(self, symbols: Iterable[int], buffer: int = 256) -> Iterator[int]:
        """Tokens of a word of any length, emitted once stable; holds ``buffer`` + lookahead symbols."""
        held: list[int] = []
        full = buffer + 2 * self.lookahead
        for symbol in symbols:
            held.append(symbol)
            if len(held) >= full:
                end = 0
                for token in self.merge(held[:]):
                    if end + self.length[token] > len(held) - self.lookahead:
                        break
                    end += self.length[token]
                    yield token
                del held[:end]
                full = max(full, len(held) + buffer)
        yield from self.merge(held)


class Encoder:
    """Encodes whole texts as the tokenizer file says, without added special tokens.

    Ids come as little-endian unsigned 32-bit bytes. A null text counts as empty and has no ids.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path} holds no BPE model")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.merges = Merges(self.vocab, pairs, self.suffix)
        letters = byte_letters()
        self._inner = [self.vocab[c] for c in letters]
        self._final = [self.vocab[c + self.suffix] for c in letters]
        self._known = _KnownWords(self.merges, self._inner, self._final, self._bytes, memo_words)
        memo_pieces = min(memo_words, MEMO_PIECES)
        self._byte = {c: b for b, c in enumerate(letters)}
        tokenizer = Tokenizer.from_file(path)
        self._normalizer, self._splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens are supported as plain strings only")
        self._added = {c: i.to_bytes(4, "little") for c, i in added.items()}
        self._cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._pattern = self._word_pattern(spec)
        self._words = _Memo(self._chunk, memo_pieces)
        self._pieces = _Memo(self._piece, memo_pieces)
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}

    @staticmethod
    def _word_pattern(spec: dict) -> regex.Pattern | None:
        """The word pattern, if the file composes, folds white space and lower-cases: then words never cross it."""
        normal, cut = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        steps = [x.get("type") for x in normal.get("normalizers", [])]
        if steps == ["NFC", "Replace", "Lowercase"] and cut[0].get("type") == "Split" and cut[0]["behavior"] == "Removed" and cut[0]["invert"]:
            return regex.compile(cut[0]["pattern"]["Regex"])
        return None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        return b"".join(self._added.get(part) or self._plain(part) for part in self._cut.split(text) if part)

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """``encode`` of each text, plain texts together in blocks of bounded size."""
        block: list[str | None] = []
        held = 0
        for text in texts:
            if text and len(text) > BLOCK_CHARS:
                yield from self._block(block)
                block, held = [], 0
                yield b"".join(self.encode_parts(text))
                continue
            block.append(text)
            held += len(text or "")
            if held >= BLOCK_CHARS:
                yield from self._block(block)
                block, held = [], 0
        yield from self._block(block)

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """``encode`` of a text, a bounded part at a time; no word is cut, and none crosses a blank."""
        for part in self._cuts(text):
            yield from self._block([part])

    def _cuts(self, text: str) -> Iterator[str]:
        """The text in parts of about ``BLOCK_CHARS``, cut before a blank that an ASCII letter or digit follows."""
        if self._pattern is None:
            yield text  # words of this tokenizer may cross blanks
            return
        at = 0
        while len(text) - at > BLOCK_CHARS:
            end = _BLANK.search(text, at + BLOCK_CHARS)
            if end is None:
                break
            yield text[at : end.start()]
            at = end.start()
        yield text[at:]

    def _block(self, block: list[str | None]) -> Iterator[bytes]:
        plain = [
            self._pattern is not None and bool(t) and not (self._cut and self._cut.search(t)) and not _ODD.search(t)
            for t in block
        ]
        if not any(plain):
            yield from map(self.encode, block)
            return
        lowered = [t.lower().encode() for t, ok in zip(block, plain, strict=True) if ok]
        raw, ends = self._known.encode(lowered)
        found = zip([0, *ends], ends, strict=False)
        for text, ok in zip(block, plain, strict=True):
            if ok:
                start, end = next(found)
                yield raw[start:end]
            else:
                yield self.encode(text)

    def _plain(self, text: str) -> bytes:
        if self._pattern is not None:
            if not _ODD.search(text):
                return b"".join(map(self._words.__getitem__, text.lower().split()))
            words = self._normalizer.normalize_str(text).split(" ")
            return b"".join(map(self._words.__getitem__, filter(None, words)))
        if self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        return b"".join(self._pieces[piece] for piece, _ in self._splitter.pre_tokenize_str(text))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run of characters without white space."""
        if chunk.isascii() and chunk.isalpha():
            return self._bytes(chunk.encode())
        if _ODD.search(chunk):
            return b"".join(self._pieces[piece] for piece, _ in self._splitter.pre_tokenize_str(chunk))
        return b"".join(self._bytes(piece.encode()) for piece in self._pattern.findall(chunk))

    def _piece(self, piece: str) -> bytes:
        return self._bytes(bytes(self._byte[c] for c in piece))

    def _bytes(self, word: bytes) -> bytes:
        inner = self._inner
        if len(word) <= 2 * self.merges.lookahead:
            ids = [inner[b] for b in word]
            ids[-1] = self._final[word[-1]]
            ids = self.merges.merge(ids)
        else:
            last = len(word) - 1
            ids = self.merges.stream(self._final[b] if i == last else inner[b] for i, b in enumerate(word))
        return array("I", ids).tobytes()


class _KnownWords:
    """Encodes blocks of plain lower-case texts with array operations.

    Words of a block are found by character class and told apart by their bytes; each different one is looked up among
    the words met so far, and only new ones are merged. Words above ``MEMO_LENGTH`` are forgotten after their block, and
    all of them when there are more than ``most``.
    """

    def __init__(self, merges: Merges, inner: list[int], final: list[int], long_word, most: int):
        self._merges, self._long_word, self._most = merges, long_word, most
        self._inner, self._final = np.array(inner, np.int64), np.array(final, np.int64)
        self._one = np.full(256, _OTHER, np.uint8)
        self._one[[9, 10, 13, 32]] = _SPACE
        self._one[48:58] = _DIGIT
        self._one[97:123] = _LETTER
        self._one[0xC3:0xC6] = _LETTER
        self._after_c2 = np.full(256, _OTHER, np.uint8)
        self._after_c2[[0xAA, 0xB5, 0xBA]] = _LETTER  # feminine and masculine ordinal, micro
        self._after_c2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT  # superscripts and fractions
        self._forget()

    def _forget(self) -> None:
        self._at: dict[bytes, int] = {}
        self._starts, self._counts = _Numbers(), _Numbers()
        self._ids = _Numbers()

    def _words(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word: letters, one digit, other marks, or an apostrophe ending."""
        kind = self._one[text]
        lead = np.flatnonzero((text >= 0xC2) & (text <= 0xC5))
        tail = text[lead + 1]
        of = np.where(text[lead] == 0xC2, self._after_c2[tail], _LETTER).astype(np.uint8)
        of[(text[lead] == 0xC3) & ((tail == 0x97) | (tail == 0xB7))] = _OTHER  # times, divided by
        kind[lead] = kind[lead + 1] = of
        begins = np.empty(len(text), bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[lead + 1] = False
        self._endings(text, kind, begins)
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(text)]
        real = kind[starts] != _SPACE
        return starts[real], ends[real]

    @staticmethod
    def _endings(text: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> None:
        """Join an apostrophe that starts a word with the ending after it (s, t, m, d, re, ve, ll)."""
        at = np.flatnonzero((text[:-2] == 39) & begins[:-2] & (kind[1:-1] == _LETTER))
        if not len(at):
            return
        first, second = text[at + 1], text[at + 2]
        size = np.where(np.isin(first, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        two = (np.isin(first, np.frombuffer(b"rv", np.uint8)) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        size = np.where(two, 2, size)
        at, size = at[size > 0], size[size > 0]
        begins[at + 1] = False
        begins[at + 1 + size] = True

    def encode(self, texts: list[bytes]) -> tuple[bytes, list[int]]:
        """Ids of the texts end to end as bytes, and where each text's ids end."""
        joined = b"\n".join([*texts, b"\n\n"])
        text = np.frombuffer(joined, np.uint8)
        starts, ends = self._words(text)
        edges = np.cumsum([len(t) + 1 for t in texts])
        words_before = np.searchsorted(starts, edges, "left")
        if not len(starts):
            return b"", [0] * len(texts)
        at, which = self._find(text, starts, ends)
        counts, begins = self._counts.array()[at][which], self._starts.array()[at][which]
        stops = np.cumsum(counts)
        ids = self._ids.array()[np.repeat(begins - (stops - counts), counts) + np.arange(stops[-1])]
        if len(self._at) > self._most or len(self._ids.array()) > 8 * self._most:
            self._forget()
        sums = np.r_[0, stops]
        return ids.astype("<u4").tobytes(), (sums[words_before] * 4).tolist()

    def _find(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each different word among the known ones, new ones added, and which one each word is."""
        sizes = ends - starts
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        inside = np.zeros(len(text) + 1, np.int8)
        inside[starts] = 1
        inside[ends] -= 1
        data = text[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        get, least = self._at.get, len(self._counts.array())
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            first = np.zeros(len(words), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            ids, counts = self._merge(text, starts[first[new]], ends[first[new]])
            self._starts.add(len(self._ids.array()) + np.cumsum(counts) - counts)
            self._counts.add(counts)
            self._ids.add(ids)
            at[new] = least + np.arange(len(new))
            self._at.update((words[i], n) for n, i in enumerate(new.tolist(), least) if len(words[i]) <= MEMO_LENGTH)
        return at, which

    def _merge(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = ends - starts
        long = np.flatnonzero(sizes > 2 * self._merges.lookahead)
        sizes = np.where(sizes > 2 * self._merges.lookahead, 1, sizes)
        stops = np.cumsum(sizes)
        flat = text[np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1])]
        ids = self._inner[flat]
        ids[stops - 1] = self._final[flat[stops - 1]]
        ids, counts = self._merges.merge_all(ids, sizes)
        if len(long):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in long.tolist():
                parts[i] = np.frombuffer(self._long_word(text[starts[i] : ends[i]].tobytes()), "<u4").astype(np.int64)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, counts


class _Numbers:
    """An array of 32-bit numbers that grows at its end."""

    def __init__(self):
        self._held, self._size = np.zeros(1024, np.int32), 0

    def add(self, more: np.ndarray) -> None:
        size = self._size + len(more)
        if size > len(self._held):
            self._held = np.concatenate([self._held[: self._size], np.zeros(max(size, 2 * self._size) - self._size, np.int32)])
        self._held[self._size : size] = more
        self._size = size

    def array(self) -> np.ndarray:
        return self._held[: self._size]


class _Memo(dict):
    """Results by key; emptied when it holds too many, so its size is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, key):
        value = self._make(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= self._most:
                self.clear()
            self[key] = value
        return value


class Decoder:
    """Turns ids into text as they come; holds at most the bytes of one unfinished character.

    ``byte_level``: tokens spell bytes, which are joined and read as UTF-8, malformed bytes replaced.
    Otherwise (a tokenizer file without a decoder) tokens are joined with one space.
    """

    def __init__(self, texts: dict[int, str], byte_level: bool = False):
        self.byte_level, self._first = byte_level, True
        if byte_level:
            value = {c: b for b, c in enumerate(byte_letters())}
            self._of = {i: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for i, t in texts.items()}
        else:
            self._of = texts
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.byte_level:
            return self._state.decode(b"".join(map(self._of.__getitem__, ids)))
        text = " ".join(map(self._of.__getitem__, ids))
        if not self._first and text:
            text = " " + text
        self._first = self._first and not text
        return text

    def finish(self) -> str:
        self._first = True
        return self._state.decode(b"", True) if self.byte_level else ""


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode_column(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array column ``out`` of token ids; every other column stays as it is.

    A null or empty text gives an empty array; repeated rows each give one. ``out`` must be a new name.
    """
    if out in docs.columns:
        raise ValueError(f"the column {out} is there already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [array("I", raw).tolist() for raw in enc.encode_many(batch.column(text_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64()))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode_column(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with a text column ``out``: the ids read back by the streaming decoder. Null ids give an empty text."""
    if out in rows.columns:
        raise ValueError(f"the column {out} is there already")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(encoder(path).texts)
        for batch in batches:
            texts = [decoder.feed(ids or []) + decoder.finish() for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def _by_parts(enc: Encoder, texts: pa.Array) -> Iterator[Iterable[bytes]]:
    """The ids of each text, in one part; those of a long text in parts, made one at a time."""
    short: list[str | None] = []
    held = 0
    for text in texts:
        text = text.as_py()
        if text and len(text) > BLOCK_CHARS:
            yield from ([raw] for raw in enc.encode_many(short))
            short, held = [], 0
            yield enc.encode_parts(text)
            continue
        short.append(text)
        held += len(text or "")
        if held >= BLOCK_CHARS:
            yield from ([raw] for raw in enc.encode_many(short))
            short, held = [], 0
    yield from ([raw] for raw in enc.encode_many(short))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing; a null id stays null; every row gives one row.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        decoder = Decoder(enc.texts)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for parts in _by_parts(enc, batch.column("text")):
                size, ids, digest = 0, hashlib.sha256(), hashlib.sha256()
                for raw in parts:
                    size += len(raw) // 4
                    ids.update(raw)
                    for at in range(0, len(raw), 4 * DECODE_BLOCK):
                        digest.update(decoder.feed(array("I", raw[at : at + 4 * DECODE_BLOCK])).encode())
                digest.update(decoder.finish().encode())
                counts.append(size)
                coded.append(ids.hexdigest())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], names=names)

    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
