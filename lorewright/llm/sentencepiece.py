"""SentencePiece (merge type) encoding and decoding, exactly, without merging.

A text is encoded left to right: at each position the longest vocabulary match
found by an Aho-Corasick automaton is tried, then the next shorter ones.  A
token may follow the previous one only if merging the two tokens' text gives
back exactly those two tokens; the answer for each pair is kept.  When no
token fits, the last one is taken back and its start position's bit in a
bitfield of failed ends is set, so no position fails twice.  The result equals
that of running all merges: a cut is in the merged text if and only if it is in
the merge of its two neighbours.

Characters that the vocabulary lacks become byte pieces.  Where no piece has a
word's last character behind the one before it (a comma after a letter), no
merge can join them, and it is encoded by itself.  No piece spans a
blank that follows another character, so the text is cut before blanks and
every distinct word of a batch is encoded once; Arrow then gathers the ids.

Defined results: null text gives null ids, null decoded text and a count of
null; the empty text gives no ids; repeated rows are each encoded; an empty
table gives an empty result; other columns, whatever their names, are ignored.
Decoding turns U+2581 into a blank (the format cannot tell them apart), so a
text holding it does not come back and has ``round_trip`` false.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._words import slices

#: The vocabulary; a path that every executor has.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, and pairs of tokens, that a worker keeps in each of two generations.
CACHE_WORDS, CACHE_PAIRS = 200_000, 300_000
SPACE = "▁"
_NORMAL, _BYTE = 1, 6
_NEVER = float("-inf")
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[i : i + size]
            i += size


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, model: str = MODEL):
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.bytes: list[bytes] = []
        for tag, value in _fields(Path(model).read_bytes()):
            if tag == 1:
                self._piece(dict(_fields(value)))
            elif tag == 2 and dict(_fields(value)).get(3) != 2:
                raise ValueError("not a merge-type model")
            elif tag == 3 and (norm := dict(_fields(value))) and (norm.get(2) or not norm.get(3, 1) or norm.get(4, 1)):
                raise ValueError("only identity normalisation with a leading blank and kept blanks is supported")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError("a piece spans words")
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._older_fits: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self.pieces = pa.array(self.bytes, pa.binary())
        self.pairs = {piece[k : k + 2] for piece in self.id for k in range(len(piece) - 1)}
        self._char = lru_cache(4096)(self._char)
        self._state = bytearray(len(self.bytes))  # of each piece: 0 unknown, 1 what its text merges to, 2 not

    def _piece(self, fields: dict) -> None:
        i, kind, text = len(self.bytes), fields.get(3, _NORMAL), fields[1].decode()
        if kind == _BYTE:
            value = int(text[3:5], 16)
            self.byte[value] = i
            self.bytes.append(bytes([value]))
        elif kind == _NORMAL:
            self.id[text] = i
            self.score[text] = float(np.frombuffer(fields[2], "<f4")[0])
            self.bytes.append(text.replace(SPACE, " ").encode())
        else:
            self.bytes.append(b"")

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first, leftmost on ties."""
        parts, get = list(text), self.score.get
        gain = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while gain:
            best = max(gain)
            if best == _NEVER:
                break
            k = gain.index(best)
            parts[k] += parts.pop(k + 1)
            del gain[k]
            if k:
                gain[k - 1] = get(parts[k - 1] + parts[k], _NEVER)
            if k < len(gain):
                gain[k] = get(parts[k] + parts[k + 1], _NEVER)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` stay two tokens when their text is merged."""
        both = left + right
        return both not in self.id and (len(both) == 2 or self.merge(both) == [left, right])

    def cut(self, word: str) -> list[int]:
        """The ids of a word's pieces by backtracking; -1 - code point for a character without a piece."""
        whole = self.id.get(word)
        if whole is not None and self._whole(whole, word):
            return [whole]
        n = len(word)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            # Ends grow, so each start gets its matches by growing size.
            matches[end - match[0] + 1].append(match)
        failed = bytearray(n // 8 + 1)  # bit p: no valid rest from position p
        ids: list[int] = []
        cuts = [0]
        todo = [matches[0].copy() if matches[0] and matches[0][0][0] == 1 else [(1, -1 - ord(word[0])), *matches[0]]]
        at = 0
        while at < n:
            options = todo[-1]
            while options:
                size, token = options.pop()
                end = at + size
                if end < n and failed[end >> 3] >> (end & 7) & 1:
                    continue
                if size > 2 and not self._whole(token, word[at:end]):
                    continue
                if ids and not self._follows(ids[-1], token, word, cuts[-2], at, end):
                    continue
                ids.append(token)
                cuts.append(end)
                at = end
                if at < n:
                    own = matches[at]
                    todo.append(own.copy() if own and own[0][0] == 1 else [(1, -1 - ord(word[at])), *own])
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                todo.pop()
                ids.pop()
                cuts.pop()
                at = cuts[-1]
        return ids

    def _follows(self, left: int, right: int, word: str, start: int, at: int, end: int) -> bool:
        """:meth:`fits` of ``word[start:at]`` and ``word[at:end]``, kept by their ids."""
        key = left << 32 ^ right
        fit = self._fits.get(key)
        if fit is None:
            fit = self._older_fits.get(key)
            if fit is None:
                fit = self.fits(word[start:at], word[at:end])
            if len(self._fits) >= CACHE_PAIRS:
                self._older_fits, self._fits = self._fits, {}
            self._fits[key] = fit
        return fit

    def _whole(self, token: int, text: str) -> bool:
        """Whether merging a piece's own text yields the piece."""
        state = self._state[token]
        if not state:
            state = self._state[token] = 1 if self.merge(text) == [text] else 2
        return state == 1

    def word_ids(self, word: str) -> bytes:
        """Ids of one word (blanks written as U+2581, and only in front) as 32-bit integers."""
        if "\n" in word:
            return self._char("\n").join(map(self._line, word.split("\n")))
        return self._line(word)

    def _line(self, word: str) -> bytes:
        """Ids of a word; last characters that no piece has behind the one before them are pieces of their own."""
        end, pairs = len(word), self.pairs
        while end > 1 and word[end - 2 : end] not in pairs:
            end -= 1
        ids = self._core(word[:end]) if end else b""
        return ids + b"".join(map(self._char, word[end:])) if end < len(word) else ids

    def _char(self, c: str) -> bytes:
        i = self.id.get(c)
        return np.array([self.byte[b] for b in c.encode("utf-8", "replace")] if i is None else [i], np.int32).tobytes()

    def _core(self, word: str) -> bytes:
        known = self._words.get(word)
        if known is not None:
            return known
        known = self._older.get(word)
        if known is None:
            ids: list[int] = []
            for i in self.cut(word):
                if i < 0:
                    ids.extend(self.byte[b] for b in chr(-1 - i).encode("utf-8", "replace"))
                else:
                    ids.append(i)
            known = np.array(ids, np.int32).tobytes()
        if len(word) <= 64:
            if len(self._words) >= CACHE_WORDS:
                self._older, self._words = self._words, {}
            self._words[word] = known  # one that comes again outlives the others
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.word_ids, _CHUNK.findall(whole))), np.int32).tolist()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of texts without nulls."""
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        encoded = split.flatten().dictionary_encode()
        words = encoded.dictionary.to_pylist()
        # A run of blanks, a blank at an end, or U+2581 itself: such a text is encoded by itself.
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        odd_word = np.fromiter((not w or SPACE in w for w in words), bool, len(words))
        odd = np.zeros(len(texts), bool)
        if len(codes):
            odd[np.repeat(np.arange(len(texts)), np.diff(offsets))[odd_word[codes]]] = True
        per_word = [b"" if o else self.word_ids(SPACE + w) for w, o in zip(words, odd_word)]
        sizes = np.fromiter(map(len, per_word), np.int64, len(per_word)) // 4
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(per_word), np.int32)))
        ids = table.take(pa.array(codes)).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[offsets]
        if not odd.any():
            return ends, ids
        rows = [np.array(self.encode(texts[i].as_py()), np.int32) if odd[i] else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
        return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)

    def decode_batch(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts of rows of ids; bytes that aren't UTF-8 become U+FFFD."""
        taken = self.pieces.take(pa.array(ids))
        ends = taken.buffers()[1]
        at = np.frombuffer(ends, np.int32, len(ids) + 1) if ends and len(ids) else np.zeros(1, np.int32)
        data = taken.buffers()[2] or pa.py_buffer(b"")
        bounds = at[offsets].astype(np.int32)
        joined = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(bounds), data])
        first = pc.binary_length(joined).to_numpy(zero_copy_only=False) > 0
        raw = np.frombuffer(data, np.uint8)
        blank = first.copy()
        blank[first] = raw[bounds[:-1][first]] == 32
        if blank.all() or (blank | ~first).all():
            # The leading blank that encoding added: skip one byte of every row.
            starts = bounds[:-1] + blank
            try:
                return _rows(raw, starts, bounds[1:]).cast(pa.string())
            except pa.ArrowInvalid:
                pass
        return pa.array([(b := x.as_py())[b[:1] == b" " :].decode("utf-8", "replace") for x in joined], pa.string())


def _rows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary rows ``raw[starts[i]:ends[i]]`` whose gaps are single bytes."""
    keep = np.ones(len(raw), bool)
    gap = np.concatenate([starts[:1], starts[1:]])
    keep[gap[gap > np.concatenate([[0], ends[:-1]])] - 1] = False
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(raw[keep].tobytes())])


_codecs: dict[str, Codec] = {}


def codec(model: str = MODEL) -> Codec:
    """The worker's codec of a vocabulary file, loaded once."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def encode_documents(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ``token_ids``, ``n_tokens`` and ``round_trip``: whether decoding gives back the text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for batch in slices(whole, text):
                column = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
                full = pc.fill_null(column, "")
                offsets, ids = c.encode_batch(full)
                null = pc.is_null(column)
                rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=null)
                same = pc.if_else(null, pa.scalar(None, pa.bool_()), pc.equal(c.decode_batch(offsets, ids), full))
                count = pc.if_else(null, pa.scalar(None, pa.int32()), pa.array(np.diff(offsets), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_column)), rows, count, same], names=[id_column, "token_ids", "n_tokens", "round_trip"])

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, token_ids array<int>, n_tokens int, round_trip boolean")


def decode_tokens(encoded: DataFrame, model: str = MODEL, id_column: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """id and the decoded ``text`` of rows of token ids (null ids give null)."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids))
            lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            flat = rows.flatten().to_numpy(zero_copy_only=False)
            texts = c.decode_batch(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), flat)
            texts = pc.if_else(pc.is_null(rows), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_column)), texts], names=[id_column, "text"])

    return encoded.select(id_column, ids).mapInArrow(run, f"`{id_column}` {kind}, text string")
