"""Exact token ids from pieces: texts are cut where no pre-token crosses, and each distinct word is encoded once.

A cut lies before a space or line feed whose predecessor is surely no white
space.  There both tokenizers start a new pre-token (white space belongs to the
token after it or to none, normalisation never joins a character to a space or
line feed, and no added token holds white space), so the ids of a text are those
of its pieces in order.

Plain pieces (at most one space or line feed, Latin letters, then punctuation)
are pre-tokens by sight; the distinct ones of a step go through the vocabulary
file's merge table together, as arrays.  All other pieces go to the tokenizers
library.  Each step also encodes some of the plain words with the library and
stops if the ids differ.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Odd pieces that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 100_000
#: Words longer than this go to the library.
LONGEST = 40
#: Words of each step that the library encodes too, to compare.
COMPARED = 32

LETTER, MARK, OTHER = 1, 2, 0


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def classes(data: np.ndarray) -> np.ndarray:
    """LETTER, MARK (ASCII punctuation but the apostrophe) or OTHER for each byte of UTF-8 ``data``."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(33, 127):
        table[b] = LETTER if chr(b).isalpha() else OTHER if chr(b).isdigit() or b == 39 else MARK
    kind = table[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # all of U+00C0..U+00FF but the two signs
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    return kind


def cut_points(data: np.ndarray) -> np.ndarray:
    """Offsets in UTF-8 ``data`` before which it may be cut."""
    if len(data) < 2:
        return np.empty(0, dtype=np.int64)
    here = np.flatnonzero((data == 32) | (data == 10))
    here = here[here > 0]
    before = data[here - 1]
    wide = before >= 0x80
    good = (before > 0x20) & (before != 0x7F) & ~wide
    at = here[wide]
    if len(at):
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        space = ((two == 0xC2) & ((data[at - 1] == 0x85) | (data[at - 1] == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3))
        good[wide] = ~space
    return here[good]


def gather(pool: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches ``pool[first : first + lens]``, one after the other."""
    ends = np.cumsum(lens)
    take = np.repeat(first - (ends - lens), lens)
    take += np.arange(len(take), dtype=take.dtype)
    return pool[take]


class Merges:
    """A BPE merge table in arrays: pair of ids to rank and joined id."""

    EMPTY = -1

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        rank: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            if a in vocab and b in vocab and a + b in vocab:
                rank.setdefault(vocab[a] << 17 | vocab[b], (r, vocab[a + b]))
        self.shift = np.uint64(64 - 19)
        self.keys = np.full((1 << 19) + 64, self.EMPTY, dtype=np.int64)
        self.rank = np.full(len(self.keys), 1 << 30, dtype=np.int32)
        self.made = np.zeros(len(self.keys), dtype=np.int32)
        slots = self._slot(np.array(list(rank), dtype=np.int64)).tolist()
        for (key, (r, made)), at in zip(rank.items(), slots):
            while self.keys[at] != self.EMPTY:
                at += 1
            self.keys[at], self.rank[at], self.made[at] = key, r, made

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the table; a place with the highest rank where there is none."""
        at = self._slot(keys)
        held = self.keys[at]
        open_ = np.flatnonzero((held != keys) & (held != self.EMPTY))
        while len(open_):
            at[open_] += 1
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != self.EMPTY)]
        return at

    def apply(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of symbol ids (n x width, padded with -1) until no pair is left, lowest rank and leftmost first."""
        symbols, lens = symbols.copy(), lens.copy()
        rows, now = np.arange(len(symbols)), symbols
        while len(rows):
            now = now[:, : int(lens[rows].max())]
            if now.shape[1] < 2:
                break
            left, right = now[:, :-1].astype(np.int64), now[:, 1:]
            keys = np.where(right >= 0, left << 17 | right, -2)
            at = self.find(keys.ravel()).reshape(keys.shape)
            ranks = np.where(keys >= 0, self.rank[at], 1 << 30)
            best = ranks.argmin(1)
            line = np.arange(len(rows))
            going = ranks[line, best] < 1 << 30
            done = ~going
            symbols[rows[done], : now.shape[1]] = now[done]
            rows, now, best, at = rows[going], now[going], best[going], at[going]
            if not len(rows):
                break
            line = line[: len(rows)]
            column = np.arange(now.shape[1] - 1)
            made = self.made[at[line, best]]
            now = np.where(column[None, :] <= best[:, None], now[:, :-1], now[:, 1:])
            now[line, best] = made
            lens[rows] -= 1
        symbols[rows, : now.shape[1]] = now
        return symbols, lens


class PieceEncoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(self.suffix)  # that vocabulary lower-cases, drops white space and marks word ends
        self.merges = Merges(vocab, model["merges"])
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letters[b] + self.suffix] for b in range(256)], dtype=np.int32)
        self.odd: dict[str, list[int]] = {}
        self.steps = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(texts), 1000):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _odd(self, pieces: list[str]) -> list[list[int]]:
        new = [p for p in pieces if p not in self.odd]
        made = dict(zip(new, self._library(new)))
        out = [made[p] if p in made else self.odd[p] for p in pieces]
        if len(self.odd) + len(made) > REMEMBERED:
            self.odd = {}
        if len(made) <= REMEMBERED:
            self.odd |= made
        return out

    def _words(self, data: np.ndarray, first: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (bytes ``data[first : first + lens]``, each at most LONGEST): pool and lengths."""
        ids = np.empty(0, dtype=np.int32)
        out, counts = [], np.zeros(len(lens), dtype=np.int64)
        order = np.argsort(lens, kind="stable")
        sizes = lens[order]
        edges = np.searchsorted(sizes, [0, 5, 7, 9, 11, 13, 16, 20, 26, LONGEST + 1])
        where = np.zeros(len(lens), dtype=np.int64)
        total = 0
        for a, b in zip(edges[:-1], edges[1:]):
            for c in range(a, b, 1 << 15):
                part = order[c : min(b, c + (1 << 15))]
                width = int(lens[part].max())
                column = np.arange(width)
                inside = column[None, :] < lens[part][:, None]
                raw = data[np.minimum(first[part][:, None] + column[None, :], len(data) - 1)]
                symbols = np.where(inside, self.inner[raw], -1)
                end = (np.arange(len(part)), lens[part] - 1)
                symbols[end] = self.last[raw[end]]
                merged, left = self.merges.apply(symbols, lens[part])
                out.append(merged[np.arange(merged.shape[1])[None, :] < left[:, None]])
                counts[part] = left
                where[part] = total + np.cumsum(left) - left
                total += int(left.sum())
        ids = np.concatenate(out) if out else ids
        return gather(ids, where, counts), counts

    def encode(self, data: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start and end (``len(offsets)`` places).

        ``offsets`` bound the texts in the UTF-8 ``data``.
        """
        texts = np.asarray(offsets, dtype=np.int64)
        if not len(data):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[cut_points(raw)] = True
        edge[texts] = True
        bounds = np.flatnonzero(edge)
        coded = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        pool, lens = self._pieces(coded.dictionary)
        first = np.cumsum(lens) - lens
        each = lens[which]
        ids = gather(pool, first[which], each)
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, ends[np.searchsorted(bounds, texts)]

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: pool and lengths."""
        n = len(pieces)
        _, offsets, buffer = pieces.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[pieces.offset : pieces.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffer, dtype=np.uint8)[: at[-1]]
        kind = classes(data)
        letters = np.concatenate([[0], np.cumsum(kind == LETTER)])
        marks = np.concatenate([[0], np.cumsum(kind == MARK)])
        start, end = at[:-1], at[1:]
        lead = data[np.minimum(start, len(data) - 1)]
        gap = ((lead == 32) | (lead == 10)) & (end > start)
        body = start + gap
        n_letters, n_marks = letters[end] - letters[body], marks[end] - marks[body]
        plain = (n_letters + n_marks == end - body) & (end > body) & (letters[body + n_letters] - letters[body] == n_letters) & (end - start <= LONGEST)
        odd = np.flatnonzero(~plain)
        odd_ids = self._odd([pieces[i].as_py() for i in odd.tolist()])
        middle = body + n_letters
        spaced = gap & (lead == 32) & (not self.lower)
        word_at = np.where(plain & (n_letters > 0), body - spaced, 0)
        word_len = np.where(plain & (n_letters > 0), middle - word_at, 0)
        mark_at = np.where(n_letters > 0, middle, body - spaced)
        mark_len = np.where(plain & (n_marks > 0), end - mark_at, 0)
        feed = plain & gap & (lead == 10) & (not self.lower)
        source = data
        if self.lower:
            upper = ((data >= 65) & (data <= 90)) | ((data >= 0x80) & (data <= 0x9E) & (np.concatenate([[0], data[:-1]]) == 0xC3))
            source = data + np.where(upper, np.uint8(32), np.uint8(0))
        # Distinct words and marks, each once.
        has_word, has_mark = np.flatnonzero(word_len), np.flatnonzero(mark_len)
        f = np.concatenate([word_at[has_word], mark_at[has_mark]])
        m = np.concatenate([word_len[has_word], mark_len[has_mark]])
        joined = np.ascontiguousarray(gather(source, f, m))
        bounds = np.concatenate([[0], np.cumsum(m)])
        coded = pa.StringArray.from_buffers(len(m), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined)).dictionary_encode()
        unit = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        if len(words):
            _, o, b = words.buffers()
            w = np.frombuffer(o, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            ids, counts = self._words(np.frombuffer(b, dtype=np.uint8), w[:-1], np.diff(w))
            self._compare(words, ids, counts)
        else:
            ids, counts = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        extra = ([] if self.lower else [[int(self.inner[10])]]) + odd_ids
        ids = np.concatenate([ids, np.array([i for x in extra for i in x], dtype=np.int32)])
        counts = np.concatenate([counts, np.array([len(x) for x in extra], dtype=np.int64)]).astype(np.int64)
        units = np.full((n, 4), -1, dtype=np.int64)
        units[feed, 0] = len(words)
        units[has_word, 1] = unit[: len(has_word)]
        units[has_mark, 2] = unit[len(has_word) :]
        units[odd, 3] = len(words) + (not self.lower) + np.arange(len(odd))
        sizes = np.where(units >= 0, counts[units], 0)
        flat = units.ravel()
        flat = flat[flat >= 0]
        return gather(ids, (np.cumsum(counts) - counts)[flat], counts[flat]), sizes.sum(1)

    def _compare(self, words: pa.StringArray, ids: np.ndarray, counts: np.ndarray) -> None:
        """The library's ids of a few words against ours."""
        self.steps += 1
        ends = np.cumsum(counts)
        picked = [(self.steps * 7919 + k * (len(words) // COMPARED + 1)) % len(words) for k in range(min(COMPARED, len(words)))]
        for i, want in zip(picked, self._library([words[i].as_py() for i in picked])):
            if want != ids[ends[i] - counts[i] : ends[i]].tolist():
                raise ValueError(f"the merge table and the library disagree on {words[i].as_py()!r}")
