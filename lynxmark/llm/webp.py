"""Lossless WebP: a whole decoder of the VP8L format, and an encoder for byte payloads.

``decode_many`` reads any lossless files in step, one lane per image: prefix
codes, back-references, colour cache, meta prefix codes, and the predictor,
cross-colour, subtract-green and palette transforms.  ``encode_payloads`` writes
bytes as 64-pixel rows of R, G, B, with prefix codes, back-references, a colour
cache and a transform of each image's own; ``decode_payloads`` reads them, or
any other lossless files, by ``decode_many``.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Rows of one image; a longer payload continues in the next file of the same value.
ROWS = 64
LIMIT = 12  # bits of our longest code
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)  # fixed values of the format


class Bits:
    """Bits of a file, the lowest of each byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(8), at

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek(n)
        self.at += n
        if self.at > 8 * (len(self.data) - 8):
            raise ValueError("the file ends too early")
        return value


def canonical(lengths: list[int]) -> list[int]:
    """Code of each symbol as the stream has it: its first bit lowest."""
    code, out = 0, [0] * len(lengths)
    for n in range(1, 16):
        for symbol, have in enumerate(lengths):
            if have == n:
                out[symbol] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


class Prefix:
    """A prefix code: one look at 15 bits gives symbol and length."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) < 2:
            self.only = used[0] if used else 0
            return
        if sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.only = None
        self.width = max(lengths)
        self.table: list[tuple[int, int]] = [(0, 0)] * (1 << self.width)
        for symbol, code in enumerate(canonical(lengths)):
            if n := lengths[symbol]:
                for at in range(code, 1 << self.width, 1 << n):
                    self.table[at] = (symbol, n)

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.table[bits.peek(self.width)]
        bits.read(n)
        return symbol


def read_lengths(bits: Bits, alphabet: int) -> list[int]:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    first = [0] * 19
    for k in CODE_ORDER[: 4 + bits.read(4)]:
        first[k] = bits.read(3)
    code = Prefix(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = code.next(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
        else:
            value, n = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
            if at + n > alphabet:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = [value] * n
            at += n
    return lengths


def _neighbours() -> list[tuple[int, int]]:
    """Distance codes 1 to 120: places near the pixel, the nearest first."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


NEIGHBOURS = _neighbours()


def _long(bits: Bits, prefix: int) -> int:
    """Value of a length or distance prefix with its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _coded_image(bits: Bits, width: int, height: int, outer: bool) -> list[int]:
    """ARGB values of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, group_of, groups = 0, None, 1
    if outer and bits.read(1):
        block = bits.read(3) + 2
        group_of = [(p >> 8) & 0xFFFF for p in _coded_image(bits, -(-width >> block), -(-height >> block), False)]
        groups = max(group_of) + 1
    size = 280 + ((1 << cache_bits) if cache_bits else 0)
    codes = [[Prefix(read_lengths(bits, n)) for n in (size, 256, 256, 256, 40)] for _ in range(groups)]
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    total, across = width * height, -(-width >> block)
    code = codes[0]
    while len(out) < total:
        if group_of is not None:
            y, x = divmod(len(out), width)
            code = codes[group_of[(y >> block) * across + (x >> block)]]
        s = code[0].next(bits)
        done = len(out)
        if s < 256:
            red = code[1].next(bits)
            blue = code[2].next(bits)
            out.append(code[3].next(bits) << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _long(bits, s - 256)
            far = _long(bits, code[4].next(bits))
            if far > 120:
                far -= 120
            else:
                x, y = NEIGHBOURS[far - 1]
                far = max(1, x + y * width)
            if far > done or done + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-far])
        else:
            out.append(cache[s - 280])
        if cache_bits:
            for p in out[done:]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def _split(pixels: list[int], height: int, width: int) -> np.ndarray:
    return np.array(pixels, dtype="<u4").view(np.uint8).reshape(height, width, 4).copy()  # B, G, R, A


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, right, corner):
    """Prediction from the pixels at the left, above, above right and above left (arrays of 4 int)."""
    if mode in (0, 14, 15):
        return np.array([0, 0, 0, 255])
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    middle = _average(left, top)
    return np.clip(middle + np.fix((middle - corner) / 2).astype(int), 0, 255)


def _undo_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> None:
    height, width = image.shape[:2]
    flat = image.reshape(-1, 4).astype(int)
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if not at:
                guess = np.array([0, 0, 0, 255])
            elif y == 0:
                guess = flat[at - 1]
            elif x == 0:
                guess = flat[at - width]
            else:
                guess = _predict(int(modes[y >> bits, x >> bits, 1]) & 15, flat[at - 1], flat[at - width], flat[at - width + 1], flat[at - width - 1])
            flat[at] = (flat[at] + guess) & 255
    image[:] = flat.reshape(image.shape)


def _undo_colour(image: np.ndarray, blocks: np.ndarray, bits: int) -> None:
    height, width = image.shape[:2]
    signed = np.repeat(np.repeat(blocks, 1 << bits, 0), 1 << bits, 1)[:height, :width].view(np.int8).astype(int)
    green = image[..., 1].view(np.int8).astype(int)
    red = (image[..., 2] + (signed[..., 0] * green >> 5)) & 255
    blue = image[..., 0] + (signed[..., 1] * green >> 5) + (signed[..., 2] * red.astype(np.uint8).view(np.int8).astype(int) >> 5)
    image[..., 2], image[..., 0] = red, blue & 255


def _undo_palette(image: np.ndarray, colours: np.ndarray, pack: int, width: int) -> np.ndarray:
    green = image[..., 1]
    if pack:
        each = 8 >> pack
        shifts = np.arange(1 << pack, dtype=np.uint8) * each
        green = ((green[..., None] >> shifts) & ((1 << each) - 1)).reshape(len(image), -1)[:, :width]
    table = np.zeros((256, 4), dtype=np.uint8)
    table[: len(colours)] = colours
    return table[green]


def riff_files(data: bytes) -> list[bytes]:
    """The VP8L streams of the WebP files that follow one another in ``data``."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("no WebP file")
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        chunk = at + 12
        found = None
        while chunk + 8 <= end:
            n = struct.unpack_from("<I", data, chunk + 4)[0]
            if data[chunk : chunk + 4] == b"VP8L" and found is None:
                found = data[chunk + 8 : chunk + 8 + n]
            chunk += 8 + n + (n & 1)
        if found is None:
            raise ValueError("no lossless image in the file")
        out.append(found)
        at = end + (end - at & 1)
    return out


# --- Many images in step ---


def windows(data: np.ndarray) -> np.ndarray:
    """The 32 bits that begin at each byte."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.int64)
    n = len(data) + 4
    return padded[:n] | padded[1 : n + 1] << 8 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 24


class Lanes:
    """One place in the bits for each of many streams that lie in one buffer."""

    def __init__(self, window: np.ndarray, at: np.ndarray):
        self.window, self.at = window, at.astype(np.int64)

    def read(self, who: np.ndarray, bits) -> np.ndarray:
        """The next ``bits`` (at most 25; one number or one for each) of the lanes ``who``."""
        at = self.at[who]
        value = (self.window[at >> 3] >> (at & 7)) & ((1 << np.asarray(bits, dtype=np.int64)) - 1)
        self.at[who] = at + bits
        return value


REVERSED = np.array([int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)], dtype=np.int64)


def codebook(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lane, symbol, length and stream-order code of every used symbol, by lane, length and symbol.

    ``lengths`` is lanes x symbols.  A lane with one symbol has a code of no
    bits; one without any has symbol 0.
    """
    lane, symbol = np.nonzero(lengths)
    n = np.bincount(lane, minlength=len(lengths))
    bare = np.flatnonzero(n == 0)
    lane, symbol = np.concatenate([lane, bare]), np.concatenate([symbol, np.zeros(len(bare), dtype=symbol.dtype)])
    size = lengths[lane, symbol].astype(np.int64)
    size[n[lane] < 2] = 0
    order = np.argsort((lane * 16 + size) * lengths.shape[1] + symbol)
    lane, symbol, size = lane[order], symbol[order], size[order]
    span = np.left_shift(1, 15 - size)
    ends = np.cumsum(span)
    if ends.size and (ends[np.flatnonzero(np.diff(lane, append=-1))] != (np.arange(len(lengths)) + 1) << 15).any():
        raise ValueError("a prefix code is not complete")
    return lane, symbol, size, REVERSED[(ends - span) & 0x7FFF]


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lookup entries (symbol * 16 + length) of all lanes, each lane's first entry and its mask of bits to look at."""
    lane, symbol, size, _ = codebook(lengths)
    wide = np.zeros(len(lengths), dtype=np.int64)
    np.maximum.at(wide, lane, size)
    entries = np.repeat((symbol * 16 + size).astype(np.uint16), np.left_shift(1, wide[lane] - size))
    first = np.concatenate([[0], np.cumsum(np.left_shift(1, wide))[:-1]]).astype(np.int64)
    for m in np.unique(wide).tolist():
        if m > 1:  # from the order of codes to the order of bits in the stream
            cells = first[wide == m][:, None] + np.arange(1 << m)
            entries[cells] = entries[first[wide == m][:, None] + (REVERSED[: 1 << m] >> (15 - m))]
    return entries, first, np.left_shift(1, wide) - 1


def lane_lengths(lanes: Lanes, who: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Code lengths of the next prefix code of the lanes ``who``; ``alphabet`` is the number of symbols of each."""
    out = np.zeros((len(who), int(alphabet.max())), dtype=np.uint8)
    simple = lanes.read(who, 1) == 1
    rows = np.flatnonzero(simple)
    if len(rows):
        two, wide = lanes.read(who[rows], 1), lanes.read(who[rows], 1)
        out[rows, lanes.read(who[rows], np.where(wide == 1, 8, 1))] = 1
        more = rows[two == 1]
        if len(more):
            out[more, lanes.read(who[more], 8)] = 1
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return out
    mine = who[rows]
    first = np.zeros((len(rows), 19), dtype=np.uint8)
    count = 4 + lanes.read(mine, 4)
    for k, symbol in enumerate(CODE_ORDER):
        there = np.flatnonzero(count > k)
        if len(there):
            first[there, symbol] = lanes.read(mine[there], 3)
    entries, base, mask = tables(first)
    left = alphabet[rows].astype(np.int64)
    some = np.flatnonzero(lanes.read(mine, 1) == 1)
    if len(some):
        bits = 2 + 2 * lanes.read(mine[some], 3)
        left[some] = 2 + lanes.read(mine[some], bits)
    at, before = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), 8, dtype=np.int64)
    full = alphabet[rows]
    open_ = np.arange(len(rows))
    while True:
        open_ = open_[(at[open_] < full[open_]) & (left[open_] > 0)]
        if not len(open_):
            return out
        left[open_] -= 1
        here = mine[open_]
        place = lanes.at[here]
        entry = entries[base[open_] + ((lanes.window[place >> 3] >> (place & 7)) & mask[open_])].astype(np.int64)
        lanes.at[here] = place + (entry & 15)
        s = entry >> 4
        run = np.ones(len(open_), dtype=np.int64)
        for symbol, least, bits in ((16, 3, 2), (17, 3, 3), (18, 11, 7)):
            hit = np.flatnonzero(s == symbol)
            if len(hit):
                run[hit] = least + lanes.read(here[hit], bits)
        if (at[open_] + run > full[open_]).any():
            raise ValueError("code lengths run over")
        value = np.where(s < 16, s, np.where(s == 16, before[open_], 0))
        for k in range(6):
            more = np.flatnonzero((value > 0) & (run > k))
            if not len(more):
                break
            out[rows[open_[more]], at[open_[more]] + k] = value[more]
        at[open_] += run
        known = np.flatnonzero((s < 16) & (s > 0))
        before[open_[known]] = s[known]


class Head:
    """What stands before the prefix codes of a stream's main image."""

    def __init__(self, stream: bytes):
        bits = Bits(stream)
        if bits.read(8) != 0x2F:
            raise ValueError("no lossless signature")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.undo, self.coded, seen = [], self.width, set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise ValueError("a transform occurs twice")
            seen.add(kind)
            if kind < 2:
                block = bits.read(3) + 2
                w, h = -(-self.coded >> block), -(-self.height >> block)
                self.undo.append((kind, block, _split(_coded_image(bits, w, h, False), h, w), self.coded))
            elif kind == 2:
                self.undo.append((kind, 0, None, self.coded))
            else:
                n = bits.read(8) + 1
                colours = np.cumsum(_split(_coded_image(bits, n, 1, False), 1, n)[0], axis=0, dtype=np.uint8)
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.undo.append((kind, pack, colours, self.coded))
                self.coded = -(-self.coded >> pack)
        self.cache = bits.read(4) if bits.read(1) else 0
        if self.cache > 11:
            raise ValueError("the colour cache is too large")
        self.block, self.group_of, self.groups = 0, None, 1
        if bits.read(1):
            self.block = bits.read(3) + 2
            self.group_of = [(p >> 8) & 0xFFFF for p in _coded_image(bits, -(-self.coded >> self.block), -(-self.height >> self.block), False)]
            self.groups = max(self.group_of) + 1
        self.at, self.pixels = bits.at, self.coded * self.height

    def finish(self, coded: np.ndarray) -> np.ndarray:
        """Height x width x R, G, B, A from the ARGB values of the main image: the transforms, the last first."""
        image = np.ascontiguousarray(coded, dtype="<u4").view(np.uint8).reshape(self.height, self.coded, 4).copy()
        for kind, block, extra, before in reversed(self.undo):
            if kind == 0:
                _undo_predictor(image, extra, block)
            elif kind == 1:
                _undo_colour(image, extra, block)
            elif kind == 2:
                image[..., 0] += image[..., 1]
                image[..., 2] += image[..., 1]
            else:
                image = _undo_palette(image, extra, block, before)
        return image[..., [2, 1, 0, 3]]


_NEAR_X, _NEAR_Y = (np.array([p[k] for p in NEIGHBOURS], dtype=np.int64) for k in (0, 1))


def _far(lanes: Lanes, who: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Values of length or distance prefixes with their extra bits."""
    extra = np.maximum(0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + lanes.read(who, np.where(prefix < 4, 0, extra))) + 1


def _main_images(heads: list[Head], streams: list[bytes]) -> np.ndarray:
    """ARGB values (pixel x lane) of the main images; lanes come by falling number of pixels."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    window = windows(np.frombuffer(b"".join(streams), dtype=np.uint8))
    lanes = Lanes(window, 8 * (np.cumsum(sizes) - sizes) + np.array([h.at for h in heads]))
    stop = 8 * np.cumsum(sizes)
    groups = np.array([h.groups for h in heads], dtype=np.int64)
    cache_bits = np.array([h.cache for h in heads], dtype=np.int64)
    first_group = np.cumsum(groups) - groups
    kinds = (280 + np.where(cache_bits > 0, np.left_shift(1, cache_bits), 0), np.full(len(heads), 256), np.full(len(heads), 256), np.full(len(heads), 256), np.full(len(heads), 40))
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in kinds]
    for g in range(int(groups.max())):
        who = np.flatnonzero(groups > g)
        for k, alphabet in enumerate(kinds):
            found[k].append((first_group[who] + g, lane_lengths(lanes, who, alphabet[who])))
    made = []
    for parts in found:
        lengths = np.zeros((int(groups.sum()), max(p.shape[1] for _, p in parts)), dtype=np.uint8)
        for where, part in parts:
            lengths[where, : part.shape[1]] = part
        made.append(tables(lengths))
    one_alpha = bool((made[3][2] == 0).all())
    group = first_group.copy()
    mixed = np.flatnonzero(groups > 1)
    maps = np.concatenate([np.array(heads[k].group_of, dtype=np.int64) for k in mixed.tolist()]) if len(mixed) else None
    if maps is not None:
        across = np.array([-(-heads[k].coded >> heads[k].block) for k in mixed.tolist()])
        map_at = np.cumsum([0, *(len(heads[k].group_of) for k in mixed.tolist())])[:-1]
        blocks = np.array([heads[k].block for k in mixed.tolist()])
    pixels, widths = np.array([h.pixels for h in heads], dtype=np.int64), np.array([h.coded for h in heads], dtype=np.int64)
    out = np.zeros((int(pixels[0]), len(heads)), dtype=np.uint32)
    cached = np.flatnonzero(cache_bits > 0)
    cache_at = np.cumsum(np.left_shift(1, cache_bits)) - np.left_shift(1, cache_bits)
    cache = np.zeros(int(np.left_shift(1, cache_bits).sum()), dtype=np.uint32)
    left, back = np.zeros(len(heads), dtype=np.int64), np.ones(len(heads), dtype=np.int64)

    def look(code: int, who) -> np.ndarray:
        """The next symbol of each lane in ``who``."""
        entries, base, mask = made[code]
        g, at = group[who], lanes.at[who]
        entry = entries[base[g] + ((window[at >> 3] >> (at & 7)) & mask[g])]
        lanes.at[who] = at + (entry & 15)
        return entry >> 4

    falls = {int(p): int((pixels >= p).sum()) for p in np.unique(pixels)}  # lanes that reach so many pixels
    marks = sorted(falls)
    live, copying = 0, 0
    for t in range(int(pixels[0])):
        if not t or t == marks[0]:
            if t:
                marks.pop(0)
            live = falls[marks[0]]
            cached = cached[cached < live]
            copying = int((left[:live] > 0).sum())
            if (lanes.at > stop).any():
                raise ValueError("the file ends too early")
        if maps is not None:
            there = mixed < live
            lane = mixed[there]
            y, x = t // widths[lane], t % widths[lane]
            group[lane] = first_group[lane] + maps[map_at[there] + (y >> blocks[there]) * across[there] + (x >> blocks[there])]
        row = out[t]
        who = slice(0, live) if not copying else np.flatnonzero(left[:live] == 0)
        s = look(0, who)
        plain = s < 256
        if plain.all():
            read = who
        else:
            mine = np.arange(live) if not copying else who
            read = mine[plain]
            for symbol, lane in ((s[~plain], mine[~plain]),):
                hit = symbol >= 280
                row[lane[hit]] = cache[cache_at[lane[hit]] + symbol[hit] - 280]
                run, lane = symbol[~hit].astype(np.int64), lane[~hit]
                if len(lane):
                    left[lane] = _far(lanes, lane, run - 256)
                    far = _far(lanes, lane, look(4, lane).astype(np.int64))
                    near = np.minimum(far, 120) - 1
                    far = np.where(far > 120, far - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * widths[lane]))
                    if (far > t).any() or (left[lane] + t > pixels[lane]).any():
                        raise ValueError("a back-reference leaves the image")
                    back[lane] = far
                    copying += len(lane)
            s = s[plain]
        if len(s):
            red = look(1, read).astype(np.uint32) << 16
            value = red | s.astype(np.uint32) << 8 | look(2, read)
            alpha = made[3][0][made[3][1][group[read]]] >> 4 if one_alpha else look(3, read)
            row[read] = value | alpha.astype(np.uint32) << 24
        if copying:
            lane = np.flatnonzero(left[:live] > 0)
            row[lane] = out[t - back[lane], lane]
            left[lane] -= 1
            copying = int((left[lane] > 0).sum())
        if len(cached):
            p = row[cached].astype(np.int64)
            cache[cache_at[cached] + ((0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits[cached]))] = p
    if (lanes.at > stop).any():
        raise ValueError("the file ends too early")
    return out


#: Pixels (lanes times the tallest) that are decoded together.
TOGETHER = 8 << 20


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Pixels (height x width x R, G, B, A) of VP8L streams, decoded in step, one lane each."""
    heads = [Head(s) for s in streams]
    order = sorted(range(len(streams)), key=lambda k: -heads[k].pixels)
    out: list[np.ndarray] = [np.empty(0)] * len(streams)
    at = 0
    while at < len(order):
        most = max(1, TOGETHER // heads[order[at]].pixels)
        part = order[at : at + most]
        coded = _main_images([heads[k] for k in part], [streams[k] for k in part])
        for lane, k in enumerate(part):
            out[k] = heads[k].finish(coded[: heads[k].pixels, lane])
        at += most
    return out


def decode(stream: bytes) -> np.ndarray:
    """Pixels of one VP8L stream."""
    return decode_many([stream])[0]


def decode_payloads(media: list[bytes]) -> list[bytes]:
    """The payload of each value (one or more WebP files): R, G, B of all pixels in a row."""
    streams, owner = [], []
    for k, m in enumerate(media):
        for s in riff_files(m):
            streams.append(s)
            owner.append(k)
    whole: list[list[bytes]] = [[] for _ in media]
    for k, image in zip(owner, decode_many(streams)):
        whole[k].append(image[..., :3].tobytes())
    return [b"".join(w) for w in whole]


# --- Payloads of bytes ---

#: Lengths of the code that writes code lengths; complete, and the same in every image.
STEP_LENGTHS = {0: 3, 1: 7, 2: 6, 3: 5, 4: 4, 5: 4, 6: 3, 7: 3, 8: 4, 9: 4, 10: 5, 11: 6, 12: 7, 13: 7, 16: 7, 17: 3, 18: 3}
STEP_CODES = canonical([STEP_LENGTHS.get(k, 0) for k in range(19)])
CACHE_BITS, WINDOW, LONGEST = 8, 4, 4096
#: Bits of a pixel's place in its image.
PLACE_BITS = (ROWS * WIDTH - 1).bit_length()


class Bitstring:
    """Bits put one after another, the first lowest."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits


def code_lengths(weights: list[int], limit: int = LIMIT) -> list[int]:
    """Huffman lengths of two or more weights, none above ``limit``: small weights are raised until that holds."""
    n = len(weights)
    floor = 0
    while True:
        w = [max(x, floor) for x in weights]
        order = sorted(range(n), key=w.__getitem__)
        heavy = [w[k] for k in order] + [0] * (n - 1)
        parent = [0] * (2 * n - 1)
        i, j = 0, n
        for k in range(n, 2 * n - 1):
            for _ in (0, 1):
                if i < n and (j >= k or heavy[i] <= heavy[j]):
                    a, i = i, i + 1
                else:
                    a, j = j, j + 1
                heavy[k] += heavy[a]
                parent[a] = k
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            out = [0] * n
            for place, k in enumerate(order):
                out[k] = depth[place]
            return out
        floor = max(floor * 2, sum(weights) >> limit, 1)


def _zeros(bits: Bitstring, n: int) -> None:
    while n:
        if n >= 11:
            run = min(n, 138)
            bits.put(STEP_CODES[18], STEP_LENGTHS[18])
            bits.put(run - 11, 7)
        elif n >= 3:
            run = n
            bits.put(STEP_CODES[17], STEP_LENGTHS[17])
            bits.put(run - 3, 3)
        else:
            run = 1
            bits.put(STEP_CODES[0], STEP_LENGTHS[0])
        n -= run


def _put_code(bits: Bitstring, symbols: list[int], lengths: list[int], alphabet: int) -> None:
    """A prefix code's description: its symbols, ascending, with their lengths; a single symbol (below 256) simply."""
    if len(symbols) < 2:
        bits.put(0b101, 3)
        bits.put(symbols[0] if symbols else 0, 8)
        return
    bits.put(0, 1)
    bits.put(15, 4)
    for k in CODE_ORDER:
        bits.put(STEP_LENGTHS.get(k, 0), 3)
    bits.put(0, 1)
    at = 0
    for s, n in zip(symbols, lengths):
        _zeros(bits, s - at)
        bits.put(STEP_CODES[n], STEP_LENGTHS[n])
        at = s + 1
    _zeros(bits, alphabet - at)


def _put_pixels(bits: Bitstring, pixels: list[tuple[int, int, int]]) -> None:
    """A small inner image of (R, G, B), literally, without a cache."""
    bits.put(0, 1)
    planes = [[p[k] for p in pixels] for k in (1, 0, 2)]
    codes = []
    for plane, alphabet in zip(planes, (280, 256, 256)):
        used = sorted(set(plane))
        lengths = code_lengths([plane.count(s) for s in used]) if len(used) > 1 else [0]
        _put_code(bits, used, lengths, alphabet)
        full = [0] * alphabet
        for s, n in zip(used, lengths):
            full[s] = n
        codes.append((canonical(full), full))
    _put_code(bits, [255], [0], 256)
    _put_code(bits, [0], [0], 40)
    for at in range(len(pixels)):
        for plane, (code, full) in zip(planes, codes):
            bits.put(code[plane[at]], full[plane[at]])


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits' value and their number for lengths and distances from 1."""
    n = value - 1
    high = np.frexp(np.maximum(n, 1).astype(float))[1] - 1
    extra = np.where(n < 4, 0, high - 1)
    return np.where(n < 4, n, 2 * high + ((n >> np.maximum(high - 1, 0)) & 1)), np.where(n < 4, 0, n & (np.left_shift(1, extra) - 1)), extra


def _entropy(image: np.ndarray, values: np.ndarray, images: int, alphabet: int = 256) -> np.ndarray:
    """Bits that the values of each image take at the rate of their own frequencies."""
    counts = np.bincount(image * alphabet + values, minlength=images * alphabet).reshape(images, alphabet)
    total = counts.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1)


def _transformed(pixels: np.ndarray, image: np.ndarray, first: np.ndarray, heights: np.ndarray) -> list[tuple[np.ndarray, Bitstring, int, int]]:
    """For each image the coded pixels (n x R, G, B), the transform's bits, the constant alpha and the coded width.

    Tried are no transform, prediction from the left or from above, and a red
    and a blue that follow green; an image of few colours gets a palette.
    """
    count = len(heights)
    px = pixels.astype(np.int64)
    place = np.arange(len(px)) - first[image]
    # Every fourth row tells how well each would do; the whole image is transformed only where one is chosen.
    seen = np.flatnonzero((place // WIDTH) % 4 == 0)
    mine = image[seen]
    scale = heights * WIDTH / np.bincount(mine, minlength=count)
    cost = lambda p: scale * sum(_entropy(mine, p[:, k], count) for k in range(3))

    def residue(mode: int, where: np.ndarray) -> np.ndarray:
        """What prediction from the left (1) or from above (2) leaves of the pixels at ``where``."""
        at = place[where]
        back = np.where((at < WIDTH) | ((mode == 1) & (at % WIDTH > 0)), 1, WIDTH)
        guess = px[np.maximum(where - back, 0)]
        guess[at == 0] = 0
        return (px[where] - guess) & 255

    few_px = px[seen]
    plain = cost(few_px)
    signed = np.where(few_px > 127, few_px - 256, few_px)
    green, n_of = signed[:, 1], np.bincount(mine, minlength=count)
    mean = lambda v: np.bincount(mine, weights=v, minlength=count) / n_of
    middle = mean(green)
    spread = np.maximum(mean(green * green) - middle**2, 1e-9)
    slopes = [np.clip(np.round(32 * (mean(green * signed[:, k]) - middle * mean(signed[:, k])) / spread), -128, 127).astype(np.int64) for k in (0, 2)]

    def follow(where: np.ndarray) -> np.ndarray:
        """Red and blue without what they share with green."""
        out = px[where]
        g = np.where(out[:, 1] > 127, out[:, 1] - 256, out[:, 1])
        for k, slope in zip((0, 2), slopes):
            out[:, k] = (out[:, k] - (slope[image[where]] * g >> 5)) & 255
        return out

    costs = np.stack([plain, cost(residue(1, seen)) + 90, cost(residue(2, seen)) + 90, cost(follow(seen)) + 90])
    best = np.argmin(costs, axis=0)
    best[plain <= 1.05 * costs.min(0) + 64] = 0
    packed = px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2]
    out = []
    for k, (start, h) in enumerate(zip(first.tolist(), heights.tolist())):
        bits = Bitstring()
        span = slice(start, start + h * WIDTH)
        few = np.unique(packed[span]) if 2 * h * WIDTH < plain[k] < 12 * h * WIDTH else ()
        if 1 < len(few) <= 256 and 30 * len(few) + np.log2(len(few)) * h * WIDTH < plain[k]:
            index = np.searchsorted(few, packed[span])
            bits.put(1, 1)
            bits.put(3, 2)
            bits.put(len(few) - 1, 8)
            steps = np.diff(np.stack([few >> 16, few >> 8 & 255, few & 255], 1), axis=0, prepend=np.zeros((1, 3), dtype=np.int64)) & 255
            # The first colour's alpha is 255; the others add 0 to it, so alphas differ and the list is written with its own codes.
            _put_palette(bits, [tuple(c) for c in steps.tolist()])
            pack = 3 if len(few) <= 2 else 2 if len(few) <= 4 else 1 if len(few) <= 16 else 0
            if pack:
                index = index.reshape(-1, 1 << pack)
                index = (index << (np.arange(1 << pack) * (8 >> pack))).sum(1)
            coded = np.zeros((len(index), 3), dtype=np.int64)
            coded[:, 1] = index
            out.append((coded, bits, 255, WIDTH >> pack))
            continue
        mode = int(best[k])
        if not mode:
            out.append((px[span], bits, 255, WIDTH))
            continue
        where = np.arange(start, start + h * WIDTH)
        bits.put(1, 1)
        bits.put(0 if mode < 3 else 1, 2)
        bits.put(7, 3)  # one block of 512 x 512
        _put_pixels(bits, [(0, mode, 0) if mode < 3 else (0, int(slopes[1][k]) & 255, int(slopes[0][k]) & 255)])
        out.append((residue(mode, where) if mode < 3 else follow(where), bits, 0 if mode < 3 else 255, WIDTH))
    return out


def _put_palette(bits: Bitstring, steps: list[tuple[int, int, int]]) -> None:
    """The palette's colours as differences: alpha is 255 in the first and 0 in all others."""
    bits.put(0, 1)
    planes = [[p[k] for p in steps] for k in (1, 0, 2)] + [[255] + [0] * (len(steps) - 1)]
    codes = []
    for plane, alphabet in zip(planes, (280, 256, 256, 256)):
        used = sorted(set(plane))
        lengths = code_lengths([plane.count(s) for s in used]) if len(used) > 1 else [0]
        _put_code(bits, used, lengths, alphabet)
        full = [0] * alphabet
        for s, n in zip(used, lengths):
            full[s] = n
        codes.append((canonical(full), full))
    _put_code(bits, [0], [0], 40)
    for at in range(len(steps)):
        for plane, (code, full) in zip(planes, codes):
            bits.put(code[plane[at]], full[plane[at]])


def _copies(px: np.ndarray, image: np.ndarray, last: np.ndarray, rate: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Start, length and distance of the copies to make: the latest earlier place with the same four pixels, as far as it agrees."""
    n = len(px)
    if n <= WINDOW:
        return [], [], []
    # Sorted by image, a hash of the window and the place, each exactly: what is found in an image depends on nothing else.
    mixed = px.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mixed.copy()
    for k in range(1, WINDOW):
        key = (key ^ np.roll(mixed, -k) >> np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD)
    first = np.concatenate([[0], last[:-1]])
    place = (np.arange(n) - first[image]).astype(np.uint64)
    hashed = image.astype(np.uint64) << np.uint64(40 - PLACE_BITS) | key >> np.uint64(24 + PLACE_BITS)
    ordered = np.sort(hashed << np.uint64(PLACE_BITS) | place)
    group = ordered >> np.uint64(PLACE_BITS)
    at = (ordered & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + first[(group >> np.uint64(40 - PLACE_BITS)).astype(np.int64)]
    same = group[1:] == group[:-1]
    far = np.zeros(n, dtype=np.int64)
    far[at[1:][same]] = (at[1:] - at[:-1])[same]
    far[np.arange(n) + WINDOW > last[image]] = 0
    ok = np.flatnonzero(far)
    agree = np.ones(len(ok), dtype=bool)
    for k in range(WINDOW):
        agree &= px[ok + k] == px[ok + k - far[ok]]
    far[ok[~agree]] = 0
    begins = np.flatnonzero((far > 0) & ((np.diff(far, prepend=0) != 0) | (np.diff(image, prepend=-1) != 0)))
    ends = np.flatnonzero((far > 0) & ((np.diff(far, append=0) != 0) | (np.diff(image, append=-1) != 0)))
    starts, sizes, fars, done = [], [], [], 0
    for s, e, d in zip(begins.tolist(), (ends + WINDOW).tolist(), far[begins].tolist()):
        s = max(s, done)
        while e - s >= WINDOW:
            size = min(e - s, LONGEST)
            starts.append(s)
            sizes.append(size)
            fars.append(d)
            s = done = s + size
    if starts:
        of, size = image[starts], np.array(sizes)
        gain = np.bincount(of, weights=size * rate[of] - 26, minlength=len(rate))
        keep = (gain[of] > 0).tolist()
        starts, sizes, fars = ([v for v, k in zip(vs, keep) if k] for vs in (starts, sizes, fars))
    return starts, sizes, fars


def encode_payloads(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """WebP files for the payloads that follow one another in ``data``; each size is a positive multiple of 192.

    A pixel's R, G, B are three bytes.  Each image gets its own transform,
    prefix codes, back-references and colour cache, whichever is shortest by
    its own frequencies; what an image becomes depends on its pixels only.
    """
    rows = sizes // ROW
    strips = -(-rows // ROWS)
    owner = np.repeat(np.arange(len(sizes)), strips)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
    heights = np.minimum(ROWS, rows[owner] - turn * ROWS)
    images = len(heights)
    counts = heights * WIDTH
    parts = _transformed(data.reshape(-1, 3), np.repeat(np.arange(images), counts), np.cumsum(counts) - counts, heights)
    counts = np.array([len(p[0]) for p in parts], dtype=np.int64)
    rgb = np.concatenate([p[0] for p in parts])
    alpha = np.array([p[2] for p in parts], dtype=np.int64)
    image = np.repeat(np.arange(images), counts)
    n = len(rgb)
    last = np.cumsum(counts)
    argb = alpha[image] << 24 | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    literal = sum(_entropy(image, rgb[:, k], images) for k in range(3))
    starts, lens, fars = _copies(argb, image, last, literal / counts)
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, np.array(starts, dtype=np.int64), 1)
    np.add.at(covered, np.array(starts, dtype=np.int64) + np.array(lens, dtype=np.int64), -1)
    free = np.cumsum(covered[:n]) == 0
    # The cache holds, for each hash, the last pixel that had it, however it was coded.
    slot = (0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    first = last - counts
    ordered = np.sort(((image << CACHE_BITS | slot) << PLACE_BITS) | (np.arange(n) - first[image]))
    at = (ordered & ((1 << PLACE_BITS) - 1)) + first[ordered >> (CACHE_BITS + PLACE_BITS)]
    hit = np.zeros(n, dtype=bool)
    hit[at[1:]] = ((ordered[1:] >> PLACE_BITS) == (ordered[:-1] >> PLACE_BITS)) & (argb[at[1:]] == argb[at[:-1]])
    hit &= free
    alphabet = 280 + (1 << CACHE_BITS)
    lit = free & ~hit
    with_cache = _entropy(image[free], np.where(hit, 280 + slot, rgb[:, 1])[free], images, alphabet) + sum(_entropy(image[lit], rgb[lit, k], images) for k in (0, 2))
    used = np.bincount((np.bincount((image << CACHE_BITS | slot)[hit], minlength=images << CACHE_BITS).reshape(images, -1) > 0).nonzero()[0], minlength=images)
    without = sum(_entropy(image[free], rgb[free, k], images) for k in range(3))
    cached = with_cache + 8 * used + 60 < without
    hit &= cached[image]
    lit = free & ~hit
    green = np.where(hit, 280 + slot, rgb[:, 1])
    start, size, far = (np.array(v, dtype=np.int64) for v in (starts, lens, fars))
    size_prefix, size_extra, size_bits = _prefix(size)
    far_prefix, far_extra, far_bits = _prefix(far + 120)
    green[start] = 256 + size_prefix
    token = free.copy()
    token[start] = True
    histogram = lambda who, values, wide: np.bincount(image[who] * wide + values, minlength=images * wide).reshape(images, wide)
    books = []
    for counted in (histogram(token, green[token], alphabet), histogram(lit, rgb[lit, 0], 256) + histogram(lit, rgb[lit, 2], 256), histogram(start, far_prefix, 40)):
        where, symbol = np.nonzero(counted)
        edges = np.searchsorted(where, np.arange(images + 1)).tolist()
        weights, symbols = counted[where, symbol].tolist(), symbol.tolist()
        lengths = np.zeros(counted.shape, dtype=np.uint8)
        listed = []
        for a, b in zip(edges[:-1], edges[1:]):
            listed.append((symbols[a:b], code_lengths(weights[a:b]) if b - a > 1 else [1] * (b - a)))
        lengths[where, symbol] = [x for _, ls in listed for x in ls]
        lane, symbol, wide, code = codebook(lengths)
        codes, widths = np.zeros(counted.shape, dtype=np.uint16), np.zeros(counted.shape, dtype=np.uint8)
        codes[lane, symbol], widths[lane, symbol] = code, wide
        books.append((listed, codes, widths))
    heads = []
    for k in range(images):
        bits_ = Bitstring()
        bits_.put(0x2F, 8)
        bits_.put(WIDTH - 1, 14)
        bits_.put(int(heights[k]) - 1, 14)
        bits_.put(0, 4)
        bits_.put(parts[k][1].value, parts[k][1].size)
        bits_.put(0, 1)
        if cached[k]:
            bits_.put(1, 1)
            bits_.put(CACHE_BITS, 4)
        else:
            bits_.put(0, 1)
        bits_.put(0, 1)
        _put_code(bits_, *books[0][0][k], alphabet if cached[k] else 280)
        both = Bitstring()
        _put_code(both, *books[1][0][k], 256)
        bits_.put(both.value, both.size)
        bits_.put(both.value, both.size)
        _put_code(bits_, [int(alpha[k])], [0], 256)
        _put_code(bits_, *books[2][0][k], 40)
        heads.append(bits_)
    # Each pixel that begins a literal, a cache hit or a copy has one value of at most 54 bits.
    value, wide = books[0][1][image, green].astype(np.int64), books[0][2][image, green].astype(np.int64)
    at_lit = np.flatnonzero(lit)
    own, wide_lit, more = image[at_lit] << 8, wide[at_lit], np.zeros(len(at_lit), dtype=np.int64)
    for k in (0, 2):
        cell = own | rgb[at_lit, k]
        more |= books[1][1].ravel()[cell].astype(np.int64) << wide_lit
        wide_lit += books[1][2].ravel()[cell]
    value[at_lit] |= more
    wide[at_lit] = wide_lit
    if len(start):
        of = image[start]
        for more, bits_of in ((size_extra, size_bits), (books[2][1][of, far_prefix], books[2][2][of, far_prefix]), (far_extra, far_bits)):
            value[start] |= more.astype(np.int64) << wide[start]
            wide[start] += bits_of
    wide[~token] = 0
    value[~token] = 0
    total = np.concatenate([[0], np.cumsum(wide)])
    head_bits = np.array([h.size for h in heads], dtype=np.int64)
    n_bytes = -(-(head_bits + total[last] - total[last - counts]) // 8)
    room = n_bytes + (n_bytes & 1)
    begin = np.cumsum(room) - room
    where = total[:-1] + (8 * begin + head_bits - total[last - counts])[image]
    value, where = value[token], where[token]
    value <<= where & 7
    byte = where >> 3
    whole = int(room.sum())
    stream = np.zeros(whole + 8)
    for k in range(8):
        if k > 4:  # few values are that long
            long = value >= 1 << 8 * k
            value, byte = value[long], byte[long]
        stream += np.bincount(byte + k, weights=(value >> (8 * k)) & 255, minlength=whole + 8)[: whole + 8]
    stream = stream.astype(np.uint8)
    for s, h in zip(begin.tolist(), heads):
        raw = np.frombuffer(h.value.to_bytes(-(-h.size // 8), "little"), dtype=np.uint8)
        stream[s : s + len(raw)] |= raw
    raw = stream.tobytes()
    files = [b"RIFF" + struct.pack("<I", 12 + r) + b"WEBPVP8L" + struct.pack("<I", m) + raw[s : s + r] for s, m, r in zip(begin.tolist(), n_bytes.tolist(), room.tolist())]
    ends_of = np.cumsum(strips).tolist()
    return [b"".join(files[e - s : e]) for e, s in zip(ends_of, strips.tolist())]
