"""VCDIFF (RFC 3284) with the default code table: encoder, decoder, streams, composition and listings.

Extensions that the format provides for: an Adler-32 of each window, an application header, and sections compressed by
a secondary compressor (LZMA, each section by itself where that makes it smaller).
"""

from __future__ import annotations

import lzma
import zlib
from dataclasses import dataclass, field, replace

import numpy as np

MAGIC = b"\xd6\xc3\xc4\x00"
NOOP, ADD, RUN, COPY = range(4)
NEAR, SAME = 4, 3
#: Header and window flags; the number of the secondary compressor.
DECOMPRESS, CODETABLE, APP_HEADER = 1, 2, 4
SOURCE, TARGET, CHECKSUM = 1, 2, 4
LZMA = 2
MIN_RUN, MIN_COPY = 8, 4
_FILTERS = [{"id": lzma.FILTER_LZMA2, "preset": 6}]


def _filters(size: int) -> list[dict[str, int]]:
    """What compresses so many bytes: a dictionary beyond them would only be set up."""
    return [_FILTERS[0] | {"dict_size": min(1 << 23, max(1 << 12, 1 << size.bit_length()))}]


@dataclass(frozen=True)
class Level:
    """A matcher's effort: source words at every so many bytes, how many places of a target word are tried, how long a match
    may be for a look whether the next place has a longer one."""

    stride: int
    chain: int
    lazy: int


LEVELS = {"fastest": Level(8, 1, 0), "faster": Level(4, 1, 0), "fast": Level(2, 4, 0), "default": Level(1, 8, 16), "slow": Level(1, 64, 128)}


def _code_table() -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """The 256 default entries, by the rule of the standard: pairs of (instruction, size, mode)."""
    none = (NOOP, 0, 0)
    table = [((RUN, 0, 0), none)] + [((ADD, s, 0), none) for s in range(18)]
    table += [((COPY, s, m), none) for m in range(9) for s in (0, *range(4, 19))]
    table += [((ADD, a, 0), (COPY, c, m)) for m in range(6) for a in range(1, 5) for c in range(4, 7)]
    table += [((ADD, a, 0), (COPY, 4, m)) for m in range(6, 9) for a in range(1, 5)]
    return table + [((COPY, 4, m), (ADD, 1, 0)) for m in range(9)]


CODE_TABLE = _code_table()
_CODE = {entry: i for i, entry in enumerate(CODE_TABLE)}
_KINDS = {"add": ADD, "run": RUN, "copy": COPY}
#: What an entry holds without the empty instructions.
_STEPS = [tuple(x for x in entry if x[0] != NOOP) for entry in CODE_TABLE]
_SINGLE = {entry[0]: i for entry, i in _CODE.items() if entry[1][0] == NOOP}


def _number(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


_NUMBERS = [_number(n) for n in range(1 << 14)]


def number(n: int) -> bytes:
    return _NUMBERS[n] if 0 <= n < 1 << 14 else _number(n)


class Reader:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def byte(self) -> int:
        self.at += 1
        return self.raw[self.at - 1]

    def number(self) -> int:
        n = self.raw[self.at]
        if n < 128:
            self.at += 1
            return n
        n = 0
        for _ in range(10):
            b = self.byte()
            n = n << 7 | b & 127
            if b < 128:
                if n >> 63:
                    break
                return n
        raise ValueError("a number is too large")

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.raw):
            raise IndexError("data ends early")
        return self.raw[self.at - n : self.at]


class Addresses:
    """The caches of recent addresses: four near ones in turn, and those that agree in their last digits."""

    def __init__(self):
        self.near, self.same, self.turn = [0] * NEAR, [0] * (SAME * 256), 0

    def met(self, at: int) -> None:
        self.near[self.turn], self.turn = at, (self.turn + 1) % NEAR
        self.same[at % (SAME * 256)] = at

    def encode(self, at: int, here: int) -> tuple[int, bytes]:
        """(mode, bytes) of the shortest form."""
        slot = at % (SAME * 256)
        if self.same[slot] == at:
            mode, raw = 2 + NEAR + slot // 256, _NUMBERS[slot % 256][-1:] if slot % 256 < 128 else bytes((slot % 256,))
        else:
            value, mode = at, 0
            if here - at < value:
                value, mode = here - at, 1
            k = 2
            for n in self.near:
                if 0 <= at - n < value:
                    value, mode = at - n, k
                k += 1
            raw = _NUMBERS[value] if 0 <= value < 1 << 14 else number(value)
        self.near[self.turn], self.turn = at, (self.turn + 1) % NEAR
        self.same[slot] = at
        return mode, raw

    def decode(self, mode: int, here: int, r: Reader) -> int:
        if mode == 0:
            at = r.number()
        elif mode == 1:
            at = here - r.number()
        elif mode < 2 + NEAR:
            at = self.near[mode - 2] + r.number()
        else:
            at = self.same[(mode - 2 - NEAR) * 256 + r.byte()]
        if not 0 <= at < here:
            raise ValueError("an address lies outside the window")
        self.near[self.turn], self.turn = at, (self.turn + 1) % NEAR
        self.same[at % (SAME * 256)] = at
        return at


@dataclass
class Window:
    """A window's instructions (op, size, address or None) with the data of its adds and runs, in order."""

    ops: list[tuple[str, int, int | None]] = field(default_factory=list)
    data: bytes = b""
    size: int = 0
    source: tuple[int, int] | None = None  # place and size of the source segment
    from_target: bool = False
    checksum: int | None = None


def pack_window(w: Window, secondary: bool = False) -> bytes:
    """Instructions by the code table: sizes within the code where it has them, pairs of instructions in one code."""
    start = w.source[1] if w.source else 0
    cache, here, addr = Addresses(), start, bytearray()
    inst: list[tuple[int, int, int]] = []
    for op, size, at in w.ops:
        mode = 0
        if op == "copy":
            mode, raw = cache.encode(at, here)
            addr += raw
        inst.append((_KINDS[op], size, mode))
        here += size
    codes, k, last = bytearray(), 0, len(inst) - 1
    while k <= last:
        one = inst[k]
        if k < last and (one[1] < 5 and inst[k + 1][1] < 7) and (both := _CODE.get((one, inst[k + 1]))) is not None:  # no pair is larger
            codes.append(both)
            k += 2
            continue
        size = one[1]
        code = _SINGLE.get(one) if size else None
        if code is None:
            codes.append(_SINGLE[(one[0], 0, one[2])])
            codes += number(size)
        else:
            codes.append(code)
        k += 1
    sections, packed = [w.data, bytes(codes), bytes(addr)], 0
    if secondary:
        for i, raw in enumerate(sections):
            small = number(len(raw)) + lzma.compress(raw, lzma.FORMAT_RAW, filters=_filters(len(raw)))
            if len(small) < len(raw):
                sections[i], packed = small, packed | 1 << i
    body = number(w.size) + bytes([packed]) + b"".join(number(len(s)) for s in sections)
    body += (w.checksum.to_bytes(4, "big") if w.checksum is not None else b"") + b"".join(sections)
    flags = ((TARGET if w.from_target else SOURCE) if w.source else 0) | (CHECKSUM if w.checksum is not None else 0)
    return bytes([flags]) + (number(w.source[1]) + number(w.source[0]) if w.source else b"") + number(len(body)) + body


def read_window(r: Reader) -> Window:
    flags = r.byte()
    source = None
    if flags & (SOURCE | TARGET):
        size = r.number()
        source = (r.number(), size)
    end = r.number() + r.at
    if end > len(r.raw):
        raise IndexError("data ends early")
    length, packed = r.number(), r.byte()
    sizes = [r.number() for _ in range(3)]
    check = int.from_bytes(r.take(4), "big") if flags & CHECKSUM else None
    sections = [r.take(n) for n in sizes]
    for i in range(3):
        if packed >> i & 1:
            own = Reader(sections[i])
            n = own.number()
            sections[i] = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_FILTERS).decompress(own.raw[own.at :], n)
            if len(sections[i]) != n:
                raise ValueError("a compressed section is damaged")
    inst, addr = Reader(sections[1]), Reader(sections[2])
    cache, here = Addresses(), source[1] if source else 0
    w = Window(data=sections[0], size=length, source=source, from_target=bool(flags & TARGET), checksum=check)
    ops, raw = w.ops, inst.raw
    while inst.at < len(raw):
        steps = _STEPS[raw[inst.at]]
        inst.at += 1
        for op, n, mode in steps:
            n = n or inst.number()
            if op == COPY:
                ops.append(("copy", n, cache.decode(mode, here, addr)))
            else:
                ops.append(("add" if op == ADD else "run", n, None))
            here += n
    if r.at != end:
        raise ValueError("a window is damaged")
    return w


def apply_window(w: Window, source: bytes) -> bytes:
    """The target bytes of a window, given its source segment."""
    out, at, size = bytearray(), 0, len(source)
    for op, n, address in w.ops:
        if op == "add":
            out += w.data[at : at + n]
            at += n
        elif op == "run":
            out += w.data[at : at + 1] * n
            at += 1
        elif address + n <= size:
            out += source[address : address + n]
        else:
            head = source[address:] if address < size else b""
            out += head
            left, place = n - len(head), max(address - size, 0)
            while left > 0:  # a copy may overlap what it makes
                piece = out[place : place + left]
                out += piece
                left -= len(piece)
                place += len(piece)
    if len(out) != w.size or w.checksum is not None and zlib.adler32(bytes(out)) != w.checksum:
        raise ValueError("window is damaged")
    return bytes(out)


def header(app: bytes = b"", secondary: bool = False) -> bytes:
    flags = (DECOMPRESS if secondary else 0) | (APP_HEADER if app else 0)
    return MAGIC + bytes([flags]) + (bytes([LZMA]) if secondary else b"") + (number(len(app)) + app if app else b"")


def read_header(r: Reader) -> dict[str, object]:
    if r.take(4) != MAGIC:
        raise ValueError("no VCDIFF data")
    flags = r.byte()
    if flags & ~(DECOMPRESS | APP_HEADER):
        raise ValueError("code tables of their own aren't read")
    if flags & DECOMPRESS and (kind := r.byte()) != LZMA:
        raise ValueError(f"secondary compressor {kind} isn't known")
    return {"secondary": bool(flags & DECOMPRESS), "app": r.take(r.number()) if flags & APP_HEADER else b""}


def _words(data: bytes, n: int) -> np.ndarray:
    """The n bytes from each position on, as one number."""
    kind = {4: "<u4", 8: "<u8"}[n]
    size = len(data) - n + 1
    return np.ndarray((max(0, size),), dtype=kind, buffer=data, strides=(1,)) if size > 0 else np.zeros(0, dtype=kind)


def _previous(words: np.ndarray) -> np.ndarray:
    """For each position the last one before it with the same word, or -1."""
    order = np.argsort(words, kind="stable")
    same = words[order][1:] == words[order][:-1]
    out = np.full(len(words), -1, dtype=np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    return matched(a, 0, len(a), b, 0, len(b))


def matched(a: bytes, i: int, i_end: int, b: bytes, j: int, j_end: int) -> int:
    """How many bytes of a from i on equal those of b from j on: growing pieces are compared, and the first that differ by their
    lowest bit that does."""
    most, n, step = min(i_end - i, j_end - j), 0, 16
    while n < most:
        k = min(step, most - n)
        x, y = a[i + n : i + n + k], b[j + n : j + n + k]
        if x != y:
            if k > 256:
                return n + int((np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)).argmax())
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + ((differ & -differ).bit_length() - 1 >> 3)
        n, step = n + k, step << 2
    return max(n, 0)


def runs(data: bytes) -> list[tuple[int, int]]:
    """(place, length) of runs of MIN_RUN equal bytes or more."""
    if not data:
        return []
    x = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    lengths = np.diff(np.r_[starts, len(x)])
    long = lengths >= MIN_RUN
    return list(zip(starts[long].tolist(), lengths[long].tolist()))


def string_match(new: bytes, matches: list[tuple[int, int, int]], base_size: int, level: Level) -> Window:
    """Instructions for ``new`` from matches with the source (kind, size, place as gdelta's): what they leave is looked for in
    the target itself, by runs and by words of four bytes, lazily, and added where it isn't found."""
    w = Window(size=len(new))
    words = _words(new, MIN_COPY)
    back = _previous(words) if len(words) else np.zeros(0, dtype=np.int64)
    # the next place, from each on, whose word was met before
    nexts = np.minimum.accumulate(np.where(back >= 0, np.arange(len(back)), len(new))[::-1])[::-1].tolist()
    back, many, chain = back.tolist(), len(back), level.chain
    data, ops = bytearray(), w.ops

    def add(a: int, b: int) -> None:
        if b > a:
            ops.append(("add", b - a, None))
            data.extend(new[a:b])

    def best(at: int, end: int) -> tuple[int, int]:
        """(length, place) of the longest earlier occurrence among those tried; copies that a long number would cost more than
        they save are left out."""
        found, place, tries = 0, -1, chain
        other = back[at] if at < many else -1
        while other >= 0 and tries:
            if not found or at + found < end and new[at + found] == new[other + found]:  # else it is no longer than the one found
                n = MIN_COPY + matched(new, at + MIN_COPY, end, new, other + MIN_COPY, end)
                if n > found:
                    found, place = n, other
            other, tries = back[other], tries - 1
        if found and (found == 4 and at - place > 1 << 14 or found == 5 and at - place > 1 << 21):
            return 0, -1
        return found, place

    def fill(a: int, b: int) -> None:
        """The stretch from a to b without the source."""
        literal, at = a, a
        own_runs = [(a + s, n) for s, n in runs(new[a:b])]
        r = 0
        while at < b:
            while r < len(own_runs) and own_runs[r][0] < at:
                r += 1
            hit = nexts[at] if at < many else b
            hit = hit if hit <= b - MIN_COPY else b  # words that end within the stretch
            run = own_runs[r][0] if r < len(own_runs) else b
            if run <= hit and run < b:
                add(literal, run)
                ops.append(("run", own_runs[r][1], None))
                data.append(new[run])
                at = literal = run + own_runs[r][1]
                continue
            if hit >= b:
                break
            size, place = best(hit, b)
            if 0 < size <= level.lazy and hit + 1 + MIN_COPY <= b:
                later, later_place = best(hit + 1, b)
                if later > size + 1:
                    hit, size, place = hit + 1, later, later_place
            if size < MIN_COPY:
                at = hit + 1
                continue
            size = min(size, run - hit) if run - hit >= MIN_COPY else size
            add(literal, hit)
            ops.append(("copy", size, base_size + place))
            at = literal = hit + size
        add(literal, b)

    at = 0
    for kind, size, place in matches:
        if kind:
            ops.append(("copy", size, place))
        else:
            fill(at, at + size)
        at += size
    w.data = bytes(data)
    return w


def listed(w: Window, target_size: int = 0) -> list[tuple[str, int, int | None]]:
    return list(w.ops)


class Encoder:
    """A stream of windows against one source: feed() returns what is ready, finish() the rest."""

    def __init__(self, base: bytes, match, window: int = 1 << 21, checksum: bool = True, secondary: bool = False, app: bytes = b"", level: str = "default"):
        self.base, self.match, self.window, self.level = base, match, window, LEVELS[level]
        self.checksum, self.secondary, self.held = checksum, secondary, bytearray()
        self.ready = header(app, secondary)
        self.written = False

    def _emit(self, new: bytes) -> bytes:
        w = string_match(new, self.match(new, self.base, self.level.stride), len(self.base), self.level)
        w = replace(w, source=(0, len(self.base)) if self.base else None, checksum=zlib.adler32(new) if self.checksum else None)
        self.written = True
        return pack_window(w, self.secondary)

    def feed(self, new: bytes) -> bytes:
        out, self.ready = self.ready, b""
        self.held += new
        while len(self.held) >= self.window:
            out += self._emit(bytes(self.held[: self.window]))
            del self.held[: self.window]
        return out

    def finish(self) -> bytes:
        out = self.feed(b"")
        if self.held or not self.written:
            out += self._emit(bytes(self.held))
            self.held.clear()
        return out


class Decoder:
    """Undoes a stream that comes in any pieces: feed() returns the target bytes of the windows that are whole by then."""

    def __init__(self, base: bytes):
        self.base, self.raw, self.head, self.target, self.keep = base, b"", None, bytearray(), True

    def feed(self, delta: bytes) -> bytes:
        self.raw += delta
        r, out = Reader(self.raw), b""
        try:
            if self.head is None:
                self.head = read_header(r)
                self.raw, r = self.raw[r.at :], Reader(self.raw[r.at :])
            while r.at < len(r.raw):
                begin = r.at
                w = read_window(r)
                place, size = w.source or (0, 0)
                piece = apply_window(w, bytes((self.target if w.from_target else self.base)[place : place + size]))
                self.target += piece
                out += piece
        except IndexError:
            begin = r.at if self.head is None else begin
            self.raw = self.raw[begin:] if self.head is not None else self.raw
            return out
        self.raw = b""
        return out

    def finish(self) -> None:
        if self.raw or self.head is None:
            raise ValueError("the stream ends within a window")


def encode(new: bytes, base: bytes, match, checksum: bool = True, window: int = 1 << 21, secondary: bool = False, app: bytes = b"", level: str = "default") -> bytes:
    coder = Encoder(base, match, window, checksum, secondary, app, level)
    return coder.feed(new) + coder.finish()


def windows(delta: bytes) -> tuple[dict[str, object], list[Window]]:
    """The header's fields and all windows."""
    r = Reader(delta)
    try:
        head, found = read_header(r), []
        while r.at < len(delta):
            found.append(read_window(r))
    except (IndexError, KeyError, lzma.LZMAError) as e:
        raise ValueError(f"damaged VCDIFF data: {e}") from e
    return head, found


def decode(delta: bytes, base: bytes) -> bytes:
    target = bytearray()
    for w in windows(delta)[1]:
        place, size = w.source or (0, 0)
        target += apply_window(w, bytes((target if w.from_target else base)[place : place + size]))
    return bytes(target)


def instructions(delta: bytes) -> list[tuple[str, int, int | None]]:
    return [op for w in windows(delta)[1] for op in w.ops]


def describe(delta: bytes) -> dict[str, object]:
    """What the headers say: application header, secondary compressor, and for each window its sizes."""
    head, found = windows(delta)
    return head | {"windows": [{"size": w.size, "source": w.source, "instructions": len(w.ops), "data": len(w.data), "checksum": w.checksum} for w in found]}


def recode(delta: bytes, secondary: bool | None = None, app: bytes | None = None) -> bytes:
    """The same instructions written anew: with or without compressed sections, with another application header."""
    head, found = windows(delta)
    packed = head["secondary"] if secondary is None else secondary
    return header(head["app"] if app is None else app, packed) + b"".join(pack_window(w, packed) for w in found)


def _pieces(found: list[Window]) -> list[tuple[str, int, object]]:
    """What a delta's whole target is made of: (data, size, bytes), (run, size, byte) or (copy, size, place in the base)."""
    out: list[tuple[str, int, object]] = []
    starts: list[int] = []
    total = 0

    def put(piece):
        nonlocal total
        starts.append(total)
        out.append(piece)
        total += piece[1]

    for w in found:
        begin, at = total, 0
        place, size = w.source or (0, 0)
        for op, n, address in w.ops:
            if op == "add":
                put(("data", n, w.data[at : at + n]))
                at += n
            elif op == "run":
                put(("run", n, w.data[at : at + 1]))
                at += 1
            else:
                head = max(0, min(n, size - address))
                if head and not w.from_target:
                    put(("copy", head, place + address))
                elif head:
                    for piece in cut(out, starts, place + address, head):
                        put(piece)
                rest, where = n - head, begin + max(0, address - size)
                while rest:  # what a copy makes may be part of what it copies
                    take = min(rest, total - where)
                    for piece in cut(out, starts, where, take):
                        put(piece)
                    rest, where = rest - take, where + take
    return out


def cut(pieces: list[tuple[str, int, object]], starts: list[int], at: int, size: int) -> list[tuple[str, int, object]]:
    """The pieces of a stretch: the first is found by halving."""
    from bisect import bisect_right

    out, k = [], bisect_right(starts, at) - 1
    while size:
        kind, n, what = pieces[k]
        skip = at - starts[k]
        take = min(size, n - skip)
        out.append((kind, take, what[skip : skip + take] if kind == "data" else what if kind == "run" else what + skip))
        at, size, k = at + take, size - take, k + 1
    return out


def merge(first: bytes, second: bytes, base_size: int, window: int = 1 << 21) -> bytes:
    """One delta for both in turn, without the base's bytes: the second's copies from its source are led through the first."""
    from itertools import accumulate

    through = _pieces(windows(first)[1])
    starts = [0, *accumulate(n for _, n, _ in through)][:-1]
    made = _pieces(windows(second)[1])
    pieces: list[tuple[str, int, object]] = []
    for kind, n, what in made:
        pieces += cut(through, starts, what, n) if kind == "copy" else [(kind, n, what)]
    out, w, data = header(), Window(source=(0, base_size) if base_size else None), bytearray()

    def flush() -> bytes:
        nonlocal w, data
        raw = pack_window(replace(w, data=bytes(data)))
        w, data = Window(source=w.source), bytearray()
        return raw

    for kind, n, what in pieces:
        while n:
            take = min(n, window - w.size)
            last = w.ops[-1] if w.ops else None
            if kind == "data":
                if last and last[0] == "add":
                    w.ops[-1] = ("add", last[1] + take, None)
                else:
                    w.ops.append(("add", take, None))
                data += what[:take]
                what = what[take:]
            elif kind == "run":
                w.ops.append(("run", take, None))
                data += what
            else:
                if last and last[0] == "copy" and last[2] + last[1] == what:
                    w.ops[-1] = ("copy", last[1] + take, last[2])
                else:
                    w.ops.append(("copy", take, what))
                what += take
            n -= take
            w.size += take
            if w.size == window:
                out += flush()
    return out + (flush() if w.size or out == header() else b"")
