"""Delta and lossless codecs: pure functions on bytes; decode(encode(new, base), base) == new for each."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib

import numpy as np

from deltaloom.functions import vcdiff
from deltaloom.functions.bytescan import _GEAR, GEAR, U64, rolling
from deltaloom.functions.vcdiff import _words, common_prefix, matched

WORD, TRIM = 8, 16


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if not n or a[-1] != b[-1]:
        return 0
    if a[-n:] == b[-n:]:
        return n
    x, y = np.frombuffer(a, np.uint8)[len(a) - n :], np.frombuffer(b, np.uint8)[len(b) - n :]
    return int((x != y)[::-1].argmax())


def _slots(words: np.ndarray, bits: int) -> np.ndarray:
    """Slots of words by a multiplication; the top bits of the product are the best mixed."""
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _found(new: bytes, base: bytes, head: int, end: int, stop: int, stride: int) -> np.ndarray:
    """For each position of new a place in the base with the same word of eight bytes, or -1: a table of the base's words, of
    which the last in a slot stays, looked up for all positions at once."""
    out = np.full(max(0, stop), -1, dtype=np.int64)
    ours, theirs = _words(new[:stop], WORD), _words(base[:end], WORD)
    if len(ours) <= head or len(theirs) <= head:
        return out
    bits = max(10, (end - head).bit_length() + 2)
    table = np.full(1 << bits, -1, dtype=np.int32)
    places = np.arange(head, len(theirs), stride)
    table[_slots(theirs[places], bits)] = places
    own = ours[head:].copy()
    place = table[_slots(own, bits)]
    same = (place >= 0) & (theirs[np.maximum(place, 0)] == own)
    out[head : head + len(own)][same] = place[same]
    return out


def _match(new: bytes, base: bytes, stride: int = 1, allowed: np.ndarray | None = None, reverse: bool = False) -> list[tuple[int, int, int]]:
    """Instructions (kind, length, offset): copies (1) of the base and literals (0, offset in new), greedy by words.

    ``reverse`` takes, of the place found and the one right after the last copy, the one with the longer match.
    """
    head = common_prefix(new, base)
    tail = min(common_suffix(new, base), len(new) - head, len(base) - head)
    head, tail = head if head > TRIM else 0, tail if tail > TRIM else 0
    out = [(1, head, 0)] if head else []
    stop, end = len(new) - tail, len(base) - tail
    place = _found(new, base, head, end, stop, stride)
    if allowed is not None:
        place[: max(0, stop - WORD + 1)][~allowed[WORD - 1 : max(WORD - 1, stop)]] = -1
    hits = np.flatnonzero(place >= 0)
    at = literal = head
    k, after = 0, head
    while True:
        k = int(np.searchsorted(hits, at)) if k < len(hits) and hits[k] < at else k
        if k >= len(hits):
            break
        at = int(hits[k])
        found = int(place[at])
        size = WORD + matched(new, at + WORD, stop, base, found + WORD, end)
        if reverse and after + WORD <= end and base[after : after + WORD] == new[at : at + WORD]:
            other = WORD + matched(new, at + WORD, stop, base, after + WORD, end)
            found, size = (after, other) if other > size else (found, size)
        back = common_suffix(new[literal:at], base[head:found]) if at > literal else 0
        at, found, size = at - back, found - back, size + back
        if at > literal:
            out.append((0, at - literal, literal))
        out.append((1, size, found))
        at = literal = at + size
        after = found + size
    if literal < stop:
        out.append((0, stop - literal, literal))
    if tail:
        out.append((1, tail, end))
    return out


def _write(new: bytes, ops: list[tuple[int, int, int]]) -> bytes:
    inst, data = bytearray(), bytearray()
    for kind, size, at in ops:
        rest = size >> 6
        inst.append(kind | bool(rest) << 1 | (size & 63) << 2)
        inst += varint(rest) if rest else b""
        if kind:
            inst += varint(at)
        else:
            data += new[at : at + size]
    return varint(len(inst)) + bytes(inst) + bytes(data)


def gdelta_instructions(delta: bytes) -> list[tuple[str, int, int | None]]:
    """(op, length, base offset) of the delta; literals have no offset."""
    size, at = read_varint(delta, 0)
    end, out = at + size, []
    while at < end:
        head = delta[at]
        at, length = at + 1, head >> 2
        if head & 2:
            rest, at = read_varint(delta, at)
            length |= rest << 6
        offset = None
        if head & 1:
            offset, at = read_varint(delta, at)
        out.append(("copy" if head & 1 else "insert", length, offset))
    return out


def gdelta_encode(new: bytes, base: bytes, stride: int = 1, reverse: bool = False) -> bytes:
    """stride: the base's words at every so many bytes are found; reverse: see _match()."""
    return _write(new, _match(new, base, stride, reverse=reverse))


def gdelta_left_encode(new: bytes, base: bytes) -> bytes:
    """The twin by left-shifted hashes: words are found by the gear hash of their eight bytes, compared, and written alike."""
    return _write(new, _match_left(new, base))


def _match_left(new: bytes, base: bytes) -> list[tuple[int, int, int]]:
    """As _match(), by a dictionary of word hashes met from left to right; an equal hash of another word is no match."""
    mask = np.uint64(U64)
    hashed = lambda d: [sum((GEAR[np.frombuffer(d, np.uint8)[i : len(d) - WORD + 1 + i]] << np.uint64(WORD - 1 - i)) & mask for i in range(WORD))][0]
    out, literal, at = [], 0, 0
    if len(new) < WORD or len(base) < WORD:
        return [(0, len(new), 0)] if new else []
    theirs = dict(zip(hashed(base).tolist(), range(len(base) - WORD + 1)))
    ours = hashed(new).tolist()
    while at < len(ours):
        found = theirs.get(ours[at])
        if found is None or base[found : found + WORD] != new[at : at + WORD]:
            at += 1
            continue
        size = WORD + common_prefix(new[at + WORD :], base[found + WORD :])
        back = common_suffix(new[literal:at], base[:found])
        if at - back > literal:
            out.append((0, at - back - literal, literal))
        out.append((1, size + back, found - back))
        at = literal = at + size
    if literal < len(new):
        out.append((0, len(new) - literal, literal))
    return out


def gdelta_sketch_encode(new: bytes, base: bytes, new_bits: int, base_bits: int) -> bytes:
    """Looks a word up only where the sketches agree on the bit its hash falls on."""
    same = ~(new_bits ^ base_bits)
    agree = np.array([same >> b & 1 for b in range(64)], dtype=bool)
    return _write(new, _match(new, base, allowed=agree[(rolling(new) & np.uint64(63)).astype(np.int64)]))


def gdelta_decode(delta: bytes, base: bytes) -> bytes:
    size, at = read_varint(delta, 0)
    at, out = at + size, []
    for op, length, offset in gdelta_instructions(delta):
        if op == "copy":
            out.append(base[offset : offset + length])
        else:
            out.append(delta[at : at + length])
            at += length
    return b"".join(out)


EDELTA_MIN, EDELTA_MAX = 12, 64
#: Three bits: a word ends at one in eight places beyond its least length.
EDELTA_MASK = 0b10101 << 4
#: Words of the base taken at first, by how much their number grows each time, and words of the input that are tried for it.
BASE_WORDS, BASE_GROWTH, TRIED_WORDS = 5, 3, 5


def words_from(data: bytes, at: int, n: int | None = None) -> list[tuple[int, int]]:
    """(offset, size) of the next n content-defined words of about 12 to 64 bytes (all of them without n)."""
    out = []
    while at < len(data) and (n is None or len(out) < n):
        left, h = min(len(data) - at, EDELTA_MAX), 0
        for size in range(EDELTA_MIN, left):
            h = (h << 1) + _GEAR[data[at + size]] & 0xFFFFFFFF
            if not h & EDELTA_MASK:
                break
        else:
            size = left
        out.append((at, size))
        at += size
    return out


def micro_chunks(data: bytes) -> list[tuple[int, int]]:
    return words_from(data, 0)


def edelta_encode(new: bytes, base: bytes) -> bytes:
    """Content-defined words of the new data are looked up among those of the base; matches grow both ways.

    The base is cut into words lazily: a few, then three times as many each time that some words of the input in a row are
    not among them, until all are known. After a match the search goes on behind it in both.
    """
    words: dict[bytes, int] = {}
    known, grow, missed = 0, BASE_WORDS, 0
    out, literal = bytearray(), 0

    def more() -> None:
        nonlocal known, grow
        for a, n in words_from(base, known, grow):
            words.setdefault(base[a : a + n], a)
            known = a + n
        grow *= BASE_GROWTH

    def flush(end: int) -> None:
        if end > literal:
            out.extend((end - literal).to_bytes(4, "little") + new[literal:end])

    more()
    at = 0
    while at < len(new):
        _, size = words_from(new, at, 1)[0]
        found = words.get(new[at : at + size])
        while found is None and missed >= TRIED_WORDS and known < len(base):
            more()
            found = words.get(new[at : at + size])
        if found is None:
            missed += 1
            at += size
            continue
        missed = 0
        size += common_prefix(new[at + size :], base[found + size :])
        back = common_suffix(new[literal:at], base[:found])
        flush(at - back)
        out += (size + back | 1 << 31).to_bytes(4, "little") + (found - back).to_bytes(4, "little")
        at = literal = at + size
        if found + size > known:
            known = found + size
    flush(len(new))
    return bytes(out)


def edelta_decode(delta: bytes, base: bytes) -> bytes:
    out, at = [], 0
    while at < len(delta):
        head = int.from_bytes(delta[at : at + 4], "little")
        size, at = head & (1 << 31) - 1, at + 4
        if head >> 31:
            offset = int.from_bytes(delta[at : at + 4], "little")
            out.append(base[offset : offset + size])
            at += 4
        else:
            out.append(delta[at : at + size])
            at += size
    return b"".join(out)


def vcdiff_encode(new: bytes, base: bytes, checksum: bool = True, window: int = 1 << 21, secondary: bool = False, app: bytes = b"", level: str = "default") -> bytes:
    return vcdiff.encode(new, base, _match, checksum, window, secondary, app, level)


def vcdiff_stream(base: bytes, **options) -> vcdiff.Encoder:
    """An encoder that is fed piece by piece."""
    return vcdiff.Encoder(base, _match, **options)


vcdiff_decode, vcdiff_instructions, merge_deltas = vcdiff.decode, vcdiff.instructions, vcdiff.merge


def zdelta_encode(new: bytes, *refs: bytes, level: int = 6) -> bytes:
    """Deflate with up to four references as its dictionary, each with its last bytes in equal shares of the window."""
    z = zlib.compressobj(level, zdict=dictionary(refs))
    return z.compress(new) + z.flush()


def zdelta_decode(delta: bytes, *refs: bytes) -> bytes:
    z = zlib.decompressobj(zdict=dictionary(refs))
    return z.decompress(delta) + z.flush()


def dictionary(refs: tuple[bytes, ...]) -> bytes:
    """32 KiB at most of the references: what shorter ones leave of their share goes to the others."""
    if not 0 < len(refs) <= 4:
        raise ValueError("one to four references")
    share, left = {}, 32768
    for k, i in enumerate(sorted(range(len(refs)), key=lambda i: len(refs[i]))):
        share[i] = min(len(refs[i]), left // (len(refs) - k))
        left -= share[i]
    return b"".join(r[len(r) - share[i] :] for i, r in enumerate(refs))


def zdelta_stream(*refs: bytes, level: int = 6):
    """A deflate object that is fed piece by piece: compress(piece), then flush()."""
    return zlib.compressobj(level, zdict=dictionary(refs))


def zdelta_stream_decode(*refs: bytes):
    return zlib.decompressobj(zdict=dictionary(refs))


def compress(data: bytes, codec: str = "zstd", level: int = 1) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    import pyarrow as pa

    return pa.Codec("lz4_raw").compress(data, asbytes=True)


def decompress(raw: bytes, size: int, codec: str = "zstd") -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, size))
    import pyarrow as pa

    return pa.Codec("lz4_raw").decompress(raw, decompressed_size=size, asbytes=True) if size else b""


def _unlzw(data: bytes) -> bytes:
    """Undoes the compress program's format: codes of growing width, low bits first, in groups of eight."""
    if len(data) < 3:
        raise ValueError("no compressed data")
    most, block = data[2] & 31, bool(data[2] & 128)
    table = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    width, at, out, last = 9, 3 * 8, [], b""
    total, group = len(data) * 8, 0
    raw = int.from_bytes(data, "little")
    while at + width <= total:
        code = raw >> at & (1 << width) - 1
        at, group = at + width, (group + 1) % 8
        if block and code == 256:
            at, group, table, width, last = at + (-group % 8) * width, 0, [bytes([i]) for i in range(256)] + [b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("compressed data is damaged")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last and len(table) < 1 << most:
            table.append(last + entry[:1])
        if len(table) == 1 << width and width < most:
            at, group, width = at + (-group % 8) * width, 0, width + 1
        last = entry
    return b"".join(out)


#: Outer compressions that a source unpacks: first bytes, undo, do.
OUTER = {
    "gzip": (b"\x1f\x8b", gzip.decompress, lambda d: gzip.compress(d, mtime=0)),
    "bzip2": (b"BZh", bz2.decompress, bz2.compress),
    "xz": (b"\xfd7zXZ\x00", lzma.decompress, lzma.compress),
    "compress": (b"\x1f\x9d", _unlzw, lambda d: gzip.compress(d, mtime=0)),
}


def outer_kind(data: bytes) -> str | None:
    return next((name for name, (magic, _, _) in OUTER.items() if data.startswith(magic)), None)


def unpack_outer(data: bytes) -> bytes:
    kind = outer_kind(data)
    return OUTER[kind][1](data) if kind else data


def repack_outer(data: bytes, kind: str | None) -> bytes:
    """Undoes unpack_outer(), with the kind that outer_kind() found; bytes may differ from the first packing, contents don't."""
    return OUTER[kind][2](data) if kind else data


ENCODERS = {"gdelta": gdelta_encode, "gdelta_left": gdelta_left_encode, "edelta": edelta_encode, "vcdiff": vcdiff_encode, "zdelta": zdelta_encode}
DECODERS = {"gdelta": gdelta_decode, "gdelta_sketch": gdelta_decode, "gdelta_left": gdelta_decode, "edelta": edelta_decode, "vcdiff": vcdiff_decode, "zdelta": zdelta_decode}
