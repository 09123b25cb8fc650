import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaloom.config import SMALL, EngineConfig
from deltaloom.functions import bytescan, codecs, vcdiff

EDGES = [0, 1, 31, 32, 511, 512, 513, 1023, 1024, 1025, 4095, 4096, 4097, 20_000]


def noise(n, seed=0):
    return random.Random(seed).randbytes(n)


def scalar_hash(data):
    fp, out = 0, []
    for b in data:
        fp = ((fp >> 8) + int(bytescan.GEAR[b])) & bytescan.U64
        out.append(fp)
    return out


@pytest.mark.parametrize("data", [noise(5000), b"\0" * 3000, b"abcdefgh" * 300, "Ähé の".encode() * 200])
def test_rolling_hash_equals_the_recurrence(data):
    assert bytescan.rolling(data).tolist() == scalar_hash(data)


def test_bitmap_sketch_by_loop():
    data, bits = noise(4000), 0
    for fp in scalar_hash(data):
        if not fp & int(bytescan.MASKS[fp & 63]):
            bits |= 1 << (fp & 63)
    assert bytescan.bitmap_sketch(data) == bits


def test_features_by_loop():
    data = noise(3000)
    h, sampled = 0, []
    for b in data:
        h = ((h >> 1) + int(bytescan.GEAR[b])) & 0xFFFFFFFF
        sampled += [h] if not h & bytescan.ODESS_MASK else []
    m, a = bytescan.linear_params(4)
    assert bytescan.odess_features(data, 4) == [max((int(m[i]) * x + int(a[i])) % (1 << 32) for x in sampled) for i in range(4)]
    windows = []
    for i in range(len(data) - 31):
        x = 0
        for b in data[i : i + 32]:
            x = (x * 37 + b) % 1_000_000_007
        windows.append(x)
    assert bytescan.ntransform_features(data, 4) == [max((int(m[i]) * x + int(a[i])) % (1 << 32) for x in windows) for i in range(4)]
    assert bytescan.ntransform_features(b"short", 3) == [0, 0, 0]


def loop_cut(kind, p, start, c):
    """Each chunker as a plain loop over bytes."""
    gear, n = bytescan._GEAR, min(len(p) - start, c.max_size)
    low = c.plain_min_size if kind.startswith("plain") else c.min_size
    middle, fp = min(c.normal_size, n), 0
    if kind in ("normalized", "normalized2", "unified") and n <= low:
        return n
    if kind == "unified":
        for i in range(n):
            fp = ((fp >> 8) + gear[p[start + i]]) & bytescan.U64
            if i >= low and not fp & (bytescan.CUT_S if i < middle else bytescan.CUT_L):
                return i
        return n
    two = kind.endswith("2")
    low = min(low, n) // 2 * 2 if kind == "plain2" else min(low, n)
    for i in range(low, n - two, 1 + two):
        mask = bytescan.CUT if kind.startswith("plain") else bytescan.CUT_S if i < middle else bytescan.CUT_L
        if not two:
            fp = ((fp >> 8 if kind == "normalized" else fp << 1) + gear[p[start + i]]) & bytescan.U64
            if not fp & mask:
                return i
            continue
        fp = ((fp << 2) + (gear[p[start + i]] << 1)) & bytescan.U64
        if not fp & (mask << 1):
            return i
        fp = (fp + gear[p[start + i + 1]]) & bytescan.U64
        if not fp & mask:
            return i + 1
    return n


@pytest.mark.parametrize("kind", ["normalized", "normalized2", "plain", "plain2", "unified"])
def test_cuts_equal_loops(kind):
    for config in (SMALL, EngineConfig(), EngineConfig(min_size=30, normal_size=65, max_size=301, plain_min_size=7), EngineConfig(min_size=512, normal_size=2049, max_size=2500, plain_min_size=301)):
        c = EngineConfig(**{**config.__dict__, "chunker": kind})
        for data in (noise(60_000, 3), b"\0" * 40_000, b"abcdefgh" * 5000, ("Größe " * 8000).encode(), noise(6145, 1), noise(3, 1)):
            at = 0
            for offset, size, bits in bytescan.chunks(data, c):
                assert offset == at and size == loop_cut(kind, data, at, c)
                if bits is not None:
                    assert bits == bytescan.bitmap_sketch(data[at : at + size], 4)
                at += size


def test_batched_sketches_equal_single_ones():
    many = [noise(n, n) for n in (0, 1, 15, 16, 17, 300, 5000, 0, 9000)]
    assert bytescan.bitmap_sketches(many).tolist() == [bytescan.bitmap_sketch(d) for d in many]
    assert bytescan.bitmap_sketches([]).tolist() == []
    fp = 0
    for b in many[5]:
        fp = ((fp << 1) + bytescan._GEAR[b]) & bytescan.U64
    assert bytescan.gear_hash(many[5]) == fp and bytescan.gear_hash(b"") == 0


def test_finesse_by_loop():
    data = noise(2000, 8)
    hashes = []
    for i in range(len(data) - 31):
        x = 0
        for b in data[i : i + 32]:
            x = (x * 37 + b) % 1_000_000_007
        hashes.append(x)
    cuts = [len(hashes) * k // 8 for k in range(9)]
    best = [max(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    groups = [sorted(best[i : i + 4], reverse=True) for i in (0, 4)]
    assert bytescan.finesse_features(data, 8) == [g[k] for k in range(4) for g in groups]
    assert bytescan.finesse_features(b"short", 8) == [0] * 8 and bytescan.finesse_features(data, 6) == [0] * 6


@pytest.mark.parametrize("chunker", ["normalized", "normalized2", "plain", "plain2", "unified", "fixed"])
@pytest.mark.parametrize("size", EDGES)
def test_chunks_cover_the_data(chunker, size):
    c = EngineConfig(**{**SMALL.__dict__, "chunker": chunker})
    for data in (noise(size), b"\0" * size):
        found = bytescan.chunks(data, c)
        assert b"".join(data[a : a + n] for a, n, _ in found) == data
        assert all(0 < n <= c.max_size for _, n, _ in found)
        if chunker in ("normalized", "normalized2", "unified"):
            assert all(n >= c.min_size for _, n, _ in found[:-1])


def edited(data, seed):
    r, out = random.Random(seed), bytearray(data)
    for _ in range(r.randint(0, 12)):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randint(0, 40)] = r.randbytes(r.randint(0, 40))
    return bytes(out)


PAIRS = [(b"", b""), (b"", b"x"), (b"x", b""), (noise(5000), noise(5000)), (b"a" * 900, b"a" * 700), (noise(300), noise(300)[:200])]
PAIRS += [(edited(noise(8000), s), noise(8000)) for s in range(12)]


@pytest.mark.parametrize("name", sorted(codecs.ENCODERS))
def test_delta_round_trip(name):
    for new, base in PAIRS:
        delta = codecs.ENCODERS[name](new, base)
        assert codecs.DECODERS[name](delta, base) == new
    if name not in ("zdelta", "gdelta_left"):
        assert len(codecs.ENCODERS[name](noise(8000), noise(8000))) < 200


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.binary(max_size=20)), max_size=5))
def test_delta_round_trip_of_any_bytes(base, edits):
    new = base
    for at, piece in edits:
        new = new[:at] + piece + new[at + len(piece) // 2 :]
    for name, encode in codecs.ENCODERS.items():
        assert codecs.DECODERS[name](encode(new, base), base) == new
    guided = codecs.gdelta_sketch_encode(new, base, bytescan.bitmap_sketch(new), bytescan.bitmap_sketch(base))
    assert codecs.gdelta_decode(guided, base) == new


def test_instructions_and_merge():
    base = noise(4000)
    new = base[:2000] + b"hello" + base[2100:]
    ops = codecs.gdelta_instructions(codecs.gdelta_encode(new, base))
    assert ops == [("copy", 2000, 0), ("insert", 5, None), ("copy", 1900, 2100)]
    later = edited(new, 3)
    merged = codecs.merge_deltas(codecs.vcdiff_encode(new, base), codecs.vcdiff_encode(later, new), len(base))
    assert codecs.vcdiff_decode(merged, base) == later
    assert sum(n for _, n, _ in codecs.vcdiff_instructions(merged)) == len(later)
    assert ("run", 50, None) in codecs.vcdiff_instructions(codecs.vcdiff_encode(b"q" * 50, b""))


def test_damage_is_noticed():
    base = noise(3000)
    delta = bytearray(codecs.vcdiff_encode(base[:1000] + noise(200, 1) + base[1000:], base))
    delta[-150] ^= 1
    with pytest.raises(ValueError):
        codecs.vcdiff_decode(bytes(delta), base)


def test_code_table_and_outer_compression():
    import bz2
    import gzip
    import lzma

    assert len(vcdiff.CODE_TABLE) == 256
    assert vcdiff.CODE_TABLE[163] == ((1, 1, 0), (3, 4, 0)) and vcdiff.CODE_TABLE[255] == ((3, 4, 8), (1, 1, 0))
    for pack in (gzip.compress, bz2.compress, lzma.compress, bytes):
        assert codecs.unpack_outer(pack(b"data")) == b"data"


def test_sketches_of_similar_data_agree():
    a = noise(8000)
    same = bin(bytescan.bitmap_sketch(a) ^ bytescan.bitmap_sketch(edited(a, 5))).count("1")
    assert same <= np.bitwise_count(np.uint64(bytescan.bitmap_sketch(a) ^ bytescan.bitmap_sketch(noise(8000, 9)))) + 8


def synthetic(seed, adds=0.1):
    """A source of 8 to 24 KiB and a target of copies from it with a share of adds, lengths exponential up to 512."""
    r = np.random.RandomState(seed)
    source = r.bytes(8192 + r.randint(16384))
    out, want = bytearray(), 8192 + r.randint(16384)
    while len(out) < want:
        n = int(min(512, 1 + r.exponential(128)))
        if r.rand() < adds:
            out += r.bytes(n)
        else:
            at = r.randint(len(source) - n)
            out += source[at : at + n]
    return source, bytes(out)


@pytest.mark.parametrize("options", [{}, {"level": "fastest"}, {"level": "slow"}, {"window": 1000}, {"secondary": True}, {"app": b"a//b", "checksum": False}, {"window": 4096, "secondary": True, "app": b"x"}])
def test_vcdiff_round_trip_of_synthetic_pairs(options):
    for seed in range(6):
        source, target = synthetic(seed)
        delta = codecs.vcdiff_encode(target, source, **options)
        assert codecs.vcdiff_decode(delta, source) == target
        assert len(delta) < len(target) / 2 or options.get("window") or options.get("level")
        found = vcdiff.describe(delta)
        assert found["app"] == options.get("app", b"") and sum(w["size"] for w in found["windows"]) == len(target)
        assert codecs.vcdiff_decode(codecs.vcdiff_encode(source, b"", **options), b"") == source


def test_vcdiff_streams_in_any_pieces():
    source, target = synthetic(9)
    coder, out, r = codecs.vcdiff_stream(source, window=3000), b"", random.Random(1)
    at = 0
    while at < len(target):
        n = r.randrange(1, 2000)
        out += coder.feed(target[at : at + n])
        at += n
    out += coder.finish()
    for step in (1, 7, 5000):
        decoder = vcdiff.Decoder(source)
        assert b"".join(decoder.feed(out[i : i + step]) for i in range(0, len(out), step)) == target
        decoder.finish()
    cut_off = vcdiff.Decoder(source)
    cut_off.feed(out[:-1])
    with pytest.raises(ValueError):
        cut_off.finish()
    z, data = codecs.zdelta_stream(source[:9000], source[9000:]), b""
    data = z.compress(target[:100]) + z.compress(target[100:]) + z.flush()
    assert codecs.zdelta_decode(data, source[:9000], source[9000:]) == target


def test_vcdiff_merge_needs_no_base():
    for seed in range(5):
        source, first = synthetic(seed)
        second = edited(first[3000:] + first[:3000] + b"z" * 500, seed)
        a, b = codecs.vcdiff_encode(first, source, window=5000), codecs.vcdiff_encode(second, first, window=3000)
        merged = codecs.merge_deltas(a, b, len(source))
        assert codecs.vcdiff_decode(merged, source) == second and len(merged) < len(second)
        again = codecs.vcdiff_encode(edited(second, 7), second)
        assert codecs.vcdiff_decode(codecs.merge_deltas(merged, again, len(source)), source) == codecs.vcdiff_decode(again, second)
    assert codecs.vcdiff_decode(codecs.merge_deltas(codecs.vcdiff_encode(b"", b"x"), codecs.vcdiff_encode(b"", b""), 1), b"x") == b""


def test_vcdiff_recode_and_corruption():
    source, target = synthetic(4)
    delta = codecs.vcdiff_encode(target, source)
    packed = vcdiff.recode(delta, secondary=True, app=b"name")
    assert codecs.vcdiff_decode(packed, source) == target and vcdiff.describe(packed)["secondary"]
    assert vcdiff.recode(packed, secondary=False, app=b"") == delta
    r, wrong = random.Random(2), 0
    for _ in range(150):
        bad = bytearray(delta)
        bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
        try:
            wrong += codecs.vcdiff_decode(bytes(bad), source) != target
        except ValueError:
            pass
    assert wrong == 0


def test_address_cache_over_many_rounds():
    r, coder, decoder, here = random.Random(3), vcdiff.Addresses(), vcdiff.Addresses(), 1
    modes = set()
    for _ in range(10_000):
        here += r.randrange(1, 1 << r.randrange(1, 12))
        at = r.choice([r.randrange(here), max(0, here - r.randrange(1, 300)), *[x for x in coder.near if x < here]])
        mode, raw = coder.encode(min(at, here - 1), here)
        modes.add(mode)
        assert decoder.decode(mode, here, vcdiff.Reader(raw)) == min(at, here - 1)
    assert modes == set(range(9))
    with pytest.raises(ValueError):
        vcdiff.Reader(b"\xff" * 9 + b"\x7f").number()
    assert vcdiff.Reader(vcdiff.number(1 << 40)).number() == 1 << 40


def test_codecs_on_prose():
    r = random.Random(5)
    words = ["".join(r.choice("aeinorst") for _ in range(r.randint(1, 7))) for _ in range(120)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 400))).encode() for _ in range(25)]
    for new, base in zip(texts, texts[1:]):
        for name, encode in codecs.ENCODERS.items():
            assert codecs.DECODERS[name](encode(new, base), base) == new
        for level in vcdiff.LEVELS:
            assert codecs.vcdiff_decode(codecs.vcdiff_encode(new, base, level=level, window=300), base) == new


def test_target_matching_runs_and_identical_windows():
    def ops(data, base=b"", **options):
        return vcdiff.instructions(codecs.vcdiff_encode(data, base, **options))

    assert ops(b"x" * 9) == [("run", 9, None)] and ops(b"x" * 7)[0][0] == "add"
    assert ops(b"ABCDE12345ABCDE") == [("add", 10, None), ("copy", 5, 0)]
    assert ops(b"abcdabc1abc") == [("add", 11, None)]  # three equal bytes are no match
    base = noise(20_000)
    assert ops(base, base) == [("copy", 20_000, 0)]
    assert ops(base, base, window=8000) == [("copy", 8000, 0), ("copy", 8000, 8000), ("copy", 4000, 16_000)]
    zeroed = base[:128] + bytes(16) + base[144:]
    assert len(codecs.vcdiff_encode(zeroed, base)) < 60
    lazy = b"bcdeXXXXYbcdefghijYYabcd" + b"abcdefghij"
    assert codecs.vcdiff_decode(codecs.vcdiff_encode(lazy, b""), b"") == lazy


def test_every_488th_byte_changed():
    base = bytearray(noise(102_400, 4))
    new = bytearray(base)
    for i in range(0, len(base), 488):
        base[i], new[i] = 3, 2
    for name in ("gdelta", "edelta", "vcdiff"):
        delta = codecs.ENCODERS[name](bytes(new), bytes(base))
        assert codecs.DECODERS[name](delta, bytes(base)) == bytes(new) and len(delta) < len(new) / 10
    for options in ({"stride": 2}, {"stride": 4}, {"reverse": True}):
        assert codecs.gdelta_decode(codecs.gdelta_encode(bytes(new), bytes(base), **options), bytes(base)) == bytes(new)


def test_references_and_outer_compressions():
    refs = (noise(40_000, 1), noise(100, 2), noise(30_000, 3), b"")
    share = codecs.dictionary(refs)
    assert len(share) == 32768 and refs[1] in share and share.endswith(refs[2][-10:]) and refs[0][-16_000:] in share
    new = refs[0][-9000:] + refs[2][-9000:]
    assert codecs.zdelta_decode(codecs.zdelta_encode(new, *refs), *refs) == new and len(codecs.zdelta_encode(new, *refs)) < 2000
    with pytest.raises(ValueError):
        codecs.zdelta_encode(b"", b"", b"", b"", b"", b"")
    for kind, (_, undo, do) in codecs.OUTER.items():
        assert codecs.unpack_outer(codecs.repack_outer(b"data" * 99, kind)) == b"data" * 99

    def lzw(data, most=12):  # the compress program's format, by the book
        out, bits, n, group = bytearray(b"\x1f\x9d" + bytes([128 | most])), 0, 0, 0
        table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
        size = 257

        def put(code):
            nonlocal bits, n, group
            bits, n, group = bits | code << n, n + width, (group + 1) % 8

        for b in data:
            nxt = word + bytes([b])
            if nxt in table:
                word = nxt
                continue
            put(table[word])
            if size < 1 << most:
                table[nxt] = size
                size += 1
                if size > 1 << width and width < most:
                    n, group, width = n + (-group % 8) * width, 0, width + 1
            word = bytes([b])
        put(table[word])
        return bytes(out + bits.to_bytes(-(-n // 8), "little"))

    text = b" ".join(b"%d apples" % (i % 97) for i in range(3000))
    assert codecs.unpack_outer(lzw(text)) == text and codecs.outer_kind(lzw(text)) == "compress"


def test_matched_by_loop():
    r = random.Random(8)
    for n in (0, 1, 15, 16, 17, 80, 700, 3000):
        a = r.randbytes(n)
        for at in {0, 1, n // 2, n - 1, n} & set(range(n + 1)):
            b = b"zz" + a[:at] + bytes([a[at] ^ 128]) + a[at + 1 :] if at < n else b"zz" + a
            assert vcdiff.matched(a, 0, n, b, 2, len(b)) == at == codecs.common_prefix(a, b[2:])
            assert vcdiff.matched(a, 0, min(n, 5), b, 2, len(b)) == min(at, 5, n)
