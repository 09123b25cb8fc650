"""DuckDB SQL that states chunkers and sketches over whole tables, for comparison.

The hash of a position depends on its last 16 bytes (right shift) or, as masks end at bit 45, on its last 45 (left shift). So
every position's hash comes from window functions, positions that meet a mask are listed by document, and a recursive query
hops from cut to cut. Where a hash still shows that it began spot a chunk's skipped bytes, its shorter forms are used: t1 to t15
by windows, or (linear in the bytes) the difference of two full hashes.
"""

from __future__ import annotations

from deltaloom.config import EngineConfig
from deltaloom.functions import bytescan

_ALL = str((1 << 64) - 1)
_LEFT_BITS = 45


def _bytes(table: str, key: str, text: str) -> str:
    values = ", ".join(f"('{i:02X}', {int(g)}::HUGEINT)" for i, g in enumerate(bytescan.GEAR))
    return f"""
gear(pair, g) AS (VALUES {values}),
raw AS (SELECT {key} AS id, hex(encode(coalesce({text}, ''))) AS h FROM {table}),
pos AS (SELECT id, unnest(range(CAST(length(h) // 2 AS BIGINT))) AS i, h FROM raw),
b AS (SELECT id, i, g FROM (SELECT id, i, substr(h, 2 * i + 1, 2) AS pair FROM pos) JOIN gear USING (pair))"""


def _right(shift: int = 8, bits: str = _ALL, most: int = 16) -> str:
    """t1 .. t16 of every position."""
    out = ",\nw1 AS (SELECT id, i, g, g AS t1 FROM b)"
    for k in range(2, most + 1):
        held = ", ".join(f"t{j}" for j in range(1, k))
        out += f",\nw{k} AS (SELECT id, i, g, {held}, ((lag(t{k - 1}) OVER (PARTITION BY id ORDER BY i) >> {shift}) + g) & {bits}::HUGEINT AS t{k} FROM w{k - 1})"
    return out


def _left() -> str:
    """The full hash f of every position, modulo 2^45."""
    mod = (1 << _LEFT_BITS) - 1
    out = f",\nd1 AS (SELECT id, i, (g & {mod}::HUGEINT)::BIGINT AS s FROM b)"
    step = 1
    while step < 64:
        low = max(0, (1 << max(0, _LEFT_BITS - step)) - 1)
        before = f"coalesce(lag(s, {step}) OVER (PARTITION BY id ORDER BY i), 0)"
        out += f",\nd{2 * step} AS (SELECT id, i, (s + (({before} & {low}) << {min(step, 44)})) & {mod} AS s FROM d{step})"
        step *= 2
    return out


def chunk_ctes(kind: str, c: EngineConfig, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Common table expressions up to chunks(id, idx, spot, size); the last ones of the positions are w16 or d64."""
    how = bytescan.CHUNKERS[kind]
    normalised = how.skip == "min_size"
    least, strict, loose = getattr(c, how.skip), how.strict, how.loose
    sizes = "sizes AS (SELECT id, CAST(length(h) // 2 AS BIGINT) AS n FROM raw)"
    if how.left:
        lists = f"""
lists AS (SELECT id, list(i ORDER BY i) FILTER (WHERE s & {strict} = 0) AS strict, list(i ORDER BY i) FILTER (WHERE s & {loose} = 0) AS loose, list(s ORDER BY i) AS f FROM d64 GROUP BY id)"""
    else:
        heads = " UNION ALL ".join(f"SELECT id, (i - {k} + 1) * 64 + {k} * 2 + (t{k} & {strict} = 0)::INT AS x FROM w16 WHERE t{k} & {loose} = 0" for k in range(1, 16))
        lists = f"""
heads AS (SELECT id, list(x ORDER BY x) AS heads FROM ({heads}) GROUP BY id),
lists AS (SELECT id, list(i ORDER BY i) FILTER (WHERE t16 & {strict} = 0) AS strict, list(i ORDER BY i) FILTER (WHERE t16 & {loose} = 0) AS loose, any_value(heads) AS f
  FROM w16 LEFT JOIN heads USING (id) GROUP BY id)"""
    n = f"least(n - spot, {c.max_size})"
    skipped = f"least({least}, {n})" + (" // 2 * 2" if how.step == 2 and not normalised else "")
    # m: bytes that may be cut, r: skipped, e: where tests end, y: where the loose mask begins
    measures = f"SELECT *, {n} AS m, {skipped} AS r FROM state JOIN sizes USING (id) JOIN lists USING (id) WHERE spot < n"
    end = "m - (m - r) % 2" if how.step == 2 else "m"
    middle = f"least({c.normal_size}, m)" + (f" + (least({c.normal_size}, m) - r) % 2" if how.step == 2 else "")
    if how.sketches:
        head = "NULL"
        begin = "r"
    elif how.left:
        window = f"list_slice(f, spot + r, spot + r + 64)"
        low = f"((CASE WHEN spot + r > 0 THEN list_extract({window}, 1) ELSE 0 END))"
        value = f"list_extract(CASE WHEN spot + r > 0 THEN win ELSE list_prepend(0::BIGINT, list_slice(f, 1, 64)) END, j + 1)"
        first = "(CASE WHEN spot + r > 0 THEN list_extract(win, 1) ELSE 0 END)"
        shifted = f"(CASE WHEN j >= {_LEFT_BITS} THEN 0 ELSE ({first} & ((1::BIGINT << (greatest({_LEFT_BITS} - j, 0))) - 1)) << least(j, 44) END)"
        mask = f"(CASE WHEN r + j - 1 < y THEN {strict} ELSE {loose} END)"
        head = f"list_min(list_filter(range(1, 65), lambda j: r + j - 1 < e AND r + j - 1 > 0 AND (({value} - {shifted}) & {(1 << _LEFT_BITS) - 1} & {mask}) = 0)) - 1 + r"
        begin = "r + 64"
    else:
        place = "(x % 64) // 2 - 1 + r"
        head = f"list_min(list_transform(list_filter(f, lambda x: x // 64 = spot + r AND {place} < e AND (({place} >= y) OR x % 2 = 1)), lambda x: {place}))"
        begin = "r + 15"
    after = f"list_min(list_filter(strict, lambda x: x >= spot + {begin} AND x < spot + least(y, e))) - spot"
    later = f"list_min(list_filter(loose, lambda x: x >= spot + greatest({begin}, y) AND x < spot + e)) - spot"
    whole = f"CASE WHEN m <= {least} THEN m ELSE NULL END" if normalised else "NULL::BIGINT"
    win = ", list_slice(f, spot + r, spot + r + 64) AS win" if how.left else ""
    hashes = _left() if how.left else _right()
    return f"""{_bytes(table, key, text)}{hashes},
{sizes},{lists},
state(id, idx, spot, size) AS (
  SELECT id, -1::BIGINT, 0::BIGINT, 0::BIGINT FROM sizes
  UNION ALL
  SELECT id, idx + 1, spot + cut, cut FROM (
    SELECT *, coalesce({whole}, {head}, {after}, {later}, m)::BIGINT AS cut
    FROM (SELECT *, {middle} AS y, {end} AS e{win} FROM ({measures})))),
chunks AS (SELECT id, idx, spot - size AS spot, size FROM state WHERE idx >= 0)"""


def chunks_sql(kind: str, c: EngineConfig) -> str:
    bits = "NULL::BIGINT" if kind != "unified" else "coalesce(bits, 0)"
    sketch, joined = "", ""
    if kind == "unified":
        sketch, joined = f",\n{bits_cte(4)}", "LEFT JOIN sketch USING (id, idx)"
    return f"""WITH RECURSIVE {chunk_ctes(kind, c)}{sketch}
SELECT id AS blob_id, idx::INTEGER AS idx, id * 1048576 + idx AS ord, spot AS "offset", size::INTEGER AS size, {bits} AS bits, md5(unhex(substr(h, 2 * spot + 1, 2 * size))) AS digest
FROM chunks JOIN raw USING (id) {joined}"""


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808::HUGEINT THEN {x} - 18446744073709551616::HUGEINT ELSE {x} END)::BIGINT"


def bits_cte(shift: int = 0, chunks: str = "chunks") -> str:
    """masks, sketch(id, idx, bits): the bitmap sketch of each chunk, from its own first byte on."""
    masks = ", ".join(f"({i}, {int(m)}::HUGEINT)" for i, m in enumerate(bytescan.MASKS))
    own = "CASE least(i - spot, 15) " + " ".join(f"WHEN {k - 1} THEN t{k}" for k in range(1, 17)) + " END"
    slot = f"((fp >> {shift}) & 63)::INTEGER"
    return f"""masks(slot, mask) AS (VALUES {masks}),
inside AS (SELECT w.id, c.idx, {own} AS fp FROM w16 w ASOF JOIN {chunks} c ON w.id = c.id AND w.i >= c.spot WHERE w.i < c.spot + c.size),
hits AS (SELECT id, idx, {slot} AS slot FROM inside JOIN masks ON masks.slot = {slot} WHERE fp & mask = 0),
sketch AS (SELECT id, idx, {_signed("bit_or(1::HUGEINT << slot)")} AS bits FROM hits GROUP BY id, idx)"""


def unique_ctes(c: EngineConfig) -> str:
    """... uniq(id, idx, ord, spot, size, digest) of first occurrences among normalised chunks, and their sketch."""
    return f"""{chunk_ctes("normalized", c)},
marked AS (SELECT id, idx, id * 1048576 + idx AS ord, spot, size, md5(unhex(substr(h, 2 * spot + 1, 2 * size))) AS digest FROM chunks JOIN raw USING (id)),
uniq AS (SELECT * FROM marked QUALIFY ord = min(ord) OVER (PARTITION BY digest)),
{bits_cte(0, "uniq")},
bitmap AS (SELECT ord, spot, size, digest, coalesce(bits, 0) AS bits FROM uniq LEFT JOIN sketch USING (id, idx))"""


def sf(bits: str, k: int) -> str:
    """The k-th of three overlapping windows of a bitmap."""
    unsigned = f"(CASE WHEN {bits} < 0 THEN {bits}::HUGEINT + 18446744073709551616::HUGEINT ELSE {bits}::HUGEINT END)"
    return f"CASE WHEN {bits} <> 0 THEN (({unsigned} >> {16 * k}) & 4294967295::HUGEINT)::BIGINT END"


def bitmap_sql(c: EngineConfig) -> str:
    return f"""WITH RECURSIVE {unique_ctes(c)}
SELECT ord, bits, {", ".join(f"{sf('bits', k)} AS sf{k}" for k in range(3))}, bit_count(bits)::INTEGER AS ones FROM bitmap"""


def popcount_sql(c: EngineConfig) -> str:
    return f"WITH RECURSIVE {unique_ctes(c)} SELECT bit_count(bits)::INTEGER AS ones, count(*) AS n FROM bitmap GROUP BY ALL"


def _keys(c: EngineConfig) -> str:
    keys = " UNION ALL ".join(f"SELECT ord, {k} AS sf_pos, {sf('bits', k)} AS sf_value FROM bitmap WHERE bits <> 0" for k in range(3))
    return f"""{unique_ctes(c)},
keys AS ({keys}),
before AS (SELECT *, lag(ord) OVER (PARTITION BY sf_pos, sf_value ORDER BY ord) AS base FROM keys),
found AS (SELECT ord, arg_min(base, sf_pos) AS base_ord, min(sf_pos)::INTEGER AS sf_pos FROM before WHERE base IS NOT NULL GROUP BY ord)"""


def similar_sql(c: EngineConfig) -> str:
    return f"WITH RECURSIVE {_keys(c)} SELECT ord, base_ord, sf_pos FROM found"


def fetch_sql(c: EngineConfig) -> str:
    return f"""WITH RECURSIVE {_keys(c)}
SELECT a.ord, base_ord, a.size::INTEGER AS size, b.size::INTEGER AS base_size, a.digest, b.digest AS base_digest
FROM bitmap a LEFT JOIN found USING (ord) LEFT JOIN bitmap b ON b.ord = base_ord"""


def small_sql(c: EngineConfig, most: int = 1024) -> str:
    return f"WITH RECURSIVE {chunk_ctes('normalized', c)} SELECT size <= {most} AS small, count(*) AS n, sum(size)::BIGINT AS bytes FROM chunks GROUP BY ALL"


def hits_sql() -> str:
    masks = ", ".join(f"({i}, {int(m)}::HUGEINT)" for i, m in enumerate(bytescan.MASKS))
    own = "CASE least(i, 15) " + " ".join(f"WHEN {k - 1} THEN t{k}" for k in range(1, 17)) + " END"
    return f"""WITH {_bytes("documents", "doc_id", "text").lstrip()}{_right()},
masks(slot, mask) AS (VALUES {masks}), fps AS (SELECT {own} AS fp FROM w16),
hits AS (SELECT slot, count(*) AS n FROM fps JOIN masks ON slot = (fp & 63)::INTEGER WHERE fp & mask = 0 GROUP BY slot)
SELECT slot::INTEGER AS mask, coalesce(n, 0)::BIGINT AS n FROM masks LEFT JOIN hits USING (slot)"""


def ntransform_sql(c: EngineConfig, n: int) -> str:
    """The features of unique chunks: hashes of 32 bytes by doubling, then maxima of linear maps."""
    prime, base, size, power = bytescan.RABIN_PRIME, bytescan.RABIN_BASE, 1, bytescan.RABIN_BASE
    values = ", ".join(f"('{i:02X}', {i})" for i in range(256))
    out = f"""code(pair, x) AS (VALUES {values}),
p1 AS (SELECT id, i, x::BIGINT AS v FROM (SELECT id, i, substr(h, 2 * i + 1, 2) AS pair FROM pos) JOIN code USING (pair))"""
    while size < bytescan.RABIN_WINDOW:
        out += f",\np{2 * size} AS (SELECT id, i, (lag(v, {size}) OVER (PARTITION BY id ORDER BY i) * {power} + v) % {prime} AS v FROM p{size})"
        size, power = 2 * size, power * power % prime
    m, a = bytescan.linear_params(n)
    best = ", ".join(f"coalesce(max((v::HUGEINT * {int(x)} + {int(y)}) & 4294967295::HUGEINT), 0)::BIGINT AS f{k}" for k, (x, y) in enumerate(zip(m, a)))
    return f"""WITH RECURSIVE {unique_ctes(c)},
{out},
own AS (SELECT u.ord, p.v FROM p{bytescan.RABIN_WINDOW} p ASOF JOIN marked c ON p.id = c.id AND p.i >= c.spot JOIN uniq u ON u.ord = c.ord WHERE p.i - c.spot >= {bytescan.RABIN_WINDOW - 1})
SELECT ord, {best} FROM uniq LEFT JOIN own USING (ord) GROUP BY ord"""
