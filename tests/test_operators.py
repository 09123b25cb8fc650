import os
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from deltaloom.config import SMALL
from deltaloom.functions import codecs, formats, registry
from deltaloom.operators import reduce as ops
from deltaloom.plans import catalog, reduction
from deltaloom.sources import blobs as sources
from deltaloom.streaming.incremental import IncrementalIndex, base_of, candidate_stream, cluster_stream, dedup_stream, first_seen_stream, segments


def blobs(spark, repeat=1):
    r = random.Random(1)
    base = r.randbytes(9000)
    rows = [(0, base), (1, base[:4000] + r.randbytes(50) + base[4000:]), (2, base), (3, b""), (4, b"\0" * 9000), (5, None), (6, r.randbytes(700))]
    return spark.createDataFrame(rows, "blob_id long, content binary").repartition(repeat)


@pytest.mark.parametrize("options", [{}, {"sketch": "odess"}, {"sketch": "ntransform"}, {"delta": "gdelta_sketch"}, {"delta": "vcdiff"}, {"lossless": "lz4"}, {"index": "cluster"}, {"chunker": "fixed"}, {"chunker": "unified", "delta": "edelta"}])
def test_reduction_adds_up_and_restores(spark, tmp_path, options):
    config = replace(SMALL, **options)
    r = reduction.reduce(blobs(spark), config)
    one = r.report().first()
    assert one["total_bytes"] - one["dup_bytes"] == sum(one[f"{k}_bytes"] for k in ("delta", "lossless", "raw"))
    assert one["dup_bytes"] >= 9000
    reduction.store(r, str(tmp_path / "store"))
    got = {x["blob_id"]: bytes(x["content"]) for x in reduction.restore(spark, str(tmp_path / "store"), config).collect()}
    want = {x["blob_id"]: bytes(x["content"]) for x in blobs(spark).collect() if x["content"]}
    assert got == want


def test_restore_says_what_it_cannot_decode(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.createDataFrame([(1, 9, 3, "delta", b"xyz"), (2, None, 3, "raw", b"abc")], "ord long, base_ord long, size int, kind string, stored binary").write.parquet(f"{path}/chunks")
    spark.createDataFrame([(0, 0, 1, 3), (0, 1, 2, 3)], "blob_id long, idx int, first_ord long, size int").write.parquet(f"{path}/recipes")
    spark.createDataFrame([("gdelta", "zstd", True)], "delta string, lossless string, delta_post_compress boolean").write.parquet(f"{path}/header")
    with pytest.raises(ValueError, match="1 chunks"):
        reduction.restore(spark, path, SMALL)
    with pytest.raises(ValueError, match="written with"):
        reduction.restore(spark, path, replace(SMALL, delta="edelta"))


def test_restore_needs_every_chunk(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.createDataFrame([(2, None, 3, "raw", b"abc")], "ord long, base_ord long, size int, kind string, stored binary").write.parquet(f"{path}/chunks")
    spark.createDataFrame([(0, 0, 2, 3), (0, 1, 7, 3)], "blob_id long, idx int, first_ord long, size int").write.parquet(f"{path}/recipes")
    spark.createDataFrame([("gdelta", "zstd", True)], "delta string, lossless string, delta_post_compress boolean").write.parquet(f"{path}/header")
    with pytest.raises(Exception, match="has not"):
        reduction.restore(spark, path, SMALL).collect()


def test_restore_of_a_long_delta_chain(spark, tmp_path):
    """Each version is a delta of the one before."""
    r, versions = random.Random(8), []
    content = bytearray(r.randbytes(400))
    for k in range(8):
        content[40 * k : 40 * k + 8] = r.randbytes(8)
        versions.append((k, bytes(content)))
    config = replace(SMALL, chunker="fixed", normal_size=1024)
    done = reduction.reduce(spark.createDataFrame(versions, "blob_id long, content binary"), config)
    reduction.store(done, str(tmp_path / "store"))
    assert done.encoded.where("kind = 'delta'").count() >= 5
    got = {x["blob_id"]: bytes(x["content"]) for x in reduction.restore(spark, str(tmp_path / "store"), config).collect()}
    assert got == dict(versions)


def test_result_does_not_depend_on_partitions(spark):
    found = [sorted(reduction.reduce(blobs(spark, n), SMALL).candidates.collect()) for n in (1, 5)]
    assert found[0] == found[1] and found[0] and all(r["base_ord"] < r["ord"] for r in found[0])


def simulate(rows, cluster):
    tables, out = {}, {}
    for o, keys in rows:
        hit = next(((i, tables[i, k]) for i, k in enumerate(keys) if (i, k) in tables), None)
        node = [o]
        if hit:
            out[o] = (hit[1][0], hit[0])
            if cluster:
                node = hit[1]
                node[0] = o
        for i, k in enumerate(keys):
            tables[i, k] = node
    return out


@pytest.mark.parametrize("cluster", [False, True])
def test_index_equals_simulation(spark, cluster):
    r = random.Random(2)
    rows = [(o, [r.randrange(60) for _ in range(3)]) for o in range(500)]
    df = spark.createDataFrame([(0, o, k) for o, k in rows], "blob_id long, ord long, sfp array<long>").repartition(3)
    found = ops.cluster_base(df) if cluster else ops.latest_base(ops.index_keys(df))
    assert {x["ord"]: (x["base_ord"], x["sf_pos"]) for x in found.collect()} == simulate(rows, cluster)


def test_cluster_bases_over_all_blobs(spark):
    r = random.Random(3)
    rows = [(o, [r.randrange(400) for _ in range(3)]) for o in range(500)]
    df = spark.createDataFrame([(o % 90, o, k) for o, k in rows], "blob_id long, ord long, sfp array<long>").repartition(3)
    assert {x["ord"]: (x["base_ord"], x["sf_pos"]) for x in ops.cluster_base_parts(df).collect()} == simulate(rows, True)


def test_cluster_query_looks_everywhere(spark):
    content = random.Random(4).randbytes(3000)
    near = [(b, content[:-40] + bytes([b]) * 40) for b in range(6)]
    df = spark.createDataFrame(near, "blob_id long, content binary")
    found = reduction.reduce(df, replace(SMALL, index="cluster")).candidates.collect()
    assert any(x["base_ord"] >> 20 != x["ord"] >> 20 for x in found)


def test_hot_keys_are_cut_into_ranges(spark):
    r = random.Random(6)
    rows = [(o, [7, r.randrange(40), r.randrange(3)]) for o in r.sample(range(10**6), 800)]
    df = spark.createDataFrame(rows, "ord long, sfp array<long>").repartition(3)
    keys = ops.index_keys(df)
    want = simulate(sorted(rows), False)
    for size in (100, 37, 10**6):
        assert {x["ord"]: (x["base_ord"], x["sf_pos"]) for x in ops.latest_base(keys, (), size).collect()} == want
    pairs = [sorted(tuple(x) for x in ops.similar_pairs(keys, 2, n).collect()) for n in (50, 10**6)]
    assert pairs[0] == pairs[1] and pairs[0]
    assert ops.latest_base(keys.limit(0)).count() == 0


def test_scope_keeps_nulls_and_other_columns(spark):
    data = random.Random(1).randbytes(3000)
    rows = [(0, data, "a"), (1, data, "a"), (2, data, None), (3, data, None), (4, data, "b")]
    df = spark.createDataFrame(rows, "blob_id long, content binary, tenant string")
    done = reduction.reduce(df, replace(SMALL, scope=("tenant",)))
    dup = {x["blob_id"] for x in done.deduped.where("is_dup").select("blob_id").distinct().collect()}
    assert dup == {1, 3} and done.deduped.select("blob_id").distinct().count() == 5
    assert reduction.reduce(df, SMALL).report().first()["dup_bytes"] == 4 * 3000


def test_limit_and_order_bounds(spark):
    ords = [r * 3 % 1001 for r in range(700)]
    df = spark.createDataFrame([(o,) for o in ords], "ord long")
    assert [ops.kth(df, k, 4) for k in (0, 1, 350, 699)] == [sorted(ords)[k] for k in (0, 1, 350, 699)] and ops.kth(df, 700) is None
    assert sorted(r["ord"] for r in ops.limited(df, 1 / 3).collect()) == sorted(ords)[:233]
    assert ops.limited(df, 1.0).count() == 700 and ops.limited(df, 0.0).count() == 0
    config = replace(SMALL, chunker="fixed", normal_size=500, limit_fraction=0.5)
    assert reduction.reduce(blobs(spark), config).report().first()["total_chunks"] == 74 // 2
    too_far = spark.createDataFrame([(1 << 50, b"x" * 2000)], "blob_id long, content binary")
    for cut in (lambda: ops.content_chunks(too_far, SMALL).collect(), lambda: ops.fixed_chunks(too_far).collect()):
        with pytest.raises(Exception, match="beyond the stream order"):
            cut()


def test_files_and_ranges(spark, tmp_path):
    import gzip

    r = random.Random(2)
    data = {f"f{k:02}": r.randbytes(100 + 900 * k) for k in range(7)} 
    (tmp_path / "empty").write_bytes(b"")  # Spark lists no empty files
    for name, d in data.items():
        (tmp_path / name).write_bytes(d if name != "f03" else gzip.compress(d))
    found = sources.from_files(spark, str(tmp_path), unpack=True).collect()
    assert {os.path.basename(x["path"]): bytes(x["content"]) for x in found} == data
    assert [os.path.basename(x["path"]) for x in sorted(found, key=lambda x: x["blob_id"])] == sorted(data)
    assert {os.path.basename(x["path"]): x["packed_as"] for x in found}["f03"] == "gzip" and sorted(x["blob_id"] for x in found) == list(range(7))
    pieces = sorted(sources.from_ranges(spark, str(tmp_path), 1000).collect(), key=lambda x: x["blob_id"])
    joined = {}
    for x in pieces:
        joined[os.path.basename(x["path"])] = joined.get(os.path.basename(x["path"]), b"") + bytes(x["content"])
    assert joined == {k: (tmp_path / k).read_bytes() for k in data} and [x["blob_id"] for x in pieces] == list(range(len(pieces)))


def test_measurements(spark, tmp_path):
    done = reduction.reduce(blobs(spark), SMALL)
    sizes = ops.codec_sizes(done.sketched, done.candidates, done.config)
    events = ops.codec_events(sizes)
    reduction.write_events(events, str(tmp_path / "events"))
    back = spark.read.option("header", True).csv(str(tmp_path / "events"))
    assert back.columns == ["method", "block_reduction_ratio", "time(us)"] and back.count() == events.count() > 0
    assert {x["method"] for x in ops.event_averages(events).collect()} == {"lossless", *ops.CODECS}
    base = done.candidates.count()
    by = {x["codec"]: x for x in ops.codec_comparison(done.sketched, done.candidates, done.config).groupBy("codec").sum("chunks").collect()}
    assert {x["sum(chunks)"] for x in by.values()} == {done.sketched.count()} and base > 0
    one = next(x for x in sizes.collect() if x["vcdiff"])
    row = next(x for x in ops.base_bytes(done.sketched, done.candidates).collect() if x["ord"] == one["ord"])
    assert one["vcdiff"]["size"] == len(codecs.vcdiff_encode(bytes(row["data"]), bytes(row["base_data"])))
    shares = ops.distribution(spark.range(1, 101).withColumn("g", F.lit("x")), "g", "id", 4).collect()
    assert [(x["share"], x["value"]) for x in shares] == [(0.25, 25), (0.5, 50), (0.75, 75), (1.0, 100)]
    rows = reduction.grid(spark.createDataFrame([(0, b"a" * 900, "x"), (1, b"a" * 900, "y")], "blob_id long, content binary, d string"), {"one": SMALL, "two": replace(SMALL, sketch="finesse", features=12, delta="edelta")}, "d").collect()
    assert sorted((x["config"], x["dataset"], x["dup_bytes"]) for x in rows) == [(c, d, 0) for c in ("one", "two") for d in ("x", "y")]


def test_formats(spark):
    df = spark.createDataFrame([(1_002_003, 1536.0, "a/b/c.tar", "2024-01-31 23:59:59")], "m long, n double, p string, t string")
    got = df.select(formats.duration(F.col("m")), formats.byte_size(F.col("n")), formats.file_name(F.col("p")), formats.moment(F.col("t").cast("timestamp")), formats.result_name(F.col("p"), F.lit("x")), formats.byte_size(F.lit(12))).first()
    assert tuple(got) == ("1s 2ms 3us", "1.50 KB", "c.tar", "2024-01-31_23:59:59", "c.tar_x.csv", "12 B")


def test_sizes_round_halves_to_even(spark):
    sizes = [133 * 1024 + 128, 133 * 1024 + 384, 694 * 1024 + 640, 1024 + 896, 1048575, 2**20 + 2**17, 2**30 + 5 * 2**27, 562949953421312 * 16 - 1, 1023]
    df = spark.createDataFrame([(n,) for n in sizes] + [(None,)], "n long")
    unit = lambda n: next((1 << k, u) for k, u in ((30, "GB"), (20, "MB"), (10, "KB")) if n >= 1 << k)
    want = [f"{n / unit(n)[0]:.2f} {unit(n)[1]}" if n >= 1024 else f"{n} B" for n in sizes]
    assert [r[0] for r in df.select(formats.byte_size(F.col("n"))).collect()] == [*want, None]
    assert [r[0] for r in df.limit(1).select(formats.byte_size(F.lit(1029.5))).collect()] == ["1.01 KB"]
    moments = spark.createDataFrame([(-1_500_001,), (2**62 + 1,), (None,)], "m long")
    assert [r[0] for r in moments.select(formats.duration(F.col("m"))).collect()] == ["-1s -500ms -1us", "4611686018427s 387ms 905us", None]


def test_delta_tools_of_repeated_and_missing_ids(spark, tmp_path):
    r = random.Random(4)
    base = " ".join(r.choice(["one", "two", "three", "four", "five"]) for _ in range(300))
    rows = [(i, base[i : 900 - i] + str(i)) for i in range(-3, 140) if i % 7] + [(64, base), (64, base + "x"), (64, None), (None, base), (None, "y"), (66, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.delta_tools_roundtrip(spark, str(tmp_path)).collect()
    assert Counter((x[0], x[1]) for x in found) == Counter((i, len(t or "")) for i, t in rows)
    assert all(x[2:] == (True,) * 4 for x in found)


def test_choose_ties(spark):
    rows = [(10, 5, 4), (10, 5, 5), (10, 10, None), (10, 12, 11), (10, 9, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    assert [r[0] for r in df.select(ops.choose(df.a, df.b, df.c)).collect()] == ["delta", "lossless", "raw", "raw", "lossless"]


def test_incremental_equals_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(o, str(r.randrange(150)), [r.randrange(40) for _ in range(2)]) for o in range(200)]
    schema = "ord long, fp string, sfp array<long>"
    index = IncrementalIndex(spark, str(tmp_path))
    for b in range(4):
        index.process(spark.createDataFrame(rows[b * 50 : b * 50 + 50], schema), b)
    got = {x["ord"]: x["base_ord"] for x in spark.read.parquet(*[f"{tmp_path}/candidates/{b}" for b in range(4)]).collect()}
    first = {}
    for o, fp, _ in rows:
        first.setdefault(fp, o)
    want = simulate([(o, k) for o, fp, k in rows if first[fp] == o], False)
    assert got == {o: b for o, (b, _) in want.items()}


def test_segments_add_up():
    for n in range(70):
        found = segments(n)
        assert [a for a, _ in found] == [0, *[b for _, b in found]][: len(found)] and sum(b - a for a, b in found) == n and len(found) == n.bit_count()


def test_streams_equal_batches(spark, tmp_path):
    """Files one by one through the table index, the keyed states and the cluster state; repeats and a late row among them."""
    r = random.Random(9)
    rows = [(0, o, str(r.randrange(60)), [r.randrange(30) for _ in range(2)], f"2024-01-01 00:00:{o // 4:02}") for o in range(200)]
    late = rows[150]
    rows = [*rows[:150], *rows[151:180], late, *rows[180:]]
    schema = "tenant long, ord long, fp string, sfp array<long>, t string"
    source = str(tmp_path / "in")
    for b in range(5):
        spark.createDataFrame(rows[b * 40 : b * 40 + 40], schema).coalesce(1).write.mode("append").json(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source).withColumn("t", F.to_timestamp("t"))
    index = IncrementalIndex(spark, str(tmp_path / "index"))
    index.start(stream(), str(tmp_path / "c0")).awaitTermination()
    assert sum(len(spark.read.parquet(f"{tmp_path}/index/candidates/{b}").collect()) for b in range(5)) > 20

    def run(df, name):
        out = str(tmp_path / name)
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / (name + "-c"))).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    first = run(first_seen_stream(stream(), "t", "1 hour"), "first").collect()
    assert len(first) == 200 and sum(not x["is_dup"] for x in first) == len({x[2] for x in rows})
    assert {x["fp"]: x["first_ord"] for x in first if not x["is_dup"]} == {x["fp"]: x["first_ord"] for x in first}
    once = run(dedup_stream(stream().select("ord", "fp", "t"), "t", "1 hour"), "once").collect()
    assert len(once) == len({x[2] for x in rows})
    found = base_of(run(candidate_stream(ops.index_keys(stream().withColumn("at", F.col("t")), ("t",)), "t", "1 hour"), "found")).collect()
    clusters = run(cluster_stream(stream(), "tenant"), "clusters").collect()
    assert {x["ord"] for x in found} and all(x["base_ord"] != x["ord"] for x in found)
    assert {x["ord"] for x in clusters} <= {x[1] for x in rows} and len(clusters) > 100


def test_eviction_forgets_old_keys(spark, tmp_path):
    schema = "ord long, fp string, sfp array<long>"
    index = IncrementalIndex(spark, str(tmp_path))
    for b in range(3):
        index.process(spark.createDataFrame([(10 * b + k, f"{b}{k}", [k]) for k in range(3)], schema), b)
    index.evict(3, 21)
    index.process(spark.createDataFrame([(30 + k, f"3{k}", [k]) for k in range(3)], schema), 3)
    assert {x["ord"]: x["base_ord"] for x in spark.read.parquet(f"{tmp_path}/candidates/3").collect()} == {31: 21, 32: 22}


def test_sql_table_functions(spark):
    assert {"cdc_chunk_rows", "delta_instructions", "gdelta_hash_encode", "vcdiff_merge"} <= set(registry.register(spark, SMALL))
    rows = spark.sql("SELECT * FROM cdc_chunk_rows(cast(repeat('abc', 9000) AS binary))").collect()
    assert sum(r["size"] for r in rows) == 27_000 and rows[0]["offset"] == 0
    ops_ = spark.sql("SELECT * FROM delta_instructions(vcdiff_encode(cast(repeat('q', 50) AS binary), X''), 'vcdiff')").collect()
    assert [(r["op"], r["length"]) for r in ops_] == [("run", 50)]
    one = spark.sql("SELECT gdelta_decode(gdelta_hash_encode(X'010203', X'01'), X'01') AS a, zdelta_decode2(zdelta_encode2(X'0102', X'01', X'02'), X'01', X'02') AS z").first()
    assert bytes(one["a"]) == b"\x01\x02\x03" and bytes(one["z"]) == b"\x01\x02"


def test_entry_without_the_llm_folders(tmp_path):
    """The entry of a copy without them, and of one whose folder is an empty leftover."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "deltaloom"), tmp_path / "deltaloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"
    for leftover in (False, True):
        if leftover:
            (tmp_path / "deltaloom" / "llm").mkdir()
        subprocess.run([sys.executable, "-W", "error", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_sql_functions(spark):
    assert "vcdiff_encode" in registry.register(spark, SMALL)
    one = spark.sql("SELECT gdelta_decode(gdelta_encode(X'0102', X'01'), X'01') AS a, size(cdc_chunks(cast(repeat('ab', 3000) AS binary))) AS n").first()
    assert bytes(one["a"]) == b"\x01\x02" and one["n"] >= 2
