"""Image files, landing ingest, nested records, mask probes and state in buckets: nulls, empty and broken input, restarts."""

import glob
import os
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.operators import governance, nested
from ashlar.sources import files, images
from ashlar.streaming import buckets
from ashlar.streaming import events as ev


def png(width, height, depth, colour, lines, palette=None, interlaced=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = b"".join(b"\0" + bytes(line) for line in lines)
    return images.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", bytes(palette)) if palette else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def bmp(pixels, depth, upwards):
    height, width, _ = pixels.shape
    rows = pixels[::-1] if upwards else pixels
    lines = b""
    for row in rows:
        line = b"".join(bytes([b, g, r]) + (b"\xff" if depth == 32 else b"") for r, g, b in row.tolist())
        lines += line + b"\0" * (-len(line) % 4)
    return b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height if upwards else -height, 1, depth, 0, len(lines), 0, 0, 0, 0) + lines


def test_pictures_of_all_filters_and_kinds():
    rnd = np.random.default_rng(3)
    for height, width in ((1, 1), (1, 9), (9, 1), (7, 5), (23, 40)):
        for pixels in (rnd.integers(0, 256, (height, width, 3), np.uint8), np.full((height, width, 3), 200, np.uint8)):
            assert (images.decode(images.encode_png(pixels)) == pixels).all()
            for depth in (24, 32):
                for upwards in (True, False):
                    assert (images.decode(bmp(pixels, depth, upwards)) == pixels).all()
    grey = lambda *rows: [[[v, v, v] for v in row] for row in rows]
    for data, want in [
        (png(3, 1, 1, 0, [[0b10100000]]), grey([255, 0, 255])),
        (png(3, 1, 2, 0, [[0b00011100]]), grey([0, 85, 255])),
        (png(3, 1, 4, 0, [[0x0F, 0x80]]), grey([0, 255, 136])),
        (png(2, 2, 8, 0, [[1, 2], [3, 4]]), grey([1, 2], [3, 4])),
        (png(2, 1, 16, 0, [[7, 99, 8, 99]]), grey([7, 8])),
        (png(2, 1, 8, 4, [[5, 255, 6, 0]]), grey([5, 6])),
        (png(1, 2, 8, 6, [[1, 2, 3, 4], [5, 6, 7, 8]]), [[[1, 2, 3]], [[5, 6, 7]]]),
        (png(1, 1, 16, 2, [[1, 0, 2, 0, 3, 0]]), [[[1, 2, 3]]]),
        (png(3, 1, 2, 3, [[0b00011000]], [9, 9, 9, 1, 2, 3, 4, 5, 6]), [[[9, 9, 9], [1, 2, 3], [4, 5, 6]]]),
    ]:
        assert images.decode(data).tolist() == want


def test_broken_pictures_are_null(spark, tmp_path):
    whole = images.encode_png(np.full((4, 4, 3), 9, np.uint8))
    flipped = bytearray(whole)
    flipped[45] ^= 1
    huge = bytearray(png(1, 1, 8, 0, [[1]]))
    huge[16:24] = struct.pack(">II", 2**31 - 1, 2**31 - 1)
    huge[29:33] = struct.pack(">I", zlib.crc32(bytes(huge[12:29])))
    bad = [None, b"", b"GIF89a", whole[:30], whole[:-12], bytes(flipped), bytes(huge), png(1, 1, 8, 0, [[1]], interlaced=1), png(1, 1, 8, 3, [[5]], [1, 2, 3]), png(1, 1, 8, 3, [[0]]), png(1, 1, 3, 0, [[1]]), png(1, 1, 8, 5, [[1]]), images.PNG_MAGIC, b"BM", bmp(np.zeros((2, 2, 3), np.uint8), 24, True)[:-1]]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate([*bad, whole])], "width_ int, content binary")
    got = images.picture_features(images.decode_images(df, "content"), "pixels").orderBy("width_").collect()
    assert all((r.width, r.height, r.pixels, r.colour, r.hex) == (None,) * 5 for r in got[:-1])
    assert (got[-1].width, got[-1].height, got[-1].colour, got[-1].hex) == (4, 4, "black", "#090909")
    assert images.decode_images(df.limit(0), "content").count() == 0


def test_image_files_come_back(spark, tmp_path):
    flat = [(1, [10, 20, 30] * 6, 3), (2, [], 3), (3, None, 1), (4, [1, 2, 3, 4], 1), (5, [1, 2, 3], None), (6, [250, 10, 10] * 2 + [0, 0, 0], 1)]
    df = spark.createDataFrame(flat, "id int, p array<int>, w int").select(F.format_string("%d.png", "id").alias("name"), images.encode_images("p", "w").alias("content"))
    folder = f"file://{tmp_path}/pictures"
    assert {r.name for r in images.write_files(df, folder, "name", "content").collect()} == {"1.png", "6.png"}
    assert {r.name for r in images.write_files(df, folder, "name", "content").collect()} == {"1.png", "6.png"}
    got = images.picture_features(images.decode_images(files.read_images(spark, folder), "content"), "pixels").collect()
    assert {(os.path.basename(r.path), r.width, r.height, r.hex, r.colour) for r in got} == {("1.png", 3, 2, "#0a141e", "blue"), ("6.png", 1, 3, "#fa0a0a", "red")}


def test_ingest_opens_new_files_only(spark, tmp_path):
    folder = tmp_path / "in [1]"
    folder.mkdir()
    (folder / "old.csv.gz").write_bytes(b"not a gzip file: opening it fails")
    lines = [f"{i},{'x' * (i % 40)}" for i in range(3000)]
    (folder / "new.csv").write_text("\n".join(["k,v", *lines]) + "\n")
    (folder / "empty.csv").write_text("k,v\n")
    root = str(folder).replace("[", "\\[").replace("]", "\\]")
    listed = spark.read.format("binaryFile").load(root).select(F.col("_metadata.file_path").alias("_source_file"))
    known = listed.where("_source_file like '%old.csv.gz'")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # several blocks a file
    try:
        rows = files.ingest_landing(spark, root, ["k", "v"], known)
        assert sorted((r._line, r.k) for r in rows.collect()) == [(i + 1, str(i)) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    again = files.ingest_landing(spark, root, ["k", "v"], listed)
    assert again.count() == 0 and again.columns == ["k", "v", "_source_file", "_line", "_ingested_at"]


def test_nested_records_by_hand(spark):
    schema = "id long, a struct<b: struct<c: int>, d: string>, tags array<string>, kids array<struct<n: int, toys array<struct<id: long>>>>, m map<string, int>".replace("toys array", "toys: array")
    rows = [(1, ((7,), "x"), ["p", None], [(1, [(10,), (11,)]), (2, None), None], {"q": 1}), (2, None, [], None, None), (None, (None, "y"), ["z"], [(3, [])], None)]
    out = nested.normalize_nested(spark.createDataFrame(rows, schema), ["id"], "r")
    plain = {k: Counter(map(tuple, v.drop("m").collect())) for k, v in out.items()}
    assert {k: v.columns for k, v in out.items()} == {"r": ["id", "a__b__c", "a__d", "m"], "r__tags": ["_key_id", "_pos", "value"], "r__kids": ["_key_id", "_pos", "n"], "r__kids__toys": ["_key_id", "_pos", "_pos2", "id"]}
    assert plain == {"r": Counter([(1, 7, "x"), (2, None, None), (None, None, "y")]), "r__tags": Counter([(1, 0, "p"), (1, 1, None), (None, 0, "z")]), "r__kids": Counter([(1, 0, 1), (1, 1, 2), (1, 2, None), (None, 0, 3)]), "r__kids__toys": Counter([(1, 0, 0, 10), (1, 0, 1, 11)])}
    with pytest.raises(ValueError, match="a__d"):
        nested.flatten(spark.createDataFrame(rows, schema).withColumn("A__d", F.lit(1)))
    parents = spark.createDataFrame([(None,), (2,)], "id long")
    kept = nested.replace_children(out["r__tags"], out["r__tags"].limit(0), parents, ["id"])
    assert Counter(map(tuple, kept.collect())) == Counter([(1, 0, "p"), (1, 1, None)])


def test_mask_probes_on_nulls_and_empty(spark):
    raw = spark.createDataFrame([("ab1", 1), ("cb1", 2), (None, 3), ("xy2", 3)], "s string, v int")
    masked = raw.select(F.concat(F.lit("**"), F.substring("s", -1, 1)).alias("s"), F.lit(None).cast("int").alias("v"))
    got = {r.probe: (r.raw, r.masked, r.verdict) for r in governance.mask_audit(raw, masked, {"raw": "s = 'ab1'", "end": F.col("s").endswith("1"), "none": "s = 'q'"}, ["s", "v"]).collect()}
    assert got == {"raw": (1, 0, "closed"), "end": (2, 2, "open"), "none": (0, 0, "nothing"), "distinct s": (3, 2, "partly"), "distinct v": (3, 0, "closed")}
    assert {(r.raw, r.masked, r.verdict) for r in governance.mask_audit(raw.limit(0), masked.limit(0), {"raw": "s = 'ab1'"}, ["s"]).collect()} == {(0, 0, "nothing")}


ORDERS = "id long, k string, v long, seq int"


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, ORDERS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def views():
    return {"sums": buckets.View("base", {"k": F.col("k")}, {"v": F.col("v")}, F.col("v").isNull() | (F.col("v") >= 0)), "sizes": buckets.View("sums", {"big": F.col("v") > 10})}


def contents(path):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/*/batch_id=*/bucket=*/*.parquet")}


def test_buckets_follow_changes_and_leave_others(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"

    def run():
        return buckets.maintain(ev.read_events(spark, f"{source}/*", spark.createDataFrame([], ORDERS).schema), out, ["id"], "seq", views(), 8)

    def table(store, name, batch=None):
        return Counter(map(tuple, store.read(name, batch).collect()))

    first = [(i, "abc"[i % 3], i, 1) for i in range(40)] + [(None, None, None, 1)]
    land(spark, source, "a", first)
    store = run()
    live = {r[0]: r for r in first}
    expect = lambda: Counter({(k, sum(r[2] or 0 for r in live.values() if r[1] == k and (r[2] is None or r[2] >= 0)), n): 1 for k, n in Counter(r[1] for r in live.values() if r[2] is None or r[2] >= 0).items()})
    assert table(store, "base") == Counter(live.values()) and table(store, "sums") == expect()
    assert table(store, "sizes") == Counter([(True, 3), (False, 1)])
    before = contents(tmp_path / "out")
    land(spark, source, "b", [(4, "c", 100, 2), (5, "b", 7, 0), (7, "a", -1, 2), (7, "a", 3, 1)])  # moved, too late, taken out of the view, older than the one beside it
    store = run()
    live |= {4: (4, "c", 100, 2), 7: (7, "a", -1, 2)}
    assert table(store, "base") == Counter(live.values()) and table(store, "sums") == expect()
    after = contents(tmp_path / "out")
    assert {f: after[f] for f in before} == before  # nothing that was written is written again
    new = {f.split("/base/batch_id=1/")[1].split("/")[0] for f in after if "/base/batch_id=1/" in f}
    assert 1 <= len(new) <= 3 < len({f.split("bucket=")[1] for f in before if "/base/" in f})
    assert sum(table(store, "sums", 0).values()) == 4 and store.batches() == [0, 1]
    for folder in glob.glob(str(tmp_path / "out" / "marks" / "batch_id=1")):  # as if the batch had failed at its end: it comes again
        os.rename(folder, tmp_path / "mark-gone")
    for name in ("1", ".1.crc"):
        os.remove(tmp_path / "out" / "checkpoint" / "commits" / name)
    assert table(store, "base") == Counter(r for r in first)
    store = run()
    assert store.batches() == [0, 1] and table(store, "base") == Counter(live.values()) and table(store, "sums") == expect()
    store.prune()
    assert store.batches() == [1] and table(store, "sums") == expect() and table(store, "base") == Counter(live.values())
    with pytest.raises(ValueError, match="no table"):
        store.read("other")


def test_buckets_count_once_and_total(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    schema = spark.createDataFrame([], ORDERS).schema
    for i, rows in enumerate(([(1, "a", 1, 0), (2, "b", 2, 0), (1, "z", 9, 9)], [(1, "q", 5, 9), (3, "a", 3, 0), (2, "b", 2, 0)], [])):
        land(spark, source, f"f{i}", rows)
        once = buckets.maintain(ev.read_events(spark, f"{source}/*", schema), f"{out}/once", ["id"], None, {"n": buckets.View("base", {"all": F.lit(1)}, {"v": F.col("v").cast("decimal(9,2)")})}, 4)
        totals = buckets.running_totals(ev.read_events(spark, f"{source}/*", schema), "k", "id", F.col("v"), f"{out}/totals", 4)
    assert [r.n for r in once.read("n").collect()] == [3] and {r.id: r.k for r in once.read("base").collect()}[2] == "b" and once.read("base").where("id = 1 and k = 'q'").count() == 0
    assert Counter((r.id, r.k, r.running) for r in totals.collect()) == Counter([(1, "a", 1), (2, "b", 2), (1, "z", 9), (1, "q", 5), (3, "a", 4), (2, "b", 4)])
    with pytest.raises(ValueError, match="exact"):
        buckets.View("base", {}, {"v": F.col("v").cast("double")}).parts(spark.createDataFrame([], f"_old struct<{ORDERS.replace(' ', ':').replace(',:', ',')}>, _new struct<{ORDERS.replace(' ', ':').replace(',:', ',')}>"))


def test_join_of_changes_by_hand(spark, tmp_path):
    """Versions in any order, deletes and returns on both sides, null keys; buckets that a batch doesn't touch keep their files."""
    left, right = "k long, id long, a string, seq long", "k long, b string, seq long"
    steps = [
        ([(1, 10, "x", 0), (1, 11, "y", 5), (2, 20, "z", 0), (None, 30, "n", 0)], [(1, "p", 0), (None, "q", 0)], {(10, "x", "p"), (11, "y", "p")}),
        ([(1, 11, "old", 4), (1, 10, None, 1)], [(2, "r", 3)], {(11, "y", "p"), (20, "z", "r")}),
        ([(1, 10, "back", 2)], [(2, "late", 2), (1, None, 1)], {(20, "z", "r")}),
        ([], [(1, "again", 2)], {(10, "back", "again"), (11, "y", "again"), (20, "z", "r")}),
    ]
    out, sizes = f"file://{tmp_path}/out", []
    for n, (a, b, want) in enumerate(steps):
        spark.createDataFrame(a, left).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a/{n}")
        spark.createDataFrame(b, right).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b/{n}")
        streams = [ev.read_events(spark, f"{tmp_path}/{s}/*", spark.createDataFrame([], schema).schema) for s, schema in (("a", left), ("b", right))]
        store = buckets.join_changes(*streams, "k", "id", "seq", out, 64)
        assert store.read("view").columns == ["id", "a", "b"]
        assert {tuple(r) for r in store.read("view").collect()} == want
        sizes.append(store.mark()[0])
    assert len({b for (name, _), b in sizes[-1].items() if name == "left"}) == 2  # key 1 was last written by batch 3 or 2, key 2 stays in batch 0
    assert {tuple(r) for r in store.read("view", 1).collect()} == steps[1][2]
