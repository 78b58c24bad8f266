"""Scans, sinks and logs over files that Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions import money, total
from ashlar.lineage import scratch
from ashlar.operators import merge, nested
from ashlar.plans.catalog import Tables, query
from ashlar.plans.relational import V1, V2, versions
from ashlar.sources import files, images, log
from ashlar.sources.keyed import KeyedTable
from ashlar.streaming import events as ev

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
BY_STATUS = "select o_orderstatus, count(*) as n, sum(o_totalprice::decimal(18,2))::double as total from orders group by 1"


def orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), total(money("o_totalprice")).alias("total"))


@query(BY_STATUS)
def s1_read_csv(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    files.write_table(orders(t), path, "csv", header="true")
    return by_status(files.read_csv(t.spark, path, ORDERS))


@query("select l_orderkey, l_quantity from lineitem where l_quantity >= 49 and l_shipdate >= timestamp '1997-01-01'")
def s2_read_table(t: Tables) -> DataFrame:
    where = (F.col("l_quantity") >= 49) & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return files.read_table(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], where)


@query("select codec, o_orderstatus, n, total from (select unnest(['none', 'snappy', 'zstd']) as codec), (" + BY_STATUS + ")")
def s3_orc(t: Tables) -> DataFrame:
    out = []
    for codec in ("none", "snappy", "zstd"):
        path = scratch(t.spark, "orc")
        files.write_table(orders(t), path, "orc", compression=codec)
        out.append(by_status(files.read_table(t.spark, path, ["o_orderstatus", "o_totalprice"], fmt="orc", schema=ORDERS)).withColumn("codec", F.lit(codec)))
    return merge.union(*out)


@query("select event_id, user_id, (props->>'k')::bigint as k from events")
def s4_read_json(t: Tables) -> DataFrame:
    path = scratch(t.spark, "json")
    files.write_table(t.events.select("event_id", "user_id", F.from_json("props", "k long").alias("props")), path, "json")
    return files.read_json(t.spark, path, "event_id long, user_id long, props struct<k: long>").select("event_id", "user_id", "props.k")


@query("select o_orderstatus as status, count(*) as n, count(*)::bigint as last_line, 1 as files from orders where o_orderstatus <> 'F' group by 1")
def s5_ingest_landing(t: Tables) -> DataFrame:
    """Files of status F are in the ledger already; one file a status."""
    folder = scratch(t.spark, "landing")
    for status in [r[0] for r in t.orders.select("o_orderstatus").distinct().collect()]:  # each by a task that sorts nothing
        orders(t).where(F.col("o_orderstatus").eqNullSafe(status)).coalesce(1).write.option("header", "true").csv(f"{folder}/part={status}")
    known = t.spark.read.option("header", "true").csv(f"{folder}/part=F").select(F.col("_metadata.file_path").alias("_source_file"))
    rows = files.ingest_landing(t.spark, folder, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], known)
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("_line").alias("last_line"), F.count_distinct("_source_file").cast("int").alias("files"))


@query("select count(*) as n, count(distinct event_id) as ids, max(event_id) as last from events")
def s7_stream_scan(t: Tables) -> DataFrame:
    """The events in many files, some of them a batch."""
    folder = scratch(t.spark, "stream-source")
    t.events.repartition(6, "event_id").write.parquet(folder)
    rows = ev.write_stream(ev.read_events(t.spark, folder, t.events.schema, files_per_batch=2), ev.fresh_folder(t.spark, "s7"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.max("event_id").alias("last"))


@query("select event_id, event_type from events where (event_type = 'view' and event_id >= 100 and event_id < 700) or (event_type = 'click' and event_id >= 300) or event_type not in ('view', 'click')")
def s8_read_log(t: Tables) -> DataFrame:
    return files.read_log(t.events, "event_type", "event_id", {"view": 100, "click": 300}, {"view": 700}).select("event_id", "event_type")


def event_log(t: Tables) -> tuple[str, DataFrame]:
    """The folder of a log of events in two commits, and what it was given."""
    log.register(t.spark)
    path = scratch(t.spark, "log")
    rows = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    for odd in (0, 1):
        rows.where(F.col("value").cast("long") % 2 == odd).write.format("ashlar_log").option("path", path).mode("append").save()
    return path, rows


@query("select crc32_mod as part, n, n as last_offset_1, 0::bigint as first_offset, ids from (select 0 as crc32_mod, count(*) as n, count(distinct event_id) as ids from events)")
def s8_log_source(t: Tables) -> DataFrame:
    """A log of one part: offsets have no gap and no row is lost or doubled."""
    log.register(t.spark)
    path = scratch(t.spark, "log")
    t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts")).write.format("ashlar_log").option("path", path).option("parts", 1).mode("append").save()
    rows = t.spark.read.format("ashlar_log").option("path", path).load()
    return rows.groupBy("part").agg(F.count("*").alias("n"), (F.max("offset") + 1).alias("last_offset_1"), F.min("offset").alias("first_offset"), F.count_distinct("value").alias("ids"))


@query("select event_id, user_id, ts from events")
def s8_log_stream(t: Tables) -> DataFrame:
    """A log read as a stream and written to another by a stream, each row once."""
    path, _ = event_log(t)
    copy = scratch(t.spark, "log")
    stream = t.spark.readStream.format("ashlar_log").option("path", path).load().select("key", "value", "ts")
    stream.writeStream.format("ashlar_log").option("path", copy).option("checkpointLocation", f"{copy}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.format("ashlar_log").option("path", copy).load()
    return rows.select(F.col("value").cast("long").alias("event_id"), F.col("key").cast("long").alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("select 'seq' as by, count(*) as n, min(event_id) as first_id from events where event_id >= 500 union all select 'time', count(*), min(event_id) from events where ts >= timestamp '2024-01-20' union all select 'last', count(*), min(id) from (select max(event_id) as id from events group by user_id) union all select 'all', count(*), min(event_id) from events")
def s9_replay(t: Tables) -> DataFrame:
    log = t.events.select("event_id", "ts", "user_id", "value")
    kinds = {"seq": files.replay(log, "event_id", "ts", from_seq=500), "time": files.replay(log, "event_id", "ts", from_ts=F.lit("2024-01-20").cast("timestamp_ntz")), "last": files.replay(log, "event_id", "ts", last_per=["user_id"]), "all": files.replay(log, "event_id", "ts")}
    return merge.union(*(df.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).withColumn("by", F.lit(k)) for k, df in kinds.items()))


@query("select o_orderstatus, count(*) as n, sum((case when o_orderstatus = 'P' then o_totalprice * 2 else o_totalprice end)::decimal(18,2))::double as total from orders group by 1")
def s10_write_partitioned(t: Tables) -> DataFrame:
    """A second write replaces the one partition that it has."""
    path = scratch(t.spark, "partitioned")
    files.write_partitioned(orders(t), path, ["o_orderstatus"])
    files.write_partitioned(orders(t).where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, ["o_orderstatus"])
    return by_status(files.read_table(t.spark, path, schema="o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string"))


@query("select event_type, count(*) as n from events group by 1")
def s11_write_stream(t: Tables) -> DataFrame:
    """Appended by a checkpointed stream that is stopped half-way and goes on with more files."""
    source, folder = scratch(t.spark, "stream-source"), ev.fresh_folder(t.spark, "s11")
    t.events.where("event_id % 2 = 0").write.parquet(source)
    stream = lambda: ev.read_events(t.spark, source, t.events.schema, files_per_batch=1)
    ev.write_stream(stream(), folder)
    t.events.where("event_id % 2 = 1").write.mode("append").parquet(source)
    return ev.write_stream(stream(), folder).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"with a as ({V1}), b as ({V2}) select o_orderkey, coalesce(b.o_totalprice, a.o_totalprice) as o_totalprice from a full join b using (o_orderkey)")
def s13_upsert_sink(t: Tables) -> DataFrame:
    """Two versions as a stream of files: the later one overwrites by key."""
    source = scratch(t.spark, "stream-source")
    for n, df in enumerate(versions(t)):
        df.withColumn("v", F.lit(n)).coalesce(1).write.mode("append").parquet(source)
    stream = ev.read_events(t.spark, source, t.spark.read.parquet(source).schema, files_per_batch=1)
    return ev.upsert_sink(stream, ["o_orderkey"], ev.fresh_folder(t.spark, "s13"), "append", order="v").select("o_orderkey", "o_totalprice")


#: Every seventh event is corrected, every eleventh deleted; what is older comes again at last.
WRITES = [(0, "true", "value", False), (2, "event_id % 7 = 0", "value + 1", False), (3, "event_id % 11 = 0", "value", True), (1, "event_id % 5 = 0", "-1.0", False)]
STORED = "select user_id, event_id, case when event_id % 7 = 0 then value + 1 when event_id % 5 = 0 then -1.0 else value end as value from events where event_id % 11 <> 0"


def keyed_events(t: Tables, label: str) -> KeyedTable:
    """Events by user, written by a stream of four batches."""
    source, folder = scratch(t.spark, "stream-source"), ev.fresh_folder(t.spark, label)
    table = KeyedTable(t.spark, folder, ["user_id"], ["event_id"], "seq", "gone", buckets=16, spread=2)
    schema = "user_id long, event_id long, value double, seq int, gone boolean"
    for n, (seq, where, value, gone) in enumerate(WRITES):
        rows = t.events.where(where).select("user_id", "event_id", F.expr(value).cast("double").alias("value"), F.lit(seq).alias("seq"), F.lit(gone).alias("gone"))
        rows.coalesce(4).write.parquet(f"{source}/{n}")
        table.write_stream(t.spark.readStream.schema(schema).parquet(f"{source}/*"))
    return table


@query(STORED)
def s13_keyed_sink(t: Tables) -> DataFrame:
    """Streams upserted into a table by keys, stopped after each batch and gone on with; a batch rewrites the buckets of its keys."""
    return keyed_events(t, "s13k").read().select("user_id", "event_id", "value")


@query(f"select user_id, count(*) as n, sum(value::decimal(18,2))::double as total from ({STORED}) where user_id in (select c_custkey from customer where c_custkey % 50 = 3) group by 1")
def s14_keyed_lookup(t: Tables) -> DataFrame:
    """Rows of the asked users only, from their buckets only."""
    asked = t.customer.where("c_custkey % 50 = 3").select(F.col("c_custkey").alias("user_id"))
    return keyed_events(t, "s14k").lookup(asked).groupBy("user_id").agg(F.count("*").alias("n"), total(money("value")).alias("total"))


@query("select fmt, o_orderstatus, n, total from (select unnest(['csv', 'json', 'orc', 'parquet']) as fmt), (" + BY_STATUS + ")")
def s14_formats(t: Tables) -> DataFrame:
    """The same write and read through several stores' formats; JDBC and table formats take their options alike."""
    out = []
    for fmt in ("csv", "json", "orc", "parquet"):
        path = scratch(t.spark, fmt)
        files.write_table(orders(t), path, fmt)
        out.append(by_status(files.read_table(t.spark, path, fmt=fmt, schema=ORDERS)).withColumn("fmt", F.lit(fmt)))
    return merge.union(*out)


@query()
def s15_read_images(t: Tables) -> DataFrame:
    """Path and length of the tables' files, contents unread."""
    return files.read_images(t.spark, t.sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


#: Pictures by supplier: a colour by nation with one pixel of another; every tenth file is cut short. Fixed by the query and its SQL.
PICTURES = [(220, 40, 40), (40, 180, 60), (50, 80, 210), (250, 250, 250), (20, 20, 20), (128, 128, 128), (240, 150, 30)]


def pictures(t: Tables) -> DataFrame:
    """file, length and content of an image file for each supplier, as written before."""
    colour = F.element_at(F.array(*(F.array(*map(F.lit, rgb)) for rgb in PICTURES)), F.col("s_nationkey") % len(PICTURES) + 1)
    wide, high = (F.col("s_suppkey") % 5 + 3).cast("int"), (F.col("s_suppkey") % 4 + 2).cast("int")
    pixels = F.concat(F.array(F.lit(1), F.lit(2), F.lit(3)), F.flatten(F.array_repeat(colour, wide * high - 1)))
    made = t.supplier.select(F.format_string("%d.png", "s_suppkey").alias("name"), images.encode_images(pixels, wide).alias("content"))
    short = F.when(F.col("name").rlike("3.png$"), F.expr("substring(content, 1, length(content) - 20)")).otherwise(F.col("content"))
    folder = scratch(t.spark, "images")
    written = images.write_files(made.withColumn("content", short), folder, "name", "content").agg(F.count("*")).first()[0]
    if not written:  # an empty table has no folder
        return t.spark.createDataFrame([], "file string, length long, content binary")
    return files.read_images(t.spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content")


@query("select s_suppkey || '.png' as file, case when s_suppkey % 10 <> 3 then (s_suppkey % 5 + 3)::int end as width, case when s_suppkey % 10 <> 3 then (s_suppkey % 4 + 2)::int end as height from supplier")
def s15_image_files(t: Tables) -> DataFrame:
    """Image files that the query wrote, read and decoded; those cut short are null."""
    return images.decode_images(pictures(t), "content").select("file", "width", "height")


@query("""with c as (select s_suppkey || '.png' as file, case when s_suppkey % 10 <> 3 then s_nationkey % 7 end as i from supplier)
select file, ['red', 'green', 'blue', 'white', 'black', 'gray', 'orange'][i + 1] as colour, ['#dc2828', '#28b43c', '#3250d2', '#fafafa', '#141414', '#808080', '#f0961e'][i + 1] as hex,
[86.3, 70.6, 82.4, 98.0, 7.8, 50.2, 94.1][i + 1]::double as brightness, [81.8, 77.8, 76.2, 0, 0, 0, 87.5][i + 1]::double as saturation from c""")
def f5_image_files(t: Tables) -> DataFrame:
    """Features of the decoded pixels."""
    return images.picture_features(images.decode_images(pictures(t), "content"), "pixels").select("file", "colour", "hex", "brightness", "saturation")


ORDER_LINES = "select o_orderkey as _key_o_orderkey, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as _pos, l_partkey as part__partkey, l_suppkey as part__suppkey, l_quantity as quantity from orders join lineitem on l_orderkey = o_orderkey"


def order_documents(t: Tables) -> DataFrame:
    """Orders as nested records: the customer as a struct, the lines as a list of structs."""
    line = F.struct("l_linenumber", F.struct(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).alias("part"), F.col("l_quantity").alias("quantity"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    customer = F.struct(F.col("o_custkey").alias("custkey"), F.struct(F.col("o_orderpriority").alias("priority")).alias("terms")).alias("customer")
    return t.orders.select("o_orderkey", customer).join(lines, "o_orderkey", "left")


@query("select o_orderkey, o_custkey as customer__custkey, o_orderpriority as customer__terms__priority from orders")
def s16_normalize_parent(t: Tables) -> DataFrame:
    return nested.normalize_nested(order_documents(t), ["o_orderkey"], "orders")["orders"]


@query(ORDER_LINES)
def s16_normalize_children(t: Tables) -> DataFrame:
    return nested.normalize_nested(order_documents(t), ["o_orderkey"], "orders")["orders__lines"].drop("l_linenumber")


@query(f"with l as ({ORDER_LINES}), n as (select *, max(_pos) over (partition by _key_o_orderkey) as top from l) select _key_o_orderkey, _pos, part__partkey, part__suppkey, quantity from n where _key_o_orderkey % 5 <> 0 or _pos < top")
def s16_replace_children(t: Tables) -> DataFrame:
    """Every fifth order comes again without its last line."""
    stored = order_documents(t)
    again = stored.where("o_orderkey % 5 = 0").withColumn("lines", F.expr("slice(lines, 1, greatest(size(lines) - 1, 0))"))
    lines = lambda df: nested.normalize_nested(df, ["o_orderkey"], "orders")["orders__lines"]
    return nested.replace_children(lines(stored), lines(again), again, ["o_orderkey"]).drop("l_linenumber")


@query("select count(*) as n, sum(l_quantity::decimal(18,2))::double as qty, true as fewer, true as same from lineitem")
def m26_compact_files(t: Tables) -> DataFrame:
    many, few = scratch(t.spark, "many-files"), scratch(t.spark, "few-files")
    t.lineitem.repartition(24, "l_orderkey", "l_linenumber").write.parquet(many)
    before, after = t.spark.read.parquet(many), files.compact_files(t.spark, many, few)
    same = merge.checksum(before).join(merge.checksum(after), ["rows", "digest"]).agg((F.count("*") == 1).alias("same"))
    fewer = after.select(F.col("_metadata.file_name").alias("f")).distinct().agg((F.count("*") < 24).alias("fewer"))
    return after.agg(F.count("*").alias("n"), total(money("l_quantity")).alias("qty")).crossJoin(fewer).crossJoin(same)  # one row each


@query("select o_orderstatus as batch, count(*) as n from orders where o_orderstatus = 'O' group by 1")
def t17_pending_batches(t: Tables) -> DataFrame:
    """Batch F is done, O is ready, P isn't yet."""
    folder = scratch(t.spark, "batches")
    for name in ("F", "O", "P"):
        rows = orders(t).where(F.col("o_orderstatus") == name)
        rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/{name}/rows")
    for name, marker in (("F", "READY"), ("F", "_SUCCESS"), ("O", "READY")):
        files.write_marker(t.spark, f"{folder}/{name}", marker)
    ready = files.pending_batches(files.marker_files(t.spark, folder))
    rows = t.spark.read.schema(ORDERS).parquet(f"{folder}/*/rows").withColumn("batch", F.element_at(F.split("_metadata.file_path", "/"), -3))
    return rows.join(ready, "batch").groupBy("batch").agg(F.count("*").alias("n"))
