"""Streaming queries: block files written from the events table, read back as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..adapters import sig
from ..session import shared_folder
from ..sources.blocks import to_blocks
from ..streaming import carries
from .common import query
from .signal import ENV
from .spectra import vectors


def run(spark, blocks, build, schema):
    """Write block files, stream them through `build`, and read what the sink holds."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    blocks.repartition(6, "block_ix").write.parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", carries.STORE)
    out = build(carries.read_block_stream(spark, f"{root}/in", 2))
    carries.run_available(out, f"{root}/out", f"{root}/state")
    return spark.read.schema(schema).parquet(f"{root}/out")


def with_end(blocks):
    end = blocks.groupBy("capture_id", "channel").agg(F.max("block_ix").alias("_e"))
    return blocks.join(end, ["capture_id", "channel"]).select("capture_id", F.col("channel").cast("int").alias("channel"), "block_ix", "start_sample", "samples", (F.col("block_ix") == F.col("_e")).alias("last"))


@query("k1_streaming_envelope", "with" + ENV + " select capture_id, win_ix, round(rms_db, 6) as rms_db from env")
def k1(spark, d):
    b = with_end(to_blocks(sig(spark, d).withColumn("channel", F.lit(0)), 512))
    out = run(spark, b, lambda s: carries.stream_envelope(s, 5), "capture_id string, channel int, win_ix bigint, rms_db double").drop("channel")
    return out.withColumn("rms_db", F.round("rms_db", 6))


@query("k2_streaming_events")
def k2(spark, d):
    two = sig(spark, d).withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("amp", F.when(F.col("channel") == 1, -F.col("amp")).otherwise(F.col("amp")))
    return run(spark, with_end(to_blocks(two, 2048)), carries.stream_events, carries.EVENTS)


@query("k3_streaming_flux", """with e as (select vec_id, list_transform(embedding, lambda x: x::double * x::double) as p from embeddings), z as (select vec_id, list_transform(p, lambda x: x / list_sum(p)) as p from e),
  w as (select vec_id, vec_id // 100 as s, p, lag(p) over (partition by vec_id // 100 order by vec_id) as q from z)
  select cast(s as varchar) as capture_id, vec_id as win_ix, round(case when q is null then 0 else list_sum(list_transform(list_zip(p, q), lambda x: greatest(x[1] - x[2], 0))) end, 8) as flux from w""")
def k3(spark, d):
    v = vectors(spark, d).select(F.expr("cast(vec_id div 100 as string)").alias("capture_id"), F.lit(0).alias("channel"), (F.col("vec_id") % 100).alias("block_ix"), "vec_id", F.col("vec_id").alias("start_sample"),
                                 F.transform("v", lambda x: x * x).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    last = F.col("vec_id") == F.least((F.expr("vec_id div 100") + 1) * 100 - 1, F.lit(v.agg(F.max("vec_id")).first()[0]))
    b = v.select("capture_id", "channel", "block_ix", "start_sample", F.transform("p", lambda x: x / total).alias("samples"), last.alias("last"))
    out = run(spark, b, carries.stream_flux, "capture_id string, channel int, win_ix bigint, flux double").drop("channel")
    return out.withColumn("flux", F.round("flux", 8))
