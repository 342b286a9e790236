"""Named queries over the test tables, with the SQL that each is held against.

The corpus of most is `embeddings`: 64 inputs and the label as output, dealt over 8 files by vec_id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import measure
from ..functions import bf16
from ..operators import quantise as quantising
from ..operators import records as recs
from ..operators import sample as sampling
from ..operators.fuzz import Policy, counts, fuzz
from ..shape import RecordShape
from ..sources import manifest as manifests
from ..sources.verify import not_contained
from .pipeline import Pipeline, stage_seeds

SEED, RATE, SHAPE = 73_519, 0.25, RecordShape(64, 1)
POLICIES = {
    "fuzz_uniform_absolute": Policy.named("uniform", 0.07, "absolute"),
    "fuzz_uniform_relative": Policy.named("uniform", 0.11, "relative"),
    "fuzz_gaussian_absolute": Policy.named("gaussian", 0.03, "absolute"),
    "fuzz_gaussian_relative": Policy.named("gaussian", 0.02, "relative"),
    "fuzz_targets_outputs": Policy.named("gaussian", 0.4, "absolute", "outputs"),
    "fuzz_targets_all": Policy.named("uniform", 0.3, "relative", "all"),
    "fuzz_clamped": Policy.named("uniform", 90.0, "absolute", "inputs", -2.5, 4.0),
    "fuzz_one_sided": Policy.named("gaussian", 6.0, "absolute", "inputs", None, 1.5),
}
STEPS = ({"transform": "sample", "rate": RATE}, {"transform": "fuzz", "distribution": "gaussian", "scale": 0.01, "mode": "relative"}, {"transform": "quantise", "scheme": "bfloat16"})


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return recs.from_table(table, "vec_id", F.concat("embedding", F.array(F.col("label").cast("float"))))


def each(records: DataFrame) -> DataFrame:
    """A row per value."""
    rows = records.select("pos", F.posexplode("values").alias("i", "value"))
    return rows.select("pos", F.col("i").cast("bigint").alias("i"), F.col("value").cast("double").alias("value"))


def scan_records(spark, d):
    return each(corpus(spark, d))


def corpus_geometry(spark, d):
    rows = corpus(spark, d).select(F.size("values").alias("n"))
    n, width = F.count(F.lit(1)), F.max("n").cast("bigint")
    return rows.agg(n.alias("record_count"), width.alias("record_values"), (width * 4).alias("bytes_per_record"), (n * width * 4).alias("total_bytes"))


def discovery_order(spark, d):
    return corpus(spark, d).groupBy("file_name", "file_ord").agg(F.count(F.lit(1)).alias("records")).select("file_name", F.col("file_ord").cast("bigint").alias("file_ord"), "records")


def read_record(spark, d):
    return each(recs.read_record(corpus(spark, d), 17, 500))


def split_inputs_outputs(spark, d):
    return corpus(spark, d).select("pos", F.aggregate(F.slice("values", 1, 64), F.lit(0.0), lambda a, v: a + v.cast("double")).alias("input_sum"), F.element_at("values", 65).cast("double").alias("output"))


def synthetic_corpus(spark, d):
    """As many synthetic records as there are embeddings, by the generator and held against their ids by a join."""
    ids = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("bigint").alias("pos"))
    return each(recs.synthetic(spark, 1, ids.count(), RecordShape(3, 1)).join(ids, "pos", "left_semi"))


def sample_bernoulli(spark, d):
    return sampling.kept(corpus(spark, d), RATE, SEED).select("pos")


def sample_full_rate(spark, d):
    return sampling.kept(corpus(spark, d), 1.0, SEED).agg(F.count(F.lit(1)).alias("kept"))


def sample_block_shuffle(spark, d):
    out = sampling.sample(corpus(spark, d), RATE, SEED)
    return out.select(F.col("file_ord").cast("bigint").alias("file_ord"), "rec_idx", "pos")


def sample_share_by_file(spark, d):
    out = sampling.share_by_file(corpus(spark, d), RATE, SEED)
    return out.select(F.col("file_ord").cast("bigint").alias("file_ord"), "records_read", "records_kept")


def sample_names(spark, d):
    """What samples at the rates of discounts, and at an eighth of them, would be called."""
    rates = spark.read.parquet(f"{d}/lineitem.parquet").where("l_discount > 0").select(F.explode(F.array(F.col("l_discount").cast("double"), F.col("l_discount") / 8)).alias("rate"))
    return rates.distinct().select("rate", sampling.file_name_of("rate").alias("file_name"))


def whole_pass_bytes(spark, d):
    size = corpus(spark, d).count() * SHAPE.bytes_per_record
    return spark.createDataFrame([(sampling.expected_bytes(size, SHAPE.bytes_per_record, RATE),)], "expected_bytes bigint")


def quantise_bf16(spark, d):
    return each(quantising.quantise(corpus(spark, d)))


def quantise_bf16_expression(spark, d):
    """The rounding as a column expression, on a plain table."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("float").alias("x"))
    return rows.select("pos", bf16.rounded(F.col("x")).cast("double").alias("value"))


def quantise_error(spark, d):
    out = quantising.rounding_report(corpus(spark, d))
    return out.select("values", "non_zero", F.round("max_relative", 9).alias("max_relative"), F.round("mean_relative", 9).alias("mean_relative"), F.round("max_absolute", 9).alias("max_absolute"))


def error_probe_report(spark, d):
    """Rounding errors of probe records, one for each embedding."""
    probe = recs.error_probe(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", RecordShape(250, 6))
    out = quantising.rounding_report(probe)
    return out.select("values", "non_zero", F.round("max_relative", 9).alias("max_relative"), F.round("mean_relative", 9).alias("mean_relative"), F.round("max_absolute", 9).alias("max_absolute"))


def fuzz_query(policy: Policy):
    return lambda spark, d: each(fuzz(corpus(spark, d), policy, SHAPE, SEED))


def fuzz_counts(spark, d):
    return counts(corpus(spark, d), POLICIES["fuzz_clamped"], SHAPE, SEED)


def fuzz_preserve_non_finite(spark, d):
    """Every third record starts with NaN, every fifth then has an infinity: what becomes of them, by class."""
    rows = corpus(spark, d)
    marked = F.transform("values", lambda v, i: F.when((i == 0) & (F.col("pos") % 3 == 0), F.lit(float("nan"))).when((i == 1) & (F.col("pos") % 5 == 0), F.lit(float("inf"))).otherwise(v).cast("float"))
    out = fuzz(rows.withColumn("values", marked), POLICIES["fuzz_clamped"], SHAPE, SEED).select(F.explode("values").alias("v"))
    v = F.col("v")
    return out.agg(F.count_if(F.isnan(v)).alias("nans"), F.count_if(v == float("inf")).alias("infinities"), F.count_if(~F.isnan(v) & (F.abs(v) != float("inf"))).alias("finite"))


def run(steps: tuple):
    return lambda spark, d: each(Pipeline(steps).apply(corpus(spark, d), SHAPE, SEED)[0])


def stage_seeds_of_orders(spark, d):
    """The seeds that stages at the positions of order keys would have."""

    def batches(it):
        for batch in it:
            seeds = stage_seeds(SEED, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seeds).cast(pa.string())], names=["position", "seed"])

    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint")).mapInArrow(batches, "position bigint, seed string")


def record_digests(spark, d):
    text = F.array_join(F.transform("values", lambda v: F.round(v.cast("double") * 1_000_000).cast("bigint").cast("string")), ",")
    return corpus(spark, d).select("pos", F.sha2(text, 256).alias("digest"))


def sample_containment(spark, d):
    source = corpus(spark, d)
    return not_contained(sampling.sample(source, RATE, SEED), source).agg(F.count(F.lit(1)).alias("not_in_source"))


def baseline_compare(spark, d):
    """Two sets of made-up cases: orders by priority, of customers with even and with odd keys, some left out."""
    orders = spark.read.parquet(f"{d}/orders.parquet")

    def cases(odd: int, without: str) -> DataFrame:
        part = orders.where((F.col("o_custkey") % 2 == odd) & (F.col("o_orderpriority") != without))
        n, key = F.count(F.lit(1)), F.sum("o_orderkey").cast("bigint")
        return part.groupBy(F.col("o_orderpriority").alias("label")).agg(
            F.lit(1000).cast("bigint").alias("elapsed_ms"), F.max("o_custkey").cast("bigint").alias("peak_rss_kib"), key.alias("input_bytes"),
            key.alias("output_bytes"), n.alias("records_read"), n.alias("records_written"),
        )

    out = measure.compared(cases(0, "1-URGENT"), cases(1, "5-LOW"), 0.01)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("speed", "memory", "size")], "verdict")


def derived_metrics(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("label")).agg(
        F.lit(1500).cast("bigint").alias("elapsed_ms"), (F.count(F.lit(1)) * 8).alias("input_bytes"), (F.count(F.lit(1)) * 4).alias("output_bytes"), F.count(F.lit(1)).alias("records_read"),
    )
    return measure.derived(orders).select("label", F.round("records_per_second", 6).alias("records_per_second"), F.round("output_ratio", 6).alias("output_ratio"))


def metadata_valid(spark, d):
    """Entries made of parts' names and comments of orders' priorities, some with spaces, no value or no equals sign."""
    kind = F.pmod("p_partkey", F.lit(4))
    key = F.regexp_replace("p_name", " ", F.when(kind == 0, " ").when(kind == 1, "-").otherwise("_"))
    value = F.when(kind == 2, F.repeat("p_name", F.pmod("p_partkey", F.lit(90)).cast("int"))).otherwise(F.lit("v=w"))
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(kind == 3, key).otherwise(F.concat(key, F.lit("="), value)).alias("entry"))
    return rows.select("p_partkey", manifests.is_valid("entry").alias("valid"))


def manifest_timestamp(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", manifests.timestamp_of(F.col("event_id") * 86399).alias("created_at"))


def queries() -> dict:
    from . import disk

    plain = (
        scan_records, corpus_geometry, discovery_order, read_record, split_inputs_outputs, synthetic_corpus, sample_bernoulli,
        sample_full_rate, sample_block_shuffle, sample_share_by_file, sample_names, whole_pass_bytes, quantise_bf16,
        quantise_bf16_expression, quantise_error, error_probe_report, fuzz_counts, fuzz_preserve_non_finite,
        record_digests, sample_containment, baseline_compare, derived_metrics, metadata_valid, manifest_timestamp,
    )
    found = {f.__name__: f for f in plain} | {"stage_seeds": stage_seeds_of_orders} | {name: fuzz_query(p) for name, p in POLICIES.items()}
    return found | {
        "pipeline_sample_fuzz_quantise": run(STEPS),
        "pipeline_quantise_fuzz": run((STEPS[2], STEPS[1])),
        "pipeline_fuzz_quantise": run((STEPS[1], STEPS[2])),
    } | disk.queries()


def oracle_sql() -> dict[str, str]:
    from . import disk, oracle

    return oracle.all_sql() | disk.oracle_sql()
