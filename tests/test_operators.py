import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import errors
from millrace.functions import bf16, draws
from millrace.operators import fuzz as fuzzing
from millrace.operators import quantise as quantising
from millrace.operators import records as recs
from millrace.operators import sample as sampling
from millrace.operators.fuzz import Policy
from millrace.shape import Encoding, RecordShape

SEED, SHAPE = 4_711, RecordShape(2, 1)


def multiples(spark, n, files=1):
    rows = [(i % files, f"s{i % files}.bin", i // files, i, [float(i), 2.0 * i, 3.0 * i]) for i in range(n)]
    return spark.createDataFrame(rows, "file_ord int, file_name string, rec_idx bigint, pos bigint, values array<float>")


def error_report(before, after):
    """Values, non-zero ones, the largest and the mean relative error of these, and the largest absolute error, by a join."""
    pair = before.select("pos", F.col("values").alias("x")).join(after.select("pos", F.col("values").alias("q")), "pos")
    each = pair.select(F.explode(F.arrays_zip("x", "q")).alias("v")).select(F.col("v.x").alias("x"), F.col("v.q").alias("q"))
    error = F.abs(F.col("q") - F.col("x"))
    relative = F.when(F.col("x") != 0, (error / F.abs(F.col("x"))).cast("double"))
    return each.agg(
        F.count(F.lit(1)).alias("values"), F.count_if(F.col("x") != 0).alias("non_zero"), F.max(relative).alias("max_relative"),
        F.avg(relative).alias("mean_relative"), F.max(error).cast("double").alias("max_absolute"),
    )


def exact_bf16(bits):
    """The nearest of the two neighbouring bfloat16 values, by integers."""
    low, rest = bits >> 16, bits & 0xFFFF
    return low + (1 if rest > 0x8000 or rest == 0x8000 and low & 1 else 0)


EDGE = np.array([0x00000000, 0x80000000, 1, 0x80000001, 0x00400000, 0x00008000, 0x00008001, 0x7F7FFFFF, 0xFF7FFFFF, 0x7F800000, 0xFF800000, 0x3F808000, 0x3F818000, 0x7F7F7FFF], np.uint32)


def test_codec_rounds_to_nearest_even():
    every = np.concatenate([EDGE, np.random.default_rng(1).integers(0, 1 << 32, 20_000, dtype=np.uint64).astype(np.uint32)])
    every = every[~np.isnan(every.view(np.float32))]
    assert bf16.encode(every.view(np.float32)).tolist() == [exact_bf16(int(b)) for b in every]


def test_nan_stays_quiet_nan():
    bits = bf16.encode(np.array([np.nan, -np.nan], np.float32))
    assert np.isnan(bf16.decode(bits)).all() and (bits & 0x40).all()


def test_column_expression_equals_codec(spark):
    values = np.concatenate([EDGE.view(np.float32), np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32).view(np.float32)])
    values = values[np.isfinite(values)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double").select("i", F.col("x").cast("float").alias("x"))
    got = [r["y"] for r in df.select("i", bf16.rounded(F.col("x")).alias("y")).orderBy("i").collect()]
    assert np.array_equal(np.array(got, np.float32).view(np.uint32), bf16.decode(bf16.encode(values)).view(np.uint32))


@pytest.mark.parametrize("rate", [0.0, -0.1, 1.1, float("nan")])
def test_rate_is_refused(rate):
    with pytest.raises(errors.InvalidRate):
        sampling.checked_rate(rate)


@pytest.mark.parametrize(("rate", "percent"), [(1.0, 100), (0.5, 50), (0.125, 13), (0.05, 5), (0.004, 0)])
def test_percent(rate, percent):
    assert sampling.percent(rate) == percent


def test_expected_bytes():
    assert sampling.expected_bytes(100 * 12, 12, 0.25) == 300 + 3
    assert sampling.expected_bytes(12 + 5, 12, 0.01) == 12 + 1


def test_share_is_binomial(spark):
    n, p = 30_000, 0.04
    kept = sampling.kept(recs.synthetic(spark, 1, n, SHAPE), p, SEED).count()
    assert abs(kept - n * p) <= 5 * (n * p * (1 - p)) ** 0.5


def test_sample_is_a_block_permutation(spark):
    out = sampling.sample(multiples(spark, 100, 4), 1.0, SEED).orderBy("pos").collect()
    assert [r["pos"] for r in out] == list(range(100))
    assert sorted(r["values"][0] for r in out) == [float(i) for i in range(100)]
    assert [r["values"][0] for r in out] != [float(i) for i in range(100)]
    files = [r["file_ord"] for r in out]
    assert sum(a != b for a, b in zip(files, files[1:])) == 3


def test_partitions_do_not_matter(spark):
    a, b = (sampling.sample(multiples(spark, 200, 3).repartition(n), 0.4, SEED).select("pos", "values").orderBy("pos").collect() for n in (1, 7))
    assert a == b and 0 < len(a) < 200


def test_seeds_matter(spark):
    a, b = ({r["values"][0] for r in sampling.kept(multiples(spark, 300), 0.5, s).collect()} for s in (1, 2))
    assert a != b


def test_repeated_records_draw_for_themselves(spark):
    same = multiples(spark, 1000).withColumn("values", F.array(F.lit(1.0).cast("float"), F.lit(1.0).cast("float"), F.lit(1.0).cast("float")))
    assert 0 < sampling.kept(same, 0.5, SEED).count() < 1000


def test_empty_table(spark):
    none = multiples(spark, 1).where("pos > 5")
    assert sampling.sample(none, 0.5, SEED).count() == 0
    assert quantising.quantise(none).count() == 0
    assert fuzzing.counts(none, Policy.named("uniform", 1.0, "absolute"), SHAPE, SEED).first()["perturbed"] == 0


def test_quantise_bounds(spark):
    out = error_report(multiples(spark, 500), quantising.quantise(multiples(spark, 500))).first()
    assert out["max_relative"] <= 1 / 256 and out["values"] == 1500


def test_ragged_and_null_values(spark):
    rows = [(0, "a", 0, 0, [1.0, 2.0]), (0, "a", 1, 1, [3.14159]), (0, "a", 2, 2, []), (0, "a", 3, 3, None)]
    df = spark.createDataFrame(rows, "file_ord int, file_name string, rec_idx bigint, pos bigint, values array<float>")
    out = [r["values"] for r in quantising.quantise(df).orderBy("pos").collect()]
    assert out == [[1.0, 2.0], [3.140625], [], None]


@pytest.mark.parametrize("call", [
    (lambda: Policy.named("cauchy", 1.0, "absolute"), errors.UnknownDistribution),
    (lambda: Policy.named("uniform", 1.0, "sideways"), errors.UnknownMode),
    (lambda: Policy.named("uniform", 1.0, "absolute", "some"), errors.UnknownTargets),
    (lambda: Policy.named("uniform", 0.0, "absolute"), errors.InvalidScale),
    (lambda: Policy.named("uniform", float("inf"), "absolute"), errors.InvalidScale),
    (lambda: Policy.named("uniform", 1.0, "absolute", low=2.0, high=1.0), errors.InvalidBounds),
    (lambda: Policy.named("uniform", 1.0, "absolute", low=1e300), errors.InvalidBounds),
    (lambda: quantising.Scheme.named("int8"), errors.UnknownScheme),
    (lambda: RecordShape(0, 1), errors.InvalidRecordShape),
])
def test_refusals(call):
    with pytest.raises(call[1]):
        call[0]()


def test_equal_bounds_are_allowed():
    assert Policy.named("uniform", 1.0, "absolute", low=1.0, high=1.0).low == 1.0


def test_noise_moments():
    draws_ = fuzzing.noise(Policy.named("gaussian", 1.0, "absolute"), SEED, np.arange(2000), 50)
    assert abs(draws_.mean()) < 0.02 and abs(draws_.std() - 1) < 0.02
    flat = fuzzing.noise(Policy.named("uniform", 1.0, "absolute"), SEED, np.arange(2000), 50)
    assert -1 <= flat.min() and flat.max() < 1 and abs(flat.mean()) < 0.02


def test_value_draws_reach_past_32_bits():
    low, high = (draws.value_uniforms(draws.value_keys(1, "t"), np.array([p]), 4)[0] for p in (5, 5 + (1 << 40)))
    assert not np.array_equal(low, high)


def test_relative_noise_leaves_zero(spark):
    zero = multiples(spark, 1)
    policy = Policy.named("gaussian", 0.5, "relative", "all")
    assert fuzzing.fuzz(zero, policy, SHAPE, SEED).first()["values"] == [0.0, 0.0, 0.0]
    assert fuzzing.counts(zero, policy, SHAPE, SEED).first()["perturbed"] == 3


def test_non_finite_sources_stay(spark):
    rows = [(0, "a", 0, 0, [float("nan"), 1.0, 2.0]), (0, "a", 1, 1, [float("inf"), float("-inf"), 3.0]), (0, "a", 2, 2, [4.0, 5.0, 6.0])]
    df = spark.createDataFrame(rows, "file_ord int, file_name string, rec_idx bigint, pos bigint, values array<float>")
    policy = Policy.named("gaussian", 0.05, "absolute", low=-1.0, high=1.0)
    out = [r["values"] for r in fuzzing.fuzz(df, policy, SHAPE, SEED).orderBy("pos").collect()]
    assert np.isnan(out[0][0]) and out[1][:2] == [float("inf"), float("-inf")]
    assert [v[2] for v in out] == [2.0, 3.0, 6.0]  # outputs are no targets
    assert fuzzing.counts(df, policy, SHAPE, SEED).first().asDict() == {"perturbed": 3, "clamped": 2 + (out[0][1] == 1.0), "preserved": 3}


def test_overflow_fails_and_is_named(spark):
    df, policy = multiples(spark, 4), Policy.named("gaussian", 1e300, "absolute", high=1.0)
    with pytest.raises(Exception, match="record 0, value 0"):
        fuzzing.fuzz(df.coalesce(1), policy, SHAPE, SEED).collect()
    first = fuzzing.first_failure(df, policy, SHAPE, SEED)
    assert (first.record, first.value) == (0, 0)


def test_read_record(spark):
    assert recs.read_record(multiples(spark, 5), 3, 5).first()["values"] == [3.0, 6.0, 9.0]
    with pytest.raises(errors.RecordIndexOutOfRange):
        recs.read_record(multiples(spark, 5), 5, 5)


def test_shapes():
    shape = RecordShape(2511, 1)
    assert shape.bytes_per_record == 10_048 and shape.encoded(Encoding.BFLOAT16).bytes_per_record == 5_024


def test_rounding_report_is_the_error_report(spark):
    records = multiples(spark, 500)
    one, two = quantising.rounding_report(records).first().asDict(), error_report(records, quantising.quantise(records)).first().asDict()
    assert one == pytest.approx(two)
    assert quantising.rounding_report(records.where("pos < 0")).first()["values"] == 0
