"""Named queries that go through files: a corpus is published, transformed on disk, verified and read back.

Its source is `embeddings` in one file in order of vec_id, so a record's position is its vec_id.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import transforms
from ..operators import quantise as quantising
from ..shape import Encoding
from ..sources.discover import corpus_files, record_counts
from ..sources.fixedwidth import read_corpus, read_record, write_corpus
from ..sources.provenance import lineage
from ..sources.publish import publish
from ..sources.verify import changed_files, digests, not_contained, verify
from .catalogue import RATE, SEED, SHAPE, STEPS, corpus, each
from .pipeline import Pipeline

FUZZ = STEPS[1] | {"seed": SEED}
#: Noise that bounds hold often, and noise on every value.
HELD = {"transform": "fuzz", "distribution": "uniform", "scale": 40.0, "mode": "absolute", "clamp_min": -3.0, "clamp_max": 2.5}
WIDE = {"transform": "fuzz", "distribution": "uniform", "scale": 0.25, "mode": "absolute", "targets": "all"}
BF16 = SHAPE.encoded(Encoding.BFLOAT16)


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which has to be a mount; a local one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = os.path.join("/" + root.removeprefix("file:").lstrip("/"), "millrace", uuid.uuid4().hex)
    os.makedirs(path)
    return path


def source(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The folder of a query and its published source."""
    at, rows = folder(spark), corpus(spark, sf_dir)
    made = os.path.join(at, "source")
    publish(rows, SHAPE, made, "embeddings.bin", {"name": "export", "parameters": {}}, {"record_count": rows.count()}, {}, single_file=True)
    return at, made


def stage(spark: SparkSession, sf_dir: str, spec: dict, single_file: bool = False) -> tuple[str, str, dict]:
    """Source, output and manifest of a transform on disk."""
    at, made = source(spark, sf_dir)
    out = os.path.join(at, "out")
    return made, out, transforms.run_stage(spark, made, out, SHAPE, spec, single_file=single_file)


def disk_geometry(spark: SparkSession, d: str) -> DataFrame:
    files = corpus_files(source(spark, d)[1])
    rows = [(f.name, n, f.bytes) for f, n in zip(files, record_counts(files, SHAPE), strict=True)]
    return spark.createDataFrame(rows, "file_name string, record_count bigint, bytes bigint")


def disk_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return each(read_corpus(spark, source(spark, d)[1], SHAPE))


def disk_quantise_pieces(spark: SparkSession, d: str) -> DataFrame:
    _, out, _ = stage(spark, d, STEPS[2])
    shape = SHAPE.encoded(Encoding.BFLOAT16)
    verify(spark, out, shape)
    return each(read_corpus(spark, out, shape))


def disk_sample(spark: SparkSession, d: str) -> DataFrame:
    return each(read_corpus(spark, stage(spark, d, STEPS[0] | {"seed": SEED})[1], SHAPE))


def disk_fuzz(spark: SparkSession, d: str) -> DataFrame:
    return each(read_corpus(spark, stage(spark, d, FUZZ)[1], SHAPE))


def disk_pipeline(spark: SparkSession, d: str) -> DataFrame:
    at, made = source(spark, d)
    transforms.run_pipeline(spark, made, os.path.join(at, "out"), SHAPE, Pipeline(STEPS, SEED))
    return each(read_corpus(spark, os.path.join(at, "out"), SHAPE.encoded(Encoding.BFLOAT16)))


def disk_quantise_fuzz_fuzz(spark: SparkSession, d: str) -> DataFrame:
    """Noise on a quantised corpus, twice: each stage hands on what bfloat16 holds."""
    at, made = source(spark, d)
    transforms.run_pipeline(spark, made, os.path.join(at, "out"), SHAPE, Pipeline((STEPS[2], STEPS[1], WIDE), SEED))
    return each(read_corpus(spark, os.path.join(at, "out"), BF16))


def disk_noise_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a pipeline's noise did, as its run tells: the first stage also to records that the sample drops."""
    at, made = source(spark, d)
    told = transforms.run_pipeline(spark, made, os.path.join(at, "out"), SHAPE, Pipeline((HELD, STEPS[0], WIDE), SEED))
    return spark.createDataFrame([tuple(c.values()) for c in told.counts], "stage bigint, perturbed bigint, clamped bigint, preserved bigint")


def disk_read_record(spark: SparkSession, d: str) -> DataFrame:
    return each(read_record(spark, source(spark, d)[1], SHAPE, 17))


def disk_sink(spark: SparkSession, d: str) -> DataFrame:
    out = os.path.join(folder(spark), "sunk")
    write_corpus(corpus(spark, d), out, SHAPE)
    verify(spark, out, SHAPE)
    return each(read_corpus(spark, out, SHAPE))


def disk_lineage(spark: SparkSession, d: str) -> DataFrame:
    """How a corpus of three steps came about, from the manifests beside the corpora."""
    at, made = source(spark, d)
    shape = SHAPE
    for k, spec in enumerate((STEPS[0] | {"seed": SEED}, FUZZ, STEPS[2]), 1):
        out = os.path.join(at, f"step{k}")
        transforms.run_stage(spark, made, out, shape, spec)
        made = out
    found = lineage(spark, at, made)
    return found.select("step", "transform", F.col("seed").cast("string").alias("seed"), "encoding", "records_read", "records_written", "bytes")


def disk_verified(spark: SparkSession, d: str) -> DataFrame:
    """What a verified sample's manifest tells, whether its source stayed as it was, and records it should not have."""
    at, made = source(spark, d)
    names = [f.name for f in corpus_files(made)]
    before = spark.createDataFrame(digests(spark, made, names).collect(), "name string, bytes bigint, sha256 string")
    out = os.path.join(at, "out")
    transforms.run_stage(spark, made, out, SHAPE, STEPS[0] | {"seed": SEED}, single_file=True)
    told = verify(spark, out, SHAPE)
    row = (told["output"]["file"], told["source"]["record_count"], told["output"]["record_count"], told["output"]["bytes"])
    extra = not_contained(read_corpus(spark, out, SHAPE), read_corpus(spark, made, SHAPE)).agg(F.count(F.lit(1)).alias("not_in_source"))
    changed = changed_files(before, digests(spark, made, names)).agg(F.count(F.lit(1)).alias("files_changed"))
    kept = spark.createDataFrame([row], "file_name string, records_read bigint, records_kept bigint, bytes bigint")
    return kept.select("*", F.lit(changed.first()[0]).cast("bigint").alias("files_changed"), F.lit(extra.first()[0]).cast("bigint").alias("not_in_source"))


def storage_reduction(spark: SparkSession, d: str) -> DataFrame:
    made, _, told = stage(spark, d, STEPS[2])
    size = sum(f.bytes for f in corpus_files(made))
    return spark.createDataFrame([(quantising.storage_reduction(size, told["output"]["bytes"]),)], "reduction double")


def queries() -> dict:
    return {f.__name__: f for f in (disk_geometry, disk_round_trip, disk_quantise_pieces, disk_sample, disk_fuzz, disk_pipeline, disk_verified, disk_quantise_fuzz_fuzz, disk_noise_counts, disk_read_record, disk_sink, disk_lineage, storage_reduction)}


def oracle_sql() -> dict[str, str]:
    from ..operators.fuzz import Policy
    from .oracle import CORPUS, VALUES, all_sql, bf16, fuzzed, noise, sampled, uniform
    from .pipeline import stage_seed

    seeds, policies = [stage_seed(SEED, k) for k in (1, 2, 3)], [Policy.named(s["distribution"], s["scale"], s["mode"], s.get("targets", "inputs")) for s in (STEPS[1], WIDE)]
    sql, one_file = all_sql(), CORPUS.replace("vec_id % 8 AS file_ord, vec_id // 8 AS rec_idx", "0 AS file_ord, vec_id AS rec_idx")
    return {
        "disk_geometry": "SELECT 'embeddings.bin' AS file_name, count(*) AS record_count, count(*) * 260 AS bytes FROM embeddings",
        "disk_round_trip": sql["scan_records"],
        "disk_quantise_pieces": sql["quantise_bf16"],
        "disk_sample": f"WITH {one_file},\n{sampled(SEED)},\nv AS ({VALUES.format('placed')})\nSELECT pos, i, x::DOUBLE AS value FROM v",
        "disk_fuzz": f"WITH {CORPUS},\nv AS ({VALUES.format('corpus')}),\n{noise('v', SEED, 'n')}\nSELECT pos, i, ({fuzzed(policies[0])})::DOUBLE AS value FROM n",
        "disk_pipeline": sql["pipeline_sample_fuzz_quantise"].replace(CORPUS, one_file),
        "disk_quantise_fuzz_fuzz": f"""WITH {CORPUS},
w AS ({VALUES.format('corpus')}), v AS (SELECT pos, i, {bf16('x')} AS x FROM w),
{noise('v', seeds[1], 'n')}, f AS (SELECT pos, i, {fuzzed(policies[0])} AS x FROM n), g AS (SELECT pos, i, {bf16('x')} AS x FROM f),
{noise('g', seeds[2], 'm')}, h AS (SELECT pos, i, {fuzzed(policies[1])} AS x FROM m) SELECT pos, i, ({bf16('x')})::DOUBLE AS value FROM h""",
        "disk_noise_counts": f"""WITH {CORPUS},
v AS ({VALUES.format('corpus')}), {noise('v', seeds[0], 'n')}, m AS (SELECT (x::DOUBLE + 40.0 * (2 * u - 1))::FLOAT AS y FROM n WHERE i < 64)
SELECT 1::BIGINT AS stage, count(*) AS perturbed, count(*) FILTER (y < -3 OR y > 2.5) AS clamped, 0::BIGINT AS preserved FROM m
UNION ALL SELECT 3, count(*) * 65, 0, 0 FROM corpus WHERE {uniform('keep', 'pos', seeds[1])} < {RATE}""",
        "disk_read_record": sql["read_record"],
        "disk_sink": sql["scan_records"],
        "disk_lineage": f"""WITH n AS (SELECT count(*) AS every, count(*) FILTER ({uniform('keep', 'vec_id')} < {RATE}) AS kept FROM embeddings)
SELECT step::BIGINT AS step, transform, seed, encoding, (CASE WHEN step < 2 THEN kept ELSE every END)::BIGINT AS records_read, (CASE WHEN step < 3 THEN kept ELSE every END)::BIGINT AS records_written,
       (CASE WHEN step < 3 THEN kept ELSE every END * CASE step WHEN 0 THEN 130 ELSE 260 END)::BIGINT AS bytes
FROM n, (VALUES (0, 'quantise', NULL, 'bfloat16'), (1, 'fuzz', '{SEED}', 'float32'), (2, 'sample', '{SEED}', 'float32'), (3, 'export', NULL, 'float32')) t(step, transform, seed, encoding)""",
        "disk_verified": f"""SELECT 'sample-{RATE * 100:.0f}.bin' AS file_name, count(*) AS records_read, count(*) FILTER ({uniform('keep', 'vec_id')} < {RATE}) AS records_kept,
  (count(*) FILTER ({uniform('keep', 'vec_id')} < {RATE})) * 260 AS bytes, 0::BIGINT AS files_changed, 0::BIGINT AS not_in_source FROM embeddings""",
        "storage_reduction": sql["storage_reduction"],
    }
