import errno
import json
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import cli, errors, measure, soak, transforms
from millrace.operators import fuzz as fuzzing
from millrace.operators import records as recs
from millrace.operators.fuzz import Policy
from millrace.operators.quantise import Scheme
from millrace.plans.pipeline import Pipeline, stage_seed
from millrace.shape import Encoding, RecordShape
from millrace.sources import discover, fixedwidth, gather, manifest, provenance, verify
from millrace.sources import publish as publishing
from millrace.sources.fixedwidth import read_corpus
from millrace.sources.publish import publish, staged, write_synthetic
from millrace.streaming.transforms import record_stream, transformed

SHAPE = RecordShape(2, 1)
STEPS = [{"transform": "sample", "rate": 1.0}, {"transform": "fuzz", "distribution": "gaussian", "scale": 0.01, "mode": "relative"}, {"transform": "quantise", "scheme": "bfloat16"}]


def write(directory, **files):
    os.makedirs(directory, exist_ok=True)
    for name, values in files.items():
        np.array(values, "<f4").tofile(os.path.join(directory, f"{name}.bin"))


@pytest.fixture
def source(tmp_path):
    path = str(tmp_path / "source")
    write(path, a=[[i, 2 * i, 3 * i] for i in range(40)], b=[[i, 2 * i, 3 * i] for i in range(40, 100)])
    return path


def published(directory):
    made = manifest.beside(directory)
    raw = b"".join(open(os.path.join(directory, f["file"]), "rb").read() for f in made["output"].get("files") or [made["output"]])
    return made, raw


def test_scan_in_name_order(spark, source):
    rows = read_corpus(spark, source, SHAPE, split_bytes=120, batch_bytes=36).orderBy("pos").collect()
    assert [r["values"][0] for r in rows] == [float(i) for i in range(100)]
    assert rows[40]["file_name"] == "b.bin" and rows[40]["rec_idx"] == 0 and rows[40]["file_ord"] == 1


def test_discovery(tmp_path, source):
    write(source, B=[[1, 2, 3]])
    open(os.path.join(source, ".hidden.bin"), "wb").close()
    os.mkdir(os.path.join(source, "sub.bin"))
    assert [f.name for f in discover.corpus_files(source)] == ["B.bin", "a.bin", "b.bin"]
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(errors.NoSources):
        discover.discover(str(empty))
    with pytest.raises(errors.NoCorpusFiles):
        discover.corpus_files(str(empty))


def test_partial_and_empty_files(spark, tmp_path):
    path = str(tmp_path / "bad")
    os.mkdir(path)
    with open(os.path.join(path, "x.bin"), "wb") as f:
        f.write(bytes(20))
    with pytest.raises(errors.PartialRecord, match="8 more"):
        read_corpus(spark, path, SHAPE)
    open(os.path.join(path, "x.bin"), "wb").close()
    with pytest.raises(errors.EmptySource):
        read_corpus(spark, path, SHAPE)


@pytest.mark.parametrize("where", ["{s}", "{s}/in", "{p}"])
def test_overlap_is_refused(spark, source, where):
    out = where.format(s=source, p=os.path.dirname(source))
    with pytest.raises(errors.OverlappingCorpora):
        transforms.run_stage(spark, source, out, SHAPE, {"transform": "quantise", "scheme": "bfloat16"})


def test_sample_end_to_end(spark, source, tmp_path):
    out = str(tmp_path / "out")
    spec = {"transform": "sample", "rate": 0.5, "seed": 7}
    made = transforms.run_stage(spark, source, out, SHAPE, spec, {"owner": "me"})
    kept, raw = published(out)
    assert made == kept and kept["output"]["file"] == "sample-50-00000.bin" and kept["metadata"] == {"owner": "me"}
    got = np.frombuffer(raw, "<f4").reshape(-1, 3)
    assert 20 < len(got) < 80 and set(got[:, 0]) <= set(range(100)) and (got[:, 1] == 2 * got[:, 0]).all()
    assert verify.verify(spark, out, SHAPE)["output"]["record_count"] == len(got)
    assert verify.not_contained(read_corpus(spark, out, SHAPE), read_corpus(spark, source, SHAPE)).count() == 0
    transforms.run_stage(spark, source, out, SHAPE, spec)
    assert published(out)[1] == raw  # the same seed gives the same bytes, in place of what was there
    assert sorted(os.listdir(tmp_path)) == ["out", "source"]


def test_sample_of_nothing_is_published(spark, source, tmp_path):
    out = str(tmp_path / "out")
    made = transforms.run_stage(spark, source, out, SHAPE, {"transform": "sample", "rate": 1e-9, "seed": 1})
    assert made["output"]["record_count"] == 0 and os.path.getsize(os.path.join(out, "sample-0-00000.bin")) == 0
    assert verify.verify(spark, out, SHAPE)["output"]["bytes"] == 0


def test_pieces_instead_of_one_file(spark, source, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spec = {"transform": "sample", "rate": 1.0, "seed": 3}
    transforms.run_stage(spark, source, one, SHAPE, spec, single_file=True)
    made = transforms.run_stage(spark, source, many, SHAPE, spec)
    assert len(made["output"]["files"]) >= 1 and published(one)[1] == published(many)[1]
    assert verify.verify(spark, many, SHAPE)


def test_quantise_halves_and_declares(spark, source, tmp_path):
    out = str(tmp_path / "q")
    made = transforms.run_stage(spark, source, out, SHAPE, {"transform": "quantise", "scheme": "bfloat16"})
    assert made["output"]["bytes"] == 600 and made["source_record_shape"]["encoding"] == "float32" and "seed" not in made["transform"]
    back = read_corpus(spark, out, SHAPE.encoded(Encoding.BFLOAT16)).orderBy("pos").collect()
    assert [r["values"][0] for r in back][:40] == [float(i) for i in range(40)]
    with pytest.raises(errors.SourceEncodingMismatch):
        transforms.run_stage(spark, out, str(tmp_path / "again"), SHAPE, {"transform": "sample", "rate": 1.0})
    with pytest.raises(errors.SourceWidthMismatch):
        verify.check_declaration(out, RecordShape(3, 1, Encoding.BFLOAT16))


def test_pipeline_equals_its_stages(spark, source, tmp_path):
    config = Pipeline.from_json(json.dumps({"version": 1, "seed": 41, "stages": STEPS}))
    whole = str(tmp_path / "whole")
    made = transforms.run_pipeline(spark, source, whole, SHAPE, config)
    at, shape = source, SHAPE
    for k, spec in enumerate(STEPS, 1):
        out = str(tmp_path / f"stage{k}")
        transforms.run_stage(spark, at, out, shape, spec if spec["transform"] == "quantise" else spec | {"seed": stage_seed(41, k)})
        at = out
    assert published(whole)[1] == published(at)[1]
    assert [s["name"] for s in made["pipeline"]] == ["sample", "fuzz", "quantise"] and made["transform"]["parameters"]["stage_count"] == 3


SAMPLE, FUZZ, QUANTISE = ({"transform": "sample", "rate": 0.6}, {"transform": "fuzz", "distribution": "gaussian", "scale": 0.05, "mode": "relative", "targets": "all", "clamp_max": 250.0}, {"transform": "quantise", "scheme": "bfloat16"})
MIXES = [
    (QUANTISE, FUZZ, FUZZ), (FUZZ, QUANTISE, FUZZ), (SAMPLE, FUZZ, QUANTISE), (FUZZ, SAMPLE, QUANTISE, FUZZ), (SAMPLE, SAMPLE, FUZZ), (FUZZ, SAMPLE, FUZZ, SAMPLE),
    (QUANTISE, SAMPLE, FUZZ), (SAMPLE, QUANTISE, SAMPLE),
]


@pytest.mark.parametrize("steps", MIXES, ids=lambda m: "-".join(s["transform"] for s in m))
def test_disk_frame_and_stages_agree(spark, source, tmp_path, steps):
    whole, seed = str(tmp_path / "whole"), 77
    made = transforms.run_pipeline(spark, source, whole, SHAPE, Pipeline(steps, seed))
    at, shape, counts = source, SHAPE, []
    for k, spec in enumerate(steps, 1):
        out = str(tmp_path / f"stage{k}")
        told = transforms.run_stage(spark, at, out, shape, spec if spec["transform"] == "quantise" else spec | {"seed": stage_seed(seed, k)}, single_file=True)
        counts += [c | {"stage": k} for c in told.counts]
        at, shape = out, RecordShape(2, 1, Encoding(told["record_shape"]["encoding"]))
    assert published(whole)[1] == published(at)[1] and made["record_shape"] == shape.as_dict()
    frame, own = Pipeline(steps, seed).apply(read_corpus(spark, source, SHAPE), SHAPE, seed)
    rows = [r["values"] for r in frame.orderBy("pos").collect()]
    assert own == shape and rows == [r["values"] for r in read_corpus(spark, whole, shape).orderBy("pos").collect()] and len(rows) > 10
    assert made.counts == counts and all(c["perturbed"] > 0 for c in counts)


def test_a_sample_is_the_same_over_any_tasks(spark, source, tmp_path, monkeypatch):
    spec, found = {"transform": "sample", "rate": 0.7, "seed": 4}, []
    for k, split in enumerate((64 << 20, 120, 12)):
        monkeypatch.setattr(gather, "SPLIT", split)
        made = transforms.run_stage(spark, source, str(tmp_path / f"o{k}"), SHAPE, spec)
        found.append(published(str(tmp_path / f"o{k}"))[1])
    assert len(made["output"]["files"]) > 20 and found[0] == found[1] == found[2]


@pytest.mark.parametrize(("steps", "position"), [((QUANTISE, QUANTISE), 2), ((QUANTISE, SAMPLE, FUZZ, QUANTISE), 4)])
def test_a_stage_that_cannot_read_its_input_is_refused(spark, source, tmp_path, steps, position):
    with pytest.raises(errors.StageFailed) as e:
        transforms.run_pipeline(spark, source, str(tmp_path / "out"), SHAPE, Pipeline(steps, 1))
    assert e.value.position == position and isinstance(e.value.cause, errors.SourceEncodingMismatch) and os.listdir(tmp_path) == ["source"]
    with pytest.raises(errors.SourceEncodingMismatch):
        transforms.run_stage(spark, source, str(tmp_path / "out"), SHAPE.encoded(Encoding.BFLOAT16), QUANTISE)


HUGE = {"transform": "fuzz", "distribution": "uniform", "scale": 3e38, "mode": "absolute"}


SMALL = {k: v for k, v in FUZZ.items() if k != "clamp_max"} | {"mode": "absolute"}


@pytest.mark.parametrize("steps", [(SMALL, HUGE), (HUGE, SAMPLE | {"rate": 0.01}), (QUANTISE, HUGE, SMALL)], ids=lambda m: "-".join(s["transform"] for s in m))
def test_the_first_failure_is_named_whatever_task_meets_it(spark, tmp_path, monkeypatch, steps):
    monkeypatch.setattr(gather, "SPLIT", 24)
    source = str(tmp_path / "source")
    write(source, a=[[1.0, 3e38, 2.0]] * 40, b=[[2e38, 1.0, 2.0]] * 20)
    position = next(k for k, s in enumerate(steps, 1) if s is HUGE)
    before, shape = Pipeline(steps[: position - 1], 5), SHAPE
    records = read_corpus(spark, source, SHAPE)
    if position > 1:
        records, shape = before.apply(records, SHAPE, 5)
    policy = Policy.named("uniform", 3e38, "absolute")
    want = fuzzing.first_failure(records, policy, shape, stage_seed(5, position))
    with pytest.raises(errors.StageFailed) as e:
        transforms.run_pipeline(spark, source, str(tmp_path / "out"), SHAPE, Pipeline(steps, 5))
    assert want and e.value.position == position and isinstance(e.value.cause, errors.NonFiniteResult) and e.value.cause.facts == want.facts
    assert os.listdir(tmp_path) == ["source"]


def test_a_stage_alone_raises_its_own_failure(spark, tmp_path):
    write(str(tmp_path / "source"), a=[[1.0, 2.0, 0.5]])
    spec = {"transform": "fuzz", "distribution": "uniform", "scale": 1e300, "mode": "absolute", "clamp_max": 1.0, "seed": 1}
    with pytest.raises(errors.NonFiniteResult) as e:
        transforms.run_stage(spark, str(tmp_path / "source"), str(tmp_path / "out"), SHAPE, spec)
    assert (e.value.record, e.value.value, e.value.original) == (0, 0, 1.0) and "record 0" in str(e.value)


def test_noise_that_rounding_makes_infinite_fails(spark, tmp_path):
    """The largest float32 rounds to infinity as bfloat16, though noise left it finite."""
    shape = SHAPE.encoded(Encoding.BFLOAT16)
    values = np.array([[1.0, 3.3895314e38, 2.0]], np.float32)
    out = fuzzing.noised(Policy.named("uniform", 1e-3, "relative"), shape, next(s for s in range(99) if fuzzing.noise(Policy.named("uniform", 1e-3, "relative"), s, np.array([0]), 3)[0, 1] > 0.9), np.float32(values), np.array([0]))
    assert out.failure is None or out.failure.value == 1
    top = np.array([[1.0, np.float32(3.4e38), 2.0]], np.float32)
    assert fuzzing.noised(Policy.named("uniform", 1e-9, "relative"), shape, 1, top, np.array([0])).failure.value == 1


def test_the_sink_publishes_and_an_aborted_write_leaves_nothing(spark, source, tmp_path):
    records = read_corpus(spark, source, SHAPE)
    out = str(tmp_path / "sunk")
    fixedwidth.write_corpus(records.repartition(7), out, SHAPE, name="sunk.bin", metadata={"k": "v"})
    made, raw = published(out)
    want = b"".join(open(os.path.join(source, f), "rb").read() for f in ("a.bin", "b.bin"))
    assert raw == want and made["metadata"] == {"k": "v"} and made["output"]["record_count"] == 100 and verify.verify(spark, out, SHAPE)
    broken = records.withColumn("values", F.when(F.col("pos") == 60, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("values")))
    with pytest.raises(Exception, match="a record of 1 values"):
        fixedwidth.write_corpus(broken, out, SHAPE)
    failing = records.withColumn("pos", F.when(F.col("pos") == 99, F.raise_error(F.lit("killed")).cast("bigint")).otherwise(F.col("pos")))
    with pytest.raises(Exception, match="killed"):
        fixedwidth.write_corpus(failing, out, SHAPE)
    unsorted = records.orderBy(F.desc("pos")).coalesce(1).select("pos", "values")
    assert published(out)[1] == want and sorted(os.listdir(tmp_path)) == ["source", "sunk"]
    with pytest.raises(Exception, match="record order"):
        unsorted.write.format("fixedwidth").mode("overwrite").options(path=out, inputs="2", outputs="1").save()
    assert published(out)[1] == want and sorted(os.listdir(tmp_path)) == ["source", "sunk"]


def test_a_record_is_read_by_a_seek(spark, source):
    row = fixedwidth.read_record(spark, source, SHAPE, 41).collect()
    assert [(r["pos"], r["file_name"], r["rec_idx"], r["values"]) for r in row] == [(41, "b.bin", 1, [41.0, 82.0, 123.0])]
    for index in (-1, 100):
        with pytest.raises(errors.RecordIndexOutOfRange):
            fixedwidth.read_record(spark, source, SHAPE, index)


@pytest.fixture
def pushing(spark):
    spark.conf.set(fixedwidth.PUSHDOWN, "true")
    yield spark
    spark.conf.unset(fixedwidth.PUSHDOWN)


def test_conditions_on_positions_reach_the_reader(pushing, source):
    records = read_corpus(pushing, source, SHAPE, split_bytes=120)
    assert records.rdd.getNumPartitions() == 10
    one = records.where("pos = 57")
    assert one.rdd.getNumPartitions() == 1 and [r["pos"] for r in one.collect()] == [57]
    for condition, want in (("pos >= 38 AND pos < 43", range(38, 43)), ("pos IN (3, 95)", [3, 95]), ("pos > 97", [98, 99]), ("pos <= 1 AND rec_idx = 1", [1]), ("pos = 100", []), ("pos = 5 AND pos = 6", [])):
        assert sorted(r["pos"] for r in records.where(condition).collect()) == list(want)


def test_seeds_are_the_generators():
    # fixed values: the generator's first three outputs from this seed
    assert [stage_seed(20260831, k) for k in (1, 2, 3)] == [283084283387929719, 7589195149613138759, 12069378877930774043]


@pytest.mark.parametrize(("spec", "error"), [
    ({"version": 1, "stages": []}, errors.EmptyPipeline),
    ({"version": 2, "stages": STEPS}, errors.UnsupportedConfigVersion),
    ({"version": 1, "stages": STEPS, "more": 1}, errors.InvalidConfig),
    ({"version": 1, "stages": [{"transform": "quantise", "scheme": "bfloat16", "seed": 1}]}, errors.InvalidConfig),
    ({"version": 1, "stages": [{"transform": "sample"}]}, errors.InvalidConfig),
    ({"version": 1, "stages": [{"transform": "sample", "rate": 2.0}]}, errors.StageFailed),
])
def test_configurations_are_refused(spec, error):
    with pytest.raises(error):
        Pipeline.from_json(json.dumps(spec))


def test_configuration_round_trip():
    config = Pipeline(tuple(STEPS), 5)
    assert Pipeline.from_json(config.to_json()) == config


def test_failed_run_leaves_nothing(spark, source, tmp_path):
    spec = {"transform": "fuzz", "distribution": "gaussian", "scale": 1e300, "mode": "absolute", "seed": 1}
    with pytest.raises(Exception, match="record"):
        transforms.run_stage(spark, source, str(tmp_path / "out"), SHAPE, spec)
    assert os.listdir(tmp_path) == ["source"]


def test_publish_rolls_back(tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "old").write_text("x")
    with pytest.raises(RuntimeError), staged(str(out)):
        raise RuntimeError
    assert os.listdir(tmp_path) == ["out"] and os.listdir(out) == ["old"]


def test_wrong_width_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="a record of 3 values"):
        publish(recs.synthetic(spark, 1, 4, SHAPE), RecordShape(3, 1), str(tmp_path / "out"), "x.bin", {}, {"record_count": 4}, {})


@pytest.mark.parametrize(("change", "check"), [
    (lambda d, m: m["output"].update(bytes=1), "published bytes"),
    (lambda d, m: m["output"].update(record_count=1), "record count"),
    (lambda d, m: m["output"]["files"][0]["checksum"].update(value="0"), "published checksum"),
    (lambda d, m: m["record_shape"].update(inputs=9), "record geometry"),
    (lambda d, m: m["source"].update(record_count=0), "sample size"),
])
def test_verification_names_the_invariant(spark, source, tmp_path, change, check):
    out = str(tmp_path / "out")
    made = transforms.run_stage(spark, source, out, SHAPE, {"transform": "sample", "rate": 1.0, "seed": 1})
    change(out, made)
    manifest.write(made, out)
    with pytest.raises(errors.InvariantBroken, match=check):
        verify.verify(spark, out, SHAPE)


def test_source_digests(spark, source):
    names = ["a.bin", "b.bin"]
    before = verify.digests(spark, source, names).toPandas()
    before = spark.createDataFrame(before)
    assert verify.changed_files(before, verify.digests(spark, source, names)).count() == 0
    write(source, b=[[1, 2, 3]])
    assert [r["name"] for r in verify.changed_files(before, verify.digests(spark, source, names)).collect()] == ["b.bin"]


@pytest.mark.parametrize("entry", ["novalue", "=x", "a b=c", "k" * 65 + "=v", "k=" + "v" * 1025, "k=a\nb"])
def test_metadata_is_refused(entry):
    with pytest.raises(errors.InvalidMetadata):
        manifest.parse_metadata([entry])


def test_metadata():
    assert manifest.parse_metadata(["b=x=y", "a="]) == {"a": "", "b": "x=y"}
    with pytest.raises(errors.InvalidMetadata, match="twice"):
        manifest.parse_metadata(["a=1", "a=2"])


def test_unknown_manifest_version(tmp_path):
    (tmp_path / "manifest.json").write_text('{"manifest_version": 2}')
    with pytest.raises(errors.InvalidManifest):
        manifest.beside(str(tmp_path))


def test_timestamp():
    assert manifest.timestamp(951782400) == "2000-02-29T00:00:00Z"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamp_of_any_year_in_any_zone(spark, duck, zone):
    """Years beyond 9999 have no sign, and hours that a zone skips or has twice are told apart."""
    seconds = [0, -1, 951782400, 253402300799, 253402300800, 518_394_000_000, 8_000_000_000_000, -60_000_000_000, -62_200_000_000, 1678588200, 1699162200, 1699165800]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        table = spark.createDataFrame([(s,) for s in [*seconds, None]], "s bigint")
        got = dict(table.select("s", manifest.timestamp_of(F.col("s"))).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    values = ", ".join(f"({s})" for s in seconds)
    want = duck.sql(f"SELECT s, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') FROM (VALUES {values}) t(s)").fetchall()
    assert got == dict(want) | {None: None}
    assert got[518_394_000_000] == "18397-04-02T13:20:00Z"


def test_synthetic_files(spark, tmp_path):
    out = str(tmp_path / "made")
    write_synthetic(spark, out, 3, 5, SHAPE)
    rows = read_corpus(spark, out, SHAPE).orderBy("pos").collect()
    assert [r["values"] for r in rows] == [[float(g), g + 1.0, g + 2.0] for g in range(15)]
    with pytest.raises(errors.EmptySource):
        write_synthetic(spark, out, 0, 5, SHAPE)


def test_command_line(spark, source, tmp_path, capsys):
    common = ["--source", source, "--inputs", "2", "--outputs", "1", "--metadata", "k=v"]
    assert cli.main([*common, "--output", str(tmp_path / "s"), "sample", "--rate", "0.5", "--seed", "3"], spark) == 0
    assert "seed: 3" in capsys.readouterr().out
    assert cli.main([*common, "--output", str(tmp_path / "q"), "quantise", "--scheme", "bfloat16"], spark) == 0
    assert cli.main([*common, "--output", str(tmp_path / "f"), "fuzz", "--distribution", "uniform", "--scale", "0.1", "--mode", "absolute", "--clamp-min", "0"], spark) == 0
    config = tmp_path / "p.json"
    config.write_text(Pipeline(tuple(STEPS), 1).to_json())
    assert cli.main([*common, "--output", str(tmp_path / "p"), "pipeline", "--config", str(config)], spark) == 0
    assert cli.main([*common, "--output", str(tmp_path / "n"), "--single-file", "quantise", "--scheme", "bfloat16"], spark) == 0
    assert (tmp_path / "n" / "quantise-bfloat16.bin").exists() and (tmp_path / "q" / "quantise-bfloat16-00000.bin").exists()
    assert cli.main([*common, "--output", str(tmp_path / "x"), "sample", "--rate", "7"], spark) == 1
    assert cli.main([*common, "--output", str(tmp_path / "x"), "quantise", "--scheme", "int8"], spark) == 1
    with pytest.raises(SystemExit) as e:
        cli.main([*common, "sample"])
    assert e.value.code == 2


def test_storage_full_is_28(capsys):
    full = errors.StorageFull(required_bytes=99)
    full.__cause__ = OSError(errno.ENOSPC, "No space left on device")
    assert cli._report(full) == 28 and "required_bytes=99" in capsys.readouterr().err
    assert cli.exit_code(RuntimeError("task failed: [Errno 28] No space left on device")) == 28
    assert cli.exit_code(OSError(errno.EACCES, "no")) == 1


def test_stream_equals_batch(spark, source, tmp_path):
    records = read_corpus(spark, source, SHAPE)
    records.write.parquet(str(tmp_path / "in"))
    policy = Policy.named("gaussian", 0.1, "absolute")
    stream = transformed(record_stream(spark, str(tmp_path / "in")), SHAPE, policy, 5, Scheme.BFLOAT16)
    query = stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = transformed(records, SHAPE, policy, 5, Scheme.BFLOAT16)
    assert spark.table("streamed").orderBy("pos").select("pos", "values").collect() == batch.orderBy("pos").select("pos", "values").collect()


def case(label, ms, rss, out):
    return (label, ms, rss, 1000, out, 100, 50)


def test_baseline(spark):
    base = spark.createDataFrame([case("a", 100, 10, 10), case("b", 100, 10, 10), case("c", 100, 10, 10), case("gone", 1, 1, 1)], measure.CASES)
    now = spark.createDataFrame([case("a", 110, 11, 10), case("b", 200, 10, 10), case("c", 100, 13, 10), case("d", 1, 1, 1)], measure.CASES)
    assert {r["label"]: r["verdict"] for r in measure.compared(base, now).collect()} == {"a": "ok", "b": "regression", "c": "regression", "d": "new", "gone": "regression"}
    with pytest.raises(errors.Regression, match="b, c, gone"):
        measure.hold(base, now)
    assert "| a | 110 | 909 |" in measure.markdown(now)
    told = {r["label"]: r for r in measure.compared(base, now).collect()}
    assert (told["b"]["speed"], told["c"]["memory"], told["a"]["size"], told["gone"]["speed"], told["d"]["size"]) == (0.5, 1.3, 1.0, None, None)
    with pytest.raises(errors.Incomparable, match="records of"):
        measure.hold(now, now, shapes=(SHAPE, RecordShape(3, 1)))


def test_a_child_is_measured_with_its_children(tmp_path):
    big = "import time; x = bytearray(120 << 20); time.sleep(0.5)"
    run = measure.child("c", [sys.executable, "-c", f"import subprocess, sys; print('said'); subprocess.run([sys.executable, '-c', {big!r}])"])
    assert run["code"] == 0 and run["output"] == "said\n" and run["peak_rss_kib"] > 120 << 10 and run["elapsed_ms"] >= 500
    assert measure.child("c", [sys.executable, "-c", "raise SystemExit(3)"])["code"] == 3


def test_measured_children_must_end_well_and_agree(tmp_path):
    made = iter([{"source": {"record_count": 4}, "output": {"record_count": 2, "bytes": n}} for n in (8, 8, 8, 9)])
    command = [sys.executable, "-c", "pass"]
    case_ = measure.measured_child("c", command, 2, lambda: next(made), 16)
    assert (case_["records_read"], case_["records_written"], case_["output_bytes"], case_["input_bytes"]) == (4, 2, 8, 16) and case_["peak_rss_kib"] > 0
    with pytest.raises(errors.Incomparable):
        measure.measured_child("c", command, 2, lambda: next(made), 16)
    with pytest.raises(errors.CommandFailed):
        measure.measured_child("c", [sys.executable, "-c", "raise SystemExit(1)"], 1, lambda: {}, 0)


def test_soak(spark, tmp_path):
    report = soak.soak(spark, str(tmp_path), SHAPE, 2, 40, 3, 0.5)
    assert len(report["rounds"]) == 3 and len({r["seed"] for r in report["rounds"]}) == 3 and all(5 < r["records_kept"] < 75 for r in report["rounds"])
    assert [(f["fault"], f["error"]) for f in report["faults"]] == [("a file cut short", "PartialRecord"), ("noise out of range", "NonFiniteResult")]
    assert report["source_unchanged"] and report["scratch_left_behind"] == 0 and json.loads(soak.as_json(report)) == report
    assert "| noise out of range | NonFiniteResult | intact |" in soak.markdown(report) and sorted(os.listdir(tmp_path)) == ["sample", "source"]


def test_a_soak_tells_of_a_fault_that_passes_and_of_a_changed_source(spark, tmp_path):
    with pytest.raises(errors.InvariantBroken, match="fail loud"):
        soak.soak(spark, str(tmp_path / "a"), SHAPE, 1, 20, 1, 0.5, {"none": lambda source, shape, spec: (spec, lambda: None)})

    def spoils(source, shape, spec):
        write(source, extra=[[1, 2, 3]])
        return soak.cut_short(source, shape, spec)

    with pytest.raises(errors.InvariantBroken, match="source immutability"):
        soak.soak(spark, str(tmp_path / "b"), SHAPE, 1, 20, 1, 0.5, {"spoils": spoils})


def test_lineage_follows_the_manifests(spark, source, tmp_path):
    at, shape = source, SHAPE
    for k, spec in enumerate((SAMPLE | {"seed": 2**64 - 1}, SMALL | {"seed": 1}, QUANTISE)):
        out = str(tmp_path / f"step {k}+é")
        transforms.run_stage(spark, at, out, shape, spec, {"owner": "me"})
        at = out
    found = provenance.lineage(spark, str(tmp_path), at).orderBy("step").collect()
    assert [(r["step"], r["transform"], r["path"]) for r in found] == [(2 - k, n, str(tmp_path / f"step {k}+é")) for k, n in ((2, "quantise"), (1, "fuzz"), (0, "sample"))]
    assert found[2]["seed"] == 2**64 - 1 and found[2]["source_path"] == os.path.realpath(source) and [r["encoding"] for r in found] == ["bfloat16", "float32", "float32"]
    table = provenance.corpora(spark, str(tmp_path))
    scale = table.where("transform = 'fuzz'").select(F.expr("variant_get(parameters, '$.scale', 'double')")).first()[0]
    assert table.count() == 3 and scale == SMALL["scale"] and {r["metadata"]["owner"] for r in table.collect()} == {"me"}


def test_what_a_full_disk_needs_is_never_less_than_was_written(spark, source, tmp_path, monkeypatch):
    def full(self, values):
        self.bytes += 10**6
        raise OSError(errno.ENOSPC, os.strerror(errno.ENOSPC))

    monkeypatch.setattr(publishing.Piece, "write", full)
    layout = gather.Layout.of(discover.corpus_files(source), [40, 60], SHAPE)
    told = gather.told(layout, [], SHAPE, 0, iter([[np.arange(10)]]), str(tmp_path))
    assert told["is_full"] and told["bytes"] == 10**6 and sorted(os.listdir(tmp_path)) == ["source"]
    monkeypatch.setattr(gather.Gather, "run", lambda self, directory: (_ for _ in ()).throw(errors.StorageFull(required_bytes=10**6)))
    for spec, needed in ((SAMPLE, 10**6), (QUANTISE, 10**6)):
        with pytest.raises(errors.StorageFull) as e:
            transforms.run_stage(spark, source, str(tmp_path / "out"), SHAPE, spec)
        assert e.value.required_bytes == needed and cli.exit_code(e.value) == 28 and os.listdir(tmp_path) == ["source"]


def test_measured_runs_must_agree():
    results = iter([{"source": {"record_count": 1}, "output": {"record_count": 1, "bytes": n}} for n in (4, 8)])
    with pytest.raises(errors.Incomparable):
        measure.measured("x", lambda: next(results), 2, 10)


def test_storage_full_in_a_task_tells_what_is_needed(spark, source, tmp_path, monkeypatch):
    def full(*_):
        def write(it):
            raise OSError(errno.ENOSPC, os.strerror(errno.ENOSPC))
            yield from it

        spark.range(1).mapInArrow(write, "id bigint").collect()

    monkeypatch.setattr(transforms, "publish", full)
    with pytest.raises(errors.StorageFull) as e:
        transforms.run_stage(spark, source, str(tmp_path / "out"), SHAPE, {"transform": "sample", "rate": 0.5, "seed": 1})
    assert e.value.required_bytes == 50 * 12 + 6 and cli.exit_code(e.value) == 28


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_manifest_lists_files_as_processed(spark, source, tmp_path, seed):
    made = transforms.run_stage(spark, source, str(tmp_path / "out"), SHAPE, {"transform": "sample", "rate": 1.0, "seed": seed})
    first = np.frombuffer(published(str(tmp_path / "out"))[1], "<f4")[0]
    assert made["source"]["files"][0]["name"] == ("a.bin" if first < 40 else "b.bin")


def test_unlike_corpora_are_not_compared(spark):
    base = spark.createDataFrame([case("a", 100, 10, 10)], measure.CASES)
    other = spark.createDataFrame([("a", 100, 10, 2000, 10, 200, 50)], measure.CASES)
    with pytest.raises(errors.Incomparable, match="a"):
        measure.hold(base, other)
    for tolerance in (-0.1, 1.0, float("nan")):
        with pytest.raises(errors.Incomparable, match="tolerance"):
            measure.compared(base, base, tolerance)


def test_speed_up(spark):
    cases = spark.createDataFrame([case("ours", 100, 5, 10), case("theirs", 300, 10, 10)], measure.CASES)
    assert measure.speed_up(cases, "ours", "theirs") == {"times": pytest.approx(3.0), "memory_share": 0.5}
    with pytest.raises(errors.Regression):
        measure.hold_speed_up(cases, "ours", "theirs", 4.0)
    with pytest.raises(errors.Incomparable, match="none"):
        measure.speed_up(cases, "ours", "none")
    assert json.loads(measure.as_json(cases))[0]["records_per_second"] == 1000.0
