"""DuckDB SQL for the catalogue, written from the definitions of the operators."""

from __future__ import annotations

from ..operators.fuzz import Policy
from .catalogue import POLICIES, RATE, SEED
from .pipeline import stage_seed

CORPUS = """corpus AS (
  SELECT vec_id::BIGINT AS pos, vec_id % 8 AS file_ord, vec_id // 8 AS rec_idx, list_append(embedding, label::FLOAT) AS vals FROM embeddings)"""
VALUES = "SELECT c.pos, (t.k - 1)::BIGINT AS i, c.vals[t.k] AS x FROM {} c, range(1, 66) t(k)"


def uniform(tag: str, by: str, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5('{seed}:{tag}:' || {by}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def noise(source: str, seed: int, out: str) -> str:
    """CTEs from `source` (pos, i, x) to `out` with two uniforms u and v for each value."""
    steps = [f"{out}_k AS (SELECT *, ('0x' || substr(md5('{seed}:noise'), 1, 8))::BIGINT AS k0, ('0x' || substr(md5('{seed}:noise'), 9, 8))::BIGINT AS k1 FROM {source})"]
    last = f"{out}_k"

    def mix(name: str, expr: str) -> None:
        nonlocal last
        for k, step in enumerate((expr, f"(xor({name}, {name} >> 16) * 569420461) & 4294967295", f"(xor({name}, {name} >> 15) * 1935289751) & 4294967295", f"xor({name}, {name} >> 15)")):
            keep = "*" if k == 0 else f"* EXCLUDE ({name})"
            steps.append(f"{out}_{name}{k} AS (SELECT {keep}, {step} AS {name} FROM {last})")
            last = f"{out}_{name}{k}"

    mix("p", "xor(pos & 4294967295, k0)")
    mix("r", "xor(xor(p, (pos >> 32) & 4294967295), k1)")
    mix("j", "xor(i, k0)")
    mix("a", "xor(r, j)")
    mix("b", "(a + 2654435769) & 4294967295")
    steps.append(f"{out} AS (SELECT pos, i, x, a / 4294967296::DOUBLE AS u, b / 4294967296::DOUBLE AS v FROM {last})")
    return ",\n".join(steps)


def fuzzed(policy) -> str:
    """The new value from x, u and v under a policy."""
    draw = "sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v)" if policy.distribution.value == "gaussian" else "(2 * u - 1)"
    moved = f"x::DOUBLE + {policy.scale} * {draw}" if policy.mode.value == "absolute" else f"x::DOUBLE * (1 + {policy.scale} * {draw})"
    out = f"({moved})::FLOAT"
    if policy.low is not None:
        out = f"greatest({out}, {policy.low}::FLOAT)"
    if policy.high is not None:
        out = f"least({out}, {policy.high}::FLOAT)"
    target = {"inputs": "i < 64", "outputs": "i >= 64", "all": "TRUE"}[policy.targets.value]
    return f"CASE WHEN {target} THEN {out} ELSE x END"


def bf16(x: str) -> str:
    magic = f"(1.5::DOUBLE * pow(2::DOUBLE, 45 + greatest(floor(log2(abs({x}::DOUBLE))), -126)))"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE (sign({x}) * ((abs({x}::DOUBLE) + {magic}) - {magic}))::FLOAT END"


def sampled(seed: int) -> str:
    return f"""kept AS (SELECT * FROM corpus WHERE {uniform('keep', 'pos', seed)} < {RATE}),
placed AS (SELECT file_ord, rec_idx, vals, row_number() OVER (ORDER BY md5('{seed}:file:' || file_ord), file_ord, md5('{seed}:order:' || pos), rec_idx) - 1 AS pos FROM kept)"""


def all_sql() -> dict[str, str]:
    errors = f"""q AS (SELECT x, {bf16('x')} AS q FROM v)
SELECT count(*) AS values, count(*) FILTER (x <> 0) AS non_zero, round(max((abs(q - x) / abs(x))::DOUBLE) FILTER (x <> 0), 9) AS max_relative,
       round(avg((abs(q - x) / abs(x))::DOUBLE) FILTER (x <> 0), 9) AS mean_relative, round(max(abs(q - x))::DOUBLE, 9) AS max_absolute FROM q"""
    final = "SELECT pos, i, ({})::DOUBLE AS value FROM {}"
    with_values = f"WITH {CORPUS},\nv AS ({VALUES.format('corpus')})"
    relative, held = Policy.named("gaussian", 0.01, "relative"), POLICIES["fuzz_clamped"]
    word = "18446744073709551616::UHUGEINT"
    out = {
        "scan_records": f"{with_values}\n{final.format('x', 'v')}",
        "corpus_geometry": f"WITH {CORPUS} SELECT count(*) AS record_count, 65::BIGINT AS record_values, 260::BIGINT AS bytes_per_record, count(*) * 260 AS total_bytes FROM corpus",
        "discovery_order": "WITH n AS (SELECT printf('shard-%03d.bin', vec_id % 8) AS file_name, count(*) AS records FROM embeddings GROUP BY 1) SELECT file_name, row_number() OVER (ORDER BY file_name) - 1 AS file_ord, records FROM n",
        "read_record": f"{with_values}\n{final.format('x', 'v')} WHERE pos = 17",
        "split_inputs_outputs": f"WITH {CORPUS} SELECT pos, list_reduce(list_prepend(0::DOUBLE, list_transform(vals[1:64], lambda z: z::DOUBLE)), lambda a, b: a + b) AS input_sum, vals[65]::DOUBLE AS output FROM corpus",
        "synthetic_corpus": "SELECT vec_id::BIGINT AS pos, v.k AS i, (vec_id + v.k)::DOUBLE AS value FROM embeddings, range(0, 4) v(k)",
        "sample_bernoulli": f"SELECT vec_id::BIGINT AS pos FROM embeddings WHERE {uniform('keep', 'vec_id')} < {RATE}",
        "sample_full_rate": "SELECT count(*) AS kept FROM embeddings",
        "sample_block_shuffle": f"WITH {CORPUS},\n{sampled(SEED)} SELECT file_ord::BIGINT AS file_ord, rec_idx::BIGINT AS rec_idx, pos FROM placed",
        "sample_share_by_file": f"SELECT (vec_id % 8)::BIGINT AS file_ord, count(*) AS records_read, count(*) FILTER ({uniform('keep', 'vec_id')} < {RATE}) AS records_kept FROM embeddings GROUP BY 1",
        "sample_names": """SELECT DISTINCT rate, 'sample-' || round(rate * 100)::INT || '.bin' AS file_name
FROM (SELECT unnest([l_discount::DOUBLE, l_discount::DOUBLE / 8]) AS rate FROM lineitem WHERE l_discount > 0)""",
        "whole_pass_bytes": f"WITH k AS (SELECT ceil(count(*) * {RATE})::BIGINT * 260 AS b FROM embeddings) SELECT b + ceil(b / 100)::BIGINT AS expected_bytes FROM k",
        "quantise_bf16": f"{with_values}\n{final.format(bf16('x'), 'v')}",
        "quantise_bf16_expression": f"WITH v AS (SELECT o_orderkey AS pos, o_totalprice::FLOAT AS x FROM orders) SELECT pos, ({bf16('x')})::DOUBLE AS value FROM v",
        "error_probe_report": f"""WITH v AS (SELECT (CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END)::FLOAT * ((0.017::FLOAT + (vec_id::FLOAT * 0.001::FLOAT)::FLOAT)::FLOAT * sqrt((1 + k)::FLOAT)::FLOAT)::FLOAT AS x FROM embeddings, range(0, 256) t(k)), {errors}""",
        "quantise_error": f"{with_values}, {errors}",
        "storage_reduction": "SELECT 1 - (count(*) * 130)::DOUBLE / (count(*) * 260) AS reduction FROM embeddings",
        "fuzz_counts": f"""{with_values}, {noise('v', SEED, 'n')}, m AS (SELECT (x::DOUBLE + {held.scale} * (2 * u - 1))::FLOAT AS y FROM n WHERE i < 64)
SELECT count(*) AS perturbed, count(*) FILTER (y < {held.low} OR y > {held.high}) AS clamped, 0::BIGINT AS preserved FROM m""",
        "fuzz_preserve_non_finite": "SELECT count(*) FILTER (vec_id % 3 = 0) AS nans, count(*) FILTER (vec_id % 5 = 0) AS infinities, count(*) * 65 - count(*) FILTER (vec_id % 3 = 0) - count(*) FILTER (vec_id % 5 = 0) AS finite FROM embeddings",
        "stage_seeds": f"""WITH z0 AS (SELECT o_orderkey::BIGINT AS position, ({SEED}::UHUGEINT + (o_orderkey::UHUGEINT * 11400714819323198485::UHUGEINT) % {word}) % {word} AS z FROM orders),
z1 AS (SELECT position, (xor(z, z // 1073741824) * 13787848793156543929::UHUGEINT) % {word} AS z FROM z0), z2 AS (SELECT position, (xor(z, z // 134217728) * 10723151780598845931::UHUGEINT) % {word} AS z FROM z1)
SELECT position, xor(z, z // 2147483648)::VARCHAR AS seed FROM z2""",
        "record_digests": f"WITH {CORPUS} SELECT pos, sha256(array_to_string(list_transform(vals, lambda z: round(z::DOUBLE * 1000000)::BIGINT::VARCHAR), ',')) AS digest FROM corpus",
        "sample_containment": f"WITH {CORPUS}, kept AS (SELECT * FROM corpus WHERE {uniform('keep', 'pos')} < {RATE}) SELECT count(*) AS not_in_source FROM (SELECT vals FROM kept EXCEPT ALL SELECT vals FROM corpus)",
        "baseline_compare": """WITH a AS (SELECT o_orderpriority AS label, count(*) AS n, max(o_custkey) AS rss, sum(o_orderkey) AS size FROM orders WHERE o_custkey % 2 = 0 AND o_orderpriority <> '1-URGENT' GROUP BY 1),
b AS (SELECT o_orderpriority AS label, count(*) AS n, max(o_custkey) AS rss, sum(o_orderkey) AS size FROM orders WHERE o_custkey % 2 = 1 AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT coalesce(a.label, b.label) AS label, round(b.n / a.n::DOUBLE, 6) AS speed, round(b.rss / a.rss::DOUBLE, 6) AS memory, round(b.size / a.size::DOUBLE, 6) AS size, CASE WHEN b.label IS NULL THEN 'regression' WHEN a.label IS NULL THEN 'new'
  WHEN b.n < a.n * 0.99::DOUBLE OR b.rss > a.rss * 1.01::DOUBLE OR b.size > a.size * 1.01::DOUBLE THEN 'regression' ELSE 'ok' END AS verdict FROM a FULL JOIN b ON a.label = b.label""",
        "derived_metrics": "SELECT o_orderpriority AS label, round(count(*) / 1.5::DOUBLE, 6) AS records_per_second, 0.5::DOUBLE AS output_ratio FROM orders GROUP BY 1",
        "metadata_valid": r"""WITH e AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '_') END AS k,
         CASE WHEN p_partkey % 4 = 2 THEN repeat(p_name, p_partkey % 90) ELSE 'v=w' END AS v FROM part)
SELECT p_partkey, p_partkey % 4 <> 3 AND regexp_full_match(k, '[A-Za-z0-9_.-]{1,64}') AND strlen(v) <= 1024 AS valid FROM e""",
        "manifest_timestamp": "SELECT event_id, strftime(make_timestamp(event_id * 86399 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events",
    }
    for name, policy in POLICIES.items():
        out[name] = f"{with_values},\n{noise('v', SEED, 'n')}\nSELECT pos, i, ({fuzzed(policy)})::DOUBLE AS value FROM n"
    first, second = stage_seed(SEED, 1), stage_seed(SEED, 2)
    out["pipeline_sample_fuzz_quantise"] = (
        f"WITH {CORPUS},\n{sampled(first)},\nv AS ({VALUES.format('placed')}),\n{noise('v', second, 'n')},\n"
        f"f AS (SELECT pos, i, {fuzzed(relative)} AS x FROM n)\nSELECT pos, i, ({bf16('x')})::DOUBLE AS value FROM f"
    )
    out["pipeline_quantise_fuzz"] = f"WITH {CORPUS},\nw AS ({VALUES.format('corpus')}),\nv AS (SELECT pos, i, {bf16('x')} AS x FROM w),\n{noise('v', second, 'n')},\nf AS (SELECT pos, i, {fuzzed(relative)} AS x FROM n)\nSELECT pos, i, ({bf16('x')})::DOUBLE AS value FROM f"
    out["pipeline_fuzz_quantise"] = f"{with_values},\n{noise('v', first, 'n')},\nf AS (SELECT pos, i, {fuzzed(relative)} AS x FROM n)\nSELECT pos, i, ({bf16('x')})::DOUBLE AS value FROM f"
    return out
