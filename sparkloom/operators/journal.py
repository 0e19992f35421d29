"""Journals of finished candidates: a hash chain per job, verified in parallel, of which the intact prefix is used again.

A record names the digest of its candidate, of the record before it (the first one: of the job's binding) and of its payload,
and carries a digest of itself. Writing a chain takes a job's records in order, so ``committed`` streams over them, sorted,
with one digest as its state. Reading one does not: each record is checked on its own and against its neighbour
(``lag``), and a running conjunction keeps those before the first failure.

Records: key, ordinal, candidate_sha256, previous_sha256, payload (canonical JSON: sorted keys, no blanks), payload_sha256,
record_sha256. A record without an ordinal below the job's number of candidates is not looked at; of one ordinal there is one record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORD = "key long, ordinal long, candidate_sha256 string, previous_sha256 string, payload string, payload_sha256 string, record_sha256 string"
#: Parts of a binding that stand for the source, and for the analysis (fixed values).
SOURCE = ("snapshot_identity", "manifest_sha256", "request_sha256")
POLICY = ("runtime_policy_sha256", "score_threshold")
POPULATION = ("candidate_count", "candidates_sha256", "reusable_prefix_count", "reusable_prefix_sha256")
_TEMPLATE = '{"candidate_sha256":"%s","ordinal":%d,"payload":%s,"payload_sha256":"%s","previous_sha256":"%s","schema":1}'


def record_digest(candidate: Column, ordinal: Column, payload: Column, payload_sha256: Column, previous: Column) -> Column:
    """SHA-256 of a record's canonical JSON without the digest itself."""
    return F.sha2(F.format_string(_TEMPLATE, candidate, ordinal, payload, payload_sha256, previous), 256)


def binding_text(binding: Column) -> Column:
    """Canonical JSON of a binding, a struct of ``SOURCE``, ``POLICY`` and ``POPULATION``."""
    text = lambda n: F.concat(F.lit(f'"{n}":"'), binding[n], F.lit('"'))
    number = lambda n: F.concat(F.lit(f'"{n}":'), binding[n].cast("string"))
    parts = [(number if n in ("candidate_count", "reusable_prefix_count", "score_threshold") else text)(n) for n in sorted((*SOURCE, *POLICY, *POPULATION)) if n < "schema"]
    rest = [number("score_threshold"), text("snapshot_identity")]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, F.lit('"schema":1'), *rest), F.lit("}"))


def binding_reason(active: Column, now: Column, readable: Column) -> Column:
    """Why a job's saved binding does not hold for this run; null where it does, or where none was saved."""
    differs = lambda names: ~F.coalesce(F.struct(*(active[n] for n in names)).eqNullSafe(F.struct(*(now[n] for n in names))), F.lit(False))
    reason = F.when(~readable, "checkpoint_active_binding_invalid").when(active.isNull(), None)
    return reason.when(differs(SOURCE), "checkpoint_source_changed").when(differs(POLICY), "checkpoint_runtime_policy_changed").when(differs(POPULATION), "checkpoint_candidates_changed")


def committed(rows: DataFrame) -> DataFrame:
    """Rows (key, ordinal, candidate_sha256, payload, identity) as records, each chained to the one before it in its job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, previous = None, ""
        for b in batches:
            out = []
            for key, ordinal, candidate, payload, identity in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if job != (key,):
                    job, previous = (key,), identity
                own = hashlib.sha256(payload.encode()).hexdigest()
                record = hashlib.sha256((_TEMPLATE % (candidate, ordinal, payload, own, previous)).encode()).hexdigest()
                out.append((previous, own, record))
                previous = record
            made = [pa.array([o[i] for o in out], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), made[0], b.column(3), made[1], made[2]], [c.split()[0] for c in RECORD.split(", ")])

    columns = rows.select(F.col("key").cast("long"), F.col("ordinal").cast("long"), "candidate_sha256", "payload", "identity")
    return columns.repartition("key").sortWithinPartitions("key", "ordinal").mapInArrow(run, RECORD)


def payload_reason(payload: Column, candidate: Column, threshold: Column, before: Column, parsed: Column | None = None, facts: dict[str, Column] | None = None) -> Column:
    """The first rule that a payload breaks, or null.

    ``candidate``: struct of region_indices, segment_indices, duration_seconds; ``before``: seconds saved by earlier records. ``parsed``
    is the payload as a variant. Rules look into it in some sixty places; what they look up is put into ``facts`` by name, and taken from
    there if it is there, so that a caller may compute each of these once a row, as a column.
    """
    value = F.try_parse_json(payload) if parsed is None else parsed
    facts = {} if facts is None else facts
    fact = lambda name, c: facts.setdefault(f"_{name}".replace(".", "_").replace("<", "_").replace(">", ""), c)
    at = lambda path, kind="variant": fact(f"{path} {kind}", F.try_variant_get(value, f"$.{path}", kind))
    kind = lambda path: fact(f"{path} kind", F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{path}", "variant")), F.lit("none")))
    object_ = lambda path: kind(path).startswith("OBJECT")
    sure = lambda c: F.coalesce(c, F.lit(False))
    numeric = lambda path: kind(path).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$") & sure(at(path, "double") >= 0)
    whole = lambda path: kind(path).rlike("^(BIGINT|INT|SMALLINT|TINYINT)$")
    array = lambda path: at(path, "array<bigint>")
    indices = lambda path: (kind(path) == "ARRAY<BIGINT>") & sure((F.size(array(path)) > 0) & (F.array_min(array(path)) >= 0) & (F.array_sort(F.array_distinct(array(path))) == array(path)))
    texts = lambda path: kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>")
    names = fact("names", F.array_sort(F.json_object_keys(payload)))
    expected = F.array(*(F.lit(n) for n in ("cumulative_elapsed_seconds", "elapsed_seconds", "features", "row", "weighted")))
    gate = at("weighted.candidate_source_gate.valid", "boolean")
    valid = sure(at("features.inputs.candidate.status", "string") == "ok") & sure(at("features.candidate_gate", "string") == "valid")
    decision = F.when(valid & (at("weighted.score", "double") >= threshold), "experimental_ad_candidate").otherwise("unknown")
    absences = F.when(at("features.expected_absences").isNull(), 0).otherwise(F.size(F.from_json(F.get_json_object(payload, "$.features.expected_absences"), "array<string>")))
    row_names = fact("row names", F.json_object_keys(F.get_json_object(payload, "$.row")))
    total, spent = at("cumulative_elapsed_seconds", "double"), at("elapsed_seconds", "double")
    near = F.abs(total - (before + spent)) <= F.greatest(F.lit(1e-9), 1e-12 * F.greatest(F.abs(total), F.abs(before + spent)))
    same_row = sure((array("row.region_indices") == candidate["region_indices"]) & (array("row.segment_indices") == candidate["segment_indices"]) & (at("row.duration_seconds", "double") == candidate["duration_seconds"]))
    raw = object_("features.inputs") & object_("features.inputs.candidate") & sure(at("features.candidate_gate", "string").isin("valid", "unknown")) & object_("features.ocr") & texts("features.errors")
    raw &= (at("features.expected_absences").isNull() | kind("features.expected_absences").startswith("ARRAY")) & (kind("weighted.candidate_source_gate.valid") == "BOOLEAN")
    judged = sure(at("weighted.decision", "string") == decision) & sure(at("row.decision", "string") == decision) & numeric("row.score") & sure(at("row.score", "double") == at("weighted.score", "double"))
    judged &= sure(at("row.status", "string") == F.when(valid, "scored").otherwise("unknown")) & sure(at("row.errors", "array<string>") == at("features.errors", "array<string>"))
    judged &= whole("row.expected_absence_count") & sure(at("row.expected_absence_count", "bigint") == absences)
    rules = [
        (value.isNotNull(), "json"),
        (sure(names == expected), "payload"),
        (object_("features") & object_("weighted") & object_("row"), "missing_raw_evidence"),
        (indices("row.region_indices") & indices("row.segment_indices") & numeric("row.duration_seconds"), "row_types"),
        (same_row, "candidate_row_mismatch"),
        (~sure(F.arrays_overlap(row_names, F.array(F.lit("selection"), F.lit("overlapping_passing_ranges")))), "requires_preselection_row"),
        (raw, "raw_gate"),
        (numeric("weighted.score") & sure(at("weighted.score", "double") <= 100) & sure(gate == valid), "score_or_gate_mismatch"),
        (judged, "row_score_gate_decision_mismatch"),
        (numeric("elapsed_seconds") & numeric("cumulative_elapsed_seconds") & sure(near), "elapsed_mismatch"),
    ]
    prefix = lambda name: f"checkpoint_invalid_{name}" if name in ("json", "payload", "row_types", "raw_gate") else f"checkpoint_{name}"
    out = F.when(~rules[0][0], prefix(rules[0][1]))
    for good, name in rules[1:]:
        out = out.when(~good, prefix(name))
    return out


def checked(records: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Records with ``reason``, the first rule that each breaks, and ``usable``: it and all before it break none.

    Candidates: key, ordinal, candidate_sha256, candidate. Jobs: key, identity, threshold and ``void``, whether nothing saved counts.
    """
    own = W.partitionBy("key").orderBy("ordinal")
    rows = records.join(candidates.select("key", "ordinal", F.col("candidate_sha256").alias("due"), "candidate"), ["key", "ordinal"]).join(jobs.where("NOT void").select("key", "identity", "threshold"), "key")
    rows = rows.withColumns({"place": F.row_number().over(own) - 1, "chained": F.coalesce(F.lag("record_sha256").over(own), F.col("identity"))})
    seconds = F.try_variant_get("parsed", "$.cumulative_elapsed_seconds", "double")
    rows = rows.withColumn("parsed", F.try_parse_json("payload")).withColumn("saved", seconds).withColumn("before", F.coalesce(F.lag("saved").over(own), F.lit(0.0)))
    digests = (F.col("candidate_sha256") == F.col("due")) & (F.col("previous_sha256") == F.col("chained")) & (F.col("payload_sha256") == F.sha2("payload", 256))
    digests &= F.col("record_sha256") == record_digest(F.col("candidate_sha256"), F.col("ordinal"), F.col("payload"), F.col("payload_sha256"), F.col("previous_sha256"))
    mismatch = F.when(~F.coalesce(digests, F.lit(False)), "checkpoint_record_identity_or_checksum_mismatch")
    given = [F.col(c) for c in ("payload", "candidate", "threshold", "before", "parsed")]
    facts: dict[str, Column] = {}
    payload_reason(*given, facts=facts)
    rows = rows.withColumns(facts)
    rows = rows.withColumn("broken", F.coalesce(mismatch, payload_reason(*given, facts={n: F.col(f"`{n}`") for n in facts}))).drop("parsed", *facts)
    reason = F.when(F.col("ordinal") != F.col("place"), F.format_string("checkpoint_missing_candidate_%d", F.col("place")))
    rows = rows.withColumn("reason", reason.when(F.col("broken").isNotNull(), F.format_string("checkpoint_invalid_candidate_%d: %s", F.col("ordinal"), F.col("broken"))))
    return rows.withColumn("usable", F.bool_and(F.col("reason").isNull()).over(own.rowsBetween(W.unboundedPreceding, 0)))


def restored(records: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """(key, completed, saved_seconds, reason) for every job; ``jobs`` has ``cause`` besides, why its binding is void, or null."""
    rows = checked(records, candidates, jobs)
    first = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("place")))
    per = rows.groupBy("key").agg(F.count_if("usable").alias("completed"), F.max(F.when(F.col("usable"), F.col("saved"))).alias("saved_seconds"), first.alias("found"))
    return jobs.select("key", "cause").join(per, "key", "left").select("key", F.coalesce("completed", F.lit(0)).alias("completed"), F.coalesce("saved_seconds", F.lit(0.0)).alias("saved_seconds"), F.coalesce("cause", "found").alias("reason"))
