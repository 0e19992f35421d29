"""Byte payloads, cut borders and journals over small cases with known answers."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import journal, payloads


def signature(name, data, offset=0):
    return payloads.Signature(name, len(data), hashlib.sha256(data).hexdigest(), data[offset : offset + 64], offset)


def brute(data, signatures):
    matches, candidates = [], 0
    for s in signatures:
        at = data.find(s.anchor)
        while at >= 0:
            candidates += 1
            if candidates > 128:
                return candidates, "candidates", None
            a = at - s.anchor_offset
            if 0 <= a and a + s.length <= len(data) and hashlib.sha256(data[a : a + s.length]).hexdigest() == s.sha256:
                matches.append((a, a + s.length))
                if len(matches) > 16:
                    return candidates, "matches", None
            at = data.find(s.anchor, at + 1)
    matches.sort()
    if any(a[1] > b[0] for a, b in zip(matches, matches[1:], strict=False)):
        return candidates, "overlap", None
    return candidates, None, matches


@pytest.mark.parametrize("size", [70, 101, 4096])
def test_payloads_across_slices(spark, size):
    rng = random.Random(size)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    long, short, zeros = noise(300), noise(90), bytes(64)
    known = [signature("long", long, 130), signature("short", short), signature("zeros", zeros)]
    changed = long[:250] + b"x" + long[251:]
    files = [None, b"", noise(63), long, long[1:], changed + short, noise(40) + short + noise(7) + long + long + noise(90), short * 17, short * 3 + bytes(128), bytes(63 + 128), bytes(64 + 128), long[100:] + long, short + short[:64]]
    rows = spark.createDataFrame(list(enumerate(files)), "key long, content binary").repartition(3)
    sources = rows.select("key", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"))
    for slices in (payloads.cut(rows, "key", "content", size), payloads.carried(payloads.cut(rows, "key", "content", size))):
        found = {r.key: (r.candidates, r.error, None if r.matches is None else [tuple(m) for m in r.matches]) for r in payloads.find_payloads(sources, slices, known, size).collect()}
        assert found == {k: brute(x or b"", known) for k, x in enumerate(files)}


@pytest.mark.parametrize("change", [{"length": 63}, {"anchor_offset": 400}, {"sha256": "0" * 63 + "G"}, {"id": ""}, {"anchor": b"x" * 63}])
def test_catalogs_are_checked(change):
    good = signature("a", bytes(range(200)))
    assert payloads.checked([good]) == [good]
    with pytest.raises(ValueError):
        payloads.checked([payloads.Signature(**(good.__dict__ | change))])
    for many in ([], [good, good], [signature(str(i), bytes([i]) * 64) for i in range(9)]):
        with pytest.raises(ValueError):
            payloads.checked(many)


PACKET = "key long, stream int, pos long, size long, video boolean, keyframe boolean, pts long, dts long, duration long"


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_borders(spark, block):
    steady = [(k, 0, i * 10, 10, True, True, i, i, 1) for k in range(8) for i in range(6)]
    by_key = {k: [p for p in steady if p[0] == k] for k in range(8)}
    by_key[1][2] = (1, 0, 19, 12, True, True, 2, 2, 1)  # reaches over 20 and 30
    by_key[2].append((2, 1, 20, 10, True, True, 9, 1, 1))  # a second video packet at 20
    by_key[3][2] = (3, 0, 20, 10, True, False, 2, 2, 1)  # no keyframe
    by_key[4][1] = (4, 0, 10, 0, True, True, 1, 1, 1)  # empty
    by_key[5][3] = (5, 0, 30, 10, True, True, 3, 1, 1)  # goes back
    by_key[6][4] = (6, 0, 40, 10, True, True, 2, 4, 1)  # shown before the one at 20
    by_key[7].append((7, 1, 20, 10, False, False, 9, 1, 1))  # sound may start there as well
    packets = spark.createDataFrame([p for ps in by_key.values() for p in ps], PACKET)
    spans = spark.createDataFrame([(k, 20, 40) for k in range(8)] + [(9, 20, 40)], "key long, start long, stop long")
    sizes = spark.createDataFrame([(k, 60) for k in range(10)], "key long, bytes long")
    found = {r.key: (r.refused, r.ticks) for r in payloads.removals(packets, spans, sizes, block).collect()}
    assert found == {0: (None, 2), 1: ("cut", None), 2: ("keyframe", None), 3: ("keyframe", None), 4: ("packet", None), 5: ("order", None), 6: ("time", None), 7: (None, 2), 9: ("packet", None)}


GOOD = (
    '{"cumulative_elapsed_seconds":5,"elapsed_seconds":2.5,"features":{"candidate_gate":"valid","errors":["a"],"expected_absences":["x","y"],"inputs":{"candidate":{"status":"ok"}},"ocr":{}},'
    '"row":{"decision":"experimental_ad_candidate","duration_seconds":3,"errors":["a"],"expected_absence_count":2,"region_indices":[1,2],"score":60.5,"segment_indices":[4],"status":"scored"},'
    '"weighted":{"candidate_source_gate":{"valid":true},"decision":"experimental_ad_candidate","score":60.5}}'
)


@pytest.mark.parametrize(
    ("old", "new", "reason"),
    [
        ("", "", None),
        ("{", "[", "checkpoint_invalid_json"),
        ('"elapsed_seconds":2.5,', '"elapsed_seconds":2.5,"more":1,', "checkpoint_invalid_payload"),
        ('"weighted":{"candidate_source_gate":{"valid":true},"decision":"experimental_ad_candidate","score":60.5}', '"weighted":[]', "checkpoint_missing_raw_evidence"),
        ('"region_indices":[1,2]', '"region_indices":[2,1]', "checkpoint_invalid_row_types"),
        ('"region_indices":[1,2]', '"region_indices":[true]', "checkpoint_invalid_row_types"),
        ('"segment_indices":[4]', '"segment_indices":[]', "checkpoint_invalid_row_types"),
        ('"duration_seconds":3', '"duration_seconds":"3"', "checkpoint_invalid_row_types"),
        ('"segment_indices":[4]', '"segment_indices":[5]', "checkpoint_candidate_row_mismatch"),
        ('"row":{', '"row":{"selection":null,', "checkpoint_requires_preselection_row"),
        ('"candidate_gate":"valid"', '"candidate_gate":"open"', "checkpoint_invalid_raw_gate"),
        ('"ocr":{}', '"ocr":[]', "checkpoint_invalid_raw_gate"),
        ('"errors":["a"],"expected_absences"', '"errors":[1],"expected_absences"', "checkpoint_invalid_raw_gate"),
        ('"valid":true', '"valid":1', "checkpoint_invalid_raw_gate"),
        ('"valid":true', '"valid":false', "checkpoint_score_or_gate_mismatch"),
        ('"decision":"experimental_ad_candidate","score":60.5}}', '"decision":"experimental_ad_candidate","score":true}}', "checkpoint_score_or_gate_mismatch"),
        ('"status":"ok"', '"status":"bad"', "checkpoint_score_or_gate_mismatch"),
        ('"score":60.5,"segment', '"score":60,"segment', "checkpoint_row_score_gate_decision_mismatch"),
        ('"expected_absence_count":2', '"expected_absence_count":1', "checkpoint_row_score_gate_decision_mismatch"),
        ('"errors":["a"],"expected_absence_count"', '"errors":[],"expected_absence_count"', "checkpoint_row_score_gate_decision_mismatch"),
        ('"status":"scored"', '"status":"unknown"', "checkpoint_row_score_gate_decision_mismatch"),
        ('"elapsed_seconds":2.5', '"elapsed_seconds":2', "checkpoint_elapsed_mismatch"),
        ('"elapsed_seconds":2.5', '"elapsed_seconds":-2.5', "checkpoint_elapsed_mismatch"),
    ],
)
def test_payload_rules(spark, old, new, reason):
    candidate = F.struct(F.array(F.lit(1), F.lit(2)).cast("array<long>").alias("region_indices"), F.array(F.lit(4)).cast("array<long>").alias("segment_indices"), F.lit(3.0).alias("duration_seconds"))
    assert old in GOOD
    text = GOOD.replace(',"elapsed_seconds":2.5', ',"elapsed_seconds":' + new[18:], 1) if new.startswith('"elapsed_seconds":') and not new.endswith(",") and "more" not in new else GOOD.replace(old, new, 1)
    row = spark.createDataFrame([(text,)], "payload string").select(journal.payload_reason(F.col("payload"), candidate, F.lit(55), F.lit(2.5)).alias("r"))
    assert row.first().r == reason


def test_bindings_have_canonical_text(spark):
    names = {n: F.lit(n[0]) for n in (*journal.SOURCE, "runtime_policy_sha256", "candidates_sha256", "reusable_prefix_sha256")} | {n: F.lit(3) for n in ("score_threshold", "candidate_count", "reusable_prefix_count")}
    import json

    row = spark.range(1).select(F.struct(*(c.alias(n) for n, c in names.items())).alias("b")).select(journal.binding_text(F.col("b")).alias("t"))
    text = row.first().t
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")) and len(json.loads(text)) == 10
