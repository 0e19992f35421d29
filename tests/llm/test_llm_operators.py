"""Every operator over awkward tables, against brute force."""

from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, common, decontam, licenses, mixing, neardup, quality, suffix_dedup, token_counts, token_ids, warc
from sparkloom.llm import kernels as K
from sparkloom.llm.components import components
from sparkloom.llm.encoder import encoder
from sparkloom.llm.queries import tokenizer_path

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnoprstué") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def edited(text, k, seed):
    rng = random.Random(seed)
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY).upper()
    return " ".join(w)


def awkward_texts():
    long = prose(120, 1)
    passage = prose(80, 2)
    out = [None, "", " \n\t ", "one", "two words", "ONE two Three", long, long, long.upper(), "a " * 900, "x" * 3000, "\n".join(["same line here"] * 40)]
    out += [edited(long, k, k) for k in range(1, 9)] + [edited(edited(long, 2, 50), 3, 60 + i) for i in range(5)]
    out += [prose(60, 100 + i) + " " + passage + " " + prose(70, 200 + i) for i in range(6)]
    out += [passage, prose(4, 9), prose(5, 10), prose(20000, 11), "# $ % | " * 60 + prose(60, 12), "héé ÀÉ   \x1c end" * 3]
    return out


ROWS = [(i * 7 - 14, t, "x", f"s{i % 3}" if i % 5 else None) for i, t in enumerate(awkward_texts())]
SCHEMA = "doc_id long, text string, kept string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns named like the operators' own
    extra = [F.lit(1).alias(c) for c in ("digest", "key", "n", "node", "size", "n_words", "part", "tie", "words", "copies", "h")]
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).select("*", *extra).cache()


@pytest.fixture(scope="module")
def twisted(spark):
    """Null ids, repeated rows, one id with several texts."""
    t = prose(90, 3)
    rows = [(None, t), (None, None), (5, t), (5, t), (5, prose(70, 4)), (5, None), (6, edited(t, 2, 1)), (None, prose(60, 5))]
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


PAIRS = [(r[0], r[1]) for r in ROWS]


def test_token_files_hold_the_ids(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    want = brute.token_ids([(d, t or "") for d, t in PAIRS], Tokenizer.from_file(tokenizer_path()))
    assert table(token_ids.token_files(docs, tokenizer_path()), *columns) == want
    folder = f"file://{tmp_path}/set"
    manifest = token_ids.write(docs, folder, tokenizer_path(), docs_per_shard=5)
    assert len(manifest["shards"]) > 5 and json.loads((tmp_path / "set/manifest.json").read_text()) == manifest
    assert table(token_ids.read(spark, folder, manifest), *columns) == want
    assert sorted(p.name for p in (tmp_path / "set").iterdir()) == sorted(["manifest.json", *(f"{s['name']}.{k}" for s in manifest["shards"] for k in ("bin", "idx"))])
    again = token_ids.write(docs.repartition(7), f"file://{tmp_path}/again", tokenizer_path(), docs_per_shard=5)
    assert again == manifest
    assert all((tmp_path / f"again/{s['name']}.bin").read_bytes() == (tmp_path / f"set/{s['name']}.bin").read_bytes() for s in manifest["shards"])


def test_token_files_of_null_and_repeated_ids(spark, twisted, tmp_path):
    manifest = token_ids.write(twisted, f"file://{tmp_path}/t", tokenizer_path(), docs_per_shard=2)
    got = token_ids.read(spark, f"file://{tmp_path}/t", manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, None, 5, 5, 5, 5, 6]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(8)]


def test_ranges_split_hot_keys(spark):
    df = spark.createDataFrame([(i // 50 if i < 1000 else 10**15 + (i > 1500),) for i in range(2000)], "k long")
    ranges = common.Ranges.over(df, "k", 60)
    import numpy as np

    keys = np.array([r.k for r in df.collect()])
    part = ranges.of(keys, np.zeros(len(keys), bool), np.arange(len(keys)))
    assert part.max() < ranges.parts and np.bincount(part).max() <= 75
    order = np.argsort(part, kind="stable")
    assert (np.diff(keys[order]) >= 0).all()


@pytest.mark.parametrize("parts", [1, 300])
def test_ranges_of_far_apart_clusters(spark, parts):
    """Clusters of ids as monotonically_increasing_id makes them, and clusters that each lie deep inside a bin of the last."""
    ids = [(c << 33) + i for c in range(parts) for i in range(150)] + [2**62 + (1 << e) + i for e in range(0, 60, 4) for i in range(40)] + [-(2**63), 2**63 - 1]
    ranges = common.Ranges.over(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 8)
    keys = np.array(sorted(ids))
    part = ranges.of(keys, np.zeros(len(keys), bool), np.arange(len(keys)) * 7919)
    assert len(ranges.base) == len(ranges.split) == len(ranges.edges) + 1
    assert (np.diff(part) >= 0).all() and part.max() < ranges.parts
    # an id may occur twice, the others once
    assert np.bincount(part).max() <= 8


BENCHMARK = [("7", None), ("8", ""), ("9", "one"), ("10", ROWS[6][1]), ("10", ROWS[6][1]), ("11", prose(40, 2)), ("12", "TWO words"), (None, prose(13, 2)), ("13", prose(50, 999))]


def test_decontamination(spark, docs, twisted, nothing):
    items = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert table(decontam.decontaminate(docs, items), *columns) == sorted(brute.decontaminate(PAIRS, BENCHMARK))
    rows = [(r.doc_id, r.text) for r in twisted.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = [tuple(r[c] for c in columns) for r in decontam.decontaminate(twisted, items).collect()]
    assert sorted(got, key=key) == sorted(brute.decontaminate(rows, BENCHMARK), key=key)
    assert decontam.decontaminate(nothing, items).count() == 0
    assert table(decontam.decontaminate(docs, items.limit(0)), *columns) == sorted(brute.decontaminate(PAIRS, []))


@pytest.mark.parametrize(("bits", "segment"), [(10, 19), (14, 11)])
def test_decontamination_with_crowded_filters(spark, docs, monkeypatch, bits, segment):
    """Filters that let much through, in one segment or several."""
    items = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    monkeypatch.setattr(decontam, "SEGMENT", segment)
    got = decontam.decontaminate(docs, items)
    assert table(got, "doc_id", "n_hit", "n_items") == sorted((r[0], r[2], r[3]) for r in brute.decontaminate(PAIRS, BENCHMARK))


def test_token_counts_follow_edits(spark, docs, nothing):
    enc = token_counts.encoder(tokenizer_path())
    got = token_counts.masked_counts(docs, tokenizer_path()).collect()
    texts = dict(PAIRS)
    for r in got:
        assert r.tokens_before == len(enc.library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
    assert token_counts.masked_counts(nothing, tokenizer_path()).count() == 0


def test_random_edits_against_encoding_again(spark):
    enc = token_counts.encoder(tokenizer_path())
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(150):
        text = prose(rng.choice([0, 1, 30, 300, 2000]), i).replace("é", rng.choice(["é", " ", "\t ", "e"]))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 5)) // 2 * 2))
        edits, out, at = [], "", 0
        for a, z in zip(cuts[::2], cuts[1::2], strict=True):
            new = rng.choice(["", " ", "x", "\n\n", "é", " new words here", "y" * 50, prose(900, i)])
            a, z = (a, a) if rng.random() < 0.3 else (a, min(z, a + rng.choice([1, 5, 700])))
            edits.append((len(text[:a].encode()), len(text[:z].encode()), new))
            out += text[at:a] + new
            at = z
        out += text[at:]
        rows.append((i, text, edits or None))
        want[i] = out
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    for r in token_counts.count_edits(df, F.col("edits"), tokenizer_path()).collect():
        assert r.text == want[r.doc_id]
        assert r.tokens_after == len(enc.library.encode(r.text, add_special_tokens=False).ids) == sum(r.leaf_tokens)
        assert (r.leaf_ends[-1] if r.text else 0) == r.n_bytes == len(r.text.encode()) and list(r.leaf_ends) == sorted(r.leaf_ends)


def test_stored_trees_are_edited_again(spark, tmp_path, twisted, nothing):
    """Trees go to disk and come back; later edits encode the leaves they touch and no whole text."""
    rng = random.Random(9)
    texts = {i: prose(4000, i) for i in range(4)} | {4: "", 5: "short"}
    token_counts.build_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer_path()).write.parquet(f"{tmp_path}/trees-0")
    enc = encoder(tokenizer_path())
    for step in range(3):
        trees = spark.read.parquet(f"{tmp_path}/trees-{step}")
        rows = []
        for i, t in texts.items():
            at = rng.randrange(len(t) + 1)
            stop, new = min(len(t), at + rng.choice([0, 3, 900])), rng.choice(["", "new words", "\n\n x", prose(300, step)])
            rows.append((i, [(len(t[:at].encode()), len(t[:stop].encode()), new)]))
            texts[i] = t[:at] + new + t[stop:]
        edits = spark.createDataFrame(rows, f"id long, edits {token_counts.EDITS}")
        out = token_counts.apply_edits(trees.join(edits, F.col("doc_id") == F.col("id")), tokenizer_path(), F.col("edits"))
        out.write.parquet(f"{tmp_path}/trees-{step + 1}")
        for r in spark.read.parquet(f"{tmp_path}/trees-{step + 1}").collect():
            assert r.text == texts[r.doc_id]
            assert r.tokens_after == len(enc.library.encode(r.text, add_special_tokens=False).ids) == sum(r.leaf_tokens)
            # the edit's own text, the leaves at both ends and their neighbours
            assert r.encoded_bytes <= len(rows[r.doc_id][1][0][2].encode()) + 8 * token_counts.SPLIT * token_counts.LEAF
    empty = token_counts.apply_edits(token_counts.build_trees(twisted, tokenizer_path()), tokenizer_path(), F.lit(None))
    assert sorted((r.doc_id or -1, r.tokens_before == r.tokens_after, r.encoded_bytes) for r in empty.collect()) == sorted((r.doc_id or -1, True, 0) for r in twisted.collect())
    assert token_counts.apply_edits(token_counts.build_trees(nothing, tokenizer_path()), tokenizer_path(), F.lit(None)).count() == 0


@pytest.mark.parametrize("edits", [[(3, 1, "")], [(0, 99, "")], [(2, 4, ""), (3, 5, "")], [(1, 2, "x")]])
def test_bad_edits_fail(edits):
    text = "aé bcd".encode()
    with pytest.raises(ValueError, match="document 5"):
        token_counts.Edited(text if edits != [(1, 2, "x")] else "é b".encode(), token_counts.Tree(*token_counts.leaves(token_counts.np.array([0]), token_counts.np.array([3]), len(text))), [(a, b, c.encode()) for a, b, c in edits], 5)


def test_quality(spark, docs, twisted, nothing):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality.quality_report(docs)
    assert table(got, *columns) == sorted((d, *brute.quality_base(t)) for d, t in PAIRS)
    verdict = {r.doc_id: r for r in got.collect()}
    assert not any(r.kept for r in verdict.values() if r.base_failed)
    assert all(verdict[d].kept for d, t in PAIRS if t and t in (ROWS[6][1], prose(20000, 11)))
    assert not verdict[ROWS[-2][0]].kept
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and table(kept, "doc_id") == sorted((d,) for d, r in verdict.items() if r.kept)
    assert quality.quality_report(twisted).count() == 8
    assert quality.quality_report(nothing).count() == quality.quality_filter(nothing).count() == 0


def test_repeats(spark, docs, twisted, nothing, monkeypatch):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(brute.repeats(PAIRS))
    assert table(suffix_dedup.remove_repeats(docs), *columns) == want
    kept = suffix_dedup.remove_repeats(docs, with_bytes=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in kept)
    monkeypatch.setattr(suffix_dedup, "MOST", 1)  # every anchor is a hot one
    assert table(suffix_dedup.remove_repeats(docs), *columns) == want
    rows = [(i, r.text) for i, r in enumerate(twisted.collect())]
    want = sorted(r[1:] for r in brute.repeats(rows))
    assert table(suffix_dedup.remove_repeats(twisted), *columns[1:]) == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_in_many_contexts(spark, monkeypatch):
    """Passages between different words, split down to single strings, and edits at every distance from each other."""
    rng = random.Random(12)
    passage = prose(150, 41)
    rows = [prose(rng.randint(0, 9), 500 + i) + "xyz"[i % 3] + passage[rng.choice([0, 0, 0, 1, 5, 40]) :] + "uv"[i % 2] + prose(rng.randint(0, 90), 700 + i) for i in range(40)]
    rows += [edited(passage, k, k) + prose(20, 800 + k % 3) for k in range(12)]
    rows = list(enumerate(rows))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.repeats(rows))
    for most in (2048, 1):
        monkeypatch.setattr(suffix_dedup, "MOST", most)
        assert table(suffix_dedup.remove_repeats(df), *columns) == want


def test_repeats_of_runs_and_periods(spark):
    """Runs and periods make few rows, and texts of several megabytes are read in slices."""
    rng = random.Random(4)
    period = "".join(rng.choice("abcdefgh") for _ in range(37))
    lead = prose(60, 31)
    rows = [(1, lead + "x" * 3000 + prose(60, 32)), (2, period * 60), (3, prose(80, 33) + period * 14), (4, "x" * 399), (5, "x" * 400)]
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(suffix_dedup.remove_repeats(df), *columns) == sorted(brute.repeats(rows))
    big = [(1, "q" * 10_000_000), (2, lead + period * 100_000), (3, " ".join(f"{i:x}" for i in range(600_000)))]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(big, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (10_000_000, 1)
    assert (got[2].n_removed, got[2].n_bytes - got[2].n_removed) == (3_700_000, len(lead.encode()))
    assert got[3].n_removed == 0


def page_rows():
    big = "<p>" + "x" * 200 + "</p>"
    return [(5, "u5", big), (2, "u2", big), (9, None, big), (3, "a\nb%", None), (4, "u4", ""), (6, "u6", "tiny"), (7, "u7", "tiny"), (8, "u8", "é" * 60), (1, "u1", "é" * 60), (10, "", "🙂" * 3000)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumns({"digest": F.lit(1), "part": F.lit("x")})
    want, first = [], {}
    for i, _, h in sorted(page_rows(), key=lambda r: r[0]):
        b = (h or "").encode()
        g = hashlib.sha256(b).hexdigest()
        leader = first.setdefault(g, i) if len(b) >= 100 else i
        want.append((i, len(b), g, "response" if leader == i else "revisit", None if leader == i else leader))
    got = sorted(tuple(r)[:5] for r in warc.archive(pages).collect())
    assert got == want
    make = lambda name, df, **k: warc.write(df, f"file://{tmp_path}/{name}", pages_per_part=4, **k)
    one, two = make("a", pages, roll=300), make("b", pages.repartition(5), roll=300)
    assert one == two and len(one["files"]) > 3 and one["records"] == 10
    for f in one["files"]:
        raw = (tmp_path / "a" / f["name"]).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and raw == (tmp_path / "b" / f["name"]).read_bytes()
    assert sorted(tuple(r)[:5] for r in warc.read(spark, f"file://{tmp_path}/a", one).collect()) == want


def test_warc_of_null_and_repeated_pages(spark):
    big = "y" * 150
    pages = spark.createDataFrame([(None, "n", big), (3, "u", big), (3, "u", big), (3, "v", big), (None, None, None)], "page_id long, url string, html string")
    got = warc.archive(pages).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [(0, 0, "response", 0), (0, 150, "revisit", 3), (3, 150, "response", 0), (3, 150, "revisit", 3), (3, 150, "revisit", 3)]
    assert warc.archive(pages.limit(0)).count() == 0


def test_damaged_records_are_refused():
    raw = warc.zlib.decompress(warc.encode_record(1, "u", "abc", hashlib.sha256(b"abc").hexdigest(), 3, "response", None, None, "2000-01-01T00:00:00Z"), 31)
    assert warc.decode_record(raw)[0]["X-Page-ID"] == "1"
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(raw.replace(b"abc", b"abd"))


def conversations():
    rng = random.Random(5)
    rows = []
    for c in range(12):
        n = rng.choice([1, 2, 5, 9, 60])
        for t in range(n):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant\n", None])
            text = rng.choice([None, "", "<|im_end|>\n<|im_start|>user\n", "back\\slash <\\| <|", prose(rng.choice([3, 40, 400]), t * 31 + c), "<"])
            rows.append((c if c else None, t, role, text))
    rows += [(50, 1, "user", "tie b"), (50, 1, "user", "tie a"), (50, None, "assistant", "first"), (50, 1, "user", "tie a")]
    return rows


@pytest.mark.parametrize(("budget", "stretch"), [(2048, 64), (300, 64), (300, 2)])
def test_chat_windows(spark, monkeypatch, budget, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "context": F.lit("c")})
    out = common.staged(chat.windows(turns, tokenizer_path(), budget=budget, history=100), "t")
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0, role or "", text or ""), role or "", text or ""))
    assert set(got) == set(by)
    for c, v in by.items():
        v = [(r, t) for _, r, t in sorted(v)]
        loss = "".join(t for r, t in v if r == "assistant")
        want = (len(v), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    for w in out.collect():
        own = len(chat.parse(w.text)) - w.context
        assert own >= 1 and (w.n_tokens <= budget or own == 1)
    assert chat.formatted_report(turns.limit(0), tokenizer_path()).count() == 0


def test_windows_of_short_turns_keep_the_budget(spark):
    """The tokens of a whole window, template and escapes included, against the budget."""
    rows = [(1, i, ("user", "assistant")[i % 2], ("ok", "a\\b <| c")[i % 3 == 0]) for i in range(400)]
    got = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tokenizer_path(), budget=256, history=64).collect()
    assert len(got) > 1
    for w in got:
        real = sum(int(encoder(tokenizer_path()).lengths(data, bounds)[1].sum()) for _, data, bounds, _ in K.blocks(pa.array([w.text])))
        assert real <= w.n_tokens <= 256


def test_license_scan(spark, docs, nothing):
    mit, apache, bsd = (licenses.TEMPLATES[n][0] for n in ("MIT", "Apache-2.0", "BSD-3-Clause"))
    wrapped = "\n".join(f"// {x}" for x in apache.split("."))
    rows = [
        (1, f"Copyright 2021 A. Person. {mit} And more text follows here, about something else."),
        (2, "Released under an MIT License"),
        (3, None),
        (4, ""),
        (5, "License"),
        (6, "Some words before. This work is licensed under\nthe GNU General Public License,\nversion 3. And after."),
        (7, f"Copyright 2021. Released under the MIT License. See {wrapped}"),
        (8, "Released under the new and improved MIT License today and forever."),
        (9, bsd.replace("the copyright holder", "Some Company").upper()),
        (9, mit[: len(mit) // 3]),
        (None, "words " * 50000 + mit),
        (10, prose(300, 3)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(1))
    got = [(r.doc_id, r.licenses, r.n_matches) for r in licenses.scan(df).collect()]
    want = {1: "MIT", 2: "", 3: "", 4: "", 5: "", 6: "GPL-3.0", 7: "Apache-2.0,MIT", 8: "", 10: "", None: "MIT"}
    assert all(x in got for x in ((k, v, len(v.split(",")) if v else 0) for k, v in want.items())), got
    both = [x[1] for x in got if x[0] == 9]
    assert "BSD-3-Clause" in max(both) and "" in both and len(got) == len(rows)
    assert licenses.scan(nothing).count() == 0 and licenses.scan(docs).count() == len(ROWS)


def test_license_scan_against_all_aligned_windows(spark):
    """Every indexed bigram in every place, by brute force, at several thresholds."""
    rng = random.Random(8)
    texts = {"A": ("one two three four five six seven", "one two three"), "B": ("seven eight nine ten one two three four",), "C": ("x",)}
    vocabulary = "one two three four five six seven eight nine ten".split()
    rows = [(i, " ".join(rng.choice(vocabulary) if rng.random() < 0.35 else vocabulary[(i + j) % 10] for j in range(rng.randint(0, 25)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 80, 100):
        table, entries = licenses.index(texts, percent)
        for r in licenses.scan(df, texts, percent).collect():
            w, found = rows[r.doc_id][1].split(), {}
            for g, t, o in entries:
                _, name, n, gs = table[t]
                for p in range(len(w) - 1):
                    x = w[max(0, p - o) : max(0, p - o + n)]
                    if " ".join(w[p : p + 2]) == g and len(x) > 1:
                        a = set(licenses.bigrams(" ".join(x)))
                        d = 2 * len(a & set(gs)) / (len(a) + len(gs))
                        if d * 100 >= percent:
                            key = name, max(0, p - o)
                            found[key] = max(found.get(key, (0, 0)), (d, len(x)))
            all_ = [(-d, -m, name, start) for (name, start), (d, m) in found.items()]
            left = [x for x in all_ if not any(y < x and y[3] < x[3] - x[1] and x[3] < y[3] - y[1] for y in all_)]
            assert sorted((-m.dice, -m.words, m.license, m.start) for m in r.matches) == sorted(left)


def test_every_match_of_a_whole_template_is_indexed():
    """Any set of bigrams large enough to match holds an indexed one."""
    for percent in (50, 80, 95):
        table, entries = licenses.index(licenses.TEMPLATES, percent)
        for t, _, _, gs in table:
            kept = {g for g, x, _ in entries if x == t}
            left = len(gs) - len(kept)  # the largest set without an indexed bigram, in a window of its own
            assert 200 * left < percent * (left + len(gs))


def gap_is_closed(rows, target):
    """Whether taken words end within the smallest document of the target, or no document that could help is free."""
    sizes = [n for n, _ in rows if n]
    gap = target - sum(n * c for n, c in rows)
    if abs(gap) <= max(min(sizes, default=0), 1e-3):
        return True
    bound = 2 if gap > 0 else 0
    return all(c == bound for n, c in rows if 0 < n <= abs(gap) / 2)


def test_mix_meets_its_targets(spark, docs, twisted, nothing):
    got = mixing.mix(docs).collect()
    sizes = {d: len(brute.BLANK.findall(t or "")) for d, t in PAIRS}
    source = {r[0]: r[3] for r in ROWS}
    want = brute.mix_targets([(source[d], n) for d, n in sizes.items()])
    by = defaultdict(int)
    for d, n in sizes.items():
        by[source[d]] += n
    assert len(got) == len(ROWS)
    taken = defaultdict(list)
    for r in got:
        assert (r["size"], r.source_size) == (sizes[r.doc_id], by[source[r.doc_id]]) and r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]].append((r["size"], r.copies))
    assert all(gap_is_closed(v, want[s]) for s, v in taken.items())
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    rows = mixing.mixed_rows(docs, mixing.mix(docs))
    assert rows.columns == docs.columns
    assert rows.where("doc_id = 28").count() == next(r.copies for r in got if r.doc_id == 28)
    assert mixing.mix(twisted).count() == 8
    assert mixing.mix(nothing).count() == 0


def test_mix_against_brute_force(spark):
    """Targets, rates and copies of many sources against a bisection and a plain loop."""
    rng = random.Random(21)
    rows = []
    for s in range(23):
        for _ in range(rng.choice([1, 5, 40, 200])):
            n = rng.choice([0, 1, 3, 30, 31, 200, rng.randint(1, 900), 20000 if rng.random() < 0.01 else 50])
            rows.append((len(rows), "w " * n, f"s{s:02d}" if s else None))
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    sized = [(d, s, len(t) // 2) for d, t, s in rows]
    want = brute.mix_targets([(s, n) for _, s, n in sized])
    by = defaultdict(list)
    for d, s, n in sized:
        by[s].append((d, n))
    for s, v in by.items():
        assert all(got[d].target == pytest.approx(want[s]) for d, _ in v)
        rates = brute.tilted_rates([n for _, n in v], want[s])
        assert [got[d].rate for d, n in v if n] == pytest.approx([r for r, (_, n) in zip(rates, v, strict=True) if n], rel=1e-3)
        assert all(got[d].copies == 1 for d, n in v if not n)
        assert gap_is_closed([(n, got[d].copies) for d, n in v], want[s])


def test_targets_are_capped_and_shared_again():
    got = mixing.targets({"a": 10, "b": 100, "c": 100, None: 100})
    assert sum(got.values()) == pytest.approx(465) and got["a"] == 20
    assert got[None] == 200 and got["b"] == pytest.approx(245 * 2 / 3) and got["c"] == pytest.approx(245 / 3)


def test_ranks_within_a_cell(spark):
    df = spark.createDataFrame([(i, "one two three", "s") for i in range(500)] + [(1000, "a b c d", "t")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    taken = sum(r.taken for r in got if r.source == "s")
    assert abs(taken - next(r.target for r in got if r.source == "s")) <= 3


def test_components_of_long_chains(spark):
    rng, order = random.Random(3), list(range(3000))
    rng.shuffle(order)
    chain = list(zip(order, order[1:], strict=False))
    star = [(5000, 5001 + i) for i in range(50)] + [(6000 + i, 6100) for i in range(50)]
    df = spark.createDataFrame([(v, u) if rng.random() < 0.5 else (u, v) for u, v in chain] + star + star[:9] + [(7000, 7000)], "u long, v long")
    got = {r.node: r.comp for r in components(df).collect()}
    assert got == dict.fromkeys(order, 0) | dict.fromkeys(range(5000, 5051), 5000) | dict.fromkeys([*range(6000, 6050), 6100], 6000)
    assert components(df.limit(0)).count() == 0


def test_near_duplicates_of_a_version_history(spark):
    """Each version replaces the oldest words of the last, so it links with its neighbours only."""
    words = [f"w{i}" for i in range(60 + 4 * 600)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(600)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.component_id, r.kept) for r in got if r.doc_id} == {(0, False)} and len(got) == 600


def test_near_duplicates(spark, docs, nothing):
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    assert table(neardup.near_duplicates(docs), *columns) == sorted(brute.near_duplicates(PAIRS))
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_random_families(spark):
    rows, rng = [], random.Random(2)
    for f in range(12):
        seed = prose(rng.choice([6, 12, 40, 150]), 1000 + f)
        rows += [edited(seed, rng.randint(0, max(1, seed.count(" ") // 12)), 10 * f + j) for j in range(12)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(neardup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(rows))


def test_near_duplicates_in_crowded_lists(spark, monkeypatch):
    """Families around one long passage: sketches share most values, so whole sets decide."""
    monkeypatch.setattr(neardup, "MOST", 1)
    passage = prose(60, 77)
    rows = [passage + " " + prose(n, 3000 + 10 * n + i) for n in (2, 6, 10, 15, 25) for i in range(8)]
    rows += [edited(rows[i], 1, i) for i in (0, 9, 20, 33)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(neardup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(rows))


def test_near_duplicates_of_null_and_repeated_ids(spark, twisted):
    got = neardup.near_duplicates(twisted)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert (None, 86, 5, False) in found and (6, 86, 5, False) in found and (5, 86, 5, True) in found
    rows = common.keep_rows(twisted, got.where("kept"), once=True)
    assert rows.where("doc_id = 5").count() == 3 and rows.where("doc_id IS NULL").count() == 2


def test_texts_of_megabytes(spark):
    """One very long text beside short ones, for every operator that reads documents."""
    long = prose(500_000, 4242)
    rows = [(1, long, "a"), (2, "short text", "a"), (3, None, "b"), (4, long[: len(long) // 2] + " " + prose(300_000, 17), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    words = {d: len(brute.BLANK.findall(t or "")) for d, t, _ in rows}
    library = encoder(tokenizer_path()).library
    tokens = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t, _ in rows}
    assert {r.doc_id: r.n_tokens - 1 for r in token_ids.token_files(df, tokenizer_path()).collect()} == tokens
    assert {r.doc_id: r.tokens_before for r in token_counts.masked_counts(df, tokenizer_path()).collect()} == tokens
    items = spark.createDataFrame([("x", prose(20, 3)), ("y", " ".join(brute.ALNUM.findall(long)[-13:]))], "item_id string, text string")
    assert {r.doc_id: r.n_hit > 0 for r in decontam.decontaminate(df, items).collect()}[1]
    assert {r.doc_id: r.n_words for r in quality.quality_report(df).collect()} == words
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    assert removed[2] == removed[3] == 0 and abs(removed[1] - len(long.encode()) // 2) < 1000
    assert {r.doc_id: r["size"] for r in mixing.mix(df).collect()} == words
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_matches for r in licenses.scan(df).collect()} == dict.fromkeys(range(1, 5), 0)


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, "en", s, len(t or "")) for d, t, _, s in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = quality.quality_filter(docs)
    texts = {r.doc_id: r.text for r in kept.collect()}
    firsts = {r[0] for r in brute.near_duplicates(sorted(texts.items())) if r[3]}
    clean = {r[0] for r in brute.decontaminate([(d, texts[d]) for d in sorted(firsts)], BENCHMARK) if not r[5]}
    left = docs.where(F.col("doc_id").isin(sorted(clean)))
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for d in sorted(clean):
        n = len(library.encode(texts[d], add_special_tokens=False).ids) + 1
        for _ in range(copies[d]):
            want.append((d, start, n))
            start += n
    assert table(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "start", "n_tokens") == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
