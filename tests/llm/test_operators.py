"""Each operator against brute force on small tables, and on awkward rows."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm.decontaminate import contamination, find_benchmark_spans, remove_contaminated
from seriesloom.llm.graph import connected_components
from seriesloom.llm.html import extract_main_text
from seriesloom.llm.language import detect_languages
from seriesloom.llm.minhash import dart_signature, keep_first_of_class, near_duplicates
from seriesloom.llm.mixing import documents_in_mix, integer_shares, mix_sources, period_schedule
from seriesloom.llm.pairwise_quality import score_quality
from seriesloom.llm import passages
from seriesloom.llm.passages import (
    _linked, _matches_of_common, _packed_matches, chains, remove_repeated_passages, shared_passages, wording_classes,
)
from seriesloom.llm.quality_rules import weak_quality
from seriesloom.llm.sharding import shard_documents, shard_rows
from seriesloom.llm.tool_calls import format_chat

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, node string, slot int, score string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty, word-free, very long, repeated and tied rows, and columns with taken names."""
    rng = random.Random(5)
    long, base = prose(rng, 40_000), prose(rng, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", None, None),
        (4, None, "en", "a"), (5, "", "fr", "b"), (6, "", None, "b"), (7, "!!! ???", "fr", None), (8, long, "en", "a"),
        (None, "short text", None, "a"), (9, "short text", "en", "null"), (10, "ÀÉ ßü", "fr", "b"), (11, prose(rng, 60), "en", "b"),
    ]
    return spark.createDataFrame([(*r, "n", 1, "s") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df):
    return Counter(r.doc_id for r in df.collect())


def test_signature_agrees_as_often_as_the_weighted_sets_do():
    rng = np.random.default_rng(3)
    gaps = []
    for _ in range(80):
        n = int(rng.integers(5, 400))
        u, v = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        same = int(n * 0.8)
        v[:same] = u[:same]
        a, b = rng.uniform(0.2, 3, n), rng.uniform(0.2, 3, n)
        want = np.minimum(a, b)[:same].sum() / (np.maximum(a, b)[:same].sum() + a[same:].sum() + b[same:].sum())
        gaps.append((dart_signature(u, a, 120) == dart_signature(v, b, 120)).mean() - want)
    assert abs(np.mean(gaps)) < 0.015


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(6, 150)).split()
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]))
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both >= 0.8 * sum((sets[i] | sets[j]).values()):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == dict(enumerate(part))


def test_near_duplicates_of_awkward_rows(awkward, empty):
    got = near_duplicates(awkward).collect()
    assert Counter(r.doc_id for r in got) == counted(awkward)
    of = {r.doc_id: r.class_id for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[4] == 4 and of[5] == of[6] == 5 and of[None] == of[9] == 9
    kept = keep_first_of_class(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7, 8, 9, 10, 11]
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_decontamination_in_blocks_equals_one_block(spark, awkward, empty):
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 14, 5, 13))] + [(9, None), (None, prose(rng, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, prose(rng, 20) + " " + (t or "") + " " + prose(rng, 40 * i)) for i, (_, t) in enumerate(items)]
    docs += [(90, None), (91, ""), (92, items[2][1].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in contamination(find_benchmark_spans(df, bench)).collect()}
    split = {r.doc_id: r for r in contamination(find_benchmark_spans(df, bench, block_windows=7)).collect()}
    assert got == split
    for d, t in docs:
        w, hit, found = WORD.findall((t or "").lower()), set(), set()
        for item, text in items:
            b = WORD.findall((text or "").lower())
            n = min(13, len(b))
            known = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in known]
            hit.update(j for i in at for j in range(i, i + n))
            if at and item is not None:
                found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bad = bool(hit) and 20 * len(hit) >= len(w)
        assert tuple(got[d]) == (d, len(w), len(hit), len(found), digest, bad)
    assert counted(contamination(find_benchmark_spans(awkward, bench))) == counted(awkward)
    assert contamination(find_benchmark_spans(empty, bench)).count() == 0
    assert remove_contaminated(df, bench.limit(0)).count() == len(docs)
    cut = {r.doc_id: r.text for r in remove_contaminated(df, bench, mode="spans").collect()}
    assert cut[90] is None and cut[92].strip(" .") == "" and len(cut) == len(docs)


def test_mixing_stays_within_a_block_of_the_weights(spark, awkward, empty):
    weights = spark.createDataFrame([("+a", 5.0), ("+b", 2.2), ("+c", 0.3), ("-", 1.0)], "source_key string, weight double")
    plan = period_schedule(integer_shares(weights, 60), 60).toPandas()
    assert sorted(plan.slot) == list(range(60))
    assert ((plan.slot >= plan.release) & (plan.slot < plan.deadline)).all()
    for _, own in plan.groupby("source_key"):
        share = own.share.iloc[0] / 60
        assert all(abs((own.slot < t).sum() - share * t) < 1 for t in range(61))
    got = mix_sources(awkward).toPandas()
    assert Counter(got.doc_id.dropna()) == Counter({k: v for k, v in counted(awkward).items() if k})
    assert len(got) == 13 and list(got.columns[: len(awkward.columns)]) == awkward.columns
    assert mix_sources(empty).count() == 0
    with pytest.raises(ValueError):
        mix_sources(awkward, period=3)


def test_a_used_up_source_leaves_the_mix(spark):
    sizes = {"hot": 900, "b": 200, "c": 120, "tiny": 3}
    df = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "doc_id string, source string")
    got = documents_in_mix(df).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in df.collect())
    slots = mix_sources(df).toPandas().groupby("source").mix_slot.unique().map(set)
    assert sorted(s for own in slots for s in own) == list(range(225 + 50 + 30 + 1))
    # "tiny" is gone after its block: the others stay at the square roots of their sizes until "b" or "c" is used up.
    total = sum(sizes[k] ** 0.5 for k in ("hot", "b", "c"))
    begin, stop = max(slots["tiny"]) + 1, min(max(slots["b"]), max(slots["c"]))
    for k in ("hot", "b", "c"):
        assert abs(sum(begin <= s < stop for s in slots[k]) - (stop - begin) * sizes[k] ** 0.5 / total) < 1.7


def test_mixing_does_not_drift_from_the_given_weights(spark):
    weights = {"hot": 1 / 3} | {f"s{i}": 2 / 60 for i in range(20)} | {"rare": 0.00001}
    rows = [(f"{k}{i}", k) for k, w in weights.items() for i in range(round(12_000 * w) + 1)]
    df = spark.createDataFrame(rows, "doc_id string, source string")
    got = mix_sources(df, weights=weights, block_rows=1).toPandas().sort_values("mix_slot")
    assert list(got.mix_slot) == list(range(len(rows)))
    got = got[got.in_mix]
    assert len(got) > 11_000
    for k, w in weights.items():
        share = w / sum(weights.values()) * np.arange(1, len(got) + 1)
        assert np.abs((got.source == k).cumsum() - share).max() < 1.7


def test_shards_are_even_and_keep_equal_texts(spark, awkward, empty):
    df = spark.range(400).select("id", F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 150, "hot").otherwise(F.floor(F.col("id") / 3).cast("string"))).alias("text"))
    got = shard_rows(df, shards=7).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and sizes["count"].sum() == 400
    assert (sizes["min"] == 0).all() and (sizes["nunique"] == sizes["count"]).all() and (sizes["max"] + 1 == sizes["count"]).all()
    small = got[got.doc_id >= 150].groupby("node").shard.nunique()
    assert (small > 1).sum() <= 7
    out = shard_documents(awkward, shards=4)
    assert out.columns == [c for c in awkward.columns if c != "slot"] + ["shard", "slot"]
    assert counted(out) == counted(awkward)
    assert shard_rows(empty).count() == 0


def test_languages(spark, awkward, empty):
    rng = random.Random(4)
    letters = {"x": "abcde", "y": "vwxyzé"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(30)), k) for i, k in enumerate("xy" * 20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    half = rows[0][1] + " " + rows[1][1]
    ask = spark.createDataFrame([(1, rows[2][1]), (2, rows[3][1]), (3, half), (4, None), (5, "12 – 34")], "doc_id long, text string")
    got = {r.doc_id: r for r in detect_languages(ask, train).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[4].lang_pred, got[5].lang_pred) == ("x", "y", "und", "und")
    assert set(got[3].langs) == {"x", "y"} and 0.4 < got[3].score < 0.6 and got[1].langs == ["x"]
    assert counted(detect_languages(awkward, awkward)) == counted(awkward)
    assert detect_languages(empty, train).count() == 0
    assert {r.lang_pred for r in detect_languages(ask, empty).collect()} == {"und"}


def test_a_text_of_four_languages(spark):
    rng = random.Random(9)
    letters = {"q": "abcdef", "r": "ghijkl", "s": "mnopqr", "t": "stuvwx"}

    def words(k, n):
        return " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(n))

    train = spark.createDataFrame([(i, words(k, 60), k) for i, k in enumerate("qrst" * 10)], "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(1, " ".join(words(k, n) for k, n in zip("qrst", (40, 30, 20, 10)))), (2, words("q", 50))], "doc_id long, text string")
    got = {r.doc_id: r for r in detect_languages(ask, train).collect()}
    assert got[1].langs == ["q", "r", "s", "t"] and np.allclose(got[1].shares, [0.4, 0.3, 0.2, 0.1], atol=0.03)
    assert got[2].langs == ["q"]


def test_quality_rules_count_as_plain_loops_do(spark, awkward, empty):
    rng = random.Random(6)
    line = prose(rng, 8)
    texts = [prose(rng, 80), "\n".join([line] * 3 + [prose(rng, 30)]), "# $ % a\x0bb\tc " * 30, "É" * 9 + " x", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in weak_quality(df).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(win)
        inside = {j for i, x in enumerate(win) if often[x] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert counted(weak_quality(awkward)) == counted(awkward)
    assert weak_quality(empty).count() == 0


def test_pairwise_quality_learns_an_order(spark, awkward, empty):
    rng = random.Random(7)
    rows = [(i, prose(rng, 60) if i % 4 else " ".join(w + "###" for w in prose(rng, 60).split()), int(i % 4 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = score_quality(df.select("doc_id", "text"), df.select("doc_id", "quality")).join(df, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 60 and (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    labels = df.select("doc_id", "quality")
    assert counted(score_quality(awkward, labels)) == counted(awkward)
    assert set(r.score for r in score_quality(awkward, labels.limit(0)).collect()) == {0.5}
    assert score_quality(empty, labels).count() == 0


def test_passages(spark, awkward, empty):
    rng = random.Random(8)
    passage = prose(rng, 70).rstrip(".").split()
    changed = list(passage)
    changed[20], changed[45] = "zzz", "zzzz"
    rows = [
        (1, prose(rng, 90) + " " + " ".join(passage) + " " + prose(rng, 50)), (2, prose(rng, 30) + " " + " ".join(changed)),
        (3, prose(rng, 200)), (4, " ".join(passage[:30]) + " " + prose(rng, 100)), (5, None), (6, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (r,) = shared_passages(df).collect()
    assert (r.doc_id, r.other_id, r.kind) == (2, 1, "passage")
    assert abs(r.start_word - 30) <= 3 and abs(r.n_words - 70) <= 6 and abs(r.other_start - 90) <= 3 and r.identity > 0.9
    left = {x.doc_id: x.text for x in remove_repeated_passages(df).collect()}
    assert len(left[2].split()) < 45 and left[1] == rows[0][1] and left[5] is None
    kinds = {(x.doc_id, x.other_id, x.kind) for x in shared_passages(awkward).collect()}
    assert kinds == {(2, 1, "copy"), (3, 1, "passage")}
    assert shared_passages(empty).count() == 0


def test_passages_with_many_changed_words(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        words = prose(rng, 60).rstrip(".").split()
        changed = list(words)
        for j in rng.sample(range(2, 58), (3, 6, 9)[i % 3]):  # identity 0.95, 0.9, 0.85
            changed[j] = f"zz{j}"
        rows += [(2 * i, " ".join([prose(rng, 40), *words, prose(rng, 40)])), (2 * i + 1, " ".join([prose(rng, 30), *changed, prose(rng, 30)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shared_passages(df).collect()
    assert all(r.doc_id == r.other_id + 1 and r.other_id % 2 == 0 for r in got) and len(got) == len({r.doc_id for r in got})
    by = Counter(r.other_id // 2 % 3 for r in got)
    # What is missed has changes so near its ends that fewer than 50 words are left between them.
    assert by[0] == 40 and by[1] >= 39 and by[2] >= 34


def test_all_pairs_of_a_passage_are_linked(spark):
    rng = random.Random(16)
    passage = prose(rng, 70).rstrip(".")
    rows = [(i, " ".join([prose(rng, 40), passage, prose(rng, 40)])) for i in range(8)]
    got = shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(j, i) for i in range(8) for j in range(i + 1, 8)}


def test_passages_whose_every_seed_is_frequent(spark):
    rng = random.Random(14)
    parts = [prose(rng, 18).rstrip(".") for _ in range(3)]
    rows = [(i, " ".join([prose(rng, 40), *parts, prose(rng, 40)])) for i in range(3)]
    rows += [(3 + 50 * p + i, " ".join([prose(rng, 60), parts[p], prose(rng, 60)])) for p in range(3) for i in range(50)]
    got = shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(1, 0), (2, 0), (2, 1)}
    assert all(r.n_words >= 54 and r.kind == "passage" for r in got)


def test_texts_of_a_wording_class_agree_pairwise():
    rng = np.random.default_rng(15)
    wording = rng.integers(1, 60_000, 95).astype(np.uint16)
    around = np.stack([np.where(rng.random(95) < share, rng.integers(1, 60_000, 95), wording) for share in rng.uniform(0, 0.3, 80)])
    around = np.concatenate((around, rng.integers(1, 60_000, (40, 95)))).astype(np.uint16)
    classes = wording_classes(around, 50, 45)
    assert classes[:80].any(axis=1).sum() > 25 and not classes[80:].any()
    for members in classes.T:
        rows = around[members]
        most = [max(same[k : k + 50].sum() for k in range(46)) for a in rows for same in a == rows]
        assert min(most) >= 40
    # Every other pair that agrees well enough about the seed is found by itself.
    around[:, 45:50] = wording[45:50]
    table = pa.table({"node": np.arange(120), "place": np.full(120, 45, dtype=np.int32), "words": [r.tobytes() for r in around]})
    matches = _matches_of_common(table, 50, 0.8).to_pydict()
    found = set(zip(matches["x"], matches["y"], strict=True))
    classes = wording_classes(around, 50, 45)
    for i in range(120):
        for j in range(i + 1, 120):
            same = around[i] == around[j]
            if max(same[k : k + 50].sum() for k in range(46)) >= 40:
                assert (i, j) in found or (classes[i] & classes[j]).any()


def test_matches_of_runs_of_one_word_do_not_grow_with_their_square():
    rng = np.random.default_rng(17)
    around = rng.integers(2, 60_000, (300, 95)).astype(np.uint16)
    for i, row in enumerate(around):  # runs of 20 to 95 words about the seed
        size = 20 + i % 76
        begin = max(0, min(45, 95 - size) - int(rng.integers(0, min(size - 4, 45))))
        row[begin : begin + size] = 1
        row[45:50] = 1
    table = pa.table({"node": np.arange(300), "place": np.full(300, 145, dtype=np.int32), "words": [r.tobytes() for r in around]})
    matches = _matches_of_common(table, 50, 0.8).to_pydict()
    long = {i for i in range(300) if max(np.convolve(around[i] == 1, np.ones(50), "valid")) >= 45}
    assert len(long) > 100 and long <= {*matches["x"], *matches["y"]}
    assert sum(len(m) // 2 for m in matches["m"]) < 3 * 300


def test_links_of_near_copies_do_not_grow_with_their_square():
    rng = np.random.default_rng(20)
    wording, rows = rng.integers(2, 60_000, 95).astype(np.uint16), []
    for i in range(400):
        row = np.where(rng.random(95) < 0.05, rng.integers(2, 60_000, 95), wording).astype(np.uint16)
        if i % 4 == 0:  # a word put in, or left out, on one side of the seed
            cut = int(rng.integers(30, 44))
            row[: cut - 1] = row[1:cut]
        if i % 4 == 1:
            cut = int(rng.integers(51, 65))
            row[cut + 1 :] = row[cut:-1].copy()
        row[45:50] = wording[45:50]
        rows.append(row.tobytes())
    table = pa.table({"node": np.arange(400), "place": np.full(400, 145, dtype=np.int32), "words": rows})
    matches = _matches_of_common(table, 50, 0.8).to_pydict()
    assert sum(len(m) // 2 for m in matches["m"]) < 16 * 400
    group = list(range(400))
    for x, y in zip(matches["x"], matches["y"], strict=True):
        a, b = group[x], group[y]
        group = [a if g == b else g for g in group]
    assert len(set(group)) == 1


def test_chains_keep_the_ends_of_runs_of_matches():
    places = [(a, a + 7) for a in range(0, 60, 3)] + [(a, a + 9) for a in range(90, 120, 5)] + [(130, 160)]
    x, y, (a, b) = np.zeros(len(places), dtype=np.int64), np.ones(len(places), dtype=np.int64), np.array(places).T
    (chain,) = _linked(_packed_matches(x, y, a, b, 1), 5).column("chain").to_pylist()
    assert chain == [0, 7, 57, 64, 90, 99, 115, 124, 130, 160]


def test_texts_with_runs_of_one_word_are_linked(spark):
    rng = random.Random(18)
    rows = [(i, " ".join([prose(rng, 20 + i), *["zz"] * (60 + i % 30), prose(rng, 40)])) for i in range(60)]
    got = shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == set(range(60))
    assert len(got) < 60 * 59 // 4 and all(r.n_words >= 50 and r.identity >= 0.8 for r in got)


def test_seeds_without_a_passage_are_left_before_texts_are_read_again(spark, monkeypatch):
    rng = random.Random(19)
    rows = []
    for i in range(40):
        common = prose(rng, 7).rstrip(".")
        rows += [(2 * i + j, " ".join([prose(rng, 60), common, prose(rng, 60)])) for j in range(2)]
    stored = []

    def kept(df, materialise=passages.materialise):
        stored.append(materialise(df))
        return stored[-1]

    monkeypatch.setattr(passages, "materialise", kept)
    assert shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    (chained,) = (df for df in stored if "chain" in df.columns)
    assert chained.count() < 20


def test_only_the_smallest_id_keeps_a_passage(spark):
    rng = random.Random(13)
    passage = prose(rng, 70).rstrip(".")
    rows = [(i, " ".join([prose(rng, 40), passage, prose(rng, 40)])) for i in range(30)]
    left = {r.doc_id: r.text for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[0] == rows[0][1]
    assert all(75 <= len(left[i].split()) <= 85 for i in range(1, 30))


def test_only_the_smallest_id_of_many_near_copies_keeps_a_passage(spark):
    rng = random.Random(5)
    ids, passage, rows = rng.sample(range(120), 120), prose(rng, 80).rstrip(".").split(), []
    for i in range(120):
        words = [f"q{i}x{j}" if rng.random() < 0.05 else w for j, w in enumerate(passage)]
        if i % 3 == 0:
            words.insert(rng.randrange(20, 60), f"more{i}")
        if i % 3 == 1:
            del words[rng.randrange(20, 60)]
        rows.append((ids[i], " ".join([prose(rng, 40), *words, prose(rng, 40)])))
    left = {r.doc_id: r.text for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[0] == dict(rows)[0] and all(len(left[i].split()) < 110 for i in range(1, 120))


def test_chains_respect_order_and_gaps():
    line = [(i, i + 100) for i in range(0, 80, 8)]
    noise = [(40, 5), (41, 900)]
    found = chains(line + noise, 8, 0.2, 40)
    assert found[0] == line and all(len(c) > 1 for c in found)
    assert chains([(0, 0), (300, 300)], 8, 0.0, 40) == []


def test_html(spark):
    page = (
        "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=x>m</a></nav>"
        "<div class='site-header'>logo</div><div class='post-12'><h1>Head &amp; more</h1><p>One  <b>two<br>three<p>Four</p>"
        "<div class=share-box>share</div><ul><li>a<li>b</ul></div><div id=comments><p>{}</p></div><footer>f</footer></body></html>"
    )
    rows = [(i, f"http://h.example/{i}", page.format("long reader comment " * 5)) for i in range(4)]
    rows += [(8, None, None), (9, "x", ""), (10, "http://h.example/z", "plain &lt; text")]
    got = {r.page_id: r for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "Head & more\nOne two three\nFour\na\nb" and got[0].n_chars == len(got[0].text)
    assert got[8].text == "" and got[9].text == "" and got[10].text == "plain < text" and len(got) == 7
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat(spark):
    def call(i, ref=None, **arguments):
        if ref:
            arguments["after"] = {"$ref": ref}
        return "<tool_call>" + json.dumps({"id": i, "name": "f", "arguments": arguments}) + "</tool_call>"

    def result(i, content):
        return json.dumps({"tool_call_id": i, "content": content})

    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", "ok " + call("late", ref="base", n=1) + call("base", n=2.0)),
        (1, 2, "tool", result("base", {"b": 1, "a": [1.0]})), (1, 3, "tool", result("late", 5)), (1, 4, "tool", result("late", 6)),
        (1, 5, "tool", "no json"), (1, 6, "assistant", call("p", ref="q", n=1) + call("q", ref="p", n=1) + call("bad", n="x") + call("base", n=1)),
        (None, None, None, None), (2, 0, "assistant", "<tool_call>{broken</tool_call>"), (2, 0, "assistant", "<tool_call>{broken</tool_call>"),
    ]
    schemas = {"f": {"type": "object", "required": ["n"], "properties": {"n": {"type": ["integer", "number"], "maximum": 9}}}}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_chat(df, schemas).orderBy("conv_id", "position").collect()
    for r in got:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    one = [(r.kind, r.status, json.loads(r.json).get("id")) for r in got if r.conv_id == 1]
    assert one[:4] == [("message", "ok", None), ("message", "ok", None), ("call", "ok", "base"), ("call", "ok", "late")]
    assert Counter(s for _, s, _ in one) == Counter(ok=4, extra=1, orphan=1, cycle=2, invalid=2)
    assert [r.position for r in got if r.conv_id == 1] == list(range(10))
    assert [(r.kind, r.status) for r in got if r.conv_id == 2] == [("call", "invalid")]
    assert [r.json for r in got if r.conv_id is None] == ['{"role":null,"text":null}']
    assert format_chat(df.limit(0), schemas).count() == 0
