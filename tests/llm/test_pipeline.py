"""Every stage of the corpus pipeline on awkward rows, against plain loops."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from seriesloom.llm.pairwise_quality import score_quality
from seriesloom.session import materialise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, mix_slot long, shard int, slot string"


def prose(rng, n, alphabet="abcdefghij"):
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def junk(rng, n):
    return " ".join("".join(rng.choice("#*$%|<>AB") for _ in range(rng.randint(1, 9))) for _ in range(n))


def words(text):
    return WORD.findall((text or "").lower())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    item = prose(rng, 30)
    good = [(i, prose(rng, rng.randint(40, 160))) for i in range(1, 61)]
    rows = good + [(i, junk(rng, rng.randint(20, 90))) for i in range(61, 101)]
    base = good[0][1].split()
    near = " ".join(["other", *base[1:]])
    rows += [(101, good[0][1]), (102, near), (103, near), (104, near), (105, f"{prose(rng, 40)} {item} {prose(rng, 40)}")]
    rows += [(106, None), (107, None), (108, ""), (109, ""), (110, "one two"), (None, prose(rng, 60)), (2, good[1][1])]
    rows += [(111, prose(rng, 30_000)), (112, f"{prose(rng, 3000)} {' '.join(item.split()[:13])} {prose(rng, 3000)}")]
    table = [(i, t, "en" if (i or 0) % 3 else None, "hot" if (i or 0) % 3 else f"s{(i or 0) % 7}", len(t or ""), 1, 0.5, 9, 7, "s") for i, t in rows]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(1, 61)] + [(i, 0, 0) for i in range(61, 101)] + [(5, 0, 0), (None, 1, 0), (70, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", item), ("b2", None), ("b3", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(name, input rows, output rows, output columns) of each stage."""
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, folder))
        found[name] = (docs.collect(), out.collect(), out.columns)
        docs = out
    return found


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_all_stages_but_the_last_keep_the_columns(stages):
    names = list(stages)
    assert names == ["quality classifier", "near duplicates", "decontamination", "mixing", "sharding"]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]  # some of them are results of later stages
    assert all(set(columns) <= set(stages[n][2]) for n in names[:4])
    for name in names:
        before, after, _ = stages[name]
        texts = Counter((r.doc_id, r.text) for r in before)
        assert not Counter((r.doc_id, r.text) for r in after) - texts


def test_quality_stage_keeps_what_scores_well(spark, folder, stages):
    before, after, _ = stages["quality classifier"]
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, labels).collect()
    assert ids(after) == Counter(r.doc_id for r in scored if r.predicted == 1)
    kept = {r.doc_id for r in after}
    assert len(set(range(1, 61)) & kept) >= 54 and len(kept & set(range(61, 101))) <= 4


def test_near_duplicate_stage_keeps_one_of_each_class(stages):
    before, after, _ = stages["near duplicates"]
    rows = [r for r in before if r.text is not None]
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([r.text]))
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    classes = {}
    for r, p in zip(rows, part, strict=True):
        classes.setdefault(p, []).append(r.doc_id)
    want = Counter(min(c, key=lambda i: (i is None, i)) for c in classes.values())
    want += Counter(r.doc_id for r in before if r.text is None)
    assert ids(after) == want


def test_decontamination_stage_follows_the_rule(spark, folder, stages):
    before, after, _ = stages["decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items if w for i in range(max(1, len(w) - 12))}

    def hit(text):
        w, marked = words(text), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    marked |= set(range(i, i + n))
        return len(marked) > 0 and 20 * len(marked) >= len(w)

    assert ids(after) == Counter(r.doc_id for r in before if not hit(r.text))
    dropped = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert dropped == {105} and 112 in ids(after)


def test_mixing_and_sharding_keep_every_document(stages):
    for name in ("mixing", "sharding"):
        before, after, _ = stages[name]
        assert ids(after) == ids(before)
    after = stages["sharding"][1]
    sizes = Counter(r.shard for r in after)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in after if r.shard == shard) == list(range(size))


def test_an_empty_table_passes_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
