"""Merkle manifests, exact top-k search and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm.merkle import FANOUT, fold, manifest_with_audit, path_digest
from seriesloom.llm.ordinals import with_ordinals
from seriesloom.llm.topk import nearest
from seriesloom.llm.variants import near_words, one_letter_apart, spelling_variants, word_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, at long, n string, path int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """Root, and the siblings (left, right) of each leaf by level."""
    paths, nodes, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for path, (i, j) in zip(paths, enumerate(own), strict=True):
            first = j // FANOUT * FANOUT
            path.append(("".join(nodes[first:j]), "".join(nodes[j + 1 : first + FANOUT])))
            own[i] = j // FANOUT
        nodes = [sha(*nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
    return nodes[0], paths


def plain_manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, proof digest) of rows in the order of ``DOCS``."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], sha(*[framed(x) for x in (r[0], r[3], r[2], r[4], r[1])])))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_tree([leaf for _, leaf in groups[lang]])
    root, up = plain_tree([trees[lang][0] for lang in langs])
    found = Counter()
    for lang, above in zip(langs, up, strict=True):
        for (i, leaf), path in zip(groups[lang], trees[lang][1], strict=True):
            proof = sha("".join(a + b for a, b in path + above))
            found[i, leaf, trees[lang][0], root, proof] += 1
    return found


def documents(rng, sizes):
    rows, number = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            number += rng.randint(1, 5)
            rows.append((number, "Ab ß" * rng.randint(0, 3), lang, None, rng.randint(0, 9), 1, "x", 2))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("stride", [1, 2, 3])
@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "fr": 9, None: 1}, {"en": 600, "de": 65, "fr": 64, "": 7}])
def test_manifest_equals_plain_trees(spark, stride, sizes):
    rows = documents(random.Random(len(sizes)), sizes)
    found = manifest_with_audit(spark.createDataFrame(rows, DOCS).repartition(3), stride=stride)
    found = found.withColumn("proof", path_digest(F.col("path"))).withColumn("again", fold(F.col("leaf"), F.col("path")))
    got = found.collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got) == plain_manifest(rows)
    assert all(r.again == r.root and r.audited == r.leaf for r in got)


def test_manifest_of_awkward_rows(spark):
    long = "Ä word " * 60_000
    rows = [
        (1, "Text", "en", "a", 4, 0, "n", 0), (1, "Text", "en", "a", 4, 1, "n", 0), (1, "Other", "en", "a", 4, 1, "n", 0),
        (None, "Text", "en", None, None, 0, None, 0), (2, None, None, None, None, 0, None, 0), (3, "", "", "", 0, 0, "", 0),
        (4, long, "en", "a", len(long), 0, "n", 0),
    ]
    df = spark.createDataFrame(rows, DOCS)
    changed = F.when(F.col("doc_id") == 4, F.lower("text"))
    got = manifest_with_audit(df, changed).withColumn("again", fold(F.col("audited"), F.col("path"))).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert [r.doc_id for r in got if r.again != r.root] == [4]
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root) for r in got) == Counter(
        {k[:4]: 0 for k in plain_manifest(rows)} | Counter(k[:4] for k in plain_manifest(rows).elements())
    )
    assert manifest_with_audit(df.limit(0)).count() == 0


def test_ordinals_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(None if i % 7 == 0 else "a" if i % 3 else "b", rng.randint(0, 500)) for i in range(2000)]
    got = with_ordinals(spark.createDataFrame(rows, "g string, x int").repartition(5), "g", ["x"]).collect()
    for group in (None, "a", "b"):
        mine = sorted((r["at"], r["x"], r["n"]) for r in got if r["g"] == group)
        assert [m[0] for m in mine] == list(range(len(mine))) and {m[2] for m in mine} == {len(mine)}
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)


VECTORS = "vec_id long, embedding array<double>, rank int, score string, place int"


def plain_nearest(rows, step, k):
    """List of (query_id, rank, vec_id, score)."""
    usable = []
    for r in rows:
        if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]):
            usable.append((r[0], [int(np.floor(1024 * x)) for x in r[1]]))
    found = []
    for q, e in usable:
        if q % step == 0:
            scored = [(-sum(x * y for x, y in zip(e, f, strict=True)), i) for i, f in usable if i != q and len(f) == len(e)]
            found += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return Counter(found)


def found_nearest(df, step, k, **more):
    return Counter(tuple(r) for r in nearest(df, F.col("vec_id") % step == 0, k, **more).collect())


@pytest.mark.parametrize("bins", [4, 4096])
def test_nearest_equals_brute_force(spark, bins):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 6).tolist(), 1, "s", 0) for i in range(400)]
    # Two hundred copies of one vector, spread over ids and tasks, tie with one another and the query.
    rows += [(1000 - 3 * i, [0.5, 0.25, 0.0, -0.5, 0.0, 0.125], 1, "s", 0) for i in range(200)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert found_nearest(df, 25, 7, block_queries=9, bins=bins, cells=300) == plain_nearest(rows, 25, 7)


def test_nearest_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, None]), (3, None), (4, [nan, 1.0]),
        (5, [inf, 1.0]), (None, [9.0, 9.0]), (10, [1.0, 2.0, 3.0]), (11, []), (20, []), (-10, [1e-5, -1e-5]), (2**62, [0.1, 0.1]),
        (-(2**62), [0.1, 0.1]), (30, [5.0]),
    ]
    rows = [(*r, 1, "s", 0) for r in rows]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    for k in (1, 2, 50):
        assert found_nearest(df, 10, k) == plain_nearest(rows, 10, k)
    assert nearest(df.limit(0), F.lit(True), 3).count() == 0
    assert nearest(df, F.lit(False), 3).count() == 0
    assert nearest(df.where("embedding IS NULL"), F.lit(True), 3).count() == 0


def test_nearest_of_long_vectors(spark):
    """Scores beyond the exact doubles are summed as integers; beyond 64 bits is an error."""
    rows = [(i, [2.0**18 + i, 2.0**18 + 3 * i, 1.0 / 1024], 1, "s", 0) for i in range(20)]
    assert found_nearest(spark.createDataFrame(rows, VECTORS), 5, 4) == plain_nearest(rows, 5, 4)
    with pytest.raises(ValueError):
        nearest(spark.createDataFrame([(0, [1e30], 1, "s", 0)], VECTORS), F.lit(True), 1)


RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWERED = {i: i + 32 for i in range(65, 91)}


def plain_words(rows, every=97, shortest=5, least=3):
    counts = Counter()
    for i, text in rows:
        for word in RUN.findall((text or "").translate(LOWERED)):
            h = zlib.crc32(f"{i}:{word}".encode())
            if i is not None and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def near(a, b):
    return one_letter_apart(a, b) or one_letter_apart(b, a)


def plain_variants(words):
    found = {}
    by = {w: [o for o in words if near(w, o)] for w in words}
    for w, others in by.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        found[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while found[root] is not None:
            root = found[root]
        out.add((w, n, len(by[w]), found[w], words.get(found[w]), root))
    return out


def letters(rng, size):
    return "".join(rng.choice("abcqé÷ÿz") for _ in range(size))


def edited(rng, word):
    at, new = rng.randrange(len(word)), rng.choice("abcqé")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + new + word[at:], word[:at] + new + word[at + 1 :]])


def test_one_letter_apart():
    assert one_letter_apart("abc", "abcd") and one_letter_apart("abc", "xabc") and one_letter_apart("abc", "axc")
    assert not any(one_letter_apart(*p) for p in (("abc", "abc"), ("abcd", "abc"), ("abc", "acb"), ("abc", "abcde"), ("abc", "bcdx")))


@pytest.mark.parametrize("subtrie", [3, 40, 1 << 15])
def test_near_words_equal_all_pairs(spark, subtrie):
    rng = random.Random(8)
    words = {letters(rng, rng.randint(5, 9)) for _ in range(60)}
    words |= {edited(rng, w) for w in list(words) for _ in range(3)}
    words |= {"".join(rng.sample("abcdefgh", 8)) for _ in range(60)}  # one vector
    words |= {"q" * 40 + letters(rng, 3) for _ in range(12)} | {"z" * 31, "z" * 32, "z" * 33, "z" * 34}
    table = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long").repartition(4)
    got = [(r.word, r.other) for r in near_words(table, subtrie).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_variants_equal_brute_force(spark):
    rng = random.Random(2)
    stock = [letters(rng, rng.randint(4, 9)) for _ in range(30)]
    stock += [edited(rng, rng.choice(stock)) for _ in range(120)]
    weights = [1 / (1 + i % 40) for i in range(len(stock))]
    rows = [(i, " ".join(rng.choices(stock, weights, k=60)).upper().replace("É", "é") + "3x") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words = plain_words(rows)
    assert {(r.word, r.n) for r in word_counts(df).collect()} == set(words.items())
    got = spelling_variants(df).collect()
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == plain_variants(words)
    assert len(got) == len(words)


def test_variants_of_awkward_rows(spark):
    long = "w" * 300 + "ö" * 5000
    rows = [
        (1, "House house HOUSE hause hause hause"), (1, "House house HOUSE hause hause hause"), (None, "house mouse mouse mouse"),
        (2, None), (3, ""), (4, "1234 _ \n"), (5, f"{long} {long} {long}x {long}x {long}x {long}"), (-6, "éÀÿ×÷é éÀÿ×÷é éÀÿ×÷é ŁéÀÿ×÷ł"),
    ]
    schema = "doc_id long, text string, word string, n int, form string, key int, piece int"
    df = spark.createDataFrame([(*r, "w", 1, "f", 1, 1) for r in rows], schema).repartition(3)
    words = plain_words(rows)
    assert {(r.word, r.n) for r in word_counts(df).collect()} == set(words.items())
    got = spelling_variants(df).collect()
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == plain_variants(words)
    assert {(r.word, r.n) for r in word_counts(df, slip_every=1, least=1).collect()} == set(plain_words(rows, 1, 5, 1).items())
    assert spelling_variants(df.limit(0)).count() == 0
    assert spelling_variants(df.where("doc_id = 4")).count() == 0
