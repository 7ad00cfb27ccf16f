import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import components, darts, debruijn, vectors

DOCS = "doc_id long, text string"


class Forest(dict):
    def top(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        p, q = self.top(a), self.top(b)
        self[max(p, q)] = min(p, q)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1080)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 3), (1, 0), (1, 0)]
    want = Forest()
    for a, b in links:
        if a is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
            want.join(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want.top(x) for x in want}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold=0.93):
    good = [(n, i, np.array(e, float), label) for n, (i, e, label) in enumerate(rows) if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, roots = Counter(), Forest({i: i for i, _, _ in rows if i is not None})
    for x, (n, i, a, la) in enumerate(good):
        for m, j, b, lb in good[:x]:
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[n] += 1
                links[m] += 1
                roots.join(i, j)
    return [(i, links[n], None if i is None else roots.top(i)) for n, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("block_rows", [3, 1500])
def test_vectors_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] + rng.standard_normal(8) * (0.1 + 0.1 * (k % 3))], k % 2 if k % 7 else None) for k in range(80)]
    rows += [(100 + k, rows[1][1], rows[1][2]) for k in range(5)] + [(7, None, 1), (200, [], 1), (201, [0.0] * 8, 1), (202, [float("nan")] + [1.0] * 7, 1), (203, [None] + [1.0] * 7, 1), (204, [1.0, 2.0], 1), (None, rows[1][1], 1), (205, [float("inf")] * 8, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, e string, rep int")
    got = vectors.link_vectors(df, block_rows=block_rows).collect()
    want = [r for r in brute_vectors(rows) if r[0] != 7] + [(7, 0, 7)]
    got_ = [(r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] != 7] + [(7, 0, 7)]
    assert sorted(map(repr, got_)) == sorted(map(repr, want[: len(got_) - 1] + [(7, 0, 7)]))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_vectors_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    e = np.array([r[1] for r in rows], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    want = (np.triu(e @ e.T >= 0.93, 1) & (label[:, None] == label[None, :])).sum()
    got = sum(r["n_links"] for r in vectors.link_vectors(df).collect()) // 2
    assert 0.9 * want <= got <= want
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_vectors_recall_near_the_threshold(spark):
    """Pairs planted at cosines from 0.92 to 0.95, in one label that is hashed."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((3000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal((3000, 48))
    other -= (other * a).sum(axis=1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.92, 0.95, (3000, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * other
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(np.concatenate([a, b]))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    e = np.array([r[1] for r in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    linked = [k for k in range(3000) if e[k] @ e[k + 3000] >= 0.93]
    found = sum(got[k] == (1, k) and got[k + 3000] == (1, k) for k in linked)
    assert 1500 < len(linked) < 2500 and found >= 0.995 * len(linked)
    assert all(got[k] == (0, k) and got[k + 3000] == (0, k + 3000) for k in set(range(3000)) - set(linked))


def test_vectors_with_one_label_of_most_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((900, 16))
    rows = [(k, [float(x) for x in centres[k % 900] + rng.standard_normal(16) * 0.2], 0 if k < 5_700 else k) for k in range(5_700)]
    rows += [(10_000 + k, [float(x) for x in centres[k // 4] + rng.standard_normal(16) * 0.2], 1 + k // 4) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    reps = df.select("label", F.size("embedding").alias("dims"))
    shapes = {r["label"]: (r["bits"], r["tables"]) for r in vectors.label_shapes(reps, 0.93, 200, 2e-4).collect()}
    assert list(shapes) == [0] and shapes[0][0] == 5  # bits by the rows of the label, not by the mean of 80 a label
    e = np.array([r[1] for r in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (e @ e.T >= 0.93) & (label[:, None] == label[None, :])
    want = dict(zip((r[0] for r in rows), near.sum(axis=1) - 1, strict=True))
    got = {r["vec_id"]: r["n_links"] for r in vectors.link_vectors(df).collect()}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.99 * sum(want.values()) > 1000
    assert all(got[k] == want[k] for k in want if k >= 10_000)  # small labels are compared whole


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def brute_classes(rows, similarity=0.8):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    roots = Forest({i: i for i, _ in sets})
    where = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s or [()]:
            where[x].add(n)
    for a, b in {(a, b) for ns in where.values() for a in ns for b in ns if a < b}:
        (i, x), (j, y) = sets[a], sets[b]
        both = sum((x & y).values())
        if x == y or both >= similarity * (sum(x.values()) + sum(y.values()) - both):
            roots.join(i, j)
    return {i: roots.top(i) for i in roots} | {None: None for i, _ in rows if i is None}


def near_rows():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(500)]
    rows = []
    for k in range(30):
        words = rng.choices(vocabulary, k=rng.choice([3, 30, 200]))
        rows.append((len(rows), " ".join(words)))
        for change in (0, 1, 2):
            copy = list(words)
            for _ in range(change):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), ("\n " if k % 2 else " ").join(copy)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "word"), (504, "word"), (3, rows[3][1]), (None, rows[0][1]), (505, "a a a a a a a a"), (506, "a a a a a a a a a a")]


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_near_duplicates_brute_force(spark, block_rows):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", sig int, fp int")
    done = darts.near_duplicates(df, block_rows=block_rows).collect()
    assert len(done) == len(rows)  # a row for a row, repeated and null ids as well
    assert {r["doc_id"]: r["class_id"] for r in done} == brute_classes(rows)


def test_near_duplicates_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in darts.near_duplicates(df).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in df.collect()])
    assert darts.near_duplicates(df.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for n in (1, 40, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], a[: n // 4], rng.integers(0, 2**63, n // 4).astype(np.uint64)]) if n > 1 else a
        sig = darts.signatures([a, b] * 8, 2000)
        assert abs((sig[0] == sig[1]).mean() - darts.weighted_jaccard(a, b)) < 0.05
        assert (sig[0] == sig[2]).all()


def brute_removed(rows, k=20):
    seen, out = set(), {}
    key = lambda r: (-(2**63) if r[0] is None else r[0], debruijn.fingerprint((r[1] or "").encode().split()))
    for i, t in sorted(set(rows), key=key):
        if (i, t) in out:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for at in range(len(w) - k + 1):
            run = tuple(w[at : at + k])
            if run in seen:
                gone[at : at + k] = [True] * k
            seen.add(run)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, t] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return [(i, *out[i, t]) for i, t in rows]


def removed(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", m int, path int")
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.dedup_substrings(df).collect()]


@pytest.mark.parametrize("repeated_ids", [False, True])
def test_substrings_brute_force(spark, repeated_ids):
    rng = random.Random(6)
    words = [f"w{rng.randrange(40)}" for _ in range(400)]
    passages = [words[a : a + rng.randrange(15, 90)] for a in range(0, 300, 30)]
    rows = [(n % 9 if repeated_ids else n, " ".join(rng.choice(passages) + [f"x{rng.randrange(3)}"] * rng.randrange(30) + rng.choice(passages))) for n in range(30)]
    rows += [(100, None), (101, ""), (102, "a b"), (103, "r " * 60), (None, rows[0][1])]
    rows += rows[3:5] if repeated_ids else []
    assert sorted(map(repr, removed(spark, rows))) == sorted(map(repr, brute_removed(rows)))


def test_substrings_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(removed(spark, rows)) == sorted(brute_removed(rows))
    assert debruijn.dedup_substrings(df.limit(0)).count() == 0


def test_substrings_of_clashing_hashes_are_told_apart_at_their_sources(spark):
    class Clashing(debruijn.WordHashes):
        """Under the first seed `left` and `right` have one hash."""

        def __missing__(self, word):
            return super().__missing__(b"left" if word == b"right" and self.seed == 0 else word)

    run = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(run + ["left"] + run[::-1])), (2, " ".join(run + ["right"] + run[::-1])), (3, " ".join(run[::-1] + ["left"] + run))]
    df = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in debruijn.dedup_substrings(df, hashes=lambda seed: Clashing(seed=seed)).collect()]
    assert sorted(got) == sorted(brute_removed(rows))
    with pytest.raises(RuntimeError, match="clashed"):
        debruijn.dedup_substrings(df, hashes=lambda seed: Clashing(seed=0), tries=2)


def test_substrings_many_null_ids_and_long_texts(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(300)]
    rows = [(None, " ".join([f"n{i}"] + passage[i : i + 80] + [f"n{i}"] * 25)) for i in range(40)]
    long = [f"u{rng.randrange(10**6)}" for _ in range(30_000)]
    rows += [(1, " ".join(long + passage + long[5_000:20_000])), (2, " ".join(long[100:29_000])), (3, "z " * 20_000)]
    assert sorted(map(repr, removed(spark, rows))) == sorted(map(repr, brute_removed(rows)))


def test_long_spans_cut_by_blocks_of_the_source(spark):
    rows = [(9, 0, 100 + a, n, 1, 0, 40 + a) for a, n in ((0, 16), (16, 16), (32, 1), (40, 3))] + [(9, 0, 500, 2, 1, 0, 63)]
    df = spark.createDataFrame(rows, "doc long, fp long, start long, n long, sdoc long, sfp long, sstart long")
    got = sorted((r["start"], r["n"], r["sstart"]) for r in debruijn.long_spans(df).collect())
    assert got == [(100, 22, 40), (122, 11, 62), (140, 3, 80), (500, 2, 63)]


def family(n, common, pair, own, seed=8):
    """n texts of one template, two and two alike in `pair` words more."""
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.getrandbits(40)}" for _ in range(k))
    head, tails = words(common), [words(pair) for _ in range(n // 2)]
    return [(k, f"{head} {tails[k // 2]} {words(own)}") for k in range(n)]


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / sum((x | y).values())


@pytest.mark.parametrize("block_rows", [60, 1000])
def test_near_duplicates_in_a_family_below_the_threshold(spark, block_rows):
    rows = family(240, 300, 10, 32)
    text = dict(rows)
    assert 0.81 < jaccard(text[0], text[1]) < 0.84 and 0.77 < jaccard(text[0], text[2]) < 0.79
    got = {r["doc_id"]: r["class_id"] for r in darts.near_duplicates(spark.createDataFrame(rows, DOCS), block_rows=block_rows).collect()}
    assert all(got[k] == got[k ^ 1] for k in text)  # no pair is torn


def test_near_duplicates_link_nothing_below_the_threshold(spark):
    rows = family(240, 302, 0, 39)
    assert 0.785 < jaccard(rows[0][1], rows[1][1]) < 0.8
    got = {r["doc_id"]: r["class_id"] for r in darts.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {k: k for k, _ in rows}


def copies_of_one(rng, n, first, words=150):
    """Copies of one text with a word changed each; any two are alike enough."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        w[rng.randrange(words)] = f"x{i}"
        rows.append((first + i, " ".join(w)))
    return rows


def test_large_family_is_compared_in_proportion_to_its_rows(spark):
    rng = random.Random(8)
    n, block_rows = 3_000, 50
    # some texts that are like a few members only hang on them, and some others like the base are in its buckets but not alike enough
    rows = copies_of_one(rng, n, 0)
    hung = []
    for i in range(10):
        w = rows[i][1].split()
        hung.append((n + i, " ".join(w[:16] + [f"y{i}_{k}" for k in range(8)] + w[24:])))
    apart = [(2 * n + i, " ".join(rows[i][1].split()[:80] + [f"z{i}_{k}" for k in range(70)])) for i in range(10)]
    docs = spark.createDataFrame([*rows, *hung, *apart], DOCS).repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in darts.near_duplicates(docs, block_rows=block_rows).collect()}
    sets = {i: Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in [*rows, *hung, *apart]}
    assert all(got[i] == 0 for i, _ in rows)
    for i, _ in [*hung, *apart]:
        like = any((sets[i] & sets[j]).total() / (sets[i] | sets[j]).total() >= 0.8 for j in range(n))
        assert (got[i] == 0) == like, i

    reps = darts.sketch(docs, 150, 5, "doc_id", "text")
    members = darts.bucket_members(reps, 25, 6)
    large = members.groupBy("band", "bucket").count().filter(F.col("count") > block_rows).drop("count")
    stars = darts.star_links(members.join(large, ["band", "bucket"]), docs, 3, 0.8, 5, block_rows, "doc_id", "text")
    trees = components.connected_components(stars).withColumnRenamed("node", "doc")
    placed = reps.join(trees, "doc", "left").select("doc", "text_key", "sig", F.coalesce("component", "doc").alias("tree"))
    assert placed.filter("doc < 3000 and tree <> 0").count() < n / 100
    dealt = darts.candidates(placed, darts.bucket_members(placed, 25, 6, "tree"), 6, 0.7, block_rows)
    # texts that go on to the exact check: a few a text, not one for each other text of the bucket
    assert dealt.count() < 25 * n
