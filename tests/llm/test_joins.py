import random

import numpy as np
import pytest
from helpers import clashing, empty_docs, odd_docs
from pyspark.sql import functions as F

from quern.llm import lines, links, neardup, permutation, topk
from quern.llm.common import table
from quern.llm.vectors import usable


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(r, s, n, letters="abcd "):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s) + 1)
        k = r.randrange(3)
        if k == 0:
            s.insert(i, r.choice(letters))
        elif s and k == 1:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = r.choice(letters)
    return "".join(s)


def test_banded_distance():
    r = random.Random(3)
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.choice([0, 1, 5, 20, 63, 64, 65, 90])))
        b = edited(r, a, r.randrange(7), "abc")
        d = lev(a, b)
        for k in (1, 2, 5):
            assert lines.banded(a, b, k) == min(d, k + 1) and lines.within(a, b, k) == (d <= k)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 100)]
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    got = {x["id"]: x["label"] for x in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: s.find(x) for e in edges if e[0] != e[1] for x in e}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_take_few_jobs(spark):
    """Labels are those of the rounds, made in one task, so the driver doesn't hold the rounds' plans."""
    r = random.Random(8)
    chain = list(range(-150, 150))
    r.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)), (7000, 7000), (9, 8), (8, 9)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup("few", "")
    got = links.components(df).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("rounds", "")
    for few in (0, 200):  # by rounds alone, and by rounds until so few are left
        assert sorted(got) == sorted(links.components(df, few).collect())
    spark.sparkContext.setJobGroup("", "")
    assert len({x["id"] for x in got}) == len(got) and {x["label"] for x in got if x["id"] < 1000} == {-150}
    assert jobs <= 8


def test_resolve_finds_every_class_in_big_mixed_buckets(spark):
    """Members are linked if their tens agree; stars alone would miss most links."""
    rows = [(1, i) for i in range(120)] + [(2, i) for i in range(100, 300, 7)] + [(3, 999)]
    def verify(pairs):
        return pairs.where(F.floor(F.col("a") / 10) == F.floor(F.col("b") / 10))
    found, labels, _ = links.resolve(spark.createDataFrame(rows, "bucket long, id long"), verify)
    s = Sets()
    for bucket in (1, 2):
        ids = [i for b, i in rows if b == bucket]
        for a in ids:
            for b in ids:
                if a // 10 == b // 10:
                    s.join(a, b)
    got = {x["id"]: x["label"] for x in labels.collect()}
    assert all(got.get(i, i) == s.find(i) for _, i in rows)
    assert all(x["a"] // 10 == x["b"] // 10 for x in found.collect())


def corpus(r):
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    base = ["\n".join(" ".join(r.choice(words) for _ in range(r.randint(8, 14))) for _ in range(r.randint(2, 6))) for _ in range(40)]
    docs = list(base)
    for _ in range(60):
        t = r.choice(base).split(" ")
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        docs.append(" ".join(t))
    for _ in range(40):
        ls = r.choice(base).split("\n")
        docs.append("\n".join(edited(r, x, r.randint(0, 3)) for x in r.sample(ls, r.randint(1, len(ls)))) + "\n" + " ".join(r.choice(words) for _ in range(12)))
    docs += r.choices(base, k=20)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]


def test_near_duplicates_by_brute_force(spark):
    data = corpus(random.Random(8))
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    g = {i: neardup.grams(neardup.words(t)) for i, t, *_ in data}
    s = Sets()
    for a in g:
        for b in g:
            if a < b and len(g[a] & g[b]) >= neardup.THRESHOLD * len(g[a] | g[b]):
                s.join(a, b)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {i: s.find(i) for i in g}
    assert sum(r["keep"] for r in got.values()) == len({s.find(i) for i in g})
    kept = neardup.stage(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({s.find(i) for i in g})


@pytest.mark.parametrize("block", [neardup.BLOCK, 7])
def test_every_link_counts(spark, block):
    """n_links is that of brute force over distinct texts, whether a class is one block or several."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for size in (1, 2, 3, 3, 40):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(1, 6)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
    three = " ".join(r.choice(words) for _ in range(60))
    texts += [three, three + " x", three + " y", texts[3], texts[3], "one", "one", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    g = {t: neardup.grams(neardup.words(t)) for t in texts}
    want = {t: sum(bool(x & y) and len(x & y) >= neardup.THRESHOLD * len(x | y) for o, y in g.items() if o != t) for t, x in g.items()}
    got = {x["doc_id"]: x["n_links"] for x in neardup.near_duplicates(df, block=block).collect()}
    assert got == {i: want[t] for i, t in enumerate(texts)}
    assert want[three] == 2 and max(want.values()) > 20


def test_a_passage_that_many_documents_share(spark):
    """Documents that share a third of their words meet in buckets of the passage; only those that are near are linked."""
    r = random.Random(31)
    words = [f"w{i}" for i in range(4000)]
    passage = [r.choice(words) for _ in range(60)]
    texts = []
    for _ in range(80):
        own = [r.choice(words) for _ in range(70)]
        for _ in range(r.choice([1, 1, 1, 3])):
            t = list(own)
            for _ in range(r.randint(0, 9)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join([*t[:35], *passage, *t[35:]]))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    g = [neardup.grams(t.split()) for t in texts]
    s, n = Sets(), [0] * len(g)
    for i, a in enumerate(g):
        for j, b in enumerate(g[:i]):
            if len(a & b) >= neardup.THRESHOLD * len(a | b):
                n[i], n[j] = n[i] + 1, n[j] + 1
            if len(a & b) >= neardup.THRESHOLD * len(a | b):
                s.join(i, j)
    got = {x["doc_id"]: x for x in neardup.near_duplicates(df).collect()}
    assert {i: x["class_id"] for i, x in got.items()} == {i: s.find(i) for i in range(len(g))} and 20 < len({s.find(i) for i in range(len(g))}) < len(g)
    assert [got[i]["n_links"] for i in range(len(g))] == n


def test_bands():
    b, r = neardup.bands_for(0.5, 0.99)
    assert 1 - (1 - 0.5**r) ** b >= 0.99 and b * r <= 128
    with pytest.raises(ValueError):
        neardup.bands_for(0.01, 0.999999, 16)


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.near_duplicates(clashing(odd_docs(spark))).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[5]["class_id"] == by[4]["class_id"] == 4 and by[4]["class_size"] == 3 and by[4]["keep"] and not by[5]["keep"] and by[1]["keep"]
    kept = neardup.deduplicate(odd_docs(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["None", "1", "2", "3", "4", "6", "7", "8"])
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0 and neardup.deduplicate(empty_docs(spark)).count() == 0


def linked(a, b):
    """By the stated rule: 2 edits, 1 if the shorter has fewer than 20 code points, none if fewer than 10."""
    k = min(2, min(len(a), len(b)) // 10)
    return abs(len(a) - len(b)) <= k and lev(a, b) <= k


def lines_by_brute_force(data):
    every = [(i, no, x) for i, t, *_ in sorted(data) if t for no, x in enumerate(t.split("\n")) if x.strip()]
    s, texts = Sets(), sorted({x for *_, x in every})
    near = set()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if linked(a, b):
                s.join(a, b)
                near |= {a, b}
    first, gone, n_near = {}, {}, {}
    for i, no, x in every:
        if first.setdefault(s.find(x), (i, no)) != (i, no):
            gone.setdefault(i, []).append(no)
        n_near[i] = n_near.get(i, 0) + (x in near)
    return gone, n_near


def test_lines_by_brute_force(spark):
    r = random.Random(4)
    data = [d for d in corpus(r) if d[0] % 2]
    short = ["".join(r.choice("abcdef") for _ in range(n)) for n in (1, 2, 3, 5, 8, 9, 10, 11, 14, 15, 18, 19, 20, 21, 25, 30)]
    data += [(2000 + i, "\n".join(edited(r, r.choice(short), r.randint(0, 3)) for _ in range(8)), "en", "s", 1) for i in range(40)]
    data = [(*d[:4], len(d[1])) for d in data]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    gone, n_near = lines_by_brute_force(data)
    got = {r["doc_id"]: r for r in lines.report(df).collect()}
    assert {i: sorted(r["dropped"]) for i, r in got.items()} == {i: gone.get(i, []) for i, *_ in data}
    assert {i: r["n_near"] for i, r in got.items()} == {i: n_near.get(i, 0) for i, *_ in data} and sum(n_near.values()) > 10
    out = {r["doc_id"]: r for r in lines.stage(spark, df, "").collect()}
    for i, t, *_ in data:
        left = [x for no, x in enumerate(t.split("\n")) if no not in gone.get(i, [])]
        assert i not in out and not "".join(left).strip() or out[i]["text"] == "\n".join(left) and out[i]["n_chars"] == len("\n".join(left))


def test_lines_of_odd_rows(spark):
    got = lines.report(clashing(odd_docs(spark))).collect()
    assert len(got) == 10
    dropped = {(r["doc_id"], r["n_lines"] - r["n_kept"]) for r in got}
    assert (5, 1) in dropped and (4, 0) in dropped and (1, 0) in dropped
    assert lines.report(empty_docs(spark)).count() == 0 and lines.deduplicate(empty_docs(spark)).count() == 0
    assert {r["doc_id"] for r in lines.deduplicate(odd_docs(spark)).collect()} == {None, 1, 2, 3, 4, 6, 7, 8}


def test_short_lines(spark):
    """Lines below 10 code points go if they are exact copies, of 10 to 19 if they are one edit apart, of 20 on two; blank ones stay."""
    texts = ["yes\n\nHe said so, at 12 o'clock.\nno", "yes\n \nHe said so, at 11 o'clock.\nyet", "\n\u3000\nno\nno\n", "\u3000", "fifteen letters", "fifteen lettersx\nfifteen lettexx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: r["dropped"] for r in lines.report(df).collect()} == {0: [], 1: [0, 2], 2: [2, 3], 3: [], 4: [], 5: [0]}
    assert {r["doc_id"]: r["text"] for r in lines.deduplicate(df).collect()} == {0: texts[0], 1: " \nyet", 3: texts[3], 4: texts[4], 5: "fifteen lettexx"}


def test_unlike_lines_of_one_template(spark):
    """Lines that share all but a number share every bucket of the template; rare substrings bring the linked ones together, and hot classes are broadcast."""
    r = random.Random(12)
    numbers = ["".join(r.choice("0123456789") for _ in range(12)) for _ in range(150)]
    numbers += [edited(r, n, r.randint(0, 3), "0123456789") for n in numbers[:80]]
    data = [(i, f"your order number is {n}, and we thank you for it\nthe same line in every document\n{n}", "en", "s", 1) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    gone, n_near = lines_by_brute_force(data)
    assert 50 < sum(n > 0 for n in n_near.values()) < 230
    got = {x["doc_id"]: x for x in lines.report(df).collect()}
    assert {i: x["dropped"] for i, x in got.items()} == {i: gone.get(i, []) for i, *_ in data} and {i: x["n_near"] for i, x in got.items()} == n_near
    few = {x["doc_id"]: x for x in lines.report(df, hot=10**9).collect()}
    assert few == got


def test_rare_grams_bring_all_pairs_together(spark):
    """Each two texts that are linked post a gram in common, however often other grams come."""
    r = random.Random(2)
    base = ["the same beginning of a line and then " + "".join(r.choice("abcdefghij") for _ in range(10)) for _ in range(60)]
    texts = sorted({*base, *(edited(r, r.choice(base), 2, "abcdefghij") for _ in range(120))})
    got = links.by_rare_grams(spark.createDataFrame([(i, t, [7, i % 2]) for i, t in enumerate(texts)], "id long, text string, buckets array<long>"), lines.grams_of, lambda t, _: 9).collect()
    post = {}
    for x in got:
        post.setdefault(x["id"], set()).add(x["bucket"])
    pairs = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if linked(a, b)]
    assert len(pairs) > 100 and all(post.get(i, set()) & post.get(j, set()) for i, j in pairs)
    assert links.by_rare_grams(spark.createDataFrame([], "id long, text string, buckets array<long>"), lines.grams_of, lambda t, _: 9).count() == 0


def test_long_documents_of_many_lines(spark):
    """Bookkeeping is linear in the lines of a document."""
    docs = spark.createDataFrame([(0, "\n".join(f"line {i}" for i in range(40_000))), (1, "\n".join(f"line {i}" for i in range(39_999, -1, -1)) + "\nlast")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] == "last" for r in lines.deduplicate(docs).collect()} == {0: False, 1: True}


def test_line_classes_and_links(spark):
    """Each line of a class of several places tells the class's first place and all its links, in large buckets too."""
    r = random.Random(6)
    data = [d for d in corpus(r) if d[0] % 3]
    stem = "the same sentence, but for its last two letters "
    data += [(1000 + i, stem + a + b, "en", "s", 50) for i, (a, b) in enumerate((a, b) for a in "abcdefg" for b in "hijklmn")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    every = [(i, no, x) for i, t, *_ in sorted(data) for no, x in enumerate(t.split("\n")) if x.strip()]
    texts, s, n = sorted({x for *_, x in every}), Sets(), {}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if linked(a, b):
                s.join(a, b)
                n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    places = {}
    for i, no, x in every:
        places.setdefault(s.find(x), []).append((i, no))
    want = {}
    for i, no, x in every:
        if len(places[s.find(x)]) > 1:
            want.setdefault(i, []).append((no, *places[s.find(x)][0], n.get(x, 0)))
    got = {x["doc_id"]: x for x in lines.report(df).collect()}
    assert {i: [tuple(c) for c in x["classes"]] for i, x in got.items()} == {i: want.get(i, []) for i, *_ in data}
    assert all(x["n_links"] == sum(c[3] for c in want.get(i, [])) for i, x in got.items()) and n[stem + "ah"] == 48


@pytest.mark.parametrize("block", [512, 3])
def test_every_link_of_a_bucket(spark, block):
    rows = [(1, i) for i in range(40)] + [(2, i) for i in range(30, 50)] + [(3, 99)]
    def verify(pairs):
        return pairs.where(F.floor(F.col("a") / 10) == F.floor(F.col("b") / 10))
    members = spark.createDataFrame(rows, "bucket long, id long")
    _, labels, _ = links.resolve(members, verify)
    got = [(x["a"], x["b"]) for x in links.every_link(members, labels, verify, block).collect()]
    assert sorted(got) == [(a, b) for a in range(50) for b in range(a + 1, 50) if a // 10 == b // 10]


def vectors(spark, n=700, d=8, seed=1, copies=250):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).round(2)
    x[:copies] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(900, None), (None, [1.0] * d), (1000, [float("nan")] * d), (1100, [0.0] * d), (1200, [float("inf")] + [0.0] * (d - 1)), (1300, [None] + [1.0] * (d - 1)), (1400, []), (1500, [1.0]), (100, [float(v) for v in x[0]])]
    return spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").repartition(6), dict(rows)


def test_exact_top_k(spark):
    df, x = vectors(spark)
    v = usable(df, "vec_id", "embedding", zero=True)
    got = {}
    for r in topk.top_k(v, v.where("id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    pool = [(i, np.floor(np.array(e) * 1024).astype(int)) for i, e in [*x.items(), (1100, [0.0] * 8), (100, x[0])]]
    own = dict(x) | {1100: [0.0] * 8}
    assert set(got) == {i for i in own if i % 100 == 0}
    for q, rows in got.items():
        qs = [np.floor(np.array(e) * 1024).astype(int) for i, e in [*x.items(), (1100, [0.0] * 8)] if i == q]
        if q == 100:
            qs = [min((list(own[100]), list(x[0])))]
            qs = [np.floor(np.array(qs[0]) * 1024).astype(int)]
        want = sorted(((-int(e @ qs[0]), i) for i, e in pool if i != q))[:10]
        assert [(s, i) for _, i, s in sorted(rows)] == [(-s, i) for s, i in want]


def test_top_k_of_few_and_huge(spark):
    e = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id bigint, embedding array<double>")
    v = usable(e, "vec_id", "embedding", zero=True)
    rows = topk.top_k(v, v.where("id = 0"), 10).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1, (1 << 63) - 1), (2, 2, -(1 << 63))]
    none = usable(e.limit(0), "vec_id", "embedding", zero=True)
    assert topk.top_k(none, none, 10).count() == 0


def test_permutation_index(spark):
    f = permutation.Files(np.array([[0, 1], [2, 0], [1, 2]]), 3)
    assert f.footrule(np.array([0, 1])).tolist() == [0, 4, 4]  # |places| with 2 for a missing one: 0; 1 + 1 + 2 (pivots 0, 1, 2); 2 + 1 + 1
    df, x = vectors(spark, copies=1)
    v = usable(df, "vec_id", "embedding", zero=False)
    got = permutation.knn(v, v.where("id % 100 = 0"), permutation.pivots_of(v, 64), length=32, asked=16).collect()
    hit = n = 0
    for q in (0, 200, 300, 400, 500, 600):
        d = sorted((float(np.sqrt(((np.array(e) - np.array(x[q])) ** 2).sum())), i) for i, e in [*x.items(), (100, x[0])] if i != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in mine] == list(range(1, 11)) and [s for *_, s in mine] == sorted(s for *_, s in mine)
        hit += len({i for _, i in d} & {i for _, i, _ in mine})
        n += len({i for _, i in d})
    assert hit / n >= 0.9
    assert 1100 not in {r["vec_id"] for r in got} | {r["query_id"] for r in got}


@pytest.mark.parametrize("n, copies", [(700, 250), (3000, 1000)])
def test_permutation_index_among_copies(spark, n, copies):
    """A vector that a third of the rows share takes neither the pivots nor the reranked places of others; ties go to the smaller id."""
    df, x = vectors(spark, n=n, copies=copies)
    v = usable(df, "vec_id", "embedding", zero=False)
    pivots = permutation.pivots_of(v, 64)
    assert len(pivots) == 64 == len({tuple(p) for p in pivots})
    e = np.array([x[i] for i in range(n)])
    outside = copies + np.argsort(((e[copies:] - e[0]) ** 2).sum(axis=1))
    asked = {0, 5, 100, *range(copies, n, 97), *outside[:30].tolist()}
    found = {}
    for r in permutation.knn(v, v.where(F.col("id").isin(*asked)), pivots, length=32).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hit = 0
    for q in asked:
        d = np.sqrt(((e - e[q]) ** 2).sum(axis=1))
        pool = sorted([(float(d[i]), i) for i in range(n) if i != q] + ([(float(d[0]), 100)] if q != 100 else []))[:10]
        mine = [t[1:] for t in sorted(found[q])]
        if q < copies:
            assert mine == pool
        assert mine == sorted(mine) and len(mine) == 10
        hit += sum(s <= pool[-1][0] + 1e-9 for s, _ in mine)
    assert hit / (10 * len(asked)) >= 0.9


def test_permutation_index_of_few_and_no_rows(spark):
    df, x = vectors(spark, n=30, copies=1)
    v = usable(df.select("*", F.lit(1).alias("id"), F.lit("x").alias("vec"), F.lit(2).alias("score")), "vec_id", "embedding", zero=False)
    pivots = permutation.pivots_of(v)
    assert len(pivots) == 30
    got = {}
    for r in permutation.knn(v, v.where("id < 3"), pivots).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in (0, 1, 2):  # so few are all reranked
        d = sorted((float(np.sqrt(((np.array(e) - np.array(x[q])) ** 2).sum())), i) for i, e in [*x.items(), (100, x[0])] if i != q)[:10]
        assert [i for _, i in sorted(got[q])] == [i for _, i in d]
    few = v.where("id < 3")
    assert permutation.knn(few, few, permutation.pivots_of(few)).count() == 6
    none = v.where("id < 0")
    assert permutation.knn(none, none, permutation.pivots_of(none)).count() == 0 == permutation.knn(v, none, pivots).count()


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    e = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table(spark, sf, "embeddings").collect()}
    ids, x = np.array(list(e)), np.array(list(e.values()))
    hit = n = 0
    got = {}
    for r in permutation.op5(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in ids[ids % 100 == 0]:
        d = ((x - e[q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & got[int(q)])
        n += 10
    assert hit / n >= 0.9
