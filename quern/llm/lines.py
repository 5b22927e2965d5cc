"""Line dedup by a segment-partition edit join.

Lines are linked if they are few edits apart: edits() says how many, by the shorter line's length. A line is cut into one
segment more than that; a line within so many edits of it holds one of them unchanged, near the place it has there. So
each line posts its segments, and probes, for each length that a partner not longer than itself can have, the substrings
at the places that segment may have moved to; both meet in buckets of (length, segment number, substring). Links are
verified by banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, fresh, spread, table, written
from .links import by_rare_grams, every_link, mixed, resolve

#: most edits between linked lines, and one of them for each so many code points of the shorter line; below that length copies are linked to nothing else
TAU, EACH = 2, 10
#: length of the substrings by which lines of a bucket of unlike ones are told apart
Q = 4
#: lines that a task remembers, to post each of them once; code points whose keys are made at once
CACHE, AT_ONCE = 100_000, 1 << 19
#: most classes of lines that may count as hot, each with a share of all places above one in so many
HOT = 10_000
#: what a line holds that isn't blank
SEEN = r"[^\p{IsWhite_Space}]"
#: ids that are broadcast at most; beyond, texts are shuffled to them
BROADCAST_IDS = 1_000_000
WORD = (1 << 64) - 1


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def banded(s: str, t: str, k: int) -> int:
    """Edit distance if it is at most k (below 32), else k + 1. One 64-bit word holds the band of the matrix's diagonals.

    Vertical and horizontal differences of the column's cells lie in bit vectors, as in Myers's and Hyyro's algorithms;
    the word moves down one cell a column, so the pattern's bits are read from the band's first row on.
    """
    if len(s) < len(t):
        s, t = t, s
    m, n = len(s), len(t)
    if m - n > k:
        return k + 1
    if m <= 2 * k + 1:
        row = list(range(n + 1))
        for i, c in enumerate(s, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return min(row[n], k + 1)
    bits: dict[str, int] = {}
    for i, c in enumerate(s):
        bits[c] = bits.get(c, 0) | 1 << i
    vp, vn, dist, first, low = (WORD << (63 - k)) & WORD, 0, k, k - 63, 1 << 62
    most = k + n - (m - k)
    for i, c in enumerate(t):
        p = bits.get(c, 0)
        p = (p >> first if first >= 0 else p << -first) & WORD
        d0 = ((((p & vp) + vp) & WORD) ^ vp) | p | vn
        hp, hn = (vn | ~(d0 | vp)) & WORD, d0 & vp
        if i < m - k:
            dist += not d0 >> 63
        else:
            dist += bool(hp & low) - bool(hn & low)
            low >>= 1
        if dist > most:
            return k + 1
        vp, vn = (hn | ~((d0 >> 1) | hp)) & WORD, (d0 >> 1) & hp
        first += 1
    return min(dist, k + 1)


def edits(n: int, tau: int = TAU, each: int = EACH) -> int:
    """Most edits between two linked lines, the shorter of which has n code points."""
    return min(tau, n // each)


def within(a: str, b: str, k: int) -> bool:
    """Whether at most k edits apart: what both begin and end with is taken off first."""
    if abs(len(a) - len(b)) > k:
        return False
    i = _common(a, b)
    a, b = a[i:], b[i:]
    i = _common(a[::-1], b[::-1])
    return banded(a[: len(a) - i], b[: len(b) - i], k) <= k


def places(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 even segments of a line; the last ones are the longer."""
    base, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        n = base + (i >= tau + 1 - longer)
        out.append((at, n))
        at += n
    return out


MIX, ODD = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def keys(lines: list[str], tau: int = TAU, each: int = EACH) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the line): what lines post to and probe, as hashes of (partner's length, segment number, substring).

    A segment i of a partner shorter by d moves by at most i to either side, as each move is an edit before it, and by
    at most t - i around d, as each is one behind it, t being the edits allowed; both limits hold at once, which leaves
    few substrings to probe. What a line posts is what it would probe in its own place for a partner of its own length,
    so one list serves both. Substrings have polynomial hashes, read off sums over each line's beginning.
    """
    n = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    start = np.cumsum(n) - n
    most = int(n.max(initial=0)) + 1
    power = np.ones(most, dtype=np.uint64)
    power[1:] = np.cumprod(np.full(most - 1, ODD, dtype=np.uint64))
    back = np.ones(most, dtype=np.uint64)
    back[1:] = np.cumprod(np.full(most - 1, pow(ODD, -1, 1 << 64), dtype=np.uint64))
    place = np.arange(len(codes)) - np.repeat(start, n)
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * power[place])])
    buckets, who = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for t in range(1, tau + 1):
        for d in range(t + 1):
            of = np.flatnonzero((n - d >= t * each) & ((n - d < (t + 1) * each) | (t == tau)))
            m, at = n[of] - d, start[of]
            base, longer = m // (t + 1), m % (t + 1)
            for i in range(t + 1):
                a, size = base * i + np.maximum(longer - (t + 1 - i), 0), base + (t + 1 - i <= longer)
                for off in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1):
                    x = a + off
                    fine = (x >= 0) & (x + size <= n[of])
                    x, y, w = x[fine], size[fine], at[fine]
                    h = (upto[w + x + y] - upto[w + x]) * back[x]
                    buckets.append(mixed(h ^ (m[fine].astype(np.uint64) * np.uint64(64) + np.uint64(i)) * MIX).view(np.int64))
                    who.append(of[fine])
    return np.concatenate(buckets), np.concatenate(who)


def _posted(tau: int, each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ids, lines, held = [], [], 0

            def out() -> pa.RecordBatch:
                bucket, who = keys(lines, tau, each)
                return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.array(ids, dtype=np.int64)[who])], names=["bucket", "id"])

            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i in seen:
                    continue
                if len(seen) < CACHE:
                    seen.add(i)
                ids.append(i)
                lines.append(t)
                held += len(t)
                if held > AT_ONCE:
                    yield out()
                    ids, lines, held = [], [], 0
            yield out()

    return run


def grams_of(line: str, q: int = Q) -> np.ndarray:
    """Hashes of the line's substrings of q code points, repeats included."""
    c = mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1))
    n = len(c) - q + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = c[:n].copy()
    for i in range(1, q):
        h = h * MIX + c[i : n + i]
    return mixed(h)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc_id, no, line, n, h1, h2): the lines that aren't blank, with their document's key and their own hashes."""
    d = docs.where(col(text_col).isNotNull()).select(*doc_key(id_col, text_col), col(id_col).alias("doc_id"), F.posexplode(F.split(col(text_col), "\n", -1)).alias("no", "line"))
    return d.where(F.col("line").rlike(SEEN)).withColumns({"n": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def doc_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits of a document's id and text; rows that share both are one document."""
    return F.xxhash64(col(id_col), col(text_col)).alias("k1"), F.xxhash64(F.lit(1), col(id_col), col(text_col)).alias("k2")


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and id, the distinct ones of buckets that hold several ids."""
    tail = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def out(b: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(b), dtype=bool)
        new[1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1])
        b, i = b[new], i[new]
        same = b[1:] == b[:-1]
        fine = np.zeros(len(b), dtype=bool)
        fine[1:] |= same
        fine[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(b[fine]), pa.array(i[fine])], names=["bucket", "id"])

    for batch in batches:
        b, i = (np.concatenate([t, c.to_numpy()]) for t, c in zip(tail, batch.columns))
        if not len(b):
            continue
        cut = np.searchsorted(b, b[-1])  # the last bucket may go on
        if cut:
            yield out(b[:cut], i[:cut])
        b, i = b[cut:], i[cut:]
        if len(b) > 2:  # of a long bucket the distinct ids are enough
            new = np.concatenate([[True], i[1:] != i[:-1]])
            b, i = b[new], i[new]
        tail = (b, i)
    if len(tail[0]):
        yield out(*tail)


def classes(lines: DataFrame, tau: int = TAU, each: int = EACH, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labels, links) of different lines that are linked: (id, label), (a, b), an id being the line's h1. All links if every, else those that the labels took."""
    posted = lines.where(F.col("n") >= each).select("h1", "line").mapInArrow(_posted(tau, each), "bucket long, id long")
    held = Scratch()
    members = held.written(posted.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_several, "bucket long, id long"), "segments")
    ids = held.written(members.select("id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = held.written(lines.select(F.col("h1").alias("id"), "line").join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"]), "lines")
    left, right = texts.select(F.col("id").alias("a"), F.col("line").alias("ta")), texts.select(F.col("id").alias("b"), F.col("line").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(a, b) for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns)) if within(s, t, edits(min(len(s), len(t)), tau, each))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")

    def refine(open_: DataFrame) -> DataFrame:  # t edits change t * Q of a line's grams at most
        own = open_.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))  # a line has few
        own = held.written(texts.join(own, "id").select("id", F.col("line").alias("text"), "buckets"), "unlike")
        return by_rare_grams(own, grams_of, lambda t, _: Q * edits(len(t), tau, each) + 1)

    links, labels, buckets = resolve(members, verify, refine)
    out = labels, every_link(buckets, labels, verify) if every else links
    held.drop()
    return out


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, each: int = EACH, told: bool = False, hot: int = HOT) -> DataFrame:
    """(k1, k2, dropped, n_near, classes) by document key: numbers of the lines to drop, from 0, in order, and how many of its lines have a link to a different one.

    classes, empty unless told, has a (no, class_doc_id, class_no, n_links) for each line whose class has several places,
    in order: the class's first place, and to how many different lines it is linked.

    Lines of one class (copies, and what links of different lines connect) are one line: its first place stays, by
    doc_id, nulls last, then the document's key, then line number. Blank lines always stay. Every other line is compared,
    with edits(n, tau, each) edits allowed, which is none below each code points. Null and empty texts have no lines.
    Classes that hold more than one in hot of all places, hot at most, are broadcast, so none is one task's.
    """
    lines = lines_of(docs, id_col, text_col)
    labels, links = classes(lines, tau, each, told)
    if told:
        ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
        labels = labels.join(ends, "id", "left")
    else:
        labels = labels.withColumn("n_links", F.lit(None).cast("long"))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "no")
    o = lines.select("k1", "k2", "doc_id", "no", "h1", "h2").join(labels.select(F.col("id").alias("h1"), "label", "n_links"), "h1", "left")
    o = o.select("k1", "k2", "no", at.alias("at"), F.coalesce("label", "h1").alias("c1"), F.when(F.col("label").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("c2"), F.col("label").isNotNull().alias("near"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    o = written(o, "places")
    per = written(o.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1"), "classes")
    often = (per.agg(F.sum("n").alias("n")).first()["n"] or 0) / hot
    own = o.join(F.broadcast(per.where(F.col("n") > often).drop("n")), ["c1", "c2"], "left")  # hot rows at most, as their n add up to no more than the sum
    d = own.where("first is not null").unionByName(own.where("first is null").drop("first").join(per.where(F.col("n") <= often).drop("n"), ["c1", "c2"]))
    other = (F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2")) | (F.col("no") != F.col("first.no"))
    if not told:
        d = d.where(other | F.col("near"))
    place = F.struct("no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.no").alias("class_no"), "n_links")
    return d.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.when(other, F.col("no")))).alias("dropped"), F.count_distinct(F.when(F.col("near"), F.col("no"))).alias("n_near"), F.array_sort(F.collect_set(F.when(F.lit(told), place))).alias("classes")
    )


def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of these numbers."""
    out = []
    for t, g in zip(texts, gone):
        if t is not None and g is not None:
            g = set(g.tolist())
            t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in g])
        out.append(t)
    return pd.Series(out, dtype="object")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row a document: doc_id, n_lines, n_kept, n_near, n_links, dropped, classes. Null text: no lines.

    classes is as in dropped(): lines that aren't in it are classes of their own, without links. n_links is their sum.
    Rows that repeat id and text are one document and get the same row each; no rows: no rows; other columns aren't read.
    """
    d = docs.select(*doc_key(id_col, text_col), col(id_col).alias("doc_id"), F.coalesce(F.size(F.split(col(text_col), "\n", -1)), F.lit(0)).alias("n"), col(text_col).isNull().alias("none"))
    d = d.join(dropped(docs, id_col, text_col, told=True, **how), ["k1", "k2"], "left")
    classes_ = F.coalesce("classes", F.array().cast(d.schema["classes"].dataType))
    n_links = F.aggregate(classes_, F.lit(0).cast("long"), lambda a, x: a + x["n_links"])
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    n = F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long")
    return d.select("doc_id", n.alias("n_lines"), (n - F.size(gone)).alias("n_kept"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), n_links.alias("n_links"), gone.alias("dropped"), classes_.alias("classes"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """docs with the dropped lines taken out of their texts, and chars_col, where it is there, set to the new length. Documents left with only white space, having lost lines, go; all others stay, with all columns."""
    k1, k2, gone = fresh(docs, "k1", "k2", "gone")
    a, b = doc_key(id_col, text_col)
    lost = dropped(docs, id_col, text_col, **how).where(F.size("dropped") > 0).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("dropped").alias(gone))
    d = docs.withColumns({k1: a, k2: b}).join(lost, [k1, k2], "left")
    text = F.pandas_udf(without, "string").asNondeterministic()(F.when(col(gone).isNotNull(), col(text_col)), col(gone))
    new = d.withColumn(text_col, F.when(col(gone).isNull(), col(text_col)).otherwise(text))
    new = new.where(col(gone).isNull() | col(text_col).rlike(SEEN))
    if chars_col and chars_col in docs.columns:
        new = new.withColumn(chars_col, F.when(col(gone).isNull(), col(chars_col)).otherwise(F.length(col(text_col)).cast(docs.schema[chars_col].dataType)))
    return new.select(*[col(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has."""
    return deduplicate(docs)
