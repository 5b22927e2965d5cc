"""Secret scans: base patterns, and password guess-cost by dynamic programming over values in credential contexts.

The guess cost of a value is the least sum, over segmentations of the whole value into words, dates, repeats, sequences,
keyboard walks and brute-force spans, of the log10 of the guesses each segment takes, plus a charge a segment for their
order. Values that follow a credential word and cost enough are secrets; cheap ones are placeholders and prose. Words
take their ranks from counts over the whole corpus, and from a short list of usual passwords.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, fresh, spread, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
WORDS_OF_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Further contexts: a word, and what may stand between it and the value, which goes on to white space or the next context.
CONTEXT = re.compile(rb"(?<![A-Za-z0-9])(password|passwd|passphrase|passcode|pass|pwd|secret|credentials?|token|bearer|private_?key|access_?key|client_?secret|auth|api_?key|login)([\"'`]?[\x20\t]*(?:=>|[:=]|[\x20\t]is[\x20\t]|[\x20\t])[\x20\t]*[\"'`]?)(?=[!-~\x80-\xff]{6})", re.I)
WORDS_OF_CONTEXT = (b"pass", b"pwd", b"secret", b"credential", b"token", b"bearer", b"key", b"auth", b"login")
URL = re.compile(rb"(?<=[A-Za-z0-9]://)[^\s/:@\"']*:([^\s/@\"']{6,})@")
BLANK = re.compile(rb"[^!-~\x80-\xff]")
#: log10 of guesses from which a value counts as a secret
COST = 9.0
#: most words ranked by the corpus, and the longest that is one; longest block that counts as said again and again
WORDS, WIDEST, PERIOD = 50_000, 24, 32
FLUSH = 200_000

COMMON = """password passwort secret token letmein welcome admin root user login master dragon monkey shadow sunshine princess
football baseball superman batman trustno starwars iloveyou hello freedom whatever qazwsx ninja azerty solo access flower
hottie loveme charlie donald michael jordan jennifer hunter buster soccer harley ranger thomas tigger robert george andrew
daniel summer winter spring autumn monday friday january february march april june july august september october november
december test testing example sample changeme default guest public private server system service database backup oracle mysql
postgres redis mongo google amazon azure cloud account email phone home office school company the and for that with this from
have not are was you all any can had her one our out day get has him his how man new now old see two way who boy did its let put
say she too use key api auth pass code data file name word time year people work life love world house water light money music
game play star blue green red black white orange silver gold power magic happy lucky secure security access control manager
developer production staging local host port value string null none true false redacted removed hidden your here insert replace
please forgot reset required field policy strength length must should contain characters letters numbers stored hashed""".split()
RANK = {}
for _i, _w in enumerate(COMMON, 10):
    RANK.setdefault(_w, math.log10(_i))
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEAR: dict[str, set[str]] = {}
for _r, _row in enumerate(ROWS):
    for _c, _k in enumerate(_row):
        NEAR.setdefault(_k, set()).update(x for dr in (-1, 0, 1) if 0 <= _r + dr < 4 for dc in (-1, 0, 1) if (dr or dc) and 0 <= _c + dc < len(ROWS[_r + dr]) for x in ROWS[_r + dr][_c + dc])
LEET = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
PER_SEGMENT = math.log10(2)


def _classes(s: str) -> float:
    """log10 of guesses a brute-forced character takes: the alphabets that the whole value draws on."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) and not s.isdigit():
        return math.log10(16)
    n = 10 * bool(re.search(r"\d", s)) + 26 * bool(re.search(r"[a-z]", s)) + 26 * bool(re.search(r"[A-Z]", s)) + 33 * bool(re.search(r"[^0-9A-Za-z]", s))
    return math.log10(max(n, 10))


def segments(s: str, ranks: dict[str, float] = RANK, blocks: dict[str, float] | None = None) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses) of what may be guessed at once; walks and brute force are left to the segmentation.

    Repeats are what stands between the ends of a stretch of period up to PERIOD, from each place of its first two
    blocks, as often as the block fits and once less; their block costs what its own segmentation costs.
    """
    low, n, blocks = s.lower(), len(s), {} if blocks is None else blocks
    if len(low) != n:  # a letter whose small form is two
        low = s
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + WIDEST) + 1):
            for form, extra in ((low, 0.0), (plain, math.log10(4))):
                if (r := ranks.get(form[i:j]) or RANK.get(form[i:j])) is not None:
                    yield i, j, "word", r + extra + (0 if s[i:j].islower() else math.log10(2 + sum(c.isupper() for c in s[i:j])))
                    break
        m = DATE.match(s, i)
        while m:
            yield i, m.end(), "date", math.log10(365 * 120 if m.end() - i > 4 else 130)
            m = DATE.match(s, i, m.end() - 1) if m.end() - i > 4 else None
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for p in range(1, min(PERIOD, n // 2) + 1):
        same = np.concatenate([[False], points[p:] == points[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # s[a:b] is s[a + p:b + p]
            for i in range(a, min(a + 2 * p, b)):
                most = (b + p - i) // p
                for k in (most, most - 1):
                    if k > 1 + (p == 1):
                        block = s[i : i + p]
                        if block not in blocks:
                            blocks[block] = segmentation(block, ranks, blocks)[0]
                        yield i, i + k * p, "repeat", blocks[block] + math.log10(k)
    for step in (1, -1):
        i = 0
        while i < n:
            j = i + 1
            while j < n and ord(s[j]) - ord(s[j - 1]) == step and s[j].isascii() and s[j].isalnum():
                j += 1
            for x in range(i, j - 2):
                for y in range(x + 3, j + 1):
                    yield x, y, "sequence", math.log10(26 * (y - x))
            i = j


WALK, STEP = math.log10(47), math.log10(2.5)  # a walk's first key, and each further one


def segmentation(s: str, ranks: dict[str, float] = RANK, blocks: dict[str, float] | None = None) -> tuple[float, list[tuple[str, str]]]:
    """(log10 of guesses, [(kind, piece)]) of the cheapest way to say the whole of s; brute-force characters next to each other are one piece. Linear in the length."""
    each, low = _classes(s), s.lower()
    if len(low) != len(s):
        low = s
    by_end: dict[int, list] = {}
    for a, b, kind, c in segments(s, ranks, blocks):
        by_end.setdefault(b, []).append((a, kind, c + PER_SEGMENT))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    never = (math.inf, 0)
    one = two = more = never  # the cheapest walks that end here, of 1, 2 and 3 or more keys, and where they begin
    for k in range(1, len(s) + 1):
        c = (best[k - 1][0] + (0.6 if s[k - 1] in "-_./ " else each), k - 1, "brute")
        for a, kind, cost in by_end.get(k, ()):
            if best[a][0] + cost < c[0]:
                c = (best[a][0] + cost, a, kind)
        on = k > 1 and low[k - 1] in NEAR.get(low[k - 2], ())
        grown = lambda w: (w[0] + STEP, w[1]) if on else never  # noqa: B023, E731
        one, two, more = (best[k - 1][0] + WALK + PER_SEGMENT, k - 1), grown(one), min(grown(two), grown(more))
        if more[0] < c[0]:
            c = (*more, "walk")
        best.append(c)
    out, k = [], len(s)
    while k:
        _, a, kind = best[k]
        if kind == "brute" and out and out[-1][0] == "brute":
            out[-1] = (kind, s[a:k] + out[-1][1])
        else:
            out.append((kind, s[a:k]))
        k = a
    return best[-1][0], out[::-1]


def guess_cost(s: str, ranks: dict[str, float] = RANK) -> float:
    """log10 of guesses of the cheapest segmentation of the whole of s."""
    return segmentation(s, ranks)[0]


_RUN = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def values_of(raw: bytes, low: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether assigned) of the values in credential contexts, by start; each ends at white space or where the next context begins."""
    out = []
    if any(w in low for w in WORDS_OF_CONTEXT):
        ms = list(CONTEXT.finditer(raw))
        end = 0
        for m, after in zip(ms, [*(m.start() for m in ms[1:]), len(raw)]):
            a = m.end()
            if a >= end:  # else the run of an earlier value goes on
                blank = BLANK.search(raw, a)
                end = blank.start() if blank else len(raw)
            out.append((a, min(end, after), b":" in m[2] or b"=" in m[2]))
    if b"://" in raw:
        out += [(*m.span(1), True) for m in URL.finditer(raw)]
    return sorted(set(out))


def scan(text: str | None, least: float = COST, ranks: dict[str, float] = RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in KINDS; time is linear in the text's length."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    low = raw.translate(_LETTERS)
    if any(w in low for w in WORDS_OF_ASSIGN):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    if b"hhhhhhhhhhhhhhhhhhhhhhhh" in raw.translate(_RUN):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw) if m.end() - m.start() >= 24]
    begins, ends = [], []  # the base spans' union, as stretches in order
    for a, _, b in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    last = 0
    for a, b, assigned in values_of(raw, low):
        v = raw[a:b].rstrip(b".,;:!?)]}>\"'`&")
        b = a + len(v)
        k = bisect_left(begins, b)  # stretches before this one begin before the value's end
        if len(v) < 6 or a < last or k and ends[k - 1] > a:
            continue
        # prose may follow the word alone: then only a value with a digit counts
        if (assigned or re.search(rb"\d", v)) and guess_cost(v.decode("utf-8", "replace"), ranks) >= least:
            found.append((a, 3, b))
            last = b
    found.sort()
    if len(raw) != len(text):
        upto = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
        found = [(int(upto[a]), k, int(upto[b])) for a, k, b in found]
    return [(KINDS[k], a, b) for a, k, b in found]


_WORD = re.compile(r"[^\W\d_]+")


def ranks_of(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> dict[str, float]:
    """log10 of the rank of the most frequent words of 3 to WIDEST letters, counted over all texts; values in credential contexts don't count.

    A task counts its own words and sends one row a word, again after FLUSH different ones; words a parameter bounds what
    reaches the driver and the workers. Ties: code point order. Null and empty texts: no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in (x.as_py() for x in batch.column(0)):  # one text at a time
                if not t:
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                low = raw.translate(_LETTERS)
                if any(w in low for w in WORDS_OF_CONTEXT) or b"://" in raw:
                    parts, at = [], 0
                    for a, b, assigned in values_of(raw, low):
                        if assigned and a >= at:
                            parts.append(raw[at:a])
                            at = b
                    t = b" ".join([*parts, raw[at:]]).decode("utf-8", "replace")
                n.update(w for w in _WORD.findall(t.lower()) if 2 < len(w) <= WIDEST)
                if len(n) > FLUSH:
                    yield out()
                    n.clear()
        yield out()

    held = Scratch()
    c = held.written(docs.select(col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = F.floor(F.log2("n") * 16).cast("int")
    some, least = 0, 0  # the class of counts from which there are enough words, so that no partition sends all it has
    for r in sorted(c.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        some, least = some + r["count"], r["size"]
        if some >= words:
            break
    top = c.where(size >= least).orderBy(F.desc("n"), "word").limit(words).collect()
    held.drop()
    return {r["word"]: math.log10(i) for i, r in enumerate(top, 10)}


def find(docs: DataFrame, text_col: str = "text", least: float = COST, ranks: dict[str, float] | None = None) -> DataFrame:
    """All rows and columns of docs, and secrets: [kind, start, end] (under a free name if that is taken).

    Narrow, one pass over whole texts; null and empty texts: no secrets. Guess spans don't overlap base ones. Repeated
    rows get the same spans, very long texts and values are read whole; no rows: no rows. ranks: ranks_of(), else the short list alone.
    """
    ranks = dict(RANK) if ranks is None else ranks
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = held.value
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, least, known)] for t in texts.tolist()], dtype="object")

    (name,) = fresh(docs, "secrets")
    return docs.withColumn(name, spans(col(text_col)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    f = find(docs, ranks=ranks_of(docs))
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return f.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))
