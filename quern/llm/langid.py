"""Language ID by cross-parsing: the language whose labelled text parses a text into the fewest normalised phrases wins."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket, col, fresh, spread, table, written

FOLDS, HELD = 4, 2
#: The sample that a language is learned from: at most DOCS documents of it, a random window of CHARS code points each.
DOCS, CHARS = 48, 400
#: Texts are cut into blocks of so many symbols that are parsed side by side; what a block's parse owes to the one before is then put right.
BLOCK, AT_ONCE = 512, 3 << 18
UND = "und"
SPACE, OTHER = 0, 1  # symbols: anything but a letter, runs as one; letters that no sample has


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The edges of the codes' suffix automaton by state, the first being the start. OTHER parts the documents of a sample; no path crosses it or holds it."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        if c == OTHER:
            last = 0
            continue
        if c in edges[last] and length[edges[last][c]] == length[last] + 1:  # after a restart the string may be known
            last = edges[last][c]
            continue
        cur = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return edges


class Table:
    """An automaton's edges in two arrays: a state is a base of its own; if it has an edge for a symbol, owner[base + symbol] is its base and next[base + symbol] that of the state it leads to.

    Where it hasn't, a phrase ends, and the next begins with the symbol, from the start: first[symbol]. The start itself
    and states without edges have the base 0, which owns no place. Its size goes with the edges and the number of
    symbols, not with their product.
    """

    def __init__(self, edges: list[dict[int, int]], symbols: int):
        base = np.zeros(len(edges), dtype=np.int64)
        rows = sorted((s for s in range(1, len(edges)) if edges[s]), key=lambda s: (-len(edges[s]), s))
        room = symbols + 2 * sum(map(len, edges)) + 2 * symbols
        free = np.ones(room, dtype=bool)
        free[:symbols] = False
        own = np.ones(room, dtype=bool)  # bases that no state has
        own[0] = False
        begin = symbols
        singles = [s for s in rows if len(edges[s]) == 1]
        for s in rows[: len(rows) - len(singles)]:
            syms = np.fromiter(edges[s], dtype=np.int64, count=len(edges[s]))
            while True:
                b = begin + np.flatnonzero(free[begin : begin + 4096]) - syms[0]
                b = b[(b > 0) & own[np.maximum(b, 0)]]
                for c in syms[1:]:
                    b = b[free[np.minimum(b + c, room - 1)] & (b + c < room)]
                if len(b):
                    break
                begin += 2048
                if begin + 4096 > room:
                    free, own, room = np.concatenate([free, np.ones(room, dtype=bool)]), np.concatenate([own, np.ones(room, dtype=bool)]), 2 * room
            base[s] = b[0]
            own[b[0]] = False
            free[b[0] + syms] = False
            while begin < room and not free[begin]:
                begin += 1
        left = np.array(sorted(singles, key=lambda s: next(iter(edges[s]))), dtype=np.int64)
        rng, tries = np.random.default_rng(1), 0
        while len(left):  # states with one edge, all at once; those whose base is taken try again elsewhere
            syms = np.fromiter((next(iter(edges[s])) for s in left.tolist()), dtype=np.int64, count=len(left))
            at = np.flatnonzero(free[symbols:]) + symbols
            if len(at) < len(left) + 2 * symbols:
                free, own = np.concatenate([free, np.ones(room, dtype=bool)]), np.concatenate([own, np.ones(room, dtype=bool)])
                room *= 2
                continue
            at = (rng.permutation(at) if tries else at)[: len(left)]
            tries += 1
            b = at - syms
            fine = np.zeros(len(left), dtype=bool)
            fine[np.unique(b, return_index=True)[1]] = True
            fine &= (b > 0) & own[np.maximum(b, 0)]
            base[left[fine]] = b[fine]
            own[b[fine]] = False
            free[at[fine]] = False
            left = left[~fine]
        own_, sym_, to_ = (np.array(x, dtype=np.int64) for x in zip(*((s, c, to) for s in rows for c, to in edges[s].items()))) if rows else (np.zeros(0, dtype=np.int64),) * 3
        self.owner = np.full(int(base.max()) + symbols + 1, -1, dtype=np.int32)
        self.next = np.zeros(len(self.owner), dtype=np.int32)
        self.owner[base[own_] + sym_], self.next[base[own_] + sym_] = base[own_], base[to_]
        self.first = np.zeros(symbols, dtype=np.int32)
        for c, to in edges[0].items():
            self.first[c] = base[to]
        self.first[OTHER] = 0


class Model:
    """Automata of a few samples: {language: [window, ...]}. Every letter that a sample has is a symbol of its own."""

    def __init__(self, samples: dict[str, list[str]]):
        samples = {k: [w.lower() for w in v] for k, v in samples.items()}
        count = Counter(c for v in samples.values() for w in v for c in w if c.isalpha())
        known = sorted(count, key=lambda c: (-count[c], c))
        self.known = np.full(0x110000, OTHER, dtype=np.int32)
        points = np.arange(0x110000)
        letter = np.fromiter((chr(i).isalpha() for i in points), dtype=bool, count=len(points))
        self.known[~letter] = SPACE
        for i, c in enumerate(known):
            self.known[ord(c)] = i + 2
        self.langs, self.tables, self.bits = [], [], []
        for lang in sorted(samples):
            codes: list[int] = []
            for w in samples[lang]:
                codes += [OTHER, *self.codes(w)[0].tolist()]
            if any(c > OTHER for c in codes):
                self.langs.append(lang)
                self.tables.append(Table(automaton(codes), len(known) + 2))
                self.bits.append(math.log2(len(codes) + 1))

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a text with runs of SPACE as one, and which of its code points they stand for."""
        raw = self.known[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        keep = np.empty(len(raw), dtype=bool)
        if len(raw):
            keep[0] = True
            np.logical_or(raw[1:] != SPACE, raw[:-1] != SPACE, out=keep[1:])
        return raw[keep], keep

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, symbols, letters) of lower-case texts, each parsed from its first symbol to its last.

        Blocks are first parsed as if a phrase began with each. Then, in rounds, a block is parsed again from the state
        that the block before ends in, until both parses meet in one state; from there on they are the same.
        """
        joined = "\n".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes, keep = self.codes(joined)
        upto = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(codes != SPACE)])
        a, b = upto[np.concatenate([[0], ends[:-1]])], upto[ends - 1]
        n = b - a
        blocks = np.maximum(-(-n // BLOCK), 0)
        doc = np.repeat(np.arange(len(texts)), blocks)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = a[doc] + k * BLOCK
        size = np.minimum(BLOCK, b[doc] - start)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        before = np.where(k > 0, place[np.maximum(np.arange(len(doc)) - 1, 0)], -1)[order]  # the lane of the block before
        start, size, doc = start[order], size[order], doc[order]
        active = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # lanes longer than step t
        lanes, steps = len(start), int(size.max(initial=0))
        out = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        symbols = np.zeros((steps, lanes), dtype=np.int32)
        for t in range(steps):
            m = active[t]
            symbols[t, :m] = codes[start[:m] + t]
        states = np.zeros((steps, lanes), dtype=np.int32)
        begun = np.zeros((steps, lanes), dtype=bool)
        for i, table_ in enumerate(self.tables):
            first = table_.first.take(symbols)
            state = np.zeros(lanes, dtype=np.int32)
            for t in range(steps):
                m = active[t]
                s = state[:m]
                cell = s + symbols[t, :m]
                new = np.not_equal(table_.owner.take(cell), s, out=begun[t, :m])
                s[:] = np.where(new, first[t, :m], table_.next.take(cell))
                states[t, :m] = s
            known = np.zeros(lanes, dtype=np.int32)  # the state that a lane has been parsed from
            todo = np.flatnonzero(before >= 0)
            while len(todo):
                enter = states[size[before[todo]] - 1, before[todo]]
                todo, enter = todo[enter != known[todo]], enter[enter != known[todo]]
                known[todo] = enter
                lane, s, t, ended = todo, enter, 0, []
                while len(lane):
                    fine = t < size[lane]
                    ended.append(lane[~fine])
                    lane, s = lane[fine], s[fine]
                    if not len(lane):
                        break
                    cell = s + symbols[t, lane]
                    new = table_.owner.take(cell) != s
                    s = np.where(new, first[t, lane], table_.next.take(cell))
                    begun[t, lane] = new
                    apart = states[t, lane] != s
                    states[t, lane] = s
                    lane, s, t = lane[apart], s[apart], t + 1
                changed = np.zeros(lanes, dtype=bool)
                if ended:
                    changed[np.concatenate(ended)] = True
                todo = np.flatnonzero((before >= 0) & changed[np.maximum(before, 0)])
            count = np.zeros(lanes, dtype=np.int64)
            for t in range(steps):
                count[: active[t]] += begun[t, : active[t]]
            out[i] = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        return out, n, letters[b] - letters[a]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The languages; in [0, 1], how far their rates are below the next: 1 - best / second; and the best language's bits a symbol, its last phrase left out, as the text's end cuts it. 0 for und; score 1 if one language is known."""
        langs, scores, bits = [], [], []
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < AT_ONCE):
                part.append((texts[at] or "").lower())
                size += len(part[-1])
                at += 1
            if not self.langs:
                langs += [UND] * len(part)
                scores += [0.0] * len(part)
                bits += [0.0] * len(part)
                continue
            count, n, letters = self.phrases(part)
            rate = count * np.array(self.bits)[:, None]
            best = rate.argmin(axis=0)  # ties: the first language in code point order
            low = rate[best, np.arange(len(part))]
            rate[best, np.arange(len(part))] = np.inf
            second = rate.min(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(np.isfinite(second), 1 - low / np.maximum(second, 1e-9), 1.0)
            for b, s, x, y, k in zip(best, score, letters, low, n):
                langs.append(self.langs[b] if x else UND)
                scores.append(float(s) if x else 0.0)
                bits.append(float((y - self.bits[b]) / k) if x else 0.0)
        return langs, scores, bits


_MODELS: dict = {}


def model(key: str, samples: dict) -> Model:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(samples)
    return _MODELS[key]


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held: int = HELD, n_docs: int = DOCS, n_chars: int = CHARS) -> tuple[dict[str, list[str]], list[int]]:
    """learn()'s samples, and text_key() of the texts that they were taken from."""
    text = col(text_col)
    h = F.xxhash64(col(id_col), text)
    at = F.pmod(h, F.greatest(F.length(text) - n_chars, F.lit(0)) + 1).cast("int") + 1
    d = docs.where(text.isNotNull() & col(lang_col).isNotNull() & (bucket(col(id_col), folds) != held))
    d = d.select(col(lang_col).alias("lang"), h.alias("h"), F.substring(text, at, F.lit(n_chars)).alias("w"), text_key(text).alias("t"))
    d = d.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "w"))).where(F.col("k") <= n_docs)
    out: dict[str, list[str]] = {}
    rows = d.orderBy("lang", "k").collect()
    for r in rows:
        out.setdefault(r["lang"], []).append(r["w"])
    return out, sorted({r["t"] for r in rows})


def text_key(text: Column) -> Column:
    return F.xxhash64(F.lit(2), text)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held: int = HELD, n_docs: int = DOCS, n_chars: int = CHARS) -> dict[str, list[str]]:
    """The samples: for each language n_docs documents first by a hash of id and text, a window of n_chars of each. No rows, or none with a lang: no samples.

    Rows with null text, lang or id, and those whose crc32(id) mod folds is held, aren't used. What reaches the driver
    is bounded by languages * n_docs * n_chars; each task keeps n_docs rows a language before the shuffle.
    """
    return drawn(docs, id_col, text_col, lang_col, folds, held, n_docs, n_chars)[0]


def identify(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, and lang_pred, score and bits, the best language's bits a symbol (under free names if those are taken).

    Null texts and texts without a letter: und, score and bits 0; ties: the first language in code point order; no
    samples: und. Repeated rows get the same answer; long texts are parsed whole; no rows: no rows.
    """
    import hashlib

    key = hashlib.md5(repr(sorted(samples.items())).encode()).hexdigest()

    @F.pandas_udf("lang string, score double, bits double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(key, samples)
        for texts in batches:
            langs, scores, bits = m.predict(texts.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores, "bits": bits})

    lang, score, bits, all_ = fresh(docs, "lang_pred", "score", "bits", "lang_all")
    out = docs.withColumn(all_, predict.asNondeterministic()(col(text_col)))  # so that a filter on it doesn't evaluate it once more
    return out.select(*[col(c) for c in docs.columns], col(all_)["lang"].alias(lang), col(all_)["score"].alias(score), col(all_)["bits"].alias(bits))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(spread(docs.select("doc_id", "text")), learn(docs)).select("doc_id", F.coalesce(bucket(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: A text goes if it takes more than REJECT times the bits a symbol that labelled documents take at the median; a label is overruled from this score on.
REJECT, OVERRULE = 3.0, 0.3
#: decimals of the bits whose median is taken: exact on these, it needs a count a value, of which there are few, and not every document's bits in one task
PLACES = 3


def usual_bits(told: DataFrame, learned: list[int], text_col: str = "text", lang_col: str = "lang") -> float:
    """The median bits a symbol, to PLACES decimals, of all labelled documents with letters but those that a sample was taken from; infinite if there are none. told is identify()'s."""
    pred, _, bits = map(col, told.columns[-3:])
    others = told.where(col(lang_col).isNotNull() & (pred != UND) & ~text_key(col(text_col)).isin(learned))
    usual = others.agg(F.median(F.round(bits, PLACES)).alias("usual")).first()["usual"]
    return math.inf if usual is None else usual


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language, with lang set by the method where it is null or overruled.

    What goes: null texts, texts without a letter, and texts that no language's sample parses into phrases of a usual
    length (random letters, scripts that weren't learned). Without labelled documents nothing can be said: all stay as they are.
    Each text is parsed once: the parsed table is written, and both the usual length and the decisions are read off it.
    """
    samples, learned = drawn(docs)
    if not any(c.isalpha() for v in samples.values() for w in v for c in w.lower()):
        return docs
    out = written(identify(docs, samples), "parsed")
    pred, score, bits = map(col, out.columns[-3:])
    lang = F.when(col("lang").isNull() | (score >= OVERRULE), pred).otherwise(col("lang"))
    return out.where((pred != UND) & (bits <= REJECT * usual_bits(out, learned))).select(*[lang.alias(c) if c == "lang" else col(c) for c in docs.columns])
