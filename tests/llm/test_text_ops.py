import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import clashing, empty_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import agree
from pyspark.sql import functions as F

from quern.llm import chat, langid, mixing, packing, registry, secret_scan, toxicity
from quern.llm.common import table


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    agree(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


# language ID


def phrases(text, sample_docs):
    """Greedy parse by hand: phrases are the longest strings that a sample document holds."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and any(text[at : at + k + 1] in d for d in sample_docs):
            k += 1
        at += k
        n += 1
    return n


def test_phrases_are_those_of_a_greedy_parse():
    m = langid.Model({"x": ["abracadabra alakazam", "hocus pocus abra"], "y": ["mississippi river", "issip"]})
    for t in ("abra cadabra pocus", "sip river zam", "q", "a", "xyzzy miss"):
        got = m.phrases([t])[0][:, 0].tolist()
        assert got == [phrases(t, ["abracadabra alakazam", "hocus pocus abra"]), phrases(t, ["mississippi river", "issip"])]


def test_long_texts_are_parsed_as_one():
    """Blocks of the parse leave no trace, whatever state they are entered in."""
    r = random.Random(3)
    docs = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(80)) for _ in range(3)]
    m = langid.Model({"x": docs, "y": ["mississippi river"]})
    for n in (3, 100, 700, 1500, 3000):
        t = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(n // 3))
        assert m.phrases([t, "zz", t[::-1]])[0][0].tolist() == [phrases(t, docs), 2, phrases(t[::-1], docs)]
    own = " ".join(docs[0] for _ in range(1))
    assert len(own) > 150 and langid.Model({"x": [own * 5]}).phrases([own * 5])[0].tolist() == [[1]]


def test_every_letter_of_a_sample_counts():
    """Scripts of many letters stay whole: 600 ideographs are 600 symbols."""
    han = "".join(chr(0x4E00 + i) for i in range(600))
    m = langid.Model({"zh": [han[i : i + 100] for i in range(0, 600, 100)], "en": ["the old house by the sea"]})
    assert len({int(m.known[ord(c)]) for c in han}) == 600
    assert m.phrases([han[550:600] + han[0:40]])[0].tolist() == [[2], [90]] or m.langs == ["en", "zh"] and m.phrases([han[550:600] + han[0:40]])[0].tolist() == [[90], [2]]


def test_stage_decides(spark, sf):
    """The stage rejects junk and unlearned scripts, names unlabelled texts, overrules wrong labels, and keeps all where nothing is labelled."""
    docs = table(spark, sf, "documents")
    clean = docs.where("length(text) > 400 and lang = 'de'").limit(3).collect()
    r = random.Random(9)
    rows = [(-1 - i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([("".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(900)), "en"), ("Съешь же ещё этих мягких французских булок " * 9, None), (clean[0]["text"], None), (clean[1]["text"], "en")])]
    got = {x["doc_id"]: x for x in langid.stage(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), sf).collect()}
    assert -1 not in got and -2 not in got and got[-3]["lang"] == "de" and got[-4]["lang"] == "de"
    assert {x["doc_id"] for x in docs.collect()} <= set(got)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(tuple, langid.stage(spark, bare, sf).collect()), key=str) == sorted(map(tuple, bare.collect()), key=str)


def test_stage_goes_by_all_labelled_documents(spark):
    """The usual bits are the median over every labelled document, not over a few more of those that samples are drawn from: 200 documents of freely mixed words outnumber 60 of fixed sentences, and stay."""
    r = random.Random(5)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 7))) for _ in range(60)]
    fixed = [" ".join(r.choice(words) for _ in range(12)) for _ in range(4)]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % langid.FOLDS == langid.HELD][:200]
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % langid.FOLDS != langid.HELD][:60]
    rows = [(i, " ".join(r.choice(fixed) for _ in range(8)), "x", "s", 1) for i in free] + [(i, " ".join(r.choice(words) for _ in range(100)), "x", "s", 1) for i in held]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in langid.stage(spark, docs, "").collect()} == {*free, *held}
    samples, learned = langid.drawn(docs)
    assert samples == langid.learn(docs) and len(samples["x"]) == langid.DOCS
    model, taken = langid.Model(samples), set(learned)
    key = {x["doc_id"]: x["t"] for x in docs.select("doc_id", langid.text_key(F.col("text")).alias("t")).collect()}
    bits = [b for (i, *_), b in zip(rows, model.predict([t for _, t, *_ in rows])[2]) if key[i] not in taken]
    assert langid.usual_bits(langid.identify(docs, samples), learned) == pytest.approx(np.median(bits), abs=1e-3)
    assert langid.usual_bits(langid.identify(docs.where("doc_id < 0"), samples), learned) == float("inf")


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in langid.op6(spark, sf).collect()}
    truth = table(spark, sf, "documents").collect()
    held = [r for r in truth if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == len(truth) and all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_texts(spark):
    docs = clashing(odd_docs(spark))
    samples = {"en": ["the same words here again today with long lines"], "de": ["und der die das nicht ist eine"]}
    out = langid.identify(docs, samples)
    rows = out.collect()
    assert len(rows) == 10 and out.columns[: len(docs.columns)] == docs.columns
    named = {r["doc_id"]: r[out.columns[-3]] for r in rows}
    assert named[1] == named[2] == named[3] == named[6] == "und" and named[4] == "en" and named[8] != "und"
    assert langid.identify(empty_docs(spark), samples).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs(spark), {}).collect()} == {"und"}
    kept = langid.stage(spark, odd_docs(spark), "")
    assert kept.columns == odd_docs(spark).columns and {r["doc_id"] for r in kept.collect()} == {None, 4, 5, 7, 8}


# toxicity


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op1(spark, sf).collect()}
    rows = [(got[r["doc_id"]], r["toxic"]) for r in table(spark, sf, "labels").collect()]
    held = [(p["score"], t) for p, t in rows if p["held_out"]]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos])
    assert auc > 0.9
    assert np.mean([s >= 0.5 for s in pos]) > 0.75 and np.mean([s >= 0.5 for s in neg]) < 0.08
    assert all(p["predicted"] == (p["score"] >= 0.5) and 0 <= p["score"] <= 1 for p, _ in rows)


def test_kernel_by_hand():
    units = ["idiot", "idxiot", "table"]
    def value(u):
        s, out = [31, *toxicity.SYMBOLS[[ord(c) for c in u]].tolist()], {}
        from itertools import combinations
        for n in (3, 4):
            for c in combinations(range(len(s)), n):
                if c[-1] - c[0] < toxicity.SPAN:
                    k = tuple(s[i] for i in c)
                    out[k] = out.get(k, 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out
    def norm(u):
        from itertools import combinations
        return sum(toxicity.DECAY ** (2 * (c[-1] - c[0] + 1)) for n in (3, 4) for c in combinations(range(len(u) + 1), n) if c[-1] - c[0] < toxicity.SPAN) ** 0.5
    want = [[sum(v * value(b).get(k, 0) for k, v in value(a).items()) / norm(a) / norm(b) for b in units] for a in units]
    assert np.allclose(toxicity.kernel(units, units), want)
    assert want[0][1] > 2 * want[0][2]


def test_weights_are_the_svm():
    pos, neg = ["idiot", "moron", "idiots"], ["table", "chair", "window", "thing", "idea"]
    f, w, b = toxicity.train(pos, neg, ["idiot", "moron", "table", "chair"])
    s = toxicity.Scorer(f, w, b)
    v = s.units(pos + neg + ["i" * 5000])
    assert (v[:3] > 0).all() and (v[3:8] < 0).all() and np.isfinite(v).all()
    assert s.units(["idxiot"])[0] > s.units(["table"])[0]
    assert toxicity.units_of("i-d.i*o_t") == ["idiot"] and "idiot" in toxicity.units_of("1d1ot")


def test_sentences():
    assert toxicity.sentences("You i d i o t there. And *i *d *i, o. t.\nno a b") == [["you", "idiot", "there"], ["and", "idiot"], ["no", "a", "b"]]
    assert toxicity.sentences("you i. d. i. o. t. yes") == [["you", "idiot", "yes"]] and toxicity.sentences(None) == toxicity.sentences(" \n ") == []
    long = toxicity.sentences("word " * 100)
    assert [len(s) for s in long] == [48, 48, 4]


def test_scripts_are_told_apart():
    """Insults in letters that aren't Latin are no more alike than Latin ones."""
    k = toxicity.kernel(["дурак", "дурраак", "окно", "стол", "바보", "창문"], ["дурак", "바보"])
    assert k[0, 0] > 0.5 and k[1, 0] > 2 * max(k[2, 0], k[3, 0]) and k[4, 1] > k[5, 1] + 0.2


def test_learns_other_scripts_and_without_strong_evidence(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, f"мы дошли до дома {i}. ты дурак и осёл" if i % 2 else f"мы дошли до старого дома {i}. окно и стол"  ) for i in range(60)], "doc_id bigint, text string")
    model = toxicity.learn(docs, labels, min_evidence=10_000.0)
    assert toxicity.score(docs, model).where("predicted <> doc_id % 2").count() == 0
    new = spark.createDataFrame([(1, "он дуррак"), (2, "он вошёл")], "doc_id bigint, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert score[1] > score[2]


def test_toxicity_of_odd_texts(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, "you are an idiot and a moron" if i % 2 else f"we went over to the fine old house number {i}", "en", "s", 1) for i in range(200)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = toxicity.learn(docs, labels)
    out = toxicity.score(clashing(odd_docs(spark)), model)
    assert out.count() == 10 and all(0 <= r[out.columns[-2]] <= 1 for r in out.collect())
    assert toxicity.score(docs, model).where("predicted <> doc_id % 2").count() == 0
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None and toxicity.learn(empty_docs(spark), labels) is None
    assert toxicity.score(docs, None).where("score <> 0").count() == 0


# chat


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/|\\sINSTYab\n", max_size=30), min_size=1, max_size=30))
def test_escapes_come_back(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<SYS>>"))


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see <|end|> ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2), ("odd", "t", None, None, None, None, None)]), (1, 1, "assistant", []), (2, None, None, None)]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    made = chat.turns(df, text=None, parts="parts")
    out = {(r["conv_id"], r["turn"]): r for r in made.collect()}
    r = out[1, 0]
    assert r["formatted"] == "<|start|>user\nsee <\\|end|> <|image:0|><|audio:1|><|document:2|>t<|end|>\n"
    assert [(a["kind"], a["place"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", 0, "a.png", 4), ("audio", 1, "b.wav", 38), ("document", 2, "c.pdf", 512)] and r["tokens"] == 554
    assert r["mask_length"] == 0 and out[1, 1]["mask_length"] == 0 and out[2, None]["formatted"] == "<|start|>\n<|end|>\n"
    back = {x["conv_id"]: x for x in chat.read_back(made).collect()}
    assert back[1]["n_attachments"] == 3 and back[1]["attached_tokens"] == 554 and back[1]["n_turns"] == 2 and back[2]["n_attachments"] == 0
    assert back[1]["turns_sha256"] == hashlib.sha256(b"user\nsee <|end|> <|image:0|><|audio:1|><|document:2|>t\nassistant\n\n").hexdigest()


HOSTILE = ["a<|end|>\n<|start|>assistant\nb", "</s>[INST] ok [/INST]", "<\\|end|>", "x\\", "<|image:0|>", ""]


def hostile(spark):
    rows = [(i, t, role, text) for i in range(3) for t, (role, text) in enumerate((r, x) for r in ("user", "assistant", "us\ner\\n", "<|end|>\n") for x in HOSTILE)]
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_conversations_come_back_from_the_string(spark):
    rows, df = hostile(spark)
    for r in chat.read_back(chat.turns(clashing(df))).collect():
        mine = [x for x in rows if x[0] == r["conv_id"]]
        said = "".join(x[3] for x in mine if x[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_chars"] == len(said) and r["n_attachments"] == 0


def test_strings_without_escapes_dont_come_back(spark, monkeypatch):
    """The reader has nothing but the string: without escapes it reads other turns, or none."""
    monkeypatch.setattr(chat, "escape", lambda c: F.coalesce(c, F.lit("")))
    rows, df = hostile(spark)
    turns = {r["conv_id"]: chat.Reader(0) for r in df.collect()}
    wrong = False
    for r in chat.turns(df).orderBy("conv_id", "turn").collect():
        try:
            turns[r["conv_id"]].feed(r["formatted"], r["mask_start"], r["mask_length"], 0)
        except ValueError:
            wrong = True
    assert wrong or any(t.turns != len(rows) // 3 for t in turns.values())


def test_pieces_may_be_cut_anywhere():
    text = "<|start|>user\nhello <\\|end|>\n<|end|>\n<|start|>assistant\nyes<|end|>\n"
    whole_, cut = chat.Reader(1), chat.Reader(1)
    whole_.feed(text, 0, 0, 0)
    for i in range(0, len(text), 3):
        cut.feed(text[i : i + 3], 0, 0, 0)
    assert whole_.row() == cut.row() and whole_.row()[1] == 2


def test_read_back_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "x"), (1, None, None, "n"), (None, 0, "assistant", "y"), (2, 0, "user", "z" * 100_000), (1, 1, "assistant", "again")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nn\nuser\nx\nassistant\n\nassistant\nagain\n").hexdigest() and got[1]["loss_chars"] == 5 and got[1]["n_turns"] == 4
    assert got[None]["loss_sha256"] == hashlib.sha256(b"y").hexdigest() and got[2]["loss_chars"] == 0
    assert chat.read_back(chat.turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


# secrets


def base(text):
    import re

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "SECRET", "=", ": ", ":", '"', "abc123", "0123456789abcdef", "AKIA", "ABCDEFGH01", " ", "é", "🙂", "ſecret", "\n", "x", "pwd", "hunter2Z!q"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert [s for s in secret_scan.scan(text) if s[0] != "guess"] == base(text)


def test_guess_cost_is_the_cheapest_segmentation():
    def brute(s):
        segs = [(a, b, x + secret_scan.PER_SEGMENT) for a, b, _, x in secret_scan.segments(s)]
        near = [s[i + 1].lower() in secret_scan.NEAR.get(s[i].lower(), ()) for i in range(len(s) - 1)]
        segs += [(a, b, secret_scan.WALK + secret_scan.PER_SEGMENT + (b - a - 1) * secret_scan.STEP) for a in range(len(s)) for b in range(a + 3, len(s) + 1) if all(near[a : b - 1])]
        def rest(i):
            if i == len(s):
                return 0.0
            c = (0.6 if s[i] in "-_./ " else secret_scan._classes(s)) + rest(i + 1)
            return min([c, *(x + rest(b) for a, b, x in segs if a == i)])
        return rest(0)
    for s in ("password12", "qwerty1987", "aaaa-9$", "x9$kQz", "abcabcab", "P4ssw0rd", "sssssummer", "zqwertyq"):
        assert secret_scan.guess_cost(s) == pytest.approx(brute(s))
    assert secret_scan.guess_cost("password1234") < secret_scan.COST < secret_scan.guess_cost("x9$kQz!82mLp")
    assert [s[0] for s in secret_scan.scan("pwd=x9$kQz!82mLp and passphrase: password")] == ["guess"]


def test_values_are_costed_whole():
    """No length flips the answer: a block said again costs its own segmentation once, and pieces of long values don't add up apart."""
    cost = secret_scan.guess_cost
    for block in ("aB", "qwerty1", "a"):
        for n in (48, 60, 97, 400):
            assert cost(block * n) <= cost(block) + np.log10(n) + 2 * secret_scan.PER_SEGMENT + 1e-9 < secret_scan.COST
    r = random.Random(3)
    v = "".join(r.choice("abcdXYZ0189") for _ in range(97))
    assert cost(v) > cost(v[:96]) > 100
    assert [s[0] for s in secret_scan.scan("passphrase:\tqzvxkjwplmtrhbnü, pwd=" + "aB" * 60)] == ["guess"]
    words = {"wandelbar": 2.0, "steinig": 2.5}
    assert secret_scan.scan("secret note = wandelbarsteinig pwd: wandelbarsteinig", ranks=words) == [] != secret_scan.scan("pwd: wandelbarsteinig")


def test_scan_is_linear():
    import time

    def took(n):
        t = time.perf_counter()
        out = secret_scan.scan("token=abcdefgh12 pwd=x9$kQz!82mLp é " * n)
        assert len(out) == 2 * n
        return time.perf_counter() - t
    took(100)
    assert took(8000) < 16 * took(1000) + 1
    assert secret_scan.scan("pwd=" + "password=" * 20_000) is not None


def test_query_of_secrets_against_brute_force(spark, tmp_path):
    """The registered columns over a fixture: counts, digest and spans, in code points."""
    r = random.Random(5)
    parts = ["password: ", "Token=", "api_key=", "abc123XYZ", "0123456789abcdef" * 2, "AKIA" + "ABCDEFGH01" * 2, " ", "é", "🙂", "\n", "pwd=hunter2Z!q9x", "the house "]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in secret_scan.op4(spark, str(tmp_path)).collect()}
    extra = 0
    for i, t in rows:
        want, x = base(t or ""), got[i]
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(k == n for k, *_ in want) for n in ("assign", "access", "hex"))
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [s.split(":") for s in x["spans"].split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in spans if k != "guess"] == want
        extra += sum(k == "guess" and (t[int(a) : int(b)]).startswith("hunter2") for k, a, b in spans)
    assert extra > 5


def test_ranks_count_words_outside_contexts(spark):
    docs = spark.createDataFrame([("der stein der stein haus pwd=qzvxkj",), ("stein",), (None,), ("",)], "text string").repartition(2)
    got = secret_scan.ranks_of(docs)
    assert sorted(got, key=got.get) == ["stein", "der", "haus", "pwd"] and secret_scan.ranks_of(docs.limit(0)) == {} and len(secret_scan.ranks_of(docs, words=2)) == 2


def test_secrets_of_odd_texts(spark):
    out = secret_scan.find(clashing(odd_docs(spark)))
    assert out.count() == 10 and all(r[out.columns[-1]] == [] for r in out.collect())
    assert secret_scan.find(empty_docs(spark)).count() == 0


# mixing


def test_many_sources_are_joined_salted(spark):
    """Beyond the bound of the broadcast the same rows come out."""
    docs = odd_docs(spark).where("doc_id is not null")
    by = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert by(mixing.mix(docs)) == by(mixing.mix(docs, broadcast=1, salts=3))


def test_mix_of_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 10 and mixing.mix(empty_docs(spark)).count() == 0
    names = mixing.mix(docs).columns[len(docs.columns) :]
    by = {}
    for r in rows:
        size, total, target, copies = (r[n] for n in names)
        by.setdefault(r["source"], [0, total, target])[0] += size
        assert copies <= 2 and target <= 2 * total
    assert all(v[0] == v[1] for v in by.values())
    assert sum(v[2] for v in by.values()) == pytest.approx(1.5 * sum(v[1] for v in by.values()))
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 500, "e": 0, None: 77}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    w = dict(zip(["a", "b", "c", "d", "e", None], [3, 1, 2, 3, 1, 2]))
    left, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    assert got == pytest.approx(want)


# packing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", " ", "\n", "  ", "'s", "'", " é", "ñ", "1", "23", ".", ",", "\t", " ", "　", "\r\n", "日本", "🙂", "<|endoftext|>", "\x1c"]), max_size=16))
def test_ids_are_the_tokenizers(parts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = "".join(parts)
    assert np.frombuffer(packing.encoder(None).ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_with_added_tokens():
    enc, t, r = packing.encoder(None), tokenizer(), random.Random(2)
    parts = ["a", " ", "\n", "  ", "'s", "é", "\n\n", "<|endoftext|>", "<|endoftext|>", "<|", "endoftext|>"]
    for text in ["a <|endoftext|> b", *("".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(300))]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.ids("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1, 2, 31, 32, 1023, 1024, 1025, 2047, 2048, 2049, 4000, 10_000])
def test_cuts(n):
    out = packing.cuts(n)
    assert sum(a for a, _ in out) == n and all(1 <= a <= 2048 // j for a, j in out) and len(out) <= n // 2048 + 12


def whole(rows, texts, capacity=2048):
    """Each document's pieces join to its ids; sequences have no gap."""
    by_seq, by_doc, t = {}, {}, tokenizer()
    assert len({(r["row_id"], r["start"]) for r in rows}) == len(rows)
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    for d, ps in by_doc.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        at = 0
        for r in sorted(ps, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    return len(by_seq), sum(r["length"] for r in rows)


def test_packing_is_whole_and_tight(spark, sf):
    docs = table(spark, sf, "documents")
    n, tokens = whole(packing.op10(spark, sf).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert 1 - tokens / (2048 * n) < 0.01
    n2, t2 = whole(packing.pack(docs.repartition(7)).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert t2 == tokens and n2 <= n + 8


def test_packing_of_odd_rows(spark):
    rows = packing.pack(clashing(odd_docs(spark).where("doc_id <> 4 or doc_id is null")), with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs(spark).collect()}
    whole(rows, texts)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows) and packing.pack(empty_docs(spark)).count() == 0
    assert sum(r["length"] for r in packing.pack(odd_docs(spark).where("doc_id = 4")).collect()) == 2 * packing.pack(odd_docs(spark).where("doc_id = 4").limit(1)).collect()[0]["doc_tokens"]
