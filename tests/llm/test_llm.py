import os
import random

import numpy as np
import pytest

pytest.importorskip("relgraph.llm")

from relgraph.llm import leakage as L  # noqa: E402
from relgraph.llm import names as N  # noqa: E402
from relgraph.llm import reading as R  # noqa: E402
from relgraph.llm.boosting import BoostedTrees  # noqa: E402
from relgraph.llm.tokenizer import TOKENIZER_DIR, VOCABULARY, Encoder, encode_corpus, load_ranks, merge_long, merge_short  # noqa: E402

has_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZER_DIR, VOCABULARY)), reason="no vocabulary")


# Tokenizer ---------------------------------------------------------------------------------------------------------


@has_vocabulary
def test_encoder_agrees_with_library_and_round_trips():
    import tiktoken

    from relgraph.llm.tokenizer import WORD_PATTERN

    ranks = load_ranks(os.path.join(TOKENIZER_DIR, VOCABULARY))
    theirs = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = Encoder(ranks)
    rng = random.Random(4)
    texts = ["", "a", "  two  spaces \r\n\t", "<|endoftext|>", "don't WE'LL 12345", "漢字 🙂 naïve x", "x" * 5000, "\n" * 300]
    texts += ["".join(rng.choice("abeint rs,.é\n漢1") for _ in range(n)) for n in (10, 200, 3000)]
    for t in texts:
        assert mine.encode(t) == theirs.encode_ordinary(t)
        assert theirs.decode(mine.encode(t)) == t
    for n in (1, 2, 17, 128, 700):
        word = bytes(rng.choice(b"abcdeth\xc3\xa9") for _ in range(n))
        assert merge_short(word, ranks) == merge_long(word, ranks)


@has_vocabulary
def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "hello world", "q"), (3, "hello world", "q"), (None, " ", "q")], "doc_id long, text string, ids string")
    got = encode_corpus(df, "doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == [("1", []), ("2", []), ("3", [31373, 995]), ("3", [31373, 995]), ("None", [220])]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# Leakage -----------------------------------------------------------------------------------------------------------


def _edit(rng, tokens, n):
    out = list(tokens)
    for _ in range(n):
        i = rng.randrange(1, len(out) - 1)
        k = rng.randrange(3)
        if k == 0:
            out[i] = "altered"
        elif k == 1:
            out.insert(i, "added")
        else:
            del out[i]
    return out


def _has_exact(item, doc):
    """EXACT_WORDS consecutive words of the item, however the document parts them."""
    ends, joined = {0}, ""
    for t in doc:
        joined += t
        ends.add(len(joined))
    for i in range(len(item) - 12):
        run = "".join(item[i : i + 13])
        if any(joined.startswith(run, p) and p + len(run) in ends for p in ends):
            return True
    return False


def _has_loose(item, doc):
    """Every beginning of a passage against the whole document, without bands: least edits, joined words for nothing."""
    m = len(doc)
    for i in range(len(item) - 23):
        rows = [[0] * (m + 1)]
        for n in range(1, min(47, len(item) - i) + 1):
            t, prev = item[i + n - 1], rows[-1]
            row = [prev[0] + 1]
            for j in range(1, m + 1):
                v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (doc[j - 1] != t))
                if j > 1 and doc[j - 2] + doc[j - 1] == t:
                    v = min(v, prev[j - 2])
                if n > 1 and item[i + n - 2] + t == doc[j - 1]:
                    v = min(v, rows[-2][j - 1])
                row.append(v)
            rows.append(row)
            if n >= 24 and min(row) <= n // 8:
                return True
            if min(row) > 5:
                break
    return False


@pytest.mark.parametrize("letters", ["abcdefghij", "абвгдежзик漢字語"])
def test_filter_loses_nothing(letters):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 10)))
    items = [(i, " ".join(word() for _ in range(55))) for i in range(6)]
    index = L.ItemIndex(items)
    for trial in range(60):
        i, text = rng.choice(items)
        t = text.split()
        loose = trial % 2
        n = rng.randrange(24, 48) if loose else 13
        a = rng.randrange(0, len(t) - n + 1)
        part = _edit(rng, t[a : a + n], n // 8) if loose else t[a : a + n]
        doc = [word() for _ in range(rng.randrange(0, 60))] + part + [word() for _ in range(rng.randrange(0, 60))]
        want = [k for k, x in items if _has_exact(x.split(), doc) or _has_loose(x.split(), doc)]
        assert i in want
        assert index.leaked(doc) == sorted(want)
        cut = _edit(rng, _edit(rng, doc, 8), 6)  # mostly too many edits
        assert index.leaked(cut) == sorted(k for k, x in items if _has_exact(x.split(), cut) or _has_loose(x.split(), cut))


def test_long_items_and_repeating_words():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("бвгджзклмнпрст") for _ in range(rng.randrange(3, 9)))
    long = [word() for _ in range(240_000)]
    index = L.ItemIndex([(1, " ".join(long)), (2, " ".join(word() for _ in range(80)))])
    assert len(index.texts[0]) > 1_200_000
    assert L.leaked("xx " * 3 + " ".join(long[-60:-20]), index) == [1]
    part = long[-60:-20]
    part[5] = part[17] = part[30] = "other"
    assert L.leaked(" ".join([word() for _ in range(3000)] + part), index) == [1]
    assert L.leaked(" ".join(word() for _ in range(3000)), index) == []
    again = L.ItemIndex([(1, "ha " * 300 + "the end"), (2, "so it goes " * 100)])
    assert L.leaked("ha " * 20_000, again) == [1] and L.leaked("ha xo " * 20_000, again) == []


def test_long_words_and_word_breaks():
    item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}rd" for i in range(60)]
    index = L.ItemIndex([(1, " ".join(item))])
    doc = item[:24]
    doc[3:3] = ["x" * 50_000]
    doc[12] = "y" * 70_000
    assert L.leaked(" ".join(doc), index) == [1]
    doc = item[:24]
    doc[10:12] = ["".join(doc[10:12])]
    doc[4:6] = ["".join(doc[4:6])]
    doc[6], doc[15], doc[19] = "other", "other", "other"
    assert L.leaked(" ".join(doc), index) == [1]


def test_leak_limits_and_disguises(spark):
    item = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    text = " ".join(item)
    short = " ".join(item[5:17])
    four = item[:24]
    for i in (3, 9, 15, 21):
        four = four[:i] + ["other"] + four[i + 1 :]
    three = item[:24]
    for i in (4, 12, 20):
        three = three[:i] + ["other"] + three[i + 1 :]
    docs = {
        1: " ".join(item[5:18]), 2: "xyz " + short + " end", 3: " ".join(three), 4: " ".join(four), 5: " ".join(item[5:18]).upper().replace(" ", ", "),
        6: "<p>" + " ".join(f"<b>{w}</b>" if i % 3 else w for i, w in enumerate(item[5:18])) + "</p>", 7: " ".join(item[5:10]) + " wor-\nd" + " ".join(item[10:18])[4:],
        8: None, 9: "", 10: "x" + " ".join(item[5:18]) + "y", 11: "filler " * 60_000 + " ".join(item[5:18]), 12: " ".join(w[:2] + "​" + w[2:] for w in item[5:18]),
    }
    d = spark.createDataFrame([(k, t, "z") for k, t in docs.items()] + [(1, docs[1], "z")], "doc_id int, text string, item_id string")
    i = spark.createDataFrame([(7, text, "z"), (8, None, "z"), (9, "too short", "z")], "item_id int, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {(k, 7) for k in (1, 3, 5, 6, 7, 11, 12)}
    assert L.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0 and L.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


# Reading levels ----------------------------------------------------------------------------------------------------

WORDS = ["the cat sat on a mat we go up", "people send boxes because trucks were late today", "although managers requested additional shipments production continued", "organisational considerations necessitated comprehensive documentation", "epistemological heterogeneity notwithstanding jurisdictional indeterminacy presupposes"]


def _text(rng, level, n=60):
    return ". ".join(" ".join(rng.choice(WORDS[level - 1].split()) for _ in range(4 + 3 * level)) for _ in range(n // (4 + 3 * level) + 1))


def test_boosting_learns_and_cross_validates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + x[:, 1]
    m = BoostedTrees(trees=80).fit(x[:400], y[:400])
    assert np.mean((m.predict(x[400:]) - y[400:]) ** 2) < 0.15 * y.var()


def test_reading_levels(spark):
    rng = random.Random(2)
    rows = [(i, _text(rng, i % 5 + 1), rng.choice(["en", None]), f"s{i % 7}", "z") for i in range(150)]
    rated = [(i, "r", i % 5 + 1) for i in range(0, 150, 2)] + [(0, "r", 1), (2, None, None), (4, "r", 9), (999, "r", 3)]
    extra = [(900, None, "en", "s0", "z"), (901, "", "en", None, "z"), (902, "123 !?", None, "s0", "z"), (903, "hallo welt", "de", "s0", "z"), (904, "Cat", "en", None, "z"), (905, _text(rng, 4, 60_000), "en", None, "z")]
    d = spark.createDataFrame(rows + extra + rows[:3], "doc_id int, text string, lang string, source string, reading_level string")
    r = spark.createDataFrame(rated, "doc_id long, rater string, reading_level int")
    got = R.reading_levels(d, r).toPandas()
    assert got["doc_id"].is_unique and set(got["doc_id"]) == set(range(150)) | {904, 905}
    level = dict(zip(got["doc_id"], got["reading_level"]))
    assert np.mean([level[i] == i % 5 + 1 for i in range(1, 150, 2)]) > 0.95 and level[905] == 4
    cv = R.cross_validation(d, r).toPandas()
    assert (cv["exact"] * cv["n_documents"]).sum() / cv["n_documents"].sum() > 0.9
    assert set(R.reading_levels(d, r.limit(0)).toPandas()["reading_level"]) == {3}
    assert R.reading_levels(d.limit(0), r).count() == 0


# Names -------------------------------------------------------------------------------------------------------------


def test_name_words():
    assert N.name_words("Hilbramfe Fulosston S.p.A.") == ["fulosston", "hilbramfe"]
    assert N.name_words("  MÖKIMRIN/Lumtrospan G.m.b.H. ") == ["lumtrospan", "mokimrin"]
    assert N.name_words("Dibunwo &amp; Dbisstul, Ltd.") == ["dbisstul", "dibunwo"]
    assert N.name_words("DusfiviFofigu of the Group") == ["dusfivi", "fofigu"]
    assert N.edits("karte", "kraet", 3) == 2 and N.edits("abc", "abcdefg", 2) == 3


def _clusters(spark, names):
    df = spark.createDataFrame([(i, n, "z") for i, n in enumerate(names)], "id int, name string, entity string")
    out = {}
    for r in N.same_names(df, "id", "name").collect():
        out.setdefault(r["entity"], set()).add(r["id"])
    return {frozenset(v) for v in out.values()}


def test_same_names(spark):
    names = [
        "Wotisom Fokonvi Bearings Ltd", "Fokonvi, Wotisom Bearings Limited", "WOTISOM FOKONIV BEARINGS", "Wotisom Fokon. Brgs", "WotisomFokonvi Bearings",
        "Wotisom Tremandel Bearings Ltd", "Tremandel Kasbrunno Springs AG", "Tremandel-Kasbruno Sprgs A.G.", "Bill Hurtnevo Dasmilka Optics", "William Hurtnevo Dasmilka Optics",
        None, "", "Ltd", "Wotisom Fokonvi Bearings Ltd",
    ]
    got = _clusters(spark, names)
    assert frozenset({0, 1, 2, 3, 4, 13}) in got and frozenset({6, 7}) in got and frozenset({8, 9}) in got and frozenset({5}) in got
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    pairs = {(r["a"], r["b"]) for r in N.same_name_pairs(df, "id", "name").collect()}
    assert (0, 13) in pairs and (6, 7) in pairs and (0, 5) not in pairs and len(pairs) == 15 + 1 + 1
    assert N.same_names(df.limit(0), "id", "name").count() == 0


def test_many_spellings_of_one_firm(spark):
    """A firm holds together however many spellings it has, and however large a share of all names."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    firm = set()
    while len(firm) < 40:
        w = list("Tremandelo Kasbrunnova Springs")
        i = rng.randrange(1, len(w) - 1)
        w[i] = rng.choice("abdeiklmnorstu")
        firm.add("".join(w))
    got = _clusters(spark, sorted(firm) + [f"{word()} {word()}" for _ in range(80)])
    assert frozenset(range(len(firm))) in got


def test_slips_at_either_end_meet(spark):
    got = _clusters(spark, ["Volkswagen", "Volkswagne", "Tremandel Optics", "Rtemandel Optics", "Kasbrunno", "Kabsrunno", "Precision Bearings", "Precison Bearings", "Bill Steel", "William Steel"])
    assert got == {frozenset({i, i + 1}) for i in range(0, 10, 2)}


def test_a_shared_part_is_not_enough(spark):
    names = ["Thomas Kasbrunno Optics", "George Kasbrunno Optics", "Kasbrunno Bearings GmbH", "Kasbrunno Transport Inc", "Wotisom Fokonvi Bearings", "Wotisom Tremandel Bearings", "Lafela Wirtviham Precision Bearings"]
    assert _clusters(spark, names) == {frozenset({i}) for i in range(len(names))}


def test_pairing_of_words():
    same = N.SameWord(frozenset({"precision", "tools", "forgings", "coatings", "castings"}))
    off = lambda a, b: N.pair_off(a.split(), b.split(), same)
    assert off("motapel precision tools", "motpel tools") and off("motpel tools", "motapel precision tools") and not off("motapel tools", "motapel")
    assert off("forge kasbrunno", "forgings kasbrunno") and not off("coatings kasbrunno", "castings kasbrunno")
    assert off("hilwalgo ted", "e hilwalgo") and off("hilwalgo t ted", "hilwalgo ted") and not off("george hilwalgo", "hilwalgo thomas")
    assert off("kasbr. tls", "kasbrunno tools") and off("somhenstesfistonma", "fistonma somhenstes") and not off("x " + "ab " * 3000, "y " + "cd " * 3000)


def test_cosine_pairs_are_exact(spark, monkeypatch):
    """Every pair that brute force finds, for hot grams split in blocks too."""
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    texts = sorted({" ".join(sorted(rng.choice(parts) for _ in range(rng.randrange(1, 4)))) for _ in range(150)} | {" ".join(parts) * 40})
    bags = [N._codes(t.split(" ")) for t in texts]
    codes, counts = np.unique(np.concatenate(bags), return_counts=True)
    weights = N.Weights(len(texts), codes, counts)
    vectors = [dict(zip(*(x.tolist() for x in weights.vector(t.split(" "))[:2]))) for t in texts]
    want = {(a, b): sum(w * vectors[b].get(g, 0.0) for g, w in vectors[a].items()) for a in range(len(texts)) for b in range(a + 1, len(texts))}
    want = {k: v for k, v in want.items() if v >= N.LINK}
    df = spark.createDataFrame(list(enumerate(texts)), "node long, core string")
    for size in (20_000, 4):
        monkeypatch.setattr(N, "BLOCK_NAMES", size)
        monkeypatch.setattr(N, "PORTION", 4_000_000 if size > 4 else 50)
        rows = N.cosine_pairs(df, len(texts)).collect()
        got = {(r["a"], r["b"]): r["sim"] for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_texts_travel_and_are_told_apart_where_they_meet(spark, monkeypatch):
    """Passes over shares of the grams give every pair once; pairs turned down are never written, nor are vectors."""
    rng = random.Random(10)
    texts = sorted({" ".join(sorted("".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(2))) for _ in range(120)})
    df = spark.createDataFrame(list(enumerate(texts)), "node long, core string")
    told = lambda: lambda x, y: x[0] == y[0]
    every = {(r["a"], r["b"]): r["sim"] for r in N.cosine_pairs(df, len(texts)).collect()}
    want = {k: v for k, v in every.items() if texts[k[0]][0] == texts[k[1]][0]}
    assert 0 < len(want) < len(every)
    one = N.cosine_pairs(df, len(texts), told=told)
    assert "array<" not in one._jdf.queryExecution().analyzed().treeString()
    monkeypatch.setattr(N, "PASS_NAMES", 50)
    for got in (one.collect(), N.cosine_pairs(df, len(texts), told=told).collect()):
        assert len(got) == len(want) and {(r["a"], r["b"]): r["sim"] for r in got} == want
    for texts in (["ab. cd", "x", "漢字語 é"], ["x𐐀y zzzzz", "a"], []):
        owner, codes = N.text_codes(texts)
        assert [codes[owner == k].tolist() for k in range(len(texts))] == [N._codes(t.split(" ")) for t in texts]


def test_average_linkage(spark):
    rng = random.Random(8)
    pairs = {(a, b): round(rng.random(), 3) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.45}
    got = N.average_linkage(spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, sim double"), 0.3)
    sets = [{i} for i in sorted({x for p in pairs for x in p})]
    mean = lambda x, y: sum(pairs.get((min(i, j), max(i, j)), 0.0) for i in x for j in y) / len(x) / len(y)
    while True:  # one merge at a time
        best = max(((mean(x, y), i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j), default=(0, 0, 0))
        if best[0] < 0.3:
            break
        sets[best[1]] |= sets.pop(best[2])
    out = {}
    for r in got.collect():
        out.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, out.values())) == sorted(map(sorted, sets)) and all(k == min(v) for k, v in out.items())


def test_queries_have_the_stated_columns(spark):
    from relgraph.llm.queries import QUERIES

    assert set(QUERIES) >= {"p5_found", "p7_ids", "p8_found", "p9_found"}
