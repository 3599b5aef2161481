import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parapet.llm import html_text, language, licences, packing, quality, shared, toxicity

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"en": "the and of that with this from have ing tion".split(),
         "de": "der und die ein nicht mit sich auf für über".split(),
         "fr": "le les une est dans pas pour être où déjà".split()}


def sentences(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


def corpus(spark, n=240):
    rng = random.Random(4)
    langs = sorted(WORDS)
    rows = [(i, sentences(rng, langs[i % 3], rng.randrange(5, 60)), langs[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_of_unseen_texts(spark):
    model = language.fit(language.training_part(corpus(spark)))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 !", "x"), (4, "nicht mit der", None)], SCHEMA)
    rows = {r["doc_id"]: r for r in language.with_language(odd.withColumn("score", F.lit("clash")).withColumn("_spoken", F.lit(1)), model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    rng = random.Random(9)
    test = spark.createDataFrame([(i, sentences(rng, k, 12), k) for i, k in enumerate(sorted(WORDS) * 20)], SCHEMA)
    told = language.with_language(test, model)
    assert told.where("lang = lang_pred").count() >= 57


def test_language_code_lengths_are_exact():
    """Costs of a tiny model, by hand: counts with escapes, down to one of 256."""
    code = lambda s: len(s) << 24 | int.from_bytes(s, "big")
    rows = [(b"", b"a", 3), (b"", b"b", 1), (b"a", b"b", 2)]
    model = language._model(["x"], np.array(["x"] * 3, object), np.array([code(c) for c, _, _ in rows]),
                            np.array([b[0] for _, b, _ in rows]), np.array([n for *_, n in rows]))
    data, offsets = np.frombuffer(b"abz", np.uint8), np.array([0, 3])
    got = language.code_lengths(model, data, offsets)[0, 0]
    # a after nothing: 3 of 4 + 2; b after a: 2 of 2 + 1; z: escape of the empty context, then 8 bits
    want = -np.log2(3 / 6) - np.log2(2 / 3) + (-np.log2(2 / 6) + 8)
    assert abs(got - want) < 0.02


def test_language_without_training_rows(spark):
    empty = corpus(spark).limit(0)
    model = language.fit(empty)
    assert language.with_language(empty, model).count() == 0
    assert language.with_language(corpus(spark, 3), model).where("lang_pred = 'und'").count() == 3


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        kind = i % 4
        words = [f"w{rng.randrange(200)}" for _ in range(20)]
        words += {0: ["scum"], 1: ["mild", "grp"], 2: ["mild"], 3: ["grp"]}[kind]  # 1 is bad only together
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(kind < 2)))
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, known)
    scored = toxicity.with_score(docs.withColumn("score", F.lit("clash")), machine).join(known, "doc_id")
    right = scored.where((F.col("score") >= 0.3).cast("int") == F.col("toxic")).where("doc_id % 4 <> 2")
    assert scored.count() == 1200
    assert right.where("doc_id % 4 = 0").count() == 300
    assert scored.where("score < 0.3 AND toxic = 0").count() >= 0.9 * 600
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "SCUM!!", "x")], SCHEMA)
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(odd, machine).collect()}
    assert got[1] == got[2] < got[3] and got[3] >= 0.3


def test_toxicity_without_labels(spark):
    docs = corpus(spark, 9)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, none)
    assert toxicity.with_score(docs, machine).where("score BETWEEN 0 AND 1").count() == 9
    assert toxicity.with_score(docs.limit(0), machine).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(packing.TOKENIZER))


ODD = ["", None, "Don't stop. It's (fine)!", "ÉTÉ İstanbul ΟΔΟΣ naïve—ok", "a<|endoftext|>b <|ENDOFTEXT|>", "x\x1cy \x02 z",
       "3rd, $5.00!! µm ªº ﬁne", "中文。ok a_b-c", "word. " * 3000, "   nbsp", "é Å"]


def test_packing_holds_every_id_once(spark, tokenizer):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["lorem", "Ipsum", "dolor.", "x!", "çà"]) for _ in range(rng.randrange(0, 900))) for _ in range(80)]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).withColumn("start", F.lit("clash"))
    pieces = packing.pack(rows, with_ids=True).collect()
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for t in texts]
    held = {}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and own.tolist() == p["ids"]
        assert zlib.crc32(own.astype("<u4").tobytes()) == p["ids_crc32"]
        held.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for i, own in enumerate(ids):
        at = 0
        for start, length in sorted(held[i]):
            assert start == at
            at += length
        assert at == len(own)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
        total += at
        padding += 0 if packing.is_power(at) else packing.LENGTH - at
    assert padding <= 0.02 * total
    assert packing.pack(rows.limit(0)).count() == 0


def test_best_cuts_is_optimal():
    """Against all ways to cut, on short streams."""
    rng = random.Random(3)
    length = 64
    for _ in range(30):
        places = np.cumsum([rng.randrange(1, 30) for _ in range(12)])
        costs = np.array([rng.choice([0, 8, 24]) for _ in places])

        def price(cuts):
            at = total = 0
            for c in cuts:
                n = c - at
                if n > length:
                    return float("inf")
                k = places.tolist().index(c)
                exact = n >= 32 and packing.is_power(n)
                total += (0 if exact else length - n) + packing.WINDOW + (costs[k] if c != places[-1] else 0)
                at = c
            return total

        ways = [[int(p) for i, p in enumerate(places) if mask >> i & 1] for mask in range(1 << 12) if mask >> 11 & 1]
        assert price(packing.best_cuts(places, costs, length)) == min(map(price, ways))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies</div><div class="x1"><span>Follow us</span></div>
<article><header><h1>Title &amp; more</h1></header><p><b>One<br>  two&nbsp;three<p>Four</p><ul><li>a<li>b</ul>
<div class="promo">Buy</div><form>Search <input></form></article><section class="comments"><article class="comment">
<p>Nice</p></article></section><aside>Side</aside><footer>&copy; x</footer><script>var a = "<p>no</p>";</script>"""


def test_html_article_only(spark):
    rows = [(1, "http://h.example/1", PAGE), (2, None, None), (3, "http://h.example/3", ""), (4, "x", "plain < text &lt;b&gt;"),
            (5, "http://h.example/5", "<p>a<p>b" + "<div>" * 3000 + "deep"), (5, "http://h.example/5", "<p>a<p>b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_host", F.lit(1)).withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"]) for r in html_text.with_text(pages).collect())
    assert got == [(1, "Title & more\nOne two three\nFour\na\nb"), (2, ""), (3, ""), (4, "plain < text <b>"),
                   (5, "a\nb"), (5, "a\nb\ndeep")]
    assert html_text.with_text(pages.limit(0)).count() == 0


def test_html_templates_go_and_shared_passages_stay(spark):
    """Without an article element only recurrence tells a template."""
    def page(i, article):
        passage = "<p>a passage that all pages share</p>"
        body = f"<div><h2>Story {i}</h2><p>own text of page {i} {'word ' * 40}</p>{passage}</div>"
        box = "<div class='q7'><div>Top stories</div><div>Weather</div></div>"
        return f"<body>{box}{'<article>' + body + '</article>' if article else body}<div>Imprint</div></body>"

    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i, i % 2 == 0)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.with_text(pages).collect():
        assert r["text"] == f"Story {r['page_id']}\nown text of page {r['page_id']} {('word ' * 40).strip()}\na passage that all pages share"
    few = html_text.with_text(pages.where("page_id in (1, 3)")).collect()  # too few pages to tell
    assert all(r["text"].startswith("Top stories\nWeather") for r in few)


def test_licences(spark):
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "released under THE mit license"), (3, None), (4, ""),
            (5, "nothing of the kind"), (2, "Released under the MIT License.\nReleased under the MIT License!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", F.lit(1))
    got = sorted((r["doc_id"], r["licence"], r["dice"]) for r in licences.scan(docs).collect())
    assert got == [(1, "Apache-2.0", 1.0), (2, "MIT", 1.0)]
    part = licences.scan(docs, [("x", "a text nothing of the kinds")], 0.6).collect()
    assert [(r["doc_id"], round(r["dice"], 6)) for r in part] == [(5, round(2 * 2 / 7, 6))] or part == []
    assert licences.scan(docs.limit(0)).count() == 0


def kneser_ney(texts, order=4):
    """Interpolated modified Kneser-Ney over bytes, straight from the definition."""
    from collections import Counter

    counts = {order: Counter()}
    for t in texts:
        b = bytes(order - 1) + t.encode()
        counts[order].update(b[i:i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(c):
        n = [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        part = lambda k, a, b: min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) if a else k / 2
        return [part(1, n[0], n[1]), part(2, n[1], n[2]), part(3, n[2], n[3])]

    d = {k: discount(c) for k, c in counts.items()}
    sums = {}
    for k, c in counts.items():
        for g, v in c.items():
            s = sums.setdefault(g[:-1] + bytes([0]) * 0, {}).setdefault(k, [0, 0.0])
            s[0] += v
            s[1] += d[k][min(v, 3) - 1]

    def p(gram):
        if not gram:
            return 1 / 256
        below = p(gram[1:])
        s = sums.get(gram[:-1], {}).get(len(gram))
        if s is None:
            return below
        v = counts[len(gram)].get(gram, 0)
        return (max(v - d[len(gram)][min(v, 3) - 1], 0) if v else 0) / s[0] + s[1] / s[0] * below

    return p


def test_quality_perplexity_equals_the_definition(spark):
    rng = random.Random(6)
    good = [sentences(rng, "en", 30) for _ in range(25)]
    texts = good + ["###$$$ %%%", "", None, sentences(rng, "en", 5), "the"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(99, "ohne", "de"), (98, "x", None)], SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(25)] + [(None,)], "doc_id long")
    rows = {r["doc_id"]: r for r in quality.classify(docs.withColumn("_id", F.lit(1)), trusted, calibration=0.0).collect()}
    p = kneser_ney(good)
    for i, t in enumerate(texts):
        if t:
            b = bytes(3) + t.encode()
            logs = [np.log(p(b[k:k + 4])) for k in range(len(b) - 3)]
            assert rows[i]["perplexity"] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-9)
        else:
            assert rows[i]["perplexity"] is None and not rows[i]["kept"]
    assert not rows[25]["kept"] and rows[0]["kept"]
    assert rows[99]["perplexity"] == pytest.approx(256) and rows[99]["kept"] and rows[98]["kept"]
    assert quality.classify(docs.limit(0), trusted).count() == 0


def test_quality_tells_good_words_in_a_bad_order(spark):
    """Every byte context of the shuffled and repeated words occurs in trusted text."""
    rng = random.Random(8)
    names = [x + "tion" for x in ["bal", "cor", "dun", "fel", "gim", "hov", "jat", "kel", "lum", "mer", "nop", "pis"]]
    after = {w: names[(5 * i + 3) % 12] for i, w in enumerate(names)}  # a word tells the next one, bytes don't tell words

    def good(n):
        w, out = rng.choice(names), []
        for _ in range(n):
            out.append(w)
            w = after[w] if rng.random() < 0.9 else rng.choice(names)
        return out

    shuffled = good(60)
    rng.shuffle(shuffled)
    texts = [" ".join(good(60)) for _ in range(300)] + [" ".join(shuffled), " ".join(["baltion"] * 60), " ".join(good(60))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(900, "", "en"), (901, "x y", "de")], SCHEMA)
    rows = {r["doc_id"]: r for r in quality.classify(docs, docs.where("doc_id < 300").select("doc_id")).collect()}
    assert not rows[300]["kept"] and not rows[301]["kept"] and rows[302]["kept"]
    assert rows[900]["perplexity"] is None and not rows[900]["kept"] and rows[901]["perplexity"] == pytest.approx(256)
    bytes_only = {r["doc_id"]: r for r in quality.classify(docs, docs.where("doc_id < 300").select("doc_id"), words=0).collect()}
    assert bytes_only[300]["kept"]
    model = quality.train_words(docs.where("doc_id < 100"), quality.WORDS)
    assert model.count() > quality.train_words(docs.where("doc_id < 3"), quality.WORDS).count()


def test_quality_by_parts_is_the_same_and_frees_its_tables(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab cd ef gh kl mn op".split()) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "zz"]
    once = spark.createDataFrame([(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    docs = once.union(once)  # equal blocks
    trusted = once.where("doc_id % 2 = 0 AND lang IS NOT NULL")
    folders = iter(range(1_000))
    monkeypatch.setattr(shared, "shared_folder", lambda _, name: f"{tmp_path}/{name}-{next(folders)}")

    def rows(*sizes):
        return sorted(quality.scores_in_rounds(docs, trusted, 3, *sizes).collect(), key=lambda r: (r["doc_id"], str(r["lang"])))

    whole = rows(1, 1)
    monkeypatch.setattr(quality, "FEW_BLOCKS", 0)
    parts = rows(4, 2)
    assert len(whole) == len(parts) == 2 * len(texts)
    for a, b in zip(whole, parts):
        assert a[:3] == b[:3]
        assert a["perplexity"] == b["perplexity"]
        assert (a["word_perplexity"] or 0) == pytest.approx(b["word_perplexity"] or 0, rel=1e-12)
    assert {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()} == {"kn-scores"}


def test_word_probabilities_add_up(spark):
    """Over all words seen after a context, with the rest left to spelling."""
    text = "a b a c a b c b a c c a"
    model = quality.train_words(spark.createDataFrame([(1, text, "en")], SCHEMA), 2).toPandas().sort_values("key")
    table, values = model["key"].to_numpy(), [model[c].to_numpy(float) for c in ("num", "total", "rest")]
    mass = 0.0
    for w in "abc":
        data = np.frombuffer(f"b {w}".encode(), np.uint8)
        *_, found = quality.word_grams(data, np.array([0, len(data)]), "en", 2)
        mass += np.exp(quality._word_logs(found, np.full(2, -np.inf), table, values))[1]
    rest = 1.0
    for gram, context in found:
        rest *= values[2][np.searchsorted(table, context[1])]
    assert mass + rest == pytest.approx(1)


def test_html_templates_of_a_large_host_and_lone_blocks(spark):
    """A box on 6 of 400 pages, and a lone block of prose at the end of every page."""
    def page(i):
        box = "<div class='q7'><div>Section news</div><div>More of it</div></div>" if i < 6 else ""
        return f"<body>{box}<h1>Story {i}</h1><p>own text of page {i} {'word ' * 40}</p><p>All rights reserved by us</p></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(400)]
    rows += [(900 + i, f"http://few.example/{i}", page(i)) for i in range(3)]  # too few pages to tell
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html_text.BROADCAST_HASHES, 0):  # sent to all tasks, or joined
        got = {r["page_id"]: r["text"] for r in html_text.with_text(pages, broadcast=limit).collect()}
        assert len(got) == 403
        assert all(got[i] == f"Story {i}\nown text of page {i} {('word ' * 40).strip()}" for i in range(400))
        assert got[900].startswith("Section news\nMore of it") and got[900].endswith("All rights reserved by us")


def test_quality_tells_the_counts_of_the_whole_model(spark):
    """What blocks are told, part by part and in packed rows, is what rows of n-grams give; no
    job makes a row for each n-gram."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab cd ef gh kl longer-than-eight mn op".split()) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    *_, found = quality._all_grams(data, offsets, "en", 3)
    scratch = shared.Scratch(spark)
    told, discounts = quality.word_answers([quality._texts(docs, F.lit(True))], 3, len(data), scratch, 4)
    levels = {}
    for r in told.orderBy("place").collect():
        levels.setdefault(r["place"] >> 56, []).append((
            quality._unpack(r["keys"], 5, False).view(np.int64), quality._unpack(r["followers"] or bytes(8), 1, False).view(np.int64)))
    levels = {k: [np.concatenate(x, 1) for x in zip(*v)] for k, v in levels.items()}
    numbers = [[r[c] for c in ("d1", "d2", "d3", "total", "rest")] for r in discounts.orderBy("_order").collect()]
    model = quality.train_words(docs, 3).toPandas().set_index("key")
    for k, (num, total, rest) in enumerate(quality._word_values(found, levels, numbers)):
        gram, context = found[k]
        assert num == pytest.approx(model.loc[gram, "num"].to_numpy())
        assert total == pytest.approx(model.loc[context, "total"].to_numpy())
        assert rest == pytest.approx(model.loc[context, "rest"].to_numpy())
