import random
import re

import numpy as np
import pytest
from common_rows import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import language, queries, spm, toxicity, url_filter


def test_rules_and_parts(spark):
    urls = [None, "", "nothing", "http://COM/en/x", "https://a.Example.com/en/7?x=1", "http://example.com/en/8", "http://xexample.com/en/7", "http://m.example.net/de/80#t", "http://net/de/", "http://org", "x://b.org/es/?q", "http://a.org/fr/1", "//no"]
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES).collect()

    def expect(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fits, key=lambda r: len(r.text)) if fits else None

    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = expect(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")


def test_trees_learn(spark):
    rnd = random.Random(0)
    good = [f"https://site{rnd.randint(0, 99)}.example.com/en/page{k}" for k in range(300)]
    bad = [f"http://cheap-{rnd.randint(10**6, 10**7)}.example.org/a/b/c/d?x={k}&y=1&z={rnd.random()}" for k in range(300)]
    rows = spark.createDataFrame([(u, 0) for u in good[:200]] + [(u, 1) for u in bad[:200]], "url string, blocked int")
    model = url_filter.train(rows, rounds=4)
    out = url_filter.score(spark.createDataFrame([(u,) for u in good[200:] + bad[200:]] + [(None,)], "url string"), model).collect()
    hits = sum((r["block_score"] > 0.5) == (r["url"] in set(bad)) for r in out if r["url"])
    assert hits >= 195 and len(out) == 201
    assert url_filter.train(rows.where("blocked = 1")).base > 5 and url_filter.train(rows.where("false")).base < 0


def plain_trees(x, y, w, rounds, depth, rate, ridge, min_rows):
    """Boosted trees over rows of bins, by definition; the margins of the rows."""
    share = (y * w).sum() / w.sum()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        add = np.zeros(len(y))

        def grow(rows, level, g=g, h=h, add=add):
            best, value = (1e-6, None), lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
            for f in range(x.shape[1]) if level < depth else []:
                for b in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= b]
                    right = rows[x[rows, f] > b]
                    gain = value(left) + value(right) - value(rows)
                    if min(w[left].sum(), w[right].sum()) >= min_rows and gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            if best[1]:
                grow(best[1][0], level + 1)
                grow(best[1][1], level + 1)
            else:
                add[rows] = rate * g[rows].sum() / (h[rows].sum() + ridge)

        grow(np.arange(len(y)), 0)
        margin = margin + add
    return margin


def test_trees_against_a_plain_version(spark):
    rnd = random.Random(2)
    urls = [f"http://{rnd.choice(['a', 'bb', 'c-c'])}{rnd.randint(0, 30)}.{rnd.choice(['com', 'org', 'net'])}/{'x/' * rnd.randint(0, 4)}{rnd.randint(0, 999)}{rnd.choice(['', '?q=1', '?q=1&r=2'])}" for _ in range(250)]
    rows = [(u, int(("?" in u) ^ (rnd.random() < 0.15))) for u in urls for _ in range(rnd.randint(1, 3))]
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    model = url_filter.train(labelled, rounds=3, depth=2)
    count = {}
    for r in rows:
        count[r] = count.get(r, 0) + 1
    keys = sorted(count)
    y, w = np.array([k[1] for k in keys], float), np.array([count[k] for k in keys], float)
    table = spark.createDataFrame([(i, k[0]) for i, k in enumerate(keys)], "i long, url string")
    table = table.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    told = table.select("i", url_filter._suffix(F.col("host")).alias("s"), *(c.cast("double").alias(n) for n, c in url_filter.lexical_features(F.col("url"), F.col("host"), F.col("path")).items())).toPandas().sort_values("i")
    rate_of = {s: ((y * w)[told.s == s].sum() + 20 * (y * w).sum() / w.sum()) / (w[told.s == s].sum() + 20) for s in set(told.s)}
    told["suffix_rate"] = [rate_of[s] for s in told.s]
    x = np.column_stack([np.sum([told[n].to_numpy() > e + (1e-12 if n == "suffix_rate" else 0) for e in edges], axis=0) if edges else np.zeros(len(told)) for n, edges in model.edges.items()])
    want = 1 / (1 + np.exp(-plain_trees(x, y, w, 3, 2, 0.4, 1.0, 5.0)))
    got = {r["url"]: r["block_score"] for r in url_filter.score(table.select("url").distinct(), model).collect()}
    assert [got[k[0]] for k in keys] == pytest.approx(want.tolist(), abs=1e-9)


def test_copies_do_not_fill_the_sample(spark):
    bad, good = "http://bad.org/?q=1", [f"http://good{k}.com/" for k in range(60)]
    labelled = spark.createDataFrame([(bad, 1)] * 500 + [(u, 0) for u in good], "url string, blocked int")
    model = url_filter.train(labelled, sample=40, min_rows=1.0)
    assert model.trees and len(model.suffixes.collect()) >= 1


def test_margin_is_the_trees(spark):
    model = url_filter.Model(0.5, {"a": [1.0, 2.0]}, [("a", 0, -1.0, ("a", 1, 2.0, 3.0))])
    got = [r["m"] for r in spark.range(3).select(model.margin({"a": F.col("id")}).alias("m")).collect()]
    assert got == [-0.5, 2.5, 3.5]


@given(st.lists(st.integers(-5, 5), max_size=40))
@settings(max_examples=300, deadline=None)
def test_maximal_segments(w):
    """Ruzzo and Tompa by definition: the best segment of all, then again in what lies left and right of it."""

    def split(a, b):
        best = max(((sum(w[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0), key=lambda x: (x[0], x[1], -x[2]))
        return [] if best[0] <= 0 else split(a, best[2]) + [best[0]] + split(best[3], b)

    found = toxicity.maximal_segments([float(x) for x in w])
    assert all(s == pytest.approx(sum(w[a:b])) and s > 0 for a, b, s in found)
    assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:], strict=False))
    assert max((s for _, _, s in found), default=0) == max(split(0, len(w)), default=0)


def test_best_segments():
    rng = np.random.default_rng(0)
    sizes = [0, 3, 0, 50, 1, 0]
    w, at = rng.normal(-0.2, 1, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    want = [max([0.0, *(w[i:j].sum() for i in range(a, b) for j in range(i + 1, b + 1))]) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert toxicity.best_segments(w, at) == pytest.approx(np.array(want))


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rnd, rows, labels = random.Random(1), [], []
    plain, vile = [f"word{k}" for k in range(400)], ["scumish", "vilethy", "vilewor", "vilexan"]
    for k in range(1500):
        text, bad = [rnd.choice(plain) for _ in range(rnd.randint(5, 120))], k % 5 == 0
        for _ in range(3 * bad):
            text.insert(rnd.randrange(len(text)), rnd.choice(vile).upper() + rnd.choice(["", ".", "!!", "###"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark, toxic_corpus):
    docs, labels = toxic_corpus
    model = toxicity.train(docs, labels, eligible=~toxicity.in_fold("doc_id", 1))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.in_fold("doc_id", 1)).toPandas()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert (got.predicted == got.toxic).mean() > 0.98
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got[got.predicted == 1].itertuples():
        assert any(re.search("scumish|vile", text[r.doc_id].encode()[p["start"] : p["stop"]].decode().lower()) for p in r.passages)
    kept = toxicity.drop_toxic(docs.withColumn("extra", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "extra"] and kept.count() == toxicity.score(docs, model).where("predicted = 0").count()


def test_toxicity_awkward(spark, toxic_corpus):
    docs, labels = toxic_corpus
    none = toxicity.train(docs, labels.where("toxic = 0"))
    rows = toxicity.score(awkward(spark), none).collect()
    assert len(rows) == 9 and all(r["predicted"] == 0 for r in rows)
    model = toxicity.train(docs, labels)
    assert toxicity.drop_toxic(awkward(spark), model).count() == 9 and toxicity.score(empty(spark), model).count() == 0
    assert toxicity.train(empty(spark), labels).offset == -10.0


def test_fold(spark):
    import zlib

    rows = spark.range(30).select("id", toxicity.in_fold("id", 1).alias("f")).collect()
    assert all(r["f"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_sentencepiece_parity(spark):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    original = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    texts = ["", " ", "a  b", " lead", "trail ", "▁mark▁ x", "日本語 テスト", "tab\tand\nline", "emoji 🙂🙃", "12345 6", "don't", "\u00a0 x"]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2FFF)])) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    c = spm.codec(path)
    flat, bounds, agree = c.encode(texts)
    ids = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    want = original.encode(texts)
    assert [a == b for a, b in zip(ids, want, strict=True)] == agree.tolist() and agree.all()
    back = [b.decode() for b in c.decode(flat, bounds)]
    assert back == [t.replace("▁", " ") for t in texts]  # the marker itself is a blank in every decoder
    assert back == [original.decode(x) if x else "" for x in ids]
    assert back[12:] == [c.tokenizer.decode(x, skip_special_tokens=False) for x in ids[12:]]


def test_model_file_reading():
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    model, original = spm.read_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert len(model.pieces) == original.vocab_size() and model.kind == spm.BPE and model.byte_fallback and model.dummy_prefix and not model.squeeze
    assert [p for p, _, _ in model.pieces[::997]] == [original.id_to_piece(k) for k in range(0, len(model.pieces), 997)]


def test_unigram_backend():
    pieces = [("<unk>", 0.0, spm.UNKNOWN), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -2.5, 1), ("▁ab", -1.0, 1)] + [(f"<0x{k:02X}>", 0.0, spm.BYTE) for k in range(256)]
    t = spm.build(spm.PieceModel(pieces, spm.UNIGRAM, True, b"", True, True, 0))
    assert t.encode("  ab   ab ").tokens == ["▁ab", "▁ab"] and t.decode(t.encode("ab é").ids) == "ab é"


def test_sentencepiece_tables(spark):
    path = queries.tokenizer("piece_bpe_32k.model")
    rows = spm.encode_documents(awkward(spark), path, keep_ids=True)
    got = rows.toPandas()
    assert len(got) == 9 and got.parity.all() and got.round_trip.all() and got[got.doc_id == 2].n_tokens.tolist() == [0]
    back = {(r["doc_id"], r["text"]) for r in spm.decode_documents(rows, path).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in awkward(spark).collect()}
    assert spm.encode_documents(empty(spark), path).count() == 0


def test_parity_is_of_whole_texts(spark, monkeypatch):
    c = spm.Codec(queries.tokenizer("piece_bpe_32k.model"), 1)
    original = c.original
    seen = []

    class Other:
        def encode(self, texts, num_threads):
            seen.extend(texts)
            return [x if "odd" not in t else [*x, 0] for t, x in zip(texts, original.encode(texts), strict=True)]

    monkeypatch.setattr(c, "original", Other())
    texts = ["an odd text", "a plain text", ""]
    assert c.encode(texts)[2].tolist() == [False, True, True] and seen == texts


def plain_visible(html):
    """The same by one pattern, which may take long where something is not closed."""
    return re.sub(r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html)


@given(st.lists(st.sampled_from(["<script>", "</script >", "<SCRIPT x='<b>'", "</Script", "<!--", "-->", "<p class=a>", "</p>", "<", ">", "text", " ", "<nav>", "</nav>", "<style>", "İ", "</style\n>", "<footers>", "-", "<footer/>"]), max_size=25))
@settings(max_examples=500, deadline=None)
def test_visible_text(parts):
    html = "".join(parts)
    assert language.visible_text(html) == plain_visible(html)


def test_visible_text_is_linear():
    import time

    begin = time.time()
    for part in ("<script ", "<script>", "<!-- ", "<", "<nav></nav ", "</script ", "<p>"):
        language.visible_text(part * 60_000)
    assert time.time() - begin < 20


def plain_fusion(rows, m, weight=10.0, reliability=1.0):
    """``fuse`` row by row."""
    softmax = lambda x: np.exp(x - np.max(x)) / np.exp(x - np.max(x)).sum()
    p = [softmax(np.array(r["text_log"])) for r in rows]
    total = np.sum(p, axis=0)
    declared = {d: np.sum([q for q, r in zip(p, rows, strict=True) if r["declared"] == d], axis=0) for d in {r["declared"] for r in rows} - {None}}
    every = np.sum(list(declared.values()), axis=0) if declared else np.zeros(m)
    out = []
    for q, r in zip(p, rows, strict=True):
        prior = (total + 1) / (total.sum() + m)
        for level in ("suffix", "domain", "host"):
            if r[level] is not None:
                seen = np.maximum(np.sum([x for x, o in zip(p, rows, strict=True) if o[level] == r[level]], axis=0) - q, 0)
                prior = (seen + weight * prior) / (seen.sum() + weight)
        logs = np.array(r["text_log"]) + np.log(prior)
        if r["declared"] is not None:
            logs = logs + np.log((declared[r["declared"]] + reliability) / (every + reliability * m))
        out.append(softmax(logs))
    return out


def test_fusion_against_a_plain_version(spark):
    rnd, rows = random.Random(5), []
    for k in range(120):
        host = rnd.choice([None, "a.x.de", "b.x.de", "c.y.fr", "z.com"])
        rows.append({"page_id": k, "text_log": [rnd.gauss(0, 2) for _ in range(3)], "declared": rnd.choice([None, "de", "fr"]), "host": host, "domain": host and ".".join(host.split(".")[-2:]), "suffix": host and host.split(".")[-1]})
    table = spark.createDataFrame([tuple(r.values()) for r in rows], "page_id long, text_log array<double>, declared string, host string, domain string, suffix string")
    got = {r["page_id"]: r for r in language.fuse(table, ["de", "en", "fr"]).collect()}
    for k, want in enumerate(plain_fusion(rows, 3)):
        assert got[k]["p"] == pytest.approx(list(want), abs=1e-9) and got[k]["lang"] == ["de", "en", "fr"][int(np.argmax(want))]


def test_fusion_beats_text_alone(spark):
    """Held-out accuracy: short texts of words that all languages share, where host and markup tell more than the words."""
    rnd, langs = random.Random(6), ["en", "de", "fr"]
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma"]
    text = lambda lang, n: " ".join(rnd.choices(words, [3 if k // 2 == langs.index(lang) else 1 for k in range(6)], k=n))
    docs = [(k, text(lang, 30), lang, "s") for k, lang in enumerate(rnd.choices(langs, k=600))]
    truth, pages = {}, []
    for k in range(300):
        lang = truth[k] = rnd.choice(langs)
        pages.append((k, f"http://{lang}{k % 4}.site.org/x", f'<html lang="{lang if rnd.random() < 0.9 else "en"}"><p>{text(lang, 4)}</p></html>'))
    got = language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(pages, "page_id long, url string, html string")).where("page_id is not null").collect()
    alone, fused = (sum(r[c] == truth[r["page_id"]] for r in got) for c in ("text_lang", "lang"))
    assert fused >= alone + 30, (fused, alone)


def test_every_label_is_a_language_and_ties_stay(spark):
    docs = spark.range(520).selectExpr("id doc_id", "concat(translate(cast(id % 130 as string), '0123456789', 'abcdefghij'), 'word') text", "concat('l', id % 130) lang")
    model = language.train(docs, features=5)
    assert len(model.languages) == 130 and len(model.keys) == 5


def test_language(spark):
    rnd = random.Random(0)
    vocab = {"en": ["the", "house", "water", "strong"], "de": ["das", "hausung", "wasser", "starken"], "fr": ["le", "maison", "eau", "forte"]}
    rows = [(k, " ".join(rnd.choice(vocab[lang]) for _ in range(rnd.randint(3, 30))), lang, f"s{k % 4}") for k, lang in enumerate(rnd.choices(list(vocab), k=600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    html = lambda lang, body: f'<html lang="{lang}"><script>das wasser</script><p>{body}</p></html>'
    pages = [(k, f"http://w{k % 3}.site.{'de' if k % 2 else 'fr'}/x", html("de-AT" if k % 2 else "fr", " ".join(rnd.choice(vocab["de" if k % 2 else "fr"]) for _ in range(20)))) for k in range(60)]
    pages += [(100, "http://w1.site.de/y", html("de", "")), (101, None, None), (102, "http://w9.site.de/z", "")]
    got = language.identify(docs, spark.createDataFrame(pages, "page_id long, url string, html string")).toPandas()
    assert len(got) == 663
    d = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert (d["lang"].loc[[r[0] for r in rows]].tolist() == [r[2] for r in rows]) and d["declared"].isna().all()
    p = got.dropna(subset=["page_id"]).set_index("page_id")
    assert all(p["lang"][k] == ("de" if k % 2 else "fr") for k in range(60)) and p["declared"][1] == "de"
    assert p["lang"][100] == "de" and p["lang"][102] == "de" and p["lang"][101] is not None and got.confidence.between(0, 1.0000001).all()
    assert language.identify(awkward(spark)).count() == 9 and language.identify(empty(spark)).count() == 0
