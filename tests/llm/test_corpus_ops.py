"""Corpus operators against brute force, and on odd inputs."""

from __future__ import annotations

import collections
import dataclasses
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from framescope.llm import decontaminate, html, lm, mixing, quality, rules, secrets, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
SF = "/root/testdata/sf0.01"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return SPACE.findall(text or "")


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeats, and
    extra columns named like the operators' own."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some plain words here", "en", "a", 21),
            (4, "some plain words here", "en", None, 21), (4, "some plain words here", "en", None, 21),
            (5, LONG, "en", "a", len(LONG)), (6, " \n\t ", "fr", "b", 4), (7, "é ß 日本 #### ****", "de", "b", 14)]
    extra = "score double, n_words long, h long, pos int, x array<double>, rate double, q string, root long, kept string, `row` int"
    return spark.createDataFrame([r + (0.5, 1, 2, 3, [1.0], 2.0, "q", 4, "k", 5) for r in rows], f"{DOCS}, {extra}")


def odd_labels(spark):
    return spark.createDataFrame([(4, 1, 0, 9), (4, 1, 0, 9), (5, 0, 1, 9), (None, 1, 1, 9), (2, None, None, 9),
                                  (99, 1, 1, 9)], "doc_id long, quality int, toxic int, y int")


def odd_benchmark(spark):
    return spark.createDataFrame([(1, "plain WORDS"), (1, "plain WORDS"), (2, None), (None, "日本"), (3, ""), (4, "zzz")],
                                 "item_id long, text string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


ON_DOCUMENTS = {
    "decontaminate": lambda d, la, b: decontaminate.contaminated(d, b),
    "simhash": lambda d, la, b: simhash.scored(d),
    "secrets": lambda d, la, b: secrets.scanned(d),
    "quality": lambda d, la, b: quality.scored(d, la),
    "mixing": lambda d, la, b: mixing.domain_totals(d),
    "rules": lambda d, la, b: rules.judged(d),
    "toxicity": lambda d, la, b: toxicity.scored(d, la),
    "lm": lambda d, la, b: lm.scored(d),
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_odd_rows_keep_their_row(spark, name):
    out = ON_DOCUMENTS[name](odd_documents(spark), odd_labels(spark), odd_benchmark(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "4", "4", "5", "6", "7", "None"]


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_tables(spark, name):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ON_DOCUMENTS[name](empty(spark), none, bench).count() == 0
    assert ON_DOCUMENTS[name](odd_documents(spark), none, bench).count() == 8


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    for out in (quality.keep_good(docs, odd_labels(spark)), simhash.keep_one(docs),
                decontaminate.drop_contaminated(docs, odd_benchmark(spark)), secrets.redact(docs)):
        assert out.columns == docs.columns
        out.collect()
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "mix_rate", "mix_copy"]
    assert mixed.where("mix_copy = 1").count() == 8
    assert sorted(str(r[0]) for r in simhash.keep_one(docs).select("doc_id").collect()) == ["1", "4", "5", "7"]
    clean = decontaminate.drop_contaminated(docs, odd_benchmark(spark))
    assert sorted(str(r[0]) for r in clean.select("doc_id").collect()) == ["1", "2", "5", "6"]


# ---- decontamination ------------------------------------------------------

def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, ids = set(), set()
    for item, t in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(len(iw), 10)
        for win in {tuple(iw[i:i + n]) for i in range(max(1, len(iw) - 9))} if iw else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == win:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("bits", [decontaminate.MAP_BITS, 6])
def test_decontamination_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MAP_BITS", bits)  # at 6 bits the map is full
    rng = np.random.default_rng(5)
    vocab = ["the", "of", "É", "x1", "Z", "ab", "cd"]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([1, 2, 3, 5, 12, 12, 15])] + [(10, "the of"), (11, None)]
    docs = [(i, ", ".join(rng.choice(vocab, rng.integers(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"start here {t} - {t} end") for i, t in items if t]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {d: brute_hits(t, items) for d, t in docs}
    assert len(got) == len(docs)
    for r in got:
        n, hit, ids = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, ids, hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()


# ---- SimHash --------------------------------------------------------------

def test_near_codewords_cover_two_errors():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 500)
    for a in range(23):
        for b in range(23):
            y = x ^ (1 << a) ^ (0 if a == b else 1 << b)
            (p, pm), (q, qm) = simhash.near_codewords(x), simhash.near_codewords(y)
            same = (p[:, :, None] == q[:, None, :]) & pm[:, :, None] & qm[:, None, :]
            assert same.any((1, 2)).all()
            if a == b:  # one error: the nearest codeword of one is near the other
                assert same[:, 0, :].any(1).all()


def test_fingerprint_by_hand():
    def by_hand(text):
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in (None, "", "one", "One TWO three", "a b c d", "É a\x0bb\x85c d e f g", LONG[:3000], "x y z w x y z w x y z w"):
        assert simhash.fingerprint(t) == by_hand(t)


@pytest.mark.parametrize("hot,block", [(simhash.HOT, simhash.BLOCK), (6, 2)])
def test_links_connect_as_all_pairs_do(spark, hot, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        p = int(b)
        for _ in range(12):  # chains of near fingerprints
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                p ^= 1 << int(bit)
            prints.add(p)
    signed = sorted(int(np.array([p], dtype=np.uint64).view(np.int64)[0]) for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = dict(simhash.star_rounds(simhash.links(df, 4, hot, block)).collect())
    trees = simhash._Trees()
    for i, a in enumerate(signed):
        for b in signed[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                trees.link(np.array([a]), np.array([b]))
    assert {p: roots.get(p, p) for p in signed} == {p: trees.root(p) for p in signed}


# ---- language model -------------------------------------------------------

def test_language_model_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(0, 40), p=np.arange(30, 0, -1) / 465))) for i in range(120)]
    docs += [(500, None), (501, "unseen Words only"), (502, "W1 w1\tw1 x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.scored(df).collect()}

    def toks(t):
        return words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    two, one, left, nn, total = (collections.Counter(), collections.Counter(), collections.Counter(),
                                 collections.defaultdict(lambda: [0, 0, 0]), collections.Counter())
    for d, t in docs:
        if not held[d]:
            one.update(toks(t))
            two.update(zip([0, *toks(t)[:-1]], toks(t)))
    for (h, w), n in two.items():
        left[w] += 1
        total[h] += n
        nn[h][min(n, 3) - 1] += 1

    def disc(c):
        return lm.discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])

    hi, lo, n_all, v = disc(two), disc(left), sum(one.values()), len(one)
    mass = sum(lo[min(k, 3)] for k in left.values())

    def p(h, w):
        low = (max(left[w] - lo[min(left[w], 3)], 0) + mass / (v + 1)) / len(two)
        if not total[h]:
            return low
        n = two[(h, w)]
        return (max(n - hi[min(n, 3)], 0) + sum(a * b for a, b in zip(hi[1:], nn[h])) * low) / total[h]

    for d, t in docs:
        w, r = toks(t), got[d]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d], len(w), n_all)
        assert r["n_known"] == sum(one[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10((one[x] + .5) / (n_all + .5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(h, x)) for h, x in zip([0, *w[:-1]], w)), rel_tol=1e-9)
    known = [w for w in one]
    for h in (0, "w1", "w20"):
        assert math.isclose(sum(p(h, w) for w in known) + p(h, "new"), 1.0)


def test_small_shards_and_flushes_count_the_same(spark):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["the", "a", "b", "c", f"r{i}"], 50))) for i in range(60)],
                                 "doc_id long, text string")
    texts = [r["text"] for r in docs.collect()]
    one, many = lm.train(docs), lm.train(docs, shard_bytes=500, flush=64)
    assert many.shards > one.shards and len(many.hot) > 1
    assert (one.n_tokens, one.n_types, one.n_bigrams, one.high, one.low) == (
        many.n_tokens, many.n_types, many.n_bigrams, many.high, many.low)
    assert np.allclose(lm.score_batch(one, texts)["score"], lm.score_batch(many, texts)["score"], rtol=1e-12)


def test_a_model_whose_folder_is_gone_is_an_error(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(9)], "doc_id long, text string")
    model = lm.train(docs)
    gone = dataclasses.replace(model, folder=model.folder + "-gone")
    assert lm.score_batch(model, ["a b"])["n_known"][0] == 3
    with pytest.raises(FileNotFoundError):
        lm.score_batch(gone, ["a b"])


# ---- secrets --------------------------------------------------------------

def test_secret_spans_and_digest(spark):
    key, ident = "AKIA" + "Q7" * 8, "9f86d081884c7d659a2f"
    texts = [f"é password = '{ident}' and {key} x", "secret:short token=abcdefghijkl", "API_KEY=\"aB3+/_.=-xyz12\"",
             f"{ident}G{ident}", "tokenization of secretary", None, "plain text " * 50]
    rows = {r["doc_id"]: r for r in secrets.scanned(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at, to = texts[0].index(ident), texts[0].index(key)
    assert rows[0]["spans"] == f"assign:2:{at + 20},hex:{at}:{at + 20},access:{to}:{to + 20}"
    assert rows[0]["base_sha256"] == hashlib.sha256(rows[0]["spans"].encode()).hexdigest()
    assert (rows[0]["n_assign"], rows[0]["n_access"], rows[0]["n_hex"]) == (1, 1, 1)
    assert rows[1]["spans"] == "assign:13:31"
    assert rows[2]["n_assign"] == 1 and rows[3]["n_hex"] == 2
    for i in (4, 5, 6):
        assert rows[i]["spans"] == "" and rows[i]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_markov_ratio_finds_unknown_formats_and_leaves_identifiers(spark):
    rng = np.random.default_rng(4)
    llr = secrets.ratios(spark.read.parquet(f"{SF}/documents.parquet"))
    symbols = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    found = sum(bool(secrets.spans_of(f"see {''.join(rng.choice(symbols, 28))} there", llr)) for _ in range(100))
    assert found >= 95
    for t in ("user_account_id_2 getElementById2Value function_name2_thing", "user_id_2024_01_15_report",
              "thththingandtheother12"):
        assert secrets.spans_of(t, llr) == []


def test_random_values_behind_names_and_paths_are_found(spark):
    rng = np.random.default_rng(6)
    llr = secrets.ratios(spark.read.parquet(f"{SF}/documents.parquet"))
    symbols = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    for front in ("STRIPE_LIVE_ACCOUNT_KEY_FOR_ALL=", "com/reset/link/for/user/of/the/whole/site/"):
        found = 0
        for _ in range(50):
            value = "".join(rng.choice(symbols, 28))
            text = f"see {front}{value} there"
            found += any(s <= text.index(value) and e >= text.index(value) + 28 for s, e, _ in secrets.spans_of(text, llr))
        assert found >= 45, front
    letters = sum(bool(secrets.spans_of(f"see {''.join(rng.choice(symbols[:52], 32))} there", llr)) for _ in range(50))
    assert letters >= 45
    plain = "com/reset/link/for/the/other/people/of/the/house the_name_of_another_function_with_words internationalisation"
    assert secrets.spans_of(plain, llr) == []


def test_markov_spans_never_overlap_patterns():
    rng = np.random.default_rng(12)
    llr = np.full((secrets.SIZE, secrets.SIZE), 2.0)  # every token looks random
    pieces = ["token=", "zQ9xB7" * 4, "0123456789abcdef", "AKIA" + "Z9" * 8, "a=b", " ", "words ", ". ", "secret: "]
    for _ in range(300):
        text = "".join(rng.choice(pieces, 14))
        spans = secrets.pattern_spans(text)
        free = "".join("\0" if any(s <= i < e for s, e, _ in spans) else c for i, c in enumerate(text))
        want = [(m.start(), m.end()) for t in secrets.TOKEN.finditer(text) for m in re.compile(r"[^\0]+").finditer(free, *t.span())
                if len(m[0]) >= secrets.LEAST and any(c.isdigit() for c in m[0]) and sum(c.isalpha() for c in m[0]) >= 4]
        found = secrets.spans_of(text, llr)
        assert [s for s in found if s[2] != "markov"] == spans
        assert [s[:2] for s in found if s[2] == "markov"] == want


def test_the_rest_of_a_token_beside_a_pattern_is_found(spark):
    rng = np.random.default_rng(16)
    llr = secrets.ratios(spark.read.parquet(f"{SF}/documents.parquet"))
    symbols = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    found = 0
    for _ in range(50):
        value = "G" + "".join(rng.choice(symbols, 30))
        text = f"see {'0123456789abcdef' * 2}{value} there"
        masked = secrets._masked(text, secrets.spans_of(text, llr))
        found += value[-20:] not in masked
    assert found >= 45


def test_redaction_changes_the_length(spark):
    df = spark.createDataFrame([(1, "x AKIA" + "A1" * 8 + " y", 99), (2, "clean", 77), (3, None, None)],
                               "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redact(df).orderBy("doc_id").collect()] == [
        (1, "x [access] y", 12), (2, "clean", 77), (3, None, None)]


# ---- HTML -----------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><!-- c --><nav><ul>
<li><a href="/x">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div><{tag}><header><h1>Head &amp; line</h1>
</header><p><b>First   para&nbsp;one.<br>More <a href="/y">linked</a> text here to read.<p>Second para with several words.
<ul><li>item one</li><li>item two</li></ul><form><input name=q><label>Search me</label></form><div class="ad">Buy now</div>
<p>Third &lt;para&gt; é &#x41; closes the text.</p></{tag}><section id="comments"><p>Nice post by a reader of this.</p></section>
<aside>Related things to read</aside><footer>&copy; me</footer></body></html>"""
TEXT = ("Head & line\nFirst para one. More linked text here to read.\nSecond para with several words.\nitem one\nitem two\n"
        "Third <para> é A closes the text.")


def test_main_text_of_labelled_and_other_pages(spark):
    pages = [(i, f"u{i}", PAGE.format(tag="article")) for i in range(5)]
    pages += [(10, "u", PAGE.format(tag="div")), (11, None, None), (12, "u", ""), (13, "u", "<p>no end <b"), (None, "u", "text"),
              (14, "u", "<div>" * 5000 + "deep words" + "</div>" * 4000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got[0] == TEXT
    assert got[10] == TEXT.split("\n", 1)[1]  # a header outside named content is the site's
    assert (got[11], got[12], got[13], got[None], got[14]) == ("", "", "no end", "text", "deep words")
    assert html.main_text(df.limit(0)).count() == 0


def test_stray_quotes_and_headers_of_articles():
    weights = {"w:p": 1.0, "w:h1": 1.0, "w:!p": -0.1, "t:p": -0.1, "t:/p": -0.1}
    page = ("<body><article><div class='entry-header'><h1>Its own title</h1></div><p title=don't data-x=\"a > b\" it's>One "
            "block of it</p><header class=ad><p>Buy it</p></header><p title = 'x>y'>and more</p></article></body>")
    assert html.extract(page, weights) == "Its own title\nOne block of it\nand more"
    assert html.extract(page.replace("article>", "div>"), weights) == "One block of it\nand more"
    assert html.extract("<p>kept words here</p><a href='never closed>lost", weights) == "kept words here"


def test_slugs_of_headings_are_not_furniture():
    weights = {"w:p": 1.0, "w:h2": 1.0, "w:div": 1.0, "w:section": 1.0}
    blocks = ['<h2 id="legal-status">Legal status</h2>', '<p id="search-and-rescue">Search and rescue</p>',
              '<h2 id="related-work">Related work</h2>', '<p data-id="share">Shared rooms</p>',
              '<section id="notice-of-appeal"><p>An appeal</p></section>', '<p class="legal-text">By law</p>']
    for tag in ("article", "div"):
        page = f"<{tag}>{''.join(blocks)}<div class='social-share'>Tell all</div><ul role=menu><li>Go</ul></{tag}>"
        assert html.extract(page, weights).split("\n") == [
            "Legal status", "Search and rescue", "Related work", "Shared rooms", "An appeal", "By law"]


def test_other_tags_do_not_displace_a_tags_weight(spark):
    many = "".join(f"<x-{i}>w</x-{i}>" * 2 for i in range(1200))
    pages = [(1, "u", f"<body>{many}<article><p>text <kbd>key</kbd> here</p></article></body>")]
    weights = html.learn(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert "t:kbd" in weights and "t:?" in weights and len(weights) < 50


def test_region_is_the_best_contiguous_run():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = rng.integers(1, 12)
        weights = {f"w:{i}": float(rng.integers(-4, 5)) for i in range(n)}
        seq = [(f"w:{i}", f"t{i} ", False, "") for i in range(n)]
        best = max([0.0] + [sum(weights[f"w:{k}"] for k in range(i, j)) for i in range(n) for j in range(i + 1, n + 1)])
        total = 0.0
        keep = html.parts
        try:
            html.parts = lambda _: seq
            out = html.extract("x", weights).split()
        finally:
            html.parts = keep
        total = sum(weights[f"w:{t[1:]}"] for t in out)
        assert total == best


# ---- WARC -----------------------------------------------------------------

def test_warc_round_trip(spark):
    big, other = "é" * 600, "z" * 1000
    pages = [(1, "http://a b\r\nX: y", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None),
             (None, "u", other), (8, "u", other), (8, "u", other), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (10, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS keeper")
    got = collections.Counter(tuple(r) for r in warc.round_trip(spark, df.repartition(3)).drop("url").collect())
    want = collections.Counter()
    for p, _, h in pages:
        raw = (h or "").encode()
        keeper = {big: 3, other: 8}.get(h)
        revisit = keeper is not None and p != keeper
        want[(p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None)] += 1
    assert got == want
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_each_record_is_a_member(tmp_path):
    import io

    records = [warc.record(i, f"u{i}", b"p" * i * 1000, "d", None) for i in range(5)]
    whole = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    source = io.BytesIO(whole.compress(b"".join(records[:3])) + whole.flush())
    out = io.BytesIO()
    places = list(warc.rewritten(source, out))
    assert [zlib.decompress(out.getvalue()[o:o + n], warc.GZIP) for o, n in places] == records[:3]
    assert places[-1][0] + places[-1][1] == len(out.getvalue())
    cut = io.BytesIO(source.getvalue()[:-40])
    with pytest.raises((ValueError, zlib.error)):
        list(warc.rewritten(cut, io.BytesIO()))


# ---- main text of generated pages ------------------------------------------

def made_page(rng, kind):
    """A page and its main text."""
    word = lambda: str(rng.choice(["plain", "hidden", "related", "comment", "search", "x", "día", "a&amp;b"]))
    line = lambda n: " ".join(word() for _ in range(n))
    blocks, out = [], []
    title = line(rng.integers(1, 4))
    blocks.append(f"<h1 id='related-{rng.integers(9)}'>{title}</h1>")
    out.append(title)
    for _ in range(rng.integers(2, 7)):
        text = line(rng.integers(1, 40))
        if rng.random() < 0.3:
            text += " is <math><mi>x</mi></math> here"
        blocks.append(str(rng.choice(["<p title='the hidden valley'>{}</p>", "<p data-title='Five hidden gems' style='color:red'>{}</p>",
                                      "<blockquote>{}</blockquote>", "<p>{}<script>var hidden = 1;</script></p>"])).format(text))
        out.append(re.sub("<[^>]*>", "", text))
        if rng.random() < 0.3:
            blocks.append(str(rng.choice(["<div hidden>not shown</div>", "<div style='display: none'>not shown</div>",
                                          "<aside>read this too</aside>", "<form><p>mail</p></form>"])))
    body = "".join(blocks)
    wrap = {"article": "<article>{}</article>", "main": "<main><article>{}</article></main>", "body": "<div itemprop='articleBody'>{}</div>",
            "plain": "<div>{}</div>"}[kind]
    head = "<nav><ul>" + "<li><a href=/>Home page</a></li>" * 5 + "</ul></nav><header><p>Site name</p></header>"
    page = f"<html><head><title>t</title></head><body>{head}{wrap.format(body)}<footer><p>all rights reserved</p></footer></body></html>"
    return page, "\n".join(x.replace("&amp;", "&") for x in out)


@pytest.mark.parametrize("kind", ["article", "main", "body", "plain"])
def test_main_text_of_generated_pages_is_exact(spark, kind):
    rng = np.random.default_rng(21)
    pages = [made_page(rng, kind) for _ in range(60)]
    rows = [(i, "u", html_) for i, (html_, _) in enumerate(pages)] + [(0, "u", pages[0][0])]  # a repeated row
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert bool(html.learn(df)) == (kind != "plain")  # layouts that name their content are learnt from
    for r in html.main_text(df).collect():
        assert r["text"] == pages[r["page_id"]][1], pages[r["page_id"]][0]


def test_unclosed_elements_take_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        start = time.perf_counter()
        html.parts("<svg><select>" * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 0.2


# ---- rules ----------------------------------------------------------------

def test_measures_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = ["a", "b", "c#", "é", "long*word"]
    texts = ["\n".join(" ".join(rng.choice(vocab, rng.integers(0, 9))) for _ in range(rng.integers(0, 9))) for _ in range(60)]
    texts += [None, "", "a b c d e", "a b c d e a b c d e", "\n\nx\nx\n \nx", "x " * 40, "v w x y z " + " ".join(f"u{i}" for i in range(40))]
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in rules.measures(df).collect():
        t = texts[r["doc_id"]] or ""
        w = words_of(t)
        win = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        rep = {i + j for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)), repr(t)


def test_bad_host_takes_its_documents_and_small_hosts_lean_on_the_prior(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, f"good{i % 8}") for i in range(400)]
    rows += [(1000 + i, "short text" if i % 10 else good, "bad") for i in range(300)]
    rows += [(2000, "short text", "tiny"), (2001, good, "tiny")]
    out = {r["doc_id"]: r for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1000]["host_rejected"] and not out[1000]["base_failed"] and not out[1000]["kept"]
    assert not out[2001]["host_rejected"] and out[2001]["kept"] and out[2000]["base_failed"]
    assert all(out[i]["kept"] for i in range(400))


@pytest.mark.parametrize("spread, each", [(0.0, 1), (0.0, 2), (0.0, 6), (0.15, 30)])
def test_prior_finds_the_spread_between_hosts(spread, each):
    rng = np.random.default_rng(17)
    hosts, m = 3000, 0.45
    rho = (spread / np.sqrt(m * (1 - m))) ** 2
    true = rng.beta(m * (1 / rho - 1), (1 - m) * (1 / rho - 1), hosts) if rho else np.full(hosts, m)
    n = np.full(hosts, each) + (rng.integers(0, 5, hosts) if each > 1 else 0)
    k = rng.binomial(n, true)
    mean = k.sum() / n.sum()
    size = rules.prior_size(mean, (n * (k / n - mean) ** 2).sum(), int(n.sum()), hosts, float((n ** 2).sum()))
    shrunk = (k + size * mean) / (n + size)
    if spread:
        assert abs(size - (1 / rho - 1)) < 0.2 * (1 / rho - 1)
    else:
        assert (shrunk > rules.MAX_RATE).sum() == 0  # equal hosts: none is rejected by chance


def test_hosts_of_one_document_and_repeated_lines(spark):
    good = "\n".join(f"line {i} has four words" for i in range(20))
    repeated = "\n".join(f"{'same four words here' if i % 2 else f'other line number {i}'}" for i in range(40))
    rows = [(i, good if i % 2 else "short text", f"h{i}") for i in range(40)] + [(100 + i, repeated, "lines") for i in range(30)]
    out = {r["doc_id"]: r for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i]["kept"] == bool(i % 2) for i in range(40))
    assert all(out[100 + i]["host_rejected"] for i in range(30))


# ---- quality, toxicity, mixing: held-out accuracy -------------------------

def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)
    assert all(r["predicted"] == 1 for r in out if r["quality"] == 1)


def test_quality_density_is_the_formula():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2, 4, 4))
    cov = a @ a.transpose(0, 2, 1) + np.eye(4)
    low = np.linalg.cholesky(cov)
    m = quality.Model(rng.normal(size=(2, 4)), np.linalg.inv(low), np.linalg.slogdet(cov)[1], (0, 1))
    x = rng.normal(size=(5, 4))
    want = [[-.5 * (v - m.means[k]) @ np.linalg.inv(cov[k]) @ (v - m.means[k]) - .5 * np.linalg.slogdet(cov[k])[1] for k in (0, 1)]
            for v in x]
    assert np.allclose(m.difference(x), [w[1] - w[0] for w in want])


def test_toxicity_held_out_and_disguises(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    a = lexicon.automaton()
    assert toxicity.strength(a, "calm words only " * 30) == 0
    for t in ("1d1ot", "іdiot", "IDIOT!", "ｉｄｉｏｔ", "i​diot"):
        assert toxicity.fold(t).split()[0] == "idiot"
    out = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.9 * len(out)


def test_documents_of_one_vocabulary_are_not_copies(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(200)]
    calm = [" ".join(rng.permutation(vocab)) for _ in range(60)]
    one = " ".join(rng.permutation(vocab)).split()
    rows = [(i, t + (" blorgh" if i % 2 else "")) for i, t in enumerate(calm)]  # 30 toxic documents, one word sets them apart
    rows += [(100 + i, " ".join([*one, "snarfle", f"end{chr(97 + i)}q"])) for i in range(20)]  # near copies of one document
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 or i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels).weights
    assert " blorgh " in weights and " snarfle " not in weights


def test_exception_phrase_cancels_its_match():
    a = toxicity.Lexicon({" trash ": 5.0, " tra": 3.0}, [" trash can "]).automaton()
    assert toxicity.matches(a, toxicity.fold("the trash can is here")) == {}
    assert list(toxicity.matches(a, toxicity.fold("trash talk")).values()) == [5.0]
    assert list(toxicity.matches(a, toxicity.fold("the travel")).values()) == [3.0]


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = {"en": 0.25, "de": 0.25, "es": 0.25, "fr": 0.25}
    rows, classifier, _, miss = mixing.rated(docs, "lang", weights=weights)
    assert np.abs(miss).max() < 1e-3
    p = rows.toPandas()
    q, t = np.stack(p["q"]), p["tokens"].to_numpy()
    got = (p["rate"].to_numpy() * t) @ q
    want = mixing.default_targets(t @ q, np.full(4, 0.25))
    assert (p["rate"] >= 0).all() and np.allclose(got, want, rtol=1e-3)
    assert np.allclose(got / got.sum(), 0.25, atol=1e-3)
    truth = dict(docs.select("doc_id", "lang").collect())
    best = [classifier.domains[i] for i in q.argmax(1)]
    assert sum(truth[d] == b for d, b in zip(p["doc_id"], best)) >= 0.97 * len(p)
    copies = mixing.mixed(docs, "lang", weights=weights).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    rate = p.set_index("doc_id")["rate"]
    assert (copies >= np.floor(rate[copies.index] - 1e-9)).all() and (copies <= np.ceil(rate[copies.index] + 1e-9)).all()
    assert len(copies) == len(p)


def test_sources_that_texts_do_not_show_keep_their_shares(spark):
    rows = [(i, "the same words in every source", "en", "hot" if i % 5 < 3 else f"s{i % 3}", 0) for i in range(600)]
    rows += [(1000 + i, None if i else "", "en", None, 0) for i in range(2)]
    with pytest.warns(UserWarning, match="off its target"):
        got = mixing.domain_totals(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == len(rows) and (got["domain"] == "hot").all()
    share = sum(r[3] == "hot" for r in rows) / 600
    assert np.allclose(got["posterior"], share, atol=0.05)  # near the prior
    assert np.ptp(got.loc[got["tokens"] > 0, "rate"]) < 1e-6 and got["rate"].min() >= 1 and (got["miss"].abs() > 0.01).all()  # said, not hidden


def test_posteriors_are_calibrated_on_given_sources(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    with pytest.warns(UserWarning):
        rows, classifier, _, _ = mixing.rated(docs)
    p = rows.toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    held = p[[zlib.crc32(str(i).encode()) % 5 == 1 for i in p["doc_id"]]]
    q = np.stack(held["q"])
    right = np.array([classifier.domains[i] for i in q.argmax(1)]) == held["source"].to_numpy()
    assert abs(q.max(1).mean() - right.mean()) < 0.03  # as sure as it is right
    t = held["tokens"].to_numpy()
    labels = np.array([t[(held["source"] == d).to_numpy()].sum() for d in classifier.domains])
    assert np.abs(t @ q - labels).sum() < 0.05 * t.sum()


def test_calibration_finds_the_temperature(spark):
    rng = np.random.default_rng(9)
    labels = rng.choice(3, 6000, p=[0.6, 0.3, 0.1])
    honest = rng.normal(0, 1, (6000, 3))
    honest[np.arange(6000), labels] += 1.0  # log odds of one unit for the true domain
    c = mixing.calibrated(mixing.Classifier(["a", "b", "c"], np.zeros((3, 1))), 5 * honest, labels, np.ones(6000))
    assert abs(c.weight - 0.2) < 0.02 and abs((c.bias[0] - c.bias[2]) - np.log(6)) < 0.2
    blind = mixing.calibrated(c, rng.normal(0, 5, (6000, 3)), labels, np.ones(6000))
    assert blind.weight < 0.01


def test_rates_equal_a_dense_solver(spark):
    rng = np.random.default_rng(8)
    q, t = rng.dirichlet([0.5] * 3, 60), rng.integers(5, 60, 60).astype(float)
    size = t @ q
    wanted = size * np.array([0.4, 1.0, 1.7])
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, q)], "tokens long, q array<double>")
    history, miss = mixing.fit(df, 3, lambda _: wanted)
    r = np.ones(60)
    for _ in range(200_000):  # plain projected gradient on the whole matrix
        r = np.maximum(r - q @ ((r * t) @ q / size - wanted / size), 0)
    got = mixing._steps(q, history)
    assert np.allclose((got * t) @ q, (r * t) @ q, rtol=1e-3) and np.abs(miss).max() < 1e-3


def test_default_targets_keep_documents_of_mixed_language(spark):
    rng = np.random.default_rng(3)
    words = {"en": ["the", "house", "with", "water"], "de": ["das", "haus", "mit", "wasser"]}
    rows = [(i, " ".join(rng.choice(words["en" if i % 10 else "de"], 30)), "en" if i % 10 else "de", "s", 0) for i in range(200)]
    rows += [(1000 + i, " ".join(rng.permutation(words["en"] + words["de"])), None, "s", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    p = mixing.rated(docs, "lang")[0].toPandas()
    q, t, r = np.stack(p["q"]), p["tokens"].to_numpy(), p["rate"].to_numpy()
    assert ((q.max(1) > 0.1) & (q.max(1) < 0.9)).any() and r.min() >= 1
    size, got = t @ q, (r * t) @ q
    want = mixing.default_targets(size)
    assert np.allclose(got / got.sum(), want / want.sum(), atol=1e-3) and (got >= want - 1e-3 * size).all()
    assert mixing.mixed(docs).where("mix_copy = 1").count() == len(rows)


def test_projected_gradient_keeps_rates_nonnegative(spark):
    rng = np.random.default_rng(1)
    q = rng.dirichlet([0.3] * 3, 200)
    t = rng.integers(1, 50, 200)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, q)], "tokens long, q array<double>")
    wanted = (t @ q) * np.array([0.0, 1.0, 2.0])
    history, _ = mixing.fit(df, 3, lambda size: wanted)
    r = mixing._steps(q, history)
    assert (r >= 0).all() and (r == 0).any()
    loss = lambda r: ((((r * t) @ q) - wanted) ** 2 / (t @ q)).sum()
    assert loss(r) < 0.02 * loss(np.ones(200))


def test_close_domains_reach_their_targets_or_say_so(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.uniform(0.42, 0.58, 300)
    q, t = np.stack([x, 1 - x], 1), rng.integers(20, 50, 300)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, q)], "tokens long, q array<double>").coalesce(2)
    size = t @ q
    wanted = size * np.array([1.02, 0.98])
    r = mixing._steps(q, mixing.fit(df, 2, lambda _: wanted)[0])
    assert (np.abs((r * t) @ q - wanted) / size).max() < mixing.TOLERANCE
    monkeypatch.setattr(mixing, "STEPS", 5)
    with pytest.warns(UserWarning, match="off its target"):
        mixing.fit(df, 2, lambda _: size * np.array([3.0, 0.0]))


# ---- pipeline -------------------------------------------------------------

def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "mix_rate", "mix_copy"]
    texts = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.scored(docs, labels).where("predicted = 1").collect()}
    ids = sorted(good)
    prints = np.array([simhash.fingerprint(texts[i]["text"]) for i in ids], dtype=np.uint64)
    trees = simhash._Trees()
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1:]) <= 4) + i + 1:
            trees.link(np.array([i]), np.array([j]))
    kept = {ids[i] for i in range(len(ids)) if trees.root(i) == i}
    items = [(b["item_id"], b["text"]) for b in bench]
    clean = {i for i in kept if not brute_hits(texts[i]["text"], items)[1]}
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == clean
    for r in rows:
        left = secrets.pattern_spans(r["text"])
        assert not left and r["n_chars"] == len(r["text"])
        assert (r["lang"], r["source"]) == (texts[r["doc_id"]]["lang"], texts[r["doc_id"]]["source"])
        assert r["mix_rate"] >= 0 and r["mix_copy"] <= math.ceil(r["mix_rate"] + 1e-9)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination",
                                                      "secret scans", "mixing sources to target weights"]
