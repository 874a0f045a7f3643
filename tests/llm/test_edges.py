"""Odd inputs, larger brute-force comparisons and the whole pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontam, htmltext, knn, linededup, mixing, neardup, pii, simhash, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use inside, as extra columns of the input.
CLASHES = ["th", "host", "salt", "mark", "drop", "lines", "page", "w", "fp", "component", "node", "key", "gone", "bad", "id", "t", "start", "len", "target", "spots", "row", "kind", "occ", "y0", "f", "blk", "grp", "cell", "ring", "v", "b", "n", "rk", "lines_dropped"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def docs_of(spark, rows):
    """Rows of (id, text, source), with clashing extra columns."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def odd_rows(rng):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids."""
    long = words(rng, 30_000)
    base = [(i, words(rng, 40), "ab"[i % 2]) for i in range(12)]
    return [*base, base[0], base[0], (3, words(rng, 30), "a"), (None, base[1][1], "b"), (None, words(rng, 25), None), (None, None, None), (50, None, "a"), (51, "", "a"), (52, long, "b"), (53, long + " tail", "b"), (54, "x" * 200_000, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_rows(random.Random(11)))


LABELS = "doc_id long, quality int, toxic int"


def test_odd_documents(spark, odd):
    n, labels = odd.count(), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (3, 0, 1)], LABELS)
    bench = spark.createDataFrame([(1, odd_rows(random.Random(11))[2][1]), (1, None), (None, ""), (2, "one")], "item_id long, text string")
    kept = linededup.drop_boilerplate(odd)
    assert kept.count() == n and set(kept.columns) == set(odd.columns)
    assert [f.dataType for f in kept.drop("lines_dropped").schema] == [odd.schema[c].dataType for c in kept.columns if c != "lines_dropped"]
    for drop in (lambda d: decontam.decontaminate(d, bench), simhash.one_of_each, neardup.one_of_each, lambda d: toxicity.without_toxic(d, labels)):
        out = drop(odd)
        assert out.columns == odd.columns and 0 < out.count() <= n
    assert simhash.op8_components(odd).count() == pii.op9_spans(odd).count() == substrings.op10_bytes(odd).count() == mixing.op7_mix(odd).count() == n
    assert toxicity.toxic_documents(odd, labels).count() <= n and decontam.leaks(odd, bench).count() >= 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels, bench = spark.createDataFrame([], LABELS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three", "en", "s", 5)], DOCS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (linededup.op2_lines(docs), decontam.leaks(docs, bench), decontam.decontaminate(docs, bench), toxicity.toxic_documents(docs, labels), toxicity.without_toxic(docs, labels), mixing.op7_mix(docs), simhash.op8_components(docs), simhash.one_of_each(docs), neardup.one_of_each(docs), pii.op9_spans(docs), substrings.op10_bytes(docs), htmltext.extract(pages), warc.op1_digest(pages)):
        assert out.count() == 0
    assert decontam.leaks(some, bench).count() == 0 and toxicity.without_toxic(some, labels).count() == 1


def test_rows_that_share_an_id_are_judged_apart(spark):
    rng = random.Random(12)
    item, copy = words(rng, 30), words(rng, 80)
    rows = [(None, item, "s"), (None, words(rng, 40), "s"), (9, item, "s"), (9, words(rng, 41), "s"), (8, copy, "s"), (9, copy, "s"), (None, copy, "s"), (7, words(rng, 50), "s")]
    df, bench = docs_of(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")
    of = lambda out: sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert of(decontam.decontaminate(df, bench)) == sorted([(i, t) for i, t, _ in rows if t != item], key=str)
    want = sorted([(i, t) for i, t, _ in rows if not (t == copy and i != 8) and not (t == item and i is None)], key=str)
    assert of(simhash.one_of_each(df)) == want and of(neardup.one_of_each(df)) == want


def test_line_dedup_counts_texts_once(spark):
    rng = random.Random(13)
    copy = "menu\nsame body of a copied page"
    rows = [(i, f"menu\n{words(rng, 8)}", "h") for i in range(30)] + [(100 + i, copy, "h") for i in range(30)] + [(200, "menu\nalone", "one")]
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(docs_of(spark, rows), host_rows=7).collect()}
    assert all(r["lines_dropped"] == 1 for i, r in got.items() if i < 200) and got[100]["text"] == "same body of a copied page"
    assert got[200]["text"] == "menu\nalone"


def test_topk_prunes_clusters(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([c + 0.03 * rng.normal(size=(100, 16)) for c in centres])
    x[500:560] = x[500]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3, [9.0] * 16), (None, [1.0] * 16)]
    report = {}
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("cell"), F.lit(2).alias("v")), F.col("vec_id") % 20 == 0, k=5, group_queries=16, report=report).collect()
    q = np.floor(64 * x).astype(int)
    want = [(i, r, int(j), int(q[i] @ q[j])) for i in range(0, 2000, 20) for r, j in enumerate(np.lexsort((np.arange(2000), np.where(np.arange(2000) == i, 1 << 40, -(q @ q[i]))))[:5], 1)]
    assert sorted(tuple(r) for r in got) == want
    assert report["groups"] >= 6 and report["sent"] < 0.2 * report["groups"] * report["candidates"]


def test_topk_keeps_large_integers(spark):
    big = float(1 << 56)
    rows = [(0, [1.0, 0.0]), (1, [big, 1.0]), (2, [big, 2.0]), (20, [0.0, 1.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, scale=1).collect()}
    assert got[(0, 1)] == 1 << 56 and got[(20, 2)] == 2 and got[(20, 1)] == 1


def page(i, rng, nav="k1", art="k2", foot="k3"):
    body = "".join(f"<p>{words(rng, 30)}</p>" for _ in range(rng.randint(2, 5)))
    return f'<html><body><div class="{nav}"><a href="/">home {words(rng, 1)}</a></div><div class="{art}"><h1>title {i}</h1>{body}<div class="note">Subscribe to our list</div></div><div class="{foot}">{words(rng, 4)}</div></body></html>', f"title {i}\n" + "\n".join(re.findall("<p>(.*?)</p>", body))


def test_html_classes_find_the_article_without_names(spark):
    rng = random.Random(15)
    for names in (("k1", "k2", "k3"), ("entry-x", "content with-sidebar", "share-price")):
        pages = [page(i, rng, *names) for i in range(8)]
        df = spark.createDataFrame([(i, f"https://u@H.example:8080/{i}", p) for i, (p, _) in enumerate(pages)] + [(8, None, None), (9, "http://other/", pages[0][0])], "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("salt"))
        got = {r["page_id"]: r for r in htmltext.extract(df, host_rows=3).collect()}
        assert [got[i]["text"] for i in range(8)] == [t for _, t in pages]
        assert got[8]["text"] == "" and got[0]["n_chars"] == len(pages[0][1])


def test_html_names_are_matched_whole():
    text = '<article><div class="entry-header"><h1>Title</h1></div><div class="share-price"><p>up</p></div><p class="related-work">also</p><div class="comment-list">bad</div><div id="cookie-banner">bad</div></article>'
    assert htmltext.main_text(text) == "Title\nup\nalso"
    assert htmltext.main_text('<div class="content with-sidebar"><p>kept</p></div>') == "kept"


def test_html_walk_is_linear_and_vectors_are_exact(spark):
    tags, _ = htmltext.page_tokens("<b>x " * 200_000)
    assert len(tags) == 200_000
    htmltext.main_text("<dl>" + "<b>" * 20_000 + "<dt></dt>" * 50_000)
    rng = random.Random(16)
    pages = ["".join(rng.choice(["<p>", "<div>", "<b>", "</p>", "</div>", "t "]) for _ in range(40)) for _ in range(12)]
    rows = htmltext._token_rows(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).where("kind = 'tag'").distinct()
    vec = {r["token"]: r["vec"] for r in rows.groupBy("token").agg(F.sum(F.pmod(F.xxhash64("content", "n"), F.lit(1 << 40))).alias("vec")).collect()}
    true = {}
    for i, p in enumerate(pages):
        for path, entry in htmltext.page_tokens(p)[0].items():
            true.setdefault(path, {})[i] = entry[0]
    assert true.keys() == vec.keys()
    for a in true:
        for b in true:
            assert (true[a] == true[b]) == (vec[a] == vec[b])


def test_html_one_path_in_several_roles_is_told_apart(spark):
    rng = random.Random(17)
    arts = [[words(rng, 3), *(words(rng, 30) for _ in range(rng.randint(2, 5)))] for _ in range(12)]
    # Bare divs: menu, article and footer have one path, and so have, two levels deeper, the columns of the article's frame.
    frame = "<div><div><div>{0}</div><div><h1>{1}</h1>{2}</div></div></div>"
    def bare(a, deep):
        text = a[0], "".join(f"<p>{p}</p>" for p in a[1:])
        art = frame.format(words(rng, 2), *text) if deep else "<div><h1>{}</h1>{}</div>".format(*text)
        return f'<html><body><div><a href="/">home {words(rng, 1)}</a></div>{art}<div>{words(rng, 4)}</div></body></html>'
    rows = [(100 * deep + i, f"http://h{deep}.example/{i}", bare(a, deep)) for deep in (0, 1) for i, a in enumerate(arts)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {100 * deep + i: "\n".join(a) for deep in (0, 1) for i, a in enumerate(arts)}
    # Parts of one article are not told apart to its loss.
    two = [(i, f"http://t.example/{i}", f'<html><body><div class="k1">{words(rng, 1)}</div><div class="k2"><div><h1>{a[0]}</h1><p>{a[1]}</p></div><div><p>{a[2]}</p></div></div></body></html>') for i, a in enumerate(arts)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(two, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(a[:3]) for i, a in enumerate(arts)}


def test_html_classes_follow_vectors_order_and_nesting(spark):
    side, art = '<div class="s"><b>links</b></div>', '<div class="a"><h1>{0}</h1></div>'
    body = lambda i: (side + art if i % 2 else art + side).format(i) + ("" if i == 0 else '<div class="f"><i class="x">x</i></div>')
    pages = [f'<html><body><div class="h">top{"" if i == 0 else "<u>new</u>"}</div>{body(i)}</body></html>' for i in range(12)]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    seen = htmltext._token_rows(df).distinct()
    vec = F.sum(F.pmod(F.xxhash64("content", "n"), F.lit(1 << 40))).alias("vec")
    frequent = seen.where("kind = 'tag'").groupBy("host", "kind", "token").agg(vec, F.count("*").alias("pages"), F.avg(F.get("at", F.lit(0))).alias("mean"), F.first("step").alias("step"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("few").alias("few"), F.max("most").alias("most"))
    rows = [r.asDict() for r in frequent.join(htmltext._out_of_order(seen, frequent), ["host", "kind", "token"], "left").fillna(False, ["cut"]).collect()]
    classes = [{r["step"] for r in c} for c in htmltext.classes_of(rows)]
    of = {x: i for i, c in enumerate(classes) for x in c}
    assert of["html"] == of["body"] == of["div.class=h"] and of["div.class=a"] == of["h1"] and of["div.class=s"] == of["b"]
    assert of["div.class=a"] != of["div.class=s"], "the side's place changes"
    assert of["div.class=f"] == of["i.class=x"] != of["u"], "one vector, but in two elements of another class"
    assert len(htmltext.valid_tags(htmltext.classes_of(rows), 12)) == len(rows)
    assert htmltext.valid_tags(htmltext.classes_of(rows), 24) == set()


def test_html_repeated_class_must_start_anew(spark):
    pages = ["".join(x) + f"<s>{i}</s>" for i in range(6) for x in (["<b></b><i></i>"] * 2, ["<b></b><b></b><i></i><i></i>"])]
    seen = htmltext._token_rows(spark.createDataFrame([("h", pages[j]) for j in range(12)] , "host string, html string")).distinct()
    frequent = seen.where("kind = 'tag' and step in ('b', 'i')").groupBy("host", "kind", "token").agg(F.lit(1).alias("vec"), F.lit(0).alias("parent"), F.avg(F.get("at", F.lit(0))).alias("mean"))
    apart = seen.where("content in (%s)" % ", ".join(str(htmltext._hash(0, p)) for p in pages[::2]))
    assert [r["cut"] for r in htmltext._out_of_order(apart, frequent).collect()] == [False]
    assert [r["cut"] for r in htmltext._out_of_order(seen, frequent).collect()] == [True]


def similarity(doc, item):
    """Best exact similarity of any window of the item's length."""
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    want, best = grams(item), 0.0
    for s in range(max(1, len(doc) - len(item) + 1)):
        have, left = grams(doc[s : s + len(item)]), list(want)
        both = sum(g in left and not left.remove(g) for g in have)
        best = max(best, both / (len(have) + len(want) - both))
    return best


def test_decontamination_against_all_windows(spark):
    rng = random.Random(17)
    items = [words(rng, n).split() for n in (30, 60, 80, 3)]
    docs, rows = [], []
    for i in range(90):
        w = list(items[i % 3])
        for _ in range(rng.randint(0, 3)):
            at, how = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (how != 1)] = [] if how == 2 else [words(rng, 1)]
        docs.append(words(rng, rng.randint(0, 30)).split() + w + words(rng, rng.randint(0, 30)).split())
    docs += [words(rng, 50).split() + items[3], [], items[0][:26], items[0] * 2]
    rows = [(i, " ".join(d), "s") for i, d in enumerate(docs)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    want = {(i, k): s for i, d in enumerate(docs) for k, w in enumerate(items) if (s := similarity(d, w)) >= 0.8}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(docs_of(spark, rows), bench).collect()}
    near = [p for p, s in want.items() if s < 0.9]
    assert set(got) <= set(want) and len(near) >= 10
    assert all(got[p] == pytest.approx(want[p]) for p in got) and len(got) >= 0.98 * len(want)


def test_decontamination_finds_the_best_window_out_of_line_with_every_shingle(spark):
    rng = random.Random(23)
    new = lambda n: words(rng, n).split()
    item = new(400)
    # The window in line with the first part, or with the second, holds less than one between them.
    doc = [*new(3), *item[3:200], *new(10), *item[200:395], *new(30)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontam.leaks(docs_of(spark, [(0, " ".join(doc), "s"), (None, " ".join(new(20) + doc), "s")]), bench).orderBy("start_word").collect()
    assert [(r["doc_id"], r["start_word"]) for r in got] == [(0, 3), (None, 23)]
    assert all(r["similarity"] == pytest.approx(similarity(doc, item)) for r in got)


def test_simhash_against_the_definition(spark):
    rng = random.Random(18)
    base = words(rng, 300).split()
    texts = [" ".join(base[: 280 + i]) for i in range(21)] + ["A b", "a  B", "", None, words(rng, 5)]

    def of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps, comp = [of(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_components(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in range(len(texts))}


def test_pii_base_spans_against_expressions():
    rng, pieces = random.Random(19), ["a.b@x.org", "@", "1.2.3.4", "300.1.1.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", ".", " ", "-", "0", "12", "x", "ü@é.de", "..", "+", "(", "999.1"]
    exprs = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    for _ in range(3000):
        text, want = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))), []
        for k, e in enumerate(exprs):
            for m in re.finditer(e, text):
                digits = re.sub("[^0-9]", "", m[0])
                if k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 16 <= len(digits) <= 19 and luhn(digits) or k == 3 and 8 <= len(digits) <= 15:
                    want.append((k, m.start(), m.end()))
        assert pii.base_spans(text) == want, text


def test_pii_learns_from_both_sides_and_spares_ordinary_words(spark):
    seeds = [f"w{i} fax: +1 555 010 9{i:03d} ext v{i}" for i in range(20)]
    common = [f"the +1 555 020 9{i:03d} w{i}" for i in range(20)] + [" ".join(["the house"] * 30) for _ in range(5)]
    asked = ["new fax: 5550101234 here", "the 5550101235 is", "a fax: 77 z"]
    rows = [(i, t, "s") for i, t in enumerate([*seeds, *common, *asked])]
    got = {r["doc_id"]: r["spans"] for r in pii.op9_spans(docs_of(spark, rows)).collect()}
    assert got[45] == "phone:9:19" and got[46] == "" and got[47] == ""


def test_toxicity_held_out_and_chained(spark):
    rng = random.Random(20)
    rows = [(i, words(rng, 30) + (" junkword" if i % 2 else "") + (" vile" if i % 4 == 1 else ""), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(not i % 2), int(i % 4 == 1)) for i in range(240)], LABELS)
    df = docs_of(spark, rows)
    chain = toxicity.standard_chain(df, labels)
    assert [c.name for c in chain] == ["low_quality", "toxic"] and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    got = {r["doc_id"]: r["p_toxic"] for r in toxicity.classify(df, chain).collect()}
    assert all((p >= 0.2) == (i % 4 == 1) for i, p in got.items() if i >= 240)
    text = rows[1][1]
    by_hand = []
    for link in chain:
        z = link.bias + sum(link.words.get(f, 0.0) for f in toxicity.features_of(toxicity.vocabulary_of(text))) + sum(a * p for a, p in zip(link.earlier, by_hand, strict=True))
        by_hand.append(1 / (1 + np.exp(-z)))
    assert got[1] == pytest.approx(by_hand[1])


def test_mixing_rates_are_tilted_and_rounded(spark):
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randint(1, 50)), "abc"[i % 3]) for i in range(600)]
    out = mixing.mix(docs_of(spark, rows)).collect()
    for s in "abc":
        mine = [r for r in out if r["source"] == s]
        mean, target = sum(r["size"] for r in mine) / len(mine), mine[0]["target"]
        assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(target, rel=1e-6)
        tilt = [np.log(r["rate"] / (2 - r["rate"])) / (r["size"] / mean) for r in mine if 0 < r["rate"] < 2]
        assert not tilt or max(tilt) - min(tilt) < 1e-6  # odds exponential in the size: the entropy balance
        assert abs(sum(r["copies"] for r in mine) - sum(r["rate"] for r in mine)) < 0.05 * len(mine)
    again = mixing.mix(docs_of(spark, rows).repartition(3)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in out) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_substrings_tell_the_largest_id_from_null(spark):
    text = "ab" * 10 + "x" * 150
    rows = [((1 << 63) - 1, text, "s"), (None, text, "s")]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.op10_bytes(docs_of(spark, rows)).collect()}
    assert got[(1 << 63) - 1] == 149 and got[None] == len(text)  # the first run of x is new


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    item = words(rng, 40)
    texts = {i: words(rng, rng.randint(60, 120)) for i in range(80)}
    for i in range(0, 80, 8):
        texts[i] += " vileword"
    for i in range(1, 80, 8):
        texts[i] = f"menu bar\n{texts[i]}"
    texts |= {100 + i: texts[2 + 8 * i] + " end" for i in range(5)}  # near copies
    texts |= {110: f"{words(rng, 20)} {item} {words(rng, 20)}", 111: None, 112: ""}
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(80)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t in texts.items() if not (i < 80 and i % 8 == 0)}
    kept = {i: t.removeprefix("menu bar\n") if t else t for i, t in kept.items()}
    sets = {i: set(neardup.shingle_set(t).tolist()) for i, t in kept.items()}
    comp = {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = {k: min(a, b) if c in (a, b) else c for k, c in comp.items()}
    want = {i for i in kept if comp[i] == i and i != 110}
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    assert {r["doc_id"]: r["size"] for r in got} == {i: len((kept[i] or "").split()) for i in want}
    assert hashlib.sha256(str(sorted(got)).encode()).digest() == hashlib.sha256(str(sorted(corpus_pipeline.run(spark, str(tmp_path)).collect())).encode()).digest()
