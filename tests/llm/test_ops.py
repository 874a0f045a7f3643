"""Corpus operators against brute force on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, htmltext, knn, linededup, mixing, neardup, pii, simhash, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s"):
    rows = [(i, t, "en", source if isinstance(source, str) else source[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "x" * 200), (2, "http://a/2\r\n", "x" * 200), (3, None, None), (4, "http://b", "é" * 120), (None, "u", "x" * 200), (5, "v", "short"), (6, "v", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.op1_digest(df).collect()}
    assert len(got) == 7
    assert (got[1]["record_type"], got[2]["record_type"], got[2]["refers_to"], got[None]["refers_to"]) == ("response", "revisit", 1, 1)
    assert got[4]["payload_bytes"] == 240 and got[3]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert got[5]["record_type"] == got[6]["record_type"] == "response"
    assert warc.op1_digest(df.limit(0)).count() == 0


def test_line_dedup(spark):
    texts = ["menu\nbody %d\n" % i for i in range(9)] + [None, ""]
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(docs_of(spark, texts), max_ratio=0.5).collect()}
    assert got[3]["text"] == "body 3\n" and got[3]["lines_dropped"] == 1
    assert got[9]["text"] is None and got[10]["text"] == "" and len(got) == 11


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(130, 6)).round(2)
    x[50:80] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, float("nan")] * 3), (902, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(df, F.col("vec_id") % 20 == 0, k=7, pivots=5, group_queries=2, block_rows=16).collect())
    q = np.floor(64 * x).astype(int)
    want = []
    for i in range(0, 130, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(130) if j != i)[:7]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert knn.op3_topk(df.limit(0)).count() == 0


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href="#">Menu</a></nav><div class="ad">Buy</div><article><h1>T&amp;itle</h1><p>One  two<p>Thr&eacute;e <b>four</b></p><form>Sign up</form><div class="comments">Nice</div></article><footer>F</footer></body></html>'
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "plain & simple <b>text")]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T&itle\nOne two\nThrée four", 2: "", 3: "", 4: "plain & simple text"}


def test_decontamination(spark):
    rng = random.Random(2)
    item = words(rng, 30)
    texts = [words(rng, 80) + " " + item.upper() + ". " + words(rng, 20), words(rng, 200), None, "", item, " ".join(item.split()[:12])]
    bench = spark.createDataFrame([(7, item), (8, "two words"), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(docs_of(spark, [*texts, "Two, words"]), bench).collect()}
    assert got == {(0, 7): 1.0, (4, 7): 1.0, (6, 8): 1.0}
    assert {r["doc_id"] for r in decontam.decontaminate(docs_of(spark, texts), bench).collect()} == {1, 2, 3, 5}


def test_toxicity_chain(spark):
    rng = random.Random(3)
    texts = [words(rng, 40) + (" vileword" if i % 5 == 0 else "") for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, texts)
    assert {r["doc_id"] for r in toxicity.toxic_documents(df, labels).collect()} == set(range(0, 300, 5))
    assert toxicity.without_toxic(df, labels).count() == 242
    assert toxicity.toxic_documents(df, labels.limit(0)).count() == 0


def test_mixing_targets(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(240)] + [None, ""]
    source = ["abc"[i % 3] if i < 150 else "c" for i in range(240)] + [None, "z"]
    rows = mixing.op7_mix(docs_of(spark, texts, source)).collect()
    assert len(rows) == 242 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    size, taken, target = {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    total, open_, want = 1.5 * sum(size.values()), dict(zip(["a", "b", "c", "z", None], [3, 1, 2, 3, 1], strict=True)), {}
    while open_:
        w = sum(open_.values())
        full = [s for s in open_ if total * open_[s] / w > 2 * size[s]]
        if not full:
            want |= {s: total * open_[s] / w for s in open_}
            break
        for s in full:
            want[s] = 2 * size[s]
        total -= sum(want[s] for s in full)
        open_ = {s: v for s, v in open_.items() if s not in full}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 2


def test_simhash_components(spark):
    rng = random.Random(5)
    base = words(rng, 400)
    texts = [base, base + " end", words(rng, 300), base, None, "", "One two", "one  TWO"]
    got = {r["doc_id"]: r for r in simhash.op8_components(docs_of(spark, texts)).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    parent = {i: min(j for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in fps}
    assert {i: r["component_id"] for i, r in got.items()} == {i: parent[parent[i]] for i in fps}
    assert got[4]["fingerprint"] == "0" * 16 and got[6]["component_id"] == got[7]["component_id"]


def test_bit_sliced_forest():
    rng = np.random.default_rng(6)
    f = []
    for b in rng.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(5):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(k)
            f.append(x)
    f = np.array(sorted(set(f)), dtype=np.uint64)
    row, root = simhash.forest(f, np.zeros(len(f), int), 2)
    label = np.arange(len(f))
    label[row] = root
    for i in range(len(f)):
        for j in range(i):
            if bin(int(f[i]) ^ int(f[j])).count("1") <= 2:
                assert label[i] == label[j]


def test_pii(spark):
    text = "mail a.b@x.org, ip 1.2.3.4 and 999.1.1.1 card 4111 1111 1111 1111 call +1 (555) 010-9999."
    spans = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    assert spans == [("email", "a.b@x.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    seeds = [f"please ring me +1 555 010 9{i:03d}" for i in range(12)]
    rows = pii.op9_spans(docs_of(spark, [*seeds, "so ring me 5550101234 now", None])).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[12]["n_phone"] == 1 and got[12]["spans"] == "phone:11:21" and got[13]["spans"] == ""
    assert got[13]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_substrings_match_brute_force(spark):
    rng = random.Random(7)
    shared, other = words(rng, 60), words(rng, 30)
    texts = [words(rng, 50) + shared + words(rng, 10), shared, "é" * 150, None, "", other + shared[40:] + other, words(rng, 90), "é" * 160, "ab" * 200]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            g = b[p : p + 100]
            if g in seen:
                cover[p : p + 100] = True
            seen.add(g)
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        want[i] = (len(b), int(cover.sum()), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.op10_bytes(docs_of(spark, texts)).collect()}
    assert got == want


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [words(rng, rng.randint(120, 200)) for _ in range(30)]
    for i in range(40):  # copies with one to nine changed words, some far from the threshold, some near it
        w = texts[rng.randrange(len(texts))].split()
        for k in rng.sample(range(len(w)), rng.randint(1, 9)):
            w[k] = "zz%d" % i
        texts.append(" ".join(w))
    texts += [texts[0], None, "", "One two", "one  TWO"]
    sets = [set(neardup.shingle_set(t).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, texts), "").collect()}
    assert kept == set(comp) and len(kept) < 60
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, texts), block=4).collect()}
    assert got == dict(enumerate(comp))
    assert neardup.one_of_each(docs_of(spark, texts).limit(0)).count() == 0


def test_long_repeated_runs_keep_their_length(spark):
    d, start, length = np.zeros(3, np.int64), np.array([1, 20_001, 20_301]), np.array([20_000, 300, 20_000])
    blobs = [b["blob"][0].as_py() for i in range(3) for b in substrings._packed(np.zeros(1, np.int64), np.array([5]), np.array([6]), d[:1], [substrings._code(start[i : i + 1], length[i : i + 1], 0)])]
    (row,) = substrings._gather(blobs)
    codes = row["codes"][0].values.to_numpy()
    covered = {p for s, e in substrings.removed_spans(codes, 100).tolist() for p in range(s, e)}
    assert covered == set(range(1, 1 + 40_300 + 99))
    rng = random.Random(9)
    long, middle = "".join(rng.choices("abcdefghij \n", k=1_150_000)), "".join(rng.choices("klmnop", k=70_000))
    texts = [long, middle[:20_100] + "x" + middle[20_300:45_000], middle, "y" + middle + long[300_000:380_000] + "z", long[:700_000] + "q" + long[700_000:]]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 99):
            g = hash(t[p : p + 100])
            if g in seen:
                cover[p] += 1
            seen.add(g)
        inside = np.convolve(cover[:-1], np.ones(100, int))[: len(t)] > 0
        want[i] = (len(t), int(inside.sum()), int((np.diff(np.concatenate([[0], inside.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~inside].tobytes()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.op10_bytes(docs_of(spark, texts)).collect()}
    assert got == want


def test_pii_second_generation_pattern(spark):
    seeds = [f"please ring me +1 555 010 9{i:03d}" for i in range(30)]
    first = [f"so ring me 55501017{i:02d} now" for i in range(10)]
    second = [f"or dial at 55501017{i:02d} now" for i in range(10)]
    rows = pii.op9_spans(docs_of(spark, [*seeds, *first, *second, "or dial at 5550109999 now", "we met on 5550109998 now"])).collect()
    got = {r["doc_id"]: r["spans"] for r in rows}
    assert got[30] == "phone:11:21" and got[40] == "phone:11:21"
    assert got[50] == "phone:11:21" and got[51] == ""
