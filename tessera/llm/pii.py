"""Personal data: patterns of form, and contexts learnt from them by bootstrapping.

Spans that have the form of an email address, ip address, card or phone number
are the seeds. The words around an identifier are lexical patterns of its kind:
one or two words before it, two words after it, the word before together with the
word after. Other identifier-like tokens in the same places are instances of the
pattern. Patterns and instances score one another in rounds on the bipartite
graph of their occurrences, counted over the whole corpus: a pattern is worth the
share of its places that hold a known instance, an instance as much as its best
admitted pattern. Instances of admitted patterns raise further patterns in the
next round, until a round admits nothing new; the instances of all admitted
patterns become spans.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.workdir import written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
EDGE = ".,;:!?()[]{}<>\"'"


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Return (kind index, start, end) of all spans by form, by kind and start.

    Leftmost, longest and non-overlapping for each kind; a match that fails its
    check is dropped without another try. Linear in the text.
    """
    out = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    low = 0
    for run in DIGITS.finditer(text) if "." in text else ():
        if run.start() >= low and (m := IP.match(text, run.start())):
            low = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _named(word: str) -> str:
    """A word, or a short name of a very long one."""
    return word if len(word) <= 64 else f"{word[:16]}~{xxhash.xxh64_hexdigest(word.encode('utf-8', 'surrogatepass'))}"


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The last two words before ``start`` and the first two from ``end`` on, whole, lower-cased."""
    reach, left, right = 64, [], []
    while len(left) < 3 and reach < 2 * start + 128:
        left, reach = text[max(0, start - reach) : start].split(), reach * 4
    reach = 64
    while len(right) < 3 and reach < 2 * (len(text) - end) + 128:
        right, reach = text[end : end + reach].split(), reach * 4
    return [_named(w.lower()) for w in left[-2:]], [_named(w.lower()) for w in right[:2]]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of the place of a span."""
    left, right = _around(text, start, end)
    out = [f"1 {left[-1]}"] if left else []
    if len(left) == 2:
        out.append("2 " + " ".join(left))
    if len(right) == 2:
        out.append("3 " + " ".join(right))
    if left and right:
        out.append(f"4 {left[-1]} {right[0]}")
    return out


def _shape(token: str) -> int | None:
    digits = sum("0" <= c <= "9" for c in token)
    if 0 < token.find("@") < len(token) - 1:
        return 0
    if digits and sum(c.isalpha() for c in token) * 2 > len(token):
        return None
    if token.count(".") == 3 and all(p.isdigit() for p in token.split(".")):
        return 1
    return 2 if digits >= 13 else 3 if digits >= 7 else None


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-like tokens outside ``spans``, with the kind that their shape suggests."""
    taken = sorted((s, e) for _, s, e in spans)
    out, at, k = [], 0, 0
    while m := MARK.search(text, at):
        start = end = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        token = text[start:end]
        start, end = start + len(token) - len(token.lstrip(EDGE)), end - len(token) + len(token.rstrip(EDGE))
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end > start and (k == len(taken) or taken[k][0] >= end) and (kind := _shape(text[start:end])) is not None:
            out.append((kind, start, end))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


OCC = pa.list_(pa.struct([("kind", pa.int32()), ("ctx", pa.list_(pa.string())), ("inst", pa.string()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))
SCAN = "row long, doc_id long, base array<struct<kind:int,start:int,end:int>>, occ array<struct<kind:int,ctx:array<string>,inst:string,seed:boolean,start:int,end:int>>"
PATTERNS = 200_000  # patterns counted in one pass over the texts


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One pass over the texts: base spans and the occurrences of seeds and candidates."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            base, occ = [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                found, near = [], []
                if MARK.search(t):
                    found = base_spans(t)
                    for seed, spans in ((True, found), (False, candidates(t, found))):
                        near += [{"kind": k, "ctx": contexts(t, s, e), "inst": _named(t[s:e].lower()), "seed": seed, "start": s, "end": e} for k, s, e in spans]
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                occ.append(near)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(base)), pa.int64()), batch.column(0), pa.array(base, base_type), pa.array(occ, OCC)], names=["row", "doc_id", "base", "occ"])
            row += len(base)

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, SCAN)


def places(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """Count the places of ``patterns(ctx)`` in all texts, whatever stands there: ``ctx, total``.

    The patterns go out in parts of about ``PATTERNS``, so that what a task holds is bounded.
    """
    spark = docs.sparkSession
    parts = max(1, -(-patterns.count() // PATTERNS))
    out = None
    for part in range(parts):
        known = [r[0] for r in patterns.where(F.pmod(F.xxhash64("ctx"), F.lit(parts)) == part).collect()]
        after: dict[str, list] = {}  # by a word of the pattern: kinds and their other words
        for c in known:
            kind, *ws = c.split(" ")
            after.setdefault(ws[0], []).append((kind, ws[1] if len(ws) > 1 else "", c))
        shared = spark.sparkContext.broadcast({w: {(k, o): c for k, o, c in v} for w, v in after.items()})

        def run(batches, shared=shared):
            after = shared.value
            for batch in batches:
                counts: dict[str, int] = {}
                for t in batch.column(0):
                    words = (t.as_py() or "").lower().split()
                    for i, w in enumerate(words):
                        own = after.get(w) if len(w) <= 64 else after.get(_named(w))
                        if own is None:
                            continue
                        one, two = (_named(words[j]) if j < len(words) else None for j in (i + 1, i + 2))
                        for key in (("1", ""), ("2", one), ("3", one), ("4", two)):
                            if key in own:
                                counts[own[key]] = counts.get(own[key], 0) + 1
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["ctx", "n"])

        found = docs.select(docs[text].cast("string")).mapInArrow(run, "ctx string, n long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("ctx").agg(F.sum("n").alias("total"))


def confident_patterns(occ: DataFrame, docs: DataFrame, text: str, min_score: float = 0.5, min_support: float = 5.0) -> DataFrame:
    """Score patterns against instances; returns ``kind, ctx, p`` of the patterns to trust.

    A seed scores 1, another instance as its best admitted pattern did in the
    round before (0 at first). A pattern scores the sum over its places of their
    instances' scores, divided by all its places in the corpus, those of ordinary
    words too. A round admits the patterns that score at least ``min_score`` and
    whose distinct instances' scores sum to at least ``min_support``. Rounds end
    when one admits nothing new; scores never fall, so they do end. Both sides
    are grouped aggregates over (pattern, instance) edges.
    """
    edges = written(occ.select("kind", "inst", "seed", F.explode("ctx").alias("ctx")).groupBy("kind", "ctx", "inst").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-edges")
    # No instance scores above 1, so only patterns with enough instances can ever be admitted.
    wide = edges.groupBy("kind", "ctx").agg(F.count("*").alias("insts"), F.sum("n").alias("held")).where(F.col("insts") >= min_support)
    wide = written(wide, "pii-wide")
    total = places(docs, text, wide.select("ctx").distinct())
    # Where even known instances at all places could not reach the score, nothing can.
    able = wide.join(total, "ctx", "left").select("kind", "ctx", F.greatest("held", F.coalesce("total", "held")).alias("total"), "held").where(F.col("held") >= F.lit(min_score) * F.col("total"))
    edges = written(edges.join(able.select("kind", "ctx", "total"), ["kind", "ctx"]), "pii-able", drops=(wide, edges))
    score = edges.groupBy("kind", "inst").agg(F.max(F.col("seed").cast("double")).alias("s"))
    mark, trusted = None, None
    while True:
        sums = edges.join(score, ["kind", "inst"]).groupBy("kind", "ctx").agg(F.sum("s").alias("support"), (F.sum(F.col("s") * F.col("n")) / F.max("total")).alias("p"))
        admitted = written(sums.where((F.col("support") >= min_support) & (F.col("p") >= min_score)).select("kind", "ctx", "p"), "pii-patterns", drops=(trusted,) if trusted is not None else ())
        trusted, now = admitted, admitted.count()
        if now in (0, mark):
            return trusted
        mark = now
        score = edges.join(trusted, ["kind", "ctx"], "left").groupBy("kind", "inst").agg(F.greatest(F.max(F.col("seed").cast("double")), F.coalesce(F.max("p"), F.lit(0.0))).alias("s"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Return ``doc_id, base, added`` for every row: spans by form, and those that trusted patterns add.

    Null and empty texts have no spans. Repeated rows and null ids are separate
    rows. Added spans never overlap base spans of their document. Positions are
    code points, the end is exclusive. Texts and words may be of any length,
    other columns of any name. An empty table gives an empty result.
    """
    base = written(scan(docs, doc_id, text), "pii-scan")
    occ = base.select("row", F.explode("occ").alias("o")).select("row", "o.*")
    trusted = confident_patterns(occ, docs, text, **options)
    hits = occ.where("not seed").select("row", "kind", "start", "end", F.explode("ctx").alias("ctx")).join(trusted.select("kind", "ctx"), ["kind", "ctx"])
    added = written(hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")), "pii-added", drops=(trusted,))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return base.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def op9_spans(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    found = find(docs)

    def text_of(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.expr(f"size(filter(concat(base, added), s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.concat("base", "added")).alias("spans"))
