"""Near-duplicate components of five-word shingles: SimHash with bit-sliced comparison, verified exactly.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of at least 0.8. At that similarity a bit of their SimHashes differs
in about 15 of 100 cases: in 10 of 64 bits (deviation 3), in 78 of 512
(deviation 8). Twenty-one blocks of 64 bits are 3 or 4 bits each, too few to
choose whom to compare; that is left to 28 bands of five MinHash values, in
which a pair at the threshold has all bands apart in some 2 of 100,000 cases.
Inside a bucket the first 64 bits stand in bit planes, and carry-save counters
add up the distances of one row to all the others at once (see ``simhash``), up
to 20 of them; all 512 bits thin what is left, up to 110. Sums of fewer than
``SURE`` shingles are coarser (19 of 100 bits may differ), so there only the 512
bits are asked, up to 135. A pair counts in the first band that it shares. Pairs
that pass are verified by their exact similarity.

First every band bucket is compared with its smallest node only. Then all pairs
of a bucket that are not yet in one component follow, so none is left out and a
large group of copies does not cost its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.simhash import near, planes, without_copies
from tessera.operators.components import connected_components
from tessera.sources.workdir import written

BANDS, ROWS, RADIUS, WORDS, WIDE, SURE, COARSE = 28, 5, 20, 8, 110, 16, 135
_RNG = np.random.default_rng(20261)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(1, 1 << 63, WORDS - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, words as in ``simhash.fingerprint``; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(width)), strict=False)], dtype=np.uint64))


def signature(h: np.ndarray, step: int = 1024) -> tuple[list[int], list[int]]:
    """Band names and SimHash (``WORDS`` times 64 bits, the first from the hashes themselves) of a shingle set, as signed longs."""
    low, ones = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(h), step):
        part = h[at : at + step]
        low = np.minimum(low, (part[:, None] * _A + _B).min(axis=0))
        more = (part ^ part >> np.uint64(32))[:, None] * _MIX
        bits = np.concatenate([part[:, None], more ^ more >> np.uint64(29)], axis=1)
        ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    keys = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))], dtype=np.uint64)
    return keys.view(np.int64).tolist(), np.packbits(2 * ones > len(h), bitorder="little").view(np.int64).tolist()


def _signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            n, fps, keys = [], [], []
            for t in batch.column(2):
                h = shingle_set(t.as_py(), width)
                bands, fp = signature(h)
                n.append(len(h))
                fps.append(fp)
                keys.append(bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "fp", "keys"])

    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(t), t).mapInArrow(run, "doc_id long, node long, n long, fp array<long>, keys array<long>")


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole SimHashes are within the radius."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("fp").alias(f"f{x}"), F.col("n").alias(f"n{x}"))
    apart = " + ".join(f"bit_count(fa[{i}] ^ fb[{i}])" for i in range(WORDS))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(F.expr(f"{apart} <= if(least(na, nb) < {SURE}, {COARSE}, {WIDE})")).select("a", "b")


def _similar(pairs: DataFrame, docs: DataFrame, text: str, width: int, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose exact similarity reaches the threshold; only their texts are cut into shingles again."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hs"])

    pairs = written(pairs, "neardup-pairs")
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    # Written, so that it is broadcast only if its size is known to be small.
    asked = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "neardup-asked")
    texts = docs.select(F.xxhash64(t).alias("node"), t.alias("t")).join(asked, "node", "left_semi")
    sets = written(texts.mapInArrow(run, "node long, hs array<long>").dropDuplicates(["node"]), "neardup-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hs").alias("hb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("s"), (F.size("ha") + F.size("hb")).alias("t"))
    return written(shared.where(F.col("s") >= F.lit(threshold) * (F.col("t") - F.col("s"))).select("a", "b"), "neardup-links", drops=(sets, asked, pairs))


def _across(node, comp, n, band, fp, tags, threshold):
    """Pairs of a bucket that lie in different components, share no earlier band and may reach the threshold."""
    _, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
    if len(counts) < 2:
        return
    # Rows of the largest component come last and are never compared with one another.
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")[inverse]
    order = np.argsort(rank, kind="stable")
    node, rank, n, fp, tags = (x[order] for x in (node, rank, n, fp, tags[:, : band[0]]))
    rows = planes(np.ascontiguousarray(fp[:, 0]).view(np.uint64))
    few = int.from_bytes(np.packbits(n < SURE, bitorder="little").tobytes(), "little")
    for i in range(int(np.searchsorted(rank, rank[-1]))):
        fits = (rank > rank[i]) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]))
        valid = int.from_bytes(np.packbits(fits, bitorder="little").tobytes(), "little")
        if not valid:
            continue
        found = valid if n[i] < SURE else near(rows, int(fp[i, 0]), valid, RADIUS) | valid & few
        if found:
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(found.to_bytes((len(n) + 7) // 8, "little"), np.uint8), bitorder="little"))
            hit = hit[np.bitwise_count(fp[hit] ^ fp[i]).sum(axis=1) <= np.where(np.minimum(n[hit], n[i]) < SURE, COARSE, WIDE)]
            hit = node[hit[~(tags[hit] == tags[i]).any(axis=1)]]
            if len(hit):
                yield np.minimum(hit, node[i]), np.maximum(hit, node[i])


def _rest(keyed: DataFrame, nodes: DataFrame, comp: DataFrame, threshold: float, block: int) -> DataFrame:
    """Candidate pairs of all buckets that hold more than one component.

    As in ``simhash.links``, a bucket above ``block`` rows is dealt over pairs of sub-blocks.
    """
    known = keyed.join(comp.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = known.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key", F.ceil(F.col("rows") / block).cast("int").alias("subs"))
    dealt = known.join(mixed, "key").join(nodes.select("node", "fp", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("tags")), "node").withColumn("s", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
    spread = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select("key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "node", "comp", "n", "band", "fp", "tags")

    def run(batches):
        held = None

        def pairs(cols, cut):
            found = [p for lo, hi in zip(cut[:-1], cut[1:], strict=True) if hi - lo > 1 for p in _across(*[c[lo:hi] for c in cols[3:]], threshold)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns[:7]] + [batch.column(7 + k).flatten().to_numpy().reshape(-1, w) for k, w in enumerate((WORDS, BANDS))]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            cut = np.concatenate([[0], new])
            yield from pairs(cols, cut)
            held = [c[cut[-1] :] for c in cols]
        if held is not None:
            yield from pairs(held, [0, len(held[0])])

    return spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, block: int = 2048) -> DataFrame:
    """Return ``doc_id, th, component, component_id`` for every row.

    Texts whose shingle sets are at least ``threshold`` similar are linked;
    ``component_id`` is the smallest id reachable. Equal texts (named by 64 bits)
    are one node; null and empty texts are equal. Repeated rows and rows with a
    null id keep their row and their component; a component of null ids alone
    has a null id. Texts may be of any length, other columns of any name. An
    empty table gives an empty result.
    """
    base = written(_signatures(docs, doc_id, text, width), "neardup")
    nodes = written(base.select("node", "n", "fp", "keys").dropDuplicates(["node"]), "neardup-nodes")
    keyed = nodes.select(F.posexplode("keys").alias("band", "key"), "node", "n")
    first = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("rows")).where("rows > 1")
    sizes = F.least("n", "c.n") >= F.lit(threshold) * F.greatest("n", "c.n")
    star = keyed.join(first.select("key", "c"), "key").where(F.col("node") > F.col("c.node")).where(sizes).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
    linked = _similar(_close(star, nodes), docs, text, width, threshold)
    some = written(connected_components(linked, "a", "b"), "neardup-some")
    more = _similar(_rest(keyed, nodes, some, threshold, block), docs, text, width, threshold)
    comp = connected_components(linked.unionByName(more), "a", "b")
    known = base.select("doc_id", "node").join(comp, "node", "left").select("doc_id", F.col("node").alias("th"), F.coalesce("component", "node").alias("component"))
    known = written(known, "neardup-components", drops=(base, nodes, linked, some, more))
    return known.join(known.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "th", "component", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Keep one document of each component; see ``simhash.without_copies`` for which, and for repeated and null ids."""
    return without_copies(docs, near_duplicates(docs, doc_id, text, **options), doc_id, text)
