"""SimHash near-duplicate components with bit-sliced comparison.

Fingerprints are taken over whole texts. Distinct fingerprints are bucketed by
each of radius + 1 blocks of their bits: two within the radius agree in one
block at least. In a bucket the bits stand in vertical planes, one long integer
a bit; shifting a plane by a lag compares all rows with their lag-th neighbour
at once, and carry-save counters add up the differing bits of all those pairs
together. A lag is abandoned once every pair of it exceeds the radius. Buckets
yield a spanning forest of their links, not the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.sources.workdir import written

SMALL = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42, step: int = 1 << 16) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles join
    ``width`` words with a space and count with repeats. Fewer words: the whole
    sequence is one shingle. No words, or null: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    total, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, total, step):
        part = words[at : min(at + step, total) + width - 1]
        h = np.array([digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(width)), strict=False)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str, text: str, width: int = 3) -> DataFrame:
    """Return ``doc_id, th, fp`` for every row: a 64-bit name of the text and the fingerprint as a signed long."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "th", "fp"])

    return docs.select(docs[doc_id].cast("long"), F.xxhash64(t), t).mapInArrow(run, "doc_id long, th long, fp long")


def planes(fps: np.ndarray) -> list[int]:
    """Turn fingerprints into 64 vertical bit planes; bit i of a plane belongs to row i."""
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in packed]


def counted(differences, valid: int, radius: int) -> int:
    """Return the bits of ``valid`` that are set in at most ``radius`` of 64 ``differences``.

    ``counter[j]`` holds bit j of every pair's count so far (carry-save); a
    carry out of the top bit, or a count beyond the radius, marks a pair as dead.
    Stops once all are dead.
    """
    size = (radius + 1).bit_length()
    counter, alive = [0] * size, valid
    for step, plane in enumerate(differences, 1):
        carry = plane & alive
        for j in range(size):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
            if not carry:
                break
        alive &= ~carry
        if step % 4 == 0 and step > radius:
            over, equal = 0, alive
            for j in reversed(range(size)):
                if radius >> j & 1:
                    equal &= counter[j]
                else:
                    over |= equal & counter[j]
                    equal &= ~counter[j]
            alive &= ~over
            if not alive:
                return 0
    return alive


def within(rows: list[int], lag: int, valid: int, radius: int) -> int:
    """Return the pairs (i, i + lag) of ``valid`` that differ in at most ``radius`` bits, as a bit mask."""
    return counted((plane ^ (plane >> lag) for plane in rows), valid, radius)


def near(rows: list[int], fp: int, valid: int, radius: int) -> int:
    """Return the rows of ``valid`` that differ from ``fp`` in at most ``radius`` bits, as a bit mask."""
    return counted((valid & ~plane if fp >> b & 1 else plane for b, plane in enumerate(rows)), valid, radius)


def forest(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Link rows of equal ``bucket`` (sorted) within the radius; returns (row, root) of the forest's edges."""
    n = len(fps)
    root = np.arange(n)
    if n < 2:
        return root[:0], root[:0]
    rows = planes(fps)
    _, starts, sizes = np.unique(bucket, return_index=True, return_counts=True)
    whole = len(sizes) == 1
    for lag in range(1, int(sizes.max())):
        same = bucket[lag:] == bucket[:-lag]
        if whole and (root == root[0]).all():
            break
        valid = int.from_bytes(np.packbits(same & (root[lag:] != root[:-lag]), bitorder="little").tobytes(), "little")
        found = within(rows, lag, valid, radius) if valid else 0
        if found:
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(found.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
            for i in hit:
                a, b = i, i + lag
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            while True:
                nxt = root[root]
                if (nxt == root).all():
                    break
                root = nxt
    row = np.flatnonzero(root != np.arange(n))
    return row, root[row]


def links(fps: DataFrame, radius: int = 2, block: int = 2048) -> DataFrame:
    """Return edges ``a, b`` that connect all distinct fingerprints within the radius of each other.

    A bucket above ``block`` rows is dealt over pairs of sub-blocks, so no task
    holds more than two sub-blocks of one bucket and no pair is left out.
    """
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(radius + 1)]
    keyed = fps.select("fp", F.posexplode(F.array(*parts)).alias("tab", "val"))
    big = keyed.groupBy("tab", "val").agg(F.count("*").alias("n")).where(F.col("n") > block).select("tab", "val", F.ceil(F.col("n") / block).cast("int").alias("subs"))
    dealt = keyed.join(big, ["tab", "val"], "left").withColumn("subs", F.coalesce("subs", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    pairs = dealt.withColumn("o", other).select("fp", "tab", "val", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "subs")
    spread = pairs.repartition("tab", "val", "i", "j").sortWithinPartitions("tab", "val", "i", "j", "fp")

    def flush(fp, key):
        if len(fp) < 2:
            return
        fp = np.array(fp, np.int64)
        row, root = forest(fp.view(np.uint64), np.array(key), radius)
        if len(row):
            yield pa.RecordBatch.from_pydict({"a": pa.array(fp[row]), "b": pa.array(fp[root])})

    def run(batches):
        last, k, bucket = None, 0, []  # rows of the open bucket
        fp, key = [], []  # closed small buckets, compared together
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for row in zip(*cols, strict=True):
                if row[1:] != last:
                    if 1 < len(bucket) <= SMALL:
                        fp += bucket
                        key += [k] * len(bucket)
                    elif len(bucket) > SMALL:
                        yield from flush(bucket, [0] * len(bucket))
                    last, k, bucket = row[1:], k + 1, []
                    if len(fp) > 20_000:
                        yield from flush(fp, key)
                        fp, key = [], []
                bucket.append(row[0])
        if 1 < len(bucket) <= SMALL:
            fp, key = fp + bucket, key + [k] * len(bucket)
        elif len(bucket) > SMALL:
            yield from flush(bucket, [0] * len(bucket))
        yield from flush(fp, key)

    return spread.select("fp", "tab", "val", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """Return ``doc_id, th, fp, component, component_id, fp_docs`` for every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id reachable, ``component`` the smallest
    fingerprint. Null and empty texts share fingerprint zero and are linked like
    any other. Repeated rows and rows with a null id keep their row and their
    component; a component of null ids alone has a null id. Texts may be of any
    length, other columns of any name. An empty table gives an empty result.
    """
    base = written(fingerprints(docs, doc_id, text, width), "simhash")
    distinct = base.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("fp_docs"))
    edges = links(distinct.select("fp"), radius)
    comp = connected_components(edges, "a", "b")
    known = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "low", "fp_docs", F.coalesce("component", "fp").alias("component"))
    known = written(known, "simhash-components")
    lows = known.groupBy("component").agg(F.min("low").alias("component_id"))
    table = known.join(lows, "component").select("fp", "component", "component_id", "fp_docs")
    return base.join(table, "fp").select("doc_id", "th", "fp", "component", "component_id", "fp_docs")


def without_copies(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Keep one document of each component of ``found(doc_id, th, component)``, with all its columns.

    It is the one with the smallest id (null last), then the smallest name of the
    text. A document is an id with a text: rows that repeat both are one
    document and stay or go together, rows that share only an id (or its absence)
    are judged apart.
    """
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("k"))
    gone = found.join(first, "component").where(F.expr("not (doc_id <=> k.doc_id and th = k.th)")).select("doc_id", "th").distinct()
    gone = written(gone, "copies")
    th = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    return docs.join(gone, docs[doc_id].cast("long").eqNullSafe(gone["doc_id"]) & (th == gone["th"]), "left_anti")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """Keep one document of each near-duplicate component; see ``without_copies`` for which, and for repeated and null ids."""
    return without_copies(docs, near_duplicates(docs, doc_id, text, radius, width), doc_id, text)


def op8_components(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
