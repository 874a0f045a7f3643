"""Exact removal of repeated byte strings by bucket-pointer refinement.

A position's q-gram bucket is named by a hash; the bucket of twice the length
is named from the buckets at the position and q further on, and so on until the
buckets are those of the n-byte strings. Buckets are only kept where they can
decide something:

1. Every n-byte string contains one anchor, the leftmost smallest of its q-gram
   buckets. Neighbouring strings share anchors, so a document is a short list of
   anchors, each with the run of strings that hang on it. Equal runs (named from
   the buckets at both ends) form a class. All but the first of a class are
   repeats as a whole.
2. A first run whose bucket has no other class is new as a whole.
3. The remaining runs - the edges of repeated passages - are cut into shorter
   runs, named from the longer core that their strings share, and settled in the
   same way; at last each string is a run of its own and its bucket decides.

Each task first settles what it can among its own rows and sends one row for
each class or bucket, so that a passage which a third of all documents share is
a few rows from each task. Names are 96 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.workdir import written

U = np.uint64
STEP, FLUSH = 1 << 20, 2_000_000
LAST = (1 << 63) - 1


def _blend(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Name the pair of two buckets."""
    with np.errstate(over="ignore"):
        r = a * U(0x9E3779B97F4A7C15 + 2 * salt)
        r ^= r >> U(29)
        r += b
        r *= U(0xBF58476D1CE4E5B9)
        r ^= r >> U(32)
    return r


def _refined(data: np.ndarray, q: int, n: int):
    """Bucket names of the q-grams, of the longest power of two below n, and of the n-grams, at every position."""
    table = np.random.default_rng(20260).integers(1, 1 << 63, 256, dtype=np.uint64)
    cur, size, grams = table[data], 1, None
    while size * 2 <= n:
        cur = _blend(cur[:-size], cur[size:], size)
        size *= 2
        if size == q:
            grams = cur
    rest = n - size
    return grams, cur, _blend(cur[: len(cur) - rest], cur[rest:], n) if rest else cur


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _gram_size(n: int) -> int:
    q = 1
    while q * 2 <= max(1, n // 3):
        q *= 2
    return q


def anchor_runs(data: np.ndarray, ends: np.ndarray, base: np.ndarray, n: int, block: int | None = None):
    """Runs of the n-byte strings of concatenated pieces of documents.

    ``ends``: where each piece ends in ``data``; ``base``: position of its first
    byte in its document. Without ``block``, the strings that hang on one anchor
    are a run and its bucket is the anchor's q-gram. With it, at most ``block``
    strings at fixed distances from the anchor are a run, and the bucket is that
    of the n + 1 - block bytes which they share. Returns per run: piece index,
    first position (in the document), length, bucket (32 bits), run name (64 bits).
    """
    q = _gram_size(n)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint32, np.uint64))
    if len(data) < n:
        return none
    grams, half, full = _refined(data, q, n)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), ends - starts)
    pos = np.arange(len(data)) - starts[doc] + base[doc]
    p = np.flatnonzero(np.arange(len(full)) + n <= ends[doc[: len(full)]])
    if not len(p):
        return none
    d = doc[p]
    if block == 1:
        return d, pos[p], np.ones(len(p), np.int64), (full[p] >> U(32)).astype(np.uint32), _blend(full[p], half[p], 3)
    key = (grams >> U(32) << U(32)) | pos[: len(grams)].astype(U)
    m = (_sliding_min(key, n - q + 1)[p] & U(0xFFFFFFFF)).astype(np.int64)
    change = (d[1:] != d[:-1]) | (m[1:] != m[:-1])
    if block:
        cell = (m - pos[p]) // block
        change |= cell[1:] != cell[:-1]
    new = np.flatnonzero(np.concatenate([[True], change]))
    first, last = p[new], p[np.concatenate([new[1:], [len(p)]]) - 1]
    anchor = first - pos[first] + m[new]  # index of the anchor in data
    name = _blend(full[first], full[last], 5)
    name = _blend(name, ((last - first) << 20 | (anchor - first)).astype(U), 7)
    if block:
        core = anchor - cell[new] * block  # where the shared bytes begin
        size = 1 << (n.bit_length() - 1)
        bucket = _blend(half[core], half[core + n + 1 - block - size], 11)
    else:
        bucket = grams[anchor]
    return d[new], pos[first], last - first + 1, (bucket >> U(32)).astype(np.uint32), name


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, concatenated, and its offsets."""
    arr = pc.fill_null(column, "").cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, off


def _code(start, length, kind):
    """31 bits of start, 31 of length and the kind: joined runs may be of any length within a document."""
    return (start << 32) | (length << 1) | kind


def _merged(d, start, length, kind):
    """Codes of runs, neighbouring ones of a document joined (cut at about every 30,000 strings, to bound the pieces of ``_spans``)."""
    order = np.lexsort((start, d))
    d, start, length = d[order], start[order], length[order]
    if not len(d):
        return d, start
    joins = (d[1:] == d[:-1]) & (start[1:] == start[:-1] + length[:-1])
    group = np.concatenate([[0], np.cumsum(~joins)])
    head = np.concatenate([[True], ~joins])
    # cut long chains
    room = np.cumsum(length) - length
    inside = room - room[np.flatnonzero(head)][group]
    head = head | np.concatenate([[False], (inside[1:] // 30_000) != (inside[:-1] // 30_000)])
    at = np.flatnonzero(head)
    return d[at], _code(start[at], np.add.reduceat(length, at), kind)


ROWS = "part int, blob binary"
RESULT = 0x40000000  # parts from here on hold results, dealt by document


def _packed(parts, ids, ths, d, columns, shift=0):
    """Blobs of columns, one row for each part that occurs; documents are listed once in a blob."""
    order = np.argsort(parts, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], parts[order][1:] != parts[order][:-1]])) if len(order) else order
    for i, at in enumerate(heads):
        idx = order[at : heads[i + 1] if i + 1 < len(heads) else len(order)]
        own, local = np.unique(d[idx], return_inverse=True)
        fields = [np.array([len(own), len(idx)], np.int64), ids[own], ths[own], local.astype(np.uint32), *[c[idx] for c in columns]]
        yield pa.RecordBatch.from_arrays([pa.array([int(parts[idx[0]]) + shift], pa.int32()), pa.array([b"".join(f.tobytes() for f in fields)], pa.binary())], names=["part", "blob"])


def _results(ids, ths, d, codes, n_parts):
    """Codes as blobs, dealt by hashes of the documents' ids and texts: copies of a text are spread."""
    h = _blend(ids.view(U), ths.view(U), 13)
    return _packed((h >> U(34)).astype(np.int64)[d] % n_parts, ids, ths, d, [codes], RESULT)


def _by_part(batches, settle, first):
    """Hand the blobs of each part to ``settle``, whole; results pass through unless ``first`` asks for them."""
    part, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k >= RESULT > first:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob.as_py()], pa.binary())], names=["part", "blob"])
                continue
            if k != part and blobs:
                yield from settle(blobs)
                blobs = []
            part = k
            blobs.append(blob.as_py())
    if blobs:
        yield from settle(blobs)


def _gather(blobs):
    """One row for each document, with its codes, neighbouring runs joined."""
    ids, ths, d, (codes,) = _unpacked(blobs, (np.int64,))
    if not len(d):
        return
    rank = _ranked(ids, ths, d)
    docs, at = np.unique(rank, return_index=True)
    kind = codes & 1
    parts = [_merged(rank[m], codes[m] >> 32, (codes[m] & 0xFFFFFFFF) >> 1, k) for k in (0, 1) if (m := kind == k).any()]
    r, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(r, kind="stable")
    cuts = np.searchsorted(r[order], np.append(docs, docs[-1] + 1))
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(c[order], pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(ids[d[at]]), pa.array(ths[d[at]]), lists], names=["doc_id", "th", "codes"])


def _unpacked(blobs, dtypes):
    """Undo ``_packed`` for many blobs: documents' ids and hashes, document index, columns."""
    ids, ths, d, cols, shift = [], [], [], [[] for _ in dtypes], 0
    for blob in blobs:
        n_docs, n = np.frombuffer(blob, np.int64, 2)
        at = 16
        for target, dtype, count in [(ids, np.int64, n_docs), (ths, np.int64, n_docs), (d, np.uint32, n), *[(c, t, n) for c, t in zip(cols, dtypes, strict=True)]]:
            got = np.frombuffer(blob, dtype, count, at)
            at += got.nbytes
            target.append(got.astype(np.int64) + shift if target is d else got)
        shift += int(n_docs)
    ids, ths, d = np.concatenate(ids), np.concatenate(ths), np.concatenate(d)
    return ids, ths, d, [np.concatenate(c) for c in cols]


def _ranked(ids, ths, d):
    """Rank of each entry's document in (id, text hash) order; equal documents share a rank."""
    order = np.lexsort((ths, ids))
    step = np.concatenate([[0], (ids[order][1:] != ids[order][:-1]) | (ths[order][1:] != ths[order][:-1])]) if len(order) else np.zeros(0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank[d]


def _classes(names, rank, pos):
    """Sort entries by names (last is the major key) and location.

    Returns order, first-of-class flags, and flags of entries at another place than their class's first.
    """
    order = np.lexsort((pos, rank, *names))
    diff = np.zeros(len(order), bool)
    diff[:1] = True
    for x in names:
        s = x[order]
        diff[1:] |= s[1:] != s[:-1]
    heads = np.flatnonzero(diff)
    head_of = heads[np.cumsum(diff) - 1] if len(order) else heads
    r, p = rank[order], pos[order]
    return order, diff, (r != r[head_of]) | (p != p[head_of])


def _settle_runs(ids, ths, d, start, length, anchor, name, foreign):
    """Settle runs among themselves.

    Returns masks over the entries: repeats, runs to refine, and (for the
    next stage) one entry for each class of a lone anchor or for each crowded
    anchor. ``foreign`` marks entries that stand for a crowded anchor elsewhere.
    """
    order, head, repeat = _classes((name, anchor), _ranked(ids, ths, d), start)
    a = anchor[order]
    first_of_anchor = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else head
    group = np.cumsum(first_of_anchor) - 1
    n_groups = int(group[-1]) + 1 if len(group) else 0
    crowded = (np.bincount(group, weights=head, minlength=n_groups) > 1) | (np.bincount(group, weights=foreign[order], minlength=n_groups) > 0)
    many = crowded[group] if n_groups else head
    masks = []
    for m in (repeat, head & many, np.where(many, first_of_anchor, head), many):
        out = np.zeros(len(order), bool)
        out[order] = m
        masks.append(out)
    return masks


def repeats(docs: DataFrame, n: int = 100, doc_id: str = "doc_id", text: str = "text", part_bytes: int = 24 << 20) -> DataFrame:
    """Return ``doc_id, th, text, codes`` with the codes of repeated runs of every document.

    ``codes`` holds, for each run of starts: start * 2**32 + length * 2 (+ 1 for
    runs that a later level settled). Each level is written to the shared folder.
    """
    own, whole = docs[doc_id].cast("long"), docs[text].cast("string")
    # Null ids come after the largest one: their names of texts are not negative, all others are.
    th = F.when(own.isNull(), F.xxhash64(whole).bitwiseAND(F.lit(LAST))).otherwise(F.xxhash64(whole).bitwiseOR(F.lit(-LAST - 1)))
    base = docs.select(F.coalesce(own, F.lit(LAST)).alias("doc_id"), th.alias("th"), whole.alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(8, -(-total // part_bytes))
    run_types = (np.uint32, np.uint16, np.uint32, np.uint64, np.uint8)

    def cut(block, batches):
        """Runs of all pieces of a task, settled among themselves."""
        held, size = [], 0

        def flush():
            ids, ths = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            shift = np.cumsum([0, *[len(h[0]) for h in held]])
            d = np.concatenate([h[2] + s for h, s in zip(held, shift, strict=False)])
            start, length, bucket, name = (np.concatenate([h[i] for h in held]) for i in (3, 4, 5, 6))
            repeat, refine, send, many = _settle_runs(ids, ths, d, start, length, bucket, name, np.zeros(len(d), bool))
            for mask, kind in ((repeat, 0), (refine, 1)):
                yield from _results(ids, ths, *_merged(d[mask], start[mask], length[mask], kind), n_parts)
            yield from _packed(bucket[send] % n_parts, ids, ths, d[send], [start[send].astype(np.uint32), length[send].astype(np.uint16), bucket[send], name[send], many[send].astype(np.uint8)])

        for batch in batches:
            data, off = _bytes_of(batch.column(2))
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for own, piece, ends, first in _pieces(data, off, n) if block is None else _spans(data, off, batch.column(3), n):
                d, start, length, bucket, name = anchor_runs(piece, ends, first, n, block)
                docs_of, at = np.unique(own, return_inverse=True)
                held.append((ids[docs_of], ths[docs_of], at[d], start, length, bucket, name))
                size += len(d)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def settle(blobs):
        ids, ths, d, (start, length, bucket, name, foreign) = _unpacked(blobs, run_types)
        foreign, start, length = foreign.astype(bool), start.astype(np.int64), length.astype(np.int64)
        repeat, refine, _, _ = _settle_runs(ids, ths, d, start, length, bucket, name, foreign)
        for mask, kind in ((repeat & ~foreign, 0), (refine & ~foreign & ~repeat, 1)):
            yield from _results(ids, ths, *_merged(d[mask], start[mask], length[mask], kind), n_parts)

    def with_codes(codes):
        per_doc = codes.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("codes")).alias("codes"))
        return base.join(per_doc.select(F.col("doc_id").alias("d1"), F.col("th").alias("t1"), "codes"), F.expr("doc_id = d1 and th = t1"), "left").select("doc_id", "th", "text", "codes")

    levels: list[DataFrame] = []
    for block in (None, *[b for b in (12,) if n + 1 - b >= 1 << (n.bit_length() - 1)], 1):
        rows = base if block is None else with_codes(levels[-1]).where("exists(codes, c -> (c & 1) = 1)")
        cut_here = lambda batches, block=block: cut(block, batches)
        runs = rows.mapInArrow(cut_here, ROWS).repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(lambda batches: _by_part(batches, settle, 0), ROWS)
        done = runs.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(lambda batches: _by_part(batches, _gather, RESULT), "doc_id long, th long, codes array<long>")
        levels.append(written(done, "repeats"))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return with_codes(every.select("doc_id", "th", F.expr("filter(codes, c -> (c & 1) = 0)").alias("codes")).where("size(codes) > 0"))


def _pieces(data, off, n):
    """Whole documents in pieces of about ``STEP`` bytes; a longer document goes in overlapping pieces."""
    i, count = 0, len(off) - 1
    while i < count:
        if off[i + 1] - off[i] > STEP:
            for s in range(off[i], max(off[i] + 1, off[i + 1] - n + 1), STEP):
                e = min(s + STEP + n - 1, off[i + 1])
                yield np.array([i]), data[s:e], np.array([e - s]), np.array([s - off[i]])
            i += 1
            continue
        j = i
        while j < count and off[j + 1] - off[i] <= STEP:
            j += 1
        yield np.arange(i, j), data[off[i] : off[j]], off[i + 1 : j + 1] - off[i], np.zeros(j - i, np.int64)
        i = j


def _spans(data, off, lists, n):
    """The bytes of the runs to refine, in pieces of about ``STEP`` bytes."""
    codes, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    codes = codes[at[0] : at[-1]]
    take = (codes & 1) == 1
    doc, start, size = doc[take], codes[take] >> 32, ((codes[take] & 0xFFFFFFFF) >> 1) + n - 1
    begin = 0
    while begin < len(doc):
        stop = begin + max(1, int(np.searchsorted(np.cumsum(size[begin : begin + 50_000]), STEP, "right")))
        own, s, z = doc[begin:stop], start[begin:stop], size[begin:stop]
        ends = np.cumsum(z)
        where = np.repeat(off[own] + s - (ends - z), z) + np.arange(ends[-1])
        yield own, data[where], ends, s
        begin = stop


def removed_spans(codes: np.ndarray, n: int) -> np.ndarray:
    """Maximal byte runs [start, end) that repeated strings cover, from the codes of their first positions."""
    codes = codes[(codes & 1) == 0]
    if not len(codes):
        return np.zeros((0, 2), np.int64)
    s, e = codes >> 32, (codes >> 32) + ((codes & 0xFFFFFFFF) >> 1) + n - 1
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return np.stack([s[at], np.concatenate([e[at[1:] - 1], e[-1:]])], axis=1)


def deduplicate(docs: DataFrame, n: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row.

    A byte goes if an n-byte string that covers it also starts earlier: in a
    document of smaller id, or earlier in the same one. Strings are judged on the
    input. Null and empty texts have no bytes. Null ids come last. Documents with
    one id are ordered by a hash of their texts; rows repeated with id and text count as
    one document and all get its result. Texts may be of any length, other columns
    of any name. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            data, off = _bytes_of(batch.column(1))
            out = [[], [], [], []]
            for i, x in enumerate(batch.column(2)):
                codes = x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64)
                spans, body = removed_spans(codes, n), data[off[i] : off[i + 1]].tobytes()
                keep, at = [], 0
                for s, e in spans:
                    keep.append(body[at:s])
                    at = e
                keep.append(body[at:])
                for col, v in zip(out, (len(body), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), b"".join(keep)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = repeats(docs, n, doc_id, text).select(F.when((F.col("doc_id") != LAST) | (F.col("th") < 0), F.col("doc_id")).alias("doc_id"), "text", "codes")
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_bytes(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
