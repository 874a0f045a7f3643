"""Site-relative line deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.workdir import unused, written

BLANK = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _keys(text):
    """Names (64 bits) of a text's lines without surrounding white space; blank lines have none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, BLANK, ""))
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate_lines(docs: DataFrame, host: str, text: str, max_ratio: float) -> DataFrame:
    """Return ``host, line`` (a 64-bit name) of the lines on more than ``max_ratio`` of a host's pages, and on two at least.

    Pages of a host with one and the same text count as one page, and a page
    counts once per line, so copies of a page do not make its lines boilerplate.
    Only names of lines and of texts are shuffled. A third of all rows may share
    a host, a line or a text: all counts are partial sums before the shuffle.
    """
    rows = docs.select(F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).select("host", F.xxhash64("t").alias("page"), F.array_distinct(_keys(F.col("t"))).alias("lines"))
    totals = rows.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    # A line of one page alone goes nowhere, so (host, line) is first thinned to its pages.
    lines = rows.select("host", "page", F.explode("lines").alias("line")).where("line is not null").groupBy("host", "line").agg(F.countDistinct("page").alias("n")).where("n > 1")
    return lines.join(totals, lines["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.col("pages") * F.lit(max_ratio)).select(lines["host"], "line")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.06, host_rows: int = 50_000) -> DataFrame:
    """Drop from every document the lines that its site repeats on too many pages.

    A line goes if the pages of the host that contain it are more than
    ``max_ratio`` of the host's pages and at least two; pages with equal texts
    are one page. Lines compare without surrounding white space; blank lines
    stay. All columns and rows are kept, whatever their names; ``text`` loses
    the lines, ``lines_dropped`` (long) is added (it replaces a column of that
    name). Repeated rows and rows with equal or null ids each get their own
    result. A null text stays null, a null host is a host of its own, an empty
    table gives an empty one, and a document may end up with an empty text. A
    text may be of any length: its lines are one array.

    A host's list is at most (mean lines a page) / ``max_ratio`` long. The lists
    are written first, so they are broadcast only if their size is known to be
    small; else they join by host and a salt, as many salts for each host as it
    has shares of ``host_rows`` rows.
    """
    kept = [c for c in docs.columns if c.lower() != "lines_dropped" or c == text]
    flagged = boilerplate_lines(docs, host, text, max_ratio)
    rows = docs.groupBy(F.col(host).cast("string").alias("host")).agg(F.ceil(F.count("*") / host_rows).cast("int").alias("salts"))
    lists = flagged.groupBy("host").agg(F.collect_set("line").alias("drop"))
    lists = written(lists.join(rows, lists["host"].eqNullSafe(rows["host"])).select(lists["host"], "drop", "salts"), "boilerplate")
    salt, mark = unused(docs, "salt"), unused(docs, "mark")
    big = lists.where("salts > 1").select(F.col("host").alias("big"), F.col("salts").alias("shares"))  # at most rows / host_rows hosts
    of = docs.select(*kept, F.col(host).cast("string").alias(mark))
    of = of.join(F.broadcast(big), of[mark].eqNullSafe(big["big"]), "left").select(*[of[c] for c in of.columns], F.pmod(F.xxhash64(*[of[c] for c in kept if dict(docs.dtypes)[c] in ("string", "bigint", "int")]), F.coalesce(big["shares"], F.lit(1))).cast("int").alias(salt))
    spread = lists.select(F.col("host").alias("h"), F.col("drop").alias("list"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    both = of.join(spread, of[mark].eqNullSafe(spread["h"]) & (of[salt] == spread["s"]), "left")
    whole = of[text].cast("string")
    split = F.split(whole, "\n")
    stays = F.zip_with(split, _keys(whole), lambda x, k: F.when(F.coalesce(F.array_contains(spread["list"], k), F.lit(False)), F.lit(None)).otherwise(x))
    has = spread["list"].isNotNull() & of[text].isNotNull()
    out = both.select(*[of[c] for c in kept], F.when(has, F.filter(stays, lambda x: x.isNotNull())).alias(mark), F.when(has, F.size(split)).alias(salt))
    gone = F.coalesce(out[salt] - F.size(out[mark]), F.lit(0)).cast("long")
    return out.select(*[F.when(gone > 0, F.array_join(out[mark], "\n")).otherwise(out[c].cast("string")).alias(c) if c == text else out[c] for c in kept], gone.alias("lines_dropped"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(text, '') AS page, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, page, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, source, page, pos, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
c AS (SELECT source, line, count(DISTINCT page) AS n FROM k WHERE line <> '' GROUP BY source, line),
t AS (SELECT source, count(DISTINCT page) AS pages FROM d GROUP BY source),
f AS (SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n > 1 AND n > pages * CAST(0.06 AS DOUBLE)),
m AS (SELECT k.doc_id, k.pos, k.raw, f.line IS NOT NULL AS gone FROM k LEFT JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.line = f.line),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS lines_dropped, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, g.lines_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE g.kept END AS text FROM d JOIN g ON d.doc_id = g.doc_id
"""


def op2_lines(docs: DataFrame) -> DataFrame:
    """Every document with its text less its site's boilerplate lines."""
    return drop_boilerplate(docs).select("doc_id", "lines_dropped", "text")
