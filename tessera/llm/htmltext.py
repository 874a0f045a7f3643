"""Main-text extraction by template deduction from equivalence classes.

Pages of a host come from one template. A token is a tag, told apart by its
path of tags and classes, or a whole text node at its path. Its occurrence
vector says how often each distinct page of the host has it. Frequent tokens with
equal vectors form a class. A class is split where its tokens do not stand in one
order on every page, and where they stand in different elements of other classes;
what is left is valid if it lies in an element of a valid class. The valid classes,
nested in one another, are the host's template; what stands between their tokens
are slots.

One path can play several roles, such as three bare ``div`` in a row. Where every
element of a path has the same number, above one, of a valid class's tag that holds
a slot, the tags are told apart by their place in it, and the classes are formed
again from the new tokens, until no role is new.

The template decides where the article is: the innermost tag of a valid class,
once a page, whose slots hold the bulk of the text that differs from page to
page, widened to its parent as long as that adds headings and paragraphs only.
Texts that nearly all pages repeat at one place are template as well. Names of
elements and classes are hints: they say what is a menu, a form, an advert or a
comment inside the article, and find it where classes decide nothing (a host
with a page or two, a page that departs from its host's template).

Vectors are never collected: a vector is represented by a commutative 64-bit sum
over its (page, count) entries, so a host with a third of all pages is summed up
in every task that reads it.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.workdir import written

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<(?=/?[a-zA-Z])[^>]*\Z", re.S | re.I)
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html head title option legend summary caption td th tr tbody thead tfoot dd dt li".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol table tr dl".split())
NOT_TEXT = frozenset("head title nav footer aside form button dialog menu label input object canvas audio video".split())
LISTED = frozenset("li dt dd tr td th option".split())
#: Elements that can hold an article, and those that an article is made of.
HOLDERS = frozenset("html body div section article main td table tbody tr center".split())
FLOW = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote ul ol dl pre figure table br hr b i em strong span a img".split())
#: Class names: a name is noise if all its parts are noise or neutral words and one at least is noise.
NOISE = frozenset("nav navbar navigation menu menus sidebar footer header masthead ad ads adv advert adverts advertisement advertisements advertising banner banners cookie cookies consent gdpr notice notices alert alerts promo promos promotion promotions sponsor sponsored comment comments disqus share sharing social subscribe subscription newsletter signup login search related recommended breadcrumb breadcrumbs pagination pager popup modal overlay widget widgets contentinfo complementary".split())
NEUTRAL = frozenset("site page main top bottom left right side list item items box block area wrap wrapper container section slot bar button buttons icon icons link links posts articles stories form field row col column inner outer primary secondary global sticky fixed text unit count policy".split())
MAIN_CLASS = frozenset("article main post entry story content".split())
SPLIT = re.compile(r"[\s_-]+")
SUPPORT = 0.9
TOKEN = "host string, kind string, token long, parent long, step string, depth int, content long, n long, chars long, whole long, place int, few int, most int, at array<int>"


def noisy_name(words: str) -> bool:
    """Whether a class, id or role names a menu, advert, comment or the like; ``words`` as written, lower-cased."""
    for name in words.split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[_-]+", name)]
        if any(p in NOISE for p in parts) and all(not p or p in NOISE or p in NEUTRAL for p in parts):
            return True
    return False


def _hash(parent: int, step: str) -> int:
    h = xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


class Node:
    """An open element: its name, the name of its path, and what is known about its ancestors."""

    __slots__ = ("article", "at", "block", "depth", "listed", "name", "never", "noise", "parent", "path", "place", "plain", "seq", "state", "step", "words")

    def __init__(self, name, step, words, parent, at, seq):
        self.name, self.step, self.words, self.parent, self.at, self.seq = name, step, words, parent, at, seq
        self.path = self.plain = _hash(parent.path if parent else 0, step)
        self.place = 0
        self.depth = parent.depth + 1 if parent else 1
        self.article = bool(parent and (parent.article or parent.name in ("article", "main")))
        # Holds no article by its element, or by its own or an ancestor's name.
        self.never = bool(parent and parent.never) or name in NOT_TEXT
        self.noise = self.never or bool(parent and parent.noise) or name == "header" and not self.article or self.misnamed()
        # The nearest open p or block, and the nearest list item, cell or their like, this node included.
        self.block = self if name == "p" or name in BLOCK else parent.block if parent else None
        self.listed = self if name in LISTED or name in SCOPE else parent.listed if parent else None

    def tell_apart(self, roles, met: dict) -> None:
        """Name the element by its place among its like if its path, with or without the places above it, is one of ``roles``."""
        self.plain = _hash(self.parent.plain if self.parent else 0, self.step)
        if self.path in roles or self.plain in roles:
            key = (self.parent.seq if self.parent else -1, self.path)
            self.place = met[key] = met.get(key, 0) + 1
            self.path = _hash(self.path, f"\x1e{self.place}")

    def misnamed(self) -> bool:
        return bool(self.words) and self.name not in ("html", "body", "article", "main") and noisy_name(self.words)


def nodes(page: str, roles=frozenset()):
    """Walk a page: yields ("tag", node, None, block) at start tags and ("text", node, text, block) at texts.

    ``block`` counts the block boundaries passed so far, so equal values belong
    to one block. Missing end tags are implied as far as p, li, dd, td and their
    like go. The work is linear in the page, however deep or broken it is.
    Elements whose path is in ``roles`` are told apart by their place in their parent.
    """
    stack: list[Node] = []
    open_: dict[str, int] = {}
    met: dict[tuple[int, int], int] = {}
    block = at = seq = 0

    def cut(n):
        while len(stack) > n:
            open_[stack.pop().name] -= 1

    for m in MARKUP.finditer(page):
        if m.start() > at:
            yield "text", stack[-1] if stack else None, page[at : m.start()], block
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            block += 1
        if m[2]:
            if open_.get(name):
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                cut(i)
            continue
        if name in CLOSES_P:
            if stack and stack[-1].block is not None and stack[-1].block.name == "p":
                cut(stack[-1].block.at)
        elif name in SAME:
            node = stack[-1].listed if stack else None
            while node is not None and node.name not in SCOPE:
                if node.name in SAME[name]:
                    cut(node.at)
                    break
                node = node.parent.listed if node.parent else None
        if name in VOID or m[4].endswith("/") and name not in BLOCK:
            continue
        step, words = name, ""
        if m[4]:
            found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m[4])}
            if found:
                words = " ".join(found.values()).lower()
                step += "." + ".".join(f"{k}={found[k]}" for k in sorted(found))
        stack.append(Node(name, step, words, stack[-1] if stack else None, len(stack), seq))
        seq += 1
        if roles:
            stack[-1].tell_apart(roles, met)
        open_[name] = open_.get(name, 0) + 1
        yield "tag", stack[-1], None, block
    if at < len(page):
        yield "text", stack[-1] if stack else None, page[at:], block


def page_tokens(page: str, roles=frozenset()) -> tuple[dict, dict]:
    """Count a page's tokens.

    Tags: path to [occurrences, characters of text in and below it outside
    regions with a name for noise, the same with them, parent's path, step,
    depth, place in the parent if told apart by it (else 0), fewest and most in
    one parent that has any, positions]; texts: (path, name of the text) to
    [occurrences, both characters, 0, fewest and most in one parent, positions].
    Elements that never hold text of an article are left out.
    """
    each: dict[tuple, int] = {}
    tags: dict[int, list] = {}
    texts: dict[tuple[int, int], list] = {}
    for i, (kind, node, value, _) in enumerate(nodes(page, roles)):
        if node and node.never:
            continue
        if kind == "tag":
            entry = tags.get(node.path)
            if entry is None:
                entry = tags[node.path] = [0, 0, 0, node.parent.path if node.parent else 0, node.step, node.depth, node.place, 0, 0, []]
            entry[0] += 1
            entry[9].append(i)
            key = (node.parent.seq if node.parent else -1, node.path)
            each[key] = each.get(key, 0) + 1
        elif text := " ".join(value.split()):
            path, size = node.path if node else 0, len(text)
            clean = 0 if node and node.noise else size
            if path in tags:
                tags[path][1] += clean
                tags[path][2] += size
            token = (path, _hash(path, "\x1f" + text))
            got = texts.setdefault(token, [0, 0, 0, 0, 0, 0, []])
            got[0] += 1
            got[1] += clean
            got[2] += size
            got[6].append(i)
            key = (node.seq if node else -1, token)
            each[key] = each.get(key, 0) + 1
    for (_, token), n in each.items():
        few = texts[token] if isinstance(token, tuple) else tags[token]
        few[-3], few[-2] = min(few[-3] or n, n), max(few[-2], n)
    for entry in sorted(tags.values(), key=lambda t: -t[5]):
        if entry[3] in tags:
            tags[entry[3]][1] += entry[1]
            tags[entry[3]][2] += entry[2]
    return tags, texts


def _token_rows(pages: DataFrame) -> DataFrame:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
    names = [x.split()[0] for x in TOKEN.split(", ")]
    told = [F.col("roles")] if "roles" in pages.columns else [F.lit(None).cast("array<bigint>").alias("roles")]

    def run(batches):
        rows: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for host, page, roles in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                page = page.as_py() or ""
                content = _hash(0, page)
                tags, texts = page_tokens(page, frozenset(roles or ()))
                rows.append((host, "page", 0, 0, "", 0, content, 1, 0, 0, 0, 0, 0, None))
                rows += [(host, "tag", path, up, step, depth, content, n, chars, whole, *rest) for path, (n, chars, whole, up, step, depth, *rest) in tags.items()]
                rows += [(host, "text", token, path, "", 0, content, *rest) for (path, token), rest in texts.items()]
                if len(rows) > 50_000:
                    yield flush()
                    rows = []
        if rows:
            yield flush()

    return pages.select("host", "html", *told).mapInArrow(run, TOKEN)


def _sure(pages: int, total: int) -> bool:
    """Whether nearly all of a host's pages have a token, and these are enough to say so (95 % bound of the share above a half)."""
    share, z = pages / total, 1.96
    low = (share + z * z / (2 * total) - z * ((share * (1 - share) + z * z / (4 * total)) / total) ** 0.5) / (1 + z * z / total)
    return share >= SUPPORT and low > 0.5


#: The least number of pages that can make a token sure.
SURE_FROM = next(n for n in range(1, 100) if _sure(n, n))


def classes_of(rows: list[dict]) -> list[list[dict]]:
    """The equivalence classes of tokens: equal occurrence vectors, one order on all pages, in one element of the other classes.

    A token is of its parent's class if it has the parent's vector and stands once in each. ``cut`` of a row says that on some
    page the token does not follow the one before it (by mean position) of its parent and vector; from there on a new class starts.
    """
    tags = {r["token"]: r for r in rows if r["kind"] == "tag"}
    segment, groups = {}, {}
    for r in sorted(rows, key=lambda r: (r["mean"], r["token"])):
        group = r["parent"], r["vec"]
        groups[group] = groups.get(group, 0) + bool(r["cut"])
        segment[r["kind"], r["token"]] = groups[group]
    class_of: dict[int, tuple] = {}
    out: dict[tuple, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["kind"] != "tag", r["depth"])):
        up, at = tags.get(r["parent"]), segment[r["kind"], r["token"]]
        mine = class_of[up["token"]] if up and up["vec"] == r["vec"] and r["few"] == r["most"] == 1 and not at else (r["parent"], r["vec"], at)
        if r["kind"] == "tag":
            class_of[r["token"]] = mine
        out.setdefault(mine, []).append(r)
    return list(out.values())


def valid_tags(classes: list[list[dict]], total: int) -> set[int]:
    """The tags of valid classes: frequent, of two tokens at least (a tag has a start and an end), in an element of a valid class."""
    valid: set[int] = set()
    for found in sorted(classes, key=lambda c: min(r["depth"] if r["kind"] == "tag" else 1 << 30 for r in c)):
        mine = {r["token"] for r in found if r["kind"] == "tag"}
        if mine and _sure(found[0]["pages"], total) and all(r["parent"] == 0 or r["parent"] in valid or r["parent"] in mine for r in found):
            valid |= mine
    return valid


def slots_of(tags: dict[int, dict], texts: list[dict], amount: str) -> dict[int, int]:
    """The characters in the slots in and below each tag: its text without the template's (``texts``)."""
    mass = {p: t[amount] for p, t in tags.items()}
    for t in texts:
        up = t["parent"]
        while up in tags:
            mass[up] -= t[amount]
            up = tags[up]["parent"]
    return mass


def new_roles(tags: dict[int, dict], valid: set[int], slots: dict[int, int]) -> list[int]:
    """The paths of valid classes to tell apart by place: with a slot, and as often, more than once, in each parent that has them."""
    return [p for p in valid if tags[p]["few"] == tags[p]["most"] > 1 and slots[p] > 0]


def container_of(tags: dict[int, dict], texts: list[dict], valid: set[int]) -> int:
    """The path of the tag that holds the article by the valid classes, or 0 if they decide nothing."""
    varied = {}
    for amount in ("chars", "whole"):  # text in regions with a name for noise counts only where there is little else
        mass = slots_of(tags, texts, amount)
        if not varied or max(varied.values()) < 0.1 * max(mass.values()):
            varied = mass
        if not varied:
            return 0
    name = lambda p: tags[p]["step"].partition(".")[0]
    once = [p for p in valid if tags[p]["high"] == 1 and name(p) in HOLDERS]
    # Elements told apart by place only are parts of one article if a name says so above them, or if each has its share of the text.
    like: dict[tuple[int, str], int] = {}
    for p, t in tags.items():
        if t["place"]:
            like[t["parent"], t["step"]] = like.get((t["parent"], t["step"]), 0) + max(varied[p], 0)
    part: dict[int, bool] = {0: False}
    under: dict[int, bool] = {0: False}
    for p in sorted(tags, key=lambda p: tags[p]["depth"]):
        t = tags[p]
        up = t["parent"]
        part[p] = part.get(up, False) or bool(t["place"]) and (under.get(up, False) or varied[p] < 0.9 * like[up, t["step"]])
        under[p] = under.get(up, False) or _rank(t["step"]) is not None
    once = [p for p in once if not part[p]]
    most = max((varied[p] for p in once), default=0)
    if most <= 0:
        return 0
    best = max((p for p in once if varied[p] >= 0.8 * most), key=lambda p: (tags[p]["depth"], varied[p], p))
    # A text spread over several holders: a named article among them is the better guess.
    named = [p for p in once if varied[p] >= 0.3 * most and _rank(tags[p]["step"]) is not None]
    inner = [p for p in once if tags[p]["parent"] == best and varied[p] > 0.05 * most]
    if len(inner) > 1 and named and _rank(tags[best]["step"]) is None:
        best = min(named, key=lambda p: (_rank(tags[p]["step"]), tags[p]["depth"], p))
    # The headline may stand beside the holder of the paragraphs.
    children: dict[int, list[int]] = {}
    for p, t in tags.items():
        children.setdefault(t["parent"], []).append(p)
    while (up := tags[best]["parent"]) in valid and name(up) in HOLDERS - {"html", "body"} and _rank(tags[best]["step"]) != 0 and not noisy_name(_words(tags[best]["step"])):
        if any(p != best and varied[p] > 0 and name(p) not in FLOW for p in children[up]):
            break
        best = up
    return best


def _words(step: str) -> str:
    """The class, id and role of a step, lower-cased."""
    return " ".join(x.partition("=")[2] for x in re.split(r"\.(?=(?:class|id|role)=)", step)[1:]).lower()


def _rank(step: str) -> int | None:
    """How strongly a tag's names say that it holds the article (0: most)."""
    name = step.partition(".")[0]
    if name in ("article", "main"):
        return 0 if name == "article" else 1
    return 2 if name in HOLDERS and MAIN_CLASS & set(SPLIT.split(_words(step))) else None


def _deduce(pdf: pd.DataFrame) -> pd.DataFrame:
    """Build one host's template from its frequent tokens (a bounded table: tokens on nearly all pages)."""
    total = int(pdf["total"].iloc[0])
    rows = pdf.to_dict("records")
    tags = {r["token"]: r for r in rows if r["kind"] == "tag"}
    texts = [r for r in rows if r["kind"] == "text" and r["low"] == r["high"] and _sure(r["pages"], total)]
    valid = valid_tags(classes_of(rows), total)
    roles = new_roles(tags, valid, slots_of(tags, texts, "whole"))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "container": [container_of(tags, texts, valid)], "constant": [[r["token"] for r in texts]], "fresh": [roles]})


def _out_of_order(seen: DataFrame, frequent: DataFrame) -> DataFrame:
    """Return ``host, kind, token, cut``: whether on some page a token does not follow the one before it of its parent and vector, each time.

    The order of tokens with different parents follows from that of the parents.
    """
    classes = frequent.groupBy("host", "parent", "vec").agg(F.count("*").alias("size")).where("size > 1").select("host", "parent", "vec")
    members = frequent.join(classes, ["host", "parent", "vec"], "left_semi").select("host", "kind", "token", "parent", "vec", "mean")
    line = Window.partitionBy("host", "parent", "vec", "content").orderBy("mean", "token")
    rows = seen.select("host", "kind", "token", "content", "at").join(members, ["host", "kind", "token"])
    rows = rows.withColumn("prev", F.lag("at").over(line)).withColumn("lead", F.first("at").over(line)).where("prev is not null")
    late = F.exists(F.zip_with("prev", "at", lambda a, b: a >= b), lambda x: x)
    # The class starts anew only after its last token.
    over = F.exists(F.zip_with("at", F.slice("lead", 2, F.greatest(F.size("lead"), F.lit(1))), lambda a, b: F.coalesce(a >= b, F.lit(False))), lambda x: x)
    return rows.groupBy("host", "kind", "token").agg(F.max(late | over).alias("cut"))


def _deduced(pages: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """One round: ``host, container, constant, fresh`` from ``host, html`` and, after the first, ``roles``; and the tables it reads."""
    seen = written(_token_rows(pages).distinct(), "html-seen")
    vec = F.sum(F.pmod(F.xxhash64("content", "n"), F.lit(1 << 40))).alias("vec")
    ends = [F.min("few").alias("few"), F.max("most").alias("most"), F.avg(F.get("at", F.lit(0))).alias("mean")]
    stats = seen.groupBy("host", "kind", "token").agg(F.count("*").alias("pages"), vec, F.min("n").alias("low"), F.max("n").alias("high"), F.sum("chars").alias("chars"), F.sum("whole").alias("whole"), F.first("parent").alias("parent"), F.first("step").alias("step"), F.first("depth").alias("depth"), F.first("place").alias("place"), *ends)
    stats = written(stats.where("pages > 1 or kind = 'page'"), "html-tokens")
    total = stats.where("kind = 'page'").where(F.col("pages") >= SURE_FROM).select(F.col("host").alias("h"), F.col("pages").alias("total"))
    frequent = stats.where("kind <> 'page'").join(total, F.col("host") == F.col("h")).where(F.col("pages") >= F.col("total") * SUPPORT).drop("h")
    frequent = written(frequent, "html-frequent")
    ordered = frequent.join(_out_of_order(seen, frequent), ["host", "kind", "token"], "left").fillna(False, ["cut"])
    return ordered.groupBy("host").applyInPandas(_deduce, "host string, container long, constant array<long>, fresh array<long>"), (seen, stats, frequent)


def templates(pages: DataFrame) -> DataFrame:
    """Deduce ``host, container, constant, roles`` from ``host, html``; identical pages of a host count once.

    Hosts with new roles go through another round with their pages' tokens told apart. Hosts of too few pages to be sure of anything have no row.
    """
    first, read = _deduced(pages)
    known = written(first.withColumn("roles", F.col("fresh")), "html-classes", drops=read)
    done = known.where(F.size("fresh") == 0)
    while not (open_ := known.where(F.size("fresh") > 0)).isEmpty():
        told = open_.select("host", "roles")
        again, read = _deduced(pages.select("host", "html").join(told, "host"))
        known = written(again.join(told, "host").withColumn("roles", F.array_union("roles", "fresh")).select("host", "container", "constant", "fresh", "roles"), "html-classes", drops=read)
        done = done.unionByName(known.where(F.size("fresh") == 0))
    return done.drop("fresh")


def main_text(page: str, container: int = 0, constant: frozenset = frozenset(), hints: bool = True, roles: frozenset = frozenset()) -> str:
    """Extract a page's article: the slots of the template's container, one line a block.

    Without a container (0), or where the page does not have it, the page's own
    article or main element or, failing these, all of it. Without ``hints`` the
    template alone decides; only elements that never hold an article are left out.
    """
    target, own = 0, None
    for i, (kind, node, _, _) in enumerate(nodes(page, roles)):
        if kind == "tag":
            if container and node.path == container:
                target = container
                break
            if hints and not node.noise and node.name in ("article", "main"):
                rank = (node.name == "main", node.depth, i, node.path)
                own = rank if own is None or rank < own else own
    target = target or (own[3] if own else 0)
    blocks, last, parts = [], None, []
    for kind, node, value, block in nodes(page, roles):
        if kind == "tag":
            # Outside the target, in it, in it below noise.
            above = node.parent.state if node.parent else "out" if target else "in"
            if above == "in":
                header = node.name == "header" and not node.article and not target
                above = "noise" if node.name in NOT_TEXT or hints and (header or node.misnamed()) else "in"
            elif above == "out" and node.path == target:
                above = "in"
            node.state = above
            continue
        if (node.state if node else "out" if target else "in") != "in":
            continue
        if constant and _hash(node.path if node else 0, "\x1f" + " ".join(value.split())) in constant:
            continue
        if block != last:
            blocks.append("".join(parts))
            parts, last = [], block
        parts.append(entities.unescape(value) if "&" in value else value)
    blocks.append("".join(parts))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", host_rows: int = 20_000) -> DataFrame:
    """Return ``page_id, url, text, n_chars`` for every row.

    The host is the part of the url after ``//`` (lower case, without port and
    user); null and odd urls share one host. A null page is empty, an empty
    article gives an empty text with 0 characters. Pages of a host with equal
    html count once for its template. Repeated rows and null ids are kept as
    they are, other columns may have any names; an empty table gives an empty
    result. Time and memory are linear in a page's length.

    The templates are written first, so they are broadcast only if their size is
    known to be small; else they join by host and a salt, as many salts for each
    host as it has shares of ``host_rows`` rows.
    """
    host = F.coalesce(F.lower(F.regexp_extract(pages[url].cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    base = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].cast("string").alias("html"), host.alias("host"))
    rows = base.groupBy("host").agg(F.ceil(F.count("*") / host_rows).cast("int").alias("salts"))
    known = written(templates(base).join(rows, "host"), "html-templates")
    big = known.where("salts > 1").select(F.col("host").alias("b"), F.col("salts").alias("shares"))  # at most rows / host_rows hosts
    dealt = base.join(F.broadcast(big), F.col("host") == F.col("b"), "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("shares", F.lit(1))).cast("int"))
    salted = known.select(F.col("host").alias("h"), "container", "constant", "roles", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    both = dealt.join(salted, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left")

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py() or "", c or 0, frozenset(k or ()), roles=frozenset(r or ())) for p, c, k, r in zip(batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(base.dtypes)
    return both.select("page_id", "url", "html", "container", "constant", "roles").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
