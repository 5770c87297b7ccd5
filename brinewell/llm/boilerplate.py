"""Main content of pages by template deduction from equivalence classes (problem 3).

Tags, qualified by the container they are in, and lines of text, digits aside, are the tokens
of a page. For each host the occurrence vector of a token over the host's whole pages is kept
as a commutative fingerprint (the sum of hashes of page and count), so it is aggregated before
any shuffle, however many pages a host has. Tags with one vector form an equivalence class; a
class is valid if its tags occur once on each of its pages and in one order on all of them; of
a class in several orders the pairs of opening and closing tag are left. Lines that occur once
on each of at least ``LEAST_PAGES`` pages, the very pages of a class, belong to that class: they
are the template's text, wherever they stand. Valid classes are nested by their position, and the
slots between their tags are measured: the slot that holds most of its pages' text is the main
one. The text of a slot nested in another counts to it too, unless the nested slot is navigation
by its kind, consists of links, or repeats its lines from page to page. Lines of the main slot
that aren't the template's are the article, all other lines are furniture.

Pages without HTML, or with HTML cut off before its end, are judged by what the other
pages teach: counts of line features among furniture and article lines give each line a
log-odds, and the likeliest sequence of labels is taken, a change of label having a cost. Hosts with few pages
lean on the counts of all hosts in the same way.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.urls import host_of
from brinewell.llm.residue import messages, template_sentences
from brinewell.session import cut_lineage

_TOKEN = re.compile(r"<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|<[!?][^>]*>|([^<]+)|<", re.DOTALL | re.IGNORECASE)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CONTAINER = frozenset("div nav aside footer header section main article ul ol table form dl".split())
_VOID = frozenset("br hr img input meta link source wbr area base col embed track".split())
_DIGITS = re.compile(r"\d+")
_NEWLINE = re.compile(r"[\r\n]+")


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _text_token(line: str) -> str:
    return f"={_hash(_DIGITS.sub('#', line))}"


def _residue(line: str) -> bool:
    """Problem 4's text: an unfilled placeholder, filler or an error message."""
    return bool(template_sentences(line)) or any(m for _, m in messages(line))


def squeeze_line(line: str) -> str:
    """White-space runs become one space, ends are trimmed."""
    return " ".join(line.split())


def outline(page: str) -> tuple[list[tuple[tuple[str, ...], str, bool]], list[str], bool]:
    """(slots around it from the outermost, line, whether it is a link) of every text line, the tokens in order, and whether the page ends properly.

    Tokens are the qualified tags and, with an equals sign before their hash, the lines.

    A slot is a container with a class, id or role, or a container of a kind that says what it
    is (nav, aside, footer); others take their parent's.
    """
    lines: list[tuple[tuple[str, ...], str, bool]] = []
    tokens: list[str] = []
    stack: list[tuple[str, tuple[str, ...], str]] = [("", (), "")]
    whole = False
    head = False
    link = False
    for m in _TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            if head or text.isspace():
                continue
            for line in _NEWLINE.split(text):
                line = squeeze_line(html.unescape(line) if "&" in line else line)
                if line:
                    lines.append((stack[-1][1], line, link))
                    tokens.append(_text_token(line))
            continue
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in ("html", "body"):
                whole = True
            if tag == "head":
                head = False
            elif tag == "a":
                link = False
            elif tag in _CONTAINER:
                link = False
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        tokens.append("/" + stack[depth][2])
                        del stack[depth:]
                        break
            continue
        path = stack[-1][1]
        if tag == "head":
            head = True
        elif tag == "body":
            head = False
            tokens.append("body")
        elif tag == "a":
            link = True
        elif tag in _CONTAINER:
            marks = "".join(f"{'.#@'['cir'.index(k[0].lower())]}{a or b or c}" for k, a, b, c in _MARK.findall(m.group(4)))
            if marks or tag in ("nav", "aside", "footer", "header", "main", "article") or not path:
                token = tag + marks
                stack.append((tag, (*path, token), token))
            else:
                token = f"{path[-1]}>{tag}"
                stack.append((tag, path, token))
            tokens.append(token)
        elif tag not in _VOID and tag[0] == "h" and tag[1:].isdigit():
            tokens.append(f"{path[-1] if path else ''}>{tag}")
    return lines, tokens, whole


def parse(page: str) -> tuple[list[tuple[str, str]], list[str], bool]:
    """(innermost slot, line) of every text line, the qualified tag tokens in order, and whether the page ends properly."""
    lines, tokens, whole = outline(page)
    return [(path[-1] if path else "", line) for path, line, _ in lines], [t for t in tokens if t[0] != "="], whole


#: Slots that are no part of an article wherever they are nested.
_BESIDE = re.compile(r"(?:nav|aside|footer|header|form)(?![a-z])")
_CELLS = "host string, token string, parent string, line long, pages long, times long, vector long, place double, mass long, links long"
#: Cells that a task holds before it hands them on.
_HELD = 200_000
#: Pages that a line of text must be on to belong to a template.
LEAST_PAGES = 8


def _is_slot(token: str) -> bool:
    return token[0] not in "/=" and ">" not in token and token != "body"


def _learn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, page key, raw_html): rows of two kinds.

    Without a line, for each host and token: whole pages, occurrences, vector and place. With one,
    for each host, slot, the slot around it and masked line: times, text and text of links; of a
    slot's lines beside the slots nested in it the parent is ''. Cut pages give tokens without counts.
    """
    cells: dict[tuple[str, str], list] = {}
    texts: dict[tuple[str, str, str, int], list[int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, t, None, None, c[0], c[1], c[2] - (1 << 64) if c[2] >> 63 else c[2], c[3], None, None) for (h, t), c in cells.items()]
        rows += [(h, t, p, x, None, n, None, None, mass, links) for (h, p, t, x), (n, mass, links) in texts.items()]
        texts.clear()
        cells.clear()
        cols = list(zip(*rows)) if rows else [()] * 10
        kinds = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _CELLS.split(", ")])

    for batch in batches:
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in range(3))):
            lines, tokens, whole = outline(page)
            counts: dict[str, int] = defaultdict(int)
            first: dict[str, int] = {}
            for at, t in enumerate(tokens):
                counts[t] += 1
                first.setdefault(t, at)
            for t, n in counts.items():
                if t[0] == "=" and (not whole or n > 1):
                    continue  # such a line is in no class of this page's vector
                c = cells.get((host, t))
                if c is None:
                    c = cells[host, t] = [0, 0, 0, 0.0]
                if whole:
                    c[0] += 1
                    c[1] += n
                    c[2] = (c[2] + xxhash.xxh3_64_intdigest(f"{key}:{n}")) & (2**64 - 1)
                    c[3] += first[t] / len(tokens)
            if whole:
                around = {slot for path, _, _ in lines for slot in path[:-1]}
                for path, line, link in lines:
                    if not path:
                        continue
                    # lines of slots that neither hold a slot nor are held by one need no telling
                    for parent in ([path[-2]] if len(path) > 1 else []) + ([""] if path[-1] in around else []):
                        c = texts.setdefault((host, parent, path[-1], _hash(_DIGITS.sub("#", line))), [0, 0, 0])
                        c[0] += 1
                        c[1] += len(line)
                        c[2] += len(line) * link
            if len(texts) + len(cells) > _HELD:
                yield flush()
    yield flush()


def _inside(path: tuple[str, ...], main: set[str]) -> bool:
    """Whether a line with these slots around it is in a main slot or in what is nested there as its text."""
    inside, parent = False, ""
    for slot in path:
        inside = slot in main or (inside and f"{parent}\t{slot}" in main)
        parent = slot
    return inside


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, raw_html, classes, texts): for each host and slot its own text, with that nested in it, text of its pages, and pages on which its class is out of order."""
    cells: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        for host, page, classes, pairs in zip(*(batch.column(c).to_pylist() for c in range(4))):
            lines, tokens, whole = outline(page)
            if not whole:
                continue
            first: dict[str, int] = {}
            for at, t in enumerate(tokens):
                first.setdefault(t, at)
            pairs = set(pairs or ())
            own: dict[str, int] = defaultdict(int)
            full: dict[str, int] = defaultdict(int)
            for path, line, _ in lines:
                n = len(line)
                if path:
                    own[path[-1]] += n
                for slot, inner in reversed(list(zip(path, [*path[1:], None]))):
                    if inner is not None and f"{slot}\t{inner}" not in pairs:
                        break
                    full[slot] += n
            total = sum(len(line) for _, line, _ in lines)
            wrong = set()
            for order in classes or ():
                at = [first[t] for t in order if t in first]
                if at != sorted(at):
                    wrong.update(order)
            for t in first:
                if _is_slot(t):
                    c = cells.setdefault((host, t), [0, 0, 0, 0])
                    for k, x in enumerate((own[t], full[t], total, t in wrong)):
                        c[k] += x
    rows = [(h, t, *c) for (h, t), c in cells.items()]
    cols = list(zip(*rows)) if rows else [()] * 6
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.string(), *[pa.int64()] * 4])], names=["host", "token", "own", "mass", "total", "wrong"]
    )


def _broadcast_if_small(table: DataFrame, columns: list[Column], most: int) -> DataFrame:
    """The table with a broadcast hint if its texts, measured, have at most so many bytes."""
    size = F.lit(0).cast("long")
    for c in columns:
        size = size + F.coalesce(F.octet_length(F.concat_ws(" ", c)), F.lit(0)) + 32
    return F.broadcast(table) if (table.agg(F.sum(size).alias("n")).first()["n"] or 0) <= most else table


def main_slots(rows: DataFrame, least_share: float = 0.5, weight: float = 3.0, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(host, main array<string>): the slots of each host's template that hold most of their pages' text, and the template's own text.

    A slot nested in another as part of its text is named by both, with a tab between; a line of the
    template is its hash after an equals sign.
    """
    rows = rows.select("host", "key", "raw_html").where("raw_html is not null and raw_html <> ''")
    learned = cut_lineage(rows.mapInArrow(_learn_batches, _CELLS))
    # sums of hashes wrap around as the fingerprints of whole vectors do
    counted = (
        learned.where("line is null").groupBy("host", "token").agg(
            F.sum("pages").alias("pages"),
            F.sum("times").alias("times"),
            # a wrapping sum: halves are summed apart, so that ANSI arithmetic can't overflow
            F.sum(F.shiftright("vector", 32)).alias("v1"),
            F.sum(F.col("vector").bitwiseAND(0xFFFFFFFF)).alias("v0"),
            F.sum("place").alias("place"),
        )
    )
    # lines on a few pages can't be the template's: they are all but a few
    counted = cut_lineage(counted.where(~F.col("token").startswith("=") | (F.col("pages") >= LEAST_PAGES)))
    tokens = counted.where(~F.col("token").startswith("="))
    # text of a slot: most of it is neither links nor the same from page to page
    each = learned.where("line is not null").groupBy("host", "parent", "token", "line").agg(F.sum("times").alias("times"), F.sum("mass").alias("mass"), F.sum("links").alias("links"))
    told = each.groupBy("host", "parent", "token").agg(F.sum(F.col("mass") / F.col("times")).alias("different"), F.sum("mass").alias("mass"), F.sum("links").alias("links"))
    told = cut_lineage(told.where((F.col("different") * 2 > F.col("mass")) & (F.col("links") * 2 < F.col("mass")) & ~F.col("token").rlike("^" + _BESIDE.pattern)).select("host", "parent", "token"))
    pairs = told.where("parent <> ''").groupBy("host").agg(F.collect_set(F.concat_ws("\t", "parent", "token")).alias("texts"))

    # equivalence classes: one vector, each token once a page; their order is that of the mean places
    once = tokens.where("pages > 0 and times = pages")
    classes = once.groupBy("host", "pages", "v1", "v0").agg(F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("order"))
    classes = classes.where(F.size("order") >= 2).select("host", "pages", "v1", "v0", F.transform("order", lambda x: x["token"]).alias("order"))
    # a line with the vector of a class is in the class
    printed = counted.where(F.col("token").startswith("=") & (F.col("times") == F.col("pages"))).join(classes.select("host", "pages", "v1", "v0"), ["host", "pages", "v1", "v0"], "left_semi")
    printed = printed.groupBy("host").agg(F.collect_set("token").alias("printed"))
    # one page has one order
    known = classes.where("pages > 1").groupBy("host").agg(F.collect_list("order").alias("classes")).join(pairs, "host", "full")
    known = _broadcast_if_small(cut_lineage(known), [F.col("host"), F.flatten("classes"), F.col("texts")], broadcast_bytes)
    measured = cut_lineage(
        rows.join(known, "host", "left").select("host", "raw_html", "classes", "texts").mapInArrow(_measure_batches, "host string, token string, own long, mass long, total long, wrong long")
        .groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("own", "mass", "total", "wrong")])
    )
    # a class in several orders is none; its pairs of opening and closing tag are always in order
    is_slot = ~F.col("token").startswith("/") & ~F.contains("token", F.lit(">")) & (F.col("token") != "body")
    slots = once.where(is_slot).join(classes, ["host", "pages", "v1", "v0"]).join(measured, ["host", "token"])
    slots = slots.where((F.col("wrong") == 0) | F.array_contains("order", F.concat(F.lit("/"), "token")))
    everywhere = measured.groupBy("token").agg(*[(F.sum(c) / F.greatest(F.sum("total"), F.lit(1))).alias(f"usual_{c}") for c in ("own", "mass")])
    # all hosts' share of the same token counts as ``weight`` pages; a cut or rare page's class is judged by it alone
    loose = tokens.where(is_slot).select("host", "token").join(slots.select("host", "token"), ["host", "token"], "left_anti")
    zero = F.lit(0).cast("long")
    judged = slots.select("host", "token", "pages", "own", "mass", "total").unionByName(loose.select("host", "token", zero.alias("pages"), zero.alias("own"), zero.alias("mass"), zero.alias("total")))
    share = lambda c: (F.col("pages") * F.col(c) / F.greatest("total", F.lit(1)) + weight * F.col(f"usual_{c}")) / (F.col("pages") + weight)
    judged = judged.join(everywhere, "token").where(share("mass") >= least_share).select("host", "token", share("own").alias("own"))
    # what is only wrapped around a main slot has no text of its own
    alone = told.where("parent = ''").select("host", "token", F.lit(True).alias("text"))
    main = judged.join(alone, ["host", "token"], "left").where((F.col("own") >= least_share) | F.col("text")).groupBy("host").agg(F.collect_set("token").alias("slots"))
    none = F.array().cast("array<string>")
    joined = main.join(pairs, "host", "left").join(printed, "host", "left")
    return joined.select("host", F.concat("slots", F.coalesce("texts", none), F.coalesce("printed", none)).alias("main"))


_END = re.compile(r"[。！？.!?…”’」)）]$")


def features(line: str, index: int) -> tuple[int, int, int]:
    """Hashes of the line without digits, of its beginning, and of its shape."""
    masked = _DIGITS.sub("#", line)
    n = len(line)
    shape = f"{min(7, n.bit_length())}{bool(_END.search(line))}{'：' in line}{line[:1].isascii()}{min(index, 3)}"
    return _hash("line " + masked), _hash("begin " + masked[:4]), _hash("shape " + shape)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (item_id, title, content, raw_html, main): rows of three kinds.

    0: a furniture line (id, line_no); 1: a feature's counts (key, furniture, article);
    2: a line to judge (id, line_no, the three feature keys, what is known of it).
    """
    counts: dict[int, list[int]] = {}

    def flush() -> pa.RecordBatch:
        at, n = list(counts), len(counts)
        out = _rows([1] * n, [None] * n, [None] * n, at, [counts[k][0] for k in at], [counts[k][1] for k in at], [None] * n, [None] * n)
        counts.clear()
        return out

    for batch in batches:
        kind, ids, nos, keys, a, b, c, known = ([] for _ in range(8))
        for i, title, content, page, main in zip(*(batch.column(x).to_pylist() for x in range(5))):
            if not content:
                continue
            title = squeeze_line(title or "")
            rows = [(no, squeeze_line(line)) for no, line in enumerate(content.split("\n"), 1)]
            rows = [(no, line) for no, line in rows if line]
            inside, outside, whole = set(), set(), False
            if page:
                lines, _, whole = outline(page)
                wanted = set(main or ())
                for path, line, _ in lines if wanted else ():  # of a host without any template nothing is known
                    (inside if _inside(path, wanted) and _text_token(line) not in wanted else outside).add(line)
            sure = whole and bool(inside)
            if sure:
                for at, (no, line) in enumerate(rows):
                    article = line in inside or line == title
                    if not article and not _residue(line):
                        kind.append(0)
                        ids.append(i)
                        nos.append(no)
                        for x in (keys, a, b, c, known):
                            x.append(None)
                    if line == title:
                        continue  # the headline is known wherever it stands; its look-alikes are links
                    for k in features(line, at):
                        n = counts.get(k)
                        if n is None:
                            n = counts[k] = [0, 0]
                        n[article] += 1
            else:
                for at, (no, line) in enumerate(rows):
                    f = features(line, at)
                    kind.append(2)
                    ids.append(i)
                    nos.append(no)
                    keys.append(f[0])
                    a.append(f[1])
                    b.append(f[2])
                    c.append(_residue(line))
                    known.append(-1 if line == title or line in inside else 1 if line in outside else 0)
        yield _rows(kind, ids, nos, keys, a, b, c, known)
        if len(counts) > _HELD:
            yield flush()
    yield flush()


def _rows(kind, ids, nos, keys, a, b, c, known) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.bool_()), pa.array(known, pa.int32())],
        names=["kind", "id", "line_no", "key", "a", "b", "residue", "known"],
    )


def furniture_states(odds: list[float], switch: float = 2.5) -> list[bool]:
    """The likeliest labels (True: furniture) of consecutive lines, a change of label costing ``switch``."""
    if not odds:
        return []
    score, back = [0.0, odds[0]], []
    for x in odds[1:]:
        stay_a, come_a = score[0], score[1] - switch
        stay_f, come_f = score[1], score[0] - switch
        back.append((come_a > stay_a, come_f > stay_f))
        score = [max(stay_a, come_a), max(stay_f, come_f) + x]
    state = score[1] > score[0]
    out = [state]
    for changed in reversed(back):
        state ^= changed[state]
        out.append(state)
    return out[::-1]


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, lines of (line_no, odds, residue)): the furniture lines.

    Where nothing but residue is left as an article, the page is a server's answer: its lines are problem 4's.
    """
    for batch in batches:
        ids, nos = [], []
        for i, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines.sort(key=lambda x: x["line_no"])
            states = furniture_states([x["odds"] for x in lines])
            if any(x["residue"] for x in lines) and all(furniture or x["residue"] for x, furniture in zip(lines, states)):
                continue
            for x, furniture in zip(lines, states):
                if furniture and not x["residue"]:
                    ids.append(i)
                    nos.append(x["line_no"])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=["item_id", "line_no"])


def furniture_lines(items: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(item_id, line_no): the non-blank lines of content that are not part of the article.

    Lines are split at newlines and count from 1, blank ones included. Null and empty contents
    have none; a repeated item gives its lines once. Lines that are template residue are left out.
    The host is that of the address, whatever source_site says. The hosts' templates are broadcast
    if they have at most ``broadcast_bytes``, else they are joined by a shuffle.
    """
    rows = items.select(F.col("item_id").cast("long").alias("id"), F.lower(host_of(F.coalesce("normalized_url", "url", F.lit("")))).alias("host"), "title", "content", "raw_html").where("id is not null")
    slots = cut_lineage(main_slots(rows.select("host", F.col("id").alias("key"), "raw_html"), broadcast_bytes=broadcast_bytes))
    slots = _broadcast_if_small(slots, [F.col("host"), F.col("main")], broadcast_bytes)
    joined = rows.where("content is not null and content <> ''").join(slots, "host", "left").select("id", "title", "content", "raw_html", "main")
    out = cut_lineage(joined.mapInArrow(_extract_batches, "kind int, id long, line_no int, key long, a long, b long, residue boolean, known int"))
    sure = out.where("kind = 0").select(F.col("id").alias("item_id"), "line_no")
    # log-odds of furniture of every feature that a line to judge has
    todo = out.where("kind = 2").select("id", "line_no", "residue", "known", F.posexplode(F.array("key", "a", "b")).alias("which", "key"))
    wanted = todo.select("key").distinct()
    counts = out.where("kind = 1").groupBy("key").agg(F.sum("a").alias("furniture"), F.sum("b").alias("article")).join(wanted, "key", "left_semi")
    odds = counts.select("key", F.log((F.col("furniture") + 0.5) / (F.col("article") + 0.5)).alias("odds"))
    scored = todo.join(odds, "key", "left")
    # the whole line counts fully if it is known; a line's beginning and shape are not independent, so each counts in part
    part = F.when(F.col("which") == 0, F.coalesce("odds", F.lit(0.0))).when(F.col("which") == 1, 0.7 * F.coalesce("odds", F.lit(0.0))).otherwise(0.7 * F.coalesce("odds", F.lit(0.0)))
    per_line = scored.groupBy("id", "line_no").agg(F.sum(part).alias("odds"), F.first("residue").alias("residue"), F.first("known").alias("known"))
    per_line = per_line.withColumn("odds", F.when(F.col("known") != 0, F.col("known") * 20.0).otherwise(F.greatest(F.least("odds", F.lit(8.0)), F.lit(-8.0))))
    per_item = per_line.groupBy("id").agg(F.collect_list(F.struct("line_no", "odds", "residue")).alias("lines"))
    judged = per_item.mapInArrow(_judge_batches, "item_id long, line_no int")
    return sure.unionByName(judged).distinct()


def articles(items: DataFrame) -> DataFrame:
    """(item_id, content): every item, its content without the furniture lines; null stays null."""
    bad = furniture_lines(items).groupBy("item_id").agg(F.collect_set("line_no").alias("bad"))
    keep = F.filter(F.transform(F.split("content", "\n", -1), lambda x, i: F.struct(x.alias("x"), (i + 1).cast("int").alias("no"))), lambda s: ~F.array_contains("bad", s["no"]))
    return items.select(F.col("item_id").cast("long").alias("item_id"), "content").join(bad, "item_id", "left").select(
        "item_id", F.when(F.col("bad").isNull(), F.col("content")).otherwise(F.array_join(F.transform(keep, lambda s: s["x"]), "\n")).alias("content")
    )
