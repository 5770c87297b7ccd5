"""Template residue and error-page text (problem 4).

Evidence of three kinds is weighed. Syntax: marks of template languages, repeated units and
pseudo-Latin words; a sentence is residue if it has little prose for its marks, so that a text
that writes about placeholders is none. Information: a body's sentences that recur, digits aside,
under unlike titles of the hosts that have them tell nothing of the page, and a body is a server's
answer in place of content if it lacks most terms of its own title and address and nearly all of it
recurs so or is an error message; a message that doesn't fill its sentence counts only if it
recurs. Titles: a default title stands over many unlike bodies of several hosts that lack its
terms; those of common editors and servers are known. What is many grows with the pages of the
hosts concerned.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions.urls import host_of
from brinewell.llm.mojibake import CHAINS
from brinewell.operators.html import html_title
from brinewell.session import cut_lineage

#: Marks of unfilled templates (fixed patterns of common template languages and editors).
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^%\n]{1,80}%\}|<%[^%\n]{0,80}%>|\$\{[A-Za-z_][\w.\[\]]*\}|\{\$[\w.\[\]]+\}|\[\[[^\[\]\n]{1,40}\]\]"
    r"|%[A-Z][A-Z_]{2,}%|\{[A-Za-z_]\w*\}|\{\d\}|\{[一-鿿]{1,8}\}|#[一-鿿]{1,6}#|__[A-Z][A-Z_]{2,}__"
    r"|\[object Object\]|\bNaN\b|\bundefined\b(?! (?:behaviou?r|variable))|\bTB[DA]_\w+|\bTemplate_(?=\{)|(?<![A-Za-z])X{3,}(?=[一-鿿,，。、;；]|$)|(?<=[:：])X{3,}"
    r"|此处(?:插入|填写|为文章标题|输入|添加)|在此(?:处)?(?:填写|输入|插入)|请替换为|待补充|此段可删除|请输入(?:标题|正文|内容)|(?:内容|正文|摘要|标题)待(?:补充|填)"
    r"|\[Insert [^\]\n]{1,40}\]|\bInsert (?:paragraph|text|title|image) here\b|\b(?:headline|title|text|content|caption) goes here\b|Click here to edit",
)

#: What a text with one of these marks has in any case; looking for it first is faster.
_HINTS = (
    "{", "%", "<", "$", "[", "#", "XXX", "NaN", "undefined", "TBD_", "TBA_", "__", "Template_", "此处", "在此", "请替换为", "待补充", "此段可删除", "请输入", "待填",
    "Insert", "goes here", "Click here",
)

#: Messages of failing servers, refused access and closed pages, and notices that scripts are required (fixed patterns).
MESSAGE = re.compile(
    r"(?:页面|内容|文章|资源|地址|链接)[^。\n]{0,8}(?:不存在|已被删除|已下线|未找到|已失效)|栏目已调整|(?:没有|无)权(?:限)?(?:查看|访问)|权限不足|访问被拒绝|仅限[^。\n]{0,12}访问[^。\n]{0,6}登录"
    r"|暂停访问|系统(?:正在)?(?:升级)?维护|服务器(?:内部)?错误|服务(?:暂时)?不可用|数据库连接失败|请求过于频繁|防护系统拦截|找不到您|参数非法|操作已终止|请求的资源未找到|登录(?:已)?(?:过期|超时)|会话已过期"
    r"|(?:分钟|小时)后恢复|秒后自动跳转|刷新页面或清除缓存|检查网址是否正确|(?:错误代码|事件编号|请求标识)[ :：]*[\w-]*\d[\w-]*"
    r"|(?:启用|开启|允许)[^。\n]{0,4}(?:JavaScript|脚本)|未开启脚本|允许运行脚本|脚本被拦截|无法加载正文|浏览器版本过低"
    r"|(?:Warning|Notice|(?:Fatal |Parse )?Error): [^\n]{0,200}? on line \d+|was not found on this server|\bBad Gateway\b|\bGateway Time-?out\b|Internal Server Error|Access denied|Permission denied|not have permission|unexpected error occurred|temporarily unavailable"
    r"|session (?:has )?expired|undefined variable|fatal error:|stack trace omitted|^Error code \d|quote incident|page (?:you requested )?(?:could not be|was not|cannot be) found|HTTP \d{3} ?[-:–]"
    r"|(?:enable|turn on|requires?) JavaScript|relies on scripts|scripting on and refresh|scripts? (?:that )?(?:your browser )?(?:has |have )?blocked|JavaScript (?:is )?(?:disabled|required)",
    re.IGNORECASE,
)

#: Titles that editors, servers and frameworks give by default (fixed values).
DEFAULT_TITLE = re.compile(
    r"^(?:无标题(?:文档|页)?|未命名(?:文档)?|新建(?:网页|文档|页面)\s*\d*|请输入标题|(?:标题){2,}|untitled(?: (?:document|page))?\s*\d*|new page\s*\d*|(?:page )?title goes here|undefined|null|none|title|document"
    r"|[1-5]\d\d(?: [A-Za-z]+){1,4}|error(?: \d{3})?|oops!?|service unavailable|bad gateway|not found|forbidden|access denied|internal server error|just a moment\.*"
    r"|系统提示|提示信息|错误提示|出错了!?|访问被拒绝|站点维护中|系统维护中|页面不存在|页面未找到|页面出错|此处为.{0,12}|.{0,8}\(示例\)|测试(?:页面|标题)?\d*|placeholder)$",
    re.IGNORECASE,
)

#: Function words that no sentence of these languages lacks; pseudo-Latin filler has none.
_FUNCTION = frozenset(
    "the of and a an to in for is was at by on with from that not its has be are or as were had it but which who this than between"
    " le la les de des du et en un une que qui dans pour est el los las y del por con para der die das und ist ein eine nicht mit von zu il di che per o os e da do no".split()
)
_SENTENCE = re.compile(r"\n+|(?<=[。！？])|(?<=[.!?])\s+")
_WORDS = re.compile(r"^[A-Z]?[a-z]+(?: [a-z]+){7,}[.!?]?$")
_DIGITS = re.compile(r"\d+")
_BREAKS = re.compile(r"[\s　]+")


def _gaps(seq: str | list[str], k: int) -> list[int]:
    """Distances at which runs of k come again, the most frequent first; a repeated unit's length is among them."""
    last: dict = {}
    gaps: Counter = Counter()
    for i in range(len(seq) - k + 1):
        run = seq[i : i + k] if isinstance(seq, str) else tuple(seq[i : i + k])
        if run in last:
            gaps[i - last[run]] += 1
        last[run] = i
    return [g for g, _ in gaps.most_common(4)]


def _repeats(seq: str | list[str], p: int) -> float:
    """Share of places that hold the same as the place p before."""
    return sum(map(operator.eq, seq, seq[p:])) / max(1, len(seq) - p)


def is_filler(sentence: str) -> bool:
    """Repeated units of any length, keyboard runs or pseudo-Latin words in place of a sentence."""
    s = sentence.strip(" \t　.。!！?？")
    s = re.sub(r"(?<=\D)\s+\d+$", "", s)  # a counter may follow the repetition
    n = len(s)
    if n < 6 or "锟" in s or "�" in s:
        return False
    if re.match(r"lorem ipsum\b", s, re.IGNORECASE):
        return True
    letter = re.compile(r"[A-Za-z0-9一-鿿]")
    words = s.split()
    if len(words) >= 6 and letter.search(words[0]) and len(set(words)) * 2 <= len(words) + 1:
        for p in {1, 2, 3, *_gaps(words, 1), *_gaps(words, 2), *_gaps(words, 3)}:
            if len(words) - p >= 3 and p * 2 <= len(words) and _repeats(words, p) >= 0.8:
                return True
    if len(set(s)) * 2 <= max(8, n):
        for p in {*range(1, 9), *_gaps(s, 2), *_gaps(s, 4)} if len(words) <= 2 else range(2, 9):
            unit = s[:p]
            # a unit of one character must be long, of all other units three must stand in a row from the beginning
            if p * 3 <= n and n >= (8 if p == 1 else 6) and re.search(r"[A-Za-z一-鿿]", unit) and len(set(unit)) > (p > 1):
                head = s[: max(3 * p, int(0.7 * n))]
                if len(words) <= 2 and (unit * (n // p + 1)).startswith(head):
                    return True
                if 2 <= p <= 8 and s.startswith(unit * 4):
                    return True
    return bool(_WORDS.match(s)) and not _FUNCTION.intersection(s.lower().split())


_BROKEN = re.compile("[\x80-\u024f€‚„…†‡ˆ‰‹‘’“”•–—˜™›�]")


def _unreadable(s: str) -> bool:
    """A fifth or more of the characters are those that wrong single-byte decoding leaves: words can't be judged."""
    return len(_BROKEN.findall(s)) * 5 >= len(s)


def _readings(s: str) -> list[str]:
    """What a sentence may have been before it was read in a wrong encoding."""
    return [x for x in (undo(s) for undo in CHAINS.values()) if x != s]


_PROSE = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-z]+)*|[㐀-鿿豈-﫿ぁ-ヿ가-힣]")


def prose(text: str) -> float:
    """Words of a text, two letters of Chinese, Japanese or Korean counting as one."""
    return sum(0.5 if len(w) == 1 and not w.isascii() else 1.0 for w in _PROSE.findall(text))


def _unfilled(s: str) -> bool:
    """Placeholders stand for at most ``_WORDS_A_MARK`` words of prose each."""
    marks = PLACEHOLDER.findall(s)
    return bool(marks) and prose(PLACEHOLDER.sub(" ", s)) <= _WORDS_A_MARK * len(marks)


#: Words of prose that a sentence with unfilled placeholders has for each of them at most.
_WORDS_A_MARK = 6.0


def _message(s: str) -> int:
    """0: no error message, 1: one among other words, 2: one that fills at least half of the sentence."""
    if not MESSAGE.search(s):
        return 0
    return 2 if 2 * prose(MESSAGE.sub(" ", s)) <= prose(s) else 1


def _sentences(text: str) -> list[str]:
    return [x for x in (s.strip(" \t\r　") for s in _SENTENCE.split(text)) if x]


def template_sentences(text: str) -> list[str]:
    """The sentences of a text with unfilled placeholders or filler; garbled ones are judged by what they may have been."""
    out = []
    marked, broken = any(x in text for x in _HINTS), _BROKEN.search(text) is not None
    for s in _sentences(text):
        if broken and not s.isascii() and _unreadable(s):
            if any(_unfilled(x) for x in _readings(s)):
                out.append(s)
        elif (marked and _unfilled(s)) or is_filler(s):
            out.append(s)
    return out


def messages(text: str) -> list[tuple[str, int]]:
    """(sentence, 0 to 2) of a text: how much of an error message each sentence is, in its likeliest reading."""
    return [(s, max([_message(s), *(map(_message, _readings(s)) if not s.isascii() and _unreadable(s) else ())])) for s in _sentences(text)]


def residue_sentences(text: str) -> list[str]:
    """The sentences that are residue by themselves, without the evidence of other pages."""
    bad = set(template_sentences(text))
    return [s for s, m in messages(text) if s in bad or m == 2]


def residue_title(title: str) -> bool:
    """The title is a default, or holds an unfilled placeholder or filler."""
    t = title.strip(" \t\r\n　")
    return bool(DEFAULT_TITLE.match(t)) or _unfilled(t) or is_filler(t)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _terms(text: str) -> set[str]:
    """Latin words and two-character steps of the other letters, lower-cased."""
    t = text.lower()
    cjk = re.findall(r"[一-鿿぀-ヿ]+", t)
    return set(re.findall(r"[a-z]{3,}", t)) | {c[i : i + 2] for c in cjk for i in range(len(c) - 1)}


def shared_terms(terms: set[str], text: str) -> int:
    """How many of the terms a text has."""
    t = text.lower()
    words = set(re.findall(r"[a-z]{3,}", t)) if any(x.isascii() for x in terms) else ()
    return sum((x in words) if x.isascii() else (x in t) for x in terms)


#: Factors and masks of the permutations that unlike bodies are counted by (fixed values, odd factors).
_FACTORS = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for k in range(16)], np.uint64)
_MASKS = np.array([(k + 1) * 0xD6E8FEB86659FD93 % 2**64 for k in range(16)], np.uint64)


def minima(text: str) -> list[int]:
    """The least of the text's 5-character substrings, white space and case aside, in each of eight pairs of orders.

    Two texts agree in a pair with a probability that is the square of their share of common substrings.
    """
    a = np.frombuffer("".join(text.lower().split()).ljust(5).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(a) - 4, np.uint64)
    for k in range(5):
        h = (h ^ a[k : len(a) - 4 + k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    least = [int(((h ^ m) * f).min()) for f, m in zip(_FACTORS, _MASKS)]
    return [_hash(f"{a} {b}") for a, b in zip(least[::2], least[1::2])]


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, title_hash, title, content): whether the body has none of the title's terms, and its minima."""
    for batch in batches:
        apart, least = [], []
        for title, content in zip(batch.column("title").to_pylist(), batch.column("content").to_pylist()):
            t = (title or "").strip()
            kept = "\n".join(x for x in (content or "").split("\n") if x.strip() != t)
            # most titles share a common step or word with any long text: half of the terms tell
            own = _terms(t)
            apart.append(not own or 2 * shared_terms(own, kept) < len(own))
            least.append(minima(kept))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("title_hash"), pa.array(apart), pa.array(least, pa.list_(pa.int64()))], names=["host", "title_hash", "apart", "least"])


_PATH = re.compile(r"(?:https?:/)?/[\w./?=&%#-]+", re.ASCII)


def _own_terms(title: str, url: str) -> set[str]:
    """Terms of a page's title, if that isn't residue itself, and of the words that its address joins by hyphens."""
    slug = re.findall(r"[a-z]{3,}(?:[-_][a-z]{3,})+", re.sub(r"^[a-z]+://[^/]*", "", url.lower()))
    return (set() if residue_title(title) else _terms(title)) | {w for step in slug for w in re.split("[-_]", step)}


_SCANNED = "id long, host string, title_bad boolean, body_bad boolean, title_hash long, body_hash long, sentences array<struct<s:long,n:int,m:int>>"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, url, host, title, content): what its own text tells, and of a body without most of its page's terms the masked sentences."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int32()), ("m", pa.int32())]))
    for batch in batches:
        ids, hosts, title_bad, body_bad, titles, sentences, bodies = [], [], [], [], [], [], []
        for i, url, host, title, content in zip(*(batch.column(c).to_pylist() for c in range(5))):
            ids.append(i)
            hosts.append(host)
            t = (title or "").strip()
            title_bad.append(bool(t) and residue_title(t))
            body_bad.append(bool(content) and bool(template_sentences(content)))
            titles.append(_hash(_DIGITS.sub("#", t)) if t else None)
            bodies.append(_hash(content or ""))
            own = None
            if content and not body_bad[-1]:
                terms = _own_terms(t, url or "")
                kept = [s for s in _sentences(content) if s != t]
                # an unlike text may share a common step or word with a title: half of the terms tell
                if kept and (not terms or 2 * shared_terms(terms, _PATH.sub(" ", "\n".join(kept))) < len(terms)):
                    own = [{"s": _hash(_DIGITS.sub("#", s)), "n": len(s), "m": m} for s, m in messages(content) if s != t]
            sentences.append(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(title_bad), pa.array(body_bad), pa.array(titles, pa.int64()), pa.array(bodies, pa.int64()), pa.array(sentences, kind)],
            names=["id", "host", "title_bad", "body_bad", "title_hash", "body_hash", "sentences"],
        )


def residue_by_arm(
    items: DataFrame, id_col: str = "item_id", min_titles: int = 6, min_pages: int = 8, min_hosts: int = 3, min_named: int = 2,
    title_share: float = 0.0002, body_share: float = 0.0002, filled: float = 0.8, site_names: bool = False,
) -> DataFrame:
    """(id, field_name, arm): the fields that hold residue and the kind of evidence: 'syntax', 'answer', 'shared title', 'site name'.

    Null and empty fields hold none. 'answer': a body without most of its page's terms of which ``filled`` of
    the characters are in sentences that recur, digits aside, under at least ``min_titles`` unlike
    titles, and under as many as ``body_share`` of the pages of the hosts that have the sentence, or in
    error messages that fill their sentence or recur at all. 'shared title': a title without digits of
    at least ``min_pages`` unlike bodies of ``min_hosts`` hosts, and as many as ``title_share`` of these
    hosts' pages, most of which lack most of its terms; copies of one text, edited or not, count as
    about one body. 'site name', only if asked for: the name that stands behind at least ``min_named``
    pages' HTML titles of the host.
    """
    rows = items.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce("normalized_url", "url", F.lit("")).alias("url"), "title", "content", *(["raw_html"] if site_names else [])
    ).where("id is not null")
    rows = rows.withColumn("host", F.lower(host_of(F.col("url"))))
    scanned = cut_lineage(rows.select("id", "url", "host", "title", "content").mapInArrow(_scan_batches, _SCANNED))
    arm = lambda df, field, name: df.select("id", F.lit(field).alias("field_name"), F.lit(name).alias("arm"))
    found = arm(scanned.where("title_bad"), "title", "syntax").unionByName(arm(scanned.where("body_bad"), "content", "syntax"))

    if site_names:
        rows = rows.withColumn("whole", F.when(F.col("raw_html").rlike("(?i)<title"), html_title(F.col("raw_html"))).otherwise(""))
        named = rows.select("host", F.trim(F.regexp_extract("whole", "(?s)^.* - (.+)$", 1)).alias("name")).where("name <> ''")
        names = named.groupBy("host", "name").agg(F.count("*").alias("n")).where(F.col("n") >= min_named).select("host", "name")
        titled = rows.select("id", "host", F.trim("title").alias("name"), "whole")
        # on a host of one page its own HTML title tells: the name stands on both sides
        by_name = titled.join(names, ["host", "name"], "left_semi").select("id").unionByName(titled.where("name <> '' and whole = concat(name, ' - ', name)").select("id"))
        found = found.unionByName(arm(by_name, "title", "site name"))

    host_pages = cut_lineage(scanned.where("host is not null").groupBy("host").agg(F.count("*").alias("pages")))

    def pages_of(having: DataFrame, key: str) -> DataFrame:
        """The pages of all hosts that have a key."""
        return having.select(key, "host").distinct().join(host_pages, "host").groupBy(key).agg(F.sum("pages").alias("of"))

    # titles shared by many unlike pages: those of many different bodies first, then by how unlike these are
    often = cut_lineage(
        scanned.where("title_hash is not null")
        .groupBy("title_hash")
        .agg(F.approx_count_distinct("host", 0.02).alias("hosts"), F.count_distinct("body_hash").alias("bodies"))
        .where((F.col("hosts") >= min_hosts) & (F.col("bodies") >= min_pages))
        .select("title_hash")
    )
    # of copies one address may have several rows; equal bodies are compared once a host
    alike = scanned.join(often, "title_hash", "left_semi").groupBy("title_hash", "host", "body_hash").agg(F.min("id").alias("id")).select("id", "title_hash")
    compared = cut_lineage(
        rows.join(alike, "id").select("host", "title_hash", "title", "content").mapInArrow(_compare_batches, "host string, title_hash long, apart boolean, least array<long>")
    )
    shared = (
        compared.groupBy("title_hash")
        .agg(F.least(*[F.count_distinct(F.col("least")[k]) for k in range(len(_FACTORS) // 2)]).alias("bodies"), F.avg(F.col("apart").cast("int")).alias("apart"))
        .join(pages_of(compared, "title_hash"), "title_hash")
        .where((F.col("bodies") >= F.greatest(F.lit(min_pages), title_share * F.col("of"))) & (F.col("apart") > 0.5))
    )
    # a masked title may be a series ("notice 12"): only titles without digits are judged by their number
    plain = rows.where("title is not null and not title rlike '[0-9]'").select("id")
    found = found.unionByName(arm(scanned.join(shared.select("title_hash"), "title_hash", "left_semi").select("id").join(plain, "id", "left_semi"), "title", "shared title"))

    # bodies of recurring sentences and messages; a title that is residue tells no page from another
    each = scanned.where("sentences is not null").select("id", "host", F.when(F.col("title_bad"), F.col("id")).otherwise(F.coalesce("title_hash", "id")).alias("over"), F.explode("sentences").alias("x"))
    each = each.select("id", "host", "over", "x.s", "x.n", "x.m")
    counted = each.groupBy("s").agg(F.count_distinct("over").alias("titles")).where("titles > 1")
    of = pages_of(each.join(counted, "s", "left_semi"), "s")
    counted = counted.join(of, "s", "left").select("s", "titles", ((F.col("titles") >= min_titles) & (F.col("titles") >= body_share * F.coalesce("of", F.lit(0)))).alias("recurs"))
    empty = (F.col("m") == 2) | ((F.col("m") == 1) & F.col("titles").isNotNull()) | F.coalesce("recurs", F.lit(False))
    judged = each.join(counted, "s", "left").groupBy("id").agg(F.sum("n").alias("n"), F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("none"))
    found = found.unionByName(arm(judged.where(F.col("none") >= filled * F.col("n")), "content", "answer"))
    return found.distinct().withColumnRenamed("id", id_col)


def find_residue(items: DataFrame, id_col: str = "item_id", **options) -> DataFrame:
    """(id, field_name): the fields ('title', 'content') that hold template residue or error-page text, of any length.

    A repeated row gives one case; null and empty fields give none. Options are those of ``residue_by_arm``.
    """
    return residue_by_arm(items, id_col, **options).select(id_col, "field_name").distinct()


def without_residue(items: DataFrame, id_col: str = "item_id", **options) -> DataFrame:
    """The items with every field that holds residue set to null; all other columns as they are."""
    found = find_residue(items, id_col, **options).groupBy(id_col).agg(F.collect_set("field_name").alias("__residue"))
    joined = items.join(found, id_col, "left")
    bad = lambda f: F.coalesce(F.array_contains("__residue", f), F.lit(False))
    return joined.select(
        *[F.when(~bad(c), F.col(c)).alias(c) if c in ("title", "content") else F.col(c) for c in items.columns]
    )
