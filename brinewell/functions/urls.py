"""Address functions as column expressions (no UDF unless noted)."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The part before the query without trailing slashes, and the query; the fragment is left out.
_PARTS = "(?s)^([^?#]*?)/*(\\?[^#]*)?(?:#.*)?$"
#: An address that ends, or goes on with its query, right after the host.
_BARE = "(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)(?=\\?|$)"


def normalize_url(url: Column) -> Column:
    """Fragment and trailing slashes of the path removed, an empty path made '/', query kept; null stays null."""
    return F.regexp_replace(F.regexp_replace(url, _PARTS, "$1$2"), _BARE, "$1/")


def host_of(url: Column) -> Column:
    """Host (with port, if there is one) of an absolute address, else ''."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def bare_host(url: Column) -> Column:
    """Lower-cased host without a leading 'www.'."""
    return F.regexp_replace(F.lower(host_of(url)), "^www\\.", "")


def in_domains(url: Column, domains: list[str]) -> Column:
    """Host equals one of the domains or is below one."""
    host = F.lower(host_of(url))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | host.endswith("." + d.lower())
    return out


def in_hosts(url: Column, hosts: list[str], strip_www: bool = True) -> Column:
    """Host, by default without 'www.', equals a list entry as it is written.

    An entry that itself begins with 'www.' therefore never matches while strip_www is on.
    """
    return (bare_host(url) if strip_www else F.lower(host_of(url))).isin(*hosts)


#: File endings that are not pages (fixed values).
SKIP_EXTENSIONS = (
    "css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff2?", "ttf", "eot", "mp4", "mp3",
    "webp", "bmp", "pdf", "docx?", "xlsx?", "pptx?", "zip", "rar", "7z", "tar", "gz",
)
#: Path steps that lead to no article (a fixed pattern).
SKIP_STEPS = "/(search|login|logout|register|user|admin|wp-admin|wp-content/(?!uploads)|wp-json|api|feed|rss|comment|reply|trackback|tag/|category/|author/|page/\\d+|date/)\\b"
#: File endings of attachments (fixed values).
ATTACHMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar")


def has_extension(url: Column, extensions: tuple[str, ...]) -> Column:
    """The whole address ends in one of the extensions, in any case."""
    return url.rlike("(?i)\\.(" + "|".join(extensions) + ")$")


def skipped_path(url: Column) -> Column:
    """The address has a skipped path step, an unfilled '$[' or 'nextcid=', in any case."""
    return url.rlike(f"(?i){SKIP_STEPS}|\\$\\[|nextcid=")


def crawlable_href(href: Column) -> Column:
    """An href worth resolving: not blank, begins with an ASCII character, no script, mail, phone or fragment."""
    t = F.trim(href)
    return href.isNotNull() & (t != "") & t.rlike("^[\\x00-\\x7f]") & ~t.rlike("(?i)^(javascript:|mailto:|tel:|#)")


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href resolved against base (RFC 3986, Arrow batches); null if either is null or unreadable."""

    def one(b, h):
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def content_hash(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes in hex."""
    return F.sha2(text, 256)


def snapshot_path(url: Column, root: str = "snapshots") -> Column:
    """root/ab/cd/<16 hex digits>.html of an address."""
    h = F.substring(F.sha2(url, 256), 1, 16)
    return F.concat(F.lit(root + "/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), h, F.lit(".html"))


def safe_path(path: Column) -> Column:
    """True for a relative path that stays below its root: no NUL, no '..' step, no absolute start."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return path.isNotNull() & ~F.contains(path, F.lit("\x00")) & ~p.rlike("(^|/)\\.\\.(/|$)") & ~p.rlike("^([A-Za-z]:|/)")


def attachment_extension(url: Column, default: str = ".pdf") -> Column:
    """The first of .pdf, .docx, .xlsx that the lower-cased address contains, else the default."""
    u = F.lower(url)
    out = F.lit(default)
    for e in (".xlsx", ".docx", ".pdf"):
        out = F.when(F.contains(u, F.lit(e)), e).otherwise(out)
    return out


def safe_file_name(url: Column) -> Column:
    """First 12 hex digits of the address's MD5 and its attachment extension."""
    return F.concat(F.substring(F.md5(url), 1, 12), attachment_extension(url))
