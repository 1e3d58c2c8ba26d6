"""URL filters: rules by host and path, carried over redirects and canonical links."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import settle
from riskloom.llm.components import components

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Elements whose content is text and no markup.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
TAG = re.compile(r"<([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
REFRESH_URL = re.compile(r"""url\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"']+))""", re.I)
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
REFERENCE = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?", re.S)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(rows: DataFrame, url: str, host: str = "host", path: str = "path", at: str = "at") -> DataFrame:
    """``rows`` with the url's host and path (empty for null and for urls without ``://``) and its address.

    The address names a page in the link graph: no scheme, no fragment, host
    in lower case; null without a host.
    """
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.regexp_replace(F.substring(F.col(url), begin + 3, F.char_length(url)), "(?s)#.*", "")).otherwise("")
    rows = rows.withColumn("_rest", F.coalesce(rest, F.lit("")))
    rows = rows.withColumn("_host", lower_ascii(F.regexp_extract("_rest", r"^[^/?]*", 0)))
    rows = rows.withColumn("_tail", F.substring("_rest", F.char_length("_host") + 1, F.char_length("_rest")))
    rows = rows.withColumn("_path", F.regexp_extract("_tail", r"^[^?]*", 0))
    slash = F.when(F.col("_tail").startswith("/"), "").otherwise("/")
    named = F.when(F.col("_host") != "", F.concat("_host", slash, "_tail"))
    added = {host: F.col("_host"), path: F.col("_path"), at: named}
    return rows.withColumns(added).drop("_rest", "_host", "_tail", "_path")


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def without_dots(path: str) -> str:
    """``path`` with its ``.`` and ``..`` parts carried out."""
    done, parts = [], path.split("/")
    for part in parts:
        if part == "..":
            if len(done) > 1:
                done.pop()
        elif part != ".":
            done.append(part)
    if parts[-1] in (".", ".."):
        done.append("")
    return "/".join(done)


def resolved(base: str | None, target: str) -> str | None:
    """``target`` as an absolute url, read on the page ``base`` (RFC 3986); null if it or the page has no host."""
    scheme, host, path, query = REFERENCE.match(target).groups()
    if scheme is None:
        if not base or not SCHEME.match(base):
            return None
        scheme, base_host, base_path, base_query = REFERENCE.match(base).groups()
        if base_host is None:
            return None
        if host is None:
            host = base_host
            if not path:
                path, query = base_path, base_query if query is None else query
            elif not path.startswith("/"):
                path = (base_path or "/").rpartition("/")[0] + "/" + path
    return f"{scheme}://{host}{without_dots(path)}{query or ''}" if host else None


def tags(html: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(name, attributes) of every start tag outside comments and raw text, in one pass."""
    at = html.find("<")
    while at >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            if end < 0:
                return
            at = html.find("<", end)
            continue
        found = TAG.match(html, at)
        if not found:
            at = html.find("<", at + 1)
            continue
        name, at, own = found.group(1).lower(), found.end(), {}
        while found := ATTRIBUTE.match(html, at):
            value = next((v for v in found.groups()[1:] if v is not None), "")
            own.setdefault(found.group(1).lower(), unescape(value))
            at = found.end()
        yield name, own
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if not end:
                return
            at = end.start() + 1
        at = html.find("<", at)


def alias_targets(url: str | None, html: str | None) -> list[str]:
    """Absolute urls that a page names as its canonical address or sends its readers to."""
    base, written = (url or "").strip(" \t\r\n\f"), []
    first = True
    for name, own in tags(html or ""):
        if name == "base" and "href" in own and first:
            first, base = False, resolved(base, own["href"].strip(" \t\r\n\f")) or base
        elif name == "link" and "canonical" in own.get("rel", "").lower().split():
            written.append(own.get("href", ""))
        elif name == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            found = REFRESH_URL.search(own.get("content", ""))
            written.append("".join(filter(None, found.groups())) if found else "")
    values = (value.strip(" \t\r\n\f") for value in written)
    found = (resolved(base, value) for value in values if value)
    return list(dict.fromkeys(filter(None, found)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_targets(url: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([alias_targets(*row) for row in zip(url, html, strict=True)], dtype=object)


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses: where pages declare canonical addresses or redirects.

    All links of a page count, in any order; ``rel`` is a list of words; a
    ``base`` element changes where relative links start. Comments, scripts and
    other raw text hold no links.
    """
    saying = pages.select(F.col(url).alias("_url"), F.col(html).alias("_html")).filter(
        F.rlike("_html", F.lit(r"(?i)canonical|http-equiv"))
    )
    # Written before it is filtered: a pushed filter would unfold all the steps above it.
    links = settle(saying.select("_url", F.explode(page_targets("_url", "_html")).alias("_to")))
    links = with_parts(with_parts(links, "_url", at="source").select("source", "_to"), "_to", at="target")
    return settle(links.select("source", "target"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row.

    A page that a rule fits has the rule's verdict. Any other has what its
    aliases say, all addresses connected over canonical links and redirects:
    allow if one of them is allowed by a rule, else block if one is blocked,
    else allow. ``redirects`` may hold more (source, target) urls. Null urls
    and urls without ``://`` are nobody's alias and allowed. Repeated rows are
    judged each.
    """
    links = alias_links(pages, url, html)
    if redirects is not None:
        more = with_parts(redirects.select(F.col("source").alias("_from"), F.col("target").alias("_to")), "_from", at="source")
        links = links.unionByName(with_parts(more, "_to", at="target").select("source", "target"))
    roots = components(links)
    nodes = with_parts(roots.withColumn("_url", F.concat(F.lit("x://"), "node")), "_url")
    _, said = ruled(F.col("host"), F.col("path"), rules)
    said_by = nodes.select("root", said.alias("said"))
    decided = said_by.groupBy("root").agg(F.min("said").alias("alias_verdict"))  # allow before block
    known = settle(roots.join(decided, "root").filter("alias_verdict is not null").select("node", "alias_verdict"))
    rows = with_parts(pages.select(F.col(key).alias("key"), F.col(url).alias("_url")), "_url")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("own", verdict)
    return rows.join(known, rows["at"] == known["node"], "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit("allow")).alias("verdict")
    )
