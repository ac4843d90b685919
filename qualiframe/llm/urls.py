"""URL filters with redirect equivalence, in DataFrame functions only.

A page's own rule decides it.  A page without a rule takes the decision of its aliases: pages and
targets joined by canonical links, meta refreshes and given redirects form components, and a
component with a blocked member is blocked unless one of its members is explicitly allowed.
Aliases are compared by host, path without dot segments, and query.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; null html has no links, of broken html what can be read as a tag; very
long html is read whole, in linear time; repeated urls are one node and get one verdict; an empty table gives an
empty result; columns of the input beyond id, url and html are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch

#: (verdict, host, path)
Rule = tuple[str, str, str]

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def tidy_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    whole = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    first = F.array(F.lit(""))
    step = F.aggregate(
        F.slice(F.split(whole, "/"), 2, 1 << 30), first,
        lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))),
    )
    return F.when(path.contains("/."), F.array_join(step, "/")).otherwise(path)


def alias_key(url: Column) -> Column:
    """Host, tidy path and query of a url; scheme and fragment do not tell pages apart. Null without a host."""
    path = path_of(url)
    key = F.concat(host_of(url), F.when(path == "", "/").otherwise(tidy_path(path)), F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit("")))
    return F.when(host_of(url) != "", key)


def _fit(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Place (from 1) of the longest rule that fits, else null; the rules are part of the expression."""
    found = F.lit(None).cast("int")
    for place, (_, on, below) in sorted(enumerate(rules, 1), key=lambda r: len(r[1][1]) + len(r[1][2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(below)
        found = F.when(fits, F.lit(place)).otherwise(found)
    return found


def _of_rule(values: Sequence[str], place: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in enumerate(values, 1) for x in pair])[place]


_TAG = r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = r"""(?s)[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def _attribute(attributes: Column, name: str) -> Column:
    """Value of the first attribute of that name, without quotes; null if there is none."""
    found = F.get(F.filter(attributes, lambda a: a.rlike(rf"(?is)^{name}\s*=")), F.lit(0))
    value = F.regexp_replace(F.regexp_replace(found, r"(?s)^[^=]*=\s*", ""), r"""(?s)^(["'])(.*)["']$""", "$2")
    return F.regexp_replace(F.replace(value, F.lit("&amp;"), F.lit("&")), r"^\s+|\s+$", "")


def _absolute(to: Column, host: Column, path: Column) -> Column:
    """A link as a url, seen from a page of this host and path; null for none and for schemes without ``//``."""
    base, path = F.concat(F.lit("http://"), host), F.when(path == "", "/").otherwise(path)
    return (
        F.when(to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://"), to)
        .when(to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:|^#|^$"), F.lit(None))
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(base, to))
        .when(to.startswith("?"), F.concat(base, path, to))
        .otherwise(F.concat(base, F.regexp_replace(path, r"(?s)[^/]*$", ""), to))
    )


def link_edges(pages: DataFrame, work: Scratch, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): alias keys of a page and of each canonical link or meta refresh in it.

    Tags may span lines and hold ``>`` in quotes; what comments, scripts and styles hold is no tag.
    Links are relative to the page, or to its first ``base`` tag.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html), _HIDDEN, " "), F.lit(_TAG), F.lit(0))
    # Few pages and tags are left at each step; writing them keeps each expression small.
    some = work.save(pages.filter(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).alias("url"), tags.alias("tags")), "tags")
    of_tag = lambda tag: F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    based = F.get(F.filter("tags", lambda t: t.rlike(r"(?is)^<base\b.*[\s\"'/]href\s*=")), F.lit(0))
    found = some.select(alias_key(F.col("url")).alias("a"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _attribute(of_tag(based), "href").alias("base"), F.explode("tags").alias("tag"))
    found = found.filter("a is not null").select("a", "host", "path", "base", F.col("tag").rlike(r"(?is)^<link\b").alias("is_link"), of_tag(F.col("tag")).alias("attributes"), "tag")
    canonical = F.col("is_link") & _attribute(F.col("attributes"), "rel").rlike(r"(?is)(^|\s)canonical(\s|$)")
    refresh = F.col("tag").rlike(r"(?is)^<meta\b") & _attribute(F.col("attributes"), "http-equiv").rlike(r"(?is)^refresh$")
    jump = F.regexp_extract(_attribute(F.col("attributes"), "content"), r"""(?is)^[0-9.\s]*[;,]?\s*url\s*=\s*["']?\s*([^"'\s]+)""", 1)
    found = found.select("a", "host", "path", "base", F.when(canonical, _attribute(F.col("attributes"), "href")).when(refresh, jump).alias("to")).filter("to <> ''")
    found = work.save(found.withColumn("base", _absolute(F.col("base"), F.col("host"), F.col("path"))), "links")
    seen_from = F.when(F.col("base").isNull(), F.col("host")).otherwise(host_of(F.col("base"))), F.when(F.col("base").isNull(), F.col("path")).otherwise(path_of(F.col("base")))
    found = work.save(found.select("a", "to", seen_from[0].alias("host"), seen_from[1].alias("path")), "based")
    found = work.save(found.select("a", _absolute(F.col("to"), F.col("host"), F.col("path")).alias("to")), "targets")
    return found.select("a", alias_key(F.col("to")).alias("b")).filter("a is not null and b is not null")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``redirects`` adds edges between urls (from_url, to_url)."""
    work = Scratch(pages.sparkSession, "urls")
    verdicts, names = [r[0] for r in rules], [r[1] + r[2] for r in rules]
    edges = link_edges(pages, work)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    node = work.save(connected(edges, work), "nodes")
    key = F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", 1), F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", 2)
    ruled = node.select("node", "label", key[0].alias("host"), key[1].alias("path")).withColumn("own", _of_rule(verdicts, _fit(rules, F.col("host"), F.col("path"))))
    of_class = ruled.groupBy("label").agg(F.bool_or(F.col("own") == "allow").alias("allows"), F.bool_or(F.col("own") == "block").alias("blocks"))
    blocked = work.save(of_class.filter("blocks and not coalesce(allows, false)").select("label"), "blocked")
    aliases = work.save(node.join(blocked, "label", "left_semi").select("node"), "aliases")

    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), alias_key(F.col("url")).alias("key"))
    out = out.withColumn("fit", _fit(rules, F.col("host"), F.col("path")))
    # Pages with a rule have no part in the join: their key is null.
    out = out.withColumn("key", F.when(F.col("fit").isNull(), F.col("key")))
    out = out.join(aliases.withColumn("alias_blocked", F.lit(True)), F.col("key") == F.col("node"), "left")
    verdict = F.coalesce(_of_rule(verdicts, F.col("fit")), F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", _of_rule(names, F.col("fit")).alias("rule"), verdict.alias("verdict"))
