"""URL filters with redirect equivalence, with DataFrame functions only.

Rules block or allow a host with all its subdomains, for urls whose path begins as the rule's; of the rules that fit a url
the longest (host and path) holds, of equally long ones an allowing one. Urls that no rule fits take the verdict of their
aliases: a page, what its canonical link names, what its refresh directive or a table of recorded redirects leads to, are
one resource. Connected components over these edges say which urls are aliases, whether pages or not; a component with a url
that is explicitly allowed is allowed, else one with a blocked url is blocked, else it is allowed. A url's own rule goes
before its component's verdict.

Canonical links are ``<link rel="canonical" href>``, refresh directives ``<meta http-equiv="refresh" content="0; url=...">``,
outside comments, scripts and style sheets; relative references are resolved against the page's own url. Two spellings
of a url are the same resource if they differ by the case of scheme and host, by a fragment, or by an empty path.

Only urls with edges are labelled; a component of any size is a set of rows (vertex, component), never one value. Vertices are
SHA-256 digests, so rows stay small whatever the urls' lengths.

Defined edge cases: a null url, or one without ``://``, has an empty host and path, no rule, no aliases, and is allowed; a
null or empty html has no edges; a page that links to itself adds none; repeated rows are judged alike; equal urls with
different html share the edges of all; references with another scheme than ``scheme://`` (mailto:) are no edges; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, skewed_join
from siltstone.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r" \t\n\f\r"
#: What a parser doesn't read tags in.
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style"
TAG = r"(?i)<(?:link|meta)\b[^>]*>"
#: Pages without one of these words have no edges; looked for before anything is parsed.
HINT = r"(?i)canonical|refresh"
REFRESH_URL = rf"""(?i)url[{BLANK}]*=[{BLANK}]*["']?([^"']*)"""


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def attribute(name: str) -> str:
    """The pattern of an attribute's value, quotes included."""
    return rf"""(?i)[{BLANK}"'/]{name}[{BLANK}]*=[{BLANK}]*("[^"]*"|'[^']*'|[^{BLANK}"'>]+)"""


def _value(tag: Column, name: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(tag, attribute(name), 1), r"""^["']|["']$""", ""), F.lit(" \t\n\f\r"))


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource(url: Column) -> Column:
    """The url as a vertex: scheme and host in lower case, no fragment, ``/`` for an empty path; null without ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    out = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.lit(""),
        lambda a, s: F.when(s == "..", F.regexp_replace(a, "/[^/]*$", "")).when(s == ".", a).otherwise(F.concat(a, F.lit("/"), s)),
    )
    out = F.concat(out, F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), out).otherwise(path)


def resolved(reference: Column, base: Column) -> Column:
    """The url that a reference on the page ``base`` names; null if it names the page itself or no ``scheme://`` url."""
    site = F.concat(F.translate(F.substring_index(base, "://", 1), UPPER, LOWER), F.lit("://"), host_of(base))
    path = F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base))
    beyond = F.regexp_extract(reference, "^[^?#]*([?#].*)?$", 1)
    own = F.regexp_extract(reference, "^[^?#]*", 0)
    return (
        F.when((reference == "") | F.startswith(reference, F.lit("#")), F.lit(None).cast("string"))
        .when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(F.contains(reference, F.lit("://")), reference))
        .when(F.startswith(reference, F.lit("//")), F.concat(F.substring_index(site, "//", 1), reference))
        .when(F.startswith(reference, F.lit("?")), F.concat(site, path, reference))
        .when(F.startswith(reference, F.lit("/")), F.concat(site, _without_dots(own), beyond))
        .otherwise(F.concat(site, _without_dots(F.concat(F.regexp_extract(path, "^.*/", 0), own)), beyond))
    )


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(length, allows, rule, action) of the rule that holds, or null. ``rules`` is a short list that the caller writes."""
    found = [F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.action == "allow").alias("allows"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))) for r in rules]
    return F.array_max(F.array_compact(F.array(*found)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url): the pages' canonical links and refresh directives, as vertices."""
    hinted = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).filter(F.contains("u", F.lit("://")) & F.col("h").rlike(HINT))
    tags = hinted.select("u", F.explode(F.regexp_extract_all(F.regexp_replace("h", UNREAD, " "), F.lit(TAG), 0)).alias("tag"))
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(_value(F.col("tag"), "rel")), f"[{BLANK}]+", " "), F.lit(" "))
    link = F.when(F.rlike("tag", F.lit("^<[lL]")) & F.contains(words, F.lit(" canonical ")), _value(F.col("tag"), "href"))
    refresh = F.when(F.rlike("tag", F.lit("^<[mM]")) & (F.lower(_value(F.col("tag"), "http-equiv")) == "refresh"), F.trim(F.regexp_extract(_value(F.col("tag"), "content"), REFRESH_URL, 1)))
    named = tags.select("u", F.replace(F.coalesce(link, refresh), F.lit("&amp;"), F.lit("&")).alias("r")).filter(F.col("r").isNotNull())
    ends = named.select(resource(F.col("u")).alias("from_url"), resource(resolved(F.col("r"), F.col("u"))).alias("to_url"))
    return ends.filter(F.col("from_url") != F.col("to_url")).distinct()


def _digest(c: str) -> Column:
    return F.unhex(F.sha2(F.col(c), 256))


def alias_verdicts(edges: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, verdict): for each url with an edge, by its digest, what its component says."""
    edges = scratch.write(edges, "edges")
    links = edges.select(_digest("from_url").alias("a"), _digest("to_url").alias("b"))
    found = connected_components(links, scratch, "aliases").withColumnRenamed("node", "key")
    ends = edges.select(F.explode(F.array("from_url", "to_url")).alias("url"))
    ruled = ends.select(_digest("url").alias("key"), fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["action"].alias("action")).distinct()
    nodes = scratch.write(ruled.join(found, "key", "left").withColumn("component", F.coalesce("component", "key")), "nodes")
    says = nodes.groupBy("component").agg(F.count("*").alias("n"), F.when(F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)), "allow").when(F.bool_or(F.col("action") == "block"), "block").otherwise("allow").alias("verdict"))
    return scratch.write(skewed_join(nodes, scratch.write(says, "components"), ["component"], how="inner").select("key", "verdict"), "verdicts")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), by_alias (no rule fits, but the url has aliases). ``redirects``: (from_url, to_url)
    as recorded by a crawler."""
    scratch = Scratch(pages.sparkSession, "urls")
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        recorded = redirects.select(resource(F.col("from_url")).alias("from_url"), resource(F.col("to_url")).alias("to_url"))
        edges = edges.unionByName(recorded.filter(F.col("from_url") != F.col("to_url"))).distinct()
    said = alias_verdicts(edges, scratch, rules)
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("u")).select("page_id", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rows = rows.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    # rows that need no alias meet nothing: a number of their own keeps them from one partition
    key = F.when(F.col("r").isNull() & F.contains("u", F.lit("://")), F.unhex(F.sha2(resource(F.col("u")), 256))).otherwise(F.to_binary(F.monotonically_increasing_id().cast("string"), F.lit("utf-8")))
    met = rows.withColumn("key", key).join(said, "key", "left")
    return met.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", "verdict", F.lit("allow")).alias("verdict"), F.coalesce(F.col("r").isNull() & F.col("verdict").isNotNull(), F.lit(False)).alias("by_alias"))
