"""URL filters by redirect equivalence (operator 1), in DataFrame functions alone.

Rules decide by host and path. URLs that redirect to each other, or name each other as canonical, are one resource:
connected components over these edges spread a block to aliases that no rule names, unless a rule allows a member of the
component. A node is host and path, so pages that differ in scheme, query or fragment are one node from the start.

Edges: canonical links and refreshing meta tags outside comments, scripts and styles, resolved against the page and its
base; redirects known from a crawl; and redirects that servers give by convention (`CONVENTIONS`), named rules that a
caller may change or leave out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.llm.graph import connected_components
from tidemark.llm.storage import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits `host` and its subdomains if the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """(name, verdict) of the longest rule that fits, null if none does; of rules of one length an allow comes first. The
    rules are part of the plan, so keep them to a few hundred."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


#: What is no markup of the page: comments, scripts and styles, also unfinished ones.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
TAGS = r"(?is)<(?:link|meta|base)\b[^>]*>"
#: Character references that urls in attributes use; the ampersand comes last, so that nothing is decoded twice.
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))
CANONICAL = r"(?is)^<link\b.*\brel\s*=\s*(?:\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)"
REFRESH = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\"'\s>]+))"
CONTENT_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def decoded(text: Column) -> Column:
    for reference, character in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return F.trim(text)


def href(tag: Column) -> Column:
    return decoded(F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)]))


def html_targets(html: Column) -> Column:
    """struct<base: the href of the first base tag, empty without one; targets: the hrefs of canonical links and the urls of
    refreshing meta tags>."""

    def read(tags: Column) -> Column:
        hrefs = F.transform(F.filter(tags, lambda t: t.rlike(CANONICAL)), href)
        urls = F.transform(F.filter(tags, lambda t: t.rlike(REFRESH)), lambda t: decoded(F.regexp_extract(t, CONTENT_URL, 1)))
        base = F.get(F.filter(F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<base\b")), href), lambda u: u != ""), 0)
        return F.struct(F.coalesce(base, F.lit("")).alias("base"), F.filter(F.concat(hrefs, urls), lambda u: u != "").alias("targets"))

    return let(F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), F.lit(TAGS), F.lit(0)), read)


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its segments . and .. carried out."""
    segments = F.split(path, "/")

    def step(done: Column, x: Column) -> Column:
        back = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(x == ".", done).when(x == "..", back).otherwise(F.array_append(done, x))

    folded = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), step)
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.array_join(closed, "/")).otherwise(path)


def resolved(target: Column, host: Column, path: Column) -> Column:
    """struct<host, path> of a link's target on a page, or of a base; null for schemes without a host."""
    at = lambda h, p: F.struct(h.alias("host"), p.alias("path"))
    full = lambda u: at(host_of(u), path_of(u))
    own = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    return (
        F.when(target.rlike(SCHEME), F.when(target.rlike(r"^[^/?#]*://"), full(target)))
        .when(target.startswith("//"), full(F.concat(F.lit("x:"), target)))
        .when(own == "", at(host, path))
        .when(own.startswith("/"), at(host, without_dots(own)))
        .otherwise(at(host, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own))))
    )


@dataclass(frozen=True)
class Convention:
    """Servers redirect a host or a path, as `part` says, with such a beginning or end to the one without it."""

    name: str
    part: str
    pattern: str


#: At most one of each part applies, the first that fits.
CONVENTIONS = (
    Convention("www host", "host", r"^www\."),
    Convention("mobile host", "host", r"^m\."),
    Convention("closing slash", "path", r"/\z"),
    Convention("html ending", "path", r"\.html\z"),
)


def conventional(host: Column, path: Column, conventions: tuple[Convention, ...] = CONVENTIONS) -> Column:
    """The node that a server redirects to by convention."""
    ends = []
    for part, value in (("host", host), ("path", path)):
        out = value
        for c in reversed([c for c in conventions if c.part == part]):
            out = F.when(value.rlike(c.pattern), F.regexp_replace(value, c.pattern, "")).otherwise(out)
        ends.append(out)
    return F.concat(*ends)


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None, conventions: tuple[Convention, ...] = CONVENTIONS) -> DataFrame:
    """(page_id, host, path, rule, verdict, component), a row for each row of `pages`.

    Own rule: its verdict. Else, of the page's component, `allow` if a rule allows a member, else `block` if a rule blocks
    one, else `allow`. `redirects` (from_url, to_url): edges known from a crawl, besides the canonical links and refreshes
    in html (a column that may be missing). conventions: of servers; () for none. component: its smallest node.

    Null urls, and urls without ://, have empty host and path, no rule and no alias, and are allowed. Null html has no
    links; texts of any length are read whole. Other columns may have any name. Rows with null or repeated page_id are judged each. Empty table: an empty result. A rule of the longest name
    wins; a host with uppercase A-Z is the same host.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url, html = F.col("url").cast("string"), F.col("html").cast("string") if "html" in pages.columns else F.lit("")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), html.alias("html"))
    page = read.select("page_id", "host", "path", F.concat("host", "path").alias("node"), rule_column(F.col("host"), F.col("path"), rules).alias("own"), html_targets(F.col("html")).alias("found"))
    base = F.when(F.col("found.base") == "", None).otherwise(resolved(F.col("found.base"), F.col("host"), F.col("path")))
    page = page.withColumn("at", F.coalesce(base, F.struct("host", "path")))
    targets = F.transform("found.targets", lambda t: let(resolved(t, F.col("at.host"), F.col("at.path")), lambda r: F.concat(r["host"], r["path"])))
    own = scratch.save(page.select("page_id", "host", "path", "node", "own", targets.alias("targets")))
    named = own.where("node <> ''")
    edges = named.select(F.col("node").alias("a"), F.explode("targets").alias("b"))
    if conventions:
        edges = edges.union(named.select(F.col("node").alias("a"), conventional(F.col("host"), F.col("path"), conventions).alias("b")))
    if redirects is not None:
        ends = [F.concat(host_of(F.col(c).cast("string")), path_of(F.col(c).cast("string"))) for c in ("from_url", "to_url")]
        edges = edges.union(redirects.select(ends[0].alias("a"), ends[1].alias("b")))
    edges = scratch.save(edges.where("a <> b and a <> '' and b <> ''").distinct())
    component = scratch.save(connected_components(edges, scratch))
    #: Decisions of nodes that no page stands for count too: a redirect's target may be outside the crawl.
    split = lambda c: (F.regexp_extract(c, r"(?s)^([^/]*)", 1), F.regexp_extract(c, r"(?s)^[^/]*(.*)$", 1))
    decided = component.select("component", rule_column(*split(F.col("node")), rules)["verdict"].alias("v"))
    spread = decided.groupBy("component").agg(F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1).otherwise(0)).alias("force")).where("force > 0")
    spread = scratch.save(spread)  # so that a component of many pages can be split when it is joined
    members = component.join(spread, "component", "left").select(F.col("node"), "component", "force")
    joined = own.drop("targets").join(members, "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("force") == 1, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("own.name").alias("rule"), verdict.alias("verdict"), F.coalesce("component", "node").alias("component"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _plain(part: str) -> str:
    """The SQL of one part of `conventional`."""
    own = [c for c in CONVENTIONS if c.part == part]
    return "CASE " + " ".join(f"WHEN regexp_matches({part}, {_sql(c.pattern)}) THEN regexp_replace({part}, {_sql(c.pattern)}, '')" for c in own) + f" ELSE {part} END"


def _replaced(sql: str) -> str:
    for reference, character in REFERENCES:
        sql = f"replace({sql}, {_sql(reference)}, {_sql(character)})"
    return f"trim({sql})"


_HOST = "CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*'), '" + UPPER + "', '" + LOWER + "') ELSE '' END"
_PATH = "CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_HREF = _replaced(" || ".join(f"coalesce(regexp_extract(t, {_sql(HREF)}, {k}), '')" for k in (1, 2, 3)))


def _resolved(u: str, host: str, path: str) -> str:
    """SQL of a struct {h, p}; p is not free of dots yet where the target is relative."""
    own = f"regexp_extract({u}, '^[^?#]*')"
    full = lambda x: f"{{'h': {_HOST.format(u=x)}, 'p': {_PATH.format(u=x)}, 'd': false}}"
    return (
        f"CASE WHEN regexp_matches({u}, {_sql(SCHEME)}) THEN CASE WHEN regexp_matches({u}, '^[^/?#]*://') THEN {full(u)} END "
        f"WHEN starts_with({u}, '//') THEN {full(f"('x:' || {u})")} WHEN {own} = '' THEN {{'h': {host}, 'p': {path}, 'd': false}} "
        f"WHEN starts_with({own}, '/') THEN {{'h': {host}, 'p': {own}, 'd': true}} "
        f"ELSE {{'h': {host}, 'p': CASE WHEN contains({path}, '/') THEN regexp_extract({path}, '(?s)^.*/') ELSE '/' END || {own}, 'd': true}} END"
    )


_FOLDED = (
    "list_reduce(list_transform(string_split({p}, '/'), lambda s: [s]), lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END ELSE list_concat(a, s) END)"
    " || CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN [''] ELSE CAST([] AS VARCHAR[]) END"
)
_DOTS = "CASE WHEN {d} AND regexp_matches({p}, '/\\.\\.?(/|$)') THEN array_to_string(" + _FOLDED + ", '/') ELSE {p} END"
ORACLE = f"""
WITH RECURSIVE rules(name, verdict, h, p) AS (VALUES {", ".join(f"('{r.name}', '{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
p AS (SELECT row_number() OVER () AS r, page_id, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path, html FROM pages),
n AS (SELECT *, host || path AS node, {_plain("host")} || {_plain("path")} AS plain FROM p),
tags AS (SELECT r, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT r, regexp_extract_all(regexp_replace(html, {_sql(HIDDEN)}, ' ', 'g'), {_sql(TAGS)}) AS t FROM n WHERE node <> '')),
bases AS (SELECT r, arg_min(u, k) AS u FROM (SELECT r, k, {_HREF} AS u FROM tags WHERE regexp_matches(t, '(?i)^<base\\b')) WHERE u <> '' GROUP BY r),
b AS (SELECT n.r, n.node, n.host, n.path, CASE WHEN u IS NOT NULL THEN {_resolved("u", "host", "path")} END AS x FROM n LEFT JOIN bases USING (r) WHERE node <> ''),
base AS (SELECT r, node, coalesce(x.h, host) AS h, coalesce({_DOTS.format(d="x.d", p="x.p")}, path) AS p FROM b),
links AS (SELECT r, {_HREF} AS u FROM tags WHERE regexp_matches(t, {_sql(CANONICAL)})
  UNION ALL SELECT r, {_replaced(f"regexp_extract(t, {_sql(CONTENT_URL)}, 1)")} FROM tags WHERE regexp_matches(t, {_sql(REFRESH)})),
ends AS (SELECT node, {_resolved("u", "h", "p")} AS x FROM links JOIN base USING (r) WHERE u <> ''),
edges AS (SELECT node AS a, plain AS b FROM n UNION SELECT node, x.h || {_DOTS.format(d="x.d", p="x.p")} FROM ends),
e AS (SELECT a, b FROM edges WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM edges WHERE a <> b AND a <> '' AND b <> ''),
nodes AS (SELECT node FROM n WHERE node <> '' UNION SELECT a FROM e),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
fits AS (SELECT node, name, verdict, row_number() OVER (PARTITION BY node ORDER BY length(name) DESC, verdict, name DESC) AS k FROM nodes JOIN rules
  ON (regexp_extract(node, '^[^/]*') = h OR ends_with(regexp_extract(node, '^[^/]*'), '.' || h)) AND starts_with(regexp_extract(node, '^[^/]*(.*)$', 1), p)),
own AS (SELECT node, name, verdict FROM fits WHERE k = 1),
spread AS (SELECT a, min(b) AS component, max(CASE own.verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS force FROM reach LEFT JOIN own ON b = own.node GROUP BY a)
SELECT page_id, host, path, own.name AS rule, coalesce(own.verdict, CASE WHEN force = 1 THEN 'block' ELSE 'allow' END) AS verdict, coalesce(component, n.node) AS component
FROM n LEFT JOIN own ON own.node = n.node LEFT JOIN spread ON spread.a = n.node
"""
