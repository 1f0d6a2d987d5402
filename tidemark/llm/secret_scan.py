"""Secret scans with an incremental blob ledger (operator 8), in DataFrame functions alone.

Every version of every text is addressed by its SHA-256. The ledger has, for each blob, the rule versions it was scanned
with and the spans they found; a run scans only pairs of blob and rule version that the ledger lacks, one text for each
blob, and joins the ledger's findings back to all paths that hold the blob.

Spans come from built-in functions: the pieces between matches (split) and the matches (regexp_extract_all) alternate, so
running sums of their lengths are the places of the matches, in code points and in bytes. The sums are windows over a row
for each match, and a masked text is joined from byte slices, so time grows with a text's length and matches alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.llm.storage import Scratch, free_name


@dataclass(frozen=True)
class Rule:
    """A match counts if its `group` has `least` characters; matches are leftmost and don't overlap within a kind. A change
    of pattern, group or least needs a new version."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which kinds are listed. A run of {n,} is what a run of + of n characters or more is.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Dropped or not, rows named in a list of at most so many ids are left out by a broadcast; beyond it by a shuffled join.
BROADCAST_IDS = 500_000

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,byte_start:bigint,byte_end:bigint>>"
MATCHES = "array<struct<rank:int,place:int,gap:bigint,size:bigint,byte_gap:bigint,byte_size:bigint,good:boolean>>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches in a text that isn't null, in order: the lengths of each and of the piece before it, and whether
    it counts. Texts without a match cost one search."""
    pattern = F.lit(rule.pattern)

    def parts(found: Column) -> Column:
        sizes = lambda x: (F.char_length(x).cast("long"), F.octet_length(x).cast("long"))
        own = F.arrays_zip(
            F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value")
        )

        def one(x: Column, place: Column) -> Column:
            (gap, byte_gap), (size, byte_size) = sizes(x["gap"]), sizes(x["match"])
            good = F.char_length(x["value"]) >= rule.least
            named = {"rank": F.lit(rank), "place": place, "gap": gap, "size": size, "byte_gap": byte_gap, "byte_size": byte_size, "good": good}
            return F.struct(*[c.alias(n) for n, c in named.items()])

        return F.transform(own, one)

    return F.when(text.rlike(rule.pattern), let(F.regexp_extract_all(text, pattern, F.lit(0)), parts)).otherwise(F.array().cast(MATCHES))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def scan(blobs: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rules, spans) of (blob, text, pending), where pending names the rules to apply as `kind:version`. A blob may
    be there more than once.

    Null texts are empty. Texts are read once, and what is shuffled is a row for each match. Empty table: an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = [F.when(F.array_contains("pending", f"{r.kind}:{r.version}"), matches(text, r, k)).otherwise(F.array().cast(MATCHES)) for k, r in enumerate(rules)]
    read = scratch.save(blobs.select("blob", "pending", F.concat(*each).alias("matches")))
    clean = read.where(F.size("matches") == 0).select("blob", F.col("pending").alias("rules"), F.array().cast(SPANS).alias("spans"))
    rows = read.where(F.size("matches") > 0).dropDuplicates(["blob"]).select("blob", "pending", F.inline("matches"))
    so_far = Window.partitionBy("blob", "rank").orderBy("place")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    placed = rows.select("*", F.sum(F.col("gap") + F.col("size")).over(so_far).alias("end"), F.sum(F.col("byte_gap") + F.col("byte_size")).over(so_far).alias("byte_end"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", kind.alias("kind"), "end", (F.col("byte_end") - F.col("byte_size")).alias("byte_start"), "byte_end")
    found = placed.groupBy("blob").agg(F.first("pending").alias("rules"), F.array_sort(F.collect_list(F.when(F.col("good"), span))).cast(SPANS).alias("spans"))
    return clean.dropDuplicates(["blob"]).unionByName(found)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the ledger lacks for these versions (doc_id, text): (blob, rules, spans) rows to append to it. `ledger` None:
    nothing was ever scanned. A ledger may have several rows for a blob, one for each run that added rules.

    Null texts are the blob of the empty text. Repeated rows and copies are scanned once; rows without doc_id, and those of
    one doc_id, aren't told apart and are each read, but a blob has one row. Nothing new, or an empty table: no rows. Other
    columns aren't read.
    """
    scratch = Scratch(versions.sparkSession, "ledger")
    every = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    versions = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paths = versions.select("doc_id", blob_of(F.col("text")).alias("blob"))
    #: Written before it is joined, so that the copies of a common blob can be split over tasks.
    first = scratch.save(paths.groupBy("blob").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    if ledger is None:
        repeated = first.where("rows > 1")
        pending = None
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        pending = first.join(seen, "blob", "left").select("blob", "first", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("pending"))
        pending = scratch.save(pending.where(F.size("pending") > 0))
        repeated = first.where("rows > 1")
    #: Rows whose blob an earlier row holds. Rows without an id aren't told apart and are scanned each.
    again = scratch.save(paths.join(repeated, "blob").where("doc_id > first").select(F.col("doc_id").alias("again"), F.col("blob").alias("of")))
    few = again.count() <= BROADCAST_IDS
    ids = F.broadcast(again) if few else again
    held = versions.withColumn("blob", blob_of(F.col("text")))
    once = held.join(ids, (F.col("doc_id") == F.col("again")) & (F.col("blob") == F.col("of")), "left_anti")
    todo = once.withColumn("pending", every) if pending is None else once.join(pending.select("blob", "pending"), "blob")
    return scratch.save(scan(todo, scratch, rules))


def path_findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans): the ledger's findings of the current rules for each row of `versions`, repeated rows and rows
    without a doc_id among them; null texts are empty, and a blob that the ledger doesn't have has no findings. Empty table:
    an empty result."""
    scratch = Scratch(versions.sparkSession, "findings")
    kinds = [r.kind for r in rules]
    current = ledger.where(F.size("spans") > 0).select("blob", F.filter("spans", lambda x: x["kind"].isin(kinds)).alias("spans"))
    by_blob = scratch.save(current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).where(F.size("spans") > 0))
    paths = versions.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of(F.col("text")).alias("blob"))
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans), a row for each row of `docs`; of `docs` only doc_id and text are read.

    spans: kind:start:end by start, then by the rules' order, comma-joined, in code points with end exclusive; it is empty
    without findings and for null and empty texts, and base_sha256 is the hash of it (no kinds beyond the base ones are
    added). Rows without doc_id and repeated rows are paths as any other. Empty table: an empty result.
    """
    added = update_ledger(docs, ledger, rules)
    both = added if ledger is None else ledger.select("blob", "rules", "spans").unionByName(added)
    found = path_findings(docs, both, rules)
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in rules], F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


MASK = "[secret]"


def masked(text: Column, stretches: Column) -> Column:
    """The text with each stretch (byte_start, byte_end), in order and apart, replaced by MASK."""

    def pieces(raw: Column) -> Column:
        before = lambda k: F.coalesce(F.get(stretches, k - 1)["byte_end"], F.lit(0)).cast("int")
        kept = lambda start, size: F.substring(raw, start + 1, size).cast("string")
        head = F.transform(stretches, lambda x, k: F.concat(kept(before(k), x["byte_start"].cast("int") - before(k)), F.lit(MASK)))
        return F.concat(F.array_join(head, ""), kept(before(F.size(stretches)), F.octet_length(raw)))

    return let(text.cast("binary"), pieces)


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs`, with all rows and columns, secrets in `text` replaced by MASK, a run of overlapping ones by one; n_chars, if
    it is a column, follows the new text where it changed. The stretches are joined to the texts by blob; only blobs with
    findings are on that side, and it is sent whole if there are few.

    Null texts stay null, texts without secrets stay as they are, repeated rows and rows without a doc_id are rows as any
    others, and other columns may have any name. Empty table: an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mask")
    ledger = update_ledger(docs, None, rules)
    blob, stretches, new = (free_name(docs, c) for c in ("blob", "stretches", "masked"))
    spans = ledger.select("blob", F.inline("spans"))
    reach = F.max("byte_end").over(Window.partitionBy("blob").orderBy("byte_start", "rank").rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.select("blob", "byte_start", "byte_end", "rank", (F.col("byte_start") >= F.coalesce(reach, F.lit(0))).cast("int").alias("opens"))
    runs = opens.withColumn("run", F.sum("opens").over(Window.partitionBy("blob").orderBy("byte_start", "rank")))
    merged = runs.groupBy("blob", "run").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"))
    lists = merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("byte_start", "byte_end"))).alias("stretches"))
    found = scratch.save(lists.select(F.col("blob").alias(blob), F.col("stretches").alias(stretches)))
    few = found.count() <= BROADCAST_IDS // 20 and (found.agg(F.sum(F.size(stretches))).first()[0] or 0) <= BROADCAST_IDS
    joined = docs.join(F.broadcast(found) if few else found, blob_of(F.col("text")) == F.col(blob), "left")
    joined = joined.withColumn(new, F.when(F.col(stretches).isNotNull(), masked(F.col("text").cast("string"), F.col(stretches))))
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(F.coalesce(new, "text").alias(name))
        elif name == "n_chars":
            out.append(F.coalesce(F.char_length(new).cast(docs.schema[name].dataType), F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, 0 AS rank, 'assign' AS kind, string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v, 6 AS least FROM d
  UNION ALL SELECT r, 1, 'access', string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), 20 FROM d
  UNION ALL SELECT r, 2, 'hex', string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0), 24 FROM d),
p AS (SELECT r, rank, kind, least, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g FROM m),
q AS (SELECT r, rank, kind, least, v, sum(length(g) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS e, length(m) AS n FROM p),
s AS (SELECT r, rank, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM q WHERE length(v) >= least),
t AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (r)
"""
