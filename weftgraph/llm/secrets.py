"""Secrets in texts, and who owns them: spans by pattern, then corpus-wide ownership. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.bitmaps import split
from weftgraph.operators.skew import join_facts
from weftgraph.session import stash

#: The base patterns, in order: kind, pattern, the group that is measured and its least length. Fixed values.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Further candidates, which count only if they are owner-specific: long runs with all three sorts of characters.
OPAQUE = ("opaque", r"[A-Za-z0-9_-]+", 0, 32)
#: Matches of one text that are folded at a time.
RUN = 128
#: A candidate in texts of more owners than this is a copied example.
MOST_OWNERS = 3
_FAST = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}", "opaque": r"[A-Za-z0-9_-]{32}", "assign": r"(?i)(password|passwd|secret|token|api_?key)"}


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, kind, secret) of the leftmost matches that do not overlap and whose group is long enough.

    The pieces between matches and the matches themselves give all positions: a match starts after as many code points
    as the pieces and matches before it have. Offsets are summed in one pass over both arrays.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern), lambda x: F.char_length(x))
    rows = F.arrays_zip(found.alias("match"), secrets.alias("secret"), gaps.alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,secret:string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["gap"]
        end = start + F.coalesce(F.char_length(row["match"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), row["secret"].alias("secret"))
        keep = F.coalesce(F.char_length(row["secret"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    # runs of RUN matches are folded by themselves, then moved to where they begin: arrays that grow stay short
    def placed(runs: Column) -> Column:
        starts = F.aggregate(runs, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + run["at"])))
        moved = lambda run, at: F.transform(run["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["kind"].alias("kind"), s["secret"].alias("secret")))
        return F.flatten(F.zip_with(runs, F.slice(starts, 1, F.size(runs)), moved))

    every = _once(F.transform(_once(rows, _runs), lambda part: F.aggregate(part, first, step)), placed)
    return F.when(text.rlike(_FAST[kind]), every).otherwise(empty)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(rows: Column) -> Column:
    """An array cut into arrays of RUN elements; none of none."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda k: F.slice(rows, k * RUN + 1, RUN))
    return F.when(F.size(rows) > 0, cut).otherwise(F.slice(F.array(rows), 1, 0))


def _opaque(text: Column) -> Column:
    mixed = lambda s: s["secret"].rlike("[A-Z]") & s["secret"].rlike("[a-z]") & s["secret"].rlike("[0-9]")
    return F.filter(spans(text, *OPAQUE), mixed)


def _ordered(found: Column, kinds: tuple[str, ...]) -> Column:
    """By start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.lit(list(kinds)), s["kind"])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("c"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda s: s["span"])


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


_KINDS = tuple(k for k, *_ in BASE) + (OPAQUE[0],)


def scan(documents: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """Per row of documents(doc_id, text, source): doc_id, text_hash, base (spans), spans (base and added), live.

    Candidates are the base spans and opaque runs. For each candidate hash the distinct sources (repositories, each an
    owner) with it are counted over all texts. A candidate of few owners is ``live``, however often and in however many
    documents they repeat it; others are copied examples. Opaque runs count only when they are live and no base span
    overlaps them: these are the added spans. ``live`` lists the (start, end) of live spans.

    Counting is by (hash, source) first and then by hash, both combined before the shuffle, so a secret in a third of
    all documents is one row for each task; its fact is broadcast back. A null text is empty, a null source an owner of
    its own. Rows with the same id and text share their result; none is lost. Empty input gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(*[spans(F.col("_t"), *b) for b in BASE])
    rows = documents.select("doc_id", F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-")).alias("owner"), text.alias("_t"))
    rows = rows.select("doc_id", "owner", F.sha2(F.col("_t").cast("binary"), 256).alias("text_hash"), _ordered(base, _KINDS).alias("base"), _opaque(F.col("_t")).alias("opaque"))
    # base spans in runs with their ends, so that a run far from a candidate is passed over at once
    meets = lambda a, s: (a["start"] < s["end"]) & (s["start"] < a["end"])
    run = lambda part: F.struct(part[0]["start"].alias("start"), F.array_max(F.transform(part, lambda b: b["end"])).alias("end"), part.alias("part"))
    apart = lambda s: ~F.exists("_runs", lambda r: meets(r, s) & F.exists(r["part"], lambda b: meets(b, s)))
    hashed = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["secret"].cast("binary"), 256).alias("hash")))
    # what is stashed holds hashes, never a secret
    rows = rows.withColumn("_runs", F.transform(_once(F.col("base"), _runs), run)).withColumn("opaque", F.filter("opaque", apart)).drop("_runs")
    rows = stash(rows.withColumn("base", hashed(F.col("base"))).withColumn("opaque", hashed(F.col("opaque"))))
    some = rows.where((F.size("base") > 0) | (F.size("opaque") > 0))
    texts = some.groupBy("doc_id", "text_hash").agg(F.min("owner").alias("owner"), F.first("base").alias("base"), F.first("opaque").alias("opaque"))
    every = texts.select("doc_id", "text_hash", "owner", F.explode(F.concat("base", "opaque")).alias("s")).select("doc_id", "text_hash", "owner", "s.*")
    every = stash(every)
    # a source's documents first: distinct owners by hash are then plain counts
    owned = some.select("owner", F.explode(F.concat("base", "opaque")).alias("s")).groupBy(F.col("s.hash").alias("hash"), "owner").agg(F.count(F.lit(1)).alias("n"))
    # n, the spans with a hash, tells the join which hashes are hot; it decides nothing
    facts = owned.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("n"))
    rated = join_facts(every, stash(facts), "hash", "n", "inner")
    live = F.col("owners") <= most_owners
    counted = rated.where((F.col("kind") != OPAQUE[0]) | live).withColumn("live", live)
    span = F.struct("start", F.array_position(F.lit(list(_KINDS)), F.col("kind")).alias("rank"), "end", "kind", "live")
    whole = counted.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    whole = whole.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    out = rows.join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<struct<start:int,rank:bigint,end:int,kind:string,live:boolean>>")
    return out.select("doc_id", "text_hash", "base", F.coalesce("spans", none).alias("spans"))


def secret_query(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (spans that look owner-specific) per document."""
    found = scan(documents)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *[number(k) for k, *_ in BASE], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), live)


def redact(documents: DataFrame, live_mark: str = "[secret]", example_mark: str = "[example secret]") -> DataFrame:
    """``documents`` with every span replaced: live ones by one mark, copied examples by the other.

    Overlapping spans are one, live if any is. Texts without spans, and null texts, stay as they are and where they are:
    a bitmap of the texts with spans tells who needs the join. n_chars, where there is such a column, follows the new text.
    """
    own = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    found = scan(documents).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans").dropDuplicates(["_id", "_hash"])
    found = stash(_merged(stash(found)))
    those, clean = split(documents, own, found.select("_hash"))
    packed = those.select(F.expr("struct(*)").alias("_doc"), "doc_id", "text", own.alias("_own"))
    joined = packed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    mark = lambda s: F.when(s["live"], F.lit(live_mark)).otherwise(F.lit(example_mark))
    text = F.when(F.col("merged").isNotNull(), _replaced(F.col("text"), F.col("merged"), mark)).otherwise(F.col("text"))
    new = {"text": F.col("_new")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("merged").isNotNull(), F.char_length("_new").cast(kind)).otherwise(F.col("_doc").getField("n_chars"))
    return joined.withColumn("_new", text).select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in documents.columns]).unionByName(clean)


def _merged(found: DataFrame) -> DataFrame:
    """_id, _hash and merged: the text's sorted spans with overlapping ones made one, live if any is. Spans are told
    apart by a running end over a text's own, in rows, so a text with very many costs their number and no more."""
    order = Window.partitionBy("_id", "_hash").orderBy("_at")
    ends = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = found.select("_id", "_hash", F.posexplode("spans").alias("_at", "s")).select("_id", "_hash", "_at", "s.*")
    opened = each.withColumn("_opens", (ends.isNull() | (ends <= F.col("start"))).cast("int")).withColumn("_group", F.sum("_opens").over(order))
    one = opened.groupBy("_id", "_hash", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("live").alias("live"))
    return one.groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "live"))).alias("merged"))


def _replaced(text: Column, merged: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with each of the spans, which are sorted and apart, replaced by its mark.

    Runs of RUN spans are cut out of the text first and folded by themselves, so neither the text nor what is built is
    walked or copied once for each span."""
    end_before = lambda k: F.when(k > 0, F.get(merged, k - 1)["end"]).otherwise(F.lit(0))
    starts = F.transform(_runs(merged), lambda part, k: F.struct(part.alias("part"), end_before(k * RUN).alias("from")))

    def folded(run: Column) -> Column:
        upto = F.element_at(run["part"], -1)["end"]
        own = F.substring(text, run["from"] + 1, upto - run["from"])

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(acc["own"], acc["at"] - run["from"] + 1, s["start"] - acc["at"])
            return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, mark(s)).alias("out"), acc["own"].alias("own"))

        return F.aggregate(run["part"], F.struct(run["from"].alias("at"), F.lit("").alias("out"), own.alias("own")), step)["out"]

    last = F.coalesce(F.try_element_at(merged, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(starts, folded), ""), F.substring(text, last + 1, F.char_length(text)))


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    """(doc_id, source, rank, start_, end_, secret) of one kind: pieces between matches give the positions here too."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {_KINDS.index(kind)} AS rank, g AS start_, g + length(m) AS end_, s AS secret FROM (
    SELECT doc_id, source, m[i] AS m, s[i] AS s, list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS g FROM (
      SELECT doc_id, source, unnest(range(1, len(m) + 1)) AS i, m, s, p FROM (
        SELECT doc_id, source, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {group}) AS s, string_split_regex(t, '{quoted}') AS p FROM d) WHERE len(m) > 0))
  WHERE length(s) >= {least}"""


SECRET_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('+' || source, '-') AS source, coalesce(text, '') AS t FROM documents
), base AS ({" UNION ALL ".join(_sql_spans(*b) for b in BASE)}
), more AS (SELECT * FROM ({_sql_spans(*OPAQUE)}) o WHERE regexp_matches(secret, '[A-Z]') AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start_ < o.end_ AND o.start_ < b.end_)
), every AS (SELECT * FROM base UNION ALL SELECT * FROM more
), facts AS (SELECT secret, count(DISTINCT source) <= {MOST_OWNERS} AS live FROM every GROUP BY secret
), rated AS (SELECT *, ['{"', '".join(_KINDS)}'][rank + 1] || ':' || CAST(start_ AS BIGINT) || ':' || CAST(end_ AS BIGINT) AS shown FROM every JOIN facts USING (secret) WHERE rank < {len(BASE)} OR live
), folded AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {k}) AS n_{b[0]}" for k, b in enumerate(BASE))},
    coalesce(string_agg(shown, ',' ORDER BY start_, rank) FILTER (rank < {len(BASE)}), '') AS base, string_agg(shown, ',' ORDER BY start_, rank) AS spans, count(*) FILTER (live) AS n_live
  FROM rated GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{b[0]}, 0) AS n_{b[0]}" for b in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN folded USING (doc_id)
"""
