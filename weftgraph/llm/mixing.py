"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.bitmaps import split
from weftgraph.operators.skew import join_facts
from weftgraph.session import stash

#: Copies of one equal row that one task makes.
BLOCK = 1000
#: Bits of the uniform number; a Poisson tail below 2 ** -52 can't be drawn.
UNIFORM_BITS = 52


def target_rates(documents: DataFrame, by: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None) -> DataFrame:
    """(_mx_key, _mx_n, _mx_rate): how often a document of each source should appear on average.

    A source's share of the mix is its entry in ``weights`` over their sum (sources not named get none), or, without
    weights, its row count to the power ``alpha`` over the sum of these. The rate is ``total`` rows (the input's
    number, if not given) times the share, over the source's row count. A null source is a source of its own, key ''
    with a mark; counts are combined before the shuffle, so a hot source is one row for each task.
    """
    counts = documents.groupBy(_key(by).alias("_mx_key")).agg(F.count(F.lit(1)).alias("_mx_n"))
    if weights is None:
        weight = F.sqrt(F.col("_mx_n").cast("double")) if alpha == 0.5 else F.pow(F.col("_mx_n").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("_mx_key") == F.lit("-" if name is None else f"+{name}"), F.lit(float(value))).otherwise(weight)
    counts = stash(counts.withColumn("_mx_weight", weight))
    sums = counts.agg(F.sum("_mx_n"), F.sum("_mx_weight")).first()
    n_all, w_all = (sums[0] or 0), (sums[1] or 0.0)
    rows = n_all if total is None else total
    rate = F.lit(float(rows)) * (F.col("_mx_weight") / F.lit(w_all)) / F.col("_mx_n") if w_all > 0 else F.lit(0.0)
    return counts.select("_mx_key", "_mx_n", rate.alias("_mx_rate"))


def _key(by: str):
    """Never null, and a null source differs from an empty one."""
    return F.coalesce(F.concat(F.lit("+"), F.col(by).cast("string")), F.lit("-"))


def _digits(text, digits: int = UNIFORM_BITS // 4):
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


#: Cumulative sums that are asked one by one before all the others are counted.
_FIRST = 8


def poisson_sums(rate):
    """Array of P(X <= k) for k from 0, X Poisson with mean ``rate``; summed upwards term by term.

    It stops where a uniform number of UNIFORM_BITS bits can't reach. Means over 500 would lose exp(-rate) to rounding;
    they are kept exact by drawing only the part over a whole number of copies: see replicate().
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums"))

    def step(acc, k):
        term = acc["term"] * rate / k
        return F.struct(term.alias("term"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["sums"]


def poisson_copies(sums, uniform):
    """The smallest k with sums[k] > uniform: how many sums are not over it. Most rows need only the first few."""
    copies = F.size(F.filter(sums, lambda x: x <= uniform))
    for k in reversed(range(_FIRST)):
        copies = F.when(uniform < F.get(sums, F.lit(k)), F.lit(k)).otherwise(copies)
    return copies


def _told_apart(packed: DataFrame) -> DataFrame:
    """``packed`` with ``_mx_seed``: the row's name (id and digest of the text) and its place among rows that are equal
    in every column, so that each draws a number of its own.

    A narrow count finds names that come twice; only their rows are shuffled, equal ones combined to one and a number
    before the shuffle, and made many again in blocks of BLOCK, so a row with a third of the table is no one task's."""
    seeded = lambda rows, place: rows.withColumn("_mx_seed", F.concat("_mx_name", F.lit(":"), place.cast("string")))
    twice = stash(packed.groupBy(F.xxhash64("_mx_name").alias("_mx_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_mx_h"))
    those, alone = split(packed, F.xxhash64("_mx_name"), twice)
    columns = [F.first(c).alias(c) for c in packed.columns if c != "_mx_name"]
    equal = those.groupBy("_mx_name", F.sha2(F.to_json("_mx_doc").cast("binary"), 256).alias("_mx_same")).agg(*columns, F.count(F.lit(1)).alias("_mx_many"))
    blocks = equal.withColumn("_mx_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mx_many") - 1) / BLOCK))))
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "_mx_name", "_mx_same", "_mx_block")
    place = F.explode(F.sequence(F.col("_mx_block") * BLOCK, F.least(F.col("_mx_many"), (F.col("_mx_block") + 1) * BLOCK) - 1))
    many = seeded(dealt.withColumn("_mx_place", place), F.col("_mx_place")).select(*packed.columns, "_mx_seed")
    return seeded(alone, F.lit(0)).unionByName(many)


def _mixed(documents: DataFrame, by: str, weights: dict[str, float] | None, alpha: float, total: int | None, seed: int, id_column: str, most_rate: float, text_column: str = "text") -> DataFrame:
    """_mx_doc (a document's columns in one, so that none can clash), _mx_copies, _mx_copy, _mx_order, _mx_rate.

    What a source's documents draw from, the sums, is made once for each source."""
    rates = target_rates(documents, by, weights, alpha, total)
    sure = F.floor(F.greatest(F.col("_mx_rate") - F.lit(most_rate), F.lit(0.0)))
    rates = rates.withColumn("_mx_sure", sure).withColumn("_mx_sums", poisson_sums(F.col("_mx_rate") - F.col("_mx_sure")))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")) if text_column in documents.columns else F.lit("")
    name = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    packed = documents.select(F.expr("struct(*)").alias("_mx_doc"), F.col(id_column).alias("_mx_id"), _key(by).alias("_mx_key"), name.alias("_mx_name"))
    uniform = _digits(F.concat(F.lit(f"{seed}:u:"), F.col("_mx_seed"))) / F.lit(float(2**UNIFORM_BITS))
    rated = join_facts(_told_apart(packed), stash(rates), "_mx_key", "_mx_n", "inner").withColumn("_mx_u", uniform)
    drawn = rated.withColumn("_mx_copies", F.col("_mx_sure").cast("int") + poisson_copies(F.col("_mx_sums"), F.col("_mx_u"))).drop("_mx_sums")
    copies = drawn.where("_mx_copies > 0").withColumn("_mx_copy", F.explode_outer(F.sequence(F.lit(0), F.col("_mx_copies") - 1)))
    keyed = copies.withColumn("_mx_order", _digits(F.concat(F.lit(f"{seed}:k:"), F.col("_mx_seed"), F.lit(":"), F.col("_mx_copy").cast("string"))))
    return _dealt(keyed, "_mx_order").sortWithinPartitions("_mx_order", "_mx_id", "_mx_copy")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Partition p of n gets keys from p / n of their range on. Keys are uniform, so even ranges need no sample, which
    would make all of the rows twice."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(parts, F.floor(F.col(key) * F.lit(parts) / F.lit(float(2**UNIFORM_BITS))).cast("int"))


def replicate(documents: DataFrame, by: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 0, id_column: str = "doc_id", most_rate: float = 500.0) -> DataFrame:
    """Each document as often as a Poisson number with its source's rate says, in one global random order.

    The number is drawn by inverting the distribution at a uniform number from md5(seed, id, text, place), so it depends
    on nothing but the seed, the row and the rate: documents with one id (or none) but other texts draw numbers of their
    own, and so do rows that are equal in every column, by their place among these. A rate over ``most_rate`` is split:
    floor(rate - most_rate) sure copies and a Poisson number for the rest. Copies are ordered by ``mix_key``, a 52-bit
    hash of the same and the copy number, and dealt out by its ranges, which are even whatever sources, ids and texts
    are; the id and then the copy number break ties. Tables without a column ``text`` go by their ids.

    Returns the columns of ``documents`` and n_copies, copy (from 0), mix_key, rate, which replace columns of these
    names. Sources may hold any share of the rows: the hot ones' rates are broadcast (at most 1000 rows), the others'
    joined. No rows, or no weight at all, give no rows.
    """
    own = {"n_copies": "_mx_copies", "copy": "_mx_copy", "mix_key": "_mx_order", "rate": "_mx_rate"}
    rows = _mixed(documents, by, weights, alpha, total, seed, id_column, most_rate)
    kept = [F.col("_mx_doc").getField(c).alias(c) for c in documents.columns if c not in own]
    return rows.select(*kept, *[F.col(v).alias(k) for k, v in own.items()])


def mix_rows(documents: DataFrame, by: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 0, id_column: str = "doc_id", most_rate: float = 500.0) -> DataFrame:
    """As replicate, with the columns of ``documents`` alone, whatever they are called."""
    return _mixed(documents, by, weights, alpha, total, seed, id_column, most_rate).select("_mx_doc.*")


def mix_query(documents: DataFrame) -> DataFrame:
    """doc_id, source, n_copies, copy, mix_key, rate (6 digits) for the whole table; weights are counts to the power 0.5.

    The mixed documents, texts and all other columns, are written as rows of the shuffled copies; the columns above,
    which are what the SQL gives, are read from there and put in the same order again.
    """
    mixed = stash(replicate(documents))
    shown = mixed.select("doc_id", "source", "n_copies", "copy", "mix_key", F.round("rate", 6).alias("rate"))
    return _dealt(shown, "mix_key").sortWithinPartitions("mix_key", "doc_id", "copy")


MIX_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM documents GROUP BY source
), rates AS (
  SELECT source, CAST((SELECT sum(n) FROM counts) AS DOUBLE) * (w / (SELECT sum(w) FROM counts)) / n AS rate FROM counts
), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS below FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), below + term * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), drawn AS (
  SELECT doc_id, source, seed, CAST('0x' || substr(md5('0:u:' || seed), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' ||
    (row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1) AS seed FROM documents)
), numbered AS (
  SELECT d.doc_id, d.source, d.seed, r.rate,
    (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.below <= d.u) AS n_copies
  FROM drawn d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, source, CAST(n_copies AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5('0:k:' || seed || ':' || CAST(copy AS VARCHAR)), 1, 13) AS BIGINT) AS mix_key,
  round(rate, 6) AS rate
FROM (SELECT *, unnest(range(n_copies)) AS copy FROM numbered WHERE n_copies > 0)
"""
