"""Mixing sources to target weights (op1), with Spark expressions alone.

Each source gets a mean repetition rate: its target share of the output's
characters over its share of the corpus. A document's number of copies is a
Poisson variable with that mean, found by inverting the distribution function
at a hash of its identity, so it depends on nothing but the seed, the document
and the rate. Documents are exploded by their counts and shuffled globally by a
hash of document and copy. A mean above ``MOST_MEAN`` is split into equal parts
with a hash each; the sum of Poisson variables is one again.

Cases: a null source is a source of its own; a null text is empty; a document
without doc_id is identified by its text; equal documents get equal counts; a
source without any characters keeps the mean 1; sources without a weight get
none; an empty table gives an empty one. Extra columns are carried; an input
column named ``copy_no`` is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimhound.llm.staging import staged, table

MOST_MEAN = 16
#: The distribution function of a mean of 16 is 1 to double precision long before.
TERMS = 80
SALTS = 32
#: Key of rows without a source.
NO_SOURCE = "\x01"


def source_rates(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    temperature: float = 0.5,
    budget: float = 1.0,
) -> DataFrame:
    """Per source: key, mean (of each part), parts.

    ``weights``: target weights by source; without them a source weighs its
    characters to the power of ``temperature``. ``budget``: characters of the
    output over those of the input.
    """
    chars = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    mass = docs.groupBy(_key().alias("mix_key")).agg(F.sum(chars.cast("long")).alias("chars"))
    if weights is None:
        root = F.sqrt("chars") if temperature == 0.5 else F.pow("chars", F.lit(temperature))
        weight = root.cast("double")
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            known = F.lit(NO_SOURCE if source is None else source)
            weight = F.when(F.col("mix_key") == known, F.lit(float(w))).otherwise(weight)
    mass = mass.withColumn("weight", weight)
    whole = mass.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weights"))
    mass = mass.join(F.broadcast(whole))  # one row
    share = F.col("weight") / F.nullif(F.col("all_weights"), F.lit(0.0))
    rate = F.when(
        F.col("chars") > 0,
        F.coalesce(share * F.lit(budget) * F.col("all_chars") / F.col("chars"), F.lit(0.0)),
    ).otherwise(F.lit(1.0))
    parts = F.greatest(F.lit(1), F.ceil(rate / F.lit(float(MOST_MEAN)))).cast("long")
    return mass.select("mix_key", rate.alias("rate"), parts.alias("parts")).select(
        "mix_key", (F.col("rate") / F.col("parts")).alias("mean"), "parts"
    )


def _key() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k from 0, as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("sums"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(
            p.alias("p"),
            F.concat(a["sums"], F.array(F.element_at(a["sums"], -1) + p)).alias("sums"),
        )

    terms = F.sequence(F.lit(1), F.lit(TERMS))
    return F.aggregate(terms, start, step, lambda a: a["sums"])


def _identity() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text)))


def _unit(*what: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat_ws("|", *what)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    temperature: float = 0.5,
    budget: float = 1.0,
    seed: int = 42,
    number_copies: bool = True,
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) repeated to the target weights.

    ``number_copies``: add ``copy_no``, from 1.

    The table of rates is written first, so Spark broadcasts it only if its
    true size allows that; beyond, the join is dealt by source and salt, which
    splits a source that holds much of the corpus.
    """
    columns = [c for c in docs.columns if not (number_copies and c == "copy_no")]
    rates = source_rates(docs, weights, temperature=temperature, budget=budget)
    rates = rates.withColumn("sums", _distribution(F.col("mean")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rates = staged(rates, "mix-rates").select("mix_key", "parts", "sums", salts.alias("mix_salt"))
    seeded, identity = F.lit(str(seed)), F.col("mix_id")
    counts = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.size(
            F.filter("sums", lambda c: c <= _unit(seeded, identity, j.cast("string")))
        ),
    )
    copies = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("mix_row")  # no name can clash
    marked = docs.select(
        row,
        _key().alias("mix_key"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("mix_salt"),
        _identity().alias("mix_id"),
    )
    mixed = (
        marked.join(rates, ["mix_key", "mix_salt"])
        .withColumn("mix_n", copies)
        .where("mix_n > 0")
        .select("mix_row", "mix_id", F.explode(F.sequence(F.lit(1), "mix_n")).alias("copy_no"))
        .withColumn(
            "mix_order",
            F.md5(F.concat_ws("|", seeded, F.lit("copy"), "mix_id", F.col("copy_no").cast("string"))),
        )
    )
    dealt = mixed.repartition("mix_order").sortWithinPartitions("mix_order")
    return dealt.select("mix_row.*", *(["copy_no"] if number_copies else []))


def op1_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


#: Recomputes rates, distribution and hashes with a recursive query.
OP1_SQL = """
WITH RECURSIVE mass AS (
  SELECT coalesce(source, chr(1)) AS s, sum(length(coalesce(text, '')))::BIGINT AS c
  FROM documents GROUP BY 1
), rates AS (
  SELECT s, CASE WHEN c > 0 THEN sqrt(c) / sum(sqrt(c)) OVER () * sum(c) OVER () / c ELSE 1.0 END
    AS rate FROM mass
), parts AS (
  SELECT s, greatest(1, ceil(rate / 16.0))::BIGINT AS n, rate / greatest(1, ceil(rate / 16.0)) AS m
  FROM rates
), dist AS (
  SELECT s, n, m, 0 AS k, exp(-m) AS p, exp(-m) AS upto FROM parts
  UNION ALL
  SELECT s, n, m, k + 1, p * m / (k + 1), upto + p * m / (k + 1) FROM dist WHERE k < 80
), drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, coalesce(d.source, chr(1)) AS s,
    ('0x' || substr(md5('42|' || coalesce(d.doc_id::VARCHAR, 'text:' || md5(coalesce(d.text, '')))
      || '|' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN parts ON parts.s = coalesce(d.source, chr(1)),
    unnest(range(parts.n)) AS r(j)
), counted AS (
  SELECT doc_id, text, lang, drawn.source, n_chars,
    count(*) FILTER (WHERE dist.upto <= drawn.u) AS copies
  FROM drawn JOIN dist ON dist.s = drawn.s GROUP BY 1, 2, 3, 4, 5
)
SELECT doc_id, text, lang, source, n_chars, r.k::INTEGER AS copy_no
FROM counted, unnest(range(1, copies + 1)) AS r(k)
"""
