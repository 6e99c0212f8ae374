"""Mixing sources to target weights, in DataFrame and SQL functions only.

A *block* is one copy of one document; every document has ``MOST_COPIES`` of
them, so no document exceeds that many times its size. The steps:

1. Targets. Sources ordered by code point (null last) weigh 5, 2, 1, 5, 2, ...
   and share ``TOTAL_RATIO`` times all words. A target stops at
   ``MOST_COPIES`` times its source's words; the excess is shared again by
   weight until none is above.
2. Exact block quotas. A source's blocks are permuted (all first copies, then
   all second ones, each by a seeded hash) and counted off until their words
   reach the target; the last block is cut there, so the words taken are the
   target rounded down.
3. Splitting tree. The quotas of all sources are halved again and again, down
   to the output shards: how many blocks of each source go left is drawn from
   the multivariate hypergeometric distribution, so every shard is a fair
   sample and the quotas stay exact.
4. A shard's share of a source is a run of that source's permuted blocks,
   disjoint from the other shards' runs. Inside a shard, blocks are ordered by
   another hash.

Ranks within a source are salted prefix sums (a source may hold a third of all
rows). Reruns agree: every draw is a hash of the seed.

The drawn blocks are written in their shards' order, a folder per shard, and
what the mix takes is summed from the shards as they are read back.

Defined results: null or empty text has no words, is never drawn and gets
``taken`` 0; a null source is a source of its own; rows with the same doc_id
stand side by side in the permutation, rows with a null one are placed by a row
number, so they spread; other columns stay untouched, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadflow.llm.common import free_name, materialize, prefix_sums, prepare, salts, scratch_path, table

WEIGHTS = (5, 2, 1)
TOTAL_RATIO = 1.5
MOST_COPIES = 2
SHARDS = 16
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   ratio: float = TOTAL_RATIO, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    The level at which shares settle is found by passes over the table of
    sources; each pass brings back three numbers. A pass caps at least one more
    source or ends, and in practice a handful suffice.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source here, not one per document
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = materialize(per.select("source", "source_size", weight.alias("weight")), "mix-sources")
    level = 0.0
    cap = F.col("source_size") * F.lit(float(most))
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        row = per.agg(F.sum("source_size").alias("all"),
                      F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("capped"),
                      F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("free")).first()
        if not row["all"] or not row["free"]:
            break
        found = (ratio * row["all"] - float(most) * row["capped"]) / row["free"]
        if found <= level:
            break
        level = found
    return per.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A draw from (0, 1) that depends on the parts only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column, v: Column | None = None) -> Column:
    """How many of ``draws`` blocks out of ``total`` are among the ``good`` ones.

    By inversion of the distribution within ten deviations of its mean, from the
    uniform draw ``u``; ``v`` is not used any more.
    """

    def moments(p: Column) -> Column:
        n, k, d = p["n"], p["k"], p["d"]
        mean = F.when(n > 0, d * k / n).otherwise(0.0)
        var = F.when(n > 1, d * (k / n) * (1 - k / n) * (n - d) / (n - 1)).otherwise(0.0)
        return _let(F.struct(n.alias("n"), k.alias("k"), d.alias("d"), mean.alias("mean"), var.alias("var"),
                             F.greatest(F.lit(0.0), d - (n - k)).alias("low"), F.least(d, k).alias("high")), pick)

    def pick(p: Column) -> Column:
        return F.when(p["low"] >= p["high"], p["low"].cast("long")).otherwise(inverted(p))

    def inverted(p: Column) -> Column:
        reach = 10 * F.sqrt(p["var"]) + 5
        first = F.greatest(p["low"], F.floor(p["mean"] - reach).cast("double"))
        last = F.least(p["high"], F.ceil(p["mean"] + reach).cast("double"))

        def ratio(x: Column) -> Column:
            # the weight of x over that of x - 1
            return (p["k"] - x + 1) * (p["d"] - x + 1) / (x * (p["n"] - p["k"] - p["d"] + x))

        def walk(e: Column) -> Column:
            xs = F.sequence(e["first"].cast("long"), e["last"].cast("long"))

            def add(a: Column, x: Column) -> Column:
                return _let(F.when(x == e["first"], F.lit(1.0)).otherwise(a["w"] * ratio(x)),
                            lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum")))

            zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"))
            goal = F.aggregate(xs, zero, add, lambda a: a["sum"]) * u

            def find(a: Column, x: Column) -> Column:
                return _let(F.when(x == e["first"], F.lit(1.0)).otherwise(a["w"] * ratio(x)),
                            lambda w: F.struct(w.alias("w"), (a["left"] - w).alias("left"),
                                               F.when(a["left"] > 0, x).otherwise(a["x"]).alias("x")))

            return F.aggregate(xs, F.struct(F.lit(0.0).alias("w"), goal.alias("left"), e["first"].cast("long").alias("x")),
                               find, lambda a: a["x"])

        return _let(F.struct(first.alias("first"), last.alias("last")), walk)

    return _let(F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"),
                         draws.cast("double").alias("d")), moments)


def split_quotas(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source, shard, quota) from (source, quota): the splitting tree.

    ``shards`` is a power of two. A node is the group of its sources' quotas;
    a level draws, source after source, how many of the node's blocks go left.
    Left and right differ by one block at most.
    """
    nodes = quotas.select(F.lit(0).alias("node"), "source", F.col("quota").cast("long").alias("quota"))
    level, width = 0, 1
    while width < shards:
        w = W.partitionBy("node")
        upto = w.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
        total = F.sum("quota").over(w)
        row = nodes.select("node", "source", "quota", total.alias("total"),
                           F.coalesce(F.sum("quota").over(upto), F.lit(0)).alias("before"))
        packed = row.groupBy("node", "total").agg(F.sort_array(F.collect_list(
            F.struct("before", "quota", F.col("source").isNull().alias("none"), "source"))).alias("all"))

        def draw(acc: Column, s: Column) -> Column:
            # given what went left before, what goes left of this source is hypergeometric
            left = hypergeometric(acc["total"] - s["before"], s["quota"], acc["half"] - acc["gone"],
                                  _uniform(F.lit(level), acc["node"], s["before"], s["source"], F.lit("u")))
            return _let(left, lambda got: F.struct(
                acc["total"].alias("total"), acc["half"].alias("half"), acc["node"].alias("node"),
                (acc["gone"] + got).alias("gone"),
                F.concat(acc["out"], F.array(F.struct(s["source"].alias("source"), s["quota"].alias("quota"),
                                                      got.alias("left")))).alias("out")))

        kind = dict(nodes.dtypes)["source"]
        empty = F.array().cast(f"array<struct<source:{kind},quota:bigint,left:bigint>>")
        half = F.floor((F.col("total") + 1) / 2)
        start = F.struct("total", half.alias("half"), F.col("node"), F.lit(0).cast("long").alias("gone"),
                         empty.alias("out"))
        drawn = packed.select("node", F.explode(F.aggregate("all", start, draw, lambda a: a["out"])).alias("s"))
        nodes = materialize(drawn.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("s.source").alias("source"), F.col("s.left").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.col("s.source").alias("source"),
                     (F.col("s.quota") - F.col("s.left")).alias("quota")))).alias("n")).select("n.*"), "mix-nodes")
        level, width = level + 1, width * 2
    return nodes.withColumnRenamed("node", "shard")


def draw_blocks(sizes: DataFrame, targets: DataFrame, shards: int = SHARDS,
                most: int = MOST_COPIES) -> DataFrame:
    """The blocks of the mix from rows of (row_id, doc_id, source, size):
    adds copy (from 0), words taken of it, shard and place_key, the order
    inside the shard."""
    blocks = (sizes.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
              .withColumn("key", F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), "row_id")), "copy"))))
    n = salts(sizes.count())
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * n).cast("int")
    blocks = blocks.withColumn("bucket", F.col("copy") * n + part)
    ranked = prefix_sums(blocks, "source", "bucket", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("row_id")],
                         {"rank": F.lit(1), "words_before": F.col("size")})
    # the targets meet the blocks on the partitioning that the ranks have already
    per_bucket = (blocks.select("source", "bucket").distinct()
                  .join(targets.select(F.col("source").alias("_source"), "target"),
                        F.col("source").eqNullSafe(F.col("_source")))
                  .select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "target"))
    due = F.floor(F.col("target")).cast("long")
    chosen = (ranked.join(per_bucket, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
              .filter(F.col("words_before") < due)
              .select("row_id", "doc_id", "source", "size", "copy", "key", "bucket", "rank",
                      F.least(F.col("size"), due - F.col("words_before")).alias("words")))
    chosen = materialize(chosen, "mix-blocks")
    quotas = chosen.groupBy("source").agg(F.count("*").alias("quota"))
    tree = split_quotas(quotas, shards)
    # one row per source: where each shard's run of permuted ranks ends
    ends = (tree.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("q"))
            .select(F.col("source").alias("_source"),
                    F.transform(F.sequence(F.lit(1), F.size("q")), lambda i: F.aggregate(
                        F.slice("q", F.lit(1), i), F.lit(0).cast("long"), lambda a, s: a + s["quota"])).alias("ends")))
    ends = (chosen.select(F.col("source").alias("_s"), F.col("bucket").alias("_b")).distinct()
            .join(ends, F.col("_s").eqNullSafe(F.col("_source"))).select("_s", "_b", "ends"))
    drawn = chosen.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    shard = F.aggregate("ends", F.lit(0), lambda a, e: a + F.when(F.col("rank") >= e, 1).otherwise(0))
    return (drawn.withColumn("shard", shard).filter(F.col("shard") < F.size("ends"))
            .select("row_id", "doc_id", "source", "size", "copy", "words", "shard",
                    F.xxhash64(F.lit(SEED), "shard", "key").alias("place_key")))


def sized(docs: DataFrame) -> DataFrame:
    """Stored (row_id, doc_id, source, size) of all documents."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source",
                                   word_count(F.col("text")).alias("size")), "mix-sizes")


def mixed_sizes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    sizes = sized(docs)
    targets = source_targets(sizes)
    drawn = stored_shards(draw_blocks(sizes, targets)).groupBy("row_id").agg(F.sum("words").alias("taken"))
    # the few source rows are salted like the documents they join
    n = salts(sizes.count())
    spread = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    salted = sizes.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int"))
    t = spread.select(F.col("source").alias("_source"), F.col("_salt").alias("_t"), "source_size", "target")
    return (salted.join(drawn, "row_id", "left")
            .join(t, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_t")))
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: one row per drawn block, with the columns of ``docs``;
    a cut block has its text's first words only. Adds nothing: shards and
    places are for ``write_shards``. Words are counted once, as the rows are stored."""
    keep = docs.columns
    row, size, words = (free_name(docs, n) for n in ("_mix_row", "_mix_size", "_mix_words"))
    docs = materialize(docs.withColumns({row: F.monotonically_increasing_id(), size: word_count(F.col("text"))}), "mix-docs")
    sizes = docs.select(F.col(row).alias("row_id"), "doc_id", "source", F.col(size).alias("size"))
    drawn = stored_shards(draw_blocks(sizes, source_targets(sizes), shards)).select(F.col("row_id").alias(row), F.col("words").alias(words))
    # a word and the white space before it, so the first ones joined are a prefix of the text
    each = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(each, F.lit(1), F.col(words).cast("int")), "")
    short = F.col(words) < F.col(size)
    out = docs.join(drawn, row).withColumn("text", F.when(short, cut).otherwise(F.col("text")))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(short, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*keep)


def write_shards(blocks: DataFrame, path: str) -> None:
    """Writes drawn blocks in their shards' order, a folder per shard."""
    (blocks.repartitionByRange("shard", "place_key").sortWithinPartitions("shard", "place_key")
     .write.partitionBy("shard").parquet(path))


def stored_shards(blocks: DataFrame) -> DataFrame:
    """The blocks as read back from their shards."""
    path = scratch_path(blocks.sparkSession, "mix-shards")
    write_shards(blocks, path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(prepare(spark), table(spark, sf_dir, "documents"))


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
         ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
            WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight::DOUBLE, source
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, source
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
            row_number() OVER (ORDER BY source_size / weight::DOUBLE, source) AS place FROM weighed),
chosen AS (
  SELECT coalesce(arg_min(level, place) FILTER (WHERE weight * level < 2.0 * source_size), 0) AS level FROM levels),
targets AS (
  SELECT w.source, w.source_size, least(w.weight * c.level, 2.0::DOUBLE * w.source_size) AS target
  FROM weighed w, chosen c),
blocks AS (
  SELECT doc_id, source, size, c.copy, md5('mix-1|' || doc_id || '|' || c.copy) AS key
  FROM sized, (VALUES (0), (1)) c(copy) WHERE size > 0),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY copy, key
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks),
taken AS (
  SELECT doc_id, sum(least(p.size, floor(t.target)::BIGINT - before))::BIGINT AS taken
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
  WHERE before < floor(t.target) GROUP BY doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k USING (doc_id)
"""
