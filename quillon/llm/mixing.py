"""Temperature mixing of sources to target weights, in DataFrame operations only.

Source token shares q are raised to an exponent a and normalised to weights.  Entropy falls
and the largest repetition falls as a goes from 0 (uniform) to 1 (proportional), so a is
bisected twice: to the largest one whose entropy reaches the target and to the smallest one
that respects the repetition limit; the limit wins.  One aggregation over the source totals
evaluates 63 inner points, which are six bisections.  Weights become token budgets, and each
budget is realised as epochs, every one a permutation of the source's blocks and of the
documents in a block: whole epochs first, then the blocks of one more permutation while
they fit, then documents of the next block while they fit.  Permutations are by md5 of the
epoch and the block or document, so they need no sort of the documents.

Without ``budget_tokens`` the budget is the least at which every source is read whole, so
mixing repeats small sources and loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: share of the largest possible entropy to reach; how often a source may be repeated
TARGET_ENTROPY, MAX_REPEATS = 0.97, 4.0
#: tokens of a block, at most so many blocks of a source
BLOCK_TOKENS, MAX_BLOCKS = 1 << 17, 4096
#: rows (source, block, epoch) of a plan that is broadcast; hex digits of a key that name its bin
BROADCAST_ROWS, BIN_DIGITS = 1 << 17, 3
SECTIONS, PASSES = 64, 6


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bucket(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def _grid(totals: DataFrame, low: float, high: float, grand: float):
    """(exponent, entropy, ratio of the largest to the smallest repetition) at the grid's points."""
    points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
    q = F.log(F.col("tokens") / F.lit(grand))
    cols = []
    for i, a in enumerate(points):
        cols += [F.sum(F.exp(a * q)).alias(f"z{i}"), F.sum(F.exp(a * q) * a * q).alias(f"h{i}")]
    r = totals.agg(*cols, F.min(q).alias("lo"), F.max(q).alias("hi")).first()
    return [(a, math.log(r[f"z{i}"]) - r[f"h{i}"] / r[f"z{i}"], math.exp((1 - a) * (r["hi"] - r["lo"]))) for i, a in enumerate(points)]


def exponent(totals: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for positive source totals (column tokens); 1 where there is at most one source."""
    r = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if r["n"] < 2:
        return 1.0
    goal, grand = target_entropy * math.log(r["n"]), float(r["t"])

    def search(ok_at_high, test):
        """Where ``test`` changes between 0 and 1; it holds towards 1 if ``ok_at_high``, else towards 0."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            grid = _grid(totals, low, high, grand)
            held = [test(x) for x in grid]
            if all(held):
                return (low if low > 0 else 0.0) if ok_at_high else high
            if not any(held):
                return high if ok_at_high else low
            k = held.index(True) if ok_at_high else held.index(False)
            low, high = grid[k - 1][0], grid[k][0]
        return high if ok_at_high else low

    by_entropy = search(False, lambda x: x[1] >= goal)
    by_repeats = search(True, lambda x: x[2] <= max_repeats)
    return max(by_entropy, by_repeats)


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return docs.withColumns({"_source": source, "_id": ident, "_tokens": n_tokens(F.col(text_col).cast("string"))})


def _block(blocks: Column) -> Column:
    return F.pmod(_bucket(F.col("_id")), blocks).cast("int")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    budget_tokens: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The columns of ``docs`` and n_tokens, weight, epoch, block, block_rank, doc_key: one row for each reading.

    Readings of a source are ordered by (epoch, block_rank, doc_key).  A null source is a
    source of its own.  Texts that are null or have no word take no budget and are read
    once.  Rows with the same id go together, in the same blocks and readings; a null id
    counts as one id.  An empty table gives an empty result.  Columns of ``docs`` with the
    names of the new ones are replaced.
    """
    sc = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("n_tokens", "weight", "epoch", "block", "block_rank", "doc_key")
    # positions, as the columns of docs may have any names
    columns, place = docs.columns, {c: f"c{i}" for i, c in enumerate(docs.columns)}
    docs, id_col, source_col, text_col = docs.toDF(*place.values()), place[id_col], place[source_col], place[text_col]
    own = [F.col(place[c]).alias(c) for c in columns]
    slim = sc.keep(_keyed(docs, id_col, source_col, text_col).select("_source", "_id", "_tokens"))
    totals = sc.keep(slim.groupBy("_source").agg(F.sum("_tokens").alias("tokens")).where("tokens > 0"))
    a = exponent(totals, target_entropy, max_repeats)
    share = totals.withColumn("p", F.pow(F.col("tokens").cast("double"), F.lit(a)))
    z = share.agg(F.sum("p").alias("z"), F.max(F.col("tokens") / F.col("p")).alias("most")).first()
    budget = budget_tokens if budget_tokens is not None else (z["z"] or 0.0) * (z["most"] or 0.0)
    sources = (
        share.withColumn("weight", F.col("p") / F.lit(z["z"] or 1.0))
        .withColumn("want", F.col("weight") * F.lit(float(budget)))
        .withColumn("full", F.floor(F.col("want") / F.col("tokens") + 1e-9).cast("int"))
        .withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("want") - F.col("full") * F.col("tokens") + 1e-6)))
        .withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / block_tokens)).cast("int"))
        .select("_source", "weight", "full", "rest", "blocks")
    )
    sources = sc.keep(sources)
    placed = slim.where("_tokens > 0").join(sources, "_source").withColumn("block", _block(F.col("blocks")))

    # ranks and running sums of at most MAX_BLOCKS blocks of a source, for each of its epochs
    blocks = placed.groupBy("_source", "block", "full", "rest").agg(F.sum("_tokens").alias("size"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
    key = F.md5(F.concat_ws("|", F.lit("block"), "_source", F.col("epoch").cast("string"), F.col("block").cast("string")).cast("binary"))
    order = Window.partitionBy("_source", "epoch").orderBy("key", "block")
    blocks = blocks.withColumn("key", key).withColumn("block_rank", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order))
    blocks = blocks.withColumn("left", F.col("rest") - (F.col("upto") - F.col("size")))
    state = F.when(F.col("epoch") < F.col("full"), "all").when(F.col("left") >= F.col("size"), "all").when(F.col("left") > 0, "some")
    blocks = sc.keep(blocks.withColumn("state", state).where("state is not null").select("_source", "block", "epoch", "block_rank", "state", "left"))

    # the documents of a source's one unfinished block, in the order of their keys: sums by the first digits of
    # the key find the bin where the rest runs out, so that no task orders a whole block
    doc_key = F.md5(F.concat_ws("|", F.lit("doc"), "_id", F.col("epoch").cast("string")).cast("binary"))
    some = blocks.where("state = 'some'").select("_source", "block", "epoch", "left")
    bin_ = F.substring("doc_key", 1, BIN_DIGITS).alias("bin")
    cut = placed.select("_source", "_id", "_tokens", "block").join(some, ["_source", "block"]).withColumn("doc_key", doc_key)
    cut = sc.keep(cut.select("_source", bin_, "doc_key", "_tokens", "left"))
    bins = cut.groupBy("_source", "bin", "left").agg(F.sum("_tokens").alias("size"), F.max("doc_key").alias("last"))
    bins = bins.withColumn("upto", F.sum("size").over(Window.partitionBy("_source").orderBy("bin"))).withColumn("before", F.col("upto") - F.col("size"))
    bins = sc.keep(bins.where("before <= left"))
    torn = cut.join(bins.where("upto > left").select("_source", "bin", "before"), ["_source", "bin"])
    torn = torn.withColumn("upto", F.col("before") + F.sum("_tokens").over(Window.partitionBy("_source").orderBy("doc_key"))).where("upto <= left")
    ends = bins.where("upto <= left").select("_source", "last").union(torn.select("_source", "doc_key"))
    cut = ends.groupBy("_source").agg(F.max("last").alias("cut"))

    plan = sc.keep(blocks.drop("left").join(cut, "_source", "left").join(sources.select("_source", "weight"), "_source"))
    # the plan is broadcast only while it is small, so that whole texts stay where they are
    small = plan.count() <= BROADCAST_ROWS
    sizes = sources.select("_source", "blocks")
    sizes, plan = (F.broadcast(sizes), F.broadcast(plan)) if small else (sizes, plan)
    told = _keyed(docs, id_col, source_col, text_col)
    names = [*own, F.col("_tokens").alias("n_tokens"), "weight", "epoch", "block", "block_rank", "doc_key"]
    read = told.where("_tokens > 0").join(sizes, "_source").withColumn("block", _block(F.col("blocks")))
    read = read.join(plan, ["_source", "block"]).withColumn("doc_key", doc_key)
    read = read.where("state = 'all' or doc_key <= cut").select(*names)
    empty = told.where("_tokens = 0").select(
        *own, F.col("_tokens").alias("n_tokens"), F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"), F.lit(0).alias("block"),
        F.lit(0).alias("block_rank"), F.md5(F.concat(F.lit("doc|"), "_id", F.lit("|0")).cast("binary")).alias("doc_key"),
    )
    return read.union(empty)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The readings of ``documents`` at the target weights, without the texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "epoch", "block", "block_rank", "doc_key")


OP2_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM documents),
t AS (SELECT skey, sum(n)::DOUBLE AS tokens FROM d GROUP BY skey HAVING sum(n) > 0),
g AS (SELECT count(*) AS s, sum(tokens) AS grand, max(tokens) AS big, min(tokens) AS small FROM t),
be(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT be.*, (SELECT ln(sum(pow(tokens / g.grand, (be.lo + be.hi) / 2)))
      - sum(pow(tokens / g.grand, (be.lo + be.hi) / 2) * (be.lo + be.hi) / 2 * ln(tokens / g.grand)) / sum(pow(tokens / g.grand, (be.lo + be.hi) / 2))
      >= {TARGET_ENTROPY} * ln(any_value(g.s)) FROM t, g) AS ok FROM be WHERE i < 50)),
a AS (SELECT CASE WHEN s < 2 THEN 1.0 ELSE greatest(
    (SELECT CASE WHEN hi > 1 - 1e-12 THEN 1.0 ELSE lo END FROM be WHERE i = 50),
    CASE WHEN big / small <= {MAX_REPEATS} THEN 0.0 ELSE 1 - ln({MAX_REPEATS}) / ln(big / small) END) END AS a FROM g),
p AS (SELECT skey, tokens, pow(tokens, a) AS p FROM t, a),
z AS (SELECT sum(p) AS z, max(tokens / p) AS most FROM p),
w AS (SELECT skey, tokens, p / z AS weight, p / z * (z * most) AS want FROM p, z),
s AS (SELECT *, CAST(floor(want / tokens + 1e-9) AS INTEGER) AS f, CAST(least({MAX_BLOCKS}, ceil(tokens / {BLOCK_TOKENS})) AS INTEGER) AS blocks FROM w),
r AS (SELECT *, greatest(0, floor(want - f * tokens + 1e-6)) AS rest FROM s),
x AS (SELECT d.*, r.weight, r.f, r.rest, CAST(('0x' || substr(md5(ident), 1, 8))::BIGINT % blocks AS INTEGER) AS block FROM d JOIN r USING (skey) WHERE n > 0),
b AS (SELECT skey, block, f, rest, sum(n) AS size FROM x GROUP BY ALL),
e AS (SELECT b.*, epoch, row_number() OVER o AS block_rank, sum(size) OVER o AS upto
  FROM (SELECT b.*, unnest(generate_series(0, f)) AS epoch FROM b) b
  WINDOW o AS (PARTITION BY skey, epoch ORDER BY md5('block|' || skey || '|' || epoch || '|' || block), block)),
k AS (SELECT *, rest - (upto - size) AS room FROM e),
o AS (SELECT x.doc_id, x.source, x.skey, x.n, x.weight, k.epoch, x.block, k.block_rank, md5('doc|' || ident || '|' || k.epoch) AS doc_key,
    (k.epoch < k.f OR k.room >= k.size) AS whole, k.room
  FROM x JOIN k ON x.skey = k.skey AND x.block = k.block WHERE k.epoch < k.f OR k.room > 0),
c AS (SELECT *, sum(CASE WHEN whole THEN 0 ELSE n END) OVER (PARTITION BY skey, epoch, block ORDER BY doc_key) AS upto FROM o)
SELECT doc_id, source, n AS n_tokens, round(weight, 9) AS weight, epoch, block, block_rank, doc_key FROM c WHERE whole OR upto <= room
UNION ALL
SELECT doc_id, source, n, 0.0, 0, 0, 0, md5('doc|' || ident || '|0') FROM d WHERE n = 0
"""
