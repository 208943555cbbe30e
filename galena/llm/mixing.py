"""Mixing sources to target weights, in DataFrame operations only.

A source's share p of all tokens becomes the weight p**t / sum(p**t). The exponent t is bisected: the smallest
(the flattest mix) at which no source is repeated more than the limit allows and the entropy is not above its
target. Below t = 1 the least source is repeated most, above it the largest; the limit bounds both and wins over the
entropy: where natural shares are so even that t > 1 is asked for, t goes as far up as the limit allows. Without a limit the upper end is doubled
until the entropy fits, or until the largest sources alone have weight and it can fall no further. Weights times a token budget give each source its tokens; they are realised as blocks, each a new
permutation of the source: as many whole blocks as fit, then the beginning of one more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.session import fresh, written

GRID, PASSES = 32, 7
#: Beyond this logarithm of a ratio of weights the lesser one counts as nothing.
NOTHING = 60.0
#: A source table of up to so many rows goes to every executor; a longer one is joined by a shuffle.
MOST_BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of the text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _entropies(sources: DataFrame, points: list[float], most: float) -> list[float]:
    """The entropy of the mix at each exponent, in one pass over the sources."""
    # against the largest share, so that no power of it is too small for a number
    each = sources.select(F.log(F.col("share") / F.lit(most)).alias("l"), F.posexplode(F.array(*map(F.lit, points))).alias("i", "t"))
    power = F.exp(F.col("t") * F.col("l"))
    found = {i: math.log(z) - points[i] * s / z for i, z, s in each.groupBy("i").agg(F.sum(power), F.sum(power * F.col("l"))).collect()}
    return [found[i] for i in range(len(points))]


def temperature(sources: DataFrame, repeat_limit: float | None, entropy_share: float | None) -> float:
    """The exponent for sources (share double > 0). entropy_share: of the logarithm of the number of sources.

    The least one at which no source is repeated more than the limit allows and the entropy is not above its target. Above 1 the largest source is repeated
    (most / least)**(t - 1) times, so the limit bounds t from above; where the target lies beyond, that bound is what is reached.
    """
    n, least, most = sources.agg(F.count("*"), F.min("share"), F.max("share")).first()
    if not n or least == most:
        return 1.0
    target = math.inf if entropy_share is None else entropy_share * math.log(n)
    if repeat_limit is not None:
        high = 1 + max(0.0, math.log(repeat_limit)) / math.log(most / least)
    else:
        second = sources.where(F.col("share") < F.lit(most)).agg(F.max("share")).first()[0]
        end, high = NOTHING / math.log(most / second), 1.0
        while high < end and _entropies(sources, [high], most)[0] > target:
            high = min(end, 2 * high)
    low = 0.0
    for _ in range(PASSES):
        points = [low + (high - low) * i / GRID for i in range(1, GRID + 1)]
        entropy = _entropies(sources, points, most) if entropy_share is not None else [0.0] * GRID
        fits = [(repeat_limit is None or (most / least) ** (1 - t) <= repeat_limit) and h <= target for t, h in zip(points, entropy, strict=True)]
        at = fits.index(True) if True in fits else GRID - 1
        low, high = points[at] - (points[at] - low) / (at + 1), points[at]
    return high


def _slim(docs: DataFrame, id_col: str, source_col: str, text_col: str, tokens_col: str | None) -> DataFrame:
    tokens = F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(0)) if tokens_col else token_count(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), _key(source_col).alias("key"), tokens.alias("n_tokens"))


def _key(source_col: str) -> Column:
    """The source as text, null apart from every text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n"))


def _rank(seed: int, block: Column, doc: Column) -> Column:
    """What orders a block: a digest of the seed, the block and the id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def _budgets(slim: DataFrame, repeat_limit: float | None, entropy_share: float | None, budget: int | None) -> DataFrame:
    """(key, total, weight, blocks, rest): whole blocks of each source and the tokens of the block after."""
    sources = written(slim.groupBy("key").agg(F.sum("n_tokens").alias("total")), "sources")
    everything = sources.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shares = sources.where("total > 0").withColumn("share", F.col("total") / F.lit(float(max(1, everything))))
    t = temperature(shares, repeat_limit, entropy_share)
    raised = F.pow(F.col("share") / F.lit(shares.agg(F.max("share")).first()[0] or 1.0), F.lit(t))
    norm, widest = shares.agg(F.sum(raised), F.max(F.col("total") / raised)).first()
    if budget is None:  # the least at which every source has one whole block
        tokens = F.floor(raised * F.lit(widest or 0.0) + 0.5)
    else:
        tokens = F.floor(raised / F.lit(norm or 1.0) * F.lit(float(budget)) + 0.5)
    weighed = shares.select("key", "total", (raised / F.lit(norm or 1.0)).alias("weight"), tokens.cast("long").alias("tokens"))
    weighed = weighed.select("key", "total", "weight", F.floor(F.col("tokens") / F.col("total")).cast("int").alias("blocks"), (F.col("tokens") % F.col("total")).alias("rest"))
    empty = sources.where("total <= 0").select("key", "total", F.lit(0.0).alias("weight"), F.lit(1).alias("blocks"), F.lit(0).cast("long").alias("rest"))
    return written(weighed.unionByName(empty), "budgets")


def _onto(df: DataFrame, table: DataFrame) -> DataFrame:
    return df.join(F.broadcast(table) if table.count() <= MOST_BROADCAST_SOURCES else table, "key")


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens_col: str | None = None, repeat_limit: float | None = 2.0, entropy_share: float | None = 0.97, budget: int | None = None, seed: int = 11, rows_per_bucket: int = 20_000) -> DataFrame:
    """(doc_id, source, n_tokens, block, end_tokens): a row for each use of a document.

    block counts a source's permutations from 0; end_tokens is the tokens of its block up to and with the document
    in the block's order (equal ids stand together). Without a budget it is the least that gives every source
    one whole block, so each document is used once at least. A null source is a source like any other; a source
    without tokens is used once; a null text has no tokens and is used in every whole block. An empty table gives
    an empty one.

    A block is cut into buckets by the beginning of its order's digest; sums of buckets come first, so no sort
    holds more than one bucket, be one source a third of all rows.
    """
    slim = written(_slim(docs, id_col, source_col, text_col, tokens_col), "tokens")
    plan = _budgets(slim.select("key", "n_tokens"), repeat_limit, entropy_share, budget)
    digits = max(0, math.ceil(math.log(max(1, slim.count()) / rows_per_bucket, 16)))
    used = _onto(slim, plan).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks")))).where("block < blocks or rest > 0")
    used = used.withColumn("rank", _rank(seed, F.col("block"), F.col("doc_id"))).withColumn("bucket", F.substring("rank", 1, digits))
    sums = used.groupBy("key", "block", "bucket").agg(F.sum("n_tokens").alias("sum"))
    earlier = Window.partitionBy("key", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "block", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("key", "block", "bucket").orderBy("rank")
    placed = used.withColumn("end", F.sum("n_tokens").over(within)).join(starts, ["key", "block", "bucket"])
    placed = placed.withColumn("end_tokens", F.col("end") + F.col("start")).where("block < blocks or end_tokens <= rest")
    return placed.select("doc_id", "source", "n_tokens", "block", "end_tokens")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens_col: str | None = None, repeat_limit: float | None = 2.0, entropy_share: float | None = 0.97, budget: int | None = None, seed: int = 11) -> DataFrame:
    """docs with each row as often as mixture() uses it, and no other column.

    Only counts and one digest a source are computed from a narrow copy: a block's beginning is what does not
    come after the digest of its last document, so texts are never shuffled.
    """
    uses = mixture(docs, id_col, source_col, text_col, tokens_col, repeat_limit, entropy_share, budget, seed)
    # how often a whole source is used, and the last digest of the block that is cut
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key")
    last = uses.select(key, "block", _rank(seed, F.col("block"), F.col("doc_id")).alias("rank")).groupBy("key", "block").agg(F.max("rank").alias("rank"))
    table = written(last.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "rank"))).alias("cuts")), "cuts")
    at, cuts = fresh(docs, "key"), fresh(docs, "cuts")
    table = table.withColumnsRenamed({"key": at, "cuts": cuts})
    keyed = docs.withColumn(at, _key(source_col))
    joined = keyed.join(F.broadcast(table) if table.count() <= MOST_BROADCAST_SOURCES else table, at)
    mine = F.filter(F.col(cuts), lambda c: _rank(seed, c["block"], F.col(f"`{id_col}`")) <= c["rank"])
    return joined.withColumn(cuts, F.explode(mine)).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
    WITH RECURSIVE slim AS (
        SELECT doc_id, source, coalesce('s' || source, 'n') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
    ), sources AS (SELECT key, CAST(sum(n_tokens) AS BIGINT) AS total FROM slim GROUP BY key),
    shares AS (SELECT key, total, total / CAST((SELECT sum(total) FROM sources) AS DOUBLE) AS share FROM sources WHERE total > 0),
    list AS (SELECT list(share) AS ps, max(share) AS top, max(share) / min(share) AS widest, ln(count(*)) AS most FROM shares),
    bisect AS (
        SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CASE WHEN widest > 1 THEN 1 + ln(2.0) / ln(widest) ELSE 1 END AS high FROM list
        UNION ALL
        SELECT i + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END FROM (
            SELECT i, low, high, pow(widest, 1 - (low + high) / 2) <= 2.0 AND
                ln(list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2)))) - (low + high) / 2 * list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2) * ln(p)))
                / list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2))) <= 0.97 * most AS ok
            FROM bisect, list WHERE i < 50)
    ), t AS (SELECT CASE WHEN (SELECT widest FROM list) = 1 THEN 1 ELSE high END AS t FROM bisect WHERE i = 50),
    weighed AS (SELECT key, total, CAST(floor(pow(share / top, t) * max(total / pow(share / top, t)) OVER () + 0.5) AS BIGINT) AS tokens FROM shares, t, list),
    plan AS (SELECT key, tokens // total AS blocks, tokens % total AS rest FROM weighed UNION ALL SELECT key, 1, 0 FROM sources WHERE total <= 0),
    used AS (SELECT doc_id, source, key, n_tokens, blocks, rest, unnest(range(0, blocks + 1)) AS block FROM slim JOIN plan USING (key)),
    placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY key, block ORDER BY md5('11:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS end_tokens FROM used WHERE block < blocks OR rest > 0)
    SELECT doc_id, source, n_tokens, CAST(block AS INTEGER) AS block, CAST(end_tokens AS BIGINT) AS end_tokens FROM placed WHERE block < blocks OR end_tokens <= rest
"""
