"""Operator 10: temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is found by bisection (several points at once, one aggregate a
round). Entropy falls as the exponent rises; the repetition of the most
repeated source falls up to exponent 1 and rises beyond. The smallest exponent
that meets both limits is taken; where none does, ValueError is raised.

A source's budget is its weight of the whole budget. It is served as whole
epochs and a part of one more: the source's documents fall into blocks of
about ``BLOCK_TOKENS`` tokens by a hash, and each epoch permutes the blocks,
and the documents in them, by hashes of its own. In the last epoch blocks are
taken in that order until the budget is met; the last block is cut at a
document. The cut is one row per source (a place in the permutation), so
documents decide for themselves how often they are read and where
(``mixture``); a source with a third of all rows is read in parallel like any
other. Only ``in_order`` moves texts.

A null source is a source of its own. Documents without tokens cost nothing
and follow their block. A source without tokens gets no budget: its documents
have no copies. Repeated rows count as often as they come and stand side by
side. Columns of any name pass through, but for those named like a result's
new columns, which give way. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratebook.llm.common import col, staged

BLOCK_TOKENS = 1_000_000
POINTS = 33
ROUNDS = 5
RANGES = 1024
RANGE_SHIFT = 64 - RANGES.bit_length() + 1
BROADCAST_SOURCES = 100_000


def _curve(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, log of the largest ratio of weight to share) at each exponent."""
    ratio = F.log("share") - F.lit(shares.agg(F.max(F.log("share"))).first()[0])  # of no weight's power, so none overflows
    sums = [x for a in exponents for x in (F.sum(F.exp(ratio * a)), F.sum(F.exp(ratio * a) * ratio),
                                           F.max(ratio * a - F.log("share")))]
    row = shares.agg(*sums).first()
    out = []
    for i, a in enumerate(exponents):
        z, zl, most = row[3 * i:3 * i + 3]
        out.append((math.log(z) - a * zl / z, most - math.log(z)))
    return out


def _smallest(shares: DataFrame, grid: list[float], meets) -> float | None:
    """The smallest exponent between the grid's ends that meets a condition which holds from some exponent on."""
    for _ in range(ROUNDS):
        good = [meets(*x) for x in _curve(shares, grid)]
        if True not in good:
            return None
        first = good.index(True)
        if first == 0:
            return grid[0]
        low, high = grid[first - 1], grid[first]
        grid = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
    return high


def find_exponent(shares: DataFrame, budget_share: float | None, target_entropy: float | None,
                  max_epochs: float | None) -> float:
    """The smallest exponent, 0 or more, that meets the target entropy and the repetition limit.

    ``shares``: positive ``share`` per source. ``budget_share``: budget over the
    corpus' tokens, or None for a budget that gives every source one epoch at least.
    Entropy falls as the exponent rises; repetition falls up to exponent 1 and
    rises beyond. Each is searched apart; ValueError if no exponent meets both.
    """
    by_entropy = by_epochs = 0.0
    if target_entropy is not None:
        by_entropy = _smallest(shares, [0.0, *(4.0 ** i for i in range(POINTS - 1))], lambda entropy, peak: entropy <= target_entropy + 1e-9)
        if by_entropy is None:
            raise ValueError(f"no exponent brings the entropy of these shares down to {target_entropy}")
    if max_epochs is None:
        return by_entropy
    if budget_share is None:  # the least repeated source has one epoch, the most repeated one exp(|1 - a| * spread)
        spread = shares.agg(F.max(F.log("share")) - F.min(F.log("share"))).first()[0] or 0.0
        room = math.log(max_epochs) + 1e-9
        if room < 0:
            raise ValueError(f"every source is read once: {max_epochs} epochs are too few")
        by_epochs, within = max(0.0, 1 - room / spread) if spread else 0.0, lambda a: (a - 1) * spread <= room
    else:
        room = math.log(max_epochs) - math.log(budget_share) + 1e-9
        by_epochs = _smallest(shares, [i / (POINTS - 1) for i in range(POINTS)], lambda entropy, peak: peak <= room)
        if by_epochs is None:
            raise ValueError(f"a budget of {budget_share} x the tokens needs more than {max_epochs} epochs of some source")
        within = lambda a: _curve(shares, [a])[0][1] <= room
    exponent = max(by_entropy, by_epochs)
    if exponent > 1 and not within(exponent):
        raise ValueError(f"entropy {target_entropy} needs exponent {exponent:.6f}, which repeats a source more than {max_epochs} times")
    return exponent


def source_weights(counted: DataFrame, source_col: str, tokens_col: str, evenness: float | None = None,
                   target_entropy: float | None = None, max_epochs: float | None = None,
                   budget: int | None = None, every_source_once: bool = False) -> DataFrame:
    """(source, tokens, share, weight, exponent, budget, epochs), one row per source with tokens.

    ``evenness`` sets the target entropy between the natural one (0) and that
    of equal weights (1). Without a budget the corpus' tokens are the budget,
    or, with ``every_source_once``, as many as give each source one epoch.
    """
    sums = staged(counted.groupBy(col(source_col).alias("source")).agg(F.sum(col(tokens_col)).alias("tokens"))
                  .where("tokens > 0"), "sources")
    total = sums.agg(F.sum("tokens")).first()[0]
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    if total:
        if evenness is not None:
            natural = _curve(shares, [1.0])[0][0]
            target_entropy = natural + evenness * (math.log(shares.count()) - natural)
        part = None if every_source_once else (budget or total) / total
        exponent = find_exponent(shares, part, target_entropy, max_epochs)
        top = shares.agg(F.max("share")).first()[0]
        power = F.pow(F.col("share") / F.lit(top), F.lit(exponent))
        weighted = shares.withColumn("weight", power / F.lit(shares.agg(F.sum(power)).first()[0]))
        if every_source_once:
            budget = math.ceil(weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] - 1e-6)
        whole = budget or total
    else:
        exponent, whole, weighted = 1.0, 0, shares.withColumn("weight", F.lit(0.0))
    return weighted.select("source", "tokens", "share", "weight", F.lit(exponent).alias("exponent"),
                           F.round(F.col("weight") * F.lit(float(whole))).cast("long").alias("budget"),
                           (F.col("weight") * F.lit(float(whole)) / F.col("tokens")).alias("epochs"))


def _block(id_col: str, blocks: str, seed: int):
    return F.pmod(F.xxhash64(col(id_col), F.lit(seed)), F.col(blocks))


def _order(source: str, block: str, epoch, seed: int):
    """The block's key in an epoch's permutation; keys are ordered as unsigned numbers."""
    return F.xxhash64(F.col(source), F.col(block), F.lit(seed + 1), epoch.cast("long"))


def _inner(id_col: str, epoch, seed: int):
    """The document's key within its block in an epoch."""
    return F.xxhash64(col(id_col), F.lit(seed + 2), epoch.cast("long"))


def _top(order: str):
    """The first bits of a key: the range it falls into."""
    return F.shiftrightunsigned(order, RANGE_SHIFT)


def _fraction(order: str):
    """A key as a fraction of all keys, 0 to 1."""
    rest = F.col(order).bitwiseAND(F.lit((1 << RANGE_SHIFT) - 1))
    return (_top(order) + rest / F.lit(float(1 << RANGE_SHIFT))) / RANGES


def budgeted_copies(df: DataFrame, counted: DataFrame, weights: DataFrame, id_col: str, source_col: str,
                    tokens_col: str, seed: int = 0) -> DataFrame:
    """``df`` with ``copies``: how often each row is read under its source's budget.

    ``counted`` holds id, source and tokens of every row of ``df``. Of ``df``'s
    columns, one named ``copies`` gives way.
    """
    marked, names = _decided(df, counted, weights, id_col, source_col, tokens_col, seed)
    kept = [c for c in names if c.lower() != "copies"]
    return marked.select(*[F.col(names[c]).alias(c) for c in kept], F.col("__copies").alias("copies"))


def mixture(df: DataFrame, counted: DataFrame, weights: DataFrame, id_col: str, source_col: str,
            tokens_col: str, seed: int = 0, unread: bool = False) -> DataFrame:
    """One row per copy: ``df`` with ``copies``, ``epoch`` (from 0), ``block``, ``place`` and ``inner``.

    ``place`` is how far through the source's budget the block is served in that
    epoch (0 to 1), ``inner`` the document's key in its block. In order of place
    and inner (``in_order``), all sources run through their budgets side by side,
    so any stretch of the mixture has the target weights; each epoch has its own
    permutation of blocks and documents. With ``unread``, rows of no copy come
    once, with nulls. Of ``df``'s columns, those named like the new ones give way.
    """
    marked, names = _decided(df, counted, weights, id_col, source_col, tokens_col, seed)
    kept = [c for c in names if c.lower() not in ("copies", "epoch", "block", "place", "inner")]
    epochs = F.when(F.col("__copies") > 0, F.sequence(F.lit(0), F.col("__copies") - 1))
    rows = marked.withColumn("__epoch", (F.explode_outer if unread else F.explode)(epochs))
    rows = rows.withColumn("__order", _order("__source", "__block", F.col("__epoch"), seed))
    read = F.col("__epoch").isNotNull()
    return rows.select(
        *[F.col(names[c]).alias(c) for c in kept], F.col("__copies").alias("copies"), F.col("__epoch").alias("epoch"),
        F.when(read, F.col("__block")).alias("block"),
        F.when(read, (F.col("__epoch") + _fraction("__order")) / F.col("__epochs")).alias("place"),
        F.when(read, _inner(names[id_col], F.col("__epoch"), seed)).alias("inner"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture's rows range-partitioned and sorted by place, without the columns ``mixture`` added."""
    keys = [F.col("place"), F.col("block"), F.col("inner")]
    return (mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .drop("copies", "epoch", "block", "place", "inner"))


def _decided(df: DataFrame, counted: DataFrame, weights: DataFrame, id_col: str, source_col: str, tokens_col: str,
             seed: int) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under new names with ``__copies``, ``__block``, ``__source`` and ``__epochs``, and the new name of each column."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    plan = staged(weights.select(F.col("source").alias("__source"), "budget", F.col("epochs").alias("__epochs"),
                                 F.floor(F.col("budget") / F.col("tokens")).alias("__whole"),
                                 (F.col("budget") % F.col("tokens")).alias("__left"),
                                 F.ceil(F.col("tokens") / BLOCK_TOKENS).alias("__blocks")), "budgets")
    small = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)
    placed = (counted.select(col(id_col).alias("__id"), col(source_col).alias("__s"), col(tokens_col).alias("__t"))
              .join(hint(plan), F.col("__s").eqNullSafe(F.col("__source")))
              .withColumn("__block", _block("__id", "__blocks", seed))
              .select("__source", "__left", "__t", "__block", _order("__source", "__block", F.col("__whole"), seed).alias("__order"),
                      _inner("__id", F.col("__whole"), seed).alias("__inner")))
    blocks = (placed.groupBy("__source", "__left", "__order", "__block").agg(F.sum("__t").alias("t"))
              .withColumn("range", _top("__order")))
    # unsigned order of the keys: by their first bits, then by the rest
    inner_order = ["__order", "__block"]
    ranges = blocks.groupBy("__source", "range").agg(F.sum("t").alias("rt"))
    over_ranges = Window.partitionBy("__source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("__source").alias("s2"), F.col("range").alias("r2"),
                           F.coalesce(F.sum("rt").over(over_ranges), F.lit(0)).alias("base"))
    inside = Window.partitionBy("__source", "range").orderBy(*inner_order).rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.withColumn("__run", F.coalesce(F.sum("t").over(inside), F.lit(0)))
    run = run.join(ranges, F.col("__source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2"))).withColumn(
        "before", F.col("base") + F.col("__run"))
    edge = staged(run.where("before < __left and before + t >= __left")
                  .select(F.col("__source").alias("s3"), F.col("range").alias("cut_range"), F.col("__order").alias("cut_order"),
                          F.col("__block").alias("cut_block"), (F.col("__left") - F.col("before")).alias("need")), "edges")
    last = (placed.join(hint(edge), F.col("__source").eqNullSafe(F.col("s3")) & (F.col("__order") == F.col("cut_order"))
                        & (F.col("__block") == F.col("cut_block")))
            .groupBy("s3", "need", "__inner").agg(F.sum("__t").alias("t")))
    by_doc = Window.partitionBy("s3").orderBy("__inner").rowsBetween(Window.unboundedPreceding, -1)
    taken = last.withColumn("before", F.coalesce(F.sum("t").over(by_doc), F.lit(0))).where("before < need")
    cut = taken.groupBy(F.col("s3").alias("s4")).agg(F.max("__inner").alias("cut_inner"))
    decided = plan.join(edge, plan["__source"].eqNullSafe(edge.s3), "left").join(
        cut, plan["__source"].eqNullSafe(cut.s4), "left").select(
        "__source", "__whole", "__blocks", "__epochs", "cut_range", "cut_order", "cut_block", "cut_inner")
    decided = staged(decided, "cuts")
    marked = (df.toDF(*names.values()).join(hint(decided), F.col(names[source_col]).eqNullSafe(F.col("__source")), "left")
              .withColumn("__block", _block(names[id_col], "__blocks", seed))
              .withColumn("__order", _order("__source", "__block", F.col("__whole"), seed)))
    rank = F.struct(_top("__order").alias("r"), F.col("__order").alias("o"), F.col("__block").alias("b"))
    edge_rank = F.struct(F.col("cut_range").alias("r"), F.col("cut_order").alias("o"), F.col("cut_block").alias("b"))
    inside = _inner(names[id_col], F.col("__whole"), seed) <= F.col("cut_inner")
    more = F.when(F.col("cut_order").isNull(), F.lit(False)).otherwise((rank < edge_rank) | ((rank == edge_rank) & inside))
    copies = F.coalesce(F.col("__whole"), F.lit(0)) + F.coalesce(more, F.lit(False)).cast("long")
    return marked.select(*names.values(), copies.cast("int").alias("__copies"), "__block", "__source", "__epochs"), names


def repeated(df: DataFrame, copies_col: str = "copies") -> DataFrame:
    """One row per copy, without the copies column."""
    names = [c for c in df.columns if c != copies_col]
    return (df.where(col(copies_col) > 0)
            .select(*map(col, names), F.explode(F.array_repeat(F.lit(0), col(copies_col))).alias("__copy")).drop("__copy"))
