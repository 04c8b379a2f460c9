"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic; the cells' weights are raked to the three marginals in turn until they
hold; documents are then sampled with probabilities in proportion to the weights of their cells. Only DataFrame operations.
A fit cycle is one grouped aggregate of the cells: what reaches the driver is a sum for each (language, topic), whose number
is checked; sources can be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import join_groups, written

#: (language, topic) pairs there may be; more raise an error.
MOST_PAIRS = 2_000
#: Cycles of the fit, and the change of any factor at which it ends.
CYCLES, TOLERANCE = 50, 1e-7
#: Step of a factor that only a source, language or topic with hardly a cell below 1 takes.
MOST_STEP = 1_000.0
#: Steps in the search of the scale of the probabilities.
SCALE_STEPS, BINS = 3, 512

#: Topics in order, the first that holds: name and SQL condition on `text` (never null) and `n_tokens`.
TOPICS: tuple[tuple[str, str], ...] = (
    ("empty", "n_tokens = 0"),
    ("legal", r"text rlike '(?i)licen[sc]ed? under|copyright|all rights reserved'"),
    ("contact", r"text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'"),
    ("tabular", "length(text) - length(replace(text, '|', '')) > 0.05 * length(text)"),
    ("symbolic", "length(text) - length(translate(text, '#*$%&<>', '')) > 0.05 * length(text)"),
    ("long prose", "n_tokens >= 500"),
    ("prose", "true"),
)


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def topic_of(topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    out = F.lit(None).cast("string")
    for name, condition in reversed(topics):
        out = F.when(F.expr(condition), F.lit(name)).otherwise(out)
    return out


def smoothed(totals: dict[str, float], alpha: float) -> dict[str, float]:
    """Target shares in proportion to totals to the power alpha: 1 keeps the mix, 0 makes all equal."""
    powers = {k: v**alpha for k, v in totals.items() if v > 0}
    return {k: v / sum(powers.values()) for k, v in powers.items()}


def within(shares: dict[str, float], held: dict[str, float], budget: float) -> dict[str, float]:
    """The budget in proportion to shares, but of each no more than is held; the others share what that leaves."""
    full: dict[str, float] = {}
    while len(full) < len(shares):
        rest = sum(v for k, v in shares.items() if k not in full)
        unit = max(budget - sum(full.values()), 0.0) / rest
        over = {k: held[k] for k, v in shares.items() if k not in full and v * unit > held[k]}
        if not over:
            return full | {k: v * unit for k, v in shares.items() if k not in full}
        full |= over
    return full


def fit_weights(cells: DataFrame, source_targets: DataFrame | None = None, lang_targets: dict[str, float] | None = None, topic_targets: dict[str, float] | None = None, alpha: float = 0.7, keep_share: float | None = None) -> DataFrame:
    """(source, lang, topic, tokens, weight) of cells (source, lang, topic, tokens), weight being the factor by which a
    token of the cell counts.

    Targets: (source, share), and shares by language and topic; those not given are smoothed by alpha. Shares of what has no
    tokens are ignored, what has no share gets none, and shares are scaled to sum 1. Cells without tokens weigh 0. If the
    targets contradict one another, the last cycle's weights are returned.

    With keep_share, a cell gives no more than all its tokens: tokens * min(1, keep_share * weight) are raked, to targets that
    sum to keep_share of all tokens. A source, language or topic that has too little for its target gives all, and the others
    share the rest. What cells at 1 can't give thus comes from others of the same source, language and topic. Factors take
    Newton's step for the cells below 1, which never passes the target.
    """
    pairs = [(r["lang"], r["topic"], r["tokens"]) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").orderBy("lang", "topic").limit(MOST_PAIRS + 1).collect()]
    if len(pairs) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic")
    if not pairs:
        return cells.withColumn("weight", F.lit(0.0))
    total = float(sum(x[2] for x in pairs))
    budget = total if keep_share is None else min(keep_share, 1.0) * total

    def targets(given: dict[str, float] | None, at: int) -> dict[str, float]:
        sums: dict[str, float] = {}
        for x in pairs:
            sums[x[at]] = sums.get(x[at], 0.0) + x[2]
        chosen = {k: v for k, v in given.items() if k in sums and v > 0} if given else smoothed(sums, alpha)
        if keep_share is not None:
            return within(chosen, sums, budget)
        return {k: total * v / sum(chosen.values()) for k, v in chosen.items()}

    want_lang, want_topic = targets(lang_targets, 0), targets(topic_targets, 1)
    number = F.element_at(F.create_map(*[F.lit(x) for i, (lang, topic, _) in enumerate(pairs) for x in (f"{lang}\x00{topic}", i)]), F.concat_ws("\x00", "lang", "topic"))
    sources = cells.where("tokens > 0").groupBy("source").agg(F.collect_list(F.struct(number.alias("p"), F.col("tokens").cast("double").alias("n"))).alias("cells"), F.sum("tokens").cast("double").alias("tokens"))
    if source_targets is None:
        sources = sources.withColumn("share", F.pow("tokens", F.lit(alpha)))
    else:
        sources = sources.join(source_targets.select(F.col("source").alias("s"), "share"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("share", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)))
    sources = written(sources, "mix-sources")
    shares = sources.agg(F.sum("share")).first()[0]
    if not shares:
        raise ValueError("no source has a target share")
    unit, full = budget / shares, None
    while keep_share is not None:  # as within(), for sources
        over = F.col("share") * unit > F.col("tokens")
        r = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("tokens")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("share")))).first()
        if r[0] == full or not r[2]:
            break
        full, unit = r[0], max(budget - r[1], 0.0) / r[2]
    want = F.col("share") * unit
    want = want if keep_share is None else F.least(want, F.col("tokens"))
    sources = sources.withColumn("want", want)
    factor = [1.0] * len(pairs)

    def source_factor(factors: list[float]) -> Column:
        by_pair = F.array(*[F.lit(x) for x in factors])
        held = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["n"] * F.get(by_pair, c["p"]))
        plain = F.when(held > 0, F.col("want") / held).otherwise(0.0)
        if keep_share is None:
            return plain

        def step(f: Column) -> Column:
            """Cells below 1 get what those at 1 leave; as many steps as there are cells end at the exact factor."""
            w = lambda c: F.get(by_pair, c["p"])
            whole = F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.when(f * w(c) >= 1, c["n"]).otherwise(0.0))
            rest = F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.when(f * w(c) < 1, c["n"] * w(c)).otherwise(0.0))
            return F.when(rest > 0, F.greatest(f, (F.col("want") - whole) / rest)).otherwise(f)

        return F.aggregate(F.sequence(F.lit(1), F.size("cells")), plain, lambda f, _: step(f))

    for _ in range(CYCLES):
        moved = sources.select(F.explode("cells").alias("c"), source_factor(factor).alias("f"))
        by_pair = F.get(F.array(*[F.lit(x) for x in factor]), F.col("c.p"))
        at_one = F.lit(keep_share is not None) & (F.col("f") * by_pair >= 1)
        sums = {r[0]: (r[1], r[2]) for r in moved.groupBy("c.p").agg(F.sum(F.when(at_one, 0.0).otherwise(F.col("c.n") * F.col("f"))), F.sum(F.when(at_one, F.col("c.n")).otherwise(0.0))).collect()}
        mass = [sums.get(i, (0.0, 0.0))[0] * factor[i] for i in range(len(pairs))]
        whole = [sums.get(i, (0.0, 0.0))[1] for i in range(len(pairs))]
        new, off = list(factor), 0.0
        for at, wanted in ((0, want_lang), (1, want_topic)):
            now: dict[str, float] = {}
            fixed: dict[str, float] = {}
            for x, m, f in zip(pairs, mass, whole, strict=True):
                now[x[at]], fixed[x[at]] = now.get(x[at], 0.0) + m, fixed.get(x[at], 0.0) + f
            off = max(off, *(abs(now[k] + fixed[k] - wanted.get(k, 0.0)) for k in now))
            scale = {}
            for k in now:
                left = wanted.get(k, 0.0) - fixed[k]
                if left > 0 or not fixed[k]:
                    scale[k] = left / now[k] if now[k] > 0 else 1.0 if fixed[k] else 0.0
                    if fixed[k] and (scale[k] > MOST_STEP or left <= TOLERANCE * fixed[k]):  # all but full: factors stay finite
                        scale[k] = min(scale[k], 2.0)
                else:  # the cells at 1 are too much already
                    scale[k] = wanted.get(k, 0.0) / (now[k] + fixed[k])
            mass, new = [m * scale[x[at]] for m, x in zip(mass, pairs, strict=True)], [f * scale[x[at]] for f, x in zip(new, pairs, strict=True)]
        change = max(abs(a - b) / max(a, b) if max(a, b) > 0 else 0.0 for a, b in zip(new, factor, strict=True)) if any(new) else 0.0
        if keep_share is not None and off <= TOLERANCE * budget:
            break  # the factors that were measured hold
        factor = new
        if change < TOLERANCE:
            break
    fitted = sources.select("source", source_factor(factor).alias("f"))
    out = cells.join(fitted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    weight = F.when(F.col("tokens") > 0, F.coalesce(F.col("f") * F.get(F.array(*[F.lit(x) for x in factor]), number), F.lit(0.0)) / (keep_share or 1.0)).otherwise(0.0)
    if keep_share:  # cells at 1 need no more; a bounded range keeps the search of the scale sharp
        weight = F.least(weight, F.lit(1.0 / keep_share))
    return out.withColumn("weight", weight).drop("f")


def scale_for(cells: DataFrame, budget: float) -> float:
    """k such that the sum over cells of tokens * min(1, k * weight) is the budget (in tokens), or as much as there is.

    Weights between `low` and `high` are put into BINS bins, whose sums reach the driver; at a bin's edge e the sum for
    k = 1 / e is known exactly, so the bin that holds 1 / k is found and divided again.
    """
    live = cells.where("tokens > 0 AND weight > 0")
    low, high, n = live.agg(F.min("weight"), F.max("weight"), F.sum("tokens")).first()
    if not n:
        return 0.0
    if budget >= n:
        return 1.0 / low
    high *= 1 + 1e-9
    whole = below = 0.0  # tokens of cells above the window, tokens * weight of cells below it
    inside = 0.0
    for _ in range(SCALE_STEPS):
        width = (high - low) / BINS
        at = F.least(F.floor((F.col("weight") - low) / width), F.lit(BINS - 1)).alias("bin")
        sums = {r[0]: (float(r[1]), r[2]) for r in live.where(F.col("weight").between(low, high)).groupBy(at).agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).collect()}
        inside = sum(m for _, m in sums.values())
        for b in sorted(sums, reverse=True):
            tokens, mass = sums[b]
            edge = low + b * width
            if whole + tokens + (below + inside - mass) / edge >= budget:  # f(1 / edge): the solution is in this bin
                break
            whole, inside = whole + tokens, inside - mass
        below, inside = below + inside - mass, mass
        low, high = edge, edge + width
    return max(budget - whole, 0.0) / (below + inside)


def mix(docs: DataFrame, keep_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 7, **targets) -> DataFrame:
    """Documents with their cell, calibrated probability and draw: doc_id, source, lang, topic, n_tokens, weight,
    probability, kept, text_md5.

    keep_share: expected share of all tokens that is kept. Probabilities are min(1, k * weight), and weights are
    fitted with that bound (see fit_weights), so the expected tokens kept are in the target proportions as far as tokens go. A document is kept if the hash of its id and
    the seed falls below its probability: repeated runs and repeated rows draw alike. Null texts have no tokens and, like
    all texts without, probability 0; null sources and languages are values of their own, shown as null; a null id draws as
    one document. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("\x01")).alias("lang"), text.alias("text"), token_count(F.col(text_col)).alias("n_tokens"))
    rows = written(rows.select("doc_id", "source", "lang", topic_of().alias("topic"), "n_tokens", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node")), "mix-rows")
    n = rows.count()
    cells = written(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("cell_docs")), "mix-cells")
    fitted = written(fit_weights(cells, keep_share=keep_share, **targets).withColumn("cell", F.struct("source", "lang", "topic")), "mix-fitted")
    k = scale_for(fitted, keep_share * (fitted.agg(F.sum("tokens")).first()[0] or 0))
    fitted = fitted.select("cell", "cell_docs", "weight", F.least(F.lit(1.0), F.col("weight") * k).alias("probability"))
    out = join_groups(rows.withColumn("cell", F.struct("source", "lang", "topic")), fitted, "cell", "cell_docs", n)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / float(1 << 53)
    lang = F.when(F.col("lang") != "\x01", F.col("lang"))
    return out.select("doc_id", "source", lang.alias("lang"), "topic", "n_tokens", "weight", "probability", (draw < F.col("probability")).alias("kept"), F.lower(F.hex("node")).alias("text_md5"))
