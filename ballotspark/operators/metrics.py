"""How good picked answers and scores are."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotspark.functions.answers import mentions
from ballotspark.functions.normal import normal_quantile
from ballotspark.sources.readers import numbered
from ballotspark.operators.voting import PURE_SCORE, RULES, majority, winners, with_zscores

#: Weights that a sweep tries; the last one stands for the score alone.
GAMMAS = [0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 8.0, 1e9]
#: Answers that unanimity proves nothing for.
TRIVIAL = [0, 1]


def drawn(*parts: Column | str) -> Column:
    """A reproducible random order: the md5 of the parts' text, the same in any engine."""
    return F.md5(F.concat_ws(":", *((F.lit(p) if isinstance(p, str) else p).cast("string") for p in parts)))


def accuracy(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: n, acc (four decimals) and the half width of its 95 % interval. Ids without gold are left out."""
    hit = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).cast("double")
    out = answers.join(gold, "id").agg(F.count("*").alias("n"), F.round(F.avg(hit), 4).alias("acc"))
    return out.withColumn("ci95", F.round(1.96 * F.sqrt(F.col("acc") * (1 - F.col("acc")) / F.col("n")), 4))


def pass_any(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of ids with any correct sample."""
    some = pool.join(gold, "id").groupBy("id").agg(F.max(F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("int")).alias("hit"))
    return some.agg(F.count("*").alias("n"), F.round(F.avg("hit"), 4).alias("pass_any"))


def solved(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, k, n_correct)."""
    return pool.join(gold, "id").groupBy("id").agg(F.count("*").alias("k"), F.sum(F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("long")).alias("n_correct"))


def unbiased_pass(n: Column, c: Column, m: Column) -> Column:
    """1 - C(n - c, m) / C(n, m), as a product over the c correct samples; 1 if fewer than m are wrong."""
    factors = F.when(c > 0, F.sequence(n - c + 1, n)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n - c < m, 1.0).otherwise(1 - F.aggregate(factors, F.lit(1.0), lambda a, i: a * (1 - m / i)))


def powers_of_two(pool: DataFrame, most: int = 512) -> DataFrame:
    """(m): 1, 2, 4, .. up to the largest number of samples."""
    k = pool.groupBy("id").count().agg(F.max("count").alias("k"))
    return k.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(most.bit_length() - 1)), lambda e: F.pow(F.lit(2), e).cast("long"))).alias("m"), "k").where("m <= k").select("m")


def pass_at_m(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """(m, pass_m): the chance that m samples hold a correct one, averaged over ids."""
    each = solved(pool, gold).crossJoin(F.broadcast(powers_of_two(pool)))  # at most ten values of m
    return each.groupBy("m").agg(F.round(F.avg(unbiased_pass(F.col("k"), F.col("n_correct"), F.col("m"))), 6).alias("pass_m"))


def subsamples(pool: DataFrame, m: int, trials: int, seed: str = "42") -> DataFrame:
    """pool with trial: for each of `trials` trials m samples of each id, drawn without replacement (all, if an id has
    fewer). The same trial always has the same samples, so rules are compared on equal terms."""
    each = pool.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    order = Window.partitionBy("id", "trial").orderBy(drawn(seed, F.col("id"), F.col("trial"), F.col("j")), "j")
    return each.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= m).drop("__rn")


def _by_trial(rows: DataFrame, rule, keys: list[str]) -> DataFrame:
    """rule on each combination of the keys as if it were an id: (keys, id, answer)."""
    packed = rows.withColumn("__id", F.struct("id", *keys)).drop("id", *keys).withColumnRenamed("__id", "id")
    return rule(packed).select("id.*", "answer")


def drawn_number(below: Column, *parts: Column | str) -> Column:
    """A reproducible whole number from 0 up to `below`, from the md5 of the parts' text."""
    return F.conv(F.substring(drawn(*parts), 1, 15), 16, 10).cast("long") % below


def maj_at_m(pool: DataFrame, gold: DataFrame, trials: int = 20, seed: str = "42") -> DataFrame:
    """(m, maj_m): accuracy of the vote of m samples, averaged over trials.

    Samples are drawn without replacement; where an id has fewer than m, m times with replacement. Each (id, trial) is
    put in order once and every m takes its first samples, so rows are multiplied by trials only.
    """
    sizes = [r["m"] for r in powers_of_two(pool).orderBy("m").collect()]  # ten at most
    each = pool.select("id", "j", "ans").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    order = Window.partitionBy("id", "trial").orderBy(drawn(seed, F.col("id"), F.col("trial"), F.col("j")), "j")
    ranked = each.withColumn("r", F.row_number().over(order)).join(pool.groupBy("id").agg(F.count("*").alias("k")), "id")
    votes = lambda fits: [F.sum((fits(m) & (F.col("r") <= m)).cast("long")).alias(f"n{m}") for m in sizes]
    whole = ranked.groupBy("id", "trial", "ans").agg(*votes(lambda m: F.col("k") >= m))
    # ids with fewer samples than the largest m: as many draws as that, each of one of the id's samples
    few = pool.groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") < (sizes[-1] if sizes else 0))
    draws = few.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(sizes[-1] if sizes else 1))))
    draws = draws.withColumn("place", drawn_number(F.col("k"), seed, F.col("id"), F.col("trial"), F.lit("again"), F.col("r")))
    placed = pool.join(few.select("id"), "id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("j")) - 1).select("id", "place", "ans")
    again = draws.join(placed, ["id", "place"]).groupBy("id", "trial", "ans").agg(*votes(lambda m: F.col("k") < m))
    cells = whole.unionByName(again).groupBy("id", "trial", "ans").agg(*(F.sum(f"n{m}").alias(f"n{m}") for m in sizes))
    long = cells.select("id", "trial", "ans", F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.col(f"n{m}").alias("weight")) for m in sizes))).alias("x")).select("id", "trial", "ans", "x.*")
    best = winners(long.where("weight > 0").select(F.struct("id", "trial", "m").alias("id"), "ans", "weight", F.lit(0).alias("first_j"))).select("id.*", "answer")
    hit = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).cast("double")
    return best.join(gold, "id").groupBy("m").agg(F.round(F.avg(hit), 6).alias("maj_m"))


def curve(maj: DataFrame, passes: DataFrame, flat: float = 0.005, wide: float = 0.08) -> DataFrame:
    """(m, maj_m, pass_m, gap, gain, plateau, gap_wide): the vote's gain over the m before, and whether more samples
    or a better choice among them would help."""
    at = maj.join(passes, "m")
    gain = F.col("maj_m") - F.lag("maj_m").over(Window.orderBy("m"))  # at most ten rows
    out = at.withColumn("gap", F.round(F.col("pass_m") - F.col("maj_m"), 6)).withColumn("gain", F.round(gain, 6))
    return out.withColumn("plateau", F.coalesce(F.col("gain") < flat, F.lit(False))).withColumn("gap_wide", F.col("gap") > wide)


def diversity(pool: DataFrame) -> DataFrame:
    """Share of samples without an answer, mean number of different answers, share of ids that agree on one that isn't trivial."""
    each = pool.groupBy("id").agg(F.count("*").alias("n"), F.count("ans").alias("read"), F.count_distinct("ans").alias("kinds"), F.min("ans").alias("one"))
    agreed = ((F.col("kinds") == 1) & ~F.col("one").isin(TRIVIAL)).cast("double")
    return each.agg(F.round(1 - F.sum("read") / F.sum("n"), 6).alias("none_ratio"), F.round(F.avg("kinds"), 6).alias("uniq_answers"), F.round(F.avg(agreed), 6).alias("unanimous"))


def pairwise_auc(pool: DataFrame, gold: DataFrame, key: str = "score", slices: DataFrame | None = None) -> DataFrame:
    """(slice, pairs, auc) over pairs of a correct and a wrong sample of one id; samples without an answer are wrong,
    those without a score don't count. slices is (id, slice); all ids are the slice 'all'.

    From average ranks: U = sum of the correct samples' ranks - P (P + 1) / 2, so no pairs are made.
    """
    rows = pool.where(F.col(key).isNotNull()).join(gold, "id").withColumn("hit", F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)))
    value = Window.partitionBy("id").orderBy(key)
    ranked = rows.withColumn("r", F.rank().over(value) + (F.count("*").over(Window.partitionBy("id", key)) - 1) / 2)
    p, n = F.sum(F.col("hit").cast("long")), F.sum((~F.col("hit")).cast("long"))
    each = ranked.groupBy("id").agg(p.alias("p"), n.alias("n"), F.sum(F.when(F.col("hit"), F.col("r")).otherwise(0.0)).alias("ranks"))
    each = each.withColumn("u", F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2).withColumn("pairs", F.col("p") * F.col("n"))
    total = [F.sum("pairs").alias("pairs"), F.round(F.try_divide(F.sum(F.when(F.col("pairs") > 0, F.col("u"))), F.sum("pairs")), 6).alias("auc")]
    whole = each.agg(*total).select(F.lit("all").alias("slice"), "pairs", "auc")
    return whole if slices is None else whole.unionByName(each.join(slices, "id").groupBy("slice").agg(*total))


def majority_slices(pool: DataFrame, gold: DataFrame) -> DataFrame:
    hit = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    return majority(pool).join(gold, "id").select("id", F.when(hit, "majority_right").otherwise("majority_wrong").alias("slice"))


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x > 0: Stirling's series at x + 8, brought back by the eight factors."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - F.log(reduce(lambda a, k: a * (x + k), range(1, 8), x))


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of the paired test: twice the lower tail of a fair coin. Terms are taken from the largest down,
    as many as can matter (those beyond 12 standard deviations are below 1e-30 of it), in log space, as 2^n leaves the
    range of doubles."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * F.log(F.lit(2.0)))
    steps = F.least(k, F.ceil(12 * F.sqrt(n)) + 40).cast("long")
    terms = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, F.struct(F.lit(1.0).alias("last"), F.lit(1.0).alias("all")), lambda a, i: F.struct((a["last"] * (k - i + 1) / (n - k + i)).alias("last"), (a["all"] + a["last"] * (k - i + 1) / (n - k + i)).alias("all")))["all"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * top * tail))


def mcnemar(arms: DataFrame) -> DataFrame:
    """(x, y, b, c, diff, p) for each pair of arms of (arm, id, ok): b ids only x has right, c only y.

    Arms are few: each id's are one row, which says what it adds to each pair; arms are never joined with one another.
    """
    n = arms.agg(F.count_distinct("id").alias("n"))
    rows = arms.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("arm", "ok"))).alias("a"))
    pair = lambda x, y: F.struct(x["arm"].alias("x"), y["arm"].alias("y"), (x["ok"] & ~y["ok"]).alias("b"), (y["ok"] & ~x["ok"]).alias("c"))
    each = rows.select(F.explode(F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: x["arm"] < y["arm"]), lambda y: pair(x, y))))).alias("p")).select("p.*")
    pairs = each.groupBy("x", "y").agg(F.sum(F.col("b").cast("long")).alias("b"), F.sum(F.col("c").cast("long")).alias("c"))
    return pairs.crossJoin(F.broadcast(n)).select("x", "y", "b", "c", F.round((F.col("b") - F.col("c")) / F.col("n"), 4).alias("diff"), F.round(binomial_two_sided(F.col("b"), F.col("c")), 4).alias("p"))


def mcnemar_pooled(arms: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(b, c, p) over several pairs of arms together."""
    each = reduce(lambda x, y: x | y, [(F.col("x") == min(p)) & (F.col("y") == max(p)) for p in pairs], F.lit(False))
    turned = reduce(lambda x, y: x | y, [(F.col("x") == p[1]) & (F.col("y") == p[0]) for p in pairs], F.lit(False))
    m = mcnemar(arms).where(each)
    b = F.sum(F.when(turned, F.col("c")).otherwise(F.col("b")))
    c = F.sum(F.when(turned, F.col("b")).otherwise(F.col("c")))
    return m.agg(F.coalesce(b, F.lit(0)).alias("b"), F.coalesce(c, F.lit(0)).alias("c")).withColumn("p", F.round(binomial_two_sided(F.col("b"), F.col("c")), 5))


def union_intersection(arms: DataFrame) -> DataFrame:
    """Shares of ids that any arm, and that every arm has right."""
    each = arms.groupBy("id").agg(F.max(F.col("ok").cast("double")).alias("some"), F.min(F.col("ok").cast("double")).alias("every"))
    return each.agg(F.round(F.avg("some"), 4).alias("union_acc"), F.round(F.avg("every"), 4).alias("intersect_acc"))


def arms_of(pool: DataFrame, gold: DataFrame, rules: list[str] | None = None, tie: str = "answer_asc") -> DataFrame:
    """(arm, id, ok): each rule's answers as an arm."""
    out = None
    for name in rules or list(RULES):
        arm = RULES[name](pool, tie=tie).join(gold, "id").select(F.lit(name).alias("arm"), "id", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).alias("ok"))
        out = arm if out is None else out.unionByName(arm)
    return out


def league(pool: DataFrame, gold: DataFrame, m: int | None = None, trials: int = 20, seed: str = "42") -> DataFrame:
    """(arm, acc, gain, recovered), best first: accuracy of each rule, its gain on the plain vote, and the share of the
    gap between the plain vote and any correct sample that it recovers (0 without a gap). With m every rule sees the
    same m samples of each id in each of the trials; without, all samples once."""
    rows = pool.withColumn("trial", F.lit(0)) if m is None else subsamples(pool, m, trials, seed)
    ok = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    arms = [_by_trial(rows, rule, ["trial"]).join(gold, "id").select(F.lit(name).alias("arm"), ok.alias("ok")) for name, rule in RULES.items()]
    acc = reduce(DataFrame.unionByName, arms).groupBy("arm").agg(F.avg(F.col("ok").cast("double")).alias("acc"))
    base = acc.where("arm = 'majority'").select(F.col("acc").alias("base"))
    some = rows.join(gold, "id").groupBy("id", "trial").agg(F.max(F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("double")).alias("hit"))
    out = acc.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(some.agg(F.avg("hit").alias("top"))))  # one row each
    gain, gap = F.col("acc") - F.col("base"), F.col("top") - F.col("base")
    return out.select("arm", F.round("acc", 4).alias("acc"), F.round(gain, 4).alias("gain"), F.when(gap > 0, F.round(F.try_divide(gain, gap), 4)).otherwise(0.0).alias("recovered")).orderBy(F.desc("acc"), "arm")


def sampled_scores(pool: DataFrame, columns: list[str], m: int, trials: int, seed: str) -> DataFrame:
    """(id, trial, ans, n, first_j, and mean_c and max_c for each column c): an answer's votes and standardised scores
    among the m samples of a trial. Scores are standardised over all samples of the id, before samples are drawn."""
    rows = subsamples(with_zscores(pool, {c: f"__z_{c}" for c in columns}), m, trials, seed)
    each = [f(f"__z_{c}").alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("max", F.max))]
    return rows.groupBy("id", "trial", "ans").agg(F.count("*").alias("n"), F.min("j").alias("first_j"), *each)


def _cell(gamma: float, column: str, how: str) -> Column:
    """Weight of an answer of `sampled_scores`."""
    return F.col(f"max_{column}") if gamma >= PURE_SCORE else F.log("n") + gamma * F.col(f"{how}_{column}")


def gamma_sweep(pool: DataFrame, gold: DataFrame, scores: dict[str, tuple[str, str]], m: int = 64, trials: int = 20, gammas: list[float] | None = None, seed: str = "42") -> DataFrame:
    """(tag, gamma, acc): fused accuracy for each weight and each of scores {tag: (column, how)}, averaged over trials
    that draw m samples of each id, the same ones for every cell. The pool is read and grouped once."""
    by = sampled_scores(pool, sorted({c for c, _ in scores.values()}), m, trials, seed)
    cells = [F.struct(F.lit(tag).alias("tag"), F.lit(float(g)).alias("gamma"), _cell(g, column, how).alias("weight")) for tag, (column, how) in scores.items() for g in (gammas or GAMMAS)]
    votes = by.select("id", "trial", "ans", "first_j", F.explode(F.array(*cells)).alias("c")).select(F.struct("id", "trial", "c.tag", "c.gamma").alias("id"), "ans", "first_j", "c.weight")
    hit = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).cast("double")
    return winners(votes).select("id.*", "answer").join(gold, "id").groupBy("tag", "gamma").agg(F.round(F.avg(hit), 4).alias("acc"))


def sampled_rescue_break(pool: DataFrame, gold: DataFrame, gamma: float, column: str = "score", how: str = "mean", m: int = 64, trials: int = 20, seed: str = "42") -> DataFrame:
    """One row: ids that the plain vote of m samples has wrong and right, by trial; of these how many the fused one makes
    right and wrong; and the net gain in accuracy. Both see the same samples."""
    by = sampled_scores(pool, [column], m, trials, seed)
    ids = by.withColumn("id", F.struct("id", "trial"))
    a = winners(ids.withColumn("weight", F.log("n"))).withColumnRenamed("answer", "a0")
    b = winners(ids.withColumn("weight", _cell(gamma, column, how))).withColumnRenamed("answer", "a1")
    ok = lambda c: F.coalesce(F.col(c) == F.col("gold"), F.lit(False))
    rows = a.join(b, "id").select("id.*", "a0", "a1").join(gold, "id").select(ok("a0").alias("r0"), ok("a1").alias("r1"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = rows.agg(F.count("*").alias("cells"), n(~F.col("r0")).alias("w"), n(F.col("r0")).alias("g"), n(~F.col("r0") & F.col("r1")).alias("s"), n(F.col("r0") & ~F.col("r1")).alias("x"))
    each = [F.round(F.col(c) / trials, 4).alias(name) for c, name in (("w", "wrong"), ("g", "right"), ("s", "rescued"), ("x", "broken"))]
    return out.select(*each, F.round(F.try_divide(F.col("s") - F.col("x"), F.col("cells")), 4).alias("net"))


def best_of_sweep(sweep: DataFrame, tags: list[str]) -> DataFrame:
    """The first best cell, by weight and then in the order of the tags."""
    order = reduce(lambda w, k: w.when(F.col("tag") == tags[k], k), range(len(tags)), F.when(F.lit(False), -1))
    return sweep.agg(F.min_by(F.struct("tag", "gamma", "acc"), F.struct(-F.col("acc"), "gamma", order)).alias("best")).select("best.*")


def rescue_break(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """How many wrong answers the second choice made right, and right ones wrong."""
    ok = lambda c: F.coalesce(F.col(c) == F.col("gold"), F.lit(False))
    both = before.withColumnRenamed("answer", "a0").join(after.withColumnRenamed("answer", "a1"), "id").join(gold, "id").select(ok("a0").alias("r0"), ok("a1").alias("r1"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = both.agg(n(~F.col("r0")).alias("wrong"), n(F.col("r0")).alias("right"), n(~F.col("r0") & F.col("r1")).alias("rescued"), n(F.col("r0") & ~F.col("r1")).alias("broken"))
    return out.withColumn("net", F.col("rescued") - F.col("broken"))


def fusion_simulation(pool: DataFrame, gold: DataFrame, aucs: list[float], gammas: list[float], m: int = 32, trials: int = 5, seed: int = 42) -> DataFrame:
    """(auc, gamma, acc): what a scorer of a given pairwise AUC would bring. Scores are normal, moved up for correct
    samples by sqrt(2) * quantile(AUC); drawn by hash, so a trial is the same for every weight."""
    spark = pool.sparkSession
    grid = spark.createDataFrame([(float(a),) for a in aucs], "auc double").withColumn("mu", F.sqrt(F.lit(2.0)) * normal_quantile(F.greatest(F.least("auc", F.lit(1 - 1e-6)), F.lit(1e-6))))
    rows = subsamples(pool, m, trials, str(seed)).join(gold, "id")
    uniform = (drawn_number(F.lit(1 << 50), str(seed), F.lit("noise"), F.col("id"), F.col("trial"), F.col("j")) + 0.5) / float(1 << 50)
    rows = rows.withColumn("noise", normal_quantile(uniform)).withColumn("hit", F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("double"))
    by = rows.where(F.col("ans").isNotNull()).groupBy("id", "trial", "gold", "ans").agg(F.count("*").alias("n"), F.avg("noise").alias("noise"), F.first("hit").alias("hit"), F.min("j").alias("first_j"))
    weights = spark.createDataFrame([(float(g),) for g in gammas], "gamma double")
    each = by.crossJoin(F.broadcast(grid)).crossJoin(F.broadcast(weights))  # fixed grids
    z = F.col("noise") + F.col("hit") * F.col("mu")
    votes = each.withColumn("weight", F.when(F.col("gamma") >= 1e8, z).otherwise(F.log("n") + F.col("gamma") * z))
    best = winners(votes.withColumn("id", F.struct("id", "trial", "gold", "auc", "gamma")))
    cells = rows.select("id", "trial").distinct().count()
    hit = best.select("id.*", "answer").withColumn("ok", (F.col("answer") == F.col("gold")).cast("double"))
    return hit.groupBy("auc", "gamma").agg(F.round(F.sum("ok") / cells, 4).alias("acc"))


def vote_margin(pool: DataFrame) -> DataFrame:
    """(id, margin): votes of the first answer less those of the second."""
    votes = pool.where(F.col("ans").isNotNull()).groupBy("id", "ans").agg(F.count("*").alias("n"))
    top = F.reverse(F.array_sort(F.collect_list("n")))
    return votes.groupBy("id").agg((F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0))).alias("margin"))


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """Three definitions side by side: the element at n // 2, the one at int(0.95 n), and the interpolated median.

    Values are sorted and numbered by partition, so no task sees all of them."""
    values = numbered(df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")), "place", "v")
    n = df.agg(F.count(column).alias("n"))
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("v")))
    half = (at(F.floor((F.col("n") - 1) / 2)) + at(F.ceil((F.col("n") - 1) / 2))) / 2
    return values.crossJoin(F.broadcast(n)).groupBy("n").agg(half.alias("median"), at(F.floor(F.col("n") * 0.5)).alias("upper_median"), at(F.floor(F.col("n") * 0.95)).alias("p95"))


def length_stats(pool: DataFrame) -> DataFrame:
    """Share of truncated samples, mean characters, share of samples with a log-probability (0 means: not recorded)."""
    return pool.agg(F.count("*").alias("samples"), F.round(F.avg(F.col("trunc").cast("double")), 6).alias("trunc_ratio"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.round(F.count("logp") / F.count("*"), 6).alias("logp_share"))


def throughput(runs: DataFrame) -> DataFrame:
    """tok_per_s, trunc_ratio and cost of (tokens_in, tokens_out, seconds, samples, truncated, price_in, price_out per million)."""
    return runs.agg(F.round(F.sum("tokens_out") / F.sum("seconds"), 4).alias("tok_per_s"), F.round(F.sum("truncated") / F.sum("samples"), 6).alias("trunc_ratio"), F.round(F.sum(F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6, 6).alias("cost"))


def missed_upper_bound(pool: DataFrame, answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(n, missed, miss_upper): ids that were answered wrong although the right number stands by itself in some sample's
    text. Small numbers do so by chance, so this is an upper bound of what better parsing would win."""
    wrong = answers.join(gold, "id").where(~F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))).select("id", "gold")
    seen = pool.join(wrong, "id").groupBy("id").agg(F.max(F.coalesce(mentions(F.col("text"), F.col("gold").cast("string")), F.lit(False)).cast("long")).alias("seen"))
    n = answers.join(gold, "id").agg(F.count("*").alias("n"))
    return seen.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("missed")).crossJoin(n).select("n", "missed", F.round(F.col("missed") / F.col("n"), 4).alias("miss_upper"))


def failing_examples(rows: DataFrame, n: int, cause: str | None = None, chars: int = 600) -> DataFrame:
    """Of (id, cause, text) the first n of each cause (or of one) by id, with the end of the text."""
    some = rows if cause is None else rows.where(F.col("cause") == cause)
    rank = F.row_number().over(Window.partitionBy("cause").orderBy("id"))
    return some.withColumn("__rn", rank).where(F.col("__rn") <= n).select("id", "cause", F.right("text", F.lit(chars)).alias("tail"))


def log_odds(top: Column, yes: str = "Yes", no: str = "No", floor: float = -20.0) -> Column:
    """Of a map of log-probabilities; tokens that it lacks have the floor. Four decimals."""
    return F.round(F.coalesce(F.try_element_at(top, F.lit(yes)), F.lit(floor)) - F.coalesce(F.try_element_at(top, F.lit(no)), F.lit(floor)), 4)


