"""Cleaning, filtering and decontaminating problem tables."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotspark.functions.answers import final_integer, first_box, has_latex, trimmed, with_box

# --- Fixed values ---------------------------------------------------------------------------------------------------
# Problems that can't be solved from their text, or whose label is doubtful; the first that matches names the reason.
DROP_PATTERNS = {
    "image_ref": r"!\[|cdn\.mathpix|artofproblemsolving\.com/wiki/index\.php/File:|\.png|\.jpg",
    "asy_code": r"\[asy\]",
    "url": r"https?://",
    "reverse_q": r"what is the value of unknown variable",
}
# Remains of translation requests that are cut out of a problem.
SANITIZE_PATTERNS = [
    r"\s*Translate the (?:above )?text (?:above )?into English[^\n]*",
    r"\s*Translate the above (?:text|content)[^\n]*",
    r"\s*please (?:retain|keep) the (?:original )?[^\n]*line breaks[^\n]*",
    r"\s*(?:and )?output the translation result(?: directly)?\.?",
    r"\s*directly output the translation result\.?",
]
# --------------------------------------------------------------------------------------------------------------------


def sanitized(text: Column) -> Column:
    out = reduce(lambda s, p: F.regexp_replace(s, "(?iu)" + p, ""), SANITIZE_PATTERNS, text)
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def first_prefix(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by an explicit ordinal column."""
    return df.orderBy(order).limit(n)


def exclusion_ids(lists: dict[str, DataFrame]) -> DataFrame:
    """(id, first_list) of the union of id lists, each id with the first list that has it."""
    every = reduce(DataFrame.unionByName, [df.select("id", F.lit(k).alias("place"), F.lit(name).alias("first_list")) for k, (name, df) in enumerate(lists.items())])
    return every.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by("first_list", "place").alias("first_list"))


def exclusion_counts(lists: dict[str, DataFrame]) -> DataFrame:
    """(list, total, new): distinct ids of each list, and those no list before it has."""
    total = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("list"), "id") for name, df in lists.items()]).groupBy("list").agg(F.count_distinct("id").alias("total"))
    new = exclusion_ids(lists).groupBy(F.col("first_list").alias("list")).agg(F.count("*").alias("new"))
    return total.join(new, "list", "left").select("list", "total", F.coalesce("new", F.lit(0)).alias("new"))


def quarantine(bad: DataFrame, suspects: DataFrame) -> DataFrame:
    """Suspect rows that aren't excluded already."""
    return suspects.join(bad.select("id"), "id", "left_anti")


def drop_reason(df: DataFrame, bad: DataFrame, held: DataFrame, text: str = "question") -> DataFrame:
    """df with `reason`: bad_id, quarantined, the first pattern that matches, or null for rows that stay."""
    marks = bad.select("id").distinct().withColumn("__why", F.lit("bad_id")).unionByName(held.select("id").distinct().join(bad.select("id"), "id", "left_anti").withColumn("__why", F.lit("quarantined")))
    out = df.join(marks, "id", "left")
    why = F.col("__why")
    for name, pattern in DROP_PATTERNS.items():
        why = F.coalesce(why, F.when(F.regexp_like(F.col(text), F.lit("(?iu)" + pattern)), name))
    return out.withColumn("reason", why).drop("__why")


def cleaned(df: DataFrame, bad: DataFrame, held: DataFrame, text: str = "question") -> DataFrame:
    """The rows that stay, sanitised, with `sanitized` where that changed the text."""
    kept = drop_reason(df, bad, held, text).where("reason IS NULL").drop("reason")
    clean = kept.withColumn("__clean", sanitized(F.col(text))).withColumn("sanitized", F.col("__clean") != F.col(text))
    return clean.withColumn(text, F.col("__clean")).drop("__clean")


def funnel(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with `reason`, the first rule that fails a row; rules say what must hold, null counts as failing."""
    reason = reduce(lambda acc, r: F.coalesce(acc, F.when(~F.coalesce(r[1], F.lit(False)), r[0])), rules, F.lit(None).cast("string"))
    return df.withColumn("reason", reason)


def funnel_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def fingerprint_ascii(text: Column, size: int = 200) -> Column:
    """Lower-cased ASCII letters and digits, the first 200. For texts that NFKC leaves alone. The pattern takes the 200
    with what stands between them and no more of the text is looked at."""
    head = F.regexp_extract(F.lower(text), "(?s)^(?:[^a-z0-9]*+[a-z0-9]){0,%d}" % size, 0)
    return F.regexp_replace(head, "[^a-z0-9]++", "")


def fingerprint(df: DataFrame, text: str, out: str = "fp", size: int = 200) -> DataFrame:
    """df with the fingerprint of a text after NFKC. Only texts with characters that NFKC may change leave the JVM."""
    import unicodedata

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    plain = F.octet_length(text) == F.char_length(text)
    return df.withColumn(out, F.when(plain, fingerprint_ascii(F.col(text), size)).otherwise(fingerprint_ascii(nfkc(F.when(~plain, F.col(text))), size)))


def decontaminated(df: DataFrame, holdout: DataFrame, text: str = "question", holdout_text: str = "question", drop_empty: bool = True) -> DataFrame:
    """Rows whose fingerprint no held-out text has. With drop_empty=False the empty fingerprint (a text without ASCII
    letters and digits) counts like any other; by default it matches nothing."""
    ban = fingerprint(holdout.select(F.col(holdout_text).alias("t")), "t", "__ban").select("__ban").where(F.col("__ban").isNotNull()).distinct()
    if drop_empty:
        ban = ban.where("__ban <> ''")
    mine = fingerprint(df, text, "__fp")
    return mine.join(ban, F.col("__fp") == F.col("__ban"), "left_anti").drop("__fp")


def capped_ids(df: DataFrame, source: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each source with ids like src-0000000, by the ordinal column."""
    rn = F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1
    return df.withColumn("__rn", rn).where(F.col("__rn") < most).withColumn("id", F.format_string("%s-%07d", F.col(source), F.col("__rn"))).drop("__rn")


def external_solutions(df: DataFrame, holdout: DataFrame, require_box: bool = False, question: tuple[int, int] = (40, 1200), solution: tuple[int, int] = (120, 2400)) -> DataFrame:
    """df (src, question, solution, ..) with `reason` (null where a row is taken), answer, had_box, and the solution
    closed by a box. Rules are tried in this order: fields, lengths, an integer answer, held-out problems, a box."""
    ban = fingerprint(holdout.select(F.col("question").alias("t")), "t", "__ban").select("__ban").distinct().withColumn("__hit", F.lit(True))
    rows = fingerprint(df.withColumn("answer", final_integer(F.col("solution"))).withColumn("had_box", first_box(F.col("solution")).isNotNull()), "question", "__fp")
    rows = rows.join(ban, F.col("__fp") == F.col("__ban"), "left")
    rules = [
        ("empty_field", (F.col("question") != "") & (F.col("solution") != "")),
        ("question_length", F.length("question").between(*question)),
        ("solution_length", F.length("solution").between(*solution)),
        ("not_integer", F.col("answer").isNotNull()),
        ("held_out", F.col("__hit").isNull()),
        *([("no_box", F.col("had_box"))] if require_box else []),
    ]
    return funnel(rows, rules).withColumn("solution", with_box(F.col("solution"), F.col("answer"))).drop("__fp", "__ban", "__hit")


def profile(df: DataFrame, text: str = "question") -> DataFrame:
    """n, len_median, len_mean, tex_ratio."""
    size = F.length(text)
    return df.agg(F.count("*").alias("n"), F.percentile(size, 0.5).alias("len_median"), F.round(F.avg(size), 1).alias("len_mean"), F.round(F.avg(has_latex(F.col(text), False).cast("double")), 4).alias("tex_ratio"))


def resumed(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id hasn't been finished."""
    return todo.join(done.select("id").distinct(), "id", "left_anti")


def replay_mix(kept: DataFrame, pool: DataFrame, ratio: float, seed: str = "42") -> DataFrame:
    """kept with as many rows of the pool as make up `ratio` of all, marked src='replay', in a reproducible choice."""
    from ballotspark.operators.metrics import drawn

    n = int(kept.count() * ratio / max(1 - ratio, 1e-9))
    chosen = pool.withColumn("__k", drawn(seed, F.col("id"))).orderBy("__k", "id").limit(n).drop("__k")
    return kept.unionByName(chosen.withColumn("src", F.lit("replay")))
