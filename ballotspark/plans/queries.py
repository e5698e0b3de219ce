"""Named queries over the driver's tables: one for each operator or group of operators."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotspark.functions import answers as A
from ballotspark.functions import prompts
from ballotspark.operators import audit, gates, metrics, prep, selection, voting
from ballotspark.plans import sql as S
from ballotspark.sources import adapters as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def ev(spark, sf):
    pool = P.pool_events(spark, sf)
    return pool, P.gold_users(pool)


def li(spark, sf):
    return P.pool_lines(spark, sf), P.gold_orders(spark, sf)


def docs(spark, sf):
    """documents as problems."""
    return P.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), "source", "lang")


DOCS = "docs AS (SELECT doc_id AS id, text AS question, source, lang FROM documents)"

# ---- votes -------------------------------------------------------------------------------------------------------
for _name, _key in (("majority_vote", "majority"), ("vote_logp_soft", "logp_soft"), ("vote_logp_best", "logp_best"), ("vote_no_trunc", "no_trunc"), ("vote_path_unique", "path_unique"), ("vote_median_len", "median_length"), ("vote_short", "short"), ("vote_combo", "combined")):
    query(_name, f"WITH {S.EV} {S.RULES[_key]}")(lambda spark, sf, k=_key: voting.RULES[k](ev(spark, sf)[0]))

query("majority_first_seen", f"WITH {S.EV} {S.vote(tie='first_j')}")(lambda spark, sf: voting.majority(ev(spark, sf)[0], "first_seen"))
query("fused_mean", f"WITH {S.EV} {S.fused(0.5, 'mean')}")(lambda spark, sf: voting.fused(ev(spark, sf)[0], 0.5, "mean"))
query("fused_mean_lineitem", f"WITH {S.LI} {S.fused(0.5, 'mean')}")(lambda spark, sf: voting.fused(li(spark, sf)[0], 0.5, "mean"))
query("fused_max", f"WITH {S.EV} {S.fused(0.5, 'max')}")(lambda spark, sf: voting.fused(ev(spark, sf)[0], 0.5, "max"))
query("best_of_n", f"WITH {S.EV} {S.fused(1e9, 'max')}")(lambda spark, sf: voting.best_of_n(ev(spark, sf)[0]))
query("best_of_n_mean", f"WITH {S.EV} {S.vote('avg(z)', S.zscore('score'))}")(lambda spark, sf: voting.best_of_n(ev(spark, sf)[0], "mean"))

query("submission", f"""WITH {S.EV}, plain AS ({S.RULES['majority']}), best AS ({S.fused(0.5, 'mean')}), kinds AS (SELECT id, count(DISTINCT ans) AS kinds FROM pool GROUP BY id)
SELECT g.id, coalesce(b.answer, 0) AS answer, b.answer IS NULL AS fallback, coalesce(kinds, 0) = 1 AS unanimous, coalesce(b.answer <> p.answer, false) AS flipped
FROM gold g LEFT JOIN plain p ON p.id = g.id LEFT JOIN best b ON b.id = g.id LEFT JOIN kinds k ON k.id = g.id""")(lambda spark, sf: voting.submission(ev(spark, sf)[0], ev(spark, sf)[1]))

# ---- metrics -----------------------------------------------------------------------------------------------------
query("accuracy_ci", f"""WITH {S.EV}, a AS ({S.RULES['majority']}), s AS (SELECT count(*) AS n, round(avg(CASE WHEN answer = gold THEN 1.0 ELSE 0.0 END), 4) AS acc FROM a JOIN gold USING (id))
SELECT n, acc, round(1.96 * sqrt(acc * (1 - acc) / n), 4) AS ci95 FROM s""")(lambda spark, sf: metrics.accuracy(voting.majority(ev(spark, sf)[0]), ev(spark, sf)[1]))

query("pass_any", f"WITH {S.LI} SELECT count(*) AS n, round(avg(CASE WHEN n_correct > 0 THEN 1.0 ELSE 0.0 END), 4) AS pass_any FROM ({S.SOLVED})")(lambda spark, sf: metrics.pass_any(*li(spark, sf)))

query("pass_at_m", f"""WITH {S.EV}, s AS ({S.SOLVED}), p AS ({S.POWERS})
SELECT m, round(avg(CASE WHEN k - n_correct < m THEN 1.0 ELSE 1 - exp({S.CHOOSE.format('(k - n_correct)', 'm')} - {S.CHOOSE.format('k', 'm')}) END), 6) AS pass_m FROM s, p GROUP BY m""")(lambda spark, sf: metrics.pass_at_m(*ev(spark, sf)))

MAJ_AT_M = f"""sizes AS (SELECT id, count(*) AS k FROM pool GROUP BY id), trials AS (SELECT unnest(range(1, 6)) AS trial), powers AS ({S.POWERS}),
drawn AS (SELECT pool.id, ans, m, trial, k, row_number() OVER (PARTITION BY pool.id, m, trial ORDER BY {S.drawn("'42'", 'pool.id', 'trial', 'j')}, j) AS rn FROM pool JOIN sizes USING (id), powers, trials),
placed AS (SELECT id, ans, row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS place FROM pool),
again AS (SELECT id, m, trial, {S.drawn_number('k', "'42'", 'id', 'trial', "'again'", 'r')} AS place FROM (SELECT id, k, m, trial, unnest(range(1, m + 1)) AS r FROM sizes, powers, trials WHERE k < m)),
few AS (SELECT id, m, trial, ans FROM drawn WHERE rn <= m AND k >= m UNION ALL SELECT id, m, trial, ans FROM again JOIN placed USING (id, place)),
picked AS ({S.winner('SELECT id, m, trial, ans, count(*) AS weight FROM few GROUP BY ALL', keys='id, m, trial', ids='few')}),
maj AS (SELECT m, round(avg(CASE WHEN answer = gold THEN 1.0 ELSE 0.0 END), 6) AS maj_m FROM picked JOIN gold USING (id) GROUP BY m)"""
query("maj_at_m", f"WITH {S.EV}, {MAJ_AT_M} SELECT m, maj_m FROM maj")(lambda spark, sf: metrics.maj_at_m(*ev(spark, sf), trials=5))

query("curve_verdicts", f"""WITH {S.EV}, {MAJ_AT_M}, s AS ({S.SOLVED}), pass AS (
  SELECT m, round(avg(CASE WHEN k - n_correct < m THEN 1.0 ELSE 1 - exp({S.CHOOSE.format('(k - n_correct)', 'm')} - {S.CHOOSE.format('k', 'm')}) END), 6) AS pass_m FROM s, ({S.POWERS}) GROUP BY m
), c AS (SELECT m, maj_m, pass_m, round(pass_m - maj_m, 6) AS gap, round(maj_m - lag(maj_m) OVER (ORDER BY m), 6) AS gain FROM maj JOIN pass USING (m))
SELECT *, coalesce(gain < 0.005, false) AS plateau, gap > 0.08 AS gap_wide FROM c""")(lambda spark, sf: metrics.curve(metrics.maj_at_m(*ev(spark, sf), trials=5), metrics.pass_at_m(*ev(spark, sf))))

query("diversity", f"""WITH {S.LI}, e AS (SELECT id, count(*) AS n, count(ans) AS read, count(DISTINCT ans) AS kinds, min(ans) AS one FROM pool GROUP BY id)
SELECT round(1 - sum(read) / sum(n), 6) AS none_ratio, round(avg(kinds), 6) AS uniq_answers, round(avg(CASE WHEN kinds = 1 AND one NOT IN (0, 1) THEN 1.0 ELSE 0.0 END), 6) AS unanimous FROM e""")(lambda spark, sf: metrics.diversity(li(spark, sf)[0]))

AUC = """rows_ AS (SELECT pool.*, coalesce(ans = gold, false) AS hit FROM pool JOIN gold USING (id) WHERE score IS NOT NULL),
pairs_ AS (SELECT p.id, count(*) AS pairs, sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS u FROM rows_ p JOIN rows_ n ON p.id = n.id AND p.hit AND NOT n.hit GROUP BY p.id)"""
query("pairwise_auc", f"""WITH {S.EV}, maj AS ({S.RULES['majority']}), {AUC}, sl AS (SELECT id, CASE WHEN answer = gold THEN 'majority_right' ELSE 'majority_wrong' END AS slice FROM maj JOIN gold USING (id))
SELECT 'all' AS slice, sum(pairs) AS pairs, round(sum(u) / sum(pairs), 6) AS auc FROM pairs_ UNION ALL SELECT slice, sum(pairs), round(sum(u) / sum(pairs), 6) FROM pairs_ JOIN sl USING (id) GROUP BY slice""")(
    lambda spark, sf: metrics.pairwise_auc(*ev(spark, sf), slices=metrics.majority_slices(*ev(spark, sf)))
)

ARMS = ["majority", "no_trunc", "median_length", "logp_soft"]
query("mcnemar_pairs", f"""WITH {S.LI}, arms AS ({S.arms(ARMS)}), n AS (SELECT count(DISTINCT id) AS n FROM arms),
t AS (SELECT a.arm AS x, b.arm AS y, count(*) FILTER (a.ok AND NOT b.ok) AS b, count(*) FILTER (b.ok AND NOT a.ok) AS c FROM arms a JOIN arms b ON a.id = b.id AND a.arm < b.arm GROUP BY 1, 2)
SELECT x, y, b, c, round((b - c) / n, 4) AS diff, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp({S.CHOOSE.format('(t.b + t.c)', 'i')} - (t.b + t.c) * ln(2))) FROM (SELECT unnest(range(0, least(t.b, t.c) + 1)) AS i))) END, 4) AS p FROM t, n""")(
    lambda spark, sf: metrics.mcnemar(metrics.arms_of(*li(spark, sf), rules=ARMS))
)
query("mcnemar_pooled", f"""WITH {S.LI}, arms AS ({S.arms(ARMS)}),
t AS (SELECT count(*) FILTER (a.ok AND NOT b.ok) AS b, count(*) FILTER (b.ok AND NOT a.ok) AS c FROM arms a JOIN arms b ON a.id = b.id AND (a.arm, b.arm) IN (('majority', 'no_trunc'), ('median_length', 'logp_soft')))
SELECT b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp({S.CHOOSE.format('(t.b + t.c)', 'i')} - (t.b + t.c) * ln(2))) FROM (SELECT unnest(range(0, least(t.b, t.c) + 1)) AS i))) END, 5) AS p FROM t""")(
    lambda spark, sf: metrics.mcnemar_pooled(metrics.arms_of(*li(spark, sf), rules=ARMS), [("majority", "no_trunc"), ("median_length", "logp_soft")])
)
query("arm_union_intersect", f"""WITH {S.LI}, arms AS ({S.arms(ARMS)}), e AS (SELECT id, max(CAST(ok AS INT)) AS one, min(CAST(ok AS INT)) AS every FROM arms GROUP BY id)
SELECT round(avg(one), 4) AS union_acc, round(avg(every), 4) AS intersect_acc FROM e""")(lambda spark, sf: metrics.union_intersection(metrics.arms_of(*li(spark, sf), rules=ARMS)))

query("rule_league", f"""WITH {S.EV_WHOLE.replace('gold AS', 'truth AS')}, {S.few(16, 5, 'whole')}, pool AS (SELECT id * 100 + trial AS id, j, ans, score, trunc, logp, text FROM few), gold AS (SELECT DISTINCT id, (id // 100) % 5 AS gold FROM pool),
arms AS ({S.arms(list(S.RULES))}), a AS (SELECT arm, avg(CAST(ok AS INT)) AS acc FROM arms GROUP BY arm), b AS (SELECT acc AS base FROM a WHERE arm = 'majority'),
t AS (SELECT avg(CASE WHEN n_correct > 0 THEN 1.0 ELSE 0.0 END) AS top FROM ({S.SOLVED}))
SELECT arm, round(acc, 4) AS acc, round(acc - base, 4) AS gain, CASE WHEN top > base THEN round((acc - base) / (top - base), 4) ELSE 0.0 END AS recovered FROM a, b, t""")(lambda spark, sf: metrics.league(*ev(spark, sf), m=16, trials=5))

SWEEP = {"orm_mean": ("score", "mean"), "orm_max": ("score", "max"), "logp_mean": ("logp", "mean")}
_SWEEP_SQL = " UNION ALL ".join(
    f"SELECT '{tag}' AS tag, CAST({g} AS DOUBLE) AS gamma, round(avg(CASE WHEN answer = gold THEN 1.0 ELSE 0.0 END), 4) AS acc FROM ({S.sampled_pick(g, column, how)}) JOIN gold USING (id)"
    for tag, (column, how) in SWEEP.items() for g in metrics.GAMMAS
)
query("gamma_sweep", f"WITH {S.sampled(S.EV_WHOLE, 16, 5)} {_SWEEP_SQL}")(lambda spark, sf: metrics.gamma_sweep(*ev(spark, sf), SWEEP, 16, 5))
query("gamma_best", f"WITH {S.sampled(S.EV_WHOLE, 16, 5)}, s AS ({_SWEEP_SQL}) SELECT * FROM s ORDER BY acc DESC, gamma, CASE tag WHEN 'orm_mean' THEN 0 WHEN 'orm_max' THEN 1 ELSE 2 END LIMIT 1")(
    lambda spark, sf: metrics.best_of_sweep(metrics.gamma_sweep(*ev(spark, sf), SWEEP, 16, 5), list(SWEEP))
)

query("rescue_break", f"""WITH {S.sampled(S.LI_WHOLE, 4, 5)}, a AS ({S.sampled_pick(0.0, 'score', 'mean')}), b AS ({S.sampled_pick(2.0, 'score', 'mean')}),
r AS (SELECT coalesce(a.answer = gold, false) AS r0, coalesce(b.answer = gold, false) AS r1 FROM a JOIN b USING (id, trial) JOIN gold USING (id)),
c AS (SELECT count(*) AS cells, count(*) FILTER (NOT r0) AS w, count(*) FILTER (r0) AS g, count(*) FILTER (NOT r0 AND r1) AS s, count(*) FILTER (r0 AND NOT r1) AS x FROM r)
SELECT round(w / 5, 4) AS wrong, round(g / 5, 4) AS "right", round(s / 5, 4) AS rescued, round(x / 5, 4) AS broken, round((s - x) / cells, 4) AS net FROM c""")(lambda spark, sf: metrics.sampled_rescue_break(*li(spark, sf), 2.0, m=4, trials=5))
query("rescue_break_whole", f"""WITH {S.LI}, a AS ({S.RULES['majority']}), b AS ({S.fused(2.0, 'mean')}), r AS (SELECT coalesce(a.answer = gold, false) AS r0, coalesce(b.answer = gold, false) AS r1 FROM a JOIN b USING (id) JOIN gold USING (id))
SELECT count(*) FILTER (NOT r0) AS wrong, count(*) FILTER (r0) AS "right", count(*) FILTER (NOT r0 AND r1) AS rescued, count(*) FILTER (r0 AND NOT r1) AS broken, count(*) FILTER (NOT r0 AND r1) - count(*) FILTER (r0 AND NOT r1) AS net FROM r""")(
    lambda spark, sf: metrics.rescue_break(voting.majority(li(spark, sf)[0]), voting.fused(li(spark, sf)[0], 2.0, "mean"), li(spark, sf)[1])
)
AUCS, SIM_GAMMAS = [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0], [0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 1e9]
query("fusion_sim", f"""WITH {S.EV}, {S.few(32, 5)}, u AS (SELECT few.*, gold, ({S.drawn_number('1125899906842624', "'42'", "'noise'", 'few.id', 'trial', 'j')} + 0.5::DOUBLE) / 1125899906842624 AS u FROM few JOIN gold USING (id)),
noisy AS (SELECT *, {S.normal_quantile('u')} AS noise FROM u), by_ AS (SELECT id, trial, gold, ans, count(*) AS n, avg(noise) AS noise FROM noisy WHERE ans IS NOT NULL GROUP BY ALL),
grid AS (SELECT auc, sqrt(2.0::DOUBLE) * {S.normal_quantile('(greatest(least(auc, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE))')} AS mu FROM (SELECT unnest({AUCS})::DOUBLE AS auc)), gammas AS (SELECT unnest({SIM_GAMMAS})::DOUBLE AS gamma),
votes AS (SELECT id, trial, gold, auc, gamma, ans, CASE WHEN gamma >= 1e8 THEN noise + CASE WHEN ans = gold THEN mu ELSE 0 END ELSE ln(n) + gamma * (noise + CASE WHEN ans = gold THEN mu ELSE 0 END) END AS weight FROM by_, grid, gammas),
best AS (SELECT *, row_number() OVER (PARTITION BY id, trial, auc, gamma ORDER BY round(weight, 9) DESC, ans) AS r FROM votes)
SELECT auc, gamma, round(count(*) FILTER (ans = gold) / (SELECT count(*) FROM (SELECT DISTINCT id, trial FROM noisy)), 4) AS acc FROM best WHERE r = 1 GROUP BY auc, gamma""")(
    lambda spark, sf: metrics.fusion_simulation(*ev(spark, sf), aucs=AUCS, gammas=SIM_GAMMAS)
)
query("vote_margin", f"""WITH {S.EV}, v AS (SELECT id, ans, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC) AS r FROM pool WHERE ans IS NOT NULL GROUP BY id, ans)
SELECT id, max(n) FILTER (r = 1) - coalesce(max(n) FILTER (r = 2), 0) AS margin FROM v GROUP BY id""")(lambda spark, sf: metrics.vote_margin(ev(spark, sf)[0]))
query("subsample_votes", f"""WITH {S.EV}, s AS (SELECT *, row_number() OVER (PARTITION BY id, trial ORDER BY {S.drawn("'42'", 'id', 'trial', 'j')}, j) AS rn FROM pool, (SELECT unnest(range(1, 4)) AS trial)),
few AS (SELECT * FROM s WHERE rn <= 16) {S.winner('SELECT id, trial, ans, count(*) AS weight FROM few GROUP BY ALL', keys='id, trial', ids='few')}""")(
    lambda spark, sf: metrics._by_trial(metrics.subsamples(ev(spark, sf)[0], 16, 3), voting.majority, ["trial"])
)
query("length_quantiles", """WITH l AS (SELECT length(text) AS v FROM documents), n AS (SELECT count(*) AS n, quantile_cont(v, 0.5) AS median, list_sort(list(v)) AS s FROM l)
SELECT n, median, s[CAST(floor(n * 0.5) AS BIGINT) + 1] AS upper_median, s[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95 FROM n""")(lambda spark, sf: metrics.quantiles(docs(spark, sf).withColumn("v", F.length("question")), "v"))
query("sample_stats", f"WITH {S.LI} SELECT count(*) AS samples, round(avg(CAST(trunc AS INT)), 6) AS trunc_ratio, round(avg(length(text)), 6) AS mean_chars, round(count(logp) / count(*), 6) AS logp_share FROM pool")(lambda spark, sf: metrics.length_stats(li(spark, sf)[0]))
query("cost_report", """SELECT round(sum(l_quantity) / sum(l_tax + 1), 4) AS tok_per_s, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) AS trunc_ratio, round(sum(l_partkey * 0.435 + l_quantity * 0.87) / 1e6, 6) AS cost FROM lineitem""")(
    lambda spark, sf: metrics.throughput(P.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("tokens_in"), F.col("l_quantity").alias("tokens_out"), (F.col("l_tax") + 1).alias("seconds"), F.lit(1).alias("samples"), (F.col("l_returnflag") == "R").cast("int").alias("truncated"), F.lit(0.435).alias("price_in"), F.lit(0.87).alias("price_out")))
)

# ---- selection ---------------------------------------------------------------------------------------------------
DIFF = "CASE WHEN n_correct = 0 THEN 'unsolved' WHEN n_correct / k < 0.25 THEN 'hard' WHEN n_correct / k < 0.5 THEN 'medium' ELSE 'easy' END"
QUOTA = "CASE WHEN n_correct = 0 THEN 0 WHEN n_correct / k >= 0.5 THEN 1 WHEN n_correct / k >= 0.25 THEN 2 ELSE least(n_correct, 4) END"
query("difficulty_kappa", f"""WITH {S.LI} SELECT {DIFF} AS difficulty, CAST({QUOTA} AS INT) AS quota, CASE WHEN n_correct = 0 THEN 'unsolved' WHEN n_correct <= 3 THEN 'hard' WHEN n_correct <= 7 THEN 'medium' ELSE 'easy' END AS bucket, count(*) AS n FROM ({S.SOLVED}) GROUP BY ALL""")(
    lambda spark, sf: metrics.solved(*li(spark, sf)).groupBy(selection.difficulty(F.col("n_correct"), F.col("k")).alias("difficulty"), selection.quota(F.col("n_correct"), F.col("k")).alias("quota"), selection.solved_bucket(F.col("n_correct")).alias("bucket")).agg(F.count("*").alias("n"))
)
query("rft_select", f"""WITH {S.LI}, r AS (SELECT pool.*, gold, coalesce(ans = gold, false) AS hit FROM pool JOIN gold USING (id)), c AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY id) AS n_correct, 8 AS k FROM r),
good AS (SELECT * FROM ({S.once("SELECT * FROM c WHERE hit AND length(text) >= 2")})),
med AS (SELECT *, list_sort(list(length(text)) OVER (PARTITION BY id))[CAST(floor(count(*) OVER (PARTITION BY id) / 2) AS BIGINT) + 1] AS med FROM good)
SELECT id, j, text, gold FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(length(text) - med), j) AS rn FROM med) WHERE rn <= {QUOTA}""")(lambda spark, sf: selection.rejection_sample(*li(spark, sf), k=8, min_chars=2))
query("rft_negatives", f"WITH {S.EV} SELECT id, j, text FROM pool JOIN gold USING (id) WHERE ans IS DISTINCT FROM gold")(lambda spark, sf: selection.negatives(*ev(spark, sf)))
query("median_outward", f"""WITH {S.EV}, r AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY length(text), j) - 1 AS rn FROM pool)
SELECT id, j FROM r WHERE (rn - CAST(floor(n / 2) AS BIGINT) + n) % n < 2""")(lambda spark, sf: selection.median_outward(ev(spark, sf)[0], 2).select("id", "j"))
query("round_robin_reps", f"""WITH {S.EV}, r AS (SELECT *, row_number() OVER (PARTITION BY id, ans ORDER BY j) AS r, count(*) OVER (PARTITION BY id, ans) AS size, min(j) OVER (PARTITION BY id, ans) AS f FROM pool),
o AS (SELECT id, j, ans, row_number() OVER (PARTITION BY id ORDER BY r, size DESC, f) AS place FROM r) SELECT * FROM o WHERE place <= 8""")(lambda spark, sf: selection.round_robin(ev(spark, sf)[0], 8))
query("balanced_pairs", f"""WITH {S.EV}, maj AS ({S.RULES['majority']}), r AS (SELECT pool.*, CAST(ans = gold AS INT) AS label FROM pool JOIN gold USING (id) WHERE NOT trunc AND ans IS NOT NULL AND length(text) >= 4),
c AS (SELECT *, sum(label) OVER (PARTITION BY id) AS p, sum(1 - label) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id, label ORDER BY {S.drawn("'42'", 'id', 'j')}, j) AS rn FROM r)
SELECT c.id, j, text, label, answer IS DISTINCT FROM gold AND answer IS NOT NULL AS maj_wrong FROM c JOIN maj ON maj.id = c.id JOIN gold ON gold.id = c.id WHERE rn <= least(p, n, 3)""")(
    lambda spark, sf: selection.balanced_pairs(*ev(spark, sf), voting.majority(ev(spark, sf)[0]).join(ev(spark, sf)[1], "id").select("id", F.coalesce(F.col("answer") != F.col("gold"), F.lit(False)).alias("maj_wrong")), min_chars=4)
)
query("bucket_limit", f"""WITH {DOCS}, r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY {S.drawn("'42'", 'id')}, id) AS rn FROM docs) SELECT id, source FROM r WHERE rn <= 5""")(lambda spark, sf: selection.per_bucket(docs(spark, sf).select("id", "source"), "source", 5))
query("seeded_draw", f"WITH {DOCS} SELECT id, source FROM docs ORDER BY {S.drawn(chr(39) + '42' + chr(39), 'id')}, id LIMIT 50")(lambda spark, sf: selection.draw(docs(spark, sf).select("id", "source"), 50))
query("shard", f"WITH {DOCS} SELECT id, source FROM (SELECT id, source, row_number() OVER (ORDER BY {S.drawn(chr(39) + '42' + chr(39), 'id')}, id) - 1 AS place FROM docs) WHERE place % 4 = 1")(lambda spark, sf: selection.shard(docs(spark, sf).select("id", "source"), 1, 4))
query("easy_downsample", f"""WITH {S.LI}, s AS ({S.SOLVED}), m AS (SELECT max(n_correct) AS most FROM s)
SELECT id, k, n_correct AS n_solved FROM s, m WHERE NOT coalesce(n_correct / nullif(most, 0) >= 0.5, false) OR {S.drawn_number('1073741824', "'42'", 'id')} / 1073741824 < 0.3""")(lambda spark, sf: selection.thinned(metrics.solved(*li(spark, sf)).withColumnRenamed("n_correct", "n_solved"), 0.3))

# ---- cleaning ----------------------------------------------------------------------------------------------------
PATTERN_CASES = " ".join(f"WHEN regexp_matches(question, '{p}', 'i') THEN '{n}'" for n, p in prep.DROP_PATTERNS.items())
LISTS = "bad AS (SELECT doc_id AS id FROM labels WHERE quality = 0), held AS (SELECT doc_id AS id FROM labels WHERE toxic = 1)"


def _lists(spark, sf):
    labels = P.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return labels.where("quality = 0").select("id"), labels.where("toxic = 1").select("id")


query("drop_patterns", f"""WITH pages_ AS (SELECT page_id AS id, html AS question FROM pages), {LISTS}
SELECT CASE WHEN id IN (FROM bad) THEN 'bad_id' WHEN id IN (FROM held) THEN 'quarantined' {PATTERN_CASES} END AS reason, count(*) AS n FROM pages_ GROUP BY ALL""")(
    lambda spark, sf: prep.drop_reason(P.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("question")), *_lists(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))
)
query("exclusion_counts", f"""WITH {LISTS} SELECT 'bad' AS list, count(DISTINCT id) AS total, count(DISTINCT id) AS new FROM bad
UNION ALL SELECT 'held', count(DISTINCT id), count(DISTINCT id) FILTER (id NOT IN (FROM bad)) FROM held""")(lambda spark, sf: prep.exclusion_counts(dict(zip(("bad", "held"), _lists(spark, sf), strict=True))))
query("quarantine_minus_bad", f"WITH {LISTS} SELECT id FROM held WHERE id NOT IN (FROM bad)")(lambda spark, sf: prep.quarantine(*_lists(spark, sf)))

TAILS = ["'  Translate the above text into English, please'", "' And output the translation result directly.'", "chr(10) || chr(10) || chr(10) || chr(10) || 'x '", "''"]
NESTED = "question"
for _p in prep.SANITIZE_PATTERNS:
    NESTED = f"regexp_replace({NESTED}, '{_p}', '', 'gi')"
query("sanitize", f"""WITH t AS (SELECT item_id AS id, text || CASE item_id % 4 WHEN 0 THEN {TAILS[0]} WHEN 1 THEN {TAILS[1]} WHEN 2 THEN {TAILS[2]} ELSE {TAILS[3]} END AS question FROM benchmark)
SELECT id, md5(regexp_replace(regexp_replace({NESTED}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS clean FROM t""")(
    lambda spark, sf: P.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.md5(prep.sanitized(F.concat("text", F.when(F.col("item_id") % 4 == 0, "  Translate the above text into English, please").when(F.col("item_id") % 4 == 1, " And output the translation result directly.").when(F.col("item_id") % 4 == 2, "\n\n\n\nx ").otherwise("")))).alias("clean"))
)
query("filter_funnel", f"""WITH {DOCS} SELECT CASE WHEN NOT length(question) BETWEEN 40 AND 1200 THEN 'length' WHEN lang <> 'en' THEN 'language' WHEN regexp_matches(question, '[|]') THEN 'table' ELSE 'kept' END AS reason, count(*) AS n FROM docs GROUP BY ALL""")(
    lambda spark, sf: prep.funnel_counts(prep.funnel(docs(spark, sf), [("length", F.length("question").between(40, 1200)), ("language", F.col("lang") == "en"), ("table", ~F.col("question").rlike("[|]"))]))
)
FP = "left(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), 200)"
query("fingerprint_decontam", f"""WITH {DOCS}, h AS (SELECT DISTINCT {FP.format('text')} AS fp FROM documents WHERE doc_id % 10 = 0)
SELECT id, source FROM docs WHERE {FP.format('question')} = '' OR {FP.format('question')} NOT IN (SELECT fp FROM h)""")(
    lambda spark, sf: prep.decontaminated(docs(spark, sf), docs(spark, sf).where("id % 10 = 0")).select("id", "source")
)
query("capped_ids", f"WITH {DOCS}, r AS (SELECT id AS doc, source, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS rn FROM docs) SELECT source || '-' || lpad(CAST(rn AS VARCHAR), 7, '0') AS id, doc FROM r WHERE rn < 30")(
    lambda spark, sf: prep.capped_ids(docs(spark, sf).withColumn("doc", F.col("id")), "source", "doc", 30).select("id", "doc")
)
query("source_counts", f"WITH {DOCS} SELECT source, count(*) AS n, round(avg(CASE WHEN regexp_matches(question, '[|]') THEN 1.0 ELSE 0.0 END), 6) AS share FROM docs GROUP BY source")(
    lambda spark, sf: docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("question").rlike("[|]").cast("double")), 6).alias("share"))
)
query("stratified_split", f"""WITH {DOCS}, s AS (SELECT id, length(question) AS size, CASE WHEN regexp_matches(question, '\\$|\\\\frac|\\\\text|\\\\sqrt') THEN 1 ELSE 0 END AS tex FROM docs),
e AS (SELECT list_distinct(list_filter(list_value(quantile_cont(size, 0.25), quantile_cont(size, 0.5), quantile_cont(size, 0.75)), lambda x: x > min(size))) AS e, count(*) AS total FROM s),
r AS (SELECT s.*, total, len(list_filter(e, lambda x: x < size)) || '_' || tex AS stratum FROM s, e),
c AS (SELECT stratum, least(CAST(round_even(200 * count(*) / max(total), 0) AS BIGINT), count(*)) AS k FROM r GROUP BY stratum),
o AS (SELECT r.*, row_number() OVER (PARTITION BY stratum ORDER BY {S.drawn("'42'", 'id')}, id) <= k AS chosen FROM r JOIN c USING (stratum)),
v AS (SELECT id FROM o ORDER BY chosen DESC, {S.drawn("'42'", 'id')}, id LIMIT 200)
SELECT id, stratum, CASE WHEN id IN (FROM v) THEN 'val' ELSE 'train' END AS part FROM r""")(lambda spark, sf: selection.stratified_split(docs(spark, sf), 200))
query("profile", f"WITH {DOCS} SELECT count(*) AS n, quantile_cont(length(question), 0.5) AS len_median, round(avg(length(question)), 1) AS len_mean, round(avg(CASE WHEN regexp_matches(question, '\\$|\\\\frac|\\\\text') THEN 1.0 ELSE 0.0 END), 4) AS tex_ratio FROM docs")(
    lambda spark, sf: prep.profile(docs(spark, sf))
)
query("resume_anti", f"WITH {DOCS} SELECT id, source FROM docs WHERE id NOT IN (SELECT doc_id FROM labels)")(lambda spark, sf: prep.resumed(docs(spark, sf).select("id", "source"), P.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")))
query("replay_mix", f"""WITH {DOCS}, k AS (SELECT id, 'teacher' AS src FROM docs WHERE lang = 'fr'), p AS (SELECT id FROM docs WHERE lang = 'de'), n AS (SELECT CAST(floor(count(*) * 0.4 / 0.6) AS BIGINT) AS n FROM k),
r AS (SELECT id, row_number() OVER (ORDER BY {S.drawn("'42'", 'id')}, id) AS rn FROM p) SELECT * FROM k UNION ALL SELECT id, 'replay' FROM r, n WHERE rn <= n""")(
    lambda spark, sf: prep.replay_mix(docs(spark, sf).where("lang = 'fr'").select("id", F.lit("teacher").alias("src")), docs(spark, sf).where("lang = 'de'").select("id", F.lit("x").alias("src")), 0.4)
)

# ---- parsing -----------------------------------------------------------------------------------------------------
N = "CAST(o_custkey AS BIGINT)"
query("extract_rendered", f"SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 6 THEN CASE WHEN {N} % 7 = 0 THEN CAST({N} // 7 AS VARCHAR) END WHEN 7 THEN CAST(-{N} AS VARCHAR) ELSE CAST({N} AS VARCHAR) END AS answer FROM orders")(
    lambda spark, sf: P.rendered(spark, sf).select("id", A.extract_answer(F.col("text")).alias("answer"))
)
query("last_number", r"""WITH t AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?'), lambda x: replace(x, ',', '')) AS a FROM documents),
k AS (SELECT id, list_filter(list_transform(a, lambda x: CASE WHEN regexp_full_match(x, '-?\d+') THEN CASE WHEN regexp_full_match(x, '-?0+') THEN '0' ELSE regexp_replace(x, '^(-?)0+(\d)', '\1\2') END
  WHEN abs(TRY_CAST(x AS DOUBLE)) <= 1e17 AND abs(TRY_CAST(x AS DOUBLE) - round_even(TRY_CAST(x AS DOUBLE), 0)) < 1e-9 THEN CAST(CAST(round_even(TRY_CAST(x AS DOUBLE), 0) AS HUGEINT) AS VARCHAR) END), lambda x: x IS NOT NULL) AS k FROM t)
SELECT id, k[-1] AS answer FROM k""")(lambda spark, sf: docs(spark, sf).select("id", A.last_number(F.col("question")).alias("answer")))
query("path_hash", f"SELECT doc_id AS id, md5({S.PATH}) AS path FROM documents")(lambda spark, sf: docs(spark, sf).select("id", F.md5(A.path_hash(F.col("question"))).alias("path")))
query("cause_histogram", f"""WITH o AS (SELECT o_orderkey % 8 AS k, {N} AS n, o_custkey % 2 = 0 AS cut FROM orders),
c AS (SELECT CASE WHEN cut THEN 'truncated' WHEN k IN (4, 5) THEN 'no_box' WHEN k = 6 AND n % 7 <> 0 THEN 'box_unparsed' ELSE 'wrong_answer' END AS cause FROM o)
SELECT cause, count(*) AS n FROM c GROUP BY cause""")(
    lambda spark, sf: P.rendered(spark, sf).join(P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2 == 0).alias("cut")), "id").groupBy(A.wrong_cause(F.col("text"), F.col("cut"), A.extract_answer(F.col("text"))).alias("cause")).agg(F.count("*").alias("n"))
)
query("solution_integer", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 IN (0, 3, 5) THEN CAST({N} AS VARCHAR) WHEN o_orderkey % 8 = 2 THEN '1' END AS answer FROM orders")(
    lambda spark, sf: P.rendered(spark, sf).select("id", A.final_integer(F.col("text")).alias("answer"))
)
RENDERED = f"""rendered AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS n, CASE o_orderkey % 8 WHEN 0 THEN 'We add up. \\boxed{{' || o_custkey || '}}' WHEN 1 THEN 'So \\boxed{{\\frac{{' || {N} * 2 || '}}{{2}}}} holds'
  WHEN 2 THEN '\\boxed{{1}} then \\boxed{{' || o_custkey || '.0}}' WHEN 3 THEN '\\fbox{{' || format('{{:,}}', {N}) || '\\text{{ units}}}}' WHEN 4 THEN 'We get 3 + 4 = 7. The answer is ' || o_custkey || '.'
  WHEN 5 THEN 'first 12' || chr(10) || 'then ' || o_custkey WHEN 6 THEN '\\boxed{{' || o_custkey || '/7}}' ELSE '\\boxed{{-' || o_custkey || ' cm^2}}' END AS text FROM orders)"""
query("with_box", f"""WITH {RENDERED} SELECT id, md5(text || CASE WHEN id % 8 IN (3, 4, 5) THEN chr(10) || chr(10) || 'The final answer is \\boxed{{' || n || '}}.' ELSE '' END) AS boxed FROM rendered""")(
    lambda spark, sf: P.rendered(spark, sf).select("id", F.md5(A.with_box(F.col("text"), F.col("truth"))).alias("boxed"))
)
query("model_tag", """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'model' ELSE regexp_replace(p_brand || ' ' || p_type, '[^A-Za-z0-9._-]', '_', 'g') END AS tag FROM part""")(
    lambda spark, sf: P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), A.model_tag(F.when(F.col("p_partkey") % 3 == 0, "/").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("out/models/"), "p_brand", F.lit(" "), "p_type")).otherwise(F.concat("p_brand", F.lit(" "), "p_type", F.lit("//")))).alias("tag"))
)
_EARLY = "CASE o_orderkey % 4 WHEN 0 THEN 'It is ' || o_custkey || ', as' || repeat(' we see', 12) WHEN 1 THEN repeat('we see ', 12) || o_custkey WHEN 2 THEN 'Say 1.' || o_custkey || ' or ' || o_custkey || '7' || repeat(' we see', 30) ELSE 'n=' || o_custkey || '.5' || repeat(' we see', 12) END"
query("early_answer", f"""WITH t AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS n, {_EARLY} AS text FROM orders)
SELECT id, length(n) >= 3 AND regexp_matches(left(text, CAST(floor(length(text) * 0.25) AS BIGINT)), '(^|[^0-9.])' || n || '($|[^0-9.])') AS early FROM t""")(
    lambda spark, sf: P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("n"), F.expr(_EARLY).alias("text")).select("id", A.early_answer(F.col("text"), F.col("n")).alias("early"))
)
query("generation_messages", """SELECT item_id AS id, 2 AS n, md5('You are a careful mathematician. You always finish with a final integer answer.') AS system,
md5('Solve the following math problem step by step. The answer is a single integer. Put your final answer in \\boxed{}.' || chr(10) || chr(10) || coalesce(text, '')) AS "user" FROM benchmark""")(
    lambda spark, sf: P.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), prompts.generation_messages(F.col("text")).alias("m")).select("id", F.size("m").alias("n"), F.md5(F.col("m")[0]["content"]).alias("system"), F.md5(F.col("m")[1]["content"]).alias("user"))
)
query("shown_answers", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '(none)' WHEN o_orderkey % 3 = 1 THEN '-' || o_custkey ELSE '(' || 3 * length(CAST(o_orderkey AS VARCHAR) || '0000000') || ' digits)' END AS shown FROM orders""")(
    lambda spark, sf: P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), prompts.shown_answer(F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-"), "o_custkey")).when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("-"), F.repeat(F.concat("o_orderkey", F.lit("0000000")), F.lit(3))))).alias("shown"))
)
query("token_budget", "SELECT doc_id AS id, CASE WHEN n_chars <= 500 THEN CAST(doc_id AS DOUBLE) / 2 ELSE -20.0 END AS orm FROM documents")(
    lambda spark, sf: P.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), prompts.within_budget(F.col("n_chars"), 500, F.col("doc_id") / 2).alias("orm"))
)
query("external_solutions", f"""WITH {RENDERED}, x AS (SELECT id, 'How many are there in part ' || id || ' of the store' || repeat(', if any', id % 5) AS question, repeat('First we look closely at it. ', CAST(id % 7 AS INT)) || text AS solution FROM rendered),
r AS (SELECT x.id, CASE WHEN NOT length(question) BETWEEN 40 AND 1200 THEN 'question_length' WHEN NOT length(solution) BETWEEN 60 AND 2400 THEN 'solution_length' WHEN NOT x.id % 8 IN (0, 2, 3, 5) THEN 'not_integer' WHEN x.id % 9 = 0 THEN 'held_out' END AS reason FROM x)
SELECT coalesce(reason, 'taken') AS reason, count(*) AS n FROM r GROUP BY ALL""")(
    lambda spark, sf: prep.external_solutions(_external(spark, sf), _external(spark, sf).where("id % 9 = 0"), solution=(60, 2400)).groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))
)


def _external(spark, sf):
    text = P.rendered(spark, sf)
    question = F.concat(F.lit("How many are there in part "), "id", F.lit(" of the store"), F.repeat(F.lit(", if any"), (F.col("id") % 5).cast("int")))
    return text.select("id", question.alias("question"), F.concat(F.repeat(F.lit("First we look closely at it. "), (F.col("id") % 7).cast("int")), "text").alias("solution"))


# ---- audits and gates --------------------------------------------------------------------------------------------
LABELS = "labels_ AS (SELECT id, id % 5 AS current, CASE WHEN id % 3 > 0 THEN id % 4 END AS suggested FROM gold)"
AGREE = f"maj AS ({S.RULES['majority']}), agree AS (SELECT maj.id, answer AS mode, (SELECT count(*) FROM pool p WHERE p.id = maj.id AND p.ans = answer) AS votes, (SELECT count(*) FROM pool p WHERE p.id = maj.id) AS n FROM maj)"


def _labels(pool):
    return pool.select("id").distinct().select("id", (F.col("id") % 5).alias("current"), F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("suggested"))


def _verdict(th: str) -> str:
    return f"CASE WHEN votes / n >= {th} AND mode = suggested THEN 'relabel' WHEN votes / n >= {th} AND mode = current THEN 'keep' ELSE 'drop' END"


query("consensus_verdicts", f"WITH {S.EV}, {LABELS}, {AGREE}, v AS (SELECT id, {_verdict('0.2')} AS verdict, mode FROM agree JOIN labels_ USING (id)) SELECT id, verdict, CASE WHEN verdict <> 'drop' THEN mode END AS final FROM v")(lambda spark, sf: audit.verdicts(ev(spark, sf)[0], _labels(ev(spark, sf)[0]), 0.2))
query("consensus_sweep", f"""WITH {S.LI}, {LABELS}, c AS (SELECT id, ans, count(*) AS votes FROM pool WHERE ans IS NOT NULL GROUP BY id, ans), t AS (SELECT id, count(*) AS n FROM pool GROUP BY id),
agree AS (SELECT t.id, ans AS mode, coalesce(votes, 0) AS votes, n FROM t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, ans) AS r FROM c) b ON b.id = t.id AND r = 1),
v AS (SELECT threshold, {_verdict('threshold')} AS verdict FROM agree JOIN labels_ USING (id), (SELECT unnest([1.0, 0.95, 0.9, 0.85, 0.75, 0.6, 0.5]) AS threshold))
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (verdict = 'relabel') AS relabel, count(*) FILTER (verdict = 'keep') AS keep, count(*) FILTER (verdict = 'drop') AS "drop", round(count(*) FILTER (verdict <> 'drop') / count(*), 4) AS rate FROM v GROUP BY threshold""")(
    lambda spark, sf: audit.verdict_sweep(li(spark, sf)[0], _labels(li(spark, sf)[1]))
)
query("third_value", f"WITH {S.EV}, {LABELS}, {AGREE} SELECT count(*) AS n, count(*) FILTER (mode IS NOT NULL AND mode IS DISTINCT FROM suggested AND mode IS DISTINCT FROM current) AS third_value FROM agree JOIN labels_ USING (id)")(lambda spark, sf: audit.third_values(ev(spark, sf)[0], _labels(ev(spark, sf)[0])))
query("label_suspect", f"WITH {S.LI}, e AS (SELECT id, count(*) AS n, count(ans) AS r, count(DISTINCT ans) AS d, min(ans) AS m FROM pool GROUP BY id) SELECT id, gold, m AS model_unanimous FROM e JOIN gold USING (id) WHERE n = r AND d = 1 AND m <> gold")(lambda spark, sf: audit.suspects(*li(spark, sf)))
query("audit_scope", f"""WITH {S.LI}, maj AS ({S.RULES['majority']}), d AS (SELECT id, n_correct = 0 AS dead FROM ({S.SOLVED})) SELECT id, gold, answer AS our_maj, dead FROM maj JOIN gold USING (id) JOIN d USING (id) WHERE answer IS DISTINCT FROM gold""")(lambda spark, sf: audit.scope(*li(spark, sf)))


def _teacher(pool):
    return pool.where("NOT trunc")


query("three_way_audit", f"""WITH {S.LI}, maj AS ({S.RULES['majority']}), cases AS (SELECT id, gold, answer AS our_maj FROM maj JOIN gold USING (id) WHERE answer IS DISTINCT FROM gold), t AS ({S.winner('SELECT id, ans, count(*) AS weight FROM pool WHERE NOT trunc GROUP BY id, ans', ids='(SELECT * FROM pool WHERE NOT trunc)')})
SELECT CASE WHEN answer IS NULL THEN 'teacher_unread' WHEN answer = gold THEN 'teacher_is_gold' WHEN answer = our_maj THEN 'teacher_is_ours' ELSE 'undecided' END AS verdict, count(*) AS n FROM cases JOIN t USING (id) GROUP BY ALL""")(
    lambda spark, sf: audit.three_way(audit.scope(*li(spark, sf)), _teacher(li(spark, sf)[0]))
)
query("refine_lift", f"""WITH {S.LI}, o AS (SELECT * FROM pool WHERE j % 2 = 0), f AS (SELECT * FROM pool WHERE j % 2 = 1), maj AS ({S.winner('SELECT id, ans, count(*) AS weight FROM o GROUP BY id, ans', ids='o')}),
b AS (SELECT id, max(CASE WHEN ans = gold THEN 1 ELSE 0 END) AS before, list(DISTINCT ans) AS seen FROM o JOIN gold USING (id) GROUP BY id),
e AS (SELECT f.id, max(before) AS before, max(CASE WHEN f.ans = gold THEN 1 ELSE 0 END) AS after, count(*) AS n, count(*) FILTER (f.ans IS NOT NULL AND NOT coalesce(list_contains(seen, f.ans), false)) AS new, count(*) FILTER (f.ans IS NOT NULL AND f.ans IS DISTINCT FROM maj.answer) AS other
  FROM f JOIN b ON b.id = f.id JOIN gold ON gold.id = f.id JOIN maj ON maj.id = f.id GROUP BY f.id)
SELECT count(*) AS ids, sum(before) AS pass0, sum(1 - before) AS dead, sum((1 - before) * after) AS rescued, sum(n) AS refined, round(sum(new) / sum(n), 6) AS new_rate, round(sum(other) / sum(n), 6) AS other_rate, round((sum(before) + sum((1 - before) * after)) / count(*), 6) AS union_pass FROM e""")(
    lambda spark, sf: audit.refine_lift(li(spark, sf)[0].where("j % 2 = 0"), li(spark, sf)[0].where("j % 2 = 1"), li(spark, sf)[1])
)
BUCKETS = "buckets AS (SELECT id, CASE id % 3 WHEN 0 THEN 'unsolved' WHEN 1 THEN 'hard' ELSE 'medium' END AS bucket FROM gold)"


def _buckets(gold):
    return gold.select("id", F.when(F.col("id") % 3 == 0, "unsolved").when(F.col("id") % 3 == 1, "hard").otherwise("medium").alias("bucket"))


query("teacher_yield", f"""WITH {S.EV}, {BUCKETS}, r AS (SELECT bucket, pool.*, coalesce(ans = gold, false) AS hit FROM pool JOIN gold USING (id) JOIN buckets USING (id)), e AS (SELECT bucket, id, sum(CAST(hit AS INT)) AS ok FROM r GROUP BY ALL),
c AS (SELECT bucket, list_sort(list(length(text))) AS l FROM r WHERE hit GROUP BY bucket)
SELECT bucket, count(*) AS n, count(*) FILTER (ok > 0) AS any_correct, count(*) FILTER (ok >= 2) AS repeated, max(l[CAST(floor(len(l) / 2) AS BIGINT) + 1]) AS median_chars FROM e LEFT JOIN c USING (bucket) GROUP BY bucket""")(
    lambda spark, sf: audit.teacher_yield(*ev(spark, sf), _buckets(ev(spark, sf)[1]))
)
query("repeat_histogram", f"""WITH {S.LI}, {BUCKETS}, e AS (SELECT bucket, id, count(*) FILTER (ans = gold) AS n_ok FROM pool JOIN gold USING (id) JOIN buckets USING (id) GROUP BY ALL) SELECT bucket, n_ok, count(*) AS ids FROM e GROUP BY ALL""")(lambda spark, sf: audit.repeat_histogram(*li(spark, sf), _buckets(li(spark, sf)[1])))

SUB = "sub AS (SELECT id, CASE id % 50 WHEN 7 THEN NULL WHEN 8 THEN '1.5' ELSE CAST(gold AS VARCHAR) END AS answer FROM gold WHERE id % 40 <> 3 UNION ALL SELECT -1, '5')"


def _sub(gold):
    own = gold.where("id % 40 <> 3").select("id", F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 50 == 8, "1.5").otherwise(F.col("gold").cast("string")).alias("answer"))
    return own.unionByName(own.sparkSession.createDataFrame([(-1, "5")], "id long, answer string"))


query("submission_check", f"""WITH {S.LI}, {SUB}, f AS (SELECT count(*) AS rows_, count(*) FILTER (answer IS NULL) AS nul, count(*) FILTER (answer IS NOT NULL AND NOT regexp_full_match(answer, '-?\\d+')) AS nonint, count(*) FILTER (TRY_CAST(answer AS DOUBLE) = 0) AS z, count(DISTINCT answer) AS d, count(*) - count(DISTINCT id) AS rep FROM sub),
m AS (SELECT count(*) AS m FROM gold WHERE id NOT IN (SELECT id FROM sub)), x AS (SELECT count(*) AS x FROM sub WHERE id NOT IN (SELECT id FROM gold)), r AS (SELECT count(*) AS r FROM gold),
e AS (SELECT unnest(['row_count_gap', 'missing_id', 'extra_id', 'repeated_id', 'null_answer', 'not_integer']) AS "check", unnest([abs(rows_ - r), m, x, rep, nul, nonint]) AS n FROM f, m, x, r)
SELECT "check", CASE WHEN n > 0 THEN 'error' ELSE 'ok' END AS severity, n FROM e UNION ALL SELECT 'zero', CASE WHEN z > rows_ * 0.03 THEN 'warn' ELSE 'ok' END, z FROM f UNION ALL SELECT 'distinct_answers', 'info', d FROM f""")(
    lambda spark, sf: gates.submission_check(_sub(li(spark, sf)[1]), li(spark, sf)[1].select("id"))
)
query("distinct_envelope", f"""WITH t AS (SELECT o_orderkey AS id, o_custkey AS answer FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)), r AS (SELECT draw, answer, row_number() OVER (PARTITION BY draw ORDER BY {S.drawn("'0'", 'draw', 'id')}, id) AS rn FROM t, (SELECT unnest(range(1, 6)) AS draw)),
e AS (SELECT draw, count(DISTINCT answer) AS k FROM r WHERE rn <= 800 GROUP BY draw) SELECT min(k) AS least, max(k) AS most FROM e""")(
    lambda spark, sf: gates.distinct_envelope(P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("answer")).distinct(), 800, 5)
)
query("flip_gate", f"""WITH {S.EV}, a AS ({S.fused(0.5, 'mean')}), b AS ({S.RULES['majority']}), f AS (SELECT count(*) AS n, count(*) FILTER (a.answer IS DISTINCT FROM b.answer) AS flips FROM a JOIN b USING (id)) SELECT n, flips, flips > 0 AND flips <= n * 0.25 AS accepted FROM f""")(
    lambda spark, sf: gates.flips(voting.fused(ev(spark, sf)[0]), voting.majority(ev(spark, sf)[0]))
)
query("coverage_check", f"WITH {S.LI}, m AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM pool)), x AS (SELECT list(id ORDER BY id) AS examples FROM (SELECT id FROM m ORDER BY id LIMIT 3)) SELECT (SELECT count(*) FROM m) AS n, array_to_string(coalesce(examples, []), ',') AS examples FROM x")(
    lambda spark, sf: gates.uncovered(P.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), li(spark, sf)[0]).select("n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))
)
query("row_counts", f"WITH {S.LI} SELECT (SELECT count(DISTINCT id) FROM pool) AS generated, (SELECT count(DISTINCT id) FROM gold) AS asked, (SELECT count(DISTINCT id) FROM pool) = (SELECT count(DISTINCT id) FROM gold) AS complete")(lambda spark, sf: gates.row_counts(*li(spark, sf)))
query("input_check", f"WITH {DOCS} SELECT count(*) FILTER (question IS NULL) AS null_questions, count(*) - count(DISTINCT id) AS repeated_ids, count(*) FILTER (question IS NULL) = 0 AND count(*) = count(DISTINCT id) AS ok FROM docs")(lambda spark, sf: gates.input_check(docs(spark, sf)))
query("sampling_gates", f"""WITH {S.LI}, s AS ({S.SOLVED}) SELECT 'coverage' AS "check", avg(CASE WHEN n_correct > 0 THEN 1.0 ELSE 0.0 END) AS value, avg(CASE WHEN n_correct > 0 THEN 1.0 ELSE 0.0 END) BETWEEN 0.85 AND 0.94 AS ok FROM s
UNION ALL SELECT 'suspects', CAST(count(*) AS DOUBLE), count(*) < 500 FROM (SELECT id FROM pool GROUP BY id HAVING count(ans) = count(*) AND count(DISTINCT ans) = 1) JOIN gold USING (id) JOIN (SELECT id, min(ans) AS m FROM pool GROUP BY id) USING (id) WHERE m <> gold
UNION ALL SELECT 'training_rows', CAST(count(*) AS DOUBLE), count(*) >= 8000 FROM pool JOIN gold USING (id) WHERE ans = gold""")(
    lambda spark, sf: gates.sampling_gates(metrics.solved(*li(spark, sf)), audit.suspects(*li(spark, sf)).agg(F.count("*").alias("n")), li(spark, sf)[0].join(li(spark, sf)[1], "id").where("ans = gold").agg(F.count("*").alias("n")))
)


query("miss_upper", f"""WITH {S.LI}, t AS (SELECT id, j, ans, 'is ' || CAST(trunc(score) AS INT) % 5 || ' of ' || j AS text FROM pool), maj AS ({S.RULES['majority']}), w AS (SELECT id, gold FROM maj JOIN gold USING (id) WHERE answer IS DISTINCT FROM gold),
s AS (SELECT id, max(CASE WHEN regexp_matches(text, '(^|[^0-9.])' || gold || '($|[^0-9.])') THEN 1 ELSE 0 END) AS seen FROM t JOIN w USING (id) GROUP BY id), n AS (SELECT count(*) AS n FROM maj JOIN gold USING (id))
SELECT n, sum(seen) AS missed, round(sum(seen) / n, 4) AS miss_upper FROM s, n GROUP BY n""")(
    lambda spark, sf: metrics.missed_upper_bound(li(spark, sf)[0].withColumn("text", F.concat(F.lit("is "), (F.col("score").cast("int") % 5).cast("string"), F.lit(" of "), F.col("j").cast("string"))), voting.majority(li(spark, sf)[0]), li(spark, sf)[1])
)
query("failing_examples", f"""WITH {DOCS}, r AS (SELECT id, source AS cause, right(question, 600) AS tail, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM docs) SELECT id, cause, md5(tail) AS tail FROM r WHERE rn <= 3""")(
    lambda spark, sf: metrics.failing_examples(docs(spark, sf).select("id", F.col("source").alias("cause"), F.col("question").alias("text")), 3).withColumn("tail", F.md5("tail"))
)
query("id_differences", f"WITH {S.LI}, {SUB} SELECT 'missing' AS side, id FROM gold WHERE id NOT IN (SELECT id FROM sub) UNION ALL SELECT 'extra', id FROM sub WHERE id NOT IN (SELECT id FROM gold)")(lambda spark, sf: gates.id_differences(_sub(li(spark, sf)[1]), li(spark, sf)[1]))
query("reordered_submission", f"WITH {S.LI}, {SUB} SELECT g.id, coalesce(TRY_CAST(answer AS BIGINT), 0) AS answer FROM gold g LEFT JOIN (SELECT id, CASE WHEN regexp_full_match(answer, '-?\\d+') THEN answer END AS answer FROM sub) USING (id)")(
    lambda spark, sf: gates.reordered(_sub(li(spark, sf)[1]).withColumn("answer", F.when(F.col("answer").rlike(r"^-?\d+$"), F.col("answer").cast("long"))), li(spark, sf)[1].withColumn("ord", F.col("id")), "ord")
)
query("id_overlap", f"WITH {DOCS} SELECT count(*) AS both FROM (SELECT id FROM docs INTERSECT SELECT doc_id FROM labels)")(lambda spark, sf: docs(spark, sf).select("id").intersect(P.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))).agg(F.count("*").alias("both")))
query("fallback_rendered", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 6 THEN CAST(CAST(round_even({N} / 7.0, 0) AS BIGINT) AS VARCHAR) WHEN o_orderkey % 8 = 7 THEN CAST(-{N} AS VARCHAR) ELSE CAST({N} AS VARCHAR) END AS answer FROM orders")(
    lambda spark, sf: P.rendered(spark, sf).select("id", A.extract_or_fallback(F.col("text")).alias("answer"))
)
query("vote_margin_stats", f"""WITH {S.LI}, v AS (SELECT id, ans, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC) AS r FROM pool WHERE ans IS NOT NULL GROUP BY id, ans), m AS (SELECT id, max(n) FILTER (r = 1) - coalesce(max(n) FILTER (r = 2), 0) AS margin FROM v GROUP BY id)
SELECT quantile_cont(margin, 0.5) AS median, max(margin) AS most FROM m""")(lambda spark, sf: metrics.vote_margin(li(spark, sf)[0]).agg(F.percentile("margin", 0.5).alias("median"), F.max("margin").alias("most")))
query("log_odds", "SELECT event_id AS id, round(CASE WHEN event_id % 3 = 0 THEN -20.0 ELSE value / 10 END - (CASE WHEN event_id % 5 = 0 THEN -20.0 ELSE -value / 10 END), 4) AS orm FROM events")(
    lambda spark, sf: P.table(spark, sf, "events").select(F.col("event_id").alias("id"), metrics.log_odds(F.map_filter(F.create_map(F.lit("Yes"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 10), F.lit("No"), F.when(F.col("event_id") % 5 != 0, -F.col("value") / 10)), lambda k, v: v.isNotNull())).alias("orm"))
)

query("kept_ids", f"WITH {DOCS} SELECT id, source FROM docs WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")(lambda spark, sf: selection.only_ids(docs(spark, sf).select("id", "source"), P.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))))
query("question_lookup", "SELECT l.doc_id AS id, quality, md5(coalesce(b.text, '')) AS question FROM labels l LEFT JOIN benchmark b ON b.item_id = l.doc_id")(
    lambda spark, sf: selection.with_question(P.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), P.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))).withColumn("question", F.md5("question"))
)
query("adopted_rows", f"""WITH {S.EV}, a AS (SELECT id, j, text FROM pool JOIN gold USING (id) WHERE ans = gold AND NOT trunc), b AS (SELECT id, j, score FROM pool WHERE trunc)
SELECT id, j, text, CAST(NULL AS DOUBLE) AS score FROM a UNION ALL SELECT id, j, NULL, score FROM b""")(
    lambda spark, sf: selection.with_adopted(ev(spark, sf)[0].join(ev(spark, sf)[1], "id").where("ans = gold AND NOT trunc").select("id", "j", "text"), ev(spark, sf)[0].where("trunc").select("id", "j", "score"))
)
query("repeated_correct", f"WITH {S.LI}, g AS (SELECT pool.id, j FROM pool JOIN gold USING (id) WHERE ans = gold) SELECT id, j FROM g WHERE id IN (SELECT id FROM g GROUP BY id HAVING count(*) >= 2)")(lambda spark, sf: selection.repeated_correct(*li(spark, sf)).select("id", "j"))
query("audit_dead", f"WITH {S.LI}, maj AS ({S.RULES['majority']}), s AS ({S.SOLVED}) SELECT id, gold, answer AS our_maj, true AS dead FROM maj JOIN gold USING (id) JOIN s USING (id) WHERE n_correct = 0")(lambda spark, sf: audit.scope(*li(spark, sf), which="dead"))
query("pair_gate", f"""WITH {S.EV}, r AS (SELECT id, CAST(ans = gold AS INT) AS label FROM pool JOIN gold USING (id) WHERE NOT trunc AND ans IS NOT NULL AND length(text) >= 4), m AS (SELECT id FROM r GROUP BY id HAVING min(label) < max(label))
SELECT count(*) AS mixed, count(*) >= 20 AS ok FROM m""")(
    lambda spark, sf: gates.pair_gate(selection.balanced_pairs(*ev(spark, sf), voting.majority(ev(spark, sf)[0]).select("id", F.lit(False).alias("maj_wrong")), min_chars=4), 20)
)
query("collapsed", f"""WITH e AS (SELECT count(DISTINCT answer) AS k FROM (SELECT o_custkey AS answer, row_number() OVER (PARTITION BY draw ORDER BY {S.drawn("'0'", 'draw', 'o_orderkey')}, o_orderkey) AS rn, draw FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders), (SELECT unnest(range(1, 6)) AS draw)) WHERE rn <= 800 GROUP BY draw),
k AS (SELECT count(DISTINCT o_custkey % 50) AS kinds FROM orders) SELECT kinds, min(e.k) AS least, max(e.k) AS most, kinds < min(e.k) * 0.7 AS collapsed FROM k, e GROUP BY kinds""")(
    lambda spark, sf: gates.collapsed(P.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("answer")), gates.distinct_envelope(P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("answer")).distinct(), 800, 5))
)
query("length_mismatch", f"WITH {S.LI}, g AS (SELECT id, count(*) AS samples, count(*) FILTER (j % 5 < 4) AS scores FROM pool GROUP BY id) SELECT * FROM g WHERE samples <> scores")(
    lambda spark, sf: gates.length_mismatch(li(spark, sf)[0].groupBy("id").agg(F.collect_list("text").alias("outputs")), li(spark, sf)[0].groupBy("id").agg(F.collect_list(F.when(F.col("j") % 5 < 4, F.col("score"))).alias("orm")))
)
query("submission_report", f"""WITH {S.LI}, {SUB}, bad AS (SELECT DISTINCT answer FROM sub WHERE answer IS NOT NULL AND NOT coalesce(regexp_full_match(regexp_replace(answer, '[-.]', '', 'g'), '\\d+') AND TRY_CAST(answer AS DOUBLE) = floor(TRY_CAST(answer AS DOUBLE)), false)),
missing AS (SELECT DISTINCT id FROM gold WHERE id NOT IN (SELECT id FROM sub)), extra AS (SELECT DISTINCT id FROM sub WHERE id NOT IN (SELECT id FROM gold)),
whole AS (SELECT CAST(TRY_CAST(answer AS DOUBLE) AS HUGEINT) AS v FROM sub WHERE answer IS NOT NULL AND answer NOT IN (FROM bad))
SELECT 'columns' AS "check", 'ok' AS severity, CAST(0 AS BIGINT) AS n, '' AS examples
UNION ALL SELECT 'missing_id', CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END, count(*), (SELECT coalesce(string_agg(i, ',' ORDER BY i), '') FROM (SELECT CAST(id AS VARCHAR) AS i FROM missing ORDER BY id LIMIT 3)) FROM missing
UNION ALL SELECT 'extra_id', CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END, count(*), (SELECT coalesce(string_agg(i, ',' ORDER BY i), '') FROM (SELECT CAST(id AS VARCHAR) AS i FROM extra ORDER BY id LIMIT 3)) FROM extra
UNION ALL SELECT 'not_integer', CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END, count(*), (SELECT coalesce(string_agg(answer, ',' ORDER BY answer), '') FROM (SELECT answer FROM bad ORDER BY answer LIMIT 3)) FROM sub WHERE answer IN (FROM bad)
UNION ALL SELECT 'range', 'info', NULL, min(v) || '..' || max(v) FROM whole""")(
    lambda spark, sf: gates.submission_report(_sub(li(spark, sf)[1]), li(spark, sf)[1]).where("check IN ('columns', 'missing_id', 'extra_id', 'not_integer', 'range')")
)
