"""The same queries in SQL, for an independent engine on the same Parquet tables."""

from ballotspark.functions import normal

EV = """pool AS (
  SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j,
    CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 5 END AS ans,
    value AS score, event_type = 'error' AS trunc, -value / 10 AS logp, event_type AS text FROM events
), gold AS (SELECT DISTINCT id, id % 5 AS gold FROM pool)"""

LI = """pool AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS j,
    CASE WHEN l_linestatus <> 'X' THEN CAST(CAST(l_quantity AS INT) % 3 AS BIGINT) END AS ans,
    l_extendedprice AS score, l_returnflag = 'R' AS trunc, -l_discount AS logp, l_returnflag || ' ' || l_linestatus AS text FROM lineitem
), gold AS (SELECT DISTINCT o_orderkey AS id, o_custkey % 3 AS gold FROM orders)"""


def zscore(column: str, rows: str = "pool", out: str = "z") -> str:
    """rows with the score standardised within the id."""
    return f"""SELECT *, CASE WHEN count({column}) OVER (PARTITION BY id) < 2 THEN 0.0
      ELSE coalesce(({column} - avg({column}) OVER (PARTITION BY id)) / (CASE WHEN stddev_samp({column}) OVER (PARTITION BY id) > 0 THEN stddev_samp({column}) OVER (PARTITION BY id) ELSE 1.0 END), 0.0) END AS {out} FROM {rows}"""


def winner(votes: str, tie: str = "ans", keys: str = "id", ids: str = "pool") -> str:
    """The answer of most weight for each key; null where none has an answer."""
    return f"""SELECT {keys}, ans AS answer FROM (SELECT DISTINCT {keys} FROM {ids}) LEFT JOIN (
      SELECT {keys}, ans FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(weight, 9) DESC, {tie}) AS rn FROM ({votes}) WHERE ans IS NOT NULL) WHERE rn = 1) USING ({keys})"""


def vote(weight: str = "count(*)", rows: str = "pool", tie: str = "ans") -> str:
    return winner(f"SELECT id, ans, {weight} AS weight, min(j) AS first_j FROM ({rows}) GROUP BY id, ans" if " " in rows else f"SELECT id, ans, {weight} AS weight, min(j) AS first_j FROM {rows} GROUP BY id, ans", tie)


UNCUT = "SELECT * FROM (SELECT *, bool_and(trunc) OVER (PARTITION BY id) AS every FROM pool) WHERE every OR NOT trunc"
STEPS = r"""list_transform(regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?\s*[-+*/×÷]\s*-?\d[\d,]*(?:\.\d+)?'), lambda s: replace(replace(s, ' ', ''), ',', ''))"""
PATH = f"coalesce(nullif(array_to_string({STEPS}, '|'), ''), left(text, 80))"


def once(rows: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, {PATH} ORDER BY j) AS path_rn FROM ({rows})) WHERE path_rn = 1"


def median_weight(rows: str) -> str:
    sized = f"SELECT *, greatest(list_sort(list(length(text)) OVER (PARTITION BY id))[CAST(floor(count(*) OVER (PARTITION BY id) / 2) AS BIGINT) + 1], 1) AS med FROM ({rows})"
    return vote("sum(1.0 / (1.0 + abs(length(text) - med) / med))", sized)


RULES = {
    "majority": vote(),
    "logp_soft": vote("sum(exp(least(greatest(z, -6), 6)))", zscore("logp")),
    "logp_best": vote("CASE WHEN max(have) > 0 THEN max(z) ELSE count(*) END", f"SELECT *, count(logp) OVER (PARTITION BY id) AS have FROM ({zscore('logp')})"),
    "no_trunc": vote(rows=UNCUT),
    "path_unique": vote(rows=once("SELECT * FROM pool")),
    "median_length": median_weight("SELECT * FROM pool"),
    "short": vote("sum(1.0 / (1.0 + length(text) / 1000.0))", "SELECT * FROM pool"),
    "combined": median_weight(once(UNCUT)),
}


def fused(gamma: float, how: str, tie: str = "ans", score: str = "score") -> str:
    weight = "max(z)" if gamma >= 1e8 else f"ln(count(*)) + {gamma} * {'avg' if how == 'mean' else 'max'}(z)"
    return vote(weight, zscore(score), tie)


def arms(names: list[str], tie: str = "ans") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS arm, id, coalesce(answer = gold, false) AS ok FROM ({RULES[n]}) JOIN gold USING (id)" for n in names)


def drawn(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(parts) + "))"


def few(m: int, trials: int, rows: str = "pool") -> str:
    """Of each id and trial m samples."""
    order = drawn("'42'", "id", "trial", "j")
    return f"few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, trial ORDER BY {order}, j) AS rn FROM {rows}, (SELECT unnest(range(1, {trials} + 1)) AS trial)) WHERE rn <= {m})"


def drawn_number(below: str, *parts: str) -> str:
    return f"(('0x' || left({drawn(*parts)}, 15))::BIGINT % {below})"


#: The pool of events under the name `whole`, so that `pool` can be a part of it.
EV_WHOLE = EV.replace("pool AS (", "whole AS (").replace("FROM pool)", "FROM whole)")
LI_WHOLE = LI.replace("pool AS (", "whole AS (")
BY_TRIAL = "by_ AS (SELECT id, trial, ans, count(*) AS n, avg(zs) AS mean_score, max(zs) AS max_score, avg(zl) AS mean_logp, max(zl) AS max_logp FROM few GROUP BY ALL)"


def sampled(whole: str, m: int, trials: int) -> str:
    """by_: answers of each trial with scores that are standardised over the whole id."""
    return f"{whole}, pool AS ({zscore('logp', '(' + zscore('score', 'whole', 'zs') + ')', 'zl')}), {few(m, trials)}, {BY_TRIAL}"


def sampled_pick(gamma: float, column: str, how: str) -> str:
    weight = f"max_{column}" if gamma >= 1e8 else f"ln(n) + {gamma} * {how}_{column}"
    return winner(f"SELECT id, trial, ans, {weight} AS weight FROM by_", keys="id, trial", ids="few")


def _horner(c: list[float], x: str) -> str:
    out = repr(c[0])
    for k in c[1:]:
        out = f"({out} * {x} + {k!r})"
    return out


def normal_quantile(p: str) -> str:
    tail, q = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5::DOUBLE)"
    outer = f"({_horner([f * 1.0 for f in normal.C], tail)} / {_horner([*normal.D, 1.0], tail)})"
    inner = f"({_horner(normal.A, f'({q} * {q})')} * {q} / {_horner([*normal.B, 1.0], f'({q} * {q})')})"
    return f"CASE WHEN {p} < {normal.LOW} THEN {outer} WHEN {p} > 1 - {normal.LOW} THEN -{outer} ELSE {inner} END"


SOLVED = "SELECT id, count(*) AS k, count(*) FILTER (ans = gold) AS n_correct FROM pool JOIN gold USING (id) GROUP BY id"
POWERS = "SELECT m FROM (SELECT CAST(pow(2, unnest(range(10))) AS BIGINT) AS m) WHERE m <= (SELECT max(c) FROM (SELECT count(*) AS c FROM pool GROUP BY id))"
CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
