"""Fits, resampling and effect estimates over the panel tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.models.ordered import ordered_logit
from pitchloom.operators import stats
from pitchloom.operators.causal import att_scores, bootstrap_ratio, md5_uniform, partially_linear
from pitchloom.operators.ranking import bh_adjust, ordinal_rank
from pitchloom.plans import relational as R
from pitchloom.plans.relational import GOALS, PANEL, PCJ
from pitchloom.plans.statistics import _FE, _TM, _scores
from pitchloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@q("k01_ordered_logit")
def _(s, d):
    t = table(s, d, "training_matrix").dropna(subset=["match_id", "minute_bin", "score_diff", "red_diff", "elo_diff", "y"]).distinct()
    return ordered_logit(t.withColumn("elo", F.round(F.col("elo_diff") / 100, 1)), "minute_bin", ["score_diff", "red_diff", "elo"], "y")


_HEAT = "(SELECT t / 20.0 AS temperature FROM (SELECT unnest(range(10, 61)) AS t))"


@q("k02_temperature_fit", f"WITH l AS (SELECT temperature, round(sum(-CASE WHEN y = 1 THEN ln(pt) ELSE ln(1 - pt) END) / count(*), 6) AS nll FROM (SELECT h.temperature, t.y, 1 / (1 + exp(-ln(p / (1 - p)) / h.temperature)) AS pt FROM {_TM} t, {_HEAT} h) GROUP BY 1) SELECT temperature::DOUBLE AS temperature, nll FROM l ORDER BY nll, temperature LIMIT 1")
def _(s, d):
    # the grid rides along with each row, so one pass gives the loss of every temperature
    grid = F.explode(F.array(*[F.lit(k / 20.0) for k in range(10, 61)])).alias("temperature")
    p, y = F.col("p"), F.col("y")
    rows = _scores(s, d).select("p", "y", grid)
    pt = 1 / (1 + F.exp(-F.ln(p / (1 - p)) / F.col("temperature")))
    loss = rows.groupBy("temperature").agg(F.round(F.sum(-F.when(y == 1, F.ln(pt)).otherwise(F.ln(1 - pt))) / F.count(F.lit(1)), 6).alias("nll"))
    return loss.orderBy("nll", "temperature").limit(1)


_AUC_SQL = "(sum(pos * (below + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos)))"


@q("k10_permutation_importance", f"""WITH t AS (SELECT DISTINCT match_id, minute_bin, score_diff, elo_diff, (y > 1)::INT AS y FROM training_matrix WHERE match_id IS NOT NULL AND minute_bin IS NOT NULL AND score_diff IS NOT NULL AND elo_diff IS NOT NULL AND y IS NOT NULL),
o AS (SELECT *, coalesce(lead(score_diff) OVER w, first_value(score_diff) OVER w) AS sd2, coalesce(lead(elo_diff) OVER w, first_value(elo_diff) OVER w) AS ed2 FROM t WINDOW w AS (PARTITION BY minute_bin ORDER BY md5(concat_ws('|', match_id::VARCHAR, minute_bin::VARCHAR)), match_id, score_diff, elo_diff, y)),
s AS (SELECT 'none' AS shuffled, round(1 / (1 + exp(-(0.5 * score_diff + 0.003 * elo_diff))), 9) AS p, y FROM o UNION ALL SELECT 'score_diff', round(1 / (1 + exp(-(0.5 * sd2 + 0.003 * elo_diff))), 9), y FROM o UNION ALL SELECT 'elo_diff', round(1 / (1 + exp(-(0.5 * score_diff + 0.003 * ed2))), 9), y FROM o),
c AS (SELECT shuffled, p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY shuffled ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT shuffled, round({_AUC_SQL}, 6) AS auc FROM r GROUP BY 1""")
def _(s, d):
    t = table(s, d, "training_matrix").dropna(subset=["match_id", "minute_bin", "score_diff", "elo_diff", "y"]).select("match_id", "minute_bin", "score_diff", "elo_diff", (F.col("y") > 1).cast("int").alias("y")).distinct()
    # a value goes to the next row of its minute in hash order: a permutation that needs no gathering
    w = Window.partitionBy("minute_bin").orderBy(F.md5(F.concat_ws("|", F.col("match_id").cast("string"), F.col("minute_bin").cast("string"))), "match_id", "score_diff", "elo_diff", "y")
    moved = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    o = t.withColumns({"sd2": moved("score_diff"), "ed2": moved("elo_diff")})
    p = lambda a, b: F.round(1 / (1 + F.exp(-(0.5 * F.col(a) + 0.003 * F.col(b)))), 9)
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("shuffled"), p(a, b).alias("p")) for n, a, b in (("none", "score_diff", "elo_diff"), ("score_diff", "sd2", "elo_diff"), ("elo_diff", "score_diff", "ed2"))])).alias("k")
    return stats.auc(o.select("y", kinds).select("y", "k.*"), "p", "y", ["shuffled"]).select("shuffled", F.round("auc", 6).alias("auc"))


@q("k13_interaction", f"""WITH r AS (SELECT channel, pff_player_id, shock_id, outcome AS y, post AS x, post * (stage IN ('R16', 'QF'))::INT AS k FROM {PANEL} WHERE outcome IS NOT NULL AND post IS NOT NULL AND stage IS NOT NULL AND relative_min <> 0),
w AS (SELECT channel, y - avg(y) OVER u AS y, x - avg(x) OVER u AS x, k - avg(k) OVER u AS k FROM r WINDOW u AS (PARTITION BY channel, pff_player_id, shock_id)),
m AS (SELECT channel, sum(x * x) AS xx, sum(x * k) AS xk, sum(k * k) AS kk, sum(x * y) AS xy, sum(k * y) AS ky FROM w GROUP BY 1)
SELECT channel, round((kk * xy - xk * ky) / nullif(xx * kk - xk * xk, 0), 5) AS post, round((xx * ky - xk * xy) / nullif(xx * kk - xk * xk, 0), 5) AS post_ko FROM m""")
def _(s, d):
    ko = (F.col("post") * F.col("stage").isin("R16", "QF").cast("int")).alias("k")
    r = R.panel(s, d).where("relative_min <> 0").dropna(subset=["outcome", "post", "stage"]).select("channel", "pff_player_id", "shock_id", F.col("outcome").alias("y"), F.col("post").alias("x"), ko)
    u = Window.partitionBy("channel", "pff_player_id", "shock_id")
    w = r.select("channel", *[(F.col(c) - F.avg(c).over(u)).alias(c) for c in "yxk"])
    m = w.groupBy("channel").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xk", "kk", "xy", "ky")])
    det = F.nullif(F.col("xx") * F.col("kk") - F.col("xk") * F.col("xk"), F.lit(0.0))
    return m.select("channel", F.round(F.try_divide(F.col("kk") * F.col("xy") - F.col("xk") * F.col("ky"), det), 5).alias("post"), F.round(F.try_divide(F.col("xx") * F.col("ky") - F.col("xk") * F.col("xy"), det), 5).alias("post_ko"))


@q("k14_absorbed_study", f"""WITH w AS (SELECT channel, relative_min, outcome - avg(outcome) OVER (PARTITION BY channel, pff_player_id, shock_id) AS y FROM {PANEL} WHERE outcome IS NOT NULL), c AS (SELECT channel, relative_min, avg(y) AS m, stddev_samp(y) / sqrt(count(*)) AS se, count(*) AS n FROM w GROUP BY 1, 2)
SELECT c.channel, c.relative_min::BIGINT AS rel, round(c.m - b.m, 6) AS effect, round(sqrt(c.se * c.se + b.se * b.se), 6) AS se FROM c JOIN c b ON b.channel = c.channel AND b.relative_min = -1 WHERE c.relative_min <> -1""")
def _(s, d):
    y = F.col("outcome") - F.avg("outcome").over(Window.partitionBy("channel", "pff_player_id", "shock_id"))
    c = R.panel(s, d).dropna(subset=["outcome"]).withColumn("y", y).groupBy("channel", "relative_min").agg(F.avg("y").alias("m"), (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    w = Window.partitionBy("channel")  # a row per bin
    ref = lambda v: F.max(F.when(F.col("relative_min") == -1, F.col(v))).over(w)
    c = c.withColumns({"m0": ref("m"), "se0": ref("se"), "there": F.max((F.col("relative_min") == -1).cast("int")).over(w)}).where("there = 1 AND relative_min <> -1")
    return c.select("channel", F.col("relative_min").cast("long").alias("rel"), F.round(F.col("m") - F.col("m0"), 6).alias("effect"), F.round(F.sqrt(F.col("se") * F.col("se") + F.col("se0") * F.col("se0")), 6).alias("se"))


def _u(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(f'{p}::VARCHAR' for p in parts)})), 1, 8))::BIGINT / 4294967296.0"


def _weight(u: str) -> str:
    return f"CASE WHEN {u} < 0.36787944 THEN 0 WHEN {u} < 0.73575888 THEN 1 WHEN {u} < 0.9196986 THEN 2 WHEN {u} < 0.98101184 THEN 3 WHEN {u} < 0.99634015 THEN 4 ELSE 5 END"


def _bootstrap(clusters: str, by: str, draws: int) -> str:
    """Of (by, g, a, b): sum(a) / sum(b) and its deviation over the draws."""
    return f"""dr AS (SELECT {by}, k, sum(w * a) / nullif(sum(w * b), 0) AS e FROM (SELECT {by}, k, a, b, {_weight(_u('g', 'k'))} AS w FROM {clusters}, (SELECT unnest(range(1, {draws + 1})) AS k)) GROUP BY 1, 2),
pt AS (SELECT {by}, sum(a) / nullif(sum(b), 0) AS estimate FROM {clusters} GROUP BY 1), sp AS (SELECT {by}, stddev_samp(e) AS se FROM dr GROUP BY 1)"""


@q("k15_bootstrap", f"""WITH b AS (SELECT channel, pff_player_id, shock_id, avg(outcome) AS base FROM {PANEL} WHERE relative_min < 0 AND outcome IS NOT NULL GROUP BY ALL),
cl AS (SELECT p.channel, p.pff_player_id AS g, sum(p.outcome - b.base) AS a, count(*) AS b FROM {PANEL} p JOIN b USING (channel, pff_player_id, shock_id) WHERE p.relative_min > 0 AND p.outcome IS NOT NULL GROUP BY 1, 2), {_bootstrap('cl', 'channel', 200)}
SELECT channel, round(estimate, 6) AS att, round(se, 6) AS se FROM pt JOIN sp USING (channel)""")
def _(s, d):
    w = Window.partitionBy("channel", "pff_player_id", "shock_id")
    p = R.panel(s, d).dropna(subset=["channel", "outcome", "pff_player_id", "shock_id"]).withColumn("base", F.avg(F.when(F.col("relative_min") < 0, F.col("outcome"))).over(w))
    cl = p.where("relative_min > 0 AND base IS NOT NULL").groupBy("channel", "pff_player_id").agg(F.sum(F.col("outcome") - F.col("base")).alias("a"), F.count(F.lit(1)).alias("b"))
    return bootstrap_ratio(cl, ["channel"], "pff_player_id", "a", "b", 200).select("channel", F.round("estimate", 6).alias("att"), F.round("se", 6).alias("se"))


@q("k17_pretrend", f"WITH c AS (SELECT channel, relative_min, avg(outcome) AS m, stddev_samp(outcome) / sqrt(count(*)) AS se FROM {PANEL} WHERE outcome IS NOT NULL GROUP BY 1, 2), z AS (SELECT c.channel, (c.m - b.m) / sqrt(c.se * c.se + b.se * b.se) AS z FROM c JOIN c b ON b.channel = c.channel AND b.relative_min = -1 WHERE c.relative_min < -1) SELECT channel, round(avg(z * z), 5) AS f, count(z) AS n_bins FROM z GROUP BY 1")
def _(s, d):
    c = R.panel(s, d).dropna(subset=["outcome"]).groupBy("channel", "relative_min").agg(F.avg("outcome").alias("m"), (F.stddev_samp("outcome") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    w = Window.partitionBy("channel")
    ref = lambda v: F.max(F.when(F.col("relative_min") == -1, F.col(v))).over(w)
    z = c.withColumns({"m0": ref("m"), "se0": ref("se")}).where("relative_min < -1 AND m0 IS NOT NULL")
    z = z.select("channel", ((F.col("m") - F.col("m0")) / F.sqrt(F.col("se") * F.col("se") + F.col("se0") * F.col("se0"))).alias("z"))
    return z.groupBy("channel").agg(F.round(F.avg(F.col("z") * F.col("z")), 5).alias("f"), F.count("z").alias("n_bins"))


@q("k18_within_difference", f"""WITH u AS (SELECT channel, pff_player_id, shock_id, avg(outcome) FILTER (post = 1) - avg(outcome) FILTER (post = 0) AS dlt FROM {PANEL} WHERE outcome IS NOT NULL GROUP BY ALL),
w AS (SELECT channel, avg(dlt) AS within, stddev_samp(dlt) / sqrt(count(dlt)) AS se FROM u WHERE dlt IS NOT NULL GROUP BY 1), p AS (SELECT channel, avg(outcome) FILTER (post = 1) - avg(outcome) FILTER (post = 0) AS pooled, sqrt(var_samp(outcome) FILTER (post = 1) / count(*) FILTER (post = 1) + var_samp(outcome) FILTER (post = 0) / count(*) FILTER (post = 0)) AS pse FROM {PANEL} WHERE outcome IS NOT NULL GROUP BY 1)
SELECT channel, round(within, 6) AS within, round(pooled, 6) AS pooled, round((within - pooled) / sqrt(se * se + pse * pse), 5) AS z FROM w JOIN p USING (channel)""")
def _(s, d):
    rows = R.panel(s, d).dropna(subset=["outcome"])
    y, side = F.col("outcome"), lambda k: F.when(F.col("post") == k, F.col("outcome"))
    u = rows.groupBy("channel", "pff_player_id", "shock_id").agg((F.avg(side(1)) - F.avg(side(0))).alias("dlt")).where("dlt IS NOT NULL")
    w = u.groupBy("channel").agg(F.avg("dlt").alias("within"), (F.stddev_samp("dlt") / F.sqrt(F.count("dlt"))).alias("se"))
    p = rows.groupBy("channel").agg((F.avg(side(1)) - F.avg(side(0))).alias("pooled"), F.sqrt(F.var_samp(side(1)) / F.count(side(1)) + F.var_samp(side(0)) / F.count(side(0))).alias("pse"))
    z = (F.col("within") - F.col("pooled")) / F.sqrt(F.col("se") * F.col("se") + F.col("pse") * F.col("pse"))
    return w.join(p, "channel").select("channel", F.round("within", 6).alias("within"), F.round("pooled", 6).alias("pooled"), F.round(z, 5).alias("z"))


@q("k20_power", f"""WITH g AS (SELECT pff_player_id, count(*) AS n, avg(outcome) AS m, coalesce(var_samp(outcome), 0) AS v FROM {PANEL} WHERE outcome IS NOT NULL GROUP BY 1), o AS (SELECT sum(n) AS N_, count(*) AS k, sum(n * n) AS n2, sum(n * m) AS s, sum((n - 1) * v) AS ssw, sum(n * m * m) AS q FROM g), x AS (SELECT N_, k, ssw / (N_ - k) AS msw, (q - s * s / N_) / (k - 1) AS msb, (N_ - n2 / N_) / (k - 1) AS n0 FROM o),
e AS (SELECT N_, 1 + (N_ / k - 1) * (msb - msw) / (msb + (n0 - 1) * msw) AS deff FROM x), v AS (SELECT stddev_samp(outcome) AS sd FROM {PANEL} WHERE outcome IS NOT NULL) SELECT round(2.8015852 * v.sd * sqrt(greatest(e.deff, 0.0) / e.N_ * 4), 6) AS mde FROM e, v""")
def _(s, d):
    rows = R.panel(s, d).dropna(subset=["outcome"])
    # least effect found with 80 % power at 5 %, two halves of equal size
    deff = stats.icc(rows, "pff_player_id", "outcome").select("design_effect", F.lit(1).alias("j"))
    size = rows.agg(F.stddev_samp("outcome").alias("sd"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("j"))
    return deff.join(F.broadcast(size), "j").select(F.round(2.8015852 * F.col("sd") * F.sqrt(F.greatest("design_effect", F.lit(0.0)) / F.col("n") * 4), 6).alias("mde"))


@q("k22_fdr", f"""WITH u AS (SELECT channel, perspective, stage, pff_player_id, avg(outcome) FILTER (post = 1) - avg(outcome) FILTER (post = 0) AS dlt FROM {PANEL} WHERE outcome IS NOT NULL AND stage IS NOT NULL GROUP BY ALL), z AS (SELECT channel, perspective, stage, avg(dlt) / (stddev_samp(dlt) / sqrt(count(dlt))) AS z FROM u WHERE dlt IS NOT NULL GROUP BY 1, 2, 3 HAVING count(dlt) > 2),
p AS (SELECT *, round(2 / (1 + exp(1.702 * abs(z))), 9) AS p FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY perspective ORDER BY p) AS rk, count(*) OVER (PARTITION BY perspective) AS n FROM p)
SELECT channel, perspective, stage, round(p, 6) AS p, round(least(min(p * n / rk) OVER (PARTITION BY perspective ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS p_fdr FROM r""")
def _(s, d):
    side = lambda k: F.when(F.col("post") == k, F.col("outcome"))
    u = R.panel(s, d).dropna(subset=["outcome", "stage"]).groupBy("channel", "perspective", "stage", "pff_player_id").agg((F.avg(side(1)) - F.avg(side(0))).alias("dlt")).where("dlt IS NOT NULL")
    z = u.groupBy("channel", "perspective", "stage").agg((F.avg("dlt") / (F.stddev_samp("dlt") / F.sqrt(F.count("dlt")))).alias("z"), F.count("dlt").alias("n")).where("n > 2")
    # two-sided p by the logistic approximation of the normal distribution
    p = z.withColumn("p", F.round(2 / (1 + F.exp(1.702 * F.abs("z"))), 9)).drop("z", "n")
    return bh_adjust(p, "p", ["perspective"], ["channel"], "adj").select("channel", "perspective", "stage", F.round("p", 6).alias("p"), F.round("adj", 6).alias("p_fdr"))


_TREATED = f"(SELECT channel, pff_player_id, coalesce(position_group, '?') AS pos, outcome AS y, (perspective = 'GOAL_AGAINST')::INT::DOUBLE AS t, floor({_u('pff_player_id')} * 5) AS fold FROM {PANEL} WHERE relative_min > 0 AND outcome IS NOT NULL AND perspective IS NOT NULL AND pff_player_id IS NOT NULL AND channel IS NOT NULL)"
_FITTED = f"""r AS {_TREATED}, f AS (SELECT channel, pos, fold, sum(y) AS sy, count(y) AS ny, sum(t) AS st, sum(y) FILTER (t = 0) AS s0, count(y) FILTER (t = 0) AS n0 FROM r GROUP BY 1, 2, 3),
o AS (SELECT channel, pos, fold, (sum(sy) OVER w - sy) / nullif(sum(ny) OVER w - ny, 0) AS my, (sum(st) OVER w - st) / nullif(sum(ny) OVER w - ny, 0) AS mt, (sum(s0) OVER w - coalesce(s0, 0)) / nullif(sum(n0) OVER w - n0, 0) AS m0 FROM f WINDOW w AS (PARTITION BY channel, pos)), j AS (SELECT r.*, o.my, o.mt, o.m0 FROM r JOIN o USING (channel, pos, fold))"""


def _treated(s, d) -> DataFrame:
    p = R.panel(s, d).where("relative_min > 0").dropna(subset=["outcome", "perspective", "pff_player_id", "channel"])
    return p.select("channel", "pff_player_id", F.coalesce("position_group", F.lit("?")).alias("pos"), F.col("outcome").alias("y"), (F.col("perspective") == "GOAL_AGAINST").cast("double").alias("t"))


@q("k25_partially_linear", f"""WITH {_FITTED}, c AS (SELECT channel, pff_player_id, sum((t - mt) * (y - my)) AS a, sum((t - mt) * (t - mt)) AS b, count(*) AS m FROM j WHERE my IS NOT NULL AND mt IS NOT NULL GROUP BY 1, 2), e AS (SELECT channel, sum(a) / sum(b) AS th FROM c GROUP BY 1)
SELECT channel, round(any_value(th), 6) AS theta, round(sqrt(sum(pow(a - th * b, 2))) / sum(b), 6) AS se, sum(m)::BIGINT AS n FROM c JOIN e USING (channel) GROUP BY 1""")
def _(s, d):
    return partially_linear(_treated(s, d), "y", "t", ["channel", "pos"], "pff_player_id", ["channel"]).select("channel", F.round("theta", 6).alias("theta"), F.round("se", 6).alias("se"), "n")


_DR = f"""{_FITTED}, ps AS (SELECT channel, pff_player_id, t, y - m0 AS gap, greatest(least(mt, 0.99), 0.01) AS e FROM j WHERE m0 IS NOT NULL AND mt IS NOT NULL),
cl AS (SELECT channel, pff_player_id AS g, sum(t * gap - (1 - t) * e / (1 - e) * gap) AS a, sum(t) AS b FROM ps GROUP BY 1, 2), {_bootstrap('cl', 'channel', 100)}"""


def _dr(s, d) -> DataFrame:
    scored = att_scores(_treated(s, d), "y", "t", ["channel", "pos"], "pff_player_id")
    cl = scored.groupBy("channel", "pff_player_id").agg(F.sum("psi").alias("a"), F.sum("t").alias("b"))
    return bootstrap_ratio(cl, ["channel"], "pff_player_id", "a", "b", 100)


@q("k26_dr_learner", f"WITH {_DR} SELECT channel, round(estimate, 6) AS att, round(se, 6) AS se FROM pt JOIN sp USING (channel)")
def _(s, d):
    return _dr(s, d).select("channel", F.round("estimate", 6).alias("att"), F.round("se", 6).alias("se"))


@q("k31_att_and_ate", f"WITH {_DR}, {_FE.removeprefix('WITH ').replace('r AS', 'r2 AS').replace('FROM r WINDOW', 'FROM r2 WINDOW').replace('c AS (SELECT channel', 'c2 AS (SELECT channel')}, b2 AS (SELECT channel, sum(xy) / sum(xx) AS ate FROM c2 GROUP BY 1) SELECT channel, round(estimate, 6) AS att, round(ate, 6) AS ate, sign(round(estimate, 6)) = sign(round(ate, 6)) AS same_sign FROM pt JOIN b2 USING (channel)")
def _(s, d):
    ate = stats.within_effect(R.panel(s, d).where("relative_min <> 0"), "outcome", "post", ["pff_player_id", "shock_id"], "pff_player_id", ["channel"]).select("channel", F.round("beta", 6).alias("ate"))
    both = _dr(s, d).select("channel", F.round("estimate", 6).alias("att")).join(ate, "channel")
    return both.withColumn("same_sign", F.signum("att") == F.signum("ate"))


_SIDE = "(s2 * t0 - s1 * t1) / nullif(s0 * s2 - s1 * s1, 0)"


@q("k28_specification_curve", f"""WITH o AS (SELECT o_totalprice - 150000 AS dd, (o_orderstatus = 'F')::INT AS y, w::DOUBLE AS width FROM orders, (SELECT unnest([20000, 30000, 40000, 60000]) AS w) WHERE abs(o_totalprice - 150000) < w), m AS (SELECT width, dd >= 0 AS r, sum(k) AS s0, sum(k * dd) AS s1, sum(k * dd * dd) AS s2, sum(k * y) AS t0, sum(k * dd * y) AS t1, count(*) AS n FROM (SELECT *, 1 - abs(dd) / width AS k FROM o) GROUP BY 1, 2)
SELECT width, round(max({_SIDE}) FILTER (r) - max({_SIDE}) FILTER (NOT r), 6) AS jump, sum(n)::BIGINT AS n FROM m GROUP BY 1""")
def _(s, d):
    o = table(s, d, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    # one scan per width, each pruned to its own band; the widths are a parameter of a few values
    each = [stats.local_linear_jump(o, "o_totalprice", "y", 150000.0, w).select(F.lit(w).alias("width"), F.round("jump", 6).alias("jump"), "n") for w in (20000.0, 30000.0, 40000.0, 60000.0)]
    return reduce(DataFrame.unionByName, each)


@q("k33_split_rhat", f"""WITH r AS (SELECT channel, perspective, outcome, ntile(2) OVER (PARTITION BY channel, perspective ORDER BY panel_id) AS half FROM {PANEL} WHERE outcome IS NOT NULL AND perspective IS NOT NULL AND channel IS NOT NULL), c AS (SELECT channel, perspective, half, avg(outcome) AS m, var_samp(outcome) AS v, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT channel, round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) AS rhat, round(least(sum(n) * avg(v) / (avg(v) + avg(n) * var_samp(m)), sum(n)), 3) AS ess FROM c GROUP BY 1""")
def _(s, d):
    return stats.split_rhat(R.panel(s, d).dropna(subset=["outcome", "perspective", "channel"]), ["channel"], "perspective", "panel_id", "outcome").select("channel", F.round("rhat", 6).alias("rhat"), F.round("ess", 3).alias("ess"))


@q("k35_rankings", f"SELECT edition_id, pff_player_id, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY edition_id ORDER BY v DESC NULLS LAST, pff_player_id) END AS overall, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY edition_id, position_bucket ORDER BY v DESC NULLS LAST, pff_player_id) END AS in_bucket FROM (SELECT *, CASE WHEN isnan(protecting_clutch_idx) THEN NULL ELSE protecting_clutch_idx END AS v FROM {PCJ})")
def _(s, d):
    p = R.pcj(s, d).withColumn("v", F.when(~F.isnan("protecting_clutch_idx"), F.col("protecting_clutch_idx")))
    return p.select("edition_id", "pff_player_id", ordinal_rank("v", ["pff_player_id"], ["edition_id"]).cast("long").alias("overall"), ordinal_rank("v", ["pff_player_id"], ["edition_id", "position_bucket"]).cast("long").alias("in_bucket"))


@q("k36_split_of_groups", f"SELECT DISTINCT match_id, {_u('match_id')} < 0.8 AS is_train FROM training_matrix WHERE match_id IS NOT NULL")
def _(s, d):
    return table(s, d, "training_matrix").where("match_id IS NOT NULL").select("match_id", (md5_uniform(F.col("match_id")) < 0.8).alias("is_train")).distinct()


@q("k37_late_goal_rate", f"WITH m AS (SELECT match_id, count(*) FILTER (minute >= 90) AS late FROM {GOALS} WHERE match_id IS NOT NULL GROUP BY 1) SELECT count(*) AS n_matches, round(CASE WHEN count(*) < 5 THEN 0.025 ELSE sum(late) / count(*) / 30.0 END, 6) AS rate FROM m")
def _(s, d):
    m = R.goals(s, d).where("match_id IS NOT NULL").groupBy("match_id").agg(F.count_if(F.col("minute") >= 90).alias("late"))
    n = F.count(F.lit(1))
    return m.agg(n.alias("n_matches"), F.round(F.when(n < 5, 0.025).otherwise(F.sum("late") / n / 30.0), 6).alias("rate"))
