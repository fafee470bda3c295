"""Queries for the classifier's training table, scores and ROC curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventspark.operators import hist, mlprep, model, network, roc, scoring
from eventspark.plans import fixture as fx
from suite.registry import query
from suite.sqlparts import with_ctes

CLASSES = ("HH", "background")


def r(column, digits=4):
    return F.round(column, digits)


def tagged(spark, d):
    return mlprep.add_tag(fx.ml_rows(spark, d))


def positive(spark, d):
    return mlprep.drop_nonpositive(tagged(spark, d))


def balanced(spark, d):
    return mlprep.balance(positive(spark, d), CLASSES)


_BALANCED = """
SELECT m.*, weight * cnt / cls AS training_weight FROM (SELECT * FROM ml WHERE weight > 0) m
JOIN (SELECT tag, sum(weight) AS cls FROM ml WHERE weight > 0 GROUP BY tag) USING (tag)
CROSS JOIN (SELECT count(*) AS cnt FROM ml WHERE weight > 0)"""
_EVEN = "CAST(trunc((abs(phi) * 1e5 - floor(abs(phi) * 1e5)) * 10.0) AS INTEGER) % 2 = 0"


@query(
    "score_categories",
    with_ctes(
        """SELECT CASE WHEN score > 0.1 AND score < 0.6 THEN 1 WHEN score > 0.6 AND score < 0.8 THEN 2
             WHEN score > 0.8 AND score < 0.92 THEN 3 WHEN score > 0.92 AND score < 1.0 THEN 4 END AS category,
             type, count(*) AS n, round(sum(weight), 4) + 0.0 AS sumw FROM ml GROUP BY 1, 2""",
        "ml",
    ),
)
def score_categories(spark, d):
    df = fx.ml_rows(spark, d).withColumn("category", mlprep.categorise(F.col("score"), mlprep.SCORE_EDGES))
    return df.groupBy("category", "type").agg(F.count("*").alias("n"), r(F.sum("weight")).alias("sumw"))


@query(
    "one_hot",
    with_ctes(
        """SELECT o_orderkey, CASE WHEN tag = 'HH' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "HH",
             CASE WHEN tag = 'background' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS background FROM ml""",
        "ml",
    ),
)
def one_hot(spark, d):
    return mlprep.one_hot(tagged(spark, d), CLASSES).select("o_orderkey", *CLASSES)


@query(
    "positive_weight",
    with_ctes("SELECT count(*) AS n_total, count(*) FILTER (weight > 0) AS n_kept FROM ml", "ml"),
)
def positive_weight(spark, d):
    return mlprep.count_nonpositive(tagged(spark, d))


@query(
    "class_balance",
    with_ctes(
        "SELECT o_orderkey, tag, weight AS event_weight, round(training_weight, 6) + 0.0 AS training_weight FROM bal",
        "ml",
        bal=_BALANCED,
    ),
)
def class_balance(spark, d):
    return balanced(spark, d).select(
        "o_orderkey", "tag", "event_weight", r(F.col("training_weight"), 6).alias("training_weight")
    )


def _draw_sql(seed):
    return f"CAST('0x' || substr(md5('{seed}|' || o_orderkey), 1, 13) AS BIGINT)"


@query(
    "batch_check",
    with_ctes(
        f"""SELECT tag, round(sum(training_weight) / 20, 4) + 0.0 AS mean_weight, count(*) / 20 AS mean_rows
            FROM (SELECT tag, training_weight FROM bal, range(20) b(i)
                  QUALIFY row_number() OVER (PARTITION BY i
                    ORDER BY ({_draw_sql(1)} - i * {mlprep.DRAWS // 20} + {mlprep.DRAWS}) % {mlprep.DRAWS}, o_orderkey) <= 256)
            GROUP BY tag""",
        "ml",
        bal=_BALANCED,
    ),
)
def batch_check(spark, d):
    out = mlprep.batch_check(balanced(spark, d), 256, ["o_orderkey"], weight="training_weight")
    return out.withColumn("mean_weight", r(F.col("mean_weight")))


@query(
    "weight_hist",
    with_ctes(
        """SELECT tag, CASE WHEN weight >= hi THEN 100 ELSE least(CAST(floor(100 * ((weight - lo) / (hi - lo))) AS INTEGER) + 1, 100)
             END AS bin, count(*) AS n
           FROM ml JOIN (SELECT tag, min(weight) AS lo, max(weight) AS hi FROM ml GROUP BY tag) USING (tag) GROUP BY 1, 2""",
        "ml",
    ),
)
def weight_hist(spark, d):
    return mlprep.weight_hist(tagged(spark, d), CLASSES)


@query(
    "weight_hist_both",
    with_ctes(
        """SELECT name AS weight, tag, CASE WHEN v >= hi THEN 100
             ELSE least(CAST(floor(100 * ((v - lo) / (hi - lo))) AS INTEGER) + 1, 100) END AS bin, count(*) AS n
           FROM (SELECT *, min(v) OVER (PARTITION BY name, tag) AS lo, max(v) OVER (PARTITION BY name, tag) AS hi
                 FROM (SELECT tag, 'event_weight' AS name, weight AS v FROM bal
                       UNION ALL SELECT tag, 'training_weight', round(training_weight, 6) FROM bal)) GROUP BY 1, 2, 3""",
        "ml",
        bal=_BALANCED,
    ),
)
def weight_hist_both(spark, d):
    """Distributions of the weight before and after the classes were balanced."""
    rows = balanced(spark, d).withColumn("training_weight", r(F.col("training_weight"), 6))
    each = [
        mlprep.weight_hist(rows, CLASSES, weight=w).withColumn("weight", F.lit(w)) for w in ("event_weight", "training_weight")
    ]
    return each[0].unionByName(each[1])


@query(
    "parity_split",
    with_ctes(f"SELECT o_orderkey, CASE WHEN {_EVEN} THEN 'test' ELSE 'train' END AS subset FROM ml", "ml"),
)
def parity_split(spark, d):
    train, test = mlprep.parity_split(fx.ml_rows(spark, d), split="even")
    pick = lambda df, name: df.select("o_orderkey", F.lit(name).alias("subset"))
    return pick(train, "train").unionByName(pick(test, "test"))


@query("val_split", with_ctes(f"SELECT o_orderkey, {_draw_sql(0)} % 100 < 30 AS is_val FROM ml", "ml"))
def val_split(spark, d):
    return mlprep.val_split(fx.ml_rows(spark, d), ["o_orderkey"]).select("o_orderkey", "is_val")


@query(
    "tail_repeat",
    with_ctes(
        """SELECT o_orderkey, copy::INTEGER AS copy, round(training_weight / n, 6) + 0.0 AS training_weight
           FROM (SELECT *, CASE WHEN training_weight >= q THEN greatest(CAST(floor(training_weight / q) AS BIGINT), 1) ELSE 1 END AS n
                 FROM bal CROSS JOIN (SELECT quantile_cont(training_weight, 0.6) AS q FROM bal)) t,
                unnest(range(1, n + 1)) u(copy)""",
        "ml",
        bal=_BALANCED,
    ),
)
def tail_repeat(spark, d):
    out = mlprep.repeat_tail(balanced(spark, d), 0.6)
    return out.select("o_orderkey", "copy", r(F.col("training_weight"), 6).alias("training_weight"))


@query(
    "split_summary",
    with_ctes(
        f"""SELECT CASE WHEN {_EVEN} THEN 'test' WHEN o_orderkey % 10 < 3 THEN 'validation' ELSE 'training' END AS subset,
              count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ml), 4) + 0.0 AS percent FROM ml GROUP BY 1""",
        "ml",
    ),
)
def split_summary(spark, d):
    out = mlprep.summary(
        fx.ml_rows(spark, d), mlprep.is_even(F.col("leadingLepton_phi")), F.col("o_orderkey") % 10 < 3
    )
    return out.withColumn("percent", r(F.col("percent")))


@query(
    "feature_norm",
    with_ctes(
        f"""SELECT o_orderkey, round((pt - mp) / sp, 5) + 0.0 AS pt, round((phi - mf) / sf, 5) + 0.0 AS "leadingLepton_phi",
              round((met_pt - mm) / sm, 5) + 0.0 AS met_pt
            FROM ml CROSS JOIN (SELECT avg(pt) AS mp, stddev_samp(pt) AS sp, avg(phi) AS mf, stddev_samp(phi) AS sf,
              avg(met_pt) AS mm, stddev_samp(met_pt) AS sm FROM ml WHERE NOT ({_EVEN}))""",
        "ml",
    ),
)
def feature_norm(spark, d):
    """All rows scaled with the mean and sample deviation of the training rows."""
    features = ["pt", "leadingLepton_phi", "met_pt"]
    rows = fx.ml_rows(spark, d)
    train, _ = mlprep.parity_split(rows, split="even")
    out = mlprep.normalise(rows, train, features)
    return out.select("o_orderkey", *[r(F.col(c), 5).alias(c) for c in features])


def embedding_rows(spark, d):
    features = [f"x{i}" for i in range(64)]
    rows = fx.table(spark, d, "embeddings").select(
        "vec_id",
        (F.col("label") < 5).cast("double").alias("label"),
        (1 + F.col("vec_id") % 5).cast("double").alias("w"),
        (F.col("vec_id") % 2 == 0).alias("even"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)],
    )
    return rows, features


def linear(rows, features):
    return model.train(rows, features, "label", "w", kind="logistic", iterations=200, tol=1e-12)


@query("train_score")
def train_score(spark, d):
    """Weighted linear classifier per parity; every row is scored by the model that has not seen its parity."""
    rows, features = embedding_rows(spark, d)
    on_odd, on_even = (linear(rows.filter(keep), features) for keep in (~F.col("even"), F.col("even")))
    scored = model.score_by_parity(on_odd, on_even, rows, F.col("even"))
    return scored.select("vec_id", "label", "w", "score")


@query(
    "train_balance",
    """SELECT even, count(*) AS n, sum(w * y) AS true_weight, sum(w * y) AS scored_weight
       FROM (SELECT vec_id % 2 = 0 AS even, CAST(1 + vec_id % 5 AS DOUBLE) AS w, CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END AS y
             FROM embeddings) GROUP BY even""",
)
def train_balance(spark, d):
    """A converged linear classifier with a free intercept gives its own training rows their weight in the class."""
    rows, features = embedding_rows(spark, d)
    own = [
        model.score(linear(rows.filter(keep), features), rows.filter(keep)) for keep in (F.col("even"), ~F.col("even"))
    ]
    weight = lambda c: F.round(F.sum(F.col("w") * F.col(c)), 2)
    return own[0].unionByName(own[1]).groupBy("even").agg(
        F.count("*").alias("n"), weight("label").alias("true_weight"), weight("score").alias("scored_weight")
    )


@query(
    "class_check",
    with_ctes(
        """SELECT c.tag, count(m.tag) AS n FROM (VALUES ('HH'), ('background'), ('absent')) c(tag) LEFT JOIN ml m USING (tag)
           GROUP BY c.tag""",
        "ml",
    ),
)
def class_check(spark, d):
    return mlprep.class_rows(tagged(spark, d), (*CLASSES, "absent"))


def _network(spark, d, **options):
    rows, features = embedding_rows(spark, d)
    rows = rows.withColumn("held", F.col("vec_id") % 4 == 0)
    return rows, network.fit(rows, features, "label", "w", F.col("held"), **options)


@query(
    "network_balance",
    """SELECT vec_id % 4 = 0 AS held, count(*) AS n,
         CASE WHEN vec_id % 4 <> 0 THEN sum(w * y) END AS true_weight, CASE WHEN vec_id % 4 <> 0 THEN sum(w * y) END AS scored_weight
       FROM (SELECT vec_id, CAST(1 + vec_id % 5 AS DOUBLE) AS w, CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END AS y
             FROM embeddings) GROUP BY vec_id % 4 = 0, vec_id % 4 <> 0""",
)
def network_balance(spark, d):
    """A weighted network, scored as a column; its last offset gives the training rows their weight in the class."""
    rows, net = _network(spark, d, hidden=(16, 8), epochs=3, steps=4)
    rows = rows.withColumn("score", net.score({f: F.col(f) for f in net.features}))
    weight = lambda c: F.when(~F.first("held"), F.round(F.sum(F.col("w") * F.col(c)), 4))
    return rows.groupBy("held").agg(
        F.count("*").alias("n"), weight("label").alias("true_weight"), weight("score").alias("scored_weight")
    )


@query(
    "network_history",
    """SELECT CAST(e AS INTEGER) AS epoch, CAST((e + 1) * least(2, count(DISTINCT vec_id)) AS INTEGER) AS steps,
         CAST(0.02 AS DOUBLE) * CASE WHEN e < 3 THEN 1.0::DOUBLE WHEN e < 5 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS rate, e = 0 AS best,
         true AS finite
       FROM range(6) t(e), embeddings GROUP BY e""",
)
def network_history(spark, d):
    """No loss can be better by 100 than the first: two reductions, and the end after five epochs of waiting."""
    plan = network.Schedule(rate=0.02, min_delta=100.0, plateau=2, factor=0.5, patience=5)
    _, net = _network(spark, d, hidden=(4,), epochs=30, steps=2, schedule=plan, balance=False)
    finite = ~(F.isnan("loss") | F.isnan("val_loss")) & (F.col("loss") > 0) & (F.col("val_loss") > 0)
    return net.history(spark).select("epoch", "steps", "rate", "best", finite.alias("finite"))


@query(
    "trees_score",
    """SELECT vec_id, true AS equal, true AS inside FROM embeddings""",
)
def trees_score(spark, d):
    """Boosted trees, stopped early on the held rows, as a column; equal to the scores of the model's own transformer."""
    rows, features = embedding_rows(spark, d)
    rows = rows.withColumn("held", F.col("vec_id") % 4 == 0)
    made = model.train(rows, features[:8], "label", "w", kind="gbt", validation="held", iterations=6)
    own = scoring.of_pipeline(made)
    both = model.score(made, rows).withColumn("own", own)
    equal = F.abs(F.col("own") - F.col("score")) < 1e-9
    return both.select("vec_id", equal.alias("equal"), ((F.col("own") > 0) & (F.col("own") < 1)).alias("inside"))


@query(
    "discriminant",
    with_ctes("SELECT o_orderkey, round(ln(score / (1 - score)), 6) + 0.0 AS d_hh FROM ml", "ml"),
)
def discriminant(spark, d):
    p = F.col("score")
    return fx.ml_rows(spark, d).select("o_orderkey", r(mlprep.discriminant([p], [1 - p]), 6).alias("d_hh"))


# --- ROC -------------------------------------------------------------------------------------------------------

_STEPS = """
SELECT threshold, pos, neg, s, b, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(s) OVER w - s AS s_above, sum(b) OVER w - b AS b_above, row_number() OVER w AS rank,
  lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
FROM (SELECT score AS threshold, coalesce(sum(w_roc) FILTER (tag = 'HH'), 0) AS pos,
        coalesce(sum(w_roc) FILTER (tag <> 'HH'), 0) AS neg, coalesce(sum(w_sig) FILTER (tag = 'HH'), 0) AS s,
        coalesce(sum(w_sig) FILTER (tag <> 'HH'), 0) AS b FROM ml GROUP BY score)
WINDOW w AS (ORDER BY threshold DESC)"""
_SIG = """
SELECT threshold, s_above, b_above, CASE WHEN b_above > 0 AND s_above > 0
    AND (s_above + b_above) * ln(1 + s_above / b_above) - s_above >= 0
  THEN sqrt(2 * ((s_above + b_above) * ln(1 + s_above / b_above) - s_above)) ELSE 0.0 END AS z
FROM (SELECT *, row_number() OVER (ORDER BY threshold DESC) AS i, count(*) OVER () AS kept FROM steps
      WHERE rank = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg)
WHERE i % greatest(CAST(floor((kept + 1) / 100) AS BIGINT), 1) = 0"""


def scored(spark, d):
    df = tagged(spark, d)
    return df, (F.col("tag") == "HH").cast("int")


def hh_curve(spark, d, **options):
    df, y = scored(spark, d)
    return roc.curve(df, y, F.col("score"), F.col("w_roc"), sig_weight=F.col("w_sig"), **options)


@query(
    "roc",
    with_ctes(
        """SELECT threshold, tp, fp, round(tp / (SELECT sum(pos) FROM steps), 6) + 0.0 AS tpr,
             round(fp / (SELECT sum(neg) FROM steps), 6) + 0.0 AS fpr FROM steps""",
        "ml",
        steps=_STEPS,
    ),
)
def roc_points(spark, d):
    return hh_curve(spark, d).select(
        "threshold", "tp", "fp", r(F.col("tpr"), 6).alias("tpr"), r(F.col("fpr"), 6).alias("fpr")
    )


@query(
    "auc",
    with_ctes(
        """SELECT round(sum((fpr - lag_fpr) * (tpr + lag_tpr) / 2), 6) + 0.0 AS auc FROM (
             SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY threshold DESC), 0) AS lag_fpr,
               coalesce(lag(tpr) OVER (ORDER BY threshold DESC), 0) AS lag_tpr
             FROM (SELECT threshold, tp / (SELECT sum(pos) FROM steps) AS tpr, fp / (SELECT sum(neg) FROM steps) AS fpr FROM steps))""",
        "ml",
        steps=_STEPS,
    ),
)
def auc(spark, d):
    return roc.auc(hh_curve(spark, d)).select(r(F.col("auc"), 6).alias("auc"))


_GRID = """
SELECT tag, cell, threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS all_pos, sum(neg) OVER a AS all_neg
FROM (SELECT sample AS tag, least(CAST(floor(score * 32) AS INTEGER), 31) AS cell, least(floor(score * 32), 31) / 32.0::DOUBLE AS threshold,
        coalesce(sum(w_roc) FILTER (tag = 'HH' OR o_orderkey % 3 = 0), 0) AS pos,
        coalesce(sum(w_roc) FILTER (NOT (tag = 'HH' OR o_orderkey % 3 = 0)), 0) AS neg FROM ml GROUP BY ALL)
WINDOW w AS (PARTITION BY tag ORDER BY cell DESC), a AS (PARTITION BY tag)"""


def _sample_grid(spark, d):
    """Two parts of the rows, merged; with labels that give every sample both classes."""
    rows = tagged(spark, d)
    y = ((F.col("tag") == "HH") | (F.col("o_orderkey") % 3 == 0)).cast("int")
    parts = [rows.filter(F.col("o_orderkey") % 2 == i) for i in (0, 1)]
    grids = [roc.grid(p, y, F.col("score"), F.col("w_roc"), ["sample"], cells=32) for p in parts]
    return rows.withColumn("y", y), roc.grid_curve(roc.merged(grids, ["sample"]), ["sample"], cells=32)


@query(
    "roc_grid",
    with_ctes(
        """SELECT tag AS sample, cell, threshold, tp, fp, round(tp / nullif(all_pos, 0), 6) + 0.0 AS tpr, round(fp / nullif(all_neg, 0), 6) + 0.0 AS fpr,
             round(pos / nullif(all_pos, 0), 6) + 0.0 AS tpr_error FROM grid""",
        "ml",
        grid=_GRID,
    ),
)
def roc_grid(spark, d):
    """Curves per sample from grids of 32 cells, exact at the cells' edges."""
    _, points = _sample_grid(spark, d)
    rates = [(r(F.col(c), 6) + 0.0).alias(c) for c in ("tpr", "fpr", "tpr_error")]
    return points.select("sample", "cell", "threshold", "tp", "fp", *rates)


@query(
    "auc_grid",
    with_ctes(
        """SELECT tag AS sample, round(sum(neg * (tp - pos / 2)) / nullif(max(all_pos) * max(all_neg), 0) + 1e-9, 6) + 0.0 AS auc,
             round(sum(pos * neg / 2) / nullif(max(all_pos) * max(all_neg), 0) + 1e-9, 6) + 0.0 AS error, CASE WHEN max(all_pos) * max(all_neg) > 0 THEN true END AS covers
           FROM grid GROUP BY tag""",
        "ml",
        grid=_GRID,
    ),
)
def auc_grid(spark, d):
    """Areas with their errors; the exact area of every sample lies inside."""
    rows, points = _sample_grid(spark, d)
    exact = roc.auc(roc.curve(rows, F.col("y"), F.col("score"), F.col("w_roc"), ["sample"]), ["sample"])
    both = roc.grid_auc(points, ["sample"]).join(exact.withColumnRenamed("auc", "exact"), "sample")
    covers = F.abs(F.col("auc") - F.col("exact")) <= F.col("error") + 1e-12
    return both.select(
        "sample", (r(F.col("auc") + 1e-9, 6) + 0.0).alias("auc"), (r(F.col("error") + 1e-9, 6) + 0.0).alias("error"), covers.alias("covers")
    )


@query(
    "significance",
    with_ctes(f"SELECT threshold, s_above, b_above, round(z, 6) + 0.0 AS z FROM ({_SIG})", "ml", steps=_STEPS),
)
def significance(spark, d):
    sig = roc.significance(hh_curve(spark, d, drop_intermediate=True))
    return sig.select("threshold", "s_above", "b_above", r(F.col("z"), 6).alias("z"))


@query(
    "best_wp",
    with_ctes(
        f"SELECT threshold, round(z, 6) + 0.0 AS z FROM ({_SIG}) ORDER BY z DESC, threshold DESC LIMIT 1",
        "ml",
        steps=_STEPS,
    ),
)
def best_wp(spark, d):
    sig = roc.significance(hh_curve(spark, d, drop_intermediate=True))
    return roc.best_working_point(sig).select("threshold", r(F.col("z"), 6).alias("z"))


@query(
    "roc_multi",
    with_ctes(
        """SELECT "class", threshold, round(sum(pos) OVER w / sum(pos) OVER (PARTITION BY "class"), 6) + 0.0 AS tpr,
             round(sum(neg) OVER w / sum(neg) OVER (PARTITION BY "class"), 6) + 0.0 AS fpr
           FROM (SELECT "class", threshold, coalesce(sum(w_roc) FILTER (y), 0) AS pos, coalesce(sum(w_roc) FILTER (NOT y), 0) AS neg
                 FROM (SELECT 'HH' AS "class", score AS threshold, tag = 'HH' AS y, w_roc FROM ml
                       UNION ALL SELECT 'background', 1 - score, tag = 'background', w_roc FROM ml) GROUP BY 1, 2)
           WINDOW w AS (PARTITION BY "class" ORDER BY threshold DESC)""",
        "ml",
    ),
)
def roc_multi(spark, d):
    df = tagged(spark, d).select("tag", "w_roc", F.col("score").alias("p"))
    rows = roc.one_vs_rest(df, F.col("tag"), {"HH": F.col("p"), "background": 1 - F.col("p")})
    points = roc.curve(rows, F.col("y"), F.col("score"), F.col("w_roc"), by=["class"])
    return points.select("class", "threshold", r(F.col("tpr"), 6).alias("tpr"), r(F.col("fpr"), 6).alias("fpr"))


_BY_CLASS = """
SELECT "class", threshold, s - own_s AS s_above, b - own_b AS b_above, rank FROM (
  SELECT *, sum(own_s) OVER w AS s, sum(own_b) OVER w AS b, row_number() OVER w AS rank,
    lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
  FROM (SELECT "class", threshold, coalesce(sum(w_roc) FILTER (y), 0) AS pos, coalesce(sum(w_roc) FILTER (NOT y), 0) AS neg,
          coalesce(sum(w_sig) FILTER (y), 0) AS own_s, coalesce(sum(w_sig) FILTER (NOT y), 0) AS own_b
        FROM (SELECT 'HH' AS "class", score AS threshold, tag = 'HH' AS y, w_roc, w_sig FROM ml
              UNION ALL SELECT 'background', 1 - score, tag = 'background', w_roc, w_sig FROM ml) GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY "class" ORDER BY threshold DESC))
WHERE rank = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"""


@query(
    "significance_by_class",
    with_ctes(
        """SELECT "class", threshold, s_above, b_above, CASE WHEN s_above > 0 AND b_above > 0 THEN round(sqrt(greatest(
             2 * ((s_above + b_above) * ln(1 + s_above / b_above) - s_above), 0)), 6) ELSE 0.0 END + 0.0 AS z
           FROM (SELECT *, row_number() OVER (PARTITION BY "class" ORDER BY threshold DESC) AS i,
                   count(*) OVER (PARTITION BY "class") AS kept FROM by_class)
           WHERE i % greatest(CAST(floor((kept + 1) / 100) AS BIGINT), 1) = 0""",
        "ml",
        by_class=_BY_CLASS,
    ),
)
def significance_by_class(spark, d):
    df = tagged(spark, d).select("tag", "w_roc", "w_sig", F.col("score").alias("p"))
    rows = roc.one_vs_rest(df, F.col("tag"), {"HH": F.col("p"), "background": 1 - F.col("p")})
    points = roc.curve(
        rows, F.col("y"), F.col("score"), F.col("w_roc"), ["class"], sig_weight=F.col("w_sig"), drop_intermediate=True
    )
    sig = roc.significance(points, by=["class"])
    return sig.select("class", "threshold", "s_above", "b_above", r(F.col("z"), 6).alias("z"))


@query(
    "roc_discriminant",
    with_ctes(
        """SELECT round(ln(threshold / (1 - threshold)), 6) + 0.0 AS threshold, tp, fp,
             round(tp / (SELECT sum(pos) FROM steps), 6) + 0.0 AS tpr, round(fp / (SELECT sum(neg) FROM steps), 6) + 0.0 AS fpr
           FROM steps""",
        "ml",
        steps=_STEPS,
    ),
)
def roc_discriminant(spark, d):
    """The curve of the log ratio of signal and background outputs."""
    df, y = scored(spark, d)
    p = F.col("score")
    points = roc.curve(df, y, mlprep.discriminant([p], [1 - p]), F.col("w_roc"))
    return points.select(*[r(F.col(c), 6).alias(c) for c in ("threshold", "tpr", "fpr")], "tp", "fp")


_KINDS = ("ggHH", "TTbar", "DY", "WW")


@query(
    "roc_pairwise",
    with_ctes(
        """SELECT class_a, class_b, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) + 0.0 AS auc
           FROM (SELECT class_a, class_b, pos, neg, sum(pos) OVER (PARTITION BY class_a, class_b ORDER BY score DESC) AS tp
                 FROM (SELECT a.k AS class_a, b.k AS class_b, score, coalesce(sum(w_roc) FILTER (m.kind = a.k), 0) AS pos,
                         coalesce(sum(w_roc) FILTER (m.kind = b.k), 0) AS neg
                       FROM kinds a JOIN kinds b ON a.i < b.i JOIN (SELECT *, split_part(process, '__', 1) AS kind FROM ml) m
                         ON m.kind = a.k OR m.kind = b.k GROUP BY 1, 2, 3))
           GROUP BY 1, 2""",
        "ml",
        kinds="SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(_KINDS)) + ") t(i, k)",
    ),
)
def roc_pairwise(spark, d):
    kind = F.split_part(F.col("process"), F.lit("__"), F.lit(1))
    rows = roc.pairwise(fx.ml_rows(spark, d).select("score", "w_roc", kind.alias("kind")), F.col("kind"), _KINDS)
    by = ["class_a", "class_b"]
    points = roc.curve(rows, F.col("y"), F.col("score"), F.col("w_roc"), by=by)
    return roc.auc(points, by).withColumn("auc", r(F.col("auc"), 6))


# --- score histograms and evaluation ---------------------------------------------------------------------------

_SCORE_BINS = """
SELECT tag, CAST(floor(50 * ((score - lo) / (hi - lo))) AS INTEGER) + 1 AS bin, sum(w_sig) AS sumw, count(*) AS n
FROM ml CROSS JOIN (SELECT min(score) AS lo, max(score) AS hi FROM ml) WHERE score < hi GROUP BY 1, 2"""


def score_bins(spark, d):
    return hist.adaptive(tagged(spark, d), "score", 50, F.col("w_sig"), ["tag"], closed=False)


@query("score_hist", with_ctes("SELECT tag, bin, sumw, n FROM bins", "ml", bins=_SCORE_BINS))
def score_hist(spark, d):
    return score_bins(spark, d).select("tag", "bin", "sumw", "n")


_OUTPUTS = {"HH": "score", "background": "1 - score"}


@query(
    "score_hist_all",
    with_ctes(
        " UNION ALL ".join(
            f"""SELECT '{out}' AS output, '{w}' AS weight, tag, CAST(floor(50 * ((p - lo) / (hi - lo))) AS INTEGER) + 1 AS bin,
                  sum({w}) AS sumw, count(*) AS n
                FROM (SELECT *, {p} AS p FROM ml) CROSS JOIN (SELECT min({p}) AS lo, max({p}) AS hi FROM ml)
                WHERE p < hi GROUP BY ALL"""
            for out, p in _OUTPUTS.items()
            for w in ("w_roc", "w_sig")
        ),
        "ml",
    ),
)
def score_hist_all(spark, d):
    """Every output of the classifier, per class and with both weights."""
    df = tagged(spark, d).withColumns({f"out_{c}": F.expr(p) for c, p in _OUTPUTS.items()})
    each = [
        hist.adaptive(df, f"out_{c}", 50, F.col(w), ["tag"], closed=False).select(
            F.lit(c).alias("output"), F.lit(w).alias("weight"), "tag", "bin", "sumw", "n"
        )
        for c in _OUTPUTS
        for w in ("w_roc", "w_sig")
    ]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(
    "score_cumulative",
    with_ctes(
        """SELECT tag, bin, round(sum(sumw) OVER (PARTITION BY tag ORDER BY bin) / sum(sumw) OVER (PARTITION BY tag), 6) + 0.0
             AS cum_left,
             round(sum(sumw) OVER (PARTITION BY tag ORDER BY bin DESC) / sum(sumw) OVER (PARTITION BY tag), 6) + 0.0 AS cum_right
           FROM (SELECT t.tag, g.bin::INTEGER AS bin, coalesce(b.sumw, 0) AS sumw FROM (SELECT DISTINCT tag FROM ml) t
                 CROSS JOIN range(1, 51) g(bin) LEFT JOIN bins b ON b.tag = t.tag AND b.bin = g.bin)""",
        "ml",
        bins=_SCORE_BINS,
    ),
)
def score_cumulative(spark, d):
    cum = hist.cumulative(hist.every_bin(score_bins(spark, d), 50, ["tag"]), ["tag"])
    return cum.select("tag", "bin", r(F.col("cum_left"), 6).alias("cum_left"), r(F.col("cum_right"), 6).alias("cum_right"))


@query(
    "eval_metrics",
    with_ctes(
        """SELECT round(sum(w_roc * -CASE WHEN tag = 'HH' THEN ln(score) ELSE ln(1 - score) END) / count(*), 6) + 0.0 AS loss,
             round(avg(CASE WHEN (score > 0.5) = (tag = 'HH') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy,
             round(count(*) FILTER (score > 0.5 AND tag = 'HH') / count(*) FILTER (score > 0.5), 6) + 0.0 AS precision,
             round(count(*) FILTER (score > 0.5 AND tag = 'HH') / count(*) FILTER (tag = 'HH'), 6) + 0.0 AS recall,
             count(*) FILTER (score > 0.5 AND tag <> 'HH') AS false_positives, count(*) AS n,
             (SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) + 0.0 FROM areas) AS auc FROM ml""",
        "ml",
        areas="""SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp FROM (
          SELECT score, count_if(tag = 'HH')::DOUBLE AS pos, count_if(tag <> 'HH')::DOUBLE AS neg FROM ml GROUP BY score)""",
    ),
)
def eval_metrics(spark, d):
    df, y = scored(spark, d)
    out = mlprep.evaluate(df, y, F.col("score"), F.col("w_roc"))
    return out.withColumns({c: r(F.col(c), 6) for c in ("loss", "accuracy", "precision", "recall", "auc")})
