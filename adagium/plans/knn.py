"""Plans of the nearest-neighbour workload on the embeddings table.

Stand-ins: rows with vec_id divisible by 50 ask, and every row of the table but the
query itself is a reference; theme, main class and subgroup codes derive from
label and vec_id; the centroid of each subgroup is its definition.
"""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from adagium.functions import fixed
from adagium.operators import corpus, inference, knn, metrics
from adagium.plans.corpus import _DEFS as _THEMES
from adagium.plans.registry import query, table

K = fixed.KNN_K


def _codes(df):
    theme = F.char((F.lit(65) + F.col("label")).cast("int"))
    main = F.concat(theme, (F.col("vec_id") % 3).cast("string"))
    return df.withColumns({"theme": theme, "main_class": main, "subgroup_code": F.concat(main, F.char((F.lit(97) + F.col("vec_id") % 2).cast("int")))})


def _parts(spark, d):
    e = _codes(table(spark, d, "embeddings"))
    q = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "q").withColumn("own", F.col("q"))
    return q, e.withColumnRenamed("vec_id", "ref").withColumn("own", F.col("ref"))


_E = """e AS (SELECT vec_id, label, chr(65 + label) AS theme, concat(chr(65 + label), (vec_id % 3)::VARCHAR) AS main_class, concat(chr(65 + label), (vec_id % 3)::VARCHAR, chr((97 + vec_id % 2)::INT)) AS subgroup_code,
  list_transform(embedding, lambda x: x::DOUBLE) AS v0 FROM embeddings),
n AS (SELECT * EXCLUDE (v0), list_transform(v0, lambda x: x / sqrt(list_dot_product(v0, v0))) AS v FROM e),
qs AS (SELECT vec_id AS q, * EXCLUDE (vec_id) FROM n WHERE vec_id % 50 = 0), rs AS (SELECT vec_id AS ref, * EXCLUDE (vec_id) FROM n)"""
_TOP = f"""{_E}, nn AS (SELECT q, ref, sim, r AS rank FROM (SELECT q, ref, list_dot_product(qs.v, rs.v) AS sim, row_number() OVER (PARTITION BY q ORDER BY list_dot_product(qs.v, rs.v) DESC, ref) AS r FROM qs, rs WHERE ref <> q) WHERE r <= {K})"""


def _votes_sql(name: str, near: str, labels: str, keys: str = "q") -> str:
    return f"""{name}0 AS (SELECT {keys}, code, sum(greatest(sim, 0)) AS w, count(*) AS n FROM {near} JOIN ({labels}) USING (ref) GROUP BY ALL),
{name}1 AS (SELECT {keys}, code, CASE WHEN sum(w) OVER (PARTITION BY {keys}) > 0 THEN w ELSE n END AS weight FROM {name}0),
{name} AS (SELECT *, weight / greatest(sum(weight) OVER (PARTITION BY {keys}), 1e-9) AS share, row_number() OVER (PARTITION BY {keys} ORDER BY weight DESC, code) AS rank FROM {name}1)"""


_THEME = _votes_sql("tv", "nn", "SELECT ref, theme AS code FROM rs")


def _near(spark, d):
    q, r = _parts(spark, d)
    return q, r, knn.neighbours(q, r, K, exclude="own")


def _theme_votes(spark, d):
    q, r, near = _near(spark, d)
    return q, knn.vote(near, r.select("ref", F.col("theme").alias("code")))


@query(f"WITH {_TOP} SELECT q, ref, round(sim, 6) AS sim, rank FROM nn")
def knn_top15(spark, d):
    """J8, N1, N2, W4."""
    return _near(spark, d)[2].select("q", "ref", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TOP}, {_THEME} SELECT q, code, round(share, 6) AS share FROM tv WHERE rank = 1")
def knn_vote(spark, d):
    """N3, A10, A11, W6."""
    q, r, near = _near(spark, d)
    return knn.predict(near, r.select("ref", F.col("theme").alias("code")), q).withColumn("share", F.round("share", 6))


@query(f"WITH {_TOP}, {_THEME} SELECT q.q, c.code, round(coalesce(tv.share, 0), 6) AS share FROM qs q CROSS JOIN (SELECT DISTINCT theme AS code FROM rs) c LEFT JOIN tv ON tv.q = q.q AND tv.code = c.code")
def knn_distribution(spark, d):
    """N10."""
    q, v = _theme_votes(spark, d)
    codes = _parts(spark, d)[1].select(F.col("theme").alias("code")).distinct()
    return knn.distribution(v, codes).select("q", "code", F.round("share", 6).alias("share"))


@query(f"WITH {_TOP}, {_THEME} SELECT q, code, rank, round(share, 3) AS share FROM tv WHERE rank <= 3")
def top3_themes(spark, d):
    """N11, W5."""
    return knn.top_codes(_theme_votes(spark, d)[1], 3).select("q", "code", F.col("rank").cast("long").alias("rank"), F.round("share", 3).alias("share"))


@query(f"WITH {_TOP}, {_THEME} SELECT count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS top1, round(avg((coalesce(rank, 99) <= 2)::INT), 6) AS top2, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS top3 FROM qs LEFT JOIN tv ON tv.q = qs.q AND tv.code = qs.theme")
def topn_hits(spark, d):
    """E9."""
    q, v = _theme_votes(spark, d)
    ranked = knn.top_codes(v, 3).select("q", F.col("code").alias("theme"), "rank")
    hits = metrics.hit_rates(q.select("q", "theme").join(ranked, ["q", "theme"], "left"))
    return hits.withColumns({f"top{k}": F.round(f"top{k}", 6) for k in (1, 2, 3)})


_DEF = """, cx AS (SELECT theme, main_class, subgroup_code, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM rs),
cm AS (SELECT theme, main_class, subgroup_code, i, avg(x) AS x FROM cx GROUP BY ALL),
c0 AS (SELECT theme, main_class, subgroup_code, list(x ORDER BY i) AS v0 FROM cm GROUP BY ALL),
ds AS (SELECT row_number() OVER (ORDER BY subgroup_code) AS ref, theme, main_class, subgroup_code, list_transform(v0, lambda x: x / sqrt(list_dot_product(v0, v0))) AS v FROM c0),
dn AS (SELECT q, theme, main_class, subgroup_code FROM (SELECT q, ds.theme, ds.main_class, ds.subgroup_code, row_number() OVER (PARTITION BY q ORDER BY list_dot_product(qs.v, ds.v) DESC, ref) AS r FROM qs, ds) WHERE r = 1)"""


def _definitions(spark, d):
    """A definition for each subgroup: the mean of its unit vectors; ref by the order of the codes."""
    q, r = _parts(spark, d)
    at = r.select("theme", "main_class", "subgroup_code", F.posexplode(knn.unit(F.col("embedding"))).alias("i", "x"))
    mean = at.groupBy("theme", "main_class", "subgroup_code", "i").agg(F.avg("x").alias("x"))
    defs = mean.groupBy("theme", "main_class", "subgroup_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    return q, defs.withColumn("ref", F.row_number().over(W.orderBy("subgroup_code")).cast("long"))  # a row a code


@query(f"WITH {_E}{_DEF} SELECT q, theme AS code FROM dn")
def def_nearest(spark, d):
    """N9, flat."""
    q, defs = _definitions(spark, d)
    return knn.nearest(q, defs, defs.select("ref", F.col("theme").alias("code")))


@query(f"WITH {_E}{_DEF}, dm AS (SELECT q, main_class FROM (SELECT dn.q, ds.main_class, row_number() OVER (PARTITION BY dn.q ORDER BY list_dot_product(qs.v, ds.v) DESC, ref) AS r FROM dn JOIN qs USING (q) JOIN ds ON ds.theme = dn.theme) WHERE r = 1) SELECT dn.q, dn.theme, dm.main_class FROM dn JOIN dm USING (q)")
def def_cascade(spark, d):
    """N9, cascade: the main class among the definitions of the nearest theme."""
    q, defs = _definitions(spark, d)
    theme = knn.nearest(q, defs, defs.select("ref", F.col("theme").alias("code"))).withColumnRenamed("code", "theme")
    q2 = q.drop("theme").join(theme, "q")
    main = knn.nearest(q2, defs, defs.select("ref", F.col("main_class").alias("code")), pool=["theme"])
    return main.select("q", "theme", F.col("code").alias("main_class"))


def _stage(name: str, source: str, on: str, code: str, where: str = "true") -> str:
    near = f"""{name}n AS (SELECT q, ref, sim FROM (SELECT s.q, rs.ref, list_dot_product(qs.v, rs.v) AS sim, row_number() OVER (PARTITION BY s.q ORDER BY list_dot_product(qs.v, rs.v) DESC, rs.ref) AS r FROM {source} s JOIN qs ON qs.q = s.q JOIN rs ON {on}
WHERE rs.ref // 3 % 3 <> qs.q // 3 % 3 AND {where}) WHERE r <= {K})"""
    return near + ", " + _votes_sql(f"{name}v", f"{name}n", f"SELECT ref, {code} AS code FROM rs") + f", {name} AS (SELECT qs.q, coalesce(v.code, '') AS code FROM qs LEFT JOIN {name}v v ON v.q = qs.q AND v.rank = 1)"


_CASCADE = f"""{_E}, {_stage("th", "qs", "true", "theme")}, {_stage("mn", "(SELECT q, code FROM th)", "rs.theme = s.code", "main_class")}, {_stage("sb", "(SELECT q, code FROM mn)", "rs.main_class = s.code", "subgroup_code")}, {_stage("fl", "qs", "true", "subgroup_code")},
cp AS (SELECT th.q, th.code AS pred_theme, mn.code AS pred_main, sb.code AS pred_sub, fl.code AS flat_sub FROM th JOIN mn USING (q) JOIN sb USING (q) JOIN fl USING (q))"""


def _cascade(spark, d):
    q, r = _parts(spark, d)
    fold = lambda c: F.floor(F.col(c) / 3) % 3
    q = q.withColumn("fold", fold("q")).drop("theme", "main_class", "subgroup_code", "own")
    r = r.withColumns({"fold": fold("ref"), "source_type": F.lit("example")})
    return knn.cascade(q, r, K, fold="fold").select("q", "pred_theme", "pred_main", "pred_sub", "flat_sub")


@query(f"WITH {_CASCADE} SELECT * FROM cp")
def cascade_cv(spark, d):
    """Examples of the query's own fold are no candidates."""
    return _cascade(spark, d)


@query(f"""WITH {_CASCADE} SELECT count(*) AS n, round(avg((pred_theme = theme)::INT), 6) AS theme_acc, round(avg((pred_main = main_class)::INT), 6) AS main_acc, round(avg((pred_sub = subgroup_code)::INT), 6) AS sub_acc, round(avg((flat_sub = subgroup_code)::INT), 6) AS flat_acc,
round(avg((pred_main = main_class)::INT) FILTER (pred_theme = theme), 6) AS main_given_theme FROM cp JOIN qs USING (q)""")
def flat_vs_cascade(spark, d):
    """A4, A5 on the cascade and the flat baseline."""
    j = _cascade(spark, d).join(_parts(spark, d)[0].select("q", "theme", "main_class", "subgroup_code"), "q")
    ok = lambda p, g: (F.col(p) == F.col(g)).cast("double")
    pairs = {"theme_acc": ("pred_theme", "theme"), "main_acc": ("pred_main", "main_class"), "sub_acc": ("pred_sub", "subgroup_code"), "flat_acc": ("flat_sub", "subgroup_code")}
    return j.agg(F.count("*").alias("n"), *[F.round(F.avg(ok(*p)), 6).alias(k) for k, p in pairs.items()], F.round(metrics.conditional_mean(ok("pred_main", "main_class"), ok("pred_theme", "theme")), 6).alias("main_given_theme"))


_SUBS = _votes_sql("sv", "nn", "SELECT ref, subgroup_code AS code FROM rs")


@query(f"WITH {_TOP}, {_SUBS} SELECT q, code, rank FROM sv WHERE rank <= 10")
def shortlist(spark, d):
    """N7."""
    _, r, near = _near(spark, d)
    return knn.top_codes(knn.vote(near, r.select("ref", F.col("subgroup_code").alias("code"))), 10).select("q", "code", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_TOP}, {_SUBS}, h AS (SELECT qs.q, max((sv.code = subgroup_code)::INT) AS hit, max((sv.code = subgroup_code AND rank = 1)::INT) AS picked FROM qs JOIN sv ON sv.q = qs.q AND rank <= 10 GROUP BY 1)
SELECT round(avg(hit), 6) AS recall, round(avg(picked) FILTER (hit = 1), 6) AS precision_in_list FROM h""")
def shortlist_recall(spark, d):
    """E10, A5."""
    q, r, near = _near(spark, d)
    top = knn.top_codes(knn.vote(near, r.select("ref", F.col("subgroup_code").alias("code"))), 10).join(q.select("q", "subgroup_code"), "q")
    same = F.col("code") == F.col("subgroup_code")
    h = top.groupBy("q").agg(F.max(same.cast("int")).alias("hit"), F.max((same & (F.col("rank") == 1)).cast("int")).alias("picked"))
    return h.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"), F.round(metrics.conditional_mean(F.col("picked"), F.col("hit")), 6).alias("precision_in_list"))


@query(f"""WITH {_TOP}, {_SUBS}, l AS (SELECT q, count(*) AS n, max_by(code, rank) AS c FROM sv WHERE rank <= 10 GROUP BY 1)
SELECT qs.q, coalesce(n, 0) AS n_candidates, coalesce(c, '') AS pick FROM qs LEFT JOIN l ON l.q = qs.q""")
def shortlist_pick(spark, d):
    """Shortlist, then a (mock) model's pick of its last code."""
    q, r = _parts(spark, d)
    defs = r.select(F.col("subgroup_code").alias("code")).distinct().withColumn("text", F.concat(F.lit("about "), F.col("code")))
    client = inference.mock_client(lambda p: '{"code": "' + p.split("\n\n")[1].split("\n")[-1].split(":")[0] + '"}')
    labels = r.select("ref", F.col("subgroup_code").alias("code"))
    out = inference.shortlist_and_pick(q.withColumn("text", F.col("q").cast("string")), r, labels, defs, client, "Pick one code.", exclude="own")
    return out.select("q", F.size("candidates").cast("long").alias("n_candidates"), "pick")


@query(f"""WITH {_THEMES}, th AS (SELECT min(code) AS c FROM defs WHERE level = 'theme'), mn AS (SELECT min(code) AS c FROM defs, th WHERE level = 'main' AND code[1:1] = th.c)
SELECT item_id, th.c AS pred_theme, coalesce(mn.c, '') AS pred_main, '' AS pred_sub FROM benchmark, th, mn""")
def definition_llm_cascade(spark, d):
    """A cascade over definitions with a (mock) model that takes the first option; subgroups don't exist, so it ends there."""
    from adagium.plans.corpus import _definitions as themes

    client = inference.mock_client(lambda p: "CODE: " + p.split("\n\n")[1].split(":")[0] if ":" in p else "")
    rows = table(spark, d, "benchmark").select("item_id", "text")
    return inference.definition_cascade(rows, themes(spark, d), client, "Pick a code.").select("item_id", "pred_theme", "pred_main", "pred_sub")


_FUSE = f"""{_TOP}, n5 AS (SELECT * FROM nn WHERE rank <= 5), {_THEME}, {_votes_sql("t5", "n5", "SELECT ref, theme AS code FROM rs")},
fz AS (SELECT q, code, sum(share) / 2 AS w FROM (SELECT q, code, share FROM tv UNION ALL SELECT q, code, share FROM t5) GROUP BY 1, 2),
fr AS (SELECT q, code, row_number() OVER (PARTITION BY q ORDER BY round(w, 9) DESC, code) AS r FROM fz),
fc AS (SELECT q, list(code ORDER BY r) AS codes FROM fr WHERE r <= 3 GROUP BY 1)"""


@query(f"""WITH {_FUSE} SELECT fc.q, array_to_string(codes, ',') AS codes, CASE WHEN a.code = b.code THEN 'HIGH' WHEN list_contains(codes, b.code) THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM fc JOIN tv a ON a.q = fc.q AND a.rank = 1 JOIN t5 b ON b.q = fc.q AND b.rank = 1""")
def fuse_top3_confidence(spark, d):
    """The votes of 15 and of 5 neighbours as the two methods."""
    q, r, near = _near(spark, d)
    labels = r.select("ref", F.col("theme").alias("code"))
    a, b = knn.vote(near, labels), knn.vote(near.filter("rank <= 5"), labels)
    return knn.confidence(a, b).select("q", F.array_join("codes", ",").alias("codes"), "confidence")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v0 FROM embeddings), n AS (SELECT vec_id, label, list_transform(v0, lambda x: x / sqrt(list_dot_product(v0, v0))) AS v FROM e),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id <> b.vec_id THEN 1 - list_dot_product(a.v, b.v) ELSE 0 END) AS t, count(*) FILTER (a.vec_id <> b.vec_id) AS k FROM n a, n b GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(t / k) FILTER (label = other AND k > 0) AS a, min(t / k) FILTER (label <> other) AS b FROM d GROUP BY 1)
SELECT count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""")
def silhouette_cosine(spark, d):
    """N13."""
    s = knn.silhouette(table(spark, d, "embeddings").withColumnRenamed("vec_id", "q"))
    return s.select("n", F.round("silhouette", 6).alias("silhouette"))


@query("SELECT vec_id, theme, main_class, label AS depth FROM (SELECT vec_id, chr(65 + label) AS theme, concat(chr(65 + label), (vec_id % 3)::VARCHAR) AS main_class, label FROM embeddings)")
def reference_index(spark, d):
    """P13, P14, K6's table: codes of every reference row."""
    e = _codes(table(spark, d, "embeddings"))
    p = corpus.parent_codes(F.col("subgroup_code"))
    return e.select("vec_id", p["theme"].alias("theme"), p["main_class"].alias("main_class"), F.col("label").alias("depth"))
