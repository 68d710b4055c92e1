"""Plans of the annotation and evaluation workload: votes, agreement, metrics, comparisons, models."""

from __future__ import annotations


from pyspark.sql import functions as F

from adagium.functions.replies import mock_sum_label
from adagium.functions import rules
from adagium.operators import inference, metrics, models, votes
from adagium.operators.sampling import split
from adagium.plans.registry import TEMPLATED_SQL, query, table, templated
from adagium.shared import materialize

# Three deterministic raters: each vote is a hexadecimal digit of md5(doc_id:rater); 15 abstains, the third one is reversed.
_RATERS = (("r1", 10), ("r2", 9), ("r3", 3))
_DIGIT = "strpos('0123456789abcdef', substring(md5(concat(doc_id::VARCHAR, ':{r}')), 1, 1)) - 1"
_BASE = "(strpos('0123456789abcdef', substring(md5(concat(doc_id::VARCHAR, ':base')), 1, 1)) - 1) % 2"
_VOTES = "vt AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS item, '{r}' AS rater, {i} AS ord, CASE WHEN {_DIGIT.format(r=r)} = 15 THEN '' WHEN {_DIGIT.format(r=r)} < {k} THEN ({_BASE})::VARCHAR ELSE (1 - {_BASE})::VARCHAR END AS value FROM documents" for i, (r, k) in enumerate(_RATERS)
) + ")"


def _digit(key: str):
    return F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{key}"))), 1, 1), 16, 10).cast("int")


def _votes(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    base = _digit("base") % 2
    frames = []
    for r, k in _RATERS:
        v = _digit(r)
        frames.append((r, docs.select(F.col("doc_id").cast("string").alias("id"), F.when(v == 15, "").when(v < k, base.cast("string")).otherwise((1 - base).cast("string")).alias("v"))))
    return votes.votes_long(frames, "id", "v").withColumn("item", F.col("item").cast("long"))


@query(f"""WITH {_VOTES}, g AS (SELECT item, count(*) FILTER (value = '0') AS a, count(*) FILTER (value = '1') AS b, string_agg(value, ';' ORDER BY ord) FILTER (value <> '') AS raw FROM vt GROUP BY 1)
SELECT item, CASE WHEN a > b THEN '0' WHEN b > a THEN '1' ELSE '' END AS label, coalesce(raw, '') AS raw, a + b AS n_votes,
CASE WHEN a + b = 0 THEN 'insufficient (0 votes)' WHEN a = b THEN concat('TIE {{0: ', a::VARCHAR, ', 1: ', b::VARCHAR, '}} - needs adjudication') WHEN a + b = 1 THEN 'single vote only' WHEN greatest(a, b) = a + b THEN 'unanimous' ELSE 'majority' END AS agreement FROM g""".replace("{{", "{").replace("}}", "}"))
def vote_majority(spark, d):
    """A7, C9."""
    return votes.majority(_votes(spark, d))


@query(f"""WITH {_VOTES}, v AS (SELECT item, CASE WHEN value = '' THEN 'unknown' ELSE value END AS value FROM vt), g AS (SELECT item, count(*) FILTER (value = '0') AS a, count(*) FILTER (value = '1') AS b FROM v GROUP BY 1)
SELECT item, CASE WHEN a > b THEN '0' WHEN b > a THEN '1' ELSE 'unknown' END AS label FROM g""")
def vote_ensemble(spark, d):
    """A8."""
    v = _votes(spark, d)
    return votes.ensemble(v.withColumn("value", F.when(F.col("value") == "", "unknown").otherwise(F.col("value"))))


_PAIRS = """SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) AS n, round(avg((a.value = b.value)::INT), 6) AS agreement, avg((a.value = b.value)::INT) < 0.4 AS reversed
FROM {t} a JOIN {t} b ON a.item = b.item AND a.ord < b.ord WHERE a.value IN ('0', '1') AND b.value IN ('0', '1') GROUP BY 1, 2"""


@query(f"WITH {_VOTES} " + _PAIRS.format(t="vt"))
def pair_agreement(spark, d):
    """A9, J2."""
    return votes.pair_agreement(_votes(spark, d)).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {_VOTES}, fl AS (SELECT item, rater, ord, CASE WHEN rater = 'r3' AND value = '0' THEN '1' WHEN rater = 'r3' AND value = '1' THEN '0' ELSE value END AS value FROM vt) " + _PAIRS.format(t="fl"))
def flip_and_recheck(spark, d):
    """The reversed rater turned round; the gate then passes."""
    v = votes.flip(_votes(spark, d), "r3")
    return votes.pair_agreement(v).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {_VOTES} SELECT 'r2' AS rater, item FROM vt WHERE rater = 'r1' AND item % 97 = 0")
def reviewer_coverage(spark, d):
    """Items that a rater lacks."""
    return votes.coverage_gaps(_votes(spark, d).filter("not (rater = 'r2' and item % 97 = 0)"))


@query("SELECT doc_id AS item FROM documents WHERE trim(text) <> trim(lower(text))")
def rater_text_mismatch(spark, d):
    """A18."""
    docs = table(spark, d, "documents")
    return votes.text_mismatches(docs.select(F.col("doc_id").alias("item"), "text").unionByName(docs.select(F.col("doc_id").alias("item"), F.lower("text").alias("text"))))


_LAB = "(SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)"
_PRED_DIGIT = "strpos('0123456789abcdef', substring(md5(concat(doc_id::VARCHAR, ':{m}')), 1, 1)) - 1"


def _pred_sql(m: str, k: int) -> str:
    v = _PRED_DIGIT.format(m=m)
    return f"CASE WHEN {v} = 15 THEN 'unknown' WHEN {v} < {k} THEN quality::VARCHAR ELSE (1 - quality)::VARCHAR END"


_MODELS = (("m1", 12), ("m2", 9), ("m3", 5))
_GP = "gp AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{m}' AS method, quality::VARCHAR AS gold, {_pred_sql(m, k)} AS pred FROM {_LAB} JOIN documents USING (doc_id)" for m, k in _MODELS) + ")"


def _wide(spark, d):
    gold = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").select("doc_id", "lang").join(gold, "doc_id")
    q = F.col("quality")
    cols = {f"form_pred__{m}": F.when(_digit(m) == 15, "unknown").when(_digit(m) < k, q.cast("string")).otherwise((1 - q).cast("string")) for m, k in _MODELS}
    return docs.withColumns(cols).withColumn("gold", q.cast("string"))


def _long(spark, d):
    w = _wide(spark, d)
    return metrics.wide_predictions(w, "doc_id", "form_pred").withColumnRenamed("model", "method").join(w.select("doc_id", "lang", "gold"), "doc_id")


@query(f"WITH {_GP} SELECT doc_id, method AS model, pred FROM gp")
def wide_to_long_scores(spark, d):
    """P15."""
    return metrics.wide_predictions(_wide(spark, d), "doc_id", "form_pred")


@query(f"""WITH {_GP} SELECT method, count(*) AS gradable, count(*) FILTER (gold = pred) AS correct, count(*) FILTER (pred = 'unknown') AS unknown, round(count(*) FILTER (gold = pred) / nullif(count(*) FILTER (pred <> 'unknown'), 0)::DOUBLE, 6) AS accuracy FROM gp GROUP BY 1""")
def acc_unknown(spark, d):
    """E1, E2, E11."""
    return metrics.accuracy(_long(spark, d), ["method"], "unknown").withColumn("accuracy", F.round("accuracy", 6))


_PER = """, lb AS ({labels}), cc AS (SELECT s.{by}, lb.label, count(*) FILTER (gold = lb.label AND pred = lb.label) AS tp, count(*) FILTER (gold <> lb.label AND pred = lb.label) AS fp, count(*) FILTER (gold = lb.label AND pred <> lb.label) AS fn
FROM {src} s JOIN lb ON {on} GROUP BY 1, 2),
pc AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cc)"""
_FIXED = _PER.format(labels="SELECT unnest(['0', '1']) AS label", by="method", src="gp", on="true")
_SLICE = _PER.format(labels="SELECT DISTINCT method, label FROM (SELECT method, gold AS label FROM gp UNION SELECT method, pred FROM gp)", by="method", src="gp", on="lb.method = s.method")
_SUMMARY = "SELECT method, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM pc GROUP BY 1"


def _rounded(df, names):
    return df.withColumns({c: F.round(c, 6) for c in names})


_MEANS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@query(f"WITH {_GP}{_FIXED} SELECT method, label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc")
def per_class_report(spark, d):
    """E3, E5, E6."""
    return _rounded(metrics.per_class(_long(spark, d), ["0", "1"], ["method"]), ("precision", "recall", "f1"))


@query(f"WITH {_GP}{_FIXED} {_SUMMARY}")
def macro_f1_fixed(spark, d):
    """Labels 0 and 1."""
    return _rounded(metrics.summary(_long(spark, d), ["0", "1"], ["method"]), _MEANS)


@query(f"WITH {_GP}{_SLICE} {_SUMMARY}")
def macro_f1_slice(spark, d):
    """The labels that occur in the slice, 'unknown' among them."""
    return _rounded(metrics.summary(_long(spark, d), None, ["method"]), _MEANS)


@query(f"WITH {_GP}, w AS (SELECT lang AS method, gold, pred FROM gp){_PER.format(labels='SELECT DISTINCT method, label FROM (SELECT lang AS method, gold AS label FROM gp UNION SELECT lang, pred FROM gp)', by='method', src='w', on='lb.method = s.method')} SELECT method AS lang, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM pc GROUP BY 1")
def weighted_f1(spark, d):
    """E5, by language."""
    return metrics.summary(_long(spark, d), None, ["lang"]).select("lang", F.round("weighted_f1", 6).alias("weighted_f1"))


@query("""WITH c AS (SELECT label::VARCHAR AS gold, (label + vec_id % 3) % 10 AS pred FROM embeddings) SELECT gold, """ + ", ".join(f"count(*) FILTER (pred = {i}) AS p_{i}" for i in range(10)) + " FROM c GROUP BY 1")
def confusion_matrix(spark, d):
    """A17."""
    rows = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("gold"), ((F.col("label") + F.col("vec_id") % 3) % 10).cast("string").alias("pred"))
    return metrics.confusion_matrix(rows, [str(i) for i in range(10)])


@query("SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*))::DOUBLE, 6) AS weight FROM embeddings GROUP BY 1")
def class_weights(spark, d):
    """A15."""
    return metrics.class_weights(table(spark, d, "embeddings"), "label").withColumn("weight", F.round("weight", 6))


@query(f"WITH {_GP} SELECT doc_id, method, CASE WHEN gold IS NULL OR pred IS NULL OR pred = 'unknown' THEN '' WHEN gold = pred THEN '1' ELSE '0' END AS correct FROM gp")
def three_state_flags(spark, d):
    """P9, P18."""
    return _long(spark, d).select("doc_id", "method", metrics.three_state(F.col("gold"), F.col("pred")).alias("correct"))


@query(f"WITH {_GP} SELECT method, count(DISTINCT pred) AS distinct_predictions, count(DISTINCT pred) = 1 AS collapsed FROM gp GROUP BY 1")
def collapse_check(spark, d):
    """E12, A12."""
    return metrics.collapsed(_long(spark, d), ["method"])


@query(f"""WITH {_GP}, x AS (SELECT method, lang AS language, gold, nullif(pred, 'unknown') AS pred FROM gp), b AS (SELECT method, language, gold, pred FROM x UNION ALL SELECT method, '', gold, pred FROM x),
p AS (SELECT * FROM b WHERE pred IS NOT NULL), lb AS (SELECT DISTINCT method, language, label FROM (SELECT method, language, gold AS label FROM p UNION SELECT method, language, pred FROM p)),
c AS (SELECT p.method, p.language, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM p JOIN lb USING (method, language) GROUP BY ALL),
k AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c),
s AS (SELECT method, language, round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(max(recall) FILTER (label = '0'), 6) AS recall_0, round(max(recall) FILTER (label = '1'), 6) AS recall_1 FROM k GROUP BY 1, 2)
SELECT method, language, count(*) AS rows, round(100 * avg((pred IS NULL)::INT), 6) AS parse_fail, any_value(accuracy) AS accuracy, any_value(macro_f1) AS macro_f1, any_value(recall_0) AS recall_0, any_value(recall_1) AS recall_1 FROM b LEFT JOIN s USING (method, language) GROUP BY 1, 2""")
def comparison_table(spark, d):
    """E8, O2."""
    rows = _long(spark, d).select("method", F.col("lang").alias("language"), "gold", F.when(F.col("pred") != "unknown", F.col("pred")).alias("pred"))
    return _rounded(metrics.comparison(rows), ("parse_fail", "accuracy", "macro_f1", "recall_0", "recall_1"))


@query(f"""WITH g AS (SELECT quality::VARCHAR AS gold FROM {_LAB}), b AS (SELECT gold AS pred FROM g GROUP BY 1 ORDER BY count(*) DESC, gold LIMIT 1) SELECT gold, pred, count(*) AS n FROM g, b GROUP BY 1, 2""")
def dummy_most_frequent(spark, d):
    """M6."""
    gold = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(F.col("quality").cast("string").alias("gold"))
    return metrics.dummy_most_frequent(gold, gold).groupBy("gold", "pred").agg(F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT doc_id, quality::VARCHAR AS gold, ('0x' || substring(md5(concat(doc_id::VARCHAR, ':42')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {_LAB}),
c AS (SELECT gold AS pred, sum(count(*)) OVER (ORDER BY gold) / (SELECT count(*) FROM g)::DOUBLE AS hi, (sum(count(*)) OVER (ORDER BY gold) - count(*)) / (SELECT count(*) FROM g)::DOUBLE AS lo FROM g GROUP BY gold)
SELECT doc_id, gold, pred FROM g JOIN c ON u >= lo AND u < hi""")
def dummy_stratified(spark, d):
    """M6."""
    gold = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", F.col("quality").cast("string").alias("gold"))
    return metrics.dummy_stratified(gold, gold, "doc_id")


@query(f"SELECT doc_id, CASE WHEN quality IN (0, 1) AND toxic IN (0, 1) THEN (quality = 0 OR toxic = 1)::INT END AS label FROM {_LAB}")
def combined_labels(spark, d):
    """P8, P17."""
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return l.select("doc_id", votes.combined_label(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"))


@query(f"WITH {_GP}, f AS (SELECT method, doc_id % 5 AS fold, avg((gold = pred)::INT) AS m FROM gp GROUP BY 1, 2) SELECT method, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(*) AS folds FROM f GROUP BY 1")
def fold_summary(spark, d):
    """A6."""
    rows = _long(spark, d).withColumns({"ok": (F.col("gold") == F.col("pred")).cast("double"), "fold": F.col("doc_id") % 5})
    return _rounded(metrics.folded(rows, "ok", by=["method"]), ("mean", "std"))


@query(f"""WITH {_GP}, w AS (SELECT doc_id, lang, max((gold = pred)::INT) FILTER (method = 'm1') AS a, max((gold = pred)::INT) FILTER (method = 'm2') AS b FROM gp GROUP BY 1, 2)
SELECT lang, count(*) AS n, round(avg(a), 6) AS first_ok, round(avg(b) FILTER (a = 1), 6) AS second_given_first FROM w GROUP BY 1""")
def conditional_acc(spark, d):
    """A4, A5, E10."""
    ok = (F.col("gold") == F.col("pred")).cast("int")
    w = _long(spark, d).groupBy("doc_id", "lang").agg(F.max(F.when(F.col("method") == "m1", ok)).alias("a"), F.max(F.when(F.col("method") == "m2", ok)).alias("b"))
    g = w.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("a").cast("double")).alias("first_ok"), metrics.conditional_mean(F.col("b"), F.col("a")).alias("second_given_first"))
    return _rounded(g, ("first_ok", "second_given_first"))


@query(f"""WITH {_GP}, m AS (SELECT method, avg((gold = pred)::INT) AS acc FROM gp GROUP BY 1), fl AS (SELECT max(n) / sum(n)::DOUBLE AS floor FROM (SELECT count(*) AS n FROM {_LAB} GROUP BY quality))
SELECT method, CASE WHEN acc - 0.5 > 0.03 AND acc >= floor THEN 'signal' ELSE 'no signal' END AS verdict FROM m, fl""")
def signal_verdict(spark, d):
    """C11."""
    acc = _long(spark, d).groupBy("method").agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("acc"))
    n = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).groupBy("q").count()
    floor = n.agg((F.max("count") / F.sum("count")).alias("floor"))  # one row
    return acc.crossJoin(F.broadcast(floor)).select("method", metrics.signal(F.col("acc") - 0.5, F.col("acc"), F.col("floor")).alias("verdict"))


@query(f"""WITH {TEMPLATED_SQL}, g AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1), r AS (SELECT doc_id, t, q, row_number() OVER (PARTITION BY q ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k FROM tc JOIN g USING (doc_id))
SELECT string_agg(concat('Text: "', t, '"', chr(10), '{{"label": ', q, '}}'), chr(10) || chr(10) ORDER BY md5(concat(doc_id, ':42s')), doc_id) AS block FROM r WHERE k <= 3""")
def fewshot_block(spark, d):
    """One row with the rendered examples."""
    gold = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = templated(table(spark, d, "documents")).join(gold, "doc_id")
    return spark.createDataFrame([(inference.few_shots(train, "doc_id", "t", "quality", 6),)], "block string")


@query(f"""WITH {TEMPLATED_SQL}, s AS (SELECT doc_id, list_sum([unicode(x)::BIGINT FOR x IN string_split(t, '')]) % 2 AS n FROM tc)
SELECT doc_id, CASE WHEN n = 0 THEN 'prescriptive' ELSE 'descriptive' END AS label FROM s""")
def model_replies(spark, d):
    """A model behind the client interface (the mock of T23), and T14 on its replies. An empty text sums to -1, as in mock_labels."""
    from adagium.functions.replies import salvage_label

    client = inference.mock_client(lambda t: "I say: " + ("Prescriptive" if t and sum(map(ord, t)) % 2 == 0 else "descriptive"))
    return inference.ask(templated(table(spark, d, "documents")), F.col("t"), client).select("doc_id", salvage_label(F.col("reply")).alias("label"))


@query()
def logreg_embeddings(spark, d):
    """M1: penalty tuned on validation, one prediction of the test part."""
    rows = split(table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).cast("double").alias("y")), ["y"], "vec_id", (("train", 0.64), ("val", 0.16), ("test", 0.20)))
    parts = [rows.filter(F.col("split") == s) for s in ("train", "val", "test")]
    pred, _, _ = models.tune_logistic(*parts, "y")
    return pred.select("vec_id", F.col("y").cast("int").alias("gold"), F.col("prediction").cast("int").alias("pred"))


@query()
def logreg_rules(spark, d):
    """Out-of-fold predictions on the nine rule features."""
    f = rules.features_v2(F.col("t"))
    rows = templated(table(spark, d, "documents")).withColumns(f)
    rows = rows.withColumn("y", (mock_sum_label(F.col("t"))["form"] == "prescriptive").cast("double")).withColumn("y", F.when(F.col("f_imperative") == 1, 1.0).otherwise(F.col("y")))
    rows = materialize(rows.select("doc_id", "y", *rules.FEATURES_V2), "rule-features")  # the texts end here
    out = models.out_of_fold(rows, list(rules.FEATURES_V2), "y", "doc_id")
    return out.select("doc_id", F.col("y").cast("int").alias("gold"), F.col("prediction").cast("int").alias("pred"))


