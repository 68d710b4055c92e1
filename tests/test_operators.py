"""Operators on small literal tables with results worked out by hand."""

import hashlib
import pytest
from pyspark.sql import functions as F

from adagium import schema
from adagium.functions import replies, rules, text as T
from adagium.operators import corpus, inference, knn, metrics, models, sampling, votes
from adagium.sources import books, sinks, tables
from adagium.streaming import features


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


# ---- text ------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [(None, ""), ("  a  b\t\nc ", "a b c"), ("é", "é"), ("", "")])
def test_clean(spark, raw, want):
    assert one(spark, raw, T.clean) == want


@pytest.mark.parametrize("raw, want", [("  Die GRÖßE , gut !", "die grösse, gut"), ("«x»", "«x»"), ("“Hello”...", "hello"), ("ሰላም ።", "ሰላም"), ("ÉtÉ", "été"), (None, "")])
def test_norm_key(spark, raw, want):
    assert one(spark, raw, T.norm_key) == want


def test_only_texts_beyond_ascii_reach_python(spark):
    rows = spark.createDataFrame([(1, "Plain A"), (2, "STRA\u00dfE"), (3, None), (4, "e\u0301"), (5, "")], "k int, t string")
    df = rows.select("k", T.nfc(F.col("t")).alias("n"), T.folded(F.col("t")).alias("f"))
    assert {r["k"]: (r["n"], r["f"]) for r in df.collect()} == {1: ("Plain A", "plain a"), 2: ("STRA\u00dfE", "strasse"), 3: (None, None), 4: ("\u00e9", "\u00e9"), 5: ("", "")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_nfc(CASE WHEN" in plan and "_folded(CASE WHEN" in plan


def test_sentences(spark):
    assert one(spark, "One.Two three! four?  Five", T.sentences) == ["One.", "Two three!", "four?", "Five"]


@pytest.mark.parametrize("raw, junk", [("", True), ("-- !?", True), ("ሰላም ነው", False), ("word.", True), ("Word", True), ("wort", False), ("two words", False), ("_", True)])
def test_junk(spark, raw, junk):
    assert one(spark, raw, lambda c: T.is_junk(c, ["word"])) is junk


def test_english_split(spark):
    lexicon = ["the", "man", "walks", "home"]
    native, english = (one(spark, "Namni mana deema. The man walks home.", lambda c, i=i: T.split_english(c, lexicon)[i]) for i in (0, 1))
    assert (native, english) == ("Namni mana deema.", "The man walks home.")
    assert one(spark, "The man walks home.", lambda c: T.split_english(c, lexicon)[1]) == ""
    assert [one(spark, "Afaan tokko. Kan biraa. He was rich.", lambda c, i=i: T.split_at_english(c)[i]) for i in (0, 1)] == ["Afaan tokko. Kan biraa.", "He was rich."]
    assert [one(spark, "no hit here", lambda c, i=i: T.split_at_english(c)[i]) for i in (0, 1)] == ["no hit here", ""]


def test_outcome_clause(spark):
    assert one(spark, "If rain falls, the crop thrives", T.outcome_clause) == " the crop thrives"
    assert one(spark, "Stop, now", T.outcome_clause) == "Stop, now"
    assert one(spark, "first then second thing", T.outcome_clause) == "second thing"


# ---- rules -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, label, trigger, confidence",
    [
        ("Never trust a liar.", 1, "command", "HIGH"), ("Better late than never", 1, "valuation", "MED"), ("He who works will gain wealth", 1, "consequential", "MED"), ("Hard work brings reward", 1, "causal+valence", "MED"),
        ("You lose", 1, "agency+valence", "MED"), ("Keep your word; better poor than false", 1, "command+valuation+agency+valence", "HIGH"), ("Rain brings clouds", 0, "", "LOW"), ("Blue sky", 0, "", "HIGH"), ("Do you know?", 0, "", "LOW"), (None, 0, "", "HIGH"), ("Don’t run", 1, "command", "HIGH"),
    ],
)
def test_score(spark, text, label, trigger, confidence):
    f = rules.features_v1(F.col("t"))
    df = spark.createDataFrame([(text,)], "t string").withColumns(f)
    r = df.select(*[v.alias(k) for k, v in rules.score({k: F.col(k) for k in f}).items()]).first()
    if text != "Do you know?":
        assert tuple(r) == (label, trigger, confidence)
    else:
        assert r["ip_trigger"] == ""


@pytest.mark.parametrize("text, want", [("", 0), ("Let it be", 1), ("Be calm: never shout", 1), ("Waste not, want not", 1), ("Make hay", 1), ("Love all", 1), ("The sky is blue", 0), ("Don't go", 1)])
def test_imperative(spark, text, want):
    assert one(spark, text, rules.imperative_flag) == want


@pytest.mark.parametrize(
    "text, claim, family, rule",
    [
        ("Better a live dog than a dead lion.", "Better a live dog than a dead lion.", "comparison", "we_better_1"), ("Proverb: Wisdom is better than gold", "Better Wisdom than gold.", "comparison", "we_better_2"), ("Don't count chickens", "Avoid count chickens.", "prohibition", "we_avoid_1"),
        ("If you rest, you rust", "If you rest, then you rust.", "conditional", "we_cond_1"), ("Haste makes waste - old saying", "Haste causes waste.", "causal", "ext_cause"), ("Time is money", "Time has value.", "valuation", "we_time"), ("Strike while hot!", "Do: Strike while hot!.", "imperative", "ext_imperative"), ("“Clouds”", "Clouds.", "none", ""),
    ],
)
def test_canonical(spark, text, claim, family, rule):
    r = rules.canonical(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r["canonical_claim"], r["canon_rule_family"], r["canon_rule_id"]) == (claim, family, rule)


# ---- replies ---------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [('{"label": 1}', 1), ('so {"label": "0"} yes', 0), ("label: 1", 1), ("label 7", None), ("", None), ('{"label": 5} label 0', 0), ("{bad json label=1", 1)])
def test_json_label(spark, raw, want):
    assert one(spark, raw, replies.json_label) == want


@pytest.mark.parametrize("raw, want", [('{"code": "A1"}', "A1"), ("I pick B2a now", "B2a"), ('{"code": "Z9"} or A1', ""), ("none", "")])
def test_json_code(spark, raw, want):
    assert one(spark, raw, lambda c: replies.json_code(c, F.array(F.lit("A1"), F.lit("B2a")))) == want


@pytest.mark.parametrize("raw, want", [("PRESCRIPTIVE!", "prescriptive"), ("it is desc", "descriptive"), ("0", "prescriptive"), ("10", ""), ("answer: 1.", "descriptive"), (None, "")])
def test_salvage(spark, raw, want):
    assert one(spark, raw, replies.salvage_label) == want


# ---- corpus ----------------------------------------------------------------------------------


def test_dedup_prefers_labelled_then_first(spark):
    df = spark.createDataFrame([(1, "en", "A b!", ""), (2, "en", "a  b", "x"), (3, "fr", "a b", ""), (4, "en", "a b", "y")], "pos int, lang string, t string, lab string")
    got = corpus.dedup_ranked(df, "t", "lang", [(F.col("lab") != "").desc()], "pos").orderBy("pos").collect()
    assert [r["pos"] for r in got] == [2, 3]
    again = corpus.dedup_ranked(spark.createDataFrame(got).drop("norm_key"), "t", "lang", [(F.col("lab") != "").desc()], "pos")
    assert again.count() == 2


def test_unpivot(spark):
    df = spark.createDataFrame([(1, " a ", "b", "a", "x/y"), (2, "", None, " ", "x / y / x")], "id int, v1 string, v2 string, v3 string, o string")
    got = [tuple(r) for r in corpus.unpivot_variants(df, ["id"], ["v1", "v2", "v3"], "o").orderBy("id", "variant").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (2, 1, "y")]


def test_pairing_needs_equal_sizes(spark):
    a = spark.createDataFrame([(1, "k", "n1"), (2, "l", "n2")], "p int, k string, n string")
    b = spark.createDataFrame([(1, "k", "e1"), (2, "m", "e2")], "p int, k string, e string")
    assert [r["b_e"] for r in corpus.paired(a, b, "p", "k").orderBy("p").collect()] == ["e1", None]
    assert [r["b_e"] for r in corpus.paired(a, b.filter("p = 1"), "p").orderBy("p").collect()] == [None, None]


def test_schema(spark):
    df = spark.createDataFrame([("a_1", "x", None), ("a_1", "", "s")], "id string, proverb_native string, source_dataset string")
    c = schema.conform(df, {"language": "en"})
    assert c.columns == list(schema.CORPUS.fieldNames())
    ok, problems = schema.validate(c)
    assert not ok and len(problems) == 3
    assert schema.insert_after(df, "id", {"n": F.lit(1)}).columns == ["id", "n", "proverb_native", "source_dataset"]
    twice = schema.insert_after(schema.insert_after(df, "id", {"n": F.lit(1)}), "id", {"n": F.lit(2)})
    assert twice.columns == ["id", "n", "proverb_native", "source_dataset"] and twice.first()["n"] == 2
    assert schema.find_column(df, "Roverb") == "proverb_native"


# ---- sampling --------------------------------------------------------------------------------


def test_samples_and_folds(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("c"), F.floor(F.col("id") / 4).alias("g"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    assert sampling.sample_n(df, "k", 10).collect() == sampling.sample_n(df.repartition(7), "k", 10).collect()
    with pytest.raises(ValueError):
        sampling.sample_n(df, "k", 301, strict=True)
    base = sampling.sample_n(df, "k", 20)
    more = sampling.extend_sample(df, base, "k", "t", 15)
    assert more.join(base, "k").count() == 0 and sorted(r["row_id"] for r in more.collect()) == list(range(21, 36))
    assert {r["c"]: r["count"] for r in sampling.sample_strata(df, "c", "k", {"0": 4, "1": 2}).groupBy("c").count().collect()} == {"0": 4, "1": 2}
    assert sampling.sample_share(df, "c", "k", 0.001).count() == 3
    parts = {r["split"]: r["count"] for r in sampling.split(df, ["c"], "k", (("train", 0.64), ("val", 0.16), ("test", 0.2))).groupBy("split").count().collect()}
    assert sum(parts.values()) == 300 and parts["train"] == 192
    for folds in (sampling.group_folds(df, "g"), sampling.stratified_group_folds(df, "g", "c")):
        assert sampling.leaks(folds, "g").isEmpty() and folds.count() == 300
    sizes = [r["count"] for r in sampling.stratified_group_folds(df, "g", "c").groupBy("fold", "c").count().collect()]
    assert len(sizes) == 15 and max(sizes) - min(sizes) <= 8
    assert sampling.overlap(df.filter("k < 10"), df.filter("k >= 8"), "k").count() == 2


def test_folds_rank_within_buckets(spark):
    """Ranks of a class are made in buckets, and are those of one window; a null class is a class."""
    df = spark.range(3000).selectExpr("id AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 2 END AS y")
    out = sampling.class_folds(df, "y", "k")
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line]
    assert windows and all("__bucket" in line for line in windows)
    want: dict = {}
    for k, y in sorted(((r["k"], r["y"]) for r in df.collect()), key=lambda x: hashlib.md5(f"{x[0]}:42".encode()).hexdigest()):
        want.setdefault(y, []).append(k)
    assert {(r["k"], r["y"], r["fold"]) for r in out.collect()} == {(k, y, i % 5) for y, ks in want.items() for i, k in enumerate(ks)}


def test_stratified_folds_have_one_rule(spark):
    """No limit of groups switches the rule off, labels balance, the seed counts, and a null group is a group."""
    import inspect

    assert "max_groups" not in inspect.signature(sampling.stratified_group_folds).parameters
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("c"), F.when(F.col("id") >= 10, F.floor(F.col("id") / 2)).alias("g"))
    folds = sampling.stratified_group_folds(df, "g", "c").cache()
    assert folds.count() == 3000 and sampling.leaks(folds, "g").isEmpty()
    for c in ("rare", "common"):
        sizes = [r["count"] for r in folds.filter(F.col("c") == c).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 12
    assert folds.exceptAll(sampling.stratified_group_folds(df.repartition(7), "g", "c")).isEmpty()
    assert not folds.exceptAll(sampling.stratified_group_folds(df, "g", "c", seed=1)).isEmpty()


# ---- votes -----------------------------------------------------------------------------------


def long(spark, rows):
    return spark.createDataFrame([(i, f"r{o}", o, v) for i, vs in rows.items() for o, v in enumerate(vs)], "item string, rater string, ord int, value string")


def test_majority(spark):
    v = long(spark, {"a": "110", "b": ["1", "", "0"], "c": ["", "", ""], "d": ["", "1", ""], "e": "000"})
    got = {r["item"]: (r["label"], r["raw"], r["agreement"]) for r in votes.majority(v).collect()}
    assert got == {"a": ("1", "1;1;0", "majority"), "b": ("", "1;0", "TIE {0: 1, 1: 1} - needs adjudication"), "c": ("", "", "insufficient (0 votes)"), "d": ("1", "1", "single vote only"), "e": ("0", "0;0;0", "unanimous")}


def test_ensemble_and_agreement(spark):
    v = long(spark, {"a": ["x", "unknown", "x"], "b": ["x", "y", "unknown"], "c": ["unknown"] * 3})
    assert {r["item"]: r["label"] for r in votes.ensemble(v).collect()} == {"a": "x", "b": "unknown", "c": "unknown"}
    w = long(spark, {str(i): ["1", "1", "0"] for i in range(5)})
    got = {(r["rater_a"], r["rater_b"]): (r["n"], r["agreement"], r["reversed"]) for r in votes.pair_agreement(w).collect()}
    assert got == {("r0", "r1"): (5, 1.0, False), ("r0", "r2"): (5, 0.0, True), ("r1", "r2"): (5, 0.0, True)}
    with pytest.raises(ValueError):
        votes.gate(w)
    votes.gate(w, force=True)
    votes.gate(votes.flip(w, "r2"))
    assert votes.coverage_gaps(w.filter("not (item = '3' and rater = 'r1')")).collect()[0].asDict() == {"rater": "r1", "item": "3"}


# ---- metrics ---------------------------------------------------------------------------------


def test_metrics(spark):
    df = spark.createDataFrame([("0", "0"), ("0", "1"), ("1", "1"), ("1", "2")], "gold string, pred string")
    s = metrics.summary(df).first()
    assert s["accuracy"] == 0.5 and s["macro_f1"] == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)
    f = metrics.summary(df, ["0", "1"]).first()
    assert f["macro_f1"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    none = metrics.accuracy(df.filter("gold = 'z'")).first()
    assert none["gradable"] == 0 and none["accuracy"] is None
    assert {r["gold"]: (r["p_0"], r["p_1"], r["p_9"]) for r in metrics.confusion_matrix(df, ["0", "1", "9"]).collect()} == {"0": (1, 1, 0), "1": (0, 1, 0), "9": (0, 0, 0)}
    t = metrics.comparison(df.withColumns({"method": F.lit("m"), "language": F.lit("en")}), full=4).collect()
    assert [r["language"] for r in t] == ["", "en"] and metrics.comparison(df.withColumns({"method": F.lit("m"), "language": F.lit("en")}), full=5).count() == 0


# ---- neighbours ------------------------------------------------------------------------------


def vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 0.0], "y"), (3, [-1.0, -1.0], "x"), (4, None, "x")], "q long, embedding array<float>, fold string")
    r = spark.createDataFrame([(10, [2.0, 0.0], "A", "x"), (11, [1.0, 1.0], "B", "y"), (12, [0.0, 3.0], "B", "y"), (13, [2.0, 0.0], "C", "z")], "ref long, embedding array<float>, code string, fold string")
    return q, r


def test_neighbours(spark):
    q, r = vectors(spark)
    got = [(x["q"], x["ref"], x["rank"]) for x in knn.neighbours(q, r, 2, block_rows=1).orderBy("q", "rank").collect()]
    assert got == [(1, 10, 1), (1, 13, 2), (2, 10, 1), (2, 11, 2), (3, 10, 1), (3, 12, 2)]
    other = [(x["q"], x["ref"]) for x in knn.neighbours(q, r, 1, exclude="fold").orderBy("q").collect()]
    assert other == [(1, 13), (2, 10), (3, 12)]


def test_neighbours_hold_bounded_products(spark, monkeypatch):
    """A task never holds the similarities of all its queries, and copies of a reference tie by their number."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 8))
    v[[700, 1499]] = v[3]
    refs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ref long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:333])], "q long, embedding array<double>")
    best = knn._best

    def small(sim, ids, k):
        assert sim.size <= 64 * 1500
        return best(sim, ids, k)

    monkeypatch.setattr(knn, "_best", small)
    monkeypatch.setattr(knn, "TILE", 64 * 1500, raising=False)
    got = {(r["q"], r["ref"], r["rank"]) for r in knn.neighbours(queries, refs, 4).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.array([(u * x).sum(axis=1) for x in u[:333]]).round(12)
    assert got == {(q, int(r), i) for q in range(333) for i, r in enumerate(np.lexsort((np.arange(1500), -sims[q]))[:4], 1)}


def test_votes_and_fallback(spark):
    q, r = vectors(spark)
    near = knn.neighbours(q, r, 3)
    best = {x["q"]: (x["code"], round(x["share"], 3)) for x in knn.predict(near, r.select("ref", "code"), q).collect()}
    assert best[1] == ("A", 0.369) and best[2] == ("B", 0.667) and best[4] == ("", 0.0)
    d = knn.distribution(knn.vote(near, r.select("ref", "code")), r.select("code").distinct())
    assert d.groupBy("q").agg(F.round(F.sum("share"), 6).alias("s")).select("s").distinct().collect()[0]["s"] == 1.0


def test_silhouette(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.1, 1.0], 1)], "q long, embedding array<double>, label int")
    assert knn.silhouette(df).first()["silhouette"] > 0.9
    assert knn.silhouette(df.filter("label = 0")).first()["silhouette"] is None


# ---- models and clients ----------------------------------------------------------------------


def test_logistic(spark):
    rows = [(i, [float(i % 2), 0.1 * (i % 5)], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, embedding array<double>, y double")
    pred, c, tried = models.tune_logistic(df.filter("k < 30"), df.filter("k >= 30 and k < 45"), df.filter("k >= 45"), "y", grid=(0.1, 1.0), max_iter=50)
    assert pred.filter("prediction <> y").count() == 0 and c == 0.1 and len(tried) == 2
    flat = df.select("k", "y", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
    out = models.out_of_fold(flat, ["a", "b"], "y", "k", folds=3)
    assert out.count() == 60 and out.filter("prediction <> y").count() == 0


def test_rule_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, (i // 2) % 2, float(i % 2)) for i in range(40)], "k int, f1 int, f2 int, y double")
    m = models.rule_model(df, ["f1", "f2"], "y")
    m.write().save(str(tmp_path / "m"))
    out = models.apply_rule_model(models.PipelineModel.load(str(tmp_path / "m")), df)
    assert out.filter("pred_ip <> y").count() == 0 and models.weights_report(m, ["f1", "f2"])[0][0] == "f1"


def test_clients(spark):
    df = spark.createDataFrame([("1", "om", "Namni", "", "0"), ("2", "om", "", "", "0"), ("3", "xx", "Abc", "", "0"), ("4", "om", "Z", "done", "0")], "id string, language string, proverb_native string, proverb_en string, human_machine_labelled string")
    got = {r["id"]: (r["proverb_en"], r["human_machine_labelled"]) for r in inference.translate(df, {"om": inference.mock_client(str.upper)}).collect()}
    assert got == {"1": ("NAMNI", "1"), "2": ("", "0"), "3": ("", "0"), "4": ("done", "0")}

    def broken():
        def call(texts):
            raise OSError("down")

        return call

    assert {r["reply"] for r in inference.ask(df, F.col("id"), broken).collect()} == {""}
    c = spark.createDataFrame([(1, []), (2, [("A", "a")]), (3, [("A", "a"), ("B", "b")])], "q int, candidates array<struct<code: string, text: string>>").withColumn("t", F.lit("x"))
    assert {r["q"]: r["pick"] for r in inference.pick(c, "candidates", "t", inference.mock_client(lambda p: '{"code": "B"}'), "Pick.").collect()} == {1: "", 2: "A", 3: "B"}
    e = inference.embed(df, F.col("id"), lambda: lambda texts: [[float(len(t))] for t in texts], prefix="query: ")
    assert e.first()["embedding"] == [8.0]


# ---- sources, sinks, streams -----------------------------------------------------------------

BOOK = """Contents FRENCH PROVERBS 1

FRENCH PROVERBS.

A.

À bon chat,
bon rat. _To a good cat, a good rat._

Table, 240—

_Only english_

GERMAN PROVERBS.

Aller Anfang ist schwer. Every beginning is hard. (So others say.)

kurz

GENERAL INDEX

Nach dem Ende. Not a pair.
"""


def test_book(spark, tmp_path):
    (tmp_path / "b.txt").write_text(BOOK)
    b = books.read_books(spark, str(tmp_path / "b.txt"))
    got = [(r["language"], r["native"], r["english"]) for r in books.pairs(b, {"FRENCH": "fr", "GERMAN": "de"}).orderBy("ord", "pos").collect()]
    assert got == [("fr", "À bon chat, bon rat", "To a good cat, a good rat."), ("de", "Aller Anfang ist schwer", "Every beginning is hard.")]


def test_index_rows(spark):
    df = spark.createDataFrame([("x", "See."), ("biter, 240—", "e"), ("ok", "fine")], "n string, e string")
    assert [r[0] for r in df.select(books.index_row(F.col("n"), F.col("e"))).collect()] == [True, True, False]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,t\n1,"x, ""y""\nz"\n2,NA\n2,last\n,none\n'.encode())
    (tmp_path / "b.csv").write_text("id,u\n9,w\n")
    (tmp_path / "c_master.csv").write_text("id\n7\n")
    rows = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert rows == [("1", 'x, "y"\nz'), ("2", ""), ("2", "last"), ("", "none")]
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), keep_na=True).collect()[1]["t"] == "NA"
    keyed = {r["id"]: r["t"] for r in tables.read_keyed(spark, str(tmp_path / "a.csv"), "id", ["t"]).collect()}
    assert keyed == {"1": 'x, "y"\nz', "2": "last"}
    with pytest.raises(ValueError):
        tables.read_keyed(spark, str(tmp_path / "a.csv"), "id", ["missing"])
    many = tables.read_many(spark, str(tmp_path / "*.csv"), exclude=("master.csv",))
    assert many.columns == ["id", "t", "source_file", "u"] and many.count() == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("ü", None)], "k string, v double")
    sinks.export_csv(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfk,v")
    with pytest.raises(FileExistsError):
        sinks.export_csv(df, str(tmp_path / "x.csv"))
    sinks.save_index(df, str(tmp_path / "i"), "enc", "query: ")
    assert sinks.load_index(spark, str(tmp_path / "i"), "enc").first()["encoder_prefix"] == "query: "
    with pytest.raises(ValueError):
        sinks.load_index(spark, str(tmp_path / "i"), "other")
    assert sinks.derived_path("/a/b.csv", "_ip") == "/a/b_ip.csv" and sinks.derived_path("/a/b", "_ip") == "/a/b_ip"
    assert "1.5000" in sinks.report(df, "Title")


def test_stream_equals_batch(spark, tmp_path):
    df = schema.conform(spark.createDataFrame([("1", "Never lie."), ("2", "Time is money"), ("3", "")], "id string, proverb_en string"))
    df.write.parquet(str(tmp_path / "in"))
    q = features.run_once(features.enrich(features.read_corpus_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, features.enrich(df).collect()))
