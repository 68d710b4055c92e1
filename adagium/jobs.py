"""End-to-end jobs over files: python -m adagium.jobs <job> --option value ...

Every job reads delimited text or Parquet, runs one declarative plan and writes
one new table; nothing is overwritten. Options are the functions' parameters.
"""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import DataFrame, SparkSession, functions as F

from adagium.functions import fixed, rules
from adagium.functions.replies import json_label, prompt
from adagium.operators import corpus, inference, knn, metrics, models, sampling, votes
from adagium.operators.corpus import clean_corpus, union_all
from adagium.schema import conform, insert_after, numbered_id, validate
from adagium.shared import materialize
from adagium.sources import books, sinks, tables

FORM, IMPLICIT = "prescriptive_or_descriptive", "has_implicit_prescription"


def load(spark: SparkSession, path: str, keep_na: bool = False) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith((".parquet", "_parquet")) or "." not in path.rsplit("/", 1)[-1] else tables.read_csv(spark, path, keep_na)


def book(spark: SparkSession, source: str, out: str, sections: str, source_dataset: str = "gutenberg", license: str = "public domain") -> DataFrame:
    """A sectioned book as corpus rows. sections: NAME=language pairs, comma separated."""
    from pyspark.sql import Window as W

    names = dict(x.split("=") for x in sections.split(","))
    rows = books.pairs(books.read_books(spark, source), names)
    place = F.row_number().over(W.partitionBy("language").orderBy("path", "ord", "pos"))  # a book's pairs: small
    rows = rows.select(numbered_id(F.col("language"), place).alias("id"), "language", F.col("native").alias("proverb_native"), F.col("english").alias("proverb_en"))
    return _saved(conform(rows, {"source_dataset": source_dataset, "source_url": source, "license": license, "resource_level": "high"}), out)


def combine(spark: SparkSession, pattern: str, out: str) -> DataFrame:
    """All source files but earlier masters in one table; problems are printed."""
    df = conform(tables.read_many(spark, pattern, exclude=("master.csv", "master_translated.csv")))
    ok, problems = validate(df)
    print("valid" if ok else "; ".join(problems))
    return _saved(df, out)


def clean(spark: SparkSession, source: str, out: str, lexicon: str) -> DataFrame:
    """T1-T7, W1, O1. lexicon: a text file with one English word a line, all of which count."""
    words = [r[0].strip().lower() for r in spark.read.text(lexicon).collect()]
    df = tables.with_position(conform(load(spark, source)))
    return _saved(conform(clean_corpus(df, [w for w in words if len(w) >= 3])), out)


def translate(spark: SparkSession, source: str, out: str, clients: dict | None = None, limit: int | None = None, endpoint: str | None = None, models_by_language: str = "") -> DataFrame:
    """X3, P6. clients: language to model client, or language=model pairs of a server at endpoint; without any, nothing changes."""
    if endpoint:
        clients = {lang: inference.http_client(endpoint, m) for lang, m in (x.split("=") for x in models_by_language.split(",") if x)}
    return _saved(inference.translate(conform(load(spark, source)), clients or {}, limit), out)


def select(spark: SparkSession, master: str, out: str, n: int = 50, seed: int = 42, add: int = 0, existing: str | None = None) -> DataFrame:
    """N rows with English text, or ``add`` more rows behind an existing sample."""
    from adagium.functions.text import has_english

    pool = conform(load(spark, master)).filter(has_english(F.col("proverb_en")))
    if add and existing:
        old = load(spark, existing)
        more = sampling.extend_sample(pool, old, "id", "proverb_en", add, seed)
        return _saved(union_all([old.withColumn("row_id", F.col("row_id").cast("long")), more]).na.fill(""), out)
    from pyspark.sql import Window as W

    drawn = sampling.sample_n(pool, "id", n, seed, strict=True)
    return _saved(drawn.withColumn("row_id", F.row_number().over(W.orderBy(sampling.draw(F.col("id"), seed), "id")).cast("long")), out)  # n rows


def imperative(spark: SparkSession, master: str, out: str) -> DataFrame:
    """C1, C2."""
    return _saved(load(spark, master, keep_na=True).withColumn("has_imperative", rules.imperative_flag(F.col("proverb_en"))), out)


def imppresc(spark: SparkSession, master: str, out: str, sample: int = 0) -> DataFrame:
    """Rule features and score; with sample, only so many rows: half positives, a quarter near misses, the rest clear negatives."""
    f = rules.features_v1(F.col("proverb_en"))
    df = load(spark, master, keep_na=True).withColumns(f)
    df = df.withColumns(rules.score({k: F.col(k) for k in f}))
    if sample:
        stratum = F.when(F.col("implicit_prescriptive") == 1, "positive").when(F.col("ip_confidence") == "LOW", "near").otherwise("negative")
        half, quarter = sample // 2, sample // 4
        df = sampling.sample_strata(df.withColumn("stratum", stratum), "stratum", "id", {"positive": half, "near": quarter, "negative": sample - half - quarter})
    return _saved(df, out)


def canonicalise(spark: SparkSession, master: str, out: str, gold: str | None = None) -> DataFrame:
    """T9, T10, C8, V4, E7. gold: a 0/1 column to hold the hints against."""
    df = rules.canonical(load(spark, master, keep_na=True), "proverb_en")
    df = df.withColumns(rules.hints(F.col("canon_rule_family")))
    print(sinks.report(metrics.value_share(df, "canon_rule_family"), "Rule families"))
    if gold:
        known = df.filter(F.col(gold).isin("0", "1")).withColumn("g", F.col(gold).cast("int"))
        print(sinks.report(metrics.hint_quality(known, "canon_implicit_hint", "g"), "Hint against gold"))
    return _saved(df, out)


def vote(spark: SparkSession, inputs: str, out: str, flip: str = "", diagnose_only: bool = False, force: bool = False) -> DataFrame | None:
    """S3, J1, A7, A9, C9, P16, V2. inputs: files, comma separated, in rater order; flip: rater:column pairs."""
    paths = inputs.split(",")
    frames = [(p.rsplit("/", 1)[-1].split("_")[0].split(".")[0], tables.read_keyed(spark, p, "id", [FORM, IMPLICIT])) for p in paths]
    turned = {tuple(x.split(":")) for x in flip.split(",") if x}
    out_frames = []
    for column, name in ((FORM, "pd"), (IMPLICIT, "imp")):
        v = votes.votes_long(frames, "id", column)
        gaps = votes.coverage_gaps(v).orderBy("rater", "item").limit(10).collect()
        if gaps:
            raise ValueError(f"raters saw different ids: {gaps}")
        for rater, of in turned:
            v = votes.flip(v, rater) if of == column else v
        print(sinks.report(votes.pair_agreement(v), f"Agreement on {column}"))
        if name == "pd" and not diagnose_only:
            votes.gate(v, force)
        out_frames.append(votes.majority(v).select(F.col("item").alias("id"), F.col("label").alias(column), F.col("raw").alias(f"{name}_votes"), F.col("agreement").alias(f"{name}_agreement")))
    if diagnose_only:
        return None
    base = frames[0][1].drop(FORM, IMPLICIT, "position")
    return _saved(base.join(out_frames[0], "id").join(out_frames[1], "id"), out)


def macro_f1(spark: SparkSession, pred: str, gold: str, out: str, prefix: str = "form_code") -> DataFrame:
    """Per-model metrics of wide predictions against a gold column, with fixed labels 0 and 1."""
    df = load(spark, pred, keep_na=True)
    long = metrics.wide_predictions(df, "id", prefix).join(df.select("id", F.col(gold).alias("gold")), "id")
    long = long.filter(F.col("gold").isin("0", "1") & F.col("pred").isin("0", "1"))
    return _saved(metrics.summary(long, ["0", "1"], ["model"]).orderBy(F.desc("macro_f1"), "model"), out)


def llm_compare(spark: SparkSession, gold: str, out: str, clients: dict | None = None, limit: int | None = None, endpoint: str | None = None, models_to_ask: str = "") -> DataFrame:
    """Every model's two answers, their ensemble, and correctness. Without clients or models, comma separated, at an endpoint, the mock of T23 answers."""
    if endpoint:
        clients = {m: inference.http_client(endpoint, m) for m in models_to_ask.split(",") if m}
    from adagium.functions.replies import mock_sum_label, two_lines

    df = load(spark, gold, keep_na=True)
    df = df.orderBy("id").limit(limit) if limit is not None else df
    rows, parts = df.select("id", "proverb_en", FORM), []
    for name, client in (clients or {"mock": None}).items():
        a = mock_sum_label(F.col("proverb_en")) if client is None else two_lines(F.col("reply"))
        asked = rows if client is None else inference.ask(rows, F.col("proverb_en"), client)
        parts.append(asked.select("id", F.lit(name).alias("rater"), F.lit(0).alias("ord"), a["form"].alias("value")))
    form = union_all(parts).withColumnRenamed("id", "item")
    best = votes.ensemble(form).select(F.col("item").alias("id"), F.col("label").alias("ensemble"))
    code = F.when(F.col("ensemble") == "prescriptive", "0").when(F.col("ensemble") == "descriptive", "1").otherwise("")
    wide = form.groupBy("item").pivot("rater", list(clients or {"mock": None})).agg(F.first("value")).withColumnRenamed("item", "id")
    joined = df.join(wide, "id").join(best, "id").withColumn("form_code__ensemble", code)
    return _saved(joined.withColumn("form_ensemble_correct", metrics.three_state(F.col(FORM), F.col("form_code__ensemble"))), out)


def ip_train(spark: SparkSession, train: str, model_out: str, apply: str | None = None, out: str | None = None, ablate: bool = False) -> DataFrame | None:
    """The nine-feature classifier; train holds form and implicit labels."""
    f = rules.features_v2(F.col("proverb_en"))
    label = votes.combined_label(F.col(FORM), F.col(IMPLICIT))
    rows = load(spark, train, keep_na=True).withColumn("y", label.cast("double")).filter("y is not null").withColumns(f)
    names = list(rules.FEATURES_V2)
    if ablate:
        sets = {"all": names, **{f"without {n}": [x for x in names if x != n] for n in names}}
        print(sinks.report(models.ablation(rows, sets, "y", "id"), "Ablation"))
    model = models.rule_model(rows, names, "y")
    print("\n".join(f"{n:16s} {w:+.4f}" for n, w in models.weights_report(model, names)))
    model.write().save(model_out)
    if apply and out:
        return _saved(models.apply_rule_model(model, load(spark, apply, keep_na=True).withColumns(f)), out)
    return None


def index(spark: SparkSession, types: str, definitions: str, out: str, encoder: str, client: object = None, prefix: str = "") -> DataFrame:
    """Examples and definitions with vectors of an injected encoder, tagged with its name."""
    variants = ["proverb_primary_en", *[f"proverb_variant_{i}" for i in range(1, 5)], "proverb_variant_extra"]
    examples = corpus.unpivot_variants(load(spark, types), ["kuusi_id", "theme", "main_class", "subgroup_code"], variants, "proverb_original")
    examples = examples.withColumn("source_type", F.lit("example")).drop("variant")
    defs = corpus.definition_rows(load(spark, definitions)).withColumn("kuusi_id", F.lit(""))
    rows = union_all([examples, defs]).withColumn("ref", F.monotonically_increasing_id())
    if client is None:
        raise ValueError("an encoder has to be given")
    sinks.save_index(inference.embed(rows, F.col("text"), client, prefix), out, encoder, prefix)
    return sinks.load_index(spark, out, encoder)


def cascade(spark: SparkSession, index: str, out: str, k: int = fixed.KNN_K, folds: int = 5, definitions: bool = True) -> DataFrame:
    """Cross-validated cascade over a reference index; the fold summary is printed."""
    refs = sinks.load_index(spark, index)
    refs = refs if definitions else refs.filter("source_type = 'example'")
    examples, _ = _grouped(spark, index, folds)
    refs = union_all([examples, refs.filter("source_type <> 'example'").withColumn("fold", F.lit(-1))])
    pred = knn.cascade(examples.select(F.col("ref").alias("q"), "embedding", "fold"), refs, k, fold="fold")
    truth = examples.select(F.col("ref").alias("q"), "fold", F.col("theme").alias("true_theme"), F.col("main_class").alias("true_main"), F.col("subgroup_code").alias("true_sub"))
    joined = truth.join(pred, "q")
    for p, t in (("pred_theme", "true_theme"), ("pred_main", "true_main"), ("pred_sub", "true_sub"), ("flat_sub", "true_sub")):
        joined = joined.withColumn(f"{p}_ok", (F.col(p) == F.col(t)).cast("int"))
    saved = _saved(joined, out)
    for p in ("pred_theme", "pred_main", "pred_sub", "flat_sub"):
        print(sinks.report(metrics.folded(saved, f"{p}_ok"), p))
    return saved


def label(spark: SparkSession, master: str, index: str, out: str, client: object = None, probabilities: str | None = None, k: int = fixed.KNN_K) -> DataFrame:
    """Top three themes and confidence of every row, from neighbours and stored class probabilities of a second model."""
    from adagium.functions.text import prefer_text

    refs = sinks.load_index(spark, index).filter("source_type = 'example'")
    rows = tables.with_position(conform(load(spark, master)))
    rows = inference.embed(rows, prefer_text(F.col("proverb_en"), F.col("proverb_native")), client).withColumnRenamed("position", "q")
    near = knn.vote(knn.neighbours(rows, refs, k), refs.select("ref", F.col("theme").alias("code")))
    second = models.read_probabilities(load(spark, probabilities).withColumnRenamed("id", "q"), "q") if probabilities else near
    if probabilities:
        second = second.join(rows.select(F.col("id").alias("__id"), F.col("q").alias("__q")), F.col("q") == F.col("__id")).select(F.col("__q").alias("q"), "code", "share")
    best = knn.confidence(near, second).select("q", "codes", "confidence")
    joined = rows.join(best, "q", "left")
    at = lambda i: F.coalesce(F.try_element_at("codes", F.lit(i)), F.lit(""))
    new = {f"mk_theme{i}": at(i) for i in (1, 2, 3)} | {"mk_confidence": F.coalesce("confidence", F.lit("LOW"))}
    return _saved(insert_after(joined, "mk_theme", new).drop("q", "embedding", "codes", "confidence"), out)


def figlit(spark: SparkSession, data: str, out: str, max_iter: int = 1000) -> DataFrame:
    """Tuned logistic regression on embeddings(id, language, label, embedding), and the two baselines."""
    rows = load(spark, data).withColumn("y", models.balanced(F.col("label")).cast("double")).filter("y is not null")
    parts = sampling.split(rows, ["language", "y"], "id", fixed.SPLIT_SIZES)
    train, val, test = (parts.filter(F.col("split") == s) for s in ("train", "val", "test"))
    pred, c, _ = models.tune_logistic(train, val, test, "y", max_iter=max_iter)
    gold = lambda d: d.select("id", "language", F.col("y").cast("int").cast("string").alias("gold"))
    own = pred.select("id", "language", F.col("y").cast("int").cast("string").alias("gold"), F.col("prediction").cast("int").cast("string").alias("pred"), F.lit(f"logistic C={c}").alias("method"))
    known = gold(union_all([train, val]))
    most = metrics.dummy_most_frequent(gold(test), known).withColumn("method", F.lit("most frequent"))
    random = metrics.dummy_stratified(gold(test), known, "id").withColumn("method", F.lit("stratified"))
    return _saved(metrics.comparison(union_all([own, most, random])), out)


def _client(endpoint: str | None, model: str | None, mock: bool):
    if mock:
        return inference.first_option_client()
    if not endpoint or not model:
        raise ValueError("name a model and its endpoint, or ask for the mock")
    return inference.http_client(endpoint, model)


def _judged(df: DataFrame, out: str, pairs: dict[str, str], fold: str | None = None) -> DataFrame:
    """df with a 0/1 column for each (predicted, true) pair, saved; the means are printed, over folds if there are any."""
    for p, t in pairs.items():
        df = df.withColumn(f"{p}_ok", (F.col(p) == F.col(t)).cast("int"))
    saved = _saved(df, out)
    for p in pairs:
        print(sinks.report(metrics.folded(saved, f"{p}_ok", fold) if fold else saved.agg(F.count("*").alias("n"), F.avg(f"{p}_ok").alias("accuracy")), p))
    return saved


def _grouped(spark: SparkSession, index: str, folds: int) -> tuple[DataFrame, DataFrame]:
    """(examples with folds, definitions) of a reference index; no group spans two folds."""
    refs = sinks.load_index(spark, index)
    examples = sampling.stratified_group_folds(refs.filter("source_type = 'example'"), "kuusi_id", "theme", folds)
    if not sampling.leaks(examples, "kuusi_id").isEmpty():
        raise AssertionError("a group spans two folds")
    return examples, refs.filter("source_type <> 'example'")


LEVELS = (("theme", "theme", []), ("main", "main_class", ["theme"]), ("sub", "subgroup_code", ["main_class"]))
_TRUE = {f"pred_{n}": f"true_{n}" for n, _, _ in LEVELS}


def _truth(examples: DataFrame) -> DataFrame:
    return examples.select(F.col("ref").alias("q"), "text", "fold", "embedding", *[F.col(c).alias(f"true_{n}") for n, c, _ in LEVELS])


def rerank(spark: SparkSession, index: str, out: str, endpoint: str | None = None, model: str | None = None, mock: bool = False, sample: int = 200, k: int = fixed.KNN_K, folds: int = 5, client: object = None) -> DataFrame:
    """A model picks theme, main class and subgroup from shortlists of neighbours outside the row's own fold. sample: so many rows, 0 for all."""
    examples, defs = _grouped(spark, index, folds)
    names = defs.select("text", F.coalesce(F.nullif("subgroup_code", F.lit("")), F.nullif("main_class", F.lit("")), F.col("theme")).alias("code"))
    rows = _truth(sampling.sample_n(examples, "ref", sample) if sample else examples)
    for n, column, pool in LEVELS:
        refs = examples.filter(F.col(column) != "")
        asked = rows.withColumns({c: F.col("pred_theme" if c == "theme" else "pred_main") for c in pool})
        picked = inference.shortlist_and_pick(asked, refs, refs.select("ref", F.col(column).alias("code")), names, client or _client(endpoint, model, mock), "Pick the code that fits the text best.", k=k, pool=pool, exclude="fold")
        inside = F.coalesce(F.exists("candidates", lambda x: x["code"] == F.col(f"true_{n}")), F.lit(False)).cast("int")
        rows = materialize(picked.withColumns({f"pred_{n}": F.col("pick"), f"{n}_in_short": inside}).drop("pick", "candidates", *pool), f"picks-{n}")
    return _judged(rows.drop("embedding", "q"), out, _TRUE)


def pure_llm(spark: SparkSession, data: str, definitions: str, out: str, endpoint: str | None = None, model: str | None = None, mock: bool = False, mode: str = "cascade", sample: int = 200, client: object = None) -> DataFrame:
    """A model classifies data(id, text, theme, main_class, subgroup_code) from definitions alone, level by level or (mode flat) by subgroup at once."""
    if mode not in ("cascade", "flat"):
        raise ValueError("mode is cascade or flat")
    rows = load(spark, data)
    rows = sampling.sample_n(rows, "id", sample) if sample else rows
    defs, ask = load(spark, definitions).filter(F.trim("text") != ""), client or _client(endpoint, model, mock)
    if mode == "cascade":
        pred = inference.definition_cascade(rows, defs, ask, "Pick the code that fits the text best.")
    else:  # every subgroup stands as a theme of a cascade of one level
        flat = inference.definition_cascade(rows, defs.filter("level = 'subgroup'").withColumn("level", F.lit("theme")), ask, "Pick the code that fits the text best.")
        code = F.col("pred_theme")
        pred = flat.withColumns({"pred_theme": F.substring(code, 1, 1), "pred_main": F.substring(code, 1, 2), "pred_sub": code})
    named = pred.withColumnsRenamed({c: f"true_{n}" for n, c, _ in LEVELS})
    return _judged(named.withColumns({f"{n}_invalid": (F.col(f"pred_{n}") == "").cast("int") for n, _, _ in LEVELS}), out, _TRUE)


def figlit_llm(spark: SparkSession, data: str, out: str, endpoint: str | None = None, model: str | None = None, mock: bool = False, text: str = "proverb_native", shots: int = 0, client: object = None) -> DataFrame:
    """A model answers 0 or 1 for the locked test part; with shots, examples from the training part stand before the text."""
    rows = load(spark, data).withColumn("y", models.balanced(F.col("label"))).filter("y is not null")
    parts = sampling.split(rows, ["language", "y"], "id", fixed.SPLIT_SIZES)
    ask = "Is the text literal (0) or figurative (1)? Answer with {\"label\": 0} or {\"label\": 1}."
    if shots:
        ask += "\n\n" + inference.few_shots(parts.filter("split = 'train'"), "id", text, "y", shots)
    replied = inference.ask(parts.filter("split = 'test'"), prompt(ask, F.col(text)), client or _client(endpoint, model, mock))
    pred = replied.select("id", "language", F.col("y").cast("string").alias("gold"), json_label(F.col("reply")).cast("string").alias("pred"), F.lit(model or "mock").alias("method"))
    return _saved(metrics.comparison(pred), out)


def xgb(spark: SparkSession, index: str, out: str, folds: int = 5, rounds: int = 400, depth: int = 6) -> DataFrame:
    """Out-of-fold themes by boosted trees on embeddings, in grouped folds; the report is printed."""
    examples, _ = _grouped(spark, index, folds)
    themes = [r[0] for r in examples.select("theme").distinct().orderBy("theme").collect()]  # a row a theme
    number = F.array_position(F.array(*map(F.lit, themes)), F.col("theme")).cast("double") - 1
    rows = materialize(models.embedded(examples.withColumn("y", number), "embedding"), "boosting")
    parts = []
    for k in range(folds):
        fit = models.boosted(rows.filter(F.col("fold") != k), "features", "y", rounds, depth)
        parts.append(fit.transform(rows.filter(F.col("fold") == k)))
    code = F.element_at(F.array(*map(F.lit, themes)), F.col("prediction").cast("int") + 1)
    pred = union_all(parts).select("ref", "fold", F.col("theme").alias("gold"), code.alias("pred"))
    saved = _saved(pred, out)
    print(sinks.report(metrics.summary(saved, themes), "Boosted trees"))
    print(sinks.report(metrics.confusion_matrix(saved, themes), "Confusion"))
    return saved


def defanchor(spark: SparkSession, index: str, out: str) -> DataFrame:
    """Every example by its nearest theme definition (a), its nearest subgroup definition (b), and the cascade over definitions (c)."""
    refs = sinks.load_index(spark, index)
    rows = _truth(refs.filter("source_type = 'example'").withColumn("fold", F.lit(0))).drop("fold")
    level = lambda n, c: refs.filter(F.col("source_type") == f"def_{n}").filter(F.col(c) != "")
    named = lambda n, c: level(n, c).select("ref", F.col(c).alias("code"))
    a = knn.nearest(rows, level("theme", "theme"), named("theme", "theme")).withColumnRenamed("code", "pred_theme")
    b = knn.nearest(rows, level("subgroup", "subgroup_code"), named("subgroup", "subgroup_code")).select("q", F.col("code").alias("b_sub"), F.substring("code", 1, 2).alias("b_main"), F.substring("code", 1, 1).alias("b_theme"))
    first = materialize(rows.join(a, "q").join(b, "q"), "anchors")
    main = knn.nearest(first.withColumn("theme", F.col("pred_theme")), level("main", "main_class"), named("main", "main_class"), ["theme"]).select("q", F.col("code").alias("pred_main"))
    second = materialize(first.join(main, "q", "left"), "anchors")
    sub = knn.nearest(second.withColumn("main_class", F.col("pred_main")), level("subgroup", "subgroup_code"), named("subgroup", "subgroup_code"), ["main_class"]).select("q", F.col("code").alias("pred_sub"))
    done = second.join(sub, "q", "left").na.fill("", ["pred_main", "pred_sub"]).drop("embedding", "q")
    return _judged(done, out, _TRUE | {f"b_{n}": f"true_{n}" for n, _, _ in LEVELS})


def top3(spark: SparkSession, index: str, out: str, k: int = fixed.KNN_K, folds: int = 5) -> DataFrame:
    """By fold, the share of examples whose theme is among the first one, two and three by vote of other folds' neighbours."""
    examples, _ = _grouped(spark, index, folds)
    near = knn.neighbours(examples.withColumn("q", F.col("ref")), examples, k, exclude="fold")
    ranked = knn.top_codes(knn.vote(near, examples.select("ref", F.col("theme").alias("code"))), 3).select("q", F.col("code").alias("true_theme"), "rank")
    hits = _truth(examples).join(ranked, ["q", "true_theme"], "left").withColumns({f"top{n}": (F.coalesce("rank", F.lit(99)) <= n).cast("int") for n in (1, 2, 3)})
    saved = _saved(hits.select("q", "fold", "true_theme", "top1", "top2", "top3"), out)
    for n in (1, 2, 3):
        print(sinks.report(metrics.folded(saved, f"top{n}"), f"top {n}"))
    return saved


def _saved(df: DataFrame, out: str) -> DataFrame:
    sinks.save_table(df, out)
    return df.sparkSession.read.parquet(out)


JOBS = {f.__name__: f for f in (book, combine, clean, translate, select, imperative, imppresc, canonicalise, vote, macro_f1, llm_compare, ip_train, index, cascade, label, figlit, rerank, pure_llm, figlit_llm, xgb, defanchor, top3)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="adagium", description=__doc__)
    commands = parser.add_subparsers(dest="job", required=True)
    for name, f in JOBS.items():
        p = commands.add_parser(name.replace("_", "-"), description=f.__doc__)
        for k, v in list(inspect.signature(f).parameters.items())[1:]:
            kind = v.default
            if k in ("client", "clients"):
                continue  # injected from Python
            if isinstance(kind, bool):
                p.add_argument(f"--{k.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=kind)
            else:
                p.add_argument(f"--{k.replace('_', '-')}", required=kind is inspect.Parameter.empty, default=None if kind is inspect.Parameter.empty else kind, type=int if isinstance(kind, int) or k == "limit" else str)
    args = vars(parser.parse_args(argv))
    job = JOBS[args.pop("job").replace("-", "_")]
    job(SparkSession.builder.appName("adagium").getOrCreate(), **args)


if __name__ == "__main__":
    main()
