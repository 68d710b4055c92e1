"""Jobs from files to files, on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from adagium import jobs
from adagium.functions import fixed
from adagium.schema import conform


def csv(path, header, rows):
    path.write_text("\n".join([",".join(header), *[",".join(f'"{v}"' for v in r) for r in rows]]) + "\n")
    return str(path)


@pytest.fixture
def master(spark, tmp_path):
    rows = [(f"en_{i:05d}", "en", f"Native {i}", t) for i, t in enumerate(["Never lie.", "Time is money", "Better late than never", "Blue sky", "He who works will gain wealth", "Rain brings clouds", "", "nan"] * 3)]
    return csv(tmp_path / "m.csv", ["id", "language", "proverb_native", "proverb_en"], rows)


def test_combine_and_clean(spark, tmp_path):
    h = ["id", "language", "proverb_native", "source_dataset"]
    csv(tmp_path / "a.csv", h, [("a_1", "fr", "  Bon  chat ", "A"), ("a_2", "fr", "bon chat!", "A"), ("a_3", "fr", "word", "A")])
    csv(tmp_path / "b.csv", [*h, "proverb_en"], [("b_1", "om", "Namni deema. The man walks home.", "B", "")])
    csv(tmp_path / "master.csv", h, [("z", "fr", "old", "Z")])
    df = jobs.combine(spark, str(tmp_path / "*.csv"), str(tmp_path / "all"))
    assert df.columns == list(fixed.CORPUS_COLUMNS) and df.count() == 4
    (tmp_path / "lex.txt").write_text("the\nman\nwalks\nhome\nword\n")
    got = {r["id"]: (r["proverb_native"], r["proverb_en"]) for r in jobs.clean(spark, str(tmp_path / "all"), str(tmp_path / "clean"), str(tmp_path / "lex.txt")).collect()}
    assert got == {"a_1": ("Bon chat", ""), "b_1": ("Namni deema.", "The man walks home.")}


def test_clean_reads_the_whole_lexicon(spark, tmp_path):
    source = csv(tmp_path / "a.csv", ["id", "language", "proverb_native", "proverb_en"], [("b_1", "om", "Namni deema. The man walks home.", "")])
    (tmp_path / "lex.txt").write_text("\n".join([*(f"zz{i}" for i in range(100_000)), *"the man walks home".split()]) + "\n")
    got = jobs.clean(spark, source, str(tmp_path / "clean"), str(tmp_path / "lex.txt")).first()
    assert (got["proverb_native"], got["proverb_en"]) == ("Namni deema.", "The man walks home.")


def test_features_and_samples(spark, tmp_path, master):
    assert jobs.imperative(spark, master, str(tmp_path / "i")).filter("has_imperative = 1").count() == 3
    got = jobs.imppresc(spark, master, str(tmp_path / "p"), sample=8)
    assert got.filter("implicit_prescriptive = 1").count() == 4
    c = jobs.canonicalise(spark, master, str(tmp_path / "c"))
    assert c.filter("canon_rule_id = 'we_time'").count() == 3
    first = jobs.select(spark, master, str(tmp_path / "s"), n=4)
    assert sorted(r["row_id"] for r in first.collect()) == [1, 2, 3, 4]
    more = jobs.select(spark, master, str(tmp_path / "s2"), add=1, existing=str(tmp_path / "s"))
    assert more.count() == 5 and more.select("id").distinct().count() == 5


def test_vote_and_train(spark, tmp_path):
    rows = [(f"p{i}", t, str(int(not t.startswith("Never"))), "1" if i % 3 else "0") for i, t in enumerate(["Never lie.", "Sky is blue", "Never run", "Rain falls"] * 5)]
    paths = []
    for name in ("ann", "bob", "cid"):
        turned = [(r[0], r[1], str(1 - int(r[2])) if name == "cid" else r[2], r[3]) for r in rows]
        paths.append(csv(tmp_path / f"{name}_labels.csv", ["id", "proverb_en", jobs.FORM, jobs.IMPLICIT], turned))
    with pytest.raises(ValueError):
        jobs.vote(spark, ",".join(paths), str(tmp_path / "g0"))
    assert jobs.vote(spark, ",".join(paths), str(tmp_path / "g0"), diagnose_only=True) is None
    gold = jobs.vote(spark, ",".join(paths), str(tmp_path / "gold"), flip=f"cid:{jobs.FORM}")
    assert {r["pd_agreement"] for r in gold.collect()} == {"unanimous"} and gold.count() == 20
    out = jobs.llm_compare(spark, str(tmp_path / "gold"), str(tmp_path / "cmp"))
    assert set(r["form_ensemble_correct"] for r in out.collect()) <= {"0", "1"}
    f1 = jobs.macro_f1(spark, str(tmp_path / "cmp"), jobs.FORM, str(tmp_path / "f1"))
    assert f1.first()["model"] == "ensemble"
    applied = jobs.ip_train(spark, str(tmp_path / "gold"), str(tmp_path / "model"), apply=paths[0], out=str(tmp_path / "ip"))
    assert applied.filter("prob_ip between 0 and 1").count() == 20


def test_index_cascade_label(spark, tmp_path):
    h = ["kuusi_id", "theme", "main_class", "subgroup_code", "proverb_primary_en", *[f"proverb_variant_{i}" for i in range(1, 5)], "proverb_variant_extra", "proverb_original"]
    rows = [(f"k{i}", "AB"[i % 2], "AB"[i % 2] + "1", "AB"[i % 2] + "1a", f"text {'xy'[i % 2]} {i}", f"more {'xy'[i % 2]} {i}", "", "", "", "", "") for i in range(20)]
    types = csv(tmp_path / "t.csv", h, rows)
    defs = csv(tmp_path / "d.csv", ["level", "code", "text"], [("theme", "A", "about x"), ("main", "A1", "of x"), ("subgroup", "A1a", "x x"), ("theme", "B", "about y"), ("main", "B1", "of y"), ("subgroup", "B1a", "y y"), ("other", "C", "c"), ("theme", "D", "")])
    client = lambda: lambda texts: [[float(t.count("x")), float(t.count("y"))] for t in texts]
    ix = jobs.index(spark, types, defs, str(tmp_path / "ix"), "toy", client)
    assert ix.count() == 46 and ix.select("ref").distinct().count() == 46
    with pytest.raises(ValueError):
        jobs.index(spark, types, defs, str(tmp_path / "ix2"), "toy")
    got = jobs.cascade(spark, str(tmp_path / "ix"), str(tmp_path / "cv"), k=3, folds=4)
    assert got.count() == 40 and got.filter("pred_theme_ok = 0 or pred_sub_ok = 0 or flat_sub_ok = 0").count() == 0
    conform(spark.createDataFrame([("1", "x x"), ("2", "y")], "id string, proverb_en string")).write.parquet(str(tmp_path / "m"))
    lab = {r["id"]: (r["mk_theme1"], r["mk_confidence"]) for r in jobs.label(spark, str(tmp_path / "m"), str(tmp_path / "ix"), str(tmp_path / "lab"), client, k=3).collect()}
    assert lab == {"1": ("A", "HIGH"), "2": ("B", "HIGH")}


def test_models_and_anchors_over_an_index(spark, tmp_path):
    codes = [(t, t + "1", t + "1" + s) for t in "AB" for s in "ab"]
    at = {c[2]: [float(i < 2), float(i >= 2), 0.3 * (i % 2)] for i, c in enumerate(codes)}
    rows = [(i, f"k{i // 2}", "example", f"text {i}", *codes[i % 4], [x + 0.01 * (i % 5) for x in at[codes[i % 4][2]]]) for i in range(40)]
    rows += [(100 + i, "", "def_subgroup", f"about {c[2]}", *c, at[c[2]]) for i, c in enumerate(codes)]
    rows += [(110 + i, "", "def_main", f"about {t}1", t, t + "1", "", [float(t == "A"), float(t == "B"), 0.1]) for i, t in enumerate("AB")]
    rows += [(120 + i, "", "def_theme", f"about {t}", t, "", "", [float(t == "A"), float(t == "B"), 0.1]) for i, t in enumerate("AB")]
    ix = str(tmp_path / "ix")
    df = spark.createDataFrame(rows, "ref long, kuusi_id string, source_type string, text string, theme string, main_class string, subgroup_code string, embedding array<float>")
    df.withColumns({"encoder": F.lit("toy"), "encoder_prefix": F.lit("")}).write.parquet(ix)
    out = jobs.rerank(spark, ix, str(tmp_path / "rr"), mock=True, sample=12, k=5, folds=4)
    assert out.count() == 12 and out.filter("theme_in_short = 0").count() == 0 and out.filter("pred_theme_ok + pred_main_ok < 2").count() == 0
    with pytest.raises(ValueError):
        jobs.rerank(spark, ix, str(tmp_path / "rr2"))
    got = jobs.defanchor(spark, ix, str(tmp_path / "da"))
    assert got.count() == 40 and got.filter("pred_theme_ok + pred_main_ok + pred_sub_ok + b_sub_ok < 4").count() == 0
    hits = jobs.top3(spark, ix, str(tmp_path / "t3"), k=5, folds=4)
    assert hits.count() == 40 and hits.agg(F.min("top1")).first()[0] == 1
    trees = jobs.xgb(spark, ix, str(tmp_path / "xgb"), folds=2, rounds=2, depth=2)
    assert trees.count() == 40 and trees.filter("gold <> pred").count() == 0
    data = df.filter("source_type = 'example'").select(F.col("ref").cast("string").alias("id"), "text", "theme", "main_class", "subgroup_code")
    data.write.parquet(str(tmp_path / "data"))
    defs = csv(tmp_path / "d.csv", ["level", "code", "text"], [("theme", "A", "a"), ("main", "A1", "a one"), ("subgroup", "A1a", "x"), ("subgroup", "A1b", "y"), ("theme", "B", "b")])
    first = jobs.pure_llm(spark, str(tmp_path / "data"), defs, str(tmp_path / "pl"), mock=True, sample=0)
    assert {(r["pred_theme"], r["pred_main"], r["pred_sub"]) for r in first.collect()} == {("A", "A1", "A1a")} and first.filter("pred_sub_ok = 1").count() == 10
    flat = jobs.pure_llm(spark, str(tmp_path / "data"), defs, str(tmp_path / "pf"), mock=True, mode="flat", sample=0)
    assert {r["pred_sub"] for r in flat.collect()} == {"A1a"}
    rows = [(str(i), "en", f"saying {i}", str(i % 2)) for i in range(60)]
    spark.createDataFrame(rows, "id string, language string, proverb_native string, label string").write.parquet(str(tmp_path / "fl"))
    said = jobs.figlit_llm(spark, str(tmp_path / "fl"), str(tmp_path / "flo"), mock=True, shots=4)
    assert said.filter("language = ''").first()["parse_fail"] == 0.0


def test_http_client(spark):
    """A server on this machine that echoes the prompt; one that fails gives no reply."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from adagium.operators import inference

    class Echo(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"error": "no"} if "bad" in asked["prompt"] else {"response": f"{asked['model']}:{asked['prompt']}"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    client = inference.http_client(f"http://127.0.0.1:{server.server_port}/", "m")
    assert {r["reply"] for r in inference.ask(df, F.col("t"), client).collect()} == {"m:a", "m:b"}
    assert {r["reply"] for r in inference.ask(df.limit(1), F.lit("bad"), client).collect()} == {""}
    server.shutdown()


def test_figlit(spark, tmp_path):
    rows = [(str(i), "en" if i % 3 else "de", str(i % 2), [float(i % 2), 0.1 * (i % 7)]) for i in range(120)]
    spark.createDataFrame(rows, "id string, language string, label string, embedding array<float>").write.parquet(str(tmp_path / "e"))
    out = jobs.figlit(spark, str(tmp_path / "e"), str(tmp_path / "r"), max_iter=50)
    best = out.filter("language = ''").orderBy(F.desc("macro_f1")).first()
    assert best["method"].startswith("logistic") and best["macro_f1"] == 1.0


def test_book(spark, tmp_path):
    from tests.test_operators import BOOK

    (tmp_path / "b.txt").write_text(BOOK)
    got = [r["id"] for r in jobs.book(spark, str(tmp_path / "b.txt"), str(tmp_path / "o"), "FRENCH=fr,GERMAN=de").orderBy("id").collect()]
    assert got == ["de_00001", "fr_00001"]


def test_command_line():
    with pytest.raises(SystemExit):
        jobs.main(["no-such-job"])
    with pytest.raises(SystemExit):
        jobs.main(["select", "--n", "5"])
