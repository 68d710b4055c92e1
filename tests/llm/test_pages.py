"""Operators on pages, and the pipeline."""

import base64
import hashlib
import json
import re

import duckdb
import numpy as np
import pytest

from adagium.llm import html_pages, html_text, queries, url_filter, warc
from adagium.llm.common import shared_dir

PAGES = "page_id long, url string, html string, text string, host string, n int, __id int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", 1, 2) for r in rows], PAGES).repartition(3)


@pytest.fixture(scope="module")
def model():
    return html_text.train_model()


def article(html):
    """Text of the template pages' article, by their fixed markup."""
    import html as h

    parts = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", html, re.S)[1])
    return "\n\n".join(x for x in (" ".join(h.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts) if x)


def test_blocks():
    page = "<body><p>a &amp; b<br>c<p>d <b>e</b>f<div>g</div>h<script>var x='<p>no</p>'</script><!-- <p>no --> <ul><li>i<li>j</ul>&copy k &lt;p&gt; 1 < 2</body>"
    assert html_text.blocks(page).texts == ["a & b c", "d ef", "g", "h", "i", "j", "© k <p> 1 < 2"]
    assert html_text.blocks(None).texts == html_text.blocks("").texts == []
    one = html_text.blocks("<p title='x>y' class='Big one' id=k>z</p")
    assert one.texts == ["z"] and one.path(0) == ["p", ".big", ".one", ".k"] and one.links == [0.0]
    assert html_text.blocks('<p class="a">x</p><a href="q"').texts == ["x"]


def test_hidden_elements_show_nothing():
    page = "<p>a</p><p hidden>b</p><div style='color:red; DISPLAY : none'><p>c <b>d</b></p></div><p title='is hidden here'>e <span style=visibility:hidden>f</span>g</p><p aria-hidden=true data-hidden=1>h<p hidden>i<p>j"
    assert html_text.blocks(page).texts == ["a", "e g", "h", "j"]


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    deep = html_text.blocks("<div><b>" * 100_000 + "<p>x</p>" + "<span>" * 1000 + "".join(f"<li>{i}" for i in range(1000)))
    assert deep.texts[0] == "x" and len(deep) == 1001 and deep.depths[0] == 200_001
    assert html_text.Inputs([deep]).vectors(html_text.new_model(np.random.default_rng(0))).shape == (1001, html_text.INPUT)
    assert time.time() - began < 5


def test_path_sums(model):
    """A block's path vector is the sum of the vectors of its path."""
    cut = [html_text.blocks(html_pages.page(f"3:{k}")[0]) for k in range(5)]
    x = html_text.Inputs(cut).vectors(model)[:, : html_text.PATH_DIM]
    want = [sum((model["path"][html_text._path_slot(t)] for t in c.path(k)), np.zeros(html_text.PATH_DIM)) for c in cut for k in range(len(c))]
    assert np.allclose(x, want, atol=1e-4)


def test_labeller_on_unseen_pages(model):
    wrong = total = 0
    for k in range(120):
        page, main = html_pages.page(f"77:{k}")
        b = html_text.blocks(page)
        p = html_text.probabilities(model, html_text.Inputs([b]))
        wrong += sum((q >= 0.5) != (x in main) for x, q in zip(b.texts, p))
        total += len(b)
    assert wrong / total < 0.01


def test_labeller_on_pages_labelled_by_hand(model):
    from tests.llm.hand_pages import PAGES

    wrong = total = 0
    for page, main in PAGES:
        found, want = html_text.main_texts(model, [page])[0][0].split("\n\n"), main.split("\n\n")
        wrong += len(set(found) ^ set(want))
        total += len(html_text.blocks(page))
    assert total > 50 and wrong / total < 0.06


def test_labels_do_not_depend_on_the_batch(model):
    made = [html_text.blocks(html_pages.page(f"5:{k}")[0]) for k in range(20)]
    together = html_text.probabilities(model, html_text.Inputs(made))
    alone = np.concatenate([html_text.probabilities(model, html_text.Inputs([b])) for b in made])
    assert np.allclose(together, alone, atol=1e-4)


def test_gradient(model):
    """Backpropagation against finite differences."""
    rng = np.random.default_rng(1)
    m = {k: v.astype(float) for k, v in html_text.new_model(rng).items()}
    made = [html_pages.page(f"9:{k}") for k in range(3)]
    cut = [html_text.blocks(p) for p, _ in made]
    y = np.concatenate([[float(t in main) for t in c.texts] for c, (_, main) in zip(cut, made)])
    inputs = html_text.Inputs(cut)
    g, _ = html_text._gradients(m, inputs, y)
    for name, at in (("wf", (3, 7)), ("wb", (html_text.INPUT + 2, 30)), ("cf", (11,)), ("out", (4,)), ("path", (int(inputs.events[0]), 2)), ("path", (int(inputs.events[len(inputs.events) // 2]), 3)), ("word", (int(inputs.words[0]), 1))):
        eps, loss = 1e-5, []
        for s in (eps, -eps):
            m[name][at] += s
            loss.append(html_text._gradients(m, inputs, y)[1])
            m[name][at] -= s
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * eps), rel=1e-3, abs=1e-7)


def test_extract(spark, model):
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in d.collect()}
    got = html_text.extract(d, model).collect()
    same = sum(r["text"] == article(html[r["page_id"]]) for r in got)
    assert len(got) == len(html) and same >= 0.98 * len(html)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_extract_odd_pages(spark, model):
    long = "<article>" + "".join(f"<p>word{i} and some more words follow here.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>> &&& <a"), (4, "u", long), (4, "u", long), (None, None, "<article><p>An article without number has words.</p></article>")]
    got = html_text.extract(pages(spark, rows), model).collect()
    assert sorted((str(r["page_id"]), r["n_main"]) for r in got if r["page_id"] in (1, 2, 4)) == [("1", 0), ("2", 0), ("4", 5000), ("4", 5000)]
    assert len(got) == 6 and html_text.extract(pages(spark, rows).limit(0), model).count() == 0


# ---- archives --------------------------------------------------------------------------------


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


ARCHIVE = [(1, "http://a/ü\n", "one"), (2, "http://b", "one"), (3, None, "two"), (4, "http://c", None), (5, "http://d", ""), (6, "http://e", "one"), (6, "http://e", "one"), (None, "http://f", "one"), (7, "http://g", "é" * 90_000)]


def test_archive(spark):
    got = warc.archive(pages(spark, ARCHIVE)).collect()
    last = {}
    for i, _, h in ARCHIVE:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = []
    for i, _, h in ARCHIVE:
        p = (h or "").encode()
        ref = None if i is None or i == last[h or ""] else last[h or ""]
        want.append((i, len(p), b32(p), "response" if ref is None else "revisit", ref))
    key = str
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)


def test_archive_files(spark):
    """Two writes give the same bytes; files roll; the manifest lists just what is there; payloads come back."""
    d = pages(spark, ARCHIVE)
    outs = [f"{shared_dir(spark)}/warc-test-{i}-{np.random.default_rng().integers(1 << 60)}" for i in range(2)]
    manifests = [warc.write_warc(x, o, target_bytes=400) for x, o in zip((d, d.repartition(1)), outs)]
    assert [m["sha256"] for m in manifests[0]] == [m["sha256"] for m in manifests[1]] and len(manifests[0]) > 4
    folder = outs[0].removeprefix("file://")
    import os

    assert sorted(x for x in os.listdir(folder) if not x.startswith(".")) == sorted(["MANIFEST.json", *[m["file"] for m in manifests[0]]])
    assert json.load(open(f"{folder}/MANIFEST.json"))["files"] == manifests[0]
    back = {(r["page_id"], bytes(r["payload"])) for r in warc.read_warc(spark, outs[0], payloads=True).filter("record_type = 'response'").collect()}
    assert (7, ("é" * 90_000).encode()) in back and (6, b"one") in back
    with pytest.raises(FileExistsError):
        warc.write_warc(d, outs[0])
    assert json.load(open(f"{folder}/MANIFEST.json"))["files"] == manifests[0] and not os.path.exists(f"{folder}/_temporary")
    small = {r["page_id"]: r["record_type"] for r in warc.archive(d, min_payload=100).collect()}
    assert set(small.values()) == {"response"}
    assert warc.archive(d.limit(0)).count() == 0


# ---- urls ------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y", "http://example.net/en", "http://example.net/en/", "https://b.example.com:80/de/1#f", "http://org/fr/x", "http://x.org?u=/fr/", "http://ÄB.org/fr/", "ftp://net", "http://net/", "http://example.com.net/x", "a://b://c/d"]


def slow_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(r), r, act) for act, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, "http://q.org/", None)]
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages(spark, rows), none).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(URLS):
        host, path, rule, action = slow_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, action or "allow")


def test_bad_host_is_blocked_and_new_host_inherits(spark):
    rows = [(i, f"http://bad.spam.org/{i}", None) for i in range(40)] + [(100 + i, f"http://good{i % 4}.fine.org/{i}", None) for i in range(80)] + [(300, "http://new.spam.org/", None), (301, "http://new.fine.org/", None)]
    good = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(80)] + [(5, None), (None, 1)], "page_id long, good int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages(spark, rows), good).collect()}
    assert got[3] == "block" and got[150] == "allow" and got[301] == "allow"
    assert url_filter.filter_urls(pages(spark, rows).limit(0), good).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    for t in ("pages", "labels", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    key = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == cols and key(got) == key(want)


# ---- pipeline --------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import shutil

    import corpus_pipeline as cp

    from adagium.llm import near_dup

    for t in ("documents", "labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.01/{t}.parquet", tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames, d = [docs], docs
    for i, (_, f) in enumerate(cp.STAGES):
        f(spark, d, sf).write.parquet(f"{sf}/stage{i}")
        d = spark.read.parquet(f"{sf}/stage{i}")
        frames.append(d)
    assert all(f.columns == docs.columns for f in frames[:-1])
    n = [f.count() for f in frames]
    assert n == sorted(n, reverse=True) and 0 < n[-1] < n[0]
    classes = near_dup.classes(frames[1]).collect()
    assert {r["doc_id"] for r in frames[2].collect()} == {r["class_id"] for r in classes}
    run = {r["doc_id"]: r["ids_sha256"] for r in cp.run(spark, sf).collect()}
    assert run == {r["doc_id"]: r["ids_sha256"] for r in frames[-1].collect()}
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, f in cp.STAGES:
        empty = f(spark, empty, sf)
    assert empty.count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Every stage alone, on null ids and texts, shared ids, repeated rows and clashing columns, against brute force."""
    import corpus_pipeline as cp
    import tiktoken

    import public_tokenizers as P

    from tests.llm.cases import edge_docs, frame
    from tests.llm.test_documents import counted, slow_classes, slow_dedup, split

    rows = edge_docs()
    docs = frame(spark, rows)
    text = {r[0]: r[1] for r in rows}
    item = " ".join(split(text[7])[:9]) + "\n" + " ".join(split(text[7])[9:14])
    spark.createDataFrame([(1, item), (None, text[3]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(112, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = {name: f(spark, docs, str(tmp_path)) for name, f in cp.STAGES}
    assert all(d.columns == docs.columns for n, d in stage.items() if n != "byte-level BPE")
    got = {n: [tuple(r) for r in d.select("doc_id", "text").collect()] for n, d in stage.items() if n != "byte-level BPE"}
    assert not counted(got["quality classifier"]) - counted(r[:2] for r in rows) and {r[0] for r in got["quality classifier"]} >= set(range(60))
    kept = {d for d, c in slow_classes(rows).items() if d == c}
    assert {r[0] for r in got["near duplicates"] if r[0] is not None} == kept and sum(r[0] is None for r in got["near duplicates"]) == 2
    sha = lambda t: hashlib.sha256(" ".join(split(t)).encode("utf-8", "surrogatepass")).hexdigest()
    assert counted((d, sha(t)) for d, t in got["repeated passages"]) == counted((d, h) for d, _, _, h in slow_dedup(rows, 20))
    assert counted(got["benchmark leaks"]) == counted(r[:2] for r in rows if r[0] != 7)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [(r["doc_id"], bytes(r["ids"])) for r in stage["byte-level BPE"].collect()]
    assert counted(ids) == counted((r[0], np.array(enc.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()) for r in rows)
