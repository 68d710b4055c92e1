"""Plans of the corpus workload: normalise, deduplicate, conform, validate, sample, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from adagium.functions import fixed, text as T
from adagium.operators import corpus, metrics, sampling
from adagium.plans.registry import TEMPLATED_SQL, query, quoted, table, templated
from adagium.schema import conform, numbered_id, required_counts

_WS = r"[\s\x0B\x1C-\x1F\x85\pZ]+"
_CLEAN = rf"trim(regexp_replace(nfc_normalize(text), '{_WS}', ' ', 'g'))"
# Case folding of the four languages in the tables differs from lower-casing by one letter.
_KEY = rf"trim(regexp_replace(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '{_WS}', ' ', 'g')), '\s+([{fixed.TIGHT_PUNCTUATION}])', '\1', 'g'), '{fixed.EDGE_PUNCTUATION.replace(chr(39), chr(39) * 2)}')"
LEXICON = ["the", "and", "with", "for", "this", "that", "from", "was", "are", "which", "not", "have", "one", "you", "they"]
_LEX = ", ".join(f"'{w}'" for w in LEXICON)
_DRAW = "md5(concat(doc_id::VARCHAR, ':42'))"


def _labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")


@query(f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def norm_text(spark, d):
    """T1."""
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {_KEY} AS norm_key FROM documents")
def norm_keys(spark, d):
    """T2."""
    return table(spark, d, "documents").select("doc_id", T.norm_key(F.col("text")).alias("norm_key"))


@query(f"""WITH k AS (SELECT d.doc_id, lang, {_KEY} AS norm_key, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))
SELECT doc_id, lang, norm_key, quality FROM (SELECT *, row_number() OVER (PARTITION BY lang, norm_key ORDER BY (quality IS NOT NULL) DESC, doc_id) AS r FROM k) WHERE r = 1""")
def dedup_ranked(spark, d):
    """One document for each language and key, labelled ones first."""
    out = corpus.dedup_ranked(_labelled(spark, d), "text", "lang", [F.col("quality").isNotNull().desc()], "doc_id")
    return out.select("doc_id", "lang", "norm_key", "quality")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_first(spark, d):
    """W2."""
    return corpus.first_by(table(spark, d, "documents").select("doc_id", "text"), ["text"], [F.col("doc_id")])


@query("""SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) AS r
FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)) WHERE r = 1""")
def first_label_per_text(spark, d):
    """W3."""
    rows = _labelled(spark, d).filter(F.col("quality").isNotNull()).withColumn("key", F.trim("text"))
    return corpus.first_by(rows, ["key"], [F.col("doc_id")]).select("doc_id", "quality")


def _all_sources(spark, d):
    docs = table(spark, d, "documents").select(numbered_id(F.col("lang"), F.col("doc_id") + 1).alias("id"), F.col("lang").alias("language"), F.col("text").alias("proverb_native"))
    bench = table(spark, d, "benchmark").select(numbered_id(F.lit("bench"), F.col("item_id") + 1).alias("id"), F.col("text").alias("proverb_native"))
    talk = table(spark, d, "conversations").select(F.format_string("conv_%05d_%d", F.col("conv_id"), F.col("turn")).alias("id"), F.col("text").alias("proverb_native"), F.col("role").alias("proverb_type"))
    return corpus.union_all([
        conform(docs, {"source_dataset": "documents", "license": "synthetic", "resource_level": "high"}),
        conform(bench, {"source_dataset": "benchmark", "language": "en", "license": "synthetic"}),
        conform(talk, {"source_dataset": "conversations", "language": "en"}),
    ])


def _conform_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{columns.get(c, chr(39) * 2)} AS {c}" for c in fixed.CORPUS_COLUMNS) + f" FROM {source}"


_UNION = " UNION ALL ".join([
    _conform_sql({"id": "concat(lang, '_', lpad((doc_id + 1)::VARCHAR, greatest(5, length((doc_id + 1)::VARCHAR))::INT::INT, '0'))", "language": "lang", "proverb_native": "text", "source_dataset": "'documents'", "license": "'synthetic'", "resource_level": "'high'"}, "documents"),
    _conform_sql({"id": "concat('bench_', lpad((item_id + 1)::VARCHAR, greatest(5, length((item_id + 1)::VARCHAR))::INT::INT, '0'))", "language": "'en'", "proverb_native": "text", "source_dataset": "'benchmark'", "license": "'synthetic'"}, "benchmark"),
    _conform_sql({"id": "concat('conv_', lpad(conv_id::VARCHAR, greatest(5, length(conv_id::VARCHAR))::INT, '0'), '_', turn::VARCHAR)", "language": "'en'", "proverb_native": "text", "proverb_type": "role", "source_dataset": "'conversations'"}, "conversations"),
])


@query(_UNION)
def corpus_conform_union(spark, d):
    """P1, P2, P3, U1."""
    return _all_sources(spark, d)


@query(f"""SELECT count(*) AS rows, {", ".join(f"count(*) FILTER (coalesce(trim({c}), '') = '') AS blank_{c}" for c in fixed.REQUIRED_COLUMNS)}, count(id) - count(DISTINCT id) AS repeated FROM ({_UNION})""")
def validate_counts(spark, d):
    """V1, A13, A14."""
    return required_counts(_all_sources(spark, d))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def counts_by_source_lang(spark, d):
    """A1."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def counts_by_language(spark, d):
    """A2."""
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT lang, n, round(n / sum(n) OVER (), 3) AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def value_share(spark, d):
    """A3."""
    return metrics.value_share(table(spark, d, "documents"), "lang")


@query("SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents WHERE lang = 'de'")
def sources_without_german(spark, d):
    """U3."""
    docs = table(spark, d, "documents")
    return docs.select("source").distinct().subtract(docs.filter("lang = 'de'").select("source"))


@query(f"SELECT doc_id FROM documents WHERE NOT (text = '' OR regexp_matches(text, '^[^\\pL\\pN\\pM_]+$') OR lower(regexp_extract(text, '^([A-Za-z]+)\\.?$', 1)) IN ({_LEX}))")
def junk_filter(spark, d):
    """T7."""
    return table(spark, d, "documents").filter(~T.is_junk(F.col("text"), LEXICON)).select("doc_id")


_APART = r"trim(regexp_replace(text, '([.!?])([A-Z])', '\1 \2', 'g'))"


@query(rf"""WITH s AS (SELECT doc_id, [x FOR x IN string_split_regex(regexp_replace({_APART}, '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS p FROM documents)
SELECT doc_id, len(p)::BIGINT AS n_sentences, coalesce(length(p[1]), 0)::BIGINT AS first_length FROM s""")
def sentence_stats(spark, d):
    """T3."""
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("p"))
    return s.select("doc_id", F.size("p").cast("long").alias("n_sentences"), F.coalesce(F.length(F.try_element_at("p", F.lit(1))), F.lit(0)).cast("long").alias("first_length"))


@query(f"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_extract_all(lower(text), '[a-z'']+') IF length(x) >= 3] AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 2 THEN round(len([x FOR x IN w IF x IN ({_LEX})]) / len(w)::DOUBLE, 6) ELSE 0 END AS fraction FROM w""")
def english_fraction(spark, d):
    """T4."""
    return table(spark, d, "documents").select("doc_id", F.round(T.english_fraction(F.col("text"), LEXICON), 6).alias("fraction"))


# The SQL engine's \\b takes ASCII alone for words: other letters become underscores, one for one, before places are found.
_PLACES = r"regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', '_', 'g')"
_SQUEEZED = lambda x: f"trim(regexp_replace({x}, {quoted(T.SPACE)}, ' ', 'g'))"


@query(rf"""WITH s AS (SELECT doc_id, text, [x FOR x IN string_split_regex(regexp_replace({_APART}, '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS p FROM documents),
w AS (SELECT *, [[z FOR z IN regexp_extract_all(lower(x), '[a-z'']+') IF length(z) >= 3] FOR x IN p] AS ws FROM s),
f AS (SELECT *, list_reverse([CASE WHEN len(y) >= 2 THEN len([z FOR z IN y IF z IN ({_LEX})]) / len(y)::DOUBLE ELSE 0 END >= 0.3 FOR y IN ws]) AS fl FROM w),
t AS (SELECT *, len(p) AS n, coalesce(nullif(list_position(fl, false), 0) - 1, len(p)) AS tail FROM f),
k AS (SELECT *, CASE WHEN regexp_matches({_PLACES}, {quoted(fixed.EMBEDDED_ENGLISH)}) THEN text[1:length(regexp_extract({_PLACES}, concat('(?s)^(.*?)(?:', {quoted(fixed.EMBEDDED_ENGLISH)}, ')'), 1))] END AS before FROM t),
c AS (SELECT *, length(before) - strpos(reverse(before), '.') + 1 AS stop, before IS NOT NULL AND contains(before, '.') AS cut FROM k)
SELECT doc_id, CASE WHEN tail > 0 AND tail < n THEN trim(array_to_string(p[1:n - tail], ' ')) ELSE text END AS native_lexicon, CASE WHEN tail > 0 AND tail < n THEN trim(array_to_string(p[n - tail + 1:], ' ')) ELSE '' END AS english_lexicon,
CASE WHEN cut THEN {_SQUEEZED("text[1:stop]")} ELSE text END AS native_keyword, CASE WHEN cut THEN {_SQUEEZED("text[stop + 1:]")} ELSE '' END AS english_keyword FROM c""")
def embedded_english(spark, d):
    """Trailing English by lexicon and by keyword."""
    c = F.col("text")
    (n1, e1), (n2, e2) = T.split_english(c, LEXICON, 0.3), T.split_at_english(c)
    return table(spark, d, "documents").select("doc_id", n1.alias("native_lexicon"), e1.alias("english_lexicon"), n2.alias("native_keyword"), e2.alias("english_keyword"))


@query()
def clean_documents(spark, d):
    """The cleaning stage over all sources."""
    rows = _all_sources(spark, d).withColumn("position", F.concat_ws(":", "source_dataset", "id"))
    return corpus.clean_corpus(rows, LEXICON).select("id", "language", "proverb_native", "proverb_en")


@query(f"WITH {TEMPLATED_SQL} SELECT * FROM tc")
def templated_corpus(spark, d):
    """T19."""
    return templated(table(spark, d, "documents"))


@query("SELECT doc_id, CASE WHEN trim(lang) <> '' THEN lang ELSE source END AS picked, lang = 'en' AND coalesce(trim(text), '') <> '' AS needs, coalesce(trim(text) <> '' AND lower(trim(text)) <> 'nan', false) AS has_english FROM documents")
def text_predicates(spark, d):
    """P5, P6, P7."""
    no_english = F.when(F.col("lang") == "en", "").otherwise("x")
    return table(spark, d, "documents").select("doc_id", T.prefer_text(F.col("lang"), F.col("source")).alias("picked"), T.needs_translation(no_english, F.col("text")).alias("needs"), T.has_english(F.col("text")).alias("has_english"))


@query(f"SELECT doc_id FROM documents ORDER BY {_DRAW}, doc_id LIMIT 100")
def sample_n(spark, d):
    """D1, D9."""
    return sampling.sample_n(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query(f"""WITH s AS (SELECT doc_id, text FROM documents ORDER BY {_DRAW}, doc_id LIMIT 100),
m AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s) AND text NOT IN (SELECT text FROM s) ORDER BY md5(concat(doc_id::VARCHAR, ':7')), doc_id LIMIT 50)
SELECT row_number() OVER (ORDER BY md5(concat(doc_id::VARCHAR, ':7')), doc_id) + 100 AS row_id, doc_id FROM m""")
def sample_extend(spark, d):
    """D2, J3, W7."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sampling.extend_sample(docs, sampling.sample_n(docs, "doc_id", 100), "doc_id", "text", 50, seed=7).select("row_id", "doc_id")


@query(f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, doc_id) AS r FROM documents)
WHERE r <= CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 20 WHEN 'de' THEN 20 ELSE 0 END""")
def sample_stratified(spark, d):
    """D3."""
    return sampling.sample_strata(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 40, "fr": 20, "de": 20})


_LAB = "(SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)"


@query(f"SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) AS r FROM {_LAB}) WHERE r <= 25 AND quality IN (0, 1)")
def sample_balanced(spark, d):
    """D4."""
    rows = _labelled(spark, d).filter("quality is not null").withColumn("s", F.col("quality").cast("string"))
    return sampling.sample_strata(rows, "s", "doc_id", {"0": 25, "1": 25}).select("doc_id", "quality")


@query(f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_DRAW}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
WHERE r <= greatest(1, round_even(n * 0.1::DOUBLE, 0))""")
def sample_proportional(spark, d):
    """D5."""
    return sampling.sample_share(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.1)


@query(f"""SELECT doc_id, CASE WHEN p < 0.64::DOUBLE THEN 'train' WHEN p < 0.8::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (
SELECT doc_id, (row_number() OVER (PARTITION BY lang, quality ORDER BY {_DRAW}, doc_id) - 1) / (count(*) OVER (PARTITION BY lang, quality))::DOUBLE AS p FROM documents JOIN {_LAB} USING (doc_id))""")
def split_stratified(spark, d):
    """D6."""
    rows = _labelled(spark, d).filter("quality is not null").select("doc_id", "lang", "quality")
    return sampling.split(rows, ["lang", "quality"], "doc_id", fixed.SPLIT_SIZES).select("doc_id", "split")


@query("SELECT vec_id, ('0x' || substring(md5(concat((vec_id // 3)::VARCHAR, ':42')), 1, 8))::BIGINT % 5 AS fold FROM embeddings")
def group_folds(spark, d):
    """D7, by hash."""
    rows = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 3).alias("g"))
    return sampling.group_folds(rows, "g").select("vec_id", F.col("fold").cast("long").alias("fold"))


def _stratified(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 3).alias("g"))
    return sampling.stratified_group_folds(rows, "g", "label")


@query("""WITH c AS (SELECT vec_id // 3 AS g, label::VARCHAR AS y, count(*) AS n FROM embeddings GROUP BY 1, 2),
s AS (SELECT g, first(y ORDER BY n DESC, y) AS y, max(n) AS n, string_agg(concat(y, ':', n), ',' ORDER BY y) AS s FROM c GROUP BY 1),
r AS (SELECT g, (row_number() OVER (ORDER BY y, n DESC, s, md5(concat(g::VARCHAR, ':42')), g) - 1) % 10 AS i FROM s)
SELECT vec_id, least(i, 9 - i) AS fold FROM embeddings JOIN r ON g = vec_id // 3""")
def stratified_folds(spark, d):
    """D7, stratified."""
    return _stratified(spark, d).select("vec_id", F.col("fold").cast("long").alias("fold"))


@query("SELECT 0::BIGINT AS leaking, count(DISTINCT vec_id // 3) AS groups FROM embeddings")
def leak_check(spark, d):
    """D7 (stratified), J10, V3: no group spans two folds."""
    folds = _stratified(spark, d)
    bad = sampling.leaks(folds, "g").agg(F.count("*").alias("leaking"))
    return bad.crossJoin(folds.agg(F.count_distinct("g").alias("groups")))  # one row each


@query(f"SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) - 1) % 5)::INT AS fold FROM {_LAB} WHERE doc_id IN (SELECT doc_id FROM documents) AND quality IS NOT NULL")
def class_folds(spark, d):
    """D8."""
    return sampling.class_folds(_labelled(spark, d).filter("quality is not null"), "quality", "doc_id").select("doc_id", "fold")


_V = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')"


@query(f"""WITH v AS (SELECT doc_id, [x FOR x IN [w[1], w[2], w[3], w[2], ' ', w[1]] IF x IS NOT NULL AND trim(x) <> ''] AS l FROM (SELECT doc_id, {_V} AS w FROM documents)),
u AS (SELECT doc_id, [x FOR x, i IN l IF list_position(l, x) = i] AS l FROM v)
SELECT doc_id, (unnest(generate_series(1, len(l))) - 1)::INT AS variant, unnest(l) AS text FROM u""")
def unpivot_variants(spark, d):
    """P12."""
    w = F.regexp_extract_all("text", F.lit(r"([^ \t\n\r\f\x0B]+)"), 1)
    rows = table(spark, d, "documents").select("doc_id", w.alias("w"))
    at = lambda i: F.try_element_at("w", F.lit(i))
    rows = rows.select("doc_id", *[v.alias(f"v{i}") for i, v in enumerate((at(1), at(2), at(3), at(2), F.lit(" "), at(1)))])
    return corpus.unpivot_variants(rows, ["doc_id"], [f"v{i}" for i in range(6)])


_DEFS = """defs AS (SELECT 'theme' AS level, chr(65 + r_regionkey::INT) AS code, r_name AS text FROM region
UNION ALL SELECT 'main', concat(chr(65 + n_regionkey::INT), (n_nationkey % 10)::VARCHAR), n_name FROM nation)"""


def _definitions(spark, d):
    letter = lambda c: F.char((F.lit(65) + F.col(c)).cast("int"))
    themes = table(spark, d, "region").select(F.lit("theme").alias("level"), letter("r_regionkey").alias("code"), F.col("r_name").alias("text"))
    mains = table(spark, d, "nation").select(F.lit("main").alias("level"), F.concat(letter("n_regionkey"), (F.col("n_nationkey") % 10).cast("string")).alias("code"), F.col("n_name").alias("text"))
    return themes.unionByName(mains)


@query(f"WITH {_DEFS} SELECT concat('def_', level) AS source_type, text, code[1:1] AS theme, CASE WHEN level <> 'theme' THEN code[1:2] ELSE '' END AS main_class, '' AS subgroup_code FROM defs WHERE trim(text) <> ''")
def code_parents(spark, d):
    """P13, P14."""
    return corpus.definition_rows(_definitions(spark, d))


@query(f"WITH {_DEFS} SELECT p.code, p.text, c.code AS child, c.text AS child_text FROM defs p JOIN defs c ON c.level = 'main' AND c.code[1:1] = p.code WHERE p.level = 'theme'")
def hierarchy_children(spark, d):
    """J7."""
    defs = _definitions(spark, d)
    return corpus.children(defs.filter("level = 'theme'").select("code", "text"), defs, "code", "main", 1)


@query(f"WITH {_DEFS} SELECT n.n_name, n.code, coalesce(d.text, n.code) AS code_text FROM (SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'Z9' ELSE chr(65 + n_regionkey::INT) END AS code FROM nation) n LEFT JOIN defs d ON n.code = d.code")
def code_texts(spark, d):
    """J6."""
    n = table(spark, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 3 == 0, "Z9").otherwise(F.char((F.lit(65) + F.col("n_regionkey")).cast("int"))).alias("code"))
    return corpus.code_text(n, _definitions(spark, d), "code")


@query("""SELECT r_name, n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((r_name), (r_name, n_name))""")
def hier_rollup(spark, d):
    """A4 over two levels of a hierarchy, as grouping sets."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupingSets([["r_name"], ["r_name", "n_name"]], "r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.lang WHEN d.source IS NOT NULL THEN d.source ELSE '' END AS value, CASE WHEN l.quality = 1 THEN 'human' WHEN d.source IS NOT NULL THEN 'machine' ELSE '' END AS value_source
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def preferred_source(spark, d):
    """S10."""
    docs = _labelled(spark, d)
    human = docs.filter("quality = 1").select("doc_id", F.col("lang").alias("value"))
    machine = docs.select("doc_id", F.col("source").alias("value"))
    return corpus.preferred(docs.select("doc_id"), [("human", human), ("machine", machine)], "doc_id", "value")


@query("SELECT r_regionkey AS position, r_name, r_name AS b_r_name FROM region")
def paired_by_position(spark, d):
    """J4."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("position"), "r_name")
    return corpus.paired(r, r, "position", "r_name")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS body FROM pages)
SELECT page_id, len(regexp_extract_all(body, '<p>'))::BIGINT AS paragraphs, length(body)::BIGINT AS body_length FROM p""")
def html_sections(spark, d):
    """S12, S13 on pages: the section between two markers, and its paragraph marks."""
    body = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_count(body, F.lit("<p>")).cast("long").alias("paragraphs"), F.length(body).cast("long").alias("body_length"))
