"""External models behind injected clients: labelling, translation, picking, sentiment, syntax.

A client is a factory that each task calls once; it returns a function of a list
of texts (or prompts) that gives a list of replies. Failing calls are retried,
then give ''. Parsers of replies are column expressions in functions.replies.
The mocks make plumbing testable without a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from adagium.functions.replies import json_code, line_code, options, prompt
from adagium.functions.text import needs_translation
from adagium.operators import knn

Client = Callable[[], Callable[[list[str]], list[str]]]


def ask(df: DataFrame, text: Column, client: Client, out: str = "reply", retries: int = 1, parallel: int | None = None) -> DataFrame:
    """A reply for each row. parallel: concurrent tasks, that is, calls."""

    def run(batches):
        import pandas as pd

        call = client()
        for s in batches:
            texts, replies = [t or "" for t in s], None
            for attempt in range(retries + 1):
                try:
                    replies = list(call(texts))
                    break
                except Exception:  # the client's own failures: counted as unparsed replies
                    if attempt == retries:
                        replies = [""] * len(texts)
            yield pd.Series(replies, dtype=object)

    fn = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)
    return (df.repartition(parallel) if parallel else df).withColumn(out, fn(text))


def mock_client(reply: Callable[[str], str]) -> Client:
    return lambda: lambda texts: [reply(t) for t in texts]


def http_client(endpoint: str, model: str, timeout: float = 120.0) -> Client:
    """A local model server that takes a JSON prompt at temperature 0 and answers with a text under "response"."""

    def load():
        import json
        from urllib.request import Request, urlopen

        def one(text: str) -> str:
            body = json.dumps({"model": model, "prompt": text, "stream": False, "options": {"temperature": 0}}).encode()
            with urlopen(Request(endpoint, body, {"Content-Type": "application/json"}), timeout=timeout) as reply:
                said = json.load(reply)
            if "error" in said:
                raise OSError(said["error"])
            return said.get("response", "")

        return lambda texts: [one(t) for t in texts]

    return load


def first_option_client() -> Client:
    """A mock for plumbing: the code of the first option of a prompt, as a line and as JSON."""
    code = lambda p: p.split("\n\n")[1].split(":")[0] if p.count("\n\n") else ""
    return mock_client(lambda p: f'CODE: {code(p)}\n{{"code": "{code(p)}", "label": 0}}')


def translate(df: DataFrame, clients: dict[str, Client], limit: int | None = None, seed: int = 42) -> DataFrame:
    """proverb_en of rows that lack it, by the client of their language; marks human_machine_labelled '1'.

    Languages without client stay. limit: so many rows a language at most, in order of id.
    """
    from pyspark.sql import Window as W

    need = needs_translation(F.col("proverb_en"), F.col("proverb_native"))
    if limit is not None:
        place = F.row_number().over(W.partitionBy("language", need).orderBy("id"))
        df = df.withColumn("__place", place)
        need = need & (F.col("__place") <= limit)
    df = df.withColumn("__need", need)
    out = df.filter(~F.col("__need") | ~F.col("language").isin(*clients))
    for language, client in clients.items():
        part = ask(df.filter(F.col("__need") & (F.col("language") == language)), F.col("proverb_native"), client, "__en")
        done = F.trim("__en") != ""
        part = part.withColumns({"proverb_en": F.when(done, F.col("__en")).otherwise(F.col("proverb_en")), "human_machine_labelled": F.when(done, "1").otherwise(F.col("human_machine_labelled"))})
        out = out.unionByName(part.drop("__en"))
    return out.drop("__need", "__place")


def pick(df: DataFrame, candidates: str, text: str, client: Client, instruction: str) -> DataFrame:
    """Column pick from an array of (code, text): '' without candidates, the only one without asking, else the model's."""
    n = F.size(candidates)
    codes = F.transform(F.col(candidates), lambda x: x["code"])
    many = ask(df.filter(n > 1), prompt(instruction, F.col(text), options(F.col(candidates))), client, "__reply")
    many = many.withColumn("pick", json_code(F.col("__reply"), codes)).drop("__reply")
    few = df.filter(F.coalesce(n <= 1, F.lit(True))).withColumn("pick", F.coalesce(F.try_element_at(codes, F.lit(1)), F.lit("")))
    return many.unionByName(few)


def shortlist_and_pick(queries: DataFrame, refs: DataFrame, labels: DataFrame, definitions: DataFrame, client: Client, instruction: str, text: str = "text", k: int = 15, n: int = 10, pool: list[str] = [], exclude: str | None = None) -> DataFrame:
    """The codes of the k nearest references, at most n by vote, then the model's pick."""
    near = knn.neighbours(queries, refs, k, pool=pool, exclude=exclude)
    top = knn.top_codes(knn.vote(near, labels), n).select("q", "rank", "code")
    named = top.join(definitions.select("code", F.col("text").alias("__d")), "code", "left")
    lists = named.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", F.coalesce("__d", "code").alias("text")))), lambda x: F.struct(x["code"].alias("code"), x["text"].alias("text"))).alias("candidates"))
    empty = F.array().cast("array<struct<code: string, text: string>>")
    return pick(queries.join(lists, "q", "left").withColumn("candidates", F.coalesce("candidates", empty)), "candidates", text, client, instruction)


def definition_cascade(df: DataFrame, definitions: DataFrame, client: Client, instruction: str, text: str = "text") -> DataFrame:
    """Theme, main class, subgroup from definitions alone; a reply outside the list is '' and ends the cascade."""
    levels = (("theme", None, 0, "pred_theme"), ("main", "pred_theme", 1, "pred_main"), ("subgroup", "pred_main", 2, "pred_sub"))
    for level, parent, width, out in levels:
        own = definitions.filter(F.col("level") == level)
        item = F.struct("code", F.col("text").alias("text"))
        lists = own.withColumn("__p", F.substring("code", 1, width) if width else F.lit("")).groupBy("__p").agg(F.array_sort(F.collect_list(item)).alias("__c"))  # a row a parent
        on = df.withColumn("__p", F.col(parent) if parent else F.lit("")).join(lists, "__p", "left")
        asked = ask(on, prompt(instruction, F.col(text), options(F.col("__c"))), client, "__r")
        codes = F.transform(F.col("__c"), lambda x: x["code"])
        df = asked.withColumn(out, F.coalesce(F.when(F.size("__c") > 0, line_code(F.col("__r"), codes)), F.lit(""))).drop("__p", "__c", "__r")
    return df


def few_shots(train: DataFrame, key: str, text: str, label: str, shots: int, seed: int = 42) -> str:
    """About shots examples, as many of each class and one at least, from the training rows alone, rendered in hashed order."""
    from adagium.operators.sampling import draw, sample_strata

    names = [r[0] for r in train.select(F.col(label).cast("string")).distinct().orderBy(label).collect()]  # a row a class
    rows = sample_strata(train.withColumn("__l", F.col(label).cast("string")), "__l", key, {x: max(1, shots // len(names)) for x in names}, seed)
    rows = rows.orderBy(draw(F.col(key), f"{seed}s"), key).select(text, "__l").collect()  # shots rows
    return "\n\n".join(f'Text: "{t}"\n{{"label": {y}}}' for t, y in rows)


def embed(df: DataFrame, text: Column, encoder: Callable[[], Callable[[list[str]], list]], prefix: str = "", out: str = "embedding") -> DataFrame:
    """Embeddings by an injected encoder, loaded once a task; prefix as some encoders ask for."""

    def run(batches):
        import pandas as pd

        encode = encoder()
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in encode([prefix + (t or "") for t in s])], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)(text))


def classify_texts(df: DataFrame, text: Column, model: Client, out: str) -> DataFrame:
    """0/1 flags or words of a syntax or sentiment model; the regular expressions of functions.rules are the fallback."""
    return ask(df, text, model, out)
