"""Parser of a sectioned book: sections, paragraphs, and pairs of native and English text.

One row a book; sections and paragraphs come from splits and posexplode, so the
position in the book is explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adagium.functions import fixed


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole staged files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def sections(books: DataFrame, names: dict[str, str]) -> DataFrame:
    r"""(path, section, language, body): from each header '\n<NAME> PROVERBS.' to the next; the last ends at the index or the end mark.

    names: section name to language. A header counts where it first occurs.
    """
    at = F.array_sort(F.filter(F.array(*[F.struct(F.instr("text", f"\n{n} PROVERBS.").alias("at"), F.lit(n).alias("section"), F.lit(v).alias("language")) for n, v in names.items()]), lambda x: x["at"] > 0))
    rows = books.withColumn("__s", at).select("path", "text", "__s", F.posexplode("__s").alias("i", "s"))
    rest = F.expr("substring(text, s.at)")
    stop = F.regexp_instr(rest, F.lit(fixed.BOOK_END))
    follows = F.try_element_at("__s", F.col("i") + 2)
    size = F.when(follows.isNotNull(), follows["at"] - F.col("s.at")).when(stop > 0, stop - 1).otherwise(F.length("text"))
    return rows.select("path", F.col("s.section").alias("section"), F.col("s.language").alias("language"), F.col("i").alias("ord"), F.substring(rest, F.lit(1), size).alias("body"))


def paragraphs(parts: DataFrame) -> DataFrame:
    """Paragraphs of each section with white space collapsed; blank ones, headers and letter dividers drop."""
    rows = parts.select("path", "section", "language", "ord", F.posexplode(F.split("body", r"\n\s*\n")).alias("pos", "raw"))
    p = F.trim(F.regexp_replace("raw", r"\s+", " "))
    rows = rows.withColumn("paragraph", p).drop("raw")
    return rows.filter((F.col("paragraph") != "") & ~F.startswith("paragraph", F.concat("section", F.lit(" PROVERBS"))) & ~F.col("paragraph").rlike(r"^[A-Z]\.$"))


def _rstop(c: Column) -> Column:
    return F.trim(F.rtrim(F.trim(c), F.lit(".")))


def italic_pair(p: Column) -> tuple[Column, Column]:
    """(native, english): the first _..._ is English, what stands before it is native."""
    return _rstop(F.regexp_extract(p, r"^(.*?)_(.+?)_", 1)), F.trim(F.regexp_extract(p, "_(.+?)_", 1))


def plain_pair(p: Column) -> tuple[Column, Column]:
    """(native, english): cut after the first sentence that a capital follows; a closing note in parentheses drops."""
    cut = r"""^(.*?[.?!]["”’»)\]]?)\s+(?=["“‘«(\[]?[A-Z])(.*)$"""
    english = F.trim(F.regexp_replace(F.regexp_extract(p, cut, 2), r"\s*\([^)]*\)\s*$", ""))
    return _rstop(F.regexp_extract(p, cut, 1)), english


def index_row(native: Column, english: Column) -> Column:
    """An entry of the book's index."""
    token = F.rtrim(F.lower(F.trim(english)), F.lit("."))
    return token.isin(*fixed.INDEX_TOKENS) | native.rlike(fixed.INDEX_PAGE)


def pairs(books: DataFrame, names: dict[str, str], plain: tuple[str, ...] = ("de",)) -> DataFrame:
    """(language, ord, pos, native, english) of all sections."""
    rows = paragraphs(sections(books, names))
    (n1, e1), (n2, e2) = italic_pair(F.col("paragraph")), plain_pair(F.col("paragraph"))
    is_plain = F.col("language").isin(*plain)
    rows = rows.select("path", "language", "ord", "pos", F.when(is_plain, n2).otherwise(n1).alias("native"), F.when(is_plain, e2).otherwise(e1).alias("english"))
    return rows.filter((F.col("native") != "") & (F.col("english") != "")).filter(~index_row(F.col("native"), F.col("english")))
