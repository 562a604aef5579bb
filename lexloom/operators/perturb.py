"""Variants of stated queries, as people type them: six transforms as Column builders, and their deterministic choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Shortened words, in the order they are applied.
CHAT = (
    ("bao nhiêu", "bn"), ("thế nào", "ntn"), ("không", "ko"), ("được", "dc"), ("người", "ng"), ("những", "nhg"),
    ("với", "vs"), ("vậy", "v"), ("gì", "j"), ("phải", "fai"), ("trong", "trg"), ("nhưng", "nhg"),
)
#: What a keyword search leaves out after and before the matter.
TAIL = r"\s*(thì\s+)?(sẽ\s+)?(bị\s+)?(xử\s+)?(phạt|xử lý|xử phạt)(\s+(bao nhiêu|thế nào|ra sao|mấy|như thế nào))?(\s+tiền)?\s*[?.]?\s*$"
LEAD = r"^\s*(cho\s+hỏi|xin\s+hỏi|hỏi|em\s+hỏi|anh\s+ơi|mọi\s+người\s+ơi)[,\s]+"
#: Openings of a chat message.
FILLERS = ("cho hỏi ", "mọi người ơi ", "anh chị cho em hỏi ")
#: Styles of queries that a transform would not change in kind.
UNFIT = {
    "no_diacritics": ("p_no_diacritics", "p_typo"), "chat_abbrev": ("p_chat_abbrev",), "very_short": ("p_truncate",), "colloquial": ("p_truncate",),
    "number_format": ("p_number_reformat",), "teencode": ("p_chat_abbrev", "p_no_diacritics"),
}


def seed(text: Column) -> Column:
    """The first 32 bits of the text's SHA-256."""
    return F.conv(F.substring(T.sha256(text), 1, 8), 16, 10).cast("long")


def _pick(options: Column, by: Column) -> Column:
    return F.get(options, (by % F.nullif(F.size(options), F.lit(0))).cast("int"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def no_diacritics(query: Column) -> Column:
    return F.translate(F.regexp_replace(query, "[̀-ͯ]", ""), T.FOLD_FROM, T.FOLD_TO)


def chat_abbrev(query: Column) -> Column:
    for full, short in CHAT:
        query = F.regexp_replace(query, f"(?iu){full}", short)
    return query


def truncate(query: Column) -> Column:
    """Without the opening and the closing phrase, if three words are left."""
    short = F.btrim(F.regexp_replace(F.regexp_replace(query, f"(?iu){LEAD}", ""), f"(?iu){TAIL}", ""), F.lit(" ?.,"))
    return F.when(F.size(_words(short)) >= 3, short).otherwise(query)


def number_reformat(query: Column) -> Column:
    """Whole millions in words, no leading zero, a point for the decimal comma."""
    query = F.regexp_replace(query, r"(?U)\b(?=\d{1,3}\.)0{0,2}(\d{1,3})\.000\.000\b", "$1 triệu")
    return F.regexp_replace(F.regexp_replace(query, r"(?U)\b0(\d)\b", "$1"), r"(?U)\b(\d+),(\d+)\b", "$1.$2")


def typo(query: Column) -> Column:
    """Two adjacent letters swapped inside one word of five letters or more."""
    words = _words(query)
    places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.coalesce(F.rlike(F.get(words, i), F.lit(r"^\p{L}{5,}$")), F.lit(False)))
    chosen = _pick(places, seed(query))

    def swapped(word: Column) -> Column:
        cut = (1 + seed(word) % (F.length(word) - 2)).cast("int")
        return F.concat(F.substr(word, F.lit(1), cut), F.substr(word, cut + 2, F.lit(1)), F.substr(word, cut + 1, F.lit(1)), F.substr(word, cut + 3))

    return F.when(chosen.isNull(), query).otherwise(F.array_join(F.transform(words, lambda w, i: F.when(i == chosen, swapped(w)).otherwise(w)), " "))


def noise(query: Column) -> Column:
    return F.concat(_pick(F.array(*map(F.lit, FILLERS)), seed(query)), F.rtrim(query, F.lit("?. ")), F.lit(" ???"))


TRANSFORMS = {"p_no_diacritics": no_diacritics, "p_chat_abbrev": chat_abbrev, "p_truncate": truncate, "p_number_reformat": number_reformat, "p_typo": typo, "p_noise": noise}


def all_variants(queries: DataFrame) -> DataFrame:
    """queries(ordinal, query, …) -> each transform of each query: style, variant."""
    each = F.array(*[F.struct(F.lit(k).alias("style"), f(F.col("query")).alias("variant")) for k, f in TRANSFORMS.items()])
    return queries.select("*", F.inline(each))


def perturbed(queries: DataFrame, per_query: int = 2) -> DataFrame:
    """queries(ordinal, query, base_style) -> ordinal, query (the variant), style, base_query, base_style.

    Each query takes `per_query` transforms that fit its style, in turn from one that its digest names. A variant that equals its
    query, or one before it but for case, is left out; blank queries have none.
    """
    unfit = F.create_map(*[x for k, names in UNFIT.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    usable = F.array_except(F.array(*map(F.lit, TRANSFORMS)), F.coalesce(F.try_element_at(unfit, F.coalesce("base_style", F.lit(""))), F.array().cast("array<string>")))
    turns = queries.filter(F.trim("query") != "").withColumn("_usable", usable)
    n = F.size("_usable")
    turn = F.pmod(F.array_position("_usable", F.col("style")) - 1 - seed(F.col("query")) % n, n)
    made = all_variants(turns).filter(F.array_contains("_usable", F.col("style"))).withColumn("_turn", turn).filter(F.col("_turn") < per_query).filter("variant <> query")
    first = F.row_number().over(Window.partitionBy(F.lower("variant")).orderBy("ordinal", "_turn"))
    return made.withColumn("_first", first).filter("_first = 1").select("ordinal", F.col("variant").alias("query"), "style", F.col("query").alias("base_query"), "base_style")
