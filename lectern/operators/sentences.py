"""Rule-based sentence spans, paragraph breaks and segments, computed within the row of their document; a hook for other splitters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import bind, sums_before
from lectern.functions.text import WS, strip

#: Pieces tile the text: a run without a stop and the stops after it.
PIECE = "[^.!?]+[.!?]*|[.!?]+"


def sentence_array(text: Column) -> Column:
    """array<struct<sent_idx, start, end, sentence, is_break, segment>> of the non-empty sentences of a text; null for null."""

    def placed(pieces: Column) -> Column:
        def one(raw: Column, before: Column) -> Column:
            lead = F.regexp_extract(raw, f"^([{WS}]*)", 1)
            return bind(
                F.struct(lead.alias("lead"), strip(raw).alias("sentence")),
                lambda x: F.struct((before + F.length(x["lead"])).alias("start"), x["sentence"].alias("sentence"), (F.regexp_count(x["lead"], F.lit("\\n")) >= 2).alias("gap")),
            )

        return F.filter(F.zip_with(pieces, sums_before(F.transform(pieces, F.length)), one), lambda x: x["sentence"] != "")

    def numbered(rows: Column) -> Column:
        breaks = F.transform(rows, lambda x, i: ((i == 0) | x["gap"]).cast("int"))
        return bind(F.struct(breaks.alias("b"), sums_before(breaks).alias("s")), lambda k: F.transform(rows, lambda x, i: F.struct(
            i.alias("sent_idx"), x["start"].cast("long").alias("start"), (x["start"] + F.length(x["sentence"])).cast("long").alias("end"), x["sentence"].alias("sentence"),
            (k["b"][i] == 1).alias("is_break"), (k["s"][i] + k["b"][i] - 1).alias("segment"),
        )))

    return F.when(text.isNotNull(), bind(bind(F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1)), placed), numbered))


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(key, columns to keep, sent_idx, start, end, sentence, is_break, segment) for every non-empty sentence; no shuffle.

    A sentence starts a paragraph if it is the first or if two newlines at least lie in the white space just before it.
    Null and empty texts have no sentence.
    """
    return docs.where(F.col(text).isNotNull()).select(key, *keep, F.inline(sentence_array(F.col(text))))


#: Characters of a block by which positions meet in a range join.
POSITIONS = 1024


def in_sentences(tokens: DataFrame, sentences: DataFrame, key: str = "doc_id", at: str = "start") -> DataFrame:
    """Tokens (key, at, ...) with the sent_idx of the sentence whose span holds their position; tokens between sentences drop out.

    A range join by blocks of positions: a sentence stands in every block that it touches, a token in one.
    """
    s = sentences.select(key, "sent_idx", F.col("start").alias("__s"), F.col("end").alias("__e"), F.explode(F.sequence(F.floor(F.col("start") / POSITIONS), F.floor((F.col("end") - 1) / POSITIONS))).alias("__b"))
    t = tokens.withColumn("__b", F.floor(F.col(at) / POSITIONS))
    return t.join(s, [key, "__b"]).where((F.col(at) >= F.col("__s")) & (F.col(at) < F.col("__e"))).drop("__b", "__s", "__e")


def positions(text: Column) -> Column:
    """array<struct<token, start>> of the words between white space."""

    def of(pieces: Column) -> Column:
        placed = F.zip_with(pieces, sums_before(F.transform(pieces, F.length)), lambda p, at: F.struct(p.alias("token"), at.cast("long").alias("start")))
        return F.filter(placed, lambda x: ~x["token"].rlike(f"^[{WS}]"))

    return bind(F.regexp_extract_all(text, F.lit(f"([^{WS}]+|[{WS}]+)"), F.lit(1)), of)


#: A splitter turns (documents, key, text) into the rows above.
Splitter = Callable[[DataFrame, str, str], DataFrame]
