"""Problem 3: visually identical text spelled with different characters.

DuckDB runs inside the Arrow partitions: embedded SQL removes invisible characters (regexp_replace), maps compatibility
forms and look-alike letters one by one (translate), opens joined letters (replace) and composes accents
(nfc_normalize). Two texts look the same exactly when their forms are equal; what is visible (case, accents, digits,
marks, line breaks, the number of blanks) is kept.

Null texts give null, empty texts stay empty; other columns pass through under their own names; texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import cut

# Letters of Cyrillic and Greek drawn like a Latin letter, and that letter.
LOOKALIKES = {
    "а": "a", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "с": "c", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ԁ": "d", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "С": "C", "Ѕ": "S", "Т": "T", "Ү": "Y", "У": "Y", "Х": "X", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ρ": "p", "υ": "u", "ι": "i", "ϲ": "c", "ϳ": "j",
}
# Ranges of invisible characters.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
# Blanks of another width or kind, each one blank.
BLANKS = "               　"


def _single() -> tuple[str, str]:
    """Characters that become one other character, by rule: other widths, presentation forms, mathematical letters."""
    table = {b: " " for b in BLANKS}
    spans = ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9D), (0xFE80, 0xFEF4), (0x1D400, 0x1D7FF))
    for lo, hi in spans:
        for cp in range(lo, hi + 1):
            c = chr(cp)
            n = unicodedata.normalize("NFKC", c)
            if n != c and len(n) == 1:
                table[c] = n
    for c in [*table]:
        table[c] = LOOKALIKES.get(table[c], table[c])
    table |= LOOKALIKES | {c: r for c, r in _accented().items() if len(r) == 1}
    return "".join(table), "".join(table.values())


def _accented() -> dict[str, str]:
    """Accented Cyrillic and Greek letters as the look-alike of their letter with the accent, as their decomposed spelling becomes."""
    out = {}
    for cp in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        base, *marks = unicodedata.normalize("NFD", chr(cp))
        if marks and base in LOOKALIKES and chr(cp) not in LOOKALIKES:
            out[chr(cp)] = unicodedata.normalize("NFC", LOOKALIKES[base] + "".join(marks))
    return out


def _joined() -> dict[str, str]:
    """Joined letters that open into several, and accented letters that have no composed look-alike."""
    out = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFB00, 0xFB07), *range(0xFEF5, 0xFEFD), 0x0132, 0x0133, 0x01C7, 0x01C8, 0x01C9, 0x01CA, 0x01CB, 0x01CC]}
    return out | {c: r for c, r in _accented().items() if len(r) > 1}


FROM, TO = _single()
JOINED = _joined()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Polytonic Greek: its many accented letters are only looked for in texts that have one.
_POLYTONIC = (0x1F00, 0x1FFF)
FEW = {c: r for c, r in JOINED.items() if not _POLYTONIC[0] <= ord(c) <= _POLYTONIC[1]}


def form_sql(column: str, joined: dict[str, str] = JOINED) -> str:
    """The form of a text as one DuckDB expression."""
    x = f"regexp_replace({column}, {_q('[' + INVISIBLE + ']')}, '', 'g')"
    x = f"translate({x}, {_q(FROM)}, {_q(TO)})"
    for c, r in joined.items():
        x = f"replace({x}, {_q(c)}, {_q(r)})"
    for half, mark in (("ﾞ", "゙"), ("ﾟ", "゚")):
        x = f"replace({x}, {_q(half)}, {_q(mark)})"
    return f"nfc_normalize({x})"


_ASCII_FAST = (
    f"CASE WHEN regexp_full_match({{0}}, '[\\x00-\\x7f]*') THEN {{0}} WHEN regexp_matches({{0}}, '[{chr(_POLYTONIC[0])}-{chr(_POLYTONIC[1])}]') THEN {form_sql('{0}')} ELSE {form_sql('{0}', FEW)} END"
)
#: Rows that DuckDB works on at once.
ROWS = 1000


def _connection():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '256MB'")
    return con


def canonical(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """Adds the consistent form of a text column under the name `out` (replacing a column of that name)."""
    keep = [c for c in df.columns if c != out]
    inner = [f"c{i}" for i in range(len(keep))]
    k = keep.index(text)
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(inner, keep)] + [T.StructField("f", T.StringType())])
    sql = f"SELECT {_ASCII_FAST.replace('{0}', 't')} AS f FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            con = con or _connection()
            batch = pa.table({"t": b.column(k)})  # noqa: F841  DuckDB reads it by name
            con.register("batch", batch)
            f = con.sql(sql).to_arrow_table().column("f").combine_chunks()
            con.unregister("batch")
            if isinstance(f, pa.ChunkedArray):
                f = f.chunk(0) if f.num_chunks else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, f.cast(pa.string())], names=[*inner, "f"])
        if con:
            con.close()

    done = df.select([df[f"`{c}`"].alias(n) for n, c in zip(inner, keep)]).mapInArrow(run, schema)
    return done.select([F.col(n).alias(c) for n, c in zip(inner, keep)] + [F.col("f").alias(out)])


def same_look(essays: DataFrame, id_col: str = "essay_id", text: str = "text") -> DataFrame:
    """Pairs (id_a, id_b) of records whose different texts look the same; blank texts pair with nothing.

    Only digests are shuffled. Spellings of one look are paired first, then each spelling brings its ids, so exact copies
    never meet each other and the work follows the size of the result, which lists every pair of ids.
    """
    rows = essays.select(F.col(f"`{id_col}`").alias("essay_id"), F.col(f"`{text}`").alias("text")).where("essay_id IS NOT NULL AND text IS NOT NULL AND length(regexp_replace(text, '(?U)\\\\s', '')) > 0")
    digests = cut(canonical(rows).select("essay_id", F.unhex(F.md5("form")).alias("look"), F.unhex(F.md5("text")).alias("spelling")).distinct())
    spellings = digests.select("look", "spelling").distinct()
    several = spellings.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    mixed = spellings.join(several, "look", "left_semi")
    a, b = mixed.alias("a"), mixed.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.spelling") < F.col("b.spelling"))).select(F.col("a.spelling").alias("s1"), F.col("b.spelling").alias("s2"))
    ids = digests.select("essay_id", "spelling")
    both = pairs.join(ids.select(F.col("essay_id").alias("x"), F.col("spelling").alias("s1")), "s1").join(ids.select(F.col("essay_id").alias("y"), F.col("spelling").alias("s2")), "s2")
    return both.where("x <> y").select(F.least("x", "y").alias("essay_id_a"), F.greatest("x", "y").alias("essay_id_b")).distinct()
