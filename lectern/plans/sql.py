"""SQL fragments that the oracle queries share: the rule splitter, tokens, words and buckets as DuckDB writes them."""

from __future__ import annotations

from lectern.functions.text import TOKEN, WS

# Fixed values, written out here once more so that a slip in the package shows against them.
BUCKETS = (("short", 0), ("standard", 200), ("long", 500), ("xlong", 800))
PUNCTUATION = ".,!?;:\"'()\\[\\]{}<>\\-"
VOWELS = "[aeiouyà-æè-ïò-öøù-ýÿœ]+"

WS_RE = WS  # RE2 and Java write the class alike


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS_RE}]+|[{WS_RE}]+$', '', 'g')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{TOKEN.replace(chr(39), chr(39) * 2)}')"


def words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '[{WS_RE}]+'), lambda w: w <> ''))"


def bucket(n: str) -> str:
    out = " ".join(f"WHEN {n} >= {lo} AND {n} < {hi} THEN '{name}'" for (name, lo), (_, hi) in zip(BUCKETS, BUCKETS[1:]))
    return f"CASE {out} WHEN {n} IS NOT NULL THEN '{BUCKETS[-1][0]}' END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


def bare(c: str) -> str:
    return f"regexp_replace({c}, '[{WS_RE}]+', '', 'g')"


def sentences(table: str = "documents", key: str = "doc_id", text: str = "text", where: str = "TRUE") -> str:
    """CTEs ending in `sent` (key, sent_idx, start, end, sentence, is_break, segment)."""
    return f"""
    pieces AS (SELECT {key}, regexp_extract_all({text}, '[^.!?]+[.!?]*|[.!?]+') AS p FROM {table} WHERE {text} IS NOT NULL AND {where}),
    rawp AS (SELECT {key}, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM pieces),
    placed AS (SELECT {key}, i, raw, coalesce(sum(length(raw)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f,
                      {strip('raw')} AS sentence, regexp_extract(raw, '^([{WS_RE}]*)', 1) AS lead FROM rawp),
    kept AS (SELECT {key}, f + length(lead) AS start, f + length(lead) + length(sentence) AS stop, sentence,
                    row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS sent_idx, length(regexp_replace(lead, '[^\\n]', '', 'g')) >= 2 AS gap
             FROM placed WHERE sentence <> ''),
    sent AS (SELECT {key}, sent_idx, start::BIGINT AS start, stop::BIGINT AS "end", sentence, (sent_idx = 0 OR gap) AS is_break,
                    sum(CASE WHEN sent_idx = 0 OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY sent_idx) - 1 AS segment FROM kept)"""


def blank_words(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({c}), '[{WS_RE}]+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')"


def feature_columns(s: str, t: str, words_: str = "bw", digits: int = 6) -> dict[str, str]:
    """The twelve sentence features over a sentence `s`, its tokens `t` and its words between blanks."""
    n, k = f"len({t})", f"len(list_distinct({t}))"
    b = bare(s)
    syll = f"list_sum(list_transform({words_}, lambda w: greatest(1, len(regexp_extract_all(w, '{VOWELS}')))))::DOUBLE"
    hard = f"len(list_filter({words_}, lambda w: len(regexp_extract_all(w, '{VOWELS}')) >= 3))::DOUBLE"
    chars = f"length({b})::DOUBLE"
    letters = f"length(regexp_replace({s}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE"
    some = lambda x: f"CASE WHEN len({words_}) > 0 THEN {x} ELSE 0.0::DOUBLE END"
    w = f"len({words_})::DOUBLE"
    grams = f"list_transform(range(1, length({b}) - 1), lambda i: substring({b}, i, 3))"
    pairs = f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    punct = PUNCTUATION.replace("'", "''")
    cols = {
        "ttr": ratio(k, n),
        "word_length_mean": ratio(f"length(array_to_string({t}, ''))", n),
        "sent_len": f"{n}::DOUBLE",
        "lexical_recurrence": ratio(f"{n} - {k}", n),
        "ngram_rep_char_3": f"CASE WHEN length({b}) >= 3 THEN 1.0::DOUBLE - len(list_distinct({grams}))::DOUBLE / (length({b}) - 2)::DOUBLE ELSE 0.0::DOUBLE END",
        "ngram_rep_word_2": f"CASE WHEN {n} >= 2 THEN 1.0::DOUBLE - len(list_distinct({pairs}))::DOUBLE / ({n} - 1)::DOUBLE ELSE 0.0::DOUBLE END",
        "punct_density": ratio(f"length(regexp_replace({s}, '[^{punct}]', '', 'g'))", f"length({b})"),
        "flesch_reading_ease": some(f"206.835::DOUBLE - 1.015::DOUBLE * {w} - 84.6::DOUBLE * ({syll} / {w})"),
        "flesch_kincaid_grade": some(f"0.39::DOUBLE * {w} + 11.8::DOUBLE * ({syll} / {w}) - 15.59::DOUBLE"),
        "ari": some(f"4.71::DOUBLE * ({chars} / {w}) + 0.5::DOUBLE * {w} - 21.43::DOUBLE"),
        "coleman_liau": some(f"0.058::DOUBLE * (100.0::DOUBLE * ({letters} / {w})) - 0.296::DOUBLE * (100.0::DOUBLE / {w}) - 15.8::DOUBLE"),
        "gunning_fog": some(f"0.4::DOUBLE * ({w} + 100.0::DOUBLE * ({hard} / {w}))"),
    }
    return {k_: f"round({v}, {digits})" for k_, v in cols.items()}


def featured(key: str = "doc_id", digits: int = 6, extra: str = "") -> str:
    """A CTE `feat` over `sent` with the features of every sentence."""
    cols = ", ".join(f"{v} AS {k}" for k, v in feature_columns("sentence", "t", "bw", digits).items())
    return f"""
    tok AS (SELECT *, {tokens('sentence')} AS t, {blank_words('sentence')} AS bw FROM sent),
    feat AS (SELECT {key}, sent_idx, segment, sentence, {extra}{cols} FROM tok)"""


def _quoted(words_) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words_)


def tag_case(u: str = "x") -> str:
    """Class of one unit by the rules of the surrogate tagger."""
    from lectern.operators.tagging import CLOSED, ENDINGS

    punct = PUNCTUATION.replace("'", "''")
    closed = " ".join(f"WHEN lower({u}) IN ({_quoted(ws)}) THEN '{t}'" for t, ws in CLOSED.items())
    endings = " ".join(f"WHEN regexp_matches(lower({u}), '^{e}$') THEN '{t}'" for t, e in ENDINGS)
    return (
        f"CASE WHEN regexp_matches({u}, '^[0-9]+$') THEN 'NUM' WHEN regexp_matches({u}, '^[{punct}]$') THEN 'PUNCT' {closed} WHEN NOT regexp_matches({u}, '[A-Za-z\\x{{C0}}-\\x{{24F}}]') THEN 'SYM' {endings} "
        f"WHEN regexp_matches({u}, '^[A-Z]') THEN 'PROPN' ELSE 'NOUN' END"
    )


def units(c: str) -> str:
    punct = PUNCTUATION.replace("'", "''")
    return f"regexp_extract_all({c}, '[A-Za-z0-9''\\x{{C0}}-\\x{{24F}}]+|[{punct}]|[^\\sA-Za-z0-9''\\x{{C0}}-\\x{{24F}}]')"


POS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")


def syntax_columns(digits: int = 6) -> dict[str, str]:
    """Shares of classes, their entropy and clauses over the units `u` and classes `g` of a sentence."""
    from lectern.operators.tagging import CLAUSE_OPENERS

    share = lambda t: f"(len(list_filter(g, lambda y: y = {t}))::DOUBLE / len(g))"
    cols = {f"pos_{t}": share(f"'{t}'") for t in POS}
    cols["pos_entropy"] = f"list_sum(list_transform(list_distinct(g), lambda k: -{share('k')} * log2({share('k')})))"
    cols["clause_density"] = f"1.0::DOUBLE + len(list_filter(u, lambda y: lower(y) IN ({_quoted(CLAUSE_OPENERS)})))"
    return {k: f"CASE WHEN len(g) > 0 THEN round({v}, {digits}) END" for k, v in cols.items()}


#: Features in the order of extraction; the one that needs a parser is never there.
TEXTUAL = (
    "ttr", "word_length_mean", "sent_len", "lexical_recurrence", "ngram_rep_char_3", "ngram_rep_word_2", "punct_density",
    "flesch_reading_ease", "flesch_kincaid_grade", "ari", "coleman_liau", "gunning_fog", *(f"pos_{t}" for t in POS), "pos_entropy", "dep_depth_mean", "clause_density",
)
MODEL = ("perplexity", "token_entropy_mean", "token_entropy_std", "log_prob_mean", "log_prob_std", "rank_mean", "rank_std", "prob_curvature")
ORDER = (*TEXTUAL, *MODEL)


def vectors(key: str = "doc_id", model: bool = True) -> str:
    """CTEs ending in `longf` (key, sent_idx, feature, ordinal, value) over `sent`: every feature that a sentence has."""
    cols = feature_columns("sentence", "t") | syntax_columns()
    names = [n for n in TEXTUAL if n in cols]
    out = f"""
    tok AS (SELECT {key}, sent_idx, sentence, {tokens('sentence')} AS t, {blank_words('sentence')} AS bw, {units('sentence')} AS u FROM sent),
    tgd AS (SELECT *, list_transform(u, lambda x: {tag_case()}) AS g FROM tok),
    feat AS (SELECT {key}, sent_idx, {', '.join(f'{cols[n]} AS {n}' for n in names)} FROM tgd)"""
    if model:
        out += f""",
    lmh AS (SELECT b, count(*) AS n FROM (SELECT ('0x' || substr(md5(token), 1, 5))::BIGINT AS b FROM (SELECT unnest({tokens('text')}) AS token FROM documents WHERE text IS NOT NULL)) GROUP BY b),
    lma AS (SELECT sum(n)::DOUBLE + count(*) AS whole, count(*) AS kinds, max(n) AS top FROM lmh),
    lme AS (SELECT sum(-((n + 1.0::DOUBLE) / whole) * ln((n + 1.0::DOUBLE) / whole)) AS h FROM lmh, lma),
    lmr AS (SELECT b, n, rank() OVER (ORDER BY n DESC) - 1 AS rk FROM lmh),
    lmt AS (SELECT {key}, sent_idx, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS i FROM tgd),
    lms AS (SELECT {key}, sent_idx, ln((coalesce(n, 0) + 1.0::DOUBLE) / whole) AS lp, coalesce(rk, kinds)::DOUBLE AS rk, (top + 1.0::DOUBLE) / whole AS t1
            FROM lmt LEFT JOIN lmr ON lmr.b = ('0x' || substr(md5(token), 1, 5))::BIGINT, lma WHERE NOT (i = 0 AND sent_idx = 0)),
    lmf AS (SELECT {key}, sent_idx, round(exp(-avg(lp)), 3) AS perplexity, round(any_value(h), 4) AS token_entropy_mean, 0.0::DOUBLE AS token_entropy_std, round(avg(lp), 5) AS log_prob_mean, round(stddev_pop(lp), 5) AS log_prob_std,
            round(avg(rk), 4) AS rank_mean, round(stddev_pop(rk), 4) AS rank_std, round(avg(t1), 5) AS prob_curvature FROM lms, lme GROUP BY {key}, sent_idx),
    featm AS (SELECT feat.*, {', '.join(f'coalesce({n}, 0.0::DOUBLE) AS {n}' for n in MODEL)} FROM feat LEFT JOIN lmf USING ({key}, sent_idx))"""
        names += MODEL
    source = "featm" if model else "feat"
    lists = f"unnest([{_quoted(names)}]) AS feature, unnest([{', '.join(str(ORDER.index(n) + 1) for n in names)}]) AS ordinal, unnest([{', '.join(names)}]) AS value"
    return out + f""",
    longf AS (SELECT * FROM (SELECT {key}, sent_idx, {lists} FROM {source}) WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))"""


def unpivoted(names: tuple[str, ...], keys: str, ordinals: dict[str, int], source: str = "feat") -> str:
    """A CTE `longf` (keys, feature, ordinal, value)."""
    parts = " UNION ALL ".join(f"SELECT {keys}, '{n}' AS feature, {ordinals[n]} AS ordinal, {n} AS value FROM {source}" for n in names)
    return f"longf AS (SELECT * FROM ({parts}) WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))"
