import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.repetition import Tokens, judged, repeated_share, repeating
from lectern.llm.sentences import Model, sentences, split
from lectern.llm.truncation import endings, length_hazards, tail

CASES = [
    ["Dr. Yotra told me to be in Paris at 6 a.m. on the dot.", "We left."],
    ["We stayed until 3 p.m.", "In my notes it was cold."],
    ['"I can\'t trust it. I tried 77 times," Ann said, and left.', "It rained."],
    ["“Duck!” Gizolin Vortolin shouted across the bakery.", "Then he left."],
    ["That evening Ann called the map “a win!” and nobody argued.", "Why me?"],
    ["My grade, i.e. 28.2, did not please Prof. Elrenor.", "I saved essay_v4.7.txt twice."],
    ["Vivió en EE. UU. 51 meses antes de pedir ayuda.", "¿Por qué?"],
    ["«¡Espera!», gritó Ana desde la radio.", "El Sr. Paz rió."],
    ["Manche Dinge, z. B. eine Uhr, brauchen Ruhe.", "Am 17. Mai 1978 fuhr er fort."],
    ["„Halt!“, rief Kim über die Tür.", "Ich dachte an Treue … aber Kim ging."],
    ["« Arrête ! » a crié Bea devant la lampe.", "Selon l'art. 21 du règlement, il fallait partir."],
    ["Мы жили на ул. Хомотурск, д. 612, долго.", "«Стой!» – крикнул Дан у моста.", "Некоторые вещи, т. е. пила, важны."],
    ["(Nobody here had asked Ann about it.)", "I was not ready ... but Ann was."],
    ["I will not say no.", "I traded a camera."],
]
GLUED = [
    ["「もう無理。帰りたい。」とガキは言った。", "気温は33.6度から上がった。", "なんと古い本だろう！"],
    ["“我不行了。我想回家。”她说。", "我的钟表来自城……后来她走了。", "多么简单的地图啊！"],
    ["We left late.", "Running laps helped me.", "Why not?"],
]
THAI = ["ฉันใช้เวลา 532 ชั่วโมงกับกานินต์", "ในปี 1986 มาลุวงศ์ได้เขียนจดหมาย", "แผนที่เก่านี้มาจากขานินต์นคร"]


@pytest.mark.parametrize("parts", CASES)
@pytest.mark.parametrize("sep", [" ", "  ", "\n\n"])
def test_known_sentences(parts, sep):
    t = sep.join(parts)
    assert [t[a:b] for a, b in split(t)] == parts


@pytest.mark.parametrize("parts", GLUED)
def test_without_blanks(parts):
    t = "".join(parts)
    assert [t[a:b] for a, b in split(t)] == parts


def test_thai_blanks():
    t = " ".join(THAI)
    assert [t[a:b] for a, b in split(t)] == THAI


def test_hindi_and_arabic():
    for parts in (["डॉ. पूमिवी ने कहा कि चुप्पी ज़रूरी है।", "“रुको!” रालाक चिल्लाया।"], ["صرخ داموف: «توقف!» ثم خرج من نارومية.", "قال د. باموق إن الصداقة أهم من الصمت."]):
        t = " ".join(parts)
        assert [t[a:b] for a, b in split(t)] == parts


def test_headings_and_wrapped_lines():
    t = "My quiet loom\n\nWithout it, the letters from\nFrance were lost. We\nleft."
    assert [t[a:b] for a, b in split(t)] == ["My quiet loom", "Without it, the letters from\nFrance were lost.", "We\nleft."]


def test_garbled_and_invisible_characters_keep_positions():
    t = "â€œWait â€“ what?â€\x9d asked Ann. The sign​ read no.​  Then we left."
    assert [t[a:b] for a, b in split(t)] == ["â€œWait â€“ what?â€\x9d asked Ann.", "The sign​ read no.​", "Then we left."]


def test_the_length_of_whole_spans_decides():
    """Without the length of spans the same boundaries are chosen otherwise."""
    flat = Model(lengths={k: (4.0, 3.0) for k in ("spaced", "unspaced", "thai")})
    t = "WE HAD LIVED IN THE U.S. FOR 663 WEEKS."
    long = "THE TEACHER OF OUR SCHOOL AND MY COUSIN, WHO HAD NEVER LEFT THE VALLEY BEFORE, WERE FLOWN TO THE U.S. FOR MANY WEEKS THE HOUSE STOOD EMPTY AND NOBODY CAME BY TO SEE WHETHER ANYTHING WAS WRONG."
    assert len(split(t)) == 1 and len(split(long)) == 2
    assert len(split(t, flat)) == len(split(long, flat))


def test_texts_without_marks_are_divided_by_counted_words(spark):
    first, verbs, last = ["Every", "Nobody", "Somewhere", "Our"], ["saw Marta near the river and", "met Ivo in the old town before he", "told Dr Paz about the garden that"], ["slept", "sang", "left"]
    rng = random.Random(8)
    said = lambda: f"{rng.choice(first)} friend {rng.choice(verbs)} {rng.choice(last)}"
    rows = [(i, ". ".join(said() for _ in range(8)) + ".") for i in range(80)]
    parts = [said() for _ in range(9)]
    df = spark.createDataFrame([*rows, (1000, " ".join(parts)), (1001, None)], "i int, text string")
    got = [r["sentence"] for r in sentences(df).where("i = 1000").orderBy("sent_index").collect()]
    assert got == parts
    t = " ".join(parts)
    assert [t[a:b] for a, b in split(t)] != parts  # without the counts they are not told apart


@pytest.mark.parametrize("n", [150, 250, 1000])
def test_any_number_of_rejected_marks(n):
    t = "He met " + "Dr. Lee and " * n + "left."
    assert split(t) == [(0, len(t))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?\n\"“”«»()…。「」ก1é​ ,-", max_size=80))
def test_spans_cover_all_but_white_space(t):
    spans = split(t)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    left = list(t)
    for a, b in spans:
        assert not t[a].isspace() and not t[b - 1].isspace()
        left[a:b] = " " * (b - a)
    assert all(c.isspace() or c == "​" for c in left)


def test_sentence_rows(spark):
    df = spark.createDataFrame([("a", "One. Two."), ("b", None), ("c", " "), ("a", "One. Two.")], "essay_id string, text string").selectExpr("*", "7 AS sent_index", "8 AS sentence")
    rows = sentences(df).orderBy("sent_index").collect()
    assert [(r["essay_id"], r["sentence"]) for r in rows] == [("a", "One.")] * 2 + [("a", "Two.")] * 2
    assert sentences(df.limit(0)).count() == 0


def test_very_long_text():
    assert len(split("Some words here. " * 3000)) == 3000
    assert repeated_share("word " * 50000) > 0.99


# --- repetition ---------------------------------------------------------------------------------------------------------


def test_repeated_share():
    assert repeated_share(None) == repeated_share("") == repeated_share("One two three.") == 0.0
    a = "the quick brown fox jumps over lazy dogs near old river banks "
    assert repeated_share(a) == 0.0
    assert repeated_share(a + a.upper()) == pytest.approx(0.5 * 2 - 0.5, abs=0.51) and repeated_share(a + a) >= 0.4
    assert repeated_share(a * 4) >= 0.7
    assert repeated_share("so tired " + "fragile " * 30) > 0.9
    assert repeated_share("我和她花了506个小时讨论失败。" * 5) > 0.7
    assert repeated_share("Paid 12, 13, 14 and 15; paid 16.") < 0.4


def random_text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_the_band_rejects_no_text_that_repeats_two_fifths():
    rng = random.Random(11)
    tokens = Tokens()
    rejected = 0
    for n in range(600):
        words = [rng.choice(["ba", "tolo", "mirkaded", "su"]) + rng.choice("aeiou") + str(k).translate(str.maketrans("0123456789", "bcdfghjklm")) for k in range(rng.randint(3, 60))]
        text = []
        for _ in range(rng.randint(1, 12)):  # new words, and stretches of three words or more that were said before
            text += [words[rng.randrange(len(words))] for _ in range(rng.randint(1, 9))]
            if len(text) > 8 and rng.random() < 0.7:
                i = rng.randrange(len(text) - 4)
                text += text[i : i + rng.randint(3, 5)]
        row = tokens.measure(" ".join(text), True)
        assert not (row[7] and row[8] >= 0.4)
        rejected += row[7]
    assert 100 < rejected < 590  # the band decides


def test_words_have_the_tokens_they_have_in_their_text():
    from lectern.llm.tokenizers import piece_bpe

    model, _ = piece_bpe()
    text = "ein grüner baum steht am haus и старый дом у реки naïve café"
    assert [t for w in Tokens().of(text.split()) for t in w] == model.encode(text)


def test_judged(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", random_text(rng, 80)) for i in range(40)] + [(f"r{i}", random_text(rng, 20) + " " + "come to our shop today " * 15) for i in range(5)] + [("e", None), ("f", "  "), ("r0", rng.choice("ab"))]
    df = spark.createDataFrame([(i, "human", None, t) for i, t in rows], "essay_id string, label string, model string, text string").selectExpr("*", "1 AS script")
    found = {r["essay_id"] for r in judged(df).where("repeats").collect()}
    assert found == {r["essay_id"] for r in repeating(df).collect()}
    assert found == {f"r{i}" for i in range(5)}
    assert judged(df.limit(0)).count() == 0


def test_other_texts_do_not_decide(spark):
    rng = random.Random(3)
    half = [(t := random_text(rng, 60)) + " " + " ".join(t.split()[:50]) for _ in range(10)]
    plain, loops = [random_text(rng, rng.randint(80, 140)) for _ in range(20)], ["come to our shop today " * rng.randint(40, 160) for _ in range(30)]
    rows = [(f"{k}{i}", t) for k, texts in (("h", half), ("n", plain), ("s", loops)) for i, t in enumerate(texts)]
    out = {r["essay_id"]: r for r in judged(spark.createDataFrame([(i, "human", None, t) for i, t in rows], "essay_id string, label string, model string, text string")).collect()}
    assert {i for i, r in out.items() if r["repeats"]} == {i for i in out if i[0] in "hs"}
    assert all(abs(r["surplus"]) < 0.2 for i, r in out.items() if i[0] == "n")


def test_long_quotation_does_not_divide():
    t = "He said: “" + "We must go home. " * 399 + "We must go home” and left the room. Then it rained."
    assert [t[a:b][-12:] for a, b in split(t)] == ["ft the room.", "n it rained."]


# --- truncation ------------------------------------------------------------------------------------------------------------


def test_kinds_of_endings():
    kind = lambda t: tail(t)[0]
    assert kind(None) == kind(" ") == "blank"
    assert kind("We left. She said my pa… Read more") == kind("We left. By then there [...]") == kind("We left. The map (cont") == "mark"
    assert kind("We left. “I will not go.") == "open"
    assert kind("We spoke to Dr.") == "abbreviation"
    assert kind("We left early,") == "comma"
    assert kind("We left early.") == "stop" and kind("We left (early).") == "stop"
    assert kind("buy this now " * 20 + "buy th") == "repeats"


def corpus(rng, n, limit):
    pool = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(700)]
    w = lambda: rng.choice(pool)
    sentence = lambda: f"{w().capitalize()} {w()} the {w()} {w()} near a {w()}."
    rows = [(f"e{i:04d}", " ".join(sentence() for _ in range(rng.randint(4, 14))), "s") for i in range(n)]
    return rows + [(f"x{i:04d}", " ".join(sentence() for _ in range(20))[:limit], "s") for i in range(n // 8)]


def test_limits_and_broken_endings(spark):
    rng = random.Random(4)
    rows = corpus(rng, 240, 400)
    rows += [("ok1", rows[0][1][:-1], "s"), ("ok2", rows[1][1] + "\n\nYours sincerely", "s"), ("bad", rows[2][1] + " The old man carr", "t"), ("nul", None, "s"), ("x0000", rows[240][1], "s")]
    rows += [(f"c{i}", rows[i][1] + "\n\nYours sincerely", "s") for i in range(6)]
    df = spark.createDataFrame([(i, t, s, None, None) for i, t, s in rows], "essay_id string, text string, source string, model string, generation_config struct<max_tokens: int>").selectExpr("*", "1 AS kind", "2 AS letters")
    out = {r["essay_id"]: r for r in endings(df).collect()}
    cut = {i for i, t, _ in rows if i.startswith("x") and not t.rstrip().endswith(".")}
    found = {i for i, r in out.items() if r["broken"]}
    assert cut <= found and "bad" in found
    assert not found & {"ok1", "ok2", "nul", *(f"c{i}" for i in range(6))}
    assert len(found - cut - {"bad"}) <= 2
    assert out["x0000"]["at_limit"]
    assert endings(df.limit(0)).count() == 0


def test_hazards_without_limits(spark):
    rng = random.Random(5)
    rows = [("s", False, rng.randint(200, 900), str(i)) for i in range(600)]
    h = length_hazards(spark.createDataFrame(rows, "limiter string, per_token boolean, unit long, letters string"))
    assert h.where("significant").count() == 0
    rows += [("s", False, 500, f"k{i}") for i in range(30)]
    h = length_hazards(spark.createDataFrame(rows, "limiter string, per_token boolean, unit long, letters string"))
    assert [r["unit"] for r in h.where("significant").collect()] == [500]
