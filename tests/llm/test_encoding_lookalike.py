import pytest

from lectern.llm import encoding
from lectern.llm.encoding import garbling, restore
from lectern.llm.lookalike import canonical, same_look

GARBLED = [
    ("Sócleik’s “café” – naïve.", "utf-8", "cp1252"),
    ("Lüfiya’s résumé", "utf-8", "latin-1"),
    ("Nérigostonmoor’s chair", "utf-8", "mac_roman"),
    ("Glarefen spelled it pâté", "utf-8", "cp437"),
    ("«¡Espera!», gritó", "utf-8", "cp1251"),
    ("Мы жили на ул. Кираданград", "utf-8", "cp1252"),
    ("父はサガキネ村の辞書を買った。", "utf-8", "mac_roman"),
    ("Мы жили долго и думали про терпение", "cp1251", "cp1252"),
    ("Мы жили долго и думали", "koi8_r", "cp1251"),
    ("「待って！」と彼は叫んだ。", "shift_jis", "cp1252"),
]


def wrong(text, written, shown):
    out = []
    for b in text.encode(written):
        try:
            out.append(bytes([b]).decode(shown))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text,written,shown", GARBLED)
def test_found_and_restored(text, written, shown):
    g = wrong(text, written, shown)
    fixed, hit, left = restore("Plain words before. " + g)
    assert hit
    if written == "utf-8":
        assert fixed == "Plain words before. " + text and left == 0


def test_double_encoding():
    assert restore(wrong(wrong("Sóz’s", "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == "Sóz’s"


PLAIN = (
    "Größe und Füße: „schön“ – gesagt für Jürgen.", "L’été à la plage, c’est déjà fini – hélas…", "¿Qué pasó mañana? “Nada”, contestó él.",
    "Мы жили на ул. Лесной, д. 5, и я знал в чём дело.", "父は村の辞書を買った。「待って！」", "ฉันชอบอ่านหนังสือ", "قال د. سمير إن الوقت و المال", "मैं घर गया। वह आया था।",
)


@pytest.mark.parametrize("text", PLAIN)
@pytest.mark.parametrize("page", ["latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1253"])
def test_any_number_of_rounds_through_a_page_is_undone(text, page):
    garbled = text
    for n in range(5):
        garbled = wrong(garbled, "utf-8", page)
        assert restore(garbled) == (text, True, 0), n + 1


@pytest.mark.parametrize("pages", [("latin-1", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman", "cp437")])
def test_rounds_through_different_pages(pages):
    for text in PLAIN:
        garbled = text
        for p in pages:
            garbled = wrong(garbled, "utf-8", p)
        assert restore(garbled) == (text, True, 0)


def test_places_of_more_pages_than_rounds_were_once_allowed():
    pages = ("cp1252", "mac_roman", "cp437", "cp1251", "cp850", "cp1253")
    text = " and then ".join(wrong("façade déjà vécu", "utf-8", p) for p in pages)
    assert restore(text) == (" and then ".join(["façade déjà vécu"] * len(pages)), True, 0)


@pytest.mark.parametrize("text", [None, "", "  ", "ascii only", "a round-trip to SÃO Paulo", "the symbol Â stood for it, and Ã for that", "ordered CRÈME BRÛLÉE twice", "547 € or 682 £, ™ and all", "in Übung und À Paris « été »", "Мы в СССР» – сказал он", "Тhе рrоjесt аt Вахеhult", "цена 3 ₽ и №5"])
def test_intended_signs_stay(text):
    assert restore(text) == (text, False, 0)


def test_marks_of_typography_alone_are_never_garbled():
    marks = sorted(encoding.TYPOGRAPHY)
    near = ["", " ", "a", "A", ".", "!", "1"]
    texts = [x + a + y + b + z for a in marks for b in marks for x in near for y in near for z in near]
    assert not any(h.search(t) for h in encoding._HINTS.values() for t in texts)
    assert not any(encoding._ANY.search(t) for t in texts)


def test_signs_need_their_characters():
    """A sign is found in no text without one of the characters that it is said to need."""
    chars = [chr(c) for c in [*range(0x20, 0x2600), *range(0xFF00, 0xFFFF)]]
    for name, sign in encoding.SIGNS.items():
        rest = [c for c in chars if not encoding._NEEDS[name].match(c)]
        for a in "aZ 1я":
            text = "".join(f"{a}{c}{b} {c}{c}{c} {c}{c}{c}{c} " for c in rest for b in "aZ ")
            assert name in ("swapped_case", "no_vowels", "mixed_script") and a == "я" or not sign.search(text), name


def test_replacement_characters_are_found():
    assert restore("Pens� en la tristeza")[1:] == (True, 1)


def test_only_the_span_changes():
    assert restore("É certo, café and cafÃ©")[0] == "É certo, café and café"


def test_garbling_columns(spark):
    df = spark.createDataFrame([(1, "cafÃ©", "x"), (2, None, "y"), (3, "", "z")], "essay_id int, text string, restored string")
    rows = garbling(df).orderBy("essay_id").collect()
    assert [r["garbling"]["garbled"] for r in rows] == [True, False, False]
    assert rows[0]["garbling"]["restored"] == "café" and rows[0]["restored"] == "x"
    assert garbling(df.limit(0)).count() == 0


SAME = [
    ("Ａｂｃ １２", "Abc 12"), ("café", "café"), ("sym­bol​", "symbol"), ("a b c", "a b c"), ("Giﬁt", "Gifit"), ("Тhе рrоjесt", "The project"),
    ("ｶﾞｷ", "ガキ"), ("Αnna", "Anna"), ("ёlka", "ëlka"),
    ("άλλος ύπνος ίδιος ό", "α\u0301λλος υ\u0301πνος ι\u0301διος ο\u0301"), ("ў и й ѐ", "у\u0306 и и\u0306 е\u0300"), ("ά", "á"),
    ("ἄλλος ᾧ Ἀθῆναι", "α\u0313\u0301λλος ω\u0314\u0342\u0345 Α\u0313θη\u0342ναι"),
]
OTHER = [("a  b", "a b"), ("a\nb", "a b"), ("Abc", "abc"), ("cafe", "café"), ("a b.", "a b"), ("1", "2"), ("“a”", '"a"')]


def forms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r["i"]: r["form"] for r in canonical(df).collect()}


def test_forms(spark):
    f = forms(spark, [t for p in SAME + OTHER for t in p] + [None, ""])
    n = len(SAME)
    assert all(f[2 * i] == f[2 * i + 1] for i in range(n))
    assert all(f[2 * i] != f[2 * i + 1] for i in range(n, n + len(OTHER)))
    assert f[2 * (n + len(OTHER))] is None and f[2 * (n + len(OTHER)) + 1] == ""


def test_form_is_stable(spark):
    first = forms(spark, [t for p in SAME for t in p])
    assert forms(spark, [first[i] for i in sorted(first)]) == first


def test_pairs(spark):
    rows = [("c", "café x"), ("a", "café x"), ("b", "café x"), ("b", "café x"), ("d", "cafe x"), ("e", None), ("f", "  "), ("g", "  "), (None, "café x")]
    df = spark.createDataFrame(rows, "essay_id string, text string").selectExpr("essay_id", "text", "1 AS form", "2 AS look")
    assert {tuple(r) for r in same_look(df).collect()} == {("a", "b"), ("a", "c")}
    assert same_look(df.limit(0)).count() == 0


def test_a_look_that_many_share(spark):
    df = spark.createDataFrame([(f"x{i:04d}", "same words") for i in range(3000)] + [("y", "same words")], "essay_id string, text string")
    assert same_look(df).count() == 3000
