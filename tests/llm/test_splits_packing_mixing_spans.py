import random
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest

from lectern.llm import cross_split, fm_index, packing
from lectern.llm.components import components
from lectern.llm.cross_split import EVALUATION, lcs, least, overlaps, words
from lectern.llm.grouped_split import assign, broken_families, stratify
from lectern.llm.mixing import mixture, shares
from lectern.llm.shared_spans import shared_text

ESSAY = "essay_id string, original_essay_id string, split string, label string, text string"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for _ in range(80)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("z", "z"), ("hub", "a")] + [(f"h{i}", "hub") for i in range(200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == roots([], edges)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_families(spark):
    h = "hum-00000000"
    rows = [
        (h + "1", None, "train", "human", "t"), ("pol-000000001", f" {h.upper()}1 ", "val", "ai_polished", "t"), ("pol-000000002", "pol-000000001", "", "ai_polished", "t"),
        (h + "2", h + "2", "train", "human", "t"), ("pol-000000003", "hum-999999999", "train", "x", "t"), ("pol-000000004", "HUM-999999999", "test", "x", "t"), ("pol-000000004", "HUM-999999999", "test", "x", "t"),
        (h + "3", "N/A", "train", "human", "t"), (h + "4", "N/A", "val", "human", "t"), ("pol-000000005", h + "5", "val", "x", "t"), (h + "5", "pol-000000005", "train", "x", "  "), (None, h + "1", "test", "x", "t"),
    ]
    got = {tuple(r) for r in broken_families(spark.createDataFrame(rows, ESSAY).selectExpr("*", "1 AS node", "2 AS u", "3 AS component")).collect()}
    assert got == {(h + "1", h + "1"), ("pol-000000001", h + "1"), ("pol-000000002", h + "1"), ("pol-000000003", "pol-000000003"), ("pol-000000004", "pol-000000003"), ("pol-000000005", h + "5")}
    assert broken_families(spark.createDataFrame([], ESSAY)).count() == 0


def test_stratify_places_rare_labels_first():
    fam = [(f"f{i}", {"common": 3}) for i in range(60)] + [(f"r{i}", {"rare": 1, "common": 1}) for i in range(10)]
    goal = {"train": {"common": 133.0, "rare": 7.0}, "val": {"common": 28.5, "rare": 1.5}, "test": {"common": 28.5, "rare": 1.5}}
    where = stratify(fam, goal)
    n = {s: sum(v.get("rare", 0) for f, v in fam if where[f] == s) for s in goal}
    assert n["train"] == 7 and {n["val"], n["test"]} <= {1, 2} and len(where) == 70


def test_assign(spark):
    rng = random.Random(3)
    rows = [(f"hum-{i:09d}", f"hum-{rng.randint(0, i):09d}" if rng.random() < 0.2 else None, "train", rng.choice(["human", "ai_generated", None]), "t") for i in range(900)]
    out = assign(spark.createDataFrame(rows, ESSAY), shard=300).toPandas()
    assert len(out) == 900 and out.groupby("family_id").new_split.nunique().max() == 1
    share = out.new_split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["val"] - 0.15) < 0.02
    assert assign(spark.createDataFrame([], ESSAY)).count() == 0


def test_labels_of_any_number(spark):
    """Free text as label: every value is stratified on, none is left out."""
    rows = [(f"hum-{i:09d}", f"hum-{i // 40 * 40:09d}" if i % 40 and i < 400 else None, "train", f"label {i % 2500}", "t") for i in range(5000)]
    out = assign(spark.createDataFrame(rows, ESSAY), shard=700).toPandas()
    assert len(out) == 5000 and out.new_split.notna().all() and out.groupby("family_id").new_split.nunique().max() == 1
    assert abs((out.new_split == "train").mean() - 0.7) < 0.03


def test_one_family_holds_a_third(spark):
    rows = [(f"hum-{i:09d}", "hum-000000000" if i % 3 == 0 else None, "train" if i % 2 else "val", "human", "t") for i in range(3000)]
    df = spark.createDataFrame(rows, ESSAY)
    assert broken_families(df).count() == 1000
    assert assign(df).groupBy("family_id").agg({"new_split": "count"}).count() == 2001


# --- overlap ---------------------------------------------------------------------------------------------------------------


def test_lcs():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert lcs(a, b) == d[-1][-1]


def test_overlaps_are_all_found(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 60))]
        rows.append((f"t{i}", " ".join(base), "train", "s"))
        for j in range(2):
            edited = [w for w in base if rng.random() > rng.choice([0.0, 0.1, 0.2])]
            edited = [rng.choice(vocabulary) if rng.random() < rng.choice([0.0, 0.1, 0.2]) else w for w in edited]
            rows.append((f"v{i}_{j}", " ".join(edited).upper() + "!", rng.choice(EVALUATION), "s"))
    rows += [("z1", None, "train", "s"), ("z2", "  ", "val", "s"), ("z3", "...", "val", "s"), ("z4", "w1 w2", "", "s"), rows[0], ("same", rows[0][1], "train", "s"), ("jp1", "父は古い本を読んだ。", "train", "s"), ("jp2", "父は古い本を読んだ！", "val", "s")]
    df = spark.createDataFrame(rows, "essay_id string, text string, split string, source string").selectExpr("*", "NULL AS model", "1 AS words", "2 AS form")
    got = {(r["train_id"], r["eval_id"]) for r in overlaps(df).collect()}
    side = {s: {i: words(t) for i, t, x, _ in rows if t and (x == "train") == s and x} for s in (True, False)}
    want = {(a, b) for a, x in side[True].items() for b, y in side[False].items() if x and y and lcs(x, y) >= least(max(len(x), len(y)))}
    assert got == want and len(want) > 40
    assert {(r["train_id"], r["eval_id"]) for r in overlaps(df, per_salt=2).collect()} == got  # hot words dealt over salts
    assert overlaps(df.limit(0)).count() == 0


def _worn(rng, n, least_words, most_words):
    """Pairs of a text of a worn-out vocabulary and an edited copy of it, as lists of numbers."""
    weights = [1 / (i + 3) for i in range(250)]
    for _ in range(n):
        base = rng.choices(range(250), weights, k=rng.randint(least_words, most_words))
        keep = rng.choice([1.0, 0.9, 0.85])
        yield base, [w if rng.random() > 0.05 else rng.randrange(250) for w in base if rng.random() < keep]


@pytest.mark.parametrize("lengths", [(2, 40), (90, 160), (480, 560)])
def test_frequent_words_meet_in_pairs(lengths):
    """All that overlaps meets and passes the parities, at both levels of a length; few others do, though every word is in many texts."""
    rng = random.Random(5)
    texts = [x for p in _worn(rng, 60, *lengths) for x in p if x]
    n = np.array([len(x) for x in texts])
    of, toks = cross_split.tokens(np.array([w for x in texts for w in x], np.int64) * 0x123456789ABCDE7, n)
    counts = np.bincount(toks & (1 << cross_split.SKETCH_BITS) - 1, minlength=1 << cross_split.SKETCH_BITS)

    def at(level):
        t, k, seen = cross_split.keys(of, toks, n, level, counts, 3)
        assert (seen <= len(texts)).all()
        return [set(k[t == i].tolist()) for i in range(len(n))], cross_split.parities(of, toks, level)

    own = cross_split._level(n)
    sides = {d: at(np.maximum(own + d, 0)) for d in (-1, 0, 1)}
    met = others = passed = 0
    for i, j in permutations(range(len(n)), 2):
        t = least(max(n[i], n[j]))
        if min(n[i], n[j]) < max(t, 2):
            continue
        keys, flips = sides[own[j] - own[i]]  # i probes at the level of j
        meets = bool(keys[i] & sides[0][0][j])
        same_bits = int(np.bitwise_count((flips[i] ^ sides[0][1][j]).view(np.uint64)).sum()) <= n[i] + n[j] - 2 * t
        if lcs(texts[i], texts[j]) >= t:
            assert meets and same_bits
            met += 1
        elif (Counter(texts[i]) & Counter(texts[j])).total() * 5 < 3 * max(n[i], n[j]):
            others += 1
            passed += meets and same_bits
    assert met > 20 and passed * 20 <= others


def test_alike_is_the_longest_common_subsequence():
    """With repeated, edited and shuffled words; a programme that cannot come to enough stops."""
    rng = random.Random(3)
    for a, b in _worn(rng, 400, 1, 80):
        b = rng.sample(b, len(b)) if rng.random() < 0.2 else b
        whole, need = lcs(a, b), least(max(len(a), len(b)))
        assert cross_split.alike(np.array(a, np.int64), np.array(b, np.int64)) == (whole >= need)
        assert all((lcs(a, b, k) >= k) == (whole >= k) for k in range(1, len(a) + 2))
    assert lcs([*range(200)], [*range(300, 400), *range(100, 200)], 160) == 0  # the second half is not read


def test_overlaps_of_a_worn_vocabulary(spark):
    """Every word is frequent and dealt over salts; the pairs are those of brute force."""
    rng = random.Random(9)
    rows = []
    for i, (a, b) in enumerate(_worn(rng, 70, 2, 150)):
        rows += [(f"t{i}", " ".join(f"w{w}" for w in a), "train"), (f"v{i}", " ".join(f"w{w}" for w in b), "val")]
    df = spark.createDataFrame(rows, "essay_id string, text string, split string").selectExpr("*", "'s' AS source", "NULL AS model")
    side = {s: {i: words(t) for i, t, x in rows if x == s and t} for s in ("train", "val")}
    want = {(a, b) for a, x in side["train"].items() for b, y in side["val"].items() if lcs(x, y) >= least(max(len(x), len(y)))}
    assert len(want) > 20
    assert {(r["train_id"], r["eval_id"]) for r in overlaps(df, per_salt=3, frequent=2).collect()} == want


def test_overlaps_apart_from_case_of_any_script(spark):
    """Copies made here, so nothing is asked of words()."""
    texts = {
        "ru": "Мой сосед Сабарин живёт в новом доме у реки, но вот там нет тепла и ему тяжело",
        "el": "Ήταν μια νύχτα γεμάτη αστέρια και ο Νίκος έγραφε στην Ύδρα για τους φίλους του",
        "de": "Die Straße lag weiß und groß vor dem Fluß, dreißig Füße tief floß er heiß vorbei",
        "ce": "Ӏуьйре хьалхе гӀуллакх дика ду цӀа вогӀу нохчийн мотт хӀара стаг",
    }
    bare = {"el": "Ηταν μια νυχτα γεματη αστερια και ο Νικος εγραφε στην Υδρα για τους φιλους του"}
    spoof = "Νobody Κnew Τhe Нouse Вy Мy Тown Νor Ηow Υou Κeep Ιt"
    plain = "Nobody Knew The House By My Town Nor How You Keep It"
    other = "vobody knew the house by my town vor how uou keep it"
    rows = [(f"{k}0", t, "train") for k, t in texts.items()] + [(f"{k}1", t.upper(), "val") for k, t in texts.items()] + [(f"{k}2", t.upper(), "test") for k, t in bare.items()]
    rows += [("x0", spoof, "train"), ("x1", plain.lower(), "val"), ("x2", "never vine nine never vine nine vat", "train"), ("x3", "vever nine vine vever nine vine nat", "val"), ("x4", other, "test")]
    df = spark.createDataFrame(rows, "essay_id string, text string, split string").selectExpr("*", "'s' AS source", "NULL AS model")
    got = {(r["train_id"], r["eval_id"]) for r in overlaps(df).collect()}
    assert got == {(f"{k}0", f"{k}1") for k in texts} | {("el0", "el2"), ("x0", "x1")}


# --- packing and mixing ----------------------------------------------------------------------------------------------------------


def test_pack_keeps_items_whole_and_is_tight():
    rng = random.Random(2)
    for cap in (10, 100, 512):
        sizes = [rng.randint(1, cap) for _ in range(400)]
        bins, first = packing.pack(sizes, cap)
        for found in (bins, first):
            assert sorted(i for b in found for i in b) == list(range(400))
            assert max(sum(sizes[i] for i in b) for b in found) <= cap
        assert len(bins) < len(first)
    assert packing.pack([], 5) == ([], []) and packing.pack([5, 5], 5)[0] == [[0], [1]]
    assert len(packing.local_search([3, 3, 2, 2], [[0], [1], [2], [3]], 5)) == 2


def test_first_fit_is_the_first_container_with_room():
    rng = random.Random(4)
    for n in (0, 1, 2, 33, 200):
        sizes = [rng.randint(1, 50) for _ in range(n)]
        plain: list[list[int]] = []
        for i, s in enumerate(sizes):
            k = next((k for k, b in enumerate(plain) if sum(sizes[x] for x in b) + s <= 50), None)
            plain.append([i]) if k is None else plain[k].append(i)
        assert packing.first_fit(sizes, 50) == plain


def test_search_empties_containers_and_leaves_no_step():
    """The rows come from the search: it removes containers of the plain fill, and brute force finds no step it left."""
    rng = random.Random(6)
    sizes = [rng.randint(1, 60) for _ in range(120)]
    search = packing.LocalSearch(sizes, [[i] for i in range(120)], 100)
    out = search.run()
    fills = [sum(sizes[i] for i in b) for b in out]
    assert len(out) <= -(-sum(sizes) // 100) + 2 and {(1, 0), (1, 1)} <= set(search.steps)
    some = lambda b, none: [(), *((i,) for i in b), *combinations(b, 2)][0 if none else 1 :]
    total = lambda ids: sum(sizes[i] for i in ids)
    for (a, f), (b, g) in permutations(zip(out, fills), 2):
        for x in some(a, False):
            for y in some(b, True):
                d = total(x) - total(y)
                assert not (0 < d <= 100 - g and g + d > f), "a step that raises the squared fill is left"


def test_all_partners_are_considered():
    """Only the last of many underfull containers can take the document."""
    sizes = [99] * 200 + [97] + [3]
    assert len(packing.local_search(sizes, [[i] for i in range(202)], 100)) == 201


def test_sizes_of_texts_with_long_runs_are_the_tokenizers_own():
    from lectern.llm.tokenizers import byte_bpe, count_tokens

    enc = byte_bpe()
    text = "alpha beta gamma delta " * 600 + "漢字、" * 1400 + " and more"
    assert count_tokens(text, enc) == len(enc.encode_ordinary("alpha beta gamma delta " * 600)) - 1 + len(enc.encode_ordinary(" " + "漢字、" * 1400 + " and more"))


DOC = "doc_id long, text string, source string"


def docs(spark, n=300, hot=True):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 400))), rng.choice(["a", "A ", "b", "c", None]) if not hot or i % 3 else "a") for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "a"), (n + 1, "", "b")], DOC)


def test_containers(spark):
    s = spark.createDataFrame([(1, 128), (2, 1024), (3, None), (4, 0), (1, 128)], "setting_id int, capacity_tokens int")
    df = docs(spark).selectExpr("*", "1 AS shard", "2 AS n_tokens")
    p = packing.containers(df, s, shard=100).toPandas()
    cap = {1: 128, 2: 1024}
    assert set(p.setting_id) == set(cap)
    fill = p.groupby(["setting_id", "container"]).n_tokens.sum()
    assert all(v <= cap[k[0]] for k, v in fill.items())
    whole = p.groupby(["setting_id", "doc_id"]).agg(total=("n_tokens", "sum"), pieces=("piece", "count"))
    assert whole.total.xs(1).equals(whole.total.xs(2)) and 300 not in whole.total.xs(1).index
    assert all(n == -(-t // cap[k[0]]) for k, (t, n) in zip(whole.index, whole.to_numpy()))
    begun = p.groupby("setting_id").first_container.nunique()
    assert all(p.groupby("setting_id").container.nunique() <= begun) and p.container.nunique() < p.first_container.nunique()
    assert packing.containers(df.limit(0), s).count() == 0
    assert packing.fill_report(packing.containers(df, s), s).count() == 2


TARGET = "source string, target_share double, max_repeats int"


def test_mixture(spark):
    t = spark.createDataFrame([("A", 0.5, 1), ("b ", 0.3, 4), ("c", 0.1, 1), ("none", 0.1, 3), (None, 0.1, 1)], TARGET)
    df = docs(spark).selectExpr("*", "1 AS key", "2 AS bucket", "3 AS budget")
    r = {x["source"]: x for x in shares(df, t, total=20000).collect()}
    assert set(r) == {"a", "b", "c", "none"} and r["none"]["tokens"] == 0
    for k in ("a", "b", "c"):
        assert abs(r[k]["tokens"] - min(r[k]["target_share"] * 20000, r[k]["available"] * r[k]["max_repeats"])) <= 400
        assert r[k]["most_repeats"] <= r[k]["max_repeats"]
    assert sum(x["actual_share"] for x in r.values()) == pytest.approx(1.0)
    m = mixture(df, t, total=20000)
    assert {x["doc_id"] for x in m.collect()} == {x["doc_id"] for x in mixture(df, t, total=20000).collect()}
    assert m.where("repeats < 1 OR n_tokens < 1").count() == 0
    assert mixture(df.limit(0), t).count() == 0 and mixture(df, t.limit(0)).count() == 0


# --- shared spans ------------------------------------------------------------------------------------------------------------------


def brute_matching(segs, owners, several, most):
    out = []
    for s in segs:
        for i in range(len(s)):
            n = 0
            for k in range(1, min(most, len(s) - i) + 1):
                having = [y for y, z in enumerate(segs) if s[i : i + k] in z]
                if len({owners[y] for y in having}) < 2 and not any(several[y] for y in having):
                    break
                n = k
            out.append(n)
    return out


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(40):
        base = "".join(rng.choice("abcd") for _ in range(60))
        segs = [base[(a := rng.randint(0, 40)) : a + rng.randint(1, 20)] + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(1, 6))]
        owners, several, most = [rng.randint(0, 3) for _ in segs], [rng.random() < 0.1 for _ in segs], rng.choice([4, 7, 12])
        ix = fm_index.SharedIndex([np.array([ord(c) for c in s], np.uint32) for s in segs], np.array(owners), np.array(several), most)
        m = ix.matching()
        assert [int(m[a + i]) for a, n in zip(ix.starts, ix.lens) for i in range(n)] == brute_matching(segs, owners, several, most)


def covered(rows, least_):
    seen, many = {}, set()
    for i, t in rows:
        for j in range(len(t or "") - least_ + 1):
            g = t[j : j + least_]
            if seen.setdefault(g, i) != i:
                many.add(g)
    out = {}
    for i, t in rows:
        hit = bytearray(len(t or ""))
        for j in range(len(t or "") - least_ + 1):
            if t[j : j + least_] in many:
                hit[j : j + least_] = b"\1" * least_
        out[i] = sum(hit)
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop é日本語"])
def test_shared_text(spark, alphabet):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(rng.randint(140, 400)) for _ in range(6)]
    rows = [(i, word(rng.randint(0, 300)) + rng.choice(passages)[rng.randint(0, 40) :] + word(rng.randint(0, 200))) for i in range(40)]
    own = word(200)
    rows += [(100, own + own), (101, None), (102, ""), (103, word(149)), (104, passages[0][:149]), (105, rows[0][1]), (106, "loop " * 100), (107, "x" + "loop " * 60)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").selectExpr("*", "1 AS route", "2 AS segment", "3 AS digest")
    got = {r["doc_id"]: r["shared_chars"] for r in shared_text(df).collect()}
    assert got == covered(rows, 150)
    assert shared_text(df.limit(0)).count() == 0


def test_hot_passage_is_split(spark, monkeypatch):
    from lectern.llm import shared_spans

    monkeypatch.setattr(shared_spans, "HOT", 5)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(200)
    rows = [(i, word(rng.randint(0, 90)) + passage[rng.randint(0, 60) : 200 - rng.randint(0, 20)] + word(rng.randint(0, 90))) for i in range(60)]
    got = {r["doc_id"]: r["shared_chars"] for r in shared_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == covered(rows, 150)


def test_hot_passage_meets_across_cut_blocks(spark, monkeypatch):
    """Pairs that share a few characters more than a hot passage, one document beginning with it and the other ending with it or not."""
    from lectern.llm import shared_spans

    monkeypatch.setattr(shared_spans, "HOT", 5)
    monkeypatch.setattr(shared_spans, "SHARD_CHARS", 500)
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(146)
    rows = [(i, word(rng.randint(20, 90)) + passage + word(rng.randint(20, 90))) for i in range(40)]
    for i in range(20):
        own = word(rng.randint(5, 20))
        rows += [(100 + i, passage + own + word(rng.choice([0, 60]))), (200 + i, word(rng.randint(20, 90)) + passage + own + word(rng.choice([0, 60])))]
    got = {r["doc_id"]: r["shared_chars"] for r in shared_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == covered(rows, 150)


def test_overlaps_broadcast_and_collect_nothing_that_grows(spark, monkeypatch):
    """Tables that are sized far too low are not broadcast, and the counts reach the driver as a few packed blocks."""
    seen = []
    real = cross_split.cut

    def spy(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(cross_split, "cut", spy)
    texts = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(30)) for i in range(40)]
    rows = [(f"e{i}", t, "train" if i % 2 else "test", "s", None) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        o = overlaps(spark.createDataFrame(rows, "essay_id string, text string, split string, source string, model string"))
        plans = [*seen, o._jdf.queryExecution().executedPlan().toString()]
        assert all("BroadcastHashJoin" not in x for x in plans)
        assert sum(x.count("SortMergeJoin") for x in plans) >= 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    words_ = [[1, 2, 2, 3], [2, 3, 1 << 40]]
    counts = cross_split._counts(spark.createDataFrame([(w,) for w in words_], "words array<long>").repartition(2))
    of, toks = cross_split.tokens(np.array(sum(words_, []), np.int64), np.array([4, 3]))
    assert counts.dtype == np.int32 and counts.tolist() == np.bincount(toks & (1 << cross_split.SKETCH_BITS) - 1, minlength=1 << cross_split.SKETCH_BITS).tolist()
    got = []
    frame = type(spark.range(1))
    for name in ("collect", "toPandas"):
        f = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, *a, _f=f: got.append(_f(self, *a)) or got[-1])
    wide = spark.range(200).selectExpr("transform(sequence(0, 499), x -> xxhash64(id, x) & 9223372036854775807) AS words")
    cross_split._counts(wide)
    assert sum(map(len, got)) <= (1 << cross_split.SKETCH_BITS) // 4096
