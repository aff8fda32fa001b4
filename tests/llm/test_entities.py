import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

names = pytest.importorskip("wardline.llm.names")
from wardline.llm import linkage, matching, places, trie, variants  # noqa: E402
from wardline.llm.components import components  # noqa: E402

ROW = "key string, block string, name string, town string, phone string, addresses array<string>, postal string, lat double, lon double, beds array<int>, size int"


def levenshtein(a, b):
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
        old = new
    return old[-1]


def test_trie_join_equals_brute_force():
    r = random.Random(1)
    words = list({"".join(r.choices("abcd", k=r.randint(0, 7))) for _ in range(150)})
    entries = [(w, i) for i, w in enumerate(words)]
    for bound in range(4):
        got = {(a, b): d for a, b, d in trie.trie_join(entries, entries, bound)}
        assert got == {(i, j): d for (x, i), (y, j) in itertools.product(entries, entries) if (d := levenshtein(x, y)) <= bound}


def any_kind(a, b):
    return F.lit(True)


def edit_form(bound):
    return lambda w: [trie.Form("w", w, bound, bound)]


def test_cut_shards_equal_whole_ones(spark):
    r = random.Random(2)
    words = {(b, "".join(r.choices("abc", k=r.randint(1, 6)))) for b in "xxxy" for _ in range(60)} | {("x", "q" * 5000), ("x", "q" * 4999)}
    left = spark.createDataFrame([(b, f"l{i}", w, "") for i, (b, w) in enumerate(sorted(words))], "shard string, key string, word string, kind string")
    right = spark.createDataFrame([(b, f"r{i}", w, "") for i, (b, w) in enumerate(sorted(words)) if i % 3], "shard string, key string, word string, kind string")
    rows = [(b, f"l{i}", w) for i, (b, w) in enumerate(sorted(words))]
    for bound in (1, 2):
        near = {(x[1], y[1]): d for x in rows for y in rows if x[0] == y[0] and abs(len(x[2]) - len(y[2])) <= bound and (len(x[2]) < 9 or x[2][0] == y[2][0] == "q") and (d := levenshtein(x[2], y[2]) if len(x[2]) < 9 else len({x[2], y[2]}) - 1) <= bound}
        for part in (10_000, 30, 4):
            get = lambda a, b: {(x.key_a, x.key_b): x.e for x in trie.near_rows(a, b, edit_form(bound), lambda k, l: True, any_kind, part).groupBy("key_a", "key_b").agg(F.min("edits").alias("e")).collect()}  # noqa: B023, E731
            assert get(left, None) == {k: d for k, d in near.items() if k[0] < k[1]}
            assert get(left, right) == {(k, "r" + l[1:]): d for (k, l), d in near.items() if int(l[1:]) % 3}
    assert trie.near_rows(left.where("false"), right, edit_form(1), lambda k, l: True, any_kind).count() == 0


def test_rows_sent_grow_with_the_names_of_a_town(spark):
    """Twice the names of one town are twice the pieces, and each piece is met once."""
    sent = lambda n: sum(len(lie | ask) for i in range(n) for lie, ask in [trie.cuts(variants.spellings(chr(0xAC00 + i) + chr(0xAC00 + i * 7 % 11172) + "가"))])
    assert sent(400) < 2.2 * sent(200)


def test_words_that_are_near_could_meet():
    r = random.Random(11)
    words = sorted({"".join(r.choices("가나다라마바사", k=r.randint(1, 4))) for _ in range(80)} | {"gana", "dara", "nagada"})
    for forms in (variants.spellings, variants.wide_spellings):
        letters = {w: trie.bags(forms(w)) for w in words}
        near = trie.near_words(forms, words)
        could = {(a, b) for a in words for b in words if trie.could_meet(letters[a], letters[b])}
        assert near.keys() <= could and len(could) < len(words) ** 2


def test_what_does_not_ask_is_found_by_asking_rows_of_either_side():
    forms = lambda w: [trie.Form("r", w.lower(), 1, 1, w.islower())]
    assert trie.near_words(forms, ["AB", "abc"], ["ab", "ABC"]) == {("AB", "ab"): 0, ("abc", "ab"): 1, ("abc", "ABC"): 0}
    assert trie.near_words(forms, ["AB", "AC"]) == {}


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2"), ("z2", "z2"), ("z9", None)] + [(f"s{i}", "s0") for i in range(50)]
    got = {r.node: r.class_id for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and {got["z1"], got["z2"]} == {"z1"} and {got[f"s{i}"] for i in range(50)} == {"s0"} and "z9" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(chain, "a string, b string"), rounds=1)


def test_readings():
    for name in ("가람 나다라 종합병원", "나다라종합병원 (가람)", "의료법인 마바의료재단 나다라종합병원", "나다라종합", "나​다라존합병원", "종합병원 나다라", "Nadara General Hospital", "skekfkwhdgkqquddnjs", "나다라 종합병원 [의료법인 사의료재단]", "나다다라종합병원 응급실"):
        core, kind = names.parse(name, "가람")[0]
        assert (core, kind) in {("나다라", "general"), ("nadara", "general")}, name
    assert names.parse(None) == names.parse("") == names.parse(" ()") == []
    assert names.from_keyboard("dksgo") == "안해" and names.from_keyboard("Maraju") is None
    assert names.parse("x" * 100_000) and names.parse("가" * 20_000 + "병원")
    assert ("수초", "orthopedic clinic") in names.parse("수초정형외과의원") and ("sucho", "orthopedic clinic") in names.parse("Sucho정형외과의원")
    assert {k for _, k in names.parse("샘정태병원")} == {"hospital", "university", "orthopedic hospital"}  # every kind within reach of a misspelt ending
    assert names.parse("가나요양병원") == [("가나", "convalescent")] and ("가나대", "hospital") in names.parse("가나대병원")
    assert names.distance("abcd", "abdc", 2) == 1 and names.distance("abc", "xyz", 2) == 3


def test_place_keys():
    for a in ("한울도 가람시 들마루로 16번길 101", "가람시 들마루로16 101 (물가동)", "한울도 가람시 물가동 들마루로16101", "한울도 가람시 들마루로16번 길101 2층 응급실"):
        assert places.road_key(a) == "들마루로16101"
    assert places.road_key("가람시 물가동") is None and places.road_key(None) is None
    assert places.lot_key("한울도 가람시 물가동 17-3번지") == "물가동 17-3" and places.lot_key("가람시 물가동 들마루로 3") is None
    assert {places.phone_key(p) for p in ("081-224-1903", "+82-81-224-1903", "224 1903", "0812241903")} == {"2241903"} and places.phone_key("119") is None


def rows(spark, data):
    base = dict(block="b", town="가람", phone=None, addresses=[None, None], postal=None, lat=None, lon=None, beds=[None, None, None], size=None)
    return spark.createDataFrame([tuple((base | dict(key=k) | v)[c.split()[0]] for c in ROW.split(", ")) for k, v in data], ROW)


HOUSE = dict(name="나다라종합병원", phone="081-224-1903", addresses=["가람시 들마루로 16번길 101"], lat=35.0, lon=127.0)


def test_variants_link_and_keep_apart(spark):
    data = [
        ("1", HOUSE),
        ("2", HOUSE | dict(name="Nadara General Hospital", addresses=None, phone="2241903")),
        ("3", HOUSE | dict(name="나라다종합", phone=None, lat=35.0001)),
        ("4", HOUSE | dict(name="나다라종합병원")),
        ("5", HOUSE | dict(name="나다라요양병원", phone="999-9999")),  # another kind at the address
        ("6", HOUSE | dict(phone="888-8888", addresses=["가람시 먼길 9"], lat=35.2)),  # the name at another place
        ("7", HOUSE | dict(block="other")),
        ("8", HOUSE | dict(name=None)),
        ("9", dict(name="나다라종합병원")),  # nothing about its place
        ("4", HOUSE | dict(name="나다라종합병원")),
    ]
    df = rows(spark, data).withColumn("class_id", F.lit("clash")).withColumn("token", F.lit("clash"))
    classes = {r.key: r.class_id for r in variants.variant_classes(df).collect()}
    assert classes == {k: "1" for k in "1234"}
    pairs = {(r.node_a, r.node_b) for r in variants.variant_pairs(variants.variant_classes(df), df.select("key", "name")).collect()}
    assert pairs == {("1", "2"), ("1", "3"), ("2", "3"), ("2", "4"), ("3", "4")}
    assert variants.variant_classes(df.where("false")).count() == 0


def test_a_crowd_of_equal_rows_is_linked_by_a_star(spark):
    df = rows(spark, [(f"k{i:03d}", HOUSE) for i in range(120)])
    links = variants.candidate_links(places.folded(df))
    assert links.count() == 119
    assert variants.variant_classes(df).select("class_id").distinct().count() == 1


def test_rows_of_one_name_are_compared_though_their_head_differs(spark):
    bed = dict(name="나다라종합병원", beds=[3, 4, None])
    data = [
        ("1", bed | dict(phone="888-8888", addresses=["가람시 먼길 9"], postal="11111")),  # another house, but of the same bed token
        ("2", bed | dict(phone="081-224-1903", postal="22222")),
        ("3", bed | dict(phone="999-9999", postal="22222")),  # links to 2 by beds and postal code only
        ("4", bed | dict(phone="081-224-1903", postal="22222")),
        ("5", bed | dict(name=None)),
    ]
    assert {r.key: r.class_id for r in variants.variant_classes(rows(spark, data)).collect()} == {k: "2" for k in "234"}


def test_every_pair_whose_position_counts_is_a_candidate(spark):
    near = dict(name="나다라종합병원", lat=35.0, lon=127.0)
    data = []
    for i in range(24):  # pairs 0.11 km apart, wherever the grid lies and whatever the latitude
        lat, lon = 33.0 + i * 0.41337, 126.0 + i * 0.07773
        away = 0.11 / 111.19
        data += [(f"{i:02d}a", near | dict(block=f"b{i}", lat=lat, lon=lon)), (f"{i:02d}b", near | dict(block=f"b{i}", lat=lat + away * (i % 2), lon=lon + away * (1 - i % 2) / math.cos(math.radians(lat))))]
    data += [("p1", dict(name="나다라종합병원", block="p", postal="11111")), ("p2", dict(name="나다라종합병원", block="p", postal="11111"))]
    got = {r.key: r.class_id for r in variants.variant_classes(rows(spark, data)).collect()}
    assert got == {k: k[:2] + "a" for k, _ in data[:-2]} | {"p1": "p1", "p2": "p1"}


def test_crowded_tokens_are_cut(spark, monkeypatch):
    data = [(f"k{i:02d}", HOUSE | dict(name="나다라종합병원" if i % 2 else "나다마종합병원", lat=35.0 + i * 1e-6)) for i in range(30)]
    pairs = lambda: {(r.key_a, r.key_b) for r in variants.candidate_links(places.folded(rows(spark, data))).collect()}
    whole = pairs()
    near = trie.near_rows
    monkeypatch.setattr(variants, "near_rows", lambda *a: near(*a[:5], 4))
    assert pairs() == whole == set(itertools.combinations([k for k, _ in data], 2))


SYLLABLES = "가나다라마바사자차카타파하거너더러머버서저처커터퍼허고노도로모보소조초코토포호"


def variants_of(core, r):
    """By class of typing error: another spelling of the name of a general hospital."""
    letters = names.spelled(core)
    i = r.randrange(len(core))
    turned = core[1:] + core[0]
    keys = {v: k for k, v in names.KEYS.items()}
    wrong = chr(ord(core[i]) + 28 * r.choice((1, 4)))  # another vowel
    typed = "".join(keys[x] for x in letters)
    return {
        "vowel": core[:i] + wrong + core[i + 1 :] + "종합병원",
        "lost syllable": core[:i] + core[i + 1 :] + "종합병원",
        "doubled syllable": core[: i + 1] + core[i:] + "종합병원",
        "order": turned + "종합병원",
        "order and vowel": turned[:2] + chr(ord(turned[2]) + 28) + "종합병원",
        "kind first": "종합병원 " + core,
        "abbreviated": core + "종병",
        "misspelt kind": core + "종합병월",
        "legal entity": "의료법인 나누의료재단 " + core + "종합병원",
        "transcribed": names.romanized(core).capitalize() + " General Hospital",
        "keyboard": typed + "종합병원",
        "spaced": " ".join(core) + " 종합 병원",
    }


def test_recall_by_class_of_typing_error(spark):
    r, data, classes = random.Random(5), [], {}
    for n in range(60):
        core = "".join(r.sample(SYLLABLES, 3))
        at = dict(phone=f"081-{100 + n}-{1000 + n}", addresses=[f"가람시 들마루로 {n + 1}"])
        data.append((f"{n:02d}", at | dict(name=core + "종합병원")))
        for label, name in variants_of(core, r).items():
            data.append((f"{n:02d} {label}", at | dict(name=name)))
            classes.setdefault(label, []).append(f"{n:02d}")
    got = {x.key: x.class_id for x in variants.variant_classes(rows(spark, data)).collect()}
    recall = {label: sum(got.get(f"{n} {label}") == n for n in found) / len(found) for label, found in classes.items()}
    assert min(recall.values()) >= 0.95, recall
    assert len(set(got.values())) == 60


def test_a_stated_name_is_a_further_reading_of_the_own_kind():
    assert places.readings_of("하사 병원", None, "하서별병원")[-1] == ("하서별", "hospital")
    assert places.readings_of("하사 병원", None, "하서별의원") == places.readings_of("하사 병원", None, None)
    assert places.readings_of(None, None, "하서별의원") == []


def exact_marginals(cands):
    """By enumeration over all assignments: a left node has one record, a record any friends or one rival."""
    total, each = 0.0, [0.0] * len(cands)
    for picks in itertools.product((0, 1), repeat=len(cands)):
        on = [c for c, p in zip(cands, picks) if p]
        if len({c[0] for c in on}) < len(on) or any(c[3] and sum(d[1] == c[1] for d in on) > 1 for c in on):
            continue
        weight = math.exp(sum(c[2] for c in on))
        total += weight
        each = [e + weight * p for e, p in zip(each, picks)]
    return [e / total for e in each]


CANDIDATES = "left string, right string, log_odds double, rival boolean"


def test_beliefs_are_exact_on_a_tree(spark):
    cands = [("a", "x", 1.0, False), ("a", "y", 0.5, False), ("b", "y", 2.0, True), ("c", "y", 0.7, True), ("d", "y", 1.5, False), ("d", "w", 1.0, True), ("e", "z", -1.0, False), ("f", "v", 700.0, False), ("f", "u", -700.0, True)]
    got = {(r.left, r.right): r.confidence for r in matching.beliefs(spark.createDataFrame(cands, CANDIDATES), settled=1e-9).collect()}
    tree = [c for c in cands if c[0] != "f"]
    for c, want in zip(tree, exact_marginals(tree)):
        assert abs(got[c[0], c[1]] - want) < 1e-6
    assert got["f", "v"] > 0.999 and got["f", "u"] < 0.001
    assert matching.beliefs(spark.createDataFrame([], CANDIDATES)).count() == 0


def test_beliefs_settle_on_loops_or_raise(spark):
    crowd = [(f"l{i}", f"r{j}", 3.0 if i == j else 2.5, (i + j) % 2 == 1) for i in range(8) for j in range(8)]
    df = spark.createDataFrame(crowd, CANDIDATES)
    assert matching.beliefs(df).count() == 64
    with pytest.raises(RuntimeError):
        matching.beliefs(df, rounds=2)


def test_messages_decide_where_odds_alone_mistake(spark):
    """A name that two records bear: who has no better record gets the one that is left."""
    cands = [("sure", "r1", 6.0, False), ("open", "r1", 1.0, True), ("open", "r2", 0.8, False)]
    got = {(r.left, r.right): r.confidence for r in matching.beliefs(spark.createDataFrame(cands, CANDIDATES)).collect()}
    assert got["open", "r2"] > 0.5 > got["open", "r1"]


def test_weights_are_recovered(spark):
    r = random.Random(7)
    fields = (linkage.Field("x", (0.5, 0.5), (0.9, 0.1)), linkage.Field("y", (0.4, 0.6), (0.8, 0.2)), linkage.Field("z", (0.5, 0.5), (0.8, 0.2)))
    data = []
    for _ in range(20_000):
        m = r.random() < 0.2
        level = lambda p, q: None if r.random() < 0.2 else int(r.random() < (p if m else q))  # noqa: B023, E731
        data.append((level(0.9, 0.02), level(0.8, 0.1), level(0.95, 0.3)))
    got = linkage.fit(spark.createDataFrame(data, "x int, y int, z int"), fields)
    for name, (p, q) in dict(x=(0.9, 0.02), y=(0.8, 0.1), z=(0.95, 0.3)).items():
        assert abs(got.levels[name][1] - math.log(p / q)) < 0.25 and abs(got.levels[name][0] - math.log((1 - p) / (1 - q))) < 0.6
    assert abs(1 / (1 + math.exp(-got.prior)) - 0.2) < 0.03
    empty = linkage.fit(spark.createDataFrame([], "x int, y int, z int"), fields)
    assert abs(empty.levels["x"][1] - math.log(0.5 / 0.1)) < 1e-6


def test_match(spark):
    register = rows(spark, [("R1", HOUSE | dict(size=300)), ("R2", HOUSE | dict(name="마바사의원", phone="081-555-1234", addresses=["가람시 꽃길 7"], lat=35.1)), ("R3", dict(name=None)), ("R1", HOUSE | dict(size=300))])
    source = rows(spark, [("s1", HOUSE | dict(name="나다라 종합", size=302)), ("s2", dict(name="Mabasa Clinic", phone="5551234")), ("s3", HOUSE | dict(name="하하하병원")), ("s4", dict(name=None)), ("s5", dict(name="나다라종합병원", phone="777-7777"))])
    got = {r.key: (r.record, r.confidence) for r in matching.match(source, register).collect()}
    assert got["s1"][0] == "R1" and got["s1"][1] > 0.9 and got["s2"][0] == "R2" and got["s2"][1] > 0.5
    assert "s3" not in got and "s4" not in got and got["s5"][1] < got["s1"][1]
    assert matching.match(source.where("false"), register).count() == 0 and matching.match(source, register.where("false")).count() == 0


def test_a_common_name_is_singled_out_by_beds(spark):
    house = lambda i, **more: dict(name="나다라종합병원", phone=f"555-{1000 + i}", addresses=[f"가람시 꽃길 {i}"], size=100 if i < 24 else 900) | more
    register = rows(spark, [(f"R{i:02d}", house(i)) for i in range(25)])
    taken = [(f"s{i:02d}", house(i)) for i in range(24)]
    lost = ("t", house(24, phone="999-9999", addresses=None))
    got = {r.key: (r.record, r.confidence) for r in matching.match(rows(spark, [*taken, lost]), register).collect()}
    assert got["t"][0] == "R24" and 0.0 < got["t"][1] < got["s00"][1]
    assert all(got[f"s{i:02d}"][0] == f"R{i:02d}" for i in range(24))
