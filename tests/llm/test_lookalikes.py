import unicodedata

from tracelake.llm import lookalikes as L

SAME = [
    ("HT-53 abc", "ＨＴ－５３ abc"), ("café au lait", "café au lait"), ("file", "ﬁle"), ("no break", "no break"), ("zero", "ze​ro"), ("soft", "so­ft"), ("用日金", "⽤⽇⾦"),
    ("paper", "рарer"), ("ROCKET", "RОСКEТ"), ("a-b", "a‐b"), ("a-b", "a‑b"), ("сосна", "cocнa"), ("长门", "⻓⻔"),
    ("café", "cafе\u0301"), ("Löhne", "Lо\u0308hne"), ("Apple", "Ꭺpple"), ("gala", "ɡɑla"), ("Invoice", "Ιnvoice"), ("Год", "Γод"),
]
APART = [("a1", "a2"), ("m2", "m²"), ("1", "①"), ("l0", "lO"), ("a b", "ab"), ("рост", "роst"), ("test", "tést"), ("А", "Б"), ("x", "X"), ("Il", "II"), ("modern", "modem"), ("3а", "За"), ("1", "l")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.form for r in L.visual_forms(df).orderBy("key").collect()]


def test_same_and_apart(spark):
    got = forms(spark, [t for p in SAME + APART for t in p])
    for k, p in enumerate(SAME):
        assert got[2 * k] == got[2 * k + 1], p
    for k, p in enumerate(APART, len(SAME)):
        assert got[2 * k] != got[2 * k + 1], p


def test_viterbi_is_the_best_way(spark):
    import itertools

    letters = L.Letters.of(L.published(spark))
    lattice = L.Lattice({(97 << 16) | 112: 9, (0x430 << 16) | 0x440: 3, 97: 4, (112 << 16): 4, (0x440 << 16) | 0x43E: 7, (0x406 << 16) | 97: 5}, letters)
    for token in ("рао", "ape", "ро", "ЕКА", "aІp", "Ӏaо"):
        ways = list(itertools.product(*[lattice.ways.get(c, [(c, 0.0)]) for c in token.translate(lattice.skeleton)]))
        score = lambda w: sum(lattice.score(a, b) for a, b in zip([0, *map(ord, w)], [*map(ord, w), 0]))
        top = max(score([c for c, _ in w]) - sum(x for _, x in w) for w in ways)
        assert any("".join(c for c, _ in w) == lattice.best(token) and abs(score([c for c, _ in w]) - sum(x for _, x in w) - top) < 1e-9 for w in ways)


def test_classes_share_no_letter(spark):
    table = L.Letters.of(L.published(spark))
    assert len(table.classes) > len(L.LOOKALIKES) and set("ІΙӀ") <= set(table.doubtful) and not set("0123456789") & set("".join(table.classes))
    letters = [c for cls in table.classes for c in cls]
    assert len(letters) == len(set(letters)) and all(unicodedata.normalize("NFC", c) == c for c in letters)


def test_the_search_decides_between_readings(spark):
    """One stroke, two readings: which text it meets depends on the letters around it, not on a map of characters."""
    got = forms(spark, ["Italy value total"] * 20 + ["Іtaly", "Italy", "ltaly", "totaІ", "total", "totaI"])[20:]
    assert got[0] == got[1] != got[2] and got[3] == got[4] != got[5]


def test_script_consistency(spark):
    assert forms(spark, ["сосна растет", "the paper"]) == ["сосна растет", "the paper"]


def test_pairs(spark):
    rows = [(1, "paper", "x"), (2, "рарer", "x"), (3, "paper", "x"), (4, "pap3r", "x"), (5, None, "x"), (6, "", "x"), (7, "​", "x"), (8, "z" * 100_000, "x"), (2, "рарer", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    assert {tuple(r) for r in L.lookalike_pairs(df).collect()} == {(1, 2), (2, 3), (6, 7)}
    assert L.lookalike_pairs(df.where("1 = 0")).collect() == []
