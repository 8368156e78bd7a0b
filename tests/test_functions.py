import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import similarity, text
from pairloom.functions.stem import stem_words

STEMS = """consign consign consigned consign consignment consign consistency consist consolations consol
consolatory consolatori consoled consol consonant conson conspiracy conspiraci conspirators conspir
constancy constanc knackeries knackeri knaves knave knavish knavish kneading knead kneeled kneel knightly
knight knitted knit knives knive knockers knocker databases databas relational relat optimization optim
efficiently effici queries queri generically generic communities communiti ties tie cries cri gas gas
this this gaps gap hopping hop hoping hope cry cri by by say say dying die news news proceeds proceed
inning inning happy happi generously generous business busi dies die agreed agre meeting meet
sensational sensat traditional tradit colonizer colon youth youth boy boy bed bed embed emb fluently
fluentli rolling roll rational ration conditional condit hopefulness hope electricity electr
controll control adoption adopt irritation irrit it it skis ski only onli""".split()


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(*columns).first()


@pytest.mark.parametrize("value", ["a  b", " lead", "tab\tnb sp em\x1cfs\nnl", "", "   "])
def test_words_split_like_python(spark, value):
    assert one(spark, value, text.words(F.col("s")))[0] == value.split()


@pytest.mark.parametrize("value", ["abcde", "ab", "a", "", "naïve 🎉x"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams(spark, value, n):
    expected = [value[i : i + n] for i in range(len(value) - n + 1)]
    assert one(spark, value, text.ngrams(F.col("s"), n))[0] == expected


@pytest.mark.parametrize("value", ["o'neil mcDONALD 3rd x-ray", "élan vital", "", "a1b"])
def test_augmentations_match_python(spark, value):
    row = one(
        spark, value,
        text.title_case(F.col("s")).alias("title"),
        text.alphanumeric(F.col("s")).alias("alnum"),
        F.reverse("s").alias("rev"),
    )
    assert row.title == value.title()
    assert row.alnum == "".join(c for c in value if c.isalnum())
    assert row.rev == value[::-1]


def test_composed_augmentations_apply_in_order(spark):
    assert one(spark, "Straße", text.augment(F.col("s"), ["upper", "lower"]))[0] == "strasse"
    assert one(spark, "ab Cd", text.augment(F.col("s"), ["reverse", "title"]))[0] == "Dc Ba"


def test_punctuation_keeps_the_backslash(spark):
    import string

    assert one(spark, string.punctuation + "x", text.strip_punctuation(F.col("s")))[0] == "\\x"


def test_normalise_and_venue(spark):
    assert one(spark, " A\t B \n", text.normalise(F.col("s")))[0] == "a b"
    venue = text.canonical_venue(F.col("s"), [("sigmod", "sigmod"), ("icde", "icde")], "vldb")
    assert [one(spark, v, venue)[0] for v in ("acm sigmod icde", "icde 1", "pods")] == [
        "sigmod", "icde", "vldb",
    ]


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    df = spark.createDataFrame(pairs, "word string, stem string")
    wrong = df.withColumn("found", stem_words(F.col("word"))).filter("found <> stem").collect()
    assert wrong == []
    assert one(spark, " Running  the Queries ", stem_words(F.col("s")))[0] == "run the queri"


def python_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def python_scores(a, b):
    a, b = set(a), set(b)
    union, size = len(a | b), len(a) + len(b)
    return {
        "jaccard": len(a & b) / union if union else 0,
        "dice": 2 * len(a & b) / size if size else 0,
        "edit": 1 - python_edit(sorted(a), sorted(b)) / size if size else 0,
        "exact": float(a == b),
    }


def test_set_similarities_match_python(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(8)] + ["é", "🎉"]
    sets = [sorted(set(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(80)]
    rows = list(zip(sets[:40], sets[40:], strict=True)) + [([], []), (["x"], []), (["x"], ["x"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    found = df.select(
        "a", "b", similarity.edit_ceiling(a, b).alias("ceiling"),
        similarity.exact_sets(a, b).alias("exact"),
        *[m.score(a, b).alias(name) for name, m in similarity.MEASURES.items()],
    ).collect()
    for row in found:
        expected = python_scores(row.a, row.b)
        for name, value in expected.items():
            assert row[name] == pytest.approx(value), (name, row)
        assert row.ceiling >= row["edit"] - 1e-12
        for name, measure in similarity.MEASURES.items():
            if expected[name] > 0 and (floor := measure.jaccard_floor(expected[name])) > 0:
                assert expected["jaccard"] >= floor - 1e-9


def test_edit_characters(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("é", "e")], "a string, b string")
    found = [r[0] for r in df.select(similarity.edit_characters(F.col("a"), F.col("b"))).collect()]
    assert found == pytest.approx([1 - 3 / 7, 1.0, 0.0])


def test_sets_by_column_type_and_in_sql(spark):
    similarity.register_sql_functions(spark)
    df = spark.createDataFrame([(["a", "b", "b"], "abb", 11)], "items array<string>, s string, n int")
    row = df.select(*[similarity.as_set(df, c).alias(c) for c in df.columns]).first()
    assert (row["items"], row.s, row.n) == (["a", "b"], ["a", "b"], ["1"])
    found = spark.sql(
        "SELECT jaccard_similarity(a, b) j, dice_similarity(a, b) d, exact_similarity(a, b) e "
        "FROM VALUES (array('x', 'y'), array('y', 'z')) t(a, b)"
    ).first()
    assert tuple(found) == pytest.approx((1 / 3, 0.5, 0.0))


@pytest.mark.parametrize("size", [300, 60_000, 70_000])
def test_edit_similarity_of_many_tokens(spark, size):
    """Beyond what one code unit can number: three tokens differ, in the middle and at both ends."""
    names = [f"t{i:06d}" for i in range(size)]
    other = ["s0", *names[1 : size // 2], "t" + names[size // 2][1:] + "x", *names[size // 2 + 1 : -1], "u0"]
    df = spark.createDataFrame([(names, other)], "a array<string>, b array<string>")
    score = df.select(similarity.edit_tokens(F.col("a"), F.col("b"), 0.99)).first()[0]
    assert score == pytest.approx(1 - 3 / (2 * size), abs=1e-12)


def test_augmentations_that_begin_alike_are_shared(spark):
    chosen = [("lower",), ("identity", "lower"), ("lower", "title"), ("lower", "title", "reverse"), ("identity",), ("upper", "lower")]
    df = spark.createDataFrame([("Straße o'NEIL a\tb",), ("",), (None,)], "s string")
    made, found = text.with_augmented(df, "s", chosen)
    got = made.select(*[found[c].alias(str(k)) for k, c in enumerate(chosen)]).collect()
    assert got == df.select(*[text.augment(F.col("s"), c).alias(str(k)) for k, c in enumerate(chosen)]).collect()
    # One column for the text and one for each distinct beginning.
    assert len(made.columns) == 1 + 6


def test_title_case_of_other_symbols(spark):
    """A lower-case symbol that is no letter has a capital where it begins a run of others."""
    df = spark.createDataFrame([("abⓐc ⓐ d-ⅰ",)], "s string")
    assert df.select(text.title_case(F.col("s"))).first()[0] == "AbⒶC ⓐ D-ⅰ"
