"""Trait tagging against hand-derived rows and against a plain Python reading of the rules."""

import random
import re

from gristmill import config
from gristmill.operators import traits

GOLDEN = [
    ("Resistant to maize streak virus", "YES NO NO NO NO"),
    ("Not resistant to blight", "NO NO NO NO NO"),
    ("Susceptible to rust but drought tolerant", "NO NO YES NO NO"),
    ("Low yielding; suitable for highlands", "NO NO NO NO NO"),
    ("Good storage, good taste, bitter", "NO NO NO YES NO"),
    ("Popular, palatable, attractive color, bitter", "NO NO NO NO YES"),
    ("Resistant to lodging", "NO NO NO NO NO"),
    ("rust, rust", "YES NO NO NO NO"),
    ("Weevil resistant", "NO YES NO YES NO"),
    ("Aphids and alectra", "NO YES NO NO NO"),
    (None, "NO NO NO NO NO"),
    ("   ", "NO NO NO NO NO"),
]


def tag(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, note string")
    tagged = traits.extract_traits(df, "note").orderBy("i")
    return [" ".join(r[t] for t in config.TRAITS) for r in tagged.collect()]


def expected(text):
    """The rules, hit by hit."""
    text = (text or "").strip().lower()
    out = []
    negation = re.compile(r"\b(?:" + "|".join(config.NEGATION_WORDS) + r")\b")
    for trait in config.TRAITS:
        counts = {"yes": 0, "negated": 0, "explicit": 0}
        for kind, phrases in config.TRAIT_PHRASES[trait].items():
            for phrase in phrases:
                for hit in re.finditer(r"(.{0,30})\b" + re.escape(phrase) + r"\b", text):
                    if kind == "NO":
                        counts["explicit"] += 1
                    elif negation.search(hit.group(1)):
                        counts["negated"] += 1
                    else:
                        after = text[hit.end():hit.end() + 50]
                        generic = phrase in config.GENERIC_PHRASES
                        near = any(w in after for w in config.GENERIC_CONTEXT[trait])
                        counts["yes"] += near or not generic
        need = counts["explicit"] * 3 if counts["explicit"] else counts["negated"] * 2
        out.append("YES" if counts["yes"] and counts["yes"] >= need else "NO")
    return " ".join(out)


def test_golden(spark):
    assert tag(spark, [t for t, _ in GOLDEN]) == [want for _, want in GOLDEN]


def test_random_texts_agree_with_the_rules(spark):
    rng = random.Random(7)
    words = [p for t in config.TRAIT_PHRASES.values() for ps in t.values() for p in ps]
    filler = ["not", "low", "the", "é", "disease", "of\nthe", "x" * 28, ",", "rust", "rust", "no", "to", "ünrust"]
    texts = [
        rng.choice(["", " ", "\n"]).join(
            [" "] + [rng.choice(words if rng.random() < .5 else filler) + rng.choice([" ", ", ", "\n", ". "])
                     for _ in range(rng.randint(1, 25))])
        for _ in range(400)
    ]
    texts += ["rust " * 60, "rust\nrust rust", "x" * 40 + " rust"]
    assert tag(spark, texts) == [expected(t) for t in texts]


def test_missing_column_gives_no(spark):
    out = traits.extract_traits(spark.range(2), "absent").drop("id").distinct().collect()
    assert [tuple(r) for r in out] == [("NO",) * 5]


def test_is_idempotent(spark):
    df = spark.createDataFrame([(t,) for t, _ in GOLDEN], "note string")
    once = traits.extract_traits(df, "note")
    again = traits.extract_traits(once, "note")
    assert again.columns == once.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_report(spark):
    df = spark.createDataFrame([(t,) for t, _ in GOLDEN], "note string")
    report = {r.trait: r for r in traits.trait_report(traits.extract_traits(df, "note"), "note").collect()}
    row = report["disease_tolerant"]
    assert (row.yes_count, row.no_count, row.total_records, row.records_with_text) == (2, 10, 12, 10)
    assert row.enrichment_rate == 83.3


def test_phrases_that_overlap_themselves(spark):
    rng = random.Random(9)
    phrases = {"a": {"YES": ["so and so", "l'or", "x.y", "été sec"], "NO": ["so", "\\Q"]}}
    parts = ["so", "and", "so and so", "not", "\n", "l'or", "x.y", "xzy", "été sec", "\\Q", "and so", "é", "z" * 25]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(150)]
    negation = re.compile(r"\b(?:" + "|".join(config.NEGATION_WORDS) + r")\b")

    def plain(text):
        yes = negated = 0
        for phrase in phrases["a"]["YES"]:
            for hit in re.finditer(r"(.{0,30})\b" + re.escape(phrase) + r"\b", text.strip()):
                turned = negation.search(hit.group(1))
                negated, yes = negated + bool(turned), yes + (not turned)
        explicit = sum(len(re.findall(r".{0,30}\b" + re.escape(p) + r"\b", text.strip())) for p in phrases["a"]["NO"])
        need = explicit * 3 if explicit else negated * 2
        return "YES" if yes and yes >= need else "NO"

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, note string")
    got = [r.a for r in traits.extract_traits(df, "note", phrases).orderBy("i").collect()]
    assert got == [plain(t) for t in texts] and set(got) == {"YES", "NO"}


def test_repeated_texts_are_scanned_once(spark):
    rows = [(i, GOLDEN[i % len(GOLDEN)][0], "x") for i in range(60)]
    df = spark.createDataFrame(rows, "i int, note string, drought_tolerant string")
    once = traits.extract_traits_once(df, "note")
    plain = traits.extract_traits(df, "note")
    assert once.columns == plain.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))
    absent = traits.extract_traits_once(df, "absent").select(*config.TRAITS).distinct().collect()
    assert [tuple(r) for r in absent] == [("NO",) * 5]
