import random

from weftline.llm import reading

LOW = ["the cat sits", "we see a dog", "it is red", "look at the box", "this is fun"]
HIGH = ["the epistemic limitations of distributed observation", "commutativity entails serialization guarantees", "heterogeneous dependencies presuppose reconciliation", "asymptotic characterization of contention"]


def sample(words, r, n=12):
    return ". ".join(r.choice(words) for _ in range(n)) + "."


def graded(spark):
    r = random.Random(1)
    rows = [(i, sample(LOW if lv < 4 else HIGH, r), "en", lv) for i, lv in enumerate([1, 1, 2, 4, 5, 5])] + [(90, None, "en", 1), (91, "x", "en", None)]
    return spark.createDataFrame(rows, "sample_id bigint, sample_text string, lang string, reading_level int")


def test_levels(spark):
    r = random.Random(2)
    code = "def f(x):\n    return x\n\n[10:00:00] ERROR db: lost 3 rows\nSELECT a\nFROM b\nWHERE c > 1;\n"
    docs = [
        (1, sample(HIGH, r)), (2, sample(LOW, r)), (3, None), (4, ""), (5, "ok"), (6, code), (7, "## Title here\n\n- " + sample(HIGH, r, 4) + "\n- " + sample(HIGH, r, 4) + "\n```\n" + sample(LOW, r, 30) + "\n```\n"),
        (8, sample(HIGH, r, 3000)), (9, "zzz qqq " * 30), (1, sample(HIGH, r)),
    ]
    df = spark.createDataFrame([(i, t, "zh", 3) for i, t in docs], "doc_id bigint, text string, lang string, reading_level int")
    got = reading.demanding(df, graded(spark)).collect()
    assert sorted(x.doc_id for x in got) == [1, 1, 7, 8]
    lev = {x.doc_id: x.reading_level for x in reading.levels(df, graded(spark)).collect()}
    assert lev[2] in (1, 2) and all(lev[k] is None for k in (3, 4, 5, 6, 9))


def test_prose():
    assert reading.prose("# Head\n\nA line.\n    code\n$ ls\n1. Item one\nuser: said this") == "A line.\nItem one\nsaid this"
    assert reading.units("不要 Don't") == ["不", "要", "不要", "don't"]


def test_no_samples_and_no_documents(spark):
    df = spark.createDataFrame([(1, sample(HIGH, random.Random(3)))], "doc_id bigint, text string")
    assert reading.demanding(df, graded(spark).where("false")).count() == 0
    assert reading.levels(df.where("false"), graded(spark)).count() == 0
