import random

from pyspark.sql import functions as F

from seqjoin.llm.residue import classified_templates
from seqjoin.llm.templates import ANY, Leaf, leaf_of, mine_leaf, mine_templates


def brute(messages, agree):
    """One after the other against all templates."""
    templates, of = [], []
    for words in (m.split(" ") for m in messages):
        most = int(len(words) * (1 - agree) + 1e-9)
        differ = [sum(x != y for x, y in zip(t, words)) for t in templates]
        best = min(range(len(templates)), key=lambda i: (differ[i], i), default=None)
        if best is None or differ[best] > most:
            templates.append(words)
            of.append(len(templates) - 1)
        else:
            templates[best] = [x if x == y else ANY for x, y in zip(templates[best], words)]
            of.append(best)
    return [" ".join(templates[i]) for i in of]


def test_leaf_against_comparing_all():
    r = random.Random(4)
    for n in (1, 2, 5, 9, 30):
        for agree in (0.5, 0.8, 1.0):
            messages = sorted({" ".join(r.choice("ab" if r.random() < 0.9 else "cdef") for _ in range(n)) for _ in range(200)})
            assert mine_leaf(messages, agree) == brute(messages, agree)
    assert mine_leaf([]) == []


def test_paths():
    assert leaf_of(["the", "<num>", "page"], 7) == "7 the <*> page" and leaf_of(["a"], 1) == "1 a"
    leaf = Leaf(5, 0.8)
    assert leaf.place("a b c d e".split()) == leaf.place("a b c x e".split()) == 0 and leaf.place("a b y y e".split()) == 1


def mined(spark, messages, **options):
    df = spark.createDataFrame([(leaf_of(m.split(" ")[:3], len(m.split(" "))), m) for m in messages], "leaf string, message string")
    return mine_templates(df, **options)


def test_a_template_stands_once_however_large_its_leaf(spark):
    messages = [f"the file called n{i} was not found on this server" for i in range(400)] + [f"the file called {a}{a} is new and it stays so" for a in "xyz"]
    rows = mined(spark, messages * 2, block=7).collect()
    assert {r.message: r.n for r in rows} == dict.fromkeys(messages, 2)
    assert {r.template for r in rows} == {"the file called <*> was not found on this server", "the file called <*> is new and it stays so"}
    judged = classified_templates(mined(spark, messages, block=7)).orderBy("n").collect()
    assert [(r.n_messages, r.verdict) for r in judged] == [(3, None), (400, "error_page")]
    assert mined(spark, ["a"]).where(F.col("n") > 1).count() == 0
    assert mine_templates(spark.createDataFrame([], "leaf string, message string")).count() == 0
