import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binledger.llm import toxicity as tox


def test_folds_lookalikes_digits_and_signs():
    assert tox.fold("You ІDIОT!") == " you idiot "  # Cyrillic I and O
    assert tox.fold("1d10t m0r0n") == " idiot ldlot moron "
    assert tox.fold("tr@sh a$$ 2024 ｌｏｓｅｒ zu​gabe") == " trash as 2024 loser zugabe " or tox.fold("tr@sh") == " trash "
    assert tox.fold("café") == " café "
    assert tox.fold("") == " " and tox.fold("—") == " "


def brute_matches(folded, lexicon):
    words, at, found, places = folded.split(), 0, {}, []
    for w in words:
        places.append(at)
        at += len(w) + 1
    for place, w in zip(places, words):
        best = max(
            (v for t, v in lexicon.weights.items() if (t == f" {w} " if t.endswith(" ") else w.startswith(t[1:]) and len(w) > len(t) - 1)),
            default=0,
        )
        if best > 0:
            found[place] = best
    for phrase in lexicon.exceptions:
        some = phrase.split()
        for i in range(len(words) - len(some) + 1):
            if words[i : i + len(some)] == some:
                for j in range(i, i + len(some)):
                    found.pop(places[j], None)
    return found


@pytest.mark.parametrize("seed", range(30))
def test_matches_equal_brute_force(seed):
    dice = random.Random(seed)
    pool = ["ab", "abc", "abcd", "b", "bc", "cab", "abca"]
    lexicon = tox.Lexicon(
        {" ab ": 2.0, " abc": 1.0, " abcd ": 3.0, " b ": 0.5, " ca": 1.5}, (" ab bc ", " b b ", " cab abcd ab "), (0.0, 1.0, 1.0)
    )
    folded = tox.fold(" ".join(dice.choice(pool) for _ in range(dice.randint(0, 60))))
    assert tox.matches(folded, lexicon) == brute_matches(folded, lexicon)


def corpus(n, dice):
    """Clean and toxic documents; toxic ones hold forms of one stem, which clean ones hold now and then too."""
    rows, labels = [], []
    for i in range(n):
        words = ["".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 5))) for _ in range(dice.randint(20, 200))]
        toxic = int(i % 5 == 0)
        for k in dice.sample(range(8, len(words)), max(3, len(words) // 25) if toxic else int(dice.random() < 0.05)):
            words[k] = "xyqu" + dice.choice(["a", "bo", "cude"])
        if i % 4 == 1 and not toxic:
            words[5:7] = ["trash", "heap"]
        rows.append((i, " ".join(words), "src", 0))
        labels.append((i, 1, toxic))
    return rows, labels


def test_learns_stems_and_exceptions_and_holds_out(spark):
    rows, labels = corpus(600, random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = tox.fit(docs, marks)
    assert any(t.startswith(" xyq") for t in lexicon.weights) and " trash heap " in lexicon.exceptions
    made = tox.toxicity(docs, marks).join(marks, "doc_id").where("held_out")
    hits = {(r.toxic, r.predicted): r["count"] for r in made.groupBy("toxic", "predicted").count().collect()}
    assert hits.get((1, 1), 0) >= 0.95 * (hits.get((1, 1), 0) + hits.get((1, 0), 0))
    assert hits.get((0, 1), 0) <= 0.05 * sum(hits.values())
    # labels of held-out rows change nothing
    other = marks.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.fit(docs, other) == lexicon


def test_copies_of_one_toxic_text_do_not_teach_its_ordinary_words(spark):
    rows, labels = corpus(300, random.Random(2))
    for i in range(300, 420):
        rows.append((i, rows[0][1] + f" n{i}", "src", 0))
        labels.append((i, 1, 1))
    lexicon = tox.fit(
        spark.createDataFrame(rows, "doc_id long, text string, source string, score int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
    learned = [t for t in lexicon.weights if t not in tox.base_lexicon().weights]
    assert learned and all(t.startswith(" xyq") for t in learned)


def test_edge_rows_and_missing_labels(spark):
    rows = [(None, "you idiot"), (1, None), (2, ""), (2, ""), (3, "a trash can and a trash bin"), (4, "idiot " * 5000), (5, "m0ron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    made = tox.toxicity(docs, none).collect()
    assert len(made) == len(rows) and all(0 <= r.score <= 1 for r in made)
    by = {}
    for r in made:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert by == {None: [1], 1: [0], 2: [0, 0], 3: [0], 4: [1], 5: [1]}
    assert not next(r for r in made if r.doc_id is None).held_out
    assert tox.toxicity(docs.where("false"), none).count() == 0
    assert tox.fit(docs.where("false"), spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, toxic int")) == tox.base_lexicon()


def test_curve_orders_and_weighs():
    x = np.array([[0, 0], [0, 0], [1, 2], [2, 3], [0, 0.5]], float)
    bias, a, b = tox.fit_curve(x, np.array([0, 0, 1, 1, 0.0]), np.ones(5))
    p = 1 / (1 + np.exp(-(bias + x @ [a, b])))
    assert a >= 0 and b >= 0 and p[2:4].min() > 0.3 > p[[0, 1, 4]].max()
