"""Quality rules and toxicity: counts against plain versions, models by held-out accuracy."""

import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from optrace.llm import quality, toxicity
from optrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@pytest.mark.parametrize("text", [
    None, "", "  ", "a b c a b c", "a b c d a b c d e", "x x x x", "eins\nzwei\n\neins\n \n eins\neins", "a | b ## <c> é f", "a\x0bb\x0cc\rd", "a b a b a",
    "p q r s t p q r u r s t",
])
def test_base_counts(text):
    assert quality.base_counts(text) == plain_counts(text)


def test_base_counts_of_documents(documents):
    model = {"weights": bytes(8 * (quality.SIZE + 1)), "slope": 0.0, "offset": 4.0}
    rows = quality.quality_verdicts(documents, model).collect()
    assert len(rows) == documents.count()
    for x in rows:
        assert tuple(x[n] for n in quality.VERDICT_NAMES[:5]) == plain_counts(x.text)
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert x.kept == (not x.base_failed)


def test_model_without_labels(spark, documents, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(documents, labels)
    assert {x.kept for x in quality.quality_verdicts(documents, model).filter("NOT base_failed").collect()} == {True}
    assert quality.quality_verdicts(empty, model).count() == 0
    machine = toxicity.train(documents, labels)
    scored = toxicity.toxicity_scores(documents, machine)
    assert scored.count() == documents.count() and dict(scored.dtypes)["score"] == "double"
    assert toxicity.toxicity_scores(empty, machine).count() == 0


def test_quality_on_documents(spark):
    found = QUERIES["op4_quality_rules"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.filter("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {x.quality: x.share for x in rows}
    assert share[1] > 0.98 and share[0] < 0.1


@pytest.fixture(scope="module")
def trained(spark):
    """A machine of the table, its held-out rows with labels, and the words it takes for insults in a sentence."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    machine = toxicity.train(documents, labels)
    found = toxicity.toxicity_scores(documents.select("doc_id", "text"), machine).join(labels, "doc_id")
    rows = found.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("text", "toxic", "predicted").collect()
    return machine, rows, min(" ".join(x.text.split()[:12]) for x in rows if x.toxic == x.predicted == 0 and len(x.text or "") > 300 and x.text.isascii())


INSULTS = "idiot clown moron scum stupid trash loser pathetic worthless disgusting".split()


def flagged(machine, sentence, word=None):
    """Is the sentence toxic, with that unit in it?"""
    found = sorted(toxicity.units(sentence)) + [word] * (word is not None)
    margins = machine.unit_margins(found)
    return machine.scores(np.array([sum(margins)]), np.array([len(found)]))[0] >= 0.5


def test_toxicity_held_out(trained):
    _, rows, _ = trained
    share = {y: np.mean([x.predicted for x in rows if x.toxic == y]) for y in (0, 1)}
    assert share[1] > 0.85 and share[0] < 0.03


def test_changed_insults_are_found(trained):
    """By the kernel alone: the words are given as units, so no pattern puts letters together."""
    machine, _, sentence = trained
    assert not flagged(machine, sentence)
    words = [w for w in INSULTS if flagged(machine, sentence, w)]
    assert len(words) >= 8
    pick = random.Random(1)

    def put(word, n, mark):
        for _ in range(n):
            at = pick.randrange(1, len(word))
            word = word[:at] + (mark or pick.choice("abcdefghijklmnopqrstuvwxyz")) + word[at:]
        return word

    def dropped(word):
        at = pick.randrange(1, len(word) - 1)
        return word[:at] + word[at + 1 :]

    share = lambda form: np.mean([flagged(machine, sentence, form(w)) for w in words for _ in range(5)])
    for n in (1, 2, 3):
        assert share(lambda w: put(w, n, "~")) >= 0.85 and share(lambda w: put(w, n, "_")) >= 0.85  # noqa: B023
    assert share("~".join) >= 0.85 and share("~~".join) >= 0.85 and share("*".join) >= 0.85
    assert share(lambda w: put(w, 1, None)) >= 0.85 and share(dropped) >= 0.8 and share(lambda w: put(w, 2, None)) >= 0.7


def plain_weights(word):
    letters = [i for i, c in enumerate(word) if c.isalnum() or i in (0, len(word) - 1)]
    plain = Counter()
    for i, j, k in combinations(letters, 3):
        plain[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
    norm = sum(x * x for x in plain.values()) ** 0.5
    return {u: x / norm for u, x in plain.items()}


@pytest.mark.parametrize("word", ["^banana$", "^a$", "^i~d~~i-ot$", "^é日b日b$", "^l.o__ser$"])
def test_subsequences_against_all_of_them(word):
    [(some, code, value)] = list(toxicity._subsequences([word]))
    got = {chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF): v for c, v in zip(code[0].tolist(), value[0].tolist()) if v}
    assert some.tolist() == [0] and got == pytest.approx(plain_weights(word))


def test_margins_against_plain_kernel():
    """Margins of a small machine, and their bounds, against sums over landmarks worked out word by word."""
    pick = random.Random(6)
    word = lambda: "^" + "".join(pick.choice("abcdé~-") for _ in range(pick.randrange(1, 9))).strip("~-") + "$"
    marks, words = ["^abcab$", "^bad-c$", "^dcéa$", "^cab$"], ["^$", *(word() for _ in range(300))]
    codes, table = toxicity._landmark_table(marks)
    alphas = np.array([1.5, -0.7, 0.9, 0.4])
    machine = toxicity.Machine(codes, table, alphas, -0.3)
    wanted = []
    for x in words:
        own = plain_weights(x)
        alike = [sum(v * plain_weights(m).get(u, 0) for u, v in own.items()) for m in marks]
        wanted.append(min(toxicity.HIGHEST, -0.3 + sum(a * k**toxicity.POWER for a, k in zip(alphas, alike))))
    assert machine.margins(words, -9.0) == pytest.approx(wanted, abs=1e-5)
    assert machine.margins(words, 0.0) == pytest.approx(np.maximum(wanted, 0), abs=1e-5)
    bounds = machine._bounds(words)
    assert all(b >= w - 1e-5 for b, w, x in zip(bounds, wanted, words) if len(x) > 2)


@pytest.mark.parametrize("run", ["_" * 10_000, "." * 10_000, "-" * 10_000, "_ " * 5000, "a_" * 5000, "a." * 5000, "* _" * 4000])
@pytest.mark.parametrize("end", ["", "!", " x", "bc"])
def test_long_runs_take_little_time(run, end):
    start = time.process_time()
    found = toxicity.units(f"Name: {run}{end}")
    toxicity.Machine(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), -1.0).unit_margins(sorted(found))
    assert time.process_time() - start < 1


def test_units_spelled_out():
    assert "idiot" in toxicity.units("an i d i o t here") and "idiot" in toxicity.units("I.D.I.O.T")
    assert toxicity.units(None) == set()
