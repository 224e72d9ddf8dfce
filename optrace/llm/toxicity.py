"""Operator 8: toxicity by a subsequence string kernel and a support vector machine.

Units are words of the sentences (and runs of single characters read as one word). The kernel compares
the subsequences of three letters of two units, each weighted DECAY ** span, normalised and raised to a
power: letters put in or left out lower a likeness but do not end it, and marks between letters are gaps,
so any number of them is told from the span alone. Landmark units, changed forms of them among these, give
a Nyström map, on which a linear support vector machine is trained; changed forms of the positive examples
are positive examples too.

Labels belong to texts: a unit is a positive example if several toxic texts hold it, among different words,
and it is far more frequent in them than in clean ones, a negative one if clean texts have it. A text's
score comes from the sum of its units' margins, each between 0 and 1, and the number of its units, with
logistic weights fitted to sampled texts left out of the fit: one insult is much in a sentence and may be
chance in a long text."""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optrace.llm.common import sampled, slices

#: Labelled texts used at most; the documented bound of the training sample.
SAMPLE = 8000
POSITIVES, NEGATIVES, POOL, LANDMARKS = 400, 3000, 100_000, 160
DECAY, WINDOW, FLOOR, MINING = 0.8, 18, 1e-3, 4
POWER, ALIKE = 3, 0.65
#: A unit counts with its margin between these: what is surely below the least is not worked out.
LOWEST, HIGHEST = 0.0, 1.0
#: Weight of a toxic text in the calibration, and what stands in for it: of the log of the units' sum, of
#: the log of their number (above MOST it needs no more), and alone.
WEIGHT, DEFAULT = 2.0, (4.0, -2.0, 10.0)
SUM, COUNT, MOST = 0.2, 200, 500
#: Changed forms of a positive example, and letters put in or left out in them at most.
FORMS, CHANGES = 24, 3
#: Groups of landmarks in a bound, and how like a group's first two are at most;
#: margins kept from one lot of texts to the next.
GROUPS, LIKE, KEPT = 32, 0.5, 200_000
#: Units compared with the landmarks at once.
ROWS = 100
LIFT, EVIDENCE, LEAST = 6.0, 24.0, 3
MARKS = string.punctuation + "«»“”„‘’…–—¡¿"
GAP = 3
LONG_GAP = re.compile(f"([\\W_]{{{GAP}}})[\\W_]+")
INSERTED = string.ascii_lowercase + "~*_.-+=|/0123456789"
#: Single characters with marks or blanks between them; _ is a mark here, so no text matches in two ways.
SPELLED = re.compile(r"(?<!\S)[^\W_](?:[\s.*_-]+[^\W_]){2,}(?!\S)")


def units(text: str | None) -> set[str]:
    """Distinct units of a whole text: words, lower-cased and without marks around them, and
    spelled-out runs of characters."""
    text = (text or "").lower()
    out = {x.strip(MARKS) for x in set(text.split())}
    for found in SPELLED.finditer(text):
        out.add(re.sub(r"\W", "", found.group()))
    return out


def _windows(unit: str) -> list[str]:
    """The unit without marks around it, its ends marked; long ones in overlapping windows of WINDOW
    letters, with at most GAP marks between two of them."""
    if unit.isalnum() and len(unit) + 2 <= WINDOW:
        return [f"^{unit}$"]
    unit = "^" + LONG_GAP.sub(r"\1", unit.strip(MARKS + " ")) + "$"
    letters = [i for i, c in enumerate(unit) if c.isalnum() or i in (0, len(unit) - 1)]
    if len(letters) <= WINDOW:
        return [unit]
    return [unit[letters[i] : letters[min(i + WINDOW, len(letters)) - 1] + 1] for i in range(0, len(letters) - WINDOW // 2, WINDOW // 2)]


def _letters(word: str) -> tuple[int, ...] | int:
    """The places of a word's letters, or their number if there are no marks between them."""
    inner = word.strip("^$")
    if inner.isalnum():
        return len(word)
    places = tuple(i for i, c in enumerate(word) if c.isalnum() or (c in "^$" and i in (0, len(word) - 1)))
    return len(word) if len(places) == len(word) else places


@lru_cache(maxsize=4096)
def _triples(letters: tuple[int, ...] | int) -> tuple[np.ndarray, np.ndarray]:
    """Three letters each, and their weight: a mark between them counts as a gap."""
    letters = range(letters) if isinstance(letters, int) else letters
    places = np.array(list(combinations(letters, 3)), np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1).astype(np.float64)


def _alike(words: list[str]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Words whose letters have the same places: their positions, how many characters count, and the
    places and weights of three letters."""
    by: dict[tuple[int, ...] | int, list[int]] = {}
    for i, word in enumerate(words):
        letters = _letters(word)
        if (letters if isinstance(letters, int) else len(letters)) >= 3:
            by.setdefault(letters, []).append(i)
    for letters, rows in by.items():
        places, weight = _triples(letters)
        length = letters if isinstance(letters, int) else letters[-1] + 1
        for at in range(0, len(rows), 1 + 200_000 // len(places)):
            yield np.array(rows[at : at + 1 + 200_000 // len(places)]), length, places, weight


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words' positions, the codes of their subsequences (equal ones together) and weights scaled
    so that each word's vector has length 1; a repeated code has its sum once."""
    for some, length, places, weight in _alike(words):
        text = "".join(words[i][:length] for i in some)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), length).astype(np.int64)
        code = (codes[:, places[:, 0]] << 42) | (codes[:, places[:, 1]] << 21) | codes[:, places[:, 2]]
        order = np.argsort(code, axis=1, kind="stable")
        code = np.take_along_axis(code, order, 1)
        values = weight[order]
        first = np.concatenate([np.ones((len(some), 1), bool), code[:, 1:] != code[:, :-1]], 1)
        starts = np.flatnonzero(first)
        summed = np.zeros(code.size)
        summed[starts] = np.add.reduceat(values.reshape(-1), starts)
        summed = summed.reshape(code.shape)
        yield some, code, summed / np.sqrt((summed**2).sum(axis=1))[:, None]


class Machine:
    """Decision function: sorted subsequence codes, their weight in each landmark, the landmarks'
    coefficients, intercept, and the weights that turn the margins of a text's units into a score."""

    def __init__(self, codes: np.ndarray, table: np.ndarray, alphas: np.ndarray, intercept: float, weights: tuple = DEFAULT):
        self.codes, self.table, self.alphas, self.intercept, self.weights = codes, table.astype(np.float32), np.asarray(alphas, np.float64), intercept, weights
        self._group()

    def _group(self) -> None:
        """Landmarks that speak for toxicity in groups of like ones, and by three letters (by number, 0 for
        others) the most a group's landmarks have there and what they add up to."""
        positive = np.flatnonzero(self.alphas > 0)
        own = self.table[:, positive].astype(np.float64)
        alike, seeds = own.T @ own, []
        for i in np.argsort(-self.alphas[positive], kind="stable"):
            if len(seeds) < GROUPS and (not seeds or alike[i, seeds].max() < LIKE):
                seeds.append(int(i))
        group = alike[:, seeds].argmax(axis=1) if seeds else np.zeros(0, np.int64)
        used = np.flatnonzero((own > 0).any(axis=1))
        parts = [(self.codes[used] >> shift) & 0x1FFFFF for shift in (42, 21, 0)]
        self.letters = np.unique(np.concatenate([np.zeros(1, np.int64), *parts]))
        size = len(self.letters)
        place = (np.searchsorted(self.letters, parts[0]) * size + np.searchsorted(self.letters, parts[1])) * size + np.searchsorted(self.letters, parts[2])
        self.rows = np.zeros(size**3, np.int32)
        self.rows[place] = np.arange(1, len(used) + 1)
        self.bounds = np.zeros((len(used) + 1, 2 * len(seeds)), np.float32)  # the first for letters that no landmark has
        for g in range(len(seeds)):
            inside = own[used][:, group == g]
            self.bounds[1:, g], self.bounds[1:, len(seeds) + g] = inside.max(axis=1), inside @ self.alphas[positive][group == g]

    def _bounds(self, words: list[str]) -> np.ndarray:
        """No margin of a word is above its bound. In a group a likeness is at most the sum over the most,
        and the weighted sum of the powers at most that to the power POWER - 1 times the weighted sum; all
        over the word's length, which repeated subsequences can but raise."""
        out, size, groups = np.full(len(words), -np.inf), len(self.letters), self.bounds.shape[1] // 2
        for rows, length, places, weight in _alike(words):
            weight = (weight / np.sqrt((weight**2).sum())).astype(np.float32)
            codes = np.frombuffer("".join(words[i][:length] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), length)
            at = np.minimum(np.searchsorted(self.letters, codes), size - 1)
            at = np.where(self.letters[at] == codes, at, 0)
            code = (at[:, places[:, 0]] * size + at[:, places[:, 1]]) * size + at[:, places[:, 2]]
            found = self.rows[code]
            for i in range(0, len(rows), step := 1 + 40_000 // len(places)):
                sums = weight @ self.bounds[found[i : i + step]]
                out[rows[i : i + step]] = self.intercept + (np.minimum(1, sums[:, :groups]) ** (POWER - 1) * sums[:, groups:]).sum(axis=1)
        return out

    def margins(self, words: list[str], lowest: float = LOWEST) -> np.ndarray:
        """Margin of every word, between lowest and HIGHEST."""
        out = np.full(len(words), min(HIGHEST, max(self.intercept, lowest)))
        if len(self.codes):
            near = np.flatnonzero(self._bounds(words) > lowest - 1e-3)
            out = np.full(len(words), lowest)
            short = [i for i, x in enumerate(words) if len(x) < 3]
            out[short] = min(HIGHEST, max(self.intercept, lowest))
            for some, code, value in _subsequences([words[i] for i in near]):
                at, value = _known(self.codes, code, value)
                for i in range(0, len(some), ROWS):
                    few = slice(i, i + ROWS)
                    found = self.intercept + _likeness(at[few], value[few], self.table) @ self.alphas
                    out[near[some[few]]] = np.clip(found, lowest, HIGHEST)
        return out

    def unit_margins(self, found: list[str]) -> list[float]:
        parts = [_windows(x) for x in found]
        flat = self.margins([w for p in parts for w in p])
        starts = np.cumsum([0, *(len(p) for p in parts)])[:-1]
        return np.maximum.reduceat(flat, starts).tolist() if found else []

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of texts from the sum of their units' margins and the number of units."""
        return 1 / (1 + np.exp(-np.clip(_features(sums, counts) @ np.array(self.weights), -500, 500)))


def _features(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.stack([np.log(sums + SUM), np.log(np.minimum(counts, MOST) + COUNT), np.ones(len(sums))], axis=1)


def calibration(sums: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple:
    """Logistic weights of a text's features, toxic texts weighted; DEFAULT if they make no sense."""
    x, each, out = _features(sums, counts), np.where(labels == 1, WEIGHT, 1.0), np.zeros(3)
    for _ in range(rounds):
        share = 1 / (1 + np.exp(-np.clip(x @ out, -500, 500)))
        slope = x.T @ (each * (share - labels)) + 1e-2 * out
        out = out - np.linalg.solve((x * (each * share * (1 - share))[:, None]).T @ x + 1e-2 * np.eye(3), slope)
    return tuple(out.tolist()) if np.isfinite(out).all() and out[0] > 0 >= out[1] else DEFAULT


def changed_forms(word: str, forms: int = FORMS) -> list[str]:
    """Forms of a word with up to CHANGES letters or marks put in between its ends, or one letter left
    out; always the same ones."""
    pick, inner, out = random.Random(word), word.strip("^$"), []
    if len(inner) < 4:
        return []
    for i in range(forms):
        if i % 4 == 3:
            at = pick.randrange(1, len(inner) - 1)
            form = inner[:at] + inner[at + 1 :]
        else:
            form, mark = inner, pick.choice(INSERTED)
            for _ in range(1 + i % 4 % CHANGES):
                at = pick.randrange(1, len(form))
                form = form[:at] + (mark if i % 2 else pick.choice(INSERTED)) + form[at:]
        out.append(word.replace(inner, form)[:WINDOW])
    return list(dict.fromkeys(out))


def _shares(numbers: list[float], total: float) -> np.ndarray:
    out = np.array(numbers, np.float64)
    return out * (total / max(out.sum(), 1e-9))


def _evidence(t: int, c: int, share: float) -> float:
    """Likelihood ratio statistic of t toxic among t + c texts, if share of all texts is toxic."""
    n = t + c
    return 2 * (t * math.log(t / n / share) + (c * math.log(c / n / (1 - share)) if c else 0.0))


def fit(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> Machine:
    """Machine from (unit, toxic texts with it, clean texts with it); toxic and clean are the numbers
    of texts. Without positive examples its margin is constant."""
    lift = {w: (t / max(1, toxic)) / ((c + 0.5) / max(1, clean)) for w, t, c in rows}
    share = min(max(toxic / max(1, toxic + clean), 1e-6), 1 - 1e-6)
    positive = sorted((-t, w) for w, t, c in rows if t >= LEAST and lift[w] >= LIFT and _evidence(t, c, share) >= EVIDENCE)
    seen = {x: -t for t, w in reversed(positive) for x in _windows(w) if len(x) >= 5}
    positive = sorted(seen, key=lambda x: (-seen[x], x))[:POSITIVES]
    if not positive:
        return Machine(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), -1.0)
    held = set(positive)
    pool = [w for w, t, c in sorted(rows, key=lambda x: -x[2]) if c and lift[w] <= 2]
    often = {w: c for w, _, c in rows}
    common = {x: often[w] for w in reversed(pool) for x in _windows(w) if x not in held}
    pool = sorted(common, key=lambda x: (-common[x], x))

    formed = {y: seen[x] / FORMS for x in positive for y in changed_forms(x) if y not in held and y not in common}
    chosen = _diverse(positive + list(formed), LANDMARKS // 2)
    codes, table = _landmark_table(chosen)
    near = np.concatenate([np.zeros(0), *(_kernel(pool[i : i + 2000], codes, table).max(axis=1) for i in range(0, len(pool), 2000))])
    hard = [pool[i] for i in np.argsort(-near, kind="stable")[:NEGATIVES]]
    negative = list(dict.fromkeys(hard + pool[:NEGATIVES]))
    codes, table = _landmark_table(list(dict.fromkeys(chosen + _diverse(hard, LANDMARKS - len(chosen)))))
    values, vectors = np.linalg.eigh((table.T @ table) ** POWER)
    root = (vectors / np.sqrt(np.maximum(values, FLOOR))) @ vectors.T

    def mapped(words: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros((0, len(root))), *(_kernel(words[i : i + 2000], codes, table) @ root for i in range(0, len(words), 2000))])

    known = mapped(positive + list(formed))
    gain = np.concatenate([_shares([math.sqrt(seen[x]) for x in positive], 0.25), _shares([math.sqrt(x) for x in formed.values()], 0.25)])
    for _ in range(MINING):  # negatives that the machine takes for insults join its examples
        y = np.concatenate([np.ones(len(known)), -np.ones(len(negative))])
        cost = np.concatenate([gain, _shares([math.sqrt(common[x]) for x in negative], 0.5)])
        weights, intercept = _hinge(np.concatenate([known, mapped(negative)]), y, cost)
        machine = Machine(codes, table, root @ weights, intercept)
        margins = machine.margins(pool, -1.0)
        wrong = [pool[i] for i in np.argsort(-margins, kind="stable")[: NEGATIVES // 2] if margins[i] > -0.8]
        negative = list(dict.fromkeys(wrong + negative))
    return machine


def _diverse(words: list[str], most: int) -> list[str]:
    """The first words that are not much alike, at most that many."""
    out: list[str] = []
    for at in range(0, len(words), 200):
        some = words[at : at + 200]
        codes, table = _landmark_table(out + some)
        alike = table.T @ table
        kept = list(range(len(out)))
        for i in range(len(out), len(alike)):
            if len(kept) < most and (not kept or alike[i, kept].max() < ALIKE):
                kept.append(i)
        out = [(out + some)[i] for i in kept]
        if len(out) == most:
            break
    return out


def _landmark_table(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted subsequence codes of the landmarks and a column of weights for each landmark."""
    found = list(_subsequences(marks))
    codes = np.unique(np.concatenate([code.reshape(-1) for _, code, _ in found]))
    table = np.zeros((len(codes), len(marks)))
    for some, code, value in found:
        np.add.at(table, (np.searchsorted(codes, code), np.broadcast_to(some[:, None], code.shape)), value)
    return codes, table


def _known(codes: np.ndarray, code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return at, np.where(codes[at] == code, value, 0.0)


def _likeness(at: np.ndarray, value: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel values with every landmark: the normalised subsequence kernel to the power POWER."""
    out = np.einsum("ij,ijk->ik", value.astype(table.dtype), table[at], optimize=False)
    return out**POWER


def _kernel(words: list[str], codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), table.shape[1]))
    for some, code, value in _subsequences(words):
        at, value = _known(codes, code, value)
        for i in range(0, len(some), ROWS):
            out[some[i : i + ROWS]] = _likeness(at[i : i + ROWS], value[i : i + ROWS], table)
    return out


def _hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1e-6, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine, accelerated gradient."""
    now = ahead = np.zeros(x.shape[1] + 1)
    step = 1 / (2 * max(1e-9, np.linalg.eigvalsh((x * cost[:, None]).T @ x)[-1] + cost.sum()) + penalty)
    for turn in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * cost * y * short
        new = ahead - step * np.append(x.T @ pull + penalty * ahead[:-1], pull.sum())
        ahead, now = new + turn / (turn + 3) * (new - now), new
    return now[:-1], float(now[-1])


def contexts(text: str | None) -> set[tuple[str, int]]:
    """The units of a text with the words around them, as a hash; spelled-out runs have none."""
    words = [x.strip(MARKS) for x in (text or "").lower().split()]
    around = {(b, xxhash.xxh3_64_intdigest(f"{a} {c}") >> 1) for a, b, c in zip(["", *words], words, [*words[1:], ""])}
    return around | {(x, 0) for x in units(text).difference(words)}


def _sample_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("unit", pa.string()), ("around", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "text"):
            found = [[{"unit": u, "around": k} for u, k in sorted(contexts(x))] for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(found, kind)], ["doc_id", "label", "units"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 5) -> Machine:
    """Machine from labelled documents whose crc32(doc_id as text) mod held_out is not 0. labels has
    (doc_id, toxic); of rows that contradict each other toxic counts."""
    number = F.crc32(F.col("doc_id").cast("string"))
    one = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(number % held_out != 0)
    chosen = sampled(one.groupBy("doc_id").agg(F.max("toxic").alias("label")), "doc_id", sample, "toxic")
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("label").cast("long").alias("label"))
    found = found.mapInArrow(_sample_units, "doc_id long, label long, units array<struct<unit: string, around: long>>").persist()
    used = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(4)) != 3
    fitted = found.filter(used)
    totals = {x["label"]: x["n"] for x in fitted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = fitted.select("label", F.explode(F.array_distinct("units.unit")).alias("unit"))
    counts = held.groupBy("unit").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    # Copies of a toxic text hold a unit among the same words: they count once.
    around = fitted.filter("label = 1").select(F.inline("units")).groupBy("unit").agg(F.countDistinct("around").alias("around"))
    counts = counts.join(around, "unit", "left").select("unit", F.least("t", F.coalesce("around", "t")).alias("t"), "c")
    likely = counts.filter(F.col("t") >= LEAST).orderBy(F.desc(F.col("t") / (F.col("c") + 1)), "unit").limit(2 * POSITIVES)
    often = counts.filter("c > 0").orderBy(F.desc("c"), "unit").limit(POOL // 2)
    other = counts.filter("c > 0").orderBy(F.xxhash64("unit"), "unit").limit(POOL // 2)
    rows = likely.union(often).union(other).distinct().orderBy("unit").collect()  # bounded by the limits
    machine = fit([(x["unit"], x["t"], x["c"]) for x in rows], totals.get(1, 0), totals.get(0, 0))
    rest = found.filter(~used).mapInArrow(_text_sums(machine), "label long, margin double, n long").collect()  # bounded by sample
    rest = np.array(sorted((x["label"], x["margin"], x["n"]) for x in rest), np.float64).reshape(-1, 3)
    if len(set(rest[:, 0])) == 2 and len(machine.codes):
        machine.weights = calibration(rest[:, 1], rest[:, 2], rest[:, 0])
    found.unpersist()
    return machine


def _text_sums(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [{u["unit"] for u in x} for x in batch.column("units").to_pylist()]
            sums, n = [sum(machine.unit_margins(sorted(x))) for x in texts], [len(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sums, pa.float64()), pa.array(n, pa.int64())], ["label", "margin", "n"])

    return run


def _scored(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = {}, {}  # margins of the units met lately: of the last two lots of KEPT
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                texts = [units(x) for x in part.column("text").to_pylist()]
                cache = {x: y for x in set().union(*texts) if (y := now.get(x, old.get(x))) is not None}
                new = list(set().union(*texts) - cache.keys())
                cache.update(zip(new, machine.unit_margins(new)))
                if len(now) > KEPT:
                    now, old = {}, now
                now |= cache
                sums = np.array([math.fsum(map(cache.__getitem__, x)) for x in texts])
                score = machine.scores(sums, np.array([len(x) for x in texts]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*part.schema.names, "score", "predicted"]
                )

    return run


def toxicity_scores(documents: DataFrame, machine: Machine) -> DataFrame:
    """Every row of documents with score (0 to 1) and predicted (1 if score is at least 0.5). A
    null or empty text has no units, so it scores low. Columns of these names are replaced."""
    documents = documents.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(_scored(machine), f"{schema}, score double, predicted int")
