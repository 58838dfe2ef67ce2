"""Toxicity: a counterfactually regularised linear classifier.

A text is its set of distinct lower-cased words; a word brings its own feature and the
5-grams of its letters, so inflected forms share evidence.  Spark counts the features
of the labelled rows by class and keeps the most telling ones; sparse logistic regression
on them is fitted with a penalty on counterfactual score changes: wherever an identity
term stands in a labelled sentence, swapping it for another term of its group, or for
a neutral word, must not move the score.  Terms of no labelled sentence are held still
by template sentences.  Scores are sums over distinct words, so a
task remembers a word's weight and reads every text once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm._common import durable, name, text_blocks

WORD = re.compile(r"[^\W\d_]+")
GRAM = 5
#: Feature hashes are 32 bits wide; words that a task remembers.
MEMORY, BLOCK = 700_000, 4 << 20
#: Groups of identity terms (a parameter of ``fit``), in the corpus's four languages; a term is swapped within its group, and for a neutral word without features.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("femmes", "hommes", "filles", "garçons"), ("frauen", "männer", "mädchen", "jungen"), ("mujeres", "hombres", "niñas", "niños"),
    ("black", "white", "asian", "latino"), ("noirs", "blancs", "asiatiques", "arabes"), ("schwarze", "weiße", "asiaten", "araber"), ("negros", "blancos", "asiáticos", "árabes"),
    ("muslim", "christian", "jewish", "hindu"), ("musulmans", "chrétiens", "juifs", "hindous"), ("muslime", "christen", "juden", "hindus"), ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("gay", "lesbian", "straight", "transgender"), ("gays", "lesbiennes", "hétérosexuels", "transgenres"), ("schwule", "lesben", "heterosexuelle", "transgeschlechtliche"), ("homosexuales", "lesbianas", "heterosexuales", "transexuales"),
    ("immigrant", "refugee", "native", "foreign"), ("immigrés", "réfugiés", "autochtones", "étrangers"), ("einwanderer", "flüchtlinge", "einheimische", "ausländer"), ("inmigrantes", "refugiados", "nativos", "extranjeros"),
    ("disabled", "deaf", "blind", "elderly"), ("handicapés", "sourds", "aveugles", "aînés"), ("behinderte", "gehörlose", "blinde", "senioren"), ("discapacitados", "sordos", "ciegos", "ancianos"),
)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[int]:
    """The word's own feature, then those of its 5-grams (with word ends)."""
    framed = f"^{word}$"
    grams = {framed[i : i + GRAM] for i in range(max(1, len(framed) - GRAM + 1))}
    return [xxhash.xxh32_intdigest("w" + word), *(xxhash.xxh32_intdigest("g" + g) for g in grams)]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    info: dict = field(default_factory=dict)
    groups: tuple[tuple[str, ...], ...] = IDENTITY

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in set(features_of(word)))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + sum(map(self.word, words_of(text)))))))


    def swapped(self, words: set[str]) -> list[tuple[float, float]]:
        """(sum before, sum after) of every counterfactual of a text's distinct words."""
        out, before = [], None
        for group in self.groups:
            for a in words.intersection(group):
                if before is None:
                    before = self.bias + math.fsum(map(self.word, words))
                for b in (*group, None):
                    if b != a:
                        out.append((before, before - self.word(a) + (self.word(b) if b and b not in words else 0.0)))
        return out

    def gap(self, words: set[str]) -> float:
        """The largest change of the score by a swap of one identity term; 0 for a text without any."""
        squash = lambda x: 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
        return max((abs(squash(a) - squash(b)) for a, b in self.swapped(words)), default=0.0)


def sample_rows(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at the most, chosen by a hash of the key; all of them if there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(name(key)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def count_features(rows: DataFrame, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> DataFrame:
    """label, ids (features), counts (distinct words with the feature), terms (identity terms)."""
    terms = {t for g in groups for t in g}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for first, texts in text_blocks(batch.column(1), BLOCK):
                ids, counts, held = [], [], []
                for text in texts:
                    words, own = words_of(text), []
                    for w in words:
                        if (f := known.get(w)) is None:
                            f = known[w] = features_of(w)
                        own += f
                    values, n = np.unique(np.array(own, np.int64), return_counts=True)
                    ids.append(values)
                    counts.append(n)
                    held.append(sorted(words & terms))
                if len(known) > MEMORY:
                    known = {}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.string()))],
                    ["label", "ids", "counts", "terms"],
                )

    return rows.select(F.col("label").cast("int"), "text").mapInArrow(count, "label int, ids array<long>, counts array<long>, terms array<string>")


def choose_features(counted: DataFrame, most: int, least_docs: int) -> list[int]:
    """The features whose document frequencies differ most between the classes (z of two proportions)."""
    totals = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    if not totals.n:
        return []
    n, pos = float(totals.n), float(totals.pos)
    held = counted.select("label", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    share = F.col("n") / n
    apart = F.col("pos") / max(pos, 1.0) - (F.col("n") - F.col("pos")) / max(n - pos, 1.0)
    z = F.abs(apart) / F.sqrt(share * (1 - share) + 1.0 / n)
    return [r.id for r in held.where(F.col("n") >= least_docs).select("id", z.alias("z")).orderBy(F.desc("z"), "id").limit(most).collect()]


def fit(
    rows: DataFrame,
    *,
    most_features: int = 4096,
    least_docs: int = 5,
    l1: float = 3e-4,
    l2: float = 1e-5,
    fairness: float = 1.0,
    steps: int = 400,
    groups: tuple[tuple[str, ...], ...] = IDENTITY,
    template_weight: float = 1.0,
) -> Model:
    """Fit on ``rows`` (label 0/1, text), a bounded sample: their chosen features go to the driver.

    Every labelled sentence with an identity term of ``groups`` gives its counterfactuals,
    one for each other term of the group and one without the term; ``fairness`` weighs the
    mean squared score change over all of them.  A term that no labelled sentence has
    counts as ``template_weight`` template sentences that hold it beside words without
    features, so the penalty covers it too.  Repeated rows count as often as they stand
    there, texts of any length are read whole, null texts are empty.  Without both classes
    (an empty table among others) the model is a constant.
    """
    counted = durable(count_features(rows, groups))
    chosen = choose_features(counted, most_features, least_docs)
    terms = [t for g in groups for t in g]
    for w in terms:
        chosen.append(features_of(w)[0])
    place = {f: i for i, f in enumerate(dict.fromkeys(chosen))}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, counts in zip(batch.column(1), batch.column(2), strict=True):
                own = [(place[f], c) for f, c in zip(ids.as_py(), counts.as_py(), strict=True) if f in place]
                out.append(np.array(own, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(3)], ["label", "own", "terms"])

    data = counted.mapInArrow(pick, "label int, own binary, terms array<string>").toArrow()
    y = data["label"].to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return Model({}, 0.0 if not len(y) else (5.0 if y[0] else -5.0), groups=groups)
    own = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in data["own"].to_pylist()]
    row = np.repeat(np.arange(len(y)), [len(x) for x in own])
    col, value = np.concatenate(own).T
    scale = np.sqrt(np.bincount(col, value.astype(float) ** 2, len(place)) / len(y))
    scale[scale == 0] = 1.0  # identity terms that no sentence has
    value = value / scale[col]
    seen = Counter(s for found in data["terms"].to_pylist() for s in counterfactuals(set(found), groups))
    unseen = set(terms) - {a for a, _, _ in seen}
    for a in unseen:
        for s in counterfactuals({a}, groups):
            seen[s] += template_weight
    swaps = _swaps(seen, place, scale)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[col], len(y))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, value * r[row], len(place))

    v = np.ones(len(place))
    for _ in range(15):  # the largest curvature, for the step size
        v /= np.linalg.norm(v)
        v = back(times(v)) / len(y)
    # a bound on the curvature, by coordinate: only identity terms take the short steps of the penalty
    curve = 0.25 * np.linalg.norm(v) + 0.25 + l2 + 2 * fairness * (np.abs(swaps).T @ np.abs(swaps).sum(axis=1))
    w, look, momentum, bias, look_bias = np.zeros(len(place)), np.zeros(len(place)), 1.0, 0.0, 0.0
    for _ in range(steps):  # accelerated proximal gradient descent
        error = 1 / (1 + np.exp(-np.clip(times(look) + look_bias, -500, 500))) - y
        slope = back(error) / len(y) + l2 * look + 2 * fairness * (swaps.T @ (swaps @ look))
        new, new_bias = look - slope / curve, look_bias - error.mean() / curve.min()
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0.0)
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        look, look_bias = new + (momentum - 1) / after * (new - w), new_bias + (momentum - 1) / after * (new_bias - bias)
        w, bias, momentum = new, new_bias, after
    info = {
        "rows": len(y), "positive": int(y.sum()), "curvature": float(curve.max()), "slope": float(np.abs(slope).max()),
        "sentences_with_terms": sum(map(bool, data["terms"].to_pylist())), "terms_by_template": len(unseen), "mean_swap": float(np.sqrt(((swaps @ w) ** 2).sum())),
    }
    return Model({f: float(w[i] / scale[i]) for f, i in place.items() if w[i]}, float(bias), info, groups)


def counterfactuals(found: set[str], groups: tuple[tuple[str, ...], ...]) -> Iterator[tuple[str, str | None, bool]]:
    """(term, its replacement or None, whether the sentence has that already) of a sentence with the identity terms ``found``.

    A sentence's score is a sum over its distinct words, so these tell its whole change.
    """
    for group in groups:
        for a in found.intersection(group):
            for b in (*group, None):
                if b != a:
                    yield a, b, b in found


def _swaps(seen: dict[tuple[str, str | None, bool], float], place: dict[int, int], scale: np.ndarray) -> np.ndarray:
    """A row for each kind of swap: the change of the scaled features, times the root of the swap's share."""
    total, out = sum(seen.values()), []
    for (a, b, there), n in sorted(seen.items(), key=repr):
        delta = np.zeros(len(place))
        for word, sign in ((b, 1.0), (a, -1.0)) if b and not there else ((a, -1.0),):
            for f in set(features_of(word)):
                if f in place:
                    delta[place[f]] += sign / scale[place[f]]
        out.append(delta * math.sqrt(n / total))
    return np.array(out)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and swap_gap (largest score change by a swap of one identity term), a row for each row of ``docs``.

    Null counts as the empty text, texts of any length are read whole, repeated rows
    are scored each, an empty table gives no rows; other columns, whatever their names,
    are not read.
    """
    terms = {t for g in model.groups for t in g}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Known(dict):
            def __missing__(self, word: str) -> float:
                self[word] = value = model.word(word)
                return value

        known = Known()
        for batch in batches:
            for first, texts in text_blocks(batch.column(1), BLOCK):
                get = known.__getitem__
                split = [words_of(t) for t in texts]
                sums = np.array([math.fsum(map(get, words)) for words in split])
                scores = 1 / (1 + np.exp(-np.clip(sums + model.bias, -500, 500)))
                gaps = [0.0 if terms.isdisjoint(words) else model.gap(words) for words in split]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(scores), pa.array(gaps, pa.float64())], ["doc_id", "score", "swap_gap"])
                if len(known) > MEMORY:
                    known = Known()

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("swap_gap", T.DoubleType())])
    return docs.select(name(key), name(text).cast("string")).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 12_000) -> DataFrame:
    """label, text of about ``most`` labelled rows at the most (rows with a null label or key take no part).

    A doc_id that stands in several rows of ``docs`` or ``labels`` gives a row for each pair.
    """
    known = labels.select(name(key).alias("id"), name(label).cast("int").alias("label")).where("id is not null and label is not null")
    known = durable(sample_rows(known, "id", most))
    return docs.join(F.broadcast(known), name(key) == F.col("id")).select("label", name(text).cast("string").alias("text"))


