"""Reading level of each document: boosted regression trees over what its text looks like."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.boosting import BoostedTrees
from relgraph.sources.scratch import materialize

LEVELS = (1, 2, 3, 4, 5)
#: The model is fitted on at most so many rated documents, chosen by a hash of their id; ratings beyond are not used.
MOST_RATED = 8000
FOLDS = 5
#: Words of the learned vocabulary stand in at least so many rated documents.
LEAST_DOCS = 3
#: Words of a window over which a text's local difficulty is taken.
WINDOW = 20

_TAG = re.compile(r"<[^<>]{1,200}>")
_URL = re.compile(r"\b(?:https?://|www\.)\S+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_STOP = re.compile(r"[.!?;:\n\r]+")
_NUMBER = re.compile(r"\d+")
_VOWELS = re.compile(r"[aeiouyäöüáéíóú]+")

# English function words by what they do in a sentence.
SUBORDINATORS = frozenset("because although though since unless whereas while when whenever if until after before that which who whom whose where provided insofar albeit lest notwithstanding".split())
CONNECTIVES = frozenset("and but or so then however therefore moreover thus hence furthermore nevertheless consequently also first second finally next instead otherwise meanwhile accordingly thereby".split())
PREPOSITIONS = frozenset("of in on at by for with from to into over under between among through during against without within despite upon regarding concerning pursuant irrespective".split())
PRONOUNS = frozenset("i you he she it we they me him her us them my your his its our their this these those who".split())
BE = frozenset("is are was were be been being am has have had".split())
SUFFIXES = ("tion", "sion", "ment", "ity", "ness", "ance", "ence", "ism", "ology")

FEATURES = (
    "word_length", "word_length_sd", "word_length_p90", "long7", "long10", "long13", "syllables", "sentence_length", "sentence_length_p90",
    "window_ttr", "nominal", "commas", "subordinators", "connectives", "prepositions", "pronouns", "be_ed", "numbers", "ly_words",
    "overlap", "overlap_sd", "known_share", "level_mean", "level_sd", "level_p10", "level_p50", "level_p90", "window_mean", "window_p10", "window_p50", "window_p90", "window_high",
)


def _cleaned(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    return _URL.sub(" ", _TAG.sub(" ", text))


def tokens(text: str) -> list[str]:
    """Lower-case words of a text, without markup and addresses."""
    return _WORD.findall(_cleaned(text).lower())


def _spread(values: list[float]) -> tuple[float, float, float, float, float]:
    """Mean, standard deviation and the 10th, 50th and 90th percentiles."""
    a = np.sort(np.asarray(values, dtype=float))
    last = len(a) - 1
    return a.mean(), a.std(), a[int(0.1 * last + 0.5)], a[int(0.5 * last + 0.5)], a[int(0.9 * last + 0.5)]


def features(text: str, lexicon: dict[str, float], middle: float) -> list[float]:
    """Length, vocabulary, syntax and cohesion of one text, in the order of FEATURES.

    All are shares, means and spreads, so that the length of the text as such does not make it harder.
    """
    clean = _cleaned(text)
    low = clean.lower()
    words = _WORD.findall(low)
    n = len(words)
    if n == 0:
        return [0.0] * 22 + [middle, 0.0] + [middle] * 7 + [0.0]
    counts = Counter(words)
    lengths = _spread([len(w) for w in words])
    runs = _spread([k for k in (len(_WORD.findall(x)) for x in _STOP.split(low)) if k])
    starts = range(0, max(1, n - WINDOW // 2), WINDOW)
    windows = [words[i : i + WINDOW] for i in starts]
    longer = [0, 0, 0]
    syllables = nominal = ly = 0
    kinds = [0, 0, 0, 0]
    for w, c in counts.items():
        k = len(w)
        if k >= 7:
            longer[0] += c
            if k >= 10:
                longer[1] += c
                if k >= 13:
                    longer[2] += c
        syllables += len(_VOWELS.findall(w)) * c
        if w.endswith(SUFFIXES):
            nominal += c
        if w.endswith("ly"):
            ly += c
        for i, words_of in enumerate((SUBORDINATORS, CONNECTIVES, PREPOSITIONS, PRONOUNS)):
            if w in words_of:
                kinds[i] += c
    sets = [{w for w in x if len(w) > 3} for x in windows]
    overlaps = _spread([len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(sets, sets[1:])] or [0.0])
    ed = sum(1 for a, b in zip(words, words[1:]) if a in BE and b.endswith("ed"))
    known = [lexicon.get(w) for w in words]
    told = [v for v in known if v is not None]
    levels = _spread(told or [middle])
    around = []
    for i in starts:
        here = [v for v in known[i : i + WINDOW] if v is not None]
        around.append(sum(here) / len(here) if here else middle)
    local = _spread(around)
    return [
        lengths[0], lengths[1], lengths[4], longer[0] / n, longer[1] / n, longer[2] / n, syllables / n, runs[0], runs[4],
        sum(len(set(x)) / len(x) for x in windows) / len(windows), nominal / n, clean.count(",") / n, kinds[0] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, ed / n, len(_NUMBER.findall(clean)) / n, ly / n,
        overlaps[0], overlaps[1], len(told) / n, *levels, local[0], *local[2:], sum(1 for v in around if v > middle) / len(around),
    ]


class Lexicon:
    """Mean level of the rated documents that use a word, drawn towards the overall mean where they are few.

    Counts are kept by fold, so that a fold's documents can be told by the ratings of the other folds alone. A word is
    known if at least LEAST_DOCS of the documents that count use it.
    """

    def __init__(self, middle: float, words: list[str], folds: np.ndarray, seen: np.ndarray, mass: np.ndarray, total: np.ndarray):
        self.middle, self.places = middle, {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.array([self.places[w] for w in words], dtype=np.int64)
        shape = (len(self.places), FOLDS)
        self.seen, self.mass, self.total = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for table, values in ((self.seen, seen), (self.mass, mass), (self.total, total)):
            np.add.at(table, (at, folds), values)

    def without(self, fold: int | None) -> dict[str, float]:
        """Word -> level, from all folds but one."""
        kept = np.ones(FOLDS, dtype=bool)
        if fold is not None:
            kept[fold] = False
        seen, mass, total = (t[:, kept].sum(1) for t in (self.seen, self.mass, self.total))
        level = self.middle + total / (mass + 2.0)
        return {w: float(level[i]) for w, i in self.places.items() if seen[i] >= LEAST_DOCS}


def learned_lexicon(sample: DataFrame, middle: float) -> Lexicon:
    """The lexicon of rated documents (text, fold, target, weight), counted in the workers.

    What comes to the driver is one row for each word and fold, of words that LEAST_DOCS documents use.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[tuple[str, int], list[float]] = {}
            for text, fold, y, w in zip(pdf["text"], pdf["fold"], pdf["target"], pdf["weight"]):
                for t in set(tokens(text)):
                    r = rows.setdefault((t, fold), [0.0, 0.0, 0.0])
                    r[0] += 1
                    r[1] += w
                    r[2] += (y - middle) * w
            yield pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=["word", "fold", "seen", "mass", "total"])

    per = sample.select("text", "fold", "target", "weight").mapInPandas(count, "word string, fold int, seen double, mass double, total double")
    per = per.groupBy("word", "fold").agg(*[F.sum(c).alias(c) for c in ("seen", "mass", "total")])
    known = per.groupBy("word").agg(F.sum("seen").alias("n")).where(F.col("n") >= LEAST_DOCS).select("word")
    pdf = per.join(known, "word", "left_semi").toPandas().sort_values(["word", "fold"])
    return Lexicon(middle, list(pdf["word"]), *(pdf[c].to_numpy() for c in ("fold", "seen", "mass", "total")))


def _cuts(score: np.ndarray, level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Borders between levels that make the scores agree with the ratings most often; near the midpoints if few tell."""
    cuts = np.array([1.5, 2.5, 3.5, 4.5])
    grid = np.arange(-0.4, 0.41, 0.02)
    for i in range(len(cuts)):
        best = None
        for g in grid:
            c = i + 1.5 + g
            near = (level >= i + 0.75) & (level <= i + 2.25)
            right = np.where(score[near] >= c, level[near] >= i + 1.5, level[near] < i + 1.5)
            value = (weight[near] * right).sum() - 5.0 * g * g
            if best is None or value > best[0] + 1e-9:
                best = (value, c)
        cuts[i] = best[1]
    return np.maximum.accumulate(cuts)


class ReadingModel:
    """Boosted trees, the learned vocabulary and the calibrated borders between levels."""

    def __init__(self, lexicon: dict[str, float], middle: float, trees: BoostedTrees | None, cuts: np.ndarray):
        self.lexicon, self.middle, self.trees, self.cuts = lexicon, middle, trees, cuts

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.middle)
        if not texts:
            return np.empty(0)
        return self.trees.predict(np.array([features(t, self.lexicon, self.middle) for t in texts]))

    def level(self, score: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, score, side="right")


def _folds(sources: list[str]) -> list[int]:
    """A fold for each source, largest sources first, each into the emptiest fold."""
    per = Counter(sources)
    loads, fold_of = [0] * FOLDS, {}
    for s, n in sorted(per.items(), key=lambda x: (-x[1], x[0])):
        fold_of[s] = loads.index(min(loads))
        loads[fold_of[s]] += n
    return [fold_of[s] for s in sources]


def fit(x: np.ndarray, fold: np.ndarray, target: np.ndarray, weight: np.ndarray, middle: float) -> tuple[BoostedTrees, np.ndarray, np.ndarray, np.ndarray]:
    """(trees, borders between levels, scores as predicted without a document's own source, documents kept).

    Documents whose rating lies far from what the other folds predict are taken for slips of the rater and leave the
    final fit: more than 1.25 levels off, and more than three times as far as the middle one.
    """
    make = lambda: BoostedTrees(trees=120, depth=3, least_weight=3.0)
    score = np.full(len(target), middle)
    for k in range(FOLDS):
        inside, outside = fold == k, fold != k
        if inside.any() and outside.any():
            score[inside] = make().fit(x[outside], target[outside], weight[outside]).predict(x[inside])
    off = np.abs(score - target)
    kept = off <= max(1.25, 3 * float(np.median(off)))
    return make().fit(x[kept], target[kept], weight[kept]), _cuts(score, target, weight), score, kept


def rated_sample(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """At most MOST_RATED rated documents with text: doc_id, text, source, target (mean rating), raters.

    Ratings outside the scale and null ratings do not count; repeated ratings by one rater count once. The sample is the
    one bound on the labelled rows: which documents are in it a hash of their id decides.
    """
    per = (
        ratings.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(LEVELS[0], LEVELS[-1]))
        .select("doc_id", "rater", "reading_level")
        .distinct()
        .groupBy("doc_id")
        .agg(F.avg("reading_level").alias("target"), F.count(F.lit(1)).alias("raters"))
    )
    texts = docs.where(F.col("text").isNotNull())
    ids = texts.select(F.col("doc_id").cast("long").alias("doc_id")).join(per, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_RATED)
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("source", F.lit("")).alias("source")).join(F.broadcast(ids), "doc_id")


def fit_on(docs: DataFrame, ratings: DataFrame) -> tuple[ReadingModel, pd.DataFrame]:
    """The model, and the rated sample with cross-validated score and level.

    Sources fall into folds; the vocabulary that a document is measured by is learned from the other folds, for the
    training features too, so no document's own rating reaches its features. Texts stay in the workers: counts of words
    and one row of features a document come to the driver. Without ratings every text gets level 3.
    """
    spark = docs.sparkSession
    held = materialize(rated_sample(docs, ratings)).df
    sample = held.drop("text").toPandas().sort_values("doc_id", ignore_index=True)
    if len(sample) == 0:
        return ReadingModel({}, 3.0, None, np.array([1.5, 2.5, 3.5, 4.5])), sample.assign(score=[], level=[])
    target, weight = sample["target"].to_numpy(float), np.sqrt(sample["raters"].to_numpy(float))
    sample["fold"], middle = _folds(list(sample["source"])), float(np.average(target, weights=weight))
    marks = spark.createDataFrame(sample[["doc_id", "fold"]].drop_duplicates("doc_id").astype({"fold": "int32"}))
    rows = held.join(F.broadcast(marks), "doc_id").withColumn("weight", F.sqrt("raters"))
    lexicon = learned_lexicon(rows, middle)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(lexicon))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = cloudpickle.loads(shared.value)
        views: dict[int, dict[str, float]] = {}
        for pdf in batches:
            x = [features(t, views[k] if k in views else views.setdefault(k, known.without(k)), middle) for t, k in zip(pdf["text"], pdf["fold"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": x})

    measured = rows.select("doc_id", "text", "fold").mapInPandas(measure, "doc_id long, x array<double>").toPandas()
    at = dict(zip(measured["doc_id"], measured["x"]))
    x = np.array([at[k] for k in sample["doc_id"]])
    trees, cuts, score, kept = fit(x, sample["fold"].to_numpy(), target, weight, middle)
    if not kept.all():
        # The words of documents that left count no more.
        gone = spark.createDataFrame(sample.loc[~kept, ["doc_id"]])
        lexicon = learned_lexicon(rows.join(F.broadcast(gone), "doc_id", "left_anti"), middle)
    model = ReadingModel(lexicon.without(None), middle, trees, cuts)
    return model, sample.assign(score=score, level=model.level(score))


def reading_levels(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Level of every English or unlabelled document with a letter in its text: doc_id (long), reading_level (int).

    docs: doc_id, text, lang, source; ratings: doc_id, rater, reading_level. A null or letterless text and a document in
    another language get no row. Levels lie on the scale of the ratings, for unrated documents too; without any rating,
    3. Repeated rows come out once. Whole texts are read. The model is broadcast: trees, borders, and the vocabulary of the
    rated sample of at most MOST_RATED documents.
    """
    model, _ = fit_on(docs, ratings)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = cloudpickle.loads(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "reading_level": m.level(m.score(list(pdf["text"])))})

    wanted = docs.where((F.col("lang").isNull() | (F.col("lang") == "en")) & F.col("text").rlike(r"\p{L}"))
    return wanted.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(predict, "doc_id long, reading_level int").distinct()


def cross_validation(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Agreement per source when its documents are predicted without it: source, n_documents, exact, within_one, mean_error."""
    _, cv = fit_on(docs, ratings)
    truth = cv["target"].round()
    cv = cv.assign(exact=(cv["level"] == truth).astype(float), within_one=((cv["level"] - truth).abs() <= 1).astype(float), mean_error=(cv["score"] - cv["target"]).abs())
    out = cv.groupby("source", as_index=False).agg(n_documents=("doc_id", "size"), exact=("exact", "mean"), within_one=("within_one", "mean"), mean_error=("mean_error", "mean"))
    return docs.sparkSession.createDataFrame(out, "source string, n_documents long, exact double, within_one double, mean_error double")
