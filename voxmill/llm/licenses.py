"""Licence scans: a trained paragraph classifier over word n-grams, confirmed by templates.

A paragraph ends at an empty line (or one of comment marks only) and at a line that ends a sentence, so
a notice that is wrapped over lines is read as a whole. Its features are word n-grams (one to three
words) of the notices in ``licence_texts``. A sparse multinomial logistic regression gives each class a
weight per n-gram; besides the licence families there are the classes ``unknown`` (a licence notice of
no known family) and ``none``. Probabilities are calibrated by one temperature, fitted on references that
were not trained on; a family is only believed from a probability on that keeps licences apart which
belong to no family and were not trained on. It must also be confirmed: the paragraph holds enough of
the word n-grams of one of the family's templates. Other notices are reported as ``unknown``.

The weights themselves say which paragraphs can be a notice at all: those with an n-gram that speaks
more for some licence class than for ``none``. Each such n-gram is looked for by its rarest word, and
only paragraphs with one of these words are scored; no other could have been predicted as a notice.

Scanning is made of built-in expressions over whole texts of any length, with no Python; only the
paragraphs that can be a notice are written and shuffled. A null or empty text has no
paragraphs. Of classes that are equally likely the first in the model's order is predicted. Repeated
rows give repeated results; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import licence_texts as texts
from .common import materialize

NONE, UNKNOWN = "none", "unknown"
WORD = "[a-z]+[0-9]*|[0-9]+"
PARAGRAPH_END = r"""\n(?:[ \t]*[#*/;%]*[ \t]*\r?\n)+|(?<=[.!?])["')]*[ \t]*\r?\n"""
#: Share of a template's n-grams that a paragraph must hold to confirm its family.
CONFIRMED_AT = 0.5
#: Paragraphs without a notice that one notice may have between its paragraphs.
GAP = 2
#: Among the licences of no family that calibrate, so many may still be taken for one.
STRANGERS_BELIEVED = 0.1


def grams_of(paragraph: str) -> list[str]:
    """The distinct word n-grams of a text, as ``paragraph_grams`` finds them."""
    words = re.findall(WORD, paragraph.lower())
    return sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def paragraph_grams(paragraph: Column) -> Column:
    """The distinct n-grams of one to three words of a paragraph."""
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(f"({WORD})"), 1)
    two = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    three = F.zip_with(F.slice(two, 1, F.greatest(F.size(two) - 1, F.lit(0))), F.slice(words, 3, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, two, three))


def references(frames: list[str]) -> list[tuple[str, str]]:
    """(family, text) of short references."""
    return [(family, frame.format(name)) for family, names in texts.NAMES.items() for name in names for frame in frames]


def with_halves(text: str) -> list[str]:
    """A text, and each half of its words if it is long."""
    words = text.split(" ")
    half = len(words) // 2
    return [text] if len(words) < 12 else [text, " ".join(words[:half]), " ".join(words[half:])]


def training_texts() -> list[tuple[str, str]]:
    """(class, text) of everything that the model is trained on."""
    notices = [(family, part) for family, paragraphs in texts.NOTICES.items() for notice in paragraphs for part in with_halves(notice)]
    strange = [part for text in texts.STRANGE for part in with_halves(text)] + [frame.format(name) for frame in texts.FRAMES for name in texts.INVENTED]
    strange += [frame.format(holder) for frame in texts.RIGHTS for holder in texts.HOLDERS]
    prose = [frame.format(trap) for trap in texts.TRAPS for frame in texts.SENTENCES] + texts.PROSE
    headings = [(family, heading) for family, many in texts.HEADINGS.items() for heading in many]
    return notices + headings + references(texts.FRAMES) + [(UNKNOWN, text) for text in strange] + [(NONE, text) for text in prose]


def templates() -> dict[str, list[list[str]]]:
    """The n-grams of two and three words of each family's notices, headings and references, of which a reference's hold a word of its name.

    A heading of one word that only licences have is a template of its own.
    """
    found = {}
    for family, paragraphs in texts.NOTICES.items():
        whole = [[g for g in grams_of(text) if " " in g or " " not in text] for text in paragraphs + texts.HEADINGS[family]]
        named = []
        for name in texts.NAMES[family]:
            own = set(re.findall(WORD, name.lower())) - texts.FUNCTION_WORDS
            named += [[g for g in grams_of(frame.format(name)) if " " in g and own & set(g.split(" "))] for frame in ("under {}", "SPDX-License-Identifier: {}")]
        found[family] = [own for own in whole + named if own]
    return found


@dataclass(frozen=True)
class LicenceModel:
    """Weights per class for the n-grams that have any, the temperature of the probabilities, and from where on a family is believed."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]
    temperature: float
    believed_at: float

    def triggers(self) -> list[str]:
        """Words of which a paragraph must have one to be predicted as anything but ``none``."""
        none = self.classes.index(NONE)
        if any(own > self.intercepts[none] for own in self.intercepts):
            raise ValueError("a text without n-grams must be no notice")
        common = Counter(word for name, text in training_texts() if name == NONE for word in set(re.findall(WORD, text.lower())))
        words: set[str] = set()
        speaking = [gram for gram, own in self.weights.items() if max(own) > own[none]]
        for gram in sorted(speaking, key=lambda g: (g.count(" "), g)):
            own = gram.split(" ")
            if not words & set(own):
                words.add(min(own, key=lambda word: (word in texts.FUNCTION_WORDS or word.isdigit(), common[word], -len(word), word)))
        return sorted(words)


def trigger_pattern(words: list[str]) -> str:
    """A pattern that finds any of ``words`` as a whole word; words are grouped by their first letter."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:] + ("(?![0-9])" if word[-1].isdigit() else "(?![a-z0-9])"))
    return "(?i)(?<![a-z])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(groups.items())) + ")"


def fit_licences(spark: SparkSession, l1: float = 0.0015, temperatures: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)) -> LicenceModel:
    """Train on the fixed texts; their number is fixed, so nothing here grows with the corpus."""
    rows = training_texts()
    classes = (*texts.NOTICES, UNKNOWN, NONE)
    spoken = {g for name, text in rows if name != NONE for g in grams_of(text)}
    vocabulary = sorted(g for g in spoken if not all(word in texts.FUNCTION_WORDS or word.isdigit() for word in g.split(" ")))
    vectoriser = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=0.0).setBinary(True)

    def vectors(some: list[tuple[str, str]]) -> DataFrame:
        frame = spark.createDataFrame([(float(classes.index(name)), grams_of(text)) for name, text in some], "label double, grams array<string>")
        return materialize(vectoriser.transform(frame.coalesce(1)).select("label", "features"))

    model = LogisticRegression(family="multinomial", elasticNetParam=0.8, regParam=l1, maxIter=60).fit(vectors(rows))
    held = model.transform(vectors(references(texts.HELD_FRAMES) + [(UNKNOWN, text) for text in texts.LEFT_OUT]))
    judged = [(int(row["label"]), row["logits"]) for row in held.select("label", vector_to_array("rawPrediction").alias("logits")).collect()]

    def probabilities(logits: list[float], temperature: float) -> list[float]:
        powers = [math.exp((x - max(logits)) / temperature) for x in logits]
        return [power / sum(powers) for power in powers]

    def loss(temperature: float) -> float:
        return -sum(math.log(max(probabilities(logits, temperature)[label], 1e-12)) for label, logits in judged)

    temperature = min(temperatures, key=loss)
    unknown = classes.index(UNKNOWN)
    strange = sorted(max(p for i, p in enumerate(probabilities(logits, temperature)) if i < unknown) for label, logits in judged if label == unknown)
    believed_at = max(0.5, strange[max(0, int(len(strange) * (1 - STRANGERS_BELIEVED)) - 1)])
    matrix = model.coefficientMatrix.toArray()
    weights = {gram: tuple(map(float, matrix[:, j])) for j, gram in enumerate(vocabulary) if abs(matrix[:, j]).max() > 1e-9}
    return LicenceModel(classes, weights, tuple(map(float, model.interceptVector.toArray())), temperature, min(believed_at, 0.95))


def scored_paragraphs(docs: DataFrame, model: LicenceModel, gated: bool = True) -> DataFrame:
    """row, doc_id, paragraph, notice, predicted, probability, similarity, confirmed of every paragraph that is predicted as a notice.

    ``row`` tells rows apart that repeat a doc_id. Without ``gated`` every paragraph is scored. N-grams meet
    the weights and the templates in joins with these tables of a fixed size.
    """
    spark = docs.sparkSession
    columns = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pattern = trigger_pattern(model.triggers()) if gated else ""
    lines = columns.where(F.col("text").rlike(pattern)).select("row", "doc_id", F.posexplode(F.split("text", PARAGRAPH_END)).alias("paragraph", "notice"))
    lines = materialize(lines.where(F.col("notice").rlike(pattern)))
    grams = lines.select("row", "paragraph", F.explode(paragraph_grams(F.col("notice"))).alias("gram"))

    names = [f"c{i}" for i in range(len(model.classes))]
    weights = spark.createDataFrame([(gram, *own) for gram, own in model.weights.items()], "gram string, " + ", ".join(f"{name} double" for name in names))
    sums = [(F.sum(name) + F.lit(bias)).alias(name) for name, bias in zip(names, model.intercepts, strict=True)]
    logits = grams.join(F.broadcast(weights), "gram").groupBy("row", "paragraph").agg(*sums)
    most = F.greatest(*names)
    powers = [F.exp((F.col(name) - most) / model.temperature) for name in names]
    predicted = F.coalesce(*(F.when(F.col(name) == most, label) for name, label in zip(names, model.classes, strict=True)))
    likely = logits.select("row", "paragraph", predicted.alias("predicted"), (1 / sum(powers[1:], powers[0])).alias("probability")).where(F.col("predicted") != NONE)

    rows = [(gram, family, i, len(own)) for family, many in templates().items() for i, own in enumerate(many) for gram in own]
    held = grams.join(F.broadcast(spark.createDataFrame(rows, "gram string, predicted string, template int, size int")), "gram")
    shares = held.groupBy("row", "paragraph", "predicted", "template").agg((F.count("*") / F.first("size")).alias("share"))
    similar = shares.groupBy("row", "paragraph", "predicted").agg(F.max("share").alias("similarity"))
    scored = likely.join(similar, ["row", "paragraph", "predicted"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    confirmed = (F.col("similarity") >= CONFIRMED_AT) & (F.col("probability") >= model.believed_at)
    return scored.join(lines, ["row", "paragraph"]).select("row", "doc_id", "paragraph", "notice", "predicted", "probability", "similarity", confirmed.alias("confirmed"))


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Licence notices of whole texts: doc_id, paragraph, paragraphs, family, predicted, probability, similarity, confirmed, notice.

    A notice may have several paragraphs: those that follow one another with at most ``GAP`` others
    between them, until another family is confirmed. ``paragraph`` is the number of its first (from 0),
    ``paragraphs`` how many were found. The other columns are those of its surest paragraph: ``predicted``
    is the classifier's class, ``similarity`` the largest share of the n-grams of one of that class's
    templates that the paragraph holds, ``family`` the predicted class if it is confirmed, else ``unknown``.
    """
    found = scored_paragraphs(docs, model).withColumn("own", F.when(F.col("confirmed"), F.col("predicted")))
    order = Window.partitionBy("row").orderBy("paragraph")
    apart = F.coalesce(F.col("paragraph") - F.lag("paragraph").over(order), F.lit(0)) > GAP + 1
    before = F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("begins", (apart | (F.col("own") != before)).cast("int"))
    numbered = marked.withColumn("number", F.sum(F.coalesce("begins", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    surest = F.max_by(F.struct("predicted", "probability", "similarity", "confirmed", "notice"), F.struct("confirmed", "similarity", "probability", -F.col("paragraph")))
    notices = numbered.groupBy("row", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("paragraph").alias("paragraph"), F.count("*").cast("int").alias("paragraphs"), surest.alias("best")
    )
    return notices.select(
        "doc_id", "paragraph", "paragraphs", F.when(F.col("best.confirmed"), F.col("best.predicted")).otherwise(UNKNOWN).alias("family"), F.col("best.predicted").alias("predicted"),
        F.round("best.probability", 6).alias("probability"), F.round("best.similarity", 6).alias("similarity"), F.col("best.confirmed").alias("confirmed"), F.col("best.notice").alias("notice"),
    )
