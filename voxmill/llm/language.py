"""Language identification by rank-order profiles of n-grams.

A language's profile is the ordered list of the most frequent n-grams (one to three letters, with
word edges) in labelled texts. A document's own most frequent n-grams are ranked likewise over its
whole text; the out-of-place distance to a profile sums how far each n-gram's rank is from its rank
there, and an n-gram that the profile lacks counts as far as possible. The nearest language wins;
of equally near ones, the first by name.

A text that is null or has no letter is ``und`` with score 0, and so is every text if no row has a
language to learn from. Rows are judged one by one: repeated rows get the same result, an empty
table gives an empty one, and other columns are not read. Long texts are counted in parts, so a task
holds the distinct n-grams of a text and not one code for each of its characters.

A filter keeps what is near enough to the profile of a wanted language (``LEAST_SCORE``): a text in
a language without a profile has a nearest profile too, but one that it hardly resembles.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile.
PROFILE = 300
#: The profiles are fitted on about so many labelled documents of each language, chosen by a hash.
SAMPLE_PER_LANGUAGE = 400
UNDETERMINED = "und"

#: Documents are kept by a filter from this score on; a text of a learned language has 0.5 to 0.9.
LEAST_SCORE = 0.4
#: Characters whose n-grams are held together.
PART = 1 << 20

EDGE = 1
WIDTH = 21

Profiles = list[tuple[str, np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Codes of all n-grams of one to three characters, part by part; what is no letter is a word edge."""
    lowered = text.lower()
    before = np.array([EDGE])
    for start in range(0, len(lowered) + 1, PART):
        points = np.frombuffer(lowered[start : start + PART].encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        codes = np.where(letter_table()[points], points, EDGE)
        if start + PART > len(lowered):
            codes = np.append(codes, EDGE)
        codes = np.concatenate((before, codes[(codes != EDGE) | (np.concatenate((before[-1:], codes[:-1])) != EDGE)]))
        pairs = (codes[:-1] << WIDTH) | codes[1:]
        own = codes[len(before) :]
        yield np.concatenate((own[own != EDGE], pairs[len(before) - 1 :], (pairs[:-1] << WIDTH) | codes[2:]))
        before = codes[-2:]


def added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their counts."""
    if len(grams) == 1:
        return grams[0], counts[0]
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text and their counts."""
    total: tuple[np.ndarray, np.ndarray] | None = None
    for part in ngrams(text):
        own = np.unique(part, return_counts=True)
        total = own if total is None else added([total[0], own[0]], [total[1], own[1]])
    return total


def most_frequent(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` n-grams with the highest counts, in order; of equal counts, the lower code first."""
    if len(grams) > size:
        bound = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= bound], counts[counts >= bound]
    return grams[np.lexsort((grams, -counts))][:size]


def distances(text: str, profiles: Profiles) -> np.ndarray | None:
    """Out-of-place distance to each profile as a share of the largest possible; None without letters."""
    grams, counts = gram_counts(text)
    if not len(grams):
        return None
    own = most_frequent(grams, counts)
    ranks = np.arange(len(own))
    result = np.empty(len(profiles))
    for i, (_, grams, places) in enumerate(profiles):
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        away = np.where(grams[at] == own, np.abs(places[at] - ranks), PROFILE)
        result[i] = away.sum() / (PROFILE * len(own))
    return result


def fit_profiles(docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles of all languages among the rows where ``learn`` holds.

    The sample is the rows whose hashed doc_id lies below a bound that gives about ``per_language``
    documents of each language; their whole texts are counted. The driver gets PROFILE rows a language.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return []
    share = F.create_map(*(F.lit(x) for row in sizes for x in (row["lang"], per_language / row["n"])))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < share[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                texts.setdefault(lang, []).append(gram_counts(text.as_py()))
            for lang, found in texts.items():
                grams, counts = added(*map(list, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"]
                )

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE)
    grams: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "gram", "rank").collect():
        grams.setdefault(row["lang"], []).append((row["gram"], row["rank"]))
    profiles = []
    for lang in sorted(grams):
        pairs = np.array(sorted(grams[lang]), dtype=np.int64)
        profiles.append((lang, pairs[:, 0], pairs[:, 1]))
    return profiles


def judge(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """(language, score); the score is the share of the largest distance that the nearest stays away from."""
    away = distances(text, profiles) if text and profiles else None
    if away is None:
        return UNDETERMINED, 0.0
    nearest = int(np.argmin(away))
    return profiles[nearest][0], float(1 - away[nearest])


def predict_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text.as_py(), known.value) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_languages(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE, wanted: Collection[str] | None = None) -> DataFrame:
    """The rows whose text is in a wanted language (any learned one by default) with a score of ``least`` or more; all columns of ``docs``."""
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def accepts(text: str | None) -> bool:
        lang, score = judge(text, known.value)
        return lang != UNDETERMINED and score >= least and (wanted is None or lang in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([accepts(text.as_py()) for text in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
