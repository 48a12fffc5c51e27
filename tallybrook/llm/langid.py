"""Language identification by nearest centroid.

A text becomes a vector of hashed character n-grams (1 to 3 letters, words marked at both ends), by
log-scaled counts times inverse document frequency, of length one. Each language has several centroids,
from spherical k-means over its own texts, since one language holds several kinds of text. A text gets the
language of the centroid with the largest cosine. It is rejected when that cosine is lower than nearly all
training texts of that centroid's language had.

Document frequencies come from all training rows. Centroids are fitted on at most `per_language` rows of
each language, those with the smallest hash of id and text; the vectors of that bounded sample are the only
rows that meet in one task. Rows that repeat both count once there, so copies can't make a task large.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import common as C

DIMS = 4096
PER_LANGUAGE, CLUSTERS, ROUNDS = 600, 4, 8
#: Languages of a model: it is broadcast, 64 KB for each. More of them make several models, and the best of all counts.
MOST_LANGUAGES = 1000
#: Languages whose sampling rates are broadcast (a few MB); beyond, they are joined.
FEW_RATES = 100_000
#: n-grams from which on a text is held to the whole of its centroid's floor (about 170 letters).
SURE_GRAMS = 500
_SLICE = 1 << 20
UNKNOWN = "und"


def grams(text: str) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased letters; None if there is no letter.

    Long texts go slice by slice, each after the last two marks of what stands before it, so every gram counts once.
    """
    text = text.lower()
    total, before, found = np.zeros(DIMS, np.int64), np.array([0x20], np.uint64), False
    count = lambda h: np.bincount((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64), minlength=DIMS)
    with np.errstate(over="ignore"):
        total += count(before)
        for at in range(0, max(len(text), 1), _SLICE):
            part = text[at : at + _SLICE]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = _is_letter(points, part)
            found = found or bool(letter.any())
            x = np.r_[before, np.where(letter, points, np.uint32(0x20))]
            if at + _SLICE >= len(text):
                x = np.r_[x, np.uint64(0x20)]
            space = x == 0x20
            x = x[np.r_[True, ~(space[1:] & space[:-1])]]
            old = len(before)  # no gram that ends in these is new
            two = x[:-1] * np.uint64(0x1F123BB5) + x[1:]
            three = two[:-1] * np.uint64(0x1F123BB5) + x[2:]
            total += count(np.concatenate([x[old:], two[old - 1 :] ^ np.uint64(1 << 40), three[max(0, old - 2) :] ^ np.uint64(2 << 40)]))
            before = x[-2:]
    return total if found else None


_LETTERS = np.array([chr(k).isalpha() for k in range(0x3000)])


def _is_letter(points: np.ndarray, part: str) -> np.ndarray:
    low = points < len(_LETTERS)
    out = _LETTERS[np.where(low, points, 0)]
    if not low.all():
        for k in np.flatnonzero(~low).tolist():
            out[k] = part[k].isalpha()
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts at rows far from those taken before."""
    picks = [0]
    near = x @ x[0]
    for _ in range(1, min(k, len(x))):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    centres = x[picks].astype(np.float32)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = x[own == j].mean(0)
                centres[j] = mean / (np.linalg.norm(mean) or 1.0)
    return centres


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]
    floors: np.ndarray  # of each centroid: cosines below it are rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1) and whether the text is rejected; a text without letters is `und`, with score 0."""
        counts = grams(text) if text else None
        if counts is None or not len(self.langs):
            return UNKNOWN, 0.0, True
        cosine = self.centres @ vector(counts, self.idf)
        best = int(np.argmax(cosine))
        # A short text is far from every centroid, so less is asked of it.
        floor = self.floors[best] * min(1.0, counts.sum() / SURE_GRAMS)
        return self.langs[best], float(min(1.0, max(0.0, cosine[best]))), bool(cosine[best] < floor)


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for frame in batches:
            for text in frame["text"]:
                counts = grams(text) if isinstance(text, str) else None
                if counts is not None:
                    total += counts > 0
                    n += 1
        used = np.flatnonzero(total)
        yield pd.DataFrame({"dim": np.r_[-1, used].astype(np.int32), "n": np.r_[n, total[used]]})

    out, n = np.zeros(DIMS, np.int64), 0
    for row in rows.select("text").mapInPandas(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        if row.dim < 0:
            n = row.n
        else:
            out[row.dim] = row.n
    return out, n


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> list[Model]:
    """Learns from rows (doc_id, text, lang); rows with null lang, or without letters, teach nothing.

    Returns one model, or (with more than MOST_LANGUAGES languages) several, languages in ascending order.
    """
    rows = rows.select(C.id_column(), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    found, n = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + found)) + 1
    # A hash threshold first leaves about twice the sample, so that only it is ordered.
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    rates = rows.groupBy("lang").agg(F.least(F.lit(2.0), F.lit(2.0 * per_language + 50) / F.count("*")).alias("rate"))
    rates = C.materialise(rates, "languages")
    few = rates.count() <= FEW_RATES
    sample = rows.withColumn("h", h).join(F.broadcast(rates) if few else rates, "lang").where(F.col("h") < F.col("rate")).drop("rate").dropDuplicates(["lang", "h"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "doc_id", "text"]).head(per_language)
        counts = [c for c in map(grams, frame["text"]) if c is not None]
        if not counts:
            return pd.DataFrame(columns=["lang", "centre", "floor"])
        x = np.stack([vector(c, idf) for c in counts])
        centres = spherical_kmeans(x, clusters)
        # Half of what the least typical hundredth has: far texts only.
        best = (x @ centres.T).max(1)
        floor = 0.5 * float(np.quantile(best, 0.01))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "floor": floor})

    learnt = C.materialise(sample.groupBy("lang").applyInPandas(learn, "lang string, centre binary, floor double"), "centres")
    out, after = [], None
    while True:  # a model at a time: this many languages after the last one's
        left = learnt if after is None else learnt.where(F.col("lang") > after)
        names = left.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES)
        held = sorted(left.join(F.broadcast(names), "lang", "left_semi").collect(), key=lambda r: (r.lang, bytes(r.centre)))
        if not held and out:
            break
        centres = np.stack([np.frombuffer(r.centre, np.float32) for r in held]) if held else np.zeros((0, DIMS), np.float32)
        out.append(Model(idf, centres, [r.lang for r in held], np.array([r.floor for r in held])))
        if not held:
            break
        after = held[-1].lang
        if len({r.lang for r in held}) < MOST_LANGUAGES:
            break
    C.discard(learnt, rates)
    return out


def held_out(name: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2. Rows without an id are learnt from."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


_FOUND = "lang_pred string, score double, rejected boolean"


def _predictor(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)  # MOST_LANGUAGES x clusters x DIMS floats at most

    @F.pandas_udf(_FOUND)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [shared.value.predict(x if isinstance(x, str) else None) for x in values]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return lambda text: run(text.cast("string"))


def found(docs: DataFrame, models: list[Model]) -> DataFrame:
    """own (a row of docs) and found (lang_pred, score, rejected, from its text alone).

    Several models judge one after another, so that only one is held at a time; of equal scores the first model's counts.
    """
    rows = docs.select(F.struct("*").alias("own"))
    for k, model in enumerate(models):
        new = _predictor(docs.sparkSession, model)(F.col("own.text"))
        if k == 0:
            rows = rows.select("own", new.alias("found"))
            continue
        held = rows
        rows = held.select("own", "found", new.alias("new")).select("own", F.when((F.col("new.lang_pred") != UNKNOWN) & (F.col("new.score") > F.col("found.score")), F.col("new")).otherwise(F.col("found")).alias("found"))
        rows = C.materialise(rows, "languages")
        if k > 1:
            C.discard(held)
    return rows


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """docs with lang_pred, score and rejected added, from the text alone. Columns of docs with these names are replaced."""
    added = ("lang_pred", "score", "rejected")
    own = [c for c in docs.columns if c.lower() not in added]
    return found(docs.select(*own), models).select("own.*", *[f"found.{c}" for c in added])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text, lang), learning from the rows that are not held out.

    A null text, or one without letters, is `und` with score 0. Repeated rows are rows. A text of any length counts
    whole. If nothing can be learnt every text is `und`. An empty table gives no rows. Other columns are ignored.
    """
    models = fit(docs.where(~held_out()))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(own, models).drop("text")
