"""Language identification (operator 7): multinomial naive Bayes over hashed n-grams.

Character n-grams of 1 to 3 code points, padded at word ends, are hashed into a fixed
number of buckets. Training sums bucket counts per language over a sample of labelled
rows: at most about `sample` rows of each language, chosen by a hash of doc_id and text,
each distinct text counted once. So one text that fills a third of the table weighs as
much as any other, and a rare language is learned on a large table as on a small one. The
matrix of log-probabilities has languages x buckets entries and is broadcast. Scoring
hashes whole texts in blocks and adds the matrix rows of each text's n-grams (a sparse
product, summed by segment).

Cases: a text that is null, empty or without a letter gets `und` and score 0. Ties go
to the language that sorts first. With no labelled row at all every text is `und`.
Labels that are null are not learned from. Of more than MAX_LANGUAGES labels, as a dirty
column can hold, those with the most rows are learned. Repeated rows get one prediction
each and are learned from once. Texts of any length are read whole. An empty table gives
an empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import U, column, texts
from docmill.session import table

BUCKETS = 1 << 15
#: At most about so many labelled rows of each language are learned from.
SAMPLE_ROWS = 5_000
#: Labels that are learned at most: the matrix must stay small enough to broadcast.
MAX_LANGUAGES = 500
UNDETERMINED = "und"
ALPHA = 0.5


@lru_cache(maxsize=1)
def lowered() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form with non-letters as blanks, and is-letter."""
    letter = np.zeros(0x110000, bool)
    low = np.full(0x110000, 32, np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            letter[p] = True
            x = c.lower()
            low[p] = ord(x) if len(x) == 1 else p
    return low, letter


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, how many each text has, and how many letters each text has."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    low, is_letter = lowered()
    raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = offsets if len(raw) == len(data) else np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    letters = is_letter[raw]
    points = low[raw]
    owner = np.repeat(np.arange(n), np.diff(first))
    keep = letters.copy()  # one blank stands for any run of non-letters
    keep[1:] |= letters[:-1] & (owner[1:] == owner[:-1])
    points, owner, letters_kept = points[keep].astype(U), owner[keep], letters[keep]
    same1 = np.empty(len(points), bool)
    same2 = same1.copy()
    same1[:1], same2[:2] = False, False
    same1[1:] = owner[1:] == owner[:-1]
    same2[2:] = owner[2:] == owner[:-2]
    grams, owners = [], []
    prev1 = np.where(same1, np.concatenate(([32], points[:-1])).astype(U), U(32))
    prev2 = np.where(same2, np.concatenate(([32, 32], points[:-2])).astype(U)[: len(points)], U(32))
    bits = U(64 - BUCKETS.bit_length() + 1)
    for salt, gram, which in ((1, points, letters_kept), (2, points | prev1 << U(21), letters_kept | same1), (3, points | prev1 << U(21) | prev2 << U(42), letters_kept | same1)):
        h = (gram[which] + U(salt << 61)) * U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        grams.append((h >> bits).astype(np.int64))
        owners.append(owner[which])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(grams)[order], np.bincount(np.concatenate(owners), minlength=n), np.bincount(owner, weights=letters_kept, minlength=n).astype(np.int64)


def held_out(id_col: str) -> Column:
    """Rows that must not be learned from; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """Languages in order and the matrix buckets x languages of log-probabilities."""

    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.weights, self.prior = languages, weights, prior

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The index of each text's language (-1: undetermined), its posterior, and how much likelier
        an n-gram of the text is in it than in a language of uniform buckets (mean logarithm).
        """
        grams, counts, letters = features(data, offsets)
        n, k = len(counts), len(self.languages)
        sums = np.zeros((n, k))
        full = np.flatnonzero(counts)
        if len(full) and k:
            at = (np.cumsum(counts) - counts)[full]
            for j in range(k):
                sums[full, j] = np.add.reduceat(self.weights[j][grams], at)
        sums += self.prior
        if not k:
            return np.full(n, -1), np.zeros(n), np.zeros(n)
        best = sums.argmax(axis=1)
        top = sums[np.arange(n), best]
        score = 1 / np.exp(sums - top[:, None]).sum(axis=1)
        none = letters == 0
        fit = (top - self.prior[best]) / np.maximum(counts, 1) + np.log(BUCKETS)
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, fit)


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE_ROWS) -> Model:
    """Fits the model; only row counts of labels and sums per language and bucket reach the driver."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in rows}
    if not share:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    limits = F.create_map(*(F.lit(x) for lang, part in share.items() for x in (lang, int(1e9 * part))))
    chosen = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000_000)) < F.coalesce(F.try_element_at(limits, F.col("lang")), F.lit(0)))
    labelled = chosen.withColumn("h", F.xxhash64("text")).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for part, data, offsets in texts(batches, "text"):
            langs = column(part, "lang").to_pylist()
            grams, counts, _ = features(data, offsets)
            owner = np.repeat(np.arange(len(counts)), counts)
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(grams[own[owner]], minlength=BUCKETS)
                texts_of[lang] = texts_of.get(lang, 0) + int(own.sum())
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(x[at], texts_of[lang]), pa.int64())], names=["lang", "bucket", "n"])

    partial = labelled.mapInArrow(count, "lang string, bucket int, n long")
    got = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    weights = np.full((len(languages), BUCKETS), ALPHA)
    seen = np.zeros(len(languages))
    for j, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        cells = own[own["bucket"] >= 0]
        weights[j, cells["bucket"].to_numpy()] += cells["n"].to_numpy()
        seen[j] = own.loc[own["bucket"] < 0, "n"].sum()
    weights = np.log(weights / weights.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, weights, np.log(seen / max(seen.sum(), 1)) if len(languages) else np.zeros(0))


def predict(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """All columns of df with lang_pred, score and fit; df must not have columns of these names."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        names = pa.array([*own.languages, UNDETERMINED], pa.string())
        for part, data, offsets in texts(batches, text_col):
            best, score, fit = own.predict(data, offsets)
            lang = names.take(pa.array(np.where(best < 0, len(own.languages), best)))
            yield pa.RecordBatch.from_arrays([*part.columns, lang, pa.array(score), pa.array(fit)], names=[*part.schema.names, "lang_pred", "score", "fit"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]))


def identify(docs: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = train(docs.where(~held_out("doc_id")), "doc_id", "text", "lang", sample)
    slim = docs.select("doc_id", "text")
    out = predict(slim, model, "text")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an identifiable language go.

    That is those without letters (null and empty texts too), and those whose n-grams are less
    likely in the best language than in one of uniform buckets, as of unknown scripts or noise.
    Null or repeated doc_ids do no harm, nor do clashing names.
    """
    model = train(docs.where(~held_out("doc_id")), "doc_id", "text", "lang")
    # The text is carried through; its prediction decides and is dropped.
    names = docs.columns
    out = predict(docs.toDF(*[f"c{i}" for i in range(len(names))]), model, f"c{names.index('text')}")
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("fit") >= 0)).drop("lang_pred", "score", "fit").toDF(*names)
