"""Language identification by hierarchical discrimination.

A text's language family is predicted first, then one-versus-one linear support vector machines
tell the languages of that family apart.  Features are hashed byte n-grams of the lower-cased
text, as square roots of their shares.  The machines are fitted on a bounded sample of labelled
rows: ``SAMPLE_PER_LANGUAGE`` of each language, or an equal part of ``SAMPLE_ROWS`` where there are
more languages than that allows, so none is left out.  Each pair of classes is fitted in a Spark
task of its own on sparse rows.  Predictions see whole texts and nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import release, table, written

#: Families of languages by their ISO 639-1 codes; any other language is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ca", "ro", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"],
}
SAMPLE_PER_LANGUAGE = 600
SAMPLE_ROWS = 38_400
#: Rows of a language, at least, where there are very many.
LEAST_ROWS = 8
#: Rows of a class in a machine, at most: a family shares them among its languages.
CLASS_ROWS = 2400
BITS = 13
GRAMS = (1, 2, 3)
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
#: Bytes of ASCII that are no letters count as a blank.
_FOLD = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], dtype=np.uint32)
_MULTIPLIER = np.uint32(0x9E3779B1)


def features(text: str) -> np.ndarray:
    """``2 ** BITS`` values of unit length."""
    raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 0x20) | (raw[:-1] != 0x20)])]
    counts, gram = np.zeros(1 << BITS), np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(raw) < n:
            break
        gram = gram[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :]
        if n in GRAMS:
            counts += np.bincount(((gram + np.uint32(n)) * _MULTIPLIER) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


@dataclass
class Machine:
    """Two classes: ``first`` where the margin is positive."""

    first: str
    second: str
    weights: np.ndarray
    bias: float
    slope: float


@dataclass
class Votes:
    """One-versus-one machines over classes; a class's score is its weakest probability against another."""

    classes: list[str]
    machines: list[Machine] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.ones((len(x), len(self.classes)))
        for m in self.machines:
            p = 1 / (1 + np.exp(-np.clip(m.slope * (x @ m.weights + m.bias), -30, 30)))
            for name, q in ((m.first, p), (m.second, 1 - p)):
                k = self.classes.index(name)
                least[:, k] = np.minimum(least[:, k], q)
        best = least.argmax(1)
        return best, least[np.arange(len(x)), best]


@dataclass
class LanguageModel:
    families: Votes
    within: dict[str, Votes]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and a score from 0 to 1 of each text: ``und`` and 0 where it is null or has no letter."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        live = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not live or not self.families.classes:
            return out
        x = np.stack([features(texts[i]) for i in live])
        family, p = self.families.predict(x)
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                lang, q = self.within[name].predict(x[rows])
                for r, which, score in zip(rows, lang, p[rows] * q, strict=True):
                    out[live[r]] = (self.within[name].classes[which], float(score))
        return out


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray, names: tuple[str, str], c: float = 100.0, rounds: int = 12) -> Machine:
    """A linear support vector machine on sparse ``rows`` (places, values) by dual coordinate descent; every fifth row only sets the slope of its probability."""
    y = np.where(first, 1.0, -1.0)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    checks, train = order[::5], np.setdiff1d(order, order[::5]) if len(order) > 10 else order
    w, bias, alpha = np.zeros(1 << BITS, dtype=np.float64), 0.0, np.zeros(len(rows))
    rows = [(at, value.astype(np.float64)) for at, value in rows]
    norm = [float(value @ value) + 1.0 for _, value in rows]
    for _ in range(rounds):
        for i in rng.permutation(train).tolist():
            at, value = rows[i]
            g = y[i] * (value @ w[at] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * value
                bias += step
                alpha[i] = new
    margin = y[checks] * (np.array([rows[i][1] @ w[rows[i][0]] for i in checks]) + bias)
    slopes = np.array([0.5, 1, 2, 3, 4, 6, 8])
    loss = [np.log1p(np.exp(-np.clip(s * margin, -30, 30))).sum() for s in slopes]
    return Machine(*names, w.astype(np.float32), float(bias), float(slopes[int(np.argmin(loss))]))


def _sample(labelled: DataFrame, sample: int) -> tuple[list[str], DataFrame]:
    """The languages, and ``lang, family, draw, at, value`` of the rows of each whose hash of ``key`` is least."""
    rows = labelled.where("lang is not null and key is not null and text is not null")
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    each = max(LEAST_ROWS, min(sample, SAMPLE_ROWS // max(1, len(known))))
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = {lang: min(1 << 30, round((1 << 30) * (1.3 * each + 20) / n)) for lang, n in known.items()}
        for batch in batches:
            got = [(lang, draw_, text) for lang, draw_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if draw_ < share[lang] and _LETTER.search(text)]
            x = [features(text) for _, _, text in got]
            at = [np.flatnonzero(v) for v in x]
            columns = [[g[0] for g in got], [_FAMILY.get(g[0], g[0]) for g in got], [g[1] for g in got], [a.astype("<u2").tobytes() for a in at], [v[a].tobytes() for v, a in zip(x, at, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["lang", "family", "draw", "at", "value"])

    drawn = rows.select("lang", draw.alias("draw"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "lang string, family string, draw long, at binary, value binary")
    least = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "at", "value"))
    return sorted(known), written(drawn.withColumn("k", least).where(F.col("k") <= each), "sample")


def fit(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from ``text, lang, key`` rows.

    Rows with a null language, key or text, or a text without letters, are left out; rows that
    repeat a key are drawn together.  Without any row (as of an empty table) the model answers
    ``und`` for all.
    """
    _, drawn = _sample(labelled, sample)
    languages = [r["lang"] for r in drawn.select("lang").distinct().collect()]
    if not languages:
        return LanguageModel(Votes([]), {})
    families: dict[str, list[str]] = {}
    for lang in sorted(languages):
        families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    # A machine's rows: those of two families (level "", a family's rows shared among its languages), or of two languages of one.
    jobs = [("", a, b) for a, b in combinations(sorted(families), 2)] + [(f, a, b) for f, langs in families.items() for a, b in combinations(langs, 2)]
    machines: list[tuple[int, Machine]] = []
    if jobs:
        spark = labelled.sparkSession
        sides = [(k, level, name, name == a) for k, (level, a, b) in enumerate(jobs) for name in (a, b)]
        wanted = spark.createDataFrame(sides, "job int, level string, class string, first boolean")
        part = {f: max(1, CLASS_ROWS // len(langs)) for f, langs in families.items()}
        few = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])[F.col("family")]
        upper = drawn.where(F.col("k") <= few).select(F.lit("").alias("level"), F.col("family").alias("class"), "draw", "at", "value")
        inner = drawn.select(F.col("family").alias("level"), F.col("lang").alias("class"), "draw", "at", "value")

        def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["class", "draw", "at", "value"], kind="stable")
            x = [(np.frombuffer(a, dtype="<u2").astype(np.int64), np.frombuffer(v, dtype=np.float32)) for a, v in zip(rows["at"], rows["value"], strict=True)]
            m = fit_machine(x, rows["first"].to_numpy(bool), ("", ""))
            return pd.DataFrame({"job": [key[0]], "weights": [m.weights.tobytes()], "bias": [m.bias], "slope": [m.slope]})

        each = upper.unionByName(inner).join(wanted, ["level", "class"]).groupBy("job").applyInPandas(learn, "job int, weights binary, bias double, slope double")
        for r in sorted(each.collect(), key=lambda r: r["job"]):  # a row for each pair of classes
            machines.append((r["job"], Machine(*jobs[r["job"]][1:], np.frombuffer(r["weights"], dtype=np.float32), r["bias"], r["slope"])))
    of = lambda level: [m for k, m in machines if jobs[k][0] == level]
    return LanguageModel(Votes(sorted(families), of("")), {f: Votes(langs, of(f)) for f, langs in families.items()})


def identify(docs: DataFrame, model: LanguageModel, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``language`` and ``score``, which replace columns of those names; works on whole ``text`` only.

    A null or empty text, and one without a letter, is ``und`` with the score 0; repeated rows get
    the same answer each, and an empty table gives no row.
    """
    kept = [c for c in docs.columns if c.lower() not in (language.lower(), score.lower())]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(language, "string").add(score, "double")
    at = [c.lower() for c in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                got = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*kept, language, score])
        release()

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of the id's decimal text is 2 modulo 4; false where the id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_documents(docs: DataFrame) -> LanguageModel:
    return fit(docs.where(~held_out()).select("text", F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("key")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, fit_on_documents(docs)).select("doc_id", "held_out", "lang_pred", "score")
