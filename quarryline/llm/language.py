"""Hierarchical language identification (operator 5): the family first, then one-versus-one linear SVMs within it.

Features: byte 1- to 3-grams of the whole text, letters only and lower-cased, hashed to BINS, square roots of their
shares. Families are given (FAMILIES, by ISO 639-1 code); a language of none is a family of its own. The family
classifier is a softmax regression; in a family each pair of languages has a linear SVM (squared hinge, L2),
and the language with most votes wins, ties to the larger sum of margins, then to the lower code. The score is the family's
probability times the mean logistic margin of the winner's duels.

Learned from all rows that may be learned from (texts with letters), in parts of SAMPLE rows at most with all languages, dealt by a hash of doc_id: a model of each part is made in a task,
and their weights are averaged; only sums of weights reach the driver. Training has no random part.
Null texts and texts without a letter are 'und' with score 0, as is everything if there is nothing to learn from. Very long texts
are counted in parts, whole. Rows are judged one by one, repeated ones alike.

The score tells languages apart, not whether a text is in any of them, so the filter (accepted) measures that: the mean log-probability of a
text's n-grams (runs of other characters as one blank) under the profile of each language. On rows withheld from fitting its spread is measured, as
a part that stays and one that shrinks with the length; a text more than FAR deviations under the median of every language is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import DOUBLE, STRING, annotate, give_back, map_in_arrow, only, pieces, stored, struct, table
from quarryline.llm.features import gram_counts, held_out, learning, unit

FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
BINS, SAMPLE, SEED = 4096, 4000, 5
#: Texts that are counted at once.
ROWS = 256
#: Standard deviations under the median of withheld rows from which a filter rejects a text, and the share of all bins in a profile.
FAR, SMOOTH = 6.0, 0.01
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), f"other:{lang}")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def fit_softmax(xb: np.ndarray, y: np.ndarray, classes: int, rounds: int = 150, rate: float = 20.0, l2: float = 1e-5) -> np.ndarray:
    """Weights (columns of xb, classes) by accelerated full-batch gradient steps."""
    want = np.eye(classes, dtype=np.float32)[y]
    share = want.mean(0)
    weight = (want / np.where(share > 0, share * classes, 1)).sum(1, keepdims=True).astype(np.float32)  # classes count alike
    w = last = np.zeros((xb.shape[1], classes), np.float32)
    for k in range(rounds):
        look = w + k / (k + 3) * (w - last)
        grad = xb.T @ (weight * (_softmax(xb @ look) - want)) / len(xb) + l2 * look
        last, w = w, (look - rate * grad / 4).astype(np.float32)
    return w


def fit_svm(xb: np.ndarray, sign: np.ndarray, rounds: int = 150, c: float = 10.0) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge SVM by accelerated gradient steps; rows with sign 0 don't count."""
    weight = (np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * np.abs(sign) * c).astype(np.float32)
    xb, weight, sign = (v[sign != 0] for v in (xb, weight, sign))
    step = np.float32(1) / np.float32(1e-3 + 2 * c * float(np.einsum('ij,ij->', xb, xb) / max(1, len(xb))))
    w = last = np.zeros(xb.shape[1], np.float32)
    for k in range(rounds):
        look = w + k / (k + 3) * (w - last)
        slack = np.maximum(0, 1 - sign * (xb @ look))
        grad = np.float32(1e-3) * look - 2 * (xb.T @ (weight * slack * sign))
        last, w = w, (look - step * grad).astype(np.float32)
    return w


class LanguageModel:
    """langs, families and weights; predict(texts) -> (codes, scores)."""

    def __init__(self, xb: np.ndarray, langs: list[str], known: list[str] | None = None):
        self.langs = sorted(set(langs)) if known is None else known
        self.families = sorted({family_of(v) for v in self.langs})
        self.members = [[i for i, v in enumerate(self.langs) if family_of(v) == f] for f in self.families]
        y = np.array([self.langs.index(v) for v in langs], np.int64)
        of = {i: f for f, m in enumerate(self.members) for i in m}
        self.family = fit_softmax(xb, np.array([of[i] for i in y], np.int64), len(self.families)) if len(self.families) > 1 else None
        self.duels = {}
        for m in self.members:
            for a in m:
                for b in m:
                    if a < b:
                        self.duels[a, b] = fit_svm(xb, ((y == a).astype(np.float32) - (y == b)).astype(np.float32))

    def weights(self) -> np.ndarray:
        """All weights in one line."""
        return np.concatenate([w.ravel().astype(np.float64) for w in ([] if self.family is None else [self.family]) + [self.duels[d] for d in sorted(self.duels)]] or [np.zeros(0)])

    def reweighted(self, line: np.ndarray) -> LanguageModel:
        """This model with other weights()."""
        at = 0
        if self.family is not None:
            at = self.family.size
            self.family = line[:at].reshape(self.family.shape).astype(np.float32)
        for d in sorted(self.duels):
            self.duels[d], at = line[at : at + BINS + 1].astype(np.float32), at + BINS + 1
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        xb = with_bias(unit(gram_counts(texts, BINS)))
        chance = _softmax(xb @ self.family) if self.family is not None else np.ones((len(xb), len(self.families)), np.float32)
        best = chance.argmax(1)
        codes, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        margins = {d: xb @ w for d, w in self.duels.items()}
        for i, t in enumerate(texts):
            if not t or not any(map(str.isalpha, t)):
                continue
            m = self.members[best[i]]
            rank = []
            for a in m:
                own = [float(margins[a, b][i] if a < b else -margins[b, a][i]) for b in m if b != a]
                sure = float(np.mean([1 / (1 + np.exp(-2 * v)) for v in own])) if own else 1.0
                rank.append((-sum(v > 0 for v in own), -sum(own), self.langs[a], sure))
            _, _, codes[i], sure = min(rank)
            scores[i] = float(min(1.0, chance[i, best[i]] * sure))
        return codes, scores


def parts(rows: DataFrame, counts: dict[str, int], most: int, seed: int) -> tuple[DataFrame, int]:
    """rows with part, and how many parts there are: of about most rows, the with all languages (counts). Every row is in one at least; those of a language that is too rare to give each part a quarter of its share are in several."""
    each = max(1, most // len(counts))
    n = max(-(-k // each) for k in counts.values())
    many = {lang: min(n, max(1, k // max(1, each // 4))) for lang, k in counts.items()}
    own = F.create_map(*[F.lit(x) for kv in sorted(many.items()) for x in kv])[F.col("lang")]
    placed = rows.withColumn("_own", own).withColumn("_first", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("_own")).cast("int"))
    # a language's parts are dealt in turn
    turns = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k % F.col("_own") == F.col("_first"))
    return placed.withColumn("part", F.explode(turns)).drop("_own", "_first"), n


def fit(docs: DataFrame, most: int = SAMPLE, seed: int = SEED) -> LanguageModel | None:
    """A model of docs.lang from all rows that may be learned from, or None without any: the mean of the models of parts() of them, each learned in a task."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text RLIKE '\\\\p{L}'").where(learning()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    known = sorted(counts)
    placed, n = parts(rows, counts, most, seed)

    def learn(found: pa.Table) -> pa.Table:
        order = sorted(zip(found["doc_id"].to_pylist(), found["lang"].to_pylist(), found["text"].to_pylist()))
        found = None
        xb = np.ones((len(order), BINS + 1), np.float32)
        for at in range(0, len(order), ROWS):
            xb[at : at + ROWS, :BINS] = unit(gram_counts([x[2] for x in order[at : at + ROWS]], BINS)).astype(np.float16)
        line = LanguageModel(xb, [x[1] for x in order], known).weights()
        order = xb = None
        give_back()
        return pa.table({"line": pa.array([line.tobytes()], pa.binary())})

    def added(batches):
        total, many = 0, 0
        for batch in batches:
            for x in batch.column(0):
                total, many = total + np.frombuffer(x.as_py(), np.float64), many + 1
        if many:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([many], pa.int64())], names=["line", "many"])

    learned = placed.repartition(n, "part").groupBy("part").applyInArrow(learn, "line binary")
    total, many = 0, 0
    for r in sorted(map_in_arrow(learned, added, struct(line=T.BinaryType(), many=T.LongType())).collect(), key=lambda r: bytes(r["line"])):
        total, many = total + np.frombuffer(r["line"], np.float64), many + r["many"]
    return LanguageModel(np.zeros((1, BINS + 1), np.float32), known[:1], known).reweighted(total / many)


def _predictor(model: LanguageModel | None):
    def make():
        return (lambda texts: model.predict(texts)) if model else lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts))

    return make


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, lang_pred and score of every row."""
    make = _predictor(model)
    return annotate(docs, lambda: (lambda work: lambda texts: list(work(texts)))(make()), struct(lang_pred=STRING, score=DOUBLE), text, carry)


_OTHER = re.compile(r"[\W\d_]+")


def _letter_grams(texts: list[str | None]) -> np.ndarray:
    return gram_counts([_OTHER.sub(" ", t) if t else t for t in texts], BINS)


class Familiarity:
    """How far texts are from the learned languages: deviations(texts) from the nearest one's median, negative below it.

    Made from the languages' mean shares of n-grams; measure() takes (lang, n-grams, scores) of texts that tell the spread.
    """

    def __init__(self, langs: list[str], shares: np.ndarray):
        self.langs, self.logs = langs, np.log((1 - SMOOTH) * shares.T + SMOOTH / BINS)
        self.middle, self.fixed, self.falling = np.zeros(len(langs)), 0.0, 0.0

    def measure(self, rows: DataFrame) -> Familiarity:
        """rows: lang, n and score (of that language) of texts, a stored table."""
        middle = {r["lang"]: r["m"] for r in rows.groupBy("lang").agg(F.percentile("score", F.lit(0.5)).alias("m")).collect()}
        self.middle = np.array([middle.get(v, 0.0) for v in self.langs])
        of = F.create_map(*[F.lit(x) for kv in sorted(middle.items()) for x in kv])[F.col("lang")]
        rows = rows.withColumn("square", F.pow(F.col("score") - of, F.lit(2.0)))
        long = F.col("n") >= rows.agg(F.percentile("n", F.lit(0.5)).alias("m")).collect()[0]["m"]
        # one row of 200 lies further than three deviations, so junk among the rows does not widen them
        tail = lambda x: F.percentile(x, F.lit(0.995)) / 9
        falling = F.col("square") * F.col("n")
        r = rows.agg(tail(F.when(long, F.col("square"))).alias("fixed"), F.coalesce(tail(F.when(~long, falling)), tail(falling)).alias("falling")).collect()[0]
        self.fixed, self.falling = r["fixed"], r["falling"]
        return self

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        counts = _letter_grams(texts)
        n = counts.sum(1)
        return n, counts @ self.logs / np.maximum(n, 1)[:, None]

    def deviations(self, texts: list[str | None]) -> np.ndarray:
        n, score = self.scores(texts)
        spread = np.sqrt(self.fixed + self.falling / np.maximum(n, 1)) + 1e-9
        return (score - self.middle).max(1) / spread


def familiarity(docs: DataFrame) -> Familiarity | None:
    """From all rows that may be learned from, its spread from all withheld ones, or None without any.

    Sums by task and language reach the driver, and quantiles of numbers that are stored for each withheld row.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text RLIKE '\\\\p{L}'")

    def sums(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, 1):
                counts = _letter_grams(part.column(1).to_pylist())
                shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
                for lang in set(langs := part.column(0).to_pylist()):
                    own = shares[[v == lang for v in langs]]
                    held[lang] = held.get(lang, 0) + np.append(own.sum(0), len(own))
        for lang, total in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tobytes()], pa.binary())], names=["lang", "total"])

    learned = rows.where(learning()).select("lang", "text")
    totals: dict[str, np.ndarray] = {}
    for r in map_in_arrow(learned, sums, struct(lang=STRING, total=T.BinaryType())).collect():
        totals[r.lang] = totals.get(r.lang, 0) + np.frombuffer(r.total, np.float64)
    if not totals:
        return None
    known = Familiarity(sorted(totals), np.array([totals[v][:-1] / totals[v][-1] for v in sorted(totals)]))

    def make():
        def work(texts: list) -> list:
            n, score = known.scores(texts)
            return [pa.array(n, pa.float64()), score.tolist()]

        return work

    place = F.create_map(*[F.lit(x) for k, v in enumerate(known.langs) for x in (v, k)])[F.col("lang")]

    def measured(which) -> DataFrame:
        scored = annotate(rows.where(which), make, struct(n=DOUBLE, score=T.ArrayType(DOUBLE)), carry=("lang",))
        return scored.where(place.isNotNull()).select("lang", "n", F.get("score", place).alias("score"))

    withheld = stored(measured(held_out()), "withheld")
    missing = sorted(set(known.langs) - {r["lang"] for r in withheld.select("lang").distinct().collect()})
    # a language without withheld rows is measured on those that it was learned from
    return known.measure(stored(withheld.unionByName(measured(learning() & F.col("lang").isin(missing))), "measured") if missing else withheld)


def accepted(docs: DataFrame, model: LanguageModel | None, far: float = FAR) -> DataFrame:
    """The rows of docs, all columns, that are in one of the learned languages."""
    make, known = _predictor(model), familiarity(docs) if model else None

    def judge():
        work = make()

        def good(texts: list) -> list:
            codes, _ = work(texts)
            near = known.deviations(texts) >= -far if known else [True] * len(texts)
            return [c != UNKNOWN and bool(x) for c, x in zip(codes, near)]

        return good

    return only(docs, judge)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
