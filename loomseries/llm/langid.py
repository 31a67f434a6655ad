"""Languages in two steps: the family first, then the language within it.

Both steps are votes of one-versus-one linear support vector machines: one for
each two families, and one for each two languages of a family. A text is the
vector of its byte trigrams and words (lower-cased), each hashed into 2048
places, as square roots of counts, scaled to length 1.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .quality import held_out

SAMPLE = 1000  # rows that each language is learned from, at most
PLACES = 2048
STEEP = 6.0  # a margin m is the confidence sigmoid(STEEP * m)
UNKNOWN = "und"

# Language families by ISO 639-1 codes. Any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk", "tt"],
    "indo-aryan": ["hi", "ur", "bn", "pa", "mr", "gu", "ne", "si"],
    "iranian": ["fa", "ps", "ku", "tg"],
    "semitic": ["ar", "he", "am", "mt"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "sinitic": ["zh", "yue"],
    "austronesian": ["id", "ms", "jv", "tl"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def features(texts: words.Texts) -> np.ndarray:
    """One row per text."""
    n = len(texts)
    data, out = texts.data, np.zeros((n, 2 * PLACES), np.float32)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        triples = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        places = (triples * np.uint32(2654435761)) >> np.uint32(21)
        at = np.repeat(np.arange(n), np.diff(texts.bounds))
        same = at[:-2] == at[2:]
        out[:, :PLACES] = np.bincount(at[:-2][same] * PLACES + places[same], minlength=n * PLACES).reshape(n, -1)
    starts, ends = texts.words()
    places = (texts.hashes(starts, ends) >> np.uint64(53)).astype(np.int64)
    out[:, PLACES:] = np.bincount(texts.owner(starts) * PLACES + places, minlength=n * PLACES).reshape(n, -1)
    np.sqrt(out, out=out)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in words.texts_of(batch.column(2), 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(row, len(texts)) for i in (0, 1)), words.binary_rows(features(texts))], ["lang", "turn", "x"])


def _machine(table: pa.Table) -> pa.Table:
    """Train one machine on rows (machine, positive, turn, x): dual coordinate descent of the L2-regularised hinge loss."""
    table = table.combine_chunks().sort_by([("turn", "ascending"), ("x", "ascending")])
    x = words.matrix_of(table["x"].combine_chunks(), np.float32, 2 * PLACES).astype(np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.where(table["positive"].to_numpy(), 1.0, -1.0)
    cost = np.where(y > 0, 10.0 / max(1, (y > 0).mean() * 2), 10.0 / max(1, (y < 0).mean() * 2))
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(y)), (x * x).sum(axis=1)
    order = np.random.default_rng(1)
    for _ in range(12):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return pa.table({"machine": table["machine"][:1], "w": words.binary_rows(w[None, :].astype(np.float32))})


class Model:
    """Languages, and (first, second) -> weights of the machines; a margin above 0 speaks for the first."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str, str], np.ndarray]):
        self.langs = langs
        self.machines = machines
        self.families = {f: sorted(x) for f, x in itertools.groupby(sorted(langs, key=lambda x: (family_of(x), x)), family_of)}

    def vote(self, step: str, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner and its least margin, by row. Most votes win, then the larger sum of margins, then the earlier name."""
        votes, sums = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), 5.0)
        for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
            w = self.machines[step, a, b]
            m = x @ w[:-1] + w[-1]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            sums[:, i] += m
            sums[:, j] -= m
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = np.argmax(votes + np.tanh(sums / (1 + len(names))) * 0.49, axis=1)
        return best, least[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = sorted(self.families)
        family, margin = self.vote("family", names, x)
        lang = np.empty(len(x), object)
        for i, name in enumerate(names):
            some = np.flatnonzero(family == i)
            best, inner = self.vote("lang", self.families[name], x[some])
            lang[some] = np.array(self.families[name], object)[best]
            margin[some] = np.minimum(margin[some], inner)
        return lang, 1 / (1 + np.exp(-STEEP * margin))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text, lang): rows not held out, with a language and a letter.

    At most ``sample`` rows of a language are drawn by a hash of doc_id. Each
    machine is trained in a task of its own on the rows of its two sides, which
    the sample bounds.
    """
    rows = docs.where(~held_out()).where(r"lang is not null and text rlike '\\p{L}'").where(F.col("lang") != UNKNOWN)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], {})
    turn = F.xxhash64(F.lit("lang"), F.col("doc_id"))
    wanted = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 1.2 * sample / n))])
    drawn = rows.where(turn / 2.0**64 + 0.5 <= wanted[F.col("lang")]).select("lang", turn.alias("turn"), F.lower("text").alias("text"))
    vectors = drawn.mapInArrow(_vectors, "lang string, turn long, x binary")
    first = Window.partitionBy("lang").orderBy("turn", "x")
    vectors = vectors.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample)
    model = Model(sorted(counts), {})
    roles = {lang: [] for lang in counts}
    for a, b in itertools.combinations(sorted(model.families), 2):
        for name, positive in ((a, True), (b, False)):
            for lang in model.families[name]:
                # A family's languages share its part of the sample.
                roles[lang].append(("family", a, b, positive, -(-sample // len(model.families[name]))))
    for langs in model.families.values():
        for a, b in itertools.combinations(langs, 2):
            roles[a].append(("lang", a, b, True, sample))
            roles[b].append(("lang", a, b, False, sample))
    if not any(roles.values()):
        return model
    parts = F.create_map(*[
        x for lang, r in sorted(roles.items()) if r for x in (F.lit(lang), F.array(*[
            F.struct(F.lit("\t".join(k)).alias("machine"), F.lit(p).alias("positive"), F.lit(top).alias("top")) for *k, p, top in r]))])
    sides = vectors.withColumn("role", F.explode(parts[F.col("lang")])).where("place <= role.top")
    sides = sides.select("role.machine", "role.positive", "turn", "x")
    # One row of 4097 weights for each two languages of a family and each two families.
    for r in sides.groupBy("machine").applyInArrow(_machine, "machine string, w binary").collect():
        model.machines[tuple(r.machine.split("\t"))] = np.frombuffer(r.w, np.float32)
    return model


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs`` (doc_id, text); or the columns ``keep`` and the last two.

    A text that is NULL or has no letter is ``und`` with the score 0, and so is
    every text if no language was learned. The score is the confidence of the
    narrowest vote that the winner has won. Repeated rows get equal results; a
    NULL doc_id counts as held out. Texts are read whole, other columns are not
    looked at, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            for row, texts in words.texts_of(batch.column(1), 1 << 20):
                n = len(texts)
                letter = batch.column(0).slice(row, n).to_numpy(zero_copy_only=False).astype(bool)
                lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if model.langs:
                    named, sure = model.predict(features(texts))
                    lang[letter], score[letter] = named[letter], sure[letter]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, n) for i in range(2, batch.num_columns)), pa.array(lang, pa.string()), pa.array(score)],
                    names)

    seen = [F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"), F.lower("text").alias("_lower")]
    own = [F.col(f"`{c}`") for c in keep] or [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out")]
    slim = docs.select(*seen, *own)
    schema = T.StructType(slim.schema.fields[2:]).add("lang_pred", "string").add("score", "double")
    names = schema.names
    return slim.mapInArrow(run, schema)
