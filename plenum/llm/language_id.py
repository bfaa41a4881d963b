"""Operator 1: language identification by averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed subwords (2 to 4 bytes within blank-bounded words, ASCII lower
case); one linear layer gives the languages. Embeddings and layer are trained together by stochastic gradient descent in
numpy on a bounded, documented sample (about ``PER_LANGUAGE`` documents of each of at most ``LANGUAGES`` languages, twice
as many together at most, ``WORDS`` words drawn from anywhere in each). A part of the sample is set aside: it fits the temperature that calibrates the scores
and the score under which a text is rejected.

For prediction the product of embeddings and layer is a table of bounded size, sent to every task once; documents are
read once, whole, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.bytetext import lower_table, text_slices

BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 800
LANGUAGES = 100
WORDS = 64
STEPS = 320
REJECT_SHARE = 0.001
REJECT_MOST = 0.5
UNKNOWN = "und"


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x61:0x7B] = table[0x80:] = True
    return table


_LETTER, _LOWER = _letters(), lower_table()


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of all subwords; what is no letter stands as a blank, and every row has one before it."""
    text = np.append(np.insert(_LOWER[data], offsets[:-1], 32), np.uint8(32))
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    letter = _LETTER[text]
    text = np.where(letter, text, 32).astype(np.uint32)
    rows = np.cumsum(np.bincount(begins, minlength=len(text))) - 1
    found, owners = [], []
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        code, valid = np.zeros(m, np.uint32), letter[:m] | letter[n - 1 : n - 1 + m]
        for j in range(n):
            code = (code ^ text[j : j + m]) * np.uint32(0x01000193) + np.uint32(n)
            if 0 < j < n - 1:
                valid &= letter[j : j + m]
        at = np.flatnonzero(valid)
        code = code[at]
        found.append((code ^ (code >> np.uint32(15))) & np.uint32(BUCKETS - 1))
        owners.append(rows[at])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times layer over temperature
    bias: np.ndarray
    threshold: float
    held: float  # accuracy on the part that was set aside

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        buckets, rows = subwords(data, offsets)
        totals = np.stack([np.bincount(rows, weights=self.table[buckets, k], minlength=n) for k in range(len(self.languages))], axis=1)
        return softmax(totals / np.maximum(np.bincount(rows, minlength=n), 1)[:, None] + self.bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded training sample: (lang, words) of documents that are not held out."""
    learn = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("id")) % 5 != 0))
    counts = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, PER_LANGUAGE / r["count"]))))
    drawn = learn.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30))
    words = F.transform(F.split("text", r"\s+"), lambda w, i: F.struct(F.xxhash64(w, i).alias("h"), w.alias("w")))
    some = F.transform(F.slice(F.array_sort(words), 1, WORDS), lambda x: F.substring(x["w"], 1, 64))
    rows = drawn.select("lang", F.array_join(some, " ").alias("words"), F.xxhash64("id", "text").alias("h")).orderBy("h", "lang").limit(2 * PER_LANGUAGE * len(counts)).collect()
    return [(r["lang"], r["words"]) for r in rows]


def train(rows: list[tuple[str, str]], *, steps: int = STEPS, seed: int = 7) -> Model:
    """Fits a model to (lang, text) rows; every fifth row is set aside for calibration."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0, 0.0)
    raw = [text.encode() for _, text in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    buckets, owners = subwords(np.frombuffer(b"".join(raw), np.uint8), offsets)
    order = np.argsort(owners, kind="stable")
    buckets, owners = buckets[order].astype(np.int64), owners[order]
    cut = np.searchsorted(owners, np.arange(len(rows) + 1))
    label = np.array([languages.index(lang) for lang, _ in rows])
    aside = np.arange(len(rows)) % 5 == 4
    if len(rows) < 10:
        aside[:] = False
    rng, k = np.random.default_rng(seed), len(languages)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, k)), np.zeros(k)
    learn = np.flatnonzero(~aside)

    def batch(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of some documents, and each document's shares of them."""
        own = np.concatenate([buckets[cut[i] : cut[i + 1]] for i in ids])
        doc = np.repeat(np.arange(len(ids)), cut[ids + 1] - cut[ids])
        used, place = np.unique(own, return_inverse=True)
        shares = np.bincount(doc * len(used) + place, minlength=len(ids) * len(used)).reshape(len(ids), len(used)).astype(float)
        return used, shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)

    for step in range(steps):
        ids = rng.choice(learn, min(32, len(learn)), replace=False)
        used, shares = batch(ids)
        rate = 25.0 * (1 - step / steps) + 0.1
        hidden = shares @ embedding[used]
        wrong = softmax(hidden @ layer + bias)
        wrong[np.arange(len(ids)), label[ids]] -= 1
        wrong /= len(ids)
        embedding[used] -= rate * (shares.T @ (wrong @ layer.T))
        layer -= rate * 0.1 * (hidden.T @ wrong)
        bias -= rate * 0.02 * wrong.sum(axis=0)
    check = np.flatnonzero(aside) if aside.any() else learn
    logits = np.concatenate([(lambda b: b[1] @ embedding[b[0]] @ layer + bias)(batch(check[i : i + 64])) for i in range(0, len(check), 64)])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), label[check]] + 1e-12).mean()
    temperature = min((0.25 * 1.15**i for i in range(30)), key=loss)
    best = softmax(logits / temperature)
    right = best.argmax(axis=1) == label[check]
    threshold = min(REJECT_MOST, float(np.quantile(best.max(axis=1)[right], REJECT_SHARE))) if right.any() else 0.0
    return Model(languages, (embedding @ layer / temperature).astype(np.float32), bias / temperature, threshold, float(right.mean()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_rejected; columns of these names are replaced.

    A text that is null or without a letter is ``und`` with score 0 and rejected; so is every text if nothing could be
    learned. Repeated rows and nulls in other columns pass unchanged.
    """
    made = ["lang_pred", "lang_score", "lang_rejected"]
    kept = docs.drop(*made)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    text = F.col("text").cast("string")
    name = "_text"
    while name in docs.columns:
        name += "_"
    marked = kept.withColumns({name: F.when(text.rlike(r"\p{L}"), text).otherwise(F.lit(None).cast("string"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if model.languages:
                for i, j, data, offsets in text_slices(texts):
                    p = model.scores(data, offsets)
                    best[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            none = np.asarray(texts.is_null()) | (not model.languages)
            score[none] = 0
            names = pa.array([UNKNOWN if x else model.languages[b] for b, x in zip(best.tolist(), none.tolist(), strict=True)], pa.string())
            columns = [*batch.columns[:-1], names, pa.array(np.minimum(score, 1.0)), pa.array(none | (score < model.threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *made])

    return marked.mapInArrow(run, schema)
