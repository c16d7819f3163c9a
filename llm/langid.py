"""Language identification: a linear SVM picks the language family, then one-versus-one linear SVMs
separate the languages of that family.

Features are byte 2-, 3- and 4-grams of the whole text (letters only, lower case), hashed into ``DIMS``
places, as square roots of relative frequencies. The models are fitted on the driver on a sample of at most
``sample_rows`` labelled rows (documented bound; drawn by a hash of the id, about evenly over languages);
feature work and prediction run in tasks over all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0. With no labelled row every
text is ``und``; with one language every text is that language. Repeated rows get equal results; extra
columns are kept. A row without id is never a training row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import byte_slices, free_name, release_worker, roomy, spread, text_bytes

if TYPE_CHECKING:
    import pandas as pd

DIMS = 4096
SAMPLE_ROWS = 2400

#: Language code -> family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tt"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), f"alone:{lang}")


LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
PAD = 3


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``DIMS`` values per text; a text without letters has zeros only."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for a, b in byte_slices(texts):
        for c in range(a, b, 256):
            d = min(b, c + 256)
            out[c:d] = slice_features(texts.slice(c, d - c))
    return out


def slice_features(texts: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(texts)
    n = len(texts)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    low = LETTERS[raw]
    # capitals of the Latin-1 letters, whose second byte differs by 32
    low[1:] += np.where((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E), 32, 0).astype(np.uint8)
    # blanks between texts, so that no n-gram reaches into the next one
    line = np.full(len(raw) + PAD * (n + 1), 32, np.uint32)
    line[np.arange(len(raw)) + PAD * (doc + 1)] = low
    owner = np.zeros(len(line), np.int64)
    owner[np.arange(len(raw)) + PAD * (doc + 1)] = doc
    at = np.flatnonzero(line[: len(line) - PAD] != 32)
    doc = owner[at]
    total = np.zeros((n, DIMS), np.float32)
    gram = line[at]
    for k in range(1, 4):
        gram = (gram << np.uint32(8)) | line[at + k]
        place = ((gram * np.uint32(2654435761)) + np.uint32(k * 40503)) >> np.uint32(20)
        total += np.bincount(doc * DIMS + place, minlength=n * DIMS).reshape(n, DIMS)
    weight = total.sum(1, keepdims=True)
    return np.sqrt(total / np.maximum(weight, 1)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge loss, classes weighted evenly) by accelerated gradient steps; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    mean = x.mean(0)
    x = x - mean  # the only copy
    squares = np.concatenate([(x[a : a + 256] ** 2).sum(1) for a in range(0, len(x), 256)])
    scale = np.float32(1 / max(np.sqrt(squares.mean()), 1e-6))
    x *= scale
    w = np.zeros(x.shape[1], np.float32)
    bias = np.float32(0)
    ahead, ahead_bias, step = w, bias, np.float32(0.2)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead + ahead_bias)).astype(np.float32)
        g = -2 * weight * y * slack
        new, new_bias = ahead - step * (x.T @ g + ridge * ahead), ahead_bias - step * g.sum()
        pace = np.float32(i / (i + 3))
        ahead, ahead_bias = new + pace * (new - w), new_bias + pace * (new_bias - bias)
        w, bias = new, new_bias
    w = w * scale
    return w, float(bias - mean @ w)


@dataclass
class Model:
    """families: name -> (weights, bias) against all others; pairs: (a, b) -> weights, positive for a."""

    langs: dict[str, list[str]] = field(default_factory=dict)
    families: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language and a score from 0 to 1 (share of the family times share of the language) of each row."""
        names = list(self.langs)
        if not names:
            return np.full(len(x), "und", object), np.zeros(len(x))
        if len(names) > 1:
            margin = np.stack([x @ w + b for w, b in (self.families[n] for n in names)], 1)
            odds = np.exp(np.clip(4 * margin, -30, 30))
            best, share = margin.argmax(1), odds.max(1) / odds.sum(1)
        else:
            best, share = np.zeros(len(x), int), np.ones(len(x))
        lang = np.empty(len(x), object)
        for i, name in enumerate(names):
            rows, group = np.flatnonzero(best == i), self.langs[name]
            if len(rows):
                won = np.zeros((len(rows), len(group)))
                for (a, b), (w, bias) in self.pairs.items():
                    if a in group:
                        p = 1 / (1 + np.exp(-np.clip(4 * (x[rows] @ w + bias), -30, 30)))
                        won[:, group.index(a)] += p
                        won[:, group.index(b)] += 1 - p
                win = won.argmax(1)
                lang[rows] = np.array(group, object)[win]
                if len(group) > 1:
                    share[rows] *= won.max(1) / (len(group) - 1)
        return lang, np.clip(share, 0, 1)


def sample_ids(labelled: DataFrame, id_col: str, lang_col: str, rows: int) -> DataFrame:
    """At most ``rows`` ids, drawn by a hash; each language gets about the same number."""
    counts = labelled.groupBy(lang_col).agg(F.count("*").alias("_n"))
    rank = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("_n")
    drawn = labelled.select(id_col, lang_col).join(counts, lang_col).withColumn("_rank", rank)
    return drawn.filter(F.col("_rank") < rows).orderBy("_rank", id_col).limit(rows).select(F.col(id_col).alias("_id"))


def train(docs: DataFrame, usable, sample_rows: int = SAMPLE_ROWS, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Fit on a bounded sample of the rows where ``usable`` holds and the language is known."""
    labelled = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = sample_ids(labelled, "id", "lang", sample_rows)
    chosen = labelled.join(F.broadcast(ids.distinct()), F.col("id") == F.col("_id"), "left_semi").select("lang", "text")

    def work(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], ["lang", "x"])

    # an id may be repeated: the bound holds for rows as well
    got = chosen.mapInArrow(roomy(work), "lang string, x binary").limit(2 * sample_rows).toArrow()
    # the driver has little room: rows come packed, and are unpacked and sorted in one array
    lang = np.array(got.column("lang").to_pylist(), object)
    x = np.empty((len(got), DIMS), np.float32)
    for i, row in enumerate(got.column("x")):
        x[i] = np.frombuffer(zlib.decompress(row.as_buffer()), np.float32)
    del got
    order = fixed_order(lang, x)
    for a in range(0, DIMS, 256):
        x[:, a : a + 256] = x[order, a : a + 256]
    model = fit(lang[order], x)
    del x
    release_worker(encoders=False)  # the driver has little room as well
    return model


def fixed_order(lang: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The order of the rows in training."""
    return np.lexsort((x[:, 0], x[:, 1], lang.astype(str))) if len(lang) else np.zeros(0, int)


def fit(lang: np.ndarray, x: np.ndarray) -> Model:
    order = fixed_order(lang, x)
    if (order != np.arange(len(order))).any():
        lang, x = lang[order], x[order]
    model = Model()
    for name in sorted(set(lang)):
        model.langs.setdefault(family_of(name), []).append(name)
    family = np.array([family_of(v) for v in lang], object)
    if len(model.langs) > 1:
        model.families = {n: svm(x, np.where(family == n, 1, -1).astype(np.float32)) for n in model.langs}
    for group in model.langs.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                rows = (lang == a) | (lang == b)
                model.pairs[a, b] = svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32))
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    place = [f.name for f in kept].index(text_col)

    def work(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(place), 1 << 21):
                part = batch.slice(a, b - a)
                text = part.column(place)
                lang, score = np.full(len(text), "und", object), np.zeros(len(text))
                rows = np.flatnonzero(np.asarray(part.column(len(kept))))
                for c in range(0, len(rows), 256):
                    some = rows[c : c + 256]
                    lang[some], score[some] = model.predict(features(text.take(pa.array(some))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score)], schema.names)

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(free_name(docs, "letter"))
    return spread(docs.select(*[f"`{f.name}`" for f in kept], letter)).mapInArrow(roomy(work), schema)


def accuracy(predicted: pd.DataFrame) -> float:
    known = predicted[predicted["lang"].notna()]
    return float((known["lang"] == known["lang_pred"]).mean())
