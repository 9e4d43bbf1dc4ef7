"""Language identification in two levels: a linear machine chooses the language family, then one-versus-one linear support
vector machines separate the languages inside it.

A text is the square roots of its hashed letter-trigram counts, scaled to length 1. The machines are trained by dual
coordinate descent on a bounded sample: about PER_LANGUAGE rows of each language, chosen by hash from all labelled rows
that are not held out; a family's machine sees its own rows of that sample against REST rows of all languages alike. These
bounds are parameters; every language with a labelled row is learned, and everything else covers all rows. Machines are
trained side by side on the executors; only the REST rows and the weights (one vector a family and a pair of languages in
it) come to the driver.

Defined cases: null text or one without a letter is `und` with score 0; a null language is not learned from; rows that are
repeated in id and text are learned from once; without any learned language, every text is `und`; one learned language is
predicted for every text with a letter, with score 1; a tie goes to the family or language that comes first by code point;
a text of any length is read whole, in a run of its own if it is long; other columns are not read, so their names can't
clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, prepare, runs, utf8_views

PER_LANGUAGE = 400
REST = 2000
BITS = 12
RUN = 1 << 19
UNDETERMINED = "und"

# Families of languages by ISO 639-1 code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ur", "ne"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def family(code: str) -> str:
    return _FAMILY.get(code.split("-")[0].lower(), f"={code}")


def vectors(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of unit length with 2^BITS columns; zero for a text without letters. Trigrams stay within a text."""
    n, width = len(off) - 1, 1 << BITS
    if len(raw) < 3 or not n:
        return np.zeros((n, width), np.float32)
    c = _LETTER[raw].astype(np.uint32)
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    blank = (c[:-2] == 0x20) & (c[1:-1] == 0x20) | (c[1:-1] == 0x20) & (c[2:] == 0x20)
    text = np.repeat(np.arange(n), np.diff(off))[:-2]
    last = np.repeat(off[1:], np.diff(off))[:-2]
    use = ~blank & (np.arange(len(code)) + 2 < last)
    counts = np.bincount(text[use] * width + slot[use].astype(np.int64), minlength=n * width).reshape(n, width)
    x = np.sqrt(counts, dtype=np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def has_letter(column: pa.Array, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """True where a text holds a letter (any script). ASCII letters are found in bytes, others by their characters."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = True
    found = np.concatenate([[0], np.cumsum(ascii_letter[raw[off[0] : off[-1]]])])
    out = found[off[1:] - off[0]] > found[off[:-1] - off[0]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = any(ch.isalpha() for ch in column[i].as_py() or "")
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights and bias of an L2-loss linear support vector machine (y = +1 or -1), by dual coordinate descent; classes
    count alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    balance = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    diag = 1 / (2 * cost * balance)
    norm = np.einsum("ij,ij->i", x, x) + diag
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            new = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + diag[i] * alpha[i]) / norm[i], 0.0)
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


@dataclass
class Model:
    """families: names; of[f]: its languages; top: weights a family; pairs[f]: (i, j, weights) of languages i over j."""

    families: list[str] = field(default_factory=list)
    of: list[list[str]] = field(default_factory=list)
    top: np.ndarray | None = None
    pairs: list[list[tuple[int, int, np.ndarray]]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the logistic of the family's lead, times that of the weakest duel the language won."""
        n = len(x)
        if not self.families:
            return [UNDETERMINED] * n, np.zeros(n)
        sure, chosen = np.ones(n), np.zeros(n, np.int64)
        if self.top is not None:
            margin = x @ self.top[:, :-1].T + self.top[:, -1]
            chosen = margin.argmax(1)
            rest = margin.copy()
            rest[np.arange(n), chosen] = -np.inf
            sure = _logistic(2 * (margin.max(1) - rest.max(1)))
        names = np.empty(n, object)
        for f, languages in enumerate(self.of):
            rows = np.flatnonzero(chosen == f)
            if not len(rows):
                continue
            votes, lead = np.zeros((len(rows), len(languages))), np.full((len(rows), len(languages)), np.inf)
            for i, j, w in self.pairs[f]:
                m = x[rows] @ w[:-1] + w[-1]
                votes[:, i] += (m >= 0) + _logistic(m) * 1e-3
                votes[:, j] += (m < 0) + _logistic(-m) * 1e-3
                lead[:, i], lead[:, j] = np.minimum(lead[:, i], m), np.minimum(lead[:, j], -m)
            best = votes.argmax(1)
            names[rows] = [languages[b] for b in best]
            if self.pairs[f]:
                sure[rows] *= _logistic(4 * lead[np.arange(len(rows)), best])
        return list(names), sure


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def layout(languages: list[str]) -> Model:
    """A model without weights."""
    known = sorted(set(languages))
    families = sorted({family(c) for c in known})
    return Model(families, [[c for c in known if family(c) == f] for f in families], None, [[] for _ in families])


def machines_of(model: Model) -> dict[str, list[str]]:
    """The machines that each language's rows are positive or negative examples of: its family's, and its duels."""
    out: dict[str, list[str]] = {}
    for f, languages in enumerate(model.of):
        for code in languages:
            out[code] = [f"{f}"] if len(model.families) > 1 else []
        for i, j in combinations(range(len(languages)), 2):
            for k in (i, j):
                out[languages[k]].append(f"{f}.{i}.{j}")
    return out


def train_machine(name: str, x: np.ndarray, lang: np.ndarray, model: Model, rest_x: np.ndarray, rest_lang: np.ndarray) -> np.ndarray:
    f, *duel = map(int, name.split("."))
    if duel:
        return train_svm(x, np.where(lang == model.of[f][duel[0]], 1.0, -1.0))
    others = np.array([family(c) != model.families[f] for c in rest_lang], bool)
    return train_svm(np.vstack([x, rest_x[others]]), np.append(np.ones(len(x)), -np.ones(others.sum())))


def fill(model: Model, weights: dict[str, np.ndarray]) -> Model:
    if len(model.families) > 1:
        model.top = np.stack([weights[f"{f}"] for f in range(len(model.families))])
    for f, languages in enumerate(model.of):
        model.pairs[f] = [(i, j, weights[f"{f}.{i}.{j}"]) for i, j in combinations(range(len(languages)), 2)]
    return model


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, rest: int = REST) -> Model:
    """Fit on about per_language rows of each language: those whose hash lies under the language's own threshold."""
    spark = prepare(docs.sparkSession)
    h = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text)), 1)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # the model has every language
    model = layout(list(counts))
    if not model.families:
        return model
    named = machines_of(model)
    # a row a language: far smaller than the model, which every task gets as well
    table = spark.createDataFrame([(code, counts[code], own) for code, own in named.items()], "lang string, n long, machines array<string>")
    # the rows of a repeated text share a hash, so they are one row here and a language's sample stays bounded
    sample = rows.join(F.broadcast(table), "lang").where(F.col("h") <= F.least(F.lit(float(per_language)) / F.col("n"), F.lit(1.0)) * float((1 << 63) - 1))
    sample = sample.dropDuplicates(["h", "lang"]).select("h", "lang", "text", "machines", (F.col("h") <= F.lit(rest / len(named)) / F.col("n") * float(1 << 63)).alias("rest"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, raw = utf8_views(batch.column("text"))
            x = [vectors(raw[off[a] : off[b]], off[a : b + 1] - off[a]).astype(np.float16) for a, b in runs(off, RUN)]
            packed = [row.tobytes() for part in x for row in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("lang"), batch.column("machines"), batch.column("rest"), pa.array(packed, pa.binary())], ["h", "lang", "machines", "rest", "x"]
            )

    ready = materialize(sample.mapInArrow(frugal(work), "h long, lang string, machines array<string>, rest boolean, x binary"), "lang-sample")
    found = ready.where("rest").orderBy("h", "lang").limit(4 * rest).select("lang", "x").collect() if len(model.families) > 1 else []  # about REST rows
    rest_x, rest_lang = unpacked([r["x"] for r in found]), np.array([r["lang"] for r in found], object)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "lang"])
        name = pdf["machine"].iloc[0]
        w = train_machine(name, unpacked(list(pdf["x"])), pdf["lang"].to_numpy(), model, rest_x, rest_lang)
        return pd.DataFrame({"machine": [name], "w": [w.astype("<f8").tobytes()]})

    parts = ready.select("h", "lang", "x", F.explode("machines").alias("machine"))
    weights = parts.groupBy("machine").applyInPandas(train, "machine string, w binary").collect()
    return fill(model, {r["machine"]: np.frombuffer(r["w"], "<f8") for r in weights})


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), 1 << BITS).astype(np.float32)


def predict_column(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    off, raw = utf8_views(column)
    names: list[str] = []
    scores: list[np.ndarray] = []
    for a, b in runs(off, RUN):
        own, sure = model.predict(vectors(raw[off[a] : off[b]], off[a : b + 1] - off[a]))
        names += own
        scores.append(sure)
    score = np.concatenate(scores) if scores else np.zeros(0)
    if len(off) > 1:
        ok = has_letter(column, off, raw)
        score = np.where(ok, score, 0.0)
        names = [n if k else UNDETERMINED for n, k in zip(names, ok)]
    return names, score


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score (0 to 1)."""
    model = learn(docs, id_col, text, lang)
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict_column(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return source.mapInArrow(frugal(work), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.0) -> DataFrame:
    """The documents whose language is determined with a score above `least`, all columns as they were."""
    model = learn(docs, id_col, text, lang)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict_column(model, batch.column(text))
            yield batch.filter(pa.array([n != UNDETERMINED and s > least for n, s in zip(names, score)], pa.bool_()))

    return docs.mapInArrow(frugal(work), docs.schema)
