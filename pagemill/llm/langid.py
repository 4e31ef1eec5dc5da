"""Language identification by a convolutional network over bytes, trained and applied with numpy.

Bytes are taken to 128 classes (case folded). A text is cut into windows of ``WINDOW`` bytes; filters
of several widths run over each, their largest answers in a window go through a softmax layer, and a
text's probabilities are the means of its windows', by their letters. One more class, noise, is learned from
labelled texts whose letters are scrambled or drawn anew, so that letters which are no language score low in
every language. At prediction a filter is a sum
of looked-up rows, for single classes and for pairs, so that a batch of windows needs few array steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import fresh, row_slices, text_buffers, without

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
CLASSES = 128
#: About so many labelled rows are learned from, and of each language at least so many where it has them.
TRAIN_ROWS, TRAIN_FEW = 4000, 64
EPOCHS, BATCH, RATE = 8, 64, 0.004
#: Windows of a text that each epoch learns from; over all epochs they are drawn from the whole text.
EACH = 3
#: Every so many-th text is learned from as noise too.
NOISE_EVERY = 4
#: Few rows are gone over more often, so that at least so many steps are made.
MIN_STEPS = 300
BATCH_WINDOWS = 128
UNKNOWN = "und"


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[0x30:0x3A] = 1
    table[0x41:0x5B] = table[0x61:0x7B] = np.arange(2, 28)
    table[0x80:0xC0] = np.arange(28, 92)
    table[0xC0:] = 92 + (np.arange(0xC0, 0x100) - 0xC0) // 2
    return table


CLASS = _classes()


@dataclass
class Model:
    """A network; the last output, after those of the languages, is noise."""

    languages: list[str]
    filters: list[np.ndarray]  # of each width: (width, CLASSES, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray


def windows_of(raw: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Classes of a text's bytes as rows of ``size``, with the bytes that follow each for the widest filter."""
    extra = max(WIDTHS) - 1
    n = -(-len(raw) // size)
    flat = np.zeros(n * size + extra, np.uint8)
    flat[: len(raw)] = CLASS[raw]
    return np.lib.stride_tricks.as_strided(flat, (n, size + extra), (size, 1)).copy()


def letters_of(windows: np.ndarray) -> np.ndarray:
    """Letters (and bytes of other scripts) in each window: how much it can show of a language."""
    return (windows[:, :WINDOW] > 1).sum(axis=1)


def noise_of(text: str, rng: np.random.Generator) -> str:
    """A text with other letters in the places of its letters: its own in another order, or any from a to z."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    kinds, which = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds], bool)[which]
    own = codes[letter]
    codes[letter] = rng.permutation(own) if rng.random() < 0.5 else rng.integers(97, 123, len(own))
    return codes.tobytes().decode("utf-32-le")


def draw(text: str, rng: np.random.Generator, most: int = EPOCHS * EACH) -> np.ndarray:
    """Windows of a whole text to learn from, those with more letters more often; all that have letters if these are few enough."""
    w = windows_of(np.frombuffer(text.encode(), np.uint8))
    letters = letters_of(w)
    if np.count_nonzero(letters) <= most:
        return w[letters > 0]
    return w[rng.choice(len(w), most, replace=False, p=letters / letters.sum())]


def draws(text: str, noise: bool) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text, and of noise made from it (none without ``noise``); equal texts give equal windows."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    return draw(text, rng), draw(noise_of(text, rng) if noise else "", rng)


def train(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """A model of labelled texts; every ``NOISE_EVERY``-th is learned from as noise too."""
    return train_windows([(lang, *draws(t, i % NOISE_EVERY == 0)) for i, (t, lang) in enumerate(zip(texts, labels, strict=True))], seed)


def train_windows(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """Fit filters and softmax by Adam on texts' ``(language, windows, windows of noise)``.

    An epoch takes the next ``EACH`` windows of each text, so that long texts weigh no more than others; a window counts by its letters.
    """
    languages = sorted({lang for lang, w, _ in samples if len(w)})
    number = {x: k for k, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    parts = [(w, number[lang]) for lang, w, _ in samples if len(w)] + [(w, len(languages)) for _, _, w in samples if len(w)]
    sizes = np.array([len(w) for w, _ in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x, y = np.concatenate([w for w, _ in parts]), np.repeat([k for _, k in parts], sizes)
    heavy = letters_of(x).astype(np.float32)
    k = len(languages) + 1
    params = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, k)).astype(np.float32), np.zeros(k, np.float32)]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(max(EPOCHS, -(-MIN_STEPS * BATCH // int(np.minimum(sizes, EACH).sum())))):
        turn = [(starts + (epoch * EACH + j) % sizes)[sizes > j] for j in range(EACH)]
        order = rng.permutation(np.concatenate(turn))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            grads = _gradients(params, x[pick].astype(np.int64), y[pick], heavy[pick])
            step += 1
            for p, g, m, v in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    n = len(WIDTHS)
    return Model(languages, params[:n], params[n], params[n + 1], params[n + 2])


def _gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, heavy: np.ndarray) -> list[np.ndarray]:
    n = len(WIDTHS)
    filters, bias, weight, offset = params[:n], params[n], params[n + 1], params[n + 2]
    tops, best = [], []
    for w, f in zip(WIDTHS, filters, strict=True):
        z = sum(f[j][x[:, j : j + WINDOW]] for j in range(w))
        at = z.argmax(axis=1)
        best.append(at)
        tops.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
    pre = np.concatenate(tops, axis=1) + bias
    hidden = np.maximum(pre, 0)
    logits = hidden @ weight + offset
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (heavy / heavy.sum())[:, None]
    back = (p @ weight.T) * (pre > 0)
    out = []
    for i, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
        g = np.zeros_like(f)
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):
            seen = np.take_along_axis(x, best[i] + j, 1)
            np.add.at(g[j], (seen, np.arange(FILTERS)[None, :]), part)
        out.append(g)
    return [*out, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


class Predictor:
    """Look-up tables of a model: for each width, rows for pairs of classes and for a single one."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = []
        for w, f in zip(WIDTHS, model.filters, strict=True):
            parts = []
            for j in range(0, w - 1, 2):
                parts.append((j, True, (f[j][:, None, :] + f[j + 1][None, :, :]).reshape(-1, FILTERS)))
            if w % 2:
                parts.append((w - 1, False, f[w - 1]))
            self.tables.append(parts)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window's languages, then of noise."""
        out = []
        for lo in range(0, len(x), BATCH_WINDOWS):
            part = x[lo : lo + BATCH_WINDOWS].astype(np.int32)
            pairs = (part[:, :-1] << 7) | part[:, 1:]
            tops = []
            for parts in self.tables:
                z = None
                for j, paired, table in parts:
                    got = table[(pairs if paired else part)[:, j : j + WINDOW]]
                    z = got if z is None else np.add(z, got, out=z)
                tops.append(z.max(axis=1))
            hidden = np.maximum(np.concatenate(tops, axis=1) + self.model.bias, 0)
            logits = hidden @ self.model.weight + self.model.offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (its number) and score of each text; -1 and 0 for empty texts."""
        k = len(self.model.languages) + 1
        total, heavy = np.zeros((len(offs) - 1, k)), np.zeros(len(offs) - 1)
        pending, rows, held = [], [], 0

        def flush():
            nonlocal pending, rows, held
            x, row = np.concatenate(pending), np.concatenate(rows)
            p, letters = self.windows(x), letters_of(x) + 1e-3
            for c in range(k):
                total[:, c] += np.bincount(row, p[:, c] * letters, minlength=len(total))
            heavy[:] += np.bincount(row, letters, minlength=len(total))
            pending, rows, held = [], [], 0

        for i in range(len(offs) - 1):
            lo, end = int(offs[i]), int(offs[i + 1])
            while lo < end:
                hi = min(end, lo + 4096 * WINDOW)
                w = windows_of(buf[lo:hi])
                pending.append(w)
                rows.append(np.full(len(w), i))
                held += len(w)
                if held >= 4096:
                    flush()
                lo = hi
        if pending:
            flush()
        mean = (total / np.maximum(heavy, 1e-9)[:, None])[:, :-1]
        best = np.where(heavy > 0, mean.argmax(axis=1), -1)
        return best, np.where(heavy > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, few: int = TRAIN_FEW) -> Model | None:
    """A model of the labelled rows outside the held-out fold; None where there are none with a letter.

    It learns from a bounded sample of rows, picked by a hash of id and text: about 1.2 times ``rows``, shared over the languages by
    their rows, and about ``few`` of a language whose share is less (all it has, if fewer). Of each, windows are drawn in the tasks from the
    whole text, however long, so that the driver gets at most ``EPOCHS * EACH`` windows a row, and as many of noise for some. Null texts, ids and labels and
    empty texts are not learned from; rows that repeat count once; other columns are not looked at.
    """
    usable = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.col(text) != ""))
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    total = sum(counts.values())
    if not total:
        return None
    shares = {x: min(1.0, max(1.2 * rows / total, few / n)) for x, n in counts.items()}
    bound = F.create_map(*(F.lit(v) for x, s in shares.items() for v in (x, int(s * 1_000_000))))
    marked = usable.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text, F.lit(11)).alias("mark"), F.pmod(F.xxhash64(doc_id, text, F.lit(12)), F.lit(1_000_000)).alias("place"), F.col(text).alias("text"), bound[F.col(lang)].alias("bound"))
    picked = marked.filter("place < bound").select("lang", "mark", "text").dropDuplicates(["lang", "mark"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, marks, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                own, noise = draws(texts[i].as_py(), marks[i].as_py() % NOISE_EVERY == 0)
                yield pa.record_batch([langs.slice(i, 1), marks.slice(i, 1), pa.array([own.tobytes()]), pa.array([noise.tobytes()])], names=["lang", "mark", "own", "noise"])

    found = sorted(picked.mapInArrow(windows, "lang string, mark long, own binary, noise binary").collect(), key=lambda r: (r[0], r[1]))
    table = lambda raw: np.frombuffer(raw, np.uint8).reshape(-1, WINDOW + max(WIDTHS) - 1)
    samples = [(r.lang, table(r.own), table(r.noise)) for r in found if r.own]
    return train_windows(samples) if samples else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` from the whole text; every row and every other column stays.

    The score is the mean probability of the best language (ties: the first by name); noise takes what the languages
    do not have. ``und`` with score 0 where the text is null or has no letter, or without a model. Repeated rows get
    equal results; columns of the two names give way; an empty table gives no rows.
    """
    docs = without(docs, "lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    given = docs.withColumn(fresh(docs, "_letter"), letter)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            buf, offs = text_buffers(batch.column(batch.schema.get_field_index(text)))
            for lo, hi in row_slices(offs):
                part = batch.slice(lo, hi - lo)
                best, score = predictor.texts(buf, offs[lo : hi + 1])
                has = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                best = np.where(has, best, -1)
                arrays = [*part.columns[:-1], pa.array(names[best], pa.string()), pa.array(np.where(has, score, 0.0), pa.float64())]
                yield pa.record_batch(arrays, schema=None, names=schema.names)

    return given.mapInArrow(labelled, schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
