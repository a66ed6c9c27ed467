"""Language identification: multinomial naive Bayes over hashed character n-grams.

Both passes work on code points with numpy: n-grams of 1 to 3 characters of a text are
hashed into `BUCKETS` columns; training sums their counts by language with a Spark
aggregation, scoring adds up the rows of a broadcast matrix of log probabilities, which has
`BUCKETS` rows and one column per language whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwalk.llm import wordhash

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Pseudo-count of every bucket.
SMOOTHING = 0.5
UNKNOWN = "und"
#: Languages that a model learns, the most frequent ones of the labelled rows; the matrix then takes 32 MB.
MOST_LANGUAGES = 256
#: Share of labelled texts that may lie under the calibrated gain, and how far below it a text has to be.
RARE = 1e-4
MARGIN = 0.5
#: Bytes that start a character.
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _some_letter(data: np.ndarray) -> bool:
    """Whether a text, read in pieces, has a letter."""
    low = 0
    while low < len(data):
        high = wordhash.cut_at(data, FIRST_BYTE, low + wordhash.SEGMENT_BYTES, len(data)) if len(data) - low > wordhash.SEGMENT_BYTES else len(data)
        if has_letter(data[low:high].tobytes().decode("utf-8", "replace")):
            return True
        low = high
    return False


def _bucket(chained: np.ndarray) -> np.ndarray:
    return ((chained ^ (chained >> np.uint64(29))) * np.uint64(wordhash.MIX_1)) >> np.uint64(50)


def _points(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")


def _long_grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(bytes, n-grams) of one text in pieces that are cut between characters; an n-gram belongs to the piece in which it ends."""
    low, carried = 0, np.zeros(0, np.uint64)
    while low < len(data):
        high = wordhash.cut_at(data, FIRST_BYTE, low + wordhash.SEGMENT_BYTES, len(data)) if len(data) - low > wordhash.SEGMENT_BYTES else len(data)
        raw = data[low:high]
        ends = [10] if low == 0 else [], [10] if high == len(data) else []
        padded = np.concatenate((carried, *(np.array(x, dtype=np.uint64) for x in (ends[0], _points(raw), ends[1]))))
        found, chained = [], np.zeros(len(padded), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            chained = chained[: max(len(padded) - n + 1, 0)] * np.uint64(wordhash.BASE) + padded[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                own = _bucket(chained[max(len(carried) - n + 1, 0) :]).astype(np.int32)
                found.append((own, np.array([len(own)])))
        yield raw, found
        carried = padded[len(padded) - min(len(padded), max(ORDERS) - 1) :]
        low = high


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, end row, n-grams) for runs of rows; n-grams: for each order the buckets of all of them, row after row, and how many each row has.

    A text is seen between two line feeds, so that its ends count as word ends.  A long row
    comes alone, and as often as it has pieces.
    """
    for i, j in wordhash.segments(offsets):
        low = offsets[i]
        if offsets[j] - low > 2 * wordhash.SEGMENT_BYTES:
            for _, found in _long_grams(data[low : offsets[j]]):
                yield i, j, found
            continue
        raw = data[low : offsets[j]]
        points = _points(raw)
        # characters before each row: bytes that do not continue one
        starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets[i : j + 1] - low]
        lengths = np.diff(starts)
        padded = np.full(len(points) + 2 * (j - i), 10, dtype=np.uint64)
        inside = np.ones(len(padded), dtype=bool)
        ends = np.cumsum(lengths + 2)
        inside[ends - 1] = inside[ends - lengths - 2] = False
        padded[inside] = points
        found = []
        chained = np.zeros(len(padded), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            chained = chained[: len(padded) - n + 1] * np.uint64(wordhash.BASE) + padded[n - 1 :] + np.uint64(n)
            if n not in ORDERS:
                continue
            bucket = _bucket(chained)
            # an n-gram that starts in the last n - 1 places of a row would reach into the next
            whole = np.ones(len(padded), dtype=bool)
            for k in range(1, n):
                whole[ends - k] = False
            counts = np.maximum(lengths + 3 - n, 0)
            found.append((bucket[whole[: len(bucket)]].astype(np.int32), counts))
        yield i, j, found


@dataclass(frozen=True)
class Model:
    """Languages in ascending order, and BUCKETS x languages log probabilities with the languages' log priors."""

    languages: tuple[str, ...]
    log_p: np.ndarray
    log_prior: np.ndarray


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> Model:
    """Fits the model to every row that has a text and one of the `most_languages` most frequent languages; no rows give a model without languages.

    Of equally frequent languages the first by name are learned, so a column with many stray
    labels does not stop the job.  What reaches the driver are the summed counts: at most
    BUCKETS rows per language.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    n_docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    languages = tuple(sorted(n_docs))
    code = {x: k for k, x in enumerate(languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(code) * BUCKETS, np.int64)
        for batch in batches:
            langs = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, j, found in grams(*wordhash.text_buffer(batch.column(1))):
                for buckets, counts in found:
                    total += np.bincount(buckets + np.repeat(langs[i:j], counts) * BUCKETS, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    total = np.zeros(len(code) * BUCKETS)
    rows = rows.where(F.col("lang").isin(list(code)))
    if code:
        for r in rows.mapInArrow(task, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
            total[r["cell"]] = r["n"]
    counts = total.reshape(len(code), BUCKETS).T + SMOOTHING
    prior = np.array([n_docs[x] for x in languages], dtype=float)
    return Model(languages, np.log(counts / counts.sum(axis=0)) if code else counts, np.log(prior / prior.sum()) if code else prior)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "gain")) -> DataFrame:
    """docs with three columns, in place of any columns of these `names`: language, score and gain.

    The score is the posterior probability of the language among those learned, near 1 for any
    text of some length.  The gain is the mean over the n-grams of the text of how much more
    likely (natural logarithm) the language makes them than chance, where all buckets are alike;
    below 0 no learned language explains the text, as with encoded data or other scripts (made-up
    words of common letters between blanks stay above 0).  A null text, one without a letter, or a
    model without languages gives `und`, score 0 and a null gain.  Nothing but the text is looked at.
    """
    lowered = {n.lower() for n in names}
    kept = [c for c in docs.columns if c.lower() not in lowered]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = kept.index(text_col)
    schema = docs.select(kept).schema
    for name, kind in zip(names, ("string", "double", "double"), strict=True):
        schema = schema.add(name, kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        by_language = [np.ascontiguousarray(m.log_p[:, k]) for k in range(len(m.languages))]
        for batch in batches:
            data, offsets = wordhash.text_buffer(batch.column(text_at))
            langs: list[str] = []
            scores: list[float] = []
            gains: list[float | None] = []
            points = np.tile(m.log_prior, (batch.num_rows, 1))
            n_grams = np.zeros(batch.num_rows)
            for i, j, found in grams(data, offsets) if m.languages else ():
                for buckets, counts in found:
                    n_grams[i:j] += counts
                    begins = (np.cumsum(counts) - counts)[counts > 0]
                    at = i + np.flatnonzero(counts)
                    for k in range(len(m.languages)):
                        points[at, k] += np.add.reduceat(by_language[k][buckets], begins) if len(begins) else 0.0
            if m.languages:
                best = points.argmax(axis=1)
                posterior = 1 / np.exp(points - points.max(axis=1, keepdims=True)).sum(axis=1)
                gain = (points.max(axis=1) - m.log_prior[best]) / np.maximum(n_grams, 1) + np.log(BUCKETS)
                for r in range(batch.num_rows):
                    known = _some_letter(data[offsets[r] : offsets[r + 1]])
                    langs.append(m.languages[best[r]] if known else UNKNOWN)
                    scores.append(float(posterior[r]) if known else 0.0)
                    gains.append(float(gain[r]) if known else None)
            if not m.languages:
                langs, scores, gains = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [None] * batch.num_rows
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gains, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kept, *names])

    return docs.select(kept).mapInArrow(task, schema)


def least_gain(labelled: DataFrame, model: Model, text_col: str = "text", share: float = RARE, margin: float = MARGIN) -> float:
    """The gain under which a text is none of the learned languages: `margin` below the one that `share` of all labelled texts do not reach, and never above chance (0).

    Short texts full of numbers and addresses have low gains in any language, so the labelled
    rows tell how low they get.  Without labelled texts it is 0.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col("lang").isNotNull()).select(F.col(text_col).alias("text"))
    low = predict(rows, model).agg(F.percentile_approx("gain", share, 100_000).alias("low")).first()["low"]
    return 0.0 if low is None else min(0.0, low - margin)


def held_out(id_col: str = "doc_id"):
    """Rows that the model never learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts the language of every row."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    return predict(docs, model, text_col).withColumn("held_out", held_out(id_col))
