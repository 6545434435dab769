"""Language identification as mixture inference.

Every language has a distribution over hashed character n-grams (orders 1 to 3 inside padded words). A document's n-grams
are a draw from a mixture of languages: expectation-maximisation estimates the proportions, and the set of languages is
chosen by likelihood less a penalty for each language, so that a second one is named only where it explains the text.

The counts are sums over all labelled texts, made in the tasks and added up by language and bucket: the model is
languages x buckets numbers, whatever the size of the corpus, and that size is checked before it goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.shared import col, new_names

BUCKETS, SMOOTHING, PENALTY, STEPS, TOLERANCE, CHUNK = 1 << 16, 0.5, 12.0, 500, 1e-3, 1 << 20
#: Texts of fewer n-grams than this are counted by sorting, longer ones in a table of all buckets.
SORTED = 1 << 13
#: A model of more megabytes than this is refused before it is gathered: there would be hundreds of languages.
MODEL_MB = 64
UNKNOWN = "und"
_PREDICTED = "id long, lang_pred string, score double, share double, mixture map<string,double>"
_ARROW = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("share", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _hashes(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, some at a time; nothing where it has no letter."""
    if not text:
        return
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()[codes]
    if not letters.any():
        return
    codes = np.concatenate([[32], np.where(letters, codes, 32), [32]]).astype(np.uint32)
    letters = codes != 32
    for at in range(0, len(codes), CHUNK):
        c, is_letter = codes[at : at + CHUNK + 2], letters[at : at + CHUNK + 2]
        n = min(CHUNK, len(codes) - at)
        one = c * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(0x85EBCA6B) + c[1:]
        three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:]
        # an n-gram starts in this chunk, and holds a letter first (order 1), on either side (2) or in the middle (3)
        orders = enumerate(((one, is_letter), (two, is_letter[:-1] | is_letter[1:]), (three, is_letter[1:-1])))
        yield np.concatenate([(h[:n][held[:n]] + np.uint32(order * 0x27D4EB2F)) * np.uint32(0x9E3779B1) >> np.uint32(16) for order, (h, held) in orders])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets of the text's n-grams, rising, and their counts; None where it has no letter."""
    parts = list(_hashes(text)) if not text or len(text) <= CHUNK else None
    if parts is not None and sum(map(len, parts)) <= SORTED:
        return np.unique(np.concatenate(parts), return_counts=True) if parts else None
    counts = np.zeros(BUCKETS, np.int64)
    for part in parts if parts is not None else _hashes(text):
        counts += np.bincount(part, minlength=BUCKETS)
    held = np.flatnonzero(counts)
    return (held, counts[held]) if len(held) else None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = ngrams(text.as_py())
            if found is not None:
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang][found[0]] += found[1]
    for lang, counts in total.items():
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """log p(bucket | language), a row a bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        smooth = counts.astype(np.float64) + SMOOTHING
        self.langs, self.p = langs, (smooth / smooth.sum(axis=0)).astype(np.float32)

    def infer(self, text: str | None) -> tuple[str, float, float, list[tuple[str, float]]]:
        """Predicted language, score (its share times the chance that no language outside the set fits better), share, mixture."""
        found = ngrams(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0, 0.0, []
        c, p = found[1].astype(np.float64), self.p[found[0]].astype(np.float64)
        alone = c @ np.log(p)
        best = int(alone.argmax())
        chosen, shares = select(c, p, best)
        out = np.delete(alone, chosen)
        sure = 1 / (1 + np.exp(np.minimum(out - alone[chosen].max(), 0)).sum()) if len(out) else 1.0
        top = int(shares.argmax())
        mixture = sorted(((self.langs[i], float(s)) for i, s in zip(chosen, shares, strict=True)), key=lambda x: -x[1])
        return self.langs[chosen[top]], float(min(1.0, shares[top] * sure)), float(shares[top]), mixture


def select(c: np.ndarray, p: np.ndarray, best: int, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The languages of a text and their shares, from counts c and probabilities p (n-gram x language).

    From the best single language on, a language is added while that raises the likelihood by more than the penalty. The
    likelihood is concave in the shares, so no set can gain more than its steepest slope, the sum of c * p / mixture less the
    number of n-grams: languages whose slope is no more than the penalty need no trial. Others are tried from the
    steepest on, and the search ends when none of them gains enough.
    """
    chosen, shares, total = [best], np.ones(1), c.sum()
    mixed = p[:, best]
    value = c @ np.log(mixed)
    while len(chosen) < p.shape[1]:
        slope = (c / mixed) @ p - total
        slope[chosen] = -np.inf
        added = False
        for more in np.argsort(-slope, kind="stable"):
            if slope[more] <= penalty:
                break
            trial = [*chosen, int(more)]
            q = p[:, trial]
            pi = proportions(c, q, np.append(shares * (1 - 1 / len(trial)), 1 / len(trial)))
            together = q @ pi
            if (gained := c @ np.log(together)) - value > penalty:
                chosen, shares, value, mixed, added = trial, pi, gained, together, True
                break
        if not added:
            break
    return chosen, shares


def proportions(c: np.ndarray, p: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Expectation-maximisation of the shares from a start, until no share moves by TOLERANCE."""
    total = c.sum()
    for _ in range(STEPS):
        weighted = p * pi
        now = (c / weighted.sum(axis=1)) @ weighted / total
        if np.abs(now - pi).max() < TOLERANCE:
            return now
        pi = now
    return pi


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all rows whose language and text are not null; no rows give a model that knows no language.

    Whole texts count, of any length, and repeated rows as often as they are there; other columns are not read. More
    languages than MODEL_MB has room for are an error, which comes before anything is gathered.
    """
    rows = labelled.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    known = labelled.agg(F.approx_count_distinct(col(lang_col))).first()[0]  # exact for so few as there may be; reads no text
    if 0.8 * known * BUCKETS * 4 > MODEL_MB << 20:
        raise ValueError(f"{known} languages need a model of over {MODEL_MB} MB")
    summed = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS rows at most
    codes = summed.column("lang").combine_chunks().dictionary_encode()
    names = codes.dictionary.to_pylist() if len(summed) else []
    order = np.argsort(np.array(names, dtype=object))
    counts = np.zeros((BUCKETS, len(names)), np.int64)
    if names:
        counts[summed.column("bucket").to_numpy(), np.argsort(order)[codes.indices.to_numpy()]] = summed.column("n").to_numpy()
    return Model([names[i] for i in order], counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, lang_pred, score, share, mixture (language -> proportion).

    A text that is null or has no letter, or any text where no language was learned, gives "und" with score 0. Whole texts
    count. Ids are integers; null ids and repeated rows stay. An empty table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = [known.infer(t.as_py()) for t in batch.column(1)]
            columns = zip(*found, strict=True) if found else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True)]], schema=_ARROW)

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, _PREDICTED).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", least_share: float = 0.5) -> DataFrame:
    """docs without the rows whose language is unknown or has under `least_share` of the text; a null language is filled in.

    Same columns whatever their names, whole rows; the texts are not shuffled. Null and empty texts, and those without a
    letter, are of unknown language and go; a share that equals the least one stays; repeated rows are judged alike. With a
    model that knows no language, texts with a letter stay and a null language stays null. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,share:double>")
    def judged(texts):
        import pandas as pd

        found = [sent.value.infer(t) if sent.value.langs else (None if ngrams(t) is not None else UNKNOWN, 0, 1.0) for t in texts]
        return pd.DataFrame({"lang": [f[0] for f in found], "share": [f[2] for f in found]})

    (own,) = new_names(docs, "judged")
    rows = docs.withColumn(own, judged.asNondeterministic()(col(text_col)))  # else it runs for the filter and again for the columns
    kept = rows.where(~F.col(own)["lang"].eqNullSafe(F.lit(UNKNOWN)) & (F.col(own)["share"] >= least_share))
    return kept.select(*[F.coalesce(col(c), F.col(own)["lang"]).alias(c) if c == lang_col else col(c) for c in docs.columns])
