"""Token counts from distinct pre-tokens.

Byte-level BPE never merges across its pre-tokens, so a text has as many tokens as the sum over its pre-tokens. Three
steps, none of which holds ids:

1. Every task counts the pre-tokens of its texts; their sums over the corpus are the vocabulary.
2. Each distinct pre-token's pieces are counted once.
3. Texts are cut again. Each pre-token is a row (document, pre-token, frequency) that is joined to the vocabulary, and the
   products are summed by document. Only the most frequent pre-tokens, `head` of them at most, are priced in the task: they
   would be the join's hot keys. A pre-token outside them has under 1 / head of all occurrences.

Where white space comes as single spaces and line ends, a pre-token is a space-delimited chunk with the white space before
it (a run of whole library pre-tokens); other texts are cut by the library.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.shared import SALTS, col, staged

#: Pre-tokens that are looked up in the tasks, and the most characters that one of them has: some 5 MB, 20 MB at most, whatever
#: the corpus. Longer ones are joined, with salts, as one of them may be in many texts.
HEAD, HEAD_CHARS, FLUSH, ROWS = 1 << 16, 64, 400_000, 50_000
#: Characters of texts after which a task hands on what it has counted, however few entries that is.
CHARS = 1 << 25
_ODD = re.compile(r"[^\S \n]|\s\s(?:\s|\Z)")
_VOCAB = pa.schema([("token", pa.string()), ("n", pa.int64())])
_COUNTS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("token", pa.string()), ("salt", pa.int64()), ("n", pa.int64())])
_CUTTERS: dict[str, Cutter] = {}


class Cutter:
    """Cuts texts into pre-tokens and counts the pieces of one, by a tokenizer file with byte-level pre-tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.pre, self.model = library.pre_tokenizer, library.model
        added = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def count(self, text: str) -> tuple[Counter, int]:
        """Frequencies of a text's pre-tokens, and its added tokens, which are one token each."""
        if self.added and (special := len(self.added.findall(text))):
            return Counter(p for part in self.added.split(text) for p in self._cut(part)), special
        if _ODD.search(text):
            return Counter(self._cut(text)), 0
        first, *rest = text.replace("\n", " \n").split(" ")
        found = Counter({c if c[:1] == "\n" else " " + c: n for c, n in Counter(rest).items()})
        if first:
            found[first] += 1
        return found, 0

    def _cut(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def pieces(self, token: str) -> int:
        return sum(len(self.model.tokenize(mapped)) for mapped, _ in self.pre.pre_tokenize_str(token))


def cutter(name: str) -> Cutter:
    if name not in _CUTTERS:
        path = name
        if os.sep not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _CUTTERS[name] = Cutter(path)
    return _CUTTERS[name]


def _vocabulary(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, total, read = cutter(tokenizer), Counter(), 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], schema=_VOCAB)
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                total.update(cut.count(text)[0])
                read += len(text)
                if len(total) > FLUSH or read > CHARS:
                    yield table()
                    total, read = Counter(), 0
        yield table()

    return run


def _pieces(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([cut.pieces(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["token", "freq", "pieces"])

    return run


def _by_document(tokenizer: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = cutter(tokenizer), head.value
        rows: list[tuple] = []
        read = 0
        for batch in batches:
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                found, total = cut.count(text)
                for token, n in found.items():
                    pieces = known.get(token)
                    if pieces is None:
                        rows.append((row, None, None, token, row % SALTS if len(token) > HEAD_CHARS else 0, n))
                    else:
                        total += n * pieces
                rows.append((row, doc, len(text.encode("utf-8", "surrogatepass")), "", row + 1, total))
                read += len(text)
                if len(rows) >= ROWS or read > CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)], schema=_COUNTS)
                    rows, read = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)], schema=_COUNTS)

    return run


def _grade():
    """Frequencies in steps of an eighth of a power of two: at most 512 grades."""
    return F.floor(F.log2("freq") * 8).cast("int")


def _lowest(known: DataFrame, head: int) -> int:
    """The lowest grade from which on there are no more than `head` pre-tokens."""
    left, lowest = head, 1 << 30
    for grade, n in sorted(((r.g, r.n) for r in known.groupBy(_grade().alias("g")).agg(F.count("*").alias("n")).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        lowest = grade
    return lowest


def vocabulary(docs: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row a distinct pre-token of all texts: token, freq, pieces."""
    counted = docs.select(col(text_col).alias("text")).mapInArrow(_vocabulary(tokenizer), "token string, n long")
    distinct = counted.groupBy("token").agg(F.sum("n").alias("freq"))
    return distinct.mapInArrow(_pieces(tokenizer), "token string, freq long, pieces long")


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", head: int = HEAD) -> DataFrame:
    """One row a document: id_col, n_bytes (UTF-8), n_tokens, as the tokenizers library counts them without added begin or end.

    Added tokens inside texts are one token each, as is the library's default. A null text counts as empty: 0 bytes and
    tokens. Ids are integers and may be null or repeat: rows are told apart. A very long text is cut whole, in one task, and
    its pre-tokens leave it in batches. A pre-token that the vocabulary lacks, as where texts change under the query, is an
    error. An empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    known = staged(vocabulary(docs, text_col, tokenizer), "pre-tokens")
    short = known.where(F.length("token") <= HEAD_CHARS)
    top = {r.token: r.pieces for r in short.where(_grade() >= _lowest(short, head)).select("token", "pieces").toLocalIterator()}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    counts = rows.mapInArrow(_by_document(tokenizer, spark.sparkContext.broadcast(top)), "row long, id long, n_bytes long, token string, salt long, n long")
    return priced(counts, known).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def priced(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of pre-tokens by row times their pieces, summed up by row: row, id, n_bytes, n_tokens.

    A row's own entry, with its id, bytes and what the task has summed up, has an empty pre-token and a salt of its own.
    """
    salts = F.when(F.length("token") > HEAD_CHARS, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    joined = counts.join(known.select("token", F.explode(salts).alias("salt"), "pieces"), ["token", "salt"], "left")
    missing = F.raise_error(F.concat(F.lit("a pre-token is not in the vocabulary: "), F.col("token"))).cast("long")
    total = F.sum(F.col("n") * F.when(F.col("token") == "", F.lit(1)).when(F.col("pieces").isNull(), missing).otherwise(F.col("pieces")))
    return joined.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
