"""Fill-in-the-middle: texts are cut into prefix, middle and suffix and put together in another order, by DuckDB in the tasks.

Each Arrow batch of a task is registered with a DuckDB of its own and comes back as Arrow from one SELECT; no row passes through
Python. A batch is dealt to DuckDB in slices of SLICE bytes of text, so that the lists of tokens of some megabytes of text
exist at a time, whatever a batch holds. All draws are read from the SHA-256 of the id, so that a repeated task, another
batching or another cluster makes the same cuts. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.shared import col, let

#: The units that texts are cut into, the marks, and the percentages of transformed texts and, of these, of
#: those that begin with the suffix.
TOKEN, PREFIX, SUFFIX, MIDDLE, TRANSFORMED, SUFFIX_FIRST = "[A-Za-z]+|[^A-Za-z]", "<P>", "<S>", "<M>", 90, 20
SLICE = 4 << 20
OUTPUT = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def sql(source: str, seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> str:
    """DuckDB SQL over a relation (id, text): id, n, form, prefix_chars, middle_chars, output, text (null as empty)."""
    draws = ", ".join(f"CAST('0x' || h[{8 * i + 1}:{8 * i + 8}] AS BIGINT) AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    part = lambda a, b: f"array_to_string(list_slice(tokens, {a}, {b}), '')"
    return f"""SELECT id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output, text
FROM (SELECT *, {part("1", "a")} AS prefix, {part("a + 1", "b")} AS middle, {part("b + 1", "n")} AS suffix
FROM (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN text = '' OR {marked} OR h3 % 100 >= {transformed} THEN 'plain' WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
FROM (SELECT id, text, tokens, CAST(len(tokens) AS BIGINT) AS n, {draws}
FROM (SELECT id, text, regexp_extract_all(text, '{TOKEN}') AS tokens, sha256('{seed}:' || coalesce(CAST(id AS VARCHAR), '')) AS h
FROM (SELECT id, coalesce(text, '') AS text FROM {source})))))"""


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about `most` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1, len(sizes))
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def _transform(statement: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as own:
            for batch in batches:
                for part in _slices(batch, most):
                    own.register("batch", pa.Table.from_batches([part]))
                    yield from own.sql(statement).to_arrow_table().cast(_ARROW).to_batches()

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row a document: id_col, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    A null text is an empty one; empty texts and those that hold a mark are plain. A null id draws as an id without digits.
    Rows of one id are cut at the same draws, repeated rows alike. Whole texts of any length; an empty table gives no rows.
    Ids are integers; other columns are not read.
    """
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    statement = f"SELECT id, n, form, prefix_chars, middle_chars, output FROM ({sql('batch', seed, transformed, suffix_first)})"
    return rows.mapInArrow(_transform(statement, SLICE), OUTPUT).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: what lies between the marks, in its first order."""
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    marks = "|".join((PREFIX, SUFFIX, MIDDLE))
    of = lambda kind: let(F.split(output, marks, -1), lambda parts: F.concat(*[F.get(parts, i) for i in order[kind]]))
    return F.when(form == "psm", of("psm")).when(form == "spm", of("spm")).otherwise(output)
