r"""Secret scans with an incremental blob ledger.

A version of a file is a row (path, version, text). Its text is addressed by SHA-256. The ledger holds one row for each
(blob, rule version) that was ever scanned, with the spans found, none included. A scan picks one row for each blob that
the ledger lacks at this rule version, runs the rules over these texts alone, and `locate` joins the ledger's findings
back to all paths and versions.

One text stands for a blob, by an aggregate whose partial results leave one text a task and blob, so that texts are shuffled
once and a text of many rows is no hot key. Against a ledger, hashes alone are compared first; where few blobs are new, their
hashes go to all tasks and no seen text moves. Findings are joined back by blob, from the blobs that have any: broadcast where
a count shows that they are few, else repeated for each of a few salts, so that the copies of one blob fall to many keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesieve.llm.shared import col, let, new_names, salted, staged


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in this order. hex and access state their least length in the pattern, which finds the
#: same matches: a run that is too short holds no other match.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}+"),
    Rule("hex", r"[0-9a-f]{32,}+"),
)
_HEADER = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: What may stand between the lines of a key: white space, also escaped, and marks of quotes, comments and concatenation.
_BETWEEN = r"""(?:\\{1,4}[nr]|[\x20\x09-\x0D"'>#|*,+])"""
#: A key up to its END line, if no -- comes first. Else, as in a text that is cut off, fields of encryption and runs of at
#: least 16 base64 characters, with a shorter run after them; 16 characters are no more than the name of the algorithm.
_KEY = rf"""{_HEADER}(?:(?:[^-]{{1,}}+|-[^-]){{0,}}+-----END [A-Z ]{{0,40}}PRIVATE KEY-----|(?:{_BETWEEN}{{1,}}+(?:Proc-Type|DEK-Info):\x20?[A-Za-z0-9-]{{1,}}+,[A-Za-z0-9]{{1,}}+){{0,}}+(?:{_BETWEEN}{{0,}}+[A-Za-z0-9+/]{{16,}}+={{0,2}}+){{1,}}+(?:{_BETWEEN}{{1,}}+[A-Za-z0-9+/]{{1,15}}+={{0,2}}+)?)?"""
_JWT = Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
MORE_RULES = (Rule("pem", _KEY), _JWT)
#: Rule sets by version. A new version scans every blob again; an old one's findings stay in the ledger. Version 2 has a
#: key's BEGIN line alone.
RULE_SETS = {1: BASE_RULES, 2: (*BASE_RULES, Rule("pem", _HEADER), _JWT), 3: BASE_RULES + MORE_RULES}
VERSION = 3
SPAN = "array<struct<start:int,kind:int,stop:int>>"
LEDGER = f"blob_id binary, rule_version int, spans {SPAN}"
MASK = "[SECRET]"
#: Blobs with findings and their spans go to all executors up to this number of both: some 50 bytes each.
BROADCAST = 200_000


def _spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule in code points: the lengths of the matches and of what lies between them, summed up."""
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    held = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found

    def walk(gaps: Column, whole: Column, part: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            stop = start + F.length(F.get(whole, i))
            span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop")))
            return F.struct(stop.alias("at"), F.when(F.length(F.get(part, i)) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), zero, step, lambda acc: acc["spans"])

    spans = let(F.split(text, rule.pattern, -1), lambda gaps: let(found, lambda whole: let(held, lambda part: walk(gaps, whole, part))))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPAN))


def spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All rules' spans by start, then by the rules' order."""
    return F.sort_array(F.concat(*[_spans_of(text, r, i) for i, r in enumerate(rules)]))


def with_blobs(versions: DataFrame, path_col: str, version_col: str | None, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    version = col(version_col).cast("string") if version_col else F.lit("")
    return versions.select(col(path_col).alias("path"), version.alias("version"), F.unhex(F.sha2(text, 256)).alias("blob_id"), text.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", version_col: str | None = None, text_col: str = "text", rule_version: int = VERSION) -> DataFrame:
    """New ledger rows: blob_id, rule_version, spans; one for each blob that the ledger lacks at this rule version.

    A null text is an empty blob. Null paths, repeated rows and ties are fine: any row of a blob stands for it, chosen by
    an aggregate with partial results, so that a text of many rows is no hot key. A very long text is one value of one row.
    An empty table gives no rows. Columns other than the three named are not read.
    """
    blobs = with_blobs(versions, path_col, version_col, text_col)
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob_id")
        new = staged(blobs.select("blob_id").distinct().join(seen, "blob_id", "left_anti"), "unseen-blobs")
        blobs = blobs.join(F.broadcast(new) if new.count() <= BROADCAST else new, "blob_id", "left_semi")
    unseen = blobs.groupBy("blob_id").agg(F.any_value("text").alias("text"))
    return unseen.select("blob_id", F.lit(rule_version).alias("rule_version"), spans(F.col("text"), RULE_SETS[rule_version]).alias("spans"))


class Ledger:
    """The ledger as a table that grows: every call of `extend` appends what it found in blobs that no earlier one saw.

    Two writers at a time may both append a blob that both found new. Their rows are equal, and `rows` gives one of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def rows(self) -> DataFrame:
        """One row a blob and rule version."""
        return self._files().dropDuplicates(["blob_id", "rule_version"])

    def extend(self, versions: DataFrame, path_col: str = "doc_id", version_col: str | None = None, text_col: str = "text", rule_version: int = VERSION) -> DataFrame:
        """Scans the unseen pairs of blob and rule version among `versions`, appends them, and returns the whole ledger, in which
        a blob of two writers may be twice: scan, locate and redact take it so.

        Nulls, repeats and empty tables are as in `scan`; the first call makes the table, also for no rows.
        """
        known = None
        try:
            known = self._files()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        found = scan(versions, known, path_col, version_col, text_col, rule_version)
        found.write.mode("append").option("compression", "zstd").parquet(self.path)
        return self._files()


def _hits(ledger: DataFrame, rule_version: int) -> tuple[DataFrame, bool]:
    """Blobs with findings (blob_id, spans), each once, and whether they may go to all executors: a checked size."""
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob_id", "spans").dropDuplicates(["blob_id"])
    n, spans_of_all = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    return hits, n + spans_of_all <= BROADCAST


def _located(rows: DataFrame, ledger: DataFrame, rule_version: int, by: Column) -> DataFrame:
    """rows (blob_id, ...) with spans, null where their blob has none."""
    hits, few = _hits(ledger, rule_version)
    return rows.join(F.broadcast(hits), "blob_id", "left") if few else salted(rows, hits, "blob_id", by, "left")


def locate(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", version_col: str | None = None, text_col: str = "text", rule_version: int = VERSION) -> DataFrame:
    """All rows of versions as path, version, blob_id with their blob's spans (none: an empty list).

    Null paths and texts stay, a null text as the empty blob; repeated rows stay; an empty table gives no rows. Blobs of
    all findings go to the executors where they are few by count; else both sides are shuffled by blob and salt. Texts are
    hashed, whatever their length, and not shuffled. Columns other than the three named are not read.
    """
    rows = with_blobs(versions, path_col, version_col, text_col).drop("text")
    by = F.struct("path", "version", F.monotonically_increasing_id())
    return _located(rows, ledger, rule_version, by).select("path", "version", "blob_id", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def describe(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with each span, and each run of overlapping spans, replaced by the mask."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1))))


def redact(docs: DataFrame, text_col: str = "text", path_col: str = "doc_id", rule_version: int = VERSION, ledger: DataFrame | None = None, changed: bool = False) -> DataFrame:
    """docs, same rows and columns whatever their names, with the secrets of every text masked; with `changed`, only rows that have any.

    Null texts stay null, empty ones empty; repeated rows stay, and equal texts are scanned once. A ledger that holds every
    text saves the scan. Texts move only where the texts with secrets are too many to broadcast, dealt by blob and salt. An
    empty table gives no rows.
    """
    ledger = staged(scan(docs, None, path_col, None, text_col, rule_version), "secret-ledger") if ledger is None else ledger
    blob = F.unhex(F.sha2(F.coalesce(col(text_col), F.lit("")), 256))
    (own,) = new_names(docs, "row")
    rows = docs.select(blob.alias("blob_id"), F.struct(*[col(c).alias(c) for c in docs.columns]).alias(own))
    text = F.col(own)[text_col]
    masked = F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans")))
    found = _located(rows, ledger, rule_version, F.monotonically_increasing_id())
    found = found.where("spans IS NOT NULL") if changed else found
    return found.select(*[masked.alias(c) if c == text_col else F.col(own)[c].alias(c) for c in docs.columns])
