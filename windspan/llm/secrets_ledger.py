"""Secret scans with a ledger of texts that were scanned before.

Every version of a document is addressed by the SHA-256 of its text, its blob. The ledger holds, for
each blob, the rule versions it was scanned with and what they found. A scan looks up the blobs of a
table, scans each blob once with those rule versions that it has not met, appends that to the ledger,
and joins all findings back to every row that has the blob. A second scan of the same rows reads no
text for rules; a new rule, or a new version of one, scans known blobs with that rule only.

The ledger is one Parquet table that is only appended to: a run that fails leaves nothing behind that
later runs take for scanned. Two runs at once may both scan a blob; readers take each finding once.

Copies are combined before texts are shuffled, so a large group of copies moves one text for each task
that reads some. A blob with over a thousandth of all rows is joined back in parts.

Defined results
    null text        an empty text, without findings
    null id          a row like any other
    repeated rows    one row each
    ties             spans of one start stand in the order of `rules`
    very long texts  scanned whole; findings of one text are one array
    empty table      no rows
    other columns    not read; names of helper columns cannot clash with them
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from windspan.session import written


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and without overlap, whose `group` has `least` characters."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule(
        "assign",
        1,
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
        r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""",
        12,
        1,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18),
    # A run of fewer characters fails as a whole, so runs of the least length are all there is.
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),
)
#: Further kinds: headers of private keys, and signed web tokens of three dotted parts.
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1),
)
SPAN = "struct<rule: string, start: bigint, end: bigint>"
LEDGER = f"blob string, rules array<string>, findings array<{SPAN}>"
BROADCAST_BLOBS = 100_000  # unseen blobs of 64 bytes
HOT = 1000  # a blob with more than a thousandth of all rows is hot: fewer than 1,000 are
SALTS = 64


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """(blob, rules, findings), one row for each run that scanned the blob; empty at first."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _pieces(text: Column, rule: Rule) -> Column:
    """For each match (before, whole, tested): the lengths of the text since the match before it,
    of the match, and of its tested group."""

    def lengths(parts: Column) -> Column:
        return F.transform(parts, F.length)

    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("before"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("whole"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("tested"),
    )
    return F.when(text.rlike(rule.pattern), zipped)


def found_spans(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rule, start, end) of blobs (blob, text, todo), by the rules that `todo` names.

    The text between two matches and the matches themselves add up to each match's start.
    """
    scanned = F.array(
        *[
            F.when(
                F.array_contains("todo", r.name),
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.least).alias("least"),
                    _pieces(F.col("text"), r).alias("pieces"),
                ),
            )
            for r in rules
        ]
    )
    matches = (
        blobs.select("blob", F.explode(scanned).alias("scan"))
        .select("blob", "scan.rule", "scan.least", F.posexplode("scan.pieces").alias("at", "piece"))
        .select("blob", "rule", "least", "at", "piece.*")
        .filter("whole is not null")  # what stands behind the last match
    )
    so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        matches.withColumn("end", F.sum(F.col("before") + F.col("whole")).over(so_far))
        .filter("tested >= least")
        .select("blob", "rule", (F.col("end") - F.col("whole")).alias("start"), "end")
    )


def _todo(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, todo): blobs of `versions` with the names of the rules they have not met."""
    known = ledger.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen")
    )
    names = F.array(*[F.lit(r.name) for r in rules])
    todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    return (
        versions.select("blob")
        .distinct()
        .join(known, "blob", "left")
        .select("blob", todo.alias("todo"))
        .filter(F.size("todo") > 0)
    )


def update_ledger(
    docs: DataFrame, versions: DataFrame, path: str, rules: Sequence[Rule], text: str = "text"
) -> int:
    """Scan the blobs of `docs` that the ledger lacks, append them, and say how many they were."""
    todo = written(_todo(versions, read_ledger(docs.sparkSession, path), rules), "ledger-todo")
    unseen = todo.count()
    if unseen == 0:
        return 0
    texts = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), _blob(F.col(text)).alias("blob")
    )
    if unseen <= BROADCAST_BLOBS:  # an increment: other rows' texts go no further than their scan
        texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    once = texts.dropDuplicates(["blob"]).join(todo, "blob")
    spans = found_spans(once, rules)
    by_blob = spans.groupBy("blob").agg(
        F.collect_list(F.struct("rule", "start", "end").cast(SPAN)).alias("findings")
    )
    entries = todo.join(by_blob, "blob", "left").select(
        "blob",
        F.col("todo").alias("rules"),
        F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings"),
    )
    entries.write.mode("append").parquet(path)
    return unseen


def _listed(spans: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:end by start, then by the order of `rules`, comma-joined."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    ordered = F.array_sort(
        F.transform(
            F.filter(spans, lambda s: s["rule"].isin(*[r.name for r in rules])),
            lambda s: F.struct(
                s["start"].alias("start"),
                place[s["rule"]].alias("place"),
                s["end"].alias("end"),
                F.substring_index(s["rule"], "@", 1).alias("kind"),
            ),
        )
    )
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _counted(spans: Column, rule: Rule) -> Column:
    return F.size(F.filter(spans, lambda s: s["rule"] == rule.name)).cast("bigint")


def _joined_back(versions: DataFrame, found: DataFrame) -> DataFrame:
    """`versions` with the `findings` of their blobs; hot blobs in SALTS parts."""
    many = versions.count() // HOT
    hot = versions.groupBy("blob").agg(F.count("*").alias("n")).filter(F.col("n") > many)
    hot = hot.filter("n > 1").select(F.col("blob").alias("h"))
    marked = versions.join(F.broadcast(hot), F.col("blob") == F.col("h"), "left")
    # Any spread will do, as every part of a hot blob holds the same findings.
    spread = F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int")
    salt = F.when(F.col("h").isNotNull(), spread).otherwise(0)
    parts = F.when(F.col("h").isNotNull(), F.lit(SALTS - 1)).otherwise(0)
    repeated = (
        found.join(F.broadcast(hot), F.col("blob") == F.col("h"), "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), parts)))
        .select(F.col("blob").alias("b"), F.col("salt").alias("s"), "findings")
    )
    return marked.withColumn("salt", salt).join(
        repeated, (F.col("blob") == F.col("b")) & (F.col("salt") == F.col("s")), "left"
    )


def scan(
    docs: DataFrame,
    ledger: str,
    rules: Sequence[Rule] = RULES,
    base: Sequence[Rule] = BASE,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each row of `docs`: its id, n_{kind} of each rule of `base`, base_sha256 of their
    spans, and the spans of all `rules`. Blobs and rules that the table at `ledger` lacks are
    scanned and added to it."""
    if len({r.name for r in rules}) < len(rules) or any("@" in r.kind for r in rules):
        raise ValueError("rules differ in kind or version, and kinds hold no @")
    versions = written(
        docs.select(
            F.col(id).alias("id"),
            _blob(F.col(text)).alias("blob"),
            F.spark_partition_id().alias("place"),
        ),
        "ledger-versions",
    )
    update_ledger(docs, versions, ledger, rules, text)
    mine = F.filter("f", lambda s: s["rule"].isin(*[r.name for r in rules]))
    found = (
        read_ledger(docs.sparkSession, ledger)
        .filter(F.size("findings") > 0)
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("f"))
        .select("blob", mine.alias("findings"))
        .filter(F.size("findings") > 0)
    )
    spans = F.coalesce("findings", F.array().cast(f"array<{SPAN}>"))
    return _joined_back(versions, found).select(
        F.col("id").alias(id),
        *[_counted(spans, r).alias(f"n_{r.kind}") for r in base],
        F.sha2(_listed(spans, base), 256).alias("base_sha256"),
        _listed(spans, rules).alias("spans"),
    )
