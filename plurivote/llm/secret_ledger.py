"""Secrets in every version of every path, each text scanned once: an incremental ledger of blobs.

A version is a path and a text. Its address is the SHA-256 of the text, so copies, renames and unchanged files share
one blob. The ledger is a folder in the shared store with two tables: ``seen`` says which versions of which rules were
held against a blob, ``findings`` has the spans. ``scan`` looks up which pairs of blob and rule version are missing,
reads one text per such blob, and appends what it finds; ``report`` joins the findings back to all paths. A second
scan of the same versions reads no text, a new rule is held against all blobs, and the other rules against none.

Findings are written before ``seen``: a scan that ends in between is done again by the next one, and rows that were
stored twice are read once. Two scans at one time may both do a pair; the result is the same.

Spans are code points, end exclusive. Matches of one rule do not overlap: the leftmost is taken, and one that is too
short is dropped without another try inside it. Spans of rules that are not ``base`` are left out where they touch a
base span. Positions are running sums over the pieces between matches, so a text with very many matches costs as
much as it is long.

Defined cases: a null text is an empty one and has no spans; repeated rows and rows that share a path each get a row;
a null path stays null; an empty table gives an empty result and an empty ledger; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurivote.llm.hot_keys import join_unique
from plurivote.session import MAX_BROADCAST_ROWS, settle, small_side


@dataclass(frozen=True)
class Rule:
    """``group`` of ``pattern`` must have ``least`` characters; the span is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Fixed patterns. A run of hex digits or of a key id is as long as it can be, so the length may stand in the pattern.
BASE = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + _VALUE, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
)
# What the base lacks: keys with a known beginning, key files, signed tokens, logins in addresses, upper-case digests.
MORE = (
    Rule("prefixed", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|npm_|hf_|AIza)[A-Za-z0-9_-]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
    Rule("named", r"([Pp][Ww][Dd]|[Pp]assphrase|[Cc]redentials?|[Pp]rivate_?[Kk]ey|[Aa]ccess_?[Kk]ey|[Aa]uth)" + _VALUE, 2, 8),
    Rule("digest", r"[0-9A-F]{32,}"),
)
RULES = BASE + MORE
FOUND = "blob binary, rule string, start bigint, end bigint"
SEEN = "blob binary, rules array<string>"


def address(text: Column) -> Column:
    """Content address of a text."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def _read(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame | None:
    """A table of the ledger, or None where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(f"{ledger}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def unseen(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``blob`` and the names of the ``rules`` that were not held against it."""
    names = F.array(*[F.lit(r.name) for r in rules]).cast("array<string>")
    blobs = versions.select(address(F.col(text)).alias("blob")).distinct()
    seen = _read(versions.sparkSession, ledger, "seen", SEEN)
    if seen is None:
        return blobs.withColumn("rules", names)
    done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    left = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", left.alias("rules")).where(F.size("rules") > 0)


def _spans(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Spans of the rules in ``rules`` over (blob, text, rules)."""

    def lengths(parts: Column) -> Column:
        return F.transform(parts, lambda x: F.length(x).cast("bigint"))

    def matches(rule: Rule) -> Column:
        pattern, body = F.lit(rule.pattern), F.col("text")
        found = F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.least).alias("least"),
            lengths(F.split(body, rule.pattern, -1)).alias("gap"),
            lengths(F.regexp_extract_all(body, pattern, F.lit(0))).alias("size"),
            lengths(F.regexp_extract_all(body, pattern, F.lit(rule.group))).alias("judged"),
        )
        return F.when(F.array_contains("rules", rule.name) & F.regexp_like(body, pattern), found)

    each = texts.select("blob", F.explode(F.array_compact(F.array(*[matches(r) for r in rules]))).alias("m"))
    rows = each.select("blob", "m.rule", "m.least", F.posexplode(F.arrays_zip("m.size", "m.judged", "m.gap")).alias("nth", "x"))
    # One more piece than matches: the last one has no size. The texts are dealt by blob, and so these windows need no exchange.
    upto = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.where("x.size IS NOT NULL").withColumn("end", F.sum(F.col("x.gap") + F.col("x.size")).over(upto))
    return placed.where("x.judged >= least").select("blob", "rule", (F.col("end") - F.col("x.size")).alias("start"), "end")


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text: str = "text") -> None:
    """Hold every missing rule version against every blob of ``versions`` and store what is found."""
    todo = settle(unseen(versions, ledger, rules, text))
    rows = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One text per blob; copies are combined before the exchange. Few missing blobs are picked out before it.
    if todo.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        rows = rows.join(small_side(todo.select("blob")), "blob", "left_semi")
    texts = rows.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    _spans(texts, rules).write.mode("append").parquet(f"{ledger}/findings")
    todo.write.mode("append").parquet(f"{ledger}/seen")


def _beside_base(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Without added spans that touch a base span; all windows share one order."""
    base = F.col("rule").isin([r.name for r in rules if r.base])
    order = Window.partitionBy("blob").orderBy("start", "end", "rule")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    # A base span after this one starts no earlier; the first one decides.
    next_base = F.first(F.when(base, F.col("start")), ignorenulls=True).over(after)
    last_end = F.max(F.when(base, F.col("end"))).over(upto)
    held = found.withColumns({"last_end": last_end, "next_base": next_base})
    clear = (F.coalesce("last_end", F.lit(0)) <= F.col("start")) & (F.col("next_base").isNull() | (F.col("next_base") >= F.col("end")))
    return held.where(base | clear).select("blob", "rule", "start", "end")


def report(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``path`` and its ``spans`` (kind, start, end, base), by start and order of the rules, for every row of ``versions``."""
    spark = versions.sparkSession
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.base).alias("base")) for r in rules])
    paths = versions.select(F.col(path).alias("path"), address(F.col(text)).alias("blob"))
    found = _read(spark, ledger, "findings", FOUND)
    found = spark.createDataFrame([], FOUND) if found is None else found.where(F.col("rule").isin([r.name for r in rules])).distinct()
    one = F.struct("start", F.element_at(rank, F.col("rule")).alias("rank"), "end")
    per_blob = _beside_base(found, rules).groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    joined = join_unique(paths, per_blob, "blob")
    spans = F.transform(
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")),
        lambda x: F.struct(kinds[x["rank"]]["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), kinds[x["rank"]]["base"].alias("base")),
    )
    return joined.select(F.col("path").alias(path), spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
