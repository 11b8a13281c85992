"""Secret scans over an incremental blob ledger, with DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import fresh, shared_dir, staged

#: Matches whose starts are added up one by one; the sums of whole steps are added up before.
STEP = 128
MARK = "[SECRET]"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


#: Fixed values of the contract.  In the last two the least length may stand in the pattern: a run of such characters
#: that is too short from its first possible start is too short from every later one.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and deep in lambdas the body names it."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """Sums of ``lengths[0..i]`` for every i: by steps, so that many matches in one text stay cheap."""
    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def inside(steps: Column) -> Column:
        return F.transform(
            lengths,
            lambda _, i: F.element_at(steps, (i / STEP).cast("int") + 1) + total(F.slice(lengths, (i / STEP).cast("int") * STEP + 1, i % STEP + 1)),
        )

    last = ((F.size(lengths) - 1) / STEP).cast("int")
    sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(lengths, b * STEP + 1, F.lit(STEP))))
    return let(sums, lambda s: let(F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))), inside))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points.  What stands between matches (``split``) and the matches themselves add up to starts."""
    def every(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))

    def located(whole: Column) -> Column:
        between = F.split(text, rule.pattern, -1)
        lengths = let(between, lambda s: F.transform(whole, lambda _, i: F.length(F.element_at(s, i + 1)) + F.when(i > 0, F.length(F.element_at(whole, i))).otherwise(0)))
        starts = let(lengths, _running)
        spans = let(starts, lambda at: F.transform(whole, lambda w, i: F.struct(
            F.element_at(at, i + 1).cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (F.element_at(at, i + 1) + F.length(w)).cast("int").alias("end"))))
        if not rule.group:
            return F.filter(spans, lambda s: s["end"] - s["start"] >= rule.least)
        return let(every(rule.group), lambda v: let(spans, lambda ss: F.filter(ss, lambda _, i: F.length(F.element_at(v, i + 1)) >= rule.least)))

    none = F.array().cast(SPANS)
    return let(every(0), lambda whole: F.when(F.size(whole) > 0, located(whole)).otherwise(none)).cast(SPANS)


def _read(spark, ledger: str) -> DataFrame:
    schema = f"blob string, rule string, spans {SPANS}"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # no ledger yet


def scan(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with all historical ``versions`` (path, text); give (blob, spans) of the blobs now present.

    A blob is the SHA-256 of a text, whatever paths and versions hold it.  Of the pairs (blob, rule version) only those
    are scanned that the ledger lacks, each once, on one row of the blob; the result is appended to the ledger, an
    empty list too.  Equal rows are reduced to one before the shuffle; a text is moved once at most, and copies are dealt by
    path as well, so a blob with a third of all rows is no hot key.  A run that fails appends nothing.  Two runs that
    meet may both store a pair: it is read once.
    """
    spark = versions.sparkSession
    place = F.coalesce(F.concat(F.lit("="), F.col(path).cast("string")), F.lit("")).alias("place")
    rows = versions.select(place, F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = rows.select("place", "text", F.sha2(F.col("text").cast("binary"), 256).alias("blob"))
    names = [r.version for r in rules]
    blobs = staged(hashed.groupBy("blob").agg(F.min("place").alias("place")), "secret-blobs")
    wanted = blobs.select("blob", "place", F.explode(F.array(*map(F.lit, names))).alias("rule"))
    missing = wanted.join(_read(spark, ledger), ["blob", "rule"], "left_anti").groupBy("blob", "place").agg(F.collect_set("rule").alias("rules"))
    once = hashed.groupBy("blob", "place").agg(F.first("text").alias("text"))
    todo = once.join(missing, ["blob", "place"]).select("blob", "text", "rules")
    found = todo.select("blob", F.explode(F.filter(F.array(*[
        F.struct(F.lit(r.version).alias("rule"), F.when(F.array_contains("rules", r.version), spans_of(F.col("text"), r, k)).alias("spans")) for k, r in enumerate(rules)
    ]), lambda x: x["spans"].isNotNull())).alias("x")).select("blob", "x.rule", "x.spans")
    found.write.mode("append").parquet(ledger)
    own = _read(spark, ledger).where(F.col("rule").isin(names)).join(blobs, "blob", "left_semi")
    pairs = F.collect_set(F.struct("rule", "spans"))  # equal pairs have equal spans
    return own.groupBy("blob").agg(F.array_sort(F.flatten(F.transform(pairs, lambda p: p["spans"]))).alias("spans"))


def findings(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(path, blob, spans) for every row of ``versions``: the ledger's findings joined back to all paths.

    Spans are (start, rank, kind, end) by start, then by rule; code points, end exclusive.  Null and empty texts are the blob
    of the empty text, without spans.  Null and repeated paths are rows like others; an empty table gives an empty result;
    other columns are not read.  Without ``ledger`` a new one in the shared folder is used.
    """
    ledger = ledger or shared_dir(versions.sparkSession, "secret-ledger")
    spans = scan(versions, ledger, path, text, rules)
    paths = versions.select(F.col(path), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob"))
    return paths.join(spans, "blob").select(path, "blob", "spans")


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).otherwise(a["parts"]).alias("parts"),
    )
    done = let(F.aggregate(spans, start, step), lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", count: str | None = "n_chars", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; a text without any, null too, stays as it is.  ``count``: its length column."""
    ledger = ledger or shared_dir(docs.sparkSession, "secret-ledger")
    own_blob, own_spans, new_text = fresh(docs, "blob", "spans", "new")
    spans = scan(docs, ledger, path, text, rules).where(F.size("spans") > 0).select(F.col("blob").alias(own_blob), F.col("spans").alias(own_spans))
    same = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256) == F.col(own_blob)
    joined = docs.join(spans, same, "left").withColumn(new_text, F.when(F.col(own_spans).isNotNull(), redacted(F.col(text), F.col(own_spans))))
    new = {text: F.col(new_text), count: F.length(new_text)}
    return joined.select(*[F.when(F.col(new_text).isNull(), F.col(f"`{c}`")).otherwise(new[c].cast(kind)).alias(c) if c in new else F.col(f"`{c}`") for c, kind in docs.dtypes])


def report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Per document: doc_id, blob, n_assign, n_access, n_hex, base_sha256 and spans."""
    spans = F.col("spans")
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(spans, lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in RULES]
    found = findings(docs, ledger)
    return found.select("doc_id", "blob", *count, joined.alias("spans")).withColumn("base_sha256", F.sha2(F.col("spans").cast("binary"), 256))


def _sql(rank: int, rule: Rule) -> str:
    letters = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    pattern = rule.pattern.replace("(?i)(password|passwd|secret|token|api_?key)", letters).replace("'", "''")
    return (
        f"SELECT doc_id, t, {rank} AS rank, '{rule.kind}' AS kind, regexp_extract_all(t, '{pattern}', 0) AS w,"
        f" regexp_extract_all(t, '{pattern}', {rule.group}) AS v, string_split_regex(t, '{pattern}') AS s, {rule.least} AS least FROM d"
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql(k, r) for k, r in enumerate(RULES))}),
n AS (SELECT doc_id, rank, kind, w, v, s, least, unnest(range(len(w))) AS i FROM m WHERE len(w) > 0),
p AS (SELECT doc_id, rank, kind, length(w[i + 1]) AS width, length(v[i + 1]) >= least AS ok,
             (list_sum(list_transform(s[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i], lambda x: length(x))), 0))::BIGINT AS start FROM n),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || (start + width), ',' ORDER BY start, rank) AS spans FROM p WHERE ok GROUP BY doc_id)
SELECT d.doc_id, sha256(t) AS blob, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
