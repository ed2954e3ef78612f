"""Secret scan over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. Only pairs of a blob and a rule version
that the ledger has not seen are scanned; findings belong to blobs and are joined back to all paths.
DataFrame functions only.

Defined results: null text is the empty text; equal texts are scanned once, whatever their number (the copy under the
smallest path; rows that repeat that path too are one after the scan); a null path is a path; repeated rows come back
once each; an empty table gives no finding; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table


@dataclass(frozen=True)
class Rule:
    """matches: leftmost, non-overlapping. least: shortest accepted length of the group. needle: a string that every match holds."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    needle: str | None = None


#: Base rules first; a shorter run than the least length cannot hide a longer one in access and hex, so their
#: patterns carry it. The last four are the method's own.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", needle="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needle="-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needle="eyJ"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needle="gh"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needle="xox"),
)
BASE = 3


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def pending(versions: DataFrame, scans: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, path, rules): the blobs with rule versions not seen yet, and one path that has each blob."""
    blobs = versions.groupBy("blob_id").agg(F.min("path").alias("path"))
    named = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    if scans is None:
        return blobs.withColumn("rules", named)
    done = scans.groupBy("blob_id").agg(F.collect_set("rule").alias("done"))
    left = blobs.join(done, "blob_id", "left").withColumn("rules", F.array_except(named, F.coalesce("done", F.array().cast("array<string>"))))
    return left.where(F.size("rules") > 0).drop("done")


def _lengths(text: Column, rule: Rule) -> Column:
    """Per match: code points before it since the last match, its own, and whether it counts. Empty if none."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    good = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least) if rule.least else (lambda m: F.lit(True))
    rows = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("len"), good(m).alias("ok")))
    hit = text.contains(rule.needle) if rule.needle else F.lit(True)
    return F.when(hit & text.rlike(rule.pattern), rows).otherwise(F.lit(None))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """texts (blob_id, text, rules) to findings (blob_id, rule, kind, at, start, end); code points, end exclusive."""
    text, cols = F.col("text"), []
    for i, r in enumerate(rules):
        wanted = F.array_contains("rules", f"{r.kind}@{r.version}")
        cols.append(F.struct(F.lit(i).alias("at"), F.when(wanted, _lengths(text, r)).alias("found")))
    per = texts.select("blob_id", F.filter(F.array(*cols), lambda x: x["found"].isNotNull()).alias("per")).where(F.size("per") > 0)
    # a path may be repeated: one row a blob is enough, and only blobs with matches come this far
    per = per.dropDuplicates(["blob_id"]).select("blob_id", F.explode("per").alias("p"))
    each = per.select("blob_id", "p.at", F.posexplode("p.found").alias("n", "m"))
    w = Window.partitionBy("blob_id", "at").orderBy("n")
    end = F.sum((F.col("m.gap") + F.col("m.len")).cast("bigint")).over(w)
    spans = each.select("blob_id", "at", end.alias("end"), F.col("m.len").alias("len"), F.col("m.ok").alias("ok")).where("ok")
    kinds, versions = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    return spans.select("blob_id", F.element_at(versions, F.col("at") + 1).alias("rule"), F.element_at(kinds, F.col("at") + 1).alias("kind"), "at", (F.col("end") - F.col("len")).alias("start"), "end")


def scan_unseen(docs: DataFrame, path: str, text: str, scans: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, todo, findings) of docs against a ledger's scans (blob_id, rule)."""
    held = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob_id", blob_id(F.col("text")))
    # hashes of all texts are computed once; the table has ids only
    versions = keep(held.select("path", "blob_id"), "versions")
    # Written, so that its rules are data: were they constants, as they are in a first run, the optimizer would move the
    # scan below the join and scan every copy of a blob.
    todo = keep(pending(versions, scans, rules), "todo")
    # The build side holds ids only; texts stream past it without a sort, and only one copy of an unseen blob goes on.
    owners = todo.select(F.col("blob_id").alias("owned"), F.col("path").alias("owner"), "rules").hint("shuffle_hash")
    texts = held.join(owners, (F.col("blob_id") == F.col("owned")) & F.col("path").eqNullSafe(F.col("owner"))).select("blob_id", "text", "rules")
    return versions, todo, scan(texts, rules)


def spans_by_path(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each path's blob: (path, blob_id, found), found an array of (start, at, kind, end) in order."""
    per = findings.groupBy("blob_id").agg(F.array_sort(F.collect_set(F.struct("start", "at", "kind", "end"))).alias("found"))
    return versions.join(per, "blob_id", "left").withColumn("found", F.coalesce("found", F.array().cast(per.schema["found"].dataType)))


class BlobLedger:
    """The ledger as Parquet tables in a shared folder: versions, scans and findings, appended by each run."""

    def __init__(self, spark: SparkSession, root: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def scans(self) -> DataFrame:
        return self._read("scans", "blob_id string, rule string")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob_id string, rule string, kind string, at int, start bigint, end bigint")

    def versions(self) -> DataFrame:
        return self._read("versions", "path string, blob_id string")

    def add(self, docs: DataFrame, path: str, text: str) -> None:
        """Scan what is new and append it; scans are written last, so a run that broke off is done again."""
        versions, todo, found = scan_unseen(docs.withColumn(path, F.col(path).cast("string")), path, text, self.scans(), self.rules)
        found.write.mode("append").parquet(f"{self.root}/findings")
        versions.join(self.versions(), ["path", "blob_id"], "left_anti").distinct().write.mode("append").parquet(f"{self.root}/versions")
        todo.select("blob_id", F.explode("rules").alias("rule")).write.mode("append").parquet(f"{self.root}/scans")

    def report(self) -> DataFrame:
        """(path, blob_id, found) of all versions by the current rule versions; findings of a repeated run count once."""
        now = [f"{r.kind}@{r.version}" for r in self.rules]
        return spans_by_path(self.versions().distinct(), self.findings().where(F.col("rule").isin(now)).distinct())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    versions, _, findings = scan_unseen(docs, "doc_id", "text")
    per = findings.groupBy("blob_id").agg(F.array_sort(F.collect_set(F.struct("start", "at", "kind", "end"))).alias("found"))
    joined = lambda keep: F.array_join(F.transform(F.filter("found", keep), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["at"] == k)).cast("bigint")
    digest = per.select("blob_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(lambda x: x["at"] < BASE), 256).alias("base_sha256"), joined(lambda x: F.lit(True)).alias("spans"))
    # written first: the join that follows has plain exchanges on both sides, so that a blob of very many paths is split
    digest = keep(digest, "digests")
    zero, none = F.lit(0).cast("bigint"), F.sha2(F.lit(""), 256)
    return versions.join(digest, "blob_id", "left").select(F.col("path").alias("doc_id"), *[F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")], F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _oracle() -> str:
    """Spans by DuckDB: split into gaps, extract the matches, running sums of both."""
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        good = f"length(regexp_extract(m, '{pattern}', {r.group})) >= {r.least}" if r.least else "true"
        parts.append(f"""
  SELECT doc_id, {i} AS k, '{r.kind}' AS kind, e - length(m) AS s, e FROM (
    SELECT doc_id, m, {good} AS ok, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM (
      SELECT doc_id, generate_subscripts(ms, 1) AS n, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))) WHERE ok""")
    span = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  coalesce(string_agg({span}, ',' ORDER BY s, k) FILTER (WHERE k < {BASE}), '') AS base, string_agg({span}, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE = _oracle()
