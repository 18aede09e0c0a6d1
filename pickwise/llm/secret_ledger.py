"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a table of scanned (blob, rule version)
pairs, kept as one row per blob and run. A scan reads the ledger, scans only pairs it does not hold yet, each blob once whatever the number of its copies, appends them as
a new run folder, and joins the findings of all wanted pairs back to every path. A changed rule gets a new version and is scanned anew;
results of the other rules are reused.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.llm.common import fresh
from pickwise.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values of the base rules
BASE = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
# added by the method: key blocks and signed web tokens
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
RULES = BASE + ADDED
# for masking, a key block is whole: from its BEGIN line through its END line, or to the end of the text if that is missing
MASKED = BASE + (Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", 0, 1), *ADDED[1:])
LEDGER = "sha binary, rules array<string>, found array<struct<rule:string,start:int,end:int>>"
_LEDGER_ARROW = pa.schema([
    ("sha", pa.binary()), ("rules", pa.list_(pa.string())),
    ("found", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
])


def find(rule: re.Pattern, group: int, least: int, text: str) -> list[tuple[int, int]]:
    """Spans in code points, end exclusive."""
    return [m.span() for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {r.key: (re.compile(r.pattern, re.A), r.group, r.least) for r in rules}
        for batch in batches:
            found = []
            for text, todo in zip(batch["text"], batch["todo"].to_pylist()):
                text = text.as_py()
                found.append([{"rule": k, "start": a, "end": b} for k in todo for a, b in find(*known[k], text)])
            yield pa.RecordBatch.from_arrays([batch["sha"], batch["todo"], pa.array(found, _LEDGER_ARROW.field("found").type)], schema=_LEDGER_ARROW)

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """All finished runs, or None before the first; a run folder without _SUCCESS (a crashed run) is not read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    runs = [str(s.getPath()) for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema(LEDGER).parquet(*runs) if runs else None


def blob(text):
    """Content address of a text column; NULL counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, version, sha, findings array of (start, end, kind)) for every row of ``versions`` (path, version, text).

    NULL text counts as empty. Rows repeat as often as in the input, other columns are ignored, NULL paths and versions are kept.
    Findings are sorted by start, then by the rules' order; no findings give an empty array. ``ledger`` is a folder all executors
    reach; every run has its own folder, and the result covers exactly the given rule versions.
    """
    # ids and addresses only: what is joined to paths at the end, and what picks one row for each unseen blob
    keys = cut_lineage(versions.select("path", "version", blob(F.col("text")).alias("sha")))
    _extend(versions, keys, ledger, rules)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return keys.join(findings(versions.sparkSession, ledger, rules), "sha", "left").select(
        "path", "version", F.lower(F.hex("sha")).alias("sha"), F.coalesce("findings", none).alias("findings")
    )


def _extend(versions: DataFrame, keys: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> None:
    """Scans the pairs of blobs and rule versions that the ledger does not hold, and appends them as a run."""
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = keys.groupBy("sha").agg(F.min(F.struct("path", "version")).alias("at"))
    have = read_ledger(spark, ledger)
    if have is not None:
        done = have.select("sha", F.explode("rules").alias("rule")).groupBy("sha").agg(F.collect_set("rule").alias("done"))  # rule versions only
        blobs = blobs.join(done, "sha", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
    else:
        blobs = blobs.withColumn("todo", wanted)
    unseen = blobs.filter(F.size("todo") > 0).select("sha", "at.path", "at.version", "todo")
    texts = versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text"))
    same = (F.col("t.path").eqNullSafe(F.col("u.path"))) & (F.col("t.version").eqNullSafe(F.col("u.version"))) & (blob(F.col("t.text")) == F.col("u.sha"))
    # the addresses are the hash join's build side; texts stream past it, unsorted
    todo = texts.alias("t").join(unseen.alias("u").hint("shuffle_hash"), same).select("u.sha", "t.text", "u.todo")
    found = todo.mapInArrow(_scan(rules), LEDGER).dropDuplicates(["sha"])
    # two scans at once keep apart; what both found is the same
    found.write.parquet(f"{ledger}/run-{uuid.uuid4().hex}")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, findings) of the ledger's blobs that have any under the given rule versions."""
    rank = F.create_map(*[v for i, r in enumerate(rules) for v in (F.lit(r.key), F.lit(i))])
    every = read_ledger(spark, ledger).filter(F.size("found") > 0).select("sha", F.explode("found").alias("s"))
    spans = every.filter(F.col("s.rule").isin([r.key for r in rules])).select(
        "sha", "s.start", "s.end", rank[F.col("s.rule")].alias("rank"), F.split_part("s.rule", F.lit("@"), F.lit(1)).alias("kind")
    )
    by_blob = spans.groupBy("sha").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "end", "kind"))).alias("f"))
    return by_blob.select("sha", F.transform("f", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("findings"))


def redacted(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = MASKED) -> DataFrame:
    """``docs`` with every finding in its text masked; rows without findings, NULL texts among them, stay as they are."""
    versions = docs.select(F.col(id_col).alias("path"), F.lit(0).alias("version"), F.col(text_col).alias("text"))
    keys = cut_lineage(versions.select("path", "version", blob(F.col("text")).alias("sha")))
    _extend(versions, keys, ledger, rules)
    sha, spans = fresh(docs, "_sha"), fresh(docs, "_findings")
    masked = findings(docs.sparkSession, ledger, rules).select(F.col("sha").alias(sha), F.col("findings").alias(spans))
    joined = docs.join(masked.hint("shuffle_hash"), blob(docs[text_col]) == F.col(sha), "left")
    clean = F.when(F.col(spans).isNull(), docs[text_col]).otherwise(redact(docs[text_col], F.col(spans)))
    return joined.select(*[clean.alias(c) if c == text_col else docs[c] for c in docs.columns])


def joined(findings, kinds: tuple[str, ...] | None = None):
    """kind:start:end of each finding, comma-joined."""
    if kinds is not None:
        findings = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redact(text, findings, mask: str = "[SECRET]"):
    """The text with every finding replaced by ``mask``; overlapping findings are replaced once. A column expression."""
    step = F.aggregate(
        findings,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(findings) == 0, text).otherwise(step)
