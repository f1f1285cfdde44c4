"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds, for each blob and each version
of a rule that was run on it, what was found; a scan reads only pairs that the ledger lacks, and findings are joined
back to all paths and versions with that blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from viaduct.llm.arrow import byte_texts, slices
from viaduct.session import ready, scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` characters are asked of ``group``; ``hint`` (RE2) must occur in a text with any."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    either_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches, without those too short; code points, the end exclusive."""
        found = re.finditer(self.pattern, text, re.ASCII | (re.IGNORECASE if self.either_case else 0))
        return [m.span() for m in found if len(m[self.group]) >= self.least]


# The three base kinds as the contract states them, in its order; then further kinds.
BASE_RULES = (
    Rule(
        "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", group=2, least=8, either_case=True,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", least=16),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{32}", least=32),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", r"gh[opsur]_[A-Za-z0-9]{36}"),
    Rule("signed", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10}"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<rule:string,start:long,end:long>"
LEDGER = f"blob binary, rules array<string>, spans array<{SPAN}>"
_SPANS = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _addressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blob of each version, and its text, compressed, where this task sees the blob first."""
    pack = zstandard.ZstdCompressor(level=1).compress
    seen: set[bytes] = set()
    for batch in slices(batches, "text", 4 << 20):
        texts = byte_texts(batch.column("text"))
        blobs = [hashlib.sha256(t).digest() for t in texts]
        packed: list[bytes | None] = []
        for blob, text in zip(blobs, texts, strict=True):
            packed.append(None if blob in seen else pack(text))
            seen.add(blob)
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(packed, pa.binary())], names=["blob", "packed"])


def _scanner(rules: dict[str, Rule]):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed", 1 << 20):
            texts = [unpack(p) for p in batch.column("packed").to_pylist()]
            todo = batch.column("rules").to_pylist()
            found: list[list[dict]] = [[] for _ in texts]
            column = pa.array(texts, pa.large_binary())
            for name, rule in rules.items():
                hinted = pc.match_substring_regex(column, rule.hint).to_pylist()
                for i, hit in enumerate(hinted):
                    if hit and name in todo[i]:
                        found[i] += [{"rule": name, "start": a, "end": b} for a, b in rule.spans(texts[i].decode("utf-8"))]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, _SPANS)], names=["blob", "rules", "spans"])

    return scan


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; none is an empty one."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it there, and return all ``versions`` with ``spans`` and ``blob``.

    ``versions`` has a column ``text`` and any others (path, version, ...), which are kept; null text counts as empty.
    Only findings of the given rules' versions are returned. An empty table scans nothing.
    """
    spark = ready(versions.sparkSession)
    names = [r.name for r in rules]
    wanted = F.array(*[F.lit(n) for n in names])
    distinct = versions.select("text").mapInArrow(_addressed, "blob binary, packed binary").filter(F.col("packed").isNotNull())
    blobs = distinct.groupBy("blob").agg(F.first("packed").alias("packed"))
    done = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    todo = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    unseen = blobs.join(done, "blob", "left").select("blob", "packed", todo.alias("rules")).filter(F.size("rules") > 0)
    unseen.mapInArrow(_scanner({r.name: r for r in rules}), LEDGER).write.mode("append").parquet(ledger)
    # join back: a blob's findings once, to every version that holds it; blobs without any need no row
    kept = F.filter("spans", lambda s: s["rule"].isin(names))
    found = read_ledger(spark, ledger).select("blob", kept.alias("spans")).filter(F.size("spans") > 0)
    found = found.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    addressed = versions.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    none = F.array().cast(f"array<{SPAN}>")
    return addressed.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def spans_text(spans, rules: tuple[Rule, ...]):
    """Spans of ``rules`` as kind:start:end, by start, then by the order of the rules, joined by commas."""
    order = F.array(*[F.lit(r.name) for r in rules])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    own = F.filter(spans, lambda s: F.array_contains(order, s["rule"]))
    keyed = F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["rule"]).alias("k"), s["end"].alias("end"), s["rule"].alias("rule")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", kinds[s["rule"]], s["start"], s["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``, each document a path with one version, with a ledger that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_versions(docs, scratch(spark, "ledger"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rule = '{r.name}')) as long)").alias(f"n_{r.kind}") for r in BASE_RULES]
    base = F.sha2(spans_text("spans", BASE_RULES), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, spans_text("spans", RULES).alias("spans"))
