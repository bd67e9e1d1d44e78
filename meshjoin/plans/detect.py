"""The detection query: elements and rules in, clashes and statistics out."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from types import SimpleNamespace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.broadphase import RULE_COLUMNS, blocked_column, broad_phase, document_pairs, same_set, scope, thin
from ..operators.lineage import cut
from ..operators.narrow import result_rows, tested
from ..operators.packs import counted_in_packs, tested_in_packs, with_own_rules, with_rules
from ..schema import CLASH, DEPTH_SEMANTICS, Rules
from ..sources.payload import explode_elements, parse_elements, payload_frame, payload_rules
from ..sources.sinks import clash_dicts


def candidates_of(elements: DataFrame, rules: Rules, method: str = "auto") -> DataFrame:
    """Candidate pairs under the rules' scopes, gap and exclusions. Equal scopes are one set; others are compared by their keys."""
    boxes = cut(thin(elements))
    a, b = scope(boxes, rules.model_a), scope(boxes, rules.model_b)
    same = rules.model_a == rules.model_b or same_set(a, b)
    return broad_phase(a, b, rules.gap_m, rules, same, method)


def clashes_of(candidates: DataFrame, elements: DataFrame, rules: Rules | None = None, with_point: bool = True, vertex_only: bool = False, exact: bool = False) -> DataFrame:
    """Clashes by pair: gi_a, gi_b and the result columns. A pair with a hard clash isn't tested for clearance.

    Without rules the candidates' own columns hard and gap say what each pair is tested for.
    """
    hard, gap = (F.col("hard"), F.col("gap")) if rules is None else (rules.hard, rules.gap_m if rules.soft else None)
    return result_rows(tested(candidates, elements, hard, gap, with_point, 1 if vertex_only else 4 if exact else 3))


def found_in(elements: DataFrame, rules: Rules, with_point: bool = True, vertex_only: bool = False, exact: bool = False, with_ids: bool = False, within: float | None = None) -> DataFrame:
    """The clashes of elements (see narrow.tested; without with_point, clearances have no point either), without their candidate pairs: small meshes meet in
    packs, which move no pairs, and only where some mesh is too large for that pairs are made first. with_ids: also element_id and model_id of both.
    within: of the rules' candidates all distances up to this (metres), and no test for intersection."""
    stages = 1 if vertex_only else 4 if exact else 3
    hard, gap = (rules.hard, rules.gap_m if rules.soft else None) if within is None else (False, within)
    found = tested_in_packs(with_rules(elements, rules).withColumns({"hard": F.lit(hard), "gap": F.lit(gap).cast("double")}), with_point, stages, with_ids)
    if found is None:
        found = tested(candidates_of(elements, rules), elements, hard, gap, with_point, stages)
        found = _with_ids(found, elements) if with_ids else found
    return found


def counts_in(elements: DataFrame, rules: Rules) -> DataFrame:
    """One row: the numbers of candidate pairs and clashes. Small meshes are counted in packs, where no pair becomes a row."""
    counted = counted_in_packs(with_rules(elements, rules)) if rules.hard or rules.soft else None
    if counted is None:
        candidates = candidates_of(elements, rules)
        counted = candidates.agg(F.count("*").alias("candidate_pairs")).crossJoin(found_in(elements, rules, with_point=False).agg(F.count("*").alias("clash_count")))
    return counted


def _with_ids(found: DataFrame, elements: DataFrame) -> DataFrame:
    for s in "ab":
        found = found.join(elements.select(F.col("gi").alias(f"gi_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("element_id", "model_id")]), f"gi_{s}")
    return found


def named(found: DataFrame, stable_ids: bool = False) -> DataFrame:
    """Clashes with element_id and model_id of both elements (see found_in) as result rows in wire names, with an id as with_identity gives it."""
    who = [F.col(f"{c}_{s}").alias(n) for s in "ab" for c, n in (("element_id", f"element{s.upper()}"), ("model_id", f"model{s.upper()}Id"))]
    document = ["document"] if "document" in found.columns else []
    rows = result_rows(found, [*map(F.col, document), *who]).select(*document, *CLASH.names)
    return rows.select(_id(stable_ids), *rows.columns)


def _id(stable: bool) -> Column:
    key = F.sha2(F.concat_ws("\x1f", "modelAId", "elementA", "modelBId", "elementB", "type", F.col("distance").cast("string")), 256) if stable else F.uuid()
    return F.upper(F.substring(key, 1, 8)).alias("id")


def with_identity(clashes: DataFrame, elements: DataFrame, stable_ids: bool = False) -> DataFrame:
    """Result rows in wire names, with an id: eight random hex digits, or digits of a hash of the row's identity."""
    who = lambda s: elements.select(F.col("gi").alias(f"gi_{s}"), F.col("element_id").alias(f"element{s.upper()}"), F.col("model_id").alias(f"model{s.upper()}Id"))
    document = ["document"] if "document" in elements.columns else []
    rows = clashes.join(who("a").join(elements.select(F.col("gi").alias("gi_a"), *document), "gi_a") if document else who("a"), "gi_a")
    rows = rows.join(who("b"), "gi_b").select(*document, *CLASH.names)
    return rows.select(_id(stable_ids), *rows.columns)


@dataclass
class Detection:
    """A detection whose plans are built; `clashes` is lazy, `stats` and `response` run it."""

    elements: DataFrame
    candidates: DataFrame
    clashes: DataFrame
    rules: Rules
    began: float
    spark: SparkSession
    on_phase: Callable[[str], None] | None = None
    on_progress: Callable[[int, int], None] | None = None
    on_complete: Callable[[dict], None] | None = None

    def _count_clashes(self, pairs: int) -> int:
        """Counts the clashes; meanwhile on_progress gets (pairs done, pairs), by the share of the running stages' tasks that have ended."""
        if not self.on_progress:
            return self.clashes.count()
        context, group, found = self.spark.sparkContext, f"narrow-{uuid.uuid4().hex}", {}

        def run():
            context.setJobGroup(group, "narrow phase")
            try:
                found["count"] = self.clashes.count()
            except Exception as e:  # noqa: BLE001  handed on below
                found["error"] = e

        work, told, ended = threading.Thread(target=run), 0, {}
        work.start()
        while work.is_alive():
            work.join(PROGRESS_SECONDS)
            tracker = context.statusTracker()
            for job in tracker.getJobIdsForGroup(group):
                for stage in (tracker.getJobInfo(job) or _NO_JOB).stageIds:
                    if info := tracker.getStageInfo(stage):
                        ended[stage] = (info.numCompletedTasks, info.numTasks)
            tasks = sum(n for _, n in ended.values())
            # later stages may be unknown yet, so the end is told only when it is reached
            done = min(pairs - 1, pairs * sum(k for k, _ in ended.values()) // max(tasks, 1))
            if done > told:
                told = done
                self.on_progress(told, pairs)
        if "error" in found:
            raise found["error"]
        self.on_progress(pairs, pairs)
        return found["count"]

    @cached_property
    def stats(self) -> dict:
        """Counts, duration, and what ran."""
        counts = {"elementCount": self.elements.count(), "candidatePairs": self.candidates.count()}
        if counts["candidatePairs"] and self.on_phase:
            self.on_phase("Narrow phase")
        counts["clashCount"] = self._count_clashes(counts["candidatePairs"]) if counts["candidatePairs"] else 0
        if counts["candidatePairs"] and self.on_phase:
            self.on_phase("Finalising")
        stats = counts | {
            "duration_ms": round((time.time() - self.began) * 1000), "threads": self.spark.sparkContext.defaultParallelism, "backends": ["spark"], "depth_semantics": DEPTH_SEMANTICS,
        }
        if self.on_complete:
            self.on_complete(stats)
        return stats

    def response(self) -> dict:
        """The wire form: clashes as dicts, and stats. Collects the clashes."""
        stats = self.stats
        return {"clashes": clash_dicts(self.clashes) if stats["clashCount"] else [], "stats": stats}

    def unpersist(self) -> None:
        for df in (self.elements, self.candidates, self.clashes):
            df.unpersist()


def detect(spark: SparkSession, source: dict | str | DataFrame, rules: Rules | dict | None = None, on_progress=None, on_phase=None, strict: bool = True, method: str = "auto", stable_ids: bool = False, on_complete=None) -> Detection:
    """Detects clashes in a payload (dict or JSON text), or in a frame of parsed elements with separate rules.

    on_phase gets "Building BVH" (indexing; the name is part of the protocol), "Narrow phase" and "Finalising", on_progress (done, total) as tasks end
    (see percent), on_complete the statistics.
    strict: faulty elements fail the query; otherwise they are left out.
    """
    began = time.time()
    if isinstance(source, DataFrame):
        elements = source
    else:
        payloads = payload_frame(spark, source)
        rules = rules or payload_rules(payloads)
        elements = parse_elements(explode_elements(payloads), strict)
    rules = rules if isinstance(rules, Rules) else Rules.of(rules)
    elements = elements.persist(StorageLevel.MEMORY_AND_DISK)
    candidates = candidates_of(elements, rules, method).persist(StorageLevel.MEMORY_AND_DISK)
    if on_phase and not candidates.isEmpty():
        on_phase("Building BVH")
    clashes = with_identity(clashes_of(candidates, elements, rules), elements, stable_ids).persist(StorageLevel.MEMORY_AND_DISK)
    return Detection(elements, candidates, clashes, rules, began, spark, on_phase, on_progress, on_complete)


def percent(done: int, total: int) -> int:
    """Progress as a whole percentage; 0 for nothing to do."""
    return round(100 * done / total) if total else 0


def rules_table(payloads: DataFrame) -> DataFrame:
    """The rules of payloads as columns (RULE_COLUMNS), a row for each document; absent and null entries take their defaults."""
    rule = lambda name, default: F.coalesce(F.col(f"rules.{name}"), F.lit(default))
    mode, gap = rule("mode", "hard"), rule("maxGap", 0.0)
    soft = mode.isin("soft", "both")
    values = [
        rule("modelA", "all"), rule("modelB", "all"), F.when(soft, gap / 1000.0).otherwise(0.0), mode != "soft", soft & (gap > 0), rule("excludeSelf", False),
        blocked_column(F.col("rules.excludeTypePairs")),
    ]
    return payloads.select("document", *[v.alias(n) for v, n in zip(values, RULE_COLUMNS)])


def detect_documents(payloads: DataFrame, strict: bool = True, method: str = "auto", stable_ids: bool = True, with_point: bool = True) -> DataFrame:
    """Clashes of several payloads (document, elements, rules), each under its own rules: document, id and the result columns.

    Rules are data: a table with a row for each document that is joined to its elements, so scopes, gaps, exclusions and modes are columns of one
    plan, whose jobs don't depend on the number of documents or of different rules. Elements pair within their document only; whether its two
    scopes are one set is decided by document. Absent rules take the defaults; payloads without elements give no rows. Document keys that are
    null or repeated fail the query. method: auto takes small meshes in packs (see found_in); any other one makes candidate pairs first.
    """
    elements = cut(parse_elements(explode_elements(payloads), strict))  # parsed once for all steps
    if method == "auto":
        found = tested_in_packs(with_own_rules(elements, rules_table(payloads)), with_point, with_ids=True)
        if found is not None:
            return named(found, stable_ids)
    candidates = document_pairs(elements.join(rules_table(payloads), "document"), method)
    return with_identity(clashes_of(candidates, elements, with_point=with_point), elements, stable_ids)


#: Seconds between looks at the running tasks.
PROGRESS_SECONDS = 0.2
VERSION = "0.2.0"
_NO_JOB = SimpleNamespace(stageIds=())

#: The advertised protocol.
CAPABILITIES = {
    "protocolVersion": 1, "modelScope": "exact", "overlapVolume": False,
    "rules": {
        "mode": True, "maxGap": True, "minGap": False, "excludeSelf": True, "excludeTypePairs": True, "excludeTypes": False, "includeSpaces": False, "toleranceByTypePair": False,
        "minOverlapVolM3": False, "duplicates": False, "useSemanticFilter": False, "excludeSameDiscipline": False, "disciplineMatrix": False, "changeAware": False,
    },
}


def capabilities(spark: SparkSession) -> DataFrame:
    """One row: protocol version, model scope, overlap volume, and the rules that are honoured. minGap is accepted without effect, so it is false."""
    rules = F.struct(*[F.lit(v).alias(k) for k, v in CAPABILITIES["rules"].items()])
    return spark.range(1).select(*[F.lit(CAPABILITIES[k]).alias(k) for k in ("protocolVersion", "modelScope", "overlapVolume")], rules.alias("rules"))


def status(spark: SparkSession) -> dict:
    """The status record: what runs here, and the advertised protocol."""
    return {"status": "ready", "version": VERSION, "cores": spark.sparkContext.defaultParallelism, "backends": ["spark"], "protocolVersion": CAPABILITIES["protocolVersion"], "capabilities": {k: CAPABILITIES[k] for k in ("modelScope", "overlapVolume", "rules")}}
