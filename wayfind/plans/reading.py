"""The reading plan: which paths to read first, each with its evidence.

Branches of evidence give rows of (purpose, path); they are united and aggregated, and the
few best of each purpose and root are chosen one after another on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import paths as P
from wayfind.operators.landmarks import deepest_root
from wayfind.schemas import CONFIDENCES, EVIDENCE_KINDS, PURPOSES
from wayfind.storage import materialize, release

MAX_PLAN, MIN_PLAN = 10, 5
START_KINDS = ("agent_instructions", "contributor_instructions", "readme", "manifest")
RUNTIME_KINDS = ("build_entry_point", "task_entry_point")
CONTEXT_KINDS = ("lockfile", "ci", "ownership", "license")

# Entry points below a project root, by purpose, and their score.
ENTRY_SCORE = 2_800_000_000
LIBRARY_ENTRIES = ("src/lib.rs", "lib.rs", "src/lib.ts", "src/lib.js")
MAIN_ENTRIES = (
    "src/main.rs", "main.rs", "src/main.py", "main.py", "src/main.rb", "main.rb", "src/main.ts", "main.ts", "src/main.js", "main.js", "src/index.ts",
    "index.ts", "src/index.js", "index.js", "src/index.tsx", "index.tsx", "src/index.jsx", "index.jsx",
)


def _row(purpose: Column, score: Column, confidence: Column | str, kinds: list[str] | Column, reason: Column, root: Column, limitations: Column | None = None) -> list[Column]:
    if isinstance(kinds, list):
        kinds = F.array(*map(F.lit, kinds))
    return [
        purpose.alias("purpose"), F.col("path"), root.alias("project_root"), kinds.alias("evidence_kinds"), reason.alias("reason"),
        (limitations if limitations is not None else F.array().cast("array<string>")).alias("limitations"), score.cast("long").alias("score"),
        (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"),
    ]


def candidate_rows(
    files: DataFrame, ranking: DataFrame, links: DataFrame, landmarks: DataFrame, roots: DataFrame, omitted: DataFrame, churn: DataFrame, bugs: DataFrame, fires: DataFrame
) -> DataFrame:
    """All contributions, before they are summed.

    files (path, limitations), ranking (path, score, focus_matches), links (path, links),
    landmarks and roots as their operators give them, omitted (path), and three of (path,
    commits).
    """
    src = deepest_root(files.select("path", "limitations"), roots).join(ranking.select("path", F.col("score").alias("rank"), "focus_matches"), "path", "left")
    src = src.join(links.select("path", "links"), "path", "left").na.fill({"rank": 0, "focus_matches": 0, "links": 0})
    root, limits = F.col("project_root"), F.col("limitations")
    linked = F.col("links") > 0
    kinds = F.array_compact(F.array(F.lit("source_map"), F.when(linked, F.lit("graph")), F.when(root.isNotNull(), F.lit("project_topology"))))
    why = F.when(linked, F.concat(F.lit("lexical edges link this ranked source with "), F.col("links").cast("string"), F.lit(" file relationships"))).otherwise("ranked source kept as structural context")
    rows = [src.select(*_row(F.lit("architecture"), F.col("rank"), F.when(linked, "high").otherwise("medium"), kinds, why, root, limits))]
    below = F.when(root == ".", F.col("path")).when(root.isNull(), F.col("path")).otherwise(F.expr("substring(path, length(project_root) + 2)"))
    library, program = below.isin(*LIBRARY_ENTRIES), below.isin(*MAIN_ENTRIES)
    entry = src.where(library | program)
    rows.append(entry.select(*_row(F.when(library, "architecture").otherwise("runtime"), F.lit(ENTRY_SCORE), "high", ["project_topology", "source_map"], F.lit("conventional entry point of its project"), root, limits)))
    focused = src.where("focus_matches > 0")
    said = F.concat(F.lit("an explicit focus matched this path "), F.col("focus_matches").cast("string"), F.lit(" times"))
    rows.append(focused.select(*_row(F.lit("architecture"), F.lit(2_000_000_000) + F.col("focus_matches").cast("long") * 1_000_000, "high", ["focus"], said, root)))

    real = files.select("path").unionAll(omitted.select("path")).distinct()
    marks = landmarks.join(real, "path", "left_semi")
    kind, bonus = F.col("kind"), F.col("priority").cast("long") * 1_000_000 + F.col("focus_matches").cast("long") * 1_000_000
    root_readme = F.when((kind == "readme") & ~F.col("path").contains("/"), 500_000).otherwise(0)
    purpose = F.when(kind.isin(*START_KINDS), "start_here").when(kind.isin(*RUNTIME_KINDS), "runtime").when(kind.isin(*CONTEXT_KINDS), "supporting_context")
    base = F.when(purpose == "start_here", F.lit(3_000_000_000) + root_readme).when(purpose == "runtime", F.lit(2_500_000_000)).otherwise(F.lit(500_000_000))
    used = marks.where(purpose.isNotNull())
    trust = F.when(purpose == "supporting_context", "medium").otherwise("high")
    rows.append(used.select(*_row(purpose, base + bonus, trust, ["landmark"], F.concat(F.lit("landmark: "), kind), root)))
    rows.append(used.where("focus_matches > 0").select(*_row(purpose, F.lit(2_000_000_000) + F.col("focus_matches").cast("long") * 1_000_000, "high", ["focus"], F.lit("an explicit focus matched this landmark"), root)))

    tests = landmarks.where("kind = 'test_root'").select(F.col("path").alias("_t")).distinct()
    under = src.select("*", F.explode(P.ancestors(F.col("path"))).alias("_a")).join(tests, F.col("_a") == F.col("_t"), "left_semi").drop("_a").distinct()
    rows.append(under.select(*_row(F.lit("tests"), F.lit(1_500_000_000) + F.col("rank"), "high", ["landmark", "source_map"], F.lit("source below a test directory"), root, limits)))

    for counts, score, said in ((churn, 600_000_000, "churn"), (bugs, 600_000_000, "bug fixes"), (fires, 400_000_000, "recovery commits")):
        joined = src.join(counts.select("path", "commits"), "path")
        why = F.concat(F.lit(f"{said} in "), F.col("commits").cast("string"), F.lit(" commits"))
        rows.append(joined.select(*_row(F.lit("supporting_context"), F.lit(score) + F.col("commits") * 100_000, "medium", ["history_overlap"], why, root, limits)))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def combine(rows: DataFrame) -> DataFrame:
    """One candidate for each purpose and path: scores summed, the rest united, the strongest confidence."""
    rank = lambda c, labels: F.array_position(F.array(*map(F.lit, labels)), c)
    kinds = F.flatten(F.collect_set("evidence_kinds"))
    ordered = F.transform(F.array_sort(F.array_distinct(F.transform(kinds, lambda k: F.struct(rank(k, EVIDENCE_KINDS).alias("o"), k.alias("k"))))), lambda s: s["k"])
    grouped = rows.groupBy("purpose", "path").agg(
        F.min("project_root").alias("project_root"), ordered.alias("evidence_kinds"), F.array_sort(F.collect_set("reason")).alias("reasons"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("limitations")))).alias("limitations"), F.sum("score").alias("score"),
        F.min_by("confidence", rank(F.col("confidence"), CONFIDENCES)).alias("confidence"),
    )
    return grouped


def with_manifests(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """Manifests of project roots as start_here candidates: a root one is raised, an absent one added."""
    wanted = roots.select(F.col("path").alias("_root"), F.explode("manifests").alias("_m"))
    joined = candidates.join(wanted, (F.col("purpose") == "start_here") & (F.col("path") == F.col("_m")), "full_outer")
    absent = F.col("path").isNull()
    top = F.col("_root") == "."
    score = F.when(absent, F.when(top, 3_090_000_000).otherwise(3_000_000_000)).when(top, F.greatest("score", F.lit(3_095_250_000))).otherwise(F.col("score"))
    none = F.array().cast("array<string>")
    return joined.select(
        F.coalesce("purpose", F.lit("start_here")).alias("purpose"), F.coalesce("path", "_m").alias("path"), F.when(absent, F.col("_root")).otherwise(F.col("project_root")).alias("project_root"),
        F.coalesce("evidence_kinds", F.array(F.lit("project_topology"))).alias("evidence_kinds"), F.coalesce("reasons", F.array(F.lit("manifest of a project root"))).alias("reasons"),
        F.coalesce("limitations", none).alias("limitations"), score.cast("long").alias("score"), F.coalesce("confidence", F.lit("high")).alias("confidence"),
    )


def shortlist(candidates: DataFrame) -> list[dict]:
    """All that the choice can ever reach: the best ten of each purpose and of each root, and the ten weakest.

    Ten picks can pass over nine paths at most, each of which has up to five purposes, so the
    lists hold the first fifty rows.
    """
    depth = MAX_PLAN * len(PURPOSES)
    strength = F.lit(4) - F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence"))
    rows = materialize(candidates.withColumn("strength", strength.cast("int")), "candidates")  # summed once for the three lists
    best = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("strength").desc(), "path", "purpose"))
    by_purpose = rows.withColumn("_n", best("purpose")).where(F.col("_n") <= depth).drop("_n")
    by_root = rows.where("project_root is not null").withColumn("_n", best("project_root")).where(F.col("_n") <= depth).drop("_n")
    weakest = rows.orderBy("score", "strength", F.col("path").desc()).limit(depth)
    seen = {}
    for part in (by_purpose, by_root, weakest):
        for r in part.collect():
            seen[r["purpose"], r["path"]] = r.asDict(recursive=True)
    release(rows)
    return [seen[k] for k in sorted(seen)]


def choose(candidates: list[dict], roots: list[dict], fill_order: str = "weakest") -> dict[str, object]:
    """The plan from a shortlist. ``roots`` has path and manifests, in order.

    First the best of each purpose, then the root's first manifest, then the best of each
    project root, then a fill up to ten: from the weakest candidate on, as the fill has always
    been, or from the strongest.
    """
    by_path = sorted(candidates, key=lambda c: c["path"], reverse=True)
    weakest = sorted(by_path, key=lambda c: (c["score"], c["strength"]))  # of equals the larger path first
    selected, taken = [], set()

    def take(c: dict | None) -> None:
        if c is not None:
            selected.append(c)
            taken.add(c["path"])

    def best(of) -> dict | None:
        return next((c for c in reversed(weakest) if of(c) and c["path"] not in taken), None)

    for purpose in PURPOSES:
        take(best(lambda c, p=purpose: c["purpose"] == p))
    top = next((r for r in roots if r["path"] == "."), None)
    if top and top["manifests"] and top["manifests"][0] not in taken:
        take(next((c for c in candidates if c["purpose"] == "start_here" and c["path"] == top["manifests"][0]), None))
    for r in roots:
        if len(selected) < MAX_PLAN:
            take(best(lambda c, p=r["path"]: c["project_root"] == p))
    for c in reversed(weakest) if fill_order == "strongest" else weakest:
        if len(selected) < MAX_PLAN and c["path"] not in taken:
            take(c)
    selected.sort(key=lambda c: (PURPOSES.index(c["purpose"]), -c["score"], c["path"]))
    plan = [
        {"ordinal": n, "purpose": c["purpose"], "path": c["path"], "project_root": c["project_root"], "reason": "; ".join(c["reasons"][:2]),
         "evidence_kinds": c["evidence_kinds"], "confidence": c["confidence"], "limitations": c["limitations"]}
        for n, c in enumerate(selected, 1)
    ]
    rooted, shown = {c["project_root"] for c in candidates}, {c["project_root"] for c in selected}
    omitted = [r["path"] for r in roots if r["path"] in rooted and r["path"] not in shown]
    shortfall = None
    if len(plan) < MIN_PLAN:
        few = len({c["path"] for c in candidates}) < MIN_PLAN
        shortfall = {"target_minimum": MIN_PLAN, "returned": len(plan), "reason": "few paths have evidence" if few else "scope and limits left few usable paths"}
    return {"recommendations": plan, "omitted_project_roots": omitted, "shortfall": shortfall}
