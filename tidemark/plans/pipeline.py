"""The cleaning pipeline: names, structure, quality, semantics, relations, patterns, imputation, export.

Rows are never dropped and columns never added (but for columns merged under one name).
A fitted pipeline is a JSON-able dict of plans; applying it is a chain of projections
between a few aggregate jobs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame

from ..operators import export, impute, names, patterns, quality, relations, semantics, structure
from ..operators import issues as I
from ..operators import profile as P
from ..sources import scratch, shared
from ..sources.files import ingest
from ..sources.stores import LearningMemory, SemanticHistory
from . import advisor as A

# What each mode sets.
MODES = {"conservative": (False, 0.90), "balanced": (True, 0.75), "aggressive": (True, 0.60)}
STAGES = ["names", "structure", "quality", "semantics", "relations", "patterns", "impute", "export"]


@dataclass
class Options:
    mode: str = "balanced"
    aliases: dict[str, str] | None = None
    aliasing: bool = True
    structure: structure.Config = field(default_factory=structure.Config)
    quality: quality.Config = field(default_factory=quality.Config)
    semantics: semantics.Config | None = None  # as given; else the mode sets its threshold
    impute: impute.Config = field(default_factory=impute.Config)
    impute_missing: bool | None = None  # as given; else the mode tells.  impute.enabled=False switches imputation off either way
    date_tolerance: int = 0
    numeric_tolerance: float = 0.0
    custom_patterns: dict[str, dict] = field(default_factory=dict)
    fix_patterns: bool = False
    export_dates: bool = True
    semantic_hints: bool = False  # meanings found after the structural stage guide the quality stage
    history_path: str | None = None
    memory_path: str | None = None
    memory_rule: str = "short"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        fills, threshold = MODES[self.mode]
        if self.semantics is None:
            self.semantics = semantics.Config(threshold=threshold)
        if self.impute_missing is None:
            self.impute_missing = fills


@dataclass
class Result:
    df: DataFrame
    issues: DataFrame
    report: dict


class CleaningPipeline:
    def __init__(self, options: Options | None = None, advisor: A.SchemaAdvisor | None = None):
        self.options, self.advisor = options or Options(), advisor
        self.plans: dict | None = None
        self.last_report: dict = {}

    def fit(self, df: DataFrame) -> CleaningPipeline:
        """Learns names, structure and quality profile; the other stages look at the data they are given."""
        return self._fit(_ingested(df))

    def _fit(self, df: DataFrame) -> CleaningPipeline:
        o = self.options
        warnings = P.input_warnings(df)
        advice, status = {"columns": {}, "mode": None}, "off"
        if self.advisor:
            try:
                advice, status = A.safe(self.advisor.advise(P.dataset_summary(df)), df.columns), "ok"
            except Exception as e:  # advice is optional, but its failure is told
                status = f"failed: {e}"
        hints = A.overrides(advice)
        raw = [c for c in df.columns if c != P.ROW_ID]
        renamed = names.plan(raw, o.aliases, hints["aliases"], o.aliasing)
        df = names.rename(df, [*renamed, P.ROW_ID])
        # Copies: what one data set's advice adds is not handed on to the next.
        q = replace(o.quality, semantic_types=o.quality.semantic_types | hints["semantic_types"], semantic_confidences=o.quality.semantic_confidences | {c: advice["columns"][c]["confidence"] for c in hints["semantic_types"]}, domains=o.quality.domains | hints["domains"], id_columns=[*o.quality.id_columns, *hints["id_columns"]])
        s_plan = structure.fit(df, o.structure)
        df = scratch.made(structure.apply(df, s_plan, o.structure)[0], "fitted")[0]
        if o.semantic_hints:
            found = P.meanings(df)
            q = replace(q, semantic_types=q.semantic_types | {c: m for c, m in found.items() if m in ("date", "amount")})
        q_plan = quality.fit(df, q)
        self.plans = {"names": dict(zip(raw, renamed, strict=True)), "advised_aliases": hints["aliases"], "quality_config": asdict(q), "structure": structure.save(s_plan), "quality": asdict(q_plan), "custom_patterns": o.custom_patterns | hints["custom_patterns"], "advice": advice["columns"], "advisor": status, "input_warnings": warnings}
        return self

    def transform(self, df: DataFrame, strict: bool = False, progress: Callable[[str, float], None] | None = None) -> Result:
        """Cleaned df, issues of all stages, and a report by stage.

        A stage that fails leaves the frame as the stage before it made it (an error if strict).
        After the stages of BOUNDARIES the frame is made and its rows counted; an error in
        rows, or a changed number of them, goes back to the last frame that was made.
        """
        return self._transform(_ingested(df), strict, progress)

    def _transform(self, df: DataFrame, strict: bool = False, progress: Callable[[str, float], None] | None = None) -> Result:
        if self.plans is None:
            raise RuntimeError("fit the pipeline first")
        o, plans = self.options, self.plans
        before = [c for c in df.columns if c != P.ROW_ID]
        spark = df.sparkSession
        found: list[DataFrame] = []
        warnings, rows = P.input_state(df)
        report: dict = {"stages": {}, "status": "success", "advisor": plans["advisor"], "input_warnings": warnings, "rows": {"before": rows, "after": rows}, "nulls": {}}
        advice, custom = dict(plans["advice"]), dict(plans["custom_patterns"])

        def stage_semantics(df):
            """Asks about the columns of this data set that no rule is sure of, where there is an advisor."""
            told = {}
            history = SemanticHistory(o.history_path) if o.history_path else None
            if self.advisor:
                decided = semantics.decide(df, o.semantics, history, advice)
                asked = [c for c, d in decided.items() if d["ambiguous"]]
                told = {"asked": asked, "advisor": "off"}
                if asked:
                    try:
                        given = A.safe(self.advisor.advise(A.ambiguous_only(P.dataset_summary(df), asked)), asked)
                        advice.update(given["columns"])
                        # Patterns that the user gave stay in force.
                        custom.update({c: s for c, s in A.overrides(given)["custom_patterns"].items() if c not in o.custom_patterns})
                        told["advisor"] = "ok"
                    except Exception as e:  # as at fit: told, not raised
                        told["advisor"] = f"failed: {e}"
            out, issues, more = semantics.apply(df, o.semantics, history, advice)
            return out, issues, more | told

        def stage_names(df):
            raw = [c for c in df.columns if c != P.ROW_ID]
            # By name, so that reordered, missing and added columns keep their values.
            new = [plans["names"].get(c, n) for c, n in zip(raw, names.plan(raw, o.aliases, plans["advised_aliases"], o.aliasing), strict=True)]
            merged = sorted({n for n in new if new.count(n) > 1})
            return names.rename(df, [*new, P.ROW_ID]), None, {"renamed": {a: b for a, b in zip(raw, new, strict=True) if a != b}, "merged": merged}

        def stage_quality(df):
            # A table, as all decisions of the stage are taken from it.
            df = scratch.made(df, "structured")[0]
            out, told = quality.apply(df, quality.Plan(**plans["quality"]), quality.Config(**plans["quality_config"]), LearningMemory(o.memory_path, o.memory_rule))
            return out, None, told

        stages = {
            "names": stage_names,
            "structure": lambda d: _middle(structure.apply(d, structure.load(plans["structure"]), o.structure)),
            "quality": stage_quality,
            "semantics": stage_semantics,
            "relations": lambda d: relations.apply(d, o.date_tolerance, o.numeric_tolerance),
            "patterns": lambda d: patterns.apply(d, custom, o.fix_patterns),
            "impute": lambda d: impute.apply(d, replace(o.impute, enabled=o.impute.enabled and o.impute_missing)),
            "export": lambda d: _middle(export.apply(d)) if o.export_dates else (d, None, {}),
        }
        made, kept = df, 0
        for i, (name, run) in enumerate(stages.items()):
            if progress:
                progress(name, i / len(stages))
            try:
                out, issues, told = run(df)
                changed = names.differences(df.columns, out.columns)
                if name != "names" and (changed["dropped"] or changed["new"] or changed["order_changed"]) and not o.structure.force_schema:
                    raise ValueError(f"stage {name} changed the columns: {changed}")
                if name in BOUNDARIES:
                    # Rows and nulls are counted by the job that makes the frame.
                    out, now, nulls = scratch.made(out, name)
                    if now != rows:
                        raise ValueError(f"stage {name} made {now} rows of {rows}")
                    report["nulls"][name] = {c: n for c, n in nulls.items() if c != P.ROW_ID}
                df = out
                report["stages"][name] = told | {"status": "success"}
                if issues is not None:
                    found.append(issues)
                if name in BOUNDARIES:
                    made, kept = df, len(found)
            except Exception as e:
                if strict:
                    raise
                if name in BOUNDARIES:
                    # Any stage since the last frame may be at fault, and its issues rest on rows that cannot be made.
                    df, found = made, found[:kept]
                report["status"] = "partial_success"
                report["stages"][name] = {"status": "failed", "error": str(e)}
        if progress:
            progress("done", 1.0)
        report["columns"] = {"before": before, "after": [c for c in df.columns if c != P.ROW_ID]}
        self.last_report = report
        return Result(df, I.distinct(I.union(spark, found)), report)

    def fit_transform(self, df: DataFrame, **k) -> Result:
        df = _ingested(df)
        return self._fit(df)._transform(df, **k)

    def save(self, path: str) -> None:
        """The plans and all options as a JSON file, whole or not at all; path may be a URI."""
        if self.plans is None:
            raise RuntimeError("fit the pipeline first")
        shared.write_text(path, json.dumps({"options": asdict(self.options), "plans": self.plans}, default=str, indent=1))

    @classmethod
    def load(cls, path: str, options: Options | None = None) -> CleaningPipeline:
        data = json.loads(shared.read_text(path))
        if not data.get("plans"):
            raise ValueError("the file holds no fitted pipeline")
        parts = {"structure": structure.Config, "quality": quality.Config, "semantics": semantics.Config, "impute": impute.Config}
        out = cls(options or Options(**{k: parts[k](**v) if k in parts else v for k, v in data["options"].items()}))
        out.plans = data["plans"]
        return out


#: Stages after which the frame is made a table of its own, so that later aggregates do not repeat all before them.
BOUNDARIES = ("quality", "relations", "impute")


def _ingested(df: DataFrame) -> DataFrame:
    """The input as a table of its own: fit and transform read it a dozen times, and its source may be slow or change."""
    return scratch.made(ingest(df), "input")[0]


def _middle(pair):
    df, told = pair
    return df, None, told


def without_row_id(df: DataFrame) -> DataFrame:
    return df.drop(P.ROW_ID)


def build(mode: str = "balanced", advisor: A.SchemaAdvisor | None = None, **options) -> CleaningPipeline:
    return CleaningPipeline(Options(mode=mode, **options), advisor)


def fit_and_save(df: DataFrame, path: str, mode: str = "balanced", **options) -> CleaningPipeline:
    out = build(mode, **options).fit(df)
    out.save(path)
    return out
