"""Checks of whole stages: rankings, labels, completed annotations, frozen inputs, configurations and manifests.

A check is one row: check_id, status, observed, expected. Counts that go together are one aggregation."""

from __future__ import annotations

import importlib.metadata
import json
import platform
import sys
from dataclasses import fields
from functools import reduce
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragstone.functions.text import is_identifier, is_timestamp, provenance, question_hash
from ragstone.operators.evaluation import FORBIDDEN_BLINDED, MANUAL_LABELS
from ragstone.operators.governance import Registry, config_hash

T = TypeVar("T")


def _rows(one: DataFrame, expected: dict[str, object]) -> DataFrame:
    """A row of observations as a row per check."""
    observed = one.select(*[F.col(k).cast("string").alias(k) for k in expected])
    wanted = F.create_map(*[F.lit(x) for k, v in expected.items() for x in (k, _text(v))])
    long = observed.unpivot([], list(expected), "check_id", "observed").withColumn("expected", wanted[F.col("check_id")])
    status = F.when(F.col("observed").eqNullSafe(F.col("expected")), "pass").otherwise("fail")
    return long.select("check_id", status.alias("status"), "observed", "expected")


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _counts(df: DataFrame, by: str, name: str) -> DataFrame:
    """One row: how many rows each value has, as text in the order of the values."""
    counted = df.groupBy(F.col(by).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("v", "n"))), lambda x: F.concat_ws("=", x["v"], x["n"].cast("string")))
    return counted.agg(F.array_join(parts, ",").alias(name))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def ranking_checks(
    ranked: DataFrame, conditions: DataFrame, summaries: DataFrame, question: str, depth: int, expected: dict[str, object], first: str
) -> DataFrame:
    """The nine checks of a retrieval stage.

    ranked: question, strategy, rank, chunk_id, split; conditions: question, strategy, k, keys; summaries: split; expected:
    ranked_hit_rows, condition_rows, question_split_counts and strategy_rows (counts as `a=1,b=2`). `first` is the strategy
    whose first ranks count the questions."""
    group = [question, "strategy"]
    per = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("ranks"), F.countDistinct("chunk_id").alias("chunks")
    )
    total = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("ranked_hit_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("ranks")), F.lit(0)).alias("unique_rank_keys"),
        F.count_if((F.col("low") != 1) | (F.col("high") != depth) | (F.col("ranks") != depth) | (F.col("n") != depth)).alias("rank_continuity"),
        F.count_if(F.col("chunks") != depth).alias("unique_chunks_per_ranking"),
    )
    deepest = conditions.filter(F.col("k") == depth).select(*group, F.col("keys").alias("every"))
    nested = conditions.join(deepest, group, "left").agg(
        F.count(F.lit(1)).alias("condition_rows"),
        F.count_if(F.col("every").isNull() | (F.col("keys") != F.slice(F.coalesce("every", "keys"), F.lit(1), F.col("k")))).alias("nested_prefixes"),
    )
    sealed = summaries.agg(F.count_if(F.col("split") == "test").alias("test_aggregate_sealed"))
    questions = _counts(ranked.filter((F.col("strategy") == first) & (F.col("rank") == 1)), "split", "question_split_counts")
    strategies = _counts(ranked, "strategy", "strategy_rows")
    none = ("unique_rank_keys", "rank_continuity", "unique_chunks_per_ranking")
    return _union(
        [
            _rows(total, {"ranked_hit_rows": expected["ranked_hit_rows"], **{k: 0 for k in none}}),
            _rows(nested, {"condition_rows": expected["condition_rows"], "nested_prefixes": 0}),
            _rows(sealed, {"test_aggregate_sealed": 0}),
            _rows(questions, {"question_split_counts": expected["question_split_counts"]}),
            _rows(strategies, {"strategy_rows": expected["strategy_rows"]}),
        ]
    )


def label_checks(
    labels: DataFrame, conditions: DataFrame, summaries: DataFrame, sample: DataFrame, blinded: DataFrame, key: DataFrame,
    registry: Registry, allowed: list[str], expected: dict[str, object],
) -> DataFrame:
    """The fourteen checks of a labelling stage.

    labels: question_id, strategy, k, split, y_suff, label_method (gold_span_coverage, benchmark_impossible, unresolved),
    label_status, gold_document_hit, fully_covered, exclusion_reason; expected: label_rows, split_row_counts,
    impossible_rows and sample_size."""
    keys = ["question_id", "strategy", "k"]
    spans, impossible = F.col("label_method") == "gold_span_coverage", F.col("label_method") == "benchmark_impossible"
    unresolved = F.col("label_status") == "unresolved"
    sound = (F.col("y_suff") == 0) & (F.col("label_status") == "preliminary_benchmark_negative") & F.col("gold_document_hit").isNull()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    before = F.lag("y_suff").over(Window.partitionBy("question_id", "strategy").orderBy("k"))
    covered = labels.filter(spans).withColumn("before", before).agg(F.count_if(F.col("before") > F.col("y_suff")).alias("k_monotonicity"))
    total = labels.agg(
        F.count(F.lit(1)).alias("label_rows"),
        (F.count(F.lit(1)) - F.countDistinct(*keys)).alias("unique_condition_labels"),
        F.count_if(spans & no((F.col("y_suff") == 1) == (F.col("fully_covered") > 0))).alias("full_span_rule"),
        F.count_if(impossible).alias("impossible_rows"),
        F.count_if(impossible & no(sound)).alias("benchmark_negative_provenance"),
        F.count_if(unresolved & (F.col("y_suff").isNotNull() | F.col("exclusion_reason").isNull())).alias("unresolved_are_na"),
    )
    mine, theirs = labels.select(*keys).distinct(), conditions.select(*keys).distinct()
    other = mine.withColumn("a", F.lit(1)).join(theirs.withColumn("b", F.lit(1)), keys, "full_outer")
    apart = other.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("exact_condition_coverage"))
    sealed = summaries.agg(F.count_if(F.col("split") == "test").alias("test_aggregate_sealed"))
    drawn = sample.agg(
        F.concat_ws("/", F.count(F.lit(1)), F.countDistinct("sample_id"), F.countDistinct("question_id"), F.count_if(~F.col("split").isin("train", "validation"))).alias("manual_sample")
    )
    ids = [df.select("sample_id").distinct().withColumn(n, F.lit(1)) for n, df in (("s", sample), ("b", blinded), ("k", key))]
    met = reduce(lambda a, b: a.join(b, "sample_id", "full_outer"), ids)
    separate = met.agg(F.count_if(F.col("s").isNull() | F.col("b").isNull() | F.col("k").isNull()).alias("annotation_key_separation"))
    try:
        registry.validate(allowed)
        guarded = True
    except ValueError:
        guarded = False
    unclassified = sorted(set(labels.columns) ^ set(registry.classes))
    exposed = sorted(set(FORBIDDEN_BLINDED) & set(blinded.columns))
    fixed = labels.sparkSession.createDataFrame(
        [(",".join(exposed), ",".join(unclassified), guarded)], "annotation_blinding string, column_governance_complete string, feature_allowlist_guard boolean"
    )
    size = expected["sample_size"]
    none = ("unique_condition_labels", "full_span_rule", "benchmark_negative_provenance", "unresolved_are_na")
    return _union(
        [
            _rows(total, {"label_rows": expected["label_rows"], "impossible_rows": expected["impossible_rows"], **{k: 0 for k in none}}),
            _rows(covered, {"k_monotonicity": 0}),
            _rows(_counts(labels, "split", "split_row_counts"), {"split_row_counts": expected["split_row_counts"]}),
            _rows(apart, {"exact_condition_coverage": 0}),
            _rows(sealed, {"test_aggregate_sealed": 0}),
            _rows(drawn, {"manual_sample": f"{size}/{size}/{size}/0"}),
            _rows(separate, {"annotation_key_separation": 0}),
            _rows(fixed, {"annotation_blinding": "", "column_governance_complete": "", "feature_allowlist_guard": True}),
        ]
    )


def annotation_checks(rows: DataFrame, template: DataFrame, size: int) -> DataFrame:
    """Checks of a returned annotation before its key is opened: columns, rows, ids, texts that nobody may have changed,
    labels, annotators and times. template: sample_id and what annotators were shown."""
    shown = [c for c in template.columns if c != "sample_id"]
    wanted = [*template.columns, "manual_label", "annotator_id", "annotation_timestamp"]
    digest = F.sha2(F.to_json(F.struct(*sorted(shown)), {"ignoreNullFields": "false"}), 256) if shown else F.lit("")
    given, original = rows.withColumn("now", digest), template.select("sample_id", digest.alias("then"), F.lit(1).alias("known"))
    both = given.join(original, "sample_id", "full_outer")
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    here = F.col("now").isNotNull()
    total = both.agg(
        F.count_if(here).alias("rows"),
        (F.count_if(here) - F.countDistinct(F.when(here, F.col("sample_id")))).alias("unique_samples"),
        F.count_if(~here | F.col("known").isNull()).alias("same_samples"),
        F.count_if(here & F.col("known").isNotNull() & (F.col("now") != F.col("then"))).alias("unchanged_texts"),
        F.count_if(here & ~F.lower(clean("manual_label")).isin(*MANUAL_LABELS)).alias("valid_labels"),
        F.count_if(here & ~is_identifier(clean("annotator_id"))).alias("valid_annotators"),
        F.count_if(here & ~is_timestamp(clean("annotation_timestamp"))).alias("valid_times"),
        F.countDistinct(F.when(here, clean("annotator_id"))).alias("annotators"),
    )
    none = ("unique_samples", "same_samples", "unchanged_texts", "valid_labels", "valid_annotators", "valid_times")
    odd = ",".join(sorted(set(rows.columns) ^ set(wanted)))
    fixed = rows.sparkSession.createDataFrame([(odd,)], "columns string")
    return _union([_rows(total, {"rows": size, **{k: 0 for k in none}, "annotators": 1}), _rows(fixed, {"columns": ""})])


def overall(checks: DataFrame) -> DataFrame:
    """One row: checks, failed, status."""
    failed = F.count_if(F.col("status") == "fail")
    return checks.agg(F.count(F.lit(1)).alias("checks"), failed.alias("failed"), F.when(failed == 0, "pass").otherwise("fail").alias("status"))


def frozen_inputs(spark: SparkSession, expected: dict[str, str]) -> DataFrame:
    """path, expected, observed, ok for files that must have a given SHA-256; an absent one isn't ok."""
    wanted = spark.createDataFrame(list(expected.items()), "path string, expected string")

    def digest(path: str) -> DataFrame | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), F.sha2("content", 256).alias("observed"))

    found = [x for x in map(digest, expected) if x is not None]
    seen = _union(found) if found else spark.createDataFrame([], "path string, observed string")
    return wanted.join(seen, "path", "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)))


def load_config(kind: type[T], path: str | Path, sha256: str | None = None, constants: dict[str, object] | None = None) -> T:
    """A dataclass from a JSON file with exactly its fields. The canonical hash and fields of fixed value are checked."""
    values = json.loads(Path(path).read_text(encoding="utf-8"))
    names = {f.name for f in fields(kind)}
    if set(values) != names:
        raise ValueError(f"fields {sorted(set(values) ^ names)} don't match {kind.__name__}")
    if sha256 and config_hash(values) != sha256:
        raise ValueError("the configuration has another hash")
    odd = {k: values.get(k) for k, v in (constants or {}).items() if values.get(k) != v}
    if odd:
        raise ValueError(f"fixed values differ: {odd}")
    return kind(**values)


def environment(packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict[str, object]:
    """Interpreter, platform and package versions; a package that isn't there is null."""

    def version(name: str) -> str | None:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return None

    return {
        "python": sys.version.split()[0],
        "implementation": platform.python_implementation(),
        "platform": platform.platform(),
        "packages": {p: version(p) for p in packages},
    }


def canonical(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def component_manifest(members: DataFrame, splits: DataFrame, seed: int) -> DataFrame:
    """One row per component: size, its questions, files and hashes as JSON arrays, counts, split and a hash of all that.

    members: component, question_id, filename (null if none), text, answerable; splits: component, split. Components are
    groups of related questions; their lists are bounded by that."""
    hashed = members.withColumn("h", question_hash(F.col("text")))
    listed = lambda c: F.to_json(F.sort_array(F.collect_set(c)))
    rows = hashed.groupBy("component").agg(
        F.countDistinct("question_id").alias("component_size"),
        listed("question_id").alias("member_question_ids_json"),
        listed("filename").alias("shared_gold_filenames_json"),
        listed("h").alias("normalized_question_hashes_json"),
        F.countDistinct(F.when(F.col("answerable"), F.col("question_id"))).alias("answerable_count"),
        F.countDistinct(F.when(~F.col("answerable"), F.col("question_id"))).alias("impossible_count"),
    )
    named = sorted([*rows.columns, "assigned_split"])
    return rows.join(splits.select("component", F.col("split").alias("assigned_split")), "component").withColumns(
        {"split_seed": F.lit(seed), "component_sha256": F.sha2(canonical(*map(F.col, named)), 256)}
    )


def assignment_manifest(questions: DataFrame, components: DataFrame, splits: DataFrame, seed: int) -> DataFrame:
    """One row per question: provenance, hashes, reference and evidence status, component and split.

    questions: question_id, text, answer (null or empty if none), answerable; components: question_id, component."""
    empty = F.coalesce(F.length(F.trim("answer")), F.lit(0)) == 0
    none = ~F.col("answerable")
    return (
        questions.join(components, "question_id")
        .join(splits, "component")
        .select(
            "question_id",
            provenance(F.col("question_id").cast("string")).alias("provenance_partition"),
            F.sha2("text", 256).alias("question_sha256"),
            question_hash(F.col("text")).alias("normalized_question_sha256"),
            none.alias("is_impossible"),
            F.when(none, "not_applicable_impossible").when(empty, "empty_answerable").otherwise("available").alias("reference_status"),
            F.when(none, "not_applicable_impossible").when(empty, "pending_manual_alignment").otherwise("confirmed_attached_context").alias("evidence_status"),
            "component",
            "split",
            F.lit(seed).alias("split_seed"),
        )
    )


def response_manifest(responses: DataFrame) -> DataFrame:
    """One row per response with hashes and counts of its labels, in the order of (length of the id, id) when written.

    responses: response_id, source_id, response, prompt, quality, task_type, labels (array of label_type, implicit_true,
    due_to_null)."""
    labels = F.col("labels")
    marked = lambda name: F.size(F.filter(labels, lambda x: x[name]))
    return responses.select(
        "response_id",
        F.length("response_id").alias("id_length"),
        "source_id",
        F.sha2("response", 256).alias("response_sha256"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.size(labels).alias("label_count"),
        (F.size(labels) > 0).alias("has_unsupported_span"),
        marked("implicit_true").alias("implicit_true_count"),
        marked("due_to_null").alias("due_to_null_count"),
        F.to_json(F.array_sort(F.array_distinct(F.transform(labels, lambda x: x["label_type"])))).alias("label_types_json"),
        (F.coalesce(F.col("task_type") == "QA", F.lit(False)) & F.coalesce(F.col("quality") == "good", F.lit(False))).alias("eligible"),
    ).orderBy("id_length", "response_id")


def unresolved_alignments(ids: list[str], spark: SparkSession, timestamp: str, rationale: str) -> DataFrame:
    """Records of questions whose evidence nobody has aligned: no document and no span is made up."""
    rows = spark.createDataFrame([(i,) for i in ids], "question_id string")
    empty = {c: F.lit(None).cast("string") for c in ("document", "evidence_start", "evidence_end", "annotator")}
    return rows.withColumns({"status": F.lit("unresolved"), **empty, "rationale": F.lit(rationale), "timestamp": F.lit(timestamp)})
