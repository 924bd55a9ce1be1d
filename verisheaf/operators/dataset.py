"""Building view and case datasets from cleaned records, and checks on their splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisheaf.functions import records as R
from verisheaf.functions import text as T
from verisheaf.operators.quality import dense_ordinal, keep_first_of_two, listed_once, reasons_of


def case_views(records: DataFrame) -> DataFrame:
    """DQ4: records (record_index, images, messages) with sections, positions (of images) and case_reasons."""
    out = records.withColumn("target", R.first_content(F.col("messages"), "assistant")).withColumn("__v", T.view_sections(F.col("target")))
    out = out.withColumn("sections", F.col("__v.sections")).withColumn("positions", F.transform("images", R.image_position))
    named = F.filter("positions", lambda p: p.isNotNull())
    rules = {
        "image_filename_position_unresolved": F.exists("positions", lambda p: p.isNull()),
        "duplicate_image_position": F.size(F.array_distinct(named)) != F.size("positions"),
        "image_section_labels_not_exact_match": F.array_sort(F.array_distinct(named)) != F.array_sort(F.transform("sections", lambda s: s["label"])),
    }
    reasons = F.array_sort(F.array_union("__v.reasons", reasons_of(rules)))
    return listed_once(out, "case_reasons", reasons).drop("__v")


def one_to_one(records: DataFrame, min_chars: int = 8) -> tuple[DataFrame, DataFrame]:
    """DQ5, DD3: (views, excluded). A view has one_to_one_index, record_index, image, source_position, answer, diagnosis
    and analysis_chars; views whose image or answer was taken before are excluded and take nothing themselves."""
    cases = case_views(records)
    bad_cases = cases.where(F.size("case_reasons") > 0).select("record_index", F.lit(None).cast("string").alias("image"), F.col("case_reasons").alias("reasons"))
    pair = F.arrays_zip(F.col("images").alias("image"), F.col("positions").alias("position"))
    views = cases.where(F.size("case_reasons") == 0).select("record_index", "target", "sections", F.posexplode(pair).alias("place", "v"))
    text = F.filter("sections", lambda s: s["label"] == F.col("v.position"))[0]["content"]
    views = views.select("record_index", "place", F.col("v.image").alias("image"), F.col("v.position").alias("source_position"), T.normalize_lines(text).alias("analysis"), T.diagnosis_line(F.col("target")).alias("diagnosis"))
    views = views.withColumn("answer", F.concat(F.lit("图像分析："), F.col("analysis"))).withColumn("analysis_chars", T.cjk_count(F.col("analysis"))).withColumn("key", T.canonical_target(F.col("answer")))
    views = listed_once(views, "reasons", reasons_of({"single_view_analysis_too_short": F.col("analysis_chars") < min_chars, "position_token_remains_in_target": F.col("answer").rlike(T.VIEW_POSITION)}))
    views = views.withColumn("at", F.col("record_index") * 1_000_000 + F.col("place"))
    fine = keep_first_of_two(views.where(F.size("reasons") == 0), "at", "image", "key")
    repeated = fine.where("not keep").select("record_index", "image", F.array(F.lit("duplicate_image_or_target")).alias("reasons"))
    bad_views = views.where(F.size("reasons") > 0).select("record_index", "image", "reasons")
    kept = dense_ordinal(fine.where("keep").drop("keep", "reasons", "key"), "at", "one_to_one_index").drop("at", "place")
    return kept, bad_cases.unionByName(bad_views).unionByName(repeated)


def numbered_evidence(order: str, text: str) -> Column:
    """GR1, an aggregate: texts of a group in order, numbered, a line each."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x, i: F.concat(F.lit("证据"), (i + 1).cast("string"), F.lit("："), x[text]))
    return F.concat_ws("\n", lines)


def group_cases(views: DataFrame, case: str, order: str, text: str, diagnosis: str, source: str) -> DataFrame:
    """GR1, GR2: per case view_count, view_order, evidence, the diagnosis and source, and whether they are consistent (one
    each, diagnosis not empty). Groups are the views of one case, a handful."""
    one = F.min(F.trim(diagnosis)).eqNullSafe(F.max(F.trim(diagnosis))) & (F.min(source) == F.max(source)) & (F.coalesce(F.max(F.trim(diagnosis)), F.lit("")) != "")
    return views.groupBy(case).agg(F.count(F.lit(1)).alias("view_count"), F.sort_array(F.collect_list(order)).alias("view_order"), numbered_evidence(order, text).alias("evidence"), F.max(F.trim(diagnosis)).alias("diagnosis"), F.max(source).alias("source"), one.alias("consistent"))


def consistent_cases(cases: DataFrame, policy: str = "skip") -> DataFrame:
    """GR2: policy for cases that contradict themselves: record (keep, with the flag), skip, or abort."""
    if policy == "abort":
        bad = cases.where("not consistent").limit(5).collect()
        if bad:
            raise ValueError(f"cases that contradict themselves: {bad}")
    return cases if policy == "record" else cases.where("consistent")


def case_records(cases: DataFrame, prompt: str = "") -> DataFrame:
    """Records that ask for a diagnosis from a case's evidence."""
    return cases.withColumn("record", R.record(F.concat(F.lit(prompt + "\n"), F.col("evidence")), F.concat(F.lit("病理诊断："), F.col("diagnosis"))))


def direct_records(records: DataFrame, prompt: str = "") -> DataFrame:
    """PR11, PR12: a record per case with all its images and its diagnosis alone; cases without either are left out."""
    found = records.withColumn("diagnosis", T.diagnosis_tail(R.first_content(F.col("messages"), "assistant"))).where((F.size("images") > 0) & (F.col("diagnosis") != ""))
    return found.select("record_index", R.record(R.prompt_with_images(F.col("images"), prompt), F.concat(F.lit("病理诊断："), F.col("diagnosis")), F.col("images")).alias("record"))


def take_first(rows: DataFrame, order: str, n: int) -> DataFrame:
    """SO3: the first n rows; raises if there are fewer."""
    out = rows.orderBy(order).limit(n)
    if (found := out.count()) < n:
        raise ValueError(f"{found} rows of {n} that are needed")
    return out


def shared_images(train: DataFrame, test: DataFrame, column: str = "images") -> DataFrame:
    """GR3: images that both splits have."""
    return train.select(F.explode(column).alias("image")).intersect(test.select(F.explode(column).alias("image")))


def contiguous(rows: DataFrame, ordinal: str) -> DataFrame:
    """WN3: one row, whether the ordinal runs from 0 without gap or repeat."""
    return rows.agg(F.coalesce((F.min(ordinal) == 0) & (F.max(ordinal) == F.count(F.lit(1)) - 1) & (F.count_distinct(ordinal) == F.count(F.lit(1))), F.lit(True)).alias("contiguous"))
