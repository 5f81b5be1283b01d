"""Per-visit samples: neighbours, filters, cumulative history and the labels of the task library.

Neighbours are taken over all visits, filters follow, then counts, then history: one partitioning by
patient and one order serve all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_US = 86_400_000_000


def by_patient():
    return Window.partitionBy("patient_id").orderBy("encounter_time", "visit_id")


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days of elapsed time, rounded down; not a difference of calendar days."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / DAY_US)


def los_class(days: Column) -> Column:
    """Length of stay in ten classes: under a day, each day of the first week, the second week, longer."""
    return F.when(days < 1, 0).when(days <= 7, days).when(days <= 14, 8).otherwise(9).cast("int")


def with_next(visits: DataFrame, *columns: str) -> DataFrame:
    """``next_<column>`` of the patient's following visit, null on the last one."""
    return visits.withColumns({f"next_{c}": F.lead(c).over(by_patient()) for c in columns} | {"has_next": F.lead(F.lit(True), 1, False).over(by_patient())})


def nonempty(*roles: str) -> Column:
    """All of the given arrays have an element."""
    cond = F.lit(True)
    for r in roles:
        cond = cond & (F.size(r) > 0)
    return cond


def at_least(samples: DataFrame, least: int) -> DataFrame:
    """Patients with fewer than ``least`` samples go."""
    return samples.withColumn("_n", F.count("*").over(Window.partitionBy("patient_id"))).where(F.col("_n") >= least).drop("_n")


def last_samples(samples: DataFrame, most: int) -> DataFrame:
    """The latest ``most`` samples of each patient."""
    late = Window.partitionBy("patient_id").orderBy(F.desc("encounter_time"), F.desc("visit_id"))
    return samples.withColumn("_r", F.row_number().over(late)).where(F.col("_r") <= most).drop("_r")


def with_history(samples: DataFrame, *columns: str, suffix: str = "_hist") -> DataFrame:
    """``<column>_hist``: the column's values up to and including this sample, in order."""
    upto = by_patient().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.withColumns({c + suffix: F.collect_list(c).over(upto) for c in columns})


def with_masked_history(samples: DataFrame, column: str, pad: str = "<pad>", width: int = 3) -> DataFrame:
    """``<column>_hist`` without this sample's own value: ``width`` pads as the first entry, then the earlier values."""
    before = by_patient().rowsBetween(Window.unboundedPreceding, -1)
    first = F.array(F.array(*([F.lit(pad)] * width)))
    return samples.withColumn(column + "_hist", F.concat(first, F.collect_list(column).over(before)))


def masked_last(history: Column, fill: Column) -> Column:
    """An array with its last element replaced: the current visit's value is hidden."""
    return F.concat(F.slice(history, 1, F.size(history) - 1), F.array(fill))


def truncate_codes(codes: Column, characters: int) -> Column:
    return F.transform(codes, lambda c: F.substring(c, 1, characters))


def tail(items: Column, most: int) -> Column:
    """The last ``most`` elements."""
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - most + 1), most)


def label_readmission(days: int = 15) -> Column:
    """1 if the next encounter starts within fewer than ``days`` whole days."""
    return (elapsed_days("next_encounter_time", "encounter_time") < days).cast("int")


def label_next_mortality() -> Column:
    """The next visit's discharge status where it is 0 or 1, else 0."""
    status = F.col("next_discharge_status")
    return F.when(status.cast("int").isin(0, 1), status.cast("int")).when(status == "Expired", 1).otherwise(0)


def label_mortality_within(hours: int = 24, death: str = "death_time") -> Column:
    """1 if death follows the encounter by less than ``hours``; 0 without a death."""
    gap = F.unix_micros(death) - F.unix_micros("encounter_time")
    return F.coalesce((gap < hours * 3_600_000_000).cast("int"), F.lit(0))


def label_stay() -> Column:
    return los_class(elapsed_days("discharge_time", "encounter_time"))


def map_groups(visits: DataFrame, column: str, groups: DataFrame, key: str = "visit_id") -> DataFrame:
    """(key, groups): the sorted distinct groups that ``groups`` (code, grp) has for the codes of an array column."""
    codes = visits.select(key, F.explode(column).alias("code"))
    return codes.join(groups, "code").groupBy(key).agg(F.array_sort(F.collect_set("grp")).alias("groups"))


TASKS: dict[str, tuple[Callable[[], Column], bool]] = {
    "readmission": (label_readmission, True),
    "next_mortality": (label_next_mortality, True),
    "mortality": (label_mortality_within, False),
    "stay": (label_stay, False),
}


def build_samples(visits: DataFrame, task: str, least: int = 1, history: tuple[str, ...] = ("conditions", "procedures", "drugs"), label: Column | None = None) -> DataFrame:
    """Samples of a scalar-label task: neighbours, empty roles out, rare patients out, history, label.

    ``task`` is one of ``TASKS``; ``label`` overrides its rule. Visits with an empty role give no sample
    but still serve as the next visit of the one before.
    """
    rule, needs_next = TASKS[task]
    rows = with_next(visits, "encounter_time", "discharge_status")
    keep = nonempty("conditions", "procedures", "drugs")
    rows = rows.where(keep & F.col("has_next")) if needs_next else rows.where(keep)
    rows = rows.withColumn("label", label if label is not None else rule())
    return with_history(at_least(rows, least), *history, "visit_id")


def phenotype_samples(visits: DataFrame, groups: DataFrame, key: str = "visit_id") -> DataFrame:
    """(visit_id, label): the groups that ``groups`` (code, grp) has for the next visit's conditions; visits without a next one or with an empty role give none."""
    rows = with_next(visits, "conditions").where(nonempty("conditions", "procedures", "drugs") & F.col("has_next"))
    return map_groups(rows, "next_conditions", groups, key).withColumnRenamed("groups", "label")


def next_code_samples(visits: DataFrame, most: int = 20, least: int = 3) -> DataFrame:
    """Samples whose label is the next visit's conditions; the latest ``most`` of a patient, and patients with ``least`` or more."""
    rows = with_next(visits, "conditions").where(nonempty("conditions", "procedures", "drugs") & (F.size("next_conditions") > 0))
    return with_history(at_least(last_samples(rows, most), least), "visit_id").withColumn("label", F.col("next_conditions"))


def drug_samples(visits: DataFrame, least: int = 1, characters: int = 4) -> DataFrame:
    """Samples whose label is the visit's own drugs, cut to ``characters``; their history hides them."""
    rows = visits.where(nonempty("conditions", "procedures", "drugs")).withColumn("drugs", truncate_codes(F.col("drugs"), characters))
    return with_masked_history(at_least(rows, least), "drugs").withColumn("label", F.col("drugs"))


#: Task -> kind of its metric, kind of its prompts.
MODES = {
    "PHE": ("multilabel", "ehr"), "DIAG": ("multilabel", "ehr"), "REC": ("multilabel", "ehr"), "LOS": ("multiclass", "ehr"), "MOR": ("binary", "ehr"), "REA": ("binary", "ehr"), "IHM": ("binary", "ehr"),
    "SUMMARY": ("text", "summary"), "MULTIPLE": ("multilabel", "mqa"), "SINGLE": ("multiclass", "qa"),
}
#: Which cohort tasks each source has.
SOURCES = {
    "MIII": ("PHE", "LOS", "MOR", "IHM", "REA", "REC"), "MIV": ("LOS", "MOR", "IHM", "REA", "REC"), "MIV-Note": ("PHE", "REC"), "eICU": ("PHE", "LOS", "MOR", "IHM", "REA", "REC"),
    "EHR-SHOT": ("DIAG",), "OMOP": ("DIAG",), "PIC": (), "OMIX": (),
}


def task_samples(visits: DataFrame, source: str, task: str, least: int = 1, groups: DataFrame | None = None) -> DataFrame:
    """The samples of a source's task, all with a column ``label``; ``groups`` (code, grp) is needed for PHE.

    An unknown source or task, and a task that the source does not have, is an error.
    """
    if source not in SOURCES or task not in MODES:
        raise ValueError(f"no such source or task: {source}, {task}")
    if task not in SOURCES[source]:
        raise ValueError(f"{source} has no {task}")
    if task == "PHE":
        if groups is None:
            raise ValueError("PHE needs a table of codes and their groups")
        return phenotype_samples(visits, groups)
    if task == "DIAG":
        return next_code_samples(visits)
    if task == "REC":
        return drug_samples(visits, least)
    return build_samples(visits, {"REA": "readmission", "IHM": "next_mortality", "MOR": "mortality", "LOS": "stay"}[task], least)


def with_notes(visits: DataFrame, notes: DataFrame, keys: list[str], column: str, size: int) -> DataFrame:
    """Visits with the vector ``column`` of their note, found by ``keys``; ``size`` zeros where there is none."""
    none = F.array_repeat(F.lit(0.0), size)
    return visits.join(notes.select(*keys, F.col(column).cast("array<double>").alias(column)), keys, "left").withColumn(column, F.coalesce(column, none))


def swapped_history(samples: DataFrame) -> DataFrame:
    """Samples of a source that records drugs as procedures: ``procedures`` becomes the drug history, ``drugs`` the last procedures."""
    return samples.withColumns({"procedures": F.col("drugs_hist"), "drugs": F.col("procedures")})
