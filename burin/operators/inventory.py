"""Metadata inventories as relations: scan, group, search, summarise, strip, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burin.functions.text import js_trim
from burin.operators.html import ENTRY, SAMPLE, html_entries  # noqa: F401


def frontmatter_entries(text: Column) -> Column:
    """Inventory of a Markdown text: the `key: value` lines of its frontmatter."""
    body = F.regexp_extract(text, r"\A---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|\z)", 1)
    pattern = r"^\s*([^:]+):\s*(.*?)\s*$"
    lines = F.filter(F.split(body, r"\r?\n"), lambda line: line.rlike(pattern) & (js_trim(F.regexp_extract(line, pattern, 1)) != ""))
    made = lambda line, i: F.struct((i + 1).cast("int").alias("ord"), F.lit("frontmatter").alias("where"), js_trim(F.regexp_extract(line, pattern, 1)).alias("key"), js_trim(F.regexp_extract(line, pattern, 1)).alias("label"), js_trim(F.regexp_extract(line, pattern, 2)).alias("value"), F.lit("medium").alias("sensitivity"), F.lit("with-container").alias("removal"), F.lit("frontmatter").alias("block"))
    return F.when(body != "", F.transform(lines, made)).otherwise(F.array().cast(ENTRY))


def exploded(df: DataFrame, entries: Column, *keep: str) -> DataFrame:
    """One row for each entry: the kept columns and the entry's fields."""
    return df.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.*")


def groups(entries: DataFrame, artifact: str) -> DataFrame:
    """Entries by place, groups in order of first appearance, rows in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", "value"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return entries.groupBy(artifact, "where").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_entries"), F.array_join(rows, "; ").alias("rows"))


def will_remove(removal: Column, mode: str, any_deletable: Column) -> Column:
    """Whether a cleaning removes an entry: deep mode all that can go, light mode only if a block can be sent."""
    return (removal != "never") & (F.lit(mode == "deep") | any_deletable)


# How an entry's fate is told.
PLANS = {
    "individual": ("Se elimina", "se puede borrar por sí sola"),
    "with-container": ("Se elimina", "se borra junto con su contenedor"),
    "never": ("Se conserva", "dato técnico o que el limpiador actual no elimina: se conserva"),
    "kept": ("Se conserva", "el modo Ligero no elimina esta entrada"),
}


def row_plan(removal: Column, mode: str, any_deletable: Column) -> Column:
    """struct(text, detail) of an entry in a mode."""
    plan = lambda k: F.struct(F.lit(PLANS[k][0]).alias("text"), F.lit(PLANS[k][1]).alias("detail"))
    spared = F.lit(mode == "light") & ~any_deletable
    return F.when(removal == "never", plan("never")).when(spared, plan("kept")).when(removal == "individual", plan("individual")).otherwise(plan("with-container"))


def group_plans(plans: DataFrame, artifact: str, plan: str = "plan") -> DataFrame:
    """One row for each place of an artifact: the plan of its entries, or `mixed` where they differ."""
    some = F.min(plan)
    return plans.groupBy(artifact, "where").agg(F.when(F.min(plan) != F.max(plan), F.lit("mixed")).otherwise(some).alias("plan"))


# Why an entry of a page is kept.
PRESERVED = {
    "doctype": "Se conserva: es la declaración estructural del documento.",
    "charset": "Se conserva: quitarlo rompe la codificación de la página.",
}


def preserved(entries: DataFrame) -> DataFrame:
    """Entries that a cleaning keeps for a reason that it tells, with the note."""
    note = F.create_map(*[F.lit(v) for pair in PRESERVED.items() for v in pair])[F.col("key")]
    return entries.where("removal = 'never'").withColumn("preserved_note", note).where(F.col("preserved_note").isNotNull())


def summary(entries: DataFrame, artifact: str, deep: bool = True, any_deletable: Column | None = None) -> DataFrame:
    """Entries, removed, preserved and highly sensitive ones of each artifact, in deep or light mode."""
    removable = will_remove(F.col("removal"), "deep" if deep else "light", F.lit(True) if any_deletable is None else any_deletable)
    return entries.groupBy(artifact).agg(F.count("*").alias("total"), F.count_if(removable).alias("removed"), F.count_if(~removable).alias("preserved"), F.count_if(F.col("sensitivity") == "high").alias("high_risk"))


def search(entries: DataFrame, artifact: str, term: str) -> DataFrame:
    """Entries whose key, label, value or place holds the term; a place that holds it keeps its group whole."""
    q = F.lit(term.lower())
    hit = F.contains(F.lower("key"), q) | F.contains(F.lower(F.coalesce("label", F.lit(""))), q) | F.contains(F.lower("value"), q) | F.contains(F.lower("where"), q)
    return entries.where(hit)


def verify(before: DataFrame, after: DataFrame, artifact: str, artifacts: DataFrame | None = None) -> DataFrame:
    """(artifact, status, remaining, sample) of every artifact: clean, remaining or unverifiable, with the first leftovers.

    A leftover is a removable entry that stands in both inventories with the same place, key,
    value and, where there is a column `hex`, the same hex; an entry without value and hex is no
    content. An artifact without any entry in both is unverifiable; `artifacts` (a table with the
    artifact's column) names those that neither inventory knows. A repeated entry is as many
    leftovers as it stands before. A null artifact has no row.
    """
    hexed = lambda df: F.coalesce(F.col("hex"), F.lit("")) if "hex" in df.columns else F.lit("")
    # Place, key, value and hex as one digest: values may be long, and nulls are like nulls.
    same = lambda df: df.where(F.col(artifact).isNotNull()).withColumn("__same", F.sha2(F.to_json(F.struct(F.col("where"), F.col("key"), F.col("value"), hexed(df).alias("hex"))), 256)).withColumn("__hex", hexed(df))
    kept = same(after).select(artifact, "__same").distinct()
    left = same(before).where("removal <> 'never' AND (coalesce(value, '') <> '' OR __hex <> '')").join(kept, [artifact, "__same"], "left_semi")
    # The first labels of each artifact: ranks are cut before the shuffle, so one artifact may hold any number of entries.
    first = left.withColumn("__rank", F.row_number().over(Window.partitionBy(artifact).orderBy("ord", "label"))).where(F.col("__rank") <= SAMPLE)
    sample = first.groupBy(artifact).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "label"))), lambda e: e["label"]), "; ").alias("sample"))
    known = before.select(artifact).unionAll(after.select(artifact)).distinct().withColumn("__known", F.lit(True))
    spine = known.select(artifact) if artifacts is None else artifacts.select(artifact).unionAll(known.select(artifact)).distinct()
    out = spine.where(F.col(artifact).isNotNull()).join(known, artifact, "left").join(left.groupBy(artifact).agg(F.count("*").alias("remaining")), artifact, "left").join(sample, artifact, "left")
    status = F.when(F.col("__known").isNull(), F.lit("unverifiable")).when(F.col("remaining").isNull(), F.lit("clean")).otherwise(F.lit("remaining"))
    return out.select(artifact, status.alias("status"), F.coalesce("remaining", F.lit(0)).alias("remaining"), F.coalesce("sample", F.lit("")).alias("sample"))
