"""Cleaning of scanned lines: unusable lines go, legacy metres are repaired, couplets are made whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosodia.functions import metre as M

UNUSABLE = ("corrupt", "not scanned")
#: Lines from a group's start in which a pentameter makes it elegiac.
LOOK = 100


def usable(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("pattern").isNotNull() & ~F.col("pattern").isin(*UNUSABLE))


def fix_meters(lines: DataFrame, strict: bool = False) -> DataFrame:
    """metre and pattern anew from the codes; the legacy attribute goes. A line that is neither metre gets nulls, or fails the
    query if strict."""
    made = F.expr(M.repaired_metre())
    if strict:
        made = F.coalesce(made, F.raise_error(F.lit("a line is neither hexameter nor pentameter")))
    return lines.withColumns({"metre": made, "pattern": F.expr(M.build_pattern())}).drop("meter")


def clean(lines: DataFrame, by: list[str], order: str = "line_idx", strict: bool = False) -> DataFrame:
    """Cleaned lines of each group `by` (a division for books, a work for whole files), one window over it: repair if its first
    usable line is of the legacy kind, and drop lines that break couplets if a pentameter is among its first LOOK. A hexameter stays unless another follows
    it; a pentameter stays after a hexameter."""
    rows = usable(lines)
    run = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    if "meter" in rows.columns:
        legacy = F.coalesce(F.first("meter").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "E", F.lit(False))
        fixed = fix_meters(rows, strict)
        rows = rows.withColumn("_legacy", legacy).withColumns({c: F.when(F.col("_legacy"), F.expr(e)).otherwise(F.col(c)) for c, e in (("metre", M.repaired_metre()), ("pattern", M.build_pattern()))}).drop("_legacy")
        rows = rows.select(*fixed.columns)
    rows = rows.withColumn("_n", F.row_number().over(run)).withColumn("_e", F.max((F.col("metre") == "P") & (F.col("_n") <= LOOK)).over(whole))
    rows = rows.withColumns({"_next": F.lead("metre").over(run), "_prev": F.lag("metre").over(run)})
    kept = ~F.col("_e") | ((F.col("metre") == "H") & (F.col("_next").isNull() | (F.col("_next") != "H"))) | ((F.col("metre") == "P") & (F.col("_prev") == "H"))
    return rows.where(F.coalesce(kept, F.lit(False))).drop("_n", "_e", "_next", "_prev")


def kept(verses: str) -> str:
    """What clean() keeps of a group that is held as an array of structs with metre and pattern, in order: SQL of the shorter array. Without the legacy
    repair."""
    usable_ = f"filter({verses}, v -> v.pattern is not null and v.pattern not in ({', '.join(map(repr, UNUSABLE))}))"
    whole = "(v.metre = 'H' and coalesce(get(q.u, k + 1).metre <> 'H', true) or v.metre = 'P' and coalesce(get(q.u, k - 1).metre = 'H', false))"
    elegiac = f"exists(slice(u, 1, {LOOK}), v -> v.metre = 'P')"
    asked = f"transform(transform(array({usable_}), u -> named_struct('u', u, 'e', {elegiac})), q -> filter(q.u, (v, k) -> not q.e or {whole}))"
    return f"get({asked}, 0)"


def numbered(lines: DataFrame, by: list[str], order: str = "line_idx", out: str = "rn") -> DataFrame:
    """Places in the cleaned group, from 0."""
    return lines.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
