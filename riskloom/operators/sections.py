"""Record texts cut into sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION_SOURCES = {
    "full_text": ["full_text"],
    "eligibility_criteria": ["eligibilityCriteria", "eligibility_criteria"],
    "primary_outcome": ["primaryOutcomeMeasure", "primary_outcome_measure", "primary_outcome"],
}


def section_texts(rows: DataFrame, key: str, sections: dict[str, Sequence[str]] = SECTION_SOURCES) -> DataFrame:
    """One row per record and section; a section without a column takes the full text.

    The first column a table has stands for the section, null text is empty, and
    every record yields every section.
    """
    parts = []
    for name, candidates in sections.items():
        column = next((c for c in candidates if c in rows.columns), "full_text")
        text = F.coalesce(F.col(column), F.lit(""))
        parts.append(F.struct(F.lit(name).alias("section"), text.alias("text")))
    return rows.select(key, F.explode(F.array(*parts)).alias("_p")).select(key, "_p.*")
