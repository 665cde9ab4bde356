"""The five stages as one plan: correct, redact, standardise, professionalise, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.names import correct_names
from ..operators.redact import redact
from ..operators.restore import restore
from ..operators.terms import professionalise, standardise
from ..session import cut
from ..sources.tables import Options


def process(notes: DataFrame, registry: DataFrame, variants: list[tuple[str, str]], feedback: DataFrame | None = None, rewriter=None, id_col: str = "note_id", text_col: str = "text", recogniser=None, with_windows: bool = True) -> DataFrame:
    """One wide row a note: the texts of all stages, the token map, the audits and ``n_corrections``, the sum over all five:
    names corrected, names redacted, both rewrites' changes, and tokens reversed."""
    corrected, _ = correct_names(notes, registry, feedback, id_col, text_col, recogniser, with_windows)
    redacted, _ = redact(cut(corrected), registry, id_col, "corrected")  # what a stage makes is read many times by the next
    standard = standardise(cut(redacted), variants, rewriter, "redacted").withColumnsRenamed({"ok": "standard_ok", "corrections": "standard_corrections"})
    done = professionalise(standard, rewriter, "standard").withColumnsRenamed({"ok": "professional_ok", "corrections": "professional_corrections"})
    sizes = F.col("n_names") + F.size("pii_map") + F.size("standard_corrections") + F.size("professional_corrections") + F.size("reversals")
    return restore(done, "professional").withColumn("n_corrections", sizes)


def health(spark: SparkSession) -> dict[str, str]:
    """What a service would report of itself: version, provider and stages."""
    return {"status": "ok", "spark": spark.version, "provider": Options.from_conf(spark).provider, "stages": "correct, redact, standardise, professionalise, restore"}
