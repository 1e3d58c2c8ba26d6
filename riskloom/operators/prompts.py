"""Prompt texts assembled from columns; no model is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import numbers
from riskloom.functions.scoring import describe_changes


def _lines(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def explain_prompt(
    title: Column, condition: Column, tier: Column, probability: Column, contributions: Column
) -> Column:
    """Prompt that asks why a record carries its risk, with its three strongest factors.

    ``contributions`` is an array of (name, shap) structs.
    """
    ranked = F.array_sort(
        F.transform(
            contributions,
            lambda c: F.struct(
                (-F.abs(c["shap"])).alias("_rank"), c["name"].alias("name"), c["shap"].alias("shap")
            ),
        )
    )
    factors = F.array_join(
        F.transform(
            F.slice(ranked, 1, 3),
            lambda c: _lines("  - ", c["name"], ": contribution = ", numbers.fixed(c["shap"], 3, signed=True)),
        ),
        "\n",
    )
    return _lines(
        "Trial: ", title,
        "\nCondition: ", condition,
        "\nRisk tier: ", tier,
        "\nTermination probability: ", numbers.percent(probability, 1),
        "\n\nTop contributing factors:\n", factors,
        "\n\nExplain in 2-3 sentences why this trial carries this risk level.",
    )


def rewrite_prompt(
    section: Column,
    phase: Column,
    condition: Column,
    contribution: Column,
    body: Column,
    width: int = C.SECTION_WINDOW_AFTER,
) -> Column:
    """Prompt that asks for edits of one section; the reply is JSON."""
    return _lines(
        "Protocol section: ", section,
        "\nTrial phase: ", phase,
        "\nCondition: ", condition,
        "\nRisk contribution score: ", numbers.fixed(contribution, 3, signed=True),
        "\n\nSection text:\n", F.substring(body, 1, width),
        "\n\nSuggest 2-3 specific, actionable edits to reduce termination risk.\n",
        'Respond in JSON: {"rewrites": ["edit 1", "edit 2", "edit 3"]}',
    )


def whatif_prompt(before: Column, after: Column, old: Column, new: Column) -> Column:
    """Prompt that asks why the risk changed, listing the changed parameters by name."""
    delta = new - old
    changes = F.transform(
        F.array_sort(F.map_entries(describe_changes(before, after))),
        lambda e: _lines(
            '  "', e["key"], '": {"from": ', F.coalesce(e["value"]["from"], F.lit("null")),
            ', "to": ', F.coalesce(e["value"]["to"], F.lit("null")), "}",
        ),
    )
    return _lines(
        "Original termination probability: ", numbers.percent(old, 1),
        "\nNew termination probability: ", numbers.percent(new, 1),
        "\nRisk ", numbers.delta_direction(delta), " by ", numbers.percent(F.abs(delta), 1),
        "\n\nParameters changed:\n", F.array_join(changes, "\n"),
        "\n\nExplain in 1-2 sentences why the risk changed (or didn't).",
    )


def choice_label(key: Column, title: Column, condition: Column, tier: Column, probability: Column) -> Column:
    """Display label ``[HIGH] key — title · condition… (82%)``."""
    tag = (
        F.when(F.contains(tier, F.lit("HIGH")), "HIGH")
        .when(F.contains(tier, F.lit("MED")), "MED")
        .otherwise("LOW")
    )
    short = F.substring(title, 1, 45)
    about = F.when(F.coalesce(condition, F.lit("")) != "", _lines(" · ", F.substring(condition, 1, 20)))
    cut = F.when(F.length(title) > 45, "…").otherwise("")
    return _lines(
        "[", tag, "] ", key.cast("string"), " — ", short, F.coalesce(about, F.lit("")), cut,
        " (", numbers.percent(probability), ")",
    )


def choice_key(label: Column) -> Column:
    """The key inside a display label; null when it has none."""
    after = F.regexp_extract(label, r"(?s)^.*?\] (.*)$", 1)
    return F.nullif(F.trim(F.split(after, " — ", 2)[0]), F.lit(""))
