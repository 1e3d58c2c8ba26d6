"""Additive contributions of features to scores, and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import numbers
from riskloom.functions.text import concat_nonempty
from riskloom.operators import boosting
from riskloom.operators.boosting import Trees
from riskloom.operators.ensembles import number_array
from riskloom.operators.joins import match_patterns


# --- linear scores ---------------------------------------------------------


def linear_contributions(
    coefficients: Mapping[str, float], means: Mapping[str, float] | None = None
) -> dict[str, Column]:
    """Per feature: weight times distance from its mean."""
    means = means or {}
    return {
        name: F.lit(float(weight)) * (F.col(name).cast("double") - F.lit(float(means.get(name, 0.0))))
        for name, weight in coefficients.items()
    }


def contributions_long(rows: DataFrame, key: str, contributions: Mapping[str, Column]) -> DataFrame:
    """One row per record and feature: (key, feature, shap)."""
    items = F.array(
        *[F.struct(F.lit(n).alias("feature"), c.alias("shap")) for n, c in contributions.items()]
    )
    return rows.select(key, F.explode(items).alias("_i")).select(key, "_i.*")


# --- tree ensembles --------------------------------------------------------

#: Leaves below more cuts than these are paid row by row, not by a table of the sides of the cuts.
MOST_CUTS = 8


@dataclass(frozen=True)
class Leaves:
    """Leaf paths of an ensemble, padded to one width.

    Per leaf and path feature: feature number (-1 pads), the half-open interval
    ``low < x <= high`` the path demands, and the share of rows that follow it.
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    base: float
    n_features: int


def tree_leaves(models: Sequence[Trees]) -> Leaves:
    """Leaf paths of the mean margin of several models, in log-odds.

    Their number is bounded by the trees and their depth. The hessian sums of
    the train rows are the cover.
    """
    paths = [(path, value / len(models)) for model in models for root in model.roots for path, value, _ in _walk(model, int(root))]
    return _leaves(paths, models[0].n_features)


def _leaves(paths: Sequence[tuple[dict, float]], n_features: int) -> Leaves:
    width = max((len(p) for p, _ in paths), default=0)
    shape = (len(paths), max(width, 1))
    feature, share = np.full(shape, -1), np.ones(shape)
    low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
    for i, (path, _) in enumerate(paths):
        for j, (f, (lo, hi, r)) in enumerate(path.items()):
            feature[i, j], low[i, j], high[i, j], share[i, j] = f, lo, hi, r
    value = np.array([v for _, v in paths])
    base = float((value * share.prod(axis=1)).sum())
    return Leaves(value, feature, low, high, share, base, n_features)


@dataclass(frozen=True)
class Group:
    """Neighbouring leaves of a tree: the cuts above them, and what each feature gets by the sides of these cuts.

    Bit k of a row of ``table`` tells that a value is above cut k; a column
    belongs to one of the features in ``paid``.
    """

    feature: np.ndarray
    cut: np.ndarray
    paid: np.ndarray
    table: np.ndarray


def leaf_groups(models: Sequence[Trees]) -> tuple[list[Group], Leaves | None]:
    """The leaves of the mean margin of several models in groups, and those below too many cuts for a table."""
    groups, rest, n = [], [], models[0].n_features
    for model in models:
        for root in model.roots:
            near: dict[int, list[tuple]] = {}
            for path, value, trail in _walk(model, int(root)):
                if trail:
                    near.setdefault(trail[-2:][0][0], []).append((path, value / len(models), trail))
            for found in near.values():
                nodes = sorted({node for *_, trail in found for node, _ in trail})
                if len(nodes) > MOST_CUTS:
                    rest += [(path, value) for path, value, _ in found]
                    continue
                leaves, codes = _leaves([(path, value) for path, value, _ in found], n), np.arange(1 << len(nodes))
                met = [np.ones((len(codes), len(found)), bool) for _ in range(leaves.feature.shape[1])]
                for i, (path, _, trail) in enumerate(found):
                    for node, right in trail:
                        met[list(path).index(int(model.feature[node]))][:, i] &= (codes >> nodes.index(node) & 1) == right
                paid = np.unique(model.feature[nodes])
                table = np.asfortranarray(paid_by_leaves(met, leaves)[:, paid])
                groups.append(Group(model.feature[nodes], model.cut[nodes], paid, table))
    return groups, _leaves(rest, n) if rest else None


def _walk(model: Trees, root: int) -> Iterator[tuple[dict, float, list[tuple[int, int]]]]:
    """Leaves of one tree, each with interval and row share per path feature, and the cuts above it with the side taken."""
    pending = [(root, {}, [])]
    while pending:
        node, path, trail = pending.pop()
        left = int(model.left[node])
        if left == node:
            yield path, float(model.value[node]), trail
            continue
        f, cut = int(model.feature[node]), float(model.cut[node])
        lo, hi, r = path.get(f, (-np.inf, np.inf, 1.0))
        whole = model.cover[left] + model.cover[left + 1]
        for child, bounds in ((left, (lo, min(hi, cut))), (left + 1, (max(lo, cut), hi))):
            part = model.cover[child] / whole if whole > 0 else 0.5
            pending.append((child, {**path, f: (*bounds, r * part)}, [*trail, (node, child - left)]))


def attribute_batch(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    """Contributions of a batch of rows: (rows, features)."""
    count, width = leaves.feature.shape
    source = np.where(leaves.feature < 0, 0, leaves.feature)
    out = np.zeros((len(x), leaves.n_features))
    step = max(1, 1_000_000 // max(count, 1))
    for start in range(0, len(x), step):
        part = x[start : start + step]
        seen = [np.nan_to_num(part[:, source[:, j]], nan=-np.inf, neginf=-np.inf, posinf=np.inf) for j in range(width)]
        # What is not a number goes left: it is above no cut, and below all.
        met = [((s > leaves.low[:, j]) | (leaves.low[:, j] == -np.inf)) & (s <= leaves.high[:, j]) for j, s in enumerate(seen)]
        out[start : start + step] = paid_by_leaves(met, leaves)
    return out


def paid_by_leaves(met: Sequence[np.ndarray], leaves: Leaves) -> np.ndarray:
    """Contributions (rows, features) where ``met[j]`` tells of each row and leaf whether demand j is met.

    A leaf pays its value to a row that meets all its demands; an unknown demand
    counts with its row share r, a known one with o, 1 if it is met and else 0.
    The Shapley value of demand i is value (o_i - r_i) times the integral over
    t from 0 to 1 of the product of the other demands' r + t (o - r). That is a
    polynomial of a degree below the number of demands, for which Gauss-Legendre
    points of half that number are exact. So a leaf costs the square of its
    path's length, not its subsets. Padding (always met, share 1) earns nothing.
    """
    count, width = leaves.feature.shape
    shape = met[0].shape
    points, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    real = leaves.feature >= 0
    gap = [m - leaves.share[:, j] for j, m in enumerate(met)]
    gained = [np.zeros(shape) for _ in range(width)]
    for t, weight in zip(points, weights, strict=True):
        terms = [leaves.share[:, j] + t * gap[j] for j in range(width)]
        after = [np.full(shape, weight)]
        for j in range(width - 1, 0, -1):
            after.append(after[-1] * terms[j])
        before = np.ones(shape)
        for j in range(width):
            gained[j] += before * after[width - 1 - j]
            before = before * terms[j]
    out = np.zeros((shape[0], leaves.n_features))
    for j in range(width):
        onehot = np.zeros((count, leaves.n_features))
        onehot[np.flatnonzero(real[:, j]), leaves.feature[real[:, j], j]] = 1.0
        out += (gained[j] * gap[j] * leaves.value) @ onehot
    return out


def attribute_groups(x: np.ndarray, groups: Sequence[Group], n_features: int) -> np.ndarray:
    """Contributions of a batch of rows by the tables of all groups: (rows, features)."""
    out = np.zeros((n_features, len(x)))
    columns = np.ascontiguousarray(np.nan_to_num(x, nan=-np.inf, neginf=-np.inf, posinf=np.inf).T)
    for group in groups:
        code = np.zeros(len(x), np.uint8)
        for k, (f, cut) in enumerate(zip(group.feature, group.cut, strict=True)):
            code |= (columns[f] > cut).view(np.uint8) << np.uint8(k)
        place = code.astype(np.intp)
        for k, f in enumerate(group.paid):
            out[f] += group.table[:, k][place]
    return out.T


def tree_attributions(matrix: DataFrame, models: Sequence[Trees], vector: str = "features") -> DataFrame:
    """Exact Shapley values of the mean log-odds of tree models, of any depth.

    Adds ``phi`` (one value per feature), ``base_value`` and ``log_odds`` (their
    sum). Arrow batches go through a small numpy kernel; nothing is shuffled and
    only the tables and leaf paths travel to the tasks.
    """
    base, width = tree_leaves(models).base, models[0].n_features
    groups, rest = leaf_groups(models)

    def explain(vectors: pa.Array) -> pa.Array:
        x = boosting.matrix_of(vectors, width)
        phi = attribute_groups(x, groups, width)
        if rest is not None:
            phi = phi + attribute_batch(x, rest)
        offsets = np.arange(len(phi) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(phi.ravel()))

    found = F.arrow_udf(explain, "array<double>")(number_array(matrix, vector))
    total = F.aggregate("phi", F.lit(base), lambda a, b: a + b)
    explained = matrix.withColumn("phi", found).drop(vector)
    return explained.withColumn("base_value", F.lit(base)).withColumn("log_odds", total)


# --- sections and summaries ------------------------------------------------


def section_members(
    names: Sequence[str], sections: Mapping[str, Sequence[str]], other: str
) -> list[tuple[str, list[str], bool]]:
    """(section, features, whether it is shown only if its sum is not negligible)."""
    matched = match_patterns(names, sections)
    assigned = {n for hits in matched.values() for n in hits}
    groups = [(s, list(hits), False) for s, hits in matched.items() if hits]
    rest = [n for n in names if n not in assigned]
    return [*groups, (other, rest, True)] if rest else groups


def section_sum(contributions: Mapping[str, Column], members: Sequence[str]) -> Column:
    total = contributions[members[0]]
    for name in members[1:]:
        total = total + contributions[name]
    return total


def section_attributions(
    contributions: Mapping[str, Column],
    sections: Mapping[str, Sequence[str]] = C.SECTION_FEATURES,
    labels: Mapping[str, str] = C.FEATURE_LABELS,
    other: str = C.OTHER_SECTION,
    rounded: Callable[[str, Column], Column] = lambda name, value: numbers.half_even(value, 4),
    sums: Mapping[str, Column] | None = None,
) -> Column:
    """Contributions summed by section, the strongest section first.

    A record's features are its own columns, so this is one projection: no
    long table, no shuffle. Features in no section make up the ``other`` one,
    shown when its sum is not negligible. ``rounded`` gives the shown value of
    a feature's contribution or, by its name, of a section's sum; both are
    named more than once, so :func:`with_sections` makes columns of them.
    """
    built = []
    for ordinal, (section, members, optional) in enumerate(section_members(list(contributions), sections, other)):
        total = sums[section] if sums else section_sum(contributions, members)
        shown = {n: rounded(n, contributions[n]) for n in members}
        features = [
            F.struct(
                (-F.abs(shown[n])).alias("_rank"),
                F.lit(i).alias("_ordinal"),
                F.lit(labels.get(n, n)).alias("name"),
                F.lit(n).alias("raw_name"),
                shown[n].alias("shap"),
            )
            for i, n in enumerate(members)
        ]
        ordered = F.transform(
            F.sort_array(F.array(*features)),
            lambda f: F.struct(
                f["name"].alias("name"), f["raw_name"].alias("raw_name"), f["shap"].alias("shap")
            ),
        )
        whole = rounded(section, total)
        entry = F.struct(
            (-F.abs(whole)).alias("_rank"),
            F.lit(ordinal).alias("_ordinal"),
            F.lit(section).alias("section"),
            whole.alias("contribution"),
            F.abs(whole).alias("abs_contribution"),
            F.when(total >= 0, "increases risk").otherwise("reduces risk").alias("direction"),
            ordered.alias("features"),
        )
        built.append(F.when(F.abs(total) > 1e-6, entry) if optional else entry)
    return F.transform(
        F.sort_array(F.filter(F.array(*built), lambda s: s.isNotNull())),
        lambda s: F.struct(
            *[
                s[c].alias(c)
                for c in ("section", "contribution", "abs_contribution", "direction", "features")
            ]
        ),
    )


def with_sections(
    rows: DataFrame,
    contributions: Mapping[str, Column],
    output: str = "section_attributions",
    sections: Mapping[str, Sequence[str]] = C.SECTION_FEATURES,
    other: str = C.OTHER_SECTION,
    **options,
) -> DataFrame:
    """Add the section attributions of a record.

    Contributions, then sums, then what is shown of both become columns of
    their own, so that each is computed once however often it is mentioned.
    """
    staged = rows.withColumns({f"_phi_{n}": c for n, c in contributions.items()})
    phi = {n: F.col(f"_phi_{n}") for n in contributions}
    members = {s: m for s, m, _ in section_members(list(contributions), sections, other)}
    staged = staged.withColumns({f"_sum_{s}": section_sum(phi, m) for s, m in members.items()})
    sums = {s: F.col(f"`_sum_{s}`") for s in members}
    staged = staged.withColumns({f"_shown_{n}": numbers.half_even(c, 4) for n, c in {**phi, **sums}.items()})
    built = section_attributions(
        phi, sections, other=other, rounded=lambda name, _: F.col(f"`_shown_{name}`"), sums=sums, **options
    )
    return staged.withColumn(output, built).drop(*[c for c in staged.columns if c not in rows.columns])


def top_risk_sections(sections: Column, n: int = 3) -> Column:
    return F.slice(F.filter(sections, lambda s: s["contribution"] > 0), 1, n)


def top_protective_sections(sections: Column, n: int = 2) -> Column:
    return F.slice(F.filter(sections, lambda s: s["contribution"] < 0), 1, n)


def nl_summary(sections: Column, tier: Column, probability: Column) -> Column:
    """Two or three sentences: headline, strongest feature, first protective section."""
    risks = F.filter(sections, lambda s: s["contribution"] > 0)
    guards = F.filter(sections, lambda s: s["contribution"] < 0)
    section = lambda found, i: F.lower(F.get(found, F.lit(i))["section"])
    opening = F.concat(
        F.lit("This trial is predicted "), tier, F.lit(" ("), numbers.percent(probability), F.lit(" probability) ")
    )
    headline = F.concat(
        opening,
        F.when(
            F.size(risks) >= 2,
            F.concat(
                F.lit("primarily because the "),
                section(risks, 0),
                F.lit(" and "),
                section(risks, 1),
                F.lit(" are both strong predictors of early termination in historical trials."),
            ),
        )
        .when(
            F.size(risks) == 1,
            F.concat(
                F.lit("primarily due to concerns with the "),
                section(risks, 0),
                F.lit(", a strong predictor of early termination."),
            ),
        )
        .otherwise("with no single dominant risk factor."),
    )
    strongest = F.get(F.get(risks, F.lit(0))["features"], F.lit(0))
    signal = F.concat(
        F.lit('The strongest individual signal is "'),
        strongest["name"],
        F.lit('" (SHAP contribution: '),
        numbers.fixed(strongest["shap"], 2, signed=True),
        F.lit(")."),
    )
    offset = F.concat(F.lit("However, the "), section(guards, 0), F.lit(" partially offset this risk."))
    return concat_nonempty([headline, signal, offset], " ")


def explain_batch(
    scored: DataFrame,
    models: Sequence[Trees],
    features: Sequence[str] = tuple(C.FEATURES),
    vector: str = "features",
) -> DataFrame:
    """Scored records with sections, summary and base value, one row per record.

    The attribution keeps the columns of a record, so nothing is joined back and
    copies of a key stay apart.
    """
    phi = {name: F.col("phi")[i] for i, name in enumerate(features)}
    explained = with_sections(tree_attributions(scored, models, vector), phi)
    summary = nl_summary(F.col("section_attributions"), F.col("risk_tier"), F.col("probability"))
    return (
        explained.withColumn("base_value", numbers.half_even(F.col("base_value"), 4))
        .withColumn("natural_language_summary", summary)
        .drop("phi", "log_odds")
    )
