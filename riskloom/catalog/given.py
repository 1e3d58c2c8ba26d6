"""A small given ensemble of trees, as a model and as SQL, for what must be checkable without a fit."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np

from riskloom import constants as C
from riskloom.catalog.fixtures import sql_scaled
from riskloom.operators.boosting import Trees
from riskloom.operators.calibration import Isotonic
from riskloom.operators.ensembles import GbtModel

#: A node is (feature, cut, left, right) over scaled features, a leaf (log-odds, cover).
FIRST = [
    ("criteria_length", 0.2113, ("enrollment_ratio", -0.1371, (0.31, 210.0), (-0.22, 130.0)), ("phase_encoded", 2.5, (0.45, 90.0), (0.12, 70.0))),
    ("has_placebo", 0.5, (-0.15, 300.0), ("text_complexity", 0.0817, (0.05, 120.0), (0.38, 80.0))),
]
SECOND = [
    ("log_enrollment", 0.4019, ("log_enrollment", -0.6127, (0.52, 60.0), (-0.11, 240.0)), ("has_randomized", 0.5, (-0.33, 110.0), (0.09, 90.0))),
    ("has_expanded_access", 0.5, ("criteria_unique_ratio", 0.1931, (-0.27, 150.0), (0.24, 190.0)), (0.14, 160.0)),
]
MEMBERS = [FIRST, SECOND]
#: Points of the calibration of each member.
CURVES = [([0.30, 0.45, 0.55, 0.70], [0.10, 0.25, 0.50, 0.85]), ([0.35, 0.50, 0.65], [0.20, 0.40, 0.90])]
THRESHOLD = 0.45


def is_leaf(node: tuple) -> bool:
    return len(node) == 2


def cover(node: tuple) -> float:
    return node[1] if is_leaf(node) else cover(node[2]) + cover(node[3])


def trees_of(roots: list[tuple]) -> Trees:
    rows: list[list] = []

    def place(node: tuple, at: int) -> None:
        if is_leaf(node):
            rows[at][1:6] = [0, np.inf, at, *node]
            return
        left = len(rows)
        rows.extend([k, 0, 0.0, 0, 0.0, 0.0, False] for k in (left, left + 1))
        rows[at][1:6] = [C.FEATURES.index(node[0]), node[1], left, 0.0, cover(node)]
        place(node[2], left)
        place(node[3], left + 1)

    for root in roots:
        rows.append([len(rows), 0, 0.0, 0, 0.0, 0.0, True])
        place(root, len(rows) - 1)
    return Trees.of_rows([tuple(r) for r in rows], len(C.FEATURES), 2)


MODEL = GbtModel(tuple(map(trees_of, MEMBERS)), tuple(Isotonic(np.array(a), np.array(v)) for a, v in CURVES))


# --- SQL -------------------------------------------------------------------


def sql_value(node: tuple, known: set[str] | None = None) -> str:
    """The log-odds of a tree, unknown features by the shares of their rows; all are known by default."""
    if is_leaf(node):
        return f"{node[0]}::DOUBLE"
    feature, cut, left, right = node
    if known is None or feature in known:
        return f"(case when {sql_scaled(feature)} <= {cut}::DOUBLE then {sql_value(left, known)} else {sql_value(right, known)} end)"
    share = cover(left) / cover(node)
    return f"({share!r}::DOUBLE * {sql_value(left, known)} + {1 - share!r}::DOUBLE * {sql_value(right, known)})"


def sql_curve(p: str, at: list[float], value: list[float]) -> str:
    arms = [f"when {p} <= {at[0]}::DOUBLE then {value[0]}::DOUBLE"]
    for x, y, u, v in zip(at, value, at[1:], value[1:], strict=False):
        arms.append(f"when {p} <= {u}::DOUBLE then {y}::DOUBLE + ({p} - {x}::DOUBLE) * {(v - y) / (u - x)!r}::DOUBLE")
    return f"(case {' '.join(arms)} else {value[-1]}::DOUBLE end)"


def sql_probability() -> str:
    parts = []
    for roots, (at, value) in zip(MEMBERS, CURVES, strict=True):
        margin = " + ".join(map(sql_value, roots))
        parts.append(sql_curve(f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({margin}))))", at, value))
    return f"(({' + '.join(parts)}) / {float(len(parts))}::DOUBLE)"


def players(node: tuple) -> set[str]:
    return set() if is_leaf(node) else {node[0]} | players(node[2]) | players(node[3])


def sql_effect(feature: str) -> str:
    """The Shapley value of a feature in the mean log-odds of the members, subset by subset."""
    parts = ["0.0::DOUBLE"]
    for root in (root for roots in MEMBERS for root in roots):
        others = sorted(players(root) - {feature})
        if feature not in players(root):
            continue
        whole = len(others) + 1
        for size in range(whole):
            weight = factorial(size) * factorial(whole - size - 1) / factorial(whole) / len(MEMBERS)
            for known in map(set, combinations(others, size)):
                parts.append(f"{weight!r}::DOUBLE * ({sql_value(root, known | {feature})} - {sql_value(root, known)})")
    return f"({' + '.join(parts)})"


def base_value() -> float:
    def mean(node: tuple) -> float:
        return node[0] if is_leaf(node) else (cover(node[2]) * mean(node[2]) + cover(node[3]) * mean(node[3])) / cover(node)

    return sum(mean(root) for roots in MEMBERS for root in roots) / len(MEMBERS)
