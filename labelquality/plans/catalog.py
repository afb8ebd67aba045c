"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401  (importing a module registers its queries)
    q_agreement,
    q_calibration,
    q_hard,
    q_responses,
    q_sampling,
    q_sources,
    q_text,
    q_trust,
    q_uncertainty,
    registry,
)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
