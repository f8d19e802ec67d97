"""Which research views are on: a configuration of switches, not data."""

from __future__ import annotations

# The views' ids, all of them on.
FEATURES = ("comparisonWorkspace", "companionWitnesses", "parallelPassageDetection", "variantViewer", "citationBuilder", "researchCollections", "passageBacklinks", "readingPlans", "concordance", "provenanceInspector", "researchBundleExport", "localAiStudyAssistant")


def switches(off: tuple[str, ...] = ()) -> dict[str, bool]:
    """Every view's switch, with the named ones off."""
    unknown = set(off) - set(FEATURES)
    if unknown:
        raise ValueError(f"no such view: {sorted(unknown)}")
    return {name: name not in off for name in FEATURES}


def any_on(states: dict[str, bool]) -> bool:
    return any(states.get(name, False) for name in FEATURES)
