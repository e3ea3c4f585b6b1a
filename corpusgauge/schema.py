"""Keys, metric lists and other fixed values shared by the operators."""

from __future__ import annotations

DOC_KEYS = ("category", "topic", "system")
BASELINE = "pdfs"

# Metric names, their facet and their scale.
FACET_METRICS = {
    "outline": ["Outline", "Outline_structure"],
    "content": ["Coverage", "Structure", "Relevance", "Language", "Criticalness", "Faithfulness"],
    "reference": ["Reference", "Reference_quality"],
}
METRICS = [m for facet in ("outline", "content", "reference") for m in FACET_METRICS[facet]]
RATIO_METRICS = ["Outline_structure", "Faithfulness", "Reference_quality"]
CONTENT_CRITERIA = ["Coverage", "Structure", "Relevance", "Language", "Criticalness"]
DENSITIES = [
    "Images_density", "Equations_density", "Tables_density", "Citations_density", "Claim_density",
]

# Metrics whose zeros stand for "missing".
ZERO_FILLED_METRICS = [
    "Outline", "Outline_coverage", "Outline_structure", "Outline_no", "Outline_density",
    "Reference", "Reference_density", "Reference_quality", "Reference_no",
    "Coverage", "Structure", "Relevance", "Language", "Criticalness", "Faithfulness",
    "Images_density", "Equations_density", "Tables_density",
    "Citations_density", "Sentence_no", "Claim_density",
    "Outline_domain", "Reference_domain",
    "Coverage_domain", "Structure_domain", "Relevance_domain", "Language_domain",
    "Criticalness_domain",
]

TOP_ITEMS = {"outline": 5, "content": 5, "reference": 20}


def facet_of(metric: str) -> str:
    """The facet whose similarity applies to ``metric``."""
    for facet, names in FACET_METRICS.items():
        if metric in names:
            return facet
    raise KeyError(metric)
