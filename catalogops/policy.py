"""Numeric policy of the content matcher."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Quality labels a confidence can carry.
CLEAR = "clear"
DECISIVE = "decisive_low_similarity"
AMBIGUOUS = "ambiguous"
CONTESTED = "contested"


@dataclass(frozen=True)
class MatchPolicy:
    min_similarity: float = 0.58
    clear_margin: float = 0.05
    review_below: float = 0.70
    auto_accept: float = 0.80
    clear_confidence: float = 0.85

    def normalized(self) -> "MatchPolicy":
        """Values outside (0, 1) fall back to the default; so does an inconsistent ladder."""
        base = MatchPolicy()
        bad = {f.name: getattr(base, f.name) for f in fields(self) if not 0 < getattr(self, f.name) < 1}
        out = replace(self, **bad)
        if not out.review_below < out.auto_accept <= out.clear_confidence:
            out = replace(out, review_below=base.review_below, auto_accept=base.auto_accept,
                          clear_confidence=base.clear_confidence)
        return out
