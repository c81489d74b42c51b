"""Default scoring pack: weights, multipliers, thresholds and escalation policies."""

from __future__ import annotations

from dataclasses import dataclass, field

# Factor weights. The first five sum to 1.0; the recurrence weight comes on top of them.
WEIGHTS = {
    "model_probability": 0.30,
    "rule_severity": 0.25,
    "barrier_failure": 0.20,
    "critical_hazard": 0.15,
    "critical_activity": 0.10,
    "recurring_pattern": 0.10,
}

# Consequence multipliers and barrier penalties; anything unlisted scores UNLISTED.
UNLISTED = 0.40
HAZARD_MULTIPLIERS = {
    "Electrical Energy": 1.00,
    "Toxic Gas / H2S": 1.00,
    "Fall from Height": 0.95,
    "Fire / Explosion": 1.00,
    "Asphyxiation": 1.00,
    "High Pressure Release": 0.90,
    "Struck-By": 0.85,
    "Caught Between": 0.85,
    "Structural Failure": 0.80,
    "Chemical Exposure": 0.75,
    "Slip / Trip / Fall": 0.30,
}
ACTIVITY_MULTIPLIERS = {
    "Confined Space Entry": 1.00,
    "Hot Work": 0.95,
    "Welding": 0.90,
    "Cutting": 0.90,
    "Working at Height": 0.90,
    "Lifting & Rigging": 0.85,
    "Drilling": 0.85,
    "Maintenance": 0.80,
    "Pipe Fitting": 0.75,
    "Excavation": 0.70,
    "Painting & Blasting": 0.60,
    "Driving & Logistics": 0.55,
    "Inspection & Audit": 0.35,
    "Pre-task Briefing": 0.15,
    "Housekeeping": 0.15,
}
BARRIER_PENALTIES = {
    "Not Verified": 1.00,
    "Failed": 0.95,
    "Absent": 0.90,
    "Unknown": 0.40,
    "Present": 0.05,
}

# Barrier states that count as a compromised barrier.
COMPROMISED = ("Not Verified", "Failed", "Absent")


@dataclass(frozen=True)
class ScoringPack:
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    hazards: dict = field(default_factory=lambda: dict(HAZARD_MULTIPLIERS))
    activities: dict = field(default_factory=lambda: dict(ACTIVITY_MULTIPLIERS))
    barriers: dict = field(default_factory=lambda: dict(BARRIER_PENALTIES))
    unlisted: float = UNLISTED
    # Priority bands and escalation thresholds.
    high: float = 0.65
    medium: float = 0.35
    escalation_margin: float = 0.05
    critical_severity: int = 4
    critical_hazard: float = 0.95
    model_medium: float = 0.60
    model_high: float = 0.85
    escalate_on_critical_rule: bool = True
    escalate_on_critical_barrier: bool = True


DEFAULT_SCORING = ScoringPack()

# Probability assumed from rule severity when no classifier is plugged in.
FALLBACK_CAP = 0.95
FALLBACK_SLOPE = 0.8
FALLBACK_BASE = 0.15
FALLBACK_QUIET = 0.10

# The older two-factor score (rule weight, assumed model confidence) and its bands.
LEGACY_RULE_WEIGHT = 0.65
LEGACY_MODEL_WEIGHT = 0.35
LEGACY_MODEL_CONFIDENCE = 0.30
LEGACY_FLAG_FLOOR = 0.40
LEGACY_BANDS = ((0.80, "CRITICAL"), (0.60, "HIGH"), (0.40, "MEDIUM"), (float("-inf"), "LOW"))

# Wording bands for a probability.
PROBABILITY_LABELS = ((0.80, "HIGH"), (0.50, "MEDIUM"), (0.30, "LOW"), (float("-inf"), "VERY_LOW"))
