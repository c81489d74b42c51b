"""Wording of explanations, alerts, badges, recommendations and summaries.

Braces name the value that is filled in.
"""

# Signal lines.
SIGNALS = {
    "activity": "{activity} activity detected",
    "hazard": "{hazard} hazard detected",
    "barrier_and_status": "{barrier} status: {status}",
    "status_only": "Barrier status: {status}",
    "barrier_only": "Barrier identified: {barrier}",
    "probability_high": "Elevated ML precursor probability ({pct})",
    "probability_medium": "Moderate ML precursor probability ({pct})",
    "probability_low": "Low ML precursor probability ({pct})",
    "recurrence": "Recurring risk pattern detected (similarity score: {recurrence})",
    "evidence": "Physical evidence indicators: '{evidence}'",
}

# Rule line and barrier line.
RULE_LINE = "{rule} (Severity {label})"
BARRIER_LINES = {
    "barrier_and_status": "{barrier} ({status})",
    "status_only": "{status}",
    "barrier_only": "{barrier} (Status Unspecified)",
}

# Reasons for the priority.
ESCALATION_RULE = "Elevated to HIGH: CRITICAL safety rule (severity 4/4) triggered."
ESCALATION_BARRIER = (
    "Elevated to HIGH: Critical hazard ({hazard}) detected with compromised barrier ({status})."
)
REASONS = {
    "high_rules_and_probability": "Prioritized as HIGH due to elevated precursor probability ({pct}) combined with life-saving safety rule triggers.",
    "high_rules": "Prioritized as HIGH due to deterministic life-saving safety rule triggers.",
    "high_barrier": "Prioritized as HIGH due to compromised critical barrier ({status}) under high-consequence operating conditions.",
    "high_probability": "Prioritized as HIGH based on strong ML precursor indicators ({pct}).",
    "medium_rules": "Prioritized as MEDIUM due to advisory safety rule triggers requiring supervisor review.",
    "medium_probability": "Prioritized as MEDIUM due to moderate precursor probability ({pct}).",
    "medium_hazard": "Prioritized as MEDIUM due to identified hazard ({hazard}) without critical barrier failure.",
    "medium_other": "Prioritized as MEDIUM for scheduled HSE review and supervisor follow-up.",
    "low": "Classified as LOW priority for routine logging: no critical safety rules triggered and low precursor probability ({pct}).",
}

# Fixed values: "why" lines per priority.
WHY_HIGH = {
    "activity": "{activity} activity detected",
    "hazard": "{hazard} hazard detected",
    "barrier_and_status": "{barrier} {status}",
    "status_only": "Barrier {status}",
    "barrier_only": "{barrier} barrier identified",
    "rule": "{rule} safety rule triggered",
    "probability": "Elevated SIF precursor probability ({pct})",
    "recurrence": "Recurring risk pattern detected (similarity: {recurrence})",
    "override": "Safety override applied: {reason}",
    "nothing": "High precursor indicators detected ({pct})",
}
WHY_MEDIUM = {
    "activity": "{activity} activity detected",
    "hazard": "{hazard} hazard detected",
    "barrier_and_status": "{barrier} status: {status}",
    "barrier_only": "{barrier} barrier observed",
    "rule": "{rule} rule triggered",
    "no_rule": "No critical life-saving rule violations",
    "probability": "Moderate precursor probability ({pct})",
    "recurrence": "Elevated recurrence pattern observed ({recurrence})",
}
WHY_LOW = {
    "activity": "{activity} activity observed under standard conditions",
    "hazard": "Routine operational condition ({hazard})",
    "barrier_sound": "{barrier} barrier confirmed {status}",
    "controls": "Standard operational controls in place",
    "no_rule": "No life-saving safety rules triggered",
    "probability": "Low precursor probability ({pct})",
}
SOUND_STATES = ("verified", "intact", "present")

# Layout of the full explanation and its driver sentences.
HEADLINE = "Priority: {priority}\n\nWhy:\n- {why}"
DRIVERS = {
    "probability_high": "Model identified strong SIF precursor signals (probability: {pct})",
    "probability_medium": "Model identified moderate precursor indicators (probability: {pct})",
    "probability_low": "Model precursor probability is low ({pct})",
    "rules_severe": "Deterministic safety rules triggered: {rules} (severity: {label})",
    "rules_other": "Safety rules matched: {rules}",
    "no_rules": "No deterministic life-saving rules were triggered",
    "barrier": "Safety barrier issue: {barrier} is {status}",
    "barrier_hazard": " involving {hazard}",
    "barrier_activity": " during {activity}",
    "hazard": "Primary hazard observed: {hazard}",
    "recurrence": "Elevated recurring risk pattern detected (similarity score: {recurrence})",
    "override": "Safety policy override: {reason}",
}
DRIVER_LINE = "Key drivers: {drivers}."
EVIDENCE_LINE = "Trigger evidence: '{evidence}'."
CLOSING_LINE = "Note: This score prioritizes HSE review attention and does not predict accident occurrence."

# Statements that would contradict a priority.
CONTRADICTIONS = {
    "HIGH": ("low precursor probability", "routine operational condition",
             "standard operational controls in place", "no life-saving safety rules triggered"),
    "LOW": ("safety rule triggered", "elevated sif precursor probability",
            "high precursor indicators", "critical barrier"),
}
RULE_CLAIM = "safety rule triggered"

# Thresholds used by the wording.
STRONG_PROBABILITY = 0.70
MODERATE_PROBABILITY = 0.40
RULE_REASON_PROBABILITY = 0.65
RECURRENCE_SHOWN_FROM = 0.50

# Explanation of the older two-factor score.
LEGACY_NOTHING = (
    "No SIF precursor signals were detected by the rule engine in this {words}-word report. Priority "
    "assigned as LOW. Note: ML classification (Phase 3) may detect additional risks."
)
LEGACY_FIRED = (
    "Rule engine detected {count} SIF precursor rule(s): {rules}. Triggered categories: {categories}. "
    "Overall rule severity: {label}. Composite priority score: {score}. ML confidence is a placeholder "
    "— DistilBERT will replace this in Phase 3."
)

# Workflow states and their badges.
REVIEW_REQUIRED = "HSE_REVIEW_REQUIRED"
MONITORING = "ROUTINE_MONITORING"
CONTROLLED = "CONTROLLED"
BADGES = {
    "HSE_REVIEW_REQUIRED": "HIGH PRIORITY → HSE REVIEW REQUIRED",
    "ROUTINE_MONITORING": "MEDIUM PRIORITY → ROUTINE MONITORING",
    "CONTROLLED": "LOW PRIORITY → CONTROLLED",
    "REVIEWED_CONFIRMED": "REVIEWED & CONFIRMED BY HSE",
    "REVIEWED_CORRECTED": "REVIEWED & CORRECTED BY HSE",
    "REVIEWED_REJECTED": "DE-ESCALATED / REJECTED BY HSE",
}

# Alert and action texts.
ALERT_TITLE = "HIGH PRIORITY → HSE REVIEW REQUIRED"
ALERT_MESSAGE = (
    "Automated SIF Triage: Report {report} classified as HIGH priority ({pct} SIF probability). "
    "Hazard: {hazard}. Barrier: {barrier} ({status}). Immediate HSE officer verification required."
)
ACTION_TITLE = "Investigate and verify {barrier} controls for {hazard}"
AUTOMATION_ACTOR = "TRIAGE_AUTOMATION"

# Pattern names, advice and summary.
CLUSTER_NAME = "{barrier} — {status}"
CLUSTER_ADVICE = "Perform site-wide audit on {barrier} verification procedures and defense compliance."
PATTERN_SUMMARY = (
    "Analysis of {total} safety observations indicates prominent risk clusters in {hazard} and {barrier}."
)
PATTERN_SUMMARY_EMPTY = "No reports currently loaded."
SUMMARY_HAZARD_DEFAULT = "high-energy operations"
SUMMARY_BARRIER_DEFAULT = "control verification"
RECOMMENDATIONS = (
    # (words looked for in the hazard, words looked for in the barrier failure, advice), tried in order
    (("electric",), ("isolation",),
     "Mandate immediate verification of Lockout/Tagout (LOTO) zero-energy isolation procedures and audit electrical permit compliance across all operating units."),
    (("gas", "toxic"), ("confined",),
     "Issue immediate site safety bulletin requiring continuous 4-gas atmospheric monitoring and dedicated standby observers for all confined vessel entries."),
    (("height",), ("fall",),
     "Initiate comprehensive inspection of scaffolding tags, 100% tie-off compliance, and harness inspection logs prior to work at elevation."),
    (("struck", "lifting"), ("rigging",),
     "Establish physical exclusion zone barriers around active crane swings and verify lifting supervisor sign-offs on all rigging plans."),
)
RECOMMENDATION_OTHER = (
    "Initiate targeted HSE operational audit for {activity} focusing on {barrier} to eliminate recurring precursor vulnerability."
)
COMMON_DEFAULTS = {
    "activity": "High-Energy Operations",
    "hazard": "Physical Energy",
    "barrier": "Control Verification Deficient",
    "status": "Compromised",
}
