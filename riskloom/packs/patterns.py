"""Default linguistic patterns for spans whose wording varies (activities, equipment, places, barrier state)."""

from __future__ import annotations

# Activity phrases and the activity each stands for. The span is the whole
# phrase, its surface text the first group when the phrase has one. The leading keywords only say
# which texts need searching: a text without any of them cannot match.
ACTIVITY_PATTERNS = (
    (("maintenance",), r"\b(maintenance)\s+(?:started|commenced|was\s+in\s+progress|began|technician)\b", "Maintenance"),
    (("welding",), r"\b(welding)\s+(?:operation|was|activity|started|commenced)\b", "Welding"),
    (("cutting",), r"\b(cutting)\s+(?:operation|commenced|started|activity)\b", "Cutting"),
    (("lift",), r"\b(crane\s+lift|lifting)\s+(?:was\s+in\s+progress|operation|activity)\b", "Lifting & Rigging"),
    (("entered",), r"\b(?:technician|worker)\s+entered\s+(confined\s+space|storage\s+tank|vessel)\b",
     "Confined Space Entry"),
    (("height",), r"\b(?:working|found\s+working)\s+at\s+height\b", "Working at Height"),
    (("inspection",), r"\b(?:routine|pipeline|housekeeping)\s+(inspection)\b", "Inspection & Audit"),
    (("offloading",), r"\b(offloading)\s+of\s+chemical\s+drums\b", "Lifting & Rigging"),
    (("phone",), r"\b(?:worker|operator)\s+observed\s+using\s+mobile\s+phone\s+while\s+(driving|operating\s+a\s+vehicle)\b",
     "Driving & Logistics"),
    (("toolbox",), r"\b(toolbox\s+meeting)\s+was\s+conducted\b", "Pre-task Briefing"),
    (("paint",), r"\b(painting|painter)\s+(?:reported|was)\b", "Painting & Blasting"),
    (("h2s",), r"\b(h2s\s+alarm)\s+was\s+triggered.*?(evacuated)\b", "Emergency Response"),
)
ACTIVITY_CONFIDENCE = 0.88

# Equipment and location phrases; span and text are the first group, which
# always ends where the phrase ends.
EQUIPMENT_PATTERNS = (
    (("equipment", "rig", "scaffold", "panel", "crane", "pump", "valve", "drums", "separator", "grinder"),
     r"\b(?:on|with|using|servicing|repairing|inspecting|operating|near)\s+([a-z0-9_-]+\s+(?:equipment|rig|scaffold|panel|crane|pump|valve|drums|separator|grinder))\b"),
    (("energized", "circuit", "panel", "rig", "scaffold", "crane", "valve", "detector", "drums", "grinder",
      "forklift", "pump"),
     r"\b(energized\s+equipment|live\s+circuit|motor\s+control\s+panel|electrical\s+panel|drilling\s+rig|\d+-metre\s+scaffold|crane\s+load|pressure\s+relief\s+valve|isolation\s+valve|gas\s+detector|chemical\s+drums|angle\s+grinder|forklift|crane|pump|scaffold)\b"),
)
EQUIPMENT_CONFIDENCE = 0.85
LOCATION_PATTERNS = (
    (("tank", "well", "pump", "process", "flare", "derrick", "pipe", "chemical", "storage", "office", "site",
      "separator"),
     r"\b(?:in|at|inside|near|into)\s+(?:the\s+)?([a-z0-9_\s-]{3,25}?(?:tank\s+farm|storage\s+tank|wellhead|well\s+site|pump\s+room|pump\s+station|process\s+area|flare\s+stack|derrick|pipe\s+yard|chemical\s+store|storage\s+room|office\s+block|site\s+road|separator\s+station|separator\s+vessel))\b"),
)
LOCATION_CONFIDENCE = 0.82

# Wording that tells a barrier's state, strongest state first.
STATUS_WORDS = (
    ("Not Verified", ("without verified", "not verified", "unverified", "no verified",
                      "lacking verification", "verification missing", "not confirmed")),
    ("Absent", ("without wearing", "without completing", "without clearing", "without providing",
                "without obtaining", "without a", "without any", "without", "not applied", "not used",
                "not worn", "not provided", "not performed", "not done", "not obtained", "not closed",
                "not locked", "not set up", "not enforced", "not de-energized", "missing", "absent",
                "no attendant", "no barricade", "no harness", "no permit", "no gas test", "no lock",
                "no spotter", "no guarding", "no")),
    ("Failed", ("failed", "compromised", "broken", "cracked", "inadequate", "defective", "bypassed",
                "damaged", "unsecured")),
    ("Present", ("verified", "in place", "applied", "completed", "performed", "present", "functional",
                 "active", "enforced", "signed off", "signed", "provided", "operated throughout",
                 "satisfactory")),
)

# Barrier nouns (most specific wording first within a barrier) and the barrier each names.
BARRIER_NOUNS = (
    ("Isolation", ("isolation",)),
    ("Isolation", ("lockout tagout", "loto", "lockout", "tagout")),
    ("Gas Testing", ("gas testing", "gas test", "atmospheric testing", "atmospheric monitoring",
                     "gas clearance")),
    ("Fall Protection", ("fall protection", "safety harness", "harness", "guardrail", "safety net")),
    ("Hot Work Permit", ("hot work permit", "entry permit", "work permit", "permit")),
    ("Fire Watch", ("fire watch",)),
    ("Exclusion Zone", ("exclusion zone", "barricade")),
    ("Machine Guarding", ("machine guarding", "guarding", "protective guard")),
    ("Ventilation", ("ventilation",)),
    ("Spotter", ("spotter", "attendant")),
    ("PPE", ("ppe", "hard hat", "safety glasses")),
)

# Words allowed between state and barrier, and confidences by state and order.
PREFIX_FILLERS = ("completing", "wearing", "performing", "having", "a", "any")
POSTFIX_VERBS = ("was", "is", "had been")
UNVERIFIED_PREFIX_CONFIDENCE = 0.94
PREFIX_CONFIDENCE = 0.89
POSTFIX_CONFIDENCE = 0.90

# How far apart (in characters) spans may start to share a state or reinforce each other.
STATUS_REACH = 30
REINFORCE_REACH = 15
REINFORCE_BONUS = 0.06
CONFIDENCE_CEILING = 0.98

# Keyword tests on the text around a barrier, tried in order; and the window size.
WINDOW_CHARS = 40
WINDOW_TESTS = (
    ("Not Verified", ("without verified", "not verified")),
    ("Absent", ("without", "absent", "missing", "no ", "not applied", "not used", "not worn",
                "not performed")),
    ("Failed", ("failed", "cracked", "broken", "defective", "bypassed")),
    ("Present", ("verified", "in place", "applied", "completed", "functional", "present", "enforced")),
)

# Equipment assumed when only this phrase is present.
EQUIPMENT_FALLBACK = "energized equipment"
EQUIPMENT_FALLBACK_CONFIDENCE = 0.85
