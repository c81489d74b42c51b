"""Default rule pack: which phrases signal which serious-incident precursor.

A pack is plain data; callers may pass their own list of :class:`Rule`.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    severity: int
    signals: tuple[str, ...]
    explanation: str
    conditions: tuple[str, ...] = field(default=())
    reference: str = ""


# Rule ids, names, categories, severities and signal phrases.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "RULE_001", "Energy Isolation Failure", "Energy Isolation", 4,
        ("loto not applied", "loto not followed", "lockout not applied", "tagout not applied",
         "lockout tagout not", "isolation not verified", "energy not isolated", "not de-energized",
         "energized equipment", "live wire", "live circuit", "working on live", "breaker not locked",
         "energy source not", "isolation failure", "loto not performed", "no loto", "no lockout",
         "no tagout", "without isolation", "energy isolation"),
        "Work began while stored or live energy could still be released onto people.",
        ("live or stored energy within reach", "lockout or tagout step skipped", "isolation left unproven"),
        "OSHA 29 CFR 1910.147",
    ),
    Rule(
        "RULE_002", "Confined Space Entry Without Controls", "Confined Space", 4,
        ("confined space", "gas testing not performed", "gas testing absent", "gas test not done",
         "gas test absent", "no gas test", "atmospheric testing not performed",
         "atmospheric testing absent", "atmospheric test absent", "atmospheric monitoring absent",
         "permit not obtained", "permit missing", "permit absent", "without permit", "no permit",
         "no attendant", "attendant absent", "no rescue plan", "without standby", "entry without",
         "manhole", "tank entry", "vessel entry"),
        "Someone may enter an enclosed space whose air, permit or standby cover is not assured.",
        ("entry into an enclosed space", "air not tested", "permit or standby missing"),
        "OSHA 29 CFR 1910.146",
    ),
    Rule(
        "RULE_003", "Working at Height Without Fall Protection", "Working at Height", 3,
        ("working at height", "work at height", "fall protection absent", "fall protection not used",
         "fall protection missing", "fall protection not provided", "harness not used",
         "without harness", "no harness", "harness absent", "not wearing harness", "harness not worn",
         "guardrail missing", "guardrail absent", "no guardrail", "no safety net", "unprotected edge",
         "ladder unsafe", "elevated work", "working at elevation", "roof work", "scaffold work",
         "fall hazard"),
        "A person could fall because edge or personal fall protection is not in use.",
        ("raised work position", "harness or edge protection lacking"),
        "OSHA 29 CFR 1926.502",
    ),
    Rule(
        "RULE_004", "Hot Work Without Adequate Controls", "Hot Work", 3,
        ("hot work", "welding", "cutting", "grinding", "open flame", "fire watch absent",
         "fire watch not present", "fire watch not stationed", "no fire watch", "fire watch missing",
         "flammable material", "combustible material", "gas not cleared", "hydrocarbon present",
         "hot work permit", "ignition source", "permit absent", "permit missing", "no permit"),
        "Sparks or flame may meet fuel while watch, permit or clearance is not assured.",
        ("spark or flame producing task", "fuel close by", "fire watch or permit lacking"),
        "NFPA 51B",
    ),
    Rule(
        "RULE_005", "Line of Fire Exposure", "Line of Fire", 3,
        ("line of fire", "struck by", "struck-by", "caught between", "caught-between",
         "exclusion zone not", "no exclusion zone", "exclusion zone missing", "exclusion zone absent",
         "in the path", "below the load", "under the load", "dropped object", "swinging load",
         "overhead load", "path of travel", "barricade absent", "no barricade", "barricade missing",
         "falling object", "projectile"),
        "A person stands where a moving load, vehicle or object could strike or trap them.",
        ("moving or suspended load", "person inside its path", "zone not closed off"),
        "IOGP Report 459",
    ),
)

# Severity labels by level; a rule at or above FLAG_SEVERITY raises the flag.
SEVERITY_LABELS: dict[int, str] = {0: "NONE", 1: "LOW", 2: "MEDIUM", 3: "HIGH", 4: "CRITICAL"}
FLAG_SEVERITY = 3
NO_SIGNAL_SUMMARY = "No SIF precursor signals detected by rule engine."
BLANK_SUMMARY = "Empty report text. No rules evaluated."
