"""Default gazetteers: canonical term -> aliases, in priority order, one table per entity type."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    canonical: str
    aliases: tuple[str, ...]
    category: str | None = None


# Activity terms.
ACTIVITIES = (
    Term("Maintenance", ("maintenance", "preventative maintenance", "repair", "overhaul", "servicing",
                         "motor repair", "pump maintenance", "vessel maintenance", "electrical maintenance")),
    Term("Welding", ("welding", "tig welding", "mig welding", "arc welding", "weld", "welder")),
    Term("Cutting", ("cutting", "torch cutting", "plasma cutting", "grinding", "angle grinder")),
    Term("Hot Work", ("hot work", "brazing", "soldering", "thermal cutting")),
    Term("Confined Space Entry", ("confined space entry", "vessel entry", "tank entry",
                                  "entering confined space", "entering vessel", "entering storage tank",
                                  "entered confined", "entered storage tank", "entered vessel",
                                  "confined space", "confined storage tank")),
    Term("Lifting & Rigging", ("lifting", "crane lift", "rigging", "hoisting", "crane operation",
                               "offloading", "material handling", "crane load", "below crane load")),
    Term("Working at Height", ("working at height", "elevated work", "working at 4 metres",
                               "working at 6 metres", "working on scaffold", "top of scaffold",
                               "scaffold at 6 metres", "scaffold at 4 metres", "on scaffold",
                               "climbing derrick")),
    Term("Drilling", ("drilling", "tripping pipe", "drilling rig operation", "casing operation", "wireline")),
    Term("Inspection & Audit", ("inspection", "routine inspection", "pipeline inspection", "safety audit",
                                "ppe audit", "visual inspection", "housekeeping inspection")),
    Term("Scaffolding", ("scaffolding", "scaffold erection", "scaffold dismantling", "scaffold assembly",
                         "scaffolding work")),
    Term("Pipe Fitting", ("pipe fitting", "flange connection", "pipe installation", "bolting", "pipe work")),
    Term("Painting & Blasting", ("painting", "sandblasting", "surface preparation", "coating")),
    Term("Driving & Logistics", ("driving", "operating vehicle", "forklift operation", "truck driving",
                                 "transport")),
    Term("Excavation", ("excavation", "trenching", "digging", "trench work")),
    Term("Housekeeping", ("housekeeping", "cleaning", "spill cleanup", "debris removal")),
    Term("Pre-task Briefing", ("toolbox meeting", "pre-task briefing", "tailgate meeting", "jsa review",
                               "safety meeting", "safety briefing")),
    Term("Emergency Response", ("emergency response", "evacuation", "fire response", "spill response")),
)

# Hazard terms.
HAZARDS = (
    Term("Electrical Energy", ("energized equipment", "electrical energy", "live circuit", "live wire",
                               "high voltage", "electrocution", "exposed terminals", "breaker not locked",
                               "not de-energized", "energized", "electrical"), "Hazardous Energy"),
    Term("Fall from Height", ("fall from height", "working at height", "elevated work at 4 metres",
                              "elevated work at 6 metres", "scaffold edge", "open edge",
                              "unprotected edge", "dropped from height"), "Working at Height"),
    Term("Toxic Gas / H2S", ("h2s", "toxic gas", "hydrogen sulfide", "sour gas", "gas leak",
                             "leaking gas", "flammable vapours", "hydrocarbon presence",
                             "gas detected"), "Hazardous Atmosphere"),
    Term("Asphyxiation", ("asphyxiation", "oxygen deficiency", "lack of oxygen", "enclosed storage room",
                          "dizziness after working", "atmospheric hazard"), "Hazardous Atmosphere"),
    Term("Fire / Explosion", ("fire", "explosion", "ignition", "ignition source", "flammable vapours",
                              "combustible", "gas cloud", "flash fire"), "Thermal / Chemical"),
    Term("Struck-By", ("struck by", "struck-by", "falling object", "below crane load", "below the load",
                       "pedestrian was struck", "struck by the forklift", "line of fire",
                       "swinging load"), "Mechanical / Physical"),
    Term("Caught Between", ("caught between", "pinch point", "rotating components", "crush hazard",
                            "caught in", "entanglement"), "Mechanical / Physical"),
    Term("Structural Failure", ("structural failure", "scaffold collapse", "cracked board",
                                "unsecured scaffold", "dropped object", "integrity failure"),
         "Physical / Structural"),
    Term("High Pressure Release", ("high pressure", "pressure release", "relief valve leaking",
                                   "pressurized line", "pressure build-up"), "Hazardous Energy"),
    Term("Chemical Exposure", ("chemical exposure", "chemical splash", "hazardous chemical", "drum leak",
                               "acid", "corrosive"), "Chemical"),
    Term("Slip / Trip / Fall", ("slip trip", "oil spill", "slippery surface", "trip hazard", "wet area"),
         "Physical / Ergonomic"),
)

# Barrier terms.
BARRIERS = (
    Term("Isolation", ("isolation", "verified isolation", "lockout tagout", "lockout", "tagout", "loto",
                       "energy isolation", "isolation valve", "breaker lock"), "Engineering / Procedural"),
    Term("Gas Testing", ("gas test", "gas testing", "atmospheric testing", "atmospheric monitoring",
                         "gas clearance", "gas detector", "h2s monitoring"), "Verification / Monitoring"),
    Term("Fall Protection", ("fall protection", "safety harness", "harness", "guardrail", "safety net",
                             "lanyard", "anchor point"), "Physical / Safeguard"),
    Term("Hot Work Permit", ("hot work permit", "work permit", "permit to work", "permit", "ptw"),
         "Administrative / Permit"),
    Term("Fire Watch", ("fire watch", "standby person", "fire extinguisher"), "Procedural / Human"),
    Term("Exclusion Zone", ("exclusion zone", "barricade", "barricaded area", "cordoned off",
                            "warning signs", "safety tape"), "Physical / Administrative"),
    Term("Machine Guarding", ("machine guard", "guarding", "protective guard", "safety barrier", "cover"),
         "Engineering Safeguard"),
    Term("Entry Permit & Attendant", ("entry permit", "attendant", "standby outside", "standby attendant"),
         "Administrative / Human"),
    Term("PPE", ("ppe", "hard hat", "safety glasses", "face shield", "gloves", "slip-resistant footwear",
                 "respirator"), "Personal Protective Equipment"),
    Term("Ventilation", ("ventilation", "forced air", "exhaust fan", "air blower"), "Engineering Safeguard"),
    Term("Spotter", ("spotter", "signal person", "banksman"), "Procedural / Human"),
)

# Location terms.
LOCATIONS = (
    Term("Tank Farm", ("tank farm", "tank farm area")),
    Term("Storage Tank", ("storage tank", "tank", "storage vessel")),
    Term("Well Site", ("well site", "well pad", "drill site")),
    Term("Wellhead", ("wellhead", "wellhead area")),
    Term("Pump Room / Station", ("pump room", "pump station", "motor room")),
    Term("Separator Station", ("separator station", "separator vessel", "separator")),
    Term("Process Area", ("process area", "process unit", "process vessel")),
    Term("Flare Stack", ("flare stack", "flare area")),
    Term("Derrick", ("derrick", "rig floor")),
    Term("Pipe Yard", ("pipe yard", "pipe rack")),
    Term("Chemical Store", ("chemical store", "chemical storage")),
    Term("Storage Room", ("storage room", "store room")),
    Term("Office Block", ("office block", "control room corridor", "facilities")),
    Term("Site Road", ("site road", "site perimeter", "roadway")),
)

# Equipment terms.
EQUIPMENT = (
    Term("energized equipment", ("energized equipment", "live circuit", "live wire")),
    Term("motor control panel", ("motor control panel", "electrical panel", "breaker", "switchgear")),
    Term("drilling rig", ("drilling rig", "rig")),
    Term("scaffold", ("scaffold", "scaffolding", "6-metre scaffold")),
    Term("crane", ("crane", "crane load", "mobile crane")),
    Term("forklift", ("forklift",)),
    Term("pump", ("pump", "rotating components of a pump")),
    Term("valve", ("pressure relief valve", "isolation valve", "relief valve", "valve")),
    Term("separator", ("separator", "separator vessel")),
    Term("gas detector", ("gas detector", "gas monitoring equipment")),
    Term("chemical drums", ("chemical drums", "drums")),
    Term("angle grinder", ("angle grinder", "grinder")),
    Term("flare stack", ("flare stack",)),
)


@dataclass(frozen=True)
class Gazetteer:
    """One entity type's terms and the confidence its matches carry."""

    kind: str
    terms: tuple[Term, ...]
    confidence: float


# Confidence of a gazetteer match per entity type.
DEFAULT_GAZETTEERS = (
    Gazetteer("activity", ACTIVITIES, 0.92),
    Gazetteer("hazard", HAZARDS, 0.92),
    Gazetteer("barrier", BARRIERS, 0.90),
    Gazetteer("location", LOCATIONS, 0.90),
    Gazetteer("equipment", EQUIPMENT, 0.88),
)

# The hazard a barrier guards against, used when no hazard is mentioned.
IMPLIED_HAZARDS = {
    "Isolation": "Electrical Energy",
    "Gas Testing": "Toxic Gas / H2S",
    "Fall Protection": "Fall from Height",
    "Fire Watch": "Fire / Explosion",
    "Hot Work Permit": "Fire / Explosion",
    "Exclusion Zone": "Struck-By",
    "Machine Guarding": "Caught Between",
    "Ventilation": "Asphyxiation",
}
IMPLIED_HAZARD_CONFIDENCE = 0.70
