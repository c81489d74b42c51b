"""Extraction against a brute-force restatement: every alias and every pattern tried by itself."""

import random
import re

from riskloom.operators import extract as X
from riskloom.packs import patterns as P
from riskloom.packs.gazetteer import DEFAULT_GAZETTEERS

WORDS = (
    "without verified isolation lockout tagout not applied gas test testing permit no attendant fire watch missing was is "
    "had been harness worn any a the at tank farm pump room welder maintenance began energized equipment confined space "
    "entered worker storage flare stack signed off exclusion zone in place verification lacking , . verified near using "
    "safety performing ppe hard hat SCAFFOLD Crane load valve on with de-energized unverified 6-metre"
).split()


def texts(n: int) -> list[str]:
    rng = random.Random(7)
    gaps = [" ", " ", " ", " ", "  ", "\n", "_", "-"]
    out = ["", "   ", "...", "Maintenance started on energized equipment without verified isolation."]
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(3, 25))]
        out.append("".join(w + rng.choice(gaps) for w in words))
    return out


def gazetteer_spans(text: str) -> list[tuple]:
    found = []
    for g in DEFAULT_GAZETTEERS:
        for term in g.terms:
            for alias in term.aliases:
                if alias not in text.lower():
                    continue
                for m in re.finditer(rf"\b{re.escape(alias)}\b", text, re.I):
                    found.append((g.kind, m.start(), m.end(), term.canonical))
    found.sort(key=lambda s: (s[0], s[1], s[1] - s[2]))
    kept = []
    for s in found:
        if not any(k[0] == s[0] and k[2] > s[1] and k[1] < s[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def pattern_spans(text: str) -> list[tuple]:
    out = []
    for _, pattern, value in P.ACTIVITY_PATTERNS:
        out += [("activity", m.start(), m.end(), value, None) for m in re.finditer(pattern, text, re.I)]
    for _, pattern in P.EQUIPMENT_PATTERNS:
        out += [("equipment", m.start(1), m.end(1), m.group(1).strip().lower(), None) for m in re.finditer(pattern, text, re.I)]
    for _, pattern in P.LOCATION_PATTERNS:
        out += [("location", m.start(1), m.end(1), m.group(1).strip().title(), None) for m in re.finditer(pattern, text, re.I)]
    for barrier, status, regex in STATE_PATTERNS:
        out += [("barrier", m.start(), m.end(), barrier, status) for m in regex.finditer(text)]
    return out


def _state_patterns() -> list[tuple]:
    """Every state wording with every barrier, before and after it: compiled once, in pattern order."""
    out = []
    for status, words in P.STATUS_WORDS:
        for word in words:
            for barrier, nouns in P.BARRIER_NOUNS:
                noun = "|".join(rf"\b{spaced(n)}\b" for n in nouns)
                for regex in (rf"\b({spaced(word)})\s+{FILLER}({noun})", rf"\b({noun})\s+{VERB}({spaced(word)})\b"):
                    out.append((barrier, status, re.compile(regex, re.I)))
    return out


def spaced(words: str) -> str:
    return r"\s+".join(re.escape(x) for x in words.split())


FILLER = "(?:" + "|".join(rf"{f}\s+" for f in P.PREFIX_FILLERS) + ")?"
VERB = "(?:" + "|".join(rf"{spaced(v)}\s+" for v in P.POSTFIX_VERBS) + ")?"
STATE_PATTERNS = _state_patterns()


def merged_spans(text: str) -> list[tuple]:
    base, extra = gazetteer_spans(text), pattern_spans(text)
    out = []
    for kind, s, e, value in base:
        near = [p for p in extra if p[0] == kind]
        status = next((p[4] for p in near if p[4] and abs(p[1] - s) <= P.STATUS_REACH), None) if kind == "barrier" else None
        backed = any(abs(p[1] - s) <= P.REINFORCE_REACH for p in near)
        out.append((kind, s, e, value, status, "hybrid" if backed else "deterministic"))
    for p in extra:
        if not any(o[0] == p[0] and o[2] > p[1] and o[1] < p[2] for o in out):
            out.append((*p, "nlp_pattern"))
    return sorted(out, key=lambda s: s[1])


def test_spans_equal_brute_force_and_slice_back(spark):
    samples = texts(300)
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(samples)], "report_id string, report_text string")
    got = {r.report_id: r for r in X.extract(rows).select("report_id", "gazetteer_entities", "entities").collect()}
    for i, text in enumerate(samples):
        text = text.strip()
        r = got[str(i)]
        assert [(e.entity_type, e.start, e.end, e.normalized_value) for e in r.gazetteer_entities] == gazetteer_spans(text), text
        mine = [(e.entity_type, e.start, e.end, e.normalized_value, e.status, e.source) for e in r.entities]
        assert mine == merged_spans(text), text
        assert all(text[e.start : e.end].strip() == e.text for e in r.entities if e.entity_type != "activity")


def test_shared_alias_belongs_to_the_term_listed_first(spark):
    rows = spark.createDataFrame([("a", "Flammable vapours near the attendant")], "report_id string, report_text string")
    entities = X.extract(rows).first().entities
    assert ("hazard", "Toxic Gas / H2S") in [(e.entity_type, e.normalized_value) for e in entities]
    assert ("barrier", "Entry Permit & Attendant") in [(e.entity_type, e.normalized_value) for e in entities]


def test_null_text_has_no_entities(spark):
    row = X.extract(spark.createDataFrame([("a", None)], "report_id string, report_text string")).first()
    assert row.entities == [] and row.barrier is None
    assert row.extraction_summary == "No specific safety context entities detected"
