"""Entity extraction: typed spans with offsets, barrier state, merged spans and primary fields.

All of it is column expressions. A regex finds the matches, the text between the matches gives the
offsets, and array folds do the order-dependent steps, so a report never leaves its row, its task or
the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import text as tx
from riskloom.functions.plan import in_parts, settled
from riskloom.packs import patterns as P
from riskloom.packs.gazetteer import (
    DEFAULT_GAZETTEERS,
    IMPLIED_HAZARD_CONFIDENCE,
    IMPLIED_HAZARDS,
    Gazetteer,
)

ENTITY = (
    "struct<entity_type:string,text:string,normalized_value:string,category:string,start:int,end:int,"
    "confidence:double,source:string,status:string>"
)
ENTITIES = f"array<{ENTITY}>"
# A pattern span with its place in pattern order.
RANKED = f"struct<rank:int,start:int,entity:{ENTITY}>"


@dataclass(frozen=True)
class ExtractionPack:
    gazetteers: Sequence[Gazetteer] = DEFAULT_GAZETTEERS
    # (keywords, pattern, value) and (keywords, pattern): any one keyword must occur; "" always does.
    activity_patterns: Sequence[tuple[Sequence[str], str, str]] = P.ACTIVITY_PATTERNS
    equipment_patterns: Sequence[tuple[Sequence[str], str]] = P.EQUIPMENT_PATTERNS
    location_patterns: Sequence[tuple[Sequence[str], str]] = P.LOCATION_PATTERNS
    status_words: Sequence[tuple[str, Sequence[str]]] = P.STATUS_WORDS
    barrier_nouns: Sequence[tuple[str, Sequence[str]]] = P.BARRIER_NOUNS
    implied_hazards: dict = field(default_factory=lambda: dict(IMPLIED_HAZARDS))


DEFAULT_EXTRACTION = ExtractionPack()


NO_ENTITIES = f"cast(array() as {ENTITIES})"


def _entity(kind, text, value, start, end, confidence, source, category="cast(null as string)",
            status="cast(null as string)") -> str:
    """SQL for one span; ``confidence`` is a number or SQL."""
    if not isinstance(confidence, str):
        confidence = f"{float(confidence)!r}D"
    return (
        f"named_struct('entity_type', {tx.sql_text(kind)}, 'text', {text}, 'normalized_value', {value}, "
        f"'category', {category}, 'start', {start}, 'end', {end}, 'confidence', {confidence}, "
        f"'source', {tx.sql_text(source)}, 'status', {status})"
    )


# --------------------------------------------------------------------------- gazetteers


def _first_owner(gazetteer: Gazetteer, attribute: str) -> dict[str, str]:
    """Upper-cased alias -> attribute of the first term that lists it."""
    owner: dict[str, str] = {}
    for term in gazetteer.terms:
        for alias in term.aliases:
            owner.setdefault(alias.upper(), getattr(term, attribute))
    return owner


def _gazetteer_entities(gazetteer: Gazetteer, cut: str, first: str) -> str:
    values = _first_owner(gazetteer, "canonical")
    categories = {k: v for k, v in _first_owner(gazetteer, "category").items() if v is not None}

    def entity(text: str, start: str, end: str, _: str) -> str:
        return _entity(
            gazetteer.kind, text, tx.sql_lookup(f"upper({text})", values), start, end,
            gazetteer.confidence, "deterministic",
            *([tx.sql_lookup(f"upper({text})", categories)] if categories else []),
        )

    return tx.per_span(cut, first, entity, NO_ENTITIES)


def match_gazetteers(reports: DataFrame, text: str, gazetteers: Sequence[Gazetteer]) -> DataFrame:
    """Add ``gazetteer_entities``: per type the leftmost matches, the longest where several start together.

    Scanning one alternation (longest phrase first) from left to right *is* the greedy removal of
    overlapping spans, so overlaps never have to be produced and thrown away.
    """
    staged, found = _found_by_gazetteers(reports, text, gazetteers)
    return _listed(staged, "gazetteer_entities", list(found.values())).drop(*found.values())


def _found_by_gazetteers(reports: DataFrame, text: str, gazetteers: Sequence[Gazetteer]) -> tuple[DataFrame, dict[str, str]]:
    """A column of gazetteer spans for each type, and its name by type, in the order of type names.

    Types have columns of their own, so that a plan that needs one type does not search for the others.
    """
    regex = {g.kind: tx.phrase_regex(a for t in g.terms for a in t.aliases) for g in gazetteers}
    staged = reports.withColumns({f"__cut_{k}": tx.pieces(F.col(text), r) for k, r in regex.items()})
    staged = staged.withColumns({f"__first_{k}": tx.first_piece(f"__cut_{k}") for k in regex})
    lists: dict[str, list[str]] = {k: [] for k in sorted(regex)}
    for g in gazetteers:
        lists[g.kind].append(_gazetteer_entities(g, f"__cut_{g.kind}", f"__first_{g.kind}"))
    staged = staged.withColumns({f"__known_{k}": F.expr(_concat(found)) for k, found in lists.items()})
    return staged.drop(*[f"__{part}_{k}" for k in regex for part in ("cut", "first")]), {k: f"__known_{k}" for k in lists}


def _concat(lists: Sequence[str]) -> str:
    """SQL: the arrays of spans one after the other."""
    return lists[0] if len(lists) == 1 else f"concat({', '.join(lists)})" if lists else NO_ENTITIES


def _listed(staged: DataFrame, name: str, lists: Sequence[str]) -> DataFrame:
    """Add the spans of the lists by start offset; spans that start together stand as the lists do."""
    # Staged, because the sort below names the list more than once.
    staged = staged.withColumn("__unsorted", F.expr(_concat(lists)))
    return staged.withColumn(name, in_reading_order("__unsorted")).drop("__unsorted")


def in_reading_order(entities: str) -> Column:
    """Stable sort of a column of spans by start offset."""
    return F.expr(
        f"if(size({entities}) > 1, transform(sort_array(transform({entities}, (e, i) -> "
        f"named_struct('start', e.start, 'place', i, 'entity', e))), k -> k.entity), {entities})"
    )


# --------------------------------------------------------------------------- phrase patterns


def _has_group(pattern: str) -> bool:
    return any(pattern[i] == "(" and pattern[i + 1] != "?" for i in range(len(pattern) - 1))


def _phrase_entities(reports: DataFrame, text: str, pack: ExtractionPack) -> tuple[DataFrame, dict[str, list[str]], list[str]]:
    """Spans of activity, equipment and location phrases by type, in pattern order, as SQL.

    A phrase is searched for only in texts that hold one of its keywords.
    """
    jobs = (
        [("activity", *job, P.ACTIVITY_CONFIDENCE) for job in pack.activity_patterns]
        + [("equipment", *job, None, P.EQUIPMENT_CONFIDENCE) for job in pack.equipment_patterns]
        + [("location", *job, None, P.LOCATION_CONFIDENCE) for job in pack.location_patterns]
    )
    cuts, firsts, lists = {}, {}, {}
    # As one method of whole-stage code the searches would be too long to compile.
    apart = in_parts(F.col("__folded").isNotNull())
    for i, (kind, keywords, pattern, value, confidence) in enumerate(jobs):
        cut, first = f"__cut_{i}", f"__first_{i}"
        cuts[cut] = F.when(
            apart & F.expr(tx.contains_any("__folded", keywords)),
            tx.pieces(F.col(text), tx.FLAGS + pattern, 1 if _has_group(pattern) else 0),
        )
        firsts[first] = tx.first_piece(cut)

        def entity(found: str, start: str, end: str, found_start: str) -> str:
            if kind == "activity":
                return _entity(kind, found, tx.sql_text(value), start, end, confidence, "nlp_pattern")
            shown = f"btrim({found}, {tx.sql_text(tx.WHITESPACE)})"
            name = f"lower({shown})" if kind == "equipment" else tx.title_case(shown)
            return _entity(kind, shown, name, found_start, end, confidence, "nlp_pattern")

        lists.setdefault(kind, []).append(tx.per_span(cut, first, entity, NO_ENTITIES))
    return reports.withColumns(cuts).withColumns(firsts), lists, [*cuts, *firsts]


# --------------------------------------------------------------------------- barrier state


@dataclass(frozen=True)
class _StateRegex:
    kind: str
    regex: str


def _state_vocabulary(pack: ExtractionPack):
    words = [(status, word) for status, group in pack.status_words for word in group]
    nouns = [(barrier, noun, i) for i, (barrier, group) in enumerate(pack.barrier_nouns) for noun in group]
    return words, nouns


def _state_regexes(pack: ExtractionPack) -> list[_StateRegex]:
    """Four look-ahead regexes that stand for every (state wording, barrier, order) pair.

    At each start the first state wording in pack order wins. A bare wording that begins longer
    wordings ("without", "no", "signed") goes into a regex of its own, so that the short and the long reading
    of the same place are both seen. Look-ahead makes overlapping spans visible.
    """
    words, nouns = _state_vocabulary(pack)
    all_words = [w for _, w in words]
    short = [w for w in all_words if " " not in w and any(o.startswith(w + " ") for o in all_words)]
    long_ = [w for w in all_words if w not in short]
    noun = tx.by_first_letter([n for _, n, _ in nouns], tx.words_regex)
    filler = rf"(?:(?:{'|'.join(P.PREFIX_FILLERS)}){tx._SPACE})?"
    verb = rf"(?:(?:{'|'.join(tx.words_regex(v) for v in P.POSTFIX_VERBS)}){tx._SPACE})?"
    begin, end = rf"(?<!{tx._WORD})", rf"(?!{tx._WORD})"
    out = []
    for group in (long_, short):
        if not group:
            continue
        word = tx.by_first_letter(group, tx.words_regex)
        out.append(_StateRegex("prefix", f"(?iu){begin}(?=((?:{word}){tx._SPACE}{filler}(?:{noun}){end}))"))
        out.append(_StateRegex("postfix", f"(?iu){begin}(?=((?:{noun}){end}{tx._SPACE}{verb}(?:{word}){end}))"))
    return out


def _plain(text: str, regex: str) -> str:
    """SQL: the part of a span that a regex finds, lower case with single spaces."""
    return (
        f"lower(regexp_replace(regexp_extract({text}, {tx.sql_text(regex)}, 0), {tx.sql_text(tx._SPACE)}, ' '))"
    )


def _state_entities(reports: DataFrame, text: str, pack: ExtractionPack) -> tuple[DataFrame, str, list[str]]:
    """Barrier spans bound to a state, in pattern order (state wording, barrier, prefix before postfix), as SQL."""
    words, nouns = _state_vocabulary(pack)
    place = {w: i for i, (_, w) in reversed(list(enumerate(words)))}
    status = {w: s for s, w in reversed(words)}
    barrier = {n: b for b, n, _ in nouns}
    barrier_place = {n: i for _, n, i in nouns}
    regexes = _state_regexes(pack)
    any_noun = tx.phrase_regex((n.split(" ")[0] for _, n, _ in nouns), flags="")

    # Most reports name no barrier: one test spares them the four searches.
    # Both projections are too long for one method, as above.
    staged = reports.withColumn("__names_barrier", in_parts(F.col("__folded").rlike(any_noun)))
    cuts = {
        f"__state_{i}": F.when(in_parts(F.col("__names_barrier")), tx.pieces(F.col(text), r.regex, 1))
        for i, r in enumerate(regexes)
    }
    staged = staged.withColumns(cuts)
    by_length = dict(key=len, reverse=True)
    any_word = "|".join(tx.words_regex(w) for w in sorted((w for _, w in words), **by_length))
    any_name = "|".join(tx.words_regex(n) for n in sorted((n for _, n, _ in nouns), **by_length))
    word_first, word_last = rf"(?iu)^(?:{any_word})(?!{tx._WORD})", rf"(?iu)(?<!{tx._WORD})(?:{any_word})$"
    noun_first, noun_last = rf"(?iu)^(?:{any_name})(?!{tx._WORD})", rf"(?iu)(?<!{tx._WORD})(?:{any_name})$"

    lists = []
    for i, r in enumerate(regexes):
        prefix, cut = r.kind == "prefix", f"__state_{i}"
        # Each span with the words that make it up, so that they are cut out once.
        named = (
            f"transform({tx.spans(cut, look_ahead=True)}, s -> named_struct('s', s, "
            f"'word', {_plain('s.text', word_first if prefix else word_last)}, "
            f"'noun', {_plain('s.text', noun_last if prefix else noun_first)}))"
        )
        if not prefix:
            # A name within a longer one of the same barrier ("permit" in "work permit") is no match of its own.
            same = f"{tx.sql_lookup('o.noun', barrier_place)} = {tx.sql_lookup('m.noun', barrier_place)}"
            named = (
                f"transform(array({named}), ms -> filter(ms, m -> not exists(ms, o -> o.s.end = m.s.end and o.s.start < m.s.start "
                f"and o.word = m.word and {same})))[0]"
            )
        state = tx.sql_lookup("m.word", status)
        confidence = (
            f"if({state} = 'Not Verified', {P.UNVERIFIED_PREFIX_CONFIDENCE}D, {P.PREFIX_CONFIDENCE}D)"
            if prefix
            else P.POSTFIX_CONFIDENCE
        )
        # Pattern order: state wording, then barrier, then prefix before postfix.
        rank = (
            f"{tx.sql_lookup('m.word', place)} * {2 * len(pack.barrier_nouns)} "
            f"+ {tx.sql_lookup('m.noun', barrier_place)} * 2 + {0 if prefix else 1}"
        )
        entity = _entity(
            "barrier", "m.s.text", tx.sql_lookup("m.noun", barrier), "m.s.start", "m.s.end",
            confidence, "nlp_pattern", status=state,
        )
        lists.append(
            f"if(size({cut}) > 1, transform({named}, m -> named_struct('rank', {rank}, "
            f"'start', m.s.start, 'entity', {entity})), cast(array() as array<{RANKED}>))"
        )
    ordered = f"transform(sort_array(concat({', '.join(lists)})), k -> k.entity)"
    return staged, ordered, ["__names_barrier", *cuts]


def match_patterns(reports: DataFrame, text: str, pack: ExtractionPack) -> DataFrame:
    """Add ``pattern_entities``: phrase spans, then barrier-state spans, in pattern order."""
    staged, found = _found_by_patterns(reports, text, pack)
    return staged.withColumn("pattern_entities", F.expr(_concat(list(found.values())))).drop(*found.values())


def _found_by_patterns(reports: DataFrame, text: str, pack: ExtractionPack) -> tuple[DataFrame, dict[str, str]]:
    """A column of pattern spans for each type, and its name by type, both in pattern order."""
    staged = reports.withColumn("__folded", tx.folded(F.col(text)))
    staged, phrases, scratch = _phrase_entities(staged, text, pack)
    staged, states, state_scratch = _state_entities(staged, text, pack)
    lists = {**{k: _concat(found) for k, found in phrases.items()}, "barrier": states}
    staged = staged.withColumns({f"__worded_{k}": F.expr(found) for k, found in lists.items()})
    return staged.drop("__folded", *scratch, *state_scratch), {k: f"__worded_{k}" for k in lists}


# --------------------------------------------------------------------------- merge


def _merge_type(kind: str, known: str, worded: str, any_worded: str) -> str:
    """SQL: gazetteer spans of a type, reinforced and given a state by nearby pattern spans of it, then its new pattern spans.

    ``any_worded`` tells whether the spans that are not backed have their confidence rounded too.
    """
    def told(e: str, backed: str, state: str) -> str:
        raised = f"least({P.CONFIDENCE_CEILING}D, {e}.confidence + {P.REINFORCE_BONUS}D)"
        return f"""named_struct(
          'entity_type', {e}.entity_type, 'text', {e}.text, 'normalized_value', {e}.normalized_value,
          'category', {e}.category, 'start', {e}.start, 'end', {e}.end,
          'confidence', round(if({backed}, {raised}, {e}.confidence), 2),
          'source', if({backed}, 'hybrid', 'deterministic'),
          'status', {state if kind == 'barrier' else 'cast(null as string)'})"""

    # The first pattern span in reach decides the state.
    several = told(
        "e", f"exists({worded}, p -> abs(p.start - e.start) <= {P.REINFORCE_REACH})",
        f"get(filter({worded}, p -> abs(p.start - e.start) <= {P.STATUS_REACH} and p.status is not null), 0).status",
    )
    # One by one and in pattern order: a span is kept if it overlaps none kept so far.
    merged = f"""
        aggregate({worded}, cast(transform({known}, e -> {several}) as {ENTITIES}), (kept, p) -> if(
          exists(kept, k -> k.end > p.start and k.start < p.end), kept, array_append(kept, p)))"""
    # One span of each source, a usual case, is told without loops, which Spark interprets.
    e, p = f"get({known}, 0)", f"get({worded}, 0)"
    away = f"abs({p}.start - {e}.start)"
    one = told(e, f"{away} <= {P.REINFORCE_REACH}", f"if({away} <= {P.STATUS_REACH}, {p}.status, null)")
    pair = f"if({e}.end > {p}.start and {e}.start < {p}.end, array({one}), array({one}, {p}))"
    return f"""case when not ({any_worded}) then {known}
        when size({known}) = 0 and size({worded}) = 1 then {worded}
        when size({known}) = 1 and size({worded}) = 1 then {pair} else {merged} end"""


def _merge_types(staged: DataFrame, pack: ExtractionPack, known: dict[str, str], worded: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """A column of merged spans for each type (types do not act on each other), and its name by type; and ``entities``, all of them."""
    # Rounding shows only where a pack has confidences of more than two digits.
    finer = any(round(g.confidence, 2) != g.confidence for g in pack.gazetteers)
    found = lambda kinds: " or ".join(f"size({worded[k]}) > 0" for k in kinds)
    merged, told = {}, {}
    for k in dict.fromkeys([*known, *worded]):
        merged[k] = f"__merged_{k}"
        if k not in worded:
            told[k] = f"if({found(worded)}, transform({known[k]}, e -> named_struct({_rounded('e')})), {known[k]})" if finer else known[k]
        else:
            told[k] = _merge_type(k, known.get(k, NO_ENTITIES), worded[k], found(worded if finer else [k]))
    staged = staged.withColumns({merged[k]: F.expr(told[k]) for k in merged})
    # Where spans start together, those of gazetteers stand first.
    first = [f"slice({merged[k]}, 1, size({known[k]}))" if k in worded else merged[k] for k in known]
    new = [f"slice({merged[k]}, size({known[k]}) + 1, size({merged[k]}))" if k in known else merged[k] for k in worded]
    return _listed(staged, "entities", [*first, *new]), merged


def _rounded(span: str) -> str:
    fields = [f.split(":")[0] for f in ENTITY.removeprefix("struct<").removesuffix(">").split(",")]
    return ", ".join(f"'{f}', " + (f"round({span}.{f}, 2)" if f == "confidence" else f"{span}.{f}") for f in fields)


# --------------------------------------------------------------------------- primary fields


def primary(spans: str) -> Column:
    """The most confident of the spans of a type; the earlier one among equals."""
    return F.expr(
        f"if(size({spans}) > 1, array_min(transform({spans}, (e, i) -> "
        f"named_struct('key', -e.confidence, 'start', e.start, 'place', i, 'entity', e))).entity, get({spans}, 0))"
    )


def status_in_window(window: str) -> str:
    """SQL: barrier state read off the words around a barrier that no pattern bound to a state."""
    cases = " ".join(f"when {tx.contains_any(window, words)} then '{label}'" for label, words in P.WINDOW_TESTS)
    return f"case {cases} else 'Unknown' end"


def window_around(text: str, start: str, end: str) -> str:
    """SQL: the lower-cased text within reach of a span."""
    first = f"greatest(0, {start} - {P.WINDOW_CHARS})"
    return f"lower(substring({text}, {first} + 1, {end} + {P.WINDOW_CHARS} - {first}))"


def resolve_primary(extracted: DataFrame, text: str, pack: ExtractionPack, spans: dict[str, str]) -> DataFrame:
    """Add the five primary fields with confidences, the hazard category, the barrier state and a summary.

    ``spans`` names the column of the spans of a type.
    """
    kinds = ("activity", "hazard", "barrier", "location", "equipment")
    staged = extracted.withColumns({f"__{k}": primary(spans[k]) if k in spans else F.lit(None).cast(ENTITY) for k in kinds})
    staged = staged.withColumn(
        "__window",
        F.when(
            F.col("__barrier").isNotNull() & F.col("__barrier")["status"].isNull(),
            F.expr(window_around(text, "__barrier.start", "__barrier.end")),
        ),
    )
    barrier = F.col("__barrier")
    implied = tx.lookup(barrier["normalized_value"], pack.implied_hazards)
    hazards = next((g for g in pack.gazetteers if g.kind == "hazard"), None)
    category_of = {t.canonical: t.category for t in hazards.terms if t.category} if hazards else {}
    fallback = F.lower(F.col(text)).contains(P.EQUIPMENT_FALLBACK)

    def confidence(kind: str, absent=0.0) -> Column:
        return F.round(F.coalesce(F.col(f"__{kind}")["confidence"], absent if isinstance(absent, Column) else F.lit(absent)), 2)

    staged = staged.withColumns(
        {
            "activity": F.col("__activity")["normalized_value"],
            "activity_confidence": confidence("activity"),
            "hazard": F.coalesce(F.col("__hazard")["normalized_value"], implied),
            "hazard_category": F.when(
                F.col("__hazard").isNotNull(), F.col("__hazard")["category"]
            ).otherwise(tx.lookup(implied, category_of)) if category_of else F.col("__hazard")["category"],
            "hazard_confidence": confidence(
                "hazard", F.when(implied.isNotNull(), IMPLIED_HAZARD_CONFIDENCE).otherwise(0.0)
            ),
            "barrier": barrier["normalized_value"],
            "barrier_status": F.when(
                barrier.isNotNull(),
                F.coalesce(barrier["status"], F.expr(status_in_window("__window"))),
            ),
            "barrier_confidence": confidence("barrier"),
            "extracted_location": F.col("__location")["normalized_value"],
            "location_confidence": confidence("location"),
            "equipment": F.coalesce(F.col("__equipment")["text"], F.when(fallback, P.EQUIPMENT_FALLBACK)),
            "equipment_confidence": confidence(
                "equipment", F.when(fallback, P.EQUIPMENT_FALLBACK_CONFIDENCE).otherwise(0.0)
            ),
        }
    )
    return staged.drop("__window", *[f"__{k}" for k in kinds])


def context_summary() -> Column:
    """One line naming what was found."""
    barrier = F.concat(
        F.lit("Barrier: "), F.col("barrier"),
        F.when(F.col("barrier_status").isNotNull(), F.concat(F.lit(" ("), F.col("barrier_status"), F.lit(")"))).otherwise(""),
    )
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("Activity: "), F.col("activity")),
        F.concat(F.lit("Equipment: "), F.col("equipment")),
        F.concat(F.lit("Hazard: "), F.col("hazard")),
        barrier,
        F.concat(F.lit("Location: "), F.col("extracted_location")),
    )
    return F.when(line == "", "No specific safety context entities detected").otherwise(line)


def extract(
    reports: DataFrame,
    text: str = "report_text",
    pack: ExtractionPack = DEFAULT_EXTRACTION,
    use_patterns: bool = True,
) -> DataFrame:
    """Add gazetteer, pattern and merged ``entities`` and the primary fields to each report."""
    staged = reports.withColumn("__text", tx.unmarked(tx.strip(F.col(text))))
    staged, known = _found_by_gazetteers(staged, "__text", pack.gazetteers)
    staged = _listed(staged, "gazetteer_entities", list(known.values()))
    scratch, spans = list(known.values()), known
    if use_patterns:
        staged, worded = _found_by_patterns(staged, "__text", pack)
        staged = staged.withColumn("pattern_entities", F.expr(_concat(list(worded.values()))))
        staged, spans = _merge_types(staged, pack, known, worded)
        scratch += [*worded.values(), *spans.values()]
    else:
        staged = staged.withColumn("entities", F.col("gazetteer_entities"))
    staged = resolve_primary(staged, "__text", pack, spans)
    return settled(reports, staged.withColumn("extraction_summary", context_summary()).drop("__text", *scratch))


def entity_rows(extracted: DataFrame, column: str = "entities", key: str = "report_id") -> DataFrame:
    """One row per span."""
    return extracted.select(key, F.posexplode(column).alias("span_pos", "span")).select(
        key, "span_pos", "span.*"
    )


def gazetteer_table(spark: SparkSession, gazetteers: Sequence[Gazetteer] = DEFAULT_GAZETTEERS) -> DataFrame:
    """Every alias with its term and category, in pack order."""
    rows = [
        (g.kind, i, t.canonical, t.category, a)
        for g in gazetteers
        for i, (t, a) in enumerate((t, a) for t in g.terms for a in t.aliases)
    ]
    return spark.createDataFrame(
        rows, "kind string, alias_pos int, canonical string, category string, alias string"
    )


def alias_hits(reports: DataFrame, key: str = "report_id", text: str = "report_text",
               gazetteers: Sequence[Gazetteer] = DEFAULT_GAZETTEERS) -> DataFrame:
    """How often every alias stands in a report, overlaps included: (key, kind, alias_pos, canonical, alias, hits).

    A plain substring test picks the aliases worth counting; only those become rows.
    """
    entries = ", ".join(
        f"named_struct('kind', {tx.sql_text(g.kind)}, 'alias_pos', {i}, 'canonical', {tx.sql_text(t.canonical)}, 'alias', {tx.sql_text(a)})"
        for g in gazetteers
        for i, (t, a) in enumerate((t, a) for t in g.terms for a in t.aliases)
    )
    staged = reports.select(key, F.col(text).alias("__text"), tx.folded(F.col(text)).alias("__folded"))
    near = F.expr(f"filter(array({entries}), a -> contains(__folded, a.alias))")
    begin, end = F.lit(f"(?iu)(?<!{tx._WORD})\\Q"), F.lit(f"\\E(?!{tx._WORD})")
    counted = F.regexp_count("__text", F.concat(begin, F.col("a.alias"), end))
    return (
        staged.select(key, "__text", F.explode(near).alias("a")).select(key, "a.*", counted.alias("hits"))
        .filter(F.col("hits") > 0)
    )
