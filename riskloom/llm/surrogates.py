"""Surrogates for personal data in report texts: keyed, of the same kind and form, distinct and consistent."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.lineage import stored

#: Numbers of attempts at a surrogate that is neither taken nor found in the texts.
ATTEMPTS = 64

# Given names by script and gender. A name gets another one of its own list.
GIVEN = {
    ("latin", "f"): (
        "Alice", "Amelia", "Anna", "Camille", "Carmen", "Clara", "Claire", "Elena", "Elisabeth", "Emma", "Eva", "Hannah", "Helen", "Ines",
        "Isabel", "Julia", "Karin", "Laura", "Lena", "Linda", "Lucia", "Margaret", "Maria", "Marie", "Marta", "Mary", "Monika", "Nadia",
        "Nicole", "Nina", "Olivia", "Paula", "Petra", "Rosa", "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Ursula",
    ),
    ("latin", "m"): (
        "Alan", "Andreas", "Antonio", "Bernard", "Carlos", "Charles", "Daniel", "David", "Diego", "Edward", "Erik", "Felix", "Frank",
        "George", "Hans", "Henri", "Hugo", "Ivan", "James", "Jan", "Javier", "John", "Jorge", "Juan", "Julien", "Klaus", "Lars", "Louis",
        "Luis", "Marco", "Mark", "Martin", "Michael", "Oliver", "Oscar", "Paul", "Peter", "Robert", "Stefan", "Thomas",
    ),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("cyrillic", "m"): ("Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος"),
}
# Titles: they tell that a name follows, and stay.
TITLES = {
    "f": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra."),
    "m": ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr."),
    "": ("Dr.", "Dr", "Prof.", "Prof"),
}
# Syllables that other names are made of, by script.
SYLLABLES = {
    "latin": tuple(c + v for c in "bcdfghjklmnprstvz" for v in "aeiou"),
    "cyrillic": tuple(c + v for c in "бвгдзклмнпрстфх" for v in "аеиоу"),
    "greek": tuple(c + v for c in "βγδζθκλμνπρστφχ" for v in "αειου"),
}

_NAMED = "|".join(sorted({name for names in GIVEN.values() for name in names}, key=lambda n: (-len(n), n)))
_TITLED = "|".join(t.replace(".", r"\.") for t in sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_EDGE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_CAPITAL = r"\p{Lu}[\p{L}\p{M}'’-]+"
#: Kinds in the order in which they are looked for, and their patterns; what one finds is not searched by the next.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "secret": r"(?i:(?:token|secret|password|passwd|api[_-]?key)\s{0,2}[:=]\s{0,2}[\"'])[^\"'\s]{6,}+(?=[\"'])",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,8}){1,4}(?!\d)|\+\d{8,15}(?!\d)"
             r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<!\d)\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "social": _EDGE + r"\d{3}-\d{2}-\d{4}" + _AFTER,
    "person": _EDGE + rf"(?:(?:{_TITLED}) {_CAPITAL}(?: {_CAPITAL})?|(?:{_NAMED}) {_CAPITAL})" + _AFTER,
}
KINDS = tuple(PATTERNS)
#: A quick look at what every entity needs, so that most texts are left alone by the patterns.
HINT = r"@|\d{3}|\d\.\d|[\"']|\+\d|[A-Z]{2}\d{2} ?[A-Z0-9]|AKIA|ASIA|gh[pousr]_|sk-[A-Za-z0-9]|" + rf"{_EDGE}(?:{_TITLED}|{_NAMED}) \p{{Lu}}"
_PATTERN = "|".join(f"(?<{kind}>{pattern})" for kind, pattern in PATTERNS.items())
# Marks around an entity and between its kinds; a text that holds them has them escaped meanwhile.
_OPEN, _CLOSE, _NEXT, _ESCAPE = "\ue000", "\ue001", "\ue002", "\ue003"
_MARKS = _ESCAPE + _OPEN + _CLOSE + _NEXT


def _escaped(text: Column) -> Column:
    out = text
    for k, mark in enumerate(_MARKS):
        out = F.replace(out, F.lit(mark), F.lit(f"{_ESCAPE}{k}"))
    return F.when(text.rlike(f"[{_MARKS}]"), out).otherwise(text)


def _restored(text: Column) -> Column:
    out = text
    for k, mark in reversed(list(enumerate(_MARKS))):
        out = F.replace(out, F.lit(f"{_ESCAPE}{k}"), F.lit(mark))
    return F.when(F.contains(text, F.lit(_ESCAPE)), out).otherwise(text)


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once and its expression not copied."""
    return F.transform(F.array(value), use)[0]


def _luhn_sum(digits: Column, odd: int) -> Column:
    """The sum of the digits modulo 10, every second one doubled: from the last one if ``odd`` is 1, else from the one before it."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: _once(d.cast("int"), lambda x: F.when(
        i % 2 == 1 - odd, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda x, d: x + d) % 10


def _mod97(text: Column) -> Column:
    """Digits and capitals (A is 10, Z is 35) read as one number, modulo 97."""
    def add(x: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (x * 10 + F.ascii(c) - 48) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def pieces(text: Column) -> Column:
    """The text as an array of (kind, value, rest): an entity and what follows it; the first has no entity."""
    marked = F.regexp_replace(_escaped(text), F.lit(_PATTERN), F.lit(_OPEN + _NEXT.join(f"${{{kind}}}" for kind in KINDS) + _CLOSE))
    kinds = F.array(*[F.lit(kind) for kind in KINDS])

    def checked(piece: Column) -> Column:
        """A run of digits or letters that only looks like a number with check digits is text."""
        plain = F.regexp_replace(piece["value"], "[ -]", "")
        turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
        wrong = F.when(piece["kind"] == "card", _luhn_sum(plain, 0) != 0).when(piece["kind"] == "iban", _mod97(turned) != 1).otherwise(False)
        return F.when(wrong, F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("value"), F.concat(piece["value"], piece["rest"]).alias("rest"))).otherwise(piece)

    def entity(part: Column, index: Column) -> Column:
        head = F.when(index > 0, F.substring_index(part, _CLOSE, 1)).otherwise(F.lit(""))
        return _once(_once(head, lambda h: F.struct(
            # The field that is filled tells the kind: it has as many separators before it.
            F.when(index > 0, F.element_at(kinds, F.length(F.regexp_extract(h, f"^{_NEXT}*", 0)) + 1)).alias("kind"),
            F.replace(h, F.lit(_NEXT), F.lit("")).alias("value"),
            F.when(index > 0, F.substring(part, F.length(h) + 2, F.length(part))).otherwise(part).alias("rest"),
        )), checked)

    return F.transform(F.split(marked, _OPEN), entity)


def _titles() -> Column:
    return F.array(*[F.lit(t) for names in TITLES.values() for t in names])


def _exchanged(key: str) -> Column:
    """Given name to given name: each list is one ring in an order that the key decides, and every name gives way to the next in it."""
    pairs = []
    for names in GIVEN.values():
        ring = sorted(names, key=lambda name: hashlib.sha256(f"{key}|given|{name}".encode()).hexdigest())
        pairs += [F.lit(x) for k, name in enumerate(ring) for x in (name, ring[(k + 1) % len(ring)])]
    return F.create_map(*pairs)


def _secret_part(value: Column) -> Column:
    """What follows the opening quote."""
    return F.regexp_replace(value, F.lit(r"^[^\"']*[\"']"), F.lit(""))


def units(piece: Column) -> Column:
    """What of an entity gets a surrogate, as 'kind:value' in the form in which mentions of the same are equal."""
    kind, value = piece["kind"], piece["value"]
    plain = F.when(kind == "secret", _secret_part(value)).when(kind.isin("card", "phone", "iban", "social"), F.regexp_replace(value, r"[ .()-]", "")) \
        .when(kind == "email", F.lower(value)).otherwise(value)
    words = F.filter(F.split(value, " "), lambda w: ~F.array_contains(_titles(), w) & ~F.array_contains(_given(), w))
    return F.when(kind == "person", F.transform(words, lambda w: F.concat(F.lit("name:"), F.lower(w)))) \
        .when(kind.isNotNull(), F.array(F.concat(kind, F.lit(":"), plain))).otherwise(F.array().cast("array<string>"))


def _given() -> Column:
    return F.array(*[F.lit(n) for names in GIVEN.values() for n in names])


def surrogate(key: str, unit: Column, attempt: Column) -> Column:
    """The surrogate of a unit at an attempt: letters for letters, digits for digits, and valid for its kind."""
    kind, value = F.substring_index(unit, ":", 1), F.substring(unit, F.instr(unit, ":") + 1, F.length(unit))
    seed = F.concat_ws("\x1f", F.lit(key), unit, attempt.cast("string"))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{k}")), 256) for k in range(4)])

    def formed(hexed: Column, text: Column) -> Column:
        """A character of the same class for each one, by two hexadecimal digits of the stream."""
        def char(c: Column, i: Column) -> Column:
            draw = F.conv(F.substring(hexed, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            pick = lambda letters: F.substring(F.lit(letters), draw % len(letters) + 1, F.lit(1))
            return F.when(c.rlike(r"[0-9]"), pick("0123456789")).when(hexadecimal & c.rlike("[a-z]"), pick("abcdef")) \
                .when(c.rlike(r"\p{Ll}"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        hexadecimal = text.rlike("^[0-9a-f]+$")
        return F.array_join(F.transform(F.split(text, ""), char), "")

    def number(hexed: Column, at: int, below: int) -> Column:
        return (F.conv(F.substring(hexed, F.lit(at * 4 + 1), F.lit(4)), 16, 10).cast("int") % below)

    def luhn(body: Column) -> Column:
        """The digits and their check digit."""
        return F.concat(body, ((10 - _luhn_sum(body, 1)) % 10).cast("string"))

    def iban(country: Column, body: Column) -> Column:
        """The account under the country, with its two check digits."""
        check = F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

    def syllables(hexed: Column) -> Column:
        script = {"cyrillic": value.rlike(r"\p{IsCyrillic}"), "greek": value.rlike(r"\p{IsGreek}")}
        name = lambda s: F.concat(*[F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[s]]), number(hexed, k, len(SYLLABLES[s])) + 1) for k in range(4)])
        return F.when(script["cyrillic"], name("cyrillic")).when(script["greek"], name("greek")).otherwise(name("latin"))

    def build(hexed: Column) -> Column:
        local, head = F.substring_index(value, "@", 1), F.substring(value, 1, 1)
        return (
            F.when(kind == "name", syllables(hexed))
            # Domains and addresses that nobody can own: names kept for examples, and the reserved block.
            .when(kind == "email", F.concat(formed(hexed, local), F.lit("@"), F.translate(F.substring(hexed, 240, 8), "0123456789", "ghijklmnop"), F.lit(".example.net")))
            .when(kind == "address", F.concat_ws(".", number(hexed, 0, 15) + 240, number(hexed, 1, 256), number(hexed, 2, 256), number(hexed, 3, 254) + 1))
            .when(kind == "card", luhn(F.concat(head, formed(hexed, F.substring(value, F.lit(2), F.length(value) - 2)))))
            .when(kind == "key", F.concat(F.substring(value, 1, 4), formed(hexed, F.substring(value, F.lit(5), F.length(value)))))
            .when(kind == "iban", iban(F.substring(value, 1, 2), formed(hexed, F.substring(value, F.lit(5), F.length(value)))))
            .when((kind == "phone") & F.startswith(value, F.lit("+")), F.concat(F.substring(value, 1, 2), formed(hexed, F.substring(value, F.lit(3), F.length(value)))))
            .otherwise(formed(hexed, value))
        )

    return _once(stream, build)


def _spread(form: Column, filling: Column) -> Column:
    """The separators of ``form`` with the other characters taken from ``filling`` in turn."""
    chars = F.split(form, "")
    state = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.when(
        c.rlike(r"[ .()-]"), F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], F.substring(filling, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))))
    return state["out"]


def _replaced(piece: Column, table: Column, given: Column) -> Column:
    """An entity's text after replacement, in the form of the original."""
    kind, value = piece["kind"], piece["value"]

    def word(w: Column) -> Column:
        new = F.element_at(table, F.concat(F.lit("name:"), F.lower(w)))
        return F.when(F.array_contains(_titles(), w), w).when(F.map_contains_key(given, w), F.element_at(given, w)) \
            .when(F.upper(w) == w, F.upper(new)).otherwise(F.initcap(new))

    found = F.element_at(table, units(piece)[0])
    return F.when(kind == "person", F.array_join(F.transform(F.split(value, " "), word), " ")) \
        .when(kind == "secret", F.concat(F.regexp_extract(value, r"^[^\"']*[\"']", 0), found)) \
        .when(kind.isin("card", "phone", "iban", "social"), _spread(value, found)).otherwise(found)


def assigned(values: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(unit, surrogate) for distinct units: no surrogate is used twice, and none is itself a value of the reports.

    All units draw at once. Of those that draw the same surrogate the first by value keeps it; the others, and
    those that drew a value that occurs in the reports or a surrogate kept before, draw again. Rounds shrink
    quickly; what is left after ``attempts`` of them gets a unique name made of its digest.
    """
    kept, left = None, values.select("unit")
    known = values.select(F.col("unit").alias("surrogate_unit"))
    kind = F.substring_index("unit", ":", 1)
    for attempt in range(attempts):
        drawn = stored(left.withColumn("surrogate", surrogate(key, F.col("unit"), F.lit(attempt))).withColumn(
            "surrogate_unit", F.concat(kind, F.lit(":"), "surrogate")))
        free = drawn.join(known, "surrogate_unit", "left_anti")
        if kept is not None:
            free = free.join(kept.select("surrogate_unit"), "surrogate_unit", "left_anti")
        won = stored(free.groupBy("surrogate_unit").agg(F.min("unit").alias("unit"), F.first("surrogate").alias("surrogate")))
        kept = won if kept is None else kept.unionByName(won)
        left = stored(drawn.join(won, "unit", "left_anti").select("unit"))
        if left.isEmpty():
            return kept.select("unit", "surrogate")
    rest = left.withColumn("surrogate", F.sha2(F.concat_ws("\x1f", F.lit(key), "unit"), 256))
    return kept.select("unit", "surrogate").unionByName(rest)


def replace_personal(reports: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """Reports with every detected entity replaced by a surrogate that ``key`` decides.

    Entities are e-mail addresses, quoted secrets, access keys, bank and card numbers, network addresses, phone
    and social security numbers, and persons (a title or a known given name and what follows it). A surrogate has
    the form of the original: digits for digits, letters for letters, the same separators, valid check digits
    for cards and bank numbers (numbers without them are no entities), a given name of the same gender and script, syllables of the same script for other names, titles
    unchanged. Equal entities have equal surrogates in all reports, whatever their separators or case; a family
    name keeps its surrogate with and without title or given name. Different ones differ, and none occurs as
    an entity of the reports (see ``assigned``). Nothing leaves the JVM: texts without a sign of an entity are
    passed on as they are, and of the others only the entities are shuffled to find the surrogates.

    Returns report_id, report_text (null stays null), kinds (array, one entry an entity, in order). Reports are
    told apart by their text, so rows repeated with one id, or without an id, get the same treatment each. Other
    columns are not looked at. An empty table gives an empty result.
    """
    rows = reports.select("report_id", "report_text")
    hinted = F.coalesce(F.col("report_text").rlike(HINT), F.lit(False))
    cut = stored(rows.filter(hinted).select("report_id", pieces(F.col("report_text")).alias("pieces"), F.sha2("report_text", 256).alias("digest")))
    held = cut.filter(F.size("pieces") > 1)
    mentioned = stored(held.select("digest", F.explode(F.flatten(F.transform("pieces", units))).alias("unit")).distinct())
    table = assigned(stored(mentioned.select("unit").distinct()), key, attempts)
    entries = mentioned.join(table, "unit").groupBy("digest").agg(F.collect_set(F.struct("unit", "surrogate")).alias("entries"))
    given = _exchanged(key)

    def text(table: Column) -> Column:
        return F.array_join(F.transform("pieces", lambda p: F.concat(
            F.when(p["kind"].isNull(), F.lit("")).otherwise(_replaced(p, table, given)), p["rest"])), "")

    def kinds() -> Column:
        return F.filter(F.transform("pieces", lambda p: p["kind"]), lambda k: k.isNotNull())

    named = held.join(entries.withColumn("table", F.map_from_entries("entries")), "digest", "left")
    # An entity that is a title and a known given name has no unit of its own.
    no_table = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    changed = named.select("report_id", _restored(text(F.coalesce("table", no_table))).alias("report_text"), kinds().alias("kinds"))
    none = F.array().cast("array<string>").alias("kinds")
    clear = cut.filter(F.size("pieces") == 1).select("report_id", _restored(F.col("pieces")[0]["rest"]).alias("report_text"), none)
    return changed.unionByName(clear).unionByName(rows.filter(~hinted).select("report_id", "report_text", none))
