"""Surrogates for personal data (operator 1), DataFrame functions only.

Entities (mail addresses, card, phone, IP and national numbers, IBANs, access keys, secrets, given names and
surnames) are replaced by keyed surrogates of the same kind, script and format: digits stay digits, letters keep
their case and alphabet, card numbers stay Luhn-valid, given names keep their gender (a keyed rotation of the list
of that gender and script, hence one to one), surnames are built of syllables of their script and keep a feminine
ending. A surrogate is a keyed hash of the entity alone, so one entity has one surrogate in the whole corpus
(coreference). A check over all distinct entities finds surrogates that two entities would share or that are
themselves an entity of the corpus; the losers draw again until all are distinct. Only these few exceptions have
to be joined to the documents; all others are replaced by an expression in the scan.

Names are found by the list of given names (everywhere), and as capitalised words after one of these, a form of
address or words that introduce a name: the next word and up to two more, past initials and particles. What is found so
is also replaced where it stands alone in the same text. Names that neither rule meets stay.

A secret is told by the word before it, the other kinds by their form; the same characters have one surrogate as a secret
and another as a name. A format that has too few values for all its entities (one letter before an ``@``) gets longer
surrogates from the ``LONGER``-th draw on, so that there is always a next one.

Defined results: null text stays null with no entities; repeated rows get equal results; other columns pass
through untouched, whatever their names, but for one that is named like the count, which is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.llm import common as C

# Given names by gender and script, forms of address, syllables of surnames.
GIVEN = {
    "f": ["Mary", "Jennifer", "Linda", "Patricia", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Anna", "Laura", "María", "Carmen", "Ana", "Marie", "Ursula", "Ingrid", "Alice", "Amelia", "Beatriz", "Camille", "Carla", "Caroline", "Charlotte", "Chloé", "Claudia", "Eleanor", "Emily", "Fernanda", "Franziska", "Greta", "Hannah", "Helena", "Isabel", "Johanna", "Juliana", "Katharina", "Louise", "Lucía", "Margaret", "Mariana", "Monika", "Sabine", "Sophie", "Victoria"],
    "m": ["John", "James", "David", "Richard", "Joseph", "Thomas", "Daniel", "Matthew", "Anthony", "Steven", "Paul", "Kevin", "Brian", "Peter", "Antonio", "Manuel", "Francisco", "Pedro", "João", "Pierre", "Jacques", "Hans", "Karl", "Wolfgang", "Alexander", "Andrew", "Antoine", "Carlos", "Charles", "Diego", "Edward", "Fernando", "François", "Friedrich", "George", "Guillaume", "Heinrich", "Henry", "Javier", "Johannes", "José", "Jürgen", "Lukas", "Matthias", "Michael", "Nicolas", "Oliver", "Pablo", "Philippe", "Robert", "Stefan", "William"],
    "cf": ["Анастасия", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия", "Людмила", "Галина"],
    "cm": ["Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий", "Владимир", "Виктор"],
}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Senhor", "Senhora", "г-н", "г-жа"]
SYLLABLES = {"latin": ["bar", "cor", "dan", "fel", "gar", "hol", "jan", "kel", "lin", "mar", "nor", "pel", "ran", "sol", "tam", "ver"], "cyrillic": ["бар", "вол", "гор", "дан", "кол", "лом", "мар", "нов", "пет", "рад", "сол", "тар"], "greek": ["βαρ", "γαλ", "δαν", "κορ", "λιν", "μαρ", "νικ", "παλ", "σολ", "ταν"]}


def _either(words) -> str:
    """A pattern for any of these words, branched by their first letter, so that few of them are tried anywhere."""
    by = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


_ANY = _either(n for names in GIVEN.values() for n in names)
_TITLE = _either(TITLES)
#: A name, without a final 's; what stands before one; small words inside names.
_WORD = r"\p{Lu}(?:\p{L}+|(?=['’]\p{Lu}))(?:['’-]\p{L}{2,})*"
_LEAD = rf"(?<!\p{{L}})(?:(?:{_TITLE})\.?|(?:{_ANY}))\s"
_PARTICLE = "(?:de|da|do|dos|das|del|di|du|la|le|van|von|der|den|zu|y|e)"
_BETWEEN = rf"(?:\p{{Lu}}[\p{{L}}'’-]{{0,24}}\.?|{_PARTICLE})\s"
#: Phone numbers: grouped, international, with a trunk 0 (not a date), and the short-grouped national forms of several countries.
PHONES = [
    r"\+[0-9](?:[ .()/-]{0,2}[0-9]){7,14}",
    r"00[1-9][0-9]{0,2}[ .(/-](?:[ .()/-]{0,2}[0-9]){7,12}",
    r"(?!0[1-9][./-][0-9]{2}[./-][0-9]{4}(?![0-9]))\(?0[1-9](?:[ .()/-]{0,2}[0-9]){7,9}",
    r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}",
    r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}",
    r"[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}",
    r"\(?[1-9][0-9]\)? ?9?[0-9]{4}-[0-9]{4}",
    r"8[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -][0-9]{2}[ -][0-9]{2}",
]
#: Kinds in order of precedence, with their patterns.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "secret": r"(?<=[=:]|[=:][\"' ]|[=: ] ?[\"' ])(?<=\b(?:password|passwd|token|secret|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_/+-]{8,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])",
    "phone": "|".join(rf"(?<![0-9\w])(?<![0-9][.,/-]){p}(?![0-9])" for p in PHONES),
    "given": rf"(?=\p{{Lu}})(?:{_ANY})(?!\p{{L}})",
    "surname": rf"(?=\p{{Lu}})(?<=[\p{{L}}.]\s)(?:(?<={_LEAD})|(?<={_BETWEEN})(?<={_LEAD}{_BETWEEN}(?:{_BETWEEN})?(?:{_BETWEEN})?)){_WORD}",
}
#: All kinds start where no letter or digit stands before.
PATTERN = r"(?<![\p{L}0-9])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: What a text must have at all for ``PATTERN`` to be tried: both are single cheap scans.
MARKS = "[0-9@=:]"
NAMES = rf"(?<!\p{{L}})(?=\p{{Lu}}|г)(?:{_TITLE}|{_ANY})(?!\p{{L}})"
#: Words that introduce a name (all but their first letter), and the name after them.
INTRODUCTIONS = ["y name is ", "igned by ", "e llamo ", "e m'appelle ", "ch heiße ", "ein Name ist ", "eu nome é ", "еня зовут "]
INTRODUCED = rf"(?<=\p{{L}})(?:{'|'.join(INTRODUCTIONS)})({_WORD}(?:\s{_WORD}){{0,2}})"
SECRETS = r"\b(?:password|passwd|token|secret|api_key|apikey)\s{0,2}[=:]"
#: Stands before a secret in the lists of entities.
TAG = "\x01"
#: From this draw on surrogates get longer, one character every so many draws.
LONGER = 16


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def entities(text: Column, names: Column | None = None) -> Column:
    """The entities of a text in order, secrets behind ``TAG``; with ``names`` also where these stand alone."""
    if names is not None:
        found = F.regexp_extract_all(text, pattern(names), F.lit(0))
    else:
        hint = text.rlike(MARKS) | text.rlike(NAMES)
        found = F.when(hint, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    secrets = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}0-9])(?:{KINDS['secret']})"), F.lit(0))
    marked = _let(F.struct(found.alias("f"), secrets.alias("s")), lambda x: F.transform(x["f"], lambda e: F.when(F.array_contains(x["s"], e) & ~e.rlike("@|^(?:AKIA|ASIA)[0-9A-Z]{16}$"), F.concat(F.lit(TAG), e)).otherwise(e)))
    return F.when(text.rlike(SECRETS), marked).otherwise(found)


def plain(entity: Column) -> Column:
    """The characters of an entity."""
    return F.translate(entity, TAG, "")


def names_of(text: Column, found: Column) -> Column:
    """The names among a text's entities that are not in the list, and those that are introduced, longest first."""
    listed = "|".join(f"^{n}$" for names in GIVEN.values() for n in names)
    own = F.filter(found, lambda e: e.rlike(rf"^{_WORD}$") & ~e.rlike(listed))
    introduced = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(INTRODUCED), F.lit(1)), lambda e: F.split(e, r"\s")))
    hint = reduce(Column.__or__, [text.contains(x) for x in INTRODUCTIONS])
    every = F.when(hint, F.concat(own, introduced)).otherwise(own)
    return F.reverse(F.transform(F.array_sort(F.transform(F.array_distinct(every), lambda e: F.struct(F.length(e).alias("n"), e.alias("e")))), lambda x: x["e"]))


def pattern(names: Column) -> Column:
    """``PATTERN``, and names wherever they stand."""
    alone = F.concat(F.lit(r"|(?<![\p{L}0-9])(?=\p{Lu})(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}0-9])"))
    return F.concat(F.lit(PATTERN), F.when(F.size(names) > 0, alone).otherwise(""))


def kind_of(value: Column) -> Column:
    """The kind of an entity: a tagged one is a secret, the others are told by their form."""
    names = "|".join(f"^{n}$" for names in GIVEN.values() for n in names)
    return (
        F.when(value.startswith(TAG), "secret")
        .when(value.contains("@"), "email")
        .when(value.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$"), "access_key")
        .when(value.rlike(rf"^(?:{KINDS['ip'].replace('(?<![0-9.])', '').replace('(?!\\.?[0-9])', '')})$"), "ip")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}$"), "national_id")
        .when(value.rlike(r"^(?:[0-9]{4}[ -]?){3}[0-9]{1,7}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}$"), "card")
        .when(value.rlike(r"^[A-Z]{2}[0-9]{2}[ 0-9A-Z]{12,}$"), "iban")
        .when(value.rlike(r"^[+(]?[0-9 .()/-]+$") & value.rlike("[ .()/+-]|^0[1-9][0-9]{7,9}$"), "phone")
        .when(value.rlike(names), "given")
        .when(value.rlike(rf"^{_WORD}$|^\p{{Lu}}\p{{L}}[\p{{L}}'-]*$"), "surname")
        .otherwise("secret")
    )


def _stream(key: str, value: Column, draw: Column) -> Column:
    """256 pseudorandom hex digits of an entity: SHA-256 over the key on both sides of the message."""
    part = lambda i: F.sha2(F.concat(F.lit(f"{key}\x00{i}\x00"), F.coalesce(draw.cast("string"), F.lit("0")), F.lit("\x00"), F.lower(value), F.lit(f"\x00{key}")), 256)
    return F.concat(*[part(i) for i in range(4)])


def _number(stream: Column, at: Column, most: int) -> Column:
    """A number below ``most`` from four digits of the stream."""
    return F.pmod(F.conv(F.substring(stream, F.pmod(at * 4, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int"), F.lit(most))


def _pick(stream: Column, at: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), _number(stream, at, len(letters)) + 1, F.lit(1))


def _same_format(value: Column, stream: Column) -> Column:
    """Every digit and letter drawn anew within its class; everything else stays."""
    hexa = value.rlike("^[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), _pick(stream, i, "0123456789"))
            .when(c.rlike("[a-f]") & hexa, _pick(stream, i, "abcdef"))
            .when(c.rlike("[a-z]"), _pick(stream, i, "abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), _pick(stream, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(value: Column) -> Column:
    """The value with its last digit set so that the checksum holds."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    places = F.transform(F.split(F.substring(digits, F.lit(2), F.length(digits) - 1), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(places, F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - 1), F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _surname(value: Column, stream: Column, draw: Column) -> Column:
    def of(script: str, ending: tuple[str, str]) -> Column:
        s = SYLLABLES[script]
        parts = F.transform(F.sequence(F.lit(1), F.lit(3) + F.floor(F.coalesce(draw, F.lit(0)) / 4).cast("int")), lambda i: F.element_at(F.array(*map(F.lit, s)), _number(stream, i, len(s)) + 1))
        return F.concat(F.array_join(parts, ""), F.when(value.rlike(f"(?i){ending[0]}$"), ending[1]).otherwise(""))

    word = F.when(value.rlike(r"^\p{IsCyrillic}"), of("cyrillic", ("а", "а"))).when(value.rlike(r"^\p{IsGreek}"), of("greek", ("α", "α"))).otherwise(of("latin", ("(?:ova|eva|ska)", "ova")))
    return F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word))))


def surrogate(value: Column, key: str, draw: Column | None = None) -> Column:
    """The surrogate of an entity at its ``draw``-th attempt (0 if not given)."""
    draw = F.lit(0) if draw is None else draw
    rotated = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x00{n}".encode()).hexdigest())
        rotated |= {n: order[(i + 1) % len(order)] for i, n in enumerate(order)}
    given = F.create_map(*[F.lit(x) for pair in rotated.items() for x in pair])
    prefix = r"^\+[0-9]{1,3}"

    def form(v: Column, kind: Column, stream: Column, new: Column) -> Column:
        """``new``: the value in its own format."""
        octet = lambda i: _number(stream, F.lit(i), 254) + 1
        country = F.regexp_extract(v, prefix, 0)
        more = F.substring(F.translate(stream, "abcdef", "012345"), F.lit(1), F.floor(draw / LONGER).cast("int"))
        long = F.concat(new, more)
        return (
            F.when(kind == "email", F.concat(F.substring_index(new, "@", 1), more, F.lit("@"), F.regexp_replace(F.substring_index(new, "@", -1), r"\.[^.]+$", ""), F.lit(".example")))
            .when(kind == "access_key", F.concat(F.substring(v, 1, 4), F.substring(new, F.lit(5), F.lit(16)), more))
            .when(kind == "ip", F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
            .when(kind == "card", _luhn(F.concat(F.substring(v, 1, 1), F.substring(long, F.lit(2), F.length(long) - 1))))
            .when(kind == "iban", F.concat(F.substring(v, 1, 2), F.substring(long, F.lit(3), F.length(long))))
            .when(kind == "phone", F.when(v.rlike(prefix + "[ .(-]"), F.concat(country, F.substring(long, F.length(country) + 1, F.length(long)))).otherwise(long))
            .when(kind == "given", F.element_at(given, v))
            .when(kind == "surname", _surname(v, stream, draw))
            .otherwise(long)
        )

    return _let(
        F.struct(plain(value).alias("v"), kind_of(value).alias("k"), _stream(key, value, draw).alias("s")),
        lambda x: _let(F.struct(x["v"].alias("v"), x["k"].alias("k"), x["s"].alias("s"), _same_format(x["v"], x["s"]).alias("f")), lambda y: form(y["v"], y["k"], y["s"], y["f"])),
    )


def exceptions(found: DataFrame, key: str) -> DataFrame | None:
    """entity, draw of the entities whose first surrogate was taken; ``found`` (entity) may repeat. None: none."""
    real = C.materialise(found.filter(kind_of(F.col("entity")) != "given").select("entity").distinct(), "entities")
    open_, placed, out = real.withColumn("draw", F.lit(0)), None, None
    for draw in itertools.count():
        tried = open_.select("entity", F.lit(draw).alias("draw")).withColumn("surrogate", surrogate(F.col("entity"), key, F.lit(draw)))
        tried = C.materialise(tried, "tried")  # the long expression stands in this plan alone
        free = tried.join(real.select(F.lower(plain(F.col("entity"))).alias("_s")).distinct(), F.lower("surrogate") == F.col("_s"), "left_anti")
        if placed is not None:
            free = free.join(placed.select(F.lower("surrogate").alias("_s")), F.lower("surrogate") == F.col("_s"), "left_anti")
        first = free.groupBy(F.lower("surrogate").alias("_s")).agg(F.min_by(F.struct("entity", "draw", "surrogate"), F.struct(F.lower("entity"), "entity")).alias("r"), F.min(F.lower("entity")).alias("_e"))
        # spellings of one entity that differ in case share a surrogate
        same = free.join(first.select(F.col("_s"), F.col("_e")), (F.lower("surrogate") == F.col("_s")) & (F.lower("entity") == F.col("_e"))).select("entity", "draw", "surrogate")
        same = C.materialise(same, "surrogates")
        placed = same if placed is None else placed.unionByName(same)
        if draw:
            out = same if out is None else out.unionByName(same)
        open_ = C.materialise(open_.join(same.select("entity"), "entity", "left_anti").select("entity"), "open")
        if not open_.limit(1).count():
            return None if out is None else out.select("entity", "draw")
    return None


def replace(text: Column, found: Column, names: Column, key: str, draws: Column | None = None) -> Column:
    """The text with its entities (``found``, in order) replaced; ``draws``: entity to draw of the exceptions."""
    one = lambda e: surrogate(e, key, None if draws is None else F.coalesce(F.try_element_at(draws, e), F.lit(0)))
    new = F.concat(F.transform(found, one), F.array(F.lit("")))
    woven = F.array_join(F.zip_with(F.split(text, pattern(names), -1), new, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    return F.when(F.size(found) > 0, woven).otherwise(text)


def _exploded(found: str) -> Column:
    """``found`` exploded with a null for none, to be filtered later: the filter that Spark makes of a plain ``explode``
    goes below the projection, where the patterns of ``found`` are written out, and matched, dozens of times."""
    return F.explode_outer(found).alias("entity")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "_n_entities") -> DataFrame:
    """``docs`` with its text replaced, and the number of entities as ``count`` (long)."""
    docs = docs.drop(count)
    first, names, found, ident, mine = C.unused(docs, "_first", "_names", "_found", "_ident", "_draws")
    seen = docs.withColumn(text, F.col(text).cast("string")).withColumn(first, entities(F.col(text))).withColumn(names, names_of(F.col(text), F.col(first)))
    seen = seen.withColumn(found, F.when(F.size(names) > 0, entities(F.col(text), F.col(names))).otherwise(F.col(first))).drop(first)
    late = exceptions(seen.select(_exploded(found)).filter("entity is not null"), key)
    draws = None
    if late is not None:
        late = C.materialise(late, "late")
        of_text = F.md5(F.col(text).cast("binary"))
        touched = seen.select(of_text.alias(ident), _exploded(found)).filter("entity is not null").distinct().join(late, "entity")
        touched = C.materialise(touched.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("entity", "draw"))).alias(mine)), "touched")
        if touched.count() <= 20_000:  # rows of a hash and a few entities; beyond that the join shuffles
            touched = F.broadcast(touched)
        seen = seen.withColumn(ident, of_text).join(touched, ident, "left")
        draws = F.coalesce(F.col(mine), F.from_json(F.lit("{}"), "map<string,int>"))
    n = F.coalesce(F.size(found), F.lit(0)).cast("long")
    out = seen.withColumn(count, F.greatest(n, F.lit(0))).withColumn(text, replace(F.col(text), F.col(found), F.col(names), key, draws))
    return out.select(*docs.columns, count)
