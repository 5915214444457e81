"""Personal data replaced by surrogates, with built-in functions only.

Each entity is replaced by a value of its own type and format that a key and the entity alone
determine, so an entity has one surrogate everywhere. The units that have surrogates are whole values
and, of names, first names (by gender) and family names each: "Mr John Smith", "Mr Smith" and, in the same
document, a bare "John Smith" or "Smith" agree. All distinct units' surrogates are then checked: of those
that coincide with one another, or with a unit of the corpus, all but one are drawn again, until all
differ; from the second redraw on, names, emails and phone numbers get longer, so that those of a format
with few values find one too. The few units that were drawn more than once are joined back to their
documents; every other surrogate is computed where it is needed.

Names are found by the titles of TITLES, and elsewhere in a document that has them. Family names keep
Latin, Greek or Cyrillic script; those in another script become Latin. Cards get a check digit that is
right (Luhn), IBANs check digits that are right (modulo 97).
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, table, unused

#: Titles by gender and script; the words after them are a name.
TITLES = {
    ("male", "latin"): ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor"),
    ("female", "latin"): ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita"),
    ("male", "cyrillic"): ("господин", "Господин"),
    ("female", "cyrillic"): ("госпожа", "Госпожа"),
}
FIRST_NAMES = {
    ("male", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"),
    ("male", "greek"): ("Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Ιωάννης", "Κώστας", "Λεωνίδας", "Μιχάλης", "Νίκος", "Πέτρος", "Σπύρος", "Τάσος", "Φίλιππος", "Χρήστος"),
    ("female", "greek"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Ουρανία", "Σοφία", "Χριστίνα"),
    ("female", "latin"): ("Ada", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irma", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula"),
    ("male", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Тимур"),
    ("female", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"),
}
#: Family names, and first names drawn again, are made of these.
SYLLABLES = {"greek": ("βα", "δελ", "φι", "γορ", "χεν", "καλ", "λο", "μαρ", "νε", "περ", "ρι", "σολ", "ταν", "βερ", "βιλ", "ζο"), "latin": ("ba", "del", "fi", "gor", "hen", "kal", "lo", "mar", "ne", "per", "ri", "sol", "tan", "ver", "wil", "zo"), "cyrillic": ("ба", "дел", "фи", "гор", "хен", "кал", "ло", "мар", "не", "пер", "ри", "сол", "тан", "вер", "вил", "зо")}

_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_TITLED = rf"(?=[{''.join(sorted({t[0] for titles in TITLES.values() for t in titles}))}])(?<!\p{{L}})(?:{_TITLE})\.?"
#: A capitalised word; what is after its apostrophe is part of it, but for an s.
_NAMED = r"\p{Lu}\p{L}*(?:['-](?!s(?!\p{L}))\p{L}+)*"
_NAME = rf"{_TITLED} {_NAMED}(?: {_NAMED})?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kinds and their patterns; where several match at one place the first counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": _NAME,
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must have for any pattern to match.
_HINT = rf"@|[0-9][0-9]|[0-9]\.[0-9]|{_TITLED} \p{{Lu}}"
#: Redraws before giving up: reached only if a format that doesn't grow has hardly more values than there are entities.
ROUNDS = 64


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for kind in reversed(KINDS[:-1]):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _draw(key: str, attempt: Column, what: Column) -> Column:
    """256 hex digits from the key, the attempt and what is to be replaced."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(f"{key}:{block}"), attempt.cast("string"), what), 256) for block in range(4)))


def _number(digest: Column, i: Column | int) -> Column:
    """The i-th of 64 numbers from 0 to 65535 in a draw."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands around entities in a marked text; texts that hold it are marked without it in two steps.
_MARK = "\u0000"


def _shifted(c: Column, n: Column, alphabet: str) -> Column:
    """Another character of the alphabet, n of a draw deciding which."""
    size = len(alphabet)
    return F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) + F.pmod(n, F.lit(size - 1)), F.lit(size)) + 1, F.lit(1))


def _same_format(value: Column, digest: Column, kept: Column | int = 0) -> Column:
    """Other digits for digits and other letters of the same case for letters, from the ``kept``-th character
    on; a first digit that isn't 0 doesn't become 0."""

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        digit = F.when((i == kept) & (c != "0"), _shifted(c, n, "123456789")).otherwise(_shifted(c, n, "0123456789"))
        drawn = F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), _shifted(c, n, _LOWER)).when(c.rlike("[A-Z]"), _shifted(c, n, _UPPER)).otherwise(c)
        return F.when(i < kept, c).otherwise(drawn)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _luhn(card: Column) -> Column:
    """A card number of 16 digits with the last one set right."""
    digits = F.split(F.regexp_replace(card, "[^0-9]", ""), "")
    doubled = F.transform(digits, lambda d, i: F.when(i == 15, 0).when(i % 2 == 0, F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + x)
    return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _iban(value: Column) -> Column:
    """An IBAN with its check digits (third and fourth) set right."""
    bare = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 2), F.lit("00"))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), F.pmod(s * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(s * 100 + F.instr(F.lit(_UPPER), c) + 9, F.lit(97))))
    return F.concat(F.substring(value, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(value, F.lit(5), F.length(value)))


def title_of(name: Column) -> Column:
    return F.regexp_extract(name, rf"^(?:{_TITLE})\.? ", 0)


def words_of(name: Column) -> Column:
    """One or two words after a title."""
    return F.split(F.substring(name, F.length(title_of(name)) + 1, F.length(name)), " ")


def _gender(title: Column) -> Column:
    male = "|".join(t for (g, _), ts in TITLES.items() if g == "male" for t in ts)
    return F.when(title.rlike(rf"^(?:{male})\.? $"), "male").otherwise("female")


def units_of(value: Column) -> Column:
    """The units of a value, kind and what: itself or, of a name, its family name after its first name."""

    def named(words: Column) -> Column:
        family = F.struct(F.lit("family").alias("kind"), F.lower(F.element_at(words, -1)).alias("what"))
        first = F.struct(_gender(title_of(value)).alias("kind"), F.lower(F.get(words, F.lit(0))).alias("what"))
        return F.when(F.size(words) > 1, F.array(first, family)).otherwise(F.array(family))

    return F.when(title_of(value) != "", _let(words_of(value), named)).otherwise(F.array(F.struct(kind_of(value).alias("kind"), value.alias("what"))))


def drawn_for(kind: Column, what: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit. An email's domain has a surrogate of its own, but for its last label; a phone
    number keeps its country code, a card its first digit, an IBAN its country."""
    # So many syllables, letters or pairs of digits more: each makes at least 16 times as many values.
    more = F.floor(attempt / 2).cast("int")

    def by_kind(whole: Column) -> Column:
        domain, last = F.regexp_extract(what, r"@(.*)\.", 1), F.regexp_extract(what, r"\.[A-Za-z]+$", 0)
        email = F.concat(_same_format(F.concat(F.regexp_extract(what, "^[^@]*", 0), F.repeat(F.lit("a"), more)), whole), F.lit("@"), _let(_draw(key, F.lit(0), domain), lambda d: _same_format(domain, d)), last)
        octets = F.array_join(F.transform(F.split(what, r"\."), lambda o, i: (F.pmod(o.cast("int") + F.pmod(_number(whole, i), F.lit(253)), F.lit(254)) + 1).cast("string")), ".")
        code = F.length(F.regexp_extract(what, r"^\+[0-9]{1,3}(?=[ .(-])", 0))
        # A phone number with a country code has a pair of digits to spare for each redraw but one.
        grown = F.when((kind == "phone") & what.startswith("+"), F.concat(what, F.repeat(F.lit("00"), more))).otherwise(what)
        other = _same_format(grown, whole, F.when(kind == "phone", code).when(kind == "card", 1).when(kind == "iban", 2).otherwise(0))
        script = F.when(what.rlike(r"\p{IsCyrillic}"), "cyrillic").when(what.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

        lists = {name: F.array(*map(F.lit, values)) for name, values in SYLLABLES.items()}
        parts = F.when(script == "cyrillic", lists["cyrillic"]).when(script == "greek", lists["greek"]).otherwise(lists["latin"])
        given = F.lit(None).cast("array<string>")
        for (gender, name), values in FIRST_NAMES.items():
            given = F.when((kind == gender) & (script == name), F.array(*map(F.lit, values))).otherwise(given)
        # A first name that was drawn again is made, as there are few given ones.
        least = F.when(kind == "family", 4).otherwise(3)
        composed = _let(parts, lambda p: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), more + least - 1), lambda i: F.get(p, F.pmod(_number(whole, i + 1), F.size(p)))), "")))
        picked = _let(given, lambda g: F.get(g, F.pmod(_number(whole, 0), F.size(g))))
        return (
            F.when(kind == "email", email).when(kind == "ip", octets).when(kind.isin("male", "female") & (attempt < 2), picked).when(kind.isin("family", "male", "female"), composed)
            .when(kind == "card", _luhn(other)).when(kind == "iban", _iban(other)).otherwise(other)
        )

    return _let(_draw(key, attempt, F.concat_ws("\x1f", kind, what)), by_kind)


def surrogate(value: Column, attempts: Column, key: str) -> Column:
    """What replaces ``value``: its units' surrogates, the title of a name and its words' capitals kept.
    attempts: a map of "kind<unit separator>what" to attempts, for units that aren't at their first."""

    def made(unit: Column, word: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", unit["kind"], unit["what"])), F.lit(0))
        shouted = unit["kind"].isin("family", "male", "female") & (F.length(word) > 1) & (word == F.upper(word))
        return _let(drawn_for(unit["kind"], unit["what"], attempt, key), lambda s: F.when(shouted, F.upper(s)).otherwise(s))

    def joined(title: Column) -> Column:
        words = F.when(title == "", F.array(value)).otherwise(words_of(value))
        return F.concat(title, F.array_join(F.zip_with(units_of(value), words, made), " "))

    return _let(title_of(value), joined)


def redrawn(units: DataFrame, key: str) -> DataFrame:
    """(kind, what, attempt) of those distinct ``units`` (kind, what) whose first surrogate isn't theirs to keep."""
    same = ["kind", "what"]
    taken = F.lower(F.col("what")).alias("used")
    pending, taken, moved = units.withColumn("attempt", F.lit(0)), units.select("kind", taken), None
    for _ in range(ROUNDS):
        drawn = materialize(pending.withColumn("drawn", F.lower(drawn_for(F.col("kind"), F.col("what"), F.col("attempt"), key))), "surrogates")
        # One unit of those that drew a surrogate may have it, unless it is taken.
        own = drawn.groupBy("kind", "drawn").agg(F.min(F.struct("what", "attempt")).alias("o")).select("kind", "drawn", "o.*")
        own = materialize(own.join(taken.withColumnRenamed("used", "drawn"), ["kind", "drawn"], "left_anti"), "own_surrogates")
        pending = materialize(drawn.join(own, same, "left_anti").select(*same, (F.col("attempt") + 1).alias("attempt")), "redraw")
        now = own.where("attempt > 0").select(*same, "attempt")
        moved = now if moved is None else moved.unionByName(now)
        if pending.isEmpty():
            return moved
        taken = taken.unionByName(own.select("kind", F.col("drawn").alias("used")))
    raise RuntimeError("more entities of a format than it has values")


def marked(text: Column) -> Column:
    """A text with _MARK before and after each entity; null where there is none. A text that holds the mark
    has it replaced by a blank there."""
    plain = F.translate(text, _MARK, " ")
    found = F.when(text.rlike(_HINT), F.regexp_replace(plain, _ANY, f"{_MARK}$0{_MARK}"))
    return F.when(F.contains(found, F.lit(_MARK)), found)


def _with_bare_names(pieces: Column) -> Column:
    """Pieces of a marked text (entities at odd places), with the names of its titled people marked where
    they stand without a title."""
    people = F.filter(pieces, lambda x, i: (i % 2 == 1) & (title_of(x) != ""))
    # Full names first, so that they are taken before their family names; letters, ' and - need no escape.
    names = F.array_distinct(F.concat(F.transform(F.filter(people, lambda x: F.size(words_of(x)) > 1), lambda x: F.array_join(words_of(x), " ")), F.transform(people, lambda x: F.element_at(words_of(x), -1))))

    def mark(names: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![\p{L}'-])(?:"), F.array_join(names, "|"), F.lit(r")(?!['-]?\p{L}(?<!'s))"))
        again = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(_MARK), x, F.lit(_MARK))).otherwise(F.regexp_replace(x, pattern, F.lit(f"{_MARK}$0{_MARK}"))))
        return F.split(F.array_join(again, ""), _MARK)

    return _let(names, lambda n: F.when(F.size(n) > 0, mark(n)).otherwise(pieces))


def _titled(value: Column, pieces: Column) -> Column:
    """A bare name with the title that it has elsewhere in the document; other values as they are."""
    found = F.filter(pieces, lambda x, i: (i % 2 == 1) & (title_of(x) != "") & F.endswith(x, F.concat(F.lit(" "), value)))
    return F.when((kind_of(value) == "name") & (title_of(value) == ""), F.get(found, F.lit(0))).otherwise(value)


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities in text replaced; adds entities (array of value, surrogate), null where
    there are none, in place of a column of that name. Texts without entities, null and empty ones stay as
    they are; so do all rows, repeated ones and null doc_ids too. Rows that share a doc_id share the
    attempts of their units, nothing else; equal values have equal surrogates in all rows."""
    pieces, row, own, moved, drawn = unused(docs, "pieces", "row", "own_row", "moved", "drawn")
    tagged = docs.withColumn(pieces, F.split(marked(F.col("text")), _MARK)).withColumn(row, F.monotonically_increasing_id())
    tagged = materialize(tagged, "marked")
    values = F.array_distinct(F.filter(F.col(pieces), lambda x, i: i % 2 == 1))
    occurrences = tagged.where(F.col(pieces).isNotNull()).select(F.col(row).alias("row"), F.explode(F.array_distinct(F.flatten(F.transform(values, units_of)))).alias("u")).select("row", "u.*")
    occurrences = materialize(occurrences, "units")
    again = redrawn(occurrences.select("kind", "what").distinct(), key)
    entry = F.struct(F.concat_ws("\x1f", "kind", "what"), "attempt")
    by_row = occurrences.join(again, ["kind", "what"]).groupBy(F.col("row").alias(own)).agg(F.map_from_entries(F.collect_list(entry)).alias(moved))
    by_row = materialize(by_row, "redrawn_by_row")
    joined = tagged.join(by_row, F.col(row) == F.col(own), "left")
    attempts = F.coalesce(F.col(moved), F.create_map().cast("map<string,int>"))
    joined = joined.withColumn(pieces, F.when(F.col(pieces).isNotNull(), _with_bare_names(F.col(pieces))))

    def replaced(x: Column) -> Column:
        def fitted(full: Column) -> Column:
            s = surrogate(full, attempts, key)
            return F.struct(x.alias("value"), F.when(full == x, s).otherwise(F.array_join(F.slice(F.split(s, " "), -F.size(F.split(x, " ")), F.size(F.split(x, " "))), " ")).alias("surrogate"))

        return _let(_titled(x, F.col(pieces)), fitted)

    joined = joined.withColumn(drawn, F.transform(F.filter(F.col(pieces), lambda x, i: i % 2 == 1), replaced))
    text = F.array_join(F.transform(F.col(pieces), lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get(F.col(drawn), F.floor(i / 2).cast("int"))["surrogate"])), "")
    text = F.when(F.col(pieces).isNotNull(), text).otherwise(F.col("text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "entities"), F.col(drawn).alias("entities"))


def surrogate_report(docs: DataFrame, key: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_entities, the number of each kind, text with surrogates."""
    done = replace_personal_data(docs.select("doc_id", "text"), key)
    kinds = F.transform(F.coalesce("entities", F.array().cast("array<struct<value:string,surrogate:string>>")), lambda e: kind_of(e["value"]))
    done = done.withColumn("kinds", kinds)
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", F.size("kinds").cast("bigint").alias("n_entities"), *counts, "text")


#: Where the session keeps the key of a release.
KEY_SETTING = "spark.tessera.surrogateKey"


def release_key(spark: SparkSession) -> str:
    """The session's key, or without one a key that nobody knows: surrogates are then the same within a run only."""
    if found := spark.conf.get(KEY_SETTING, None):
        return found
    warnings.warn(f"{KEY_SETTING} isn't set: a random key is drawn, and other runs will have other surrogates", stacklevel=2)
    return f"{uuid.uuid4().hex}{uuid.uuid4().hex}"


def op10_pii(spark, sf_dir):
    return surrogate_report(table(spark, sf_dir, "documents"), release_key(spark))
