"""Surrogates for personal data and secrets, by SQL expressions alone.

Entities are found by one combined pattern, once.  Every distinct entity of the
corpus gets one surrogate from a keyed hash, so mentions of one entity stay
mentions of one entity, also where they are spelt otherwise: addresses of mail in
other capitals, numbers in other groups, a surname after another title or given
name.  A surrogate is drawn for the canonical form and poured into the layout of
each spelling; it has the entity's type, its layout character by
character (digit for digit, letter for letter of the same case and script) and,
for persons, the gender of their given name or else of their title.  Rounds of joins check that no
surrogate equals another's or any entity of the corpus; those that do are drawn
again, and lengthened where their layout has too few values, so drawing ends
whatever the corpus holds.  Signs alone ('Password: ________') are no entity.
Texts without entities pass; only the others are joined, hot ones by broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import meet
from tickloom.llm.scratch import Scratch

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles before names, by the gender they tell.
TITLES = {"m": ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mademoiselle", "Госпожа"), "": ("Dr", "Prof")}
_MALE, _FEMALE, _ANY = (f"(?:{'|'.join(v)})" for v in TITLES.values())
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_ANY})\.? "
#: Small words inside surnames, which stay.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "zu", "bin", "ibn", "al", "el")
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) )*+"
_REST = r"(?:['’](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]++|-[\p{L}\p{M}]++)*+"
# no repeated group of the patterns gives back what it took: Java's matcher would recurse once a repeat, and a list of names would end the stack
# titles, a first name word or initial, further ones, and words all in capitals
_PERSON = (
    rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})++{_PART}(?!{_TITLE.rstrip()}(?![\p{{L}}\p{{M}}'’-]))(?:\p{{Lu}}\.(?= (?:{'|'.join(p + ' ' for p in PARTICLES)}|\p{{Lu}}))|\p{{Lu}}[\p{{L}}\p{{M}}]*+{_REST})"
    rf"(?: {_PART}(?:\p{{Lu}}\.(?= (?:{'|'.join(p + ' ' for p in PARTICLES)}|\p{{Lu}}))|\p{{Lu}}(?= {_PART}\p{{Lu}}\p{{L}})|\p{{Lu}}\p{{M}}*+(?:['’]\p{{Lu}})?\p{{Lu}}*+\p{{Ll}}[\p{{L}}\p{{M}}]*+{_REST}))*+(?: {_PART}\p{{Lu}}\p{{M}}*+(?:['’-]?\p{{Lu}}\p{{M}}*+)++(?![\p{{L}}\p{{M}}]))*+"
)
#: Given names that tell persons without a title, by gender; none of them is a common word, a place or a month.
GIVEN = {
    "m": (
        "Ahmed", "Alejandro", "Alexander", "Andreas", "Andrew", "Anthony", "Antonio", "Brian", "Carlos", "Charles", "Christian", "Christopher", "Daniel", "David", "Diego", "Edward", "Eric", "Fernando", "François", "Frédéric",
        "George", "Hans", "Henry", "Ivan", "Jacques", "James", "Javier", "Jean", "Johannes", "John", "Jonathan", "José", "Joseph", "Juan", "Jürgen", "Karl", "Kevin", "Klaus", "Laurent", "Luis", "Manuel", "Martin", "Matthew",
        "Michael", "Michel", "Mohammed", "Nicolas", "Olivier", "Pablo", "Patrick", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Robert", "Sebastian", "Stefan", "Stephen", "Steven", "Thomas", "Timothy", "Wolfgang",
        "Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий",
    ),
    "f": (
        "Alice", "Amanda", "Andrea", "Angela", "Anna", "Anne", "Barbara", "Birgit", "Camille", "Carmen", "Caroline", "Catherine", "Christine", "Claudia", "Deborah", "Elena", "Elizabeth", "Emily", "Emma", "Fatima",
        "Françoise", "Gabriela", "Hannah", "Heike", "Helen", "Isabel", "Isabelle", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Laura", "Linda", "Lisa", "Lucía", "Margaret", "Maria", "María", "Marie", "Marta", "Mary",
        "Michelle", "Monika", "Nathalie", "Nicole", "Olga", "Patricia", "Petra", "Rebecca", "Sabine", "Sandra", "Sarah", "Sophie", "Stephanie", "Susan", "Ursula", "Valérie",
        "Анна", "Галина", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна",
    ),
}
_KNOWN = f"(?:{'|'.join(GIVEN['m'] + GIVEN['f'])})"
_SURNAME = r"\p{Lu}\p{M}*+(?:['’]\p{Lu})?\p{Lu}*+\p{Ll}"
_INITIALS = r"(?:\p{Lu}\. )*+"
_DOUBLE = r"(?:-\p{Lu}\p{Ll}++)?"
# a known given name, more of them and initials as long as a surname is left, and a surname not all in capitals
_NAMED = (
    rf"(?<![\p{{L}}\p{{N}}'’-])(?=\p{{Lu}}){_KNOWN}{_DOUBLE}(?: {_INITIALS}{_KNOWN}{_DOUBLE}(?= {_INITIALS}{_PART}{_SURNAME}))*+"
    rf" {_INITIALS}{_PART}{_SURNAME}[\p{{L}}\p{{M}}]*+{_REST}"
)
_LABEL = r"[\p{L}\p{N}-]++"
_ODD_LABELS = rf"(?:\.(?!\p{{L}}{{2}}){_LABEL})*+"
#: Type and pattern, the first that matches at a place wins.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![\p{L}\p{N}._%+-])(?![._%+-]++@[.-]++\p{L}++(?![\p{L}\p{N}.-]))[\p{L}\p{N}._%+-]++@" + _LABEL + rf"(?:{_ODD_LABELS}\.{_LABEL}(?={_ODD_LABELS}\.\p{{L}}{{2}}))*+{_ODD_LABELS}\.\p{{L}}{{2,}}+"),
    ("secret", r"(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[+/_.~-]*+[A-Za-z0-9])[A-Za-z0-9+/_.~-]{6,}+"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)"),
    ("phone", r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d)"),
    ("phone", r"(?<![\p{L}\p{N}+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)"),
    ("ssn", r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"),
    ("card", r"(?<![\p{L}\p{N}])(?:\d{4}[ -]?){3}\d{4}(?!\d)"),
    ("ip", rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"),
    ("person", _PERSON),
    ("person", _NAMED),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
_SECRET_HEAD = r"^(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?"
#: With words in capitals beside them, which may be the bare surnames of persons of the text; none that begins a secret.
WITH_BARE = PATTERN + r"|(?:(?<![\p{L}\p{N}'’_-])\p{Lu}[\p{L}\p{M}]*+" + _REST + r"(?<!(?i:password|passwd|secret|token|key|api))(?![\p{L}\p{N}_@-]))"
#: A text with an entity has one of these: a class of signs, or a title or given name by any first letter and any rest, which fails fast.
_SPELT = sorted({t for v in (*TITLES.values(), *GIVEN.values()) for t in v})
HINT = "[0-9@=:]|[" + "".join(sorted({t[0] for t in _SPELT})) + "](?:" + "|".join(sorted({t[1:] for t in _SPELT}, key=len)) + r")(?:-\p{Lu}\p{Ll}++|\.)? (?:\p{Lu}|(?:" + "|".join(PARTICLES) + ") )"

#: Given names and surnames for surrogates of persons.
NAMES = {
    "latin": {"m": ("Adrian", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon"), "f": ("Alma", "Clara", "Diana", "Elena", "Flora", "Greta", "Irene", "Julia", "Laura", "Nora")},
    "cyrillic": {"m": ("Антон", "Борис", "Виктор", "Глеб", "Денис"), "f": ("Анна", "Вера", "Дарья", "Инна", "Мария")},
}
SURNAMES = {
    "latin": ("Abel", "Berger", "Costa", "Dupont", "Engel", "Ferrer", "Garnier", "Holm", "Ibsen", "Jansen", "Keller", "Lorenz", "Moreau", "Navarro", "Olsen", "Petit", "Quist", "Romero", "Stein", "Torres"),
    "cyrillic": ("Белов", "Волков", "Громов", "Зуев", "Котов", "Лосев", "Орлов", "Соколов"),
}


def entity_type(value: Column) -> Column:
    """The type of an entity from its own text, by the order of PATTERNS."""
    out = F.lit("other")
    for name, pattern in reversed(PATTERNS):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _pick(options: tuple[str, ...] | str, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


#: Character classes and the letters they are replaced by, the first that fits.
LAYOUT: tuple[tuple[str, str], ...] = (
    (r"[0-9]", "0123456789"),
    (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsCyrillic}&&\p{L}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"[\p{IsGreek}&&\p{L}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{Lu}", "ÁÀÂÄÉÈÊËÍÎÓÔÖÚÜÑÇ"),
    (r"\p{L}", "áàâäéèêëíîóôöúüñç"),
    (r"\p{N}", "0123456789"),
)
#: Draws after which an entity of few replaceable signs is lengthened, as its layout may have no free value.
SAME_LAYOUT = 4
#: Draws after which any other entity gets 16 digits more, as its type's own space is full.
LAST_LAYOUT = 12
#: Types whose mentions are one entity if their letters and digits agree.
GROUPED = ("phone", "iban", "card", "ssn")


#: Kinds of the words that names of persons are made of.
NAME_KINDS = ("surname", "given_m", "given_f", "given_")


def name_parts(persons: DataFrame, key: str) -> DataFrame:
    """(person, pos, value, kind, fixed) of the words of *persons* (value), person being a digest of the whole name; fixed ones need no surrogate drawn.

    Titles and particles stay, initials move along their alphabet by the key; a
    known given name keeps its own gender, another one takes the title's.
    """
    v = F.col("value")
    titles = F.regexp_extract(v, f"^(?:{_TITLE})+", 0)
    words = F.split(F.substring(v, F.length(titles) + 1, F.length(v)), " ")
    given = F.when(titles.rlike(rf"(?:^| ){_FEMALE}\.? "), "given_f").when(titles.rlike(rf"(?:^| ){_MALE}\.? "), "given_m").otherwise("given_")
    shift = 1 + int(hashlib.sha256(key.encode()).hexdigest(), 16) % 23
    spelt = ["".join(x for _, x in LAYOUT if x[0] == c) for c in "AАΑ"]
    moved = F.translate("value", "".join(spelt), "".join(x[shift:] + x[:shift] for x in spelt))
    person = F.sha2(v, 256).alias("person")
    # what is said of the whole name is worked out before its words are rows
    told = persons.select(person, titles.alias("titles"), given.alias("given"), words.alias("words"))
    parts = told.withColumn("n", F.size("words")).select("person", "given", "n", F.posexplode("words").alias("pos", "value"))
    first = F.substring_index("value", "-", 1)
    kind = F.when(F.col("pos") == F.col("n") - 1, "surname").when(v.isin(*PARTICLES) | v.rlike(r"^\p{Lu}\.?$"), "fixed").when(first.isin(*GIVEN["f"]), "given_f").when(first.isin(*GIVEN["m"]), "given_m").otherwise(F.col("given"))
    parts = parts.select("person", "pos", "value", kind.alias("kind"), F.when(v.rlike(r"^\p{Lu}\.?$"), moved).otherwise(v).alias("fixed"))
    heads = persons.where(titles != "").select(person, F.lit(-1).alias("pos"), F.rtrim(titles).alias("value"), F.lit("fixed").alias("kind"), F.rtrim(titles).alias("fixed"))
    return heads.unionByName(parts)


def canonical(value: Column, kind: Column) -> Column:
    """The form that all spellings of an entity share: mail in small letters, numbers without what groups their signs, a secret without its name."""
    return F.when(kind == "email", F.lower(value)).when(kind == "secret", F.regexp_replace(value, _SECRET_HEAD, "")).when(kind.isin(*GROUPED), F.regexp_replace(value, r"[^\p{L}\p{N}+]", "")).otherwise(value)


def poured(value: Column, kind: Column, surrogate: Column) -> Column:
    """*surrogate* (of the canonical form) in the layout of *value*: its capitals, or its groups; what is longer follows."""
    chars, rest = F.split(value, ""), F.length(value) + 1
    cased = F.array_join(F.zip_with(chars, F.slice(F.split(surrogate, ""), F.lit(1), F.greatest(F.size(chars), F.lit(0))), lambda c, x: F.when(c != F.lower(c), F.upper(x)).otherwise(x)), "")
    bare = F.regexp_replace(surrogate, r"^\+", "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))
    step = lambda a, c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(a["out"], F.substring(bare, a["n"], 1)).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))
    done = F.aggregate(chars, start, step)
    left = F.substring(bare, done["n"], F.length(bare))
    grouped = F.concat(done["out"], F.when(left == "", "").otherwise(F.concat(F.lit(" "), left)))
    named = F.concat(F.regexp_extract(value, _SECRET_HEAD, 0), surrogate)
    return F.when(kind == "secret", named).when(kind == "email", F.concat(cased, F.substring(surrogate, rest, F.length(surrogate)))).when(kind.isin(*GROUPED), grouped).otherwise(surrogate)


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Add column surrogate to (value, kind, attempt): same type, layout, case and script."""
    v, k = F.col("value"), F.col("kind")
    seed = F.concat_ws("\x1f", F.lit(key), k, v, F.col("attempt").cast("string"))
    df = entities.withColumn("stream", F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 512) for i in range(2)]))
    head = (
        F.when(k == "access_key", F.substring(v, 1, 4))
        .when(k == "phone", F.regexp_extract(v, r"^\+(?:1|7|\d{2})", 0))
        .when(k == "iban", F.substring(v, 1, 2))
        .otherwise("")
    )
    df = df.withColumn("head", head).withColumn("tail", F.when(k == "email", F.regexp_extract(v, r"\.\p{L}+$", 0)).otherwise(""))
    df = df.withColumn("body", F.substring(v, F.length("head") + 1, F.length(v) - F.length("head") - F.length("tail")))
    df = df.withColumn("hex", F.col("body").rlike(r"^[0-9a-f]{12,}$"))

    def number(at: Column | int, digits: int = 3) -> Column:
        return F.conv(F.substring(F.col("stream"), at if isinstance(at, Column) else F.lit(at), F.lit(digits)), 16, 10).cast("long")

    def one(c: Column, i: Column) -> Column:
        n = number(F.pmod(i * 3, F.lit(252)) + 1)
        out = F.when(F.col("hex") & c.rlike("[a-f]"), _pick("abcdef", n))
        for test, letters in LAYOUT:
            out = out.when(c.rlike(test), _pick(letters, n))
        return out.otherwise(c)

    layout = F.array_join(F.transform(F.split("body", ""), one), "")
    octets = F.concat_ws(".", *[(1 + F.pmod(number(1 + 4 * i, 4), F.lit(254))).cast("string") for i in range(4)])

    def name(script: str) -> Column:
        given, family = NAMES[script], SURNAMES[script]
        short = F.when(k == "given_f", _pick(given["f"], number(1))).when(k == "given_m", _pick(given["m"], number(1))).otherwise(_pick(given["m"] + given["f"], number(1)))
        # a further part a draw, so that there is a name for every person
        more = F.transform(F.sequence(F.lit(1), F.col("attempt")), lambda i: F.lower(_pick(family, number(F.pmod(i * 3, F.lit(228)) + 25))))
        more = F.when(F.col("attempt") > 0, F.array_join(more, "")).otherwise("")
        return F.concat(F.when(k == "surname", F.concat(_pick(family, number(9)), F.lower(_pick(family, number(17))))).otherwise(short), more)

    names = F.when(v.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin"))
    # short layouts run out: later draws add letters, or groups of digits a phone number has room for
    late = F.greatest(F.col("attempt") - (SAME_LAYOUT - 1), F.lit(0))
    spare = F.sha2(F.concat(seed, F.lit("\x1fspare")), 512)
    letters = F.substring(F.translate(spare, "0123456789abcdef", "abcdefghijklmnop"), F.lit(1), 2 * late)
    digits = F.translate(spare, "abcdef", "012345")
    # numbers have 15 digits at most
    roomy = (k == "phone") & v.rlike(r"^\+\d{1,11}$")
    full = F.when(F.col("attempt") >= LAST_LAYOUT, F.substring(digits, 1, 16)).otherwise("")
    extra = F.when(late == 0, "").when(k.isin("email", "secret", "other"), letters).when(roomy & (F.col("attempt") < LAST_LAYOUT), F.substring(digits, 1, 4)).otherwise(full)
    df = df.withColumn("made", F.when(k == "ip", F.concat(octets, F.when(full != "", F.concat(F.lit("."), full)).otherwise(""))).when(k.isin(*NAME_KINDS), names).otherwise(F.concat("head", layout, extra, "tail")))
    bare = F.regexp_replace(v, r"\D", "")
    base = F.col("made").substr(F.lit(1), F.length("made") - 1)
    check = F.pmod(10 - _luhn(F.concat(F.regexp_replace(base, r"\D", ""), F.lit("0"))), F.lit(10)).cast("string")
    df = df.withColumn("surrogate", F.when((k == "card") & (_luhn(bare) == 0), F.concat(base, check)).otherwise(F.col("made")))
    return df.select(*entities.columns, "surrogate")


def surrogate_table(values: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(value, kind, attempt, surrogate) of distinct *values*, off the corpus and one to one between entities.

    A surrogate that equals an entity of the corpus, or one already given, is
    drawn again with the next attempt; of several drawn alike in a round the
    least value keeps it.  Persons get theirs word by word: one for a surname
    whatever stands before it, and one for a given name of one gender, each one
    to one, so whole names are as well.
    """
    kinds = values.select("value", entity_type(F.col("value")).alias("kind")).withColumn("canon", canonical(F.col("value"), F.col("kind")))
    kinds = scratch.put(kinds, "kinds")
    parts = scratch.put(name_parts(kinds.where("kind = 'person'").select("value"), key), "parts")
    units = scratch.put(kinds.where("kind <> 'person'").select(F.col("canon").alias("value"), "kind").distinct().unionByName(parts.where("kind <> 'fixed'").select("value", "kind").distinct()), "units")
    # entities share one space of surrogates, surnames have one and given names of any gender
    space = F.when(F.col("kind") == "surname", "surname").when(F.col("kind").isin(*NAME_KINDS), "given").otherwise("")
    real = units.select(F.col("value").alias("surrogate"), space.alias("space"), F.lit(True).alias("real"))
    todo, done, step = units.withColumn("attempt", F.lit(0)), None, 0
    while True:
        drawn = scratch.put(with_surrogates(todo, key).withColumn("space", space), f"drawn{step}")
        taken = drawn.groupBy("space", "surrogate").agg(F.min("value").alias("owner"))
        bad = drawn.join(taken, ["space", "surrogate"]).withColumn("second", F.col("value") != F.col("owner"))
        seen = real if done is None else real.unionByName(done.select("surrogate", "space", F.lit(True).alias("real")))
        checked = scratch.put(bad.join(seen.distinct(), ["space", "surrogate"], "left").withColumn("ok", ~F.col("second") & F.col("real").isNull()).select("value", "kind", "attempt", "surrogate", "space", "ok"), f"checked{step}")
        good = checked.where("ok").drop("ok")
        done = good if done is None else done.unionByName(good)
        if checked.where("not ok").isEmpty():
            break
        todo = checked.where("not ok").select("value", "kind", (F.col("attempt") + 1).alias("attempt"))
        step += 1
    done = done.drop("space")
    words = parts.join(done, ["value", "kind"], "left").groupBy("person").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("surrogate", "fixed").alias("word")))).alias("words"), F.coalesce(F.max("attempt"), F.lit(0)).alias("attempt")
    )
    persons = kinds.where("kind = 'person'").select("value", F.sha2("value", 256).alias("person")).join(words, "person").select("value", F.lit("person").alias("kind"), "attempt", F.array_join("words.word", " ").alias("surrogate"))
    drawn = done.where(~F.col("kind").isin(*NAME_KINDS)).withColumnRenamed("value", "canon")
    others = kinds.join(drawn, ["canon", "kind"]).select("value", "kind", "attempt", poured(F.col("value"), F.col("kind"), F.col("surrogate")).alias("surrogate"))
    return others.unionByName(persons)


def pseudonymise(documents: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """The documents with every entity in *text_col* replaced by its surrogate, as the secret *key* draws them.

    All columns come back under their names; with *report* three are added:
    n_entities, and originals_found / surrogates (arrays in order of the text).

    * null text stays null, empty text empty, both without entities;
    * very long texts are searched whole, in time that grows with their length; their entities are one map a text;
    * a word in capitals that is the surname of a person of the same text, found
      by title or given name, is replaced as in the person's name;
    * one entity has one surrogate wherever and however often it stands; of
      entities drawn alike the least value keeps the draw, so reruns agree;
    * repeated rows and null ids: each row is rewritten like its twin;
    * an empty table gives an empty result; columns named like the operator's
      own do not clash, as it works on the columns wrapped in one struct.
    """
    spark = documents.sparkSession
    names = documents.columns
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    none = F.expr("cast(array() as array<string>)")
    scratch = Scratch(spark)
    with scratch:
        told = scratch.keep(packed.withColumn("found", F.coalesce(found, none)), "told")
        dirty = told.where(F.size("found") > 0).withColumn("sha", F.sha2("text", 256))
        mentions = dirty.select("sha", F.array_distinct("found").alias("found")).groupBy("sha").agg(F.first("found").alias("found"), F.count("*").alias("rows"))
        mentions = scratch.keep(mentions, "mentions")
        each = mentions.select("sha", F.explode("found").alias("value"))
        values = scratch.put(each.groupBy("value").agg(F.count("*").alias("uses")), "values")
        table = surrogate_table(values.select("value"), key, scratch).join(values, "value")
        table = scratch.keep(table, "table")
        # per text its own map; a text's entities are bounded by its length
        told_as = F.struct("value", F.struct("surrogate", (F.col("kind") == "person").alias("person")).alias("to"))
        maps = meet(each, table, "value", "uses").groupBy("sha").agg(F.map_from_entries(F.collect_list(told_as)).alias("map"))
        maps = scratch.keep(maps.join(mentions.select("sha", "rows"), "sha"), "maps")
    clean = told.where(F.size("found") == 0).select("row", F.col("text").alias("new"), none.alias("found"), none.alias("subs"))
    last = lambda c: F.substring_index(c, " ", -1)
    persons = F.filter(F.map_entries("map"), lambda e: e["value"]["person"])
    surnames = F.map_from_entries(F.array_distinct(F.transform(persons, lambda e: F.struct(last(e["key"]), last(e["value"]["surrogate"])))))
    dirty = meet(dirty, maps, "sha", "rows").withColumn("surnames", surnames)
    bare = F.size("surnames") > 0
    dirty = dirty.withColumn("all", F.when(bare, F.regexp_extract_all("text", F.lit(WITH_BARE), F.lit(0))).otherwise(F.col("found")))
    dirty = dirty.withColumn("all_subs", F.transform("all", lambda v: F.coalesce(F.try_element_at("map", v)["surrogate"], F.try_element_at("surnames", v))))
    gaps = F.when(bare, F.split("text", WITH_BARE, -1)).otherwise(F.split("text", PATTERN, -1))
    dirty = dirty.withColumn("gaps", gaps).withColumn("pairs", F.zip_with("all", "all_subs", lambda v, s: F.struct(v.alias("v"), s.alias("s"))))
    woven = F.concat(F.element_at("gaps", 1), F.array_join(F.zip_with("pairs", F.slice("gaps", F.lit(2), F.size("pairs")), lambda p, g: F.concat(F.coalesce(p["s"], p["v"]), g)), ""))
    hits = F.filter("pairs", lambda p: p["s"].isNotNull())
    both = clean.unionByName(dirty.select("row", woven.alias("new"), F.transform(hits, lambda p: p["v"]).alias("found"), F.transform(hits, lambda p: p["s"]).alias("subs")))
    out = [F.col("new").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    if report:
        out += [F.size("found").alias("n_entities"), F.col("found").alias("originals_found"), F.col("subs").alias("surrogates")]
    return both.select(*out)
