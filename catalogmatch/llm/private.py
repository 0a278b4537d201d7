"""Surrogates for personal data.

Patterns find email and IP addresses, card and phone numbers, social security numbers, secrets and
names behind a title.  Every entity of the corpus, in a plain form without case and separators, gets
one surrogate, made from a keyed hash, so it reads the same wherever the entity stands.  It keeps the
type, the script, the gender a title tells, the case and the separators of what it replaces.

The first and the family name behind a title are entities of their own, so ``Dr Anna Berg`` and
``Dr Berg`` keep one family name, and two people of one family do.  In a text that names somebody
behind a title the parts are replaced wherever else they stand as a capitalised word.  Scripts are
Latin, Cyrillic and Greek; names in others get Latin ones.

Distinct entities get distinct surrogates, none of them an entity of the corpus: where two surrogates
of a type are equal, or one equals an entity, all but the first draw again until none is left.  From the
draw after ``NARROW`` on a surrogate gets one more letter, digit, number or syllable each time than the
format has.  So a format whose every value is an entity (``d@d.com``) is left for a longer one: the
values of a length grow with it without bound and the entities do not, so the draws come to an end.
DataFrame functions only.

Entities are gathered once per distinct surface, joined with their surrogates from a written table,
and brought back as small maps per text, so a map never outgrows one text however many rows have no
id or share one; the text itself is shuffled once.

Defined results: a null text stays null; a text without entities stays as it is; a blank key is
refused; rows that share a ``doc_id`` are treated each by its own text, repeated rows alike; an empty
table gives no rows; columns named like those used inside stay as they are, but for ``n_entities``, which
is replaced.  The whole of a text is searched; a row costs memory in proportion to its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm.staging import stage

KEY = "catalogmatch surrogates"
NARROW = 3  # tries within the format of an entity, before it is widened

_START, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"

# ---- fixed values: titles before names, by the gender they tell ----
TITLES = {"f": ("Mrs", "Ms", "Miss", "Madam", "Mme", "Mlle", "Madame", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Госпожа"),
          "m": ("Mr", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Don", "Господин"),
          "n": ("Dr", "Prof")}
# ---- fixed values: first names of surrogates, by gender and script ----
FIRST = {("f", "latin"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nina", "Sofia"),
         ("m", "latin"): ("Adam", "Bruno", "David", "Felix", "Hugo", "Leon", "Martin", "Victor"),
         ("n", "latin"): ("Alexis", "Andrea", "Camille", "Dominique", "Kim", "Nicola", "Robin", "Sascha"),
         ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
         ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Роман"),
         ("n", "cyrillic"): ("Валя", "Женя", "Мика", "Паша", "Саша", "Слава", "Шура", "Юля"),
         ("f", "greek"): ("Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"),
         ("m", "greek"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"),
         ("n", "greek"): ("Άγγελα", "Αριστέα", "Δανάη", "Θέμις", "Ιάσων", "Ρένα", "Τόνια", "Φάνης")}
# ---- fixed values: letters of made-up names, consonants then vowels, by script ----
SYLLABLES = {"latin": ("bdfgklmnprst", "aeiou"), "cyrillic": ("бвгдклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστφ", "αειου")}
# ---- fixed values: patterns of entities, the first that fits names the type ----
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"),
    ("secret", _START + r"[0-9a-fA-F]{32,64}" + _END),
    ("ip", r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[\p{L}\p{N}])"),
    ("card", _START + r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}" + _END),
    ("ssn", _START + r"\d{3}-\d{2}-\d{4}" + _END),
    ("phone", r"(?<![\p{L}\p{N}+(])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}" + _END
     + r"|(?<![\p{L}\p{N}+(])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}" + _END + r"|" + _START + r"\d{3}[.-]\d{3}[.-]\d{4}" + _END),
    ("name", _START + "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + r")\.? " + _NAME + f"(?: {_NAME})?"),
)
# ---- end of fixed values ----

ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: a capitalised word, which may be part of a name found elsewhere in the text; ``Berg's`` gives ``Berg``
_WORD = _START + r"\p{Lu}[\p{L}-]*+(?:['’]\p{Lu}[\p{L}-]*+)*+" + _END
_TITLE = "^(" + "|".join(t for titles in TITLES.values() for t in titles) + r")\.? "


def kind_of(surface: Column) -> Column:
    """Type of an entity from its whole surface."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        kind = F.when(surface.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def plain(kind: Column, surface: Column) -> Column:
    """The forms that all spellings of an entity share: one, or for a name one for each part.

    A part is its role, the gender of a first name, the script, and the word.
    """
    title = F.regexp_extract(surface, _TITLE, 1)
    gender = F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("n")
    names = F.split(F.lower(F.regexp_replace(surface, _TITLE, "")), " ")

    def part(role: str, sex: Column, word: Column) -> Column:
        script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        return F.concat_ws(":", F.lit(role), sex, script, word)

    family = part("family", F.lit(""), F.element_at(names, -1))
    parts = F.when(F.size(names) > 1, F.array(part("given", gender, names[0]), family)).otherwise(F.array(family))
    return (F.when(kind.isin("card", "ssn", "phone"), F.array(F.regexp_replace(surface, r"\D", "")))
            .when(kind == "name", parts).otherwise(F.array(F.lower(surface))))


def value(kind: Column, entity: Column) -> Column:
    """What of an entity is seen in a text: the word of a name, else all."""
    return F.when(kind == "name", F.element_at(F.split(entity, ":"), -1)).otherwise(entity)


def _draws(kind: Column, entity: Column, tries: Column, key: str) -> Column:
    """256 bits from the key and the entity, as hex digits."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, entity, tries.cast("string")), 256)


def _byte(draws: Column, i: Column | int) -> Column:
    """Number from 0 to 255: the ``i``-th byte, from the start again after the last."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(draws, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(draws: Column, text: Column) -> Column:
    """``text`` with other letters and digits of the same script; all else stays."""
    def other(c: Column, i: Column) -> Column:
        b = _byte(draws, i + F.floor(i / 32).cast("int") * 7)
        turn = F.pmod(b + i, F.lit(1 << 16))
        return (F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
                .when(c.rlike(r"\p{IsCyrillic}"), F.substr(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), F.pmod(turn, F.lit(27)) + 1, F.lit(1)))
                .when(c.rlike(r"\p{IsGreek}"), F.substr(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), F.pmod(turn, F.lit(24)) + 1, F.lit(1)))
                .when(c.rlike(r"\p{L}"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(turn, F.lit(26)) + 1, F.lit(1)))
                .otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), other), "")


def _syllable(draws: Column, onsets: str, vowels: str):
    """The ``i``-th syllable of a name."""
    def pick(letters: str, byte: Column, turn: Column) -> Column:
        return F.substr(F.lit(letters), F.pmod(byte + turn, F.lit(len(letters))) + 1, F.lit(1))

    def one(i: Column) -> Column:
        turn = F.floor(i / 16).cast("int")  # the bytes come round after 16 syllables
        return F.concat(pick(onsets, _byte(draws, 2 * i), turn), pick(vowels, _byte(draws, 2 * i + 1), turn))

    return one


def surrogate(kind: Column, entity: Column, tries: Column, key: str) -> Column:
    """Plain form of the surrogate of an entity, from the key and the number of tries."""
    draws = _draws(kind, entity, tries, key)
    wider = F.greatest(tries - F.lit(NARROW), F.lit(0))

    def each(count: Column, make) -> Column:
        return F.transform(F.sequence(F.lit(1), count), make)

    digits = F.array_join(each(F.length(entity) + wider, lambda i: F.pmod(_byte(draws, i) + i, F.lit(10)).cast("string")), "")
    hexes = F.substr(F.concat(draws, F.reverse(draws), draws), F.lit(1), F.length(entity) + wider)
    ip = F.array_join(each(4 + wider, lambda i: (F.pmod(_byte(draws, 2 * i) * 256 + _byte(draws, 2 * i + 1), F.lit(254)) + 1).cast("string")), ".")
    last = F.element_at(F.split(entity, r"\."), -1)
    email = F.concat(_letters(draws, F.concat(F.repeat(F.lit("a"), wider), F.substr(entity, F.lit(1), F.length(entity) - F.length(last)))), last)
    part = F.split(entity, ":")
    name = F.lit(None).cast("string")
    for script, (onsets, vowels) in SYLLABLES.items():
        made = F.array_join(each(4 + wider, _syllable(draws, onsets, vowels)), "")
        ends = {"f": vowels[0], "m": onsets[7], "n": vowels[2]}  # a first name that is made up tells the gender by its end
        own = F.when(part[0] == "family", made)
        for gender, end in ends.items():
            names = FIRST[gender, script]
            pick = F.lower(F.element_at(F.array(*[F.lit(n) for n in names]), F.pmod(_byte(draws, 0), F.lit(len(names))) + 1))
            own = own.when((part[1] == gender) & (tries == 0), pick).when(part[1] == gender, F.concat(made, F.lit(end)))
        name = F.when(part[2] == script, own).otherwise(name)
    return (F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "secret", hexes).when(kind == "ip", ip)
            .when(kind == "email", email).otherwise(name))


def _cased(word: Column, sign: Column) -> Column:
    """``sign`` in capitals where ``word`` is (one letter is no sign of that), else with a capital first."""
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(sign)).otherwise(F.initcap(sign))


def shown(kind: Column, surface: Column, sign: Column, given: Column, family: Column) -> Column:
    """The surrogate in the format of the surface: its separators, its case, its title.

    Names have the surrogates of their parts in ``given`` (null without one) and ``family``; others in ``sign``.
    """
    chars = F.split(surface, "")
    before = F.transform(chars, lambda c, i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d.rlike("[0-9]"))))
    digits = F.array_join(F.zip_with(chars, before, lambda c, n: F.when(c.rlike("[0-9]"), F.substr(sign, n, F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substr(sign, F.element_at(before, -1) + 1, F.length(sign)))  # those of a wider format
    names = F.split(F.regexp_replace(surface, _TITLE, ""), " ")
    name = F.concat(F.regexp_extract(surface, _TITLE, 0), F.concat_ws(" ", F.when(given.isNotNull(), _cased(names[0], given)), _cased(F.element_at(names, -1), family)))
    cased = F.when(surface == F.upper(surface), F.upper(sign)).otherwise(sign)
    return F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "name", name).when(kind == "ip", sign).otherwise(cased)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, entity, sign`` for the distinct ``kind, entity``: surrogates without clashes.

    Each round draws again for the entities whose surrogate an earlier entity has, or which is an
    entity itself; the others keep theirs.  Rounds end when no clash is left, which wider formats see to.
    """
    tries = stage(entities.select("kind", "entity", F.lit(0).alias("tries")), "private-tries")
    real = entities.select("kind", value(F.col("kind"), F.col("entity")).alias("sign")).distinct().withColumn("is_real", F.lit(True))
    while True:
        drawn = tries.withColumn("sign", surrogate(F.col("kind"), F.col("entity"), F.col("tries"), key))
        drawn = stage(drawn, "private-signs")
        heads = drawn.groupBy("kind", "sign").agg(F.min(F.struct("tries", "entity")).alias("head"))
        judged = drawn.join(heads, ["kind", "sign"]).join(real, ["kind", "sign"], "left")
        clash = (F.struct("tries", "entity") != F.col("head")) | F.col("is_real").isNotNull()
        judged = judged.withColumn("clash", clash)
        if not judged.where("clash").limit(1).count():
            return drawn.select("kind", "entity", "sign")
        tries = stage(judged.select("kind", "entity", (F.col("tries") + F.col("clash").cast("int")).alias("tries")), "private-tries")


def _row(docs: DataFrame) -> Column:
    """A hash that tells rows apart by id and text; where two rows agree in it, they share a larger map."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def _found(docs: DataFrame) -> DataFrame:
    """``row, kind, surface, entity``, distinct per row; a name has a row for each of its parts."""
    hits = docs.select(_row(docs).alias("row"),
                       F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))).alias("surface"))
    hits = hits.withColumn("kind", kind_of(F.col("surface"))).where("kind is not null")
    return hits.withColumn("entity", F.explode(plain(F.col("kind"), F.col("surface"))))


def _maps(found: DataFrame, signs: DataFrame) -> DataFrame:
    """``__row, __shown, __parts``: per text what stands for each surface, and for each part of a name by itself."""
    named = found.join(signs, ["kind", "entity"])
    role = F.when(F.col("kind") == "name", F.element_at(F.split("entity", ":"), 1))
    named = named.withColumn("role", role).withColumn("part", F.when(role.isNotNull(), value(F.col("kind"), F.col("entity"))))
    whole = named.groupBy("row", "kind", "surface").agg(
        F.max(F.when(F.col("role").isNull(), F.col("sign"))).alias("sign"), F.max(F.when(F.col("role") == "given", F.col("sign"))).alias("given"),
        F.max(F.when(F.col("role") == "family", F.col("sign"))).alias("family"))
    whole = whole.select("row", "surface", shown(*[F.col(c) for c in ("kind", "surface", "sign", "given", "family")]).alias("shown"))
    maps = whole.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("surface", "shown"))).alias("__shown"))
    # a word that is a first name here and a family name there counts as the family name
    parts = named.where("role is not null").groupBy("row", "part").agg(F.min(F.struct("role", "entity", "sign")).alias("one"))
    parts = parts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("part", "one.sign"))).alias("__parts"))
    return maps.join(parts, "row", "left").withColumnRenamed("row", "__row")


def replace_private(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, all other columns as they are, and ``n_entities`` added or replaced."""
    if not key.strip():
        raise ValueError("the key must not be blank")
    found = stage(_found(docs), "private-found")
    signs = surrogates(found.select("kind", "entity").distinct(), key)
    maps = _maps(found, signs)
    rows = docs.join(maps, _row(docs) == maps["__row"], "left")
    text, known, parts = docs["text"], maps["__shown"], maps["__parts"]

    def replaced(pattern: str, one) -> tuple[Column, Column]:
        """The text with every match replaced by ``one`` of it (null: left alone), and the number replaced."""
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        new = F.transform(hits, lambda h: F.coalesce(one(h), h))
        whole = F.array_join(F.zip_with(F.split(text, pattern), new, lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")
        return whole, F.size(F.filter(F.transform(hits, one), lambda h: h.isNotNull())).cast("long")

    def by_part(h: Column) -> Column:
        sign = F.element_at(parts, F.lower(h))
        return F.coalesce(F.element_at(known, h), F.when(sign.isNotNull(), _cased(h, sign)))

    plain_text, count = replaced(ANY, lambda h: F.element_at(known, h))
    named_text, more = replaced(f"{ANY}|(?:{_WORD})", by_part)
    has, names = known.isNotNull() & text.isNotNull(), parts.isNotNull()
    new = F.when(has & names, named_text).when(has, plain_text).otherwise(text).alias("text")
    return rows.select(*[new if c == "text" else docs[f"`{c}`"] for c in docs.columns if c != "n_entities"],
                       F.when(has & names, more).when(has, count).otherwise(0).cast("long").alias("n_entities"))
