"""Surrogates: an end for every input, names and their parts, and agreement with a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from catalogmatch.llm import private


def texts(spark, given, key="k"):
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    return [r.text for r in private.replace_private(docs, key).orderBy("doc_id").collect()]


@pytest.mark.parametrize("full", [
    [f"{a}@{b}.com" for a in range(10) for b in range(10)],           # all a hundred addresses of the shape
    [f"{a}@{b}.com" for a in range(10) for b in range(7)],
    ["mail " + chr(97 + a) + "@x.y" for a in range(26)]])
def test_a_format_that_is_full_is_left_for_a_longer_one(spark, full):
    found = texts(spark, full)
    addresses = [re.search(r"\S+@\S+", t).group() for t in found]
    assert len(set(addresses)) == len(full)
    assert not set(addresses) & {re.search(r"\S+@\S+", t).group() for t in full}
    assert {t.rsplit(".", 1)[1] for t in addresses} == {t.rsplit(".", 1)[1] for t in full}


@pytest.mark.parametrize("kind, entities", [
    ("ssn", [f"{i:02d}" for i in range(100)]), ("phone", [str(i) for i in range(10)]), ("card", [f"{i:03d}" for i in range(900)]),
    ("name", [f"family::latin:n{i}" for i in range(400)]), ("name", [f"given:{g}:{s}:n{i}" for g in "fmn" for s in ("latin", "greek", "cyrillic") for i in range(30)])])
def test_signs_are_distinct_and_no_entities(spark, kind, entities):
    rows = spark.createDataFrame([(kind, e) for e in entities], "kind string, entity string")
    signs = {r.entity: r.sign for r in private.surrogates(rows, "k").collect()}
    seen = {e.split(":")[-1] for e in entities}
    assert set(signs) == set(entities) and len(set(signs.values())) == len(entities) and not set(signs.values()) & seen
    if kind != "name":
        assert all(s.isdigit() for s in signs.values())


def test_one_person_keeps_one_name(spark):
    out = texts(spark, ["Dr Anna Berg came. Dr Berg spoke. Anna Berg left; Anna smiled. Berg's hat, BERG and bergs.", "Anna Berg is not known here",
                        "Mr Berg and Mrs Eva Berg met Dr Anna Stein."])
    person, later, part, first, hat, capitals = re.fullmatch(
        r"Dr (\S+ \S+) came\. Dr (\S+) spoke\. (\S+ \S+) left; (\S+) smiled\. (\S+)'s hat, (\S+) and bergs\.", out[0]).groups()
    given, family = person.split(" ")
    assert person == part and later == family == hat and first == given and capitals == family.upper()
    assert not {given, family} & {"Anna", "Berg"}
    assert out[1] == "Anna Berg is not known here"  # no title says that this is a name
    mr, eva, mrs, dr, stein = re.fullmatch(r"Mr (\S+) and Mrs (\S+) (\S+) met Dr (\S+) (\S+)\.", out[2]).groups()
    assert mr == mrs == family and dr == given  # two people of one family, and one first name
    assert len({mr, eva, dr, stein}) == 4


def test_names_keep_script_and_case(spark):
    out = texts(spark, ["Госпожа Анна Петрова; Mr ΑΛΕΞΗΣ ΠΑΠΠΑΣ; Mrs Ελένη Παππά and Παππά; Dr O'Brien, O'Brien's", "Mr Λ. Sr García-Márquez, García-Márquez"])
    cyrillic, capitals, greek, alone, irish, again = re.fullmatch(
        r"Госпожа (\S+ \S+); Mr (\S+ \S+); Mrs (\S+ \S+) and (\S+); Dr (\S+), (\S+)'s", out[0]).groups()
    assert re.fullmatch(r"[А-Яа-я]+ [А-Яа-я]+", cyrillic) and re.fullmatch(r"[Α-ΩΆ-Ώ]+ [Α-ΩΆ-Ώ]+", capitals)
    assert re.fullmatch(r"[Α-Ωα-ωά-ώΆ-Ώ]+ [Α-Ωα-ωά-ώ]+", greek.replace("Ά", "Α").replace("Ι", "Ι")) and alone == greek.split(" ")[1]
    assert irish == again and "Brien" not in irish
    spanish = re.fullmatch(r"Mr Λ\. Sr (\S+), (\S+)", out[1]).groups()
    assert spanish[0] == spanish[1] != "García-Márquez"


def plain_replacement(text, signs, find, kinds):
    """The same from the table of signs, in Python: ``find`` gives entities, ``kinds`` their kinds and parts."""
    surfaces = {s: kinds(s) for s in find.findall(text)}
    parts = {}
    for kind, entities in surfaces.values():
        for e in entities if kind == "name" else ():
            word = e.split(":")[-1]
            parts[word] = min(parts.get(word, (e.split(":")[0], e)), (e.split(":")[0], e))

    def cased(word, sign):
        return sign.upper() if len(word) > 1 and word == word.upper() else sign.capitalize()

    def one(match):
        s = match.group()
        if s not in surfaces:
            found = parts.get(s.lower())
            return cased(s, signs["name", found[1]]) if found else s
        kind, entities = surfaces[s]
        if kind == "name":
            title = re.match(r"\S+ ", s).group()
            return title + " ".join(cased(w, signs["name", e]) for w, e in zip(s[len(title):].split(" "), entities))
        sign = signs[kind, entities[0]]
        if kind == "ssn":
            digits = iter(sign)
            return "".join(next(digits) if c.isdigit() else c for c in s) + "".join(digits)
        return sign.upper() if s == s.upper() else sign

    return re.sub(find.pattern + r"|(?<!\w)[A-Z][A-Za-z-]*(?!\w)", one, text)


def test_replacement_agrees_with_a_plain_version(spark):
    rng = random.Random(3)
    names, sure = ["Anna", "Eva", "Tom", "Berg", "Stein", "Rose"], ["Berg", "Stein", "Rose", "Wolf"]

    def sentence():
        return rng.choice([
            lambda: f"Dr {rng.choice(names)} {rng.choice(sure)} spoke.", lambda: f"Mrs {rng.choice(sure)} left.", lambda: f"{rng.choice(names)} saw {rng.choice(sure)}.",
            lambda: f"mail {rng.choice('abc')}{rng.randrange(5)}@x.org, ", lambda: f"ssn {rng.randrange(100, 105)}-11-2222;", lambda: f"{rng.choice(sure).upper()} or {rng.choice(sure).lower()}s."])()

    given = [" ".join(sentence() for _ in range(rng.randrange(9))) for _ in range(60)]
    find = re.compile(r"[\w.]+@\w+\.\w+|(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)|(?<!\w)(?:Dr|Mrs) [A-Z]\w+(?: [A-Z]\w+)?")

    def kinds(surface):
        if "@" in surface:
            return "email", [surface.lower()]
        if surface[0].isdigit():
            return "ssn", [surface.replace("-", "")]
        title, *words = surface.lower().split(" ")
        family = f"family::latin:{words[-1]}"
        return "name", [f"given:{'f' if title == 'mrs' else 'n'}:latin:{words[0]}", family] if len(words) > 1 else [family]

    entities = sorted({(k, e) for t in given for s in find.findall(t) for k, es in [kinds(s)] for e in es})
    signs = {(r.kind, r.entity): r.sign for r in private.surrogates(spark.createDataFrame(entities, "kind string, entity string"), "k").collect()}
    assert texts(spark, given) == [plain_replacement(t, signs, find, kinds) for t in given]


def test_entities_are_counted_with_their_later_mentions(spark):
    docs = spark.createDataFrame([(1, "Dr Anna Berg. Anna, Berg and Carl; 555-11-2222", "x"), (2, "Anna", "y")], "doc_id long, text string, n_entities string")
    found = {r.doc_id: r.n_entities for r in private.replace_private(docs.withColumns({c: F.lit("t") for c in ("row", "part", "role", "__x")}), "k").collect()}
    assert found == {1: 4, 2: 0}
