"""Text folding, stopwords, word de-duplication as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the catalog's rules understand it: every Unicode space and the four separators
# U+001C..U+001F, which a plain Java ``\s`` leaves out.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ASCII_SPACE = r"[\t-\r\x{1c}-\x{20}]"

# ---- fixed values: the public Portuguese stopword list that Spark ships, in its order ----
PORTUGUESE = """
    de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando
    muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você
    essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos
    lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles
    aquelas isto aquilo estou está estamos estão estive esteve estivemos estiveram estava estávamos estavam
    estivera estivéramos esteja estejamos estejam estivesse estivéssemos estivessem estiver estivermos estiverem
    hei há havemos hão houve houvemos houveram houvera houvéramos haja hajamos hajam houvesse houvéssemos
    houvessem houver houvermos houverem houverei houverá houveremos houverão houveria houveríamos houveriam sou
    somos são era éramos eram fui foi fomos foram fora fôramos seja sejamos sejam fosse fôssemos fossem for formos
    forem serei será seremos serão seria seríamos seriam tenho tem temos tém tinha tínhamos tinham tive teve
    tivemos tiveram tivera tivéramos tenha tenhamos tenham tivesse tivéssemos tivessem tiver tivermos tiverem
    terei terá teremos terão teria teríamos teriam
""".split()
# ---- fixed values: stopwords kept although the language list holds them ----
KEPT_STOPWORDS = ("com", "sem")
# ---- fixed values: words a Treebank word tokenizer cuts in two ----
SPLIT_WORDS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))
# ---- end of fixed values ----

_SPLIT_PATTERN = r"\b(?:" + "|".join(f"({a})({b})" for a, b in SPLIT_WORDS) + r")\b"
_SPLIT_PARTS = "".join(f"${2 * i + 1}" for i in range(len(SPLIT_WORDS))) + " " + "".join(
    f"${2 * i + 2}" for i in range(len(SPLIT_WORDS)))


@lru_cache(maxsize=1)
def _compatibility_tables() -> tuple[str, str, str]:
    """Build the folding tables from the Unicode database.

    Returns the characters that fold to one ASCII character, those characters, and a
    ``char=expansion`` list for characters that fold to several.  Characters that fold to
    nothing need no entry: the clean-up after the lookup drops them.
    """
    source, target, expansions = [], [], []
    for char in map(chr, range(0x80, 0x20000)):  # nothing beyond these planes folds to ASCII
        if not unicodedata.decomposition(char):
            continue
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        kept = "".join(ch for ch in plain if ch.isalnum() or ch.isspace())
        if len(kept) == 1:
            source.append(char)
            target.append(kept)
        elif kept:
            expansions.append(f"{char}={kept}")
    return "".join(source), "".join(target), ";".join(expansions)


def _covering_class(chars: str, gap: int = 64) -> str:
    """A short character class that covers ``chars`` and their near neighbours.

    Java tests a class range by range for every character, so a few wide ranges scan far faster
    than hundreds of exact ones.  Catching too much is harmless where the exact lookup follows.
    """
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def to_ascii(text: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII; rows already ASCII skip the lookup."""
    source, target, expansions = _compatibility_tables()
    table = F.str_to_map(F.lit(expansions), F.lit(";"), F.lit("="))
    expanding = _covering_class("".join(pair[0] for pair in expansions.split(";")))
    expanded = F.array_join(
        F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    wide = F.when(text.rlike(expanding), expanded).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(wide, source, target)).otherwise(text)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Split at white space; no empty words."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def fold(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, single spaces.  Null becomes ``''``."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    cleaned = F.regexp_replace(to_ascii(lowered), r"[^a-zA-Z0-9\t-\r\x{1c}-\x{20}]", "")
    return F.trim(F.regexp_replace(cleaned, f"{ASCII_SPACE}+", " "))


def portuguese_stopwords() -> list[str]:
    """The Portuguese list, minus the words that carry meaning here."""
    return [w for w in PORTUGUESE if w not in KEPT_STOPWORDS]


def drop_stopwords(text: Column, stopwords: list[str]) -> Column:
    """Remove stopwords from folded text.  Accented entries cannot match folded words."""
    tokens = F.split(F.regexp_replace(text, _SPLIT_PATTERN, _SPLIT_PARTS), f"{SPACE}+")
    dropped = ", ".join(f"'{w}'" for w in ["", *stopwords])
    kept = F.call_function("filter", tokens, F.expr(f"w -> lower(w) NOT IN ({dropped})"))
    return F.array_join(kept, " ")


def distinct_words(text: Column) -> Column:
    """Keep the first of equal words (case matters) in their order."""
    return F.array_join(F.array_distinct(words(text)), " ")


def without_dot_zero(text: Column) -> Column:
    """Delete the two characters ``.0`` wherever they stand, so ``500.0`` and also ``1.05`` change."""
    return F.replace(text, F.lit(".0"), F.lit(""))


def let(value: Column, body: str) -> Column:
    """Evaluate ``value`` once and pass it to ``body``, an SQL lambda."""
    return F.call_function("transform", F.array(value), F.expr(body)).getItem(0)
