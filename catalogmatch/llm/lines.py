"""Line dedup by a log-template tree of fixed depth.

A line is led down the tree by its number of tokens and its first ``LEAD`` tokens; tokens with a
digit or an at sign are variable fields and count as ``<*>``.  A leaf holds templates: the masked
line, and for lines of ``LEAST`` tokens or more also the line with one of its later quarters
generalised, so lines that differ in one field anywhere behind the lead have a template in common.
A line goes when an earlier document has one of its templates; the first document keeps its lines,
so no content is lost from the corpus.  DataFrame functions only.

Templates are written down once per line, counted with partial aggregation and joined back by key,
both sides shuffled from written tables, so AQE splits a line that a third of all documents has.

Defined results: a null text stays null; blank lines and lines without any constant token are no
templates and stay; a text whose lines all go becomes empty; a document without ``doc_id`` counts as
later than all others and not as earlier than its like; rows that share a ``doc_id`` are one document
for the comparison and keep their own texts.  Templates are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm.staging import LAST, stage

LEAD = 2
QUARTERS = 4
LEAST = 8
_BLANK, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: a token with a digit or an at sign, found from its first character only
_FIELD = rf"(?<!{_WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+"
#: lines without a field and with single blanks between tokens, most of them, are spared the rest
_ROUGH = r"[0-9@\x09-\x0D]| (?: |$)|^ "


def masked(line: Column) -> Column:
    """Tokens joined by single blanks, variable fields as ``<*>``."""
    whole = F.trim(F.regexp_replace(F.regexp_replace(line, _FIELD, "<*>"), _BLANK, " "))
    return F.when(line.rlike(_ROUGH), whole).otherwise(line)


def _quarters(tokens: Column) -> Column:
    """Hash of each quarter of the tokens."""
    n = F.size(tokens)

    def cut(q: Column) -> Column:
        return F.floor(n * q / QUARTERS).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(QUARTERS - 1)), lambda q: F.xxhash64(F.slice(tokens, cut(q) + 1, cut(q + 1) - cut(q))))


def _templates(plain: Column, n: Column, quarters: Column) -> Column:
    """All templates of a masked line: its own, and those with one later quarter generalised."""
    wide = F.transform(F.sequence(F.lit(1), F.lit(QUARTERS - 1)), lambda q: F.xxhash64(
        q, n, F.transform(quarters, lambda h, k: F.when(k == q, F.lit(0).cast("long")).otherwise(h))))
    own = F.array(F.xxhash64(F.lit(0), plain))
    return F.when(n >= LEAST, F.concat(own, wide)).otherwise(own)


def _place(docs: DataFrame) -> tuple[Column, Column]:
    """Place in the order of documents, and a hash that tells apart rows of one id."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.xxhash64(docs["text"])


def _lines(docs: DataFrame) -> DataFrame:
    """``ord, row, line, key``: every template of every line (by its number) of every document."""
    order, row = _place(docs)
    lines = docs.select(order.alias("ord"), row.alias("row"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    plain = lines.select("ord", "row", "line", masked(F.col("text")).alias("plain"))
    tokens = plain.select("*", F.split("plain", " ").alias("tokens"))
    parts = tokens.select("ord", "row", "line", "plain", F.size("tokens").alias("n"), _quarters(F.col("tokens")).alias("quarters"),
                          F.exists("tokens", lambda t: (t != "<*>") & (t != "")).alias("constant"))
    keys = F.when(F.col("constant"), _templates(F.col("plain"), F.col("n"), F.col("quarters")))
    return parts.select("ord", "row", "line", F.explode(keys).alias("key"))


def recurring(lines: DataFrame) -> DataFrame:
    """``key, first``: templates that several documents have, with the first of these."""
    return stage(lines.groupBy("key").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
                 .where("first < last").select("key", "first"), "lines-recurring")


def drop_recurring_lines(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``; all other columns as they are.

    Two columns named ``counts`` are added, the lines of the text and those that went (0 for a null
    text).  Columns of these names in ``docs`` are replaced.
    """
    templates = stage(_lines(docs), "lines-templates")
    gone = templates.join(recurring(templates), "key").where("first < ord").groupBy("ord", "row").agg(F.collect_set("line").alias("__gone"))
    gone = gone.withColumnsRenamed({"ord": "__ord", "row": "__row"})
    order, row = _place(docs)
    text, lines = docs["text"], F.split(docs["text"], "\n")
    rows = docs.join(gone, (order == gone["__ord"]) & (row == gone["__row"]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["__gone"])
    kept = F.transform(left, lambda i: F.get(lines, i))
    rows = rows.withColumn("__kept", F.when(gone["__gone"].isNotNull() & text.isNotNull(), kept))
    total = F.when(text.isNull(), 0).otherwise(F.size(lines))
    return rows.select(
        *[F.coalesce(F.array_join("__kept", "\n"), text).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns if c not in counts],
        total.cast("long").alias(counts[0]), F.when(F.col("__kept").isNull(), 0).otherwise(total - F.size("__kept")).cast("long").alias(counts[1]))


def twin() -> str:
    """The same counts and texts in DuckDB SQL, on templates as text."""
    def wide(q: int) -> str:
        low, high = f"greatest(n * {q} // {QUARTERS}, {LEAD})", f"n * {q + 1} // {QUARTERS}"
        return f"concat('{q}|', n, '|', array_to_string(tokens[1:{low}], ' '), '|', array_to_string(tokens[{high} + 1:n], ' '))"

    keys = ", ".join(wide(q) for q in range(1, QUARTERS))
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS ord, text FROM documents),
        line AS (SELECT r, ord, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
        plain AS (SELECT r, ord, i, line, list_transform(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda t: t <> ''),
            lambda t: CASE WHEN regexp_matches(t, '[0-9@]') THEN '<*>' ELSE t END) AS tokens FROM line),
        own AS (SELECT *, len(tokens) AS n, array_to_string(tokens, ' ') AS own FROM plain
            WHERE len(list_filter(tokens, lambda t: replace(t, '<*>', '') <> '')) > 0),
        keyed AS (SELECT r, ord, i, unnest(CASE WHEN n >= {LEAST} THEN ['0|' || own, {keys}] ELSE ['0|' || own] END) AS k FROM own),
        seen AS (SELECT k, min(ord) AS first FROM keyed GROUP BY k),
        gone AS (SELECT DISTINCT r, i FROM keyed JOIN seen USING (k) WHERE first < ord),
        kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM line ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT docs.doc_id, CASE WHEN docs.text IS NULL THEN 0 ELSE len(string_split(docs.text, chr(10))) END::BIGINT AS n_lines,
            CASE WHEN docs.text IS NULL THEN 0 ELSE len(string_split(docs.text, chr(10))) - coalesce(kept.n, 0) END::BIGINT AS n_dropped,
            CASE WHEN docs.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)"""
