"""URL filter: a weighted vocabulary counted by Aho-Corasick, behind host and path rules.

A url is read once by the automaton of all terms.  A term counts where it stands between characters
that are no letters or digits, and once per url however often it occurs.  Strict terms weigh as much
as the limit, soft ones less, so one strict term or several different soft ones block.  A rule on
host and path that fits decides before the terms do.

Rows are independent: no shuffle, only the id and the url are read.  Defined results: a null url, or
one without ``://``, has an empty host and path; its terms are still counted; repeated rows give
repeated results, with the same or a null ``page_id``; an empty table gives no rows; other columns, whatever
their names, are ignored.  A url of any length is read whole, in time and memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2

# ---- fixed values: terms of unwanted sites, strict ones and soft ones by kind ----
STRICT = """porn porno xxx hentai escort escorts milf camgirl camgirls bdsm fetish nsfw
viagra cialis levitra tramadol steroids
casino casinos sportsbook bookmaker bookmakers
warez keygens cracked serialz nulled
malware phishing ransomware spyware botnet stresser booter carding"""
SOFT = """sex sexy adult adults erotic nude nudes naked webcam cams dating hookup singles
pills pharmacy pharma prescription meds weightloss diet slimming
bet bets betting odds poker slots slot roulette blackjack baccarat jackpot lottery bingo win winner prize bonus
loan loans payday credit cash forex binary crypto airdrop investment refinance debt mortgage
cheap discount coupon coupons deals replica replicas outlet wholesale bulk
spam farm ads adserver banner popup popunder clicks click track tracker tracking affiliate affiliates redirect seo backlinks traffic
crack keygen serial torrent torrents download downloads hack hacks cheats modded apk proxy unblocked leaked
essay essays homework followers likes proxies vpnfree horoscope psychic clickbait giveaway"""
# ---- fixed values end; LIMIT blocks ----
TERMS = dict.fromkeys(STRICT.split(), LIMIT) | dict.fromkeys(SOFT.split(), 1)
# ---- fixed values: (action, host, start of the path) ----
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# ---- end of fixed values ----

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Host with A-Z in lower case, and path, of a url column; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host, path, rules: Sequence[tuple[str, str, str]] = RULES):
    """The longest rule that fits as ``struct<rule, action>``; null where none does.

    Of rules of one length the first listed wins.
    """
    found = None
    for action, rule_host, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        value = F.struct(F.lit(rule_host + start).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,action:string>") if found is None else found


def automaton(terms: Mapping[str, int]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in terms.items():
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def _part(char: str) -> bool:
    return "a" <= char <= "z" or "0" <= char <= "9"


def hits(url: str, found: ahocorasick.Automaton) -> dict[str, int]:
    """Terms that stand free in ``url`` (in lower case), with their weights."""
    out = {}
    for last, (term, weight) in found.iter(url):
        first = last - len(term) + 1
        if (first == 0 or not _part(url[first - 1])) and (last + 1 == len(url) or not _part(url[last + 1])):
            out[term] = weight
    return out


def _counted(batches: Iterator[pa.RecordBatch], terms: Mapping[str, int], limit: int) -> Iterator[pa.RecordBatch]:
    found, lower = automaton(terms), str.maketrans(_UPPER, _LOWER)
    for batch in batches:
        strict, soft, score = [], [], []
        for url in batch.column("url").to_pylist():
            weights = hits((url or "").translate(lower), found).values() if terms else ()
            strict.append(sum(w >= limit for w in weights))
            soft.append(sum(w < limit for w in weights))
            score.append(sum(weights))
        out = {name: batch.column(name) for name in ("page_id", "url")}
        yield pa.record_batch(out | {"n_strict": pa.array(strict, pa.int64()), "n_soft": pa.array(soft, pa.int64()),
                                     "score": pa.array(score, pa.int64())})


def judge_urls(pages: DataFrame, terms: Mapping[str, int] = TERMS, limit: int = LIMIT,
               rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_strict, n_soft, score`` of every url."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    counted = rows.mapInArrow(partial(_counted, terms=dict(terms), limit=limit),
                              "page_id long, url string, n_strict long, n_soft long, score long")
    host, path = host_and_path(F.col("url"))
    parts = counted.select("*", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    ruled = parts.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("by"))
    own = F.when(F.col("score") >= limit, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("by.rule").alias("rule"),
                        F.coalesce("by.action", own).alias("verdict"), "n_strict", "n_soft", "score")


def twin(terms: Mapping[str, int] = TERMS, limit: int = LIMIT, rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same rows in DuckDB SQL: one pattern per term in place of the automaton."""
    def count(chosen: list[str]) -> str:
        return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t in chosen) or "0::BIGINT"

    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", a, h + p) for a, h, p in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, _, name in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {f} THEN '{a}'" for f, a, _ in fits) + " END"
    strict, soft = [t for t, n in terms.items() if n >= limit], [t for t, n in terms.items() if n < limit]
    weights = " + ".join(f"{n} * regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t, n in terms.items())
    return f"""WITH r AS (SELECT page_id, coalesce(url, '') AS url,
            CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(url, '{_UPPER}', '{_LOWER}') AS low,
            translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        c AS (SELECT *, {count(strict)} AS n_strict, {count(soft)} AS n_soft, {weights} AS score FROM p)
        SELECT page_id, host, path, {rule} AS rule,
            coalesce({action}, CASE WHEN score >= {limit} THEN 'block' ELSE 'allow' END) AS verdict,
            n_strict, n_soft, score FROM c"""
