"""Phrase collocations by dynamic itemset counting.

Documents are dealt into ``SHARDS`` shards, and the shards are scanned in a cycle.  Words are counted
from the start; a longer phrase becomes active once the phrase without its last word and the one
without its first have both been met ``least`` times, whatever shard the scan has come to, and is
counted for one full cycle from there.  So several lengths are counted in one scan, and the work ends
when no active phrase is short of its cycle.  A phrase that occurs ``least`` times has parts that do, so
none is missed, and what is counted is counted in every shard once.

Which phrases have been met often enough is known to the tasks as a bitmap of bounded size (see
``bits``).  A stranger that passes it costs a count of a phrase that proves rare; activity is decided
by the bitmaps of this step and of the step one cycle before, each by itself from the words up, so that its
count covers every shard as well, and a stranger of one cycle that is frequent in the next is no exception.
Counts are kept in a table; a phrase whose cycle is over leaves it, for good if it is rare.

Defined results: a null text is empty; a null ``lang`` is ``und``; repeated rows count each; a text
without words adds nothing; an empty table gives no rows; other columns are ignored.  Phrases are told
apart by 64-bit hashes of their words and language.  Working memory is a few hundred bytes per word of
the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.llm import bits
from catalogmatch.llm import words as w
from catalogmatch.llm.letters import table, translate
from catalogmatch.llm.staging import stage

SHARDS = 2
LEAST, SHARE, TOP, LONGEST = 30, 80, 2000, 4
HELD = 3 << 20  # hashes counted together in a task
GROUPS = 1024  # of documents; each phrase remembers one that has it, to be spelled from
_LETTERS = table(b"", b".,;:!?\x0b\x0c\r")


class _Phrases:
    """Hashes of the phrases of a slice: ``of[n][i]`` is the phrase of ``n`` words from word ``i`` on.

    ``inside[n]`` tells which of them lie within one piece.  The lowest two bits hold the length less one.
    """

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        self.words = x = w.split(translate(texts, _LETTERS))
        text = x.text_of()
        piece = np.searchsorted(np.flatnonzero(x.data == 0x0A), x.start) + text
        single = w.mix(x.hash ^ langs[text])
        self.text, self.of, self.inside = text, {}, {}
        for n in range(1, LONGEST + 1):
            of = single if n == 1 else w.windows(single, n)
            self.of[n] = (of & ~np.uint64(3)) | np.uint64(n - 1)
            self.inside[n] = piece[:len(of)] == piece[n - 1:n - 1 + len(of)]

    def within(self, n: int, bitmap: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which phrases of ``n`` words, of those in ``among``, the bitmap lets pass."""
        out = np.zeros(len(self.of[n]), bool)
        at = np.flatnonzero(among)
        out[at] = bits.member(bitmap, self.of[n][at])
        return out


def _both(part: np.ndarray) -> np.ndarray:
    return part[:-1] & part[1:]


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(name).to_numpy(zero_copy_only=False) for name in names]


def _count(batches: Iterator[pa.RecordBatch], now, before, words: bool) -> Iterator[pa.RecordBatch]:
    """``h, c, g``: the active phrases of a shard, their counts and a group of documents that has them.

    ``now`` and ``before`` are the bitmaps of this step and one cycle ago.
    """
    now, before = (None if x is None else x.value for x in (now, before))
    held: list[np.ndarray] = []
    groups: list[np.ndarray] = []

    def hold(h: np.ndarray, at: np.ndarray) -> None:
        held.append(h)
        groups.append(at.astype(np.int16))

    def counted() -> pa.RecordBatch:
        h, g = np.concatenate(held), np.concatenate(groups)
        held.clear()
        groups.clear()
        order = np.argsort(h)
        h = h[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        return pa.record_batch({"h": h[at].view(np.int64), "c": np.diff(np.append(at, len(h))), "g": g[order[at]].astype(np.int32)})

    for batch in batches:
        texts, (langs, group) = batch.column("text"), _columns(batch, "lang", "group")
        for low, high in w.slices(texts):
            x = _Phrases(texts.slice(low, high - low), langs[low:high].view(np.uint64))
            own = group[low:high][x.text]
            if words:
                hold(x.of[1], own)
            if now is not None and len(x.of[1]):
                among = counted_before = x.inside[1]
                for n in range(1, LONGEST):
                    known = x.within(n, now, among)
                    if len(known) < 2:
                        break
                    among = x.inside[n + 1] & _both(known)
                    active = among
                    if before is not None:  # what was active then, by that bitmap alone, has its cycle already
                        # bitmaps only grow, so what this one holds back was held back then
                        counted_before = x.inside[n + 1] & _both(x.within(n, before, counted_before & known))
                        active = among & ~counted_before
                    hold(x.of[n + 1][active], own[:len(active)][active])
            if sum(map(len, held)) >= HELD:
                yield counted()
    if held:
        yield counted()


def _source(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    return docs.select(F.xxhash64(lang).alias("lang"), lang.alias("name"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(GROUPS)).cast("int").alias("group"), "text")


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """``h, c, g``: all phrases of up to four words met ``least`` times, their counts, and a group that has them.

    Also the number of scans.
    """
    spark, source = docs.sparkSession, _source(docs)
    done, live, sizes, maps, step, gone = [], None, [0], [None], 0, 0
    while step < SHARDS or sizes[step] != sizes[step - SHARDS]:
        before = maps[step - SHARDS] if step >= SHARDS else None
        found = source.where(F.col("group") % SHARDS == step % SHARDS).select("lang", "group", "text").mapInArrow(
            partial(_count, now=maps[step], before=before, words=step < SHARDS), "h long, c long, g int")
        found = found.withColumn("step", F.lit(step))
        every = found if live is None else found.unionByName(live)
        counts = stage(every.groupBy("h").agg(F.sum("c").alias("c"), F.min("g").alias("g"), F.min("step").alias("step")), f"phrases-{step}")
        over = counts.where(F.col("step") <= step - SHARDS + 1).where(F.col("c") >= least)
        live = counts.where(F.col("step") > step - SHARDS + 1)
        done.append(over)
        often = counts.where(F.col("c") >= least).where(F.col("h").bitwiseAND(F.lit(3)) < LONGEST - 1)
        ended, met = often.agg(F.count_if(F.col("step") <= step - SHARDS + 1), F.count("*")).first()
        sizes.append(gone + met)
        gone += ended
        if step == 0:
            size = bits.size_for(8 * sizes[1])
        last = maps[step].value if maps[step] is not None else np.zeros(size // 8, np.uint8)
        maps.append(spark.sparkContext.broadcast(last | bits.bitmap(often, "h", size)))
        step += 1
    out = live.where(F.col("c") >= least)
    for x in done:
        out = out.unionByName(x)
    return stage(out.select("h", "c", "g"), "phrases-frequent"), step


def _spell(batches: Iterator[pa.RecordBatch], candidates) -> Iterator[pa.RecordBatch]:
    """Text and parts of each candidate that a task meets, and its number of words for each language (``h`` null).

    A candidate is spelled from the one group of documents that it remembers.
    """
    seen, totals = np.zeros(0, np.uint64), {}
    for batch in batches:
        texts, (langs, group) = batch.column("text"), _columns(batch, "lang", "group")
        names = batch.column("name").to_pylist()
        for low, high in w.slices(texts):
            x = _Phrases(texts.slice(low, high - low), langs[low:high].view(np.uint64))
            for i, n in enumerate(x.words.counts.tolist()):
                if n:
                    totals[names[low + i]] = totals.get(names[low + i], 0) + n
            for n in range(2, LONGEST + 1):
                if len(x.of[1]) < n:
                    break
                own = group[low:high][x.text[:len(x.of[n])]].astype(np.uint64)
                at = np.flatnonzero(x.inside[n])
                at = at[bits.member(candidates.value, x.of[n][at] ^ (own[at] << np.uint64(2)) ^ (own[at] << np.uint64(33)))]
                h, first = np.unique(x.of[n][at], return_index=True)
                fresh = ~np.isin(h, seen, assume_unique=True)
                h, at = h[fresh], at[first[fresh]]
                if not len(at):
                    continue
                seen = np.concatenate([seen, h])
                start, end = x.words.start[at], x.words.end[at + n - 1]
                spelled = [x.words.data[a:b].tobytes().decode().replace("\t", " ") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                out = {"h": h.view(np.int64), "name": pa.array([names[low + i] for i in x.text[at].tolist()], pa.string()),
                       "phrase": pa.array([" ".join(filter(None, t.split(" "))) for t in spelled], pa.string()), "n": np.zeros(len(at), np.int64)}
                for k in (1, 2, 3):
                    out[f"l{k}"] = pa.array(x.of[k][at].view(np.int64), pa.int64()) if k < n else pa.nulls(len(at), pa.int64())
                    out[f"r{k}"] = pa.array(x.of[n - k][at + k].view(np.int64), pa.int64()) if k < n else pa.nulls(len(at), pa.int64())
                yield pa.record_batch(out)
    none = pa.nulls(len(totals), pa.int64())
    yield pa.record_batch({"h": none, "name": pa.array(list(totals), pa.string()), "phrase": pa.nulls(len(totals), pa.string()),
                           "n": pa.array(list(totals.values()), pa.int64()), **{f"{s}{k}": none for k in (1, 2, 3) for s in "lr"}})


def _parts(found: DataFrame) -> DataFrame:
    """``h, part``: the phrases of two and three words that lie inside each longer candidate."""
    two = found.where("l2 is not null").select("h", F.explode(F.array("l2", "r1")).alias("part"))
    inner = found.select(F.col("h").alias("part"), F.col("r1").alias("middle")).where("middle is not null")
    four = found.where("l3 is not null")
    # of four words a b c d: a b c and b c d, a b and c d, and b c as the rest of a b c
    return (two.join(four.select("h"), "h", "left_anti")
            .unionByName(four.select("h", F.explode(F.array("l3", "r1", "l2", "r2")).alias("part")))
            .unionByName(four.select("h", F.col("l3").alias("part")).join(inner, "part").select("h", F.col("middle").alias("part"))))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to four words of each language.

    A phrase counts by its worst cut, ``2,000,000 a / (l + r)``; it goes if a longer candidate that holds it
    has ``share`` percent of its occurrences.
    """
    spark = docs.sparkSession
    counts, _ = frequent(docs, least)
    long = counts.where(F.col("h").bitwiseAND(F.lit(3)) > 0)
    with_group = F.col("h").bitwiseXOR(F.shiftleft(F.col("g").cast("long"), 2)).bitwiseXOR(F.shiftleft(F.col("g").cast("long"), 33))
    wanted = spark.sparkContext.broadcast(bits.bitmap(long.select(with_group.alias("h")), "h", bits.size_for(long.count())))
    columns = "h long, name string, phrase string, n long, l1 long, r1 long, l2 long, r2 long, l3 long, r3 long"
    spelled = stage(_source(docs).select("lang", "name", "group", "text").mapInArrow(partial(_spell, candidates=wanted), columns), "phrases-spelled")
    words = spelled.where("h is null").groupBy("name").agg(F.sum("n").alias("n"))
    same = [F.min(c).alias(c) for c in ("name", "phrase", "l1", "r1", "l2", "r2", "l3", "r3")]
    found = stage(spelled.where("h is not null").groupBy("h").agg(*same).join(long.select("h", "c"), "h"), "phrases-found")
    cuts = found.select("h", "c", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("first"), F.col(f"r{k}").alias("rest")) for k in (1, 2, 3)])).alias("cut"))
    cuts = cuts.select("h", "c", "cut.*").where("first is not null")
    cuts = cuts.join(counts.select(F.col("h").alias("first"), F.col("c").alias("l")), "first")
    cuts = cuts.join(counts.select(F.col("h").alias("rest"), F.col("c").alias("r")), "rest")
    score = F.expr("cast(2000000 as decimal(18, 0)) * cast(c as decimal(18, 0)) div cast(l + r as decimal(20, 0))")
    worst = cuts.groupBy("h").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = _parts(found).join(found.select("h", F.col("c").alias("more")), "h").groupBy("part").agg(F.max("more").alias("more"))
    kept = found.join(longer.withColumnRenamed("part", "h"), "h", "left").where(f"more is null or 100 * more < {share} * c")
    rows = kept.select("h", "name", "phrase", F.col("c").alias("a")).join(worst, "h").select("name", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "name").select(F.col("name").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def twin(least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """The rows of ``collocations`` in DuckDB SQL, every phrase counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(
        f"SELECT lang, {k}::BIGINT AS size, array_to_string(w[p:p + {k - 1}], ' ') AS phrase FROM places WHERE p + {k - 1} <= len(w)" for k in range(1, LONGEST + 1))
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
        lists AS (SELECT lang, list_filter(string_split_regex(t, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM lists),
        f AS (SELECT lang, size, phrase, count(*)::BIGINT AS c FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
        words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
        cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        cuts AS (SELECT lang, phrase, c, unnest(range(1, size)) AS k, w FROM cand),
        scored AS (SELECT x.lang, x.phrase, x.c, k, a.c AS l, b.c AS r, ((2000000::HUGEINT * x.c) // (a.c + b.c))::BIGINT AS score FROM cuts x
            JOIN f a ON a.lang = x.lang AND a.phrase = array_to_string(x.w[1:k], ' ') JOIN f b ON b.lang = x.lang AND b.phrase = array_to_string(x.w[k + 1:], ' ')),
        worst AS (SELECT lang, phrase, c AS a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        spans AS (SELECT lang, c, w, unnest(flatten([[[s, m] for s in range(1, size - m + 2)] for m in range(2, size)])) AS span FROM cand WHERE size > 2),
        longer AS (SELECT lang, array_to_string(w[span[1]:span[1] + span[2] - 1], ' ') AS phrase, max(c) AS more FROM spans GROUP BY ALL),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
            FROM worst LEFT JOIN longer USING (lang, phrase) JOIN words USING (lang) WHERE more IS NULL OR 100 * more < {share} * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}"""
