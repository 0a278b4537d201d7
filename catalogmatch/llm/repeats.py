"""Substring dedup by level-wise doubling.

Whether a window of words repeats is settled at a short length first: only windows whose part of
that length repeats are looked at again at twice the length, up to the length asked for.  At a short
length not every position is sent around: each full window names the part with the least hash among
its parts, so equal windows name equal parts and nothing is lost, at about a quarter of the rows.

Defined results: a null or empty text has no words; a document without ``doc_id`` counts as later
than every other and not as earlier than its like; rows with one ``doc_id`` are one document for the
comparison and keep their own texts; a window repeated only inside one document stays.  Windows are
compared by 64-bit hashes.

Lists of repeated parts are gathered by id, but by text (``row``) where rows have no id or an id has
more than ``SHARED`` of the rows (and over ``FEW``), so no list grows with the rows of one id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm import words as w
from catalogmatch.llm.staging import LAST, stage

WINDOW = 13
SHARED, FEW = 0.00001, 100  # of these ids there are at most 100,000, so their list is broadcast


def lengths(window: int) -> list[int]:
    """Lengths of the levels: halves of ``window`` down to four words at least, shortest first."""
    out = [window]
    while out[0] > 13:
        out.insert(0, -(-out[0] // 2))
    if out[0] > 3:
        out.insert(0, -(-out[0] // 2))
    return out


def _member(values: np.ndarray, text: np.ndarray, known: pa.Array) -> np.ndarray:
    """Which values are in the list of their text."""
    offsets = known.offsets.to_numpy().astype(np.int64)
    flat = known.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    keep = np.zeros(len(values), bool)
    cuts = np.searchsorted(text, np.arange(len(known) + 1))
    for i in np.flatnonzero(np.diff(offsets)):
        part = slice(cuts[i], cuts[i + 1])
        keep[part] = np.isin(values[part], flat[offsets[i]:offsets[i + 1]])
    return keep


def _named_parts(x: w.Words, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each full window, its text, and the hash of the part of ``length`` words it names."""
    at = w.inside(x, window)
    named = w.lowest(w.windows(x.hash, length), window - length + 1)
    return at, x.text_of()[at], named[at]


def _emit(batches: Iterator[pa.RecordBatch], window: int, before: int | None, length: int) -> Iterator[pa.RecordBatch]:
    """(part, ord, row) of the parts of ``length`` words that windows name, where those of the level before survived."""
    for batch in batches:
        texts = batch.column("text")
        order, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "row"))
        for low, high in w.slices(texts):
            x = w.split(texts.slice(low, high - low))
            _, text, value = _named_parts(x, window, length)
            if before is not None:
                _, _, old = _named_parts(x, window, before)
                keep = _member(old, text, _compact(batch.column("known"), low, high))
                text, value = text[keep], value[keep]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
            yield pa.record_batch({"part": value[new].view(np.int64), "ord": order[low:high][text[new]], "row": row[low:high][text[new]]})


def _compact(lists: pa.Array, low: int, high: int) -> pa.Array:
    """A slice of a list column whose offsets start at its own values; null is the empty list."""
    part = lists.slice(low, high - low)
    return pa.ListArray.from_arrays(
        np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))).astype(np.int32),
        part.flatten())


def _repeated(parts: DataFrame) -> DataFrame:
    """Parts that several documents have, with the first of these."""
    return (parts.groupBy("part").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
            .where("first < last").select("part", "first"))


def _known(parts: DataFrame, repeated: DataFrame, later: bool = False) -> DataFrame:
    """``ord, row, known``: per text its repeated parts; ``later`` leaves out those its document is the first to have."""
    hit = parts.join(repeated, "part")
    if later:
        hit = hit.where("first < ord")
    return hit.groupBy("ord", "row").agg(F.collect_set("part").alias("known"))


def ordered(docs: DataFrame) -> DataFrame:
    """``doc_id``, the place ``ord`` in the order of documents, ``row`` and ``text``.

    ``row`` is 0, and a hash of the text for rows without id or with an id that many have.  Where texts
    of one place agree in it, they share a list, which changes nothing: whether a part repeats, or is a
    later one, hangs on part and place only.
    """
    counts = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__shared")).count()
    shared = stage(counts.where(F.col("count") > max(FEW, int(SHARED * docs.count()))).select("__shared"), "repeats-shared")
    rows = docs.select("doc_id", "text").join(F.broadcast(shared), F.col("doc_id") == F.col("__shared"), "left")
    apart = F.col("doc_id").isNull() | F.col("__shared").isNotNull()
    return rows.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
                       F.when(apart, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("row"), "text")


def repeated_windows(source: DataFrame, window: int = WINDOW) -> DataFrame:
    """``ord, row, known``: per text of ``ordered`` the hashes of its windows that also start in an earlier document.

    Every level is one aggregation, with partial sums, and one join back to the texts that have
    a repeated part; no group of documents is ever gathered.
    """
    before, known = None, None
    for length in lengths(window):
        rows = source if known is None else source.join(known, ["ord", "row"])
        parts = rows.mapInArrow(partial(_emit, window=window, before=before, length=length), "part long, ord long, row long")
        repeated = stage(_repeated(parts), f"repeats-{length}")
        known = _known(parts, repeated, later=length == window)
        before = length
    return known


def _covered(x: w.Words, window: int, known: pa.Array) -> np.ndarray:
    at, text, value = _named_parts(x, window, window)
    hit = at[_member(value, text, known)]
    edge = np.zeros(len(x.hash) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _removal(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("doc_id")
        for low, high in w.slices(texts):
            x = w.split(texts.slice(low, high - low))
            gone = _covered(x, window, _compact(batch.column("known"), low, high))
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[x.first[1:]] - total[x.first[:-1]]
            kept = []
            for i, (a, b) in enumerate(zip(x.first[:-1], x.first[1:], strict=True)):
                found = x.data[x.text_at[i]:x.text_at[i + 1]].tobytes().split()
                if removed[i]:
                    found = [word for word, out in zip(found, gone[a:b], strict=True) if not out]
                kept.append(b" ".join(found))
            out = {"doc_id": ids.slice(low, high - low), "n_words": pa.array(x.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            if digest:
                out["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())
            else:
                out["text"] = pa.array([t.decode("utf-8", "replace") for t in kept], pa.string())
            yield pa.record_batch(out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the ``text`` of the kept words joined by one space.

    A word goes if a window of ``window`` words that covers it also starts in an earlier document.
    ``digest`` gives ``kept_sha256`` in place of the text.
    """
    source = ordered(docs)
    known = repeated_windows(source, window).withColumnsRenamed({"ord": "known_ord", "row": "known_row"})
    rows = source.join(known, (source.ord == known.known_ord) & (source.row == known.known_row), "left").select("doc_id", "text", "known")
    last = "kept_sha256 string" if digest else "text string"
    return rows.mapInArrow(partial(_removal, window=window, digest=digest), f"doc_id long, n_words long, n_removed long, {last}")


def twin(window: int = WINDOW) -> str:
    """The digests of ``remove_repeats`` in DuckDB SQL, on windows as text."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS ord,
            list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        places AS (SELECT r, ord, w, unnest(range(1, len(w) + 1)) AS p FROM d),
        wins AS (SELECT r, ord, p, array_to_string(w[p:p + {window - 1}], ' ') AS k FROM places WHERE p + {window - 1} <= len(w)),
        seen AS (SELECT k, min(ord) AS first FROM wins GROUP BY k),
        hits AS (SELECT r, unnest(range(p, p + {window})) AS p FROM wins JOIN seen USING (k) WHERE first < ord),
        gone AS (SELECT DISTINCT r, p FROM hits),
        kept AS (SELECT r, string_agg(w[p], ' ' ORDER BY p) AS text, count(*) AS n FROM places ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)"""
