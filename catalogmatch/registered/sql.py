"""Pieces of DuckDB SQL shared by the twins.

They are written from the semantics, in another way than the Spark expressions where there is a
choice (accents by ``strip_accents``, longest common subsequence by a table of rows).
"""

from __future__ import annotations

from catalogmatch.functions.measures import UNITS
from catalogmatch.functions.text import SPLIT_WORDS, portuguese_stopwords


def _stopword_list() -> str:
    return "[" + ",".join(f"'{w}'" for w in portuguese_stopwords()) + "]"


def fold(e: str) -> str:
    plain = f"strip_accents(lower(coalesce({e}, '')))"
    kept = f"regexp_replace({plain}, '[^a-zA-Z0-9\\s]', '', 'g')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


def words(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '\\s+'), lambda w: w <> '')"


def stop(e: str) -> str:
    for a, b in SPLIT_WORDS:
        e = f"regexp_replace({e}, '\\b({a})({b})\\b', '\\1 \\2', 'g')"
    return f"array_to_string(list_filter({words(e)}, lambda w: NOT list_contains({_stopword_list()}, w)), ' ')"


def dedupe(e: str) -> str:
    """For short texts; null stays null."""
    return (f"CASE WHEN {e} IS NULL THEN NULL ELSE array_to_string(list_filter({words(e)}, "
            f"lambda w, i: list_position({words(e)}, w) = i), ' ') END")


def convert(e: str) -> str:
    m = f"trim(upper({e}))"
    pattern = f"(\\d+[\\.,]?\\d*)\\s*({'|'.join(u for u, _, _ in UNITS)})"
    unit = f"regexp_extract({m}, '{pattern}', 2)"
    number = f"CAST(replace(regexp_extract({m}, '{pattern}', 1), ',', '.') AS DOUBLE)"
    cases = " ".join(f"WHEN '{u}' THEN CAST({number} * CAST({f} AS DOUBLE) AS VARCHAR) || '{t}'"
                     for u, f, t in UNITS if f is not None)
    return f"(CASE {unit} {cases} ELSE {m} END)"


def processed_measure(e: str) -> str:
    return stop(fold(f"replace({convert(e)}, '.0', '')"))


_FILLED = """filled AS (SELECT replace(grp_insumo, '.0', '') AS grp_insumo, cd_insumo, insumo,
    coalesce(descricao, '') AS descricao, coalesce(marca, 'SEM MARCA') AS marca,
    coalesce(embalagem, '') AS embalagem, coalesce(qtd_medida, '') AS qtd_medida,
    coalesce(cd_medida, '') AS cd_medida, coalesce(medida, '') AS medida, status FROM raw)"""
_COMPOSED = """composed AS (SELECT *, replace(qtd_medida, '.0', '') || medida AS medida_pad,
    insumo || ' ' || descricao || ' (' || embalagem || ')' AS insumo_descricao,
    replace(qtd_medida, '.0', '') || ' ' || cd_medida AS medida_abv FROM filled)"""


def catalog_ctes() -> str:
    """``filled, composed, display, processed`` on top of ``raw``."""
    display = f"""display AS (SELECT grp_insumo, cd_insumo, {dedupe('insumo_descricao')} AS insumo_descricao,
        {dedupe('marca')} AS marca, {dedupe('medida_abv')} AS medida, status
        FROM composed WHERE insumo IS NOT NULL)"""
    projected = f"""projected AS (SELECT grp_insumo, cd_insumo, {dedupe('insumo_descricao')} AS insumo_descricao,
        {dedupe('marca')} AS marca, {dedupe('medida_pad')} AS medida FROM composed WHERE insumo IS NOT NULL)"""
    processed = f"""processed AS MATERIALIZED (SELECT grp_insumo, cd_insumo, {stop(fold('insumo_descricao'))} AS insumo_descricao,
        {stop(fold('marca'))} AS marca, {processed_measure('medida')} AS medida FROM projected)"""
    return ", ".join([_FILLED, _COMPOSED, display, projected, processed])


def expanded_ctes() -> str:
    """``expanded``: the query table ``q0`` with unit codes replaced, on top of ``raw``."""
    lookup = f"""lookup AS (SELECT {fold('cd_medida')} AS unit_key, min(medida) AS unit_name
        FROM units GROUP BY 1 HAVING min(medida) IS NOT NULL)"""
    compact = """compact AS (SELECT query_id, descricao, coalesce(marca, '') AS marca,
        CASE WHEN trim(coalesce(medida, '')) = '' THEN '' ELSE replace(medida, ' ', '') END AS m FROM q0)"""
    keyed = f"""keyed AS (SELECT *, regexp_extract(m, '^(\\d+)([a-zA-Z]+)', 1) AS digits,
        {fold("CASE WHEN regexp_matches(m, '^\\d+[a-zA-Z]+') THEN regexp_extract(m, '^(\\d+)([a-zA-Z]+)', 2) ELSE m END")} AS k
        FROM compact)"""
    expanded = """expanded AS (SELECT query_id, descricao, marca,
        coalesce(digits || unit_name, m) AS medida FROM keyed LEFT JOIN lookup ON k = unit_key)"""
    return ", ".join([lookup, compact, keyed, expanded])


def query_ctes() -> str:
    """``q``: standardized queries with ``consulta``, on top of ``raw``."""
    q = f"""q AS MATERIALIZED (SELECT query_id, descricao AS consulta, {stop(fold('descricao'))} AS descricao,
        {stop(fold('marca'))} AS marca, {processed_measure('medida')} AS medida FROM expanded)"""
    return f"{expanded_ctes()}, {q}"


def ratio_ctes(name: str, source: str) -> str:
    """``name(a, b, ratio)``: token-set similarity of the distinct pairs of ``source(a, b)``."""
    def tokens(e: str) -> str:
        return f"list_distinct({words(f'coalesce({e}, chr(0))')})".replace("chr(0)", "''")

    def join(e: str) -> str:
        return f"array_to_string(list_sort({e}), ' ')"

    lcs = """list_reduce(list_transform(string_split(only_b, ''), lambda c: [unicode(c)]), lambda row, c:
        list_reduce(list_transform(range(1, length(only_a) + 1), lambda i: [i]), lambda acc, i:
            list_append(acc, CASE WHEN chars_a[i[1]] = c[1] THEN row[i[1]] + 1
                             ELSE greatest(acc[-1], row[i[1] + 1]) END), [CAST(0 AS BIGINT)]),
        list_transform(range(0, length(only_a) + 1), lambda z: CAST(0 AS BIGINT)))[-1]"""
    ratio = "(CAST(100 AS DOUBLE) - CAST(100 AS DOUBLE) * ({0}) / ({1}))"
    return f"""{name}_s AS (SELECT a, b, {tokens('a')} AS ta, {tokens('b')} AS tb FROM (SELECT DISTINCT a, b FROM ({source}))),
    {name}_p AS (SELECT a, b, len(ta) AS na, len(tb) AS nb,
        length(array_to_string(list_filter(ta, lambda w: list_contains(tb, w)), ' ')) AS s,
        {join('list_filter(ta, lambda w: NOT list_contains(tb, w))')} AS only_a,
        {join('list_filter(tb, lambda w: NOT list_contains(ta, w))')} AS only_b FROM {name}_s),
    {name}_d AS (SELECT DISTINCT only_a, only_b, list_transform(string_split(only_a, ''), lambda x: unicode(x)) AS chars_a
        FROM {name}_p WHERE only_a <> '' AND only_b <> '' AND na > 0 AND nb > 0),
    {name}_l AS (SELECT only_a, only_b, {lcs} AS lcs FROM {name}_d),
    {name}_n AS (SELECT a, b, na, nb, s, length(p.only_a) AS la, length(p.only_b) AS lb, coalesce(lcs, 0) AS lcs,
        s + (s > 0)::INT + length(p.only_a) AS x, s + (s > 0)::INT + length(p.only_b) AS y
        FROM {name}_p p LEFT JOIN {name}_l l ON p.only_a = l.only_a AND p.only_b = l.only_b),
    {name} AS (SELECT a, b, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE
        WHEN s > 0 AND (la = 0 OR lb = 0) THEN 1.0::DOUBLE
        WHEN s = 0 THEN {ratio.format('la + lb - 2 * lcs', 'x + y')} / 100
        ELSE greatest({ratio.format('la + lb - 2 * lcs', 'x + y')}, {ratio.format('1 + la', 's + x')},
                      {ratio.format('1 + lb', 's + y')}) / 100 END AS ratio FROM {name}_n)"""


def blank(e: str) -> str:
    return f"(trim(coalesce({e}, '')) = '')"


def no_brand(e: str) -> str:
    return f"(lower(trim(coalesce({e}, ''))) IN ('', 'sem marca'))"


_PARSED = "^(\\d+(?:[.,]\\d+)?)\\s*([a-zA-Zçãáéíóú\\s]*)$"


def parsed_value(e: str) -> str:
    m = f"lower(trim(coalesce({e}, '')))"
    return f"TRY_CAST(replace(regexp_extract({m}, '{_PARSED}', 1), ',', '.') AS DOUBLE)"


def parsed_unit(e: str) -> str:
    m = f"lower(trim(coalesce({e}, '')))"
    return f"CASE WHEN regexp_matches({m}, '{_PARSED}') THEN trim(regexp_extract({m}, '{_PARSED}', 2)) ELSE {m} END"


def measure_similarity(q: str, d: str, fallback: str) -> str:
    qv, dv, qu, du = parsed_value(q), parsed_value(d), parsed_unit(q), parsed_unit(d)
    return f"""CASE WHEN {blank(q)} THEN 1.0::DOUBLE WHEN {blank(d)} THEN 0.0::DOUBLE
        WHEN {qv} IS NOT NULL AND {dv} IS NOT NULL THEN
            CASE WHEN ({qu}) = ({du}) OR ({qu}) = '' OR ({du}) = ''
                 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - abs({qv} - {dv}) / greatest(abs({qv}), abs({dv}), 1.0::DOUBLE))
                 ELSE 0.0::DOUBLE END
        ELSE {fallback} END"""


def sims_ctes(pairs: str) -> str:
    """``sims``: ``pairs(query_id, cd_insumo, score_sbert, q_*, d_*)`` with the three similarities."""
    brand_query = f"CASE WHEN {no_brand('q_marca')} THEN '' ELSE q_marca END"
    return ", ".join([
        f"pairs AS MATERIALIZED ({pairs})",
        ratio_ctes("rd", "SELECT q_descricao AS a, d_descricao AS b FROM pairs"),
        ratio_ctes("rm", f"SELECT {brand_query} AS a, d_marca AS b FROM pairs"),
        ratio_ctes("rx", f"""SELECT q_medida AS a, d_medida AS b FROM pairs WHERE NOT {blank('q_medida')}
            AND NOT {blank('d_medida')} AND ({parsed_value('q_medida')} IS NULL OR {parsed_value('d_medida')} IS NULL)"""),
        f"""sims AS (SELECT pairs.*, rd.ratio AS sim_desc, rm.ratio AS sim_marca,
            {measure_similarity('q_medida', 'd_medida', 'rx.ratio')} AS sim_medida
            FROM pairs LEFT JOIN rd ON rd.a = q_descricao AND rd.b = d_descricao
            LEFT JOIN rm ON rm.a = {brand_query} AND rm.b = d_marca
            LEFT JOIN rx ON rx.a = q_medida AND rx.b = d_medida)""",
    ])


def weight_ctes(weights: tuple[float, float, float, float] = (0.5, 0.0, 0.25, 0.25)) -> str:
    """``weighted``: ``sims`` with effective weights ``w_*`` and ``score``."""
    s, d, m, x = (f"CAST({v} AS DOUBLE)" for v in weights)
    return f"""kept AS (SELECT *, {s} AS k_s, CASE WHEN {blank('q_descricao')} THEN 0.0::DOUBLE ELSE {d} END AS k_d,
        CASE WHEN {no_brand('q_marca')} THEN 0.0::DOUBLE ELSE {m} END AS k_m,
        CASE WHEN {blank('q_medida')} THEN 0.0::DOUBLE ELSE {x} END AS k_x FROM sims),
    shares AS (SELECT *, k_s + k_d + k_m + k_x AS k_t FROM kept),
    given AS (SELECT *, CASE WHEN k_t <= 0 THEN {s} ELSE k_s / k_t END AS w_sbert,
        CASE WHEN k_t <= 0 THEN {d} ELSE k_d / k_t END AS w_desc,
        CASE WHEN k_t <= 0 THEN {m} ELSE k_m / k_t END AS w_marca,
        CASE WHEN k_t <= 0 THEN {x} ELSE k_x / k_t END AS w_medida FROM shares),
    weighted AS (SELECT *, 100.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, w_sbert * score_sbert
        + w_desc * sim_desc + w_marca * sim_marca + w_medida * sim_medida)) AS score FROM given)"""


def ranked_cte(threshold: float) -> str:
    return f"""ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, score_sbert DESC, cd_insumo) AS INTEGER) AS rank
        FROM weighted WHERE score >= {threshold})"""


def knn_ctes(queries: str, items: str, k: int) -> str:
    """``knn(query_id, cd_insumo, score_sbert, knn_rank)`` of two relations with ``vector``."""
    return f"""kq AS MATERIALIZED (SELECT query_id, CAST(vector AS DOUBLE[]) AS v FROM {queries}),
    ki AS MATERIALIZED (SELECT cd_insumo, CAST(vector AS DOUBLE[]) AS v FROM {items}),
    kp AS (SELECT query_id, cd_insumo, round(coalesce(list_inner_product(kq.v, ki.v)
            / nullif(sqrt(list_inner_product(kq.v, kq.v)) * sqrt(list_inner_product(ki.v, ki.v)), 0), 0), 6) + 0.0 AS sim
        FROM kq, ki),
    kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cd_insumo) AS INTEGER) AS knn_rank FROM kp),
    knn AS MATERIALIZED (SELECT query_id, cd_insumo, greatest(0.0::DOUBLE, least(1.0::DOUBLE, sim)) AS score_sbert, knn_rank
        FROM kr WHERE knn_rank <= {k})"""


def lsh_ctes(queries: str, items: str, planes, tables: int, probes: int, k: int) -> str:
    """``lsh(query_id, cd_insumo, score_sbert, knn_rank)``: the best of the buckets that each query looks into.

    ``planes`` are the random directions of all tables in turn.
    """
    bits = len(planes) // tables
    lists = ", ".join(f"[{', '.join(repr(float(x)) for x in plane)}]::DOUBLE[]" for plane in planes)
    return f"""lp AS MATERIALIZED (SELECT i // {bits} AS tab, i % {bits} AS bit, p[i + 1] AS plane FROM (SELECT [{lists}] AS p), range({len(planes)}) r(i)),
    lq AS MATERIALIZED (SELECT query_id, CAST(vector AS DOUBLE[]) AS v FROM ({queries})),
    li AS MATERIALIZED (SELECT cd_insumo, CAST(vector AS DOUBLE[]) AS v FROM {items}),
    lb AS MATERIALIZED (SELECT cd_insumo, tab, sum(CASE WHEN list_inner_product(v, plane) >= 0 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS bucket
        FROM li, lp GROUP BY ALL),
    ls AS MATERIALIZED (SELECT query_id, tab, bit, list_inner_product(v, plane) AS side FROM lq, lp),
    lo AS (SELECT query_id, tab, sum(CASE WHEN side >= 0 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS bucket FROM ls GROUP BY ALL),
    lc AS (SELECT query_id, tab, s, sum(side * side * ((s >> bit) & 1)) AS cost FROM ls, range({2 ** bits}) r(s) GROUP BY ALL),
    lr AS (SELECT query_id, tab, s, row_number() OVER (PARTITION BY query_id, tab ORDER BY cost, s) AS place FROM lc),
    lw AS (SELECT query_id, tab, xor(bucket, s) AS bucket FROM lr JOIN lo USING (query_id, tab) WHERE place <= {probes}),
    lf AS (SELECT DISTINCT query_id, cd_insumo FROM lw JOIN lb USING (tab, bucket)),
    lm AS (SELECT query_id, cd_insumo, round(coalesce(list_inner_product(lq.v, li.v)
        / nullif(sqrt(list_inner_product(lq.v, lq.v)) * sqrt(list_inner_product(li.v, li.v)), 0), 0), 6) + 0.0 AS sim
        FROM lf JOIN lq USING (query_id) JOIN li USING (cd_insumo)),
    lsh AS (SELECT query_id, cd_insumo, greatest(0.0::DOUBLE, least(1.0::DOUBLE, sim)) AS score_sbert,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cd_insumo) AS INTEGER) AS knn_rank FROM lm QUALIFY knn_rank <= {k})"""


def hash_vectors(name: str, source: str, key: str, dim: int = 256) -> str:
    """``name(key, vector)``: hashed word and trigram counts of ``source(key, txt)``, unit length."""
    grams = "flatten(list_transform(ws, lambda w: list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3))))"
    return f"""{name}_w AS (SELECT {key}, {words('txt')} AS ws FROM ({source})),
    {name}_f AS (SELECT {key}, unnest(list_concat(ws, {grams})) AS f FROM {name}_w),
    {name}_c AS (SELECT {key}, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % {dim} AS bucket, count(*) AS n FROM {name}_f GROUP BY ALL),
    {name}_m AS (SELECT {key}, map_from_entries(list(row(bucket, n))) AS m, sqrt(sum(n * n)::DOUBLE) AS len FROM {name}_c GROUP BY {key}),
    {name} AS MATERIALIZED (SELECT w.{key} AS {key}, list_transform(range(0, {dim}), lambda b:
        CAST(CASE WHEN m.len IS NULL THEN 0.0::DOUBLE ELSE coalesce(m.m[b], 0) / m.len END AS FLOAT)) AS vector
        FROM {name}_w w LEFT JOIN {name}_m m ON w.{key} = m.{key})"""


def digest(e: str) -> str:
    """A vector as text of four-digit integers, comparable across engines."""
    return f"array_to_string(list_transform({e}, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS INTEGER)), ',')"


def with_(*ctes: str, then: str) -> str:
    return "WITH " + ", ".join(c for c in ctes if c) + " " + then
