"""Pieces of DuckDB SQL that mirror inputs.py and the operators."""

from __future__ import annotations

from ..functions.text import DOUBLE_QUOTES, PUNCTUATION, SINGLE_QUOTES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[ \n\t\r]+'), lambda w_: w_ <> '')"


def upos(w: str) -> str:
    return rf"CASE WHEN NOT regexp_matches({w}, '[\p{{L}}\p{{N}}]') THEN 'PUNCT' WHEN regexp_matches({w}, '^[0-9]+$') THEN 'NUM' ELSE 'WORD' END"


def key(w: str) -> str:
    return f"lower({w}) || '_' || {upos(w)}"


LINES = f"""cut AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, lang, source, parts, unnest(range(1, len(parts) + 1)) AS line_no FROM cut),
lines AS (SELECT doc_id, lang, source, line_no::INT AS line_no, parts[line_no] AS text, length(parts[line_no])::INT AS char_len, len({words('parts[line_no]')})::INT AS token_count FROM numbered)"""

DOC_KEYS = f"""toks AS (SELECT doc_id, lang, source, unnest({words('text')}) AS w FROM documents),
doc_keys AS (SELECT doc_id, lang, source, translate(lower(w), 'ё', 'е') || '_' || {upos('w')} AS key, CASE WHEN try_cast(substr(source, 4, 10) AS INT) < 10 THEN 'pre' ELSE 'post' END AS period FROM toks)"""

PAIRS = f"""turns AS (SELECT conv_id, turn, role, {words('text')} AS w FROM conversations),
pairs AS (SELECT u.conv_id, u.turn, u.conv_id % 3 AS model, u.w AS h, a.w AS m FROM turns u JOIN turns a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def wlas(k: int = 12, m: int = 1, policy: str = "quantile", trim: bool = False, by: str = "", where: str = "true", name: str = "t", exclude: tuple[str, ...] = (), jitter: int | None = None) -> str:
    """CTEs that end in `name`: (by, key, n_pairs, c_H, c_M, ell_H, ell_M, LAS). PAIRS must stand before them."""
    n = name
    comma, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    span = f"least(len(h), len(m)) - {k}" if trim else f"CASE side WHEN 'h' THEN len(h) ELSE len(m) END - {k}"
    start = {"first": "0", "last": "span", "quantile": f"least(span, greatest(0, floor((i + 0.5) / {m} * span)))::INT"}[policy]
    if jitter is not None:
        hexed = f"md5(concat_ws('|', conv_id || '-' || turn, side, i, '{jitter}'))"
        drawn = f"list_sum(list_transform(range(7), lambda d_: (strpos('0123456789abcdef', substr({hexed}, d_::INT + 1, 1)) - 1) * (16 ** (6 - d_))::BIGINT))::DOUBLE"
        at = f"(i + 0.5::DOUBLE) / {m} + ({drawn} / {1 << 28}::DOUBLE - 0.5::DOUBLE) / {m}"
        start = f"least(span, greatest(0, floor(least(greatest({at}, 0.0::DOUBLE), 1.0::DOUBLE) * span)))::INT"
    if policy != "quantile":
        m = 1
    out = f" WHERE {upos('w')} NOT IN ({', '.join(map(q, exclude))})" if exclude else ""
    return f"""{n}_elig AS (SELECT *, row_number() OVER () AS pid FROM pairs WHERE len(h) >= {k} AND len(m) >= {k} AND {where}),
{n}_n AS (SELECT {comma}count(*) AS n_pairs FROM {n}_elig {group}),
{n}_sides AS (SELECT pid, conv_id, turn, {comma}side, i, CASE side WHEN 'h' THEN h ELSE m END AS ws, ({span})::INT AS span FROM {n}_elig, (VALUES ('h'), ('m')) s(side), range({m}) r(i)),
{n}_words AS (SELECT pid, {comma}side, i, unnest(list_slice(ws, {start} + 1, {start} + {k})) AS w FROM {n}_sides),
{n}_seen AS (SELECT DISTINCT pid, {comma}side, i, {key('w')} AS key FROM {n}_words{out}),
{n}_c AS (SELECT {comma}key, count(*) FILTER (side = 'h') / {m}::DOUBLE AS c_H, count(*) FILTER (side = 'm') / {m}::DOUBLE AS c_M FROM {n}_seen GROUP BY {comma}key),
{n}_e AS (SELECT *, (c_H + 0.5) / (n_pairs + 1.0::DOUBLE) AS ell_H, (c_M + 0.5) / (n_pairs + 1.0::DOUBLE) AS ell_M FROM {n}_c {f'JOIN {n}_n USING ({by})' if by else f'CROSS JOIN {n}_n'}),
{n} AS (SELECT *, ell_M - ell_H AS LAS, (c_M + 0.5) / (c_H + 0.5) AS count_ratio_MH, (c_M >= 20)::INT AS lpr_guard_ok FROM {n}_e)"""


RANKED = """ranked AS (SELECT *, row_number() OVER (ORDER BY LAS DESC, key) AS rank_LAS, row_number() OVER (ORDER BY CASE WHEN lpr_guard_ok = 1 THEN count_ratio_MH ELSE 1.0 END DESC, key) AS rank_LPR,
 CASE WHEN lpr_guard_ok = 1 THEN ln(count_ratio_MH) ELSE 0.0 END AS lpr_MH_guarded, ln(count_ratio_MH) AS lpr_MH, regexp_extract(key, '_([^_]*)$', 1) AS upos FROM t)"""

DISCOVERED = f"{PAIRS}, {wlas()}, {RANKED}"


def basic_clean(x: str) -> str:
    quotes = q(DOUBLE_QUOTES + SINGLE_QUOTES)
    to = q('"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))
    no_controls = rf"regexp_replace({x}, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')"
    return rf"replace(translate(trim(regexp_replace({no_controls}, '\s+', ' ', 'g')), {quotes}, {to}), '…', '...')"


def digit_dominated(x: str) -> str:
    both = rf"length(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    return rf"coalesce(length(regexp_replace({x}, '[^\p{{Nd}}]', '', 'g')) / nullif({both}, 0)::DOUBLE > 0.5, false)"


def repetition(x: str) -> str:
    """CTE columns n, ttr, top of a column of texts named x."""
    w = words(f"lower({x})")
    return f"len({w})::INT AS n, coalesce(len(list_distinct({w})) / nullif(len({w}), 0)::DOUBLE, 1.0) AS ttr, coalesce(list_max(list_transform(list_distinct({w}), lambda d_: len(list_filter({w}, lambda v_: v_ = d_)))) / nullif(len({w}), 0)::DOUBLE, 0.0) AS top"


def punctuation_share(x: str) -> str:
    solid = rf"regexp_replace({x}, '\s+', '', 'g')"
    return f"coalesce((length({solid}) - length(translate({solid}, {q(PUNCTUATION)}, ''))) / nullif(length({solid}), 0)::DOUBLE, 0.0)"


def markup(x: str) -> str:
    return rf"(regexp_matches({x}, '(?i)```|<code>|</code>|def\s+\w+\s*\(|class\s+\w+|function\s+\w+\s*\(|var\s+\w+\s*=') OR regexp_matches({x}, '</?[A-Za-z][^>]*>'))"


def chi2(a: str, b: str, c: str, d: str) -> str:
    n = f"({a} + {b} + {c} + {d})"
    gap = f"greatest(abs({a} * {d} - {b} * {c}) - {n} / 2, 0.0)"
    return f"({n} * {gap} * {gap} / nullif(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}), 0))"


def pearson(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
