"""The chunker restated as SQL for DuckDB: lines and blocks by windows, packing by list_reduce, and one recursive step for each block."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"
_SPLIT = r"[\s\x1c-\x1f\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SPLIT}'), lambda ww: ww <> '')"


def _tokens(x: str) -> str:
    return f"list_transform([{x}], lambda yy: CASE WHEN yy = '' THEN 0 ELSE greatest(len({_words('yy')}), length(yy) // 3) END)[1]"


def _sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _costs(items: str, cost: str) -> str:
    return f"list_transform({items}, lambda it: {{'done': []::VARCHAR[], 'open': it, 'used': 0::BIGINT, 'cost': ({cost})::BIGINT}})"


def _packed(items: str, budget: str, joint: str, cost: str | None = None) -> str:
    """A list of texts, joined greedily within a budget."""
    step = f"""CASE WHEN aa.open IS NOT NULL AND aa.used + xx.cost > {budget}
      THEN {{'done': aa.done || [aa.open], 'open': xx.open, 'used': xx.cost, 'cost': 0::BIGINT}}
      ELSE {{'done': aa.done, 'open': CASE WHEN aa.open IS NULL THEN xx.open ELSE aa.open || {joint} || xx.open END, 'used': aa.used + xx.cost, 'cost': 0::BIGINT}} END"""
    start = "{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'used': 0::BIGINT, 'cost': 0::BIGINT}"
    reduced = f"list_reduce({_costs(items, cost or _tokens('it'))}, lambda aa, xx: {step}, {start})"
    return f"list_transform([{reduced}], lambda rr: CASE WHEN rr.open IS NULL THEN rr.done ELSE rr.done || [rr.open] END)[1]"


def _fitted(x: str, size: int) -> str:
    """Runs of words of at most ``size`` tokens; longer words by characters."""
    part = 3 * size + 2
    long = f"list_transform(range(0, (length(xx.open) + {part - 1}) // {part}), lambda jj: substr(xx.open, (jj * {part} + 1)::INT, {part}))"
    joined = "aa.open || ' ' || xx.open"
    step = f"""CASE WHEN length(xx.open) // 3 > {size}
      THEN {{'done': (CASE WHEN aa.open IS NULL THEN aa.done ELSE aa.done || [aa.open] END) || {long}, 'open': NULL::VARCHAR, 'used': 0::BIGINT, 'cost': 0::BIGINT}}
      WHEN aa.open IS NULL THEN {{'done': aa.done, 'open': xx.open, 'used': 1::BIGINT, 'cost': 0::BIGINT}}
      WHEN greatest(aa.used + 1, length({joined}) // 3) > {size} THEN {{'done': aa.done || [aa.open], 'open': xx.open, 'used': 1::BIGINT, 'cost': 0::BIGINT}}
      ELSE {{'done': aa.done, 'open': {joined}, 'used': aa.used + 1, 'cost': 0::BIGINT}} END"""
    start = "{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'used': 0::BIGINT, 'cost': 0::BIGINT}"
    reduced = f"list_reduce({_costs(_words(x), '1')}, lambda aa, xx: {step}, {start})"
    return f"list_transform([{reduced}], lambda rr: CASE WHEN rr.open IS NULL THEN rr.done ELSE rr.done || [rr.open] END)[1]"


def chunks_sql(pages: str, key: str, size: int, overlap: int) -> str:
    """SQL for ``(key, text, chunk_index, page_number)`` from a query for pages (k, page_number, text), whose order in a document is that of page_number."""
    strip, n = f"trim({{}}, {_SPACES})", "chr(10)"
    rows = f"string_split(text, {n})"
    head = f"array_to_string({rows}[1:h], {n})"
    return rf"""WITH RECURSIVE pages AS MATERIALIZED (SELECT * FROM ({pages}) WHERE {strip.format('text')} <> ''),
    lines AS MATERIALIZED (SELECT k, page_number, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM (SELECT k, page_number, string_split(text, {n}) AS parts FROM pages)),
    opens AS (SELECT k, page_number, i, regexp_extract(line, '^(`{{3,}}|~{{3,}})', 1) AS fence FROM lines WHERE regexp_matches(line, '^(`{{3,}}|~{{3,}})')),
    closed AS (SELECT o.k, o.page_number, o.i, min(c.i) AS last FROM opens o JOIN lines c ON c.k = o.k AND c.page_number = o.page_number AND c.i >= o.i + 2 AND rtrim(c.line, {_SPACES}) = o.fence GROUP BY ALL),
    chosen AS (SELECT k, page_number, list_reduce(list({{'picked': []::BIGINT[], 'first': i::BIGINT, 'last': last::BIGINT}} ORDER BY i),
        lambda aa, xx: CASE WHEN xx.first > aa.last THEN {{'picked': aa.picked || [xx.first, xx.last], 'first': 0::BIGINT, 'last': xx.last}} ELSE aa END,
        {{'picked': []::BIGINT[], 'first': 0::BIGINT, 'last': 0::BIGINT}}).picked AS p FROM closed GROUP BY ALL),
    fences AS (SELECT k, page_number, unnest(list_transform(range(0, len(p) // 2), lambda jj: p[2 * jj + 1])) AS first, unnest(list_transform(range(0, len(p) // 2), lambda jj: p[2 * jj + 2])) AS last FROM chosen),
    code AS (SELECT f.*, coalesce((SELECT min(l.i) FROM lines l WHERE l.k = f.k AND l.page_number = f.page_number AND l.i > f.last AND {strip.format('l.line')} <> ''),
        (SELECT max(l.i) + 1 FROM lines l WHERE l.k = f.k AND l.page_number = f.page_number)) AS after FROM fences f),
    plain AS (SELECT l.*, {strip.format('line')} AS bare FROM lines l WHERE NOT EXISTS (FROM code c WHERE c.k = l.k AND c.page_number = l.page_number AND l.i >= c.first AND l.i < c.after)),
    kinds AS (SELECT *, CASE WHEN regexp_matches(bare, '^#{{1,6}}\s+.+$') THEN 'heading' WHEN regexp_matches(bare, '^\|.+\|$') THEN 'table' ELSE 'paragraph' END AS kind FROM plain),
    marked AS (SELECT *, CASE WHEN kind = 'heading' OR lag(kind) OVER w IS DISTINCT FROM kind OR lag(i) OVER w <> i - 1 THEN 1 ELSE 0 END AS new FROM kinds WINDOW w AS (PARTITION BY k, page_number ORDER BY i)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY k, page_number ORDER BY i) AS g FROM marked),
    made AS (SELECT k, page_number, kind, min(i) AS i, {strip.format(f"string_agg(CASE WHEN kind = 'paragraph' THEN line ELSE bare END, {n} ORDER BY i)")} AS text FROM numbered GROUP BY k, page_number, kind, g
        UNION ALL SELECT c.k, c.page_number, 'code', c.first, string_agg(l.line, {n} ORDER BY l.i) FROM code c JOIN lines l ON l.k = c.k AND l.page_number = c.page_number AND l.i >= c.first AND l.i < c.after GROUP BY ALL),
    costed AS (SELECT *, {_tokens('text')} AS cost, row_number() OVER (PARTITION BY k, page_number ORDER BY i) AS b,
        CASE WHEN regexp_matches({rows}[2], '^\|[\s\-:]+\|') THEN 2 ELSE 1 END AS h, regexp_matches({rows}[-1], '^(`{{3,}}|~{{3,}})\s*$') AS ended FROM made WHERE text <> ''),
    budgets AS (SELECT *, CASE WHEN kind = 'table' THEN greatest({size} - {_tokens(head)}, 1) WHEN kind = 'code' THEN greatest({size} - {_tokens(f'{rows}[1]')} - CASE WHEN ended THEN {_tokens(f'{rows}[-1]')} ELSE 0 END, 1) ELSE {size} END AS budget FROM costed),
    blocks AS MATERIALIZED (SELECT k, page_number, b, kind, text, cost, CASE
        WHEN kind IN ('code', 'table') AND cost <= {size} OR kind = 'table' AND len({rows}) < 3 THEN [text]
        WHEN kind = 'code' THEN list_transform({_packed(f'CASE WHEN ended THEN {rows}[2:-2] ELSE {rows}[2:] END', 'budget', n)}, lambda pp: {rows}[1] || {n} || pp || {n} || CASE WHEN ended THEN {rows}[-1] ELSE '' END)
        WHEN kind = 'table' THEN list_transform({_packed(f'{rows}[h + 1:]', 'budget', n)}, lambda pp: {head} || {n} || pp)
        WHEN kind = 'paragraph' AND cost > {size} AND len({_sentences('text')}) > 1 THEN {_packed(_sentences('text'), 'budget', "' '")}
        WHEN kind = 'paragraph' AND cost > {size} THEN {_packed(_words('text'), 'budget', "' '", '1')} END AS pieces FROM budgets),
    steps AS (SELECT k, page_number, 0::BIGINT AS b, []::VARCHAR[] AS done, []::VARCHAR[] AS held, 0::BIGINT AS used FROM pages
      UNION ALL
      SELECT k, page_number, b, CASE WHEN pieces IS NOT NULL THEN flushed || pieces WHEN begins THEN flushed ELSE done END,
        CASE WHEN pieces IS NOT NULL THEN []::VARCHAR[] WHEN begins AND lead <> '' THEN [lead, text] WHEN begins THEN [text] ELSE held || [text] END,
        (CASE WHEN pieces IS NOT NULL THEN 0 WHEN begins THEN {_tokens('lead')} + cost ELSE used + cost END)::BIGINT
      FROM (SELECT *, CASE WHEN NOT begins OR before IS NULL OR {overlap} <= 0 THEN '' WHEN {_tokens('before')} <= {overlap} THEN before
          WHEN len(parts) = 1 THEN array_to_string(w[greatest(1, len(w) - {overlap - 1}) + 1:], ' ')
          ELSE {strip.format(f"array_to_string(parts[list_filter(range(1, len(parts) + 2), lambda jj: coalesce(list_sum(list_transform(parts[jj:], lambda qq: {_tokens('qq')})), 0) <= {overlap + 15})[1]:], ' ')")} END AS lead
        FROM (SELECT *, {_sentences(f"array_to_string(w[greatest(1, len(w) - {overlap + 29}):], ' ')")} AS parts
          FROM (SELECT *, coalesce({_words('before')}, []::VARCHAR[]) AS w
            FROM (SELECT *, flushed[-1] AS before
              FROM (SELECT s.k, s.page_number, x.b, x.kind, x.text, x.cost, x.pieces, s.done, s.held, s.used,
                  CASE WHEN {strip.format("array_to_string(s.held, chr(10) || chr(10))")} <> '' THEN s.done || [{strip.format("array_to_string(s.held, chr(10) || chr(10))")}] ELSE s.done END AS flushed,
                  x.pieces IS NULL AND (x.kind = 'heading' OR len(s.held) > 0 AND s.used + x.cost > {size}) AS begins
                FROM steps s JOIN blocks x ON x.k = s.k AND x.page_number = s.page_number AND x.b = s.b + 1)))))),
    ended AS (SELECT k, page_number, done, {strip.format("array_to_string(held, chr(10) || chr(10))")} AS rest FROM steps QUALIFY b = max(b) OVER (PARTITION BY k, page_number)),
    chunks AS (SELECT k, page_number, CASE WHEN rest <> '' THEN done || [rest] ELSE done END AS made FROM ended),
    fitted AS (SELECT k, page_number, flatten(list_transform(made, lambda cc: CASE WHEN {_tokens('cc')} <= {size} THEN [cc] ELSE {_fitted('cc', size)} END)) AS made FROM chunks),
    out AS (SELECT k, page_number, unnest(range(1, len(made) + 1)) AS i, unnest(made) AS text FROM fitted)
    SELECT k AS {key}, text, (row_number() OVER (PARTITION BY k ORDER BY page_number, i) - 1)::INT AS chunk_index, page_number::INT AS page_number FROM out"""


STRUCTURED = """SELECT l_orderkey AS k, 0 AS page_number, '# Order ' || l_orderkey || chr(10) || chr(10) || 'It has lines. They follow.' || chr(10) || chr(10) || '| line | part | n |' || chr(10) || '| --- | --- | --- |' || chr(10)
    || string_agg(r, chr(10) ORDER BY l_linenumber, r) || chr(10) || chr(10) || '```text' || chr(10) || string_agg('part_' || l_linenumber || ' = ' || r, chr(10) ORDER BY l_linenumber, r) || chr(10) || '```' || chr(10) AS text
    FROM (SELECT l_orderkey, l_linenumber, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || trunc(l_quantity)::INT || ' |' AS r FROM lineitem) GROUP BY l_orderkey"""
