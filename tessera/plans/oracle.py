"""DuckDB twins of the registered queries (same columns, same values).

Built from the same pattern constants as the Spark code; the views
``documents pages conversations embeddings events lineitem labels`` are the
given tables.  DuckDB lambdas are 1-based where Spark's are 0-based.
"""

from __future__ import annotations

from tessera.functions import patterns as P
from tessera.functions.text import AGENT_NAMES
from tessera.operators import compact as CP
from tessera.operators import boundaries as BD
from tessera.operators import compact as CP
from tessera.operators import lexical as LX
from tessera.operators import search_index as SI
from tessera.operators import route as RT
from tessera.plans import catalog as C
from tessera.plans.ask import FALLBACK_THRESHOLD
from tessera.sources import derived as D


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


NL = "chr(10)"

# The character references that the given pages hold, ``&amp;`` last.
FIXTURE_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&middot;", "·"),
                      ("&copy;", "©"), ("&amp;", "&")]


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(P.WS_EDGES)}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {lit(P.WS_RUN)}), lambda w_: w_ <> '')"


def tok(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, {lit(P.TOKEN_PIECES)})), 0)::BIGINT"


def terms(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), {lit(P.TERM_SPLIT)}), lambda t_: t_ <> '')"


def bucket(x: str, dims: int = C.HASH_DIMS) -> str:
    return f"((('0x' || substr(md5({x}), 1, 8))::BIGINT) % {dims})"


def fold_starts(sizes: str, limit: int, blank: bool, inclusive: bool) -> str:
    add = " + 1" if blank else ""
    cmp = ">=" if inclusive else ">"
    return (
        f"list_reduce({sizes}, lambda a, n: CASE WHEN a.cur + n{add} {cmp} {limit} "
        f"THEN {{'cur': n, 'i': a.i + 1, 'starts': list_append(a.starts, a.i)}} "
        f"ELSE {{'cur': a.cur + n{add}, 'i': a.i + 1, 'starts': a.starts}} END, "
        f"{{'cur': 0::BIGINT, 'i': 1::BIGINT, 'starts': []::BIGINT[]}}).starts"
    )


def pieces(items: str, starts: str, joiner: str) -> str:
    return (
        f"list_filter(list_transform(list_prepend(1::BIGINT, {starts}), lambda b, k: "
        f"array_to_string({items}[b : coalesce({starts}[k], len({items}) + 1) - 1], {joiner})), lambda c_: c_ <> '')"
    )


def chunk_cte(src: str = "documents", extra: str = "") -> str:
    """C1 over ``src(doc_id, text)`` -> ``_chunks(doc_id, chunk_no, chunk)``."""
    sizes = "list_transform(ws, lambda x: length(x)::BIGINT)"
    return f"""
_w AS (SELECT doc_id{extra}, {words('text')} AS ws FROM {src}),
_s AS (SELECT doc_id{extra}, ws, {fold_starts(sizes, 1000, True, False)} AS st FROM _w),
_p AS (SELECT doc_id{extra}, {pieces('ws', 'st', "' '")} AS cs FROM _s),
_chunks AS (SELECT doc_id{extra}, generate_subscripts(cs, 1) - 1 AS chunk_no, unnest(cs) AS chunk FROM _p)"""


def html_text(x: str) -> str:
    s = f"regexp_replace({x}, {lit(P.HTML_MARKUP_RE2)}, '', 'g')"
    for ent, ch in FIXTURE_REFERENCES:
        s = f"replace({s}, {lit(ent)}, {lit(ch)})"
    lines = f"string_split_regex({s}, {lit(P.LINE_BREAK)})"
    flat = f"flatten(list_transform({lines}, lambda l_: string_split({strip('l_')}, '  ')))"
    return f"array_to_string(list_filter(list_transform({flat}, lambda p_: {strip('p_')}), lambda p_: p_ <> ''), {NL})"


def canonical(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[?#].*$', ''), ';[^/]*$', '')"


def sentences(x: str) -> str:
    pcs = f"regexp_extract_all(replace({x}, {NL}, ' '), {lit(P.SENTENCE)})"
    return f"list_filter(list_transform({pcs}, lambda s_: {strip('s_')}), lambda s_: s_ <> '')"


def trim_budget(x: str, max_tokens: int, sents: str | None = None) -> str:
    sents = sents or sentences(x)
    costs = f"list_transform({sents}, lambda s_: {tok('s_')} + 1)"
    cut = (
        f"list_reduce({costs}, lambda a, c: {{'tot': a.tot + c, 'i': a.i + 1, "
        f"'cut': CASE WHEN a.cut = 0 AND a.tot + c > {max_tokens} THEN a.i + 1 ELSE a.cut END}}, "
        f"{{'tot': 0::BIGINT, 'i': 0::BIGINT, 'cut': 0::BIGINT}}).cut"
    )
    return (
        f"CASE WHEN {tok(x)} <= {max_tokens} THEN {x} WHEN {cut} = 0 THEN {x} "
        f"ELSE array_to_string({sents}[1 : {cut} - 1], ' ') END"
    )


def boundary_ctes() -> str:
    """The words of all documents, and what they show about periods."""
    def part(hit: str, of: str, p: str) -> str:
        return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE {hit} * ln({p}) + ({of} - {hit}) * ln(1 - {p}) END)"

    def likelihood(a: str, b: str, both: str) -> str:
        n, rest, other = "t.total::DOUBLE", f"(t.total - {a})::DOUBLE", f"({b} - {both})"
        p = f"({b} / {n})"
        return f"(-2 * ({part(both, a, p)} + {part(other, rest, p)} - {part(both, a, f'({both} / {a}::DOUBLE)')} - {part(other, rest, f'({other} / {rest})')}))"

    core = f"regexp_replace(ltrim(p), {lit(BD.BEFORE)}, '')"
    body = f"regexp_replace({core}, {lit(BD.BEHIND)}, '')"
    return rf"""_p AS (SELECT doc_id, text, regexp_extract_all(replace(coalesce(text, ''), {NL}, ' '), {lit(BD.PIECE)}) AS p FROM documents),
_x AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS i FROM _p),
_y AS (SELECT doc_id, i, {core} AS core, {body} AS body, lower(regexp_replace({body}, {lit(BD.MARKS)}, '')) AS plain FROM _x),
_z AS (SELECT doc_id, i, CASE WHEN regexp_matches(plain, {lit(BD.NUMBER)}) THEN '#' ELSE plain END AS type,
       CASE WHEN regexp_matches(body, '[!?]$') THEN 'e' WHEN regexp_matches(body, '(\.\.|…)$') THEN 'l' WHEN ends_with(body, '.') THEN 'p' ELSE '' END AS mark,
       CASE WHEN regexp_matches(core, '^\p{{Lu}}') THEN 'u' WHEN regexp_matches(core, '^\p{{Ll}}') THEN 'l' ELSE '' END AS kase FROM _y),
_w AS (SELECT *, lead(type) OVER d AS next, lead(kase) OVER d AS next_case, lag(mark) OVER d AS before FROM _z WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
_c AS (SELECT type, count(*) AS n, count(*) FILTER (mark = 'p') AS n_dot, count(*) FILTER (kase = 'l') AS small,
       count(*) FILTER (kase = 'u' AND before = '') AS within FROM _w GROUP BY type),
_t AS (SELECT sum(n)::BIGINT AS total, sum(n_dot) / sum(n) AS share FROM _c),
_s AS (SELECT type, n_dot, n - n_dot AS n_plain, length(replace(type, '.', ''))::DOUBLE AS size, t.share FROM _c, _t t WHERE n_dot > 0 AND regexp_matches(type, '\p{{L}}')),
_a AS (SELECT type, n_dot, n_plain, -2 * (n_dot * ln(share) + n_plain * ln(1 - share) - n_dot * ln(0.99::DOUBLE) - n_plain * ln(0.01::DOUBLE))
       * exp(-size) * (length(type) - size + 1) * pow(size, -n_plain) AS score FROM _s),
_abbr AS (SELECT * FROM _a WHERE score >= {BD.ABBREVIATION}),
_pairs AS (SELECT type, next, type IN (SELECT type FROM _abbr) AS abbr, count(*) AS "both" FROM _w WHERE mark = 'p' AND next IS NOT NULL GROUP BY type, next),
_sure AS (SELECT next, sum("both")::BIGINT AS "both" FROM _pairs WHERE NOT abbr AND NOT regexp_matches(type, '^(\p{{L}}|#)$') GROUP BY next),
_ends AS (SELECT greatest(1, sum("both"))::BIGINT AS a FROM _sure),
_starters AS (SELECT next FROM _sure s JOIN _c c ON c.type = s.next, _t t, _ends e WHERE regexp_matches(next, '\p{{L}}') AND c.n >= "both"
       AND t.total / e.a::DOUBLE > c.n / "both"::DOUBLE AND {likelihood('e.a', 'c.n', '"both"')} >= {BD.STARTER}),
_colloc AS (SELECT p.type, p.next FROM _pairs p JOIN _c a ON a.type = p.type JOIN _c b ON b.type = p.next, _t t
       WHERE (abbr OR regexp_matches(p.type, '^(\p{{L}}|#)$')) AND "both" > 1 AND "both" <= least(a.n, b.n) AND t.total / a.n::DOUBLE > b.n / "both"::DOUBLE
       AND {likelihood('a.n', 'b.n', '"both"')} >= {BD.COLLOCATION}),
_stop AS (SELECT doc_id, i, CASE WHEN mark = 'e' THEN true WHEN mark = 'l' THEN next_case = 'u'
       WHEN (type, next) IN (SELECT (type, next) FROM _colloc) THEN false
       WHEN (held OR type = '#') AND next_case = 'l' THEN false
       WHEN held THEN next IN (SELECT next FROM _starters) OR (next_case = 'u' AND next IN (SELECT type FROM _c WHERE small > 0 AND within = 0)) ELSE true END AS stop
       FROM (SELECT *, type IN (SELECT type FROM _abbr) OR regexp_matches(type, '^\p{{L}}$') AS held FROM _w WHERE mark <> '' AND next IS NOT NULL)),
_e AS (SELECT doc_id, list(i ORDER BY i) AS ends FROM _stop WHERE stop GROUP BY doc_id),
_cut AS (SELECT doc_id, text, p, list_concat(coalesce(ends, []), [len(p) - 1]) AS ends FROM _p LEFT JOIN _e USING (doc_id)),
_sents AS (SELECT doc_id, text, CASE WHEN len(p) = 0 THEN [] ELSE
       list_transform(ends, lambda e_, k_: trim(array_to_string(p[CASE WHEN k_ > 1 THEN ends[k_ - 1] ELSE -1 END + 2 : e_ + 1], ''))) END AS sents FROM _cut)"""


def condense_sql(budget: int) -> str:
    """Central sentences of the slices; a step of the walk is one CTE."""
    walk = ",\n".join(
        f"""_p{k} AS MATERIALIZED (SELECT q.doc_id, q.no, q.i, q.n, {1 - CP.DAMPING} / q.n + {CP.DAMPING} * (coalesce(x.p, 0) + coalesce(o.p, 0) / q.n) AS p
FROM _p{k - 1} q LEFT JOIN (SELECT m.doc_id, m.no, m.j, sum(p * share) AS p FROM _m m JOIN _p{k - 1} USING (doc_id, no, i) GROUP BY ALL) x
ON x.doc_id = q.doc_id AND x.no = q.no AND x.j = q.i
LEFT JOIN (SELECT doc_id, no, sum(p) AS p FROM _p{k - 1} JOIN _mute USING (doc_id, no, i) GROUP BY ALL) o ON o.doc_id = q.doc_id AND o.no = q.no)""" for k in range(1, CP.STEPS + 1))
    return f"""WITH _sl AS (SELECT doc_id, s // 4000 AS no, substring(text, s + 1, 4000) AS slice
     FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 4000)) AS s FROM documents WHERE length(text) > 0)),
_b AS (SELECT doc_id, no, {sentences('slice')} AS sents FROM _sl WHERE {tok('slice')} > {budget}),
_u AS (SELECT doc_id, no, len(sents)::DOUBLE AS n, unnest(sents) AS sent, generate_subscripts(sents, 1) AS i FROM _b),
_tf AS (SELECT doc_id, no, n, i, term, count(*) AS tf FROM (SELECT doc_id, no, n, i, unnest({terms('sent')}) AS term FROM _u) GROUP BY ALL),
_wt AS (SELECT doc_id, no, i, term, tf * ln(1 + n / count(*) OVER (PARTITION BY doc_id, no, term)) AS w FROM _tf),
_unit AS (SELECT doc_id, no, i, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, no, i)) AS w FROM _wt),
_sim AS (SELECT a.doc_id, a.no, a.i, b.i AS j, sum(a.w * b.w) AS s FROM _unit a JOIN _unit b USING (doc_id, no, term) WHERE a.i <> b.i GROUP BY ALL),
_m AS MATERIALIZED (SELECT doc_id, no, i, j, s / sum(s) OVER (PARTITION BY doc_id, no, i) AS share FROM _sim),
_mute AS MATERIALIZED (SELECT doc_id, no, i FROM _u EXCEPT SELECT doc_id, no, i FROM _sim),
_p0 AS MATERIALIZED (SELECT doc_id, no, i, n, 1 / n AS p FROM _u),
{walk},
_r AS (SELECT u.doc_id, u.no, u.i, u.sent, sum({tok('u.sent')} + 1) OVER (PARTITION BY u.doc_id, u.no ORDER BY round(p, 6) DESC, u.i) AS used
     FROM _u u JOIN _p{CP.STEPS} USING (doc_id, no, i)),
_k AS (SELECT doc_id, no, string_agg(sent, ' ' ORDER BY i) AS t FROM _r WHERE used <= {budget} GROUP BY ALL)
SELECT doc_id, no::BIGINT AS slice_no, CASE WHEN {tok('slice')} <= {budget} THEN slice ELSE coalesce(t, '') END AS condensed FROM _sl LEFT JOIN _k USING (doc_id, no)"""


def wikitext_cte() -> str:
    names = arr(D.WIKI_HEADINGS)
    para = (
        f"CASE WHEN i = 1 THEN p ELSE repeat('=', (2 + (doc_id + i - 1) % 3)::INT) || ' ' || "
        f"{names}[1 + (doc_id * 7 + i - 1) % 6] || ' ' || repeat('=', (2 + (doc_id + i - 1) % 3)::INT) || {NL} || p END"
    )
    return f"_wiki AS (SELECT doc_id, array_to_string(list_transform(string_split(text, {NL}), lambda p, i: {para}), {NL}) AS w FROM documents)"


def sections_cte(src: str | None = None) -> str:
    """``_secs(doc_id, pos, level, heading, middle, content)`` over
    ``src(doc_id, w)`` (default: the wiki text derived from documents)."""
    head = f"{wikitext_cte()}," if src is None else ""
    return f"""{head}
_pc AS (SELECT doc_id, w, string_split_regex(w, {lit(P.HEADING)}) AS pcs,
               regexp_extract_all(w, {lit(P.HEADING)}) AS hds FROM {src or '_wiki'}),
_h AS (SELECT doc_id, pcs, unnest(hds) AS h, generate_subscripts(hds, 1) AS pos FROM _pc),
_secs AS (
  SELECT doc_id, 0::BIGINT AS pos, 0::BIGINT AS level, 'Summary' AS heading, '' AS middle,
         {strip('pcs[1]')} AS content FROM _pc
  UNION ALL
  SELECT doc_id, pos::BIGINT, length(string_split(h, ' ')[1])::BIGINT,
         array_to_string(string_split(h, ' ')[2 : len(string_split(h, ' ')) - 1], ' '),
         array_to_string(string_split({strip("replace(h, '=', '')")}, ' ')[2 : len(string_split({strip("replace(h, '=', '')")}, ' ')) - 1], ' '),
         {strip('pcs[pos + 1]')}
  FROM _h)"""


def prune_cte(src: str | None = None) -> str:
    """``_kept(doc_id, pos, level, heading, n_tokens, content)`` via the
    ancestor rule: drop a section when it, or an enclosing section, has a
    discarded heading."""
    stop = arr(P.DISCARD_SECTIONS)
    return f"""{sections_cte(src)},
_enc AS (
  -- enclosing sections of s: preceding t with t.level < every level between t and s
  SELECT s.doc_id, s.pos, bool_or(list_contains({stop}, t.heading)) AS anc_drop
  FROM _secs s JOIN _secs t ON s.doc_id = t.doc_id AND t.pos > 0 AND t.pos < s.pos AND t.level < s.level
  WHERE NOT EXISTS (SELECT 1 FROM _secs m WHERE m.doc_id = s.doc_id AND m.pos > t.pos AND m.pos < s.pos AND m.level <= t.level)
  GROUP BY s.doc_id, s.pos),
_kept0 AS (
  SELECT s.* FROM _secs s LEFT JOIN _enc e ON s.doc_id = e.doc_id AND s.pos = e.pos
  WHERE s.pos = 0 OR (NOT list_contains({stop}, s.heading) AND NOT coalesce(e.anc_drop, false))),
_kept AS (
  SELECT doc_id, pos, level, heading,
         CASE WHEN pos = 0 THEN {tok('content')} + 4
              WHEN {tok('content')} + 3 + {tok('middle')} - (CASE WHEN length(content) = 0 THEN 1 ELSE 0 END) < 1500
              THEN {tok('content')} + 3 + {tok('middle')} - (CASE WHEN length(content) = 0 THEN 1 ELSE 0 END)
              ELSE 1500 END AS n_tokens,
         CASE WHEN pos = 0 OR {tok('content')} + 3 + {tok('middle')} - (CASE WHEN length(content) = 0 THEN 1 ELSE 0 END) < 1500
              THEN content ELSE {trim_budget('content', 1500)} END AS content
  FROM _kept0)"""


def hashed_cte(src: str, id_expr: str, text_expr: str, name: str) -> str:
    """``name(id, bucket, weight)``: L2-normalised hashed term counts."""
    return f"""{name}_t AS (SELECT {id_expr} AS id, unnest({terms(text_expr)}) AS term FROM {src}),
{name}_c AS (SELECT id, {bucket('term')} AS bucket, count(*) AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM {name}_c)"""


def questions_cte(only: str = "") -> str:
    """``_q(qid, text)``: every user turn; ``only``: a condition on ``qid``."""
    q = "SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS qid, text FROM conversations WHERE role = 'user'"
    return f"_q AS (SELECT * FROM ({q}) WHERE {only})" if only else f"_q AS ({q})"


def vec_cte() -> str:
    return ("_e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, "
            "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nv FROM embeddings)")


def topk_sql(pairs_where: str, corpus_where: str = "TRUE", k: int = 3) -> str:
    return f"""WITH {vec_cte()},
_pairs AS (SELECT q.id AS qid, c.id AS id, round(list_dot_product(q.v, c.v) / (q.nv * c.nv), 9) AS s
           FROM _e q JOIN _e c ON {pairs_where} WHERE {corpus_where}),
_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM _pairs)
SELECT qid, rank::BIGINT AS rank, id, round(s, 6) AS score FROM _r WHERE rank <= {k}"""


def lexical_ctes() -> str:
    stop = arr(LX.STOP_WORDS)
    return f"""{questions_cte()},
_tt AS (SELECT doc_id AS id, {terms('text')} AS t FROM documents),
_dl AS (SELECT id, len(t)::DOUBLE AS dl FROM _tt),
_stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM _dl),
_df AS (SELECT term, count(*)::DOUBLE AS df FROM (SELECT DISTINCT id, unnest(t) AS term FROM _tt) GROUP BY term),
_qt0 AS (SELECT DISTINCT qid, unnest({terms('text')}) AS term FROM _q),
_qt1 AS (SELECT q.qid, q.term, ln(1.0::DOUBLE + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) AS idf
         FROM _qt0 q JOIN _df d USING (term), _stats s WHERE NOT list_contains({stop}, q.term)),
_qt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idf DESC, term) AS term_rank FROM _qt1),
_sel AS (SELECT * FROM _qt WHERE term_rank <= {LX.MAX_SEARCH_TERMS})"""


def phrase_ctes() -> str:
    stop = arr(LX.STOP_WORDS)
    pairs = lambda x: f"list_zip({x}[1 : len({x}) - 1], {x}[2 : len({x})])"
    return f"""{lexical_ctes()},
_qw AS (SELECT qid, {terms('text')} AS t FROM _q),
_ask AS (SELECT DISTINCT qid, b[1] AS term, b[2] AS next FROM (SELECT qid, unnest({pairs('t')}) AS b FROM _qw WHERE len(t) > 1)
         WHERE NOT list_contains({stop}, b[1]) AND NOT list_contains({stop}, b[2])),
_two AS (SELECT id, b[1] AS term, b[2] AS next FROM (SELECT id, unnest({pairs('t')}) AS b FROM _tt WHERE len(t) > 1)),
_n2 AS (SELECT term, next, count(*) AS n, count(DISTINCT id)::DOUBLE AS df FROM _two WHERE (term, next) IN (SELECT (term, next) FROM _ask) GROUP BY ALL),
_n1 AS (SELECT term, count(*)::DOUBLE AS n FROM (SELECT unnest(t) AS term FROM _tt) GROUP BY term),
_npmi AS (SELECT p.term, p.next, p.n, ln(p.n * l.l / (a.n * b.n)) / -ln(p.n / l.l) AS score, ln(1.0::DOUBLE + (s.n - p.df + 0.5::DOUBLE) / (p.df + 0.5::DOUBLE)) AS idf
          FROM _n2 p JOIN _n1 a ON a.term = p.term JOIN _n1 b ON b.term = p.next, _stats s, (SELECT sum(dl) AS l FROM _dl) l WHERE p.n >= {SI.MIN_PAIRS} AND p.n < l.l),
_phr AS (SELECT qid, term, next, n, score, idf FROM _ask JOIN _npmi USING (term, next) WHERE score >= {SI.MIN_SCORE})"""


def chunk_store_cte() -> str:
    return f"""{chunk_cte()},
_cs AS (SELECT doc_id * 1000000 + chunk_no AS id, chunk FROM _chunks),
{hashed_cte('_cs', 'id', 'chunk', '_cv')},
{questions_cte()},
{hashed_cte('_q', 'qid', 'text', '_qv')}"""


def route_ctes() -> str:
    rows = ", ".join(f"({lit(a[0])}, {a[1]}, {lit(a[2])})" for a in RT.AGENTS)
    return f"""_ag AS (SELECT * FROM (VALUES {rows}) t(agent, ord, description)),
{hashed_cte('_ag', 'agent', 'description', '_av')},
_rs AS (SELECT q.id AS qid, a.id AS agent, g.ord, round(sum(q.weight * a.weight), 9) AS score
        FROM _qv q JOIN _av a USING (bucket) JOIN _ag g ON g.agent = a.id GROUP BY ALL),
_best AS (SELECT qid, arg_max(agent, (score, -ord)) AS agent, max(score) AS score FROM _rs GROUP BY qid),
_routed AS (SELECT q.qid, CASE WHEN b.score > 0 THEN b.agent END AS agent,
                   CASE WHEN b.score > 0 THEN round(b.score, 6) END AS score
            FROM _q q LEFT JOIN _best b USING (qid))"""


def agent_dim_cte() -> str:
    rows = ", ".join(
        f"({lit(a[0])}, {a[3]}::DOUBLE, {a[4]}, {lit(a[5])}, {lit(a[6])}, {lit(a[7])}, {lit(a[8])})" for a in RT.AGENTS
    )
    return f"_dim AS (SELECT * FROM (VALUES {rows}) t(agent, temperature, max_tokens, instruction, layout, q_prefix, q_suffix))"


def compact_sql(x: str) -> str:
    stop = arr(CP.FILLER_WORDS)
    keys = arr([k for k, _ in CP.ABBREVIATIONS])
    vals = arr([v for _, v in CP.ABBREVIATIONS])
    kept = f"list_filter({words(x)}, lambda z_: NOT list_contains({stop}, lower(z_)))"
    return f"array_to_string(list_transform({kept}, lambda z_: coalesce(map({keys}, {vals})[lower(z_)], z_)), ' ')"


def upsert_log_cte() -> str:
    return f"""_log AS (
  SELECT doc_id, 1 AS batch_id, text FROM documents
  UNION ALL
  SELECT doc_id, 2 AS batch_id, {compact_sql('text')} AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""


def utter_text() -> str:
    return ("CASE event_type WHEN 'click' THEN 'smart tutor' WHEN 'signup' THEN 'simple tutor' "
            "WHEN 'error' THEN 'add docs' WHEN 'purchase' THEN (CASE WHEN event_id % 50 = 0 THEN 'exit' ELSE 'help' END) "
            "ELSE 'what is ' || event_id::VARCHAR END")


def command_sql(x: str) -> str:
    return (f"CASE WHEN lower({x}) IN ('exit', 'smart tutor', 'simple tutor', 'add docs', 'help') "
            f"THEN lower({x}) ELSE 'question' END")


def table_rows_cte() -> str:
    return f"""_rows AS (
  SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate)::BIGINT AS row_no,
         concat_ws(',', l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus) AS "row"
  FROM lineitem
  UNION ALL
  SELECT DISTINCT l_suppkey, 0::BIGINT, {lit(D.TABLE_HEADER)} FROM lineitem),
_tok AS (SELECT file, row_no, "row", {tok('"row"')} AS n FROM _rows),
_files AS (SELECT file, list(struct_pack(row_no := row_no, r := "row", n := n) ORDER BY row_no) AS rs FROM _tok GROUP BY file),
_fs AS (SELECT file, rs, {fold_starts('list_transform(rs, lambda x: x.n)', 1000, False, True)} AS st FROM _files),
_fp AS (SELECT file, {pieces('list_transform(rs, lambda x: x.r)', 'st', NL)} AS cs FROM _fs)"""


def web_store_cte(only: str = "") -> str:
    """K3's store: pages linked by the questions' BM25 search (3 each), their
    visible text in 4,000-character slices, compacted; defines ``_q``,
    ``_cs(id, chunk)``, ``_cv`` and ``_qv`` like ``chunk_store_cte``."""
    stop = arr(LX.STOP_WORDS)
    wiki = f"contains(regexp_extract(url, {lit(P.URL_AUTHORITY)}, 1), 'wikipedia.org')"
    return f"""{questions_cte(only)},
_pg0 AS (SELECT page_id, {canonical('url')} AS url, {html_text('html')} AS text FROM pages),
_pw AS (SELECT page_id AS doc_id, text AS w FROM _pg0 WHERE {wiki}),
{prune_cte('_pw')},
_pwa AS (SELECT w.doc_id AS page_id, CASE WHEN length(w.w) = 0 THEN '' ELSE string_agg(k.content, {NL} ORDER BY k.pos) END AS text
         FROM _pw w JOIN _kept k USING (doc_id) GROUP BY w.doc_id, w.w),
_pg AS (SELECT page_id, text FROM _pg0 WHERE NOT {wiki} UNION ALL SELECT page_id, text FROM _pwa),
_pgt AS (SELECT * FROM _pg WHERE coalesce(text, '') <> ''),
_tt AS (SELECT page_id AS id, {terms('text')} AS t FROM _pgt),
_dl AS (SELECT id, len(t)::DOUBLE AS dl FROM _tt),
_stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM _dl),
_df AS (SELECT term, count(*)::DOUBLE AS df FROM (SELECT DISTINCT id, unnest(t) AS term FROM _tt) GROUP BY term),
_qt0 AS (SELECT DISTINCT qid, unnest({terms('text')}) AS term FROM _q),
_qt1 AS (SELECT q.qid, q.term, ln(1.0::DOUBLE + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) AS idf
         FROM _qt0 q JOIN _df d USING (term), _stats s WHERE NOT list_contains({stop}, q.term)),
_qt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idf DESC, term) AS term_rank FROM _qt1),
_sel AS (SELECT * FROM _qt WHERE term_rank <= {LX.MAX_SEARCH_TERMS}),
_post AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(t) AS term FROM _tt) GROUP BY id, term),
_lsc AS (SELECT s.qid, p.id, round(sum(s.idf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / st.avgdl))), 9) AS score
         FROM _sel s JOIN _post p USING (term) JOIN _dl l ON l.id = p.id, _stats st GROUP BY s.qid, p.id),
_lr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM _lsc WHERE score > 0),
_usedp AS (SELECT DISTINCT id AS page_id FROM _lr WHERE rank <= 3),
_sl AS (SELECT p.page_id, p.text, unnest(generate_series(0, length(p.text) - 1, 4000)) AS s FROM _pgt p JOIN _usedp USING (page_id)),
_sl2 AS (SELECT page_id, s // 4000 AS slice_no, {compact_sql('substring(text, s + 1, 4000)')} AS context FROM _sl),
_cs AS (SELECT page_id * 1000000 + slice_no AS id, context AS chunk FROM _sl2 WHERE context <> ''),
{hashed_cte('_cs', 'id', 'chunk', '_cv')},
{hashed_cte('_q', 'qid', 'text', '_qv')}"""


def prompts_ctes(store: str | None = None) -> str:
    """Question prompts as in ``assemble_prompts``; ends with ``_x(qid, agent, pos, m)``."""
    return f"""{store or chunk_store_cte()}, {route_ctes()}, {agent_dim_cte()},
_cn AS (SELECT id, sqrt(sum(weight * weight)) AS nv FROM _cv GROUP BY id),
_qn AS (SELECT id, sqrt(sum(weight * weight)) AS nv FROM _qv GROUP BY id),
_sc AS (SELECT q.id AS qid, c.id AS cid, round(sum(q.weight * c.weight) / (any_value(qn.nv) * any_value(cn.nv)), 9) AS s
        FROM _qv q JOIN _cv c USING (bucket) JOIN _qn qn ON qn.id = q.id JOIN _cn cn ON cn.id = c.id GROUP BY q.id, c.id),
_all AS (SELECT q.qid, c.id AS cid, coalesce(s.s, 0) AS s FROM _q q CROSS JOIN _cs c LEFT JOIN _sc s ON s.qid = q.qid AND s.cid = c.id),
_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS rank FROM _all) WHERE rank <= 3),
_ctx AS (SELECT t.qid, list(cs.chunk ORDER BY t.rank) AS contexts FROM _top t JOIN _cs cs ON cs.id = t.cid GROUP BY t.qid),
_pq AS (SELECT q.qid, q.text, coalesce(x.contexts, []::VARCHAR[]) AS contexts, coalesce(r.agent, 'DocAgent') AS agent
        FROM _q q LEFT JOIN _ctx x USING (qid) LEFT JOIN _routed r USING (qid)),
_msgs AS (SELECT p.qid, p.agent,
  [{{'role': 'system', 'content': {lit(RT.SYSTEM_LINE)}}}, {{'role': 'user', 'content': d.instruction}}]
  || CASE WHEN d.layout = 'joined' THEN [{{'role': 'user', 'content': 'Comma seperated value text:' || {NL} || array_to_string(p.contexts, {NL})}}]
          ELSE list_transform(p.contexts, lambda c_: {{'role': 'user', 'content': 'Context: ' || c_}}) END
  || [{{'role': 'user', 'content': d.q_prefix || p.text || d.q_suffix}}] AS ms
  FROM _pq p JOIN _dim d USING (agent)),
_x AS (SELECT qid, agent, (generate_subscripts(ms, 1) - 1)::BIGINT AS pos, unnest(ms) AS m FROM _msgs)"""


def folder_files() -> str:
    return f"""_k AS (SELECT doc_id, 'doc_' || doc_id::VARCHAR || '.' || {arr(D.FILE_EXTENSIONS)}[1 + doc_id % 8] AS f,
                      text || {NL} AS content FROM documents),
_k2 AS (SELECT *, lower(string_split(f, '.')[-1]) AS ext FROM _k),
_k3 AS (SELECT *, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('doc', 'docx') THEN 'docx' WHEN ext IN ('csv', 'xlsx') THEN 'table'
                       WHEN ext = 'txt' THEN 'text' WHEN ext = 'png' THEN 'image' ELSE 'unsupported' END AS kind FROM _k2)"""


def folder_sql() -> str:
    sizes = "list_transform(rs, lambda x: x.n)"
    return f"""WITH {folder_files()},
_txt AS (SELECT doc_id, content AS text FROM _k3 WHERE kind NOT IN ('table', 'unsupported')),
{chunk_cte('_txt')},
_tl AS (SELECT f, string_split_regex(content, '\r?\n') AS ls FROM _k3 WHERE kind = 'table'),
_tr AS (SELECT f, list_filter(ls, lambda l_: regexp_matches(l_, '[^ \t]')) AS lines FROM _tl),
_tt2 AS (SELECT f, list_transform(lines, lambda r_: {{'r': r_, 'n': {tok('r_')}}}) AS rs FROM _tr),
_ts AS (SELECT f, rs, {fold_starts(sizes, 1000, False, True)} AS st FROM _tt2),
_tp AS (SELECT f, {pieces('list_transform(rs, lambda x: x.r)', 'st', NL)} AS cs FROM _ts),
_tc AS (SELECT f, (generate_subscripts(cs, 1) - 1)::BIGINT AS chunk_no, unnest(cs) AS body FROM _tp)
SELECT k.f AS name, k.kind, c.chunk_no::BIGINT AS chunk_no, c.chunk FROM _chunks c JOIN _k3 k USING (doc_id)
UNION ALL
SELECT f AS name, 'table' AS kind, chunk_no, f || {NL} || {NL} || body AS chunk FROM _tc"""


def answer_sql(store: str | None = None) -> str:
    """K2 (and K3 with the web store): per question profile, prompt size,
    completion budget and best context score."""
    return f"""WITH {prompts_ctes(store)},
_used AS (SELECT qid, any_value(agent) AS agent, count(*) AS n_messages, sum({tok('m.content')}) AS used FROM _x GROUP BY qid)
SELECT u.qid, u.agent, 'fast' AS model, u.n_messages::BIGINT AS n_messages, u.used::BIGINT AS used,
       greatest(1, least(d.max_tokens, 4096 - u.used - 100))::BIGINT AS max_tokens, u.used >= 4096 AS overflow,
       round(t.s, 6) AS best_score
FROM _used u JOIN _dim d USING (agent) LEFT JOIN (SELECT qid, s FROM _top WHERE rank = 1) t USING (qid)"""


def fallback_sql(ok: str) -> str:
    """K4: tier 1 keeps questions for which ``ok`` holds; the rest are answered
    from a web store built for them."""
    ask = answer_sql()
    rest = f"qid NOT IN (SELECT qid FROM ({ask}) a WHERE {ok})"
    return (
        f"SELECT *, 1::BIGINT AS tier FROM ({ask}) t1 WHERE {ok} "
        f"UNION ALL SELECT *, 2::BIGINT AS tier FROM ({answer_sql(web_store_cte(rest))}) t2"
    )


YES = ("qid IN (SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR FROM conversations WHERE role = 'assistant' "
       "AND contains(lower(text || [' Yes.', ' No.', ' TableAgent', ''][1 + turn % 4]), 'yes'))")


SQL: dict[str, str] = {
    "chunk_words": f"WITH {chunk_cte()} SELECT doc_id, chunk_no::BIGINT AS chunk_no, chunk FROM _chunks",
    "chunk_fixed": (
        "WITH _s AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 4000)) AS s FROM documents "
        "WHERE length(text) > 0) SELECT doc_id, (s // 4000)::BIGINT AS slice_no, substring(text, s + 1, 4000) AS slice FROM _s"
    ),
    "even_split": (
        f"WITH _n AS (SELECT doc_id, n_chars::BIGINT AS size, CASE WHEN n_chars > {C.SPLIT_LIMIT} "
        f"THEN ceil(n_chars / {C.SPLIT_LIMIT})::BIGINT ELSE 1 END AS n FROM documents), "
        "_p AS (SELECT doc_id, size, n, ceil(size / n)::BIGINT AS part FROM _n), "
        "_x AS (SELECT doc_id, size, part, unnest(range(0, n)) AS part_no FROM _p) "
        "SELECT doc_id, part_no::BIGINT AS part_no, (part_no * part)::BIGINT AS start_pos, "
        "least((part_no + 1) * part, size)::BIGINT AS end_pos FROM _x"
    ),
    "token_count": f"SELECT doc_id, {tok('text')} AS n_tokens FROM documents",
    "html_to_text": f"SELECT page_id, {html_text('html')} AS text FROM pages",
    "canonical_url": f"SELECT page_id, {canonical('url')} AS url FROM pages",
    "page_links_no_ads": (
        "WITH _l AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN list_append(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), "
        "'https://www.google.com/aclk?sa=' || page_id::VARCHAR) ELSE regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) END AS ls FROM pages), "
        "_x AS (SELECT page_id, (generate_subscripts(ls, 1) - 1)::BIGINT AS pos, unnest(ls) AS href FROM _l) "
        f"SELECT page_id, pos, href FROM _x WHERE NOT regexp_matches(href, {lit(P.AD_LINK)})"
    ),
    "wiki_titles": (
        "WITH _u AS (SELECT page_id, 'https://en.wikipedia.org' || CASE WHEN page_id % 4 = 0 THEN '/w/' ELSE '/wiki/' END "
        "|| 'Page_' || page_id::VARCHAR || '%20C%2B%2B+x' || CASE WHEN page_id % 3 = 0 THEN '/sub' ELSE '' END || '?a=1#t' AS u FROM pages), "
        f"_c AS (SELECT page_id, {canonical('u')} AS c FROM _u), "
        f"_p AS (SELECT page_id, c, string_split(regexp_replace(regexp_extract(c, {lit(P.URL_PATH)}, 1), ';[^/]*$', ''), '/') AS parts FROM _c) "
        f"SELECT page_id, c AS url, contains(regexp_extract(c, {lit(P.URL_AUTHORITY)}, 1), 'wikipedia.org') AS is_wiki, "
        "CASE WHEN len(parts) > 2 AND parts[2] = 'wiki' THEN replace(url_decode(replace(parts[3], '+', '%2B')), '_', ' ') END AS title FROM _p"
    ),
    "file_dispatch": (
        f"WITH _f AS (SELECT doc_id, 'doc_' || doc_id::VARCHAR || '.' || {arr(D.FILE_EXTENSIONS)}[1 + doc_id % 8] AS f FROM documents), "
        "_e AS (SELECT doc_id, f, lower(string_split(f, '.')[-1]) AS ext FROM _f) "
        "SELECT doc_id, f, ext, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('doc', 'docx') THEN 'docx' "
        "WHEN ext IN ('csv', 'xlsx') THEN 'table' WHEN ext = 'txt' THEN 'text' "
        f"WHEN list_contains({arr(P.IMAGE_EXTENSIONS)}, ext) THEN 'image' ELSE 'unsupported' END AS kind FROM _e"
    ),
    "verdict_parse": (
        "WITH _r AS (SELECT conv_id, turn, text || [' Yes.', ' No.', ' TableAgent', ''][1 + turn % 4] AS text "
        "FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN contains(lower(text), 'yes') THEN true "
        "WHEN contains(lower(text), 'no') THEN false END AS verdict FROM _r"
    ),
    "agent_parse": (
        "WITH _r AS (SELECT conv_id, turn, text || [' Yes.', ' No.', ' TableAgent', ''][1 + turn % 4] AS text "
        "FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CASE "
        + " ".join(f"WHEN contains(text, {lit(a)}) THEN {lit(a)}" for a in AGENT_NAMES)
        + " END AS agent FROM _r"
    ),
    "text_compact": f"SELECT doc_id, {compact_sql('text')} AS text FROM documents",
    "text_condense": condense_sql(C.CONDENSED),
    "sentence_abbreviations": f"WITH {boundary_ctes()} SELECT type, n_dot, n_plain, round(score, 6) AS score FROM _abbr",
    "sentence_trim_learned": f"WITH {boundary_ctes()} SELECT doc_id, len(sents)::INTEGER AS n_sentences, {trim_budget('text', C.TRIM_TOKENS, 'sents')} AS text FROM _sents",
    "sentence_trim": f"SELECT doc_id, {trim_budget('text', C.TRIM_TOKENS)} AS text FROM documents",
    "section_split": f"WITH {sections_cte()} SELECT doc_id, pos, level, heading, content FROM _secs",
    "section_prune": f"WITH {prune_cte()} SELECT doc_id, pos, heading, n_tokens, content FROM _kept",
    "section_assemble": (
        f"WITH {prune_cte()} SELECT w.doc_id, CASE WHEN length(w.w) = 0 THEN '' ELSE "
        f"string_agg(k.content, {NL} ORDER BY k.pos) END AS text FROM _wiki w JOIN _kept k USING (doc_id) GROUP BY w.doc_id, w.w"
    ),
    "embed_hash": f"WITH {hashed_cte('documents', 'doc_id', 'text', '_h')} SELECT id AS doc_id, bucket::BIGINT AS bucket, round(weight, 6) AS weight FROM _h",
    "upsert_batches": (
        f"WITH {chunk_cte()} SELECT doc_id AS source_id, chunk_no::BIGINT AS chunk_no, "
        "((row_number() OVER (ORDER BY doc_id, chunk_no) - 1) // 80)::BIGINT AS batch_no, "
        "ceil(count(*) OVER () / 80)::BIGINT AS n_batches FROM _chunks"
    ),
    "upsert_latest": (
        f"WITH {upsert_log_cte()}, {chunk_cte('_log', ', batch_id')}, "
        "_new AS (SELECT doc_id, max(batch_id) AS batch_id FROM _log GROUP BY doc_id) "
        "SELECT 'homework' AS namespace, c.doc_id AS source_id, c.chunk_no::BIGINT AS chunk_no, c.batch_id::BIGINT AS batch_id, "
        "c.chunk AS context FROM _chunks c JOIN _new USING (doc_id, batch_id)"
    ),
    "upsert_by_id": (
        f"WITH {upsert_log_cte()}, {chunk_cte('_log', ', batch_id')} "
        "SELECT 'homework' AS namespace, doc_id AS source_id, chunk_no::BIGINT AS chunk_no, max(batch_id)::BIGINT AS batch_id, "
        "arg_max(chunk, batch_id) AS context FROM _chunks GROUP BY doc_id, chunk_no"
    ),
    "latent_vectors": f"SELECT doc_id, {C.LATENT_WIDTH}::INTEGER AS width, len({terms('text')}) > 0 AS unit_length FROM documents",
    "vector_topk": topk_sql("q.id <> c.id"),
    "centroid_topk_exact": topk_sql("q.id <> c.id"),
    "centroid_recall": "SELECT count(*) AS questions, true AS recall_90 FROM embeddings",
    "namespace_topk": topk_sql("q.id <> c.id", "c.label % 2 = 0"),
    "fallback_retrieve": f"""WITH {vec_cte()},
_pairs AS (SELECT q.id AS qid, c.id AS id, CASE WHEN c.label % 2 = 0 THEN 1 ELSE 2 END AS tier,
                  round(list_dot_product(q.v, c.v) / (q.nv * c.nv), 9) AS s FROM _e q JOIN _e c ON q.id <> c.id),
_r AS (SELECT *, row_number() OVER (PARTITION BY qid, tier ORDER BY s DESC, id) AS rank FROM _pairs),
_good AS (SELECT qid FROM _r WHERE tier = 1 AND rank = 1 AND s >= {C.FALLBACK_THRESHOLD})
SELECT qid, tier::BIGINT AS tier, rank::BIGINT AS rank, id, round(s, 6) AS score FROM _r
WHERE rank <= 3 AND ((tier = 1 AND qid IN (SELECT qid FROM _good)) OR (tier = 2 AND qid NOT IN (SELECT qid FROM _good)))""",
    "fused_namespaces": f"""WITH {vec_cte()},
_pairs AS (SELECT q.id AS qid, c.id AS id, CASE WHEN c.label % 2 = 0 THEN 'homework' ELSE 'googlestuff' END AS tier,
                  round(list_dot_product(q.v, c.v) / (q.nv * c.nv), 9) AS s FROM _e q JOIN _e c ON q.id <> c.id),
_h AS (SELECT * FROM _pairs QUALIFY row_number() OVER (PARTITION BY qid, tier ORDER BY s DESC, id) <= 3),
_z AS (SELECT qid, id, tier, round(coalesce((s - avg(s) OVER (PARTITION BY tier)) / nullif(stddev_pop(s) OVER (PARTITION BY tier), 0), 0), 9) AS z FROM _h),
_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY z DESC, tier, id) AS rank FROM _z)
SELECT qid, rank::BIGINT AS rank, id, tier, round(z, 4) AS score FROM _r WHERE rank <= 3""",
    "fused_vector_lexical": f"""WITH {lexical_ctes()}, {hashed_cte('documents', 'doc_id', 'text', '_hd')}, {hashed_cte('_q', 'qid', 'text', '_hq')},
_near AS (SELECT q.id AS qid, d.id, round(sum(q.weight * d.weight), 9) AS s FROM _hq q JOIN _hd d USING (bucket) GROUP BY ALL),
_post AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(t) AS term FROM _tt) GROUP BY id, term),
_sc AS (SELECT s.qid, p.id, round(sum(s.idf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / st.avgdl))), 9) AS s
        FROM _sel s JOIN _post p USING (term) JOIN _dl l ON l.id = p.id, _stats st GROUP BY s.qid, p.id),
_both AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM _near WHERE s > 0
          UNION ALL SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM _sc WHERE s > 0),
_f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM _both WHERE rank <= 10 GROUP BY ALL),
_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM _f)
SELECT qid, rank::BIGINT AS rank, id, score FROM _r WHERE rank <= 3""",
    "search_terms": f"WITH {lexical_ctes()} SELECT qid, term_rank::BIGINT AS term_rank, term FROM _sel",
    "search_phrases": f"WITH {phrase_ctes()} SELECT qid, term, next, n, round(score, 6) AS score FROM _phr",
    "lexical_topk_phrases": f"""WITH {phrase_ctes()},
_post AS (SELECT id, term, NULL AS next, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(t) AS term FROM _tt) GROUP BY id, term
          UNION ALL SELECT id, term, next, count(*)::DOUBLE AS tf FROM _two GROUP BY id, term, next),
_all AS (SELECT qid, term, NULL AS next, idf FROM _sel UNION ALL SELECT qid, term, next, idf FROM _phr),
_sc AS (SELECT s.qid, p.id, round(sum(s.idf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / st.avgdl))), 9) AS score
        FROM _all s JOIN _post p ON p.term = s.term AND p.next IS NOT DISTINCT FROM s.next JOIN _dl l ON l.id = p.id, _stats st GROUP BY s.qid, p.id),
_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM _sc WHERE score > 0)
SELECT qid, rank::BIGINT AS rank, id, round(score, 4) AS score FROM _r WHERE rank <= 3""",
    "lexical_topk": f"""WITH {lexical_ctes()},
_post AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(t) AS term FROM _tt) GROUP BY id, term),
_sc AS (SELECT s.qid, p.id, round(sum(s.idf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / st.avgdl))), 9) AS score
        FROM _sel s JOIN _post p USING (term) JOIN _dl l ON l.id = p.id, _stats st GROUP BY s.qid, p.id),
_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM _sc WHERE score > 0)
SELECT qid, rank::BIGINT AS rank, id, round(score, 4) AS score, (1 + 10 * floor((rank - 1) / 10))::BIGINT AS page FROM _r WHERE rank <= 3""",
    "route_questions": f"""WITH {questions_cte()}, {hashed_cte('_q', 'qid', 'text', '_qv')}, {route_ctes()}, {agent_dim_cte()}
SELECT r.qid, r.agent, r.score, d.temperature, d.max_tokens::BIGINT AS max_tokens FROM _routed r LEFT JOIN _dim d USING (agent)""",
    "assemble_prompts": f"WITH {prompts_ctes()} SELECT qid, agent, pos, m.role AS role, m.content AS content FROM _x",
    "router_prompts": f"""WITH {questions_cte()},
_m AS (SELECT qid, [{{'role': 'system', 'content': {lit(RT.SYSTEM_LINE)}}}, {{'role': 'user', 'content': {lit(RT.ROUTER_INSTRUCTION)}}},
                    {{'role': 'user', 'content': 'Question:' || {NL} || text}}, {{'role': 'user', 'content': {lit(RT.AGENT_LIST_TEXT)}}}] AS ms FROM _q),
_x AS (SELECT qid, (generate_subscripts(ms, 1) - 1)::BIGINT AS pos, unnest(ms) AS m FROM _m)
SELECT qid, pos, m.role AS role, m.content AS content FROM _x""",
    "judge_prompts": f"""WITH {prompts_ctes()},
_ans AS (SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS qid, text AS answer FROM conversations WHERE role = 'assistant'),
_jc AS (SELECT t.qid, string_agg(cs.chunk, {NL} ORDER BY t.rank) AS contexts FROM _top t JOIN _cs cs ON cs.id = t.cid GROUP BY t.qid),
_jm AS (SELECT q.qid, [{{'role': 'system', 'content': {lit(RT.SYSTEM_LINE)}}}, {{'role': 'user', 'content': {lit(RT.JUDGE_INSTRUCTION)}}},
                      {{'role': 'user', 'content': 'Query: ' || q.text}}, {{'role': 'user', 'content': 'Context: ' || coalesce(c.contexts, '')}},
                      {{'role': 'user', 'content': 'Answer: ' || coalesce(a.answer, '')}}] AS ms
        FROM _q q LEFT JOIN _jc c USING (qid) LEFT JOIN _ans a USING (qid)),
_jx AS (SELECT qid, (generate_subscripts(ms, 1) - 1)::BIGINT AS pos, unnest(ms) AS m FROM _jm)
SELECT qid, pos, m.role AS role, m.content AS content FROM _jx""",
    "ask": answer_sql(),
    "web_assist": answer_sql(web_store_cte()),
    "ask_with_fallback": fallback_sql(f"best_score >= {FALLBACK_THRESHOLD}"),
    "ask_with_verdict": fallback_sql(YES),
    "prompt_budget": f"""WITH _u AS (SELECT conv_id, sum({tok('text')})::BIGINT AS used FROM conversations GROUP BY conv_id),
_m AS (SELECT * FROM (VALUES ('fast', 4096, NULL), ('smart', 8000, 8000)) t(model, ceiling, forced))
SELECT conv_id, model, used, greatest(1, least(coalesce(forced, 1000), ceiling - used - 100))::BIGINT AS max_tokens,
       used >= ceiling AS overflow FROM _u, _m""",
    "flatten_join": f"""WITH _p AS (SELECT conv_id, turn, list_transform(string_split(text, {NL}),
                   lambda l_, i_: CASE WHEN (i_ - 1) % 3 = 2 THEN NULL ELSE l_ END) AS xs FROM conversations)
SELECT conv_id, turn, CASE WHEN len(list_filter(xs, lambda x: x IS NOT NULL)) > 0
  THEN array_to_string(list_filter(xs, lambda x: x IS NOT NULL), {NL}) END AS answer FROM _p""",
    "mode_in_effect": f"""WITH _u AS (SELECT user_id AS session_id, ts, event_id, {utter_text()} AS text FROM events),
_k AS (SELECT *, {command_sql('text')} AS kind FROM _u),
_r AS (SELECT *, row_number() OVER w AS seq,
         last_value(CASE kind WHEN 'smart tutor' THEN 'smart' WHEN 'simple tutor' THEN 'fast' END IGNORE NULLS) OVER w AS model,
         max(CASE WHEN kind = 'exit' THEN 1 ELSE 0 END) OVER w AS exited
       FROM _k WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, seq::BIGINT AS seq, text, coalesce(model, 'fast') AS model FROM _r WHERE kind = 'question' AND exited = 0""",
    "folder_ingest": folder_sql(),
    "folder_rejects": f"WITH {folder_files()} SELECT f AS name, kind, 'LookupError: no decoder for ' || ext AS error FROM _k3 WHERE kind = 'unsupported'",
    "csv_table": "SELECT " + ", ".join(f"{c}::VARCHAR AS {c}" for c in C.CSV_COLUMNS) + " FROM lineitem",
    "csv_render": f'SELECT concat_ws(\',\', {", ".join(C.CSV_COLUMNS)}) AS "row" FROM lineitem',
    "hook_count_tokens": "SELECT doc_id, (length(text) - length(replace(text, ' ', '')) + 1)::BIGINT AS n_tokens FROM documents",
    "hook_transform": "SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS text FROM documents",
    "hook_embed": (
        "SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks, "
        "(length(text) - length(replace(text, chr(10), '')))::DOUBLE AS lines FROM documents"
    ),
    "hook_complete": (
        f"WITH {questions_cte()} SELECT qid, '3/40: Question:' || {NL} || text AS reply FROM _q WHERE contains(text, ' ') "
        "UNION ALL SELECT qid, NULL FROM _q WHERE NOT contains(text, ' ')"
    ),
    "hook_solve": (
        f"WITH _p AS (SELECT conv_id, turn, list_filter(string_split(text, {NL}), lambda l_: l_ <> '') AS ls FROM conversations) "
        f"SELECT conv_id, turn, CASE WHEN len(ls) > 0 THEN array_to_string(ls, {NL}) END AS answer FROM _p"
    ),
    "positional_ids": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos_id FROM documents",
    "command_contains": (
        "WITH _s AS (SELECT conv_id, turn, lower(text || [' please EXIT', ' Smart Tutor now', ' help', ''][1 + turn % 4]) AS s FROM conversations) "
        "SELECT conv_id, turn, CASE WHEN contains(s, 'exit') THEN 'exit' WHEN contains(s, 'smart tutor') THEN 'smart tutor' "
        "WHEN contains(s, 'simple tutor') THEN 'simple tutor' WHEN contains(s, 'add docs') THEN 'add docs' "
        "WHEN contains(s, 'help') THEN 'help' ELSE 'question' END AS command FROM _s"
    ),
    "prompt_extend": f"""WITH {questions_cte()},
_a AS (SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS qid, trim(text, ' ' || {NL}) AS answer FROM conversations WHERE role = 'assistant')
SELECT qid, 0::BIGINT AS pos, 'user' AS role, text AS content FROM _q JOIN _a USING (qid)
UNION ALL SELECT qid, 1, 'assistant', answer FROM _q JOIN _a USING (qid)
UNION ALL SELECT qid, 2, 'user', 'Answer in one line.' FROM _q JOIN _a USING (qid)""",
    "chunk_table_rows": f"""WITH {table_rows_cte()},
_x AS (SELECT file, (generate_subscripts(cs, 1) - 1)::BIGINT AS chunk_no, unnest(cs) AS body FROM _fp)
SELECT file, chunk_no, 'supplier_' || file::VARCHAR || '.csv' || {NL} || {NL} || body AS chunk FROM _x""",
}
SQL["stream_ingest"] = SQL["upsert_latest"]
SQL["stream_two_feeds"] = (
    f"WITH _pt AS (SELECT page_id AS doc_id, {html_text('html')} AS text FROM pages), {chunk_cte('_pt')} "
    f"SELECT namespace, source_id, chunk_no, context FROM ({SQL['upsert_latest']}) "
    "UNION ALL SELECT 'googlestuff', doc_id, chunk_no::BIGINT, chunk FROM _chunks"
)
SQL["stream_mode"] = SQL["mode_in_effect"]
