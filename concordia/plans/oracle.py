"""The catalog's queries as DuckDB SQL over the same tables, written from the operators' rules and not from their code.

merge, text_vote and quorum_report have none: ordered alignment of whole texts is no query. Tests compare them with plain models.
"""

from __future__ import annotations

from concordia.functions.text import CYRILLIC, LATIN

SPACES = r"[ \t\n\r\v\f\x1c-\x1f]"
CYR = "[А-Яа-яЁёІіЇїЄєҐґ]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~–—«»“”„’‘…•·€£§°"
TRIMMED = f"regexp_replace({{0}}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def _count(of: str, kind: str) -> str:
    """Characters of a class."""
    return f"length(regexp_replace({of}, '[^{kind[1:]}', '', 'g'))"


def _bare(x: str) -> str:
    """tidy without look-alikes."""
    signs = "’ʼ`‘´—– ', '''''''''''-- '"
    one = f"trim(regexp_replace(translate({x}, '{signs}), '{SPACES}+', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({one}, ' ([.,;:!?)»])', '\\1', 'g'), '([(«]) ', '\\1', 'g')"


def _cyrillic(x: str) -> str:
    """Look-alikes of a bare line as Cyrillic, in words that have Cyrillic, and in codes of mostly Cyrillic lines. x: a column."""
    most = f"{_count(x, CYR)} > {_count(x, '[A-Za-z]')}"
    word = f"CASE WHEN regexp_matches(w, '{CYR}') OR (regexp_matches(w, '^[A-Za-z]\\d{{2,}}[^\\p{{L}}\\p{{N}}_]*$') AND {most}) THEN translate(w, '{LATIN}', '{CYRILLIC}') ELSE w END"
    return f"CASE WHEN regexp_matches({x}, '{CYR}') THEN array_to_string(list_transform(string_split({x}, ' '), lambda w: {word}), ' ') ELSE {x} END"


def _tidied(source: str, *columns: str) -> str:
    """source with t_c for each column c, tidy; a null stays one."""
    bare = ", ".join(f"{_bare(c)} AS b_{c}" for c in columns)
    full = ", ".join(f"{_cyrillic(f'b_{c}')} AS t_{c}" for c in columns)
    return f"SELECT * EXCLUDE ({', '.join(f'b_{c}' for c in columns)}), {full} FROM (SELECT *, {bare} FROM {source})"


def _key(x: str) -> str:
    """The comparison key of a tidy line."""
    return f"regexp_replace(lower(translate({x}, '{LATIN}', '{CYRILLIC}')), '{SPACES}+', '', 'g')"


def _letters(x: str) -> str:
    return _count(x, r"[\p{L}]")


def _confidence(x: str) -> str:
    seen = f"length(regexp_replace({x}, '{SPACES}', '', 'g'))"
    good = _count(x, r"[\p{L}\p{Nd}²³¹.,;:!?()\-/\\]")
    return f"(CASE WHEN {seen} > 0 THEN {good} / {seen} ELSE 0.0 END)"


def _gate(x: str) -> str:
    signs = _count(x, r"[@#$%^&*_=+<>\[\]{}~`]")
    return f"(length({TRIMMED.format(x)}) >= 100 AND {_confidence(x)} >= 0.82 AND {signs} <= 0.03 * length({x}))"


def _clean(x: str) -> str:
    x = f"regexp_replace({x}, '\\f', '', 'g')"
    return TRIMMED.format(f"regexp_replace(regexp_replace(replace({x}, chr(160), ' '), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _stripped(x: str) -> str:
    """Noise out of a text: one replacement a sign, as the engine has no back-references, then word by word."""
    for c in PUNCTUATION:
        pattern = {"'": "''"}.get(c, "\\" + c if c.isascii() else c)
        x = f"regexp_replace({x}, '{pattern}{{3,}}', '{ {chr(39): chr(39) * 2, chr(92): chr(92) * 2}.get(c, c) }', 'g')"
    core = "trim(w, '.,;:!?()-–—/\\')"
    keep = f"lambda w: w <> '' AND ({core} = '' OR regexp_matches({core}, '[\\p{{L}}\\p{{N}}]'))"
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: array_to_string(list_filter(string_split(l, ' '), {keep}), ' ')), chr(10))"


def _noisy(w: str, level: str) -> str:
    h = f"substr(md5(concat_ws('|', doc_id::VARCHAR, '{w}', row_no::VARCHAR)), 1, 2)"
    bad = f"CASE WHEN {h}[1] = '0' THEN replace(truth, 'e', 'c') WHEN {h}[2] < '6' THEN translate(truth, '{LATIN}', '{CYRILLIC}') ELSE replace(truth, '.', '') END"
    read = f"CASE WHEN {h}[1] < '{level}' THEN {bad} ELSE truth END"
    return (f"CASE WHEN {h} <> 'ff' THEN {read} END" if w == "tesseract" else read) + f" AS {w}"


NOISY = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS truth, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row_no FROM documents),
w AS (SELECT doc_id, row_no, truth, {_noisy('chrome', '1')}, {_noisy('photos', '3')}, {_noisy('tesseract', '7')} FROM l)"""
_NAMES = ("chrome", "photos", "tesseract")
_SAME = " + ".join("coalesce(f{0} = f{1}, false)::INTEGER".replace("{1}", str(j)) for j in range(3))
VOTED = f"""WITH {NOISY}, t AS ({_tidied('w', *_NAMES)}),
f AS (SELECT *, {', '.join(f"{_key(f't_{n}')} AS f{i}" for i, n in enumerate(_NAMES))} FROM t),
n AS (SELECT *, {', '.join(f"{_SAME.replace('{0}', str(i))} AS n{i}" for i in range(3))} FROM f),
m AS (SELECT *, greatest(n0, n1, n2) AS top, CASE greatest(n0, n1, n2) WHEN n0 THEN f0 WHEN n1 THEN f1 ELSE f2 END AS lead,
  (chrome IS NOT NULL)::INTEGER + (photos IS NOT NULL)::INTEGER + (tesseract IS NOT NULL)::INTEGER AS live FROM n),
p AS (SELECT *, (top >= 2 OR live = 1) AS decided, list_max([{', '.join(f"CASE WHEN f{i} = lead THEN {{'c': {_count(n, CYR)}, 'p': -{i}, 't': t_{n}}} END" for i, n in enumerate(_NAMES))}]).t AS won FROM m),
v AS (SELECT doc_id, row_no, truth, chrome, photos, tesseract, CASE WHEN decided THEN won ELSE coalesce(t_chrome, t_photos, t_tesseract, '') END AS line, decided FROM p)"""

POLLS = """WITH p AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS snap, event_type AS witness FROM events)"""
WORDS = r"list_filter(string_split(regexp_replace(upper(replace(text, 'ß', 'ss')), '[\r\n\t,.:; ]', ' ', 'g'), ' '), lambda x: x <> '')"


def _phrase(source: str, *words: str, gap: int = 2) -> str:
    """hit(doc_id): documents in which each word is the first of its kind within reach of the one before."""
    steps = "".join(
        f", s{k} AS (SELECT s.doc_id, s.start, min(b.pos) AS pos FROM s{k - 1} s JOIN q b ON s.doc_id = b.doc_id AND b.pos BETWEEN s.pos + 1 AND s.pos + {gap} WHERE b.word = '{w}' GROUP BY ALL)" for k, w in enumerate(words) if k
    )
    return f"""q AS (SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM {source}),
s0 AS (SELECT doc_id, pos AS start, pos FROM q WHERE word = '{words[0]}'){steps}, hit AS (SELECT DISTINCT doc_id FROM s{len(words) - 1})"""


_BLOCK = """list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {'k': list_max(list_filter(range(0, least(ahi - i, bhi - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k))), 'i': -i, 'j': -j}))))"""


def _ratio(pairs: str) -> str:
    """Likeness of the pairs (a, b): the longest common block, the first of equals, then both sides of it, and so on; r(a, b, ratio)."""
    return f"""open_(a, b, alo, ahi, blo, bhi) AS (SELECT a, b, 0::BIGINT, length(a), 0::BIGINT, length(b) FROM {pairs}
UNION ALL SELECT a, b, o.alo, o.ahi, o.blo, o.bhi FROM (SELECT a, b, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}}, {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}}]) AS o
  FROM (SELECT *, {_BLOCK} AS m FROM open_ WHERE alo < ahi AND blo < bhi) WHERE m.k > 0)),
r AS (SELECT a, b, 2.0 * sum(CASE WHEN alo < ahi AND blo < bhi THEN {_BLOCK}.k ELSE 0 END) / (length(a) + length(b)) AS ratio FROM open_ GROUP BY a, b)"""


def _near(source: str, *tokens: str, gap: int = 2, least: float = 0.75) -> str:
    """hit(doc_id): as _phrase, with words near the tokens."""
    fits = " OR ".join(f"2.0 * least(length(word), {len(t)}) / (length(word) + {len(t)}) >= {least}" for t in tokens)
    steps = "".join(
        f", s{k} AS (SELECT s.doc_id, s.start, min(b.pos) AS pos FROM s{k - 1} s JOIN h b ON s.doc_id = b.doc_id AND b.pos BETWEEN s.pos + 1 AND s.pos + {gap} WHERE b.b = '{t}' GROUP BY ALL)" for k, t in enumerate(tokens) if k
    )
    return f"""q AS (SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM {source}),
x AS (SELECT word AS a, unnest([{', '.join(f"'{t}'" for t in tokens)}]) AS b FROM (SELECT DISTINCT word FROM q WHERE {fits})),
{_ratio('x')},
h AS (SELECT q.doc_id, q.pos, r.b FROM q JOIN r ON q.word = r.a WHERE r.ratio >= {least}),
s0 AS (SELECT doc_id, pos AS start, pos FROM h WHERE b = '{tokens[0]}'){steps}, hit AS (SELECT DISTINCT doc_id FROM s{len(tokens) - 1})"""


def _stable(need: int, polls: str = POLLS) -> str:
    return polls + f""", a AS (SELECT *, last_value(nullif(snap, '') IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p),
b AS (SELECT *, CASE WHEN snap <> '' AND snap = prev THEN 1 ELSE 0 END AS inc FROM a),
c AS (SELECT *, sum(1 - inc) OVER (PARTITION BY key ORDER BY seq) AS run FROM b),
e AS (SELECT *, sum(inc) OVER (PARTITION BY key, run ORDER BY seq) AS same FROM c),
fired AS (SELECT key, min(seq)::INTEGER AS fired_at FROM e WHERE inc = 1 AND same >= {need - 1} GROUP BY key)"""


TIMED = POLLS.replace("WITH p AS", "WITH p0 AS") + ", p AS (SELECT * FROM (SELECT key, seq, CASE WHEN key % 3 = 0 AND seq <= 1 + key % 5 THEN '' ELSE snap END AS snap, (seq - 1) * 15 AS sec FROM p0) WHERE sec <= 120)"
OUTCOME = _stable(2, TIMED) + """, seen AS (SELECT key, coalesce(min(sec) FILTER (WHERE snap <> '') <= 30, false) AS early, arg_max(snap, seq) FILTER (WHERE snap <> '') AS last FROM p GROUP BY key)
SELECT s.key, CASE WHEN NOT early THEN 'quiet' WHEN f.key IS NOT NULL THEN 'settled' ELSE 'total' END AS how,
  CASE WHEN NOT early THEN '' WHEN f.key IS NOT NULL THEN x.snap ELSE coalesce(last, '') END AS text FROM seen s LEFT JOIN fired f USING (key) LEFT JOIN p x ON x.key = f.key AND x.seq = f.fired_at"""
DEAD = POLLS + """, r AS (SELECT key, witness, min(seq) AS seq FROM p WHERE witness IN ('click', 'purchase') GROUP BY ALL), k AS (SELECT key FROM r GROUP BY key HAVING count(*) = 2),
g AS (SELECT key, unnest(['view', 'click', 'purchase']) AS witness FROM k) SELECT g.key, g.witness, coalesce(r.witness || '-' || r.seq, '') AS text, r.seq::INTEGER AS seq FROM g LEFT JOIN r USING (key, witness)"""

BOXES = """b0 AS (SELECT doc_id AS page, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) - 1 AS seq FROM documents),
b AS (SELECT page, seq, word, (seq // 8) * 40 + (seq * 7) % 5 AS top, (seq % 8) * 100 AS lft, 40 + (seq * 13) % 61 AS width, 18 + seq % 5 AS height, seq % 101 AS conf FROM b0 WHERE word <> '' {0})"""
LAYOUT = """m AS (SELECT page, list_sort(list(height))[len(list(height)) // 2 + 1] AS m FROM b GROUP BY page),
j AS (SELECT b.*, m.m // 2 AS half FROM b JOIN m USING (page)),
k AS (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY page ORDER BY top, seq)) > greatest(6, half) THEN 1 ELSE 0 END AS new FROM j),
r AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY top, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS row_id FROM k),
g AS (SELECT *, lft - lag(lft + width) OVER (PARTITION BY page, row_id ORDER BY lft, top, seq) AS gap FROM r),
y AS (SELECT page, row_id::BIGINT AS row_id, string_agg((CASE WHEN gap IS NULL OR gap <= 2 THEN '' WHEN gap >= 4 * greatest(4, half) THEN chr(9) ELSE ' ' END) || word, '' ORDER BY lft, top, seq) AS line FROM g GROUP BY page, row_id)"""


def _gaps(low: int) -> str:
    return f"""d AS (SELECT DISTINCT l_orderkey AS page, l_partkey::INTEGER AS y FROM lineitem), o AS (SELECT o_orderkey AS page, (o_orderkey % 4000 + 500)::INTEGER AS width, (o_custkey % 3000 + 1000)::INTEGER AS height FROM orders),
c AS (SELECT page, count(*) AS lines, list(y ORDER BY y) AS ys FROM d GROUP BY page),
g AS (SELECT * FROM (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) - y AS gap FROM d) WHERE gap > {low}), md AS (SELECT page, median(gap) AS med, count(*) AS gaps FROM g GROUP BY page),
u AS (SELECT g.*, CASE WHEN abs(gap - med) > 0.25 * med THEN 1 ELSE 0 END AS off_ FROM g JOIN md USING (page)), v AS (SELECT *, sum(off_) OVER (PARTITION BY page ORDER BY y) AS run FROM u),
n AS (SELECT page, run, count(*) FILTER (WHERE off_ = 0) AS n, min(y) FILTER (WHERE off_ = 0) AS y FROM v GROUP BY page, run)"""


HEADER = f"""WITH {_gaps(0)}, best AS (SELECT page, arg_max(y, {{'n': n, 'y': -y}}) AS y, max(n) AS n FROM n WHERE n > 0 GROUP BY page),
hd AS (SELECT o.page, o.height, c.ys, (CASE WHEN coalesce(c.lines, 0) < 5 THEN floor(o.height * 0.12) WHEN best.n >= 3 THEN best.y ELSE c.ys[3] END)::INTEGER AS header FROM o LEFT JOIN c USING (page) LEFT JOIN best USING (page))"""
STRIPS = HEADER + """, rw AS (SELECT page, height, header, list_filter(coalesce(ys, []::INTEGER[]), lambda y: y >= header AND y <= height AND y >= 0) AS ys FROM hd),
st AS (SELECT *, len(ys) AS m, greatest(1, round_even((height - header) / (height * 0.18), 0)::INTEGER) AS n FROM rw),
tb AS (SELECT page, unnest(list_filter(list_transform(range(0, ceil(greatest(m - 5, 0) / 3)::INTEGER + 1), lambda k: {'top': ys[k * 3 + 1], 'bottom': ys[least(k * 3 + 4, m - 1) + 1]}), lambda x: x.bottom - x.top >= 20)) AS x, generate_subscripts(list_filter(list_transform(range(0, ceil(greatest(m - 5, 0) / 3)::INTEGER + 1), lambda k: {'top': ys[k * 3 + 1], 'bottom': ys[least(k * 3 + 4, m - 1) + 1]}), lambda x: x.bottom - x.top >= 20), 1) - 1 AS strip FROM st WHERE m >= 5),
pc AS (SELECT page, height, header, n, ((height - header) // n) AS size, unnest(range(0, n)) AS k FROM st WHERE m < 5)
SELECT page, strip::INTEGER AS strip, x.top::INTEGER AS top, x.bottom::INTEGER AS bottom FROM tb
UNION ALL SELECT page, k::INTEGER, (header + k * size - CASE WHEN k > 0 THEN floor(size * 0.1) ELSE 0 END)::INTEGER, (CASE WHEN k = n - 1 THEN height ELSE header + (k + 1) * size END)::INTEGER FROM pc"""

KNOWN = r"""WITH lx AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{N}_''-]{2,}')) AS word FROM benchmark),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
wd AS (SELECT doc_id, line, unnest(regexp_extract_all(t, '\p{L}[\p{L}\p{N}_''-]{2,}|\p{Nd}+')) AS word FROM ln),
dw AS (SELECT word, unnest(list_filter(string_split(lower(word), '-'), lambda x: x <> '')) AS part FROM (SELECT DISTINCT word FROM wd)),
kn AS (SELECT word, bool_and(part IN (SELECT word FROM lx)) AS known FROM dw GROUP BY word),
rt AS (SELECT doc_id, line, count(*) AS n, count(*) FILTER (WHERE regexp_matches(wd.word, '^\p{Nd}+$') OR known) AS good FROM wd LEFT JOIN kn USING (word) GROUP BY ALL)
SELECT doc_id, coalesce(sum(good) FILTER (WHERE 5 * good >= 3 * n), 0)::BIGINT AS worth FROM documents LEFT JOIN rt USING (doc_id) GROUP BY doc_id"""

SEARCHED = f"""WITH RECURSIVE rd AS (SELECT *, {_letters('text')} >= 30 AS read FROM documents), src AS (SELECT doc_id, text FROM rd WHERE read), {_near('src', 'LICENSE', 'TERMS')},
z AS (SELECT rd.doc_id, read, hit.doc_id IS NOT NULL AS found, contains(text, 'license') AS quoted FROM rd LEFT JOIN hit USING (doc_id)),
out_ AS (SELECT doc_id, read, found OR quoted AS matched, CASE WHEN found THEN 'filter' WHEN quoted THEN 'model' ELSE 'none' END AS how FROM z)"""

LINES = f"SELECT doc_id, b AS bare FROM (SELECT doc_id, {_bare('x')} AS b FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS x FROM documents)) WHERE b <> ''"


def _errors(r: str) -> str:
    plain = lambda c: f"regexp_replace(coalesce({c}, ''), '[^\\x00-\\x7f]', '?', 'g')"
    return f"SELECT '{r}' AS reading, levenshtein({plain(r if r != 'vote' else 'line')}, {plain('truth')}) AS e, length(truth) AS n FROM v"


def oracle_sql() -> dict[str, str]:
    return {
        "clean_text": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
        "text_confidence": f"SELECT doc_id, {_confidence('text')} AS confidence FROM documents",
        "training_gate": f"SELECT doc_id, {_letters('text')}::INTEGER AS letters FROM documents WHERE {_gate('text')}",
        "training_pairs": f"SELECT substr(translate(source || ' / ' || doc_id || repeat('x', 60), ' /', '__'), 1, 60) AS label, md5(text) AS digest FROM documents WHERE {_gate('text')}",
        "enough_letters": f"SELECT doc_id FROM documents WHERE {_letters('text')} >= 30",
        "noise_strip": f"SELECT doc_id, md5({_stripped('text')}) AS digest FROM documents",
        "noise_strip_pages": f"SELECT page_id, md5({_stripped('html')}) AS digest FROM pages",
        "normalized": f"SELECT conv_id, turn, md5({TRIMMED.format('text')}) AS digest FROM conversations",
        "fold_keys": f"SELECT doc_id, md5({_key('t_bare')}) AS fold FROM ({_tidied_bare('(' + LINES + ')')})",
        "look_alikes": f"WITH {NOISY}, x AS (SELECT doc_id, row_no, concat_ws(' ', tesseract, truth) AS both_ FROM w), t AS ({_tidied('x', 'both_')}) SELECT doc_id, row_no::INTEGER AS row_no, md5(t_both_) AS tidy, md5({_key('t_both_')}) AS fold FROM t",
        "squash_keys": f"SELECT doc_id, md5({_key('text')}) AS squash, md5(lower(translate(text, '{LATIN}', '{CYRILLIC}'))) AS key FROM documents",
        "tokens": r"SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '\p{Nd}+(?:[.,:/*x×-]\p{Nd}+)*|[\p{L}\p{N}_][\p{L}\p{N}_''-]*|[^\p{L}\p{N}_\s\v\x1c-\x1f]') AS t FROM documents)",
        "distinct_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), f AS (SELECT doc_id, x, min(p) AS p FROM l GROUP BY ALL) SELECT doc_id, count(*)::INTEGER AS n, md5(string_agg(x, chr(10) ORDER BY p)) AS digest FROM f GROUP BY doc_id",
        "known_worth": KNOWN,
        "line_majority": VOTED + " SELECT doc_id, row_no::INTEGER AS row_no, line, decided FROM v",
        "agreement_report": VOTED + " SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE decided) AS agreed, count(*) FILTER (WHERE NOT decided) AS disputed FROM v GROUP BY doc_id",
        "error_rates": VOTED + f", e AS ({' UNION ALL '.join(map(_errors, (*_NAMES, 'vote')))}) SELECT reading, sum(e)::BIGINT AS errors, sum(n)::BIGINT AS chars, count(*) FILTER (WHERE e = 0) AS exact, count(*) AS lines FROM e GROUP BY reading",
        "base_witness": f"""WITH q AS (SELECT doc_id, {_letters('text')} AS q FROM documents), x AS (SELECT doc_id, w.witness, w.rank, floor(((doc_id * (w.rank + 3)) % 10) * q / 10) AS quality FROM q, (VALUES ('chrome', 0), ('photos', 1), ('tesseract', 2)) AS w(witness, rank)),
y AS (SELECT *, max(quality) OVER (PARTITION BY doc_id) AS best FROM x) SELECT doc_id, arg_min(witness, rank) AS witness FROM y WHERE quality > 0 AND 2 * quality >= best GROUP BY doc_id""",
        "voted_phrase": VOTED + f", rt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY row_no) AS text, count(*) AS n_lines, count(*) FILTER (WHERE decided) AS agreed FROM v GROUP BY doc_id), {_phrase('rt', 'OF', 'THE')} SELECT doc_id, n_lines, agreed, md5(text) AS digest FROM rt WHERE doc_id IN (SELECT doc_id FROM hit)",
        "word_ratio": f"WITH RECURSIVE d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,12}}')) AS a FROM benchmark), x AS (SELECT a, unnest(['tide', 'thereth', 'nation']) AS b FROM d), {_ratio('x')} SELECT a AS word, b AS token, round(ratio, 9) AS ratio FROM r",
        "phrase_exact_gap": f"WITH {_phrase('documents', 'OF', 'THE')} SELECT doc_id FROM hit",
        "phrase_three_words": f"WITH {_phrase('documents', 'THE', 'AND', 'TO')} SELECT doc_id FROM hit",
        "phrase_fuzzy": f"WITH RECURSIVE {_near('documents', 'THE', 'TIONLY')} SELECT doc_id FROM hit",
        "second_chance": SEARCHED + " SELECT doc_id, read, matched, how FROM out_",
        "search_summary": SEARCHED + " SELECT count(*) AS total, count(*) FILTER (WHERE matched) AS saved, count(*) FILTER (WHERE how = 'model') AS by_model, count(*) FILTER (WHERE NOT matched) AS skipped FROM out_",
        "phrase_windows": r"WITH t AS (SELECT doc_id, regexp_replace(text, '[ \t]+', ' ', 'g') AS t FROM documents), n AS (SELECT doc_id, t, unnest(range(0, greatest(length(t) - 2500 + 2199, 0) + 1, 2200)) AS start FROM t WHERE length(t) > 0) SELECT doc_id, start::INTEGER AS start, md5(substr(t, start + 1, 2500)) AS digest FROM n",
        "layout_lines": f"WITH {BOXES.replace('{0}', '')}, {LAYOUT} SELECT page, row_id, line FROM y",
        "layout_confident": f"WITH {BOXES.replace('{0}', 'AND seq % 101 >= 40')}, {LAYOUT} SELECT page, row_id, line FROM y",
        "layout_tables": f"WITH {BOXES.replace('{0}', 'AND seq % 50 <> 49')}, {LAYOUT}, a AS (SELECT page, {_clean(chr(116))} AS t FROM (SELECT page, string_agg(line, chr(10) ORDER BY row_id) AS t FROM y GROUP BY page)) SELECT page, md5({_stripped('t')}) AS digest FROM a",
        "stability": _stable(2) + " SELECT * FROM fired",
        "stability_scan": _stable(3) + " SELECT * FROM fired",
        "stability_outcome": OUTCOME,
        "rendezvous": POLLS + ", f AS (SELECT key, witness, min(seq) AS seq FROM p GROUP BY key, witness) SELECT key, max(seq)::INTEGER AS ready_at FROM f GROUP BY key HAVING count(*) = 5",
        "rendezvous_dead": DEAD,
        "grid_regularity": f"WITH {_gaps(5)}, best AS (SELECT page, max(n) AS n FROM n GROUP BY page) SELECT c.page, (CASE WHEN gaps >= 3 AND lines >= 4 THEN best.n ELSE 0 END)::BIGINT AS longest FROM c LEFT JOIN best USING (page) LEFT JOIN md USING (page)",
        "line_height": f"WITH {_gaps(5)} SELECT o.page, (CASE WHEN gaps >= 3 AND lines >= 4 THEN floor(med) ELSE greatest(20, o.width // 50) END)::INTEGER AS height FROM o LEFT JOIN c USING (page) LEFT JOIN md USING (page)",
        "header_end": HEADER + " SELECT page, header FROM hd",
        "strips": STRIPS,
        "safe_dpi": "SELECT c_custkey, (CASE WHEN c_acctbal > 0 THEN least(greatest(floor(3300 / (c_acctbal / 72)), 72), 300) ELSE 300 END)::INTEGER AS dpi FROM customer",
        "preset_argmax": "SELECT key, preset FROM (SELECT l_orderkey AS key, l_linenumber AS preset, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1",
        "run_summary": f"SELECT source, count(*) AS total, count(*) FILTER (WHERE {_letters('text')} >= 30) AS read, count(*) FILTER (WHERE {_gate('text')}) AS training FROM documents GROUP BY source",
        "short_circuit": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND {_letters('text')} >= 30)",
    }


def _tidied_bare(source: str) -> str:
    return f"SELECT doc_id, {_cyrillic('bare')} AS t_bare FROM {source}"
