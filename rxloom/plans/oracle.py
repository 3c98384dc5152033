"""DuckDB SQL that states each query of ``queries`` on its own terms."""

from __future__ import annotations

from rxloom.functions import fixed
from rxloom.plans import inputs


def _q(text: str) -> str:
    return text.replace("'", "''")


def m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(?i){_q(pattern)}')"


def x(column: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({column}, '(?i){_q(pattern)}', {group})"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def drop(column: str, pattern: str, every: bool = False) -> str:
    return strip(f"regexp_replace({column}, '(?i){_q(pattern)}', ''{', ' + chr(39) + 'g' + chr(39) if every else ''})")


def chain(tests: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in tests) + f" ELSE {default} END"


def noise(c: str) -> str:
    return "(" + " OR ".join(m(c, p) for p in fixed.NOISE) + ")"


def score(c: str) -> str:
    codes = "|".join(fixed.SCORED_CODES)
    parts = [(m(c, fixed.DOSAGE), 5), (f"regexp_matches(upper({c}), '\\b({codes})\\b')", 3), (m(c, fixed.POSITIONAL), 4), (m(c, fixed.SPAN_WORDS), 2), (m(c, fixed.NUMBERED), 1), (m(c, fixed.BULLETED), 1), (m(c, fixed.HEADER_MARKS), -3), (f"length({strip(c)}) < 8", -2)]
    return "CAST(" + " + ".join(f"CASE WHEN {t} THEN {v} ELSE 0 END" for t, v in parts) + " AS INTEGER)"


def _list(values: list[str]) -> str:
    return "'" + " ".join(values) + "'"


def frequency(c: str) -> dict[str, str]:
    """code, full_name, times_per_day, times, raw_match; times are blank-joined."""
    a, b, d = (x(c, fixed.POSITIONAL, g) for g in (1, 2, 3))
    total = f"(CAST({a} AS INTEGER) + CAST({b} AS INTEGER) + CAST({d} AS INTEGER))"
    pattern = f"concat_ws('-', {a}, {b}, {d})"
    slots = "concat_ws(' ', " + ", ".join(f"CASE WHEN {v} <> '0' THEN '{t}' END" for v, t in zip((a, b, d), fixed.POSITIONAL_TIMES, strict=True)) + ")"
    by = {f[1]: f for f in fixed.FREQUENCIES}
    daily = f"len(regexp_extract_all({c}, '(?i){fixed.DAILY}')) > len(regexp_extract_all({c}, '(?i){fixed.DAILY}({fixed.DAILY_BUT})'))"
    tests = [(m(c, fixed.POSITIONAL), f"'INDIAN:' || {pattern}", f"{total} || 'x daily (' || {pattern} || ')'", total, slots, x(c, fixed.POSITIONAL, 0))]
    for _, code, name, n, at in fixed.FREQUENCIES:
        tests.append((f"regexp_matches(upper({c}), '\\b{code}\\b')", f"'{code}'", f"'{name}'", str(n), _list(at), f"'{code}'"))
    for i, (p, code) in enumerate(fixed.PHRASES):
        _, _, name, n, at = by[code]
        tests.append((m(c, p) + (f" OR {daily}" if i == 0 else ""), f"'{code}'", f"'{name}'", str(n), _list(at or ["08:00"]), "''"))
    default = ["'OD'", "'Once Daily (assumed)'", "1", "'08:00'", "''"]
    names = ["code", "full_name", "times_per_day", "times", "raw_match"]
    return {name: chain([(t[0], t[k + 1]) for t in tests], default[k]) for k, name in enumerate(names)}


def timing(c: str) -> str:
    return chain([(m(c, p), f"'{v}'") for p, v in fixed.TIMINGS], "''")


def days(c: str) -> str:
    return chain([(m(c, p), f"coalesce(TRY_CAST({x(c, p)} AS INTEGER), 0) * {n}") for p, n in fixed.DURATIONS], "0")


def after_duration(c: str) -> str:
    return chain([(m(c, p), drop(c, p)) for p, _ in fixed.DURATIONS], c)


def after_marker(c: str) -> str:
    return drop(drop(strip(c), r"^\d+[\.\)]\s*"), r"^[-•*]\s*")


def after_timing(c: str) -> str:
    for p, _ in fixed.TIMINGS:
        c = drop(c, p, every=True)
    return c


STRICT = f"length(line) >= 4 AND NOT {noise('line')} AND {score('line')} >= 3"
WEAK = f"length(line) >= 6 AND NOT {noise('line')} AND NOT ({m('line', fixed.DOCTOR)} OR {m('line', fixed.PATIENT)} OR {m('line', fixed.HOSPITAL)}) AND ({score('line')} >= 1 OR {m('line', fixed.HINT)})"

_F = frequency("rest")
_CODE_DROP = chain([(f"code = '{f[1]}' AND raw_match = '{f[1]}'", drop("rest", f[1], every=True)) for f in fixed.FREQUENCIES], "rest")

def _steps(where: str) -> str:
    return f"""p0 AS MATERIALIZED (SELECT rx_id, line_no, {after_marker("line")} AS rest FROM lines WHERE {where}),
p1 AS MATERIALIZED (SELECT rx_id, line_no, {strip(x("rest", fixed.DOSAGE, 0))} AS dosage, {chain([(m("rest", fixed.DOSAGE), drop("rest", fixed.DOSAGE))], "rest")} AS rest FROM p0),
p2 AS MATERIALIZED (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _F.items())}, {timing("rest")} AS timing_notes FROM p1),
p3 AS MATERIALIZED (SELECT * EXCLUDE (rest), CASE WHEN starts_with(code, 'INDIAN:') THEN {strip("replace(rest, raw_match, '')")} ELSE {_CODE_DROP} END AS rest FROM p2),
p4 AS MATERIALIZED (SELECT * EXCLUDE (rest), {days("rest")} AS duration_days, {after_duration("rest")} AS rest FROM p3),
p5 AS MATERIALIZED (SELECT * EXCLUDE (rest), {after_timing("rest")} AS rest FROM p4),
parsed AS (SELECT * FROM (SELECT * EXCLUDE (rest), trim(regexp_replace({drop("rest", fixed.FORM_PREFIX)}, '\\s{{2,}}', ' ', 'g'), ' ,;:-/\\') AS name FROM p5) WHERE length(name) >= 2)"""


PARSED = f"""{inputs.LINES_SQL}, {_steps(STRICT)}"""

PLANS = f"""{PARSED},
starts AS (SELECT o_orderkey AS rx_id, CAST(o_orderdate AS date) AS start_date FROM orders),
plans AS (
  SELECT *, start_date + CAST(days - 1 AS INTEGER) AS end_date, CASE WHEN times = '' THEN ['08:00'] ELSE string_split(times, ' ') END AS daily FROM (
    SELECT *, upper(name) AS medicine_name, CASE WHEN duration_days > 0 THEN duration_days ELSE 30 END AS days FROM parsed JOIN starts USING (rx_id)))"""

_SUMMARY = f"""found AS (SELECT rx_id, count(*) AS n, count(*) FILTER (line_no % 3 = 0) AS u, bool_or(rx_id % 4 = 0) AS lenient FROM lines WHERE {STRICT} GROUP BY rx_id),
summary AS (SELECT o_orderkey AS rx_id, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(lenient, false) AS lenient, CAST(50 + o_orderkey % 50 AS double) / 100 - 0.2 AS conf FROM orders LEFT JOIN found ON o_orderkey = rx_id)"""
SUMMARY = f"{inputs.LINES_SQL}, {_SUMMARY}"

_WORD_RUNS = """wi AS (SELECT *, CASE WHEN line_num <> lag(line_num) OVER w THEN 1 ELSE 0 END AS s FROM words WHERE conf >= 0 AND trim(text) <> '' WINDOW w AS (PARTITION BY rx_id, variant_idx ORDER BY word_idx)),
wr AS (SELECT * EXCLUDE (line_num), CAST(sum(s) OVER (PARTITION BY rx_id, variant_idx ORDER BY word_idx) AS INTEGER) AS line_num FROM wi),
wb AS (SELECT rx_id, variant_idx, line_num, string_agg(trim(text), ' ' ORDER BY word_idx) AS text, avg(conf / 100.0::double) AS confidence FROM wr GROUP BY ALL)"""
_BOX_RUNS = """bi AS (SELECT *, y + tall / 2 AS yc, tall + 1 AS h FROM boxes WHERE trim(text) <> ''),
bg AS (SELECT *, CASE WHEN abs(yc - lag(yc) OVER w) > 0.7::double * CASE WHEN (h + lag(h) OVER w) / 2 < 4 THEN 14 ELSE (h + lag(h) OVER w) / 2 END THEN 1 ELSE 0 END AS s FROM bi WINDOW w AS (PARTITION BY rx_id, variant_idx ORDER BY yc, x, box_idx)),
br AS (SELECT *, CAST(sum(s) OVER (PARTITION BY rx_id, variant_idx ORDER BY yc, x, box_idx) AS INTEGER) AS line_num FROM bg),
bb AS (SELECT rx_id, variant_idx, line_num, string_agg(trim(text), ' ' ORDER BY x, yc, box_idx) AS text, avg(conf) AS confidence FROM br GROUP BY ALL)"""
_ENGINES = f"""{inputs.BOXES_SQL}, {_WORD_RUNS}, {_BOX_RUNS},
eb AS (SELECT 'box' AS engine, * FROM bb UNION ALL SELECT 'word', * FROM wb),
et AS (SELECT rx_id, engine, variant_idx, string_agg(text, chr(10) ORDER BY line_num) FILTER (text <> '') AS text, round(avg(confidence), 10) AS avg_conf FROM eb GROUP BY ALL),
bv AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY rx_id, engine ORDER BY avg_conf DESC, variant_idx) AS r FROM et) WHERE r = 1)"""

_SLOTS = "SELECT *, unnest(daily) AS time, unnest(range(0, len(daily))) AS time_idx"
_HEADS = {"doctor_name": fixed.DOCTOR, "patient_name": fixed.PATIENT, "date": fixed.DATE}


def _line_sim(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE 1 - levenshtein(lower({a}), lower({b}))::double / greatest(length({a}), length({b})) END"



def _forms(c: str) -> str:
    forms = [c]
    for bad, good in fixed.MISREADS:
        at = f"instr(lower({c}), '{bad}')"
        forms.append(f"CASE WHEN {at} > 0 THEN concat(substr(lower({c}), 1, {at} - 1), '{good}', substr(lower({c}), {at} + {len(bad)})) END")
        forms.append(f"CASE WHEN {at} > 0 THEN replace(lower({c}), '{bad}', '{good}') END")
    letters = f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
    forms.append(f"CASE WHEN length({letters}) >= 4 THEN {letters} END")
    return f"[{', '.join(forms)}]"


def _cands(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({_forms(c)}, lambda v: v IS NOT NULL))), '|')"


def _cleaned(c: str) -> str:
    out = drop(drop(drop(c, fixed.LINK_PREFIX), fixed.LINK_DOSAGE), fixed.LINK_NUMBER)
    return f"CASE WHEN {out} = '' THEN {c} ELSE {out} END"


def _sim(a: str, b: str) -> str:
    """Twice the longest common subsequence in percent of both lengths: rows of its table as bits of whole numbers."""
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = ch THEN 1::HUGEINT << CAST(i - 1 AS INTEGER) ELSE 0::HUGEINT END))"
    full = f"((1::HUGEINT << CAST(length({a}) AS INTEGER)) - 1)"
    rows = f"list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda ch: CAST({mask} AS HUGEINT))), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE 200.0::double * (length({a}) - bit_count({rows})) / (length({a}) + length({b})) END"


_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda v: v <> ''))"
_REST = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda v: NOT list_contains({y}, v))), ' ')"
#: name, match, score of the names in asked(name)
LINKED = f"""dict AS (SELECT min(p_partkey) AS dict_idx, p_name AS entry FROM part GROUP BY p_name),
l0 AS (SELECT DISTINCT name, {_cleaned("name")} AS c FROM asked),
l1 AS (SELECT name, cand, min(pos) AS pos FROM (SELECT name, unnest({_forms("c")}) AS cand, unnest(range(0, len({_forms("c")}))) AS pos FROM l0) WHERE cand IS NOT NULL GROUP BY name, cand),
l2 AS MATERIALIZED (SELECT *, {_WORDS("cand")} AS x, {_WORDS("entry")} AS y FROM (SELECT DISTINCT cand FROM l1), dict),
l3 AS MATERIALIZED (SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS b, {_REST("x", "y")} AS p, {_REST("y", "x")} AS q FROM l2),
l4 AS MATERIALIZED (SELECT *, trim(b || ' ' || p) AS one, trim(b || ' ' || q) AS two FROM l3),
l5 AS MATERIALIZED (SELECT cand, dict_idx, entry, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN b <> '' AND (p = '' OR q = '') THEN 100 ELSE greatest({_sim("one", "two")}, {_sim("b", "one")}, {_sim("b", "two")}) END AS score FROM l4),
linked AS (SELECT name, entry AS match, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, pos, dict_idx) AS r FROM l1 JOIN l5 USING (cand)) WHERE r = 1)"""

MEDICINES = f"""{inputs.LINES_SQL}, {_steps(f"({STRICT}) OR ({WEAK})")},
m0 AS (SELECT *, bool_or(strict) OVER (PARTITION BY rx_id) AS any_strict FROM parsed JOIN (SELECT rx_id, line_no, ocr_conf, {STRICT} AS strict FROM lines) USING (rx_id, line_no)),
m1 AS MATERIALIZED (SELECT * FROM m0 WHERE strict OR NOT any_strict),
asked AS (SELECT DISTINCT name FROM m1), {LINKED},
m2 AS (SELECT *, match <> '' AND score >= 45 AS guess, 0.4::double * ocr_conf + 0.6::double * score / 100 AS blend FROM m1 JOIN linked USING (name)),
m3 AS (SELECT *, CASE WHEN guess THEN match ELSE name END AS corrected_name, NOT guess OR score < 85 OR blend < 0.55 OR NOT strict AS is_uncertain,
  CAST(round(CAST(CAST(blend AS VARCHAR) AS DECIMAL(22, 20)), 3) AS DOUBLE) AS conf FROM m2),
m4 AS (SELECT *, row_number() OVER (PARTITION BY rx_id, lower(trim(corrected_name)) ORDER BY line_no) AS r FROM m3),
m5 AS (SELECT *, row_number() OVER (PARTITION BY rx_id ORDER BY line_no) AS r8 FROM m4 WHERE strict OR r = 1)"""

_LOW_A, _LOW_B = fixed.LOW_CONFIDENCE.split("%s")
_CODES_VALUES = ", ".join(f"({o}, '{c}', '{n}', {t}, {_list(a)})" for o, c, n, t, a in fixed.FREQUENCIES)
_CODES = f"codes(ord, code, full_name, times_per_day, times) AS (VALUES {_CODES_VALUES})"
_LF = frequency("line")
_WARNED = f"""concat_ws('|', CASE WHEN conf < 0.45 THEN '{_LOW_A}' || CAST(round(conf * 100) AS INTEGER) || '%{_LOW_B}' END,
      CASE WHEN lenient THEN '{fixed.LENIENT_USED}' END, CASE WHEN u > 0 THEN u || '{fixed.UNMATCHED[2:]}' END, CASE WHEN n = 0 THEN '{fixed.NONE_FOUND}' END)"""

ORACLE = {
    "doses_per_prescription": f"WITH {PLANS}, e AS (SELECT rx_id, max(end_date) AS e, sum(days * len(daily)) AS n FROM plans GROUP BY rx_id) SELECT starts.rx_id, CAST(CAST(coalesce(e, start_date + 29) AS date) AS VARCHAR) AS end_date, CAST(coalesce(n, 0) AS BIGINT) AS total_doses FROM starts LEFT JOIN e USING (rx_id)",
    "split_lines": f"WITH {inputs.DOCUMENTS_SQL} SELECT rx_id, CAST(i AS INTEGER) AS line_no, {strip('line')} AS line FROM (SELECT rx_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM docs)",
    "line_scores": f"WITH {inputs.LINES_SQL} SELECT rx_id, line_no, {noise('line')} AS noise, {score('line')} AS score FROM lines",
    "strict_lines": f"WITH {inputs.LINES_SQL} SELECT rx_id, line_no, line, {score('line')} AS score FROM lines WHERE {STRICT}",
    "lenient_lines": f"WITH {inputs.LINES_SQL} SELECT rx_id, line_no, line, {score('line')} AS score FROM lines WHERE {WEAK} AND rx_id NOT IN (SELECT rx_id FROM lines WHERE {STRICT})",
    "header_fields": f"WITH {inputs.DOCUMENTS_SQL} SELECT rx_id, {', '.join(f'{strip(x("text", p))} AS {k}' for k, p in _HEADS.items())}, {strip(x('text', fixed.HOSPITAL, 0))} AS hospital FROM docs",
    "dosages": f"WITH {inputs.LINES_SQL}, p AS (SELECT rx_id, line_no, {after_marker('line')} AS rest FROM lines) SELECT rx_id, line_no, {strip(x('rest', fixed.DOSAGE, 0))} AS dosage, {chain([(m('rest', fixed.DOSAGE), drop('rest', fixed.DOSAGE))], 'rest')} AS rest FROM p",
    "frequencies": f"WITH {inputs.LINES_SQL} SELECT rx_id, line_no, {', '.join(f'{v} AS {k}' for k, v in _LF.items())}, {timing('line')} AS timing_note FROM lines",
    "default_times": f"WITH {inputs.LINES_SQL}, {_CODES}, f AS (SELECT rx_id, line_no, {_LF['code']} AS code FROM lines) SELECT rx_id, line_no, code, coalesce(nullif(times, ''), '08:00') AS times FROM f LEFT JOIN codes USING (code)",
    "durations": f"WITH {inputs.LINES_SQL} SELECT rx_id, line_no, {days('line')} AS days, {after_duration('line')} AS rest FROM lines",
    "medicine_lines": f"WITH {PARSED} SELECT rx_id, line_no, name, dosage, full_name AS frequency, code AS frequency_code, times_per_day, duration_days, timing_notes, times FROM parsed",
    "schedules": f"WITH {PLANS} SELECT rx_id, line_no, medicine_name, CAST(start_date AS VARCHAR) AS start_date, CAST(CAST(end_date AS date) AS VARCHAR) AS end_date, days, array_to_string(daily, ' ') AS times, duration_days = 0 AS is_ongoing FROM plans",
    "dose_rows": f"WITH {PLANS}, d AS (SELECT rx_id, start_date, len(daily) AS n, unnest(range(0, days)) AS o FROM plans) SELECT rx_id, CAST(o + 1 AS INTEGER) AS day_number, CAST(sum(n) AS BIGINT) AS doses, CAST(CAST(min(start_date + CAST(o AS INTEGER)) AS date) AS VARCHAR) AS day FROM d GROUP BY rx_id, o",
    "daily_slots": f"WITH {PLANS}, s AS ({_SLOTS} FROM plans), d AS (SELECT *, unnest(range(1, days + 1)) AS day_number FROM s) SELECT rx_id, CAST(day_number AS INTEGER) AS day_number, string_agg(concat_ws('|', time, medicine_name, dosage, timing_notes), ';' ORDER BY time, line_no, time_idx) AS slots FROM d GROUP BY rx_id, day_number",
    "daily_doses": f"WITH {PARSED} SELECT rx_id, CAST(sum(CASE WHEN times_per_day = 0 THEN 1 ELSE times_per_day END) AS BIGINT) AS daily_doses FROM parsed GROUP BY rx_id",
    "dose_progress": f"WITH {PLANS}, s AS ({_SLOTS} FROM plans) SELECT rx_id, count(*) AS total, count(*) FILTER (line_no % 2 = 0) AS taken, count(*) FILTER (line_no % 2 <> 0) AS remaining FROM s GROUP BY rx_id",
    "display_labels": f"""WITH {inputs.LINES_SQL}, v AS (SELECT *, CAST(rx_id % 101 AS double) / 100 AS c FROM lines) SELECT rx_id, line_no,
      CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS level, CASE WHEN c >= 0.75 THEN 'High' WHEN c >= 0.5 THEN 'Medium' ELSE 'Low' END AS quality,
      CAST(rx_id % 101 AS INTEGER) AS percent, CASE WHEN rx_id % 24 < 12 THEN 'Good morning' WHEN rx_id % 24 < 17 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting,
      line_no * 7 % 30 AS days, 1 AS times_per_day, rx_id % 130 < 100 AND 10 + line_no < 100 AS valid, {timing("line")} LIKE 'Before%' AS before FROM v""",
    "warnings": f"WITH {SUMMARY} SELECT rx_id, n AS n_medicines, u AS n_uncertain, {_WARNED} AS warnings FROM summary",
    "fallback_choice": f"""WITH {SUMMARY}, w AS (SELECT *, n = 0 OR conf <= 0.5 OR u::double / n >= 0.8 AS wanted, n + rx_id % 3 - 1 AS n2, greatest(u - 1, 0) AS u2, greatest(conf, 0.5) AS c2 FROM summary),
      b AS (SELECT *, wanted AND (n2 > n OR n2 = n AND (n2 - u2 > n - u OR n2 - u2 = n - u AND c2 > conf)) AS better FROM w)
      SELECT rx_id, wanted, better AS used_fallback, CASE WHEN better THEN n2 ELSE n END AS n_medicines, CASE WHEN better THEN u2 ELSE u END AS n_uncertain, round(CASE WHEN better THEN c2 ELSE conf END, 6) AS conf FROM b""",
    "ocr_rows": f"WITH {inputs.BOXES_SQL}, {_BOX_RUNS} SELECT rx_id, variant_idx, line_num, text, round(confidence, 10) AS confidence FROM bb",
    "word_blocks": f"WITH {inputs.WORDS_SQL}, {_WORD_RUNS} SELECT rx_id, variant_idx, line_num, text, round(confidence, 10) AS confidence FROM wb",
    "engine_texts": f"WITH {_ENGINES} SELECT rx_id, engine, variant_idx, text, avg_conf FROM et",
    "best_variants": f"WITH {_ENGINES} SELECT rx_id, engine, variant_idx, text, avg_conf FROM bv",
    "unread_documents": f"WITH {inputs.WORDS_SQL} SELECT o_orderkey AS rx_id FROM orders WHERE o_orderkey NOT IN (SELECT rx_id FROM words WHERE conf >= 50)",
    "merge_choice": f"""WITH {_ENGINES}, p AS (SELECT rx_id, max(avg_conf) FILTER (engine = 'box') AS b, max(avg_conf) FILTER (engine = 'word') AS w FROM bv GROUP BY rx_id)
      SELECT rx_id, CASE WHEN w IS NULL OR b * 0.55::double >= w * 0.45::double THEN 'box' ELSE 'word' END AS primary_engine,
      CASE WHEN b IS NOT NULL AND w IS NOT NULL THEN b * 0.55::double + w * 0.45::double ELSE coalesce(b, w) END AS conf,
      CASE WHEN b IS NOT NULL AND w IS NOT NULL THEN 'box+word' WHEN w IS NULL THEN 'box' ELSE 'word' END AS engines FROM p""",
    "line_similarities": f"WITH {inputs.LINES_SQL}, p AS (SELECT l.rx_id, l.line_no, l.line AS a, r.line AS b FROM lines l JOIN lines r ON l.rx_id = r.rx_id AND r.line_no = l.line_no + 1) SELECT rx_id, line_no, round({_line_sim('a', 'b')}, 6) AS similarity FROM p",
    "merged_texts": f"""WITH RECURSIVE {_ENGINES},
      pc AS (SELECT rx_id, max(avg_conf) FILTER (engine = 'box') AS b, max(avg_conf) FILTER (engine = 'word') AS w FROM bv GROUP BY rx_id),
      pe AS (SELECT rx_id, CASE WHEN w IS NULL OR b * 0.55::double >= w * 0.45::double THEN 'box' ELSE 'word' END AS primary_engine, CASE WHEN b IS NOT NULL AND w IS NOT NULL THEN b * 0.55::double + w * 0.45::double ELSE coalesce(b, w) END AS conf FROM pc),
      ln AS (SELECT eb.rx_id, eb.engine, list({{'t': eb.text, 'c': round(confidence, 10)}} ORDER BY line_num) AS l FROM eb JOIN bv ON eb.rx_id = bv.rx_id AND eb.engine = bv.engine AND eb.variant_idx = bv.variant_idx WHERE trim(eb.text) <> '' GROUP BY ALL),
      pr AS MATERIALIZED (SELECT pe.*, f.l AS prim, s.l AS sec, bv.text AS own FROM pe JOIN bv ON bv.rx_id = pe.rx_id AND bv.engine = primary_engine LEFT JOIN ln f ON f.rx_id = pe.rx_id AND f.engine = primary_engine LEFT JOIN ln s ON s.rx_id = pe.rx_id AND s.engine <> primary_engine),
      step(rx_id, i, used, told) AS (
        SELECT rx_id, 1, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM pr WHERE sec IS NOT NULL
        UNION ALL
        SELECT rx_id, i + 1, CASE WHEN best > 0.5 THEN list_append(used, j) ELSE used END, list_append(told, CASE WHEN best > 0.5 AND sec[j].c > prim[i].c THEN sec[j].t ELSE prim[i].t END) FROM (
          SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS j FROM (
            SELECT rx_id, i, used, told, prim, sec, list_transform(range(1, len(sec) + 1), lambda k: CASE WHEN list_contains(used, k) THEN 0 ELSE {_line_sim("prim[i].t", "sec[k].t")} END) AS sims
            FROM step JOIN pr USING (rx_id) WHERE i <= len(prim)))),
      last AS (SELECT rx_id, arg_max(told, i) AS told FROM step GROUP BY rx_id)
      SELECT pr.rx_id, CASE WHEN sec IS NOT NULL THEN array_to_string(told, chr(10)) ELSE own END AS text, round(conf, 12) AS conf, primary_engine FROM pr LEFT JOIN last USING (rx_id)""",
    "link_candidates": f"WITH d AS (SELECT min(p_partkey) AS dict_idx, p_name AS name FROM part GROUP BY p_name), r AS (SELECT dict_idx, concat('Tab ', translate(name, 'ols', '015'), ' ', cast(dict_idx % 3 * 4000 AS string)) AS raw FROM d), c AS (SELECT dict_idx, {_cleaned('raw')} AS cleaned FROM r) SELECT dict_idx, cleaned, {_cands('cleaned')} AS candidates FROM c",
    "link_matches": f"WITH asked AS (SELECT DISTINCT translate(p_name, 'ols', '015') AS name FROM part), {LINKED} SELECT name, match, score FROM linked",
    "medicines": f"""WITH {MEDICINES} SELECT rx_id, line_no, name, corrected_name, dosage, code AS frequency_code, CASE WHEN strict THEN times_per_day ELSE greatest(times_per_day, 1) END AS times_per_day, duration_days, timing_notes,
      CASE WHEN times = '' AND NOT strict THEN '08:00' ELSE times END AS times, CASE WHEN strict THEN conf ELSE least(conf, 0.45::double) END AS confidence, is_uncertain, NOT strict AS lenient FROM m5 WHERE strict OR r8 <= 8""",
    "link_bands": f"""WITH {inputs.LINES_SQL}, v AS (SELECT rx_id, line_no, CASE WHEN line_no = 3 THEN ' ' ELSE line END AS name, rx_id % 9 > 0 AS has, CAST((rx_id + line_no) % 101 AS double) AS s FROM lines)
      SELECT rx_id, line_no, CASE WHEN has AND s >= 45 AND trim(name) <> '' THEN 'match' ELSE name END AS corrected_name, CASE WHEN trim(name) = '' THEN 0 WHEN has THEN s ELSE 50 END AS score,
      NOT (has AND s >= 85 AND trim(name) <> '') AS flagged FROM v""",
    "model_lines": f"""WITH {inputs.LINES_SQL}, v AS (SELECT rx_id, line_no, regexp_replace(line, '\\s+', ' ', 'g') AS l FROM lines)
      SELECT rx_id, line_no, CASE rx_id % 4 WHEN 0 THEN concat(l, ' ', line_no, chr(10), 'plain text') WHEN 1 THEN concat(l, ' OD')
      WHEN 2 THEN concat_ws(chr(10), CASE WHEN length(l) >= 3 THEN l END, CASE WHEN length(l) >= 3 THEN l END, 'end of it') ELSE concat('{{broken ', l, '}}') END AS text FROM v""",
    "dictionary_search": "SELECT min(p_partkey) AS dict_idx, p_name AS name FROM part WHERE contains(lower(p_name), 'giz') GROUP BY p_name ORDER BY 1 LIMIT 5",
    "dictionary_sizes": f"WITH {_CODES} SELECT (SELECT count(DISTINCT p_name) FROM part) AS medicines, (SELECT count(*) FROM codes) AS codes",
    "frequency_dictionary": f"WITH {inputs.LINES_SQL}, {_CODES}, u AS (SELECT {_LF['code']} AS code, count(*) AS lines FROM lines GROUP BY 1) SELECT ord, code, full_name, times_per_day, times, coalesce(lines, 0) AS lines FROM codes LEFT JOIN u USING (code)",
    "upsert_medicines": """WITH r AS (SELECT p_partkey AS key, concat(p_name, ' ', p_partkey % 50) AS name, p_brand AS category FROM part),
      o AS (SELECT arg_min(key, key) AS key, name, arg_min(category, key) AS category FROM r WHERE key % 2 = 0 GROUP BY name),
      n AS (SELECT max(key) AS key, name, arg_max(category, key) AS category FROM r WHERE key % 3 = 0 GROUP BY name)
      SELECT key, name, category FROM n UNION ALL SELECT key, name, category FROM o WHERE name NOT IN (SELECT name FROM n)""",
    "upsert_codes": f"""WITH {_CODES}, p AS (SELECT 100 + p_partkey AS ord, substring(upper(translate(p_brand, '#', '')), 1, 7) AS code, p_type, p_size FROM part),
      n AS (SELECT ord, code, full_name FROM codes UNION ALL SELECT max(ord), code, upper(arg_max(p_type, ord)) FROM p WHERE p_size <= 10 GROUP BY code)
      SELECT ord, code, full_name FROM n UNION ALL SELECT max(ord), code, arg_max(p_type, ord) FROM p WHERE code NOT IN (SELECT code FROM n) GROUP BY code""",
    "table_versions": """WITH r AS (SELECT p_partkey AS key, concat(p_name, ' ', p_partkey % 50) AS name, p_brand AS category, p_retailprice AS price FROM part),
      o AS (SELECT * FROM r WHERE key % 2 = 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY key DESC) = 1),
      n AS (SELECT * FROM r WHERE key % 3 = 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY key DESC) = 1)
      SELECT *, 1 AS version FROM o UNION ALL SELECT *, 2 FROM n UNION ALL SELECT *, 2 FROM o WHERE name NOT IN (SELECT name FROM n)""",
    "dictionary_failover": f"""SELECT min(p_partkey) AS dict_idx, p_name AS name, true AS found FROM part GROUP BY p_name
      UNION ALL SELECT i - 1, [{", ".join(f"'{t}'" for t in fixed.MEDIA_TYPES)}][i], false FROM (SELECT unnest(range(1, {len(fixed.MEDIA_TYPES) + 1})) AS i)""",
    "result_ids": """SELECT sha256(concat('{"o_orderkey":', o_orderkey, ',"o_custkey":', o_custkey, '}')) AS id, o_orderkey FROM orders""",
    "stored_prescriptions": f"""WITH {inputs.DOCUMENTS_SQL}, {_steps(STRICT)}, {_SUMMARY},
      l AS (SELECT rx_id, string_agg(concat_ws('|', name, dosage, code, duration_days), ';' ORDER BY line_no) AS medicines FROM parsed GROUP BY rx_id)
      SELECT text AS raw_text, {strip(x('text', fixed.DOCTOR))} AS doctor_name, {strip(x('text', fixed.PATIENT))} AS patient_name, coalesce(medicines, '') AS medicines, {_WARNED} AS warnings, ocr_conf AS overall_confidence
      FROM docs JOIN summary USING (rx_id) LEFT JOIN l USING (rx_id)""",
    "stored_reminders": f"WITH {PLANS} SELECT rx_id AS prescription_id, medicine_name, dosage, days FROM plans",
    "result_json": f"WITH {PARSED} SELECT rx_id, concat('{{\"rx_id\":', rx_id, ',\"line_no\":', line_no, ',\"name\":\"', name, '\",\"dosage\":\"', dosage, '\",\"duration_days\":', duration_days, '}}') AS json FROM parsed",
    "upload_validation": f"""WITH u AS (SELECT o_orderkey AS upload_id, [{", ".join(f"'{t}'" for t in fixed.MEDIA_TYPES)}, 'text/plain', NULL][o_orderkey % 7 + 1] AS mime, CAST(trunc(o_totalprice * 40) AS BIGINT) % 12000000 AS length FROM orders)
      SELECT *, CASE WHEN mime IS NULL OR mime = 'text/plain' THEN 415 WHEN length > 10485760 THEN 413 WHEN length < 1000 THEN 400 ELSE 200 END AS status_code FROM u""",
    "image_geometry": """WITH i AS (SELECT o_orderkey AS image_id, CAST(200 + o_orderkey % 3000 AS double) AS w, CAST(150 + o_custkey % 3500 AS double) AS h, o_totalprice / 200 AS v FROM orders),
      s AS (SELECT *, least(greatest(900 / h, 1200 / w), 3) AS f FROM i)
      SELECT image_id, round(CASE WHEN (h < 900 OR w < 1200) AND f > 1.05 THEN f ELSE 1 END, 6) AS up, round(least(1, 2400 / greatest(w, h)), 6) AS down, round(least(v / 1000, 1), 10) AS quality FROM s""",
    "text_regions": """WITH c AS (SELECT l_orderkey AS rx_id, l_partkey % 800 AS x, l_suppkey % 500 AS y, CAST(trunc(l_quantity) AS BIGINT) * 6 AS w, CAST(l_linenumber AS BIGINT) * 5 AS h FROM lineitem),
      u AS (SELECT rx_id, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM c WHERE w * h >= 80 AND w >= 10 AND h >= 8 GROUP BY rx_id),
      v AS (SELECT *, (x2 - x1) * (y2 - y1) / 1080000::double > 0.9 OR (x2 - x1 < 120 AND y2 - y1 < 72) AS whole, CAST(floor(greatest(x2 - x1, y2 - y1) * 0.1::double) AS BIGINT) + 12 AS p FROM u)
      SELECT rx_id, CASE WHEN NOT whole THEN greatest(0, x1 - p) ELSE -1 END AS x1, CASE WHEN NOT whole THEN greatest(0, y1 - p) ELSE -1 END AS y1, CASE WHEN NOT whole THEN least(1200, x2 + p) ELSE -1 END AS x2, CASE WHEN NOT whole THEN least(900, y2 + p) ELSE -1 END AS y2 FROM v""",
    "skews": """WITH a AS (SELECT l_orderkey AS rx_id, CAST(CAST(trunc(l_quantity) AS INTEGER) % 41 - 20 AS double) + 0.25 AS a FROM lineitem), k AS (SELECT rx_id, coalesce(median(a) FILTER (a > -15 AND a < 15), 0.0::double) AS m FROM a GROUP BY rx_id)
      SELECT rx_id, CASE WHEN abs(m) < 0.5 THEN 0.0::double ELSE m END AS skew FROM k""",
}
