"""DuckDB SQL for each registered query (the correctness oracle).

The SQL derives the same fixtures from the same tables, but independently:
pairs by brute force (self-join of all i < j, row_number <= cap), positions
by a global window, rational equality by 128-bit integers. Tables
``documents labels embeddings conversations`` are views.
"""

from __future__ import annotations

from prefloom.functions.text import PY_WHITESPACE_CHARS, WS_CLASS_BODY
from prefloom.operators import prompts
from prefloom.plans import catalog as C
from prefloom.sources import testdata as T

WS_CHARS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE_CHARS) + ")"
WS = f"[{WS_CLASS_BODY}]"
NON_WS = f"[^{WS_CLASS_BODY}]"
BOX_FIRST = r"\\boxed\{(.*?)\}"
BOX_BAL = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
BOX_LAST = r"(?s:.*)\\boxed\{(.*?)\}"
NL = "chr(10)"


def lit(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + f" || {NL} || ".join(quoted) + ")"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def boxed(x: str, pattern: str = BOX_FIRST) -> str:
    return (f"(CASE WHEN regexp_matches({x}, '{pattern}') "
            f"THEN {strip(f'regexp_extract({x}, {chr(39)}{pattern}{chr(39)}, 1)')} ELSE {strip(x)} END)")


def norm(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS}+', ',', 'g')"


def ntok(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NON_WS}+'))"


def skey(seed, *cols) -> str:
    cat = f"'{seed}'" + "".join(f" || ':' || CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST(('0x' || substr(md5({cat}), 1, 13))::BIGINT AS DOUBLE)"


def uniform(seed, *cols) -> str:
    return f"(({skey(seed, *cols)} + 0.5) / 4503599627370496.0)"


def responses(g: int, name: str) -> str:
    return (f"{name} AS (SELECT doc_id // {g} AS problem_id, CAST(doc_id % {g} AS INTEGER) AS response_idx, "
            f"doc_id, text AS response, n_chars, lang, source FROM documents)")


def problems(src: str, name: str) -> str:
    return (f"{name} AS (SELECT problem_id, response AS problem, lang, source, n_chars "
            f"FROM {src} WHERE response_idx = 0)")


R8 = responses(8, "r8")
P8 = problems("r8", "p8")
C8 = ("c8 AS (SELECT r8.*, CAST(coalesce(l.quality, 0) AS INTEGER) AS score "
      "FROM r8 LEFT JOIN labels l ON l.doc_id = r8.doc_id)")
ST = "st AS (SELECT doc_id AS problem_id, text AS problem, lang, source, n_chars FROM documents)"
R16 = responses(16, "r16")
P16 = problems("r16", "p16")


def pairs_cte(name: str, src: str, k: int) -> str:
    return f"""{name}_all AS (
  SELECT a.problem_id, a.response_idx AS i, b.response_idx AS j, a.score AS si, b.score AS sj
  FROM {src} a JOIN {src} b ON a.problem_id = b.problem_id AND a.response_idx < b.response_idx
  WHERE a.score <> b.score),
{name} AS (
  SELECT problem_id, CAST(pair_rank AS INTEGER) AS pair_rank, i, j,
    CASE WHEN si > sj THEN i ELSE j END AS accepted_idx,
    CASE WHEN si > sj THEN j ELSE i END AS rejected_idx,
    CASE WHEN si > sj THEN si ELSE sj END AS accepted_score,
    CASE WHEN si > sj THEN sj ELSE si END AS rejected_score
  FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY i, j) AS pair_rank FROM {name}_all)
  WHERE pair_rank <= {k})"""


def texts_cte(name: str, pairs: str, txt: str, prob: str) -> str:
    return f"""{name} AS (
  SELECT p.*, pr.problem, ta.response AS accepted, tr.response AS rejected FROM {pairs} p
  JOIN {txt} ta ON ta.problem_id = p.problem_id AND ta.response_idx = p.accepted_idx
  JOIN {txt} tr ON tr.problem_id = p.problem_id AND tr.response_idx = p.rejected_idx
  JOIN {prob} pr ON pr.problem_id = p.problem_id)"""


MC = (f"mc AS (SELECT problem_id, response_idx, doc_id, "
      f"response || ' So \\boxed{{' || {lst(T.MATH_VALUES)}[n_chars % 7 + 1] || '}} holds' AS response, "
      f"'\\boxed{{' || {lst(T.MATH_VALUES)}[problem_id % 7 + 1] || '}}' AS answer FROM r8)")
CC = (f"cc AS (SELECT problem_id, response_idx, doc_id, "
      f"response || ' \\boxed{{' || {lst(T.CHOICE_VALUES)}[n_chars % 5 + 1] || '}}' AS response, "
      f"{lst(T.CHOICE_VALUES)}[problem_id % 5 + 1] AS answer FROM r8)")

_THOUS = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
_DEC = r"^-?[0-9]+(\.[0-9]+)?$"
_TEX = r"^\\[dt]?frac\{(-?[0-9]{1,18})\}\{(-?[0-9]{1,18})\}$"
_SL = r"^(-?[0-9]{1,18})/(-?[0-9]{1,18})$"


def rational_ctes(src: str, a: str, b: str, name: str) -> str:
    """Adds ``{name}.rat_eq`` comparing columns ``a`` and ``b`` of ``src``."""
    def s_expr(x):
        return f"(CASE WHEN regexp_matches({x}, '{_THOUS}') THEN replace({x}, ',', '') ELSE {x} END)"

    def parts(p):
        s = f"{p}_s"
        ip = f"regexp_extract({s}, '^-?([0-9]+)', 1)"
        fp = f"regexp_extract({s}, '\\.([0-9]+)$', 1)"
        dec_ok = f"(regexp_matches({s}, '{_DEC}') AND length({ip} || {fp}) <= 18)"
        dec_num = f"(TRY_CAST({ip} || {fp} AS HUGEINT) * CASE WHEN starts_with({s}, '-') THEN -1 ELSE 1 END)"
        dec_den = f"TRY_CAST('1' || repeat('0', length({fp})) AS HUGEINT)"
        tex = f"regexp_matches({s}, '{_TEX}')"
        sl = f"regexp_matches({s}, '{_SL}')"
        fn = f"TRY_CAST(CASE WHEN {tex} THEN regexp_extract({s}, '{_TEX}', 1) ELSE regexp_extract({s}, '{_SL}', 1) END AS HUGEINT)"
        fd = f"TRY_CAST(CASE WHEN {tex} THEN regexp_extract({s}, '{_TEX}', 2) ELSE regexp_extract({s}, '{_SL}', 2) END AS HUGEINT)"
        fr_ok = f"(({tex} OR {sl}) AND {fd} <> 0)"
        num = f"CASE WHEN {dec_ok} THEN {dec_num} WHEN {fr_ok} THEN {fn} END AS {p}_num"
        den = f"CASE WHEN {dec_ok} THEN {dec_den} WHEN {fr_ok} THEN {fd} END AS {p}_den"
        return f"{num}, {den}"

    return f"""{name}_s AS (SELECT *, {s_expr(a)} AS ra_s, {s_expr(b)} AS rb_s FROM {src}),
{name}_p AS (SELECT *, {parts('ra')}, {parts('rb')} FROM {name}_s),
{name} AS (SELECT *, coalesce(ra_num * rb_den = rb_num * ra_den, false) AS rat_eq FROM {name}_p)"""


def math_scored(pattern: str = BOX_FIRST) -> str:
    return (f"ms0 AS (SELECT problem_id, response_idx, doc_id, response, answer, {boxed('response', pattern)} AS rc, "
            f"{boxed('answer', pattern)} AS ac FROM mc),\n" + rational_ctes("ms0", "rc", "ac", "ms1") +
            ",\nms AS (SELECT *, (rc IS NOT DISTINCT FROM ac) OR rat_eq AS correct FROM ms1)")


def choice_items(x: str, trim: bool = False) -> str:
    base = (f"CASE WHEN contains({x}, '[') AND json_valid({x}) AND json_type({x}) = 'ARRAY' "
            f"THEN from_json({x}, '[\"VARCHAR\"]') WHEN contains({x}, ',') THEN string_split({x}, ',') END")
    return f"list_transform({base}, lambda y: {strip('y')})" if trim else base


def choice_scored() -> str:
    items = choice_items
    return f"""cs0 AS (SELECT problem_id, response_idx, doc_id, response, {boxed('response')} AS g, answer AS c FROM cc),
cs1 AS (SELECT *, {items('g')} AS gi, {items('c')} AS ci FROM cs0),
cs AS (SELECT *, CAST(CASE WHEN (gi IS NULL) <> (ci IS NULL) THEN -1
    WHEN gi IS NOT NULL THEN len(ci) - len(list_filter(ci, lambda x: NOT list_contains(gi, x)))
                         - len(list_filter(gi, lambda x: NOT list_contains(ci, x)))
    WHEN g = c THEN 1 ELSE -1 END AS INTEGER) AS score FROM cs1)"""


def code_ctes(statements: str = "p16") -> str:
    t = "response"
    shape = "n_chars % 5"
    resp = (f"CASE WHEN {shape} = 0 THEN {t} "
            f"WHEN {shape} = 1 THEN {lit(chr(10).join(['Here is my code:', '```python', '']))} || {t} || {lit(chr(10) + '```' + chr(10) + 'That is all.')} "
            f"WHEN {shape} = 2 THEN {lit('```' + chr(10))} || {t} || {lit(chr(10) + '```')} "
            f"WHEN {shape} = 3 THEN {lit('Code:' + chr(10) + '```python')} || {t} "
            f"ELSE {lit('```python' + chr(10) + 'import subprocess' + chr(10))} || {t} || {lit(chr(10) + '```')} END")
    body = "split_part(response, '```', 2)"
    code = (f"CASE WHEN contains(response, '```') THEN (CASE WHEN starts_with({body}, 'python') "
            f"THEN substr({body}, 7) ELSE {body} END) ELSE response END")
    starter = f"CASE WHEN lang = 'en' THEN {lit(T.STARTER_EN)} WHEN lang = 'de' THEN '' END"
    schema = '{"fn_name":"VARCHAR","inputs":["VARCHAR"],"outputs":["VARCHAR"]}'
    v = "((n_chars + case_idx) % 5)"
    err = (f"CASE WHEN NOT ok THEN {lit('Traceback (most recent call last):' + chr(10) + '  File \"/tmp/run/tmp.py\", line ')}"
           f" || CAST(case_idx + 3 AS VARCHAR) || {lit(', in <module>' + chr(10) + '    main()' + chr(10))}"
           f" || {lst(T.ERROR_KINDS)}[n_chars % 3 + 1] ELSE '' END")
    passed = (f"(ok AND coalesce(CASE WHEN fn_name IS NULL THEN {norm('actual')} = {norm('expected')} "
              f"ELSE actual = expected END, false))")
    return f"""{R16}, {P16}, {ST},
kc AS (SELECT problem_id, response_idx, doc_id, n_chars, {resp} AS response FROM r16),
kx AS (SELECT problem_id, response_idx, {code} AS code FROM kc),
kp0 AS (SELECT problem_id, problem AS question, lang, string_split(problem, {NL}) AS lines FROM {statements}),
kp1 AS (SELECT *, list_transform(lines, lambda x: replace(x, ' ', '_')) AS outs0 FROM kp0),
kp AS (SELECT problem_id, question, lang, {starter} AS starter_code,
  to_json({{'fn_name': CASE WHEN problem_id % 3 = 2 THEN 'solve' END, 'inputs': lines,
            'outputs': CASE WHEN problem_id % 3 = 1 THEN outs0[1:greatest(len(outs0) - 1, 0)] ELSE outs0 END}})::VARCHAR
    AS input_output FROM kp1),
tc0 AS (SELECT problem_id, from_json(input_output, '{schema}') AS t FROM kp),
tc1 AS (SELECT problem_id, t.fn_name AS fn_name, t.inputs AS inputs, t.outputs AS outputs,
  least(len(t.inputs), len(t.outputs)) AS m FROM tc0),
tc2 AS (SELECT problem_id, fn_name, inputs, outputs, unnest(range(1, m + 1)) AS k FROM tc1),
cases AS (SELECT problem_id, CAST(k - 1 AS INTEGER) AS case_idx, fn_name, inputs[k] AS input,
  outputs[k] AS expected FROM tc2),
cr0 AS (SELECT c.problem_id, r.response_idx, c.case_idx, c.fn_name, c.expected, r.n_chars,
  NOT (r.n_chars % 11 = 0 AND c.case_idx = 1) AS ok FROM kc r JOIN cases c ON c.problem_id = r.problem_id),
cr AS (SELECT problem_id, response_idx, case_idx, fn_name, expected,
  CASE WHEN NOT ok THEN '' WHEN {v} = 0 THEN expected WHEN {v} = 1 THEN replace(expected, ' ', '  ')
       WHEN {v} = 2 THEN expected || {NL} ELSE expected || ' x' END AS actual, ok, {err} AS error FROM cr0),
pc AS (SELECT problem_id, response_idx, count(*) AS n_cases, CAST(sum(CAST({passed} AS INTEGER)) AS BIGINT) AS n_passed,
  bool_and(ok) AS all_ran FROM cr GROUP BY problem_id, response_idx),
ks AS (SELECT kc.problem_id, kc.response_idx, kc.response, coalesce(pc.n_cases, 0) AS n_cases,
  coalesce(pc.n_passed, 0) AS n_passed,
  CAST(CASE WHEN contains(kx.code, 'subprocess') OR contains(kx.code, 'venv') THEN 0
       ELSE coalesce(CASE WHEN pc.all_ran THEN pc.n_passed ELSE 0 END, 0) END AS INTEGER) AS score
  FROM kc JOIN kx ON kx.problem_id = kc.problem_id AND kx.response_idx = kc.response_idx
  LEFT JOIN pc ON pc.problem_id = kc.problem_id AND pc.response_idx = kc.response_idx)"""


def rewards_cte() -> str:
    parts = []
    for name, m in C.REWARD_MODELS.items():
        parts.append(f"SELECT '{name}' AS model, vec_id, list_sum(list_transform(embedding, "
                     f"lambda x, i: CAST(x AS DOUBLE) * ((i % {m}) - {m // 2}))) AS reward FROM embeddings")
    return "rw AS (" + " UNION ALL ".join(parts) + ")"


def scored_pairs_ctes() -> str:
    return f"""{R8}, {P8}, {C8}, {pairs_cte('pr8', 'c8', C.MATH_CAP)}, {rewards_cte()},
sp AS (SELECT ra.model, p.*, ra.reward AS r_accepted, rr.reward AS r_rejected, p8.lang AS domain
  FROM pr8 p
  JOIN rw ra ON ra.vec_id = (p.problem_id * 8 + p.accepted_idx) % (SELECT count(*) FROM embeddings)
  JOIN rw rr ON rr.model = ra.model
    AND rr.vec_id = (p.problem_id * 8 + p.rejected_idx) % (SELECT count(*) FROM embeddings)
  JOIN p8 ON p8.problem_id = p.problem_id)"""


def selection_ctes() -> str:
    key = skey(C.SEED, "problem_id", "pair_rank")
    g = f"(-gap / 1.0 - ln(-ln({uniform(str(C.SEED) + ':draw', 'problem_id', 'pair_rank')})))"
    return f"""{scored_pairs_ctes()},
pool AS (SELECT model, problem_id, pair_rank, r_accepted, r_rejected FROM sp),
win AS (SELECT *, abs(r_accepted - r_rejected) AS gap FROM pool
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY {key}, problem_id, pair_rank)
    <= count(*) OVER (PARTITION BY model) // {C.SELECT_WINDOW}),
keyed AS (SELECT *, {g} AS gkey FROM win),
sel AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY gkey DESC, problem_id, pair_rank) AS select_rank
  FROM keyed QUALIFY select_rank <= (SELECT count(*) FROM pool p WHERE p.model = keyed.model) // {C.SELECT_K})"""


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    pairs_cols = "problem_id, pair_rank, accepted_idx, rejected_idx, accepted_score, rejected_score"
    q["preference_pairs"] = f"""WITH {R8}, {P8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)},
{texts_cte('pt', 'pr', 'r8', 'p8')}
SELECT problem_id, pair_rank, i, j, accepted_idx, rejected_idx, accepted_score, rejected_score,
  problem, accepted, rejected FROM pt"""
    q["preference_pairs_math"] = f"""WITH {R8}, {P8}, {MC}, {math_scored()},
sc AS (SELECT problem_id, response_idx, response, CAST(correct AS INTEGER) AS score FROM ms),
{pairs_cte('pr', 'sc', C.MATH_CAP)}, {texts_cte('pt', 'pr', 'sc', 'p8')}
SELECT {pairs_cols}, problem, accepted, rejected FROM pt"""
    q["preference_pairs_medical"] = f"""WITH {R8}, {P8}, {CC}, {choice_scored()},
{pairs_cte('pr', 'cs', C.MATH_CAP)}, {texts_cte('pt', 'pr', 'cs', 'p8')}
SELECT {pairs_cols}, accepted, rejected FROM pt"""
    q["preference_pairs_code"] = f"""WITH {code_ctes()},
{pairs_cte('pr', 'ks', C.CODE_CAP)}, {texts_cte('pt', 'pr', 'ks', 'p16')}
SELECT {pairs_cols}, problem, accepted, rejected FROM pt"""
    q["pair_count_by_problem"] = f"""WITH {R8}, {C8},
np AS (SELECT a.problem_id, count(*) AS n FROM c8 a JOIN c8 b ON a.problem_id = b.problem_id
  AND a.response_idx < b.response_idx WHERE a.score <> b.score GROUP BY a.problem_id),
nr AS (SELECT problem_id, count(*) AS n_responses FROM c8 GROUP BY problem_id)
SELECT nr.problem_id, nr.n_responses, CAST(coalesce(np.n, 0) AS DECIMAL(38,0)) AS n_pairs_all,
  least(coalesce(np.n, 0), {C.MATH_CAP}) AS n_pairs_kept FROM nr LEFT JOIN np USING (problem_id)"""

    q["pair_count_by_problem16"] = f"""WITH {R16},
c16 AS (SELECT problem_id, response_idx, CAST(n_chars % 5 AS INTEGER) AS score FROM r16),
np AS (SELECT a.problem_id, count(*) AS n FROM c16 a JOIN c16 b ON a.problem_id = b.problem_id
  AND a.response_idx < b.response_idx WHERE a.score <> b.score GROUP BY a.problem_id),
nr AS (SELECT problem_id, count(*) AS n_responses FROM c16 GROUP BY problem_id)
SELECT nr.problem_id, nr.n_responses, CAST(coalesce(np.n, 0) AS DECIMAL(38,0)) AS n_pairs_all,
  least(coalesce(np.n, 0), {C.CODE_CAP}) AS n_pairs_kept FROM nr LEFT JOIN np USING (problem_id)"""

    ratio = "[" + ", ".join(f"{r}::DOUBLE" for r in C.SOURCE_RATIOS) + "]"
    q["mix_sources_by_ratio"] = f"""WITH n AS (
  SELECT source, {ratio}[(row_number() OVER (ORDER BY source) - 1) % {len(C.SOURCE_RATIOS)} + 1] AS ratio, count(*) AS n
  FROM documents WHERE source IS NOT NULL GROUP BY source),
quota AS (SELECT source, floor((sum(n) OVER () // {C.MIX_EXAMPLES}) * ratio / sum(ratio) OVER ()) AS quota FROM n)
SELECT source AS source_name, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY {skey(C.SEED, 'doc_id')}, doc_id) AS INTEGER)
  AS sample_rank FROM documents JOIN quota USING (source) QUALIFY sample_rank <= quota"""
    q["nested_subsets"] = f"""WITH {R8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)},
rk AS (SELECT problem_id, pair_rank, CAST(row_number() OVER (ORDER BY {skey(C.SEED, 'problem_id', 'pair_rank')},
  problem_id, pair_rank) AS INTEGER) AS subset_rank, count(*) OVER () AS n FROM pr)
SELECT problem_id, pair_rank, subset_rank,
  CAST(CASE {" ".join(f"WHEN subset_rank <= n // {k} THEN n // {k}" for k in C.SUBSETS)} END AS INTEGER) AS subset_size
FROM rk WHERE subset_rank <= n // {C.SUBSETS[-1]}"""

    pre, post = prompts.split_template(prompts.MATH_TEMPLATE)
    q["render_prompt_math"] = f"WITH {ST} SELECT problem_id, {lit(pre)} || problem || {lit(post)} AS prompt FROM st"
    cpre, cpost = prompts.split_template(prompts.CODE_TEMPLATE)
    code_prompt = f"""WITH {code_ctes('st')},
pp AS (SELECT problem_id, starter_code, {lit(cpre)} || question || {lit(cpost)} AS prompt FROM kp)
SELECT problem_id, CASE WHEN coalesce(starter_code, '') <> '' THEN prompt || {lit(prompts.STARTER_NOTE)} || starter_code
  ELSE prompt END AS prompt FROM pp"""
    q["render_prompt_code"] = code_prompt
    q["user_messages"] = f"SELECT problem_id, 'user' AS role, prompt AS content FROM ({code_prompt})"
    q["chat_pair_messages"] = f"""WITH {R8}, {P8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)},
{texts_cte('pt', 'pr', 'r8', 'p8')}
SELECT problem_id, pair_rank, 'user: ' || problem || {NL} || 'assistant: ' || accepted AS chosen_text,
  'user: ' || problem || {NL} || 'assistant: ' || rejected AS rejected_text FROM pt"""
    sft = """sft AS (SELECT u.conv_id, u.turn, u.text AS problem, a.text AS completion FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
    q["sft_pairs"] = f"WITH {sft} SELECT conv_id, turn, problem, completion FROM sft"
    q["sft_text"] = (f"WITH {sft} SELECT conv_id, turn, '<|im_start|>user' || {NL} || problem || '<|im_end|>' || {NL}"
                     f" || '<|im_start|>assistant' || {NL} || completion || '<|im_end|>' || {NL} AS text FROM sft")
    q["fan_out_samples"] = f"""WITH {ST},
pm AS (SELECT problem_id, {lit(pre)} || problem || {lit(post)} AS prompt FROM st),
fo AS (SELECT problem_id, prompt, unnest(range(0, {C.FAN_OUT})) AS s FROM pm)
SELECT problem_id, CAST(s AS INTEGER) AS sample_idx, prompt FROM fo"""

    q["extract_boxed"] = f"WITH {R8}, {MC} SELECT problem_id, response_idx, {boxed('response')} AS core FROM mc"
    q["extract_boxed_balanced"] = (f"WITH {R8}, {MC} SELECT problem_id, response_idx, "
                                   f"{boxed('response', BOX_BAL)} AS core FROM mc")
    q["math_score"] = f"WITH {R8}, {MC}, {math_scored()} SELECT problem_id, response_idx, correct FROM ms"
    q["math_score_rational"] = (f"WITH {R8}, {MC}, {math_scored(BOX_BAL)} "
                                f"SELECT problem_id, response_idx, correct FROM ms")
    q["medical_score"] = (f"WITH {R8}, {CC}, {choice_scored()} SELECT problem_id, response_idx, score, "
                          f"CASE WHEN gi IS NOT NULL AND ci IS NOT NULL THEN CAST(score = len(ci) AS INTEGER) "
                          f"ELSE score END AS perfect FROM cs")
    q["extract_code"] = f"WITH {code_ctes()} SELECT problem_id, response_idx, code FROM kx"
    q["forbidden_code"] = (f"WITH {code_ctes()} SELECT problem_id, response_idx, "
                           f"contains(code, 'subprocess') OR contains(code, 'venv') AS forbidden FROM kx")
    q["testcase_explode"] = f"WITH {code_ctes('st')} SELECT problem_id, case_idx, fn_name, input, expected FROM cases"
    q["code_pass_count"] = f"WITH {code_ctes()} SELECT problem_id, response_idx, n_cases, n_passed, score FROM ks"
    q["failure_reasons"] = (f"WITH {code_ctes()} SELECT string_split(error, {NL})[-1] AS reason, "
                            f"count(*) AS n_failed FROM cr WHERE NOT ok GROUP BY 1")

    q["length_filter"] = f"""WITH {R8}, {P8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)},
{texts_cte('pt', 'pr', 'r8', 'p8')}
SELECT problem_id, pair_rank FROM pt
WHERE greatest({ntok('problem')} + {ntok('accepted')}, {ntok('problem')} + {ntok('rejected')}) <= {C.MAX_TOKENS}"""
    q["reward_score_linear"] = f"WITH {rewards_cte()} SELECT model, vec_id, round(reward, 6) AS reward FROM rw"
    q["pair_gap"] = f"""WITH {scored_pairs_ctes()}
SELECT model, problem_id, pair_rank, round(r_accepted, 6) AS r_accepted, round(r_rejected, 6) AS r_rejected,
  round(abs(r_accepted - r_rejected), 6) AS gap FROM sp"""
    q["pairwise_accuracy"] = f"""WITH {scored_pairs_ctes()},
a AS (SELECT model, count(*) AS n_pairs,
  CAST(sum(CASE WHEN r_accepted > r_rejected THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
  CAST(sum(CASE WHEN r_accepted = r_rejected THEN 1 ELSE 0 END) AS BIGINT) AS n_ties FROM sp GROUP BY model)
SELECT model, n_pairs, n_correct, n_ties, round(n_correct / n_pairs, 6) AS accuracy FROM a"""
    running = f"""WITH {scored_pairs_ctes()},
o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {skey(C.SEED, 'problem_id', 'pair_rank')},
  problem_id, pair_rank) - 1 AS pos FROM sp),
b AS (SELECT model, pos // {C.EVAL_BATCH} AS batch_id, count(*) AS n,
  sum(CASE WHEN r_accepted > r_rejected THEN 1 ELSE 0 END) AS c FROM o GROUP BY 1, 2),
cum AS (SELECT model, batch_id, CAST(sum(n) OVER w AS BIGINT) AS seen, CAST(sum(c) OVER w AS BIGINT) AS correct,
  max(batch_id) OVER (PARTITION BY model) AS final FROM b WINDOW w AS (PARTITION BY model ORDER BY batch_id))
SELECT model, batch_id, seen, correct, round(correct / seen, 6) AS accuracy FROM cum"""
    q["running_accuracy"] = q["stream_running_accuracy"] = running
    q["running_accuracy_every10"] = running + " WHERE batch_id % 10 = 0 OR batch_id = final"
    q["eval_matrix"] = f"""WITH {scored_pairs_ctes()}
SELECT model, domain, count(*) AS n_pairs, round(avg(CAST(r_accepted > r_rejected AS DOUBLE)), 6) AS accuracy
FROM sp GROUP BY model, domain"""
    q["active_selected"] = (f"WITH {selection_ctes()} SELECT model, problem_id, pair_rank, "
                            f"CAST(select_rank AS INTEGER) AS select_rank, round(gap, 6) AS gap FROM sel")
    q["active_rest"] = f"""WITH {selection_ctes()}
SELECT model, problem_id, pair_rank, round(gap, 6) AS gap FROM win w
WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.model = w.model AND s.problem_id = w.problem_id AND s.pair_rank = w.pair_rank)"""
    q["resume_pending"] = f"""WITH {R8}, {P8}
SELECT problem_id FROM p8 WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id // 8 = p8.problem_id)"""
    q["extract_boxed_last"] = (f"WITH {R8}, {CC} SELECT problem_id, response_idx, "
                               f"{boxed(chr(39) + 'First ' + chr(92) + 'boxed{0} then ' + chr(39) + ' || response', BOX_LAST)} AS core FROM cc")
    cc_spaced = (f"cc AS (SELECT problem_id, response_idx, doc_id, "
                 f"response || ' \\boxed{{' || replace({lst(T.CHOICE_VALUES)}[n_chars % 5 + 1], ',', ', ') || '}}' AS response, "
                 f"{lst(T.CHOICE_VALUES)}[problem_id % 5 + 1] AS answer FROM r8)")
    tr = f"""WITH {R8}, {cc_spaced},
t0 AS (SELECT problem_id, response_idx, {boxed("response")} AS g, answer AS c FROM cc),
t1 AS (SELECT *, {choice_items('g', True)} AS gi, {choice_items('c', True)} AS ci FROM t0)
SELECT problem_id, response_idx, CAST(CASE WHEN (gi IS NULL) <> (ci IS NULL) THEN -1
    WHEN gi IS NOT NULL THEN len(ci) - len(list_filter(ci, lambda x: NOT list_contains(gi, x)))
                         - len(list_filter(gi, lambda x: NOT list_contains(ci, x)))
    WHEN g = c THEN 1 ELSE -1 END AS INTEGER) AS score FROM t1"""
    q["medical_score_trim"] = tr
    partial = code_ctes().replace("ELSE coalesce(CASE WHEN pc.all_ran THEN pc.n_passed ELSE 0 END, 0) END",
                                  "ELSE coalesce(pc.n_passed, 0) END")
    q["code_pass_count_partial"] = f"WITH {partial} SELECT problem_id, response_idx, score FROM ks"
    q["active_rest_keep_unseen"] = f"""WITH {selection_ctes()}
SELECT model, problem_id, pair_rank, round(gap, 6) AS gap FROM win w
WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.model = w.model AND s.problem_id = w.problem_id AND s.pair_rank = w.pair_rank)
UNION ALL
SELECT model, problem_id, pair_rank, round(abs(r_accepted - r_rejected), 6) AS gap FROM pool p
WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.model = p.model AND w.problem_id = p.problem_id AND w.pair_rank = p.pair_rank)"""
    q["eval_batches"] = f"""WITH {scored_pairs_ctes()},
o AS (SELECT model, problem_id, pair_rank, row_number() OVER (PARTITION BY model
  ORDER BY {skey(C.SEED, 'problem_id', 'pair_rank')}, problem_id, pair_rank) - 1 AS pos FROM sp)
SELECT model, problem_id, pair_rank, pos // {C.EVAL_BATCH} AS batch_id FROM o"""
    def cut(x):
        return f"array_to_string(regexp_split_to_array({strip(x)}, '{WS}+')[1:{C.CUT_TOKENS}], ' ')"

    def length_reward(x):
        return f"(len(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))) / (1.0 + sqrt(length({x}))))"

    side = {s: (f"'<|im_start|>user' || {NL} || problem || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || "
                f"{s} || '<|im_end|>' || {NL}") for s in ("accepted", "rejected")}
    single = f"""{R8}, {P8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)}, {texts_cte('pt', 'pr', 'r8', 'p8')},
ct AS (SELECT problem_id, pair_rank, {cut(side['accepted'])} AS ta, {cut(side['rejected'])} AS tr FROM pt),
rs AS (SELECT problem_id, pair_rank, {length_reward('ta')} AS r_accepted, {length_reward('tr')} AS r_rejected FROM ct)"""
    q["single_pair_rewards"] = f"""WITH {single}
SELECT problem_id, pair_rank, round(r_accepted, 6) AS r_accepted, round(r_rejected, 6) AS r_rejected FROM rs"""
    q["evaluation_metrics"] = f"""WITH {single},
o AS (SELECT *, (row_number() OVER (ORDER BY {skey(C.SEED, 'problem_id', 'pair_rank')}, problem_id, pair_rank) - 1)
  // {C.EVAL_BATCH} AS batch_id FROM rs),
b AS (SELECT batch_id, count(*) AS n, count(*) FILTER (r_accepted > r_rejected) AS c FROM o GROUP BY 1),
cum AS (SELECT batch_id, CAST(sum(n) OVER w AS BIGINT) AS seen, CAST(sum(c) OVER w AS BIGINT) AS correct,
  max(batch_id) OVER () AS final FROM b WINDOW w AS (ORDER BY batch_id))
SELECT batch_id, seen, correct, round(correct / seen, 6) AS accuracy FROM cum WHERE batch_id % 10 = 0 OR batch_id = final
UNION ALL SELECT -1, seen, correct, round(correct / seen, 6) FROM cum WHERE batch_id = final"""
    q["render_problems_math"] = f"""WITH {R8}, {P8},
s AS (SELECT problem_id, problem, '\\boxed{{' || {lst(T.MATH_VALUES)}[problem_id % 7 + 1] || '}}' AS solution,
  {lit(pre)} || problem || {lit(post)} AS prompt FROM p8)
SELECT problem_id, problem, solution, prompt, 'user' AS role, prompt AS content FROM s"""
    q["pairwise_gradient"] = f"""WITH {R8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)},
d AS (SELECT unnest(range(1, len(a.embedding) + 1)) AS dim, a.embedding AS ea, r.embedding AS er FROM pr p
  JOIN embeddings a ON a.vec_id = (p.problem_id * 8 + p.accepted_idx) % (SELECT count(*) FROM embeddings)
  JOIN embeddings r ON r.vec_id = (p.problem_id * 8 + p.rejected_idx) % (SELECT count(*) FROM embeddings))
SELECT CAST(dim AS INTEGER) AS dim, 2 * count(*) AS n_rows, count(*) AS n_positive,
  round(sum(CAST(ea[dim] AS DOUBLE) - CAST(er[dim] AS DOUBLE)), 3) AS slope FROM d GROUP BY dim"""
    q["active_round_sizes"] = f"""WITH RECURSIVE {R8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)},
n AS (SELECT count(*) FILTER (NOT held) AS pool, count(*) FILTER (held) AS held FROM (
  SELECT {uniform(str(C.SEED) + ':split', 'problem_id')} < 0.2 AS held FROM pr)),
rounds AS (
  SELECT 0 AS round, greatest(1, pool // {C.SELECT_K}) AS k, pool // {C.SELECT_WINDOW} AS look, pool AS n_rest, held FROM n
  UNION ALL
  SELECT round + 1, k, look, least(look, n_rest) - k, held FROM rounds WHERE round < 3 AND n_rest >= k)
SELECT round, k AS n_train, held AS n_eval, n_rest, 0::BIGINT AS n_shared FROM rounds WHERE round > 0"""
    sft_rows = f"""WITH {R8}, {P8}
SELECT problem_id, response_idx, problem, response AS completion FROM r8 JOIN p8 USING (problem_id)"""
    q["sft_rows"] = q["stream_sft"] = sft_rows
    q["last_line_int"] = f"""WITH {R8} SELECT problem_id, response_idx,
  CASE WHEN n_chars % 45 = 0 THEN CAST(0 AS DECIMAL(38,0)) WHEN n_chars % 45 <= 38
       THEN CAST(repeat('7', CAST(n_chars % 45 AS INTEGER)) AS DECIMAL(38,0)) END AS value FROM r8"""
    q["truncate_tokens"] = f"""WITH {R8} SELECT problem_id, response_idx,
  array_to_string(regexp_extract_all(response, '{NON_WS}+')[1:64], ' ') AS cut FROM r8"""
    q["output_projection"] = f"SELECT problem_id, pair_rank, problem, accepted, rejected FROM ({q['preference_pairs']})"
    q["tables_round_trip"] = f"""WITH {R8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)}
SELECT CASE WHEN {uniform(f'{C.SEED}:split', 'problem_id')} < 0.25 THEN 'train' ELSE 'rest' END AS split,
  problem_id, pair_rank, accepted_idx, rejected_idx FROM pr"""
    q["strict_sample"] = f"""SELECT doc_id, row_number() OVER (ORDER BY {skey(C.SEED, 'doc_id')}, doc_id) AS sample_rank
FROM documents QUALIFY sample_rank <= (SELECT count(*) // 4 FROM documents)"""
    q["stream_preference_pairs"] = q["preference_pairs_math"].replace(
        f"SELECT {pairs_cols}, problem, accepted, rejected FROM pt", f"SELECT {pairs_cols}, i, j, problem, accepted, rejected FROM pt")
    q["error_digest"] = f"""WITH {code_ctes()},
l AS (SELECT problem_id, response_idx, case_idx, string_split(error, {NL}) AS m FROM cr WHERE NOT ok)
SELECT problem_id, response_idx, case_idx, array_to_string([m[1], regexp_extract(m[2], '^[^\"]*\"'), m[3], m[4]], {NL}) AS digest
FROM l"""
    q["generate_completions"] = f"""WITH {ST},
pm AS (SELECT problem_id, {lit(pre)} || problem || {lit(post)} AS prompt FROM st),
fo AS (SELECT problem_id, prompt, unnest(range(0, {C.FAN_OUT})) AS s FROM pm)
SELECT problem_id, CAST(s AS INTEGER) AS response_idx,
  array_to_string(regexp_extract_all(prompt, '{NON_WS}+')[-5:], ' ') || ' ... so the answer is \\boxed{{'
  || CAST((length(prompt) + s) % 7 AS VARCHAR) || '}}' AS response FROM fo"""

    q["code_run_responses"] = f"""WITH {code_ctes()},
run AS (SELECT kx.problem_id, kx.response_idx, length(input) % 7 <> 0
    AND NOT (contains(code, 'subprocess') OR contains(code, 'venv')) AS ok
  FROM kx JOIN cases ON cases.problem_id = kx.problem_id)
SELECT problem_id, response_idx, count(*) AS n_cases, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS n_passed,
  CAST(CASE WHEN bool_and(ok) THEN count(*) ELSE 0 END AS INTEGER) AS score FROM run GROUP BY problem_id, response_idx"""

    def side(x):
        chat = (f"('<|im_start|>user' || {NL} || problem || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || {x}"
                f" || '<|im_end|>' || {NL})")
        return f"round(len(list_distinct(regexp_extract_all({chat}, '{NON_WS}+'))) / (1.0 + sqrt(length({chat}))), 6)"

    q["stream_preference_pairs_merged"] = q["preference_pairs_medical"]
    q["versioned_pairs"] = f"""WITH {R8}, {C8}, {pairs_cte('pr', 'c8', C.MATH_CAP)}
SELECT problem_id, pair_rank, accepted_idx, rejected_idx FROM pr"""
    q["pair_rewards_by_tokens"] = q["reward_model_scores"] = f"""SELECT problem_id, pair_rank, {side('accepted')} AS r_accepted, {side('rejected')} AS r_rejected
FROM ({q['preference_pairs']})"""
    return q


ORACLE_SQL = _sql()
