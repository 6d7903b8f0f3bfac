"""DuckDB SQL equivalents of the catalogue queries (the correctness oracle).

Built from small SQL fragments so that each definition is written once.
Constants are written as doubles (``::DOUBLE``); a bare ``0.5`` is a decimal.
"""

from __future__ import annotations

from prefline.config import (CAP_RANGE, DEFAULT_EOS, GEMMA_ANSWER_END, GEMMA_ANSWER_START,
                             HUMAN_SCORE_DIVISOR, MIN_REVIEW_CHARS, PREFERENCE_SYSTEM_PROMPT,
                             QUERY_SYSTEM_PROMPT, WORD_PATTERN)

WORD_RE = f"'{WORD_PATTERN}'"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def nl(s: str) -> str:
    """SQL expression for a Python string that may contain newlines."""
    parts = s.split("\n")
    out = [q(p) for p in parts]
    return " || chr(10) || ".join(out) if len(parts) > 1 else out[0]


EOS = q(DEFAULT_EOS)
SEP = "': '"
END = "chr(10) || chr(10)"


def words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {WORD_RE})"


def nwords(t: str) -> str:
    return f"len({words(t)})"


def ndistinct(t: str) -> str:
    return f"len(list_distinct({words(t)}))"


def h8(salt: str, key: str) -> str:
    return f"('0x' || substr(md5({q(salt)} || '|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def u(salt: str, key: str) -> str:
    return f"({h8(salt, key)} / 4294967296::DOUBLE)"


def piece(role: str, content: str) -> str:
    return f"({role} || {SEP} || {content} || {END})"


def human_logit(t: str) -> str:
    return f"(CASE WHEN {nwords(t)} > 0 THEN 8::DOUBLE * {ndistinct(t)} / {nwords(t)} - 6::DOUBLE END)"


def capped_raw(t: str) -> str:
    return f"(CASE WHEN {nwords(t)} > 0 THEN length({t}) / (6 * {nwords(t)}) END)"


def helpful(qc: str, t: str) -> str:
    qd = f"list_distinct({words(qc)})"
    td = f"list_distinct({words(t)})"
    return (f"(CASE WHEN len({qd}) > 0 THEN len(list_intersect({qd}, {td}))::DOUBLE "
            f"/ len({qd}) END)")


def scale(x: str, lmin: float, lmax: float, rmin: float, rmax: float) -> str:
    return (f"({float(rmin)!r}::DOUBLE + (({x})::DOUBLE - {float(lmin)!r}::DOUBLE) / "
            f"{float(lmax) - float(lmin)!r}::DOUBLE * {float(rmax) - float(rmin)!r}::DOUBLE)")


def cap(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN isnan({x}) THEN ({x}) ELSE least({x}, 1.0::DOUBLE) END)"


def weighted(hf: str, human: str, w: float = 0.5) -> str:
    return (f"({float(w)!r}::DOUBLE * ({hf}) + {1.0 - float(w)!r}::DOUBLE * "
            f"({1.0 / HUMAN_SCORE_DIVISOR!r}::DOUBLE * ({human})))")


def gmin(a: str, b: str) -> str:
    return (f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL "
            f"WHEN isnan({a}) OR isnan({b}) THEN 'NaN'::DOUBLE ELSE least({a}, {b}) END)")


PER_CONV = """per_conv AS (
  SELECT conv_id,
         arg_min(text, CASE WHEN role = 'user' THEN turn END) AS query,
         arg_min(text, CASE WHEN role = 'assistant' THEN turn END) AS answer
  FROM conversations GROUP BY conv_id)"""

PAIRS = PER_CONV + """,
answered AS (
  SELECT conv_id, query, answer AS chosen,
         coalesce(lead(answer) OVER (ORDER BY conv_id), first_value(answer) OVER (ORDER BY conv_id)) AS rejected
  FROM per_conv WHERE conv_id IS NOT NULL AND answer IS NOT NULL),
pairs AS (SELECT conv_id, query, chosen, rejected FROM answered WHERE query IS NOT NULL),
rollout AS (SELECT conv_id, query, chosen AS response, rejected AS ref_response FROM pairs)"""

SCORED = PAIRS + f""",
scored AS (
  SELECT conv_id, query, response, ref_response,
         {human_logit('response')} AS human, {human_logit('ref_response')} AS ref_human,
         {helpful('query', 'response')} AS helpful, {helpful('query', 'ref_response')} AS ref_helpful
  FROM rollout)"""

VOCAB = f"""wc AS (
  SELECT tok, count(*) AS n FROM (SELECT unnest({words('text')}) AS tok FROM documents) GROUP BY tok),
vocab AS (
  SELECT tok, n, 3 + row_number() OVER (ORDER BY n DESC, tok) AS id
  FROM wc)"""


def prompt_user(system: str | None = None) -> str:
    sys_piece = f"{piece(q('system'), q(system))} || " if system else ""
    return f"{sys_piece}{piece(q('user'), 'query')} || {EOS}"


def queries_cte() -> str:
    return """fq AS (
  SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id)"""


def sql_catalog() -> dict[str, str]:
    w = weighted
    out = {}
    out["q01_project_rename"] = "SELECT doc_id, text AS review FROM documents"
    out["q02_first_query"] = f"WITH {queries_cte()} SELECT conv_id, query FROM fq"
    out["q03_min_chars"] = f"SELECT doc_id, n_chars FROM documents WHERE length(text) > {MIN_REVIEW_CHARS}"
    out["q04_prompt"] = f"WITH {queries_cte()} SELECT conv_id, {prompt_user()} AS prompt FROM fq"
    out["q05_prompt_system"] = (f"WITH {queries_cte()} SELECT conv_id, "
                                f"{prompt_user(QUERY_SYSTEM_PROMPT)} AS prompt FROM fq")
    out["q06_encode_filter"] = (f"SELECT doc_id, {nwords('text')} AS n_tokens FROM documents "
                                f"WHERE {nwords('text')} <= 300")
    def padded(text: str, end: str, limit: int = 125) -> str:
        """Ids of the words of ``text`` and the ids ``end``, left-padded to the limit."""
        return f"""WITH {VOCAB}, {queries_cte()},
qw AS (SELECT conv_id, {words(text)} AS w FROM fq),
toks AS (SELECT conv_id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS tok FROM qw),
enc AS (SELECT t.conv_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids
        FROM toks t LEFT JOIN vocab v ON t.tok = v.tok GROUP BY t.conv_id),
full_ids AS (SELECT qw.conv_id, list_concat(coalesce(enc.ids, []), {end}) AS ids
             FROM qw LEFT JOIN enc ON qw.conv_id = enc.conv_id WHERE qw.w IS NOT NULL),
sized AS (SELECT conv_id, ids, len(ids) AS n FROM full_ids)
SELECT conv_id,
       array_to_string(list_concat(list_transform(range({limit} - n), lambda x: 0), ids), ',') AS ids,
       array_to_string(list_concat(list_transform(range({limit} - n), lambda x: 0),
                                   list_transform(range(n), lambda x: 1)), ',') AS mask,
       n AS n_tokens
FROM sized WHERE n <= {limit}"""
    out["q07_pad_mask"] = padded("query", "[]")
    bare = piece(q("user"), "query")
    out["q36_prompt_dataset"] = padded(bare, "[3]")
    out["q37_prompt_dataset_system"] = padded(f"({piece(q('system'), q(QUERY_SYSTEM_PROMPT))} || {bare})", "[3]")
    out["q35_encode_documents"] = f"""WITH {VOCAB},
toks AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS tok
         FROM (SELECT doc_id, {words('text')} AS w FROM documents)),
enc AS (SELECT t.doc_id, count(*) AS n, string_agg(CAST(v.id AS VARCHAR), ',' ORDER BY t.pos) AS ids
        FROM toks t JOIN vocab v ON t.tok = v.tok GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(enc.n, 0) AS n_tokens, md5(coalesce(enc.ids, '')) AS ids_md5
FROM documents d LEFT JOIN enc ON d.doc_id = enc.doc_id"""
    out["q08_random_prefix"] = f"""WITH d AS (SELECT doc_id, 2 + ({h8('prefix', 'doc_id')} % 6) AS k, {words('text')} AS w
      FROM documents WHERE length(text) > {MIN_REVIEW_CHARS})
SELECT doc_id, k, array_to_string(list_slice(w, 1, k), ' ') AS query FROM d"""
    out["q23_word_count"] = f"SELECT doc_id, len(regexp_extract_all(text, {WORD_RE})) AS n_words FROM documents"
    out["q24_net_length"] = f"""WITH {PAIRS}
SELECT conv_id, {nwords('response')} - {nwords('query')} AS net_words FROM rollout"""
    out["q30_vocab"] = f"WITH {VOCAB} SELECT tok, n, id FROM vocab"
    def flat(prompt_sys: str | None, fam: str) -> str:
        if fam == "mistral":
            ans = lambda c: f"{c} || {EOS}"
        elif fam == "gemma":
            ans = lambda c: f"{nl(GEMMA_ANSWER_START)} || {c} || {nl(GEMMA_ANSWER_END)}"
        else:
            ans = lambda c: f"{piece(q('assistant'), c)} || {EOS}"
        return f"""WITH {PAIRS}
SELECT conv_id, {prompt_user(prompt_sys)} AS prompt, {ans('chosen')} AS chosen, {ans('rejected')} AS rejected
FROM pairs"""
    out["q09_pref_mistral"] = flat(None, "mistral")
    out["q10_pref_gemma"] = flat(PREFERENCE_SYSTEM_PROMPT, "gemma")
    out["q11_pref_default"] = flat(None, "default")
    render = (f"coalesce(array_to_string(list_transform({{m}}, lambda x: x.role || {SEP} || x.content || {END}), ''), '')"
              f" || {EOS}")
    out["q12_pref_messages"] = f"""WITH msgs AS (
  SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS m
  FROM conversations GROUP BY conv_id),
mp AS (
  SELECT conv_id, m AS chosen,
         coalesce(lead(m) OVER (ORDER BY conv_id), first_value(m) OVER (ORDER BY conv_id)) AS rejected
  FROM msgs WHERE conv_id IS NOT NULL)
SELECT conv_id, {render.format(m='list_slice(chosen, 1, len(chosen) - 1)')} AS prompt,
       {render.format(m='[chosen[len(chosen)]]')} AS chosen,
       {render.format(m='[rejected[len(rejected)]]')} AS rejected
FROM mp"""
    ranked = f"""WITH {PAIRS},
r AS (SELECT conv_id, count(*) OVER () AS n,
             row_number() OVER (ORDER BY md5('42|' || CAST(conv_id AS VARCHAR)), conv_id) AS r1,
             row_number() OVER (ORDER BY md5('43|' || CAST(conv_id AS VARCHAR)), conv_id) AS r2
      FROM pairs),
f AS (SELECT conv_id, r1 <= CAST(floor(0.8::DOUBLE * n) AS BIGINT) AS in_train,
             r2 <= n - CAST(floor(0.8::DOUBLE * n) AS BIGINT) AS in_eval2 FROM r)"""
    out["q13_split"] = ranked + """
SELECT conv_id, CASE WHEN in_train THEN 'train' ELSE 'eval' END AS part FROM f"""
    out["q14_split_independent"] = ranked + """
SELECT conv_id, 'train' AS part FROM f WHERE in_train
UNION ALL SELECT conv_id, 'eval' AS part FROM f WHERE in_eval2"""
    out["q28_split_leak"] = ranked + """
SELECT 'disjoint' AS mode, sum(CASE WHEN NOT in_train THEN 1 ELSE 0 END)::BIGINT AS n_eval, 0::BIGINT AS n_leak FROM f
UNION ALL
SELECT 'independent' AS mode, sum(CASE WHEN in_eval2 THEN 1 ELSE 0 END)::BIGINT AS n_eval,
       sum(CASE WHEN in_eval2 AND in_train THEN 1 ELSE 0 END)::BIGINT AS n_leak FROM f"""
    from prefline.plans.catalog import SCALE_RANGES
    out["q15_scale"] = f"WITH {PAIRS}\n" + "\nUNION ALL\n".join(
        f"SELECT conv_id, {q(name)} AS rng, {scale(human_logit('response'), *b)} AS scaled FROM rollout"
        for name, *b in SCALE_RANGES)
    out["q16_capped"] = f"""WITH {PAIRS}
SELECT conv_id, {scale(cap(capped_raw('response')), *CAP_RANGE)} AS human,
       {scale(cap(capped_raw('ref_response')), *CAP_RANGE)} AS ref_human FROM rollout"""
    out["q17_human_label"] = f"WITH {SCORED} SELECT conv_id, human, ref_human FROM scored"
    out["q18_pair_score"] = f"WITH {SCORED} SELECT conv_id, helpful, ref_helpful FROM scored"
    out["q19_reward_min"] = f"""WITH {SCORED}
SELECT conv_id, {gmin('human', 'helpful')} AS reward, {gmin('ref_human', 'ref_helpful')} AS ref_reward FROM scored"""
    out["q21_reward_single"] = f"""WITH {SCORED}
SELECT conv_id, 'human_only' AS mode, human AS reward, ref_human AS ref_reward FROM scored
UNION ALL
SELECT conv_id, 'normal_training' AS mode, helpful AS reward, ref_helpful AS ref_reward FROM scored"""
    out["q22_reward_log"] = f"""WITH {SCORED}
SELECT conv_id, query, response, ref_response, {w('ref_helpful', 'ref_human')} AS ref_rewards FROM scored"""
    trials = f"""trials AS (
  SELECT range AS trial,
         1e-07::DOUBLE + {u('lr', 'range')} * (1e-05::DOUBLE - 1e-07::DOUBLE) AS lr,
         0.3::DOUBLE + {u('beta', 'range')} * (0.7::DOUBLE - 0.3::DOUBLE) AS beta,
         0.0::DOUBLE + {u('smooth', 'range')} * (0.5::DOUBLE - 0.0::DOUBLE) AS smoothing,
         CAST(130 + {h8('warmup', 'range')} % 101 AS INTEGER) AS warmup,
         CAST(1 + {h8('mb', 'range')} % 4 AS INTEGER) AS mini_batch,
         CAST(1 + {h8('ga', 'range')} % 4 AS INTEGER) AS accum,
         ['sigmoid', 'hinge', 'ipo', 'robust'][1 + {h8('loss', 'range')} % 4] AS loss_type
  FROM range(10))"""
    out["q25_trials"] = f"""WITH {PAIRS}, {trials},
sched AS (SELECT *, ((SELECT count(*) FROM pairs) + mini_batch * accum - 1) // (mini_batch * accum) AS steps
          FROM trials)
SELECT *, CASE WHEN steps >= 1 THEN 1 + steps // 10 ELSE 0 END AS log_steps FROM sched"""
    sp = lambda z: f"(greatest({z}, 0::DOUBLE) + ln(1::DOUBLE + exp(-abs({z}))))"
    bx = "(t.beta * p.x)"
    e = "t.smoothing"
    losses = f"""WITH {PAIRS}, {trials},
px AS (SELECT conv_id, {human_logit('chosen')} - {human_logit('rejected')} AS x FROM pairs),
tl AS (
  SELECT t.trial,
         CASE t.loss_type
           WHEN 'sigmoid' THEN (1::DOUBLE - {e}) * {sp('-' + bx)} + {e} * {sp(bx)}
           WHEN 'hinge' THEN greatest(0::DOUBLE, 1::DOUBLE - {bx})
           WHEN 'ipo' THEN (p.x - 1::DOUBLE / (2::DOUBLE * t.beta)) * (p.x - 1::DOUBLE / (2::DOUBLE * t.beta))
           WHEN 'robust' THEN CASE WHEN {e} <> 0.5::DOUBLE THEN
             ((1::DOUBLE - {e}) * {sp('-' + bx)} - {e} * {sp(bx)}) / (1::DOUBLE - 2::DOUBLE * {e}) END
         END AS loss,
         {bx} AS margin
  FROM trials t, px p WHERE p.x IS NOT NULL),
agg AS (SELECT trial, round(avg(loss), 9) AS loss, round(avg(margin), 9) AS margin FROM tl GROUP BY trial)"""
    out["q26_trial_loss"] = losses + "\nSELECT trial, loss, margin FROM agg"
    out["q27_best_trials"] = losses + "\nSELECT trial, loss FROM agg WHERE loss IS NOT NULL ORDER BY loss, trial LIMIT 3"
    out["q29_quarantine"] = f"""SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN 'null_text'
       WHEN len(regexp_extract_all(d.text, {WORD_RE})) < 2 THEN 'too_short'
       WHEN l.doc_id IS NULL THEN 'missing_label' END AS reason
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
WHERE d.text IS NULL OR len(regexp_extract_all(d.text, {WORD_RE})) < 2 OR l.doc_id IS NULL"""
    out["q31_generate"] = f"""WITH {queries_cte()}
SELECT conv_id, array_to_string(list_reverse({words('query')}), ' ') AS response,
       array_to_string({words('query')}, ' ') AS ref_response FROM fq"""
    gen = f"""WITH {queries_cte()},
g AS (SELECT conv_id, query,
             array_to_string(list_reverse({words('query')}), ' ') AS response,
             array_to_string({words('query')}, ' ') AS ref_response FROM fq),
s AS (SELECT conv_id, response, ref_response,
             {human_logit('response')} AS human, {human_logit('ref_response')} AS ref_human,
             {helpful('query', 'response')} AS helpful, {helpful('query', 'ref_response')} AS ref_helpful FROM g)"""
    out["q34_rollout_reward"] = gen + f"""
SELECT conv_id, response, ref_response, {w('helpful', 'human')} AS reward,
       {w('ref_helpful', 'ref_human')} AS ref_reward FROM s"""
    out["q33_stream_score"] = (f"SELECT conv_id, turn, {human_logit('text')} AS score "
                               f"FROM conversations WHERE role = 'assistant'")
    out["q20_reward_weighted"] = f"""WITH {SCORED}
SELECT conv_id, {w('helpful', 'human')} AS reward, {w('ref_helpful', 'ref_human')} AS ref_reward,
       {w('helpful', 'human')} - {w('ref_helpful', 'ref_human')} AS margin
FROM scored"""
    messages = """m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations)"""
    white = q("".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])))
    out["q38_chat_templates"] = f"""WITH {messages},
r AS (
  SELECT conv_id, pos, 'fallback' AS template, role || ': ' || text || chr(10) || chr(10) AS piece FROM m
  UNION ALL SELECT conv_id, pos, 'im_marks', '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) FROM m
  UNION ALL SELECT conv_id, pos, 'turn_marks',
    CASE WHEN pos = 1 AND role = 'system' THEN trim(text, {white}) || chr(10) || chr(10)
         ELSE '<start_of_turn>' || (CASE WHEN role = 'assistant' THEN 'model' ELSE role END) || chr(10) || trim(text, {white}) || '<end_of_turn>' || chr(10) END
  FROM m),
j AS (SELECT conv_id, template, string_agg(piece, '' ORDER BY pos) AS body FROM r GROUP BY ALL)
SELECT conv_id, template, CASE template WHEN 'fallback' THEN body || '</s>' WHEN 'im_marks' THEN body || '<|im_start|>assistant' || chr(10)
  ELSE '<bos>' || body || '<start_of_turn>model' || chr(10) END AS rendered FROM j"""
    held = f"({h8('bayes', 'doc_id')} % 5 = 0)"
    out["q39_bayes_scorer"] = f"""WITH l AS (
  SELECT doc_id, text, quality AS y FROM documents JOIN labels USING (doc_id) WHERE NOT {held} AND quality IN (0, 1) AND text IS NOT NULL),
c AS (SELECT tok, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM (SELECT y, unnest({words('text')}) AS tok FROM l) GROUP BY tok),
t AS (SELECT count(*) AS v, sum(n1) AS n1, sum(n0) AS n0 FROM c),
k AS (SELECT tok, round(ln(((c.n1 + 1)::DOUBLE * (t.n0 + t.v)::DOUBLE) / ((c.n0 + 1)::DOUBLE * (t.n1 + t.v)::DOUBLE)) * 1000000)::BIGINT AS weight FROM c, t),
p AS (SELECT round(ln((count(*) FILTER (y = 1) + 1)::DOUBLE / (count(*) FILTER (y = 0) + 1)::DOUBLE) * 1000000)::BIGINT AS prior FROM l),
s AS (SELECT doc_id, sum(weight)::BIGINT AS s FROM (SELECT doc_id, unnest({words('text')}) AS tok FROM documents) JOIN k USING (tok) GROUP BY doc_id),
f AS (SELECT doc_id, {held} AS held_out, prior + coalesce(s, 0) AS score FROM documents LEFT JOIN s USING (doc_id), p)
SELECT doc_id, held_out, score, (score > 0)::INTEGER AS predicted FROM f"""
    plain = padded(bare, "[3]").replace("FROM sized WHERE n <= 125", "")
    out["q40_length_batches"] = plain[:plain.index("SELECT conv_id,\n       array_to_string")] + f""",
placed AS (SELECT *, (row_number() OVER (ORDER BY n, {h8('batch', 'conv_id')}, conv_id) - 1) // 16 AS batch FROM sized WHERE n <= 125),
longest AS (SELECT *, max(n) OVER (PARTITION BY batch) AS batch_length FROM placed)
SELECT conv_id, array_to_string(list_concat(list_transform(range(batch_length - n), lambda x: 0), ids), ',') AS ids,
       array_to_string(list_concat(list_transform(range(batch_length - n), lambda x: 0), list_transform(range(n), lambda x: 1)), ',') AS mask,
       n AS n_tokens, batch, batch_length FROM longest"""
    out["q41_step_log"] = f"""WITH s AS (
  SELECT conv_id, turn, {human_logit('text')} AS score FROM conversations WHERE role = 'assistant'),
n AS (SELECT *, (row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, score NULLS FIRST) - 1) // 4 + 1 AS step FROM s)
SELECT conv_id, turn, score, step FROM n WHERE step = 1 OR step % 10 = 0"""
    out["q42_nested_queries"] = """WITH m AS (
  SELECT conv_id, list(struct_pack(i := text) ORDER BY turn, text) FILTER (role = 'user') AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, l[1].i AS query, CASE WHEN l IS NULL THEN 'empty_list' WHEN l[1].i IS NULL THEN 'no_input' END AS reason FROM m"""
    out["q43_split_repeated"] = """WITH g AS (SELECT lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY lang),
r AS (SELECT lang, c, coalesce(sum(c) OVER (ORDER BY md5('42|' || lang), lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CAST(floor(0.55::DOUBLE * sum(c) OVER ()) AS BIGINT) AS k FROM g),
i AS (SELECT lang, c, greatest(0, least(c, k - before))::BIGINT AS inside FROM r)
SELECT lang, 'train' AS part, inside AS n FROM i WHERE inside > 0
UNION ALL SELECT lang, 'eval' AS part, c - inside AS n FROM i WHERE inside < c"""
    cut = f"list_slice({words('text')}, 1, 512)"
    logit = lambda w: f"CASE WHEN len({w}) > 0 THEN 8::DOUBLE * len(list_distinct({w})) / len({w}) - 6::DOUBLE END"
    out["q46_budget_scores"] = f"""SELECT doc_id, NULL::INTEGER AS max_tokens, {logit(words('text'))} AS score FROM documents
UNION ALL SELECT doc_id, 512 AS max_tokens, {logit(cut)} AS score FROM documents"""
    out["q47_tensor_rows"] = plain[:plain.index("SELECT conv_id,\n       array_to_string")] + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS row FROM sized WHERE n <= 125),
whole AS (SELECT row, conv_id, list_concat(list_transform(range(125 - n), lambda x: 3), ids) AS ids,
                 list_concat(list_transform(range(125 - n), lambda x: 0), list_transform(range(n), lambda x: 1)) AS mask FROM numbered)
SELECT row, conv_id, unnest(range(125))::INTEGER AS pos, unnest(ids)::INTEGER AS id, unnest(mask)::INTEGER AS mask FROM whole"""
    return out


# Queries whose doubles are compared after rounding to this many digits.
ROUNDED = {"q26_trial_loss": 9, "q27_best_trials": 9}
