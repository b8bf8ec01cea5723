"""DuckDB SQL for the catalogue's queries, written apart from the Spark expressions."""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}

_CLEAN = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _pieces(listed: str) -> str:
    return f"list_filter(list_transform({listed}, lambda x: {_CLEAN.format(x='x')}), lambda x: x <> '')"


def segments(source: str, keys: str, text: str) -> str:
    """CTEs that end in ``seg(keys, steps)``: lines, numbers, connectors or sentences; packed; merged."""
    return rf"""
raw AS (SELECT {keys}, regexp_replace({text}, '^\s+|\s+$', '', 'g') AS t FROM {source}),
cut AS (SELECT {keys}, t,
  {_pieces("string_split(t, chr(10))")} AS l,
  {_pieces(r"string_split(regexp_replace(regexp_replace(t, '(?i)(^|\s)(step\s*\d+[:.)-])', chr(1) || '\1\2', 'g'), '(^|\s)(\d+[:.)-]|\(\d+\))', chr(1) || '\1\2', 'g'), chr(1))")} AS n,
  {_pieces(r"string_split(regexp_replace(t, '(?i)\b(Therefore|Thus|So|Hence|Then|Next)\b', '@@@\1', 'g'), '@@@')")} AS c,
  {_pieces(r"string_split(regexp_replace(t, '([.。;；])\s+', '\1' || chr(1), 'g'), chr(1))")} AS s
  FROM raw),
cand AS (SELECT {keys}, CASE WHEN len(l) >= 2 THEN l WHEN len(n) >= 2 THEN n WHEN len(c) >= 2 THEN c ELSE s END AS p FROM cut),
packed AS (SELECT {keys}, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 500 THEN [x] ELSE
    list_transform([list_reduce(list_transform(list_filter(string_split(regexp_replace(x, '([.。;；])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> ''), lambda y: {{'d': []::VARCHAR[], 'o': y}}),
      lambda a, b: CASE WHEN length(a.o) + 1 + length(b.o) <= 500 THEN {{'d': a.d, 'o': a.o || ' ' || b.o}} ELSE {{'d': list_append(a.d, a.o), 'o': b.o}} END)],
      lambda r: list_append(r.d, r.o))[1] END)) AS p FROM cand),
fold AS (SELECT {keys}, p, CASE WHEN len(p) > 0 THEN list_reduce(list_transform(p, lambda x: {{'d': []::VARCHAR[], 'o': x}}),
    lambda a, b: CASE WHEN length(a.o) < 8 THEN {{'d': a.d, 'o': a.o || ' ' || b.o}} ELSE {{'d': list_append(a.d, a.o), 'o': b.o}} END) END AS r FROM packed),
seg AS (SELECT {keys}, CASE WHEN len(p) = 0 THEN []::VARCHAR[]
    WHEN len(r.d) > 0 AND length(r.o) < 8 THEN list_append(r.d[1:len(r.d) - 1], r.d[len(r.d)] || ' ' || r.o)
    ELSE list_append(r.d, r.o) END AS steps FROM fold)"""


_TURNS = "(SELECT * FROM conversations WHERE role = 'assistant') c"
_SEG = segments(_TURNS, "conv_id, turn", "text")

ORACLES["flagship_step_weights"] = f"""WITH {_SEG},
w AS (SELECT CAST((conv_id + turn) % len(steps) AS INT) AS m, len(steps) AS n FROM seg WHERE len(steps) > 0),
e AS (SELECT m, unnest(range(n)) AS k FROM w)
SELECT CAST(k AS INT) AS step_idx, count(*) AS n, round(sum(CASE WHEN k < m THEN 0.0 ELSE pow(0.25, k - m) END), 6) AS sum_weight FROM e GROUP BY k"""
ORACLES["segment_documents"] = f"WITH {segments('documents', 'doc_id', 'text')} SELECT doc_id, CAST(len(steps) AS INT) AS n_steps, md5(array_to_string(steps, '|')) AS steps_md5 FROM seg"
ORACLES["segment_conversations"] = f"WITH {_SEG} SELECT conv_id, turn, CAST(len(steps) AS INT) AS n_steps, md5(array_to_string(steps, '|')) AS steps_md5 FROM seg"
ORACLES["step_count_dist"] = f"WITH {_SEG} SELECT CAST(len(steps) AS INT) AS n_steps, count(*) AS n FROM seg GROUP BY 1"
ORACLES["step_length_stats"] = f"WITH {_SEG}, u AS (SELECT unnest(steps) AS s FROM seg) SELECT count(*) AS n_steps, CAST(min(length(s)) AS INT) AS shortest, CAST(max(length(s)) AS INT) AS longest, round(avg(length(s)), 6) AS mean_chars FROM u"
ORACLES["reasoning_length"] = r"SELECT role, round(avg(len(regexp_extract_all(text, '\S+'))), 6) AS mean_tokens, count(*) AS n FROM conversations GROUP BY role"


def _literal_steps(*parts: str) -> str:
    listed = ", ".join(parts)
    return f"SELECT c_custkey AS idx, {len(parts)} AS n_steps, array_to_string([{listed}], '|') AS steps FROM customer"


ORACLES["segment_numbered"] = _literal_steps("'1. Take ' || c_custkey || ' and add'", "'2. Step 2: double it to get more'", "'(3) check that ' || c_custkey || ' is right'")
ORACLES["segment_connectors"] = _literal_steps("'We have ' || c_custkey || ' items'", "'so we count them.'", "'Then we add more,'", "'hence the total grows'")
ORACLES["segment_sentences"] = _literal_steps("'There are ' || c_custkey || ' items.'", "'Ok. Nine more arrive;'", "'all of them stay. End'")

# Answers

_ANSWERS = """a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS q, l_partkey % 9 + 1 AS d,
  CASE l_linenumber % 6 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_quantity AS INT) || '/' || (l_partkey % 9 + 1)
    WHEN 2 THEN CAST(l_quantity AS INT) || '.50' WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 4 THEN 'none at all' END AS x FROM lineitem)"""
ORACLES["answer_extraction"] = f"WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, l_partkey, q, x AS extracted, x AS normalised FROM a"
ORACLES["answer_verification"] = f"""WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, l_partkey, q,
  CASE l_linenumber % 6 WHEN 0 THEN l_partkey = q WHEN 1 THEN abs(q / d - round(q / d, 6)) <= 1e-4 WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS correct FROM a"""
ORACLES["page_numbers"] = r"SELECT page_id, regexp_extract_all(html, '[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:/\d+(?:,\d{3})*)?')[-1] AS extracted FROM pages"

# Generators


def _toy(source: str, key: str) -> str:
    return f"""SELECT {key} AS idx, 'A box has ' || ({key} + 12) || ' packs. Each pack contains ' || ({key} % 7 + 3) || ' pencils. Then ' || ({key} % 5 + 2) || ' more pencils are added. How many pencils are there in total?' AS question,
  '#### ' || (({key} + 12) * ({key} % 7 + 3) + {key} % 5 + 2) AS answer FROM {source}"""


_FEW = f"q AS ({_toy('customer', 'c_custkey')})"
ORACLES["toy_questions"] = _toy("orders", "o_orderkey")
ORACLES["head_questions"] = _toy("orders", "o_orderkey") + " ORDER BY o_orderkey LIMIT 100"
ORACLES["placeholder_pairs"] = f"WITH {_FEW} SELECT idx, 'Question: ' || question || chr(10) || 'Answer step by step.' AS prompt, answer AS chosen, answer AS rejected, answer FROM q"
ORACLES["pair_records"] = f"WITH {_FEW} SELECT 'Question: ' || question || chr(10) || 'Answer step by step.' AS prompt, answer AS chosen, answer AS rejected, answer, 0 AS n_metadata FROM q"


# First error, numbers, question and steps of each template.  w is 0 in chosen traces and 1 in rejected ones.
_TRACES = {
    "inventory": (
        1,
        "3 + seed % 5 AS a, 4 + seed % 7 AS b, 5 + seed % 6 AS c, (seed % 4 + 1) * (3 + seed % 5) AS d, 10 + seed % 13 AS e, a * b * c + w * b AS f, f - d + e AS z",
        ("A store has {} shelves with {} boxes on each shelf. Each box contains {} markers. During the morning, {} markers are sold, and later {} new markers are added. How many markers are in the store now?", "a, b, c, d, e"),
        ("There are {} * {} = {} boxes.", "a, b, a * b"),
        ("The boxes contain {} * {} = {} markers.", "a * b, c, f"),
        ("After selling {} and adding {}, the total is {} - {} + {} = {}.", "d, e, f, d, e, z"),
    ),
    "tickets": (
        1,
        "12 + seed % 11 AS a, 8 + seed % 9 AS b, 9 + seed % 8 AS c, 4 + seed % 5 AS d, 15 + (seed % 6) * 5 AS e, 18 + seed % 17 AS f, b * (d + w) AS g, a * c + g AS h, h - e + f AS z",
        ("A group buys {} adult tickets at ${} each and {} child tickets at ${} each. They use a ${} coupon, then spend ${} on snacks. How many dollars do they spend in total?", "a, c, b, d, e, f"),
        ("The adult tickets cost {} * {} = {} dollars.", "a, c, a * c"),
        ("The child tickets cost {} * {} = {} dollars.", "b, d, g"),
        ("Before the coupon and snacks, the subtotal is {} + {} = {} dollars.", "a * c, g, h"),
        ("After the ${} coupon and ${} snacks, the total is {} - {} + {} = {}.", "e, f, h, e, f, z"),
    ),
    "garden": (
        1,
        "5 + seed % 8 AS a, 7 + seed % 9 AS b, 3 + seed % 5 AS c, 4 + seed % 6 AS d, 6 + seed % 11 AS e, c * (d + w) AS f, a * b + f - e AS z",
        ("A garden starts with {} rows of flowers and {} flowers in each row. For {} days, {} more flowers are planted each day. Then {} flowers wilt. How many flowers are left?", "a, b, c, d, e"),
        ("The garden starts with {} * {} = {} flowers.", "a, b, a * b"),
        ("The new planting adds {} * {} = {} flowers.", "c, d, f"),
        ("After {} flowers wilt, the total is {} + {} - {} = {}.", "e, a * b, f, e, z"),
    ),
    "classroom": (
        1,
        "18 + seed % 13 AS a, 6 + seed % 8 AS b, 3 + seed % 5 AS c, 9 + seed % 7 AS d, 20 + seed % 21 AS e, (c + w) * d AS f, a * b + f - e AS z",
        ("A teacher prints {} pages for each of {} students. She also prints {} extra packets with {} pages each. If {} pages are recycled, how many printed pages remain?", "b, a, c, d, e"),
        ("The student pages total {} * {} = {}.", "a, b, a * b"),
        ("The extra packets total {} * {} = {} pages.", "c, d, f"),
        ("After recycling {} pages, {} + {} - {} = {} pages remain.", "e, a * b, f, e, z"),
    ),
    "recipe": (
        0,
        "4 + seed % 7 AS a, 3 + seed % 5 AS b, 12 + seed % 9 AS c, 5 + seed % 6 AS d, (a + w) * b AS f, f + c - d AS z",
        ("A bakery uses {} cups of flour for each batch of muffins and makes {} batches. It also buys {} more cups of flour, but uses {} cups for bread. How many cups of flour are accounted for by muffins and remaining added flour?", "b, a, c, d"),
        ("The muffins use {} * {} = {} cups of flour.", "a, b, f"),
        ("The remaining added flour is {} - {} = {} cups.", "c, d, c - d"),
        ("Together that is {} + {} = {} cups.", "f, c - d, z"),
    ),
    "shipping": (
        1,
        "6 + seed % 8 AS a, 11 + seed % 10 AS b, 1 + seed % 3 AS c, 2 + seed % 4 AS d, 15 + seed % 12 AS e, c * (d + w) AS f, a * b - f + e AS z",
        ("A warehouse packs {} crates with {} items in each crate. In {} crates, {} items are damaged in each. Then {} replacement items arrive. How many usable items are there?", "a, b, c, d, e"),
        ("The warehouse starts with {} * {} = {} items.", "a, b, a * b"),
        ("The damaged items total {} * {} = {}.", "c, d, f"),
        ("After replacements, there are {} - {} + {} = {} usable items.", "a * b, f, e, z"),
    ),
}
_TAIL = "chr(10) || 'Answer step by step and end with ''#### <answer>''.'"


def _trace(i: int, name: str) -> str:
    m, numbers, *texts = _TRACES[name]
    question, *steps = [f"format('{text}', {args})" for text, args in (*texts, ("#### {}", "z"))]
    side = lambda w: re.sub(r"\bw\b", str(w), numbers)
    right = f"(SELECT idx, seed, {side(0)} FROM seeds WHERE seed % 6 = {i})"
    asked = f"(SELECT idx, seed, {question} AS question, [{', '.join(steps)}] AS chosen_steps FROM {right})"
    return f"SELECT idx, 'Question: ' || question || {_TAIL} AS prompt, chosen_steps, [{', '.join(steps)}] AS rejected_steps, {m} AS m, '{name}' AS template FROM (SELECT idx, question, chosen_steps, {side(1)} FROM {asked})"


def pairs(source: str = "orders", key: str = "o_orderkey") -> str:
    """Both traces of a seed from one row, without a join."""
    traces = " UNION ALL ".join(_trace(i, name) for i, name in enumerate(_TRACES))
    return f"seeds AS (SELECT {key} AS idx, {key} AS seed FROM {source}), pairs AS ({traces})"


_PAIRS, _FEW_PAIRS = pairs(), pairs("customer", "c_custkey")
ORACLES["template_eval"] = f"WITH {_PAIRS} SELECT idx, prompt, chosen_steps[len(chosen_steps)] AS answer, template FROM pairs"
ORACLES["template_pairs"] = f"WITH {_PAIRS} SELECT idx, prompt, array_to_string(chosen_steps, chr(10)) AS chosen, array_to_string(rejected_steps, chr(10)) AS rejected, chosen_steps[len(chosen_steps)] AS answer, m AS first_error_step, template FROM pairs"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The wording of prompts.
_WORDING = {
    "eval": "\n\nSolve the problem. Show the calculation briefly and end with exactly one line: #### <answer>",
    "numbered": "\nAnswer with 3 to 6 numbered steps. Make each step short and include any arithmetic explicitly. End with a final line in the form '#### <answer>'.",
    "chosen": "Solve the problem correctly. End with the exact final answer marker.\n\nQuestion: ",
    "rejected": "Write a plausible step-by-step solution, but make exactly one arithmetic mistake in the middle so the final answer is wrong. Do not mention that it is intentionally wrong. End with '#### <wrong answer>'.\n\nQuestion: ",
    "continue": "\n\nA partial solution is given below. Continue it naturally to the final answer. End with '#### <answer>'.\n\nPartial solution:\n",
    "judge": "You are checking a rejected math solution against the gold answer.\n\nQuestion and instruction:\n",
    "gold": "\n\nGold solution / answer:\n",
    "steps": "\n\nRejected solution steps, indexed from 0:\n",
    "ask": """

Find the first step where the rejected solution becomes mathematically or logically wrong.
If all reasoning steps are correct but the solution is incomplete or missing the final answer, choose the final listed step.
If a step is merely verbose but still correct, do not mark it wrong.

Return only one JSON object with this exact schema:
{"first_error_step": <integer index>, "confidence": <number from 0 to 1>, "rationale": "<short reason>"}
""",
}
_W = {k: _q(v) for k, v in _WORDING.items()}
ORACLES["prompt_forms"] = f"""WITH {_FEW}, p AS (SELECT *, 'Question: ' || question AS p FROM q)
SELECT idx, p || {_W['eval']} AS eval, p || chr(10) || '#### ?' AS marked, p || {_W['numbered']} AS numbered,
  {_W['chosen']} || question || chr(10) || 'Gold final answer: ' || answer AS chosen,
  {_W['rejected']} || question || chr(10) || 'The correct final answer is ' || answer || ', but your final answer must be different.' AS rejected,
  p || chr(10) || 'one' || chr(10) || 'Continue the solution.' AS rollout,
  p || {_W['continue']} || 'one ' || chr(10) || 'two' AS rollout_api,
  {_W['judge']} || p || {_W['gold']} || answer || {_W['steps']} || '0. one ' || chr(10) || '1. two' || {_W['ask']} AS judge FROM p"""
ORACLES["repair_elicited"] = f"""WITH {_FEW} SELECT idx, CASE WHEN idx % 3 = 0 THEN 'There are ' || (idx + 12) || ' packs. Compute directly. ' || answer ELSE 'thus ' || answer END AS chosen,
  'so #### 1' AS rejected FROM q WHERE idx % 5 <> 0"""

# Errors and weights

ORACLES["arithmetic_errors"] = f"WITH {_PAIRS} SELECT idx, m AS rejected_error, CASE template WHEN 'inventory' THEN 2 WHEN 'tickets' THEN 3 WHEN 'shipping' THEN 2 END AS chosen_error FROM pairs"
ORACLES["toy_arithmetic_errors"] = "SELECT c_custkey AS idx, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS error FROM customer"


def _listed(w: str, n: str = "len(rejected_steps)", digits: int = 6) -> str:
    return f"array_to_string(list_transform(range({n}), lambda k: printf('%.{digits}f', CAST({w} AS DOUBLE))), ',')"


_DECAY = "CASE WHEN k < {m} THEN 0.0 ELSE pow({g}, k - {m}) END"
ORACLES["weight_variants"] = f"""WITH {_PAIRS}, v AS (SELECT unnest(['vanilla', 'uniform_downweight', 'prefix_masked', 'first_error_only', 'decayed']) AS weight_variant)
SELECT idx, weight_variant, {_listed("CASE weight_variant WHEN 'vanilla' THEN 1.0 WHEN 'uniform_downweight' THEN 0.25 WHEN 'prefix_masked' THEN (CASE WHEN k < m THEN 0.0 ELSE 1.0 END) WHEN 'first_error_only' THEN (CASE WHEN k = m THEN 1.0 ELSE 0.0 END) ELSE (CASE WHEN k < m THEN 0.0 ELSE pow(0.5, k - m) END) END", digits=4)} AS weights
FROM pairs, v"""
ORACLES["decayed_weights"] = f"""WITH {_PAIRS}, x AS (SELECT idx, len(rejected_steps) AS n, m + CAST(idx % 7 AS INT) - 2 AS e, greatest(0, least(len(rejected_steps) - 1, m + CAST(idx % 7 AS INT) - 2)) AS c FROM pairs)
SELECT idx, {_listed(_DECAY.format(m='c', g=0.25), 'n')} AS clamped, {_listed(_DECAY.format(m='e', g=0.25), 'n')} AS unclamped FROM x"""
ORACLES["probe_masks"] = f"""WITH {_PAIRS}, v AS (SELECT unnest(['prefix', 'error', 'suffix', 'mask']) AS probe), k AS (SELECT idx, template, m, unnest(range(len(rejected_steps))) AS k FROM pairs)
SELECT probe, template, round(sum(CASE probe WHEN 'prefix' THEN (k < m)::INT WHEN 'error' THEN (k = m)::INT WHEN 'suffix' THEN (k > m)::INT ELSE CASE WHEN k < m THEN 0.0 ELSE pow(0.5, k - m) END END), 6) AS mass, count(DISTINCT idx) AS n FROM k, v GROUP BY probe, template"""

def _rates() -> str:
    return "r AS (SELECT l_orderkey, round(l_discount * 10, 6) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount) - 1 AS k FROM lineitem)"


ORACLES["localize_rates"] = f"""WITH {_rates()},
c AS (SELECT l_orderkey, k, greatest(0.0, least(1.0, q)) AS q FROM r),
d AS (SELECT *, lag(q) OVER (PARTITION BY l_orderkey ORDER BY k) - q AS drop_ FROM c),
g AS (SELECT l_orderkey, count(*) AS n, min(k) FILTER (WHERE drop_ > 0.3) AS f, max(q) AS hi, min(q) AS lo, arg_min(k, (q, k)) AS am FROM d GROUP BY l_orderkey)
SELECT g.l_orderkey, CAST(g.n AS INT) AS n, CAST(CASE WHEN f IS NOT NULL THEN f WHEN hi <= 0.2 THEN 0 WHEN lo >= 0.8 THEN g.n - 1 ELSE am END AS INT) AS first_error,
  round(CASE WHEN f IS NOT NULL THEN least(1.0, d.drop_) WHEN hi <= 0.2 THEN 1 - hi WHEN lo >= 0.8 THEN 0.0 ELSE greatest(0.0, 1 - lo) END, 6) AS confidence
FROM g LEFT JOIN d ON d.l_orderkey = g.l_orderkey AND d.k = g.f"""
ORACLES["heuristic_rates"] = f"WITH {_PAIRS} SELECT idx, '0.0' AS rejected_last, 1.0 AS chosen_last, CAST(len(rejected_steps) AS INT) AS n FROM pairs"
ORACLES["localisation_cascade"] = f"""WITH {_PAIRS} SELECT idx,
  CASE idx % 4 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'rates' WHEN 2 THEN 'label' ELSE 'heuristic' END AS branch,
  CAST(CASE idx % 4 WHEN 0 THEN m WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS INT) AS first_error_step,
  CASE idx % 4 WHEN 1 THEN 0.8 WHEN 3 THEN 0.8 ELSE 1.0 END AS confidence,
  CASE idx % 4 WHEN 0 THEN {_listed(_DECAY.format(m='m', g=0.5))} WHEN 2 THEN '0.000000,1.000000,0.500000' ELSE '0.000000,0.000000,1.000000' END AS weights FROM pairs"""

# Variants of labelled pairs

ORACLES["shift_error"] = f"""WITH {_PAIRS}, s AS (SELECT unnest([1, -1]) AS shift), x AS (SELECT idx, shift, len(rejected_steps) AS n, greatest(0, least(m + shift, len(rejected_steps) - 1)) AS c FROM pairs, s)
SELECT idx, CAST(c AS INT) AS m, {_listed(_DECAY.format(m='c', g=0.25), 'n')} AS w, shift FROM x"""
_U = "CAST('0x' || substr(md5('42:{salt}:' || idx), 1, 8) AS BIGINT) / 4294967296.0"
ORACLES["noise_error"] = f"""WITH {_PAIRS}, x AS (SELECT idx, m, len(rejected_steps) AS n, {_U.format(salt='coin')} < 0.25 AS coin, CAST(floor({_U.format(salt='pick')} * (len(rejected_steps) - 1)) AS INT) AS p FROM pairs)
SELECT idx, CAST(CASE WHEN coin AND n > 1 THEN p + (p >= m)::INT ELSE m END AS INT) AS first_error_step, coin AS localization_noisy FROM x"""
ORACLES["truncate_rejected"] = f"WITH {_PAIRS} SELECT idx, array_to_string(rejected_steps[1:m + 1], chr(10)) AS rejected, m AS first_error_step, m + 1 AS n FROM pairs"
ORACLES["positive_prefix"] = f"WITH {_PAIRS} SELECT idx, array_to_string(rejected_steps[1:m], chr(10)) AS positive_prefix FROM pairs WHERE m >= 1"
ORACLES["metadata_merge"] = """SELECT event_id, event_type AS a, user_id AS b, '{"a":"' || event_type || '","b":' || user_id || ',"c":0.5,"n":null}' AS merged, 4 AS n FROM events"""

# Selection, filters, splits

ORACLES["pair_selection"] = """SELECT lang, source, coalesce(CAST(min(doc_id) FILTER (WHERE quality = 1) AS VARCHAR), 'gold') AS chosen, CAST(min(doc_id) FILTER (WHERE quality IS DISTINCT FROM 1) AS VARCHAR) AS rejected,
  count(*) AS num_candidates, count(*) FILTER (WHERE quality = 1) > 0 AS has_sampled_chosen
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source HAVING count(*) FILTER (WHERE quality IS DISTINCT FROM 1) > 0"""
_REASON = """f AS (SELECT idx, CASE WHEN idx % 7 = 0 OR (idx % 11) / 10.0 < 0.5 THEN 'low_confidence'
  WHEN idx % 8 = 1 THEN 'last_error' WHEN idx % 3 <> 1 THEN 'gold_fallback_chosen'
  WHEN idx % 5 = 2 OR length(array_to_string(rejected_steps, chr(10))) < 80 THEN 'truncated' END AS reject_reason FROM pairs)"""
ORACLES["quality_filter"] = f"WITH {_PAIRS}, {_REASON} SELECT idx, reject_reason FROM f"
ORACLES["reject_stats"] = f"""WITH {_PAIRS}, {_REASON}, r AS (SELECT unnest(['total', 'kept', 'low_confidence', 'last_error', 'gold_fallback_chosen', 'truncated']) AS reason)
SELECT reason, count(*) FILTER (WHERE reason = 'total' OR reason = coalesce(reject_reason, 'kept')) AS n_rows FROM r, f GROUP BY reason"""
ORACLES["truncated_documents"] = r"SELECT length(rtrim(text, E' \t\n\r\f\v')) < 80 OR regexp_matches(rtrim(text, E' \t\n\r\f\v'), '[=+\-*/:,]$') AS truncated, count(*) AS n FROM documents GROUP BY 1"
ORACLES["pair_distributions"] = f"""WITH {_PAIRS}, c AS (
SELECT 'step_count' AS measure, CAST(len(rejected_steps) AS VARCHAR) AS value FROM pairs UNION ALL SELECT 'first_error', CAST(m AS VARCHAR) FROM pairs
UNION ALL SELECT 'confidence', '1.00' FROM pairs UNION ALL SELECT 'template', template FROM pairs UNION ALL SELECT 'chosen_correct', 'true' FROM pairs
UNION ALL SELECT 'rejected_wrong', 'true' FROM pairs UNION ALL SELECT 'not_last_first_error', CASE WHEN m < len(rejected_steps) - 1 THEN 'true' ELSE 'false' END FROM pairs
UNION ALL SELECT 'sampled_chosen', CASE WHEN idx % 5 > 0 AND idx % 3 = 0 THEN 'true' ELSE 'false' END FROM pairs)
SELECT measure, value, count(*) AS n FROM c GROUP BY measure, value"""
ORACLES["split_exact"] = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= greatest(1, least(n - 1, CAST(round_even(n * 0.8, 0) AS BIGINT))) THEN 'train' ELSE 'test' END AS split FROM r"""

# Rollouts and reports

ORACLES["success_rates"] = """WITH g AS (SELECT user_id, event_id % 5 AS k, avg((value > 40)::INT) AS q FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(printf('%.6f', q), ',' ORDER BY k) AS rates FROM g GROUP BY user_id"""
ORACLES["rollouts_replayed"] = f"""WITH {_PAIRS}, k AS (SELECT idx, unnest(range(len(rejected_steps))) AS k FROM pairs)
SELECT idx, string_agg(printf('%.6f', ((idx + k + 1) % 3 = 0)::INT / 2 + ((idx + k + 2) % 3 = 0)::INT / 2), ',' ORDER BY k) AS rates FROM k GROUP BY idx"""
ORACLES["replay_join"] = f"WITH {_FEW}, s AS (SELECT unnest([1, 2]) AS sample_no) SELECT idx, sample_no, CASE WHEN idx % 2 = 0 AND sample_no = 1 THEN 'reply ' || idx END AS completion FROM q, s"
ORACLES["stop_at_provider_error"] = "SELECT c_custkey AS idx FROM customer WHERE c_custkey < coalesce((SELECT min(c_custkey) FROM customer WHERE c_custkey % 200 = 150), 1e18)"
_SAID = "d AS (SELECT event_type AS model, event_id AS idx, CAST(CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS VARCHAR) AS pred_answer, event_id % 3 <> 0 AS correct FROM events)"
ORACLES["generation_details"] = f"WITH {_SAID} SELECT * FROM d"
ORACLES["accuracy_summary"] = f"WITH {_SAID} SELECT model, round(avg(correct::INT), 6) AS accuracy, count(*) FILTER (WHERE correct) AS correct, count(*) AS total FROM d GROUP BY model UNION ALL SELECT 'nobody', 0.0, 0, 0"
ORACLES["template_accuracy"] = f"WITH {_PAIRS} SELECT template, round(avg((idx % 4 = 0)::INT), 6) AS accuracy, count(*) FILTER (WHERE idx % 4 = 0) AS correct, count(*) AS total FROM pairs GROUP BY template"
ORACLES["accuracy_over_seeds"] = """WITH s AS (SELECT event_type, event_id % 3 AS seed, avg((value > 50)::INT) AS a FROM events GROUP BY 1, 2)
SELECT event_type, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, count(*) AS n FROM s GROUP BY event_type"""
ORACLES["judge_verdicts"] = """WITH x AS (SELECT event_id, event_id % 10 AS kind, event_id % 9 - 2 AS m, (event_id % 14) / 10.0 AS c FROM events),
w AS (SELECT *, CASE kind WHEN 0 THEN 'judge response did not contain a JSON object' WHEN 1 THEN 'judge response did not contain a JSON object'
  WHEN 2 THEN 'could not convert string to float: ''high' || chr(39) WHEN 3 THEN 'float() argument must be a string or a real number, not ''NoneType' || chr(39) WHEN 5 THEN 'invalid JSON' END AS why FROM x)
SELECT event_id, CAST(CASE WHEN why IS NOT NULL OR kind = 6 THEN 4 WHEN kind = 7 THEN 3 WHEN kind = 8 THEN 2 ELSE greatest(0, least(m, 4)) END AS INT) AS first_error,
  CASE WHEN why IS NOT NULL THEN 0.0 WHEN kind IN (6, 8) THEN 1.0 WHEN kind = 7 THEN 0.5 ELSE greatest(0.0, least(c, 1.0)) END::DOUBLE AS confidence,
  CASE WHEN why IS NOT NULL THEN 'parse_failed: ' || why WHEN kind = 6 THEN 'None' WHEN kind = 7 THEN 'spaced out' WHEN kind = 8 THEN '' ELSE 'r' || m END AS rationale, why IS NOT NULL AS failed FROM w"""

# Tokens, scores, loss

ORACLES["token_offsets"] = r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '(\s*)(\S+)', 1) AS g, regexp_extract_all(text, '(\s*)(\S+)', 2) AS w FROM conversations),
u AS (SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(g) AS gap, unnest(w) AS token FROM t),
o AS (SELECT *, sum(length(gap) + length(token)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS e FROM u)
SELECT conv_id, turn, CAST(pos AS INT) AS pos, token, CAST(e - length(token) AS INT) AS start, CAST(e AS INT) AS end_ FROM o"""
ORACLES["step_char_spans"] = f"""WITH {_FEW_PAIRS}, u AS (SELECT idx, unnest(range(len(rejected_steps))) AS k, unnest(rejected_steps) AS s FROM pairs),
o AS (SELECT idx, k, length(s) AS l, sum(length(s) + 1) OVER (PARTITION BY idx ORDER BY k) - 1 AS e FROM u)
SELECT idx, CAST(k AS INT) AS k, CAST(e - l AS INT) AS start, CAST(e AS INT) AS end_ FROM o"""
_TOKENS = rf"""{_FEW_PAIRS},
sides AS (SELECT idx, m, 'chosen' AS side, prompt, chosen_steps AS steps FROM pairs UNION ALL SELECT idx, m, 'rejected', prompt, rejected_steps FROM pairs),
parts AS (SELECT idx, side, -1 AS k, 0.0 AS w, 0.0 AS wp, 0.0 AS we, 0.0 AS ws, prompt AS t FROM sides
  UNION ALL SELECT idx, side, k, CASE WHEN side = 'chosen' THEN 1.0 WHEN k < m THEN 0.0 ELSE pow(0.5, k - m) END, (k < m)::INT, (k = m)::INT, (k > m)::INT, t
  FROM (SELECT idx, m, side, unnest(range(len(steps))) AS k, unnest(steps) AS t FROM sides)),
words AS (SELECT idx, side, k, w, wp, we, ws, unnest(range(len(regexp_extract_all(t, '\S+')))) AS j, unnest(regexp_extract_all(t, '\S+')) AS token FROM parts),
toks AS (SELECT *, row_number() OVER (PARTITION BY idx, side ORDER BY k, j) - 1 AS pos FROM words)"""
ORACLES["token_weights"] = f"WITH {_TOKENS} SELECT idx, side, CAST(pos AS INT) AS pos, token, round(w, 6) AS w FROM toks"
ORACLES["vocabulary"] = r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), u AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM t)
SELECT token, min(doc_id) AS first_row, CAST(arg_min(pos, (doc_id, pos)) AS INT) AS first_pos FROM u WHERE token NOT IN ('<pad>', '<eos>', '<unk>') GROUP BY token"""
ORACLES["vocabulary_ids"] = r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark), u AS (SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM t),
v AS (SELECT token, min(item_id) AS first_row, CAST(arg_min(pos, (item_id, pos)) AS INT) AS first_pos FROM u GROUP BY token)
SELECT *, CAST(row_number() OVER (ORDER BY first_row, first_pos) + 2 AS INT) AS token_id FROM v"""
ORACLES["encoded_pairs"] = f"WITH {_TOKENS} SELECT idx, side, CAST(count(*) AS INT) AS n, round(sum(w), 6) AS mass FROM toks WHERE pos < 70 GROUP BY idx, side"
_SCORED = f"""{_TOKENS}, n AS (SELECT token, count(*) AS n FROM toks WHERE side = 'chosen' GROUP BY token), z AS (SELECT sum(n) AS total, count(*) AS kinds FROM n),
scored AS (SELECT toks.*, ln((coalesce(n, 0) + 1.0) / (total + 1.0 * (kinds + 1))) AS policy, ln((coalesce(n, 0) + 10.0) / (total + 10.0 * (kinds + 1))) AS ref FROM toks LEFT JOIN n USING (token), z)"""
_SUMS = f"{_SCORED}, sums AS (SELECT idx, side, coalesce(sum(w * policy) FILTER (WHERE pos >= 1), 0) AS policy, coalesce(sum(w * ref) FILTER (WHERE pos >= 1), 0) AS ref, greatest(1.0, sum(w) FILTER (WHERE pos >= 1)) AS mass FROM scored GROUP BY idx, side)"
ORACLES["masked_logp"] = f"WITH {_SUMS} SELECT idx, side, round(policy, 6) AS policy, round(ref, 6) AS ref FROM sums"
ORACLES["masked_logp_normalised"] = f"WITH {_SUMS} SELECT idx, side, round(policy / mass, 6) AS policy, round(ref / mass, 6) AS ref FROM sums"
_LOSS = f"{_SUMS}, p AS (SELECT c.idx, c.policy - c.ref AS cr, r.policy - r.ref AS rr FROM sums c JOIN sums r ON c.idx = r.idx AND c.side = 'chosen' AND r.side = 'rejected'), l AS (SELECT *, cr - rr AS margin, ln(1 + exp(-0.1 * (cr - rr))) AS loss FROM p)"
ORACLES["preference_loss"] = f"WITH {_LOSS} SELECT idx, round(cr, 6) AS chosen_reward, round(rr, 6) AS rejected_reward, round(margin, 6) AS reward_margin, round(loss, 6) AS loss FROM l"
ORACLES["loss_metrics"] = f"WITH {_LOSS} SELECT round(avg(loss), 6) AS loss, round(avg(cr), 6) AS chosen_reward, round(avg(rr), 6) AS rejected_reward, round(avg(margin), 6) AS reward_margin, 0.0 AS process_positive_loss FROM l"


def _probe(name: str, w: str) -> str:
    mean = lambda c: f"sum({w} * {c}) FILTER (WHERE pos >= 1) / count(DISTINCT idx)"
    return f"round({mean('policy')}, 6) AS before_{name}, round({mean('ref')}, 6) AS after_{name}, round({mean('ref')} - {mean('policy')}, 6) AS {name}_delta"


ORACLES["probe_deltas"] = f"WITH {_SCORED} SELECT 'smoothed' AS variant, {_probe('prefix', 'wp')}, {_probe('error', 'we')}, {_probe('suffix', 'ws')}, {_probe('mask', 'w')} FROM scored WHERE side = 'rejected'"

ORACLES["rejected_logp_annotation"] = f"WITH {_SUMS} SELECT pairs.idx, template, round(policy, 6) AS weighted_rejected_logp FROM pairs LEFT JOIN sums ON sums.idx = pairs.idx AND side = 'rejected'"
ORACLES["bigram_logp"] = f"""WITH {_TOKENS}, b AS (SELECT side, lag(token) OVER (PARTITION BY idx, side ORDER BY pos) AS prev, token FROM toks),
c AS (SELECT prev, count(*) AS before_ FROM b WHERE side = 'chosen' AND prev IS NOT NULL GROUP BY prev), p AS (SELECT prev, token, count(*) AS n FROM b WHERE side = 'chosen' AND prev IS NOT NULL GROUP BY 1, 2), k AS (SELECT count(*) AS kinds FROM c)
SELECT side, round(avg(ln((coalesce(n, 0) + 1.0) / (coalesce(before_, 0) + 1.0 * (kinds + 1)))), 6) AS mean_logp, count(*) AS n FROM b LEFT JOIN c USING (prev) LEFT JOIN p USING (prev, token), k WHERE prev IS NOT NULL GROUP BY side"""
ORACLES["process_positive_metrics"] = f"""WITH {_SCORED}, sums AS (SELECT idx, side, coalesce(sum(w * (policy - ref)) FILTER (WHERE pos >= 1), 0) AS r, coalesce(sum(wp * (policy - ref)) FILTER (WHERE pos >= 1), 0) AS pr FROM scored GROUP BY idx, side),
p AS (SELECT c.idx, c.r AS cr, r.r AS rr, r.pr AS pr FROM sums c JOIN sums r ON c.idx = r.idx AND c.side = 'chosen' AND r.side = 'rejected')
SELECT round(avg(ln(1 + exp(-0.1 * (cr - rr)))) - 0.2 * avg(pr), 6) AS loss, round(avg(cr), 6) AS chosen_reward, round(avg(rr), 6) AS rejected_reward, round(avg(cr - rr), 6) AS reward_margin, round(-avg(pr), 6) AS process_positive_loss FROM p"""
ORACLES["padded_batch"] = f"""WITH {_FEW}, t AS (SELECT idx, list_transform(string_split(question, ' '), lambda x: length(x)) AS l FROM q), m AS (SELECT max(len(l)) + 2 AS n FROM t)
SELECT idx, array_to_string(list_concat(l, list_transform(range(n - len(l)), lambda x: 0)), ',') AS ids FROM t, m"""
ORACLES["strict_pairing"] = f"WITH {_FEW} SELECT idx, 'reply ' || answer AS completion FROM q"
ORACLES["confident_rates"] = f"WITH base AS ({ORACLES['localize_rates']}) SELECT l_orderkey AS idx, 'rates' AS branch, first_error AS first_error_step, confidence FROM base WHERE confidence >= 0.6"
ORACLES["short_traces_dropped"] = f"WITH {_SEG} SELECT conv_id, turn, CAST(len(steps) AS INT) AS n_steps FROM seg WHERE len(steps) >= 2"
ORACLES["judged_pairs"] = f"""WITH {_PAIRS}, x AS (SELECT idx, len(rejected_steps) AS n, idx % 6 = 5 AS f, CAST(CASE WHEN idx % 6 = 5 THEN len(rejected_steps) - 1 ELSE least(idx % 4, len(rejected_steps) - 1) END AS INT) AS c FROM pairs)
SELECT idx, c AS first_error_step, CASE WHEN f THEN 0.0 ELSE 0.75 END AS localization_confidence, CASE WHEN f THEN 'parse_failed: judge response did not contain a JSON object' ELSE 'x' END AS judge_rationale, f AS parse_failed, {_listed(_DECAY.format(m='c', g=0.25), 'n')} AS weights FROM x"""
ORACLES["cached_localisations"] = "SELECT c_custkey AS sample_id FROM customer WHERE c_custkey % 3 <> 0"
ORACLES["judge_failures"] = f"""WITH {_PAIRS}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE idx % 10 = 0) AS no_steps, count(*) FILTER (WHERE idx % 10 <> 0 AND idx % 6 = 5) AS parse_failed FROM pairs)
SELECT *, no_steps + parse_failed AS failures FROM c"""
ORACLES["model_grid"] = f"""WITH {_FEW}, m(model) AS (VALUES ('always'), ('thirds'), ('never')), x AS (SELECT model, model = 'always' OR (model = 'thirds' AND idx % 3 = 0) AS ok FROM q, m)
SELECT model, round(avg(ok::INT), 6) AS accuracy, count(*) FILTER (WHERE ok) AS correct, count(*) AS total FROM x GROUP BY model"""

# Files

ORACLES["jsonl_round_trip"] = f"""WITH {_FEW} SELECT 'Question: ' || question || chr(10) || 'Answer step by step.' AS prompt, answer AS chosen, answer AS rejected,
  CASE WHEN idx % 2 = 0 THEN answer END AS answer, 'naïve ✓ "' || idx || '"' AS note FROM q"""
ORACLES["variant_files"] = ORACLES["weight_variants"]
ORACLES["resumed_rows"] = "SELECT c_custkey AS idx, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM customer"
ORACLES["csv_report"] = f"WITH {_PAIRS} SELECT template, printf('%.4f', avg((idx % 4 = 0)::INT)) AS accuracy, CAST(count(*) AS VARCHAR) AS total FROM pairs GROUP BY template"
ORACLES["seeded_draws"] = "SELECT c_custkey, CAST('0x' || substr(md5('456:' || c_custkey), 1, 15) AS BIGINT) % 1000001 AS seed FROM customer"
ORACLES["committed_increments"] = ORACLES["resumed_rows"]
ORACLES["typed_metadata"] = """SELECT c_custkey AS row_id, '{"gamma":0.25,"nested":{"by":{"name":"é","note":null},"rows":[' || c_custkey || ',' || (c_custkey + 1) || ']},"none":null,"ok":' || (c_custkey % 2 = 0) || ',"row_id":' || c_custkey || ',"text":7,"x":' || c_custkey || '.5}' AS metadata,
  true AS x_is_decimal, 'VOID' AS none_is FROM customer"""
ORACLES["record_positions"] = "SELECT o_orderkey AS idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders"
ORACLES["cached_completions"] = f"WITH {_FEW}, s AS (SELECT unnest([1, 2]) AS sample_no) SELECT idx, sample_no, CASE WHEN idx % 3 = 0 THEN 'kept' ELSE length(question) || ' characters' END AS completion FROM q, s"

# Order, ranges, logits, streams

ORACLES["length_batches"] = f"""WITH {_FEW}, t AS (SELECT idx, list_transform(string_split(question, ' '), lambda x: length(x))[1:idx % 9 + 12] AS l FROM q),
o AS (SELECT idx, l, row_number() OVER (ORDER BY len(l), idx) - 1 AS n FROM t), b AS (SELECT *, n // 16 AS batch, max(len(l)) OVER (PARTITION BY n // 16) AS width FROM o)
SELECT idx, batch, CAST(n % 16 AS INT) AS place, CAST(width AS INT) AS width, array_to_string(list_concat(l, list_transform(range(width - len(l)), lambda x: 0)), ',') AS ids, CAST(len(l) AS INT) AS n_real FROM b"""
ORACLES["training_batches"] = f"""WITH {_TOKENS}, s AS (SELECT idx, side, CAST(count(*) AS INT) AS n, round(sum(w), 6) AS mass FROM toks GROUP BY idx, side),
o AS (SELECT *, row_number() OVER (ORDER BY n, idx, side) - 1 AS k FROM s), b AS (SELECT *, max(n) OVER (PARTITION BY k // 8) AS width FROM o)
SELECT idx, side, k // 8 AS batch, CAST(k % 8 AS INT) AS place, width, width AS n_ids, width AS n_mask, n AS n_real, mass FROM b"""
ORACLES["cyclic_batches"] = """WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n, count(*) OVER () AS total FROM customer), s AS (SELECT unnest(range(70, 3570)) AS i)
SELECT i // 7 AS step, CAST(i % 7 AS INT) AS place, c_custkey FROM s JOIN o ON o.n = s.i % o.total"""
ORACLES["token_weights_joined"] = f"WITH {_TOKENS} SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY k, j) - 1 AS INT) AS pos, token, round(w, 6) AS w FROM words WHERE side = 'rejected' AND k >= 0"
ORACLES["softmax_logp"] = """WITH c AS (SELECT c_custkey AS idx, unnest(range(6)) AS pos FROM customer), v AS (SELECT idx, pos, unnest(range(11)) AS t FROM c),
x AS (SELECT idx, pos, t, (idx * 31 + pos * 17 + t * 13) % 97 / 8 AS x FROM v), z AS (SELECT idx, pos, ln(sum(exp(x))) AS z FROM x GROUP BY idx, pos)
SELECT x.idx, CAST(x.pos + 1 AS INT) AS pos, round(x - z, 6) AS logp, 1.0::DOUBLE AS mass FROM x JOIN z USING (idx, pos) WHERE x.pos < 5 AND t = (idx * 7 + (x.pos + 1) * 3) % 11"""
ORACLES["backoff_logp"] = f"""WITH {_TOKENS}, b AS (SELECT side, lag(token) OVER (PARTITION BY idx, side ORDER BY pos) AS prev, token FROM toks), r AS (SELECT * FROM b WHERE prev IS NOT NULL),
n AS (SELECT prev, token, count(*) AS n FROM r WHERE side = 'chosen' GROUP BY prev, token), u AS (SELECT prev, sum(n) AS total, count(*) AS kinds FROM n GROUP BY prev),
a AS (SELECT token, count(*) AS n FROM n GROUP BY token), z AS (SELECT (SELECT count(*) FROM n) AS pairs, (SELECT count(*) FROM a) AS tokens),
p AS (SELECT r.side, n.n, u.total, u.kinds, (greatest(coalesce(a.n, 0) - 0.75, 0) + 0.75 * tokens / (tokens + 1.0)) / pairs AS low FROM r LEFT JOIN n ON n.prev = r.prev AND n.token = r.token LEFT JOIN u ON u.prev = r.prev LEFT JOIN a ON a.token = r.token, z)
SELECT side, round(avg(ln(CASE WHEN total IS NULL THEN low ELSE (greatest(coalesce(n, 0) - 0.75, 0) + 0.75 * kinds * low) / total END)), 6) AS mean_logp, count(*) AS n FROM p GROUP BY side"""
ORACLES["arriving_rates"] = f"SELECT l_orderkey, first_error, confidence FROM ({ORACLES['localize_rates']})"
ORACLES["step_spans_not_found"] = """WITH c AS (SELECT c_custkey AS idx, CAST(length(CAST(c_custkey AS VARCHAR)) AS INT) AS n FROM customer)
SELECT idx, 0 AS k, 0 AS start, 12 + n AS end_ FROM c UNION ALL SELECT idx, 1, 14 + n, 27 + n FROM c UNION ALL SELECT idx, 2, 27 + n, 31 + n FROM c"""
