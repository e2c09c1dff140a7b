"""The catalog's queries as SQL for another engine, written independently.

Sequential operators are recursive CTEs here, one row at a time, where the Spark
side uses windows, partial aggregates or arrays.
"""

from __future__ import annotations

from colloquy.operators.prompts import INSTRUCTIONS, PERSONALITY
from colloquy.plans import catalog
from colloquy.sources import index

SIZE, SHARED = catalog.SETTINGS["chunk_size"], catalog.SETTINGS["overlap"]
MARK = "|".join(f"{k}={v}" for k, v in sorted(catalog.SETTINGS.items()))
DAY_US = 86_400_000_000
WAKE_PHRASES = catalog.WAKE_PHRASES
WORD = r"\s*\S+(?:\s+$)?"
LETTERS = r"\p{L}+"
BUCKET = "((('0x' || substr(md5(w), 1, 8))::BIGINT) % {dim})::INTEGER"

SENTENCES = r"""
all_s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS s FROM documents),
sents AS (SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM all_s)"""

DISTANCES = SENTENCES + f""",
buf AS (SELECT doc_id, pos, string_agg(sentence, '') OVER
    (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b FROM sents),
tok AS (SELECT doc_id, pos, {BUCKET.format(dim=256)} AS bucket, count(*)::DOUBLE AS n
    FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(b), '{LETTERS}')) AS w FROM buf) GROUP BY ALL),
sq AS (SELECT doc_id, pos, sum(n * n) AS q FROM tok GROUP BY ALL),
dots AS (SELECT b.doc_id, b.pos, sum(a.n * b.n) AS d FROM tok a JOIN tok b
    ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.bucket = b.bucket GROUP BY ALL),
dist AS (SELECT s.doc_id, s.pos, round(1 - coalesce(d / (sqrt(q1.q) * sqrt(q0.q)), 0), 9) AS distance
    FROM sents s LEFT JOIN dots USING (doc_id, pos) LEFT JOIN sq q1 USING (doc_id, pos)
    LEFT JOIN sq q0 ON q0.doc_id = s.doc_id AND q0.pos = s.pos - 1 WHERE s.pos > 0),
lim AS (SELECT doc_id, round(quantile_cont(distance, 0.9), 12) AS threshold FROM dist GROUP BY doc_id),
numbered AS (SELECT s.doc_id, s.pos, s.sentence,
    sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.pos)::INTEGER AS chunk_no
    FROM sents s LEFT JOIN dist USING (doc_id, pos) LEFT JOIN lim ON lim.doc_id = s.doc_id)"""


def packing(source: str, keys: str) -> str:
    """Pack sentences of ``source(keys, pos, sentence)`` into ``spans(keys, part, text, n_tokens)``."""
    on = " AND ".join(f"p.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    pk = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return rf""",
worded AS (SELECT {keys}, pos, sentence, regexp_extract_all(sentence, '{WORD}') AS ws FROM {source}),
units AS (
    SELECT {keys}, pos, 0 AS sub, sentence AS t, len(ws) AS n FROM worded WHERE len(ws) <= {SIZE}
    UNION ALL
    SELECT {keys}, pos, i AS sub, array_to_string(ws[i + 1 : i + {SIZE}], '') AS t, len(ws[i + 1 : i + {SIZE}]) AS n
    FROM (SELECT *, unnest(range(0, len(ws), {SIZE})) AS i FROM worded WHERE len(ws) > {SIZE})),
lists AS (SELECT {keys}, list(t ORDER BY pos, sub) AS ts, list(n ORDER BY pos, sub) AS ns,
    list_concat([0], list(c ORDER BY pos, sub)) AS cum
    FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY pos, sub)::BIGINT AS c FROM units) GROUP BY ALL),
walk AS (
    SELECT {keys}, 0 AS part, 0::BIGINT AS s, (len(list_filter(cum, lambda x: x <= {SIZE})) - 1)::BIGINT AS e FROM lists
    UNION ALL
    SELECT {keys}, part + 1, s2, len(list_filter(cum, lambda x: x <= cum[s2 + 1] + {SIZE})) - 1
    FROM (SELECT {pk}, part, cum, len(list_filter(cum, lambda x: x < cum[e + 1] - least({SHARED}, {SIZE} - ns[e + 1]))) AS s2
          FROM walk p JOIN lists l ON {on} WHERE e < len(ns))),
spans AS (SELECT {pk}, part, array_to_string(ts[s + 1 : e], '') AS text, (cum[e + 1] - cum[s + 1])::INTEGER AS n_tokens
    FROM walk p JOIN lists l ON {on})"""


def flat(expr: str, scale: int = 1_000_000) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: round(x::DOUBLE * {scale})::BIGINT::VARCHAR), ',')"


def nearest(k: int, source: str = "embeddings") -> str:
    return f"""
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
    round(1 - list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
      / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
       * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 9) AS distance
    FROM {source}),
hits AS (SELECT query_id, rank::INTEGER AS rank, chunk_id, distance, 1 - distance AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM pairs) WHERE rank <= {k})"""


def planes() -> str:
    import numpy as np

    drawn = np.random.default_rng(catalog.LSH["seed"]).standard_normal((catalog.LSH["tables"] * catalog.LSH["bits"], 64))
    rows = ", ".join(
        f"({i // catalog.LSH['bits']}, {i % catalog.LSH['bits']}, [{', '.join(repr(float(x)) for x in p)}]::DOUBLE[])"
        for i, p in enumerate(drawn)
    )
    return f"planes(tab, bit, p) AS (VALUES {rows})"


PROMPT = "CASE WHEN length({c}) > 0 THEN {c} || '\n\n" + PERSONALITY + " " + INSTRUCTIONS + "\nQuery: ' || {q} ELSE '" + PERSONALITY + "\nQuery: ' || {q} END"

QUESTIONS = "questions AS (SELECT conv_id * 100000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user')"


def ratio(source: str, keywords: list | str, cutoff: float) -> str:
    """Best window of each keyword in ``source(conv_id, turn, text)``: ``best``. Keywords are a list or SQL for (no, k)."""
    listed = keywords if isinstance(keywords, str) else "VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(keywords))
    return f""",
kw(no, k) AS ({listed}),
sides AS (SELECT conv_id, turn, no, length(text) AS n,
    CASE WHEN length(text) < length(k) THEN text ELSE k END AS a,
    CASE WHEN length(text) < length(k) THEN k ELSE text END AS b,
    length(text) < length(k) AS turned FROM {source}, kw WHERE length(text) > 0),
chars AS (SELECT *, string_split(a, '') AS ca, string_split(b, '') AS cb, length(a) AS m FROM sides),
alphabet AS (SELECT DISTINCT a, unnest(ca) AS c FROM chars),
bits AS (SELECT a, map(list(c), list(bm)) AS bm FROM (SELECT a, c, list_sum(list_transform(range(length(a)),
    lambda i: CASE WHEN string_split(a, '')[i + 1] = c THEN (1::BIGINT << i) ELSE 0 END))::BIGINT AS bm FROM alphabet) GROUP BY a),
masked AS (SELECT conv_id, turn, no, n, m, length(b) AS nb, turned, (1::BIGINT << m) - 1 AS full_,
    list_transform(cb, lambda c: coalesce(bm[c], 0)) AS ms FROM chars JOIN bits USING (a)),
wins AS (SELECT *, greatest(st, 0) AS lo, least(st + m, nb) AS hi
    FROM (SELECT *, unnest(range(1 - m, nb)) AS st FROM masked)),
vs AS (SELECT conv_id, turn, no, m, turned, n, lo, hi, list_reduce(list_prepend(full_, ms[lo + 1 : hi]),
    lambda v, h: ((v + (v & h)) | (v - (v & h))) & full_) AS v FROM wins),
scored AS (SELECT conv_id, turn, no, 200.0::DOUBLE * (m - bit_count(v)) / (m + hi - lo) AS score,
    CASE WHEN turned THEN n ELSE hi END AS stop FROM vs),
each AS (SELECT conv_id, turn, no, score, stop, row_number() OVER
    (PARTITION BY conv_id, turn ORDER BY score DESC, no, stop) AS place FROM scored),
best AS (SELECT conv_id, turn, no, score, stop FROM each WHERE place = 1 AND score >= {cutoff})"""


def lower_phrases() -> list:
    return [k.lower() for k in WAKE_PHRASES]


FOLLOWS = {  # state -> event -> next state, spelled out
    "WAITING": {"trigger": "LISTENING"},
    "LISTENING": {"transcript": "THINKING"},
    "THINKING": {"answer": "SPEAKING"},
    "SPEAKING": {"done": "WAITING"},
    "ERROR": {"trigger": "LISTENING"},
}


def replay(where: str) -> str:
    cases = " ".join(
        f"WHEN state = '{s}' AND e.event = '{ev}' THEN '{to}'" for s, m in FOLLOWS.items() for ev, to in m.items()
    )
    roles = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.EVENT_ROLES.items())
    move = f"CASE WHEN e.event = 'failure' THEN 'ERROR' {cases} WHEN state = 'ERROR' THEN 'WAITING' ELSE state END"
    return f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type {roles} END AS event,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events {where}),
r AS (
    SELECT user_id, event_id, e.event, no, {move} AS state
    FROM (SELECT *, 'WAITING' AS state FROM e WHERE no = 1) e
    UNION ALL
    SELECT e.user_id, e.event_id, e.event, e.no, {move.replace('state', 'r.state')}
    FROM r JOIN e ON e.user_id = r.user_id AND e.no = r.no + 1)
SELECT user_id, event_id, event, state FROM r"""


def debounced(where: str = "") -> str:
    return f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE value >= 20 {where}),
f AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id),
r AS (SELECT user_id, t FROM f
    UNION ALL
    SELECT user_id, t2 FROM (SELECT r.user_id, min(e.t) AS t2 FROM r JOIN e ON e.user_id = r.user_id AND e.t >= r.t + {DAY_US}
        GROUP BY r.user_id) WHERE t2 IS NOT NULL)
SELECT user_id, event_id, t AS ts_us FROM r JOIN e USING (user_id, t)"""


_SP = catalog.SPEECH


def gated(where: str = "") -> str:
    return f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, round(value * 3600 * 1000000)::BIGINT AS busy
  FROM events WHERE event_type = 'click' {where}),
r AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
    UNION ALL
    SELECT user_id, t2 FROM (SELECT r.user_id, min(n.t) AS t2 FROM r JOIN e USING (user_id, t)
      JOIN e n ON n.user_id = r.user_id AND n.t >= r.t + e.busy GROUP BY r.user_id) WHERE t2 IS NOT NULL)
SELECT user_id, event_id, t AS ts_us FROM r JOIN e USING (user_id, t)"""


def segments(where: str = "", closed: str = "", source: str = "events", _SP: dict = _SP) -> str:
    return f"""
WITH RECURSIVE f AS (SELECT user_id, least(1.0, value / 100) AS p,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM {source} {where}),
r AS (
    SELECT user_id, no, seg, start, pend,
      NULL::BIGINT AS done FROM (SELECT user_id, no,
        CASE WHEN p >= {_SP['t']} THEN 1 ELSE 0 END AS seg,
        CASE WHEN p >= {_SP['t']} THEN {_SP['frame']}::BIGINT - {_SP['pad']} - {_SP['frame']} END AS start,
        NULL::BIGINT AS pend FROM f WHERE no = 1)
    UNION ALL
    SELECT user_id, no, CASE WHEN opens THEN seg + 1 ELSE seg END,
      CASE WHEN opens THEN place - {_SP['pad']} - {_SP['frame']} WHEN closes THEN NULL ELSE start END,
      CASE WHEN p >= {_SP['t']} OR closes THEN NULL ELSE pend2 END,
      CASE WHEN closes THEN pend2 + {_SP['pad']} - {_SP['frame']} END
    FROM (SELECT *, low AND place - pend2 >= {_SP['min_silence']} AS closes FROM (
      SELECT f.user_id, f.no, f.p, r.seg, r.start, f.no * {_SP['frame']} AS place, f.p >= {_SP['t']} AND r.start IS NULL AS opens,
        f.p < {_SP['t']} - {_SP['margin']} AND r.start IS NOT NULL AS low,
        CASE WHEN f.p < {_SP['t']} - {_SP['margin']} AND r.start IS NOT NULL THEN coalesce(r.pend, f.no * {_SP['frame']}) ELSE r.pend END AS pend2
      FROM r JOIN f ON f.user_id = r.user_id AND f.no = r.no + 1)))
SELECT user_id, seg::BIGINT AS segment, max(start)::BIGINT AS start_pos, max(done)::BIGINT AS end_pos FROM r WHERE seg > 0 GROUP BY user_id, seg {closed}"""


def captured(where: str = "", timer_us: int | None = None) -> str:
    late = f"(SELECT min(a.t) FROM aud a WHERE a.user_id = trg.user_id AND a.t >= trg.t + {2 * DAY_US})"
    if timer_us is not None:
        late = f"t + {timer_us}"
    return f"""
WITH RECURSIVE trg AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click' {where}),
aud AS (SELECT user_id, epoch_us(ts) AS t, round(value::FLOAT::DOUBLE * 100)::BIGINT AS x, event_type = 'purchase' AS stops
  FROM events WHERE event_type IN ('view', 'purchase') {where}),
bnd AS (SELECT user_id, t, (SELECT min(a.t) FROM aud a WHERE a.user_id = trg.user_id AND a.t >= trg.t AND a.stops) AS se,
  {late} AS late FROM trg),
cap AS (SELECT user_id, t, CASE WHEN se IS NULL THEN late WHEN late IS NULL THEN se ELSE least(se, late) END AS stop,
  CASE WHEN se IS NOT NULL AND (late IS NULL OR se <= late) THEN 'speech_end' ELSE 'timeout' END AS ended_by FROM bnd),
r AS (SELECT user_id, min(t) AS t, 1 AS no FROM cap GROUP BY user_id
    UNION ALL
    SELECT user_id, t2, no + 1 FROM (SELECT r.user_id, r.no, min(n.t) AS t2 FROM r JOIN cap USING (user_id, t)
      JOIN cap n ON n.user_id = r.user_id AND n.t > cap.stop GROUP BY r.user_id, r.no) WHERE t2 IS NOT NULL),
acc AS (SELECT user_id, no, t, stop, ended_by, (SELECT max(a.t) FROM aud a WHERE a.user_id = r.user_id AND a.t < r.t) AS front
  FROM r JOIN cap USING (user_id, t) WHERE stop IS NOT NULL),
utt AS (SELECT user_id, acc.no, ended_by, count(*) AS n, string_agg(x::VARCHAR, ',' ORDER BY aud.t) AS s
  FROM acc JOIN aud USING (user_id) WHERE aud.t BETWEEN acc.t AND acc.stop OR aud.t = acc.front GROUP BY ALL)
SELECT user_id, no::BIGINT AS utt_no, ended_by, CASE WHEN n < 4 THEN s || repeat(',0', (6 - n)::INTEGER) ELSE s END AS samples FROM utt"""


def reframed(where: str = "") -> str:
    return f"""
WITH s AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings {where}),
n AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS place FROM s)
SELECT label, place // 24 AS frame_no, string_agg(round(x::DOUBLE * 1000000)::BIGINT::VARCHAR, ',' ORDER BY place) AS samples
FROM n GROUP BY label, place // 24 HAVING count(*) = 24"""


def switched(where: str = "") -> str:
    return f"""
WITH sw AS (SELECT user_id, ts, event_type = 'signup' AS enabled FROM events WHERE event_type IN ('signup', 'error'))
SELECT e.user_id, e.event_id FROM (SELECT * FROM events WHERE event_type NOT IN ('signup', 'error') {where}) e
ASOF JOIN sw ON sw.user_id = e.user_id AND sw.ts <= e.ts WHERE sw.enabled"""


EPOCHS = """(SELECT user_id * 1000000 + (SELECT count(*) FROM events c WHERE c.user_id = v.user_id AND c.event_type = 'click' AND c.ts <= v.ts)
    AS user_id, event_id, ts, value FROM events v WHERE event_type <> 'click')"""

MOVED = """CASE WHEN {event} = 'disable' THEN 'OFF'
  WHEN {state} = 'OFF' THEN CASE WHEN {event} = 'enable' THEN 'WAITING' ELSE 'OFF' END
  WHEN {event} = 'failure' THEN 'ERROR'
  WHEN {state} IN ('WAITING', 'ERROR') AND {event} = 'trigger' THEN 'LISTENING'
  WHEN {state} = 'LISTENING' AND {event} = 'transcript' THEN 'THINKING'
  WHEN {state} = 'LISTENING' AND {event} = 'short_transcript' THEN 'WAITING'
  WHEN {state} = 'THINKING' AND {event} = 'answer' THEN 'SPEAKING'
  WHEN {state} = 'SPEAKING' AND {event} = 'done' THEN 'WAITING'
  WHEN {state} = 'ERROR' THEN 'WAITING' ELSE {state} END"""

BUILT = {"buffer_size": 1, "chunk_size": SIZE, "dim": 256, "embedder": "hashed", "overlap": SHARED, "pct": 90}
BUILT_MARK = "|".join(f"{k}={v}" for k, v in BUILT.items())

ORACLE: dict[str, str] = {
    "scan_texts": "SELECT lang, line FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)",
    "drop_comment_lines": r"""
SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM
  (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS line_no, unnest(l) AS line
   FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE NOT regexp_matches(line, '^\s*#') AND NOT regexp_matches(line, '^\s*$')""",
    "append_tables": """
SELECT o_orderkey, o_orderpriority || coalesce('\n\n--- TABLE CONTENT ---\n\n' || c || '\n\n--- END TABLE CONTENT ---', '') AS text
FROM orders JOIN (
  SELECT l_orderkey, string_agg(CASE WHEN l_returnflag NOT IN ('N', 'A')
    THEN l_linenumber::VARCHAR || ' | ' || l_partkey::VARCHAR || ' | ' || l_linestatus END, '\n\n' ORDER BY l_linenumber,
    l_linenumber::VARCHAR || ' | ' || l_partkey::VARCHAR || ' | ' || l_linestatus) AS c
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "scalar_metadata": """
SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events
UNION ALL SELECT event_id, 'kind', event_type FROM events
UNION ALL SELECT event_id, 'ok', (value > 40)::VARCHAR FROM events
UNION ALL SELECT event_id, 'none', NULL FROM events
UNION ALL SELECT event_id, 'half', '0.5' FROM events""",
    "write_and_open_chunks": """
SELECT doc_id::VARCHAR AS chunk_id, text FROM documents
UNION ALL SELECT conv_id::VARCHAR || '-' || turn::VARCHAR, text FROM conversations""",
    "insert_new_entries": "SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'stored' ELSE text END AS text FROM documents",
    "assign_batches": """
SELECT source, doc_id, ((row_number() OVER (ORDER BY source, doc_id) - 1) // 100 + 1)::BIGINT AS batch_num,
  ((SELECT count(*) FROM documents) + 99) // 100 AS total_batches FROM documents""",
    "dump_chunk_texts": "SELECT text FROM documents",
    "ingest_report": "WITH RECURSIVE " + SENTENCES + packing("sents", "doc_id") + """
SELECT lang, (SELECT count(*) FROM documents d2 WHERE d2.lang = d.lang) AS documents, count(*) AS chunks
FROM spans JOIN documents d USING (doc_id) GROUP BY lang""",
    "split_sentences": f"WITH {SENTENCES} SELECT doc_id, pos, sentence FROM sents",
    "buffer_sentences": f"""WITH {SENTENCES} SELECT doc_id, pos, string_agg(sentence, '') OVER
(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS buffered FROM sents""",
    "hash_embed": f"""
WITH tok AS (SELECT doc_id, {BUCKET.format(dim=256)} AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS w FROM documents) GROUP BY ALL)
SELECT doc_id, bucket, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 6) AS weight FROM tok""",
    "embed": f"""
WITH tok AS (SELECT doc_id, {BUCKET.format(dim=64)} AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS w FROM documents) GROUP BY ALL),
wt AS (SELECT doc_id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT AS weight FROM tok),
cells AS (SELECT d.doc_id, b.bucket, coalesce(weight, 0) AS weight FROM documents d CROSS JOIN range(64) b(bucket)
  LEFT JOIN wt ON wt.doc_id = d.doc_id AND wt.bucket = b.bucket)
SELECT doc_id, string_agg(round(weight::DOUBLE * 1000000)::BIGINT::VARCHAR, ',' ORDER BY bucket) AS embedding
FROM cells GROUP BY doc_id""",
    "adjacent_distance": f"WITH {DISTANCES} SELECT doc_id, pos, distance FROM dist",
    "breakpoint_threshold": f"WITH {DISTANCES} SELECT doc_id, threshold FROM lim",
    "semantic_chunks": f"""WITH {DISTANCES} SELECT doc_id, chunk_no, string_agg(sentence, '' ORDER BY pos) AS text
FROM numbered GROUP BY doc_id, chunk_no""",
    "pack_sentences": "WITH RECURSIVE " + SENTENCES + packing("sents", "doc_id")
    + " SELECT doc_id, part AS pos, text, n_tokens FROM spans",
    "token_windows": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 20, 1), 80)) AS i FROM w WHERE len(ws) > 0)
SELECT doc_id, (i // 80)::INTEGER AS pos, array_to_string(ws[i + 1 : i + 100], '') AS text,
  len(ws[i + 1 : i + 100])::INTEGER AS n_tokens FROM c""",
    "chunk_documents": "WITH RECURSIVE " + DISTANCES + packing("numbered", "doc_id, chunk_no")
    + " SELECT doc_id, chunk_no, part, text, n_tokens FROM spans",
    "build_chunks": "WITH RECURSIVE " + DISTANCES + packing("numbered", "doc_id, chunk_no") + f""",
h AS (SELECT *, sha256('{BUILT_MARK}|' || text) AS content_hash FROM spans)
SELECT concat_ws('-', doc_id, chunk_no, part, substr(content_hash, 1, 12)) AS chunk_id, doc_id, chunk_no AS pos, n_tokens,
  content_hash FROM h""",
    "new_chunks": f"""
WITH h AS (SELECT doc_id, lang, sha256('{MARK}|' || text) AS content_hash FROM documents)
SELECT doc_id, content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE lang = 'en')""",
    "cosine_neighbours": """
SELECT a.vec_id, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
  / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
   * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "topk_search": "WITH" + nearest(3, "embeddings q, embeddings c") + " SELECT * FROM hits",
    "relevance_filter": "WITH" + nearest(5, "embeddings q, embeddings c") + " SELECT * FROM hits WHERE score >= 0.55",
    "lsh_topk": f"WITH {planes()}, " + """
signs AS (SELECT vec_id, tab, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], p) > 0 THEN (1::BIGINT << bit) ELSE 0 END) AS cell
  FROM embeddings, planes GROUP BY vec_id, tab),
cand AS (SELECT DISTINCT a.vec_id AS qid, b.vec_id AS cid FROM signs a JOIN signs b ON a.tab = b.tab AND a.cell = b.cell),"""
    + nearest(3, "cand JOIN embeddings q ON q.vec_id = qid JOIN embeddings c ON c.vec_id = cid") + " SELECT * FROM hits",
    "assemble_context": f"""
WITH {QUESTIONS},
hits AS (SELECT query_id, rank, cv * 3 + rank AS doc_id FROM (SELECT conv_id * 100000 + turn AS query_id, conv_id AS cv,
  unnest(range(1, turn + 1)) AS rank FROM conversations WHERE role = 'user'))
SELECT q.query_id, c.context FROM questions q LEFT JOIN (
  SELECT query_id, string_agg(text, '\n\n' ORDER BY rank) AS context FROM hits JOIN documents USING (doc_id) GROUP BY query_id
) c USING (query_id)""",
    "build_prompt": f"""
SELECT conv_id, turn, {PROMPT.format(c='context', q='text')} AS prompt FROM
  (SELECT *, CASE role WHEN 'assistant' THEN text WHEN 'user' THEN '' END AS context FROM conversations)""",
    "direct_prompts": f"WITH {QUESTIONS} SELECT query_id, '{PERSONALITY}\nQuery: ' || query AS prompt FROM questions",
    "grounded_prompts": "WITH RECURSIVE " + QUESTIONS + "," + SENTENCES + packing("sents", "doc_id") + f""",
texts AS (SELECT doc_id::VARCHAR || '-' || part::VARCHAR AS id, text FROM spans),
ctok AS (SELECT id, {BUCKET.format(dim=256)} AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS w FROM texts) GROUP BY ALL),
qtok AS (SELECT query_id, {BUCKET.format(dim=256)} AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{LETTERS}')) AS w FROM questions) GROUP BY ALL),
cw AS (SELECT id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM ctok),
qw AS (SELECT query_id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY query_id)))::FLOAT::DOUBLE AS x FROM qtok),
cl AS (SELECT id, sqrt(sum(x * x)) AS len FROM cw GROUP BY id),
ql AS (SELECT query_id, sqrt(sum(x * x)) AS len FROM qw GROUP BY query_id),
dp AS (SELECT query_id, id, sum(q.x * c.x) AS d FROM qw q JOIN cw c USING (bucket) GROUP BY query_id, id),
ds AS (SELECT query_id, id, round(1 - coalesce(d, 0) / (ql.len * cl.len), 9) AS distance
  FROM ql CROSS JOIN cl LEFT JOIN dp USING (query_id, id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ds),
ctx AS (SELECT query_id, string_agg(text, '\n\n' ORDER BY rank) AS context FROM top JOIN texts USING (id)
  WHERE rank <= 3 AND 1 - distance >= 0.1 GROUP BY query_id)
SELECT query_id, context, {PROMPT.format(c='context', q='query')} AS prompt FROM questions LEFT JOIN ctx USING (query_id)""",
    "request_stats": """
SELECT event_type AS route, count(*) AS n, count(*) FILTER (WHERE value > 100) AS n_failed, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""",
    "clean_transcripts": r"""
SELECT conv_id, turn, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS cleaned, ltrim(' .,!? ' || text, ' ,.!?') AS rest
FROM conversations""",
    "partial_ratio": "WITH src AS (SELECT conv_id, turn, lower(text) AS text FROM conversations)"
    + ratio("src", ["good morning robot"], 0) + """
SELECT conv_id, turn, round(coalesce(score, 0), 6) AS score, coalesce(stop, 0)::BIGINT AS "end"
FROM src LEFT JOIN best USING (conv_id, turn)""",
    "best_keyword": "WITH src AS (SELECT conv_id, turn, lower(text) AS text FROM conversations)"
    + ratio("src", [k.lower() for k in catalog.KEYWORDS], 55) + f"""
SELECT conv_id, turn, {catalog.KEYWORDS!r}[no + 1] AS keyword, round(score, 6) AS score, stop::BIGINT AS "end"
FROM src LEFT JOIN best USING (conv_id, turn)""",
    "keyword_table": """WITH src AS (SELECT conv_id, turn, lower('From ' || replace(n_name, 'I', '') || '. ' || text) AS text
  FROM conversations JOIN nation ON n_nationkey = (conv_id + turn) % 25)"""
    + ratio("src", "SELECT n_nationkey, lower(n_name) FROM nation", 80) + """
SELECT conv_id, turn, n_name AS keyword, round(score, 6) AS score, stop::BIGINT AS "end"
FROM src LEFT JOIN best USING (conv_id, turn) LEFT JOIN nation ON n_nationkey = no""",
    "strip_wakeword": r"""WITH src AS (SELECT conv_id, turn, regexp_replace(lower(CASE role WHEN 'user' THEN 'Hello  Robot, '
  WHEN 'assistant' THEN 'God morning computer! ' ELSE '' END || text), '^\s+|\s+$', '', 'g') AS text FROM conversations)"""
    + ratio("src", lower_phrases(), 75) + """
SELECT conv_id, turn, score IS NOT NULL AS matched,
  CASE WHEN score IS NULL THEN text ELSE ltrim(substr(text, stop::BIGINT + 1), ' ,.!?') END AS rest
FROM src LEFT JOIN best USING (conv_id, turn)""",
    "min_length_filter": rf"""WITH {SENTENCES} SELECT doc_id, pos, sentence FROM sents
WHERE length(regexp_replace(sentence, '^\s+|\s+$', '', 'g')) >= 10""",
    "assemble_transcript": """
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, round(coalesce((SELECT avg(l_discount) FROM lineitem
  WHERE l_orderkey = conv_id), 0), 6) AS prob FROM conversations GROUP BY conv_id""",
    "trim_text": r"SELECT doc_id, regexp_replace(chr(9) || ' ' || text || ' ' || chr(10), '^\s+|\s+$', '', 'g') AS text FROM documents",
    "tick_format": """
WITH t AS (SELECT event_id, (event_id * 7919 + floor(value * 100)::BIGINT) * 10 AS ms FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS point,
  printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS comma FROM t""",
    "audio_length": """
SELECT vec_id, round(64 * (label + 20) / 16000.0::DOUBLE, 6) AS seconds, 64 * (label + 20) < 1600 AS too_short FROM embeddings""",
    "samples_to_float": f"""
WITH f AS (SELECT vec_id, embedding, ['int32', 'int16', 'int8', 'uint8', 'float32', 'int24'][label % 6 + 1] AS fmt,
  ([2147483647.0, 32767.0, 127.0, 255.0, 1.0, 1.0]::DOUBLE[])[label % 6 + 1] AS peak FROM embeddings),
r AS (SELECT vec_id, fmt, peak, CASE fmt WHEN 'float32' THEN embedding::DOUBLE[]
  WHEN 'uint8' THEN list_transform(embedding, lambda x: round((x::DOUBLE + 1) * 127))
  ELSE list_transform(embedding, lambda x: round(x::DOUBLE * peak)) END AS raw FROM f WHERE fmt <> 'int24')
SELECT vec_id, fmt, {flat('list_transform(raw, lambda v: (v / peak)::FLOAT)', 100_000)} AS samples FROM r""",
    "samples_to_pcm16": """
SELECT vec_id, array_to_string(list_transform(embedding, lambda x:
  trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (x * 4::FLOAT)::DOUBLE)) * 32767)::BIGINT::VARCHAR), ',') AS samples FROM embeddings""",
    "reframe": reframed(),
    "reframe_stream": reframed(),
    "with_preroll": f"""
SELECT vec_id, {flat('list_concat(coalesce(before, []), embedding)')} AS samples FROM
  (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)""",
    "pad_short_captures": f"""
SELECT vec_id, CASE WHEN 64 < 61 + label THEN {flat('embedding')} || repeat(',0', (8 + 61 + label - 64)::INTEGER)
  ELSE {flat('embedding')} END AS samples FROM embeddings""",
    "debounce": debounced(),
    "debounce_stream": debounced(),
    "gate_triggers": gated(),
    "gate_stream": gated(),
    "hysteresis_segments": segments(),
    "hysteresis_stream": segments(),
    "hysteresis_resets": f"""
SELECT user_id // 1000000 AS user_id, user_id % 1000000 AS epoch, segment, start_pos, end_pos FROM ({segments(source=EPOCHS, _SP=catalog.RESET_SPEECH)})""",
    "reframe_resets": """
WITH e AS (SELECT *, (SELECT count(*) FROM embeddings r WHERE r.label = v.label AND r.vec_id % 10 = 0 AND r.vec_id <= v.vec_id) AS epoch
  FROM embeddings v WHERE vec_id % 10 <> 0),
s AS (SELECT label, epoch, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM e),
n AS (SELECT label, epoch, x, row_number() OVER (PARTITION BY label, epoch ORDER BY vec_id, i) - 1 AS place FROM s)
SELECT label, epoch, place // 24 AS frame_no, string_agg(round(x::DOUBLE * 1000000)::BIGINT::VARCHAR, ',' ORDER BY place) AS samples
FROM n GROUP BY label, epoch, place // 24 HAVING count(*) = 24""",
    "speech_captures": f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_pos) AS utt_no, start_pos * 1000 AS start_us,
  end_pos * 1000 AS end_us, 'speech_end' AS ended_by FROM ({segments()}) WHERE end_pos IS NOT NULL""",
    "replay_all_events": f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type || (event_id % 2)::VARCHAR
    {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.ALL_EVENTS.items())} END AS event,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events),
r AS (SELECT user_id, event_id, event, no, {MOVED.format(state="'WAITING'", event="event")} AS state FROM e WHERE no = 1
    UNION ALL
    SELECT e.user_id, e.event_id, e.event, e.no, {MOVED.format(state="r.state", event="e.event")}
    FROM r JOIN e ON e.user_id = r.user_id AND e.no = r.no + 1)
SELECT user_id, event_id, event, state FROM r""",
    "own_embedder": """
SELECT doc_id, length(text)::VARCHAR || ',' || (length(text) - length(replace(text, ' ', '')))::VARCHAR || ','
  || (length(text) - length(replace(text, chr(10), '')))::VARCHAR AS embedding FROM documents""",
    "assemble_utterances": captured(),
    "utterance_stream": captured(),
    "while_enabled": switched(),
    "while_enabled_stream": switched(),
    "latest_score": """
SELECT user_id, event_type, max(epoch_us(ts)) AS ts_us, arg_max(value, ts) AS value FROM events GROUP BY user_id, event_type""",
    "replay_states": replay(""),
    "replay_stream": replay(""),
    "stage_durations": """
WITH n AS (SELECT user_id, event_id, upper(event_type) AS state,
  (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1000000.0::DOUBLE AS s FROM events)
SELECT user_id, event_id, state, round(s, 6) AS seconds,
  coalesce(s > CASE state WHEN 'CLICK' THEN 3600.0 WHEN 'VIEW' THEN 30000.0 END, false) AS timed_out FROM n""",
    "sample_splits": """
WITH n AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id::VARCHAR), doc_id) AS no FROM labels)
SELECT doc_id, quality, CASE WHEN no <= CASE quality WHEN 0 THEN 100 ELSE 150 END THEN 'train' ELSE 'validation' END AS split
FROM n WHERE no <= CASE quality WHEN 0 THEN 120 WHEN 1 THEN 180 END""",
    "compose_batches": """
WITH n AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id::VARCHAR), doc_id) - 1 AS no FROM labels),
b AS (SELECT doc_id, quality, CASE quality WHEN 0 THEN no // 10 WHEN 1 THEN no // 25 END AS batch_no FROM n),
full_ AS (SELECT least(count(*) FILTER (WHERE quality = 0) // 10, count(*) FILTER (WHERE quality = 1) // 25) AS k FROM labels)
SELECT doc_id, quality, batch_no FROM b, full_ WHERE batch_no < k""",
    "label_phrases": f"""
SELECT doc_id, CASE WHEN lower(w) IN ('the', 'der', 'la') THEN 'positive' WHEN lower(w) IN ('of', 'und', 'le') THEN 'adversarial'
  ELSE 'background' END AS label, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM documents) GROUP BY ALL""",
    "smoothed_labels": "SELECT doc_id, CASE quality WHEN 0 THEN 0.05 WHEN 1 THEN 0.95 END::DOUBLE AS quality FROM labels",
    "fit_clips": f"""
SELECT vec_id, {flat('embedding')} || repeat(',0', 16) AS longer, {flat('embedding[1:32]')} AS shorter FROM embeddings""",
    "calibrate_threshold": """
WITH n AS (SELECT value, count(*) FILTER (WHERE event_type = 'error') AS fp FROM events GROUP BY value),
c AS (SELECT value, sum(fp) OVER (ORDER BY value DESC) AS cum FROM n)
SELECT min(value) AS threshold, max(cum)::BIGINT AS false_positives FROM c WHERE cum / 744.0 <= 0.1""",
}

ORACLE["update_collection"] = ORACLE["build_chunks"]


ORACLE["assemble_on_timer"] = ORACLE["utterance_timer_stream"] = captured(timer_us=round(catalog.QUIET * 1_000_000))
# chunk i of a user ends at position i * frame; a capture has the chunks between its bounds and the one in front
ORACLE["speech_utterance_stream"] = f"""
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * {catalog.SPEECH['frame']} AS p,
  round(value::FLOAT::DOUBLE * 100)::BIGINT AS x FROM events),
s AS (SELECT user_id, start_pos, end_pos, row_number() OVER (PARTITION BY user_id ORDER BY start_pos) AS utt_no
  FROM ({segments()}) WHERE end_pos IS NOT NULL),
m AS (SELECT s.user_id, utt_no, p, x FROM s JOIN c ON c.user_id = s.user_id AND p <= end_pos
  AND p >= coalesce((SELECT max(f.p) FROM c f WHERE f.user_id = s.user_id AND f.p < start_pos), start_pos)),
u AS (SELECT user_id, utt_no, count(*) AS n, string_agg(x::VARCHAR, ',' ORDER BY p) AS v FROM m GROUP BY ALL)
SELECT user_id, utt_no, CASE WHEN n < 4 THEN v || repeat(',0', (6 - n)::INTEGER) ELSE v END AS samples FROM u"""
ORACLE["stage_stream"] = f"""
WITH e AS ({ORACLE["stage_durations"]})
SELECT *, false AS open FROM e
UNION ALL SELECT user_id, event_id, state, CASE state WHEN 'CLICK' THEN 3600.0 ELSE 30000.0 END::DOUBLE, true, true FROM e
WHERE timed_out OR (seconds IS NULL AND state IN ('CLICK', 'VIEW'))"""


ORACLE["plugged_store"] = """
SELECT concat_ws('-', conv_id, turn) AS chunk_id, conv_id AS doc_id, turn::INTEGER AS pos, text, md5(text) AS content_hash, role
FROM conversations"""


def _chunked(source: str) -> str:
    """Chunks with their hashes, of another source than the table."""
    made = DISTANCES + packing("numbered", "doc_id, chunk_no") + f""",
h AS (SELECT *, sha256('{BUILT_MARK}|' || text) AS content_hash FROM spans)"""
    return "WITH RECURSIVE " + made.replace("FROM documents)", f"FROM ({source}))")


ORACLE["versioned_collection"] = f"""
WITH b AS ({_chunked("SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0")} SELECT doc_id, count(*) AS before FROM h GROUP BY doc_id),
n AS ({_chunked("SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN text || ' It was revised.' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 2")}
  SELECT doc_id, chunk_no AS pos, n_tokens, content_hash FROM h)
SELECT doc_id, pos, n_tokens, content_hash, CASE WHEN doc_id % 7 IN (0, 1, 3) THEN 2 ELSE 1 END::BIGINT AS version, before
FROM n LEFT JOIN b USING (doc_id)"""


ORACLE["index_exact"] = "WITH" + nearest(3, "embeddings q JOIN embeddings c ON c.vec_id % 7 <> 3") + " SELECT * FROM hits"

ORACLE["index_topk"] = f"""
WITH held AS (SELECT embedding::DOUBLE[] AS v, md5(vec_id::VARCHAR) AS h, row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) AS n
  FROM embeddings WHERE vec_id % 5 <> 0),
many AS (SELECT floor(sqrt(count(*))) AS w FROM held),
drawn AS (SELECT v, row_number() OVER (ORDER BY min(h)) - 1 AS cell FROM held, many WHERE n <= {index.DRAWN} * w GROUP BY v),
near AS (SELECT vec_id, cell, round(1 - list_dot_product(embedding::DOUBLE[], v)
    / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 9) AS d
  FROM embeddings, drawn, many WHERE cell < w),
places AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS place FROM near),
cand AS (SELECT a.vec_id AS qid, b.vec_id AS cid FROM places a JOIN places b ON a.cell = b.cell
  WHERE a.place <= {catalog.PROBES} AND b.place = 1 AND b.vec_id % 7 <> 3),""" + nearest(
    3, "cand JOIN embeddings q ON q.vec_id = qid JOIN embeddings c ON c.vec_id = cid") + " SELECT * FROM hits"
