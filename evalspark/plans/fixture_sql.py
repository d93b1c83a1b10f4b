"""The D1-D9 derivations as SQL text (DuckDB dialect) for the oracle queries.

They mirror ``evalspark.sources.fixtures`` expression by expression and
are used only to build the independent DuckDB side of the correctness
check. Text columns are whole.
"""

D1 = """
SELECT d.doc_id AS item_no, concat('run', CAST(d.doc_id % 4 AS VARCHAR)) AS run_id,
       d.lang AS subcategory, CASE WHEN d.n_chars % 13 = 0 THEN NULL ELSE d.source END AS subset,
       l.quality AS gt_answer, CASE WHEN l.quality = 1 THEN ' Yes' ELSE 'NO ' END AS ground_truth,
       CASE WHEN d.n_chars % 11 = 0 THEN 'unclear' WHEN d.n_chars % 5 = 0 THEN '**No**, it is not.'
            WHEN d.n_chars % 7 = 0 THEN 'yes?' ELSE 'Yes.' END AS verdict
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

D2 = """
SELECT 2 * x.doc_id + x.k AS item_no, CASE WHEN x.doc_id % 23 <> 0 THEN x.doc_id END AS picture_name,
       CASE x.doc_id % 4 WHEN 0 THEN 'existence' WHEN 1 THEN 'count' WHEN 2 THEN 'OCR' ELSE 'code_reasoning' END AS subset,
       x.lang AS category, x.source AS subcategory,
       CASE WHEN (CASE WHEN x.k = 0 THEN x.quality ELSE x.toxic END) = 1 THEN 'Yes' ELSE 'No' END AS ground_truth,
       CASE WHEN (x.n_chars + x.k) % 9 = 0 THEN 'unclear' WHEN (x.n_chars + x.k) % 3 = 0 THEN 'No.'
            WHEN x.k = 0 THEN 'yes' ELSE 'no' END AS verdict,
       CASE WHEN x.k = 0 THEN '(a)' ELSE '(b)' END AS correct_answer,
       CASE WHEN (x.n_chars + x.k) % 4 = 0 THEN 'unclear' WHEN x.k = 0 THEN 'The choice is (A)' ELSE '(b)' END AS choice_verdict
FROM (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, unnest([0, 1]) AS k
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x
"""

D3 = """
SELECT c.c_custkey AS item_no, o.choices, c.c_mktsegment AS question_type,
       CASE c.c_custkey % 3 WHEN 0 THEN replace(n.n_name, '_', ' ') WHEN 1 THEN lower(n.n_name) ELSE reverse(n.n_name) END AS answer_text,
       CASE c.c_custkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS answer_letter,
       CASE c.c_custkey % 5 WHEN 0 THEN 'unclear' WHEN 1 THEN 'A' WHEN 2 THEN '(B)' ELSE 'I pick (A).' END AS verdict
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN (SELECT n_regionkey, list_sort(array_agg(n_name)) AS choices FROM nation GROUP BY n_regionkey) o ON n.n_regionkey = o.n_regionkey
"""

D4 = """
SELECT e.event_id AS item_no, CASE WHEN e.event_type = 'click' THEN 'multi_choice' ELSE 'free_form' END AS question_type,
       CASE WHEN e.event_type = 'click' THEN 'B'
            WHEN e.event_type = 'view' THEN CAST(CAST(e.value AS DECIMAL(10,2)) AS VARCHAR)
            WHEN e.event_type = 'error' THEN concat('[', CAST(e.user_id AS VARCHAR), ', ', CAST(e.event_id % 7 AS VARCHAR), ']')
            WHEN e.event_type = 'signup' AND e.event_id % 24 = 5 THEN repeat(CAST(e.user_id AS VARCHAR), 20)
            WHEN e.event_type = 'signup' THEN CAST(e.user_id AS VARCHAR) ELSE 'about ten' END AS answer,
       CASE WHEN e.event_id % 5 = 0 THEN 'unclear'
            WHEN e.event_type = 'signup' AND e.event_id % 48 = 5 THEN concat(' +00', repeat(CAST(e.user_id AS VARCHAR), 20))
            WHEN e.event_type = 'signup' AND e.event_id % 48 = 29 THEN concat(repeat(CAST(e.user_id AS VARCHAR), 20), '1')
            WHEN e.event_type = 'signup' AND e.event_id % 24 = 7 THEN repeat(CAST(e.user_id AS VARCHAR), 2000)
            WHEN e.event_type = 'signup' AND e.event_id % 24 = 11 THEN translate(CAST(e.user_id AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩')
            WHEN e.event_type = 'click' THEN CASE e.event_id % 2 WHEN 0 THEN 'B.' ELSE 'a' END
            WHEN e.event_type = 'view' THEN concat(CAST(CAST(e.value AS DECIMAL(10,2)) AS VARCHAR), CASE e.event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE 'd' END)
            WHEN e.event_type = 'error' THEN concat('[', CAST(e.user_id AS VARCHAR), ',', CAST(e.event_id % 7 AS VARCHAR), CASE e.event_id % 3 WHEN 0 THEN '.0]' ELSE ']' END)
            WHEN e.event_type = 'signup' THEN concat(CASE e.event_id % 4 WHEN 0 THEN '+' WHEN 1 THEN ' ' ELSE '' END, CAST(e.user_id AS VARCHAR), CASE e.event_id % 3 WHEN 0 THEN '.0' ELSE '' END)
            ELSE 'about ten' END AS verdict
FROM events e
"""

# the options as a list, its literal text is the fixture's
D4_MATH = """
SELECT b.item_no, b.question_type, x.choices, x.skills, coalesce(x.option_answer, b.answer) AS answer,
       coalesce(x.option_verdict, b.verdict) AS verdict
FROM d4 b JOIN (
  SELECT e.event_id AS item_no,
         CASE WHEN e.event_type <> 'click' OR e.event_id % 11 = 0 THEN NULL
              WHEN e.event_id % 13 = 0 THEN ['it''s ' || e.user_id::VARCHAR, 'user ' || e.user_id::VARCHAR]
              ELSE ['user ' || e.user_id::VARCHAR, 'event ' || (e.event_id % 7)::VARCHAR,
                    'value ' || coalesce(CAST(e.value AS DECIMAL(10,2))::VARCHAR, 'none')] END AS choices,
         CASE WHEN e.event_type <> 'click' THEN NULL WHEN e.event_id % 3 = 0 THEN 'User ' || e.user_id::VARCHAR
              WHEN e.event_id % 3 = 1 THEN 'event'
              ELSE 'value: ' || coalesce(CAST(e.value AS DECIMAL(10,2))::VARCHAR, 'none') END AS option_answer,
         CASE WHEN e.event_type <> 'click' THEN NULL WHEN e.event_id % 5 = 0 THEN 'unclear'
              WHEN e.event_id % 4 = 0 THEN 'A.' WHEN e.event_id % 4 = 1 THEN '(b)' WHEN e.event_id % 4 = 2 THEN 'c'
              ELSE 'B' END AS option_verdict,
         CASE WHEN e.event_id % 17 = 0 THEN [e.event_type]
              ELSE [e.event_type, 'parity ' || (e.event_id % 2)::VARCHAR] END AS skills
  FROM events e) x ON b.item_no = x.item_no
"""

D5 = """
SELECT d.doc_id AS item_no, CASE WHEN d.n_chars % 3 = 0 THEN 0 ELSE 1 END AS sign,
       concat('{', chr(39), 'skills', chr(39), ': [', chr(39), d.lang, chr(39), ', ', chr(39),
              CASE WHEN d.doc_id % 3 = 0 THEN d.lang ELSE d.source END, chr(39), '], ', chr(39), 'grade', chr(39), ': ',
              CAST(d.n_chars % 12 AS VARCHAR), '}') AS metadata
FROM documents d
"""

D6 = """
SELECT CAST((d.doc_id - d.doc_id % 3) / 3 AS BIGINT) AS item_id, d.doc_id % 3 + 1 AS attempt,
       CASE WHEN d.n_chars % 4 = 0 THEN concat(' ', chr(10), ' ')
            WHEN d.doc_id % 17 = 0 THEN 'Sorry, I cannot answer that.'
            WHEN d.doc_id % 2 = 0 THEN concat('Reasoning Steps:', chr(10), 'Look: first', chr(10), d.text)
            ELSE d.text END AS generation
FROM documents d
"""

D7 = """
SELECT c.conv_id AS item_id, c.turn + 1 AS step, c.role, c.text AS response,
       concat('Question ', CAST(c.conv_id AS VARCHAR), ' {question}?') AS prompt, 'iVBORw0KGgo=' AS image,
       CASE WHEN c.conv_id % 3 = 0 THEN 1 ELSE 0 END AS already_done
FROM conversations c
"""

D7_GENERATIONS = """
SELECT c.item_id, k.attempt,
       CASE WHEN (k.attempt = 1 AND c.item_id % 4 = 0) OR (k.attempt = 2 AND c.item_id % 8 = 0) OR c.item_id % 16 = 0
            THEN concat(' ', chr(10), ' ')
            WHEN k.attempt = 1 AND c.item_id % 5 = 0 THEN 'I cannot answer this.'
            ELSE concat('Reasoning steps:', chr(10), array_to_string(list_transform(generate_series(1, c.n),
                        lambda i: concat('Look at turn ', i::VARCHAR, ': who speaks')), chr(10))) END AS generation
FROM (SELECT conv_id AS item_id, count(*) AS n FROM conversations GROUP BY conv_id) c,
     (SELECT unnest([1, 2, 3]) AS attempt) k
"""

D8 = """
SELECT d.doc_id AS item_no, d.lang AS answer,
       concat('A. ', d.lang, chr(10), 'B. ', d.source, chr(10)) AS options,
       CASE d.doc_id % 4 WHEN 0 THEN 'free_answer' WHEN 1 THEN 'yes_no' WHEN 2 THEN 'choice' ELSE 'number' END AS kind,
       CASE WHEN d.doc_id % 10 = 0 THEN repeat('go ', 12) ELSE d.text END AS response,
       CASE d.n_chars % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'Correct' ELSE 'unclear' END AS verdict
FROM documents d
"""

D9 = """
SELECT p.page_id AS item_id,
       CASE p.page_id % 3 WHEN 0 THEN 'You are a careful judge.' WHEN 1 THEN '' ELSE NULL END AS system_text,
       p.url AS query,
       to_base64(unhex(CASE p.page_id % 5 WHEN 0 THEN 'FFD8FFE000104A464946' WHEN 1 THEN '89504E470D0A1A0A'
                       WHEN 2 THEN '474946383961' WHEN 3 THEN '524946462400000057454250' ELSE NULL END) || encode(p.url)) AS image
FROM pages p
"""


def with_fixtures(body: str, **fixtures: str) -> str:
    """``WITH name AS (...) , ... body`` for the given fixture CTEs."""
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in fixtures.items())
    return f"WITH {ctes}\n{body.strip()}"
