"""Domain inputs derived from the benchmark tables.

The tables hold no clips, so each query builds the shape it needs with a plain
SELECT that Spark and the reference database read alike.
"""

RESPONSES = """
SELECT d.doc_id, 'exp_' || CAST(d.doc_id % 3 AS STRING) AS exp_name,
       'doc_' || CAST(d.doc_id AS STRING) || '.mp4' AS file,
       d.n_chars / 1000.0E0 AS seconds, d.n_chars % 11 = 0 AS is_error,
       CASE d.doc_id % 8
         WHEN 0 THEN 'Classification: Anomaly'
         WHEN 1 THEN '<think>maybe an anomaly</think> classification:   NORMAL'
         WHEN 2 THEN 'This is an anomaly.'
         WHEN 3 THEN 'All normal here'
         WHEN 4 THEN 'normal at first, then an anomaly'
         WHEN 5 THEN 'an anomaly? no, abnormal'
         WHEN 6 THEN 'cannot tell' END || ' ' || d.text AS raw_output
FROM {documents} d
"""

TRUTH = "SELECT doc_id, 1 - quality AS true_label FROM {labels}"

SENTENCES = """
SELECT doc_id,
       text || CASE doc_id % 7
         WHEN 0 THEN ' A bag lies ahead. The car decelerates to a stop. (at least 2 seconds) (end)'
         WHEN 1 THEN ' Clear road! The car starts moving.'
         WHEN 2 THEN ' Is it a wall? The car continues at speed without slowing down.'
         WHEN 3 THEN ' Glare. The car slows down before resuming nominal speed.'
         WHEN 4 THEN ' The car steers around the cones at cruising pace.'
         WHEN 5 THEN '(only a note) (another note)'
         ELSE '' END AS prompt_text
FROM {documents}
"""

# One clip per 60 (samples) or 61 (poses) consecutive events, dense index inside.
SAMPLES = """
SELECT CAST((event_id - event_id % 60) / 60 AS BIGINT) AS clip, event_id % 60 AS i,
       value / 10.0E0 AS v, CAST(event_id % 37 - 18 AS DOUBLE) / 2.0E0 AS h
FROM {events}
"""

EXPECTED = """
SELECT DISTINCT CAST((event_id - event_id % 60) / 60 AS BIGINT) AS clip,
       CASE CAST((event_id - event_id % 60) / 60 AS BIGINT) % 4
         WHEN 0 THEN 'accelerate' WHEN 1 THEN 'decelerate' WHEN 2 THEN 'maintain' END AS exp_speed,
       CAST((event_id - event_id % 60) / 60 AS BIGINT) % 3 = 0 AS exp_steer
FROM {events}
"""

POSES = """
SELECT CAST((event_id - event_id % 61) / 61 AS BIGINT) AS clip, event_id % 61 AS k,
       value / 100.0E0 AS px, CAST(event_id % 50 AS DOUBLE) / 10.0E0 AS pz,
       SIN(CAST(event_id * 7 % 63 AS DOUBLE) / 10.0E0) AS fx,
       COS(CAST(event_id * 7 % 63 AS DOUBLE) / 10.0E0) AS fz
FROM {events}
"""

CLIP_PATHS = """
SELECT event_id,
       'final/set_' || CAST(CAST((event_id - event_id % 240) / 240 AS BIGINT) AS STRING) ||
       CASE event_id % 3 WHEN 0 THEN '/negative_scenarios/negative_scenarios_variants'
                         WHEN 1 THEN '/positive_scenarios/positive_scenarios_filtered'
                         ELSE '/misc' END ||
       '/prompt_' || CAST(event_id % 12 AS STRING) || '_v' ||
       LPAD(CAST(CAST((event_id - event_id % 12) / 12 AS BIGINT) % 20 + 1 AS STRING), 2, '0') || '.mp4' AS rel_path
FROM {events}
"""

DONE_PATHS = """
SELECT 'final/set_' || CAST(CAST((doc_id - doc_id % 240) / 240 AS BIGINT) AS STRING) ||
       CASE doc_id % 3 WHEN 0 THEN '/negative_scenarios/negative_scenarios_variants'
                       WHEN 1 THEN '/positive_scenarios/positive_scenarios_filtered'
                       ELSE '/misc' END ||
       '/prompt_' || CAST(doc_id % 12 AS STRING) || '_v' ||
       LPAD(CAST(CAST((doc_id - doc_id % 12) / 12 AS BIGINT) % 20 + 1 AS STRING), 2, '0') || '.mp4' AS rel_path
FROM {documents}
"""

# Prompt files of up to twelve lines in the mirrored tree, one of them at the top.
PROMPT_LINES = """
SELECT CASE WHEN f = 3 THEN 'final'
            ELSE 'final/set_' || CAST(CAST((f - f % 4) / 4 AS BIGINT) AS STRING) ||
                 CASE f % 4 WHEN 0 THEN '/negative_scenarios/negative_scenarios'
                            WHEN 1 THEN '/positive_scenarios'
                            WHEN 2 THEN '/positive_scenarios'
                            ELSE '' END END AS dir,
       CASE f % 4 WHEN 2 THEN 'updated_human_prompt.txt' ELSE 'prompt.txt' END AS filename,
       doc_id % 12 AS line_no, prompt_text AS text
FROM (SELECT doc_id, CAST((doc_id - doc_id % 12) / 12 AS BIGINT) AS f,
             text || CASE doc_id % 3 WHEN 0 THEN ' The car stops. (note)' WHEN 1 THEN ' Go! It drives on.' ELSE '' END
               AS prompt_text
      FROM {documents}) t
"""

SKIP_LIST = """
SELECT CASE quality WHEN 1 THEN 'negative' ELSE 'positive' END AS tree,
       'prompt_' || CAST(doc_id % 12 AS STRING) || '_v' ||
       LPAD(CAST(CAST((doc_id - doc_id % 12) / 12 AS BIGINT) % 20 + 1 AS STRING), 2, '0') || '.mp4' AS file_name
FROM {labels} WHERE toxic = 1
"""

LOG_LINES = """
SELECT event_id AS line_no,
       CASE WHEN event_type = 'error'
            THEN 'FLAG  clip_' || CAST(user_id AS STRING) || '.mp4: expected=maintain n=' || CAST(event_id % 9 AS STRING)
            ELSE 'NOTE  clip_' || CAST(user_id AS STRING) || '.mp4: no matching prompt sentence' END AS line
FROM {events}
"""

LABEL_STORE = """
SELECT event_id AS row_no, 'clip_' || CAST(user_id AS STRING) || '.mp4' AS rel_path,
       CASE WHEN event_id % 2 = 0 THEN 'Valid' ELSE 'Invalid' END AS label,
       CASE WHEN event_type = 'error' THEN 'FLAGGED' ELSE 'OK' END AS heuristic,
       CASE WHEN event_id % 4 = 0 THEN '' ELSE 'c' || CAST(event_id % 10 AS STRING) END AS comment
FROM {events}
"""

LABEL_UPDATES = """
SELECT c_custkey AS seq,
       'clip_' || CAST(CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT) AS STRING) || '.mp4' AS rel_path,
       CASE WHEN c_acctbal > 0 THEN 'Valid' ELSE 'Invalid' END AS label, 'OK' AS heuristic, c_name AS comment
FROM {customer}
"""

TRAJECTORY_TEXTS = """
SELECT event_id,
       CASE event_id % 10
         WHEN 0 THEN '[[' || CAST(value AS STRING) || ', 1.5], [3, 4, 9]]'
         WHEN 1 THEN 'oops ' || CAST(event_id AS STRING)
         WHEN 2 THEN '[]'
         WHEN 3 THEN props
         WHEN 4 THEN '[[' || CAST(event_id AS STRING) || ']]'
         WHEN 5 THEN '[["' || CAST(event_id AS STRING) || '.5", 2]]'
         WHEN 6 THEN '[[NaN, ' || CAST(event_id AS STRING) || ']]'
         WHEN 7 THEN '[[' || CAST(event_id AS STRING) || ', null]]'
         WHEN 8 THEN '[[1, 2], [' || CAST(event_id AS STRING) || ', "x"]]'
       END AS txt
FROM {events}
"""

WRAPPED_PROMPTS = """
SELECT event_id,
       CASE event_id % 5
         WHEN 0 THEN props
         WHEN 1 THEN '{{"prompt": "' || REPLACE(props, '"', chr(92) || '"') || '"}}'
         WHEN 2 THEN '{{"prompt": ' || props || '}}'
         WHEN 3 THEN 'oops ' || props
         ELSE '{{"prompt": "not json ' || event_type || '"}}' END AS j
FROM {events}
"""

TIME_RANGES = """
SELECT o_orderkey,
       '0:00-0:' || LPAD(CAST(o_orderkey % 4 + 1 AS STRING), 2, '0') || '|0:' ||
       LPAD(CAST(o_orderkey % 5 + 1 AS STRING), 2, '0') || '-0:0' || CAST(o_orderkey % 3 + 4 AS STRING) ||
       CASE o_orderpriority WHEN '1-URGENT' THEN '|soon' ELSE '' END AS ranges,
       CAST(o_custkey % 3 + 4 AS STRING) || 's' AS duration
FROM {orders}
"""

FRAMES = """
SELECT clip, idx, CASE clip % 4 WHEN 0 THEN 24.0E0 WHEN 1 THEN 25.0E0 WHEN 2 THEN 0.0E0 END AS native_fps
FROM (SELECT CAST((event_id - event_id % 45) / 45 AS BIGINT) AS clip, event_id % 45 AS idx FROM {events}) t
"""

PROBES = """
SELECT p_partkey,
       CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) || '.5' WHEN 1 THEN 'N/A' WHEN 2 THEN '0' END AS duration,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size * 24 AS STRING) END AS nb_frames,
       CASE p_partkey % 3 WHEN 0 THEN '24/1' WHEN 1 THEN '' ELSE '0/0' END AS avg_rate,
       '30000/1001' AS real_rate
FROM {part}
"""

MATRIX = """
SELECT 'v' || LPAD(CAST(n_nationkey + 1 AS STRING), 2, '0') AS row, n_name AS weather, r_name AS region
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

BASE_PROMPTS = "SELECT p_partkey AS prompt_idx, p_name AS scenario FROM {part}"

OVERRIDES = """
SELECT s_suppkey AS prompt_idx, 'v02' AS row, 'weather' AS axis, s_name AS value FROM {supplier}
"""

BASE_DOCUMENTS = """
SELECT c_custkey AS prompt_idx,
       '{{"subjects":[{{"description":"' || c_name || '","number_of_subjects":1,"number_of_arms":0,"number_of_legs":4}}],' ||
       '"lighting":{{"conditions":"clear","shadows":"long"}},"aesthetics":{{"patterns":"none"}},' ||
       '"actions":[],"segments":[{{"time_range":"0:00-0:05"}}],"duration":"5s","fps":24,' ||
       '"resolution":{{"H":720,"W":1280}},"aspect_ratio":"16,9"}}' AS json
FROM {customer}
"""

VARIANT_DOCUMENTS = """
SELECT 'prompt_' || CAST(o_custkey AS STRING) || '_' || CAST(o_orderkey AS STRING) AS file, o_custkey AS prompt_idx,
       '{{"subjects":[' || CASE o_orderkey % 7 WHEN 0 THEN '' ELSE '{{"description":"' ||
       CASE o_orderkey % 3 WHEN 0 THEN 're-skinned' ELSE 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END ||
       '","number_of_subjects":1,"number_of_arms":0,"number_of_legs":' || CASE o_orderstatus WHEN 'P' THEN '2' ELSE '4' END || '}}' END ||
       CASE o_orderkey % 7 WHEN 1 THEN ',{{"description":"b","pose":"c"}},{{}}' ELSE '' END || '],' ||
       '"lighting":{{"conditions":"rain","shadows":"none"}},"aesthetics":{{"patterns":"wet"}},' ||
       '"actions":[],"segments":[{{"time_range":"0:00-0:0' || CASE o_orderstatus WHEN 'F' THEN '4' ELSE '5' END || '"}}],"duration":"' ||
       CASE o_orderpriority WHEN '5-LOW' THEN '8s' ELSE '5s' END || '","fps":' ||
       CASE o_orderstatus WHEN 'F' THEN '25' ELSE '24' END || ',' ||
       '"resolution":{{"H":720,"W":1280}},"aspect_ratio":"16,9"' ||
       CASE o_orderpriority WHEN '1-URGENT' THEN ',"extra":1' ELSE '' END || '}}' AS json
FROM {orders}
"""

CONVERSATION_ROWS = "SELECT conv_id * 1000 + turn AS row_id, role, text FROM {conversations}"

ACTIONS_LONG = "SELECT vec_id, embedding FROM {embeddings}"
