"""DuckDB SQL with the results of the interaction queries."""

from __future__ import annotations

CLICKS = """
clicks AS (
  SELECT *, ['Screening CVs or job applications', 'Credit scoring or insurance risk',
             'Eligibility for public benefits or services', 'Safety-critical systems or infrastructure',
             'General productivity tools (Copilot, ChatGPT, etc.)', 'We don''t use AI yet'][event_id % 6 + 1] AS option
  FROM events),
per_option AS (
  SELECT user_id, option, count(*) AS n, max(ts) AS last_ts, max(event_id) AS last_id FROM clicks GROUP BY ALL),
answers AS (
  SELECT user_id, coalesce(list(option ORDER BY last_ts, last_id) FILTER (n % 2 = 1), []) AS selected,
         ['Yes', 'No', 'Not sure', ''][user_id % 4 + 1] AS in_scope
  FROM per_option GROUP BY user_id)
"""
HIGH = """len(list_filter(selected, lambda x: x IN ('Screening CVs or job applications', 'Credit scoring or insurance risk',
  'Eligibility for public benefits or services', 'Safety-critical systems or infrastructure'))) > 0"""
RESULT = f"""CASE WHEN in_scope = 'Not sure' THEN 'unsure' WHEN {HIGH} AND in_scope = 'Yes' THEN 'high'
  WHEN NOT ({HIGH}) OR in_scope = 'No' THEN 'low' ELSE 'unsure' END"""
TARGET = """CASE p_partkey % 4 WHEN 0 THEN p_size || '+' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || chr(10) ELSE p_name END"""
FIRST_USE = "'Screening CVs or job applications'"
SUBMISSIONS = r"""
submissions AS (
  SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name,
         CASE WHEN c_custkey % 7 = 0 THEN c_name || '@' ELSE lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@mail.example' END AS email,
         CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS message,
         CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE '' END AS bot_field
  FROM customer),
checked AS (
  SELECT *, regexp_matches(email, '^[A-Za-z0-9.]+@[a-z]+(\.[a-z]+)*$') AS email_ok FROM submissions)
"""

ORACLE_SQL: dict[str, str] = {
    "r01_multi_select_toggle": """
        WITH o AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY ALL)
        SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY last_ts) FILTER (n % 2 = 1), '') AS selected FROM o GROUP BY user_id""",
    "r02_single_select": """
        SELECT user_id, event_type AS selected FROM
          (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1""",
    "r03_rule_classifier": f"WITH {CLICKS} SELECT user_id, in_scope, {RESULT} AS result FROM answers",
    "r04_any_of": f"WITH {CLICKS} SELECT user_id, {HIGH} AS any_high_risk FROM answers",
    "r05_array_edits": f"""
        WITH {CLICKS}
        SELECT user_id, list_contains(selected, {FIRST_USE}) AS has_option,
               coalesce(array_to_string(list_filter(selected, lambda x: x <> {FIRST_USE}), ';'), '') AS dropped,
               array_to_string(list_append(selected, {FIRST_USE}), ';') AS appended,
               coalesce(CASE WHEN list_contains(selected, {FIRST_USE}) THEN array_to_string(list_filter(selected, lambda x: x <> {FIRST_USE}), ';')
                    ELSE array_to_string(list_append(selected, {FIRST_USE}), ';') END, '') AS toggled
        FROM answers""",
    "r08_can_advance": f"WITH {CLICKS} SELECT user_id, len(selected) > 0 AS uses_complete, in_scope <> '' AS scope_complete FROM answers",
    "r09_is_selected": f"""
        WITH {CLICKS}
        SELECT user_id, CASE WHEN user_id % 2 = 0 THEN list_contains(selected, 'Credit scoring or insurance risk') ELSE in_scope = 'Yes' END AS is_selected
        FROM answers""",
    "r10_step_machine": """
        WITH RECURSIVE acts AS (
          SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
        walk AS (
          SELECT user_id, 0 AS place, 0 AS state FROM (SELECT DISTINCT user_id FROM acts)
          UNION ALL
          SELECT w.user_id, a.place::INTEGER,
                 CASE WHEN a.event_type = 'error' THEN 0 WHEN w.state = 4 THEN 4 WHEN a.event_type = 'click' THEN w.state + 1
                      WHEN a.event_type = 'view' AND w.state > 0 THEN w.state - 1 ELSE w.state END
          FROM walk w JOIN acts a ON a.user_id = w.user_id AND a.place = w.place + 1)
        SELECT user_id, arg_max(state, place) AS state FROM walk GROUP BY user_id""",
    "r11_days_until_deadline": """
        SELECT event_id, ceil((epoch_us(TIMESTAMP '2026-08-02 00:00:00') - epoch_us(ts)) / 86400000000.0)::BIGINT AS days_left FROM events""",
    "r12_result_lookup": f"""
        WITH {CLICKS}, results(result, heading, link) AS (VALUES
          ('high', 'Your systems likely fall under Annex III.', '/contact'), ('low', 'You''re likely outside the highest-risk categories.', '/services'),
          ('unsure', 'Hard to say without a bit more context.', '/contact'))
        SELECT user_id, result, heading, link FROM (SELECT user_id, {RESULT} AS result FROM answers) JOIN results USING (result)""",
    "r13_parse_counter": rf"""
        WITH t AS (SELECT p_partkey, {TARGET} AS target FROM part)
        SELECT p_partkey, TRY_CAST(nullif(regexp_extract(target, '\A([0-9]+)(\+?)\z', 1), '') AS BIGINT) AS number,
               CASE WHEN regexp_matches(target, '\A[0-9]+\+?\z') THEN regexp_extract(target, '\A([0-9]+)(\+?)\z', 2) END AS suffix FROM t""",
    "r15_ease_out": """
        SELECT l_orderkey, l_linenumber,
               floor((1 - pow(1 - least(l_quantity * 40.0 / 1200.0, 1.0), 3)) * l_extendedprice + 0.5)::BIGINT AS shown FROM lineitem""",
    "r16_still_or_moving": rf"""
        WITH t AS (SELECT p_partkey, {TARGET} AS target FROM part),
        n AS (SELECT *, TRY_CAST(nullif(regexp_extract(target, '\A([0-9]+)(\+?)\z', 1), '') AS BIGINT) AS number,
                     regexp_extract(target, '\A([0-9]+)(\+?)\z', 2) AS suffix FROM t)
        SELECT p_partkey, CASE WHEN number IS NULL OR p_partkey % 3 = 0 THEN target ELSE
          floor((1 - pow(1 - least((p_partkey % 13) * 100.0 / 1200.0, 1.0), 3)) * number + 0.5)::BIGINT || suffix END AS display FROM n""",
    "r17_one_shot_latch": "SELECT user_id, arg_min(event_id, ts) AS first_event FROM events WHERE value >= 15 GROUP BY user_id",
    "r18_delayed_effect": "SELECT event_id, epoch_us(ts) + (event_id % 7) * 80000 AS due_micros FROM events",
    "r19_threshold_state": "SELECT user_id, arg_max(value > 15, ts) AS above FROM events GROUP BY user_id",
    "r20_flip": "SELECT user_id, count(*) % 2 = 1 AS open FROM events WHERE event_type = 'click' GROUP BY user_id",
    "r21_class_list": "SELECT o_orderkey, 'page ' || o_orderpriority || CASE WHEN o_orderstatus = 'O' THEN ' locked' ELSE '' END AS classes FROM orders",
    "r22_link_style": """
        WITH l(href) AS (VALUES ('/'), ('/services'), ('/about'), ('/contact')),
        p AS (SELECT page_id, ['/', '/services', '/about', '/contact'][page_id % 4 + 1] AS path FROM pages)
        SELECT page_id, href, CASE WHEN path = href THEN 'current' WHEN page_id % 2 = 0 THEN 'on_light' ELSE 'on_dark' END AS style FROM p, l""",
    "r23_query_flag": r"SELECT page_id, coalesce(regexp_extract(url, '[?&]page=([^&#]*)', 1) = '2', false) AS is_second_page FROM pages",
    "r24_required_fields": f"WITH {SUBMISSIONS} SELECT c_custkey, email_ok, name <> '' AND email_ok AND message <> '' AS is_valid FROM checked",
    "r25_form_sink": f"""
        WITH {SUBMISSIONS} SELECT c_custkey, name, email, message, 'contact' AS form_name
        FROM checked WHERE bot_field = '' AND name <> '' AND email_ok AND message <> ''""",
    "r26_projection": "SELECT p_partkey + 1 AS number, upper(p_name) AS label, '/parts/' || (p_partkey + 1) AS href FROM part",
    "r27_indexed_map": """
        SELECT vec_id, i, i * 80 AS delay_ms, CASE WHEN i >= 6 THEN 'accent' ELSE 'plain' END AS colour,
               CASE WHEN i < 6 THEN 0.6::DOUBLE + i * 0.06::DOUBLE ELSE 1.0::DOUBLE END AS opacity
        FROM (SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings)""",
    "r27_union_offset": """
        SELECT i, i * 80 AS delay_ms, name FROM (
          SELECT r_regionkey AS i, r_name AS name FROM region UNION ALL SELECT n_nationkey + 5, n_name FROM nation)""",
    "r28_positional_lookup": """
        SELECT event_id, ['What does your organisation use AI for?', 'Is your organisation based in the EU or serving EU customers?',
               'How many people work in your organisation?', 'When did you last review your AI policies or governance?'][event_id % 6 + 1] AS question
        FROM events""",
    "r29_json": """
        SELECT event_id, '{"user":' || user_id || ',"kind":"' || event_type || '","place":{"zip":null,"phone":""}}' AS json FROM events""",
    "r30_template": """
        SELECT event_id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END || ' visitor ' || user_id || ' in ' || year(ts) AS line,
               year(ts)::INTEGER AS year FROM events""",
}
