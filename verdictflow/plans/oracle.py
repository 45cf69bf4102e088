"""The registered queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from verdictflow.fixed_values import ACCOUNT_STATUS, CREDIT_HISTORY, LOAN_PURPOSE, PROMPT


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _label(column: str, labels: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{code}' THEN {_text(label)}" for code, label in labels.items())
    return f"CASE {column} {cases} ELSE {column} END"


_CODED = """
coded AS (
  SELECT o_orderkey,
    CASE WHEN o_totalprice >= 400000 THEN 'A13' WHEN o_orderstatus = 'F' THEN 'A11'
      WHEN o_orderstatus = 'O' THEN 'A12' ELSE 'A14' END AS c0,
    CAST(4 + o_orderkey % 69 AS INTEGER) AS c1,
    'A3' || (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) AS c2,
    'A4' || (o_custkey % 11) AS c3,
    CAST(trunc(o_totalprice / 25) AS INTEGER) AS c4,
    CAST(1 + o_custkey % 4 AS INTEGER) AS other,
    CAST(CASE WHEN o_custkey % 10 < 3 THEN 2 ELSE 1 END AS INTEGER) AS c20
  FROM orders)
"""

_DECODED = f"""{_CODED},
decoded AS (
  SELECT o_orderkey AS id_cliente, {_label("c0", ACCOUNT_STATUS)} AS status_conta_corrente,
    c1 AS duracao_credito_meses, {_label("c2", CREDIT_HISTORY)} AS historico_credito,
    {_label("c3", LOAN_PURPOSE)} AS proposito_emprestimo, c4 AS valor_credito_solicitado,
    c20 AS target_real
  FROM coded)
"""

_PROFILE = f"""{_DECODED},
profiles AS (
  SELECT *, '{{"id_cliente": ' || id_cliente
    || ', "status_conta_corrente": ' || CAST(to_json(status_conta_corrente) AS VARCHAR)
    || ', "duracao_credito_meses": ' || duracao_credito_meses
    || ', "historico_credito": ' || CAST(to_json(historico_credito) AS VARCHAR)
    || ', "proposito_emprestimo": ' || CAST(to_json(proposito_emprestimo) AS VARCHAR)
    || ', "valor_credito_solicitado": ' || valor_credito_solicitado AS open_text
  FROM decoded)
"""

_SCORED = f"""{_DECODED},
first_points AS (
  SELECT *,
    CASE WHEN status_conta_corrente IN ('< 0 DM (Saldo Negativo)', 'Sem conta corrente') THEN 3 ELSE 0 END
    + CASE WHEN historico_credito IN ('Atrasos passados', 'Conta crítica / Outros bancos') THEN 2 ELSE 0 END
    + CASE WHEN valor_credito_solicitado >= 5000 AND duracao_credito_meses >= 24 THEN 1 ELSE 0 END AS first
  FROM decoded),
all_points AS (
  SELECT *, first + CASE WHEN first > 0 AND proposito_emprestimo NOT IN ('Educação', 'Negócios')
    THEN 1 ELSE 0 END AS points
  FROM first_points),
scored AS (
  SELECT id_cliente, target_real, status_conta_corrente, proposito_emprestimo,
    CAST(CASE WHEN proposito_emprestimo IN ('A47', 'A48') THEN 0 WHEN points >= 4 THEN 2 ELSE 1 END AS INTEGER)
      AS predicao,
    CASE WHEN proposito_emprestimo IN ('A47', 'A48') THEN 'predicao_invalida_recebida=None'
      ELSE 'Risco ' || CASE WHEN points >= 4 THEN 'alto' ELSE 'baixo' END || ': ' || points || ' de 7 pontos.' END
      AS justificativa
  FROM all_points)
"""

_FILE_FIELDS = ", ".join(
    {0: "c0", 1: "c1", 2: "c2", 3: "c3", 4: "c4", 20: "c20"}.get(
        i, "other" if i in (7, 10, 12, 15, 17) else f"'A{i}' || other"
    )
    + f" AS _c{i}"
    for i in range(21)
)

_LINE_FIELDS = "[" + ", ".join(
    {0: "c0", 1: "c1::VARCHAR", 2: "c2", 3: "c3", 4: "CASE WHEN o_orderkey % 5 = 1 THEN 'x' ELSE '' END || c4", 20: "c20::VARCHAR"}.get(
        i, "other::VARCHAR" if i in (7, 10, 12, 15, 17) else f"'A{i}' || other"
    )
    for i in range(21)
) + "]"

_TABLE_ROWS = f"WITH {_SCORED} SELECT id_cliente, target_real, predicao, justificativa FROM scored"

ORACLE_SQL: dict[str, str] = {
    "decode_passthrough": f"""
        WITH {_CODED}
        SELECT o_orderkey, {_label("c0", ACCOUNT_STATUS)} AS status,
          {_label("c2", CREDIT_HISTORY)} AS history, {_label("c3", LOAN_PURPOSE)} AS purpose
        FROM coded""",
    "application_payload": f"""
        WITH {_PROFILE}
        SELECT id_cliente, open_text || ', "target_real": ' || target_real || '}}' AS value FROM profiles""",
    "json_defaults": """
        SELECT event_type,
          CASE WHEN event_type = 'signup' THEN '"abc-' || event_id || '"' WHEN event_type = 'error' THEN event_id || '.5'
            WHEN user_id < 10 THEN NULL WHEN user_id < 20 THEN 'true' ELSE CAST(event_id AS VARCHAR) END AS id_cliente,
          CASE event_type WHEN 'view' THEN NULL WHEN 'purchase' THEN CAST(user_id AS VARCHAR) ELSE '-1' END AS target_real
        FROM events""",
    "label_holdout": """
        SELECT CAST(doc_id AS VARCHAR) AS id_cliente, CAST(quality AS VARCHAR) AS target_real,
          '{"toxic": ' || toxic || ', "id_cliente": ' || doc_id || '}' AS perfil
        FROM labels""",
    "prompt_render": f"""
        WITH {_PROFILE}
        SELECT id_cliente, {_text(PROMPT)} || open_text || '}}' AS prompt FROM profiles""",
    "request_payload": f"""
        WITH {_PROFILE}
        SELECT id_cliente, '{{"model": "rubric", "prompt": '
          || CAST(to_json({_text(PROMPT)} || open_text || '}}') AS VARCHAR)
          || ', "format": "json", "stream": false}}' AS request
        FROM profiles""",
    "validate_reply": """
        SELECT event_id,
          CAST(CASE WHEN value < 5 THEN 0 WHEN event_type = 'click' THEN 1
            WHEN event_type = 'purchase' AND user_id IN (1, 2) THEN user_id
            WHEN event_type = 'view' AND user_id >= 60 THEN 2
            WHEN event_type = 'view' AND user_id >= 40 THEN 1 ELSE 0 END AS INTEGER) AS predicao,
          CASE WHEN value < 5 THEN 'erro: KeyError - ''response'''
            WHEN event_type = 'click' THEN 'evento ' || event_id
            WHEN event_type = 'error' THEN 'erro: JSONDecodeError - Expecting value: line 1 column 1 (char 0)'
            WHEN event_type = 'purchase' AND user_id IN (1, 2) THEN 'None'
            WHEN event_type IN ('purchase', 'signup') THEN 'predicao_invalida_recebida=' || user_id
            WHEN user_id < 20 THEN 'erro: AttributeError - ''list'' object has no attribute ''get'''
            WHEN user_id < 40 THEN 'predicao_invalida_recebida=None'
            WHEN user_id < 60 THEN 'sim' ELSE '' END AS justificativa
        FROM events""",
    "decode_parts": """
        SELECT l_orderkey, l_linenumber, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS part
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 7 <> 0""",
    "row_id": """
        SELECT row_number() OVER () - 1 AS row_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""",
    "scan_file": f"""
        WITH {_DECODED}
        SELECT * REPLACE (row_number() OVER () - 1 AS id_cliente) FROM decoded""",
    "scan_types": f"WITH {_CODED} SELECT {_FILE_FIELDS} FROM coded",
    "scan_lenient": f"""
        WITH {_CODED}, numbered AS (
          SELECT row_number() OVER () - 1 AS row_id, o_orderkey,
            {_LINE_FIELDS} AS fields, o_orderkey % 5 = 1 AS letters, c4, c20
          FROM coded),
        lines AS (
          SELECT *, array_to_string(CASE o_orderkey % 7 WHEN 2 THEN fields[:12] WHEN 3 THEN list_append(fields, 'A1') ELSE fields END, ' ')
            AS text, CASE WHEN o_orderkey % 7 IN (2, 3) THEN 'not 21 fields' WHEN letters THEN 'no int in _c4: x' || c4 END AS reason
          FROM numbered)
        SELECT row_id, CASE WHEN reason IS NULL THEN c4 END AS amount, CASE WHEN reason IS NULL THEN c20 END AS outcome,
          CASE WHEN reason IS NOT NULL THEN text END AS line, reason
        FROM lines""",
    "score_applications": f"""
        WITH {_SCORED}
        SELECT id_cliente, predicao, '{{"id_cliente": ' || id_cliente || ', "target_real": ' || target_real
          || ', "predicao": ' || predicao || ', "justificativa": ' || CAST(to_json(justificativa) AS VARCHAR)
          || ', "modelo": "rubric"}}' AS value
        FROM scored""",
    "scored_projection": _TABLE_ROWS,
    "score_and_land": _TABLE_ROWS,
    "insert_select": _TABLE_ROWS,
    "head_rows": f"{_TABLE_ROWS} ORDER BY id_cliente LIMIT 10",
    "confusion_matrix": f"""
        WITH {_SCORED} SELECT target_real, predicao, count(*) AS rows FROM scored GROUP BY ALL""",
    "agreement_rate": f"""
        WITH {_SCORED}, totals AS (
          SELECT count(*) AS rows, count(*) FILTER (predicao = target_real) AS hits,
            count(*) FILTER (predicao = 0) AS fallbacks
          FROM scored)
        SELECT *, round(hits / rows, 6) AS agreement, round(fallbacks / rows, 6) AS fallback_rate FROM totals""",
    "prediction_profile": f"""
        WITH {_SCORED}
        SELECT status_conta_corrente, proposito_emprestimo, predicao, count(*) AS rows FROM scored GROUP BY ALL""",
    "backlog": """
        WITH arrived AS (SELECT doc_id, count(*) AS raw_rows FROM documents GROUP BY doc_id),
          done AS (SELECT doc_id, count(*) AS scored_rows FROM labels GROUP BY doc_id)
        SELECT doc_id, raw_rows, coalesce(scored_rows, 0) AS scored_rows,
          raw_rows - coalesce(scored_rows, 0) AS pending
        FROM arrived LEFT JOIN done USING (doc_id) WHERE raw_rows > coalesce(scored_rows, 0)""",
    "topic_backlog": """
        SELECT o_orderkey AS id_cliente, 2 * count(*) AS raw_rows, count(*) AS scored_rows, count(*) AS pending
        FROM orders GROUP BY o_orderkey""",
    "stream_append": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "replay_append": """
        SELECT event_id, event_type, count(*) AS copies
        FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY event_id, event_type""",
    "replay_same_path": """
        SELECT event_id, event_type, count(*) AS copies
        FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY event_id, event_type""",
    "replay_pace": """
        WITH n AS (SELECT row_number() OVER () - 1 AS number, CAST(ceil(count(*) OVER () / 5) AS BIGINT) AS size FROM orders)
        SELECT number // size AS commit, count(*) AS rows, min(number) AS first, max(number) AS last FROM n GROUP BY ALL""",
    "calls_cut_off": """
        SELECT event_id, CAST(CASE WHEN event_id % 1000 = 0 THEN 0 ELSE 1 + event_id % 2 END AS INTEGER) AS predicao,
          CASE WHEN event_id % 1000 = 0 THEN 'erro: TimeoutError - ' ELSE '' END AS justificativa
        FROM events""",
    "score_failures": """
        SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 2 ELSE 0 END AS INTEGER) AS predicao,
          CASE event_type WHEN 'error' THEN 'erro: ConnectionError - down ' || event_id
            WHEN 'signup' THEN 'erro: TimeoutError - '
            WHEN 'purchase' THEN 'erro: TypeError - unhashable type: ''list'''
            WHEN 'click' THEN 'erro: TypeError - unhashable type: ''dict'''
            ELSE '{''a'': 1}' END AS justificativa
        FROM events""",
    "ingest_counts": f"""
        WITH {_SCORED} SELECT count(*) AS rows, count(*) FILTER (predicao = 0) AS failed FROM scored""",
    "dead_letters": """
        WITH m AS (
          SELECT event_id, user_id, event_type, event_type IN ('error', 'signup') AS bad,
            '{"id_cliente": ' || event_id || ', "target_real": ' || user_id || ', "tipo": "' || event_type || '"}' AS text
          FROM events),
        sent AS (SELECT *, CASE event_type WHEN 'error' THEN text[:-2] WHEN 'signup' THEN '[' || text || ']' ELSE text END AS said FROM m)
        SELECT CASE WHEN NOT bad THEN event_id END AS id_cliente, CAST(CASE WHEN NOT bad THEN user_id END AS INTEGER) AS target_real,
          CAST(CASE WHEN NOT bad THEN 1 END AS INTEGER) AS predicao,
          CASE WHEN bad THEN 'message is not a JSON object: ' || said ELSE event_type || ' ' || event_id END AS justificativa,
          CASE WHEN bad THEN said END AS message
        FROM sent""",
    "call_counts": f"""
        WITH {_SCORED}
        SELECT id_cliente % 4 AS batch, count(*) AS asked, count(*) AS answered, CAST(0 AS BIGINT) AS waiting,
          count(*) FILTER (predicao = 0) AS fallbacks, count(*) AS timed, true AS ordered
        FROM scored GROUP BY ALL""",
    "live_backlog": """
        WITH raw AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id),
          done AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id),
          sides AS (SELECT doc_id, coalesce(raw.n, 0) AS sent, coalesce(done.n, 0) AS judged FROM raw FULL JOIN done USING (doc_id)),
          states AS (
            SELECT 0 AS commit, doc_id, sent AS pending FROM sides UNION ALL SELECT 1, doc_id, sent - judged FROM sides
            UNION ALL SELECT 2, doc_id, 2 * sent - judged FROM sides)
        SELECT * FROM states WHERE pending <> 0""",
    "snapshot_as_of": """
        SELECT event_id, user_id, event_type, ts,
          CAST(CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 ELSE 1 END AS BIGINT) AS snapshot_id
        FROM events WHERE ts < TIMESTAMP '2024-01-21'""",
    "snapshot_audit": """
        SELECT CAST(CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END
          AS BIGINT) AS snapshot_id, count(*) AS rows
        FROM events GROUP BY ALL""",
    "snapshot_rollback": """
        SELECT event_id, user_id, event_type, ts, CAST(0 AS BIGINT) AS snapshot_id
        FROM events WHERE ts < TIMESTAMP '2024-01-11'""",
    "snapshot_compact": """
        SELECT event_id, user_id, event_type, ts,
          CAST(CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS BIGINT) AS snapshot_id
        FROM events""",
}
