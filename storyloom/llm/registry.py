"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, lines, lm, merkle, mixing, packing, quality, secrets, simhash, tokens, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (tokens.op1_token_ids, decontaminate.op2_decontamination, secrets.op3_secret_scan, toxicity.op4_toxicity, simhash.op5_simhash, quality.op6_quality_rules, lm.op7_lm_score, lines.op8_line_dedup, chat.op9_chat_format, mixing.op10_mixing, whitening.op11_whitening, packing.op12_packing, merkle.op13_merkle)}

_ESCAPES = " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in (r"\\", r"<\|", "</?s>", r"\[/?INST\]", r"[<\[]</?SYS>>", r"[<\[]/?SYS>>"))

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE,
    "op9_chat_format": rf"""
        WITH probe AS (
            SELECT -1 AS conv_id, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) v(turn, role, t)
        ), m AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT * FROM probe
        ), c AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t) AS told,
                   coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '') AS loss,
                   sum(len('<|turn|><|body|><|end|>') + len(role) + len(t) + {_ESCAPES}) AS chars
            FROM m GROUP BY conv_id
        )
        SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256,
               CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
        FROM c""",
}
