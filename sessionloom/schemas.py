"""Schemas of the tables: sessions, messages, parts and what is derived from them.

Every ordered list has an explicit index, and missing values are the type's
default rather than null, as in the session files.
"""

from __future__ import annotations

SESSIONS = "session_id string, title string, directory string, created_ms long, updated_ms long"
MESSAGES = "session_id string, msg_idx int, role string, created_ms long, finish string, error string, tokens_total long"
PARTS = (
    "session_id string, msg_idx int, part_idx int, type string, text string, tool string, call_id string, status string, "
    "input_json string, output string, hash string, files array<string>, prompt string, description string, agent string"
)
BLOCKS = "session_id string, block_id int, start int, end int, intent string"
TRAJECTORIES = (
    "session_id string, session_type string, project string, intent string, "
    "what_happened array<struct<phase:string,summary:string>>, "
    "problems_encountered array<struct<problem:string,how_resolved:string,lessons:string>>, "
    "key_decisions array<struct<decision:string,rationale:string,outcome:string>>, "
    "lessons_learned array<string>, discoveries array<string>, label string, label_score double"
)
TOPICS = "topic_id string, topic_name string, topic_summary string, session_ids array<string>, primary_project string"
RULE = (
    "struct<id:string,type:string,condition:string,action:string,evidence_from_success:array<string>,"
    "evidence_from_failure:array<string>,confidence:double,scope:string>"
)
SKILLS = (
    "topic_id string, topic_name string, skill_title string, skill_type string, description string, summary string, "
    f"rules array<{RULE}>, body string, source_sessions array<string>"
)
STATE = "last_run string, last_session_id string, processed_sessions array<string>, cost_accumulated double, stats map<string,long>"

LABELS = ("success", "partial", "failure")
NOISE_TOOLS = ("todowrite", "profile_update", "profile_query")
