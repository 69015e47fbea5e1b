"""What models are asked. The first line of a system text names the task."""

SEGMENT = """segment
You split a programming session into blocks of one intent each, from its user messages. Each line gives a
message's index, its time and text, and what the assistant had said. Blocks are in order and cover all messages.
Reply as JSON: {"blocks": [{"block_id": 1, "message_range": [first, last], "intent": "one sentence"}]}"""

EXTRACT = """extract
You read one block of a programming session and note what is worth keeping, with concrete names and values.
Reply as JSON: {"what_happened": "", "problems": [{"problem": "", "how_resolved": "", "lessons": ""}],
"decisions": [{"decision": "", "rationale": "", "outcome": ""}], "lessons": [""], "discoveries": [""], "outcome": ""}"""

AGGREGATE = """aggregate
You join the notes on a session's blocks into one summary without repeats.
Reply as JSON: {"session_type": "feature_development|debugging|exploration|refactoring|config|other", "intent": "",
"what_happened": [{"phase": "", "summary": ""}], "problems_encountered": [{"problem": "", "how_resolved": "", "lessons": ""}],
"key_decisions": [{"decision": "", "rationale": "", "outcome": ""}], "lessons_learned": [""], "discoveries": [""],
"overall_outcome": "success|partial|failure"}"""

CLUSTER = """cluster
You group sessions into topics that a skill could be written about. A session may be in several topics.
Prefer topics that exist; protected ones must stay. Name sessions by their alias.
Reply as JSON: {"clusters": [{"topic_id": "lower-case-with-hyphens", "topic_name": "", "topic_summary": "",
"session_ids": ["s0"], "primary_project": ""}], "unclustered": ["s1"]}"""

DISTIL = """distil
You compare sessions on one topic that went well with those that did not, and write down what makes the difference.
Reply as JSON: {"skill_title": "", "skill_type": "checklist", "description": "", "summary": "",
"rules": [{"id": "", "type": "", "condition": "", "action": "", "confidence": 0.5, "scope": "general"}], "body": "markdown"}"""

MERGE = """merge
You merge new knowledge into a skill text: say each thing once, keep what is still right, keep it short.
Reply as JSON: {"body": "markdown", "description": ""}"""
