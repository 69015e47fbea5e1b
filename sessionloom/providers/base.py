"""What a provider is, and one that answers by rule so that runs need no network."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Protocol


class ContextOverflow(Exception):
    """The prompt is too long for the model; asking again does not help."""


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


class Provider(Protocol):
    """Built once in each partition from a picklable factory."""

    model_name: str

    def complete(self, system: str, prompt: str, temperature: float, max_tokens: int) -> Reply: ...

    def close(self) -> None: ...


class RuleProvider:
    """Deterministic replies of the right shape, found from the first line of the system text, the task's name."""

    model_name = "rules"

    def complete(self, system: str, prompt: str, temperature: float = 0.2, max_tokens: int = 4096) -> Reply:
        task = system.split("\n", 1)[0].strip().lower()
        value = getattr(self, f"_{task}", lambda p: {})(prompt)
        text = json.dumps(value, ensure_ascii=False)
        return Reply(text, len(prompt) // 4 + 1, len(text) // 4 + 1)

    def close(self) -> None:
        pass

    @staticmethod
    def _segment(prompt: str) -> dict:
        """A block from each user message to the next."""
        found = [(int(i), t) for i, t in re.findall(r"(?m)^#(\d+) \[[^\]]*\] (.*)$", prompt)]
        ends = [i - 1 for i, _ in found[1:]] + [found[-1][0] + 1] if found else []
        return {"blocks": [{"block_id": k + 1, "message_range": [i, e], "intent": t[:60]} for k, ((i, t), e) in enumerate(zip(found, ends, strict=True))]}

    @staticmethod
    def _extract(prompt: str) -> dict:
        lines = prompt.split("\n")
        errors = [x[8:88] for x in lines if x.startswith("[ERROR] ")]
        return {
            "what_happened": "; ".join(x[:60] for x in lines if x.startswith("[TOOL] "))[:300],
            "problems": [{"problem": e, "how_resolved": "", "lessons": ""} for e in errors],
            "decisions": [], "lessons": [f"avoid: {e}" for e in errors], "outcome": "failure" if errors else "success",
        }

    @staticmethod
    def _aggregate(prompt: str) -> dict:
        start = prompt.find("[")
        try:
            blocks, _ = json.JSONDecoder().raw_decode(prompt[start:]) if start >= 0 else ([], 0)
        except ValueError:
            blocks = []
        problems = [p for b in blocks for p in b.get("problems", [])]
        return {
            "session_type": "debugging" if problems else "feature_development", "intent": blocks[0].get("intent", "") if blocks else "",
            "what_happened": [{"phase": b.get("intent", ""), "summary": b.get("what_happened", "")} for b in blocks],
            "problems_encountered": problems, "key_decisions": [], "lessons_learned": sorted({x for b in blocks for x in b.get("lessons", [])}),
            "discoveries": [], "overall_outcome": "failure" if problems else "success",
        }

    @staticmethod
    def _cluster(prompt: str) -> dict:
        """Topics by project and kind; topics by their names."""
        groups: dict[tuple[str, str], list[str]] = {}
        for alias, rest in re.findall(r"(?m)^(s\d+): (.*)$", prompt):
            field = dict(x.split("=", 1) for x in rest.split(" | ")[1:] if "=" in x)
            project = field.get("project", "")
            groups.setdefault((project, field["topic"] if "topic" in field else f"{project} {field.get('type', '')}"), []).append(alias)
        clusters = [{"topic_id": name, "topic_name": name.strip(), "topic_summary": f"{len(ids)} sessions", "session_ids": ids, "primary_project": p} for (p, name), ids in sorted(groups.items())]
        return {"clusters": clusters, "unclustered": []}

    @staticmethod
    def _distil(prompt: str) -> dict:
        lessons = sorted({x.strip() for line in re.findall(r"(?m)^Lessons: (.*)$", prompt) for x in line.split(";") if x.strip()})
        intents = re.findall(r"(?m)^Intent: (.*)$", prompt)
        name = (re.findall(r"(?m)^Topic: (.*)$", prompt) or ["topic"])[0]
        rules = [{"id": f"rule_{i}", "type": "must_do", "condition": "", "action": x, "confidence": 0.6} for i, x in enumerate(lessons)]
        body = "\n".join(f"- {x[:80]}" for x in intents)
        return {"skill_title": name, "skill_type": "checklist", "description": f"{len(intents)} sessions on {name}", "summary": f"What sessions on {name} show", "rules": rules, "body": body}

    @staticmethod
    def _merge(prompt: str) -> dict:
        """Lines of both bodies, once each."""
        old, _, new = prompt.partition("\n=== NEW ===\n")
        kept = list(dict.fromkeys([*old.removeprefix("=== CURRENT ===\n").split("\n"), *new.split("\n")]))
        return {"body": "\n".join(kept)}
