"""The report of a run, as rows and as HTML."""

from __future__ import annotations

import html
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, markdown_to_html, percent, score_colour
from ..operators.sessions import label_reason
from .files import _safe, put

#: Rows of the report's tables; totals and errors are of all rows.
SHOWN = 500
LABEL_NAMES = {"success": "成功", "partial": "部分", "failure": "失败"}
_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px}.bar{background:#48c;height:10px}.green{background:#2a2}.amber{background:#ca2}.red{background:#c33}.card{border:1px solid #ccc;padding:8px;margin:8px 0}"


def duration(seconds: float) -> str:
    """As ``duration_text`` gives it, for the few steps of a run."""
    return f"{seconds:.1f} 秒" if seconds < 60 else f"{int(seconds // 60)} 分 {round(seconds % 60)} 秒"


@dataclass
class Report:
    project: str
    date: str
    note: str = ""
    steps: list[tuple[str, float]] = field(default_factory=list)
    session_rows: list[dict] = field(default_factory=list)
    labels: dict[str, int] = field(default_factory=dict)
    topic_rows: list[dict] = field(default_factory=list)
    #: A row for each task and model that was asked in this run.
    usage: list[dict] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    #: Rows that the tables leave out.
    hidden: dict[str, int] = field(default_factory=dict)

    def step(self, name: str, seconds: float) -> None:
        self.steps.append((name, seconds))

    def used(self, sums: dict[tuple[str, str], dict[str, int]]) -> None:
        self.usage = [{"task": task, "model": model, **n} for (task, model), n in sorted(sums.items())]

    def by_model(self) -> list[dict]:
        """The usage of all tasks, a row for each model."""
        out: dict[str, dict] = {}
        for row in self.usage:
            held = out.setdefault(row["model"], {"model": row["model"], "calls": 0, "input_tokens": 0, "output_tokens": 0})
            for k in ("calls", "input_tokens", "output_tokens"):
                held[k] += row[k]
        return list(out.values())

    def sessions(self, mined: DataFrame) -> None:
        why = label_reason(F.col("label"), F.transform("problems_encountered", lambda p: p["problem"]), F.col("lessons_learned"))
        rows = mined.orderBy("pos").limit(SHOWN).select("session_id", "title", "project", "message_count", "tool_count", "label", "label_score", score_colour(F.col("label_score")).alias("colour"), "intent", why.alias("reason"), "error").collect()
        self.session_rows = [r.asDict() for r in rows]
        self.hidden["sessions"] = mined.count() - len(rows)
        self.errors += [f"{r['session_id']}: {r['error']}" for r in mined.where("error <> ''").orderBy("pos").select("session_id", "error").collect()]
        self.labels = {r["label"]: r["count"] for r in mined.where("status = 'ok'").groupBy("label").count().collect()}

    def skills(self, skills: DataFrame) -> None:
        rules = F.transform("rules", lambda x: F.struct(x["type"], x["action"], x["condition"], percent(x["confidence"]).alias("percent"), score_colour(x["confidence"]).alias("colour")))
        rows = skills.orderBy("topic_id").limit(SHOWN).select(
            "topic_id", "skill_title", "skill_type", "description", F.size("rules").alias("n_rules"), F.size("source_sessions").alias("n_sessions"),
            rules.alias("rules"), markdown_to_html(html_escape(F.col("body"))).alias("body_html")).collect()
        self.topic_rows = [r.asDict(recursive=True) for r in rows]
        self.hidden["topics"] = skills.count() - len(rows)

    def failed_topics(self, failed: DataFrame) -> None:
        self.errors += [f"topic {r['topic_id']}: {r['error']}" for r in failed.orderBy("topic_id").select("topic_id", "error").collect()]

    def html(self) -> str:
        e = lambda x: html.escape("" if x is None else str(x))

        def table(rows: list[dict]) -> str:
            if not rows:
                return "<p>–</p>"
            head = "".join(f"<th>{e(k)}</th>" for k in rows[0])
            body = "".join("<tr>" + "".join(f"<td>{e(LABEL_NAMES.get(v, v) if k == 'label' else v)}</td>" for k, v in r.items()) + "</tr>" for r in rows)
            return f"<table><tr>{head}</tr>{body}</table>"

        def bar(share: float, colour: str) -> str:
            return f"<div class='bar {colour}' style='width:{100 * min(max(share, 0), 1):.0f}%'></div>"

        def card(t: dict) -> str:
            rules = "".join(
                f"<li>[{e(r['type'])}] {e(r['action'])}{' (when: ' + e(r['condition']) + ')' if r['condition'] else ''} {r['percent']}%{bar(r['percent'] / 100, r['colour'])}</li>" for r in t["rules"])
            facts = f"{e(t['skill_type'])}, {t['n_rules']} rules, {t['n_sessions']} sessions"
            return f"<div class=card><h3>{e(t['skill_title'])}</h3><p>{facts}</p><p>{e(t['description'])}</p><ul>{rules}</ul><div>{t['body_html']}</div></div>"

        scored = [{k: v for k, v in r.items() if k != "colour"} for r in self.session_rows]
        scores = "".join(f"<p>{e(r['session_id'])}{bar(r['label_score'], r['colour'])}</p>" for r in self.session_rows)
        longest = max((s for _, s in self.steps), default=1) or 1
        bars = "".join(f"<p>{e(n)} {duration(s)}{bar(s / longest, '')}</p>" for n, s in self.steps)
        counts = " | ".join(f"{LABEL_NAMES[k]}: {self.labels.get(k, 0)}" for k in LABEL_NAMES)
        parts = {
            "sessions": table(scored) + scores, "topics": "".join(card(t) for t in self.topic_rows) or "<p>–</p>", "timeline": bars,
            "usage": table(self.by_model()) + table(self.usage),
            "files": table([{"name": k, "path": v} for k, v in self.paths.items()]), "errors": "".join(f"<p>{e(x)}</p>" for x in self.errors) or "<p>–</p>",
        }
        for k, n in self.hidden.items():
            parts[k] += f"<p>{n} more rows are not shown</p>" if n else ""
        nav = " ".join(f"<a href='#{k}'>{k}</a>" for k in parts)
        body = "".join(f"<h2 id={k}>{k}</h2>{v}" for k, v in parts.items())
        return f"<!DOCTYPE html><meta charset=utf-8><title>{e(self.project)}</title><style>{_STYLE}</style><h1>{e(self.project)} {e(self.date)}</h1><p>{nav}</p><p>{counts}</p><p>{e(self.note)}</p>{body}"

    def write_html(self, output: str) -> str:
        return put(f"{output}/reports/{_safe(self.project)}_{self.date}.html", self.html())
